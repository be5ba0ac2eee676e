"""The k best documents of many queries, worked out where the documents lie.

A pair of query and document is never a row: each task keeps the k best of each
query among its own documents, and only these are exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents that are scored at once, and numbers in the rows of their frequent terms (128 MB).
DOCS, CELLS = 16_384, 32_000_000
#: A term of more than one in so many documents of a block has a row of weights, others a list of documents.
FREQUENT = 24
#: Documents of one term that give a first bound of a query's k-th best score.
SEEDS = 400
#: Documents that are scored at once where each query's whole list of many is wanted.
LIST_DOCS = 32_768
#: Candidates that are held before they are scored in double precision.
HELD = 500_000
#: As everywhere, scores are ranked as rounded to so many decimals.
DECIMALS = 6


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, dl, t, n) with the rows of a document one after the other, to (doc_id, dl, terms, tfs) of one row a
    document, its terms in order. t -1 stands for no term: a document may have nothing else."""

    def of(batch: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        starts, doc = np.flatnonzero(new), np.cumsum(new) - 1
        t, n = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
        order = np.lexsort((t, doc))
        order = order[t[order] >= 0]
        t, n, doc = t[order], n[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])])) if len(t) else np.zeros(0, dtype=np.int64)
        tf = np.add.reduceat(n, first) if len(t) else n
        offsets = pa.array(np.searchsorted(doc[first], np.arange(len(starts) + 1)).astype(np.int32))
        at = pa.array(starts)
        columns = [batch.column(0).take(at), batch.column(1).take(at)]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (t[first], tf)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "dl", "terms", "tfs"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        ids = batch.column(0)
        other = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), False).to_numpy(zero_copy_only=False).astype(bool)
        new = np.concatenate([[True], other])
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield of(batch.slice(0, last), new[:last])
        rest = batch.slice(last)
    if rest is not None:
        yield of(rest, np.arange(rest.num_rows) == 0)


#: Postings that are held before they are packed for an exchange (16 MB).
CHUNK = 500_000


def by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, dl, terms) of documents, to (term, docs, dls, tfs) of one row a term of a batch, and one of all its documents,
    whose term is empty as no other is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(2).flatten().dictionary_encode()
        doc = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column(2))))
        key, tf = np.unique(np.asarray(codes.indices).astype(np.int64) * batch.num_rows + doc, return_counts=True)
        term, doc = key // batch.num_rows, pa.array(key % batch.num_rows)
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        offsets = pa.array(np.append(start, len(term)).astype(np.int32))
        held = (batch.column(0).take(doc), batch.column(1).take(doc).cast(pa.int32()), pa.array(tf.astype(np.int32)))
        every = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), x) for x in (batch.column(0), batch.column(1).cast(pa.int32()), pa.nulls(batch.num_rows, pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array([""]), *every], ["term", "docs", "dls", "tfs"])
        yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(term[start])), *(pa.ListArray.from_arrays(offsets, x) for x in held)], ["term", "docs", "dls", "tfs"])


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, dl, t, n, chunk), to rows of chunk and held: its rows, compressed."""

    def of(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        rows = rows.sort_by([("chunk", "ascending"), ("t", "ascending"), ("doc_id", "ascending")])
        chunk = rows.column("chunk").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        rows, held = rows.drop_columns(["chunk"]), []
        for a, e in zip(start.tolist(), [*start[1:].tolist(), len(chunk)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.slice(a, e - a))
            held.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(chunk[start], pa.int32()), pa.array(held, pa.binary())], ["chunk", "held"])

    waiting, n = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield of(waiting)
            waiting, n = [], 0
    if n:
        yield of(waiting)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that chunked() packed."""
    for batch in batches:
        for held in batch.column(1):
            yield from pa.ipc.open_stream(held.as_buffer())


class _Best:
    """The k best of each query so far; least: the k-th best score, which another document has to reach."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.q, self.score, self.doc = np.zeros(0, dtype=np.int64), np.zeros(0), None

    def take(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        if not len(q):
            return
        if self.doc is not None:
            q, score, doc = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc if doc.dtype != object else np.unique(doc, return_inverse=True)[1], -score, q))
        q = q[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        keep = order[place < self.k]
        self.q, self.score, self.doc = q[place < self.k], score[keep], doc[keep]
        full = order[place == self.k - 1]
        self.least[q[place == self.k - 1]] = score[full]


class _Block:
    """Weights of the terms in some documents: by term a list of documents, for frequent terms a row of all."""

    def __init__(self, asked: dict, doc: np.ndarray, dl: np.ndarray, sizes: np.ndarray, t: np.ndarray, tf: np.ndarray):
        self.asked, self.doc, self.n = asked, doc, len(doc)
        k1, b = asked["k1"], asked["b"]
        d = np.repeat(np.arange(self.n), sizes)
        order = np.argsort(t, kind="stable")
        t, d, tf = t[order].astype(np.int64), d[order], tf[order].astype(np.float64)
        self.w = asked["idf"][t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[d] / asked["avgdl"]))
        self.key, self.d, self.w32 = t * self.n + d, d, self.w.astype(np.float32)
        self.present, start = np.unique(t, return_index=True)
        end = np.append(start[1:], len(t))
        terms = len(asked["idf"])
        self.start, self.end = np.zeros(terms, dtype=np.int64), np.zeros(terms, dtype=np.int64)
        self.start[self.present], self.end[self.present] = start, end
        self.most, self.size = np.zeros(terms), np.zeros(terms)
        if len(t):
            self.most[self.present] = np.maximum(np.maximum.reduceat(self.w, start), 0)
            self.size[self.present] = np.maximum.reduceat(np.abs(self.w), start)
        count = end - start
        common = np.flatnonzero(count > self.n / FREQUENT)
        common = common[np.argsort(-count[common], kind="stable")][: max(1, CELLS // self.n)]
        self.rows: dict[int, np.ndarray] = {}
        for i in common:
            row = np.zeros(self.n, dtype=np.float32)
            row[d[start[i] : end[i]]] = self.w32[start[i] : end[i]]
            self.rows[int(self.present[i])] = row

    def docs_of(self, t: int) -> np.ndarray:
        return self.d[self.start[t] : self.end[t]]

    def weights(self, t: int, docs: np.ndarray) -> np.ndarray | float:
        """Of a term in these documents, in single precision."""
        if (row := self.rows.get(t)) is not None:
            return row[docs]
        a, e = self.start[t], self.end[t]
        if a == e:
            return np.float32(0)
        own = self.d[a:e]
        at = np.minimum(np.searchsorted(own, docs), e - a - 1)
        return np.where(own[at] == docs, self.w32[a:e][at], np.float32(0))

    def summed(self, terms: list[int], times: list[int], docs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), dtype=np.float32)
        for t, n in zip(terms, times):
            x = self.weights(t, docs)
            out += x if n == 1 else x * np.float32(n)
        return out

    def score(self, best: _Best, held: list[tuple[int, np.ndarray]]) -> None:
        """The candidates' scores in double precision, to the best."""
        if not held:
            return
        x = self.asked
        q = np.repeat(np.array([h[0] for h in held]), [len(h[1]) for h in held])
        docs = np.concatenate([h[1] for h in held])
        held.clear()
        many = x["at"][q + 1] - x["at"][q]
        start = np.cumsum(many) - many
        part = np.repeat(x["at"][q] - start, many) + np.arange(many.sum())
        want = x["terms"][part] * self.n + np.repeat(docs, many)
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = self.key[at] == want
        score = np.round(np.add.reduceat(np.where(hit, self.w[at] * x["times"][part], 0.0), start), DECIMALS) + 0.0
        keep = np.ones(len(q), dtype=bool)
        if x["every"]:
            keep &= np.add.reduceat(hit.astype(np.int64), start) == many
        if x["positive"]:
            keep &= score > 0
        best.take(q[keep], score[keep], self.doc[docs[keep]])

    def search(self, best: _Best) -> None:
        """Every document that may be among the k best of a query is scored.

        most bounds what a term adds to any document here. Terms, from the smallest bound on, whose bounds together
        don't reach the k-th best score so far can't bring a document among the best by themselves: only documents of
        the other terms are looked at, and of these only those that reach it with the bounds of the rest added. The
        first documents of a query are compared in single precision, with room for its error and the rounding.
        """
        if not len(self.key):
            return
        x, k = self.asked, best.k
        queries = len(x["at"]) - 1
        owner = np.repeat(np.arange(queries), np.diff(x["at"]))
        bound = self.most[x["terms"]] * x["times"]
        there = self.end[x["terms"]] > self.start[x["terms"]]
        order = np.lexsort((bound, owner))
        order = order[there[order]]
        terms, times, bound, own = x["terms"][order], x["times"][order], bound[order], owner[order]
        at = np.searchsorted(own, np.arange(queries + 1))
        total = np.concatenate([[0.0], np.cumsum(bound)])
        below = total[1:] - total[at[:-1]][own]  # of a query's terms up to this one
        size = np.bincount(own, self.size[terms] * times, queries)
        error = 2e-6 + 3e-7 * (np.diff(at) + 2) * size + 1e-10 * total[-1]
        cut = best.least - error
        spare = np.bincount(own, below < cut[own], queries).astype(np.int64)  # how many terms can't do it alone
        full = np.diff(at)
        todo = np.flatnonzero((full > 0) & (spare < full))
        if x["every"]:
            todo = todo[full[todo] == np.diff(x["at"])[todo]]
        terms_, times_, below_ = terms.tolist(), times.tolist(), below.tolist()
        acc, held, waiting = np.zeros(self.n, dtype=np.float32), [], 0
        for q, a, e, s, least, err in zip(todo.tolist(), at[todo].tolist(), at[todo + 1].tolist(), spare[todo].tolist(), cut[todo].tolist(), error[todo].tolist()):
            ts, ns = terms_[a:e], times_[a:e]
            if x["every"]:
                by = sorted(ts, key=lambda t: self.end[t] - self.start[t])
                c = self.docs_of(by[0])
                for t in by[1:]:
                    other = self.docs_of(t)
                    c = c[other[np.minimum(np.searchsorted(other, c), len(other) - 1)] == c]
                    if not len(c):
                        break
            else:
                if least <= 0:  # no k documents known: some of the rarest term that has as many
                    lead = next((t for t in reversed(ts) if self.end[t] - self.start[t] >= k), None)
                    if lead is not None:
                        some = self.summed(ts, ns, self.docs_of(lead)[: max(k, SEEDS)])
                        least = max(least, float(np.partition(some, len(some) - k)[len(some) - k]) - 2 * err)
                        s = sum(v < least for v in below_[a:e])
                if least > 0:
                    need = least - (below_[a + s - 1] if s else 0.0)
                    rows = []
                    for t, n in zip(ts[s:], ns[s:]):
                        if (row := self.rows.get(t)) is None:
                            i, j = self.start[t], self.end[t]
                            acc[self.d[i:j]] += self.w32[i:j] if n == 1 else self.w32[i:j] * np.float32(n)
                        else:
                            rows.append(row if n == 1 else row * np.float32(n))
                    for row in rows:
                        acc += row
                    c = np.flatnonzero(acc >= need)
                    got = acc[c]
                    acc.fill(0)
                    for i in range(s - 1, -1, -1):  # the larger bounds first, so most candidates go early
                        if not len(c):
                            break
                        got = got + (self.weights(ts[i], c) if ns[i] == 1 else self.weights(ts[i], c) * np.float32(ns[i]))
                        keep = got >= least - (below_[a + i - 1] if i else 0.0)
                        c, got = c[keep], got[keep]
                else:
                    c = np.unique(np.concatenate([self.docs_of(t) for t in ts]))
                    got = self.summed(ts, ns, c)
                if len(c):
                    if len(c) > 4 * k:
                        least = max(least, float(np.partition(got, len(got) - k)[len(got) - k]) - 2 * err)
                    c = c[got >= least]
            if len(c):
                held.append((q, c))
                waiting += len(c)
                if waiting > HELD:
                    self.score(best, held)
                    waiting = 0
        self.score(best, held)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of documents (doc_id, dl, terms, tfs) so many at once: their ids, dl, numbers of terms, terms and tfs."""

    def of(rows: pa.Table) -> tuple[np.ndarray, ...]:
        doc, dl, terms, tfs = (c.combine_chunks() for c in rows.columns)
        sizes = np.asarray(pc.list_value_length(terms)).astype(np.int64)
        return doc.to_numpy(zero_copy_only=False), np.asarray(dl).astype(np.float64), sizes, np.asarray(terms.flatten()), np.asarray(tfs.flatten())

    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        while n >= size:
            rows = pa.Table.from_batches(waiting)
            yield of(rows.slice(0, size))
            waiting, n = rows.slice(size).to_batches(), n - size
    if n:
        yield of(pa.Table.from_batches(waiting))


def best_documents(shared, kind: pa.DataType):
    """Of documents (doc_id, dl, terms, tfs) the k best of each query: (qid, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = _Best(len(asked["at"]) - 1, asked["k"])
        for block in _blocks(batches, DOCS):
            _Block(asked, *block).search(best)
        for at in range(0, len(best.q), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([asked["qids"].take(pa.array(best.q[part])), pa.array(best.doc[part], kind), pa.array(best.score[part])], ["qid", "doc_id", "score"])

    return run


def _k_best(score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then document, in no order."""
    if len(score) <= k:
        return score, doc
    least = np.partition(score, len(score) - k)[len(score) - k]
    keep = score > least
    tied = np.flatnonzero(score == least)
    keep[tied[np.argsort(doc[tied], kind="stable")[: k - int(keep.sum())]]] = True
    return score[keep], doc[keep]


def best_lists(shared, kind: pa.DataType):
    """Of all documents (doc_id, dl, terms, tfs) the k best of each query, one row a query: (qid, docs), the best first.

    For many documents a query: every document with a term of it is scored, block by block in double precision.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        k, k1, b, n_queries = asked["k"], asked["k1"], asked["b"], len(asked["at"]) - 1
        at, terms_, times_ = asked["at"].tolist(), asked["terms"].tolist(), asked["times"].tolist()
        scores: list = [None] * n_queries
        docs: list = [None] * n_queries
        least = np.full(n_queries, -np.inf)
        for ids, dl, sizes, t, tf in _blocks(batches, LIST_DOCS):
            n = len(ids)
            d = np.repeat(np.arange(n), sizes)
            order = np.argsort(t, kind="stable")
            t, d, tf = t[order], d[order], tf[order].astype(np.float64)
            w = asked["idf"][t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[d] / asked["avgdl"]))
            ends = np.searchsorted(t, np.arange(len(asked["idf"]) + 1)).tolist()
            score, hits = np.zeros(n), np.zeros(n, dtype=np.int32)
            for q in range(n_queries):
                own = range(at[q], at[q + 1])
                for i in own:
                    x, y = ends[terms_[i]], ends[terms_[i] + 1]
                    if x < y:
                        score[d[x:y]] += w[x:y] if times_[i] == 1 else w[x:y] * times_[i]
                        if asked["every"] or least[q] <= 0:
                            hits[d[x:y]] += 1
                if asked["every"] or least[q] <= 0:
                    c = np.flatnonzero(hits >= (len(own) if asked["every"] else 1))
                    hits.fill(0)
                else:  # a document with no term has 0, so it doesn't reach the k-th best
                    c = np.flatnonzero(score >= least[q] - 1e-6)
                s = np.round(score[c], DECIMALS) + 0.0
                score.fill(0)
                keep = s >= least[q]
                if asked["positive"]:
                    keep &= s > 0
                if not keep.all():
                    c, s = c[keep], s[keep]
                if not len(c):
                    continue
                own_docs = ids[c]
                if scores[q] is not None:
                    s, own_docs = np.concatenate([scores[q], s]), np.concatenate([docs[q], own_docs])
                scores[q], docs[q] = _k_best(s, own_docs, k)
                if len(scores[q]) == k:
                    least[q] = scores[q].min()
        for first in range(0, n_queries, 500):
            part = range(first, min(first + 500, n_queries))
            lists = [docs[q][np.lexsort((docs[q] if docs[q].dtype != object else np.unique(docs[q], return_inverse=True)[1], -scores[q]))] if docs[q] is not None else np.zeros(0, dtype=np.int64) for q in part]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
            values = pa.concat_arrays([pa.array(x, kind) if len(x) else pa.array([], kind) for x in lists])
            yield pa.RecordBatch.from_arrays([asked["qids"].slice(first, len(part)), pa.ListArray.from_arrays(offsets, values)], ["qid", "docs"])

    return run
