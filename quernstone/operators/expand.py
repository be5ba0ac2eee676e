"""Document expansion: gaps, expansions, entailment, queries, filters, deduplication and the expanded text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import providers as P

THRESHOLD, MOST, QUERIES = 0.85, 10, 3
NONE = "array<string>"


def greedy_keep(sims: np.ndarray, threshold: float = THRESHOLD) -> list[int]:
    """Items in order, without those at least that similar to an item kept before; dropped items drop nothing."""
    kept: list[int] = []
    for i in range(len(sims)):
        if not any(sims[i, j] >= threshold for j in kept):
            kept.append(i)
    return kept


def deduplicated(df: DataFrame, items: str, doc: str | None, encoder: P.Encoder, out: str, threshold: float = THRESHOLD, size: int = 256) -> DataFrame:
    """The rows with their items without near repetitions and without those too similar to the document; an array of
    one item or none stays as it is. A row is a document, so its items are few. Where the encoder fails on a batch its
    rows are encoded one by one, and a row it fails on has null items and the error (out_error)."""

    def kept(xs: list[str], own: str | None) -> list[str]:
        if len(xs) <= 1:
            return xs
        codes = encoder.encode(xs)
        keep = greedy_keep(codes @ codes.T, threshold)
        if own:
            near = codes @ encoder.encode([own])[0]
            keep = [i for i in keep if float(near[i]) < threshold]
        return [xs[i] for i in keep]

    def whole(lists, docs):
        flat = [x for xs in lists for x in xs if len(xs) > 1]
        codes = encoder.encode(flat) if flat else np.zeros((0, 1))
        own = encoder.encode([d or "" for d in docs]) if flat and doc is not None else None
        at, out_ = 0, []
        for row, xs in enumerate(lists):
            if len(xs) <= 1:
                out_.append(xs)
                continue
            v = codes[at : at + len(xs)]
            at += len(xs)
            keep = greedy_keep(v @ v.T, threshold)
            if own is not None and docs[row]:
                keep = [i for i in keep if float(v[i] @ own[row]) < threshold]
            out_.append([xs[i] for i in keep])
        return out_

    def one(xs: list[str], own: str | None) -> tuple[list[str] | None, str | None]:
        try:
            return kept(xs, own), None
        except Exception as error:
            return None, str(error)

    def call(lists, docs=None):
        lists, docs = [xs or [] for xs in lists], docs or [None] * len(lists)
        try:
            found, errors = whole(lists, docs), [None] * len(lists)
        except Exception:  # the provider's, reported with its rows
            told = [one(*x) for x in zip(lists, docs)]
            found, errors = [x for x, _ in told], [e for _, e in told]
        return [pa.array(found, pa.list_(pa.string())), pa.array(errors, pa.string())]

    return P.apply_batched(df, [items] if doc is None else [items, doc], [(out, NONE), (f"{out}_error", "string")], call, size)


def deduplicated_vectors(df: DataFrame, group: str, key: str, vector: str, threshold: float = THRESHOLD) -> DataFrame:
    """(group, key) of the vectors that stay, in key order, of groups small enough for a task."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        v = np.array(table.column("vector").to_pylist(), dtype=np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        return table.select(["grp", "key"]).take(pa.array(greedy_keep(v @ v.T, threshold)))

    rows = df.select(df[group].alias("grp"), df[key].alias("key"), df[vector].alias("vector"))
    return rows.groupBy("grp").applyInArrow(run, f"grp {kinds[group]}, key {kinds[key]}").toDF(group, key)


def unlike_document(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (item and doc vectors of length one) whose cosine is below the threshold."""
    from quernstone.operators.dense import dot

    return df.where(dot("item", "doc") < threshold)


def combine(df: DataFrame, doc: str, semantic: str, queries: str, encoder: P.Encoder) -> DataFrame:
    """The rows with semantic and queries filtered, final (at most ten of both, deduplicated), expanded, and combine_error;
    where combining fails, final has the first ten as they came."""
    empty = F.array().cast(NONE)
    rows = df.withColumns({"_sem": X.useful_expansions(F.col(semantic), F.col(doc)), "_ask": X.useful_expansions(F.col(queries), F.col(doc))})
    rows = deduplicated(rows.withColumn("_all", F.concat("_sem", "_ask")), "_all", doc, encoder, "_kept")
    plain = F.concat(F.coalesce(semantic, empty), F.coalesce(queries, empty))
    final = F.slice(F.when(F.col("_kept_error").isNull(), F.col("_kept")).otherwise(plain), 1, MOST)
    return rows.withColumns({"final": final, "expanded": X.joined(F.col(doc), final), "combine_error": F.col("_kept_error")}).drop("_all", "_kept", "_kept_error", "_sem", "_ask")


def expand(
    docs: DataFrame, generator: P.TextGenerator | None, nli: P.NliClassifier | None, asker: P.QueryGenerator | None, encoder: P.Encoder,
    frame: tuple[str, str] = X.INSTRUCT, n: int = QUERIES, mode: str = "lenient",
) -> DataFrame:
    """(doc_id, original, gaps, raw_expansions, valid_expansions, queries, final, expanded, error) of (doc_id, text).

    Each stage may be missing and may fail: its error is given in the row and the row goes on with what it has.
    valid_expansions stays empty without a classifier, though all expansions then go on.
    """
    empty = F.array().cast(NONE)
    rows = docs.select("doc_id", F.col("text").alias("original"))
    errors = []
    if generator:
        asked = P.answer(rows.withColumn("_p", X.filled(X.GAP_PROMPT, frame, document=F.col("original"))), "_p", generator, "_gaps")
        asked = asked.withColumn("gaps", F.coalesce(X.parsed_lines(F.col("_gaps")), empty))
        listed = F.when(F.size("gaps") > 0, F.array_join("gaps", "\n")).otherwise(F.lit("none"))
        asked = P.answer(asked.withColumn("_p", X.filled(X.EXPAND_PROMPT, frame, document=F.col("original"), gaps=listed)), "_p", generator, "_exp")
        rows = asked.withColumn("raw_expansions", F.coalesce(X.parsed_lines(F.col("_exp")), empty))
        errors += ["_gaps_error", "_exp_error"]
    else:
        rows = rows.withColumns({"gaps": empty, "raw_expansions": empty})
    if nli:
        rows = P.entail(rows, "original", "raw_expansions", nli, "_valid", mode).withColumn("valid_expansions", F.col("_valid"))
        errors.append("_valid_error")
    else:
        rows = rows.withColumns({"_valid": F.col("raw_expansions"), "valid_expansions": empty})
    if asker:
        rows = P.ask(rows, "original", asker, n, "queries")
        errors.append("queries_error")
    else:
        rows = rows.withColumn("queries", empty)
    rows = combine(rows, "original", "_valid", "queries", encoder)
    error = F.concat_ws("; ", *errors, "combine_error")
    return rows.select("doc_id", "original", "gaps", "raw_expansions", "valid_expansions", "queries", "final", "expanded", F.nullif(error, F.lit("")).alias("error"))


def expand_single_prompt(docs: DataFrame, generator: P.TextGenerator, frame: tuple[str, str] = X.CHAT, most: int = 500) -> DataFrame:
    """(doc_id, original, expanded, error): the text and the answer to one prompt about its first most characters; after
    an error the text alone."""
    rows = docs.select("doc_id", F.col("text").alias("original"))
    asked = P.answer(rows.withColumn("_p", X.filled(X.PASSAGE_PROMPT, frame, document=F.substring("original", 1, most))), "_p", generator, "_answer")
    expanded = F.when(F.col("_answer").isNull(), F.col("original")).otherwise(F.concat("original", F.lit(" "), X.strip(F.col("_answer"))))
    return asked.select("doc_id", "original", expanded.alias("expanded"), F.col("_answer_error").alias("error"))


def expand_queries_only(docs: DataFrame, asker: P.QueryGenerator, n: int = QUERIES) -> DataFrame:
    """(doc_id, original, queries, expanded): the text and all its queries."""
    rows = P.ask(docs.select("doc_id", F.col("text").alias("original")), "original", asker, n)
    return rows.select("doc_id", "original", "queries", X.joined(F.col("original"), F.col("queries")).alias("expanded"))


def validate_added(expanded: DataFrame, originals: DataFrame, nli: P.NliClassifier, mode: str = "lenient") -> DataFrame:
    """(doc_id, text, n_added, n_kept): expanded texts with the added sentences that don't contradict their original; a
    text without an original, or with an empty one, stays as it is."""
    rows = expanded.select("doc_id", "text").join(originals.select("doc_id", F.col("text").alias("original")), "doc_id", "left")
    known = F.col("original").isNotNull() & (F.col("original") != "")
    rows = rows.withColumn("added", F.when(known, X.added_sentences(F.col("original"), F.col("text"))).otherwise(F.array().cast(NONE)))
    rows = P.entail(rows, "original", "added", nli, "kept", mode)
    text = F.when(F.size("kept") > 0, X.joined(F.col("original"), F.col("kept"))).otherwise(F.col("original"))
    return rows.select("doc_id", F.when(known, text).otherwise(F.col("text")).alias("text"), F.size("added").alias("n_added"), F.size("kept").alias("n_kept"))


def keep_rates(validated: DataFrame) -> DataFrame:
    """kept, removed and keep_rate (percent; null if there was nothing) in one row."""
    kept, all_ = F.coalesce(F.sum("n_kept"), F.lit(0)), F.coalesce(F.sum("n_added"), F.lit(0))
    return validated.agg(kept.cast("long").alias("kept"), (all_ - kept).cast("long").alias("removed"), F.round(F.when(all_ > 0, 100.0 * kept / all_), 6).alias("keep_rate"))


def not_yet_done(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key isn't in the output yet: how a job goes on after it broke off."""
    return docs.join(done.select(key), key, "left_anti")  # reads the keys of done only
