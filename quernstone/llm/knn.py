"""Problem 3: the k most similar vectors of every vector, by a permutation index.

A bounded sample of the vectors serves as pivots. Every vector is represented
by its nearest pivots in order (a prefix of its permutation) and posted in the
inverted file of each of them. Two vectors that meet in no file share no pivot,
so their footrule distance is the largest there is; all others rank before
them, and every vector is reranked by cosine against all that it meets, none
cut off by rank. A pair that meets in several files counts in the first of
them in the order of the vector that asks.

A file is all one task needs, and only the best k of a file leave it. The
number of pivots grows with the number of vectors, so files stay as long as
they are and hardly a neighbour more is missed in larger collections; a vector
finds its pivots through coarser ones, of which there are as many as the root
of the number of pivots.

A dense cluster would put many pivots into itself, and its members would be
scattered over them nearly at random. So no two pivots are nearer than APART:
a cluster denser than that has one pivot, and all its members meet.

Exact copies are one vector here, whatever their number, and are written out at
the end. A file that is too large for a task is cut into blocks, and every two
blocks meet on their own, so none is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.session import written
from quernstone.sources.tables import hashed_sample

#: Files a vector is posted in.
LISTS = 3
#: One of so many vectors is a pivot before thinning, MOST_PIVOTS at most (67 MB to a task at 64 numbers, reached at a
#: million vectors; beyond, files grow in proportion).
PIVOT_EVERY, MOST_PIVOTS = 4, 262_144
#: Coarse pivots whose pivots a vector is compared with.
PROBES = 16
#: Two pivots have at most this cosine.
APART = 0.8
#: Members of a file that meet in one task.
BLOCK = 16_000
#: Copies of one vector that are joined to their class by a shuffle; larger classes, of which there are few, are broadcast.
HUGE = 100_000
#: Cosines are compared to this many decimals, beyond which single precision tells nothing.
DECIMALS = 6


def clean_id(column: Column) -> Column:
    """The text inside a possible byte-literal wrapper."""
    return F.regexp_replace(column, "^b(['\"])(.*)\\1$", "$2")


def usable(column: Column, dim: int) -> Column:
    """dim finite numbers that aren't all zero."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return column.isNotNull() & (F.size(column) == dim) & F.coalesce(fine, F.lit(False)) & F.exists(column, lambda x: x != 0)


def _units(column: pa.Array, rows: int) -> list[bytes]:
    """The vectors at length one in single precision, as bytes."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True) if rows else x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)
    return [r.tobytes() for r in x]


def _print(unit: bytes) -> bytes:
    return hashlib.blake2b(unit, digest_size=16).digest()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_print(u) for u in _units(batch.column(1), batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["id", "print"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        once = {_print(u): u for u in _units(batch.column(0), batch.num_rows)}
        yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.binary()), pa.array(list(once.values()), pa.binary())], ["print", "vec"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype="<f4").reshape(len(rows), -1)


def _short(x: np.ndarray) -> list[bytes]:
    """Vectors as 24-bit numbers, which is all that single precision tells of them; the scale falls out of a cosine."""
    x = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 8_388_607).astype("<i4")
    return [r.tobytes() for r in x.view(np.uint8).reshape(*x.shape, 4)[:, :, :3]]


def _long(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The same at length one, in double precision."""
    rows = column.to_pylist()
    short = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1, 3)
    full = np.zeros((*short.shape[:2], 4), dtype=np.uint8)
    full[:, :, 1:] = short
    x = (full.reshape(len(rows), -1).view("<i4") >> 8).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def thinned(pivots: np.ndarray, apart: float = APART) -> np.ndarray:
    """The pivots, of those nearer than apart to an earlier one that stays only that one."""
    stays = np.ones(len(pivots), dtype=bool)
    for at in range(0, len(pivots), 500):
        part = pivots[at : at + 500]
        own = stays[at : at + 500]
        if at:
            for low in range(0, at, 8_000):
                own &= ~(part @ pivots[low : min(at, low + 8_000)][stays[low : min(at, low + 8_000)]].T > apart).any(axis=1)
        near = part @ part.T > apart
        for i in range(len(part)):
            if own[i]:
                own[i + 1 :] &= ~near[i, i + 1 :]
    return pivots[stays]


class Pivots:
    """Pivots, each below the nearest of the first root of them."""

    def __init__(self, vectors: np.ndarray):
        self.coarse = vectors[: max(1, round(len(vectors) ** 0.5))].T.copy()
        home = np.concatenate([(vectors[at : at + 10_000] @ self.coarse).argmax(axis=1) for at in range(0, len(vectors), 10_000)])
        self.order = np.argsort(home, kind="stable").astype(np.int32)
        self.starts = np.searchsorted(home[self.order], np.arange(self.coarse.shape[1] + 1))
        self.vectors = vectors[self.order]

    def nearest(self, x: np.ndarray, d: int) -> np.ndarray:
        """The d nearest pivots (rows, d) in order, of those below the PROBES nearest coarse ones; -1 where there are no more."""
        near = x @ self.coarse
        probes = min(PROBES, near.shape[1])
        below = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
        value = np.full((len(x), probes * d), -np.inf, dtype=np.float32)
        which = np.full((len(x), probes * d), -1, dtype=np.int32)
        flat = below.ravel()
        by = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[by], np.arange(near.shape[1] + 1))
        for c in np.flatnonzero(np.diff(ends)):
            a, b = self.starts[c], self.starts[c + 1]
            if a == b:
                continue
            rows, slots = np.divmod(by[ends[c] : ends[c + 1]], probes)
            cos = x[rows] @ self.vectors[a:b].T
            m = min(d, b - a)
            top = np.argpartition(-cos, m - 1, axis=1)[:, :m]
            places = slots[:, None] * d + np.arange(m)
            value[rows[:, None], places] = np.take_along_axis(cos, top, axis=1)
            which[rows[:, None], places] = self.order[a + top]
        best = np.argsort(-value, axis=1, kind="stable")[:, :d]
        return np.take_along_axis(which, best, axis=1)


def _permute(pivots, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4_000):
                batch = whole.slice(at, 4_000)
                vectors = _matrix(batch.column(1))
                places = pivots.value.nearest(vectors, prefix)
                offsets = pa.array(np.arange(len(places) + 1, dtype=np.int32) * places.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(_short(vectors), pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(places.ravel()))], ["rep", "vec", "prefix"]
                )

    return run


def shared_weight(prefixes: np.ndarray) -> np.ndarray:
    """For all pairs of different prefixes (n, d), the smaller weights of their shared pivots, added up: the footrule distance is
    d * (d + 1) less twice that. A measure of the index only: all that meet are compared by cosine."""
    n, d = prefixes.shape
    out = np.zeros((n, n), dtype=np.float32)
    weight = np.tile(np.arange(d, 0, -1, dtype=np.float32), n)
    flat, owner = prefixes.ravel(), np.repeat(np.arange(n), d)
    order = np.argsort(flat, kind="stable")
    flat, owner, weight = flat[order], owner[order], weight[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    for a, b in zip(start, np.r_[start[1:], len(flat)]):
        if b - a > 1:
            rows = owner[a:b]
            out[rows[:, None], rows[None, :]] += np.minimum.outer(weight[a:b], weight[a:b])
    return out


def best_places(cos: np.ndarray, k: int) -> np.ndarray:
    """Columns (rows, k) of the k largest rounded cosines of each row; of equal ones the smaller column."""
    n = cos.shape[1]
    wide = min(n, k + 8)
    some = np.argpartition(cos, n - wide, axis=1)[:, n - wide :] if wide < n else np.broadcast_to(np.arange(n), cos.shape)
    value = np.rint(np.take_along_axis(cos, some, axis=1) * 10**DECIMALS)
    order = np.lexsort((some, -value), axis=1)
    found = np.take_along_axis(some, order[:, :k], axis=1)
    if wide < n:  # where more than those are as good as the k-th, all columns are ranked
        value = np.take_along_axis(value, order, axis=1)
        for row in np.flatnonzero(value[:, -1] + 1 >= value[:, k - 1]):
            found[row] = np.lexsort((np.arange(n), -np.rint(cos[row] * 10**DECIMALS)))[:k]
    return found


def _meet(k: int):
    def run(table: pa.Table) -> pa.Table:
        reps, others, cosines = [], [], []
        table = table.sort_by("rep")
        pivot, block, vectors = table.column("pivot")[0].as_py(), table.column("block").to_numpy(), _long(table.column("vec"))
        prefix = table.column("prefix").combine_chunks()
        prefix = prefix.flatten().to_numpy().reshape(len(prefix), -1)
        every = np.arange(table.num_rows)
        low, high = every[block == block.min()], every[block == block.max()]
        own = block.min() == block.max()
        for rows, columns in [(every, every)] if own else [(low, high), (high, low)]:
            c = min(k, len(columns) - own)
            facing = vectors[columns].T.copy()
            for at in range(0, len(rows) if c else 0, 256):
                part = rows[at : at + 256]
                cos = vectors[part] @ facing
                if own:
                    cos[np.arange(len(part)), part] = -2
                found = best_places(cos, c)
                value = np.take_along_axis(cos, found, axis=1).ravel()
                asks, meets = np.repeat(part, c), columns[found.ravel()]
                # The first of the files that both are in.
                theirs = prefix[meets]
                shared = (prefix[asks][:, :, None] == np.where(theirs < 0, -2, theirs)[:, None, :]).any(axis=2)
                first = prefix[asks, shared.argmax(axis=1)] == pivot
                reps.append(asks[first])
                others.append(meets[first])
                cosines.append(np.rint(value[first] * 10**DECIMALS) / 10**DECIMALS)
        ids = table.column("rep").combine_chunks()
        if not reps:
            return pa.table({"rep": ids[:0], "other": ids[:0], "cos": pa.array([], pa.float64())})
        return pa.table({"rep": ids.take(pa.array(np.concatenate(reps))), "other": ids.take(pa.array(np.concatenate(others))), "cos": np.concatenate(cosines)})

    return run


def similar_vectors(reps: DataFrame, n: int, k: int, lists: int = LISTS, block: int = BLOCK) -> DataFrame:
    """The k most similar other vectors of each of n distinct vectors (rep string, vec binary): columns rep, other, cos."""
    spark = reps.sparkSession
    m = min(MOST_PIVOTS, n, max(2, n // PIVOT_EVERY))
    if n < 2:
        return spark.createDataFrame([], "rep string, other string, cos double")
    sample = hashed_sample(reps, "rep", m, n).select("vec").collect()
    pivots = spark.sparkContext.broadcast(Pivots(thinned(np.stack([np.frombuffer(bytes(r["vec"]), dtype=np.float32) for r in sample]))))
    posted = reps.mapInArrow(_permute(pivots, lists), "rep string, vec binary, prefix array<int>")
    posted = posted.select(F.explode("prefix").alias("pivot"), "rep", "vec", "prefix").where("pivot >= 0")
    # As many rows as there are pivots at most, so their size is bounded.
    size = posted.groupBy("pivot").count().select("pivot", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("many"))
    held = posted.join(F.broadcast(size), "pivot").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("many")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).select(
        "pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "vec", "prefix"
    )
    met = held.groupBy("pivot", "low", "high").applyInArrow(_meet(k), "rep string, other string, cos double")
    place = Window.partitionBy("rep").orderBy(F.desc("cos"), F.asc("other"))
    return met.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("place")


def neighbour_pairs(df: DataFrame, key: str, vector: str, dim: int, k: int = 5) -> DataFrame:
    """Pairs id_a < id_b (as strings) in which one is among the k most similar of the other, by cosine; of equal ones
    the smaller id first.

    An id is the text inside a possible byte-literal wrapper. Rows with a null id, or a vector that is null, of another
    length, or has null, NaN or infinite numbers or zeros only, don't take part; an id in several rows counts once
    (with one of its vectors, the same in every run, should they differ). Scale doesn't matter. Copies under other ids
    are each other's most similar. Further columns are ignored; fewer than two usable vectors give an empty result.
    """
    rows = df.where(df[key].isNotNull() & usable(df[vector], dim)).select(
        clean_id(df[key].cast("string")).alias("id"), df[vector].cast("array<double>").alias("v")
    )
    # Ids meet by the fingerprints of their vectors; the vectors themselves move once.
    members = written(rows.mapInArrow(_prints, "id string, print binary").groupBy("id").agg(F.min("print").alias("print")), "members")
    # Of the copies of one vector only the k + 1 smallest ids can ever be neighbours.
    first = Window.partitionBy("print").orderBy("id")
    few = members.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    sizes = members.groupBy("print").agg(F.count(F.lit(1)).alias("n"))
    held = few.groupBy("print").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")).join(sizes, "print")
    classes = written(held, "copies")
    vectors = rows.select("v").mapInArrow(_vectors, "print binary, vec binary").groupBy("print").agg(F.min("vec").alias("vec"))
    reps = written(vectors.join(classes.select("print", "rep"), "print").select("rep", "vec"), "vectors")
    near = similar_vectors(reps, classes.count(), k)
    ids = classes.select("rep", "ids")
    small = ids.where(F.size("ids") <= k)
    # near lies by rep already, so its own ids come first and the others' after the only shuffle by other.
    mine = near.join(small.select("rep", F.explode("ids").alias("own")), "rep").select("own", "other", "cos")
    outside = mine.join(ids.select(F.col("rep").alias("other"), "ids"), "other").select("own", F.explode(F.slice("ids", 1, k)).alias("id"), "cos")
    inside = small.where(F.size("ids") > 1).select(F.explode("ids").alias("own"), "ids").select("own", F.explode("ids").alias("id"), F.lit(1.0).alias("cos")).where("own <> id")
    ranked = outside.unionByName(inside)
    place = Window.partitionBy("own").orderBy(F.desc("cos"), F.asc("id"))
    close = ranked.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("own", "id")
    # Every copy in a large class has its k smallest others. A class may be of any size: there are no more than
    # rows / HUGE of the largest, which go to their members; the others meet theirs in a shuffle.
    large = classes.where(F.size("ids") > k).select("print", "ids", "n")
    huge = F.broadcast(large.where(F.col("n") > HUGE))
    rest = members.join(huge.select("print"), "print", "left_anti").join(large.where(F.col("n") <= HUGE), "print")
    copies = rest.unionByName(members.join(huge, "print")).select(
        F.col("id").alias("own"), F.explode(F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k)).alias("id")
    )
    pairs = close.unionByName(copies)
    return pairs.select(F.least("own", "id").alias("id_a"), F.greatest("own", "id").alias("id_b")).distinct()
