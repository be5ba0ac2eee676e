"""Problem 5: near-duplicate records, by fast similarity sketching, banding and exact verification.

Records with the same set of words form a class, and only one representative
of each class goes on. Its sketch has T coordinates. In round i every word is
thrown into one bin by the i-th hash, and a bin keeps the smallest hash of the
first round that reached it; the rounds end when every bin is full, after T at
most, and a bin that is empty then takes the smallest of all words. So every
coordinate is filled, two sketches agree in a coordinate with a probability of
the similarity, and the number of agreements is as concentrated as that of
independent coordinates, at a fraction of their cost.

Bands of coordinates give the candidates; those whose 128 sketch bits disagree
more than pairs at the threshold ever do are dropped in the join itself; the rest is verified on the words. Of rows coordinates a band and so many bands,
a pair at similarity s is missed with probability (1 - s^rows)^bands; both follow
from the threshold, so that a pair at the threshold is missed with MISSED at most
(at 0.75: 40 bands of 6; a pair at 0.8 with 6e-6).

Classes of many records are dealt in blocks wherever they are joined or paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.session import settle, written

#: How likely a pair at the threshold may be missed by the bands, and by the sketch bits; bands where two rows would do.
MISSED, BITS_MISSED, MOST_BANDS = 4e-4, 1.5e-5, 40
#: Sketch bits compared in the join.
BITS = 128
#: Members of a bucket that are paired in one piece; larger buckets are cut into blocks, paired block by block.
BLOCK = 2_000
#: Records sketched at once by a task.
AT_ONCE = 2_048


def bands_for(threshold: float) -> tuple[int, int]:
    """(rows, bands): the longest bands of which MOST_BANDS at most find a pair at the threshold, or single rows."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    t, rows = min(threshold, 0.98), 1
    needed = lambda r: math.ceil(math.log(MISSED) / math.log(1 - t**r))
    while needed(rows + 1) <= MOST_BANDS:
        rows += 1
    return rows, needed(rows)


def most_different(threshold: float) -> int:
    """Of BITS sketch bits (half of the coordinates that differ), as many as differ at the threshold but for BITS_MISSED."""
    p, tail, d = (1 - threshold) / 2, 1.0, -1
    while tail > BITS_MISSED:
        d += 1
        tail -= math.comb(BITS, d) * p**d * (1 - p) ** (BITS - d)
    return d


_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fast_sketch(words: np.ndarray, owner: np.ndarray, n: int, t: int) -> np.ndarray:
    """Sketches (n, t) of n sets: words are 64-bit hashes, owner the set of each. A set without words stays unfilled."""
    sketch = np.full(n * t, _NONE, dtype=np.uint64)
    seed = seeds(2 * t)
    w, o, width = words.astype(np.uint64, copy=False), owner.astype(np.int64), np.uint64(t)
    for i in range(t):
        if not len(w):
            break
        h = mix(w ^ seed[i])
        bins = ((h >> _32) * width >> _32).astype(np.int64)
        np.minimum.at(sketch, o * t + bins, (np.uint64(i) << _32) | (h & _LOW))
        if i % 2 or i < 4:
            left = (sketch.reshape(n, t) == _NONE).any(axis=1)
            more = left[o]
            w, o = w[more], o[more]
    if len(w):  # small sets: the second half of the rounds fills what is empty
        order = np.argsort(o, kind="stable")
        w, o = w[order], o[order]
        start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        own = sketch.reshape(n, t)[o[start]]
        for j in range(t):
            least = np.minimum.reduceat(mix(w ^ seed[t + j]) & _LOW, start)
            empty = own[:, j] == _NONE
            own[empty, j] = (np.uint64(t + j) << _32) | least[empty]
        sketch.reshape(n, t)[o[start]] = own
    return sketch.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key (n, bands) for each band of rows coordinates; the band is part of the key."""
    seed = seeds(bands + 7)[7:]
    key = np.broadcast_to(seed, (len(sketch), bands)).copy()
    part = sketch[:, : rows * bands].reshape(len(sketch), bands, rows)
    for r in range(rows):
        key = mix(key ^ part[:, :, r]) + np.uint64(r + 1)
    return key


def sketch_bits(sketch: np.ndarray) -> np.ndarray:
    """One bit of each of the first BITS coordinates, as (n, 2) words of 64 bits."""
    bit = (mix(sketch[:, :BITS]) & np.uint64(1)).reshape(len(sketch), 2, 64)
    return (bit << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def _sketcher(rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = max(rows * bands, BITS)
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                lists = batch.column(1)
                words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
                s = fast_sketch(words, np.repeat(np.arange(len(size)), size), len(size), t)
                keys, bits = band_keys(s, rows, bands), sketch_bits(s)
                offsets = pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(size, pa.int32()),
                        pa.array(bits[:, 0].view(np.int64)),
                        pa.array(bits[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["rep", "size", "bits_a", "bits_b", "keys"],
                )

    return run


def word_set(*texts: Column) -> Column:
    """The distinct lower-cased runs of letters and digits of texts (strings or arrays of strings), sorted."""
    joined = F.concat_ws(" ", *texts)  # skips nulls, also inside arrays
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(joined, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)))


def classes(df: DataFrame, key: str, words: Column, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members: rec, rep, part, parts; representatives: rep, words). Records with the same words have the smallest of
    their keys. A class of more than block records is dealt into parts; there are no more such classes than
    records / block, which bounds what is broadcast to find them."""
    rows = df.where(df[key].isNotNull()).select(df[key].alias("rec"), words.alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("print", F.unhex(F.md5(F.array_join("words", " "))))
    prints = written(rows.select("rec", "print").distinct(), "prints")
    sizes = prints.groupBy("print").agg(F.min("rec").alias("rep"), F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
    sizes = written(sizes, "classes")
    large = F.broadcast(sizes.where("parts > 1"))
    few = prints.join(large.select("print"), "print", "left_anti").join(sizes.where("parts = 1"), "print")
    members = few.unionByName(prints.join(large, "print")).select("rec", "rep", F.pmod(F.xxhash64("rec"), "parts").cast("int").alias("part"), "parts")
    least = rows.groupBy("print").agg(F.min_by("words", "rec").alias("words"))
    return members, written(least.join(sizes, "print").select("rep", "words"), "words")


def dealt_links(found: DataFrame, members: DataFrame) -> DataFrame:
    """ra and rb of the members of linked classes a and b, part by part of large classes."""
    large = members.where("parts > 1").select("rep", "parts").distinct()
    for side in "ab":
        known = F.broadcast(large.select(F.col("rep").alias(side), F.col("parts").alias(f"parts_{side}")))
        found = found.join(known, side, "left").withColumn(f"part_{side}", F.explode(F.sequence(F.lit(0), F.coalesce(f"parts_{side}", F.lit(1)) - 1)))
    for side in "ab":
        own = members.select(F.col("rec").alias(f"r{side}"), F.col("rep").alias(side), F.col("part").alias(f"part_{side}"))
        found = found.join(own, [side, f"part_{side}"])
    return found.select("ra", "rb")


def inside_classes(members: DataFrame) -> DataFrame:
    """ra < rb of the same class; every two parts of a large one meet on their own."""
    held = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "rec", "rep", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    )
    x, y = held.alias("x"), held.alias("y")
    same = (F.col("x.rep") == F.col("y.rep")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
    once = (F.col("x.low") == F.col("x.high")) | (F.col("x.part") != F.col("y.part"))
    return x.join(y, same & once & (F.col("x.rec") < F.col("y.rec"))).select(F.col("x.rec").alias("ra"), F.col("y.rec").alias("rb"))


def links(reps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs of representatives (a < b) with a similarity of at least the threshold; columns a, b, similarity."""
    rows, bands = bands_for(threshold)
    kind = reps.select("rep").schema[0].dataType.simpleString()
    hashed = reps.select("rep", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    sketched = hashed.mapInArrow(_sketcher(rows, bands), f"rep {kind}, size int, bits_a long, bits_b long, keys array<long>")
    band = settle(sketched).select(F.explode("keys").alias("key"), "rep", "size", "bits_a", "bits_b")
    # Only buckets of two or more give pairs. A large one is cut into blocks by hash, and every two blocks meet on their own.
    count = band.groupBy("key").count().where("count > 1")
    many = F.ceil(F.col("count") / F.lit(block)).cast("int")
    held = band.join(count, "key").withColumn("many", many).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("many")).cast("int"))
    held = held.select(
        "key", "rep", "size", "bits_a", "bits_b", "block", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other")
    ).select("key", "rep", "size", "bits_a", "bits_b", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    x, y = held.alias("x"), held.alias("y")
    differ = F.bit_count(F.col("x.bits_a").bitwiseXOR(F.col("y.bits_a"))) + F.bit_count(F.col("x.bits_b").bitwiseXOR(F.col("y.bits_b")))
    near = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.low") == F.col("y.low"))
        & (F.col("x.high") == F.col("y.high"))
        & (F.col("x.rep") < F.col("y.rep"))
        & ((F.col("x.low") == F.col("x.high")) | (F.col("x.block") != F.col("y.block")))
        & (F.least("x.size", "y.size") >= F.lit(threshold) * F.greatest("x.size", "y.size"))
        & (differ <= most_different(threshold))
    )
    pairs = x.join(y, near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    both = pairs.join(reps.select(F.col("rep").alias("a"), F.col("words").alias("wa")), "a").join(
        reps.select(F.col("rep").alias("b"), F.col("words").alias("wb")), "b"
    )
    shared = F.size(F.array_intersect("wa", "wb"))
    total = F.size("wa") + F.size("wb") - shared
    # shared / total >= threshold, in a form without rounding for thresholds like 3/4
    return both.where(shared >= F.lit(threshold) * total).select("a", "b", (shared / total).alias("similarity"))


def similar_pairs(df: DataFrame, key: str, words: Column, threshold: float = 0.75, block: int = BLOCK) -> DataFrame:
    """Pairs rec_a < rec_b of different keys whose word sets reach the threshold of shared by all words.

    Records without words and rows with a null key don't take part; rows repeated for a key count once (a key with
    several texts is in a pair if any of them is); exact copies of any number are found as one class and written out
    as pairs only at the end; further columns are ignored; an empty table gives an empty result.
    """
    members, reps = classes(df, key, words, block)
    across = dealt_links(links(reps, threshold, block).select("a", "b"), members).where("ra <> rb")
    across = across.select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"))
    return across.unionByName(inside_classes(members)).distinct().toDF("rec_a", "rec_b")


def components(found: DataFrame, nodes: DataFrame, rounds: int = 30) -> DataFrame:
    """rep and group (smallest rep it is linked to, over any number of links), by halving pointers until nothing moves."""
    edges = settle(found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = settle(nodes.select("rep", F.col("rep").alias("group")))
    for _ in range(rounds):
        # the least label among the neighbours, then that label's own label
        near = edges.join(label.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.min("group").alias("near"))
        step = label.join(near.withColumnRenamed("a", "rep"), "rep", "left").select("rep", F.col("group").alias("old"), F.least("group", "near").alias("group"))
        up = step.select(F.col("rep").alias("group"), F.col("group").alias("up"))
        new = settle(step.join(up, "group", "left").select("rep", "old", F.least("group", "up").alias("group")))
        label = new.select("rep", "group")
        if new.where("group <> old").isEmpty():
            return label
    raise RuntimeError("components didn't settle; give more rounds")


def grouped(df: DataFrame, key: str, words: Column, threshold: float = 0.75, block: int = BLOCK) -> DataFrame:
    """One row for each key with words: rec_id's key, class_id (smallest key with the same words), group_id (smallest
    class it is linked to, over any number of links) and n_links (its links to other classes)."""
    members, reps = classes(df, key, words, block)
    found = settle(links(reps, threshold, block))
    ends = found.select(F.col("a").alias("rep")).unionByName(found.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    label = components(found, degree.select("rep"))
    known = degree.join(label, "rep")
    parts = members.where("parts > 1").select("rep").distinct()
    columns = [F.col("rec").alias(key), F.col("rep").alias("class_id"), F.coalesce("group", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    # Large classes, which are few, go to their members.
    large = members.where("parts > 1").join(F.broadcast(known.join(F.broadcast(parts), "rep", "left_semi")), "rep", "left")
    return members.where("parts = 1").join(known, "rep", "left").select(*columns).unionByName(large.select(*columns))
