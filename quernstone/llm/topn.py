"""Problem 1: the N best items of every group, by partition lower bounds.

Every partition of the scan finds, without a shuffle, its own N best items of
each group and writes them once to the shared folder. Its N-th best item is a
lower bound of the group's true N-th best, whichever partition it comes from.
The largest bound of each group is joined to these survivors where they lie, as
a broadcast while its measured size allows, which drops nearly all of a large
group before anything is shuffled; the rest is ranked once.

A bound is a score with an item, in the order of the ranking, so even a group
of equal scores is cut down to N rows a partition before the join and to N of
all that matter after it. A group with a third of all rows sends hardly more
than N rows over the network.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.session import written

#: Rows a task gathers before it prunes them to the best N of each group.
PRUNE_ROWS = 1_000_000
#: Bytes of bounds that go to every task; more are joined by a shuffle on the groups, which the ranking uses again.
BROADCAST_BYTES = 32_000_000


def _order(column: pa.ChunkedArray) -> np.ndarray:
    """Codes of the strings of a column, in the order of the strings by code point."""
    coded = column.combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    rank = np.empty(len(coded.dictionary), dtype=np.int64)
    rank[pa.compute.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    return rank[coded.indices.to_numpy()]


def _prune(table: pa.Table, n: int, groups: int) -> pa.Table:
    """The best n distinct items of each group of a table, and at the n-th best of its group here a mark."""
    keys = [_order(table.column(i)) for i in range(groups)]
    item, score = _order(table.column(groups)), table.column(groups + 1).to_numpy()
    group = np.zeros(len(item), dtype=np.int64)
    for key in keys:
        _, group = np.unique(group * (int(key.max()) + 1) + key, return_inverse=True)
    by = np.lexsort((-score, item, group))  # the best row of each item stands first
    g, i = group[by], item[by]
    first = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]
    by = by[first]
    by = by[np.lexsort((item[by], -score[by], group[by]))]
    g = group[by]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    keep = place < n
    kept = table.take(pa.array(by[keep]))
    return kept.select(range(groups + 2)).append_column("is_bound", pa.array(place[keep] == n - 1))


def _survivors(n: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, floor = [], 0, PRUNE_ROWS
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= floor:
                held = [_prune(pa.concat_tables(held), n, groups).select(range(groups + 2))]
                rows = held[0].num_rows
                floor = max(PRUNE_ROWS, 2 * rows)  # many small groups can't be pruned further
        if rows:
            yield from _prune(pa.concat_tables(held), n, groups).to_batches(max_chunksize=50_000)

    return run


def top_n_per_group(df: DataFrame, keys: Sequence[str], item: str, score: str, n: int) -> DataFrame:
    """The n items of highest score of each group of keys; columns: keys, item, score, rank (from 1).

    An item counts once per group, with its highest score; of equal scores the item smaller as a string by code
    point goes first. Rows with a null item, or a null or NaN score, don't take part. Null is a key like any other
    (drop such rows before, if they shouldn't count); -0.0 equals 0.0. Groups with fewer items give all they have;
    an empty table gives an empty result; repeated rows change nothing; further columns of df are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [f"g{i}" for i in range(len(keys))]
    # A key travels as text behind a mark, so that null differs from every value and joins to itself.
    marked = [F.coalesce(F.concat(F.lit("="), df[k].cast("string")), F.lit("")).alias(g) for k, g in zip(keys, names)]
    rows = df.where(df[item].isNotNull() & df[score].isNotNull() & ~F.isnan(df[score].cast("double"))).select(
        *marked, df[item].cast("string").alias("item"), (df[score].cast("double") + F.lit(0.0)).alias("score")
    )
    schema = ", ".join([*(f"{g} string" for g in names), "item string, score double, is_bound boolean"])
    local = written(rows.mapInArrow(_survivors(n, len(names)), schema), "survivors")
    # Of equal bounds the smaller item is the tighter one.
    tightest = F.min(F.struct((-F.col("score")).alias("score"), "item"))
    bounds = written(local.where("is_bound").groupBy(*names).agg(tightest.alias("bound")), "bounds")
    width = sum((F.octet_length(g) for g in [*names, "bound.item"]), F.lit(64))
    small = (bounds.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES
    joined = local.drop("is_bound").join(F.broadcast(bounds) if small else bounds, names, "left")
    ahead = -F.col("score")
    left = joined.where(
        F.col("bound").isNull() | (ahead < F.col("bound.score")) | ((ahead == F.col("bound.score")) & (F.col("item") <= F.col("bound.item")))
    ).drop("bound")
    # One exchange by group serves the last deduplication and the ranking.
    best = left.repartition(*names).groupBy(*names, "item").agg(F.max("score").alias("score"))
    place = Window.partitionBy(*names).orderBy(F.desc("score"), F.asc("item"))
    ranked = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)
    types = dict(df.dtypes)
    back = [F.when(F.col(g) == "", None).otherwise(F.expr(f"substring({g}, 2)")).cast(types[k]).alias(k) for k, g in zip(keys, names)]
    return ranked.select(*back, F.col("item").cast(types[item]).alias(item), F.col("score").alias(score), "rank")
