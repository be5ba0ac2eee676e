"""Problem 7: filling containers of fixed capacity, by first-fit decreasing over a tournament tree.

The documents are dealt at random, by the hash of their key, into independent
groups of about GROUP_ITEMS, so each group is one bounded task and all groups
run in parallel. In a group the items go, largest first, into the first
container that still has room; a tournament tree over the containers' free room
finds it in log time. What a group wastes beyond the whole is at most part of
its last containers, which is nothing among thousands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import settle

GROUP_ITEMS = 20_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, by first-fit in the given order; no size may exceed the capacity."""
    n = len(sizes)
    leaves = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * leaves)  # every node holds the most room of the containers below it
    out = np.empty(n, dtype=np.int64)
    for k, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out[k] = node - leaves
        tree[node] -= size
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left > right else right
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return out


def pack(df: DataFrame, key: str, size: str, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Containers of items: columns key, piece_no, start, n_tokens, container.

    An item larger than the capacity, and only such a one, is split: into pieces of the capacity and a remainder, all
    placed like items (start: the piece's place in the item, piece_no from 0). Rows with a null key or a null or
    non-positive size are no items. Ties of size go by key, piece and row; a key that stands in several rows is several
    items, dealt like others. container is 'group-number', unique over all groups. Further columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = df.select(key).schema[0].dataType.simpleString()
    items = df.where(df[key].isNotNull() & (df[size] > 0)).select(df[key].alias("id"), df[size].cast("long").alias("size"))
    # Sizes may be dear to compute, and are read twice; rows of one key are told apart by their place in what is written.
    items = settle(items).withColumn("row", F.monotonically_increasing_id())
    groups = max(1, -(-items.count() // group_items))
    # Pieces go out before the groups are dealt: a giant item doesn't make its group larger.
    pieces = items.select(
        "id", "row", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {int(capacity)}"))).alias("piece_no", "nth")
    ).select("id", "row", "piece_no", (F.col("nth") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("nth") * capacity).alias("n_tokens"))
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("id", "piece_no", "row"), F.lit(groups)))

    def fill(lot: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "id", "piece_no", "row"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        own = first_fit_decreasing(rows["n_tokens"].to_numpy(), capacity)
        return rows[["id", "piece_no", "start", "n_tokens"]].assign(container=[f"{lot[0]}-{x}" for x in own])

    out = dealt.groupBy("lot").applyInPandas(fill, f"id {kind}, piece_no int, start long, n_tokens long, container string")
    return out.toDF(key, "piece_no", "start", "n_tokens", "container")
