"""Reciprocal rank fusion of any number of runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators.sparse import DECIMALS

CONSTANT = 60


def fuse(runs: DataFrame, k: int = CONSTANT, depth: int | None = 1000, keep: int | None = 1000, by: tuple[str, ...] = (), tag: str = "rrf") -> DataFrame:
    """Fuse runs in one table: each document gets the sum of 1 / (k + rank) over the runs that list it to a depth.

    by: further columns that keep fusions apart, like the variant of the collection. Ties go by doc_id.
    """
    rows = runs if depth is None else runs.where(F.col("rank") <= depth)
    scored = rows.groupBy(*by, "qid", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))), DECIMALS + 3).alias("score"))
    place = Window.partitionBy(*by, "qid").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(place))
    return (ranked if keep is None else ranked.where(F.col("rank") <= keep)).select(*by, "qid", "doc_id", "rank", "score", F.lit(tag).alias("tag"))


def rrf(runs: list[DataFrame], k: int = CONSTANT, depth: int | None = 1000, keep: int | None = 1000, tag: str = "rrf") -> DataFrame:
    """The same of separate runs."""
    return fuse(reduce(DataFrame.unionByName, [r.select("qid", "doc_id", "rank") for r in runs]), k, depth, keep, tag=tag)


def fuse_lists(lists: DataFrame, k: int = CONSTANT, keep: int | None = 1000) -> DataFrame:
    """The same of one row a query, (qid, first, second), two lists of documents with the best first: (qid, doc_id, rank,
    score). No row is exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                part = whole.slice(at, 100)
                docs, ranks, scores, sizes = [], [], [], []
                for row in range(part.num_rows):
                    own = [x.values.to_numpy(zero_copy_only=False) for x in (part.column(1)[row], part.column(2)[row]) if x.is_valid and len(x)]
                    sizes.append(0)
                    if not own:
                        continue
                    doc, where = np.unique(np.concatenate(own), return_inverse=True)
                    score = np.round(np.bincount(where, np.concatenate([1.0 / (k + np.arange(1.0, len(x) + 1)) for x in own])), DECIMALS + 3)
                    order = np.argsort(-score, kind="stable")[:keep]
                    sizes[-1] = len(order)
                    docs.append(doc[order])
                    scores.append(score[order])
                    ranks.append(np.arange(1, len(order) + 1, dtype=np.int32))
                if docs:
                    qids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
                    columns = [qids, pa.array(np.concatenate(docs), part.schema.field(1).type.value_type), pa.array(np.concatenate(ranks)), pa.array(np.concatenate(scores))]
                    yield pa.RecordBatch.from_arrays(columns, ["qid", "doc_id", "rank", "score"])

    qid, doc = lists.schema["qid"].dataType.simpleString(), lists.schema["first"].dataType.elementType.simpleString()
    return lists.select("qid", "first", "second").mapInArrow(run, f"qid {qid}, doc_id {doc}, rank int, score double")
