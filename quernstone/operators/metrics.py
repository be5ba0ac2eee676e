"""Effectiveness of runs against judgements."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.session import written

KS = (10, 100, 1000)
DECIMALS = 9


def judgements(qrels: DataFrame, min_rel: int | None = 1) -> DataFrame:
    """(qid, doc_id, rel, relevant): min_rel None takes every judged document for relevant."""
    good = F.lit(True) if min_rel is None else F.coalesce(F.col("rel") >= min_rel, F.lit(False))
    return qrels.select("qid", "doc_id", F.coalesce("rel", F.lit(0)).alias("rel"), good.alias("relevant"))


def evaluate(run: DataFrame, qrels: DataFrame, ks: Sequence[int] = KS, min_rel: int | None = 1, ideal: str = "retrieved", by: tuple[str, ...] = ()) -> DataFrame:
    """Per query (and by): mrr@10, map, p@10 and, for each k, ndcg and recall, rounded to 9 decimals.

    Queries of the run without a judgement are left out, queries without a hit count 0. A document that a run lists
    twice counts at its best rank for recall and gain. Gains are linear; ideal 'retrieved' orders the gains found,
    'qrels' all judged ones. Negative judgements gain as they are.
    """
    keys = [*by, "qid"]
    known = judgements(qrels, min_rel)
    total = known.groupBy("qid").agg(F.sum(F.col("relevant").cast("long")).alias("n_rel"))
    hits = run.join(total.select("qid"), "qid", "left_semi").join(known, ["qid", "doc_id"], "left").select(
        *keys, "doc_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"), F.coalesce("relevant", F.lit(False)).alias("hit")
    )
    so_far = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    best = Window.partitionBy(*keys).orderBy(F.desc("rel"), "rank")
    hits = hits.withColumn("found", F.sum(F.col("hit").cast("long")).over(so_far)).withColumn("best", F.row_number().over(best))
    gain = lambda place: F.col("rel") / F.log2(F.col(place) + 1)
    sums = [
        F.coalesce(F.lit(1.0) / F.min(F.when(F.col("hit") & (F.col("rank") <= 10), F.col("rank"))), F.lit(0.0)).alias("mrr@10"),
        F.sum(F.when(F.col("hit"), F.col("found") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        (F.count(F.when(F.col("hit") & (F.col("rank") <= 10), 1)) / F.lit(10.0)).alias("p@10"),
    ]
    for k in ks:
        sums += [
            F.sum(F.when(F.col("rank") <= k, gain("rank")).otherwise(0.0)).alias(f"dcg@{k}"),
            F.sum(F.when(F.col("best") <= k, gain("best")).otherwise(0.0)).alias(f"idcg@{k}"),
            F.countDistinct(F.when(F.col("hit") & (F.col("rank") <= k), F.col("doc_id"))).alias(f"hits@{k}"),
        ]
    rows = hits.groupBy(*keys).agg(*sums).join(total, "qid")
    if ideal == "qrels":
        order = known.withColumn("best", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
        full = order.groupBy("qid").agg(*[F.sum(F.when(F.col("best") <= k, gain("best")).otherwise(0.0)).alias(f"full@{k}") for k in ks])
        rows = rows.join(full, "qid").withColumns({f"idcg@{k}": F.col(f"full@{k}") for k in ks})
    ratio = lambda a, b: F.round(F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b)), DECIMALS)
    out = [F.round("mrr@10", DECIMALS).alias("mrr@10"), ratio("ap_sum", "n_rel").alias("map"), "p@10"]
    for k in ks:
        out += [ratio(f"dcg@{k}", f"idcg@{k}").alias(f"ndcg@{k}"), ratio(f"hits@{k}", "n_rel").alias(f"recall@{k}")]
    return rows.select(*keys, *out)


def summarise(per_query: DataFrame, by: tuple[str, ...] = ("tag",)) -> DataFrame:
    """Means over the queries, and their number, of each method."""
    names = [c for c in per_query.columns if c not in {*by, "qid"}]
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("num_queries"), *[F.round(F.avg(f"`{c}`"), 6).alias(c) for c in names])


def compare(runs: DataFrame, qrels: DataFrame, **options) -> DataFrame:
    """A summary of every method (tag) in one table of runs, as method, num_queries and means."""
    return summarise(evaluate(runs, qrels, by=("tag",), **options)).withColumnRenamed("tag", "method")


def timed(search: Callable[[], DataFrame], n_queries: int) -> tuple[DataFrame, float]:
    """The run of a search, written, and its mean time in milliseconds a query. All queries are one job here, so there
    is no time of a single one."""
    began = time.monotonic()
    run = written(search(), "run")
    return run, 1000 * (time.monotonic() - began) / max(1, n_queries)


def relative_improvement(summary: DataFrame, metric: str, base: str, group: str, variant: str) -> DataFrame:
    """(group, variant, value, improvement): the change from a group's base variant, as a share; null without a base."""
    other = summary.where(F.col(variant) == base).select(group, F.col(f"`{metric}`").alias("base"))
    return summary.join(other, group, "left").select(
        group, variant, F.col(f"`{metric}`").alias("value"), F.round(F.when(F.col("base") != 0, (F.col(f"`{metric}`") - F.col("base")) / F.col("base")), 6).alias("improvement")
    )
