"""Exact search over vectors, and reranking by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.sparse import DECIMALS, top_k
from quernstone.session import written
from quernstone.sources.tables import hashed_sample

#: Numbers of a block of query vectors that goes to every task (64 MB), and of results a task holds for it (64 MB of
#: ids and scores); more queries are searched block by block.
BLOCK_NUMBERS, BLOCK_RESULTS = 16_000_000, 4_000_000
#: Scores of queries by vectors that are worked out at once (32 MB).
AT_ONCE = 4_000_000


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def unit(vector: str) -> Column:
    """The vector at length one; of zeros only, as it is."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def cosine(a: str, b: str) -> Column:
    return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), DECIMALS)


def _k_best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by score, then id."""
    n = score.shape[1]
    if n <= k:
        return ids, score
    least = np.partition(score, n - k, axis=1)[:, n - k, None]
    good = score >= least
    many = good.sum(axis=1)
    keep = np.empty((len(score), k), dtype=np.int64)
    plain = many == k
    keep[plain] = np.nonzero(good[plain])[1].reshape(-1, k)
    for row in np.flatnonzero(~plain):  # ties at the last place
        some = np.flatnonzero(good[row])
        keep[row] = some[np.lexsort((ids[row, some], -score[row, some]))[:k]]
    return np.take_along_axis(ids, keep, 1), np.take_along_axis(score, keep, 1)


def _local_best(shared, k: int, metric: str, at_once: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        held_ids, held = np.zeros((len(qids), 0), dtype=np.int64), np.zeros((len(qids), 0))
        step = max(1, (at_once or AT_ONCE) // max(1, len(qids)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = np.array(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                if metric == "cosine":
                    length = np.linalg.norm(x, axis=1, keepdims=True)
                    score = np.round(q @ np.divide(x, length, out=x, where=length > 0).T, DECIMALS)
                else:
                    score = -np.round(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T), 0), DECIMALS)
                ids = np.concatenate([held_ids, np.broadcast_to(np.asarray(batch.column(0)), score.shape)], axis=1)
                held_ids, held = _k_best(ids, np.concatenate([held, score], axis=1), k)
        for at in range(0, len(qids), 1_000):
            part = held[at : at + 1_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids[at : at + 1_000], part.shape[1])), pa.array(held_ids[at : at + 1_000].ravel()), pa.array(np.abs(part.ravel()) if metric == "l2" else part.ravel())],
                ["qid", "doc_id", "score"],
            )

    return run


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", tag: str = "dense") -> DataFrame:
    """The k nearest vectors (doc_id long, embedding) of every query vector (qid long, embedding), exactly.

    Each task multiplies its vectors with a block of the queries and keeps the k best of each query, so at most k rows
    a query and task are shuffled. A block of queries is bounded (BLOCK_NUMBERS, BLOCK_RESULTS), and so is what is worked
    out of it at once (AT_ONCE); more queries are read block by block from their own scan. cosine: higher is better; l2: squared distance, lower is better. Ties go by doc_id.
    """
    spark = queries.sparkSession
    first = queries.select(F.size("embedding")).first()
    if first is None:
        return top_k(spark.createDataFrame([], "qid long, doc_id long, score double"), k, tag)
    step = max(1, min(BLOCK_NUMBERS // max(1, first[0]), BLOCK_RESULTS // k))
    blocks = max(1, -(-queries.count() // step))
    found = None
    for n in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n)
        rows = part.orderBy("qid").select("qid", "embedding").collect()
        if not rows:
            continue
        q = np.array([r["embedding"] for r in rows], dtype=np.float64)
        if metric == "cosine":
            length = np.linalg.norm(q, axis=1, keepdims=True)
            q = np.divide(q, length, out=q, where=length > 0)
        shared = spark.sparkContext.broadcast((np.array([r["qid"] for r in rows], dtype=np.int64), q))
        best = vectors.select("doc_id", "embedding").mapInArrow(_local_best(shared, k, metric), "qid long, doc_id long, score double")
        found = best if found is None else found.unionByName(best)
    order = [F.desc("score") if metric == "cosine" else F.asc("score"), F.asc("doc_id")]
    return top_k(found, k, tag, order)


def similarity_matrix(vectors: DataFrame, group: str) -> DataFrame:
    """Cosines of all pairs i < j of the vectors of a group of bounded size (the expansions of one document)."""
    x, y = vectors.alias("x"), vectors.alias("y")
    same = (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col("x.vec_id") < F.col("y.vec_id"))
    return x.join(y, same).select(F.col(f"x.{group}").alias(group), F.col("x.vec_id").alias("i"), F.col("y.vec_id").alias("j"), cosine("x.embedding", "y.embedding").alias("sim"))


def rerank(candidates: DataFrame, passages: DataFrame, queries: DataFrame, depth: int = 1000, tag: str = "rerank") -> DataFrame:
    """A run's candidates up to a rank, ordered by the cosine of their vectors; those without a vector drop out."""
    pairs = candidates.where(F.col("rank") <= depth).select("qid", "doc_id").join(queries.select("qid", F.col("embedding").alias("q")), "qid").join(
        passages.select("doc_id", F.col("embedding").alias("p")), "doc_id"
    )
    return top_k(pairs.select("qid", "doc_id", cosine("q", "p").alias("score")), None, tag)


def _nearest(shared, probes: int):
    """The lists of the probes nearest centroids of each vector, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        d = min(probes, len(centroids))
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, AT_ONCE // len(centroids))):
                batch = whole.slice(at, max(1, AT_ONCE // len(centroids)))
                x = np.array(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                near = x @ centroids.T
                found = np.argpartition(-near, d - 1, axis=1)[:, :d]
                rows = pa.array(np.repeat(np.arange(len(x)), d))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.ravel().astype(np.int32))], ["id", "embedding", "list"])

    return run


def write_lists(vectors: DataFrame, folder: str, every: int = 50, most: int = 65_536) -> None:
    """An inverted file of vectors (doc_id long, embedding): each in the list of its nearest centroid, sorted by list, and
    the centroids beside them. The centroids are a sample by hash of one of so many vectors, most at most; every vector
    is indexed. Vectors of zeros only have no direction and are left out."""
    spark = vectors.sparkSession
    known = vectors.where(F.exists("embedding", lambda x: x != 0)).select("doc_id", unit("embedding").alias("embedding"))
    n = known.count()
    sample = hashed_sample(known, "doc_id", min(most, max(1, n // every)), n)
    centroids = written(sample.select("embedding"), "centroids")
    centroids.write.mode("overwrite").parquet(f"{folder}/centroids")
    schema = "id long, embedding array<double>, list int"
    listed = known.mapInArrow(_nearest(_shared_centroids(spark, folder), 1), schema) if n else spark.createDataFrame([], schema)
    listed.withColumnRenamed("id", "doc_id").repartitionByRange("list", "doc_id").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{folder}/lists")


def _shared_centroids(spark: SparkSession, folder: str):
    rows = spark.read.parquet(f"{folder}/centroids").collect()
    return spark.sparkContext.broadcast(np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 1))


def approximate_search(queries: DataFrame, folder: str, k: int, probes: int = 32, tag: str = "ann") -> DataFrame:
    """The k most similar vectors of a written inverted file, for query vectors (qid long, embedding), by cosine, among
    the lists of the probes nearest centroids. Only lists that are probed leave the scan, and a list meets its queries
    by a join on the list, so no task holds more than the rows it ranks. Ties go by doc_id."""
    spark = queries.sparkSession
    shared = _shared_centroids(spark, folder)
    if not len(shared.value):
        return top_k(spark.createDataFrame([], "qid long, doc_id long, score double"), k, tag)
    asked = queries.where(F.exists("embedding", lambda x: x != 0)).select("qid", unit("embedding").alias("embedding"))
    probed = asked.mapInArrow(_nearest(shared, probes), "id long, embedding array<double>, list int").select(F.col("id").alias("qid"), F.col("embedding").alias("q"), "list")
    lists = spark.read.parquet(f"{folder}/lists").join(probed.select("list").distinct(), "list", "left_semi")
    scored = lists.join(probed, "list").select("qid", "doc_id", F.round(dot("q", "embedding"), DECIMALS).alias("score"))
    return top_k(scored, k, tag)
