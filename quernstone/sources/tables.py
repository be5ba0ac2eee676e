"""Readers and writers: collections, queries, judgements, runs, vectors and reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernstone.functions.text import SPACE
from quernstone.session import shuffle_width

RUN = T.StructType(
    [T.StructField("qid", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("tag", T.StringType())]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over tasks if the scan has fewer splits than tasks can run at once, which bounds its size to as many
    splits; larger inputs stay as they are."""
    width = min(df.sparkSession.sparkContext.defaultParallelism, shuffle_width(df.sparkSession))
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def read_pairs(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Lines of key, tab and text (the rest of the line, tabs too); lines without both are skipped."""
    part = F.split("value", "\t", 2)
    lines = spark.read.text(path).select(part.alias("p")).where(F.size("p") == 2)
    return lines.select(F.col("p")[0].alias(key), F.col("p")[1].alias("text"))


def read_pairs_csv(spark: SparkSession, path: str, key: str = "doc_id", limit: int | None = None) -> DataFrame:
    """The quote-aware dialect: the first two of tab-separated fields."""
    rows = spark.read.csv(path, sep="\t", quote='"', escape='"', schema=f"{key} string, text string").where("text IS NOT NULL")
    return rows.limit(limit) if limit is not None else rows


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One id a line, without white space; blank lines are skipped."""
    return spark.read.text(path).select(F.regexp_replace("value", SPACE, "").alias(key)).where(F.col(key) != "").distinct()


def last_of_each(df: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    """Of several rows for a key the last by the given columns (of ties, the largest of the row's other columns)."""
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("row")
    return df.groupBy(*key).agg(newest).select(*key, *[F.col("row")[c].alias(c) for c in rest])


def read_queries(spark: SparkSession, *paths: str, limit: int | None = None) -> DataFrame:
    """The queries of several files, with their number of the file; missing files are skipped. limit: of each file."""
    out = spark.createDataFrame([], "qid string, text string, source int")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for n, path in enumerate(paths):
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).exists(where):
            rows = read_pairs(spark, path, "qid")
            out = out.unionByName((rows if limit is None else rows.limit(limit)).withColumn("source", F.lit(n)))
    return out


def read_qrels(spark: SparkSession, path: str, qids: DataFrame | None = None) -> DataFrame:
    """qid, doc_id and rel of lines of qid, iteration, document and judgement, between any white space."""
    part = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(part.alias("p")).where(F.size("p") >= 4)
    rows = lines.select(F.col("p")[0].alias("qid"), F.col("p")[2].alias("doc_id"), F.try_to_number(F.col("p")[3], F.lit("S9999")).cast("int").alias("rel"))
    return keep_keys(rows, qids, "qid")


def keep_keys(df: DataFrame, keys: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is among keys; no keys at all, or none given, filter nothing."""
    if keys is None or keys.isEmpty():
        return df
    return df.join(keys.select(key).distinct(), key, "left_semi")


def parse_run(lines: DataFrame, top: int | None = None, qids: DataFrame | None = None) -> DataFrame:
    """Rows of a run from lines (value) of six fields or more; at most rank top, of the qids given."""
    rows = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 6)
    rows = rows.select(
        F.col("p")[0].alias("qid"), F.col("p")[2].alias("doc_id"), F.expr("try_cast(p[3] AS int)").alias("rank"), F.expr("try_cast(p[4] AS double)").alias("score"), F.col("p")[5].alias("tag")
    )
    return keep_keys(rows if top is None else rows.where(F.col("rank") <= top), qids, "qid")


def read_run(spark: SparkSession, path: str, top: int | None = None, qids: DataFrame | None = None) -> DataFrame:
    return parse_run(spark.read.text(path), top, qids)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[c.to_pylist() for c in batch.columns])
        out = [f"{qid} Q0 {doc} {rank} {float('nan') if score is None else score:.6f} {tag}" for qid, doc, rank, score, tag in rows]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def run_lines(run: DataFrame) -> DataFrame:
    """A run as lines (value), with six decimals, sorted by qid as a number where it is one, then by rank.

    The decimals are those of the double itself, as C prints them; the JVM would round its shortest decimal form.
    """
    rows = run.orderBy(F.expr("try_cast(qid AS bigint)").asc_nulls_last(), "qid", "rank").select("qid", "doc_id", "rank", "score", "tag")
    return rows.mapInArrow(_lines, "value string")


def write_run(run: DataFrame, path: str) -> None:
    run_lines(run).write.mode("overwrite").text(path)


def write_pairs(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Lines of key, tab and text; line breaks and tabs in the text become spaces, as a line can't hold them."""
    flat = F.regexp_replace(F.col(text), r"[\t\r\n]+", " ")
    df.select(F.concat_ws("\t", F.col(key).cast("string"), flat).alias("value")).write.mode("overwrite").text(path)


def read_matrix(spark: SparkSession, path: str, dim: int, ids: str | None = None) -> DataFrame:
    """row (from 0) and embedding of a file of an int32 count and count x dim float32, little-endian; one file is one
    task, as its rows have no separators. ids: a file of one id a line, in the order of the rows, which adds doc_id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                n = int(np.frombuffer(content, dtype="<i4", count=1)[0])
                flat = np.frombuffer(content, dtype="<f4", offset=4, count=n * dim)
                for at in range(0, n, 10_000):
                    part = flat[at * dim : (at + 10_000) * dim]
                    m = len(part) // dim
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * dim), pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + m)), lists], ["row", "embedding"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                own = [x.strip() for x in content.decode("utf-8").splitlines()]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int64()), pa.array(own, pa.string())], ["row", "doc_id"])

    whole = spark.read.format("binaryFile")
    found = whole.load(path).select("content").mapInArrow(rows, "row long, embedding array<float>")
    return found if ids is None else whole.load(ids).select("content").mapInArrow(lines, "row long, doc_id string").join(found, "row")


def matrix_bytes(vectors: np.ndarray) -> bytes:
    """The same format, of a matrix."""
    return np.int32(len(vectors)).astype("<i4").tobytes() + np.ascontiguousarray(vectors, dtype="<f4").tobytes()


def clean_ids(df: DataFrame, column: str) -> DataFrame:
    """Ids without a byte-literal wrapper."""
    return df.withColumn(column, F.regexp_replace(column, "^b(['\"])(.*)\\1$", "$2"))


def write_results(summary: DataFrame, path: str) -> None:
    """One JSON object a method, in one file (a summary has one row a method)."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def report(summary: DataFrame, columns: Sequence[str] = ("ndcg@10", "recall@100", "mrr@10")) -> str:
    """A Markdown table of a summary with one row a method."""
    rows = summary.orderBy("method").select("method", *[f"`{c}`" for c in columns]).collect()
    lines = ["| method | " + " | ".join(columns) + " |", "|" + "---|" * (len(columns) + 1)]
    return "\n".join(lines + ["| " + r["method"] + " | " + " | ".join(f"{r[c]:.4f}" for c in columns) + " |" for r in rows])


def numbered(df: DataFrame, order: Sequence[str], within: Sequence[str], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def hashed_sample(df: DataFrame, key: str, want: int, total: int | None = None) -> DataFrame:
    """One row of each of the want keys of smallest hash. total: the number of rows, where every row has a key of its
    own; else the distinct keys are found first, and of several rows of a key the smallest counts, so a key that holds
    many rows counts once. Tasks send on no more than they need: keys far above the hash expected for the last one are
    dropped before the sort (six deviations more than are wanted are left)."""
    place = F.xxhash64(key)
    keys = df if total is not None else df.select(key).distinct()
    share = (want + 6 * want**0.5 + 100) / max(1, keys.count() if total is None else total)
    if share < 1:
        keys = keys.where(place < F.lit(int(-(2**63) + share * 2**64)))
    chosen = keys.orderBy(place, key).limit(want)
    if total is not None:
        return chosen
    least = F.min(F.struct(*[c for c in df.columns if c != key])).alias("row")
    return df.join(F.broadcast(chosen), key, "left_semi").groupBy(key).agg(least).select(key, "row.*")
