"""Expansion that goes on where it stopped: new files of a folder, each batch once, into one Parquet table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.operators.expand import not_yet_done


def expand_new(spark: SparkSession, source: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], schema: str = "doc_id long, text string"):
    """A query that reads new files of source, drops documents already in target, and appends transform(the rest).

    A batch that is repeated after a failure finds its own rows in the target, so nothing is written twice as long as
    batches don't run side by side (they don't). Stops when the files at hand are done.
    """

    def write(batch: DataFrame, _: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        rows = batch.dropDuplicates(["doc_id"])
        transform(not_yet_done(rows, spark.read.parquet(target)) if there else rows).write.mode("append").parquet(target)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
