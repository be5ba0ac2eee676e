"""Session settings and the durable folder that long plans write to."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "quernstone", **conf: str) -> SparkSession:
    """A session with this engine's defaults; settings given here or on submit win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (tests, a single machine) one of our
    own, with a warning on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local"):
            warnings.warn("spark.checkpoint.dir is not set: a folder of this machine is used, which executors elsewhere can't see", stacklevel=2)
        folder = known if known else "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder with checkpoint(), so a lost executor loses nothing."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(durable_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a Parquet table below the shared folder and read them back (columnar, so later reads prune)."""
    spark = df.sparkSession
    path = f"{durable_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session has."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def scratch_path(folder: str) -> str | None:
    """A path for files that a task drops again, below the shared folder; None if the folder is no file path."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return folder if os.path.isabs(folder) else None
