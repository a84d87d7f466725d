"""Session builder and table loader."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(name: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on: UTC, AQE with skew joins and coalescing."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; columns are pruned by the scan, so callers select what they need."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialised(df: DataFrame, label: str) -> DataFrame:
    """df written once to the folder in spark.checkpoint.dir and read back: later steps start from files that all executors share.

    Where the setting is missing and all runs in one process (tests), a temporary folder is set; on a cluster it must be there.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialised() made once nothing lazy reads it any more; other tables are left alone."""
    if path := getattr(df, "_lodestone_path", None):
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
