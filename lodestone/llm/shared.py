"""What the operators share: tables in the cluster's shared folder, and column-name guards."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and every executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    scope = _made.get()
    if scope is not None:
        scope.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table that written() made once nothing lazy reads it any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        _delete(df.sparkSession, path)


#: Paths of the tables that written() has made inside the innermost written_alone() of this thread, in order; None outside of any.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written_alone(spark: SparkSession, make, label: str) -> DataFrame:
    """make() written as a table, then the tables deleted that make() had written on the way: nothing lazy reads them any more.

    Only what make() itself has written goes, not what other threads or earlier calls have.
    """
    own: list[str] = []
    outer = _made.set(own)
    try:
        made = make()
    finally:
        _made.reset(outer)
    out = written(made, label)
    for path in own:
        _delete(spark, path)
    return out


def free(name: str, df: DataFrame) -> str:
    """name, with underscores after it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(col: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


#: Rows of an Arrow batch at most: whole texts are long, so the default of 10,000 rows would set a task's memory.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session hands Python at most BATCH_ROWS rows at a time. Results do not depend on it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df
