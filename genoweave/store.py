"""Tables in the folder that the driver and all executors share: where lineage is cut and a result is used more than once."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset, which only a local master may have."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="genoweave-"))
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this call's own in the shared one; it goes when the driver's Python ends, or by drop_folder."""
    path = f"{shared_dir(spark)}/genoweave-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        drop_folder(spark, path)
    except Exception:  # the session may have ended before
        return


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there, and a lost executor costs nothing before it."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def drop(df: DataFrame) -> None:
    """Removes the table that written() returned, once nothing reads it any more."""
    drop_folder(df.sparkSession, df._folder)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more.

    The scheduler holds the last job's plan until another job has run, so a job of one row runs first.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
