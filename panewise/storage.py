"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; for a local master without it a temporary folder, which is then set."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="panewise-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/panewise-{os.getpid()}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of new_path(); also when the session has ended already."""
    if path.startswith("file:/"):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone at exit; a leftover in the scratch folder is harmless
        return


def _file(spark: SparkSession, path: str):
    """(Hadoop's file system, path) of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file(spark, path)
    return fs.exists(target)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, with its folders; it may be there already."""
    fs, target = _file(spark, path)
    fs.create(target, True).close()


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A folder with all that is in it; the target must not be there."""
    (fs, a), (other, b) = _file(spark, source), _file(spark, target)
    other.mkdirs(b.getParent())
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: lineage ends here, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has been counted to hold at most so many rows, else as it is: Spark then shuffles and splits skewed keys.

    df should be a written table or cheap, as it is counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
