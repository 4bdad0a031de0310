"""Files and folders in whatever store Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete files or folders with all they hold; what is missing is passed over."""
    for x in paths:
        fs, p = _file_system(spark, x)
        fs.delete(p, True)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Folders right under path whose write has ended, by the mark that Spark leaves."""
    fs, p = _file_system(spark, path)
    found = [x.getPath() for x in fs.listStatus(p) if x.isDirectory()] if fs.exists(p) else []
    return sorted(x.toString() for x in found if exists(spark, f"{x.toString()}/_SUCCESS"))


def listed(df: DataFrame) -> list[str]:
    """The files that hold rows of a frame read from files, by their rows."""
    return [r[0] for r in df.select(F.col("_metadata.file_path")).distinct().collect()]


def work_dir(spark: SparkSession) -> str:
    """A new folder in the place that all executors share (spark.checkpoint.dir). A
    temporary one is set only where a local session names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/plumbline/{uuid.uuid4().hex}"
