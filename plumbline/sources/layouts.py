"""Sorted copies of tables that are written once and looked up by range or value.

A layout is a folder of Parquet files in ranges of its order, sorted inside, with bloom
filters on columns that are looked up by value, and a table of zones: per file the lowest
and highest value of the first column. A lookup reads the zones first, opens only files
whose zone meets it, and leaves the rest to the files' own statistics and filters; it
shuffles nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import CODECS, names_of, ordered

#: Rows of a group that a file can be read by: small, as lookups want few rows.
ROW_GROUP_BYTES = 4 << 20


def store(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None, where: str | None = None, by_value: list[str] = (), files: int | None = None, compression: str = "PAGE") -> None:
    """Write the columns (all, if none are named) of rows that match as a layout. order is a
    list of `name` or `name DESC`; by_value names columns that get a bloom filter."""
    names = names_of(order)
    rows = df.where(where) if where else df
    rows = rows.select(*names, *[c for c in (columns if columns is not None else df.columns) if c not in names])
    ranges = rows.repartitionByRange(files, *ordered(order)) if files else rows.repartitionByRange(*ordered(order))
    out = ranges.sortWithinPartitions(*ordered(order)).write.option("compression", CODECS[compression.upper()]).option("parquet.block.size", ROW_GROUP_BYTES)
    for c in by_value:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(f"{path}/rows")
    spark = df.sparkSession
    zones = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(names[0]).alias("low"), F.max(names[0]).alias("high"), F.count_if(F.col(names[0]).isNull()).alias("n_nulls"), F.count("*").alias("n_rows"))
    zones.coalesce(1).write.parquet(f"{path}/zones")


def files_of(spark: SparkSession, path: str, low, high) -> list[str]:
    """The files whose zone meets a range, both ends included; None leaves an end open."""
    zones = spark.read.parquet(f"{path}/zones")
    meets = F.col("low").isNotNull()
    if low is not None:
        meets &= F.col("high") >= F.lit(low)
    if high is not None:
        meets &= F.col("low") <= F.lit(high)
    return [r["file"] for r in zones.where(meets).select("file").collect()]


def lookup(spark: SparkSession, path: str, column: str, low=None, high=None, and_: Column | None = None) -> DataFrame:
    """Rows whose first column of the order lies in a range (None leaves an end open), and
    for which a further condition holds. Only files of the zones that it meets are read."""
    schema = spark.read.parquet(f"{path}/rows").schema
    if schema.names[0] != column:
        raise ValueError(f"the layout is ordered by {schema.names[0]}")
    found = files_of(spark, path, low, high)
    if not found:
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema).parquet(*found)
    if low is not None:
        out = out.where(F.col(column) >= F.lit(low))
    if high is not None:
        out = out.where(F.col(column) <= F.lit(high))
    return out if and_ is None else out.where(and_)
