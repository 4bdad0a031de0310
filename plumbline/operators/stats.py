"""What column statistics hold: counts, densities of leading columns, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def single(df: DataFrame, column: str, where: str | None = None, sample: tuple[str, int] | None = None) -> DataFrame:
    """(n_rows, n_distinct, n_nulls, low, high) of a column, of rows that match, or of the
    rows whose (key, percent) falls into a repeatable sample; percent 0 takes all."""
    rows = df.where(where) if where else df
    if sample and sample[1]:
        rows = rows.where(F.pmod(F.col(sample[0]), F.lit(100)) < sample[1])
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct(column).alias("n_distinct"), F.count_if(F.col(column).isNull()).alias("n_nulls"), F.min(column).alias("low"), F.max(column).alias("high"))


def multi(df: DataFrame, columns: list[str]) -> DataFrame:
    """(prefix, n_distinct): distinct values of each leading part of a column list, from
    one pass over grouping sets; the density is 1 / n_distinct."""
    prefixes = [columns[: i + 1] for i in range(len(columns))]
    groups = df.groupingSets(prefixes, *columns).agg(F.grouping_id().alias("g"))
    # the grouping id of a prefix has ones for the columns left out behind it
    level: Column = F.lit(len(columns)) - F.length(F.regexp_replace(F.bin("g"), "0", ""))
    return groups.groupBy(level.cast("int").alias("prefix")).agg(F.count("*").alias("n_distinct"))


def histogram(df: DataFrame, column: str, work: str, steps: int = 10) -> DataFrame:
    """(step, high, n_below, n_equal): the values up to which the first, second, ... part of
    the rows lies, exactly, with the rows below each and equal to it; nulls do not count.

    Values are counted first, so that a common one is a single row, and written in ranges.
    The ranges' sums tell which ranges hold a bound; only those are summed up value by
    value, each in a task of its own. A step whose bound is that of the step before, as a
    value has several parts' rows, is left out."""
    spark = df.sparkSession
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("high")).agg(F.count("*").alias("n_equal"))
    counts.repartitionByRange("high").withColumn("part", F.spark_partition_id()).write.parquet(work)
    counts = spark.read.parquet(work)
    # one row per range from here on
    sums = counts.groupBy("part").agg(F.sum("n_equal").alias("n"), F.min("high").alias("low"))
    before = sums.select("part", "n", (F.sum("n").over(Window.orderBy("low")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    wanted = before.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).withColumn("at", F.ceil(F.col("total") * F.col("step") / F.lit(steps)))
    wanted = wanted.where("at > before and at <= before + n").select("part", "before", "step", "at")
    inside = counts.join(F.broadcast(wanted.select("part", "before").distinct()), "part")
    summed = inside.select("part", "high", "n_equal", (F.col("before") + F.sum("n_equal").over(Window.partitionBy("part").orderBy("high"))).alias("upto"))
    hit = summed.join(F.broadcast(wanted.select("part", "step", "at")), "part").where("at <= upto and at > upto - n_equal")
    return hit.groupBy("high", "n_equal", "upto").agg(F.min("step").alias("step")).select("step", "high", (F.col("upto") - F.col("n_equal")).alias("n_below"), "n_equal")
