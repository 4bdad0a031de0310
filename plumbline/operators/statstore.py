"""Column statistics that are kept and merged instead of counted anew.

A store is a folder of numbered batches. A batch holds one row per partition of the table
that it counted: the rows, and for each column its nulls, least and greatest value, a
sketch of its values and a sketch of the leading part of the column list that ends with
it. Sketches of the same size merge without loss, so partitions add up to the table.

Two things make a batch: `refresh` counts whole partitions and supersedes what earlier
batches say of them, `absorb` counts rows that were appended. Both write under their own
number, so one that fails can be repeated, and a batch is read only once its write has
finished. `fold` makes one batch of all. A row of a store is a few sketches of 2**bits
bytes, whatever the partition holds.

Distinct values come from HyperLogLog with a relative standard error of 1.04 / 2**(bits/2),
1.6 % at 12 bits; `stats` has the exact forms. For statistics of some rows or of a sample,
pass a frame of just those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.paths import delete, finished
from .merge import in_partitions

BITS = 12


def error(bits: int = BITS) -> float:
    """The relative standard error of distinct counts."""
    return 1.04 / 2 ** (bits / 2)


def _hash(columns: list[str]) -> Column:
    """64 bits of some columns' values, in which nulls count by their place."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def states(df: DataFrame, by: list[str], columns: list[str], bits: int = BITS) -> DataFrame:
    """(part, n_rows, s0, s1, ...): one row per partition, in one pass with partial sums."""
    def of(i: int) -> Column:
        c, prefix = F.col(columns[i]), columns[: i + 1]
        return F.struct(F.count_if(c.isNull()).alias("n_nulls"), F.min(c).alias("low"), F.max(c).alias("high"), F.hll_sketch_agg(F.when(c.isNotNull(), _hash([columns[i]])), F.lit(bits)).alias("values"), F.hll_sketch_agg(_hash(prefix), F.lit(bits)).alias("prefix")).alias(f"s{i}")

    return df.groupBy(F.struct(*by).alias("part")).agg(F.count("*").alias("n_rows"), *[of(i) for i in range(len(columns))])


def merged(df: DataFrame, by: list[str]) -> DataFrame:
    """States of equal `by` as one; those without rows have no sketches."""
    def of(s: str) -> Column:
        both = F.struct(F.sum(f"{s}.n_nulls").alias("n_nulls"), F.min(f"{s}.low").alias("low"), F.max(f"{s}.high").alias("high"), F.hll_union_agg(f"{s}.values").alias("values"), F.hll_union_agg(f"{s}.prefix").alias("prefix"))
        return F.when(F.sum("n_rows") > 0, both).alias(s)

    return df.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *[of(s) for s in df.columns if s not in ("part", "n_rows", "batch", "rebuilt")])


def _number(folder: str) -> int:
    return int(folder.rsplit("=", 1)[1])


def _read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    done = [p for p in finished(spark, path) if before is None or _number(p) < before]
    return spark.read.option("basePath", path).parquet(*done) if done else None


def live(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The state rows that hold, or held before some batch: for each partition its last
    whole count and what was absorbed since."""
    rows = _read(spark, path, before)
    if rows is None:
        raise ValueError(f"no finished batch in {path}")
    last = F.max(F.when(F.col("rebuilt"), F.col("batch"))).over(Window.partitionBy("part"))
    return rows.withColumn("last", last).where("last is null or batch >= last").drop("last")


def _write(df: DataFrame, path: str, batch: int, rebuilt: bool) -> None:
    df.withColumn("rebuilt", F.lit(rebuilt)).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def refresh(df: DataFrame, path: str, batch: int, by: list[str], columns: list[str], changed: DataFrame | None = None, bits: int = BITS) -> None:
    """Count the partitions of `changed` (rows of `by`) anew, or all of them. Of a table
    that is partitioned by `by`, only those are read. A partition that has no rows any more
    counts as empty; the values in `changed` go through the driver, which lists a table's
    partitions anyway."""
    spark = df.sparkSession
    if changed is not None:
        changed = changed.select(*by).distinct()
        df = df.where(in_partitions(by, changed.collect()))
        known = changed.select(F.struct(*by).alias("part"))
    else:
        before = _read(spark, path, batch)
        known = None if before is None else before.select("part").distinct()
    out = states(df, by, columns, bits)
    if known is not None:
        # joined by value, so that null partitions meet; empty ones keep a row without sketches
        out = known.alias("k").join(out.alias("o"), F.col("k.part").eqNullSafe(F.col("o.part")), "full_outer").select(F.coalesce("o.part", "k.part").alias("part"), F.coalesce("o.n_rows", F.lit(0)).cast("bigint").alias("n_rows"), *[F.col(f"o.s{i}") for i in range(len(columns))])
    _write(out, path, batch, True)


def absorb(added: DataFrame, path: str, batch: int, by: list[str], columns: list[str], bits: int = BITS) -> None:
    """Count rows that were appended; no other row of the table is read."""
    _write(states(added, by, columns, bits), path, batch, False)


def fold(spark: SparkSession, path: str, batch: int) -> None:
    """One batch that says what all before it say together."""
    _write(merged(live(spark, path, batch), ["part"]), path, batch, True)


def tidy(spark: SparkSession, path: str) -> list[str]:
    """Delete batches of which nothing holds any more, and return their folders. Readers
    that began before the last fold must have ended."""
    used = {r[0] for r in live(spark, path).select("batch").distinct().collect()}
    gone = [p for p in finished(spark, path) if _number(p) not in used]
    delete(spark, gone)
    return gone


def describe(states: DataFrame, columns: list[str]) -> DataFrame:
    """(column, prefix, n_rows, n_nulls, n_distinct, low, high, n_prefix) of the table that
    live states add up to: values of each column without nulls, and of the leading part of
    the list that ends with it, whose density is 1 / n_prefix. Only the two counts of
    distinct values are estimates."""
    one = merged(states, [])

    def of(i: int) -> Column:
        s = F.col(f"s{i}")
        count = lambda x: F.coalesce(F.hll_sketch_estimate(s[x]), F.lit(0)).cast("bigint")
        return F.struct(F.lit(columns[i]).alias("column"), F.lit(i + 1).alias("prefix"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), F.coalesce(s["n_nulls"], F.lit(0)).cast("bigint").alias("n_nulls"),
                        count("values").alias("n_distinct"), s["low"].cast("string").alias("low"), s["high"].cast("string").alias("high"), count("prefix").alias("n_prefix"))

    return one.select(F.inline(F.array(*[of(i) for i in range(len(columns))])))
