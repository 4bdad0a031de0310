"""Statistics that are kept: merged states against counts over all rows."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.operators import stats, statstore

BY, COLUMNS = ["p"], ["a", "b"]


def rows(spark, n, parts=5):
    """a has many values and nulls, b repeats, and a partition is null."""
    r = F.col("id")
    return spark.range(n).select(F.when(r % parts > 0, (r % parts).cast("string")).alias("p"), F.when(r % 11 > 0, F.xxhash64(r % 7001)).alias("a"), (r % 13).cast("double").alias("b"))


def described(df):
    return {r["column"]: r for r in statstore.describe(df, COLUMNS).collect()}


def held(spark, path):
    return described(statstore.live(spark, path))


def exact(df):
    prefixes = {r["prefix"]: r["n_distinct"] for r in stats.multi(df, COLUMNS).collect()}
    return {c: (*stats.single(df, c).selectExpr("n_rows", "n_nulls", "n_distinct", "cast(low as string)", "cast(high as string)").first(), prefixes[i + 1]) for i, c in enumerate(COLUMNS)}


def same(got, df, bits=12):
    want = exact(df)
    for c, (n, nulls, distinct, low, high, prefix) in want.items():
        r = got[c]
        assert (r["n_rows"], r["n_nulls"], r["low"], r["high"]) == (n, nulls, low, high)
        for x, y in ((r["n_distinct"], distinct), (r["n_prefix"], prefix)):
            assert abs(x - y) <= 4 * statstore.error(bits) * y


def stored(df, path):
    df.repartition("p").write.partitionBy("p").mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_only_changed_partitions_are_read(spark, tmp_path):
    """Files of other partitions are spoilt after the first count; a refresh of one that
    changed never opens them."""
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    df = rows(spark, 20000)
    statstore.refresh(stored(df, table), store, 0, BY, COLUMNS)
    more = df.unionByName(rows(spark, 3000).where("p = '2'").withColumn("b", F.lit(99.0)))
    now = stored(more, table)
    for f in Path(table).glob("p=*/*.parquet"):
        if "p=2" not in str(f):
            f.write_bytes(b"spoilt")
    for crc in Path(table).glob("p=*/.*.crc"):
        os.remove(crc)
    statstore.refresh(now, store, 1, BY, COLUMNS, spark.createDataFrame([("2",)], "p string"))
    same(held(spark, store), more)
    with pytest.raises(Exception):
        statstore.refresh(now, store, 2, BY, COLUMNS, spark.createDataFrame([("3",)], "p string"))
    # the count that failed left no mark, and is not read
    same(held(spark, store), more)


def test_refreshed_absorbed_and_folded_equal_a_rebuild(spark, tmp_path):
    store, anew = str(tmp_path / "s"), str(tmp_path / "n")
    df = rows(spark, 20000)
    first, added = df.where("b < 9"), df.where("b >= 9")
    statstore.refresh(first, store, 0, BY, COLUMNS)
    statstore.absorb(added, store, 1, BY, COLUMNS)
    same(held(spark, store), df)
    # a null partition and one that loses all rows
    left = df.where("p is null and b < 5 or p in ('1', '2', '4')")
    gone = spark.createDataFrame([(None,), ("3",)], "p string")
    for _ in range(2):
        statstore.refresh(left, store, 2, BY, COLUMNS, gone)
        same(held(spark, store), left)
    statstore.absorb(df.where("p = '3' and b = 1"), store, 3, BY, COLUMNS)
    now = left.unionByName(df.where("p = '3' and b = 1"))
    for _ in range(2):
        statstore.fold(spark, store, 4)
        same(held(spark, store), now)
    assert len(statstore.tidy(spark, store)) == 4 and len(statstore.tidy(spark, store)) == 0
    statstore.refresh(now, anew, 0, BY, COLUMNS)
    assert held(spark, store) == held(spark, anew)
    # counted anew as a whole, without what is there no more
    for _ in range(2):
        statstore.refresh(df.where("p = '1'"), store, 5, BY, COLUMNS)
        same(held(spark, store), df.where("p = '1'"))


@pytest.mark.parametrize("bits", [8, 14])
def test_error_by_size(spark, bits):
    """Of twenty counts at most one is off by more than three standard errors."""
    df = spark.range(200000).select((F.col("id") % 20).alias("p"), F.col("id").alias("a"))
    each = statstore.states(df, ["p"], ["a"], bits).select(F.hll_sketch_estimate("s0.values").alias("n")).collect()
    assert len(each) == 20 and sum(abs(r["n"] - 10000) > 3 * statstore.error(bits) * 10000 for r in each) <= 1


def test_nothing_and_nulls(spark, tmp_path):
    empty = rows(spark, 0)
    got = described(statstore.states(empty, BY, COLUMNS))
    assert [(r["n_rows"], r["n_nulls"], r["n_distinct"], r["low"], r["n_prefix"]) for r in got.values()] == [(0, 0, 0, None, 0)] * 2
    nulls = spark.createDataFrame([("x", None, None)] * 3, "p string, a bigint, b double")
    same(described(statstore.states(nulls, BY, COLUMNS)), nulls)
    # (null, 1) and (1, null) are two leading parts
    two = spark.createDataFrame([("x", None, 1), ("x", 1, None)], "p string, a int, b int")
    assert described(statstore.states(two, BY, COLUMNS))["b"]["n_prefix"] == 2
    with pytest.raises(ValueError):
        statstore.live(spark, str(tmp_path / "none"))
