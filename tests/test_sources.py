"""Stored layouts and databases over JDBC."""

import pytest
from pyspark.sql import functions as F

from plumbline.sources import jdbc, layouts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_opens_few_files(spark, sf, tmp_path):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    path = str(tmp_path / "by_part")
    layouts.store(lines, path, ["l_partkey", "l_quantity DESC"], ["l_orderkey"], by_value=["l_orderkey"], files=10)
    every = spark.read.parquet(f"{path}/rows")
    assert every.columns == ["l_partkey", "l_quantity", "l_orderkey"] and len(every.inputFiles()) > 5
    out = layouts.lookup(spark, path, "l_partkey", 20, 25)
    assert "Exchange" not in plan(out) and "PushedFilters: [IsNotNull(l_partkey), GreaterThanOrEqual(l_partkey,20)" in plan(out)
    assert len(out.inputFiles()) <= 3
    want = lines.where("l_partkey between 20 and 25").select(*every.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count()
    one = layouts.lookup(spark, path, "l_partkey", high=1, and_=F.col("l_quantity") > 10)
    assert one.count() == lines.where("l_partkey <= 1 and l_quantity > 10").count()
    assert layouts.lookup(spark, path, "l_partkey", 10**9).isEmpty() and layouts.lookup(spark, path, "l_partkey").count() == lines.count()
    with pytest.raises(ValueError):
        layouts.lookup(spark, path, "l_quantity", 1)


def test_layout_of_nulls_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "k int, v int")
    layouts.store(df, str(tmp_path / "n"), ["k"], files=3)
    assert [r["v"] for r in layouts.lookup(spark, str(tmp_path / "n"), "k", 0).collect()] == [3]
    layouts.store(df.limit(0), str(tmp_path / "e"), ["k"])
    assert layouts.lookup(spark, str(tmp_path / "e"), "k").isEmpty()


@pytest.fixture(scope="module")
def database(spark):
    url = "jdbc:derby:memory:plumbline;create=true"
    rows = [(i, f"n{i % 7}", None if i % 11 == 0 else float(i)) for i in range(500)]
    spark.createDataFrame(rows, 'id int, name string, Amount double').write.option("createTableColumnTypes", "name VARCHAR(20)").jdbc(url, '"items"', properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    return url


def test_reads_are_split_and_filtered_by_the_server(spark, database):
    out = jdbc.read_table(spark, database, "items", split="id", where="Amount > 100 and name = 'n3'", rows_per_task=10)
    assert out.rdd.getNumPartitions() > 3
    text = plan(out.select("id"))
    assert "PushedFilters" in text and "GreaterThan(Amount,100.0)" in text and "EqualTo(name,n3)" in text.replace("*", "")
    assert sorted(r["id"] for r in out.collect()) == [i for i in range(101, 500) if i % 7 == 3 and i % 11]
    assert jdbc.read_table(spark, database, "items", split="id").rdd.getNumPartitions() == 1
    assert jdbc.read_table(spark, database, "items", split="id", where="id < 0", rows_per_task=10).isEmpty()


def test_missing_tables_are_skipped(spark, database):
    found = jdbc.extract_tables(spark, database, {"items": {"keys": ["id"], "where": "id < 3", "split": "id"}, "none": {"keys": ["x"]}})
    assert list(found) == ["items"] and [tuple(r) for r in found["items"].select("id", "name").collect()] == [(0, "n0"), (1, "n1"), (2, "n2")]
    assert {"items", "APP.items"} <= jdbc.tables_of(spark, database)
