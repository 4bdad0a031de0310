"""Postings: positions, keys, refreshing from a stream, compaction."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks, merge, text
from plumbline.streaming import text_stream

TEXTS = [(1, "Red, red blue", None), (2, "", "--"), (3, None, None), (4, "--blue--", "Ünï x Ünï")]


def test_positions(spark):
    df = spark.createDataFrame(TEXTS, "id int, a string, b string")
    got = {(r["term"], r["id"], r["column"]): (r["n"], r["positions"]) for r in text.text_index(df, "id", ["a", "b"]).collect()}
    assert got == {("red", 1, "a"): (2, [0, 1]), ("blue", 1, "a"): (1, [2]), ("blue", 4, "a"): (1, [1]), ("ünï", 4, "b"): (2, [0, 2]), ("x", 4, "b"): (1, [1])}


def test_no_shuffle_of_terms(spark):
    df = spark.createDataFrame(TEXTS, "id int, a string, b string")
    assert "Exchange" not in text.text_index(df, "id", ["a"])._jdf.queryExecution().executedPlan().toString()


def test_key(spark):
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            text.text_index(spark.createDataFrame(rows, "id int, a string"), "id", ["a"])


class Store:
    """A stream of rows (id, a, version) into a store, a batch per call."""

    def __init__(self, spark, folder, schema="id int, a string, version int", **how):
        self.spark, self.folder, self.schema, self.how = spark, str(folder), schema, how
        self.path = f"{folder}/store"

    def step(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        changes = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")
        text_stream.keep_postings(changes, self.path, f"{self.folder}/state", "id", ["a"], **self.how).awaitTermination()

    def terms(self):
        return {(r["id"], r["term"]) for r in text_stream.read_postings(self.spark, self.path, "id").collect()}


def test_late_versions_lose(spark, tmp_path):
    s = Store(spark, tmp_path)
    s.step((1, "red", 5), (2, "blue", 1))
    s.step((1, "pink", 3), (2, "black", 2))
    assert s.terms() == {(1, "red"), (2, "black")}
    s.step((1, "late", 5), (2, None, 3))
    assert s.terms() == {(1, "red")}
    s.step((2, "grey", 2), (3, "new", None), (None, "lost", 1))
    assert s.terms() == {(1, "red"), (3, "new")}
    s.step((2, "white", 4), (3, "newer", 0))
    assert s.terms() == {(1, "red"), (2, "white"), (3, "newer")}


def test_repeated_rows_collapse(spark, tmp_path):
    s = Store(spark, tmp_path)
    s.step((1, "red red", 1), (1, "red red", 1), (2, "a1", 1), (2, "b1", 1), (2, "c1", 0))
    rows = text_stream.read_postings(spark, s.path, "id").collect()
    assert sorted((r["id"], r["term"], r["n"]) for r in rows) == [(1, "red", 2), (2, "b1", 1)]
    plain = Store(spark, tmp_path / "plain", "id int, a string")
    plain.step((1, "x1"), (1, "x1"))
    plain.step((1, "y1"))
    assert plain.terms() == {(1, "y1")}


def test_tombstones_by_column(spark, tmp_path):
    s = Store(spark, tmp_path, "id int, a string, version int, deleted boolean")
    s.step((1, "red", 1, None), (2, "blue", 1, False))
    s.step((1, "red", 2, True))
    s.step((1, "red", 1, False))
    assert s.terms() == {(2, "blue")}


def test_compaction_keeps_what_was_decided(spark, tmp_path):
    """Reading touches the live generation only, tombstones outlive it, batches fold."""
    s = Store(spark, tmp_path, fold=3)
    s.step((1, "red", 5), (2, "blue", 1), (3, "green", 1))
    s.step((2, None, 4), (3, "lime", 2))
    assert len(text_stream.manifests(spark, s.path)[0]["segments"]) == 2
    s.step((1, "pink", 6))
    live = text_stream.manifests(spark, s.path)[0]["segments"]
    assert live == ["base-3"] and s.terms() == {(1, "pink"), (3, "lime")}
    read = text_stream.read_postings(spark, s.path, "id")
    assert all("/postings/base-3/" in f for f in read.inputFiles())
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    s.step((2, "late", 3), (1, "late", 5))
    assert s.terms() == {(1, "pink"), (3, "lime")}
    s.step((2, "back", 5))
    assert s.terms() == {(1, "pink"), (3, "lime"), (2, "back")}
    # what only manifests before the replaced one named is gone
    assert not any((tmp_path / "store" / "postings" / f"batch-{n}").exists() for n in (0, 1, 2))
    assert (tmp_path / "store" / "postings" / "base-3").exists()


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """A batch that failed before its manifest is written anew; one that had it is skipped."""
    path = str(tmp_path)
    df = spark.createDataFrame([(1, "red")], "id int, a string")
    text_stream.take(spark, df, 0, path, "id", ["a"])
    before = text_stream.manifests(spark, path)
    text_stream.take(spark, df.limit(0), 0, path, "id", ["a"])
    assert text_stream.manifests(spark, path) == before
    spark.createDataFrame([(9, 0, 1, False)], "id int, version bigint, seq bigint, gone boolean").write.parquet(f"{path}/heads/batch-1")
    assert {r["term"] for r in text_stream.read_postings(spark, path, "id").collect()} == {"red"}
    text_stream.take(spark, df.selectExpr("2 as id", "'blue' as a"), 1, path, "id", ["a"])
    assert {r["term"] for r in text_stream.read_postings(spark, path, "id").collect()} == {"red", "blue"}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, 2, 3), (2, 1, 2, 3)], "id int, `in` int, scope int, key int")
    assert {r["action"] for r in merge.diff(df, df, ["id"], where="scope = 2").collect()} == {"keep"}
    assert merge.merge(df, df.limit(0), ["id"], delete=True, where="scope = 2").isEmpty()
    removed = df.where("id = 1").select("id")
    assert [r["id"] for r in checks.set_on_delete(df, "in", removed, "id").where(F.col("in").isNull()).collect()] == [1, 2]


def test_row_report(spark):
    df = spark.createDataFrame([(1, None), (5, "x"), (None, "y")], "a int, b string")
    got = {(r["constraint"], r["n"]) for r in checks.row_report(df, "t", {"small": "a < 3"}, ["b"]).collect()}
    assert got == {("small", 1), ("b", 1)}
