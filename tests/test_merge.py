"""Laws of merging and history on small frames with nulls and repeated keys."""

import pytest

from plumbline.operators import merge, temporal
from plumbline.sources import tables as src

SCHEMA = "id int, part string, v double, note string"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a", 1.0, "x"), (2, "a", None, None), (3, "b", 3.0, "z"), (4, None, 4.0, "w")], SCHEMA)


@pytest.fixture
def source(spark):
    return spark.createDataFrame([(1, "a", 1.0, "x"), (2, "a", 2.0, None), (5, "c", 5.0, "n"), (None, "q", 0.0, "null key")], SCHEMA)


def test_actions(target, source):
    got = {(r["id"], r["action"]) for r in merge.diff(target, source, ["id"]).collect()}
    assert got == {(1, "keep"), (2, "update"), (3, "delete"), (4, "delete"), (5, "insert"), (None, "insert")}


def test_delete_needs_a_true_predicate(target, source):
    out = merge.merge(target, source, ["id"], delete=True, where="part = 'b'")
    # 4 has a null part, so the predicate is not true for it
    assert {r["id"] for r in out.collect()} == {1, 2, 4, 5, None}


def test_merge_twice_is_merge_once(target, source):
    s = source.where("id is not null")
    once = merge.merge(target, s, ["id"])
    assert rows(merge.merge(once, s, ["id"])) == rows(once)


def test_merge_with_delete_is_the_source(target, source):
    s = source.where("id is not null")
    assert rows(merge.merge(target, s, ["id"], delete=True)) == rows(s)


def test_after_merge_all_is_kept(target, source):
    s = source.where("id is not null")
    after = merge.merge(target, s, ["id"], delete=True)
    assert {r["action"] for r in merge.diff(after, s, ["id"]).collect()} == {"keep"}


def test_empty_sides(target, source):
    none = source.limit(0)
    assert rows(merge.merge(target, none, ["id"])) == rows(target)
    assert merge.merge(target, none, ["id"], delete=True).isEmpty()
    assert rows(merge.insert_only(none, target, ["id"])) == rows(target)


def test_key_guard(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "id int")
    assert {(r["id"], r["n"], r["reason"]) for r in merge.key_guard(df, ["id"]).collect()} == {(1, 2, "repeated"), (None, 1, "null")}


def test_roles(spark, target):
    t = src.with_roles(target, {"v": src.COMPUTED, "part": src.IDENTITY, "note": src.ROWGUID})
    assert merge.roles(t.schema) == {"read": ["id", "part"], "insert": ["id", "part"], "update": ["id"]}


def test_history(target, source):
    s = source.where("id is not null")
    current, past = temporal.on(target)
    assert past.isEmpty()
    current, past = temporal.apply(current, past, s, ["id"], "2024-01-01 00:00:00")
    assert rows(temporal.as_of(current, past, "2024-01-02 00:00:00")) == rows(s)
    assert rows(temporal.as_of(current, past, "2023-12-31 00:00:00")) == rows(target)
    assert past.count() == 3


def _files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def _stored(spark, folder, rows):
    spark.createDataFrame(rows, "id int, v string, w int, p string").repartition("p").write.partitionBy("p").parquet(str(folder))


def test_stored_merge_leaves_other_partitions(spark, tmp_path):
    """Files of partitions without a change stay; rows move; an emptied partition goes."""
    t = tmp_path / "t"
    _stored(spark, t, [(1, "a", 1, "x"), (2, "b", 2, "x"), (3, "c", 3, "y"), (4, "d", 4, "z"), (5, "e", 5, "q"), (None, "n", 6, "y")])
    before = _files(t)
    source = spark.createDataFrame([(1, "a", "x"), (2, "B", "new"), (3, "c", "y"), (4, "d", "z"), (9, "i", "new")], "id int, v string, p string")
    counts = merge.merge_stored(str(t), source, ["id"], ["p"], str(tmp_path / "w"), delete_missing=True, where="p in ('q', 'y')")
    assert {(r["p"], r["n_insert"], r["n_update"], r["n_delete"]) for r in counts.collect()} == {("x", 0, 0, 0), ("new", 1, 1, 0), ("q", 0, 0, 1), ("y", 0, 0, 1)}
    got = {(r["id"], r["v"], r["w"], r["p"]) for r in spark.read.parquet(str(t)).collect()}
    assert got == {(1, "a", 1, "x"), (2, "B", 2, "new"), (3, "c", 3, "y"), (4, "d", 4, "z"), (9, "i", None, "new")}
    after = _files(t)
    assert {f: m for f, m in after.items() if f.startswith("p=z")} == {f: m for f, m in before.items() if f.startswith("p=z")}
    assert not (t / "p=q").exists()


def test_stored_merge_again_changes_nothing(spark, tmp_path):
    t = tmp_path / "t"
    _stored(spark, t, [(1, "a", 1, "x"), (2, "b", 2, "y")])
    source = spark.createDataFrame([(1, "A", 7, "x"), (3, "c", 3, "y")], "id int, v string, w int, p string")
    for n, want in enumerate((2, 0)):
        counts = merge.merge_stored(str(t), source, ["id"], ["p"], str(tmp_path / f"w{n}"))
        assert counts.count() == want
        files = _files(t) if n == 0 else files  # noqa: F821
    assert _files(t) == files
    assert {tuple(r) for r in spark.read.parquet(str(t)).collect()} == {(1, "A", 7, "x"), (2, "b", 2, "y"), (3, "c", 3, "y")}


def test_stored_merge_reads_named_partitions(spark, tmp_path):
    """With the partition column in the key, others need not even be readable."""
    t = tmp_path / "t"
    _stored(spark, t, [(1, "a", 1, "x"), (2, "b", 2, "y")])
    for f in (t / "p=y").glob("*.parquet"):
        f.write_bytes(b"no parquet")
    for f in (t / "p=y").glob(".*.crc"):
        f.unlink()
    source = spark.createDataFrame([(1, "A", "x"), (3, "c", "x")], "id int, v string, p string")
    merge.merge_stored(str(t), source, ["id", "p"], ["p"], str(tmp_path / "w"), set_columns=["v"])
    assert {tuple(r) for r in spark.read.schema("id int, v string, w int").parquet(str(t / "p=x")).collect()} == {(1, "A", 1), (3, "c", None)}
