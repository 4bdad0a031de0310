"""Conforming, checking and normalising small frames."""

import bisect
import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import normalize
from plumbline.operators import checks, conform, drift, ledger, stats, temporal
from plumbline.sources import tables as src


@pytest.mark.parametrize("text, want", [("(a)+(b)", "(a)+(b)"), ("((a)+(b))", "(a)+(b)"), ("(((x)))", "x"), ("f(x)", "f(x)"), ("(f(x))", "f(x)"), (" ( a ) ", "a"), ("()", ""), ("", "")])
def test_strip_parens(spark, text, want):
    assert spark.createDataFrame([(text,)], "e string").select(normalize.strip_parens(F.col("e"))).head()[0] == want


def test_names(spark):
    df = spark.createDataFrame([("[[a b]]",), (" [x",), ("a]",), ("[[a ] ]",), ("[[]",), ("[]",), ("",), (None,)], "n string").select(normalize.strip_brackets(F.col("n")).alias("n"))
    assert [r["n"] for r in df.collect()] == ["a b", "[x", "a]", "a", "[", "", "", None]


def test_catalog_of_user_tables(spark):
    rows = [("d", s, t, "c") for s, t in (("dbo", "system_users"), ("dbo", "SysDiagrams"), ("dbo", "MSpeer_a"), ("dbo", "mspeers"), ("sys", "x"), ("Tool", "x"))]
    df = spark.createDataFrame(rows, "database string, schema string, table string, column string")
    assert sorted(r["table"] for r in src.read_catalog(df).collect()) == ["mspeers", "system_users"]


def test_compression_of_a_clustered_index(spark):
    index = "database string, schema string, table string, name string, compression string, clustered boolean, fill_factor int"
    table = "database string, schema string, table string, compression string"
    desired = spark.createDataFrame([("d", "dbo", "t", "i", "ROW", True, 0), ("d", "dbo", "u", "i", None, False, 0)], index)
    live = spark.createDataFrame([("d", "dbo", "t", "i", "ROW", True, 100), ("d", "dbo", "u", "i", "PAGE", False, 100)], index)
    tables = spark.createDataFrame([("d", "dbo", "t", "PAGE"), ("d", "dbo", "u", "PAGE")], table)
    now = spark.createDataFrame([("d", "dbo", "t", "ROW"), ("d", "dbo", "u", "NONE")], table)
    out = drift.storage_drift(desired, live, tables, now).collect()
    assert sorted((r["table"], r["name"] or "", r["want_compression"], r["have_compression"]) for r in out) == [("u", "", "PAGE", "NONE"), ("u", "i", "NONE", "PAGE")]


def test_a_clustered_columnstore_index_takes_its_table_out(spark):
    """A table under one has no compression of its own; a columnstore index has COLUMNSTORE
    where it declares none, and tables drift among NONE, ROW and PAGE only."""
    index = "database string, schema string, table string, name string, compression string, clustered boolean, column_store boolean, fill_factor int"
    table = "database string, schema string, table string, compression string"
    desired = spark.createDataFrame([("d", "dbo", "t", "i", None, True, True, 0), ("d", "dbo", "u", "i", "COLUMNSTORE_ARCHIVE", False, True, 0)], index)
    live = spark.createDataFrame([("d", "dbo", "t", "i", "COLUMNSTORE", True, True, 0), ("d", "dbo", "u", "i", None, False, True, 100)], index)
    tables = spark.createDataFrame([("d", "dbo", "t", "PAGE"), ("d", "dbo", "u", "ROW"), ("d", "dbo", "v", "XML")], table)
    now = spark.createDataFrame([("d", "dbo", t, None) for t in "tuv"], table)
    out = drift.storage_drift(desired, live, tables, now).collect()
    assert sorted((r["table"], r["name"] or "", r["want_compression"], r["have_compression"]) for r in out) == [("u", "", "ROW", "NONE"), ("u", "i", "COLUMNSTORE_ARCHIVE", "COLUMNSTORE")]


def test_conform(spark):
    df = spark.createDataFrame([(1, "12", "x"), (2, "no", "y")], "id int, old string, junk string")
    out = conform.conform(df, {"old": "n"}, {"id": ("int", None), "n": ("int", None), "d": ("string", "'none'")}, {"twice": "id * 2"})
    assert out.columns == ["id", "n", "d", "twice"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 12, "none", 2), (2, None, "none", 4)]


def test_identity_continues(spark, tmp_path):
    df = spark.createDataFrame([(k, 100 if k == 3 else None) for k in range(8)], "k int, id bigint").repartition(3)
    out = {r["k"]: r["id"] for r in conform.identity_column(df, "id", ["k"], str(tmp_path), 1, 10).collect()}
    assert out == {3: 100, 0: 110, 1: 120, 2: 130, 4: 140, 5: 150, 6: 160, 7: 170}


def test_unmasked_function_leaves_values(spark):
    df = spark.createDataFrame([("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(normalize.mask(F.col("s"), "", "string")).collect()] == ["abc", None]
    assert [r[0] for r in df.select(normalize.mask(F.col("s"), "email()", "string")).collect()] == ["aXXX@XXXX.com", None]


def test_fk_passes_nulls(spark):
    child = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "id int, boss int")
    assert [r["id"] for r in checks.fk_orphans(child, ["boss"], child, ["id"]).collect()] == [2]


def test_gate(spark):
    checks.gate(spark.sql("select true"))
    for sql in ("select false", "select cast(null as boolean)", "select true where false"):
        with pytest.raises(checks.GateClosed):
            checks.gate(spark.sql(sql))


def test_cascade_to_itself_ends_on_a_cycle(spark, tmp_path):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 9)], "id int, boss int")
    out = checks.cascade_delete_self(df, "id", "boss", df.where("id = 1"), str(tmp_path))
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3]


def test_json_rows_leave_nulls_out(spark):
    df = spark.createDataFrame([(1, "Test Item 1", None)], "Id int, Name string, Description string")
    doc = src.to_json_rows(df, ["Id"]).head()["doc"]
    assert doc == '{"Id":1,"Name":"Test Item 1"}'


def test_definition_file(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "t.json").write_text('{"Name": "[T]", "Columns": [{"Name": "[A]", "DataType": "INT", "Nullable": true}],\n "Indexes": [{"Name": "PK", "IndexColumns": "[A] DESC", "PrimaryKey": true}]}')
    (tmp_path / "empty.json").write_text('{"Name": "[U]", "Columns": []}')
    defs = src.read_definitions(spark, str(tmp_path))
    flat = drift.explode_definitions(defs)
    assert [(r["schema"], r["table"], r["Name"]) for r in flat["columns"].collect()] == [("dbo", "T", "A")]
    assert flat["foreign_keys"].isEmpty() and flat["text"].isEmpty()


def test_histogram_by_sorting(spark, tmp_path):
    """Bounds, rows below and rows equal against a sorted list; ties, nulls, few rows, none."""
    rng = random.Random(8)
    for trial, (n, steps, values) in enumerate([(1000, 10, 37), (1000, 7, 100_000), (5, 10, 3), (400, 4, 1), (0, 4, 9)]):
        data = [rng.choice([None, rng.randrange(values)]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in data], "v int").repartition(5)
        kept = sorted(x for x in data if x is not None)
        want = {}
        for i in range(1, steps + 1 if kept else 1):
            high = kept[-(-len(kept) * i // steps) - 1]
            want.setdefault(high, (i, high, sum(x < high for x in kept), kept.count(high)))
        assert sorted(tuple(r) for r in stats.histogram(df, "v", f"{tmp_path}/{trial}", steps).collect()) == sorted(want.values())


def test_versions_of_a_hot_key(spark):
    """One user with most events, times that repeat: cut into slices, same rows."""
    rng = random.Random(2)
    rows = [(i, 7 if rng.random() < 0.9 else rng.choice([1, 2, None]), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.choice([rng.randrange(5000), 77])), 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, user int, ts timestamp_ntz, part int").repartition(4)
    want = sorted(map(str, temporal.versions(df, "user", "ts", "id").collect()))
    for limit in (50, 400, 2600):
        cut = temporal.versions(df, "user", "ts", "id", limit=limit)
        assert cut.columns == [*df.columns, "ValidFrom", "ValidTo"]
        assert sorted(map(str, cut.collect())) == want
    found = temporal.slices(df, "user", "ts", 400).collect()
    assert [r["user"] for r in found] == [7] and len(found[0]["bounds"]) > 3
    # no slice holds much more than the limit, but for the time that repeats
    per = collections.Counter(sum(b < t for b in found[0]["bounds"]) for _, u, t, _ in rows if u == 7)
    assert sorted(per.values())[-2] <= 600


def _next_times(rows, lasts):
    """(id, until) by sorting each user's rows; nulls last."""
    out, per = {}, collections.defaultdict(list)
    for i, user, ts in rows:
        per[user].append((ts is None, ts or lasts, i is None, i, ts))
    for found in per.values():
        found.sort(key=lambda r: r[:4])
        for this, following in zip(found, [*found[1:], None]):
            out[this[3]] = following[4] if following and following[4] else lasts
    return out


def test_slices_are_found_once_and_nulls_come_last(spark):
    """Every reader of the slices finds the same ones, so they are written; times at all
    scales, some of them null, in zones with and without a summer time."""
    rng, lasts, zone = random.Random(4), datetime.datetime(9999, 12, 31, 23, 59, 59, 999999), spark.conf.get("spark.sql.session.timeZone")
    start = datetime.datetime(2024, 10, 27)
    rows = [(i, rng.choice([7, 7, 7, 8, None]), rng.choice([None, *[start + datetime.timedelta(microseconds=rng.randrange(10 ** rng.randrange(1, 12)))] * 9])) for i in range(3000)]
    rows += [(3000 + i, 7, start.replace(year=y)) for i, y in enumerate((1, 1582, 1969, 9999))]
    df = spark.createDataFrame(rows, "id int, user int, ts timestamp_ntz").repartition(4)
    want = _next_times(rows, lasts)
    try:
        for limit, named in ((40, "Europe/Berlin"), (10_000, "UTC")):
            spark.conf.set("spark.sql.session.timeZone", named)
            cut = temporal.versions(df, "user", "ts", "id", limit=limit)
            assert {r["id"]: r["ValidTo"] for r in cut.collect()} == want
            assert "percentile" not in cut._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)



def test_many_slices_cost_an_event_no_more(spark):
    """An event finds its slice by arithmetic, not by looking through all of them; each
    holds twice the limit at most, and keys with few events have no more slices for it."""
    rng, lasts = random.Random(6), datetime.datetime(9999, 12, 31, 23, 59, 59, 999999)
    rows = [(i, 7 if i % 10 else 8, datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=rng.randrange(10**10))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id int, user int, ts timestamp_ntz").repartition(4)
    cut = temporal.versions(df, "user", "ts", "id", limit=20)
    assert "lambda" not in cut._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["ValidTo"] for r in cut.collect()} == _next_times(rows, lasts)
    bounds = {r["user"]: r["bounds"] for r in temporal.slices(df, "user", "ts", 20).collect()}
    sizes = {u: collections.Counter(bisect.bisect_left(b, t) for _, v, t in rows if v == u) for u, b in bounds.items()}
    assert len(sizes[7]) > 500 and 50 < len(sizes[8]) < 250 and max(max(c.values()) for c in sizes.values()) <= 40


def test_ledger(spark):
    inputs = spark.createDataFrame([("a", "p", "s", False), ("b", "p", "s", True), ("c", "p", "s", None)], "path string, product string, slot string, always boolean")
    done = spark.createDataFrame([("a", "p", "s", None), ("b", "p", "s", None), ("z", "p", "s", None)], "path string, product string, slot string, done_at timestamp")
    assert {r["path"] for r in ledger.pending(inputs, done).collect()} == {"b", "c"}
    assert {r["path"] for r in ledger.record(done, inputs).collect()} == {"a", "b", "c", "z"}
    assert [r["path"] for r in ledger.obsolete(done, inputs).collect()] == ["z"]
