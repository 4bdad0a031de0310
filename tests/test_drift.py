"""Signatures of declared objects, and what is dropped with what."""

import json

from pyspark.sql import functions as F

from plumbline.operators import drift
from plumbline.sources import tables as src

ONE = """{"Schema": "[s]", "Name": "[T]", "Columns": [{"Name": "[A]", "DataType": "INT", "Default": "((1))"}, {"Name": "B", "DataType": "INT"}],
 "Indexes": [{"Name": "[I]", "IndexColumns": "[A], [B] desc", "IncludeColumns": "[D],[C]", "FilterExpression": "([A]>(0))"}],
 "XmlIndexes": [{"Name": "[X]", "Column": "[D]", "IsPrimary": true}],
 "ForeignKeys": [{"Name": "[F]", "Columns": "[A]", "RelatedTableSchema": "[s]", "RelatedTable": "[U]", "RelatedColumns": "[A]"}],
 "CheckConstraints": [{"Name": "[K]", "Expression": "(([A]>(0)))"}], "Statistics": [{"Name": "[S]", "Columns": "[A]"}],
 "FullTextIndex": {"FullTextCatalog": "[c]", "KeyIndex": "[I]", "ChangeTracking": "auto", "Columns": "[B],[A]"}}"""
TWO = """{"Schema": "s", "Name": "T", "Columns": [{"Name": "A", "DataType": "INT", "Default": "1"}, {"Name": "B", "DataType": "INT"}],
 "Indexes": [{"Name": "I", "IndexColumns": "A,B DESC", "IncludeColumns": "C, D", "FilterExpression": "[A]>(0)", "Unique": false}],
 "XmlIndexes": [{"Name": "X", "Column": "D", "IsPrimary": true}],
 "ForeignKeys": [{"Name": "F", "Columns": "A", "RelatedTableSchema": "s", "RelatedTable": "U", "RelatedColumns": "A", "DeleteAction": "no action"}],
 "CheckConstraints": [{"Name": "K", "Expression": "[A]>(0)"}], "Statistics": [{"Name": "S", "Columns": "A"}],
 "FullTextIndex": {"FullTextCatalog": "c", "KeyIndex": "I", "ChangeTracking": "AUTO", "Columns": "A,B"}}"""


def signed(spark, text):
    docs = spark.createDataFrame([("d", text)], "database string, j string")
    return drift.signatures(drift.explode_definitions(docs.select("database", F.from_json("j", src.DEFINITION).alias("x")).select("database", "x.*")))


def test_spelling_does_not_count(spark):
    one = signed(spark, ONE)
    assert {r["kind"] for r in one.collect()} == {"index", "xml_index", "foreign_key", "check", "default", "statistic", "text_index"}
    assert drift.signature_drift(one, signed(spark, TWO)).isEmpty()


def test_changes_count(spark):
    changed = TWO.replace('"A,B DESC"', '"B DESC,A"').replace('"no action"', '"CASCADE"').replace('"Default": "1"', '"Default": "2"').replace('"C, D"', '"C"')
    got = {(r["kind"], r["name"], r["change"]) for r in drift.signature_drift(signed(spark, ONE), signed(spark, changed)).collect()}
    assert got == {("index", "I", "changed"), ("foreign_key", "F", "changed"), ("default", "A", "changed")}


def _index(**fields):
    return json.dumps({"Schema": "s", "Name": "T", "Columns": [{"Name": "A", "DataType": "INT"}], "Indexes": [{"Name": "I", "IndexColumns": "A", "IncludeColumns": "B"} | fields]})


def test_an_index_that_differs_by_compression_alone(spark):
    drifts = lambda a, b: not drift.signature_drift(signed(spark, _index(**a)), signed(spark, _index(**b))).isEmpty()
    assert drifts({"CompressionType": "PAGE"}, {})
    assert not drifts({"CompressionType": " "}, {"CompressionType": "none"})
    assert drifts({"ColumnStore": True, "CompressionType": "COLUMNSTORE_ARCHIVE"}, {"ColumnStore": True})
    assert not drifts({"ColumnStore": True, "CompressionType": "COLUMNSTORE"}, {"ColumnStore": True})
    # a compression that the form cannot have
    assert drifts({"CompressionType": "COLUMNSTORE"}, {}) and drifts({"ColumnStore": True, "CompressionType": "PAGE"}, {"ColumnStore": True})


def test_forms_of_columnstore_indexes(spark):
    """They have no keys; one that is clustered covers all columns."""
    drifts = lambda a, b: not drift.signature_drift(signed(spark, _index(**a)), signed(spark, _index(**b))).isEmpty()
    store = {"ColumnStore": True}
    assert drifts(store, {}) and not drifts(store, store | {"IndexColumns": "B"})
    assert drifts(store, store | {"IncludeColumns": "A"})
    assert not drifts(store | {"Clustered": True}, store | {"Clustered": True, "IncludeColumns": "A"})


OBJECTS = "database string, schema string, table string, kind string, name string, columns string, definition string, clustered boolean, is_unique boolean, owner string"


def objects(spark, *rows):
    return spark.createDataFrame([("d", "s", *r) for r in rows], OBJECTS)


def test_reasons_to_drop(spark):
    live = objects(spark, ("a", "index", "mine", "A", None, False, False, "me"), ("a", "index", "other", "A", None, False, False, "you"), ("b", "index", "column", "B", None, False, True, "me"),
                   ("c", "index", "key", "C", None, True, True, "me"), ("c", "xml_index", "x", "X", None, False, False, None), ("e", "xml_index", "moved", "X", None, False, False, None), ("e", "index", "stays", "E", None, False, True, "me"))
    desired = live.where("name in ('column', 'key', 'x', 'moved', 'stays')")
    drifted = live.where("name in ('key', 'moved')").select(*drift.OBJECT, F.lit("changed").alias("change"))
    changed = spark.createDataFrame([("d", "s", "b", "B")], "database string, schema string, table string, column string")
    drops = {u: drift.index_drops(desired, live, drifted, changed, "me", u) for u in (False, True)}
    names = {u: sorted(r["name"] for r in df.collect()) for u, df in drops.items()}
    assert names == {False: ["column", "key", "mine", "moved", "x"], True: ["column", "key", "mine", "moved", "other", "x"]}
    fks = spark.createDataFrame([("d", "s", "z", f"to_{t}", "s", t) for t in "abce"], "database string, schema string, table string, name string, related_schema string, related_table string")
    assert sorted(r["name"] for r in drift.dependent_fks(fks, live.where("kind = 'index'"), drops[True]).collect()) == ["to_b", "to_c"]


def _impact(spark, changed, columns, objects, folder):
    c = spark.createDataFrame([("d", "s", t, n) for t, n in changed], "database string, schema string, table string, column string")
    cols = spark.createDataFrame([("d", "s", t, n, e) for t, n, e in columns], "database string, schema string, table string, column string, computed string")
    obj = spark.createDataFrame([("d", "s", *o) for o in objects], "database string, schema string, table string, kind string, name string, columns string, definition string, related_schema string, related_table string, related_columns string")
    return c, cols, obj, {(r["table"], r["kind"], r["name"], r["depth"]) for r in drift.transitive_impact(c, cols, obj, str(folder)).collect()}


TOUCHED = [("T", "index", "I", "[C3] DESC, X", None, None, None, None), ("T", "check", "K", None, "([c10] > 'C1 is text')", None, None, None), ("T", "statistic", "S", "C1", None, None, None, None), ("T", "index", "F", "X", "[C2]<(5)", None, None, None),
           ("U", "foreign_key", "R", "A", None, "s", "T", "[c4],B"), ("U", "index", "J", "C1", None, None, None, None), ("T", "check", "E", None, "", None, None, None)]


def test_impact_over_computed_columns(spark, tmp_path):
    """C1 -> C2 -> C3 -> C4 and what hangs on each; C10 and other tables are not touched."""
    columns = [("T", "C1", None), ("T", "C2", "[C1]*(2)"), ("T", "C3", "len(C2) + 'C10'"), ("T", "C4", "(C3 + [C2])"), ("T", "C10", "[X]"), ("U", "C2", "[C1]")]
    c, _, obj, got = _impact(spark, [("T", "c1")], columns, TOUCHED, tmp_path)
    assert got == {("T", "column", "c2", 1), ("T", "column", "c3", 2), ("T", "column", "c4", 2), ("T", "statistic", "S", 0), ("T", "index", "F", 1), ("T", "index", "I", 2), ("U", "foreign_key", "R", 2)}
    assert {r["name"] for r in drift.column_impact(c, obj).collect()} == {"S"}
    assert {r["name"] for r in drift.column_impact(c, obj, "substring").collect()} == {"S", "K"}


def test_impact_ends_on_a_cycle(spark, tmp_path):
    columns = [("T", "C1", "C2"), ("T", "C2", "C1")]
    assert _impact(spark, [("T", "C1")], columns, TOUCHED[:1], tmp_path)[3] == {("T", "column", "c2", 1)}
    assert _impact(spark, [], columns, TOUCHED, tmp_path / "none")[3] == set()
