"""Queries on drift between declared and live catalogs. The fleet's catalogs are derived
from lineitem and orders: every row stands for a column or an object somewhere, and a
database for every few suppliers or customers, so that the fleet grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import drift
from ..sources import tables as src
from . import common
from .common import derived, plain

NAMES = {"db": "database", "sch": "schema", "tab": "table", "col": "column"}
_WHO = "'d' || cast(floor(l_suppkey / 10) as int) as db, 'dbo' as sch, 'T' || (l_partkey % 40) as tab"
#: Columns: live ones and desired ones, which lack some, add others and change some.
LIVE_COLUMNS = f"select {_WHO}, 'C' || l_linenumber as col, case when max(l_partkey) % 3 = 0 then 'DECIMAL(10, 2)' else 'VARCHAR(' || (max(l_partkey) % 5) || ')' end as type, max(l_suppkey) % 2 = 0 as nullable, case when max(l_partkey) % 7 = 0 then 'C1*2' end as computed from {{lineitem}} where l_orderkey % 3 <> 0 group by 1, 2, 3, 4"
WANT_COLUMNS = f"select {_WHO}, 'C' || (l_linenumber + 1) as col, case when max(l_partkey) % 3 = 0 then 'DECIMAL(10,2)' else 'VARCHAR(' || (max(l_partkey) % 5) || ')' end as type, max(l_suppkey) % 2 = 0 as nullable, case when max(l_partkey) % 7 = 0 then 'C1*2' end as computed, case when min(l_partkey) % 4 = 0 then 'C' || l_linenumber end as old_name from {{lineitem}} where l_orderkey % 4 <> 0 and l_partkey % 40 < 35 group by 1, 2, 3, 4, l_linenumber"
#: Tables with owner, compression and former name.
LIVE_TABLES = "select 'd' || cast(floor(o_custkey / 150) as int) as db, 'dbo' as sch, 'T' || (o_orderkey % 40) as tab, case when max(o_custkey) % 5 = 0 then null when max(o_custkey) % 3 = 0 then 'other' else 'mine' end as owner, case when max(o_orderkey) % 2 = 0 then 'PAGE' else 'NONE' end as compression from {orders} where o_orderkey % 3 <> 0 and o_custkey % 7 <> 0 group by 1, 2, 3"
WANT_TABLES = "select 'd' || cast(floor(o_custkey / 150) as int) as db, 'dbo' as sch, 'T' || (o_orderkey % 40 + 5) as tab, case when max(o_custkey) % 2 = 0 then 'T' || (o_orderkey % 40) end as old_name, case when max(o_orderkey) % 3 = 0 then 'PAGE' end as compression from {orders} where o_custkey % 9 <> 0 group by 1, 2, 3, o_orderkey % 40"
#: Objects of several kinds with a signature, a column list or a text.
_OBJECT = "'d' || cast(floor(o_custkey / 150) as int) as db, 'dbo' as sch, 'T' || (o_orderkey % 40) as tab, case o_custkey % 5 when 0 then 'index' when 1 then 'check' when 2 then 'statistic' when 3 then 'xml_index' else 'foreign_key' end as kind"
#: Compression follows another order in live objects than in desired ones, so that some
#: indexes differ by it alone.
_REST = ("max(o_orderkey) % 7 = 0 as column_store, case when max(o_orderkey) % 7 = 0 then case when ({of}) % 2 = 0 then 'COLUMNSTORE_ARCHIVE' end when ({of}) % 5 = 0 then 'ROW' when ({of}) % 5 = 1 then 'PAGE' end as compression, case when max(o_custkey) % 5 = 1 then null else 'C' || (max(o_orderkey) % 9) || ',C' || (max(o_orderkey) % 4) || ' DESC' end as columns, case when max(o_custkey) % 5 = 1 then '([C' || (max(o_orderkey) % 9) || ']>(0))' end as definition, "
         "max(o_custkey) % 10 = 0 as clustered, max(o_orderkey) % 4 = 0 as is_unique, 'T' || (max(o_orderkey) % 30) as related, cast(max(o_orderkey) % 3 * 40 as int) as fill_factor, case when max(o_custkey) % 7 = 0 then null when max(o_custkey) % 4 = 0 then 'other' else 'mine' end as owner")
LIVE_OBJECTS = f"select {_OBJECT}, 'N' || (o_orderkey % 11) as name, {_REST.format(of='max(o_orderkey)')} from {{orders}} where o_orderkey % 3 <> 0 group by 1, 2, 3, 4, 5"
WANT_OBJECTS = f"select {_OBJECT}, 'N' || (o_orderkey % 13) as name, {_REST.format(of='max(o_orderkey) + max(o_custkey) % 7')} from {{orders}} where o_orderkey % 4 <> 0 group by 1, 2, 3, 4, 5"


def _frame(spark, d, sql):
    return derived(spark, d, sql).withColumnsRenamed(NAMES)


def _columns(spark, d):
    fill = {"persisted": "false", "sparse": "false", "mask": "cast(null as string)", "collation": "cast(null as string)"}
    return tuple(_frame(spark, d, s).withColumns({k: F.expr(v) for k, v in fill.items()}) for s in (WANT_COLUMNS, LIVE_COLUMNS))


def _tables(spark, d):
    return _frame(spark, d, WANT_TABLES), _frame(spark, d, LIVE_TABLES)


def _objects(spark, d):
    return _frame(spark, d, WANT_OBJECTS), _frame(spark, d, LIVE_OBJECTS)


K = ["database", "schema", "table"]
O = [*K, "kind", "name"]


def _flat(objects):
    """The objects of each kind with the fields of their definition."""
    of = {k: objects.where(F.col("kind") == k).withColumn("Name", F.col("name")) for k in ("index", "xml_index", "foreign_key", "check", "statistic")}
    return {
        "indexes": of["index"].select(*K, "Name", F.col("columns").alias("IndexColumns"), F.when(F.col("column_store"), F.split("columns", ",")[0]).alias("IncludeColumns"), F.col("is_unique").alias("Unique"), F.col("clustered").alias("Clustered"), F.col("column_store").alias("ColumnStore"), F.col("compression").alias("CompressionType")),
        "xml_indexes": of["xml_index"].select(*K, "Name", F.split("columns", ",")[0].alias("Column"), F.lit(True).alias("IsPrimary")),
        "foreign_keys": of["foreign_key"].select(*K, "Name", F.col("columns").alias("Columns"), F.lit("dbo").alias("RelatedTableSchema"), F.col("related").alias("RelatedTable"), F.col("columns").alias("RelatedColumns")),
        "checks": of["check"].select(*K, "Name", F.col("definition").alias("Expression")),
        "statistics": of["statistic"].select(*K, "Name", F.col("columns").alias("Columns")),
    }


def _signed(spark, d):
    return tuple(drift.signatures(_flat(x)) for x in _objects(spark, d))


def _documents(spark, d):
    cols = _frame(spark, d, WANT_COLUMNS).select(*K, F.col("column").alias("Name"), F.col("type").alias("DataType"))
    text = cols.groupBy(*K).agg(F.min("Name").alias("KeyIndex"), F.max("Name").alias("Columns"))
    return drift.catalog_to_definitions({"columns": cols, **_flat(_objects(spark, d)[0]), "text": text})


def _definitions(spark, d):
    """All definitions as a package: a file for each database, whose name stands for the schema."""
    docs = _documents(spark, d)
    named = F.replace("document", F.lit('"Schema":"dbo"'), F.concat(F.lit('"Schema":"'), F.col("database"), F.lit('"')))
    files = docs.groupBy("database").agg(F.concat(F.lit("["), F.array_join(F.collect_list(named), ","), F.lit("]")).alias("value"))
    path = common.work_dir(spark)
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return src.read_definitions(spark, path)


def read_definitions(spark, d):
    """The package, read file by file."""
    return _definitions(spark, d).select(F.col("Schema").alias("schema"), F.col("Name").alias("table"), F.size("Columns").alias("n_columns"))


def read_catalog(spark, d):
    live = _frame(spark, d, LIVE_COLUMNS)
    first = live.where("column = 'C1'")
    for schema, name in (("sys", "T30"), ("dbo", "sysdiagrams"), ("dbo", "MSpub_x"), ("dbo", "system_users")):
        live = live.unionByName(first.where("table = 'T30'").withColumns({"schema": F.lit(schema), "table": F.lit(name)}))
    only = derived(spark, d, "select 'DBO.t' || n_nationkey as name from {nation} union all select explode(array('t30', 'sysdiagrams', 'mspub_x', 'system_users'))")
    return src.read_catalog(live, only).select(*K, "column", "type")


def def_explode(spark, d):
    flat = drift.explode_definitions(_definitions(spark, d))
    show = {"columns": "DataType", "indexes": "concat_ws(' ', IndexColumns, Unique, Clustered)", "xml_indexes": "Column", "foreign_keys": "concat_ws(' ', Columns, RelatedTableSchema, RelatedTable, RelatedColumns)", "checks": "Expression", "statistics": "Columns"}
    out = flat["tables"].selectExpr("schema", "`table`", "'tables' as kind", "`table` as name", "concat_ws(' ', compression, temporal) as detail")
    for name, detail in show.items():
        out = out.unionByName(flat[name].selectExpr("schema", "`table`", f"'{name}' as kind", "Name as name", f"{detail} as detail"))
    return out.unionByName(flat["text"].selectExpr("schema", "`table`", "'text' as kind", "KeyIndex as name", "Columns as detail"))


NAMED = "select c_custkey, case c_custkey % 6 when 0 then ' [' || c_name || '] ' when 1 then '[[' || c_name || '] ]' when 2 then c_name when 3 then '[' || c_name when 4 then '[' || c_name || ']]' else '[a].[' || c_name || ']' end as name from {customer}"


def normalize_names(spark, d):
    df = derived(spark, d, NAMED)
    return df.select("c_custkey", normalize.strip_brackets(F.col("name")).alias("name"), normalize.bracketed(F.col("name")).alias("wrapped"))


EXPRESSIONS = "select o_orderkey, case o_orderkey % 6 when 0 then '(C' || o_custkey || ')' when 1 then '((C' || o_custkey || '>(0)))' when 2 then '(a)+(b' || o_custkey || ')' when 3 then '((a)+(b' || o_custkey || '))' when 4 then 'C' || o_custkey else '(((f(x)))=' || o_custkey || ')' end as e from {orders}"


def normalize_exprs(spark, d):
    return derived(spark, d, EXPRESSIONS).select("o_orderkey", normalize.strip_parens(F.col("e")).alias("e"))


def normalize_column_list(spark, d):
    df = derived(spark, d, "select o_orderkey, '[B' || (o_orderkey % 7) || '] DESC, ,[A], C' || (o_orderkey % 3) || ' asc' as l from {orders}")
    return df.select("o_orderkey", F.array_join(normalize.column_list(F.col("l")), ",").alias("keys"), F.array_join(normalize.column_list(F.col("l"), False), ",").alias("sorted"))


def type_string(spark, d):
    df = derived(spark, d, "select p_partkey, case p_partkey % 4 when 0 then 'varchar' when 1 then 'decimal' when 2 then 'datetime2' else 'int' end as base, case when p_size % 5 = 0 then -1 else p_size end as len, p_size as prec, p_size % 3 as scale from {part}")
    return df.select("p_partkey", normalize.type_string(F.col("base"), F.col("len"), F.col("prec"), F.col("scale")).alias("type"))


def new_tables(spark, d):
    return drift.new_tables(*_tables(spark, d)).select(*K)


def removed_objects(spark, d):
    want, live = _tables(spark, d)
    w, v = _objects(spark, d)
    tables = drift.removed_objects(live, want, K, "mine").select(*K, F.lit("table").alias("kind"), F.col("table").alias("name"))
    return tables.unionByName(drift.removed_objects(v.where("kind = 'index'"), w, O, "mine").select(*O))


def ownership_conflicts(spark, d):
    want, live = _tables(spark, d)
    return drift.ownership_conflicts(want, live, "mine")


def renamed_tables(spark, d):
    return drift.renamed(*_tables(spark, d), ["database", "schema"], "table")


def new_columns(spark, d):
    return drift.new_columns(*_columns(spark, d)).select(*K, "column")


def renamed_columns(spark, d):
    return drift.renamed(*_columns(spark, d), K, "column")


def removed_columns(spark, d):
    want, live = _columns(spark, d)
    return drift.removed_columns(live, want).select(*K, "column")


def changed_columns(spark, d):
    return drift.changed_columns(*_columns(spark, d)).select(*K, "column", F.array_join("reasons", ",").alias("reasons"), "must_recreate")


def signature_drift(spark, d):
    return drift.signature_drift(*_signed(spark, d))


def signature_renames(spark, d):
    return drift.signature_renames(*_signed(spark, d))


def unknown_objects(spark, d):
    want, live = _objects(spark, d)
    return drift.unknown_objects(live, want).select(*O)


def clustered_conflicts(spark, d):
    return drift.clustered_conflicts(*_objects(spark, d))


def column_impact(spark, d):
    return drift.column_impact(drift.changed_columns(*_columns(spark, d)), _objects(spark, d)[1])


#: Columns of which some are computed from the one before, so that they form chains.
CHAIN_COLUMNS = f"select {_WHO}, 'C' || l_linenumber as col, case when l_linenumber > 1 and max(l_partkey) % 3 <> 0 then '[c' || (l_linenumber - 1) || '] * 2 + len(''C7 is no column'')' end as computed, max(l_suppkey) % 4 = 0 and l_linenumber < 3 as changed from {{lineitem}} group by 1, 2, 3, 4, l_linenumber"
CHAIN_OBJECTS = ("select 'd' || cast(floor(l_suppkey / 10) as int) as db, 'dbo' as sch, 'T' || (l_partkey % 40) as tab, case l_suppkey % 3 when 0 then 'index' when 1 then 'check' else 'foreign_key' end as kind, 'N' || l_partkey as name, case when max(l_suppkey) % 3 <> 1 then 'C' || max(l_linenumber) || ', C1' || max(l_linenumber) || ' DESC' end as columns, "
                 "case when max(l_suppkey) % 3 = 1 then '([C' || max(l_linenumber) || ']>(0) OR C10 = ''x'')' end as definition, case when max(l_suppkey) % 3 = 2 then 'dbo' end as related_schema, case when max(l_suppkey) % 3 = 2 then 'T' || (max(l_orderkey) % 40) end as related_table, case when max(l_suppkey) % 3 = 2 then '[C' || min(l_linenumber) || ']' end as related_columns from {lineitem} group by 1, 2, 3, 4, 5")


def column_impact_chain(spark, d):
    columns = _frame(spark, d, CHAIN_COLUMNS)
    return drift.transitive_impact(columns.where("changed"), columns, _frame(spark, d, CHAIN_OBJECTS), common.work_dir(spark))


def _drops(spark, d, unknown):
    want, live = _objects(spark, d)
    return drift.index_drops(want, live, drift.signature_drift(*_signed(spark, d)), drift.changed_columns(*_columns(spark, d)), "mine", unknown)


def drop_set(spark, d):
    """What goes with unknown indexes and without them."""
    return _drops(spark, d, True).withColumn("drop_unknown", F.lit(True)).unionByName(_drops(spark, d, False).withColumn("drop_unknown", F.lit(False)))


def dependent_fks(spark, d):
    live = _objects(spark, d)[1]
    fks = live.where("kind = 'foreign_key'").select(*K, "name", F.lit("dbo").alias("related_schema"), F.col("related").alias("related_table"))
    return drift.dependent_fks(fks, live.where("kind = 'index'"), _drops(spark, d, False))


def storage_drift(spark, d):
    want, live = _objects(spark, d)
    return drift.storage_drift(want.where("kind = 'index'"), live.where("kind = 'index'"), *_tables(spark, d))


def catalog_to_defs(spark, d):
    """Every document, read again, with its children in their order."""
    out = _documents(spark, d).select(*K, F.from_json("document", src.DEFINITION).alias("j"))
    show = {"Columns": "x.Name || ' ' || x.DataType", "Indexes": "concat_ws(' ', x.Name, x.IndexColumns, x.Unique, x.Clustered)", "XmlIndexes": "concat_ws(' ', x.Name, x.Column, x.IsPrimary)",
            "ForeignKeys": "concat_ws(' ', x.Name, x.Columns, x.RelatedTable, x.RelatedColumns)", "CheckConstraints": "concat_ws(' ', x.Name, x.Expression)", "Statistics": "concat_ws(' ', x.Name, x.Columns)"}
    return out.selectExpr("database", "schema", "`table`", "j.FullTextIndex.KeyIndex as text_key", *[f"coalesce(array_join(transform(j.{k}, x -> {e}), ';'), '') as {k}" for k, e in show.items()])


PROPS_I = "select o_custkey as owner, 'p' || (o_orderkey % 4) as name, max(o_orderstatus) as value from {orders} where o_orderkey % 2 = 0 group by 1, 2"
PROPS_C = "select o_custkey as owner, 'p' || (o_orderkey % 6) as name, 'c' || max(o_orderstatus) as value from {orders} where o_orderkey % 3 = 0 group by 1, 2"


def properties_map(spark, d):
    out = drift.properties_map(derived(spark, d, PROPS_I), derived(spark, d, PROPS_C))
    return out.select("owner", F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("properties"))


def untagged_objects(spark, d):
    want, live = _tables(spark, d)
    return drift.untagged_objects(live, want).select(*K)


QUERIES = {f.__name__: f for f in (
    read_definitions, read_catalog, def_explode, normalize_names, normalize_exprs, normalize_column_list, type_string, new_tables, removed_objects, ownership_conflicts, renamed_tables, new_columns, renamed_columns,
    removed_columns, changed_columns, signature_drift, signature_renames, unknown_objects, clustered_conflicts, column_impact, column_impact_chain, drop_set, dependent_fks, storage_drift, catalog_to_defs, properties_map, untagged_objects)}

_SIGNATURE = "case kind when 'index' then case when column_store then case when clustered then 'all' else 'only ' || split_part(columns, ',', 1) end else columns end || ' ' || is_unique::varchar || ' ' || clustered::varchar || ' ' || coalesce(compression, case when column_store then 'COLUMNSTORE' else 'NONE' end) when 'xml_index' then split_part(columns, ',', 1) when 'foreign_key' then columns || ' ' || related when 'check' then definition else columns end as signature"
_WITH = f"with lc as ({plain(LIVE_COLUMNS)}), wc as ({plain(WANT_COLUMNS)}), lt as ({plain(LIVE_TABLES)}), wt as ({plain(WANT_TABLES)}), lo as (select *, {_SIGNATURE} from ({plain(LIVE_OBJECTS)})), wo as (select *, {_SIGNATURE} from ({plain(WANT_OBJECTS)})), "
_KEY = 'db as "database", sch as "schema", tab as "table"'


def _key(a):
    return f'{a}.db as "database", {a}.sch as "schema", {a}.tab as "table"'


def _same(a, b, *more):
    return " and ".join(f"{a}.{c} = {b}.{c}" for c in ("db", "sch", "tab", *more))


_TYPES = "replace(w.type, ', ', ',') <> replace(l.type, ', ', ',')"
_CHANGED = f"changed as (select w.db, w.sch, w.tab, w.col, concat_ws(',', case when {_TYPES} then 'type' end, case when w.nullable <> l.nullable then 'nullable' end, case when coalesce(w.computed, '') <> coalesce(l.computed, '') then 'computed' end) as reasons, coalesce(w.computed, '') <> coalesce(l.computed, '') as must_recreate from wc w join lc l on {_same('w', 'l', 'col')})"
_DRIFT = f"drifted as (select coalesce(w.db, l.db) as db, coalesce(w.sch, l.sch) as sch, coalesce(w.tab, l.tab) as tab, coalesce(w.kind, l.kind) as kind, coalesce(w.name, l.name) as name, case when l.name is null then 'added' when w.name is null then 'removed' when w.signature <> l.signature then 'changed' end as change from wo w full join lo l on {_same('w', 'l', 'kind', 'name')})"
_NO_WANT = f"not exists (select 1 from wo w where {_same('w', 'l', 'kind', 'name')})"
_LISTED = "list_contains(list_transform(string_split(o.columns, ','), lambda x: replace(x, ' DESC', '')), c.col)"
_OBJ = "l.db, l.sch, l.tab, l.kind, l.name"
_DROPS = (_CHANGED + ", " + _DRIFT + f", known as (select {_OBJ} from lo l where kind = 'index' and owner = 'mine' and {_NO_WANT} union select o.db, o.sch, o.tab, o.kind, o.name from lo o join changed c on {_same('o', 'c')} where o.kind = 'index' and c.reasons <> '' and {_LISTED} "
          f"union select {_OBJ} from drifted l where change = 'changed' and kind in ('index', 'xml_index')), every as (select true as drop_unknown, * from (select * from known union select {_OBJ} from lo l where kind in ('index', 'xml_index') and {_NO_WANT}) union all select false, * from known), "
          f"gone as (select * from every union select e.drop_unknown, {_OBJ} from lo l join every e on {_same('e', 'l')} join lo c on {_same('e', 'c', 'kind', 'name')} and c.clustered and c.kind = 'index' where l.kind = 'xml_index') ")
_TABLES = "(select distinct db, tab from wc)"


def _child(kind, detail, part):
    return f" union all select o.db, o.tab, '{kind}', o.name, {detail} from wo o join {_TABLES} t on t.db = o.db and t.tab = o.tab where o.kind = '{part}'"


def _listed(kind, detail):
    return f"(select coalesce(string_agg(concat_ws(' ', o.name, {detail}), ';' order by o.name), '') from wo o where o.kind = '{kind}' and {_same('o', 'c')})"


ORACLE_SQL = {
    "read_definitions": _WITH + "x as (select 1) select db as \"schema\", tab as \"table\", count(*)::int as n_columns from wc group by 1, 2",
    "read_catalog": _WITH + f"x as (select 1) select {_KEY}, col as \"column\", type from lc where tab in (select 'T' || n_nationkey from nation) or tab = 'T30' union all select db, sch, 'system_users', col, type from lc where tab = 'T30' and col = 'C1'",
    "def_explode": _WITH + "x as (select 1) select db as \"schema\", tab as \"table\", 'columns' as kind, col as name, type as detail from wc union all select db, tab, 'tables', tab, 'NONE false' from " + _TABLES + " union all select db, tab, 'text', min(col), max(col) from wc group by db, tab"
    + _child("indexes", "concat_ws(' ', o.columns, o.is_unique, o.clustered)", "index") + _child("xml_indexes", "split_part(o.columns, ',', 1)", "xml_index") + _child("foreign_keys", "concat_ws(' ', o.columns, 'dbo', o.related, o.columns)", "foreign_key")
    + _child("checks", "o.definition", "check") + _child("statistics", "o.columns", "statistic"),
    "normalize_names": "select c_custkey, name, '[' || name || ']' as wrapped from (select c_custkey, case c_custkey % 6 when 3 then '[' || c_name when 4 then c_name || ']' when 5 then 'a].[' || c_name else c_name end as name from customer)",
    "normalize_exprs": "select o_orderkey, case o_orderkey % 6 when 1 then 'C' || o_custkey || '>(0)' when 2 then '(a)+(b' || o_custkey || ')' when 3 then '(a)+(b' || o_custkey || ')' when 5 then '((f(x)))=' || o_custkey else 'C' || o_custkey end as e from orders",
    "normalize_column_list": "select o_orderkey, 'B' || (o_orderkey % 7) || ' DESC,A,C' || (o_orderkey % 3) as keys, 'A,B' || (o_orderkey % 7) || ' DESC,C' || (o_orderkey % 3) as sorted from orders",
    "type_string": "select p_partkey, case p_partkey % 4 when 0 then 'VARCHAR(' || case when p_size % 5 = 0 then 'MAX' else p_size::varchar end || ')' when 1 then 'DECIMAL(' || p_size || ', ' || (p_size % 3) || ')' when 2 then 'DATETIME2(' || (p_size % 3) || ')' else 'INT' end as type from part",
    "new_tables": _WITH + f"x as (select 1) select {_KEY} from wt w where not exists (select 1 from lt l where {_same('w', 'l')}) and not exists (select 1 from lt l where l.db = w.db and l.sch = w.sch and l.tab = w.old_name)",
    "removed_objects": _WITH + f"x as (select 1) select {_KEY}, 'table' as kind, tab as name from lt l where owner = 'mine' and not exists (select 1 from wt w where {_same('w', 'l')}) union all select db, sch, tab, kind, name from lo l where kind = 'index' and owner = 'mine' and {_NO_WANT}",
    "ownership_conflicts": _WITH + f"x as (select 1) select distinct {_key('l')}, l.owner from lt l join wt w on {_same('w', 'l')} where l.owner <> 'mine'",
    "renamed_tables": _WITH + f"x as (select 1) select db as \"database\", sch as \"schema\", old_name, tab as \"table\" from wt w where exists (select 1 from lt l where l.db = w.db and l.sch = w.sch and l.tab = w.old_name) and not exists (select 1 from lt l where {_same('w', 'l')})",
    "new_columns": _WITH + f"x as (select 1) select {_KEY}, col as \"column\" from wc w where exists (select 1 from lc l where {_same('w', 'l')}) and not exists (select 1 from lc l where {_same('w', 'l', 'col')})",
    "renamed_columns": _WITH + f"x as (select 1) select {_KEY}, old_name, col as \"column\" from wc w where exists (select 1 from lc l where {_same('w', 'l')} and l.col = w.old_name) and not exists (select 1 from lc l where {_same('w', 'l', 'col')})",
    "removed_columns": _WITH + f"x as (select 1) select {_KEY}, col as \"column\" from lc l where exists (select 1 from wc w where {_same('w', 'l')}) and not exists (select 1 from wc w where {_same('w', 'l', 'col')})",
    "changed_columns": _WITH + _CHANGED + f" select {_KEY}, col as \"column\", reasons, must_recreate from changed where reasons <> ''",
    "signature_drift": _WITH + _DRIFT + f" select {_KEY}, kind, name, change from drifted where change is not null",
    "signature_renames": _WITH + f"x as (select 1) select {_key('l')}, l.kind, l.name as old_name, max(n.name) as new_name from lo l join wo n on {_same('n', 'l', 'kind', 'signature')} where {_NO_WANT} and not exists (select 1 from lo l2 where {_same('n', 'l2', 'kind', 'name')}) group by 1, 2, 3, 4, 5",
    "unknown_objects": _WITH + f"x as (select 1) select {_KEY}, kind, name from lo l where {_NO_WANT}",
    "clustered_conflicts": _WITH + f"x as (select 1) select {_key('w')}, w.name, l.name as conflict from wo w join lo l on {_same('w', 'l')} and l.clustered where w.clustered and not exists (select 1 from lo l2 where {_same('w', 'l2', 'name')})",
    "column_impact": _WITH + _CHANGED + f" select distinct {_key('o')}, o.kind, o.name from lo o join changed c on {_same('o', 'c')} where c.reasons <> '' and (list_contains(list_transform(string_split(o.columns, ','), lambda x: replace(x, ' DESC', '')), c.col) or contains(o.definition, c.col))",
    "column_impact_chain": f"with recursive c as ({plain(CHAIN_COLUMNS)}), o as ({plain(CHAIN_OBJECTS)}), a as (select db, sch, tab, lower(col) as col, 0 as depth from c where changed union select c.db, c.sch, c.tab, lower(c.col), a.depth + 1 from c join a on c.db = a.db and c.sch = a.sch and c.tab = a.tab and starts_with(c.computed, '[' || a.col || '] ')), "
                           "m as (select db, sch, tab, col, min(depth) as depth from a group by 1, 2, 3, 4), h as (select o.db, o.sch, o.tab, kind, name, depth from o join m on o.db = m.db and o.sch = m.sch and o.tab = m.tab and (list_contains(list_transform(string_split(lower(o.columns), ','), lambda x: trim(replace(x, ' desc', ''))), m.col) or contains(lower(o.definition), '[' || m.col || ']') or (m.col = 'c10' and o.definition is not null)) "
                           "union all select o.db, o.sch, o.tab, kind, name, depth from o join m on o.db = m.db and o.related_schema = m.sch and o.related_table = m.tab and lower(o.related_columns) = '[' || m.col || ']' union all select db, sch, tab, 'column', col, depth from m where depth > 0) select db as \"database\", sch as \"schema\", tab as \"table\", kind, name, min(depth) as depth from h group by all",
    "drop_set": _WITH + _DROPS + f"select drop_unknown, {_KEY}, kind, name from gone",
    "dependent_fks": _WITH + _DROPS + f"select {_key('f')}, f.name from lo f where f.kind = 'foreign_key' and exists (select 1 from gone g join lo l on {_same('g', 'l', 'kind', 'name')} where not g.drop_unknown and g.kind = 'index' and l.is_unique and l.db = f.db and l.sch = 'dbo' and l.tab = f.related)",
    "storage_drift": _WITH + f"wi as (select *, coalesce(compression, case when column_store then 'COLUMNSTORE' else 'NONE' end) as c from wo where kind = 'index'), li as (select *, coalesce(compression, case when column_store then 'COLUMNSTORE' else 'NONE' end) as c from lo where kind = 'index'), "
                     f"i as (select {_key('w')}, w.name, w.c as want_compression, coalesce(nullif(w.fill_factor, 0), 100) as want_fill, l.c as have_compression, coalesce(nullif(l.fill_factor, 0), 100) as have_fill from wi w join li l on {_same('w', 'l', 'name')}), o as (select db, sch, tab, max(case when column_store then 'COLUMNSTORE' else c end) as over from wi where clustered group by 1, 2, 3), "
                     f"t as (select distinct {_key('w')}, null::varchar as name, coalesce(o.over, w.compression, 'NONE') as want_compression, 100 as want_fill, coalesce(l.compression, 'NONE') as have_compression, 100 as have_fill from wt w left join o on {_same('w', 'o')} join lt l on {_same('w', 'l')}), j as (select * from i union all select * from t where want_compression in ('NONE', 'ROW', 'PAGE')) select * from j where want_compression <> have_compression or want_fill <> have_fill",
    "catalog_to_defs": _WITH + f"x as (select 1) select {_key('c')}, min(c.col) as text_key, string_agg(c.col || ' ' || c.type, ';' order by c.col) as \"Columns\", {_listed('index', 'o.columns, o.is_unique, o.clustered')} as \"Indexes\", {_listed('xml_index', "split_part(o.columns, ',', 1), true")} as \"XmlIndexes\", {_listed('foreign_key', 'o.columns, o.related, o.columns')} as \"ForeignKeys\", {_listed('check', 'o.definition')} as \"CheckConstraints\", {_listed('statistic', 'o.columns')} as \"Statistics\" from wc c group by c.db, c.sch, c.tab",
    "properties_map": f"with i as ({plain(PROPS_I)}), c as ({plain(PROPS_C)}), b as (select coalesce(i.owner, c.owner) as owner, coalesce(i.name, c.name) as name, coalesce(i.value, c.value) as value from i full join c on i.owner = c.owner and i.name = c.name) select owner, string_agg(name || '=' || value, ';' order by name) as properties from b group by owner",
    "untagged_objects": _WITH + f"x as (select 1) select {_KEY} from lt l where owner is null and exists (select 1 from wt w where {_same('w', 'l')})",
}
