"""Queries on reading, writing and merging tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import merge
from ..sources import layouts
from ..sources import tables as src
from . import common
from .common import derived, plain, table

TARGET = "select * from {orders} where o_orderkey % 10 <> 0"
SOURCE = ("select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderdate, "
          "case when o_orderkey % 13 = 0 then null else o_orderpriority end as o_orderpriority from {orders} where o_orderkey % 11 <> 0")
KEYS = ["o_orderkey"]
ALL = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
WITH = f"with t as ({plain(TARGET)}), s as ({plain(SOURCE)}) "
DIFFERS = " or ".join(f"t.{c} is distinct from s.{c}" for c in ALL.split(", ")[1:])


def _both(spark, d):
    return derived(spark, d, TARGET), derived(spark, d, SOURCE)


def _merged(where=None, **how):
    def run(spark, d):
        t, s = _both(spark, d)
        return merge.merge(t, s, KEYS, where=where, **how)
    return run


def extract_filtered(spark, d):
    return src.extract(table(spark, d, "orders"), KEYS, "o_orderstatus = 'F' and o_totalprice > 100000")


def _customers(spark, d):
    return derived(spark, d, "select c_custkey, c_name, c_nationkey, c_acctbal, case when c_custkey % 7 = 0 then null else c_mktsegment end as c_mktsegment from {customer}")


def rows_to_json(spark, d):
    return src.to_json_rows(_customers(spark, d), ["c_custkey"])


def json_to_rows(spark, d):
    rows = src.to_json_rows(_customers(spark, d), ["c_custkey"])
    return src.from_json_rows(rows, "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string, c_phone string")


def geo_pair(spark, d):
    df = derived(spark, d, "select s_suppkey, case when s_suppkey % 5 <> 0 then named_struct('wkt', 'POINT (' || s_nationkey || ' ' || s_suppkey || ')', 'srid', 4326) end as place from {supplier}")
    back = src.geo_join(src.geo_split(df, "place"), "place")
    return back.select("s_suppkey", F.col("place.wkt").alias("wkt"), F.col("place.srid").alias("srid"))


def write_clustered(spark, d):
    path = common.work_dir(spark)
    src.write_clustered(table(spark, d, "orders"), path, ["o_orderdate DESC", "o_orderkey"], "PAGE")
    return spark.read.parquet(path)


def covering_projection(spark, d):
    return src.covering_projection(table(spark, d, "lineitem"), ["l_shipdate DESC", "l_orderkey"], ["l_quantity"], "l_returnflag = 'R'")


def covering_lookup(spark, d):
    """A narrow stored copy of returned lines, looked up by a month and a quantity."""
    path = common.work_dir(spark)
    layouts.store(table(spark, d, "lineitem"), path, ["l_shipdate DESC", "l_orderkey"], ["l_quantity"], "l_returnflag = 'R'", ["l_orderkey"], files=12)
    return layouts.lookup(spark, path, "l_shipdate", datetime(1995, 3, 1), datetime(1995, 3, 31), F.col("l_quantity") > 25)


def extract_many(spark, d):
    found = src.extract_many(spark, d, {"nation": {"keys": ["n_nationkey"]}, "region": {"keys": ["r_regionkey"], "where": "r_regionkey > 0"}, "no_such_table": {"keys": ["x"]}, "supplier": {"keys": ["s_suppkey"]}})
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, df in sorted(found.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def merge_actions(spark, d):
    return merge.diff(*_both(spark, d), KEYS)


def merge_insert_only(spark, d):
    return merge.insert_only(*_both(spark, d), KEYS)


def changed_rows(spark, d):
    return merge.changed(*_both(spark, d), KEYS)


TYPED_T = "select p_partkey, p_name, map('size', p_size, 'brand', length(p_brand)) as m, named_struct('wkt', 'P' || p_size, 'srid', 1) as g from {part}"
TYPED_S = "select p_partkey, p_name, map('brand', length(p_brand), 'size', case when p_partkey % 9 = 0 then p_size + 1 else p_size end) as m, named_struct('wkt', 'P' || p_size, 'srid', case when p_partkey % 4 = 0 then 2 else 1 end) as g from {part}"


def changed_rows_typed(spark, d):
    return merge.changed(derived(spark, d, TYPED_T), derived(spark, d, TYPED_S), ["p_partkey"]).select("p_partkey", "p_name")


PARTS = "year(o_orderdate) as o_year, month(o_orderdate) as o_month"


def _stored(spark, d):
    """The target as a table partitioned by month, and a source of one year that moves some
    orders by a month, deletes all of February and leaves out a column."""
    path = f"{common.work_dir(spark)}/orders"
    derived(spark, d, f"select *, {PARTS} from ({TARGET})").repartition("o_year", "o_month").write.partitionBy("o_year", "o_month").parquet(path)
    source = derived(spark, d, f"select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_year, case when o_orderkey % 17 = 0 then o_month % 12 + 1 else o_month end as o_month from (select *, {PARTS} from ({SOURCE})) where o_year = 1995 and o_month <> 2")
    return path, source


def merge_stored(spark, d):
    """The table after it, partition by partition rewritten only where rows change."""
    path, source = _stored(spark, d)
    merge.merge_stored(path, source, KEYS, ["o_year", "o_month"], common.work_dir(spark), delete_missing=True, where="o_year = 1995 and o_month < 5")
    return spark.read.parquet(path)


def merge_stored_counts(spark, d):
    """What was written in each partition that was touched."""
    path, source = _stored(spark, d)
    return merge.merge_stored(path, source, KEYS, ["o_year", "o_month"], common.work_dir(spark), delete_missing=True, where="o_year = 1995 and o_month < 5")


def merge_column_roles(spark, d):
    t, s = _both(spark, d)
    t = src.with_roles(t, {"o_totalprice": src.COMPUTED, "o_custkey": src.IDENTITY, "o_orderstatus": src.ROWGUID})
    use = merge.roles(t.schema)
    out = merge.merge(t.select(*use["insert"]), s.select(*use["read"]), KEYS, set_columns=use["update"])
    return out.select(*sorted(out.columns))


def merge_plan_counts(spark, d):
    return merge.plan_counts(merge.diff(*_both(spark, d), KEYS, where="o_orderstatus = 'F'"))


def merge_key_guard(spark, d):
    rows = derived(spark, d, "select case when l_orderkey % 50 = 0 then null else l_orderkey end as l_orderkey, l_linenumber from {lineitem}")
    return merge.key_guard(rows, ["l_orderkey", "l_linenumber"])


QUERIES = {
    "merge_actions": merge_actions, "extract_filtered": extract_filtered, "rows_to_json": rows_to_json, "json_to_rows": json_to_rows, "geo_pair": geo_pair,
    "write_clustered": write_clustered, "covering_projection": covering_projection, "covering_lookup": covering_lookup, "extract_many": extract_many,
    "merge_upsert": _merged(), "merge_insert_only": merge_insert_only, "merge_delete_scoped": _merged(delete=True, where="o_orderstatus = 'F'"),
    "changed_rows": changed_rows, "changed_rows_typed": changed_rows_typed, "merge_column_roles": merge_column_roles, "merge_plan_counts": merge_plan_counts, "merge_key_guard": merge_key_guard,
    "merge_stored": merge_stored, "merge_stored_counts": merge_stored_counts,
}

_JSON = "json_merge_patch('{}', to_json({c_acctbal: c_acctbal, c_custkey: c_custkey, c_mktsegment: case when c_custkey % 7 = 0 then null else c_mktsegment end, c_name: c_name, c_nationkey: c_nationkey}))"
_ACTION = "case when t.o_orderkey is null then 'insert' when s.o_orderkey is null then {gone} when " + DIFFERS + " then 'update' else 'keep' end"
_JOIN = " from t full join s on t.o_orderkey = s.o_orderkey"
_TAKE = ", ".join(f"case when s.o_orderkey is not null then s.{c} else t.{c} end as {c}" for c in ALL.split(", "))
_HELD = (f"with t as (select *, year(o_orderdate)::int as o_year, month(o_orderdate)::int as o_month from ({plain(TARGET)})), s as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_year, case when o_orderkey % 17 = 0 then o_month % 12 + 1 else o_month end as o_month "
         f"from (select *, year(o_orderdate)::int as o_year, month(o_orderdate)::int as o_month from ({plain(SOURCE)})) where o_year = 1995 and o_month <> 2) ")
_SET = "o_custkey o_orderstatus o_totalprice o_orderdate o_year o_month".split()
_MOVED = " or ".join(f"t.{c} is distinct from s.{c}" for c in _SET)
ORACLE_SQL = {
    "merge_stored": _HELD + "select coalesce(t.o_orderkey, s.o_orderkey) as o_orderkey, " + ", ".join(f"case when s.o_orderkey is not null then s.{c} else t.{c} end as {c}" for c in _SET) + ", t.o_orderpriority from t full join s on t.o_orderkey = s.o_orderkey where not (s.o_orderkey is null and t.o_year = 1995 and t.o_month < 5)",
    "merge_stored_counts": _HELD + ", j as (select t.o_year as ty, t.o_month as tm, s.o_year as sy, s.o_month as sm, case when t.o_orderkey is null then 'insert' when s.o_orderkey is null then 'delete' else 'update' end as action from t full join s on t.o_orderkey = s.o_orderkey where t.o_orderkey is null or (s.o_orderkey is null and t.o_year = 1995 and t.o_month < 5) or (s.o_orderkey is not null and (" + _MOVED + "))), "
    "p as (select ty as o_year, tm as o_month, case action when 'update' then 'left' else action end as action from j where action <> 'insert' union all select sy, sm, action from j where action <> 'delete') select o_year, o_month, count(*) filter (action = 'insert') as n_insert, count(*) filter (action = 'update') as n_update, count(*) filter (action = 'delete') as n_delete from p group by 1, 2",
    "extract_filtered": "select o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000",
    "rows_to_json": f"select c_custkey, {_JSON}::varchar as doc from customer",
    "json_to_rows": "select c_custkey, c_name, c_nationkey, case when c_custkey % 7 = 0 then null else c_mktsegment end as c_mktsegment, null::varchar as c_phone from customer",
    "geo_pair": "select s_suppkey, case when s_suppkey % 5 <> 0 then 'POINT (' || s_nationkey || ' ' || s_suppkey || ')' end as wkt, case when s_suppkey % 5 <> 0 then 4326 end as srid from supplier",
    "write_clustered": "select * from orders",
    "covering_projection": "select l_shipdate, l_orderkey, l_quantity from lineitem where l_returnflag = 'R'",
    "covering_lookup": "select l_shipdate, l_orderkey, l_quantity from lineitem where l_returnflag = 'R' and l_quantity > 25 and l_shipdate between timestamp '1995-03-01' and timestamp '1995-03-31'",
    "extract_many": "select 'nation' as name, count(*) as n_rows from nation union all select 'region', count(*) from region where r_regionkey > 0 union all select 'supplier', count(*) from supplier",
    "merge_actions": WITH + "select coalesce(t.o_orderkey, s.o_orderkey) as o_orderkey, " + _ACTION.format(gone="'delete'") + " as action" + _JOIN,
    "merge_upsert": WITH + f"select {_TAKE}" + _JOIN,
    "merge_insert_only": WITH + f"select {ALL} from t union all select {ALL} from s where o_orderkey not in (select o_orderkey from t)",
    "merge_delete_scoped": WITH + f"select {_TAKE}" + _JOIN + " where not (s.o_orderkey is null and t.o_orderstatus = 'F')",
    "changed_rows": WITH + f"select {', '.join('s.' + c for c in ALL.split(', '))} from t join s on t.o_orderkey = s.o_orderkey where {DIFFERS}",
    "changed_rows_typed": "select p_partkey, p_name from part where p_partkey % 9 = 0 or p_partkey % 4 = 0",
    "merge_column_roles": WITH + "select case when t.o_orderkey is not null then t.o_custkey else s.o_custkey end as o_custkey, case when s.o_orderkey is not null then s.o_orderdate else t.o_orderdate end as o_orderdate, coalesce(t.o_orderkey, s.o_orderkey) as o_orderkey, case when s.o_orderkey is not null then s.o_orderpriority else t.o_orderpriority end as o_orderpriority" + _JOIN,
    "merge_plan_counts": WITH + "select action, count(*) as n from (select " + _ACTION.format(gone="case when t.o_orderstatus = 'F' then 'delete' else 'keep' end") + " as action" + _JOIN + ") group by action",
    "merge_key_guard": "with s as (select case when l_orderkey % 50 = 0 then null else l_orderkey end as l_orderkey, l_linenumber from lineitem) select l_orderkey, l_linenumber, count(*) as n, case when l_orderkey is null or l_linenumber is null then 'null' else 'repeated' end as reason from s group by 1, 2 having count(*) > 1 or l_orderkey is null or l_linenumber is null",
}
