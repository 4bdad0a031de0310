"""Queries on conforming rows, on checks and on statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize
from ..operators import actions, checks, conform, stats, statstore
from . import common
from .common import derived, plain, table


def rename_columns(spark, d):
    return conform.rename_columns(table(spark, d, "nation"), {"n_name": "name", "n_regionkey": "n_nationkey", "no_such": "x"})


def union_same_template(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return conform.union_same({"even": c.where("c_custkey % 2 = 0"), "odd": c.where("c_custkey % 2 = 1").drop("c_name")})


def add_columns(spark, d):
    return conform.add_columns(table(spark, d, "region"), {"z": ("int", "r_regionkey * 2"), "a": ("string", None), "r_name": ("string", None)})


def drop_columns(spark, d):
    df = table(spark, d, "supplier").withColumns({"ValidFrom": F.lit("x"), "junk": F.lit(1)})
    return conform.drop_columns(df, ["s_suppkey", "s_name"], temporal=True)


MIXED = "select c_custkey, case when c_custkey % 3 = 0 then 'x' || c_custkey else cast(c_custkey as string) end as a, c_name as b, cast(c_custkey % 1000 as string) || '.' || case when c_custkey % 4 = 0 then '125' else '50' end as dec from {customer}"


def cast_columns(spark, d):
    return conform.cast_columns(derived(spark, d, MIXED), {"a": "int", "dec": "decimal(10, 3)"}).select("c_custkey", "a", "b", F.col("dec").cast("double").alias("dec"))


def computed_columns(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size")
    return conform.computed_columns(df, {"double_size": "p_size * 2", "label": "concat('P', p_partkey)"})


def identity_column(spark, d):
    df = derived(spark, d, "select c_custkey, case when c_custkey % 5 = 0 then c_custkey * 2 + 13 end as id from {customer}")
    return conform.identity_column(df, "id", ["c_custkey"], common.work_dir(spark), 13, 2)


def cast_failures(spark, d):
    df = derived(spark, d, "select c_custkey, a, case when c_custkey % 17 = 0 then null else b end as b, dec from (" + MIXED + ")")
    return conform.cast_failures(df, ["c_custkey"], {"a": {"type": "int", "nullable": False}, "b": {"length": 10, "nullable": False}, "dec": {"type": "decimal(10,2)"}})




def fill_defaults(spark, d):
    df = derived(spark, d, "select event_id, case when event_id % 3 = 0 then '{{\"id\":' || event_id || '}}' when event_id % 3 = 1 then '{{\"id\":' || event_id || ',\"a\":null}}' else '{{\"id\":' || event_id || ',\"a\":' || event_id || '}}' end as doc from {events}")
    return conform.fill_defaults(df, "doc", T._parse_datatype_string("struct<id:bigint,a:bigint>"), {"a": "-1"})


def sparse_report(spark, d):
    return conform.sparse_report(derived(spark, d, "select c_custkey, case when c_custkey % 4 = 0 then null else c_name end as c_name, case when c_custkey % 3 <> 0 then null else c_acctbal end as c_acctbal from {customer}"))


def collate_column(spark, d):
    df = derived(spark, d, "select case when p_partkey % 2 = 0 then upper(p_name) else p_name end as p_name from {part}")
    out = df.groupBy(normalize.collated(F.col("p_name"), "SQL_Latin1_General_CI_AS").alias("p_name")).agg(F.count("*").alias("n"))
    return out.select(F.lower(F.collate("p_name", "UTF8_BINARY")).alias("p_name"), "n")


def mask_column(spark, d):
    df = derived(spark, d, "select o_orderkey, o_orderpriority, o_totalprice, o_orderdate, o_orderstatus from {orders}")
    return df.select("o_orderkey", normalize.mask(F.col("o_orderpriority"), "email()", "string").alias("o_orderpriority"), normalize.mask(F.col("o_totalprice"), "default()", "double").alias("o_totalprice"),
                     F.date_format(normalize.mask(F.col("o_orderdate"), "default()", "timestamp_ntz"), "yyyy-MM-dd").alias("o_orderdate"), normalize.mask(F.col("o_orderstatus"), "default()", "string").alias("o_orderstatus"))


LI_KEY = ["l_orderkey", "l_linenumber"]


def pk_violations(spark, d):
    return checks.pk_violations(table(spark, d, "lineitem"), LI_KEY)


def unique_violations(spark, d):
    return checks.unique_violations(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


def unique_filtered_violations(spark, d):
    return checks.unique_violations(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus = 'P'")


def _some_orders(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 20 <> 0")


def fk_orphans(spark, d):
    child = derived(spark, d, "select case when l_orderkey % 30 = 0 then null else l_orderkey end as l_orderkey, l_linenumber, l_partkey from {lineitem}")
    return checks.fk_orphans(child, ["l_orderkey"], _some_orders(spark, d), ["o_orderkey"])


def fk_orphans_composite(spark, d):
    child = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    parent = table(spark, d, "lineitem").where("l_linenumber < 5").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"))
    return checks.fk_orphans(child, LI_KEY, parent, ["a", "b"])


STAFF = "select c_custkey as id, case when c_custkey % 10 = 0 then null else cast(floor(c_custkey / 3) as bigint) end as boss from {customer} where c_custkey % 23 <> 1"


def fk_self_orphans(spark, d):
    df = derived(spark, d, STAFF)
    return checks.fk_orphans(df, ["boss"], df, ["id"])


def check_violations(spark, d):
    return checks.check_violations(table(spark, d, "lineitem"), "l_quantity < 25 or l_discount > 0.02").select(*LI_KEY, "l_quantity", "l_discount")


def column_check_violations(spark, d):
    return checks.column_check_violations(table(spark, d, "part"), ["p_partkey"], {"p_size": "p_size < 40", "p_retailprice": "p_retailprice > 905", "p_brand": None})


def not_null_violations(spark, d):
    df = derived(spark, d, "select c_custkey, case when c_custkey % 4 = 0 then null else c_name end as c_name, case when c_custkey % 6 = 0 then null else c_acctbal end as c_acctbal from {customer}")
    return checks.not_null_violations(df, ["c_custkey"], ["c_name", "c_acctbal"])


def _gone(spark, d):
    return table(spark, d, "customer").where("c_custkey % 10 = 0")


def cascade_delete(spark, d):
    orders, lines = checks.cascade_delete(_gone(spark, d), [(table(spark, d, "orders"), "o_custkey", "c_custkey"), (table(spark, d, "lineitem"), "l_orderkey", "o_orderkey")])
    return orders.select(F.lit("orders").alias("tab"), F.col("o_orderkey").alias("k"), F.lit(0).alias("line")).unionByName(lines.select(F.lit("lineitem").alias("tab"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line")))


def cascade_delete_self(spark, d):
    df = derived(spark, d, STAFF)
    return checks.cascade_delete_self(df, "id", "boss", df.where("id in (2, 5)"), common.work_dir(spark))


def set_null_on_delete(spark, d):
    return checks.set_on_delete(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", _gone(spark, d), "c_custkey")


def set_default_on_delete(spark, d):
    return checks.set_on_delete(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", _gone(spark, d), "c_custkey", "-1")


def no_action_blockers(spark, d):
    return checks.no_action_blockers(_gone(spark, d), "c_custkey", table(spark, d, "orders"), "o_custkey")


def _deleted(outcome):
    """(tab, id, what, value) of all that happens."""
    rows = [df.select(F.lit(t).alias("tab"), F.col("id").cast("bigint").alias("id"), F.lit("delete").alias("what"), F.lit(None).cast("bigint").alias("value")) for t, df in outcome.deleted.items()]
    rows += [df.select(F.lit(r.child).alias("tab"), F.col("id").cast("bigint").alias("id"), F.lit(r.column).alias("what"), F.col("value").cast("bigint").alias("value")) for r, df in outcome.changed.items()]
    rows.append(outcome.blockers.select(F.col("reference").alias("tab"), F.col("id").cast("bigint").alias("id"), F.lit("blocks").alias("what"), F.lit(None).cast("bigint").alias("value")))
    return reduce(DataFrame.unionByName, rows)


def delete_actions(spark, d):
    """A nation goes: its customers, their orders and lines with it; suppliers lose it, the
    customers' events get customer 1, and lines by its suppliers elsewhere stand in the way."""
    tables = {t: table(spark, d, t) for t in ("nation", "customer", "supplier", "orders", "events")}
    tables["lineitem"] = derived(spark, d, "select l_orderkey * 100 + l_linenumber as id, l_orderkey, max(l_suppkey) as l_suppkey from {lineitem} group by 1, 2")
    ids = {"nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "events": "event_id", "lineitem": "id"}
    R = actions.Reference
    graph = [R("fk_customer", "customer", "c_nationkey", "nation", "n_nationkey", "CASCADE"), R("fk_supplier", "supplier", "s_nationkey", "nation", "n_nationkey", "SET NULL"), R("fk_orders", "orders", "o_custkey", "customer", "c_custkey", "CASCADE"),
             R("fk_lines", "lineitem", "l_orderkey", "orders", "o_orderkey", "CASCADE"), R("fk_events", "events", "user_id", "customer", "c_custkey", "SET DEFAULT", "cast(1 as bigint)"), R("fk_supplies", "lineitem", "l_suppkey", "supplier", "s_suppkey")]
    gone = {"nation": tables["nation"].where("n_nationkey = 3"), "supplier": tables["supplier"].where("s_nationkey = 3 and s_suppkey % 2 = 0")}
    return _deleted(actions.delete(tables, ids, graph, gone, common.work_dir(spark)))


#: Chains of four in a table, of orders and their lines that refer to each other in turn.
CYCLE_A = "select o_orderkey as id, case when o_orderkey % 4 <> 0 then o_orderkey - 1 end as before, o_custkey * 7 as b from {orders}"
CYCLE_B = "select c_custkey * 7 as id, case when c_custkey % 3 = 1 then (c_custkey * 13) % 500 end as a, case when c_custkey % 3 = 0 then 7 end as other from {customer}"


def delete_actions_cycle(spark, d):
    """Two tables that delete each other's rows, one of them also its own."""
    tables = {"a": derived(spark, d, CYCLE_A), "b": derived(spark, d, CYCLE_B)}
    R = actions.Reference
    graph = [R("own", "a", "before", "a", "id", "CASCADE"), R("a_b", "a", "b", "b", "id", "CASCADE"), R("b_a", "b", "a", "a", "id", "CASCADE"), R("b_b", "b", "other", "b", "id", "SET NULL")]
    return _deleted(actions.delete(tables, {"a": "id", "b": "id"}, graph, {"a": tables["a"].where("id in (1, 2, 17)"), "b": tables["b"].where("id = 7")}, common.work_dir(spark)))


def cascade_update(spark, d):
    moved = _gone(spark, d).select(F.col("c_custkey").alias("old"), F.when(F.col("c_custkey") % 20 != 0, F.col("c_custkey") + 1_000_000).alias("new"))
    return checks.cascade_update(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", moved, "old", "new")


def gate(spark, d):
    condition = table(spark, d, "orders").agg((F.count("*") > 0).alias("ok"))
    checks.gate(condition)
    return condition


def constraint_report(spark, d):
    lines = table(spark, d, "lineitem")
    keys = checks.constraint_report({("lineitem", "pk"): checks.pk_violations(lines, LI_KEY), ("lineitem", "fk_orders"): checks.fk_orphans(lines, ["l_orderkey"], _some_orders(spark, d), ["o_orderkey"]), ("orders", "uq_cust"): checks.unique_violations(table(spark, d, "orders"), ["o_custkey"])})
    rows = checks.row_report(lines, "lineitem", {"ck_quantity": "l_quantity < 25", "ck_discount": "l_discount <= 0.05"}, ["l_shipdate"])
    return keys.unionByName(rows)


def _single(**how):
    return lambda spark, d: stats.single(table(spark, d, "orders"), "o_custkey", **how)


def stats_multi(spark, d):
    return stats.multi(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"])


def stats_histogram(spark, d):
    """Of quantities, which repeat a lot."""
    return stats.histogram(table(spark, d, "lineitem"), "l_quantity", common.work_dir(spark), 8)


def stats_histogram_prices(spark, d):
    return stats.histogram(derived(spark, d, "select case when o_orderkey % 9 <> 0 then o_totalprice end as price from {orders}"), "price", common.work_dir(spark), 200)


KEPT = ["l_returnflag", "l_suppkey", "l_shipdate", "l_quantity"]


def stats_kept(spark, d):
    """Statistics by month of shipment: counted over an older table, then only for its
    changed months, with appended rows and a lost month, beside exact counts. Estimates
    are within four standard errors."""
    path, store = common.work_dir(spark), common.work_dir(spark)
    lines = derived(spark, d, "select *, date_format(l_shipdate, 'yyyy-MM') as month from {lineitem}").select("month", "l_orderkey", *KEPT)
    late, new = F.coalesce(F.col("month") >= "1996", F.lit(True)), F.col("l_orderkey") % 5 == 0
    extra = lines.where("l_orderkey % 50 = 1").withColumn("month", F.lit("2099-01"))
    lines.where(~new).unionByName(extra).repartition("month").write.partitionBy("month").parquet(f"{path}/before")
    lines.repartition("month").write.partitionBy("month").parquet(f"{path}/after")
    schema = lines.schema
    before, after = (spark.read.schema(schema).parquet(f"{path}/{x}") for x in ("before", "after"))
    by = ["month"]
    statstore.refresh(before, store, 0, by, KEPT)
    statstore.refresh(after, store, 1, by, KEPT, before.unionByName(after).where(late).select("month").distinct())
    statstore.absorb(after.where(~late & new), store, 2, by, KEPT)
    statstore.fold(spark, store, 3)
    kept = statstore.describe(statstore.live(spark, store), KEPT)
    exact = stats.multi(lines, KEPT).withColumnRenamed("n_distinct", "exact_prefix")
    values = lines.agg(*[F.countDistinct(c).alias(c) for c in KEPT]).unpivot([], KEPT, "column", "exact_distinct")
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= F.col(y) * F.lit(4 * statstore.error())
    return kept.join(exact, "prefix").join(values, "column").select("column", "prefix", "n_rows", "n_nulls", "low", "high", near("n_distinct", "exact_distinct").alias("near_distinct"), near("n_prefix", "exact_prefix").alias("near_prefix"))


QUERIES = {f.__name__: f for f in (
    stats_kept, rename_columns, union_same_template, add_columns, drop_columns, cast_columns, computed_columns, identity_column, cast_failures, fill_defaults, sparse_report, collate_column, mask_column,
    pk_violations, unique_violations, unique_filtered_violations, fk_orphans, fk_orphans_composite, fk_self_orphans, check_violations, column_check_violations, not_null_violations,
    cascade_delete, cascade_delete_self, set_null_on_delete, set_default_on_delete, no_action_blockers, delete_actions, delete_actions_cycle, cascade_update, gate, constraint_report, stats_multi, stats_histogram, stats_histogram_prices)}
QUERIES |= {"stats_single": _single(), "stats_filtered": _single(where="o_orderstatus = 'F'"), "stats_sampled": _single(sample=("o_orderkey", 20))}

_MIXED = common.plain(MIXED)
_STAFF = common.plain(STAFF)
_GONE = "(select c_custkey from customer where c_custkey % 10 = 0)"
_STATS = "select count(*) as n_rows, count(distinct o_custkey) as n_distinct, count(*) filter (o_custkey is null) as n_nulls, min(o_custkey) as low, max(o_custkey) as high from orders"
def _histogram(value, rows, steps):
    return (f"with v as (select {value} as high, count(*) as n_equal from {rows} where {value} is not null group by 1), c as (select *, sum(n_equal) over (order by high) as upto, sum(n_equal) over () as total from v) "
            f"select min(step)::int as step, high, (upto - n_equal)::bigint as n_below, n_equal from c, (select unnest(range(1, {steps + 1})) as step) where (total * step + {steps - 1}) // {steps} between upto - n_equal + 1 and upto group by high, upto, n_equal")


ORACLE_SQL = {
    "stats_histogram": _histogram("l_quantity", "lineitem", 8),
    "stats_histogram_prices": _histogram("price", "(select case when o_orderkey % 9 <> 0 then o_totalprice end as price from orders)", 200),
    "stats_kept": " union all ".join(f"select '{c}' as \"column\", {i + 1} as prefix, count(*) as n_rows, count(*) filter ({c} is null) as n_nulls, min({c})::varchar as low, max({c})::varchar as high, true as near_distinct, true as near_prefix from lineitem" for i, c in enumerate(KEPT)),
    "rename_columns": "select n_nationkey, n_name as name, n_regionkey from nation",
    "union_same_template": "select c_custkey, case when c_custkey % 2 = 0 then c_name end as c_name, case when c_custkey % 2 = 0 then 'even' else 'odd' end as database from customer",
    "add_columns": "select r_regionkey, r_name, null::varchar as a, r_regionkey * 2 as z from region",
    "drop_columns": "select s_suppkey, s_name, 'x' as \"ValidFrom\" from supplier",
    "cast_columns": f"select c_custkey, try_cast(a as int) as a, b, try_cast(dec as decimal(10, 3))::double as dec from ({_MIXED})",
    "computed_columns": "select p_partkey, p_size, p_size * 2 as double_size, 'P' || p_partkey as label from part",
    "identity_column": "with c as (select c_custkey, case when c_custkey % 5 = 0 then c_custkey * 2 + 13 end as id from customer) select c_custkey, id from c where id is not null union all select c_custkey, (select max(id) from c) + 2 * row_number() over (order by c_custkey) from c where id is null",
    "cast_failures": f"with m as (select c_custkey, a, case when c_custkey % 17 = 0 then null else b end as b, dec from ({_MIXED})) select c_custkey, 'a' as \"column\", a as value, 'cast' as reason from m where try_cast(a as int) is null union all select c_custkey, 'b', b, case when b is null then 'null' else 'length' end from m where b is null or length(b) > 10 union all select c_custkey, 'dec', dec, 'scale' from m where c_custkey % 4 = 0",
    "fill_defaults": "select event_id as id, case when event_id % 3 = 0 then -1 when event_id % 3 = 1 then null else event_id end as a from events",
    "sparse_report": "select 'c_custkey' as \"column\", count(*) as n_rows, 0::bigint as n_nulls from customer union all select 'c_name', count(*), count(*) filter (c_custkey % 4 = 0) from customer union all select 'c_acctbal', count(*), count(*) filter (c_custkey % 3 <> 0) from customer",
    "collate_column": "select lower(p_name) as p_name, count(*) as n from part group by 1",
    "mask_column": "select o_orderkey, left(o_orderpriority, 1) || 'XXX@XXXX.com' as o_orderpriority, case when o_totalprice is not null then 0.0::double end as o_totalprice, '1900-01-01' as o_orderdate, 'xxxx' as o_orderstatus from orders",
    "pk_violations": "select l_orderkey, l_linenumber, count(*) as n, 'repeated' as reason from lineitem group by 1, 2 having count(*) > 1",
    "unique_violations": "select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2 having count(*) > 1",
    "unique_filtered_violations": "select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1 having count(*) > 1",
    "fk_orphans": "select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey % 30 <> 0 and l_orderkey not in (select o_orderkey from orders where o_orderkey % 20 <> 0)",
    "fk_orphans_composite": "select l_orderkey, l_linenumber from lineitem a where not exists (select 1 from lineitem b where b.l_linenumber < 5 and a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber)",
    "fk_self_orphans": f"with s as ({_STAFF}) select id, boss from s where boss is not null and boss not in (select id from s)",
    "check_violations": "select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem where not (l_quantity < 25 or l_discount > 0.02)",
    "column_check_violations": "select p_partkey, 'p_size' as \"column\" from part where not p_size < 40 union all select p_partkey, 'p_retailprice' from part where not p_retailprice > 905",
    "not_null_violations": "select c_custkey, 'c_name' as \"column\" from customer where c_custkey % 4 = 0 union all select c_custkey, 'c_acctbal' from customer where c_custkey % 6 = 0",
    "cascade_delete": f"select 'orders' as tab, o_orderkey as k, 0 as line from orders where o_custkey in {_GONE} union all select 'lineitem', l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey in {_GONE})",
    "cascade_delete_self": f"with recursive s as ({_STAFF}), r as (select id from s where id in (2, 5) union select s.id from s join r on s.boss = r.id) select id, boss from s where id in (select id from r)",
    "set_null_on_delete": f"select o_orderkey, case when o_custkey in {_GONE} then null else o_custkey end as o_custkey from orders",
    "set_default_on_delete": f"select o_orderkey, case when o_custkey in {_GONE} then -1 else o_custkey end as o_custkey from orders",
    "no_action_blockers": f"select o_custkey as c_custkey, count(*) as n_children from orders where o_custkey in {_GONE} group by 1",
    "delete_actions": "with s as (select s_suppkey from supplier where s_nationkey = 3 and s_suppkey % 2 = 0), c as (select c_custkey from customer where c_nationkey = 3), o as (select o_orderkey from orders where o_custkey in (select c_custkey from c)), l as (select l_orderkey * 100 + l_linenumber as id, max(l_suppkey) as l_suppkey, l_orderkey in (select o_orderkey from o) as gone from lineitem group by l_orderkey, l_linenumber) "
                      "select 'nation' as tab, 3::bigint as id, 'delete' as what, null::bigint as value union all select 'supplier', s_suppkey, 'delete', null from s union all select 'customer', c_custkey, 'delete', null from c union all select 'orders', o_orderkey, 'delete', null from o union all select 'lineitem', id, 'delete', null from l where gone "
                      "union all select 'supplier', s_suppkey, 's_nationkey', null from supplier where s_nationkey = 3 and s_suppkey % 2 <> 0 union all select 'events', event_id, 'user_id', 1 from events where user_id in (select c_custkey from c) union all select 'fk_supplies', id, 'blocks', null from l where not gone and l_suppkey in (select s_suppkey from s) "
                      "union all select 'fk_events', event_id, 'blocks', null from events where user_id in (select c_custkey from c) and 1 in (select c_custkey from c)",
    "delete_actions_cycle": f"with recursive a as ({plain(CYCLE_A)}), b as ({plain(CYCLE_B)}), r as (select 'a' as tab, id from a where id in (1, 2, 17) union select 'b', id from b where id = 7 union select * from (select case k when 3 then 'b' else 'a' end as tab, case k when 1 then a.id when 2 then c.id else b.id end as id from r, (values (1), (2), (3)) t(k) left join a on k = 1 and r.tab = 'a' and a.before = r.id left join a c on k = 2 and r.tab = 'b' and c.b = r.id left join b on k = 3 and r.tab = 'a' and b.a = r.id) where id is not null) "
                            "select tab, id::bigint as id, 'delete' as what, null::bigint as value from r union all select 'b', id, 'other', null from b where other in (select id from r where tab = 'b') and id not in (select id from r where tab = 'b')",
    "cascade_update": f"select o_orderkey, case when o_custkey not in {_GONE} then o_custkey when o_custkey % 20 <> 0 then o_custkey + 1000000 end as o_custkey from orders",
    "gate": "select count(*) > 0 as ok from orders",
    "constraint_report": "select 'lineitem' as \"table\", 'pk' as \"constraint\", count(*) as n from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all select 'lineitem', 'fk_orders', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 20 <> 0) union all select 'lineitem', 'ck_quantity', count(*) from lineitem where not l_quantity < 25 union all select 'lineitem', 'ck_discount', count(*) from lineitem where not l_discount <= 0.05 union all select 'lineitem', 'l_shipdate', count(*) from lineitem where l_shipdate is null union all select 'orders', 'uq_cust', count(*) from (select 1 from orders group by o_custkey having count(*) > 1)",
    "stats_multi": "select 1 as prefix, count(distinct l_returnflag) as n_distinct from lineitem union all select 2, count(*) from (select distinct l_returnflag, l_linestatus from lineitem) union all select 3, count(*) from (select distinct l_returnflag, l_linestatus, l_suppkey from lineitem)",
    "stats_single": _STATS, "stats_filtered": _STATS + " where o_orderstatus = 'F'", "stats_sampled": _STATS + " where o_orderkey % 100 < 20",
}
