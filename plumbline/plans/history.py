"""Queries on row history, XML, JSON and text side tables, and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, ledger, temporal, text
from ..sources import layouts
from ..streaming import text_stream
from . import common
from .common import derived, plain, table
from .sync import KEYS, SOURCE, TARGET

AT = "2024-06-01 00:00:00"


def _days(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("ValidFrom", "ValidTo")})


def temporal_on(spark, d):
    current, past = temporal.on(table(spark, d, "nation"))
    return _days(current).withColumn("n_history", F.lit(past.count()))


def temporal_off(spark, d):
    return temporal.off(temporal.on(table(spark, d, "nation"))[0])


def _applied(spark, d):
    current, past = temporal.on(derived(spark, d, TARGET))
    return temporal.apply(current, past, derived(spark, d, SOURCE), KEYS, AT)


def temporal_apply(spark, d):
    current, past = _applied(spark, d)
    both = current.withColumn("part", F.lit("current")).unionByName(past.withColumn("part", F.lit("history")))
    return _days(both).select("part", "o_orderkey", "o_totalprice", "o_orderpriority", "ValidFrom", "ValidTo")


def temporal_versions(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return temporal.versions(events, "user_id", "ts", "event_id").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ValidFrom").cast("timestamp")).alias("from_us"), F.unix_micros(F.col("ValidTo").cast("timestamp")).alias("to_us"))


HOT = "select event_id, case when event_id % 10 < 9 then 1 else user_id end as user_id, ts from {events}"


def temporal_versions_hot(spark, d):
    """One user with nine tenths of the events, cut into slices."""
    out = temporal.versions(derived(spark, d, HOT), "user_id", "ts", "event_id", limit=500)
    return out.select("event_id", "user_id", F.unix_micros(F.col("ValidFrom").cast("timestamp")).alias("from_us"), F.unix_micros(F.col("ValidTo").cast("timestamp")).alias("to_us"))


def temporal_as_of(spark, d):
    current, past = _applied(spark, d)
    before, after = temporal.as_of(current, past, "2024-05-31 00:00:00"), temporal.as_of(current, past, "2024-06-02 00:00:00")
    return before.withColumn("at", F.lit("before")).unionByName(after.withColumn("at", F.lit("after"))).select("at", *KEYS, "o_totalprice", "o_orderpriority")


def temporal_alter(spark, d):
    wider = lambda df: df.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(20,2)").cast("string")).withColumn("note", F.lit(None).cast("string"))
    current, past = temporal.alter(*_applied(spark, d), wider)
    return current.unionByName(past).select("o_orderkey", "o_totalprice", "note")


PART_XML = "select p_partkey, to_xml(named_struct('name', p_name, 'brand', p_brand, 'size', p_size, 'tag', array(p_type, 'T' || p_size)), map('rowTag', 'part')) as doc from {part}"


def xml_nodes(spark, d):
    return documents.xml_nodes(derived(spark, d, PART_XML), "p_partkey", "doc", "name string, brand string, size int, tag array<string>, absent string")


def _layout(kind, where):
    return lambda spark, d: documents.xml_layout(xml_nodes(spark, d), kind, "p_partkey").where(where)


def xml_lookup(spark, d):
    """All nodes of the parts' documents stored by value, and by path and value; one lookup
    in each."""
    nodes, base = documents.xml_shred(derived(spark, d, NESTED_XML), "p_partkey", "doc"), common.work_dir(spark)
    # a layout reads its rows twice, for its ranges and to write them
    nodes.select("p_partkey", "node", "path", "value").write.parquet(f"{base}/nodes")
    nodes = spark.read.parquet(f"{base}/nodes")
    for kind in ("PATH", "VALUE"):
        order = [c for c in documents.LAYOUTS[kind] if c]
        layouts.store(nodes, f"{base}/{kind}", order, ["p_partkey", "node"], by_value=["value"], files=8)
    by_path = layouts.lookup(spark, f"{base}/PATH", "path", "/part/made/@by", "/part/made/@by", F.col("value") == "Brand#2")
    by_value = layouts.lookup(spark, f"{base}/VALUE", "value", "ECONOMY", "ECONOMY")
    return by_path.unionByName(by_value)


def json_entries(spark, d):
    return documents.json_entries(table(spark, d, "events"), "event_id", "props")


DEEP = "select event_id, to_json(named_struct('a', event_type, 'b', named_struct('c', event_id, 'd', array(user_id, 7)), 'n', cast(null as int))) as doc from {events}"


def json_flatten(spark, d):
    return documents.json_flatten(derived(spark, d, DEEP), "event_id", "doc", common.work_dir(spark))


#: Twelve levels, with an array in the middle.
DEEPER = "select event_id, '{{\"a\": ' || repeat('{{\"x\": ', 5) || '[7, {{\"t\": \"' || event_type || '\"}}, {{}}, null, ' || repeat('{{\"y\": ', 5) || event_id || repeat('}}', 5) || ']' || repeat('}}', 5) || ', \"b\": []}}' as doc from {events}"


def json_flatten_deep(spark, d):
    return documents.json_flatten(derived(spark, d, DEEPER), "event_id", "doc", common.work_dir(spark))


NESTED_XML = ("select p_partkey, '<part id=\"0' || p_partkey || '\"><name>' || p_name || '</name><made by=\"' || p_brand || '\"><size>0' || p_size || '</size>and <size unit=\"cm\">' || (p_size + 1) || '</size> too<deep><er><est>' || p_type || '</est></er></deep></made><none/>"
              "</part>' || case when p_partkey % 50 = 0 then '<more' else '' end as doc from {part}")


def xml_shred(spark, d):
    """Nested, repeated, mixed and attribute nodes, and documents that are not well-formed."""
    out = documents.xml_shred(derived(spark, d, NESTED_XML), "p_partkey", "doc")
    return out.withColumn("value", F.when(F.col("kind") != "fault", F.col("value")))


def text_postings(spark, d):
    out = text.text_index(table(spark, d, "documents"), "doc_id", ["text"], use_stop=False)
    return out.select("term", "doc_id", "n", F.element_at("positions", 1).alias("first"))


def text_stoplist(spark, d):
    stop = derived(spark, d, "select lower(n_name) as term from {nation} union all select 'the' union all select 'de'")
    return text.text_index(table(spark, d, "documents"), "doc_id", ["text"], stop).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


def text_multi_column(spark, d):
    return text.text_index(table(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], use_stop=False).select("term", "p_partkey", "column", "n")


def _texts(spark, d):
    old = table(spark, d, "documents").select("doc_id", "text")
    return old, old.where("doc_id % 6 = 0").withColumn("text", F.concat(F.lit("changed "), "text"))


def text_refresh_manual(spark, d):
    old, new = _texts(spark, d)
    out = text.refresh(text.text_index(old, "doc_id", ["text"], use_stop=False), new, "doc_id", ["text"], use_stop=False)
    return out.select("term", "doc_id", "n")


def text_refresh_stream(spark, d):
    """The documents as version 1; changed texts of some as version 3, each twice; and late
    ones of version 2, which lose. Folded after two of the three batches."""
    base = common.work_dir(spark)
    old, new = _texts(spark, d)
    first, again = old.withColumn("version", F.lit(1)), new.withColumn("version", F.lit(3))
    late = old.where("doc_id % 12 = 0").select("doc_id", F.lit("late").alias("text"), F.lit(2).alias("version"))
    for part in (first, again.unionByName(again), late):
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(first.schema).parquet(f"{base}/in")
        text_stream.keep_postings(stream, f"{base}/out", f"{base}/state", "doc_id", ["text"], fold=2).awaitTermination()
    return text_stream.read_postings(spark, f"{base}/out", "doc_id").select("term", "doc_id", "n")


INPUTS = "select 'C:\\\\pack\\\\in\\\\' || o_orderkey || '.sql' as path, 'p' || (o_custkey % 3) as product, 's' || (o_orderkey % 2) as slot, o_orderkey % 17 = 0 as always from {orders}"
LEDGER = "select 'in/' || o_orderkey || '.sql' as path, 'p' || (o_custkey % 3) as product, 's' || (o_orderkey % 2) as slot, cast('2024-01-01' as timestamp) as done_at from {orders} where o_orderkey % 3 = 0 union all select 'in/old' || c_custkey || '.sql', 'p' || (c_custkey % 5), 's0', cast('2024-01-01' as timestamp) from {customer}"


def _ledger(spark, d):
    return ledger.relative(derived(spark, d, INPUTS), "C:\\pack"), derived(spark, d, LEDGER)


def pending_inputs(spark, d):
    return ledger.pending(*_ledger(spark, d))


def record_inputs(spark, d):
    inputs, done = _ledger(spark, d)
    return ledger.record(done, inputs).select(*ledger.KEY)


def obsolete_entries(spark, d):
    inputs, done = _ledger(spark, d)
    return ledger.obsolete(done, inputs).select(*ledger.KEY)


QUERIES = {f.__name__: f for f in (temporal_on, temporal_off, temporal_apply, temporal_versions, temporal_versions_hot, temporal_as_of, temporal_alter, xml_nodes, xml_shred, xml_lookup, json_entries, json_flatten, json_flatten_deep, text_postings, text_stoplist, text_multi_column, text_refresh_manual, text_refresh_stream, pending_inputs, record_inputs, obsolete_entries)}
QUERIES |= {"xml_layout_path": _layout("PATH", "path = 'brand' and value = 'Brand#2'"), "xml_layout_value": _layout("VALUE", "value = 'ECONOMY'"), "xml_layout_property": _layout("PROPERTY", "p_partkey < 50")}

_T, _S = plain(TARGET), plain(SOURCE)
_DIFFERS = " or ".join(f"t.{c} is distinct from s.{c}" for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
_APPLIED = (f"with t as ({_T}), s as ({_S}), j as (select t.o_orderkey as tk, s.o_orderkey as sk, t.o_totalprice as tp, s.o_totalprice as sp, t.o_orderpriority as tq, s.o_orderpriority as sq, "
            f"t.o_orderkey is not null and s.o_orderkey is not null and not ({_DIFFERS}) as same from t full join s on t.o_orderkey = s.o_orderkey), "
            "a as (select 'current' as part, sk as o_orderkey, sp as o_totalprice, sq as o_orderpriority, case when same then '0001-01-01' else '2024-06-01' end as \"ValidFrom\", '9999-12-31' as \"ValidTo\" from j where sk is not null "
            "union all select 'history', tk, tp, tq, '0001-01-01', '2024-06-01' from j where tk is not null and not same) ")
_NODES = ("select p_partkey, 'name' as path, 1 as ordinal, p_name as value from part union all select p_partkey, 'brand', 1, p_brand from part union all select p_partkey, 'size', 1, p_size::varchar from part "
          "union all select p_partkey, 'tag', 1, p_type from part union all select p_partkey, 'tag', 2, 'T' || p_size from part")
_PIECES = "(select doc_id, unnest(w) as term, generate_subscripts(w, 1) - 1 as place from (select doc_id, regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+') as w from {rows}))"


_SHREDDED = [
    (0, "null", "element", "'part'", "/part", 1, "null"), (1, 0, "attribute", "'id'", "/part/@id", 1, "id"), (2, 0, "element", "'name'", "/part/name", 1, "p_name"), (3, 2, "text", "null", "/part/name", 1, "p_name"),
    (4, 0, "element", "'made'", "/part/made", 1, "'and too'"), (5, 4, "attribute", "'by'", "/part/made/@by", 1, "p_brand"), (6, 4, "element", "'size'", "/part/made/size", 1, "'0' || p_size"), (7, 6, "text", "null", "/part/made/size", 1, "'0' || p_size"),
    (8, 4, "text", "null", "/part/made", 1, "'and'"), (9, 4, "element", "'size'", "/part/made/size", 2, "(p_size + 1)::varchar"), (10, 9, "attribute", "'unit'", "/part/made/size/@unit", 1, "'cm'"), (11, 9, "text", "null", "/part/made/size", 1, "(p_size + 1)::varchar"),
    (12, 4, "text", "null", "/part/made", 2, "'too'"), (13, 4, "element", "'deep'", "/part/made/deep", 1, "null"), (14, 13, "element", "'er'", "/part/made/deep/er", 1, "null"), (15, 14, "element", "'est'", "/part/made/deep/er/est", 1, "p_type"),
    (16, 15, "text", "null", "/part/made/deep/er/est", 1, "p_type"), (17, 0, "element", "'none'", "/part/none", 1, "null")]


def _terms(rows="documents", text="text"):
    return _PIECES.format(rows=rows, text=text)


_REFRESHED = ("with r as (select doc_id, case when doc_id % 6 = 0 then 'changed ' || text else text end as text from documents) "
              "select term, doc_id, count(*) as n from " + _terms("r") + " where term <> ''{stop} group by 1, 2")
_INPUTS = "(select 'in/' || o_orderkey || '.sql' as path, 'p' || (o_custkey % 3) as product, 's' || (o_orderkey % 2) as slot, o_orderkey % 17 = 0 as always from orders)"
_LEDGER = f"({plain(LEDGER)})"
ORACLE_SQL = {
    "temporal_on": "select *, '0001-01-01' as \"ValidFrom\", '9999-12-31' as \"ValidTo\", 0 as n_history from nation",
    "temporal_off": "select * from nation",
    "temporal_apply": _APPLIED + "select * from a",
    "temporal_versions": "select event_id, user_id, event_type, epoch_us(ts) as from_us, coalesce(epoch_us(lead(ts) over (partition by user_id order by ts, event_id)), 253402300799999999) as to_us from events",
    "temporal_versions_hot": f"select event_id, user_id, epoch_us(ts) as from_us, coalesce(epoch_us(lead(ts) over (partition by user_id order by ts, event_id)), 253402300799999999) as to_us from ({plain(HOT)})",
    "temporal_as_of": f"with t as ({_T}), s as ({_S}) select 'before' as at, o_orderkey, o_totalprice, o_orderpriority from t union all select 'after', o_orderkey, o_totalprice, o_orderpriority from s",
    "temporal_alter": _APPLIED + "select o_orderkey, o_totalprice::decimal(20,2)::varchar as o_totalprice, null::varchar as note from a",
    "xml_nodes": _NODES,
    "xml_shred": "with p as (select p_partkey, p_name, p_brand, p_size, p_type, '0' || p_partkey as id, p_partkey % 50 = 0 as bad from part) select p_partkey, node::bigint as node, parent::bigint as parent, kind, name, path, ordinal, value from (" + " union all ".join(
        f"select p_partkey, {node} as node, {parent} as parent, '{kind}' as kind, {name} as name, '{path}' as path, {ordinal}::int as ordinal, {value} as value from p where not bad" for node, parent, kind, name, path, ordinal, value in _SHREDDED)
        + " union all select p_partkey, 0, null, 'fault', null, null, null, null from p where bad)",
    "xml_lookup": "select '/part/made/@by' as path, p_brand as value, p_partkey, 5::bigint as node from part where p_brand = 'Brand#2' and p_partkey % 50 <> 0 union all select '/part/made/deep/er/est', p_type, p_partkey, n from part, (values (15::bigint), (16::bigint)) t(n) where p_type = 'ECONOMY' and p_partkey % 50 <> 0",
    "json_flatten_deep": "select event_id, 'a.x.x.x.x.x.' || p as path, v as value from (select event_id, '0' as p, '7' as v from events union all select event_id, '1.t', event_type from events union all select event_id, '4.y.y.y.y.y', event_id::varchar from events)",
    "xml_layout_path": f"select * from ({_NODES}) where path = 'brand' and value = 'Brand#2'",
    "xml_layout_value": f"select * from ({_NODES}) where value = 'ECONOMY'",
    "xml_layout_property": f"select * from ({_NODES}) where p_partkey < 50",
    "json_entries": "select event_id, 'k' as name, json_extract_string(props, '$.k') as value, 'BIGINT' as type from events where json_extract(props, '$.k') is not null",
    "json_flatten": "select event_id, 'a' as path, event_type as value from events union all select event_id, 'b.c', event_id::varchar from events union all select event_id, 'b.d.0', user_id::varchar from events union all select event_id, 'b.d.1', '7' from events",
    "text_postings": "select term, doc_id, count(*) as n, min(place)::int as \"first\" from " + _terms() + " where term <> '' group by 1, 2",
    "text_stoplist": "select term, count(distinct doc_id) as n_docs, count(*) as n from " + _terms() + " where term <> '' and term not in (select lower(n_name) from nation) and term not in ('the', 'de') group by 1",
    "text_multi_column": "select term, p_partkey, \"column\", count(*) as n from (select p_partkey, \"column\", unnest(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+')) as term from (select p_partkey, 'p_name' as \"column\", p_name as t from part union all select p_partkey, 'p_brand', p_brand from part union all select p_partkey, 'p_type', p_type from part)) where term <> '' group by 1, 2, 3",
    "text_refresh_manual": _REFRESHED.replace("{stop}", ""),
    "text_refresh_stream": _REFRESHED.replace("{stop}", " and term not in (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"),
    "pending_inputs": f"select i.* from {_INPUTS} i where always or not exists (select 1 from {_LEDGER} l where l.path = i.path and l.product = i.product and l.slot = i.slot)",
    "record_inputs": f"select path, product, slot from {_LEDGER} union all select path, product, slot from {_INPUTS} i where not always and not exists (select 1 from {_LEDGER} l where l.path = i.path and l.product = i.product and l.slot = i.slot)",
    "obsolete_entries": f"select path, product, slot from {_LEDGER} l where exists (select 1 from {_INPUTS} i where l.product = i.product and l.slot = i.slot) and not exists (select 1 from {_INPUTS} i where l.path = i.path and l.product = i.product and l.slot = i.slot)",
}
