"""Drift between declared and live catalogs of a whole fleet, one job for all databases.

Objects are keyed by database, schema, table (and name). Frames hold normalised names
and expressions; `normalize` gives them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import column_list, strip_brackets, strip_parens

TABLE = ["database", "schema", "table"]


def normalize(df: DataFrame, names: list[str] = (), expressions: list[str] = ()) -> DataFrame:
    return df.withColumns({c: strip_brackets(F.col(c)) for c in names} | {c: strip_parens(F.col(c)) for c in expressions})


def explode_definitions(defs: DataFrame) -> dict[str, DataFrame]:
    """Definition documents as flat frames: tables, each kind of child and the columns'
    defaults; with the documents' database, if they have one."""
    keys = [c for c in TABLE if c != "database" or c in defs.columns]
    who = [F.col(c) for c in keys if c == "database"]
    who += [strip_brackets(F.coalesce("Schema", F.lit("dbo"))).alias("schema"), strip_brackets(F.col("Name")).alias("table")]
    out = {"tables": defs.select(*who, strip_brackets(F.col("OldName")).alias("old_name"), F.coalesce("CompressionType", F.lit("NONE")).alias("compression"), F.coalesce("IsTemporal", F.lit(False)).alias("temporal"))}
    for name, field in CHILDREN.items():
        out[name] = defs.select(*who, F.explode(field).alias("x")).select(*keys, "x.*").withColumn("Name", strip_brackets(F.col("Name")))
    out["defaults"] = out["columns"].where(F.col("Default").isNotNull()).select(*keys, "Name", F.col("Default").alias("Expression"))
    out["text"] = defs.where("FullTextIndex is not null").select(*who, "FullTextIndex.*")
    return out


def new_tables(desired: DataFrame, live: DataFrame) -> DataFrame:
    """Desired tables that live has under neither name."""
    have = live.select(*TABLE)
    old = have.withColumnRenamed("table", "old_name")
    return desired.join(have, TABLE, "left_anti").join(old, ["database", "schema", "old_name"], "left_anti").select(*desired.columns)


def removed_objects(live: DataFrame, desired: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Live objects of this owner that are not desired any more."""
    return live.where(F.col("owner") == owner).join(desired.select(*keys), keys, "left_anti")


def ownership_conflicts(desired: DataFrame, live: DataFrame, owner: str) -> DataFrame:
    return desired.select(*TABLE).distinct().join(live.where(F.col("owner") != owner).select(*TABLE, "owner"), TABLE)


def renamed(desired: DataFrame, live: DataFrame, scope: list[str], name: str) -> DataFrame:
    """Desired objects with an old name that is live while the new one is not."""
    have = live.select(*scope, name)
    has_old = desired.where(F.col("old_name").isNotNull()).join(have.withColumnRenamed(name, "old_name"), [*scope, "old_name"], "left_semi")
    return has_old.join(have, [*scope, name], "left_anti").select(*scope, "old_name", name)


def new_columns(desired: DataFrame, live: DataFrame) -> DataFrame:
    """Desired columns that existing tables lack."""
    return desired.join(live.select(*TABLE).distinct(), TABLE, "left_semi").join(live.select(*TABLE, "column"), [*TABLE, "column"], "left_anti")


def removed_columns(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Columns of desired tables that are live only, but for period columns."""
    own = live.join(desired.select(*TABLE).distinct(), TABLE, "left_semi").where(~F.col("column").isin("ValidFrom", "ValidTo"))
    return own.join(desired.select(*TABLE, "column"), [*TABLE, "column"], "left_anti")


#: Compared attributes, what their absence means, and whether a change makes the column anew.
ATTRIBUTES = {"type": ("", False), "nullable": (False, False), "computed": ("", True), "persisted": (False, True), "sparse": (False, False), "mask": ("", False), "collation": ("", False)}


def changed_columns(desired: DataFrame, live: DataFrame) -> DataFrame:
    """(table, column, reasons, must_recreate); collation IGNORE in desired is no reason."""
    reasons = []
    for name, (absent, _) in ATTRIBUTES.items():
        d, v = F.coalesce(F.col(f"d.{name}"), F.lit(absent)), F.coalesce(F.col(f"l.{name}"), F.lit(absent))
        if name == "type":
            d, v = F.replace(d, F.lit(", "), F.lit(",")), F.replace(v, F.lit(", "), F.lit(","))
        differs = (d != v) & (F.upper(d) != "IGNORE") if name == "collation" else d != v
        reasons.append(F.when(differs, F.lit(name)))
    on = [F.col(f"d.{k}") == F.col(f"l.{k}") for k in (*TABLE, "column")]
    out = desired.alias("d").join(live.alias("l"), on).select(*[F.col(f"d.{k}") for k in (*TABLE, "column")], F.array_compact(F.array(*reasons)).alias("reasons"))
    again = F.array(*[F.lit(n) for n, (_, anew) in ATTRIBUTES.items() if anew])
    return out.where(F.size("reasons") > 0).withColumn("must_recreate", F.arrays_overlap("reasons", again))


OBJECT = [*TABLE, "kind", "name"]

#: The kind of each frame's objects, and the fields of their signature with the spelling
#: in which they are compared.
SIGNED = {
    "indexes": ("index", {"IndexColumns": "list", "IncludeColumns": "set", "FilterExpression": "expression", "Unique": "flag", "PrimaryKey": "flag", "UniqueConstraint": "flag", "Clustered": "flag", "ColumnStore": "flag", "CompressionType": "word"}),
    "xml_indexes": ("xml_index", {"Column": "name", "IsPrimary": "flag", "PrimaryIndex": "name", "SecondaryIndexType": "word"}),
    "foreign_keys": ("foreign_key", {"Columns": "list", "RelatedTableSchema": "name", "RelatedTable": "name", "RelatedColumns": "list", "DeleteAction": "action", "UpdateAction": "action"}),
    "checks": ("check", {"Expression": "expression"}),
    "defaults": ("default", {"Expression": "expression"}),
    "statistics": ("statistic", {"Columns": "list", "FilterExpression": "expression"}),
    "text": ("text_index", {"FullTextCatalog": "name", "KeyIndex": "name", "ChangeTracking": "word", "StopList": "name", "Columns": "set"}),
}
_SPELL = {
    "list": lambda c: F.array_join(column_list(c), ","),
    "set": lambda c: F.array_join(column_list(c, False), ","),
    "expression": strip_parens,
    "name": strip_brackets,
    "flag": lambda c: F.coalesce(c, F.lit(False)).cast("string"),
    "action": lambda c: F.upper(F.coalesce(c, F.lit("NO ACTION"))),
    "word": F.upper,
}


#: Compressions of tables and of indexes over rows, and of columnstore indexes; the first of
#: each is what an index has that declares none.
ROWS, COLUMNSTORE = ("NONE", "ROW", "PAGE"), ("COLUMNSTORE", "COLUMNSTORE_ARCHIVE")


def index_compression(declared: Column, columnstore: Column) -> Column:
    """The compression of an index of that form; null where the form cannot have the one
    declared, which then differs from any that a live index has."""
    word = F.upper(F.nullif(F.trim(declared), F.lit("")))
    store = F.coalesce(word, F.lit(COLUMNSTORE[0]))
    rows = F.coalesce(word, F.lit(ROWS[0]))
    return F.when(columnstore, F.when(store.isin(*COLUMNSTORE), store)).when(rows.isin(*ROWS), rows)


def index_form(df: DataFrame) -> DataFrame:
    """Indexes with the fields that count for their form: a columnstore index has no keys, a
    clustered one covers all columns, and each form has its own compressions."""
    types = {"IndexColumns": "string", "IncludeColumns": "string", "Clustered": "boolean", "ColumnStore": "boolean", "CompressionType": "string"}
    value = {c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in types.items()}
    store, clustered = (F.coalesce(value[c], F.lit(False)) for c in ("ColumnStore", "Clustered"))
    return df.withColumns({"IndexColumns": F.when(~store, value["IndexColumns"]), "IncludeColumns": F.when(~(store & clustered), value["IncludeColumns"]), "CompressionType": index_compression(value["CompressionType"], store)})


def signatures(flat: dict[str, DataFrame]) -> DataFrame:
    """(table, kind, name, signature) of all objects of flat frames as explode_definitions
    makes them, however names, lists and expressions are spelled. A field that a frame
    lacks counts as null; a text index, of which a table has one, is named `text`. An index
    whose compression differs is another one, as it is dropped and made again."""
    if "indexes" in flat:
        flat = flat | {"indexes": index_form(flat["indexes"])}

    def signed(df: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
        def part(name: str, how: str) -> Column:
            value = F.col(name) if name in df.columns else F.lit(None).cast("boolean" if how == "flag" else "string")
            return F.concat(F.lit(f"{name}="), F.coalesce(_SPELL[how](value), F.lit("")))

        name = F.col("Name") if "Name" in df.columns else F.lit("text")
        return df.select(*[c for c in TABLE if c in df.columns], F.lit(kind).alias("kind"), name.alias("name"), F.concat_ws(";", *[part(*x) for x in fields.items()]).alias("signature"))

    return reduce(DataFrame.unionByName, [signed(flat[name], *SIGNED[name]) for name in SIGNED if name in flat])


def signature_drift(desired: DataFrame, live: DataFrame) -> DataFrame:
    """(object, change): added, removed or changed by signature, of all kinds at once."""
    on = [F.col(f"d.{k}") == F.col(f"l.{k}") for k in OBJECT]
    both = desired.alias("d").join(live.alias("l"), on, "full_outer")
    change = F.when(F.col("l.name").isNull(), "added").when(F.col("d.name").isNull(), "removed").when(~F.col("d.signature").eqNullSafe(F.col("l.signature")), "changed")
    return both.select(*[F.coalesce(f"d.{k}", f"l.{k}").alias(k) for k in OBJECT], change.alias("change")).where("change is not null")


def signature_renames(desired: DataFrame, live: DataFrame) -> DataFrame:
    """(table, kind, old_name, new_name) of equal signatures under names of which the old
    is not desired and the new not live; one new name per old one."""
    scope = [*TABLE, "kind"]
    gone = live.join(desired.select(*OBJECT), OBJECT, "left_anti").select(*scope, "signature", F.col("name").alias("old_name"))
    fresh = desired.join(live.select(*OBJECT), OBJECT, "left_anti").select(*scope, "signature", F.col("name").alias("new_name"))
    return gone.join(fresh, [*scope, "signature"]).groupBy(*scope, "old_name").agg(F.max("new_name").alias("new_name"))


def unknown_objects(live: DataFrame, desired: DataFrame) -> DataFrame:
    return live.join(desired.select(*OBJECT), OBJECT, "left_anti")


def clustered_conflicts(desired: DataFrame, live: DataFrame) -> DataFrame:
    """(table, name, conflict): a clustered key that is missing while another is there."""
    wanted = desired.where("clustered").join(live.select(*TABLE, "name"), [*TABLE, "name"], "left_anti").select(*TABLE, "name")
    return wanted.join(live.where("clustered").select(*TABLE, F.col("name").alias("conflict")), TABLE)


#: String literals, which name no column, and what can name one.
LITERAL, IDENTIFIER = "'[^']*'", r"\[[^\]]+\]|[A-Za-z_@#][A-Za-z0-9_@#$]*"


def identifiers(expression: Column) -> Column:
    """The distinct names in an expression, in lower case and without brackets."""
    names = F.regexp_extract_all(F.regexp_replace(expression, LITERAL, " "), F.lit(IDENTIFIER), F.lit(0))
    return F.array_distinct(F.transform(names, lambda x: F.lower(F.btrim(x, F.lit("[]")))))


def column_impact(changed: DataFrame, objects: DataFrame, mode: str = "identifier") -> DataFrame:
    """Objects that changed columns touch, by their column list, by an expression that names
    the column, or, as foreign keys (related_schema, related_table, related_columns), by
    what they refer to. Lists and expressions are split once and joined by equality, so
    C1 does not find C10; mode `substring` asks for any text that holds the name."""
    names = F.lower("column")
    c = changed.select(*TABLE, names.alias("column")).distinct()

    def listed(table: list[str], text: str) -> DataFrame:
        own = objects.where(F.col(text).isNotNull()).select(*[F.col(t).alias(f"{o}_") for t, o in zip(table, TABLE)], *OBJECT, F.explode(column_list(F.col(text))).alias("column"))
        own = own.withColumn("column", F.lower(F.regexp_replace("column", " DESC$", "")))
        return own.join(c.select(*[F.col(t).alias(f"{t}_") for t in TABLE], "column"), [*[f"{t}_" for t in TABLE], "column"], "left_semi").select(*OBJECT)

    found = listed(TABLE, "columns")
    if "related_columns" in objects.columns:
        found = found.unionByName(listed(["database", "related_schema", "related_table"], "related_columns"))
    texts = objects.where("definition is not null").select(*OBJECT, "definition")
    if mode == "substring":
        hits = texts.join(c, TABLE).where(F.contains(F.lower("definition"), F.col("column")))
    else:
        hits = texts.withColumn("column", F.explode(identifiers(F.col("definition")))).join(c, [*TABLE, "column"], "left_semi")
    return found.unionByName(hits.select(*OBJECT)).distinct()


def affected_columns(changed: DataFrame, columns: DataFrame, work: str) -> DataFrame:
    """(table, column, depth): changed columns (0) and computed ones of the same table that
    name one of them, directly (1) or over others. Expressions are split once; each round
    joins what the one before found, and is written under work. Names are lower-cased."""
    spark = changed.sparkSession
    edges = columns.where("computed is not null").select(*TABLE, F.lower("column").alias("to"), F.explode(identifiers(F.col("computed"))).alias("column"))
    edges.write.parquet(f"{work}/edges")
    edges = spark.read.schema(edges.schema).parquet(f"{work}/edges")
    front, depth, paths = changed.select(*TABLE, F.lower("column").alias("column")).distinct().withColumn("depth", F.lit(0)), 0, []
    while True:
        front.write.parquet(path := f"{work}/{depth}")
        front = spark.read.schema(front.schema).parquet(path)
        if front.isEmpty():
            return seen if paths else front
        paths.append(path)
        seen, depth = spark.read.schema(front.schema).parquet(*paths), depth + 1
        front = edges.join(front, [*TABLE, "column"]).select(*TABLE, F.col("to").alias("column")).distinct().join(seen, [*TABLE, "column"], "left_anti").withColumn("depth", F.lit(depth))


def transitive_impact(changed: DataFrame, columns: DataFrame, objects: DataFrame, work: str) -> DataFrame:
    """Objects that changed columns touch themselves or through computed columns, those
    computed columns with kind `column`, by the least depth. An index on a computed column
    over a changed one has depth 1."""
    affected = affected_columns(changed, columns, work)
    own = affected.where("depth > 0").select(*TABLE, F.lit("column").alias("kind"), F.col("column").alias("name"), "depth")
    levels = [r[0] for r in affected.select("depth").distinct().collect()]
    each = [column_impact(affected.where(F.col("depth") == n), objects).withColumn("depth", F.lit(n)) for n in levels]
    return reduce(DataFrame.unionByName, [own, *each]).groupBy(*OBJECT).agg(F.min("depth").alias("depth"))


def drop_set(reasons: list[DataFrame], xml_indexes: DataFrame | None = None, clustered: DataFrame | None = None) -> DataFrame:
    """Distinct objects to drop for any reason; with them the XML indexes of tables whose
    clustered key goes."""
    out = reduce(DataFrame.unionByName, [r.select(*OBJECT) for r in reasons]).distinct()
    if xml_indexes is None:
        return out
    tables = out.join(clustered.select(*OBJECT), OBJECT, "left_semi").select(*TABLE).distinct()
    more = xml_indexes.select(*OBJECT).join(tables, TABLE, "left_semi").join(out, OBJECT, "left_anti")
    return out.unionByName(more.select(*OBJECT))


def index_drops(desired: DataFrame, live: DataFrame, drifted: DataFrame, changed: DataFrame, owner: str, drop_unknown: bool = True) -> DataFrame:
    """Distinct indexes and XML indexes to drop. Indexes go that the owner has and desires no
    more, and those on changed columns; of both kinds those that drifted (object, change) by
    signature and, if asked for, those that are not desired at all; and XML indexes of tables
    whose clustered index goes."""
    index, xml = (live.where(F.col("kind") == k) for k in ("index", "xml_index"))
    both = F.col("kind").isin("index", "xml_index")
    reasons = [removed_objects(index, desired, OBJECT, owner), column_impact(changed, index), drifted.where(both & (F.col("change") == "changed"))]
    if drop_unknown:
        reasons.append(unknown_objects(live.where(both), desired))
    return drop_set(reasons, xml, index.where("clustered"))


def dependent_fks(fks: DataFrame, indexes: DataFrame, dropped: DataFrame) -> DataFrame:
    """Foreign keys(database, schema, table, name, related_schema, related_table) that refer
    to a table which loses an index (object, is_unique), be it a constraint's or unique."""
    gone = indexes.where("is_unique").join(dropped, OBJECT, "left_semi").select("database", F.col("schema").alias("related_schema"), F.col("table").alias("related_table"))
    return fks.join(gone.distinct(), ["database", "related_schema", "related_table"], "left_semi").select(*TABLE, "name")


def storage_drift(desired: DataFrame, live: DataFrame, tables: DataFrame, live_tables: DataFrame) -> DataFrame:
    """Indexes and (without a name) tables whose compression or fill factor differs. No
    compression is NONE, or COLUMNSTORE where column_store says so, and a fill factor of 0 is
    100. A table takes the compression of its clustered index, if it is to have one; under a
    clustered columnstore index, or with a compression that tables cannot have, it has no
    drift of its own."""
    fill = lambda c: F.coalesce(F.nullif(c, F.lit(0)), F.lit(100))
    full = F.lit(100)

    def side(df: DataFrame, prefix: str) -> DataFrame:
        store = F.coalesce("column_store", F.lit(False)) if "column_store" in df.columns else F.lit(False)
        squeezed = F.coalesce("compression", F.when(store, COLUMNSTORE[0]).otherwise(ROWS[0]))
        return df.select(*TABLE, "name", "clustered", store.alias("store"), squeezed.alias(f"{prefix}_compression"), fill(F.col("fill_factor")).alias(f"{prefix}_fill"))

    want, have = side(desired, "want"), side(live, "have")
    indexes = want.drop("clustered", "store").join(have.drop("clustered", "store"), [*TABLE, "name"])
    over = want.where("clustered").groupBy(*TABLE).agg(F.max(F.when(F.col("store"), COLUMNSTORE[0]).otherwise(F.col("want_compression"))).alias("over"))
    of = tables.join(over, TABLE, "left").select(*TABLE, F.coalesce("over", "compression", F.lit(ROWS[0])).alias("want_compression")).distinct().where(F.col("want_compression").isin(*ROWS))
    of = of.join(live_tables.select(*TABLE, F.coalesce("compression", F.lit(ROWS[0])).alias("have_compression")), TABLE)
    of = of.select(*TABLE, F.lit(None).cast("string").alias("name"), "want_compression", full.alias("want_fill"), "have_compression", full.alias("have_fill"))
    return indexes.select(*of.columns).unionByName(of).where("want_compression <> have_compression or want_fill <> have_fill")


#: The frames of children and their fields in a document.
CHILDREN = {"columns": "Columns", "indexes": "Indexes", "xml_indexes": "XmlIndexes", "foreign_keys": "ForeignKeys", "checks": "CheckConstraints", "statistics": "Statistics"}


def catalog_to_definitions(flat: dict[str, DataFrame]) -> DataFrame:
    """(database, schema, table, document): nested definitions from flat frames named as in
    CHILDREN, whose first column after the table's key is the Name, by which children are
    sorted, and from one row of `text` for each table with a text index."""
    def fields(df: DataFrame):
        return F.struct(*[c for c in df.columns if c not in TABLE])

    kinds = {frame: field for frame, field in CHILDREN.items() if frame in flat}
    nested = [flat[frame].groupBy(*TABLE).agg(F.array_sort(F.collect_list(fields(flat[frame]))).alias(field)) for frame, field in kinds.items()]
    if "text" in flat:
        nested.append(flat["text"].select(*TABLE, fields(flat["text"]).alias("FullTextIndex")))
    out = reduce(lambda a, b: a.join(b, TABLE, "left"), nested)
    return out.select(*TABLE, F.to_json(F.struct(F.col("schema").alias("Schema"), F.col("table").alias("Name"), *[c for c in out.columns if c not in TABLE])).alias("document"))


def properties_map(index_props: DataFrame, constraint_props: DataFrame) -> DataFrame:
    """(owner, properties) with index and constraint properties (owner, name, value) merged;
    of a name in both the index's value counts."""
    i = index_props.select("owner", "name", F.col("value").alias("i"))
    c = constraint_props.select("owner", "name", F.col("value").alias("c"))
    both = i.join(c, ["owner", "name"], "full_outer").select("owner", "name", F.coalesce("i", "c").alias("value"))
    return both.groupBy("owner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))


def untagged_objects(live: DataFrame, desired: DataFrame) -> DataFrame:
    """Live, desired, without an owner."""
    return live.where(F.col("owner").isNull()).join(desired.select(*TABLE), TABLE, "left_semi")


