"""XML and JSON columns as ordinary tables of nodes and entries."""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type



def xml_nodes(df: DataFrame, key: str, xml: str, schema: str) -> DataFrame:
    """(key, path, ordinal, value) of the declared elements of an XML column. Elements that
    repeat are numbered from 1; absent ones have no row."""
    parsed = df.select(F.col(key), F.from_xml(xml, schema).alias("x"))

    def cells_of(f):
        v = F.col(f"x.{f.name}")
        values = F.transform(v, lambda e: e.cast("string")) if f.dataType.typeName() == "array" else F.array(v.cast("string"))
        return F.transform(values, lambda e, i: F.struct(F.lit(f.name).alias("path"), (i + 1).cast("int").alias("ordinal"), e.alias("value")))

    cells = [cells_of(f) for f in parsed.schema["x"].dataType.fields]
    return parsed.select(key, F.inline(F.filter(F.flatten(F.array(*cells)), lambda e: e["value"].isNotNull())))


NODE = "node bigint, parent bigint, kind string, name string, path string, ordinal int, value string"


def shred(xml: str, columns: list[list]) -> None:
    """Appends the nodes of one document in document order to the columns of NODE, numbered
    from 0: elements (their value is their own text, null if there is none), their
    attributes, and runs of text. path holds element names from the root and @name for
    attributes; ordinal counts siblings of one kind and name from 1. Text of blanks alone is
    no node. What is not well-formed raises, and may have appended nodes before."""
    numbers, parents, kinds, names, paths, ordinals, values = columns
    first, text = len(numbers), []
    # the open element's number and path, and its parts counted by their step; those around it
    own, here, seen, around = -1, "", {}, []

    def node(parent, kind, name, path, ordinal, value):
        numbers.append(at := len(numbers) - first)
        parents.append(parent)
        kinds.append(kind)
        names.append(name)
        paths.append(path)
        ordinals.append(ordinal)
        values.append(value)
        return at

    def flush():
        run = "".join(text).strip()
        text.clear()
        if run:
            seen[""] = n = seen.get("", 0) + 1
            node(own, "text", None, here, n, run)
            before = values[first + own]
            values[first + own] = run if before is None else before + " " + run

    def start(name, attributes):
        nonlocal own, here, seen
        if text:
            flush()
        step = "/" + name
        seen[step] = n = seen.get(step, 0) + 1
        around.append((own, here, seen))
        here += step
        own, seen = node(None if own < 0 else own, "element", name, here, n, None), {}
        # an element's attributes differ in name
        for k in range(0, len(attributes), 2):
            node(own, "attribute", attributes[k], f"{here}/@{attributes[k]}", 1, attributes[k + 1])

    def end(_):
        nonlocal own, here, seen
        if text:
            flush()
        own, here, seen = around.pop()

    parser = expat.ParserCreate()
    parser.ordered_attributes, parser.buffer_text = True, True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    # entities of the document's own could grow without bound
    parser.EntityDeclHandler = _no_entities
    parser.Parse(xml, True)


def _no_entities(*_):
    raise ValueError("entity declarations are not read")


#: Nodes up to which those of several documents go to Spark together.
BATCH_NODES = 20_000


def xml_shred(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, node, parent, kind, name, path, ordinal, value): every node of an XML column at
    any depth, without a schema, one pass over each document. Null has no nodes; what is
    not well-formed, or declares entities, has one of kind `fault` with the reason.
    Documents are dealt out by their content first, as a table of few files has few tasks."""
    schema = pa.schema([(key, to_arrow_type(df.schema[key].dataType)), ("node", pa.int64()), ("parent", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("path", pa.string()), ("ordinal", pa.int32()), ("value", pa.string())])

    def run(batches):
        for batch in batches:
            keys, of, columns = batch.column(0), [], [[] for _ in schema.names[1:]]

            def rows():
                return pa.RecordBatch.from_arrays([keys.take(pa.array(of)).cast(schema.field(0).type), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)

            for i, doc in enumerate(batch.column(1)):
                if not doc.is_valid:
                    continue
                try:
                    shred(doc.as_py(), columns)
                except (expat.ExpatError, ValueError) as e:
                    for c, x in zip(columns, (0, None, "fault", None, None, None, str(e))):
                        c[len(of):] = [x]
                of += [i] * (len(columns[0]) - len(of))
                if len(of) >= BATCH_NODES:
                    yield rows()
                    of, columns = [], [[] for _ in columns]
            if of:
                yield rows()

    docs = df.select(key, xml).where(F.col(xml).isNotNull()).repartition(key, xml)
    return docs.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {NODE}")


#: The lookups a node table can be laid out for.
LAYOUTS = {"PATH": ("path", "value"), "VALUE": ("value", "path"), "PROPERTY": (None, "path")}


def xml_layout(nodes: DataFrame, kind: str, key: str) -> DataFrame:
    """The nodes ranged and sorted for lookups by path, by value or by row."""
    order = [c or key for c in LAYOUTS[kind.upper()]]
    return nodes.repartitionByRange(*order).sortWithinPartitions(*order)


def json_entries(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, name, value, type) of a JSON object's properties, nulls left out."""
    df.createOrReplaceTempView(view := f"json_entries_{id(df)}")
    rows = df.sparkSession.sql(f"select `{key}`, e.key as name, e.value as v from {view}, lateral variant_explode(try_parse_json(`{column}`)) as e where schema_of_variant(try_parse_json(`{column}`)) like 'OBJECT%'")
    rows = rows.where(~F.is_variant_null("v"))
    return rows.select(key, "name", F.when(F.schema_of_variant("v") == "STRING", F.variant_get("v", "$", "string")).otherwise(F.to_json("v")).alias("value"), F.schema_of_variant("v").alias("type"))


def json_flatten(df: DataFrame, key: str, column: str, work: str) -> DataFrame:
    """(key, path, value) of all leaves with dotted paths, at any depth. Elements of arrays
    have their number in the path; nulls, empty objects and empty arrays have no row.

    Documents are parsed once. A job per level takes what the level before found to have
    parts, and writes its own parts under work, leaves as text and others as variants; no
    level is computed twice, and the leaves are read from there."""
    spark, depth = df.sparkSession, 0
    level = df.select(F.col(key), F.lit("").alias("path"), F.try_parse_json(column).alias("v"))
    inner = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    text = F.when(F.schema_of_variant("v") == "STRING", F.variant_get("v", "$", "string")).otherwise(F.to_json("v"))
    while True:
        level.createOrReplaceTempView(view := f"json_level_{id(df)}")
        parts = spark.sql(f"select `{key}`, concat(if(path = '', '', concat(path, '.')), coalesce(e.key, cast(e.pos as string))) as path, e.value as v from {view}, lateral variant_explode(v) as e")
        parts = parts.where(~F.is_variant_null("v")).select(key, "path", F.when(inner, F.col("v")).alias("v"), F.when(~inner, text).alias("value"))
        path = f"{work}/level={depth}"
        parts.write.parquet(path)
        spark.catalog.dropTempView(view)
        level = spark.read.schema(parts.schema).parquet(path).where("v is not null").select(key, "path", "v")
        if level.isEmpty():
            break
        depth += 1
    return spark.read.schema(parts.schema).parquet(*[f"{work}/level={i}" for i in range(depth + 1)]).where("value is not null").select(key, "path", "value")
