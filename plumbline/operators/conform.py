"""Bringing rows into the shape a definition declares: renames, drops, additions, casts,
computed columns, in that order, all as projections."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import fresh

PERIOD = ("ValidFrom", "ValidTo")


def rename_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """{old: new}, each only where old is there and new is not."""
    return df.withColumnsRenamed({o: n for o, n in renames.items() if o in df.columns and n not in df.columns})


def union_same(frames: dict[str, DataFrame]) -> DataFrame:
    """Tables of one definition from many databases, with a `database` column."""
    tagged = [df.withColumn("database", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def add_columns(df: DataFrame, columns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """{name: (type, default expression or None)}, those that are missing, in name order."""
    new = {n: F.expr(d or "null").cast(t) for n, (t, d) in sorted(columns.items()) if n not in df.columns}
    return df.withColumns(new) if new else df


def drop_columns(df: DataFrame, defined: list[str], temporal: bool = False) -> DataFrame:
    keep = set(defined) | (set(PERIOD) if temporal else set())
    return df.select(*[c for c in df.columns if c in keep])


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Declared types; what cannot be cast is null here and found by cast_failures."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in kinds.items() if c in df.columns})


def computed_columns(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.expr(e) for c, e in expressions.items()})


def identity_column(df: DataFrame, name: str, order: list[str], work: str, seed: int = 1, increment: int = 1) -> DataFrame:
    """Number rows that have no value in `name`, by order, from the seed or on from the
    largest value. Rows are ranged, sorted and numbered inside partitions, written under
    work, so that a lost executor cannot number them anew, and shifted by the counts of
    the partitions before, of which there is one row each."""
    missing = df.where(F.col(name).isNull()) if name in df.columns else df.withColumn(name, F.lit(None).cast("long"))
    rest = df.where(F.col(name).isNotNull()) if name in df.columns else None
    sorted_ = missing.repartitionByRange(*order).sortWithinPartitions(*order)
    part, row, n, earlier, last = fresh(missing.columns, "part", "row", "n", "before", "top")
    sorted_ = sorted_.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    path = f"{work}/{uuid.uuid4().hex}"
    sorted_.write.parquet(path)
    numbered = df.sparkSession.read.schema(sorted_.schema).parquet(path)
    counts = numbered.groupBy(part).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start: Column = F.lit(seed)
    shifts = counts.select(part, before.alias(earlier))
    if rest is not None:
        top = rest.agg(F.max(name).alias(last))
        shifts = shifts.join(F.broadcast(top), F.lit(True))  # one row
        start = F.coalesce(F.col(last) + increment, F.lit(seed))
    made = numbered.join(shifts, part).withColumn(name, (start + (F.col(earlier) + F.col(row)) * increment).cast("long"))
    made = made.select(*missing.columns)
    return made if rest is None else rest.select(*missing.columns).unionByName(made)


def cast_failures(df: DataFrame, keys: list[str], rules: dict[str, dict]) -> DataFrame:
    """(keys, column, value, reason) of values that {column: {type, length, nullable}}
    would break: a null, a failed cast, lost decimals, a text too long."""
    checks = []
    for c, rule in rules.items():
        v = F.col(c)
        reason = F.when(v.isNull() & F.lit(not rule.get("nullable", True)), "null")
        if "type" in rule:
            cast = v.try_cast(rule["type"])
            reason = reason.when(v.isNotNull() & cast.isNull(), "cast")
            if rule["type"].startswith("decimal"):
                reason = reason.when(v.try_cast("decimal(38, 12)") != cast.cast("decimal(38, 12)"), "scale")
        if "length" in rule:
            reason = reason.when(F.length(v) > rule["length"], "length")
        checks.append(F.struct(F.lit(c).alias("column"), v.cast("string").alias("value"), reason.alias("reason")))
    return df.select(*keys, F.explode(F.filter(F.array(*checks), lambda x: x["reason"].isNotNull())).alias("f")).select(*keys, "f.column", "f.value", "f.reason")


def fill_defaults(df: DataFrame, json_col: str, schema: T.StructType, defaults: dict[str, str]) -> DataFrame:
    """Rows from JSON where a default stands for an absent property, not for a null one."""
    typed = df.select(F.from_json(json_col, schema).alias("j"), F.json_object_keys(json_col).alias("keys"))
    def value(f: T.StructField) -> Column:
        v = F.col(f"j.{f.name}")
        return F.when(~F.array_contains("keys", f.name), F.expr(defaults[f.name]).cast(f.dataType)).otherwise(v).alias(f.name) if f.name in defaults else v.alias(f.name)
    return typed.select(*[value(f) for f in schema.fields])


def sparse_report(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_nulls) of every column in one aggregate."""
    one = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select("n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_nulls")) for c in df.columns])).alias("x")).select("x.column", "n_rows", "x.n_nulls")


def conform(df: DataFrame, renames: dict[str, str], columns: dict[str, tuple[str, str | None]], computed: dict[str, str], temporal: bool = False) -> DataFrame:
    """All steps in order for a declared table."""
    out = rename_columns(df, renames)
    out = drop_columns(out, [*columns, *computed], temporal)
    out = cast_columns(add_columns(out, columns), {n: t for n, (t, _) in columns.items()})
    return computed_columns(out, computed)
