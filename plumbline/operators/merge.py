"""Comparing a target with a source by key, and the target after the merge.

Keys match by plain equality, so a null key matches nothing; other columns are compared
null-safe. One full outer join serves every action."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import fresh
from ..sources.paths import delete, listed
from ..sources.tables import COMPUTED, IDENTITY, ROWGUID

INSERT, UPDATE, DELETE, KEEP = "insert", "update", "delete", "keep"


def roles(schema: T.StructType) -> dict[str, list[str]]:
    """Column lists per use: read, insert and update."""
    of = {f.name: f.metadata.get("role") for f in schema.fields}
    read = sorted(c for c, r in of.items() if r not in (COMPUTED, ROWGUID))
    return {"read": read, "insert": list(read), "update": [c for c in read if of[c] != IDENTITY]}


def comparable(c: Column, kind: T.DataType) -> Column:
    """A form in which any type can be compared: maps as sorted entries, structs as JSON."""
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(kind, (T.StructType, T.VariantType)):
        return F.to_json(c)
    return c


def differs(columns: list[str], schema: T.StructType, t: str = "t", s: str = "s") -> Column:
    each = [~comparable(F.col(f"{t}.{c}"), schema[c].dataType).eqNullSafe(comparable(F.col(f"{s}.{c}"), schema[c].dataType)) for c in columns]
    return reduce(or_, each, F.lit(False))


def joined(target: DataFrame, source: DataFrame, keys: list[str], how: str) -> tuple[DataFrame, Column, Column]:
    """The target as `t` joined with the source as `s`, and whether a row is only the
    source's, or only the target's."""
    (mark,) = fresh([*target.columns, *source.columns], "in")
    t = target.withColumn(mark, F.lit(True)).alias("t")
    s = source.withColumn(mark, F.lit(True)).alias("s")
    return t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], how), F.col(f"t.{mark}").isNull(), F.col(f"s.{mark}").isNull()


def _scoped(target: DataFrame, where: str | None) -> tuple[DataFrame, Column]:
    (scope,) = fresh(target.columns, "scope")
    return target.withColumn(scope, F.lit(True) if where is None else F.coalesce(F.expr(where), F.lit(False))), F.col(f"t.{scope}")


def diff(target: DataFrame, source: DataFrame, keys: list[str], where: str | None = None, compare: list[str] | None = None) -> DataFrame:
    """keys and action for every key of either side. A row that only the target has is a
    delete, with `where` only if the predicate is true for it; otherwise it is kept."""
    compare = [c for c in target.columns if c in source.columns and c not in keys] if compare is None else compare
    scoped, scope = _scoped(target, where)
    both, new, gone = joined(scoped, source, keys, "full_outer")
    action = F.when(new, INSERT).when(gone & scope, DELETE).when(gone, KEEP).when(differs(compare, target.schema), UPDATE).otherwise(KEEP)
    return both.select(*[F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in keys], action.alias("action"))


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: bool = True, delete: bool = False, where: str | None = None, set_columns: list[str] | None = None) -> DataFrame:
    """The target after inserts and, as asked for, updates and scoped deletes. Only
    set_columns (all but the keys) change in matched rows."""
    scoped, scope = _scoped(target, where)
    both, new, gone = joined(scoped, source, keys, "full_outer")
    if delete:
        both = both.where(~(gone & scope))
    change = {c for c in target.columns if c in source.columns and c not in keys}
    change &= set(set_columns) if set_columns is not None else change

    def value(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"t.{c}").alias(c)
        takes = new | (~gone & F.lit(update and c in change))
        return F.when(takes, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return both.select(*[value(c) for c in target.columns])


def insert_only(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target and the source's rows of new keys; existing rows stay untouched."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def changed(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows of matched keys where any other column differs."""
    compare = [c for c in target.columns if c in source.columns and c not in keys]
    return joined(target, source, keys, "inner")[0].where(differs(compare, target.schema)).select(*[F.col(f"s.{c}") for c in source.columns])


def plan_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def key_guard(source: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a merge cannot place: those with a null and those that repeat."""
    null = reduce(or_, [F.col(k).isNull() for k in keys])
    per = source.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.where(null | (F.col("n") > 1)).withColumn("reason", F.when(null, "null").otherwise("repeated"))


def in_partitions(by: list[str], rows: list) -> Column:
    """Whether a row lies in one of the partitions."""
    return reduce(or_, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in by]) for r in rows], F.lit(False))


def merge_stored(path: str, source: DataFrame, keys: list[str], by: list[str], work: str, update: bool = True, delete_missing: bool = False, where: str | None = None, set_columns: list[str] | None = None) -> DataFrame:
    """Merge into a Parquet table that is partitioned by some columns, and return the
    partitions that were written, with the rows inserted, updated and deleted in each.

    One join finds the rows that change; they are written under work. Only partitions that
    lose or get a row are read again and replaced, each at once when the write commits;
    files of others stay as they are. Partitions that lose all rows are deleted. Where all
    partition columns are keys, and nothing is deleted, only partitions that the source
    names are read at all. The partitions' values go through the driver, which lists them
    for every scan anyway.

    The new rows are complete in work before the table is touched, so that a run which
    fails can be repeated: rows that have been merged are then equal, and change nothing.
    Repeated keys of the source are for key_guard to find; here they insert or update once
    each. A null key matches nothing."""
    spark = source.sparkSession
    target = spark.read.parquet(path)
    if set(by) <= set(keys) and not delete_missing:
        target = target.where(in_partitions(by, source.select(*by).distinct().collect()))
    change = [c for c in target.columns if c in source.columns and c not in keys and (set_columns is None or c in set_columns)]
    scoped, scope = _scoped(target, where)
    both, new, gone = joined(scoped, source, keys, "full_outer")
    action = F.when(new, INSERT).when(gone & scope & F.lit(delete_missing), DELETE).when(gone, KEEP).when(F.lit(update) & differs(change, target.schema), UPDATE).otherwise(KEEP)
    act, *old = fresh([*target.columns, *source.columns], "action", *[f"old_{c}" for c in by])

    def value(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"t.{c}")
        return F.when(new | (~gone & F.lit(c in change)), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType)

    rows = both.withColumn(act, action).where(F.col(act) != KEEP).select(F.col(act), *[F.col(f"t.{c}").alias(o) for c, o in zip(by, old)], *[value(c).alias(c) for c in target.columns])
    rows.write.parquet(f"{work}/changes")
    rows = spark.read.schema(rows.schema).parquet(f"{work}/changes")
    was = rows.where(F.col(act) != INSERT).select(act, *[F.col(o).alias(c) for c, o in zip(by, old)])
    now = rows.where(F.col(act) != DELETE).select(act, *by)
    moved = was.where(F.col(act) == UPDATE).select(F.lit("left").alias(act), *by)
    counts = now.unionByName(was.where(F.col(act) == DELETE)).unionByName(moved).groupBy(*by).agg(*[F.count_if(F.col(act) == a).alias(f"n_{a}") for a in (INSERT, UPDATE, DELETE)])
    counts.write.parquet(f"{work}/counts")
    counts = spark.read.schema(counts.schema).parquet(f"{work}/counts")
    touched = counts.select(*by).collect()
    if touched:
        held = spark.read.parquet(path).where(in_partitions(by, touched))
        # keys of rows that go or are replaced; a null key matches nothing, so such rows only go by being missing
        out = held.join(rows.where(F.col(act) != INSERT).select(*keys), keys, "left_anti").select(*target.columns)
        if delete_missing:
            null = reduce(or_, [F.col(k).isNull() for k in keys])
            out = out.where(~(null & (F.lit(True) if where is None else F.coalesce(F.expr(where), F.lit(False)))))
        out = out.unionByName(rows.where(F.col(act) != DELETE).select(*target.columns))
        out.write.parquet(f"{work}/rows")
        out = spark.read.schema(out.schema).parquet(f"{work}/rows")
        filled = {tuple(r) for r in out.select(*by).distinct().collect()}
        emptied = [r for r in touched if tuple(r) not in filled]
        places = listed(held.where(in_partitions(by, emptied))) if emptied else []
        out.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        delete(spark, sorted({p.rsplit("/", 1)[0] for p in places}))
    return counts
