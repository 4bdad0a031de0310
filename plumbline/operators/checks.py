"""Rows that break a key, reference or check, and what follows from deletes and key changes."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import fresh


def _any_null(keys: list[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def pk_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, reason): a null in the key, or a key that repeats."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.where(_any_null(keys) | (F.col("n") > 1)).withColumn("reason", F.when(_any_null(keys), "null").otherwise("repeated"))


def unique_violations(df: DataFrame, keys: list[str], where: str | None = None) -> DataFrame:
    """(keys, n) of repeated keys, among rows that match; nulls count as equal."""
    rows = df.where(where) if where else df
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fk_orphans(child: DataFrame, columns: list[str], parent: DataFrame, related: list[str]) -> DataFrame:
    """Child rows without a parent; a null anywhere in the key passes."""
    names = fresh(child.columns, *[f"parent{i}" for i in range(len(related))])
    p = parent.select(*[F.col(r).alias(n) for r, n in zip(related, names)])
    on = reduce(and_, [F.col(c) == F.col(n) for c, n in zip(columns, names)])
    return child.where(~_any_null(columns)).join(p, on, "left_anti")


def check_violations(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which the expression is false; null passes."""
    return df.where(~F.expr(expression))


def column_check_violations(df: DataFrame, keys: list[str], checks: dict[str, str | None]) -> DataFrame:
    """(keys, column) of every column check that is false, all in one pass."""
    each = [F.when(~F.expr(e), F.lit(c)) for c, e in checks.items() if e and e.strip()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*each))).alias("column"))


def not_null_violations(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    each = [F.when(F.col(c).isNull(), F.lit(c)) for c in columns]
    return df.select(*keys, F.explode(F.array_compact(F.array(*each))).alias("column"))


def cascade_delete(removed: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Children to remove, table after table: each step is (child, column, parent's key),
    its parents being the rows that the step before removes."""
    out = []
    for child, column, key in steps:
        (k,) = fresh(child.columns, "key")
        removed = child.join(removed.select(F.col(key).alias(k)).distinct(), F.col(column) == F.col(k), "left_semi")
        out.append(removed)
    return out


def cascade_delete_self(df: DataFrame, key: str, parent: str, removed: DataFrame, work: str) -> DataFrame:
    """Rows to remove from a self-referencing table, followed until no child is left.
    Each round's rows are written under work, so none is computed twice."""
    spark, base = df.sparkSession, f"{work}/{uuid.uuid4().hex}"
    front, n, paths = removed.select(key), 0, []
    (k,) = fresh(df.columns, "key")
    while True:
        path = f"{base}/{n}"
        front.write.parquet(path)
        front = spark.read.parquet(path)
        if front.isEmpty():
            break
        paths.append(path)
        seen = spark.read.parquet(*paths)
        kids = df.join(front.select(F.col(key).alias(k)), F.col(parent) == F.col(k), "left_semi").select(key)
        front, n = kids.join(seen, key, "left_anti").distinct(), n + 1
    return df.join(spark.read.parquet(*paths), key, "left_semi") if paths else df.limit(0)


def set_on_delete(child: DataFrame, column: str, removed: DataFrame, key: str, default: str = "null") -> DataFrame:
    """Children whose parent goes get null, or the default expression, for their key."""
    k, mark = fresh(child.columns, "key", "gone")
    gone = removed.select(F.col(key).alias(k)).distinct().withColumn(mark, F.lit(True))
    value = F.when(F.col(mark), F.expr(default).cast(child.schema[column].dataType)).otherwise(F.col(column))
    return child.join(gone, F.col(column) == F.col(k), "left").withColumn(column, value).select(*child.columns)


def no_action_blockers(removed: DataFrame, key: str, child: DataFrame, column: str) -> DataFrame:
    """(key, n_children) of parents that cannot go because rows refer to them."""
    per = child.groupBy(F.col(column).alias(key)).agg(F.count("*").alias("n_children"))
    return removed.select(key).distinct().join(per, key)


def cascade_update(child: DataFrame, column: str, changes: DataFrame, old: str, new: str) -> DataFrame:
    """Children with the parent's new key where changes(old, new) has one."""
    was, becomes, moved = fresh(child.columns, "old", "new", "moved")
    c = changes.select(F.col(old).alias(was), F.col(new).alias(becomes), F.lit(True).alias(moved))
    value = F.when(F.col(moved), F.col(becomes)).otherwise(F.col(column))
    return child.join(c, F.col(column) == F.col(was), "left").withColumn(column, value).select(*child.columns)


class GateClosed(RuntimeError):
    """A gate's condition was not true."""


def gate(condition: DataFrame, name: str = "gate") -> None:
    """Raise unless the one value of a one-row frame is true; null and no row are false."""
    row = condition.head()
    if row is None or row[0] is not True:
        raise GateClosed(name)


def row_report(df: DataFrame, table: str, checks: dict[str, str], not_null: list[str] = ()) -> DataFrame:
    """(table, constraint, n): rows that break each check {constraint: expression} or have
    a null in a column, all counted in one pass over the table."""
    broken = [(c, ~F.expr(e)) for c, e in checks.items()] + [(c, F.col(c).isNull()) for c in not_null]
    one = df.agg(*[F.count_if(x).alias(f"n{i}") for i, (_, x) in enumerate(broken)])
    rows = [F.struct(F.lit(table).alias("table"), F.lit(c).alias("constraint"), F.col(f"n{i}").alias("n")) for i, (c, _) in enumerate(broken)]
    return one.select(F.inline(F.array(*rows)))


def constraint_report(counted: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """(table, constraint, n) for {(table, constraint): violations}, each a plan of its own;
    constraints on single rows belong in a row_report of their table."""
    each = [v.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), F.lit(c).alias("constraint"), "n") for (t, c), v in counted.items()]
    return reduce(DataFrame.unionByName, each)
