"""What deleting rows does to tables that refer to each other: one graph of references with
mixed actions, followed to its end before anything is changed.

CASCADE deletes children, and theirs, over several tables and in cycles. Children that
stay lose their reference (SET NULL), get the default instead (SET DEFAULT), or block the
whole delete (NO ACTION). Whether a child stays is known only at the end, so a child that
another path deletes neither blocks nor changes. A default must exist among the parents
that stay, and a reference that takes no null cannot be set to it; both block too.

A reference of a table to itself is followed by pointer doubling, in as many jobs as the
depth has binary digits; others in one round per step between tables. Every round's rows
are written, so none is computed twice. A null reference refers to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import fresh
from .checks import GateClosed

CASCADE, SET_NULL, SET_DEFAULT, NO_ACTION = "CASCADE", "SET NULL", "SET DEFAULT", "NO ACTION"


@dataclass(frozen=True)
class Reference:
    """child.column refers to parent.key; default is an SQL expression."""

    name: str
    child: str
    column: str
    parent: str
    key: str
    action: str = NO_ACTION
    default: str = "null"
    nullable: bool = True


@dataclass
class Outcome:
    """ids that go per table; per reference the ids that stay and their new value; the rows
    (reference, id, reason) that stand in the way; and the jobs that it took."""

    deleted: dict[str, DataFrame]
    changed: dict[Reference, DataFrame]
    blockers: DataFrame
    rounds: int = 0
    doublings: int = field(default=0)


class _Work:
    """Frames written one after another under a folder."""

    def __init__(self, folder: str):
        self.folder, self.n = folder, 0

    def put(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.folder}/{self.n}", self.n + 1
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def _of(table: DataFrame, column: str, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of the table whose column is, or with left_anti is not, in the one column of wanted."""
    (name,) = fresh(table.columns, "wanted")
    return table.join(wanted.toDF(name), F.col(column) == F.col(name), how)


def _keys(table: DataFrame, id_: str, ids: DataFrame, key: str) -> DataFrame:
    """The values of a key column in rows of some ids."""
    return ids.select(F.col("id").alias("value")) if key == id_ else _of(table, id_, ids).select(F.col(key).alias("value"))


def descendants(table: DataFrame, id_: str, key: str, column: str, start: DataFrame, work: _Work) -> tuple[DataFrame, int]:
    """The ids of rows below rows of start(id), start left out, and how many doublings it took.

    Every row knows one row above it, at first its parent, and whether a row of start lies
    on the way there. A doubling replaces the row above by the one above that. Rows that
    have met one of start, or the top, are settled. Cycles have no top; after as many
    doublings as the row count has digits, all of a cycle has been seen."""
    up = table.select(F.col(id_).alias("id"), F.col(key).alias("key"), F.col(column).alias("parent"))
    parents = up.select(F.col("key").alias("parent"), F.col("id").alias("up")).where("parent is not null")
    first = start.select("id").distinct().withColumn("in_start", F.lit(True))
    hit = first.select(F.col("id").alias("up"), F.lit(True).alias("hit"))
    state = up.join(parents, "parent", "left").join(hit, "up", "left").select("id", "up", F.coalesce("hit", F.lit(False)).alias("hit"))
    state, n = work.put(state), 0
    most = ceil(log2(max(state.count(), 2))) + 1
    while n < most and not state.where("up is not null and not hit").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("hit").alias("next_hit"))
        moving = state.where("up is not null and not hit").join(above, "up", "left").select("id", F.col("next").alias("up"), F.coalesce("next_hit", F.lit(False)).alias("hit"))
        state = work.put(state.where("up is null or hit").unionByName(moving))
        n += 1
    return state.where("hit").select("id").join(first, "id", "left_anti"), n


def delete(tables: dict[str, DataFrame], ids: dict[str, str], references: list[Reference], removed: dict[str, DataFrame], folder: str) -> Outcome:
    """What follows from deleting the rows of removed (table: a frame with its id column).
    ids names each table's id; a reference's key is unique among its parents."""
    work, rounds, doublings = _Work(folder), 0, 0
    cascades = [r for r in references if r.action == CASCADE]
    # of several references of a table to itself the first is followed by doubling
    own = {r.parent: r for r in reversed(cascades) if r.child == r.parent}
    front = {t: _of(tables[t], ids[t], df.select(ids[t])).select(F.col(ids[t]).alias("id")).distinct() for t, df in removed.items()}
    seen: dict[str, list[DataFrame]] = {t: [] for t in tables}
    while front:
        rounds, now = rounds + 1, {}
        for t, rows in front.items():
            rows = work.put(rows)
            if rows.isEmpty():
                continue
            seen[t].append(rows)
            now[t] = rows
            if t in own:
                below, n = descendants(tables[t], ids[t], own[t].key, own[t].column, rows, work)
                doublings += n
                known = reduce(DataFrame.unionByName, seen[t])
                below = work.put(below.join(known, "id", "left_anti"))
                seen[t].append(below)
                now[t] = rows.unionByName(below)
        reached: dict[str, list[DataFrame]] = {}
        for r in cascades:
            if r.parent in now and r is not own.get(r.parent):
                values = _keys(tables[r.parent], ids[r.parent], now[r.parent], r.key)
                kids = _of(tables[r.child], r.column, values).select(F.col(ids[r.child]).alias("id"))
                reached.setdefault(r.child, []).append(kids)
        front = {}
        for t, found in reached.items():
            new = reduce(DataFrame.unionByName, found).distinct()
            front[t] = new.join(reduce(DataFrame.unionByName, seen[t]), "id", "left_anti") if seen[t] else new
    deleted = {t: reduce(DataFrame.unionByName, found) for t, found in seen.items() if found}
    changed, blockers = {}, []
    for r in references:
        if r.parent not in deleted or r.action == CASCADE:
            continue
        child = tables[r.child].select(F.col(ids[r.child]).alias("id"), F.col(r.column).alias("old"))
        stay = child.join(deleted[r.child], "id", "left_anti") if r.child in deleted else child
        gone = _keys(tables[r.parent], ids[r.parent], deleted[r.parent], r.key)
        hit = stay.join(gone, F.col("old") == F.col("value"), "left_semi").select("id")
        blocked = lambda rows, why, r=r: rows.select(F.lit(r.name).alias("reference"), F.col("id").cast("string").alias("id"), F.lit(why).alias("reason"))
        if r.action == NO_ACTION:
            blockers.append(blocked(hit, "is referred to"))
            continue
        kind = tables[r.child].schema[r.column].dataType
        value = F.lit(None) if r.action == SET_NULL else F.expr(r.default)
        new = hit.select("id", value.cast(kind).alias("value"))
        if not r.nullable:
            blockers.append(blocked(new.where("value is null"), "takes no null"))
        if r.action == SET_DEFAULT:
            left = _of(tables[r.parent], ids[r.parent], deleted[r.parent], "left_anti").select(F.col(r.key).alias("value"))
            blockers.append(blocked(new.where("value is not null").join(left, "value", "left_anti"), "default is no parent"))
        changed[r] = new
    some = next(iter(tables.values())).sparkSession
    none = some.createDataFrame([], "reference string, id string, reason string")
    return Outcome(deleted, changed, reduce(DataFrame.unionByName, blockers, none), rounds, doublings)


def apply(tables: dict[str, DataFrame], ids: dict[str, str], outcome: Outcome) -> dict[str, DataFrame]:
    """The tables after the delete; raises, and changes nothing, if anything stands in the way."""
    row = outcome.blockers.head()
    if row is not None:
        raise GateClosed(f"{row['reference']}: {row['id']} {row['reason']}")
    out = dict(tables)
    for t, gone in outcome.deleted.items():
        out[t] = _of(out[t], ids[t], gone, "left_anti")
    for r, new in outcome.changed.items():
        df = out[r.child]
        key, value, mark = fresh(df.columns, "id", "value", "set")
        named = new.select(F.col("id").alias(key), F.col("value").alias(value), F.lit(True).alias(mark))
        out[r.child] = df.join(named, F.col(ids[r.child]) == F.col(key), "left").withColumn(r.column, F.when(F.col(mark), F.col(value)).otherwise(F.col(r.column))).select(*df.columns)
    return out
