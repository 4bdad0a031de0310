"""Row history: period columns, closing and opening versions, reading as of a time.
Intervals are half open: ValidFrom <= t < ValidTo."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import fresh
from ..sources.paths import work_dir
from .merge import differs, joined

FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"


def _time(text: str):
    return F.lit(text).cast("timestamp_ntz")


def on(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with its period columns, and its empty history."""
    current = df.withColumns({"ValidFrom": _time(FIRST), "ValidTo": _time(LAST)})
    return current, df.sparkSession.createDataFrame([], current.schema)


def off(current: DataFrame) -> DataFrame:
    return current.drop("ValidFrom", "ValidTo")


def apply(current: DataFrame, history: DataFrame, source: DataFrame, keys: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    """(current, history) after the source's rows became valid at a time: changed and
    deleted rows close into history, changed and new ones open a version. A null key
    matches nothing, so such rows close and open each time. Both results are read off one
    join, whose shuffles a plan with both of them makes once."""
    columns = off(current).columns
    both, new, gone = joined(current, source, keys, "full_outer")
    keep = ~new & ~gone & ~differs([c for c in columns if c not in keys], current.schema)
    period = {"ValidFrom": _time(at), "ValidTo": _time(LAST)}
    now = both.where(~gone).select(*[F.when(keep, F.col(f"t.{c}")).otherwise(period[c] if c in period else F.col(f"s.{c}")).alias(c) for c in current.columns])
    closed = both.where(~new & ~keep).select(*[F.col(f"t.{c}") for c in current.columns]).withColumn("ValidTo", _time(at))
    return now, history.unionByName(closed)


#: Events of a key up to which one task sorts them all, and rows up to which a table of
#: slices is broadcast; both are counted. A slice cut again is cut into PARTS at least.
SLICE_ROWS, BROADCAST_ROWS, PARTS = 1_000_000, 100_000, 64


def _micros(df: DataFrame, time: str) -> Column:
    """A time in microseconds, in the order of the times whatever the session's zone."""
    if df.schema[time].dataType.typeName() == "timestamp":
        return F.unix_micros(time)
    since = F.col(time).cast("timestamp_ntz") - _time("1970-01-01 00:00:00")
    return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long")


def _sliced(events: DataFrame, key: str, time: str, limit: int, us: str, start: str) -> tuple[DataFrame, DataFrame] | None:
    """(events with a column `start`, (key, start, first, last) of the slices): events of
    keys with more than limit are cut into slices of 2 * limit at most, or of one time,
    and know where theirs starts, in microseconds. Events of other keys and without a time
    have null there. None if there is nothing to cut.

    Slices are cut by arithmetic: a key's span into as many parts of one length as it has
    limits, and parts that hold too many events again, between their own first and last
    time. Their counts are exact and written, so that every reader finds the same slices."""
    if events.groupBy(key).agg(F.count(time).alias("n")).where(F.col("n") > limit).isEmpty():
        return None
    spark, base = events.sparkSession, work_dir(events.sparkSession)
    hot, at, low, width = fresh([*events.columns, us, start], "hot", "at", "low", "width")
    rows = events.withColumns({us: _micros(events, time), start: F.lit(None).cast("long")})
    found, done, level = rows, [], 0
    while True:
        counts = found.where(F.col(us).isNotNull()).groupBy(F.col(key).alias("key"), F.col(start).alias("start"))
        counts = counts.agg(F.count("*").alias("n"), F.min(us).alias("low"), F.max(us).alias("high"), F.min(time).alias("first"), F.max(time).alias("last")).where(F.lit(level > 0) | (F.col("n") > limit))
        counts.write.parquet(f"{base}/{level}")
        counts = spark.read.schema(counts.schema).parquet(f"{base}/{level}")
        many = (F.col("n") > (2 * limit if level else limit)) & (F.col("low") < F.col("high"))
        cut = counts.where(many)
        if level:
            done.append(counts.where(~many).select("key", "start", "first", "last"))
        if cut.isEmpty():
            return (rows, reduce(DataFrame.unionByName, done)) if level else None
        parts = F.greatest(F.ceil(F.col("n") / limit), F.lit(PARTS if level else 2))
        cut = _checked(cut.select(F.col("key").alias(hot), F.col("start").alias(at), F.col("low").alias(low), (F.floor((F.col("high") - F.col("low")) / parts) + 1).alias(width)))
        same = F.col(key).eqNullSafe(F.col(hot)) & F.col(start).eqNullSafe(F.col(at))
        moved = F.when(F.col(width).isNull(), F.col(start)).otherwise(F.col(us) - (F.col(us) - F.col(low)) % F.col(width))
        found, rows = (rows.join(cut, same, how).withColumn(start, moved).drop(hot, at, low, width) for how in ("inner", "left"))
        level += 1


def slices(events: DataFrame, key: str, time: str, limit: int) -> DataFrame | None:
    """(key, bounds) of keys with more than limit events: times that cut theirs into parts
    of 2 * limit at most, each the last of its part. None if no key has so many."""
    found = _sliced(events, key, time, limit, *fresh(events.columns, "us", "start"))
    if found is None:
        return None
    ends = F.sort_array(F.collect_list("last"))
    return found[1].groupBy(F.col("key").alias(key)).agg(ends.alias("ends")).select(key, F.slice("ends", 1, F.size("ends") - 1).alias("bounds"))


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if len(df.select(F.lit(1)).head(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS else df


def versions(events: DataFrame, key: str, time: str, tie: str, limit: int = SLICE_ROWS) -> DataFrame:
    """Every event as a version valid until the key's next one; a null key is a key of its
    own, a null time or tie comes last. Keys with more than limit events are cut into slices
    of time, so that no task sorts all of one; the first time of each slice, a row per
    slice, ends the slice before. Only events of one key at one time, or without a time,
    which slices cannot part, stay in one task."""
    ends, order = _time(LAST), [F.col(c).asc_nulls_last() for c in (time, tie)]
    us, start, hot, at, nxt = fresh(events.columns, "us", "start", "hot", "at", "next")
    found = _sliced(events, key, time, limit, us, start)
    if found is None:
        until = F.lead(time).over(Window.partitionBy(key).orderBy(*order))
        return events.withColumns({"ValidFrom": F.col(time), "ValidTo": F.coalesce(until, ends)})
    rows, cells = found
    after = cells.select(F.col("key").alias(hot), F.col("start").alias(at), F.lead("first").over(Window.partitionBy("key").orderBy("start")).alias(nxt))
    until = F.lead(time).over(Window.partitionBy(key, start).orderBy(*order))
    inside = rows.withColumns({"ValidFrom": F.col(time), "ValidTo": until})
    both = inside.join(_checked(after), F.col(key).eqNullSafe(F.col(hot)) & (F.col(start) == F.col(at)), "left")
    return both.withColumn("ValidTo", F.coalesce("ValidTo", nxt, ends)).drop(us, start, hot, at, nxt)


def as_of(current: DataFrame, history: DataFrame, at: str) -> DataFrame:
    return off(current.unionByName(history).where((F.col("ValidFrom") <= _time(at)) & (F.col("ValidTo") > _time(at))))


def alter(current: DataFrame, history: DataFrame, change: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A change of shape on current rows and history alike."""
    return change(current), change(history)
