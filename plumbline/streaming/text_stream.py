"""Postings kept up to date from a stream of changed rows, by key and version.

A store is a folder of segments and a manifest. Every micro-batch becomes a segment with
two tables: heads, one row per changed key (key, version, seq, gone), and the postings of
those keys under the same seq. A change is taken only if its version is above the
newest one stored for its key, so late and repeated changes lose; a key whose texts are
all null, or whose row says `deleted`, leaves a head that is a tombstone. The manifest
names the live segments; writing one file of it is the last step of a batch, so readers
see a batch whole or not at all, and a batch that is repeated after a failure is either
known already or written anew. After `fold` segments the store is compacted: current
postings become one segment, the manifest is swapped, and what only manifests before the
one just replaced have named is deleted.

Reading touches live segments only. The first, which holds nearly all rows, is not
shuffled: its rows are checked against the keys of the later ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.text import postings_of
from ..sources.paths import delete, exists

MANIFEST = "id bigint, batch bigint, segments array<string>"
#: Keys up to which those of later segments are broadcast; counted first.
BROADCAST_KEYS = 100_000
FOLD = 8


def manifests(spark: SparkSession, path: str) -> list:
    """All manifests that are left, newest first: a few, as compaction removes old ones."""
    if not exists(spark, f"{path}/manifest"):
        return []
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{path}/manifest").orderBy(F.desc("id")).collect()


def _publish(spark: SparkSession, path: str, number: int, batch: int, segments: list[str]) -> None:
    row = spark.createDataFrame([(number, batch, segments)], MANIFEST).coalesce(1)
    row.write.mode("overwrite").json(f"{path}/manifest/{number}")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if len(df.select(F.lit(1)).head(BROADCAST_KEYS + 1)) <= BROADCAST_KEYS else df


def _heads(spark: SparkSession, path: str, segments: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/heads/{s}" for s in segments])


def newest(batch: DataFrame, key: str, columns: list[str], number: int) -> DataFrame:
    """(key, version, gone, columns): one row per key, that of the highest version. Repeated
    rows collapse; of different rows of one version the greater texts count. Without a
    version column, batches count in their order; a null version is below all others."""
    version = F.coalesce(F.col("version").cast("bigint"), F.lit(-(2**63) + 1)) if "version" in batch.columns else F.lit(number).cast("bigint")
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])
    gone = (F.coalesce(F.col("deleted"), F.lit(False)) | empty) if "deleted" in batch.columns else empty
    best = F.max(F.struct(version.alias("version"), gone.alias("gone"), *[F.col(c) for c in columns])).alias("best")
    return batch.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "best.*")


def take(spark: SparkSession, batch: DataFrame, number: int, path: str, key: str, columns: list[str], stop: DataFrame | None = None, use_stop: bool = True, fold: int = FOLD) -> None:
    """Add one batch to the store. Rows without a key have no place and are left out."""
    known = manifests(spark, path)
    if known and known[0]["batch"] >= number:
        return  # its manifest was written before the stream noted the batch
    live, at = (known[0]["segments"], known[0]["id"] + 1) if known else ([], 0)
    rows = newest(batch, key, columns, number)
    if live:
        rows = rows.persist()
        stored = _heads(spark, path, live).join(_small(rows.select(key)), key, "left_semi").groupBy(key).agg(F.max("version").alias("stored"))
        accepted = rows.join(stored, key, "left").where("stored is null or version > stored").drop("stored")
    else:
        accepted = rows
    name = f"batch-{number}"
    staged = f"{path}/staged/{name}"
    accepted.write.mode("overwrite").parquet(staged)
    if live:
        rows.unpersist()
    accepted = spark.read.parquet(staged).withColumn("seq", F.lit(number).cast("bigint"))
    accepted.select(key, "version", "seq", "gone").write.mode("overwrite").parquet(f"{path}/heads/{name}")
    texts = accepted.where("not gone")
    postings_of(texts, key, columns, stop, use_stop).withColumn("seq", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/postings/{name}")
    _publish(spark, path, at, number, [*live, name])
    delete(spark, [staged])
    if len(live) + 1 >= fold:
        compact(spark, path, key)


def keep_postings(changes: DataFrame, path: str, checkpoint: str, key: str, columns: list[str], stop: DataFrame | None = None, use_stop: bool = True, fold: int = FOLD) -> StreamingQuery:
    """Start a query that brings the store at path up to date with a stream of rows
    (key, columns, and optionally version and deleted)."""
    def write(batch: DataFrame, number: int) -> None:
        take(batch.sparkSession, batch, number, path, key, columns, stop, use_stop, fold)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _current(spark: SparkSession, path: str, segments: list[str], key: str, kind: str) -> DataFrame:
    """Rows of a kind that no later segment replaces."""
    first = spark.read.parquet(f"{path}/{kind}/{segments[0]}")
    if len(segments) == 1:
        return first
    last = _heads(spark, path, segments[1:]).groupBy(key).agg(F.max("seq").alias("seq"))
    later = spark.read.parquet(*[f"{path}/{kind}/{s}" for s in segments[1:]])
    kept = first.join(_small(last.select(key)), key, "left_anti")
    return kept.unionByName(later.join(last, [key, "seq"], "left_semi").select(*first.columns))


def read_postings(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The postings of every key's newest version."""
    return _current(spark, path, manifests(spark, path)[0]["segments"], key, "postings").drop("seq")


def compact(spark: SparkSession, path: str, key: str) -> None:
    """Make the current postings one segment and swap the manifest. Heads stay, tombstones
    too, so that late versions still lose. Readers of the manifest before still find what
    it names; what only older ones name goes."""
    known = manifests(spark, path)
    now = known[0]
    if len(now["segments"]) > 1:
        name = f"base-{now['id'] + 1}"
        for kind in ("heads", "postings"):
            _current(spark, path, now["segments"], key, kind).write.mode("overwrite").parquet(f"{path}/{kind}/{name}")
        _publish(spark, path, now["id"] + 1, now["batch"], [name])
        known = manifests(spark, path)
    live = {s for m in known if m["id"] >= now["id"] for s in m["segments"]}
    old = [m for m in known if m["id"] < now["id"]]
    delete(spark, [f"{path}/{kind}/{s}" for s in {s for m in old for s in m["segments"]} - live for kind in ("heads", "postings")] + [f"{path}/manifest/{m['id']}" for m in old])
