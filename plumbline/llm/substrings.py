"""Substring dedup with a log-structured fingerprint index.

Windows of 13 words are fingerprinted by an anchor, the smallest hash among the
6-word runs inside them, so equal windows have equal anchors while consecutive
windows mostly share one: the index holds a fifth of the windows' number and yet
misses none. A batch becomes a run, an immutable table of (anchor, doc) bucketed and
sorted by anchor. The new run is merge-joined with the runs of history, bucket by
bucket and without a shuffle; documents on either side that have a shared anchor
are read again, their windows under shared anchors compared by 128 bits (64 of the 13
words and, beside them, the anchor's 64), and windows that start in an earlier
document are removed. When `fanout` runs stand beside each
other they are merged into one.

Batches are taken in order of doc_id, so what history holds is earlier. Tasks keep
only the earliest document of a window before anything is shuffled, so a passage in
a third of all documents reaches the shuffle once per task.

Null text has no words. Rows with a null doc_id are passed on whole and seen by no
other. doc_id names a row: equal rows that repeat one are treated alike. Documents
of fewer than 13 words lose nothing. Empty input gives empty output.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, saved, table
from .hashing import PRIME, U, WordHashes, bitmap, in_bitmap, mixed, split_words, windows

WINDOW, ANCHOR = 13, 6
BATCHES, FANOUT = 3, 2
#: Characters of text per bucket of the index, for choosing their number.
BUCKET_CHARS = 64 << 20


def fingerprints(hashes: np.ndarray, n: int = WINDOW, a: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(window key, anchor) of every n-word window."""
    w = windows(hashes, n)
    if not len(w):
        return w, w
    runs = windows(hashes ^ U(PRIME), a)
    low = runs[: len(w)].copy()
    for k in range(1, n - a + 1):
        np.minimum(low, runs[k : k + len(w)], out=low)
    return mixed(w ^ (low * U(PRIME))), low


def _anchors(n: int, a: int):
    def run(batches):
        known = WordHashes()
        for batch in batches:
            found, docs = [np.empty(0, U)], [np.empty(0, np.int64)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = np.unique(fingerprints(known.of(split_words(text)), n, a)[1])
                found.append(low)
                docs.append(np.full(len(low), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(docs))], ["anchor", "doc"])

    return run


def _candidates(anchors: tuple[np.ndarray, int], docs: tuple[np.ndarray, int] | None, n: int, a: int):
    """(key, low, doc, at, sure) of windows under shared anchors (low). Of equal windows in
    a batch only those of the first document keep their key; later ones are removed for sure.
    With docs, a bitmap, these are documents of history, of which no window is removed."""
    def run(batches):
        known = WordHashes()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            which = np.arange(len(ids)) if docs is None else np.flatnonzero(in_bitmap(docs[0], ids, docs[1]))
            keys, lows, owner, places = [np.empty(0, U)], [np.empty(0, U)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for i, text in zip(ids[which], batch.column(1).take(pa.array(which)).to_pylist()):
                key, low = fingerprints(known.of(split_words(text)), n, a)
                at = np.flatnonzero(in_bitmap(anchors[0], low.view(np.int64), anchors[1])) if len(key) else np.empty(0, np.int64)
                keys.append(key[at])
                lows.append(low[at])
                owner.append(np.full(len(at), i, np.int64))
                places.append(at.astype(np.int32))
            key, low, doc, at = (np.concatenate(x) for x in (keys, lows, owner, places))
            order = np.lexsort((doc, key))
            key, low, doc, at = key[order], low[order], doc[order], at[order]
            # different windows of one key have different anchors and start anew
            start = np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]))) if len(key) else np.empty(0, bool)
            head = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0)) if len(key) else np.empty(0, np.int64)
            sure = doc != doc[head]
            if docs is not None:
                key, low, doc, at, sure = key[start], low[start], doc[start], np.full(int(start.sum()), -1, np.int32), sure[start]
            # rows that are settled get keys that spread them evenly
            key = np.where(sure, mixed(doc.view(U) * U(PRIME) + at.astype(np.int64).view(U)), key)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(low.view(np.int64)), pa.array(doc), pa.array(at), pa.array(sure)], ["key", "low", "doc", "at", "sure"])

    return run


class FingerprintIndex:
    """Runs of (anchor, doc), each a table in the shared folder, bucketed and sorted."""

    def __init__(self, spark: SparkSession, buckets: int, n: int = WINDOW, a: int = ANCHOR, fanout: int = FANOUT):
        self.spark, self.buckets, self.n, self.a, self.fanout = spark, buckets, n, a, fanout
        self.runs: list[tuple[int, str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "anchor").write.format("parquet").option("compression", "zstd").option("path", new_path(self.spark, name))
         .bucketBy(self.buckets, "anchor").sortBy("anchor").saveAsTable(name))
        return name

    def _compact(self) -> None:
        """Merge the newest runs while `fanout` of a level stand beside each other."""
        while len(self.runs) >= self.fanout and len({level for level, _ in self.runs[-self.fanout :]}) == 1:
            last = self.runs[-self.fanout :]
            merged = self.spark.table(last[0][1])
            for _, name in last[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.runs[-self.fanout :] = [(last[0][0] + 1, self._write(merged))]
            for _, name in last:
                self.spark.sql(f"drop table {name}")

    def add(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """(doc, at) of the batch's windows that start in an earlier document, of history
        (id, text; what was added before) or of the batch; then the batch is history."""
        new = self._write(batch.mapInArrow(_anchors(self.n, self.a), "anchor long, doc long"))
        run = self.spark.table(new)
        inside = run.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor")
        olds = [self.spark.table(name) for _, name in self.runs]
        across = None
        for old in olds:
            met = run.join(old.hint("merge"), "anchor", "left_semi").select("anchor")
            across = met if across is None else across.unionByName(met)
        shared = saved(inside if across is None else inside.unionByName(across.distinct()), "shared")
        anchors = bitmap(shared, F.col("anchor"))
        schema = "key long, low long, doc long, at int, sure boolean"
        rows = batch.mapInArrow(_candidates(anchors, None, self.n, self.a), schema)
        if olds:
            docs = None
            for old in olds:
                had = old.join(run.hint("merge"), "anchor", "left_semi").select("doc")
                docs = had if docs is None else docs.unionByName(had)
            rows = rows.unionByName(history.mapInArrow(_candidates(anchors, bitmap(docs, F.col("doc")), self.n, self.a), schema))
        first = F.min(F.when(~F.col("sure"), F.col("doc"))).over(Window.partitionBy("key", "low"))
        removed = saved(rows.withColumn("first", first).where("at >= 0 and (sure or doc > first)").select("doc", "at"), "removed")
        self.runs.append((0, new))
        self._compact()
        return removed


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, n: int = WINDOW, a: int = ANCHOR) -> DataFrame:
    """(doc, at): the windows of docs that also start in a document of smaller id."""
    spark = docs.sparkSession
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null and text is not null")
    chars, low, high = raw.agg(F.sum(F.length("text")), F.min("id"), F.max("id")).head()
    if chars is None:
        return spark.createDataFrame([], "doc long, at int")
    index = FingerprintIndex(spark, max(partitions(spark), -(-chars // BUCKET_CHARS)), n, a)
    edges = raw.approxQuantile("id", [i / batches for i in range(1, batches)], 0.005) if batches > 1 and low < high else []
    cuts = [low, *sorted({int(x) + 1 for x in edges if low <= x < high}), high + 1]
    out = None
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        removed = index.add(raw.where((F.col("id") >= lo) & (F.col("id") < hi)), raw.where(F.col("id") < lo))
        out = removed if out is None else out.unionByName(removed)
    return out


def kept_words(ws: list[bytes], starts: np.ndarray, n: int = WINDOW) -> list[bytes]:
    """The words that no window from the given starts covers."""
    edge = np.zeros(len(ws) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + n, len(ws)), -1)
    return [ws[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _hit(documents: tuple[np.ndarray, int]):
    """Documents that lose nothing get their digest at once; the others keep their text."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            maybe = in_bitmap(documents[0], ids.fill_null(0).to_numpy(zero_copy_only=False), documents[1]) & ids.is_valid().to_numpy(zero_copy_only=False)
            texts, counts, shas = [], [], []
            for text, later in zip(batch.column(1).to_pylist(), maybe):
                ws = split_words(text)
                counts.append(len(ws))
                texts.append(text if later else None)
                shas.append(None if later else hashlib.sha256(b" ".join(ws)).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()), pa.array(counts, pa.int64()), pa.array(shas, pa.string())], ["id", "text", "n_words", "sha"])

    return run


def _finish(n: int):
    def run(batches):
        for batch in batches:
            removed, shas = [], []
            for text, count, sha, at in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                if sha is None:
                    kept = kept_words(split_words(text), np.array(at or [], dtype=np.int64), n)
                    removed.append(count - len(kept))
                    shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                else:
                    removed.append(0)
                    shas.append(sha)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _cut(n: int):
    def run(batches):
        for batch in batches:
            out = [None if t is None else t if not at else b" ".join(kept_words(split_words(t), np.array(at, dtype=np.int64), n)) for t, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array([None if t is None else t.decode("utf-8", "replace") for t in out], pa.string()), *rest], batch.schema.names[:1] + batch.schema.names[2:])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, n: int = WINDOW, a: int = ANCHOR) -> DataFrame:
    """docs whose text has lost repeated windows; texts that lose none stay as they are,
    of others the kept words are joined by one space."""
    gone = repeated_windows(docs, id_col, text_col, batches, n, a).groupBy("doc").agg(F.collect_list("at").alias("at"))
    rest = [c for c in docs.columns if c != text_col]
    both = docs.join(gone, docs[id_col] == gone["doc"], "left").select(docs[text_col].cast("binary").alias(text_col), gone["at"].alias("__at"), *[docs[c] for c in rest])
    schema = ", ".join([f"`{text_col}` string", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]])
    return both.mapInArrow(_cut(n), schema).select(*docs.columns)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    gone = repeated_windows(docs, "id").groupBy("doc").agg(F.collect_list("at").alias("at"))
    marked = docs.mapInArrow(_hit(bitmap(gone, F.col("doc"))), "id long, text binary, n_words long, sha string")
    both = marked.join(gone, marked["id"] == gone["doc"], "left").select("id", "text", "n_words", "sha", "at")
    return both.mapInArrow(_finish(WINDOW), "doc_id long, n_words long, n_removed long, kept_sha256 string")
