"""Near-duplicate documents by DartMinHash.

A document is the multiset of its 5-word shingles: a shingle that occurs m times
is an element whose weight region has m unit cells. Hashed darts arrive in every
cell as a Poisson process in time (exponential gaps drawn from the cell's hash),
each at a hashed coordinate; the earliest dart per coordinate is the signature.
Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity. Darts are thrown only up to the time by which all coordinates
are expected to be hit, k (ln k + 4) of them however large the document.

Bands of the signature are joined. Texts with equal shingles are one node. Small
band buckets are compared pair by pair, exactly and on all shingles (as 64-bit hashes).
In large ones the best connected member leads and is compared with the others, and who
is not linked to it with all fellows, block by block. So no link that any bucket holds
is lost, while a bucket of n copies costs n comparisons, not n * n.

Texts of one to four words have one shingle, the whole text. Null, empty and blank
texts have none: each is a class of its own. Rows that share a doc_id share a
class; a null doc_id gives a null class. Empty input gives empty output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, saved, table
from .hashing import PRIME, U, WordHashes, bitmap, in_bitmap, mixed, split_words, windows
from .unionfind import components, links_of_buckets

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Cells that are signed at a time.
CELLS = 100_000


def cells(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """One hash per unit of weight: (shingle, how often it came before), sorted by shingle."""
    if not len(hashes):
        return hashes
    s = windows(hashes, min(n, len(hashes)))
    s.sort()
    at = np.arange(len(s))
    first = np.concatenate(([True], s[1:] != s[:-1]))
    return mixed(s + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(U) * U(PRIME))


def signatures(cell: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The ids of the earliest darts at k coordinates, one row per document; cell holds
    the documents' cells one after another, sizes (above 0) how many each has."""
    out = np.zeros((len(sizes), k), dtype=U)
    todo = np.arange(len(sizes))
    until = (np.log(k) + 4) / sizes
    while len(todo):
        owner = np.repeat(np.arange(len(todo)), sizes[todo])
        left = cell if len(todo) == len(sizes) else cell[np.repeat(np.isin(np.arange(len(sizes)), todo), sizes)]
        when, n = np.zeros(len(left)), 0
        darts, times, places = [], [], []
        while len(left):
            n += 1
            dart = mixed(left + U(n * PRIME % (1 << 64)))
            when = when - np.log(((dart >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / k
            go = np.flatnonzero(when < until[todo[owner]])
            left, when, dart, owner = left[go], when[go], dart[go], owner[go]
            darts.append(dart)
            times.append(when)
            places.append(owner * k + (mixed(dart ^ U(PRIME)) % U(k)).astype(np.int64))
        darts, times, places = np.concatenate(darts), np.concatenate(times), np.concatenate(places)
        earliest = np.full(len(todo) * k, np.inf)
        np.minimum.at(earliest, places, times)
        won = times == earliest[places]
        ids = np.zeros(len(todo) * k, dtype=U)
        ids[places[won]] = darts[won]
        full = np.isfinite(earliest).reshape(len(todo), k).all(axis=1)
        out[todo[full]] = ids.reshape(len(todo), k)[full]
        todo = todo[~full]
        until = until * 2
    return out


def _sign(bands: int, rows: int, n: int):
    def run(batches):
        known = WordHashes()
        salt = mixed(np.arange(1, bands + 1, dtype=U) * U(PRIME))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                start, made, total = at, [], 0
                while at < len(texts) and total < CELLS:
                    made.append(cells(known.of(split_words(texts[at])), n))
                    total += len(made[-1])
                    at += 1
                sizes = np.array([len(c) for c in made])
                has = np.flatnonzero(sizes)
                keys = np.broadcast_to(salt, (len(has), bands)).copy()
                if len(has):
                    sig = signatures(np.concatenate(made), sizes[has], bands * rows).reshape(len(has), bands, rows)
                    for j in range(rows):
                        keys = mixed(keys * U(PRIME) + sig[:, :, j])
                listed = iter(keys.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), pa.array(sizes, pa.int64()), pa.array([xxhash.xxh3_128_digest(c.tobytes()) if len(c) else None for c in made], pa.binary()),
                                                  pa.array([next(listed) if m else None for m in sizes], pa.list_(pa.int64()))], ["id", "size", "content", "bands"])

    return run


def _prints(wanted: np.ndarray, bits: int, n: int):
    """(node, prints): the cells of documents that may be wanted."""
    def run(batches):
        known = WordHashes()
        for batch in batches:
            ids = batch.column(0)
            maybe = np.flatnonzero(in_bitmap(wanted, ids.to_numpy(zero_copy_only=False), bits))
            texts = batch.column(1).take(pa.array(maybe))
            prints = [np.unique(cells(known.of(split_words(t)), n)).view(np.int64) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(maybe)), pa.array(prints, pa.list_(pa.int64()))], ["node", "prints"])

    return run


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE) -> DataFrame:
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return raw.mapInArrow(_sign(bands, rows, n), "id long, size long, content binary, bands array<long>")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE) -> DataFrame:
    """(id, class_id, n_shingles) per row of docs; class_id is the smallest id of the class."""
    sig = saved(signed(docs, id_col, text_col, bands, rows, n), "signatures")
    known = sig.where("id is not null and content is not null")
    contents = saved(known.groupBy("content").agg(F.min("id").alias("node"), F.first("bands").alias("bands")), "contents")
    keyed = contents.select(F.explode("bands").alias("key"), "node")
    # a bucket's rows are kept if it has more than one node
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    members = saved(keyed.join(shared, "key"), "members")
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null")
    wanted = bitmap(members.select("node").distinct(), F.col("node"))
    # rows that share an id: each of its texts is a node of the same number, the largest stands for it
    prints = raw.mapInArrow(_prints(*wanted, n), "node long, prints array<long>").groupBy("node").agg(F.max_by("prints", F.size("prints")).alias("prints"))
    prints = saved(prints, "prints")

    def measured(pairs: DataFrame) -> DataFrame:
        both = pairs.join(prints.select(F.col("node").alias("a"), F.col("prints").alias("pa")), "a").join(prints.select(F.col("node").alias("b"), F.col("prints").alias("pb")), "b")
        return both.select("a", "b", F.size(F.array_intersect("pa", "pb")).alias("common"), F.size("pa").alias("na"), F.size("pb").alias("nb"))

    links = links_of_buckets(members, measured, prints, lambda found: [np.array(x, np.int64) for x in found], similarity)
    comp = saved(components(links), "components")
    root = contents.select("content", "node").join(comp, "node", "left").select("content", F.coalesce("component", "node").alias("root"))
    out = sig.join(root, "content", "left")
    return out.select("id", F.coalesce("root", "id").alias("class_id"), F.col("size").alias("n_shingles"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents that are not the first (smallest id) of their class."""
    gone = saved(classes(docs, id_col, text_col, similarity).where("class_id <> id").select("id").distinct(), "gone")
    (name,) = fresh(docs, "__id")
    return docs.join(gone.select(F.col("id").alias(name)), docs[id_col] == F.col(name), "left_anti")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest doc_id of its class and the size of its shingle set."""
    return classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
