"""Fuzzy duplicate lines by MinHash over character shingles.

A line that has a word is named by 128 bits of the hash of its bytes without outer
ASCII spaces, the first half of which is its node, so exact copies are one from the
start. Lines of at least 8 characters, which have a shingle, get a one-permutation
MinHash signature of their 8-character shingles (empty bins filled from the next bin),
cut into 14 bands of 5 rows, which pairs lines of similarity 0.8 with a probability of
0.996. Band keys travel as packed 8-byte values, once per task, only to find keys that
two lines share. Members of shared keys are compared on all their shingles (exact
Jaccard, 0.8 or more) and joined by distributed union-find. Of each component the first
line by (doc_id, line number) stays; the others go, in the same document too.

Lines without a word stay as they are. Null text stays null, a null doc_id leaves
the row alone, rows that share a doc_id count as one document. A document of which
no line is left keeps its row with an empty text. Empty input gives empty output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, partitions, saved, table
from .hashing import PRIME, U, bitmap, in_bitmap, mixed
from .unionfind import components, links_of_buckets

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 14, 5
#: Characters worked on at a time, and bytes of band keys a task gathers.
CHUNK, CHUNK_LINES, GATHERED = 4_000_000, 200_000, 64 << 20
#: Characters of lines whose shingles a task remembers while it compares pairs.
REMEMBERED = 2_000_000


def nodes_of(text: bytes) -> tuple[list[int], list[bytes]]:
    """Numbers and contents of the lines of a text that have a word."""
    at, lines = [], []
    for i, line in enumerate(text.split(b"\n")):
        line = line.strip(b" \t\n\x0b\x0c\r")
        if line:
            at.append(i)
            lines.append(line)
    return at, lines


def names(lines: list[bytes]) -> np.ndarray:
    """(node, check) of every line: the halves of its 128-bit hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)


def shingles(lines: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-character shingles of lines without line ends, and their lines."""
    text = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(text) < n:
        return np.empty(0, U), np.empty(0, np.int64)
    ends = text == 10
    owner = np.cumsum(ends) - ends
    inside = owner[: len(text) - n + 1] == owner[n - 1 :]
    inside &= ~ends[n - 1 :]
    # hashes of runs of twice the length from those of the two halves, then the rest
    h, p, length = text.astype(U), PRIME, 1
    while 2 * length <= n:
        h = h[:-length] * U(p) + h[length:]
        length, p = 2 * length, p * p % (1 << 64)
    for k in range(length, n):
        h = h[:-1] * U(PRIME) + text[k:].astype(U)
    return mixed(h[inside]), owner[: len(text) - n + 1][inside]


def signatures(lines: list[str], k: int, n: int = SHINGLE) -> np.ndarray:
    """One-permutation MinHash, one row per line; each line has at least n characters."""
    none = U(0xFFFFFFFFFFFFFFFF)
    h, owner = shingles(lines, n)
    sig = np.full(len(lines) * k, none, dtype=U)
    np.minimum.at(sig, owner * k + ((h >> U(32)) * U(k) >> U(32)).astype(np.int64), h & U(0xFFFFFFFF))
    sig = sig.reshape(len(lines), k)
    open_ = np.flatnonzero((sig == none).any(axis=1))
    while len(open_):
        part = sig[open_]
        right = np.roll(part, -1, axis=1)
        fill = (part == none) & (right != none)
        part[fill] = right[fill] + U(0x100000001)
        sig[open_] = part
        open_ = open_[(part == none).any(axis=1)]
    return sig


def band_keys(lines: list[str], bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE) -> np.ndarray:
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=U) * U(PRIME)), (len(lines), bands)).copy()
    sig = signatures(lines, bands * rows, n).reshape(len(lines), bands, rows)
    for j in range(rows):
        key = mixed(key * U(PRIME) + sig[:, :, j])
    return key


PACKED = "node array<long>, check array<long>, id array<long>, line array<int>, nodes binary, keys binary"


def _sign(bands: int, rows: int, n: int):
    """One row per chunk of text: every line's name, document and number; and as packed
    values the nodes and band keys of lines that are long enough, each once per task."""
    def run(batches):
        done: set[bytes] = set()
        for batch in batches:
            found, owners, numbers, ids, lines, chars = [], [], [], [], [], 0

            def pack():
                keys = band_keys(lines, bands, rows, n) if lines else np.empty(0, U)
                name = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                cols = [pa.array([x], pa.list_(pa.int64())) for x in (name[:, 0], name[:, 1], np.array(owners, np.int64))]
                nodes = np.frombuffer(b"".join(ids), np.int64)[::2]
                return pa.RecordBatch.from_arrays([*cols, pa.array([np.array(numbers, np.int32)], pa.list_(pa.int32())), pa.array([nodes.tobytes()], pa.binary()), pa.array([keys.tobytes()], pa.binary())],
                                                  ["node", "check", "id", "line", "nodes", "keys"])

            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, here = nodes_of(text or b"")
                numbers += at
                owners += [i] * len(at)
                digests = list(map(xxhash.xxh3_128_digest, here))
                found += digests
                for x, line in zip(digests, here):
                    if len(line) < n or x in done:
                        continue
                    if len(done) > 2_000_000:
                        done.clear()
                    done.add(x)
                    s = line.decode("utf-8", "replace")
                    if len(s) >= n:
                        ids.append(x)
                        lines.append(s)
                        chars += len(s)
                if chars > CHUNK or len(found) > CHUNK_LINES:
                    yield pack()
                    found, owners, numbers, ids, lines, chars = [], [], [], [], [], 0
            if found:
                yield pack()

    return run


def packed_keys(nodes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """48 bits of each band key and 16 of a hash of key and node. Two nodes that agree in
    those 16 bits of one key differ in those of other keys."""
    tag = mixed(keys ^ mixed(nodes.view(U))[:, None] * U(PRIME)) >> U(48)
    return (keys & U(0xFFFFFFFFFFFF0000)) | tag


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _keys_out(buckets: int, bands: int):
    """(bucket, packed keys): each once per batch."""
    def run(batches):
        for batch in batches:
            every = [packed_keys(np.frombuffer(nodes, np.int64), np.frombuffer(keys, U).reshape(-1, bands)).ravel() for nodes, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            packed = distinct(np.concatenate(every)) if every else np.empty(0, U)
            cuts = np.searchsorted((packed >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1, dtype=U))
            rows = [(b, packed[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "packed"])

    return run


def _shared(batches):
    """Keys (without their low 16 bits) that two different nodes of a partition have."""
    every = [np.frombuffer(x, U) for batch in batches for x in batch.column(1).to_pylist()]
    key = distinct(np.concatenate(every) if every else np.empty(0, U)) >> U(16)
    yield pa.RecordBatch.from_arrays([pa.array(distinct(key[1:][key[1:] == key[:-1]]).astype(np.int64), pa.int64())], ["key"])


def _members(wanted: np.ndarray, bits: int, bands: int):
    def run(batches):
        for batch in batches:
            for nodes, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = (np.frombuffer(keys, U).reshape(-1, bands) >> U(16)).astype(np.int64)
                line, band = np.nonzero(in_bitmap(wanted, key.ravel(), bits).reshape(key.shape))
                yield pa.RecordBatch.from_arrays([pa.array(key[line, band], pa.int64()), pa.array(np.frombuffer(nodes, np.int64)[line], pa.int64())], ["key", "node"])

    return run


def _texts(wanted: np.ndarray, bits: int, n: int):
    """(node, check, text) of lines that may be wanted, each once per batch."""
    def run(batches):
        for batch in batches:
            lines = [line for text in batch.column(0).to_pylist() for line in nodes_of(text or b"")[1] if len(line) >= n]
            name = names(lines)
            yes = np.flatnonzero(in_bitmap(wanted, name[:, 0], bits)) if len(lines) else ()
            found = {lines[i]: name[i] for i in yes}
            node, check = (pa.array([x[k] for x in found.values()], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([node, check, pa.array([x.decode("utf-8", "replace") for x in found], pa.string())], ["node", "check", "text"])

    return run


def _measured(n: int):
    """(a, b, common, na, nb) of pairs (a, b, pa, pb), by their texts' shingle sets."""
    def run(batches):
        def parts(s: str) -> set[str]:
            return {s[i : i + n] for i in range(len(s) - n + 1)}

        for batch in batches:
            known, chars = {}, 0
            out = [], [], []
            for x, y, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                if chars > REMEMBERED:
                    known, chars = {}, 0
                p, q = known.get(x), known.get(y)
                if p is None:
                    p = known[x] = parts(s)
                    chars += len(s)
                if q is None:
                    q = known[y] = parts(t)
                    chars += len(t)
                for col, value in zip(out, (len(p & q), len(p), len(q))):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int32()) for c in out)], ["a", "b", "common", "na", "nb"])

    return run


def _cells(n: int):
    """The distinct shingles of lines, as 64-bit hashes."""
    def of(lines: list[str]) -> list[np.ndarray]:
        h, owner = shingles(lines, n)
        ends = np.searchsorted(owner, np.arange(len(lines) + 1))
        return [np.unique(h[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    return of


def signed_lines(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE) -> DataFrame:
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null and text is not null")
    return saved(raw.mapInArrow(_sign(bands, rows, n), PACKED), "signed")


def line_components(docs: DataFrame, signed: DataFrame, text_col: str, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE) -> DataFrame:
    """(node, check, component) of lines that have near copies, other than exact ones."""
    spark = docs.sparkSession
    signed = signed.select("nodes", "keys")
    volume = signed.agg(F.sum(F.length("keys"))).head()[0] or 0
    parts = max(partitions(spark), -(-volume // GATHERED))
    shared = signed.mapInArrow(_keys_out(4 * parts, bands), "bucket int, packed binary").repartition(parts, "bucket").mapInArrow(_shared, "key long")
    shared = saved(shared, "shared")
    found = signed.mapInArrow(_members(*bitmap(shared, F.col("key")), bands), "key long, node long")
    members = saved(found.distinct().join(shared, "key"), "members")
    texts = docs.select(F.col(text_col).cast("binary").alias("text")).where("text is not null")
    lines = texts.mapInArrow(_texts(*bitmap(members.select("node").distinct(), F.col("node")), n), "node long, check long, text string")
    lines = saved(lines.dropDuplicates(["node"]), "lines")

    def measured(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(lines.select(F.col("node").alias("a"), F.col("text").alias("pa")), "a").join(lines.select(F.col("node").alias("b"), F.col("text").alias("pb")), "b")
        return pairs.select("a", "b", "pa", "pb").mapInArrow(_measured(n), "a long, b long, common int, na int, nb int")

    links = links_of_buckets(members, measured, lines.select("node", "text"), _cells(n), similarity)
    return saved(components(links).join(lines.select("node", "check"), "node"), "components")


def removed_lines(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, **shape) -> DataFrame:
    """(id, gone): the numbers of the lines to remove, for documents that lose any."""
    signed = signed_lines(docs, id_col, text_col, **shape)
    lines = signed.select(F.inline(F.arrays_zip("node", "check", "id", "line")))
    comp = line_components(docs.where(F.col(id_col).isNotNull()), signed, text_col, similarity, shape.get("bands", BANDS), shape.get("rows", ROWS), shape.get("n", SHINGLE))
    first = lines.groupBy("node", "check").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n"))
    first = saved(first.join(comp, ["node", "check"], "left").where("n > 1 or component is not null"), "first")
    heads = first.where("component is not null").groupBy("component").agg(F.min("first").alias("head"))
    own = first.join(heads, "component", "left").select("node", "check", F.coalesce("head", "first").alias("first"))
    goes = lines.join(own, ["node", "check"]).where("id <> first.id or line <> first.line")
    return goes.groupBy("id").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the text of its kept lines, and n_lines (with a word) and n_removed."""
    gone = saved(removed_lines(docs, id_col, text_col, **options), "gone")
    key, which = fresh(docs, "__id", "__gone")
    # texts travel to what they lose at every size: one plan, whose cost follows the input
    out = docs.join(gone.select(F.col("id").alias(key), F.col("gone").alias(which)).hint("merge"), F.col(id_col) == F.col(key), "left")

    def left(lines):
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(which))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    n_lines, n_removed = fresh(docs, "n_lines", "n_removed")
    had = F.size(F.filter(F.split(F.col(text_col), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    kept = F.when(F.col(which).isNull(), F.col(text_col)).otherwise(let(F.split(F.col(text_col), "\n"), left))
    return out.select(*[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns],
                      F.when(F.col(text_col).isNull(), 0).otherwise(had).cast("long").alias(n_lines), F.when(F.col(which).isNull(), 0).otherwise(F.size(which)).cast("long").alias(n_removed))


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, the text that is left, n_lines and n_removed."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
