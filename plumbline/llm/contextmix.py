"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a sequence of words and one end. Each word is a symbol of 8 bits: the 191 most
frequent words of the training documents have symbols of their own, the end has one, all
other words of training share 63 symbols by a hash of their ending, and one symbol says
that a new word follows, which is then spelled in bytes. Words that training has once
teach what comes before new words and how these are spelled. So

    P(text) = product of P(symbol | text before) * P(word | symbol) * P(spelling)

where P(word | symbol) is the word's share of the symbol's training count and spellings
are texts of bytes, modelled like the texts of symbols. The most frequent words are the
only vocabulary that is gathered; words and their counts stay in Spark tables, in which
blocks of documents look theirs up, part by part, and none is dropped. Which documents a block
has, and in which order, follows from a hash of id and text and from the size of all
texts, so that neither the model nor a score depends on how the input is partitioned.

Each bit is predicted in five contexts: the two symbols before, the one before, the
second before alone (a sparse pair), and, learned in the text itself, none and the one
before (hashed). A mixer adds the stretched probabilities by weights which a gate chooses
(the bit's place and how often the two symbols before were seen in training), and an
adaptive map refines the sum. The text's own changes of the weights and its own predictors
are updated after every bit, in the order of the text. They restart every SEGMENT symbols,
so that parts of texts are worked on side by side, whatever their length; the symbols
before are known across such a cut. Where weights start, and the map, are learned bit by
bit from all training documents, in two folds (odd and even remainders), each predicted
from the other's counts: each block learns by itself, and the blocks' weights are averaged
by their bits, in whole numbers, whose sums are the same in any order.

Null text is empty and scores its end alone. Rows that repeat score alike. A null
doc_id counts as training. Words are told apart by 64 bits. Empty input gives empty output.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, saved, table
from .hashing import U

NEW, END, TOP, ENDINGS = 0, 1, 191, 63
FIRST_ENDING = 2 + TOP
#: Bytes of text in a block, symbols until online states restart, rows worked on at a time.
BLOCK_BYTES, SEGMENT, WIDTH = 8_000_000, 512, 2048
#: Bytes of words that a part of the vocabulary should get, and tasks that sum contexts.
PART_BYTES, CONTEXT_PARTS = 16 << 20, 32
#: Stretched probabilities are kept in steps of 1 / SCALE, up to 127 of them.
SCALE = 12.0
INPUTS, GATES, BINS = 3, 8 * 8, 33
#: Learned weights are summed in steps of 1 / STEPS.
STEPS = 1 << 16
#: Entries of a segment's own hashed contexts; what weights and own contexts move by.
OWN = 2048
RATE, SHARED_RATE, OWN_RATES = 0.002, 0.02, (0.05, 0.15)


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10, F.lit(2)).cast("int")


def packed(x: np.ndarray) -> bytes:
    """An array's bytes, first those of all values' first bytes and so on, compressed."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, kind) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).reshape(-1).view(kind)


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    """A batch for a schema of longs and binaries."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


# the words of blocks and their counts

BLOCKS = "block long, ids binary, rest binary, sizes binary, lengths binary, tokens binary, words binary, keys binary, first binary, second binary, n_words long, n_train long, n_ends long"


class _Endings(dict):
    def __missing__(self, ending: bytes) -> int:
        value = self[ending] = xxhash.xxh3_64_intdigest(ending) % ENDINGS
        return value


def word_keys(words: list[bytes], endings: _Endings) -> np.ndarray:
    """58 bits of a word's hash and the symbol that its ending has."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    ending = np.fromiter((endings[w[-2:]] for w in words), U, len(words))
    return h & ~U(63) | ending


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The documents (chunk, rest, id, text) of a block: one chunk's, BLOCK_BYTES and the
    rest of a text at most."""
    docs, size, last = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if docs and (row[0] != last or size >= BLOCK_BYTES):
                yield docs
                docs, size = [], 0
            docs.append(row)
            last, size = row[0], size + len(row[3] or b"")
    if docs:
        yield docs


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as blocks: ids (null: the smallest long), each document's words as places
    in the block's list of words, which is sorted by key, and how often either fold has
    them."""
    endings, made = _Endings(), TaskContext.get().partitionId() << 32
    for docs in _grouped(batches):
        ids = np.array([-(1 << 63) if i is None else i for _, _, i, _ in docs], np.int64)
        r = np.array([rest for _, rest, _, _ in docs], np.uint8)
        place: dict[bytes, int] = defaultdict(count().__next__)
        found, sizes = [], []
        for _, _, _, text in docs:
            words = (text or b"").lower().split()
            found.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
            sizes.append(len(text or b""))
        words = list(place)
        key = word_keys(words, endings)
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        lengths = np.array([len(x) for x in found], np.int32)
        tokens = rank[np.concatenate(found)]
        fold = np.repeat(np.where(r > 0, 1 + r % 2, 0), lengths)
        counts = [np.bincount(tokens[fold == f], minlength=len(words)).astype(np.uint32) for f in (1, 2)]
        yield _rows(BLOCKS, [(made, ids.tobytes(), r.tobytes(), packed(np.array(sizes, np.int64)), packed(lengths), packed(tokens), packed(np.frombuffer(b" ".join(words[i] for i in order), np.uint8)),
                              key[order].tobytes(), packed(counts[0]), packed(counts[1]), len(words), int((fold > 0).sum() + (r > 0).sum()), int((r > 0).sum()))])
        made += 1


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, rest, id, text), a chunk's rows together and in the order of their hash.
    There are as many chunks as BLOCK_BYTES go into all texts, whatever the cluster."""
    spark = docs.sparkSession
    raw = docs.select(remainder(F.col(id_col)).alias("rest"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    size = raw.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    chunks = max(1, -(-size // BLOCK_BYTES))
    h = F.xxhash64("id", "text")
    dealt = raw.withColumn("h", h).withColumn("chunk", F.pmod("h", F.lit(chunks)))
    parts = min(chunks, max(partitions(spark), chunks // 16))
    placed = dealt.repartitionById(parts, F.pmod("chunk", F.lit(parts)).cast("int"))
    return placed.sortWithinPartitions("chunk", "h").select("chunk", "rest", "id", "text")


def _asks(parts: int):
    """(part, block, keys, counts): the words of a block by part of the vocabulary."""
    def run(batches):
        for batch in batches:
            for block, keys, first, second in zip(*(c.to_pylist() for c in batch.columns)):
                key = np.frombuffer(keys, U)
                n = unpacked(first, np.uint32) + unpacked(second, np.uint32)
                cuts = np.searchsorted((key >> U(32)) * U(parts) >> U(32), np.arange(parts + 1, dtype=U))
                yield _rows("part long, block long, keys binary, n binary", [(p, block, packed(np.diff(key[a:b], prepend=U(0))), packed(n[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a])

    return run


def _answers(batches):
    """(block, part, c): training counts of the words that a block asks for; and one row per
    part (block -1) with its number of known words, counts by ending, keys and counts of its
    most frequent words."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for part, asks in groupby(rows, key=lambda r: r[0]):
        blocks, keys, counts = list(zip(*asks))[1:]
        asked = [np.cumsum(unpacked(x, U), dtype=U) for x in keys]
        key, at = np.unique(np.concatenate(asked), return_inverse=True)
        c = np.bincount(at.ravel(), np.concatenate([unpacked(x, np.uint32) for x in counts]), len(key)).astype(np.int64)
        ends = np.cumsum([0, *map(len, asked)])
        for block, a, b in zip(blocks, ends[:-1], ends[1:]):
            yield _rows(ANSWERS, [(block, part, packed(c[at[a:b]].astype(np.uint64)), 0, b"", b"", b"")])
        top = np.lexsort((key.view(np.int64), -c))[:TOP]
        top = top[c[top] > 1]
        by_ending = np.bincount((key & U(63)).astype(np.int64), c, 64).astype(np.int64)
        yield _rows(ANSWERS, [(-1, part, b"", int((c > 0).sum()), by_ending.tobytes(), key[top].tobytes(), c[top].tobytes())])


ANSWERS = "block long, part long, c binary, known long, by_ending binary, top_keys binary, top_counts binary"


class Vocabulary:
    """What documents must know besides their words' counts; its size is fixed."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, by_ending: np.ndarray, total: int, ends: int, distinct: int):
        order = np.argsort(keys)
        self.keys, self.symbols = keys[order], (2 + np.arange(len(keys)))[order].astype(np.uint8)
        self.by_ending = by_ending.copy()
        np.subtract.at(self.by_ending, (keys & U(63)).astype(np.int64), counts)
        self.total, self.ends, self.distinct = total, ends, distinct

    def symbols_of(self, key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, log10 of the word's share of it) of words with these counts."""
        ending = (key & U(63)).astype(np.int64)
        symbol = np.where(c > 0, FIRST_ENDING + ending, NEW).astype(np.uint8)
        share = np.where(c > 0, np.log10(np.maximum(c, 1)) - np.log10(np.maximum(self.by_ending, 1))[ending], 0.0)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            own = self.keys[at] == key
            symbol[own] = self.symbols[at[own]]
            share[own] = 0.0
        return symbol, share

    def base(self, c) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


#: Texts to score, and those to learn from.
TEXTS = ("symbols", "lengths", "spelled", "spelled_lengths")
LESSONS = ("learn_symbols", "learn_lengths", "learn_spelled", "learn_spelled_lengths")
STREAMS = "ids binary, rest binary, sizes binary, known binary, base binary, share binary, learn_rest binary, " + ", ".join(f"{n} binary" for n in TEXTS + LESSONS)


def _texts(symbol: np.ndarray, doc: np.ndarray, n: int, word: np.ndarray, spelling: list[bytes]) -> list[bytes]:
    """Packed symbols and lengths, spelled bytes and lengths, of n documents whose words
    have these symbols; the end stands after each document's words."""
    stream = np.full(len(symbol) + n, END, np.uint8)
    stream[np.arange(len(symbol)) + doc] = symbol
    new = np.flatnonzero(symbol == NEW)
    spelled = [spelling[i] + b" " for i in word[new].tolist()]
    size = np.bincount(doc[new], np.fromiter(map(len, spelled), np.int64, len(spelled)), n).astype(np.int64)
    return [packed(x) for x in (stream, np.bincount(doc, minlength=n) + 1, np.frombuffer(b"".join(spelled), np.uint8), size)]


def _streams(vocabulary):
    """Blocks with the counts of their words as texts of symbols and of spelled bytes."""
    def run(batches):
        v = vocabulary.value
        for batch in batches:
            for ids, rest, sizes, lengths, tokens, words, keys, got in zip(*(x.to_pylist() for x in batch.columns)):
                key, n = np.frombuffer(keys, U), unpacked(lengths, np.int32).astype(np.int64)
                c = np.concatenate([unpacked(x, np.uint64) for x in got or ()] or [np.empty(0, U)]).astype(np.int64)
                symbol, share = v.symbols_of(key, c)
                at, r = unpacked(tokens, np.uint32), np.frombuffer(rest, np.uint8)
                doc = np.repeat(np.arange(len(n)), n)
                spelling = unpacked(words, np.uint8).tobytes().split(b" ")
                known = np.bincount(doc, (c > 0)[at], len(n)).astype(np.int64) + (v.ends > 0)
                sums = [np.bincount(doc, x[at], len(n)) for x in (v.base(c), share)]
                texts = _texts(symbol[at], doc, len(n), at, spelling)
                # what occurs once is new where it occurs
                learn = (r > 0)[doc]
                lessons = _texts(np.where(c > 1, symbol, NEW).astype(np.uint8)[at[learn]], (np.cumsum(r > 0) - 1)[doc[learn]], int((r > 0).sum()), at[learn], spelling)
                yield _rows(STREAMS, [(ids, rest, sizes, packed(known), packed(sums[0] + v.base(v.ends)), packed(sums[1]), r[r > 0].tobytes(), *texts, *lessons)])

    return run


# contexts learned from training documents

def before(stream: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two before each of the texts that stand one after another."""
    first = np.cumsum(lengths) - lengths
    one = np.concatenate(([start], stream[:-1])).astype(np.uint8)[: len(stream)]
    one[first[lengths > 0]] = start
    two = np.concatenate(([start], one[:-1])).astype(np.uint8)[: len(stream)]
    two[first[lengths > 0]] = start
    return one, two


#: What stands before a text of symbols and one of spellings.
STARTS = (END, 32)


def _texts_of(row: tuple, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(stream, lengths) of a row of symbols, lengths, spelled, spelled_lengths."""
    symbols, lengths, spelled, spelled_lengths = row
    return (unpacked(symbols, np.uint8), unpacked(lengths, np.int64)) if kind == 0 else (unpacked(spelled, np.uint8), unpacked(spelled_lengths, np.int64))


def _contexts(batches):
    """(part, kind, fold, codes, counts): how often two symbols and the next one occur."""
    for batch in batches:
        for rest, *row in zip(*(c.to_pylist() for c in batch.columns)):
            r = np.frombuffer(rest, np.uint8)
            for kind in (0, 1):
                stream, lengths = _texts_of(row, kind)
                one, two = before(stream, lengths, STARTS[kind])
                code = two.astype(np.uint32) << 16 | one.astype(np.uint32) << 8 | stream
                of = np.repeat(1 + r % 2, lengths)
                for fold in (1, 2):
                    x, n = np.unique(code[of == fold], return_counts=True)
                    cuts = np.searchsorted(x, np.arange(CONTEXT_PARTS + 1) * (1 << 24) // CONTEXT_PARTS)
                    yield _rows(CONTEXTS, [(p, kind, fold, packed(np.diff(x[a:b], prepend=np.uint32(0))), packed(n[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a])


CONTEXTS = "part long, kind long, fold long, codes binary, n binary"


def states(counts: np.ndarray) -> np.ndarray:
    """For counts (contexts, 256), what each context's nodes predict, (contexts, 256): the
    stretched probability plus 128 in the low byte, the level of the node's count above it.
    Node 1 is the first bit, 2 n and 2 n + 1 follow n. Nodes never seen say 0 at level 0."""
    out = np.full(counts.shape, 128, np.uint16)
    for bit in range(8):
        n = counts.reshape(len(counts), 1 << bit, 2, -1).sum(axis=3)
        total = n.sum(axis=2)
        with np.errstate(divide="ignore"):
            value = np.clip(np.rint(np.log((n[:, :, 1] + 0.05) / (n[:, :, 0] + 0.05)) * SCALE), -127, 127).astype(np.int64)
            level = np.minimum(np.log2(total + 1).astype(np.int64) // 2 + 1, 7)
        out[:, 1 << bit : 2 << bit] = np.where(total > 0, level << 8 | value + 128, 128)
    return out


def _tables(batches):
    """(kind, version, part, pairs, ones, skips): states of the contexts of a part in all
    counts (version 0) and either fold's (1, 2); counts of single symbols before, of which
    each part has a share; states of the second symbol before."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    width = (1 << 24) // CONTEXT_PARTS
    for (part, kind), given in groupby(rows, key=lambda r: r[:2]):
        n = np.zeros((3, width), np.int64)
        for _, _, fold, codes, counts in given:
            at = np.cumsum(unpacked(codes, np.uint32), dtype=np.uint32).astype(np.int64) - part * width
            n[fold, at] += unpacked(counts, np.uint32)
        n[0] = n[1] + n[2]
        for version in range(3):
            cube = n[version].reshape(-1, 256, 256)
            yield _rows(TABLES, [(kind, version, part, packed(states(cube.reshape(-1, 256)).ravel()), packed(cube.sum(axis=0).ravel()), packed(states(cube.sum(axis=1)).ravel()))])


TABLES = "kind long, version long, part long, pairs binary, ones binary, skips binary"


class Tables:
    """Predictions by the symbols before, of fixed size: 2^24 nodes for two of them, which
    have 8 times the value plus the level."""

    def __init__(self, rows: list[tuple] = ()):
        """rows: part, pairs, ones, skips."""
        self.pairs = np.zeros(1 << 24, np.int16)
        ones, skips = np.zeros((256, 256), np.int64), np.full((256, 256), 128, np.uint16)
        width, high = (1 << 24) // CONTEXT_PARTS, 256 // CONTEXT_PARTS
        for part, pairs, one, skip in rows:
            state = unpacked(pairs, np.uint16)
            self.pairs[part * width : (part + 1) * width] = ((state & 255).astype(np.int16) - 128) * 8 + (state >> 8).astype(np.int16)
            ones += unpacked(one, np.int64).reshape(256, 256)
            skips[part * high : (part + 1) * high] = unpacked(skip, np.uint16).reshape(-1, 256)
        self.one, self.skip = (self._value(x).ravel() for x in (states(ones), skips))

    def __getstate__(self) -> tuple:
        """Contexts never seen, the most by far in small corpora, take no room on the way."""
        return packed(self.pairs), self.one, self.skip

    def __setstate__(self, state: tuple) -> None:
        self.pairs, (self.one, self.skip) = unpacked(state[0], np.int16), state[1:]

    @staticmethod
    def _value(state: np.ndarray) -> np.ndarray:
        return (((state & 255).astype(np.float32) - 128) / np.float32(SCALE)).astype(np.float32)


# mixing

class Mixer:
    """Where the weights by gate (INPUTS, GATES) and the map (8, BINS) start."""

    def __init__(self, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.weights = np.full((INPUTS, GATES), 0.4, np.float32) if weights is None else weights.astype(np.float32)
        centre = 1 / (1 + np.exp(-np.linspace(-8, 8, BINS)))
        self.map = np.tile(centre, (8, 1)).astype(np.float32) if refined is None else refined.astype(np.float32)


def segments(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of pieces of at most `size` symbols, longest first."""
    n = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), n)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(lengths) - lengths, n) + piece * size
    length = np.minimum(lengths[text] - piece * size, size)
    order = np.argsort(-length, kind="stable")
    return text[order], start[order], length[order]


def mixed(tables: Tables, mixer: Mixer, stream: np.ndarray, lengths: np.ndarray, start: int, learn: bool = False, size: int = SEGMENT):
    """The bits that each of the texts takes. With learn, the weights by gate are learned,
    one set for all texts, and (weights, times, ones), the last two being the map's counts,
    come back instead."""
    one, two = before(stream, lengths, start)
    text, at, length = segments(lengths, size)
    out = np.zeros(len(lengths))
    shared = mixer.weights.copy()
    seen = np.zeros((8 * BINS, 2))
    for a in range(0, len(text), WIDTH):
        few = slice(a, a + WIDTH)
        np.add.at(out, text[few], _together(tables, mixer, stream, one, two, at[few], length[few], shared, seen, learn))
    return (shared, seen.sum(axis=1), seen[:, 1]) if learn else out


def _together(tables: Tables, mixer: Mixer, stream, one, two, at, length, shared, seen, learn) -> np.ndarray:
    """Bits per segment (with learn: none are counted); all advance symbol by symbol side by
    side, longest first. The eight bits of a symbol have nodes and changes of their own, so
    none of them reads what another moves, and they go together.

    Stretched prediction: the contexts' values times (weight by gate + the segment's own
    change of it) + what the segment has learned in its own two contexts. Each of these
    moves by its rate times the error after the bit."""
    n, total = len(at), np.zeros(len(at))
    active = np.searchsorted(-length, -np.arange(int(length[0])) - 1, side="right")
    # the context of the symbol before, then the one of none
    own = np.zeros(n * (OWN + 256), np.float32)
    base0, base1 = n * OWN + np.arange(n) * 256, np.arange(n) * OWN
    moved = np.zeros((INPUTS, 8, n), np.float32)
    one_f, clip, refined = np.float32(1), "clip", mixer.map.ravel()
    bit = np.arange(8)[:, None]
    first_gate, first_spot = bit * 8, ((BINS - 1) / 2 + 0.5 + bit * BINS).astype(np.float32)
    rates = np.array(OWN_RATES, np.float32)[:, None, None]
    for step, m in enumerate(active):
        here = at[:m] + step
        symbol, c1, c2 = (x.take(here).astype(np.int64) for x in (stream, one, two))
        node, bits = symbol + 256 >> 8 - bit, symbol >> 7 - bit & 1
        wide = bits.astype(np.float32)
        i = np.empty((2, 8, m), np.int64)
        np.add(node, base0[:m], out=i[0])
        np.multiply(node, 0x2F, out=i[1])
        i[1] &= OWN - 1
        i[1] ^= base1[:m] + ((c1 * 0x9E35 + 0x55) & (OWN - 1))
        p = own.take(i, mode=clip)
        z = p[0] + p[1]
        state = tables.pairs.take(node + (c2 << 16 | c1 << 8), mode=clip)
        gate = (state & 7) + first_gate
        y = np.empty((INPUTS, 8, m), np.float32)
        np.multiply(state >> 3, np.float32(1 / SCALE), out=y[0])
        tables.one.take(node + (c1 << 8), out=y[1], mode=clip)
        tables.skip.take(node + (c2 << 8), out=y[2], mode=clip)
        change, w = moved[:, :, :m], shared.take(gate, axis=1, mode=clip)
        w += change
        w *= y
        for k in range(INPUTS):
            z += w[k]
        np.clip(z, -8, 8, out=z)
        q = np.negative(z)
        np.exp(q, out=q)
        q += one_f
        np.divide(one_f, q, out=q)
        z *= np.float32((BINS - 1) / 16)
        z += first_spot
        spot, error = z.astype(np.int64), wide - q
        p += error * rates
        own[i] = p
        np.multiply(y, error * np.float32(RATE), out=w)
        change += w
        if learn:
            seen += np.bincount((spot * 2 + bits).ravel(), minlength=seen.size).reshape(seen.shape)
            gate, y = gate.ravel(), y * error
            times = np.maximum(np.bincount(gate, minlength=GATES), 50)
            for k in range(INPUTS):
                shared[k] += np.bincount(gate, y[k].ravel(), GATES) / times * SHARED_RATE
        else:
            q += refined.take(spot, mode=clip)
            q *= np.float32(0.5)
            # 1 - p where the bit is 0
            q -= one_f - wide
            total[:m] -= np.log2(np.maximum(np.abs(q, out=q), np.float32(1e-9)).prod(axis=0, dtype=np.float64))
    return total


def _learned(tables):
    """(kind, at, value): sums over blocks of weights (in steps of 1 / STEPS) times bits,
    of bits, and of the map's counts, all whole; each fold's documents are predicted by
    the other fold's counts."""
    def run(batches):
        sums = np.zeros((2, GATES * INPUTS + 1 + 2 * 8 * BINS), np.int64)
        for batch in batches:
            for rest, *row in zip(*(c.to_pylist() for c in batch.columns)):
                r = np.frombuffer(rest, np.uint8)
                for kind in (0, 1):
                    stream, lengths = _texts_of(row, kind)
                    of, mixer = 1 + r % 2, Mixer()
                    for fold in (1, 2):
                        some = stream[np.repeat(of == fold, lengths)]
                        if len(some):
                            w, times, ones = mixed(tables.value[kind][3 - fold], mixer, some, lengths[of == fold], STARTS[kind], True)
                            # a block goes on with the weights that it has
                            mixer = Mixer(w, mixer.map)
                            whole = np.rint(w.ravel().astype(np.float64) * STEPS).astype(np.int64)
                            sums[kind] += np.concatenate([whole * len(some), [len(some)], np.rint(times).astype(np.int64), np.rint(ones).astype(np.int64)])
        for kind in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * sums.shape[1], pa.int64()), pa.array(np.arange(sums.shape[1])), pa.array(sums[kind])], ["kind", "at", "value"])

    return run


def fitted(sums: np.ndarray) -> Mixer:
    """The mixer for sums of what blocks have learned."""
    if not len(sums) or not sums[GATES * INPUTS]:
        return Mixer()
    weights = (sums[: GATES * INPUTS] / (sums[GATES * INPUTS] * STEPS)).reshape(INPUTS, GATES)
    times, ones = sums[GATES * INPUTS + 1 :].reshape(2, 8, BINS)
    return Mixer(weights, np.clip((ones + 20 * Mixer().map) / (times + 20), 1e-4, 1 - 1e-4))


SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits double, bits_per_byte double"


def _scored(tables, mixers, total: int):
    def run(batches):
        for batch in batches:
            for ids, rest, sizes, known, base, share, *row in zip(*(c.to_pylist() for c in batch.columns)):
                bits = -unpacked(share, np.float64) / np.log10(2)
                for kind in (0, 1):
                    stream, lengths = _texts_of(row, kind)
                    if len(stream):
                        bits = bits + mixed(tables.value[kind], mixers[kind], stream, lengths, STARTS[kind])
                i, size = np.frombuffer(ids, np.int64), unpacked(sizes, np.int64)
                none = i == -(1 << 63)
                columns = [pa.array(i, mask=none), pa.array(np.frombuffer(rest, np.uint8) == 0), pa.array(unpacked(row[1], np.int64)), pa.array(unpacked(known, np.int64)), pa.array(np.full(len(i), total)),
                           pa.array(unpacked(base, np.float64)), pa.array(-bits * np.log10(2)), pa.array(bits), pa.array(bits / np.maximum(size, 1), mask=size == 0)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCORED.split(", ")])

    return run


def _vocabulary(blocks: DataFrame, answers: DataFrame) -> Vocabulary:
    total, ends = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_ends"), F.lit(0))).head()
    stats = answers.where("block = -1")

    def unfolded(batches):
        for batch in batches:
            for keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["key", "c"])

    def endings(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(np.frombuffer(x, np.int64))], ["at", "c"])

    distinct = stats.agg(F.coalesce(F.sum("known"), F.lit(0))).head()[0]
    top = stats.select("top_keys", "top_counts").mapInArrow(unfolded, "key long, c long").orderBy(F.desc("c"), "key").limit(TOP).collect()
    by_ending = np.zeros(64, np.int64)
    for r in stats.select("by_ending").mapInArrow(endings, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).collect():
        by_ending[r["at"]] = r["c"]
    return Vocabulary(np.array([r["key"] for r in top], np.int64).view(U), np.array([r["c"] for r in top], np.int64), by_ending, total, ends, distinct + (ends > 0))


def model_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Vocabulary, list[Tables], list[Mixer]]:
    """All documents as texts of symbols, and the model of the training documents among
    them: the vocabulary, and tables and mixer for symbols and for spellings."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    blocks = saved(chunked(docs, id_col, text_col).mapInArrow(_blocks, BLOCKS), "blocks")
    size = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).head()[0] * 12
    parts = max(partitions(spark), -(-size // PART_BYTES))
    asks = blocks.select("block", "keys", "first", "second").mapInArrow(_asks(parts), "part long, block long, keys binary, n binary")
    answers = saved(asks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_answers, ANSWERS), "answers")
    vocabulary = _vocabulary(blocks, answers)
    got = answers.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "c"))).alias("got"))
    both = blocks.join(got.hint("merge"), "block", "left").select("ids", "rest", "sizes", "lengths", "tokens", "words", "keys", F.col("got.c").alias("got"))
    streams = saved(both.mapInArrow(_streams(share(vocabulary)), STREAMS), "streams")
    contexts = streams.select("learn_rest", *LESSONS).mapInArrow(_contexts, CONTEXTS)
    summed = contexts.repartition(CONTEXT_PARTS, "part").sortWithinPartitions("part", "kind").mapInArrow(_tables, TABLES)
    # 2 * 3 * CONTEXT_PARTS rows, of 2^24 nodes in all for each kind and version
    made = saved(summed, "contexts")

    def tables(version: int) -> list[Tables]:
        rows = made.where(F.col("version") == version).collect()
        return [Tables([tuple(r)[2:] for r in rows if r["kind"] == kind]) for kind in (0, 1)]

    folds = share([{1: a, 2: b} for a, b in zip(tables(1), tables(2))])
    learned = streams.select("learn_rest", *LESSONS).mapInArrow(_learned(folds), "kind long, at long, value long").groupBy("kind", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("double").alias("value")).collect()
    mixers = [fitted(np.array([v for _, v in sorted((r["at"], r["value"]) for r in learned if r["kind"] == kind)])) for kind in (0, 1)]
    folds.unpersist()
    return streams, vocabulary, tables(0), mixers


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits,
    bits_per_byte) per row; no bytes have no bits per byte."""
    streams, vocabulary, tables, mixers = model_of(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    return streams.select("ids", "rest", "sizes", "known", "base", "share", *TEXTS).mapInArrow(_scored(shared, mixers, vocabulary.total), SCORED)


def op5_contextmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by the model of those whose remainder is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs).withColumnRenamed("id", "doc_id")
