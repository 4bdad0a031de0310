"""Phrases whose words stand together more often than chance, mined level by level.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and into
words at spaces and tabs. The occurrence relation of phrases of one length is stored
sorted by piece and position: tasks write chunks of bounded size, each with the places
of its occurrences (places of neighbouring words differ by 1, those of different pieces
by 2 or more) and a dictionary of the phrases that occur in it, with counts, dealt into
buckets by the phrase's hash.

A level joins each occurrence with its neighbour at the next place of the same piece, a
merge of two sorted relations, which gives the occurrences of phrases one word longer.
A phrase is the pair of the numbers of its first and last part, which overlap in all
but one word, so that keys stay two numbers at every length and no hash can mix
phrases. One shuffle brings the dictionaries of a bucket together. There they are
counted, phrases with at least LEAST occurrences get numbers, and each chunk is told
which of its entries those are: a semi-join, before the next level extends them. The
buckets are as many as the occurrences ask for, and a phrase is one entry per chunk at
most, however often it occurs. Nothing is broadcast or sent to the driver.

Scores use decimals of 38 digits; counts up to 10**15 fit. Null text is empty, a null
language is `und`. Repeated rows count as often as they occur. A piece longer than a
chunk stays whole. Empty input gives empty output.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, partitions, saved, small, table
from .hashing import PRIME, U, mixed
from .lloyd import pack, unpack

# Fixed values of the query's contract.
PIECE = rb"[.,;:!?\x0A-\x0D]"
LONGEST, LEAST, INSIDE_PERCENT, TOP = 3, 10, 50, 2000
#: Words of a chunk: its places and numbers take 8 MB, its dictionary a few times that.
CHUNK_WORDS = 1 << 20
#: Occurrences that a bucket is meant for, and how many phrases one can number.
BUCKET_OCCURRENCES, NUMBERS = 400_000, 1 << 24
#: Groups that share a language's ranking before its best are brought together.
SALTS = 64

#: Bucket -1 holds the relation itself (places, items), others their part of the
#: dictionary: items, key (heads and tails, or lengths and bytes of words), counts.
STORED = "chunk bigint, bucket int, size bigint, items binary, one binary, two binary, counts binary, lang array<string>, n array<bigint>"
SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("size", pa.int64()), ("items", pa.binary()), ("one", pa.binary()), ("two", pa.binary()), ("counts", pa.binary()), ("lang", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])


def squeezed(a: np.ndarray) -> bytes:
    """Packed numbers, all their first bytes before all second ones, compressed."""
    data = pack(a)
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, data[0]).T
    return zstandard.compress(data[:1] + planes.tobytes(), 1)


def spread(data: bytes) -> np.ndarray:
    data = zstandard.decompress(data)
    return unpack(data[:1] + np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1).T.tobytes())


def _stored(chunk: int, place: np.ndarray, item: np.ndarray, bucket: np.ndarray, keys, counts: np.ndarray, totals: Counter | None) -> pa.Table:
    """The rows of a chunk. keys(entries) packs the keys of some entries as two binaries.
    Entries are numbered in the order of their buckets, so that a bucket's are told by the
    first; words, of which few make up most occurrences, by falling count, which packs best."""
    order = np.argsort(-counts if totals else bucket, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    if totals:
        order = order[np.argsort(bucket[order], kind="stable")]
    parts = [p for p in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(p)]
    packed = [keys(p) for p in parts]
    n = len(parts) + 1
    columns = [[chunk] * n, [-1, *(int(bucket[p[0]]) for p in parts)], [len(place), *(len(p) for p in parts)],
               [squeezed(rank[item]), *(squeezed(np.diff(rank[p], prepend=0) if totals else rank[p[:1]]) for p in parts)], [squeezed(np.diff(place, prepend=0)), *(x for x, _ in packed)], [None, *(y for _, y in packed)],
               [None, *(squeezed(counts[p]) for p in parts)], [list(totals) if totals else None] + [None] * (n - 1), [list(totals.values()) if totals else None] + [None] * (n - 1)]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def _words(buckets: int, size: int):
    """(lang, text) to chunks of word occurrences. A word's key is word, space, language."""
    cut = re.compile(PIECE)

    def made(number, known, items, lengths, totals):
        item, lengths = np.frombuffer(items, dtype="i").astype(np.int64), np.array(lengths)
        place = np.arange(len(item)) + np.repeat(np.arange(len(lengths)), lengths)
        keys = [w + b" " + lang.encode() for lang, w in known]
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(k) % buckets for k in keys), dtype=np.int64, count=len(keys))
        return _stored(number, place, item, bucket, lambda p: (squeezed(np.array([len(keys[i]) for i in p])), zstandard.compress(b"".join([keys[i] for i in p]), 1)), np.bincount(item, minlength=len(keys)), totals)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        known, items, lengths, totals = {}, array("i"), [], Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                for piece in cut.split(text.lower()):
                    ws = piece.split()
                    if not ws:
                        continue
                    items.extend([known.setdefault((lang, w), len(known)) for w in ws])
                    lengths.append(len(ws))
                    totals[lang] += len(ws)
                    if len(items) >= size:
                        yield from made(number, known, items, lengths, totals).to_batches()
                        number += 1
                        known, items, lengths, totals = {}, array("i"), [], Counter()
        if items:
            yield from made(number, known, items, lengths, totals).to_batches()

    return run


def _extend(buckets: int):
    """A chunk's relation and its entries that stay (items, and numbers over all chunks)
    to the relation of phrases one word longer."""
    def run(relation, stay):
        if not relation.num_rows or not stay.num_rows:
            return SCHEMA.empty_table()
        item, place = spread(relation.column("items")[0].as_py()), np.cumsum(spread(relation.column("one")[0].as_py()))
        kept, ids = (np.concatenate([spread(x.as_py()) for x in stay.column(c)]) for c in ("items", "ids"))
        order = np.argsort(kept)
        kept, ids = kept[order], ids[order]
        dense = np.full(int(item.max()) + 1, -1, dtype=np.int64)
        dense[kept] = np.arange(len(kept))
        item = dense[item]
        place, item = place[item >= 0], item[item >= 0]
        # both relations are sorted by place: the neighbour at the next place, if any, is the next row
        pair = np.flatnonzero(place[1:] == place[:-1] + 1)
        if not len(pair):
            return SCHEMA.empty_table()
        keys, entry, n = np.unique(item[pair] * len(kept) + item[pair + 1], return_inverse=True, return_counts=True)
        head, tail = (ids[x] for x in np.divmod(keys, len(kept)))
        bucket = (mixed(head.astype(U) * U(PRIME) + tail.astype(U)) % U(buckets)).astype(np.int64)
        return _stored(relation.column("chunk")[0].as_py(), place[pair], entry, bucket, lambda p: (squeezed(np.diff(head[p], prepend=0)), squeezed(tail[p])), n, None)

    return run


#: A row per chunk with the entries that stay, and one per bucket, without a chunk, with its phrases.
COUNTED = "chunk bigint, items binary, ids binary, word array<binary>, head array<bigint>, tail array<bigint>, a array<bigint>, id array<bigint>"
COUNTED_SCHEMA = pa.schema([("chunk", pa.int64()), ("items", pa.binary()), ("ids", pa.binary()), ("word", pa.list_(pa.binary())), *[(c, pa.list_(pa.int64())) for c in ("head", "tail", "a", "id")]])


def _count(words: bool, least: int):
    """All dictionaries of a bucket: the frequent phrases, numbered, and who has them."""
    def run(key, rows):
        column = {c: [x.as_py() for x in rows.column(c)] for c in ("chunk", "items", "one", "two", "counts")}
        counts, sizes = np.concatenate([spread(x) for x in column["counts"]]), rows.column("size").to_numpy()
        if words:
            ends = np.cumsum(np.concatenate([spread(x) for x in column["one"]]))
            data = b"".join(zstandard.decompress(x) for x in column["two"])
            known: dict[bytes, int] = {}
            start, phrase = 0, np.empty(len(ends), dtype=np.int64)
            for i, end in enumerate(ends.tolist()):
                phrase[i] = known.setdefault(data[start:end], len(known))
                start = end
        else:
            (heads, h), (tails, t) = (np.unique(np.concatenate(x), return_inverse=True) for x in ([np.cumsum(spread(x)) for x in column["one"]], [spread(x) for x in column["two"]]))
            codes, phrase = np.unique(h * len(tails) + t, return_inverse=True)
            head, tail = np.divmod(codes, len(tails))
        total = np.bincount(phrase, weights=counts).astype(np.int64)
        often = np.flatnonzero(total >= least)
        if len(often) > NUMBERS:
            raise ValueError("too many frequent phrases in a bucket")
        number = np.full(len(total), -1, dtype=np.int64)
        number[often] = key[0].as_py() * NUMBERS + np.arange(len(often))
        names = list(known) if words else None
        lists = [[names[i] for i in often] if words else None, *(None if words else x.tolist() for x in ((None, None) if words else (heads[head[often]], tails[tail[often]]))), total[often].tolist(), number[often].tolist()]
        out = [[None], [None], [None], *[[x] for x in lists]]
        mine = np.split(number[phrase], np.cumsum(sizes)[:-1])
        for chunk, items, ids in zip(column["chunk"], column["items"], mine):
            has = ids >= 0
            if has.any():
                at = np.cumsum(spread(items)) if words else spread(items)[0] + np.arange(len(ids))
                for x, y in zip(out, (chunk, squeezed(at[has]), squeezed(ids[has]), None, None, None, None, None)):
                    x.append(y)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, COUNTED_SCHEMA)], schema=COUNTED_SCHEMA)

    return run


def buckets_for(spark: SparkSession, occurrences: int) -> int:
    return max(2 * partitions(spark), -(-occurrences // BUCKET_OCCURRENCES))


def counted(relation: DataFrame, words: bool, least: int) -> tuple[DataFrame, DataFrame]:
    """The relation's frequent phrases, and per chunk the entries that stay."""
    entries = relation.where("bucket >= 0").select("bucket", "chunk", "size", "items", "one", "two", "counts")
    out = saved(entries.groupBy("bucket").applyInArrow(_count(words, least), COUNTED), "counted")
    zipped = F.explode(F.arrays_zip(*(["word"] if words else ["head", "tail"]), "a", "id")).alias("d")
    return out.where("chunk is null").select(zipped).select("d.*"), out.where("chunk is not null").select("chunk", "items", "ids")


def mined(docs: DataFrame, text_col: str, lang_col: str, longest: int = LONGEST, least: int = LEAST, size: int = CHUNK_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of every length from 1 to longest, and all words per language. Words
    are (id, lang, word, a); longer phrases have the numbers of their parts, head and tail,
    and firsts and lasts, the counts of all they start and end with, instead of the word."""
    spark = docs.sparkSession
    kept = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    # a word and its space have six bytes or so; the number only says how work is dealt
    n = (kept.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // 6
    relation = saved(kept.mapInArrow(_words(buckets_for(spark, n), size), STORED), "occurrences")
    totals = saved(relation.where("bucket = -1").select(F.explode(F.arrays_zip("lang", "n")).alias("d")).groupBy(F.col("d.lang").alias("lang")).agg(F.sum("d.n").alias("n")), "totals")
    found, stay = counted(relation, True, least)
    used = [relation, stay]
    text = F.col("word").cast("string")
    word = F.substring_index(text, " ", 1)
    levels = [saved(found.select("id", F.substring(text, F.length(word) + 2, F.length(text)).alias("lang"), word.alias("word"), "a"), "phrases")]
    firsts, lasts = F.array("a"), F.array("a")
    for _ in range(longest - 1):
        whole = relation.where("bucket = -1")
        n = whole.agg(F.sum("size")).head()[0] or 0
        relation = saved(whole.select("chunk", "items", "one").groupBy("chunk").cogroup(stay.groupBy("chunk")).applyInArrow(_extend(buckets_for(spark, n)), STORED), "occurrences")
        # what the level came from has been read for the last time; the parts are in levels
        forget(*used)
        found, stay = counted(relation, False, least)
        used = [relation, stay]
        first = levels[-1].select(F.col("id").alias("head"), "lang", firsts.alias("firsts"))
        last = levels[-1].select(F.col("id").alias("tail"), lasts.alias("lasts"))
        levels.append(saved(found.join(first, "head").join(last, "tail").select("id", "lang", "head", "tail", "a", F.concat("firsts", F.array("a")).alias("firsts"), F.concat("lasts", F.array("a")).alias("lasts")), "phrases"))
        firsts, lasts = F.col("firsts"), F.col("lasts")
    forget(*used)
    return levels, totals


def outside(phrases: DataFrame, longer: DataFrame | None, percent: int = INSIDE_PERCENT) -> DataFrame:
    """Phrases without those that mostly occur inside one longer phrase. A longer phrase
    that holds one holds it within its first or its last part, which is as frequent, so
    the next length is all that needs a look."""
    if longer is None:
        return phrases
    within = longer.select(F.explode(F.array("head", "tail")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("most"))
    return phrases.join(within, "id", "left").where((F.col("most").isNull()) | (100 * F.col("most") < percent * F.col("a"))).drop("most")


def scored(phrases: DataFrame) -> DataFrame:
    """The worst cut of each phrase: l, r and the score, ties to the earliest cut."""
    def at(name: str, k) -> F.Column:
        return F.get(name, k).cast("decimal(15,0)")

    whole = F.col("a").cast("decimal(15,0)")
    # decimal(38,0): a million times a product of two 15-digit counts
    top = (F.lit(1_000_000).cast("decimal(7,0)") * whole * whole).cast("decimal(38,0)")
    size = F.size("firsts")

    def cut(k):
        l, r = at("firsts", k - 1), at("lasts", size - k - 1)
        return F.struct(F.call_function("div", top, l * r).alias("score"), k.alias("k"), l.cast("bigint").alias("l"), r.cast("bigint").alias("r"))

    worst = F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))
    return phrases.withColumn("worst", worst).select("id", "lang", "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), F.col("worst.score").alias("score"))


def foremost(rows: DataFrame, top: int) -> DataFrame:
    """Rows that can be among the first of their language by score and count, a little more
    than top of each: those above a cut by counts per hundred scores, and of these those
    above a cut by score and count. Rows equal in both stay together."""
    def cut(df: DataFrame, keys: list[str]) -> DataFrame:
        counts = df.groupBy("lang", *keys).agg(F.count("*").alias("c"))
        down = Window.partitionBy("lang").orderBy(*[F.desc(k) for k in keys])
        kept = counts.withColumn("above", F.sum("c").over(down) - F.col("c")).where(F.col("above") < top)
        return df.join(kept.select("lang", *keys), ["lang", *keys], "left_semi")

    return cut(cut(rows.withColumn("hundred", F.expr("score div 100")), ["hundred"]), ["score", "a"]).drop("hundred")


def spelt(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(id, phrase) for ids of phrases of the last of some levels. Going down one level, a
    row of numbers x, y, z becomes head(x), tail(x), tail(y), tail(z)."""
    parts = rows.select("id", F.lit(0).alias("place"), F.col("id").alias("part"))
    for level in reversed(levels[1:]):
        down = level.select(F.col("id").alias("part"), "head", "tail").join(small(saved(parts, "parts")), "part")
        parts = down.select("id", F.explode(F.when(F.col("place") == 0, F.array(F.struct(F.lit(0).alias("place"), F.col("head").alias("part")), F.struct(F.lit(1).alias("place"), F.col("tail").alias("part")))).otherwise(F.array(F.struct((F.col("place") + 1).alias("place"), F.col("tail").alias("part"))))).alias("x")).select("id", "x.*")
    words = levels[0].select(F.col("id").alias("part"), "word").join(small(saved(parts, "parts")), "part")
    return words.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "word")))["word"], " ").alias("phrase"))


def best(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first rows. A language is ranked in SALTS parts, so that none is a
    single task's work, and at most SALTS * top rows of it then meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    parts = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    lists = parts.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("b"), "phrase", "l", "r"))), 1, top).alias("rows"))
    return lists.select("lang", F.posexplode("rows").alias("i", "x")).select("lang", (F.col("i") + 1).cast("bigint").alias("rank"), "x.phrase", (-F.col("x.b")).alias("a"), "x.l", "x.r", (-F.col("x.s")).alias("score"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, size: int = CHUNK_WORDS) -> DataFrame:
    """Each language's best phrases of 2 to longest words: lang, rank, phrase, a, l, r, n, score."""
    levels, totals = mined(docs, text_col, lang_col, longest, least, size)
    kept = [scored(outside(p, q)).withColumn("length", F.lit(k)) for k, (p, q) in enumerate(zip(levels[1:], [*levels[2:], None]), 2)]
    rows = saved(foremost(saved(reduce(DataFrame.unionByName, kept), "scored"), top), "foremost")
    named = []
    for k in range(2, longest + 1):
        of = rows.where(F.col("length") == k)
        named.append(of.join(spelt(of, levels[:k]), "id"))
    return best(reduce(DataFrame.unionByName, named), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
