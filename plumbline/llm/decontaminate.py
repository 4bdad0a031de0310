"""Benchmark decontamination by question templates.

Words are canonicalised one by one: outer punctuation is dropped, numbers become
<num>, units <unit>, capitalised words <name>, everything else its lower case.
Windows of 13 template words (a whole item where it has only 8 to 12) are hashed and
joined with those of the benchmark, so a question whose numbers and names were
exchanged still meets its original. Windows with fewer than 7 words that are no
placeholders say too little as templates and are hashed by their words themselves. The
values behind the placeholders are then compared along the alignment of document
and item: the same value must always stand for the same one, in both directions.
A consistent alignment makes the document contaminated, and so does any window of
which all values are the item's own, whatever the rest of the alignment.

Tasks drop windows by two bitmaps made from the benchmark's hashes, whatever
its size; what passes is joined exactly. Items of fewer than 8 words are too short
to tell and are ignored. Null text matches nothing; null doc_ids are left alone;
rows that share a doc_id are one document. No benchmark leaves all documents clean.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, saved, small, table
from .hashing import CACHED_WORDS, U, bitmap, in_bitmap, split_words, windows

WINDOW = 13
SHORTEST = 8
LITERALS = 7
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ounce ounces gram grams ton tons"
    " ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks"
    " month months year years cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh".split())
#: Numbers in words.
SPELLED = frozenset(
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    " twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[\d][\d.,:/]*(?:st|nd|rd|th|%|[a-z]{1,3})?")


def template(word: str) -> tuple[str, str]:
    """(template word, value): the value is empty for words that are no placeholders."""
    bare = _EDGES.sub("", word)
    low = bare.lower()
    if _NUMBER.fullmatch(low) or all(x in SPELLED for x in low.split("-")):
        return "<num>", "n:" + low
    if low in UNITS:
        return "<unit>", "u:" + low
    if bare[:1].isupper() and not (len(bare) > 1 and bare.isupper()):
        return "<name>", "c:" + low
    return low or word, ""


class _Templates(dict):
    """Hash of a word's template; the lowest bit is set for words that are no placeholders."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        form, value = template(word.decode("utf-8", "replace"))
        out = self[word] = xxhash.xxh3_64_intdigest(form) & ~1 | (not value)
        return out


def _itself(words: list[bytes]) -> int:
    """Hash of words themselves, without outer punctuation and case."""
    h = xxhash.xxh3_64_intdigest("\n".join(_EDGES.sub("", w.decode("utf-8", "replace")).lower() for w in words), seed=1)
    return h - (h >> 63 << 64)


def _windows(lengths: tuple[int, ...], literals: int, wanted: tuple[tuple[np.ndarray, int], tuple[np.ndarray, int]] | None):
    """(hash, template's hash, id, at, n, values) per window; of documents only those that
    may match, by bitmaps of the templates' hashes and of the hashes."""
    def run(batches):
        known = _Templates()
        for batch in batches:
            out = [[], [], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = split_words(text)
                t = np.fromiter(map(known.__getitem__, ws), dtype=U, count=len(ws))
                sure = np.concatenate(([0], np.cumsum(t & U(1)).astype(np.int64)))
                # an item of its own is taken in windows of one length
                for n in lengths if wanted is not None else (min(WINDOW, len(ws)),) if len(ws) >= SHORTEST else ():
                    h = windows(t, n).view(np.int64)
                    if not len(h):
                        continue
                    for at in range(len(h)) if wanted is None else np.flatnonzero(in_bitmap(wanted[0][0], h, wanted[0][1])):
                        key = h[at]
                        if sure[at + n] - sure[at] < min(literals, n - 1):
                            key = _itself(ws[at : at + n])
                            if wanted is not None and not in_bitmap(wanted[1][0], np.array([key]), wanted[1][1])[0]:
                                continue
                        for column, value in zip(out, (key, h[at], i, at, n, [template(w.decode("utf-8", "replace"))[1] for w in ws[at : at + n]])):
                            column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["h", "t", "id", "at", "n", "values"])

    return run


SCHEMA = "h long, t long, id long, at int, n int, values array<string>"


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", literals: int = LITERALS) -> DataFrame:
    """(id, item_id, shift, n_windows, n_slots, consistent) per aligned document and item."""
    b = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    items = saved(b.mapInArrow(_windows((), literals, None), SCHEMA), "templates")
    lengths = tuple(sorted(r["n"] for r in items.select("n").distinct().collect()))  # at most 6 values
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null and text is not null")
    found = saved(raw.mapInArrow(_windows(lengths, literals, (bitmap(items.select("t"), F.col("t")), bitmap(items.select("h"), F.col("h")))), SCHEMA).drop("t"), "windows")
    i = small(items.select("h", "n", F.col("id").alias("item"), F.col("at").alias("item_at"), F.col("values").alias("item_values")))
    both = found.join(i, ["h", "n"])
    slots = F.filter(F.arrays_zip(F.col("item_values").alias("a"), F.col("values").alias("b")), lambda x: x["a"] != "")
    per = both.groupBy("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"), F.max(F.col("values") == F.col("item_values")).alias("verbatim"))
    one_way = F.size(F.array_distinct(F.transform("slots", lambda x: x["a"]))) == F.size("slots")
    other_way = F.size(F.array_distinct(F.transform("slots", lambda x: x["b"]))) == F.size("slots")
    return per.select("id", F.col("item").alias("item_id"), "shift", "n_windows", F.size("slots").alias("n_slots"), (F.col("verbatim") | one_way & other_way).alias("consistent"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """(id, n_items, n_windows, item_id) of contaminated documents; item_id has most windows."""
    good = saved(matches(docs, benchmark, **columns), "matches").where("consistent")
    return good.groupBy("id").agg(F.countDistinct("item_id").alias("n_items"), F.sum("n_windows").alias("n_windows"), F.max(F.struct("n_windows", (-F.col("item_id")).alias("i"))).alias("m")).select("id", "n_items", "n_windows", (-F.col("m.i")).alias("item_id"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """docs without the contaminated ones."""
    gone = saved(contaminated(docs, benchmark, id_col=id_col, **columns).select("id"), "contaminated")
    (name,) = fresh(docs, "__id")
    return docs.join(small(gone.select(F.col("id").alias(name))), docs[id_col] == F.col(name), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: contaminated or not, by how many items and windows, the foremost item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = saved(contaminated(docs, table(spark, sf_dir, "benchmark")), "contaminated")
    out = docs.select("doc_id").join(small(hits), F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", F.col("id").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), "item_id")
