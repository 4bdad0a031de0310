"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies.

Inside one pre-token (a piece the vocabulary's splitting pattern cuts out) a
sequence of tokens is the BPE result exactly if every neighbouring pair is what BPE
makes of the two tokens' bytes. So one pass over a piece finds, for each of its
prefixes, the single last token that fits the last token before it, and with it the
count: count[i] = count[i - len(token)] + 1. Pieces repeat, so their tables are
remembered per task, and a text's table is the tables of its pieces laid end to end
on the counts before them. Where cutting the text short would change the pieces
themselves (a run of white space cut at its end, a contraction or a special string
cut inside) the entry is computed from the pieces as they would be.

With the table, the count of any prefix, the longest prefix within a budget and
whether a limit is passed are look-ups. Special strings inside texts count as one
token, as the library takes them by default. Null text is empty and has no tokens.
Work is per row, with no shuffle; memory is that of one batch of texts.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 1024
REMEMBERED = 600_000
#: Bytes up to which the states of a piece's prefixes are remembered.
KEPT_PREFIX = 64
#: Fixed: Unicode white space, and the pattern by which such vocabularies split text.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def _letters() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: printable
    Latin-1 characters stand for themselves, other bytes for 256 and up in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class _Made(dict):
    """A dict that makes what it lacks; long keys are made each time."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= KEPT_PREFIX:
            self[key] = value
        return value


class PrefixCounter:
    """Prefix tables for the vocabulary in a tokenizer's .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.longest = max(map(len, self.tokens))
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pieces = regex.compile(PATTERN).findall
        self.blank = regex.compile(f"[{SPACE}]+").fullmatch
        self.known = _Made(self._table)
        #: (last token, count) of prefixes, which pieces share
        self.states: dict[bytes, tuple[bytes, int]] = {}
        self.blanks: set[str] = set()
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """BPE itself, used on the bytes of two tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.rank.get
        while len(parts) > 1:
            best, least, left = None, 1 << 60, parts[0]
            for right in parts[1:]:
                place = rank((left, right), least)
                if place < least:
                    best, least = (left, right), place
                left = right
            if best is None:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fit(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            # a pair that merges is none; else see what BPE makes of the bytes
            found = self.fits[key] = key not in self.rank and self.merged(left + right) == ([left, right] if left else [right])
        return found

    def piece(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of one piece, one per character."""
        b = text.encode("utf-8", "surrogatepass")
        last: list[bytes] = [b""]
        count = [0]
        if len(self.states) >= REMEMBERED:
            self.states.clear()
        tokens, fits, states = self.tokens, self.fits, self.states
        for i in range(1, len(b) + 1):
            state = states.get(b[:i]) if i <= KEPT_PREFIX else None
            if state is None:
                for j in range(max(0, i - self.longest), i):
                    token = b[j:i]
                    if token in tokens:
                        fit = fits.get((last[j], token))
                        if self.fit(last[j], token) if fit is None else fit:
                            state = token, count[j] + 1
                            break
                if i <= KEPT_PREFIX:
                    states[b[:i]] = state
            last.append(state[0])
            count.append(state[1])
        out = np.array(count[1:], dtype=np.uint32)
        if len(b) != len(text):
            out = out[np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text]) - 1]
        if text in ("'re", "'ve", "'ll"):  # cut after two characters these are two pieces
            out[1] = 2
        return out

    def _table(self, text: str) -> bytes:
        if self.blank(text):
            self.blanks.add(text)
        return self.piece(text).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        """The table of a text without special strings."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
            self.blanks.clear()
        pieces = self.pieces(text)
        if not pieces:
            return np.empty(0, dtype=np.int64)
        table_of = self.known.__getitem__
        every = np.frombuffer(b"".join([table_of(p) for p in pieces]), dtype=np.uint32)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(lengths)
        totals = every[ends - 1].astype(np.int64)
        before = np.cumsum(totals) - totals
        out = every + np.repeat(before, lengths)
        # white space of two or more before a word: cut at its end it is one piece
        blanks = self.blanks
        for i in [i for i, p in enumerate(pieces[:-1], 1) if p in blanks]:
            first = pieces[i][0]
            if self.blank(first):
                whole = np.frombuffer(table_of(pieces[i - 1] + first), dtype=np.uint32)
                out[ends[i] - lengths[i]] = before[i - 1] + whole[-1]
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of text[:1], text[:2], ..., text."""
        if not self.cut or not self.cut.search(text):
            return self._plain(text)
        parts, at, had = [], 0, 0
        for m in self.cut.finditer(text):
            plain = self._plain(text[at : m.start()])
            done = had + (int(plain[-1]) if len(plain) else 0)
            # cut inside the special string, the text since the last one is ordinary
            inside = [had + int(self._plain(text[at:p])[-1]) for p in range(m.start() + 1, m.end())]
            parts += [plain + had, np.array(inside, dtype=np.int64), np.array([done + 1])]
            at, had = m.end(), done + 1
        return np.concatenate([*parts, self._plain(text[at:]) + had])

    def count(self, text: str) -> int:
        table = self.prefixes(text)
        return int(table[-1]) if len(table) else 0

    def within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most `budget` tokens."""
        fits = np.flatnonzero(self.prefixes(text) <= budget)
        return int(fits[-1]) + 1 if len(fits) else 0


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None, budget: int | None = None, prefixes: bool = False) -> DataFrame:
    """docs without other columns than those given, plus n_tokens; with a budget,
    kept_chars, the longest prefix within it; with prefixes, the table itself."""
    path = path or default_path()
    rest = [c for c in docs.columns if c != text_col]
    names = ["n_tokens", *(["kept_chars"] if budget is not None else []), *(["prefix_tokens"] if prefixes else [])]
    clash = {c.lower() for c in rest}
    names = [f"_{n}" if n in clash else n for n in names]
    kinds = ["long", *(["long"] if budget is not None else []), *(["array<int>"] if prefixes else [])]

    def run(batches):
        of = counter(path)
        for batch in batches:
            tables = [of.prefixes(t or "") for t in batch.column(0).to_pylist()]
            made = [pa.array([int(t[-1]) if len(t) else 0 for t in tables], pa.int64())]
            if budget is not None:
                made.append(pa.array([int(f[-1]) + 1 if len(f := np.flatnonzero(t <= budget)) else 0 for t in tables], pa.int64()))
            if prefixes:
                made.append(pa.array([t.astype(np.int32) for t in tables], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*batch.schema.names[1:], *names])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), *(f"{n} {k}" for n, k in zip(names, kinds))])
    return docs.select(text_col, *rest).mapInArrow(run, schema)


def op10_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("text", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_counts(sized).withColumn("over_limit", F.col("n_tokens") > LIMIT)
