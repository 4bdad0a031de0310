"""Postings of text columns: term, key, positions; stop words; refresh of changed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import pk_violations

SPLIT = r"[^\p{L}\p{N}]+"
#: Used where no list is given.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(text: Column) -> Column:
    """[(term, positions)] of a text, positions from 0 counting empty pieces too. The pieces
    are sorted and cut into runs inside the row, so no term is shuffled."""
    def cut(a: Column) -> Column:
        term = lambda i: F.get(a, i)["term"]
        heads = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (term(i) != term(i - 1)))
        runs = _let(heads, lambda h: F.transform(h, lambda i, k: F.struct(term(i).alias("term"), F.slice(a, i + 1, F.coalesce(F.get(h, k + 1), F.size(a)) - i)["position"].alias("positions"))))
        return F.when(F.size(a) > 0, runs)

    pieces = F.transform(F.split(F.lower(text), SPLIT), lambda x, i: F.struct(x.alias("term"), i.alias("position")))
    return _let(F.array_sort(F.filter(pieces, lambda p: p["term"] != "")), cut)


def require_key(df: DataFrame, key: str) -> None:
    """Raise unless the key is unique and has no nulls."""
    bad = pk_violations(df, [key]).head()
    if bad is not None:
        raise ValueError(f"{key} is no key of a text index: {bad['reason']} value {bad[key]}")


def without_stop_words(postings: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Postings whose term is not in stop(term)."""
    if stop is None:
        return postings.where(~F.col("term").isin(*STOP_WORDS))
    return postings.join(stop.select("term").distinct(), "term", "left_anti").select(*postings.columns)


def text_index(df: DataFrame, key: str, columns: list[str], stop: DataFrame | None = None, use_stop: bool = True) -> DataFrame:
    """(term, key, column, n, positions) for rows of one key each, which is checked."""
    require_key(df, key)
    return postings_of(df, key, columns, stop, use_stop)


def postings_of(df: DataFrame, key: str, columns: list[str], stop: DataFrame | None = None, use_stop: bool = True) -> DataFrame:
    """text_index for rows whose key is known to be one."""
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns])).alias("t")
    each = df.select(F.col(key), texts).select(key, "t.column", F.explode(_runs(F.col("t.text"))).alias("run"))
    out = each.select("run.term", key, "column", F.size("run.positions").cast("long").alias("n"), "run.positions")
    return without_stop_words(out, stop) if use_stop else out


def refresh(postings: DataFrame, changed: DataFrame, key: str, columns: list[str], stop: DataFrame | None = None, use_stop: bool = True) -> DataFrame:
    """Postings after some keys' texts changed: theirs are replaced, others stay."""
    kept = postings.join(changed.select(key).distinct(), key, "left_anti").select(*postings.columns)
    return kept.unionByName(text_index(changed, key, columns, stop, use_stop))
