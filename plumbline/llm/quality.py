"""Quality rules with a verdict on whole hosts (native).

Each document is measured (words, symbols, repeated lines and 5-word windows)
and fails the base rules or not. Failures are counted per host, the host rates
are shrunk towards an empirical beta prior fitted to all hosts by moments, and a
host whose shrunk rate passes the limit loses all its documents. The host is the
`source` column; counting is a partial aggregate, so a host with a third of the
rows costs no more than others, and the verdicts are joined back by broadcast
only after their number has been checked.

Null or blank text has no words and fails. A null host is a host of its own.
Repeated rows count as often as they occur. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, fresh, let, saved, small, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected when its shrunk failure rate is above this.
HOST_LIMIT = 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hashes. Where all are different, which one set
    operation shows, nothing more is done; else the start positions of repeated
    windows are sorted, and each covers up to `window` words until the next."""
    def hashed(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def covered(wins: Column) -> Column:
        placed = F.sort_array(F.transform(wins, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(p: Column) -> Column:
            twice = F.filter(p, lambda x, j: F.coalesce(F.get(p, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(starts: Column) -> Column:
            return F.aggregate(F.transform(starts, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b)

        return let(placed, lambda p: let(again(p), total))

    def counted(wins: Column) -> Column:
        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), 0).otherwise(covered(wins))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) < window + 1, 0).otherwise(let(hashes, lambda h: let(hashed(h), counted)))


def measured(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one struct column of measures and the base verdict, and its name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    (name,) = fresh(docs, "__quality")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    dups = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    body = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeat_words(ws).cast("long").alias("n_repeat_words")))
    bare = F.length(F.translate(text, SPACES, "")).cast("long")
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    out = docs.withColumn(name, F.struct(body.alias("w"), bare.alias("word_chars"), symbols.alias("n_symbols"), dups.cast("long").alias("n_dup_lines")))
    q = F.col(name)
    n, r = q["w"]["n_words"], q["w"]["n_repeat_words"]
    failed = (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
    return out.withColumn(name, F.struct(n.alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"), r.alias("n_repeat_words"), failed.alias("base_failed"))), name


def host_rates(judged: DataFrame, host_col: str, failed: Column, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, docs, fails, rate, rejected), the rate shrunk to a beta prior.

    The prior's mean is the rate over all documents; its strength comes from the
    spread of host rates beyond what counting alone would give (moments), held
    between 1 and 10,000 documents."""
    hosts = saved(judged.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("docs"), F.sum(failed.cast("long")).alias("fails")), "hosts")
    raw = F.col("fails") / F.col("docs")
    prior = hosts.agg(F.count("*").alias("m"), (F.sum("fails") / F.sum("docs")).alias("mean"), F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("spread"), F.avg(1 / F.col("docs")).alias("inverse"))
    between = F.greatest(F.col("spread") - F.col("mean") * (1 - F.col("mean")) * F.col("inverse"), F.lit(1e-12))
    strength = F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / between - 1, F.lit(1.0)), F.lit(10_000.0))
    prior = prior.select(F.col("mean").alias("prior"), strength.alias("strength"))
    rate = (F.col("fails") + F.col("prior") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    # one row of prior, made by a global aggregate
    return saved(hosts.join(F.broadcast(prior), F.lit(True)).select("host", "docs", "fails", rate.alias("rate"), (rate > limit).alias("rejected")), "host_rates")


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> tuple[DataFrame, str]:
    """docs with one struct column: the measures, base_failed, host_rate and kept."""
    marked, name = measured(docs, text_col)
    marked = saved(marked, "measured")
    host, rate, rejected = fresh(marked, "host", "rate", "rejected")
    rates = small(host_rates(marked, host_col, F.col(name)["base_failed"], limit).select(F.col("host").alias(host), F.col("rate").alias(rate), F.col("rejected").alias(rejected)))
    out = marked.join(rates, F.col(host_col).eqNullSafe(F.col(host)), "left")
    kept = ~F.col(name)["base_failed"] & ~F.col(rejected)
    return out.withColumn(name, F.col(name).withField("host_rate", F.col(rate)).withField("kept", kept)).drop(host, rate, rejected), name


def quality_filter(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass their own rules and whose host does."""
    out, name = judge(docs, text_col, host_col, limit)
    return out.where(F.col(name)["kept"]).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, name = measured(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    marked = saved(marked.select("doc_id", "source", name), "measured")
    rates = small(host_rates(marked, "source", F.col(name)["base_failed"]))
    out = marked.join(rates, marked["source"].eqNullSafe(rates["host"]), "left")
    q = F.col(name)
    return out.select("doc_id", *[q[c].alias(c) for c in MEASURES], q["base_failed"].alias("base_failed"), (~q["base_failed"] & ~F.col("rejected")).alias("kept"), F.round("rate", 6).alias("host_rate"))
