"""Secrets in texts, by patterns and by tests of randomness (native).

Patterns find assignments to password-like names, access keys and long lower-case hex
strings; matches that are too short are dropped. All other runs of 20 or more encoded
characters are candidates: their encoding is inferred from the characters they use
(hex, base32, base36 or base64; digits alone and letters of one case are no encoding),
and three tests ask whether their symbols could be uniformly random: chi-squared over
the alphabet, the number of runs of the lower and upper half of the alphabet, and the
circular serial correlation of neighbours. Fisher's sum combines the three p-values.

Random strings have uniform p-values, words and paths have p-values near 0. Which p is
enough is settled per encoding and length class over the whole corpus: from the upper
half of the p-values, where ordinary strings do not come, follows how many of each bin
are random; the smallest limit is taken above which at most FALSE_SHARE of the
candidates are not. Short strings, which the tests tell apart less well, so need a
higher p than long ones. Below FLOOR no candidate counts.

Null and empty texts have no spans. Repeated rows are rows of their own. Empty input
gives empty output. Positions come from the lengths of what lies between matches, by
sums over blocks, so that long texts with very many matches take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, let, saved, table

# Fixed values of the query's contract: the patterns and their least lengths.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LEAST_VALUE = 6
#: A run of letters and digits matches from its first AKIA on, so the least length of the
#: match can stand in the pattern; so it can for hex.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: Alphabets in the order of their symbols' values; candidates are spelt in them first.
ALPHABETS = {
    "hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Upper ends (exclusive) of the length classes, in symbols.
LENGTHS = (32, 64, 128, 256)
BINS, FALSE_SHARE, FLOOR = 20, 0.1, 0.001
BLOCK = 256

# Expressions in SQL that Spark and DuckDB share, over columns of the same names:
# raw (the candidate), body (raw without padding), encoding, sym (body in its alphabet).
BODY = "regexp_replace(raw, '=+$', '')"
ENCODING = """case when not (regexp_like(body, '[0-9]') and regexp_like(body, '[A-Za-z]')) and not (regexp_like(body, '[a-z]') and regexp_like(body, '[A-Z]')) then null
  when regexp_like(body, '^([0-9a-f]+|[0-9A-F]+)$') then 'hex' when regexp_like(body, '^[A-Z2-7]+$') then 'base32'
  when regexp_like(body, '^([a-z0-9]+|[A-Z0-9]+)$') then 'base36' when regexp_like(body, '[a-z]') and regexp_like(body, '[A-Z]') then 'base64' else null end"""
SYMBOLS = "case encoding when 'hex' then upper(body) when 'base36' then lower(body) when 'base64' then translate(body, '-_', '+/') else body end"


def _by_encoding(make) -> str:
    return "case encoding " + " ".join(f"when '{e}' then {make(a)}" for e, a in ALPHABETS.items()) + " end"


#: Sum of the squared counts of the symbols; the halves of the alphabet as a string of 0 and 1.
SQUARES = _by_encoding(lambda a: " + ".join(f"power(length(sym) - length(replace(sym, '{x}', '')), 2)" for x in a))
HALVES = _by_encoding(lambda a: f"translate(sym, '{a}', '{'0' * (len(a) // 2) + '1' * (len(a) // 2)}')")
SIZE = _by_encoding(lambda a: f"cast({len(a)} as double)")
RUNS = "1.0e0 + (2 * length(halves) - length(replace(halves, '01', '')) - length(replace(halves, '10', ''))) / 2.0e0"
ONES = "cast(length(replace(halves, '0', '')) as double)"
LENGTH_CLASS = "case " + " ".join(f"when n < {x} then {i}" for i, x in enumerate(LENGTHS)) + f" else {len(LENGTHS)} end"
# The three standard scores: chi-squared with the moments of n draws from k symbols,
# Wald and Wolfowitz's runs, and the circular serial correlation.
Z_CHI = "greatest((k * squares / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n), 0.0e0)"
Z_RUNS = "case when ones = 0 or ones = n then sqrt(n) else abs(runs - 1 - 2 * ones * (n - ones) / n) / sqrt(2 * ones * (n - ones) * (2 * ones * (n - ones) - n) / (n * n * (n - 1))) end"
Z_SERIAL = "case when n * q = s * s then sqrt(n) else abs((n * m - s * s) / (n * q - s * s) + 1 / (n - 1)) / sqrt(n * n / ((n - 1) * (n - 1) * (n - 2))) end"


def tail(z: str) -> str:
    """Both tails of the normal distribution beyond z >= 0: the rational approximation of
    the complementary error function with five terms (error below 2e-7), at least 1e-30."""
    x = f"({z}) / 1.4142135623730951e0"
    t = f"(1 / (1 + 0.3275911e0 * {x}))"
    return f"greatest(exp(-({x}) * ({x})) * {t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))), 1.0e-30)"


#: Half of Fisher's statistic, and its tail with six degrees of freedom. The first test is one-sided.
FISHER = f"-(ln(least(case when z_chi = 0 then 1.0e0 else {tail('z_chi')} end, 1.0e0)) + ln(least({tail('z_runs')}, 1.0e0)) + ln(least({tail('z_serial')}, 1.0e0)))"
P = "exp(-half) * (1 + half + half * half / 2)"
BIN = f"cast(least(floor(p * {BINS}), {BINS - 1}) as int)"


def running(lengths: Column) -> Column:
    """For each length the sum of all before it."""
    def scan(xs: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("all"), F.lit(0).cast("bigint").alias("sum"))
        return F.aggregate(xs, start, lambda a, x: F.struct(F.concat(a["all"], F.array(a["sum"])).alias("all"), (a["sum"] + x).alias("sum")), lambda a: a["all"])

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, total)), lambda b, o: F.transform(scan(b), lambda x: x + o))))


def found(text: Column, pattern: str, values: int | None = None) -> Column:
    """All matches as structs (start, stop, raw), in code points; raw is the match, or its
    group `values`."""
    kind = "array<struct<start:bigint,stop:bigint,raw:string>>"

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), lambda x: F.length(x).cast("bigint"))
        lengths = F.transform(hits, lambda x: F.length(x).cast("bigint"))
        raws = hits if values is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(values))
        starts = let(gaps, lambda g: let(lengths, lambda n: F.zip_with(F.zip_with(running(F.zip_with(g, n, lambda a, b: a + b)), g, lambda a, b: a + b), n, lambda at, m: F.struct(at.alias("start"), (at + m).alias("stop")))))
        return F.zip_with(starts, raws, lambda at, raw: F.struct(at["start"].alias("start"), at["stop"].alias("stop"), raw.alias("raw")))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(kind))


def scanned(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with three columns: a row number, the pattern spans (start, kind, stop) in
    order, and the candidates (start, stop, raw) that touch none of them."""
    row, spans, candidates = fresh(docs, "row", "spans", "candidates")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of(kind: int, matches: Column) -> Column:
        return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop")))

    values = F.filter(found(text, ASSIGN, 2), lambda x: F.length(x["raw"]) >= LEAST_VALUE)
    out = docs.withColumn(spans, F.sort_array(F.concat(of(0, values), of(1, found(text, ACCESS)), of(2, found(text, HEX)))))
    out = out.withColumn(candidates, F.filter(found(text, CANDIDATE), lambda c: ~F.exists(F.col(spans), lambda s: (s["start"] < c["stop"]) & (c["start"] < s["stop"]))))
    return out.withColumn(row, F.monotonically_increasing_id()), [row, spans, candidates]


def scored(candidates: DataFrame) -> DataFrame:
    """Rows with a column raw, with encoding, length class, p and its bin added; those
    without an encoding go."""
    out = candidates.withColumn("body", F.expr(BODY)).withColumn("encoding", F.expr(ENCODING)).where("encoding is not null")
    out = out.withColumn("sym", F.expr(SYMBOLS)).withColumn("n", F.expr("cast(length(sym) as double)")).where("n > 2")
    out = out.withColumn("v", F.expr("transform(split(sym, ''), x -> cast(instr(" + _by_encoding(lambda a: f"'{a}'") + ", x) - 1 as double))"))
    add = "cast(0 as double), (a, x) -> a + x"
    out = out.selectExpr("*", f"{SIZE} as k", f"{SQUARES} as squares", f"{HALVES} as halves", f"aggregate(v, {add}) as s", f"aggregate(v, cast(0 as double), (a, x) -> a + x * x) as q",
                         f"aggregate(zip_with(v, concat(slice(v, 2, size(v)), slice(v, 1, 1)), (x, y) -> x * y), {add}) as m")
    out = out.selectExpr("*", f"{RUNS} as runs", f"{ONES} as ones").selectExpr("*", f"{Z_CHI} as z_chi", f"{Z_RUNS} as z_runs", f"{Z_SERIAL} as z_serial")
    out = out.withColumn("half", F.expr(FISHER)).withColumn("p", F.expr(P)).withColumn("bin", F.expr(BIN)).withColumn("length_class", F.expr(LENGTH_CLASS))
    return out.drop("body", "sym", "v", "k", "squares", "halves", "s", "q", "m", "runs", "ones", "half")


def limits(marked: DataFrame) -> DataFrame:
    """(encoding, length_class, least): the bin from which candidates count. Classes
    without such a bin are missing. At most BINS rows per class, whatever the input."""
    counts = marked.groupBy("encoding", "length_class", "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy("encoding", "length_class")
    up = w.orderBy(F.desc("bin"))
    seen = counts.select("*", F.sum("c").over(up).alias("above"), (2 * F.sum(F.when(F.col("bin") >= BINS // 2, F.col("c")).otherwise(0)).over(w) + 1).alias("random"))
    false = F.greatest(F.col("above") - F.col("random") * (1 - F.col("bin") / F.lit(float(BINS))), F.lit(0.0)) / F.col("above")
    return seen.where(false <= FALSE_SHARE).groupBy("encoding", "length_class").agg(F.min("bin").alias("least"))


def secrets(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a column of spans (start, kind, stop, p) in order, and its name; kind is
    a position in KINDS, p is null for pattern spans."""
    out, (row, spans, candidates) = scanned(docs, text_col)
    out = saved(out, "scanned")
    marked = saved(scored(out.select(F.col(row).alias("row"), F.inline(candidates))), "scored")
    # encodings times length classes: at most 20 rows
    kept = marked.join(F.broadcast(limits(marked)), ["encoding", "length_class"]).where(f"bin >= least and p >= {FLOOR}")
    key, extra = fresh(out, "key", "extra")
    kept = kept.groupBy(F.col("row").alias(key)).agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "stop", "p")).alias(extra))
    out = out.join(kept, out[row] == kept[key], "left")
    whole = F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.lit(None).cast("double").alias("p"))), F.coalesce(F.col(extra), F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,p:double>>")))
    return out.withColumn(spans, F.sort_array(whole)).drop(row, candidates, extra, key), spans


def joined(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, spans = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return out.select("doc_id", *[number(k) for k in range(len(KINDS))], F.sha2(joined(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))
