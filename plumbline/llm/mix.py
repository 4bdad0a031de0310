"""Mixing sources to target weights by entropy balancing (native).

Every source gets a token target. Inside a source each document d of size x_d
gets the rate that stays closest, in bounded relative entropy, to taking it once
while the source's words add up to the target:

    rate(x) = c * exp(l * x) / (c - 1 + exp(l * x)),   0 <= rate <= c

with c the largest repetition (3) and one multiplier l per source, the root of
the convex dual. Newton's steps run on a histogram (source, size, documents),
so no step reads texts, and a bracket keeps every step inside the interval known
to hold the root. Rates become whole copies by rounding with a hash of the
document, where the cut between rounding up and down is set per source so that
the words taken meet the target to within a document or so.

Null text has size 0 and takes no words. A null source is a source, the last in
order. Rows that repeat are taken as documents of their own with equal copies.
Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, saved, small, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
STEPS = 60
TOLERANCE = 1e-9
BINS = 32768


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, docs, target) for sizes(source, size).

    The total of all sizes is shared by weight; a source stops at `most` times its
    own size and what is left over goes to the others by weight. Filling in order
    of most * size / weight gives that fixed point in one pass of running sums."""
    per = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.max("size").alias("longest")), "sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    per = per.withColumn("n", F.row_number().over(order) - 1).withColumn("weight", weight)
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(all_rows))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
    # the level at the first source that stays under its cap holds for all after it
    under = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    per = per.withColumn("final", F.first(under, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return saved(per.select("source", "source_size", "docs", "longest", target.cast("double").alias("target")), "targets")


def rate(size: Column, multiplier: Column, scale: Column, most: float = MOST) -> Column:
    """The tilted rate; a null multiplier means the source is taken `most` times."""
    z = F.least(F.greatest(multiplier * size / scale, F.lit(-700.0)), F.lit(700.0))
    up = F.exp(z)
    return F.when(multiplier.isNull(), F.lit(float(most))).otherwise(most * up / (most - 1 + up))


def multipliers(sizes: DataFrame, goal: DataFrame, most: float = MOST, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """goal with its multiplier and scale: distributed Newton steps on the dual."""
    hist = saved(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("docs")), "hist")
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = goal.select(
        "source", "source_size", "target", F.greatest(F.col("source_size") / F.greatest(F.col("docs"), F.lit(1)), F.lit(1.0)).cast("double").alias("scale"),
        F.when(~full, F.lit(0.0)).alias("multiplier"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), full.alias("done"))
    state = saved(state, "dual")

    def exact(terms: Column) -> Column:
        """A sum that is the same in any order of rows, so that reruns agree."""
        return F.sum(terms.cast("decimal(38,9)")).cast("double")

    for _ in range(steps):
        if state.where(~F.col("done")).isEmpty():
            break
        h = hist.alias("h").join(small(state.where(~F.col("done"))).alias("s"), F.expr("h.source <=> s.source"))
        x = F.col("h.size").cast("double")
        r = rate(x, F.col("s.multiplier"), F.col("s.scale"), most)
        sums = h.groupBy(F.col("s.source").alias("source")).agg(
            exact(F.col("h.docs") * x * r).alias("words"),
            exact(F.col("h.docs") * x * x / F.col("s.scale") * r * (1 - r / most)).alias("slope"))
        s = state.alias("s").join(sums.alias("g"), F.expr("s.source <=> g.source"), "left")
        at, gap = F.col("s.multiplier"), F.col("words") - F.col("s.target")
        low = F.when(gap <= 0, at).otherwise(F.col("s.low"))
        high = F.when(gap >= 0, at).otherwise(F.col("s.high"))
        newton = at - gap / F.greatest(F.col("slope"), F.lit(1e-300))
        # outside the bracket: halve it, or double the distance where one end is open
        safe = F.when((low.isNull() | (newton > low)) & (high.isNull() | (newton < high)) & (F.abs(newton - at) <= 4 + 4 * F.abs(at)), newton) \
            .when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(gap < 0, at * F.when(at > 0, 2.0).otherwise(0.5) + 1).otherwise(at * F.when(at < 0, 2.0).otherwise(0.5) - 1)
        near = F.abs(gap) <= tolerance * F.greatest(F.col("s.target"), F.lit(1.0))
        closed = F.coalesce((high - low) <= 1e-13 * (1 + F.abs(at)), F.lit(False))
        stop = F.col("s.done") | gap.isNull() | near | closed
        state = saved(s.select(F.col("s.source"), F.col("s.source_size"), F.col("s.target"), F.col("s.scale"), F.when(stop, at).otherwise(safe).alias("multiplier"), low.alias("low"), high.alias("high"), stop.alias("done")), "dual")
    return state.select("source", "source_size", "target", "multiplier", "scale")


def _draw(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << 52)) / float(1 << 52)


def cuts(sizes: DataFrame, duals: DataFrame, most: float = MOST) -> DataFrame:
    """duals with the bin from which on a source's documents round up."""
    d = sizes.alias("d").join(small(duals).alias("s"), F.expr("d.source <=> s.source"))
    d = d.select("s.source", "s.target", F.col("d.size").alias("size"), rate(F.col("d.size"), F.col("multiplier"), F.col("scale"), most).alias("rate"), _draw(F.col("d.id")).alias("draw"))
    part = F.col("rate") - F.floor("rate")
    bins = d.groupBy("source", "target", F.when(part > 0, F.floor((part - F.col("draw")) * BINS)).alias("bin")).agg(
        F.sum(F.floor("rate") * F.col("size")).alias("sure"), F.sum("size").alias("more"))
    w = Window.partitionBy("source")
    bins = bins.withColumn("have", F.sum("sure").over(w) + F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("more"))).over(w.orderBy(F.col("bin").desc_nulls_last())), F.lit(0)))
    # the cut whose words come closest to the target; taking no bin at all is a choice too
    none = bins.groupBy("source").agg(F.sum("sure").alias("have"), F.max("target").alias("target")).withColumn("bin", F.lit(BINS + 1).cast("long"))
    choice = bins.where("bin is not null").select("source", "bin", F.abs(F.col("have") - F.col("target")).alias("miss")).unionByName(none.select("source", "bin", F.abs(F.col("have") - F.col("target")).alias("miss")))
    cut = choice.groupBy("source").agg(F.min(F.struct("miss", (-F.col("bin")).alias("b"))).alias("m")).select("source", (-F.col("m.b")).alias("cut"))
    return saved(duals.alias("s").join(cut.alias("c"), F.expr("s.source <=> c.source"), "left").select("s.*", "c.cut"), "cuts")


def copies(size: Column, key: Column, multiplier: Column, scale: Column, cut: Column, most: float = MOST) -> Column:
    r = rate(size, multiplier, scale, most)
    part = r - F.floor(r)
    return (F.floor(r) + F.when((part > 0) & (F.floor((part - _draw(key)) * BINS) >= cut), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken (copies * size).

    Added columns get a leading underscore where docs has one of that name."""
    sizes = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    params = _params(sizes, weights, most)
    return _apply(docs.withColumn((s := fresh(docs, "size"))[0], word_count(F.col(text_col))), s[0], params, id_col, source_col, most)


def _params(sizes: DataFrame, weights, most: float) -> DataFrame:
    return cuts(sizes, multipliers(sizes, targets(sizes, weights, most), most), most)


def _apply(docs: DataFrame, size: str, params: DataFrame, id_col: str, source_col: str, most: float) -> DataFrame:
    p = params.select(*[F.col(c).alias(f"__mix_{c}") for c in params.columns])
    out = docs.join(small(p), docs[source_col].eqNullSafe(p["__mix_source"]), "left")
    n_source, n_target, n_rate, n_copies, n_taken = fresh(docs, "source_size", "target", "rate", "copies", "taken")
    m, s, c = (F.col(f"__mix_{x}") for x in ("multiplier", "scale", "cut"))
    return out.select(*[docs[x] for x in docs.columns], F.col("__mix_source_size").alias(n_source), F.col("__mix_target").alias(n_target), rate(docs[size], m, s, most).alias(n_rate),
                      copies(docs[size], docs[id_col], m, s, c, most).alias(n_copies)).withColumn(n_taken, F.col(n_copies) * F.col(size))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it."""
    docs = table(spark, sf_dir, "documents")
    sizes = saved(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")), "sizes")
    out = _apply(sizes.withColumnRenamed("id", "doc_id"), "size", _params(sizes, WEIGHTS, MOST), "doc_id", "source", MOST)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate", "source")
