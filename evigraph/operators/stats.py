"""Statistics over evidence: ranks, tests, agreement, information, ablation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.order import quantiles

from evigraph.functions import kernels as K


def average_rank(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1 with ties sharing their mean."""
    w = Window.partitionBy(*group).orderBy(value)
    tied = Window.partitionBy(*group, value)
    return rows.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(tied) - 1) / 2)


def spearman(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks; null for fewer than three rows or a constant side."""
    ranked = average_rank(average_rank(rows, group, x, "_rx"), group, y, "_ry")
    out = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_rx", "_ry").alias("c"), F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"))
    ok = (F.col("n") >= 3) & (F.col("_sx") > 0) & (F.col("_sy") > 0)
    return out.select(*group, "n", F.when(ok, F.col("c") / F.when(F.col("_sx") * F.col("_sy") > 0, F.col("_sx") * F.col("_sy"))).alias("spearman"))


def signed_rank(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Wilcoxon's signed-rank z with zeros dropped and ties corrected."""
    r = average_rank(rows.where(F.col(value).isNotNull() & (F.col(value) != 0)).withColumn("_a", F.abs(value)), group, "_a", "_r")
    r = r.withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*group, "_a")))
    s = r.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(value) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        # each of t tied rows carries (t^2 - 1), which sums to t^3 - t
        F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("_ties"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.when(variance > 0, F.sqrt(variance))
    return s.select(*group, "n", "w_plus", z.alias("z"))


def adjust_p(rows: DataFrame, group: list[str], p: str, key: str) -> DataFrame:
    """Benjamini-Hochberg: running minimum from the largest p, at most 1."""
    up = Window.partitionBy(*group).orderBy(p, key)
    down = Window.partitionBy(*group).orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    raw = F.col(p) * n / F.row_number().over(up)
    return rows.withColumn("_raw", raw).withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_raw")


def set_summary(rows: DataFrame, group: str, value: str, least: int = 10) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("q"),
        F.count_if(F.col(value) > 0).alias("n_positive"), F.count_if(F.col(value) < 0).alias("n_negative"),
    )
    return out.where(F.col("n") >= least).select(group, "n", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "n_positive", "n_negative")


def information(ledger: DataFrame, key: str, prior: float = 0.5, cutoff: float = 0.5) -> DataFrame:
    """For each (key, stream): bits, the posterior without the stream, the shift, and whether the decision flips."""
    step = F.col("weight") * F.ln("factor")
    total = F.sum(step).over(Window.partitionBy(key))
    start = K.logit(F.lit(prior))
    rows = ledger.withColumn("with_all", K.expit(start + total)).withColumn("without", K.expit(start + total - step))
    alone = K.expit(start + step)
    return rows.select(
        key, "stream", K.relative_entropy_bits(alone, F.lit(prior)).alias("bits"), "with_all", "without", (F.col("with_all") - F.col("without")).alias("shift"),
        ((F.col("with_all") > cutoff) != (F.col("without") > cutoff)).alias("flips"),
    )


def agreement(ledger: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """For each pair of streams (``names``: the few there are): concordant signs, both positive, Jaccard of positives.

    Signs of a key's rows are counted by stream, and counts are multiplied: the ledger is read once, and its rows aren't joined.
    """
    sign = F.signum(F.ln("factor"))
    signs = ledger.where(F.col(key).isNotNull() & F.col("stream").isNotNull()).repartition(key).groupBy(key, "stream").agg(F.count(F.lit(1)).alias("n"), F.count_if(sign > 0).alias("p"), F.count_if(sign < 0).alias("m"))
    held = signs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stream", "n", "p", "m"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y["stream"] > x["stream"]), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    met = held.select(F.explode(pairs).alias("e")).select("e.a", "e.b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    out = met.groupBy(a("stream").alias("stream_a"), b("stream").alias("stream_b")).agg(
        F.sum(a("n") * b("n")).alias("n"), F.sum(a("p") * b("p") + a("m") * b("m")).alias("concordant"), F.sum(a("p") * b("m") + a("m") * b("p")).alias("discordant"),
        F.sum(a("p") * b("p")).alias("both_positive"), F.sum(a("p") * b("n") + a("n") * b("p") - a("p") * b("p")).alias("either"),
    )
    return out.withColumn("jaccard", F.col("both_positive") / F.when(F.col("either") > 0, F.col("either"))).drop("either")


def conflict(ledger: DataFrame, key: str) -> DataFrame:
    """Support against refutation for each key: entropy of the two shares and the spread of the logs."""
    x = F.col("weight") * F.ln("factor")
    g = ledger.groupBy(key).agg(F.sum(F.greatest(x, F.lit(0.0))).alias("support"), F.sum(F.greatest(-x, F.lit(0.0))).alias("refute"), (F.max(x) - F.min(x)).alias("spread"))
    share = F.col("support") / F.when(F.col("support") + F.col("refute") > 0, F.col("support") + F.col("refute"))
    h = lambda p: F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))
    return g.select(key, "support", "refute", "spread", F.coalesce(h(share), F.lit(0.0)).alias("entropy"))


def set_jaccard(a: DataFrame, b: DataFrame, keys: list[str], empty: float | None = 1.0) -> DataFrame:
    """One row: sizes, intersection, union and Jaccard of two key sets; ``empty`` if both are."""
    rows = a.select(*keys, F.lit(1).alias("_a")).distinct().join(b.select(*keys, F.lit(1).alias("_b")).distinct(), keys, "full_outer")
    got = rows.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count(F.lit(1)).alias("either"))
    return got.withColumn("jaccard", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(F.lit(empty)))


def decision_changes(full: DataFrame, ablated: DataFrame, key: str, cutoff: float = 0.5) -> DataFrame:
    """Keys whose decision changes, as lost or gained; a key that is missing isn't selected."""
    rows = full.select(key, F.col("posterior").alias("p_full")).join(ablated.select(key, F.col("posterior").alias("p_ablated")), key, "full_outer")
    was, now = F.coalesce(F.col("p_full") > cutoff, F.lit(False)), F.coalesce(F.col("p_ablated") > cutoff, F.lit(False))
    return rows.where(was != now).select(key, "p_full", "p_ablated", F.when(was, "lost").otherwise("gained").alias("change"))


def threshold_sweep(values: DataFrame, value: str, tq: Column, multipliers: list[float]) -> DataFrame:
    """For each multiplier of the threshold: geometric mean factor, maximum, and how many factors exceed 1."""
    rows = values.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    factor = K.floored_likelihood(F.col(value), tq * F.col("multiplier")) / 0.5
    return rows.withColumn("f", factor).groupBy("multiplier").agg(
        F.exp(F.avg(F.ln("f"))).alias("geometric_mean"), F.max("f").alias("largest"), F.count_if(F.col("f") > 1 + 1e-12).alias("above_one"), F.count(F.lit(1)).alias("n")
    )


def compressed_scale(values: DataFrame, value: str) -> DataFrame:
    """log10(1 + x) where the tail is long (q99 over 100 medians, or over 1e4), else x."""
    stats = quantiles(values, F.col(value), [0.5, 0.99]).select("q")
    rows = values.join(F.broadcast(stats))  # one row
    long_tail = (F.col("q")[1] > 100 * F.col("q")[0]) | (F.col("q")[1] > 1e4)
    return rows.withColumn("shown", F.when(long_tail, F.log10(1 + F.col(value))).otherwise(F.col(value))).withColumn("compressed", long_tail).drop("q")
