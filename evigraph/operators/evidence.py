"""Evidence on nodes and pairs: thresholds, ledgers, posteriors.

The store is long: one row for each node (or pair) and stream, with the factor
and its weighted log.  Leaving a stream out is a filter, integrating is one
aggregate, and audit tables are pivots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import kernels as K
from evigraph.operators.order import quantiles, totals_before


@dataclass(frozen=True)
class Stream:
    """How a stream's value becomes a factor."""

    name: str
    neutral: float = 1.0
    weight: float = 1.0
    multiplier: float = 1.0
    continuous: bool = False
    floor: float = 1e-6


def background_threshold(values: DataFrame, value: str, q: float = 0.75, positive: bool = False) -> DataFrame:
    """One row: the exact, linearly interpolated quantile over all finite values."""
    x = K.finite(F.col(value))
    x = F.when(x > 0, x) if positive else x
    return quantiles(values, x, [q]).select(F.col("q")[0].alias("tq"), F.col("n").alias("background"))


#: Streams whose threshold is one for the whole source, and those with one for each row.
SOURCE_WIDE, BY_ROW = ("protein_abundance", "pc_transcript"), ("phosphoprotein_response", "site_level_phosphoprotein_response", "collecting_duct_abundance")
KINASE_TQ = 0.17


def node_values(nodes: DataFrame, handler: str, rows: DataFrame, key: str, value: str, tq: str | None = None) -> DataFrame:
    """(key, x, tq) of every node by the stream's handler; a missing measurement is null.

    A source-wide threshold is the first one stored (the least one of the least key), activities have a fixed
    one.  Where each row has its own, a missing or non-positive one becomes the median
    of the nodes' positive thresholds, so that a node without a row can be scored at
    zero.  A stream without any positive threshold is an error.
    """
    x = K.finite(F.col(value))
    if handler == "kinase_activity":
        found = rows.groupBy(key).agg(F.min(x).alias("x"))
        return nodes.select(key).join(found, key, "left").select(key, "x", F.lit(KINASE_TQ).alias("tq"))
    if handler not in SOURCE_WIDE + BY_ROW or tq is None:
        raise ValueError(f"no handler {handler}" if tq is not None else f"{handler} needs a threshold")
    t = K.finite(F.col(tq))
    found = rows.groupBy(key).agg(F.min(x).alias("x"), F.min(t).alias("tq"))
    known = nodes.select(key).join(found, key, "left")
    missing = F.raise_error(F.lit(f"stream {handler} has no positive threshold")).cast("double")
    if handler in SOURCE_WIDE:
        first = rows.where(t.isNotNull()).agg(F.min_by(t, F.struct(F.col(key), t.alias("_t"))).alias("first"))  # a key may have several
        return known.join(F.broadcast(first)).select(key, "x", F.coalesce(F.when(F.col("first") > 0, F.col("first")), missing).alias("tq"))  # one row
    middle = quantiles(known, F.when(F.col("tq") > 0, F.col("tq")), [0.5]).select(F.col("q")[0].alias("middle"))
    return known.join(F.broadcast(middle)).select(key, "x", F.coalesce(F.when(F.col("tq") > 0, F.col("tq")), F.col("middle"), missing).alias("tq"))  # one row


def value_counts(values: DataFrame, value: str, most: int = 64) -> DataFrame:
    """(value, n): how often each different value occurs if there are ``most`` or fewer of them, else nothing."""
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    few = counts.limit(most + 1)
    number = few.agg(F.count(F.lit(1)).alias("different"))
    return few.join(F.broadcast(number)).where(F.col("different") <= most).select("value", "n")  # one row


def signaling_factors(values: DataFrame, universe: DataFrame, key: str, value: str, q: float = 0.75, floor: float = 0.5) -> DataFrame:
    """The threshold comes from the whole background, before the universe is picked out."""
    tq = background_threshold(values, value, q)
    picked = values.join(universe.select(key).distinct(), key, "left_semi")
    return picked.join(F.broadcast(tq)).withColumn("factor", K.floored_factor(F.col(value), F.col("tq"), floor))  # one row


def stream_factor(stream: Stream, x: Column, t: Column, eligible: Column, observed: Column, penalty: float | None) -> Column:
    """Factor of one stream with its negative evidence.

    A continuous stream takes 0 for what wasn't seen; otherwise what is eligible
    but unobserved gets the fixed penalty, if there is one, and 1 if not.
    """
    t = t * F.lit(stream.multiplier)
    if stream.continuous:
        seen = F.when(observed, x).otherwise(F.lit(0.0))
        return F.when(eligible, K.continuous_factor(seen, t, stream.floor)).otherwise(F.lit(1.0))
    likelihood = K.floored_likelihood(x, t, floor=0.5)
    positive = F.when(observed, likelihood / F.lit(0.5)).otherwise(F.lit(1.0))
    if penalty is None:
        return positive
    return F.when(eligible & ~observed, F.lit(penalty)).otherwise(positive)


def integrate(ledger: DataFrame, keys: list[str], prior: float = 0.5, cutoff: float = 0.5) -> DataFrame:
    """Posterior from the sum of weighted log factors; duplicates of a key add up; the cutoff is strict."""
    total = ledger.groupBy(*keys).agg(F.sum(F.col("weight") * F.ln("factor")).alias("log_odds"))
    posterior = K.expit(K.logit(F.lit(prior)) + F.col("log_odds"))
    return total.withColumn("posterior", posterior).withColumn("selected", F.col("posterior") > cutoff)


def running_posterior(ledger: DataFrame, keys: list[str], order: str, prior: float = 0.5) -> DataFrame:
    """Before and after each stream, in its order."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.col("weight") * F.ln("factor")
    rows = ledger.withColumn("log_after", F.sum(step).over(upto)).withColumn("log_before", F.col("log_after") - step)
    start = K.logit(F.lit(prior))
    return rows.withColumn("before", K.expit(start + F.col("log_before"))).withColumn("after", K.expit(start + F.col("log_after")))


def categorical_update(priors: DataFrame, factors: DataFrame, key: str, missing: float = 0.5) -> DataFrame:
    """Normalized over all rows: totals are one row, joined back."""
    total = priors.agg(F.sum("prior").alias("total"))
    rows = priors.join(F.broadcast(total)).join(factors, key, "left")  # one row
    rows = rows.withColumn("raw", F.col("prior") / F.col("total") * F.coalesce("factor", F.lit(missing)))
    return rows.join(F.broadcast(rows.agg(F.sum("raw").alias("mass")))).withColumn("posterior", F.col("raw") / F.col("mass"))  # one row


def best_row(rows: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fixed_histogram(values: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins of [0, 1], the last one closed; empty bins are there too."""
    spark = values.sparkSession
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counted = values.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def log2_histogram(values: DataFrame, value: str, bins: int = 41, least_span: float = 0.25) -> DataFrame:
    """Symmetric histogram of log2 values; the span follows the largest one."""
    x = F.log2(F.col(value))
    span = values.agg(F.greatest(F.max(F.abs(x)), F.lit(least_span)).alias("span"))
    at = F.floor((F.col("x") + F.col("span")) / (2 * F.col("span")) * bins)
    rows = values.select(x.alias("x")).where("x is not null").join(F.broadcast(span))  # one row
    counted = rows.groupBy(F.greatest(F.lit(0), F.least(at, F.lit(bins - 1))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def quantile_curve(values: DataFrame, value: str, steps: int = 100) -> DataFrame:
    qs = [i / steps for i in range(steps + 1)]
    return quantiles(values, F.col(value), qs).select(F.posexplode("q").alias("step", "value"))


def percentile_position(values: DataFrame, key: str, value: str) -> DataFrame:
    """Shares below and tied, for every key: a running count over the different values, which are joined back."""
    counted = values.groupBy(value).agg(F.count(F.lit(1)).alias("ties"))
    ranked = totals_before(counted, [value], "ties", "below").join(F.broadcast(values.agg(F.count(value).alias("total"))))  # one row
    return values.join(ranked, value).select(key, value, (F.col("below") / F.col("total")).alias("share_below"), (F.col("ties") / F.col("total")).alias("share_tied"))
