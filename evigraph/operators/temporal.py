"""Time courses: log ratios, variance trend, moderated t, response times, order statistics."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.special import t_pvalue
from evigraph.operators.order import quantiles

EPS = float(np.finfo(float).eps)


def log_ratios(rows: DataFrame, case: str, control: str) -> DataFrame:
    """log2(case / control) where both are positive, else null."""
    return rows.withColumn("log2_ratio", F.when((F.col(case) > 0) & (F.col(control) > 0), F.log2(F.col(case) / F.col(control))))


def timepoints(rows: DataFrame, keys: list[str], time: str = "minute", value: str = "log2_ratio", intensity: str = "intensity") -> DataFrame:
    """Mean, sample variance and count of each site's replicates at each time."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, time).agg(
        F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.count(value).alias("n"), F.percentile(intensity, F.lit(0.5)).alias("intensity")
    )


def variance_trend(points: DataFrame, bins: int = 25, least: int = 20) -> DataFrame:
    """(center, trend) of the bins between quantiles of log10 intensity, plus the overall median as ``overall``.

    At most ``bins`` rows: medians inside a bin are one group-by, edges one aggregate.
    """
    usable = points.where((F.col("n") >= 2) & (F.col("intensity") > 0) & (F.col("variance") >= 0)).select(F.log10("intensity").alias("x"), "variance")
    edges = quantiles(usable, F.col("x"), [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("edges"))
    edges = edges.join(quantiles(usable, F.col("variance"), [0.5]).select(F.greatest(F.col("q")[0], F.lit(EPS)).alias("overall")))  # one row each
    rows = usable.join(F.broadcast(edges))  # one row
    at = F.size(F.filter("edges", lambda e: e <= F.col("x")))
    rows = rows.withColumn("bin", F.least(at, F.size("edges") - 1))
    grouped = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.percentile("x", F.lit(0.5)).alias("center"), F.greatest(F.percentile("variance", F.lit(0.5)), F.lit(EPS)).alias("trend"), F.first("overall").alias("overall"))
    return grouped.where(F.col("n") >= least).select("center", "trend", "overall")


def prior_variance(points: DataFrame, trend: DataFrame) -> DataFrame:
    """Linear interpolation in the trend, flat beyond its ends; the trend is one row of at most 25 structs."""
    packed = trend.agg(F.array_sort(F.collect_list(F.struct("center", "trend"))).alias("knots"), F.first("overall").alias("overall"))
    rows = points.join(F.broadcast(packed)).withColumn("x", F.when(F.col("intensity") > 0, F.log10("intensity")))  # one row
    below = F.filter("knots", lambda k: k["center"] <= F.col("x"))
    above = F.filter("knots", lambda k: k["center"] > F.col("x"))
    lo, hi = F.element_at(below, -1), F.element_at(above, 1)
    share = (F.col("x") - lo["center"]) / (hi["center"] - lo["center"])
    inside = lo["trend"] + share * (hi["trend"] - lo["trend"])
    value = F.when(F.col("x").isNull() | (F.size("knots") == 0), F.col("overall")).when(F.size(below) == 0, hi["trend"]).when(F.size(above) == 0, lo["trend"]).otherwise(inside)
    return rows.withColumn("prior_variance", F.greatest(value, F.lit(EPS))).drop("knots", "overall", "x")


def moderated_t(points: DataFrame, prior_df: float = 4.0) -> DataFrame:
    """Variance shrunk to the prior; a single replicate takes the prior alone."""
    if not prior_df > 0:
        raise ValueError("prior_df must be positive")
    df = F.greatest(F.col("n") - 1, F.lit(0))
    var = F.when(F.col("n") > 1, (F.lit(prior_df) * F.col("prior_variance") + df * F.col("variance")) / (F.lit(prior_df) + df)).otherwise(F.col("prior_variance"))
    rows = points.withColumn("se", F.sqrt(var / F.col("n"))).withColumn("df", F.lit(prior_df) + df)
    return rows.withColumn("t", F.abs(F.col("mean")) / F.when(F.col("se") > 0, F.col("se")))


def gene_responses(points: DataFrame, gene: str, site: str, time: str = "minute", alpha: float = 0.05) -> DataFrame:
    """The site with the largest |t|, its corrected p and centre of mass; the correction counts all of the gene's tests."""
    tests = points.groupBy(gene).agg(F.count(F.lit(1)).alias("tests"))
    peak = Window.partitionBy(gene).orderBy(F.desc_nulls_last("t"), site, time)
    best = points.withColumn("_n", F.row_number().over(peak)).where("_n = 1").select(gene, F.col(site).alias("_site"), F.col("t").alias("peak_t"), F.col("df").alias("peak_df"))
    mass = points.join(best, gene).where(F.col(site) == F.col("_site")).groupBy(gene).agg(
        (F.sum(F.abs("mean") * F.col(time)) / F.when(F.sum(F.abs("mean")) > 0, F.sum(F.abs("mean")))).alias("center_of_mass"), F.count(F.lit(1)).alias("times")
    )
    rows = best.join(mass, gene).join(tests, gene).withColumn("p_raw", t_pvalue("peak_t", "peak_df"))
    rows = rows.withColumn("p", F.least(F.lit(1.0), F.col("p_raw") * F.col("tests")))
    return rows.withColumn("passed", F.col("p") < alpha).withColumnRenamed("_site", "best_site")


def response_draws(points: DataFrame, gene: str, time: str = "minute", draws: int = 200, seed: int = 0) -> DataFrame:
    """Seeded draws of each gene's response time; a gene's generator depends on the gene and the seed alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        name = pdf[gene].iloc[0]
        pdf = pdf.sort_values(time)
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
        x = np.abs(rng.normal(pdf["mean"].to_numpy(), pdf["se"].fillna(0).to_numpy(), (draws, len(pdf))))
        total = x.sum(axis=1)
        return pd.DataFrame({gene: name, "draw": np.arange(draws, dtype="int32"), "response": x @ pdf[time].to_numpy(float) / np.where(total > 0, total, EPS)})

    kind = points.schema[gene].dataType.simpleString()
    return points.select(gene, time, "mean", "se").groupBy(gene).applyInPandas(run, f"{gene} {kind}, draw int, response double")


def sensitivity(points: DataFrame, gene: str, site: str, priors: list[float], alphas: list[float], time: str = "minute") -> DataFrame:
    """Responses for a grid (prior_df, alpha): each prior is worked out once, the cutoffs only gate it again."""
    parts = [gene_responses(moderated_t(points, p), gene, site, time, alpha=1.0).withColumn("prior_df", F.lit(float(p))) for p in priors]
    rows = functools.reduce(DataFrame.unionByName, parts).drop("passed")
    return rows.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas]))).withColumn("passed", F.col("p") < F.col("alpha"))


def sensitivity_paths(path_nodes: DataFrame, grid: DataFrame, draws: DataFrame, node: str) -> DataFrame:
    """Order statistics of each path in each cell of the grid, over the nodes that pass there.

    ``draws``: (prior_df, node, draw, response), one set a prior.
    """
    cell = ["prior_df", "alpha"]
    key = lambda c: F.struct(*cell, c).alias(c)
    passed = grid.where("passed").select(*cell, node)
    placed = path_nodes.crossJoin(F.broadcast(grid.select(*cell).distinct()))  # the grid's few cells
    drawn = passed.join(draws, ["prior_df", node])
    out = path_order(placed.select(key("path"), "pos", key(node)), drawn.select(key(node), "draw", "response"), node)
    return out.select("path.*", *[c for c in out.columns if c != "path"])


def path_order(path_nodes: DataFrame, draws: DataFrame, node: str) -> DataFrame:
    """For each path: soft precedence and Kendall tau over the draws; (path, pos, node) against (node, draw, response)."""
    placed = path_nodes.join(draws, node).select("path", "pos", "draw", "response")
    a, b = placed.alias("a"), placed.alias("b")
    met = a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.draw") == F.col("b.draw")) & (F.col("a.pos") < F.col("b.pos")))
    sign = F.signum(F.col("b.response") - F.col("a.response"))
    soft = F.avg(F.when(sign > 0, 1.0).when(sign == 0, 0.5).otherwise(0.0))
    each = met.groupBy(F.col("a.path").alias("path"), F.col("a.draw").alias("draw")).agg(F.avg(sign).alias("tau"), soft.alias("soft"))
    return each.groupBy("path").agg(F.avg("soft").alias("soft_precedence"), F.avg("tau").alias("tau_mean"), F.percentile("tau", F.lit(0.025)).alias("tau_low"), F.percentile("tau", F.lit(0.975)).alias("tau_high"))


def kendall(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """tau-a, tau-b and the share of concordant pairs in each (bounded) group."""
    r = rows.select(group, x, y, F.row_number().over(Window.partitionBy(group).orderBy(x, y)).alias("_i"))
    a, b = r.alias("a"), r.alias("b")
    met = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a._i") < F.col("b._i")))
    sx, sy = F.signum(F.col(f"b.{x}") - F.col(f"a.{x}")), F.signum(F.col(f"b.{y}") - F.col(f"a.{y}"))
    out = met.groupBy(F.col(f"a.{group}").alias(group)).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(sx * sy).alias("s"), F.sum(F.abs(sx)).alias("nx"), F.sum(F.abs(sy)).alias("ny"), F.avg(F.when(sx * sy > 0, 1.0).otherwise(0.0)).alias("concordance")
    )
    return out.select(group, "pairs", (F.col("s") / F.col("pairs")).alias("tau_a"), (F.col("s") / F.when(F.col("nx") * F.col("ny") > 0, F.sqrt(F.col("nx") * F.col("ny")))).alias("tau_b"), "concordance")
