"""Queries of the node stage: parts are the nodes, their line items the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import kernels as K
from evigraph.functions.keys import joined_set
from evigraph.operators.order import quantiles
from evigraph.operators import evidence as E
from evigraph.operators.order import with_rank
from evigraph.plans.catalog import Tables, query, rounded
from evigraph.sources.state import cut

LIK = "greatest(0.5, 1 - exp(-0.5 * power(greatest({x}, 0) / ({t}), 2)))"
QTY = "qty AS (SELECT l_partkey AS symbol, sum(l_quantity) AS x FROM lineitem GROUP BY 1), qt AS (SELECT quantile_cont(x, 0.75) AS tq FROM qty)"
REV = (
    "rev AS (SELECT l_partkey AS symbol, sum(l_extendedprice * (1 - l_discount)) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), "
    "rt AS (SELECT quantile_cont(x, 0.75) AS tq FROM rev WHERE x > 0)"
)
SITE = (
    "sites AS (SELECT l_partkey AS symbol, l_orderkey, l_linenumber, l_discount - l_tax AS lfc FROM lineitem), "
    "st AS (SELECT quantile_cont(abs(lfc), 0.75) AS tq FROM sites), "
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(lfc) DESC, l_orderkey, l_linenumber) AS rn FROM sites) WHERE rn = 1)"
)


def quantity(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("symbol")).agg(F.sum("l_quantity").alias("x"))


def returned_revenue(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_returnflag = 'R'")
    return rows.groupBy(F.col("l_partkey").alias("symbol")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))


def sites(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("symbol"), "l_orderkey", "l_linenumber", (F.col("l_discount") - F.col("l_tax")).alias("lfc"))


def best_sites(t: Tables) -> DataFrame:
    return E.best_row(sites(t), ["symbol"], F.desc(F.abs("lfc")), F.col("l_orderkey"), F.col("l_linenumber"))


@query(
    "node_abundance_bf",
    f"WITH {QTY} SELECT symbol, round(x, 6) AS x, round(tq, 6) AS tq, (SELECT count(*) FROM qty) AS background, "
    "round(greatest(0.5, 1 - exp(-0.5 * power(x / tq, 2))), 6) AS factor FROM qty, qt WHERE symbol IN (SELECT p_partkey FROM part WHERE p_size <= 25)",
)
def node_abundance_bf(t: Tables) -> DataFrame:
    universe = t.part.where("p_size <= 25").select(F.col("p_partkey").alias("symbol"))
    return rounded(E.signaling_factors(quantity(t), universe, "symbol", "x").select("symbol", "x", "tq", "background", "factor"))


@query(
    "node_transcript_bf_zero_excluded",
    f"WITH {REV} SELECT p_partkey AS symbol, round(coalesce(x, 0), 6) AS x, round(tq, 6) AS tq, "
    f"round(CASE WHEN x > 0 THEN {LIK.format(x='x', t='tq')} ELSE 0.5 END, 6) AS likelihood FROM part LEFT JOIN rev ON p_partkey = symbol CROSS JOIN rt",
)
def node_transcript(t: Tables) -> DataFrame:
    values = returned_revenue(t)
    tq = E.background_threshold(values, "x", positive=True).select("tq")
    rows = t.part.select(F.col("p_partkey").alias("symbol")).join(values, "symbol", "left").join(F.broadcast(tq))  # one row
    lik = F.when(F.col("x") > 0, K.floored_likelihood(F.col("x"), F.col("tq"))).otherwise(F.lit(0.5))
    return rounded(rows.select("symbol", F.coalesce("x", F.lit(0.0)).alias("x"), "tq", lik.alias("likelihood")))


@query(
    "node_site_max_bf",
    f"WITH {SITE} SELECT symbol, l_orderkey, l_linenumber, round(lfc, 6) AS lfc, round(greatest(0.5, 1 - exp(-0.5 * power(abs(lfc) / tq, 2))), 6) AS factor FROM best, st",
)
def node_site_max(t: Tables) -> DataFrame:
    tq = quantiles(sites(t), F.abs("lfc"), [0.75]).select(F.col("q")[0].alias("tq"))
    rows = best_sites(t).join(F.broadcast(tq))  # one row
    return rounded(rows.select("symbol", "l_orderkey", "l_linenumber", "lfc", K.floored_factor(F.abs("lfc"), F.col("tq")).alias("factor")))


@query(
    "node_site_median_collapse",
    "SELECT l_partkey AS symbol, round(median(l_discount - l_tax), 6) AS median_lfc, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS flags, "
    "count(*) AS n_sites FROM lineitem GROUP BY 1",
)
def node_site_median(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_partkey").alias("symbol"))
    return rounded(rows.agg(F.percentile(F.col("l_discount") - F.col("l_tax"), F.lit(0.5)).alias("median_lfc"), joined_set(F.col("l_returnflag")).alias("flags"), F.count(F.lit(1)).alias("n_sites")))


LEDGER = (
    f"{QTY}, {REV}, {SITE}, ledger AS ("
    f"SELECT p_partkey AS symbol, 1 AS ord, 'abundance' AS stream, 1.0 AS weight, CASE WHEN x IS NULL THEN 1.0 ELSE {LIK.format(x='x', t='tq * 0.5')} / 0.5 END AS factor "
    "FROM part LEFT JOIN qty ON p_partkey = symbol CROSS JOIN qt UNION ALL "
    f"SELECT p_partkey, 2, 'revenue', 0.5, CASE WHEN x IS NULL THEN 1.0 ELSE {LIK.format(x='x', t='tq')} / 0.5 END FROM part LEFT JOIN rev ON p_partkey = symbol CROSS JOIN rt UNION ALL "
    "SELECT symbol, 3, 'site', 0.8, greatest(0.5, 1 - exp(-0.5 * power(abs(lfc) / tq, 2))) FROM best, st)"
)


def ledger(t: Tables) -> DataFrame:
    """(symbol, ord, stream, weight, factor): the long store of the node stage."""
    parts = t.part.select(F.col("p_partkey").alias("symbol"))

    def abundance(values: DataFrame, ord_: int, name: str, weight: float, multiplier: float, positive: bool) -> DataFrame:
        values = cut(values, "sums")  # the threshold and the factors are of the same sums
        tq = E.background_threshold(values, "x", positive=positive).select("tq")
        rows = parts.join(values, "symbol", "left").join(F.broadcast(tq))  # one row
        stream = E.Stream(name, 0.5, weight, multiplier)
        factor = E.stream_factor(stream, F.col("x"), F.col("tq"), F.lit(True), F.col("x").isNotNull(), None)
        return rows.select("symbol", F.lit(ord_).alias("ord"), F.lit(name).alias("stream"), F.lit(weight).alias("weight"), factor.alias("factor"))

    tq = quantiles(sites(t), F.abs("lfc"), [0.75]).select(F.col("q")[0].alias("tq"))
    site = best_sites(t).join(F.broadcast(tq))  # one row
    site = site.select("symbol", F.lit(3).alias("ord"), F.lit("site").alias("stream"), F.lit(0.8).alias("weight"), K.floored_factor(F.abs("lfc"), F.col("tq")).alias("factor"))
    return abundance(quantity(t), 1, "abundance", 1.0, 0.5, False).unionByName(abundance(returned_revenue(t), 2, "revenue", 0.5, 1.0, True)).unionByName(site)


POST = f"{LEDGER}, post AS (SELECT symbol, sum(weight * ln(factor)) AS log_odds FROM ledger GROUP BY 1), p AS (SELECT symbol, log_odds, 1 / (1 + exp(-log_odds)) AS posterior FROM post)"


@query(
    "node_posterior_integrated",
    f"WITH {POST} SELECT symbol, round(log_odds, 6) AS log_odds, round(posterior, 6) AS posterior, round(posterior, 9) > 0.5 AS selected, "
    "rank() OVER (ORDER BY round(posterior, 9) DESC) AS rank FROM p",
)
def node_posterior(t: Tables) -> DataFrame:
    rows = E.integrate(ledger(t), ["symbol"])
    nine = F.round("posterior", 9)
    return rounded(with_rank(rows.select("symbol", "log_odds", "posterior", (nine > 0.5).alias("selected")), -nine))


@query(
    "node_fixed_absence_penalty",
    f"WITH {REV} SELECT p_partkey AS symbol, p_type = 'ECONOMY' AS eligible, x IS NOT NULL AS observed, "
    f"round(CASE WHEN p_type = 'ECONOMY' AND x IS NULL THEN 0.5 WHEN x IS NOT NULL THEN {LIK.format(x='x', t='tq')} / 0.5 ELSE 1.0 END, 6) AS factor "
    "FROM part LEFT JOIN rev ON p_partkey = symbol CROSS JOIN rt",
)
def node_fixed_penalty(t: Tables) -> DataFrame:
    return _negative(t, E.Stream("revenue", 0.5), 0.5)


@query(
    "node_continuous_negative",
    f"WITH {REV} SELECT p_partkey AS symbol, p_type = 'ECONOMY' AS eligible, x IS NOT NULL AS observed, "
    "round(CASE WHEN p_type = 'ECONOMY' THEN greatest(1e-6, (1 - exp(-0.5 * power(greatest(coalesce(x, 0), 0) / tq, 2))) / 0.5) ELSE 1.0 END, 6) AS factor "
    "FROM part LEFT JOIN rev ON p_partkey = symbol CROSS JOIN rt",
)
def node_continuous(t: Tables) -> DataFrame:
    return _negative(t, E.Stream("revenue", 0.5, continuous=True), 0.5)


def _negative(t: Tables, stream: E.Stream, penalty: float) -> DataFrame:
    values = returned_revenue(t)
    tq = E.background_threshold(values, "x", positive=True).select("tq")
    rows = t.part.select(F.col("p_partkey").alias("symbol"), (F.col("p_type") == "ECONOMY").alias("eligible")).join(values, "symbol", "left").join(F.broadcast(tq))  # one row
    observed = F.col("x").isNotNull()
    factor = E.stream_factor(stream, F.col("x"), F.col("tq"), F.col("eligible"), observed, penalty)
    return rounded(rows.select("symbol", "eligible", observed.alias("observed"), factor.alias("factor")))


@query(
    "node_sequential_ledger",
    f"WITH {LEDGER}, l AS (SELECT *, sum(weight * ln(factor)) OVER (PARTITION BY symbol ORDER BY ord) AS la, weight * ln(factor) AS step FROM ledger) "
    "SELECT symbol, stream, round(1 / (1 + exp(-(la - step))), 6) AS before, round(1 / (1 + exp(-la)), 6) AS after FROM l",
)
def node_sequential(t: Tables) -> DataFrame:
    return rounded(E.running_posterior(ledger(t), ["symbol"], "ord").select("symbol", "stream", "before", "after"))


@query(
    "node_categorical_update",
    f"WITH {QTY}, pr AS (SELECT p_partkey AS symbol, p_retailprice / sum(p_retailprice) OVER () AS prior FROM part), "
    f"raw AS (SELECT pr.symbol, prior, prior * coalesce({LIK.format(x='x', t='tq')}, 0.5) AS raw FROM pr LEFT JOIN qty USING (symbol) CROSS JOIN qt) "
    "SELECT symbol, round(prior * 1e6, 6) AS prior_ppm, round(raw / sum(raw) OVER () * 1e6, 6) AS posterior_ppm FROM raw",
)
def node_categorical(t: Tables) -> DataFrame:
    priors = t.part.select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("prior"))
    values = quantity(t)
    tq = E.background_threshold(values, "x").select("tq")
    factors = values.join(F.broadcast(tq)).select("symbol", K.floored_likelihood(F.col("x"), F.col("tq")).alias("factor"))  # one row
    rows = E.categorical_update(priors, factors, "symbol")
    return rounded(rows.select("symbol", (F.col("prior") / F.col("total") * 1e6).alias("prior_ppm"), (F.col("posterior") * 1e6).alias("posterior_ppm")))


@query(
    "node_posterior_histogram50",
    f"WITH {POST}, h AS (SELECT least(floor(round(posterior, 9) * 50), 49)::INT AS bin, count(*) AS n FROM p GROUP BY 1) SELECT b::INT AS bin, coalesce(n, 0) AS n FROM range(50) r(b) LEFT JOIN h ON h.bin = b",
)
def node_histogram(t: Tables) -> DataFrame:
    return E.fixed_histogram(E.integrate(ledger(t), ["symbol"]).withColumn("posterior", F.round("posterior", 9)), "posterior")


@query(
    "factor_histogram41",
    f"WITH {LEDGER}, v AS (SELECT round(log2(factor), 9) AS x FROM ledger WHERE stream <> 'site'), s AS (SELECT greatest(max(abs(x)), 0.25) AS span FROM v), "
    "h AS (SELECT greatest(0, least(floor((x + span) / (2 * span) * 41), 40))::INT AS bin, count(*) AS n FROM v, s GROUP BY 1) "
    "SELECT b::INT AS bin, coalesce(n, 0) AS n FROM range(41) r(b) LEFT JOIN h ON h.bin = b",
)
def factor_histogram(t: Tables) -> DataFrame:
    rows = ledger(t).where("stream != 'site'").select(F.pow(F.lit(2.0), F.round(F.log2("factor"), 9)).alias("f"))
    return E.log2_histogram(rows, "f")


@query(
    "factor_quantiles101",
    f"WITH {QTY}, q AS (SELECT unnest(range(101)) AS step) SELECT step::INT AS step, round((SELECT quantile_cont(x, (SELECT list(i / 100.0) FROM range(101) t(i)))[step + 1] FROM qty), 6) AS value FROM q"
    .replace("(SELECT list(i / 100.0) FROM range(101) t(i))", "[" + ", ".join(str(i / 100) for i in range(101)) + "]"),
)
def factor_quantiles(t: Tables) -> DataFrame:
    return rounded(E.quantile_curve(quantity(t), "x"))


@query(
    "node_percentile_position",
    f"WITH {QTY} SELECT symbol, x, round((rank() OVER (ORDER BY x) - 1) / (count(*) OVER ())::DOUBLE, 6) AS share_below, round(count(*) OVER (PARTITION BY x) / (count(*) OVER ())::DOUBLE, 6) AS share_tied FROM qty",
)
def node_percentile(t: Tables) -> DataFrame:
    return rounded(E.percentile_position(quantity(t), "symbol", "x"))


@query(
    "node_audit_pivot",
    f"WITH {LEDGER} SELECT symbol, round(max(CASE WHEN stream = 'abundance' THEN factor END), 6) AS abundance, round(max(CASE WHEN stream = 'revenue' THEN factor END), 6) AS revenue, "
    "round(max(CASE WHEN stream = 'site' THEN factor END), 6) AS site FROM ledger GROUP BY 1",
)
def node_pivot(t: Tables) -> DataFrame:
    return rounded(ledger(t).groupBy("symbol").pivot("stream", ["abundance", "revenue", "site"]).agg(F.max("factor")))


@query(
    "node_rank_change",
    f"WITH {LEDGER}, a AS (SELECT symbol, sum(weight * ln(factor)) AS z, sum(CASE WHEN ord < 3 THEN weight * ln(factor) ELSE 0 END) AS z0 FROM ledger GROUP BY 1), "
    "r AS (SELECT symbol, rank() OVER (ORDER BY round(z0, 9) DESC) AS before, rank() OVER (ORDER BY round(z, 9) DESC) AS after FROM a) SELECT symbol, before, after, before - after AS rank_change FROM r",
)
def node_rank_change(t: Tables) -> DataFrame:
    step = F.col("weight") * F.ln("factor")
    rows = ledger(t).groupBy("symbol").agg(F.sum(step).alias("z"), F.sum(F.when(F.col("ord") < 3, step).otherwise(0.0)).alias("z0"))
    ranked = with_rank(with_rank(rows, -F.round("z0", 9), "before"), -F.round("z", 9), "after")
    return ranked.select("symbol", "before", "after", (F.col("before") - F.col("after")).alias("rank_change"))


@query(
    "node_universe_sets",
    f"WITH {POST}, sel AS (SELECT symbol FROM p WHERE round(posterior, 9) > 0.5), seed AS (SELECT p_partkey AS symbol FROM part WHERE p_size <= 25) "
    "SELECT symbol, 'both' AS side FROM sel WHERE symbol IN (SELECT symbol FROM seed) UNION ALL SELECT symbol, 'selected_only' FROM sel WHERE symbol NOT IN (SELECT symbol FROM seed)",
)
def node_universe_sets(t: Tables) -> DataFrame:
    chosen = E.integrate(ledger(t), ["symbol"]).where(F.round("posterior", 9) > 0.5).select("symbol")
    seed = t.part.where("p_size <= 25").select(F.col("p_partkey").alias("symbol"))
    both = chosen.join(seed, "symbol", "left_semi").withColumn("side", F.lit("both"))
    return both.unionByName(chosen.join(seed, "symbol", "left_anti").withColumn("side", F.lit("selected_only")))


FALLBACK = (
    "rw AS (SELECT l_partkey AS k, min(l_extendedprice) AS x, min(CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 9 = 2 THEN -1.0 ELSE l_quantity + 1 END) AS tq FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), "
    "kn AS (SELECT p_partkey AS k, x, tq FROM part LEFT JOIN rw ON rw.k = p_partkey), md AS (SELECT quantile_cont(tq, 0.5) FILTER (WHERE tq > 0) AS m FROM kn), fi AS (SELECT arg_min(tq, k) AS first FROM rw WHERE tq IS NOT NULL)"
)


@query(
    "node_values_by_handler",
    f"WITH {FALLBACK} SELECT 'collecting_duct_abundance' AS handler, k, round(x, 6) AS x, round(CASE WHEN tq > 0 THEN tq ELSE m END, 6) AS tq FROM kn, md UNION ALL SELECT 'kinase_activity', k, round(x, 6), 0.17 FROM kn UNION ALL SELECT 'pc_transcript', k, round(x, 6), first FROM kn, fi",
)
def node_values_by_handler(t: Tables) -> DataFrame:
    """Thresholds by row with the median for those that have none, a fixed one, and one for the whole source."""
    k = F.col("l_partkey")
    own = F.when(k % 4 == 0, None).when(k % 9 == 2, -1.0).otherwise(F.col("l_quantity") + 1)
    rows = t.lineitem.where("l_returnflag = 'R'").select(k.alias("k"), F.col("l_extendedprice").alias("v"), own.cast("double").alias("own"))
    parts = t.part.select(F.col("p_partkey").alias("k"))
    each = lambda handler: E.node_values(parts, handler, rows, "k", "v", "own").withColumn("handler", F.lit(handler))
    return rounded(each("collecting_duct_abundance").unionByName(each("kinase_activity")).unionByName(each("pc_transcript")))


@query("factor_value_counts", "WITH c AS (SELECT l_discount * 2 AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'few' AS what, round(value, 6) AS value, n FROM c")
def factor_value_counts(t: Tables) -> DataFrame:
    """Eleven discounts are counted; prices are too many."""
    few = E.value_counts(t.lineitem.withColumn("f", F.col("l_discount") * 2), "f").withColumn("what", F.lit("few"))
    return rounded(few.unionByName(E.value_counts(t.lineitem, "l_extendedprice").withColumn("what", F.lit("many"))))
