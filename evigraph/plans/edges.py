"""Queries of the edge stage: pairs of suppliers, their evidence, directions, paths and the search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import kernels as K
from evigraph.functions.keys import canonical_pairs
from evigraph.operators import graph as G
from evigraph.operators import pairs as P
from evigraph.plans.catalog import Tables, query, rounded
from evigraph.sources.state import cut

CO = (
    "so AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), "
    "co AS (SELECT a.s AS node_a, b.s AS node_b, count(*) AS n FROM so a JOIN so b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2)"
)


def co_supply(t: Tables) -> DataFrame:
    return P.co_occurring(t.lineitem, "l_orderkey", "l_suppkey")


@query(
    "pair_canonicalize_dedupe_max",
    "WITH r AS (SELECT lower(c_mktsegment) AS x, trim(o_orderpriority) AS y, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey "
    "UNION ALL SELECT trim(o_orderpriority), c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey) "
    "SELECT CASE WHEN (lower(x), x) <= (lower(y), y) THEN x ELSE y END AS node_a, CASE WHEN (lower(x), x) <= (lower(y), y) THEN y ELSE x END AS node_b, "
    "round(max(v), 6) AS best, count(*) AS n FROM r WHERE x <> '' AND y <> '' AND x <> y GROUP BY 1, 2",
)
def pair_canonicalize(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    one = rows.select(F.lower("c_mktsegment").alias("node_a"), F.col("o_orderpriority").alias("node_b"), "o_totalprice")
    two = rows.select(F.col("o_orderpriority").alias("node_a"), F.col("c_mktsegment").alias("node_b"), "o_totalprice")
    pairs = canonical_pairs(one.unionByName(two), "node_a", "node_b")
    return rounded(pairs.groupBy("node_a", "node_b").agg(F.max("o_totalprice").alias("best"), F.count(F.lit(1)).alias("n")))


SCORE = "n / (n + 40.0)"


@query("pair_odds_bf", f"WITH {CO}, s AS (SELECT *, {SCORE} AS score FROM co) SELECT node_a, node_b, round((score / (1 - score)) / (0.041 / 0.959), 6) AS bayes_factor FROM s")
def pair_odds(t: Tables) -> DataFrame:
    return rounded(co_supply(t).select("node_a", "node_b", K.odds_factor(F.col("n") / (F.col("n") + 40.0), 0.041).alias("bayes_factor")))


@query("pair_floored_odds_bf", f"WITH {CO}, s AS (SELECT *, {SCORE} AS score FROM co) SELECT node_a, node_b, round(greatest((score / (1 - score)) / (0.15 / 0.85), 1), 6) AS bayes_factor FROM s")
def pair_floored_odds(t: Tables) -> DataFrame:
    return rounded(co_supply(t).select("node_a", "node_b", K.odds_factor(F.col("n") / (F.col("n") + 40.0), 0.15, floor=True).alias("bayes_factor")))


@query("pair_zero_anchored_bf", f"WITH {CO} SELECT node_a, node_b, round((0.5 + 0.5 * (1 - exp(-0.5 * power(n / 6.0, 2)))) / 0.5, 6) AS bayes_factor FROM co")
def pair_zero_anchored(t: Tables) -> DataFrame:
    return rounded(co_supply(t).select("node_a", "node_b", K.zero_anchored_factor(F.col("n")).alias("bayes_factor")))


PROFILE = (
    "prof AS (SELECT l_suppkey AS s, c_nationkey AS d, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), "
    "nrm AS (SELECT s, sqrt(sum(w * w)) AS norm FROM prof GROUP BY 1), "
    "prod AS (SELECT a.s AS node_a, b.s AS node_b, sum(a.w * b.w) AS dot, sum(a.w * b.w / (na.norm * nb.norm)) AS cosine "
    "FROM prof a JOIN prof b ON a.d = b.d AND a.s < b.s JOIN nrm na ON na.s = a.s JOIN nrm nb ON nb.s = b.s GROUP BY 1, 2)"
)
THRESH = (
    "mir AS (SELECT node_a AS node, {v} AS v FROM prod UNION ALL SELECT node_b, {v} FROM prod), "
    "th AS (SELECT node, CASE WHEN quantile_cont(v, 0.75) > 0 THEN quantile_cont(v, 0.75) ELSE quantile_cont(v, 0.75) FILTER (WHERE v > 0) END AS tq FROM mir GROUP BY 1)"
)
#: The same over all pairs: those without a common dimension count as zeros.
ZERO_THRESH = (
    "mir AS (SELECT a.s AS node, coalesce({v}, 0) AS v FROM nrm a JOIN nrm b ON a.s <> b.s LEFT JOIN prod ON node_a = least(a.s, b.s) AND node_b = greatest(a.s, b.s)), "
    + THRESH[THRESH.index("th AS") :]
)
RECIP = (
    "SELECT prod.node_a, prod.node_b, round({v}, 6) AS {v}, round((CASE WHEN a.tq IS NULL THEN 0.5 ELSE greatest(0.5, 1 - exp(-0.5 * power(greatest({v}, 0) / a.tq, 2))) END + "
    "CASE WHEN b.tq IS NULL THEN 0.5 ELSE greatest(0.5, 1 - exp(-0.5 * power(greatest({v}, 0) / b.tq, 2))) END) / 2 / 0.5, 6) AS factor "
    "FROM prod LEFT JOIN th a ON a.node = node_a LEFT JOIN th b ON b.node = node_b"
)


def profiles(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("l_suppkey").alias("s"), F.col("c_nationkey").alias("d")).agg(F.sum("l_quantity").alias("w"))


def _reciprocal(rows: DataFrame, value: str, continuous: bool = False) -> DataFrame:
    """Pairs without a common dimension are zeros in the thresholds, and have no row."""
    return rounded(P.reciprocal_products(rows, "s", "d", "w", value, continuous=continuous).select("node_a", "node_b", value, "factor"))


@query("pair_dot_bf", f"WITH {PROFILE}, {ZERO_THRESH.format(v='dot')} {RECIP.format(v='dot')}")
def pair_dot(t: Tables) -> DataFrame:
    return _reciprocal(profiles(t), "dot")


@query("pair_cosine_bf", f"WITH {PROFILE}, {ZERO_THRESH.format(v='cosine')} {RECIP.format(v='cosine')}")
def pair_cosine(t: Tables) -> DataFrame:
    return _reciprocal(profiles(t), "cosine")


SPARSE_PROFILE = PROFILE.replace("l_orderkey = o_orderkey JOIN", "l_orderkey = o_orderkey AND l_quantity >= 49 AND l_discount > 0.07 JOIN")


def sparse_profiles(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_quantity >= 49 AND l_discount > 0.07").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("l_suppkey").alias("s"), F.col("c_nationkey").alias("d")).agg(F.sum("l_quantity").alias("w"))


@query("pair_dot_sparse_bf", f"WITH {SPARSE_PROFILE}, {ZERO_THRESH.format(v='dot')} {RECIP.format(v='dot')}")
def pair_dot_sparse(t: Tables) -> DataFrame:
    return _reciprocal(sparse_profiles(t), "dot")


@query("pair_dot_sparse_continuous_bf", f"WITH {SPARSE_PROFILE}, {ZERO_THRESH.format(v='dot')} {RECIP.format(v='dot').replace('greatest(0.5,', 'greatest(0.5e-6,')}")
def pair_dot_continuous(t: Tables) -> DataFrame:
    return _reciprocal(sparse_profiles(t), "dot", continuous=True)


EMB = (
    "e AS (SELECT vec_id AS n, embedding::DOUBLE[] AS v FROM embeddings), "
    "prod AS (SELECT a.n AS node_a, b.n AS node_b, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS cosine FROM e a JOIN e b ON a.n < b.n)"
)


@query("node_similarity_threshold", f"WITH {EMB}, {THRESH.format(v='cosine')} SELECT node, round(tq, 6) AS tq FROM th")
def node_similarity_threshold(t: Tables) -> DataFrame:
    return rounded(P.dense_thresholds(t.embeddings, "vec_id", "embedding", "cosine"))


@query(
    "pair_sum_log_bf",
    "WITH so AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, l_returnflag AS f FROM lineitem), co AS (SELECT a.s AS node_a, b.s AS node_b, a.f AS f, count(*) AS n FROM so a JOIN so b ON a.o = b.o AND a.f = b.f AND a.s < b.s GROUP BY 1, 2, 3) "
    "SELECT node_a, node_b, round(exp(sum(ln((0.5 + 0.5 * (1 - exp(-0.5 * power(n / 6.0, 2)))) / 0.5))), 6) AS bayes_factor, count(*) AS n FROM co GROUP BY 1, 2",
)
def pair_sum_log(t: Tables) -> DataFrame:
    so = t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag").distinct()
    a, b = so.alias("a"), so.alias("b")
    met = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_returnflag") == F.col("b.l_returnflag")) & (F.col("a.l_suppkey") < F.col("b.l_suppkey")))
    co = met.groupBy(F.col("a.l_suppkey").alias("node_a"), F.col("b.l_suppkey").alias("node_b"), F.col("a.l_returnflag").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.summed_log_factors(co.withColumn("bayes_factor", K.zero_anchored_factor(F.col("n")))))


@query(
    "pair_incremental_only",
    "SELECT a.s_suppkey AS node_a, b.s_suppkey AS node_b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE a.s_acctbal < 0 OR b.s_acctbal < 0",
)
def pair_incremental(t: Tables) -> DataFrame:
    return P.incremental_pairs(t.supplier, "s_suppkey", F.col("s_acctbal") < 0)


PCP = "m AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, CASE WHEN a.n_nationkey = b.n_nationkey THEN 1.0 WHEN a.n_regionkey = b.n_regionkey THEN 0.6 ELSE 0.0 END AS c FROM nation a CROSS JOIN nation b)"


@query(
    "pair_compatibility_pcp",
    f"WITH {PROFILE}, f AS (SELECT s, d, w / sum(w) OVER (PARTITION BY s) AS w FROM prof), {PCP}, h AS (SELECT s AS node_a, j, sum(w * c) AS h FROM f JOIN m ON d = i WHERE c > 0 GROUP BY 1, 2) "
    "SELECT node_a, f.s AS node_b, round(sum(h * w), 6) AS compatible FROM h JOIN f ON h.j = f.d AND node_a < f.s GROUP BY 1, 2",
)
def pair_pcp(t: Tables) -> DataFrame:
    p = profiles(t)
    fractions = p.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("s")))
    # nations of one region; the table of compatible kinds is small and fixed
    a, b = t.nation.alias("a"), t.nation.alias("b")
    same = F.when(F.col("a.n_nationkey") == F.col("b.n_nationkey"), 1.0).otherwise(0.6)
    matrix = a.join(b, F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_nationkey").alias("i"), F.col("b.n_nationkey").alias("j"), same.alias("c"))
    return rounded(P.compatibility(fractions, matrix, "s", "d", "w"))


EDGE = (
    f"{CO}, cat AS (SELECT node_a, node_b, 'co' AS stream, 1.0 AS weight, (0.5 + 0.5 * (1 - exp(-0.5 * power(n / 6.0, 2)))) / 0.5 AS bf FROM co "
    f"UNION ALL SELECT node_a, node_b, 'odds', 0.5, ({SCORE} / (1 - {SCORE})) / (0.15 / 0.85) FROM co), "
    "ep AS (SELECT node_a, node_b, sum(weight * ln(bf)) AS log_odds, 1 / (1 + exp(-sum(weight * ln(bf)))) AS posterior FROM cat GROUP BY 1, 2)"
)


def edge_ledger(t: Tables) -> DataFrame:
    """Both streams of a pair come from its one row, so they stay together and aren't shuffled again."""
    n = F.col("n")
    entry = lambda name, weight, factor: F.struct(F.lit(name).alias("stream"), F.lit(weight).alias("weight"), factor.alias("factor"))
    both = F.array(entry("co", 1.0, K.zero_anchored_factor(n)), entry("odds", 0.5, K.odds_factor(n / (n + 40.0), 0.15)))
    return co_supply(t).select("node_a", "node_b", F.inline(both))


def edge_posteriors(t: Tables) -> DataFrame:
    from evigraph.operators.evidence import integrate

    return integrate(edge_ledger(t), ["node_a", "node_b"])


@query("edge_posterior", f"WITH {EDGE} SELECT node_a, node_b, round(log_odds, 6) AS log_odds, round(posterior, 6) AS posterior FROM ep")
def edge_posterior(t: Tables) -> DataFrame:
    return rounded(edge_posteriors(t).select("node_a", "node_b", "log_odds", "posterior"))


@query("edge_supported", f"WITH {EDGE} SELECT node_a, node_b, round(posterior, 6) AS posterior FROM ep WHERE round(posterior, 9) > 0.6")
def edge_supported(t: Tables) -> DataFrame:
    return rounded(edge_posteriors(t).where(F.round("posterior", 9) > 0.6).select("node_a", "node_b", "posterior"))


@query("edge_contributions", f"WITH {EDGE} SELECT node_a, node_b, stream, round(weight * ln(bf), 6) AS contribution FROM cat WHERE abs(weight * ln(bf)) > 1e-14")
def edge_contributions(t: Tables) -> DataFrame:
    rows = edge_ledger(t).select("node_a", "node_b", "stream", K.log_contribution(F.col("factor"), F.col("weight")).alias("contribution"))
    return rounded(rows.where(F.abs("contribution") > 1e-14))


@query(
    "pair_eligibility_fill",
    f"WITH {CO}, f AS (SELECT node_a, node_b, (0.5 + 0.5 * (1 - exp(-0.5 * power(n / 6.0, 2)))) / 0.5 AS bf FROM co WHERE n >= 5), "
    "el AS (SELECT a.s_suppkey AS node_a, b.s_suppkey AS node_b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey) "
    "SELECT node_a, node_b, round(bf, 6) AS bayes_factor FROM f UNION ALL SELECT node_a, node_b, 0.5 FROM el WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.node_a = el.node_a AND f.node_b = el.node_b)",
)
def pair_fill(t: Tables) -> DataFrame:
    factors = co_supply(t).where("n >= 5").select("node_a", "node_b", K.zero_anchored_factor(F.col("n")).alias("bayes_factor"))
    return rounded(P.eligibility_fill(P.co_occurring(t.supplier, "s_nationkey", "s_suppkey"), factors, 0.5))


ANCHOR = "an AS (SELECT l_suppkey AS hub, o_custkey AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING sum(l_quantity) > 60)"


@query(
    "closure_shared_anchor",
    f"WITH {ANCHOR}, u AS (SELECT hub FROM an GROUP BY 1 HAVING count(*) >= 2), k AS (SELECT an.* FROM an JOIN u USING (hub)) "
    "SELECT a.node AS node_a, b.node AS node_b, count(*) AS supporting, string_agg(a.hub::VARCHAR, ';' ORDER BY a.hub::VARCHAR) AS hubs, 1.8 AS bayes_factor FROM k a JOIN k b ON a.hub = b.hub AND a.node < b.node GROUP BY 1, 2",
)
def closure(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("hub"), F.col("o_custkey").alias("node")).agg(F.sum("l_quantity").alias("q"))
    return P.shared_anchor_closure(rows.where("q > 60"), "hub", "node")


# -- directions: nations are the nodes of a small graph, brands and regions give their classes

NGRAPH = (
    "sh AS (SELECT c_nationkey AS cn, s_nationkey AS sn, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), "
    "ec AS (SELECT least(cn, sn) AS node_a, greatest(cn, sn) AS node_b, count(*) AS n FROM sh WHERE cn <> sn GROUP BY 1, 2), "
    "ne AS (SELECT node_a, node_b, n / (n + (SELECT avg(n) FROM ec)) AS p FROM ec)"
)
CLASS_OF = ["ligand", "receptor", "kinase", "kinase_phosphatase_binding", "cyclase", "second_messenger"]
NCLASS = (
    "ncl AS (SELECT n_nationkey AS node, ['ligand','receptor','kinase','kinase_phosphatase_binding','cyclase','second_messenger'][n_regionkey + 1] AS class FROM nation "
    "UNION ALL SELECT n_nationkey, 'second_messenger_binding' FROM nation WHERE length(n_name) > 8), "
    "rules(rule, source_class, target_class) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in G.RULES) + "), "
    "rs AS (SELECT node_a, node_b, bool_or(f) AS r_ab, bool_or(NOT f) AS r_ba, string_agg(DISTINCT rule, ';' ORDER BY rule) AS rules FROM ("
    "SELECT node_a, node_b, true AS f, rule FROM ne JOIN ncl a ON a.node = node_a JOIN ncl b ON b.node = node_b JOIN rules ON a.class = source_class AND b.class = target_class UNION ALL "
    "SELECT node_a, node_b, false, rule FROM ne JOIN ncl a ON a.node = node_a JOIN ncl b ON b.node = node_b JOIN rules ON b.class = source_class AND a.class = target_class) GROUP BY 1, 2), "
    "rec AS (SELECT least(sn, cn) AS node_a, greatest(sn, cn) AS node_b, bool_or(sn < cn) AS d_ab, bool_or(sn > cn) AS d_ba, count(*) AS records FROM sh WHERE sn <> cn AND l_linenumber = 7 GROUP BY 1, 2)"
)
RESOLVED = (
    f"{NGRAPH}, {NCLASS}, j AS (SELECT ne.node_a, ne.node_b, p, coalesce(r_ab, false) AS r_ab, coalesce(r_ba, false) AS r_ba, coalesce(d_ab, false) AS d_ab, coalesce(d_ba, false) AS d_ba "
    "FROM ne LEFT JOIN rs USING (node_a, node_b) LEFT JOIN rec USING (node_a, node_b)), "
    "res AS (SELECT node_a, node_b, p, CASE WHEN r_ab <> r_ba THEN r_ab WHEN d_ab <> d_ba THEN d_ab ELSE true END AS a_to_b, CASE WHEN r_ab <> r_ba THEN r_ba WHEN d_ab <> d_ba THEN d_ba ELSE true END AS b_to_a, "
    "CASE WHEN r_ab <> r_ba AND d_ab <> d_ba AND r_ab = d_ab THEN 'rule+record' WHEN r_ab <> r_ba THEN 'rule' WHEN d_ab <> d_ba THEN 'record' WHEN r_ab OR d_ab THEN 'conflict' ELSE 'none' END AS basis FROM j), "
    "de AS (SELECT node_a AS src, node_b AS dst, p, -ln(p) AS cost FROM res WHERE a_to_b AND p > 0.5 UNION ALL SELECT node_b, node_a, p, -ln(p) FROM res WHERE b_to_a AND p > 0.5)"
)


def shipments(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("c_nationkey").alias("cn"), F.col("s_nationkey").alias("sn"), "l_linenumber")


def nation_edges(t: Tables) -> DataFrame:
    n = shipments(t).where("cn != sn").groupBy(F.least("cn", "sn").alias("node_a"), F.greatest("cn", "sn").alias("node_b")).agg(F.count(F.lit(1)).alias("n"))
    mean = n.agg(F.avg("n").alias("m"))
    return n.join(F.broadcast(mean)).select("node_a", "node_b", (F.col("n") / (F.col("n") + F.col("m"))).alias("p"))  # one row


def nation_classes(t: Tables) -> DataFrame:
    by_region = F.element_at(F.array(*[F.lit(c) for c in CLASS_OF]), F.col("n_regionkey") + 1)
    one = t.nation.select(F.col("n_nationkey").alias("node"), by_region.alias("class"))
    return one.unionByName(t.nation.where(F.length("n_name") > 8).select(F.col("n_nationkey").alias("node"), F.lit("second_messenger_binding").alias("class")))


def records(t: Tables) -> DataFrame:
    return shipments(t).where("l_linenumber = 7").select(F.col("sn").alias("source"), F.col("cn").alias("target"))


def resolved(t: Tables) -> DataFrame:
    edges = nation_edges(t)
    return G.resolve_directions(edges, G.rule_support(edges, nation_classes(t), G.rule_table(t.spark)), G.record_support(records(t)))


def graph_edges(t: Tables) -> DataFrame:
    return G.costs(G.directed_edges(resolved(t)), 0.5)


@query("direction_rules", f"WITH {NGRAPH}, {NCLASS} SELECT node_a, node_b, r_ab AS a_to_b, r_ba AS b_to_a, rules FROM rs")
def direction_rules(t: Tables) -> DataFrame:
    return G.rule_support(nation_edges(t), nation_classes(t), G.rule_table(t.spark))


@query("direction_records", f"WITH {NGRAPH}, {NCLASS} SELECT node_a, node_b, d_ab AS a_to_b, d_ba AS b_to_a, records FROM rec")
def direction_records(t: Tables) -> DataFrame:
    return G.record_support(records(t))


@query("direction_resolved", f"WITH {RESOLVED} SELECT node_a, node_b, round(p, 6) AS p, a_to_b, b_to_a, basis FROM res")
def direction_resolved(t: Tables) -> DataFrame:
    return rounded(resolved(t))


@query(
    "class_pair_catalog",
    "WITH c(i, c) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(G.CLASSES)) + "), r(rule, s, t) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in G.RULES) + ") "
    "SELECT a.c AS class_a, b.c AS class_b, coalesce(string_agg(DISTINCT rule, ';' ORDER BY rule), '') AS rules FROM c a JOIN c b ON a.i <= b.i LEFT JOIN r ON (a.c = s AND b.c = t) OR (b.c = s AND a.c = t) GROUP BY 1, 2",
)
def class_pairs(t: Tables) -> DataFrame:
    return G.class_pair_catalog(t.spark)


PATHS = (
    f"WITH RECURSIVE {RESOLVED}, walk(nodes, cost, last, hops) AS (SELECT [0::INT], 0.0::DOUBLE, 0::INT, 0 UNION ALL "
    "SELECT list_append(nodes, dst::INT), walk.cost + de.cost, dst::INT, hops + 1 FROM walk JOIN de ON src = last WHERE last <> 7 AND hops < 4 AND NOT list_contains(nodes, dst::INT)), "
    "top AS (SELECT nodes, cost, hops, row_number() OVER (ORDER BY cost, nodes) AS rank FROM walk WHERE last = 7 ORDER BY cost, nodes LIMIT 10)"
)


def ranked_paths(t: Tables) -> tuple[DataFrame, DataFrame]:
    edges = cut(graph_edges(t), "graph")
    paths = G.top_paths(edges, 0, 7, 10, 4)
    return paths.withColumn("rank", F.row_number().over(Window.orderBy("cost", "nodes")).cast("long")), edges


@query("paths_topk", f"{PATHS} SELECT rank, array_to_string(nodes, '->') AS path, round(cost, 6) AS cost, hops, round(exp(-cost), 6) AS product, round(exp(-cost / hops), 6) AS geometric_mean FROM top")
def paths_topk(t: Tables) -> DataFrame:
    paths, _ = ranked_paths(t)
    path = F.array_join(F.transform("nodes", lambda n: n.cast("string")), "->")
    return rounded(paths.select("rank", path.alias("path"), "cost", "hops", F.exp(-F.col("cost")).alias("product"), F.exp(-F.col("cost") / F.col("hops")).alias("geometric_mean")))


STEPS = f"{PATHS}, st AS (SELECT rank, unnest(range(1, len(nodes))) AS i, nodes FROM top), se AS (SELECT rank, i - 1 AS step, nodes[i] AS src, nodes[i + 1] AS dst FROM st)"


@query("path_edges", f"{STEPS} SELECT rank, step::INT AS step, se.src, se.dst, round(p, 6) AS p FROM se JOIN de ON de.src = se.src AND de.dst = se.dst")
def path_edges(t: Tables) -> DataFrame:
    paths, edges = ranked_paths(t)
    return rounded(G.path_edges(paths, edges))


@query("path_network_nodes", f"{PATHS}, n AS (SELECT rank, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS pos FROM top) SELECT node, count(*) AS paths, round(avg(pos), 6) AS mean_position, min(rank) AS best_rank FROM n GROUP BY 1")
def network_nodes(t: Tables) -> DataFrame:
    rows = ranked_paths(t)[0].select("rank", F.posexplode("nodes").alias("pos", "node"))
    return rounded(rows.groupBy("node").agg(F.count(F.lit(1)).alias("paths"), F.avg("pos").alias("mean_position"), F.min("rank").alias("best_rank")))


@query(
    "path_network_edges",
    f"{STEPS}, g AS (SELECT least(se.src, se.dst) AS node_a, greatest(se.src, se.dst) AS node_b, max(p) AS p, bool_or(se.src < se.dst) AS f, bool_or(se.src > se.dst) AS b, count(*) AS uses FROM se JOIN de ON de.src = se.src AND de.dst = se.dst GROUP BY 1, 2) "
    "SELECT node_a, node_b, round(p, 6) AS p, uses, f <> b AS arrow FROM g",
)
def network_edges(t: Tables) -> DataFrame:
    paths, edges = ranked_paths(t)
    rows = G.path_edges(paths, edges)
    g = rows.groupBy(F.least("src", "dst").alias("node_a"), F.greatest("src", "dst").alias("node_b")).agg(
        F.max("p").alias("p"), F.count(F.lit(1)).alias("uses"), (F.bool_or(F.col("src") < F.col("dst")) != F.bool_or(F.col("src") > F.col("dst"))).alias("arrow")
    )
    return rounded(g)


@query(
    "hop_limited_shortest",
    f"WITH RECURSIVE {RESOLVED}, h(hops, node, cost) AS (SELECT 0, 7::INT, 0.0::DOUBLE UNION ALL SELECT hops + 1, src::INT, de.cost + h.cost FROM h JOIN de ON dst = node WHERE hops < 4), "
    "b AS (SELECT node, hops, min(cost) AS cost FROM h GROUP BY 1, 2), k AS (SELECT DISTINCT hops FROM b), nn AS (SELECT DISTINCT node FROM b) "
    "SELECT nn.node, k.hops, round(min(b.cost), 6) AS cost FROM nn CROSS JOIN k JOIN b ON b.node = nn.node AND b.hops <= k.hops GROUP BY 1, 2",
)
def hop_limited(t: Tables) -> DataFrame:
    rows = G.hop_costs(cut(graph_edges(t), "graph"), 0, 7, 4).where("side = 1").select("node", F.posexplode("costs").alias("hops", "cost"))
    return rounded(rows.where(F.col("cost") < float("inf")))


@query(
    "reachability",
    f"WITH RECURSIVE {RESOLVED}, r(node, hops) AS (SELECT 0::INT, 0 UNION SELECT dst::INT, hops + 1 FROM r JOIN de ON src = node WHERE hops < 12) SELECT node, min(hops)::INT AS hops FROM r GROUP BY 1",
)
def reachability(t: Tables) -> DataFrame:
    return G.reachable(graph_edges(t), 0)


# -- backward search from nation 7, receptors are the nations of region 1

SHORT = (
    f"{RESOLVED}, bf AS (SELECT src, dst, ln(p / (1 - p)) AS log_bf FROM de), "
    "c0 AS (SELECT src AS candidate, 1 / (1 + exp(-log_bf)) AS cheap, log_bf FROM bf WHERE dst = 7 AND src <> 7), "
    "rk AS (SELECT *, row_number() OVER (ORDER BY cheap DESC, candidate) AS cheap_rank, candidate IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS is_receptor FROM c0)"
)


def search_edges(t: Tables) -> DataFrame:
    return graph_edges(t).select("src", "dst", F.ln(F.col("p") / (1 - F.col("p"))).alias("log_bf"))


def receptors(t: Tables) -> DataFrame:
    return t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("node"))


def first_round(t: Tables) -> DataFrame:
    front = t.spark.createDataFrame([("0", [7], 0.0)], "path_id string, nodes array<int>, log_p double")
    return G.shortlist(front, search_edges(t), receptors(t), 0.5, 4)


@query("beam_round0_shortlist", f"WITH {SHORT} SELECT candidate, round(cheap, 6) AS cheap, cheap_rank, is_receptor FROM rk WHERE cheap_rank <= 4 OR is_receptor")
def beam_shortlist(t: Tables) -> DataFrame:
    return rounded(first_round(t).select("candidate", "cheap", F.col("cheap_rank").cast("long").alias("cheap_rank"), "is_receptor"))


@query("beam_round0_scored", f"WITH {SHORT} SELECT candidate, round(ln(cheap), 6) AS score FROM rk WHERE cheap_rank <= 4 OR is_receptor ORDER BY ln(cheap) DESC, candidate LIMIT 3")
def beam_scored(t: Tables) -> DataFrame:
    scored = first_round(t).withColumn("score", F.ln("cheap"))
    return rounded(G.beam(scored, "score", 3).select("candidate", "score"))


def _rounds(depth: int, top_n: int, width: int) -> str:
    """The search's rounds one after the other; a round after a receptor was found has no paths."""
    out = ["f0 AS (SELECT '0' AS path_id, [7::INT] AS nodes, 0.0::DOUBLE AS log_p)"]
    for r in range(depth):
        out.append(
            f"g{r} AS (SELECT f.path_id, f.nodes, f.log_p, src AS candidate, log_p + ln(1 / (1 + exp(-log_bf))) AS score, row_number() OVER (PARTITION BY f.path_id ORDER BY 1 / (1 + exp(-log_bf)) DESC, src) AS cheap_rank, "
            f"src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS is_receptor FROM f{r} f JOIN bf ON dst = f.nodes[-1] WHERE NOT list_contains(f.nodes, src::INT)), "
            f"s{r} AS (SELECT * FROM g{r} WHERE cheap_rank <= {top_n} OR is_receptor QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY score DESC, path_id) = 1), "
            f"k{r} AS (SELECT s.path_id || '.' || s.candidate AS path_id, list_append(s.nodes, s.candidate::INT) AS nodes, s.score AS log_p, is_receptor FROM s{r} s ORDER BY s.score DESC, s.path_id, s.candidate LIMIT {width}), "
            f"f{r + 1} AS (SELECT path_id, nodes, log_p FROM k{r} WHERE NOT is_receptor AND NOT EXISTS (SELECT 1 FROM k{r} WHERE is_receptor))"
        )
    found = " UNION ALL ".join(f"SELECT nodes, log_p, {r} AS round FROM k{r} WHERE is_receptor" for r in range(depth))
    return ", ".join(out) + f" SELECT array_to_string(list_reverse(nodes), '->') AS path, round(exp(log_p), 6) AS p, round, 'receptor_reached' AS stopped FROM ({found})"


@query("beam_solutions", f"WITH {SHORT}, {_rounds(4, 3, 3)}")
def beam_solutions(t: Tables) -> DataFrame:
    found, why = G.backward_search(search_edges(t), 7, receptors(t), top_n=3, width=3, depth=4)
    return rounded(found.select(F.array_join(F.transform(F.reverse("nodes"), lambda n: n.cast("string")), "->").alias("path"), F.exp("log_p").alias("p"), "round", F.lit(why).alias("stopped")))


# -- caches and structural evidence

CACHE = (
    "old AS (SELECT l_partkey AS k, l_returnflag AS e, l_discount AS v, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_linestatus = 'O'), "
    "new AS (SELECT l_partkey AS k, l_returnflag AS e, l_tax AS v, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_linestatus = 'F')"
)


def cache_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    side = lambda status, v: t.lineitem.where(F.col("l_linestatus") == status).select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("e"), F.col(v).alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return side("O", "l_discount"), side("F", "l_tax")


@query("cache_upsert_replace", f"WITH {CACHE}, u AS (SELECT *, 0 AS side FROM old UNION ALL SELECT *, 1 FROM new), r AS (SELECT *, row_number() OVER (PARTITION BY k, e ORDER BY side DESC, seq DESC, v) AS rn FROM u) SELECT k, e, seq FROM r WHERE rn = 1")
def cache_replace(t: Tables) -> DataFrame:
    return P.upsert(*cache_sides(t), ["k", "e"]).select("k", "e", "seq")


@query(
    "cache_insert_ignore",
    f"WITH {CACHE}, o1 AS (SELECT k, e, min(seq) AS seq FROM old GROUP BY 1, 2), n1 AS (SELECT k, e, min(seq) AS seq FROM new GROUP BY 1, 2) SELECT * FROM o1 UNION ALL SELECT * FROM n1 WHERE NOT EXISTS (SELECT 1 FROM o1 WHERE o1.k = n1.k AND o1.e = n1.e)",
)
def cache_ignore(t: Tables) -> DataFrame:
    old, new = cache_sides(t)
    first = old.groupBy("k", "e").agg(F.min("seq").alias("seq"))
    return P.insert_absent(first, new.select("k", "e", "seq"), ["k", "e"])


@query(
    "structural_bf",
    f"WITH {CO} SELECT node_a, node_b, round(least(greatest((sc / (1 - sc)) / (0.6 / 0.4), 0.1), 10), 6) AS bayes_factor FROM (SELECT *, least(greatest(n / 12.0, 1e-6), 1 - 1e-6) AS sc FROM co)",
)
def structural(t: Tables) -> DataFrame:
    return rounded(co_supply(t).select("node_a", "node_b", K.structural_factor(F.col("n") / 12.0, 0.6, 0.1, 10.0).alias("bayes_factor")))


@query(
    "structural_priority_lookup",
    "WITH r AS (SELECT l_partkey AS k, l_shipdate, l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS rk, l_discount AS score FROM lineitem), "
    "m AS (SELECT k, rk, max(score) AS score FROM r GROUP BY 1, 2) SELECT k, rk AS protocol, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rk) AS rn FROM m) WHERE rn = 1",
)
def priority_lookup(t: Tables) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = t.lineitem.groupBy(F.col("l_partkey").alias("k"), rank.alias("protocol")).agg(F.max("l_discount").alias("score"))
    return rounded(P.first_by_priority(rows, ["k"], "protocol", ["protocol", "score"]))


@query(
    "substitute_suppression",
    f"WITH {EDGE} SELECT node_a, node_b, min(CASE WHEN stream = 'co' THEN 1 ELSE 2 END)::INT AS substitute FROM cat WHERE bf > 1.9 AND weight > 0 GROUP BY 1, 2",
)
def substitutes(t: Tables) -> DataFrame:
    order = F.when(F.col("stream") == "co", 1).otherwise(2)
    return edge_ledger(t).where("factor > 1.9 AND weight > 0").groupBy("node_a", "node_b").agg(F.min(order).alias("substitute"))


@query(
    "evidence_three_state",
    f"WITH {CO}, pr AS (SELECT node_a, node_b FROM co), f AS (SELECT node_a, node_b, (0.5 + 0.5 * (1 - exp(-0.5 * power(n / 6.0, 2)))) / 0.5 AS bf FROM co WHERE n >= 5), sc AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 3000) "
    "SELECT pr.node_a, pr.node_b, round(CASE WHEN bf IS NOT NULL THEN bf WHEN pr.node_a IN (SELECT node FROM sc) AND pr.node_b IN (SELECT node FROM sc) THEN 0.7 ELSE 1.0 END, 6) AS factor, bf IS NOT NULL AS found, "
    "bf IS NULL AND pr.node_a IN (SELECT node FROM sc) AND pr.node_b IN (SELECT node FROM sc) AS scoped_nonreport FROM pr LEFT JOIN f USING (node_a, node_b)",
)
def three_state(t: Tables) -> DataFrame:
    co = co_supply(t)
    found = co.where("n >= 5").select("node_a", "node_b", K.zero_anchored_factor(F.col("n")).alias("bayes_factor"))
    return rounded(P.three_state(co, found, t.supplier.where("s_acctbal > 3000").select(F.col("s_suppkey").alias("node")), 1.0, 0.7))
