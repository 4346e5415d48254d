"""Queries on eligibility, triage, reconciliation, imports and identifier choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import kernels as K
from evigraph.functions.keys import labels
from evigraph.operators import curation as U
from evigraph.operators import pairs as P
from evigraph.plans.catalog import Tables, query, rounded
from evigraph.plans.edges import CO, EDGE, NGRAPH, PATHS, PROFILE, RESOLVED, co_supply, edge_ledger, graph_edges, nation_edges, profiles, ranked_paths
from evigraph.sources.state import cut


@query(
    "intermediate_eligibility",
    "WITH n AS (SELECT p_partkey, list_sort(list_intersect(string_split(p_name, ' '), ['ring', 'bolt', 'small'])) AS rl, p_type FROM part), r AS (SELECT p_partkey, CASE WHEN p_partkey IN (0, 7) THEN 'endpoint' WHEN p_type = 'PROMO' THEN 'external target is no intermediate' "
    "WHEN p_type = 'LARGE' THEN 'second messenger' WHEN len(rl) > 0 THEN 'relay: ' || array_to_string(rl, ';') ELSE 'no relay class' END AS reason FROM n) SELECT p_partkey, reason NOT IN ('external target is no intermediate', 'no relay class') AS eligible, reason FROM r",
)
def eligibility(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_type") == "PROMO", "external_target").when(F.col("p_type") == "LARGE", "second_messenger").otherwise("protein")
    return U.intermediate_eligibility(t.part, labels(F.col("p_name"), " "), ["ring", "bolt", "small"], [0, 7], kind, "p_partkey")


@query(
    "colocalization_triage",
    f"WITH {PROFILE}, {EDGE}, j AS (SELECT ep.node_a, ep.node_b, posterior, round(cosine, 9) - 0.7 AS sim, a.s_nationkey IS NOT NULL AND a.s_acctbal > 0 AND b.s_acctbal > 0 AS cov, CASE WHEN a.s_nationkey = b.s_nationkey THEN 1.0 ELSE 0.0 END AS os "
    "FROM ep LEFT JOIN prod USING (node_a, node_b) JOIN supplier a ON a.s_suppkey = ep.node_a JOIN supplier b ON b.s_suppkey = ep.node_b), "
    "k AS (SELECT *, round(posterior, 9) > 0.75 AS supported, coalesce((cov AND sim > 1e-12) OR os > 1e-12, false) AS shared, coalesce((cov AND sim <= 1e-12) OR os <= 1e-12, false) AS dis FROM j) "
    "SELECT node_a, node_b, supported, shared, NOT supported AND NOT shared AND dis AS exclude, NOT (NOT supported AND NOT shared AND dis) AS retain FROM k",
)
def triage(t: Tables) -> DataFrame:
    from evigraph.operators.evidence import integrate

    edges = integrate(edge_ledger(t), ["node_a", "node_b"]).select("node_a", "node_b", "posterior")
    edges = P.given_products(edges, profiles(t), "s", "d", "w").select("node_a", "node_b", "posterior", (F.round("cosine", 9) - 0.7).alias("sim"))
    s = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    a = s.toDF("node_a", "na", "ba")
    b = s.toDF("node_b", "nb", "bb")
    rows = edges.join(a, "node_a").join(b, "node_b")
    same = F.when(F.col("na") == F.col("nb"), 1.0).otherwise(0.0)
    covered = (F.col("ba") > 0) & (F.col("bb") > 0)
    out = U.triage(rows, covered, F.col("sim"), F.lit(True), same, F.round("posterior", 9) - 0.25)
    return out.select("node_a", "node_b", "supported", "shared", "exclude", "retain")


@query("sequential_reconciliation", f"WITH {EDGE}, s AS (SELECT node_a, node_b, 1 / (1 + exp(-sum(ln(bf)))) AS p FROM cat GROUP BY 1, 2) SELECT node_a, node_b, round(p, 6) AS repeated, round(p, 6) AS summed, true AS agrees FROM s")
def reconciliation(t: Tables) -> DataFrame:
    rows = U.reconcile(edge_ledger(t).withColumn("o", F.when(F.col("stream") == "co", 1).otherwise(2)), ["node_a", "node_b"], "o")
    return rounded(rows.select("node_a", "node_b", "repeated", "summed", (F.col("difference") < 1e-12).alias("agrees")))


@query("masked_correlation", f"WITH {PROFILE}, {CO} SELECT count(*) AS n, round(corr(cosine, n), 6) AS r FROM prod JOIN co USING (node_a, node_b) WHERE n > 3")
def masked(t: Tables) -> DataFrame:
    # a pair that shares few orders is masked before its cosine is worked out
    rows = P.given_products(co_supply(t).where("n > 3").withColumn("n", F.col("n").cast("double")), profiles(t), "s", "d", "w")
    return rounded(U.masked_correlation(rows, "cosine", "n"))


@query(
    "ortholog_pair_product",
    f"WITH {NGRAPH}, m AS (SELECT n_nationkey AS name, s_suppkey AS target FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 8000) "
    "SELECT DISTINCT least(x.target, y.target) AS node_a, greatest(x.target, y.target) AS node_b FROM ne JOIN m x ON x.name = node_a JOIN m y ON y.name = node_b WHERE p > 0.5 AND x.target <> y.target",
)
def orthologs(t: Tables) -> DataFrame:
    mapping = t.supplier.where("s_acctbal > 8000").select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("target"))
    pairs = nation_edges(t).where("p > 0.5").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return U.ortholog_pairs(pairs, mapping)


LEG = "lg AS (SELECT l_suppkey AS node_a, (l_partkey // 2)::BIGINT AS node_b, l_orderkey * 10 + l_linenumber AS ranking, l_discount * 12 AS score FROM lineitem)"


@query(
    "legacy_score_import",
    f"WITH {LEG}, r AS (SELECT *, CASE WHEN node_b NOT IN (SELECT s_suppkey FROM supplier) THEN 'unknown node' WHEN node_a = node_b THEN 'self pair' WHEN score > 1 THEN 'bad score' ELSE 'accepted' END AS reason FROM lg), "
    "n AS (SELECT reason, row_number() OVER (PARTITION BY least(node_a, node_b), greatest(node_a, node_b), reason ORDER BY ranking DESC, score DESC) AS rn FROM r) "
    "SELECT CASE WHEN reason = 'accepted' AND rn > 1 THEN 'duplicate' ELSE reason END AS reason, count(*) AS n FROM n GROUP BY 1",
)
def legacy_import(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("node_a"), F.floor(F.col("l_partkey") / 2).cast("long").alias("node_b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ranking"), (F.col("l_discount") * 12).alias("score"))
    out = U.import_scores(rows, t.supplier.select(F.col("s_suppkey").alias("node")))
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("external_target_vector", f"WITH {NGRAPH}, v AS (SELECT CASE WHEN node_a = 7 THEN node_b ELSE node_a END AS node, p FROM ne WHERE node_a = 7 OR node_b = 7) SELECT node, round(p, 6) AS p, rank() OVER (ORDER BY p DESC) AS rank FROM v")
def target_vector(t: Tables) -> DataFrame:
    rows = U.incident_pairs(nation_edges(t), 7)
    return rounded(rows.select("node", "p", F.rank().over(Window.orderBy(F.desc("p"))).cast("long").alias("rank")))  # a node's neighbours


@query(
    "path_invariants",
    f"{PATHS}, br AS (SELECT rank, CASE rank WHEN 2 THEN list_reverse(nodes) WHEN 3 THEN list_append(nodes, nodes[2]) WHEN 5 THEN list_concat(nodes, [21, 22, 23, 24]::INT[]) ELSE nodes END AS nodes, cost + CASE rank WHEN 1 THEN 0.5 ELSE 0 END AS cost FROM top), "
    "va AS (SELECT 'sound' AS variant, rank, nodes, cost FROM top UNION ALL SELECT 'broken', rank, nodes, cost FROM br UNION ALL SELECT 'broken', 11, nodes, cost FROM br WHERE rank = 10), st AS (SELECT variant, rank, nodes, unnest(range(1, len(nodes))) AS i FROM va), "
    "pr AS (SELECT variant, rank, sum(-ln(p)) AS s, count(*) FILTER (WHERE p IS NULL) AS missing FROM st LEFT JOIN de ON src = nodes[i] AND dst = nodes[i + 1] GROUP BY 1, 2), "
    "lg AS (SELECT va.*, s, missing, lag(va.cost) OVER (PARTITION BY variant ORDER BY rank) AS before FROM va JOIN pr USING (variant, rank)) "
    "SELECT variant, count(*) FILTER (WHERE nodes[1] <> 0) AS bad_start, count(*) FILTER (WHERE nodes[-1] <> 7) AS bad_target, count(*) FILTER (WHERE len(list_distinct(nodes)) <> len(nodes)) AS loops, count(*) FILTER (WHERE len(nodes) > 5) AS too_long, "
    "count(*) FILTER (WHERE before > cost + 1e-12) AS out_of_order, count(*) FILTER (WHERE abs(s - cost) > 1e-9) AS wrong_cost, sum(missing)::BIGINT AS missing_edges, count(*) - count(DISTINCT nodes) AS repeated FROM lg GROUP BY 1",
)
def invariants(t: Tables) -> DataFrame:
    """Of the paths found, and of the same paths with faults put in: a cost too high, one turned round, a loop, a tail too long, one twice."""
    paths, edges = ranked_paths(t)
    paths = cut(paths.select("rank", "nodes", "cost"), "paths")
    rank, nodes = F.col("rank"), F.col("nodes")
    tail = F.array(*[F.lit(n) for n in (21, 22, 23, 24)])
    wrong = F.when(rank == 2, F.reverse("nodes")).when(rank == 3, F.concat("nodes", F.array(nodes[1]))).when(rank == 5, F.concat("nodes", tail)).otherwise(nodes)
    broken = paths.select("rank", wrong.alias("nodes"), (F.col("cost") + F.when(rank == 1, 0.5).otherwise(0.0)).alias("cost"))
    broken = broken.unionByName(broken.where("rank = 10").withColumn("rank", F.lit(11).cast("long")))
    both = [U.path_invariants(p, edges, 0, 7, 4).withColumn("variant", F.lit(name)) for name, p in (("sound", paths), ("broken", broken))]
    return both[0].unionByName(both[1])


@query(
    "restricted_edge_count",
    f"WITH {RESOLVED}, ok AS (SELECT n_nationkey AS n FROM nation WHERE n_regionkey < 3) SELECT count(*) AS directed, count(DISTINCT (least(src, dst), greatest(src, dst))) AS undirected FROM de WHERE src IN (SELECT n FROM ok) AND dst IN (SELECT n FROM ok)",
)
def restricted_edges(t: Tables) -> DataFrame:
    ok = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("n"))
    rows = graph_edges(t).join(ok.withColumnRenamed("n", "src"), "src", "left_semi").join(ok.withColumnRenamed("n", "dst"), "dst", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("directed"), F.count_distinct(F.least("src", "dst"), F.greatest("src", "dst")).alias("undirected"))


@query(
    "live_frontier_merge",
    f"WITH {CO}, f AS (SELECT node_a, node_b, (0.5 + 0.5 * (1 - exp(-0.5 * power(n / 6.0, 2)))) / 0.5 AS i, CASE WHEN n >= 4 THEN least(greatest((s / (1 - s)) / (0.6 / 0.4), 0.1), 10) END AS c, n FROM (SELECT *, least(greatest(n / 12.0, 1e-6), 1 - 1e-6) AS s FROM co)), "
    "g AS (SELECT node_a, node_b, CASE WHEN n >= 12 THEN i END AS i, c, CASE WHEN n >= 2 THEN 0.8 END AS l FROM f) SELECT node_a, node_b, round(coalesce(i, c, l), 6) AS factor, CASE WHEN i IS NOT NULL THEN 'integrated' WHEN c IS NOT NULL THEN 'cached' WHEN l IS NOT NULL THEN 'live' ELSE 'none' END AS origin, "
    "CASE WHEN coalesce(i, c, l) > 1 THEN 'supports' WHEN coalesce(i, c, l) < 1 THEN 'refutes' ELSE 'neutral' END AS effect FROM g",
)
def live_merge(t: Tables) -> DataFrame:
    co = P.sized(cut(co_supply(t), "co"), "node_a", "node_b")
    factor = lambda rows, f: rows.select("node_a", "node_b", f.alias("bayes_factor"))
    integrated = factor(co.where("n >= 12"), K.zero_anchored_factor(F.col("n")))
    cached = factor(co.where("n >= 4"), K.structural_factor(F.col("n") / 12.0, 0.6, 0.1, 10.0))
    return rounded(U.live_scores(co.select("node_a", "node_b"), integrated, cached, factor(co.where("n >= 2"), F.lit(0.8)), ["node_a", "node_b"]))


@query(
    "node_sequence_choice",
    "WITH pr AS (SELECT p_partkey AS acc, split_part(p_name, ' ', 1) AS gene, p_type || p_brand AS seq, p_size > 25 AS reviewed FROM part), nd AS (SELECT n_name AS node, CASE WHEN n_regionkey = 1 THEN n_nationkey END AS acc FROM nation UNION ALL SELECT 'RED', NULL UNION ALL SELECT 'blue', NULL), "
    "c AS (SELECT node, pr.acc, seq, reviewed, 0 AS step FROM nd JOIN pr ON pr.acc = nd.acc UNION ALL SELECT node, pr.acc, seq, reviewed, 1 FROM nd JOIN pr ON upper(gene) = upper(node)), "
    "b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY node ORDER BY step, reviewed DESC, length(seq) DESC, acc) = 1) SELECT nd.node, b.acc AS accession, seq AS sequence, CASE step WHEN 0 THEN 'accession' WHEN 1 THEN 'gene' ELSE 'missing' END AS basis FROM nd LEFT JOIN b ON b.node = nd.node",
)
def sequence_choice(t: Tables) -> DataFrame:
    proteins = t.part.select(F.col("p_partkey").alias("accession"), F.split("p_name", " ")[0].alias("gene"), F.concat("p_type", "p_brand").alias("sequence"), (F.col("p_size") > 25).alias("reviewed"))
    nodes = t.nation.select(F.col("n_name").alias("node"), F.when(F.col("n_regionkey") == 1, F.col("n_nationkey").cast("long")).alias("accession"))
    nodes = nodes.unionByName(t.spark.createDataFrame([("RED", None), ("blue", None)], "node string, accession long"))
    return U.node_sequences(nodes, proteins)


