"""Kernels, operators and readers: closed forms, brute force, round trips."""

import itertools
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.functions import kernels as K
from evigraph.functions import keys as Y
from evigraph.functions.special import erfc, t_pvalue, t_two_sided
from evigraph.operators import calibration as C
from evigraph.operators import evidence as E
from evigraph.operators import graph as G
from evigraph.operators import mapping as M
from evigraph.operators import pairs as P
from evigraph.operators import stats as S
from evigraph.operators import temporal as T
from evigraph.sources import html as H
from evigraph.sources import readers as R
from evigraph.sources.state import StateStore


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_row_thresholds(spark):
    rows = spark.createDataFrame([("A", 1.0, 2.0), ("B", 2.0, 1.0), ("C", None, 5.0)], "k string, x double, t double")
    got = {r["k"]: r["f"] for r in rows.select("k", K.floored_factor(F.col("x"), F.col("t"), 0.0).alias("f")).collect()}
    assert got["A"] == pytest.approx(1 - math.exp(-0.125)) and got["B"] == pytest.approx(1 - math.exp(-2)) and got["C"] == 0.0
    with pytest.raises(Exception, match="positive finite thresholds"):
        rows.select(K.floored_factor(F.lit(1.0), F.lit(0.0)).alias("f")).collect()


def test_background_comes_before_the_universe(spark):
    values = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0), ("D", 100.0)], "k string, x double")
    universe = spark.createDataFrame([("A",), ("C",)], "k string")
    got = E.signaling_factors(values, universe, "k", "x", q=0.5).collect()
    assert {r["k"] for r in got} == {"A", "C"} and {r["tq"] for r in got} == {2.5} and {r["background"] for r in got} == {4}


def test_missing_values_are_neutral_or_least(spark):
    nan = F.lit(float("nan"))
    assert value(spark, K.floored_likelihood(nan, F.lit(1.0))) == 0.5
    assert value(spark, K.floored_likelihood(F.lit(1.0), F.lit(-1.0))) == 0.5
    assert value(spark, K.continuous_factor(F.lit(-3.0), F.lit(1.0))) == 1e-6
    assert value(spark, K.pair_likelihood(nan, F.lit(1.0), continuous=True)) == 0.5
    assert value(spark, K.floored_likelihood(F.lit(-9.0), F.lit(1.0), clamp=False)) > 0.99
    assert value(spark, K.zero_anchored_factor(F.lit(0.0))) == 1.0


def test_updates(spark):
    priors = spark.createDataFrame([("A", 1 / 3), ("B", 1 / 3), ("C", 1 / 3)], "k string, prior double")
    got = {r["k"]: r["posterior"] for r in E.categorical_update(priors, spark.createDataFrame([("B", 1.0)], "k string, factor double"), "k").collect()}
    assert got == pytest.approx({"A": 0.25, "B": 0.5, "C": 0.25})
    assert value(spark, K.binary_update(F.lit(0.5), F.lit(2.0))) == pytest.approx(2 / 3)
    assert value(spark, K.likelihood_update(F.lit(0.2), F.lit(1.0))) == pytest.approx(1 / 3)
    assert value(spark, K.apply_factor(F.lit(0.3), F.lit(1.0))) == 0.3
    assert value(spark, K.apply_factor(F.lit(0.5), F.lit(4.0))) == pytest.approx(0.8)
    assert value(spark, K.structural_factor(F.lit(0.999), 0.6, 0.1, 10.0)) == 10.0
    assert value(spark, K.expit(F.lit(-1e9))) >= 0.0
    with pytest.raises(ValueError):
        K.odds_factor(F.lit(0.5), 1.0)


def test_sequential_updates_are_the_product(spark):
    ledger = spark.createDataFrame([("x", i, f, w) for i, (f, w) in enumerate([(2.0, 1.0), (0.5, 0.5), (1.7, 1.0)])], "k string, o int, factor double, weight double")
    last = E.running_posterior(ledger, ["k"], "o").orderBy("o").collect()[-1]["after"]
    assert last == pytest.approx(E.integrate(ledger, ["k"]).first()["posterior"], abs=1e-12)


def test_pairs_are_canonical(spark):
    rows = spark.createDataFrame([("b", "A"), (" A", "b"), ("x", "x"), ("", "y"), ("aB", "Ab")], "a string, b string")
    assert sorted((r["a"], r["b"]) for r in Y.canonical_pairs(rows, "a", "b").collect()) == [("A", "b"), ("A", "b"), ("Ab", "aB")]
    flags = spark.createDataFrame([(" TRUE",), ("1",), ("1.0",), (None,), ("Yes",)], "t string").select(Y.truthy(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in flags] == [True, True, False, False, True]


def test_thresholds_fall_back_to_positive_values(spark):
    pairs = spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.0), (2, 3, 0.0), (1, 4, 0.8), (2, 4, 0.0), (3, 4, 0.0)], "node_a int, node_b int, v double")
    got = {r["node"]: r["tq"] for r in P.node_thresholds(pairs, "v").collect()}
    assert got[1] == pytest.approx(0.4) and got[2] is None


def test_closure_needs_two_partners(spark):
    anchors = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "c"), ("s3", "b"), ("s3", "a")], "h string, n string")
    (r,) = P.shared_anchor_closure(anchors, "h", "n").collect()
    assert (r["node_a"], r["node_b"], r["hubs"], r["supporting"]) == ("a", "b", "s1;s3", 2)


def test_incremental_pairs(spark):
    nodes = spark.createDataFrame([(i, i >= 8) for i in range(10)], "n int, new boolean")
    got = {(r["node_a"], r["node_b"]) for r in P.incremental_pairs(nodes, "n", F.col("new")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(10), 2) if b >= 8}


EDGES = {("A", "T"): 0.60, ("A", "B"): 0.90, ("B", "T"): 0.90, ("A", "C"): 0.80, ("C", "T"): 0.95, ("A", "D"): 0.99, ("D", "B"): 0.99, ("B", "C"): 0.70, ("C", "D"): 0.65}


def brute_paths(edges, start, target, hops):
    both = {}
    for (a, b), p in edges.items():
        both.setdefault(a, {})[b] = p
        both.setdefault(b, {})[a] = p
    out = []

    def walk(path, cost):
        if path[-1] == target:
            out.append((cost, path))
        elif len(path) <= hops:
            for n, p in both.get(path[-1], {}).items():
                if n not in path:
                    walk([*path, n], cost - math.log(p))

    walk([start], 0.0)
    return sorted(out)


def test_top_paths_equal_enumeration(spark):
    rows = [(a, b, p) for (a, b), p in EDGES.items()] + [(b, a, p) for (a, b), p in EDGES.items()]
    edges = G.costs(spark.createDataFrame(rows, "src string, dst string, p double"), 0.0)
    want = brute_paths(EDGES, "A", "T", 4)
    for k in (6, 100, 5):
        got = [(r["cost"], list(r["nodes"])) for r in G.top_paths(edges, "A", "T", k, 4).orderBy("cost", "nodes").collect()]
        assert [n for _, n in got] == [n for _, n in want[:k]]
    strict = G.costs(spark.createDataFrame(rows, "src string, dst string, p double"), 0.9)
    assert {tuple(sorted((r["src"], r["dst"]))) for r in strict.collect()} == {("A", "D"), ("C", "T"), ("B", "D")}


def test_random_graphs_top_paths(spark):
    rng = random.Random(5)
    edges = {(a, b): rng.uniform(0.3, 0.99) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.6}
    rows = [(a, b, p) for (a, b), p in edges.items()] + [(b, a, p) for (a, b), p in edges.items()]
    got = G.top_paths(G.costs(spark.createDataFrame(rows, "src int, dst int, p double"), 0.0), 0, 6, 8, 4).orderBy("cost", "nodes").collect()
    assert [list(r["nodes"]) for r in got] == [n for _, n in brute_paths(edges, 0, 6, 4)[:8]]


def test_directions_prefer_rules(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (2, 3, 0.9), (3, 4, 0.9)], "node_a int, node_b int, p double")
    classes = spark.createDataFrame([(1, "ligand"), (2, "receptor"), (3, "kinase")], "node int, class string")
    records = spark.createDataFrame([(2, 1), (3, 1), (3, 4), (4, 3)], "source int, target int")
    got = {(r["node_a"], r["node_b"]): (r["a_to_b"], r["b_to_a"], r["basis"]) for r in G.resolve_directions(edges, G.rule_support(edges, classes, G.rule_table(spark)), G.record_support(records)).collect()}
    assert got == {(1, 2): (True, False, "rule"), (1, 3): (False, True, "record"), (2, 3): (True, True, "none"), (3, 4): (True, True, "conflict")}
    assert G.directed_edges(G.resolve_directions(edges, G.rule_support(edges, classes, G.rule_table(spark)), G.record_support(records))).count() == 6


def test_backward_search_stops_at_the_receptor(spark):
    rows = [("A", "END", 9.0), ("B", "END", 4.0), ("C", "END", 0.5), ("REC", "B", 9.0), ("S", "A", 0.4)]
    edges = spark.createDataFrame(rows, "src string, dst string, bf double").select("src", "dst", F.ln("bf").alias("log_bf"))
    receptor = spark.createDataFrame([("REC",)], "node string")
    found, why = G.backward_search(edges, "END", receptor, top_n=2, width=2, depth=4)
    assert why == "receptor_reached" and [list(r["nodes"]) for r in found.collect()] == [["END", "B", "REC"]]
    found, why = G.backward_search(edges.where("src != 'REC'"), "END", receptor, top_n=2, width=2, depth=4)
    assert why == "frontier_exhausted" and found.count() == 0


def test_reachability_and_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src int, dst int")
    assert {(r["node"], r["hops"]) for r in G.reachable(edges, 1).collect()} == {(1, 0), (2, 1), (3, 2)}
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "child string, parent string")
    assert {(r["node"], r["ancestor"], r["distance"]) for r in G.closure(dag).collect()} == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)}


def test_t_pvalues(spark):
    assert t_two_sided([0, 2, 3], [6, 6, 10]) == pytest.approx([1, 0.0924263115, 0.0133436550], abs=1e-9)
    rows = spark.createDataFrame([(2.0, 6.0), (None, 6.0)], "t double, d double").select(t_pvalue("t", "d").alias("p"), erfc("t").alias("e")).collect()
    assert rows[0]["p"] == pytest.approx(0.0924263115, abs=1e-9) and rows[1]["p"] is None
    assert rows[0]["e"] == pytest.approx(math.erfc(2.0)) and rows[1]["e"] is None


def test_corrections_count_all_tests(spark):
    rows = []
    for site, values in (("s1", {1: [0.8, 1.0, 1.2], 5: [1.8, 2.0, 2.2]}), ("s2", {1: [0.1, 0.2, 0.3], 5: [0.2, 0.3, 0.4]})):
        rows += [("g", site, minute, v, 1e5) for minute, vs in values.items() for v in vs]
    points = T.timepoints(spark.createDataFrame(rows, "gene string, site string, minute int, log2_ratio double, intensity double"), ["gene", "site"])
    points = T.moderated_t(points.withColumn("prior_variance", F.lit(0.04)))
    r = T.gene_responses(points, "gene", "site").first()
    assert r["tests"] == 4 and r["best_site"] == "s1" and r["p"] == pytest.approx(min(1, 4 * r["p_raw"]))
    assert r["center_of_mass"] == pytest.approx((1 * 1 + 5 * 2) / 3)


def test_path_order_of_degenerate_draws(spark):
    draws = spark.createDataFrame([(g, d, float(v)) for g, v in (("A", 1), ("B", 5)) for d in range(10)], "node string, draw int, response double")
    paths = spark.createDataFrame([("B -> A", 0, "B"), ("B -> A", 1, "A"), ("A -> B", 0, "A"), ("A -> B", 1, "B")], "path string, pos int, node string")
    got = {r["path"]: (r["soft_precedence"], r["tau_mean"]) for r in T.path_order(paths, draws, "node").collect()}
    assert got == {"A -> B": (1.0, 1.0), "B -> A": (0.0, -1.0)}


def test_draws_depend_on_gene_and_seed(spark):
    points = spark.createDataFrame([("a", 1, 1.0, 0.1), ("a", 5, 2.0, 0.1), ("b", 1, 1.0, 0.1)], "g string, minute int, mean double, se double")
    one = {(r["g"], r["draw"]): r["response"] for r in T.response_draws(points, "g", draws=5).collect()}
    two = {(r["g"], r["draw"]): r["response"] for r in T.response_draws(points.where("g = 'a'").repartition(3), "g", draws=5).collect()}
    assert all(one[k] == v for k, v in two.items()) and len(one) == 10


def test_adjusted_p_and_signed_ranks(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "k int, p double")
    got = [r["p_adjusted"] for r in S.adjust_p(rows, [], "p", "k").orderBy("k").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    x = [1.0, -2.0, 2.0, 3.0, 0.0, 5.0]
    r = S.signed_rank(spark.createDataFrame([(1, v) for v in x], "g int, x double"), ["g"], "x").first()
    assert r["n"] == 5 and r["w_plus"] == pytest.approx(1 + 2.5 + 4 + 5)
    assert r["z"] == pytest.approx((12.5 - 7.5) / math.sqrt(5 * 6 * 11 / 24 - (8 - 2) / 48))


def test_spearman_needs_three_rows(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 3.0, 1.0), ("c", 1.0, 3.0), ("c", 2.0, 2.0), ("c", 3.0, 1.0)], "g string, x double, y double")
    assert {r["g"]: r["spearman"] for r in S.spearman(rows, ["g"], "x", "y").collect()} == {"a": None, "b": None, "c": pytest.approx(-1.0)}


def test_cascades_keep_order_and_ambiguity(spark):
    rows = spark.createDataFrame([("1", "n1", "m1"), ("2", "zz", "m2"), ("3", "n3", "m1"), ("4", None, None)], "k string, a string, b string")
    first = spark.createDataFrame([("n1", "T1"), ("n3", "T3"), ("n3", "T4")], "n string, t string")
    second = spark.createDataFrame([("m1", "U1"), ("m2", "U2")], "n string, t string")
    got = {r["k"]: (r["step"], r["mapped"], r["ambiguous"]) for r in M.cascade(rows, "k", [(F.col("a"), first), (F.col("b"), second)]).collect()}
    assert got == {"1": (0, "T1", False), "2": (1, "U2", False), "3": (0, None, True), "4": (None, None, False)}


def test_calibration_improves_inside_bounds():
    log8 = math.log(8)
    parameters = [C.Parameter("weight", 0.2, 1.0, 0.0, 3.0, 0.5), C.Parameter("tq", 1.0, 1.0, 0.25, 4.0, math.log(2), log=True)]
    p = lambda th: np.full(2, 1 / (1 + math.exp(-th["weight"] * log8 / th["tq"])))
    one, two = C.calibrate(parameters, p), C.calibrate(parameters, p)
    assert one == two and one["improved"] and one["loss"] < one["start_loss"]
    assert 0 <= one["values"]["weight"] <= 3 and 0.25 <= one["values"]["tq"] <= 4


def test_calibration_uses_all_controls(spark, tmp_path):
    from evigraph.plans import CATALOG_QUERIES

    rows = [(k, float(1 + k * 7 % 40)) for k in range(3000)]
    spark.createDataFrame(rows, "l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 50 if k % 2 else 1) for k in range(3000)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    tq = E.background_threshold(spark.createDataFrame(rows, "symbol long, x double"), "x").first()["tq"]
    x = np.array([x for k, x in rows if k % 2])

    def p(theta):
        factor = np.maximum(0.5, 1 - np.exp(-0.5 * (x / (tq * theta["tq"])) ** 2)) / 0.5
        return 1 / (1 + np.exp(-theta["weight"] * np.log(factor)))

    want = C.calibrate([C.Parameter("weight", 0.2, 1.0, 0.0, 3.0, 0.5), C.Parameter("tq", 1.0, 1.0, 0.25, 4.0, math.log(2), log=True)], p)
    got = CATALOG_QUERIES["calibrate_positive_controls"](spark, str(tmp_path)).first()
    assert (got["start_loss"], got["loss"]) == pytest.approx((want["start_loss"], want["loss"]), abs=2e-6)
    assert (got["weight"], got["tq"]) == pytest.approx((want["values"]["weight"], want["values"]["tq"]), abs=1e-4)


def test_controls_that_nearly_agree_count_as_one(spark):
    values = [1.0, 1.00001, -1.0, 0.0, 0.0, 2.0, None, float("nan"), float("inf")] + [5 + i * 1e-9 for i in range(1000)]
    x, n = C.summed_up(spark.createDataFrame([(v,) for v in values], "v double"), F.col("v"))
    assert n.sum() == 1006 and len(x) <= 7 and (np.diff(x) > 0).all() and x[0] == -1.0 and n[list(x).index(0.0)] == 2
    assert math.isclose((x * n).sum(), sum(v for v in values if v is not None and math.isfinite(v)), rel_tol=1e-12)


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("sym\tx\tA\nA\t\t0.5\nB\t2\t0\n")
    rows = R.read_delimited(spark, str(tmp_path / "a.tsv")).collect()
    assert rows[0]["x"] == "" and rows[1]["x"] == "2"
    (tmp_path / "s.fasta").write_text(">sp|P1|X one\nMK\nLL\n>P2 two\nAA\n")
    assert {(r["accession"], r["sequence"]) for r in R.read_fasta(spark, str(tmp_path / "s.fasta")).collect()} == {("P1", "MKLL"), ("P2", "AA")}
    (tmp_path / "o.obo").write_text("format: 1\n\n[Term]\nid: G:1\nname: one\n\n[Term]\nid: G:2\nname: two\nis_a: G:1 ! one\nrelationship: part_of G:3 ! x\nis_obsolete: true\n\n[Typedef]\nid: part_of\n")
    terms, edges = R.read_obo(spark, str(tmp_path / "o.obo"))
    assert {(r["id"], r["obsolete"]) for r in terms.collect()} == {("G:1", False), ("G:2", True)}
    assert {tuple(r) for r in edges.collect()} == {("G:2", "G:1", "is_a"), ("G:2", "G:3", "part_of")}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/data.tsv", "a\tb\n1\t2\n")
        z.writestr("in/other.txt", "no")
    assert [r["line"] for r in R.read_zip_member(spark, str(tmp_path / "z.zip"), ".tsv").orderBy("line_no").collect()] == ["a\tb", "1\t2"]
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th><td>b <b>c</b></td></tr><tr><td>1</td></tr></table>")], "page_id long, html string")
    assert [list(r["cells"]) for r in H.rows(H.cells(pages, "page_id"), "page_id").orderBy("row").collect()] == [["a", "b c"], ["1"]]
    (tmp_path / "m.tsv").write_text("x\tA\tB\nA\t0\t0.5\nB\t0.5\t0\nC\t1\t1\n")
    known = spark.createDataFrame([("A",), ("B",)], "symbol string")
    assert {tuple(r) for r in R.read_matrix(spark, str(tmp_path / "m.tsv"), known).collect()} == {("A", "B", 0.5), ("B", "A", 0.5)}
    R.write_delimited(spark.createDataFrame([("A", 1 / 3)], "k string, v double"), str(tmp_path / "out"))
    assert R.read_delimited(spark, str(tmp_path / "out")).first()["v"] == "0.333333333"


def test_state_versions_and_stream(spark, tmp_path):
    from evigraph.streaming import scores

    store = StateStore(spark, f"file://{tmp_path}/state")
    assert store.read("cache") is None
    folder = str(tmp_path / "in")
    spark.createDataFrame([("b", "a", "iptm", 0.4, 1), ("a", "c", "iptm", 1.4, 1)], scores.SCHEMA).write.parquet(folder)
    for extra in (None, [("a", "b", "iptm", 0.9, 2), ("c", "a", "iptm", 0.1, 1)]):
        if extra:
            spark.createDataFrame(extra, scores.SCHEMA).write.mode("append").parquet(folder)
        q = scores.keep_cache(scores.score_stream(spark, folder), store, "cache", str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert {(r["node_a"], r["node_b"], r["score"]) for r in store.read("cache").collect()} == {("a", "b", 0.9), ("a", "c", 0.1)}
    assert store.version("cache") == 2


def test_event_windows(spark, tmp_path):
    from evigraph.streaming import scores

    spark.createDataFrame([(1, "2024-01-01 00:10:00", "x", 1.0), (2, "2024-01-01 00:50:00", "x", 2.0), (3, "2024-01-01 01:10:00", "x", 4.0)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "ev"))
    q = scores.event_counts(spark, str(tmp_path / "ev"), "event_id long, ts timestamp, event_type string, value double").writeStream.format("memory").queryName("ev_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["n"], r["total"]) for r in spark.table("ev_counts").collect()) == [(1, 4.0), (2, 3.0)]


def test_entry_module_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
