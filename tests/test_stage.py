"""Edge stage, records, settings, feeds, the six search stages, quantiles and the path search."""

import itertools
import json
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evigraph.operators import development as D
from evigraph.operators import edge_stage as S
from evigraph.operators import graph as G
from evigraph.operators import pairs as P
from evigraph.operators import records as R
from evigraph.operators import settings as C
from evigraph.operators.order import quantiles
from evigraph.sources import feeds
from evigraph.sources.state import StateStore, cut


def pairs_of(spark, rows, name="bayes_factor"):
    return spark.createDataFrame(rows, f"node_a string, node_b string, {name} double")


def test_negative_evidence_counts_once_and_in_scope_only(spark):
    """The pair out of scope stays at the prior; the supported one rises; the unsupported one falls by one penalty, or to the floor."""
    nodes = spark.createDataFrame([("Prkar2a", False, False), ("Actn1", False, True), ("SM_CAMP", True, False)], "node string, messenger boolean, mapped boolean")
    factors = pairs_of(spark, [("Prkar2a", "SM_CAMP", 3.0)])
    eligible = S.eligible_pairs(nodes, F.col("messenger"), F.col("mapped"))
    got = lambda s, penalty: {(r["node_a"], r["node_b"]): r["probability"] for r in S.combine(S.contributions([(s, factors, eligible)], penalty), 0.5).collect()}
    fixed = got(S.EdgeStream("stitch", "floored_odds"), 0.5)
    assert ("Actn1", "Prkar2a") not in fixed and fixed["Prkar2a", "SM_CAMP"] > 0.5 and math.isclose(fixed["Actn1", "SM_CAMP"], 1 / 3)
    floor = got(S.EdgeStream("stitch", "floored_odds", continuous=True, floor=1e-5), None)
    assert math.isclose(floor["Actn1", "SM_CAMP"], 1e-5 / (1 + 1e-5))
    assert ("Actn1", "SM_CAMP") not in got(S.EdgeStream("stitch", "floored_odds"), None)
    with pytest.raises(Exception, match="not positive"):
        S.contributions([(S.EdgeStream("x", "odds"), pairs_of(spark, [("a", "b", 0.0)]), None)]).collect()


def test_duplicate_rows_add_up_and_neutral_rows_are_observations(spark):
    eligible = pairs_of(spark, [("a", "b", 1.0), ("a", "c", 1.0)]).select("node_a", "node_b")
    parts = S.contributions([(S.EdgeStream("s", "odds", weight=2.0), pairs_of(spark, [("a", "b", 1.0), ("a", "b", 1.0), ("b", "c", 2.0), ("b", "c", 3.0)]), eligible)], 0.5)
    logs = {(r["node_a"], r["node_b"]): r["log_bf"] for r in parts.collect()}
    assert logs["a", "b"] == 0 and math.isclose(logs["a", "c"], 2 * math.log(0.5)) and math.isclose(logs["b", "c"], 2 * math.log(6))
    back = {(r["node_a"], r["node_b"]): r["bayes_factor"] for r in S.applied_factors(parts, [S.EdgeStream("s", "odds", weight=2.0)]).collect()}
    assert set(back) == {("a", "c"), ("b", "c")} and math.isclose(back["b", "c"], 6)


def test_combined_blocks_equal_combined_pairs(spark, monkeypatch):
    """Several blocks and slices; nodes without a flag, without any row, and reported ones that no table knows; pairs aren't shuffled."""
    rng = np.random.default_rng(6)
    names = [f"n{i}" for i in range(60)]
    nodes = spark.createDataFrame([(n, *(None if x > 2 else bool(x > 1) for x in rng.integers(0, 4, 3))) for n in names[:50]], "node string, p boolean, q boolean, r boolean")
    made = lambda: [(a, b, float(rng.choice([0.25, 1.0, 3.0]))) for a, b in (sorted(rng.choice(names, 2, replace=False).tolist()) for _ in range(150))]
    one, two, three = (pairs_of(spark, made()) for _ in range(3))
    streams = [S.EdgeStream("one", "odds", weight=2.0), S.EdgeStream("two", "odds", continuous=True, floor=1e-3), S.EdgeStream("three", "odds", negative=False), S.EdgeStream("off", "odds", weight=0.0)]
    ends = [(F.col("p"), None), (F.col("q"), F.col("r")), (F.col("p"), None), (F.col("p"), None)]
    monkeypatch.setattr(S, "BLOCK", 11)
    monkeypatch.setattr(S, "HELD", 30)
    for penalty in (0.8, None):
        plain = S.combine(S.contributions([(s, f, S.eligible_pairs(nodes, *e)) for s, f, e in zip(streams, (one, two, three, one), ends, strict=True)], penalty), 0.3)
        blocks = S.combine_eligible(nodes, [(s, f, *e) for s, f, e in zip(streams, (one, two, three, one), ends, strict=True)], 0.3, penalty)
        rows = lambda df: sorted((r["node_a"], r["node_b"], round(r["log_odds"], 9), round(r["probability"], 9), r["streams"]) for r in df.collect())
        assert rows(blocks) == rows(plain) and len(rows(plain)) > 300
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    with pytest.raises(ValueError, match="no stream"):
        S.combine_eligible(nodes, [(streams[3], one, None, None)], 0.3)


def test_thresholds_count_absent_pairs_as_zeros(spark):
    products = pairs_of(spark, [("a", "b", 4.0)], "dot")
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    plain = {r["node"]: r["tq"] for r in P.node_thresholds(products, "dot").collect()}
    whole = {r["node"]: r["tq"] for r in P.node_thresholds(products, "dot", positive_fallback=False, nodes=nodes).collect()}
    assert plain == {"a": 4.0, "b": 4.0}
    assert set(whole) == set("abcde") and whole["c"] is None and math.isclose(whole["a"] or 0, np.quantile([0, 0, 0, 4], 0.75))


def test_handlers_and_rescoring(spark):
    raw = spark.createDataFrame([("a", "b", 0.4, 1.0, 1.0), ("a", "c", 0.15, 1.0, 1.0), ("a", "d", None, 1.0, 1.0)], "node_a string, node_b string, x double, tq_a double, tq_b double")
    odds = S.EdgeStream("o", "odds", reference=0.15)
    assert {r["node_b"] for r in S.rescored(raw, odds).collect()} == {"b"}  # the reference itself is neutral, a missing score no row
    with pytest.raises(ValueError, match="no handler"):
        S.stream_factors(raw, S.EdgeStream("o", "nothing"))
    S.HANDLERS.pop("half", None)
    S.register("half", lambda s: F.lit(0.5))
    assert S.stream_factors(raw, S.EdgeStream("h", "half")).count() == 2
    with pytest.raises(ValueError, match="already"):
        S.register("half", lambda s: F.lit(0.5))


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    for n, many in itertools.product((0, 1, 2, 7, 3000), (1, 4)):
        values = [rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1)), None]) for _ in range(n)]
        row = quantiles(spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double").repartition(3), F.col("v"), [0.0, 0.25, 0.5, 0.75, 1.0] * many).first()
        known = [v for v in values if v is not None]
        assert row["n"] == len(known)
        want = np.quantile(known, [0, 0.25, 0.5, 0.75, 1]) if known else [None] * 5
        assert all((a is None and b is None) or math.isclose(a, b, abs_tol=1e-12) for a, b in zip(row["q"], want * many if known == [] else list(want) * many, strict=True))


def brute_paths(edges, start, target, hops, k):
    by = {}
    for a, b, c in edges:
        by.setdefault(a, []).append((b, c))
    out, stack = [], [([start], 0.0)]
    while stack:
        path, cost = stack.pop()
        if path[-1] == target:
            out.append((cost, path))
        elif len(path) <= hops:
            stack += [(path + [b], cost + c) for b, c in by.get(path[-1], ()) if b not in path]
    return sorted(out)[:k]


def test_path_search_equals_brute_force(spark):
    rng = random.Random(4)
    edges = [(a, b, rng.choice([0.1, 0.2, 0.35, rng.random()])) for a, b in itertools.permutations(range(9), 2) if rng.random() < 0.5]
    df = spark.createDataFrame(edges, "src long, dst long, cost double")
    for hops, k in ((4, 12), (5, 3), (1, 2), (6, 100_000)):
        want = brute_paths(edges, 0, 8, hops, k)
        got = [(r["cost"], list(r["nodes"])) for r in G.top_paths(df.unionAll(df.withColumn("cost", F.col("cost") + 1)), 0, 8, k, hops).orderBy("cost", "nodes").collect()]
        assert [round(c, 9) for c, _ in got] == [round(c, 9) for c, _ in want] and [p for _, p in got] == [p for _, p in want]
    want = brute_paths(edges, 0, 8, 4, 1)
    ban = spark.createDataFrame([(want[0][1][0], want[0][1][1])], "src long, dst long")
    left = [e for e in edges if (e[0], e[1]) != (want[0][1][0], want[0][1][1])]
    assert [list(r["nodes"]) for r in G.top_paths(df, 0, 8, 3, 4, bans=ban).orderBy("cost", "nodes").collect()] == [p for _, p in brute_paths(left, 0, 8, 4, 3)]
    between = spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "node long")
    inner = [e for e in edges if {e[0], e[1]} <= {0, 1, 2, 3, 4, 8}]
    assert [list(r["nodes"]) for r in G.top_paths(df, 0, 8, 5, 4, allowed=between).orderBy("cost", "nodes").collect()] == [p for _, p in brute_paths(inner, 0, 8, 4, 5)]
    assert G.top_paths(df, 0, 99, 3, 4).count() == 0 and G.top_paths(df.where("false"), 0, 8, 3, 4).count() == 0
    assert [tuple(r) for r in G.top_paths(df, 3, 3, 2, 4).collect()] == [([3], 0.0, 0)]


def test_fewer_paths_than_asked_for(spark):
    """Loops abound around the start, and there are two paths: the bound goes up until all edges between the ends are let through."""
    edges = [(0, 1, 0.01), (1, 2, 0.01), (2, 3, 0.01), (3, 1, 0.01), (2, 1, 0.01), (3, 9, 5.0), (1, 9, 7.0), (9, 0, 0.1), (5, 6, 0.1)]
    got = G.top_paths(spark.createDataFrame(edges, "src long, dst long, cost double"), 0, 9, 3, 6).orderBy("cost").collect()
    assert [list(r["nodes"]) for r in got] == [[0, 1, 2, 3, 9], [0, 1, 9]]


def test_paths_on_a_graph_of_892_nodes(spark):
    """As many nodes and edges as the published timing has: 4 s for 25 paths of at most 6 steps."""
    rng = np.random.default_rng(7)
    a, b = np.triu_indices(892, 1)
    pick = rng.choice(len(a), 169_414, replace=False)
    p = rng.uniform(0.5, 0.98, len(pick))
    src, dst, cost = np.concatenate([a[pick], b[pick]]), np.concatenate([b[pick], a[pick]]), np.tile(-np.log(p), 2)
    df = spark.createDataFrame(pd.DataFrame({"src": src, "dst": dst, "cost": cost})).repartition(4)
    df = cut(df, "graph")
    for k in (25, 100):
        t = time.time()
        found = G.top_paths(df, 0, 891, k, 6).orderBy("cost", "nodes").collect()
        print(f"{k} paths in {time.time() - t:.2f} s")
        assert len(found) == k and all(len(r["nodes"]) <= 7 and len(set(r["nodes"])) == len(r["nodes"]) for r in found)
    # all that cost no more than the last, by a search over the edges that can be on one
    of = {(x, y): c for x, y, c in zip(src.tolist(), dst.tolist(), cost.tolist(), strict=True)}
    near = {}
    for (x, y), c in of.items():
        near.setdefault(x, []).append((y, c))
    to_go = {891: 0.0}
    for _ in range(6):
        to_go = {**to_go, **{x: min(m, to_go.get(x, np.inf)) for x in near if (m := min((c + to_go[y] for y, c in near[x] if y in to_go), default=np.inf)) < np.inf}}
    last, out, stack = found[-1]["cost"], [], [([0], 0.0)]
    while stack:
        path, so_far = stack.pop()
        if path[-1] == 891:
            out.append((so_far, path))
        elif len(path) <= 6:
            stack += [(path + [y], so_far + c) for y, c in near[path[-1]] if y not in path and so_far + c + to_go.get(y, np.inf) <= last + 1e-12]
    assert [p for _, p in sorted(out)[:k]] == [list(r["nodes"]) for r in found]


def search_tables(spark):
    nodes = spark.createDataFrame([(n, n != "S") for n in ("END", "REC", "A", "B", "C", "S")], "node string, eligible boolean")
    cheap = [("A", "END", 9.0), ("B", "END", 4.0), ("C", "END", 0.5), ("END", "REC", 1.0), ("END", "S", 20.0), ("A", "B", 2.0)]
    evidence = pairs_of(spark, cheap).select("*", F.lit(1).alias("step"), F.lit("cheap").alias("stream"), F.lit(1.0).alias("weight"))
    cache = spark.createDataFrame([("A", "END", "p1", 0.55), ("B", "END", "p1", 0.90), ("END", "REC", "p2", 0.10), ("A", "END", "old", 0.99)], "node_a string, node_b string, protocol string, score double")
    return {
        "pairs": evidence.select("node_a", "node_b"), "nodes": nodes, "evidence": evidence, "cache": cache,
        "disallowed": spark.createDataFrame([("C", "END")], "source string, target string"), "receptors": spark.createDataFrame([("REC",)], "node string"),
    }


def test_six_stages_of_a_round(spark, tmp_path):
    tables = search_tables(spark)
    frontier = spark.createDataFrame([(0, ["END"])], "path_id int, nodes array<string>")
    run = D.Development(StateStore(spark, f"file://{tmp_path}/dev"), tables.__getitem__, top_n=2, width=1, protocols=["p1", "p2"])
    done = []
    while (stage := run.step(0, frontier)) is not None:
        done.append(stage)
        again = D.Development(StateStore(spark, f"file://{tmp_path}/dev"), tables.__getitem__, top_n=2, width=1, protocols=["p1", "p2"])
        assert again.done(0) == done  # a run goes on from the store
    assert done == list(D.STAGES)
    reasons = {r["candidate"]: r["reason"] for r in run.table(0, "candidates").collect()}
    assert reasons == {"A": None, "B": None, "C": "direction not allowed", "REC": None, "S": "not eligible"}
    kept = {r["candidate"]: (r["forced"], r["hit"], r["score"]) for r in run.table(0, "preparation").collect()}
    assert kept == {"A": (False, True, 0.55), "B": (False, True, 0.9), "REC": (True, True, 0.1)}
    decided = {r["candidate"]: r["decision"] for r in run.table(0, "decisions").collect()}
    assert decided["B"] == "in the beam" and decided["A"] == "below the beam" and decided["REC"] == "receptor reached"
    assert [list(r["nodes"]) for r in D.next_frontier(run.table(0, "decisions"), frontier).collect()] == [["END", "B"]]
    view = D.payload(run.table(0, "decisions")).first()
    assert view["n_edges"] == 3 and json.loads(view["payload"])["edges"][0]["node_a"] == "B"


def test_sensitivity_gates_again(spark):
    from evigraph.operators import temporal as T

    rng = random.Random(1)
    rows = [(f"g{g}", f"s{k}", m, rng.gauss(g / 4, 1), abs(rng.gauss(1, 0.2)), 3, 0.8) for g in range(6) for k in range(2) for m in (1, 5, 15)]
    points = spark.createDataFrame(rows, "gene string, site string, minute int, mean double, variance double, n int, prior_variance double")
    grid = T.sensitivity(points, "gene", "site", [2.0, 8.0], [0.01, 0.2])
    for prior, alpha in itertools.product((2.0, 8.0), (0.01, 0.2)):
        one = {(r["gene"], r["best_site"], round(r["p"], 9), r["passed"]) for r in T.gene_responses(T.moderated_t(points, prior), "gene", "site", alpha=alpha).collect()}
        cell = grid.where((F.col("prior_df") == prior) & (F.col("alpha") == alpha)).collect()
        assert {(r["gene"], r["best_site"], round(r["p"], 9), r["passed"]) for r in cell} == one
    draws = spark.createDataFrame([(p, f"g{g}", d, float(g + d)) for p in (2.0, 8.0) for g in range(6) for d in range(3)], "prior_df double, gene string, draw int, response double")
    paths = spark.createDataFrame([(1, i, f"g{i}") for i in range(6)] + [(2, i, f"g{5 - i}") for i in range(6)], "path int, pos int, gene string")
    got = {(r["prior_df"], r["alpha"], r["path"]): r["tau_mean"] for r in T.sensitivity_paths(paths, grid, draws, "gene").collect()}
    assert got and all(v == (1 if k[2] == 1 else -1) for k, v in got.items())


def test_validated_joins(spark):
    from evigraph.functions.keys import left_join

    one, two = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string"), spark.createDataFrame([(1, "c")], "k int, y string")
    assert left_join(one, two, "k").count() == 2
    for bad in ((two, one, False), (one, two, True)):
        with pytest.raises(ValueError, match="more than once"):
            left_join(bad[0], bad[1], "k", one_to_one=bad[2])


def test_block_products_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    rng = np.random.default_rng(3)
    w = np.where(rng.random((40, 9)) < 0.3, rng.integers(1, 9, (40, 9)), 0)
    rows = [(f"n{i}", f"d{j}", float(w[i, j])) for i in range(40) for j in range(9) if w[i, j]]
    got = {(r["node_a"], r["node_b"]): (r["dot"], r["cosine"]) for r in P.sparse_products(spark.createDataFrame(rows, "n string, d string, w double"), "n", "d", "w").collect()}
    want = {tuple(sorted((f"n{i}", f"n{j}"))): float(w[i] @ w[j]) for i in range(40) for j in range(i) if w[i] @ w[j] > 0}
    assert {k: v for k, (v, _) in got.items()} == want
    assert all(0 < c <= 1 + 1e-12 for _, c in got.values())


def test_settings(spark):
    got = C.normalize_configuration({"edge_integration": {"prior_probability": 0.2}, "edge_streams": {"a": {"weight": 2}}}, ["a", "b"])
    assert got["edge_integration"]["prior_probability"] == 0.2 and got["edge_streams"]["a"]["weight"] == 2.0 and got["edge_streams"]["b"]["enabled"] is True
    for bad in ({"edge_integration": {"prior_probability": 1.5}}, {"edge_streams": {"c": {}}}, {"edge_streams": {"a": {"tq_multiplier": 0.0}}}, {"search": {"mode": "x"}}, {"search": {"top_n": "3"}}, {"other": {}}, {"search": {"depth": 3}}):
        with pytest.raises(ValueError):
            C.normalize_configuration(bad, ["a", "b"])
    base = spark.createDataFrame([("a", 1), ("b", 2)], "gene_symbol string, x int")
    assert C.node_catalog(base, [spark.createDataFrame([("a", 5)], "gene_symbol string, y int")]).count() == 2
    with pytest.raises(ValueError, match="several"):
        C.node_catalog(base, [base])
    with pytest.raises(ValueError, match="twice"):
        C.node_catalog(base, [spark.createDataFrame([("a", 5), ("a", 6)], "gene_symbol string, y int")])
    with C.cancellable(spark, "group-1", "a count"):
        assert spark.range(100).count() == 100
    assert C.progress(spark, "group-1") == []


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_feeds(spark, tmp_path):
    ids = spark.createDataFrame([("p1", "A"), ("p2", "B")], "id string, node string")
    links = feeds.read_links(spark, write(tmp_path / "links.txt", "protein1 protein2 combined_score\np1 p2 400\np2 p1 700\np1 p9 900\n"), ids)
    assert [tuple(r) for r in links.collect()] == [("A", "B", 0.7)]
    path = write(tmp_path / "chem.tsv", "chemical\tprotein\tcombined_score\nCIDm0005\tp1\t300\nCIDs0005\tp1\t400\nCIDm0009\tp1\t500\n")
    rows = feeds.read_chemical_links(spark, path, spark.createDataFrame([(5, "cAMP")], "cid long, messenger string"))
    one = R.collapse_chemicals(rows).first()
    assert (one["messenger"], one["representations"], one["rows"], one["score"]) == ("cAMP", "CIDm;CIDs", 2, 0.4)
    bad = write(tmp_path / "bad.tsv", "chemical\tprotein\tcombined_score\nCIDm0005\tp1\t20\n")
    with pytest.raises(Exception, match="outside"):
        feeds.read_chemical_links(spark, bad, spark.createDataFrame([(5, "cAMP")], "cid long, messenger string")).collect()
    uniprot = write(tmp_path / "u.tsv", "Entry\tReviewed\tGene Names (primary)\tGene Names (synonym)\tModified residue\tSequence\nP1\treviewed\tAqp2\tWch; Cd\tPhosphoserine; Phosphothreonine\tMKV\nP2\tunreviewed\tAqp2\t\t\tMKVLL\n")
    entries = feeds.read_uniprot(spark, uniprot)
    got = {r["wanted"]: (r["accession"], r["symbol"], r["method"]) for r in R.resolve_targets(spark.createDataFrame([("aqp2",), ("p2",), ("WCH",), ("zz",)], "wanted string"), entries).collect()}
    assert got == {"aqp2": ("P1", "Aqp2", "primary name"), "p2": ("P2", "Aqp2", "accession"), "WCH": ("P1", "Aqp2", "synonym"), "zz": (None, None, None)}
    write(tmp_path / "pwm" / "K1.csv", "aa,-1,0\nA,0.5,1\nC,0.25,2\n")
    assert {tuple(r) for r in feeds.read_matrices(spark, str(tmp_path / "pwm"), 2, 2).collect()} == {("K1", "A", "-1", 0.5), ("K1", "A", "0", 1.0), ("K1", "C", "-1", 0.25), ("K1", "C", "0", 2.0)}
    with pytest.raises(Exception, match="shape"):
        feeds.read_matrices(spark, str(tmp_path / "pwm")).collect()
    assert {r["id"] for r in feeds.read_scope_ids(spark, write(tmp_path / "scope.txt", "x ENSG000001.4 y\nENSG000001\n\nENSMUSG02 z\n")).collect()} == {"ENSG000001", "ENSMUSG02"}
    compartments = write(tmp_path / "c.tsv", "e1\tA\tGO:1\tnucleus\ts\tc\t4\n")
    assert feeds.read_compartments(spark, compartments).first()["confidence"] == 4
    with pytest.raises(Exception, match="bad row"):
        feeds.read_compartments(spark, write(tmp_path / "c2.tsv", "e1\tA\tGO:1\tnucleus\ts\tc\t7\n")).collect()
    aliases = feeds.read_aliases(spark, write(tmp_path / "a.txt", "#id\talias\tsource\np1\tAqp2\tx\np2\taqp2\ty\n"))
    assert R.choose_ids(R.alias_hits(aliases, spark.createDataFrame([("AQP2",)], "wanted string")), ["y"]).first()["id"] == "p2"


def test_structural_scores_and_sinks(spark, tmp_path):
    write(tmp_path / "run" / "A_and_B" / "ranking_debug.json", json.dumps({"iptm": {"m1": 0.3, "m2": 0.8}, "order": ["m2", "m1"]}))
    write(tmp_path / "run" / "C_and_A" / "ranking_debug.json", json.dumps({"iptm": {"m1": 0.2}}))
    scores = feeds.structural_scores(spark, str(tmp_path / "run"))
    wanted = pairs_of(spark, [("A", "B", 1.0), ("A", "C", 1.0), ("B", "C", 1.0)])
    found, missing = feeds.collected(scores, wanted)
    assert {(r["node_a"], r["node_b"], r["score"], r["models"]) for r in found.collect()} == {("A", "B", 0.8, 2), ("A", "C", 0.2, 1)}
    assert [(r["node_a"], r["node_b"]) for r in missing.collect()] == [("B", "C")]
    write(tmp_path / "old" / "a.csv", "Jobs,iptm_ptm,iPTM,Ranking\nA_and_B,0.1,0.7,0.9\n")
    write(tmp_path / "old" / "b.csv", "pair, ranking_confidence ,score\nB_and_C,0.5,0.4\n")
    assert {(r["node_a"], r["node_b"], r["ranking"], r["score"]) for r in feeds.read_score_folder(spark, str(tmp_path / "old")).collect()} == {("A", "B", 0.9, 0.7), ("B", "C", 0.5, 0.4)}
    root = f"file://{tmp_path}/out"
    feeds.write_json(spark, f"{root}/s.json", {"a": 1})
    feeds.write_json(spark, f"{root}/s.json", {"a": 2})
    assert json.loads((tmp_path / "out" / "s.json").read_text()) == {"a": 2}
    for _ in range(2):
        feeds.append_audit(wanted, f"{root}/audit")
    assert spark.read.parquet(f"{root}/audit").count() == 6
    feeds.write_round_package(wanted, spark.createDataFrame([("A", "MK"), ("Z", "MM")], "name string, sequence string"), {"round": 1}, f"{root}/round")
    assert spark.read.text(f"{root}/round/sequences.fasta").count() == 2 and json.loads((tmp_path / "out" / "round" / "round_config.json").read_text()) == {"round": 1}
    page = feeds.html_trace("a < b", [("pairs", wanted)])
    assert "a &lt; b" in page and page.count("<tr>") == 4


def test_state_is_replaced_as_a_whole(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state")
    assert store.read("t") is None
    assert [store.replace("t", spark.range(n)) for n in (3, 5)] == [1, 2]
    assert StateStore(spark, f"file://{tmp_path}/state").read("t").count() == 5


def test_compartment_similarity_takes_all_lines(spark):
    """Small quantities count as large ones do: suppliers that never sell 49 or more are compared, too."""
    from evigraph.plans import stage

    class Tables:
        lineitem = spark.createDataFrame([(1, 1, 5.0), (2, 1, 3.0), (1, 2, 50.0), (2, 3, 2.0)], "l_orderkey long, l_suppkey long, l_quantity double")
        orders = spark.createDataFrame([(1, 1), (2, 2)], "o_orderkey long, o_custkey long")
        customer = spark.createDataFrame([(1, 1), (2, 2)], "c_custkey long, c_nationkey int")
        nation = spark.createDataFrame([(1, 0), (2, 1)], "n_nationkey int, n_regionkey int")

    got = {(r["node_a"], r["node_b"]): (r["exact"], r["expected"]) for r in stage.compartment_similarity(Tables()).collect()}
    length = math.sqrt(34)
    assert got == {(1, 2): (pytest.approx(5 / length, abs=1e-6), 0.625), (1, 3): (pytest.approx(3 / length, abs=1e-6), 0.375)}


def test_eligible_pairs_are_made_once_and_not_shuffled(spark, monkeypatch):
    """By brute force, with repeated nodes, null ones and flags, in shares of three nodes; pairs aren't made distinct."""
    monkeypatch.setattr(P, "SHARE", 3)
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.random() < 0.5, rng.random() < 0.4) for _ in range(30)] + [(None, True, True), (30, None, None)]
    nodes = spark.createDataFrame(rows, "node long, k boolean, s boolean")
    k, s = {n for n, a, _ in rows if a and n is not None}, {n for n, _, b in rows if b and n is not None}
    both, cross = S.eligible_pairs(nodes, F.col("k")), S.eligible_pairs(nodes, F.col("k"), F.col("s"))
    new = P.incremental_pairs(nodes, "node", F.col("k"))
    known = sorted({n for n, _, _ in rows if n is not None})
    for frame, fits in ((both, lambda a, b: a in k and b in k), (cross, lambda a, b: (a in k and b in s) or (a in s and b in k)), (new, lambda a, b: a in k or b in k)):
        assert "Aggregate" not in frame._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["node_a"], r["node_b"]) for r in frame.collect()) == [p for p in itertools.combinations(known, 2) if fits(*p)]


@pytest.mark.parametrize("penalty", [None, 0.7, 1.5])
def test_fills_are_made_and_counted_by_blocks(spark, monkeypatch, penalty):
    """As contributions of listed pairs, which no plan joins any more."""
    monkeypatch.setattr(S, "BLOCK", 7)
    rng = random.Random(11)
    nodes = spark.createDataFrame([(i, rng.random() < 0.6, rng.random() < 0.4, rng.random() < 0.3) for i in range(24)], "node long, p boolean, k boolean, s boolean")
    made = lambda n: spark.createDataFrame([(*sorted(rng.sample(range(26), 2)), rng.uniform(0.5, 2.0)) for _ in range(n)], "node_a long, node_b long, bayes_factor double")
    one, two, off = S.EdgeStream("one", "odds", weight=2.0), S.EdgeStream("two", "effort", continuous=True, floor=0.01), S.EdgeStream("off", "odds", weight=0.0)
    streams = [(one, made(40).localCheckpoint(), F.col("p"), None), (off, made(3), None, None), (two, made(30).localCheckpoint(), F.col("k"), F.col("s"))]
    listed = [(s, f, None if a is None else S.eligible_pairs(nodes, a, b)) for s, f, a, b in streams]
    want = S.contributions(listed, penalty)
    key = lambda df: sorted((r["stream"], r["node_a"], r["node_b"], r["filled"], round(r["log_bf"], 9)) for r in df.collect())
    got = S.eligible_contributions(nodes, streams, penalty)
    assert key(got) == key(want) and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: {r["stream"]: tuple(r) for r in df.collect()}
    assert rows(S.eligible_summary(nodes, streams, penalty)) == rows(S.stream_summary(want))


@pytest.mark.parametrize("alike", [True, False])
def test_profiles_of_compatible_pairs_are_worked_out_once(spark, alike):
    """They come from joins of whole tables, so these run once, however often their sums are read."""
    reads = spark.sparkContext.accumulator(0)

    def seen(x):
        reads.add(1)
        return x

    read = F.udf(seen, "double").asNondeterministic()
    rows = spark.range(40).select((F.col("id") % 8).alias("s"), F.floor(F.col("id") / 8).alias("d"), read(F.col("id").cast("double") + 1).alias("w"))
    matrix = spark.createDataFrame([(i, j, 1.0 if i == j else 0.5) for i in range(5) for j in range(5)], "i long, j long, c double")
    got = S.similar_by_compatibility(rows, matrix, "s", "d", "w") if alike else P.compatibility(rows, matrix, "s", "d", "w")
    assert len(got.collect()) == 28 and reads.value == 40
