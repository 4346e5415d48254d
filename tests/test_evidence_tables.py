"""Quantiles by group, segment evidence, ablation in one pass, suggested names and the site database."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from evigraph.operators import ablation as A
from evigraph.operators import segments as E
from evigraph.operators import sites as Z
from evigraph.operators.order import grouped_quantiles
from evigraph.operators.suggest import suggestions


def test_quantiles_of_unequal_groups(spark):
    rng = random.Random(3)
    sizes = {("a", 1): 1, ("a", 2): 900, ("b", None): 7, (None, 3): 40, ("c", 4): 2}
    rows = [(g, h, rng.choice([rng.random(), 0.5, -1.0])) for (g, h), n in sizes.items() for _ in range(n)] + [("only nulls", 1, None)]
    frame = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    qs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {(r["g"], r["h"]): (r["q"], r["n"]) for r in grouped_quantiles(frame, ["g", "h"], F.col("v"), qs).collect()}
    assert set(got) == set(sizes)
    for key, n in sizes.items():
        values = [v for g, h, v in rows if (g, h) == key]
        assert got[key][1] == n and np.allclose(got[key][0], np.quantile(values, qs), atol=1e-12)
    assert grouped_quantiles(frame.where("false"), ["g"], F.col("v"), qs).count() == 0


def test_segment_evidence_by_hand(spark):
    measured = spark.createDataFrame([("rna", "ccd", i, float(i)) for i in range(5)] + [("rna", "ccd", 9, None), ("rna", "omcd", 1, 8.0), ("rna", "omcd", 2, float("nan"))], "assay string, segment string, row long, x double")
    mapping = spark.createDataFrame([("rna", 1, "A"), ("rna", 4, "A"), ("rna", 0, "B"), ("rna", 9, "C"), ("rna", 2, "Z")], "assay string, row long, symbol string")
    universe = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "symbol string")
    rows = {(r["symbol"], r["segment"]): r for r in E.segment_factors(measured, mapping, universe).collect()}
    tq = 3.25  # of 1, 2, 3, 4
    assert len(rows) == 8 and math.isclose(rows["A", "ccd"]["tq"], tq) and rows["A", "ccd"]["value"] == 4.0
    assert math.isclose(rows["A", "ccd"]["bayes_factor"], 2 * (1 - math.exp(-0.5 * (4 / tq) ** 2)))
    assert all(rows[s, "ccd"]["bayes_factor"] == 1.0 and not rows[s, "ccd"]["observed"] for s in "BCD")
    assert math.isclose(rows["A", "omcd"]["tq"], 8.0) and rows["A", "omcd"]["value"] == 8.0
    weights = spark.createDataFrame([("rna", "ccd", 2.0), ("rna", "omcd", 0.0)], "assay string, segment string, weight double")
    chosen = {r["symbol"]: r for r in E.selected(E.segment_factors(measured, mapping, universe), weights, 0.3, 0.31).collect()}
    assert set(chosen) == {"A"} and chosen["A"]["streams"] == 1


def test_ortholog_cascade_by_hand(spark):
    mapping = spark.createDataFrame([("g1", "p1", ""), ("g2", " p2 ", "P3"), ("g9", "P9", None)], "gene string, swissprot string, trembl string")
    links = E.accession_genes(mapping.na.fill(""), "gene", ["swissprot", "trembl"])
    orthology = spark.createDataFrame(
        [("g1", "Aa", "m1", "Xx", "one", "1"), ("g1", "Aa", "m2", "Yy", "many", "0"), ("g2", "Bb", "m3", "Zz", "one", "0"), ("g3", "Cc", "m4", "", "one", "1"), ("g4", "Dd", "m5", "Ww", "one", "1"), ("g1", "Aa", "m1", "Xx", "one", "1")],
        "gene string, symbol string, other_gene string, other_symbol string, type string, confidence string",
    )
    proteins = spark.createDataFrame([(1, "P1", "zzz"), (2, "p3-2", "Aa"), (3, "P9", "Dd"), (4, "none", "dD"), (5, "", "Cc"), (6, None, None)], "row long, accession string, symbol string")
    mapped, lost = E.map_orthologs(proteins, links, orthology, spark.createDataFrame([("XX",), ("ww",)], "symbol string"))
    got = {(r["row"], r["other_symbol"], r["canonical"], r["in_universe"], r["mapping_source"], r["rule"]) for r in mapped.collect()}
    assert got == {(1, "Xx", "XX", True, "rat_uniprot", "high_confidence_preferred"), (2, "Zz", "", False, "rat_uniprot", "low_confidence_fallback"), (4, "Ww", "ww", True, "rat_gene_symbol", "high_confidence_preferred")}
    # a known accession whose gene has no ortholog doesn't go by symbol
    assert {(r["row"], r["attempt"]) for r in lost.collect()} == {(3, "rat_uniprot"), (5, "rat_gene_symbol"), (6, "rat_gene_symbol")}


def test_ablation_has_one_shuffle_for_all_configurations(spark):
    rng = random.Random(5)
    weights = {"a": 1.0, "b": 2.0, "off": 0.0, "c": 0.5}
    rows = [(f"n{i}", s, rng.uniform(-1, 1)) for i in range(60) for s in weights if rng.random() < 0.6]
    frame = spark.createDataFrame(rows, "node string, stream string, log_bf double")
    configurations = A.leave_one_out(weights, 0.4)
    assert [c.name for c in configurations] == ["full", "without a", "without b", "without c"]
    found = A.vectors(frame, ["node"], configurations)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

    def p(node, c):
        return 1 / (1 + math.exp(-(math.log(0.4 / 0.6) + sum(c.weights.get(s, 0) * x for n, s, x in rows if n == node))))

    got = {r["node"]: r["p"] for r in found.collect()}
    assert all(math.isclose(v, p(n, c), abs_tol=1e-12) for n, vs in got.items() for v, c in zip(vs, configurations, strict=True))
    flips = {(r["configuration"], r["node"], r["change"]) for r in A.changes(found, ["node"], configurations, 0.5).collect()}
    assert flips == {(c.name, n, "lost_after_ablation" if p(n, configurations[0]) > 0.5 else "gained_after_ablation") for n in got for c in configurations[1:] if (p(n, configurations[0]) > 0.5) != (p(n, c) > 0.5)}
    for r in A.summary(found, configurations, 0.5).collect():
        c = next(c for c in configurations if c.name == r["configuration"])
        one, two = {n for n in got if p(n, configurations[0]) > 0.5}, {n for n in got if p(n, c) > 0.5}
        assert (r["full"], r["ablated"], r["lost"], r["gained"]) == (len(one), len(two), len(one - two), len(two - one)) and math.isclose(r["jaccard"], len(one & two) / len(one | two))


def test_paths_after_ablation(spark):
    configurations = A.leave_one_out({"a": 1.0, "b": 1.0}, 0.5)
    frame = spark.createDataFrame([("x", "y", "a", 2.0), ("y", "z", "b", 1.0), ("y", "z", "a", 0.5)], "node_a string, node_b string, stream string, log_bf double")
    paths = spark.createDataFrame([(1, "x", "y"), (1, "z", "y"), (2, "x", "q")], "path int, node_a string, node_b string")
    got = {(r["configuration"], r["path"]): (r["steps"], r["lost"], r["product"]) for r in A.paths_after(paths, A.vectors(frame, ["node_a", "node_b"], configurations), configurations, 0.6).collect()}
    s = lambda z: 1 / (1 + math.exp(-z))
    assert got["full", 1][:2] == (2, 0) and math.isclose(got["full", 1][2], s(2) * s(1.5))
    assert got["without a", 1][:2] == (2, 1) and got["without b", 1][:2] == (2, 0) and got["full", 2] == (1, 1, 0.5)


def blocks(a, b):
    """Characters in matching blocks: the longest common stretch, the earliest in both, and the same on either side."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    return n and n + blocks(a[:i], b[:j]) + blocks(a[i + n :], b[j + n :])


def test_suggestions_equal_a_plain_implementation(spark):
    """10,000 random names, two cutoffs: nothing that the index leaves out would have counted."""
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("aabcdeeinrst1-Ü") for _ in range(rng.randint(1, 9)))
    names = [name() for _ in range(10_000)] + ["", None]
    wanted = [name() for _ in range(6)] + ["aab", "", None, "zzz"]
    different = sorted({n for n in names if n})
    frame, asked = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(w,) for w in wanted], "wanted string")
    for cutoff, most in ((0.45, 5), (0.8, 40)):
        got = {}
        for r in suggestions(frame, asked, most=most, cutoff=cutoff).orderBy("rank").collect():
            got.setdefault(r["wanted"], []).append((r["name"], round(r["ratio"], 9)))
        for w in filter(None, set(wanted)):
            # only names that the characters in common allow
            near = [n for n in different if 2 * sum(min(n.count(c), w.count(c)) for c in set(n)) / (len(n) + len(w)) >= cutoff]
            rated = [(2 * blocks(n, w) / (len(n) + len(w)), n) for n in near]
            assert got.get(w, []) == [(n, round(r, 9)) for r, n in sorted((x for x in rated if x[0] >= cutoff), reverse=True)[:most]], w


def test_suggestions_compare_few_pairs_in_several_tasks(spark, monkeypatch):
    """Bounds decide most pairs, names over a word of bits too; blocks are dealt out by their number, however few bytes they have."""
    from difflib import SequenceMatcher

    from evigraph.operators import suggest

    rng = random.Random(9)
    name = lambda most: "".join(rng.choice("aabcdeeinrst1-Ü") for _ in range(rng.randint(1, most)))
    names, wanted = sorted({name(24) for _ in range(2000)} | {name(200) for _ in range(40)}), sorted({name(8) for _ in range(40)} | {name(150) for _ in range(4)})
    rated, compared = {}, []
    for w in wanted:
        matcher = SequenceMatcher()
        matcher.set_seq2(w)
        for n in names:
            matcher.set_seq1(n)
            # a quick ratio is never below the ratio
            if matcher.quick_ratio() >= 0.45 and matcher.ratio() >= 0.45:
                rated.setdefault(w, []).append((matcher.ratio(), n))
    best = {w: sorted(r, reverse=True)[:5] for w, r in rated.items()}

    class Counted(SequenceMatcher):
        def ratio(self):
            compared.append(1)
            return super().ratio()

    monkeypatch.setattr(suggest, "SequenceMatcher", Counted)
    letters = suggest._Letters(names)
    assert {w: r for w in wanted if (r := sorted(suggest._best(letters, w, 5, 0.45), reverse=True))} == best
    assert len(compared) < 0.02 * len(names) * len(wanted)
    monkeypatch.undo()
    monkeypatch.setattr(suggest, "ASKED", 11)
    monkeypatch.setattr(suggest, "NAMES", 700)
    frame, asked = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(w,) for w in wanted], "wanted string")
    spark.sparkContext.setJobGroup("suggest", "suggest")
    got = {}
    for r in suggestions(frame, asked).orderBy("rank").collect():
        got.setdefault(r["wanted"], []).append((r["ratio"], r["name"]))
    assert got == best
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("suggest") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 12
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_site_database_by_hand(spark):
    sequence = "MKTAYIAKQRSQSFVKSHFSRQ"
    text = 'MOD_RES 11; /note="Phosphoserine"; /evidence="E1"; MOD_RES 13..14; /note="Phosphoserine"; MOD_RES 40; /note="Phosphotyrosine"; MOD_RES 3; /note="N6-acetyl"; MOD_RES 5; /note="phosphotyrosine; by X"'
    entries = spark.createDataFrame([("Q1", True, "Abc", "Old1 Old2", text, " mktay iakqrsqsfvkshfsrq1"), ("Q2", False, "Abc Other", "", None, "MK"), ("Q3", False, "Zed", "", "", "MMM")], "accession string, reviewed boolean, primary string, synonyms string, features string, sequence string")
    nodes = spark.createDataFrame([("ABC", ["Q2", "q1-3"]), ("Other", []), ("old2", None), ("gone", ["X9-1"]), ("none", [" "])], "symbol string, accessions array<string>")
    proteins = Z.mapped_proteins(nodes, entries).cache()
    got = {r["symbol"]: (r["selected"], r["accession"], r["method"]) for r in proteins.collect()}
    assert got == {"ABC": ("q1-3", "Q1", "selected_accession_canonicalized"), "Other": ("", "Q2", "gene_primary_fallback"), "old2": ("", "Q1", "gene_synonym_fallback"), "gone": ("X9-1", "", "selected_accession_missing"), "none": ("", "", "no_accession_or_gene_match")}
    mine = proteins.where("symbol = 'ABC'")
    rows = spark.createDataFrame([("abc", "s11", "P", "AAAAAASCCCCCC"), ("ABC", "T 2", "P", "AAAAAAGCCCCCC"), ("Abc", "S99", None, ""), ("abc", "bad", "P", ""), ("other one", "S1", "P", "")], "symbol string, site string, accession string, window string")
    db = Z.database(Z.annotated(mine), Z.measured(rows, mine, "lab")).cache()
    found = {r["site"]: r for r in db.collect()}
    assert set(found) == {"S11", "?40", "Y5", "T2", "S99"}
    s11 = found["S11"]
    assert (s11["window"], s11["notation"], s11["scorable"]) == ("YIAKQRSQSFVKS", "YIAKQRS*QSFVKS", True)
    assert s11["sources"] == "dataset_observed;uniprot_annotated" and s11["evidence"] == "E1;lab" and s11["window_source"] == "canonical_uniprot;dataset_supplied"
    assert s11["validation"] == "canonical_residue_from_uniprot;canonical_sequence_match;dataset_window_center_match"
    assert not found["?40"]["scorable"] and found["?40"]["validation"] == "uniprot_position_out_of_range" and found["Y5"]["window"] == ""
    assert found["T2"]["validation"] == "canonical_residue_mismatch:K;dataset_window_center_mismatch:G" and found["T2"]["scorable"]
    assert found["S99"]["validation"] == "canonical_position_out_of_range" and found["S99"]["window"] == ""
    every = {r["site"]: (r["scorable"], r["sources"]) for r in Z.candidates(mine, db).collect()}
    assert set(every) == {f"{c}{i}" for i, c in enumerate(sequence, 1) if c in "STY"} and every["S11"] == (True, "dataset_observed;uniprot_annotated") and every["Y5"] == (False, "uniprot_annotated")


def test_missing_thresholds_become_the_median(spark):
    from evigraph.operators import evidence as V

    nodes = spark.createDataFrame([(i,) for i in range(5)], "k long")
    rows = spark.createDataFrame([(0, 1.0, 2.0), (1, None, 4.0), (2, 3.0, -1.0), (3, float("nan"), None), (9, 1.0, 100.0)], "k long, v double, t double")
    got = {r["k"]: (r["x"], r["tq"]) for r in V.node_values(nodes, "phosphoprotein_response", rows, "k", "v", "t").collect()}
    assert got == {0: (1.0, 2.0), 1: (None, 4.0), 2: (3.0, 3.0), 3: (None, 3.0), 4: (None, 3.0)}  # rows of other nodes don't count
    assert {r["tq"] for r in V.node_values(nodes, "protein_abundance", rows, "k", "v", "t").collect()} == {2.0}
    assert {r["tq"] for r in V.node_values(nodes, "kinase_activity", rows, "k", "v").collect()} == {0.17}
    for bad in (lambda: V.node_values(nodes, "other", rows, "k", "v", "t"), lambda: V.node_values(nodes, "pc_transcript", rows, "k", "v")):
        try:
            bad()
            raise AssertionError
        except ValueError:
            pass
    try:
        V.node_values(nodes, "collecting_duct_abundance", rows.withColumn("t", F.lit(0.0)), "k", "v", "t").collect()
        raise AssertionError
    except Exception as e:
        assert "no positive threshold" in str(e)
    assert V.value_counts(rows, "v", most=2).count() == 0 and {(r["value"], r["n"]) for r in V.value_counts(rows.where("k IN (0, 9, 2)"), "v").collect()} == {(1.0, 2), (3.0, 1)}
