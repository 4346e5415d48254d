"""The pair cache, locations by nearest anchors, and factorised posteriors."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators import compartments as L
from evigraph.operators import edge_stage as S
from evigraph.operators import factorised as X
from evigraph.operators import pair_cache as C

PAIRS = "node_a string, node_b string"


def asked(spark, names):
    return spark.createDataFrame(list(itertools.combinations(names, 2)), PAIRS)


def score(pairs):
    return pairs.where("node_a <> 'c'").select("node_b", "node_a", F.length(F.concat("node_a", "node_b")).cast("double").alias("payload"))


def test_second_run_computes_new_pairs_only(spark, tmp_path):
    seen = []

    def watched(pairs):
        seen.append(sorted((r["node_a"], r["node_b"]) for r in pairs.collect()))
        return score(pairs)

    one = C.PairSource("one", "s1", watched)
    cache = C.PairCache(spark, f"file://{tmp_path}/cache", buckets=4)
    first = cache.ensure(asked(spark, "abc"), [one])
    assert [(u.requested, u.reused, u.added, u.total) for u in first] == [(3, 0, 3, 3)]
    again = cache.ensure(asked(spark, "dcba").unionByName(spark.createDataFrame([("a", "a"), ("b", "a")], PAIRS)), [one])
    assert [(u.requested, u.reused, u.added, u.total) for u in again] == [(6, 3, 3, 6)]
    assert seen[1] == [("a", "d"), ("b", "d"), ("c", "d")]
    assert {(r["node_a"], r["node_b"]): r["payload"] for r in cache.rows().collect()} == {("a", "b"): 2.0, ("a", "c"): 2.0, ("b", "c"): 2.0, ("a", "d"): 2.0, ("b", "d"): 2.0, ("c", "d"): None}
    # the table is declared anew by another user of the folder
    spark.sql(f"DROP TABLE {cache.name}")
    assert C.PairCache(spark, f"file://{tmp_path}/cache", buckets=4).rows().count() == 6


def test_cached_side_is_not_shuffled(spark, tmp_path):
    cache = C.PairCache(spark, f"file://{tmp_path}/cache", buckets=4)
    source = C.PairSource("one", "s1", score)
    cache.ensure(asked(spark, "abcdef"), [source], batch_rows=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = cache.missing(asked(spark, "abcdefgh").repartition(3), source)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    cached = text[text.index("FileScan parquet") - 400 :]
    assert "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 1 and "Exchange" not in cached.split("FileScan")[0].split("\n")[-1]


def test_a_changed_source_invalidates_its_partition_only(spark, tmp_path):
    cache = C.PairCache(spark, f"file://{tmp_path}/cache", buckets=2)
    one, two = C.PairSource("one", "s1", score), C.PairSource("two", "s1", score)
    cache.ensure(asked(spark, "abcd"), [one, two])
    changed = C.PairSource("two", "s2", lambda pairs: score(pairs).withColumn("payload", F.lit(9.0)))
    assert [(u.source, u.reused, u.added) for u in cache.ensure(asked(spark, "abcd"), [one, changed])] == [("one", 6, 0), ("two", 0, 6)]
    assert cache.rows("two").count() == 12
    assert cache.forget({"one": "s1", "two": "s2"}) == 1
    assert cache.rows("one").count() == 6 and {r["payload"] for r in cache.rows("two").collect()} == {9.0, None}
    assert C.PairCache(spark, f"file://{tmp_path}/cache", buckets=2).rows().count() == 12
    assert {(r["one"], r["two"]) for r in cache.wide([one, changed]).collect()} == {(2.0, 9.0), (None, None)}


def test_a_lost_run_leaves_whole_batches(spark, tmp_path):
    cache = C.PairCache(spark, f"file://{tmp_path}/cache", buckets=2)
    calls = []

    def fails(pairs):
        calls.append(1)
        bad = F.raise_error(F.lit("lost")).cast("double") if len(calls) == 2 else F.lit(1.0)
        return pairs.withColumn("payload", bad)

    want = asked(spark, "abcdefgh")
    with pytest.raises(Exception, match="lost"):
        cache.ensure(want, [C.PairSource("one", "s1", fails)], batch_rows=10)
    left = C.PairCache(spark, f"file://{tmp_path}/cache", buckets=2)
    kept = left.rows().count()
    assert 0 < kept < 28 and left.rows().select("batch").distinct().count() == 1
    update = left.ensure(want, [C.PairSource("one", "s1", fails)], batch_rows=10)[0]
    assert (update.reused, update.added, update.total) == (kept, 28 - kept, 28)
    assert left.rows().select("node_a", "node_b").distinct().count() == 28

    def stop():
        raise RuntimeError("cancelled")

    with pytest.raises(RuntimeError, match="cancelled"):
        left.ensure(asked(spark, "xyz"), [C.PairSource("one", "s1", fails)], stop=stop)


def test_requested_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARE", 3)
    nodes = spark.createDataFrame([(i, i % 3 == 0) for i in range(20)] + [(0, None), (None, True)], "node long, new boolean")
    got = sorted((r["node_a"], r["node_b"]) for r in C.requested_pairs(nodes, "node", F.col("new")).collect())
    assert got == [(a, b) for a in range(20) for b in range(a + 1, 20) if a % 3 == 0 or b % 3 == 0]


def test_file_signatures(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x").write_text("1")
    path = [f"file://{tmp_path}/a"]
    one = C.files_signature(spark, path, "v1")
    assert one == C.files_signature(spark, path, "v1") != C.files_signature(spark, path, "v2")
    (tmp_path / "a/x").write_text("12")
    assert C.files_signature(spark, path, "v1") != one
    with pytest.raises(Exception):
        C.files_signature(spark, [f"file://{tmp_path}/none"])


def breadth_first(links, anchors, node):
    front, seen = {node}, {node}
    distance = 0
    while front:
        if hits := front & anchors:
            return {(a, distance) for a in hits}
        front = {p for c, p in links if c in front} - seen
        seen |= front
        distance += 1
    return set()


def test_nearest_anchors_by_breadth_first_search(spark):
    """A DAG of depth 40, and a cycle."""
    rng = random.Random(1)
    links = [(i, rng.randint(max(0, i - 6), i - 1)) for i in range(1, 160) for _ in range(2)] + [(500, 501), (501, 500), (501, 3), (600, 601), (601, 600)]
    anchors = {0, 7, 9, 60}
    got = {}
    frame = spark.createDataFrame(links, "child long, parent long")
    for r in L.nearest_anchors(frame, spark.createDataFrame([(a,) for a in anchors], "anchor long")).collect():
        got.setdefault(r["node"], set()).add((r["anchor"], r["distance"]))
    for node in {n for link in links for n in link}:
        assert got.get(node, set()) == breadth_first(links, anchors, node)
    deep = spark.createDataFrame([(i, i - 1) for i in range(1, 12)], "child long, parent long")
    assert max(r["distance"] for r in L.nearest_anchors(deep, spark.createDataFrame([(0,)], "anchor long")).collect()) == 11
    with pytest.raises(RuntimeError):
        L.nearest_anchors(deep, spark.createDataFrame([(0,)], "anchor long"), max_rounds=5)


def test_keyword_rules_in_their_order(spark):
    names = ["Outer Mitochondrial inner membrane", "ER membrane region", "ribbon of cell body", "axon terminus membrane", "some organelle", "Flemming body", "motile cilium", "membrane", "nothing known", None, "layer membrane"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").select("i", L.by_keyword(F.col("name")).alias("r"))
    got = {r["i"]: r["r"] for r in rows.collect()}

    def plain(name):
        for rule in L.KEYWORDS:
            if name is not None and any(n in name.lower() for n in rule.needles):
                return rule.reason, {z: w / sum(rule.zones.values()) for z, w in rule.zones.items()}
        return None

    for i, name in enumerate(names):
        assert (got[i] and (got[i]["reason"], got[i]["zones"])) == plain(name)
    assert len(L.KEYWORDS) == 37 and got[10]["reason"] == "ER membrane"


def test_mapped_locations(spark):
    terms = spark.createDataFrame([("GO:1", "root"), ("GO:2", "thing"), ("GO:3", "leaf"), ("GO:4", "the cytosol part"), ("GO:5", "odd")], "id string, name string")
    links = spark.createDataFrame([("GO:2", "GO:1"), ("GO:3", "GO:2"), ("GO:3", "OLD:9"), ("GO:3", "GO:77")], "child string, parent string")
    alt = spark.createDataFrame([("OLD:9", "GO:9"), ("OLD:3", "GO:3")], "alternative string, id string")
    terms = terms.unionByName(spark.createDataFrame([("GO:9", "second")], "id string, name string"))
    anchors = spark.createDataFrame([("GO:2", {"a": 1.0, "none": 0.0}, "specific", "x"), ("GO:9", {"b": 0.5, "a": 0.5}, "generic", "y")], "anchor string, zones map<string,double>, specificity string, description string")
    asked = spark.createDataFrame([("OLD:3", ""), ("GO:4", "GO:4"), ("GO:5", "odd"), ("GO:88", "plasma membrane raft"), ("GO:89", None), ("GO:1", "GO:1")], "location string, name string")
    got = {r["location"]: r for r in L.mapped_locations(asked, terms, links, anchors, alt).collect()}
    assert got["OLD:3"]["zones"] == {"a": 0.75, "b": 0.25} and got["OLD:3"]["id"] == "GO:3" and got["OLD:3"]["evidence"] == "GO:2:x:distance=1;GO:9:y:distance=1"
    assert (got["OLD:3"]["confidence"], got["OLD:3"]["priority"], got["OLD:3"]["method"]) == ("low", "high", "go_ancestor_anchor")
    assert (got["GO:4"]["zones"], got["GO:4"]["method"], got["GO:4"]["priority"]) == ({"cytosol_bulk": 1.0}, "keyword_fallback", "high")
    assert got["GO:88"]["zones"] == {"plasma_membrane": 1.0} and got["GO:88"]["evidence"] == "plasma membrane"
    assert [got[k]["method"] for k in ("GO:5", "GO:89", "GO:1")] == ["no_anchor_ancestor", "go_id_not_in_release", "no_anchor_ancestor"]
    assert {got[k]["priority"] for k in ("GO:5", "GO:89", "GO:1")} == {"critical"}


def dense(nodes, sources, prior, penalty):
    out = {}
    for a, b in itertools.combinations(sorted(nodes), 2):
        total, streams = math.log(prior / (1 - prior)), 0
        for s, factors, scope in sources:
            own = [f for x, y, f in factors if {x, y} == {a, b}]
            fill = s.floor if s.continuous else penalty
            if own:
                total += s.weight * sum(map(math.log, own))
                streams += 1
            elif scope is not None and s.negative and fill is not None and scope(nodes[a], nodes[b]):
                total += s.weight * math.log(fill)
        out[a, b] = (total, streams)
    return out


@pytest.mark.parametrize("penalty", [None, 0.8])
def test_factorised_is_the_dense_matrix(spark, monkeypatch, penalty):
    monkeypatch.setattr(X, "SHARE", 5)
    rng = random.Random(2)
    nodes = {i: (rng.random() < 0.6, rng.random() < 0.4, rng.random() < 0.3) for i in range(40)}
    made = lambda n, low: [(*rng.sample(range(43), 2), rng.uniform(low, 3.0)) for _ in range(n)]  # noqa: E731  three nodes aren't known
    one, two, three, off = S.EdgeStream("one", "odds", weight=2.0), S.EdgeStream("two", "effort", continuous=True, floor=0.01), S.EdgeStream("three", "hits", weight=0.5, negative=False), S.EdgeStream("off", "odds", weight=0.0)
    f1, f2, f3 = made(120, 0.2), made(90, 0.5), made(60, 1.0)
    frame = lambda rows: spark.createDataFrame(rows, "node_a long, node_b long, bayes_factor double")
    sources = [
        X.Source(one, frame(f1), X.Scope(F.col("p"))), X.Source(off, frame(f1), None),
        X.Source(two, frame(f2), X.Scope(F.col("k"), F.col("s"))), X.Source(three, frame(f3), X.Scope(F.col("p"))),
    ]
    table = spark.createDataFrame([(i, *flags) for i, flags in nodes.items()], "node long, p boolean, k boolean, s boolean")
    edges = X.factorise(table, sources, 0.3, penalty)
    cross = lambda a, b: (a[1] and b[2]) or (a[2] and b[1])
    want = dense(nodes, [(one, f1, lambda a, b: a[0] and b[0]), (two, f2, cross), (three, f3, lambda a, b: a[0] and b[0])], 0.3, penalty)
    p = lambda z: 1 / (1 + math.exp(-z))
    every = spark.createDataFrame([(b, a) for a, b in itertools.combinations(range(43), 2)], "node_a long, node_b long")
    got = {(r["node_a"], r["node_b"]): r for r in edges.lookup(every).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k]["log_odds"], z, abs_tol=1e-9) and got[k]["streams"] == n for k, (z, n) in want.items())
    # rows that are kept: those reported and classes squared
    classes = edges.nodes.select("class").distinct().count()
    assert edges.reported.count() == sum(n > 0 for _, n in want.values()) and edges.classes.count() == classes * (classes + 1) // 2
    assert edges.classes.agg(F.sum("all_pairs")).first()[0] == len(want)
    row = edges.distribution(0.5, 50).first()
    values = sorted(p(z) for z, _ in want.values())
    import numpy as np

    assert row["pairs"] == len(values) and row["bins"] == np.histogram(values, bins=np.linspace(0, 1, 51))[0].tolist() and math.isclose(row["mean"], sum(values) / len(values), abs_tol=1e-12)
    assert row["above_cutoff"] == sum(v > 0.5 for v in values) and row["at_prior"] == sum(abs(v - 0.3) <= 1e-12 for v in values)
    qs = [i / 20 for i in range(21)]
    assert np.allclose(edges.quantiles(qs).first()["q"], np.quantile(values, qs), atol=1e-9)
    for cutoff in (0.2, 0.9, 0.0):
        got = {(r["node_a"], r["node_b"]) for r in edges.above(cutoff).collect()}
        assert got == {k for k, (z, _) in want.items() if p(z) > cutoff}
    pairs, groups = edges.top(200)
    best = sorted((z for z, _ in want.values()), reverse=True)[:200][-1]
    n = sum(z >= best - 1e-9 for z, _ in want.values())
    assert pairs.count() + (groups.agg(F.sum("pairs")).first()[0] or 0) == n
    more = edges.with_factors(frame([(1, 2, 1.8), (2, 1, 1.8), (3, 3, 1.8), (0, 42, 1.8)]), weight=1.5)
    changed = more.lookup(every.where("node_a = 2 and node_b = 1")).first()
    assert math.isclose(changed["log_odds"], want[1, 2][0] + 3 * math.log(1.8), abs_tol=1e-9) and more.distribution(0.5).first()["pairs"] == len(want)
    audit = {r["stream"]: r for r in X.stream_audit(edges, sources, penalty).collect()}
    assert audit["one"]["eligible"] == sum(nodes[a][0] and nodes[b][0] for a, b in want) and audit["three"]["fills"] == 0
    known = {tuple(sorted(f[:2])) for f in f2} & set(want)
    assert audit["two"]["unsupported"] == sum(bool(cross(nodes[a], nodes[b])) and (a, b) not in known for a, b in want) == audit["two"]["fills"]


def test_ranks_keep_rows_whose_value_differs_when_worked_out_again(spark):
    """Sums of shuffled doubles may end otherwise in their last place the second time; here the whole value does."""
    from evigraph.operators.order import with_rank

    draw = F.udf(lambda _: random.random(), "double").asNondeterministic()
    rows = with_rank(spark.range(500).withColumn("v", draw("id")), F.col("v")).orderBy("v").collect()
    assert [r["rank"] for r in rows] == list(range(1, 501)) and len({r["id"] for r in rows}) == 500


def test_agreement_reads_a_ledger_once(spark):
    """By brute force, with repeated, neutral, missing and null rows; then with factors that differ each time they are read."""
    from evigraph.operators.stats import agreement

    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", "c", None]), rng.choice([0.5, 1.0, 3.0, None])) for _ in range(60)]
    want = {}
    for (k, s, f), (l, t, g) in itertools.product(rows, rows):
        if k is None or s is None or t is None or k != l or not s < t:
            continue
        x, y = (None if f is None else math.log(f)), (None if g is None else math.log(g))
        n = want.setdefault((s, t), [0] * 5)
        up, both = (x is not None and x > 0, y is not None and y > 0), x is not None and y is not None
        for i, c in enumerate((True, both and x * y > 0, both and x * y < 0, all(up), any(up))):
            n[i] += c
    frame = spark.createDataFrame(rows, "symbol int, stream string, factor double")
    got = {(r["stream_a"], r["stream_b"]): r for r in agreement(frame, "symbol", None).collect()}
    assert set(got) == set(want)
    for pair, (n, concordant, discordant, both, either) in want.items():
        r = got[pair]
        assert (r["n"], r["concordant"], r["discordant"], r["both_positive"]) == (n, concordant, discordant, both) and r["jaccard"] == pytest.approx(both / either)
    draw = F.udf(lambda _: random.choice([0.5, 2.0]), "double").asNondeterministic()
    drawn = spark.range(300).select("id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("stream")).withColumn("factor", F.when(F.col("stream") == "b", draw("id")).otherwise(2.0))
    once = {(r["stream_a"], r["stream_b"]): r["concordant"] for r in agreement(drawn, "id", None).collect()}
    assert once["a", "b"] == once["b", "c"] and once["a", "c"] == 300


@pytest.mark.parametrize("table", [1 << 24, 1])
def test_shared_groups_are_judged_without_a_row_for_a_pair(spark, monkeypatch, table):
    """Two kinds of groups, by brute force over all pairs; slices and blocks of a few rows."""
    from evigraph.operators import pairs as P

    for name, value in (("SIDE", 20), ("MET", 7), ("TABLE", table)):
        monkeypatch.setattr(P, name, value)
    rng = random.Random(6)
    nodes = {i: (rng.random() < 0.6, rng.random() < 0.4, rng.random() < 0.3) for i in range(40)}
    days, hubs = ({(rng.randrange(many), rng.randrange(43)) for _ in range(rows)} for many, rows in ((30, 120), (4, 30)))
    n, m, a, b = (F.col(c) for c in ("n", "m", "part_a", "part_b"))
    one, two, three = S.EdgeStream("one", "odds", weight=2.0), S.EdgeStream("two", "effort", continuous=True, floor=0.01), S.EdgeStream("three", "hits", weight=1.5, negative=False)
    sources = [
        X.Source(one, F.when(n > 0, 0.7 + 0.6 * n + a / 8.0), X.Scope(F.col("p"))),
        X.Source(two, F.when((n > 0) & ((a + b) % 3 > 0), 0.2 + 0.5 * n), X.Scope(F.col("k"), F.col("s"))), X.Source(three, F.when(m > 0, 1.0 + m), None),
    ]
    table = spark.createDataFrame([(i, *flags) for i, flags in nodes.items()], "node long, p boolean, k boolean, s boolean")
    rows = spark.createDataFrame([(g, x, 0) for g, x in days] + [(g, x, 1) for g, x in hubs] * 2, "g long, node long, relation int")
    edges = X.factorise_shared(rows, table, sources, 0.3, 0.8, F.col("node") % 4, 4)
    f1, f2, f3 = [], [], []
    for x, y in itertools.combinations(range(40), 2):
        if i := sum((g, x) in days and (g, y) in days for g in range(30)):
            f1.append((x, y, 0.7 + 0.6 * i + x % 4 / 8))
            if (x % 4 + y % 4) % 3:
                f2.append((x, y, 0.2 + 0.5 * i))
        if j := sum((g, x) in hubs and (g, y) in hubs for g in range(4)):
            f3.append((x, y, 1.0 + j))
    cross = lambda a, b: (a[1] and b[2]) or (a[2] and b[1])
    want = dense(nodes, [(one, f1, lambda a, b: a[0] and b[0]), (two, f2, cross), (three, f3, None)], 0.3, 0.8)
    every = spark.createDataFrame([(b, a) for a, b in itertools.combinations(range(43), 2)], "node_a long, node_b long")
    got = {(r["node_a"], r["node_b"]): (pytest.approx(r["log_odds"], abs=1e-9), r["streams"]) for r in edges.lookup(every).collect()}
    assert got == want and edges.reported().first()[0] == sum(k > 0 for _, k in want.values())
    values = sorted(1 / (1 + math.exp(-z)) for z, _ in want.values())
    row = edges.distribution(0.5, 50).first()
    assert row["pairs"] == len(want) and row["mean"] == pytest.approx(sum(values) / len(values)) and row["above_cutoff"] == sum(v > 0.5 for v in values)
    pairs, groups = edges.top(30)
    last = sorted((round(z, 9) for z, _ in want.values()), reverse=True)[29]
    best = {k: z for k, (z, streams) in want.items() if round(z, 9) >= last and streams}
    assert {(r["node_a"], r["node_b"]): pytest.approx(r["log_odds"], abs=1e-9) for r in pairs.collect()} == best
    assert (groups.agg(F.sum("pairs")).first()[0] or 0) == sum(round(z, 9) >= last and not streams for z, streams in want.values())
    audit = {r["stream"]: r for r in edges.audit().collect()}
    assert [audit[s]["reported"] for s in ("one", "two", "three")] == [len(f) for f in (f1, f2, f3)] and audit["two"]["against"] == sum(f[2] < 1 for f in f2)
    assert audit["one"]["fills"] == sum(nodes[x][0] and nodes[y][0] for x, y in want) - sum(nodes[x][0] and nodes[y][0] for x, y, _ in f1) and audit["three"]["eligible"] == 0


@pytest.mark.parametrize("name", ["factorised_posteriors", "factorised_distribution", "factorised_quantiles", "factorised_audit", "factorised_top", "factorised_with_closure"])
def test_pairs_that_share_a_date_are_not_written(spark, monkeypatch, name):
    """Two hundred customers of one kind ordered on each of three dates: 19,900 pairs, and less than a tenth as many rows are written."""
    from evigraph.plans import factorised as plan_of
    from evigraph.sources.state import cut

    written = []

    def watched(df, name):
        out = cut(df, name)
        written.append((name, out.count()))
        return out

    for module in (X, plan_of):
        monkeypatch.setattr(module, "cut", watched, raising=False)
    orders = [(10 * i, 12 * (i % 200), "F", i // 200) for i in range(600)]

    class Tables:
        customer = spark.createDataFrame([(12 * i, 6, 1.0) for i in range(200)], "c_custkey long, c_nationkey int, c_acctbal double")

    Tables.orders = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, d int").withColumn("o_orderdate", F.date_add(F.lit("1995-01-01").cast("date"), F.col("d")))
    made = {q.__name__: q for q in (plan_of.posteriors, plan_of.distribution, plan_of.quantiles, plan_of.audit, plan_of.top, plan_of.with_closure)}
    made[name.removeprefix("factorised_")](Tables()).collect()
    assert written and max(n for _, n in written) < 1990
