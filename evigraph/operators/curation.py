"""Eligibility with reasons, triage, reconciliation, imports and identifier choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import kernels as K
from evigraph.operators import pairs as P


def intermediate_eligibility(nodes: DataFrame, classes: Column, relay: list[str], ends: list, kind: Column, key: str) -> DataFrame:
    """(key, eligible, reason): endpoints always, proteins by a relay class, messengers by kind."""
    relays = F.array_intersect(classes, F.array(*[F.lit(c) for c in relay]))
    reason = (
        F.when(F.col(key).isin(ends), "endpoint")
        .when(kind == "external_target", "external target is no intermediate")
        .when(kind == "second_messenger", "second messenger")
        .when(F.size(relays) > 0, F.concat(F.lit("relay: "), F.array_join(F.array_sort(relays), ";")))
        .otherwise("no relay class")
    )
    rows = nodes.select(key, reason.alias("reason"))
    return rows.select(key, ~F.col("reason").isin("external target is no intermediate", "no relay class"), "reason").toDF(key, "eligible", "reason")


def triage(pairs: DataFrame, covered: Column, similarity: Column, other_covered: Column, other_similarity: Column, posterior: Column, eps: float = 1e-12) -> DataFrame:
    """Pairs to exclude: not supported, shared nowhere, and disjoint where covered; all others are retained."""
    supported = posterior > 0.5 + eps
    shared = (covered & (similarity > eps)) | (other_covered & (other_similarity > eps))
    disjoint = (covered & (similarity <= eps)) | (other_covered & (other_similarity <= eps))
    rows = pairs.withColumn("supported", supported).withColumn("shared", F.coalesce(shared, F.lit(False)))
    exclude = ~F.col("supported") & ~F.col("shared") & F.coalesce(disjoint, F.lit(False))
    return rows.withColumn("exclude", exclude).withColumn("retain", ~exclude)


def reconcile(ledger: DataFrame, keys: list[str], order: str, prior: float = 0.5) -> DataFrame:
    """Repeated likelihood updates against the summed logs: their difference for each key."""
    g = ledger.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "factor"))).alias("steps"), F.sum(F.ln("factor")).alias("log_odds"))
    repeated = F.aggregate("steps", F.lit(prior), lambda p, s: K.likelihood_update(p, s["factor"] * F.lit(0.5)))
    summed = K.expit(K.logit(F.lit(prior)) + F.col("log_odds"))
    return g.select(*keys, repeated.alias("repeated"), summed.alias("summed"), F.abs(repeated - summed).alias("difference"))


def masked_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation over rows that have both; null for one row or a constant side."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = both.agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return s.select("n", (F.col("c") / F.when((F.col("n") > 1) & (F.col("sx") * F.col("sy") > 0), F.col("sx") * F.col("sy"))).alias("r"))


def ortholog_pairs(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(a, b) pairs through a many-to-many mapping (name, target): different unordered pairs of targets.

    Names with many targets meet in chunks, and tasks follow the number of pairs that come out.
    """
    m = mapping.toDF("name", "target").distinct()
    sizes = m.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", "n", F.ceil(F.col("n") / P.CHUNK).cast("int").alias("chunks"))
    of = lambda end: sizes.select(F.col("name").alias(end), F.col("n").alias(f"n_{end}"), F.col("chunks").alias(f"chunks_{end}"))
    sized = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    made = sized.agg(F.sum(F.col("n_a").cast("double") * F.col("n_b")).alias("made")).first()["made"] or 0
    parts = max(1, -(-int(made) // P.ROWS))

    def side(end: str, other: str) -> DataFrame:
        rows = sized.join(m.select(F.col("name").alias(end), F.col("target").alias(f"t{end}")), end)
        mine = F.pmod(F.xxhash64(f"t{end}"), F.col(f"chunks_{end}")).cast("int").alias(f"c{end}")
        return rows.select("a", "b", f"t{end}", mine, F.explode(F.sequence(F.lit(0), F.col(f"chunks_{other}") - 1)).alias(f"c{other}"))

    # names and chunks in parts of a key, one join
    key = ["a", "b", "ca", "cb"]
    met = side("a", "b").repartition(parts, *key).join(side("b", "a").repartition(parts, *key), key).where("ta != tb")
    return met.select(F.least("ta", "tb").alias("node_a"), F.greatest("ta", "tb").alias("node_b")).repartition(parts, "node_a", "node_b").distinct()


def import_scores(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Validity cascade and duplicates of legacy scores (node_a, node_b, ranking, score): the reason, and one accepted row a pair."""
    k = known.select("node").distinct()
    r = rows.join(k.select(F.col("node").alias("node_a"), F.lit(True).alias("ka")), "node_a", "left").join(k.select(F.col("node").alias("node_b"), F.lit(True).alias("kb")), "node_b", "left")
    reason = (
        F.when(F.col("ka").isNull() | F.col("kb").isNull(), "unknown node")
        .when(F.col("node_a") == F.col("node_b"), "self pair")
        .when(F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1), "bad score")
        .otherwise("accepted")
    )
    r = r.withColumn("reason", reason).withColumn("a", F.least("node_a", "node_b")).withColumn("b", F.greatest("node_a", "node_b"))
    w = Window.partitionBy("a", "b", "reason").orderBy(F.desc_nulls_last("ranking"), F.desc("score"))
    r = r.withColumn("_n", F.row_number().over(w))
    return r.select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), "score", F.when((F.col("reason") == "accepted") & (F.col("_n") > 1), "duplicate").otherwise(F.col("reason")).alias("reason"))


def incident_pairs(edges: DataFrame, target) -> DataFrame:
    """The target's row: (node, p) of its pairs, best first by rank."""
    rows = edges.where((F.col("node_a") == F.lit(target)) | (F.col("node_b") == F.lit(target)))
    return rows.select(F.when(F.col("node_a") == F.lit(target), F.col("node_b")).otherwise(F.col("node_a")).alias("node"), "p")


def path_invariants(paths: DataFrame, edges: DataFrame, start, target, max_hops: int) -> DataFrame:
    """One row of counts, all zero if ranked paths (rank, nodes, cost) are sound."""
    order = Window.orderBy("rank")
    steps = paths.select("rank", F.posexplode(F.arrays_zip(F.expr("slice(nodes, 1, size(nodes) - 1)").alias("src"), F.expr("slice(nodes, 2, size(nodes) - 1)").alias("dst"))).alias("i", "e")).select("rank", "e.src", "e.dst")
    products = steps.join(edges.select("src", "dst", "p"), ["src", "dst"], "left").groupBy("rank").agg(F.sum(-F.ln("p")).alias("sum"), F.count_if(F.col("p").isNull()).alias("missing"))
    rows = paths.join(products, "rank").withColumn("before", F.lag("cost").over(order))  # k paths
    return rows.agg(
        F.count_if(F.element_at("nodes", 1) != F.lit(start)).alias("bad_start"), F.count_if(F.element_at("nodes", -1) != F.lit(target)).alias("bad_target"),
        F.count_if(F.size(F.array_distinct("nodes")) != F.size("nodes")).alias("loops"), F.count_if(F.size("nodes") - 1 > max_hops).alias("too_long"),
        F.count_if(F.col("before") > F.col("cost") + 1e-12).alias("out_of_order"), F.count_if(F.abs(F.col("sum") - F.col("cost")) > 1e-9).alias("wrong_cost"), F.sum("missing").alias("missing_edges"),
        (F.count(F.lit(1)) - F.count_distinct("nodes")).alias("repeated"),
    )


def live_scores(frontier: DataFrame, integrated: DataFrame, cached: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """The factor that counts (integrated, then cached, then live), where it is from, and its effect."""
    take = lambda df, name: df.select(*keys, F.col("bayes_factor").alias(name))
    r = frontier.join(take(integrated, "i"), keys, "left").join(take(cached, "c"), keys, "left").join(take(live, "l"), keys, "left")
    factor = F.coalesce("i", "c", "l")
    origin = F.when(F.col("i").isNotNull(), "integrated").when(F.col("c").isNotNull(), "cached").when(F.col("l").isNotNull(), "live").otherwise("none")
    effect = F.when(factor > 1, "supports").when(factor < 1, "refutes").otherwise("neutral")
    return r.select(*keys, factor.alias("factor"), origin.alias("origin"), effect.alias("effect"))


def node_sequences(nodes: DataFrame, proteins: DataFrame) -> DataFrame:
    """(node, accession, sequence, basis): by accession, else by gene name; reviewed first, then the longest, then by accession."""
    one = nodes.where(F.col("accession").isNotNull()).join(proteins, "accession").withColumn("step", F.lit(0)).select("node", "accession", "sequence", "reviewed", "step")
    named = nodes.select("node", F.upper("node").alias("_g")).join(proteins.withColumn("_g", F.upper("gene")), "_g")
    two = named.withColumn("step", F.lit(1)).select("node", "accession", "sequence", "reviewed", "step")
    w = Window.partitionBy("node").orderBy("step", F.desc("reviewed"), F.desc(F.length("sequence")), "accession")
    best = one.unionByName(two).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    found = best.select("node", "accession", "sequence", F.when(F.col("step") == 0, "accession").otherwise("gene").alias("basis"))
    return nodes.select("node").distinct().join(found, "node", "left").withColumn("basis", F.coalesce("basis", F.lit("missing")))
