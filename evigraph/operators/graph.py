"""Directions, bounded paths, reachability and the backward beam search."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions import kernels as K
from evigraph.sources.state import cut

#: Classes of nodes, and the rules source class -> target class.
CLASSES = (
    "receptor receptor_regulator ligand kinase phosphatase cyclase phosphodiesterase phospholipase nos gtpase gtpase_regulator "
    "kinase_phosphatase_binding second_messenger_binding signaling_process signaling_regulation second_messenger adaptor_scaffold"
).split()
RULES = (
    ("ligand_to_receptor", "ligand", "receptor"),
    ("receptor_regulator_to_receptor", "receptor_regulator", "receptor"),
    ("kinase_to_kinase_phosphatase_binding", "kinase", "kinase_phosphatase_binding"),
    ("phosphatase_to_kinase_phosphatase_binding", "phosphatase", "kinase_phosphatase_binding"),
    ("gtpase_regulator_to_gtpase", "gtpase_regulator", "gtpase"),
    ("cyclase_to_second_messenger", "cyclase", "second_messenger"),
    ("phospholipase_to_second_messenger", "phospholipase", "second_messenger"),
    ("nos_to_second_messenger", "nos", "second_messenger"),
    ("phosphodiesterase_to_second_messenger", "phosphodiesterase", "second_messenger"),
    ("second_messenger_to_second_messenger_binding", "second_messenger", "second_messenger_binding"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, source_class string, target_class string")


def class_pair_catalog(spark: SparkSession, rules=RULES, classes=CLASSES) -> DataFrame:
    """Every unordered pair of classes with the rules that orient it: a table of constants."""
    c = spark.createDataFrame([(i, x) for i, x in enumerate(classes)], "i int, c string")
    pairs = c.alias("a").join(c.alias("b"), F.col("a.i") <= F.col("b.i")).select(F.col("a.c").alias("class_a"), F.col("b.c").alias("class_b"))
    r = rule_table(spark, rules)
    met = pairs.join(
        r,
        ((F.col("class_a") == F.col("source_class")) & (F.col("class_b") == F.col("target_class")))
        | ((F.col("class_b") == F.col("source_class")) & (F.col("class_a") == F.col("target_class"))),
        "left",
    )
    return met.groupBy("class_a", "class_b").agg(F.coalesce(F.array_join(F.array_sort(F.collect_set("rule")), ";"), F.lit("")).alias("rules"))


def rule_support(edges: DataFrame, node_classes: DataFrame, rules: DataFrame) -> DataFrame:
    """(node_a, node_b, a_to_b, b_to_a) by rules on the ends' classes (node, class), for edges that some rule touches."""
    ca = node_classes.select(F.col("node").alias("node_a"), F.col("class").alias("class_a"))
    cb = node_classes.select(F.col("node").alias("node_b"), F.col("class").alias("class_b"))
    r = F.broadcast(rules)  # the rules are constants
    rows = edges.select("node_a", "node_b").join(ca, "node_a").join(cb, "node_b")
    forth = rows.join(r, (F.col("class_a") == F.col("source_class")) & (F.col("class_b") == F.col("target_class"))).select("node_a", "node_b", F.lit(True).alias("f"), "rule")
    back = rows.join(r, (F.col("class_b") == F.col("source_class")) & (F.col("class_a") == F.col("target_class"))).select("node_a", "node_b", F.lit(False).alias("f"), "rule")
    return forth.unionByName(back).groupBy("node_a", "node_b").agg(
        F.bool_or("f").alias("a_to_b"), F.bool_or(~F.col("f")).alias("b_to_a"), F.array_join(F.array_sort(F.collect_set("rule")), ";").alias("rules")
    )


def record_support(records: DataFrame) -> DataFrame:
    """(source, target) rows -> support of either direction for the unordered pair."""
    rows = records.where("source != target")
    return rows.groupBy(F.least("source", "target").alias("node_a"), F.greatest("source", "target").alias("node_b")).agg(
        F.bool_or(F.col("source") < F.col("target")).alias("a_to_b"), F.bool_or(F.col("source") > F.col("target")).alias("b_to_a"), F.count(F.lit(1)).alias("records")
    )


def resolve_directions(edges: DataFrame, by_rule: DataFrame, by_record: DataFrame) -> DataFrame:
    """A unique rule direction holds; else a unique recorded one; else both ways stay open."""
    r = by_rule.select("node_a", "node_b", F.col("a_to_b").alias("r_ab"), F.col("b_to_a").alias("r_ba"))
    d = by_record.select("node_a", "node_b", F.col("a_to_b").alias("d_ab"), F.col("b_to_a").alias("d_ba"))
    rows = edges.join(r, ["node_a", "node_b"], "left").join(d, ["node_a", "node_b"], "left").na.fill(False, ["r_ab", "r_ba", "d_ab", "d_ba"])
    rule_one, record_one = F.col("r_ab") != F.col("r_ba"), F.col("d_ab") != F.col("d_ba")
    forth = F.when(rule_one, F.col("r_ab")).when(record_one, F.col("d_ab")).otherwise(F.lit(True))
    back = F.when(rule_one, F.col("r_ba")).when(record_one, F.col("d_ba")).otherwise(F.lit(True))
    agree = record_one & (F.col("r_ab") == F.col("d_ab"))
    by = F.when(rule_one & agree, "rule+record").when(rule_one, "rule").when(record_one, "record").when(F.col("r_ab") | F.col("d_ab"), "conflict").otherwise("none")
    return rows.select("node_a", "node_b", "p", forth.alias("a_to_b"), back.alias("b_to_a"), by.alias("basis"))


def directed_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, p): one row if oriented, two if open."""
    both = resolved.select(F.explode(F.array(F.struct(F.col("node_a").alias("src"), F.col("node_b").alias("dst"), "p", F.col("a_to_b").alias("ok")), F.struct(F.col("node_b").alias("src"), F.col("node_a").alias("dst"), "p", F.col("b_to_a").alias("ok")))).alias("e"))
    return both.select("e.*").where("ok").drop("ok")


def costs(edges: DataFrame, cutoff: float) -> DataFrame:
    """(src, dst, p, cost): -ln p of the edges above the cutoff, strictly."""
    return edges.where(F.col("p") > cutoff).select("src", "dst", "p", (-F.ln("p")).alias("cost"))


def hop_costs(edges: DataFrame, start, target, max_hops: int) -> DataFrame:
    """(side, node, costs): least cost of a walk from the start (side 0) or to the target (side 1) in at most 0, 1, ... steps.

    Both sides go in one min-join a step; a step's table has two rows a node at most,
    and is written: its size is known then, so a small one is broadcast to the arcs.
    """
    out, back = F.struct(F.lit(0).alias("side"), F.col("src").alias("node"), F.col("dst").alias("to")), F.struct(F.lit(1).alias("side"), F.col("dst").alias("node"), F.col("src").alias("to"))
    arcs = edges.select(F.explode(F.array(out, back)).alias("e"), "cost").select("e.side", "e.node", "e.to", "cost")
    return _hop_costs(cut(arcs, "arcs"), start, target, max_hops)


def _hop_costs(arcs: DataFrame, start, target, max_hops: int) -> DataFrame:
    spark, kind = arcs.sparkSession, arcs.schema["to"].dataType.simpleString()
    now = spark.createDataFrame([(0, start, 0.0), (1, target, 0.0)], f"side int, node {kind}, cost double")
    levels = [now]
    for _ in range(max_hops):
        reached = arcs.join(now.withColumnRenamed("cost", "so_far"), ["side", "node"]).select("side", F.col("to").alias("node"), (F.col("so_far") + F.col("cost")).alias("cost"))
        now = cut(reached.unionByName(now).groupBy("side", "node").agg(F.min("cost").alias("cost")), "hops")
        levels.append(now)
    rows = functools.reduce(DataFrame.unionByName, [level.withColumn("hop", F.lit(i)) for i, level in enumerate(levels)])
    never = F.lit(float("inf"))
    at = [F.coalesce(F.min(F.when(F.col("hop") == i, F.col("cost"))), never) for i in range(max_hops + 1)]
    return cut(rows.groupBy("side", "node").agg(F.array(*at).alias("costs")), "hops")


def top_paths(edges: DataFrame, start, target, k: int, max_hops: int, allowed: DataFrame | None = None, bans: DataFrame | None = None) -> DataFrame:
    """The k cheapest loopless paths of at most ``max_hops`` steps: (cost, nodes, hops), exact; ties by their nodes.

    The search goes from both ends and meets in the middle.  Least costs of walks
    by number of steps, from the start and to the target, give every edge the cost
    of the cheapest walk over it.  The (k * max_hops)-th of these is at least the cost
    of the k-th walk, since a walk has max_hops edges at most; as a first bound it
    leaves the few edges that such walks use.  Partial paths of half the steps
    grow from both ends over these edges, as long as their cost and the least cost of
    the rest are within the bound, and are joined where they meet.  If loops leave fewer
    than k paths below it, four times as many edges give the next one.  Once the bound lets all edges through that lie on any walk between
    the ends, the short paths lower it before the join, and all paths are found, be
    they fewer than k.

    ``edges``: (src, dst, cost).  ``allowed``: nodes that may lie between.
    ``bans``: (src, dst) steps that must not be taken.
    """
    edges = edges.where(F.col("src") != F.col("dst")).select("src", "dst", "cost")
    spark, kind = edges.sparkSession, edges.schema["dst"].dataType.simpleString()
    if bans is not None:
        edges = edges.join(bans.select("src", "dst"), ["src", "dst"], "left_anti")
    if allowed is not None:
        ends = allowed.select("node").unionByName(spark.createDataFrame([(start,), (target,)], f"node {kind}")).distinct()
        edges = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    shape = f"nodes array<{kind}>, cost double, hops int"
    if start == target or max_hops < 1:
        return spark.createDataFrame([([start], 0.0, 0)] if start == target and max_hops >= 0 else [], shape)
    once = edges.groupBy("src", "dst").agg(F.min("cost").alias("cost")).where((F.col("src") != F.lit(target)) & (F.col("dst") != F.lit(start)))
    ends = [F.struct(F.lit(side).alias("side"), F.col(a).alias("node"), F.col(b).alias("to")) for side, a, b in ((0, "src", "dst"), (1, "dst", "src"))]
    arcs = cut(once.select(F.explode(F.array(*ends)).alias("e"), "cost").select("e.side", "e.node", "e.to", "cost"), "arcs")
    steps = arcs.where("side = 0").select(F.col("node").alias("src"), F.col("to").alias("dst"), "cost")
    best = _hop_costs(arcs, start, target, max_hops - 1)
    before = best.where("side = 0").select(F.col("node").alias("src"), F.col("costs").alias("before"))
    after = best.where("side = 1").select(F.col("node").alias("dst"), F.col("costs").alias("after"))
    # in i steps to the edge and in the steps that are left from it
    through = F.array_min(F.zip_with("before", F.reverse("after"), lambda x, y: x + y)) + F.col("cost")
    valued = cut(steps.join(before, "src").join(after, "dst").select("src", "dst", "cost", "before", "after", through.alias("through")).where(F.col("through") < float("inf")), "valued")
    wanted = k * max_hops
    while True:
        lowest = [r["through"] for r in valued.select("through").orderBy("through").limit(wanted).collect()]  # so many numbers
        bound = lowest[-1] if len(lowest) == wanted else float("inf")
        found = _within(valued.where(F.col("through") <= bound + SLACK), start, target, max_hops, k, bound).collect()  # k rows at most
        if bound == float("inf") or len(found) >= k:
            return spark.createDataFrame([(r["nodes"], r["cost"], r["hops"]) for r in found], shape)
        wanted *= 4


#: Room for sums of costs in another order.
SLACK = 1e-9


def _within(live: DataFrame, start, target, max_hops: int, k: int, bound: float) -> DataFrame:
    """The k cheapest paths over these edges that cost no more than the bound."""
    spark, kind = live.sparkSession, live.schema["dst"].dataType.simpleString()
    forth = live.select(F.lit(0).alias("side"), F.col("src").alias("node"), F.col("dst").alias("to"), F.col("cost").alias("step"), F.col("after").alias("rest"))
    back = live.select(F.lit(1).alias("side"), F.col("dst").alias("node"), F.col("src").alias("to"), F.col("cost").alias("step"), F.col("before").alias("rest"))
    arcs = forth.unionByName(back)
    half = -(-max_hops // 2)
    now = spark.createDataFrame([(0, start, [start], [], 0.0), (1, target, [target], [], 0.0)], f"side int, node {kind}, nodes array<{kind}>, costs array<double>, cost double")
    whole, parts = [], []
    for hop in range(1, half + 1):
        # the rest has max_hops - hop steps at most
        grown = now.join(arcs, ["side", "node"]).where(~F.array_contains("nodes", F.col("to")) & (F.col("cost") + F.col("step") + F.col("rest")[max_hops - hop] <= bound + SLACK))
        now = cut(grown.select("side", F.col("to").alias("node"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("costs", F.array("step")).alias("costs"), (F.col("cost") + F.col("step")).alias("cost")), "parts")
        done = now.where((F.col("side") == 0) & (F.col("node") == F.lit(target)))
        whole.append(done.select("nodes", "costs"))
        now = now.where(((F.col("side") == 0) & (F.col("node") != F.lit(target))) | ((F.col("side") == 1) & (F.col("node") != F.lit(start))))
        if hop <= max_hops - half:
            parts.append(now.where("side = 1").select("node", F.col("nodes").alias("tail"), F.col("costs").alias("tail_costs"), F.col("cost").alias("tail_cost")))
    short = functools.reduce(DataFrame.unionByName, whole)
    if parts:
        # where nothing bounds the search yet, the short paths may
        kth = [] if bound < float("inf") else [r["c"] for r in short.select(F.aggregate("costs", F.lit(0.0), lambda a, c: a + c).alias("c")).orderBy("c").limit(k).collect()]  # k numbers
        bound = min(bound, kth[-1]) if len(kth) == k else bound
        met = now.where("side = 0").join(functools.reduce(DataFrame.unionByName, parts), "node").where(F.col("cost") + F.col("tail_cost") <= bound + SLACK)
        # they share the node where they meet, and no other
        met = met.where(F.size(F.array_intersect("nodes", "tail")) == 1)
        rest = F.reverse(F.slice("tail", F.lit(1), F.size("tail") - 1))
        short = short.unionByName(met.select(F.concat("nodes", rest).alias("nodes"), F.concat("costs", F.reverse("tail_costs")).alias("costs")))
    # costs add up from the start, however the halves met
    rows = short.select("nodes", F.aggregate("costs", F.lit(0.0), lambda a, c: a + c).alias("cost"), (F.size("nodes") - 1).alias("hops"))
    return rows.orderBy("cost", "nodes").limit(k)


def shared_group_paths(rows: DataFrame, group: str, member: str, cost: Callable[[Column, Column, Column], Column], start, target, k: int, max_hops: int, least: float = 0.0, width: int = 64) -> DataFrame:
    """As ``top_paths``, on the graph whose edges are the pairs of members that share a group, without making these edges: (cost, nodes, hops), exact.

    ``cost`` (lower end, higher end, number of shared groups) mustn't rise with that
    number; ``least``: no edge costs less.  Partial paths grow from both ends
    through the groups of their last node.  A step is weighed at first as if all of
    that node's groups were shared, so only what can still be within the bound is counted.
    The bound is the cost of the k-th path of up to three steps over the ``width``
    cheapest first steps, or over more where these give fewer than k.  What a partial path
    still needs is an edge to the other end, or the cheapest of those and one more.
    """
    m = rows.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g IS NOT NULL AND m IS NOT NULL").distinct()
    m = cut(m.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("m"))), "members")
    spark, kind = m.sparkSession, m.schema["m"].dataType.simpleString()
    shape = f"nodes array<{kind}>, cost double, hops int"
    if start == target or max_hops < 1:
        return spark.createDataFrame([([start], 0.0, 0)] if start == target and max_hops >= 0 else [], shape)
    edge = lambda n: cost(F.least("node", "to"), F.greatest("node", "to"), n)
    ends = F.when(F.col("side") == 0, F.lit(start)).otherwise(F.lit(target)), F.when(F.col("side") == 0, F.lit(target)).otherwise(F.lit(start))

    def grown(front: DataFrame, bound: float, rest: DataFrame | None = None, enough: Column | None = None) -> DataFrame:
        """Partial paths (side, node, nodes, costs, cost) one step longer; ``rest`` (side, to, near) and ``enough`` say what they still need."""
        asked = cut(front.join(m.select(F.col("m").alias("node"), "g", "many"), "node"), "asked")
        met = asked.join(m.select("g", F.col("m").alias("to")), "g")
        needs = F.lit(0.0)
        if rest is not None:
            met, needs = met.join(rest, ["side", "to"], "left"), F.coalesce("near", enough)
        met = met.where((F.col("cost") + edge(F.col("many")) + needs <= bound + SLACK) & ~F.array_contains("nodes", F.col("to")))
        counted = met.groupBy("side", "node", "nodes", "costs", "cost", "to", needs.alias("needs")).agg(F.count(F.lit(1)).alias("n"))
        step = counted.withColumn("step", edge(F.col("n"))).where(F.col("cost") + F.col("step") + F.col("needs") <= bound + SLACK)
        return step.select("side", F.col("to").alias("node"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("costs", F.array("step")).alias("costs"), (F.col("cost") + F.col("step")).alias("cost"))

    def joined(forth: DataFrame, back: DataFrame, bound: float) -> DataFrame:
        """(nodes, costs) of whole paths: they share the node where they meet, and no other."""
        tails = back.select("node", F.col("nodes").alias("tail"), F.col("costs").alias("tail_costs"), F.col("cost").alias("tail_cost"))
        met = forth.join(tails, "node").where((F.col("cost") + F.col("tail_cost") <= bound + SLACK) & (F.size(F.array_intersect("nodes", "tail")) == 1))
        rest = F.reverse(F.slice("tail", F.lit(1), F.size("tail") - 1))
        return met.select(F.concat("nodes", rest).alias("nodes"), F.concat("costs", F.reverse("tail_costs")).alias("costs"))

    def cheapest(parts: list[DataFrame]) -> list:
        # costs add up from the start, however the halves met
        whole = functools.reduce(DataFrame.unionByName, parts)
        added = whole.select("nodes", F.aggregate("costs", F.lit(0.0), lambda a, c: a + c).alias("cost"), (F.size("nodes") - 1).alias("hops"))
        return added.orderBy("cost", "nodes").limit(k).collect()  # k rows

    none = spark.createDataFrame([(0, start, [start], [], 0.0), (1, target, [target], [], 0.0)], f"side int, node {kind}, nodes array<{kind}>, costs array<double>, cost double")
    first = cut(grown(none, float("inf")), "parts")
    direct, first = first.where((F.col("side") == 0) & (F.col("node") == F.lit(target))).select("nodes", "costs"), first.where(F.col("node") != ends[1])
    low = {r["side"]: (r["low"], r["n"]) for r in first.groupBy("side").agg(F.min("cost").alias("low"), F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(low) < 2 or max_hops == 1:
        return spark.createDataFrame([tuple(r) for r in cheapest([direct])], shape)
    forth, back = (first.where(F.col("side") == side) for side in (0, 1))
    whole, bound = [direct, joined(forth, back, float("inf"))], float("inf")
    other = F.when(F.col("side") == 0, low[1][0]).otherwise(low[0][0])
    while True:
        tried = [joined(grown(forth.orderBy("cost", "node").limit(width), bound).where(F.col("node") != F.lit(target)), back, bound)] if max_hops > 2 else []
        found = cheapest(whole + tried)
        if len(found) == k or not tried or width >= low[0][1]:
            bound = found[-1]["cost"] if len(found) == k else bound
            break
        width *= 8
    if max_hops == 2:
        return spark.createDataFrame([tuple(r) for r in found], shape)
    # an edge to the other end that is cheaper than the cheapest one and a step to it
    near = first.where(F.col("cost") < least + F.when(F.col("side") == 0, low[0][0]).otherwise(low[1][0])).select((1 - F.col("side")).alias("side"), F.col("node").alias("to"), F.col("cost").alias("near"))
    half = -(-max_hops // 2)
    now, tails = first, [back]
    for hop in range(2, half + 1):
        going = now if hop <= max_hops - half else now.where("side = 0")
        going = going.where(F.col("cost") + least + other <= bound + SLACK)
        now = cut(grown(going, bound, near, other + least).where((F.col("node") != ends[0]) & (F.col("node") != ends[1])), "parts")
        if hop < half:
            whole.append(joined(now.where("side = 0"), back, bound))
        if hop <= max_hops - half:
            tails.append(now.where("side = 1"))
    whole += [joined(now.where("side = 0"), tail, bound) for tail in tails]
    return spark.createDataFrame([tuple(r) for r in cheapest(whole)], shape)


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(rank, step, src, dst, p) of ranked paths."""
    rows = paths.select("rank", F.posexplode(F.arrays_zip(F.expr("slice(nodes, 1, size(nodes) - 1)").alias("src"), F.expr("slice(nodes, 2, size(nodes) - 1)").alias("dst"))).alias("step", "e"))
    return rows.select("rank", "step", "e.src", "e.dst").join(edges.select("src", "dst", "p"), ["src", "dst"])


def network(paths: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ranked paths (rank, nodes) are made of: (node, paths, mean_position, best_rank) and (src, dst, p, paths, best_rank)."""
    nodes = paths.select("rank", F.posexplode("nodes").alias("pos", "node")).groupBy("node").agg(F.count(F.lit(1)).alias("paths"), F.avg("pos").alias("mean_position"), F.min("rank").alias("best_rank"))
    used = path_edges(paths, edges).groupBy("src", "dst").agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("paths"), F.min("rank").alias("best_rank"))
    return nodes, used


def network_payload(paths: DataFrame, edges: DataFrame, start, target) -> DataFrame:
    """One row of JSON for a view: the paths, their nodes (with a role) and edges, those of the best paths first. Its size is that of k paths."""
    nodes, used = network(paths, edges)
    role = F.when(F.col("node") == F.lit(start), "start").when(F.col("node") == F.lit(target), "target").otherwise("between")
    listed = lambda rows, *order: rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*rows.columns).alias("row")))), lambda x: x["row"]).alias("all"))
    a = listed(nodes.withColumn("role", role), "best_rank", "mean_position", "node").withColumnRenamed("all", "nodes")
    b = listed(used, "best_rank", "src", "dst").withColumnRenamed("all", "edges")
    c = listed(paths.select("rank", "nodes", "cost", F.exp(-F.col("cost")).alias("product")), "rank").withColumnRenamed("all", "paths")
    return a.join(F.broadcast(b)).join(F.broadcast(c)).select(F.to_json(F.struct("paths", "nodes", "edges")).alias("payload"))  # one row each


def reachable(edges: DataFrame, start, max_rounds: int = 64) -> DataFrame:
    """(node, hops) of everything that can be reached: breadth first, until nothing is new."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], f"node {edges.schema['dst'].dataType.simpleString()}, hops int")
    edge, front = cut(edges.select("src", "dst").distinct(), "reach"), seen
    for hop in range(1, max_rounds + 1):
        fresh = front.select(F.col("node").alias("src")).join(edge, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hop))
        front = cut(fresh, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", max_rounds: int = 64) -> DataFrame:
    """(node, ancestor, distance): transitive closure of a DAG with least distances.

    Nodes with the same parents have the same ancestors, so the search runs once a class
    of such nodes, over classes; classes become nodes in the last join.
    """
    held = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.array_sort(F.collect_set(parent)).alias("parents"))
    held = cut(held, "parents")
    classes = cut(held.groupBy("parents").agg(F.min("node").alias("class")), "classes")
    members = cut(held.join(classes, "parents").select("node", "class"), "members")
    up = classes.select("class", F.explode("parents").alias("ancestor"))
    links = cut(up.join(members.toDF("ancestor", "via"), "ancestor").select("class", "via").distinct(), "links")
    seen = front = classes.select("class", F.col("class").alias("via"), F.lit(0).alias("hops"))
    for hop in range(1, max_rounds):
        nxt = front.select("class", "via").join(links.toDF("via", "next"), "via").select("class", F.col("next").alias("via")).distinct()
        front = cut(nxt.join(seen, ["class", "via"], "left_anti").withColumn("hops", F.lit(hop)), "closure")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % 8 == 0:
            seen = cut(seen, "closure")  # one table again
    reached = seen.join(up.withColumnRenamed("class", "via"), "via").groupBy("class", "ancestor").agg((F.min("hops") + 1).alias("distance"))
    return members.join(reached, "class").select("node", "ancestor", "distance")


def nearest_ancestors(edges: DataFrame, anchors: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, anchor, distance): of the anchors (anchor) among a node's ancestors in a DAG (child, parent) the nearest, the least of them on a tie.

    A label spreads from the anchors' children downwards, a row a node, so no closure
    of all ancestors is made; a node is labelled in one round only.
    """
    down = cut(edges.select(F.col("parent").alias("node"), "child").distinct(), "links")
    return _nearest(lambda front: down.join(front, "node").groupBy(F.col("child").alias("node")).agg(F.min("anchor").alias("anchor")), anchors, max_rounds)


def nearest_by_groups(children: DataFrame, parents: DataFrame, anchors: DataFrame, max_rounds: int = 64) -> DataFrame:
    """As ``nearest_ancestors``, where the children (child, group) of a group have all its parents (parent, group): labels go through the groups, so links aren't made."""
    up = cut(parents.select(F.col("parent").alias("node"), "group").where("group IS NOT NULL").distinct(), "parents")
    down = cut(children.select("child", "group").where("group IS NOT NULL").distinct(), "children")

    def step(front: DataFrame) -> DataFrame:
        labelled = up.join(front, "node").groupBy("group").agg(F.min("anchor").alias("anchor"))
        return down.join(labelled, "group").groupBy(F.col("child").alias("node")).agg(F.min("anchor").alias("anchor"))

    return _nearest(step, anchors, max_rounds)


def _nearest(step: Callable[[DataFrame], DataFrame], anchors: DataFrame, max_rounds: int) -> DataFrame:
    """``step``: labels (node, anchor) of the last round's nodes -> those of their children."""
    first = anchors.select(F.col("anchor").alias("node"), "anchor").distinct()
    seen, front = None, first
    for distance in range(1, max_rounds + 1):
        reached = step(front)
        fresh = reached if seen is None else reached.join(seen.select("node"), "node", "left_anti")
        front = cut(fresh.withColumn("distance", F.lit(distance)), "anchors")
        if seen is not None and front.isEmpty():
            break
        seen, front = front if seen is None else seen.unionByName(front), front.select("node", "anchor")
    return seen


def shortlist(frontier: DataFrame, edges: DataFrame, receptor: DataFrame, prior: float, top_n: int) -> DataFrame:
    """Candidates of every beam path: no loops, the top n by cheap posterior, receptors always."""
    grown = frontier.withColumn("child", F.element_at("nodes", -1)).join(edges.select(F.col("dst").alias("child"), F.col("src").alias("candidate"), "log_bf"), "child")
    grown = grown.where(~F.array_contains("nodes", F.col("candidate")))
    grown = grown.withColumn("cheap", K.expit(K.logit(F.lit(prior)) + F.col("log_bf")))
    w = Window.partitionBy("path_id").orderBy(F.desc("cheap"), "candidate")
    ranked = grown.withColumn("cheap_rank", F.row_number().over(w))
    flagged = ranked.join(receptor.select(F.col("node").alias("candidate"), F.lit(True).alias("is_receptor")), "candidate", "left").withColumn("is_receptor", F.coalesce("is_receptor", F.lit(False)))
    return flagged.where((F.col("cheap_rank") <= top_n) | F.col("is_receptor"))


def beam(candidates: DataFrame, score: str, width: int) -> DataFrame:
    """The best row of each candidate, then the best ``width`` of these."""
    order = [F.desc(score), F.col("path_id"), F.col("candidate")]
    once = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("candidate").orderBy(*order))).where("_n = 1").drop("_n")
    return once.orderBy(*order).limit(width)


def backward_search(edges: DataFrame, target, receptor: DataFrame, prior: float = 0.5, top_n: int = 20, width: int = 5, depth: int = 6, structural: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Beam search from the target against the edges; (solutions, why it stopped).

    ``edges``: (src, dst, log_bf); ``structural``: (node_a, node_b, log_bf) added
    where known.  Receptors found leave the beam as solutions.  A beam has
    ``width`` rows, which are written after every round.
    """
    spark = edges.sparkSession
    kind = edges.schema["dst"].dataType.simpleString()
    front = spark.createDataFrame([("0", [target], 0.0)], f"path_id string, nodes array<{kind}>, log_p double")
    solutions: DataFrame | None = None
    for round_ in range(depth):
        listed = shortlist(front, edges, receptor, prior, top_n)
        if structural is not None:
            s = structural.select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"), F.col("log_bf").alias("s_bf"))
            listed = listed.withColumn("node_a", F.least("child", "candidate")).withColumn("node_b", F.greatest("child", "candidate")).join(s, ["node_a", "node_b"], "left")
            listed = listed.withColumn("log_bf", F.col("log_bf") + F.coalesce("s_bf", F.lit(0.0)))
        scored = listed.withColumn("score", F.col("log_p") + F.ln(K.expit(K.logit(F.lit(prior)) + F.col("log_bf"))))
        kept = beam(scored, "score", width)
        now = cut(kept.select(F.concat_ws(".", "path_id", F.col("candidate").cast("string")).alias("path_id"), F.concat("nodes", F.array("candidate")).alias("nodes"), F.col("score").alias("log_p"), "is_receptor"), "beam")
        found = now.where("is_receptor").drop("is_receptor").withColumn("round", F.lit(round_))
        solutions = found if solutions is None else solutions.unionByName(found)
        front = now.where("not is_receptor").drop("is_receptor")
        if not found.isEmpty():
            return solutions, "receptor_reached"
        if front.isEmpty():
            return solutions, "frontier_exhausted"
    return solutions, "maximum_depth_reached"
