"""The search in six stages, each a table that can be looked at before the next one runs.

candidates -> cheap -> shortlist -> preparation -> structural -> decisions.  A
``Development`` keeps the tables of a round in a state store, one version a
stage, so a run stops and goes on between any two stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import kernels as K
from evigraph.operators.edge_stage import PAIR
from evigraph.operators.evidence import running_posterior
from evigraph.sources.state import StateStore

STAGES = ("candidates", "cheap", "shortlist", "preparation", "structural", "decisions")


def candidates(frontier: DataFrame, pairs: DataFrame, nodes: DataFrame, disallowed: DataFrame) -> DataFrame:
    """(path_id, current, candidate, reason): every neighbour of a path's last node, and why it is left out, if it is.

    ``frontier``: (path_id, nodes); ``pairs``: (node_a, node_b); ``nodes``: (node, eligible); ``disallowed``: (source, target).
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("node_a").alias("current"), F.col("node_b").alias("candidate")), F.struct(F.col("node_b").alias("current"), F.col("node_a").alias("candidate")))).alias("e")).select("e.*").distinct()
    rows = frontier.select("path_id", "nodes", F.element_at("nodes", -1).alias("current")).join(ends, "current")
    rows = rows.join(nodes.select(F.col("node").alias("candidate"), "eligible"), "candidate", "left")
    no = disallowed.select(F.col("source").alias("candidate"), F.col("target").alias("current"), F.lit(True).alias("no"))
    rows = rows.join(no, ["candidate", "current"], "left")
    reason = F.when(F.array_contains("nodes", F.col("candidate")), "on the path").when(F.col("no"), "direction not allowed").when(~F.coalesce("eligible", F.lit(False)), "not eligible")
    return rows.select("path_id", "current", "candidate", reason.alias("reason"))


def cheap_ledger(found: DataFrame, evidence: DataFrame, prior: float) -> DataFrame:
    """(path_id, candidate, node_a, node_b, step, stream, factor, weight, before, after) of the candidates that are in."""
    pair = found.where("reason IS NULL").select("path_id", "candidate", F.least("current", "candidate").alias("node_a"), F.greatest("current", "candidate").alias("node_b"))
    rows = pair.join(evidence.select(*PAIR, "step", "stream", F.col("bayes_factor").alias("factor"), "weight"), PAIR)
    ledger = running_posterior(rows, ["path_id", "candidate"], "step", prior)
    return ledger.select("path_id", "candidate", *PAIR, "step", "stream", "factor", "weight", "before", "after")


def shortlist(ledger: DataFrame, receptors: DataFrame, top_n: int) -> DataFrame:
    """(path_id, candidate, node_a, node_b, cheap, cheap_rank, forced): the best of each path, and receptors whatever their rank."""
    last = ledger.groupBy("path_id", "candidate", *PAIR).agg(F.max_by("after", "step").alias("cheap"))
    ranked = last.withColumn("cheap_rank", F.row_number().over(Window.partitionBy("path_id").orderBy(F.desc("cheap"), "candidate")))
    flagged = ranked.join(receptors.select(F.col("node").alias("candidate"), F.lit(True).alias("receptor")).distinct(), "candidate", "left")
    rows = flagged.withColumn("receptor", F.coalesce("receptor", F.lit(False))).where((F.col("cheap_rank") <= top_n) | F.col("receptor"))
    return rows.select("path_id", "candidate", *PAIR, "cheap", "cheap_rank", (F.col("cheap_rank") > top_n).alias("forced"), "receptor")


def preparation(chosen: DataFrame, cache: DataFrame, protocols: list[str]) -> DataFrame:
    """Adds ``protocol``, ``score`` and ``hit``: the cached score of the first protocol in order that has one."""
    order = F.array_position(F.array(*[F.lit(p) for p in protocols]), F.col("protocol"))
    known = cache.where(F.col("protocol").isin(protocols)).groupBy(*PAIR).agg(F.min_by(F.struct("protocol", "score"), F.struct(order, -F.col("score"))).alias("c"))
    rows = chosen.join(known, PAIR, "left")
    return rows.select(*chosen.columns, "c.protocol", "c.score", F.col("c").isNotNull().alias("hit"))


def structural_ledger(prepared: DataFrame, reference: float, low: float, high: float) -> DataFrame:
    """Adds ``structural_factor`` (1 without a score) and ``posterior``."""
    factor = F.when(F.col("hit"), K.structural_factor(F.col("score"), reference, low, high)).otherwise(F.lit(1.0))
    return prepared.withColumn("structural_factor", factor).withColumn("posterior", K.apply_factor(F.col("cheap"), F.col("structural_factor")))


def decisions(ledger: DataFrame, width: int) -> DataFrame:
    """Adds ``place`` and ``decision``: each candidate counts once, on its best path; receptors end a path, then the beam is filled."""
    order = [F.desc("posterior"), F.col("path_id"), F.col("candidate")]
    rows = ledger.withColumn("nth", F.row_number().over(Window.partitionBy("candidate").orderBy(*order)))
    # a round's shortlist: paths of the beam times candidates each
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("nth") > 1, F.col("receptor"), *order)))
    decision = F.when(F.col("nth") > 1, "candidate of a better path").when(F.col("receptor"), "receptor reached").when(F.col("place") <= width, "in the beam").otherwise("below the beam")
    return rows.withColumn("decision", decision).drop("nth")


def next_frontier(decided: DataFrame, frontier: DataFrame) -> DataFrame:
    """(path_id, nodes, posterior) of the paths in the beam, the candidate put at their end."""
    kept = decided.where("decision = 'in the beam'").join(frontier.select("path_id", "nodes"), "path_id")
    return kept.select(F.col("place").alias("path_id"), F.concat("nodes", F.array("candidate")).alias("nodes"), "posterior")


def payload(decided: DataFrame) -> DataFrame:
    """One row of JSON: the nodes and edges of a round, strongest first, for a view of it."""
    edge = F.to_json(F.struct("node_a", "node_b", F.round("cheap", 6).alias("cheap"), F.round("posterior", 6).alias("posterior"), "decision"))
    edges = decided.select(F.struct(-F.col("posterior"), "path_id", "candidate", edge.alias("json")).alias("e"))  # a round's shortlist
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["json"]), ",")
    return edges.agg(F.concat(F.lit('{"edges":['), listed, F.lit("]}")).alias("payload"), F.count(F.lit(1)).alias("n_edges"))


def run_payload(rounds: list[tuple[int, DataFrame]]) -> DataFrame:
    """One row of JSON of a run so far: the nodes of all rounds, by the first one that has them, and all edges with their round, strongest first.

    A round is a beam's shortlist, so a run is that times the rounds.
    """
    edges = None
    for number, decided in rounds:
        rows = decided.select(F.lit(number).alias("round"), "path_id", "candidate", *PAIR, "cheap", "posterior", "decision")
        edges = rows if edges is None else edges.unionByName(rows)
    ends = edges.select("round", F.explode(F.array(*PAIR)).alias("node"), "posterior").groupBy("node").agg(F.min("round").alias("first_round"), F.max("posterior").alias("best"))
    order = F.struct("round", (-F.col("posterior")).alias("o"), "path_id", "candidate", F.struct(*PAIR, "round", "cheap", "posterior", "decision").alias("row"))
    listed = edges.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["row"]).alias("edges"), F.max("round").alias("last_round"))
    known = ends.agg(F.array_sort(F.collect_list(F.struct("node", "first_round", "best"))).alias("nodes"))
    return listed.join(F.broadcast(known)).select(F.to_json(F.struct("last_round", "nodes", "edges")).alias("payload"))  # one row each


class Development:
    """Runs the stages one by one; ``inputs`` are tables by name, read anew for every stage."""

    def __init__(self, store: StateStore, inputs: Callable[[str], DataFrame], prior: float = 0.5, top_n: int = 20, width: int = 5, protocols: list[str] | None = None, reference: float = 0.6, bounds: tuple[float, float] = (0.1, 10.0)):
        self.store, self.inputs, self.prior, self.top_n, self.width = store, inputs, prior, top_n, width
        self.protocols, self.reference, self.bounds = protocols or [], reference, bounds

    def done(self, round_: int) -> list[str]:
        return [s for s in STAGES if self.store.version(f"round-{round_}-{s}")]

    def table(self, round_: int, stage: str) -> DataFrame:
        return self.store.read(f"round-{round_}-{stage}")

    def payload(self, last: int) -> DataFrame:
        """The run's payload over the rounds up to this one that are decided."""
        return run_payload([(r, self.table(r, "decisions")) for r in range(last + 1) if "decisions" in self.done(r)])

    def step(self, round_: int, frontier: DataFrame) -> str | None:
        """Runs the next stage of the round and returns its name; None if all are there."""
        done = self.done(round_)
        if len(done) == len(STAGES):
            return None
        stage, of = STAGES[len(done)], lambda name: self.table(round_, name)
        if stage == "candidates":
            out = candidates(frontier, self.inputs("pairs"), self.inputs("nodes"), self.inputs("disallowed"))
        elif stage == "cheap":
            out = cheap_ledger(of("candidates"), self.inputs("evidence"), self.prior)
        elif stage == "shortlist":
            out = shortlist(of("cheap"), self.inputs("receptors"), self.top_n)
        elif stage == "preparation":
            out = preparation(of("shortlist"), self.inputs("cache"), self.protocols)
        elif stage == "structural":
            out = structural_ledger(of("preparation"), self.reference, *self.bounds)
        else:
            out = decisions(of("structural"), self.width)
        self.store.replace(f"round-{round_}-{stage}", out)
        return stage
