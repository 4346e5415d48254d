"""Rounds of the search that wait for structural scores, as two streams that keep state.

``resolve`` is keyed by pair.  It holds the shortlisted candidates that wait for
their pair's score and hands each on once: when a score arrives, at once if one is
there already, or without a score when its time is up.  ``decide`` is keyed by
round.  It holds what has been resolved until the round's last candidate is there,
and then emits the round's decisions.  A round has beam x shortlist rows.

A decision once made stands: scores that come again, later or for rounds that are
over change nothing.  Both streams go on from their checkpoints, with what they
held; the table between them is written exactly once.  Time is that of the events,
so a run that is stopped and started again decides as one that isn't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REQUEST = "round long, expected long, path_id long, candidate string, node_a string, node_b string, cheap double, receptor boolean"
EVENT = f"{REQUEST}, kind string, score double, at timestamp"
RESOLVED = f"{REQUEST}, score double, at timestamp"
DECIDED = "round long, path_id long, candidate string, node_a string, node_b string, posterior double, score double, place int, decision string"
COLUMNS = [c.split()[0] for c in REQUEST.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Requests (kind ``request``) and scores (kind ``score``) from files; pairs in canonical order, scores outside [0, 1] left out."""
    rows = spark.readStream.schema(EVENT).parquet(folder)
    ok = (F.col("kind") == "request") | ((F.col("kind") == "score") & F.col("score").between(0, 1))
    ends = {"node_a": F.least("node_a", "node_b"), "node_b": F.greatest("node_a", "node_b")}
    return rows.where(ok & F.col("at").isNotNull() & F.col("node_a").isNotNull() & F.col("node_b").isNotNull()).withColumns(ends)


class _Waiting(StatefulProcessor):
    """State of a pair: its best score so far and the requests that wait for one."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.score = handle.getValueState("score", "score double")
        self.waiting = handle.getListState("waiting", "round long, expected long, path_id long, candidate string, cheap double, receptor boolean, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        scores = batch.loc[batch["kind"] == "score", "score"]
        known = self.score.get()[0] if self.score.exists() else None
        if known is None and len(scores):
            known = float(scores.max())  # of those that arrive together the best counts
            self.score.update((known,))
        asked = [
            (int(r.round), int(r.expected), int(r.path_id), r.candidate, float(r.cheap), bool(r.receptor), int(r.at.value // 1_000_000))
            for r in batch[batch["kind"] == "request"].itertuples()
        ]
        if known is None:
            # one call for all of them, and a timer for each time
            if asked:
                self.waiting.appendList(asked)
            for at in sorted({request[-1] for request in asked}):
                self.handle.registerTimer(at + self.wait_ms)
            return
        held = list(self.waiting.get()) if self.waiting.exists() else []
        self.waiting.clear()
        yield self.rows(key, [tuple(h) for h in held] + asked, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(h) for h in self.waiting.get()] if self.waiting.exists() else []
        due = expiredTimerInfo.getExpiryTimeInMs()
        over = [h for h in held if h[-1] + self.wait_ms <= due]
        if over:
            left = [h for h in held if h[-1] + self.wait_ms > due]
            self.waiting.clear()
            if left:
                self.waiting.put(left)
            yield self.rows(key, over, None)

    @staticmethod
    def rows(key, requests: list[tuple], score: float | None) -> pd.DataFrame:
        out = [(r, n, path, candidate, key[0], key[1], cheap, receptor, score, pd.Timestamp(at, unit="ms")) for r, n, path, candidate, cheap, receptor, at in requests]
        return pd.DataFrame(out, columns=[*COLUMNS, "score", "at"]).astype({"score": "float64"})

    def close(self) -> None:
        pass


class _Rounds(StatefulProcessor):
    """State of a round: what is resolved of it, and whether it is decided."""

    def __init__(self, width: int, reference: float, low: float, high: float):
        self.width, self.reference, self.low, self.high = width, reference, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "path_id long, candidate string, node_a string, node_b string, cheap double, receptor boolean, score double")
        self.over = handle.getValueState("over", "over boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        if self.over.exists():
            return
        fresh = [(int(r.path_id), r.candidate, r.node_a, r.node_b, float(r.cheap), bool(r.receptor), None if pd.isna(r.score) else float(r.score)) for r in batch.itertuples()]
        held = [tuple(h) for h in self.kept.get()] + fresh
        once = {(h[0], h[1]): h for h in reversed(held)}  # a request that was asked twice counts once
        if len(once) >= int(batch["expected"].max()):
            self.over.update((True,))
            self.kept.clear()
            yield self.decisions(int(key[0]), list(once.values()))
        else:
            self.kept.appendList(fresh)

    def decisions(self, round_: int, rows: list[tuple]) -> pd.DataFrame:
        """Each candidate counts on its best path; receptors end a path, then the beam is filled."""
        rated = sorted(((-self.posterior(h[4], h[6]), h[0], h[1], h) for h in rows), key=lambda r: r[:3])
        seen, first, later = set(), [], []
        for row in rated:
            (later if row[2] in seen else first).append(row)
            seen.add(row[2])
        ordered = [r for r in first if not r[3][5]] + [r for r in first if r[3][5]] + sorted((r for r in later), key=lambda r: (r[3][5], *r[:3]))
        out = []
        for place, (minus, path, candidate, h) in enumerate(ordered, 1):
            what = "candidate of a better path" if place > len(first) else "receptor reached" if h[5] else "in the beam" if place <= self.width else "below the beam"
            out.append((round_, path, candidate, h[2], h[3], -minus, h[6], place, what))
        names = [c.split()[0] for c in DECIDED.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"score": "float64", "place": "int32"})

    def posterior(self, cheap: float, score: float | None) -> float:
        if score is None:
            return cheap
        s = min(max(score, 1e-6), 1 - 1e-6)
        factor = min(max(s / (1 - s) / (self.reference / (1 - self.reference)), self.low), self.high)
        p = min(max(cheap, 1e-15), 1 - 1e-15)
        return 1 / (1 + math.exp(-(math.log(p / (1 - p)) + math.log(factor))))

    def close(self) -> None:
        pass


def _started(rows: DataFrame, sink: str, checkpoint: str):
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the setting that it starts with
    try:
        return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def resolve(rows: DataFrame, sink: str, checkpoint: str, wait: int = 86_400, late: str = "0 seconds"):
    """Starts the stream over all events that are there; writes each request once to ``sink`` (RESOLVED). ``wait``: seconds a request waits for a score."""
    waiting = rows.withWatermark("at", late).groupBy("node_a", "node_b")
    return _started(waiting.transformWithStateInPandas(_Waiting(1000 * wait), RESOLVED, "Append", "EventTime"), sink, checkpoint)


def decide(spark: SparkSession, source: str, sink: str, checkpoint: str, width: int = 5, reference: float = 0.6, bounds: tuple[float, float] = (0.1, 10.0)):
    """Starts the stream over what has been resolved; writes a round's decisions to ``sink`` (DECIDED) when its last request is there."""
    rounds = spark.readStream.schema(RESOLVED).parquet(source).groupBy("round")
    return _started(rounds.transformWithStateInPandas(_Rounds(width, reference, *bounds), DECIDED, "Append", "None"), sink, checkpoint)
