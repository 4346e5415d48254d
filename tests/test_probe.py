"""Rounds that wait for scores: late, repeated and missing ones, and a restart."""

import datetime
import math

import pandas as pd
from pyspark.sql import functions as F

from evigraph.operators import development as D
from evigraph.streaming import probe

ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def request(round_, expected, path, candidate, a, b, cheap, minute, receptor=False):
    return (round_, expected, path, candidate, a, b, cheap, receptor, "request", None, ZERO + datetime.timedelta(minutes=minute))


def score(a, b, value, minute):
    return (None, None, None, None, a, b, None, None, "score", value, ZERO + datetime.timedelta(minutes=minute))


FILES = [
    [request(1, 3, 1, "B", "A", "B", 0.7, 0), request(1, 3, 1, "C", "A", "C", 0.6, 0), request(1, 3, 2, "B", "D", "B", 0.9, 0), request(2, 1, 1, "Z", "Q", "Z", 0.5, 1)],
    [score("B", "A", 0.9, 5), score("A", "B", 0.3, 5), score("A", "C", 7.0, 5)],
    [score("A", "B", 0.1, 6), score("C", "A", 0.55, 7), request(3, 2, 1, "B", "A", "B", 0.5, 7), request(3, 2, 1, "R", "A", "R", 0.2, 7, True)],
    [score("B", "D", 0.2, 8), score("A", "R", 0.6, 9), score("B", "D", 0.99, 9), request(1, 3, 1, "B", "A", "B", 0.7, 9)],
    [score("x", "y", 0.5, 200)],  # time goes on: round 2 gets no score
    [score("Q", "Z", 0.99, 300), score("x", "y", 0.5, 400)],
]


def run(spark, files, root, stops):
    folder = f"{root}/events"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, probe.EVENT).coalesce(1).write.mode("append").parquet(folder)
        if i in stops:
            probe.resolve(probe.events(spark, folder), f"{root}/resolved", f"{root}/c1", wait=3600).awaitTermination()
            probe.decide(spark, f"{root}/resolved", f"{root}/decided", f"{root}/c2", width=1).awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{root}/decided").collect())


def test_rounds_are_decided_once(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = run(spark, FILES, f"file://{tmp_path}/a", range(len(FILES)))
        again = run(spark, FILES, f"file://{tmp_path}/b", [1, 3, 5])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def up(p, s):
        factor = min(max(s / (1 - s) / 1.5, 0.1), 10.0)
        return p * factor / (p * factor + 1 - p)

    want = {(1, 1, "B"): (up(0.7, 0.9), 0.9, 3, "candidate of a better path"), (1, 1, "C"): (up(0.6, 0.55), 0.55, 2, "below the beam"), (1, 2, "B"): (up(0.9, 0.99), 0.99, 1, "in the beam"), (2, 1, "Z"): (0.5, None, 1, "in the beam")}
    want |= {(3, 1, "B"): (up(0.5, 0.9), 0.9, 1, "in the beam"), (3, 1, "R"): (up(0.2, 0.6), 0.6, 2, "receptor reached")}
    assert len(got) == len(want)
    for round_, path, candidate, _, _, posterior, value, place, decision in got:
        p, s, at, what = want[round_, path, candidate]
        assert math.isclose(posterior, p, abs_tol=1e-12) and (place, decision) == (at, what) and (value is None or math.isnan(value)) == (s is None)
    # stopped elsewhere: files that come together have the better of their scores, the rest is the same
    assert [(r[0], r[1], r[2], r[8]) for r in again] == [(r[0], r[1], r[2], r[8]) for r in got]
    # as the batch stages decide
    rows = spark.createDataFrame([(r[1], r[2], r[3], r[4], r[5], r[2] == "R") for r in got if r[0] == 1], "path_id long, candidate string, node_a string, node_b string, posterior double, receptor boolean")
    assert {(r["path_id"], r["candidate"]): (r["place"], r["decision"]) for r in D.decisions(rows, 1).collect()} == {(r[1], r[2]): (r[7], r[8]) for r in got if r[0] == 1}
    assert spark.read.parquet(f"file://{tmp_path}/a/resolved").where(F.col("score").isNull()).count() == 1


class State:
    """State that counts its calls."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, []

    def getValueState(self, name, schema):
        return State()

    def getListState(self, name, schema):
        self.state = State()
        return self.state

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def update(self, row):
        self.rows = list(row)

    def clear(self):
        self.rows = []

    def appendValue(self, row):
        self.appendList([row])

    def appendList(self, rows):
        self.calls += 1
        self.rows = self.rows + list(rows)

    def registerTimer(self, at):
        self.timers.append(at)


def test_rows_that_come_together_are_one_call_of_the_state():
    rows = pd.DataFrame([request(1, 3000, i, f"c{i}", "A", "B", 0.5, i % 3) for i in range(1500)], columns=[c.split()[0] for c in probe.EVENT.split(", ")])
    handle, waiting = State(), probe._Waiting(1000)
    waiting.init(handle)
    assert list(waiting.handleInputRows(("A", "B"), iter([rows[:700], rows[700:]]), None)) == []
    assert handle.state.calls == 1 and len(handle.state.rows) == 1500 and len(handle.timers) == 3
    handle, rounds = State(), probe._Rounds(5, 0.6, 0.1, 10.0)
    rounds.init(handle)
    assert list(rounds.handleInputRows((1,), iter([rows]), None)) == []
    assert handle.state.calls == 1
    more = rows.assign(path_id=rows["path_id"] + 1500)
    (decided,) = rounds.handleInputRows((1,), iter([more]), None)
    assert len(decided) == 3000 and handle.state.calls == 1 and handle.state.rows == []
