"""Ordered funnel counting by a reverse sweep over each client's timestamp groups.

Events are distinct (client, kind, time).  All kinds of one client and time are
one timestamp group, a bit mask.  Every row of a funnel's first kind starts an
attempt; its next step is the client's earliest row of the next kind at a later
time, which is reached unless the wait is over the limit, or an excluded row lies
after the previous step and not after the next; otherwise the attempt ends.

One sweep from the last group to the first keeps, for every step, the place of
its next row and the chain of steps that follows from there, and the place of the
next excluded row.  An attempt looks its outcome up, so it takes constant time.
The sweep is done for all clients of a batch at once, as running minima over
reversed arrays.

A client isn't swept as a whole.  Its time is cut into slots, and tasks get
(client, slot) groups.  An attempt that runs out of its slot enters the next one
at the first row of some kind there, goes on along that slot's own chains, and so
on.  So a first pass picks from each slot the rows that such chains can touch: a
number that depends on the funnels alone, not on the rows.  They are sent to the
slots before it, as far back as an attempt can last; a second pass sweeps each
slot with the rows that it was sent.  Slots are as wide as the longest attempt,
or narrower, halved until the fullest holds SLOT_ROWS groups or LEAST_SLOT is
reached, so that no task grows with the input however dense a client is.

The waits' percentiles are exact.  Waits are counted by second, a group's
cumulative counts (one for each second of the limit at most) give the second
that holds the percentile, and only that second's waits are counted by
microsecond.

Defined cases: rows with a null client, kind or time are left out, and so are
kinds that no funnel names; repeated rows count once; rows of one time are no
steps of each other; a client without a first step has no row; text columns
aren't read, so their length doesn't matter; an empty table gives an empty
result; extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from evigraph.llm.common import Tables

MINUTE = 60_000_000
SLOT_ROWS = 1 << 20
LEAST_SLOT = 1_000_000
SECOND = 1_000_000


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluded: str


def micros(frame: DataFrame, column: str) -> Column:
    """Microseconds since 1970; times without a zone are taken as they stand, whatever the session's zone is."""
    if isinstance(frame.schema[column].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(column)


def whole_div(value: str, by: int) -> Column:
    """Division that rounds down, in whole numbers."""
    return F.expr(f"(`{value}` - pmod(`{value}`, {by}L)) div {by}L")


def groups(events: DataFrame, kinds: list[str]) -> DataFrame:
    """client_id, t, mask: one row for each client and time; shuffled by both, so no client is a hot key."""
    bit = F.lit(0)
    for i, kind in enumerate(kinds):
        bit = F.when(F.col("kind") == kind, 1 << i).otherwise(bit)
    rows = events.select("client_id", micros(events, "ts").alias("t"), bit.cast("int").alias("mask"))
    return rows.where("client_id IS NOT NULL AND t IS NOT NULL AND mask > 0").groupBy("client_id", "t").agg(F.bit_or("mask").alias("mask"))


class Sweep:
    """Reverse running minima over sorted timestamp groups of many (client, slot) segments."""

    def __init__(self, segment: np.ndarray, t: np.ndarray, mask: np.ndarray):
        self.segment, self.t, self.mask, self.n = segment, t, mask, len(t)
        self.cache: dict[int, np.ndarray] = {}

    def at_or_after(self, bit: int) -> np.ndarray:
        """Place of the next group with this kind in the segment, for each place; n if there is none. One entry more than places."""
        if bit not in self.cache:
            place = np.full(self.n + 1, self.n)
            has = np.flatnonzero(self.mask & (1 << bit))
            place[has] = has
            self.cache[bit] = np.minimum.accumulate(place[::-1])[::-1]
        return self.cache[bit]

    def inside(self, found: np.ndarray, of: np.ndarray) -> np.ndarray:
        """found, or n where it lies in another segment than ``of``."""
        same = (found < self.n) & (self.segment[np.minimum(found, self.n - 1)] == self.segment[of])
        return np.where(same, found, self.n)

    def after(self, bit: int, of: np.ndarray) -> np.ndarray:
        return self.inside(self.at_or_after(bit)[of + 1], of)

    def reached(self, of: np.ndarray, step: int, excluded: int, limit: int) -> np.ndarray:
        """Place of the next step if it is reached from these places, else n."""
        to, bad = self.after(step, of), self.after(excluded, of)
        time = np.append(self.t, np.iinfo(np.int64).max)
        ok = (to < self.n) & (time[to] - self.t[of] <= limit) & (time[bad] > time[to])
        return np.where(ok, to, self.n)

    def chains(self, steps: list[int], excluded: int, limit: int) -> list[np.ndarray]:
        """For each step but the last, the next step's place for all places of its kind: the ready-made suffix chain."""
        out = []
        for step, following in zip(steps, steps[1:], strict=False):
            chain = np.full(self.n + 1, self.n)
            of = np.flatnonzero(self.mask & (1 << step))
            chain[of] = self.reached(of, following, excluded, limit)
            out.append(chain)
        return out

    def touched(self, funnels: list[tuple[list[int], int]]) -> np.ndarray:
        """Places that a chain from before the segment can touch."""
        first = np.flatnonzero(np.diff(self.segment, prepend=self.segment[0] - 1)) if self.n else np.zeros(0, np.int64)
        found = []
        for steps, excluded in funnels:
            found.append(self.inside(self.at_or_after(excluded)[first], first))
            for k in range(1, len(steps)):
                at = self.inside(self.at_or_after(steps[k])[first], first)
                for following in [*steps[k + 1 :], None]:
                    at = at[at < self.n]
                    found += [at, self.after(excluded, at)]
                    if following is not None:
                        at = self.after(following, at)
        places = np.unique(np.concatenate(found)) if found else first
        return places[places < self.n]


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[tuple[np.ndarray, ...]]:
    """client, slot, t, mask and own of sorted batches, in arrays that never end inside a (client, slot)."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        size += batch.num_rows
        if size < rows:
            continue
        whole = np.concatenate(held, axis=1)
        last = np.flatnonzero((whole[0] != whole[0][-1]) | (whole[1] != whole[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield tuple(whole[:, :cut])
        held, size = [whole[:, cut:]], 0 if cut else -whole.shape[1]  # a group that fills it all is looked at again when twice as long
    if held and sum(h.shape[1] for h in held):
        yield tuple(np.concatenate(held, axis=1))


def segments(client: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return np.cumsum((np.diff(client, prepend=client[0]) != 0) | (np.diff(slot, prepend=slot[0]) != 0))


def attempts(events: DataFrame, funnels: list[Funnel], limit: int, tables: Tables) -> DataFrame:
    """funnel (its place), client_id, step (from 1), wait (null at step 1) and n: one row for each step reached; first steps are counted in the task."""
    kinds = sorted({k for f in funnels for k in (*f.steps, f.excluded)})
    plan = [([kinds.index(s) for s in f.steps], kinds.index(f.excluded)) for f in funnels]
    span = limit * (max(len(f.steps) for f in funnels) - 1)
    found = tables.put(groups(events, kinds), "groups")
    width = slot_width(found, span)
    back = -(-span // width)
    slotted = found.select("client_id", whole_div("t", width).alias("slot"), "t", "mask", F.lit(1).alias("own"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for client, slot, t, mask, _ in whole_groups(batches):
            at = Sweep(segments(client, slot), t, mask).touched(plan)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (client, slot, t)] + [pa.array(mask[at].astype(np.int32))], names=["client_id", "slot", "t", "mask"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for client, slot, t, mask, own in whole_groups(batches):
            swept = Sweep(segments(client, slot), t, mask)
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for number, (steps, excluded) in enumerate(plan):
                chains = swept.chains(steps, excluded, limit)
                at = np.flatnonzero((mask & (1 << steps[0]) != 0) & (own == 1))
                who, n = np.unique(client[at], return_counts=True)
                rows = [(who, np.ones(len(who), np.int64), np.full(len(who), -1), n)]
                for step, chain in enumerate(chains, 2):
                    to = chain[at]
                    at, to = at[to < swept.n], to[to < swept.n]
                    rows.append((client[to], np.full(len(to), step), t[to] - t[at], np.ones(len(to), np.int64)))
                    at = to
                for r in rows:
                    for column, values in zip(out, (np.full(len(r[0]), number), *r), strict=True):
                        column.append(values)
            funnel, who, step, wait, n = (np.concatenate(c) for c in out)
            columns = [pa.array(funnel.astype(np.int32)), pa.array(who), pa.array(step.astype(np.int32)), pa.array(wait, mask=wait < 0), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["funnel", "client_id", "step", "wait", "n"])

    dealt = lambda rows: rows.repartition("client_id", "slot").sortWithinPartitions("client_id", "slot", "t")
    sent = dealt(slotted).mapInArrow(pick, "client_id long, slot long, t long, mask int")
    sent = sent.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(back))))
    # what an attempt that starts in the last moment of the earlier slot can still reach
    sent = sent.withColumn("slot", F.col("slot") - F.col("back")).where(F.col("t") <= (F.col("slot") + 1) * width - 1 + span)
    both = slotted.unionByName(sent.select("client_id", "slot", "t", "mask", F.lit(0).alias("own")))
    return dealt(both).mapInArrow(sweep, "funnel int, client_id long, step int, wait long, n long")


def slot_width(found: DataFrame, span: int) -> int:
    """The longest attempt, halved until no (client, slot) has more than SLOT_ROWS groups."""
    width = max(span, LEAST_SLOT)
    while True:
        most = found.groupBy("client_id", whole_div("t", width)).count().agg(F.max("count")).first()[0] or 0
        if most <= SLOT_ROWS or width // 2 < LEAST_SLOT:
            return width
        width //= 2


def count(events: DataFrame, funnels: list[Funnel], limit: int = 15 * MINUTE, percent: int = 50) -> DataFrame:
    """funnel, client_id, n1.., deepest, t2.. (percentile of the waits) and same_depth for every client with attempts."""
    spark = events.sparkSession
    tables = Tables(spark)
    most = max(len(f.steps) for f in funnels)
    key = ["funnel", "client_id", "step"]
    steps = tables.put(attempts(events, funnels, limit, tables), "attempts")
    tables.remove("groups")
    seconds = steps.groupBy(*key, whole_div("wait", SECOND).alias("second")).agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*key).orderBy("second").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = seconds.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*key)))
    ranked = ranked.withColumn("rank", F.expr(f"({percent}L * total + 99) div 100"))
    hit = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))
    target = tables.put(ranked.where(hit).select(*key, "second", "total", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "target")
    waits = steps.withColumn("second", whole_div("wait", SECOND)).join(target.where("step > 1"), [*key, "second"])
    waits = waits.groupBy(*key, "wait", "rank").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*key).orderBy("wait").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = waits.withColumn("upto", F.sum("n").over(upto)).where(hit).select(*key, "wait")
    both = target.select(*key, "total", F.lit(None).cast("long").alias("wait")).unionByName(exact.select(*key, F.lit(None).cast("long").alias("total"), "wait"))
    at = lambda value, k: F.max(F.when(F.col("step") == k, F.col(value)))
    name = F.element_at(F.array(*[F.lit(f.name) for f in funnels]), F.col("funnel") + 1)
    clients = both.groupBy("funnel", "client_id").agg(
        *[F.coalesce(at("total", k), F.lit(0)).cast("long").alias(f"n{k}") for k in range(1, most + 1)],
        F.max("step").cast("int").alias("deepest"),
        *[at("wait", k).alias(f"t{k}") for k in range(2, most + 1)],
    )
    clients = tables.put(clients.withColumn("funnel", name), "clients")
    tables.remove("attempts", "target")
    # a row for each funnel and depth
    depths = clients.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))
    return clients.join(F.broadcast(depths), ["funnel", "deepest"]).select(
        "funnel", "client_id", *[f"n{k}" for k in range(1, most + 1)], "deepest", *[f"t{k}" for k in range(2, most + 1)], "same_depth"
    )
