"""Calibration of weights and thresholds on positive controls.

The objective runs on the driver: mean of -ln p plus a quadratic pull to preferred
values, minimized inside bounds by direction-set line searches with golden
sections, from up to three starts.  All controls count, however many: ``summed_up``
puts measurements that differ by less than WIDTH of their size together, as their
mean and number, so what comes to the driver follows the decades that they span
(23,026 rows each) and not their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative width of what counts as one measurement; the objective differs by its square.
WIDTH = 1e-4


def summed_up(values: DataFrame, x: Column) -> tuple[np.ndarray, np.ndarray]:
    """Measurements and their numbers, in rising order; missing ones are left out."""
    value = x.cast("double")
    rows = values.select(value.alias("x")).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')")
    size = F.when(F.col("x") != 0, F.floor(F.ln(F.abs("x")) / WIDTH))
    bins = rows.groupBy(F.signum("x").alias("sign"), size.alias("size")).agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    got = sorted((r["x"], r["n"]) for r in bins.select("x", "n").collect())  # bounded by the span of the values
    return np.array([v for v, _ in got], float), np.array([n for _, n in got], float)


@dataclass(frozen=True)
class Parameter:
    name: str
    start: float
    preferred: float
    low: float
    high: float
    scale: float = 1.0
    log: bool = False

    def inner(self, x: float) -> float:
        return math.log(x) if self.log else x

    def outer(self, z: float) -> float:
        return min(self.high, max(self.low, math.exp(z) if self.log else z))


def objective(parameters: list[Parameter], probability: Callable[[dict[str, float]], np.ndarray], pull: float, counts: np.ndarray | None = None) -> Callable[[np.ndarray], float]:
    def value(z: np.ndarray) -> float:
        theta = {p.name: p.outer(v) for p, v in zip(parameters, z, strict=True)}
        p = np.clip(np.asarray(probability(theta), float), 1e-15, 1.0)
        away = [((p_.inner(theta[p_.name]) - p_.inner(p_.preferred)) / p_.scale) ** 2 for p_ in parameters]
        return float(-np.average(np.log(p), weights=counts) + pull * np.mean(away))

    return value


def line_search(f: Callable[[float], float], low: float, high: float, rounds: int = 60) -> float:
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(rounds):
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return min((low, high, (a + b) / 2), key=f)


def calibrate(parameters: list[Parameter], probability: Callable[[dict[str, float]], np.ndarray], pull: float = 0.1, sweeps: int = 25, tolerance: float = 1e-10, counts: np.ndarray | None = None) -> dict:
    """Best values, the loss at the start and at the end, and whether it improved."""
    loss = objective(parameters, probability, pull, counts)
    low = np.array([p.inner(p.low) for p in parameters])
    high = np.array([p.inner(p.high) for p in parameters])
    first = np.array([p.inner(p.start) for p in parameters])
    starts = [first, np.array([p.inner(p.preferred) for p in parameters]), (low + high) / 2]
    best, best_loss = first, loss(first)
    for start in starts:
        z, now = start.copy(), loss(start)
        directions = list(np.eye(len(z)))
        for _ in range(sweeps):
            before, z0 = now, z.copy()
            for d in directions:
                z, now = _along(loss, z, now, d, low, high)
            move = z - z0
            if np.abs(move).max() > 0:
                z, now = _along(loss, z, now, move / np.abs(move).max(), low, high)
                directions = [*directions[1:], move / np.abs(move).max()] if len(directions) > 1 else directions
            if before - now < tolerance:
                break
        if now < best_loss:
            best, best_loss = z, now
    return {"values": {p.name: p.outer(v) for p, v in zip(parameters, best, strict=True)}, "start_loss": loss(first), "loss": best_loss, "improved": best_loss < loss(first)}


def _along(loss, z, now, d, low, high):
    with np.errstate(divide="ignore", invalid="ignore"):
        steps = np.concatenate([(low - z) / d, (high - z) / d])
    steps = steps[np.isfinite(steps)]
    below, above = steps[steps <= 0], steps[steps >= 0]
    if not len(below) or not len(above):
        return z, now
    a, b = below.max(), above.min()
    s = line_search(lambda t: loss(np.clip(z + t * d, low, high)), a, b)
    moved = np.clip(z + s * d, low, high)
    value = loss(moved)
    return (moved, value) if value < now else (z, now)
