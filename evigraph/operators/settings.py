"""Settings: the catalog of node factors, checked configurations, and jobs that can be cancelled."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Field:
    """A setting: its default, kind, and what it may be."""

    default: object
    low: float | None = None
    high: float | None = None
    open_low: bool = False
    choices: tuple | None = None

    def checked(self, name: str, value: object) -> object:
        kind = type(self.default)
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if type(value) is not kind:
            raise ValueError(f"{name} must be of type {kind.__name__}")
        if self.choices is not None and value not in self.choices:
            raise ValueError(f"{name} must be one of {', '.join(map(str, self.choices))}")
        if kind in (int, float):
            if not math.isfinite(value) or self.low is not None and (value < self.low or self.open_low and value == self.low) or self.high is not None and value > self.high:
                raise ValueError(f"{name} is out of range")
        return value


def normalized(given: Mapping[str, object] | None, fields: Mapping[str, Field], where: str = "") -> dict[str, object]:
    """All settings, defaults where none are given; unknown names and bad values are errors."""
    given = dict(given or {})
    if unknown := sorted(set(given) - set(fields)):
        raise ValueError(f"unknown settings: {', '.join(where + u for u in unknown)}")
    return {name: f.checked(where + name, given.get(name, f.default)) for name, f in fields.items()}


#: Settings of a stream, of the edge stage and of the search.
STREAM_FIELDS = {"enabled": Field(True), "weight": Field(1.0, 0.0), "tq_multiplier": Field(1.0, 0.0, open_low=True), "continuous_negative_evidence": Field(False)}
EDGE_FIELDS = {
    "prior_probability": Field(0.5, 1e-6, 1 - 1e-6), "penalize_unsupported": Field(False), "unsupported_bayes_factor": Field(0.5, 0.0, 1.0, open_low=True),
    "continuous_negative_evidence": Field(False), "continuous_bayes_factor_floor": Field(1e-6, 0.0, 1.0, open_low=True),
}
SEARCH_FIELDS = {"top_n": Field(20, 1), "beam_width": Field(5, 1), "max_depth": Field(8, 1), "mode": Field("production", choices=("production", "development"))}


def normalize_configuration(config: Mapping[str, Mapping], streams: list[str]) -> dict[str, dict]:
    """A whole configuration: edge_integration, edge_streams (by name) and search."""
    if unknown := sorted(set(config) - {"edge_integration", "edge_streams", "search"}):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    states = config.get("edge_streams", {})
    if unknown := sorted(set(states) - set(streams)):
        raise ValueError(f"unknown streams: {', '.join(unknown)}")
    return {
        "edge_integration": normalized(config.get("edge_integration"), EDGE_FIELDS, "edge_integration."),
        "edge_streams": {s: normalized(states.get(s), STREAM_FIELDS, f"edge_streams.{s}.") for s in streams},
        "search": normalized(config.get("search"), SEARCH_FIELDS, "search."),
    }


def node_catalog(base: DataFrame, more: list[DataFrame], key: str = "gene_symbol") -> DataFrame:
    """The base table with every further table's columns, joined one to one; a column that two tables have is an error."""
    out = base
    for table in more:
        if clash := sorted(set(out.columns) & set(table.columns) - {key}):
            raise ValueError(f"columns of several tables: {', '.join(clash)}")
        if not table.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"a table holds a {key} twice")
        out = out.join(table, key, "left")
    return out


@contextmanager
def cancellable(spark: SparkSession, group: str, what: str) -> Iterator[None]:
    """Jobs inside belong to a group that ``cancel`` stops and whose progress can be asked for."""
    spark.sparkContext.setJobGroup(group, what, interruptOnCancel=True)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def progress(spark: SparkSession, group: str) -> list[tuple[int, int, int]]:
    """(stage, tasks done, tasks) of the group's running stages."""
    tracker, out = spark.sparkContext.statusTracker(), []
    active = set(tracker.getActiveStageIds())
    for job in tracker.getJobIdsForGroup(group):
        for stage in (tracker.getJobInfo(job).stageIds if tracker.getJobInfo(job) else ()):
            if stage in active and (info := tracker.getStageInfo(stage)):
                out.append((stage, info.numCompletedTasks, info.numTasks))
    return out
