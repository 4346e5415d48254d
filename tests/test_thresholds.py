"""Quantiles whose brackets are worked out once."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators.order import quantiles


def test_a_bracket_is_worked_out_once(spark):
    """A summary made twice may give two brackets, so none may be left in the plan of the result."""
    rows = spark.range(0, 30_000, 1, 16).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("x"))
    got = quantiles(rows, F.col("x"), [0.25, 0.5, 0.75])
    assert "approx" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = rows.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    row = got.first()
    assert row["q"] == pytest.approx(want, rel=1e-12) and row["n"] == 30_000
    assert quantiles(rows.where("x < 0"), F.col("x"), [0.5]).first()["q"] == [None]
