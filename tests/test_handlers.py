"""Thresholds by handler."""

import pytest

from evigraph.operators import evidence as E


@pytest.mark.parametrize("own", [[5.0, 3.0], [3.0, 5.0]])
def test_first_threshold_is_the_least_of_the_least_key(spark, own):
    rows = spark.createDataFrame([(1, 1.0, own[0]), (1, 1.0, own[1]), (2, 1.0, 1.0), (0, 1.0, None)], "k long, v double, own double").coalesce(1)
    got = E.node_values(spark.range(3).withColumnRenamed("id", "k"), "pc_transcript", rows, "k", "v", "own")
    assert {r["tq"] for r in got.collect()} == {3.0}
