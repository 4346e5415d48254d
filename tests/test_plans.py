"""Plans of the engine's queries: pushdown, pruning, no Cartesian products."""

import re

import pytest

from evigraph.plans import CATALOG_QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["node_posterior_histogram50", "edge_posterior", "closure_shared_anchor", "direction_resolved", "information_bits_and_shift"])
def test_no_cartesian_products_and_no_python(spark, name):
    assert not re.search("CartesianProduct|Python|Pandas|Arrow", plan(CATALOG_QUERIES[name](spark, SF)))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(CATALOG_QUERIES["node_transcript_bf_zero_excluded"](spark, SF))
    assert "EqualTo(l_returnflag,R)" in text
    assert "l_shipdate" not in text and "l_comment" not in text


def test_pairs_meet_by_equi_joins(spark):
    text = plan(CATALOG_QUERIES["node_similarity_threshold"](spark, SF))
    assert "BroadcastNestedLoopJoin" not in text
