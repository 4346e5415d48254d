"""Plans: native operators stay in the JVM, narrow queries read narrow columns."""

import re

import pytest

pytest.importorskip("evigraph.llm")

from evigraph.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
NATIVE = ["op2_sharding", "op3_mixing", "op5_secrets", "op9_line_dedup"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_hold_no_python(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", text)


def test_url_filters_do_not_shuffle_or_read_pages(spark):
    text = plan(queries.QUERIES["op6_url_filters"](spark, SF))
    assert "Exchange" not in text and "html" not in text


@pytest.mark.parametrize("name", ["op2_sharding", "op3_mixing"])
def test_text_is_not_shuffled(spark, name):
    """The text is gone before the exchange: only ids, sizes and digests travel."""
    for line in plan(queries.QUERIES[name](spark, SF)).splitlines():
        if "Sort [" in line or "Window [" in line:
            assert "text#" not in line
