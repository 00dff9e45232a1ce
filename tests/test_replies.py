"""Replies are taken apart once, whatever is asked of them later."""

from __future__ import annotations

import pytest

from graftwood.plans import queries, replayed  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["parse_similar", "composite_score", "dedup_functions", "report_sorted", "strict_threshold", "score_distribution"])
def test_a_reply_is_taken_apart_once(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(func_a") == 1
