"""Every query of the comparison engine against its SQL, over whole tables."""

from __future__ import annotations

import pytest

from graftwood.plans import queries, replayed  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, same_rows, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name]).df()
    assert len(want) > 0 or name == "cache_anti_join"
    same_rows(got.toPandas(), want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_every_query_is_registered(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["dir_a", "dir_b", "jaccard"]


def test_scans_read_only_the_columns_they_need(spark):
    plan = queries.line_counts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan.split("ReadSchema")[1]


def test_file_pairs_are_joined_by_equality(spark):
    plan = queries.file_pairs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
