"""Pairs of files are unfolded where they lie: none of them goes through a shuffle."""

from __future__ import annotations

from itertools import product

import pytest
from pyspark.sql import functions as F

from graftwood.operators import comparing
from graftwood.plans import queries

SF = "/root/testdata/sf0.001"
FILES = "repo string, path string, dir string, language string, line_count int, content string"


def exchanges(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(r, f"{d}/f{k}", d, "go", 1, "" if k == 3 else f"{r}{d}{k}") for r in "AB" for d in ("x", "x/y", "z") for k in range(7)]
    matches = [(5, "x", "z"), (2, "x/y", "z"), (9, "z", "x/y"), (1, "none", "z")]
    return spark.createDataFrame(matches, "ord int, dir_a string, dir_b string"), spark.createDataFrame(rows, FILES)


def test_file_pairs_are_not_shuffled(spark):
    assert not [x for x in exchanges(queries.file_pairs(spark, SF)) if "file_a" in x]


@pytest.mark.parametrize("size", [2, 1000])
def test_blocks_unfold_to_all_pairs(spark, tree, size):
    matches, files = tree
    met = comparing.met_rows(matches, files.select("repo", "dir", "path"), size)
    got = sorted((r["a"]["path"], r["b"]["path"], r["ord"]) for r in met.collect())
    folders = {("x", "z"): 5, ("x/y", "z"): 2, ("z", "x/y"): 9}
    assert got == sorted((f"{a}/f{i}", f"{b}/f{k}", n) for (a, b), n in folders.items() for i, k in product(range(7), range(7)))


def test_keyed_pairs_are_not_joined(spark, tree, same_rows):
    matches, files = tree
    assert not [x for x in exchanges(queries.pair_key(spark, SF)) if "file_a" in x]
    one = comparing.keyed_file_pairs(matches, files, "m", 20).drop(comparing.DEALT)
    same_rows(one.toPandas(), comparing.keyed_pairs(comparing.file_pairs(matches, files), files, "m", 20).toPandas())


def test_status_of_pairs_where_they_lie(spark, tree):
    matches, files = tree
    keyed = comparing.keyed_file_pairs(matches, files, "m", 20)
    cache = keyed.filter(F.col("key") < "8")
    here, moved = (comparing.pair_status(keyed, c).collect() for c in (cache, cache.select("key").union(cache.select("key"))))
    assert sorted(here) == sorted(moved) and {r["status"] for r in here} == {"cached", "new", "skipped"}
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    with comparing.dealt_by_part_of_keys(spark):
        assert not [x for x in exchanges(keyed.join(cache.hint("shuffle_hash"), [comparing.DEALT, "key"])) if "key" in x]
