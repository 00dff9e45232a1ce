from __future__ import annotations

import random

import pytest

from graftwood.llm.components import connected_components


@pytest.mark.parametrize("kind", ["random", "star", "chain"])
def test_components_equal_union_find(spark, kind):
    rng = random.Random(3)
    pairs = {"random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "star": [(k, 90) for k in range(40)], "chain": [(k, k + 1) for k in range(40)]}[kind]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    joined = {x for a, b in pairs if a != b for x in (a, b)}
    rows = connected_components(spark.createDataFrame(pairs, "src long, dst long"), "test").collect()
    assert {r["id"]: r["component"] for r in rows} == {x: find(x) for x in joined} and len(rows) == len(joined)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long"), "test").count() == 0
