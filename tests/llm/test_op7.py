from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from graftwood.llm import near_dedup
from graftwood.llm.near_dedup import NearDedup, exact_sets, near_duplicates


def brute(rows, words, k, num, den):
    """(n_shingles, smallest reachable id) by id; ids are distinct here."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    p, q = find(ids[a]), find(ids[b])
                    parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def shown(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("p", [NearDedup(shingle=3, num=85, den=100), NearDedup()])
def test_given_documents_equal_brute_force(documents, texts, words, p):
    assert shown(near_duplicates(documents, p)) == brute(list(texts.items()), words, p.shingle, p.num, p.den)


@pytest.mark.parametrize("p", [NearDedup(), NearDedup(bucket_block=4, cluster_block=3, cluster_shingles=300, broadcast_rows=0)])
def test_large_groups_chains_and_near_misses(spark, words, p):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(k, " ".join(base[:100] if k % 3 else [*base[:99], f"only{k}"])) for k in range(40)]
    rows += [(100 + k, " ".join(base[k * 8 : k * 8 + 80])) for k in range(5)]  # each is near the next one
    other = [f"v{rng.randrange(5000)}" for _ in range(60)]
    rows += [(200 + k, " ".join(other[: 60 - 4 * k])) for k in range(6)]
    rows += [(300, "One two"), (301, "one  TWO"), (302, "one"), (303, ""), (304, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(near_duplicates(df, p)) == brute(rows, words, p.shingle, p.num, p.den)


def test_large_groups_with_loose_members(spark, words):
    """Clusters of many blocks whose members link with each other but not with the pivot."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(9000)}" for _ in range(400)]
    rows = [(k, " ".join(base[k * 7 : k * 7 + 100])) for k in range(30)]  # a chain: the pivot reaches few
    rows += [(50 + k, " ".join([*base[:80], *(f"x{k}y{j}" for j in range(17 + k % 6))])) for k in range(40)]  # around the threshold
    rows += [(100 + k, " ".join(base[100:200])) for k in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for p in (NearDedup(bucket_block=5, cluster_block=4), NearDedup(shingle=3, num=85, bucket_block=3, cluster_block=7, cluster_shingles=900)):
        assert shown(near_duplicates(df, p)) == brute(rows, words, p.shingle, p.num, p.den)


def test_words_that_collide_under_sums(spark, words):
    """Thue-Morse words have equal sums of powers; they, and texts made of them, must not count as equal."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    a, b = ("".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits))
    rows = [(1, a), (2, b), (3, f"{a} {b} {a}"), (4, f"{b} {a} {b}"), (5, a.upper())]
    got = shown(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), NearDedup()))
    assert got == brute(rows, words, 5, 80, 100) and got[5] == (1, 1) and got[2] == (1, 2)


def test_sets_of_real_shingles(words):
    texts = ["a b c a b c a", "A b c", "b c a b c", "", "c", "x" * 100 + " b c", "x" * 99 + "y b c"]
    sets = exact_sets([t.encode() for t in texts], 3)
    want = [frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if (w := words(t)) else frozenset() for t in texts]
    for x, p in zip(sets, want, strict=True):
        assert len(x) == len(p)
        for y, q in zip(sets, want, strict=True):
            assert len(np.intersect1d(x, y)) == len(p & q)


def test_a_group_moves_once(spark):
    """Copies that reach their pivot aren't met by other blocks: no second turn, whatever the size of the group."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(300)]
    seen = []
    keep = near_dedup._run_second
    near_dedup._run_second = lambda *a: seen.append(a) or keep(*a)
    try:
        got = shown(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), NearDedup(bucket_block=20, cluster_block=10)))
    finally:
        near_dedup._run_second = keep
    assert not seen and set(got.values()) == {(197, 0)}


def test_pruning_bounds():
    p = NearDedup()
    steps = p.least_matches()
    assert [n for n, _ in steps] == [25, 50, 75, 100, 125] and all(m < 0.8 * n for n, m in steps)
    assert [b for _, b in steps] == sorted(b for _, b in steps)
    assert p.chance_missed() < 1e-4 and NearDedup(num=85).chance_missed() < 1e-6


def test_edges(edges):
    rows = near_duplicates(edges, NearDedup()).collect()
    assert len(rows) == edges.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["component_id"] == by[2][0]["component_id"] == 1 and not by[2][0]["kept"]
    assert [r["component_id"] for r in by[6]] == [6, 6] and all(r["n_shingles"] == 1 for r in by[6])
    assert all(r["kept"] and r["n_shingles"] == 0 and r["component_id"] == k for k in (3, 4, 5) for r in by[k])
    assert all(r["kept"] or r["component_id"] is not None for r in by[None])
    assert near_duplicates(edges.limit(0), NearDedup()).count() == 0


def test_every_link_of_a_larger_table(spark, words):
    """All links of the rows whose id is divisible by 50, against all rows, by brute force over full sets."""
    p = NearDedup(shingle=3, num=85, den=100)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    sets = lambda w: {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} if w else set()
    holds, sizes = {}, {}
    for i, w in rows:
        if i % 50 == 0:
            own = sets(w)
            sizes[i] = len(own)
            for s in own:
                holds.setdefault(s, []).append(i)
    links = set()
    for i, w in rows:
        own = sets(w)
        both = Counter(q for s in own for q in holds.get(s, ()))
        links |= {(q, i) for q, n in both.items() if q != i and 100 * n >= 85 * (sizes[q] + len(own) - n)}
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, p).collect()}
    assert len(links) > 50 and not [(a, b) for a, b in links if got[a] != got[b]]
