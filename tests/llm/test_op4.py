from __future__ import annotations

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graftwood.llm.packing import Packing, best_fit, opening_size, pack, reachable

P = Packing()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 8191), max_size=40))
def test_best_fit_equals_a_plain_search(lengths):
    lengths = sorted(lengths, reverse=True)

    def sums_to(n, most):
        own, made = {x for x in lengths if x <= n}, {0}
        todo = [0]
        while todo:
            base = todo.pop()
            for x in own:
                if base + x <= most and base + x not in made:
                    made.add(base + x)
                    todo.append(base + x)
        return made

    shrunk = lambda u: min(c for c in P.capacities if c >= u)

    def by_sums(n, left):
        made = sums_to(n, 8192 - n)
        choices = []
        for c in P.capacities:
            if c >= n:
                held = n + min(max(s for s in made if s <= c - n), left)
                choices.append((P.cost(shrunk(held)) / held, c))
        return min(choices)[1]

    def packed(opening):
        bins, out, left = [], [], sum(lengths)
        for n in lengths:
            left -= n
            fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n]
            if fits:
                k = min(fits)[1]
            else:
                k = len(bins)
                bins.append([opening(n, left), 0])
            out.append((k, bins[k][1]))
            bins[k][0] -= n
            bins[k][1] += n
        return out, [shrunk(b[1]) for b in bins]

    rules = [by_sums, *(lambda n, left, c=c: max(c, shrunk(n)) for c in P.capacities)]
    want, wanted_sizes = min(map(packed, rules), key=lambda x: sum(map(P.cost, x[1])))
    where, offsets, sizes = best_fit(lengths, P)
    assert (list(zip(where, offsets, strict=True)), sizes) == (want, wanted_sizes)


def test_the_histogram_decides_what_is_opened():
    opened = lambda n, others, left=10**6: opening_size(n, left, reachable([n, *others], 8192)[n], P)
    assert opened(600, []) == 2048  # one fills 1024 badly, three fill 2048 well
    assert opened(600, [424]) == 1024  # the two fill 1024
    assert opened(500, [], 0) == 512 and opened(340, []) == 1024 and opened(400, []) == 2048 and opened(100, range(1, 100)) == 1024
    assert opened(600, [1], 0) == 1024  # nothing else is to come
    costs = [sum(map(P.cost, best_fit([600] * 300, Packing(capacities=c))[2])) for c in (P.capacities, (8192,), (1024, 8192))]
    assert costs[0] < min(costs[1:])


def check(rows, lengths: list[tuple]):
    """Pieces cover every document, and no bin is overfull or larger than it need be."""
    spans, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["bin_id"]].append(r)
    want = defaultdict(list)
    for i, n in lengths:
        want[i].append(n)
    for i, ns in want.items():
        assert sorted(spans[i]) == sorted((k, min(8192, n - k)) for n in ns for k in range(0, n, 8192))
    assert set(spans) == set(want)
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        used = 0
        for r in own:
            assert r["offset"] == used
            used += r["length"]
        assert own[0]["capacity"] == min(c for c in P.capacities if c >= used) and len({r["capacity"] for r in own}) == 1
    return bins


@pytest.mark.parametrize("rows", [20_000, 16])
def test_round_trip(documents, texts, words, rows):
    got = pack(documents, Packing(block_rows=rows)).collect()
    bins = check(got, [(i, len(words(t)) + 1) for i, t in texts.items()])
    if rows == 20_000:
        assert sum(r["length"] for r in got) > 0.97 * sum(b[0]["capacity"] for b in bins.values())


def test_edges(edges, words):
    rows = [(r["doc_id"], len(words(r["text"])) + 1) for r in edges.select("doc_id", "text").collect()]
    check(pack(edges).collect(), rows)
    assert pack(edges.limit(0)).count() == 0


def test_repeated_ids_spread_over_blocks(spark):
    same = spark.range(200).selectExpr("5L AS doc_id", "'a b c' AS text")
    blocks = {r["bin_id"].split("-")[0] for r in pack(same, Packing(block_rows=20)).collect()}
    assert len(blocks) > 5


def test_bins_depend_on_the_rows_alone(documents):
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    one = key(pack(documents, Packing(block_rows=50)))
    assert one == key(pack(documents.repartition(7, "text"), Packing(block_rows=50)))
