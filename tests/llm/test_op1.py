from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graftwood.llm.brown_lm import BrownLM, _endings, _held, _scores, _transitions, exchange, fit, score, sequences, transitions
from graftwood.llm.textvec import CHUNK, Words


def brute(texts: dict, words):
    end = object()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in [*words(t), end])
    total, size = sum(counts.values()), len(counts)
    out = {}
    for i, t in texts.items():
        tokens = [*words(t), end]
        out[i] = (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), total, sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in tokens))
    return out


@pytest.mark.parametrize("head", [600_000, 40])
def test_base_equals_brute_force(documents, texts, words, head):
    want = brute(texts, words)
    rows = score(documents, BrownLM(head=head)).collect()
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    own = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_the_model_is_a_distribution(documents):
    p = BrownLM(units=100, endings=16, classes=8, head=500)
    base = documents.select("doc_id", "text")
    table, m = fit(base.select("text"), p)
    rows = sequences(base, table, m, p)
    trans = transitions(rows, m, p)
    assert np.allclose((10**trans).sum(1), 1)
    # every word is in one class: emissions of a class and its place for unseen words add up to 1
    n, c = (table.toPandas()[k].to_numpy() for k in "nc")
    assert table.count() == table.select("h").distinct().count() == m["vocabulary"] and n.sum() == m["tokens"]
    for k in set(c.tolist()):
        assert ((n[c == k] + 1).sum() + 1) / 10 ** m["emit"][k] == pytest.approx(1)


@pytest.mark.parametrize("p", [BrownLM(), BrownLM(units=60, endings=8, classes=6, head=30, least=3)])
def test_scores_equal_brute_force(documents, texts, words, p):
    """Classes are taken from the table of words; everything else is counted anew, text by text."""
    base = documents.select("doc_id", "text")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    table, m = fit(base.filter(~_held(p)).select("text"), p)
    known = {r["h"]: (r["n"], r["c"]) for r in table.collect()}
    seqs = {}
    for i, t in texts.items():
        raw = words(t)
        h = [*(Words([" ".join(raw).encode()]).h.view(np.int64).tolist() if raw else []), 1]
        ends = [*(_endings(Words([w.encode()]).last(), p)[0] for w in raw), 0]
        seqs[i] = [(*known[x],) if x in known else (0, int(m["cls"][len(m["top"]) + e])) for x, e in zip(h, ends, strict=True)]
    g = np.zeros((p.classes, p.classes))
    for i, s in seqs.items():
        if not held[i]:
            for (_, a), (_, b) in zip([(0, m["end"]), *s], s, strict=False):
                g[a, b] += 1
    mass = np.array([sum(n + 1 for n, c in known.values() if c == k) + 1 for k in range(p.classes)], float)
    trans = (g + p.backoff * mass / mass.sum()) / (g.sum(1, keepdims=True) + p.backoff)
    for r in score(documents, p).collect():
        s = seqs[r["doc_id"]]
        want = sum(math.log10(trans[a, b] * (n + 1) / mass[b]) for (_, a), (n, b) in zip([(0, m["end"]), *s], s, strict=False))
        assert r["score"] == pytest.approx(want, rel=1e-9)


def test_rare_words_take_the_class_of_their_neighbours(spark):
    """x and y words alternate; words outside the core, whose endings say nothing, land with those that stand in their places."""
    rng = random.Random(6)
    rows = []
    for _ in range(400):
        rows.append((" ".join(w for _ in range(20) for w in (f"x{rng.randrange(60)}q", f"y{rng.randrange(60)}q")),))
    p = BrownLM(units=30, endings=1, classes=3, least=2)
    table, m = fit(spark.createDataFrame(rows, "text string"), p)
    c = {r["h"]: r["c"] for r in table.collect()}
    of = lambda k: {c[int(Words([f"{k}{i}q".encode()]).h.view(np.int64)[0])] for i in range(60)}
    assert len(of("x")) == len(of("y")) == 1 and of("x") != of("y")


def test_exchange_finds_alternating_classes():
    counts = np.zeros((8, 8))
    counts[:4, 4:] = counts[4:, :4] = 50
    cls = exchange(counts, 2, 20)
    assert len(set(cls[:4])) == len(set(cls[4:])) == 1 and cls[0] != cls[4]


def test_edges(edges):
    rows = score(edges).collect()
    assert len(rows) == edges.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[6]["n_tokens"] == 60_001
    assert len({r["train_tokens"] for r in rows}) == 1


def test_empty_table_and_nothing_to_learn_from(spark, edges):
    assert score(edges.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0.0 and math.isfinite(row["score"])


def test_words_are_cut_alike_whatever_the_chunk():
    text = b"aa bb\tcc\n" * 5 + b"z" * (CHUNK + 77) + b" tail aa"
    w = Words([text, b"", b"aa"])
    assert w.counts.tolist() == [15 + 1 + 2, 0, 1] and w.h[0] == w.h[-1] == w.h[17]
    alone = Words([b"z" * (CHUNK + 77)])
    assert alone.h[0] == w.h[15]


def test_long_batches_of_sequences_take_little_memory():
    """One batch of 10,000 texts and 5.6 million tokens, a text of a million among them."""
    rng = np.random.default_rng(3)
    sizes = [1_000_000, *rng.integers(0, 920, 9_999).tolist()]
    seqs = [np.append(rng.integers(0, 16, k), 5).astype(np.uint8) for k in sizes]
    batch = pa.record_batch([pa.array(range(len(seqs))), *(pa.array([0.0] * len(seqs)),) * 3, pa.array([x.tobytes() for x in seqs], pa.binary())], names=["doc_id", "n_tokens", "n_known", "logs", "seq"])
    trans, emit, p = rng.random((16, 16)), rng.random(16), BrownLM(classes=16)
    tracemalloc.start()
    scored, counted = pa.Table.from_batches(_scores(5, trans, emit)(iter([batch]))), pa.Table.from_batches(_transitions(p, 5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    before = [np.concatenate(([5], x[:-1])) for x in seqs]
    assert scored["doc_id"].to_pylist() == list(range(len(seqs)))
    assert np.allclose(scored["local"].to_numpy(), [(trans[b, c] - emit[c]).sum() for b, c in zip(before, seqs, strict=True)])
    want = np.bincount(np.concatenate(before).astype(int) * 16 + np.concatenate(seqs), minlength=256)
    got = np.zeros(256, np.int64)
    got[counted["code"].to_numpy()] = counted["n"].to_numpy()
    assert (got == want).all()
    assert peak < 100e6, f"{peak / 1e6:.0f} MB"
