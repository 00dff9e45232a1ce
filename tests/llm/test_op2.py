from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graftwood.llm import queries
from graftwood.llm.exact_dedup import LsmDedup, _open, build_index, exact_duplicates, keep_first


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids, default=None)
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(map(repr, out))


def shown(df):
    return sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in df.collect())


def test_query_equals_its_sql(spark, duck, same_rows, sf):
    same_rows(queries.op2_lsm_exact_dedup(spark, sf).toPandas(), duck.execute(queries.ORACLES["op2_lsm_exact_dedup"]).df())


@pytest.mark.parametrize("p", [LsmDedup(), LsmDedup(memtable=3, run_digests=10, filter_bits=1, filter_hashes=1), LsmDedup(filter_bytes=0), LsmDedup(digest_chars=2), LsmDedup(digest_chars=0)])
def test_small_memtables_full_filters_and_digest_collisions(documents, texts, p):
    assert shown(exact_duplicates(documents, p)) == brute(list(texts.items()))


@pytest.mark.parametrize("p", [LsmDedup(), LsmDedup(digest_chars=1)])
def test_edges(edges, p):
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    assert shown(exact_duplicates(edges, p)) == brute(rows)
    assert exact_duplicates(edges.limit(0), p).count() == 0


@pytest.mark.parametrize("p", [LsmDedup(), LsmDedup(filter_bits=1, filter_hashes=1, digest_chars=1), LsmDedup(filter_bytes=0)])
def test_one_row_of_each_text_stays_with_its_columns(edges, documents, texts, p):
    kept = keep_first(edges, p)
    assert kept.columns == edges.columns
    got = kept.collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(norm(r["text"]) for r in got) == sorted({norm(r["text"]) for r in edges.collect()})
    assert {r["doc_id"] for r in got if norm(r["text"]) == ""} == {3} and {r["doc_id"] for r in got if r["text"] and r["text"].startswith("alpha")} == {1}
    lows = defaultdict(list)
    for i, t in texts.items():
        lows[norm(t)].append(i)
    assert {r["doc_id"] for r in keep_first(documents, p).collect()} == {min(v) for v in lows.values()}
    assert keep_first(edges.limit(0), p).count() == 0


def test_each_run_has_a_filter_of_its_repeated_digests(documents):
    p = LsmDedup(run_digests=40, memtable=7)
    keyed = documents.selectExpr("doc_id", "unhex(sha2(text, 256)) AS digest")
    made, runs = build_index(keyed, p)
    rows = made.collect()
    assert runs >= 5
    index = [r for r in rows if r["digest"] is not None]
    want = {bytes(r["digest"]): (r["k"], r["n"]) for r in keyed.groupBy("digest").agg(F.min("doc_id").alias("k"), F.count("*").alias("n")).collect()}
    assert {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in index} == want
    filters = {r["run"]: r["filter"] for r in rows if r["filter"] is not None}
    assert set(filters) == {r["run"] for r in index if r["n"] > 1}
    for k, f in filters.items():
        n = sum(r["run"] == k and r["n"] > 1 for r in index)
        assert len(f) * 8 == -(-n * p.filter_bits // 64) * 64
    # nothing that repeats misses, and few others hit
    found, hit = _open(keyed, p)
    got = {bytes(r["digest"]): r["h"] for r in keyed.withColumn("h", hit).select("digest", "h").collect()}
    assert all(got[d] for d, (_, n) in want.items() if n > 1)
    assert sum(got[d] for d, (_, n) in want.items() if n == 1) < 0.2 * len(want)
