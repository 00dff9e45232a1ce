"""Each stage on what the one before it kept, against brute force."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from graftwood.llm.cotrain import score
from test_op7 import brute as near_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, documents, tmp_path_factory):
    docs, out = documents, [("documents", documents)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def _texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in stages[1:]] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert all(df.columns == COLUMNS for _, df in stages[:-1])
    assert all(later.count() <= earlier.count() for (_, earlier), (_, later) in zip(stages[:-1], stages[1:-1], strict=False))


def test_quality(spark, stages, sf):
    want = {r["doc_id"] for r in score(stages[0][1], spark.read.parquet(f"{sf}/labels.parquet")).filter("kept").collect()}
    assert set(_texts(stages[1][1])) == want


def test_exact(stages):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    least = {}
    for i, t in sorted(_texts(stages[1][1]).items()):
        least.setdefault(norm(t), i)
    assert set(_texts(stages[2][1])) == set(least.values())


def test_near(stages, words):
    want = {i for i, (_, c) in near_brute(list(_texts(stages[2][1]).items()), words, 5, 80, 100).items() if i == c}
    assert set(_texts(stages[3][1])) == want


def test_leaks(spark, stages, sf):
    words = lambda t: " ".join(re.findall(r"[^\W\d_]+", t.lower()))
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = _texts(stages[3][1]), _texts(stages[4][1])
    leaky = {i for i, t in before.items() if any(f" {x} " in f" {words(t)} " for x in items)}
    assert leaky and not leaky & set(after)
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    known = set().union(*(grams(x.split()) for x in items))
    assert all(len(grams(words(before[i]).split()) & known) >= 5 for i in set(before) - set(after))


def test_packing_covers_everything(stages, words):
    texts = _texts(stages[4][1])
    rows = stages[5][1].collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len(words(t)) + 1 for i, t in texts.items()}


def test_run_gives_the_last_stage(spark, stages, sf):
    import __spark_entry__ as entry

    got = entry.queries()["pipeline"](spark, sf).toPandas()
    want = stages[-1][1].toPandas()
    cols = ["doc_id", "piece", "start", "length"]
    assert sorted(map(tuple, got[cols].to_numpy().tolist())) == sorted(map(tuple, want[cols].to_numpy().tolist()))


def test_stages_on_edge_rows(spark, edges, sf):
    docs = edges.select(*COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() > 0, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        if name != "best_fit_packing":
            assert out.columns == COLUMNS


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert sorted({int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))}) == list(range(1, 11)) and "pipeline" in names


def test_rows_without_an_id_are_told_apart(spark, sf):
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    same = " ".join(f"w{k}" for k in range(40))
    rows = [(None, leak), (None, "harmless words " + same), (None, "harmless words " + same), (3, same), (4, f"One {leak} more"), (None, "nothing to see here"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_dedup(spark, docs, sf)
    assert near.columns == COLUMNS
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in near.collect()) == sorted([(3, same), (4, f"One {leak} more"), (0, "nothing to see here"), (0, "")])  # the leak and the text around it are near duplicates
    clean = corpus_pipeline.decontaminate(spark, docs, sf)
    assert clean.columns == COLUMNS
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in clean.collect()) == sorted([(0, rows[1][1]), (0, rows[1][1]), (3, same), (0, "nothing to see here"), (0, "")])
