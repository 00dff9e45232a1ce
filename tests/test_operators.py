from __future__ import annotations

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from graftwood.operators import comparing, matching, summaries, tree
from graftwood.streaming.checkpoints import Checkpoint


@pytest.fixture
def cut(spark, tmp_path):
    def write(df):
        path = str(tmp_path / uuid.uuid4().hex)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


FILES = "repo string, path string, dir string, language string, line_count int, content string"


def _files(spark, *paths, content="x\n"):
    rows = [("A", p, p.rpartition("/")[0], "python", 1, content) for p in paths]
    return spark.createDataFrame(rows, FILES)


def test_tree_relations(spark):
    files = _files(spark, "a/b/c/x.py", "a/y.py", "d/z.py", "r.py")
    dirs = tree.with_shells(files)
    assert {(r["dir"], r["has_files"]) for r in dirs.collect()} == {("", True), ("a", True), ("a/b", False), ("a/b/c", True), ("d", True)}
    assert {r["dir"]: r["height"] for r in tree.heights(dirs).collect()} == {"": 3, "a": 2, "a/b": 1, "a/b/c": 0, "d": 0}
    assert {(r["dir"], r["child"]) for r in tree.direct_children(dirs).collect()} == {("", "a"), ("", "d"), ("a", "a/b"), ("a/b", "a/b/c")}
    assert {r["dir"]: r["n_files"] for r in tree.rollup(files).collect()} == {"": 4, "a": 2, "a/b": 1, "a/b/c": 1, "d": 1}


def test_subtree_hash_changes_only_above_a_change(spark):
    of = lambda **c: {r["dir"]: r["subtree_hash"] for r in tree.subtree_hashes(spark.createDataFrame([("A", f"{d}/f.py", d, "python", 1, t) for d, t in c.items()], FILES)).collect()}
    one, two = of(a="1", b="2"), of(a="1", b="3")
    assert one["a"] == two["a"] and one["b"] != two["b"] and one[""] != two[""]


def test_a_prefix_is_not_an_ancestor(spark):
    files = _files(spark, "a/x.py", "ab/y.py").union(spark.createDataFrame([("B", "k/q.py", "k", "go", 1, "z")], FILES))
    matches = spark.createDataFrame([(2, "a", "k"), (1, "", "k"), (3, "none", "k")], "ord int, dir_a string, dir_b string")
    got = {(r["file_a"], r["file_b"]): r["ord"] for r in comparing.file_pairs(matches, files).collect()}
    assert got == {("a/x.py", "k/q.py"): 1, ("ab/y.py", "k/q.py"): 1}


@pytest.mark.parametrize("seed,one_task", [(0, 0), (1, 0), (2, 10), (3, 1000), (4, 1000)])
def test_greedy_rounds_equal_one_pass(spark, cut, seed, one_task):
    rng = random.Random(seed)
    pairs = sorted({(f"a{rng.randrange(9)}", f"b{rng.randrange(9)}"): rng.choice([0.3, 0.4, 0.5, 0.6]) for _ in range(50)}.items())
    want, used_a, used_b = set(), set(), set()
    for (a, b), s in sorted(pairs, key=lambda x: (-x[1], x[0])):
        if a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs], "dir_a string, dir_b string, score double")
    got = matching.heuristic_matches(df, cut, one_task).collect()
    assert {(r["dir_a"], r["dir_b"]) for r in got} == want and len(got) == len(want)


def test_confidence_and_reason(spark, cut):
    df = spark.createDataFrame([("a", "b", 0.55), ("c", "d", 0.40), ("e", "f", 0.345)], "dir_a string, dir_b string, score double")
    got = {r["dir_a"]: (r["confidence"], r["reason"]) for r in matching.heuristic_matches(df, cut).collect()}
    assert got == {"a": ("high", "heuristic score 0.55"), "c": ("medium", "heuristic score 0.40"), "e": ("low", "heuristic score 0.34")}


def test_greedy_of_nothing(spark, cut):
    assert matching.heuristic_matches(spark.createDataFrame([], "dir_a string, dir_b string, score double"), cut).count() == 0


def test_similar_names_match_without_a_common_token(spark):
    rows = [("A", "handlers", "alpha"), ("B", "handler", "beta"), ("B", "zzz", "gamma"), ("A", "empty", "")]
    got = matching.similarities(spark.createDataFrame(rows, "repo string, dir string, summary string")).collect()
    assert {(r["dir_a"], r["dir_b"]) for r in got} == {("handlers", "handler")} and got[0]["jaccard"] == 0.0


def test_similarities_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "io", "core", "utils"]
    rows = [(r, "/".join(rng.choice(words) for _ in range(rng.randrange(0, 4))) + str(k % 7) * (k % 3), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 4)))) for r in "AB" for k in range(25)]
    rows = list({(r, d): (r, d, t) for r, d, t in rows}.values())
    tokens = lambda t: {w for w in t.split() if len(w) > 2}
    want = {}
    for _, a, x in (r for r in rows if r[0] == "A"):
        for _, b, y in (r for r in rows if r[0] == "B"):
            j = len(tokens(x) & tokens(y)) / len(tokens(x) | tokens(y)) if tokens(x) and tokens(y) else 0.0
            score = SequenceMatcher(None, a or "root", b or "root").ratio() * 0.35 + j * 0.65
            if score >= 0.22:
                want[a, b] = pytest.approx(score)
    got = {(r["dir_a"], r["dir_b"]): r["score"] for r in matching.similarities(spark.createDataFrame(rows, "repo string, dir string, summary string")).collect()}
    assert got == want


def test_numbers_follow_the_order(spark, cut):
    df = spark.range(500).selectExpr("id", "(id * 7919) % 501 AS k").repartition(9)
    got = {r["k"]: r["number"] for r in matching.numbered(df, ["k"], cut).collect()}
    assert [got[k] for k in sorted(got)] == list(range(500))


def test_model_matches_are_validated(spark):
    dirs = spark.createDataFrame([("A", "a"), ("B", "b"), ("A", ""), ("B", "")], "repo string, dir string")
    given = spark.createDataFrame([(1, " a ", "b", None, None), (2, "a", "none", "high", "r"), (3, None, "b", "low", "r"), (4, "(root)", "(root)", "low", "r")], "ord int, dir_a string, dir_b string, confidence string, reason string")
    assert [tuple(r) for r in matching.valid_matches(given, dirs).collect()] == [(1, "a", "b", "medium", "")]


@pytest.mark.parametrize("n,size,most", [(40, 40, 1), (41, 40, 2), (7, 0, 1), (9, 3, 3)])
def test_batches(spark, cut, n, size, most):
    rows = [("A", f"{'ab'[k % 2]}{k:03d}", "s") for k in range(n)]
    got = {r["dir"]: r["batch"] for r in matching.batches(spark.createDataFrame(rows, "repo string, dir string, summary string"), size, cut).collect()}
    assert got == {d: (k // size if size else 0) for k, (_, d, _) in enumerate(sorted(rows, key=lambda r: r[1]))}
    assert max(got.values()) == most - 1


def _item(**more):
    base = {"func_a": {"name": "f", "line_start": 1, "line_end": 2}, "func_b": {"name": "g"}, "scores": {}, "composite_score": 50, "similarity_level": "medium", "analysis": "x"}
    return base | more


def test_parsing_of_replies(spark):
    items = [
        _item(composite_score="68"),
        _item(composite_score=75.9),
        _item(composite_score="75.9"),
        _item(composite_score=True, similarity_level="odd"),
        _item(scores={"algorithm_logic": 140}),
        {k: v for k, v in _item().items() if k != "func_b"},
        _item(func_a={}, composite_score=19),
        _item(scores={"naming_convention": "n/a"}),
        _item(scores={"data_structure": None}),
        _item(composite_score=3_000_000_000, func_a="f", scores="none"),
        "no item",
        None,
    ]
    replies = [(1, "a", "b", json.dumps({"similar_functions": items})), (2, "c", "d", "[1]"), (3, "e", "f", "not json"), (4, "g", "h", '{"similar_functions": {}}'), (5, "i", "j", None)]
    df = spark.createDataFrame(replies, "ord int, file_a string, file_b string, reply string")
    rows = {r["pos"]: r for r in comparing.parse_similar(df).collect()}
    assert set(rows) == {0, 1, 3, 4, 6, 9}
    assert rows[9]["composite_score"] == 3_000_000_000 and rows[9]["name_a"] == "unknown"
    assert [rows[k]["composite_score"] for k in (0, 1, 3, 4, 6)] == [68, 75, 1, 50, 19]
    assert rows[3]["similarity_level"] == "very_low" and rows[4]["algorithm_logic"] == 140 and rows[4]["data_structure"] == 0
    assert rows[6]["name_a"] == "unknown" and rows[6]["start_a"] == 0
    assert {r["pos"] for r in comparing.parse_similar(df, 20).collect()} == {0, 1, 4, 9}


def test_dedup_and_distribution(spark):
    items = [_item(composite_score=s, analysis=str(k)) for k, s in enumerate((40, 61, 61))] + [_item(composite_score=s, func_b={"name": f"h{s}"}) for s in (19, 20, 39, 40, 60)]
    df = spark.createDataFrame([(1, "a", "b", json.dumps({"similar_functions": items}))], "ord int, file_a string, file_b string, reply string")
    found = comparing.dedup_functions(comparing.parse_similar(df))
    best = found.filter("name_b = 'g'").collect()
    assert len(best) == 1 and best[0]["composite_score"] == 61 and best[0]["analysis"] == "1"
    assert tuple(comparing.score_distribution(found).first()) == (1, 2, 2, 1, 6)
    assert [r["composite_score"] for r in comparing.report_order(found).collect()] == [61, 60, 40, 39, 20, 19]


def test_bins_of_directories(spark):
    rows = [("A", "d", f"f{k}", n) for k, n in enumerate((5, 9, 1, 4, 30))]
    df = spark.createDataFrame(rows, "repo string, dir string, path string, tokens int")
    got = {r["path"]: r["bin"] for r in summaries.ffd_bins(df, 10).collect()}
    assert got == {"f4": 0, "f1": 1, "f0": 2, "f3": 2, "f2": 1}


def test_empty_summaries_become_placeholders(spark):
    files = _files(spark, "a/x.py", "y.py")
    given = spark.createDataFrame([("A", "a/x.py", "")], "repo string, path string, summary string")
    got = {r["path"]: r for r in summaries.prepared(files, given).collect()}
    assert all(r["summary"] == summaries.PLACEHOLDER_FILE for r in got.values())
    assert got["a/x.py"]["display_path"] == "x.py" and got["y.py"]["display_path"] == "y.py"


def test_checkpoint_keeps_the_last_sound_record(spark, tmp_path):
    at = tmp_path / "cache"
    table = Checkpoint(spark, str(at), "v int, model string, hash string, summary string", ["hash"])
    assert table.load("m").count() == 0
    rec = lambda s, h="h", m="m", v=1: spark.createDataFrame([(v, m, h, s)], table.schema)
    for k in range(60):
        table.append(rec(f"s{k}"), k) if k % 20 == 0 else None
    table.append(rec("other", m="n"), 70)
    table.append(rec("old", h="x", v=0), 71)
    (at / "part-bad.json").write_text("{broken\n" + "\n".join(json.dumps({"v": 1, "model": "m", "hash": "z", "summary": str(k), "seq": 100 + k}) for k in range(60)))
    assert {r["hash"]: r["summary"] for r in table.load("m").collect()} == {"h": "s40", "z": "59"}
    assert table.compact()
    assert {r["hash"]: r["summary"] for r in table.load("m").collect()} == {"h": "s40", "z": "59"}
    assert {r["summary"] for r in table.load("n").collect()} == {"other"}
    assert not table.compact()


def test_a_broken_compaction_loses_nothing(spark, tmp_path):
    at = tmp_path / "cache"
    table = Checkpoint(spark, str(at), "v int, model string, hash string, summary string", ["hash"])
    table.append(spark.createDataFrame([(1, "m", f"h{k % 5}", str(k)) for k in range(60)], table.schema), 1)
    at.rename(f"{at}.old")  # broke off after the old table was put aside
    assert table.load("m").count() == 5 and at.exists()
    assert table.compact() and table.load("m").count() == 5
    assert [p.name for p in tmp_path.iterdir() if p.is_dir()] == ["cache"]


def test_pairs_with_an_empty_side_are_skipped(spark):
    files = _files(spark, "a/x.py", content="").union(spark.createDataFrame([("B", "k/q.py", "k", "go", 1, "z"), ("B", "k/n.py", "k", "go", 0, None)], FILES))
    pairs = spark.createDataFrame([("a/x.py", "k/q.py", 1)], "file_a string, file_b string, ord int")
    keyed = comparing.keyed_pairs(pairs, files, "m", 20)
    assert keyed.first()["skip"]
    assert {r["status"]: r["n"] for r in comparing.pair_status(keyed, keyed.filter(F.lit(False))).collect()} == {"skipped": 1}
