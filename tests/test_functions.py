from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graftwood.functions import text as fx
from graftwood.functions.replies import extract_json, message_text
from graftwood.functions.tokenizers import PatternTokenizer, token_count, truncate, truncated


@pytest.mark.parametrize(
    "reply,value",
    [
        ("", {}),
        ("  \n", {}),
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('Sure:\n```\n[1, 2]\n```\nDone', [1, 2]),
        ('text {"a": "}{", "b": "\\"}"} more {"c": 2}', {"a": "}{", "b": '"}'}),
        ("list: [1, [2]] end", [1, [2]]),
        ("7", 7),
    ],
)
def test_json_of_replies(reply, value):
    assert extract_json(reply) == value


@pytest.mark.parametrize("reply", ["no json", '{"a": 1', "{'a': 1}"])
def test_replies_without_json(reply):
    with pytest.raises(ValueError):
        extract_json(reply)


def test_message_text():
    assert message_text({"content": "x"}) == "x"
    assert message_text({"content": [{"text": "a"}, {"other": 1}, "z", {"text": "b"}]}) == "ab"
    assert message_text(None) == "" and message_text({"content": None}) == ""


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80), st.integers(-1, 30))
def test_truncation_keeps_head_and_tail(text, most):
    tok = PatternTokenizer()
    cut, was = truncate(text, most)
    n = len(tok.encode(text))
    assert was == (0 < most < n)
    if was:
        half = max(1, most // 2)
        assert cut.startswith(tok.decode(tok.encode(text)[:half])) and cut.endswith(tok.decode(tok.encode(text)[-half:]))
        assert f"truncated {n - 2 * half} tokens" in cut
    else:
        assert cut == text


def test_native_truncation_equals_python(spark):
    texts = ["", "one two three", "a b c d e f g h i j", "x1y2\nz3!!", "ü ñ 12 ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (0, 1, 4, 5, 100):
        got = {r["t"]: (r["c"]["text"], r["c"]["truncated"]) for r in df.select("t", truncated(F.col("t"), most).alias("c")).collect()}
        assert got == {t: truncate(t, most) for t in texts}
    assert {r["t"]: r["n"] for r in df.select("t", token_count(F.col("t")).alias("n")).collect()} == {t: len(PatternTokenizer().encode(t)) for t in texts}


def test_name_ratio_is_difflibs_and_not_symmetric(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("src/api", "src/apis"), ("a" * 250, "a" * 240 + "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["r"] for r in df.select(fx.name_ratio("a", "b").alias("r")).collect()]
    assert got == [SequenceMatcher(None, a or "root", b or "root").ratio() for a, b in pairs]
    assert got[0] != got[1]


def test_two_decimals_as_python(spark):
    values = [0.345, 0.125, 0.5, 1.0, 0.995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["s"] for r in df.select(fx.two_decimals("v").alias("s")).collect()] == [f"{v:.2f}" for v in values]


def test_tokens(spark):
    df = spark.createDataFrame([("The the ab abc_1 Über naïve X9Z",)], "t string")
    assert set(df.select(fx.tokens(df["t"]).alias("k")).first()["k"]) == {"the", "abc_1", "ber", "x9z"}


def test_summary_text(spark):
    made = ['{"purpose": "p", "key_exports": ["a", "b"], "frameworks": [], "patterns": ["q"], "children_overview": ""}', "plain words", '{"purpose": 5}', ""]
    df = spark.createDataFrame([(s,) for s in made], "s string")
    got = [r["t"] for r in df.select(fx.summary_text(df["s"]).alias("t")).collect()]
    assert got[0] == "p a b q" and got[1] == "plain words" and got[3] == ""


def test_parents(spark):
    df = spark.createDataFrame([("a/b/c",), ("a",), ("",)], "p string")
    assert [r["q"] for r in df.select(fx.parent_dir(df["p"]).alias("q")).collect()] == ["a/b", "", ""]


def test_decode():
    assert fx.decode(b"a\r\nb\rc\xff\n") == "a\nb\nc\n"


def test_hash_ignores_the_path_but_not_the_language(spark):
    df = spark.createDataFrame([("x", "go"), ("x", "java"), ("x", "go")], "c string, l string")
    h = [r["h"] for r in df.select(fx.content_hash(df["c"], df["l"]).alias("h")).collect()]
    assert h[0] == h[2] != h[1] and all(len(x) == 16 for x in h)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30))
def test_first_fit_decreasing(sizes):
    from graftwood.operators.summaries import first_fit

    ordered = sorted(sizes, reverse=True)
    bins = first_fit(ordered, 25)
    loads = reduce(lambda d, x: d | {x[1]: d.get(x[1], 0) + x[0]}, zip(ordered, bins, strict=True), {})
    assert sum(loads.values()) == sum(sizes)
    assert all(load <= 25 or bins.count(b) == 1 for b, load in loads.items())
    assert sorted(loads) == list(range(len(loads)))
