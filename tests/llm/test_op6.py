from __future__ import annotations

import re

import pytest

from graftwood.llm.decontaminate import Decontamination, contaminated

ITEMS = [
    (1, "A shop sells apples to Maria Lopez for 3 dollars each and then it buys 12 kg of pears from Ben because Maria Lopez wants them before 3 weeks pass."),
    (2, "the quick onset of rain made every harvester stop before the fields were done"),
    (3, "tiny item"),
    (4, None),
    (None, "nobody can name this item although it is long enough to match a text"),
]
OTHER = ITEMS[0][1].replace("Maria Lopez", "Ann Smith").replace("3", "7").replace("12 kg", "45 kg").replace("Ben", "Tom")
FILL = "Some words stand before it, and here they end. "


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in ITEMS], "item_id long, text string, hash string, doc_id string")


def found(spark, bench, *texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench, Decontamination(**more)).collect()}


@pytest.mark.parametrize("p", [{}, {"broadcast_rows": 0}])
def test_re_parameterised_questions(spark, bench, p):
    wrong = OTHER.replace("7 weeks", "8 weeks").replace("because Ann Smith", "because Eve Stone")
    got = found(spark, bench, FILL + ITEMS[0][1], FILL + OTHER + " More follows.", FILL + wrong, "unrelated words only stand in this text", ITEMS[1][1].upper() + "!!", ITEMS[1][1].title(), FILL + ITEMS[0][1].lower(), ITEMS[0][1].upper(), "Tiny item.", "a tiny item more", "", None, **p)
    assert got == {(0, 1), (1, 1), (4, 2), (5, 2), (6, 1), (7, 1), (8, 3)}


def test_units_and_numbers_of_other_forms(spark, bench):
    text = OTHER.replace("7 dollars", "1,250.50 euros").replace("7 weeks", "1,250.50 days").replace("45 kg", "45kg")
    assert found(spark, bench, text) == {(0, 1)}


def test_part_of_an_item_is_not_the_item(spark, bench):
    half = " ".join(ITEMS[1][1].split()[:8])
    assert found(spark, bench, half) == set()


ALICE = "Alice has 5 apples. Alice buys 3 more. How many apples does Alice have?"


def test_names_that_open_sentences(spark):
    bench = spark.createDataFrame([(1, ALICE), (2, "Every morning Carla and Dieter bake 24 rolls. Carla sells 6 of them at the market. How many rolls are left for Dieter?")], "item_id long, text string")
    other = ALICE.replace("Alice", "Bob").replace("5", "7").replace("3", "9")
    torn = other.replace("Bob buys", "Eve buys")
    quoted = "He asked: \"Zoe has 2 apples. Zoe buys 31 more. How many apples does Zoe have?\" Nobody knew."
    second = "Every morning Ugo and Pia bake 36 rolls. Ugo sells 8 of them at the market. How many rolls are left for Pia?"
    got = found(spark, bench, ALICE, other, torn, quoted, "1. " + other, second, ALICE.lower(), "Apples have many buyers. How many apples does the shop have?")
    assert got == {(0, 1), (1, 1), (3, 1), (4, 1), (5, 2), (6, 1)}


def test_items_of_few_words_are_found_whole(spark):
    bench = spark.createDataFrame([(1, "What is 15 + 27?"), (2, "Add 3, 5, 7 and 9 to 12 km"), (3, "Yes or no"), (4, "no way")], "item_id long, text string")
    got = found(spark, bench, "Some say: what is 15 + 27? It is 42.", "What is 15 + 28?", "Please add 3, 5, 7 and 9 to 12 km now.", "Add 3, 5, 7 and 8 to 12 km", "It is yes or no today", "there is no way out", "No way!", "WHAT IS 15 + 27", "Then What Is 15 + 27? Nobody")
    # a text of the same template and no more is caught with other numbers too
    assert got == {(0, 1), (1, 1), (2, 2), (4, 3), (6, 4), (7, 1), (8, 1)}
    assert found(spark, bench, "Some say: what is 15 + 27? It is 42.", broadcast_rows=0) == {(0, 1)}


def test_brute_force_over_given_tables(spark, sf, documents, texts):
    """Documents that hold every five words of an item are found, and nothing that shares under half of them."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda t: {tuple(w[k : k + 5]) for w in [words(t)] for k in range(len(w) - 4)}
    items = {r["item_id"]: grams(r["text"]) for r in bench.collect()}
    share = {}
    for i, t in texts.items():
        own = grams(t)
        share |= {(i, j): len(own & g) / len(g) for j, g in items.items() if own & g}
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(documents, bench).collect()}
    assert {k for k, s in share.items() if s > 0.9} <= got <= {k for k, s in share.items() if s > 0.5} and got


def test_edges(spark, edges, bench):
    assert contaminated(edges, bench).count() == 0
    held = spark.createDataFrame([(6, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    assert {r["doc_id"] for r in contaminated(edges, held).collect()} == {1, 2}
    assert contaminated(edges.limit(0), bench).count() == 0 and contaminated(edges, bench.limit(0)).count() == 0
    twice = edges.union(edges)
    assert contaminated(twice, held.union(held)).count() == 2


def test_no_python_in_the_plan(edges, bench):
    plan = contaminated(edges, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_long_runs_overflow_no_stack(spark, bench):
    hard = ["then " + "Abc " * 80_000, "1.1" * 100_000, "1 kg " * 60_000, "Ab-" * 100_000, "\u0001" * 100_000]
    assert found(spark, bench, *hard) == set()
