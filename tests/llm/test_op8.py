from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graftwood.llm.cotrain import CoTraining, keep_good, logistic, score, sigmoid
from graftwood.llm.scratch import bounded_batches


def test_newton_fit_is_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < sigmoid(x @ [2.0, -1.0, 0.0] + 0.5)).astype(float)
    w = logistic(x, y, 1e-3)
    slope = np.hstack((x, np.ones((400, 1)))).T @ (sigmoid(x @ w[:-1] + w[-1]) - y) / 400 + np.array([1e-3, 1e-3, 1e-3, 1e-9]) * w
    assert np.abs(slope).max() < 1e-3 and w[0] > 1 and w[1] < -0.5


def test_held_out_accuracy(spark):
    """Fitted on four of five labels of a larger table, and judged on the rest."""
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(5)) == 0
    rows = score(docs.join(labels.select("doc_id"), "doc_id"), labels.filter(~held)).join(labels.filter(held), "doc_id").toPandas()
    good = (rows["quality"] == 1) & (rows["toxic"] == 0)
    assert len(rows) > 500 and (rows["kept"] == good).mean() > 0.98
    assert rows["kept"][good].mean() > 0.99 and 1 - rows["kept"][~good].mean() > 0.95
    assert abs(rows["score"].mean() - good.mean()) < 0.03
    assert rows[["p_text", "p_meta", "score"]].stack().between(0, 1).all()


def test_the_pool_teaches_both_views(documents, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    a = score(documents, labels).toPandas().set_index("doc_id").sort_index()
    b = score(documents, labels, CoTraining(rounds=0)).toPandas().set_index("doc_id").sort_index()
    assert len(a) == documents.count() and not np.allclose(a["p_text"], b["p_text"]) and not np.allclose(a["p_meta"], b["p_meta"])


@pytest.mark.parametrize("given", ["labels", "none", "one class"])
def test_edges(spark, edges, sf, given):
    labels = spark.createDataFrame([(k, k % 2, 0 if k % 3 else None, "clash") for k in range(1, 10)] + [(None, 1, 0, "c"), (1, 0, 0, "c"), (2, None, 1, "c")] + [(k, k % 2, 0, "c") for k in range(1000, 1040)], "doc_id long, quality int, toxic int, text string")
    labels = {"labels": labels, "none": labels.limit(0), "one class": labels.filter("quality = 1")}[given]
    more = spark.createDataFrame([(k, ("good words flow along here " if k % 2 else "$$$ ### junk ") * 9) for k in range(1000, 1040)], "doc_id long, text string")
    docs = edges.unionByName(more, allowMissingColumns=True)
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    if given != "labels":
        assert all(r["kept"] for r in rows)
    else:
        assert all(r["kept"] == (r["doc_id"] % 2 == 1) for r in rows if (r["doc_id"] or 0) >= 1000)
    assert score(docs.limit(0), labels).count() == 0 and keep_good(docs.limit(0), labels).count() == 0


def test_missing_metadata_columns(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert score(docs, labels).count() == docs.count()


def test_whole_texts_are_not_read_again_to_judge_them(spark, documents, sf):
    """Rejected and kept rows are told apart by their features; texts meet Python in the pass that makes these, a few megabytes at a time."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, labels = spark.conf.get(limit), spark.read.parquet(f"{sf}/labels.parquet")
    docs = documents.union(documents.limit(20)).union(documents.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and spark.conf.get(limit) == before
    python = [line for line in kept._jdf.queryExecution().executedPlan().toString().split("\n") if "Python" in line or "InArrow" in line]
    assert python and not any("InArrow" in line for line in python)
    assert all("text" not in line[line.index("(") : line.index(")#")] for line in python)
    key = lambda r: (r["doc_id"] or -1, bool(r["kept"]))
    want = sorted(key(r) for r in score(docs, labels).collect() if r["kept"])
    assert sorted((r["doc_id"] or -1, True) for r in kept.collect()) == want


def test_python_gets_bounded_batches(spark):
    rows = spark.range(64, numPartitions=1).selectExpr("repeat('word ', 100000) AS text")
    sizes = lambda: [r["n"] for r in rows.mapInArrow(lambda bs: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect()]
    with bounded_batches(spark):
        some = sizes()
    assert max(some) < 6e6 and sum(some) > 32e6 and max(sizes()) > 30e6
