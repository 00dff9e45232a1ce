"""What asking the model costs does not grow with what is asked for."""

from __future__ import annotations

import pandas as pd

from graftwood.backends.base import ReplayBackend
from graftwood.backends.offline import OfflineBackend
from graftwood.config import CompareConfig
from graftwood.operators import comparing
from graftwood.plans import replayed
from graftwood.plans.compare import Comparison

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _documents(spark, at, rows: list[tuple]) -> str:
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_a_folder_of_many_files_is_summarised_in_parts(spark, duck, tmp_path, same_rows):
    sf = _documents(spark, tmp_path, [(2 * k, f"text {k}", "en", "src0", 6) for k in range(9000)] + [(1, "b", "de", "src1", 1)])
    got = replayed.replayed_dir_summaries(spark, sf).toPandas()
    assert len(got) == 6 and set(got["summary"]) == {replayed.DIR_REPLY} and not got["degraded"].any()


def test_python_is_handed_a_few_megabytes_at_a_time(spark, tmp_path, monkeypatch):
    from graftwood.plans import compare

    seen, answer_all = [], compare.answer_all

    def counted(requests, *more):
        def sizes(batches):
            for pdf in batches:
                yield pd.DataFrame({"n": [int(pdf["user"].str.len().sum())]})

        seen.append(max(r["n"] for r in requests.coalesce(1).mapInPandas(sizes, "n long").collect()))
        return answer_all(requests, *more)

    monkeypatch.setattr(compare, "answer_all", counted)
    run = Comparison(spark, CompareConfig(output_dir=str(tmp_path / "out"), flush_every=1_000_000), lambda parts: ReplayBackend({"file_summary": "{}"}))
    before = spark.conf.get(BYTES)
    answers = run.ask(spark.range(400).selectExpr("cast(id as string) as id", "'file_summary' as kind", "'s' as system", "repeat('x', 100000) as user"))
    assert answers.count() == 400 and len(seen) == 1 and seen[0] < 8_000_000
    assert spark.conf.get(BYTES) == before


def test_prompts_of_large_turns_are_never_written(spark, tmp_path, monkeypatch, same_rows):
    files = spark.createDataFrame([(r, f"{d}/f{k}", d, "go", 1, "" if k == 3 else f"{r}{k}" * 9) for r in "AB" for d in "xy" for k in range(6)], "repo string, path string, dir string, language string, line_count int, content string")
    matches = spark.createDataFrame([(1, "x", "y"), (2, "y", "y")], "ord int, dir_a string, dir_b string")
    cut, written, got = Comparison.cut, [], []
    monkeypatch.setattr(Comparison, "cut", lambda self, df: written.append(df.columns) or cut(self, df))
    for flush in (1_000_000, 7):
        run = Comparison(spark, CompareConfig(output_dir=str(tmp_path / f"out{flush}"), flush_every=flush), lambda parts: OfflineBackend())
        got.append(run.compare(comparing.file_pairs(matches, files), files).toPandas())
        assert run.calls == 50 and any("user" in c for c in written) == (flush == 7)
    assert len(got[0]) == 72 and set(got[0]["status"]) == {"new", "skipped"}
    same_rows(*got)
