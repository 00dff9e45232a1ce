"""Files and directories to summarise: distinct contents, prompts' blocks, budgets and bins."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDER_FILE, content_hash
from ..functions.tokenizers import DIR_INPUT, PatternTokenizer, token_count


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", content_hash(F.col("content"), F.col("language")))


def distinct_contents(files: DataFrame) -> DataFrame:
    """(hash, repo, path, n_files): one row for each content and language; the first path of the first tree stands for all."""
    return hashed(files).groupBy("hash").agg(F.min(F.struct("repo", "path")).alias("f"), F.count("*").alias("n_files")).select("hash", "f.repo", "f.path", "n_files")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key the cache doesn't hold."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


def last_wins(records: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of the records with one key, the last."""
    rest = [c for c in records.columns if c not in key]
    best = records.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def fan_out(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """(repo, path, summary) of every file; a missing or failed summary is the placeholder."""
    joined = hashed(files).select("repo", "path", "hash").join(summaries.select("hash", "summary"), "hash", "left")
    return joined.select("repo", "path", F.coalesce("summary", F.lit(PLACEHOLDER_FILE)).alias("summary"))


def file_block(path: Column, language: Column, lines: Column, content: Column) -> Column:
    """A file in a prompt: a head line and the fenced content."""
    return F.concat(F.lit("File "), path, F.lit(" ["), language, F.lit(", "), lines.cast("string"), F.lit(" lines]\n```\n"), content, F.lit("\n```"))


def summary_block(path: Column, language: Column, lines: Column, summary: Column) -> Column:
    return F.concat(F.lit("== "), path, F.lit(" ["), language, F.lit(", "), lines.cast("string"), F.lit(" lines]\n"), summary)


def prepared(files: DataFrame, summaries: DataFrame, tokenizer=PatternTokenizer()) -> DataFrame:
    """(repo, dir, path, display_path, language, line_count, summary, tokens) of each file, as its directory's prompt shows it."""
    joined = files.select("repo", "dir", "path", "language", "line_count").join(summaries, ["repo", "path"], "left")
    summary = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.lit(PLACEHOLDER_FILE))
    shown = F.when(F.col("dir") == "", F.col("path")).otherwise(F.substr("path", F.length("dir") + 2))
    return joined.select("repo", "dir", "path", shown.alias("display_path"), "language", "line_count", summary.alias("summary"), token_count(summary, tokenizer).alias("tokens"))


def dir_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo", "dir").agg(F.count("*").alias("n_files"), F.sum("line_count").cast("long").alias("n_lines"), F.sum("tokens").cast("long").alias("n_tokens"))


def budgeted(totals: DataFrame, children: DataFrame, budget: int = DIR_INPUT) -> DataFrame:
    """``totals`` with child_tokens, mode (single or chunked) and crowded (children take over half).  ``children``: repo, dir, child_tokens."""
    joined = totals.join(children, ["repo", "dir"], "left").withColumn("child_tokens", F.coalesce("child_tokens", F.lit(0)).cast("long"))
    return joined.withColumn("mode", F.when(F.col("n_tokens") + F.col("child_tokens") <= budget, "single").otherwise("chunked")).withColumn("crowded", F.col("child_tokens") * 2 > budget)


def first_fit(sizes: Iterable[int], budget: int) -> list[int]:
    """Bin of each size, in the order given; a size over the budget has a bin of its own."""
    loads: list[int] = []
    out = []
    for n in sizes:
        k = next((i for i, load in enumerate(loads) if load + n <= budget), len(loads))
        if k == len(loads):
            loads.append(0)
        loads[k] += n
        out.append(k)
    return out


def ffd_bins(rows: DataFrame, budget: int = DIR_INPUT) -> DataFrame:
    """(repo, dir, path, bin) by first fit of decreasing tokens, ties by path; a directory's files are one group of short rows."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "path"], ascending=[False, True], kind="stable")
        return pdf[["repo", "dir", "path"]].assign(bin=first_fit(pdf["tokens"], budget))

    return rows.select("repo", "dir", "path", "tokens").groupBy("repo", "dir").applyInPandas(pack, "repo string, dir string, path string, bin int")


def blocks_of(rows: DataFrame, keys: list[str], order: str, block: Column, empty: str) -> DataFrame:
    """One text a key: its blocks in order, blank lines between."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return rows.groupBy(*keys).agg(F.coalesce(F.nullif(F.array_join(F.transform(lines, lambda x: x["b"]), "\n\n"), F.lit("")), F.lit(empty)).alias("text"))
