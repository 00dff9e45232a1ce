"""Directories of two trees, matched one to one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest16, digest_lanes, jaccard, multiset_digest, name_ratio, summary_text, tokens, two_decimals

LEAST_SCORE = 0.22
NAME_WEIGHT, TOKEN_WEIGHT = 0.35, 0.65


def without_root(dirs: DataFrame) -> DataFrame:
    """A tree without folders matches nothing: its only directory is the root."""
    return dirs.filter("dir <> ''")


def dir_tokens(summaries: DataFrame) -> DataFrame:
    """(repo, dir, token), distinct.  ``summaries``: repo, dir, summary."""
    return summaries.select("repo", "dir", F.explode(tokens(summary_text(F.col("summary")))).alias("token")).distinct()


def shared_tokens(words: DataFrame) -> DataFrame:
    """(dir_a, dir_b, common, size_a, size_b) of pairs that share a token, through the token index."""
    sizes = words.groupBy("repo", "dir").agg(F.count("*").alias("n"))
    a = words.filter("repo = 'A'").select(F.col("dir").alias("dir_a"), "token")
    b = words.filter("repo = 'B'").select(F.col("dir").alias("dir_b"), "token")
    common = a.join(b, "token").groupBy("dir_a", "dir_b").agg(F.count("*").alias("common"))
    size = lambda r, k: sizes.filter(F.col("repo") == r).select(F.col("dir").alias(f"dir_{k}"), F.col("n").alias(f"size_{k}"))
    return common.join(size("A", "a"), "dir_a").join(size("B", "b"), "dir_b")


def dir_jaccard(words: DataFrame, least: float = 0.0) -> DataFrame:
    """(dir_a, dir_b, jaccard) of pairs with a common token."""
    scored = shared_tokens(words).select("dir_a", "dir_b", jaccard(F.col("common"), F.col("size_a"), F.col("size_b")).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= least)


def similarities(summaries: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(dir_a, dir_b, name_score, jaccard, score) of all pairs of at least that score, which is above 0.

    A pair has a common token, and then the token index finds it, or its names alone
    reach the score; that needs lengths near each other, so names meet by an equality
    of lengths.  The exact ratio of names runs in Python only where its upper bound
    by lengths can still reach the least score.
    """
    overlap = dir_jaccard(dir_tokens(summaries))
    long = lambda c: F.greatest(F.length(c), F.when(c == "", 4).otherwise(1))
    side = lambda r, k: summaries.filter(F.col("repo") == r).select(F.col("dir").alias(f"dir_{k}"), long(F.col("dir")).alias(f"len_{k}"))
    ratio = max(least / NAME_WEIGHT, 0.01)
    a = side("A", "a")
    if ratio <= 1:
        low, high = F.ceil(F.col("len_a") * (ratio / (2 - ratio)) - 1e-6), F.floor(F.col("len_a") * ((2 - ratio) / ratio) + 1e-6)
        named = a.withColumn("len_b", F.explode(F.sequence(low.cast("int"), high.cast("int")))).join(side("B", "b"), "len_b").select("dir_a", "dir_b", F.lit(0.0).alias("jaccard"))
        pairs = overlap.union(named).groupBy("dir_a", "dir_b").agg(F.max("jaccard").alias("jaccard"))
    else:
        pairs = overlap
    la, lb = long(F.col("dir_a")), long(F.col("dir_b"))
    bound = F.lit(2.0) * F.least(la, lb) / (la + lb)
    possible = pairs.filter(bound * NAME_WEIGHT + F.col("jaccard") * TOKEN_WEIGHT >= least - 1e-9)
    scored = possible.withColumn("name_score", name_ratio("dir_a", "dir_b")).withColumn("score", F.col("name_score") * NAME_WEIGHT + F.col("jaccard") * TOKEN_WEIGHT)
    return scored.filter(F.col("score") >= least).select("dir_a", "dir_b", "name_score", "jaccard", "score")


#: Candidates that one task may go through in order.
ONE_TASK = 200_000


def _one_pass(candidates: DataFrame, rank: list[Column]) -> DataFrame:
    """Greedy assignment in one task, best first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used_a, used_b = set(), set()
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["dir_a"], pdf["dir_b"], strict=True):
                free = a not in used_a and b not in used_b
                keep.append(free)
                if free:
                    used_a.add(a)
                    used_b.add(b)
            yield pdf[keep]

    return candidates.coalesce(1).sortWithinPartitions(*rank).mapInPandas(run, candidates.schema)


def greedy(candidates: DataFrame, rank: list[Column], cut: Callable[[DataFrame], DataFrame], one_task: int = ONE_TASK) -> DataFrame:
    """Greedy one-to-one assignment by a strict order of the candidates.

    While there are more than ``one_task`` of them, the pairs that come first for
    both their sides are taken in a round, and what touches them goes; under a
    strict order this is what one pass through the ordered list takes.  The rest is
    that pass.  Only counts reach the driver.  ``cut`` writes a table out and reads
    it back.
    """
    names = candidates.columns
    rest = cut(candidates)
    kept = None
    while True:
        n = rest.count()
        if n <= one_task:
            best = cut(_one_pass(rest, rank)) if n else rest
            return best if kept is None else kept.union(best)
        first = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(*rank))
        best = cut(rest.withColumn("__a", first("dir_a")).withColumn("__b", first("dir_b")).filter("__a = 1 and __b = 1").select(*names))
        kept = best if kept is None else kept.union(best)
        rest = cut(rest.join(best.select("dir_a"), "dir_a", "left_anti").join(best.select("dir_b"), "dir_b", "left_anti").select(*names))


def numbered(df: DataFrame, order: list[str], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``number``, its place in the order from 0 on, by ranges: no task sorts more than one of them."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    # one row a range
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    inside = placed.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return inside.join(F.broadcast(before), "__p").withColumn("number", F.col("__before") + F.col("__k") - 1).drop("__p", "__k", "__before")


def confidence(score: Column) -> Column:
    return F.when(score >= 0.55, "high").when(score >= 0.40, "medium").otherwise("low")


def heuristic_matches(scored: DataFrame, cut: Callable[[DataFrame], DataFrame], one_task: int = ONE_TASK) -> DataFrame:
    """(dir_a, dir_b, confidence, reason, score): greedy by score, ties by the names of A, then B."""
    best = greedy(scored.select("dir_a", "dir_b", "score"), [F.desc("score"), F.asc("dir_a"), F.asc("dir_b")], cut, one_task)
    return best.select("dir_a", "dir_b", confidence(F.col("score")).alias("confidence"), F.concat(F.lit("heuristic score "), two_decimals("score")).alias("reason"), "score")


def confidence_rank(level: Column) -> Column:
    return F.when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0)


def one_to_one(matches: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replies of several batches (ord, dir_a, dir_b, confidence, reason) as a one-to-one match: by confidence, then the order given."""
    return greedy(matches, [F.desc(confidence_rank(F.col("confidence"))), F.asc("ord")], cut)


def batches(summaries: DataFrame, size: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(repo, dir, batch): slices of ``size`` in the order of the names; size <= 0: one batch."""
    if size <= 0:
        return summaries.select("repo", "dir", F.lit(0).alias("batch"))
    placed = cut(numbered(summaries.select("repo", "dir"), ["repo", "dir"], cut))
    first = placed.groupBy("repo").agg(F.min("number").alias("__first"))
    return placed.join(F.broadcast(first), "repo").select("repo", "dir", F.floor((F.col("number") - F.col("__first")) / size).cast("int").alias("batch"))


def match_key(summaries: DataFrame, model: str, batch_size: int) -> DataFrame:
    """One row: the key of a whole match, over the digests of all summaries, which add up."""
    entry = F.concat("repo", F.lit("\n"), "dir", F.lit("\n"), F.sha2(F.coalesce("summary", F.lit("")), 256))
    lanes = summaries.select(*digest_lanes(entry)).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"lane{k}"), F.lit(0)).alias(f"lane{k}") for k in range(4)))
    return lanes.select(digest16(F.lit(f"match2|{model}|{batch_size}"), multiset_digest([F.col(c) for c in lanes.columns])).alias("match_key"))


def summary_lines(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One text a key: ``[dir]: summary`` lines in the order of the names; the root is shown as (root)."""
    label = F.when(F.col("dir") == "", "(root)").otherwise(F.col("dir"))
    rows = F.array_sort(F.collect_list(F.struct("dir", F.concat(F.lit("["), label, F.lit("]: "), "summary").alias("line"))))
    return summaries.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


def valid_matches(replies: DataFrame, dirs: DataFrame) -> DataFrame:
    """Matches whose directories exist in their trees; a missing or root directory is refused, missing confidence is medium."""
    trim = lambda c: F.trim(F.coalesce(c, F.lit("")))
    named = replies.withColumns({"dir_a": trim(F.col("dir_a")), "dir_b": trim(F.col("dir_b")), "confidence": F.coalesce("confidence", F.lit("medium")), "reason": F.coalesce("reason", F.lit(""))})
    side = lambda r, k: without_root(dirs).filter(F.col("repo") == r).select(F.col("dir").alias(f"dir_{k}"))
    return named.join(side("A", "a"), "dir_a", "left_semi").join(side("B", "b"), "dir_b", "left_semi").select("ord", "dir_a", "dir_b", "confidence", "reason")
