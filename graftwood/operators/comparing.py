"""File pairs below matched directories, and what a comparison's reply says about them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_sha, pair_key
from ..schema import DIMENSIONS, LEVELS, WEIGHTS
from ..streaming.workspace import dealt_by_part_of_keys
from .tree import ancestors

#: Files of one folder and tree that stand in one row while pairs are dealt out.
BLOCK = 1024
#: Pairs that one task unfolds, where there are enough of them.
PAIRS_A_TASK = 4_000_000
#: What rows of pairs are dealt by: a hash of the blocks that they come from.
DEALT = "block"


def folder_pairs(matches: DataFrame, files: DataFrame) -> DataFrame:
    """(dir_a, dir_b, ord): folders of files that lie below matched directories; ord is the first match that pairs them.

    Folders meet the matches by equality on each of their ancestors; files stay behind.
    """
    below = files.select("repo", "dir").distinct().select("repo", "dir", F.explode(ancestors(F.col("dir"))).alias("up"))
    side = lambda r, k: below.filter(F.col("repo") == r).select(F.col("dir").alias(f"from_{k}"), F.col("up").alias(f"dir_{k}"))
    met = matches.select("ord", "dir_a", "dir_b").join(side("A", "a"), "dir_a").join(side("B", "b"), "dir_b")
    return met.groupBy(F.col("from_a").alias("dir_a"), F.col("from_b").alias("dir_b")).agg(F.min("ord").alias("ord"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(repo, dir, block, rows): the rows (repo, dir, path, ...) of a folder in about ``size`` each, dealt by their paths."""
    counts = rows.groupBy("repo", "dir").agg(F.ceil(F.count("*") / size).cast("int").alias("__n"))
    dealt = rows.join(counts, ["repo", "dir"]).withColumn("__k", F.pmod(F.xxhash64("path"), F.col("__n")))
    rest = [c for c in rows.columns if c not in ("repo", "dir")]
    return dealt.groupBy("repo", "dir", "__k").agg(F.collect_list(F.struct(*rest)).alias("rows")).select("repo", "dir", F.concat_ws("/", "dir", "__k").alias("block"), "rows")


def met_rows(matches: DataFrame, rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(ord, block, a, b): each row (repo, dir, path, ...) of A with each of B, where their folders are paired.

    There are far more pairs than files, so no pair goes through a shuffle: blocks of
    files meet, the pairs of blocks are dealt out, and each is unfolded where it lies.
    The rows stay dealt by ``DEALT``.
    """
    spark = rows.sparkSession
    blocks, folders = _blocks(rows, size), folder_pairs(matches, rows)
    side = lambda r, k: blocks.filter(F.col("repo") == r).select(F.col("dir").alias(f"dir_{k}"), F.col("block").alias(f"block_{k}"), F.col("rows").alias(f"rows_{k}"))
    met = folders.join(side("A", "a"), "dir_a").join(side("B", "b"), "dir_b")
    # a number of its own: short rows unfold to long work, which the sizes of the shuffle don't show
    n = rows.groupBy("repo", "dir").agg(F.count("*").alias("n"))
    sizes = lambda r, k: n.filter(F.col("repo") == r).select(F.col("dir").alias(f"dir_{k}"), F.col("n").alias(f"n_{k}"))
    pairs = folders.join(sizes("A", "a"), "dir_a").join(sizes("B", "b"), "dir_b").agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-pairs // PAIRS_A_TASK))
    met = met.select("ord", F.xxhash64("block_a", "block_b").alias(DEALT), "rows_a", "rows_b").repartition(parts, DEALT)
    return met.select("ord", DEALT, "rows_b", F.explode("rows_a").alias("a")).select("ord", DEALT, "a", F.explode("rows_b").alias("b"))


def code_blocks(files: DataFrame, cut: Callable[[DataFrame], DataFrame], size: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """(repo, block, codes: list of path and content) of about ``size`` characters in one folder, and (repo, path, block, pos), each file's place in them."""
    rows = files.select("repo", "dir", "path", "content")
    counts = rows.groupBy("repo", "dir").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("content")) / size)).cast("int").alias("__n"))
    dealt = rows.join(counts, ["repo", "dir"]).withColumn("block", F.concat_ws("/", "dir", F.pmod(F.xxhash64("path"), F.col("__n"))))
    codes = cut(dealt.groupBy("repo", "block").agg(F.collect_list(F.struct("path", "content")).alias("codes")))
    places = codes.select("repo", "block", F.posexplode("codes.path").alias("pos", "path"))
    return codes, cut(places.select("repo", "path", "block", "pos"))


def file_pairs(matches: DataFrame, files: DataFrame) -> DataFrame:
    """(file_a, file_b, ord): distinct pairs of files below matched directories; ord is the first match that pairs them.

    Contents stay behind.  ``matches``: ord, dir_a, dir_b.
    """
    met = met_rows(matches, files.select("repo", "dir", "path").distinct())
    return met.select(F.col("a.path").alias("file_a"), F.col("b.path").alias("file_b"), "ord")


def _digests(files: DataFrame) -> DataFrame:
    """(repo, dir, path, sha, empty): only digests of contents travel."""
    content = F.coalesce("content", F.lit(""))
    return files.select("repo", "dir", "path", content_sha(content).alias("sha"), (content == "").alias("empty"))


def keyed_pairs(pairs: DataFrame, files: DataFrame, model: str, threshold: int) -> DataFrame:
    """Given pairs with their key and whether one side is empty."""
    known = _digests(files)
    side = lambda r, k: known.filter(F.col("repo") == r).select(F.col("path").alias(f"file_{k}"), F.col("sha").alias(f"sha_{k}"), F.col("empty").alias(f"empty_{k}"))
    joined = pairs.join(side("A", "a"), "file_a").join(side("B", "b"), "file_b")
    key = pair_key(F.col("file_a"), F.col("sha_a"), F.col("file_b"), F.col("sha_b"), model, threshold)
    return joined.select(*pairs.columns, key.alias("key"), (F.col("empty_a") | F.col("empty_b")).alias("skip"))


def keyed_file_pairs(matches: DataFrame, files: DataFrame, model: str, threshold: int) -> DataFrame:
    """(file_a, file_b, ord, key, skip, block): ``keyed_pairs`` of ``file_pairs``, with the digests in the blocks, so that no pair is joined; rows are dealt by ``DEALT``."""
    met = met_rows(matches, _digests(files))
    key = pair_key(F.col("a.path"), F.col("a.sha"), F.col("b.path"), F.col("b.sha"), model, threshold)
    return met.select(F.col("a.path").alias("file_a"), F.col("b.path").alias("file_b"), "ord", key.alias("key"), (F.col("a.empty") | F.col("b.empty")).alias("skip"), DEALT)


def pair_status(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """(status, n): skipped (a side is empty), cached or new.

    A cache that is dealt by ``DEALT`` like the pairs, as a part of them is, meets
    them where they lie, and the counts are taken at once; any other is shuffled by its keys.
    """
    dealt = DEALT in keyed.columns and DEALT in cache.columns
    on = [DEALT, "key"] if dealt else ["key"]
    had = cache.select(*on).distinct().withColumn("__had", F.lit(True))
    status = F.when(F.col("skip"), "skipped").when(F.col("__had"), "cached").otherwise("new")
    met = lambda had: keyed.select(*on, "skip").join(had, on, "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    if not dealt:
        return met(had)
    spark = keyed.sparkSession
    with dealt_by_part_of_keys(spark):
        counts = met(had.hint("shuffle_hash")).collect()
    return spark.createDataFrame(counts, "status string, n long")


_ITEM = f"struct<func_a: variant, func_b: variant, scores: struct<{', '.join(f'{d}: variant' for d in DIMENSIONS)}>, composite_score: variant, similarity_level: variant, analysis: variant>"


def _integer(value: Column) -> tuple[Column, Column]:
    """(value, fine): an absent number is 0, one that can't become an integer spoils its item."""
    number = F.try_variant_get(value, "$", "long")
    return F.when(value.isNull(), 0).otherwise(number), value.isNull() | number.isNotNull()


def parse_similar(replies: DataFrame, threshold: int | None = None) -> DataFrame:
    """(ord, file_a, file_b, pos, name_a, ... analysis): one row for each sound item of the replies (ord, file_a, file_b, reply).

    Files are those of the request.  Scores are made integers as Python makes
    them; an item without func_a or func_b, or with a score that is no number, is
    dropped; an unknown level is very_low.  ``threshold``: also drop items with a
    lower composite score (off by default, as the model is asked to).  A reply is
    taken apart once, below the explosion: above it, filters that move through a
    projection would repeat the work for each field that they ask for.  The outer
    form of the explosion is one that no such filter is made for; its empty rows go.
    """
    items = replies.withColumn("__items", F.try_variant_get(F.try_parse_json("reply"), "$.similar_functions", f"array<{_ITEM}>"))
    rows = items.select("ord", "file_a", "file_b", F.posexplode_outer("__items").alias("pos", "i")).filter("i.func_a is not null and i.func_b is not null")
    text = lambda c, path, default: F.coalesce(F.try_variant_get(F.col(c), path, "string"), F.lit(default))
    line = lambda c, path: F.coalesce(F.try_variant_get(F.col(c), path, "int"), F.lit(0))
    scores = {name: _integer(F.col(f"i.scores.{name}")) for name in DIMENSIONS} | {"composite_score": _integer(F.col("i.composite_score"))}
    level = F.try_variant_get(F.col("i.similarity_level"), "$", "string")
    fine = reduce(and_, (ok for _, ok in scores.values()))
    parsed = rows.filter(fine).select(
        "ord", "file_a", "file_b", "pos",
        text("i.func_a", "$.name", "unknown").alias("name_a"), line("i.func_a", "$.line_start").alias("start_a"), line("i.func_a", "$.line_end").alias("end_a"),
        text("i.func_b", "$.name", "unknown").alias("name_b"), line("i.func_b", "$.line_start").alias("start_b"), line("i.func_b", "$.line_end").alias("end_b"),
        *(v.cast("long").alias(k) for k, (v, _) in scores.items()),
        F.when(level.isin(*LEVELS), level).otherwise(LEVELS[-1]).alias("similarity_level"),
        text("i.analysis", "$", "").alias("analysis"),
    )
    return parsed if threshold is None else parsed.filter(F.col("composite_score") >= threshold)


def dedup_functions(found: DataFrame) -> DataFrame:
    """Of the rows for one pair of functions (files and names), that of the best composite score; the first of equals."""
    w = Window.partitionBy("file_a", "name_a", "file_b", "name_b").orderBy(F.desc("composite_score"), "ord", "pos")
    return found.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def composite(scores: dict[str, Column]) -> Column:
    """Weighted mean of the five dimensions."""
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = out + scores[name] * weight
    return out


def level_of(score: Column) -> Column:
    return F.when(score > 60, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("very_low")


def score_distribution(found: DataFrame) -> DataFrame:
    """One row: how many composite scores lie in each range."""
    s = F.col("composite_score")
    n = lambda c: F.count_if(c)
    return found.agg(n(s > 60).alias("high"), n((s >= 40) & (s <= 60)).alias("medium"), n((s >= 20) & (s < 40)).alias("low"), n(s < 20).alias("very_low"), F.count("*").alias("total"))


def report_order(found: DataFrame) -> DataFrame:
    """Best composite score first, then the order of the pairs and of their items."""
    return found.orderBy(F.desc("composite_score"), "ord", "pos")
