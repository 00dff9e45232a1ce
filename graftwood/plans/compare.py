"""A whole comparison: scan, summarise, match, pair, compare, report."""

from __future__ import annotations

import logging
import os
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..backends.base import Backend, answer_all
from ..backends.prompts import DIR_MATCH, DIR_MERGE, DIR_PARTIAL, DIR_SUMMARY, FILE_SUMMARY, compare_system, compare_user, dir_user
from ..config import CompareConfig
from ..functions.text import PLACEHOLDER_DIR, content_sha
from ..functions.tokenizers import DIR_INPUT, SUMMARY_INPUT, PatternTokenizer, token_count, truncated
from ..operators import comparing, matching, summaries, tree
from ..schema import CACHE_DIR, CACHE_FILE, CACHE_PAIR, CACHE_REPLY
from ..sources.tree import scan_tree
from ..streaming.checkpoints import Checkpoint
from ..streaming.workspace import bounded_batches, hadoop, located, materialize, write_text
from .report import Report, pairs_text, rendered, summaries_text

log = logging.getLogger(__name__)
#: Turns of requests whose prompts are made together, and the most prompts that are written out for that.
TURNS_AT_ONCE, PROMPTS_AT_ONCE = 50, 100_000
_NO_FILES, _NO_CHILDREN = "(no files)", "(no subdirectories)"


class Comparison:
    """One run over two trees.  Every stage that asks the model is written out before it is used, so no request is sent twice by a retry of a later stage."""

    def __init__(self, spark: SparkSession, config: CompareConfig, make_backend: Callable[[int], Backend], tokenizer=PatternTokenizer()) -> None:
        self.spark, self.config, self.make, self.tokenizer = spark, config, make_backend, tokenizer
        self.out = located(config.output_dir)
        self.work = f"{self.out}/work/{uuid.uuid4().hex}"
        self.calls, self.seq = 0, time.time_ns()
        at = lambda name: f"{self.out}/cache/{name}"
        self.file_cache = Checkpoint(spark, at("files"), CACHE_FILE, ["hash"])
        self.dir_cache = Checkpoint(spark, at("dirs"), CACHE_DIR + ", repo string", ["repo", "dir"])
        self.pair_cache = Checkpoint(spark, at("pairs"), CACHE_PAIR, ["key"])
        self.match_cache = Checkpoint(spark, at("matches"), "v int, key string, ord int, dir_a string, dir_b string, confidence string, reason string, method string", ["key", "ord"])
        self.replies = Checkpoint(spark, at("replies"), CACHE_REPLY, ["key"])

    def cut(self, df: DataFrame) -> DataFrame:
        return materialize(df, "stage", self.work)

    def ask(self, requests: DataFrame, prompt: Callable[[DataFrame, int], DataFrame] | None = None, near: list[str] | None = None) -> DataFrame:
        """(id, reply, calls, error) of ``requests`` (id, kind, system, user).

        With ``prompt``, ``requests`` only hold ids, which are keys, and what that
        function makes prompts of; it is called for a bounded number of requests at
        a time, so prompts of many pairs of files never exist at once.  Prompts of
        small turns are written out for several turns; those of large ones never
        are, neither to a table nor to a shuffle: such a turn is made of requests that
        agree in ``near``, and ``prompt`` deals them out before it makes the text.  Requests go
        out ``flush_every`` at a time, and the good replies of each turn are put on
        record before the next; so a crash loses one turn at most, and a request
        that has a reply on record isn't sent again.
        """
        c = self.config
        text = F.concat_ws("\u0000", F.col("kind"), F.lit(c.model), F.col("system"), F.col("user")) if prompt is None else None
        # keys that are ids aren't written beside them
        key = F.col("id").alias("key") if text is None else F.col("key")
        keyed = self.cut(requests if text is None else requests.withColumn("key", F.sha2(text, 256))).select("*", *([key] if text is None else []))
        on_record = self.replies.load().select("key", F.col("reply").alias("had"))
        had = on_record if on_record.isEmpty() else self.cut(on_record.join(keyed.select("key").distinct(), "key", "left_semi"))
        none_had = had.isEmpty()
        todo = keyed if none_had else self.cut(keyed.join(had, "key", "left_anti").select(*requests.columns, *([] if text is None else ["key"]))).select("*", *([key] if text is None else []))
        turns = -(-todo.count() // max(1, c.flush_every))
        parts = max(1, min(c.max_in_flight, self.spark.sparkContext.defaultParallelism))
        answers = [(keyed.limit(0).withColumn("had", F.lit(None).cast("string")) if none_had else keyed.join(had, "key")).select("id", F.col("had").alias("reply"), F.lit(0).alias("calls"), F.lit(None).cast("string").alias("error"))]
        written = prompt is None or near is None or c.flush_every * TURNS_AT_ONCE <= PROMPTS_AT_ONCE
        todo = todo.withColumn("turn", F.pmod(F.xxhash64(*(["id"] if written else near)), F.lit(max(1, turns))))
        for start in range(0, turns, TURNS_AT_ONCE):
            some = todo.filter(F.col("turn").between(start, start + TURNS_AT_ONCE - 1))
            keys = some.select("id", "key", "turn")
            prompts = some if prompt is None or not written else self.cut(prompt(some, parts).join(some.select("id", "turn"), "id"))
            for k in range(start, min(turns, start + TURNS_AT_ONCE)):
                now = prompts.filter(F.col("turn") == k)
                now = (now if written else prompt(now, parts)).select("id", "kind", "system", "user")
                with bounded_batches(self.spark):
                    got = self.cut(answer_all(now, self.make, parts, c.max_in_flight, not written))
                good = got.filter("error is null")
                good = good.withColumn("key", F.col("id")) if text is None else keys.filter(F.col("turn") == k).join(good, "id")
                self.replies.append(good.select(F.lit(self.replies.version).alias("v"), "key", "reply"), self.seq)
                self.calls += got.agg(F.coalesce(F.sum("calls"), F.lit(0))).first()[0]
                answers.append(got)
        return self.cut(reduce(DataFrame.union, answers))

    # files

    def summarise_files(self, files: DataFrame) -> DataFrame:
        """(repo, path, summary, degraded)."""
        c = self.config
        known = self.cut(self.file_cache.load(c.model))
        wanted = summaries.cache_misses(summaries.distinct_contents(files), known, "hash")
        chosen = self.cut(wanted.join(files, ["repo", "path"]).withColumn("text", truncated(F.col("content"), SUMMARY_INPUT, self.tokenizer)["text"]))
        user = summaries.file_block(F.col("path"), F.col("language"), F.col("line_count"), F.col("text"))
        answers = self.ask(chosen.select(F.col("hash").alias("id"), F.lit("file_summary").alias("kind"), F.lit(FILE_SUMMARY).alias("system"), user.alias("user")))
        good = answers.filter("error is null").join(chosen.select(F.col("hash").alias("id"), "language", "path"), "id")
        fresh = good.select(F.lit(1).alias("v"), F.lit(c.model).alias("model"), F.col("id").alias("hash"), "language", F.col("reply").alias("summary"), F.col("path").alias("last_seen_path"))
        self.file_cache.append(fresh, self.seq)
        all_known = known.select("hash", "summary").union(fresh.select("hash", "summary"))
        keyed = summaries.hashed(files).select("repo", "path", "hash").join(all_known, "hash", "left")
        return self.cut(keyed.select("repo", "path", F.coalesce("summary", F.lit(summaries.PLACEHOLDER_FILE)).alias("summary"), F.col("summary").isNull().alias("degraded")))

    # directories

    def summarise_dirs(self, files: DataFrame, file_summaries: DataFrame) -> DataFrame:
        """(repo, dir, summary, degraded), from the leaves up, one round for each height."""
        c = self.config
        dirs = self.cut(tree.with_shells(files))
        level = self.cut(dirs.join(tree.heights(dirs), ["repo", "dir"]).join(tree.subtree_hashes(files), ["repo", "dir"]))
        rows = self.cut(summaries.prepared(files, file_summaries.select("repo", "path", "summary"), self.tokenizer))
        spoiled = file_summaries.filter("degraded").join(files.select("repo", "path", "dir"), ["repo", "path"]).select("repo", "dir").distinct().withColumn("bad_file", F.lit(True))
        known = self.dir_cache.load(c.model).filter("not degraded").select("repo", "dir", F.col("content_hash").alias("subtree_hash"), F.col("summary").alias("cached"))
        level = self.cut(level.join(known, ["repo", "dir", "subtree_hash"], "left").join(spoiled, ["repo", "dir"], "left"))
        top = level.agg(F.max("height")).first()[0]
        done = None
        for h in range(0, (top if top is not None else -1) + 1):
            now = level.filter(F.col("height") == h)
            here = self._one_level(now, rows, tree.direct_children(dirs), done)
            done = self.cut(here if done is None else done.union(here))
        if done is None:
            return self.spark.createDataFrame([], "repo string, dir string, summary string, degraded boolean")
        return done

    def _one_level(self, now: DataFrame, rows: DataFrame, children: DataFrame, done: DataFrame | None) -> DataFrame:
        c = self.config
        cached = now.filter("cached is not null").select("repo", "dir", F.col("cached").alias("summary"), F.lit(False).alias("degraded"))
        todo = now.filter("cached is null").select("repo", "dir", "subtree_hash", "bad_file")
        if done is None:
            below = todo.select("repo", "dir").withColumns({"children": F.lit(_NO_CHILDREN), "child_tokens": F.lit(0).cast("long"), "bad_child": F.lit(False)})
        else:
            kids = children.join(done.select("repo", F.col("dir").alias("child"), "summary", "degraded"), ["repo", "child"]).select("repo", F.col("dir").alias("parent"), F.col("child").alias("dir"), "summary", "degraded")
            text = matching.summary_lines(kids, ["repo", "parent"])
            bad = kids.groupBy("repo", "parent").agg(F.max("degraded").alias("bad_child"))
            known = text.join(bad, ["repo", "parent"]).select("repo", F.col("parent").alias("dir"), F.col("text").alias("children"), token_count(F.col("text"), self.tokenizer).cast("long").alias("child_tokens"), "bad_child")
            below = todo.select("repo", "dir").join(known, ["repo", "dir"], "left").withColumns({"children": F.coalesce("children", F.lit(_NO_CHILDREN)), "child_tokens": F.coalesce("child_tokens", F.lit(0)), "bad_child": F.coalesce("bad_child", F.lit(False))})
        own = rows.join(todo.select("repo", "dir"), ["repo", "dir"])
        totals = todo.select("repo", "dir", "subtree_hash", "bad_file").join(summaries.dir_totals(own), ["repo", "dir"], "left").join(below, ["repo", "dir"])
        totals = totals.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n_files", "n_lines", "n_tokens")})
        totals = self.cut(totals.withColumn("single", F.col("n_tokens") + F.col("child_tokens") <= DIR_INPUT))
        block = summaries.summary_block(F.col("display_path"), F.col("language"), F.col("line_count"), F.col("summary"))
        whole = summaries.blocks_of(own, ["repo", "dir"], "display_path", block, _NO_FILES)
        ident = F.concat_ws("\n", "repo", "dir")
        short = totals.filter("single").join(whole, ["repo", "dir"], "left")
        single = short.select(ident.alias("id"), F.lit("dir_summary").alias("kind"), F.lit(DIR_SUMMARY).alias("system"), dir_user(F.col("dir"), F.col("children"), F.coalesce("text", F.lit(_NO_FILES))).alias("user"))
        big = own.join(totals.filter("not single").select("repo", "dir"), ["repo", "dir"])
        bins = summaries.ffd_bins(big, DIR_INPUT)
        chunked = summaries.blocks_of(big.join(bins, ["repo", "dir", "path"]), ["repo", "dir", "bin"], "display_path", block, _NO_FILES)
        partial = chunked.select(F.concat_ws("\n", "repo", "dir", "bin").alias("id"), F.lit("dir_partial").alias("kind"), F.lit(DIR_PARTIAL).alias("system"), dir_user(F.col("dir"), F.lit(_NO_CHILDREN), F.col("text")).alias("user"))
        first = self.ask(single.union(partial))
        # a directory is merged only if every part of it came back
        parts = chunked.select("repo", "dir", "bin", F.concat_ws("\n", "repo", "dir", "bin").alias("id")).join(first, "id")
        lines = F.array_sort(F.collect_list(F.struct("bin", F.concat(F.lit("[Chunk "), (F.col("bin") + 1).cast("string"), F.lit("]\n"), "reply").alias("t"))))
        merged = parts.groupBy("repo", "dir").agg(F.count_if(F.col("error").isNotNull()).alias("lost"), F.count("*").alias("chunks"), F.array_join(F.transform(lines, lambda x: x["t"]), "\n\n").alias("text")).filter("lost = 0")
        merge = merged.join(totals.select("repo", "dir", "children"), ["repo", "dir"]).select(ident.alias("id"), F.lit("dir_merge").alias("kind"), F.lit(DIR_MERGE).alias("system"), dir_user(F.col("dir"), F.col("children"), F.col("text")).alias("user"))
        second = self.ask(merge)
        replies = first.join(single.select("id"), "id", "left_semi").union(second).filter("error is null").select("id", "reply")
        n_chunks = parts.groupBy("repo", "dir").agg(F.count("*").cast("int").alias("chunks"))
        out = self.cut(totals.withColumn("id", ident).join(replies, "id", "left").join(n_chunks, ["repo", "dir"], "left").withColumn("degraded", F.col("reply").isNull() | F.col("bad_child") | F.coalesce("bad_file", F.lit(False))))
        record = out.filter("reply is not null").select(
            F.lit(1).alias("v"), F.lit(c.model).alias("model"), "dir", F.col("subtree_hash").alias("content_hash"), F.col("reply").alias("summary"), F.lit(1.0).alias("coverage"),
            F.col("n_files").cast("int").alias("files_summarized"), F.col("n_files").cast("int").alias("total_files"), F.coalesce("chunks", F.lit(1)).alias("chunks"), F.col("n_tokens").cast("int").alias("tokens_input"), "degraded", "repo",
        )
        self.dir_cache.append(record, self.seq)
        return cached.union(out.select("repo", "dir", F.coalesce("reply", F.lit(PLACEHOLDER_DIR)).alias("summary"), "degraded"))

    # matches

    def match(self, dirs: DataFrame) -> DataFrame:
        """(ord, dir_a, dir_b, confidence, reason, method): the model's, or the heuristic's where the model can't be had."""
        schema = "ord int, dir_a string, dir_b string, confidence string, reason string, method string"
        own = self.cut(matching.without_root(dirs.select("repo", "dir", "summary")))
        n = {r["repo"]: r["n"] for r in own.groupBy("repo").agg(F.count("*").alias("n")).collect()}
        if not n.get("A") or not n.get("B"):
            log.warning("a tree has no folders: nothing to match")
            return self.spark.createDataFrame([], schema)
        size = self.config.match_batch_size
        key = matching.match_key(own, self.config.model, size).first()[0]
        had = self.match_cache.load().filter(F.col("key") == key)
        if not had.isEmpty():
            return self.cut(had.select("ord", "dir_a", "dir_b", "confidence", "reason", "method").filter("dir_a is not null"))
        several = size > 0 and max(n.values()) > size
        text = matching.summary_lines(own.join(matching.batches(own, size if several else 0, self.cut), ["repo", "dir"]), ["repo", "batch"])
        side = lambda r, k: text.filter(F.col("repo") == r).select(F.col("batch").alias(f"b{k}"), F.col("text").alias(f"t{k}"))
        pairs = side("A", "a").crossJoin(side("B", "b"))  # every batch of A meets every batch of B: the prompts to send
        ident = F.concat(F.lpad(F.col("ba").cast("string"), 9, "0"), F.lit("-"), F.lpad(F.col("bb").cast("string"), 9, "0"))
        answers = self.ask(pairs.select(ident.alias("id"), F.lit("dir_match").alias("kind"), F.lit(DIR_MATCH).alias("system"), F.concat(F.lit("A:\n"), "ta", F.lit("\n\nB:\n"), "tb").alias("user")))
        good = answers.filter("error is null")
        if good.isEmpty():
            found = matching.heuristic_matches(matching.similarities(own), self.cut)
            ranked = found.select(F.struct(-F.col("score"), "dir_a").alias("o"), "dir_a", "dir_b", "confidence", "reason")
            return self.cut(self._ordered(ranked).withColumn("method", F.lit("heuristic")))
        item = F.try_variant_get(F.try_parse_json("reply"), "$.matched_dirs", "array<variant>")
        items = good.select("id", F.posexplode(item).alias("pos", "m"))
        rows = items.select(F.struct("id", "pos").alias("o"), *(F.try_variant_get("m", f"$.{k}", "string").alias(k) for k in ("dir_a", "dir_b", "confidence", "reason")))
        valid = self.cut(matching.valid_matches(self._ordered(rows), own))
        if several or self.config.force_one_to_one:
            valid = matching.one_to_one(valid, self.cut)
        out = self.cut(valid.withColumn("method", F.lit("model")))
        # a match of nothing is a match too: one row without directories stands for it
        none = self.spark.range(1).select(F.lit(-1).alias("ord"), *(F.lit(None).cast("string").alias(k) for k in ("dir_a", "dir_b", "confidence", "reason")), F.lit("model").alias("method"))
        kept = none if out.isEmpty() else out
        self.match_cache.append(kept.select(F.lit(1).alias("v"), F.lit(key).alias("key"), *out.columns), self.seq)
        return out

    def _ordered(self, rows: DataFrame) -> DataFrame:
        """``o`` made into a running number from 1 on."""
        return matching.numbered(rows, ["o"], self.cut).withColumn("ord", (F.col("number") + 1).cast("int")).select("ord", "dir_a", "dir_b", "confidence", "reason")

    # functions

    def compare(self, pairs: DataFrame, files: DataFrame) -> DataFrame:
        """(ord, file_a, file_b, reply, status) of every pair; replies of earlier runs count as cached."""
        c = self.config
        keyed = self.cut(comparing.keyed_pairs(pairs, files, c.model, c.similarity_threshold))
        known = self.cut(self.pair_cache.load().select("key", F.col("similar_json").alias("cached")))
        none_known = known.isEmpty()
        todo = keyed.filter("not skip") if none_known else summaries.cache_misses(keyed.filter("not skip"), known, "key")
        codes, places = comparing.code_blocks(files, self.cut)
        side = lambda df, r, k: df.filter(F.col("repo") == r).select(*(F.col(x).alias(f"{x}_{k}") for x in df.columns if x != "repo"))
        near = ["block_a", "block_b"]

        def prompt(some: DataFrame, parts: int) -> DataFrame:
            met = some.groupBy(*near).agg(F.collect_list(F.struct("id", "pos_a", "pos_b")).alias("pairs"))
            met = met.join(side(codes, "A", "a"), "block_a").join(side(codes, "B", "b"), "block_b").repartition(parts, *near)
            rows = met.select("codes_a", "codes_b", F.explode("pairs").alias("p"))
            a, b = (F.get(F.col(f"codes_{k}"), F.col(f"p.pos_{k}")) for k in "ab")
            user = compare_user(a["path"], a["content"], b["path"], b["content"])
            return rows.select("p.id", F.lit("func_compare").alias("kind"), F.lit(compare_system(c.similarity_threshold)).alias("system"), user.alias("user"))

        asked = todo.select(F.col("key").alias("id"), F.col("file_a").alias("path_a"), F.col("file_b").alias("path_b")).dropDuplicates(["id"])
        placed = asked.join(side(places, "A", "a"), "path_a").join(side(places, "B", "b"), "path_b").select("id", *near, "pos_a", "pos_b")
        answers = self.ask(placed, prompt, near)
        # a reply of the wrong shape spoils its pair and isn't kept
        sound = F.try_variant_get(F.try_parse_json("reply"), "$", "map<string, variant>").isNotNull()
        good = answers.filter(F.col("error").isNull() & sound).select(F.col("id").alias("key"), "reply")
        fresh = keyed.join(good, "key").select(F.lit(1).alias("v"), "key", "file_a", "file_b", F.col("reply").alias("similar_json"))
        self.pair_cache.append(fresh, self.seq)
        met = keyed.withColumn("cached", F.lit(None).cast("string")) if none_known else keyed.join(known, "key", "left")
        joined = met.join(good, "key", "left")
        status = F.when(F.col("skip"), "skipped").when(F.col("cached").isNotNull(), "cached").when(F.col("reply").isNotNull(), "new").otherwise("error")
        return self.cut(joined.select("ord", "file_a", "file_b", F.coalesce("cached", "reply").alias("reply"), status.alias("status")))

    def run(self, path_a: str, path_b: str) -> Report:
        for cache in (self.file_cache, self.dir_cache, self.pair_cache, self.match_cache):
            cache.compact()
        try:
            report = self._run(path_a, path_b)
        finally:
            fs, work = hadoop(self.spark, self.work)
            fs.delete(work, True)
        # every stage has its own records now
        self.replies.clear()
        return report

    def _run(self, path_a: str, path_b: str) -> Report:
        c = self.config
        write = lambda name, text: write_text(self.spark, f"{self.out}/{name}", text)
        files = self.cut(scan_tree(self.spark, path_a, "A", c).union(scan_tree(self.spark, path_b, "B", c)))
        n = {r["repo"]: r["total_files"] for r in tree_totals(files).collect()}
        report = Report(os.path.realpath(path_a), os.path.realpath(path_b), n.get("A", 0), n.get("B", 0))
        dirs = self.summarise_dirs(files, self.summarise_files(files))
        by_repo: dict[str, dict[str, str]] = {"A": {}, "B": {}}
        for r in dirs.orderBy("repo", "dir").toLocalIterator():
            by_repo[r["repo"]][r["dir"]] = r["summary"]
        write("dir_summaries.json", summaries_text(by_repo["A"], by_repo["B"]))
        matches = self.match(dirs)
        report.matches = [r.asDict() for r in matches.orderBy("ord").select("dir_a", "dir_b", "confidence", "reason").collect()]
        if not c.shallow:
            pairs = self.cut(comparing.file_pairs(matches, files))
            write("compared_pairs.txt", pairs_text((r["file_a"], r["file_b"]) for r in pairs.orderBy("ord", "file_a", "file_b").toLocalIterator()))
            replies = self.compare(pairs, files)
            for r in replies.groupBy("status").count().collect():
                log.info("pairs %s: %d", r["status"], r["count"])
            found = comparing.dedup_functions(comparing.parse_similar(replies, c.similarity_threshold if c.strict_threshold else None))
            report.functions = [r.asDict() for r in found.orderBy("ord", "file_a", "file_b", "pos").toLocalIterator()]
        report.calls = self.calls
        form = c.output_format
        path = located(c.output_path) if c.output_path else f"{self.out}/report.{'json' if form == 'json' else 'md'}"
        write_text(self.spark, path, rendered(report, form))
        return report


def tree_totals(files: DataFrame) -> DataFrame:
    from ..operators.scan import total_files

    return total_files(files)


def file_digests(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", content_sha(F.col("content")).alias("sha"))
