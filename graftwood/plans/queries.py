"""Queries over the given tables, one for each operator, and the SQL of their results."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.tokenizers import token_count, truncated
from ..operators import comparing, matching, scan, summaries, tree
from ..schema import DIMENSIONS
from ..sources.corpus import files_of_documents, files_of_pages
from ..sources.tree import IgnoreRules
from ..streaming.workspace import materialize

MODEL, THRESHOLD = "gpt-4o-mini", 20
RULES = IgnoreRules.parse("# comment\nsrc3/\n*7.py\n?1.js\n1[0-4]*.go\n")
LANGUAGES = {"python", "java", "go"}
BIN_BUDGET, HEAD_TAIL, MOST_LINES, BATCH = 10_000, 400, 12, 15


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return files_of_documents(spark.read.parquet(f"{sf}/documents.parquet"))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return files_of_pages(spark.read.parquet(f"{sf}/pages.parquet"))


def _cut(spark: SparkSession):
    """Writes a table into the shared folder and reads it back."""
    return lambda df: materialize(df, "query")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Token sets of directories: of all their files' contents, a summary that is no JSON."""
    files = _files(spark, sf)
    return files.select("repo", "dir", F.explode(fx.tokens(F.col("content"))).alias("token")).distinct()


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """A directory summary in the form that a model gives, made from counts and the first path."""
    files = _files(spark, sf)
    made = files.groupBy("repo", "dir").agg(F.count("*").alias("n"), F.min("path").alias("p"), F.sum("line_count").alias("l"))
    js = F.concat(
        F.lit('{"purpose": "files of '), "dir", F.lit('", "key_exports": ["'), "p", F.lit('", "n_'), F.col("n").cast("string"),
        F.lit('"], "frameworks": [], "patterns": ["lines_'), F.col("l").cast("string"), F.lit('"], "children_overview": "'), F.when(F.col("n") % 2 == 0, "even count").otherwise(""), F.lit('"}'),
    )
    return made.select("repo", "dir", F.when(F.col("n") % 5 == 0, F.concat(F.lit("plain words of "), "dir")).otherwise(js).alias("summary"))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each directory of A with that of the next source in B, in the order of their names' digests."""
    files = _files(spark, sf)
    a = files.filter("repo = 'A'").select(F.col("dir").alias("dir_a")).distinct()
    b = files.filter("repo = 'B'").select(F.col("dir").alias("dir_b")).distinct()
    number = F.regexp_extract("dir_a", r"src([0-9]+)$", 1).cast("int")
    near = a.withColumn("dir_b", F.concat(F.regexp_extract("dir_a", "^(.*src)", 1), (number + 1).cast("string")))
    return near.join(b, "dir_b").select(F.conv(F.substr(F.sha2("dir_a", 256), F.lit(1), F.lit(7)), 16, 10).cast("int").alias("ord"), "dir_a", "dir_b")


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of a comparison, made from the numbers of line items: strings, floats, gaps and out-of-range values among them."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    s = lambda x: x.cast("string")
    q = F.col("l_quantity").cast("int")
    score = lambda m: s(F.pmod(k * m + n * 7 + q, F.lit(101)))
    comp = F.when(k % 11 == 0, F.concat(F.lit('"'), score(3), F.lit('"'))).when(k % 13 == 0, F.concat(score(3), F.lit(".9"))).when(k % 17 == 0, F.lit('"n/a"')).otherwise(score(3))
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "very_low", "extreme"))), (F.pmod(k + n, F.lit(5)) + 1).cast("int"))
    scores = F.concat(F.lit('{"data_structure": '), score(1), F.lit(', "function_signature": '), score(2), F.lit(', "algorithm_logic": '), score(5), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(', "naming_convention": '), score(6))), F.lit(', "protocol_conformance": '), score(9), F.lit("}"))
    name = F.concat(F.lit("f"), s(F.pmod(F.col("l_partkey"), F.lit(3))))
    fb = F.when(k % 19 == 0, "").otherwise(F.concat(F.lit(', "func_b": {"name": "g'), s(F.pmod(F.col("l_suppkey"), F.lit(2))), F.lit('", "line_start": 1, "line_end": 9}')))
    item = F.concat(F.lit('{"func_a": {"name": "'), name, F.lit('", "line_start": '), s(q), F.lit("}"), fb, F.lit(', "scores": '), scores, F.lit(', "composite_score": '), comp, F.lit(', "similarity_level": "'), level, F.lit('", "analysis": "a'), s(n), F.lit('"}'))
    rows = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), item.alias("i")))), lambda x: x["i"]), ", ").alias("items"))
    o = F.col("l_orderkey")
    return rows.select(o.cast("int").alias("ord"), F.concat(F.lit("a"), s(F.pmod(o, F.lit(500)))).alias("file_a"), F.concat(F.lit("b"), s(F.pmod(o, F.lit(300)))).alias("file_b"), F.concat(F.lit('{"similar_functions": ['), "items", F.lit("]}")).alias("reply"))


_FILES = """
f AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS repo, lang || '/' || source AS dir, text AS content,
    CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'go' WHEN 'es' THEN 'java' ELSE 'c' END AS language,
    lang || '/' || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.go' WHEN 'es' THEN '.java' ELSE '.c' END AS path,
    CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS INTEGER) AS line_count
  FROM documents
)"""
_TREE = r"""
p AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '/+$', '') AS dir, html AS content,
    CAST(length(html) - length(replace(html, chr(10), '')) + CASE WHEN html <> '' AND NOT ends_with(html, chr(10)) THEN 1 ELSE 0 END AS INTEGER) AS line_count
  FROM pages
), f AS (SELECT 'A' AS repo, dir, dir || '/' || page_id || '.js' AS path, content, line_count FROM p)
, parts AS (SELECT DISTINCT repo, dir, string_split(dir, '/') AS s FROM f)
, up AS (SELECT repo, dir, array_to_string(s[1:n], '/') AS anc, n FROM parts, unnest(range(0, len(s) + 1)) AS t(n))"""
_WORDS = f"""{_FILES}, w AS (
  SELECT DISTINCT repo, dir, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{{3,}}')) AS token FROM f
), n AS (SELECT repo, dir, count(*) AS n FROM w GROUP BY ALL)
, j AS (
  SELECT a.dir AS dir_a, b.dir AS dir_b, count(*) AS c FROM w a JOIN w b ON a.token = b.token AND a.repo = 'A' AND b.repo = 'B' GROUP BY ALL
), jac AS (
  SELECT dir_a, dir_b, c::DOUBLE / (na.n + nb.n - c) AS jaccard FROM j JOIN n na ON na.repo = 'A' AND na.dir = dir_a JOIN n nb ON nb.repo = 'B' AND nb.dir = dir_b
)"""
_SUMMARIES = f"""{_FILES}, g AS (SELECT repo, dir, count(*) AS n, min(path) AS p, sum(line_count) AS l FROM f GROUP BY ALL), s AS (
  SELECT repo, dir, n, p, l, CASE WHEN n % 5 = 0 THEN 'plain words of ' || dir ELSE
    '{{"purpose": "files of ' || dir || '", "key_exports": ["' || p || '", "n_' || n || '"], "frameworks": [], "patterns": ["lines_' || l || '"], "children_overview": "' || CASE WHEN n % 2 = 0 THEN 'even count' ELSE '' END || '"}}' END AS summary
  FROM g
)"""


def _blob(*parts: str) -> str:
    """SHA-256 of texts with NUL between, its first 16 digits."""
    return "substr(sha256(" + " || '\\x00'::BLOB || ".join(f"encode({p})" for p in parts) + "), 1, 16)"


_MATCHES = f"""{_FILES}, m AS (
  SELECT CAST('0x' || substr(sha256(dir_a), 1, 7) AS INTEGER) AS ord, dir_a, dir_b
  FROM (SELECT DISTINCT dir AS dir_a, regexp_extract(dir, '^(.*src)', 1) || (CAST(regexp_extract(dir, 'src([0-9]+)$', 1) AS INTEGER) + 1) AS dir_b FROM f WHERE repo = 'A')
  WHERE dir_b IN (SELECT dir FROM f WHERE repo = 'B')
), pairs AS (
  SELECT a.path AS file_a, b.path AS file_b, min(m.ord) AS ord FROM m JOIN f a ON a.repo = 'A' AND a.dir = dir_a JOIN f b ON b.repo = 'B' AND b.dir = dir_b GROUP BY ALL
)"""
_PARSED = """
li AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q, l_partkey % 3 AS pa, l_suppkey % 2 AS sb FROM lineitem)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, key) - 1 AS pos FROM (
  SELECT *, '{"func_a": {"name": "f' || pa || '", "line_start": ' || q || '}' || CASE WHEN k % 19 = 0 THEN '' ELSE ', "func_b": {"name": "g' || sb END AS key FROM li))
, x AS (
  SELECT CAST(k AS INTEGER) AS ord, 'a' || (k % 500) AS file_a, 'b' || (k % 300) AS file_b, CAST(pos AS INTEGER) AS pos, 'f' || pa AS name_a, q AS start_a, 0 AS end_a, 'g' || sb AS name_b, 1 AS start_b, 9 AS end_b,
    CAST((k * 1 + n * 7 + q) % 101 AS BIGINT) AS data_structure, CAST((k * 2 + n * 7 + q) % 101 AS BIGINT) AS function_signature, CAST((k * 5 + n * 7 + q) % 101 AS BIGINT) AS algorithm_logic,
    CAST(CASE WHEN k % 7 = 0 THEN 0 ELSE (k * 6 + n * 7 + q) % 101 END AS BIGINT) AS naming_convention, CAST((k * 9 + n * 7 + q) % 101 AS BIGINT) AS protocol_conformance,
    CAST((k * 3 + n * 7 + q) % 101 AS BIGINT) AS composite_score, ['high', 'medium', 'low', 'very_low', 'very_low'][(k + n) % 5 + 1] AS similarity_level, 'a' || n AS analysis
  FROM ranked WHERE k % 19 <> 0 AND NOT (k % 17 = 0 AND k % 11 <> 0 AND k % 13 <> 0)
), d AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY file_a, name_a, file_b, name_b ORDER BY composite_score DESC, ord, pos) AS r FROM x) WHERE r = 1)"""
_GREEDY = """
, best AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM cand)
, run AS (
  SELECT 0::BIGINT AS k, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub, false AS hit
  UNION ALL
  SELECT b.k, CASE WHEN ok THEN list_append(ua, b.dir_a) ELSE ua END, CASE WHEN ok THEN list_append(ub, b.dir_b) ELSE ub END, ok
  FROM (SELECT b.*, run.ua, run.ub, NOT list_contains(run.ua, b.dir_a) AND NOT list_contains(run.ub, b.dir_b) AS ok FROM run JOIN best b ON b.k = run.k + 1) b
)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# scans


@query(f"WITH {_FILES} SELECT repo, dir, language, count(*) AS n_files, CAST(sum(line_count) AS BIGINT) AS n_lines FROM f GROUP BY ALL")
def scan_stats(spark, sf):
    return scan.scan_stats(_files(spark, sf))


@query(f"WITH {_FILES} SELECT repo, count(*) AS total_files FROM f GROUP BY ALL")
def total_files(spark, sf):
    return scan.total_files(_files(spark, sf))


@query(f"WITH {_FILES} SELECT path, language FROM f WHERE language IN ('python', 'java', 'go')")
def language_filter(spark, sf):
    return scan.keep_languages(_files(spark, sf), LANGUAGES).select("path", "language")


@query(f"WITH {_FILES} SELECT path, line_count FROM f WHERE line_count <= {MOST_LINES}")
def max_lines_filter(spark, sf):
    return scan.keep_max_lines(_files(spark, sf), MOST_LINES).select("path", "line_count")


@query(
    f"""WITH {_FILES}, n AS (SELECT path, string_split(path, '/') AS s FROM f)
SELECT path FROM n WHERE NOT list_contains(s[1:2], 'src3') AND NOT regexp_matches(s[3], '^(.*7\\.py|.1\\.js|1[0-4].*\\.go)$')"""
)
def ignore_rules_filter(spark, sf):
    return scan.keep_unignored(_files(spark, sf), RULES).select("path")


@query(f"WITH {_FILES} SELECT path, line_count FROM f")
def line_counts(spark, sf):
    return _files(spark, sf).select("path", "line_count")


# contents


@query(f"WITH {_FILES} SELECT path, {_blob("'v1|lang=' || language", 'content')} AS hash FROM f")
def content_hash(spark, sf):
    return summaries.hashed(_files(spark, sf)).select("path", "hash")


@query(f"""WITH {_FILES}, h AS (SELECT repo, path, {_blob("'v1|lang=' || language", 'content')} AS hash FROM f)
SELECT hash, r.repo AS repo, r.path AS path, n_files FROM (SELECT hash, min(struct_pack(repo := repo, path := path)) AS r, count(*) AS n_files FROM h GROUP BY hash)""")
def distinct_contents(spark, sf):
    return summaries.distinct_contents(_files(spark, sf))


def _made_summaries(files: DataFrame) -> DataFrame:
    """Summaries of some distinct contents, as a model would have given; the rest failed."""
    one = summaries.distinct_contents(files)
    return one.filter(F.substr("hash", F.lit(1), F.lit(1)) != "0").select("hash", F.concat(F.lit('{"purpose": "'), "hash", F.lit('"}')).alias("summary"))


@query(f"""WITH {_FILES}, h AS (SELECT repo, path, {_blob("'v1|lang=' || language", 'content')} AS hash FROM f)
SELECT repo, path, CASE WHEN substr(hash, 1, 1) <> '0' THEN '{{"purpose": "' || hash || '"}}' ELSE '{fx.PLACEHOLDER_FILE}' END AS summary FROM h""")
def summary_fanout(spark, sf):
    files = _files(spark, sf)
    return summaries.fan_out(files, _made_summaries(files))


@query(f"""WITH {_FILES}, h AS (SELECT DISTINCT {_blob("'v1|lang=' || language", 'content')} AS hash FROM f) SELECT hash FROM h WHERE substr(hash, 1, 1) = '0'""")
def cache_anti_join(spark, sf):
    files = _files(spark, sf)
    return summaries.cache_misses(summaries.distinct_contents(files).select("hash"), _made_summaries(files), "hash")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id")
def cache_last_wins(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    return summaries.last_wins(e, ["user_id"], "seq")


@query(f"WITH {_FILES} SELECT path, CAST(len(regexp_extract_all(content, '(?s)[A-Za-z]+|[0-9]+|[^A-Za-z0-9]')) AS INTEGER) AS tokens FROM f")
def token_counts(spark, sf):
    return _files(spark, sf).select("path", token_count(F.col("content")).alias("tokens"))


@query(
    f"""WITH {_FILES}, t AS (SELECT path, content, regexp_extract_all(content, '(?s)[A-Za-z]+|[0-9]+|[^A-Za-z0-9]') AS p FROM f)
SELECT path, len(p) > {HEAD_TAIL} AS truncated, CASE WHEN len(p) > {HEAD_TAIL} THEN array_to_string(p[1:{HEAD_TAIL // 2}], '') || chr(10) || chr(10) || '... [truncated ' || (len(p) - {HEAD_TAIL}) || ' tokens] ...' || chr(10) || chr(10) || array_to_string(p[len(p) - {HEAD_TAIL // 2} + 1:], '') ELSE content END AS text FROM t"""
)
def head_tail_truncate(spark, sf):
    return _files(spark, sf).select("path", truncated(F.col("content"), HEAD_TAIL).alias("t")).select("path", "t.truncated", "t.text")


@query(f"WITH {_FILES} SELECT path, sha256('File ' || path || ' [' || language || ', ' || line_count || ' lines]' || chr(10) || '```' || chr(10) || content || chr(10) || '```') AS block_sha FROM f")
def file_blocks(spark, sf):
    return _files(spark, sf).select("path", F.sha2(summaries.file_block(F.col("path"), F.col("language"), F.col("line_count"), F.col("content")), 256).alias("block_sha"))


# trees


@query(f"WITH {_TREE} SELECT repo, anc AS dir, max(anc = dir) AS has_files FROM up GROUP BY repo, anc")
def ancestor_backfill(spark, sf):
    return tree.with_shells(_tree(spark, sf))


@query(f"WITH {_TREE} SELECT repo, anc AS dir, CAST(max(len(string_split(dir, '/'))) - max(n) AS INTEGER) AS height FROM up GROUP BY repo, anc")
def tree_height(spark, sf):
    return tree.heights(tree.with_shells(_tree(spark, sf)))


@query(f"WITH {_TREE}, c AS (SELECT DISTINCT repo, anc FROM up WHERE anc <> '') SELECT repo, CASE WHEN contains(anc, '/') THEN regexp_replace(anc, '/[^/]*$', '') ELSE '' END AS dir, anc AS child FROM c")
def direct_children(spark, sf):
    return tree.direct_children(tree.with_shells(_tree(spark, sf)))


@query(f"WITH {_TREE} SELECT up.repo, anc AS dir, count(*) AS n_files, CAST(sum(line_count) AS BIGINT) AS n_lines FROM up JOIN f ON f.repo = up.repo AND f.dir = up.dir GROUP BY up.repo, anc")
def dir_rollup(spark, sf):
    return tree.rollup(_tree(spark, sf))


_LANES = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT))::VARCHAR" for k in range(4))


@query(
    f"""WITH {_TREE}, e AS (SELECT repo, dir, sha256(path || chr(10) || sha256(coalesce(content, ''))) AS h FROM f)
SELECT up.repo, anc AS dir, substr(sha256('v2|root=' || anc || chr(10) || concat_ws('-', count(*), {_LANES})), 1, 16) AS subtree_hash
FROM up JOIN e ON e.repo = up.repo AND e.dir = up.dir GROUP BY up.repo, anc"""
)
def subtree_hash(spark, sf):
    return tree.subtree_hashes(_tree(spark, sf))


# directories


def _prepared(spark, sf):
    files = _files(spark, sf)
    return summaries.prepared(files, summaries.fan_out(files, _made_summaries(files)))


_PREPARED = f"""{_FILES}, h AS (SELECT *, {_blob("'v1|lang=' || language", 'content')} AS hash FROM f)
, s AS (SELECT *, CASE WHEN substr(hash, 1, 1) <> '0' THEN '{{"purpose": "' || hash || '"}}' ELSE '{fx.PLACEHOLDER_FILE}' END AS summary FROM h)
, t AS (SELECT *, CAST(len(regexp_extract_all(summary, '(?s)[A-Za-z]+|[0-9]+|[^A-Za-z0-9]')) AS INTEGER) AS tokens FROM s)"""


@query(f"WITH {_PREPARED} SELECT repo, dir, path, substr(path, length(dir) + 2) AS display_path, language, line_count, summary, tokens FROM t")
def prepared_summaries(spark, sf):
    return _prepared(spark, sf)


@query(
    f"""WITH {_PREPARED}, d AS (SELECT repo, dir, count(*) AS n_files, CAST(sum(line_count) AS BIGINT) AS n_lines, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM t GROUP BY ALL)
SELECT *, CAST(n_lines AS BIGINT) AS child_tokens, CASE WHEN n_tokens + n_lines <= 300 THEN 'single' ELSE 'chunked' END AS mode, n_lines * 2 > 300 AS crowded FROM d"""
)
def dir_budget(spark, sf):
    totals = summaries.dir_totals(_prepared(spark, sf))
    return summaries.budgeted(totals, totals.select("repo", "dir", F.col("n_lines").alias("child_tokens")), 300)


@query(
    f"""WITH RECURSIVE {_FILES}, o AS (SELECT repo, dir, path, length(content) AS w, row_number() OVER (PARTITION BY repo, dir ORDER BY length(content) DESC, path) AS k FROM f)
, r AS (
  SELECT repo, dir, path, k, 1 AS bin, [w]::BIGINT[] AS loads FROM o WHERE k = 1
  UNION ALL
  SELECT q.repo, q.dir, q.path, q.k, CASE WHEN p > 0 THEN p ELSE len(loads) + 1 END, CASE WHEN p > 0 THEN list_concat(list_concat(loads[1:p - 1], [loads[p] + w]), loads[p + 1:]) ELSE list_append(loads, w) END
  FROM (SELECT o.*, r.loads, coalesce(list_position(list_transform(r.loads, lambda v: v + o.w <= {BIN_BUDGET}), true), 0) AS p FROM r JOIN o ON o.repo = r.repo AND o.dir = r.dir AND o.k = r.k + 1) q
) SELECT repo, dir, path, CAST(bin - 1 AS INTEGER) AS bin FROM r"""
)
def ffd_bins(spark, sf):
    return summaries.ffd_bins(_files(spark, sf).withColumn("tokens", F.length("content")), BIN_BUDGET)


@query(f"""WITH {_PREPARED} SELECT repo, dir, sha256(string_agg('== ' || substr(path, length(dir) + 2) || ' [' || language || ', ' || line_count || ' lines]' || chr(10) || summary, chr(10) || chr(10) ORDER BY substr(path, length(dir) + 2))) AS text_sha FROM t GROUP BY ALL""")
def dir_blocks(spark, sf):
    block = summaries.summary_block(F.col("display_path"), F.col("language"), F.col("line_count"), F.col("summary"))
    return summaries.blocks_of(_prepared(spark, sf), ["repo", "dir"], "display_path", block, "(no files)").select("repo", "dir", F.sha2("text", 256).alias("text_sha"))


# matching


@query(f"""WITH {_SUMMARIES} SELECT repo, dir, CASE WHEN n % 5 = 0 THEN summary ELSE 'files of ' || dir || ' ' || p || ' n_' || n || ' lines_' || l || CASE WHEN n % 2 = 0 THEN ' even count' ELSE '' END END AS text FROM s""")
def summary_text(spark, sf):
    return _summaries(spark, sf).select("repo", "dir", fx.summary_text(F.col("summary")).alias("text"))


@query(f"WITH {_WORDS} SELECT repo, dir, count(*) AS n_tokens, CAST(sum(length(token)) AS BIGINT) AS n_chars FROM w GROUP BY ALL")
def dir_tokens(spark, sf):
    return _words(spark, sf).groupBy("repo", "dir").agg(F.count("*").alias("n_tokens"), F.sum(F.length("token")).alias("n_chars"))


@query(f"WITH {_WORDS} SELECT dir_a, dir_b, jaccard FROM jac WHERE jaccard >= 0.02")
def dir_jaccard(spark, sf):
    """Flagship: directories of A and B by the overlap of their vocabularies."""
    return matching.dir_jaccard(_words(spark, sf), 0.02)


_TREE_DIRS = [f"{lang}/src{k}" for lang in ("de", "en", "es", "fr") for k in range(20)]


def _ratio_rows() -> str:
    """difflib's ratio of all pairs of folders that the given tables can hold, which SQL has no function for."""
    rows = []
    for b in _TREE_DIRS:
        matcher = SequenceMatcher(None, "", b)
        for a in _TREE_DIRS:
            matcher.set_seq1(a)
            rows.append(f"('{a}','{b}',{matcher.ratio()!r}::DOUBLE)")
    return ",".join(rows)


_RATIOS = f"ratios(dir_a, dir_b, ratio) AS (VALUES {_ratio_rows()})"
_SIMILARITY = f"""{_SUMMARIES}, {_RATIOS}, txt AS (
  SELECT repo, dir, CASE WHEN n % 5 = 0 THEN summary ELSE 'files of ' || dir || ' ' || p || ' n_' || n || ' lines_' || l || CASE WHEN n % 2 = 0 THEN ' even count' ELSE '' END END AS text FROM s
), w AS (SELECT DISTINCT repo, dir, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}')) AS token FROM txt)
, n AS (SELECT repo, dir, count(*) AS n FROM w GROUP BY ALL)
, j AS (SELECT a.dir AS dir_a, b.dir AS dir_b, count(*) AS c FROM w a JOIN w b ON a.token = b.token AND a.repo = 'A' AND b.repo = 'B' GROUP BY ALL)
, sim AS (
  SELECT dir_a, dir_b, ratio AS name_score, coalesce(c::DOUBLE / (na.n + nb.n - c), 0::DOUBLE) AS jaccard, ratio * 0.35::DOUBLE + coalesce(c::DOUBLE / (na.n + nb.n - c), 0::DOUBLE) * 0.65::DOUBLE AS score
  FROM ratios LEFT JOIN j USING (dir_a, dir_b) JOIN n na ON na.repo = 'A' AND na.dir = dir_a JOIN n nb ON nb.repo = 'B' AND nb.dir = dir_b
), cand AS (SELECT * FROM sim WHERE score >= 0.22::DOUBLE)"""


@query(f"WITH {_FILES}, {_RATIOS} SELECT dir_a, dir_b, ratio FROM ratios WHERE dir_a IN (SELECT dir FROM f WHERE repo = 'A') AND dir_b IN (SELECT dir FROM f WHERE repo = 'B')")
def dir_name_ratio(spark, sf):
    files = _files(spark, sf).select("repo", "dir").distinct()
    side = lambda r, k: files.filter(F.col("repo") == r).select(F.col("dir").alias(f"dir_{k}"))
    return side("A", "a").crossJoin(side("B", "b")).select("dir_a", "dir_b", fx.name_ratio("dir_a", "dir_b").alias("ratio"))


@query(f"WITH {_SIMILARITY} SELECT * FROM cand")
def dir_similarity(spark, sf):
    return matching.similarities(_summaries(spark, sf))


_HEURISTIC = _GREEDY.format(order="score DESC, dir_a, dir_b")


@query(
    f"""WITH RECURSIVE {_WORDS}, cand AS (SELECT dir_a, dir_b, jaccard AS score FROM jac WHERE jaccard >= 0.05){_HEURISTIC}
SELECT dir_a, dir_b, CASE WHEN score >= 0.55 THEN 'high' WHEN score >= 0.40 THEN 'medium' ELSE 'low' END AS confidence, 'heuristic score ' || format('{{:.2f}}', score) AS reason, score FROM best JOIN run USING (k) WHERE hit"""
)
def heuristic_match(spark, sf):
    scored = matching.dir_jaccard(_words(spark, sf), 0.05).withColumnRenamed("jaccard", "score")
    return matching.heuristic_matches(scored, _cut(spark))


@query(
    f"""WITH RECURSIVE {_SIMILARITY}{_HEURISTIC}
SELECT dir_a, dir_b, CASE WHEN score >= 0.55 THEN 'high' WHEN score >= 0.40 THEN 'medium' ELSE 'low' END AS confidence, 'heuristic score ' || format('{{:.2f}}', score) AS reason, score FROM best JOIN run USING (k) WHERE hit"""
)
def heuristic_match_names(spark, sf):
    return matching.heuristic_matches(matching.similarities(_summaries(spark, sf)), _cut(spark))


_GIVEN = """o AS (SELECT CAST(o_orderkey AS INTEGER) AS ord, 'd' || (o_custkey % 37) AS dir_a, 'd' || ((o_custkey * 7 + o_orderkey) % 31) AS dir_b,
  ['high', 'medium', 'low', 'odd'][o_orderkey % 4 + 1] AS confidence, 'r' || o_orderkey AS reason FROM orders)"""
_RANK = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, ord"


def _given(spark, sf):
    """Replies of several batches, made from orders: the same directories again and again."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "odd"))), (k % 4 + 1).cast("int"))
    return o.select(k.cast("int").alias("ord"), F.concat(F.lit("d"), s(c % 37)).alias("dir_a"), F.concat(F.lit("d"), s((c * 7 + k) % 31)).alias("dir_b"), level.alias("confidence"), F.concat(F.lit("r"), s(k)).alias("reason"))


@query(
    f"""WITH RECURSIVE {_GIVEN}, cand AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY dir_a, dir_b ORDER BY {_RANK}) AS r FROM o) WHERE r = 1){_GREEDY.format(order=_RANK)}
SELECT best.ord, dir_a, dir_b, confidence, reason FROM best JOIN run ON best.k = run.k WHERE hit"""
)
def resolve_one_to_one(spark, sf):
    return matching.one_to_one(_given(spark, sf), _cut(spark)).select("ord", "dir_a", "dir_b", "confidence", "reason")


@query(f"""WITH {_GIVEN}, d AS (SELECT 'd' || r_regionkey AS dir FROM region), e AS (SELECT 'd' || n_nationkey AS dir FROM nation)
SELECT ord, dir_a, dir_b, confidence, reason FROM o WHERE dir_a IN (FROM d) AND dir_b IN (FROM e)""")
def match_validation(spark, sf):
    """Directories of A are numbered like regions, those of B like nations."""
    numbered = lambda table, key, repo: spark.read.parquet(f"{sf}/{table}.parquet").select(F.lit(repo).alias("repo"), F.concat(F.lit("d"), F.col(key).cast("string")).alias("dir"))
    return matching.valid_matches(_given(spark, sf), numbered("region", "r_regionkey", "A").union(numbered("nation", "n_nationkey", "B")))


@query(f"WITH {_FILES}, d AS (SELECT DISTINCT repo, dir FROM f) SELECT repo, dir, CAST((row_number() OVER (PARTITION BY repo ORDER BY dir) - 1) // {BATCH} AS INTEGER) AS batch FROM d")
def match_batches(spark, sf):
    return matching.batches(_files(spark, sf).select("repo", "dir").distinct(), BATCH, _cut(spark))


@query(
    f"""WITH {_FILES}, d AS (SELECT repo, dir, CAST((row_number() OVER (PARTITION BY repo ORDER BY dir) - 1) // {BATCH} AS INTEGER) AS batch FROM (SELECT DISTINCT repo, dir FROM f))
SELECT DISTINCT a.batch AS batch_a, b.batch AS batch_b FROM d a JOIN d b ON a.repo = 'A' AND b.repo = 'B'"""
)
def batch_product(spark, sf):
    b = matching.batches(_files(spark, sf).select("repo", "dir").distinct(), BATCH, _cut(spark))
    side = lambda r, k: b.filter(F.col("repo") == r).select(F.col("batch").alias(f"batch_{k}")).distinct()
    return side("A", "a").crossJoin(side("B", "b"))


@query(f"""WITH {_SUMMARIES}, e AS (SELECT sha256(repo || chr(10) || dir || chr(10) || sha256(summary)) AS h FROM s), j AS (SELECT concat_ws('-', count(*), {_LANES}) AS e FROM e) SELECT {_blob(f"'match2|{MODEL}|40'", 'e')} AS match_key FROM j""")
def match_key(spark, sf):
    return matching.match_key(_summaries(spark, sf), MODEL, 40)


@query(f"""WITH {_SUMMARIES} SELECT repo, sha256(string_agg('[' || dir || ']: ' || summary, chr(10) ORDER BY dir)) AS text_sha FROM s GROUP BY repo""")
def match_prompt_lines(spark, sf):
    return matching.summary_lines(_summaries(spark, sf), ["repo"]).select("repo", F.sha2("text", 256).alias("text_sha"))


# pairs and comparisons


@query(f"WITH {_MATCHES} SELECT * FROM pairs")
def file_pairs(spark, sf):
    return comparing.file_pairs(_matches(spark, sf), _files(spark, sf))


@query(
    f"""WITH {_MATCHES}, c AS (SELECT repo, path, sha256(content) AS sha, content = '' AS empty FROM f)
SELECT file_a, file_b, ord, {_blob(f"'v1|{MODEL}|{THRESHOLD}'", 'file_a', 'a.sha', 'file_b', 'b.sha')} AS key, a.empty OR b.empty AS skip FROM pairs JOIN c a ON a.repo = 'A' AND a.path = file_a JOIN c b ON b.repo = 'B' AND b.path = file_b"""
)
def pair_key(spark, sf):
    return comparing.keyed_file_pairs(_matches(spark, sf), _files(spark, sf), MODEL, THRESHOLD).drop(comparing.DEALT)


@query(
    f"""WITH {_MATCHES}, c AS (SELECT repo, path, sha256(content) AS sha FROM f)
, k AS (SELECT {_blob(f"'v1|{MODEL}|{THRESHOLD}'", 'file_a', 'a.sha', 'file_b', 'b.sha')} AS key FROM pairs JOIN c a ON a.repo = 'A' AND a.path = file_a JOIN c b ON b.repo = 'B' AND b.path = file_b)
SELECT CASE WHEN substr(key, 1, 1) < '4' THEN 'cached' ELSE 'new' END AS status, count(*) AS n FROM k GROUP BY ALL"""
)
def pair_status(spark, sf):
    keyed = comparing.keyed_file_pairs(_matches(spark, sf), _files(spark, sf), MODEL, THRESHOLD)
    return comparing.pair_status(keyed, keyed.filter(F.substr("key", F.lit(1), F.lit(1)) < "4"))


@query(f"WITH {_PARSED} SELECT * FROM x")
def parse_similar(spark, sf):
    return comparing.parse_similar(_replies(spark, sf))


@query(f"WITH {_PARSED} SELECT * FROM d")
def dedup_functions(spark, sf):
    return comparing.dedup_functions(comparing.parse_similar(_replies(spark, sf)))


@query(f"WITH {_PARSED} SELECT count(*) FILTER (composite_score > 60) AS high, count(*) FILTER (composite_score BETWEEN 40 AND 60) AS medium, count(*) FILTER (composite_score >= 20 AND composite_score < 40) AS low, count(*) FILTER (composite_score < 20) AS very_low, count(*) AS total FROM d")
def score_distribution(spark, sf):
    return comparing.score_distribution(comparing.dedup_functions(comparing.parse_similar(_replies(spark, sf))))


@query(f"WITH {_PARSED} SELECT ord, pos, file_a, file_b, name_a, name_b, composite_score FROM d ORDER BY composite_score DESC, ord, pos")
def report_sorted(spark, sf):
    found = comparing.dedup_functions(comparing.parse_similar(_replies(spark, sf)))
    return comparing.report_order(found).select("ord", "pos", "file_a", "file_b", "name_a", "name_b", "composite_score")


@query(
    f"""WITH {_PARSED}, c AS (SELECT ord, pos, data_structure * 0.25::DOUBLE + function_signature * 0.25::DOUBLE + algorithm_logic * 0.25::DOUBLE + naming_convention * 0.15::DOUBLE + protocol_conformance * 0.1::DOUBLE AS composite FROM x)
SELECT *, CASE WHEN composite > 60 THEN 'high' WHEN composite >= 40 THEN 'medium' WHEN composite >= 20 THEN 'low' ELSE 'very_low' END AS level FROM c"""
)
def composite_score(spark, sf):
    score = comparing.composite({d: F.col(d) for d in DIMENSIONS})
    return comparing.parse_similar(_replies(spark, sf)).select("ord", "pos", score.alias("composite"), comparing.level_of(score).alias("level"))
