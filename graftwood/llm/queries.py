"""Queries over the given tables, one for each operator, with production parameters."""

from __future__ import annotations

import logging
import pkgutil
from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession

from .brown_lm import score as brown_score
from .cotrain import score as quality_score
from .decontaminate import contaminated
from .exact_dedup import exact_duplicates
from .html_text import extract
from .near_dedup import NearDedup, near_duplicates
from .packing import pack
from .pii import pseudonymise
from .secrets import scan
from .url_filter import filter_urls, listing

log = logging.getLogger(__name__)

#: Setting with the key of the pseudonyms; Spark hides the values of settings named so.  Without it an application makes a key of its own, and its pseudonyms link with no other's.
PII_KEY = "spark.graftwood.pii.secret"
_made_keys: dict[str, str] = {}

URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Setting with the path of a list of blocked URLs, one a line (# begins a comment).  Without it the list beside this module holds, which OP3_SQL repeats.
URL_LIST_PATH = "spark.graftwood.url.list"
URL_LIST = tuple(line for line in pkgutil.get_data(__package__, "url_list.txt").decode().split("\n") if line and not line.startswith("#"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_score(_table(spark, sf_dir, "documents"))


def op2_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get(URL_LIST_PATH, "")
    urls = spark.read.text(path).toDF("url") if path else spark.sql(f"SELECT * FROM VALUES {', '.join(f"('{u}')" for u in URL_LIST)} AS t(url)")
    rows = [f"('{h}', '{p}', '{v}', true)" for v, h, p in URL_RULES]
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(host, path, verdict, named)")
    return filter_urls(_table(spark, sf_dir, "pages"), rules.union(listing(urls)))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def _pii_key(spark: SparkSession) -> str:
    key = spark.conf.get(PII_KEY, "")
    if not key:
        log.warning("%s isn't set: the pseudonyms of this application link with those of no other", PII_KEY)
        key = _made_keys.setdefault(spark.sparkContext.applicationId, token_hex(32))
    return key


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), _pii_key(spark))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), NearDedup(shingle=3, num=85, den=100, bands=25))


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

#: The listed URLs are whole hosts, so that only the host's canonical form counts.
OP3_SQL = rf"""
WITH rules(host, path, verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), listed(host) AS (VALUES {", ".join(f"('{u[:-1]}')" for u in URL_LIST)})
, p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), seen AS (SELECT DISTINCT host, path, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS bare FROM p)
, best AS (
  SELECT s.host, s.path, arg_max(r, length(r.host) + length(r.path)) AS r
  FROM seen s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY s.host, s.path
), hit AS (SELECT DISTINCT s.host, s.path FROM seen s JOIN listed l ON s.bare = l.host OR ends_with(s.bare, '.' || l.host))
SELECT p.page_id, p.host, p.path, b.r.host || b.r.path AS rule, coalesce(b.r.verdict, CASE WHEN h.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best b ON p.host = b.host AND p.path = b.path LEFT JOIN hit h ON p.host = h.host AND p.path = h.path
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_brown_lm,
        op2_lsm_exact_dedup,
        op3_url_filter,
        op4_best_fit_packing,
        op5_pii_pseudonyms,
        op6_template_decontamination,
        op7_minhash_near_dedup,
        op8_cotrained_quality,
        op9_main_text,
        op10_secret_scan,
    )
}
ORACLES: dict[str, str] = {"op2_lsm_exact_dedup": OP2_SQL, "op3_url_filter": OP3_SQL}
