"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listing is a host and a path prefix; it covers the host, all subdomains and all
paths that start with the prefix.  Named rules hold for a URL's host and path as
they are written.  Listed URLs without a name, and the URLs that are held against
them, are made canonical first: the host without user, port and closing dots, the
path without dot segments and with its needless percent escapes undone, at least
``/``.  A URL has one key for each suffix of its host and each listed prefix length
of its path.  Keys are looked up in a Bloom filter whose bits for one key lie in
one block of 512 bits; it has a fixed size, so it is broadcast whatever the list
holds.  Possible hits join the list itself, which removes the false positives.  Of
the rules that fit a URL the longest one wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .scratch import materialize


@dataclass(frozen=True)
class UrlFilter:
    """``blocks``: 64-byte blocks of the filter.  ``broadcast_rows``: longer lists are joined by a shuffle."""

    blocks: int = 1 << 14
    bits: int = 6
    broadcast_rows: int = 200_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    bare = F.regexp_replace(lower_ascii(host), r"(?s)^.*@", "")
    return F.regexp_replace(F.regexp_replace(bare, r":[0-9]*$", ""), r"\.+$", "")


def canonical_path(path: Column) -> Column:
    # escapes of letters, digits, hyphen, dot, underscore and tilde are undone; others stay, in capitals
    def undone(piece: Column, at: Column) -> Column:
        code = F.conv(F.substr(piece, F.lit(1), F.lit(2)), 16, 10).cast("int")
        c = F.char(code)
        rest = F.substr(piece, F.lit(3), F.length(piece))
        escape = (at > 0) & piece.rlike("^[0-9A-Fa-f]{2}")
        plain = F.concat(F.when(c.rlike("^[A-Za-z0-9._~-]$"), c).otherwise(F.concat(F.lit("%"), F.upper(F.substr(piece, F.lit(1), F.lit(2))))), rest)
        return F.when(escape, plain).when(at > 0, F.concat(F.lit("%"), piece)).otherwise(piece)

    plain = F.when(path.contains("%"), F.array_join(F.transform(F.split(path, "%", -1), undone), "")).otherwise(path)

    def walked(p: Column) -> Column:
        none = F.array().cast("array<string>")
        step = lambda s, x: F.when(x == ".", s).when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x)))
        parts = F.aggregate(F.split(F.substr(p, F.lit(2), F.length(p)), "/", -1), none, step)
        closing = F.when(p.rlike(r"/\.\.?$") & (F.size(parts) > 0), "/").otherwise("")
        return F.concat(F.lit("/"), F.array_join(parts, "/"), closing)

    rooted = F.element_at(F.transform(F.array(plain), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))), 1)
    return F.element_at(F.transform(F.array(rooted), lambda p: F.when(p.contains("/."), walked(p)).otherwise(p)), 1)


def _bits(key: Column, p: UrlFilter) -> list[Column]:
    """Block, then the bits in it."""
    h = F.xxhash64(key)
    return [F.pmod(h, F.lit(p.blocks)), *(F.pmod(F.xxhash64(key, F.lit(k)), F.lit(512)) for k in range(p.bits))]


def bloom_words(listing: DataFrame, p: UrlFilter) -> np.ndarray:
    """The filter of column ``key`` as 64-bit words, from at most 8 * blocks rows."""
    block, *bits = _bits(F.col("key"), p)
    rows = listing.select(block.alias("b"), F.explode(F.array(*bits)).alias("k"))
    word = (F.col("b") * 8 + (F.col("k") / 64).cast("long")).alias("w")
    got = rows.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("v")).toArrow()
    out = np.zeros(p.blocks * 8, np.int64)
    out[np.asarray(got.column(0))] = np.asarray(got.column(1))
    return out


def listing(urls: DataFrame) -> DataFrame:
    """Blocking rules without a name of the lines in column ``url``: a host, or a host and a path; blank lines and comments count for nothing."""
    line = F.trim(F.regexp_replace("url", "#.*$", ""))
    rows = urls.select(line.alias("line")).filter("line <> ''")
    path = F.concat(F.lit("/"), F.regexp_extract("line", "^[^/]*/(.*)$", 1))
    return rows.select(canonical_host(F.regexp_extract("line", "^[^/]*", 0)).alias("host"), canonical_path(path).alias("path"), F.lit("block").alias("verdict"), F.lit(False).alias("named"))


def filter_urls(pages: DataFrame, rules: DataFrame, p: UrlFilter = UrlFilter(), id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    ``rules``: host, path, verdict, and named (whether the rule shows in the
    result and holds for what is written; an unnamed listing is canonical, and only
    gives a verdict where no named rule fits).
    A null url, or one without ``://``, has an empty host and path and gets the
    default verdict.  Rows without an id and repeated rows are judged each.  Either
    table may be empty.  Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    url = pages[url_col].cast("string")
    base = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    listed = rules.select(lower_ascii(F.col("host")).alias("rh"), F.col("path").alias("rp"), "verdict", "named").withColumn("key", F.concat(F.when(F.col("named"), "r").otherwise("c"), F.lit("\n"), "rh", F.lit("\n"), "rp"))
    # one row a key: named rules first, then blocks
    listed = listed.groupBy("key").agg(F.min_by(F.struct("rh", "rp", "verdict", "named"), F.struct(~F.col("named"), F.col("verdict") != "block")).alias("r"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None)
    words = spark.sparkContext.broadcast(bloom_words(listed, p))

    @pandas_udf("boolean")
    def possible(block: pd.Series, *bits: pd.Series) -> pd.Series:
        w, b = words.value, block.to_numpy() * 8
        hit = np.ones(len(b), bool)
        for k in (x.to_numpy() for x in bits):
            hit &= (w[b + k // 64] >> (k % 64)) & 1 == 1
        return pd.Series(hit)

    small = listed.count() <= p.broadcast_rows
    # distinct host and path only: a hot page or host is looked up once a task and merged
    seen = base.select("host", "path").distinct()
    forms = F.array(
        F.struct(F.lit("r").alias("f"), F.col("host").alias("h"), F.col("path").alias("p")),
        F.struct(F.lit("c").alias("f"), canonical_host(F.col("host")).alias("h"), canonical_path(F.col("path")).alias("p")),
    )

    def keys_of(x: Column) -> Column:
        labels = F.split(x["h"], r"\.", -1)
        n = F.size(labels)
        suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
        prefixes = F.transform(F.filter(F.array(*(F.lit(k) for k in lengths)), lambda k: k <= F.length(x["p"])), lambda k: F.substr(x["p"], F.lit(1), k))
        return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(x["f"], F.lit("\n"), s, F.lit("\n"), p))))

    keys = seen.filter("host <> ''").select("host", "path", F.explode(forms).alias("__x")).select("host", "path", F.explode(keys_of(F.col("__x"))).alias("key")) if lengths else seen.limit(0).select("host", "path", F.lit("").alias("key"))
    hits = keys.filter(possible(*_bits(F.col("key"), p))).join(F.broadcast(listed) if small else listed, "key")
    size = F.struct(F.col("r.named"), F.length("r.rh") + F.length("r.rp"), F.length("r.rh"))
    # written, so that the join's sides are plain shuffles and a hot page's rows can be split
    best = materialize(hits.groupBy("host", "path").agg(F.max_by("r", size).alias("r")), "url-verdicts")
    # by its compressed size the table might be broadcast, which has no bound in memory
    out = base.join(best.hint("merge"), ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.when(F.col("r.named"), F.concat("r.rh", "r.rp")).alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
