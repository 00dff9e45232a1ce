"""Column expressions on paths, contents and summaries."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..config import LANGUAGES

HASH_VERSION = "v1"
PLACEHOLDER_FILE = json.dumps({"purpose": "unknown", **{k: [] for k in ("exports", "imports", "frameworks", "patterns", "key_snippets")}})
PLACEHOLDER_DIR = json.dumps({"purpose": "unknown", **{k: [] for k in ("key_exports", "frameworks", "patterns")}, "children_overview": ""})


def line_count(content: Column) -> Column:
    """Line feeds, and one more if the text ends without one."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return (breaks + ((content != "") & ~F.endswith(content, F.lit("\n"))).cast("int")).cast("int")


def extension(path: Column) -> Column:
    """Last suffix of the file name in lower case, with its dot; a leading dot is no suffix."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    ext = extension(path)
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, ext), F.ltrim(ext, F.lit(".")))


def parent_dir(path: Column) -> Column:
    """Path less its last part; the root is an empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def digest16(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, NUL between them."""
    zero = F.lit(b"\x00")
    joined: list[Column] = []
    for p in parts:
        joined += [zero] * bool(joined) + [p.cast("binary")]
    return F.substring(F.sha2(F.concat(*joined), 256), 1, 16)


def multiset_digest(entries: list[Column]) -> Column:
    """Text of the aggregated ``digest_lanes`` of a group: the same for the same entries in any order, and another one if one of them changes.

    It adds up, so a group of any size is one short row on every side of a shuffle.
    """
    return F.concat_ws("-", *(x.cast("string") for x in entries))


def digest_lanes(entry: Column) -> list[Column]:
    """Four numbers of 60 bits from the SHA-256 of an entry; sums of them stand for a multiset of entries."""
    h = F.sha2(entry, 256)
    return [F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)").alias(f"lane{k}") for k in range(4)]


def content_hash(content: Column, lang: Column) -> Column:
    """Key of a file's summary: content and language, not the path."""
    return digest16(F.concat(F.lit(f"{HASH_VERSION}|lang="), lang), content)


def content_sha(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def pair_key(path_a: Column, sha_a: Column, path_b: Column, sha_b: Column, model: str, threshold: int) -> Column:
    """Key of a comparison: model, threshold, both paths and the digests of both contents."""
    return digest16(F.lit(f"{HASH_VERSION}|{model}|{threshold}"), path_a, sha_a, path_b, sha_b)


def summary_text(summary: Column) -> Column:
    """Plain text of a directory summary: its fields joined by spaces; a summary that isn't JSON stands for itself."""
    v = F.try_parse_json(summary)

    def strings(field: str) -> Column:
        return F.array_join(F.try_variant_get(v, f"$.{field}", "array<string>"), " ")

    def string(field: str) -> Column:
        return F.try_variant_get(v, f"$.{field}", "string")

    parts = F.array(string("purpose"), strings("key_exports"), strings("frameworks"), strings("patterns"), string("children_overview"))
    return F.when(v.isNull(), summary).otherwise(F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), " "))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores, of three characters or more."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]{3,})"), F.lit(1))
    return F.array_distinct(found)


def jaccard(common: Column, size_a: Column, size_b: Column) -> Column:
    """|A and B| / |A or B| from the sizes; 0 if either is empty."""
    return F.when((size_a == 0) | (size_b == 0), F.lit(0.0)).otherwise(common / (size_a + size_b - common))


# made when first used: a worker that imports this module has no session to make them in


@cache
def _ratio_udf():
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "root", y or "root").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return pandas_udf(ratio, "double")


@cache
def _decimals_udf():
    def decimals(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else f"{v:.2f}" for v in x], dtype="object")

    return pandas_udf(decimals, "string")


def name_ratio(a: Column | str, b: Column | str) -> Column:
    """difflib's ratio of two directory names (root: "root").  Not symmetric, so A stays on the left."""
    return _ratio_udf()(a, b)


def two_decimals(x: Column | str) -> Column:
    """Two decimals as Python formats them (half to even on the binary value); the SQL format function rounds otherwise."""
    return _decimals_udf()(x)


def decode(raw: bytes) -> str:
    """UTF-8 with bad bytes left out, line ends made into line feeds."""
    return re.sub("\r\n?", "\n", raw.decode("utf-8", "ignore"))
