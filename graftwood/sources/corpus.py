"""The given tables as source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import language, line_count

EXTENSION_OF = {"en": ".py", "fr": ".js", "de": ".go", "es": ".java"}


def files_of_documents(docs: DataFrame) -> DataFrame:
    """``documents`` as files of two trees: A and B by the parity of the id, in one folder for each language and source."""
    ext = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in EXTENSION_OF.items() for x in p)), F.col("lang")), F.lit(".c"))
    folder = F.concat("lang", F.lit("/"), "source")
    path = F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), ext)
    return docs.select(
        F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("repo"),
        path.alias("path"),
        folder.alias("dir"),
        language(path).alias("language"),
        line_count(F.col("text")).alias("line_count"),
        F.col("text").alias("content"),
    )


def files_of_pages(pages: DataFrame) -> DataFrame:
    """``pages`` as one deeper tree: host, then the parts of the path; the page's own file below."""
    bare = F.regexp_replace(F.regexp_replace("url", r"^[^:]*://", ""), r"[?#].*$", "")
    folder = F.regexp_replace(bare, "/+$", "")
    path = F.concat(folder, F.lit("/"), F.col("page_id").cast("string"), F.lit(".js"))
    return pages.select(F.lit("A").alias("repo"), path.alias("path"), folder.alias("dir"), F.lit("javascript").alias("language"), line_count(F.col("html")).alias("line_count"), F.col("html").alias("content"))
