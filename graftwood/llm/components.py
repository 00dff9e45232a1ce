"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component: smallest id reachable) for every id in ``edges`` (src, dst); ids without an edge don't appear.

    Each round moves O(edges) rows and nothing is collected but counts.  Rounds
    stop when a round changes no edge (checked by a sum of hashes of the rows).
    """
    e = edges.filter("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = materialize(e, name)
    mark = None
    while True:
        # large star: neighbours above a node go to the least of its neighbours and itself
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join's sides are plain shuffles and the rows of a hub can be split
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), name)
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its neighbours below go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = materialize(small.filter("u <> v").distinct(), name)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    ids = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return ids.union(roots)
