"""Exact deduplication with a log-structured merge index of text digests.

- *Memtables.*  Each task keeps digest -> (smallest id, rows) of the rows it has
  read, up to ``memtable`` digests, and flushes it as a run sorted by digest.
- *Compaction.*  Runs are dealt out by digest and merged as sorted streams into
  larger ones of about ``run_digests``; of equal digests the smallest identifier
  stays and the rows add up.  Each run gets a Bloom filter of its digests that more
  than one row has, with ``filter_bits`` for each of them.
- *Lookup.*  A text probes the filter of the one run that may hold its digest.  If
  it misses, it is alone and never shuffled.  The filters are broadcast only if
  they add up to ``filter_bytes`` at most; beyond that, digests aren't filtered and
  every text joins the index by a shuffle.
- *Verification.*  Hits join the index, and their bytes are held against the kept
  text's bytes.  Digests under which texts differ are grouped anew by the texts
  themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .scratch import materialize


@dataclass(frozen=True)
class LsmDedup:
    """``digest_chars``: hex digits of the index key (64: all; tests shorten it to force collisions)."""

    memtable: int = 200_000
    run_digests: int = 1_000_000
    filter_bits: int = 12
    filter_hashes: int = 6
    filter_bytes: int = 64 << 20
    digest_chars: int = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _memtables(limit: int):
    def flush(table: dict) -> pa.RecordBatch:
        keys = sorted(table)
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array([table[k][0] for k in keys], pa.int64()), pa.array([table[k][1] for k in keys], pa.int64())], names=["digest", "keep_id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}
        for batch in batches:
            for d, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, n = table.get(d, (None, 0))
                table[d] = (i if low is None else low if i is None else min(low, i), n + 1)
                if len(table) >= limit:
                    yield flush(table)
                    table = {}
        if table:
            yield flush(table)

    return run


def _places(h1: np.ndarray, h2: np.ndarray, bits: np.ndarray | int, p: LsmDedup) -> Iterator[np.ndarray]:
    """Bits of a filter of ``bits`` that belong to a digest, from its two hashes."""
    bits = np.asarray(bits, np.uint64)
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    for k in range(p.filter_hashes):
        yield (h1 + np.uint64(k) * h2) % bits


def make_filter(h1: np.ndarray, h2: np.ndarray, p: LsmDedup) -> bytes:
    """The filter of digests, by their hashes: ``filter_bits`` for each, in whole 64-bit words."""
    words = np.zeros(max(1, -(-len(h1) * p.filter_bits // 64)), np.uint64)
    for at in _places(h1, h2, len(words) * 64, p):
        np.bitwise_or.at(words, (at // np.uint64(64)).astype(np.int64), np.uint64(1) << at % np.uint64(64))
    return words.tobytes()


_RUN = "run long, digest binary, keep_id long, n long, filter binary"


def _compact(p: LsmDedup):
    """Merged runs out of a stream sorted by run and digest (run, digest, keep_id, n, h1, h2); behind each run comes its filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, low, total, hashes = None, None, 0, (0, 0)
        repeated: list[tuple[int, int]] = []

        def batch_of(rows: list[tuple], filters: list[tuple]) -> pa.RecordBatch:
            every = [(*r, None) for r in rows] + [(k, None, None, None, f) for k, f in filters]
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array([r[k] for r in every], t) for k, t in enumerate(types)], names=["run", "digest", "keep_id", "n", "filter"])

        def sealed(k: int) -> list[tuple]:
            if not repeated:
                return []
            h = np.array(repeated, np.int64)
            repeated.clear()
            return [(k, make_filter(h[:, 0].copy(), h[:, 1].copy(), p))]

        for batch in batches:
            rows, filters = [], []
            for k, d, i, n, h1, h2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, d) == last:
                    low = i if low is None else low if i is None else min(low, i)
                    total += n
                    continue
                if last is not None:
                    rows.append((*last, low, total))
                    if total > 1:
                        repeated.append(hashes)
                    if k != last[0]:
                        filters += sealed(last[0])
                last, low, total, hashes = (k, d), i, n, (h1, h2)
            yield batch_of(rows, filters)
        if last is not None:
            if total > 1:
                repeated.append(hashes)
            yield batch_of([(*last, low, total)], sealed(last[0]))

    return run


def _hashes() -> list[Column]:
    return [F.xxhash64("digest").alias("h1"), F.xxhash64("digest", F.lit(1)).alias("h2")]


def _run_of(runs: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(2)), F.lit(runs).cast("long"))


def build_index(keyed: DataFrame, p: LsmDedup) -> tuple[DataFrame, int]:
    """Compacted runs of rows (digest, doc_id): run, digest, keep_id, n and, in a row of its own, the filter of a run; and the number of runs."""
    runs = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // p.run_digests))
    flushed = keyed.select("digest", "doc_id").mapInArrow(_memtables(p.memtable), "digest binary, keep_id long, n long")
    dealt = flushed.withColumn("run", _run_of(runs)).repartition("run").sortWithinPartitions("run", "digest")
    return materialize(dealt.select("run", "digest", "keep_id", "n", *_hashes()).mapInArrow(_compact(p), _RUN), "lsm-index"), runs


def _keyed(docs: DataFrame, p: LsmDedup, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), normalised(docs[text_col]).alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    return base.withColumn("digest", F.unhex(F.substring("text_sha256", 1, p.digest_chars)))


def _open(keyed: DataFrame, p: LsmDedup) -> tuple[DataFrame, Column]:
    """The index, and whether the filter of its run holds the ``digest`` of a row."""
    made, runs = build_index(keyed, p)
    index = made.filter("digest is not null").select("digest", "keep_id", "n")
    filters = made.filter("filter is not null").select("run", "filter")
    size = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    if size > p.filter_bytes:
        return index, F.lit(True)
    got = filters.orderBy("run").toArrow()
    parts = [np.frombuffer(x, np.uint64) for x in got.column(1).to_pylist()]
    lengths = np.zeros(runs, np.int64)  # in words; 0: no digest of the run repeats
    lengths[np.asarray(got.column(0)).astype(np.int64)] = [len(x) for x in parts]
    sent = keyed.sparkSession.sparkContext.broadcast((np.concatenate([*parts, np.zeros(1, np.uint64)]), lengths))

    @pandas_udf("boolean")
    def may_repeat(run: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.Series:
        words, lengths = sent.value
        starts = np.cumsum(lengths) - lengths
        k, a, b = (x.to_numpy().astype(np.int64) for x in (run, h1, h2))
        hit = lengths[k] > 0
        for at in _places(a, b, np.maximum(lengths[k], 1) * 64, p):
            at = np.where(hit, at, 0).astype(np.int64)
            hit &= words[starts[k] + at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1) == 1
        return pd.Series(hit)

    return index, may_repeat(_run_of(runs), *_hashes())


_COLS = ["doc_id", "keep_id", "group_size", "text_sha256"]


def _decided(hits: DataFrame, index: DataFrame) -> DataFrame:
    """_COLS of the rows (doc_id, norm, text_sha256, digest) that the filter lets pass, after byte verification."""
    hits = materialize(hits.select("doc_id", "norm", "text_sha256", "digest").join(index.filter("n > 1"), "digest", "left"), "lsm-hits")
    single = hits.filter("n is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    multi = hits.filter("n is not null")
    # the kept row's bytes meet those of every row of its digest; written, so that the join's sides are plain shuffles and a large group can be split
    keepers = multi.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("norm").alias("kept_norm"))
    keepers = materialize(keepers, "lsm-keepers")
    checked = multi.join(keepers, "digest").select("doc_id", "keep_id", F.col("n").alias("group_size"), "text_sha256", "digest", (F.col("norm") == F.col("kept_norm")).alias("__same"))
    checked = materialize(checked, "lsm-checked")
    wrong = checked.filter("not __same").select("digest").distinct()
    if wrong.isEmpty():
        return single.union(checked.select(_COLS))
    clash = multi.join(wrong, "digest", "left_semi")
    fixed = materialize(clash.groupBy("norm").agg(F.min("doc_id").alias("k"), F.count("*").alias("m")), "lsm-fixed")
    again = clash.select("doc_id", "norm", "text_sha256").join(fixed, "norm").select("doc_id", F.col("k").alias("keep_id"), F.col("m").alias("group_size"), "text_sha256")
    return single.union(checked.join(wrong, "digest", "left_anti").select(_COLS)).union(again.select(_COLS))


def exact_duplicates(docs: DataFrame, p: LsmDedup = LsmDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty; runs of white space equal one space; nothing is trimmed.
    The row with the smallest id of equal texts stays.  Rows that repeat an id and
    a text all count and share the result.  A row without an id counts in its
    group; it is kept only where no row of the group has an id, and keep_id is then
    null.  An empty table gives an empty result.  Other columns are ignored.
    """
    base = _keyed(docs, p, id_col, text_col)
    index, hit = _open(base, p)
    probed = base.withColumn("__hit", hit)
    alone = probed.filter(~F.col("__hit")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    out = alone.union(_decided(probed.filter("__hit"), index))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, p: LsmDedup = LsmDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, for each text: that with the smallest id; of rows that repeat id and text, any one.

    Rows that miss the filter stay where they are; only hits are shuffled.  Ids,
    nulls and white space count as in ``exact_duplicates``.
    """
    base = _keyed(docs, p, id_col, text_col)
    index, hit = _open(base, p)
    norm = normalised(docs[text_col])
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), docs[id_col].cast("long").alias("__id"), norm.alias("__norm"))
    own = own.withColumn("__sha", F.sha2("__norm", 256)).drop("__norm").withColumn("digest", F.unhex(F.substring("__sha", 1, p.digest_chars))).withColumn("__hit", hit)
    stays = _decided(base.withColumn("__hit", hit).filter("__hit"), index).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stays = materialize(stays.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct().withColumn("__stays", F.lit(True)), "lsm-stays")
    # a text has one row that stays, so rows are first held against it and then told apart
    hits = own.filter("__hit").alias("a").join(stays.alias("b"), (F.col("a.__sha") == F.col("b.__sha")) & F.col("a.__id").eqNullSafe(F.col("b.__id"))).select("a.__id", "a.__sha", "a.__row")
    hits = hits.groupBy("__id", "__sha").agg(F.first("__row").alias("__row"))
    return own.filter("not __hit").select("__row").union(hits.select("__row")).select("__row.*")
