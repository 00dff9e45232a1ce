"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes a set of hashed word shingles; texts with equal sets collapse.
2. Band keys of MinHash signatures bring candidates together.  Inside a bucket,
   signatures are compared batch by batch; a pair is given up once the posterior
   chance that its similarity reaches the threshold is below ``miss``.  Only a
   spanning forest of the surviving pairs leaves a bucket.
3. Clusters of surviving pairs gather the whole texts of their members, and every
   pair of a cluster that isn't connected yet is held against the full sets.  The
   sets are those of the words themselves, not of their hashes.
4. Connected components of the verified links give the result.

Large buckets and clusters are cut into blocks of bounded size.  In a first turn
each member goes to its own block, and the group's *pivot* (its least id) to all of
them; what reaches the pivot, in one block or another, is connected.  Only the
members that don't are *loose*, and only these meet the other blocks in a second
turn.  Jaccard distance is a metric, so a loose text whose distance to the pivot
differs from another's by more than the threshold allows can't be linked with it,
and the two don't meet.  So a group of copies, however large, moves once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import materialize
from .textvec import Words, text_chunks


@dataclass(frozen=True)
class NearDedup:
    """``num``/``den``: the least similarity as a fraction.  ``miss``: posterior chance at which a pair is pruned."""

    shingle: int = 5
    num: int = 80
    den: int = 100
    bands: int = 25
    rows: int = 5
    miss: float = 1e-5
    bucket_block: int = 1024
    cluster_block: int = 384
    cluster_shingles: int = 400_000
    broadcast_rows: int = 400_000

    def chance_missed(self) -> float:
        """Chance that a pair exactly at the threshold shares no band."""
        return (1 - (self.num / self.den) ** self.rows) ** self.bands

    def least_matches(self) -> list[tuple[int, int]]:
        """(values compared, least equal values to go on), after each batch.

        With a uniform prior, the posterior chance of p >= t after m of n equal
        values is P(Bin(n + 1, t) <= m).  Values are kept in one byte, so unequal
        ones agree with a chance of 1/256.
        """
        t = self.num / self.den
        t += (1 - t) / 256
        out = []
        for n in range(25, self.bands * self.rows + 1, 25):
            below, m = 0.0, -1
            while m < n:
                below += math.comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
                m += 1
                if below >= self.miss:
                    break
            out.append((n, m))
        return out


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; fewer words make one shingle, none makes none."""
    words = Words([x.lower() for x in texts])
    ends = np.cumsum(words.counts)
    out = []
    for to, n in zip(ends, words.counts, strict=True):
        h = words.h[to - n : to]
        if n == 0:
            out.append(h)
            continue
        width = min(k, int(n))
        s = np.zeros(n - width + 1, np.uint64)
        for i in range(width):
            s = (s ^ (s >> np.uint64(27))) * np.uint64(0x9FB21C651E98DF25) + h[i : n - width + 1 + i]
        s ^= s >> np.uint64(32)
        s *= np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(32)
        s.sort()
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return out


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(s: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """MinHash values: the least of each of the permutations x -> (x ^ c) * a of 32-bit hashes."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        best = np.minimum(best, ((low[at : at + 512, None] ^ xor) * mul).min(0))
    return best


def _signatures(p: NearDedup):
    xor, mul = _multipliers(p.bands * p.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            size, key, sig, bands = [], [], [], []
            for s in shingle_sets(texts, p.shingle):
                size.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if not len(s):
                    sig.append(None)
                    bands.append(None)
                    continue
                v = signature(s, xor, mul)
                sig.append(((v * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
                bands.append([xxhash.xxh3_64_intdigest(v[b * p.rows : (b + 1) * p.rows].tobytes(), b) - (1 << 63) for b in range(p.bands)])
            yield pa.record_batch(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "sig", "bands"],
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[list[dict]]:
    """Groups of equal key in a stream that is sorted by it."""
    held: list[dict] = []
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in key)
            if k != last and held:
                yield held
                held = []
            last = k
            held.append(row)
    if held:
        yield held


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _pairs_of(rows: list[dict]) -> Iterator[tuple[int, int, int]]:
    """For each member, the range of the others it meets: all later ones, or, if there are loose ones (side 0) in front, those behind them too but no others."""
    loose = sum(r["side"] == 0 for r in rows)
    for i in range(loose or len(rows) - 1):
        yield i, i + 1, len(rows)


def _forest(ids: list[int], parent: list[int]) -> Iterator[tuple[int, int]]:
    for i in range(len(ids)):
        root = _find(parent, i)
        if root != i:
            yield ids[i], ids[root]


def _start(rows: list[dict]) -> list[int]:
    """Parents: rows of one id or one label are connected already."""
    first: dict = {}
    parent = list(range(len(rows)))
    for i, r in enumerate(rows):
        at = first.setdefault(("label", r["label"]) if r.get("label") is not None else r["id"], i)
        parent[i] = at
    return parent


_MET = "src long, dst long, loose boolean, key long, near double"


def _met(edges: list[tuple[int, int]], loose: list[tuple[int, int, float | None]]) -> pa.RecordBatch:
    """Edges, and rows of members: (id, group, distance to the pivot) of those that a second turn needs."""
    n, m = len(edges), len(loose)
    return pa.record_batch(
        [
            pa.array([a for a, _ in edges] + [a for a, _, _ in loose], pa.int64()),
            pa.array([b for _, b in edges] + [None] * m, pa.int64()),
            pa.array([False] * n + [True] * m, pa.bool_()),
            pa.array([None] * n + [k for _, k, _ in loose], pa.int64()),
            pa.array([None] * n + [d for _, _, d in loose], pa.float64()),
        ],
        names=["src", "dst", "loose", "key", "near"],
    )


def _bucket_edges(p: NearDedup, key: tuple[str, ...]):
    steps = p.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        loose: list[tuple[int, int, float | None]] = []
        for rows in _groups(batches, key):
            if len(key) > 2 and rows[0]["side"] == 1:  # second turn: no loose rows here
                continue
            ids = [r["id"] for r in rows]
            sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), -1)
            parent = _start(rows)
            root = np.array([_find(parent, i) for i in range(len(rows))])
            for i, lo, hi in _pairs_of(rows):
                alive = lo + np.flatnonzero(root[lo:hi] != root[i])
                equal, at = np.zeros(len(alive), np.int64), 0
                for n, least in steps:
                    if not len(alive):
                        break
                    equal += (sig[alive, at:n] == sig[i, at:n]).sum(1)
                    alive, equal, at = alive[equal >= least], equal[equal >= least], n
                for j in alive.tolist():
                    a, b = _find(parent, i), _find(parent, j)
                    if a != b:
                        a, b = min(a, b), max(a, b)
                        parent[b] = a
                        root[root == b] = a
            out += _forest(ids, parent)
            if rows[0]["nb"] > 1 and rows[0]["side"] == 1:  # the pivot comes first
                loose += [(ids[i], rows[0]["key"], None) for i in range(1, len(rows)) if root[i] != root[0]]
            if len(out) + len(loose) > 50_000:
                yield _met(out, loose)
                out, loose = [], []
        yield _met(out, loose)

    return run


def exact_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sets of the k-word shingles of each text, numbered alike in all of them only if their words are the same."""
    words = Words([x.lower() for x in texts])
    ids = words.exact()
    width = int(ids.max(initial=0)) + 1
    at = ids
    for i in range(1, k):
        if len(ids) <= i:
            at = np.empty(0, np.int64)
            break
        _, at = np.unique(at[:-1] * width + ids[i:], return_inverse=True)
    ends = np.cumsum(words.counts)
    short: dict[bytes, int] = {}
    out = []
    for to, n in zip(ends.tolist(), words.counts.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(at[to - n : to - k + 1]))
        elif n:
            out.append(np.array([len(ids) + short.setdefault(ids[to - n : to].tobytes(), len(short))]))
        else:
            out.append(np.empty(0, np.int64))
    return out


def _verified_edges(p: NearDedup, key: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, key):
            if len(key) > 2 and rows[0]["side"] == 1:  # second turn: no loose rows here
                continue
            ids = [r["id"] for r in rows]
            sets = exact_sets([(r["text"] or "").encode() for r in rows], p.shingle)
            sizes = [len(s) for s in sets]
            _, local = np.unique(np.concatenate(sets), return_inverse=True)
            width = int(local.max(initial=0)) + 1
            bits, at = [], 0
            for n in sizes:
                flags = np.zeros(width, np.uint8)
                flags[local[at : at + n]] = 1
                bits.append(int.from_bytes(np.packbits(flags).tobytes(), "big"))
                at += n
            parent = _start(rows)
            for i, lo, hi in _pairs_of(rows):
                for j in range(lo, hi):
                    if p.den * min(sizes[i], sizes[j]) < p.num * max(sizes[i], sizes[j]):
                        continue
                    a, b = _find(parent, i), _find(parent, j)
                    if a == b:
                        continue
                    both = (bits[i] & bits[j]).bit_count()
                    if p.den * both >= p.num * (sizes[i] + sizes[j] - both):
                        parent[max(a, b)] = min(a, b)
            members = []
            if rows[0]["nb"] > 1 and rows[0]["side"] == 1:
                for i in range(len(rows)):
                    both = (bits[0] & bits[i]).bit_count()
                    members.append((ids[i], rows[0]["key"], 1 - both / max(1, sizes[0] + sizes[i] - both)))
            yield _met(list(_forest(ids, parent)), members)

    return run


def _own_block(df: DataFrame) -> DataFrame:
    """First turn: ``df`` (key, id, nb, pivot, tie: order of rows with one id, ...) with the block of each row; the pivot's rows go to every block."""
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("nb"))
    every = F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)
    return df.withColumn("side", F.lit(1)).withColumn("b", F.explode(F.when(F.col("id") == F.col("pivot"), every).otherwise(F.array(own)))).withColumn("__far", F.col("id") != F.col("pivot"))


def _run_first(df: DataFrame, make, name: str) -> DataFrame:
    key = ["key", "b"]
    return materialize(_own_block(df).repartition(*key).sortWithinPartitions(*key, "__far", "id", "tie").mapInArrow(make(tuple(key)), _MET), name)


def _run_second(loose: DataFrame, every: DataFrame, make, each: int) -> DataFrame:
    """Second turn.  ``loose``: key, band, id, ...; ``every``: key, id, nb, bands (those of the loose rows that it may link with), ...

    Loose rows of one group and band are dealt into blocks of ``each``, and each of
    these meets the blocks of the group's other members.
    """
    counts = materialize(loose.groupBy("key", "band").agg(F.ceil(F.count("*") / each).cast("long").alias("nl")), "near-loose-blocks")
    span = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    left = loose.join(counts, ["key", "band"]).withColumn("bi", F.pmod(F.xxhash64("id", F.lit(7)), F.col("nl"))).withColumn("bj", F.explode(span("nb"))).withColumn("side", F.lit(0)).drop("nl")
    right = every.withColumn("band", F.explode("bands")).drop("bands").join(counts, ["key", "band"])
    right = right.withColumn("bi", F.explode(span("nl"))).withColumn("bj", F.pmod(F.xxhash64("id", F.lit(5)), F.col("nb"))).withColumn("side", F.lit(1)).drop("nl")
    key = ["key", "band", "bi", "bj"]
    met = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "side", "id")
    return met.mapInArrow(make(tuple(key)), _MET).filter("not loose").select("src", "dst")


def _candidates(first: DataFrame, p: NearDedup) -> DataFrame:
    """Edges (src, dst) of a spanning forest of the pairs that survive in their buckets.  ``first``: id, sig, bands."""
    keys = first.select("id", F.explode("bands").alias("key"))
    many = keys.groupBy("key").agg(F.count("*").alias("__m"), F.min("id").alias("pivot")).filter("__m > 1")
    members = keys.join(many, "key").join(first.select("id", "sig"), "id").withColumn("nb", F.ceil(F.col("__m") / p.bucket_block).cast("long")).drop("__m").withColumn("tie", F.lit(0).cast("long"))
    make = lambda key: _bucket_edges(p, key)
    met = _run_first(members, make, "near-met")
    edges = met.filter("not loose").select("src", "dst")
    loose = met.filter("loose").select("key", F.col("src").alias("id")).distinct()
    if loose.isEmpty():
        return edges
    open_keys = loose.select("key").distinct()
    every = members.join(open_keys, "key", "left_semi").select("key", "id", "nb", "sig", F.array(F.lit(0)).alias("bands"))
    every = materialize(every, "near-open")
    left = every.join(loose, ["key", "id"], "left_semi").drop("bands").withColumn("band", F.lit(0))
    return edges.union(_run_second(left, every, make, p.bucket_block))


def _texts_of(base: DataFrame, plan: DataFrame, sigs: DataFrame, p: NearDedup) -> DataFrame:
    """``plan`` with the texts of its ids.  A row that repeats an id and a text comes once, so that repeated rows can't heap up in a block."""
    few = plan.count() <= p.broadcast_rows
    wanted = base.filter("doc_id is not null").withColumnRenamed("doc_id", "id").join(F.broadcast(plan) if few else plan, "id")
    again = sigs.groupBy(F.col("doc_id").alias("id"), "set_key").agg(F.count("*").alias("n")).filter("n > 1").select("id").distinct().join(plan.select("id"), "id", "left_semi")
    again = materialize(again, "near-repeated")
    if again.isEmpty():
        return wanted
    cols = wanted.columns
    marked = wanted.join(again.withColumn("__again", F.lit(True)), "id", "left")
    rest = [c for c in cols if c not in ("id", "text")]
    once = marked.filter("__again").groupBy("id", F.sha2("text", 256).alias("__t")).agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in rest)).select(*cols)
    return marked.filter("__again is null").select(*cols).union(once)


def _links(clusters: DataFrame, first: DataFrame, sigs: DataFrame, base: DataFrame, p: NearDedup) -> DataFrame:
    """Edges (src, dst) of verified links that connect what ``clusters`` (id, component) hold together."""
    size = F.struct(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    sizes = clusters.join(first.select("id", "n_shingles"), "id").groupBy("component").agg(size.alias("__s"))
    blocks = F.greatest(F.ceil(F.col("__s.m") / p.cluster_block), F.ceil(F.col("__s.s") / p.cluster_shingles)).cast("long")
    plan = materialize(clusters.join(sizes, "component").select("id", F.col("component").alias("key"), blocks.alias("nb"), F.col("component").alias("pivot")), "near-plan")
    make = lambda key: _verified_edges(p, key)
    met = _run_first(_texts_of(base, plan, sigs, p).withColumn("label", F.lit(None).cast("long")).withColumn("tie", F.xxhash64("text")), make, "near-verified")
    edges = met.filter("not loose").select("src", "dst")
    members = met.filter("loose").groupBy("key", F.col("src").alias("id")).agg(F.min("near").alias("near"), F.max("near").alias("far"))
    if members.isEmpty():
        return edges
    # which members of the large clusters are connected, and to the pivot
    found = connected_components(edges, "near-first")
    members = materialize(members.join(found, "id", "left").select("id", "key", "near", "far", F.coalesce("component", "id").alias("label")), "near-members")
    loose = members.filter("label <> key")
    if loose.isEmpty():
        return edges
    # distances to the pivot differ by 1 - threshold at most between texts that may be linked; bands of a twentieth, one more for rounding
    reach = 1 - p.num / p.den + 1e-9
    lo, hi = F.floor((F.col("near") - reach) * 20).cast("int"), F.floor((F.col("far") + reach) * 20).cast("int")
    kept = loose.withColumn("band", F.explode(F.sequence(F.floor(F.col("near") * 20).cast("int"), F.floor(F.col("far") * 20).cast("int"))))
    bands = kept.groupBy("key").agg(F.collect_set("band").alias("all"))
    open_plan = members.join(bands, "key").withColumn("bands", F.filter("all", lambda x: x.between(lo, hi))).filter(F.size("bands") > 0)
    open_plan = materialize(open_plan.join(plan.select("id", "nb"), "id").select("id", "key", "nb", "label", "bands"), "near-open")
    every = _texts_of(base, open_plan, sigs, p).select("key", "id", "nb", "label", "text", "bands")
    left = every.drop("bands").join(kept.select("key", "id", "band"), ["key", "id"])
    return edges.union(_run_second(left, every, make, p.cluster_block))


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null and blank texts have no shingles and link with nothing.  Repeated rows
    (same id, same text) each get the result of their document; an id with
    several texts links through any of them.  A row without an id can't be named
    by others: its component_id is null and it is kept.  An empty table gives an
    empty result.  Other columns are ignored, whatever their names.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sigs = materialize(base.mapInArrow(_signatures(p), "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>"), "near-signatures")
    nodes = sigs.filter("doc_id is not null and set_key is not null")
    reps = nodes.groupBy("set_key").agg(F.min("doc_id").alias("id"))
    # one row per distinct set: the signature travels with the smallest id
    first = nodes.groupBy("set_key").agg(F.min_by(F.struct("doc_id", "n_shingles", "sig", "bands"), "doc_id").alias("r")).select(F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n_shingles"), F.col("r.sig").alias("sig"), F.col("r.bands").alias("bands"))
    first = materialize(first, "near-distinct")
    clusters = connected_components(_candidates(first, p), "near-clusters")  # id, component
    found = connected_components(_links(clusters, first, sigs, base, p), "near-links")

    # every node: document -> smallest id of its set -> smallest id of the component
    named = reps.join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    out = sigs.join(named, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
