"""Variable-capacity best-fit packing of documents into training sequences.

Documents are measured in words and one end token.  A document longer than the
largest permitted length fills whole sequences of that length; what remains of it
is packed like the rest.  Pieces are dealt into blocks of bounded size, and each
block is packed by itself, largest piece first: a piece goes into the open bin
that it leaves the least room in; if none has room, a bin is opened.

The permitted lengths are chosen jointly from the lengths of the block's pieces.
For each capacity, the sums that the pieces still to come can make tell how far a
new bin can be filled; the bin that will cost least for each token, once it has
shrunk to that, is opened.  A block is also packed with each single capacity in
front, and the cheapest packing stays.  At the end each bin shrinks to the least
permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


@dataclass(frozen=True)
class Packing:
    """A bin of capacity c costs ``overhead + c + c * c / attention``.  ``block_rows``: pieces packed together, about."""

    capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    overhead: int = 64
    attention: int = 16384
    block_rows: int = 20_000

    def cost(self, c: int) -> float:
        return self.overhead + c + c * c / self.attention


    def shrunk(self, used: int) -> int:
        return self.capacities[bisect_left(self.capacities, used)]


def reachable(lengths: Iterable[int], top: int) -> dict[int, int]:
    """For each length, the sums up to ``top`` that pieces of at most that length can make, each used as often as wanted, as the bits of a number."""
    out, sums, mask = {}, 1, (1 << top + 1) - 1
    for n in sorted(set(lengths)):
        step = n
        while step <= top:
            sums |= sums << step & mask
            step *= 2
        out[n] = sums
    return out


def opening_size(length: int, left: int, sums: int, p: Packing) -> int:
    """The capacity that costs least for each token that a bin with this piece can hold: as far as the sums fill it, and ``left`` tokens are to come."""
    best, cost = p.capacities[-1], float("inf")
    for c in p.capacities:
        if c < length:
            continue
        room = c - length
        held = length + min((sums & (1 << room + 1) - 1).bit_length() - 1, left)
        each = p.cost(p.shrunk(held)) / held
        if each < cost:
            best, cost = c, each
    return best


def place(lengths: list[int], opening: Callable[[int, int], int], p: Packing) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the capacity of each bin.  Lengths are sorted, the largest first."""
    left = sum(lengths)
    rooms: list[tuple[int, int]] = []  # (room, bin)
    where, offsets, used = [], [], []
    for n in lengths:
        left -= n
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b = len(used)
            used.append(0)
            room = opening(n, left)
        where.append(b)
        offsets.append(used[b])
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    return where, offsets, [p.shrunk(u) for u in used]


def best_fit(lengths: Iterable[int], p: Packing = Packing()) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of the packings that the openings give; the first of equals, by the sums."""
    lengths = list(lengths)
    sums = reachable(lengths, p.capacities[-1])
    rules: list[Callable[[int, int], int]] = [lambda n, left: opening_size(n, left, sums[n], p)]
    rules += [lambda n, left, c=c: max(c, p.shrunk(n)) for c in p.capacities]
    return min((place(lengths, rule, p) for rule in rules), key=lambda x: sum(map(p.cost, x[2])))


def pack(docs: DataFrame, p: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length (tokens of the document), bin_id, offset, capacity.

    A null or blank text is one token, the end.  Ties are packed by doc_id, then by
    the length of the document; repeated rows are packed each.  The bins depend on
    the rows of the table alone, not on their order or partitions.  A row without an id
    is packed like any other, with a null doc_id.  An empty table gives an empty
    result.  Other columns are ignored, whatever their names.
    """
    top = p.capacities[-1]
    n_words = F.regexp_count(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    # rows that repeat an id and a length are counted and numbered, so that what is dealt into a block depends on the table alone
    lengths = docs.select(docs[id_col].cast("long").alias("doc_id"), (n_words + 1).cast("long").alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("m"))
    base = materialize(lengths, "pack-lengths")
    total = base.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    rows = base.select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top)), lambda i: F.struct(i.alias("piece"), (i * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - i * top).alias("length")))
    rows = rows.select("doc_id", "n", "copy", F.inline(pieces))
    # full pieces are bins of their own; the rest, at most one piece a row, is dealt into blocks
    name = F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "n", "copy", "piece")
    full = rows.filter(F.col("length") == top).select("doc_id", "piece", "start", "length", name.alias("bin_id"), F.lit(0).cast("long").alias("offset"), F.lit(top).cast("long").alias("capacity"))
    blocks = max(1, -(-total // p.block_rows))
    rest = rows.filter(F.col("length") < top).withColumn("block", F.pmod(F.xxhash64("doc_id", "n", "copy"), F.lit(blocks)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "n", "copy"], ascending=[False, True, True, True], na_position="last")
        where, offsets, sizes = best_fit(pdf["length"].tolist(), p)
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].astype("Int64"),
                "piece": pdf["piece"],
                "start": pdf["start"],
                "length": pdf["length"],
                "bin_id": [f"{key[0]}-{b}" for b in where],
                "offset": offsets,
                "capacity": [sizes[b] for b in where],
            }
        )

    packed = rest.groupBy("block").applyInPandas(run, "doc_id long, piece long, start long, length long, bin_id string, offset long, capacity long")
    return full.union(packed)
