"""Brown class-based bigram model: P(w | v) = P(c(w) | c(v)) * P(w | c(w)).

Words are known by 64-bit hashes.

1. Counts of all training words, over the whole table (a shuffle of word counts).
2. Exchange clustering of a core: the ``units`` most frequent words, and every other
   word by its ending, in one of ``endings`` groups.  The two parameters bound the
   matrix of their bigrams.
3. Every other training word that occurs ``least`` times or more moves to the class
   that makes its own neighbours likeliest: the classes before and behind each of
   its occurrences meet its count in one shuffle.  So the clustered vocabulary
   grows with the input.  Only rarer and unseen words go by their ending.
4. Class sequences of all texts.  The most frequent words, ``head`` of them at most,
   are looked up in a table that is broadcast (17 bytes a row); the places of all
   others join the table of words and are filled in.
5. Transitions are counted over the class sequences of the training texts, and all
   sequences are scored.

Emission is add-one within a class, with one place for unseen words; transitions
are smoothed towards the class's share of all tokens.  The sum of log10(count + 1)
over a text serves both this model and the unigram base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .textvec import CHUNK, Words, tally, text_chunks

#: Hash of the token that ends each text.
END = np.uint64(1)
#: Tokens of class sequences that are scored or counted at once; bounds the temporary arrays (about 60 bytes a token).
SEQUENCE = 1 << 18


@dataclass(frozen=True)
class BrownLM:
    units: int = 1000
    endings: int = 256
    classes: int = 128
    sweeps: int = 8
    least: int = 2
    head: int = 600_000
    backoff: float = 20.0
    held_fold: int = 2
    folds: int = 7


def _tokens(texts: list[bytes]):
    """Hash, ending and text of every token, an end after each text's words."""
    words = Words([x.lower() for x in texts])
    n = len(words.h) + len(texts)
    ends = np.cumsum(words.counts + 1) - 1
    inner = np.ones(n, bool)
    inner[ends] = False
    h, last = np.full(n, END, np.uint64), np.zeros(n, np.int64)
    h[inner] = words.h
    last[inner] = words.last()
    return h, last, np.repeat(np.arange(len(texts)), words.counts + 1), words.counts + 1


def _endings(last: np.ndarray, p: BrownLM) -> np.ndarray:
    return (((last * 0x9E3779B1) >> 7) % p.endings).astype(np.int64)


def _count(p: BrownLM, limit: int = 2_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            return pa.record_batch([pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), pa.array(n)], names=["h", "e", "n"])

        for _, texts in text_chunks(batches):
            h, last, _, _ = _tokens(texts)
            order = np.argsort(h, kind="stable")
            h, e = h[order], _endings(last, p)[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            held.append((np.stack([h[first], e[first].view(np.uint64)], 1), np.diff(np.append(first, len(h)))))
            size += len(first)
            if size > limit:
                keys, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                order = np.argsort(keys[:, 0], kind="stable")
                keys, n = keys[order], n[order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:, 0] != keys[:-1, 0])))
                held, size = [(keys[first], np.add.reduceat(n, first))], len(first)
                if size > limit // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _unit_of(h: np.ndarray, last: np.ndarray, top: np.ndarray, order: np.ndarray, p: BrownLM) -> np.ndarray:
    at = np.minimum(np.searchsorted(top, h), len(top) - 1)
    return np.where(top[at] == h, order[at], len(top) + _endings(last, p))


def _bigrams(p: BrownLM, top: np.ndarray):
    order = np.arange(len(top))
    width = len(top) + p.endings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for _, texts in text_chunks(batches):
            h, last, _, _ = _tokens(texts)
            u = _unit_of(h, last, top, order, p)
            end = int(_unit_of(np.array([END]), np.array([0]), top, order, p)[0])
            code = np.concatenate(([end], u[:-1])) * width + u
            k, n = np.unique(code, return_counts=True)
            keys, counts = tally(np.concatenate((keys, k)), np.concatenate((counts, n)))
        yield pa.record_batch([pa.array(keys), pa.array(counts)], names=["code", "n"])

    return run


def exchange(counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each unit: units move, one at a time, to the class that raises the likelihood of the class bigrams most."""
    size = len(counts)
    total = counts.sum(0) + counts.sum(1)
    by = np.argsort(-total, kind="stable")
    cls = np.zeros(size, np.int64)
    cls[by] = np.arange(size) % classes
    hot = np.eye(classes)[cls]
    g = hot.T @ counts @ hot
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for w in by.tolist():
            if not total[w]:
                continue
            own = counts[w, w]
            right = np.bincount(cls, counts[w], classes)
            left = np.bincount(cls, counts[:, w], classes)
            a = cls[w]
            right[a] -= own
            left[a] -= own
            # without w
            g[a] -= right
            g[:, a] -= left
            g[a, a] -= own
            row, col = g.sum(1) + left, g.sum(0) + right
            out_n, in_n = right.sum() + own, left.sum() + own
            gain = (f(g + right[None, :]) - f(g)).sum(1) + (f(g.T + left[None, :]) - f(g.T)).sum(1)
            d = np.diagonal(g)
            k = np.arange(classes)
            gain += f(d + right[k] + left[k] + own) - f(d + right[k]) - f(d + left[k]) + f(d)
            gain -= f(row + out_n) - f(row) + f(col + in_n) - f(col)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            g[b] += right
            g[:, b] += left
            g[b, b] += own
            cls[w] = b
            moved += b != a
        if not moved:
            break
    return cls


def _neighbours(p: BrownLM, top: np.ndarray, cls: np.ndarray):
    """(h, code, n): how often a word outside the core stands between two classes, code = before * classes + behind."""
    order = np.arange(len(top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = cls[int(_unit_of(np.array([END]), np.array([0]), top, order, p)[0])]
        for _, texts in text_chunks(batches):
            h, last, _, _ = _tokens(texts)
            unit = _unit_of(h, last, top, order, p)
            c = cls[unit]
            code = np.concatenate(([end], c[:-1])) * p.classes + np.concatenate((c[1:], [end]))
            own = unit >= len(top)
            h, code = h[own], code[own]
            by = np.lexsort((code, h))
            h, code = h[by], code[by]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])))) if len(h) else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(h[first].view(np.int64)), pa.array(code[first].astype(np.int32)), pa.array(np.diff(np.append(first, len(h))).astype(np.int64))], names=["h", "code", "n"])

    return run


def _likely(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, behind): what one neighbour of each class adds to the log-likelihood of a word in each class; rows are neighbours."""
    g = g + 0.1
    return np.log(g / g.sum(0, keepdims=True)), np.log(g / g.sum(1, keepdims=True)).T


def _assign(p: BrownLM, top: np.ndarray, cls: np.ndarray, g: np.ndarray):
    """Words of a stream sorted by h with their classes: h, n, c.  A row of code < 0 holds the word's count, and its ending as -1 - code."""
    before, behind = _likely(g)
    k = p.classes

    def classed(h: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        met = code >= 0
        left = np.bincount(word[met] * k + code[met] // k, n[met], len(first) * k).reshape(-1, k)
        right = np.bincount(word[met] * k + code[met] % k, n[met], len(first) * k).reshape(-1, k)
        best = (left @ before + right @ behind).argmax(1)
        total, ending = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        total[word[~met]], ending[word[~met]] = n[~met], -1 - code[~met]
        words = h[first].view(np.uint64)
        at = np.minimum(np.searchsorted(top, words), len(top) - 1)
        c = np.where((left.sum(1) > 0) & (total >= p.least), best, cls[len(top) + ending])
        c = np.where(top[at] == words, cls[at], c)
        return pa.record_batch([pa.array(words.view(np.int64)), pa.array(total), pa.array(c.astype(np.int32))], names=["h", "n", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((x, np.asarray(c).astype(np.int64))) for x, c in zip(held, batch.columns, strict=True)]
            h = held[0]
            whole = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last word may go on
            if whole:
                yield classed(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield classed(*held)

    return run


def _sequences(p: BrownLM, model):
    """A row for each text with the classes of its tokens, as far as the head knows them, and a row for each word in it that it doesn't know, with its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        head, counts, classes, by_ending = m["head"], m["counts"], m["head_cls"], m["cls"][len(m["top"]) :]
        pid, seq = TaskContext.get().partitionId(), 0
        log_head = np.log10(counts + 1.0)
        for batch, texts in text_chunks(batches, limit=CHUNK):
            h, last, doc, n = _tokens(texts)
            at = np.minimum(np.searchsorted(head, h), len(head) - 1)
            known = (head[at] == h) & (counts[at] > 0)
            c = np.where(known, classes[at], by_ending[_endings(last, p)]).astype(np.uint8)
            logs = np.bincount(doc, np.where(known, log_head[at], 0.0), len(texts))
            n_known = np.bincount(doc, known, len(texts)).astype(np.int64)
            rid = (np.int64(pid) << np.int64(36)) + seq + np.arange(len(texts))
            seq += len(texts)
            starts = np.cumsum(n) - n
            rare, dr, place = h[~known], doc[~known], (np.flatnonzero(~known) - starts[doc[~known]]).astype(np.int32)
            by = np.lexsort((place, rare, dr))
            rare, dr, place = rare[by], dr[by], place[by]
            first = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (dr[1:] != dr[:-1])))) if len(rare) else np.empty(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(rare)).astype(np.int32)), pa.array(place))
            k, r = len(texts), len(first)
            none = lambda n, t: pa.nulls(n, t)
            both = lambda a, b: pa.concat_arrays([a, b])
            flat = pa.py_buffer(c.tobytes())
            offsets = pa.py_buffer(np.append(starts, len(c)).astype(np.int32).tobytes())
            yield pa.record_batch(
                [
                    pa.array(np.concatenate((rid, rid[dr[first]] if r else np.empty(0, np.int64)))),
                    both(batch.column(0).cast(pa.int64()), none(r, pa.int64())),
                    both(pa.array(n), none(r, pa.int64())),
                    both(pa.array(n_known), none(r, pa.int64())),
                    both(pa.array(logs), none(r, pa.float64())),
                    both(pa.Array.from_buffers(pa.binary(), k, [None, offsets, flat]), none(r, pa.binary())),
                    both(none(k, pa.int64()), pa.array(rare[first].view(np.int64))),
                    both(none(k, places.type), places),
                ],
                names=["rid", "doc_id", "n_tokens", "n_known", "logs", "seq", "h", "places"],
            )

    return run


_ROW = "rid long, doc_id long, n_tokens long, n_known long, logs double, seq binary, h long, places array<int>"


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, n_known, logs, seq, with the classes ``fixes`` (c, places) filled in."""
    for batch in batches:
        col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        n = np.asarray(col["n_tokens"])
        starts = np.cumsum(n) - n
        flat = np.frombuffer(b"".join(col["seq"].to_pylist()), np.uint8).copy()
        owner = np.asarray(pc.list_parent_indices(col["fixes"]))
        fixes = pc.list_flatten(col["fixes"])
        if len(fixes):
            places = pc.struct_field(fixes, "places")
            which = np.asarray(pc.list_parent_indices(places))
            flat[starts[owner[which]] + np.asarray(pc.list_flatten(places))] = np.asarray(pc.struct_field(fixes, "c"))[which]
        offsets = pa.py_buffer(np.append(starts, len(flat)).astype(np.int32).tobytes())
        seq = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(flat.tobytes())])
        yield pa.record_batch([col["doc_id"], col["n_tokens"], col["n_known"], col["logs"], seq], names=["doc_id", "n_tokens", "n_known", "logs", "seq"])


def _sequence_chunks(batches: Iterator[pa.RecordBatch], end: int):
    """(batch, classes of its tokens, classes before them, text of each) for slices of about SEQUENCE tokens.

    Each text ends with the end token, so the class before its first is that.
    """
    for batch, seqs in text_chunks(batches, "seq", SEQUENCE):
        c = np.frombuffer(b"".join(seqs), np.uint8).astype(np.int64)
        yield batch, c, np.concatenate(([end], c[:-1]))[: len(c)], np.repeat(np.arange(len(seqs)), list(map(len, seqs)))


def _transitions(p: BrownLM, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.classes * p.classes, np.int64)
        for _, c, before, _ in _sequence_chunks(batches, end):
            total += np.bincount(before * p.classes + c, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["code", "n"])

    return run


def _scores(end: int, trans: np.ndarray, emit: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, c, before, doc in _sequence_chunks(batches, end):
            local = np.bincount(doc, trans[before, c] - emit[c], batch.num_rows)
            yield pa.record_batch([*batch.columns[:4], pa.array(local)], names=["doc_id", "n_tokens", "n_known", "logs", "local"])

    return run


def _step() -> Column:
    """Step of a count on a logarithmic scale, 64 to a doubling."""
    return F.floor(F.log2(F.col("n")) * 64).cast("int")


def _cut(counts: DataFrame, head: int) -> int:
    """The least step such that the words at it and above are no more than ``head``; a few thousand rows reach the driver."""
    steps = sorted(((r["s"], r["m"]) for r in counts.groupBy(_step().alias("s")).agg(F.count("*").alias("m")).collect()), reverse=True)
    cut, held = (steps[0][0] + 1 if steps else 0), 0
    for step, m in steps:
        held += m
        if held > head:
            break
        cut = step
    return cut


def _held(p: BrownLM) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % p.folds == p.held_fold


def fit(train: DataFrame, p: BrownLM = BrownLM()):
    """(words: h, n, c; model on the driver).  The table of words grows with the input; the model's size depends on the parameters alone."""
    counts = materialize(train.mapInArrow(_count(p), "h long, e long, n long").groupBy("h").agg(F.min("e").alias("e"), F.sum("n").alias("n")), "lm-counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the core: at most ``units`` words, by counts and hashes
    core = counts.orderBy(F.desc("n"), "h").select("h").limit(p.units).toArrow()
    top = np.sort(np.asarray(core.column(0)).astype(np.int64).view(np.uint64))
    if not len(top):
        top = np.array([END], np.uint64)
    pairs = train.mapInArrow(_bigrams(p, top), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    width = len(top) + p.endings
    matrix = np.zeros((width, width))
    code, times = np.asarray(pairs.column(0)), np.asarray(pairs.column(1))
    matrix[code // width, code % width] = times
    cls = exchange(matrix, p.classes, p.sweeps)
    hot = np.eye(p.classes)[cls]
    g = hot.T @ matrix @ hot
    # every other word by its own neighbours
    met = train.mapInArrow(_neighbours(p, top, cls), "h long, code int, n long")
    own = counts.select("h", (-1 - F.col("e")).cast("int").alias("code"), "n")
    words = materialize(met.union(own).repartition("h").sortWithinPartitions("h").mapInArrow(_assign(p, top, cls, g), "h long, n long, c int"), "lm-words")
    sums = words.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens, kinds = np.zeros(p.classes), np.zeros(p.classes)
    for r in sums:
        tokens[r["c"]], kinds[r["c"]] = r["n"], r["v"]
    cut = _cut(words, p.head)
    frequent = words.filter(_step() >= cut).toArrow()
    h, n, c = (np.asarray(frequent.column(i)).astype(np.int64) for i in range(3))
    if not len(h):
        h, n, c = top.view(np.int64), np.zeros(1, np.int64), cls[:1]
    h = h.view(np.uint64)
    by = np.argsort(h)
    end = int(cls[int(_unit_of(np.array([END]), np.array([0]), top, np.arange(len(top)), p)[0])])
    model = {
        "top": top, "cls": cls, "head": h[by], "counts": n[by], "head_cls": c[by].astype(np.uint8), "end": end,
        "emit": np.log10(tokens + kinds + 1), "share": (tokens + kinds + 1) / (tokens + kinds + 1).sum(), "tokens": int(total), "vocabulary": int(vocabulary), "cut": cut,
    }
    return words, model


def sequences(base: DataFrame, words: DataFrame, model: dict, p: BrownLM) -> DataFrame:
    """doc_id, n_tokens, n_known, logs, seq (the class of each token, a byte each) of every row of ``base`` (doc_id, text)."""
    sent = base.sparkSession.sparkContext.broadcast(model)
    rows = materialize(base.mapInArrow(_sequences(p, sent), _ROW), "lm-rows")
    rare = rows.filter("h is not null").select("rid", "h", "places").join(words.filter(_step() < model["cut"]), "h")
    # a group is the rare words of one text
    rare = rare.groupBy("rid").agg(
        F.sum(F.size("places")).cast("long").alias("__known"),
        F.sum(F.size("places") * F.log10(F.col("n") + 1)).alias("__logs"),
        F.collect_list(F.struct("c", "places")).alias("fixes"),
    )
    fixed = rows.filter("h is null").join(rare, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("__known", F.lit(0))).alias("n_known"),
        (F.col("logs") + F.coalesce("__logs", F.lit(0.0))).alias("logs"),
        "seq",
        F.coalesce("fixes", F.array().cast("array<struct<c: int, places: array<int>>>")).alias("fixes"),
    )
    return materialize(fixed.mapInArrow(_fill, "doc_id long, n_tokens long, n_known long, logs double, seq binary"), "lm-sequences")


def transitions(train: DataFrame, model: dict, p: BrownLM) -> np.ndarray:
    """log10 of the smoothed chance of each class (columns) behind each other (rows), from the sequences of the training texts."""
    pairs = train.select("seq").mapInArrow(_transitions(p, model["end"]), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    g = np.zeros(p.classes * p.classes)
    for r in pairs:
        g[r["code"]] = r["n"]
    g = g.reshape(p.classes, p.classes)
    return np.log10((g + p.backoff * model["share"]) / (g.sum(1, keepdims=True) + p.backoff))


def score(docs: DataFrame, p: BrownLM = BrownLM(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null texts are empty: one token, the end.  A row without an id is not held
    out (its fold is that of an empty id).  Repeated rows are scored and counted
    each.  With nothing to learn from, every word is unknown.  Other columns are
    ignored, whatever their names.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    words, model = fit(base.filter(~_held(p)).select("text"), p)
    rows = sequences(base, words, model, p)
    trans = transitions(rows.filter(~_held(p)), model, p)
    scored = rows.mapInArrow(_scores(model["end"], trans, model["emit"]), "doc_id long, n_tokens long, n_known long, logs double, local double")
    size = float(np.log10(model["tokens"] + model["vocabulary"] + 1))
    return scored.select(
        "doc_id",
        _held(p).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("logs") + F.col("local")).alias("score"),
    )
