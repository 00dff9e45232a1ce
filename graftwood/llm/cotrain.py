"""Quality classifier by co-training on two views.

The *content* view sees the text (shape statistics and the presence of telling
words and word stems), the *metadata* view sees what is known about the document without reading
it (source, language, length).  Each round, both classifiers judge every unlabelled
document of the table, and of each stratum of sources and languages those that one
of them is surest of join the other's training rows.  Both are then calibrated, and
combined, on labelled rows that neither has learned from.  A document is good if
its quality is 1 and it is not toxic.

The only bound on what is read is ``labelled_rows`` (one row for each of the
labelled ids with the least hashes).  Features of all documents, over their whole
texts, are written once; rounds and scores are passes over them.  A round adds
``per_stratum`` rows at most of each class, view and stratum, whatever the size of
the table, and looks for them everywhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .html_text import STOP_WORDS
from .scratch import bounded_batches, materialize
from .textvec import CHUNK, NON_LETTER, Words, text_chunks

SHAPE = 14
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "!#$%&*+/<=>@\\^_`|~{}[]"]] = True
_META = "doc_id", "source", "lang", "n_chars"


@dataclass(frozen=True)
class CoTraining:
    labelled_rows: int = 12_000
    words: int = 600
    stems: tuple[int, ...] = (4, 5)
    least_df: int = 4
    least_chi: float = 10.8
    rounds: int = 4
    per_stratum: int = 2
    sure: float = 0.95
    prior: float = 1.0
    threshold: float = 0.5
    sources: int = 64


def _stop_hashes() -> np.ndarray:
    return np.sort(Words([" ".join(STOP_WORDS).encode()], NON_LETTER).h)


def shape_of(raw: bytes, h: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Statistics of a text and its word hashes."""
    if not raw:
        return np.zeros(SHAPE)
    b = np.frombuffer(raw, np.uint8)
    n, words = len(b), max(1, len(h))
    hist = np.bincount(b, minlength=256)
    letters = hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum()
    _, times = np.unique(h, return_counts=True) if len(h) else (h, np.zeros(1, np.int64))
    known = stop[np.minimum(np.searchsorted(stop, h), len(stop) - 1)] == h if len(h) else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = hist[[0x2E, 0x21, 0x3F]].sum()
    return np.array(
        [
            np.log1p(n),
            np.log1p(words),
            hist[65:91].sum() / max(1, letters),
            hist[_SYMBOL].sum() / n,
            hist[48:58].sum() / n,
            hist[0x7C] / words,
            hist[0x21] / words,
            letters / n,
            n / words,
            known.sum() / words,
            len(times) / words**0.75,
            times.max() / words,
            1 - len(set(lines)) / max(1, len(lines)),
            ends / words,
        ]
    )


def _features(selected: np.ndarray | None, p: CoTraining):
    """Shape statistics of each text, and the distinct hashes of its words and word stems (of the selected ones, their places)."""
    stop = _stop_hashes()

    def of(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        words = Words([x.lower() for x in texts], NON_LETTER)
        ends = np.cumsum(words.counts)
        shapes = np.empty((len(texts), SHAPE))
        for k, (raw, to, n) in enumerate(zip(texts, ends, words.counts, strict=True)):
            shapes[k] = shape_of(raw, words.h[to - n : to], stop)
        hashes, owner = zip((words.h, words.doc), *(words.stems(n) for n in p.stems), strict=True)
        h, doc = np.concatenate(hashes), np.concatenate(owner)
        if selected is not None:
            at = np.minimum(np.searchsorted(selected, h), max(0, len(selected) - 1))
            hit = selected[at] == h if len(selected) else np.zeros(len(h), bool)
            h, doc = at[hit], doc[hit]
        by = np.lexsort((h, doc))
        h, doc = h[by], doc[by]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)]
        h, doc = h[first], doc[first]
        return shapes, np.split(h, np.searchsorted(doc, np.arange(1, len(texts))))

    return of


def _meta_matrix(source: list, lang: list, n_chars: list, p: CoTraining) -> np.ndarray:
    width = p.sources + 8 + 2
    out = np.zeros((len(source), width))
    for k, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[k, xxhash.xxh32_intdigest(s or "", 1) % p.sources] = 1
        out[k, p.sources + xxhash.xxh32_intdigest(g or "", 2) % 8] = 1
        size = np.log1p(max(0, n or 0))
        out[k, -2:] = (size - 7) / 2, ((size - 7) / 2) ** 2
    return out


def _dense(shapes: np.ndarray, m: dict) -> np.ndarray:
    d = np.clip((shapes - m["mean"]) / m["sd"], -6, 6)
    return np.hstack((d, np.maximum(d - 1, 0), np.maximum(-1 - d, 0)))


def _text_matrix(shapes: np.ndarray, sets: list[np.ndarray], m: dict) -> np.ndarray:
    presence = np.zeros((len(sets), len(m["selected"])))
    for k, s in enumerate(sets):
        presence[k, s] = 1
    return np.hstack((_dense(shapes, m), presence))


def _text_logit(shapes: np.ndarray, sets: list[np.ndarray], m: dict) -> np.ndarray:
    """``_logit(_text_matrix(...), m["text"])`` without the matrix."""
    w = m["text"]
    n = 3 * SHAPE
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    words = np.concatenate(sets) if len(sets) else np.empty(0, np.int64)
    return _dense(shapes, m) @ w[:n] + np.bincount(owner, w[n:-1][words.astype(np.int64)], len(sets)) + w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 30, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one is the intercept) of an L2-regularised logistic regression, by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1)))).astype(np.float32)
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    keep = np.full(x.shape[1], l2)
    keep[-1] = 1e-9
    loss = lambda v: np.logaddexp(0, -(2 * y - 1) * (x @ v)).mean() + (keep * v * v).sum() / 2
    now = loss(w)
    for _ in range(steps):
        prob = sigmoid(x @ w)
        slope = x.T @ (prob - y) / len(y) + keep * w
        bend = np.sqrt(np.maximum(prob * (1 - prob), 1e-6)).astype(np.float32)[:, None] * x
        step = np.linalg.solve((bend.T @ bend).astype(np.float64) / len(y) + np.diag(keep + 1e-8), slope)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if then > now:
            break
        w, before, now = w - size * step, now, then
        if before - now < 1e-7:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _labelled(labels: DataFrame, p: CoTraining) -> DataFrame:
    """(doc_id, good) of ``labelled_rows`` labelled ids at most."""
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("q"), labels["toxic"].cast("int").alias("t")).filter("doc_id is not null and q is not null")
    marked = marked.groupBy("doc_id").agg(F.min(((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)).cast("int")).alias("good"))
    return marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.labelled_rows)


def _view(docs: DataFrame, *more: Column) -> DataFrame:
    have = {c.lower(): c for c in docs.columns}
    kinds = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    return docs.select(*((docs[have[c]] if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in (*_META, "text")), *more)


_FOLD = "pmod(xxhash64(doc_id, 9L), 5)"  # rows of fold 0 calibrate


def _telling(rows: DataFrame, p: CoTraining) -> np.ndarray:
    """Hashes of the words and stems that tell good from bad, by chi-square of their document counts over labelled rows."""
    of = _features(None, p)
    good, n = rows.agg(F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()
    share = good / max(1, n)
    if not 0 < share < 1:
        return np.empty(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            _, sets = of(texts)
            marks = np.asarray(batch.column(batch.schema.get_field_index("good")).cast(pa.int64()))
            h, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            df = np.bincount(inverse, minlength=len(h))
            pos = np.bincount(inverse, np.repeat(marks, list(map(len, sets))), len(h)).astype(np.int64)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(df), pa.array(pos)], names=["h", "df", "pos"])

    counts = rows.select("good", "text").mapInArrow(run, "h long, df long, pos long").groupBy("h").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    gap = F.col("pos") - F.col("df") * share
    chi = gap * gap / F.greatest(F.col("df") * share * (1 - share) * (1 - F.col("df") / n), F.lit(1e-9))
    best = counts.filter(F.col("df") >= p.least_df).select("h", chi.alias("chi")).filter(F.col("chi") > p.least_chi).orderBy(F.desc("chi"), "h").limit(p.words).toArrow()
    return np.sort(np.asarray(best.column(0)).view(np.uint64))


_FEATURES = "doc_id long, source string, lang string, n_chars long, shape binary, words binary"


def _featured(selected: np.ndarray, p: CoTraining, more: tuple[str, ...] = ()):
    """Metadata, shape and places of the selected words of each text, and the columns ``more`` as they are."""
    of = _features(selected, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, limit=CHUNK):
            cols = [batch.column(batch.schema.get_field_index(c)) for c in (*_META, *more)]
            yield pa.record_batch([*cols[:4], *_packed(*of(texts)), *cols[4:]], names=[*_META, "shape", "words", *more])

    return run


def _packed(shapes: np.ndarray, sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([x.tobytes() for x in shapes], pa.binary()), pa.array([x.astype(np.int16).tobytes() for x in sets], pa.binary())]


#: Columns of features beside those of the documents.
_SHAPE, _WORDS = "__cotrain_shape", "__cotrain_words"


def _beside(selected: np.ndarray, p: CoTraining, text: str):
    """Documents as they are, with the shape and the places of the selected words of each text in two more columns."""
    of = _features(selected, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text, CHUNK):
            yield pa.record_batch([*batch.columns, *_packed(*of(texts))], names=[*batch.schema.names, _SHAPE, _WORDS])

    return run


def _read_features(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Shapes and places of words of a batch of features."""
    col = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shape", "words")}
    shapes = np.frombuffer(b"".join(col["shape"])).reshape(-1, SHAPE)
    return shapes, [np.frombuffer(x, np.int16) for x in col["words"]]


def _meta_of(batch: pa.RecordBatch, p: CoTraining) -> np.ndarray:
    return _meta_matrix(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("source", "lang", "n_chars")), p)


def _surest(p: CoTraining, sent):
    """Of each view, class and stratum in a partition, the ``per_stratum`` rows that the view is surest of, with their features.

    Ties go by hashes of ids; rows of the labelled sample and those that were taken
    before are passed over, and of rows with one id one is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        held: list[dict] = []

        def best(rows: list[dict]) -> list[dict]:
            rows.sort(key=lambda r: (r["view"], r["up"], r["stratum"], -r["sure"], r["tie"], r["doc_id"], r["words"], r["shape"]))
            out, count, seen = [], Counter(), set()
            for r in rows:
                key = (r["view"], r["up"], r["stratum"])
                if count[key] < p.per_stratum and (key, r["doc_id"]) not in seen:
                    count[key] += 1
                    seen.add((key, r["doc_id"]))
                    out.append(r)
            return out

        for batch in batches:
            shapes, sets = _read_features(batch)
            meta = _meta_of(batch, p)
            stratum = meta[:, : p.sources].argmax(1) * 8 + meta[:, p.sources : p.sources + 8].argmax(1)
            ids = batch.column(0).to_pylist()
            raw = None
            for view, z in (("text", _text_logit(shapes, sets, m)), ("meta", _logit(meta, m["meta"]))):
                prob = sigmoid(z)
                for up, sure in ((True, prob), (False, 1 - prob)):
                    some = np.flatnonzero(sure >= p.sure)
                    # in a batch, no more than the first few of each stratum can be among the best
                    some = some[np.lexsort((-sure[some], stratum[some]))]
                    for k in some[_first_few(stratum[some], 4 * p.per_stratum)].tolist():
                        if ids[k] is None or ids[k] in m["taken"]:
                            continue
                        raw = raw or batch.to_pydict()
                        held.append({c: raw[c][k] for c in raw} | {"view": view, "up": up, "sure": float(sure[k]), "stratum": int(stratum[k]), "tie": xxhash.xxh32_intdigest(str(ids[k]), 3)})
            held = best(held)
        yield pa.RecordBatch.from_pylist(held, _CHOSEN)

    return run


_CHOSEN = pa.schema(
    [
        ("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()), ("shape", pa.binary()), ("words", pa.binary()),
        ("view", pa.string()), ("up", pa.bool_()), ("sure", pa.float64()), ("stratum", pa.int32()), ("tie", pa.int64()),
    ]
)


def _first_few(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of the sorted keys are among the first ``n`` of their kind."""
    if not len(keys):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys)))) < n


def _matrices(table: pa.Table, m: dict, p: CoTraining) -> dict[str, np.ndarray]:
    one = table.combine_chunks().to_batches()
    batch = one[0] if one else pa.RecordBatch.from_pylist([], table.schema)
    shapes, sets = _read_features(batch)
    return {"text": _text_matrix(shapes, sets, m), "meta": _meta_of(batch, p)}


def _narrow(whole: DataFrame) -> DataFrame:
    """The features alone of documents with their features beside them."""
    return _view(whole, whole[_SHAPE].alias("shape"), whole[_WORDS].alias("words")).drop("text")


def fit(docs: DataFrame, labels: DataFrame, p: CoTraining = CoTraining(), whole: bool = False) -> tuple[dict | None, DataFrame | None]:
    """(model, features of all documents); None where the labels don't show both classes.  ``whole``: the features stand beside all columns of the documents."""
    view = _view(docs)
    known = _labelled(labels, p)
    # one row for each id, however often the table repeats it
    rows = view.join(F.broadcast(known), "doc_id")
    rest = F.struct("source", "lang", "n_chars", "text")
    sample = rows.groupBy("doc_id", "good").agg(F.min_by(rest, F.struct(F.xxhash64("text"), "source", "lang", "n_chars")).alias("r")).select("doc_id", "r.*", "good").withColumn("fold", F.expr(_FOLD))
    sample = materialize(sample, "cotrain-sample")
    selected = _telling(sample.filter("fold > 0"), p)
    table = sample.mapInArrow(_featured(selected, p, ("good", "fold")), f"{_FEATURES}, good int, fold long").toArrow().sort_by("doc_id")
    y, fold = np.asarray(table["good"]).astype(np.int64), np.asarray(table["fold"])
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return None, None
    learn, check = np.flatnonzero(fold > 0), np.flatnonzero(fold == 0)
    if len(set(y[learn].tolist())) < 2 or len(set(y[check].tolist())) < 2:
        learn = check = np.arange(len(y))
    shapes = np.frombuffer(b"".join(table["shape"].to_pylist())).reshape(-1, SHAPE)
    m: dict = {"mean": shapes[learn].mean(0), "sd": shapes[learn].std(0) + 1e-6, "selected": selected, "taken": set(table["doc_id"].to_pylist())}
    views = _matrices(table, m, p)
    train = {v: (x[learn], y[learn].astype(float)) for v, x in views.items()}
    with bounded_batches(docs.sparkSession):
        if whole:
            text = next(c for c in docs.columns if c.lower() == "text")
            made = materialize(docs.mapInArrow(_beside(selected, p, text), StructType([*docs.schema.fields]).add(_SHAPE, BinaryType()).add(_WORDS, BinaryType())), "cotrain-whole")
        else:
            made = materialize(view.mapInArrow(_featured(selected, p), _FEATURES), "cotrain-features")
    features = _narrow(made) if whole else made
    order = Window.partitionBy("view", "up", "stratum").orderBy(F.desc("sure"), "tie", "doc_id", "words", "shape")
    schema = f"{_FEATURES}, view string, up boolean, sure double, stratum int, tie long"
    for turn in range(p.rounds + 1):
        for v, (x, target) in train.items():
            m[v] = logistic(x, target, p.prior / len(target), start=m.get(v))
        if turn == p.rounds:
            break
        sent = docs.sparkSession.sparkContext.broadcast(m)
        surest = features.mapInArrow(_surest(p, sent), schema).dropDuplicates(["view", "up", "stratum", "doc_id"])
        chosen = surest.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= p.per_stratum).drop("__k").toArrow().sort_by("doc_id")
        said = [set(zip(chosen["doc_id"].to_pylist(), chosen["up"].to_pylist(), strict=True)) for chosen in (chosen.filter(pc.equal(chosen["view"], v)) for v in ("text", "meta"))]
        # a document that the views label oppositely teaches neither
        torn = {i for i, up in said[0] if (i, not up) in said[1]}
        m["taken"] |= {i for i, _ in said[0] | said[1]}
        chosen = chosen.filter(pa.array([i not in torn for i in chosen["doc_id"].to_pylist()], pa.bool_()))
        if not len(chosen):
            break
        more = _matrices(chosen, m, p)
        for v, other in (("text", "meta"), ("meta", "text")):
            own = np.asarray(pc.equal(chosen["view"], v).combine_chunks().to_numpy(zero_copy_only=False))
            x, target = train[other]
            train[other] = np.vstack((x, more[other][own])), np.concatenate((target, np.asarray(chosen["up"].to_pylist(), float)[own]))
    for v, x in views.items():
        z = _logit(x[check], m[v])
        m[f"{v}_cal"] = logistic(z[:, None] / 4, y[check].astype(float), 1e-3)
    z = np.stack([_logit(views[v][check], m[v]) / 4 for v in views], 1)
    m["both"] = logistic(z, y[check].astype(float), 1e-3)
    del m["taken"]
    return m, made


def _calibrated(m: dict, zt: np.ndarray, zm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated chance of being good by the content view, the metadata view, and both."""
    zt, zm = zt / 4, zm / 4
    return sigmoid(_logit(zt[:, None], m["text_cal"])), sigmoid(_logit(zm[:, None], m["meta_cal"])), sigmoid(_logit(np.stack((zt, zm), 1), m["both"]))


def score(docs: DataFrame, labels: DataFrame, p: CoTraining = CoTraining()) -> DataFrame:
    """doc_id, p_text, p_meta, score, kept of every row (kept: score >= threshold).

    Null texts are empty; null or missing metadata counts as blank.  Labels that
    contradict each other count as the worse one; rows without a quality don't
    count.  Without labels of both classes nothing is rejected: all chances are 1.
    Repeated rows and rows without an id are scored each.  Either table may be
    empty.  Other columns are ignored.
    """
    m, features = fit(docs, labels, p)
    if m is None:
        one = F.lit(1.0)
        return _view(docs).select("doc_id", one.alias("p_text"), one.alias("p_meta"), one.alias("score"), F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = _calibrated(sent.value, _text_logit(*_read_features(batch), sent.value), _logit(_meta_of(batch, p), sent.value["meta"]))
            yield pa.record_batch([batch.column(0), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= p.threshold)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    return features.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, p: CoTraining = CoTraining()) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns, without a shuffle.

    The documents are written once, with their features beside them; so each text
    is read for its features once, and only these meet Python again.
    """
    m, made = fit(docs, labels, p, whole=True)
    if m is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(m)

    def run(source: pa.Array, lang: pa.Array, n_chars: pa.Array, shape: pa.Array, words: pa.Array) -> pa.Array:
        batch = pa.record_batch([source, lang, n_chars, shape, words], names=["source", "lang", "n_chars", "shape", "words"])
        return pa.array(_calibrated(sent.value, _text_logit(*_read_features(batch), sent.value), _logit(_meta_of(batch, p), sent.value["meta"]))[2] >= p.threshold)

    have = {c.lower(): made[c] for c in made.columns}
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    told = F.arrow_udf(run, "boolean")(*(have.get(c, F.lit(None)).cast(t) for c, t in kinds.items()), made[_SHAPE], made[_WORDS])
    return made.filter(told).drop(_SHAPE, _WORDS)
