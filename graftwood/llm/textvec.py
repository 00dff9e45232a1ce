"""Vectorised tokenising and hashing of whole texts with numpy.

Words are maximal runs of bytes outside a separator set.  A word's hash takes its
length and its bytes, eight at a time, each eight through two multiplications and
shifts, so that no sum of bytes cancels another; words of over 64 bytes are hashed
by XXH3.  Words of one length of up to eight bytes never share a hash; of a
billion distinct longer ones, two do with a chance of about 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed at once; bounds the temporary arrays (about 40 bytes a byte).
CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but letters: bytes of non-ASCII letters count as letters.
NON_LETTER = np.ones(256, bool)
NON_LETTER[[*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = False

_MASK = np.array([(1 << 8 * r) - 1 for r in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one.
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on as one number; zeros follow the end."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def _bounds(buf: np.ndarray, cuts: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``buf``; no word crosses a position in ``cuts``."""
    n = len(buf)
    word = ~sep[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def _hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
    eights = _eights(buf)
    some = np.flatnonzero(size <= _LONG)
    at = 0
    while len(some):
        x = eights[starts[some] + at] & _MASK[np.minimum(size[some] - at, 8)]
        h[some] = mix(h[some] ^ mix(x + np.uint64(0xA0761D6478BD642F)))
        at += 8
        some = some[size[some] > at]
    for k in np.flatnonzero(size > _LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]], 20240607)
    return h


class Words:
    """Words of a batch of texts: ``h`` (hashes), ``doc`` (index of the text of each), ``counts`` (words of each text), ``last`` (last three bytes of each)."""

    def __init__(self, texts: list[bytes], sep: np.ndarray = SPACE) -> None:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        buf = np.frombuffer(b"".join(texts), np.uint8)
        hs, ss, es = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = 0
        while at < len(buf):
            to = min(at + CHUNK, len(buf))
            while to < len(buf):  # cut behind the last separator, or where a text begins
                inner = offsets[np.searchsorted(offsets, to, "right") - 1]
                gaps = np.flatnonzero(sep[buf[max(at, to - 4096) : to]])
                cut = max(int(inner), max(at, to - 4096) + int(gaps[-1]) + 1 if len(gaps) else 0)
                if cut > at:
                    to = cut
                    break
                to = min(to + CHUNK, len(buf))
            inside = offsets[(offsets >= at) & (offsets < to)] - at
            s, e = _bounds(buf[at:to], inside, sep)
            hs.append(_hash_words(buf[at:to], s, e))
            ss.append(s + at)
            es.append(e + at)
            at = to
        self.h, starts, ends = np.concatenate(hs), np.concatenate(ss), np.concatenate(es)
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self._buf, self._starts, self._ends = buf, starts, ends

    def exact(self) -> np.ndarray:
        """A number for each word, the same for two words only if their bytes are the same."""
        _, first, ids = np.unique(self.h, return_index=True, return_inverse=True)
        model = first[ids]
        size = self._ends - self._starts
        same = size == size[model]
        eights = _eights(self._buf)
        some = np.flatnonzero(same & (size <= _LONG) & (model != np.arange(len(ids))))
        at = 0
        while len(some):
            mask = _MASK[np.minimum(size[some] - at, 8)]
            same[some] &= ((eights[self._starts[some] + at] ^ eights[self._starts[model[some]] + at]) & mask) == 0
            at += 8
            some = some[size[some] > at]
        for k in np.flatnonzero(same & (size > _LONG)).tolist():
            m = model[k]
            same[k] = np.array_equal(self._buf[self._starts[k] : self._ends[k]], self._buf[self._starts[m] : self._ends[m]])
        known: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():  # words that share a hash with another word
            ids[k] = known.setdefault(self._buf[self._starts[k] : self._ends[k]].tobytes(), len(first) + len(known))
        return ids.astype(np.int64)

    def last(self) -> np.ndarray:
        """The last three bytes of each word as one number; missing bytes are 0."""
        out = np.zeros(len(self._ends), np.int64)
        for back in (1, 2, 3):
            at = self._ends - back
            out = out * 256 + np.where(at >= self._starts, self._buf[np.maximum(at, 0)], 0)
        return out

    def stems(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the first ``n`` (at most 7) bytes of each word that has more, and the index of its text."""
        longer = np.flatnonzero(self._ends - self._starts > n)
        out = np.full(len(longer), n, np.uint64)
        for k in range(n):
            out = out * np.uint64(256) + self._buf[self._starts[longer] + k].astype(np.uint64)
        return mix(out), self.doc[longer]


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 * CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of record batches that hold about ``limit`` bytes of text, with their texts in UTF-8 (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
        at = 0
        while at < len(sizes):
            run = np.cumsum(sizes[at:])
            n = max(1, int(np.searchsorted(run, limit, "right")))
            yield batch.slice(at, n), [x or b"" for x in column.slice(at, n).to_pylist()]
            at += n


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)
