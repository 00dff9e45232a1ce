"""Secret scan: fixed patterns, then assignment-aware lexing.

The lexer reads source and configuration syntax into pairs of a name and a value
(a literal, another name, or several joined by ``+`` or ``.``), carries constants
from name to name, and scores every literal by the names that it reaches: how
sensitive the name is, and how much the literal looks like a key rather than a
placeholder.  So a literal bound to a harmless name is found if the value later
reaches a sensitive one, wherever in the text that happens.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .textvec import text_chunks

KINDS = ("assign", "access", "hex", "lex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

_QUOTED = r"'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
#: A literal, with the letters that some languages put before its quote.
_STRING = rf"(?:[rRbBuUfFL@$]{{1,2}}(?=[\"'`]))?(?:{_QUOTED})"
_PAIR = re.compile(
    rf"""(?<![\w.$-])(?:["']([\w.-]+)["']|([A-Za-z_$][\w$.-]*))\]?[ \t]*(?::[ \t]*(?:str|string|String|&str|const\ char\ \*)[ \t]*=|:=|=>|=(?!=)|:(?![:/]))[ \t]*((?:{_STRING}|[^\s"'`,;(){{}}\[\]<>]+)(?:[ \t]*[+.][ \t]*(?:{_STRING}|[A-Za-z_$][\w$.]*))*)"""
)
_PART = re.compile(rf"({_STRING})|([^\s\"'`+]+)")
_NAME = re.compile(r"^[A-Za-z_$][\w$.-]*$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_STRONG = frozenset("password passwd passwort passphrase passcode pwd pswd secret token credential cred apikey accesskey secretkey privatekey authtoken".split())
_WEAK = frozenset("key auth session cookie signature signing salt bearer pass pw".split())
#: Before ``key``, ``pass`` or ``pw`` these make the name a sensitive one.
_QUALIFIES = frozenset("api access secret private signing encryption auth client master service account".split())
_WHOSE = frozenset("db database user admin root smtp mail imap ftp sftp ssh sql mysql postgres pg redis mongo ldap login account service sudo keystore truststore my the".split())
_HARMLESS = frozenset("public primary foreign sort cache key_id name path file url uri length len count type limit max min id expiry expires ttl".split())
_PLACEHOLDER = re.compile(r"^(?:\$\{.*|\{\{.*|<.*|%\(.*|\*+|x+|\.+|-+|(?:your|my|the|some|insert|enter|change|replace|example|sample|dummy|test|todo|none|null|true|false|undefined|redacted|placeholder)\b.*|change_?me|example.*|your[_-].*)$", re.I)


@dataclass(frozen=True)
class SecretScan:
    least: int = 8
    entropy: float = 2.5
    score: float = 1.0


def _singular(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def name_weight(name: str) -> float:
    """1 for a name that says secret, 0.5 for one that may, 0 otherwise; plurals count like one."""
    words = [_singular(w.lower()) for w in _WORDS.findall(name) if not w.isdigit()]
    pairs = list(zip(words, words[1:], strict=False))
    if words and words[-1] in _HARMLESS or "public" in words:
        return 0.0
    if _STRONG & {*words, *(a + b for a, b in pairs)}:
        return 1.0
    if any(a in _QUALIFIES and b == "key" or a in _WHOSE and b in ("pass", "pw") for a, b in pairs):
        return 1.0
    return 0.5 if _WEAK & set(words) else 0.0


def literal_weight(value: str, quoted: bool, p: SecretScan) -> float:
    """0 for placeholders and plain words, up to 1.5 for strings that look random."""
    if len(value) < p.least or _PLACEHOLDER.match(value) or re.search(r"\s", value) or "://" in value and "@" not in value:
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    if bits < p.entropy:
        return 0.0
    mixed = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if not quoted and not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        return 0.0
    return min(1.5, 0.4 + 0.2 * mixed + 0.25 * (bits >= 3.2) + 0.25 * (len(value) >= 16) + 0.15 * quoted)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def lexed_spans(text: str, p: SecretScan = SecretScan()) -> list[tuple[int, int]]:
    """Spans of the literals whose value reaches a sensitive name."""
    if "=" not in text and ":" not in text:
        return []
    literals: list[tuple[int, int, str, bool]] = []
    holds: dict[str, set[int]] = {}  # name -> literals bound to it
    flows: dict[str, set[str]] = {}  # name -> names whose value it takes
    for m in _PAIR.finditer(text):
        name = m[1] or m[2]
        parts = list(_PART.finditer(m[3]))
        for part in parts:
            at = m.start(3)
            if part[1]:
                body = part[1].lstrip("rRbBuUfFL@$")
                n = 3 if body[:3] in ("'''", '"""') and len(body) >= 6 else 1
                holds.setdefault(name, set()).add(len(literals))
                literals.append((at + part.end() - len(body) + n, at + part.end() - n, body[n:-n], True))
            else:
                bare = part[2].rstrip(".,;")
                if _NAME.match(bare) and not re.search(r"\d.*[A-Za-z].*\d|\d{4}", bare):
                    flows.setdefault(name, set()).add(bare)
                if len(parts) == 1:
                    holds.setdefault(name, set()).add(len(literals))
                    literals.append((at + part.start(), at + part.start() + len(bare), bare, False))
    # constants travel to the names that take their value: walked back from the sensitive names, over chains of any length
    short: dict[str, list[str]] = {}
    for n in holds:
        short.setdefault(n.rsplit(".", 1)[-1], []).append(n)
    found = set()
    weights = {n: name_weight(n) for n in holds.keys() | flows.keys()}
    for weight in set(weights.values()) - {0.0}:
        todo = [n for n, w in weights.items() if w == weight]
        met = set(todo)
        while todo:
            name = todo.pop()
            for i in holds.get(name, ()):
                start, end, value, quoted = literals[i]
                if weight * literal_weight(value, quoted, p) >= p.score * 0.75:
                    found.add((start, end))
            for s in flows.get(name, ()):
                fresh = [x for x in ([s] if s in weights else short.get(s.rsplit(".", 1)[-1], ())) if x not in met]
                met.update(fresh)
                todo += fresh
    return sorted(found)


def _uncovered(start: int, end: int, starts: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """What of a span lies outside the given ones, which are sorted and apart."""
    k = bisect_right(ends, start)
    while start < end:
        if k == len(starts) or starts[k] >= end:
            yield start, end
            return
        if start < starts[k]:
            yield start, starts[k]
        start = max(start, ends[k])
        k += 1


def spans_of(text: str, p: SecretScan = SecretScan()) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: of a lexed one, what no base span covers; so the tail of a literal that a base span ends in isn't lost."""
    base = base_spans(text)
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    more = [(a, 3, b) for s, e in lexed_spans(text, p) for a, b in _uncovered(s, e, starts, ends)]
    return base, sorted(base + more)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, p: SecretScan = SecretScan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lex of every row, in one pass without a shuffle.

    Null texts are empty: no spans, and the digest of an empty string.  Repeated
    rows and rows without an id are scanned each.  An empty table gives an empty
    result.  Other columns are ignored, whatever their names.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            counts, digests, spans = [], [], []
            for raw in texts:
                own, every = spans_of(raw.decode("utf-8", "replace"), p)
                counts.append(Counter(k for _, k, _ in every))
                digests.append(hashlib.sha256(_join(own).encode()).hexdigest())
                spans.append(_join(every))
            yield pa.record_batch(
                [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array([c[3] for c in counts], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lex"],
            )

    return base.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lex long")
