from __future__ import annotations

import hashlib
import re
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from graftwood.llm.pii import ANY, key_column, permute_number, permute_text, pseudonymise
from graftwood.llm.queries import op5_pii_pseudonyms

KEY = "k1"
TEXT = "Card 4539 5787 6362 1486, again 4539578763621486; bad 4539578763621487. Mail Jo.Doe+x@mail.example.com! IP 10.20.30.40, not 300.1.1.1. SSN 123-45-6789, not 000-45-6789. Call +1 (310) 555-4510 or 212-555-0199. On 2023-02-28, not 2023-02-30, 31/12/1999, 12/31/1999 and 01.02.1987."


def _one(spark, text, key=KEY):
    return pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), key).first()


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_permutations_are_one_to_one(spark):
    two = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    got = [r["p"] for r in two.select(permute_text(F.col("v"), F.lit(KEY), "t").alias("p")).collect()]
    assert len(set(got)) == 1000 and all(re.fullmatch(r"\d{3}", x) for x in got)
    got = [r["p"] for r in spark.range(21 * 20).select(permute_number(F.col("id"), 21, 20, F.lit(KEY), "t").alias("p")).collect()]
    assert sorted(got) == list(range(21 * 20))


def test_dates_are_permuted_among_days(spark):
    days = spark.range(3000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    got = [r["text"] for r in pseudonymise(days, KEY).collect()]
    assert len(set(got)) == 3000
    assert all(1900 <= date.fromisoformat(x).year <= 2099 for x in got)


def test_formats_stay_and_invalid_values_too(spark):
    r = _one(spark, TEXT)
    assert {k: r[f"n_{k}"] for k in ("card", "email", "ip", "ssn", "phone", "date")} == {"card": 2, "email": 1, "ip": 1, "ssn": 1, "phone": 2, "date": 4}
    shape = lambda t: re.sub(r"\d+(?:\.\d+){3}", "<ip>", re.sub("[a-z]", "x", re.sub("[A-Z]", "X", t)))
    digits = lambda t: re.sub(r"\d", "9", shape(t))
    assert digits(r["text"]) == digits(TEXT)
    for left in ("4539578763621487", "300.1.1.1", "000-45-6789", "2023-02-30", "@mail.example.com", "123-"):
        assert left in r["text"]
    for gone in ("4539 5787 6362 1486", "Jo.Doe+x@", "10.20.30.40", "123-45-6789", "555-4510", "2023-02-28"):
        assert gone not in r["text"]
    cards = [re.sub(r"\D", "", x) for x in re.findall(r"4\d{3} ?\d{4} ?\d{4} ?\d{4}", r["text"])]
    assert cards[0] == cards[1] and _luhn(cards[0]) and cards[0][0] == "4"
    assert all(int(x) <= 255 for x in re.search(r"IP (\d+)\.(\d+)\.(\d+)\.(\d+)", r["text"]).groups())


def test_equal_values_stay_linked_under_one_key_only(spark):
    a, b, c = _one(spark, "x 10.20.30.40 y"), _one(spark, "other 10.20.30.40"), _one(spark, "x 10.20.30.40 y", "k2")
    ip = lambda r: re.search(r"\d+\.\d+\.\d+\.\d+", r["text"])[0]
    assert ip(a) == ip(b) != ip(c)


def test_edges_and_plan(edges):
    got = pseudonymise(edges, KEY)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    want = sorted((repr(r["doc_id"]), r["text"] or "") for r in edges.collect())
    assert sorted((repr(r["doc_id"]), r["text"]) for r in got.collect()) == want
    assert pseudonymise(edges.limit(0), KEY).count() == 0


def test_long_runs_overflow_no_stack(spark):
    hard = ["a@" + "b." * 100_000, "x@mail.example.com.", "1.1." * 50_000, "+1 " * 50_000, "1-" * 100_000, "a.b-" * 60_000 + "@"]
    got = [r["text"] for r in pseudonymise(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert got[1].endswith("@mail.example.com.") and got[1] != hard[1] and got[3] == hard[3]


# brute force


def _hex(tag, half, r):
    return hashlib.sha256(f"{KEY}|{tag}|{r}|{half}".encode()).hexdigest()


def _text(v, tag):
    cut = len(v) // 2
    left, right = v[:cut], v[cut:]
    for r in range(1, 9):
        h = _hex(tag, right, r)
        out = ""
        for i, c in enumerate(left):
            step = int(h[2 * i % 64 : 2 * i % 64 + 2], 16)
            for low, high, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)):
                if low <= c <= high:
                    c = chr(ord(low) + (ord(c) - ord(low) + step) % n)
                    break
            out += c
        left, right = right, out
    return left + right


def _number(x, a, b, tag):
    left, right = divmod(x, b)
    for r in range(1, 9):
        v = int(_hex(tag, str(right), r)[:12], 16)
        left, right = right, (left + v) % (a if r % 2 else b)
    return left * b + right


def _fill(m, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), m)


def _digits(m):
    return re.sub("[^0-9]", "", m)


def _card(m):
    d = _digits(m)
    body = d[0] + _text(d[1:-1], "card")
    return _fill(m, body + next(c for c in "0123456789" if _luhn(body + c)))


def _phone(m):
    d = _digits(m)
    n = len(d)
    if n >= 10:
        moved = _text(d[n - 9 : n - 7] + d[-6:], "phone")
        return _fill(m, d[: n - 9] + moved[:2] + d[n - 7] + moved[2:])
    return _fill(m, d[: n - 6] + _text(d[-6:], "phone"))


def _cards(m):
    """All rows of groups by position, one after another."""
    tokens = re.findall(r"[0-9]+[^0-9]*", m)
    out, n, i = "", 0, 0
    while i < len(tokens):
        for j in range(len(tokens), i, -1):
            row = [_digits(t) for t in tokens[i:j]]
            d = "".join(row)
            shaped = j == i + 1 or all(3 <= len(g) <= 6 for g in row) or i == 0 and j == len(tokens)
            if shaped and 13 <= len(d) <= 19 and _luhn(d):
                out += _card("".join(tokens[i:j]))
                n += 1
                i = j
                break
        else:
            out += tokens[i]
            i += 1
    return out, "card", n


def _day(y, m, d):
    try:
        return date(int(y), int(m), int(d))
    except ValueError:
        return None


def _dated(m):
    first = date(1900, 1, 1)
    if "-" in m:
        day, form, write = _day(*m.split("-")), lambda x: True, lambda x: x.isoformat()
    else:
        sep = re.search("[/.]", m)[0]
        a, b, y = m.split(sep)
        day, own = _day(y, b, a), True
        if day is None and sep == "/":
            day, own = _day(y, a, b), False
        dw, mw = (len(a), len(b)) if own else (len(b), len(a))
        form = lambda x: (dw == 2 or x.day < 10) and (mw == 2 or x.month < 10) and (own or x.day > 12)
        wide = lambda n, w: f"{n:02d}" if w == 2 else str(n)
        write = lambda x: sep.join((*((wide(x.day, dw), wide(x.month, mw)) if own else (wide(x.month, mw), wide(x.day, dw))), str(x.year)))
    if day is None or not 1900 <= day.year <= 2099:
        return m, "none", 0
    x = (day - first).days
    while True:
        x = _number(x, 271, 270, "date")
        if x < 73049 and form(first + timedelta(x)):
            return write(first + timedelta(x)), "date", 1


def _ip(m):
    o = m.split(".")
    if any(int(x) > 255 for x in o):
        return m, "none", 0
    padded = [len(x) > 1 and x[0] == "0" for x in o]
    radix = [{2: 10, 3: 100}[len(x)] if p else 256 for x, p in zip(o, padded, strict=True)]
    x = 0
    for v, r in zip(o, radix, strict=True):
        x = x * r + int(v)
    x = _number(x, radix[0] * radix[1], radix[2] * radix[3], "ip")
    out = []
    for v, r, p in reversed(list(zip(o, radix, padded, strict=True))):
        x, y = divmod(x, r)
        out.append(str(y).zfill(len(v)) if p else str(y))
    return ".".join(reversed(out)), "ip", 1


def _replaced(m):
    if "@" in m:
        local, rest = m.split("@", 1)
        return f"{_text(local, 'email')}@{rest}", "email", 1
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}|\d{1,2}([/.])\d{1,2}\1\d{4}", m, re.A):
        return _dated(m)
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m, re.A):
        return _ip(m)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m, re.A):
        if m[:3] in ("000", "666") or m[0] == "9" or m[4:6] == "00" or m[-4:] == "0000":
            return m, "none", 0
        tail = _text(_digits(m)[3:], "ssn")
        while tail[:2] == "00" or tail[-4:] == "0000":
            tail = _text(tail, "ssn")
        return _fill(m, m[:3] + tail), "ssn", 1
    if (m[0] in "+(" or re.fullmatch(r"\d{3}[.-]\d{3}[.-]\d{4}", m, re.A)) and 8 <= len(_digits(m)) <= 15:
        return _phone(m), "phone", 1
    if m[0] == "+":
        tokens = re.findall(r"[0-9]+[^0-9]*", m)
        for j in range(len(tokens), 0, -1):
            if 8 <= len(_digits("".join(tokens[:j]))) <= 15:
                return "+" + _phone("".join(tokens[:j])) + "".join(tokens[j:]), "phone", 1
        text, kind, n = _cards(m[1:])
        return "+" + text, kind, n
    return _cards(m)


def brute(text):
    counts = dict.fromkeys(("email", "date", "ip", "ssn", "phone", "card"), 0)

    def one(m):
        out, kind, n = _replaced(m[0])
        if n:
            counts[kind] += n
        return out

    return re.sub(ANY, one, text or "", flags=re.A), counts


def _same(rows, texts):
    for r in rows:
        text, counts = brute(texts[r["doc_id"]])
        assert r["text"] == text
        assert {k: r[f"n_{k}"] for k in counts} == counts


def test_given_documents_equal_brute_force(documents, texts):
    _same(pseudonymise(documents, KEY).collect(), texts)


HARD = [
    TEXT,
    "Card 4111111111111111 9 now; 4111 1111 1111 1111 12 boxes; 12 4111 1111 1111 1111; 4111-1111-1111-1111-3 left",
    "two 4111111111111111 5500000000000004 in a row, 378282246310005 and 3782 822463 10005, 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25",
    "5 2023-02-28 4111 1111 1111 1111 and 77 123-45-6789 0012 and 41111111111111111111111",
    "1.2.2020, 01.2.2020, 1.02.2020, 01.02.2020, 12/25/2020, 25/12/2020, 1/25/2020, 3/4/2020, 31.02.2020, 1/1/1899, 2099-12-31, 1900-01-01",
    "010.1.1.1 10.1.1.1 10.01.1.1 001.002.003.004 255.255.255.255 256.1.1.1 0.0.0.0 00.1.1.1",
    "+14155552671 +49 30 1234567 +1 310 555 4510 +44 20 7946 0958 +1 4111 1111 1111 1111 +4111111111111111 +12 3 (310) 555 4510 +33 1 23 45 67 89 12 34",
    "mark \u0001 10.1.1.1 \u0001\u0001 x.y@mail.example.com \u0001",
    "",
]


def test_hard_texts_equal_brute_force(spark):
    texts = dict(enumerate(HARD))
    _same(pseudonymise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), KEY).collect(), texts)


@pytest.mark.parametrize(
    "text,gone",
    [
        ("Card 4111111111111111 9", "4111111111111111"),
        ("4111 1111 1111 1111 12 boxes", "4111 1111 1111 1111"),
        ("call +14155552671", "4155552671"),
        ("call +49 30 1234567 now", "30 1234567"),
    ],
)
def test_values_beside_other_digits_go(spark, text, gone):
    assert gone not in _one(spark, text)["text"]


FORMS = {"iso": "yyyy-MM-dd", "d.M": "d.M.yyyy", "dd.MM": "dd.MM.yyyy", "dd.M": "dd.M.yyyy", "d.MM": "d.MM.yyyy", "d/M": "d/M/yyyy", "dd/MM": "dd/MM/yyyy", "dd/M": "dd/M/yyyy", "d/MM": "d/MM/yyyy", "M/d": "M/d/yyyy", "MM/dd": "MM/dd/yyyy"}


def test_no_two_dates_of_any_form_share_a_pseudonym(spark):
    """Every day of two centuries, in every form."""
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int"))
    written = spark.range(73049).select(F.explode(F.array(*(F.date_format(day, f) for f in FORMS.values()))).alias("text")).distinct()
    got = pseudonymise(written.withColumn("doc_id", F.monotonically_increasing_id()), KEY)
    shape = lambda c: F.regexp_replace(c, "[0-9]", "9")
    rows = got.agg(F.count("*").alias("n"), F.count_distinct("text").alias("u"), F.sum("n_date").alias("d")).first()
    assert rows["n"] == rows["u"] == rows["d"] == written.count()
    # the set of pseudonyms is the set of values: each form is mapped onto itself
    assert got.select("text").exceptAll(written).isEmpty()
    assert got.select(shape(F.col("text")).alias("s")).groupBy("s").count().exceptAll(written.select(shape(F.col("text")).alias("s")).groupBy("s").count()).isEmpty()


def test_addresses_with_leading_zeros_are_a_form_of_their_own(spark):
    rows = [(0, "10.1.1.1"), (1, "010.1.1.1"), (2, "10.01.1.1"), (3, "10.1.1.001")]
    got = [r["text"] for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert len(set(got)) == 4 and re.fullmatch(r"0\d\d\.\d+\.\d+\.\d+", got[1]) and re.fullmatch(r"\d+\.0\d\.\d+\.\d+", got[2])


def test_the_key_shows_in_no_plan_and_must_be_given(spark):
    key = "never-to-be-shown"
    got = pseudonymise(spark.createDataFrame([(1, "10.1.1.1")], "doc_id long, text string"), key)
    got.collect()
    shown = got._jdf.queryExecution()
    modes = spark._jvm.org.apache.spark.sql.execution.ExplainMode
    assert all(key not in x for x in (shown.toString(), shown.executedPlan().toString(), *(shown.explainString(modes.fromString(m)) for m in ("extended", "formatted", "cost", "codegen"))))
    with pytest.raises(ValueError):
        pseudonymise(got, "")
    with pytest.raises(ValueError):
        key_column(spark, "")


def test_without_a_setting_each_application_makes_a_key(spark, sf):
    a, b = (sorted((r["doc_id"], r["text"]) for r in op5_pii_pseudonyms(spark, sf).collect()) for _ in range(2))
    assert a == b
    fixed = sorted((r["doc_id"], r["text"]) for r in pseudonymise(spark.read.parquet(f"{sf}/documents.parquet"), "graftwood-development-key").collect())
    assert a != fixed


def test_long_runs_of_digits_end_soon(spark):
    runs = ["1 2 3 45 678 " * 20_000, "4111 1111 1111 1111 " * 2_000, "1234567890" * 50_000, "123-4567-" * 30_000, "+1 " * 50_000]
    start = time.time()
    got = pseudonymise(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert time.time() - start < 120 and got[1]["n_card"] == 2000 and got[2]["text"] == runs[2]
