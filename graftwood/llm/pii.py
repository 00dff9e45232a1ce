"""Format-preserving pseudonyms of personal numbers, dates and addresses, in native expressions.

A keyed Feistel network permutes the characters of a value within their classes
(digit, lower-case or capital letter): each round shifts one half of the value,
character by character and modulo the class's size, by a stream that SHA-256
makes of the key, the round and the other half.  Values of one written form are
permuted among themselves, and forms don't overlap: so a value keeps its form, two
values never share a pseudonym, and equal values stay linked across documents.

Numbers and dates are validated first, and their pseudonyms are valid too:

- card numbers: 13 to 19 digits that pass the Luhn check; the first digit stays
  and the check digit is computed anew.  In a longer run of digits, with single
  blanks or hyphens between, each group of digits, and each row of groups of three
  to six, is tried, the longest first;
- IPv4 addresses: four octets of at most 255, permuted as one number; an octet with
  leading zeros keeps its zeros and its width;
- dates from 1900 to 2099 that exist (ISO, day or month first with slashes, day
  first with dots).  What is written tells the form: the width of day and month, and
  with slashes whether the day must come first (both readings: day first).  Dates are
  permuted among those of their form by cycle walking;
- telephone numbers: 8 to 15 digits behind a plus sign, with or without separators,
  or a national number with an area code; the country code and the first digits of
  area and exchange stay;
- social security numbers with a possible area, group and serial; the area stays;
- e-mail addresses: the part before the @.

What fails validation isn't touched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unbounded groups are possessive: others take a stack frame for each repetition.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.(?=[A-Za-z0-9]))++[A-Za-z]{2,}"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (
    r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{8,15}(?!\d)"
    r"|\+\d{1,3}(?:[ .-]\d{2,8}){1,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
)
#: A run of digits; it ends before a date or a social security number.
CARD = r"(?<![\d-])\d(?:(?:[ -](?!\d{4}-\d{2}-\d{2}(?![\d-])|\d{3}-\d{2}-\d{4}(?![\d-])))?\d){12,}+"
NUMERIC = f"(?=[0-9+(])(?:{'|'.join((DATE, IP, SSN, PHONE, CARD))})"
ANY = f"{EMAIL}|{NUMERIC}"
KINDS = ("email", "date", "ip", "ssn", "phone", "card")
ROUNDS = 8
_DAYS = 73049  # 1900-01-01 to 2099-12-31
#: Steps of a walk at most.  A form holds over a fifth of all days, so that no walk in 10**35 is longer.
_WALK = 400
_MARK = "\u0001"


def key_column(spark: SparkSession, key: str) -> Column:
    """The key as a scalar subquery over a local relation, whose values no plan, log or web page shows."""
    if not key:
        raise ValueError("pseudonyms need a key")
    return spark.sql("SELECT * FROM VALUES (:k) AS t(k)", args={"k": key}).scalar()


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with ``value`` computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _stream(key: Column, tag: str, half: Column, r: Column) -> Column:
    return F.sha2(F.concat(key, F.lit(f"|{tag}|"), r.cast("string"), F.lit("|"), half), 256)


def _shift(half: Column, hexes: Column) -> Column:
    """``half`` with each letter or digit moved on within its class by a byte of ``hexes``."""

    def one(i: Column) -> Column:
        c = F.substr(half, i, F.lit(1))
        v = F.conv(F.substr(hexes, F.pmod((i - 1) * 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
        turned = lambda base, n: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + v, F.lit(n)))
        return F.when(c.between("0", "9"), turned(48, 10)).when(c.between("a", "z"), turned(97, 26)).when(c.between("A", "Z"), turned(65, 26)).otherwise(c)

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), ""))


def permute_text(value: Column, key: Column, tag: str) -> Column:
    """Keyed permutation of the strings of one format (the classes of the characters by place)."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1, F.length(value)).alias("r"))

    def step(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), _let(_stream(key, tag, s["r"], i), lambda h: _shift(s["l"], h)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"]))


def permute_number(x: Column, a: Column | int, b: Column | int, key: Column, tag: str) -> Column:
    """Keyed permutation of 0 <= x < a * b: rounds on a pair (x div b, x mod b), whose radices change places."""
    a, b = (F.lit(n).cast("long") for n in (a, b))
    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        v = F.conv(F.substr(_stream(key, tag, s["r"].cast("string"), i), F.lit(1), F.lit(12)), 16, 10).cast("long")
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + v, F.when(i % 2 == 1, a).otherwise(b)).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * b + s["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["s"], F.when(is_digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("s"), F.when(is_digit, s["k"] + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.split(m, ""), start, step, lambda s: s["s"])


def _luhn_digit(payload: Column) -> Column:
    """The check digit of a string of digits."""
    n = F.length(payload)

    def add(s: Column, i: Column) -> Column:
        d = F.substr(payload, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return s + F.when((n - i) % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _date_of(m: Column) -> Column:
    """(date, whether the day comes first) of a written date; null if there is no such day."""
    day_first = F.coalesce(F.try_to_date(m, "d/M/yyyy"), F.try_to_date(m, "d.M.yyyy"))
    iso = F.try_to_date(m, "yyyy-MM-dd")
    date = F.when(m.contains("-"), iso).otherwise(F.coalesce(day_first, F.try_to_date(m, "M/d/yyyy")))
    return F.struct(date.alias("date"), day_first.isNotNull().alias("day_first"))


def _kind(m: Column) -> Column:
    """Kind of a match by its looks and, but for cards, its validity; null if it isn't valid."""
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    ssn_ok = m.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})$"), F.when(F.year(_date_of(m)["date"]).between(1900, 2099), "date"))
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.when(octets, "ip"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(ssn_ok, "ssn"))
        .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$") & F.length(_digits(m)).between(8, 15), "phone")
        .when(m.rlike(r"^\+\d"), "groups")
        .otherwise("card")
    )


def _card(m: Column, key: Column) -> Column:
    d = _digits(m)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    return _let(body, lambda x: _refill(m, F.concat(x, _luhn_digit(x))))


def _hit(text: Column, kind: str, n: Column | int = 1) -> Column:
    return F.struct(text.alias("text"), F.lit(kind).alias("kind"), (F.lit(n) if isinstance(n, int) else n).alias("n"))


def _cards(m: Column, key: Column) -> Column:
    """A run of digits with its card numbers replaced: of the rows of groups that could be one, the leftmost, of these the longest, and on behind it."""
    tokens = F.regexp_extract_all(m, F.lit(r"[0-9]+[^0-9]*"), F.lit(0))
    # what is tried again and again is made once: tokens, their digits, whether all of them together may be a card
    known = F.struct(tokens.alias("t"), F.transform(tokens, _digits).alias("g"), (F.length(_digits(m)) <= 19).alias("whole"))
    return _let(known, lambda s: _let(_card_rows(s), lambda rows: _with_cards(m, s["t"], rows, key)))


def _card_rows(s: Column) -> Column:
    """(i, e) of each row of groups i to e that is a card number, the longest for each i; rows may overlap."""
    k = F.size(s["t"])

    def fits(i: Column, j: Column) -> Column:
        row = F.slice(s["g"], i, j - i + 1)
        shaped = (i == j) | F.forall(row, lambda x: F.length(x).between(3, 6)) | (s["whole"] & (i == 1) & (j == k))
        return shaped & _let(F.array_join(row, ""), lambda d: F.length(d).between(13, 19) & _luhn(d))

    def last(x: Column, at: Column) -> Column:
        i, size = at + 1, F.length(x)
        tried = F.sequence(i, F.least(k, i + 18))
        return F.struct(i.alias("i"), F.when((i == 1) | size.between(3, 6) | size.between(13, 19), F.array_max(F.filter(tried, lambda j: fits(i, j)))).alias("e"))

    found = F.filter(F.transform(s["g"], last), lambda x: x["e"].isNotNull())
    none = F.array().cast("array<struct<i: int, e: int>>")
    free = lambda c, x: (F.size(c) == 0) | (F.element_at(c, -1)["e"] < x["i"])
    return F.aggregate(found, none, lambda c, x: F.when(free(c, x), F.concat(c, F.array(x))).otherwise(c))


def _with_cards(m: Column, t: Column, rows: Column, key: Column) -> Column:
    """The tokens ``t`` of a match with the chosen rows replaced."""

    def part(x: Column, at: Column) -> Column:
        before = F.when(at == 0, 0).otherwise(F.get(rows, at - 1)["e"])
        plain = F.array_join(F.slice(t, before + 1, x["i"] - before - 1), "")
        return F.concat(plain, _card(F.array_join(F.slice(t, x["i"], x["e"] - x["i"] + 1), ""), key))

    last = F.element_at(rows, -1)["e"]
    tail = F.array_join(F.slice(t, last + 1, F.greatest(F.size(t) - last, F.lit(0))), "")
    made = F.concat(F.array_join(F.transform(rows, part), ""), tail)
    return F.when(F.size(rows) == 0, _hit(m, "none", 0)).otherwise(_hit(made, "card", F.size(rows)))


def _phone(m: Column, key: Column) -> Column:
    """Of the last ten digits, the first and fourth stay; shorter numbers keep the digits before the last seven."""
    d = _digits(m)
    n = F.length(d)
    area = F.when(n >= 10, F.substr(d, n - 8, F.lit(2))).otherwise("")
    cut = F.when(n >= 10, n - 9).otherwise(n - 6)  # digits up to and with the first that stays

    def filled(moved: Column) -> Column:
        new_area = F.when(n >= 10, F.concat(F.substr(moved, F.lit(1), F.lit(2)), F.substr(d, n - 6, F.lit(1)))).otherwise("")
        return _refill(m, F.concat(F.substr(d, F.lit(1), cut), new_area, F.substr(moved, F.length(moved) - 5, F.lit(6))))

    return _let(permute_text(F.concat(area, F.substr(d, n - 5, F.lit(6))), key, "phone"), filled)


def _groups(m: Column, key: Column) -> Column:
    """A plus sign and more digits than a telephone number has: its longest row of first groups that could be one is; else a card may stand behind."""
    tokens = F.regexp_extract_all(m, F.lit(r"[0-9]+[^0-9]*"), F.lit(0))

    def search(t: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(1), F.size(t)), lambda j: F.length(_digits(F.array_join(F.slice(t, F.lit(1), j), ""))).between(8, 15))

        def made(j: Column) -> Column:
            first, rest = F.array_join(F.slice(t, F.lit(1), j), ""), F.array_join(F.slice(t, j + 1, F.size(t)), "")
            other = _let(F.substr(m, F.lit(2), F.length(m)), lambda x: _let(_cards(x, key), lambda h: F.struct(F.concat(F.lit("+"), h["text"]).alias("text"), h["kind"].alias("kind"), h["n"].alias("n"))))
            return F.when(j.isNotNull(), _hit(F.concat(F.lit("+"), _phone(first, key), rest), "phone")).otherwise(other)

        return _let(F.array_max(fits), made)

    return _let(tokens, search)


def _ip(m: Column, key: Column) -> Column:
    o = F.split(m, r"\.")
    padded = lambda x: (F.length(x) > 1) & x.startswith("0")
    radix = lambda x: F.when(padded(x), F.when(F.length(x) == 2, 10).otherwise(100)).otherwise(256).cast("long")

    def made(s: Column) -> Column:
        r = [s["r"][k] for k in range(4)]
        v = [s["o"][k].cast("long") for k in range(4)]
        x = ((v[0] * r[1] + v[1]) * r[2] + v[2]) * r[3] + v[3]

        def written(y: Column) -> Column:
            y3, y2, y1 = y, F.floor(y / r[3]), F.floor(y / (r[3] * r[2]))
            y0 = F.floor(y / (r[3] * r[2] * r[1]))
            parts = []
            for k, q in enumerate((y0, y1, y2, y3)):
                t = F.pmod(q, r[k]).cast("long").cast("string")
                parts.append(F.when(padded(s["o"][k]), F.lpad(t, F.length(s["o"][k]), F.lit("0"))).otherwise(t))
            return F.concat_ws(".", *parts)

        return _let(permute_number(x, r[0] * r[1], r[2] * r[3], key, "ip"), written)

    return _let(F.struct(o.alias("o"), F.transform(o, radix).alias("r")), made)


def _date(m: Column, key: Column) -> Column:
    first = F.lit("1900-01-01").cast("date")

    def made(s: Column) -> Column:
        fields = F.split(m, "[/.]")
        iso = m.contains("-")
        w1, w2 = F.length(fields[0]), F.length(F.get(fields, F.lit(1)))
        day_width, month_width = F.when(s["day_first"], w1).otherwise(w2), F.when(s["day_first"], w2).otherwise(w1)

        def of_form(v: Column) -> Column:
            day = F.date_add(first, v.cast("int"))
            fits = ((day_width == 2) | (F.dayofmonth(day) < 10)) & ((month_width == 2) | (F.month(day) < 10))
            return iso | fits & (s["day_first"] | (F.dayofmonth(day) > 12))

        once = lambda v: permute_number(v, 271, 270, key, "date")  # noqa: E731  271 * 270 = 73170
        state = lambda v: F.struct(v.alias("v"), ((v < _DAYS) & of_form(F.least(v, F.lit(_DAYS - 1)))).alias("fine"))
        x = F.datediff(s["date"], first).cast("long")
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), _let(once(x), state), lambda c, _: F.when(c["fine"], c).otherwise(_let(once(c["v"]), state)), lambda c: F.when(c["fine"], c["v"]).otherwise(x))

        def written(y: Column) -> Column:
            day = F.date_add(first, y.cast("int"))
            wide = lambda n, w: F.when(w == 2, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
            d, mo, sep = wide(F.dayofmonth(day), day_width), wide(F.month(day), month_width), F.when(m.contains("/"), "/").otherwise(".")
            year = F.year(day).cast("string")
            return F.when(iso, F.date_format(day, "yyyy-MM-dd")).when(s["day_first"], F.concat(d, sep, mo, sep, year)).otherwise(F.concat(mo, sep, d, sep, year))

        return _let(walk, written)

    return _let(_date_of(m), made)


def _ssn(m: Column, key: Column) -> Column:
    tail = F.substr(_digits(m), F.lit(4), F.lit(6))
    bad = lambda v: v.rlike(r"^00|0000$")
    # about one place in a hundred isn't possible; it walks on
    moved = F.aggregate(F.sequence(F.lit(1), F.lit(24)), permute_text(tail, key, "ssn"), lambda v, _: F.when(bad(v), permute_text(v, key, "ssn")).otherwise(v))
    return _refill(m, F.concat(F.substr(m, F.lit(1), F.lit(3)), moved))


def _email(m: Column, key: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_text(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at, F.length(m)))


def _pseudonym(m: Column, key: Column) -> Column:
    """(text, kind, n) of a match; its kind is found once."""

    def made(kind: Column) -> Column:
        out = F.when(kind == "card", _cards(m, key)).when(kind == "groups", _groups(m, key))
        for k, f in {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone}.items():
            out = out.when(kind == k, _hit(f(m, key), k))
        return out.otherwise(_hit(m, "none", 0))

    return _let(_kind(m), made)


def _pieces(text: Column) -> Column:
    """Text cut into what lies between matches and, at every second place, the matches."""

    def cut(pattern: str) -> Column:
        marked = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
        # a text that holds the mark is read twice instead
        both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s, h: F.array(s, h))
        twice = F.filter(F.flatten(both), lambda x: x.isNotNull())
        return F.when(text.contains(_MARK), twice).otherwise(marked)

    return F.when(text.contains("@"), cut(ANY)).when(text.rlike("[0-9]"), cut(NUMERIC)).otherwise(F.array(text))


def _count(kind: str, s: Column, x: Column) -> Column:
    return s + F.when(x["kind"] == kind, x["n"]).otherwise(0)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_<kind> replaced for each kind; one row per document, in one pass without a shuffle.

    An empty key is an error.  Null texts are empty.  Documents without a match
    come back as they are.  Repeated rows and rows without an id are treated like
    any other.  An empty table gives an empty result.  Other columns are ignored,
    whatever their names.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", _pieces(F.col("text")).alias("__pieces"), key_column(docs.sparkSession, key).alias("__key"))
    made = F.transform("__pieces", lambda m, i: F.when(i % 2 == 1, _pseudonym(m, F.col("__key"))).otherwise(_hit(m, "none", 0)))
    base = base.select("doc_id", F.when(F.size("__pieces") > 1, made).otherwise(F.array(_hit(F.get("__pieces", F.lit(0)), "none", 0))).alias("__made"))
    return base.select(
        "doc_id",
        F.array_join(F.transform("__made", lambda x: x["text"]), "").alias("text"),
        *(F.aggregate("__made", F.lit(0), partial(_count, k)).cast("long").alias(f"n_{k}") for k in KINDS),
    )
