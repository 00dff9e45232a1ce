"""Benchmark decontamination by template canonicalisation, in native expressions.

Numbers, names and units of a text become typed placeholders; the template's
windows of ``window`` tokens are hashed and joined with the benchmark's.  Pairs of
document and item that share enough windows are read again, word by word and with
the values of their slots: along a diagonal (place in the document less place in
the item) each value of the item must always meet the same value of the document.
Windows of diagonals that contradict themselves don't count.  So a question with
other numbers or names is caught, and chance overlaps of placeholders are not.

Names can only be told by their capitals: a capitalised word is one wherever it
stands, but for words that often open a sentence.  So an item with names also has a
plain template, in which they are words, for copies in capitals or small letters,
and every item has one in which its first word is a name if it was none and none if
it was; and a text that seems to be names by more than half, such as one in title
case, is read without names.  A pair counts by the best of the templates.

Windows with few words, such as those of sums, say too little without their values.
An item that has no other is looked for as a whole, with all its values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

UNITS = (
    "mm|cm|dm|km|m|mg|g|kg|t|lb|lbs|oz|ml|cl|l|s|ms|min|h|hr|hrs|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|mw|kwh|v|a|j|kj|pa|kpa|bar|mph|kmh|usd|eur|gbp|"
    "metres?|meters?|kilometres?|kilometers?|miles?|feet|foot|inch|inches|yards?|grams?|kilograms?|pounds?|ounces?|litres?|liters?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?"
)
#: Words that open sentences; capitals don't make them names.
OPENERS = (
    "a|about|add|after|all|although|an|and|another|any|are|as|assume|at|because|before|between|both|but|by|calculate|can|choose|compute|consider|could|determine|did|do|does|during|each|either|estimate|evaluate|every|explain|find|first|following|for|from|"
    "given|had|has|have|he|her|here|his|how|however|i|if|imagine|in|is|it|its|let|many|more|most|my|name|no|not|now|of|on|once|one|only|or|other|our|over|please|prove|round|said|select|she|should|show|simplify|since|so|solve|some|state|such|suppose|"
    "that|the|their|then|there|therefore|these|they|this|those|though|three|thus|to|today|two|under|use|using|was|we|were|what|when|where|whether|which|while|who|whose|why|will|with|would|write|yes|yesterday|yet|you|your|"
    "au|aux|avec|ce|ces|cette|comme|dans|de|des|du|elle|en|est|et|il|ils|je|la|le|les|leur|mais|nous|on|ou|par|pour|quand|que|quel|quelle|qui|sa|se|si|son|sur|un|une|vous|"
    "aber|als|am|auch|auf|aus|bei|das|dem|den|der|die|dies|diese|ein|eine|einem|einen|einer|er|es|im|ist|mit|nach|nicht|nur|oder|sie|sind|und|uns|von|vor|wann|warum|was|welche|wenn|wer|wie|wir|wo|zu|zum|zur|"
    "al|como|con|cuando|cuantos|del|donde|el|ella|entre|era|esta|este|esto|las|lo|los|no|nos|para|pero|por|porque|sin|sobre|su|sus|te|un|una|y|ya"
)
#: A run of digits that doesn't belong to a word; a name: capitalised words.
#: Repeated groups are possessive: others take a stack frame for each repetition, and a long text of names would overflow the stack.
#: What begins a match is looked at first, as looking back is dear.
NUMBER = r"(?=[0-9])(?<![\p{L}\p{N}])[0-9]++(?:[.,:/][0-9]++)*+"
def _opening(words: str) -> str:
    """A pattern of the words with capitals, by their first letters, so that one that isn't among them is told apart soon."""
    by: dict[str, set[str]] = {}
    for w in words.split("|"):
        by.setdefault(w[0].upper(), set()).add(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(by.items()))


NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}'-])(?!(?:{_opening(OPENERS)})(?![\p{{L}}'-]))\p{{Lu}}\p{{L}}*\p{{Ll}}[\p{{L}}'-]*+(?: \p{{Lu}}\p{{L}}*\p{{Ll}}[\p{{L}}'-]*+)*+"
_N, _A, _U, _END = "\u0001", "\u0002", "\u0003", "\u0004"


@dataclass(frozen=True)
class Decontamination:
    """``share``: least share of an item's windows.  ``literals``: least words, not placeholders, of a window that counts.  ``tokens``: least tokens of an item that is looked for as a whole inside a text."""

    window: int = 5
    share: float = 0.8
    literals: int = 3
    tokens: int = 3
    broadcast_rows: int = 500_000


def _clean(text: Column) -> Column:
    return F.regexp_replace(text, "[\u0001-\u0004]", " ")


def _numbered(text: Column, valued: bool) -> Column:
    """Numbers and units marked; ``valued``: and their values kept between marks."""
    value, end = ("$0", _END) if valued else ("", "")
    t = F.regexp_replace(text, NUMBER, f" {_N}{value}{end} ")
    mark = f"{_N}[^{_END}{_N}]*{_END}" if valued else _N
    unit = f"$1 {_U}$2{end} " if valued else f"$1 {_U} "
    return F.regexp_replace(t, rf"({mark})[ -]{{0,3}}(?i:({UNITS}))(?![\p{{L}}\p{{N}}])", unit)


def _template_hashes(docs: DataFrame) -> DataFrame:
    """doc_id and h, the hash of each token of the template; marks stand for slots.

    Step by step, since an expression that a CASE names twice is computed twice.
    """
    d = docs.select("doc_id", _clean(F.col("text")).alias("__c"))
    d = d.withColumn("__b", F.regexp_replace("__c", NAME, f" {_A} "))
    d = d.select("doc_id", F.when(F.length("__b") * 2 >= F.length("__c"), F.col("__b")).otherwise(F.col("__c")).alias("__s"))
    words = F.trim(F.regexp_replace(F.lower(_numbered(F.col("__s"), False)), rf"[^\p{{L}}{_N}-{_U}]+", " "))
    return d.select("doc_id", F.transform(F.split(words, " "), lambda x: F.xxhash64(x)).alias("h"))


def _valued(text: Column, names: bool = True) -> Column:
    """The tokens of the template; slots carry their values."""
    t = _clean(text)
    if names:
        t = F.when(F.length(F.regexp_replace(t, NAME, f" {_A} ")) * 2 >= F.length(t), F.regexp_replace(t, NAME, f" {_A}$0{_END} ")).otherwise(t)
    return F.regexp_extract_all(F.lower(_numbered(t, True)), F.lit(rf"[{_N}-{_U}][^{_END}]*{_END}|\p{{L}}+"), F.lit(0))


def _is_slot(x: Column) -> Column:
    return F.ascii(x) < 5


def _windows(hashes: Column, w: int) -> Column:
    """Hash of every window of an array of token hashes; a shorter array is one window."""
    places = F.sequence(F.lit(0), F.greatest(F.size(hashes) - w, F.lit(0)))
    made = F.transform(places, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(w))))
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(made)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, form, tokens (with values) of the templates of each item: as it is written, plain, and with the capital of its first word the other way."""
    base = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text")).filter("item_id is not null")
    base = base.select("item_id", _valued(F.col("text")).alias("named"), _valued(F.col("text"), False).alias("words"))
    first = F.get("named", F.lit(0))
    value = F.substr(first, F.lit(2), F.length(first) - 2)
    turned = F.when(first.startswith(_A), F.split(value, r"[^\p{L}]+")).otherwise(F.array(F.concat(F.lit(_A), first, F.lit(_END))))
    turned = F.concat(turned, F.slice("named", F.lit(2), F.greatest(F.size("named") - 1, F.lit(0))))
    form = lambda k, c, there: F.when(there, F.struct(F.lit(k).alias("form"), F.col(c).alias("tokens") if isinstance(c, str) else c.alias("tokens")))
    has_name = F.exists("named", lambda x: x.startswith(_A))
    forms = F.array(form("named", "named", F.lit(True)), form("plain", "words", has_name), form("turned", turned, (F.size("named") > 0) & (first.startswith(_A) | ~_is_slot(first))))
    return base.select("item_id", F.inline(F.filter(forms, lambda x: x.isNotNull())))


def _spread(df: DataFrame, p: Decontamination, key: list[str], place: str) -> DataFrame:
    """Windows that count: ``key``, place, hash, words (the template's), slots (values, null for words)."""
    w = p.window
    template = F.transform("tokens", lambda x: F.when(_is_slot(x), F.substr(x, F.lit(1), F.lit(1))).otherwise(x))
    df = df.withColumn("__t", template).withColumn("__w", F.transform("__t", lambda x: F.xxhash64(x)))
    rows = df.select(*key, "tokens", "__t", F.posexplode(_windows(F.col("__w"), w)).alias(place, "hash"))
    rows = rows.select(*key, place, "hash", F.slice("__t", F.col(place) + 1, F.lit(w)).alias("words"), F.slice("tokens", F.col(place) + 1, F.lit(w)).alias("cut"))
    known = F.size(F.filter("words", lambda x: ~_is_slot(x)))
    rows = rows.filter((known >= p.literals) | ((F.size("words") < w) & (known > 0)))
    return rows.select(*key, place, "hash", "words", F.transform("cut", lambda x: F.when(_is_slot(x), x)).alias("slots"))


def _whole(docs: DataFrame, items: DataFrame, lengths: list[int], few: bool) -> DataFrame:
    """(doc_id, item_id) of the items (item_id, tokens) that stand in a text as they are, values and all."""
    key = lambda c: F.xxhash64(c, F.lit(11))
    wanted = items.select("item_id", F.col("tokens").alias("own"), key(F.col("tokens")).alias("key"))
    words = docs.select("doc_id", F.explode(F.array(_valued(F.col("text")), _valued(F.col("text"), False))).alias("t"))

    def rows(n: int):
        return F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: key(F.slice("t", i, n)))

    none = F.array().cast("array<bigint>")
    found = F.flatten(F.array(*(F.when(F.size("t") >= n, rows(n)).otherwise(none) for n in lengths)))
    met = words.select("doc_id", F.explode(F.array_distinct(found)).alias("key")).join(F.broadcast(wanted) if few else wanted, "key").select("doc_id", "item_id").distinct()
    # the words themselves, of the few that a hash has named
    again = words.join(met, "doc_id").join(items, "item_id")
    n = F.size("tokens")
    at = F.exists(F.sequence(F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(1))), lambda i: F.slice("t", i, n) == F.col("tokens"))
    return again.filter(at).select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, share) of each pair of a document and a benchmark item that it holds.

    Null and blank texts match nothing.  An item without a window that counts
    matches texts that hold the whole of it, values and all, and is one window; if
    it has fewer than ``tokens`` tokens, only texts whose template equals its own.
    Repeated rows give one result; rows without an id, and items without one, can't
    be named and are left out.  Either table may be empty.  Other columns are
    ignored, whatever their names.
    """
    w = p.window
    read = materialize(_items(benchmark, item_col, item_text), "template-read")
    spread = _spread(read, p, ["item_id", "form"], "j")
    short = F.size("tokens") < w
    # short items with enough tokens are looked for as wholes, and so is what has no window
    counted = spread.select("item_id", "form").distinct()
    wholes = read.join(counted, ["item_id", "form"], "left_anti").union(read.filter(short)).filter(F.size("tokens") >= p.tokens).select("item_id", "tokens").distinct()
    wholes = materialize(wholes, "template-wholes")
    lengths = sorted(r[0] for r in wholes.select(F.size("tokens")).distinct().collect())  # lengths of items, not items
    items = materialize(spread, "template-items")
    item = ["item_id", "form"]
    sizes = items.groupBy(*item).agg(F.count_distinct("hash").alias("n_windows"))
    windows = items.select(*item, "hash").distinct()
    small = windows.count() <= p.broadcast_rows
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")

    hashed = _template_hashes(base).select("doc_id", F.explode(F.array_distinct(_windows(F.col("h"), w))).alias("hash"))
    joined = hashed.join(F.broadcast(windows) if small else windows, "hash").select("doc_id", *item, "hash").distinct()
    shared = joined.groupBy("doc_id", *item).agg(F.count("*").alias("n"))
    pairs = shared.join(sizes, item).filter(F.col("n") >= F.col("n_windows") * p.share).select("doc_id", *item, "n_windows")
    pairs = materialize(pairs, "template-pairs")

    # the candidates once more: their words, and the values of their slots
    few = pairs.count() <= p.broadcast_rows
    ids = pairs.select("doc_id").distinct()
    again = base.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    other = _spread(again.withColumn("tokens", _valued(F.col("text"))), p, ["doc_id"], "i").withColumnsRenamed({"slots": "dslots", "words": "dwords"})
    met = other.join(pairs.select("doc_id", *item), "doc_id").join(items, [*item, "hash"]).filter(F.col("words") == F.col("dwords"))
    met = materialize(met.select("doc_id", *item, "hash", (F.col("i") - F.col("j")).alias("diag"), "slots", "dslots"), "template-met")
    diag = ["doc_id", *item, "diag"]
    slot = met.select(*diag, F.explode(F.filter(F.arrays_zip("slots", "dslots"), lambda x: x["slots"].isNotNull())).alias("s"))
    slot = slot.select(*diag, F.col("s.slots").alias("own"), F.col("s.dslots").alias("other"))
    wrong = slot.groupBy(*diag, "own").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo <> hi")
    sound = met.join(wrong.select(*diag).distinct(), diag, "left_anti").select("doc_id", *item, "hash").distinct()
    found = sound.groupBy("doc_id", *item).agg(F.count("*").alias("n_matched")).join(sizes, item).filter(F.col("n_matched") >= F.col("n_windows") * p.share)
    found = found.select("doc_id", "item_id", "n_windows", "n_matched")
    if lengths:
        one = F.lit(1).cast("long")
        found = found.union(_whole(base, wholes, lengths, wholes.count() <= p.broadcast_rows).withColumns({"n_windows": one, "n_matched": one}))
    scored = found.select("doc_id", "item_id", F.struct((F.col("n_matched") / F.col("n_windows")).alias("share"), "n_windows", "n_matched").alias("s"))
    return scored.groupBy("doc_id", "item_id").agg(F.max("s").alias("s")).select("doc_id", "item_id", "s.n_windows", "s.n_matched", "s.share")
