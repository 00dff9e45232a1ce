"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags, with the implied ends of HTML.  Pass
one decides what it can, by length, stop-word density and link density: long blocks
with enough stop words are text, blocks that are mostly links or long without stop
words are boilerplate (inside an article the last kind stays open).  Pass two lets
each open block inherit the label of the nearest decided block of its own section;
inside an article a tie, or no decided block at all, counts as text.

Before that, elements that say what they are leave the page: menus, footers,
sidebars, adverts, notices, reader comments and the like, known by tag, role, class
or id.  Names of a class that only tell a state or a layout (``has-sidebar``) or have
unknown parts (``side-by-side``) count for nothing.  A header, form, sidebar or other
mere part of a layout comes back if it holds the only article, or most of the
page's prose.  Where articles hold most of the prose, nothing outside them is text.
Every step is linear in the size of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .textvec import text_chunks

STOP_WORDS = frozenset(
    "a an and are as at be been but by can for from had has have he her his i in is it its not of on or she so than that the their them then there they this to was we were what which who will with you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "aber als am an auch auf aus bei bin bis das dem den der die dies durch ein eine einem einen einer er es für haben hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    "al como con cuando de del donde el ella en entre era es esta este esto fue ha hay la las lo los más me mi muy no nos o para pero por que se sin sobre son su sus también te un una uno y ya yo".split()
)
#: Elements whose content is never text.
DROPPED = frozenset("head script style noscript template svg math iframe object embed canvas audio video textarea select option optgroup button nav footer aside dialog menu label input fieldset noframes noembed xmp".split())
#: Of these, the content is read up to the closing tag, whatever it looks like.
RAW = frozenset("script style textarea title noscript iframe template noframes noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "html body address article aside blockquote caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset header hgroup hr legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that may stand in a head; any other one ends it.
_IN_HEAD = frozenset("title meta link script style base noscript template".split())
_CELLS, _ROWS, _GROUPS = frozenset({"td", "th"}), frozenset({"tr"}), frozenset({"tbody", "thead", "tfoot"})
_TABLE = _CELLS | _ROWS | _GROUPS | {"table", "caption", "colgroup"}
#: Blocks that end an open list item or definition looks through.
_LOOSE = frozenset({"address", "div", "p"})

# What class and id names say.  A name is cut into its words; with one of STATES in front, or of SETTINGS anywhere, it says nothing.
STATES = frozenset("has no with without not".split())
SETTINGS = frozenset("open opened closed enabled disabled allowed accepted status on off".split())
#: These say boilerplate whatever stands beside them.
SURE = frozenset("adsbygoogle adsense adslot adbox adunit advert adverts advertising advertisement advertisements sponsored breadcrumb breadcrumbs navbar navigation pagination disqus cookie cookies gdpr newsletter masthead cookiebar".split())
#: These only if every other word of the name is one of them too, or neutral.
LIKELY = frozenset("ad ads nav menu pager toolbar sponsor sponsors promo promos share sharing sharebar social related recommended recommendations notice alert popup modal overlay consent subscribe signup login footer foot replies respond commenters".split())
#: These, under the same condition, unless they hold the article or most of the prose.
LAYOUT = frozenset("sidebar sidebars aside side header topbar widget widgets banner reply discussion legal copyright".split())
NEUTRAL = frozenset(
    "site page main top bottom left right upper lower primary secondary global container wrapper wrap box block section area list bar form post posts entry entries article articles content contents inner outer link links item items "
    "button buttons widget js wp fb google user users reader readers view thread news story stories more column col row panel group header text zone slot unit sticky fixed float floating mobile desktop media menu nav tools and the of for".split()
)
_WORDS_OF = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: A tag without values; the name and what follows it.
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[\s/][^<>\"'=]*+)?+)>")
_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_GAP = re.compile(r"[\s/]*+")
_ATTR = re.compile(r"[^\s/>][^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_AFTER = frozenset(" \t\n\r\f/>")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")

FREE, PART, GONE = 0, 1, 2


@dataclass(frozen=True)
class BlockRules:
    """``most``: how many times the prose elsewhere a part of the layout must hold to come back."""

    long: int = 70
    stop_high: float = 0.2
    stop_low: float = 0.08
    link_high: float = 0.5
    most: float = 2.0


@dataclass
class Block:
    """``kind`` and ``root``: what the elements around it (inside its article) say, and which one says it; ``outer``: what those around its article say."""

    text: str
    linked: int
    tag: str
    article: int  # number of the article that holds it; 0: none
    kind: int
    root: int
    outer: int
    label: str = ""
    prose: bool = False


@lru_cache(4096)
def _named(names: str) -> int:
    """What the names in a class or id say of an element."""
    out = FREE
    for name in names.split():
        words = [w.lower() for w in _WORDS_OF.findall(name)]
        if not words or words[0] in STATES or not SETTINGS.isdisjoint(words):
            continue
        if any(w in SURE or w.startswith("comment") and w not in ("commented", "commentary") for w in words):
            return GONE
        known = LIKELY | LAYOUT | NEUTRAL
        if not all(w in known for w in words):
            continue
        # the words that name the thing; "header" and the like in front of others only tell a place
        if any(w in LIKELY for w in words):
            return GONE
        if any(w in LAYOUT for w in words):
            out = PART
    return out


def _said(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    if tag in DROPPED:
        return GONE
    if tag in ("html", "body"):
        return FREE
    out = PART if tag == "form" or tag == "header" and not in_article else FREE
    if not attrs:
        return out
    if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or _NONE.search(attrs.get("style", "")):
        return GONE
    if attrs.get("role", "").strip().lower() in _ROLES:
        return GONE
    if tag not in ("article", "main") and tag not in HEADINGS:
        for a in ("class", "id"):
            if attrs.get(a):
                # inside an article a part of its layout is a part of it, but for sidebars
                kind = _named(attrs[a])
                if kind == PART and in_article and "side" not in attrs[a].lower() and "widget" not in attrs[a].lower():
                    kind = FREE
                out = max(out, kind)
    return out


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag from behind its name on, and where the tag ends.

    A quote that isn't closed, or whose closing is the opening of another one, ends
    with its tag.
    """
    out: dict[str, str] = {}
    n = len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= n:
            return out, n
        if page[at] == ">":
            return out, at + 1
        m = _ATTR.match(page, at)
        name, at = m[0].lower(), m.end()
        m = _EQUALS.match(page, at)
        if not m:
            out.setdefault(name, "")
            continue
        at = m.end()
        quote = page[at : at + 1]
        if quote not in ('"', "'"):
            m = _BARE.match(page, at)
            out.setdefault(name, m[0])
            at = m.end()
            continue
        to = page.find(quote, at + 1)
        if to < 0 or page[to + 1 : to + 2] not in _AFTER and to + 1 < n:
            gt = page.find(">", at + 1, to if to >= 0 else n)
            if gt >= 0:
                out.setdefault(name, page[at + 1 : gt])
                return out, gt + 1
            if to < 0:
                return out, n
        out.setdefault(name, page[at + 1 : to])
        at = to + 1


class _Reader:
    """Open elements and finished blocks while a page is read."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        # tag, kind, root, article and outer before it opened
        self.stack: list[tuple[str, int, int, int, int]] = []
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.special: list[int] = []  # places of blocks that end the search for a list item
        self.parts: list[str] = []
        self.linked, self.link = 0, False
        self.kind, self.root, self.article, self.outer = FREE, -1, 0, FREE
        self.seen, self.roots = 0, 0
        self.tag = ""

    def text(self, piece: str) -> None:
        if self.kind != GONE:
            self.parts.append(piece)
            if self.link:
                self.linked += len(piece.strip())

    def close(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()
            if text:
                self.out.append(Block(text, self.linked, self.tag, self.article, self.kind, self.root, self.outer))
            self.parts = []
        self.linked = 0

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        block = tag in BLOCKS
        self.open.setdefault(tag, []).append(len(self.stack))
        if block and tag not in _LOOSE:
            self.special.append(len(self.stack))
        self.stack.append((tag, self.kind, self.root, self.article, self.outer))
        if self.kind != GONE:
            said = _said(tag, attrs, self.article > 0)
            if said > self.kind:
                self.kind, self.root, self.roots = said, self.roots, self.roots + 1
            holds = tag in ("article", "main") or attrs and (attrs.get("role", "").strip().lower() in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower())
            if holds and self.kind != GONE and not self.article:
                self.seen += 1
                self.article, self.outer, self.kind, self.root = self.seen, self.kind, FREE, -1
        if block:
            self.tag = tag

    def pop_to(self, place: int) -> None:
        """End the element at ``place`` of the stack and all within."""
        while len(self.stack) > place:
            tag, kind, root, article, outer = self.stack.pop()
            self.open[tag].pop()
            if self.special and self.special[-1] == len(self.stack):
                self.special.pop()
            if tag in BLOCKS:
                self.close()
            elif tag == "a":
                self.link = False
            self.kind, self.root, self.article, self.outer = kind, root, article, outer

    def last(self, *tags: str) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if self.open.get("head") and tag not in _IN_HEAD:
            self.pop_to(self.open["head"][0])
        if tag in BLOCKS:
            self.close()
            # implied ends
            wall = self.last("td", "th", "table", "caption", "button", "object")
            if (p := self.last("p")) > wall and tag not in ("html", "body"):
                self.pop_to(p)
            inner = self.stack[self.special[-1]][0] if self.special else ""
            if tag == "li" and inner == "li" or tag in ("dd", "dt") and inner in ("dd", "dt"):
                self.pop_to(self.special[-1])
            table = self.last("table")
            for group, ends in ((_CELLS, ("td", "th")), (_ROWS, ("tr",)), (_GROUPS, ("tbody", "thead", "tfoot"))):
                if tag in group or tag in _ROWS and group is _CELLS or tag in _GROUPS and group is not _GROUPS:
                    if (k := self.last(*ends)) > table:
                        self.pop_to(k)
        if tag == "br":
            self.text(" ")
        elif tag == "a" and self.last("a") > (self.special[-1] if self.special else -1):
            self.pop_to(self.last("a"))
        if tag in VOID or tag in ("html", "body"):
            return
        self.push(tag, attrs)
        if tag == "a":
            self.link = True

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.close()
        if tag == "a":
            self.link = False
        places = self.open.get(tag)
        if not places:
            return
        if tag not in _TABLE and places[-1] < self.last("td", "th", "table", "caption"):
            return  # an end inside a cell doesn't reach out of it
        if tag not in BLOCKS and tag not in DROPPED and self.special and places[-1] < self.special[-1]:
            return  # neither does that of a span out of a block
        self.pop_to(places[-1])


def blocks(page: str) -> list[Block]:
    """Blocks with text that no element drops for good, in page order."""
    r = _Reader()
    at, n = 0, len(page)
    ends: dict[str, re.Pattern] = {}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            piece = page[at:lt]
            if r.open.get("head") and len(r.stack) == r.open["head"][0] + 1 and piece.strip():
                r.pop_to(r.open["head"][0])
            r.text(piece)
        if lt == n:
            break
        m = _PLAIN.match(page, lt)
        if m:
            at = m.end()
            tag = m[2].lower()
            attrs = dict.fromkeys(m[3].lower().replace("/", " ").split(), "") if m[3] else {}
        elif m := _OPEN.match(page, lt):
            tag = m[2].lower()
            attrs, at = attributes(page, m.end())
        else:
            if page.startswith("<!--", lt):
                to = page.find("-->", lt + 2)
                at = n if to < 0 else to + 3
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                to = page.find(">", lt + 1)
                at = n if to < 0 else to + 1
            else:
                r.text("<")
                at = lt + 1
            continue
        if m[1]:
            r.end(tag)
            continue
        r.start(tag, attrs)
        if tag in RAW:
            pattern = ends.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])", re.I))
            to = pattern.search(page, at)
            stop = to.start() if to else n
            r.text(page[at:stop])
            at = stop
    r.pop_to(0)
    r.close()
    return r.out


def classify(found: list[Block], rules: BlockRules = BlockRules()) -> list[Block]:
    """Labels of the blocks: good or bad."""
    stops, links, counts = [], [], []
    for b in found:
        words = _WORD.findall(b.text.lower())
        counts.append(len(words))
        stops.append(sum(w in STOP_WORDS for w in words) / max(1, len(words)))
        links.append(b.linked / max(1, len(b.text)))
        b.prose = len(b.text) >= rules.long and stops[-1] >= rules.stop_low and links[-1] <= rules.link_high
    # articles inside a part of the layout count if there are no others
    clear = any(b.article and not b.outer for b in found)
    # parts of the layout come back if they hold most of the prose
    held: dict[int, int] = {}
    free = 0
    for b in found:
        if b.prose and b.kind == PART:
            held[b.root] = held.get(b.root, 0) + len(b.text)
        elif b.prose and not (b.outer and clear):
            free += len(b.text)
    back = {root for root, size in held.items() if size > rules.most * free}
    drop = [b.outer == PART and clear or b.kind == PART and b.root not in back for b in found]
    inside = sum(len(b.text) for b, d in zip(found, drop, strict=True) if b.article and b.prose and not d)
    outside = sum(len(b.text) for b, d in zip(found, drop, strict=True) if not b.article and b.prose and not d)
    only = inside > outside
    for k, b in enumerate(found):
        if drop[k] or only and not b.article:
            b.label, drop[k] = "bad", True
        elif links[k] > rules.link_high:
            if b.article and len(b.text) >= rules.long and stops[k] >= rules.stop_high:
                b.label = "good"
            elif not b.article or counts[k] > 2 and b.tag in ("li", "td", "ul", "ol"):
                b.label = "bad"
        elif len(b.text) >= rules.long:
            if stops[k] >= (rules.stop_low if b.article else rules.stop_high):
                b.label = "good"
            elif stops[k] < rules.stop_low and not b.article:
                b.label = "bad"
    # what left the page decides nothing about its neighbours
    first = ["" if d else b.label for b, d in zip(found, drop, strict=True)]
    before, after = _nearest(found, first, 1), _nearest(found, first, -1)
    articles = any(b.article for b in found)
    for k, b in enumerate(found):
        if b.label:
            continue
        near = [(abs(k - j), first[j]) for j in (before[k], after[k]) if j >= 0]
        if not near:
            b.label = "good" if b.article or not articles else "bad"
            continue
        least = min(d for d, _ in near)
        labels = {x for d, x in near if d == least}
        b.label = labels.pop() if len(labels) == 1 else "good" if b.article else "bad"
    return found


def _nearest(found: list[Block], first: list[str], step: int) -> list[int]:
    """For each block, the place of the last decided block of its section that comes before it in the given direction; -1 without one."""
    last: dict[int, int] = {}
    out = [-1] * len(found)
    for k in range(len(found))[::step]:
        out[k] = last.get(found[k].article, -1)
        if first[k]:
            last[found[k].article] = k
    return out


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    return " ".join(b.text for b in classify(blocks(page or ""), rules) if b.label == "good")


def extract(pages: DataFrame, rules: BlockRules = BlockRules(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row, in one pass without a shuffle.

    A null or empty page has an empty text.  Broken markup is read to its end:
    open elements end with the page.  Repeated rows and rows without an id are
    treated like any other.  An empty table gives an empty result.  Other columns
    are ignored, whatever their names.
    """
    base = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "html"):
            made = [main_text(x.decode("utf-8", "replace"), rules) for x in texts]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
