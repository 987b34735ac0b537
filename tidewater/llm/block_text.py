"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks of text.  The first pass decides blocks by link
density, length and stop-word density: mostly links is boilerplate; long enough
with enough stop words is text; long with few is boilerplate, or open if it lies
in the page's own article element; short blocks and headings are open.  The
second pass gives each open block the label of its nearest decided neighbour
(declared boilerplate is none, as it lies between the blocks of a text).

What surrounds a block is one more feature.  Navigation, header, footer, aside,
form and hidden elements hold no text, nor does what lies outside the page's own
article element where there is one.  Words in class and id are evidence only:
plain names of boilerplate (an advert, a notice, comments) count; other names
with such a word in them do not count on an element that is or contains an
article, nor where four fifths of the prose around is in that element.

Defined results: null and empty pages have no text; unclosed and cut-off markup
is closed by the end of the page; an unfinished tag at the very end is markup;
character references are decoded, also those without a semicolon where HTML
allows it; pages of any length are read whole, in time linear in their length;
repeated rows give repeated results; only page_id, url and html are looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.quality_rules import STOP_WORDS

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NAME = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")

RAW = frozenset("script style noscript template textarea title iframe object canvas noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br area source track svg math".split()
)
#: Elements that are never main text.
OUTSIDE = frozenset("nav footer aside form menu dialog button select fieldset head".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status note".split())
#: Words that, as a name in class or id or a part of one, name boilerplate.
PLAIN_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar
    navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr
    notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin
    comment comments commentlist reply replies respond discussion disqus copyright disclaimer pagination pager""".split()
)
#: Words that may also name an article.
LOOSE_NAMES = frozenset("side search form share sharing social related recommended recommendations trending popular widget widgets legal skip print".split())
#: Beside these a plain name says what an element has or lacks, not what it is.
MODIFIERS = frozenset("has no not non with without is show hide free enabled disabled view news on off".split())
HEADER_NAMES = frozenset("header head pagehead siteheader".split())
NONE, LOOSE, PLAIN = 0, 1, 2
CONTENT_NAMES = frozenset("article articlebody content post entry story main maincontent bodytext".split())
_ALL_STOP = frozenset(w for words in STOP_WORDS.values() for w in words)

GOOD, BAD, SHORT = 1, -1, 0
SHORT_BELOW = 70
LONG_FROM = 200
STOP_LOW, STOP_HIGH = 0.10, 0.25
MAX_LINKS = 0.5


class Block:
    """A run of text between block borders, with what surrounds it."""

    __slots__ = ("bad", "density", "heading", "links", "named", "parts", "places", "text")

    def __init__(self, bad: bool, named: Named | None, places: frozenset, heading: bool):
        self.bad, self.named, self.places, self.heading = bad, named, places, heading
        self.parts: list[str] = []
        self.links = 0

    def measure(self) -> None:
        """Text, share of its letters in links, share of stop words."""
        self.text = " ".join("".join(self.parts).split())
        self.links /= max(1, sum(map(len, self.text.split())))
        words = _WORD.findall(self.text.lower()) if not self.bad and len(self.text) >= SHORT_BELOW else []
        self.density = sum(w in _ALL_STOP for w in words) / max(1, len(words))


def _names(attributes: dict[str, str]) -> list[set[str]]:
    """The words of each name in class and id."""
    joined = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return [set(_NAME.findall(_CAMEL.sub(" ", name).lower())) | set(_NAME.findall(name.lower())) for name in joined.split()]


def _evidence(names: list[set[str]], inside: bool) -> int:
    """How strongly the names of an element speak for boilerplate."""
    found = NONE
    for words in names:
        if words & PLAIN_NAMES or (words & HEADER_NAMES and not inside):
            found = max(found, LOOSE if words & MODIFIERS else PLAIN)
        elif words & LOOSE_NAMES:
            found = max(found, LOOSE)
    return found


def _judge_element(tag: str, raw: str, places: frozenset) -> tuple[bool, int, bool, frozenset]:
    """Whether an element is boilerplate by declaration, how strongly its names
    say so, whether it is an article or main element (an article within an
    article, such as a comment, is none), and which content places its inside
    belongs to."""
    if tag in OUTSIDE:
        return True, NONE, False, places
    attributes = {}
    if raw and not raw.isspace():
        for m in _ATTRIBUTE.finditer(raw):
            attributes.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    names, role = _names(attributes), attributes.get("role", "").lower()
    inside = bool(places)
    bad = role in OUTSIDE_ROLES or (tag == "header" and not inside)
    bad |= "hidden" in attributes or attributes.get("aria-hidden") == "true"
    bad |= "display:none" in attributes.get("style", "").replace(" ", "").lower()
    if tag in ("body", "html"):
        return False, NONE, False, places
    body, main = attributes.get("itemprop") == "articleBody", tag == "main" or role == "main"
    core = body or main or (tag == "article" and "article" not in places)
    if tag == "article" or body:
        places |= {"article"}
    if main:
        places |= {"main"}
    named = _evidence(names, inside)
    if tag not in INLINE and named < PLAIN and any(words & CONTENT_NAMES for words in names):
        places |= {"content"}
    return bad, named, core, places


class Named:
    """An element whose names speak for boilerplate, within another or none."""

    __slots__ = ("lifted", "outer", "prose", "strength")

    def __init__(self, outer: Named | None, strength: int):
        self.outer, self.strength, self.lifted, self.prose = outer, strength, False, 0


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order.

    Names do not count on an element that is or contains an article or main
    element: it is lifted, and so are those around it."""
    out: list[Block] = []
    stack: list[tuple[str, bool, Named | None, frozenset]] = []
    opened: Counter = Counter()
    named: Named | None = None
    bad, places, heading, anchor = False, frozenset(), False, 0
    current = Block(bad, named, places, heading)
    own_bad = False  # of a paragraph-like element that is not on the stack

    def border() -> None:
        nonlocal current
        if current.parts:
            out.append(current)
        current = Block(bad or own_bad, named, places, heading)

    def add(text: str) -> None:
        if text:
            text = entities.unescape(text)
            current.parts.append(text)
            if anchor:
                current.links += len("".join(text.split()))

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            add(rest)
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = m[1] == "/"
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = end.start() if end else len(page)
            if tag not in ("script", "style", "template", "noscript"):
                current.parts.append(" ")
            continue
        if tag == "a":
            anchor = 0 if closing else 1
            continue
        if tag in INLINE:
            if tag in ("br", "svg", "math"):
                current.parts.append(" ")
            continue
        if tag in ("p", "hr") or re.fullmatch(r"h[1-6]", tag):
            own_bad, heading = False, False
            if not closing:
                here, strength, *_ = _judge_element(tag, m[3], places)
                own_bad = here or strength == PLAIN
                heading = tag[0] == "h" and tag != "hr"
            border()
            continue
        if tag in VOID:
            continue
        own_bad, heading = False, False
        if not closing:
            stack.append((tag, bad, named, places))
            opened[tag] += 1
            here, strength, core, places = _judge_element(tag, m[3], places)
            bad = bad or here
            if strength:
                named = Named(named, strength)
            outer = named if core else None
            while outer is not None and not outer.lifted:
                outer.lifted = True
                outer = outer.outer
            if tag in ("nav", "footer", "article", "main", "aside", "section", "div"):
                anchor = 0
        elif opened[tag]:
            while True:
                name, bad, named, places = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
        border()
    border()
    return out


def _weigh_names(found: list[Block]) -> None:
    """Mark what lies in named elements as boilerplate, unless four fifths of
    the prose that nothing else speaks against is in one of them."""
    nodes: dict[Named, None] = {}
    free = 0
    for b in found:
        named = b.named
        while named is not None and named not in nodes:
            nodes[named] = None
            named = named.outer
        if not b.bad and b.links <= MAX_LINKS and b.density >= STOP_LOW:
            if b.named is None or b.named.lifted:
                free += len(b.text)
            elif b.named.strength == LOOSE:
                b.named.prose += len(b.text)

    def depth(node: Named) -> int:
        return depths[node]

    depths: dict[Named, int] = {}
    for node in nodes:
        way = []
        while node is not None and node not in depths:
            way.append(node)
            node = node.outer
        base = depths[node] if node is not None else 0
        for k, n in enumerate(reversed(way)):
            depths[n] = base + k + 1
    for node in sorted(nodes, key=depth, reverse=True):
        if node.strength == LOOSE and node.outer is not None:
            node.outer.prose += node.prose
    for node in sorted(nodes, key=depth):
        # within a plain name nothing is lifted again
        open_ = node.outer is None or node.outer.lifted
        node.lifted = node.lifted or (open_ and node.strength == LOOSE and node.prose > 4 * free)
    for b in found:
        b.bad = b.bad or (b.named is not None and not b.named.lifted)


def _first_pass(block: Block, home: str | None) -> int:
    at_home = home is not None and home in block.places
    if block.bad or block.links > MAX_LINKS or (home is not None and not at_home):
        return BAD
    if len(block.text) < SHORT_BELOW or block.heading:
        return SHORT
    if block.density >= STOP_HIGH or (block.density >= STOP_LOW and (at_home or len(block.text) >= LONG_FROM)):
        return GOOD
    return SHORT if at_home or block.density >= STOP_LOW else BAD


def extract(page: str | None) -> str:
    """The main text of a whole page."""
    if not page:
        return ""
    found = blocks(page)
    for b in found:
        b.measure()
    found = [b for b in found if b.text]
    _weigh_names(found)
    home = next((p for p in ("article", "main", "content") if any(p in b.places and not b.bad for b in found)), None)
    labels = [_first_pass(b, home) for b in found]
    # neighbours are looked for in the article and past declared boilerplate; where nothing is decided all is text
    within = [k for k, b in enumerate(found) if not b.bad and (home is None or home in b.places)]
    final = _inherit([labels[k] for k in within], GOOD)
    for k, label in zip(within, final):
        labels[k] = label
    return " ".join(b.text for b, label in zip(found, labels) if label == GOOD)


def _inherit(labels: list[int], default: int) -> list[int]:
    """Give each ambiguous block the label of the nearest decided one; text wins a tie."""
    n, before, after = len(labels), [], [None] * len(labels)
    last = None
    for k in range(n):
        last = k if labels[k] != SHORT else last
        before.append(last)
    last = None
    for k in range(n - 1, -1, -1):
        last = k if labels[k] != SHORT else last
        after[k] = last
    out = []
    for k in range(n):
        if labels[k] != SHORT:
            out.append(labels[k])
            continue
        near = [(abs(k - j), -labels[j]) for j in (before[k], after[k]) if j is not None]
        out.append(-min(near)[1] if near else default)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    @F.pandas_udf("string")
    def main_text(page: pd.Series) -> pd.Series:
        return pd.Series([extract(p) for p in page], dtype=object)

    out = pages.select("page_id", "url", main_text(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
