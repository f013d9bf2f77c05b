"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block elements.  What lies in menus, footers, sidebars, notices, adverts,
forms, scripts, reader comments and hidden elements is left out by element, class, id or role.  A class,
id or role counts by its whole names and by the leading word of longer ones: "sidebar" and "sidebar-left",
but not "has-sidebar".  An element left out by one of them, or a form, stays if it holds the page's article
or main; one with the leading word only also stays if all good blocks of the page lie in such elements and
are several.  Names in the middle or at the end of a longer one ("site-footer") are left to the passes.  The
first pass decides the other blocks: a block full of links is bad; one that is long enough and dense in stop
words is good; outside an article a long one with hardly any is bad.  The rest is ambiguous: short, or
of middling density.  In the second pass an ambiguous block takes the label of the nearest decided block
before and after it; if they differ, that of the nearer one, and good in a tie.  The edges of an
article count as good blocks, those of the page as bad ones.  Where a page has an article or
main, only blocks inside them are kept.  The blocks of a main outside the articles in it are dropped only if
these articles hold all of its good blocks, or one of them most of its good text.

A null or empty page, and one without good blocks, has an empty text.  Repeated rows give the same text;
extra columns are not read.  The time a page takes is in proportion to its length, also where its elements
are nested without end or never closed: no tag looks through the open elements.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import ship_code
from panelspark.llm.quality_rules import STOP_WORDS

LEAST_LENGTH = 60  # characters of a block that is decided by its stop words
GOOD_STOP = 0.2
BAD_STOP = 0.05
LINKS = 0.5
LONG = 1 << 20  # characters of a block whose words are not listed

# Elements of HTML by the part they play.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table "
    "caption tbody thead tfoot tr ul".split()
)
OUT = set(
    "nav footer aside form button select datalist noscript template svg canvas object audio video map dialog "
    "menu head label".split()
)
MAIN = {"article", "main"}
# Whole class, id and role names, or leading words of them, that mark other parts of a page.
MARKS = re.compile(
    "^(ad|ads|adv|advert|adverts|advertisement|advertising|adsense|adslot|sponsor|sponsored|promo|promotion|"
    "banner|cookie|cookies|consent|gdpr|notice|notices|alert|alerts|popup|modal|overlay|newsletter|subscribe|"
    "subscription|signup|login|nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|sidebar|aside|widget|"
    "widgets|footer|foot|masthead|share|sharing|social|related|recommended|recommendations|comment|comments|"
    "commentlist|disqus|reply|replies|respond|toolbar|pagination|pager|search|complementary|contentinfo|form)$"
)
HEADERS = re.compile("^(header|topbar)$")
NEGATIONS = {"has", "no", "with"}  # a name after one of these says what the page has, not what the element is
# Why an element is left out.
HIDDEN = 1  # hidden, or an element that never holds the page's text
MARKED = 2  # a form, or a mark as a whole name
LEADING = 3  # a mark as the leading word of a longer name
# Elements that end an open one of the first name when they begin.
HOLDS_ITEMS = {"ul", "ol", "dl", "table", "article", "main", "div"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
ITEMS = set(ENDS) | HOLDS_ITEMS
CLOSES_P = BLOCKS - {"body", "html", "head"}

# As in browsers, a quote opens a value only directly after "="; any other one is a character of the tag.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+"
    r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(
    r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))?+)?+"
)
WORD = re.compile(r"[^\W\d_]+")
STOP = frozenset(STOP_WORDS)


@dataclass
class Block:
    zone: int  # number of the article it lies in; 0 outside
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    loose: bool = False  # its text lies directly in a div


@dataclass
class Holder:
    """A left-out element that is open, within another one or none."""

    at: int  # where it begins
    hidden: bool  # it, or one around it, is never put back
    around: Holder | None


def _places(holders: list[Holder]) -> frozenset[int]:
    """Where the left-out elements and all around them begin."""
    found: set[int] = set()
    for holder in holders:
        inner: Holder | None = holder
        while inner and inner.at not in found:
            found.add(inner.at)
            inner = inner.around
    return frozenset(found)


@dataclass
class Held:
    """An article or main in left-out elements, or left out itself."""

    at: int
    main: bool
    itself: bool
    holders: Holder  # the innermost left-out element around it, or itself


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    articles: list[int] = field(default_factory=lambda: [-1])  # where the article of each zone begins
    around: list[int] = field(default_factory=lambda: [0])  # the zone around each zone
    mains: set[int] = field(default_factory=set)  # the zones that are mains
    held: list[Held] = field(default_factory=list)
    leading: list[int] = field(default_factory=list)  # where elements left out by a leading word begin


def _left_out(name: str, rest: str, inside: bool) -> int:
    """Why an element is left out; 0 if it is not."""
    why = 0
    if name in OUT or (name == "header" and not inside):
        if name != "form":
            return HIDDEN
        why = MARKED
    if not rest or rest.isspace() or name in ("html", "body"):
        return why
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return HIDDEN
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HIDDEN
        if key in ("class", "id", "role") and why != MARKED:
            before = ""
            for token in value.split():
                word, *more = re.split("[_-]+", token.strip("_-"))
                if before not in NEGATIONS and (MARKS.match(word) or (not inside and HEADERS.match(word))):
                    if name not in MAIN or word.startswith(("comment", "repl", "related")):
                        why = LEADING if more and why != MARKED else MARKED
                before = token
    return why


def blocks(page: str, spared: frozenset[int] = frozenset()) -> Page:
    """Blocks of a page in order, without those of left-out elements.

    Marked elements that begin at a place in ``spared`` are not left out.
    """
    parsed = Page()
    found = parsed.blocks
    stack: list[tuple[str, int, bool]] = []  # element, why it is left out, whether an article
    opened: Counter[str] = Counter()  # open elements by name
    bounds: list[int] = []  # places in the stack of block elements
    items: list[int] = []  # places in the stack of ITEMS
    holder: Holder | None = None
    out = articles = zone = links = 0
    zones: list[int] = []
    block = Block(0)
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal block
        text = _spaced(html.unescape("".join(block.parts)))
        if text:
            block.text = text
            found.append(block)
        block = Block(zone)

    def add(text: str) -> None:
        if not out and text:
            if zone and not block.parts:
                block.loose = bool(bounds) and stack[bounds[-1]][0] == "div"
            block.parts.append(text)
            if links:
                block.linked += len(text)

    def close(depth: int) -> None:
        nonlocal out, links, zone, holder
        while len(stack) > depth:
            name, left_out, article = stack.pop()
            opened[name] -= 1
            if name in BLOCKS:
                bounds.pop()
                flush()
            if name in ITEMS:
                items.pop()
            if left_out:
                out -= 1
                holder = holder.around
            links -= name == "a"
            if article:
                zones.pop()
                zone = zones[-1] if zones else 0
                block.zone = zone

    while at < size:
        tag = TAG.search(page, at)
        if not tag:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if tag["end"]:
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close(depth)
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in CLOSES_P and bounds and stack[bounds[-1]][0] == "p":
            close(bounds[-1])
        if name in ENDS:
            # two items of a kind are never open without a holder between, so few are passed
            for depth in reversed(items):
                if stack[depth][0] in ENDS[name]:
                    close(depth)
                    break
                if stack[depth][0] in HOLDS_ITEMS:
                    break
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th", "img", "wbr") and name != "wbr":
            add(" ")
        if name in VOID or tag["rest"].endswith("/") and name not in BLOCKS:
            continue
        left_out = _left_out(name, tag["rest"], zone > 0)
        if left_out != HIDDEN and tag.start() in spared:
            left_out = 0
        if left_out == LEADING:
            parsed.leading.append(tag.start())
        main = name == "main" or 'role="main"' in tag["rest"]
        article = main or name in MAIN
        if left_out:
            hidden = left_out == HIDDEN or (holder is not None and holder.hidden)
            holder = Holder(tag.start(), hidden, holder)
        if article and holder:
            article = False
            if not holder.hidden:
                parsed.held.append(Held(tag.start(), main, left_out > 0, holder))
        if article:
            articles += 1
            parsed.articles.append(tag.start())
            parsed.around.append(zone)
            if main:
                parsed.mains.add(articles)
            zones.append(articles)
            zone = articles
            block.zone = zone
        if name in BLOCKS:
            bounds.append(len(stack))
        if name in ITEMS:
            items.append(len(stack))
        stack.append((name, left_out, article))
        opened[name] += 1
        out += left_out > 0
        links += name == "a"
    close(0)
    flush()
    return parsed


def _spaced(text: str) -> str:
    """The text with runs of white space as one space; a long one without a list of its words."""
    return " ".join(text.split()) if len(text) <= LONG else re.sub(r"\s+", " ", text).strip()


def _density(text: str) -> float:
    """The share of stop words among the words of a text."""
    if len(text) <= LONG:
        words = WORD.findall(text)
        return sum(w in STOP for w in words) / len(words) if words else 0.0
    n = stops = 0
    for m in WORD.finditer(text):
        n += 1
        stops += m[0] in STOP
    return stops / max(1, n)


def _first_pass(block: Block) -> bool | None:
    """Good, bad, or None: ambiguous."""
    length = len(block.text)
    if block.linked > LINKS * length:
        return False
    density = _density(block.text.lower())
    if length >= LEAST_LENGTH and density >= GOOD_STOP:
        return True
    if not block.zone and length >= LEAST_LENGTH and density < BAD_STOP:
        return False
    return None


def _good_size(found: list[Block]) -> int:
    return sum(len(b.text) for b in found if _first_pass(b))


def _whole(page: str) -> Page:
    """The blocks of a page, with left-out elements put back that hold its article, main or text."""
    parsed = blocks(page)
    if any(b.zone for b in parsed.blocks) and not any(h.main for h in parsed.held):
        return parsed
    mains = [h.holders for h in parsed.held if h.main]
    if mains:
        return blocks(page, _places(mains))
    if parsed.held:
        outside = _good_size(parsed.blocks)
        trial = blocks(page, _places([h.holders for h in parsed.held]))
        sizes = dict.fromkeys(trial.articles, 0)
        for b in trial.blocks:
            sizes[trial.articles[b.zone]] += len(b.text) if _first_pass(b) else 0
        # a comment or teaser by its own name is the page's article only if nothing else is good
        own = [h for h in parsed.held if not h.itself] or ([] if outside else parsed.held)
        best = max(own, key=lambda h: sizes.get(h.at, 0), default=None)
        if best and (sizes.get(best.at, 0) > outside or not outside):
            return blocks(page, _places([best.holders]))
    if parsed.leading and not _good_size(parsed.blocks):
        trial = blocks(page, frozenset(parsed.leading))
        if sum(_first_pass(b) is True for b in trial.blocks) > 1:
            return trial
    return parsed


def _emptied(parsed: Page) -> set[int]:
    """The mains whose own blocks are dropped, as articles inside say more."""
    inside: dict[int, set[int]] = {m: set() for m in parsed.mains}
    nearest = [0]  # of each zone, the main around it
    for zone in range(1, len(parsed.around)):
        outer = parsed.around[zone]
        nearest.append(outer if outer in inside else nearest[outer])
        if nearest[zone] and zone not in parsed.mains:
            inside[nearest[zone]].add(zone)
    of: dict[int, list[tuple[int, Block]]] = {}
    for i, b in enumerate(parsed.blocks):
        of.setdefault(b.zone, []).append((i, b))
    emptied = set()
    for m, articles in inside.items():
        articles = [a for a in articles if a in of]
        if not articles:
            continue
        own = [(i, b) for i, b in of.get(m, []) if _first_pass(b)]
        size = sum(len(b.text) for _, b in own)
        sizes = [_good_size([b for _, b in of[a]]) for a in articles]
        if sum(sizes):
            if not own or 2 * max(sizes) > size + sum(sizes):
                emptied.add(m)
        # a single loose block behind an article is no story
        elif len(own) == 1 and own[0][1].loose and own[0][0] > min(of[a][0][0] for a in articles):
            emptied.add(m)
    return emptied


def main_text(page: str | None) -> str:
    """The good blocks of a page, joined by line ends."""
    parsed = _whole(page or "")
    found = parsed.blocks
    if any(b.zone for b in found):
        emptied = _emptied(parsed) if parsed.mains else ()
        found = [b for b in found if b.zone and b.zone not in emptied]
    labels = [_first_pass(b) for b in found]
    n = len(found)
    before: list[tuple[int, bool]] = []
    last = (-1, False)
    for i, b in enumerate(found):
        if i == 0 or found[i - 1].zone != b.zone:
            last = (i - 1, b.zone > 0)
        if labels[i] is not None:
            last = (i, bool(labels[i]))
        before.append(last)
    kept = []
    nearest = (n, False)
    for i in range(n - 1, -1, -1):
        if i == n - 1 or found[i + 1].zone != found[i].zone:
            nearest = (i + 1, found[i].zone > 0)
        if labels[i] is not None:
            nearest = (i, bool(labels[i]))
            good = bool(labels[i])
        else:
            (a, left), (b, right) = before[i], nearest
            good = left if left == right else (left if i - a < b - i else right if b - i < i - a else True)
        if good:
            kept.append(found[i].text)
    return "\n".join(reversed(kept))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    ship_code(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
