"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks of text. The first pass decides a block by stop-word density, length and link density, and by
the containers it stands in; short blocks and those of middling density stay open. The second pass gives each open block
the label of the nearest decided one. Every page is worked on by itself, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shorter blocks are open unless links or a container decide; code points.
SHORT = 70
LONG = 200
#: Share of stop words from which a block reads as prose, and from which it may.
STOP_HIGH = 0.30
STOP_LOW = 0.15
#: Share of linked code points from which a block is a list of links.
LINKED = 0.34
#: A kind of article element is used if it holds this share of the text outside menus and the like.
HOLDS = 0.25
ROWS_AT_ONCE = 200

# Frequent function words of seven languages.
STOP_WORDS = frozenset(
    """
    the of and to in is that it for was on with as by at from are this be or an not have which but
    der die das und den von zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er
    le la les des et en un une du que est pour qui dans sur au par ne pas plus avec il elle ce
    el los las de y que se por con para una su al lo como más pero sus ha
    il lo gli di che è per non sono della nel alla più del anche
    o os as do da em um uma não no na dos ao mais foi
    het een van niet te zijn met aan voor dat op er maar
    """.split()
)
# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
FORMATTING = frozenset("b i em strong u font small big tt s strike code nobr sub sup abbr cite q mark kbd samp var bdi bdo".split())
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul
    """.split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("nav footer aside form menu search dialog fieldset button select datalist noscript template svg object audio video canvas".split())
# Words in class, id and role of containers that hold no article text.
OUTSIDE_WORDS = frozenset(
    """
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar share sharing social related recommended
    recommendations comment comments disqus respond reply replies newsletter subscribe subscription signup login popup modal overlay widget widgets
    pagination pager copyright skip complementary contentinfo search teaser
    """.split()
)
#: A container named so only says that it stands beside such a one.
BESIDE = frozenset("no has with without layout".split())
ARTICLE_CLASSES = frozenset(
    "article article-body article-content articlebody post post-body post-content entry entry-content story story-body content main-content page-content body-text".split()
)
# An element of the key ends an open one of the first set, unless one of the second stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}),
}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|[^>\s]*+))*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_COMMENT_END = re.compile(r"--!?>")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_WORDS = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RIGHTS = re.compile(r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)

#: Kinds of article element, the surest first.
ARTICLE, BODY, MAIN, NONE = 3, 2, 1, 0


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    outside: bool
    in_header: bool
    level: int
    good: bool | None = None
    stops: float = 0.0

    @property
    def link_density(self) -> float:
        return min(1.0, self.linked / len(self.text))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", data, ""), ("open", name, attributes) and ("close", name, "") in page order; comments, scripts and styles are left out."""
    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:], ""
            return
        if mark > at:
            yield "text", page[at:mark], ""
        after = page[mark + 1 : mark + 2]
        letter = page[mark + 2 : mark + 3] if after == "/" else after
        if after in ("!", "?") or (after == "/" and not (letter.isascii() and letter.isalpha())):
            if page.startswith("<!--", mark):
                # "<!-->" and "<!--->" are whole comments
                early = mark + 4 + (page.startswith("->", mark + 4)) if page.startswith((">", "->"), mark + 4) else -1
                end = None if early >= 0 else _COMMENT_END.search(page, mark + 4)
                at = early + 1 if early >= 0 else (end.end() if end else n)
            else:
                end = page.find(">", mark)
                at = n if end < 0 else end + 1
            continue
        if not (letter.isascii() and letter.isalpha()):
            yield "text", "<", ""
            at = mark + 1
            continue
        tag = _TAG.match(page, mark)
        if tag is None:
            return  # the page ends inside a tag
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            yield "close", name, ""
            continue
        yield "open", name, tag[3]
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            yield "close", name, ""


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value.strip("\"'")))
    return out


@dataclass
class _Open:
    name: str
    outside: bool
    in_header: bool
    level: int
    link: bool
    heading: bool


def _opened(name: str, attributes: str, above: _Open, link: bool) -> _Open:
    """What holds inside the element."""
    a = _attributes(attributes) if attributes else {}
    named = " ".join([a.get("class", ""), a.get("id", ""), a.get("role", "")])
    words = {w.lower() for w in _NAME_PARTS.findall(named)} if named.strip() else set()
    classes = {c.lower().replace("_", "-") for c in named.split()}
    level = above.level
    if name == "main" or "main" in classes:
        level = max(level, MAIN)
    if classes & ARTICLE_CLASSES or a.get("itemprop", "").lower() == "articlebody":
        level = max(level, BODY)
    if name == "article":
        level = ARTICLE
    outside = above.outside and name != "main"
    if name in OUTSIDE or "hidden" in a or a.get("aria-hidden") == "true" or ("style" in a and _HIDDEN.search(a["style"])):
        outside = True
    elif name not in ("html", "body", "main") and words & OUTSIDE_WORDS and not words & BESIDE:
        outside = True
    in_header = above.in_header or name == "header" or ("header" in words and name not in HEADINGS and not words & BESIDE)
    return _Open(name, outside or (in_header and level == NONE), in_header, level, link, above.heading or name in HEADINGS)


def blocks(page: str | None) -> list[Block]:
    """Blocks of text in page order, unlabelled; empty ones are left out."""
    out: list[Block] = []
    stack = [_Open("", False, False, NONE, False, False)]
    open_: Counter[str] = Counter()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                top = stack[-1]
                out.append(Block(whole, linked, top.heading, top.outside, top.in_header, top.level))
            text.clear()
        linked = 0

    def pop_to(name: str) -> None:
        while True:
            top = stack.pop()
            open_[top.name] -= 1
            if top.name == name:
                return

    for kind, name, rest in tokens(page or ""):
        if kind == "text":
            data = unescape(name)
            text.append(data)
            if stack[-1].link:
                linked += len(data.strip())
            continue
        if kind == "open":
            if name == "br":
                text.append(" ")
            block = name in BLOCKS
            if block:
                flush()
                if open_["p"]:
                    pop_to("p")
            if name in ENDS:
                ended, barrier = ENDS[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in barrier:
                        break
                    if stack[i].name in ended:
                        pop_to(stack[i].name)
                        break
            if name in VOID or name in FORMATTING or name in RAW:
                continue
            if name == "a" and open_["a"]:
                pop_to("a")
            inner = _opened(name, rest, stack[-1], stack[-1].link or name == "a")
            if inner.outside != stack[-1].outside or inner.level != stack[-1].level:
                flush()
            stack.append(inner)
            open_[name] += 1
        else:
            if name in BLOCKS:
                flush()
            if open_[name] > 0:
                before = stack[-1]
                inner = next(o for o in reversed(stack) if o.name == name)
                i = stack.index(inner)
                if (before.outside, before.level) != (stack[i - 1].outside, stack[i - 1].level):
                    flush()
                pop_to(name)
    flush()
    return out


def _first_pass(page: list[Block]) -> int:
    """Decides blocks by their own features; returns the kind of article element that the page's text stands in."""
    inside = [b for b in page if not b.outside]
    for b in inside:
        found = _WORDS.findall(b.text.lower())
        b.stops = sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0
    plain = sum(len(b.text) for b in inside if b.link_density <= LINKED)
    level = next((k for k in (ARTICLE, BODY, MAIN) if sum(len(b.text) for b in inside if b.level >= k and b.link_density <= LINKED) > HOLDS * plain), NONE)
    # a page of a language without listed words is judged by length and links alone
    known = any(b.stops >= STOP_LOW and len(b.text) >= SHORT for b in inside)
    links = [b.link_density > LINKED for b in page]
    for i, b in enumerate(page):
        if b.outside or b.level < level:
            b.good = False
        elif links[i]:
            # inside an article one linked line may be a line of the article; several in a row are a list of links
            alone = not (links[i - 1] if i else False) and not (links[i + 1] if i + 1 < len(page) else False)
            b.good = None if level and alone else False
        elif not level and len(b.text) < LONG and _RIGHTS.search(b.text):
            b.good = False
        elif b.heading:
            b.good = None
        elif b.in_header:
            b.good = True if len(b.text) >= LONG and b.stops >= STOP_HIGH else False
        elif level:
            b.good = True if len(b.text) >= SHORT or b.stops >= STOP_HIGH else None
        elif len(b.text) < SHORT:
            b.good = None
        elif b.stops >= STOP_HIGH or not known:
            b.good = True
        elif b.stops < STOP_LOW:
            b.good = False
    return level


def _second_pass(page: list[Block], level: int) -> None:
    """Open blocks take the label of the nearest block that its text decided; a tie, or none, keeps the block.

    A heading belongs to what follows it and takes that label. Menus, footers, bylines and whatever else its container
    decided say nothing about the text beside it.
    """
    decided = [None if b.outside or b.in_header or b.level < level else b.good for b in page]
    after: list[tuple[int, bool | None]] = [(0, None)] * len(page)
    at, label = 0, None
    for i in range(len(page) - 1, -1, -1):
        after[i] = (at - i, label)
        if decided[i] is not None:
            at, label = i, decided[i]
    at, label = 0, None
    for i, b in enumerate(page):
        if b.good is None:
            far, following = after[i]
            if following is None:
                b.good = label is not False
            elif label is None or b.heading:
                b.good = following
            else:
                near = i - at
                b.good = label if near < far else following if far < near else label or following
        if decided[i] is not None:
            at, label = i, decided[i]


def labelled(page: str | None) -> list[Block]:
    """The page's blocks with ``good`` set on those of the main text."""
    out = blocks(page)
    _second_pass(out, _first_pass(out))
    return out


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in labelled(page) if b.good)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points, in place of ``html``.

    Blocks are joined by one line feed; white space inside a block, that of character references included, is one space.
    Null and empty pages, and pages without main text, have an empty text. One row per row, repeated rows included; an
    empty table gives an empty one. Other columns are kept; those named like the two new ones are replaced.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html, text, n_chars)]
    names = [f.name for f in kept]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{text}` string", f"`{n_chars}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = [main_text(page) for page in part.column("__page").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*names, text, n_chars])

    return pages.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{html}`").alias("__page")).mapInArrow(run, schema)


def page_blocks(pages: DataFrame, key: Column, html: str = "html") -> DataFrame:
    """One row per block: key, position, text, link_density, stop_density, heading, outside, good.

    ``key`` names the page and may be null; pages without text give no rows.
    """
    given = pages.select(key.alias("key"), F.col(f"`{html}`").alias("page"))
    names = ["key", "position", "text", "link_density", "stop_density", "heading", "outside", "good"]
    kinds = [pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            rows = [(r, i, b) for r, page in enumerate(part.column("page").to_pylist()) for i, b in enumerate(labelled(page))]
            values = [(i, b.text, b.link_density, b.stops, b.heading, b.outside, b.good) for _, i, b in rows]
            columns = [pa.array([v[k] for v in values], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array([r for r, _, _ in rows], pa.int64())), *columns], names)

    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(run, f"key {kind}, position int, text string, link_density double, stop_density double, heading boolean, outside boolean, good boolean")
