"""Main text of web pages by tree scoring.

A page becomes a tree of its blocks. Each paragraph has points for its length and
commas; it passes them to the block around it, and from there half of them to each
further ancestor. A block's score is its points, less the share of its text that is
links. The best block is the container; siblings that score well beside it, or are
plain paragraphs, are kept with it. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts and comments neither score nor show.

Reading is one pass over the tags with a stack of bounded depth, so a page costs
time in proportion to its length, however it is broken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrado.llm.common import slices

# fixed values: HTML's elements by what they do to a text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not parsed.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset("nav footer aside script style noscript template head title button select textarea iframe object svg canvas audio video dialog menu noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are a paragraph themselves: their text's points go to the block around them.
PARAGRAPHS = HEADINGS | frozenset("p li pre blockquote dd dt figcaption summary caption td th address".split())
MAIN = frozenset(("article", "main"))
#: What a start tag closes first, and how far up: (elements closed, elements that stop the search).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Names (words of class and id) of what is no article: whole words, and beginnings of words.
NAMES = frozenset("ad ads adv adbox adsense nav menu cookies notice notices hidden share sharing social related tags respond reply replies login signup skip search toc".split())
STARTS = ("advert", "comment", "cookie", "sidebar", "sponsor", "newsletter", "subscri", "breadcrumb", "footer", "navbar", "navigation", "promo", "consent", "gdpr", "disqus", "recommend", "popup", "modal", "pagination", "toolbar", "menubar")
HEADER_NAMES = frozenset("header masthead topbar pageheader siteheader banner".split())
COMMENTS = ("comment", "reply", "replies", "disqus", "respond")
#: Words before which a name says nothing about the block itself (`has-sidebar`).
ABOUT = frozenset("has with no without".split())
# end of fixed values

#: Deeper elements count as text of the block at this depth.
DEPTH = 400
#: Share of a container's points that goes to its own ancestor.
DECAY = 0.5
#: Share of the best score that a sibling needs; characters and link share of a sibling that is a paragraph.
SIBLING, PARAGRAPH, LINKS = 0.2, 80, 0.25
#: What an article or main element's score counts more.
SEMANTIC = 1.5
NORMAL, HARD, SOFT, HEADER = range(4)

_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|[!?/])")
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_INTERESTING = re.compile(r"class|id\s*=|role|hidden|style", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LONG_NUMBER = re.compile(r"&#0*+([0-9]{8,});?|&#0{8,}+([0-9]{0,7});?")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}


def decoded(text: str) -> str:
    """Character references decoded; numbers too long for a character become U+FFFD, as any beyond Unicode do."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_NUMBER.sub(lambda m: "�" if m[1] else f"&#{m[2] or 0};", text)
    return html.unescape(text)


@lru_cache(maxsize=1 << 12)
def _kind(tag: str, attributes: str) -> int:
    """What an element's name and attributes say: kept, dropped, dropped unless the article is in it, or a header."""
    if tag in DROPPED:
        return HARD
    kind = HEADER if tag == "header" else SOFT if tag == "form" else NORMAL
    if not _INTERESTING.search(attributes):
        return kind
    has: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        has.setdefault(name.lower(), html.unescape(a or b or c) if len(a or b or c) < 1000 else a or b or c)
    style = re.sub(r"\s", "", has.get("style", "")).lower()
    if "hidden" in has or has.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return HARD if tag not in ("html", "body") else NORMAL
    if tag in ("html", "body", "main"):
        return NORMAL
    if has.get("role", "").lower() in ROLES:
        return HEADER if has["role"].lower() == "banner" else SOFT
    for name in f"{has.get('class', '')} {has.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        for before, word in zip(["", *words], words, strict=False):
            if before in ABOUT:
                continue
            if word.startswith(COMMENTS) or tag != "article" and (word in NAMES or word.startswith(STARTS)):
                return SOFT
            if word in HEADER_NAMES and tag not in MAIN:
                kind = HEADER
    return kind


class Page:
    """A page's blocks (parent, tag, kind, with parents before children) and its runs of text."""

    def __init__(self, text: str):
        self.parent, self.tag, self.kind, self.main = [-1], ["html"], [NORMAL], [False]
        self.runs: list[tuple[int, bool, bool, str]] = []  # block, in a link, begins a block, text
        self._stack, self._open, self._skipped = [0], {"html": 1}, {}
        self._breaks, self._link = True, -1
        self._read(text)

    def _read(self, text: str) -> None:
        at, size = 0, len(text)
        while at < size:
            found = _TAG.search(text, at)
            if not found:
                self._text(text[at:])
                return
            if found.start() > at:
                self._text(text[at : found.start()])
            close, name, comment = found.groups()
            if comment:
                # `<!-->` and `<!--->` are whole comments
                short = re.compile(r"-?>").match(text, found.end())
                end = short.end() if short else text.find("-->", found.end()) + 3
                at = end if end >= 3 else size
            elif not name:
                at = text.find(">", found.end()) + 1 or size
            else:
                rest = _REST.match(text, found.end())
                if not rest:
                    return  # the page ends within a tag
                at, name = rest.end(), name.lower()
                if close:
                    self._end(name)
                    continue
                self._start(name, rest[1])
                if name in RAW:
                    end = _ENDS[name].search(text, at)
                    if name not in DROPPED:
                        self._text(text[at : end.start() if end else size])
                    at = end.start() if end else size

    def _text(self, text: str) -> None:
        if text:
            self.runs.append((self._stack[-1], self._link >= 0, self._breaks, decoded(text)))
            self._breaks = False

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("br", "hr"):
            self._breaks = True
        if tag in VOID or tag == "html":
            return
        if tag == "body" and "head" in self._open:
            self._close({"head"}, frozenset())
        if tag in BLOCKS:
            self._breaks = True
            self._close({"p"}, BLOCKS - {"p"})
            if tag in HEADINGS and self.tag[self._stack[-1]] in HEADINGS:
                self._pop()
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        elif tag == "a":
            self._link = self._stack[-1]
        kind = _kind(tag, attributes) if attributes.strip() or tag in DROPPED or tag in ("header", "form") else NORMAL
        if tag not in BLOCKS and kind == NORMAL:
            return  # inline: its text is the block's
        if attributes.rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
            return
        if len(self._stack) >= DEPTH:
            self._skipped[tag] = self._skipped.get(tag, 0) + 1
            return
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.kind.append(kind)
        self.main.append(False)
        self._stack.append(len(self.tag) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1
        if tag in ("h1", "main"):  # every block around it has the article in it
            k = self._stack[-1]
            while k >= 0 and not self.main[k]:
                self.main[k] = True
                k = self.parent[k]

    def _pop(self) -> None:
        k = self._stack.pop()
        left = self._open[self.tag[k]] - 1
        if left:
            self._open[self.tag[k]] = left
        else:
            del self._open[self.tag[k]]
        if self._link == k:
            self._link = -1

    def _close(self, tags: set[str], stops: frozenset[str] | set[str]) -> None:
        """Close the innermost of these elements, unless one of `stops` is around the place before it."""
        if not any(t in self._open for t in tags):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in tags:
                while len(self._stack) > depth:
                    self._pop()
                return
            if tag in stops:
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._breaks = True
        if tag == "a":
            self._link = -1
        if self._skipped.get(tag):
            self._skipped[tag] -= 1
        elif tag in ("html", "body"):
            return  # what stands behind belongs to the body
        elif tag in HEADINGS:
            self._close(HEADINGS, BLOCKS - HEADINGS - {"p"})
        else:
            self._close({tag}, (BLOCKS - {tag}) if tag not in BLOCKS else frozenset() if tag in TABLE else {"td", "th", "table"} - {tag})


def _shown(page: Page, roots: set[int]) -> list[int]:
    """For each block: 1 shown, 0 not, 2 its headings only (a header in an article)."""
    shown, article = [], []
    for k, (up, tag, kind) in enumerate(zip(page.parent, page.tag, page.kind, strict=True)):
        above = shown[up] if up >= 0 else 0
        article.append(tag in MAIN or (up >= 0 and article[up]))
        state = 1 if k in roots else above
        if kind == HARD or (kind == SOFT and not page.main[k]):
            state = 0
        elif kind == HEADER and state:
            state = 2 if article[k] and tag not in MAIN else 0
        elif state == 2 and tag in HEADINGS:
            state = 1
        shown.append(state)
    return shown


def _joined(page: Page, shown: list[int]) -> str:
    out, pending = [], False
    for block, _, breaks, text in page.runs:
        pending |= breaks
        if shown[block] == 1:
            if pending:
                out.append(" ")
                pending = False
            out.append(text)
    return " ".join("".join(out).split())


def main_text(source: str | None) -> str:
    """The main text of a page: its blocks in order, white space made one space, joined by one space.

    Null, empty or nothing but what is dropped: empty. Text without any tag is the
    main text itself. A page cut within a tag or comment ends there.
    """
    if not source:
        return ""
    page = Page(source)
    n = len(page.tag)
    live = _shown(page, {0})
    size, links, points = [0] * n, [0] * n, [0.0] * n
    paragraph: list[str] = []
    own = -1

    def count() -> None:
        """The paragraph's points go to the block around it."""
        if own >= 0:
            text = " ".join("".join(paragraph).split())
            if text:
                to = page.parent[own] if page.tag[own] in PARAGRAPHS and own else own
                points[to] += 1 + len(text) / 100 + sum(map(text.count, ",،、，"))

    for block, link, breaks, text in page.runs:
        if live[block] != 1:
            continue
        if breaks or block != own:
            count()
            paragraph.clear()
            own = block
        paragraph.append(text)
        long = len(text.strip())
        size[block] += long
        links[block] += long if link else 0
    count()
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        points[up] += points[k] * DECAY
        size[up] += size[k]
        links[up] += links[k]

    def score(k: int) -> float:
        return points[k] * (1 - links[k] / size[k]) * (SEMANTIC if page.tag[k] in MAIN else 1) if size[k] else 0.0

    able = [k for k in range(n) if live[k] == 1 and (page.tag[k] not in PARAGRAPHS or page.tag[k] in ("td", "blockquote"))]
    best = max(able, key=lambda k: (score(k), -k), default=0)
    k = best
    while k > 0 and page.tag[best] not in MAIN:  # an article is kept whole
        k = page.parent[k]
        if page.tag[k] in MAIN:
            best = k
    least = SIBLING * score(best)
    roots = {best}
    for k in range(1, n) if best else ():
        if page.parent[k] != page.parent[best] or live[k] != 1 or not size[k]:
            continue
        if k != best and score(k) >= least > 0:
            roots.add(k)
        elif page.tag[best] not in MAIN:
            few_links = links[k] < LINKS * size[k]
            roots |= {k} if page.tag[k] == "h1" or page.tag[k] in ("p", "pre", "blockquote") and few_links and size[k] >= PARAGRAPH else set()
    if page.tag[best] in ("html", "body"):  # no container: lists of links are menus
        for k in range(1, n):
            if page.tag[k] in ("ul", "ol", "div", "table") and page.parent[k] == best and size[k] and links[k] > size[k] / 2:
                page.kind[k] = HARD
    return _joined(page, _shown(page, roots))


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (`main_text`), n_chars (its code points): one row for each page, whatever repeats.

    Null html counts as empty; null ids and urls stay null. Empty table: no rows.
    Other columns play no part, whatever their names.
    """
    chosen = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    page_id = chosen.schema["page_id"].dataType
    id_type = to_arrow_type(page_id)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            arrays = [batch.column("page_id").cast(id_type), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return chosen.mapInArrow(extract, f"page_id {page_id.simpleString()}, url string, text string, n_chars long")
