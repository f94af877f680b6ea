"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams its events into lines: a line is the text between two block-level tags. A line's
ratio is its characters over its tags. Ratios are smoothed along the page, and lines whose smoothed ratio reaches the
standard deviation of all form the content cluster. Content lines select regions: the articles that hold any, or without
articles the smallest block that holds all of the content. A selected region gives all of its lines, so a short paragraph
between long ones stays. Elements that by their tag, role, class or id are menus, headers, footers, sidebars, notices, adverts,
forms or comments never take part; of an article's own header the heading does. A class or id such as ``has-sidebar`` or
``tag-promo`` tells of something else than the element itself and does not count, and an element that is furniture by its
names, its role or as a form, but holds most of the page's running text, is a wrapper: it stays, and what is in it is judged anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.llm.shared import lean, small_batches

# Element names of the HTML standard by their part here, and the class, id and role words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("script style noscript template nav footer aside button label legend select textarea option iframe object svg canvas head title dialog menu audio video math".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption title""".split())
REGIONS = frozenset("article main".split())
HOLDERS = frozenset("div section td body html center th details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("body html head title td th tr tbody thead tfoot caption".split())
SIBLINGS = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)),
            "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",))}
NOISE_WORDS = frozenset("""ad ads adbox adsense adslot advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion sidebar menu navbar nav
 navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup social share sharing
 related recommended recommendations comment comments commentlist respond reply replies disqus discussion popup modal overlay widget widgets toolbar topbar pagination
 pager login search copyright legal disclaimer skip skiplink teaser outbrain taboola paywall feedback responses guestbook""".split())
NOISE_STEMS = ("advert", "adsense", "adslot", "adunit", "adbanner", "adcontainer", "sponsor", "promo", "cookie", "sidebar", "navbar", "navigation", "breadcrumb",
               "newsletter", "subscri", "recommend", "popup", "paginat", "disqus", "commentlist", "commentform")
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus discussion feedback responses guestbook".split())
# words before a furniture word by which a class tells of the page's build or subject
MODIFIERS = frozenset("has have with without no not is in tag tags category cat topic subject format layout theme type status supports js".split())
HEADER_WORDS = frozenset("header masthead".split())
ARTICLE_WORDS = frozenset("article post entry story content".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNFINISHED = re.compile(r"<[A-Za-z/!?]")
_NAMES = re.compile(r"[A-Za-z0-9]+")
RADIUS = 2


class _Lines(HTMLParser):
    """Collects ``(text, tags, link characters, region, in an article, in a list item, first heading)`` for each line."""

    def __init__(self, wrappers: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.wrappers = wrappers  # start tags, by number, that are no furniture whatever their names
        self.starts = 0
        # furniture by names, role or form: (start tag, enclosing one, of comments, in an article); and [characters, in links, in articles] of each, 0 for the page
        self.boxes: list[tuple[int, int, bool, bool]] = [(0, -1, False, False)]
        self.sizes = [[0, 0, 0]]
        # open elements: (tag, in furniture (-1: by its tag, else a box), in a header (1: of the page, 2: of an article), region, in an article, in a link, list item, heading, h1)
        self.open: list[tuple[str, int, int, int, bool, bool, bool, bool, bool]] = [("", 0, 0, 0, False, False, False, False, False)]
        self.count: dict[str, int] = {}  # open elements by tag
        self.parent = [-1]  # enclosing region of each region
        self.lines: list[tuple[str, int, int, int, bool, bool, bool]] = []
        self.text: list[str] = []
        self.tags = self.links = 0
        self.kind: tuple = (0, False, False, False)

    def _cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.links, *self.kind))
            self.tags = self.links = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        self.starts += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self._cut()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close("p", BLOCKS - {"p"})
        if tag in SIBLINGS:
            for same in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                self._close(same, SIBLINGS[tag])
        _, noise, header, region, inside, link, item, heading, first = self.open[-1]
        if tag in REGIONS or tag in HOLDERS and not inside:
            self.parent.append(region)
            region, inside = len(self.parent) - 1, inside or tag in REGIONS
        if noise >= 0 and (tag in NOISE_TAGS or attrs and self._hidden(attrs)):
            noise = -1
        elif noise >= 0 and (tag == "form" or attrs) and self.starts not in self.wrappers:
            words = self._furniture(tag, attrs)
            if words or tag == "form":
                self.boxes.append((self.starts, noise, bool(words & COMMENT_WORDS), inside))
                self.sizes.append([0, 0, 0])
                noise = len(self.boxes) - 1
        if not header:
            header = 1 if tag == "header" else self._header(tag, attrs) if attrs else 0
            header = 2 if header and inside else header
        self.count[tag] = self.count.get(tag, 0) + 1
        self.open.append((tag, noise, header, region, inside, link or tag == "a", item or tag == "li", heading or tag in HEADINGS, first or tag == "h1"))

    def _header(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in ("html", "body", "main", "article"):
            return 0
        words = {w.lower() for name, value in attrs if value and name in ("class", "id") for w in _NAMES.findall(value) + _PARTS.findall(value)}
        return 0 if not words & HEADER_WORDS else 2 if words & ARTICLE_WORDS else 1

    def _hidden(self, attrs: list[tuple[str, str | None]]) -> bool:
        return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower()
                   for name, value in attrs)

    def _furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
        """The words of role, class and id that make the element furniture."""
        found: set[str] = set()
        for name, value in attrs:
            if not value or tag in ("html", "body", "main"):
                continue
            if name == "role" and value.lower() in NOISE_ROLES:
                found.add(value.lower())
            if name in ("class", "id"):
                for each in value.split():
                    parts = [p.lower() for p in _PARTS.findall(each)]
                    words = [w.lower() for w in _NAMES.findall(each)] + parts
                    first = next((i for i, p in enumerate(parts) if p in MODIFIERS), len(parts))
                    told = set(parts[first + 1:]) - set(parts[:first])
                    found |= {w for w in words if (w in NOISE_WORDS or w.startswith(NOISE_STEMS)) and w not in told}
        return found

    def _close(self, tag: str, within: frozenset[str]) -> None:
        """Close an open ``tag``, and what is open in it, unless an element of ``within`` hides it."""
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                for each in self.open[i:]:
                    self.count[each[0]] -= 1
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._cut()
        self._close(tag, frozenset())

    def handle_data(self, data: str) -> None:
        _, noise, header, region, inside, link, item, heading, first = self.open[-1]
        size = len(data.strip()) if noise >= 0 else 0
        if size:
            sizes = self.sizes[noise]
            sizes[0] += size
            sizes[1] += size if link else 0
            sizes[2] += size if inside else 0
        if noise or header == 1 or header == 2 and not heading:
            return
        if not self.text:
            self.kind = (region, inside, item, first)
        self.text.append(data)
        if link:
            self.links += len(data)


def smooth(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at the ends of the page and normalised."""
    offsets = np.arange(-radius, radius + 1)
    kernel = np.exp(-(offsets**2) / (2.0 * max(radius, 1) ** 2 / 4))
    return np.convolve(values, kernel, "full")[radius:len(values) + radius] / np.convolve(np.ones(len(values)), kernel, "full")[radius:len(values) + radius]


def _wrappers(parser: _Lines) -> frozenset[int]:
    """Start tags of furniture that holds most of the running text, from the outside in."""
    boxes, sizes = parser.boxes, [list(x) for x in parser.sizes]
    inner: list[list[int]] = [[] for _ in boxes]
    for box in range(len(boxes) - 1, 0, -1):
        if not boxes[box][2]:  # readers' comments may be longer than the article
            inner[boxes[box][1]].append(box)
            sizes[boxes[box][1]] = [a + b for a, b in zip(sizes[boxes[box][1]], sizes[box])]
    found, at, articles = set(), 0, 0
    while inner[at]:
        articles += sizes[at][2] - sum(sizes[box][2] for box in inner[at])
        box = max(inner[at], key=lambda b: sizes[b][0])
        (held, linked, in_article), total = sizes[box], sizes[at][0]
        most = 4 * held > 3 * total if articles else 2 * held > total or in_article and 4 * held > total
        if 2 * linked > held or not most or articles and not boxes[box][3]:
            break
        found.add(boxes[box][0])
        at = box
    return frozenset(found)


def _parse(html: str, wrappers: frozenset[int] = frozenset()) -> _Lines:
    parser = _Lines(wrappers)
    # past the last ">" no tag is complete: what looks like the begin of one is dropped, as at a page's end, without trying every "<"
    end = html.rfind(">") + 1
    parser.feed(html[:end])
    parser.close()
    parser.handle_data(unescape(_UNFINISHED.split(html[end:], maxsplit=1)[0]))
    parser._cut()
    return parser


def main_text(html: str) -> str:
    """The main text of one page, a line for each block; empty if there is none."""
    parser = _parse(html)
    wrappers = _wrappers(parser)
    if wrappers:
        parser = _parse(html, wrappers)
    # a list item that is nothing but a link is a menu entry, unless it stands in an article
    lines = [x for x in parser.lines if x[4] or not (x[5] and x[2] >= len(x[0]))]
    if not lines:
        return ""
    ratio = smooth(np.array([len(x[0]) / max(x[1], 1) for x in lines], dtype=float))
    content = ratio >= min(ratio.std(), ratio.max())
    if any(c and x[4] for c, x in zip(content, lines)):  # articles, if they hold content, are all there is
        regions = {x[3] for c, x in zip(content, lines) if c and x[4]}
        return "\n".join(x[0] for x in lines if x[4] and x[3] in regions)
    # regions are numbered from the outside in, so one pass from the last to the first adds each to its parent
    held, parent = [0] * len(parser.parent), parser.parent
    for c, x in zip(content, lines):
        held[x[3]] += len(x[0]) if c else 0
    for region in range(len(parent) - 1, 0, -1):
        held[parent[region]] += held[region]
    chosen = max(region for region, size in enumerate(held) if size == held[0])
    within = [region == chosen for region in range(len(parent))]
    for region in range(chosen + 1, len(parent)):
        within[region] = within[parent[region]]
    at = [i for i, x in enumerate(lines) if within[x[3]]]
    before = [i for i in range(at[0]) if lines[i][6]] if not any(lines[i][6] for i in at) else []  # its heading may stand before it
    return "\n".join(lines[i][0] for i in [*before[-1:], *at])


def extract_text(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``df`` without ``html``, with a column ``text``: the main text of each page.

    NULL, empty and text-free pages give an empty text. A page is parsed whole, by itself, so repeated rows give repeated
    texts; broken markup is read as far as the parser can. A column named ``text`` is replaced. No shuffle; memory follows the
    longest page.
    """
    kept = [c for c in df.columns if c not in (html, text)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                pages = part.column(html)
                texts = pa.array([main_text(p.as_py() or "") for p in pages], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], texts], names=[*kept, text])

    return small_batches(df.select(*kept, html)).mapInArrow(lean(run), schema)
