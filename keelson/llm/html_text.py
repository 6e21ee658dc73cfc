"""Layout-aware text of HTML pages.

A tree builder applies the implied end tags of lists, paragraphs, options and tables and moves
stray content out in front of its table. Visibility rules drop what a browser wouldn't show, and only that.
The renderer keeps the spacing of blocks, list markers and indents, preformatted text, and lays
table cells out in aligned columns.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import extended, shielded, ship, slices, table

_set = lambda words: frozenset(words.split())
#: Classes of elements.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style xmp iframe noembed noframes noscript textarea title plaintext")
UNSEEN = _set("script style title template noscript noembed noframes iframe head meta link base object canvas audio video datalist param source track")
SPACED = _set("p h1 h2 h3 h4 h5 h6 blockquote ul ol menu dir dl table pre xmp plaintext hr figure fieldset listing")
LINED = _set("div section article aside nav header footer main address form li dt dd tr td th caption thead tbody tfoot details summary figcaption legend center body html hgroup search option optgroup dialog")
CLOSES_P = SPACED | _set("div section article aside nav header footer main address form details summary figcaption center hgroup search li dd dt dialog")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
ROWS = _set("thead tbody tfoot")
TABLE_PARTS = _set("table thead tbody tfoot tr")
TABLE_CHILDREN = _set("caption colgroup col thead tbody tfoot tr td th script style template")
WALL = _set("table td th caption template object marquee")
PRE = _set("pre xmp plaintext listing textarea")
FORMATS = _set("a b big code em font i nobr s small strike strong tt u")

# a quote opens a value only directly after `=`; anywhere else it is a character like others
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
MAY_HIDE = re.compile("hidden|style", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")
DEPTH = 512  # deeper elements become siblings, as in browsers
DEEPEST = 2048  # the same for elements that hide what they hold, and for parts of tables


class Node:
    __slots__ = ("children", "raw", "tag")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.children = tag, raw, []

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, *values in ATTRIBUTE.findall(self.raw):
            out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
        return out


class Builder:
    """The tree of a page; `stack` holds the open elements, the root first."""

    def __init__(self, source: str):
        self.stack = [Node("#root")]
        self.root = self.stack[0]
        self._read(source)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            start = source.find("<", at)
            if start < 0:
                self.text(source[at:])
                return
            if start > at:
                self.text(source[at:start])
            at = self._markup(source, start)

    def _markup(self, source: str, start: int) -> int:
        """Handle what begins with `<` at start; returns where to go on."""
        after = source[start + 1 : start + 2]
        if after == "!" or after == "?":
            if source.startswith("<!--", start):
                end = source.find("-->", start + 2)
                return len(source) if end < 0 else end + 3
            end = source.find(">", start)
            return len(source) if end < 0 else end + 1
        if not (after.isascii() and after.isalpha()) and not re.match(r"</[a-zA-Z]", source[start : start + 3]):
            if after == "/":  # a bogus comment, or nothing at all
                end = source.find(">", start)
                if end >= 0:
                    return end + 1
            self.text("<")
            return start + 1
        m = TAG.match(source, start)
        if m:
            closing, tag, raw, end = m[1], m[2].lower(), m[3], m.end()
        else:  # a quote that never ends: the tag ends at the next `>`, or with the page
            end = source.find(">", start) + 1
            if not end:
                return len(source)
            inner = re.match(r"<(/?)([a-zA-Z][^\s/>]*)(.*)", source[start : end - 1], re.S)
            closing, tag, raw = inner[1], inner[2].lower(), inner[3]
        if closing:
            self.close(tag)
            return end
        self.open(tag, raw)
        if tag not in RAW:
            return end
        stop = None if tag == "plaintext" else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, end)
        inside = source[end : stop.start() if stop else len(source)]
        if tag not in UNSEEN and inside:
            self.stack[-1].children.append(html.unescape(inside) if tag == "textarea" else inside)
        self.close(tag)
        return stop.end() if stop else len(source)

    def find(self, tags: frozenset[str], walls: frozenset[str]) -> int:
        """Index of the nearest open element of these tags that isn't behind a wall, or 0."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in walls:
                return 0
        return 0

    def pop(self, index: int) -> None:
        if index > 0:
            del self.stack[index:]

    def put(self, child) -> None:
        """Append to the open element; in front of the table where a table can't hold it."""
        top = self.stack[-1]
        if top.tag in TABLE_PARTS and not (isinstance(child, Node) and child.tag in TABLE_CHILDREN):
            if isinstance(child, str) and not child.strip(" \t\n\r\f"):
                return
            i = self.find(frozenset(("table",)), frozenset())
            while self.stack[i - 1].tag in TABLE_PARTS:
                i -= 1
            among, outer = self.stack[i - 1].children, self.stack[i]
            among.insert(next((k for k in range(len(among) - 1, -1, -1) if among[k] is outer), len(among)), child)
        else:
            top.children.append(child)

    def text(self, raw: str) -> None:
        self.put(html.unescape(raw) if "&" in raw else raw)

    def open(self, tag: str, raw: str) -> None:
        if tag in ("html", "body", "head"):
            return
        one = lambda *tags: frozenset(tags)
        if tag in CLOSES_P:
            self.pop(self.find(one("p"), WALL | {"button"}))
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        elif tag == "li":
            self.pop(self.find(one("li"), WALL | {"ul", "ol", "menu", "dir"}))
        elif tag in ("dt", "dd"):
            self.pop(self.find(one("dt", "dd"), WALL | {"dl"}))
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.stack[-1].tag == "optgroup":
                self.stack.pop()
        elif tag == "a":
            self.pop(self.find(one("a"), WALL))
        elif tag in ("caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"):
            inside = self.find(one("table"), one("template"))
            if not inside:
                return
            keep = one("table") if tag in ("caption", "colgroup") or tag in ROWS else one("table") | ROWS if tag == "tr" else TABLE_PARTS
            del self.stack[max(i for i, n in enumerate(self.stack) if i >= inside and n.tag in keep) + 1 :]
            if tag in ("td", "th") and self.stack[-1].tag != "tr":
                self.push(Node("tr"))
        node = Node(tag, raw)
        if tag in VOID:
            self.put(node)
        else:
            self.push(node)

    def push(self, node: Node) -> None:
        self.put(node)
        if len(self.stack) < DEPTH or (len(self.stack) < DEEPEST and (node.tag in UNSEEN or node.tag in TABLE_CHILDREN or node.tag == "table" or MAY_HIDE.search(node.raw))):
            self.stack.append(node)

    def close(self, tag: str) -> None:
        if tag == "br":
            self.put(Node("br"))
        elif tag in HEADINGS:
            self.pop(self.find(HEADINGS, WALL))
        elif tag in FORMATS:  # what was opened inside stays open
            if i := self.find(frozenset((tag,)), WALL):
                del self.stack[i]
        else:
            self.pop(self.find(frozenset((tag,)), frozenset(("table", "template")) - {tag} if tag in TABLE_CHILDREN or tag == "table" else WALL - {tag}))


class Page:
    """Lines of text under construction; gap is the line breaks due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.blank, self.indent, self.marker = 0, False, "", ""

    def block(self, gap: int) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts = []
        self.blank = False
        self.gap = max(self.gap, gap)

    def _begin(self) -> None:
        if not self.parts:
            if self.gap == 2 and self.lines:
                self.lines.append("")
            self.gap = 0
            self.parts.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker)
            self.marker = ""
            self.blank = False

    def words(self, text: str) -> None:
        text = BLANKS.sub(" ", text)
        if text == " " or not text:
            self.blank = self.blank or (text == " " and bool(self.parts))
            return
        lead = bool(self.parts) and (self.blank or text[0] == " ")
        self._begin()
        if lead:
            self.parts.append(" ")
        self.parts.append(text.strip(" "))
        self.blank = text[-1] == " "

    def verbatim(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.newline()
            if line:
                self._begin()
                self.parts.append(line)

    def newline(self) -> None:
        if self.parts:
            self.block(0)
        elif self.lines or self.gap == 0:
            self._begin()
            self.block(0)

    def result(self) -> list[str]:
        self.block(0)
        return self.lines


def _style(node: Node) -> dict[str, str]:
    if "style" not in node.raw.lower():
        return {}
    pairs = (x.partition(":") for x in node.attributes().get("style", "").lower().split(";"))
    return {k.strip(): v.replace("!important", "").strip() for k, _, v in pairs}


class Renderer:
    def __init__(self, root: Node):
        self.page = Page()
        self.inside(root, False, False, [])

    def inside(self, node: Node, pre: bool, hidden: bool, lists: list) -> None:
        page = self.page
        for child in node.children:
            if isinstance(child, str):
                if not hidden:
                    page.verbatim(child) if pre else page.words(child)
            else:
                self.element(child, pre, hidden, lists)

    def element(self, node: Node, pre: bool, hidden: bool, lists: list) -> None:
        tag, raw, page = node.tag, node.raw, self.page
        if tag in UNSEEN:
            return
        shown = None
        if raw and MAY_HIDE.search(raw):
            style = _style(node)
            shown = style.get("display")
            if shown == "none" or (not shown and "hidden" in node.attributes()):
                return
            if (seen := style.get("visibility")) is not None:
                hidden = seen in ("hidden", "collapse")
            if style.get("white-space", "").startswith("pre"):
                pre = True
        if tag == "br":
            if not hidden:
                page.newline()
            return
        if tag == "dialog" and "open" not in node.attributes():
            return
        gap = 2 if tag in SPACED else 1 if tag in LINED or shown == "block" else 0
        if shown == "inline":
            gap = 0
        if gap:
            page.block(min(gap, 1) if lists and tag in ("ul", "ol", "menu", "dir") else gap)
        if tag == "table" and not hidden:
            self.table(node, lists)
        elif tag == "details" and "open" not in node.attributes():
            part = Node(tag)
            part.children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
            self.inside(part, pre, hidden, lists)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.inside(node, pre, hidden, [*lists, self.counter(node)])
        elif tag == "li":
            self.item(node, pre, hidden, lists)
        elif tag in ("dd", "blockquote"):
            self.indented(node, pre, hidden, lists, "  ", "")
        elif tag in PRE:
            if node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\n")
            self.inside(node, True, hidden, lists)
        elif tag == "hr":
            if not hidden:
                page.words("---")
        else:
            self.inside(node, pre, hidden, lists)
        if gap:
            page.block(min(gap, 1) if lists and tag in ("ul", "ol", "menu", "dir") else gap)

    @staticmethod
    def counter(node: Node) -> list | None:
        """The next number and the step of a numbered list; None for bullets."""
        if node.tag != "ol":
            return None
        known = node.attributes()
        step = -1 if "reversed" in known else 1
        first = sum(1 for c in node.children if isinstance(c, Node) and c.tag == "li") if step < 0 else 1
        return [int(known["start"]) if re.fullmatch(r"[+-]?\d{1,9}", known.get("start", "")) else first, step]

    def item(self, node: Node, pre: bool, hidden: bool, lists: list) -> None:
        marker = "- "
        if lists and lists[-1]:
            given = node.attributes().get("value", "")
            if re.fullmatch(r"[+-]?\d{1,9}", given):
                lists[-1][0] = int(given)
            marker = f"{lists[-1][0]}. "
            lists[-1][0] += lists[-1][1]
        self.indented(node, pre, hidden, lists, " " * len(marker), marker)

    def indented(self, node: Node, pre: bool, hidden: bool, lists: list, by: str, marker: str) -> None:
        page = self.page
        was, held = page.indent, page.marker
        page.indent, page.marker = was + by, held + marker if held else marker
        self.inside(node, pre, hidden, lists)
        page.block(0)
        page.indent, page.marker = was, ""

    def table(self, node: Node, lists: list) -> None:
        """Rows of aligned cells; a cell's further lines stand below its first. Captions come first."""
        rows, captions = [], []
        stack = list(reversed(node.children))
        while stack:
            c = stack.pop()
            if not isinstance(c, Node) or self.unseen(c):
                continue
            if c.tag in ROWS:
                stack.extend(reversed(c.children))
            elif c.tag == "tr":
                rows.append([x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th") and not self.unseen(x)])
            elif c.tag == "caption":
                captions.append(c)
        for c in captions:
            self.element(c, False, False, lists)
        grid: dict[tuple[int, int], list[str]] = {}
        taken: dict[int, int] = {}  # rows below for which a column is held by a cell above
        spans: list[tuple[int, int, int]] = []
        width: dict[int, int] = {}
        for r, row in enumerate(rows):
            col = 0
            for cell in row:
                while taken.get(col, 0) > r:
                    col += 1
                known = cell.attributes() if cell.raw else {}
                across, down = (min(int(x), 1000) if (x := known.get(k, "1")).isdigit() and len(x) < 9 and int(x) else 1 for k in ("colspan", "rowspan"))
                grid[r, col] = lines = self.cell(cell)
                size = max(map(len, lines), default=0)
                if across == 1:
                    width[col] = max(width.get(col, 0), size)
                else:
                    spans.append((col, across, size))
                    for k in range(col, col + across):
                        width.setdefault(k, 0)
                for k in range(col, col + across):
                    taken[k] = r + down
                col += across
        for col, across, size in spans:
            lack = size - sum(width[k] + 2 for k in range(col, col + across)) + 2
            if lack > 0:
                width[col + across - 1] += lack
        left, at = {}, 0
        for k in range(max(width, default=-1) + 1):
            left[k] = at
            at += width.get(k, 0) + 2
        page = self.page
        by_row: dict[int, list[int]] = {}
        for r, c in sorted(grid):
            by_row.setdefault(r, []).append(c)
        for r, cols in by_row.items():
            for i in range(max(len(grid[r, c]) for c in cols)):
                line = ""
                for c in cols:
                    if i < len(grid[r, c]):
                        line = line.ljust(left[c]) + grid[r, c][i]
                page.block(1)
                page.verbatim(line.rstrip(" "))

    @staticmethod
    def unseen(node: Node) -> bool:
        if node.tag in UNSEEN:
            return True
        if not node.raw:
            return False
        shown = _style(node).get("display")
        return shown == "none" or (not shown and "hidden" in node.raw.lower() and "hidden" in node.attributes())

    def cell(self, node: Node) -> list[str]:
        outer, self.page = self.page, Page()
        style = _style(node)
        self.inside(node, False, style.get("visibility") in ("hidden", "collapse"), [])
        lines = self.page.result()
        self.page = outer
        return lines


def render(source: str | None) -> str:
    """The visible text of a page; empty for a null or empty one."""
    if not source:
        return ""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))
    return "\n".join(Renderer(Builder(source).root).page.result())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html", 8_000_000):
            yield part.drop_columns(["html"]).append_column("__text", pa.array([render(x) for x in part.column("html").to_pylist()], pa.string()))


@shielded
def extract(pages: DataFrame) -> DataFrame:
    """pages (html and any other columns) with __text in place of html. Every row gives one; rows that repeat give repeats. Other names are as common.shielded says."""
    ship(pages.sparkSession)
    return pages.mapInArrow(_extract, extended(pages, "__text string", ("html",)))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))
