"""Visible text of HTML pages, laid out: block spacing, list markers and aligned table cells.

A page is cut into tags and text, a tree is built with the end tags that HTML implies, and the tree is rendered:
elements that are not shown are skipped (what is only invisible may hold visible parts), inline text flows with white space collapsed, block elements start new lines
(paragraph-like ones with a blank line around), lists get markers and indents, preformatted text is kept, and the cells
of a table, which may span columns and rows, are padded to common column widths. All of this holds at any depth: the tree is walked with a stack of its own.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
# Fixed values of the HTML standard: void elements, raw text elements, implied ends, and default display.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title noscript template iframe object svg math canvas audio video select datalist noembed noframes textarea".split())
BLOCK = frozenset("address article aside body center details dialog dd div dl dt fieldset figcaption figure footer form header html legend li main nav search section summary tr".split())
SPACED = frozenset("blockquote h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
CLOSES_P = (BLOCK | SPACED) - {"html", "body", "tr"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}


_VISIBILITY = re.compile(r"visibility:(visible|hidden|collapse)")
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # that a cell may span, by the standard


class Node:
    __slots__ = ("tag", "shown", "visible", "start", "columns", "rows", "children")

    def __init__(self, tag: str):
        self.tag, self.shown, self.visible, self.start, self.columns, self.rows, self.children = tag, tag not in HIDDEN, True, 1, 1, 1, []

    def read(self, attributes: str) -> None:
        """Take over what attributes say about display, numbering and spans."""
        for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                self.shown = False
            elif name == "style":
                style = re.sub(r"\s+", "", value)
                self.shown &= "display:none" not in style
                for word in _VISIBILITY.findall(style):
                    self.visible = word == "visible"
            elif name == "start" and re.fullmatch(r"-?\d{1,9}", value):
                self.start = int(value)
            elif name == "colspan" and re.fullmatch(r"\d{1,9}", value):
                self.columns = min(max(int(value), 1), MOST_COLUMNS)
            elif name == "rowspan" and re.fullmatch(r"\d{1,9}", value):
                self.rows = min(int(value), MOST_ROWS) or MOST_ROWS  # 0: down to the end


def _cut(stack: list[Node], count: Counter, at: int) -> None:
    count.subtract(node.tag for node in stack[at:])
    del stack[at:]


def _close(stack: list[Node], count: Counter, tags: set, stop: set) -> None:
    """End every open element down to the outermost of ``tags`` above the nearest of ``stop``; ``count`` has the open tags."""
    if not any(count[tag] for tag in tags):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in stop:
            return
        if stack[i].tag in tags:
            outer = i
            while outer > 1 and stack[outer - 1].tag in tags:
                outer -= 1
            _cut(stack, count, outer)
            return


def parse(page: str) -> Node:
    """Tree of a page; text is held as strings among the children."""
    root = Node("html")
    stack, count, at, lower = [root], Counter(), 0, None
    last = page.rfind(">")
    while True:
        m = _TOKEN.search(page, at, last + 1) if at <= last else None  # behind the last end of a tag there is no further tag to look for
        m = m or _OPEN_COMMENT.search(page, at)
        if m is None or m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start() if m else len(page)]))
        if m is None:
            return root
        at = m.end()
        if m.re is _OPEN_COMMENT or m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith(">"):
                at = len(page)  # a comment without an end takes the rest
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if count[tag] else ():
                if stack[i].tag == tag:
                    _cut(stack, count, i)
                    break
                if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                    break
            continue
        if tag in ENDS:
            _close(stack, count, ENDS[tag], SCOPE.get(tag, set()))
        if tag in CLOSES_P:
            _close(stack, count, {"p"}, {"table", "td", "th", "button"})
        node = Node(tag)
        node.visible = stack[-1].visible
        node.read(m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            lower = lower if lower is not None else page.lower()
            end = lower.find("</" + tag, at)
            at = end if end >= 0 else len(page)
        elif tag not in VOID:
            count[tag] += 1
            stack.append(node)  # a slash at its end does not close an HTML element


class _Page:
    """Lines written so far and the inline text of the line at work."""

    def __init__(self):
        self.lines, self.now, self.gap, self.indent, self.marker = [], [], False, "", ""

    def text(self, s: str) -> None:
        self.now.append(s)

    def end_line(self) -> None:
        line = re.sub(r"[ \t\n\r\f]+", " ", "".join(self.now)).strip(" ")
        self.now = []
        if line:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.indent + self.marker + line).rstrip())
        if self.marker:
            self.indent += " " * len(self.marker)
            self.marker = ""

    def space(self) -> None:
        self.end_line()
        self.gap = True


def _walk(first: Iterator) -> None:
    """Run a walk; each walk it yields is run to its end before it goes on."""
    stack = [first]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _render(node: Node, page: _Page, pre: bool = False) -> Iterator:
    for child in node.children:
        if isinstance(child, str):
            if not node.visible:
                continue
            if not pre:
                page.text(child)
                continue
            for i, line in enumerate(child.split("\n")):
                if i:
                    page.put("".join(page.now).rstrip())
                    page.now = []
                page.text(line)
        elif child.shown:
            yield _element(child, page, pre)


def _element(node: Node, page: _Page, pre: bool) -> Iterator:
    tag = node.tag
    if tag == "br":
        if "".join(page.now).strip():
            page.end_line()
        elif not pre:  # a break on an empty line is a blank line; several are one
            page.gap = True
    elif tag == "table":
        page.space()
        yield _table(node, page)
        page.space()
    elif tag in ("ul", "ol", "menu"):
        nested = bool(page.indent or page.marker)
        page.end_line() if nested else page.space()
        number = node.start
        for child in node.children:
            if isinstance(child, str):
                page.text(child if node.visible else "")
            elif child.shown and child.tag == "li":
                page.end_line()
                kept = page.indent
                page.marker = f"{number}. " if tag == "ol" else "- "
                number += 1
                yield _render(child, page)
                page.end_line()
                page.indent, page.marker = kept, ""
            elif child.shown:
                yield _element(child, page, pre)
        page.end_line() if nested else page.space()
    elif tag == "pre":
        page.space()
        yield _render(node, page, True)
        if page.now and "".join(page.now).strip():
            page.put("".join(page.now).rstrip())
        page.now = []
        page.space()
    elif tag in SPACED:
        page.space()
        yield _render(node, page, pre)
        page.space()
    elif tag in BLOCK:
        page.end_line()
        yield _render(node, page, pre)
        page.end_line()
    else:
        yield _render(node, page, pre)


def _rows(node: Node) -> Iterator[Node]:
    rest = node.children[::-1]
    while rest:
        child = rest.pop()
        if isinstance(child, Node) and child.shown:
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                rest += child.children[::-1]


def _table(node: Node, page: _Page) -> Iterator:
    """Cells in their columns, each column as wide as the widest of its own cells, two spaces between; text of the table outside cells
    comes first. A cell that spans columns has the room of all of them, and widens the last where that is too little; below a
    cell that spans rows its place stays empty."""
    for child in node.children:
        if isinstance(child, str):
            page.text(child if node.visible else "")
        elif child.shown and child.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup"):
            yield _element(child, page, False)
    page.end_line()
    rows: list[list[tuple[int, int, str]]] = []  # first column, column after the last, text
    taken: list[tuple[int, int, int]] = []  # first column, column after the last, rows left, of cells from rows above
    for row in _rows(node):
        cells, at, above = [], 0, sorted(taken)
        for child in row.children:
            if isinstance(child, str) or not child.shown:
                if isinstance(child, str) and child.strip() and row.visible:
                    page.text(child)
                continue
            while above and above[0][0] <= at:  # a cell from above stands here
                at = max(at, above.pop(0)[1])
            inner = _Page()
            yield _render(child, inner)
            inner.end_line()
            cells.append((at, at + child.columns, " ".join(x.strip() for x in inner.lines if x)))
            if child.rows > 1:
                taken.append((at, at + child.columns, child.rows))
            at += child.columns
        taken = [(a, e, left - 1) for a, e, left in taken if left > 1]
        rows.append(cells)
    page.end_line()
    for line in _aligned([r for r in rows if any(text for _, _, text in r)]):
        page.put(line)


def _aligned(rows: list[list[tuple[int, int, str]]]) -> Iterator[str]:
    """Lines of a table; columns in which no cell begins take no room."""
    begins = sorted({a for r in rows for a, _, _ in r})
    widths = [0] * len(begins)
    spans = [[(bisect_left(begins, a), bisect_left(begins, e), text) for a, e, text in r] for r in rows]
    for cells in spans:
        for a, e, text in cells:
            if e - a == 1:
                widths[a] = max(widths[a], len(text))
    for cells in spans:
        for a, e, text in cells:
            if e - a > 1:
                widths[e - 1] += max(0, len(text) - sum(widths[a:e]) - 2 * (e - a - 1))
    for cells in spans:
        line, at = [], 0
        for a, e, text in cells:
            line += [" " * w for w in widths[at:a]]
            line.append(text.ljust(sum(widths[a:e]) + 2 * (e - a - 1)))
            at = e
        yield "  ".join(line).rstrip()


def visible_text(page: str | None) -> str:
    """The text a reader sees; empty for null, empty or fully hidden pages."""
    if not page:
        return ""
    out = _Page()
    _walk(_render(parse(page), out))
    out.end_line()
    return "\n".join(out.lines)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text.

    A null or empty page has an empty text; very long pages are read whole, in time that grows with their length (of a table, with its rows times
    the cells that reach down into them). Nulls in page_id or url stay; repeated rows each have a result; an empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([visible_text(p.as_py()) for p in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string")
