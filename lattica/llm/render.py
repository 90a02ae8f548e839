"""Layout-aware rendering of HTML: a tree builder with implied tags and visibility rules, then text with block spacing, lists and aligned table cells."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
HIDDEN = frozenset("area audio base canvas datalist embed head iframe link meta noembed noframes noscript object param script source style template title track video".split())
CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "li", "legend"}
#: An opening tag ends these open elements, up to the first of the bounds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"caption"}, {"table"}),
}
SPACES = re.compile(r"[ \t\n\r\f]+")
NO_BOX = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: Tables within so many others are laid out as blocks.
MOST_TABLES = 12


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(HTMLParser):
    """Builds a tree of Nodes and strings; stray end tags are ignored, open elements end with the input."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.depth: Counter = Counter()  # open elements by tag, so that a search for one that isn't open costs nothing

    def cut(self, at: int) -> None:
        self.depth.subtract(n.tag for n in self.open[at:])
        del self.open[at:]

    def end_until(self, tags: set, bounds: set) -> None:
        if not any(self.depth[t] > 0 for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in bounds:
                return
            if tag in tags:
                cut, left = i, sum(self.depth[t] for t in tags) - 1
                for j in range(i - 1, 0, -1):
                    if left <= 0 or self.open[j].tag in bounds:
                        break
                    if self.open[j].tag in tags:
                        cut, left = j, left - 1
                self.cut(cut)
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in IMPLIED:
            self.end_until(*IMPLIED[tag])
        elif tag == "body":
            self.end_until({"head"}, set())
        if tag in CLOSES_P:
            self.end_until({"p"}, {"button", "td", "th", "caption"})
        if tag not in IN_HEAD and self.open[-1].tag == "head":
            self.cut(len(self.open) - 1)
        top = self.open[-1].tag
        if tag in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
            self.begin("tr", {})
        elif top == "colgroup" and tag != "col":
            self.cut(len(self.open) - 1)
        self.begin(tag, dict(attrs))

    def begin(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.depth[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if self.depth[tag] <= 0:
            return
        bounds = set() if tag in ("table", "body", "html") else {"td", "th", "table"} - {tag}
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.cut(i)
                return
            if self.open[i].tag in bounds:
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.cut(len(self.open) - 1)
        self.open[-1].children.append(data)


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in HIDDEN or "hidden" in a or (a.get("aria-hidden") or "").strip().lower() == "true" or (node.tag == "input" and (a.get("type") or "").lower() == "hidden") or bool(NO_BOX.search(a.get("style") or ""))


def number(value: str | None, most: int) -> int:
    """A positive attribute number within a bound; anything else is 1."""
    value = (value or "").strip()
    return max(1, min(most, int(value[:9]))) if value.isascii() and value.isdigit() else 1


def unseen(node: Node, was: bool) -> bool:
    """Whether text directly in a node is invisible; children inherit it and can be visible again."""
    found = VISIBILITY.search(node.attrs.get("style") or "")
    return found[1].lower() != "visible" if found else was


def width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines of text; runs of spaces collapse within a line, and margins between blocks don't add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.lead, self.indent = "", 0, "", 0

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.split("\n")
            self.put(first)
            for part in rest:
                self.newline(True)
                self.put(part)
            return
        data = SPACES.sub(" ", data)
        if not self.line or self.line.endswith(" "):
            data = data.lstrip(" ")
        self.put(data)

    def put(self, data: str) -> None:
        self.line += data

    def newline(self, keep: bool = False) -> None:
        line = self.line.rstrip(" ")
        self.line = ""
        if line or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            pad = " " * self.indent
            self.lines.append((pad[: len(pad) - len(self.lead)] + self.lead + line).rstrip(" ") if line else "")
            if line:
                self.lead = ""

    def block(self, spaced: bool) -> None:
        self.newline()
        self.gap = max(self.gap, int(spaced))


def table_rows(node: Node) -> tuple[list, list]:
    """What stands before the table (captions and misplaced content), and rows of cells, those of nested tables left to their cells."""
    before, rows = [], []
    # forms are no boxes of their own within a table: their children are the table's
    todo = [(c, None) for c in reversed(node.children)]
    while todo:
        child, row = todo.pop()
        if isinstance(child, str):
            if child.strip():
                before.append(child)
        elif hidden(child):
            continue
        elif child.tag == "tr" and row is None:
            rows.append(new := [])
            todo += [(c, new) for c in reversed(child.children)]
        elif child.tag in ("td", "th"):
            if row is None:
                rows.append(row := [])
            row.append(child)
        elif child.tag in SECTIONS or child.tag == "form":
            todo += [(c, row) for c in reversed(child.children)]
        elif child.tag not in ("col", "colgroup"):
            before.append(child)
    return before, rows


def grid(rows: list) -> list:
    """Cells with their columns: (column, columns, cell) by row; a cell with a rowspan keeps its columns in the rows below."""
    out, taken = [], {}
    for r, row in enumerate(rows):
        at, placed = 0, []
        for c in row:
            while taken.get(at, 0) > r:
                at += 1
            wide, high = number(c.attrs.get("colspan"), 1000), number(c.attrs.get("rowspan"), 65534)
            placed.append((at, wide, c))
            if high > 1:
                taken.update({at + i: r + high for i in range(wide)})
            at += wide
        out.append(placed)
    return out


def draw_table(page: Page, node: Node, dark: bool, tables: int) -> None:
    before, rows = table_rows(node)
    page.block(True)
    for c in before:
        page.newline()
        if isinstance(c, str):
            if not dark:
                page.text(c, False)
        else:
            walk(page, c, False, dark, tables)
        page.newline()
    drawn = [[(at, n, render_node(c, dark, tables).split("\n")) for at, n, c in row] for row in grid(rows)]
    widths: list[int] = []
    for row in drawn:
        for at, n, lines in row:
            widths += [0] * (at + 1 - len(widths))
            if n == 1:
                widths[at] = max(widths[at], max(map(width, lines)))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2 * (w > 0))
    for row in drawn:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            page.newline()
            out, reached = "", 0
            for at, _, lines in row:
                cell = lines[k] if k < len(lines) else ""
                if cell:
                    gap = starts[min(at, len(widths))] - reached
                    pad = max(gap, 2) if out else max(gap, 0)
                    out += " " * pad + cell
                    reached += pad + width(cell)
            page.put(out.rstrip(" "))
        page.newline()
    page.block(True)


def walk(page: Page, node: Node, pre: bool, dark: bool = False, tables: int = 0) -> None:
    """Depth first with a stack of its own: deep pages don't reach Python's limit. Beyond MOST_TABLES, nested tables are blocks."""
    stack: list = [("in", node, pre, None, dark)]
    counters: list = []
    while stack:
        what, n, pre, old, dark = stack.pop()
        if what == "out":
            if n.tag in ("ul", "ol", "menu"):
                counters.pop()
            if n.tag in BLOCK:
                page.block(n.tag in SPACED and not (n.tag in ("ul", "ol") and len(counters)))
            if old is not None:
                page.indent = old
            continue
        if isinstance(n, str):
            if not dark:
                page.text(n, pre)
            continue
        if n is not node and hidden(n):
            continue
        dark = unseen(n, dark)
        if n.tag == "br":
            page.newline(True)
            continue
        if n.tag == "table" and n is not node and tables < MOST_TABLES:
            draw_table(page, n, dark, tables + 1)
            continue
        if n.tag in ("tr", "td", "th", "caption") and n is not node:
            page.newline()
        if n.tag == "img" and n.attrs.get("alt") and not dark:
            page.text(n.attrs["alt"], False)
        old = None
        if n.tag in BLOCK and n is not node:
            page.block(n.tag in SPACED and not (n.tag in ("ul", "ol") and len(counters)))
        if n.tag in ("ul", "ol", "menu"):
            counters.append([n.tag == "ol", 0 if n.attrs.get("start") == "0" else number(n.attrs.get("start"), 10**9)])
        elif n.tag == "li":
            mark = "- "
            if counters and counters[-1][0]:
                mark = f"{counters[-1][1]}. "
                counters[-1][1] += 1
            old = page.indent
            page.indent, page.lead = old + len(mark), mark
        elif n.tag in ("dd", "blockquote"):
            old = page.indent
            page.indent = old + 2
        stack.append(("out", n, pre, old, dark))
        stack.extend(("in", c, pre or n.tag in ("pre", "textarea"), None, dark) for c in reversed(n.children))


def render_node(node: Node, dark: bool = False, tables: int = 0) -> str:
    page = Page()
    walk(page, node, False, dark, tables)
    page.newline()
    return "\n".join(page.lines).strip("\n")


def render(html: str | None) -> str:
    """All visible text of a page; null and empty pages give the empty text."""
    if not html:
        return ""
    builder = Builder()
    builder.feed(html)
    builder.close()
    return render_node(builder.root)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) for every row of (page_id, html); other columns are ignored, an empty table gives none."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([render(h) for h in b.column("html").to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, text) of every page; see render."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
