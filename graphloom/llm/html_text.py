"""Layout-aware text of HTML pages.

A tree builder reads tags with their implied starts and ends (paragraphs end before
blocks, list items and table parts end each other, cells imply rows), and a renderer
emits all visible text: blocks on lines of their own with blank lines around the ones
that have margins, list items with markers and indentation, preformatted text as it
stands, and table cells aligned in columns. Nothing visible is left out as boilerplate.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never shown.
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title desc metadata annotation annotation-xml meta link base param source track area".split())
#: Blocks, and the ones with a blank line around them.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
MARGIN = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html option optgroup tbody td tfoot th thead tr".split())
#: A start tag ends the nearest open element of these, unless one of the bounds stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "h1": ({"h1", "h2", "h3", "h4", "h5", "h6"}, BLOCK),
    "body": ({"head"}, set()),
}
#: Where text can't stand.
TABLE_PARTS = frozenset("table tbody thead tfoot tr colgroup".split())
#: Input elements whose value is shown as it is.
BUTTONS = frozenset("submit reset button".split())
#: Columns are padded up to this width; longer cells stick out.
WIDEST = 60

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        """An attribute's value, '' without one, None if it is not there."""
        if name not in self.attrs.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def parse(source: str) -> tuple[Node, int]:
    """The tree of a page, and its depth."""
    root = Node("#root")
    stack = [root]
    deepest = 1
    open_now: Counter[str] = Counter()

    def pop_to(i: int) -> None:
        open_now.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def close(tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        if not any(open_now[t] > 0 for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                pop_to(i)
                return
            if stack[i].tag in bounds:
                return

    def open_(tag: str, attrs: str) -> None:
        nonlocal deepest
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            open_now[tag] += 1
            deepest = max(deepest, len(stack))

    def text_(text: str) -> None:
        if stack[-1].tag in TABLE_PARTS and not text.isspace():  # shown before the table
            i = max(n for n, node in enumerate(stack) if node.tag in ("table", "#root"))
            if stack[i].tag == "table":
                parent = stack[i - 1].children
                at = len(parent) - 1 - next((k for k, c in enumerate(reversed(parent)) if c is stack[i]), -1)
                parent.insert(at, text)
                return
        stack[-1].children.append(text)

    at = 0
    while True:
        m = _TOKEN.search(source, at)
        end = m.start() if m else len(source)
        if end > at:
            text_(html.unescape(source[at:end]) if "&" in source[at:end] else source[at:end])
        if not m:
            return root, deepest
        at = m.end()
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            if tag == "p" and not open_now["p"]:
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in VOID:
                close({tag}, set() if tag in ("table", "body", "html") else {"table"} if tag in BLOCK else {"table", "td", "th", "li", "div", "section", "article"})
            continue
        if tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag[0] == "h" and tag in MARGIN and len(tag) == 2 and tag != "hr":
            close(*ENDS["h1"]) if stack[-1].tag in ENDS["h1"][0] else None
        elif tag in ENDS:
            close(*ENDS[tag])
        if tag in ("tbody", "thead", "tfoot"):
            close({"tr"}, {"table"})
            close(*ENDS[tag])
        if tag == "tr":
            close({"caption"}, {"table"})
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            open_("tr", "")
        if tag not in VOID and tag in BLOCK | {"span", "a", "b", "i"} and stack[-1].tag == "head" and tag != "body":
            pop_to(len(stack) - 1)
        if attrs.endswith("/") and tag in ("svg", "math"):
            continue
        open_(tag, attrs)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            end = stop.start() if stop else len(source)
            if end > at:
                text = source[at:end]
                stack[-1].children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = (source.find(">", end) + 1 or len(source)) if stop else len(source)
            pop_to(len(stack) - 1)


class _Lines:
    """Lines under construction: inline text waits until its block ends."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0
        self.indent = ""
        self.marker = ""

    def add(self, text: str, pre: bool) -> None:
        if pre:
            self.inline.append(text.replace("\r\n", "\n").replace("\t", "    ").replace(" ", "\x01"))
        else:
            self.inline.append(_SPACES.sub(" ", text))

    def flush(self) -> None:
        if not self.inline:
            return
        for line in "".join(self.inline).split("\n"):
            line = re.sub(" +", " ", line).strip(" ").replace("\x01", " ").rstrip()
            self.put(line, len(self.inline) > 1)
        self.inline = []

    def put(self, line: str, may_be_empty: bool = False) -> None:
        if not line and not (may_be_empty and self.lines and not self.gap):
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append(f"{self.indent[: len(self.indent) - len(self.marker)]}{self.marker}{line}".rstrip() if self.marker else f"{self.indent}{line}".rstrip())
        self.marker = ""

    def block(self, margin: bool) -> None:
        self.flush()
        if margin:
            self.gap = 1

    def text(self) -> str:
        self.flush()
        out = "\n".join(self.lines)
        return re.sub(r"\n{3,}", "\n\n", out).strip("\n")


def _render(node: Node, out: _Lines, shown: bool, pre: bool, depth: int) -> None:
    number = None
    if node.tag == "ol":
        start = node.get("start") or "1"
        number = int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1
    only_summary = node.tag == "details" and node.get("open") is None
    for child in node.children:
        if isinstance(child, str):
            if shown and not only_summary and (pre or not child.isspace() or node.tag not in ("table", "tbody", "tr", "ul", "ol")):
                out.add(child, pre)
            continue
        tag = child.tag
        if tag == "br":
            if shown:
                out.inline.append("\n")
            continue
        if tag in HIDDEN or (only_summary and tag != "summary"):
            continue
        visible = shown
        if child.attrs:
            if child.get("hidden") is not None or (tag == "dialog" and child.get("open") is None):
                continue
            style = child.get("style")
            if style:
                if _NONE.search(style):
                    continue
                found = _VISIBILITY.search(style)
                visible = found[1].lower() == "visible" if found else shown
        elif tag == "dialog":
            continue
        if tag == "input":
            kind = (child.get("type") or "").lower()
            if visible and kind in BUTTONS:
                out.add(child.get("value") or ("" if kind == "button" else kind.capitalize()), False)
            continue
        if tag == "table":
            out.block(True)
            for line in _table(child, visible, depth):
                out.put(line)
            out.block(True)
            continue
        if tag == "hr":
            out.block(True)
            out.put("---")
            out.block(True)
            continue
        block, margin = tag in BLOCK, tag in MARGIN
        if tag in ("ul", "ol", "menu") and depth:
            margin = False
        if block:
            out.block(margin)
        if tag in ("li", "dd", "blockquote"):
            marker = "> " if tag == "blockquote" else "  "
            if tag == "li":
                marker = "- "
                if number is not None:
                    value = child.get("value")
                    number = int(value) if value and value.lstrip("-").isdigit() and len(value) < 10 else number
                    marker, number = f"{number}. ", number + 1
            before = out.indent
            out.indent = before + (" " * len(marker) if tag != "blockquote" else marker)
            out.marker = marker if tag == "li" else ""
            _render(child, out, visible, pre, depth + (tag == "li"))
            out.flush()
            out.indent, out.marker = before, ""
        else:
            _render(child, out, visible, pre or tag in ("pre", "textarea", "xmp"), depth)
        if block:
            out.block(margin)
        elif tag in ("td", "th"):
            out.add(" ", False)


def _shown(node: Node, shown: bool) -> bool | None:
    """Whether a part of a table is visible; None where it takes no place either."""
    if node.tag in HIDDEN:
        return None
    if not node.attrs:
        return shown
    style = node.get("style") or ""
    if node.get("hidden") is not None or _NONE.search(style):
        return None
    found = _VISIBILITY.search(style)
    return found[1].lower() == "visible" if found else shown


def _rows(node: Node, shown: bool) -> list[tuple[Node, bool]]:
    out, wait = [], [(child, shown) for child in reversed(node.children)]
    while wait:
        child, outer = wait.pop()
        visible = _shown(child, outer) if isinstance(child, Node) else None
        if visible is None or child.tag in ("col", "colgroup"):
            continue
        if child.tag in ("tbody", "thead", "tfoot"):
            wait += [(c, visible) for c in reversed(child.children)]
        else:
            out.append((child, visible))
    return out


def _span(cell: Node, name: str) -> int:
    value = cell.get(name) or "1"
    return min(int(value), 1000) if value.isdigit() and len(value) < 6 and int(value) else 1


def _table(table: Node, shown: bool, depth: int) -> list[str]:
    """Lines of a table; cells of a column start at the same place.

    A cell that spans rows keeps its columns free in the rows below, one that spans
    columns widens the last of them where its text needs it.
    """
    grid: list[list[tuple[list[str], int, int]] | list[str]] = []
    taken: dict[int, int] = {}
    for row, visible in _rows(table, shown):
        if row.tag != "tr":
            own = _Lines()
            _render(row, own, visible, False, depth)
            grid.append(own.text().split("\n"))
            continue
        cells, at, down = [], 0, {}
        for cell in row.children:
            seen = _shown(cell, visible) if isinstance(cell, Node) else None
            if seen is None:
                continue
            own = _Lines()
            wrap = Node("#cell")
            wrap.children = [cell] if cell.tag not in ("td", "th") else cell.children
            _render(wrap, own, seen, False, 0)
            while taken.get(at, 0) > 0:
                at += 1
            width, rows = _span(cell, "colspan"), _span(cell, "rowspan")
            cells.append(([x for x in own.text().split("\n") if x] or [""], at, width))
            if rows > 1:
                down.update({at + k: rows - 1 for k in range(width)})
            at += width
        taken = {k: n - 1 for k, n in taken.items() if n > 1} | down
        grid.append(cells)
    widths: dict[int, int] = {}
    cells = [c for row in grid for c in row if isinstance(c, tuple)]
    for text, at, span in sorted(cells, key=lambda c: c[2]):
        need = max(min(len(x), WIDEST) for x in text) - 2 * (span - 1) - sum(widths.get(at + k, 0) for k in range(span - 1))
        widths[at + span - 1] = max(widths.get(at + span - 1, 0), need)
    place = [0]
    for k in range(max((at + span for _, at, span in cells), default=0)):
        place.append(place[-1] + widths.get(k, 0) + 2)
    lines = []
    for row in grid:
        if row and isinstance(row[0], str):
            lines += row
            continue
        for n in range(max((len(c[0]) for c in row), default=0)):
            line = ""
            for text, at, _ in row:
                if n < len(text):
                    line = (line.ljust(place[at]) if len(line) < place[at] else line + "  " * bool(line)) + text[n]
            lines.append(line.rstrip())
    return lines


def to_text(source: str | None) -> str:
    """The visible text of a page."""
    out = _Lines()
    tree, depth = parse(source or "")
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 4 * depth + 1000))  # frames of Python functions are on the heap
    try:
        _render(tree, out, True, False, 0)
        return out.text()
    finally:
        sys.setrecursionlimit(limit)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            texts = [to_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, text, n_chars.

    A null or empty page has an empty text. Markup that is broken (unclosed or stray
    tags, quotes without end) is read as text or closed where it ends; nothing raises.
    Other columns are ignored; repeated rows are each rendered.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, text string, n_chars long")
