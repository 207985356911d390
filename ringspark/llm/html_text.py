"""Layout-aware HTML text: a small tree builder with implied tags, visibility rules, and a renderer.

The renderer emits all visible text: blocks stand on lines of their own, paragraphs, headings and lists with an empty line
around them, list items with their mark and indent, table rows with cells in aligned columns (spans included),
preformatted text as it is. What a browser shows is visible: also text of SVG and MathML, options, what is hidden from
screen readers only, and visible parts of invisible elements.

Pages of any length and depth take time and space in proportion: open elements are found by name, cells are padded up to
ALIGN columns of text (wider ones push the rest of their row), and lists, quotes and tables within more than DEEP others
are plain blocks. At most SPANS cells that span rows are open at once in a table; further ones count as one row high.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringspark.llm.common import small_batches

# Element names by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes template noscript".split())
TEXT_ONLY = frozenset("textarea title".split())
HIDDEN = frozenset("script style template noscript head title iframe noembed noframes object audio video canvas datalist desc metadata defs annotation annotation-xml".split())
BLOCK = frozenset("address article aside body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol optgroup option p pre section summary table caption thead tbody tfoot tr td th ul menu blockquote".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr".split())
CLOSE_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption dd dt li legend summary optgroup option".split()) | {"dl"}
# An opening tag closes these open ones, looked for down to a tag of the second set.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"td", "th", "tr", "caption"}), frozenset({"table", "thead", "tbody", "tfoot"})),
    "tbody": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "thead": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())

TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|([!?])[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"(?:^|[;{\s])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|[;{\s])visibility\s*:\s*(visible|hidden|collapse)", re.I)
NUMBER = re.compile(r"\s*(\d{1,5})")
ALIGN, DEEP, SPANS = 40, 50, 1000
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW | TEXT_ONLY}
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("children", "columns", "name", "rows", "shown", "start")

    def __init__(self, name: str, start: int | None = None, shown: bool = True, columns: int = 1, rows: int = 1):
        self.name, self.start, self.shown, self.columns, self.rows, self.children = name, start, shown, columns, rows, []


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /\n\t\r\f") else {}


def hidden(name: str, own: dict[str, str]) -> bool:
    """Whether an element and all in it are not displayed."""
    if name in HIDDEN or "hidden" in own and own["hidden"].lower() != "until-found":
        return True
    return bool("style" in own and NO_DISPLAY.search(own["style"])) or name == "dialog" and "open" not in own


def shown(own: dict[str, str], above: bool) -> bool:
    """Whether an element's own text is visible: what it says of its visibility, else as above."""
    found = VISIBILITY.search(own["style"]) if "style" in own else None
    return found[1].lower() == "visible" if found else above


class Open:
    """The open elements, and the places of each name among them."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {root.name: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, n: int) -> None:
        while len(self.stack) > n:
            self.places[self.stack.pop().name].pop()

    def last(self, names) -> int:
        """The place of the innermost open element of these names; 0 if there is none (the root is never closed)."""
        return max((p[-1] for name in names if (p := self.places.get(name))), default=0)


CELLS, P_ENDS = ("td", "th", "table"), ("td", "th", "table", "li", "button")


def tree(source: str) -> Node:
    """The tree of the visible parts: text (str) and Nodes. Hidden elements are parsed, then dropped."""
    root = Node("html")
    opened = Open(root)
    stack = opened.stack
    at = 0

    def text(s: str) -> None:
        if s and stack[-1].shown:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    for m in TAG.finditer(source):
        if m.start() < at:
            continue
        text(source[at : m.start()])
        at = m.end()
        name = m[4]
        if name is None:
            continue
        name = name.lower()
        if m[3]:
            if name == "p" and not opened.last(("p",)):
                stack[-1].children.append(Node("p"))
            found = opened.last((name,))
            if found and (name in BLOCK or found >= opened.last(CELLS)):
                opened.close(found)
            continue
        if name in ("html", "body"):
            if found := opened.last(("head",)):
                opened.close(found)
            continue
        if name not in HEAD_ONLY and len(stack) > 1 and stack[-1].name == "head":
            opened.close(len(stack) - 1)
        if name in CLOSES:
            closed, until = CLOSES[name]
            while (found := opened.last(closed)) > opened.last(until):
                opened.close(found)
                if name not in ("tr", "tbody", "thead", "tfoot"):
                    break
        if name in CLOSE_P and (found := opened.last(("p",))) > opened.last(P_ENDS):
            opened.close(found)
        own = attributes(m[5])
        visible = shown(own, stack[-1].shown)
        if name in ("td", "th") and not any(x.name == "tr" for x in stack[-2:]):
            row = Node("tr", shown=stack[-1].shown)
            stack[-1].children.append(row)
            opened.push(row)
        span = lambda key: max(1, int(n[1])) if (n := NUMBER.match(own.get(key, ""))) else 1  # noqa: B023, E731
        node = Node(name, int(own["start"]) if name == "ol" and re.fullmatch(r"-?\d{1,9}", own.get("start", "")) else None, visible, min(span("colspan"), 1000), span("rowspan"))
        if name in RAW or name in TEXT_ONLY:
            end = RAW_END[name].search(source, at)
            inner = source[at : end.start() if end else len(source)]
            at = end.end() if end else len(source)
            if not hidden(name, own) and visible and name in TEXT_ONLY:
                node.children.append(html.unescape(inner))
                stack[-1].children.append(node)
            continue
        if name == "br" or name == "hr":
            if not hidden(name, own):
                stack[-1].children.append(node)
            continue
        if name == "img" and own.get("alt") and visible and not hidden(name, own):
            stack[-1].children.append(own["alt"])
        if name == "input" and own.get("type", "text").lower() in ("submit", "button", "reset") and own.get("value") and visible and not hidden(name, own):
            stack[-1].children.append(own["value"])
        if name in VOID:
            continue
        if not hidden(name, own):
            stack[-1].children.append(node)
        opened.push(node)  # a hidden one has no parent, so what it holds is dropped with it
    text(source[at:])
    return root


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Lines:
    """Collects lines; space between words and empty lines between blocks are held back until text follows."""

    def __init__(self):
        self.done, self.now, self.space, self.gap = [], [], False, False

    def word(self, s: str) -> None:
        parts = SPACE.split(s)
        if parts == [""]:
            return
        if parts[0] == "" and len(parts) > 1:
            self.space = True
        body = " ".join(p for p in parts if p)
        if body:
            if self.gap and not self.now:
                if self.done:
                    self.done.append("")
                self.gap = False
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(body)
            self.space = False
        if parts[-1] == "" and (body or self.now):
            self.space = True

    def end(self, gap: bool = False) -> None:
        if self.now:
            self.done.append("".join(self.now))
            self.now = []
        self.space = False
        self.gap = self.gap or gap

    def lines(self, many: list[str], gap: bool = False) -> None:
        self.end(gap)
        if many:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.done += many
        self.gap = self.gap or gap


def rows_of(node: Node) -> Iterator[Node]:
    """The rows and captions of a table, in order, without those of tables within; iterative."""
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                yield _wrap(x)
        elif x.name in ("thead", "tbody", "tfoot", "colgroup", "form"):
            todo.extend(reversed(x.children))
        else:
            yield x


def _wrap(x) -> Node:
    node = Node("caption")
    node.children.append(x)
    return node


def placed(rows: list[tuple[str, list]]) -> list[tuple[str, list]]:
    """rows (kind, cells) with cells (lines, columns, rows) made (column, columns, lines), past the cells that span down from above."""
    out, down = [], []  # down: [first column, past the last, rows left]
    for kind, cells in rows:
        if kind != "tr":
            out.append((kind, cells))
            continue
        down.sort()
        at, i, new, own = 0, 0, [], []
        for lines, columns, high in cells:
            while i < len(down) and down[i][0] < at + columns:
                at, i = max(at, down[i][1]), i + 1
            own.append((at, columns, lines))
            if high > 1 and len(down) + len(new) < SPANS:
                new.append([at, at + columns, high])
            at += columns
        down = [[a, b, n - 1] for a, b, n in down + new if n > 1]
        out.append((kind, own))
    return out


def table_lines(rows: list[tuple[str, list]]) -> list[str]:
    """Lines of a table: cells of a column start at the same place; a cell of several lines takes several lines.

    Only columns in which a cell starts count. Columns are as wide as their widest cell of one column, ALIGN at most.
    """
    rows = placed(rows)
    number = {c: k for k, c in enumerate(sorted({at for kind, cells in rows if kind == "tr" for at, _, _ in cells}))}
    firsts = list(number)
    widths = [0] * len(number)
    spans = []
    for kind, cells in rows:
        own = []
        if kind == "tr":
            for at, columns, lines in cells:
                k = number[at]
                past = bisect.bisect_left(firsts, at + columns, k + 1)
                own.append((k, past, lines))
                if past == k + 1:
                    widths[k] = min(ALIGN, max(widths[k], max(map(width, lines), default=0)))
        spans.append(own)
    begin = list(itertools.accumulate((w + 2 for w in widths), initial=0))
    out = []
    for (kind, cells), own in zip(rows, spans, strict=True):
        if kind != "tr":
            out += cells[0]
            continue
        for j in range(max((len(lines) for _, _, lines in own), default=0)):
            parts, pushed, last = [], 0, 0  # pushed: what wide cells take beyond their columns
            for k, _, lines in own:
                if j < len(lines) and lines[j]:
                    gap = begin[k] + pushed - last
                    if gap < 2 and parts:
                        pushed, gap = pushed + 2 - gap, 2
                    parts.append(" " * gap + lines[j])
                    last = begin[k] + pushed + width(lines[j])
            out.append("".join(parts).rstrip())
    return out


def render(root: Node) -> list[str]:
    """All lines of a tree. Depth is kept on a list of generators, not on Python's stack."""

    def inner(node: Node, out: Lines, deep: int = 0):
        number = node.start if node.start is not None else 1
        for x in node.children:
            if isinstance(x, str):
                if node.name == "textarea":
                    out.lines([s.rstrip() for s in x.strip("\n").split("\n")] if x.strip() else [])
                else:
                    out.word(x)
            elif x.name == "br":
                if out.now:
                    out.end()
                elif out.done and out.done[-1] != "":
                    out.gap = True
            elif x.name == "hr":
                out.end(True)
            elif x.name == "pre":
                text: list[str] = []
                flat(x, text)
                body = "".join(text).replace("\r\n", "\n")
                out.lines([s.rstrip() for s in body.removeprefix("\n").rstrip("\n").split("\n")] if body.strip() else [], True)
            elif x.name == "table" and deep < DEEP:
                rows = []
                for row in rows_of(x):
                    if row.name == "tr":
                        cells = []
                        for cell in row.children:
                            if isinstance(cell, str) and not cell.strip():
                                continue
                            own = Lines()
                            cell = _wrap(cell) if isinstance(cell, str) else cell
                            yield cell, own, deep + 1
                            own.end()
                            cells.append((own.done, cell.columns, cell.rows))
                        rows.append(("tr", cells))
                    else:
                        own = Lines()
                        yield row, own, deep + 1
                        own.end()
                        rows.append(("", [own.done]))
                out.lines(table_lines(rows), True)
            elif x.name == "li" and deep < DEEP:
                own = Lines()
                yield x, own, deep + 1
                own.end()
                mark = f"{number}. " if node.name == "ol" else "- "
                number += 1
                pad = " " * len(mark)
                out.lines([(mark if i == 0 else pad if s else "") + s for i, s in enumerate(own.done)])
            elif x.name in ("dd", "blockquote") and deep < DEEP:
                own = Lines()
                yield x, own, deep + 1
                own.end()
                out.lines(["  " + s if s else "" for s in own.done], x.name == "blockquote")
            elif x.name in BLOCK:
                nested = x.name in ("ul", "ol", "menu") and node.name == "li"
                out.end(x.name in SPACED and not nested)
                yield x, out, deep
                out.end(x.name in SPACED and not nested)
            else:
                yield x, out, deep

    def flat(node: Node, text: list[str]) -> None:
        todo = [node]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                text.append(x)
            elif x.name == "br":
                text.append("\n")
            else:
                todo.extend(reversed(x.children))

    top = Lines()
    running = [inner(root, top)]
    while running:
        try:
            running.append(inner(*next(running[-1])))
        except StopIteration:
            running.pop()
    top.end()
    return top.done


def text_of(source: str | None) -> str:
    """The visible text of a page, lines joined by line ends; empty for null or empty pages."""
    return "\n".join(render(tree(source))) if source else ""


def visible_text(page: Column) -> Column:
    @F.pandas_udf("string")
    def of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([text_of(p) for p in batch], dtype=object)

    return of(page)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with the column text (replaced if there is one) for each row; null and empty pages give an empty text.

    Repeated rows give repeated rows, an empty table an empty one; other columns stay.
    """
    small_batches(pages.sparkSession)
    return pages.withColumn("text", visible_text(F.col(column)))
