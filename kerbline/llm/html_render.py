"""Layout-aware rendering of HTML to text.

The standard library's tokenizer feeds a builder that keeps the stack of open elements: it supplies the end tags that HTML leaves
out (a paragraph ends before a block, an item before the next item, cells and rows before the next ones), ignores end tags that
match nothing, and drops what is not shown: scripts, styles, the head, hidden elements, and elements that an inline style or a
rule of the page's style sheet takes away, by tag, classes and id together; what is only made invisible may hold what is made visible
again. What is left is laid out as it is met: blocks on lines of their own with one
empty line between paragraphs, items behind bullets or numbers, indented by depth, preformatted text as it stands, and tables
with their cells padded to columns. Nothing recurses, and where each open element stands is known, so depth of nesting is no danger.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.words import in_parts, mapped

#: Element names by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template datalist object audio video iframe canvas svg noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCKS = SPACED | frozenset("html body div section article header footer nav aside main address form fieldset legend figcaption li dt dd details summary caption dialog center menu dir search select option optgroup".split())
LISTS = frozenset("ul ol menu dir".split())
PARTS = frozenset("tr td th thead tbody tfoot caption colgroup".split())
#: An opening tag ends the open elements on the left, up to the nearest of those on the right.
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Where a fixed width is asked for: lines of cells longer than this are not padded for.
WIDEST = 40
#: A laid out table has at most so many times the characters of its text, and some more, so that a long cell does not multiply its size.
TIMES, MORE = 4, 4000
#: Fixed value: columns that a cell can span, by the HTML standard.
MOST_COLUMNS = 1000

_GONE = re.compile(r"display\s*:\s*none", re.I)
_VEIL = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)", re.I)
_MARK = re.compile(r"([.#])([\w-]+)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Flow:
    """Text laid out so far in one box: the page or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = ""
        self.marker = ""

    def text(self, data: str) -> None:
        words = _SPACE.split(data)
        for i, w in enumerate(words):
            if i:
                self.space = True
            if w:
                self.put((" " if self.space and self.line else "") + w)

    def put(self, piece: str) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
            lead = self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent
            self.marker = ""
            piece = lead + piece
        self.line.append(piece)
        self.space = False

    def newline(self) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        elif self.lines and not self.gap:
            self.lines.append("")
        self.space = False

    def block(self, gap: int) -> None:
        """The line ends; before the next one come gap - 1 empty lines at least."""
        if self.line:
            self.newline()
        self.space = False
        if self.marker:
            return
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.block(1)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _widths(rows: list[list[list[str]]], widest: int | None) -> list[int]:
    """Width of each column: of its longest line, or of the longest of at most `widest` characters."""
    widths: list[int] = []
    for row in rows:
        widths += [0] * (len(row) - len(widths))
        for i, cell in enumerate(row):
            for x in cell:
                if widths[i] < len(x) and (widest is None or len(x) <= widest):
                    widths[i] = len(x)
    return widths


def aligned(rows: list[list[list[str]]], widest: int | None = None) -> list[str]:
    """Lines of a table: cells side by side, padded to the width of their column.

    Lines longer than `widest` stick out; without it, all are padded for, unless the table would grow beyond TIMES its text: then those
    longer than the greatest width at which it does not stick out.
    """
    widths = _widths(rows, widest)
    if widest is None:
        lines = sum(max((len(c) for c in row), default=0) for row in rows)
        most = TIMES * sum(len(x) for row in rows for c in row for x in c) + MORE
        if lines * sum(widths) > most:
            sizes = sorted({len(x) for row in rows for c in row for x in c})
            low, high = 0, len(sizes)  # sizes below low fit, those from high on do not
            while low < high:
                mid = (low + high) // 2
                if lines * sum(_widths(rows, sizes[mid])) <= most:
                    low = mid + 1
                else:
                    high = mid
            widths = _widths(rows, sizes[low - 1] if low else 0)
    out = []
    for row in rows:
        for n in range(max((len(c) for c in row), default=0)):
            out.append("  ".join((c[n] if n < len(c) else "").ljust(widths[i]) for i, c in enumerate(row)).rstrip())
    return out


class Renderer(HTMLParser):
    def __init__(self, widest: int | None = WIDEST) -> None:
        super().__init__(convert_charrefs=True)
        self.widest = widest
        self.open: list[tuple[str, object, bool]] = []  # name, what its end undoes, and whether text was veiled outside
        self.at: dict[str, list[int]] = {}  # where in `open` the elements of a name stand
        self.veiled = False
        self.flows = [Flow()]
        self.tables: list[list[list[list[str]]]] = []
        self.lists: list[list] = []
        self.hidden = 0
        self.pre = 0
        self.sheet: list[str] = []
        self.rules: list[tuple[str, frozenset[str], str, str]] = []
        self.n = {"li": 0, "table": 0, "p": 0}

    # ------------------------------------------------ the builder

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.void(tag, dict(attrs))
            return
        if tag in BLOCKS and self.at.get("p"):
            self.close_to({"p"}, {"td", "th", "table", "caption", "button"})
        if tag in IMPLIED:
            self.close_to(*IMPLIED[tag])
        if tag in ("td", "th") and self.tables and not self.has("tr", {"table"}):
            self.enter("tr", {})
        if tag not in UNSEEN and tag not in ("html", "meta", "link") and self.at.get("head"):
            self.close_to({"head"}, {"html"})
        self.enter(tag, dict(attrs))

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.at.get("p") and not self.hidden:
            self.flows[-1].block(2)
        elif tag == "br":
            self.void("br", {})
        elif self.at.get(tag) and self.has(tag, {"td", "th"} if tag not in PARTS | {"table", "html", "body"} else {"table"} if tag in PARTS else set()):
            while self.open:
                if self.leave() == tag:
                    break

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def has(self, tag: str, until) -> bool:
        own = self.at.get(tag)
        return bool(own) and own[-1] >= self.floor(until)

    def floor(self, names) -> int:
        """Where the innermost of these stands; -1 for none."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def close_to(self, ends, until) -> None:
        """Ends the outermost of these elements above the nearest of `until`, with all inside."""
        floor = self.floor(until)
        cut = min((own[i] for x in ends if (own := self.at.get(x)) and (i := bisect_right(own, floor)) < len(own)), default=None)
        while cut is not None and len(self.open) > cut:
            self.leave()

    # ------------------------------------------------ what is shown

    def gone(self, tag: str, attrs: dict) -> bool:
        style = attrs.get("style") or ""
        told = self.told(tag, attrs) if self.rules else set()
        if m := _VEIL.search(style):
            self.veiled = m[1].lower() != "visible"
        elif told & {"hidden", "collapse", "visible"}:
            self.veiled = "visible" not in told
        return tag in UNSEEN or "hidden" in attrs or tag == "dialog" and "open" not in attrs or bool(_GONE.search(style)) or "none" in told

    def told(self, tag: str, attrs: dict) -> set[str]:
        """What the style sheet says of an element."""
        classes, own = set((attrs.get("class") or "").split()), attrs.get("id") or ""
        return {says for t, cs, i, says in self.rules if t in ("", tag) and cs <= classes and i in ("", own)}

    def learn(self, sheet: str) -> None:
        for selectors, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
            veil = _VEIL.search(body)
            says = "none" if _GONE.search(body) else veil[1].lower() if veil else ""
            for s in selectors.split(",") if says else ():
                m = _SIMPLE.fullmatch(s.strip())
                if m and m[0]:
                    marks = _MARK.findall(m[2])
                    tag = "" if m[1] in (None, "*") else m[1].lower()
                    self.rules.append((tag, frozenset(v for k, v in marks if k == "."), next((v for k, v in marks if k == "#"), ""), says))

    # ------------------------------------------------ layout

    def void(self, tag: str, attrs: dict) -> None:
        if self.hidden:
            return
        if tag == "br":
            self.flows[-1].newline()
        elif tag == "hr":
            self.flows[-1].block(2)

    def enter(self, tag: str, attrs: dict) -> None:
        undo: object = None
        veiled = self.veiled
        if self.hidden or self.gone(tag, attrs):
            self.hidden += 1
            undo = "hidden"
        else:
            flow = self.flows[-1]
            if tag == "table":
                flow.block(2)
                self.tables.append([])
                self.n["table"] += 1
            elif tag == "tr" and self.tables:
                self.tables[-1].append([])
            elif tag in ("td", "th") and self.tables:
                self.flows.append(Flow())
                span = attrs.get("colspan") or ""
                undo = min(int(span[:9]), MOST_COLUMNS) if span.isascii() and span.isdigit() else 1
            elif tag in LISTS:
                flow.block(1 if self.lists else 2)
                start = attrs.get("start") or ""
                self.lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, flow.indent])
            elif tag == "li":
                flow.block(1)
                flow.marker = ""
                undo = flow.indent
                kind = self.lists[-1] if self.lists else ["ul", 1, ""]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                flow.indent, flow.marker = flow.indent + " " * len(mark), mark
                self.n["li"] += 1
            elif tag in BLOCKS:
                flow.block(2 if tag in SPACED else 1)
                self.n["p"] += tag == "p"
                if tag in ("dd", "blockquote"):
                    undo, flow.indent = flow.indent, flow.indent + "  "
            if tag == "pre":
                self.pre += 1
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, undo, veiled))

    def leave(self) -> str:
        tag, undo, self.veiled = self.open.pop()
        self.at[tag].pop()
        if tag == "style" and self.sheet:
            self.learn("".join(self.sheet))
            self.sheet = []
        if undo == "hidden":
            self.hidden -= 1
            return tag
        flow = self.flows[-1]
        if tag in ("td", "th") and isinstance(undo, int):
            cell = self.flows.pop().done()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].extend([cell, *[[] for _ in range(undo - 1)]])
        elif tag == "table" and self.tables:
            lines = aligned([r for r in self.tables.pop() if any(r)], self.widest)
            flow.block(2)
            for x in lines:
                if x.strip():
                    flow.put(x)
                flow.newline()
            flow.block(2)
        elif tag in LISTS and self.lists:
            self.lists.pop()
            flow.block(1 if self.lists else 2)
        elif tag == "li":
            flow.block(1)
            flow.marker = ""
            flow.indent, flow.gap = undo or "", max(flow.gap, 1)
        elif tag in BLOCKS:
            flow.block(2 if tag in SPACED else 1)
            if isinstance(undo, str):
                flow.indent = undo
        if tag == "pre":
            self.pre -= 1
        return tag

    def handle_data(self, data: str) -> None:
        if self.hidden:
            if self.open and self.open[-1][0] == "style":
                self.sheet.append(data)
            return
        if self.veiled:
            return
        flow = self.flows[-1]
        if self.open and self.open[-1][0] in ("table", "tr", "thead", "tbody", "tfoot", "ul", "ol", "dl") and not data.strip(" \t\n\r\f"):
            return
        if self.pre:
            for i, x in enumerate(data.split("\n")):
                if i:
                    flow.newline()
                if x:
                    flow.put(x)
        else:
            flow.text(data)


def render(html: str, widest: int | None = WIDEST) -> tuple[str, int, int, int]:
    """Text, and how many items, tables and paragraphs it shows."""
    r = Renderer(widest)
    r.feed(html)
    r.close()
    while r.open:
        r.leave()
    return "\n".join(r.flows[0].done()), r.n["li"], r.n["table"], r.n["p"]


def _run(widest: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, 200):
            cols = list(zip(*(render(x or "", widest) for x in part.column(1).to_pylist()), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["page_id", "text", "n_items", "n_tables", "n_paragraphs"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", widest: int | None = None) -> DataFrame:
    """Rows (page_id, text, n_items, n_tables, n_paragraphs), one for each row of pages.

    Null or empty HTML gives an empty text; broken HTML gives what can be shown of it. Repeated rows and null ids are rendered like
    others; other columns may have any names. All visible text is given, however long or deep. Columns of a table are as wide as their
    widest line of at most `widest` characters; longer lines are given whole and stick out. A cell spans at most 1,000 columns, as the
    standard has it. Style rules with several simple selectors in a row (descendants and the like) are not applied. Empty in, empty out.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    return mapped(pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")), _run(widest), f"page_id {kind}, text string, n_items long, n_tables long, n_paragraphs long")
