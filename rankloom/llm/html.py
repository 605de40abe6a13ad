"""HTML extraction by a layout-aware rendering of the visible text.

A tree builder supplies implied end tags (a paragraph ends at a block, an item at the next item, a cell at
the next cell or row); visibility rules drop what a browser does not show (head, scripts, templates, hidden
attributes, display:none, closed details, visibility:hidden with its overrides, and of inline SVG and MathML the
titles, descriptions, definitions and annotations, while labels and formulas are kept); the renderer emits all
remaining text with line breaks for blocks, a blank line around paragraphs, headings, lists and tables,
markers and indents for list items (with start, reversed and value), values of fields and buttons, and table
cells padded to aligned columns (with colspan and rowspan).  Rules of style sheets are not applied.

Builder and renderer keep their own stacks, so nesting may be as deep as the page is long.  Pages are
independent: one pass, no shuffle.

Cases: null and empty pages give an empty text; unclosed, stray and truncated tags, comments and entities
are taken as browsers take them as far as visible text goes; equal rows give equal rows; an empty table gives
an empty result; columns other than the key and the page are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, need

TOKEN = re.compile(
    r"(?P<text>[^<]++)|<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?|</?[!?/][^>]*+>?|(?P<lone><)", re.DOTALL
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")

def words(line: str) -> frozenset:
    return frozenset(line.split())


VOID = words("area base br col embed hr img input link meta param source track wbr")
RAW = words("script style textarea title xmp iframe noembed noframes")
UNSEEN = words("head script style template title iframe noembed noframes object audio video canvas datalist")
#: Types of inputs that do not show their value.
UNWRITTEN = words("hidden checkbox radio password file color range image")
#: What svg and math hide within them.
UNSEEN_IN = {
    "svg": words("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter"),
    "math": words("annotation annotation-xml"),
}
BLOCKS = words(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol optgroup option p pre search section summary table ul"
)
ENDS_PARAGRAPH = BLOCKS - words("body html option optgroup legend") | words("plaintext listing xmp")
SPACED = words("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul fieldset")
TABLE_PARTS = words("caption colgroup thead tbody tfoot tr td th")
#: Start tag: the open elements that it ends, and where the search for them stops.
IMPLIED = {
    "li": (words("li"), words("ul ol menu dir table td th")),
    "dt": (words("dt dd"), words("dl table td th")),
    "dd": (words("dt dd"), words("dl table td th")),
    "option": (words("option"), words("select table td th")),
    "optgroup": (words("option optgroup"), words("select table td th")),
    "td": (words("td th caption colgroup"), words("tr table")),
    "th": (words("td th caption colgroup"), words("tr table")),
    "tr": (words("tr caption colgroup"), words("table")),
    **{part: (words("thead tbody tfoot caption colgroup"), words("table")) for part in ("thead", "tbody", "tfoot", "caption", "colgroup")},
    "body": (words("head"), words("body")),
}
SCOPE = words("table td th caption html template object button")


class Node:
    __slots__ = ("attrs", "kids", "name")

    def __init__(self, name: str, attrs: str = "") -> None:
        self.name, self.attrs, self.kids = name, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[0].lower(): unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(self.attrs)}


def build(page: str) -> Node:
    """The tree of a page; texts are strings among an element's children."""
    root = Node("#root")
    stack, at = [root], 0
    opened: Counter[str] = Counter()  # how many elements of a name are open

    def pop_from(i: int) -> None:
        for node in stack[i:]:
            opened[node.name] -= 1
        del stack[i:]

    def close(names: frozenset, stop: frozenset) -> None:
        """End the outermost of `names` that is open within the nearest `stop`, with all in it."""
        if not any(opened[n] for n in names):
            return
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                found = i
            elif stack[i].name in stop:
                break
        if found is not None:
            pop_from(found)

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        kind = m.lastgroup
        if kind in ("text", "lone"):
            stack[-1].kids.append(unescape(m[0]) if "&" in m[0] else m[0])
            continue
        if m["name"] is None:
            continue
        name, attrs = m["name"].lower(), m["attrs"]
        if m["end"]:
            if not opened[name]:
                if name == "p":
                    stack[-1].kids.append(Node("p"))
                continue
            stop = frozenset() if name in SCOPE else words("table") if name in TABLE_PARTS else SCOPE if name in BLOCKS else words("td th table")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    pop_from(i)
                    break
                if stack[i].name in stop:
                    break
            continue
        if name == "body" and opened["body"]:
            continue
        if name in IMPLIED:
            close(*IMPLIED[name])
        elif stack[-1].name == "head" and name not in ("base", "link", "meta", "noscript", *UNSEEN):
            pop_from(len(stack) - 1)  # content begins
        if name in ENDS_PARAGRAPH:
            close(words("p"), SCOPE)
        node = Node(name, attrs)
        stack[-1].kids.append(node)
        if attrs.endswith("/") and (opened["svg"] or opened["math"] or name in UNSEEN_IN):
            continue  # these end themselves
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])|\\Z", re.IGNORECASE).search(page, at)
            body = page[at : end.start()]
            node.kids.append(unescape(body) if name in ("textarea", "title") else body)
            at = page.find(">", end.start()) + 1 or len(page)
        elif name not in VOID:
            stack.append(node)
            opened[name] += 1
    return root


class Lines:
    """Text under way: finished lines, the open line, and the blank lines owed before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.open: list[str] = []
        self.owed = False
        self.indent = 0
        self.marker = ""
        self.spaced = False  # the open line ends in a space that may collapse

    def say(self, text: str, exact: bool = False) -> None:
        if exact:
            first, *rest = text.split("\n")
            self.put(first)
            for line in rest:
                self.broken(True)
                self.put(line)
            return
        text = SPACE.sub(" ", text)
        if not self.open or self.spaced:
            text = text.lstrip(" ")
        if text:
            self.put(text)
            self.spaced = text.endswith(" ")

    def put(self, text: str) -> None:
        if text:
            if not self.open:
                if self.owed and self.lines:
                    self.lines.append("")
                self.owed = False
                self.open.append(" " * (self.indent - len(self.marker)) + self.marker)
                self.marker = ""
            self.open.append(text)
            self.spaced = False

    def broken(self, always: bool = False) -> None:
        if self.open:
            self.lines.append("".join(self.open).rstrip(" "))
            self.open, self.spaced = [], False
        elif always:
            self.lines.append("")

    def gap(self) -> None:
        self.broken()
        self.owed = True

    def done(self) -> list[str]:
        self.broken()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return [line.replace("\xa0", " ") for line in self.lines]


def _shown(node: Node, name: str) -> tuple[bool, bool | None]:
    """Whether an element is laid out, and the visibility that it sets, if any."""
    if name in UNSEEN:
        return False, None
    if not node.attrs:
        return name != "dialog", None
    has = node.attributes()
    if "hidden" in has or name == "dialog" and "open" not in has:
        return False, None
    style = re.sub(r"\s+", "", has.get("style", "").lower())
    if re.search(r"(?:^|;)display:none", style):
        return False, None
    m = re.search(r"(?:^|;)visibility:(hidden|collapse|visible)", style)
    return True, m and m[1] == "visible"


def _number(text: str, least: int, most: int, default: int) -> int:
    return min(max(int(text), least), most) if re.fullmatch(r"\s*[+-]?\d{1,9}\s*", text) else default


def _spans(node: Node) -> tuple[int, int]:
    """How many columns and rows a cell takes; rows 0: all that follow."""
    if not node.attrs:
        return 1, 1
    has = node.attributes()
    down = _number(has.get("rowspan", ""), -1, 65534, 1)
    return _number(has.get("colspan", ""), 1, 1000, 1), down if down >= 0 else 1


def _table(rows: list[list[tuple[list[str], int, int]]]) -> Iterator[str]:
    """Lines of a table of (text, columns, rows) cells, aligned by padding.  A cell over several rows is written in the
    first, one over several columns may be as wide as they are; a cell of no columns is a caption on a line of its own."""
    taken: dict[int, int] = {}  # column: the first row that is free again
    placed: list[list[tuple[int, int, list[str]]]] = []
    widths: dict[int, int] = {}
    wide = []
    for r, row in enumerate(rows):
        placed.append([])
        c = 0
        for cell, across, down in row:
            if not across:
                placed[-1].append((0, 0, cell))
                continue
            while taken.get(c, 0) > r:
                c += 1
            size = max(map(len, cell), default=0)
            if across == 1:
                widths[c] = max(widths.get(c, 0), size)
            else:
                wide.append((across, c, size))
            if down != 1:
                for k in range(c, c + across):
                    taken[k] = r + down if down else len(rows)
            placed[-1].append((c, across, cell))
            c += across
    for across, c, size in sorted(wide):
        room = sum(widths.get(k, 0) + 2 for k in range(c, c + across)) - 2
        if size > room:
            widths[c + across - 1] = widths.get(c + across - 1, 0) + size - room
    starts, at = {}, 0
    for c in range(max([c + across for row in placed for c, across, _ in row], default=0)):
        starts[c] = at
        at += widths.get(c, 0) + 2
    for row in placed:
        for k in range(max((len(cell) for _, _, cell in row), default=0)):
            line = ""
            for c, _, cell in row:
                if k < len(cell) and cell[k]:
                    line = line.ljust(starts.get(c, 0)) + cell[k]
            yield line


def render(root: Node) -> str:
    out = Lines()
    lists: list[list] = []  # kind and number of the lists around
    tables: list[tuple[Lines, list]] = []
    # Work to do: (node, visible, exact) to enter, or a function to call when an element ends.
    work: list = [(root, True, False)]
    foreign: list[str] = []  # svg and math elements around
    while work:
        item = work.pop()
        if callable(item):
            item()
            continue
        node, visible, exact = item
        if isinstance(node, str):
            if visible:
                out.say(node, exact)
            continue
        name = node.name
        laid, sets = _shown(node, name)
        if not laid or foreign and name in UNSEEN_IN[foreign[-1]]:
            continue
        visible = visible if sets is None else sets
        kids: list = node.kids
        if name == "br":
            out.broken(True)
            continue
        if name == "hr":
            out.gap()
            continue
        if name == "input":
            has = node.attributes()
            if visible and has.get("type", "text").strip().lower() not in UNWRITTEN:
                out.say(has.get("value", ""))
            continue
        if name == "details" and "open" not in node.attributes():
            kids = [k for k in kids if isinstance(k, Node) and k.name == "summary"][:1]
        after = []
        if name in UNSEEN_IN:
            foreign.append(name)
            after.append(foreign.pop)
        if foreign and foreign[-1] == "svg" and name == "text":
            out.broken()
            after.append(lambda lines=out: lines.broken())
        if name in ("td", "th", "caption") and tables:
            outer, rows = out, tables[-1][1]
            out = Lines()
            if not rows or name == "caption":
                rows.append([])

            def leave(outer=outer, rows=rows, caption=name == "caption", spans=_spans(node)):
                nonlocal out
                rows[-1].append((out.done(), *(spans if not caption else (0, 1))))
                if caption:
                    rows.append([])
                out = outer

            after.append(leave)
        elif name == "table":
            out.gap()
            tables.append((out, []))

            def leave():
                _, rows = tables.pop()
                for line in _table(rows):
                    if line:
                        out.put(line)
                        out.broken()
                out.gap()

            after.append(leave)
        elif name == "tr":
            if tables:
                tables[-1][1].append([])
        elif name in ("ul", "ol", "menu", "dir"):
            out.broken() if lists else out.gap()
            has = node.attributes() if name == "ol" and node.attrs else {}
            back = "reversed" in has
            first = sum(isinstance(k, Node) and k.name == "li" for k in kids) if back else 1
            lists.append([name, _number(has.get("start", ""), -(10**9), 10**9, first), -1 if back else 1])

            def leave():
                lists.pop()
                out.broken() if lists else out.gap()

            after.append(leave)
        elif name == "li":
            out.broken()
            here = lists[-1] if lists else ["ul", 1, 1]
            if here[0] == "ol" and node.attrs:
                here[1] = _number(node.attributes().get("value", ""), -(10**9), 10**9, here[1])
            mark = f"{here[1]}. " if here[0] == "ol" else "- "
            here[1] += here[2]
            was, out.indent, out.marker = out.indent, out.indent + len(mark), mark

            def leave(was=was, lines=out):
                lines.broken()
                lines.indent, lines.marker = was, ""

            after.append(leave)
        elif name in BLOCKS:
            spaced = name in SPACED and not (lists and name == "p")
            out.gap() if spaced else out.broken()
            if name in ("blockquote", "dd"):
                was, out.indent = out.indent, out.indent + 2
            else:
                was = out.indent

            def leave(spaced=spaced, was=was, lines=out):
                lines.gap() if spaced else lines.broken()
                lines.indent = was

            after.append(leave)
            if name == "pre" and kids and isinstance(kids[0], str):
                kids = [kids[0].removeprefix("\r").removeprefix("\n"), *kids[1:]]
        exact = exact or name in ("pre", "textarea", "listing", "xmp", "plaintext")
        work += after
        work += [(kid, visible, exact) for kid in reversed(kids)]
    return "\n".join(out.done())


def page_text(page: str | None) -> str:
    return render(build(page)) if page else ""


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, text (the visible text) and n_lines of each page."""
    need(pages, key, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [page_text(x.as_py()) for x in part.column(1)]
                lines = [x.count("\n") + 1 if x else 0 for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=["key", "text", "n_lines"])

    rows = pages.select(F.col(key).alias("key"), html)
    return rows.mapInArrow(lean(run), f"key {rows.dtypes[0][1]}, text string, n_lines long").withColumnRenamed("key", key)
