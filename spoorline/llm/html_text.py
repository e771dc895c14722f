"""HTML to text as it is laid out: implied tags, visibility, block spacing, lists, aligned table cells.

The page is read once. A stack of open elements adds the end tags that HTML leaves out; what the stack holds decides
whether text is visible and where it flows. Blocks end lines and keep blank lines between paragraphs, list items get
their mark and indent, table cells are collected and set in columns when the table ends.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACES = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist object audio video canvas svg math".split())
HEAD = frozenset("base link meta noscript script style template title".split())
# blocks with a blank line around them, and those that only end the line
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure fieldset hr xmp".split())
PLAIN = frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option "
    "search section select summary tbody textarea tfoot thead tr".split()
)
BLOCK = SPACED | PLAIN
CLOSES_P = (SPACED | PLAIN) - frozenset("body caption html optgroup option select tbody textarea tfoot thead tr legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# a start tag ends the nearest of these unless one of the borders is met first
CELL = frozenset(["td", "th"])
GROUPS = frozenset(["tbody", "thead", "tfoot"])
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select optgroup datalist table".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset("select table".split())),
    "td": (CELL, frozenset(["tr", "table"])),
    "th": (CELL, frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "tbody": (GROUPS | {"caption", "tr"}, frozenset(["table"])),
    "thead": (GROUPS | {"caption", "tr"}, frozenset(["table"])),
    "tfoot": (GROUPS | {"caption", "tr"}, frozenset(["table"])),
}
SCOPE = frozenset("table td th caption html template button".split())


class Flow:
    """Lines of running text with indents, list marks and pending blank lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.started = False
        self.gap, self.indent, self.mark = 0, "", ""

    def text(self, value: str) -> None:
        """Running text; runs of white space count as one, also across elements."""
        words = SPACES.sub(" ", value)
        if words[0] == " ":
            self.space = bool(self.parts)
            words = words[1:]
        if not words:
            return
        if self.space:
            self.parts.append(" ")
        self.space = words[-1] == " "
        self.parts.append(words[:-1] if self.space else words)

    def literal(self, value: str) -> None:
        """Text whose line ends and spaces stay."""
        first, *rest = value.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.parts.append(first)
        for line in rest:
            self.newline()
            if line:
                self.parts.append(line)

    def newline(self) -> None:
        """Ends the line even if it is empty."""
        if self.parts or self.started:
            self._put("".join(self.parts).rstrip())
        self.parts, self.space = [], False

    def _put(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap, self.started = 0, True
        if self.mark:
            self.lines.append((self.indent[: -len(self.mark)] + self.mark + line).rstrip())
            self.mark = ""
        else:
            self.lines.append((self.indent + line).rstrip() if line else "")

    def block(self, spaced: bool) -> None:
        """Ends the line if it holds text, and asks for a blank line before the next."""
        if self.parts:
            self._put("".join(self.parts).rstrip())
        self.parts, self.space = [], False
        if spaced and self.lines:
            self.gap = 1

    def done(self) -> list[str]:
        self.block(False)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    """Cells as ``(lines, columns, rows)`` per row."""

    def __init__(self, outer: Flow):
        self.outer, self.rows = outer, []

    def layout(self) -> list[str]:
        """Rows with their cells in aligned columns, two spaces apart."""
        grid, taken, width = [], {}, {}
        for r, row in enumerate(self.rows):
            column, placed = 0, []
            for lines, columns, rows in row:
                while taken.get(column, 0) > r:
                    column += 1
                for c in range(column, column + columns):
                    taken[c] = r + rows
                placed.append((column, columns, lines))
                column += columns
            grid.append(placed)
        for column, columns, lines in (cell for row in grid for cell in row):
            if columns == 1:
                width[column] = max([width.get(column, 0), *map(len, lines)])
        for column, columns, lines in (cell for row in grid for cell in row):
            if columns > 1:
                have = sum(width.setdefault(c, 0) for c in range(column, column + columns)) + 2 * (columns - 1)
                width[column + columns - 1] += max(0, max(map(len, lines), default=0) - have)
        at, x = {}, 0
        for column in range(max(width, default=-1) + 1):
            at[column] = x
            x += width.get(column, 0) + (2 if width.get(column, 0) else 0)
        out = []
        for row in grid:
            for i in range(max([len(lines) for _, _, lines in row], default=0)):
                line = ""
                for column, _, lines in row:
                    if i < len(lines) and lines[i]:
                        line = line.ljust(at[column]) + lines[i]
                out.append(line.rstrip())
        return out


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def _number(attrs: dict[str, str], name: str, most: int) -> int:
    value = attrs.get(name, "1").strip()
    return min(max(int(value), 1), most) if value.isdecimal() and len(value) < 8 else 1


class Page:
    """Open elements as ``[tag, hidden, state to restore]``, and the flow that text runs into."""

    def __init__(self):
        self.flow, self.stack, self.hidden = Flow(), [], 0
        self.tables: list[Table] = []
        self.lists: list[list] = []
        self.pre = 0
        self.open: dict[str, int] = {}

    def text(self, value: str) -> None:
        if self.hidden or not value or self.stack and self.stack[-1][3]:  # a closed details element shows its summary only
            return
        top = self.stack[-1][0] if self.stack else ""
        if top in ("table", "tr") or top in GROUPS:
            if value.isspace():
                return
            flow = self.tables[-1].outer if self.tables else self.flow  # text between cells comes before the table
            flow.text(value)
        elif self.pre:
            self.flow.literal(value.replace("\xa0", " "))
        else:
            self.flow.text(value)

    def start(self, tag: str, raw: str, selfclosed: bool) -> None:
        if tag in ("html", "body") and self.open.get(tag):
            return
        if self.open.get("head") and tag not in HEAD and tag != "head":
            self._until("head")
        if tag in CLOSES_P and self.open.get("p"):
            self._nearest(frozenset("p"), SCOPE)
        if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.pop()
        if tag in ENDS:
            self._nearest(*ENDS[tag])
        if tag in CELL and self.open.get("table") and self.stack[-1][0] != "tr":
            if self._has("tr", frozenset(["table"])):
                self._until("tr", inclusive=False)
            else:
                self.start("tr", "", False)
        attrs = attributes(raw) if raw and not raw.isspace() else {}
        if tag == "br":
            if not self.hidden:
                self.flow.newline()
            return
        if tag in VOID:
            if tag == "hr" and not self.hidden:
                self.flow.block(True)
            elif tag == "input" and not self.hidden and attrs.get("type", "text").lower() in ("submit", "button", "reset"):
                self.text(attrs.get("value", ""))
            return
        hidden = tag in UNSEEN or "hidden" in attrs or bool(HIDING.search(attrs.get("style", ""))) or (tag == "dialog" and "open" not in attrs)
        if self.stack and self.stack[-1][0] == "details" and self.stack[-1][3] and tag != "summary":
            hidden = True
        entry = [tag, hidden, None, tag == "details" and "open" not in attrs]
        self.stack.append(entry)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.hidden += hidden
        if not self.hidden:
            self._enter(tag, attrs, entry)
        if selfclosed and tag not in BLOCK and tag not in CELL and tag in ("svg", "math"):
            self.pop()

    def _enter(self, tag: str, attrs: dict[str, str], entry: list) -> None:
        flow = self.flow
        if tag in CELL and self.tables and self.tables[-1].rows:
            cell = Flow()
            self.tables[-1].rows[-1].append((cell, _number(attrs, "colspan", 1000), _number(attrs, "rowspan", 65534)))
            entry[2] = (flow, self.pre, self.lists)
            self.flow, self.pre, self.lists = cell, 0, []
            return
        if tag == "table":
            flow.block(True)
            self.tables.append(Table(flow))
            entry[2] = flow
            return
        if tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
            return
        if tag == "caption" and self.tables:
            entry[2] = (flow, self.pre, self.lists)
            self.flow = self.tables[-1].outer
        if tag in BLOCK:
            self.flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and self.lists))
        if tag in ("ul", "ol", "menu"):
            start = attrs.get("start", "1").strip()
            self.lists.append([tag, int(start) if start.lstrip("-").isdecimal() and len(start) < 8 else 1])
        elif tag == "li":
            mark = "- "
            if self.lists and self.lists[-1][0] == "ol":
                mark = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            entry[2] = (flow.indent, mark)
            flow.indent, flow.mark = flow.indent + " " * len(mark), mark
        elif tag in ("blockquote", "dd"):
            entry[2] = flow.indent
            flow.indent += "    "
        elif tag in ("pre", "textarea", "xmp"):
            self.pre += 1
            entry[2] = True

    def pop(self) -> None:
        tag, hidden, state, _ = self.stack.pop()
        self.open[tag] -= 1
        seen = not self.hidden
        self.hidden -= hidden
        if not seen:
            return
        flow = self.flow
        if tag in CELL and state:
            self.flow, self.pre, self.lists = state
            return
        if tag == "table":
            table = self.tables.pop()
            table.rows = [[(cell.done(), c, r) for cell, c, r in row] for row in table.rows]
            flow.block(True)
            for line in table.layout():
                flow._put(line)
            flow.block(True)
            return
        if tag in BLOCK:
            flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and len(self.lists) > 1))
        if tag in ("ul", "ol", "menu") and self.lists:
            self.lists.pop()
        elif tag == "li" and state:
            flow.indent, flow.mark = state[0], ""
        elif tag in ("blockquote", "dd"):
            flow.indent = state
        elif tag in ("pre", "textarea", "xmp"):
            self.pre -= 1
        elif tag == "caption" and state:
            self.flow, self.pre, self.lists = state

    def _has(self, tag: str, borders: frozenset) -> bool:
        for entry in reversed(self.stack):
            if entry[0] == tag:
                return True
            if entry[0] in borders:
                return False
        return False

    def _until(self, tag: str, inclusive: bool = True) -> None:
        while self.stack and self.stack[-1][0] != tag:
            self.pop()
        if inclusive and self.stack:
            self.pop()

    def _nearest(self, tags: frozenset, borders: frozenset) -> None:
        """Ends the outermost open element of ``tags`` inside the nearest border, with all it holds."""
        if not any(self.open.get(t) for t in tags):
            return
        last = None
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in tags:
                last = i
                if len(tags) == 1:
                    break
            elif tag in borders:
                break
        if last is not None:
            while len(self.stack) > last:
                self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "", False)
            return
        if not self.open.get(tag):
            if tag == "p" and not self.hidden:
                self.flow.block(True)  # an end tag alone makes an empty paragraph
            return
        borders = frozenset(["table"]) if tag in CELL or tag in GROUPS or tag in ("tr", "caption") else frozenset() if tag in ("table", "body", "html") else frozenset(["td", "th", "caption", "table"])
        if self._has(tag, borders):
            self._until(tag)


def render(source: str) -> str:
    """The visible text of a page."""
    page, at, n = Page(), 0, len(source)
    while at < n:
        mark = source.find("<", at)
        if mark < 0:
            page.text(html.unescape(source[at:]) if "&" in source[at:] else source[at:])
            break
        match = TOKEN.match(source, mark)
        if match is None:
            following = source.find("<", mark + 1)
            following = n if following < 0 else following
            page.text(html.unescape(source[at:following]))
            at = following
            continue
        if mark > at:
            part = source[at:mark]
            page.text(html.unescape(part) if "&" in part else part)
        at = match.end()
        if match["cdata"] is not None:
            page.text(match["cdata"])
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["end"]:
            page.end(tag)
            continue
        page.start(tag, match["attrs"], match["attrs"].endswith("/"))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            stop = close.start() if close else n
            if not page.hidden:
                page.text(html.unescape(source[at:stop]) if tag in ("textarea", "title") else source[at:stop])
            page.end(tag)
            at = close.end() if close else n
    while page.stack:
        page.pop()
    return "\n".join(page.flow.done()).replace("\xa0", " ")


def _render(batches):
    for batch in batches:
        texts = [render(x) for x in batch.column("__html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def page_text(pages: DataFrame, keep: list[str], html_column: str = "html") -> DataFrame:
    """``(*keep, text)`` for every row of ``pages``; a null or empty page has the empty text.

    Repeated rows are rendered one by one; columns not in ``keep`` are ignored. ``keep`` must not hold ``text``.
    """
    rows = pages.select(F.struct(*keep).alias("row"), F.coalesce(html_column, F.lit("")).alias("__html"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_render, f"row {kind}, text string").select("row.*", "text")
