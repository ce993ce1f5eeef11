"""HTML extraction by layout-aware rendering.

A tokenizer feeds a tree builder that supplies implied tags (an open ``p`` ends at a block, ``li``, ``dt``/``dd``, ``option``,
table parts end at their next sibling, everything ends at its parent's end); visibility rules drop elements that
a browser does not show; the renderer walks the tree and emits all visible text.  Inline white space is folded, blocks
are parted by a line break, paragraphs and headings by an empty line, list items carry a bullet or
number and are indented by depth, table cells are padded to columns (a cell of several columns or rows covers them),
preformatted text is kept as it is.  Tables are laid out from the innermost outwards, however deep they are nested.

Blanks are bounded, so that a text stays of the order of its page: a block is indented by ``INDENT`` columns at most; a table
column is widened by text up to ``WIDE`` columns, longer cells stick out; columns that no cell begins or ends in have no width; in a
table that is wider than ``WIDE`` a stretch without text is at most ``WIDE`` columns of blanks and bars, and what follows stands that far to the left.

Defined cases: null and empty pages give an empty text; unclosed or stray tags, cut-off tags and comments never fail;
null ids and repeated rows get a row each; an empty table gives no rows; other columns are not read.  Depth is bounded
by the input only, so tree and renderer keep their own stacks; the places of open elements are kept by name, so that no tag searches the stack.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import map_arrow

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption listing plaintext xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl menu dir table figure fieldset listing xmp".split())
HIDDEN = frozenset("head title style script template noscript noembed noframes datalist iframe object audio video canvas svg math select textarea rp area base link meta param source track".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())
TEXT_ONLY = frozenset("title textarea".split())
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption li dd dt option optgroup legend summary".split()) | frozenset("li dd dt summary".split())
#: An opening tag ends open elements of the second set, up to the nearest element of the third.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table", "template"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table", "template"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table", "template"])),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table", "template"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table", "template"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table", "template"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
#: Most columns and rows that a cell covers.
WIDEST, LONGEST = 1000, 65534
#: Most columns of indentation, and of blanks in a table.
INDENT, WIDE = 80, 200
#: End tags of other elements do not reach beyond these.
CELLS = frozenset("table td th template".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot body html template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BUTTON_SCOPE = frozenset("button table td th caption html template object".split())

#: A quote opens a value only after an equals sign; a tag whose quoted value never ends takes the rest of the page.
TAG = re.compile(r"""<(?:(?P<comment>!--(?:>|->|.*?(?:--!?>|\Z)))|(?P<bogus>[!?][^>]*(?:>|\Z)|/[^a-zA-Z>][^>]*(?:>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])))*+)(?:>|\Z)|(?P<empty>/>))""", re.S)
ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
FOLD = re.compile(r"[ \t\n\r\f]+")
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)


class Element:
    """``lines`` is the layout of a table once it is known; ``shut`` marks details of which the summary is shown only."""

    __slots__ = ("name", "hidden", "children", "start", "across", "down", "shut", "lines")

    def __init__(self, name: str, hidden: bool = False):
        self.name, self.hidden, self.children, self.lines = name, hidden, [], None
        self.start, self.across, self.down, self.shut = 1, 1, 1, False


def parse(html: str) -> Element:
    """The element tree; children are elements and strings."""
    root = Element("html")
    stack, at, n = [root], 0, len(html)
    raw_end: dict[str, re.Pattern] = {}
    places: dict[str, list[int]] = defaultdict(list)  # of open elements by name, ascending

    def last(names: frozenset[str]) -> int:
        """Place of the topmost open element of some names; 0 if there is none."""
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def close_to(index: int) -> None:
        for e in stack[index:]:
            places[e.name].pop()
        del stack[index:]

    def push(e: Element) -> None:
        places[e.name].append(len(stack))
        stack.append(e)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            stack[-1].children.append(unescape(html[at:]))
            break
        m = TAG.match(html, lt)
        if lt > at:
            stack[-1].children.append(unescape(html[at:lt]))
        if m is None:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "p" and not places.get("p"):
                stack[-1].children.append(Element("p"))
            elif name == "br":
                stack[-1].children.append(Element("br"))
            else:
                own = last(HEADINGS) if name in HEADINGS else (places.get(name) or [0])[-1]
                if own and (name in TABLE_PARTS or last(CELLS) <= own):
                    close_to(own)
            continue
        if name in ("html", "body", "head"):
            if name == "body":  # the head ends here, whatever it left open
                close_to(1)
            if name == "head":
                e = Element("head", True)
                stack[-1].children.append(e)
                push(e)
            continue
        if len(stack) > 1 and stack[-1].name == "head" and name not in ("meta", "title", "style", "script", "base", "link", "template", "noscript", "noframes"):
            close_to(len(stack) - 1)
        if name in ENDS_P and places.get("p") and places["p"][-1] > last(BUTTON_SCOPE):
            close_to(places["p"][-1])
        if name in IMPLIED and any(places.get(x) for x in IMPLIED[name][0]):
            ended, stop = IMPLIED[name]
            floor = last(stop)
            cut = min((own[k] for x in ended if (own := places.get(x)) and (k := bisect_right(own, floor)) < len(own)), default=None)
            if cut is not None:
                close_to(cut)
        elif name in HEADINGS and stack[-1].name in HEADINGS:
            close_to(len(stack) - 1)
        e = Element(name, name in HIDDEN)
        is_shown = False  # has the attribute "open"
        if m["attrs"] and not m["attrs"].isspace():
            for a in ATTR.finditer(m["attrs"]):
                key = a[1].lower()
                value = a[2] or a[3] or a[4] or ""
                if key == "hidden" and value.lower() != "false":
                    e.hidden = True
                elif key == "style" and INVISIBLE.search(unescape(value)):
                    e.hidden = True
                elif key == "open":
                    is_shown = True
                elif key == "start" and re.fullmatch(r"-?\d{1,9}", value):
                    e.start = int(value)
                elif key in ("colspan", "rowspan") and re.fullmatch(r"\d{1,9}", value):
                    if key == "colspan":
                        e.across = min(max(int(value), 1), WIDEST)
                    else:
                        e.down = int(value) if int(value) else LONGEST  # 0: to the end
        e.shut = name == "details" and not is_shown
        e.hidden |= name == "dialog" and not is_shown
        stack[-1].children.append(e)
        if name in VOID:
            continue
        if name in RAW or name in TEXT_ONLY:
            if name not in raw_end:
                raw_end[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I)
            end = None if name == "plaintext" else raw_end[name].search(html, at)
            body = html[at : end.start() if end else n]
            e.children.append(unescape(body) if name in TEXT_ONLY else body)
            at = end.end() if end else n
            continue
        if m["attrs"].endswith("/") and name in ("svg", "math", "path"):
            continue
        push(e)
    return root


def width(text: str) -> int:
    """Columns of a fixed-width display: wide characters count two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def shown(e: Element) -> list:
    """What a browser shows of the children."""
    if e.shut:
        return [c for c in e.children if not isinstance(c, str) and c.name == "summary"][:1]
    return e.children


class Page:
    """Lines built from inline text and breaks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []  # parts of the line that is being made
        self.prefix = ""  # indentation of the block
        self.mark = ""  # a list mark for the next line
        self.gap = 0  # empty lines owed before the next text
        self.glue = False  # a folded space is owed

    def text(self, s: str) -> None:
        folded = FOLD.sub(" ", s)
        if folded.startswith(" "):
            folded = folded[1:]
            self.glue = bool(self.line)
        if not folded:
            return
        tail = folded.endswith(" ")
        folded = folded[:-1] if tail else folded
        if folded:
            self.line.append(" " + folded if self.glue and self.line else folded)
            self.glue = tail
        elif self.line:
            self.glue = True

    def end(self, gap: int = 0) -> None:
        """End the line; ``gap`` empty lines are owed to what follows."""
        if self.line:
            self.put("".join(self.line))
            self.line = []
        self.glue = False
        self.gap = max(self.gap, gap)

    def put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        lead = self.prefix[: len(self.prefix) - len(self.mark)] + self.mark if self.mark else self.prefix
        self.mark = ""
        self.lines.append((lead + line).rstrip())

    def newline(self) -> None:
        if self.line:
            self.end()
        elif self.lines or self.mark:
            self.gap = max(self.gap, 0) + 1 if self.lines and not self.mark else self.gap


def render(root: Element) -> str:
    """Visible text of a tree."""
    tables, stack = [], [root]
    while stack:
        e = stack.pop()
        if not e.hidden:
            if e.name == "table":
                tables.append(e)
            stack += [c for c in shown(e) if not isinstance(c, str)]
    for e in reversed(tables):  # outer tables were found before their inner ones
        e.lines = list(table_lines(e))
    return flow(root)


def flow(root: Element) -> str:
    """Text of a tree whose inner tables have their lines."""
    page = Page()
    # entries: ("in", element, preformatted, counter of the list around), ("out", element, saved prefix), ("text", string, preformatted)
    work: list[tuple] = [("in", root, False, ())]
    while work:
        kind, *rest = work.pop()
        if kind == "text":
            s, pre = rest
            if not pre:
                page.text(s)
            else:
                parts = s.replace("\r\n", "\n").split("\n")
                for k, part in enumerate(parts):
                    if part:
                        page.line.append(part)
                    if k < len(parts) - 1:
                        page.put("".join(page.line))
                        page.line = []
            continue
        if kind == "out":
            e, saved = rest
            page.end(1 if e.name in SPACED and not (e.name in ("ul", "ol", "menu", "dir") and saved) else 0)
            page.mark = ""
            page.prefix = saved
            continue
        e, pre, lists = rest
        if e.hidden:
            continue
        if e.name == "br":
            page.newline()
            continue
        if e.name == "hr":
            page.end(1)
            continue
        if e.name == "table":
            page.end(1)
            for line in e.lines:
                page.put(line)
            e.lines = None
            page.end(1)
            continue
        if e.name in BLOCK:
            page.end(1 if e.name in SPACED and not (e.name in ("ul", "ol", "menu", "dir") and lists) else 0)
            work.append(("out", e, page.prefix))
            if e.name in ("ul", "menu", "dir"):
                lists = (None,)
            elif e.name == "ol":
                lists = ([e.start],)
            elif e.name == "li":
                counter = lists[-1] if lists else None
                page.mark = "- " if counter is None else f"{counter[0]}. "
                if counter is not None:
                    counter[0] += 1
                page.prefix = (page.prefix + " " * len(page.mark))[: max(INDENT, len(page.mark))]
            elif e.name in ("blockquote", "dd"):
                page.prefix = (page.prefix + "  ")[:INDENT]
            pre = pre or e.name in ("pre", "listing", "xmp", "plaintext")
        for c in reversed(shown(e)):
            work.append(("text", c, pre) if isinstance(c, str) else ("in", c, pre, lists))
    page.end()
    return "\n".join(page.lines)


def table_lines(table: Element) -> Iterator[str]:
    """Rows with cells padded to the width of their column; a cell of several lines takes several lines.

    A cell takes the first free place of its row and covers as many columns and rows as it says.  Its text stands in the
    row and column where it begins; what it is wider than its columns widens the last of them.
    """
    rows, outside = [], Element("div")
    stack = list(reversed(table.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            if c.strip():
                outside.children.append(c)
        elif c.hidden:
            continue
        elif c.name in ("tbody", "thead", "tfoot"):
            stack += reversed(c.children)
        elif c.name == "tr":
            row = []
            for d in c.children:
                if isinstance(d, str):
                    if d.strip():
                        outside.children.append(d)
                elif d.name in ("td", "th"):
                    row.append(d)
                elif not d.hidden:
                    outside.children.append(d)
            rows.append(row)
        elif c.name not in ("col", "colgroup"):
            outside.children.append(c)
    if outside.children and (text := cell_text(outside)):  # captions and text that stands between rows
        yield from text.split("\n")
    grid = placed_cells(rows)
    # columns that no cell begins or ends in are one
    edges = {x: k for k, x in enumerate(sorted({x for placed in grid for a, n, _ in placed for x in (a, a + n)}))}
    grid = [[(edges[a], edges[a + n], lines) for a, n, lines in placed] for placed in grid]
    ends = column_ends(grid, len(edges))
    dense = not ends or ends[-1] <= WIDE
    for placed in grid:
        for i in range(max((len(lines) for *_, lines in placed), default=0)):
            line, at = [], 0
            placed = placed if dense else [c for c in placed if i < len(c[2])]
            for first, to, lines in placed:
                x = lines[i] if i < len(lines) else ""
                line += blanks(ends, at, first, dense)
                room = ends[to] - ends[first] - 3 - width(x)
                line.append(x + " " * (room if dense else min(room, WIDE)))
                at = to
            yield " | ".join(line).rstrip()


def placed_cells(rows: list[list[Element]]) -> list[list[tuple[int, int, list[str]]]]:
    """Per row the cells' first column, number of columns and lines."""
    grid, spans = [], []  # spans: columns that cells above cover, as (first, end, last row), ascending
    for r, row in enumerate(rows):
        placed, at, k, below = [], 0, 0, []
        if any(s[2] < r for s in spans):
            spans = [s for s in spans if s[2] >= r]
        for d in row:
            while k < len(spans) and spans[k][0] <= at:
                at = max(at, spans[k][1])
                k += 1
            placed.append((at, d.across, [] if d.hidden else cell_text(d).split("\n")))
            if d.down > 1:
                below.append((at, at + d.across, min(r + d.down, len(rows)) - 1))
            at += d.across
        grid.append(placed)
        if below:
            merged: list[tuple[int, int, int]] = []
            for first, end, till in sorted(spans + below):
                if merged and first <= merged[-1][1] and (till == merged[-1][2] or first < merged[-1][1]):
                    merged[-1] = (merged[-1][0], max(end, merged[-1][1]), max(till, merged[-1][2]))
                else:
                    merged.append((first, end, till))
            spans = merged
    return grid


def column_ends(grid: list[list[tuple[int, int, list[str]]]], columns: int) -> list[int]:
    """Where each column begins: the widths of those before, with a bar behind each.  Narrow cells first; what a wide one lacks goes to its last column."""
    wide, sums = [0] * columns, [0] * (columns + 1)  # sums: a binary indexed tree over the widths

    def widen(k: int, by: int) -> None:
        wide[k] += by
        k += 1
        while k <= columns:
            sums[k] += by
            k += k & -k

    def before(k: int) -> int:
        out = 0
        while k:
            out += sums[k]
            k -= k & -k
        return out

    for first, to, lines in sorted((c for placed in grid for c in placed), key=lambda c: c[1] - c[0]):
        need = min(max(map(width, lines), default=0), WIDE) - (before(to - 1) - before(first) + 3 * (to - 1 - first))
        if need > wide[to - 1]:
            widen(to - 1, need - wide[to - 1])
    ends = [0]
    for w in wide:
        ends.append(ends[-1] + w + 3)
    return ends


def blanks(ends: list[int], at: int, to: int, dense: bool) -> list[str]:
    """Empty columns; no more than WIDE of the last ones in a table that is not dense."""
    if not dense:
        at = max(at, bisect_right(ends, ends[to] - WIDE, at, to))
    return [" " * (ends[k + 1] - ends[k] - 3) for k in range(at, to)]


def cell_text(cell: Element) -> str:
    body = Element("div")
    body.children = cell.children
    return flow(body)


def visible_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", outputs: tuple[str, ...] = ("text",)) -> DataFrame:
    """One row per page: id and any of ``text``, ``n_chars``, ``n_lines``, ``text_sha256``."""
    kinds = {"text": "string", "n_chars": "long", "n_lines": "long", "text_sha256": "string"}
    source = pages.select(F.col(id_col), F.col(html_col))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, " + ", ".join(f"{o} {kinds[o]}" for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [visible_text(x.as_py()) for x in part.column(1)]
                made = {
                    "text": lambda: pa.array(texts, pa.string()),
                    "n_chars": lambda: pa.array([len(t) for t in texts], pa.int64()),
                    "n_lines": lambda: pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                    "text_sha256": lambda: pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([part.column(0), *(made[o]() for o in outputs)], names=[id_col, *outputs])

    return map_arrow(source, run, schema)
