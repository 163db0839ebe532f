"""HTML to text by layout: a tree with implied tags, visibility rules, block spacing, lists and aligned tables."""

from __future__ import annotations

import re
from bisect import bisect, bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, read

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base iframe embed audio video canvas map area datalist noembed noframes param source track rp annotation annotation-xml desc defs metadata symbol clippath mask pattern".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre search section summary table ul xmp option optgroup caption tr thead tbody tfoot".split())
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol pre table ul form fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
#: An opening tag closes these open elements, up to the nearest of the second set.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "thead", "tbody", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tbody": (frozenset(["caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
IMPLIED["caption"] = IMPLIED["colgroup"] = IMPLIED["thead"]
#: Elements that hold only table parts; text and other elements inside them are laid out before the table.
GRID = frozenset("table thead tbody tfoot tr".split())
PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
CELLS = frozenset("td th caption".split())
TABLE, P, CELL_OR_TABLE, ROW_ENDS = frozenset(["table"]), frozenset(["p"]), frozenset("td th table".split()), frozenset("table tr tbody thead tfoot".split())
SCOPES = frozenset("html table td th caption button object".split())

#: Inputs that show neither a value nor a placeholder, and elements whose first line break is not shown.
NO_VALUE = frozenset("hidden password checkbox radio file range color".split())
FIRST_BREAK = frozenset("pre listing textarea".split())
#: Values of ``display`` that set an element apart like a block.
BLOCK_DISPLAY = frozenset("block flow-root flex grid list-item table".split())
#: The padding of a page's tables is at most so many characters for each of its own, and so many beside; a table beyond what is left is not padded.
PADDING, PADDING_FREE = 20, 10_000

LISTS = frozenset(["ul", "ol", "menu", "dir"])
#: Elements in whose content ``/>`` closes an element.
FOREIGN = frozenset(["svg", "math"])
#: Fixed values of the HTML standard: what wider and longer cells are cut to.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
#: The next attribute of a tag or its end. A quote counts only after an equals sign; one that is never closed ends the page.
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"?)|'([^']*+)('?)|([^\s>]*+)))?+)")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes(html: str, at: int) -> tuple[dict, int] | None:
    """The attributes of a tag from ``at`` on and the place behind its end; none if the page ends inside it."""
    found = {}
    while m := ATTRIBUTE.match(html, at):
        at = m.end()
        if m[1]:
            return found, at
        if m[3] is not None and not m[4] or m[5] is not None and not m[6]:
            return None
        found.setdefault(m[2].lower(), unescape(m[3] or m[5] or m[7] or ""))
    return None


class Open:
    """The open elements, and for each tag their places, so that no search walks through them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, i: int) -> None:
        """Close the element at place i and all inside it."""
        while len(self.nodes) > i:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags: frozenset) -> int:
        """Place of the innermost open element of these tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first_after(self, tags: frozenset, i: int) -> int:
        """Place of the outermost open element of these tags inside the one at place i, or 0."""
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect(p, i)) < len(p)]
        return min(found, default=0)

    @property
    def tag(self) -> str:
        return self.nodes[-1].tag

    def put(self, x: Node | str) -> None:
        """Add ``x`` to the innermost element; what is no part of a table goes before the table (foster parenting)."""
        if self.tag in GRID and (x.strip() if isinstance(x, str) else x.tag not in PARTS) and (i := self.last(TABLE)):
            above, table = self.nodes[i - 1].children, self.nodes[i]
            above.insert(next(k for k in range(len(above) - 1, -1, -1) if above[k] is table), x)
        else:
            self.nodes[-1].children.append(x)


def tree(html: str) -> Node:
    """Nodes of a page, in one pass. Missing end tags are implied, unmatched ones are dropped, raw text ends at its own tag.

    Content of a table outside its cells stands before the table; a form between row and cell is transparent.
    """
    root = Node("html", {})
    stack, at, n = Open(root), 0, len(html)
    while at < n:
        text_end = html.find("<", at)
        text_end = n if text_end < 0 else text_end
        tag = TAG.match(html, text_end)
        markup = html.startswith(("<!", "<?", "</"), text_end)
        if not tag and not markup and text_end < n:  # a lone sign is text, up to the next one
            next_sign = html.find("<", text_end + 1)
            text_end = n if next_sign < 0 else next_sign
            stack.put(unescape(html[at:text_end]))
            at = text_end
            continue
        if text := html[at:text_end]:
            if stack.tag == "colgroup" and text.strip():
                stack.cut(len(stack.nodes) - 1)
            stack.put(unescape(text))
        if text_end == n:
            break
        if not tag:
            close = "-->" if html.startswith("<!--", text_end) else ">"
            # the dashes that open a comment can close it
            end = html.find(close, text_end + 2)
            at = n if end < 0 else end + len(close)
            continue
        if (found := attributes(html, tag.end())) is None:
            break
        given, at = found
        own_end = html[at - 2] == "/"
        name = tag[2].lower()
        if tag[1]:
            i = stack.places.get(name, [0])[-1] if stack.places.get(name) else 0
            if i and (name in ROW_ENDS or i >= stack.last(CELL_OR_TABLE)):
                stack.cut(i)
            continue
        if name == "html":
            root.attributes = {**given, **root.attributes}
            continue
        closes, until = IMPLIED.get(name, (None, None))
        if name in ENDS_P:
            closes, until = P, SCOPES
        if closes and (i := stack.first_after(closes, stack.last(until))):
            stack.cut(i)
        grid, cell = stack.last(GRID), stack.last(CELLS)
        if name in PARTS and grid > cell:
            if name != "col" or stack.tag != "colgroup":
                stack.cut(grid + 1)
        elif stack.tag == "colgroup":
            stack.cut(len(stack.nodes) - 1)
        if stack.tag in GRID and (i := stack.last(TABLE)):
            if name == "form":
                continue
            if name == "table":
                stack.cut(i)
        if name in ("td", "th") and stack.tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            stack.nodes[-1].children.append(row)
            stack.push(row)
        node = Node(name, given)
        stack.put(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            node.children.append(unescape(html[at : end.start() if end else n]) if name in ("textarea", "title") else html[at : end.start() if end else n])
            at = html.find(">", end.start()) + 1 if end else n
            at = at or n
        elif name not in VOID and not (own_end and (name in FOREIGN or stack.last(FOREIGN))):
            stack.push(node)
    return root


def removed(node: Node) -> bool:
    """Whether nothing inside the element is laid out."""
    a = node.attributes
    return node.tag in HIDDEN or node.tag == "dialog" and "open" not in a or "hidden" in a or "style" in a and declared(a["style"], "display") == "none"


def declared(style: str, what: str) -> str | None:
    """The last value that a style gives to a property."""
    return next((v.lower() for k, v in reversed(STYLE.findall(style)) if k.lower() == what), None)


def shown(node: Node, before: bool) -> bool:
    """Whether text directly inside the element is seen: the nearest visibility counts."""
    value = declared(node.attributes["style"], "visibility") if "style" in node.attributes else None
    return before if value is None else value == "visible"


class Page:
    """Lines of rendered text; collapses white space outside of ``pre`` and blank lines between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.indent, self.blank, self.mark = "", "", False, ""
        self.lists = 0

    def text(self, x: str, pre: bool) -> None:
        if pre:
            first, *rest = x.replace("\r\n", "\n").split("\n")
            self.line += first
            for y in rest:
                self.end(True)
                self.line = y
            return
        x = SPACE.sub(" ", x)
        if not self.line or self.line.endswith(" "):
            x = x.lstrip(" ")
        self.line += x

    def end(self, keep_empty: bool = False) -> None:
        line = self.line.rstrip(" ")
        if line or keep_empty:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append((self.indent + self.mark + line).rstrip(" "))
            if self.mark:
                self.indent += " " * len(self.mark)
                self.mark = ""
        self.line = ""

    def space(self) -> None:
        self.end()
        self.blank = True


def span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "1").strip()
    return max(1, min(int(value[:6]), most)) if value.isascii() and value.isdigit() else 1


def rows_of(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions, and the cells of each row, of a table itself; what nested tables have belongs to their cell."""
    captions, rows, work = [], [], [iter(table.children)]
    while work:
        c = next(work[-1], None)
        if c is None:
            work.pop()
        elif isinstance(c, Node) and not removed(c):
            if c.tag == "tr":
                rows.append([d for d in c.children if isinstance(d, Node) and d.tag in ("td", "th") and not removed(d)])
            elif c.tag in ("thead", "tbody", "tfoot"):
                work.append(iter(c.children))
            elif c.tag == "caption":
                captions.append(c)
    return captions, rows


class Held:
    """Columns that cells of earlier rows reach down into: ranges by column, with the first row that is free again."""

    def __init__(self):
        self.ranges: list[tuple[int, int, int]] = []
        self.next: int | None = None

    def free(self, row: int) -> None:
        """Drop the ranges that end before ``row``; most rows end none."""
        if self.next is not None and row >= self.next:
            self.ranges = [r for r in self.ranges if r[2] > row]
            self.next = min((r[2] for r in self.ranges), default=None)

    def add(self, new: list[tuple[int, int, int]]) -> None:
        merged: list[tuple[int, int, int]] = []
        for a, b, until in sorted(self.ranges + new):
            if merged and merged[-1][1] >= a and merged[-1][2] == until:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), until)
            else:
                merged.append((a, b, until))
        self.ranges, self.next = merged, min(r[2] for r in merged)


def grid(table: Node, done: dict, room: list[int]) -> list[str]:
    """Lines of a table: cells padded to columns, as many lines as the longest cell of a row; spans leave places empty.

    ``room`` has the padding that is left for the page. A table that needs more has its cells side by side without padding.
    """
    captions, rows = rows_of(table)
    laid, held = [], Held()
    for at, row in enumerate(rows):
        held.free(at)
        line, column, i, new = {}, 0, 0, []
        for cell in row:
            while i < len(held.ranges) and held.ranges[i][0] <= column:
                column = max(column, held.ranges[i][1])
                i += 1
            line[column] = done[id(cell)]
            wide, high = span(cell, "colspan", MOST_COLUMNS), span(cell, "rowspan", MOST_ROWS)
            if high > 1:
                new.append((column, column + wide, at + high))
            column += wide
        laid.append(line)
        if new:
            held.add(new)
    # columns in which no cell begins have nothing to show
    widths: dict[int, int] = {}
    for line in laid:
        for c, lines in line.items():
            widths[c] = max([widths.get(c, 0), *map(len, lines)])
    columns = sorted(widths)
    upto = [0]
    for c in columns:
        upto.append(upto[-1] + widths[c] + 3)
    out = [x for c in captions for x in done[id(c)]]
    shape = [(line, max(map(len, line.values()), default=0), bisect_left(columns, max(line, default=-1) + 1)) for line in laid]
    padding = sum(high * upto[n] for _, high, n in shape) - sum(len(x) for line in laid for lines in line.values() for x in lines)
    padded = padding <= room[0]
    room[0] -= max(padding, 0) if padded else 0
    for line, high, n in shape:
        for k in range(high):
            if padded:
                out.append(" | ".join((line[c][k] if c in line and k < len(line[c]) else "").ljust(widths[c]) for c in columns[:n]).rstrip(" "))
            else:
                out.append(" | ".join(lines[k] for lines in line.values() if k < len(lines)))
    return out


def render(root: Node) -> str:
    """All visible text below ``root``. Elements and tables nest without limit: inner tables are laid out before outer ones."""
    tables, work, size = [], [(root, True)], 0
    while work:
        x, seen = work.pop()
        seen = shown(x, seen)
        size += sum(len(c) for c in x.children if isinstance(c, str))
        if x.tag == "table":
            tables.append((x, seen))
        work += [(c, seen) for c in x.children if isinstance(c, Node) and not removed(c)]
    done: dict = {}
    room = [PADDING * size + PADDING_FREE]
    # a table is met before those inside it
    for table, seen in reversed(tables):
        captions, rows = rows_of(table)
        for part in [*captions, *(c for r in rows for c in r)]:
            done[id(part)] = flow(part, done, shown(part, seen))
        done[id(table)] = grid(table, done, room)
    return "\n".join(flow(root, done, True))


def block(node: Node) -> bool:
    return node.tag in BLOCKS or "style" in node.attributes and declared(node.attributes["style"], "display") in BLOCK_DISPLAY


def number(value: str | None, other: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", value) else other


def flow(root: Node, done: dict, visible: bool) -> list[str]:
    """Lines of the visible text inside one element; tables come from ``done``."""
    page = Page()
    work: list = [("open", c, False, None, visible) for c in reversed(root.children)]
    while work:
        step, x, pre, saved, seen = work.pop()
        if step == "close":
            if x.tag in LISTS:
                page.lists -= 1
            if block(x):
                page.space() if x.tag in SPACED and not (x.tag in LISTS and page.lists) else page.end()
            if saved is not None:
                page.indent, page.mark = saved, ""
            elif x.tag == "q" and seen:
                page.text('"', True)
            continue
        if isinstance(x, str):
            if seen:
                page.text(x, pre)
            continue
        if removed(x):
            continue
        seen = shown(x, seen)
        if x.tag == "br":
            page.end(True)
        elif x.tag == "hr":
            page.space()
        elif x.tag == "img":
            if x.attributes.get("alt") and seen:
                page.text(x.attributes["alt"], False)
        elif x.tag == "input":
            kind = x.attributes.get("type", "text").strip().lower()
            value = x.attributes.get("alt" if kind == "image" else "value") or x.attributes.get("placeholder")
            if seen and value and kind not in NO_VALUE:
                page.text(value, False)
        elif x.tag == "table":
            page.space()
            for line in done[id(x)]:
                page.line = line
                page.end(True)
            page.space()
        else:
            if block(x):
                page.space() if x.tag in SPACED and not (x.tag in LISTS and page.lists) else page.end()
            saved = None
            page.lists += x.tag in LISTS
            if x.tag in ("blockquote", "dd"):
                saved = page.indent
                page.indent += "  "
            inner = x.children
            if x.tag == "ol":
                items = [c for c in inner if isinstance(c, Node) and c.tag == "li" and not removed(c)]
                back = "reversed" in x.attributes
                i = number(x.attributes.get("start"), len(items) if back else 1)
                for c in items:
                    i = number(c.attributes.get("value"), i)
                    c.attributes.setdefault("_n", f"{i}. ")
                    i += -1 if back else 1
            if x.tag == "optgroup" and seen and x.attributes.get("label"):
                page.text(x.attributes["label"], False)
                page.end()
            if x.tag == "li":
                saved = page.indent
                page.mark = x.attributes.get("_n", "- ")
            if x.tag == "q" and seen:
                page.text('"', True)
            work.append(("close", x, pre, saved, seen))
            if x.tag in FIRST_BREAK and inner and isinstance(inner[0], str):
                inner = [re.sub(r"\A\r?\n", "", inner[0]), *inner[1:]]
            now = pre or x.tag in ("pre", "listing", "plaintext", "textarea")
            work += [("open", c, now, None, seen) for c in reversed(inner)]
    page.end()
    return page.lines


def visible_text(df: DataFrame, html: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: the visible text of each whole page.

    Blocks stand on their own lines, paragraphs, lists and tables between blank lines; list items have marks,
    table cells are padded to columns and keep their lines (side by side without padding, once a page's tables would have more than PADDING
    characters of it for each character of text); options, values of inputs and text in drawings and formulas are shown; pages nest without limit. A tag that the page's end
    cuts off ends the text. Null and empty pages give an empty text; equal rows equal results; a
    column called ``out`` is replaced, others pass through.
    """
    return map_texts(df, lambda pages: [render(tree(x)) for x in pages], T.StringType(), pa.string(), out, html, keep)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = visible_text(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).cast("long").alias("n_lines"))
