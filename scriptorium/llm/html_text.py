"""HTML extraction by layout-aware rendering.

Method: a tokenizer and a tree builder with implied tags (paragraphs, list items, table parts and options close by
themselves; misplaced end tags are ignored, but that of a paragraph makes an empty one, and that of a formatting element ends
no block; a body is implied) feed a renderer. Hidden content (scripts, styles, the head, templates, closed details
and dialogs, the hidden attribute, display:none, visibility:hidden but for what is visible in it) is left out, by attributes and by
the rules of style sheets for tags, classes and ids (the last rule counts; other selectors and @-rules are not read). Elements stand on
lines of their own if they are blocks, by their tag or their display, with a blank line where browsers put a margin;
white space collapses but in preformatted text; lists get markers (numbers, letters, Roman numerals, in either direction) and indents;
table cells are padded to the width of their column, with column and row spans.

Tokenizer and tree builder take time in proportion to the page, at any depth, and so does the renderer but for tables
in tables, whose lines are padded at each level. Nothing recurses.

Defined cases: a null or empty page gives an empty text. Malformed markup never fails: what is no tag is text. A
quotation mark in a tag that never closes is no quotation mark, nor is any behind it. Elements nest to any depth; lines
are indented by INDENT characters at most, and columns padded to WIDEST, where longer cells run over. Repeated rows are
rendered each. An empty table gives an empty result. Pages of any length are rendered whole. Other columns are ignored
by the query.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The widest indent of a line, and the widest padding of a column.
INDENT, WIDEST = 200, 500
_NAME = re.compile(r"[^\s/>]+")
#: An attribute with what stands before it; name and value may be missing.
_ATTR = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?)?""")
#: The same where quotation marks don't count.
_LOOSE = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*["']?()()([^\s>"']*)["']?)?)?""")
_COMMENT_END = re.compile(r"--!?>|(?<=<!--)-?>")
_GAP = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript datalist iframe noembed noframes object audio video canvas desc metadata defs annotation annotation-xml meta link base area param source track col colgroup".split())
BLOCK = frozenset("html body address article aside div dl dt dd fieldset footer form header hgroup legend main nav section summary details dialog center li figcaption caption optgroup option".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir blockquote pre listing xmp figure table hr".split())
#: What the start of an element closes, if it is open, up to the elements that bound the search.
_P_ENDS = BLOCK | SPACED - {"optgroup", "option"}
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"table", "tr"})), "th": (frozenset({"td", "th", "caption"}), frozenset({"table", "tr"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup", "tr"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})), "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}
CLOSES["thead"] = CLOSES["tfoot"] = CLOSES["tbody"]
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_P, _P_BOUNDS = frozenset({"p"}), frozenset({"table", "td", "th", "button", "body"})


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], children: list | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs, [] if children is None else children


class _Tokens:
    """The tags of a page, from left to right. A tag that is begun and never ended is text."""

    def __init__(self, html: str) -> None:
        self.html, self.last, self.attribute = html, html.rfind(">"), _ATTR

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """From behind a tag's name: its attributes, whether it ends in a slash, and where it ends."""
        html, out, start = self.html, {}, at
        while True:
            m = self.attribute.match(html, at)
            at = m.end()
            if m[1]:
                out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            if at > self.last:
                break
            if html[at] == ">":
                return out, html[at - 1] == "/", at + 1
            if m.end() == m.start() or html[at] in "\"'" and html[m.end(1) : at].strip() == "=":
                break
        # a mark that never closes: from here on they don't count, so that no part is looked at again and again
        self.attribute = _LOOSE
        at, end = start, html.find(">", start)
        out = {}
        while at < end:
            m = _LOOSE.match(html, at, end)
            if m[1]:
                out.setdefault(m[1].lower(), m[4] or "")
            at = max(m.end(), at + 1)
        return out, html[end - 1] == "/", end + 1


class _Open:
    """The open elements, and where those of each tag are."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, to: int) -> None:
        while len(self.nodes) > to:
            self.at[self.nodes.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """Where the innermost open element of these is; 0 for none."""
        found, at = 0, self.at
        for t in tags:
            if (places := at.get(t)) and places[-1] > found:
                found = places[-1]
        return found

    def close(self, tags: frozenset[str], bounds: frozenset[str]) -> None:
        """The outermost open element of tags inside the bounds ends, with all in it."""
        open_ = [places for t in tags if (places := self.at.get(t))]
        if open_:
            bound, found = self.last(bounds), len(self.nodes)
            for places in open_:
                k = bisect_right(places, bound)
                if k < len(places):
                    found = min(found, places[k])
            self.cut(found)


_CELL_PARTS = frozenset("table tr tbody thead tfoot body td th".split())


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    tokens, open_ = _Tokens(html), _Open(root)
    stack, at, begun, end = open_.nodes, 0, 0, len(html)

    def text(a: int, b: int) -> None:
        if a < b:
            stack[-1].children.append(unescape(html[a:b]) if html.find("&", a, b) >= 0 else html[a:b])

    def add(tag: str) -> None:
        node = Node(tag, {})
        stack[-1].children.append(node)
        open_.push(node)

    while (i := html.find("<", at)) >= 0:
        c = html[i + 1 : i + 2]
        if c in ("!", "?"):
            text(begun, i)
            if html.startswith("--", i + 2):
                stop = _COMMENT_END.search(html, i + 4)
                at = stop.end() if stop else end
            else:
                at = html.find(">", i) + 1 or end
            begun = at
            continue
        closing = c == "/"
        first = html[i + 1 + closing : i + 2 + closing]
        if not (first.isascii() and first.isalpha()) or i > tokens.last:
            at = i + 1  # a text's character
            continue
        m = _NAME.match(html, i + 1 + closing)
        tag = m[0].lower()
        text(begun, i)
        if closing:
            at = begun = html.find(">", m.end()) + 1
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            found = open_.last((tag,))
            if tag in FORMATTING and found and found < open_.last(_P_ENDS):
                continue
            if tag == "p" and found <= open_.last(_P_BOUNDS):
                stack[-1].children.append(Node("p", {}))
                continue
            if found and (tag in _CELL_PARTS or found > open_.last(("td", "th", "table"))):  # an end tag doesn't reach out of a table cell
                open_.cut(found)
            continue
        attrs, slash, at = tokens.attributes(m.end())
        begun = at
        if tag == "html":
            root.attrs.update(attrs)
            continue
        if tag in CLOSES:
            open_.close(*CLOSES[tag])
        if tag in _P_ENDS:
            open_.close(_P, _P_BOUNDS)
        if stack[-1].tag == "head" and tag not in HIDDEN:
            open_.cut(len(stack) - 1)
        if tag == "tr" and stack[-1].tag == "table":
            add("tbody")
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            add("tr")
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            to = stop.start() if stop else end
            if at < to:
                node.children.append(unescape(html[at:to]) if tag in ("textarea", "title") else html[at:to])
            at = begun = (html.find(">", to) + 1 or end) if stop else end
        elif tag not in VOID and not (slash and tag in ("svg", "math", "path")):
            open_.push(node)
    text(begun, end)
    return root


_RULE = re.compile(r"([^{}@;]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-z][a-z0-9]*)?([.#][^\s.#:\[>+~*]+)?")


def declared(style: str) -> dict[str, str]:
    """display and visibility of a style's declarations; the last ones count."""
    out = {}
    for d in style.lower().split(";"):
        name, _, value = d.partition(":")
        if (name := name.strip()) in ("display", "visibility"):
            out[name] = value.replace("!important", "").strip()
    return out


def _sheet(css: str) -> list[tuple[str, str, dict[str, str]]]:
    """(tag, .class or #id, declarations) of the rules with simple selectors outside of @-rules."""
    css = re.sub(r"/\*.*?(?:\*/|$)", " ", css, flags=re.S)
    depth, begun, top = 0, 0, []
    for m in re.finditer(r"[{}]", css):  # blocks in blocks belong to an @-rule
        depth += 1 if m[0] == "{" else -1
        if depth <= 0:
            top.append(css[begun : m.end()])
            depth, begun = 0, m.end()
    out = []
    for block in top:
        if (m := _RULE.fullmatch(block.strip())) and (found := declared(m[2])):
            out += [(x[1] or "", x[2] or "", found) for sel in m[1].split(",") if (x := _SIMPLE.fullmatch(sel.strip())) and x[0]]
    return out


def _styled(root: Node) -> None:
    """Puts what style sheets say of display and visibility into the elements' own styles, before what stands there."""
    nodes, todo, css = [], [root], []
    while todo:
        x = todo.pop()
        nodes.append(x)
        if x.tag == "style":
            css += [c for c in x.children if isinstance(c, str)]
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    by: dict[str, list] = {}
    for k, (tag, name, found) in enumerate(_sheet("\n".join(css))):
        by.setdefault(name or tag, []).append((bool(name), k, tag, found))
    if not by:
        return
    for x in nodes:
        keys = [x.tag, *(f".{c}" for c in x.attrs.get("class", "").split()), f"#{x.attrs.get('id', '')}"]
        hits = sorted((r for key in keys for r in by.get(key, ()) if r[2] in ("", x.tag)), key=lambda r: r[:2])
        if hits:
            x.attrs["style"] = "".join(f"{n}:{v};" for *_, found in hits for n, v in found.items()) + x.attrs.get("style", "")


def style_of(node: Node) -> dict[str, str]:
    return declared(style) if node.attrs and (style := node.attrs.get("style")) else {}


def visible(node: Node) -> bool:
    """Whether the element is there at all; see also unseen."""
    if node.tag in HIDDEN:
        return False
    if not (a := node.attrs):
        return node.tag != "dialog"
    if "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() not in ("submit", "button", "reset")):
        return False
    return style_of(node).get("display") != "none"


def unseen(node: Node) -> bool:
    """Whether the element takes its place unseen; what is visible in it shows."""
    return style_of(node).get("visibility") in ("hidden", "collapse")


def _shown(node: Node) -> list[Node]:
    """The outermost elements in an unseen one that are visible."""
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and visible(x):
            if style_of(x).get("visibility") == "visible":
                out.append(x)
            else:
                todo += reversed(x.children)
    return out


class Flow:
    """Lines in the making, in a stack of parts (list items, quotations) that put something before their lines.

    A part begins with its first line that isn't empty, and loses the empty lines at its end."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.margin = 0
        self.prefix = ""  # of all lines in the parts that have begun
        self.parts: list[list] = [["", "", 0, 0]]  # before the first line, before the others, lines and length of the prefix before
        self.waiting = 1  # parts, the innermost, that haven't begun

    def put(self, text: str, pre: bool = False) -> None:
        if pre:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self._add(first)
            for x in more:
                self.break_(keep=True)
                self._add(x)
            return
        text = _GAP.sub(" ", text)
        if text[:1] == " " and (not self.line or self.line[-1][-1:] == " "):
            text = text[1:]
        self._add(text)

    def _add(self, text: str) -> None:
        if text:
            self.line.append(text)

    def break_(self, keep: bool = False) -> None:
        """Ends the line; keep: an empty one counts as well."""
        if self.line or keep:
            text = "".join(self.line).replace("\xa0", " ").rstrip(" ")
            self.line = []
            self._end(text)

    def _end(self, text: str) -> None:
        if not text and self.waiting:
            return
        if self.lines:
            self.lines += [""] * self.margin
        self.margin = 0
        before = self.prefix
        if self.waiting:
            for part in self.parts[-self.waiting :]:
                before += part[0]
                part[2:] = len(self.lines), len(self.prefix)
                if len(self.prefix) < INDENT:
                    self.prefix += part[1]
            self.waiting = 0
        self.lines.append(before + text if text else "")

    def space(self, margin: int) -> None:
        self.break_()
        if not self.waiting:
            self.margin = max(self.margin, margin)

    def take(self, lines: list[str]) -> None:
        """Whole lines."""
        self.break_()
        for x in lines:
            self._end(x)

    def enter(self, first: str, other: str) -> None:
        self.break_()
        self.parts.append([first, other, 0, 0])
        self.waiting += 1

    def leave(self) -> None:
        self.break_()
        _, _, start, prefix = self.parts.pop()
        if self.waiting:
            self.waiting -= 1
            return
        while len(self.lines) > start and not self.lines[-1]:
            self.lines.pop()
        self.margin, self.prefix = 0, self.prefix[:prefix]

    def done(self) -> list[str]:
        self.break_()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(text: str | None, least: int, most: int, other: int) -> int:
    return min(max(int(text), least), most) if text and text.strip().isdigit() and len(text) < 10 else other


class Item:
    """A list item with its mark."""

    __slots__ = ("mark", "node")

    def __init__(self, mark: str, node: Node) -> None:
        self.mark, self.node = mark, node


class Cell:
    """A table cell with the lines that come of it."""

    __slots__ = ("children", "flow", "right", "wide")

    def __init__(self, children: list, wide: int, right: bool) -> None:
        self.children, self.wide, self.right, self.flow = children, wide, right, Flow()

    @property
    def lines(self) -> list[str]:
        return self.flow.lines


def _split(table: Node) -> tuple[list[tuple[int, Node]], list[list]]:
    """A table's rows (with 0 for the head, 2 for the foot), and what stands between them, in groups.

    Rows are also those in sections and in other elements that are open around them, such as a form."""
    frames: list[tuple] = [(table, 1, iter(table.children), [], [[]])]
    while True:
        node, order, left, rows, stray = frames[-1]
        for c in left:
            if isinstance(c, str):
                if c.strip() or stray[-1]:
                    stray[-1].append(c)
            elif not visible(c):
                continue
            elif c.tag == "tr":
                rows.append((order, c))
                stray.append([])
            elif c.tag == "table" or c.tag == "details" and "open" not in c.attrs:
                stray[-1].append(c)
            else:
                frames.append((c, {"thead": 0, "tfoot": 2}.get(c.tag, order), iter(c.children), [], [[]]))
                break
        else:
            frames.pop()
            if not frames:
                return rows, stray
            above, groups = frames[-1][3], frames[-1][4]
            if node.tag in ("tbody", "thead", "tfoot"):
                groups += [*stray, []]
            elif rows:
                for group in stray:
                    part = Node(node.tag, node.attrs)
                    part.children += group
                    groups.append([part] if group else [])
                groups.append([])
            else:
                groups[-1].append(node)
            above += rows


def _grid(rows: list[Node]) -> list[dict[int, Cell]]:
    """The cells of each row by column."""
    grid: list[dict[int, Cell]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell from above still covers
    for row in rows:
        cells: dict[int, Cell] = {}
        column, fresh = 0, {}
        for c in row.children:
            if not isinstance(c, Node):
                content, attrs = ([c], {}) if c.strip() else (None, {})
            else:
                content, attrs = (c.children if c.tag in ("td", "th") else [c], c.attrs) if visible(c) else (None, {})
            if content is None:
                continue
            while taken.get(column, 0) > 0:
                column += 1
            wide, high = _number(attrs.get("colspan"), 1, 1000, 1), _number(attrs.get("rowspan"), 1, 65534, 1)
            right = attrs.get("align", "").lower() == "right" or "text-align:right" in "".join(attrs.get("style", "").lower().split())
            cells[column] = Cell(content, wide, right)
            if high > 1:
                for k in range(column, column + wide):
                    fresh[k] = high - 1
            column += wide
        taken = {k: n - 1 for k, n in taken.items() if n > 1} | fresh
        grid.append(cells)
    return grid


def table_lines(grid: list[dict[int, Cell]]) -> list[str]:
    """A table's rows with its cells, which are rendered, padded to the widths of their columns."""
    widths: dict[int, int] = {}
    for cells in grid:
        for k, c in cells.items():
            if c.wide == 1:
                widths[k] = min(max(widths.get(k, 0), *map(len, c.lines), 0), WIDEST)
    for cells in grid:
        for k, c in cells.items():
            if c.wide > 1:
                have = sum(widths.get(j, 0) for j in range(k, k + c.wide)) + 2 * (c.wide - 1)
                widths[k] = widths.get(k, 0) + max(0, min(max(map(len, c.lines), default=0), WIDEST) - have)
    last = max((k + c.wide for cells in grid for k, c in cells.items()), default=0)
    start, at = {}, 0
    for k in range(last):
        start[k] = at
        at += widths.get(k, 0) + 2
    out = []
    for cells in grid:
        for i in range(max((len(c.lines) for c in cells.values()), default=0)):
            line = ""
            for k in sorted(cells):
                c = cells[k]
                if i < len(c.lines):
                    room = sum(widths.get(j, 0) for j in range(k, k + c.wide)) + 2 * (c.wide - 1)
                    line = line + "  " if len(line) + 1 > start[k] > 0 else line.ljust(start[k])
                    line += c.lines[i].rjust(room) if c.right else c.lines[i]
            out.append(line.rstrip())
    return out


def _numeral(n: int, kind: str) -> str:
    """A number as a list of this type writes it: a, A, i, I, or else in digits."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(ord(kind) + k) + out
        return out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (n // value)
            n %= value
        return out.upper() if kind == "I" else out
    return str(n)


def _items(node: Node) -> Iterator:
    """A list's items with their marks; None, for a break, and the node for what is no item."""
    back = node.tag == "ol" and "reversed" in node.attrs
    own = sum(isinstance(c, Node) and c.tag == "li" and visible(c) for c in node.children) if back else 1
    number, kind = _number(node.attrs.get("start"), 0, 10**9, own), node.attrs.get("type", "")
    for c in node.children:
        if isinstance(c, Node) and c.tag == "li":
            if visible(c):
                number = _number(c.attrs.get("value"), 0, 10**9, number)
                if unseen(c):
                    yield from _shown(c)
                else:
                    yield Item(f"{_numeral(number, kind)}. " if node.tag == "ol" else "- ", c)
                number += -1 if back else 1
        else:
            yield None
            yield c


def rendered(nodes: list) -> list[str]:
    """The lines of nodes. Frames hold what is left of an element, its flow, and what comes at its end."""
    root = Flow()
    frames: list[tuple[Iterator, bool, Flow, Callable | None]] = [(iter(nodes), False, root, None)]
    while frames:
        left, pre, flow, end = frames[-1]
        for x in left:
            if isinstance(x, str):
                flow.put(x, pre)
            elif x is None:
                flow.break_()
            elif isinstance(x, Item):
                flow.enter(x.mark, " " * len(x.mark))
                frames.append((iter(x.node.children), pre, flow, flow.leave))
                break
            elif isinstance(x, Cell):
                frames.append((iter(x.children), False, x.flow, x.flow.done))
                break
            elif visible(x) and unseen(x):
                frames.append((iter(_shown(x)), pre, flow, None))
                break
            elif visible(x) and (frame := _begun(x, pre, flow)):
                frames += frame
                break
        else:
            frames.pop()
            if end:
                end()
    return root.done()


def _begun(x: Node, pre: bool, flow: Flow) -> list[tuple] | None:
    """Frames for an element's content, the last first."""
    tag = x.tag
    display = style_of(x).get("display", "")
    if display.startswith("inline") and (tag in BLOCK or tag in SPACED and tag not in ("ul", "ol", "menu", "dir", "table")):
        return [(iter(x.children), pre, flow, None)]
    if display in ("block", "flex", "grid", "list-item", "table", "flow-root") and tag not in BLOCK and tag not in SPACED and tag not in ("br", "input", "dd", "details", "textarea"):
        flow.break_()
        return [(iter(x.children), pre, flow, flow.break_)]
    if tag == "br":
        flow.break_(keep=True)
    elif tag == "input":
        flow.put(unescape(x.attrs.get("value", "")))
    elif tag in ("ul", "ol", "menu", "dir"):
        flow.space(1)
        return [(_items(x), pre, flow, lambda: flow.space(1))]
    elif tag == "table":
        flow.space(1)
        rows, stray = _split(x)
        grid = _grid([r for _, r in sorted(rows, key=lambda r: r[0])])
        cells = [c for row in grid for c in row.values()]

        def end() -> None:
            flow.take(table_lines(grid))
            flow.space(1)

        last = (iter(cells), False, flow, end)
        if len(cells) == 1 and not cells[0].right:  # nothing to align: the cell's content in a part of its own
            last = (iter([Item("", Node("td", {}, cells[0].children))]), False, flow, lambda: flow.space(1))
        # what stands in a table but in no row comes first, as browsers move it
        return [last, (iter([y for group in stray for y in (*group, None)]), pre, flow, None)]
    elif tag in ("blockquote", "dd"):
        margin = int(tag == "blockquote")

        def end() -> None:
            flow.leave()
            flow.space(margin)

        flow.space(margin)
        flow.enter("  ", "  ")
        return [(iter(x.children), pre, flow, end)]
    elif tag in ("pre", "listing", "xmp", "textarea"):
        flow.space(1)
        inner = x.children
        if inner and isinstance(inner[0], str) and inner[0][:1] == "\n":
            inner = [inner[0][1:], *inner[1:]]
        return [(iter(inner), True, flow, lambda: flow.space(1))]
    elif tag in SPACED:
        flow.space(1)
        return [(iter(x.children), pre, flow, lambda: flow.space(1))]
    elif tag == "details" and "open" not in x.attrs:
        flow.break_()
        return [(iter([c for c in x.children if isinstance(c, Node) and c.tag == "summary"][:1]), pre, flow, flow.break_)]
    elif tag in BLOCK:
        flow.break_()
        return [(iter(x.children), pre, flow, flow.break_)]
    elif x.children:
        return [(iter(x.children), pre, flow, None)]
    return None


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    root = parse(html)
    if "<style" in html or "<STYLE" in html or "<Style" in html:
        _styled(root)
    return "\n".join(rendered(root.children))


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' columns but html, with text. No shuffle."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([render(x) for x in column.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    rest = [c for c in pages.columns if c not in (html, "text")]
    return pages.select(*(F.col(f"`{c}`") for c in rest), F.arrow_udf(run, "string")(html).alias("text"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
SQL: dict[str, str] = {}
