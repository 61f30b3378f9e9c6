"""HTML extraction by layout-aware rendering: all visible text, with block spacing, lists and tables.

A tokenizer cuts the page into tags and text as browsers do. The tree builder closes elements that
HTML closes by itself (a paragraph ends at the next block, a list item at the next one), gives
stray cells a row, moves what else stands between the parts of a table before it, and marks what a
browser doesn't show. The renderer walks the tree: blocks start lines, paragraphs and headings are
set apart by an empty line, list items get a bullet or their number, table cells are padded so
that columns line up.

Every step is linear in the page but for factors that are bounded here: elements nest ``DEEPEST``
deep (deeper ones stand beside each other, as in browsers), and layout, never text, stops at
``INDENT`` and ``ALIGNED`` characters.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from ._store import lean, pick, tune

DEEPEST = 300
INDENT = 64
ALIGNED = 400
#: A column is as wide as its widest cell of one column, up to this.
COLUMN = 100

# Fixed element sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript noembed noframes title meta link iframe canvas audio video datalist".split())
#: Their content is text: as it is, or with character references.
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
RAW_REFERENCES = frozenset("title textarea".split())
#: Kinds of input whose value is shown.
HINTED_INPUT = frozenset(["", *"text search email url tel number password".split()])
SHOWN_INPUT = frozenset(["", *"button submit reset text search email url tel number date time month week datetime-local".split()])
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset".split())
BLOCKS = SPACED | frozenset("html body address article aside center dd details dialog div dt figcaption footer form header hgroup legend li main menu nav section summary tr caption option".split())
CLOSES_P = BLOCKS - frozenset("tr caption option html body".split())

#: A start tag ends these open elements ...
IMPLIED = {
    "li": {"li"}, "optgroup": {"option", "optgroup"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th", "caption", "colgroup"}, "tbody": {"thead", "tbody", "tr", "td", "th", "caption", "colgroup"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
#: ... unless one of these stands in between.
SCOPES = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"},
    "option": {"select", "optgroup"}, "optgroup": {"select"}, "body": set(),
}
#: A table part goes into the nearest of these; what is no part and stands directly in one goes before the table.
CONTEXT = {t: frozenset(c.split()) for t, c in {"caption": "table", "colgroup": "table", "thead": "table", "tbody": "table", "tfoot": "table", "col": "colgroup table", "tr": "thead tbody tfoot table", "td": "tr thead tbody tfoot table", "th": "tr thead tbody tfoot table"}.items()}
PARTS = frozenset("table colgroup thead tbody tfoot tr".split())
CELLS = HIDDEN | frozenset("td th caption".split())
#: Inside svg only text and foreignobject show text; these show none. Of a formula, the annotations don't show.
UNDRAWN = {"svg": frozenset("desc metadata defs symbol clippath mask pattern marker filter".split()), "math": frozenset("annotation annotation-xml".split())}
HTML_AGAIN = {"svg": frozenset("foreignobject desc title".split()), "text": frozenset(), "math": frozenset("mi mo mn ms mtext".split())}
#: HTML elements that end an open svg or math element, and parts of formulas that are set apart.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mtable mtr".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_TAG = re.compile(r"[A-Za-z][^ \t\n\f/>]*")
_PLAIN_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)>")
_NAME = re.compile(r"[ \t\n\f/]*([^ \t\n\f/>][^ \t\n\f/>=]*)?[ \t\n\f]*(=?)[ \t\n\f]*")
_BARE = re.compile(r"[^ \t\n\f>]*")
_COMMENT_END = re.compile(r"--!?>")
_LONG_REFERENCE = re.compile(r"&#[0-9]{20,}")
#: What a declaration is made of: comments, strings, an escaped character, brackets, the signs that matter, the rest.
_CSS = re.compile(r"""/\*.*?(?:\*/|$)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|\\.|[][(){};:]|[^][(){};:"'/\\]+|/""", re.S)
# Fixed values of the style language: what display and visibility can be.
_VALUES = {
    "display": frozenset(
        "none contents block inline flow flow-root flex grid table ruby math list-item inline-block inline-flex inline-grid inline-table table-row-group table-header-group table-footer-group table-row table-cell"
        " table-column-group table-column table-caption ruby-base ruby-text ruby-base-container ruby-text-container run-in -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex".split()
    ),
    "visibility": frozenset("visible hidden collapse".split()),
}
_EVERYWHERE = frozenset("inherit initial unset revert revert-layer".split())


def stated(style: str) -> dict[str, str]:
    """Values of display and visibility that the declarations of a style attribute leave: the last valid one, important ones first."""
    found: dict[str, tuple[bool, str]] = {}
    part: list[str] = []
    depth = 0
    for token in (*_CSS.findall(style), ";"):
        if token.startswith("/*"):
            part.append(" ")
            continue
        if token in "([{":
            depth += 1
        elif token in ")]}":
            depth = max(0, depth - 1)
        elif token == ";" and not depth:
            name, colon, value = "".join(part).partition(":")
            name, value = name.strip().lower(), value.strip().lower()
            important = re.search(r"!\s*important$", value)
            value = value[: important.start()].strip() if important else value
            if colon and name in _VALUES:
                words = value.split()
                valid = len(words) == 1 and value in _EVERYWHERE or words and len(words) <= (3 if name == "display" else 1) and all(w in _VALUES[name] for w in words) and (len(words) == 1 or "none" not in words)
                if valid and (important or not found.get(name, (False, ""))[0]):
                    found[name] = (bool(important), value)
            part = []
            continue
        part.append(token)
    return {name: value for name, (_, value) in found.items()}
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})")


def number(text: str | None, default: int) -> int:
    """The whole number that an attribute starts with, of nine digits at most."""
    found = _NUMBER.match(text or "")
    return int(found[1]) if found else default


def _text(data: str) -> str:
    """Text with its character references resolved."""
    return unescape(_LONG_REFERENCE.sub("&#1114112", data)) if "&" in data else data


class Node:
    __slots__ = ("tag", "attributes", "children", "hidden", "seen", "space")

    def __init__(self, tag: str, attributes: dict[str, str], hidden: bool, seen: bool = True, space: str = "html") -> None:
        self.tag, self.attributes, self.space = tag, attributes, space  # space: html, svg, text (of svg) or math
        self.hidden, self.seen = hidden, seen  # hidden: with all below; seen: own text and that of children which don't say otherwise
        self.children: list[Node | str] = []


class TreeBuilder:
    """Builds a tree with implied end tags; unknown end tags are ignored."""

    def __init__(self, page: str) -> None:
        self.root = Node("html", {}, False)
        self.open = [self.root]
        self.count: Counter[str] = Counter()
        self._read(page.replace("\r\n", "\n").replace("\r", "\n"))

    # ---- tokens

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        lower = None
        while at < n:
            tag = page.find("<", at)
            if tag < 0:
                tag = n
            if tag > at:
                self._data(_text(page[at:tag]))
            if tag == n:
                return
            after = page[tag + 1 : tag + 2]
            plain = _PLAIN_TAG.match(page, tag)
            if plain and after == "/":
                self._close(plain[1].lower())
                at = plain.end()
            elif plain and (name := plain[1].lower()) not in RAW and name not in RAW_REFERENCES:
                self._open(name, {})
                at = plain.end()
            elif page.startswith("<!--", tag):
                end = _COMMENT_END.search(page, tag + 2 if page.startswith(("<!-->", "<!--->"), tag) else tag + 4)
                at = end.end() if end else n
            elif page.startswith("<![CDATA[", tag) and self.open[-1].space != "html":
                end = page.find("]]>", tag)
                self._data(page[tag + 9 : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
            elif after in ("!", "?") or after == "/" and not _TAG.match(page, tag + 2):
                end = page.find(">", tag + 2)
                at = end + 1 if end >= 0 else n
            elif after == "/" or _TAG.match(page, tag + 1):
                name, attributes, closed, at = self._tag(page, tag + 1 + (after == "/"))
                if at < 0:  # the page ends inside a tag, which shows nothing
                    return
                if after == "/":
                    self._close(name)
                    continue
                space = self.open[-1].space
                self._start(name, attributes, closed)
                if (name in RAW or name in RAW_REFERENCES) and space == "html":
                    if name == "plaintext":
                        end = n
                    else:
                        lower = lower or page.translate(_SMALL)
                        end = lower.find(f"</{name}", at)
                        while end >= 0 and lower[end + 2 + len(name) : end + 3 + len(name)] not in (" ", "\t", "\n", "\f", "/", ">", ""):
                            end = lower.find(f"</{name}", end + 2)
                        end = end if end >= 0 else n
                    data = page[at:end]
                    self._data(data if name in RAW else _text(data))
                    at = end
            else:
                self._data("<")
                at = tag + 1

    @staticmethod
    def _tag(page: str, at: int) -> tuple[str, dict[str, str], bool, int]:
        """Name, attributes, whether it closes itself, and the place after a tag; -1 where the page ends in it."""
        found = _TAG.match(page, at)
        attributes: dict[str, str] = {}
        at = found.end()
        while True:
            m = _NAME.match(page, at)
            at = m.end()
            if m[1] is None and not m[2]:
                if at >= len(page):
                    return "", {}, False, -1
                return found[0].translate(_SMALL), attributes, page[at - 1] == "/", at + 1
            value = ""
            if m[2]:
                quote = page[at : at + 1]
                if quote in ("'", '"') and quote:
                    end = page.find(quote, at + 1)
                    if end < 0:
                        return "", {}, False, -1
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            attributes.setdefault((m[1] or "").translate(_SMALL), _text(value))

    # ---- tree

    def _start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        foreign = self.open[-1].space != "html"
        self._open(tag, attributes)
        if closed and self.open[-1].tag == tag and (tag in ("svg", "math") or foreign and tag not in BREAKOUT):
            self._cut(len(self.open) - 1)

    def _open(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "html" or tag == "head" and (len(self.open) > 1 or any(isinstance(c, Node) or c.strip() for c in self.root.children)):
            return  # a head that is not the first element is none
        if tag in BREAKOUT:
            while self.open[-1].space != "html":
                self._cut(len(self.open) - 1)
        if tag in CLOSES_P:
            self._end("p", {"td", "th", "table", "button"})
        if tag in ("table", "form") and (k := self._within({"table"}, CELLS)) is not None:
            if tag == "form":  # empty between the parts of a table
                return
            self._cut(k)
        if tag in CONTEXT and (k := self._within(CONTEXT[tag], HIDDEN)) is not None and self._within({"table"}, HIDDEN) is not None:
            self._cut(k + 1)
            if tag in ("td", "th") and self.open[-1].tag != "tr":
                self._add(Node("tr", {}, False, self.open[-1].seen))
        elif tag in IMPLIED:
            while (k := self._within(IMPLIED[tag], SCOPES[tag])) is not None:
                self._cut(k)
        if self.open[-1].tag == "head" and tag not in HIDDEN and tag not in ("base", "head"):
            self._cut(len(self.open) - 1)
        if tag == "body" and self.count["body"]:
            return
        above = self.open[-1]
        style = stated(attributes["style"]) if attributes.get("style") else {}
        display, visibility = style.get("display", "revert"), style.get("visibility", "inherit")
        closed = above.tag == "details" and "open" not in above.attributes and (tag != "summary" or any(isinstance(c, Node) and c.tag == "summary" for c in above.children))
        unshown = "hidden" in attributes or tag == "rp" or tag == "dialog" and "open" not in attributes
        hidden = tag in HIDDEN or tag in UNDRAWN.get(above.space, ()) or closed or display == "none" or unshown and display.startswith("revert") or tag in ("progress", "meter") or tag == "object" and "data" in attributes
        seen = visibility in ("visible", "initial") if visibility in ("visible", "initial", "hidden", "collapse") else above.seen
        space = above.space
        if space == "html":
            space = tag if tag in ("svg", "math") else "html"
        elif tag in HTML_AGAIN[space]:
            space = "html"
        elif tag == "text":
            space = "text" if space == "svg" else space
        node = Node(tag, attributes, hidden, seen, space)
        if tag not in VOID:
            self._add(node)
        else:
            self._put(node)

    def _add(self, node: Node) -> None:
        if len(self.open) > DEEPEST and not any(n.hidden for n in (self.open[-1], self.open[DEEPEST // 2])):
            self._cut(len(self.open) - 1)
        if self.open[-1].hidden and self.open[-1].tag not in ("head",):
            node.hidden = True  # nothing below a hidden element is shown
        self._put(node)
        self.open.append(node)
        self.count[node.tag] += 1

    def _put(self, item: Node | str) -> None:
        """Adds a child to the open element; between the parts of a table, before the table."""
        parent = self.open[-1]
        if isinstance(item, str) and parent.tag == "details" and "open" not in parent.attributes:
            return  # of a closed one only the summary shows
        if parent.tag in PARTS and (isinstance(item, str) or item.tag not in CONTEXT) and (k := self._within({"table"}, HIDDEN)) is not None:
            self.open[k - 1].children.insert(-1, item)  # an open table is its parent's last child
        else:
            parent.children.append(item)

    def _cut(self, k: int) -> None:
        for n in self.open[k:]:
            self.count[n.tag] -= 1
        del self.open[k:]

    def _within(self, tags: set[str], stop: set[str]) -> int | None:
        if not any(self.count[t] for t in tags):
            return None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in stop:
                return None
        return None

    def _end(self, tag: str, stop: set[str]) -> None:
        k = self._within({tag}, stop)
        if k is not None:
            self._cut(k)

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._open("br", {})
        elif tag not in VOID:
            self._end(tag, {"table"} if tag not in ("table", "body", "html") and tag not in HIDDEN else set())

    def _data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        if self.open[-1].space != "svg":
            self._put(data)


_SMALL = {i: i + 32 for i in range(65, 91)}


class _Lines:
    """Collects text into lines; ``gap``: an empty line is due before the next one; ``mark``: a list
    item's mark, due at its first line; ``indent``: stands before the others."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = self.raw = False
        self.mark: str | None = None
        self.indent = ""

    def text(self, data: str) -> None:
        data = _SPACE.sub(" ", data)
        if data.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            data = data[1:]
        if data:
            self.now.append(data)

    def kept(self, data: str) -> None:
        """Text whose white space counts."""
        first, *rest = data.split("\n")
        self.now.append(first)
        self.raw = True
        for part in rest:
            self.line(always=True)
            self.now.append(part)
            self.raw = True

    def line(self, spaced: bool = False, always: bool = False) -> None:
        done = "".join(self.now)
        done = done if self.raw else done.strip(" ")
        self.now, self.raw = [], False
        if always or done.strip(" "):
            self.put([done])
        if spaced and self.lines and self.mark is None:
            self.gap = True

    def put(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        for x in lines:
            head, self.mark = self.indent if self.mark is None else self.mark, None
            self.lines.append(head + x if x or head is not self.indent else "")

    def item(self, mark: str) -> tuple[str, str | None]:
        """Begins a list item; returns what ``leave`` restores."""
        self.line()
        before = self.indent, self.mark
        head = self.indent if self.mark is None else self.mark
        self.mark, self.indent = (head + mark)[:INDENT], (self.indent + " " * len(mark))[:INDENT]
        return before

    def leave(self, before: tuple[str, str | None]) -> None:
        self.line()
        if self.mark is not None:
            self.gap, mark = False, self.mark.rstrip(" ")
            self.mark = None
            self.lines.append(mark)
        self.indent = before[0]
        self.gap = False


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def _rows(table: Node) -> Iterator[Node]:
    for child in table.children:
        if isinstance(child, Node) and not child.hidden:
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _grid(node: Node, kept: bool) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of cells (first column, columns, lines); a cell over several rows stands in its first one."""
    grid = []
    over: list[tuple[int, int, int]] = []  # columns that cells of earlier rows still take: from, to, rows left
    for row in _rows(node):
        cells, at = [], 0
        more = []
        for cell in row.children:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th") or cell.hidden:
                continue
            for low, high, _ in over:
                if low <= at < high:
                    at = high
            span = min(max(number(cell.attributes.get("colspan"), 1), 1), 1000)
            deep = number(cell.attributes.get("rowspan"), 1)
            cells.append((at, span, render_lines(cell, kept)))
            if deep != 1 and deep >= 0:
                more.append((at, at + span, deep - 1 if deep else 1 << 30))
            at += span
        grid.append(cells)
        over = sorted([(a, b, left - 1) for a, b, left in over if left > 1] + more)
    return grid


def _table(node: Node, kept: bool) -> list[str]:
    """Cells padded by column; a cell of several lines takes several lines.

    Only columns in which a cell begins have a place. Columns line up over the first ALIGNED
    characters; a cell that is wider than its columns pushes the rest of its row.
    """
    grid = _grid(node, kept)
    used = sorted({at for row in grid for at, _, _ in row})
    width = dict.fromkeys(used, 0)
    wide = []
    for row in grid:
        for at, span, lines in row:
            size = min(max(map(_width, lines), default=0), COLUMN)
            low, high = bisect.bisect_left(used, at), bisect.bisect_left(used, at + span)
            if high - low == 1:
                width[at] = max(width[at], size)
            elif size:
                wide.append((low, high, size))
    for low, high, size in wide:
        some = used[low:high]
        width[some[-1]] += max(0, size - sum(width[u] for u in some) - 2 * (len(some) - 1))
    place, total = {}, 0
    for u in used:
        place[u] = min(total, ALIGNED)
        total += width[u] + 2
    out = []
    for row in grid:
        for i in range(max((len(lines) for *_, lines in row), default=0)):
            parts, at = [], 0
            for first, _, lines in row:
                if i < len(lines) and lines[i]:
                    pad = max(place[first] - at, 2 if parts else 0)
                    parts.append(" " * pad + lines[i])
                    at += pad + _width(lines[i])
            out.append("".join(parts))
    return out


def render_lines(root: Node, kept: bool = False) -> list[str]:
    """Lines of the visible text under ``root``, walked without recursion but for table cells.

    ``kept``: white space counts, as inside ``pre``.
    """
    out = _Lines()
    stack: list[tuple] = []

    def down(node: Node, kept: bool, listed: list | None = None) -> None:
        apart = node.space == "math" and node.tag in APART
        for c in reversed(node.children):
            if isinstance(c, Node) and not c.hidden or isinstance(c, str) and node.seen:
                stack.append(("in", c, kept, listed))
                if apart:
                    stack.append(("in", " ", False, None))

    down(root, kept)
    while stack:
        step, item, kept, listed = stack.pop()
        if step == "out":
            item()
            continue
        if isinstance(item, str):
            (out.kept if kept else out.text)(item)
            continue
        tag = item.tag
        if tag == "br":
            out.line(always=True)
        elif tag == "img":
            if item.seen:
                out.text(item.attributes.get("alt", ""))
        elif tag == "input":
            kind = item.attributes.get("type", "").lower()
            shown = item.attributes.get("value") if kind in SHOWN_INPUT else None
            if item.seen and (shown := shown or (item.attributes.get("placeholder") if kind in HINTED_INPUT else None)):
                out.text(f" {shown} ")
        elif tag == "select":
            if kept:
                out.kept(" ".join(_choices(item)))
            for text in () if kept else _choices(item):
                out.text(f" {text} ")
        elif tag == "table":
            out.line(True)
            for c in item.children:
                if isinstance(c, Node) and c.tag == "caption" and not c.hidden and (lines := render_lines(c, kept)):
                    out.put(lines)
            rows = _table(item, kept)
            if any(rows):
                out.put(rows)
            out.line(True)
        elif tag in ("ul", "ol", "menu"):
            out.line(True)
            stack.append(("out", lambda: out.line(True), False, None))
            down(item, kept, [number(item.attributes.get("start"), 1) if tag == "ol" else None])
        elif tag == "li" and listed is not None:
            mark = "- "
            if listed[0] is not None:
                at = number(item.attributes.get("value"), listed[0])
                mark, listed[0] = f"{at}. ", at + 1
            if item.seen:
                before = out.item(mark)
                stack.append(("out", lambda before=before: out.leave(before), False, None))
            else:
                out.line()
                stack.append(("out", out.line, False, None))
            down(item, kept)
        elif tag in ("pre", "textarea", "listing", "xmp", "plaintext"):
            out.line(tag != "textarea")
            if tag == "textarea" and item.seen and not any(item.children):
                out.text(item.attributes.get("placeholder", ""))
            if item.children and isinstance(item.children[0], str):
                item.children[0] = item.children[0].lstrip("\n")
            if item.children and isinstance(item.children[-1], str):
                item.children[-1] = item.children[-1].rstrip("\n")
            stack.append(("out", lambda spaced=tag != "textarea": out.line(spaced), False, None))
            down(item, True)
        elif tag in BLOCKS:
            out.line(tag in SPACED)
            stack.append(("out", lambda spaced=tag in SPACED: out.line(spaced), False, None))
            down(item, kept)
        else:
            if tag in ("td", "th") or item.space == "text" and tag == "text":
                out.text(" ")
                stack.append(("in", " ", False, None))
            down(item, kept)
    out.line()
    low, high = 0, len(out.lines)
    while low < high and not out.lines[high - 1]:
        high -= 1
    while low < high and not out.lines[low]:
        low += 1
    return out.lines[low:high]


def _plain(node: Node) -> Iterator[str]:
    """Visible text under an option, without layout."""
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            yield item
        elif not item.hidden:
            stack.extend(reversed(item.children))


def _choices(select: Node) -> list[str]:
    """Texts that a select shows: the chosen option of a drop-down list, all of a list box."""
    if not select.seen:
        return []
    listed = "multiple" in select.attributes or number(select.attributes.get("size"), 1) > 1
    found: list[tuple[Node, bool]] = []
    texts = []
    stack: list[tuple[Node | str, bool]] = [(c, False) for c in reversed(select.children)]
    while stack:
        item, off = stack.pop()
        if isinstance(item, str) or listed and item.hidden:
            continue
        off = off or "disabled" in item.attributes
        if item.tag == "option":
            found.append((item, off))
            texts.append(item.attributes.get("label") or _SPACE.sub(" ", "".join(_plain(item))).strip(" "))
        else:
            if item.tag == "optgroup" and listed:
                texts.append(item.attributes.get("label") or "")
            stack.extend((c, off) for c in reversed(item.children))
    if listed:
        return texts
    chosen = [k for k, (o, _) in enumerate(found) if "selected" in o.attributes][-1:] or [k for k, (o, off) in enumerate(found) if not off and not o.hidden][:1]
    return [texts[k] for k in chosen]


def render(html: str | None) -> str:
    """Visible text of a page; empty for a null or empty page. Never fails on broken markup."""
    return "\n".join(render_lines(TreeBuilder(html).root)) if html else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(h) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars) of each row of ``pages`` (page_id, html): all visible text, laid out.

    A null or empty page gives an empty text. Pages of any length and nesting are rendered whole.
    Repeated rows are rendered each; an empty table gives no rows; other columns are ignored.
    """
    tune(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pick(pages, "page_id", "html").mapInArrow(lean(_extract), f"page_id {kind}, text string, n_chars long")
