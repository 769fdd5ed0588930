"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, and a renderer.

The renderer keeps block spacing (a blank line around paragraphs, headings, lists, tables),
list markers with nesting, preformatted text, and table cells padded to columns.
Not visible: head, script, what SVG and MathML only describe or define, style, template, noscript and media fallbacks, comments, ``hidden``, hidden inputs,
inline or simple style-sheet rules with ``display: none`` or ``visibility: hidden``, and what a closed ``details`` holds
beside its summary.

Defined results: null html gives null, empty html an empty text. Broken markup is never an error:
unclosed tags are closed where HTML closes them, a ``<`` that begins no tag is text, nesting may be of any depth; a cell
spans 1,000 columns at most, as HTML has it. Rows are kept one for one; other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, steps, table, tidy

#: HTML's own limit.
WIDEST_SPAN = 1000

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
UNSEEN = _set("head script style template noscript iframe noembed noframes object video audio canvas title datalist")
#: Not shown inside svg and math.
UNDRAWN = {"svg": _set("desc defs metadata symbol clippath mask marker pattern"), "math": _set("annotation annotation-xml")}
HEAD = _set("title meta link style script base template noscript")
BLOCK = _set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table caption tbody thead tfoot tr td th ul textarea select")
SPACED = _set("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre table figure fieldset hr form details")
CLOSES_P = _set("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul")
SCOPE = _set("html table td th caption button object template")
LISTS = _set("ul ol menu dir")
SECTIONS = _set("tbody thead tfoot")


class Node:
    __slots__ = ("tag", "attrs", "kids", "seen")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, seen: bool = True):
        self.tag, self.attrs, self.kids, self.seen = tag, attrs, [], seen


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        value = a or b or c
        out.setdefault(name.lower(), _html.unescape(value) if "&" in value else value)
    return out


class Builder:
    """A tree of elements and strings from any text."""

    def __init__(self, source: str):
        self.root = Node("html")
        self.stack = [self.root]
        self.deepest = 1
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.body_begun = False
        self.hidden_names: set[str] = set()  # tag, .class or #id that a style sheet hides
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self.end(tag)
                continue
            rest = m[3] or m[6]
            self.start(tag, _attributes(rest) if rest and not rest.isspace() and rest != "/" else None)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                inner = source[at : close.start() if close else n]
                at = close.end() if close else n
                if tag == "style":
                    self.sheet(inner)
                elif tag in ("textarea", "xmp"):
                    self.stack[-1].kids.append(_html.unescape(inner) if tag == "textarea" else inner)
                self.end(tag)

    def sheet(self, css: str) -> None:
        for selectors, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
            if _NONE.search(body):
                self.hidden_names.update(x for s in selectors.split(",") if re.fullmatch(r"[.#]?[\w-]+", x := s.strip()))

    def _seen(self, tag: str, attrs: dict[str, str] | None) -> bool:
        if tag in UNSEEN:
            return False
        if any(tag in tags and self._depth((outer,), frozenset()) for outer, tags in UNDRAWN.items()):
            return False
        if self.hidden_names and (tag in self.hidden_names or attrs and ("#" + attrs.get("id", "") in self.hidden_names or any("." + c in self.hidden_names for c in attrs.get("class", "").split()))):
            return False
        return not attrs or not ("hidden" in attrs or "style" in attrs and _NONE.search(attrs["style"]) or tag == "input" and attrs.get("type", "").lower() == "hidden")

    def _depth(self, tags: frozenset[str] | tuple, stop: frozenset[str]) -> int:
        """Place in the stack of the nearest open element with such a tag, not beyond one of ``stop``; 0 if none."""
        best = 0
        for t in tags:
            at = self.open.get(t)
            if at and at[-1] > best:
                best = at[-1]
        if best:
            for t in stop if len(stop) < len(self.open) else self.open:
                if t in stop and (at := self.open.get(t)) and at[-1] > best:
                    return 0
        return best

    def _push(self, node: Node) -> None:
        self.open.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)
        self.deepest = max(self.deepest, len(self.stack))

    def _pop_to(self, i: int) -> None:
        if i:
            for node in reversed(self.stack[i:]):
                self.open[node.tag].pop()
                if not self.open[node.tag]:
                    del self.open[node.tag]
            del self.stack[i:]

    def _add(self, node: Node | str) -> None:
        top = self.stack[-1]
        loose = node if isinstance(node, str) else node.tag
        if top.tag in ("table", "tr") or top.tag in SECTIONS:
            table_parts = ("caption", "colgroup", "col", "tr", "td", "th", "tbody", "thead", "tfoot", "script", "style", "template")
            if (isinstance(node, str) and not node.isspace()) or (not isinstance(node, str) and loose not in table_parts and not (loose == "input")):
                i = self._depth(("table",), frozenset())
                parent = self.stack[i - 1]
                parent.kids.insert(len(parent.kids) - 1, node)  # before the table
                return
        top.kids.append(node)

    def text(self, s: str) -> None:
        if "&" in s:
            s = _html.unescape(s)
        if not s.isspace():
            self._into_body()
            if self.stack[-1].tag == "colgroup":
                self._pop_to(len(self.stack) - 1)
        self._add(s)

    def _into_body(self) -> None:
        if not self.body_begun:
            self._pop_to(self._depth(("head",), frozenset()))
            self.body_begun = True

    def start(self, tag: str, attrs: dict[str, str] | None) -> None:
        stack = self.stack
        if tag in ("html", "body", "head"):
            if tag == "body":
                self._into_body()
                node = Node(tag, attrs, self._seen(tag, attrs))
                if not node.seen:
                    stack[-1].kids.append(node)
                    self._push(node)
            elif tag == "head" and not self.body_begun and not self._depth(("head",), frozenset()):
                node = Node("head", None, False)
                stack[-1].kids.append(node)
                self._push(node)
            return
        if tag not in HEAD:
            self._into_body()
        if tag in CLOSES_P:
            self._pop_to(self._depth(("p",), SCOPE))
        if tag != "col" and tag not in ("script", "style", "template") and stack[-1].tag == "colgroup":
            self._pop_to(len(stack) - 1)
        if tag == "li":
            self._pop_to(self._depth(("li",), SCOPE | LISTS))
        elif tag in ("dd", "dt"):
            self._pop_to(self._depth(("dd", "dt"), SCOPE | {"dl"}))
        elif tag in ("option", "optgroup"):
            self._pop_to(self._depth(("option",) if tag == "option" else ("optgroup", "option"), SCOPE | {"select", "datalist"}))
        elif tag in ("td", "th"):
            self._pop_to(self._depth(("td", "th", "caption"), frozenset({"table"})))
            if not self._depth(("tr",), frozenset({"table"})) and self._depth(("table",), frozenset()):
                self.start("tr", None)
            i = self._depth(("tr",), frozenset({"table"}))
            self._pop_to(i + 1 if i else 0)
        elif tag == "tr":
            self._pop_to(self._depth(("tr", "caption"), frozenset({"table"})))
        elif tag in SECTIONS or tag == "caption":
            i = self._depth(("table",), frozenset())
            self._pop_to(i + 1 if i else 0)
        elif tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._pop_to(len(stack) - 1)
        elif tag == "a":
            self._pop_to(self._depth(("a",), SCOPE | BLOCK))
        node = Node(tag, attrs, self._seen(tag, attrs))
        self._add(node)
        if tag not in VOID:
            self._push(node)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            self._pop_to(self._depth(("head",), frozenset()))
            return
        if tag == "br":
            self.start("br", None)
            return
        if tag in ("table", "tr", "td", "th", "caption") or tag in SECTIONS:
            self._pop_to(self._depth((tag,), frozenset() if tag == "table" else frozenset({"table"})))
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._pop_to(self._depth(("h1", "h2", "h3", "h4", "h5", "h6"), SCOPE))
        elif tag in BLOCK or tag in RAW:
            i = self._depth((tag,), SCOPE | LISTS if tag == "li" else SCOPE)
            if tag == "p" and not i:
                self.start("p", None)
                i = len(self.stack) - 1 if self.stack[-1].tag == "p" else 0
            self._pop_to(i)
        else:
            self._pop_to(self._depth((tag,), SCOPE | BLOCK))


class Flow:
    """Lines of a block, with the blank lines that are due before the next."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.due = 0
        self.pre = 0

    def text(self, s: str) -> None:
        self.line.append(s)

    def flush(self) -> None:
        if not self.line:
            return
        s = "".join(self.line)
        self.line = []
        if self.pre:
            got = s.replace("\r\n", "\n").split("\n")
            got = got[1 if not got[0] and len(got) > 1 else 0 :]
            while got and not got[-1].strip():
                got.pop()
            self.add([x.rstrip() for x in got], 0)
        elif s := _SPACE.sub(" ", s).strip(" ").replace("\xa0", " "):
            self.add([s], 0)

    def add(self, lines: list[str], margin: int) -> None:
        """A block of lines with blank lines around it, collapsing with those that are due."""
        if not lines:
            return
        due = max(self.due, margin)
        if self.lines and due:
            self.lines += [""] * due
        self.lines += lines
        self.due = margin

    def margin(self, n: int) -> None:
        self.flush()
        self.due = max(self.due, n)

    def newline(self) -> None:
        if any(not x.isspace() for x in self.line):
            self.flush()
        elif self.lines and not self.due:
            self.lines.append("")

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _kids(node: Node, flow: Flow) -> None:
    for k in node.kids:
        if isinstance(k, str):
            flow.text(k)
        elif k.seen:
            _render(k, flow)


def _block(node: Node) -> list[str]:
    flow = Flow()
    _kids(node, flow)
    return flow.done()


def _number(attrs: dict[str, str] | None, name: str, least: int, most: int, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", (attrs or {}).get(name, ""))
    return min(most, max(least, int(m[1]))) if m else default


def _list(node: Node, flow: Flow) -> None:
    n = _number(node.attrs, "start", -(10**9), 10**9, 1)
    out: list[str] = []
    for k in node.kids:
        if isinstance(k, str):
            if not k.isspace():
                out.append(_SPACE.sub(" ", k).strip(" "))
        elif k.seen:
            lines = _block(k)
            if k.tag != "li":
                out += ["  " + x if x else x for x in (_nested(k) if k.tag in LISTS else lines)]
                continue
            n = _number(k.attrs, "value", -(10**9), 10**9, n)
            mark = f"{n}. " if node.tag == "ol" else "- "
            n += 1
            if lines:
                out += [mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])]
    flow.add(out, 1)


def _nested(node: Node) -> list[str]:
    flow = Flow()
    _list(node, flow)
    return flow.done()


def _table(node: Node, flow: Flow) -> None:
    rows: list[list[tuple[list[str], int, int]]] = []
    caption: list[str] = []

    def walk(part: Node) -> None:
        for k in part.kids:
            if isinstance(k, str) or not k.seen:
                continue
            if k.tag == "tr":
                rows.append([(_block(c), _number(c.attrs, "colspan", 1, WIDEST_SPAN, 1), _number(c.attrs, "rowspan", 0, 65534, 1)) for c in k.kids if not isinstance(c, str) and c.seen and c.tag in ("td", "th")])
            elif k.tag in SECTIONS:
                walk(k)
            elif k.tag == "caption":
                caption.extend(_block(k))

    walk(node)
    widths: list[int] = []
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell above still covers
    for cells in rows:
        line, col, covered = [], 0, {c: r - 1 for c, r in taken.items() if r > 1}
        for lines, across, down in cells:
            while col in taken:
                col += 1
            line.append((col, across, lines))
            if down != 1:
                covered |= {c: (down or 65534) - 1 for c in range(col, col + across) if (down or 65534) > 1}
            col += across
        placed.append(line)
        taken = {c: r for c, r in covered.items() if r > 0}
        widths += [0] * (max([col, *(c + 1 for c in taken)]) - len(widths))
    for spans in (False, True):
        for line in placed:
            for col, across, lines in line:
                if (across > 1) == spans and lines:
                    short = max(map(len, lines)) - sum(widths[col : col + across]) - 2 * (across - 1)
                    if short > 0:
                        widths[col + across - 1] += short
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + (w + 2 if w else 0))
    out = []
    for line in placed:
        for k in range(max((len(lines) for _, _, lines in line), default=0)):
            s = ""
            for col, _, lines in line:
                if k < len(lines) and lines[k]:
                    s = s.ljust(starts[col]) + lines[k]
            out.append(s.rstrip())
    flow.add(caption + out, 1)


def _render(node: Node, flow: Flow) -> None:
    tag = node.tag
    if tag == "br":
        flow.newline()
    elif tag == "wbr":
        pass
    elif tag == "hr":
        flow.margin(1)
    elif tag in LISTS:
        flow.flush()
        _list(node, flow)
    elif tag == "table":
        flow.flush()
        _table(node, flow)
    elif tag == "input":
        if (node.attrs or {}).get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
            flow.text(" " + (node.attrs or {}).get("value", "") + " ")
    elif tag in ("blockquote", "dd"):
        flow.flush()
        lines = _block(node)
        flow.add(["  " + x if x else x for x in lines], 1 if tag == "blockquote" else 0)
    elif tag in ("pre", "textarea", "xmp"):
        inner = Flow()
        inner.pre = 1
        _kids(node, inner)
        flow.flush()
        flow.add(inner.done(), 1)
    elif tag == "details" and "open" not in (node.attrs or {}):
        flow.margin(1)
        for k in node.kids:
            if not isinstance(k, str) and k.seen and k.tag == "summary":
                _render(k, flow)
        flow.margin(1)
    elif tag in BLOCK:
        n = int(tag in SPACED)
        flow.margin(n)
        _kids(node, flow)
        flow.margin(n)
    elif tag == "q":
        flow.text('"')
        _kids(node, flow)
        flow.text('"')
    else:
        _kids(node, flow)


def render(source: str) -> str:
    """The visible text of a page."""
    flow, tree = Flow(), Builder(source)
    # calls of Python functions take no room on the machine's stack
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 6 * tree.deepest + 1000))
    try:
        _kids(tree.root, flow)
    finally:
        sys.setrecursionlimit(limit)
    return "\n".join(flow.done())


def visible_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text for each row of ``pages``."""
    bounded_batches(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "html"):
                text = [None if h is None else render(h) for h in step.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([step.column("page_id"), pa.array(text, pa.string())], ["page_id", "text"])

    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{html_col}`").alias("html"))
    return src.mapInArrow(tidy(extract), "page_id long, text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_text(table(spark, sf_dir, "pages"))
