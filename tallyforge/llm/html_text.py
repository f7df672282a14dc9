"""Layout-aware text of HTML pages.

A tree builder turns markup into properly nested open and close events: it supplies implied end tags, ignores stray
ones and knows void and raw-text elements. A renderer lays the visible text out: blocks on lines of their own with a
blank line where a browser shows a margin, lists with markers and indents, preformatted text as it is, and tables with
cells padded to their columns, rows spanned and columns spanned. Nothing recurses and nothing walks the open elements,
so time grows with the page and not with its depth: open elements are found by the places of their names, indents stop
growing at ``INDENT`` characters, columns are aligned over the first ``ALIGNED`` characters of a line, and tables more than
``TABLES`` deep are laid out as lines.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import batches, through_pandas

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes datalist object audio video canvas desc metadata annotation annotation-xml".split())
#: Of a drawing only these are shown; its definitions are not.
DRAWN = frozenset("text foreignobject".split())
UNDRAWN = frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
#: Start tags that end a drawing or formula, and where they do not.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table ul xmp optgroup option".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir xmp".split())
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "legend"} | {"hr"}
#: Start tags that leave an open head open.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script template noscript noframes".split())
_SCOPE = frozenset("html body table td th caption button object template".split())
_LIST = frozenset("ul ol menu dir".split())
_ROWS = frozenset("thead tbody tfoot".split())

#: Start tags that end open elements of some names, and within what.
_ENDS: dict[str, tuple] = {
    "li": (("li",), _LIST | _SCOPE), "dt": (("dt", "dd"), {"dl"} | _SCOPE), "dd": (("dt", "dd"), {"dl"} | _SCOPE), "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "caption"), ("table",)),
} | dict.fromkeys(_ROWS, ((*_ROWS, "caption", "tr"), ("table",)))

_VALUE = r"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^ \t\n\f\r>"'][^ \t\n\f\r>]*)"""
#: A quote delimits directly after "=" alone; a tag that the page's end cuts off has an empty last group.
_MARKUP = re.compile(rf"<(?:!--.*?(?:-->|$)|[!?][^>]*>?|(/?)([a-zA-Z][^ \t\n\f\r/>]*)((?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+{_VALUE}?+)?+)*+)(>|\Z))", re.S)
_ATTRIBUTE = re.compile(rf"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+({_VALUE})?+)?+")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
INDENT, ALIGNED, TABLES = 400, 1000, 32


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value))
    return out


def events(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("open" | "close" | "text", tag or text, attributes), properly nested."""
    stack: list[str] = []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each name stands
    at, size = 0, len(html)

    def push(tag: str) -> None:
        places[tag].append(len(stack))
        stack.append(tag)

    def close_to(depth: int):
        while len(stack) > depth:
            places[stack[-1]].pop()
            yield "close", stack.pop(), {}

    def close_head():
        while stack and stack[-1] == "head":
            yield from close_to(len(stack) - 1)

    def text(source: str):
        if source.strip(" \t\n\f\r"):
            yield from close_head()
        yield "text", unescape(source), {}

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def nearest(tags, limit) -> int:
        k = last(tags)
        return k if k >= 0 and k >= last(limit) else -1

    def implied(tag: str):
        """End tags that an opening ``tag`` implies."""
        if places["select"] and tag in ("select", "input", "textarea") and (k := nearest(("select",), ())) >= 0:
            yield from close_to(k)
        if (places["svg"] or places["math"]) and tag in BREAKS_OUT and (k := nearest(("svg", "math"), _INTEGRATION)) >= 0:
            yield from close_to(k)
        if tag in _ENDS:
            tags, limit = _ENDS[tag]
            while (k := nearest(tags, limit)) >= 0:
                yield from close_to(k)
        if tag in CLOSES_P and (k := nearest(("p",), _SCOPE)) >= 0:
            yield from close_to(k)
        if tag == "body" and (k := nearest(("head",), ())) >= 0:
            yield from close_to(k)
        if tag not in IN_HEAD:
            yield from close_head()
        if tag in ("td", "th") and nearest(("tr",), {"table"}) < 0 and nearest(("table",), ()) >= 0:
            push("tr")
            yield "open", "tr", {}

    while at < size:
        m = _MARKUP.search(html, at)
        if m is None:
            break
        if m.start() > at:
            yield from text(html[at : m.start()])
        at = m.end()
        if not m[2] or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and nearest(("p",), _SCOPE) < 0:
                yield "open", "p", {}
                yield "close", "p", {}
            elif tag == "br":
                yield from close_head()
                yield "open", "br", {}
                yield "close", "br", {}
            elif (k := nearest((tag,), () if tag in ("table", "html", "body") else {"table"} if tag in _ROWS or tag in ("tr", "caption") else {"tr", "table"} if tag in ("td", "th") else {"td", "th", "caption", "table"})) >= 0:
                yield from close_to(k)
            continue
        yield from implied(tag)
        found = attributes(m[3]) if m[3].strip() else {}
        yield "open", tag, found
        if tag in VOID:
            yield "close", tag, {}
            continue
        push(tag)
        if m[3].endswith("/") and (places["svg"] or places["math"]) and tag not in RAW and tag != "select":  # foreign elements may close themselves
            yield from close_to(len(stack) - 1)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : end.start() if end else size]
            if tag not in HIDDEN and body:
                yield "text", re.sub(r"^\r?\n", "", unescape(body)) if tag == "textarea" else body, {}
            at = end.end() if end else size
            yield from close_to(len(stack) - 1)
    if at < size:
        yield from text(html[at:])
    yield from close_to(0)


class Level:
    """An indented part of a frame (the frame itself is its first): a list item, a quotation."""

    __slots__ = ("begun", "due", "kind", "marker", "start")

    def __init__(self, kind: str, marker: str = "") -> None:
        self.kind, self.marker, self.begun, self.due, self.start = kind, marker, False, False, 0


class Frame:
    """Lines laid out so far, the line being filled, the levels that indent it, and the blank lines due before the next."""

    __slots__ = ("cells", "current", "due", "kind", "levels", "lines", "number", "preformatted", "rows", "spaces", "unbegun", "width")

    def __init__(self, kind: str, preformatted: int = 0) -> None:
        self.kind, self.lines, self.current, self.preformatted = kind, [], [], preformatted
        self.levels, self.unbegun, self.due, self.width, self.spaces = [Level(kind)], 0, [], 0, ""
        self.number, self.rows, self.cells = 0, [], None

    def text(self, s: str) -> None:
        if self.preformatted:
            first, *more = s.replace("\r\n", "\n").split("\n")
            self.current.append(first)
            for line in more:
                self.end(keep=True)
                self.current.append(line)
            return
        words = s.split()
        if not words:
            if s and self.current and not self.current[-1].endswith(" "):
                self.current.append(" ")
            return
        if s[0].isspace() and self.current and not self.current[-1].endswith(" "):
            self.current.append(" ")
        self.current.append(" ".join(words))
        if s[-1].isspace():
            self.current.append(" ")

    def end(self, keep: bool = False) -> None:
        line = "".join(self.current).rstrip()
        if not self.preformatted:
            line = line.lstrip()
        self.current = []
        if line or keep:
            self.add(line)

    def add(self, line: str) -> None:
        """A line of its own; the levels that begin with it put their markers before it."""
        if not line and not self.levels[-1].begun:
            return
        if self.due:
            self.lines.append("")
            while self.due:
                self.due.pop().due = False
        marks = ""
        for level in self.levels[self.unbegun :]:
            level.begun, level.start = True, len(self.lines)
            marks += level.marker
        self.lines.append(self.spaces + marks + line if line else "")
        if marks:
            self.widen(len(marks))
        self.unbegun = len(self.levels)

    def widen(self, by: int) -> None:
        self.width += by
        self.spaces = " " * min(self.width, INDENT)

    def block(self, spaced: bool) -> None:
        """Ends the line; if ``spaced``, a blank line is due before the level's next one."""
        self.end()
        level = self.levels[-1]
        if spaced and level.begun and not level.due:
            level.due = True
            self.due.append(level)

    def indent(self, kind: str, marker: str) -> None:
        self.levels.append(Level(kind, marker))

    def dedent(self) -> None:
        self.end()
        level = self.levels.pop()
        if level.due:
            self.due.pop()
        if level.begun:
            while len(self.lines) > level.start and not self.lines[-1]:
                self.lines.pop()
            self.widen(-len(level.marker)) if level.marker else None
        self.unbegun = min(self.unbegun, len(self.levels))

    def done(self) -> list[str]:
        while len(self.levels) > 1:
            self.dedent()
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def columns(s: str) -> int:
    """How many columns of a terminal a line takes: wide characters two, combining ones none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 1 + (unicodedata.east_asian_width(c) in "WF") for c in s)


def grid(rows: list[list[tuple[list[str], int, int]] | None]) -> list[list[list[str]]]:
    """Rows of cells (lines, columns spanned, rows spanned) as rows of lines by column; None ends a group of rows and what spans them."""
    out, pending = [], {}
    for row in rows:
        if row is None:
            pending = {}
            continue
        placed: list[list[str]] = []
        spanning = {}
        for lines, across, down in row:
            while pending.get(len(placed), 0):
                placed.append([])
            for k in range(across):
                if down > 1:
                    spanning[len(placed)] = down
                placed.append([] if k else lines)
        pending = {k: n - 1 for k, n in (pending | spanning).items() if n > 1}
        out.append(placed)
    return out


def aligned(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells (each a list of lines) with every column as wide as its widest line, two blanks apart."""
    widths: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            if k == len(widths):
                widths.append(0)
            widths[k] = max([widths[k], *map(columns, cell)])
    room = ALIGNED
    for k, w in enumerate(widths):
        room -= w
        widths[k] = w if room >= 0 else 0
    out = []
    for row in rows:
        for n in range(max([1, *map(len, row)])):
            line = "  ".join(x + " " * (w - columns(x)) for x, w in ((cell[n] if n < len(cell) else "", w) for cell, w in zip(row, widths, strict=False))).rstrip()
            out.append(line)
    return [x for x in out if x]


def _span(found: dict[str, str], name: str, most: int) -> int:
    value = found.get(name, "").strip()
    return min(int(value[:9]), most) if re.fullmatch(r"[0-9]+", value) else 1


#: What is shown: all, nothing, nothing but a drawing's texts, nothing but the summary of closed details.
_ALL, _NONE, _DRAWING, _SUMMARY = range(4)


def render(html: str) -> str:
    """All visible text of a page."""
    frames = [Frame("root")]
    lists: list[tuple[str, int]] = []
    shown, invisible, tables = _ALL, False, 0
    open_: list[tuple[int, bool]] = []
    closed_details: list[int] = []  # how many elements were open inside of each that still lacks its summary
    for kind, name, found in events(html):
        top = frames[-1]
        if kind == "text":
            if shown == _ALL and not invisible and (top.kind != "table" or name.strip()):
                if top.kind == "table" and len(top.levels) == 1:  # text between cells is shown before the table
                    frames[-2].text(name)
                else:
                    top.text(name)
            continue
        if kind == "open":
            style = found.get("style", "")
            display, visibility = _DISPLAY.findall(style) if style else [], _VISIBILITY.findall(style) if style else []
            gone = name in HIDDEN or (name == "dialog" and "open" not in found) or ("hidden" in found and not display) or (display[-1:] and display[-1].lower() == "none")
            gone = gone or (name == "input" and found.get("type", "").lower() == "hidden")
            open_.append((shown, invisible))
            drawn = shown == _DRAWING
            if visibility:
                invisible = visibility[-1].lower() in ("hidden", "collapse") or (invisible and visibility[-1].lower() not in ("visible", "initial"))
            if gone or (drawn and name in UNDRAWN):
                shown = _NONE
            elif shown == _SUMMARY and name == "summary" and closed_details and closed_details[-1] == len(open_) - 1:
                shown, closed_details[-1] = _ALL, -1
            elif shown == _ALL and name == "svg":
                shown = _DRAWING
            elif shown == _ALL and name == "details" and "open" not in found:
                shown = _SUMMARY
                closed_details.append(len(open_))
                top.block(False)
            elif drawn and name in DRAWN:
                shown = _ALL
            if shown != _ALL:
                continue
            if drawn:
                top.text(" ")
            if name == "br":
                top.end(keep=not invisible) if top.kind != "table" else None
            elif name == "hr":
                top.block(False)
            elif name == "table":
                tables += 1
                top.block(True)
                if tables <= TABLES:
                    frames.append(Frame("table"))
            elif tables > TABLES and name in ("tr", "td", "th", "caption", "thead", "tbody", "tfoot"):
                top.text(" ") if name in ("td", "th") else top.block(False)
            elif name in _ROWS and top.kind == "table":
                top.rows.append(None)
            elif name == "tr" and top.kind == "table":
                top.cells = []
            elif name in ("td", "th") and top.kind == "table":
                if top.cells is None:
                    top.cells = []
                made = Frame("cell")
                made.number = (max(1, _span(found, "colspan", 1000)), _span(found, "rowspan", 65534) or 65534)  # no rows: all that follow
                frames.append(made)
            elif name == "caption" and top.kind == "table":
                frames.append(Frame("caption"))
            elif name in _LIST:
                top.block(not lists)
                start = found.get("start", "")
                lists.append((name, int(start) if name == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 1))
            elif name == "li":
                top.block(False)
                if lists and lists[-1][0] == "ol":
                    top.indent("li", f"{lists[-1][1]}. ")
                    lists[-1] = ("ol", lists[-1][1] + 1)
                else:
                    top.indent("li", "- ")
            elif name in ("blockquote", "dd"):
                top.block(name == "blockquote")
                top.indent(name, "  ")
            elif name == "select":
                made = Frame("select")
                size = found.get("size", "")
                made.number = int("multiple" in found or (re.fullmatch(r"[0-9]{1,9}", size) is not None and int(size) > 1))
                frames.append(made)
            elif name == "optgroup" and top.kind == "select":
                top.cells = "disabled" in found
            elif name == "option" and top.kind == "select":
                made = Frame("option")
                made.rows = [found.get("label", ""), "selected" in found, bool(top.cells) or "disabled" in found]
                frames.append(made)
            elif name == "textarea":
                top.preformatted += 1
            elif name in ("pre", "xmp"):
                top.block(True)
                top.preformatted += 1
            elif name in BLOCK:
                top.block(name in SPACED)
            continue
        if not open_:
            continue
        was, (shown, invisible) = shown, open_.pop()
        if was == _SUMMARY and shown == _ALL:
            closed_details.pop()
            top.block(False)
        if was != _ALL:
            continue
        if shown == _DRAWING:
            top.text(" ")
        if name == "table":
            tables -= 1
        if name == "table" and top.kind == "table":
            if top.cells:
                top.rows.append(top.cells)
            frames.pop()
            for line in top.done() + aligned(grid(top.rows)):
                frames[-1].add(line)
            frames[-1].block(True)
        elif tables > TABLES and name in ("tr", "td", "th", "caption", "thead", "tbody", "tfoot"):
            top.text(" ") if name in ("td", "th") else top.block(False)
        elif name in _ROWS and top.kind == "table":
            top.rows.append(None)
        elif name == "tr" and top.kind == "table":
            if top.cells:
                top.rows.append(top.cells)
            top.cells = None
        elif name in ("td", "th") and top.kind == "cell":
            frames.pop()
            frames[-1].cells.append((top.done(), *top.number))
        elif name == "caption" and top.kind == "caption":
            frames.pop()
            for line in top.done():
                frames[-1].add(line)
        elif name in _LIST and lists:
            lists.pop()
            top.block(not lists)
        elif name in ("li", "blockquote", "dd") and top.levels[-1].kind == name:
            top.dedent()
            top.block(name == "blockquote")
        elif name == "select" and top.kind == "select":
            frames.pop()
            chosen = [x for x, selected, _ in top.rows if selected][-1:] or [x for x, _, disabled in top.rows if not disabled][:1]
            at = frames[-2] if frames[-1].kind == "table" else frames[-1]
            at.text(" ".join([x for x, _, _ in top.rows] if top.number else chosen)) if not invisible else None
        elif name == "optgroup" and top.kind == "select":
            top.cells = None
        elif name == "option" and top.kind == "option":
            frames.pop()
            label, selected, disabled = top.rows
            frames[-1].rows.append((label or " ".join(top.done()), selected, disabled))
        elif name == "textarea":
            top.preformatted = max(0, top.preformatted - 1)
        elif name in ("pre", "xmp"):
            top.end()
            top.preformatted = max(0, top.preformatted - 1)
            top.block(True)
        elif name in BLOCK:
            top.block(name in SPACED)
    while len(frames) > 1:
        top = frames.pop()
        for line in top.done() + (aligned(grid([*top.rows, top.cells or None])) if top.kind == "table" else []):
            frames[-1].add(line)
    return "\n".join(frames[0].done())


def _render_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames, text="html"):
        yield frame.drop(columns="html").assign(text=[render(x) for x in frame.html])


def html_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and ``text``, the visible text of ``html``, for every row of ``pages``.

    A null or empty page has an empty text; null and repeated ids stay; an empty table gives no rows; other columns do
    not matter, one named ``text`` among them.
    """
    return through_pandas(pages, keep, _render_all, "text string", html=F.coalesce(F.col("html").cast("string"), F.lit("")))
