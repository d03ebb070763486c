"""HTML to text, laid out.

A tokenizer and a tree builder with the usual implied tags (a paragraph ends
where a block begins, items, cells and rows end each other, what is open at the
end is closed, text in a table but in no cell moves before it) give a tree; a
renderer walks it and writes all visible text: blocks on lines of their own,
paragraphs, headings, lists and tables apart by a blank line, items with marks
or numbers and indented, cells in aligned columns, preformatted text as it is.

Invisible are: head, script, style, template, noscript, the fallbacks of
embedded media and the like; hidden elements, closed dialogs, hidden inputs,
closed details but for their summary; what display:none or visibility:hidden
says, by the cascade: rules of compound selectors (tag, .class, #id, [attribute])
in the order of importance, specificity and place, style attributes after them.
Rules for other media than a screen 1280 pixels wide don't count, nor do
selectors that depend on other elements or on a state. Of a drop-down list the
chosen option is visible, of a list box every one; of svg its text, of math its
formulas.

Everything takes time in proportion to the page: open elements are found by tag,
rules by what they select. Layout has limits, text has none: columns are aligned
up to WIDE characters and a line's first FAR, tables are laid out NESTED deep,
indents DEEP deep; beyond, text only loses its alignment.

Defined results: null gives null, an empty page an empty text; unclosed or
stray tags, rules and quotes never raise; rows that repeat are all rendered;
ids may be null or of any type; other columns may have any names; no rows in
give no rows; equal pages give equal texts.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.plans.util import quoted, spread, table

#: Every alternative that begins matches to its end or to the page's, so no part is scanned twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile(r"[{};]|\"[^\"\n]*+[\"\n]?|'[^'\n]*+['\n]?")
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]*\])*)")
_SIMPLE = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\]\"']*)[\"']?\s*)?\]")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_LENGTH = re.compile(r"(\d+(?:\.\d+)?)(px|r?em)?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist title noembed noframes meta link base desc defs metadata symbol annotation annotation-xml".split())
#: Blocks, and the blank lines around them.
BLOCKS = dict.fromkeys("address article aside div dd dt fieldset figcaption footer form header hgroup li main nav section details summary dialog body html center legend tr td th caption thead tbody tfoot search".split(), 0) | dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu dir xmp".split(), 1)
_ENDS_P = frozenset(BLOCKS) - {"tr", "td", "th", "caption", "thead", "tbody", "tfoot", "html", "body"}
BLOCKS |= {"text": 0, "mtr": 0}
#: What an opening tag closes, up to the bounds.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "select": ({"select"}, {"table", "td", "th", "caption"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_IN_TABLE = frozenset("table thead tbody tfoot tr".split())
_OF_HEAD = frozenset("base link meta script style template title noscript".split())
_SCOPE = frozenset("table td th caption html button".split())
_LISTS = ("ul", "ol", "menu", "dir")
#: Characters of a column that are aligned, of a line; columns; levels of tables and of indents.
WIDE, FAR, COLUMNS, NESTED, DEEP = 100, 400, 1000, 24, 24
SCREEN = 1280


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "_values")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent, self._values = tag, attrs, [], parent, None

    def get(self, name: str) -> str | None:
        """An attribute's value (of several the first); "" if it has none, None if it is missing."""
        if not self.attrs:
            return None
        if self._values is None:
            self._values = {}
            for m in _ATTR.finditer(self.attrs):
                self._values.setdefault(m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or ""))
        return self._values.get(name)


class Open:
    """The open elements, and where those of each tag are."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], defaultdict(list)
        self.at[root.tag].append(0)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            self.at[self.stack.pop().tag].pop()

    def close(self, tags, bounds, first: bool = False) -> None:
        """Closes the outermost (or innermost, if first) open element of tags inside the bounds."""
        bound = max((self.at[b][-1] for b in bounds if b in self.at and self.at[b]), default=0)
        if first:
            found = max((self.at[t][-1] for t in tags if t in self.at and self.at[t]), default=0)
            found = found if found > bound else 0
        else:
            found = 0
            for t in tags:
                places = self.at.get(t)
                k = bisect_right(places, bound) if places else 0
                if places and k < len(places) and (not found or places[k] < found):
                    found = places[k]
        if found:
            self.cut(found)


def parse(page: str) -> tuple[Node, str]:
    """The tree of a page, and its style sheets."""
    root = Node("html")
    open_ = Open(root)
    stack, at_tag = open_.stack, open_.at
    sheets = []
    at, n = 0, len(page)

    def put(text: str) -> None:
        top = stack[-1]
        if top.tag in _IN_TABLE:  # moves before the table
            if not text.isspace():
                k = at_tag["table"][-1] if at_tag["table"] else 0
                if k:
                    siblings = stack[k].parent.children  # an open element is the last child
                    siblings.insert(len(siblings) - 1, text)
                else:
                    top.children.append(text)
            return
        if top.tag == "head":
            if text.isspace():
                return
            open_.cut(len(stack) - 1)
            top = stack[-1]
        top.children.append(text)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if m is None:
            end = page.find("<", lt + 1)
            end = n if end < 0 else end
            put(page[at:end])
            at = end
            continue
        if lt > at:
            put(page[at:lt])
        at = m.end()
        if m.group("cdata") is not None:
            put(html.escape(m.group("cdata"), False))
            continue
        name = m.group("close")
        if name is not None:
            name = name.lower()
            if name == "br":
                stack[-1].children.append(Node("br", "", stack[-1]))
            elif name == "p" and not at_tag["p"]:
                stack[-1].children.append(Node("p", "", stack[-1]))
            elif name not in ("html", "body"):
                open_.close((name,), () if name in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption") else _SCOPE - {name}, True)
            continue
        name = m.group("open")
        if name is None:
            continue
        name = name.lower()
        attrs = m.group("attrs")
        if name == "html":
            root.attrs += " " + attrs
            continue
        if name in _CLOSES:
            open_.close(*_CLOSES[name])
        if name in _ENDS_P:
            open_.close(("p",), _SCOPE, True)
        if stack[-1].tag == "head" and name not in _OF_HEAD:
            open_.cut(len(stack) - 1)
        if name == "body" and at_tag["body"]:
            continue
        if name in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):  # an implied row
            row = Node("tr", "", stack[-1])
            stack[-1].children.append(row)
            open_.push(row)
        top = stack[-1]
        node = Node(name, attrs, top)
        top.children.append(node)
        if name in VOID or (attrs.endswith("/") and (name in ("svg", "math") or at_tag["svg"] or at_tag["math"])):
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.IGNORECASE).search(page, at)
            body = page[at : end.start() if end else n]
            if name == "style":
                if node.get("media") is None or on_screen(node.get("media")):
                    sheets.append(body)
            elif name in ("textarea", "xmp"):
                node.children.append(body)
            at = end.start() if end else n
            if end:
                gt = page.find(">", at)
                at = n if gt < 0 else gt + 1
            continue
        open_.push(node)
    return root, "\n}}\n".join(sheets)  # what a sheet leaves open ends with it


# Style sheets


def _pixels(value: str) -> float | None:
    m = _LENGTH.fullmatch(value.strip())
    return None if m is None else float(m.group(1)) * (16 if m.group(2) in ("em", "rem") else 1)


def _feature(text: str) -> bool:
    """Whether the screen has a media feature; unknown ones it hasn't."""
    if m := re.fullmatch(r"\s*width\s*([<>]=?)\s*([^<>]+)", text):
        size = _pixels(m.group(2))
        return size is not None and (SCREEN == size and "=" in m.group(1) or (SCREEN < size) == (m.group(1)[0] == "<") and SCREEN != size)
    key, _, value = (x.strip() for x in text.partition(":"))
    size = _pixels(value)
    if key in ("min-width", "min-device-width"):
        return size is not None and SCREEN >= size
    if key in ("max-width", "max-device-width"):
        return size is not None and SCREEN <= size
    return (key, value) in (("orientation", "landscape"), ("hover", "hover"), ("pointer", "fine"), ("any-hover", "hover"), ("any-pointer", "fine"), ("color", ""), ("prefers-color-scheme", "light"), ("scripting", "enabled"))


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds for the screen."""
    if not media.strip():
        return True
    for query in media.lower().split(","):
        words = re.sub(r"\([^()]*\)", " ", query).split()
        inverted = "not" in words
        kinds = [w for w in words if w not in ("not", "only", "and", "or")]
        holds = all(k in ("all", "screen") for k in kinds)
        features = [_feature(f) for f in re.findall(r"\(([^()]*)\)", query)]
        holds = holds and (any(features) if "or" in words else all(features))
        if holds != inverted:
            return True
    return False


def hiding(declarations: str) -> list[tuple[str, bool, bool]]:
    """(property, important, whether it hides) of display and visibility, in order."""
    out = []
    for part in declarations.lower().split(";"):
        key, _, value = part.partition(":")
        key, important = key.strip(), "!important" in value.replace(" ", "")
        value = value.partition("!")[0].strip()
        if key == "display" and value:
            out.append((key, important, value == "none"))
        elif key == "visibility" and value in ("hidden", "collapse", "visible"):
            out.append((key, important, value != "visible"))
    return out


Style = tuple[tuple, str, bool]


class Sheet:
    """Rules that hide or show, by what they select: an id, else a class, else an attribute or a tag."""

    def __init__(self, sheet: str):
        self.by: dict[tuple[str, str], list[tuple[str, list, list[Style]]]] = defaultdict(list)
        self.order = 0
        css = _COMMENT.sub(" ", sheet) if "/*" in sheet else sheet
        # Of each open block: whether its rules count, its selectors (None: it is no rule), its declarations.
        stack: list[list] = []
        start, semicolon = 0, -1
        for m in _CSS.finditer(css):
            c = m.group()
            if c == "{":
                counts = stack[-1][0] if stack else True
                if stack and stack[-1][1] is not None:  # a rule inside a rule depends on it
                    stack[-1][2].append(css[start : max(start, semicolon)])
                    stack.append([False, None, []])
                else:
                    head = css[start : m.start()].strip()
                    if head.startswith("@"):
                        name, _, rest = head[1:].partition(" ")
                        inside = on_screen(rest) if name.lower() == "media" else name.lower() in ("supports", "layer", "container", "scope")
                        stack.append([counts and inside, None, []])
                    else:
                        stack.append([counts, head, []])
                start = m.end()
            elif c == "}":
                if stack:
                    counts, head, parts = stack.pop()
                    if head is not None and counts:
                        self.add(head, ";".join([*parts, css[start : m.start()]]))
                start = m.end()
            elif c == ";":
                semicolon = m.end()
                if not stack or stack[-1][1] is None:
                    start = m.end()
        if stack and stack[-1][0] and stack[-1][1] is not None:
            self.add(stack[-1][1], ";".join([*stack[-1][2], css[start:]]))

    def add(self, selectors: str, declarations: str) -> None:
        found = hiding(declarations)
        if not found:
            return
        for s in selectors.split(","):
            m = _COMPOUND.fullmatch(s.strip())
            if not m or not m.group():
                continue
            tag, parts = (m.group(1) or "*").lower(), [x.groups() for x in _SIMPLE.finditer(m.group(2))]
            if (m.group(2).count("[") and "[" not in "".join("[" for p in parts if p[2])):
                continue
            ids, classes = [p[1] for p in parts if p[0] == "#"], [p[1] for p in parts if p[0] == "."]
            weight = (len(ids), len(parts) - len(ids), int(tag != "*"))
            self.order += 1
            styles = [((important, False, *weight, self.order), key, hides) for key, important, hides in found]
            where = ("#", ids[0]) if ids else (".", classes[0]) if classes else ("", tag)
            self.by[where].append((tag, parts, styles))

    def of(self, node: Node) -> list[Style]:
        out: list[Style] = []
        places = [("", node.tag), ("", "*")]
        classes: set[str] = set()
        own = None
        if node.attrs:
            own = node.get("id")
            classes = set((node.get("class") or "").split())
            places += [("#", own)] if own else []
            places += [(".", c) for c in classes]
        for place in places:
            for tag, parts, styles in self.by.get(place, ()):
                if tag in ("*", node.tag) and all(p[1] == own if p[0] == "#" else p[1] in classes if p[0] == "." else node.get(p[2].lower()) is not None and (p[3] is None or node.get(p[2].lower()) == p[3]) for p in parts):
                    out += styles
        return out


def hidden_by(node: Node, sheet: Sheet | None) -> tuple[bool | None, bool | None]:
    """What the cascade says of an element: not displayed, invisible; None: nothing."""
    styles = sheet.of(node) if sheet is not None else []
    if node.attrs and (style := node.get("style")):
        styles += [((important, True, 0, 0, 0, k), key, hides) for k, (key, important, hides) in enumerate(hiding(style))]
    out = {key: hides for _, key, hides in sorted(styles, key=lambda x: x[0])}
    return out.get("display"), out.get("visibility")


# Layout


class Flow:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []
        self.blank = 0
        self.indent: list[str] = []
        self.mark: str | None = None

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            if first:
                self.words.append(first)
            for line in rest:
                self.end(True)
                if line:
                    self.words.append(line)
            return
        s = _SPACES.sub(" ", s)
        if s == " " and not self.words:
            return
        self.words.append(s)

    def end(self, empty: bool = False, pre: bool = False) -> None:
        """Ends the line; an empty one only counts if empty."""
        line = "".join(self.words)
        self.words = []
        if "  " in line and not empty and not pre:
            line = re.sub(" {2,}", " ", line)
        line = line.strip(" ") if not pre and not empty else line.rstrip(" ")
        if line or empty:
            self.emit(line)

    def emit(self, line: str) -> None:
        if self.blank and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.blank = 0
        head = "".join(self.indent[:DEEP])
        if self.mark is not None:
            head = head[: max(0, len(head) - len(self.mark))] + self.mark
            self.mark = None
        self.lines.append((head + line).rstrip(" ") if line or head.strip() else "")

    def block(self, margin: int) -> None:
        self.end()
        self.blank = max(self.blank, margin)


class Grid:
    """A table under construction: cells with their spans, which end at the table's edges."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.until: dict[int, int] = {}  # columns that cells of earlier rows take, and up to which row
        self.next = 0
        self.captions: list[str] = []

    def row(self) -> None:
        self.rows.append([])
        self.next = 0
        if self.until:
            self.until = {c: r for c, r in self.until.items() if r >= len(self.rows)}

    def add(self, lines: list[str], colspan: int, rowspan: int) -> None:
        if not self.rows:
            self.row()
        r, c = len(self.rows), self.next
        while c in self.until and c < COLUMNS:
            c += 1
        colspan = max(1, min(colspan, COLUMNS - c))
        self.next = min(c + colspan, COLUMNS)
        if rowspan > 1:
            self.until.update(dict.fromkeys(range(c, self.next), r + rowspan - 1))
        self.rows[-1].append((c, colspan, lines))

    def render(self) -> list[str]:
        widths: dict[int, int] = {}
        for c, span, lines in sorted((cell for row in self.rows for cell in row), key=lambda x: x[1]):
            need = min(max(map(len, lines), default=0), WIDE)
            have = sum(widths.get(c + j, 0) for j in range(span)) + 2 * (span - 1)
            widths[c + span - 1] = widths.get(c + span - 1, 0) + max(0, need - have)
        starts, at = {}, 0
        for c in range(max(widths, default=-1) + 1):
            starts[c] = min(at, FAR)
            at += widths.get(c, 0) + 2 * (widths.get(c, 0) > 0)
        out = list(self.captions)
        for row in self.rows:
            k, active = 0, [x for x in row if x[2]]
            while active:
                line = ""
                for c, _, lines in active:
                    if lines[k]:
                        line = line.ljust(starts.get(c, FAR))
                        if line and not line.endswith("  "):
                            line += "  "
                        line += lines[k]
                if line or k:
                    out.append(line.rstrip())
                k += 1
                active = [x for x in active if len(x[2]) > k]
        return out


def _number(value: str | None, least: int, most: int, default: int) -> int:
    try:
        return min(most, max(least, int(value.strip()))) if value and len(value) < 12 else default
    except ValueError:
        return default


def options(select: Node) -> list[str]:
    """The texts of the options that a select shows: all of a list box, the chosen one (else the first) of a drop-down list."""
    found, work = [], list(reversed(select.children))
    while work:
        node = work.pop()
        if isinstance(node, str) or node.tag in UNSEEN or node.get("hidden") is not None:
            continue
        if node.tag == "option":
            parts, inner = [], list(reversed(node.children))
            while inner:
                x = inner.pop()
                parts += [x] if isinstance(x, str) else []
                inner += [] if isinstance(x, str) or x.tag in UNSEEN else reversed(x.children)
            text = _SPACES.sub(" ", html.unescape("".join(parts))).strip() or node.get("label") or ""
            found.append((text, node.get("selected") is not None, node.get("disabled") is not None))
        else:
            work.extend(reversed(node.children))
            if node.tag == "optgroup" and node.get("label"):
                found.append((node.get("label"), False, True))
    if select.get("multiple") is not None or _number(select.get("size"), 0, 1000, 0) > 1:
        return [f[0] for f in found]
    chosen = [f for f in found if f[1]][-1:] or [f for f in found if not f[2]][:1]
    return [f[0] for f in chosen]


def render(page: str | None) -> str | None:
    """The visible text of a page."""
    if page is None:
        return None
    root, css = parse(page)
    sheet = Sheet(css) if "display" in css.lower() or "visibility" in css.lower() else None
    sheet = sheet if sheet is not None and sheet.by else None
    flows = [Flow()]
    grids: list[Grid | None] = []
    lists: list[list] = []
    work: list = [(root, False, False, False)]  # node, exit?, hidden, preformatted
    while work:
        node, leave, hidden, pre = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not hidden:
                flow.text(html.unescape(node) if "&" in node else node, pre)
            continue
        tag = node.tag
        margin = BLOCKS.get(tag)
        grid = grids[-1] if grids else None
        if leave:
            if tag == "pre" or tag == "xmp":
                flow.end(pre=True)
                flow.block(1)
            elif tag in ("td", "th") and grid is not None:
                flow.end()
                flows.pop()
                grid.add(flow.lines, _number(node.get("colspan"), 1, COLUMNS, 1), _number(node.get("rowspan"), 1, 65534, 1))
            elif tag == "caption" and grid is not None:
                flow.end()
                grid.captions += flow.lines
                flows.pop()
            elif tag == "table":
                grids.pop()
                if grid is not None:
                    for line in grid.render():
                        flow.emit(line)
                    flow.blank = 1
                else:
                    flow.block(1)
            elif margin is not None:
                if tag == "li" and flow.mark is not None and lists:
                    flow.end()
                flow.block(margin if not (tag in _LISTS and len(lists) > 1) else 0)
                if tag == "li" and lists:
                    flow.mark = None
                    flow.indent.pop()
                elif tag in _LISTS:
                    lists.pop()
                elif tag in ("blockquote", "dd"):
                    flow.indent.pop()
            continue
        if tag in UNSEEN:
            continue
        gone = tag == "dialog" and node.get("open") is None
        if sheet is not None or node.attrs:
            gone = gone or node.get("hidden") is not None
            none, invisible = hidden_by(node, sheet)
            gone = none if none is not None else gone
            gone = gone or tag == "input" and (node.get("type") or "").lower() == "hidden"
            hidden = invisible if invisible is not None else hidden
        if gone:
            continue
        if tag == "br":
            if not hidden:
                flow.end(empty=not flow.words and not pre or pre)
            continue
        if tag == "hr":
            flow.block(1)
            continue
        if tag in VOID:
            if tag == "input" and not hidden and (node.get("type") or "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number", "date") and node.get("value"):
                flow.text(node.get("value"), pre)
            continue
        if tag == "select":
            shown = options(node) if not hidden else []
            for k, text in enumerate(shown):
                if len(shown) > 1:
                    flow.block(0)
                flow.text(text, False)
                if k and k == len(shown) - 1:
                    flow.block(0)
            continue
        if tag in ("td", "th", "caption") and grid is not None:
            flows.append(Flow())
        elif tag == "table":
            flow.block(1)
            grids.append(Grid() if len(grids) < NESTED else None)
        elif tag == "tr" and grid is not None:
            grid.row()
        elif margin is not None:
            inside = tag in _LISTS and bool(lists)
            flow.block(0 if inside else margin)
            if tag == "ol":
                lists.append([_number(node.get("start"), -(10**9), 10**9, 1)])
            elif tag in _LISTS:
                lists.append([None])
            elif tag == "li" and lists:
                mark = "- "
                if lists[-1][0] is not None:
                    lists[-1][0] = _number(node.get("value"), -(10**9), 10**9, lists[-1][0])
                    mark = f"{lists[-1][0]}. "
                    lists[-1][0] += 1
                flow.indent.append(" " * len(mark))
                flow.mark = mark if not hidden else None
            elif tag in ("blockquote", "dd"):
                flow.indent.append("  ")
        pre = pre or tag in ("pre", "textarea", "xmp")
        children = node.children
        if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        if tag == "details" and node.get("open") is None:
            children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
        work.append((node, True, hidden, pre))
        work.extend((c, False, hidden, pre) for c in reversed(children))
    flows[0].end()
    return "\n".join(flows[0].lines).strip("\n")


def visible_text():
    """A column function: HTML to its visible text."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([render(p.as_py()) for p in pages], pa.string())

    return text


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every row."""
    rows = spread(pages.select(quoted(id_col).alias("page_id"), quoted(html_col).cast("string").alias("html")))
    return rows.select("page_id", visible_text()(F.col("html")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
