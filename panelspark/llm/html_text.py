"""Visible text of HTML pages, laid out: a tree with implied tags, visibility rules, blocks, lists, aligned tables."""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.tokens import slices

# Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("""head title script style template noscript noframes noembed iframe object embed audio video canvas
    datalist map area param source track link meta base col colgroup input desc metadata defs annotation annotation-xml""".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset form".split())
BLOCKS = PARAGRAPHS | frozenset("""html body div section article aside nav header footer main address li dt dd tr td th caption
    thead tbody tfoot figcaption details summary center legend dialog menu hgroup search option optgroup""".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul""".split())
# A start tag on the left ends an open element on the right, unless one of the last set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"optgroup"}, {"select"}), "body": ({"head"}, set()),
}
_SCOPE = frozenset("html table td th caption template object".split())
_HEAD = frozenset("html head title meta link base style script noscript template".split())

# A quote opens a string only directly after the = of an attribute; one that never closes goes up to the first >.
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|["'][^>]*+|[^\s>]++)?+"""
_TAG = re.compile(rf"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?+[^\s=/>]++(?:{_VALUE})?+|=)*+)>""")
_ATTRIBUTE = re.compile(r"""(=?[^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(["'][^>]*|[^\s>]+)))?""")
_GONE = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)
_COMMENT_END = re.compile(r"--!?>")
_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_BLANK = re.compile(r"[ \t\n\f\r]+")

# Bounds of the layout alone; no text is cut.
MOST_INDENT = 16
MOST_PADDING = 40
MOST_COLUMNS = 1000
# A table that would need more padding than so many times its text (and some more) has its cells side by side only.
MOST_PADDING_SHARE = 4
_SOME_PADDING = 2000


class Node:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.children, self.parent = name, attrs, [], parent


def _decode(text: str) -> str:
    """References replaced; a number of many digits is cut to its value or, beyond all characters, is U+FFFD."""
    def shorter(m):
        hexadecimal = m[0][2] in "xX"
        digits = m[0][3 if hexadecimal else 2:].rstrip(";").lstrip("0") or "0"
        return f"&#{'x' * hexadecimal}{digits};" if len(digits) < 8 else "\ufffd"

    return unescape(_NUMBER.sub(shorter, text) if "&#" in text else text)


def tokens(html: str):
    """("text", s), ("start", name, attribute text) and ("end", name); comments and declarations are left out."""
    at, end = 0, len(html)
    while at < end:
        mark = html.find("<", at)
        if mark < 0:
            yield "text", _decode(html[at:]), ""
            return
        if mark > at:
            yield "text", _decode(html[at:mark]), ""
        following = html[mark + 1:mark + 2]
        if html.startswith("<!--", mark):
            short = next((x for x in ("<!-->", "<!--->") if html.startswith(x, mark)), "")
            stop = None if short else _COMMENT_END.search(html, mark + 4)
            at = mark + len(short) if short else stop.end() if stop else end
        elif following in ("!", "?") or html.startswith("</", mark) and not html[mark + 2:mark + 3].isalpha():
            stop = html.find(">", mark)
            at = end if stop < 0 else stop + 1
        elif following.isascii() and following.isalpha() or following == "/":
            found = _TAG.match(html, mark)
            if not found:  # the page ends within a tag
                return
            name, at = found[2].lower(), found.end()
            yield "end" if found[1] else "start", name, found[3]
            if not found[1] and name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                stop = close.start() if close else end
                text = html[at:stop]
                yield "text", _decode(text) if name in ("title", "textarea") else text, ""
                at = stop
        else:
            yield "text", "<", ""
            at = mark + 1


def _attributes(text: str) -> dict:
    out: dict = {}
    if text.strip(" /\n\t"):
        for name, a, b, c in _ATTRIBUTE.findall(text):
            out.setdefault(name.lower(), _decode(a or b or c))
    return out


def tree(html: str) -> Node:
    """The elements of a page, with end tags supplied where they may be left out and stray ones ignored."""
    root = Node("html", {}, None)
    body = None
    here = root
    open_names: dict[str, int] = {"html": 1}

    def enter(name, attrs):
        nonlocal here
        node = Node(name, attrs, here)
        here.children.append(node)
        here = node
        open_names[name] = open_names.get(name, 0) + 1

    def leave(node):
        nonlocal here
        while True:
            done, here = here, here.parent or root
            open_names[done.name] -= 1
            if done is node:
                return

    def nearest(names, barrier):
        node = here if any(open_names.get(n) for n in names) else None
        while node is not None and node.parent is not None:
            if node.name in names:
                return node
            if node.name in barrier:
                return None
            node = node.parent
        return None

    for kind, name, rest in tokens(html):
        if kind == "text":
            if name:
                here.children.append(name)
        elif kind == "start":
            if name == "html" or name == "body" and body is not None:
                continue
            if name not in _HEAD and (head := nearest({"head"}, ())) is not None:
                leave(head)
            if name in CLOSES_P and (node := nearest({"p"}, _SCOPE)) is not None:
                leave(node)
            if name in ENDS and (node := nearest(*ENDS[name])) is not None:
                leave(node)
            if name == "tr" and here.name == "table":
                enter("tbody", {})
            elif name in ("td", "th") and here.name in ("table", "thead", "tbody", "tfoot"):
                enter("tr", {})
            enter(name, _attributes(rest))
            if name == "body":
                body = here
            if name in VOID:
                leave(here)
        elif name == "br":
            here.children.append(Node("br", {}, here))
        elif name not in ("html", "body"):
            barrier = _SCOPE if name not in _SCOPE | {"tr", "tbody", "thead", "tfoot"} else {"table"} - {name}
            if (node := nearest({name}, barrier)) is not None:
                leave(node)
    return root


def displayed(node: Node) -> bool:
    return not (node.name in HIDDEN or "hidden" in node.attrs or "style" in node.attrs and _GONE.search(node.attrs["style"]))


def seen(node: Node, parent_seen: bool) -> bool:
    """Visibility is that of the parent unless the element has its own: a hidden element may hold a visible one."""
    own = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else None
    return own[-1].lower() == "visible" if own else parent_seen


class Flow:
    """Lines of text; breaks asked for are kept until text comes, and the largest counts."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.breaks, self.space, self.indent, self.mark = 0, False, 0, ""

    def ask(self, breaks: int):
        self.breaks = max(self.breaks, breaks)

    def _open(self):
        if self.breaks:
            self.flush()
            if self.lines and self.breaks > 1:
                self.lines.append("")
            self.breaks, self.space = 0, False
        if not self.now:
            pad = "  " * min(self.indent, MOST_INDENT)
            if self.mark:
                pad = pad[:-2] + self.mark
            self.now, self.mark, self.space = [pad], "", False

    def flush(self):
        if self.now:
            self.lines.append("".join(self.now).rstrip())
        self.now = []

    def text(self, s: str):
        words = _BLANK.sub(" ", s)
        bare = words.strip(" ")
        if not bare:
            self.space = self.space or bool(words)
            return
        self._open()
        if (self.space or words[0] == " ") and len(self.now) > 1:
            self.now.append(" ")
        self.now.append(bare)
        self.space = words[-1] == " "

    def verbatim(self, s: str):
        for i, line in enumerate(s.split("\n")):
            if i:
                if not self.now:
                    self._open()
                self.flush()
            if line:
                self._open()
                self.now.append(line)

    def new_line(self):
        if self.breaks or not self.now:
            self._open()
        self.flush()

    def result(self) -> str:
        self.flush()
        return "\n".join(self.lines).replace("\xa0", " ").strip("\n")


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "")
    return max(1, min(most, int(value))) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def _lay_table(rows: list[list[tuple[Node, str]]]) -> list[str]:
    """Cells that begin at the same column start at the same place; spans take the columns they cover.

    Only columns where some cell begins take room, so a span costs nothing by itself.
    """
    placed, spanning = [], []  # spanning: (first column, column after, rows left) of cells from rows above
    for row in rows:
        line, column, above = [], 0, iter(sorted(spanning))
        following = next(above, None)
        new = []
        for cell, text in row:
            while following and following[0] <= column:
                column = max(column, following[1])
                following = next(above, None)
            across, down = _span(cell, "colspan", MOST_COLUMNS), _span(cell, "rowspan", 65_534)
            line.append((column, column + across, text))
            if down > 1:
                new.append((column, column + across, down))
            column += across
        spanning = [(a, b, n - 1) for a, b, n in spanning + new if n > 1]
        placed.append(line)
    starts = sorted({a for line in placed for a, _, _ in line})
    widths = [0] * len(starts)
    for line in placed:
        for a, b, text in line:
            at = bisect_left(starts, a)
            if at + 1 == len(starts) or starts[at + 1] >= b:
                widths[at] = max(widths[at], min(len(text), MOST_PADDING))
    reach = [0]  # where each column starts, if none is wider than its width
    for w in widths:
        reach.append(reach[-1] + w + 3)
    room = sum(reach[bisect_left(starts, line[-1][0])] for line in placed if line)
    aligned = room <= MOST_PADDING_SHARE * sum(len(t) for line in placed for *_, t in line) + _SOME_PADDING
    lines = []
    for line in placed:
        out, at = [], 0
        for a, b, text in line:
            column = bisect_left(starts, a)
            if aligned:
                out += [" " * w for w in widths[at:column]]
                at = max(column + 1, bisect_left(starts, b))
                text = text.ljust(min(reach[at] - reach[column] - 3, MOST_PADDING * (at - column))) if (a, b, text) is not line[-1] else text
            out.append(text)
        lines.append(" | ".join(out).rstrip())
    return [x for x in lines if x.strip(" |")]


def render(html: str | None) -> str:
    """The visible text of a page. Works without recursion, so depth does not matter."""
    if not html:
        return ""
    flow = Flow()
    flows, tables, lists = [], [], []
    pre = 0
    # A node to enter, with whether its parent is seen; or one to leave, with whether it opened a cell.
    stack = [(tree(html), True, True)]
    while stack:
        node, entering, flag = stack.pop()
        if isinstance(node, str):
            if flag:
                flow.verbatim(node) if pre else flow.text(node)
            continue
        name = node.name
        if entering:
            if not displayed(node):
                continue
            flag = seen(node, flag)
            cell = name in ("td", "th") and bool(tables and tables[-1])
            if name == "br":
                flow.new_line()
                continue
            if name in BLOCKS:
                flow.ask(2 if name in PARAGRAPHS and not (lists and name in ("ul", "ol", "dl")) else 1)
            if name in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "")
                lists.append([int(start) if name == "ol" and start.isascii() and start.isdigit() and len(start) < 10 else 1, name == "ol"])
                flow.indent += 1
            elif name == "li" and lists:
                number, ordered = lists[-1]
                lists[-1][0] += 1
                flow.mark = f"{number}. " if ordered else "- "
            elif name in ("dd", "blockquote"):
                flow.indent += 1
            elif name == "pre":
                pre += 1
            elif name == "table":
                tables.append([])
            elif name == "tr" and tables:
                tables[-1].append([])
            elif cell:
                tables[-1][-1].append(None)
                flows.append((flow, tables[-1][-1], len(tables[-1][-1]) - 1))
                flow = Flow()
            stack.append((node, False, cell))
            stack += [(c, True, flag) for c in reversed(node.children)]
            continue
        if flag and name in ("td", "th"):
            text = " ".join(flow.result().split())
            flow, row, place = flows.pop()
            row[place] = (node, text)
        elif name == "table":
            flow.ask(2)
            for line in _lay_table(tables.pop()):
                flow.verbatim(line)
                flow.ask(1)
        elif name in ("ul", "ol", "menu"):
            lists.pop()
            flow.indent -= 1
            flow.mark = ""
        elif name in ("dd", "blockquote"):
            flow.indent -= 1
        elif name == "pre":
            pre -= 1
        elif name == "li":
            flow.mark = ""
        if name in BLOCKS:
            flow.ask(2 if name in PARAGRAPHS and not (lists and name in ("ul", "ol", "dl")) else 1)
    return flow.result()


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text, the visible text of the whole page, for every row.

    Blocks stand on lines of their own, paragraphs between empty lines; list items have a bullet or number and
    are indented by depth (at most MOST_INDENT steps); cells of a table are aligned (padded to MOST_PADDING
    characters at most, longer ones kept whole; side by side only where padding would outgrow the text); pre keeps its lines.
    Text areas, options, formulas and texts of drawings are shown. Left out: head, scripts, styles, inputs, embedded
    objects, hidden elements (not visible ones within). No markup, however broken, is an error. A null or empty page has an empty text; null, equal and
    repeated ids stay; an empty table gives no rows. Other columns are not read. A map: no row moves.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))

    def laid_out(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [render(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return rows.mapInArrow(laid_out, f"page_id {rows.schema['page_id'].dataType.simpleString()}, text string")
