"""All visible text of a web page, laid out: a tree builder with implied tags, visibility rules, and a
renderer that keeps block spacing, lists, and aligned table cells.

Nothing here recurses. As in browsers, elements beyond DEPTH open ones are put beside each other.
"""

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows

# Fixed values of HTML: element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title object audio video canvas "
                   "datalist meta link base".split())
#: Parts of drawings and formulas that aren't rendered where they stand.
UNDRAWN = frozenset("desc defs metadata symbol clippath mask pattern marker filter".split())
UNSET = frozenset("annotation annotation-xml mphantom".split())
#: Elements of drawings and formulas in which HTML begins anew, and formulas whose parts stand apart.
HTML_AGAIN = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
APART = frozenset("mfrac mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr".split())
#: Start tags that end an open drawing or formula.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
                     "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Inputs that show no text of their own, and those that show their placeholder while empty.
WORDLESS = frozenset("hidden checkbox radio file password color range image".split())
LABELLED = frozenset("button submit reset date time month week datetime-local".split())
#: Blocks with a blank line before and after, and blocks that only start and end a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu dir listing xmp".split())
PLAIN = frozenset("html body div section article aside header footer nav main address center form hgroup search "
                  "figcaption details summary dialog legend li dt dd caption option optgroup tr hr".split())
#: What the start of an element closes, and the elements beyond which it closes nothing.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul "
                   "dt dd listing xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BARRIER = frozenset("table td th caption html template button object marquee applet foreignobject".split())
CLOSES = {
    "li": ({"li"}, BARRIER | {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, BARRIER | {"dl"}),
    "dd": ({"dt", "dd"}, BARRIER | {"dl"}), "option": ({"option"}, BARRIER | {"select"}),
    "optgroup": ({"option", "optgroup"}, BARRIER | {"select"}), "tr": ({"tr"}, {"table", "html", "template"}),
    "td": ({"td", "th"}, {"tr", "table", "html", "template"}), "th": ({"td", "th"}, {"tr", "table", "html", "template"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table", "html", "template"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table", "html", "template"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table", "html", "template"}),
}
HEAD_PARTS = frozenset("base link meta title style script noscript template head".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
SPACE = " \t\n\r\f"
#: Elements that can be open at once.
DEPTH = 512

TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)
    |/[^a-zA-Z>][^>]*+(?:>|\Z)|/>|(?P<start>[a-zA-Z][^\s/>]*+)
    (?:(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<broken>[^>]*+)(?:>|\Z)))""", re.S | re.X)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?=;|$)", re.I)


class Element:
    """A node: its children are elements and strings."""

    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []

    def values(self) -> dict[str, str]:
        if not self.attributes or self.attributes.isspace():
            return {}
        found: dict[str, str] = {}
        for name, a, b, c in ATTRIBUTE.findall(self.attributes):
            found.setdefault(name.lower(), html.unescape(a or b or c))
        return found


class TreeBuilder:
    """Elements as a browser would nest them: implied starts and ends, stray end tags ignored."""

    def __init__(self):
        self.root = Element("html")
        self.open, self.body, self.styles = [self.root], None, []
        self.drawn = False  # a drawing or formula was open before

    def _in_body(self) -> None:
        """The head ends, and the body starts, with the first thing that belongs there."""
        if self.body is None:
            del self.open[1:]
            self.body = Element("body")
            self.root.children.append(self.body)
            self.open.append(self.body)

    def _pop_to(self, names, barrier) -> bool:
        """Close the innermost open element of ``names`` that no ``barrier`` hides."""
        for at in range(len(self.open) - 1, 1, -1):
            name = self.open[at].name
            if name in names:
                del self.open[at:]
                return True
            if name in barrier:
                return False
        return False

    def foreign(self) -> bool:
        """Whether tags belong to an open drawing or formula."""
        if self.drawn:
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].name in ("svg", "math"):
                    return True
                if self.open[at].name in HTML_AGAIN:
                    return False
        return False

    def _push(self, element: Element, stays: bool) -> None:
        self.open[-1].children.append(element)
        if stays and len(self.open) < DEPTH:
            self.open.append(element)

    def text(self, data: str) -> None:
        if self.body is None:
            if not data.strip(SPACE):
                return
            self._in_body()
        self.open[-1].children.append(data)

    def start(self, name: str, attributes: str, raw: str | None) -> None:
        if self.foreign():
            if name not in BREAKOUT:
                if raw is not None and name == "style":
                    self.styles.append(raw)
                self._push(Element(name, attributes), raw is None and not attributes.endswith("/"))
                return
            while self.foreign():
                self.open.pop()
        if name in ("html", "body"):
            if name == "body":
                self._in_body()
            target = self.root if name == "html" else self.body
            target.attributes = target.attributes or attributes
            return
        if self.body is None:
            if name == "head":
                if len(self.open) == 1:
                    self._push(Element("head", attributes), True)
                return
            if name in HEAD_PARTS:
                if len(self.open) == 1:
                    self._push(Element("head"), True)
            else:
                self._in_body()
        if name in BLOCKS:
            self._pop_to({"p"}, BARRIER)
        if name in HEADINGS and self.open[-1].name in HEADINGS:
            self.open.pop()
        if name in CLOSES:
            self._pop_to(*CLOSES[name])
        if name in TABLE_PARTS:
            inside = [e.name for e in self.open[-12:]]
            if "table" in inside:
                inside = inside[len(inside) - 1 - inside[::-1].index("table"):]
            if name in ("td", "th") and "tr" not in inside:
                self._push(Element("tr"), True)
        element = Element(name, attributes)
        if raw is not None:
            if name == "style":
                self.styles.append(raw)
            element.children.append(raw)
            self._push(element, False)
        else:
            drawing = name in ("svg", "math")
            self.drawn = self.drawn or drawing
            self._push(element, name not in VOID and not (drawing and attributes.endswith("/")))

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "", None)
        elif name == "p" and not self._pop_to({"p"}, BARRIER):
            self._in_body()
            self._push(Element("p"), False)
        elif name == "head" and self.body is None:
            del self.open[1:]
        elif name in HEADINGS:
            self._pop_to(HEADINGS, BARRIER)
        elif name not in ("html", "body", "p"):
            stop = {"table", "html"} if name in TABLE_PARTS else BARRIER if name not in BARRIER else {"html"}
            self._pop_to({name}, stop - {name})


def tree(source: str) -> TreeBuilder:
    builder, at = TreeBuilder(), 0
    while True:
        tag = TAG.search(source, at)
        data = source[at:tag.start() if tag else len(source)]
        if data:
            builder.text(html.unescape(data) if "&" in data else data)
        if not tag:
            return builder
        at = tag.end()
        if name := tag["start"]:
            name, raw = name.lower(), None
            if name in RAW and not (builder.foreign() and (
                    name not in ("script", "style") or (tag["attributes"] or "").endswith("/"))):
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                raw = source[at:close.start() if close else len(source)]
                at = close.end() if close else len(source)
                if name in ("textarea", "title"):
                    raw = html.unescape(raw)
            builder.start(name, tag["attributes"] or tag["broken"] or "", raw)
        elif name := tag["end"]:
            builder.end(name.lower())
        elif source.startswith("<![CDATA[", tag.start()) and builder.foreign():
            close = source.find("]]>", tag.start())
            builder.text(source[tag.start() + 9:close if close >= 0 else len(source)])
            at = close + 3 if close >= 0 else len(source)


def hidden_by_sheets(styles: list[str]) -> frozenset[str]:
    """Simple selectors (element, .class, #id) that a style sheet hides."""
    out = set()
    for sheet in styles:
        for selectors, body in RULE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
            if HIDING.search(body):
                out |= {s.strip() for s in selectors.split(",") if re.fullmatch(r"\s*[.#]?[\w-]+\s*", s)}
    return frozenset(out)


def seen(element: Element, values: dict[str, str], hidden: frozenset[str]) -> bool:
    if element.name in UNSEEN or "hidden" in values or HIDING.search(values.get("style", "")):
        return False
    if element.name == "dialog" and "open" not in values:
        return False
    if hidden:
        names = {element.name, "#" + values.get("id", "")} | {"." + c for c in values.get("class", "").split()}
        return not names & hidden
    return True


def drawn(name: str, values: dict[str, str], place: str) -> bool:
    """Whether a drawing (``place`` svg or text) or a formula (math) shows this part."""
    if place == "math":
        return name not in UNSET
    return name not in UNDRAWN and values.get("display") != "none" and values.get("visibility") not in ("hidden", "collapse")


def input_text(values: dict[str, str]) -> str:
    """What an input shows: its value, or its placeholder while it is empty."""
    kind = values.get("type", "").lower()
    if kind == "password":
        return "" if values.get("value") else values.get("placeholder", "")
    if kind in WORDLESS:
        return ""
    return values.get("value", "") or ("" if kind in LABELLED else values.get("placeholder", ""))


class Flow:
    """Lines of text with collapsed white space, blank lines between spaced blocks, and indents."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space, self.indents = 0, False, []

    def _begin(self) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0

    def text(self, data: str, kept: bool = False) -> None:
        if kept:
            if self.line and self.space:
                self.line.append(" ")
            self.space = False
            for i, piece in enumerate(data.split("\n")):
                if i:
                    self.end_line(True)
                if piece and not self.line:
                    self._begin()
                if piece:
                    self.line.append(piece)
            return
        words = data.translate(COLLAPSE).split(" ")
        inside = [w for w in words if w]
        if not inside:
            self.space = self.space or bool(self.line)
            return
        if not self.line:
            self._begin()
        elif self.space or not words[0]:
            self.line.append(" ")
        self.line.append(" ".join(inside))
        self.space = not words[-1]

    def put(self, text: str) -> None:
        """A finished line, for example of a table."""
        self._begin()
        self.line.append(text)
        self.end_line(True)

    def end_line(self, forced: bool = False) -> None:
        if self.line or forced:
            if not self.line:
                self._begin()
            prefix = "".join(i[0] for i in self.indents)
            for indent in self.indents:
                indent[0] = " " * len(indent[0])
            self.lines.append((prefix + "".join(self.line)).rstrip(" "))
        self.line, self.space = [], False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self.lines


#: White space of HTML that collapses to one space.
COLLAPSE = {ord(c): " " for c in SPACE}


class Table:
    """Cells by row; columns get the width of their widest cell."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.caption: list[str] = []
        self.taken: list[int] = []  # rows that a cell from above still takes, by column

    def row(self) -> None:
        self.rows.append([])
        self.taken = [max(0, n - 1) for n in self.taken]

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        at = sum(n for n, _ in row)
        while at < len(self.taken) and self.taken[at]:
            row.append((1, []))
            at += 1
        row.append((across, lines))
        self.taken += [0] * (at + across - len(self.taken))
        for i in range(at, at + across):
            self.taken[i] = down

    def lines(self) -> list[str]:
        widths: list[int] = []
        for spans in (False, True):  # cells of one column first, then those that need more than their columns have
            for row in self.rows:
                at = 0
                for across, lines in row:
                    widths += [0] * (at + across - len(widths))
                    need = max(map(len, lines), default=0)
                    if spans == (across > 1):
                        have = sum(widths[at:at + across]) + 2 * (across - 1)
                        widths[at + across - 1] += max(0, need - have)
                    at += across
        out = list(self.caption)
        for row in self.rows:
            for i in range(max((len(lines) for _, lines in row), default=0)):
                at, parts = 0, []
                for across, lines in row:
                    width = sum(widths[at:at + across]) + 2 * (across - 1)
                    parts.append((lines[i] if i < len(lines) else "").ljust(width))
                    at += across
                out.append("  ".join(parts).rstrip(" "))
        return out


def number(text: str | None, least: int, most: int) -> int:
    digits = re.match(r"\s*(\d{1,6})", text or "")
    return min(most, max(least, int(digits[1]))) if digits else least


def render(source: str) -> str:
    """The page's visible text. An empty page, or one with nothing visible, gives an empty string."""
    builder = tree(source)
    hidden = hidden_by_sheets(builder.styles)
    flows, tables, lists = [Flow()], [], []
    kept, places = 0, []  # places: the open drawings and formulas, and the texts and HTML in them
    todo: list = [(builder.root, None)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not places or places[-1] != "svg":
                flow.text(node, kept > 0)
            continue
        name = node.name
        if leaving is not None:
            if name in ("td", "th", "caption") and leaving:
                lines = flows.pop().done()
                if name == "caption":
                    tables[-1].caption += lines
                else:
                    values = node.values()
                    tables[-1].cell(lines, number(values.get("colspan"), 1, 100), number(values.get("rowspan"), 1, 1000))
            elif name == "table":
                flow = flows[-1]
                for line in tables.pop().lines():
                    flow.put(line)
                flow.block(2)
            elif name in ("ul", "ol", "menu", "dir"):
                lists.pop()
                flow.block(2 if not lists else 1)
            elif name in ("li", "dd", "blockquote"):
                flow.block(2 if name == "blockquote" else 1)
                flow.indents.pop()
            elif name in SPACED:
                flow.block(2)
            elif name in PLAIN:
                flow.block(1)
            elif name in ("text", "foreignobject") and places:
                flow.block(1)
            elif name == "math" and node.values().get("display") == "block":
                flow.block(1)
            if name in ("svg", "math") or (places and name in ("text", "foreignobject")):
                places.pop()
            kept -= name in ("pre", "listing", "xmp", "textarea")
            continue
        values = node.values()
        if not seen(node, values, hidden) or (places and places[-1] != "html" and not drawn(name, values, places[-1])):
            continue
        if name == "br":
            flow.end_line(True)
            continue
        if name == "hr":
            flow.block(2)
            continue
        if name == "input":
            flow.text(input_text(values))
            continue
        apart = name in ("td", "th", "caption") and bool(tables)
        if apart:
            flows.append(Flow())
        elif name == "table":
            flow.block(2)
            tables.append(Table())
        elif name == "tr" and tables:
            tables[-1].row()
        elif name in ("ul", "ol", "menu", "dir"):
            flow.block(2 if not lists else 1)
            lists.append([name, number(values.get("start"), 1, 999999) if "start" in values else 1])
        elif name == "li":
            flow.block(1)
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{number(values.get('value'), 1, 999999) if 'value' in values else lists[-1][1]}. "
                lists[-1][1] += 1
            flow.indents.append([mark])
        elif name in ("dd", "blockquote"):
            flow.block(2 if name == "blockquote" else 1)
            flow.indents.append(["  "])
        elif name in SPACED:
            flow.block(2)
        elif name in PLAIN:
            flow.block(1)
        elif name in ("text", "foreignobject") and places:
            flow.block(1)
        elif name == "math" and values.get("display") == "block":
            flow.block(1)
        if name in ("svg", "math") or (places and name in ("text", "foreignobject")):
            places.append("html" if name == "foreignobject" else name)
        kept += name in ("pre", "listing", "xmp", "textarea")
        children = node.children
        if name in APART and places and places[-1] == "math":
            children = [x for c in children for x in (c, " ")][:-1]
        if name == "details" and "open" not in values:  # a closed one shows its summary
            children = [c for c in children if isinstance(c, Element) and c.name == "summary"][:1]
        todo.append((node, apart))
        todo += [(c, None) for c in reversed(children)]
    return "\n".join(flows[0].done())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars, n_lines) of every page; NULL and empty pages have an empty text and no lines.

    One row for each row, repeats and NULL page_ids included; extra columns are ignored; no shuffle.
    """
    def work(rows: dict) -> dict:
        texts = [render(h or "") for h in rows["html"]]
        return {"page_id": rows["page_id"], "text": texts, "n_chars": [len(t) for t in texts],
                "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]}

    thin = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"))
    return text_rows(thin, "page_id bigint, text string, n_chars bigint, n_lines bigint", work)
