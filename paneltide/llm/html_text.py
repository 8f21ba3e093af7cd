"""Visible text of HTML pages with their layout (operator 6).

A tree builder reads the tags (with the end tags that HTML implies and void elements) and
visibility rules take out what a browser does not show: elements that are not rendered, the
hidden attribute and CSS in style attributes (of a property the last declaration counts, an
important one first; ``display`` takes out all inside, ``visibility`` is inherited and can be
set back).  Labels of SVG, MathML and the options that a
list shows are text like any other; what SVG repeats by ``use`` is not.  The tree is then laid out: blocks
are set apart by line breaks, paragraphs by blank lines, list items get their marks and
indents, table cells are padded to columns, with the grid that ``rowspan`` and ``colspan`` make.
All visible text is emitted.

Pages are independent: one pass of Arrow batches, no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paneltide.llm.common import arrow_session

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset(
    "head script style template noscript iframe noembed noframes object audio video canvas datalist title "
    "meta link base param source track area".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
LISTS = frozenset("ul ol menu dir".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An end tag does not reach beyond these.
SCOPE = frozenset("table td th caption html template".split())
#: A start tag closes the first open element of these, unless a barrier comes first.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "input": ({"select"}, SCOPE),
    "textarea": ({"select"}, SCOPE),
}
CLOSES_P = (BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "html", "body", "legend"}) | {"li"}

#: Start tags that leave SVG and MathML when they come in it, and the elements that hold HTML.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HTML_POINTS = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext".split())}
#: What is not shown of SVG and MathML; of the children of some elements only the first is.
FOREIGN_HIDDEN = {
    "svg": frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter title desc metadata style script".split()),
    "math": frozenset(["mphantom"]),
}
FIRST_SHOWN = {"svg": frozenset(["switch"]), "math": frozenset("semantics maction".split())}

# A quote opens a run only directly after "="; anywhere else it is an ordinary character and
# the tag ends at the next ">", as in the HTML tokenizer.
_WS = r"[ \t\n\r\f]"
_VALUE = r"(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\r\f>\"'][^ \t\n\r\f>]*+))"
_ATTRIBUTE = rf"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:{_WS}*+={_WS}*+{_VALUE}?+)?+"
ATTRIBUTE = re.compile(_ATTRIBUTE)
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)"
    rf"((?:[ \t\n\r\f/]++|{re.sub(r'(?<!\\)\((?!\?)', '(?:', _ATTRIBUTE)})*+)(?:>|\Z)",
    re.S,
)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: A declaration ends at ";" outside of quotes and parentheses.
DECLARATION = re.compile(r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|\([^)]*+(?:\)|\Z)|[^;\"'(])++")
SPACES = re.compile(r"[ \t\n\r\f]+")
# Types of input whose value is not on the page as text, and limits of spans in HTML.
NO_VALUE = frozenset("checkbox radio password file color range hidden image".split())
MOST_COLUMNS, MOST_ROWS = 1000, 65534

#: Tables inside so many others are laid out as plain blocks (trees may be of any depth), and
#: columns are padded to so many characters at most: both bound the padding, no text is lost.
NESTED_TABLES, COLUMN_WIDTH = 32, 400


class Node:
    __slots__ = ("tag", "attrs", "children", "hidden", "visible", "space", "labels")

    def __init__(self, tag: str, attrs: dict[str, str], hidden: bool, visible: bool = True, space: str = "", labels: bool = True):
        self.tag, self.attrs = tag, attrs
        # Hidden with all inside, and whether text directly inside is visible.
        self.hidden, self.visible = hidden, visible
        # The vocabulary ("" is HTML), and whether text directly inside is shown (in SVG only that of labels is).
        self.space, self.labels = space, labels
        self.children: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        out.setdefault(m.group(1).lower(), html.unescape(value))
    return out


def _style(text: str) -> dict[str, str]:
    """Values of the properties ``display`` and ``visibility`` in a style attribute."""
    out: dict[str, tuple[bool, str]] = {}
    for part in DECLARATION.findall(COMMENT.sub(" ", text)) if "display" in text.lower() or "visibility" in text.lower() else ():
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if not colon or name not in ("display", "visibility"):
            continue
        important = bool(re.search(r"!\s*important$", value))
        value = re.sub(r"\s*!\s*important$", "", value)
        # What is not one word (or two, as in "inline flex") is no valid value and changes nothing.
        if re.fullmatch(r"[a-z-]+(?: [a-z-]+){0,2}", value) and (important or not out.get(name, (False, ""))[0]):
            out[name] = important, value
    return {k: v for k, (_, v) in out.items()}


def _visible(style: dict[str, str], parent: Node, attribute: str = "") -> bool:
    """Is an element visible, by its own declaration or else as its parent?"""
    own = style.get("visibility", attribute)
    if own in ("hidden", "collapse"):
        return False
    return own in ("visible", "initial") or parent.visible


def _hides(tag: str, attrs: dict[str, str], style: dict[str, str]) -> bool:
    if tag in HIDDEN or tag == "input" and attrs.get("type", "").strip().lower() == "hidden":
        return True
    # A display of its own takes the place of that of the attribute.
    shown = "none" if "hidden" in attrs or tag == "dialog" and "open" not in attrs else ""
    return style.get("display", shown) == "none"


def _space(stack: list[Node], tag: str, attrs: dict[str, str]) -> str:
    """The vocabulary of a start tag; one that belongs to HTML closes SVG and MathML first."""
    top = stack[-1]
    space = "" if top.tag in HTML_POINTS.get(top.space, ()) else top.space
    if space and (tag in BREAKOUT or tag == "font" and not attrs.keys().isdisjoint(("color", "face", "size"))):
        while stack[-1].space and stack[-1].tag not in HTML_POINTS[stack[-1].space]:
            stack.pop()
        space = ""
    return space or (tag if tag in ("svg", "math") else "")


def _foreign(parent: Node, tag: str, attrs: dict[str, str], space: str) -> Node:
    """An element of SVG or MathML."""
    style = _style(attrs.get("style", ""))
    hidden = tag in FOREIGN_HIDDEN[space] or style.get("display", attrs.get("display", "").strip().lower()) == "none"
    visible = _visible(style, parent, attrs.get("visibility", "").strip().lower())
    if parent.space == space and parent.tag in FIRST_SHOWN[space]:
        # A branch for one language may not be taken; then the next is.
        hidden = hidden or any(isinstance(c, Node) and "systemlanguage" not in c.attrs for c in parent.children)
    labels = space == "math" or tag in ("text", "foreignobject") or parent.space == "svg" and parent.labels
    return Node(tag, attrs, hidden, visible, space, labels)


def _self_closing(text: str) -> bool:
    """Does the attribute text of a tag end in a "/" that is not part of a value?"""
    if not text.endswith("/"):
        return False
    end = 0
    for m in ATTRIBUTE.finditer(text):
        end = m.end()
    return end < len(text)


def build_tree(page: str) -> Node:
    """The element tree of a page; text is unescaped, broken markup never fails."""
    root = Node("#root", {}, False)
    stack = [root]
    at = 0
    while True:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and stack[-1].labels:
            # What is not visible still keeps its neighbours apart.
            stack[-1].children.append(html.unescape(text) if stack[-1].visible else " ")
        if not m:
            return root
        at = m.end()
        if stack[-1].space and page.startswith("<![CDATA[", m.start()):
            end = page.find("]]>", m.start())
            at = len(page) if end < 0 else end + 3
            if stack[-1].labels and stack[-1].visible:
                stack[-1].children.append(page[m.start() + 9 : end if end >= 0 else len(page)])
            continue
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            _close(stack, tag)
            continue
        attrs = _attributes(m.group(3)) if m.group(3).strip(" /") else {}
        space = _space(stack, tag, attrs)
        if space:
            node = _foreign(stack[-1], tag, attrs, space)
            stack[-1].children.append(node)
            if not _self_closing(m.group(3)):
                stack.append(node)
            continue
        _imply(stack, tag)
        style = _style(attrs["style"]) if "style" in attrs else {}
        node = Node(tag, attrs, _hides(tag, attrs, style), _visible(style, stack[-1]))
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            place = end.start() if end else len(page)
            raw = page[at:place]
            if node.visible:
                node.children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            close = TAG.match(page, place)
            at = close.end() if close else len(page)
            continue
        stack.append(node)


def _pop_to(stack: list[Node], names: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> None:
    """Close the outermost open element of ``names`` above the nearest barrier."""
    found = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in barrier:
            break
        if stack[i].tag in names:
            found = i
    if found is not None:
        del stack[found:]


def _imply(stack: list[Node], tag: str) -> None:
    if tag in CLOSES_P:
        _pop_to(stack, {"p"}, SCOPE | {"button"})
    if tag in HEADINGS and stack[-1].tag in HEADINGS:
        stack.pop()
    if tag in IMPLIED:
        _pop_to(stack, *IMPLIED[tag])


def _close(stack: list[Node], tag: str) -> None:
    """An end tag closes its element and all inside; without one it is ignored."""
    barrier = SCOPE - {tag} if tag not in ("table", "html", "body") else frozenset()
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in barrier:
            return


def _option_text(option: Node) -> str:
    """The label of an option, or else its text."""
    if option.attrs.get("label", "").strip():
        return SPACES.sub(" ", option.attrs["label"]).strip()
    parts: list[str] = []
    todo: list[Node | str] = list(reversed(option.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            parts.append(child)
        elif not child.hidden:
            todo.extend(reversed(child.children))
    return SPACES.sub(" ", "".join(parts)).strip()


def _options(select: Node) -> tuple[list[str], bool]:
    """What a list shows, and whether it is open: all options and group labels, else the chosen option."""
    size = select.attrs.get("size", "").strip()
    multiple = "multiple" in select.attrs
    opened = multiple or size.isdecimal() and int(size[:9]) > 1
    lines: list[str] = []
    chosen = first = None
    todo: list[tuple[Node | str, bool]] = [(c, False) for c in reversed(select.children)]
    while todo:
        child, disabled = todo.pop()
        if isinstance(child, str) or opened and child.hidden:
            continue
        disabled = disabled or "disabled" in child.attrs
        if child.tag == "option":
            lines.append(_option_text(child))
            chosen = child if "selected" in child.attrs else chosen
            first = child if first is None and not disabled else first
        else:
            if child.tag == "optgroup" and opened:
                lines.append(SPACES.sub(" ", child.attrs.get("label", "")).strip())
            todo.extend((c, disabled and child.tag == "optgroup") for c in reversed(child.children))
    if opened:
        return lines, True
    shown = chosen or first
    return [_option_text(shown)] if shown else [], False


class Flow:
    """Lines of laid-out text: inline pieces are joined, blocks start new lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.prefix = self.mark = ""
        self.gap = False
        self.space = False

    def text(self, piece: str) -> None:
        words = SPACES.sub(" ", piece)
        if words == " " or not words:
            self.space = self.space or bool(words and self.line)
            return
        if (words[0] == " " or self.space) and self.line:
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words.strip(" "))

    def lines_of(self, piece: str) -> None:
        """Preformatted text keeps its lines and spaces."""
        first, *rest = piece.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.line.append(first)
        for part in rest:
            self.end(keep=True)
            if part:
                self.line.append(part)

    def end(self, keep: bool = False) -> None:
        """End the line if it has text (or always, with ``keep``)."""
        self.space = False
        if not self.line and not keep:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.prefix + self.mark + "".join(self.line)).rstrip())
        self.prefix += " " * len(self.mark)
        self.mark = ""
        self.line = []

    def blank(self) -> None:
        self.end()
        self.gap = True


def _shown_value(item: Node) -> str:
    """What an image or an input shows as text."""
    if item.tag == "img":
        return item.attrs.get("alt", "")
    kind = item.attrs.get("type", "").strip().lower()
    return item.attrs.get("alt", "") if kind == "image" else "" if kind in NO_VALUE else item.attrs.get("value", "")


def render(node: Node, nested: int = NESTED_TABLES, width: int = COLUMN_WIDTH) -> list[str]:
    """Laid-out lines of what is visible below a node; ``nested`` more levels of tables get columns."""
    flow = Flow()
    # Each entry is text, a node to enter, or what to do on leaving one; no recursion but for cells.
    todo: list = list(reversed(node.children))
    pre = 1 if node.tag == "pre" else 0
    lists: list[list] = []
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            flow.lines_of(item) if pre else flow.text(item)
            continue
        if isinstance(item, tuple):
            tag, prefix = item
            if tag in LISTS:
                lists.pop()
            flow.blank() if tag in SPACED and not lists else flow.end()
            # An item without text leaves no mark behind.
            flow.prefix, flow.mark = prefix, ""
            pre -= tag == "pre"
            continue
        tag = item.tag
        if item.hidden:
            continue
        if item.space:
            # Labels stand apart from one another, and cells and shifted parts of a label from what is before them.
            apart = tag in ("text", "foreignobject", "mtd", "mtr") or tag == "tspan" and not item.attrs.keys().isdisjoint(("x", "y", "dy"))
            if apart:
                flow.text(" ")
                todo.append(" ")
            todo.extend(reversed(item.children))
        elif tag == "select":
            shown, opened = _options(item) if item.visible else ([], False)
            for line in shown:
                flow.end() if opened else flow.text(" ")
                flow.text(line)
            flow.end() if opened else flow.text(" ")
        elif tag == "br":
            flow.end(keep=True)
        elif tag == "hr":
            flow.blank()
        elif tag in ("img", "input"):
            value = _shown_value(item) if item.visible else ""
            flow.text(" " + value + " ") if value.strip() else None
        elif tag == "table" and nested > 0:
            flow.blank()
            for line in _table(item, nested - 1, width):
                flow.line = [line] if line else []
                flow.end(keep=True)
            flow.blank()
        elif tag in BLOCK:
            flow.blank() if tag in SPACED and not lists else flow.end()
            todo.append((tag, flow.prefix))
            if tag in LISTS:
                start = item.attrs.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                ordered, number = lists[-1] if lists else (False, 0)
                flow.mark = f"{number}. " if ordered else "- "
                if lists:
                    lists[-1][1] += 1
            elif tag == "dd":
                flow.prefix += "  "
            elif tag == "blockquote":
                flow.prefix += "> "
            elif tag == "pre":
                pre += 1
            if tag == "details" and "open" not in item.attrs:
                todo.extend([c for c in item.children if isinstance(c, Node) and c.tag == "summary"][:1])
            else:
                todo.extend(reversed(item.children))
        else:
            todo.extend(reversed(item.children))
    flow.end()
    while flow.lines and not flow.lines[-1]:
        flow.lines.pop()
    while flow.lines and not flow.lines[0]:
        flow.lines.pop(0)
    return flow.lines


def _rows(table: Node) -> tuple[list[list[Node]], list[Node | str]]:
    """Rows of visible cells, and what stands in the table outside of cells."""
    rows: list[list[Node]] = []
    loose: list[Node | str] = []
    todo: list[Node | str] = list(reversed(table.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str) or child.tag not in ("thead", "tbody", "tfoot", "tr", "td", "th", "colgroup", "col"):
            if not isinstance(child, str) or child.strip():
                loose.append(child)
        elif child.hidden:
            continue
        elif child.tag in ("td", "th"):  # a cell without a row
            if not rows:
                rows.append([])
            rows[-1].append(child)
        elif child.tag == "tr":
            rows.append([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden])
            loose.extend(c for c in child.children if (c.strip() if isinstance(c, str) else c.tag not in ("td", "th")))
        else:
            todo.extend(reversed(child.children))
    return rows, loose


def _span(cell: Node, name: str, most: int) -> int:
    """Columns or rows of a cell, clamped as browsers do; 0 rows reach to the end."""
    found = re.match(r"\s*\+?(\d+)", cell.attrs.get(name, ""))
    if not found:
        return 1
    n = int(found[1][:9])
    return min(n, most) if n else most if name == "rowspan" else 1


def _places(rows: list[list[Node]]) -> list[list[int]]:
    """First column of every cell, in the grid left by cells of earlier rows that reach down."""
    places: list[list[int]] = []
    # Columns taken from above, as runs (first column, end, last row), in order.
    taken: list[tuple[int, int, int]] = []
    for r, row in enumerate(rows):
        taken = [t for t in taken if t[2] >= r]
        at, run, own, fresh = 0, 0, [], []
        for cell in row:
            while run < len(taken) and taken[run][0] <= at:
                at = max(at, taken[run][1])
                run += 1
            own.append(at)
            end = at + _span(cell, "colspan", MOST_COLUMNS)
            down = _span(cell, "rowspan", MOST_ROWS)
            if down > 1:
                fresh.append((at, end, r + down - 1))
            at = end
        places.append(own)
        taken = sorted(taken + fresh)
    return places


def _table(table: Node, nested: int, width: int) -> list[str]:
    """Lines of a table: what is outside of cells first (a caption), then padded rows."""
    rows, loose = _rows(table)
    holder = Node("div", {}, False)
    holder.children = loose
    lines = render(holder, nested, width) if loose else []
    laid = [[render(cell, nested, width) for cell in row] for row in rows]
    places = _places(rows)
    widths: dict[int, int] = {}
    for own, row in zip(places, laid):
        for i, (place, cell) in enumerate(zip(own, row)):
            if i + 1 < len(row):
                widths[place] = max(widths.get(place, 0), max(map(len, cell), default=0))
    # Where each column starts: behind those before it that have a width.
    starts, total = {}, 0
    for place in sorted(widths.keys() | {p for own in places for p in own}):
        starts[place] = total
        total += min(widths[place], width) + 3 if place in widths else 0
    for own, row in zip(places, laid):
        for k in range(max(map(len, row), default=0)):
            line = ""
            for place, cell in zip(own, row):
                line = line.ljust(starts[place] - 3) + " | " if place else line
                line += cell[k] if k < len(cell) else ""
            lines.append(line.rstrip())
    return lines


def visible_text(page: str | None, nested: int = NESTED_TABLES, width: int = COLUMN_WIDTH) -> str:
    """All text a browser would show, laid out; empty for NULL and empty pages."""
    return "\n".join(render(build_tree(page), nested, width)) if page else ""


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", nested: int = NESTED_TABLES,
    width: int = COLUMN_WIDTH,
) -> DataFrame:
    """``page_id, url, text, n_chars, n_lines`` of every row.

    Tables inside ``nested`` others are laid out as blocks, and a column is padded to ``width``
    characters at most (a longer cell shifts its own row); no text is lost by either.  NULL and
    empty pages give empty text; NULL ids and addresses pass through; repeated rows are read
    each; an empty table gives no rows; further columns are ignored.
    """
    arrow_session(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(p.as_py(), nested, width) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string"))
    got = rows.mapInArrow(extract, "page_id long, url string, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long")
    return got.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": lines})
