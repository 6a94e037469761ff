"""HTML extraction by layout-aware rendering.

A tree builder with implied tags turns the markup into elements; a renderer walks them, leaves
out what a reader cannot see, and writes the rest with its layout: a blank line around
paragraphs and headings, a line per block, marks and indents for lists, aligned cells of several
lines for tables, white space as it is in preformatted text.

What a reader sees follows tags, attributes, inline styles and those rules of the page's own style
sheets that name a tag, a class, an id or several of them at once; rules for some media only, and
selectors of other kinds, are passed over.

Definitions: a null page has null text, an empty page empty text. Markup that breaks off, closes
what is not open or nests without end is rendered as far as it says something; nothing is cut.
Every table is aligned, whatever its size: a row that has text after its widest column is as long
as that column is wide, so a table of many rows with one very wide cell is mostly blanks.
Pages are worked alone: repeated rows give equal texts, an empty table an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style template title noscript iframe noembed noframes object audio video canvas datalist map rp "
    "desc metadata defs annotation annotation-xml".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset".split())
BLOCK = SPACED | frozenset(
    "html body address article aside details dialog dd div dt fieldset figcaption footer form header hgroup "
    "legend li main menu nav section summary center optgroup option search caption".split()
)
CLOSES_P = (BLOCK | {"hr"}) - {"option", "optgroup", "caption", "html", "body", "legend"}
CELL = frozenset(("td", "th"))
SECTION = frozenset(("thead", "tbody", "tfoot"))
# An opening tag ends these open elements, searched up to the nearest of the limits.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    "td": (CELL, frozenset(("tr", "table"))),
    "th": (CELL, frozenset(("tr", "table"))),
    "thead": (SECTION | {"tr", "caption"}, frozenset(("table",))),
    "tbody": (SECTION | {"tr", "caption"}, frozenset(("table",))),
    "tfoot": (SECTION | {"tr", "caption"}, frozenset(("table",))),
    "rp": (frozenset(("rp", "rt")), frozenset(("ruby",))),
    "rt": (frozenset(("rp", "rt")), frozenset(("ruby",))),
}
WALLS = frozenset(("table", "td", "th", "caption", "template", "button", "object"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANKS = re.compile(r"[ \t\n\r\f]+")
SHOWING = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
REMARK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SHEET = re.compile(r"[^{}]*\{|\}|[^{}]+")
SIMPLE = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)", re.I)
BATCH_CHARS = 64_000_000  # text of the pages that are handed on together


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    if not text or text.isspace() or text == "/":
        return {}
    found: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(text):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


class Tree:
    """Builds elements from tags, adding the ends and beginnings that markup may leave out."""

    def __init__(self) -> None:
        self.root = Element("html", {})
        self.open = [self.root]
        self.held: Counter[str] = Counter()  # open elements by tag

    def cut(self, at: int) -> None:
        self.held.subtract(e.tag for e in self.open[at:])
        del self.open[at:]

    def text(self, text: str) -> None:
        if text:
            self.open[-1].children.append(text)

    def close_to(self, ending: frozenset, limits: frozenset) -> None:
        """Close the open elements from the outermost of ``ending`` within the limits on."""
        if not any(self.held[tag] for tag in ending):
            return
        cut = 0
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in limits:
                break
            if tag in ending:
                cut = i
        if cut:
            self.cut(cut)

    def begin(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html" or tag == "body":
            if tag == "body":
                self.close_to(frozenset(("head",)), frozenset())
            if tag == "body" and attrs:
                self.push(tag, attrs)
            return
        if len(self.open) > 1 and self.open[1].tag == "head" and tag not in HEAD_ONLY:
            self.cut(1)
        if tag in CLOSES_P:
            self.close_to(P, WALLS)
        rule = ENDS.get(tag)
        if rule:
            self.close_to(*rule)
        if tag in CELL and self.open[-1].tag not in ("tr",) and any(e.tag == "table" for e in self.open[-2:]):
            self.push("tr", {})
        self.push(tag, attrs)

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Element(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.held[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.push("br", {})
            return
        if tag in ("html", "body"):
            return
        walls = WALLS if tag not in ("table", "tr", "thead", "tbody", "tfoot", "td", "th") else frozenset(("table",))
        for i in range(len(self.open) - 1, 0, -1) if self.held[tag] else ():
            if self.open[i].tag == tag:
                self.cut(i)
                return
            if self.open[i].tag in walls:
                break
        if tag == "p":  # the end of a paragraph that is not open is an empty one
            self.open[-1].children.append(Element("p", {}))


P = frozenset(("p",))
HEAD_ONLY = frozenset("base basefont link meta noframes noscript script style template title".split())


def parse(markup: str) -> Element:
    tree, at, n = Tree(), 0, len(markup)
    while at < n:
        m = TOKEN.search(markup, at)
        if m is None:
            tree.text(unescape(markup[at:]))
            break
        if m.start() > at:
            tree.text(unescape(markup[at : m.start()]))
        at = max(m.end(), m.start() + 1)
        if m["cdata"] is not None:
            tree.text(m["cdata"])
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            tree.end(tag)
            continue
        tree.begin(tag, attributes(m["attrs"]))
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(markup, at)
            body = markup[at : stop.start()] if stop else markup[at:]
            tree.text(unescape(body) if tag in ("textarea", "title") else body)
            tree.end(tag)
            at = stop.end() if stop else n
    return tree.root


class Sheets:
    """What the page's own style sheets say on display and visibility."""

    def __init__(self, root: Element) -> None:
        # By tag, class or id that must be there: (weight, place, tag, names, property, value).
        self.rules: dict[str, list[tuple]] = {}
        todo, place = [root], 0
        while todo:
            node = todo.pop()
            for c in reversed(node.children):
                if not isinstance(c, str):
                    todo.append(c)
            if node.tag == "style":
                text = "".join(c for c in node.children if isinstance(c, str))
                for selectors, said in self.blocks(REMARK.sub(" ", text)):
                    for name, value in SHOWING.findall(said):
                        for one in selectors.split(","):
                            place += 1
                            self.add(one.strip(), place, name.lower(), value.lower())

    @staticmethod
    def blocks(text: str) -> Iterator[tuple[str, str]]:
        """Selectors and declarations of the rules outside of at-rules."""
        around: list[str] = []
        for part in SHEET.findall(text):
            if part[-1] == "{":
                around.append(part[:-1].rpartition(";")[2].strip())
            elif part == "}":
                del around[-1:]
            elif len(around) == 1 and not around[0].startswith("@"):
                yield around[0], part

    def add(self, selector: str, place: int, name: str, value: str) -> None:
        m = SIMPLE.fullmatch(selector)
        if not selector or not m:
            return
        tag = "" if m[1] in (None, "*") else m[1].lower()
        names = re.findall(r"[.#][\w-]+", m[2])
        weight = (sum(n[0] == "#" for n in names), sum(n[0] == "." for n in names), bool(tag))
        self.rules.setdefault(names[0] if names else tag, []).append((weight, place, tag, set(names), name, value))

    def of(self, node: Element) -> dict[str, str]:
        """The winning values for an element; its own style attribute comes last."""
        found: list[tuple] = []
        if self.rules:
            named = {f".{c}" for c in node.attrs.get("class", "").split()}
            if "id" in node.attrs:
                named.add(f"#{node.attrs['id']}")
            for key in (node.tag, "", *named):
                found += [r for r in self.rules.get(key, ()) if r[2] in ("", node.tag) and r[3] <= named]
            found.sort(key=lambda r: r[:2])
        won = {name: value for *_, name, value in found}
        if "style" in node.attrs:
            won.update((n.lower(), v.lower()) for n, v in SHOWING.findall(node.attrs["style"]))
        return won


def laid_out(node: Element, styles: dict[str, str]) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or styles.get("display") == "none":
        return False
    if not a and node.tag != "dialog":
        return True
    if "hidden" in a and a["hidden"].lower() != "until-found":
        return "display" in styles
    return node.tag != "dialog" or "open" in a


class Page:
    """Lines written so far, with the blank lines and indents that are due."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.mark = ""

    def write(self, text: str) -> None:
        """Running text: white space is one blank, none at the beginning of a line."""
        words = BLANKS.sub(" ", text)
        if not words or words == " ":
            self.space = self.space or bool(words and self.now)
            return
        if (words[0] == " " or self.space) and self.now:
            self.now.append(" ")
        self.start()
        self.now.append(words.strip(" "))
        self.space = words[-1] == " "

    def keep(self, text: str) -> None:
        """Preformatted text."""
        parts = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for i, part in enumerate(parts):
            if i:
                self.line(forced=True)
            if part:
                self.start()
                self.now.append(part)

    def start(self) -> None:
        if not self.now:
            if self.lines and self.gap:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.now.append("".join(self.indent) + self.mark)
            if self.mark:
                self.mark = ""

    def line(self, forced: bool = False) -> None:
        """End the line; an empty one counts only when forced."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
            self.gap = 1
        elif forced and self.lines:
            self.gap += 1
        self.space = False

    def block(self, blank: bool) -> None:
        self.line()
        if blank and self.lines:
            self.gap = max(self.gap, 2)

    def text(self) -> str:
        self.line()
        return "\n".join(self.lines)


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """By row: (column, columns, lines) of each cell; cells from above take their columns."""
        taken: dict[int, int] = {}  # by column: first row that is free again
        out = []
        for r, row in enumerate(self.rows):
            at, cells = 0, []
            for lines, wide, high in row:
                while taken.get(at, 0) > r:
                    at += 1
                cells.append((at, wide, lines))
                if high > 1:
                    taken.update(dict.fromkeys(range(at, at + wide), r + high))
                at += wide
            out.append(cells)
        return out

    def lines(self) -> Iterator[str]:
        """Rows as lines, their cells padded to the width of their columns; no blanks at the end."""
        rows = self.placed()
        width: dict[int, int] = {}
        for row in rows:
            for at, wide, lines in row:
                if wide == 1:
                    width[at] = max(width.get(at, 0), max(map(len, lines), default=0))
        for row in rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line, column = [], 0
                # Below its first line a row ends with its last text.
                shown = [i for i, cell in enumerate(row) if len(cell[2]) > k and cell[2][k]] if k else range(len(row))
                for at, wide, lines in row[: shown[-1] + 1] if shown else ():
                    line += [" " * width.get(c, 0) for c in range(column, at)]  # cells from above
                    room = sum(width.get(at + i, 0) for i in range(wide)) + 3 * (wide - 1)
                    line.append((lines[k] if k < len(lines) else "").ljust(room))
                    column = at + wide
                yield " | ".join(line).rstrip(" |") if k else " | ".join(line).rstrip()


def number(text: str | None, other: int) -> int:
    try:
        return int(text.strip()[:9]) if text else other
    except ValueError:
        return other


def render(root: Element) -> str:
    """All visible text of a tree, with its layout."""
    pages, tables, lists = [Page()], [], []
    kept, sheets = 0, Sheets(root)
    todo: list[tuple] = [(root, False, None, False)]
    while todo:
        node, leaving, was, unseen = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if not unseen:
                page.keep(node) if kept else page.write(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("ul", "ol", "menu"):
                lists.pop()
                page.block(not lists)
            elif tag in ("li", "dd", "blockquote"):
                page.line()
                if page.indent:
                    page.indent.pop()
                page.mark = ""
                page.block(tag == "blockquote")
            elif tag in ("pre", "textarea"):
                kept -= 1
                page.block(tag == "pre")
            elif tag == "table":
                page.line()
                for each in tables.pop().lines():
                    if each:
                        page.start()
                        page.now.append(each)
                    page.line()
                page.block(True)
            elif tag in CELL and tables:
                lines = pages.pop().text().rstrip().split("\n")
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                tables[-1].rows[-1].append((lines, *was))
            elif tag in CELL:
                page.write(" ")
            elif tag == "q" and not unseen:
                page.write('"')
            elif tag in BLOCK:
                page.block(tag in SPACED)
            continue
        styles = sheets.of(node)
        if not laid_out(node, styles):
            continue
        if "visibility" in styles:
            unseen = styles["visibility"] in ("hidden", "collapse")
        if tag == "br":
            page.line(forced=True)
            continue
        if tag == "hr":
            page.block(False)
            continue
        if tag == "input":
            if node.attrs.get("type", "text").lower() not in ("hidden", "password", "checkbox", "radio", "file", "image") and not unseen:
                page.write(" " + node.attrs.get("value", "") + " ")
            continue
        state = None
        if tag in ("ul", "ol", "menu"):
            page.block(not lists)
            lists.append([tag, number(node.attrs.get("start"), 1)])
        elif tag == "li":
            page.line()
            own = lists[-1] if lists else ["ul", 1]
            page.mark = ""
            if own[0] == "ol":
                own[1] = number(node.attrs.get("value"), own[1])
                page.mark = f"{own[1]}. "
                own[1] += 1
            else:
                page.mark = "- "
            room = " " * len(page.mark)
            if unseen:
                page.mark = ""
            else:
                page.start()
            page.indent.append(room)
        elif tag in ("dd", "blockquote"):
            page.block(tag == "blockquote")
            page.indent.append("    " if tag == "dd" else "> ")
        elif tag in ("pre", "textarea"):
            page.block(tag == "pre")
            kept += 1
        elif tag == "table":
            page.block(True)
            tables.append(Table())
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in CELL and tables:
            high = number(node.attrs.get("rowspan"), 1)
            state = (min(max(number(node.attrs.get("colspan"), 1), 1), 1000), high if high > 0 else 65534)
            pages.append(Page())
        elif tag in CELL:
            page.write(" ")
        elif tag == "q" and not unseen:
            page.write('"')
        elif tag in BLOCK:
            page.block(tag in SPACED)
        todo.append((node, True, state, unseen))
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
        elif tag == "table":
            # Text between rows stands before the table.
            children = [c for c in children if not isinstance(c, str)]
            stray = [c for c in node.children if isinstance(c, str) and not c.isspace()]
            if stray and not unseen:
                page.write(" ".join(stray))
                page.block(True)
        elif tag in ("pre", "textarea") and children and isinstance(children[0], str):
            children = [re.sub(r"\A\r?\n", "", children[0]), *children[1:]]
        elif tag in ("tr", "thead", "tbody", "tfoot", "colgroup"):
            children = [c for c in children if not isinstance(c, str) or not c.isspace()]
        todo.extend((c, False, None, unseen) for c in reversed(children))
    return pages[0].text()


def rendered(markup: str | None) -> str | None:
    return None if markup is None else render(parse(markup))


def extract(
    pages: DataFrame, key: str = "page_id", column: str = "html", batch_chars: int = BATCH_CHARS
) -> DataFrame:
    """``key, text`` of every page. Pages are independent; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, size, first = [], 0, 0
            for i, x in enumerate(b.column(1)):
                text.append(rendered(x.as_py()))
                size += len(text[-1] or "")
                if size >= batch_chars or i + 1 == b.num_rows:
                    ids = b.column(0).slice(first, len(text))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(text, pa.string())], names=[key, "text"])
                    text, size, first = [], 0, i + 1

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(column).cast("string")).mapInArrow(run, f"{key} {kind}, text string")


def op7_html_rendering(pages: DataFrame) -> DataFrame:
    return extract(pages)
