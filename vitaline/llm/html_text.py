"""HTML to visible text: a tree builder with implied tags, and a renderer that keeps the layout.

The builder reads tags in one pass and repairs as browsers do: html, head and body, rows and table bodies
are implied, paragraphs, list items, cells, rows and options end where the next one starts, an end tag closes
what is open inside it and is ignored where nothing matches, and text between table rows moves in front of
the table. An unfinished tag at the end of a page is dropped.

The renderer leaves out what is not shown: scripts, styles, templates, heads, closed dialogs and details, what
has `display:none`, and text whose nearest element with a `visibility` is not visible. Both come from style
attributes and from a page's rules, weighed as usual by `!important`, specificity and order. Selectors may
join tags, classes and ids, by descendance or as children; rules with any other selector are left aside.
Rules within `@media` count if they are for screens WIDTH pixels wide, those within `@supports` and `@layer`
always, those within other blocks never. Of drawings (`svg`) the `text` elements are shown, of formulas all
but annotations.

Blanks collapse except in preformatted text; blocks start on lines of their own, paragraphs, headings, lists,
tables and quotes are set off by an empty line; list items have their marker and indent; a table's cells are
aligned in columns two blanks apart, with spans. A cell wider than `align` characters does not widen its column
(ALIGN as a rule; None aligns all cells).

Null pages give null, empty pages an empty text. Depth and size of a page are not limited: neither part is
recursive. Pages are handled one by one: repeated rows and extra columns make no difference, an empty table
gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from vitaline.llm.common import map_rows

ALIGN = 60
WIDTH = 1280  # of the screen that media rules are taken for, in pixels
_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(>?)|<[!?/][^>]*+>?", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_NO_STYLE = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->|\"[^\"\n]*+\"|'[^'\n]*+'", re.S)  # comments and strings
_AT = re.compile(r"@([\w-]++)\s*+(.*)", re.S)
_MEDIUM = re.compile(r"(?:only\s+)?(?:all|screen)?((?:(?:\s*\band\s*)?\(\s*(?:min|max)-width\s*:\s*[\d.]+(?:px|r?em)\s*\))*)")
_WIDTH = re.compile(r"(min|max)-width\s*:\s*(\d+(?:\.\d+)?)(px|r?em)")
_COMPOUND = re.compile(r"(?:[a-z][\w-]*|\*)?(?:[.#][\w-]+)*")
_SIMPLE = re.compile(r"[.#]?[\w-]+")
_BLANKS = " \t\n\r\f"

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes plaintext".split())
RAW_WITH_ENTITIES = set("textarea title".split())
UNSEEN = set("script style template head title iframe noembed noframes datalist audio video canvas object annotation annotation-xml".split())
UNSEEN_IN_DRAWINGS = set("defs desc metadata symbol".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
APART = HEADINGS | set("p ul ol dl menu table blockquote pre figure hr".split())  # set off by an empty line
BLOCKS = APART | set(
    "address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header "
    "hgroup html legend li listing main nav optgroup option search section summary tr".split()
)
ENDS_PARAGRAPH = BLOCKS - set("body caption html optgroup option tr legend".split())
IN_HEAD = set("title style script link meta base template noscript".split())
LISTS = set("ul ol menu dir".split())
SECTIONS = set("thead tbody tfoot".split())
CELLS = {"td", "th"}
IN_TABLE = SECTIONS | {"table", "tr"}  # hold no text themselves
#: start tag -> (tags it ends, tags beyond which it does not look)
ENDS = {
    "li": ({"li"}, LISTS | CELLS | {"table"}),
    "dd": ({"dd", "dt"}, {"dl", "table"} | CELLS),
    "dt": ({"dd", "dt"}, {"dl", "table"} | CELLS),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    **{s: (SECTIONS | {"caption", "colgroup"}, {"table"}) for s in SECTIONS},
}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


class Builder:
    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.counts: dict[str, int] = {}  # open elements by tag, so that most searches end at once
        self.styles: list[str] = []

    def push(self, node: Node) -> None:
        top = self.open[-1]
        if top.tag in IN_TABLE and node.tag not in IN_TABLE | CELLS | UNSEEN | {"caption", "colgroup", "col", "form", "input"}:
            self._before_table(node)
        else:
            top.children.append(node)
        if node.tag not in VOID:
            self.open.append(node)
            self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def _before_table(self, child: Node | str) -> None:
        at = max(i for i, n in enumerate(self.open) if n.tag == "table")
        siblings = self.open[at - 1].children
        place = len(siblings) - 1
        while siblings[place] is not self.open[at]:
            place -= 1
        siblings.insert(place, child)

    def pop_to(self, size: int) -> None:
        for node in self.open[size:]:
            self.counts[node.tag] -= 1
        del self.open[size:]

    def find(self, tags: set[str], stop: set[str]) -> int:
        """Place of the innermost open element of `tags` with none of `stop` inside; 0 if there is none."""
        if not any(self.counts.get(t) for t in tags):
            return 0
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                return i
            if tag in stop:
                return 0
        return 0

    def text(self, text: str) -> None:
        top = self.open[-1]
        if top.tag in IN_TABLE and len(self.open) > 1 and self.counts.get("table"):
            if text.strip(_BLANKS):
                self._before_table(text)
            return
        if top.tag == "head" and text.strip(_BLANKS):
            self.pop_to(len(self.open) - 1)
            top = self.open[-1]
        top.children.append(text)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if tag == "body" and (i := self.find({"head"}, set())):
                self.pop_to(i)
            self.open[-1].attrs |= {k: v for k, v in attrs.items() if k not in self.open[-1].attrs} if len(self.open) == 1 else {}
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.pop_to(len(self.open) - 1)
        if tag in ENDS_PARAGRAPH and (i := self.find({"p"}, CELLS | {"caption", "button", "table"})):
            self.pop_to(i)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop_to(len(self.open) - 1)
        if tag in ENDS and (i := self.find(*ENDS[tag])):
            self.pop_to(i)
        if tag in SECTIONS | CELLS | {"tr", "caption"}:
            table = self.find({"table"}, set())
            if not table:
                return  # stray table parts leave their content in place
            if tag in SECTIONS | {"caption"} or (tag == "tr" and not self.find(SECTIONS, {"table"})):
                self.pop_to(table + 1)
                if tag == "tr":
                    self.push(Node("tbody"))
            elif tag == "tr":
                self.pop_to(self.find(SECTIONS, {"table"}) + 1)
            elif not self.find({"tr"}, {"table"}):
                if not self.find(SECTIONS, {"table"}):
                    self.pop_to(table + 1)
                    self.push(Node("tbody"))
                self.push(Node("tr"))
            else:
                self.pop_to(self.find({"tr"}, {"table"}) + 1)
        self.push(Node(tag, attrs))

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            return self.push(Node("br"))
        if tag == "p" and not self.find({"p"}, CELLS | {"caption", "button", "table"}):
            return self.push(Node("p")) or self.pop_to(len(self.open) - 1)
        wanted = HEADINGS if tag in HEADINGS else {tag}
        stop = {"table"} if tag in IN_TABLE | CELLS | {"caption"} else CELLS | {"table", "caption"}
        if i := self.find(wanted, stop - wanted):
            self.pop_to(i)


def parse(page: str) -> Builder:
    tree, at, size = Builder(), 0, len(page)
    lower = None
    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            tree.text(_unescape(page[at:]))
            break
        if found.start() > at:
            tree.text(_unescape(page[at : found.start()]))
        at = found.end()
        closing, name, attrs, finished = found.groups()
        if not name:
            continue
        if not finished:
            break
        tag = name.lower()
        if closing:
            tree.end(tag)
            continue
        tree.start(tag, _attributes(attrs) if attrs and not attrs.isspace() else {})
        if attrs.endswith("/") and (tree.counts.get("svg") or tree.counts.get("math")) and tree.open[-1].tag == tag:
            tree.pop_to(len(tree.open) - 1)  # in drawings and formulas a slash does end an element
            continue
        if tag in RAW or tag in RAW_WITH_ENTITIES:
            lower = page.lower() if lower is None else lower
            if len(lower) != size:  # a few capitals have longer lower-case forms
                lower = page.translate({c: c + 32 for c in range(65, 91)})
            until = lower.find(f"</{tag}", at)
            until = size if until < 0 else until
            raw = page[at:until]
            if tag == "style":
                tree.styles.append(raw)
            tree.open[-1].children.append(_unescape(raw) if tag in RAW_WITH_ENTITIES else raw)
            at = until
    return tree


def _unescape(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def _on_screen(query: str) -> bool:
    query = query.strip().lower()
    if query.startswith("not "):
        return query[4:].strip() in ("print", "speech")
    found = _MEDIUM.fullmatch(query)
    if not found:
        return False
    for side, size, unit in _WIDTH.findall(found[1]):
        pixels = float(size) * (1 if unit == "px" else 16)
        if WIDTH < pixels if side == "min" else WIDTH > pixels:
            return False
    return True


def _applies(prelude: str) -> bool:
    """Whether the rules within an at-rule count."""
    found = _AT.match(prelude)
    name = found[1].lower() if found else ""
    return name in ("supports", "layer") or name == "media" and any(map(_on_screen, found[2].split(",")))


def _declared(declarations: list[str]) -> dict[str, tuple[bool, str]]:
    """Property -> (important, value), of the two that hide."""
    found: dict[str, tuple[bool, str]] = {}
    for declaration in declarations:
        name, _, value = declaration.partition(":")
        name, (value, _, important) = name.strip().lower(), value.strip().lower().partition("!")
        if name in ("display", "visibility") and value and not (found.get(name, (False,))[0] and not important):
            found[name] = (important.strip() == "important", value.strip())
    return found


def _style_rules(style: str) -> Iterator[tuple[str, list[str]]]:
    """(selectors, declarations) of the rules that count. What is open at the end is closed there."""
    style = _NO_STYLE.sub("", style)
    blocks: list[tuple[bool, str, list[str]]] = []  # of the open ones: does it count, selectors, declarations
    at = 0
    while at <= len(style):
        found = re.compile(r"[{};]").search(style, at)
        piece = style[at : found.start() if found else None].strip()
        at = found.end() if found else len(style) + 1
        mark = found[0] if found else "}" * len(blocks)
        if mark == "{":
            counts = not blocks or blocks[-1][0] and not blocks[-1][1]
            plain = not piece.startswith("@")
            blocks.append((counts and (plain or _applies(piece)), piece if plain else "", []))
            continue
        if blocks and piece:
            blocks[-1][2].append(piece)
        if mark != ";":
            for _ in mark[: len(blocks)]:
                counts, selectors, declarations = blocks.pop()
                if counts and selectors:
                    yield selectors, declarations


def _chains(selector: str) -> list[list[frozenset[str]]] | None:
    """Left to right, groups of elements that are children of one another; None if it is of another kind."""
    chains: list[list[frozenset[str]]] = [[]]
    child = True
    for part in selector.lower().replace(">", " > ").split():
        if part == ">":
            if child:
                return None
            child = True
            continue
        if not _COMPOUND.fullmatch(part):
            return None
        names = frozenset(_SIMPLE.findall(part))
        if child:
            chains[-1].append(names)
        else:
            chains.append([names])
        child = False
    return None if child else chains


class Rules:
    """What a page's styles say about display and visibility, found by a name that the element must have."""

    def __init__(self, styles: list[str]) -> None:
        self.by_name: dict[str, list[tuple]] = {}
        order = 0
        for style in styles:
            for selectors, declarations in _style_rules(style):
                said = _declared(declarations)
                for chains in map(_chains, selectors.split(",") if said else ()):
                    if chains is None:
                        continue
                    names = [n for chain in chains for part in chain for n in part]
                    kinds = [sum(n[0] == k for n in names) for k in "#."]
                    weight = (0, *kinds, len(names) - sum(kinds), order)
                    key = min(chains[-1][-1], default="*")  # '#' and '.' come before letters
                    self.by_name.setdefault(key, []).append((chains, weight, said))
                    order += 1

    def of(self, path: list[frozenset[str]]) -> Iterator[tuple[tuple, dict[str, tuple[bool, str]]]]:
        """(weight, declarations) of the rules that the innermost element of `path` meets."""
        for name in (*path[-1], "*"):
            for chains, weight, said in self.by_name.get(name, ()):
                if _meets(chains, path):
                    yield weight, said


def _meets(chains: list[list[frozenset[str]]], path: list[frozenset[str]]) -> bool:
    """The nearest place for each group is the best one, as it leaves most elements to the groups before."""
    end = len(path)
    for chain in reversed(chains):
        last = chain is chains[-1]
        while end >= len(chain) and not all(c <= p for c, p in zip(chain, path[end - len(chain) : end], strict=True)):
            if last:
                return False
            end -= 1
        if end < len(chain):
            return False
        end -= len(chain)
    return True


def _names(node: Node) -> frozenset[str]:
    names = [f".{c}" for c in node.attrs.get("class", "").lower().split()]
    names += [f"#{node.attrs['id'].lower()}"] if node.attrs.get("id") else []
    return frozenset([node.tag, *names, *(["body"] if node.tag == "html" else [])])  # one node stands for both


def looks(node: Node, rules: Rules, path: list[frozenset[str]]) -> tuple[bool, bool | None]:
    """Is the element not displayed at all, and is its text visible (None: as around it)?"""
    if node.tag in UNSEEN:
        return True, None
    attrs = node.attrs
    default = "none" if "hidden" in attrs or node.tag == "dialog" and "open" not in attrs else ""
    said = list(rules.of(path)) if rules.by_name else []
    if "style" in attrs:
        said.append(((1,), _declared(_NO_STYLE.sub("", attrs["style"]).split(";"))))
    best = {"display": ((), default), "visibility": ((), "")}
    for weight, declared in said:
        for name, (important, value) in declared.items():
            best[name] = max(best[name], ((important, *weight), value))
    visibility = best["visibility"][1]
    return best["display"][1] == "none", visibility == "visible" if visibility in ("visible", "hidden", "collapse") else None


class Writer:
    """Lines of text: pending line ends, one pending blank, an indent and a marker for the next line."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks = 0  # line ends to write before the next text
        self.space = False
        self.fresh = True  # nothing on this line yet
        self.indent = ""
        self.marker = ""

    def block(self, breaks: int) -> None:
        self.space = False
        if self.parts:
            self.breaks = max(self.breaks, breaks)

    def line_end(self) -> None:
        self.space = False
        self.breaks = max(self.breaks, 0) + 1 if self.parts or self.marker else 0

    def _begin(self) -> None:
        if self.breaks:
            self.parts.append("\n" * self.breaks)
            self.breaks, self.fresh = 0, True
        if self.fresh:
            if self.marker:
                self.parts.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker)
                self.marker = ""
            else:
                self.parts.append(self.indent)
            self.fresh = False

    def text(self, text: str) -> None:
        words = text.split()  # no-break blanks included: they separate words here
        if not words:
            self.space = self.space or bool(text)
            return
        if (self.space or text[0].isspace()) and not (self.fresh or self.breaks):
            self.parts.append(" ")
        self._begin()
        self.parts.append(" ".join(words))
        self.space = text[-1].isspace()

    def lines(self, text: str) -> None:
        """Preformatted lines."""
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.line_end()
            if line:
                self._begin()
                self.parts.append(line)

    def result(self) -> str:
        return "".join(self.parts)


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def layout(rows: list[list[tuple[str, int, int]]], align: int | None = ALIGN) -> list[str]:
    """Aligned lines of a table; a cell is (text, columns, rows)."""
    grid: list[dict[int, list[str]]] = []
    down: dict[int, int] = {}  # column -> rows it is still taken for
    widths: dict[int, int] = {}
    for row in rows:
        line: dict[int, list[str]] = {}
        taken = {c for c, n in down.items() if n}
        down = {c: n - 1 for c, n in down.items() if n > 1}
        column = 0
        for text, across, along in row:
            while column in taken:
                column += 1
            cell = line[column] = text.split("\n")
            width = max(map(len, cell))
            if across == 1 and (align is None or width <= align):
                widths[column] = max(widths.get(column, 0), width)
            if along > 1:
                down |= dict.fromkeys(range(column, column + across), along - 1)
            column += across
        grid.append(line)
    starts, at = {}, 0
    for column in sorted({c for line in grid for c in line} | set(widths)):
        starts[column] = at
        if column in widths:
            at += widths[column] + 2 * bool(widths[column])
    out = []
    for line in grid:
        for i in range(max(map(len, line.values()), default=0)):
            text = ""
            for column, cell in line.items():
                if i < len(cell) and cell[i]:
                    text = (text.ljust(starts[column]) if len(text) + 1 < starts[column] or not text else text + "  ") + cell[i]
            if text.strip():
                out.append(text.rstrip())
    return out


def render(tree: Builder, align: int | None = ALIGN) -> str:
    rules = Rules(tree.styles)
    path: list[frozenset[str]] = []  # names of the open elements, where there are rules to meet
    shown = [True]  # of the open elements: is their text visible,
    drawing = [""]  # and are they in a drawing, or in a text of it
    writers = [Writer()]
    tables: list[dict] = []  # of the open tables: rows, and the row that is open
    lists: list[list] = []  # of the open lists: next number, or None for a bullet
    pre = 0
    todo: list[tuple[Node | str, bool]] = [(tree.root, True)]
    while todo:
        node, entering = todo.pop()
        out = writers[-1]
        if isinstance(node, str):
            if not shown[-1] or drawing[-1] == "svg":
                continue
            if pre:
                out.lines(node)
            else:
                out.text(node)
            continue
        tag = node.tag
        gap = 2 if tag in APART else 1
        if entering:
            if rules.by_name:
                path.append(_names(node))
            gone, visible = looks(node, rules, path)
            if gone or tag == "br" or drawing[-1] and tag in UNSEEN_IN_DRAWINGS:
                if rules.by_name:
                    path.pop()
                if tag == "br" and not gone and shown[-1]:
                    out.line_end()
                continue
            shown.append(shown[-1] if visible is None else visible)
            inner = {"svg": "svg", "foreignobject": "", "text": drawing[-1] and "text"}
            drawing.append(inner.get(tag, drawing[-1]))
            if tag == "text" and drawing[-1]:
                out.block(1)
            if tag == "details" and "open" not in node.attrs:
                node.children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"]
            if tag in LISTS:
                out.block(1 if lists else 2)
                start = node.attrs.get("start", "1")
                lists.append([int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1] if tag == "ol" else [None])
            elif tag == "table":
                out.block(2)
                tables.append({"rows": [], "row": None})
            elif tag in CELLS or tag == "caption" and tables:
                writers.append(Writer())
            elif tag == "tr" and tables:
                tables[-1]["row"] = []
            elif tag in BLOCKS:
                out.block(gap)
            if tag == "li":
                number = lists[-1][0] if lists else None
                if number is not None:
                    lists[-1][0] = number + 1
                mark = ("- " if number is None else f"{number}. ") if shown[-1] else ""
                out.marker = (out.marker if out.marker else "") + mark if out.marker else mark
                out.indent += " " * len(mark)
                node.attrs = {"mark": mark}
            elif tag in ("dd", "blockquote"):
                out.indent += "  "
            pre += tag in ("pre", "listing", "textarea")
            todo.append((node, False))
            children = node.children
            if tag in ("pre", "listing", "textarea") and children and isinstance(children[0], str) and children[0][:1] == "\n":
                children = [children[0][1:], *children[1:]]
            todo += [(child, True) for child in reversed(children)]
            continue
        shown.pop()
        if rules.by_name:
            path.pop()
        if drawing.pop() and tag == "text":
            out.block(1)
        pre -= tag in ("pre", "listing", "textarea")
        if tag == "li":
            out.indent = out.indent[: len(out.indent) - len(node.attrs["mark"])]
            out.marker = ""
        elif tag in ("dd", "blockquote"):
            out.indent = out.indent[:-2]
        if tag in LISTS:
            lists.pop()
            out.block(1 if lists else 2)
        elif tag in CELLS or tag == "caption" and tables:
            text = writers.pop().result()
            if tag == "caption":
                tables[-1]["caption"] = text
            elif tables and tables[-1]["row"] is not None:
                tables[-1]["row"].append((text, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag == "tr" and tables:
            tables[-1]["rows"].append(tables[-1]["row"])
            tables[-1]["row"] = None
        elif tag == "table":
            table = tables.pop()
            if table.get("caption"):
                out.lines(table["caption"])
                out.line_end()
            rows = layout(table["rows"], align)
            if rows:
                out.lines("\n".join(rows))
            out.block(2)
        elif tag in BLOCKS:
            out.block(gap)
    return writers[0].result()


def visible_text(page: str | None, align: int | None = ALIGN) -> str | None:
    return None if page is None else render(parse(page.replace("\0", "�")), align)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", align: int | None = ALIGN) -> DataFrame:
    """page_id, text: the visible text of every page."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {id_col: b[id_col], "text": [visible_text(page, align) for page in b[html_col]]}

    return map_rows(pages, [id_col, html_col], run, f"{id_col} {kind}, text string")
