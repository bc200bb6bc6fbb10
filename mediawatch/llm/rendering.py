"""Visible text of web pages, laid out: a tree with implied tags, visibility rules, blocks, lists and tables."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediawatch.llm.common import hidden

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset(
    "head script style title template iframe noembed noframes audio video canvas object svg math datalist link meta".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset form menu".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside header footer nav main address li dt dd tr thead tbody tfoot caption legend "
    "details summary figcaption center option optgroup hgroup search dialog".split()
)
#: An opening tag ends an open element of the second set, unless one of the third is nearer.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{t: ({"thead", "tbody", "tfoot", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
    **{t: ({"h1", "h2", "h3", "h4", "h5", "h6"}, BLOCKS) for t in ("h1", "h2", "h3", "h4", "h5", "h6")},
}
#: A closing tag does not reach beyond these.
FENCES = frozenset("table td th caption".split())
TABLE = FENCES | frozenset("tr thead tbody tfoot".split())
#: Elements whose lines are laid out by themselves; cells only inside a table.
APART = frozenset("li dd blockquote table".split())
CELLS = frozenset("td th caption".split())
#: A column is padded up to this width.
WIDEST = 100

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?"
    r"""|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|<(?P<loose>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>?"
    r"|(?P<text><?[^<]*)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
IGNORED = re.compile(r"""/\*.*?(?:\*/|\Z)|<!--|-->|("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""", re.S)
DECLARATION = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+(?:\s+[a-z-]+)*)\s*(!\s*important)?\s*\Z", re.I)
DISPLAYS = frozenset(
    "block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group "
    "table-header-group table-footer-group table-column table-column-group table-caption list-item flow-root flow contents "
    "ruby run-in initial inherit unset revert revert-layer".split()
)
VISIBILITIES = {"hidden": False, "collapse": False, "visible": True, "initial": True} | dict.fromkeys(("inherit", "unset", "revert", "revert-layer"))
#: The screen that media queries are asked for: lengths in pixels, and features with the values that hold.
SCREEN = {"width": 1280.0, "height": 800.0, "device-width": 1280.0, "device-height": 800.0}
FEATURES = {
    "orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover",
    "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "none", "update": "fast", "color": "", "grid": "0",
}
LENGTH = re.compile(r"(\d*\.?\d+)(px|em|rem)?\Z")
NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
SIMPLE = re.compile(
    rf"(?P<tag>\*|{NAME})|(?P<sign>[.#])(?P<name>{NAME})|:(?P<colon>:?)(?P<pseudo>[\w-]+)(?P<open>\()?"
    rf"""|\[\s*(?P<attr>{NAME})\s*(?:(?P<how>[~|^$*]?=)\s*(?:"(?P<q>(?:\\.|[^"\\])*)"|'(?P<r>(?:\\.|[^'\\])*)'|(?P<bare>[^\s\]]+))\s*(?P<flag>[is])?\s*)?\]""",
    re.I | re.S,
)
JOIN = re.compile(r"\s*([>+~])\s*|\s+")
ESCAPE = re.compile(r"\\(?:([0-9a-f]{1,6})[ \t\n]?|(.))", re.I | re.S)
BLANK = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)  # of nodes and strings
    place: int = 1  # among the elements of its parent
    of: int = 1


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def tree(page: str) -> Node:
    """The page's elements; tags that HTML lets authors leave out are implied."""
    root = Node("html", {})
    open_: list[Node] = [root]
    counts: Counter[str] = Counter()

    def close(wanted: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> None:
        """End the nearest open element that is wanted, unless one of `within` is nearer."""
        if not any(counts[t] for t in wanted):
            return
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in wanted:
                counts.subtract(n.tag for n in open_[i:])
                del open_[i:]
                return
            if open_[i].tag in within:
                return

    at = 0
    while at < len(page):
        token = TOKEN.match(page, at)
        at = max(token.end(), at + 1)
        if token["text"] is not None:
            open_[-1].children.append(html.unescape(token["text"]))
        elif token["data"] is not None:
            open_[-1].children.append(token["data"])
        elif token["end"] is not None:
            tag = token["end"].lower()
            if tag == "br" or tag == "p" and not counts["p"]:
                open_[-1].children.append(Node(tag, {}))
            else:
                close({tag}, {"table"} - {tag} if tag in TABLE else FENCES)
        elif (tag := token["tag"] or token["loose"]) is not None:
            tag = tag.lower()
            attrs = attributes(token["attrs"] if token["tag"] else token["rest"])
            if tag in ("html", "body"):
                root.attrs |= {k: v for k, v in attrs.items() if k not in root.attrs}
                continue
            if tag in BLOCKS:
                close({"p"}, FENCES | {"button", "object"})
                close({"head"}, FENCES)
            if tag in CLOSES:
                close(*CLOSES[tag])
            node = Node(tag, attrs)
            open_[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                body = page[at : end.start() if end else len(page)]
                node.children.append(html.unescape(body) if tag in ("title", "textarea") else body)
                at = end.end() if end else len(page)
            elif tag not in VOID:  # a slash before the bracket does not end an HTML element
                open_.append(node)
                counts[tag] += 1
    return root


def holds(feature: str) -> bool | None:
    """Whether a media feature holds on a normal screen; None if it is not known."""
    feature = " ".join(feature.split())
    name, _, value = (x.strip() for x in feature.partition(":"))
    bound = re.match(r"(min|max)-(.+)\Z", name)
    own = re.match(r"([a-z-]+) ?(<=?|>=?|=) ?(.+)\Z", feature)
    if bound and bound[2] in SCREEN or name in SCREEN and value:
        side, name = (bound[1], bound[2]) if bound else ("", name)
    elif own and own[1] in SCREEN:
        name, side, value = own.groups()
    elif name in FEATURES:
        return value == FEATURES[name] if value else FEATURES[name] not in ("0", "none")
    else:
        return None
    m = LENGTH.match(value)
    if not m:
        return None
    length, has = float(m[1]) * (16 if m[2] in ("em", "rem") else 1), SCREEN[name]
    return {"min": has >= length, ">=": has >= length, "max": has <= length, "<=": has <= length, ">": has > length, "<": has < length}.get(side, has == length)


def on_screen(media: str) -> bool:
    """Whether one of the media queries matches a normal screen; what is not known does not match."""
    for query in media.lower().split(",") if media.strip() else ["all"]:
        parts = [p.strip() for p in re.split(r"\band\b", query)]
        first = re.match(r"(?:(only|not)\s+)?([a-z]+)\Z", parts[0])
        known: list[bool | None] = [first[2] in ("screen", "all")] if first else []
        known += [holds(p[1:-1]) if p[:1] == "(" and p[-1:] == ")" else None for p in parts[bool(first) :]]
        fits = False if False in known else None if None in known else True
        if fits is not None and fits != bool(first and first[1] == "not"):
            return True
    return False


def declarations(body: str) -> list[tuple[str, bool | None, bool]]:
    """(property, shows, important) of a rule's display and visibility; None inherits."""
    out = []
    for m in map(DECLARATION.match, body.split(";")):
        if m:
            name, value = m[1].lower(), " ".join(m[2].lower().split())
            if name == "display" and (value == "none" or set(value.split()) <= DISPLAYS):
                out.append((name, value != "none", bool(m[3])))
            elif name == "visibility" and value in VISIBILITIES:
                out.append((name, VISIBILITIES[value], bool(m[3])))
    return out


def own_part(body: str) -> str:
    """A rule's declarations without the rules nested in it."""
    kept, depth = [], 0
    for piece in re.split(r"([{}])", body):
        if piece == "{":
            if not depth:
                kept.append(kept.pop().rpartition(";")[0] + ";")
            depth += 1
        elif piece == "}":
            depth -= 1
        elif not depth:
            kept.append(piece)
    return "".join(kept)


def rules_of(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that apply on a normal screen, in order."""
    quoted: list[str] = []  # strings wait here, as they may hold any sign
    sheet = IGNORED.sub(lambda m: quoted.append(m[1]) or f'"{len(quoted) - 1}"' if m[1] else " ", sheet)
    at, applies = 0, [True]
    while m := re.compile(r"[{};]").search(sheet, at):
        before, at = sheet[at : m.start()].strip(), m.end()
        if m[0] == "}":
            if len(applies) > 1:
                applies.pop()
        elif m[0] == "{" and before[:1] == "@":
            name, _, rest = before[1:].replace("(", " (", 1).partition(" ")
            fits = on_screen(rest) if name.lower() == "media" else not rest.strip().lower().startswith("not") if name.lower() == "supports" else name.lower() == "layer"
            applies.append(applies[-1] and fits)
        elif m[0] == "{":
            depth, start = 1, at
            while depth and (m := re.compile(r"[{}]").search(sheet, at)):
                depth, at = depth + (1 if m[0] == "{" else -1), m.end()
            body = sheet[start : at - 1] if not depth else sheet[start:]
            at = at if not depth else len(sheet)
            if applies[-1]:
                yield re.sub(r'"(\d+)"', lambda m: quoted[int(m[1])], before), own_part(body)


Test = Callable[[Node], bool]
Found = tuple[str, bool | None, tuple[bool, bool, int, int]]


def unescaped(name: str) -> str:
    return ESCAPE.sub(lambda m: chr(min(int(m[1], 16), 0x10FFFF)) if m[1] else m[2], name)


def attribute_test(name: str, how: str | None, value: str, folded: bool) -> Test:
    fold = str.lower if folded else str
    value = fold(value)
    if how is None:
        return lambda n: name in n.attrs
    fits = {
        "=": lambda x: x == value, "~=": lambda x: value in x.split(), "|=": lambda x: x == value or x.startswith(value + "-"),
        "^=": lambda x: value != "" and x.startswith(value), "$=": lambda x: value != "" and x.endswith(value),
        "*=": lambda x: value != "" and value in x,
    }[how]
    return lambda n: name in n.attrs and fits(fold(n.attrs[name]))


def place_test(formula: str) -> Test | None:
    """:nth-child of odd, even or a formula an+b."""
    m = re.match(r"(?:([+-]?\d*)n)?([+-]?\d+)?\Z", {"odd": "2n+1", "even": "2n"}.get(formula, formula))
    if not m or not m[0]:
        return None
    a, b = int({"": "1", "+": "1", "-": "-1"}.get(m[1], m[1])) if m[1] is not None else 0, int(m[2] or 0)
    return lambda n: n.place == b if not a else (n.place - b) % a == 0 and (n.place - b) // a >= 0


PLACES: dict[str, Test] = {
    "first-child": lambda n: n.place == 1,
    "last-child": lambda n: n.place == n.of,
    "only-child": lambda n: n.of == 1,
    "empty": lambda n: not any(n.children),
}


def closing(source: str, at: int) -> int:
    """Place after the bracket that closes the one before `at`."""
    depth = 1
    for m in re.compile(r"""[()]|"[^"]*"|'[^']*'""").finditer(source, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return len(source) + 1


def pseudo_test(name: str, inner: str | None) -> tuple[Test, int] | None:
    """The test of a pseudo-class and its weight; None for one that needs a reader (hover, focus) or is not known."""
    if inner is None:
        return (PLACES[name], 100) if name in PLACES else ((lambda n: n.tag == "html"), 100) if name == "root" else None
    if name == "nth-child":
        test = place_test("".join(inner.lower().split()))
        return (test, 100) if test else None
    if name not in ("not", "is", "where"):
        return None
    options = [compound(x.strip()) for x in split_list(inner)]
    if any(x is None for x in options):
        return None
    weight = 0 if name == "where" else max(x[2] for x in options)
    return (lambda n: any(all(t(n) for t in x[0]) for x in options) == (name != "not")), weight


def split_list(selectors: str) -> list[str]:
    """The selectors of a list; commas in brackets and strings do not part."""
    out, depth, start = [], 0, 0
    for m in re.compile(r"""[()\[\],]|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\\.""", re.S).finditer(selectors):
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(m[0], 0)
        if m[0] == "," and not depth:
            out.append(selectors[start : m.start()])
            start = m.end()
    return [*out, selectors[start:]]


def compound(source: str) -> tuple[list[Test], str, int] | None:
    """(tests, the name to look it up by, weight) of a selector of one element; None if it never holds."""
    got = compound_at(source, 0)
    return got[:3] if got and got[3] == len(source) else None


def compound_at(source: str, at: int) -> tuple[list[Test], str, int, int] | None:
    tests: list[Test] = []
    key, weight, first = "*", 0, at
    while m := SIMPLE.match(source, at):
        if m["tag"] and at > first:
            return None
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
            if tag != "*":
                key, weight = tag, 1
                tests.append(lambda n, t=tag: n.tag == t or t == "body" and n.tag == "html")
        elif m["sign"]:
            name, sign = unescaped(m["name"]), m["sign"]
            weight += 10_000 if sign == "#" else 100
            key = sign + name if sign == "#" or key[0] != "#" else key
            if sign == "#":
                tests.append(lambda n, i=name: n.attrs.get("id") == i)
            else:
                tests.append(lambda n, c=name: c in n.attrs.get("class", "").split())
        elif m["attr"]:
            value = unescaped(next((v for v in (m["q"], m["r"], m["bare"]) if v is not None), ""))
            tests.append(attribute_test(unescaped(m["attr"]).lower(), m["how"], value, (m["flag"] or "").lower() == "i"))
            weight += 100
        else:
            inner = None
            if m["open"]:
                end = closing(source, at)
                inner, at = source[at : end - 1], min(end, len(source))
            got = None if m["colon"] else pseudo_test(m["pseudo"].lower(), inner)
            if got is None:
                return None
            tests.append(got[0])
            weight += got[1]
    return (tests, key, weight, at) if at > first else None


@dataclass(slots=True)
class Step:
    """One element of a selector; `after` is the step that comes before it, related as `join` says."""

    number: int
    tests: list[Test]
    after: int | None
    join: str
    rules: list[Found] = field(default_factory=list)


Sheet = dict[str, list[Step]]


def steps_of(selector: str) -> tuple[list[tuple[str, list[Test], str]], int] | None:
    """[(join, tests, key)] from left to right, and the selector's weight."""
    out, at, total, join = [], 0, 0, ""
    while got := compound_at(selector, at):
        tests, key, weight, at = got
        if out and key == "body" and out[-1][2] == "html" and len(out) == 1:
            out, join = [], ""  # the tree has one element for both
        out.append((join, tests, key))
        total += weight
        if at == len(selector):
            return out, total
        m = JOIN.match(selector, at)
        if not m:
            return None
        join, at = m[1] or " ", m.end()
    return None


def sheet_of(root: Node) -> Sheet:
    """The selectors of the style elements that set display or visibility, as steps by the name that leads to them."""
    out: Sheet = {}
    stack, order, number = [root], 0, 0
    while stack:
        node = stack.pop()
        if node.tag == "style" and on_screen(node.attrs.get("media", "")):
            for selectors, body in rules_of("".join(node.children)):
                order += 1
                given = declarations(body)
                for steps, weight in filter(None, map(steps_of, map(str.strip, split_list(selectors)))) if given else ():
                    after = None
                    for join, tests, key in steps:
                        number += 1
                        step = Step(number, tests, after, join)
                        out.setdefault(key, []).append(step)
                        after = number
                    step.rules += [(name, shows, (important, False, weight, order)) for name, shows, important in given]
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def rules_by_element(root: Node, sheet: Sheet) -> dict[int, list[Found]]:
    """What the sheet gives to each element, by its identity.

    One walk from the top: an element carries the steps that it and its ancestors have met, so a selector is
    never searched backwards and the work is bounded by elements times steps.
    """
    out: dict[int, list[Found]] = {}
    none: frozenset[int] = frozenset()

    def met(node: Node, joins: dict[str, frozenset[int]]) -> frozenset[int]:
        keys = {"*", node.tag, *("." + c for c in node.attrs.get("class", "").split()), "#" + node.attrs.get("id", "")}
        own = []
        for step in (s for k in keys | ({"body"} if node.tag == "html" else set()) for s in sheet.get(k, ())):
            if (step.after is None or step.after in joins[step.join]) and all(t(node) for t in step.tests):
                own.append(step.number)
                if step.rules:
                    out.setdefault(id(node), []).extend(step.rules)
        return frozenset(own) if own else none

    def added(a: frozenset[int], b: frozenset[int]) -> frozenset[int]:
        return a if b <= a else a | b

    first = met(root, dict.fromkeys(" >+~", none))
    stack = [(root, first, first)]
    while stack:
        node, own, above = stack.pop()
        elements = [c for c in node.children if not isinstance(c, str)]
        before = earlier = none
        for place, child in enumerate(elements, 1):
            child.place, child.of = place, len(elements)
            before = met(child, {" ": above, ">": own, "+": before, "~": earlier})
            earlier = added(earlier, before)
            stack.append((child, before, added(above, before)))
    return out


def shown(node: Node, ruled: dict[int, list[Found]]) -> tuple[bool, bool | None]:
    """Whether an element is displayed, and whether it is visible (None: as its parent); the cascade decides."""
    a = node.attrs
    if node.tag in NEVER_SHOWN or node.tag == "input" and a.get("type", "").lower() not in ("submit", "button", "reset"):
        return False, None
    displayed, visible = not ("hidden" in a or node.tag == "dialog" and "open" not in a), None
    found = list(ruled.get(id(node), ()))
    if "style" in a:
        found += [(name, shows, (important, True, 0, i)) for i, (name, shows, important) in enumerate(declarations(IGNORED.sub(" ", a["style"])))]
    for name, shows, _ in sorted(found, key=lambda x: x[2]):
        if name == "display":
            displayed = shows
        else:
            visible = shows
    return displayed, visible


class Flow:
    """Lines of text under way: blanks collapse, blocks are set apart."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.gap = 0

    def write(self, text: str) -> None:
        text = BLANK.sub(" ", text)
        if text[:1] == " ":
            self.blank = True
        words = text.strip(" ")
        if words:
            self._put(words)
            self.blank = text[-1] == " "

    def verbatim(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if line:
                self._put(line)

    def _put(self, word: str) -> None:
        if not self.line and self.gap:
            self.lines += [""] * (self.gap if self.lines else 0)
            self.gap = 0
        self.line.append(" " + word if self.blank and self.line else word)
        self.blank = False

    def newline(self) -> None:
        """A forced line end, also of an empty line."""
        if self.gap and not self.line:
            self.lines += [""] * (self.gap if self.lines else 0)
            self.gap = 0
        self.lines.append("".join(self.line).rstrip())
        self.line, self.blank = [], False

    def block(self, gap: int = 0) -> None:
        if self.line:
            self.newline()
        self.blank = False
        self.gap = max(self.gap, gap)

    def add(self, lines: list[str], first: str = "", rest: str = "") -> None:
        self.block()
        if not lines and not first:
            return
        if self.gap:
            self.lines += [""] * (self.gap if self.lines else 0)
            self.gap = 0
        for i, line in enumerate(lines or [""]):
            self.lines.append(((rest if i else first) + line).rstrip())

    def done(self) -> list[str]:
        self.block()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        start = next((i for i, line in enumerate(lines) if line), 0)
        return lines[start:]


def number(value: str | None, default: int) -> int:
    m = re.match(r"\s*[+-]?\d{1,9}", value or "")
    return int(m[0]) if m else default


@dataclass(slots=True)
class Cell:
    lines: list[str]
    at: int
    span: int
    align: str


def aligned(rows: list[list[tuple[list[str], Node]]]) -> list[str]:
    """Rows of cells in columns; a cell keeps its columns from the rows it spans."""
    placed, taken = [], {}
    for row in rows:
        cells, at = [], 0
        for lines, node in row:
            while taken.get(at, 0):
                at += 1
            span = min(max(number(node.attrs.get("colspan"), 1), 1), 1000)
            align = node.attrs.get("align", "") or (re.search(r"text-align\s*:\s*(\w+)", node.attrs.get("style", "")) or ("", ""))[1]
            cells.append(Cell(lines, at, span, align.lower()))
            down = min(max(number(node.attrs.get("rowspan"), 1), 1), 65_534)
            for i in range(at, at + span) if down > 1 else ():
                taken[i] = down
            at += span
        taken = {i: n - 1 for i, n in taken.items() if n > 1}
        placed.append(cells)
    widths: dict[int, int] = {}
    for cell in (c for cells in placed for c in cells):
        if cell.span == 1:
            widths[cell.at] = min(max([widths.get(cell.at, 0), *map(len, cell.lines)]), WIDEST)
    out = []
    for cells in placed:
        for i in range(max((len(c.lines) for c in cells), default=0)):
            line, column = "", 0
            for c in cells:
                start = sum(widths.get(k, 0) + 2 for k in range(column, c.at) if widths.get(k, 0))
                width = sum(widths.get(k, 0) for k in range(c.at, c.at + c.span)) + 2 * max(
                    0, sum(1 for k in range(c.at, c.at + c.span) if widths.get(k, 0)) - 1
                )
                text = c.lines[i] if i < len(c.lines) else ""
                text = text.rjust(width) if c.align == "right" else text.center(width) if c.align == "center" else text.ljust(width)
                line += " " * start + text + "  " * bool(width or text)
                column = c.at + c.span
            out.append(line.rstrip())
    return out


def render(page: str | None) -> str:
    """All visible text of a page; walks the tree without recursion, so depth is no limit."""
    root = tree(page or "")
    sheet, seen = sheet_of(root), [True]
    ruled = rules_by_element(root, sheet) if sheet else {}
    flows, tables, lists, verbatim = [Flow()], [], [], 0
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if seen[-1]:
                (flow.verbatim if verbatim else flow.write)(node)
            continue
        tag = node.tag
        if not leaving:
            displayed, visible = shown(node, ruled)
            if not displayed:
                continue
            visible = seen[-1] if visible is None else visible
            if tag == "br":
                if visible:
                    flow.newline()
                continue
            if tag == "input":
                if visible:
                    flow.write(f" {node.attrs.get('value', '')} ")
                continue
            if tag in BLOCKS:
                flow.block(1 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 0)
            if tag in ("pre", "textarea", "xmp"):
                verbatim += 1
                if tag == "pre" and node.children and isinstance(node.children[0], str):
                    node.children[0] = node.children[0].removeprefix("\n")
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, number(node.attrs.get("start"), 1)])
            if tag == "table":
                tables.append([])
            if tag == "tr" and tables:
                tables[-1].append([])
            if tag in APART or tag in CELLS and tables:
                flows.append(Flow())
            stack.append((node, True))
            seen.append(visible)
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            if tag == "table":  # captions stand first; stray text stands before the rows
                children = sorted(children, key=lambda c: isinstance(c, Node) and c.tag != "caption")
            stack.extend((c, False) for c in reversed(children))
            continue
        seen.pop()
        if tag in ("pre", "textarea", "xmp"):
            verbatim -= 1
        if tag in APART or tag in CELLS and tables:
            lines = flows.pop().done()
            above = flows[-1]
            if tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    own = number(node.attrs.get("value"), lists[-1][1])
                    lists[-1][1] = own + 1
                    mark = f"{own}. "
                if lines:
                    above.add(lines, mark, " " * len(mark))
            elif tag in ("td", "th"):
                if not tables[-1]:
                    tables[-1].append([])  # a cell without a row implies one
                tables[-1][-1].append((lines, node))
            elif tag == "table":
                above.add(lines + aligned(tables.pop()))
            else:
                above.add(lines, *(("  ", "  ") if tag in ("dd", "blockquote") else ()))
        if tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        if tag in BLOCKS:
            flows[-1].block(1 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 0)
    return "\n".join(line.replace("\xa0", " ") for line in flows[0].done())


def rendered(pages: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """Every row of `pages` with the visible text of its page in the column `to` (replaced if there).

    Style selectors may be compound, joined (descendant, child, sibling) and hold attributes and :not, :is, :where,
    :root, :empty and places among siblings; one with any other pseudo-class never holds. `html` and `body` are
    one element, and a `tbody` that is only implied is none. A null or empty page gives the empty text; broken markup is read as far as it goes, never refused; a
    page is one row however long it is; repeated rows give repeated texts; an empty table gives no rows.
    """
    plain = pages.drop(to) if to != html_col else pages
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields if f.name != to)
    source = plain.select(F.col(f"`{html_col}`").cast("string").alias(hidden(plain, "page")), *[F.col(f"`{c}`") for c in plain.columns if c != to])

    def laid_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                text = pa.array([render(t.as_py()) for t in part.column(0)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], text], [*part.schema.names[1:], to])

    return source.mapInArrow(laid_out, f"{fields}, `{to}` string")
