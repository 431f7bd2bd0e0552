"""Visible text of HTML pages by layout-aware rendering.

A small tree builder reads tags, text and raw elements, supplies implied end tags (p, li, dt, dd,
option, table parts) and ignores end tags without a start. Rendering leaves out what no reader
sees: head, scripts, styles, templates, comments, the `hidden` attribute, inline styles and
style-sheet rules with display:none or visibility:hidden, closed details but their summary. Style
sheets are read with their braces nested; rules hold where their medium is the screen of SCREEN, and
importance, layers, specificity and order decide between rules (selectors are tags, classes and ids of
one element; those with combinators, attributes or pseudo-classes are not read). Blocks
stand on lines of their own, paragraphs and headings apart by a blank line; list items get their
bullet or number and are indented by depth; the cells of a table are padded to the widest of
their column; pre keeps its white space; br breaks a line.

Null and empty pages give an empty text. Nothing is cut: depth and length have no limit (no
recursion). Broken markup is text or is skipped as a browser would. Repeated rows are rendered
each for itself, extra columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from orrery.llm.common import small_batches, text_of

MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</\s*([A-Za-z][^\s/>]*)[^>]*(?:>|$)"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
# Comments, strings and urls of a style sheet: they may hold braces and semicolons.
CSS_OPAQUE = re.compile(
    r"/\*.*?(?:\*/|$)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|url\(\s*[^)\"'\s][^)]*\)?|<!--|-->", re.S | re.I
)
COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
DISPLAYS = set(
    "none block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-column "
    "table-caption table-row-group table-header-group table-footer-group table-column-group list-item contents flow flow-root "
    "run-in ruby ruby-base ruby-text math -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex "
    "initial inherit unset revert revert-layer".split()
)
VISIBLE = set("visible hidden collapse initial inherit unset revert revert-layer".split())
# The medium that pages are read on: a desktop screen, lengths in pixels, resolution in dots a pixel.
SCREEN = {
    "width": 1280, "height": 800, "device-width": 1280, "device-height": 800, "aspect-ratio": 1.6, "device-aspect-ratio": 1.6,
    "resolution": 1, "-webkit-device-pixel-ratio": 1, "color": 8, "color-index": 0, "monochrome": 0, "grid": 0,
    "orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "update": "fast",
    "scripting": "enabled", "display-mode": "browser", "overflow-block": "scroll", "overflow-inline": "scroll", "color-gamut": "srgb",
    "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference",
    "prefers-reduced-transparency": "no-preference", "prefers-reduced-data": "no-preference", "forced-colors": "none",
    "inverted-colors": "none", "dynamic-range": "standard",
}
UNITS = {"": 1, "px": 1, "em": 16, "rem": 16, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4, "pt": 4 / 3, "pc": 16, "x": 1, "dppx": 1, "dpi": 1 / 96, "dpcm": 2.54 / 96}
MEASURE = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+))(?:\s*/\s*(\d+\.?\d*)|([a-z]*))")
RANGE = re.compile(r"(?:([^<>=]+?)\s*([<>]=?|=)\s*)?([a-z][a-z-]*)\s*(?:([<>]=?|=)\s*([^<>=]+))?")
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp".split())
UNSEEN = set("head script style template noscript iframe object audio video canvas datalist title dialog".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
APART = set("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure".split())
ENDS_P = BLOCK - set("body html li dd dt option optgroup legend summary figcaption".split())
# A start tag ends these open elements, up to the nearest of those that bound it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
# An end tag does not reach past these.
SCOPE = {"td": "table", "th": "table", "tr": "table", "li": "ul ol", "p": "table td th"}
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def values(self) -> dict[str, str]:
        return {
            m[1].lower(): html.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
            for m in ATTRIBUTE.finditer(self.attrs)
        } if self.attrs.strip(" /\n\t") else {}


class Builder:
    """The tree of a page; nodes hold texts and nodes."""

    def __init__(self, page: str):
        self.root = Node("#root")
        self.stack, self.open = [self.root], Counter()
        self.styles: list[tuple[str, str]] = []
        at, low = 0, None
        while True:
            m = MARKUP.search(page, at)
            if not m:
                self.text(page[at:])
                break
            self.text(page[at:m.start()])
            at = m.end()
            if m[1]:
                self.end(m[1].lower())
            elif m[2]:
                tag = m[2].lower()
                node = self.start(tag, m[3])
                if tag in RAW:
                    low = page.lower() if low is None else low
                    stop = low.find("</" + tag, at) if len(low) == len(page) else page.find("</" + tag, at)
                    stop = len(page) if stop < 0 else stop
                    if tag == "style":
                        values = node.values()
                        kind = values.get("type", "").strip().lower()
                        # With scripts on, noscript and template hold no style sheet of the page.
                        if kind in ("", "text/css") and not (self.open["noscript"] > 0 or self.open["template"] > 0):
                            self.styles.append((values.get("media", ""), page[at:stop]))
                    elif tag != "script":
                        node.children.append(html.unescape(page[at:stop]))
                    at = stop
        del self.stack

    def text(self, s: str) -> None:
        if s:
            self.stack[-1].children.append(html.unescape(s) if "&" in s else s)

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        return tag

    def close(self, tags: set[str], bounds: set[str]) -> None:
        """End the outermost of `tags` that is open inside the nearest bound."""
        if not any(self.open[t] > 0 for t in tags):
            return
        depth = None
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in bounds:
                break
            if tag in tags:
                depth = i
        while depth is not None and len(self.stack) > depth:
            self.pop()

    def start(self, tag: str, attrs: str) -> Node:
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag in ENDS_P and self.open["p"] > 0:
            self.close({"p"}, {"table", "td", "th", "button"})
        node = Node(tag, attrs or "")
        self.stack[-1].children.append(node)
        if tag not in VOID and not (attrs and attrs.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW):
            self.stack.append(node)
            self.open[tag] += 1
        return node

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        if self.open[tag] <= 0:
            return
        scope = set(SCOPE.get(tag, "").split())
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i].tag in scope:
                return


def split_outside(s: str, by: str) -> list[str]:
    """Parts of `s` between those `by` that stand outside parentheses and brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(s):
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == by and depth <= 0:
            parts.append(s[start:i])
            start = i + 1
    return [*parts, s[start:]]


def _measure(text: str) -> float | None:
    m = MEASURE.fullmatch(text.strip())
    if not m or (m[3] or "") not in UNITS or (m[2] and not float(m[2])):
        return None
    return float(m[1]) / float(m[2]) if m[2] else float(m[1]) * UNITS[m[3] or ""]


def _compared(a: float, sign: str, b: float) -> bool:
    return a == b if sign == "=" else (a < b if "<" in sign else a > b) or ("=" in sign and a == b)


def feature(text: str) -> bool | None:
    """Whether SCREEN has a media feature; None where the feature is not known."""
    name, colon, value = (x.strip() for x in text.partition(":"))
    if colon:
        least, most = name.startswith(("min-", "-webkit-min-")), name.startswith(("max-", "-webkit-max-"))
        have = SCREEN.get(re.sub(r"^(-webkit-)?(min|max)-", r"\1", name) if least or most else name)
        if isinstance(have, str):
            return None if least or most else have == value
        want = _measure(value)
        if have is None or want is None:
            return None
        return _compared(have, ">=" if least else "<=" if most else "=", want)
    m = RANGE.fullmatch(text.strip())
    have = SCREEN.get(m[3]) if m else None
    if have is None:
        return None
    if not m[2] and not m[4]:
        return have not in (0, "none", "no-preference")
    ends = [(m[1], m[2], True), (m[5], m[4], False)]
    found = True
    for side, sign, before in ends:
        if sign:
            want = _measure(side)
            if want is None or isinstance(have, str):
                return None
            found = found and (_compared(want, sign, have) if before else _compared(have, sign, want))
    return found


def condition(text: str, known=feature) -> bool | None:
    """A condition of features in parentheses, not, and, or; None where its outcome is not known."""
    value = {"\1": True, "\2": False, "\3": None}
    mark = {v: k for k, v in value.items()}

    def joined(words: list[str]) -> bool | None:
        terms, links, negated = [], set(), False
        for w in words:
            if w == "not":
                negated = not negated
            elif w in ("and", "or"):
                links.add(w)
            else:
                term = value.get(w)
                terms.append(not term if negated and term is not None else term)
                negated = False
        if len(links) > 1 or len(terms) != sum(w in ("and", "or") for w in words) + 1:
            return None
        if "or" in links:
            return True if True in terms else None if None in terms else False
        return False if False in terms else None if None in terms else True

    text = re.sub(r"[\1-\3]", "", text).lower()
    open_parts: list[list[str]] = [[]]
    for piece in re.split(r"([()])", text) + [")"] * max(0, text.count("(") - text.count(")")):
        if piece == "(":
            open_parts.append([])
        elif piece == ")" and len(open_parts) > 1:
            inner = "".join(open_parts.pop())
            called = open_parts[-1] and re.search(r"[\w-]$", open_parts[-1][-1])
            found = None if called else joined(inner.split()) if re.search(r"[\1-\3]", inner) and ":" not in inner else known(inner)
            open_parts[-1].append(f" {mark[found]} ")
        else:
            open_parts[-1].append(piece)
    return joined("".join(open_parts[0]).split())


def fits(media: str) -> bool:
    """Whether a list of media queries holds for SCREEN."""
    if not media.strip():
        return True
    for query in split_outside(media, ","):
        m = re.fullmatch(r"\s*(?:(not|only)\s+)?([a-z-]+)\s*(?:\band\b\s*(.*))?", query, re.S | re.I)
        if m and m[2].lower() not in ("not", "only", "and", "or"):
            found = m[2].lower() in ("all", "screen")
            rest = condition(m[3]) if m[3] else True
            found = False if not found or rest is False else rest
            found = not found if (m[1] or "").lower() == "not" and found is not None else found
        else:
            found = condition(query)
        if found:
            return True
    return False


def supported(text: str) -> bool | None:
    """Whether a declaration in an @supports condition is taken as supported: all but those of other makers are."""
    return not re.match(r"\s*-(?:ms|o|khtml)-|\s*display\s*:\s*-ms-", text)


def declared(text: str) -> tuple[str, bool | None, bool] | None:
    """(property, hides, important) of a declaration of display or visibility; hides is None for the default."""
    name, colon, value = text.partition(":")
    name = name.strip().lower()
    if not colon or name not in ("display", "visibility"):
        return None
    value = value.strip().lower()
    plain = re.sub(r"\s*!\s*important$", "", value)
    words = plain.split()
    if "var(" not in plain and (not words or not DISPLAYS.issuperset(words) if name == "display" else plain not in VISIBLE):
        return None
    return name, None if plain.startswith("revert") else plain in ("none", "hidden", "collapse"), plain != value


class Rules:
    """What style sheets say about display and visibility, by a class, id or tag of the selector."""

    def __init__(self, styles: list[tuple[str, str]]):
        self.found: dict[str, list[tuple]] = {}
        self.layers: dict[tuple, int] = {}
        self.order = 0
        for media, sheet in styles:
            if re.search("display|visibility", sheet, re.I) and fits(media):
                self.read(CSS_OPAQUE.sub(lambda m: "" if m[0][0] in "/<-" else '""', sheet))

    def read(self, sheet: str) -> None:
        # A level: selectors (None outside a style rule), whether it applies, its cascade layer.
        levels: list[tuple] = [(None, True, ())]
        last = 0
        for m in re.finditer(r"[{};]", sheet):
            selectors, applies, layer = levels[-1]
            part = sheet[last:m.start()]
            if m[0] == "{":
                levels.append(self.level(part.strip(), *levels[-1]))
            elif m[0] == "}" and len(levels) > 1:
                self.declare(part, *levels.pop())
            elif selectors is not None and m[0] == ";":
                self.declare(part, *levels[-1])
            elif m[0] == ";" and part.lstrip().startswith("@"):
                if applies and re.match(r"\s*@layer\s", part, re.I):
                    for name in part.split(None, 1)[1].split(","):
                        self.ranked(layer, name.strip())
            else:
                continue  # stray: it spoils the rule that follows
            last = m.end()
        self.declare(sheet[last:], *levels[-1])

    def ranked(self, layer: tuple, name: str) -> tuple:
        for part in name.split(".") if name else [f" {len(self.layers)}"]:
            layer = (*layer, part)
            self.layers.setdefault(layer, len(self.layers))
        return layer

    def level(self, head: str, selectors, applies: bool, layer: tuple) -> tuple:
        if head.startswith("@"):
            m = re.match(r"@([\w-]+)\s*(.*)", head, re.S)
            name, rest = (m[1].lower(), m[2]) if m else ("", "")
            if name == "media":
                applies = applies and fits(rest)
            elif name == "supports":
                applies = applies and bool(condition(rest, supported))
            elif name == "layer":
                layer = self.ranked(layer, rest.strip()) if applies else layer
            else:
                applies = False
            return selectors, applies, layer
        found = []
        for s in split_outside(head, ","):
            s = s.strip()
            nested = selectors is not None
            m = COMPOUND.fullmatch(s[1:] if nested and s.startswith("&") else s)
            if m and s and (not nested or s.startswith("&")):
                tag = (m[1] or "").lower()
                names = re.findall(r"[.#][\w-]+", m[2])
                found += [(tag or t, [*ns, *names]) for t, ns in selectors] if nested else [(tag, names)]
        return found, applies, layer

    def declare(self, text: str, selectors, applies: bool, layer: tuple) -> None:
        known = declared(text) if selectors and applies else None
        if not known:
            return
        name, hides, important = known
        ranks = [self.layers[layer[:i + 1]] for i in range(len(layer))] + [float("inf")]
        self.order += 1
        for tag, names in selectors:
            tag = "" if tag == "*" else tag
            ids = sum(n[0] == "#" for n in names)
            weight = (important, False, tuple(-r for r in ranks) if important else tuple(ranks), (ids, len(names) - ids, bool(tag)), self.order)
            self.found.setdefault(names[-1] if names else tag or "*", []).append((tag, set(names), name, hides, weight))

    def shown(self, tag: str, values: dict[str, str]) -> bool:
        best: dict[str, tuple] = {}
        if self.found:
            names = {"." + c for c in values.get("class", "").split()}
            if values.get("id"):
                names.add("#" + values["id"])
            for key in (*names, tag, "*"):
                for t, need, name, hides, weight in self.found.get(key, ()):
                    if t in ("", tag) and need <= names and (name not in best or weight > best[name][0]):
                        best[name] = (weight, hides)
        if values.get("style"):
            for i, part in enumerate(CSS_OPAQUE.sub(lambda m: "" if m[0][0] in "/<-" else '""', values["style"]).split(";")):
                known = declared(part)
                if known:
                    weight = (known[2], True, (), (), i)
                    if known[0] not in best or weight > best[known[0]][0]:
                        best[known[0]] = (weight, known[1])
        display = best.get("display", (None, None))[1]
        return not ("hidden" in values if display is None else display) and not best.get("visibility", (None, None))[1]


def seen(node: Node, rules: Rules) -> bool:
    tag = node.tag
    values = node.values() if node.attrs else {}
    if tag in UNSEEN and not (tag == "dialog" and "open" in values):
        return False
    if tag == "input" and values.get("type") == "hidden":
        return False
    return rules.shown(tag, values) if values or rules.found else True


class Lines:
    """Lines of a block being written, with white space collapsed."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.blank = False

    def word(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for r in rest:
                self.end_line(True)
                self.now.append(r)
            return
        parts = SPACE.split(s)
        if parts[0] == "" and len(parts) > 1:
            self.gap = True
        words = [p for p in parts if p]
        if not words:
            return
        if self.now and self.gap:
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.gap = parts[-1] == ""

    def end_line(self, keep: bool = False) -> None:
        if self.now or keep:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append("".join(self.now).rstrip())
        self.now, self.gap = [], False

    def apart(self) -> None:
        self.end_line()
        self.blank = True

    def add(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines += lines


def aligned(rows: list[list[str]]) -> list[str]:
    """Cells padded to the widest of their column, two spaces between columns."""
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            if i == len(widths):
                widths.append(0)
            widths[i] = max(widths[i], len(cell))
    return ["  ".join(c.ljust(w) for c, w in zip(row, widths, strict=False)).rstrip() for row in rows]


class Frame:
    """An element being rendered: where its children stand and where its lines go."""

    __slots__ = ("node", "at", "out", "pre", "kind", "count", "rows", "step")

    def __init__(self, node, out, pre, kind="", count=0, rows=None, step=1):
        self.node, self.at, self.out, self.pre = node, 0, out, pre
        self.kind, self.count, self.rows, self.step = kind, count, rows, step


def _number(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"-?\d{1,9}", text or "") else default


def render(page: str) -> tuple[str, int, int]:
    """The visible text, and the numbers of its tables and list items."""
    built = Builder(page)
    rules = Rules(built.styles)
    top = Lines()
    stack = [Frame(built.root, top, False)]
    tables = items = 0
    while stack:
        f = stack[-1]
        if f.at < len(f.node.children):
            child = f.node.children[f.at]
            f.at += 1
            if isinstance(child, str):
                if f.kind not in ("table", "row", "list") or child.strip():
                    f.out.word(child, f.pre)
                continue
            if not seen(child, rules):
                continue
            tag = child.tag
            if tag == "br":
                f.out.end_line(True)
            elif tag == "hr":
                f.out.end_line()
            elif tag == "table":
                f.out.apart()
                tables += 1
                stack.append(Frame(child, Lines(), False, "table", rows=[]))
            elif tag in ("thead", "tbody", "tfoot") and f.rows is not None:
                stack.append(Frame(child, f.out, False, "table", rows=f.rows))
            elif tag == "tr" and f.rows is not None:
                f.rows.append([])
                stack.append(Frame(child, f.out, False, "row", rows=f.rows))
            elif tag in ("td", "th") and f.rows is not None:
                if not f.rows:
                    f.rows.append([])
                stack.append(Frame(child, Lines(), False, "cell", rows=f.rows))
            elif tag in ("ul", "ol", "menu", "dir"):
                inner = any(x.kind == "item" for x in stack)
                f.out.end_line() if inner else f.out.apart()
                values = child.values()
                start = _number(values.get("start", ""), 1) if tag == "ol" else 0
                stack.append(Frame(child, f.out, f.pre, "list" if tag != "ol" else "numbers", start))
            elif tag == "li":
                items += 1
                f.out.end_line()
                if f.kind == "numbers":
                    f.count = _number(child.values().get("value", ""), f.count)
                    mark, f.count = f"{f.count}. ", f.count + 1
                else:
                    mark = "- "
                stack.append(Frame(child, Lines(), f.pre, "item", mark))
            elif tag == "details" and "open" not in child.values():
                child.children = [c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]
                f.out.end_line()
                stack.append(Frame(child, f.out, f.pre, "block"))
            elif tag in BLOCK:
                f.out.apart() if tag in APART else f.out.end_line()
                stack.append(Frame(child, f.out, f.pre or tag == "pre", "apart" if tag in APART else "block"))
            else:
                if tag == "input" and child.values().get("type", "text") in ("submit", "button", "reset"):
                    f.out.word(child.values().get("value", ""), False)
                stack.append(Frame(child, f.out, f.pre or tag in ("textarea", "xmp"), ""))
            continue
        stack.pop()
        if f.kind == "block":
            f.out.end_line()
        elif f.kind in ("apart",):
            f.out.apart()
        elif f.kind in ("list", "numbers"):
            f.out.end_line() if any(x.kind == "item" for x in stack) else f.out.apart()
        elif f.kind == "item":
            f.out.end_line()
            pad = " " * len(f.count)
            lines = [(pad if i else f.count) + x if x else "" for i, x in enumerate(f.out.lines or [""])]
            stack[-1].out.add([x.rstrip() for x in lines])
        elif f.kind == "cell":
            f.out.end_line()
            row = f.rows[-1]
            row.append(" ".join(" ".join(x.split()) for x in f.out.lines if x.strip()))
            row += [""] * (min(_number(f.node.values().get("colspan", ""), 1), 1000) - 1)
        elif f.kind == "table" and f.node.tag == "table":
            f.out.end_line()
            out = stack[-1].out
            out.add(f.out.lines)
            out.add(aligned(f.rows))
            out.apart()
    top.end_line()
    while top.lines and not top.lines[-1].strip():
        top.lines.pop()
    start = next((i for i, x in enumerate(top.lines) if x.strip()), 0)
    return "\n".join(top.lines[start:]), tables, items


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines, n_tables, n_items for every row of `pages`."""
    small_batches(pages.sparkSession)

    def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [render(text_of(x)) for x in b["html"]]
            yield pd.DataFrame({
                "page_id": b["page_id"].astype("Int64").array, "text": [r[0] for r in found],
                "n_chars": [len(r[0]) for r in found], "n_lines": [r[0].count("\n") + 1 if r[0] else 0 for r in found],
                "n_tables": [r[1] for r in found], "n_items": [r[2] for r in found],
            })

    return pages.select("page_id", "html").mapInPandas(
        rendered, "page_id long, text string, n_chars long, n_lines long, n_tables long, n_items long"
    )
