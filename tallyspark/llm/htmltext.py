"""Operator 3: layout-aware text of HTML pages.

A scanner splits a page into tags and text; a tree builder adds the tags that
HTML lets authors leave out and closes those that others end; a renderer walks
the tree and writes all visible text: blocks on lines of their own with their
spacing, lists with markers and indents, table cells in aligned columns.

Not visible: head, script, style, template, frames and media fallbacks, elements
with ``hidden``, ``display:none`` or ``visibility:hidden`` by the cascade of style
attributes and style elements (media rules as on a screen of ``SCREEN`` pixels;
a rule that is not fully understood never hides but may show), closed ``details`` but
for the summary, and dialogs that are not open. Form controls show their value.

Neither building nor rendering recurses or walks over the open elements, and no
pattern has two ways to read a text, so the time of a page grows with its length,
whatever its nesting. So does what it writes: at most ``DEEPEST`` levels are
indented; a column is as wide as its longest cell of up to ``WIDE`` times its
mean (longer ones push the rest of their line to the right); columns that only
spans lie over have no width; rows spanned over are kept for the first
``COLUMNS`` columns; and a table of which more than ``PADDED`` times its text
would be blanks is written with two blanks between cells and no columns. Each
page is done by itself in one narrow pass, in whole.

Defined cases: a null or empty page gives the empty text; text without tags is
kept as it is, with white space collapsed; an unfinished tag or comment at the
end is dropped; repeated rows give repeated rows; columns named like the result
column are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_batches, table

# fixed values: classes of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
HIDDEN = frozenset("head script style template noframes noembed iframe object audio video canvas datalist title".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPED_RAW = frozenset("textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table ul xmp caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset hr xmp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html table td th caption template button object marquee applet".split())
CELLS = frozenset(("td", "th"))
PARTS = frozenset(("tbody", "thead", "tfoot"))
LISTS = frozenset("ul ol menu dir".split())
SPACE = " \t\n\r\f"
#: Levels of lists and quotations that are indented; deeper ones stand under the last of them.
DEEPEST = 8
#: What bounds the alignment of tables; see above.
WIDE, PADDED, COLUMNS = 4, 4, 256

# Each character of a page is read once or twice: no pattern here has two ways to read a text.
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_NEXT_ATTR = re.compile(r"[\s/]*+(?:(>)|(=?+[^\s/>=]*+)(\s*+=\s*+)?+([\"'])?+)")
_BARE = re.compile(r"[^\s>]*+")
# a sheet's tokens: strings, braces, semicolons and what is between them
_CSS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]|(?:[^{};\"'\\]|\\.)+|.", re.S)
_AT = re.compile(r"@([\w-]+)(.*)\Z", re.S)
_IDENT = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_PART = re.compile(rf"(?P<kind>[.#]?)(?P<name>{_IDENT})|(?P<all>\*)|\[\s*+(?P<attr>[\w-]++)\s*+(?:(?P<op>[~|^$*]?=)\s*+(?:\"(?P<dq>[^\"]*+)\"|'(?P<sq>[^']*+)'|(?P<bare>[^\]\s]++))\s*+(?:[iIsS]\s*+)?)?\]|(?P<pseudo>::?[\w-]+)(?P<open>\()?")
_JOIN = re.compile(r"\s*+([>+~])\s*+|\s++")
_ESCAPED = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))")
_LENGTH = re.compile(r"\(\s*(min-|max-)?(?:device-)?(width|height)\s*:\s*(\d*\.?\d+)(px|em|rem)?\s*\)")
_RANGE = re.compile(r"\(\s*(width|height)\s*(<=?|>=?|=)\s*(\d*\.?\d+)(px|em|rem)?\s*\)")
# the screen that media rules are asked for
SCREEN = {"width": 1280, "height": 800}
FEATURES = {"(orientation:landscape)": True, "(orientation:portrait)": False, "(prefers-color-scheme:light)": True, "(prefers-color-scheme:dark)": False, "(hover:hover)": True, "(hover:none)": False, "(pointer:fine)": True, "(pointer:coarse)": False, "(prefers-reduced-motion:reduce)": False}
AT_REST_NEVER = frozenset("hover focus focus-within focus-visible active target visited before after first-line first-letter".split())
_RUN = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(html: str, at: int, missing: set[str]) -> tuple[dict[str, str], int]:
    """A tag's attributes from behind its name, and the place behind its ``>``; -1 if the page ends first.

    ``missing``: quotes that do not come again in this page; a value that opens with one is bare.
    """
    out: dict[str, str] = {}
    while True:
        m = _NEXT_ATTR.match(html, at)
        if m[1]:
            return out, m.end()
        name, quote, at = m[2], m[4], m.end()
        if not quote and not name and m[3] is None:
            return out, -1
        if quote and quote not in missing:
            end = html.find(quote, at)
            if end >= 0:
                value, at = html[at:end], end + 1
            else:
                missing.add(quote)
        if m[3] is not None and (not quote or quote in missing):
            bare = _BARE.match(html, m.end(3))
            value, at = bare[0], bare.end()
        if name:
            out.setdefault(name.lower(), unescape(value) if m[3] is not None else "")


class Builder:
    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        # where the open elements of each name stand, so that looking for one does not walk over the others
        self.places: dict[str, list[int]] = {"html": [0]}
        self.in_body = False
        self.sheets: list[tuple[str, str]] = []

    def last(self, names) -> int:
        return max((at[-1] for n in names if (at := self.places.get(n))), default=-1)

    def add(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def cut(self, at: int) -> None:
        """Close all elements from this place on."""
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def within(self, names, stop=SCOPE) -> int:
        """The place of the nearest open element of these names, before a boundary; -1 if none."""
        at = self.last(names)
        return at if at < 0 or at >= self.last(stop) else -1

    def close(self, names, stop=SCOPE) -> bool:
        at = self.within(names, stop)
        if at > 0:
            self.cut(at)
        return at > 0

    def push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.add(node)
        return node

    def body(self) -> None:
        if not self.in_body:
            self.cut(1)
            self.push("body", {})
            self.in_body = True

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        if not self.in_body:
            if tag == "head":
                self.close(("head",))
                self.push("head", attrs)
                return
            if tag in ("body", "frameset"):
                self.body()
                self.open[-1].attrs = attrs
                return
            if tag in HEAD:
                if len(self.open) == 1:
                    self.push("head", {})
            else:
                self.body()
        elif tag in ("head", "body", "frameset"):
            return
        if tag in CLOSES_P:
            self.close(("p",))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.cut(len(self.open) - 1)
        if tag == "li":
            self.close(("li",), SCOPE | LISTS)
        elif tag in ("dd", "dt"):
            self.close(("dd", "dt"), SCOPE | {"dl"})
        elif tag in ("option", "optgroup"):
            self.close(("option",), SCOPE | {"select", "optgroup"} if tag == "option" else SCOPE | {"select"})
            if tag == "optgroup":
                self.close(("optgroup",), SCOPE | {"select"})
        elif tag in PARTS or tag in ("tr", "td", "th", "caption", "colgroup"):
            at = self.within(("table",), {"html"})
            if at < 0:
                return
            held = {"tr": ("tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}.get(tag, ())
            self.cut(max(at, self.last(held)) + 1)
            if tag in ("tr", "td", "th") and self.open[-1].tag == "table":
                self.push("tbody", {})
            if tag in CELLS and self.open[-1].tag != "tr":
                self.push("tr", {})
        elif self.open[-1].tag in ("table", "tr") or self.open[-1].tag in PARTS:
            if tag not in ("script", "style", "template", "col", "form", "input"):
                node = Node(tag, attrs)
                self.foster(node)
                if tag not in VOID and not closed:
                    self.add(node)
                return
        self.push(tag, attrs)
        if tag in VOID or (closed and tag in ("path", "circle", "rect", "line", "use", "polygon", "image")):
            self.cut(len(self.open) - 1)

    def foster(self, item) -> None:
        """What may not stand in a table goes before it."""
        at = self.within(("table",), {"html"})
        parent = self.open[at - 1]
        place = next((i for i in range(len(parent.children) - 1, -1, -1) if parent.children[i] is self.open[at]), len(parent.children))
        parent.children.insert(place, item)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if not self.in_body:
                self.close(("head",))
            return
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "p":
            if not self.close(("p",)):
                self.start("p", {}, False)
                self.cut(len(self.open) - 1)
        elif tag in HEADINGS:
            self.close(HEADINGS)
        elif tag in CELLS or tag in PARTS or tag in ("tr", "table", "caption"):
            self.close((tag,), {"html"} if tag == "table" else {"html", "table"})
        elif tag == "li":
            self.close(("li",), SCOPE | LISTS)
        else:
            self.close((tag,), SCOPE - {tag})

    def text(self, text: str) -> None:
        if not self.in_body and self.open[-1].tag in ("html", "head"):
            if not text.strip(SPACE):
                return
            self.body()
        top = self.open[-1].tag
        if top in ("table", "tr", "colgroup") or top in PARTS:
            if text.strip(SPACE):
                self.foster(text)
        else:
            self.open[-1].children.append(text)


def parse(html: str) -> tuple[Node, list[tuple[str, str]]]:
    """The tree and its style elements: media and text."""
    b = Builder()
    missing: set[str] = set()
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            b.text(unescape(html[at:]))
            break
        if lt > at:
            b.text(unescape(html[at:lt]))
        end = html.startswith("</", lt)
        m = _NAME.match(html, lt + 1 + end)
        if not m:
            if html.startswith("<!--", lt):
                close = _COMMENT_END.search(html, lt + 4)
                at = close.end() if close else n
            elif end or html.startswith(("<!", "<?"), lt):
                at = html.find(">", lt) + 1 or n
            else:
                b.text("<")
                at = lt + 1
            continue
        attrs, at = attributes(html, m.end(), missing)
        if at < 0:
            break  # an unfinished tag
        tag = m[0].lower()
        if end:
            b.end(tag)
            continue
        b.start(tag, attrs, html[at - 2] == "/")
        if (tag in RAW or tag in ESCAPED_RAW) and b.open[-1].tag == tag:
            stop = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(html, at)
            body = html[at : stop.start() if stop else n]
            if tag == "style":
                b.sheets.append((attrs.get("media", ""), body))
            b.open[-1].children.append(unescape(body) if tag in ESCAPED_RAW else body)
            b.cut(len(b.open) - 1)
            at = html.find(">", stop.start()) + 1 if stop else n
            if at == 0:
                break
    return b.root, b.sheets


def declared(text: str) -> dict[str, tuple[bool, bool]]:
    """Of display and visibility: (important, whether it shows) as a list of declarations leaves them."""
    out: dict[str, tuple[bool, bool]] = {}
    for part in text.lower().split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), value.strip()
        if name not in ("display", "visibility") or not value:
            continue
        before = value.removesuffix("important").rstrip()
        important = before != value and before.endswith("!")
        value = before[:-1].rstrip() if important else value
        if name == "visibility" and value not in ("visible", "initial", "hidden", "collapse"):
            continue  # inherited
        if important or not out.get(name, (False,))[0]:
            out[name] = (important, value not in ("none", "hidden", "collapse"))
    return out


def _both(a: bool | None, b: bool | None) -> bool | None:
    return False if a is False or b is False else None if a is None or b is None else True


def _feature(text: str) -> bool | None:
    if m := _LENGTH.fullmatch(text):
        have, want = SCREEN[m[2]], float(m[3]) * (16 if m[4] in ("em", "rem") else 1)
        return have >= want if m[1] == "min-" else have <= want if m[1] == "max-" else have == want
    if m := _RANGE.fullmatch(text):
        have, want = SCREEN[m[1]], float(m[3]) * (16 if m[4] in ("em", "rem") else 1)
        return {"<": have < want, "<=": have <= want, ">": have > want, ">=": have >= want, "=": have == want}[m[2]]
    return FEATURES.get(re.sub(r"\s", "", text))


def on_screen(media: str) -> bool | None:
    """Whether a media query list holds on ``SCREEN``; None if that is not known."""
    out: bool | None = False
    for query in re.sub(r"/\*.*?(?:\*/|\Z)", "", media, flags=re.S).lower().split(","):
        query = " ".join(query.split())
        negated = query.startswith("not ")
        query = re.sub(r"^(?:not|only)\s+", "", query)
        got: bool | None = True
        for part in re.split(r" ?\band\b ?", query):
            got = _both(got, True if part in ("", "all", "screen") else _feature(part) if part[0] == "(" else False if part.isalpha() else None)
        got = not got if negated and got is not None else got
        out = True if out or got else None if out is None or got is None else False
    return out


def style_rules(css: str, media: str = "") -> list[tuple[str, str, bool | None, int]]:
    """(selectors, declarations, whether it applies or None, layered 0 or not 1) of a sheet's rules, in order."""
    out: list = []
    # what is open: kind, whether it applies, layer, selectors, declarations, place in the order
    held: list[tuple] = [("at", on_screen(media), 1, "", [], 0)]
    now: list[str] = []
    for token in _CSS.findall(re.sub(r"/\*.*?(?:\*/|$)|<!--|-->", " ", css, flags=re.S)) + ["}"] * css.count("{"):
        kind, applies, layer, selectors, body, place = held[-1]
        if token == ";":
            if kind == "style":
                body.append("".join(now))
            now = []
        elif token == "{":
            prelude, now = "".join(now).strip(), []
            m = _AT.match(prelude)
            name = m[1].lower() if m else ""
            if kind == "skip" or (m and name not in ("media", "supports", "layer", "container", "scope")):
                held.append(("skip", False, layer, "", [], 0))
                continue
            if m:
                applies = _both(applies, on_screen(m[2]) if name == "media" else True if name == "layer" else None)
                held.append((kind, applies, 0 if name == "layer" else layer, selectors, [], len(out)))
            else:
                # a rule within a rule: its selectors are only a part of what it asks for
                held.append(("style", _both(applies, None) if kind == "style" else applies, layer, prelude, [], len(out)))
            if held[-1][0] == "style":
                out.append(None)
        elif token == "}":
            if kind == "style":
                body.append("".join(now))
                out[place] = (selectors, ";".join(body), applies, layer)
            now = []
            if len(held) > 1:
                held.pop()
        else:
            now.append(token)
    return [r for r in out if r]


def chains(text: str) -> list[tuple[list[tuple[str, dict]], tuple[int, int, int], bool]]:
    """Each selector of a list: compounds with what joins them to the one before, specificity,
    and whether they say all of it. Those of states that a page at rest is not in are left out;
    nothing if the list is not understood."""
    out = []
    text = ",".join(part.strip() for part in text.split(","))
    at, n = 0, len(text)
    while at <= n:
        chain: list[tuple[str, dict]] = []
        join, now, spec, whole, rest = "", {}, [0, 0, 0], True, True
        while at < n and text[at] != ",":
            if m := _JOIN.match(text, at):
                if now:
                    chain.append((join, now))
                    now = {}
                join = m[1] or " "
                if join in "+~":
                    chain, join, whole = [], "", False
                at = m.end()
                continue
            m = _PART.match(text, at)
            if not m:
                return []
            at = m.end()
            if m["pseudo"]:
                if m["open"]:
                    depth = 1
                    while at < n and depth:
                        depth += (text[at] == "(") - (text[at] == ")")
                        at += 1
                name = m["pseudo"].lower()
                rest = rest and not (name.startswith("::") or name.strip(":") in AT_REST_NEVER)
                whole, now = False, now or {"any": True}
                spec[1] += name != ":where"
            elif m["attr"]:
                op, value = m["op"] or "", m["dq"] or m["sq"] or m["bare"] or ""
                now.setdefault("attrs", []).append((m["attr"].lower(), op, value))
                spec[1] += 1
            elif m["all"]:
                now = now or {"any": True}
            else:
                name = _ESCAPED.sub(lambda e: chr(int(e[1], 16) if int(e[1], 16) < 0x110000 else 0xFFFD) if e[1] else e[2], m["name"])
                now.setdefault(m["kind"] or "tag", []).append(name if m["kind"] else name.lower())
                spec[{"#": 0, ".": 1}.get(m["kind"], 2)] += 1
        at += 1
        if not now:
            return []
        chain.append((join, now))
        if rest:
            out.append((chain, tuple(spec), whole))
    return out


_OPS = {"": lambda a, b: True, "=": lambda a, b: a == b, "~=": lambda a, b: b in a.split(), "^=": lambda a, b: bool(b) and a.startswith(b), "$=": lambda a, b: bool(b) and a.endswith(b), "*=": lambda a, b: bool(b) and b in a, "|=": lambda a, b: a == b or a.startswith(b + "-")}


def _fits(node: Node, classes: list[str], part: dict) -> bool:
    return (
        all(t == node.tag for t in part.get("tag", ()))
        and all(i == node.attrs.get("id") for i in part.get("#", ()))
        and all(c in classes for c in part.get(".", ()))
        and all(a in node.attrs and _OPS[op](node.attrs[a], v) for a, op, v in part.get("attrs", ()))
    )


class Styles:
    """The cascade of display and visibility. A rule that may not apply never hides, but may show."""

    def __init__(self, sheets: list[tuple[str, str]]):
        # by a compound's key: (join, compound, state before it, state after it, rule or None)
        self.by: dict[str, list[tuple]] = {}
        states = order = 0
        for media, sheet in sheets:
            for selectors, body, applies, layer in style_rules(sheet, media):
                if applies is False or not (says := declared(body)):
                    continue
                order += 1
                for chain, spec, whole in chains(selectors):
                    for k, (join, part) in enumerate(chain):
                        key = "#" + part["#"][0] if "#" in part else "." + part["."][0] if "." in part else part["tag"][0] if "tag" in part else "*"
                        rule = (says, layer, spec, order, whole and applies is True) if k == len(chain) - 1 else None
                        self.by.setdefault(key, []).append((join if k else "", part, states, states + 1, rule))
                        states += 1
                    states += 1

    def of(self, node: Node, parent: frozenset, above: frozenset) -> tuple[dict[str, bool], frozenset, frozenset]:
        """What holds for a node, its own states, and those of it and all above."""
        if not self.by and "style" not in node.attrs:
            return {}, frozenset(), above
        classes = node.attrs.get("class", "").split()
        won: dict[str, tuple] = {}
        own = []
        if self.by:
            keys = ["*", node.tag, *("." + c for c in dict.fromkeys(classes))]
            if "id" in node.attrs:
                keys.append("#" + node.attrs["id"])
            for key in keys:
                for join, part, before, after, rule in self.by.get(key, ()):
                    if (join == "" or before in (parent if join == ">" else above)) and _fits(node, classes, part):
                        if rule is None:
                            own.append(after)
                            continue
                        says, layer, spec, order, sure = rule
                        for name, (important, shows) in says.items():
                            if shows or sure:
                                won[name] = max(won.get(name, ()), (important, 0, layer, spec, order, shows))
        style = node.attrs.get("style")
        if style:
            for name, (important, shows) in declared(style).items():
                won[name] = max(won.get(name, ()), (important, 1, 1, (0, 0, 0), 0, shows))
        mine = frozenset(own)
        return {name: w[-1] for name, w in won.items()}, mine, above | mine if mine - above else above


@lru_cache(maxsize=64)
def styles(sheets: tuple[tuple[str, str], ...]) -> Styles:
    return Styles([x for x in sheets if "display" in x[1].lower() or "visibility" in x[1].lower()])


class Writer:
    """Lines under construction: one place where blocks, spaces and indents meet."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.indents: list[str] = []
        self.marker = ""

    def indent(self, text: str) -> None:
        """What a list or a quotation adds in front of its lines; from ``DEEPEST`` levels on nothing."""
        self.indents.append(text if len(self.indents) < DEEPEST else "")

    def word(self, text: str) -> None:
        if not self.now:
            if self.lines and self.gap > 1 and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0
            lead = "".join(self.indents[:DEEPEST])
            if self.marker:
                lead = lead[: max(len(lead) - len(self.marker), 0)] + self.marker if len(self.indents) <= DEEPEST else lead + self.marker
                self.marker = ""
            self.now.append(lead)
        elif self.space:
            self.now.append(" ")
        self.space = False
        self.now.append(text)

    def flow(self, text: str) -> None:
        """Text with white space collapsed across elements."""
        if not text:
            return
        if text[0] in SPACE:
            self.space = True
        inner = _RUN.sub(" ", text).strip(" ")
        if inner:
            self.word(inner.replace("\xa0", " "))
            self.space = text[-1] in SPACE

    def verbatim(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if line:
                self.space = False
                self.word(line)

    def newline(self) -> None:
        """A forced line end: an empty line stays if there is nothing on it."""
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        elif self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.space = False

    def block(self, gap: int) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def rows(self, rows: list[str]) -> None:
        for row in rows:
            if row:
                self.word(row)
                self.block(1)
            elif self.lines and self.lines[-1] != "":
                self.lines.append("")

    def done(self) -> list[str]:
        self.block(0)
        while self.lines and self.lines[-1] == "":
            self.lines.pop()
        return self.lines


class Grid:
    """A table's cells as they are met: (column, span, lines) by row."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        #: For each of the first columns, the number of the row that it is free in again.
        self.free = [0] * COLUMNS
        self.column = 0

    def row(self) -> None:
        self.rows.append([])
        self.column = 0

    def cell(self, attrs: dict[str, str], lines: list[str]) -> None:
        if not self.rows:
            self.row()
        now = len(self.rows) - 1
        while self.column < COLUMNS and self.free[self.column] > now:
            self.column += 1
        span, deep = _number(attrs.get("colspan"), 1, 1, 1000), _number(attrs.get("rowspan"), 1, 1, 65534)
        self.rows[-1].append((self.column, span, lines))
        if deep > 1:
            for c in range(self.column, min(self.column + span, COLUMNS)):
                self.free[c] = now + deep
        self.column += span

    def offsets(self) -> tuple[list[int], list[int]]:
        """The columns that have a width, and where each and what follows the last begins."""
        cells: dict[int, list[int]] = {}
        for row in self.rows:
            for at, span, lines in row:
                if span == 1:
                    cells.setdefault(at, []).append(max(map(len, lines), default=0))
        columns, starts = sorted(cells), [0]
        for c in columns:
            most = WIDE * (sum(cells[c]) / len(cells[c]) + WIDE)
            starts.append(starts[-1] + max((n for n in cells[c] if n <= most), default=0) + 2)
        return columns, starts

    def lines(self) -> list[str]:
        columns, starts = self.offsets()
        start = lambda column: starts[bisect_left(columns, column)]
        heights = [max((len(x[2]) for x in row), default=0) for row in self.rows]
        text = sum(len(line) - line.count(" ") + 2 for row in self.rows for *_, lines in row for line in lines or [""])
        padded = sum(start(row[-1][0]) * h for row, h in zip(self.rows, heights, strict=True) if row)
        aligned = padded <= PADDED * text
        out = []
        for row, height in zip(self.rows, heights, strict=True):
            at = [start(column) for column, *_ in row] if aligned else [0] * len(row)
            for k in range(height):
                line, long = [], 0
                for place, (*_, lines) in zip(at, row, strict=True):
                    cell = lines[k] if k < len(lines) else ""
                    blanks = max(place - long, 0 if aligned or not line else 2)
                    if aligned and line and cell:
                        blanks = max(blanks, 2 if long and line[-1][-1:] not in ("", " ") else 0)
                    line.append(" " * blanks + cell)
                    long += blanks + len(cell)
                out.append("".join(line).rstrip())
        return out


def _number(text: str | None, default: int, least: int, most: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return max(least, min(most, int(m[1]))) if m else default


def _hidden(node: Node) -> bool:
    tag, attrs = node.tag, node.attrs
    if tag in HIDDEN or (tag == "dialog" and "open" not in attrs) or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
        return True
    return "hidden" in attrs


def render(root: Node, sheet: Styles) -> str:
    writers, grids, counters = [Writer()], [], []
    # (node, iterator over its children, what to do at its end); invisible: how many open elements hide text
    stack: list[tuple] = []
    dark, pre = 0, 0

    def enter(node: Node) -> bool:
        nonlocal dark, pre
        if _hidden(node):
            return False
        parent, above = stack[-1][4:] if stack else (frozenset(), frozenset())
        holds, own, above = sheet.of(node, parent, above)
        if not holds.get("display", True):
            return False
        w, tag, attrs = writers[-1], node.tag, node.attrs
        shade = 0
        if not holds.get("visibility", True):
            shade = 1
        elif dark and "visibility" in holds:
            shade = -dark
        dark += shade
        if tag == "br":
            w.newline()
        elif tag == "hr":
            w.block(2)
        elif tag == "q" and not dark:
            w.word("“")
        elif tag == "input" and not dark and attrs.get("type", "text").lower() not in ("checkbox", "radio", "password", "file", "image"):
            w.flow(" " + attrs.get("value", "") + " ")
        kids = node.children
        if tag == "details" and "open" not in attrs:
            first = next((c for c in kids if isinstance(c, Node) and c.tag == "summary"), None)
            kids = [first] if first else []
        inner = 0
        if tag == "table":
            w.block(2)
            grids.append(Grid())
        elif tag == "tr" and grids:
            grids[-1].row()
        elif tag in CELLS and grids:
            writers.append(Writer())
        elif tag in BLOCK:
            nested = tag in LISTS and bool(counters)
            w.block(2 if tag in SPACED and not nested else 1)
            if tag in LISTS:
                counters.append([_number(attrs.get("start"), 1, -(10**9), 10**9), -1 if "reversed" in attrs else 1] if tag == "ol" else None)
            elif tag == "li":
                count = counters[-1] if counters else None
                if count is None:
                    mark = "* "
                else:
                    count[0] = _number(attrs.get("value"), count[0], -(10**9), 10**9)
                    mark = f"{count[0]}. "
                    count[0] += count[1]
                w.indent(" " * len(mark))
                w.marker = mark
                inner = 1
            elif tag in ("blockquote", "dd"):
                w.indent("    ")
                inner = 1
        if tag in ("pre", "textarea", "xmp"):
            pre += 1
        stack.append((node, iter(kids), shade, inner, own, above))
        return True

    def leave(node: Node, shade: int, inner: int) -> None:
        nonlocal dark, pre
        w, tag = writers[-1], node.tag
        if tag in ("pre", "textarea", "xmp"):
            pre -= 1
        if tag in CELLS and grids and len(writers) > 1:
            lines = writers.pop().done()
            grids[-1].cell(node.attrs, lines)
        elif tag == "table":
            w.rows(grids.pop().lines())
            w.block(2)
        elif tag in BLOCK:
            if tag in LISTS:
                counters.pop()
            nested = tag in LISTS and bool(counters)
            w.block(2 if tag in SPACED and not nested else 1)
            if inner:
                w.indents.pop()
                w.marker = "" if tag == "li" else w.marker
        elif tag == "q" and not dark:
            w.word("”")
        dark -= shade

    enter(root)
    while stack:
        node, kids, shade, inner = stack[-1][:4]
        for child in kids:
            if isinstance(child, Node):
                if enter(child):
                    break
            elif not dark:
                writers[-1].verbatim(child) if pre else writers[-1].flow(child)
        else:
            stack.pop()
            leave(node, shade, inner)
    return "\n".join(writers[0].done())


def page_text(html: str | None) -> str:
    if not isinstance(html, str) or not html:
        return ""
    root, sheets = parse(html)
    return render(root, styles(tuple(sheets)))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with text."""

    @F.pandas_udf("string")
    def texts(html: pd.Series) -> pd.Series:
        return pd.Series([page_text(h) for h in html], dtype=object)

    return bounded_batches(pages).withColumn("text", texts("html"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "html")).drop("html")
