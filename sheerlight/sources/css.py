"""Which elements hide their text by style: a subset of the cascade, and the hiding techniques.

Handled: style attributes and <style> sheets with type, class, id, attribute, descendant and child selectors, specificity, order and
``!important``; inheritance of colour, font size and text indent; px, pt, em, rem and % font sizes, px, pt, em and rem lengths; named, hex, rgb()
and rgba() colours; translate, scale, matrix and matrix3d.  No layout: lengths in % and ``auto`` are unknown.  At-rules and pseudo-classes
are skipped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from ..functions import values as V
from .dom import Node, body_of, parent_or_host, scope

#: What decides a reason; the rest of a sheet is dropped while it is read.
PROPERTIES = frozenset("font-size opacity position left top text-indent transform clip-path clip color background background-color".split())
NAMED = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "lime": (0, 255, 0), "blue": (0, 0, 255), "green": (0, 128, 0), "yellow": (255, 255, 0), "gray": (128, 128, 128),
    "grey": (128, 128, 128), "silver": (192, 192, 192), "maroon": (128, 0, 0), "navy": (0, 0, 128), "orange": (255, 165, 0), "purple": (128, 0, 128), "teal": (0, 128, 128), "aqua": (0, 255, 255),
    "cyan": (0, 255, 255), "fuchsia": (255, 0, 255), "magenta": (255, 0, 255), "olive": (128, 128, 0), "whitesmoke": (245, 245, 245), "snow": (255, 250, 250), "ivory": (255, 255, 240),
    "lightgray": (211, 211, 211), "lightgrey": (211, 211, 211), "darkgray": (169, 169, 169), "darkgrey": (169, 169, 169), "dimgray": (105, 105, 105), "ghostwhite": (248, 248, 255),
}
SIZES = {"xx-small": 9.0, "x-small": 10.0, "small": 13.0, "medium": 16.0, "large": 18.0, "x-large": 24.0, "xx-large": 32.0}
TRANSPARENT = "rgba(0, 0, 0, 0)"
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?"


def declarations(text: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of a declaration block."""
    out = []
    for part in re.split(r";(?![^(]*\))", re.sub(r"/\*.*?\*/", "", text, flags=re.S)):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in PROPERTIES:
            value = value.strip()
            strong = re.search(r"!\s*important\s*$", value, re.I)
            value = (value[: strong.start()] if strong else value).strip().lower()
            if name == "background":
                found = [c for c in re.findall(r"(?:rgba?\([^)]*\)|#[0-9a-f]{3,8}\b|[a-z]+)", value) if colour(c)]
                name, value = "background-color", found[0] if found else "transparent"
            if value:
                out.append((name, value, bool(strong)))
    return out


_SIMPLE = re.compile(r"""(\*|[a-zA-Z][\w-]*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""")


class Selector:
    """Compound parts from the last to the first, each with how it is tied to the one after it."""

    def __init__(self, text: str):
        self.parts: list[tuple[str, list[Callable[[Node], bool]]]] = []
        counts = [0, 0, 0]
        tie = " "
        tokens = re.findall(r"\s*>\s*|\s+|(?:\[[^\]]*\]|[^\s>\[])+", text.strip())
        for t in tokens:
            if not t.strip() or t.strip() == ">":
                tie = t.strip() or " "
                continue
            tests, at = [], 0
            while at < len(t):
                m = _SIMPLE.match(t, at)
                if not m:
                    raise ValueError(t)
                at = m.end()
                tests.append(self._test(m, counts))
            self.parts.append((tie, tests))
            tie = " "
        if not self.parts:
            raise ValueError(text)
        self.weight = tuple(counts)
        last = [m for m in _SIMPLE.finditer(tokens[-1])] if tokens[-1].strip() not in ("", ">") else []
        #: What an element must have to match: an id, a class or a tag; the last one told is as good as any.
        self.needs = next((f"#{m[2]}" if m[2] else f".{m[3]}" if m[3] else m[1].lower() for m in last if m[2] or m[3] or (m[1] and m[1] != "*")), "")

    @staticmethod
    def _test(m: re.Match[str], counts: list[int]) -> Callable[[Node], bool]:
        kind, ident, cls, attr, op = m[1], m[2], m[3], m[4], m[5]
        if kind:
            counts[2] += kind != "*"
            return lambda e: kind == "*" or e.tag == kind.lower()
        if ident:
            counts[0] += 1
            return lambda e: e.attrs.get("id") == ident
        counts[1] += 1
        if cls:
            return lambda e: cls in e.attrs.get("class", "").split()
        want = next((x for x in (m[6], m[7], m[8]) if x is not None), "")
        name = attr.lower()
        checks: dict[str | None, Callable[[str], bool]] = {
            None: lambda v: True, "=": lambda v: v == want, "~=": lambda v: want in v.split(), "^=": lambda v: bool(want) and v.startswith(want),
            "$=": lambda v: bool(want) and v.endswith(want), "*=": lambda v: bool(want) and want in v, "|=": lambda v: v == want or v.startswith(want + "-"),
        }
        check = checks[op]
        return lambda e: name in e.attrs and check(e.attrs[name])

    def matches(self, e: Node) -> bool:
        """Part by part from the last on, with the places of the chain above ``e`` that can hold the part; steps are parts times depth at most."""
        if not all(t(e) for t in self.parts[-1][1]):
            return False
        chain: list[Node] = []
        while e is not None and e.kind == "element" and len(self.parts) > 1:
            chain.append(e)
            e = e.parent
        at = [0]
        for k in range(len(self.parts) - 2, -1, -1):
            near = [x + 1 for x in at] if self.parts[k + 1][0] == ">" else range(at[0] + 1, len(chain))
            at = [x for x in near if x < len(chain) and all(t(chain[x]) for t in self.parts[k][1])]
            if not at:
                return False
        return True


def rules(sheet: str) -> list[tuple[Selector, list[tuple[str, str, bool]]]]:
    sheet = re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)
    out, at = [], 0
    while (brace := sheet.find("{", at)) >= 0:
        head = sheet[at:brace].strip()
        if head.startswith("@"):  # skip the block, however deep
            depth, at = 1, brace + 1
            while at < len(sheet) and depth:
                depth += {"{": 1, "}": -1}.get(sheet[at], 0)
                at += 1
            continue
        end = sheet.find("}", brace)
        end = len(sheet) if end < 0 else end
        found = declarations(sheet[brace + 1 : end])
        if found:
            for s in head.split(","):
                try:
                    out.append((Selector(s), found))
                except ValueError:
                    continue
        at = end + 1
    return out


def colour(value: str) -> str | None:
    """A computed colour, as a browser writes it; null for what is none."""
    v = value.strip().lower()
    if v == "transparent":
        return TRANSPARENT
    if v in NAMED:
        return "rgb({}, {}, {})".format(*NAMED[v])
    if m := re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", v):
        h = m[1] if len(m[1]) > 4 else "".join(c * 2 for c in m[1])
        parts = [int(h[i : i + 2], 16) for i in range(0, len(h), 2)]
    elif m := re.fullmatch(rf"rgba?\(\s*({_NUMBER}%?)[\s,]+({_NUMBER}%?)[\s,]+({_NUMBER}%?)(?:[\s,/]+({_NUMBER}%?))?\s*\)", v):
        level = lambda x: max(0, min(255, round(min(1e6, max(-1e6, float(x[:-1]) * 2.55 if x.endswith("%") else float(x))))))
        parts = [level(m[i]) for i in (1, 2, 3)]
        if m[4]:
            parts.append(float(m[4][:-1]) / 100 if m[4].endswith("%") else float(m[4]))
            parts[3] *= 255
    else:
        return None
    if len(parts) == 3 or parts[3] >= 255:
        return "rgb({}, {}, {})".format(*parts[:3])
    return "rgba({}, {}, {}, {:g})".format(*parts[:3], round(parts[3] / 255, 3))


def transparent(value: str | None) -> bool:
    """Nothing, or black without any opacity in either notation."""
    return not value or bool(re.fullmatch(r"rgba\(0,0,0,0(\.0+)?\)|rgba?\(000/0(\.0+)?\)|transparent", re.sub(r"\s+", "", value).lower()))


def luminance(value: str) -> float:
    n = [int(x) for x in re.findall(r"\d+", value)]
    return 0.299 * n[0] + 0.587 * n[1] + 0.114 * n[2] if len(n) >= 3 else 0.0


def length(value: str | None, font: float) -> float:
    """Pixels; not a number where they can't be known."""
    m = re.fullmatch(rf"({_NUMBER})(px|pt|em|rem|)", value or "")
    if not m or (not m[2] and float(m[1])):
        return math.nan
    return float(m[1]) * {"px": 1.0, "": 1.0, "pt": 4 / 3, "em": font, "rem": 16.0}[m[2]]


def matrix(value: str | None) -> tuple[float, float, float, float] | None:
    """(scale x, scale y, translate x, translate y) of a transform."""
    if not value or value == "none":
        return None
    a, d, e, f = 1.0, 1.0, 0.0, 0.0
    for name, args in re.findall(r"([a-z0-9]+)\(([^)]*)\)", value):
        raw = [x for x in re.split(r"[\s,]+", args.strip()) if x]
        if name.startswith(("translate", "matrix")):
            n = [length(x, 16.0) if name.startswith("translate") else float(x) if re.fullmatch(_NUMBER, x) else math.nan for x in raw]
        else:
            n = [float(x) if re.fullmatch(_NUMBER, x) else math.nan for x in raw]
        if not n:
            continue
        x, y = n[0], n[1] if len(n) > 1 else None
        if name in ("translate", "translate3d"):
            e, f = e + a * x, f + d * (y or 0.0)
        elif name == "translatex":
            e += a * x
        elif name == "translatey":
            f += d * x
        elif name in ("scale", "scale3d"):
            a, d = a * x, d * (x if y is None else y)
        elif name == "scalex":
            a *= x
        elif name == "scaley":
            d *= x
        elif name == "matrix" and len(n) == 6:
            a, d, e, f = n[0], n[3], n[4], n[5]
        elif name == "matrix3d" and len(n) == 16:
            a, d, e, f = n[0], n[5], n[12], n[13]
    return a, d, e, f


def pixels(x: float) -> str:
    return f"{x:g}px"


class Sheet:
    """The rules of a root's sheets by what an element needs to match them."""

    def __init__(self, root: Node):
        self.by: dict[str, list[tuple[int, Selector, list[tuple[str, str, bool]]]]] = {}
        for order, (s, ds) in enumerate(r for e in root.elements() if e.tag == "style" for r in rules("".join(c.text for c in e.children))):
            self.by.setdefault(s.needs, []).append((order, s, ds))

    def declared(self, e: Node) -> dict[str, tuple[str, bool]]:
        """property: (value, whether it can't be overridden from the style attribute)."""
        found = []
        if self.by:
            names = {"", e.tag, f"#{e.attrs.get('id', '')}", *(f".{c}" for c in e.attrs.get("class", "").split())}
            for order, s, ds in (r for n in names for r in self.by.get(n, ())):
                if s.matches(e):
                    found += [((strong, 0, s.weight, order), n, v, strong) for n, v, strong in ds]
        if style := e.attrs.get("style"):
            found += [((strong, 1, (0, 0, 0), i), n, v, strong) for i, (n, v, strong) in enumerate(declarations(style))]
        return {n: (v, strong and key[1] == 0) for key, n, v, strong in sorted(found, key=lambda x: x[0])}


def style_records(found: list[Node], numbers: dict[int, int]) -> list[list]:
    """What decides which elements of a page hide their texts, without the page; nothing if no style is declared.

    Records [root, element, place of the parent (or host) among the records or -1, declared styles, own text, whether marked for
    screen readers, place of the document's first element].  Elements that declare nothing and have no text of their own are
    left out, but for a document's first two.
    """
    out: list[list] = []
    place: dict[int, int] = {}
    first: dict[int, int] = {}
    any_style = False
    for k, r in enumerate(found):
        if r.kind == "outside":
            continue
        sheet = Sheet(r)
        if r.kind == "document":
            document = len(out)
            chain = [r.children[0], body_of(r)]
        else:
            document = first[id(_root_of(r.host))]
            chain = []
        first[id(r)] = document
        for e in [*chain, *scope(r).elements()]:
            own = sheet.declared(e)
            text = "" if e.tag.upper() in V.SKIP_TAGS or e in chain else direct_text(e)
            if own or text or e in chain:
                p = parent_or_host(e)
                while p is not None and id(p) not in place:
                    p = parent_or_host(p)
                place[id(e)] = len(out)
                any_style |= bool(own)
                out.append([k, numbers.get(id(e), -1), -1 if p is None else place[id(p)], own, text, a11y_hidden(e), document])
    return out if any_style else []


def _root_of(e: Node) -> Node:
    while e.parent is not None:
        e = e.parent
    return e


class Styles:
    """Styles of a page's elements, and what hides each one's text, in document order; elements are places of ``style_records``.

    An element whose text had a finding is made visible before styles are looked at, and one that hides its text right after;
    so an element below, which would only inherit the trick, is not told again.
    """

    def __init__(self, records: list[list]):
        self.up = [r[2] for r in records]
        self.declared = [r[3] for r in records]
        self.document = [r[6] for r in records]
        self.forced: dict[int, dict[str, str]] = {}
        self.fonts: dict[int, float] = {}

    def value(self, e: int, name: str) -> str | None:
        forced = self.forced.get(e, {}).get(name)
        own = self.declared[e].get(name)
        if forced is not None and not (own and own[1]):
            return forced
        return own[0] if own else None

    def font(self, e: int) -> float:
        chain = []
        p = e
        while p >= 0 and p not in self.fonts:
            chain.append(p)
            p = self.up[p]
        size = self.fonts[p] if p >= 0 else 16.0
        for x in reversed(chain):
            v = self.value(x, "font-size")
            if v in SIZES:
                size = SIZES[v]
            elif v and (m := re.fullmatch(rf"({_NUMBER})%", v)):
                size *= float(m[1]) / 100
            elif v and not math.isnan(n := length(v, size)):
                size = n
            self.fonts[x] = size
        return size

    def inherited(self, e: int, name: str) -> str | None:
        while e >= 0:
            v = self.value(e, name)
            if v and v != "inherit":
                return v
            e = self.up[e]
        return None

    def background(self, e: int) -> str | None:
        """The colour behind an element's text: its own, the nearest one above, the body's or the page's; never a guess."""
        of = lambda x: colour(self.value(x, "background-color") or "") or TRANSPARENT
        html = self.document[e]
        found = of(e)
        p = self.up[e]
        while transparent(found) and p >= 0 and p != html:
            found = of(p)
            p = self.up[p]
        for x in (html + 1, html):
            if transparent(found):
                found = of(x)
        return None if transparent(found) else found

    def reasons(self, e: int) -> list[str]:
        out = []
        font = self.font(e)
        if font <= 1:
            out.append("font-size " + pixels(font))
        opacity = re.match(_NUMBER, self.value(e, "opacity") or "")
        if opacity and float(opacity[0]) == 0:
            out.append("opacity:0")
        if self._far(e, font):
            out.append("off-screen position")
        if length(self.inherited(e, "text-indent"), font) < -1000:
            out.append("negative text-indent")
        m = matrix(self.value(e, "transform"))
        if m:
            if m[2] < -9000 or m[3] < -9000:
                out.append("transform off-screen")
            if m[0] == 0 or m[1] == 0:
                out.append("transform scale(0)")
        if re.match(r"circle\(\s*0(px|%)?\s*(at|\))|inset\(\s*(50%|100%)", self.value(e, "clip-path") or ""):
            out.append("clip-path hides content")
        if re.match(r"rect\(\s*0(px)?\b", self.value(e, "clip") or ""):
            out.append("clip hides content")
        behind = self.background(e)
        if behind and abs(luminance(colour(self.inherited(e, "color") or "") or "rgb(0, 0, 0)") - luminance(behind)) < 30:
            out.append("text color = background")
        return out

    def _far(self, e: int, font: float) -> bool:
        return self.value(e, "position") == "absolute" and (length(self.value(e, "left"), font) < -1000 or length(self.value(e, "top"), font) < -1000)

    def reveal(self, e: int) -> None:
        font = self.font(e)
        new: dict[str, str] = {}
        if font <= 1:
            new["font-size"] = "16px"
        opacity = re.match(_NUMBER, self.value(e, "opacity") or "")
        if opacity and float(opacity[0]) == 0:
            new["opacity"] = "0.5"
        if self._far(e, font):
            new |= {"position": "static", "left": "auto", "top": "auto"}
        if length(self.inherited(e, "text-indent"), font) < -1000:
            new["text-indent"] = "0"
        if new:
            self.forced.setdefault(e, {}).update(new)
            self.fonts.clear()


def a11y_hidden(e: Node) -> bool:
    return e.attrs.get("aria-hidden") == "true" or bool(set(e.attrs.get("class", "").split()) & set(V.A11Y_CLASSES))


def direct_text(e: Node) -> str:
    return trim("".join(c.text for c in e.children if c.kind == "text"))


_SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(chr(0x2000 + i) for i in range(11)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(s: str) -> str:
    return s.strip(_SPACE)


def hidden_elements(records: list[list], hits: set[int], mask_revealed: bool = True) -> list[tuple[int, int, list[str], bool, str]]:
    """(root, element, reasons, whether marked for screen readers, its own text), root by root in document order.

    ``hits`` are the elements whose texts had findings.
    """
    styles = Styles(records)
    out = []
    by_root: dict[int, list[int]] = {}
    for i, r in enumerate(records):
        by_root.setdefault(r[0], []).append(i)
    for mine in by_root.values():
        if mask_revealed:
            for i in mine:
                if records[i][1] in hits:
                    styles.reveal(i)
        for i in mine:
            root, element, _, _, text, a11y, _ = records[i]
            if text and (why := styles.reasons(i)):
                out.append((root, element, why, a11y, text))
                if mask_revealed:
                    styles.reveal(i)
    return out
