"""Layout of one Markdown document: regions, sections, heading and caption numbers, contents lists, heading styles.

The writer and the text that a package is held to both take their numbers from here;
``ordered`` has the same rules as windows over tables of blocks.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from ..functions import vocab as V
from ..sources import markdown as M

_CAPTION = re.compile(r"(Table|Figure):(?:[ \t]+|$)")
_RANK = {name: i for i, name in enumerate(V.REGIONS)}


@dataclass
class Item:
    """A top-level block as it is placed."""

    block: M.Block
    region: str | None = None
    starts_section: bool = False
    number: str = ""
    caption: str = ""
    #: A caption's label, the number of its chapter or appendix, and its own.
    parts: tuple[str, str, str] = ("", "", "")
    inlines: list = field(default_factory=list)

    def text(self) -> str:
        return self.number + M.inline_text(self.inlines)


@dataclass
class Layout:
    items: list[Item] = field(default_factory=list)
    sectioned: bool = False
    #: (line, what is said about it) in the order found.
    warnings: list[tuple[int, str]] = field(default_factory=list)

    def entries(self, of: str) -> list[tuple[int, str]]:
        """(level, one-line text) of a contents list, a list of tables or one of figures."""
        if of == "toc":
            found = [(i.block.level, i.text()) for i in self.items if i.block.type == "heading" and i.block.level <= 3]
        else:
            found = [(1, i.text()) for i in self.items if i.caption == {"list-of-tables": "Table", "list-of-figures": "Figure"}[of]]
        return [(level, text.replace("\n", " ")) for level, text in found]


def counted(n: int, kind: str, thai: bool = False) -> str:
    """A number of 1 or more in a counting style."""
    if kind == "decimal":
        return str(n).translate(str.maketrans("0123456789", V.THAI_DIGITS)) if thai else str(n)
    if kind in ("lower-roman", "upper-roman"):
        out = ""
        for value, letters in V.ROMAN:
            out, n = out + letters * (n // value), n % value
        return out.lower() if kind == "lower-roman" else out
    alphabet = V.THAI_LETTERS if kind == "thai-letters" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    times, at = divmod(n - 1, len(alphabet))
    return alphabet[at] * (times + 1)


def image_only(b: M.Block) -> bool:
    if b.type != "paragraph":
        return False
    shown = [n for n in b.inlines if not (n["t"] == "text" and not n["s"].strip())]
    return bool(shown) and all(n["t"] == "image" for n in shown)


def _caption_kind(before: M.Block | None, b: M.Block, after: M.Block | None) -> str:
    first = b.inlines[0] if b.type == "paragraph" and b.inlines else None
    said = _CAPTION.match(first["s"]) if first and first["t"] == "text" else None
    if said and said[1] == "Table":
        return "Table" if after is not None and after.type == "table" else ""
    return "Figure" if said and before is not None and image_only(before) else ""


# --- Fixed values: the Thai words for tables and figures -------------------------------
THAI_CAPTIONS = {"Table": ("ตาราง:", "ตารางที่:"), "Figure": ("รูป:", "รูปที่:", "ภาพ:", "ภาพที่:")}


def _silent_pictures(b: M.Block) -> list[str]:
    nodes = b.inlines if b.type in ("paragraph", "heading") else ()
    return [f"the image '{n['src']}' has no text between the brackets of ![]; a reader who cannot see it is told nothing" for n in nodes if n["t"] == "image" and not n["alt"].strip()]


def _gap(level: int, above: int) -> str:
    return f"a heading of level {level} follows one of level {above}; the contents and a screen reader read the levels in order"


def _opening(nodes: list[dict]) -> str:
    """The plain text that inline nodes start with."""
    first = nodes[0] if nodes else None
    return first["s"] if first and first["t"] == "text" and not any(first.get(k) for k in ("b", "i", "strike", "code", "link", "u", "sup", "sub")) else ""


def _missed_caption(before: M.Block | None, b: M.Block, after: M.Block | None, caption: str) -> list[str]:
    """What comes near to being a caption and is none."""
    out = []
    table_next, picture_before = after is not None and after.type == "table", before is not None and image_only(before)
    if b.type == "paragraph":
        opening = _opening(b.inlines)
        said = _CAPTION.match(opening)
        if said and said[1] == "Table" and not table_next:
            out.append("'Table:' makes a caption only in the paragraph just before a table; kept as text")
        if said and said[1] == "Figure" and not picture_before:
            out.append("'Figure:' makes a caption only in the paragraph just after an image on its own; kept as text")
        at = max((i for i, n in enumerate(b.inlines) if n["t"] == "image"), default=None)
        if at is not None:
            shown = [n for n in b.inlines if n["t"] != "hardbreak" and not (n["t"] == "text" and not n["s"].strip(" \t"))]
            run = [n["t"] == "image" for n in shown]
            pictures = run.index(False) if False in run else len(run)
            if pictures and re.match(r"[ \t]*Figure:(?:[ \t]|\Z)", _opening(shown[pictures:])):
                out.append("'Figure:' shares a paragraph with the image above it; leave a blank line between them to make a caption")
        if not caption:
            for kind, here in (("Table", table_next), ("Figure", picture_before)):
                if here and any(re.match(re.escape(word) + r"(?:[ \t]|\Z)", opening) for word in THAI_CAPTIONS[kind]):
                    out.append(f"a caption is written '{kind}:' in English, in every language; this paragraph is kept as text")
    elif b.type == "table" and len(b.inlines) > 1:
        first, rest = b.inlines[-1][0], b.inlines[-1][1:]
        if (said := _CAPTION.match(_opening(first))) and said[1] == "Table" and not any(rest):
            out.append("the table's last row starts with 'Table:'; a caption goes before the table, on its own line")
    return out


def check_regions(blocks: list[M.Block]) -> None:
    """Refuses regions out of order or given twice; a second ``back`` may follow the appendices."""
    last, seen = -1, set()
    for b in blocks:
        if b.type == "directive" and b.name in _RANK:
            place = len(_RANK) if b.name == "back" and "appendices" in seen else _RANK[b.name]
            name = (b.name, place)
            if name in seen:
                raise M.Refused(b.line, f"<!-- {b.name} --> stands here a second time")
            if place < last:
                raise M.Refused(b.line, f"<!-- {b.name} --> is out of order; regions come as {', '.join(V.REGIONS)}, back")
            seen |= {name, b.name}
            last = place


def lay_out(doc: M.Document, o) -> Layout:
    """Every block with its region, section, number and caption; raises markdown.Refused."""
    check_regions(doc.blocks)
    blocks = doc.blocks
    out = Layout(sectioned=any(b.type == "directive" and b.name in _RANK for b in blocks))
    region, boundary = "cover" if out.sectioned else None, False
    counters, places, seqs = [0] * 6, {"chapters": 0, "appendices": 0}, {"Table": 0, "Figure": 0}
    shown = lambda n: counted(n, "decimal", o.thai_digits)
    level = 0
    for i, b in enumerate(blocks):
        if b.type == "directive" and b.name in _RANK:
            region, boundary = b.name, True
            continue
        item = Item(b, region, inlines=b.inlines)
        top = out.sectioned and b.type == "heading" and b.level == 1
        item.starts_section = bool(out.items) and (boundary or top) and out.sectioned
        boundary = False
        if top:
            seqs = dict.fromkeys(seqs, 0)
            if region in places:
                places[region] += 1
        prefix = ""
        if region == "chapters" and places[region]:
            prefix = shown(places[region])
        elif region == "appendices" and places[region]:
            prefix = counted(places[region], o.appendix_numbers, o.thai_digits)
        if b.type == "heading":
            counters[b.level - 1] += 1
            counters[b.level :] = [0] * (6 - b.level)
            if top and prefix:
                label = o.chapter_label if region == "chapters" else o.appendix_label
                item.number = f"{label} {prefix}" + ("\n" if o.chapter_title_on_new_line else " ")
            elif o.heading_numbers and not out.sectioned:
                digits = [shown(n) for n in counters[: b.level]]
                item.number = (digits[0] + "." if b.level == 1 else ".".join(digits)) + " "
            elif o.heading_numbers and prefix and not top:
                item.number = ".".join([prefix, *(shown(n) for n in counters[1 : b.level])]) + " "
        before, after = blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None
        item.caption = _caption_kind(before, b, after)
        out.warnings += [(b.line, message) for message in (*_silent_pictures(b), *([_gap(b.level, level)] if b.type == "heading" and 0 < level < b.level - 1 else ()), *_missed_caption(before, b, after, item.caption))]
        level = b.level if b.type == "heading" else level
        if item.caption:
            seqs[item.caption] += 1
            label = o.table_label if item.caption == "Table" else o.figure_label
            item.parts = (label, prefix, shown(seqs[item.caption]))
            item.number = f"{label} " + "-".join(filter(None, item.parts[1:])) + " "
            first = b.inlines[0]
            item.inlines = [first | {"s": _CAPTION.sub("", first["s"], count=1)}, *b.inlines[1:]]
        out.items.append(item)
    return out


# -- heading styles of the front matter ----------------------------------------------------

# --- Fixed values: alignments, underlines, units in twips and the longest length --------
ALIGN = {"left": "left", "center": "center", "right": "right", "justify": "both", "thai-distribute": "thaiDistribute"}
UNDERLINE = {"solid": "single", "double": "double", "dotted": "dotted", "dashed": "dash", "wavy": "wave", "thick": "thick"}
UNITS = {"in": 1440, "cm": 1440 / 2.54, "pt": 20}
MAX_LENGTH = 14_400


def _twips(value: str, signed: bool) -> int | None:
    m = re.fullmatch(r"(-?)([0-9]+(?:\.[0-9]+)?)(in|cm|pt)", "0pt" if value == "0" else value)
    if m is None or (m[1] and not signed):
        return None
    n = math.floor(float(m[2]) * UNITS[m[3]] + 0.5)
    return None if n > MAX_LENGTH else -n if m[1] else n


def _points(value: str) -> float | None:
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)pt", value)
    return float(m[1]) if m and 1 <= float(m[1]) <= 400 else None


def _family(value: str) -> str | None:
    name = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return name.strip()[: V.FONT_MAX].rstrip() if 0 < len(name) <= 64 and name.strip() and '"' not in name else None


def _decoration(value: str) -> dict | None:
    words = value.split()
    if words == ["none"]:
        return {"u": None, "strike": False}
    styles = [w for w in words if w in UNDERLINE]
    lines = [w for w in words if w in ("underline", "line-through")]
    if not lines or len(words) != len(styles) + len(lines) or len(styles) > 1 or len(set(lines)) != len(lines) or styles and "underline" not in lines:
        return None
    return {"u": UNDERLINE[styles[0] if styles else "solid"] if "underline" in lines else None, "strike": "line-through" in lines}


def _spacing(value: str) -> float | None:
    return float(value) if re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", value) and 0.5 <= float(value) <= 3 else None


#: Each property: how its value is read (None: refused).
PROPERTIES = {
    "font-family": _family, "font-size": _points, "color": lambda v: v[1:].upper() if re.fullmatch(r"#[0-9A-Fa-f]{6}", v) else None,
    "font-weight": {"bold": True, "normal": False}.get, "font-style": {"italic": True, "normal": False}.get, "text-decoration": _decoration, "text-align": ALIGN.get,
    "margin-left": lambda v: _twips(v, False), "text-indent": lambda v: _twips(v, True), "margin-top": lambda v: _twips(v, False), "margin-bottom": lambda v: _twips(v, False),
    "line-height": _spacing, "page-break-before": {"always": True, "auto": False}.get,
}


def heading_styles(front: dict[str, str]) -> dict[int, dict]:
    """Level to properties, from the front matter's heading-1 to heading-6; raises markdown.Refused."""
    out: dict[int, dict] = {}
    for key, value in front.items():
        m = re.fullmatch(r"heading-([1-6])", key)
        if m is None:
            continue
        parts = re.findall(r'(?:"[^"]*"|[^";])+', value)
        if value.count('"') % 2:
            raise M.Refused(1, f"{key}: a double quote is not closed")
        props = out.setdefault(int(m[1]), {})
        for part in filter(None, (p.strip(" \t") for p in parts)):
            name, colon, given = (x.strip(" \t") for x in part.partition(":"))
            if not colon or name not in PROPERTIES:
                raise M.Refused(1, f"{key}: '{part[: V.QUOTED_MAX]}' is not a property: value pair")
            read = PROPERTIES[name](given)
            if read is None:
                raise M.Refused(1, f"{key}: {name} doesn't take '{given[: V.QUOTED_MAX]}'")
            props[name] = read
    return out
