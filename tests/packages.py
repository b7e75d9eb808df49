"""Small packages made from a table of parts, to plant faults in."""

from loomleaf.functions import vocab as V
from loomleaf.sources.packages import write_package

FONT, TITLE, ITEM, LAST = "Garuda", "แดดและฝน", "ข้าวสวย", " ค่ำ"


def el(tag, *inside, **values):
    """An element of the word namespace with its attributes."""
    said = "".join(f' w:{k}="{v}"' for k, v in values.items())
    return f"<w:{tag}{said}>{''.join(inside)}</w:{tag}>" if inside else f"<w:{tag}{said}/>"


FONTS = el("rFonts", ascii=FONT, hAnsi=FONT, cs=FONT)
MARKED = el("cs") + el("lang", bidi="th-TH")
STRONG = el("b") + el("bCs")


def run(text, props=MARKED):
    return el("r", el("rPr", props), f'<w:t xml:space="preserve">{text}</w:t>')


def paragraph(*inside, **props):
    return el("p", el("pPr", *props.values()) if props else "", *inside)


#: Each part of a package: its name, the relationship that leads to it, and its root element with what is in it.
PARTS = (
    ("word/document.xml", "officeDocument", "document", lambda: el(
        "body", paragraph(run(TITLE), style=el("pStyle", val="Heading1")), paragraph(run("เช้า "), run("สาย", STRONG + MARKED), run(LAST)),
        paragraph(run(ITEM), list=el("numPr", el("ilvl", val="0"), el("numId", val="1"))), el("sectPr", el("pgSz", w="11906", h="16838"), el("pgMar", top="1440")),
    )),
    ("word/styles.xml", "styles", "styles", lambda: el("docDefaults", el("rPrDefault", el("rPr", FONTS, el("sz", val="30"), el("szCs", val="30")))) + el(
        "style", el("name", val="heading 1"), el("pPr", el("keepNext")), el("rPr", STRONG), styleId="Heading1",
    )),
    ("word/settings.xml", "settings", "settings", lambda: el("compat", el("compatSetting", name="compatibilityMode", uri=V.COMPAT_URI, val="15"))),
    ("word/numbering.xml", "numbering", "numbering", lambda: el("abstractNum", el("lvl", el("start", val="1"), el("numFmt", val="decimal"), el("rPr", FONTS), ilvl="0"), abstractNumId="0") + el("num", el("abstractNumId", val="0"), numId="1")),
)


def declared(root):
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{root}'


def relations(*rows):
    inner = "".join(f'<Relationship Id="r{n}" Type="{V.RELATION_PREFIXES[0]}{kind}" Target="{target}"/>' for n, (kind, target) in enumerate(rows, 1))
    return declared(f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>')


def clean():
    (main, kind, _, _), *others = PARTS
    out = {
        "[Content_Types].xml": declared('<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'),
        "_rels/.rels": relations((kind, main)), "word/_rels/document.xml.rels": relations(*((k, name.partition("/")[2]) for name, k, _, _ in others)),
    }
    for name, _, root, inside in PARTS:
        out[name] = declared(f'<w:{root} xmlns:w="{V.W}" xmlns:r="{V.R}">{inside()}</w:{root}>')
    return out


def packed(parts):
    return write_package([(name, content.encode() if isinstance(content, str) else content) for name, content in parts.items()])


def planted(part, old, new):
    """The package with one thing replaced by another in a part."""
    parts = clean()
    if old not in parts[part]:
        raise AssertionError(f"{old} isn't in {part}")
    parts[part] = parts[part].replace(old, new, 1)
    return packed(parts)
