"""XML parts as a table of nodes, in document order, however deep they nest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from operator import itemgetter
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from ..workspace import SPARK_KINDS, bounded_batches, gathered

_TEXT, _INT = pa.string(), pa.int32()
_COLUMNS = {
    "doc": _TEXT, "part": _TEXT, "part_ord": _INT, "node": _INT, "parent": _INT, "sib": _INT, "depth": _INT, "ns": _TEXT, "local": _TEXT,
    "attrs": pa.map_(_TEXT, _TEXT), "text": _TEXT, "last": _INT, "run": _INT, "para": _INT, "in_history": pa.bool_(), "shape": _TEXT, "fault": _TEXT,
}
NODE_SCHEMA = ", ".join(f"{c} {SPARK_KINDS[k]}" for c, k in _COLUMNS.items())
_DECLARED = re.compile("﻿?<\\?xml[^>]*?[ \t\r\n]encoding[ \t\r\n]*=[ \t\r\n]*[\"']([^\"']*)[\"']")
STEP = 1 << 20  # bytes of a part that are parsed at a time
_BROKEN = "XML is not well-formed"
_HISTORY = ("rPrChange", "pPrChange")


def fault_of(data: bytes) -> str | None:
    """Why a part isn't read as UTF-8 XML text, or None."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return "XML part is not UTF-8"
    declared = _DECLARED.match(text)
    if b"\0" in data or declared and declared[1].lower() not in ("utf-8", "utf8"):
        return "XML part is not UTF-8"
    return None


def _reader() -> tuple[expat.XMLParserType, list[list]]:
    """A parser that turns events into nodes, and the list in which those that have ended wait."""
    count, shaping, stack, done = 0, 0, [], []
    names: dict[str, tuple[str, str]] = {}

    def start(name: str, attributes: dict) -> None:
        nonlocal count, shaping
        if name not in names:
            ns, _, local = name.rpartition("}")
            names[name] = ns, local
        ns, local = names[name]
        attrs = {f"{{{k}" if "}" in k else k: v for k, v in attributes.items()} if attributes else {}
        me = count
        count += 1
        if stack:
            above = stack[-1]
            up = above[0]
            node = [me, up[0], above[1], len(stack), ns, local, attrs, "", me, up[9], up[10], up[11] or up[5] in _HISTORY, None]
            above[1] += 1
        else:
            node = [me, None, 0, 0, ns, local, attrs, "", me, None, None, False, None]
        if local == "r":
            node[9] = me
        elif local == "p":
            node[10] = me
        elif local == "rPr":
            shaping += 1
        digest = None
        if shaping:
            digest = _said(local, attributes)
        stack.append([node, 0, digest])

    def end(_: str) -> None:
        nonlocal shaping
        node, _, digest = stack.pop()
        node[8] = count - 1
        if digest is not None:
            if node[5] == "rPr":
                node[12] = digest.hexdigest()
                shaping -= 1
            if stack and stack[-1][2] is not None:
                stack[-1][2].update(digest.digest())
        done.append(node)

    def text(data: str) -> None:
        if stack and not stack[-1][1]:
            stack[-1][0][7] += data

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    return parser, done


def ended_nodes(data: bytes, step: int = STEP) -> Iterator[list[list]]:
    """Lists of nodes as their elements end, a piece of the part at a time."""
    parser, done = _reader()
    for at in range(0, max(1, len(data)), step):
        parser.Parse(data[at : at + step], at + step >= len(data))
        if done:
            yield done[:]
            done.clear()


def shred(data: bytes) -> list[list]:
    """Nodes in pre-order: node, parent, sib, depth, ns, local, attrs, text, last, run, para, in_history, shape.

    ``attrs`` are keyed "{ns}local" or "local"; ``text`` is what stands before the
    first child; ``last`` is the last descendant; ``run`` and ``para`` are the nearest
    such element around; ``shape`` is equal for run properties that say the same, revision
    ids left out: a digest of the element made from those of its children.  Raises ExpatError for
    what is not well-formed.
    """
    if len(data) > STEP:
        return sorted((n for some in ended_nodes(data) for n in some), key=itemgetter(0))
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise expat.ExpatError(str(e)) from None
    return _nodes_below(root)


def _nodes_below(root: ElementTree.Element) -> list[list]:
    """The nodes of a small part, from the tree that the library makes of it without calling back for each element."""
    out: list[list] = []
    names: dict[str, tuple[str, str]] = {}
    above, shaping = [None, None, 0, -1, "", "", {}, "", 0, None, None, False, None], 0
    stack = [(above, iter(((0, root),)), None)]
    while stack:
        above, kids, digest = stack[-1]
        for sib, element in kids:
            tag = element.tag
            if tag not in names:
                ns, _, local = tag.rpartition("}")
                names[tag] = ns[1:], local
            ns, local = names[tag]
            me, attrs = len(out), element.attrib
            node = [me, above[0], sib, above[3] + 1, ns, local, attrs, element.text or "", me, above[9], above[10], above[11] or above[5] in _HISTORY, None]
            out.append(node)
            if local == "r":
                node[9] = me
            elif local == "p":
                node[10] = me
            elif local == "rPr":
                shaping += 1
            own = _said(local, attrs) if shaping else None
            if own is not None or len(element):
                stack.append((node, enumerate(element), own))
                break
        else:
            stack.pop()
            above[8] = len(out) - 1
            if digest is not None:
                if above[5] == "rPr":
                    above[12] = digest.hexdigest()
                    shaping -= 1
                if stack[-1][2] is not None:
                    stack[-1][2].update(digest.digest())
    return out


def _said(local: str, attributes: dict):
    """A digest begun with what an element says, revision ids left out."""
    said = sorted((k.rpartition("}")[2], v) for k, v in attributes.items()) if attributes else ()
    return blake2b(repr((local, [x for x in said if not x[0].startswith("rsid")])).encode(), digest_size=16)


def root_node(data: bytes) -> list:
    """The root as it is in ``shred``, without its text and what stands in it; the whole part is parsed, and ExpatError raised as there."""
    parser, found = expat.ParserCreate(namespace_separator="}"), []

    def start(name: str, attributes: dict) -> None:
        ns, _, local = name.rpartition("}")
        found.append([0, None, 0, 0, ns, local, {f"{{{k}" if "}" in k else k: v for k, v in attributes.items()}, "", 0, None, None, False, None])
        parser.StartElementHandler = None

    parser.StartElementHandler = start
    parser.Parse(data, True)
    return found[0]


def well_formed(data: bytes) -> bool:
    try:
        expat.ParserCreate(namespace_separator="}").Parse(data, True)
    except expat.ExpatError:
        return False
    return True


def xml_nodes(parts: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """The node table of the XML parts in ``parts`` (doc, ord, name, data); a part that can't be read is one row with ``fault``.

    A part larger than a step of the parser is parsed twice, first to know that it can be
    read, and its rows leave as its elements end.  ``only`` leaves the nodes of elements of
    these local names, each as it is among all.
    """
    bounded_batches(parts.sparkSession, 64)

    def rows(batches):
        for batch in batches:
            for doc, ord_, name, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                head, raw = (doc.as_py(), name.as_py(), ord_.as_py()), data.as_py()
                fault, some = fault_of(raw), ()
                if fault is None and len(raw) > STEP:
                    fault, some = None if well_formed(raw) else _BROKEN, ended_nodes(raw)
                elif fault is None:
                    try:
                        some = [shred(raw)]
                    except expat.ExpatError:
                        fault = _BROKEN
                if fault is not None:
                    yield (*head, *[None] * 13, fault)
                    continue
                for nodes in some:
                    for n in nodes:
                        if only is None or n[5] in only:
                            yield (*head, *n[:6], list(n[6].items()), *n[7:], None)

    kept = parts.filter("data is not null").select("doc", "ord", "name", "data")
    return kept.mapInArrow(lambda batches: gathered(rows(batches), _COLUMNS, _weight, 10_000), NODE_SCHEMA)


def _weight(row: tuple) -> int:
    """About the bytes of a node's attributes and text."""
    return len(row[10] or "") + sum(len(k) + len(v) for k, v in row[9] or ())
