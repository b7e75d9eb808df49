"""Repairing packages: parts as lossless element trees, edited and written into a new package.

The check's tables say which part plays which role and which rules a document
breaks; the trees of its parts are edited in Arrow batches; the result is checked
again.  A document is written only if its text is the same, no rule is broken that
was kept before (a difference of bags by code and part) and no repaired rule is
still broken.  A part with comments, CDATA or instructions is left as it came.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab as V
from ..sources.packages import admit, rewrite_package
from ..sources.xmlnodes import shred
from ..workspace import written
from .checks import Checked, check_packages, listed_findings
from .scripts import script_pieces
from .sets import bag_difference

MAX_NESTING = 100
UNREAD = ("package", "doctype", "size")
_TOKEN = re.compile(r"""<(/?)([^\s/>]+)((?:[^"'>]|"[^"]*"|'[^']*')*?)(/?)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)\s*=\s*("[^"]*"|'[^']*')""")
_NOT_MARKUP = re.compile(r"<!|<\?(?!xml[ \t\r\n])")
_REFERENCE = re.compile(r"&(?:#[xX]([0-9A-Fa-f]+)|#([0-9]+)|(\w+));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_HISTORY = ("w:rPrChange", "w:pPrChange")
_RPR = {n: i for i, n in enumerate((*V.ORDERS["rPr"][0], "rPrChange"))}
_SPACE = " \t\r\n"


@dataclass(eq=False)
class Element:
    """An element as its part writes it: the opening tag, what it holds, the closing tag."""

    name: str
    tag: str
    up: Element | None = None
    end: str = ""
    kids: list = field(default_factory=list)

    def get(self, attribute: str) -> str | None:
        return next((v[1:-1] for k, v in _ATTRIBUTE.findall(self.tag) if k == attribute), None)

    def put(self, attribute: str, value: str) -> None:
        held = next((m for m in _ATTRIBUTE.finditer(self.tag) if m[1] == attribute), None)
        said = '"' + value + '"'
        if held:
            self.tag = self.tag[: held.start(2)] + said + self.tag[held.end(2) :]
        else:
            at = len(self.tag) - (2 if self.tag.endswith("/>") else 1)
            self.tag = self.tag[:at].rstrip() + f" {attribute}={said}" + self.tag[at:]

    def elements(self) -> list[Element]:
        return [k for k in self.kids if isinstance(k, Element)]

    def child(self, name: str) -> Element | None:
        return next((k for k in self.elements() if k.name == name), None)

    def insert(self, at: int, kid: Element) -> Element:
        if not self.end:
            self.tag, self.end = self.tag[:-2].rstrip() + ">", f"</{self.name}>"
        kid.up = self
        self.kids.insert(at, kid)
        return kid

    def on(self) -> bool:
        return (self.get("w:val") or "") not in ("0", "false", "off")


@dataclass
class Part:
    """The tree of a part; ``head`` stands before its root and ``tail`` after it."""

    head: str
    root: Element
    tail: str
    deepest: int
    deepest_name: str

    def walk(self):
        """Elements in document order, those of tracked former properties left out."""
        stack = [self.root]
        while stack:
            e = stack.pop()
            yield e
            if e.name not in _HISTORY:
                stack.extend(reversed(e.elements()))

    def written(self) -> bytes:
        out, stack = [self.head], [self.root]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                out.append(e.tag)
                if e.end:
                    stack.append(e.end)
                    stack.extend(reversed(e.kids))
        return ("".join(out) + self.tail).encode()


def read_part(data: bytes) -> Part | None:
    """The tree of a well-formed part, or None for one that holds what is not markup."""
    text = data.decode("utf-8")
    if _NOT_MARKUP.search(text):
        return None
    at, head, tail, root, here = 0, "", "", None, None
    depths, deepest = Counter(), (0, "")
    for m in _TOKEN.finditer(text):
        if m[2].startswith("?"):
            continue
        between, at = text[at : m.start()], m.end()
        if root is None:
            head = between
        elif between:
            here.kids.append(between)
        if m[1]:
            depths[here.name] -= 1
            here.end, here = m[0], here.up
            if here is None:
                tail = text[at:]
                break
            continue
        e = Element(m[2], m[0], here)
        deepest = max(deepest, (depths[e.name] + 1, e.name))
        if here is not None:
            here.kids.append(e)
        root = root or e
        if not m[4]:
            depths[e.name] += 1
            here = e
        elif here is None:
            tail = text[at:]
            break
    return Part(head, root, tail, *deepest)


def foreign_prefix(data: bytes) -> bool:
    """Whether a tag of a part declares WordprocessingML under another prefix than ``w``, or ``w`` for something else."""
    for m in _TOKEN.finditer(data.decode("utf-8")):
        if "xmlns" in m[3]:
            for name, said in _ATTRIBUTE.findall(m[3]):
                if (name == "xmlns" or name.startswith("xmlns:")) and (said[1:-1] == V.W) != (name == "xmlns:w"):
                    return True
    return False


def plain(raw: str) -> str:
    """Character data with its references resolved."""
    return _REFERENCE.sub(lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2])) if m[2] else _NAMED.get(m[3], m[0]), raw)


def _complex(text: str) -> bool:
    return any(a <= ord(c) <= b for c in text for a, b in V.COMPLEX_SCRIPT)


def _raw_text(e: Element) -> str:
    return "".join(k for k in e.kids if isinstance(k, str))


def _drop(e: Element) -> None:
    e.up.kids.remove(e)


def _add_property(props: Element, name: str, tag: str) -> Element:
    """A run property at its place in the schema's order."""
    place = _RPR[name]
    at = next((i for i, k in enumerate(props.kids) if isinstance(k, Element) and _RPR.get(k.name.removeprefix("w:"), -1) > place), len(props.kids))
    return props.insert(at, Element("w:" + name, tag))


def pieces_of(raw: str) -> list[tuple[bool, str]]:
    """Raw character data cut where its script changes; invisible characters never make a cut."""
    units = re.findall(r"&\w+;|[^&]", raw)
    shown = [plain(u) for u in units]
    seen = "".join(c for c in shown if c not in V.INVISIBLE)
    scripts = iter([is_complex for is_complex, piece in script_pieces(seen) for _ in piece])
    out: list[tuple[bool, str]] = []
    waiting = ""
    for unit, char in zip(units, shown, strict=True):
        if char in V.INVISIBLE:
            if out:
                out[-1] = (out[-1][0], out[-1][1] + unit)
            else:
                waiting += unit
            continue
        script = next(scripts)
        if out and out[-1][0] == script:
            out[-1] = (script, out[-1][1] + unit)
        else:
            out.append((script, waiting + unit))
            waiting = ""
    return out


class Editor:
    """The edits of one document's parts; ``counts`` by code, and what was unmarked, split or given the language."""

    def __init__(self, font: str, thai_language: bool = False, mark_all: bool = False):
        self.font, self.thai_language, self.mark_all = font, thai_language, mark_all
        self.counts: Counter = Counter()
        self.font_written = False

    # 1: one compatibility mode
    def mode(self, part: Part) -> None:
        found = [e for e in part.walk() if e.name == "w:compatSetting" and e.get("w:name") == "compatibilityMode" and e.get("w:uri") == V.COMPAT_URI]
        if not found or (len(found) == 1 and found[0].get("w:val") == "15"):
            return
        found[0].put("w:val", "15")
        for e in found[1:]:
            _drop(e)
        self.counts["1"] += 1

    # 3: proofing
    def proofing(self, part: Part) -> None:
        for e in list(part.walk()):
            if e.name == "w:noProof" and e.on() and not self._is_code(e.up):
                _drop(e)
                self.counts["3"] += 1

    def _is_code(self, props: Element) -> bool:
        run = props.up
        return props.name == "w:rPr" and run is not None and run.name == "w:r" and not _complex(self._text(run))

    @staticmethod
    def _text(run: Element) -> str:
        return "".join(plain(_raw_text(t)) for t in run.elements() if t.name in ("w:t", "w:delText"))

    # order
    def order(self, part: Part) -> None:
        for e in list(part.walk()):
            name = e.name.removeprefix("w:")
            if name not in V.ORDERS or not e.name.startswith("w:"):
                continue
            places = V.PLACES[name]
            slots = [i for i, k in enumerate(e.kids) if isinstance(k, Element) and k.name.startswith("w:") and k.name[2:] in places]
            now = [e.kids[i] for i in slots]
            then = sorted(now, key=lambda k: places[k.name[2:]])
            if any(a is not b for a, b in zip(now, then, strict=True)):
                for i, k in zip(slots, then, strict=True):
                    e.kids[i] = k
                self.counts["order"] += 1

    # 5: twins and fonts
    def twins(self, props: Element) -> None:
        for one, twin in (("sz", "szCs"), ("b", "bCs"), ("i", "iCs")):
            held = props.child("w:" + one)
            if held is not None and props.child("w:" + twin) is None:
                value = held.get("w:val")
                _add_property(props, twin, f"<w:{twin}/>" if value is None else f'<w:{twin} w:val="{value}"/>')
                self.counts["5"] += 1
        fonts = props.child("w:rFonts")
        if fonts is not None and any(fonts.get("w:" + a) for a in ("ascii", "hAnsi", "asciiTheme", "hAnsiTheme")) and not (fonts.get("w:cs") or fonts.get("w:cstheme")):
            fonts.put("w:cs", self.font)
            self.font_written = True
            self.counts["5"] += 1

    def bullet(self, level: Element) -> None:
        form, props = level.child("w:numFmt"), level.child("w:rPr")
        fonts = props.child("w:rFonts") if props is not None else None
        if form is None or form.get("w:val") != "bullet" or fonts is None:
            return
        named = [k for k, v in _ATTRIBUTE.findall(fonts.tag) if v[1:-1] == "Symbol"]
        for k in named:
            fonts.put(k, self.font)
        self.font_written |= bool(named)
        self.counts["5"] += bool(named)

    # 2: the complex-script mark
    def mark(self, run: Element, wanted: bool) -> None:
        """Makes a run say whether its text is complex script; a right-to-left run says it already."""
        props = run.child("w:rPr")
        held = [k for k in props.elements() if k.name in ("w:cs", "w:rtl")] if props is not None else []
        if any(k.name == "w:rtl" and k.on() for k in held):
            return
        marks = [k for k in held if k.name == "w:cs"]
        if wanted:
            if props is None:
                props = run.insert(0, Element("w:rPr", "<w:rPr/>"))
            if not any(k.on() for k in marks):
                for k in marks:
                    _drop(k)
                _add_property(props, "cs", "<w:cs/>")
                self.counts["2"] += 1
            if self.thai_language:
                lang = props.child("w:lang")
                lang = _add_property(props, "lang", "<w:lang/>") if lang is None else lang
                if lang.get("w:bidi") != "th-TH":
                    lang.put("w:bidi", "th-TH")
                    self.counts["thai-language"] += 1
        elif any(k.on() for k in marks):
            for k in marks:
                _drop(k)
            self.counts["unmarked"] += 1

    def split(self, run: Element) -> list[Element]:
        """The runs that a plain run of both scripts becomes, or the run itself."""
        kids = [k for k in run.elements() if k.name != "w:rPr"]
        if len(kids) != 1 or kids[0].name != "w:t" or kids[0].elements() or run.elements()[-1] is not kids[0]:
            return [run]
        t = kids[0]
        raw = _raw_text(t)
        if "&#" in raw or (t.get("xml:space") != "preserve" and raw.strip(_SPACE) != raw):
            return [run]
        pieces = pieces_of(raw)
        if len(pieces) < 2:
            return [run]
        out = []
        for _, piece in pieces:
            new = Element(run.name, run.tag, run.up, run.end)
            if (props := run.child("w:rPr")) is not None:
                new.insert(0, _copy(props))
            text = new.insert(len(new.kids), Element(t.name, t.tag, None, t.end, [piece]))
            if piece.strip(_SPACE) != piece:
                text.put("xml:space", "preserve")
            out.append(new)
        at = run.up.kids.index(run)
        run.up.kids[at : at + 1] = out
        self.counts["split"] += 1
        return out

    def text(self, part: Part) -> None:
        for e in list(part.walk()):
            if e.name == "w:r":
                text = self._text(e)
                runs = self.split(e) if _complex(text) and not self.mark_all else [e]
                for run in runs:
                    if text:
                        self.mark(run, self.mark_all or _complex(self._text(run)))
                    if (props := run.child("w:rPr")) is not None:
                        self.twins(props)
            elif e.name == "w:p" and (ppr := e.child("w:pPr")) is not None and (props := ppr.child("w:rPr")) is not None:
                self.twins(props)

    def styles(self, part: Part) -> None:
        for e in list(part.walk()):
            if e.name == "w:rPr":
                marks = [k for k in e.elements() if k.name == "w:cs"]
                if not self.mark_all and any(k.on() for k in marks):
                    for k in marks:
                        _drop(k)
                    self.counts["unmarked"] += 1
                self.twins(e)

    def numbering(self, part: Part) -> None:
        for e in part.walk():
            if e.name == "w:lvl":
                self.bullet(e)
                if (props := e.child("w:rPr")) is not None:
                    self.twins(props)


def _copy(e: Element) -> Element:
    new = Element(e.name, e.tag, None, e.end)
    new.kids = [_copy(k) if isinstance(k, Element) else k for k in e.kids]
    for k in new.elements():
        k.up = new
    return new


def part_text(data: bytes) -> list[str]:
    """The text of every paragraph of a part; space at the ends of a text counts only where it is preserved."""
    texts: dict[int, list[str]] = {}
    for n in shred(data):
        if n[5] == "p":
            texts[n[0]] = []
        elif n[10] is not None and n[5] in ("t", "delText", "tab", "br"):
            kept = n[6].get("{http://www.w3.org/XML/1998/namespace}space") == "preserve"
            texts[n[10]].append((n[7] if kept else n[7].strip(_SPACE)) if n[5] in ("t", "delText") else "\t" if n[5] == "tab" else "\n")
    return ["".join(t) for t in texts.values()]


@dataclass(frozen=True)
class Outcome:
    """What the editing of one package gives; ``content`` is None where nothing is written."""

    content: bytes | None
    counts: dict[str, int]
    left: list[str]
    font_written: bool
    error: str | None


def edit_package(data: bytes, codes: set[str], roles: dict[str, list[str]], font: str, thai_language: bool = False, mark_all: bool = False) -> Outcome:
    """The edits that the broken rules ``codes`` ask for; ``roles``: part names by role."""
    parts = {e.name: content for e, content in admit(data)[0] if content is not None}
    no = lambda error: Outcome(None, {}, [], False, error)
    for name, content in parts.items():
        if name.endswith(".xml") and foreign_prefix(content):
            return no(f"{name} writes WordprocessingML under a prefix other than w:; nothing was written")
    named = {n for names in roles.values() for n in names}
    trees = {n: read_part(d) for n, d in parts.items() if n.endswith(".xml") or n in named}
    left = sorted(n for n, t in trees.items() if t is None)
    trees = {n: t for n, t in trees.items() if t is not None}
    for name in sorted(trees):
        if trees[name].deepest > MAX_NESTING:
            return no(f"{name} nests <{trees[name].deepest_name}> {trees[name].deepest} deep in itself; nothing was written")
    of = lambda role: [trees[n] for n in roles.get(role, ()) if n in trees]
    edit = Editor(font, thai_language, mark_all)
    for tree in of("settings") if "1" in codes else ():
        edit.mode(tree)
    for tree in trees.values() if "3" in codes else ():
        edit.proofing(tree)
    for name in sorted(named & set(trees)) if "order" in codes else ():
        edit.order(trees[name])
    if codes & {"2", "5"} or thai_language or not mark_all:
        for tree in of("text"):
            edit.text(tree)
        for tree in of("styles"):
            edit.styles(tree)
        for tree in of("numbering"):
            edit.numbering(tree)
    changed = {n: new for n, t in trees.items() if (new := t.written()) != parts[n]}
    counts = {k: v for k, v in edit.counts.items() if v}
    if not changed:
        return Outcome(None, counts, left, False, "nothing here is a repair this version makes; the findings say what is wrong" if codes else None)
    for name in sorted(set(roles.get("text", ())) & set(changed)):
        try:
            same = part_text(parts[name]) == part_text(changed[name])
        except expat.ExpatError:
            same = False
        if not same:
            return Outcome(None, counts, left, False, "the repair would have changed the document's text; nothing was written")
    return Outcome(rewrite_package(data, changed), counts, left, edit.font_written, None)


def chosen_fonts(checked: Checked, asked: str | None = None) -> DataFrame:
    """doc, font, why: the font asked for, else the complex-script font known to carry Thai that a document names most (of equals the smallest), else the default."""
    docs = checked.docs
    if asked:
        return docs.select("doc", F.lit(asked.strip()[: V.FONT_MAX].rstrip()).alias("font"), F.lit("asked").alias("why"))
    most = checked.fonts.groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("fewer"), "font")).alias("m")).select("doc", "m.font")
    out = docs.join(most, "doc", "left")
    return out.select("doc", F.coalesce("font", F.lit("TH Sarabun New")).alias("font"), F.when(F.col("font").isNull(), "default").otherwise("most used").alias("why"))


@dataclass
class Repaired:
    """``outcomes``: doc, ok, exit_code, content, repaired, error, sha256, bytes; ``remaining`` findings and ``warnings`` (doc, code, part, message)."""

    outcomes: DataFrame
    remaining: DataFrame
    warnings: DataFrame


_EDITED = "doc string, content binary, counts map<string,int>, left_parts array<string>, font_written boolean, error string"
_EDITED_TYPES = (pa.string(), pa.binary(), pa.map_(pa.string(), pa.int32()), pa.list_(pa.string()), pa.bool_(), pa.string())
_EDITED_NAMES = ("doc", "content", "counts", "left_parts", "font_written", "error")


def repair_packages(packages: DataFrame, font: str | None = None, thai_language: bool = False, mark_all: bool = False) -> Repaired:
    """Repairs packages (doc, content).

    A package that can't be read or edited, or whose repair fails a condition, gets an
    error and no content (exit 2); a clean one no content and no error (exit 0); findings
    that are left exit 1.
    """
    before = check_packages(packages)
    codes = before.findings.groupBy("doc").agg(F.collect_set("code").alias("codes"))
    unread = before.findings.filter(F.col("code").isin(*UNREAD)).groupBy("doc").agg(F.min_by("message", F.struct("stage", "part_ord", "node", "seq")).alias("unread"))
    roles = before.roles.groupBy("doc").agg(F.collect_set(F.concat_ws("\t", "role", "name")).alias("roles"))
    fonts = chosen_fonts(before, font)
    plan = packages.select("doc", "content").join(unread, "doc", "left")
    plan = plan.join(codes, "doc", "left").join(roles, "doc", "left").join(fonts.withColumn("font", X.xml_attribute("font")), "doc", "left")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                doc, content, has, names, name = (batch.column(i)[at].as_py() for i in range(5))
                by_role: dict[str, list[str]] = {}
                for x in names or ():
                    role, _, part = x.partition("\t")
                    by_role.setdefault(role, []).append(part)
                o = edit_package(content, set(has or ()), by_role, name[1:-1], thai_language, mark_all)
                row = (doc, o.content, list(o.counts.items()), o.left, o.font_written, o.error)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _EDITED_TYPES, strict=True)], names=list(_EDITED_NAMES))

    edited = written(plan.filter("unread is null").select("doc", "content", "codes", "roles", "font").mapInArrow(run, _EDITED))
    after = check_packages(edited.filter("content is not null").select("doc", "content"))
    saved = edited.filter("content is not null").select("doc")
    key = ["doc", "code", "part"]
    worse = bag_difference(after.findings.select(*key), before.findings.join(saved, "doc", "left_semi").select(*key))
    worse = worse.groupBy("doc").agg(F.min("code").alias("worse"))
    left = edited.select("doc", F.explode("left_parts").alias("name")).select("doc", X.quoted("name").alias("part"))
    done = edited.select("doc", F.explode(F.map_keys("counts")).alias("code"))
    still = after.findings.join(left, ["doc", "part"], "left_anti").join(done, ["doc", "code"], "left_semi").groupBy("doc").agg(F.min("code").alias("still"))
    said = F.coalesce(
        F.col("unread"), F.col("error"), F.when(F.col("worse").isNotNull(), F.concat(F.lit("the repair made a file its own checker faults ("), "worse", F.lit("); nothing was written"))),
        F.when(F.col("still").isNotNull(), F.concat(F.lit("finding "), "still", F.lit(" is still there after the repair; nothing was written"))),
    )
    judged = packages.select("doc").join(unread, "doc", "left").join(edited, "doc", "left").join(worse, "doc", "left").join(still, "doc", "left")
    judged = written(judged.withColumn("error", said).withColumn("content", F.when(F.col("error").isNull(), F.col("content"))))
    fine = judged.filter("content is not null").select("doc")
    kept = after.findings.join(fine, "doc", "left_semi").unionByName(before.findings.join(fine, "doc", "left_anti").join(unread.select("doc"), "doc", "left_anti"))
    open_docs = kept.select("doc").distinct().withColumn("open", F.lit(True))
    of_code: Column = F.map_filter("counts", lambda k, v: k != "thai-language")
    code = F.when(F.col("error").isNotNull(), F.when(F.col("worse").isNotNull() & F.startswith("error", F.lit("the repair made")), 1).otherwise(2)).when(F.col("open"), 1).otherwise(0)
    outcomes = judged.join(open_docs, "doc", "left").select(
        "doc", F.col("error").isNull().alias("ok"), code.alias("exit_code"), "content", F.when(F.col("content").isNotNull(), of_code).alias("repaired"), "error",
        F.when(F.col("content").isNotNull(), F.sha2("content", 256)).alias("sha256"), F.length("content").cast("long").alias("bytes"),
    )
    return Repaired(outcomes, listed_findings(kept), _warnings(judged, fonts, before, after, fine))


def _warnings(judged: DataFrame, fonts: DataFrame, before: Checked, after: Checked, fine: DataFrame) -> DataFrame:
    say = lambda df, code, message, part=None: df.select("doc", F.lit(code).alias("code"), (F.lit(None).cast("string") if part is None else part).alias("part"), message.alias("message"))
    saved = judged.filter("content is not null")
    out = say(saved.filter(F.col("counts")["1"].isNotNull()), "layout", F.lit("compatibility mode 15 reflows the document: page breaks can move"))
    fonted = saved.filter("font_written").join(fonts, "doc")
    out = out.unionByName(say(fonted, "font", F.concat(F.lit("complex-script font written where a run named none: '"), X.quoted("font", V.FONT_MAX), F.lit("' ("), "why", F.lit(")"))))
    left = judged.select("doc", F.explode("left_parts").alias("name")).withColumn("part", X.quoted("name")).join(before.findings.select("doc", "part").distinct(), ["doc", "part"], "left_semi")
    out = out.unionByName(say(left, "left", F.concat("part", F.lit(" holds a comment, a CDATA section or a processing instruction; it is left as it came, and its findings with it")), F.col("part")))
    spoke = saved.filter(F.col("counts")["thai-language"].isNotNull())
    out = out.unionByName(say(spoke, "thai-language", F.concat(F.lit("the Thai language was written into "), F.col("counts")["thai-language"].cast("string"), F.lit(" run properties"))))
    nothing = judged.filter("content is null and error is null")
    out = out.unionByName(say(nothing, "clean", F.lit("nothing here needs a repair; no file was written")))
    return out.unionByName(after.warnings.join(fine, "doc", "left_semi").select("doc", "code", "part", "message"))

