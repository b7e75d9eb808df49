"""Repairs: by code, whole text kept, nothing new broken, a second repair writes nothing."""

import pytest

from loomleaf.operators import repair as R
from loomleaf.sources.packages import admit
from packages import ITEM, LAST, clean, packed, planted, run

DOC, STY, SET, NUM = "word/document.xml", "word/styles.xml", "word/settings.xml", "word/numbering.xml"
TWO = '<w:r><w:rPr><w:cs/></w:rPr><w:t xml:space="preserve">{}</w:t></w:r>'
CASES = {
    "clean": (lambda: packed(clean()), 0, None, None),
    "mode 14": (lambda: planted(SET, 'w:val="15"', 'w:val="14"'), 0, {"1": 1}, None),
    "two modes": (lambda: planted(SET, "</w:compat>", clean()[SET].split("<w:compat>")[1].split("</w:compat>")[0] + "</w:compat>"), 0, {"1": 1}, None),
    "no mode": (lambda: planted(SET, "compatibilityMode", "other"), 2, None, "nothing here"),
    "no cs": (lambda: planted(DOC, "<w:cs/>", ""), 0, {"2": 1}, None),
    "cs off": (lambda: planted(DOC, "<w:cs/>", '<w:cs w:val="0"/>'), 0, {"2": 1}, None),
    "no properties": (lambda: planted(DOC, run(ITEM), "<w:r><w:t>ข้าวสวย</w:t></w:r>"), 0, {"2": 1}, None),
    "latin marked": (lambda: planted(DOC, run(LAST), run(" end")), 0, {"unmarked": 1}, None),
    "style marked": (lambda: planted(STY, "<w:bCs/>", "<w:bCs/><w:cs/>"), 0, {"unmarked": 1}, None),
    "both scripts": (lambda: planted(DOC, run(LAST), TWO.format("คำ &amp; word คำ")), 0, {"split": 1, "unmarked": 1}, None),
    "unseen inside": (lambda: planted(DOC, run(LAST), TWO.format("คำ​คำ")), 2, None, "nothing here"),
    "numeric reference": (lambda: planted(DOC, run(LAST), "<w:r><w:t>คำ &#65; word</w:t></w:r>"), 0, {"2": 1}, None),
    "proof": (lambda: planted(STY, "<w:b/>", "<w:b/><w:noProof/>"), 0, {"3": 1}, None),
    "twin": (lambda: planted(DOC, "<w:bCs/>", ""), 0, {"5": 1}, None),
    "font": (lambda: planted(STY, ' w:cs="Garuda"', ""), 0, {"5": 1}, None),
    "symbol": (lambda: planted(NUM, '"decimal"/><w:rPr><w:rFonts w:ascii="Garuda"', '"bullet"/><w:rPr><w:rFonts w:ascii="Symbol"'), 0, {"5": 1}, None),
    "order": (lambda: planted(DOC, '<w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440"/>', '<w:pgMar w:top="1440"/><w:pgSz w:w="11906" w:h="16838"/>'), 0, {"order": 1}, None),
    "split word": (lambda: planted(DOC, run(ITEM), run("ข้าว") + run("สวย")), 2, None, "nothing here"),
    "comment": (lambda: planted(DOC, "<w:body>", "<w:body><!-- x -->"), 0, None, None),
    "comment and fault": (lambda: packed(clean() | {DOC: clean()[DOC].replace("<w:cs/>", "", 1).replace("<w:body>", "<w:body><!-- x -->"), SET: clean()[SET].replace('"15"', '"14"')}), 1, {"1": 1}, None),
    "deep": (lambda: planted(DOC, "<w:sectPr>", "<w:sdt>" * 101 + "</w:sdt>" * 101 + "<w:sectPr>"), 2, None, "101 deep"),
    "prefix": (lambda: packed(clean() | {DOC: clean()[DOC].replace("w:", "v:").replace("xmlns:w=", "xmlns:v=")}), 2, None, "prefix"),
    "not zip": (lambda: b"x" * 100, 2, None, "not a zip"),
}


def rows_of(repaired):
    return {r["doc"]: r for r in repaired.outcomes.collect()}


@pytest.fixture(scope="module")
def packages(spark):
    return spark.createDataFrame([(name, bytearray(case[0]())) for name, case in CASES.items()], "doc string, content binary")


@pytest.fixture(scope="module")
def repaired(packages):
    return R.repair_packages(packages)


def test_outcomes(repaired):
    rows = rows_of(repaired)
    for name, (_, code, counts, error) in CASES.items():
        r = rows[name]
        assert (r["exit_code"], r["repaired"]) == (code, counts), (name, r["error"], r["repaired"])
        assert (error is None and r["error"] is None) or error in r["error"], (name, r["error"])
    warned = {(r["doc"], r["code"]) for r in repaired.warnings.collect()}
    assert {("mode 14", "layout"), ("font", "font"), ("comment and fault", "left"), ("clean", "clean")} <= warned
    assert "not zip" not in {r["doc"] for r in repaired.remaining.collect()}


def test_text_is_kept_and_a_second_repair_writes_nothing(spark, repaired):
    rows = {n: r for n, r in rows_of(repaired).items() if r["content"] is not None}
    for name, r in rows.items():
        old, new = (dict((e.name, d) for e, d in admit(bytes(x))[0]) for x in (CASES[name][0](), r["content"]))
        assert R.part_text(old[DOC]) == R.part_text(new[DOC]) and list(old) == list(new)
    again = R.repair_packages(spark.createDataFrame([(n, r["content"]) for n, r in rows.items()], "doc string, content binary"))
    assert all(r["content"] is None for r in again.outcomes.collect())


def test_trees_write_what_they_read():
    for data in [d.encode() for d in clean().values()] + [b"<a/>", b"\xef\xbb\xbf<?xml version='1.0'?>\n<a x='>' >t<b\n/> u</a >\n"]:
        assert R.read_part(data).written() == data
    assert R.read_part(b"<a><![CDATA[x]]></a>") is None
    assert R.read_part(b"<a>" * 50_000 + b"</a>" * 50_000).deepest == 50_000


def test_pieces():
    assert R.pieces_of("คำ​ word") == [(True, "คำ​ "), (False, "word")]
    assert R.pieces_of("​คำ&amp;x") == [(True, "​คำ"), (False, "&amp;x")]
    assert R.pieces_of("") == []


def test_whole_document_and_language(spark):
    frame = spark.createDataFrame([("a", bytearray(planted(DOC, run(LAST), "<w:r><w:t>end</w:t></w:r>" + "<w:r><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r>")))], "doc string, content binary")
    row = rows_of(R.repair_packages(frame, font=" Sarabun ", thai_language=True, mark_all=True))["a"]
    assert row["exit_code"] == 0 and row["repaired"] == {"2": 2, "5": 1}
    assert R.repair_packages(frame.limit(0)).outcomes.count() == 0
