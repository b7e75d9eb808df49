import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from loomleaf.operators.build import build_packages
from loomleaf.operators.checks import check_packages, listed_findings, package_summaries, part_roles, verdicts
from loomleaf.operators.examine import examine
from loomleaf.plans import catalogue
from loomleaf.sources import packages as P
from loomleaf.sources.xmlnodes import shred
from packages import ITEM, LAST, TITLE, clean, packed, planted, run

DOC, STY, SET, NUM = "word/document.xml", "word/styles.xml", "word/settings.xml", "word/numbering.xml"
CASES = {
    "clean": (lambda: packed(clean()), set()),
    "no cs": (lambda: planted(DOC, "<w:cs/>", ""), {"2"}),
    "cs off": (lambda: planted(DOC, "<w:cs/>", '<w:cs w:val="0"/>'), {"2"}),
    "rtl instead": (lambda: planted(DOC, "<w:cs/>", "<w:rtl/>"), set()),
    "latin without cs": (lambda: planted(DOC, run(LAST), run(" end", "")), set()),
    "mode 14": (lambda: planted(SET, 'w:val="15"', 'w:val="14"'), {"1"}),
    "no mode": (lambda: planted(SET, "compatibilityMode", "other"), {"1"}),
    "no settings": (lambda: packed({n: d for n, d in clean().items() if n != SET}), {"1"}),
    "no proof in a style": (lambda: planted(STY, "<w:b/>", "<w:noProof/><w:b/>"), {"3"}),
    "no proof on code": (lambda: planted(DOC, run(LAST), run("code", "<w:noProof/>")), set()),
    "no proof off": (lambda: planted(STY, "<w:b/>", '<w:noProof w:val="false"/><w:b/>'), set()),
    "split word": (lambda: planted(DOC, run(ITEM), run("ข้าว") + run("สวย")), {"4"}),
    "split but apart": (lambda: planted(DOC, run(ITEM), run("ข้าว") + '<w:bookmarkStart w:id="1"/>' + run("สวย")), set()),
    "no twin": (lambda: planted(DOC, "<w:bCs/>", ""), {"5"}),
    "no cs font": (lambda: planted(STY, ' w:cs="Garuda"', ""), {"5"}),
    "symbol bullet": (lambda: planted(NUM, '"decimal"/><w:rPr><w:rFonts w:ascii="Garuda"', '"bullet"/><w:rPr><w:rFonts w:ascii="Symbol"'), {"5"}),
    "page out of order": (lambda: planted(DOC, '<w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440"/>', '<w:pgMar w:top="1440"/><w:pgSz w:w="11906" w:h="16838"/>'), {"order"}),
    "style out of order": (lambda: planted(STY, '<w:name w:val="heading 1"/><w:pPr><w:keepNext/></w:pPr>', '<w:pPr><w:keepNext/></w:pPr><w:name w:val="heading 1"/>'), {"order"}),
    "invisible": (lambda: planted(DOC, TITLE, "แดด\u200bและฝน"), {"invisible"}),
    "doctype": (lambda: planted(DOC, "<w:document", "<!DOCTYPE x><w:document"), {"doctype"}),
    "not xml": (lambda: planted(DOC, "</w:body>", ""), {"package"}),
    "other encoding": (lambda: planted(STY, 'encoding="UTF-8"', 'encoding="ISO-8859-1"'), {"package"}),
    "dangling": (lambda: planted(DOC, "<w:sectPr>", '<w:sectPr><w:headerReference r:id="rId9"/>'), {"package"}),
    "no document": (lambda: packed({n: d for n, d in clean().items() if n not in (DOC, "_rels/.rels")}), {"package"}),
    "not zip": (lambda: b"x" * 100, {"package"}),
    "strict": (lambda: planted(DOC, "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://purl.oclc.org/ooxml/wordprocessingml/main"), {"package"}),
}


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(name, bytearray(make())) for name, (make, _) in CASES.items()]
    return check_packages(spark.createDataFrame(rows, "doc string, content binary"))


def test_findings(checked):
    found = {name: set() for name in CASES}
    for r in checked.findings.collect():
        found[r["doc"]].add(r["code"])
    assert found == {name: codes for name, (_, codes) in CASES.items()}


def test_counts_and_verdicts(checked):
    row = {r["doc"]: r for r in checked.counts.collect()}["clean"]
    assert (row["runs"], row["thai_language_runs"], row["paragraphs"], row["tables"]) == (5, 5, 3, 0)
    codes = {r["doc"]: r["exit_code"] for r in verdicts(checked).collect()}
    assert codes["clean"] == 0 and codes["no cs"] == 1 and codes["not zip"] == 2
    kinds = {r["doc"]: r for r in checked.numbering.collect()}
    assert kinds["clean"]["kind"] == "automatic" and kinds["clean"]["automatic_lists"] == 1
    assert listed_findings(checked.findings).count() == checked.findings.count()


def test_summaries_equal_the_tables(spark, checked):
    packages = spark.createDataFrame([(name, bytearray(make())) for name, (make, _) in CASES.items()], "doc string, content binary")
    columns = ["doc", "ok", "exit_code", "runs", "thai_language_runs", "paragraphs", "tables", "footnotes"]
    tables = verdicts(checked).join(checked.counts, "doc", "left").join(checked.numbering.select("doc", F.col("kind").alias("numbering")), "doc", "left")
    assert sorted(map(repr, package_summaries(packages).collect())) == sorted(map(repr, tables.select(*columns, "numbering").collect()))


def test_known_packages_are_built_on_all_cores(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    packages = catalogue._known_packages(spark, str(tmp_path))
    assert packages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert packages.columns == ["doc", "content"] and packages.count() == packages.select("doc").distinct().count() == spark.read.parquet(str(tmp_path / "customer.parquet")).count()


def test_packages_are_the_same_without_reading_them_back(spark):
    texts = spark.createDataFrame([("a", "# x *y*\n\ntext"), ("b", "<div>"), ("c", None), ("d", "ไทย a\tb")], "id string, body string")
    whole, bare = (build_packages(texts, "id", "body", read_back=again) for again in (True, False))
    assert bare.columns == ["doc", "content", "line", "error"]
    assert sorted(map(repr, whole.select(bare.columns).collect())) == sorted(map(repr, bare.collect()))


def test_parts_seen_before_are_examined_as_new_ones():
    for _ in range(2):  # what is kept of the first package's parts must not change what is said of the next
        for name in ("clean", "no twin", "style out of order", "not xml", "other encoding", "clean"):
            make, codes = CASES[name]
            assert {r.code for r in examine(make()) if r.kind == "finding"} == codes
    moved = clean()
    moved[STY] = moved[STY].replace("<w:bCs/>", "", 1)
    moved = {STY: moved.pop(STY), **moved}
    found = [[(r.part, r.part_ord) for r in examine(packed(p)) if r.code == "5"] for p in ({**{n: d for n, d in moved.items() if n != STY}, STY: moved[STY]}, moved)]
    assert [x[0] for x in found] == [(STY, 6), (STY, 0)]


def test_packages_made_by_others_are_read():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in clean().items():
            z.writestr(name, text)
    found, refusal = P.admit(buffer.getvalue())
    assert refusal is None and [e.name for e, _ in found] == list(clean())
    again = P.rewrite_package(buffer.getvalue(), {DOC: b"<a/>"})
    with zipfile.ZipFile(io.BytesIO(again)) as z:
        assert z.testzip() is None and z.read(DOC) == b"<a/>" and z.read(STY).decode() == clean()[STY]
    with pytest.raises(P.PackageFault):
        P.rewrite_package(again, {"none": b""})


def test_roles_alone_are_those_of_the_whole_check(spark, checked):
    cases = {name: make() for name, (make, _) in CASES.items()} | {"style not xml": planted(STY, "</w:styles>", "")}
    packages = spark.createDataFrame([(name, bytearray(data)) for name, data in cases.items()], "doc string, content binary")
    alone, whole = (sorted(map(repr, t.collect())) for t in (part_roles(packages), check_packages(packages, keep=False).roles))
    assert alone == whole and len({r["doc"] for r in part_roles(packages).collect()}) > 10


def test_damaged_packages():
    good = packed(clean())
    assert P.admit(good + b"x")[1][0] == "package"
    assert P.admit(b"front" + good)[1] is None
    twice = P.write_package([("a.xml", b"<a/>"), ("a.xml", b"<a/>")])
    assert P.admit(twice)[1][2] == "entry name appears more than once"
    spoiled = bytearray(good)
    spoiled[60] ^= 1
    assert P.admit(bytes(spoiled))[1][0] == "package"
    bomb = bytearray(P.write_package([("a.bin", b"")]))
    at = bomb.index(b"PK\x01\x02") + 24
    bomb[at : at + 4] = struct.pack("<I", (32 << 20) + 1)
    assert P.admit(bytes(bomb))[1][0] == "size"
    assert P.admit(b"")[1][0] == "package"


def test_nodes():
    nodes = shred(b'<a xmlns="u"><b x="1">t<c/>u</b><b/></a>')
    assert [(n[0], n[1], n[2], n[3], n[5], n[8]) for n in nodes] == [(0, None, 0, 0, "a", 3), (1, 0, 0, 1, "b", 2), (2, 1, 0, 2, "c", 2), (3, 0, 1, 1, "b", 3)]
    assert nodes[1][7] == "t" and nodes[1][6] == {"x": "1"}
    deep = shred(b"<a>" * 50_000 + b"</a>" * 50_000)
    assert deep[0][8] == 49_999
    assert zlib.crc32(b"") == 0
