"""Whole files as a sink, the node and package tables, and what a text is refused for."""

import json
import os
import random
import time
import zlib
from xml.parsers import expat

import pyarrow as pa
import pytest
from loomleaf.functions import text as X
from loomleaf.operators.build import package_paragraphs
from loomleaf.operators.checks import check_packages, result_lines
from loomleaf.operators.examine import examine
from loomleaf.sources import files
from loomleaf.sources.deflating import deflate
from loomleaf.sources.packages import admit, package_parts, read_packages, rewrite_package
from loomleaf.sources.xmlnodes import ended_nodes, shred, xml_nodes
from loomleaf.workspace import gathered
from packages import clean, packed, planted


def test_files_are_written_whole_or_not(spark, tmp_path):
    files.register(spark)
    rows = spark.createDataFrame([(f"f{i}.docx", bytearray(bytes([i]) * 10)) for i in range(20)], "name string, content binary").repartition(4)
    rows.write.format("loomleaf_files").option("path", str(tmp_path)).mode("append").save()
    assert sorted(os.listdir(tmp_path)) == sorted(f"f{i}.docx" for i in range(20)) and (tmp_path / "f7.docx").read_bytes() == bytes([7]) * 10
    for bad in ("../x", "a/b", "", ".hidden"):
        with pytest.raises(Exception, match="no file name"):
            spark.createDataFrame([("ok.docx", bytearray(b"1")), (bad, bytearray(b"2"))], "name string, content binary").write.format("loomleaf_files").option("path", str(tmp_path)).mode("append").save()
    with pytest.raises(Exception, match="f3.docx"):
        spark.createDataFrame([("f3.docx", bytearray(b"1"))], "name string, content binary").write.format("loomleaf_files").option("path", str(tmp_path)).mode("append").save()
    assert (tmp_path / "f3.docx").read_bytes() == bytes([3]) * 10 and len([n for n in os.listdir(tmp_path) if n[0] != "."]) == 20  # a task still at work may leave its hidden folder, no file
    spark.createDataFrame([("f3.docx", bytearray(b"new"))], "name string, content binary").write.format("loomleaf_files").option("path", str(tmp_path)).option("overwrite", "true").mode("append").save()
    assert (tmp_path / "f3.docx").read_bytes() == b"new"


def test_tables_of_packages(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(packed(clean()))
    (tmp_path / "b.docx").write_bytes(planted("word/styles.xml", "</w:styles>", ""))
    parts = package_parts(read_packages(spark, str(tmp_path)))
    assert parts.groupBy("doc").count().filter("count = 7").count() == 2
    nodes = xml_nodes(parts)
    assert nodes.filter("fault is not null").count() == 1 and nodes.filter("fault is null and local = 'p'").count() == 6
    assert nodes.filter("local = 'body'").select("depth", "part").first()["depth"] == 1


def test_nodes_of_some_elements_are_as_among_all(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(packed(clean()))
    (tmp_path / "b.docx").write_bytes(planted("word/document.xml", "</w:body>", ""))
    packages = read_packages(spark, str(tmp_path))
    shown = lambda df: sorted(map(repr, df.collect()))
    nodes = xml_nodes(package_parts(packages))
    assert shown(xml_nodes(package_parts(packages), only=("pStyle", "r"))) == shown(nodes.filter("local in ('pStyle', 'r') or fault is not null"))
    main = package_parts(packages, named=("word/document.xml",))
    assert shown(main) == shown(package_parts(packages).filter("name = 'word/document.xml' or code is not null")) and main.count() == 2


def test_entries_without_their_contents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(packed(clean()))
    (tmp_path / "b.docx").write_bytes(b"x")
    packages = read_packages(spark, str(tmp_path))
    whole, bare = package_parts(packages), package_parts(packages, data=False)
    assert bare.filter("data is not null").count() == 0 and whole.filter("data is not null").count() == 7
    assert sorted(map(repr, bare.drop("data").collect())) == sorted(map(repr, whole.drop("data").collect()))


def test_small_batches_become_few():
    batches = list(gathered(((str(i), bytes(10)) for i in range(1000)), {"a": pa.string(), "b": pa.binary()}, lambda r: len(r[1]), most=400, most_bytes=3000))
    assert [b.num_rows for b in batches] == [300, 300, 300, 100] and [v for b in batches for v in b.column(0).to_pylist()] == [str(i) for i in range(1000)]
    assert list(gathered(iter(()), {"a": pa.string()})) == []


def test_small_parts_are_read_as_large_ones():
    rng, pieces = random.Random(3), ["<p>", "</p>", "<r>", "</r>", "<rPr>", "</rPr>", "<b/>", "<i x='1' rsidR='2'/>", "<rPrChange>", "</rPrChange>", "t", "<!--c-->", "<?i x?>", "<![CDATA[ <y ]]>", "&amp;", "&no;", "<q xmlns='v}w' xmlns:k='k' k:z='1'/>", "\r\n"]
    for _ in range(5000):
        data, got = f"<a>{''.join(rng.choice(pieces) for _ in range(rng.randrange(7)))}</a>".encode(), []
        for read in (shred, lambda d: sorted((n for some in ended_nodes(d) for n in some), key=lambda n: n[0])):
            try:
                got.append(read(data))
            except expat.ExpatError:
                got.append(None)
        assert got[0] == got[1], data


def test_a_part_by_another_name_is_refused(spark):
    parts = clean()
    parts["word/styles.dat"] = parts.pop("word/styles.xml")
    parts["word/_rels/document.xml.rels"] = parts["word/_rels/document.xml.rels"].replace("styles.xml", "styles.dat")
    found = [r for r in examine(packed(parts)) if r.kind == "finding"]
    assert [(r.code, r.part, r.names) for r in found] == [("package", "word/styles.dat", ("word/styles.dat",))]
    told = check_packages(spark.createDataFrame([("x", bytearray(packed(parts)))], "doc string, content binary")).findings.first()
    assert told["message"] == "the document reads word/styles.dat as one of its parts, and that name does not end in .xml; refused"


def test_font_names_with_spaces_are_told():
    warned = [r for r in examine(planted("word/numbering.xml", 'w:ascii="Garuda"', 'w:ascii="Garuda "')) if r.kind == "warning"]
    assert [(r.message, r.names) for r in warned] == [("in a numbering level, font '\0' begins or ends with a space (U+2003), which no font's name does, so it may name no font installed", ("Garuda ",))]


def test_nodes_in_linear_time():
    began = time.time()
    nodes = shred(b"<w:rPr xmlns:w='u'>" + b"<w:rPr>" * 100_000 + b"</w:rPr>" * 100_000 + b"</w:rPr>")
    assert len(nodes) == 100_001 and time.time() - began < 10
    same = shred(b"<r><rPr><b/><i x='1' rsidR='2'/></rPr><rPr><b/><i x='1'/></rPr><rPr><b/><i x='2'/></rPr></r>")
    shapes = [n[12] for n in same if n[5] == "rPr"]
    assert shapes[0] == shapes[1] != shapes[2]


def test_arguments(spark):
    rows = spark.createDataFrame([("plain",), ("ไทย",), ("a�b",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.not_text("t")).collect()] == [False, False, True, None]


def test_deflate_is_defined_and_read_by_others():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 257, 258, 259, 70_000, 200_000):
        for data in (rng.randbytes(n), bytes(rng.choice(b"abc") for _ in range(n)), b"x" * n):
            packed_ = deflate(data)
            assert zlib.decompress(packed_, -15) == data
    assert deflate(b"") == b"\x03\x00"
    styles = b"".join(b'<w:style w:styleId="H%d"><w:name w:val="heading %d"/></w:style>' % (i, i * 7) for i in range(4000))
    assert len(deflate(styles)) < len(styles) / 7


def test_repaired_parts_are_deflated():
    data = packed(clean())
    again = rewrite_package(data, {"word/styles.xml": clean()["word/styles.xml"].replace("30", "32").encode()})
    entries = {e.name: e for e, _ in admit(again)[0]}
    assert entries["word/styles.xml"].method == 8 and entries["word/document.xml"].method == 0
    assert again == rewrite_package(data, {"word/styles.xml": clean()["word/styles.xml"].replace("30", "32").encode()})


def test_result_lines(spark):
    rows = [("fine", bytearray(packed(clean()))), ("bad", bytearray(planted("word/settings.xml", 'w:val="15"', 'w:val="14"'))), ("none", bytearray(b"x"))]
    told = {r["doc"]: r for r in result_lines(check_packages(spark.createDataFrame(rows, "doc string, content binary"))).collect()}
    assert [told[d]["exit_code"] for d in ("fine", "bad", "none")] == [0, 1, 2]
    fine, bad, none = (json.loads(told[d]["line"]) for d in ("fine", "bad", "none"))
    assert fine["ok"] and fine["findings"] == [] and fine["counts"] == {"runs": 5, "thai_language_runs": 5, "paragraphs": 3, "tables": 0} and fine["numbering"] == "automatic"
    assert bad["findings"] == [{"code": "1", "part": "word/settings.xml", "message": "compatibilityMode declared as 14; must be exactly one 15"}] and not bad["ok"]
    assert none["findings"][0]["code"] == "package" and "counts" not in none


def test_text_is_trimmed_but_where_space_is_kept():
    body = '<w:p><w:r><w:t> a </w:t></w:r><w:r><w:t xml:space="preserve"> b </w:t></w:r></w:p>'
    data = packed(clean() | {"word/document.xml": clean()["word/document.xml"].split("<w:body>")[0] + f"<w:body>{body}</w:body></w:document>"})
    assert package_paragraphs(data) == ["a b "]
