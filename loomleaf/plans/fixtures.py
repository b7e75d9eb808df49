"""Literal rows that the catalogue's rule queries run on, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(schema: str, rows: list[tuple]) -> str:
    """The rows as a SQL table expression with typed columns."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "long": "BIGINT", "double": "DOUBLE"}
    columns = [c.strip().split() for c in schema.split(",")]

    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return repr(v)
        pieces = [f"'{p}'" for p in v.replace("'", "''").split("\n")]
        return "(" + " || chr(10) || ".join(pieces) + ")"

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return "(SELECT " + ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in columns) + f" FROM (VALUES {body}) AS v(" + ", ".join(n for n, _ in columns) + "))"


CHILDREN = ("element int, ord int, list string, name string", [
    (1, 0, "pPr", "pStyle"), (1, 1, "pPr", "jc"), (1, 2, "pPr", "spacing"), (1, 3, "pPr", "ind"),
    (2, 0, "pPr", "keepNext"), (2, 1, "pPr", "w14thing"), (2, 2, "pPr", "rPr"),
    (3, 0, "rPr", "cs"), (3, 1, "rPr", "b"), (3, 2, "rPr", "rPrChange"),
    (4, 0, "rPr", "rPrChange"), (4, 1, "rPr", "odd"), (4, 2, "rPr", "sz"),
    (5, 0, "sectPr", "footerReference"), (5, 1, "sectPr", "headerReference"), (5, 2, "sectPr", "pgMar"), (5, 3, "sectPr", "pgSz"), (5, 4, "sectPr", "type"),
])
HEADINGS = ("doc int, pos int, level int", [(1, i, v) for i, v in enumerate((1, 2, 2, 3, 1, 2, 4, 3, 2, 1))] + [(2, i, v) for i, v in enumerate((3, 1, 3, 3, 2, 6, 6, 1))] + [(3, 0, 1)])
BLOCKS = ("doc int, pos int, type string, level int, name string, text string, image_only boolean", [
    (1, 0, "paragraph", None, None, "cover", False), (1, 1, "directive", None, "front", None, False), (1, 2, "heading", 1, None, "preface", False),
    (1, 3, "paragraph", None, None, "Table: before nothing", False), (1, 4, "directive", None, "chapters", None, False), (1, 5, "heading", 1, None, "one", False),
    (1, 6, "paragraph", None, None, "Table: first", False), (1, 7, "table", None, None, None, False), (1, 8, "paragraph", None, None, "", True),
    (1, 9, "paragraph", None, None, "Figure: seen", False), (1, 10, "heading", 2, None, "part", False), (1, 11, "paragraph", None, None, "Table:", False),
    (1, 12, "table", None, None, None, False), (1, 13, "heading", 1, None, "two", False), (1, 14, "paragraph", None, None, "Table: again", False), (1, 15, "table", None, None, None, False),
    (1, 16, "directive", None, "appendices", None, False), (1, 17, "heading", 1, None, "A", False), (1, 18, "paragraph", None, None, "", True), (1, 19, "paragraph", None, None, "Figure: in it", False),
    (1, 20, "directive", None, "back", None, False), (1, 21, "paragraph", None, None, "index", False),
    (2, 0, "heading", 1, None, "plain", False), (2, 1, "paragraph", None, None, "Table: plain", False), (2, 2, "table", None, None, None, False), (2, 3, "paragraph", None, None, "Tables: not one", False),
    (3, 0, "directive", None, "chapters", None, False), (3, 1, "heading", 1, None, "x", False), (3, 2, "directive", None, "front", None, False), (3, 3, "directive", None, "chapters", None, False),
    (4, 0, "directive", None, "back", None, False), (4, 1, "paragraph", None, None, "y", False), (4, 2, "directive", None, "appendices", None, False), (4, 3, "directive", None, "back", None, False),
])
MIXED = ("id int, t string", [
    (1, "ภาษาไทย 120 พ.ศ. (abc) ไทย, Word"), (2, "abc ไทย"), (3, " ไทย (ก) "), (4, "123, 456"), (5, "ก.ข x.y ก-ข"), (6, "\"ไทย\""), (7, "Word ไทย Word"), (8, "।देवनागरी abc"), (9, "a"),
])
BREAKS = ("id int, t string", [(1, "ไทย\nไทย"), (2, "ไทย\nword"), (3, "พ.\nศ."), (4, "a.\nb"), (5, "ไทย,\nไทย"), (6, "x\nไทย\nไทย"), (7, "no break")])
NUMBERS = ("n int", [(n,) for n in (1, 2, 9, 10, 26, 27, 41, 42, 53, 83, 444, 1994, 3999)])
COMMENTS = ("id int, t string", [(1, "<!-- chapter -->"), (2, "<!-- Chapters -->"), (3, "<!-- tco -->"), (4, "<!-- list of tables -->"), (5, "<!-- appendicies -->"), (6, "<!-- note to self -->"), (7, "<!-- frontt -->"), (8, "<!--toc-->"), (9, "<!-- contents -->"), (10, "plain"), (11, "<!-- bak -->")])
DECOMPOSED = ("id int, t string", [(1, "กุ่"), (2, "นู้"), (3, "กา"), (4, "ปุ่่")])
PATHS = ("id int, source string, target string", [(1, "word/document.xml", "styles.xml"), (2, "word/document.xml", "/word/x.xml"), (3, "word/document.xml", "../custom/y.xml"), (4, "", "word/document.xml"), (5, "a/b/c.xml", "../../../z.xml"), (6, "a/b/c.xml", "./d/../e.xml")])
TAGS = ("part string, pos int, kind string", [("a", i, k) for i, k in enumerate(("open", "open", "empty", "close", "open", "open", "close", "close", "close"))] + [("b", 0, "empty"), ("b", 1, "open"), ("b", 2, "close")])
SETTINGS = ("doc int, ord int, flag string, need string", [(1, 9, "--table-widths", "tables"), (1, 8, "--no-repeat-table-header", "tables"), (1, 3, "--indent", "body paragraphs"), (1, 1, "--size", None), (2, 8, "--no-repeat-table-header", "tables"), (2, 14, "--table-label", "table captions")])
PRESENCE = ("doc int, need string", [(1, "body paragraphs"), (2, "tables"), (2, "headings")])
LINES = ("id int, t string", [(1, "ก่่า"), (2, "่ก"), (3, "กำ่"), (4, "กิี"), (5, "ปู่"), (6, "กำำ"), (7, "สิทธิ์"), (8, "ก์่"), (9, "plain"), (10, "นํา")])
NAMES = ("id int, t string", [(1, "TH Sarabun New"), (2, "bad<name>;x"), (3, "ไทย font"), (4, "x" * 80), (5, "tab\there"), (6, "😀 wide")])
LINKS = ("id int, t string", [(1, "https://a.b"), (2, "javascript:x"), (3, "mailto:a@b"), (4, "#top"), (5, "other.docx"), (6, "FTP://x"), (7, "data:text/html,x"), (8, "1a:b")])
HALVES = ("x double", [(v,) for v in (0.5, 1.5, 2.5, -0.5, -1.5, 2.4999, 1440.0 * 0.75, 7.0)])
MESSAGES = ("id int, t string", [(1, "Thai-Docx grill make a report"), (2, "ช่วยทำรายงาน thai docx grill"), (3, "make a report called รายงาน"), (4, "thai_docx\n grill"), (5, "ทำ report"), (6, "thaidocx grill")])
MARKUP = ("id int, t string", [(1, 'a < b & c > "d"'), (2, "&amp;"), (3, "tab\tand 'quote'"), (4, "plain")])
HIDDEN = ("id int, t string", [(1, "a​b"), (2, "ไทย‍ไทย"), (3, "क‍ष"), (4, "soft­hyphen"), (5, "plain"), (6, "﻿start⁠"), (7, "bell\u0007"), (8, "﷐"), (9, "a‍b")])
CLAUSES = ("id int, t string", [(1, "Thai-Docx grill from thesis save to my-own only size,toc write it"), (2, "ช่วย thai docx grill จากเดิม บันทึกเป็น v2"), (3, "thai_docx  GRILL Save To x then from y"), (4, "from thesis thai docx grill"), (5, "build only this"), (6, "thai-docx grill"), (7, "thai docx grill only"), (8, "thai docx grill รายงาน เฉพาะsize")])
