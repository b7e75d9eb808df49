"""Settings: flags, profiles, rules between settings, the report and the interview."""

import json

import pytest

from loomleaf.operators import sets as S
from loomleaf.operators import settings as C

PROFILE = {"schema": 1, "settings": {"align": "thai", "indent": 0.5, "page_numbers": "top-right", "size": 14, "margins": [1, 1, 1, 1]}}


def changed(argv, profile=None):
    return C.changed(C.read_flags(argv, profile))


@pytest.mark.parametrize(
    "argv,values",
    [
        ([], {}),
        (["--size", "14"], {"size": 14}),
        (["--size=14.5"], {"size": 14.5}),
        (["--size", "14", "--size", "16"], {}),
        (["--page-numbers"], {"page_numbers": "top-right"}),
        (["--page-numbers", "bottom-center", "--toc"], {"page_numbers": "bottom-center", "toc": True}),
        (["--page-numbers", "--no-page-number-first"], {"page_numbers": "top-right", "page_number_on_first": False}),
        (["--margins", "1,1,1,1"], {"margins": [1.0, 1.0, 1.0, 1.0]}),
        (["--font", " Sarabun "], {"font": "Sarabun"}),
        (["--header", "ลับ"], {"header": "ลับ"}),
    ],
)
def test_flags(argv, values):
    assert changed(argv) == values
    assert changed(C.as_flags(values)) == values


@pytest.mark.parametrize(
    "argv,says",
    [
        (["--size", "401"], "from 1 to 400"),
        (["--size", "1e2"], "from 1 to 400"),
        (["--size"], "needs a value"),
        (["--toc=1"], "takes no value"),
        (["--nothing"], "unknown option"),
        (["--font", "  "], "a font name"),
        (["--font", "a​b"], "a font name"),
        (["--header", "a\nb"], "one line"),
        (["--no-page-number-first"], "needs --page-numbers"),
        (["--margins", "1,1,1,7"], "--margins leave"),
        (["--indent", "9"], "--indent leaves"),
        (["--indent", "9" * 400], "non-negative"),
        (["--table-label", "a b", "--auto-numbering"], "takes no space"),
        (["--default", "nothing"], "names no setting"),
    ],
)
def test_refused_flags(argv, says):
    with pytest.raises(C.SettingFault, match=says):
        C.read_flags(argv)


@pytest.mark.parametrize(
    "content",
    ["", "[]", "{", '{"schema": true, "settings": {}}', '{"schema": 1}', '{"schema": 1, "settings": {"x": 1}}', '{"schema": 1, "settings": {"size": "14"}}', '{"schema": 1, "settings": {"toc": 1}}', '{"schema": 1, "settings": {"font": 3}}', '{"schema": 1, "settings": {"margins": "1,1,1,1"}}', '{"schema": 1, "settings": {"size": [14]}}', '{"schema": 1, "settings": {"size": true}}', "x" * 70_000],
)
def test_refused_profiles(content):
    with pytest.raises(C.SettingFault):
        C.read_profile(content)


def test_profiles():
    held = C.read_profile(json.dumps(PROFILE))
    assert changed([], held) == {"align": "thai", "indent": 0.5, "page_numbers": "top-right", "size": 14, "margins": [1.0] * 4}
    assert changed(["--size", "15", "--default", "align,indent"], held) == {"page_numbers": "top-right", "size": 15, "margins": [1.0] * 4}
    assert C.read_profile('{"schema": 1, "settings": {"header": null, "page_numbers": false}}') == {"header": None, "page_numbers": False}


def test_resolved_rows(spark):
    rows = [(1, ["--toc", "--table-widths", "auto"], None), (2, None, json.dumps(PROFILE)), (3, ["--size", "x"], None), (4, [], "{")]
    out = C.resolve(spark.createDataFrame(rows, "doc int, argv array<string>, profile string"), "argv", "profile").cache()
    got = {r["doc"]: r for r in out.collect()}
    assert json.loads(got[1]["report"])["margins_in"] == {"top": 1.0, "right": 1.0, "bottom": 1.0, "left": 1.5}
    assert got[1]["flags"] == ["--toc", "--table-widths", "auto"] and got[3]["settings"] is None and got[4]["refused"] == "not JSON"
    nothing = S.changed_nothing(C.not_default(out), spark.createDataFrame([(2, "body paragraphs")], "doc int, need string"))
    assert [(r["doc"], r["flags"]) for r in nothing.collect()] == [(1, "--table-widths")]
    asked = C.questions(out)
    current = {(r["doc"], r["question"]): r["letter"] for r in asked.filter("current").collect()}
    assert current[1, "size"] == "a" and current[2, "size"] == "b" and current[2, "paper"] == "b" and current[1, "toc"] == "b" and len(current) == 16
    typed = C.resolve(spark.createDataFrame([(5, ["--size", "20"])], "doc int, argv array<string>"), "argv")
    assert C.questions(typed).filter("current and question = 'size'").first()["other"]


def test_saved_profiles_and_choices(spark):
    rows = spark.createDataFrame([("ไทย-1", ["--size", "15", "--align", "thai"]), ("b_2", ["--align", "thai", "--size", "15"]), ("../x", []), ("-no", []), ("c", ["--what"])], "name string, argv array<string>")
    saved = {r["name"]: r for r in C.saved_profiles(C.resolve(rows, "argv"), "name").collect()}
    assert set(saved) == {"ไทย-1", "b_2"} and saved["b_2"]["digest"] == saved["ไทย-1"]["digest"]
    assert C.read_profile(saved["b_2"]["content"]) == {"size": 15.0, "align": "thai"} and saved["b_2"]["content"].endswith("}\n")
    asked = C.choice_args(C.questions(C.resolve(rows.filter("name = 'b_2'").withColumnRenamed("name", "doc"), "argv")))
    held = asked.filter("current and not other").collect()
    assert held and all(r["args"] == [] for r in held)
    for r in asked.filter("not current and not other").collect():  # its flags make a choice hold
        values = C.read_flags(["--size", "15", "--align", "thai", *r["args"]]) if "--default" not in r["args"] else C.read_flags(r["args"], {"size": 15.0, "align": "thai"})
        assert all(json.loads(v) == values[k] for k, v in r["change"].items()), r
    assert C.font_said("--font", "Garuda") is None and C.font_said("--font", "Garuda\u2003") == "--font 'Garuda\u2003' begins or ends with a space (U+2003), which no font's name does, so the document names 'Garuda'"
    assert "is longer than the 31 characters" in C.font_said("--font", "x" * 40)
