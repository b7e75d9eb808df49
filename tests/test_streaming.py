from loomleaf.streaming.verdicts import arriving_packages, check_arriving, latest_verdicts
from packages import clean, packed, planted


def test_files_are_judged_as_they_come(spark, tmp_path):
    files, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    files.mkdir()
    (files / "a.docx").write_bytes(packed(clean()))
    (files / "b.docx").write_bytes(planted("word/document.xml", "<w:cs/>", ""))
    (files / "note.txt").write_bytes(b"x")

    def run():
        check_arriving(arriving_packages(spark, str(files)), out, state).trigger(availableNow=True).start().awaitTermination()
        return {r["doc"].rpartition("/")[2]: r["exit_code"] for r in latest_verdicts(spark, out).collect()}

    assert run() == {"a.docx": 0, "b.docx": 1}
    (files / "c.docx").write_bytes(b"damaged")
    (files / "copy.docx").write_bytes(packed(clean()))
    assert run() == {"a.docx": 0, "b.docx": 1, "c.docx": 2, "copy.docx": 0}  # a copy has a verdict too
    assert spark.read.parquet(out + "/contents").count() == 3  # each content is judged once
    assert spark.read.parquet(out + "/files").count() == 4
