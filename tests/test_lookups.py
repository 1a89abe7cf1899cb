"""Lookups, dropped triples, exported lines and uploaded files, worked out by hand."""

import csv
import zipfile

from gradus.plans import lookups
from gradus.sources import files, uploads
from pyspark.sql import functions as F


def test_questions_by_filters(spark):
    rows = [("q3", 1, "b", "easy", "mcq", '["x","y"]'), ("q1", 1, "a", "hard", "mcq", '["x"'), ("q2", 1, "a", "easy", "tf", None), ("q4", 2, "a", "medium", "mcq", "[]"), ("q5", 1, "a", "hard", "mcq", "{}")]
    q = spark.createDataFrame(rows, "question_id string, doc long, concept string, difficulty string, q_type string, options string")
    asked = [(10, 1, None, None, 9), (11, 1, "hard", None, 1), (12, 1, None, "tf", 5), (13, 3, None, None, 5), (14, 1, None, None, 0), (15, None, None, None, 5), (16, 1, "easy", "tf", 200)]
    r = spark.createDataFrame(asked, "request long, doc long, difficulty string, q_type string, most int")
    got = {}
    for x in lookups.asked_questions(r, q).orderBy("request", "place").collect():
        got.setdefault(x.request, []).append((x.question_id, x.options))
    assert got == {10: [("q2", []), ("q3", ["x", "y"]), ("q1", []), ("q5", [])], 11: [("q1", [])], 12: [("q2", [])], 16: [("q2", [])]}


def test_no_request_gets_more_than_the_limit(spark):
    q = spark.range(500).select(F.format_string("q%03d", "id").alias("question_id"), F.lit(1).cast("long").alias("doc"), F.lit("c").alias("concept"), F.when(F.col("id") % 2 == 0, "easy").otherwise("hard").alias("difficulty"), F.lit("mcq").alias("q_type"), F.lit("[]").alias("options"))
    r = spark.createDataFrame([(1, 1, None, None, 1000), (2, 1, "hard", None, 3)], "request long, doc long, difficulty string, q_type string, most int")
    got = lookups.asked_questions(r, q).orderBy("request", "place").collect()
    assert [x.question_id for x in got if x.request == 1] == [f"q{i:03d}" for i in range(0, 400, 2)]
    assert [x.question_id for x in got if x.request == 2] == ["q001", "q003", "q005"]


def test_why_triples_are_dropped(spark):
    rows = [(" Cell ", "is a", "Tissue", True, None), ("", "is a", "x", True, "empty_endpoint"), ("x", "is a", None, True, "empty_endpoint"), ("The Cell", "is a", "cell!", True, "self_loop"), ("Theory of Cells", "is a", "cells process", False, "self_loop"), ("cell", "made  up", "tissue", None, "unknown_predicate:MADE_UP"), ("cell", None, "tissue", None, "unknown_predicate:")]
    df = spark.createDataFrame(rows, "s string, r string, o string, known boolean, want string")
    for x in df.select("want", lookups.drop_reason(F.col("s"), F.col("r"), F.col("o"), F.col("known")).alias("got")).collect():
        assert x.got == x.want


def test_export_reads_back_as_csv(spark, tmp_path):
    rows = [(1, 2, 'say "a", b', 0.5), (1, 1, "plain", None), (2, 1, None, 1.0), (1, 3, "semi;colon", 2.0)]
    df = spark.createDataFrame(rows, "who int, at int, note string, x double")
    lines = files.export_lines(df, "who", ["at", "note", "x"], ["at"], "Title")
    files.write_lines(lines, "who", str(tmp_path / "out"))
    text = {w: "".join(p.read_text() for p in sorted((tmp_path / "out" / f"who={w}").glob("part*"))) for w in (1, 2)}
    assert text[1].split("\n")[:5] == ["# Title", "# who: 1", "# total_attempts: 3", "#", "at,note,x"]
    assert text[1].split("\n")[5:8] == ["1,plain,", '2,"say ""a"", b",0.5', "3,semi;colon,2.0"]
    assert list(csv.reader(text[2].splitlines()[4:])) == [["at", "note", "x"], ["1", "", "1.0"]]


def _docx(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_uploaded_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _docx(tmp_path / "in" / "short.docx", ["one two", "three &amp; four"])
    _docx(tmp_path / "in" / "Long.DOCX", ["word " * 600])
    (tmp_path / "in" / "broken.docx").write_bytes(b"PK no archive")
    (tmp_path / "in" / "big.docx").write_bytes(b"x" * ((1 << 20) + 1))
    (tmp_path / "in" / "notes.txt").write_text("text")
    (tmp_path / "in" / "empty.docx").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[-1]: r for r in uploads.read_uploads(spark, str(tmp_path / "in"), max_mb=1).collect()}
    assert {k: r.error for k, r in got.items()} == {"short.docx": None, "Long.DOCX": None, "broken.docx": "unreadable", "big.docx": "size", "notes.txt": "type"}  # the empty file is no row
    assert got["short.docx"].text == "one two\n\nthree & four" and got["short.docx"].n_words == 5
    assert got["short.docx"].warnings == ["only 5 words (at least 500 recommended)"] and got["Long.DOCX"].warnings == []
    own = uploads.read_uploads(spark, str(tmp_path / "in"), readers={"txt": lambda b: b.decode()}, least_words=1)
    assert [(r.text, r.warnings) for r in own.where("error is null").collect()] == [("text", [])]
