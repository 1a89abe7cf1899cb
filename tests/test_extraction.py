"""Extraction and quality formulas, worked out by hand."""

import pytest
from gradus.operators import knowledge
from gradus.plans import extraction
from gradus.plans import triples
from pyspark.sql import functions as F

PROSE = "Plain words follow one another here and say very little at all. "


def checked(spark, texts, page=1800):
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    pages = [(i, t[k : k + page]) for i, t in texts.items() if t is not None for k in range(0, max(1, len(t)), page)]
    return {r.doc_id: r for r in extraction.five_checks(docs, spark.createDataFrame(pages, "doc_id string, text string")).collect()}


def test_five_checks(spark):
    got = checked(spark, {
        "good": PROSE * 10, "short": "Too short to be read.", "empty": "", "odd": "漢字かな交じり文 " * 60, "runs": ("x" * 60 + " ") * 10,
        "marks": "a!? b!? c!? " * 30, "numbers": "12345 67890 " * 40, "lost": PROSE * 28 + " " * 1700, "none": None,
    })
    assert "none" not in got  # no page
    g = got["good"]
    # 620 characters: yield 1, density 1, no penalty; 10 of 12 tokens are words but for "all."
    assert (g.extraction_yield, g.page_loss, g.text_density, g.gibberish, g.word_ratio, g.overall, g.passed, g.reason) == (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, True, "")
    s = got["short"]
    assert (s.extraction_yield, s.page_loss, s.text_density, s.passed, s.reason) == (0.053, 0.0, 0.105, False, "extraction_yield")
    assert (got["empty"].gibberish, got["empty"].word_ratio, got["empty"].overall, got["empty"].reason) == (0.0, 0.0, 0.0, "extraction_yield")
    assert (got["odd"].gibberish, got["odd"].word_ratio, got["odd"].passed) == (0.55, 0.0, False)  # 0.15 or more of other scripts
    assert (got["runs"].gibberish, got["runs"].word_ratio) == (0.65, 0.0)
    assert (got["marks"].gibberish, got["marks"].word_ratio, got["marks"].reason) == (0.7, 0.0, "word_ratio")  # 6 of 12 characters: over 0.30
    assert (got["numbers"].overall, got["numbers"].passed, got["numbers"].reason) == (0.85, False, "word_ratio")  # no word: fails alone
    assert (got["lost"].page_loss, got["lost"].passed) == (0.5, True)  # a second page of blanks: 0.85 + 0.2 * 0.5, no hard fail


def test_acceptance_bands(spark):
    rows = [("a", 0.65, 0.6, True), ("a", 0.64, 0.6, False), ("b", 0.80, 0.5, True), ("b", 0.79, 0.6, False), ("c", 1.0, 0.69, False), ("c", 0.0, 0.7, True), ("a", 0.87, 0.49, False), ("a", 0.88, 0.49, True), ("b", 0.91, 0.1, False), ("b", 0.92, 0.1, True)]
    df = spark.createDataFrame(rows, "verdict string, confidence double, chunk double, want boolean")
    got = df.select("want", extraction.accepts(F.col("verdict"), F.col("confidence"), F.col("chunk")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_compliance(spark):
    df = spark.createDataFrame([(1, "a", "", None), (2, "b", "x", 3), (3, None, None, 3)], "id long, name string, definition string, owner long")
    got = {r.property: r for r in extraction.compliance(df, ("id", "name", "definition", "owner")).collect()}
    assert {p: (r.missing, r.passed) for p, r in got.items()} == {"id": (0, True), "name": (1, False), "definition": (2, False), "owner": (1, False)}
    assert {r.score for r in got.values()} == {100 - 3 * 15} and got["definition"].percent == 66.666667


def test_predicates_and_entities(spark):
    names = {" is-a! ": "ISA", "part  of": "PART_OF", "y" * 60: "Y" * 60, "y" * 61: "", "": "", "über_x": "ÜBER_X"}
    got = spark.createDataFrame([(k,) for k in names], "x string").select("x", extraction.predicate(F.col("x")).alias("p")).collect()
    assert {r.x: r.p for r in got} == names
    names = {' "great  bath", ': "Great Bath", "x": "", "z" * 120: "Z" + "z" * 119, "z" * 121: "", "  ": ""}
    got = spark.createDataFrame([(k,) for k in names], "x string").select("x", extraction.entity(F.col("x")).alias("e")).collect()
    assert {r.x: r.e for r in got} == names


def test_builder_anchors_by_its_own_words(spark):
    df = spark.createDataFrame([("a matrix of probability",), ("काल and a program loop",), ("काल and a loop",)], "t string")
    got = [tuple(r) for r in df.select(triples.domain(F.col("t"), triples.DOMAINS), triples.domain(F.col("t"), triples.ANCHORS)).collect()]
    assert got == [("Mathematics", "General Knowledge"), ("Computer Science", "Computer Science"), ("Computer Science", "Hindi")]


def test_merged_concepts_keep_the_order_of_first_mention(spark):
    schema = "key string, at int, name string, definition string, examples array<string>"
    rows = [("k", 2, "K two", "", ["b", "a", "b"]), ("k", 1, "K", None, ["c", None, "b"]), ("k", 3, "k3", "third", None), ("k", 4, "k4", "fourth", ["d"]), ("", 1, "x", "y", ["z"]), (None, 1, "x", "y", ["z"]), ("e", 9, "E", None, None)]
    got = {r.key: (r["name"], r.definition, r.examples) for r in knowledge.merged_concepts(spark.createDataFrame(rows, schema), "key", ["at"], ["definition"], ["examples"]).collect()}
    assert got == {"k": ("K", "third", ["c", "b", "a", "d"]), "e": ("E", None, [])}


def test_graph_tables(spark):
    c = spark.createDataFrame([("k", "Cell", ["a nerve cell", "", None], None, ["grows"]), ("w", "Wall", ["a nerve cell"], ["x = 1"], [])], "key string, name string, examples array<string>, formulas array<string>, misconceptions array<string>")
    r = spark.createDataFrame([("cell ", "part of", "WALL"), ("cell", "PART  OF", "wall"), ("Cell", "is a", "cell"), ("Wall", None, "Cell"), ("Wall", "x", "Tree")], "from string, type string, to string")
    nodes, relations = knowledge.graph_tables(c, r, "key")
    assert sorted(x.label for x in nodes.collect()) == ["Cell", "Wall", "example: a nerve cell...", "example: a nerve cell...", "formula: x = 1...", "misconception: grows..."]
    assert sorted(x.type for x in relations.collect()) == ["EXAMPLES", "EXAMPLES", "FORMULAS", "MISCONCEPTIONS", "PART_OF", "RELATES_TO"]
    assert knowledge.dangling(nodes, relations).count() == 0
    assert {x.type for x in knowledge.dangling(nodes.where("kind <> 'formula'"), relations).collect()} == {"FORMULAS"}
    again = knowledge.graph_tables(c.repartition(3), r, "key")[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, nodes.collect()))


def test_sampled_questions(spark):
    slot = "1 as concept_id, 'recall' as question_type, 2 as difficulty"
    pool = spark.range(12).selectExpr("id as question_id", slot.split(", ")[0], "'recall' as question_type", "2 as difficulty", "id as created_at")
    now = "timestamp_ntz '2024-01-10 12:00:00'"
    seen = [(1, q, "2024-01-10 10:00:00") for q in range(9)] + [(1, 8, "2024-01-01 00:00:00")] + [(2, q, "2024-01-10 11:45:00") for q in range(10) if q != 4] + [(2, 4, "2024-01-10 11:00:00")] + [(3, q, "2024-01-10 11:59:00") for q in range(10)] + [(4, q, "2024-01-07 11:00:00") for q in range(10)]
    exposures = spark.createDataFrame(seen, "user_id long, question_id long, t string").select("user_id", "question_id", F.col("t").cast("timestamp_ntz").alias("shown_at"))
    requests = spark.range(1, 5).selectExpr("id as user_id", *["1 as concept_id", "'recall' as question_type", "2 as difficulty"])
    got = {r.user_id: (r.question_id, r.tier) for r in extraction.sampled_questions(requests, pool, exposures, F.expr(now)).collect()}
    assert got[1] == (9, 1)  # the only one of the ten oldest that was not seen
    assert got[2] == (4, 2) and got[3][1] == 3 and got[4][1] == 1  # four days ago is no exposure
    assert extraction.sampled_questions(requests, pool.where("false"), exposures, F.expr(now)).count() == 0
