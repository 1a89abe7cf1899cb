"""Repeats and keys, worked out by hand."""

import hashlib

from gradus.plans import dedup
from pyspark.sql import functions as F


def test_heading_fragments(spark, tmp_path):
    lines = {1: ["What w", "What w", "what  Was special?", "0 end 0"], 2: ["only"], 3: ["a b", "AB c", "abcd", "x"], 4: []}
    kept = {1: ["what  Was special?", "0 end 0"], 2: ["only"], 3: ["abcd", "x"]}
    spark.createDataFrame([(i, "\n \n".join(x)) for i, x in lines.items()] + [(5, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.lines, r.fragments, r.kept_chars) for r in dedup.heading_fragments(spark, str(tmp_path)).collect()}
    assert got == {i: (len(lines[i]), len(lines[i]) - len(x), sum(map(len, x))) for i, x in kept.items()}
    df = spark.createDataFrame([(x,) for x in lines.values()], "l array<string>")
    assert [r.k for r in df.select(dedup.without_fragments(F.col("l")).alias("k")).collect()] == [*kept.values(), []]


def test_relations_that_differ_in_wording_only(spark):
    rows = [(3, "The Cell", "part of", "a Plant"), (1, "cell ", "PART  OF", "plant"), (2, "theory", "part of", "plant"), (4, None, "is a", "x"), (5, "", "is a", "the x")]
    got = {(r["at"], r.subject, r.n) for r in dedup.deduplicated(spark.createDataFrame(rows, "at long, subject string, relation string, object string"), "at").collect()}
    assert got == {(1, "cell ", 2), (2, "theory", 1), (4, None, 2)}


def test_cache_keys(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    c = lambda x: F.lit(x)
    one = spark.range(1).select(dedup.triple_hash(c(" Cell"), c("is_a "), c("Thing"), c("  the text ")).alias("t"), dedup.explanation_hash(c("A  gap"), c("Right "), c("wrong\tone"), c("Cell"), F.array(c(" a -> b "), c("b"))).alias("e")).first()
    assert one.t == sha("cell||IS_A||thing||" + sha("the text"))
    assert one.e == sha("a gap||right||wrong one||cell||a -> b >> b")
