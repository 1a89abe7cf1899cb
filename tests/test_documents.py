"""Queries whose work lies within a document: results against the operators over whole graphs, and what their plans send."""

import re

import pytest
from gradus.functions import text
from gradus.operators import graph
from gradus.plans import catalogue
from gradus.sources import views
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sent(df) -> list[str]:
    """The shuffles of a plan by their keys."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan(df))


@pytest.mark.parametrize("name", ["bigram_cosine", "distractors", "fuzzy_nodes", "question_validity"])
def test_no_concepts_are_broadcast(spark, sf, name):
    """The planner takes a document's concepts for as few as the documents."""
    keys = re.findall(r"Broadcast(?:HashJoin|NestedLoopJoin) (\S*)", plan(catalogue.QUERIES[name](spark, sf)))
    assert all(k.startswith("[idx#") for k in keys), keys


@pytest.mark.parametrize("name", ["khop", "khop_directed", "khop_nearest", "shortest_path", "bigram_cosine", "distractors", "best_chunks", "triple_scores", "best_triples", "neighbours_by_length"])
def test_only_documents_are_shuffled(spark, sf, name):
    keys = sent(catalogue.QUERIES[name](spark, sf))
    assert keys and all(re.fullmatch(r"doc#\d+L", k) for k in keys), keys


def test_hops_and_paths_within_documents_are_those_of_the_whole_graph(spark, sf):
    e = views.doc_edges(spark, sf)
    h = graph.hops_within(graph.undirected(e, "doc"), 3).select("start", F.explode("near").alias("x")).select("start", "x.node", "x.dist")
    assert sorted(map(tuple, h.collect())) == sorted(map(tuple, graph.k_hop(graph.undirected(e), 3).collect()))
    assert sorted(map(tuple, graph.paths_within(e).collect())) == sorted(map(tuple, graph.shortest_paths(e).collect()))


def test_grams_that_stand_twice_count_by_their_product(spark):
    names = spark.createDataFrame([(0, 1, "aaaa b"), (0, 2, "AAA"), (0, 3, "ab ab"), (0, 4, "x")], "doc long, node long, name string")
    g = {x.node: x for x in graph.gram_counts(names).first().grams}
    assert g[1].c == {ord("a") * 129: 3.0, ord("a") * 128 + 32: 1.0, 32 * 128 + ord("b"): 1.0} and not g[1].plain and g[4].own == []
    d = graph.gram_counts(names).select(F.explode("grams").alias("x"), "grams").select("x", F.explode("grams").alias("y"))
    got = {(r[0], r[1]): r[2] for r in d.select("x.node", "y.node", graph.gram_dot(F.col("x"), F.col("y"))).collect()}
    assert (got[1, 2], got[2, 1], got[1, 3], got[4, 1], got[3, 3]) == (6.0, 6.0, 0.0, 0.0, 6.0)


@pytest.mark.parametrize("name", ["question_report", "question_overall"])
def test_marks_of_questions_are_neither_broadcast_nor_shuffled(spark, sf, name):
    """F8: a table of a row for each question was broadcast through the driver, being taken for small by the size of its columns in the file."""
    df = catalogue.QUERIES[name](spark, sf)
    assert "Join" not in plan(df) and all(k.startswith("difficulty#") for k in sent(df)), plan(df)


def test_cosines_of_a_rows_texts_are_those_of_their_pairs(spark):
    texts = ["", "x", "aaaa b", "AAA-a!", "ab ab", "Où est Concept 9?", "concept 9"]
    rows = [(a, b) for a in texts for b in texts] * 6 + [("ab", "")]  # the last of 295 rows, in the second table, has an empty text
    d = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    d = d.withColumn("s", text.pair_cosines({"a": F.col("a"), "b": F.col("b")}, [("a", "b")]))
    got = d.select("s.a_b", text.pair_cosine(text.character_pairs(F.col("a")), text.character_pairs(F.col("b")))).collect()
    assert len(got) == 295 and all(x == y for x, y in got) and len({x for x, _ in got}) == 4
    assert d.where("false").select("s.*").collect() == []
