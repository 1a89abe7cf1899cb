"""Distractors of many documents at a time against a plain search, and what the questions made from them plan."""

import re
from collections import Counter
from math import floor, sqrt

import numpy as np
import pytest
from gradus.operators import distractors, support
from gradus.plans import catalogue, triples
from pyspark.sql import functions as F


def plain(edges, names):
    """Answers with their (dist, node), by search from each."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    grams = {n: Counter(x[i : i + 2] for i in range(len(x) - 1)) for n, x in names.items()}
    found = {}
    for s in near:
        seen, front, options = {s}, {s}, []
        for d in range(1, 4):
            front = {y for x in front for y in near[x]} - seen
            seen |= front
            for y in front:
                g, h = grams.get(s, {}), grams.get(y, {})
                dot, norms = sum(g[k] * h.get(k, 0) for k in g), sqrt(sum(v * v for v in g.values())) * sqrt(sum(v * v for v in h.values()))
                if dot and dot / norms >= (0.18 if d == 3 else 0.12):
                    options.append((d, y))
        options.sort()
        first = [o for i, o in enumerate(options) if i == 0 or options[i - 1][0] != o[0]]
        found[s] = (first + [o for o in options if o not in first])[:3]
    return found


def test_distractors_of_small_and_large_documents(spark, monkeypatch):
    """Documents of 2 to 200 concepts, of which some have no name or one that repeats its pairs, in slices of three; one has no relation and one only a loop."""
    monkeypatch.setattr(distractors, "DOCS", 3)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for doc, size in enumerate([2, 200, 20, 65, 0, 64, 20, 1, 130]):
        nodes = [int(x) for x in rng.permutation(size) + 1000 * (8 - doc)]
        edges = [(nodes[i], nodes[j]) for i, j in rng.integers(0, max(size, 1), (size * 6 // 5, 2))]
        edges += [(n, n) for n in nodes[:1]]
        names = {n: "".join(rng.choice(list("aBcdeé 01"), int(rng.integers(0, 9)))) for n in nodes if rng.random() < 0.9}
        rows.append((doc, edges, list(names.items())))
        want[doc] = plain(edges, {n: x.replace("é", "").lower() for n, x in names.items()})
    df = spark.createDataFrame(rows, "doc long, edges array<struct<src: long, dst: long>>, concepts array<struct<node: long, name: string>>").coalesce(1)
    got = {r.doc: {x.answer: [tuple(p) for p in x.picks] for x in r.p} for r in df.select("doc", distractors.picks(F.col("edges"), F.col("concepts")).alias("p")).collect()}
    assert got == want and {len(p) for x in want.values() for p in x.values()} == {0, 1, 2, 3} and {p[0] for p in want[1].values() for p in p} == {1, 2, 3}


def test_distractors_are_found_without_expressions_of_hops(spark, sf):
    """hops and likenesses as nested array expressions took over a millisecond for each answer; graphs now go to numpy, many at a time."""
    plan = catalogue.QUERIES["distractors"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "array_except" not in plan and len(re.findall("Join", plan)) == 1, plan


@pytest.mark.parametrize("name", ["question_validity", "question_export"])
def test_questions_are_made_in_their_documents_row(spark, sf, name):
    """every edge was compared with every chunk of its document, and questions met their options in a join shuffled by the answer."""
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    assert len(keys) == 1 and keys[0].startswith("doc#") and len(re.findall("Join ", plan)) == 1, plan


@pytest.mark.parametrize("name", ["question_overall", "question_report"])
def test_marks_write_no_texts(spark, sf, name, monkeypatch):
    """the marks were counted from questions written with their chunks, in as few tasks as these had bytes, and options pair by pair in nested expressions."""
    kept, write = [], triples.written
    monkeypatch.setattr(triples, "written", lambda df: kept.append(df.columns) or write(df))
    catalogue.QUERIES[name](spark, sf)
    assert len(kept) == 1 and not {"text", "question", "wrong"} & set(kept[0]), kept


def test_support_against_a_plain_search(spark):
    """Names that are the beginning of others, chunks of which only the first 400 characters count, equal scores, and a document without chunks."""
    names = {1: "Concept 1", 2: "Concept 2", 11: "Concept 11", 12: "The  wide Concept"}
    long = "concept 2 " + "x" * 390 + " CONCEPT 12"
    edges = [(7, 1, 2, 1.0), (5, 1, 2, 1.0), (3, 2, 1, 0.5), (4, 11, 12, 0.7), (6, 12, 12, 0.7)]
    rows = [(0, edges, [(3, "Concept 11 and concept 2."), (1, long)], list(names.items())), (1, edges[:1], [], list(names.items()))]
    schema = "doc long, edges array<struct<edge_id: long, src: long, dst: long, weight: double>>, chunks array<struct<chunk: int, text: string>>, concepts array<struct<node: long, name: string>>"
    got = {r.doc: [tuple(m) for m in r.m] for r in spark.createDataFrame(rows, schema).select("doc", support.marks(F.col("edges"), F.col("chunks"), F.col("concepts")).alias("m")).collect()}

    def want(edges, chunks):
        times, out = Counter(x for e in edges for x in e[1:3]), []
        for i, s, d, w in edges:
            a, b = names[s].lower(), names[d].lower()
            ranked = sorted((0 if a in t.lower() and b in t.lower() else 1 if a in t.lower() else 2, k, t) for k, t in chunks)
            t = ranked[0][2][:400].lower() if ranked else ""
            sup = 0.0 if not ranked else 1.0 if a in t and b in t else 0.65 if a in t else 0.4 if b in t else 0.1
            bare = re.sub(r"\s+", " ", re.sub(r"^(the|a|an)\s+", "", b)).strip(" ")
            n, chars = len(bare.split()), len(bare.replace(" ", ""))
            spec = 0.6 * {1: 0.55, 2: 0.8}.get(n, 1.0) + 0.4 * min(1.0, max(0.0, (chars - 2) / 10))
            score = 0.22 * w + 0.22 * times[s] / max(times.values()) + 0.12 * times[d] / max(times.values()) + 0.24 * sup + 0.12 * spec + 0.08 * (s != d)
            out.append((floor(score * 1e4 + 0.5) / 1e4, ranked[0][1] if ranked else None, i, s))
        best = {s: min(((-x[0], x[2]) for x in out if x[3] == s))[1] for s in {x[3] for x in out}}
        return [(x[0], x[1], best[x[3]] == x[2]) for x in out]

    assert got == {0: want(edges, rows[0][2]), 1: want(edges[:1], [])}
    assert [m[1] for m in got[0]] == [1, 1, 1, 3, 1] and got[1][0][1] is None
