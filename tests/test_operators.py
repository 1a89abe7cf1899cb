"""Order-dependent operators against plain Python, and properties."""

import itertools
import math

import numpy as np
import pytest
from gradus.functions import chunking
from gradus.functions import formulas as M
from gradus.operators import folds, graph
from gradus.plans import more
from gradus.sources import views
from pyspark.sql import functions as F


def likelihood(seqs, l0, t, s, g):
    total = 0.0
    for y in seqs:
        p = l0
        for right in y:
            seen = p * (1 - s) + (1 - p) * g
            total += math.log(max(seen if right else 1 - seen, 1e-10))
            post = p * (1 - s) / seen if right else p * s / (1 - seen)
            p = post + (1 - post) * t
    return total


def test_bkt_fit_is_the_best_of_the_grid(spark):
    rng = np.random.default_rng(1)
    rows = [(u, 1, i, u * 100 + i, bool(rng.random() < 0.4 + 0.05 * i)) for u in range(6) for i in range(7)]
    a = spark.createDataFrame(rows, "user_id long, concept_id int, created_at int, attempt_id long, correct boolean")
    got = folds.bkt_fit(a).first()
    seqs = [[r[4] for r in rows if r[0] == u] for u in range(6)]
    best = max(likelihood(seqs, *t) for t in folds.grid())
    assert got.log_likelihood == pytest.approx(best, abs=1e-3)
    assert likelihood(seqs, got.p_l0, got.p_t, got.p_s, got.p_g) == pytest.approx(best, abs=1e-9)
    assert len(folds.grid()) == 3360


def test_cycle_filter(spark):
    e = [(1, 2, "IS_A", 1, True), (2, 3, "IS_A", 2, True), (3, 1, "IS_A", 3, True), (1, 3, "IS_A", 4, True), (5, 6, "CAUSES", 5, False), (6, 5, "CAUSES", 6, False)]
    df = spark.createDataFrame([("g", *r) for r in e], "graph string, src long, dst long, rel string, edge_id long, dag boolean")
    kept = {r.edge_id: r.kept for r in graph.break_cycles(df).collect()}
    assert kept == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_khop_against_search(spark, sf):
    pairs = {(r.a, r.b) for r in graph.undirected(views.edges(spark, sf)).collect()}
    got = {(r.start, r.node): r.dist for r in graph.k_hop(graph.undirected(views.edges(spark, sf)), 3).collect()}
    want = {}
    for s in {a for a, _ in pairs}:
        seen, front = {s}, {s}
        for d in range(1, 4):
            front = {b for a, b in pairs if a in front} - seen
            seen |= front
            want |= {(s, n): d for n in front}
    assert got == want


@pytest.mark.parametrize("y", itertools.product([True, False], repeat=3))
def test_bkt_step_stays_in_bounds(spark, y):
    p = F.lit(0.25)
    for right in y:
        p = M.bkt_step(p, F.lit(right))
    assert 0 <= spark.range(1).select(p.alias("p")).first().p <= 1


def test_half_up(spark):
    got = [r.r for r in spark.createDataFrame([(-0.5,), (0.5,), (2.5,), (0.285,)], "x double").select(M.half_up(F.col("x"), 0).alias("r")).collect()]
    assert got == [0.0, 1.0, 3.0, 0.0]


def test_learning_gain_is_bounded(spark):
    rows = [(float(a), float(b)) for a in (0, 40, 60, 100) for b in (0, 40, 60, 100)]
    for r in spark.createDataFrame(rows, "a double, b double").select(M.learning_gain(F.col("a"), F.col("b")).alias("g")).collect():
        assert -1 <= r.g <= 1


def test_near_duplicate_chunks_of_very_long_texts(spark, monkeypatch):
    """Chunk 1,000 of document 1 is not chunk 0 of document 2; equal chunks are copies of the first, and pairs are of firsts."""
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "xy")
    near = " ".join([*(f"x{i}" for i in range(20)), "end"])
    rows = spark.createDataFrame([(1, 1000, one), (2, 0, two), (3, 0, one), (4, 2, one), (5, 0, near)], "doc_id long, chunk_index int, text string")
    monkeypatch.setattr(views, "chunks_fixed", lambda *_: rows)
    got = sorted(tuple(r) for r in more.near_duplicate_chunks(spark, "").collect())
    assert got == [("copy", 3, 0, 1, 1000, 1.0), ("copy", 4, 2, 1, 1000, 1.0), ("pair", 1, 1000, 5, 0, 0.941176)]


def test_natural_chunks():
    """Hand-made: 1,000 characters are one chunk and, as the overlap of the end, a second; sentences end chunks; poor chunks go."""
    a = "x" * 1000
    assert [len(t) for _, t in chunking.natural_chunks(a)] == [1000, 150]
    s = ("word " * 159 + "stop. ") + "tail " * 100
    first, *_ = chunking.natural_chunks(s)
    assert first == (0, ("word " * 159 + "stop.").strip())
    assert chunking.natural_chunks("| a | b | c | d |\n" * 4) != [] and chunking.natural_chunks("Figure 3: the sum ∑ of parts of the whole cycle, drawn") == []
    assert chunking.natural_chunks("   ") == [] and chunking.natural_chunks("too short") == []


def test_chunk_score():
    plain = "A sentence of plain words that goes on for a while. " * 3
    assert chunking.chunk_score(plain, False) == 1.0 and chunking.chunk_score(plain, True) == 0.9
    assert chunking.chunk_score("short", False) == 0.7 and chunking.chunk_score(plain + " ∑ x", False) == 0.85
    assert chunking.chunk_score("| a | b | " + plain, False) == 0.75
    assert chunking.chunk_score(plain + "漢" * 20, False) == pytest.approx(0.7)


def test_packed_chunks():
    assert [t for _, t in chunking.packed_chunks("y" * 1000)] == ["y" * 1000]
    assert [len(t) for _, t in chunking.packed_chunks("y" * 1001)] == [1000, 301]
    parts = ["a" * 600 + "\n\n", "b" * 600]
    one, two = (t for _, t in chunking.packed_chunks("".join(parts)))
    assert one == "a" * 600 and two == ("a" * 148 + "\n\n" + "b" * 600)


def test_clean_page():
    text = "Head\nhead\nHEAD\n24\n2019-20\nwww.example.com\nkeep this\nkeep this\n\n\n\n\nend https://x.y in text"
    assert chunking.clean_page(text) == "Head\nkeep this\nkeep this\n\nend https://x.y in text"


def test_repetition_cleaning(spark, tmp_path):
    spark.createDataFrame([(1, "red, red, red and and blue!!!!!! a, b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert more.repetition_cleaning(spark, str(tmp_path)).first().cleaned_chars == len("red and blue! a, b")


def test_pseudo_embeddings(spark, sf):
    rows = more.pseudo_embeddings(spark, sf).limit(20).collect()
    assert all(len(r.v) == len(rows[0].v) and all(math.isfinite(x) for x in r.v) for r in rows)
    assert len({tuple(r.v) for r in rows}) > 1


def test_session_evaluation_against_a_plain_fold(spark, sf):
    from gradus.plans import models

    got = {r.session_id: r for r in models.session_evaluation(spark, sf).collect()}
    a = sorted(views.attempts(spark, sf).collect(), key=lambda r: (r.user_id, r.concept_id, r.n))
    stages, half = ["diagnostic", "practice", "mastery"], lambda x: math.floor(x + 0.5)
    for _, rows in itertools.groupby(a, key=lambda r: (r.user_id, r.concept_id)):
        mastery, stage, at, base, first = 0.0, "diagnostic", None, None, None
        for sid, part in itertools.groupby(rows, key=lambda r: r.session_id):
            part = list(part)
            plain = [r for r in part if not r.is_spaced]
            score = 100 * float(np.mean([r.correct for r in plain or part]))
            now, mode = max(r.created_at for r in part), part[0].mode
            hours = 0 if at is None else (now - at).total_seconds() / 3600
            pre = mastery if hours <= 0 else half(mastery * math.exp(-0.05 * hours / 24) * 100) / 100
            p = pre / 100
            for r in plain:
                k, o = (p * 0.92, (1 - p) * 0.25) if r.correct else (p * 0.08, (1 - p) * 0.75)
                p = k / (k + o)
                p += (1 - p) * 0.12
            mastery, at = float(half(score if mode == "diagnostic" else 100 * p)), now
            if score >= 80 and stages.index(mode) <= (stages.index(stage) if stage in stages else -1) + 1:
                stage = [*stages[1:], "complete"][stages.index(mode)]
            before = base if base is not None else first if first is not None else mastery
            gain = (mastery - before) / (100 - before) if mastery > before else (mastery - before) / before if mastery < before else 0.0
            r = got[sid]
            assert (r.score, r.passed, r.path, r.post_mastery, r.next_stage) == (half(score), score >= 80, "test_it" if score >= 80 else "learn_it", mastery, stage)
            assert r.pre_mastery == pytest.approx(pre) and r.nlg == pytest.approx(gain, abs=1e-4)
            first = score if first is None else first
            base = score if base is None and mode == "diagnostic" else base


@pytest.mark.parametrize("size", [3, 10_000])
def test_ordered_fold_carries_its_state_over_batches(spark, size):
    """Keys that span batches, end with one, and have a single row; null keys are left out."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    rows = [(k, i, k * 100 + i) for k in range(9) for i in range(k % 4 * 3 + 1)] + [(None, 1, 5)]
    df = spark.createDataFrame(rows, "k long, i int, v long").repartition(4)
    try:
        spark.conf.set(conf, str(size))
        got = {r.k: (r.first, r.folded) for r in folds.ordered_fold(df, "k", ["i"], ["v"], lambda v: (v, 0), lambda s, v: (s[0], (s[1] * 31 + v) % 1_000_003), lambda k, s: (k, *s), "k long, first long, folded long").collect()}
        none = folds.ordered_fold(df.where("false"), "k", ["i"], ["v"], lambda v: v, lambda s, v: s, lambda k, s: (k, s), "k long, v long").count()
    finally:
        spark.conf.set(conf, before)
    want = {}
    for k in range(9):
        state = 0
        for v in sorted(v for key, _, v in rows if key == k):
            state = (state * 31 + v) % 1_000_003
        want[k] = (k * 100, state)
    assert got == want and none == 0
