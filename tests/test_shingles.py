"""Sets of shingles against plain Python, and what near_duplicate_chunks writes."""

import re

import numpy as np
import pyarrow as pa
from gradus.functions import shingles
from gradus.plans import more


def test_sets_are_those_of_runs_of_words(monkeypatch):
    monkeypatch.setattr(shingles, "TEXTS", 3)
    rng = np.random.default_rng(2)
    texts = ["", "a b c d", "a b c d e", "É a b!c,d e  é", "aB-Cd x1 y2 aB cD x1 y2 ab cd x1 y2", "ab c d e f a b c d e f", "K a b c d Kelvin"]
    texts += [" ".join(rng.choice(["a", "b", "ab", "ba", "Ü", "z9"], int(n))) for n in rng.integers(0, 60, 40)]
    plain = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (re.findall("[a-z0-9]+", t.lower()) for t in texts)]
    got = shingles.shingle_sets(pa.array(texts, pa.string()))
    assert [len(g) for g in got] == [len(p) for p in plain] and all((g[1:] > g[:-1]).all() for g in got)
    for i, p in enumerate(plain):
        for j, q in enumerate(plain):
            assert len(np.intersect1d(got[i], got[j])) == len(p & q)
            assert not p or not q or (shingles.jaccard(got[i], got[j]), shingles.set_key(got[i]) == shingles.set_key(got[j])) == (len(p & q) / len(p | q), p == q)
    assert len(set().union(*plain)) == len(np.unique(np.concatenate(got))) and shingles.shingle_sets(pa.array([], pa.string())) == []


def test_no_whole_sets_are_written_or_shuffled(spark, sf, monkeypatch):
    """the sets of all chunks, longer than their texts, were written once and shuffled three times."""
    kept, write = [], more.written
    monkeypatch.setattr(more, "written", lambda df: kept.append(df.columns) or write(df))
    plan = more.near_duplicate_chunks(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert kept == [["k", "id", "n", "p"], ["a", "b"]] and "array_intersect" not in plan and "array_union" not in plan, kept
