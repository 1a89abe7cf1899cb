"""The registered queries against their SQL, or against brute force, on the smallest tables."""

import collections
import hashlib
import re

import pandas as pd
import pytest
from compare import check, duck
from gradus.llm import minhash, queries

W = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf):
    return duck(sf).sql("select doc_id, text from documents order by 1").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    check(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


def test_substrings(spark, sf, docs):
    first, want = {}, {}
    for i, text in docs:
        words = W.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - 49):
            if first.setdefault(tuple(words[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        want[i] = (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substrings(spark, sf).collect()}
    assert got == want


def test_pii_base(spark, sf, docs):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def good(k, m):
        digits = re.sub(r"\D", "", m)
        return (True, k == 1 and all(int(p) <= 255 for p in m.split(".")), k == 2 and 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[k]

    got = {r.doc_id: r for r in queries.op3_pii(spark, sf).collect()}
    for i, text in docs:
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text or "") if good(k, m.group()))
        written = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in spans)
        n = collections.Counter(k for _, k, _ in spans)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in range(4))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))


def test_quality_base(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op6_quality(spark, sf).collect()}
    for i, text in docs:
        text = text or ""
        w = W.findall(text)
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if W.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def groups(items, linked):
    up = {i: i for i in items}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in items}


def test_near_groups(spark, sf, docs):
    """Every pair of texts that has a word sequence in common, by the exact probability Jaccard."""
    of = {i: minhash.weighted(minhash.shingle_hashes(W.findall(t or ""))) for i, t in docs}
    ids = sorted(i for i in of if len(of[i][0]))
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if minhash.probability_jaccard(of[a], of[b]) >= 0.8]
    assert {r.doc_id: r.class_id for r in queries.op8_minhash(spark, sf).collect()} == groups(of, links)


def test_packing(spark, sf, docs):
    p = queries.op5_packing(spark, sf).toPandas()
    assert p.n_words.sum() == sum(len(W.findall(t or "")) for _, t in docs)
    bins = p.groupby("sequence_id").agg(capacity=("capacity", "first"), used=("used", "first"), words=("n_words", "sum"), kinds=("capacity", "nunique"))
    assert (bins.used == bins.words).all() and (bins.used <= bins.capacity).all() and (bins.kinds == 1).all()
    assert bins.used.sum() / bins.capacity.sum() > 0.9
    for _, rows in p.sort_values(["sequence_id", "at"]).groupby("sequence_id"):
        assert rows["at"].tolist() == [0, *rows.n_words.cumsum().tolist()[:-1]]


def test_mixing_comes_near_its_targets(spark, sf):
    p = queries.op10_mixing(spark, sf).toPandas()
    g = p.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert ((g.taken - g.target).abs() <= 2 * g.largest).all()
    assert (p.taken <= 2 * p["size"]).all()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    t = queries.op4_toxicity(spark, sf).where("held_out").toPandas()
    m = t.merge(pd.DataFrame(duck(sf).sql("select doc_id, toxic from labels").fetchall(), columns=["doc_id", "toxic"]), on="doc_id")
    assert m[m.toxic == 1].predicted.mean() > 0.85
    assert m[m.toxic == 0].predicted.mean() < 0.08
