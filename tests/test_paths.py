"""Components, cycle removal and paths against plain searches."""

import random

import pytest
from gradus.operators import components, fuzzy, graph
from gradus.plans import paths
from gradus.sources import views
from pyspark.sql import functions as F


def reachable(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    return reach


def plain_components(pairs):
    reach = reachable([(a, b) for a, b in pairs if a != b])
    return {a: min(b for b in seen if a in reach[b]) for a, seen in reach.items() if a in seen}


def some_graph(rng, nodes, edges):
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]


GRAPHS = {
    "chain into a ring": [(i, i + 1) for i in range(30)] + [(30, 20), (40, 20), (7, 7)],
    "rings that share a node": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2), (5, 0), (4, 6)],
    "sparse": some_graph(random.Random(1), 60, 60),
    "dense": some_graph(random.Random(2), 25, 90),
    "no cycle": [(i, j) for i in range(8) for j in range(i + 1, 8)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_strong_components(spark, name):
    df = spark.createDataFrame(GRAPHS[name], "src long, dst long")
    assert {r.node: r.component for r in components.strong_components(df).collect()} == plain_components(GRAPHS[name])


def test_rounds_that_do_not_settle_raise(spark):
    with pytest.raises(RuntimeError):
        components.strong_components(spark.createDataFrame([(i, (i + 1) % 40) for i in range(40)], "src long, dst long"), rounds=2)


def plain_acyclic(edges):
    """Edges that go: loops, and back edges of one search of the whole graph that stays inside components."""
    dag = [e for e in edges if e[4]]
    of = plain_components([(e[0], e[1]) for e in dag])
    inside = [(s, d, i) for s, d, _, i, _ in sorted(dag, key=lambda e: e[3]) if s != d and s in of and of[s] == of.get(d)]
    return graph.back_edges(inside) | {i for s, d, _, i, _ in dag if s == d}


def test_acyclic_graph_over_documents(spark, sf):
    edges = [(r.src, r.dst, r.rel, r.edge_id, r.dag) for r in views.linked_edges(spark, sf).collect()]
    got = {r.edge_id: r.kept for r in paths.acyclic_graph(spark, sf).collect()}
    assert len(got) == len(edges) == len({e[3] for e in edges})
    assert {i for i, kept in got.items() if not kept} == plain_acyclic(edges)
    assert not plain_components([e[:2] for e in edges if e[4] and got[e[3]]])
    across = {views.DOC_NODES * k for k in range(10_000)}
    assert any(e[0] in across or e[1] in across for e in edges)


def test_acyclic_keeps_other_relations(spark):
    e = [(1, 2, "IS_A", 1, True), (2, 3, "REQUIRES", 2, True), (3, 1, "PART_OF", 3, True), (1, 3, "IS_A", 4, True), (5, 5, "IS_A", 5, True), (6, 5, "CAUSES", 6, False), (5, 6, "CAUSES", 7, False)]
    df = spark.createDataFrame(e, "src long, dst long, rel string, edge_id long, dag boolean")
    assert {r.edge_id: r.kept for r in components.acyclic(df).collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True}
    assert components.acyclic(df.where("false")).count() == 0


TEXTS = [("d", 1, "Cell"), ("d", 2, "the CELL WALL of plants"), ("d", 3, ""), ("d", 4, None), ("d", 5, "x"), ("e", 6, "cell"), ("d", 7, "wall"), ("d", 8, "a" * 49 + " nucleus"), ("d", 9, "Ñ"), ("f", 10, "cell"), ("d", 11, "e")]
NAMES = [("d", 1, "Cell wall"), ("d", 2, "cell"), ("d", 3, "Nucleus"), ("d", 4, "X"), ("e", 5, "Cell"), ("d", 6, "ñandú"), ("d", 7, ""), ("d", 8, None), ("d", 9, "el")]


def test_named_nodes(spark):
    got = fuzzy.named_nodes(spark.createDataFrame(TEXTS, "doc string, id long, text string"), spark.createDataFrame(NAMES, "doc string, node long, name string"))
    want = set()
    for d, i, t in TEXTS:
        for e, n, name in NAMES:
            x, y = (t or "")[:50].lower(), (name or "").lower()
            if d == e and x.strip() and y and (x in y or y in x):
                want.add((d, i, n))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 8


def test_paths_between(spark):
    rng = random.Random(3)
    edges = [(a, b, rng.choice("RST")) for a, b in some_graph(rng, 40, 60)]
    names = [(i, f"n{i}") for i in range(40)]
    ends = {i: (rng.sample(range(40), 2), rng.sample(range(40), rng.randint(0, 2))) for i in range(30)}
    step = {}
    for a, b, r in edges:
        for x, y in ((a, b), (b, a)):
            if x != y:
                step[x, y] = min(step.get((x, y), r), r)
    want = {}
    for i, (starts, stops) in ends.items():
        best = None
        for s in starts:
            ways, seen = {s: []}, {s}
            for d in range(1, 5):
                nxt = {}
                for (x, y), r in step.items():
                    if x in ways and y not in seen:
                        p = [*ways[x], f"n{x} -[{r}]-> n{y}"]
                        nxt[y] = min(nxt.get(y, p), p)
                seen |= nxt.keys()
                ways = nxt
                found = [(d, s, y, p) for y, p in ways.items() if y in stops and y != s]
                best = min([*found, *([best] if best else [])], default=None)
        if best:
            want[i] = best
    flat = lambda k: spark.createDataFrame([(i, n) for i, e in ends.items() for n in e[k]], "id long, node long")
    steps = fuzzy.labelled_steps(spark.createDataFrame(edges, "src long, dst long, rel string"), spark.createDataFrame(names, "node long, name string"))
    got = {r.id: (r.dist, r.start, r.end, list(r.path)) for r in fuzzy.paths_between(flat(0), flat(1), steps).collect()}
    assert got == want and len({d for d, *_ in want.values()}) > 2


def test_no_step_compares_all_pairs(spark, sf):
    names = views.nodes(spark, sf).withColumn("doc", views.doc_of(F.col("node")))
    asked = paths.answer_pairs(spark, sf).select("doc", "id", F.col("student").alias("text"))
    plan = fuzzy.named_nodes(asked, names)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_searches_from_some_starts(spark, sf):
    e = views.edges(spark, sf)
    starts = spark.createDataFrame([(3,), (45,), (3,), (-1,)], "start long")
    pairs = graph.undirected(e)
    every = {tuple(r) for r in graph.k_hop(pairs, 3).where("start in (3, 45)").collect()}
    assert {tuple(r) for r in graph.k_hop(pairs, 3, starts).collect()} == every and len(every) > 5
    every = {tuple(r) for r in graph.shortest_paths(e).where("start in (3, 45)").collect()}
    assert {tuple(r) for r in graph.shortest_paths(e, starts=starts).collect()} == every
