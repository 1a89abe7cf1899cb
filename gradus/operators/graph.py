"""Knowledge-graph operators over edges (src, dst, rel, edge_id, asymmetric, dag) and nodes (node, name, owner)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import character_pairs
from ..sources.files import written

#: Pairs of relation types that contradict each other between the same nodes.
MUTEX = [("IS_A", "CONTRASTS_WITH"), ("PART_OF", "CONTAINS"), ("CAUSES", "CAUSED_BY"), ("EXAMPLE_OF", "CONTRASTS_WITH")]


def undirected(edges: DataFrame, *scope: str) -> DataFrame:
    """Distinct pairs (a, b) in both directions, without self-loops."""
    both = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    return edges.where("src <> dst").select(*scope, both.alias("e")).select(*scope, "e.a", "e.b").distinct()


def k_hop(pairs: DataFrame, depth: int, starts: DataFrame | None = None) -> DataFrame:
    """J-01, J-02: rows (start, node, dist) of the shortest distance up to depth, from every node or from those of `starts` (start). Each hop is a
    join on the frontier, made distinct, and an anti-join with what was reached before; all but the last are written, so that a plan
    holds one hop."""
    pairs = written(pairs.select("a", "b").where("a <> b"))
    front = pairs.select(F.col("a").alias("start"), F.col("b").alias("node"))
    reached = front = (front if starts is None else written(front.join(starts.select("start").distinct(), "start", "left_semi"))).withColumn("dist", F.lit(1))
    for d in range(2, depth + 1):
        nxt = front.join(pairs, front.node == pairs.a).select("start", F.col("b").alias("node")).where("start <> node").distinct()
        front = nxt.join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("dist", F.lit(d))
        front = written(front) if d < depth else front
        reached = reached.unionByName(front)
    return reached


def _ways(steps: DataFrame, to: Column, scope: str) -> DataFrame:
    """(scope, start, ways) for each node that a step leads from: ways is the scope's map from a node to its array of `to`."""
    ways = steps.groupBy(scope, "a").agg(F.collect_list(to).alias("to")).groupBy(scope).agg(F.map_from_entries(F.collect_list(F.struct("a", "to"))).alias("ways"))
    return ways.select(scope, F.explode(F.map_keys("ways")).alias("start"), "ways")


def _onward(front: Column, step) -> Column:
    """The arrays of `step`, of each element of the front, as one."""
    return F.flatten(F.transform(front, lambda f: F.coalesce(step(f), F.array())))


def hops_within(pairs: DataFrame, depth: int, scope: str = "doc") -> DataFrame:
    """J-01, J-02 where all pairs (scope, a, b) lie within a scope: rows (scope, start, near), near being what is up to `depth` away as an array of
    (dist, node). The neighbours of a scope's nodes are one map, in which the hops are array expressions; nothing is shuffled for a hop.
    A row holds one scope, whose size is the bound."""
    h = _ways(pairs.where("a <> b").select(scope, "a", "b").distinct(), F.col("b"), scope)
    h = h.withColumn("at1", F.col("ways")[F.col("start")])
    for d in range(2, depth + 1):
        seen = F.concat(F.array("start"), *[f"at{k}" for k in range(1, d)])
        h = h.withColumn(f"at{d}", F.array_except(_onward(F.col(f"at{d - 1}"), lambda n: F.col("ways")[n]), seen))
    near = [F.transform(f"at{d}", lambda n: F.struct(F.lit(d).alias("dist"), n.alias("node"))) for d in range(1, depth + 1)]
    return h.select(scope, "start", F.concat(*near).alias("near"))


def paths_within(edges: DataFrame, depth: int = 4, scope: str = "doc") -> DataFrame:
    """J-05 as `shortest_paths` from every node, where all edges (scope, src, dst, rel) lie within a scope; hops are array expressions as in `hops_within`."""
    step = _steps(edges, scope).groupBy(scope, "a", "b").agg(F.min("w").alias("w"))
    h = _ways(step, F.struct(F.col("b").alias("node"), "w"), scope)
    first = F.transform(F.col("ways")[F.col("start")], lambda x: F.struct(x["node"].alias("node"), F.concat(F.col("start").cast("string"), x["w"]).alias("path")))
    h = h.withColumn("at1", first).withColumn("seen1", F.concat(F.array("start"), F.col("at1.node")))
    for d in range(2, depth + 1):
        new = lambda f: F.transform(F.filter(F.col("ways")[f["node"]], lambda x: ~F.array_contains(F.col(f"seen{d - 1}"), x["node"])), lambda x: F.struct(x["node"].alias("node"), F.concat(f["path"], x["w"]).alias("path")))
        h = h.withColumn("all", F.sort_array(F.flatten(F.transform(f"at{d - 1}", new))))
        h = h.withColumn(f"at{d}", F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["node"] != x["node"])))
        h = h.withColumn(f"seen{d}", F.concat(f"seen{d - 1}", F.col(f"at{d}.node")))
    found = [F.transform(f"at{d}", lambda x: F.struct(x["node"].alias("node"), F.lit(d).alias("dist"), x["path"].alias("path"))) for d in range(1, depth + 1)]
    return h.select("start", F.explode(F.concat(*found)).alias("x")).select("start", "x.*")


def k_hop_limited(pairs: DataFrame, depth: int, most: int) -> DataFrame:
    """J-02 with its limit: of the nodes at the end of a walk of each length the `most` first by id, each with the least length it was
    taken at. Walks may come back to their start, which is not a result."""
    walk = pairs.select(F.col("a").alias("start"), F.col("b").alias("node")).where("start <> node").distinct()
    taken = None
    for d in range(1, depth + 1):
        if d > 1:
            walk = walk.join(pairs, walk.node == pairs.a).where("a <> b").select("start", F.col("b").alias("node")).distinct()
        found = walk.where("start <> node").withColumn("r", F.row_number().over(Window.partitionBy("start").orderBy("node"))).where(F.col("r") <= most)
        found = found.select("start", "node", F.lit(d).alias("dist"))
        taken = found if taken is None else taken.unionByName(found)
    return taken.groupBy("start", "node").agg(F.min("dist").alias("dist"))


def _steps(edges: DataFrame, *scope: str) -> DataFrame:
    """(a, b, w): the edges in both directions, written as a step from a to b."""
    there = F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit(" -["), "rel", F.lit("]-> "), F.col("dst").cast("string")).alias("w"))
    back = F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.concat(F.lit(" <-["), "rel", F.lit("]- "), F.col("src").cast("string")).alias("w"))
    return edges.where("src <> dst").select(*scope, F.explode(F.array(there, back)).alias("e")).select(*scope, "e.*")


def shortest_paths(edges: DataFrame, depth: int = 4, starts: DataFrame | None = None) -> DataFrame:
    """J-05: for each pair of nodes, the first of the shortest undirected paths, written a -[R]- b; from every node or from those of `starts` (start).
    All hops but the last are written."""
    step = written(_steps(edges).groupBy("a", "b").agg(F.min("w").alias("w")))
    first = step.select(F.col("a").alias("start"), F.col("b").alias("node"), F.lit(1).alias("dist"), F.concat(F.col("a").cast("string"), "w").alias("path"))
    reached = front = first if starts is None else written(first.join(starts.select("start").distinct(), "start", "left_semi"))
    for d in range(2, depth + 1):
        nxt = front.join(step, front.node == step.a).where("start <> b").groupBy("start", F.col("b").alias("node")).agg(F.min(F.concat("path", "w")).alias("path"))
        front = nxt.join(reached.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(d).alias("dist"), "path")
        front = written(front) if d < depth else front
        reached = reached.unionByName(front)
    return reached


def closed_walks(edges: DataFrame, longest: int = 5) -> DataFrame:
    """J-08: closed walks of 2 to `longest` different edges for each acyclic relation; every start counts."""
    e = edges.where("dag and src <> dst").select("rel", "src", "dst", "edge_id")
    walk = e.select("rel", F.col("src").alias("start"), F.col("dst").alias("at"), F.array("edge_id").alias("used"))
    found = None
    for k in range(2, longest + 1):
        walk = walk.join(e, (walk.rel == e.rel) & (walk["at"] == e.src) & ~F.array_contains(walk.used, e.edge_id)).select(walk.rel, "start", F.col("dst").alias("at"), F.concat("used", F.array("edge_id")).alias("used"))
        closed = walk.where("start = at").groupBy("rel").agg(F.count("*").alias("walks")).withColumn("length", F.lit(k))
        found = closed if found is None else found.unionByName(closed)
    return found


def back_edges(edges: list[tuple[int, int, int]]) -> set[int]:
    """Ids of the (src, dst, id) that lead back into the path of a depth-first search. Searches start at sources in order of
    their first edge, and edges are followed in order."""
    out: dict[int, list[tuple[int, int]]] = {}
    for src, dst, i in edges:
        out.setdefault(src, []).append((dst, i))
    done, path, back = set(), set(), set()
    for start in out:
        todo = [] if start in done else [(start, iter(out[start]))]
        done.add(start)
        path.update(x for x, _ in todo)
        while todo:
            node, left = todo[-1]
            dst, i = next(left, (None, None))
            if i is None:
                path.discard(node)
                todo.pop()
            elif dst in path:
                back.add(i)
            elif dst not in done:
                done.add(dst)
                path.add(dst)
                todo.append((dst, iter(out.get(dst, ()))))
    return back


def break_cycles(edges: DataFrame, graph_col: str = "graph") -> DataFrame:
    """J-06, J-07: edges with `kept`. Of each graph's acyclic relations, the back edges of a depth-first search go.
    A graph is what one document's chunks gave, so a group is bounded by a document."""

    def run(graphs: pd.Series) -> pd.Series:
        return graphs.map(lambda dag: sorted(back_edges([(e["src"], e["dst"], e["edge_id"]) for e in dag])))

    rest = [c for c in edges.columns if c != graph_col]
    g = edges.groupBy(graph_col).agg(F.collect_list(F.struct(*rest)).alias("l"))
    # only the acyclic relations of a graph go to Python, many graphs at a time
    dag = F.array_sort(F.transform(F.filter("l", lambda e: e["dag"]), lambda e: F.struct(e["edge_id"].alias("edge_id"), e["src"].alias("src"), e["dst"].alias("dst"))))
    g = g.withColumn("gone", F.pandas_udf(run, "array<long>")(dag))
    return g.select(graph_col, "gone", F.explode("l").alias("e")).select(*[F.col(c) if c == graph_col else F.col(f"e.{c}").alias(c) for c in edges.columns], (~F.array_contains("gone", F.col("e.edge_id"))).alias("kept"))


def adjacency_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """J-09, D-18: out- and in-degree of every node."""
    ends = edges.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    d = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.join(d, "node", "left").na.fill(0, ["out_degree", "in_degree"])


def bigrams(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """H-10: counts of character pairs of the lower-case letters, digits and blanks of a text."""
    clean = F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")
    g = df.select(*keys, F.explode(F.when(F.length(clean) >= 2, F.transform(F.sequence(F.lit(1), F.length(clean) - 1), lambda i: F.substr(clean, i, F.lit(2))))).alias("gram"))
    return g.groupBy(*keys, "gram").agg(F.count("*").cast("double").alias("c"))


def gram_counts(names: DataFrame, scope: str = "doc") -> DataFrame:
    """H-10: (scope, grams) of names (scope, node, name): each node with its character pairs as numbers, their counts as a map, the norm of these,
    and whether no pair is there twice."""
    code = lambda g: F.ascii(g) * 128 + F.ascii(F.substring(g, 2, 1))
    n = names.select(scope, "node", F.transform(character_pairs(F.col("name")), code).alias("l")).withColumn("own", F.array_distinct("l"))
    c = n.select(scope, "node", "own", (F.size("own") == F.size("l")).alias("plain"), F.map_from_arrays("own", F.transform("own", lambda g: F.size(F.filter("l", lambda h: h == g)).cast("double"))).alias("c"))
    norm = F.sqrt(F.aggregate(F.map_values("c"), F.lit(0.0), lambda s, x: s + x * x))
    return c.select(scope, F.struct("node", "own", "plain", "c", norm.alias("norm")).alias("g")).groupBy(scope).agg(F.collect_list("g").alias("grams"))


def gram_dot(x: Column, y: Column) -> Column:
    """The sum of products of two nodes' counts: where all counts are one, the number of pairs in common."""
    counted = F.aggregate(F.map_keys(x["c"]), F.lit(0.0), lambda s, g: s + x["c"][g] * F.coalesce(y["c"][g], F.lit(0.0)))
    return F.when(x["plain"] & y["plain"], F.size(F.array_intersect(x["own"], y["own"])).cast("double")).otherwise(counted)


def repair_duplicates(names: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G-07: nodes with one canonical name become the first of them; edges are pointed to it, made distinct, and self-loops go.
    names: (node, key)."""
    keeper = names.withColumn("keeper", F.min("node").over(Window.partitionBy("key")))
    to = keeper.select("node", "keeper")
    e = edges.join(to.withColumnRenamed("node", "src").withColumnRenamed("keeper", "s"), "src").join(to.withColumnRenamed("node", "dst").withColumnRenamed("keeper", "d"), "dst")
    e = e.where("s <> d").groupBy(F.col("s").alias("src"), F.col("d").alias("dst"), "rel").agg(F.min("edge_id").alias("edge_id"))
    return keeper, e
