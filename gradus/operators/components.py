"""Cycles of one graph that spans all documents (J-06, J-07): strongly connected components by joins, and a search only inside them.

Every step is a join or a grouped minimum over the edges that may still lie on a cycle, and is written before the next one, so a plan
never holds more than one step. What the search gets as one group is one component.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import written
from .graph import back_edges


def peeled(pairs: DataFrame, least_share: float = 0.05) -> DataFrame:
    """pairs (src, dst) without those that start at a node nothing leads to, or end at one that leads nowhere: they lie on no cycle. Rounds
    go on while they remove at least `least_share` of the pairs; a long path that is left costs nothing but its rows."""
    now, n = pairs, pairs.count()
    while n:
        inner = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = written(inner.join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        left = inner.count()
        now, n, gone = inner, left, n - left
        if gone < least_share * (left + gone) or not left:
            break
    return now


def _coloured(pairs: DataFrame, rounds: int) -> DataFrame:
    """(node, colour): the greatest node from which a node can be reached. A round takes the colours of a node's predecessors and then the
    colour of the node that its colour is named after, so that long ways need few rounds."""
    colour = written(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
    for _ in range(rounds):
        sent = pairs.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("got"))
        step = colour.join(sent, "node", "left").select("node", F.col("colour").alias("was"), F.greatest("colour", F.coalesce("got", "colour")).alias("colour"))
        leap = step.select(F.col("node").alias("colour"), F.col("colour").alias("beyond"))
        now = written(step.join(leap, "colour").select("node", "was", F.greatest("colour", "beyond").alias("colour")))
        if not now.where("was <> colour").take(1):
            return colour
        colour = now.drop("was")
    raise RuntimeError(f"colours did not settle in {rounds} rounds")


def _reaching(pairs: DataFrame, colour: DataFrame, rounds: int) -> DataFrame:
    """(node, colour) of the nodes that reach the node their colour is named after; pairs have one colour at both ends."""
    found = front = written(colour.where("node = colour"))
    for _ in range(rounds):
        nxt = pairs.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
        front = written(nxt.join(found.select("node"), "node", "left_anti"))
        if not front.take(1):
            return found
        found = written(found.unionByName(front))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def strong_components(pairs: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, component) of the nodes of directed pairs (src, dst) that lie on a cycle; a component is named after its least node.

    Forward-backward search from many nodes at once: every node takes the colour of the greatest node that reaches it; the nodes of a
    colour that reach that node too are one component; the rest is coloured again. Loops from a node to itself are left out. Raises if
    `rounds` steps do not settle a search."""
    live = peeled(written(pairs.select("src", "dst").where("src <> dst").distinct()))
    out = None
    while live.take(1):
        colour = _coloured(live, rounds)
        ends = live.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst")
        inner = written(ends.where("colour = other").select("src", "dst", "colour"))
        found = _reaching(inner, colour, rounds)
        out = found if out is None else out.unionByName(found)
        names = found.select("node")
        live = inner.select("src", "dst").join(names.withColumnRenamed("node", "src"), "src", "left_anti").join(names.withColumnRenamed("node", "dst"), "dst", "left_anti")
        live = peeled(written(live))
    if out is None:
        return pairs.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    least = out.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return out.join(least, "colour").select("node", "component")


def edges_on_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The edges, not loops, with both ends in one component, with that component."""
    named = lambda end, name: components.select(F.col("node").alias(end), F.col("component").alias(name))
    return edges.where("src <> dst").join(named("src", "component"), "src").join(named("dst", "_other"), "dst").where("component = _other").drop("_other")


def _back(pdf: pd.DataFrame) -> pd.DataFrame:
    gone = back_edges(list(pdf.sort_values("edge_id")[["src", "dst", "edge_id"]].itertuples(index=False, name=None)))
    return pd.DataFrame({"edge_id": sorted(gone)})


def acyclic(edges: DataFrame) -> DataFrame:
    """J-06, J-07 over one graph: edges (src, dst, rel, edge_id, dag, ...) with `kept`. Of the acyclic relations, the back edges of a depth-first
    search of each component go, which starts at the source of the component's first edge and follows edges in order; loops go too."""
    dag = edges.where("dag")
    cyclic = edges_on_cycles(dag.select("src", "dst", "edge_id"), strong_components(dag))
    kind = T.StructType([T.StructField("edge_id", edges.schema["edge_id"].dataType)])
    gone = cyclic.groupBy("component").applyInPandas(_back, kind).unionByName(dag.where("src = dst").select("edge_id"))
    return edges.join(gone.withColumn("_gone", F.lit(True)), "edge_id", "left").withColumn("kept", F.col("_gone").isNull()).drop("_gone")
