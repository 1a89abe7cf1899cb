"""Concepts put together from mentions (G-02) and written as a graph with sub-nodes (J-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The array properties of a concept that become nodes of their own, and those nodes' kinds.
PARTS = {"examples": "example", "formulas": "formula", "misconceptions": "misconception"}


def merged_concepts(mentions: DataFrame, key: str, order: list[str], scalars: list[str], arrays: list[str]) -> DataFrame:
    """One row for each key: `name` of the first mention, the first value of each scalar that is not blank, and of each array the distinct items
    of all mentions in the order of their first appearance. Mentions without a key, and null items, are left out.

    Items are made distinct before they are put in order, in an aggregation by key and item that combines before the shuffle, so what a key
    gathers is its distinct items, however often it is mentioned."""
    mentions = mentions.where(F.coalesce(F.col(key), F.lit("")) != "")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(*order))).alias(c)
    head = mentions.groupBy(key).agg(F.min_by("name", F.struct(*order)).alias("name"), *[first(c) for c in scalars])
    items = mentions.select(key, *order, F.explode(F.array(*[F.struct(F.lit(a).alias("prop"), F.coalesce(F.col(a), F.array().cast("array<string>")).alias("values")) for a in arrays])).alias("p"))
    items = items.select(key, *order, "p.prop", F.posexplode("p.values").alias("_at", "item")).where("item is not null")
    seen = items.groupBy(key, "prop", "item").agg(F.min(F.struct(*order, "_at")).alias("first"))
    lists = seen.groupBy(key).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("prop") == a, F.struct("first", "item")))), lambda x: x["item"]).alias(a) for a in arrays])
    none = F.array().cast("array<string>")
    return head.join(lists, key, "left").select(key, "name", *scalars, *[F.coalesce(F.col(a), none).alias(a) for a in arrays])


def content_id(*parts: Column) -> Column:
    """An id that follows from what it names: the same wherever and however often it is computed."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def graph_tables(concepts: DataFrame, relations: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) and relations (source, target, type) of concepts (key, name, examples, formulas, misconceptions) and of relations
    between concepts (from, type, to, by name, case aside). Each item of an array that is not blank is a node below its concept. Relations
    from a concept to itself, or whose ends no concept is named like, are left out."""
    c = concepts.withColumn("id", content_id(F.col(key)))
    below = F.explode(F.array(*[F.struct(F.lit(a).alias("field"), F.lit(kind).alias("kind"), F.col(a).alias("items")) for a, kind in PARTS.items()])).alias("p")
    items = c.select("id", below).select("id", "p.field", "p.kind", F.explode("p.items").alias("text")).where("text <> ''")
    items = items.withColumn("sub", content_id(F.col("id"), F.col("field"), F.col("text")))
    nodes = c.select("id", F.lit("concept").alias("kind"), F.col("name").alias("label"))
    nodes = nodes.unionByName(items.select(F.col("sub").alias("id"), "kind", F.concat("kind", F.lit(": "), F.substring("text", 1, 30), F.lit("...")).alias("label")))
    token = F.upper(F.regexp_replace(F.coalesce(F.col("type"), F.lit("RELATES_TO")), r"\s+", "_"))
    low = lambda x: F.lower(F.btrim(x))
    named = c.select(low("name").alias("low"), "id")
    r = relations.where(low("from") != low("to")).select(low("from").alias("f"), low("to").alias("t"), token.alias("type"))
    r = r.join(named.select(F.col("low").alias("f"), F.col("id").alias("source")), "f").join(named.select(F.col("low").alias("t"), F.col("id").alias("target")), "t").where("source <> target")
    return nodes.distinct(), r.select("source", "target", "type").distinct().unionByName(items.select(F.col("id").alias("source"), F.col("sub").alias("target"), F.upper("field").alias("type")))


def dangling(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """The ends of relations that are no node: (id, type)."""
    ends = relations.select(F.explode(F.array("source", "target")).alias("id"), "type")
    return ends.join(nodes.select("id"), "id", "left_anti").distinct()
