"""Queries over stored tables: merges into them, deletes that cascade, and reads by their owner."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cascade
from ..operators.cascade import Reference
from ..sources import store, views
from ..sources.files import shared_folder, written
from ..sources.owned import Owned
from .views_sql import sql

QUERIES, SQL = {}, {}


def query(name: str, statement: str | None = None):
    def add(f):
        QUERIES[name] = f
        if statement:
            SQL[name] = statement
        return f

    return add


def _target(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("stored_verdicts", sql("select user_id, event_type, event_id, value, epoch_us(ts) as written_at from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1"))
def stored_verdicts(spark, sf_dir) -> DataFrame:
    """A-10: events as entries of a cache, merged into a stored table by the week, out of order and one week twice."""
    e = views.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("written_at"), (F.dayofmonth("ts") / 8).cast("int").alias("week"))
    at, buckets = _target(spark), store.buckets_for(e.count())
    for week in (1, 0, 3, 1, 2):
        store.merge_into(at, e.where(F.col("week") == week).drop("week"), ["user_id", "event_type"], ["written_at", "event_id"], buckets)
    return store.merged(spark, at)


def triples(spark, sf_dir) -> DataFrame:
    """Every order line is a triple that a chunk, its order, gave."""
    li, n = views.table(spark, sf_dir, "lineitem"), views.DOC_NODES
    name = lambda c: F.concat(F.lit("Concept "), F.floor(F.col("l_orderkey") / views.DOC_ORDERS) * n + F.col(c) % n)
    t = li.select(F.floor(F.col("l_orderkey") / views.DOC_ORDERS).alias("doc"), F.col("l_orderkey").alias("chunk"), name("l_partkey").alias("subject"), ((F.col("l_orderkey") + F.col("l_linenumber") * 7) % 25).cast("int").alias("idx"), name("l_suppkey").alias("object"))
    return t.join(F.broadcast(views.predicates(spark).select("idx", F.col("name").alias("relation"))), "idx")  # 25 rows


_TRIPLES = """t as (select l_orderkey // 16 as doc, l_orderkey as chunk, 'Concept ' || ((l_orderkey // 16) * 20 + l_partkey % 20) as subject, name as relation, 'Concept ' || ((l_orderkey // 16) * 20 + l_suppkey % 20) as object from lineitem join predicates on idx = (l_orderkey + l_linenumber * 7) % 25),
e as (select doc, chunk, subject as name from t union all select doc, chunk, object from t)"""


@query("graph_merge", sql("select 'node' as kind, doc, name as a, '' as b, count(*)::bigint as n from e group by doc, name union all select distinct 'relation', doc, subject, relation || ' ' || object, 1 from t union all select distinct 'mention', doc, name, chunk::varchar, 1 from e", "predicates", more=_TRIPLES))
def graph_merge(spark, sf_dir) -> DataFrame:
    """A-11, J-17: triples merged into a stored graph in three batches, the first of them twice: its nodes with their counts, its relations and the
    chunks' mentions."""
    t, at = written(triples(spark, sf_dir)), _target(spark)
    buckets = store.buckets_for(t.count())
    for k in (0, 1, 2, 0):
        store.merge_triples(at, t.where(F.col("chunk") % 3 == k), f"batch {k}", buckets)
    one = F.lit(1).cast("long").alias("n")
    nodes = store.graph_nodes(spark, at).select(F.lit("node").alias("kind"), "doc", F.col("name").alias("a"), F.lit("").alias("b"), F.col("mention_count").alias("n"))
    relations = store.graph_relations(spark, at).select(F.lit("relation").alias("kind"), "doc", F.col("subject").alias("a"), F.concat_ws(" ", "relation", "object").alias("b"), one)
    mentions = store.graph_mentions(spark, at).select(F.lit("mention").alias("kind"), "doc", F.col("name").alias("a"), F.col("chunk").cast("string").alias("b"), one)
    return nodes.unionByName(relations).unionByName(mentions)


#: Who refers to whom among the tables of a learner's concepts.
LEARNER_KEYS = {"concepts": ["user_id", "concept_id"], "sessions": ["session_id"], "attempts": ["attempt_id"], "mastery": ["user_id", "concept_id"], "pipeline_runs": ["run_id"], "files": ["path"]}
LEARNER_REFERENCES = [
    Reference("attempts", ("session_id",), "sessions", ("session_id",)),
    Reference("sessions", ("user_id", "concept_id"), "concepts", ("user_id", "concept_id")),
    Reference("mastery", ("user_id", "concept_id"), "concepts", ("user_id", "concept_id")),
    Reference("pipeline_runs", ("user_id", "concept_id"), "concepts", ("user_id", "concept_id")),
    Reference("files", ("path",), "concepts", ("source_document",)),
]


def learner_tables(spark, sf_dir) -> dict[str, DataFrame]:
    a, s = views.attempts(spark, sf_dir), views.sessions(spark, sf_dir)
    c = a.select("user_id", "concept_id").distinct().withColumn("source_document", F.concat_ws("/", "user_id", F.concat("concept_id", F.lit(".pdf"))))
    runs = s.select(F.concat_ws("-", "user_id", "concept_id", "mode").alias("run_id"), "user_id", "concept_id").distinct()
    mastery = s.groupBy("user_id", "concept_id").agg(F.max("score").alias("score"))
    return {"attempts": a, "sessions": s, "mastery": mastery, "pipeline_runs": runs, "files": c.select(F.col("source_document").alias("path")), "concepts": c}


_LEFT = "c as (select distinct user_id, concept_id, concept_id = 3 and user_id % 2 = 0 as gone from attempts)"


@query("cascade_tables", sql("select entity, count(*)::bigint as before, sum((not gone)::int)::bigint as kept from (select 'attempts' as entity, gone from attempts join c using (user_id, concept_id) union all select 'sessions', gone from sessions join c using (user_id, concept_id) union all select e, gone from c, (values ('mastery'), ('files'), ('concepts')) as t(e) union all select 'pipeline_runs', any_value(gone) from sessions join c using (user_id, concept_id) group by user_id, concept_id, mode) group by 1", "attempts", "sessions", more=_LEFT))
def cascade_tables(spark, sf_dir) -> DataFrame:
    """A-12: rows of each of six tables before and after every second learner's concept 3 is deleted with all that refers to it."""
    tables = {t: written(rows) for t, rows in learner_tables(spark, sf_dir).items()}
    left = cascade.delete(tables, LEARNER_KEYS, LEARNER_REFERENCES, {"concepts": tables["concepts"].where("concept_id = 3 and user_id % 2 = 0")})
    count = lambda rows, t, c: rows.agg(F.count("*").alias(c)).withColumn("entity", F.lit(t))
    both = [count(tables[t], t, "before").join(count(left[t], t, "kept"), "entity") for t in tables]
    return reduce(DataFrame.unionByName, both).select("entity", "before", "kept")


@query("owned_rows", sql("select 'attempts' as entity, attempt_id::varchar as id from attempts where user_id = 7 union all select 'sessions', session_id from sessions where user_id = 7 union all select 'orders', o_orderkey::varchar from orders where o_custkey = 7 union all select 'parts', p_partkey::varchar from part", "attempts", "sessions"))
def owned_rows(spark, sf_dir, owner: int = 7) -> DataFrame:
    """B-17: what one owner can read: the own rows, and shared tables in whole."""
    own = Owned(spark, sf_dir, owner)
    ids = {"attempts": "attempt_id", "sessions": "session_id", "orders": "o_orderkey", "parts": "p_partkey"}
    return reduce(DataFrame.unionByName, [own.read(t).select(F.lit(t).alias("entity"), F.col(c).cast("string").alias("id")) for t, c in ids.items()])
