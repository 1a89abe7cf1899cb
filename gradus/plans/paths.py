"""Queries over one graph of all documents, and over paths between end points that are named in free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components, fuzzy
from ..sources import views
from .views_sql import sql

QUERIES, SQL = {}, {}


def query(name: str, statement: str | None = None):
    def add(f):
        QUERIES[name] = f
        if statement:
            SQL[name] = statement
        return f

    return add


_REACH = """pairs as (select distinct src, dst from linked_edges where dag and src <> dst),
reach as (select src as a, dst as b from pairs union select r.a, p.dst from reach r join pairs p on r.b = p.src),
component as (select x.a as node, min(x.b) as component from reach x join reach y on x.a = y.b and x.b = y.a group by 1)"""


@query("cyclic_edges", sql("select e.src, e.dst, rel, edge_id, c.component from linked_edges e join component c on c.node = e.src join component d on d.node = e.dst and d.component = c.component where dag and e.src <> e.dst", "linked_edges", more=_REACH))
def cyclic_edges(spark, sf_dir) -> DataFrame:
    """J-07: the edges of acyclic relations that lie on a cycle of the graph over all documents, with the component they close."""
    e = views.linked_edges(spark, sf_dir).where("dag").select("src", "dst", "rel", "edge_id")
    return components.edges_on_cycles(e, components.strong_components(e))


@query("acyclic_graph")
def acyclic_graph(spark, sf_dir) -> DataFrame:
    """J-06, J-07 over documents; order-dependent, compared with a plain search of the whole graph in the tests."""
    return components.acyclic(views.linked_edges(spark, sf_dir)).select("src", "dst", "rel", "edge_id", "kept")


def answer_pairs(spark, sf_dir) -> DataFrame:
    """Every order is a question about its document: the right answer names a concept in full or cut short; the student's names one in full or
    within a sentence, or none."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / views.DOC_ORDERS).alias("doc"), F.col("o_custkey").alias("c"))
    name = lambda x: F.concat(F.lit("Concept "), F.col("doc") * views.DOC_NODES + x % views.DOC_NODES)
    o = o.withColumns({"right": name(F.col("id")), "wrong": name(F.col("c"))})
    short = F.substr("right", F.lit(1), F.length("right") - 1)
    said = F.when(F.col("c") % 4 == 0, F.concat(F.lit("I THINK IT IS "), F.upper("wrong"))).when(F.col("c") % 4 == 1, F.concat(F.lit("something else, like "), "c")).otherwise(F.col("wrong"))
    return o.select("id", "doc", F.when(F.col("id") % 3 == 0, short).otherwise(F.col("right")).alias("correct"), said.alias("student"))


_PAIRS = """asked as (select id, doc, case when id % 3 = 0 then substr(r, 1, length(r) - 1) else r end as correct, case c % 4 when 0 then 'I THINK IT IS ' || upper(w) when 1 then 'something else, like ' || c else w end as student
  from (select o_orderkey as id, o_orderkey // 16 as doc, o_custkey as c, 'Concept ' || ((o_orderkey // 16) * 20 + o_orderkey % 20) as r, 'Concept ' || ((o_orderkey // 16) * 20 + o_custkey % 20) as w from orders)),
named as (select node, node // 20 as doc, lower(name) as name from nodes),
starts as (select distinct id, node from asked join named using (doc) where contains(name, lower(left(correct, 50))) or contains(lower(left(correct, 50)), name)),
ends as (select distinct id, node from asked join named using (doc) where contains(name, lower(left(student, 50))) or contains(lower(left(student, 50)), name)),
step as (select a, b, 'Concept ' || a || ' -[' || min(rel) || ']-> Concept ' || b as w from (select src as a, dst as b, rel from edges where src <> dst union all select dst, src, rel from edges where src <> dst) group by 1, 2),
p0 as (select id, node as start, node, []::varchar[] as path from starts)"""


def _steps_sql(depth: int) -> str:
    parts, seen = [_PAIRS], "select id, start, node from p0"
    for d in range(1, depth + 1):
        parts.append(f"p{d} as (select p.id, p.start, s.b as node, min(list_append(p.path, s.w)) as path from p{d - 1} p join step s on p.node = s.a where (p.id, p.start, s.b) not in ({seen}) group by 1, 2, 3)")
        seen += f" union all select id, start, node from p{d}"
    return ",\n".join(parts)


@query("answer_paths", sql("select id, start, node as end, dist::int as dist, array_to_string(path, '; ') as path from (select p.*, row_number() over (partition by id order by dist, start, node, path) as r from (" + " union all ".join(f"select *, {d} as dist from p{d}" for d in range(1, 5)) + ") p join ends using (id, node)) where r = 1", "edges", "nodes", more=_steps_sql(4)))
def answer_paths(spark, sf_dir) -> DataFrame:
    """J-05: how the right answer's concept leads to the student's, both named by texts: the first of the shortest ways of at most four relations."""
    asked = views.by_doc(answer_pairs(spark, sf_dir), views.doc_parts(spark, sf_dir))
    p = fuzzy.paths_within(asked.withColumnsRenamed({"correct": "first", "student": "last"}), views.doc_nodes(spark, sf_dir), views.doc_edges(spark, sf_dir))
    return p.select("id", "start", "end", "dist", F.array_join("path", "; ").alias("path"))
