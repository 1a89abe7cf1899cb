"""Further queries: joins on text, chunk audits, caches and look-ups, with their SQL."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions import formulas as M
from ..functions import text as T
from ..functions.formulas import half_up
from ..functions.shingles import jaccard, set_key, shingle_sets
from ..operators import folds
from ..sources import views
from ..sources.files import written
from .models import _MASTERY
from .views_sql import r6, sql

QUERIES, SQL = {}, {}
#: Buckets of shingles by whose sizes shingles are put in order; a power of two.
GRAM_BUCKETS = 1 << 16


def query(name: str, statement: str | None = None):
    def add(f):
        QUERIES[name] = f
        if statement:
            SQL[name] = statement
        return f

    return add


@query("chunk_a")
def chunk_a(spark, sf_dir) -> DataFrame:
    """K-01; compared with hand-made texts in the tests."""
    return chunking.chunk(views.table(spark, sf_dir, "documents"), chunking.natural_chunks)


@query("chunk_b")
def chunk_b(spark, sf_dir) -> DataFrame:
    """K-03."""
    return chunking.chunk(views.table(spark, sf_dir, "documents"), chunking.packed_chunks)


@query("clean_pages")
def clean_pages(spark, sf_dir) -> DataFrame:
    """K-06."""
    clean = F.pandas_udf(lambda s: s.map(lambda t: chunking.clean_page(t or "")), "string")
    return views.table(spark, sf_dir, "documents").select("doc_id", clean("text").alias("text"))


@query("pseudo_embeddings")
def pseudo_embeddings(spark, sf_dir) -> DataFrame:
    """H-11 of concept names."""
    return views.nodes(spark, sf_dir).select("node", chunking.embed("name").alias("v"))


@query("repetition_cleaning")
def repetition_cleaning(spark, sf_dir) -> DataFrame:
    """K-07: repeated words and runs of one character are shortened; back-references have no SQL counterpart, compared with Python in the tests."""
    x = F.regexp_replace("text", r"(\b[^\s,]+)(, \1\b)+", "$1")
    x = F.regexp_replace(F.regexp_replace(x, r"(\b\S+)( \1\b)+", "$1"), r"(.)\1{3,}", "$1")
    return views.table(spark, sf_dir, "documents").select("doc_id", F.length(x).alias("cleaned_chars"))


_SETS = """grams as (select distinct doc_id, chunk_index, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, chunk_index, regexp_extract_all(lower(text), '[a-z0-9]+') as w from chunks_fixed), unnest(range(1, len(w) - 3)) as u(i)),
sets as (select doc_id, chunk_index, md5(string_agg(g, '|' order by g)) as k, count(*) as n from grams group by 1, 2), reps as (select k, any_value(n) as n, min_by(doc_id, (doc_id, chunk_index)) as rd, min_by(chunk_index, (doc_id, chunk_index)) as rc from sets group by 1),
own as (select r.rd, r.rc, r.n, g.g from reps r join grams g on g.doc_id = r.rd and g.chunk_index = r.rc)"""


@query("near_duplicate_chunks", sql(f"""select 'copy' as kind, s.doc_id as doc_a, s.chunk_index as chunk_a, rd as doc_b, rc as chunk_b, 1.0::double as jaccard from sets s join reps r using (k) where (s.doc_id, s.chunk_index) <> (rd, rc)
  union all select 'pair', ad, ac, bd, bc, {r6('common::double / (na + nb - common)')} from (select x.rd as ad, x.rc as ac, y.rd as bd, y.rc as bc, count(*) as common, any_value(x.n) as na, any_value(y.n) as nb from own x join own y on x.g = y.g and (x.rd, x.rc) < (y.rd, y.rc) group by 1, 2, 3, 4) where common::double / (na + nb - common) >= 0.85::double""", "chunks_fixed", more=_SETS))
def near_duplicate_chunks(spark, sf_dir) -> DataFrame:
    """C-12: chunks with the same 5-word shingles as copies of their first, and pairs of such firsts with Jaccard >= 0.85. A pair at that level
    shares one of the first 15 % of each set in any one order of all shingles, so only those are joined. The order is by how many shingles fall
    into a shingle's bucket, rarest first, which tells frequent shingles without a count of each; the buckets are a fixed number. Sets are made again where
    they are needed and not written."""
    c = views.chunks_fixed(spark, sf_dir).select(F.struct("doc_id", "chunk_index").alias("id"), "text")

    def buckets(texts: pa.Array) -> pa.Array:
        found = [s & (GRAM_BUCKETS - 1) for s in shingle_sets(texts)]
        return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(b) for b in found]))).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int32()))

    load = np.zeros(GRAM_BUCKETS, dtype=np.int64)
    for b, n in c.select(F.explode(F.arrow_udf(buckets, "array<int>")("text")).alias("b")).groupBy("b").count().collect():  # at most GRAM_BUCKETS rows
        load[b] = n

    def rarest(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(texts)
        p = [g[np.lexsort((g, load[g & (GRAM_BUCKETS - 1)]))][: len(g) - (85 * len(g) + 99) // 100 + 1] if len(g) else g for g in sets]
        return pa.StructArray.from_arrays([pa.array([set_key(g) for g in sets]), pa.array([len(g) for g in sets], pa.int32()), pa.array(p, pa.list_(pa.int64()))], names=["k", "n", "p"])

    keyed = c.select("id", F.arrow_udf(rarest, "k string, n int, p array<long>")("text").alias("x")).select("id", "x.*").where("n > 0")
    keys = written(keyed.groupBy("k").agg(F.min(F.struct("id", "n", "p")).alias("r")).select("k", "r.*"))
    own = F.arrow_udf(lambda texts: pa.array([set_key(g) if len(g) else None for g in shingle_sets(texts)], pa.string()), "string")
    copies = c.select("id", own("text").alias("k")).join(keys.select("k", F.col("id").alias("rep")), "k").where("id <> rep").select(F.lit("copy").alias("kind"), F.col("id").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard"))
    rare = keys.select("id", "n", F.posexplode("p").alias("at", "g"))
    met = rare.toDF("a", "na", "pa", "g").join(rare.toDF("b", "nb", "pb", "g"), "g").where("a < b")
    # sizes that allow the level, and enough shingles from the first common one on
    pair = met.where("100 * least(na, nb) >= 85 * greatest(na, nb) and 185 * least(na - pa, nb - pb) >= 85 * (na + nb)").select("a", "b").distinct()
    pair = written(pair)

    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        sets = [shingle_sets(pa.array([zlib.decompress(t).decode() for t in z.to_pylist()], pa.string())) for z in (x, y)]
        return pa.array([jaccard(s, t) for s, t in zip(*sets, strict=True)], pa.float64())

    # texts go to their pairs, packed, not sets, which are as long and cannot be compressed
    packed = c.select("id", F.arrow_udf(lambda texts: pa.array([zlib.compress(t.encode()) for t in texts.to_pylist()], pa.binary()), "binary")("text"))
    j = pair.join(packed.toDF("a", "x"), "a").join(packed.toDF("b", "y"), "b")
    pairs = j.select(F.lit("pair").alias("kind"), "a", "b", F.arrow_udf(alike, "double")("x", "y").alias("j")).where("j >= 0.85").withColumn("jaccard", half_up(F.col("j"))).drop("j")
    return copies.unionByName(pairs).select("kind", F.col("a.doc_id").alias("doc_a"), F.col("a.chunk_index").alias("chunk_a"), F.col("b.doc_id").alias("doc_b"), F.col("b.chunk_index").alias("chunk_b"), "jaccard")


@query("question_lookup", sql("select event_id, user_id, event_type from events where user_id = 17 and event_type <> 'error' and event_type in (select distinct event_type from events where value > 100) and props is not null order by ts desc, event_id limit 20"))
def question_lookup(spark, sf_dir) -> DataFrame:
    """A-01, A-14, A-18, B-01 to B-05, F-01: equality, inequality, not null and IN filters, then the newest rows."""
    e = views.table(spark, sf_dir, "events")
    some = e.where("value > 100").select("event_type").distinct()
    return e.where("user_id = 17 and event_type <> 'error' and props is not null").join(some, "event_type", "left_semi").orderBy(F.desc("ts"), "event_id").select("event_id", "user_id", "event_type").limit(20)


@query("upload_checks", sql(r"""select doc_id, concat_ws(',', case when length(text) = 0 then 'empty' end, case when n < 500 then 'short' end) as warnings, n::bigint as words from (select doc_id, text, len(regexp_extract_all(text, '[^\s]+')) as n from documents)"""))
def upload_checks(spark, sf_dir) -> DataFrame:
    """A-03, H-13."""
    n = F.regexp_count("text", F.lit(r"[^\s]+"))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", F.when(F.length("text") == 0, "empty"), F.when(n < 500, "short")).alias("warnings"), n.cast("long").alias("words"))


@query("weak_question_dedup", sql("select key, min(conv_id)::bigint as first_conv, count(*)::bigint as n from (select conv_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') as key from conversations where role = 'user') group by 1"))
def weak_question_dedup(spark, sf_dir) -> DataFrame:
    """G-04 to G-06."""
    c = views.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", T.squeeze(F.lower("text")).alias("key"))
    return c.groupBy("key").agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("n"))


@query("concepts_decayed", sql(f"""select concept_id, 'Concept ' || concept_id as title, count(*)::bigint as learners, {r6('avg(mastery)')} as mastery, sum((stage = 'complete')::int)::bigint as complete from mastery group by 1""", "attempts", more=_MASTERY))
def concepts_decayed(spark, sf_dir) -> DataFrame:
    """C-01, C-02: concepts with their learners' mastery."""
    m = folds.mastery_fold(views.attempts(spark, sf_dir)).groupBy("concept_id").agg(F.count("*").alias("learners"), half_up(F.avg("mastery")).alias("mastery"), F.count_if(F.col("stage") == "complete").alias("complete"))
    return m.select("concept_id", F.concat(F.lit("Concept "), "concept_id").alias("title"), "learners", "mastery", "complete")


@query("component_scores", sql(f"""select session_id, {r6('avg(cognitive_level / 2.5::double)')} as depth, {r6('avg(difficulty / 3.0::double)')} as difficulty, {r6('avg(least(1.0::double, case difficulty when 1 then 30.0::double when 2 then 60.0::double else 90.0::double end / time_taken))')} as speed, {r6('avg(1 - abs(correct::int::double - confidence))')} as calibration, {r6('0.5::double * avg(correct::int::double) + 0.3::double * (1 - exp(-0.05::double * 24)) + 0.2::double * avg(least(1.0::double, 60.0::double / time_taken))')} as spaced from attempts group by 1""", "attempts"))
def component_scores(spark, sf_dir) -> DataFrame:
    """I-19, I-20."""
    y = F.col("correct").cast("double")
    expected = M.case_map(F.col("difficulty"), {1: 30.0, 2: 60.0}, 90.0)
    spaced = 0.5 * F.avg(y) + 0.3 * (1 - F.exp(F.lit(-0.05 * 24))) + 0.2 * F.avg(F.least(F.lit(1.0), 60.0 / F.col("time_taken")))
    return views.attempts(spark, sf_dir).groupBy("session_id").agg(half_up(F.avg(F.col("cognitive_level") / 2.5)).alias("depth"), half_up(F.avg(F.col("difficulty") / 3.0)).alias("difficulty"), half_up(F.avg(F.least(F.lit(1.0), expected / F.col("time_taken")))).alias("speed"), half_up(F.avg(1 - F.abs(y - F.col("confidence")))).alias("calibration"), half_up(spaced).alias("spaced"))


@query("resolved_edges", sql("select distinct a.node as src, b.node as dst, rel from edges e join nodes a on lower(a.name) = lower('CONCEPT ' || e.src) join nodes b on lower(b.name) = lower('concept ' || e.dst) where a.node <> b.node", "edges", "nodes"))
def resolved_edges(spark, sf_dir) -> DataFrame:
    """B-07, C-07: endpoints resolved by name, case aside."""
    n = views.nodes(spark, sf_dir).select("node", F.lower("name").alias("key"))
    e = views.edges(spark, sf_dir).select(F.lower(F.concat(F.lit("CONCEPT "), "src")).alias("ks"), F.lower(F.concat(F.lit("concept "), "dst")).alias("kd"), "rel")
    j = e.join(n.select(F.col("node").alias("src"), F.col("key").alias("ks")), "ks").join(n.select(F.col("node").alias("dst"), F.col("key").alias("kd")), "kd")
    return j.where("src <> dst").select("src", "dst", "rel").distinct()


@query("canonical_names", sql("select p_partkey, pos, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ') as lite from raw_names", "raw_names"))
def canonical_names(spark, sf_dir) -> DataFrame:
    """H-02."""
    return views.raw_names(spark, sf_dir).select("p_partkey", "pos", T.canonical_lite(F.col("name")).alias("lite"))


