"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words; every document of the source is expected
``target / source size`` times. Expected copies are summed along the source's documents, a random
offset of the source is added, and a document is emitted once for every integer that its part of
the sum crosses. The order within a source spreads sizes evenly, so that the words taken come near
the target and not only the number of documents.

The sums are made in two levels: a source is cut into buckets by a hash of the row, ranks are
counted inside a bucket, and the buckets' own counts are summed over the small table of buckets. No
source is gathered in one task. Everything is DataFrame functions.

Defined results: null texts have size 0; a null source is a source of its own, last in order; rows
that are repeated are documents of their own; sources without words are emitted at rate 0; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SQL

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2.0
#: Rows of a bucket, on average over the table.
BUCKET_ROWS = 2000


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def _name(col: str) -> Column:
    """A source as a key that keeps null apart from any text."""
    return F.coalesce(F.concat(F.lit("s"), F.col(col)), F.lit("n"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """sizes: one row per source (source, n_docs, source_size). Adds weight, target and rate.

    Targets are shares of the budget by weight, cut at ``repeats`` times the source's size; what is
    cut goes to the others by weight until none is above. That fixed point is found at once: in the
    order of cap per weight, the first source whose cap lies above the level of the rest ends the cut ones.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.expr(f"cast((row_number - 1) % {len(weights)} + 1 as int)"))
    t = sizes.withColumn("row_number", F.row_number().over(by_name)).withColumn("weight", weight)
    t = t.withColumn("cap", F.col("source_size") * F.lit(repeats))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "row_number")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onward = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    budget = F.sum("source_size").over(everything) * F.lit(share)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    t = t.withColumn("level", level)
    held = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("row_number"), F.col("level")))).over(everything)
    t = t.withColumn("level", held["level"])
    t = t.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    return t.select("source", "n_docs", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Adds size, source_size, target and copies to (all columns of) docs as _size and so on."""
    spark = docs.sparkSession
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_SQL), F.lit(0))).cast("long")
    d = docs.withColumns({"_size": size, "_key": _name(source_col), "_tie": F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), "_digest": F.md5(F.coalesce(F.col(text_col), F.lit("")))})
    # by id and text, so that rows without an id or of one id spread too; only rows that are equal in both share a bucket for sure
    d = d.withColumn("_part", F.conv(F.substring(F.md5(F.concat_ws("|", "_tie", "_digest")), 9, 8), 16, 10).cast("long"))
    sizes = d.groupBy(F.col(source_col).alias("source"), "_key").agg(F.count("*").alias("n_docs"), F.sum("_size").alias("source_size"))
    n_docs = docs.count()
    parts = max(1, -(-n_docs // BUCKET_ROWS))
    d = d.withColumn("_bucket", F.col("_part") % F.lit(parts))
    targets = source_targets(sizes)
    # rows of (source, bucket); summed over the buckets of a source
    counts = d.groupBy("_key", "_bucket").agg(F.count("*").alias("n"))
    prior = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(prior), F.lit(0))).drop("n")
    plan = counts.join(targets.withColumn("_key", _name("source")).select("_key", "source_size", "target", "rate"), "_key")
    rank = F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy(F.when(F.col("_bucket") % 2 == 0, F.col("_size")).otherwise(-F.col("_size")), "_tie", "_digest"))
    d = d.withColumn("_rank", rank).join(plan, ["_key", "_bucket"])
    offset = _unit(F.concat(F.lit(f"{seed}|"), F.col("_key")))
    upto = lambda k: F.floor(k * F.col("rate") + offset)
    k = F.col("_before") + F.col("_rank")
    return d.withColumn("copies", F.least(upto(k) - upto(k - 1), F.lit(int(REPEATS))).cast("int"))


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies and taken (copies times size)."""
    d = _placed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source_name")), "id", "text", "source_name", seed)
    return d.select(F.col("id").alias(id_col), F.col("source_name").alias("source"), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The mixture itself: every row of docs as often as it is emitted, with docs' columns."""
    d = _placed(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_id"), docs[text_col].alias("_text"), docs[source_col].alias("_source")), "_id", "_text", "_source", seed)
    return d.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mixing_plan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("source")


def op10_sql() -> str:
    return rf"""
with d as (select doc_id, text, source, case when source is null then 'n' else 's' || source end as k, len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}'))::bigint as size, md5('7|' || doc_id::varchar) as tie from documents),
b as (select *, ('0x' || substr(md5(tie || '|' || md5(coalesce(text, ''))), 9, 8))::bigint % greatest(1, (select (count(*) + {BUCKET_ROWS - 1}) // {BUCKET_ROWS} from documents)) as bucket from d),
s as (select k, source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) as rn from d group by k, source),
c as (select *, 2.0::double * source_size as cap, [3.0::double, 1.0::double, 2.0::double][(rn - 1) % 3 + 1] as weight from s),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rn rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, rn rows between current row and unbounded following) as level from c),
t as (select l.k, l.source_size, least(cap, coalesce(h.level * weight, cap)) as target from l, (select first(level order by cap / weight, rn) as level from l where cap >= level * weight) h),
r as (select *, case when source_size > 0 then target / source_size else 0 end as rate from t),
n as (select k, bucket, coalesce(sum(count(*)) over (partition by k order by bucket rows between unbounded preceding and 1 preceding), 0) as before from b group by k, bucket),
p as (select b.*, before + row_number() over (partition by b.k, b.bucket order by case when b.bucket % 2 = 0 then size else -size end, tie, md5(coalesce(text, ''))) as i, r.source_size, r.target, r.rate, ('0x' || substr(md5('7|' || b.k), 1, 8))::bigint / 4294967296.0::double as u from b join n on b.k = n.k and b.bucket = n.bucket join r on b.k = r.k),
o as (select *, least(floor(i * rate + u) - floor((i - 1) * rate + u), 2)::int as copies from p)
select doc_id, size, source_size, target::double as target, copies, (copies * size)::bigint as taken from o"""
