"""Helpers that several corpus operators share: table reading, word splitting,
materialised intermediate tables and connected components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the word pattern of the text contracts (white space is blank, tab to carriage return).
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space of str.split() that the word pattern does not split at.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[str]:
    """Words of a text; str.split() where it means the same, as it is several times faster."""
    if not text:
        return []
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def text_key(text: Column) -> Column:
    """128 bits of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: at most so many rows go to a Python worker at a time, which bounds its memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one in the warehouse only where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return at or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them back."""
    bounded_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, key: str, by: list[str], counts: DataFrame, total: int, how: str = "inner", parts: int = 1024) -> DataFrame:
    """left joined with right, which has at most one row for each key. Keys with more than total / parts rows are dealt over several
    tasks: left's rows by a hash of the columns `by`, right's row once for each part. counts: (key, n) of left's rows, of which there are
    `total`; so fewer than `parts` keys are dealt, at any size, and only those are broadcast. Null keys meet nothing."""
    share = max(1, -(-total // parts))
    hot = F.broadcast(counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = left.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    repeated = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated.hint("merge"), [key, "_part"], how).drop("_part")


def empty_like(df: DataFrame) -> bool:
    return not df.take(1)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, component), the
    component being the smallest node of it. Alternates the large-star and small-star steps, so
    that long chains need a number of rounds that is logarithmic in their length. Each step is a
    pre-aggregated minimum and a join on the node; a hub's join partition can be split by AQE.
    Nodes without an edge to another node are not returned."""
    now = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or (state.n, state.h) == seen:
            break
        seen = (state.n, state.h)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.c).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, large.u == least.c).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = materialise(small.where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
