"""Stored tables that batches are merged into (A-10, A-11): Parquet, partitioned by a hash of the key. A merge reads and replaces only the
partitions that its batch touches, by Spark's dynamic partition overwrite, which commits them together at the end of the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .files import written

#: Rows of a partition, about, when a table is laid out.
BUCKET_ROWS = 500_000
_BUCKET = "_bucket"


def buckets_for(rows: int) -> int:
    """Partitions of a table that is to hold about so many rows; a table keeps the number it was laid out with."""
    return max(8, -(-rows // BUCKET_ROWS))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path; None where nothing was merged yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: that of the highest order; nulls stand lowest. A maximum that combines before the shuffle, not a sort."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def merge_into(path: str, batch: DataFrame, keys: list[str], order: list[str], buckets: int) -> None:
    """Insert the batch's rows, or replace those of the same keys. Of several rows of a key the one of the highest `order` stays, whether it comes
    first or last, so a batch may be repeated, or come late, without a change. Give `order` enough columns to decide."""
    _merge(path, written(batch), keys, _bucket(keys, buckets), order)


def _merge(path: str, batch: DataFrame, keys: list[str], bucket: Column, order: list[str]) -> None:
    """As merge_into, of rows that are the same whenever they are read. They and those they meet are dealt by partition once and written from there:
    Spark moves partitions that are overwritten dynamically into place at the end of the job, so that they may be read in it."""
    rows = batch.withColumn(_BUCKET, bucket)
    touched = [r[_BUCKET] for r in rows.select(_BUCKET).distinct().collect()]  # at most as many numbers as partitions
    if not touched:
        return
    old = stored(batch.sparkSession, path)
    if old is not None:
        rows = rows.unionByName(old.where(F.col(_BUCKET).isin(touched)).select(*rows.columns))
    rows = newest(rows.repartition(_BUCKET), [_BUCKET, *keys], order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored table."""
    return stored(spark, path).drop(_BUCKET)


#: Numbers that names of batches are hashed to.
BATCHES = 1 << 20


def merge_triples(path: str, triples: DataFrame, batch: str, buckets: int) -> None:
    """A-11: triples (doc, chunk, subject, relation, object) of a named batch as nodes, relations and mentions under `path`, each kept by batch: a batch that
    is merged again counts once, and a merge reads and writes its own batch's partitions only. Relations whose name holds more than letters, digits
    and underscores are left out, and so are triples without a subject or object."""
    triples = written(triples.where("subject is not null and object is not null"))
    ends = triples.select("doc", "chunk", F.explode(F.array("subject", "object")).alias("name"))
    safe = triples.where(F.col("relation").rlike("^_*[A-Za-z0-9][A-Za-z0-9_]*$"))
    tables = {
        "nodes": (ends.groupBy("doc", "name").agg(F.count("*").alias("mentions")), ["doc", "name"], ["mentions"]),
        "relations": (safe.select("doc", "subject", "relation", "object"), ["doc", "subject", "relation", "object"], ["batch"]),
        "mentions": (ends, ["doc", "chunk", "name"], ["batch"]),
    }
    for name, (rows, keys, order) in tables.items():
        bucket = F.pmod(F.xxhash64("batch"), F.lit(BATCHES)) * buckets + _bucket(keys, buckets)
        _merge(f"{path}/{name}", rows.withColumn("batch", F.lit(batch)), [*keys, "batch"], bucket, order)


def graph_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(doc, name, mention_count) of the merged graph."""
    return merged(spark, f"{path}/nodes").groupBy("doc", "name").agg(F.sum("mentions").alias("mention_count"))


def graph_relations(spark: SparkSession, path: str) -> DataFrame:
    """(doc, subject, relation, object) of the merged graph, once each."""
    return merged(spark, f"{path}/relations").drop("batch").distinct()


def graph_mentions(spark: SparkSession, path: str) -> DataFrame:
    """(doc, chunk, name) of the merged graph, once each."""
    return merged(spark, f"{path}/mentions").drop("batch").distinct()
