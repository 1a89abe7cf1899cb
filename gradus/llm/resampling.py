"""Importance resampling towards a target distribution.

Texts are bags of hashed n-grams: every run of words is a feature, and crc32 modulo the number of
buckets gives its bucket. Counts by bucket over all documents and over all target texts give each
bucket's gain, the logarithm of the ratio of both smoothed shares. A document's weight is the sum of
the gains of its features; Gumbel noise from a digest of its id makes the highest scores a sample
without replacement in proportion to the importance weights.

Only SQL functions: features are exploded and counted by bucket (combined before the shuffle, so at
most one row for each bucket and task travels), the table of gains has one row a bucket and is
written before it is joined, and sums of a document combine in the task that reads it. Ranks come
from a range-partitioned sort: each row knows its place in its sorted partition, and the partitions'
sizes, summed over one row each, are added. The sorted rows are written first, so that places hold.

Defined results: null and empty texts have no features and weight 0; a null id draws noise as an
empty id does and stands last among equal scores; rows that are repeated are documents of their own;
an empty corpus gives no rows, and without target texts gains only compare with the uniform share;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .terms import LOWER, UPPER, ngrams, term_array

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 10, 20, 2024
#: Gains of up to so many buckets are broadcast (12 bytes each); more are joined by a shuffle of counts by document and bucket.
BROADCAST_BUCKETS = 1 << 20


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, text_col: str, least: int, most: int, buckets: int, name: str) -> DataFrame:
    """Features of all texts by bucket: rows (bucket, <name>)."""
    words = texts.select(term_array(F.col(text_col)).alias("words"))
    features = words.select(F.explode(ngrams(F.col("words"), least, most)).alias("feature"))
    return features.select(_bucket(F.col("feature"), buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, gain), one for each bucket."""
    s = bucket_counts(docs, text_col, least, most, buckets, "s")
    t = bucket_counts(target, target_text_col, least, most, buckets, "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    whole = Window.partitionBy(F.lit(0))  # one row a bucket
    d = lambda c: c.cast("double")
    ratio = (d(F.col("t") + 1) * d(F.sum("s").over(whole) + buckets)) / (d(F.col("s") + 1) * d(F.sum("t").over(whole) + buckets))
    return materialise(every.select("bucket", F.floor(1000.0 * F.ln(ratio)).cast("long").alias("gain")))


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per input row: row, id, digest (of the text), n_words, n_features, weight and score."""
    gains = bucket_gains(docs, target, text_col, target_text_col, least, most, buckets)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), term_array(F.col(text_col)).alias("words"))
    own = ["row", "id", "digest", "n_words"]
    features = rows.select("row", "id", "digest", F.size("words").alias("n_words"), F.explode_outer(ngrams(F.col("words"), least, most)).alias("feature"))
    features = features.select(*own, _bucket(F.col("feature"), buckets).alias("bucket"))
    if buckets <= BROADCAST_BUCKETS:
        features, gains = features.withColumn("n", F.when(F.col("bucket").isNotNull(), 1).otherwise(0)), F.broadcast(gains)
    else:
        features = features.groupBy(*own, "bucket").agg(F.count("bucket").alias("n"))
    summed = features.join(gains, "bucket", "left").groupBy(*own).agg(F.sum("n").alias("n_features"), F.coalesce(F.sum(F.col("gain") * F.col("n")), F.lit(0)).alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    return summed.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: id, digest (of the text), n_features, weight, score and rank: from 1 by descending score,
    then id, for the `percent` of the documents of at least `min_words` words that are drawn; else null."""
    scored = materialise(importance_scores(docs, target, id_col, text_col, target_text_col, least, most, buckets, seed))
    fit = F.col("n_words") >= min_words
    drawn = scored.where(fit).count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("digest"), F.col("row")]
    placed = scored.where(fit).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(placed.withColumn("place", F.monotonically_increasing_id()))  # partition number, then 33 bits of place in it
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row for each partition of the sort
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= drawn, rank))
    names = ["id", "digest", "n_features", "weight", "score", "rank"]
    out = ranked.select(*names).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")).select(*names))
    return out.withColumnRenamed("id", id_col)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of docs, with docs' columns. Rows that repeat id and text stand side by side in the order, so at most one such
    group is drawn in part: of that group it is any as many rows."""
    ranked = resample(docs, target, id_col, text_col, **options)
    groups = materialise(ranked.groupBy(F.col(id_col).alias("_id"), F.col("digest").alias("_digest")).agg(F.count("rank").alias("_n"), F.count("*").alias("_of")).where("_n > 0"))
    digest = F.md5(F.coalesce(docs[text_col], F.lit("")))
    full = groups.where("_n = _of")
    whole = docs.join(full, docs[id_col].eqNullSafe(full["_id"]) & (digest == full["_digest"]), "left_semi")
    part = groups.where("_n < _of").first()
    if part is None:
        return whole
    return whole.unionByName(docs.where(docs[id_col].eqNullSafe(F.lit(part["_id"])) & (digest == part["_digest"])).limit(part["_n"]))


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents").select("doc_id", "text"), read("benchmark").select("text")).drop("digest")


def op13_sql() -> str:
    """crc32 byte by byte, over the distinct words."""
    return rf"""
with k as (select list(list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as t from range(256) r(n)),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
f as (select r, unnest(words) as w from d), g as (select unnest(words) as w from b),
v as (select w, hex(encode(w)) as h from (select w from f union select w from g)),
c as (select w, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, i * 2 + 1, 2))::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} as bucket from v, k),
s as (select bucket, count(*) as s from f join c using (w) group by bucket), t as (select bucket, count(*) as t from g join c using (w) group by bucket),
gain as (select n as bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from f) + {BUCKETS})::double) / ((coalesce(s, 0) + 1)::double * ((select count(*) from g) + {BUCKETS})::double)))::bigint as gain from range({BUCKETS}) r(n) left join s on s.bucket = n left join t on t.bucket = n),
weight as (select r, sum(gain)::bigint as weight from f join c using (w) join gain using (bucket) group by r),
p as (select d.r, doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double))))::bigint as score from d left join weight using (r)),
o as (select r, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from p where n_features >= {MIN_WORDS})
select doc_id, n_features, weight, score, case when rank <= {PERCENT} * n // 100 then rank end::bigint as rank from p left join o using (r)"""
