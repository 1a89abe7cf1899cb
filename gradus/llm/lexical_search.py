"""Ranked lexical search as a blocked sparse matrix product.

Scores are the product of two sparse matrices: items by terms, which holds how often a term counts for
an item times the term's weight, and terms by documents, which holds int64 impacts. The second is
written once as rows of documents (only terms that some item asks for) and read twice: for the counts
that weights and impacts need, over all documents, and for the product. There it is cut into blocks of
documents; a block is turned into rows by term, and an item's row of the product is the merge of its
terms' rows in a dense int64 accumulator (Gustavson's row-wise product). Each block hands on an item's
k best documents, which Spark reduces task by task, by groups of tasks, then by item.

The items' vocabulary is what is broadcast. Beyond MOST_WORDS words of items, items are dealt over
blocks by a hash and documents are read once for each block; no row of the product spans two of them.

Defined results: null and empty texts, and texts without a word, are no documents (they count nowhere);
items without a term in any document return no rows; each row of items is an item of its own, also
where ids repeat or are null; rows of documents that repeat are documents of their own; null ids stand
last among equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table
from .terms import LOWER, UPPER, term_array, terms_of

BEST = 10
#: A block of documents ends at so many documents or entries (about 100 MB in a task).
BLOCK_DOCS, BLOCK_ENTRIES = 8192, 2_000_000
#: Words of items that are broadcast at a time.
MOST_WORDS = 2_000_000


def _numbers(id_type: pa.DataType, vocabulary):
    """Rows (id, n, terms, counts) of documents; vocabulary: a broadcast dict from term to number."""
    kind = pa.schema([("id", id_type), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch["text"]:
                words = terms_of(text.as_py())
                t, c = np.unique(np.array([x for x in map(get, words) if x is not None], dtype=np.int32), return_counts=True)
                sizes.append(len(words))
                terms.append(t)
                counts.append(c)
            ends = np.concatenate(([0], np.cumsum([len(t) for t in terms]))).astype(np.int32)
            flat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32))
            out = pa.RecordBatch.from_arrays([batch["id"].cast(id_type), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(ends, flat(x)) for x in (terms, counts))], schema=kind)
            yield out.filter(pc.greater(out["n"], 0))

    return run


class Product:
    """items: for each row of items its terms' numbers and how often each counts; weights by term; documents and their words overall."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_words: int, best: int):
        self.items, self.weights, self.n_docs, self.n_words, self.best = items, weights, n_docs, n_words, best

    def impacts(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 90 + (90 * n * self.n_docs) // self.n_words
        return (1_000_000_000 * counts) // (1000 * counts + 8 * m)

    def block(self, docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, row of the block and score of each item's best documents."""
        n_docs = len(docs)
        size = pc.list_value_length(docs["terms"]).to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(n_docs), size)
        terms, counts = (pc.list_flatten(docs[c]).to_numpy() for c in ("terms", "counts"))
        value = self.impacts(counts.astype(np.int64), docs["n"].to_numpy()[doc])
        order = np.argsort(terms, kind="stable")  # rows by term
        doc, value = doc[order], value[order]
        ends = np.searchsorted(terms[order], np.arange(len(self.weights) + 1))
        place = pc.rank(docs["id"], sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
        merged, none = np.zeros(n_docs, dtype=np.int64), np.zeros(0, dtype=np.int64)
        out = [(none, none, none)]
        for item, (own, times) in enumerate(self.items):
            merged[:] = 0
            for t, k in zip(own, times, strict=True):
                a, b = ends[t], ends[t + 1]
                merged[doc[a:b]] += k * self.weights[t] * value[a:b]  # a document stands once in a row
            hit = np.flatnonzero(merged)
            if len(hit) > self.best:
                hit = hit[merged[hit] >= np.partition(merged[hit], -self.best)[-self.best]]
                hit = hit[np.lexsort((place[hit], -merged[hit]))[: self.best]]
            out.append((np.full(len(hit), item), hit, merged[hit]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, entries = [], 0, 0
    for batch in batches:
        held, docs, entries = [*held, batch], docs + len(batch), entries + len(pc.list_flatten(batch["terms"]))
        if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
            yield pa.Table.from_batches(held)
            held, docs, entries = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held)


def _best(id_type: pa.DataType, product):
    """product: a broadcast Product."""
    kind = pa.schema([("item", pa.int32()), ("id", id_type), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _blocks(batches):
            item, row, score = product.value.block(docs)
            ids = docs["id"].combine_chunks().take(pa.array(row)).cast(id_type)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(score, pa.int64())], schema=kind)

    return run


def search(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", once: bool = True, most: int = MOST_WORDS) -> DataFrame:
    """Rows (item id, rank, doc id, score): for each item its `best` documents by score above 0. once: a term counts once for an item,
    however often the item repeats it."""
    asked = materialise(items.select(F.col(item_col).alias("id"), term_array(F.col(item_text_col)).alias("terms")).where(F.size("terms") > 0))
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // most))
    if blocks == 1:
        return _search(docs, asked, best, id_col, text_col, item_col, once)
    block = lambda b: F.pmod(F.xxhash64("id", "terms"), F.lit(blocks)) == b
    found = None
    for b in range(blocks):
        part = materialise(_search(docs, asked.where(block(b)), best, id_col, text_col, item_col, once))
        found = part if found is None else found.unionByName(part)
    return found


def _search(docs: DataFrame, asked: DataFrame, best: int, id_col: str, text_col: str, item_col: str, once: bool) -> DataFrame:
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    rows = asked.collect()  # at most MOST_WORDS words, or one item
    number: dict[bytes, int] = {}
    terms = [[number.setdefault(t.encode("utf-8", "surrogatepass"), len(number)) for t in r["terms"]] for r in rows]
    matrix = [np.unique(np.array(t, dtype=np.int32), return_counts=True) for t in terms]
    matrix = [(t, np.ones_like(n) if once else n) for t, n in matrix]

    id_field = T.StructField("id", docs.schema[id_col].dataType)
    id_type = pa.int64() if isinstance(id_field.dataType, T.LongType) else pa.int32() if isinstance(id_field.dataType, T.IntegerType) else pa.string()
    if id_type == pa.string():
        id_field = T.StructField("id", T.StringType())
    texts = docs.select(F.col(id_col).cast(id_field.dataType).alias("id"), F.col(text_col).alias("text"))
    lists = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "counts")]
    counted = materialise(texts.mapInArrow(_numbers(id_type, sc.broadcast(number)), T.StructType([id_field, T.StructField("n", T.LongType()), *lists])))
    n_docs, n_words = counted.agg(F.count("*"), F.sum("n")).first()
    holding = dict(map(tuple, counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect()))  # a row for each term of the items
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(number))], dtype=np.int64)

    product = sc.broadcast(Product(matrix, weights, n_docs, n_words, best))
    scored = counted.mapInArrow(_best(id_type, product), T.StructType([T.StructField("item", T.IntegerType()), id_field, T.StructField("score", T.LongType())]))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    groups = max(1, math.isqrt(counted.rdd.getNumPartitions()))
    for keys in (["item", "part"], ["item"]):
        scored = scored.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(groups))) if "part" in keys else scored
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_col, asked.schema["id"].dataType)]))
    out = scored.join(F.broadcast(ids), "item")  # a row for each item of the block
    return out.select(item_col, "rank", F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "score")


def op11_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_sql() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
with d as (select row_number() over () as r, doc_id, {words} as words from documents),
b as (select row_number() over () as item, item_id, {words} as words from benchmark),
q as (select distinct item, unnest(words) as w from b),
n as (select r, len(words)::bigint as n from d where len(words) > 0),
whole as (select count(*)::bigint as nn, sum(n)::bigint as ll from n),
tf as (select r, w, count(*)::bigint as tf from (select r, unnest(words) as w from d) where w in (select w from q) group by all),
weight as (select w, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from tf, whole group by w, nn),
impact as (select r, w, (1000000000::bigint * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)) as impact from tf join n using (r), whole),
score as (select item, r, sum(weight * impact)::bigint as score from q join impact using (w) join weight using (w) group by item, r having sum(weight * impact) > 0),
o as (select item, doc_id, score, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from score join d using (r))
select item_id, rank::int as rank, doc_id, score from o join b using (item) where rank <= {BEST}"""
