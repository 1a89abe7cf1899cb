"""Benchmark decontamination by a broadcast hash set of test n-grams.

A window is WINDOW consecutive words of a benchmark item, or all words of a shorter item. The windows'
hashes are broadcast, sorted, with the word numbers they stand for. Each text is scanned once: words
outside the benchmark's vocabulary rule windows out, the rolling hash of the others is looked up, and a
hit counts only if the words themselves agree. Hit words are cut out, or the document goes.

What is broadcast is bounded: beyond MOST_WORDS words, windows are dealt over blocks by a hash, texts
are scanned once for each block, and hits are put together by id and text. Results are the same.

Defined results: null and empty texts have no words and no hits; null and empty items have no window;
an item without an id marks words but is not counted or named; items that repeat an id are one item;
rows that are repeated are reported as often as they occur; other columns are ignored, and kept where
documents are returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, text_key
from .terms import LOWER, UPPER, term_array, terms_of

WINDOW = 10
#: Words of benchmark windows that are broadcast at a time: about 100 MB at the driver and in each Python worker.
MOST_WORDS = 4_000_000
#: Fixed value: a word of a text whose case is not folded.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND = "struct<n_words:long,spans:array<struct<start:int,n:int>>,items:array<string>>"


class WindowIndex:
    """Windows (words joined by blanks, names of their items) by length: sorted hashes and the words' numbers."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        self.number: dict[bytes, int] = {}
        self.tables: list[tuple[int, np.uint64, np.ndarray, np.ndarray, list[list[str]]]] = []
        by_length: dict[int, list[tuple[list[int], list[str]]]] = {}
        for window, names in windows:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in window.encode("utf-8", "surrogatepass").split()]
            by_length.setdefault(len(ids), []).append((ids, names))
        for n, rows in sorted(by_length.items()):
            words, factor = np.array([ids for ids, _ in rows], dtype=np.int64), np.uint64(0x9E3779B97F4A7C15)
            while len(np.unique(code := self._hash(words.T, factor))) < len(rows):  # another factor, until hashes of these windows differ
                factor = factor * np.uint64(0xD1342543DE82EF95) + np.uint64(2) | np.uint64(1)
            order = np.argsort(code)
            self.tables.append((n, factor, code[order], words[order], [rows[i][1] for i in order]))

    @staticmethod
    def _hash(columns, factor: np.uint64) -> np.ndarray:
        code = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in columns:
                code = code * factor + c.astype(np.uint64)
                code = code ^ (code >> np.uint64(31))
        return code

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, the runs (first word, words) that windows cover, and the names of the windows' items."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in terms_of(text)], dtype=np.int64)
        unknown, edges, names = np.concatenate(([0], np.cumsum(ids == 0))), np.zeros(len(ids) + 1, dtype=np.int64), set()
        for n, factor, codes, words, owners in self.tables:
            at = np.flatnonzero(unknown[n:] == unknown[:-n]) if len(ids) >= n else ()
            if not len(at):
                continue
            code = self._hash((ids[at + k] for k in range(n)), factor)
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            same = codes[place] == code
            at, place = at[same], place[same]
            for k in range(n):
                same = ids[at + k] == words[place, k]
                at, place = at[same], place[same]
            edges[at] += 1  # a window starts at a place once for each length
            edges[at + n] -= 1
            names.update(name for p in np.unique(place) for name in owners[p])
        covered = np.concatenate(([0], np.cumsum(edges) > 0, [0])).astype(np.int8)
        turns = np.flatnonzero(np.diff(covered))
        return len(ids), [(int(a), int(b - a)) for a, b in zip(turns[::2], turns[1::2], strict=True)], sorted(names)


def _scanner(index) -> Column:
    """index: a broadcast WindowIndex."""

    @F.arrow_udf(FOUND)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))), ("items", pa.list_(pa.string()))])
        for batch in texts:
            found = (index.value.scan(t.as_py()) for t in batch)
            yield pa.array([{"n_words": n, "spans": [{"start": a, "n": m} for a, m in spans], "items": names} for n, spans, names in found], kind)

    return scan


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Rows (window, n, items) of distinct windows: words joined by blanks, their number, names of the items in order."""
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), term_array(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window + 1, F.lit(1))
    rows = items.select("name", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("words", i, window))).alias("w"))
    return rows.groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("n")).agg(F.array_sort(F.collect_set("name")).alias("items"))


def _scanners(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> tuple[int, Iterator]:
    """Number of blocks of windows, usually one, and a scanner for each, to be run before the next one is made."""
    windows = materialise(item_windows(benchmark, item_col, text_col, window))
    blocks = max(1, -(-(windows.agg(F.sum("n")).first()[0] or 0) // most))

    def scanners():
        for b in range(blocks):
            rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).select("window", "items").collect()
            shared = docs.sparkSession.sparkContext.broadcast(WindowIndex([(r["window"], list(r["items"])) for r in rows]))
            yield _scanner(shared)
            shared.unpersist()

    return blocks, scanners()


def _whole_spans(spans: Column) -> Column:
    """Runs of words from spans that may overlap."""
    order = F.array_sort(spans)
    end = lambda s: s["start"] + s["n"]
    last = lambda a: F.element_at(a, -1)
    both = lambda a, s: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), (F.greatest(end(last(a)), end(s)) - last(a)["start"]).alias("n"))))
    return F.aggregate(order, F.array().cast("array<struct<start:int,n:int>>"), lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= end(F.try_element_at(a, F.lit(-1)))), both(a, s)).otherwise(F.concat(a, F.array(s))))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most: int = MOST_WORDS) -> DataFrame:
    """One row per input row: id, n_words, spans (array of runs: start, n, in words) and items (names of the items with occurring
    windows, sorted as strings)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks, scans = _scanners(docs, benchmark, item_col, item_text_col, window, most)
    if blocks == 1:
        return rows.select("id", next(scans)("text").alias("found")).select(F.col("id").alias(id_col), "found.*")
    hits = _hits(rows, scans)
    out = hits.select("id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def _hits(rows: DataFrame, scans: Iterator) -> DataFrame:
    """What all blocks find, by id and text. Repeated rows are counted before the shuffle."""
    found = None
    for b, scan in enumerate(scans):
        one = rows.select("id", text_key(F.col("text")).alias("h"), scan("text").alias("found")).select("id", "h", "found.*")
        one = materialise(one.groupBy("id", "h", "n_words", "spans", "items").agg(F.count("*").cast("int").alias("times")).withColumn("block", F.lit(b)))
        found = one if found is None else found.unionByName(one)
    met = found.groupBy("id", "h", "n_words", "times").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return met.withColumn("spans", _whole_spans(F.col("spans")))


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words of the spans and what stands between those words."""
    out = []
    for text, runs in zip(texts, spans, strict=True):
        text, runs = text.as_py(), runs.as_py()
        if text and runs:
            words = [m.span() for m in WORD.finditer(text)]
            edges = [0, *(x for r in runs for x in (words[r["start"]][0], words[r["start"] + r["n"] - 1][1])), len(text)]
            text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out.append(text)
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most: int = MOST_WORDS) -> DataFrame:
    """Rows of docs, with docs' columns: hit words cut out of the texts (remove="spans"), or without the documents that have any
    (remove="documents")."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    blocks, scans = _scanners(docs, benchmark, item_col, item_text_col, window, most)
    if blocks == 1:
        rows = rows.withColumn("spans", next(scans)("text")["spans"])
    else:
        hits = _hits(rows, scans).where(F.size("spans") > 0).select(F.col("id").alias("_id"), F.col("h").alias("_h"), "spans")
        rows = rows.join(hits, F.col("id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_h")), "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")))
    if remove == "documents":
        return rows.where(F.size("spans") == 0).select("_row.*")
    return rows.withColumn("_row", F.col("_row").withField(text_col, F.arrow_udf(_without, "string")("text", "spans"))).select("_row.*")


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["n"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op12_sql() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
with d as (select row_number() over () as r, doc_id, {words} as words from documents),
b as (select item_id::varchar as item, {words} as words from benchmark),
win as (select distinct item, array_to_string(words[i + 1 : i + {WINDOW}], ' ') as w, least(len(words), {WINDOW}) as n from b, unnest(range(greatest(len(words) - {WINDOW} + 1, 1))) as u(i) where len(words) > 0),
lengths as (select distinct n from win),
hit as (select r, i, lengths.n, w from (select d.r, u.i, lengths.n, array_to_string(d.words[u.i + 1 : u.i + lengths.n], ' ') as w from d, lengths, unnest(range(len(d.words) - lengths.n + 1)) as u(i)) lengths where w in (select w from win)),
met as (select distinct r, item from hit join win using (w, n)),
names as (select r, count(item) as n_items, coalesce(string_agg(item, ',' order by item), '') as list from met group by r),
n as (select r, count(distinct i + k) as n_hit from hit, unnest(range(n)) as u(k) group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join names using (r)"""
