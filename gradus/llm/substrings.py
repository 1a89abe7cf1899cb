"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the MER-word piece with the least hash.
Consecutive windows of a text that share a minimiser form one super-k-mer, which travels as one
packed string to the minimiser's bucket. There its windows are cut out again and sorted, so that
equal windows stand together and the least id among them is known exactly.

Two things keep it in bounds. A repeated window has the same minimiser wherever it stands, so
super-k-mers whose minimiser occurs in one document only are not sent at all. The windows of buckets
with more than HOT super-k-mers are compared by 128-bit digests in an aggregation that is spread over
all tasks, so that a passage which many documents share lands in no single task.

Defined results: null texts have no words; nothing is removed from texts under WINDOW words; a null
id has no smaller id and is smaller than none, so its words stay and remove nothing; rows that repeat
an id belong to one document and are treated alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, words_of

WINDOW, MER, HOT = 50, 8, 4000


def super_kmers(words: list[str], window: int = WINDOW, mer: int = MER) -> list[tuple[int, int, int]]:
    """(minimiser hash, first word, number of words) of the runs of windows that share a minimiser."""
    n = len(words)
    if n < window:
        return []
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    m = n - mer + 1
    code = h[:m].copy()
    with np.errstate(over="ignore"):
        for k in range(1, mer):
            code = code * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
            code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
    width, low, span = window - mer + 1, code, 1
    while span * 2 <= width:  # least of spans that double
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts = np.concatenate(([0], cut))
    ends = np.concatenate((cut, [len(low)]))
    keys = low[starts].view(np.int64)
    return [(int(k), int(a), int(b - a + window - 1)) for k, a, b in zip(keys, starts, ends, strict=True)]


def _minimisers(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, ids, texts, counts = [], [], [], []
            for i, h, text in zip(batch["id"], batch["h"], batch["text"], strict=True):
                words, own = words_of(text), {}
                for k, a, n in super_kmers(words, window):
                    own.setdefault(k, []).append((a, n))
                keys += own
                ids += [i] * len(own)
                texts += [h] * len(own)
                counts += [len(at) if len(at) == 1 else len({" ".join(words[a : a + n]) for a, n in at}) for at in own.values()]
            yield pd.DataFrame({"key": np.array(keys, dtype=np.int64), "id": np.array(ids, dtype=np.int64), "h": np.array(texts, dtype=np.int64), "n": np.array(counts, dtype=np.int64)})

    return run


def _packed(window: int):
    """Super-k-mers of the wanted buckets; one that a text repeats is sent once, with all its places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, h, text, keys, sizes in zip(batch["id"], batch["h"], batch["text"], batch["keys"], batch["sizes"], strict=True):
                words, want = words_of(text), dict(zip(keys, sizes, strict=True))
                own: dict[tuple[int, str], list[int]] = {}
                for k, a, n in super_kmers(words, window):
                    if k in want:
                        own.setdefault((k, " ".join(words[a : a + n])), []).append(a)
                rows += [(k, want[k], i, h, starts, packed) for (k, packed), starts in own.items()]
            yield pd.DataFrame(rows, columns=["key", "size", "id", "h", "starts", "packed"])

    return run


def _windows(packed: str, window: int) -> list[str]:
    begins = [0, *accumulate(len(w) + 1 for w in packed.split(" "))]
    return [packed[a : b - 1] for a, b in zip(begins, begins[window:], strict=False)]


def _runs(starts, hit: list[int], window: int) -> list[tuple[int, int]]:
    """(first word, number of words) that flagged windows (numbers in ascending order) of a super-k-mer cover."""
    at = np.array(hit)
    breaks = np.flatnonzero(np.diff(at) > 1)
    spans = [(int(a), int(b - a) + window) for a, b in zip(at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]], strict=True)]
    return [(int(s) + a, n) for s in starts for a, n in spans]


def _sort_bucket(window: int):
    """The runs of words that windows with a smaller id elsewhere cover, from rows sorted by bucket."""

    def settle(group: list[tuple]) -> list[tuple[int, int, int, int]]:
        out, least = [], {}
        for _, i, _, _, packed in group:
            least[packed] = min(i, least.get(packed, i))
        flagged: dict[str, list[int]] = {}
        if len(least) > 1:
            last, first = None, None
            for w, i, packed, j in sorted((w, i, p, j) for p, i in least.items() for j, w in enumerate(_windows(p, window))):
                if w != last:
                    last, first = w, i
                elif i > first:
                    flagged.setdefault(packed, []).append(j)
        for _, i, h, starts, packed in group:
            hit = range(packed.count(" ") + 2 - window) if i > least[packed] else sorted(set(flagged.get(packed, ())))
            if len(hit):
                out += [(i, h, a, n) for a, n in _runs(starts, hit, window)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            rows = []
            for row in zip(batch["key"], batch["id"], batch["h"], batch["starts"], batch["packed"], strict=True):
                if held and held[0][0] != row[0]:
                    rows += settle(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(rows, columns=["id", "h", "start", "n"])
        yield pd.DataFrame(settle(held) if held else [], columns=["id", "h", "start", "n"])

    return run


def _digests(window: int):
    """Windows of large buckets, one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest(), i, h, starts, j) for i, h, starts, packed in zip(batch["id"], batch["h"], batch["starts"], batch["packed"], strict=True) for j, w in enumerate(_windows(packed, window))]
            yield pd.DataFrame(rows, columns=["digest", "id", "h", "starts", "j"])

    return run


def _cut(texts: Iterator[pd.DataFrame], keep_text: bool) -> Iterator[pd.DataFrame]:
    for batch in texts:
        out = []
        for text, runs in zip(batch["text"], batch["runs"], strict=True):
            words = words_of(text)
            kept = words
            if runs is not None and len(runs):
                gone = np.zeros(len(words), dtype=bool)
                for r in runs:
                    gone[r["start"] : r["start"] + r["n"]] = True
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            joined = " ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest(), joined if keep_text else None))
        yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"]).assign(id=batch["id"].to_numpy())


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 and kept, the words that stay joined by blanks
    (null without keep_text). hot: super-k-mers from which a bucket's windows are compared as digests, spread out."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    met = materialise(rows.where("id is not null").mapInPandas(_minimisers(window), "key long, id long, h long, n long"))
    shared = met.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.sum("n").alias("size")).where("a < b").select("key", "size")
    wanted = met.join(shared, "key").groupBy("id", "h").agg(F.collect_list("key").alias("keys"), F.collect_list("size").alias("sizes"))
    packed = rows.join(wanted, ["id", "h"]).select("id", "h", "text", "keys", "sizes").mapInPandas(_packed(window), "key long, size long, id long, h long, starts array<int>, packed string")
    packed = materialise(packed)
    cold = packed.where(F.col("size") <= hot).select("key", "id", "h", "starts", "packed").repartition("key").sortWithinPartitions("key", "id")
    runs = cold.mapInPandas(_sort_bucket(window), "id long, h long, start int, n int")
    single = packed.where(F.col("size") > hot).select("id", "h", "starts", "packed").mapInPandas(_digests(window), "digest binary, id long, h long, starts array<int>, j int")
    least = single.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least")
    more = single.join(least, "digest").where("id > least").select("id", "h", F.explode("starts").alias("start"), "j").select("id", "h", (F.col("start") + F.col("j")).alias("start"), F.lit(window).alias("n"))
    runs = runs.unionByName(more).groupBy("id", "h").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    done = rows.join(runs, ["id", "h"], "left").select("id", "text", "runs")
    out = done.mapInPandas(lambda b: _cut(b, keep_text), "n_words long, n_removed long, kept_sha256 string, kept string, id long")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).drop("kept")


def op9_sql() -> str:
    """Windows by their md5; a document's words that no repeated window covers, joined again."""
    return rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
n as (select doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) as k from d, unnest(range(1, len(w) - {WINDOW - 2})) as u(i)),
f as (select k, min(doc_id) as least from n group by 1 having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, i + t as j from (select n.doc_id, n.i from n join f on n.k = f.k and n.doc_id > f.least), range({WINDOW}) as r(t)),
kept as (select w.doc_id, count(*) as n, string_agg(word, ' ' order by w.j) as words from (select doc_id, j, w[j] as word from d, unnest(range(1, len(w) + 1)) as u(j)) w anti join gone on gone.doc_id = w.doc_id and gone.j = w.j group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.words, '')) as kept_sha256 from d left join kept on kept.doc_id = d.doc_id"""
