"""MinHash near-dedup with ProbMinHash signatures.

Shingles of SHINGLE words are weighted by 1 + ln(occurrences). Each shingle is a Poisson process
whose rate is its weight: exponential arrivals choose a register and hold it if no earlier arrival
did; a shingle stops as soon as its next arrival is later than every register. Two texts agree in a register with the
probability Jaccard similarity of their weighted shingles. Signatures are cut into bands; texts that share a band are
candidates, and a pair is linked if that same similarity, computed exactly, is at least THRESHOLD (for texts
that repeat no shingle it is the Jaccard similarity of their sets). Groups are the connected components of the links.

Exact copies are put together first and only one of them goes on. Buckets are not expanded into all pairs:

1. In each bucket, the likeliest pairs by signature form a spanning forest. Each text's best pair of all buckets is
   verified first, then the pairs of the forests that still join different groups.
2. Where that leaves a bucket's texts in different groups, every pair of them from different groups is looked at again by its
   signatures: the texts outside the bucket's largest group meet all of its texts, in tasks of two blocks of CHUNK. Those that may be
   in a link are compared exactly in such a task, and only links that join groups leave it.

So any link between candidates is either found or joins texts that are joined already. A pair is left out by its signatures only
where the estimate is MARGIN below the threshold, which a link is with probability under 1e-6.

Only signatures and pairs are shuffled while candidates are searched; texts are shuffled by id once and then twice for
each list of pairs to verify. Joins of growing tables are merge joins at every size.

Defined results: a null or empty text has no shingles, so it is alone in its group; a text under
SHINGLE words has one shingle, all of its words; rows that repeat an id are one document if their text is the same, and
get the group of their own text otherwise; rows without an id keep a null group and stay; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, table, text_key, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: Registers; bands of ROWS registers each. A pair of similarity p shares no band with probability (1 - p^4)^24: 4e-6 for 0.8.
REGISTERS, BANDS, ROWS = 256, 24, 4
#: Nearly five standard deviations of the estimate of a similarity of 0.8 from 256 registers.
MARGIN = 0.12
#: Texts of a block.
CHUNK = 512
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return h ^ (h >> np.uint64(31))


def shingle_hashes(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the consecutive shingles of a text, in order."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            out = out * _M3 + h[k : k + n]
    return _mix(out)


def weighted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles, sorted, and their weights."""
    kinds, counts = np.unique(h, return_counts=True)
    return kinds, 1 + np.log(counts)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common d of 1 / (sum over all e of max(a_e / a_d, b_e / b_d)), from sorted shingles and their weights.

    The inner sum is a's weight where a_e / b_e is at least a_d / b_d, and b's elsewhere: running sums in the order of that ratio."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i], b[1][j]
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    first = np.searchsorted(ratio, ratio, side="left")  # rows of a smaller ratio
    below = np.concatenate(([0.0], np.cumsum(y)))[first]
    above = x.sum() - np.concatenate(([0.0], np.cumsum(x)))[first]
    return float((x / (only_x + above + ratio * (only_y + below))).sum())


def signatures(texts: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of many texts at once, from their shingle hashes; a row of register values for each text."""
    arrival = np.full(len(texts) * registers, np.inf)
    holder = np.zeros(len(texts) * registers, dtype=np.uint64)
    parts, weights, owner = [], [], []
    for i, h in enumerate(texts):
        if len(h):
            kinds, weight = weighted(h)
            parts.append(kinds)
            weights.append(weight)
            owner.append(np.full(len(kinds), i))
    if not parts:
        return holder.reshape(len(texts), registers)
    element, weight, text = np.concatenate(parts), np.concatenate(weights), np.concatenate(owner)
    clock, step = np.zeros(len(element)), 0
    rows, latest = arrival.reshape(-1, registers), np.full(len(texts), np.inf)
    while len(element):
        step += 1
        with np.errstate(over="ignore"):
            draw = _mix(element + _M3 * np.uint64(2 * step + 1))
        clock = clock - np.log1p(-(draw >> np.uint64(11)).astype(float) / 2.0**53) / weight
        at = text * registers + (_mix(draw ^ _M2) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(arrival, at, clock)
        first = clock == arrival[at]
        holder[at[first]] = element[first]
        active = text[np.r_[True, text[1:] != text[:-1]]]  # texts stay in order
        latest[active] = rows[active].max(1)
        live = clock < latest[text]
        element, weight, text, clock = element[live], weight[live], text[live], clock[live]
    return holder.reshape(len(texts), registers)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for a in range(0, len(whole), 1000):
            batch = whole.iloc[a : a + 1000]
            sig = signatures([shingle_hashes(words_of(t)) for t in batch["text"]])
            with np.errstate(over="ignore"):
                bands = np.zeros((len(batch), BANDS), dtype=np.uint64)
                for k in range(ROWS):
                    bands = _mix(bands * _M3 + sig[:, k * BANDS : (k + 1) * BANDS] + np.arange(BANDS, dtype=np.uint64))
            small = _mix(sig).astype(np.uint8)
            yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "bands": list(bands.view(np.int64)), "sig": [s.tobytes() for s in small]})


def _registers(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(sigs), -1)


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of a with each row of b, from registers of one byte."""
    if len(a) * len(b) <= 4096:
        same = (a[:, None, :] == b[None, :, :]).sum(2)
    else:
        same = np.zeros((len(a), len(b)), dtype=np.int16)
        for k in range(a.shape[1]):
            same += a[:, k, None] == b[None, :, k]
    return (same / np.float32(a.shape[1]) - np.float32(1 / 256)) / np.float32(1 - 1 / 256)


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pairs of a spanning forest of a chunk, likeliest first, with their estimates."""
    pdf = pdf.sort_values("node")
    nodes, sig = pdf["node"].to_numpy(), _registers(pdf["sig"])
    found = []
    for a in range(0, len(nodes), 256):
        est = _estimates(sig[a : a + 256], sig)
        i, j = np.nonzero(est >= THRESHOLD - MARGIN)
        keep = i + a < j
        i, j = i[keep], j[keep]
        found.append((est[i, j], (i + a).astype(np.int32), j.astype(np.int32)))
    est, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(-est, kind="stable")
    up = list(range(len(nodes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out, left = [], len(nodes) - 1
    for at in range(0, len(order), 4096):
        block = order[at : at + 4096]
        for i, j, e in zip(one[block].tolist(), two[block].tolist(), est[block].tolist(), strict=True):
            x, y = root(i), root(j)
            if x != y:
                up[x] = y
                out.append((nodes[i], nodes[j], e))
                left -= 1
        if not left:
            break
    return pd.DataFrame(out, columns=["a", "b", "est"]).astype({"a": "int64", "b": "int64", "est": "float32"})


def _possible(guests: pd.DataFrame, hosts: pd.DataFrame) -> np.ndarray:
    """Which pairs of a guest and a host are in different groups and, by their estimate, may be a link."""
    if not len(guests) or not len(hosts):
        return np.zeros((len(guests), len(hosts)), dtype=bool)
    one, two = _registers(guests["sig"]), _registers(hosts["sig"])
    hit = guests["component"].to_numpy()[:, None] != hosts["component"].to_numpy()[None, :]
    for k in range(0, len(guests), 256):
        hit[k : k + 256] &= _estimates(one[k : k + 256], two) >= THRESHOLD - MARGIN
    return hit


def _alive(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block of a bucket's guests and a block of its texts that are in a possible link with the other block."""
    guest = pdf["guest"].to_numpy()
    hit = _possible(pdf[guest], pdf[~guest])
    keep = np.zeros(len(pdf), dtype=bool)
    keep[guest], keep[~guest] = hit.any(1), hit.any(0)
    return pdf[keep]


def _across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a task of two blocks, computed exactly; of those found only the ones that join groups not joined yet are returned."""
    guests, hosts = pdf[pdf["guest"]], pdf[~pdf["guest"]]
    x, y = ([weighted(shingle_hashes(words_of(t))) for t in rows["text"]] for rows in (guests, hosts))
    a, b = guests["node"].tolist(), hosts["node"].tolist()
    now = {c: c for c in pdf["component"].tolist()}  # groups joined here, in chains

    def root(c: int) -> int:
        while now[c] != c:
            now[c] = now[now[c]]
            c = now[c]
        return c

    one, two = guests["component"].tolist(), hosts["component"].tolist()
    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(_possible(guests, hosts))), strict=True):
        if root(one[i]) != root(two[j]) and probability_jaccard(x[i], y[j]) >= THRESHOLD - 1e-12:
            now[root(one[i])] = root(two[j])
            out.append((min(a[i], b[j]), max(a[i], b[j])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept, known = [], {}
        for a, b, one, two in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
            for node, text in ((a, one), (b, two)):
                if node not in known:
                    known[node] = weighted(shingle_hashes(words_of(text)))
            if probability_jaccard(known[a], known[b]) >= THRESHOLD - 1e-12:
                kept.append((a, b))
        yield pd.DataFrame(kept, columns=["a", "b"]).astype("int64")


def _both(pairs: DataFrame, of: DataFrame, col: str) -> DataFrame:
    """pairs with a column of either of their nodes."""
    one = pairs.join(of.select(F.col("node").alias("b"), F.col(col).alias(f"{col}_b")).hint("merge"), "b")
    return one.join(of.select(F.col("node").alias("a"), F.col(col).alias(f"{col}_a")).hint("merge"), "a")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, the key of its text, and class_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", text_key(F.col("text")))
    signed = materialise(rows.where("id is not null").mapInPandas(_sign, "id long, h binary, bands array<long>, sig binary"))
    # exact copies: the first document of each text goes on, as a node of its own even if its id has two texts
    firsts = signed.groupBy("h").agg(F.min("id").alias("id"))
    own = signed.where(f"sig <> unhex('{_EMPTY}')").join(firsts.hint("merge"), ["h", "id"]).dropDuplicates(["h", "id"])
    own = materialise(own.withColumn("node", F.monotonically_increasing_id()))
    sigs = own.select("node", "sig")

    band = own.select("node", F.explode("bands").alias("bucket"))
    # of buckets with the very same texts one is enough
    sizes = band.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("n > 1")
    sizes = sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    member = materialise(band.join(sizes.hint("merge"), "bucket"))
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK)).cast("int")
    trees = member.join(sigs.hint("merge"), "node").withColumn("chunk", chunk).groupBy("bucket", "chunk").applyInPandas(lambda pdf: _forest(pdf), "a long, b long, est float")
    trees = materialise(trees.groupBy("a", "b").agg(F.max("est").alias("est")))

    wanted = trees.select(F.explode(F.array("a", "b")).alias("node")).unionByName(member.where(F.col("n") > CHUNK).select("node")).distinct()
    wanted = own.select("node", "id", "h").join(wanted.hint("merge"), "node")
    texts = materialise(rows.join(wanted.hint("merge"), ["id", "h"]).select("node", "text").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        return materialise(_both(pairs, texts, "text").select("a", "b", "text_a", "text_b").mapInPandas(_verify, "a long, b long"))

    def joining(pairs: DataFrame, group: DataFrame) -> DataFrame:
        """The pairs whose nodes are in different groups so far."""
        both = pairs.join(group.toDF("a", "x").hint("merge"), "a", "left").join(group.toDF("b", "y").hint("merge"), "b", "left")
        return both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")

    # each text's best pair first; what joins groups nevertheless comes after it
    ends = trees.select("a", "b", "est", F.explode(F.array("a", "b")).alias("node"))
    best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("est", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct()
    links = verified(best)
    links = links.unionByName(verified(joining(trees.join(best.hint("merge"), ["a", "b"], "left_anti"), components(links))))
    group = components(links)

    # in buckets whose texts are still in more than one group, those outside the largest group are guests and meet all texts, block by block
    placed = member.where("n > 2").join(group.withColumnRenamed("node", "_n").hint("merge"), F.col("node") == F.col("_n"), "left").select("bucket", "n", "node", F.coalesce("component", "node").alias("component"))
    by_group = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    mixed = by_group.groupBy("bucket").agg(F.count("*").alias("groups"), F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("most")).where("groups > 1")
    blocks = lambda n: F.ceil(n / CHUNK).cast("int")
    mixed = mixed.select("bucket", F.col("most.component").alias("main"), blocks(F.col("n")).alias("hosts"), blocks(F.col("n") - F.col("most.m")).alias("guests"))
    rest = materialise(placed.drop("n").join(mixed.hint("merge"), "bucket").join(sigs.hint("merge"), "node"))

    def side(rows: DataFrame, guest: bool) -> DataFrame:
        own_block, other, n, m = ("p", "q", "guests", "hosts") if guest else ("q", "p", "hosts", "guests")
        rows = rows.withColumn(own_block, F.pmod(F.xxhash64("node"), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
        return rows.select("bucket", "p", "q", "node", "component", "sig", F.lit(guest).alias("guest"))

    met = side(rest.where("component <> main"), True).unionByName(side(rest, False))
    alive = met.groupBy("bucket", "p", "q").applyInPandas(lambda pdf: _alive(pdf), met.schema)
    more = alive.join(texts.hint("merge"), "node").groupBy("bucket", "p", "q").applyInPandas(lambda pdf: _across(pdf), "a long, b long")
    group = components(links.unionByName(materialise(more.distinct())))

    of_text = own.select("h", "id", "node").join(group.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_text.groupBy("component").agg(F.min("id").alias("class"))
    of_text = of_text.join(least.hint("merge"), "component").select("h", "class")
    known = signed.select("id", "h").join(of_text.hint("merge"), "h", "left").select("id", "h", F.coalesce("class", "id").alias("class_id"))
    return known.unionByName(rows.where("id is null").select("id", "h", F.lit(None).cast("long").alias("class_id")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (the least id of its group) and kept (id = class_id)."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = _grouped(docs, id_col, text_col)
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("class_id").cast(kind).alias("class_id"), F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are not the first of their group, and one row of those with the same id and text."""
    number = docs.schema[id_col].dataType.simpleString()

    def keyed(df: DataFrame, id_: Column, h: Column) -> DataFrame:
        return df.withColumns({"_least_id": F.coalesce(id_.cast("long"), F.lit(0)), "_no_id": id_.isNull(), "_text_key": h})

    keys = ["_least_id", "_no_id", "_text_key"]
    stay = _grouped(docs, id_col, text_col).where("id is null or id = class_id")
    stay = keyed(stay, F.col("id").cast(number), F.col("h")).select(keys).distinct()
    marked = keyed(docs, F.col(id_col), text_key(F.col(text_col)))
    return marked.join(stay.hint("merge"), keys).dropDuplicates(keys).select(docs.columns)


#: The signature of a text without shingles.
_EMPTY = _mix(np.zeros(REGISTERS, dtype=np.uint64)).astype(np.uint8).tobytes().hex()


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
