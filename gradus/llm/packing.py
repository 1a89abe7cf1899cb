"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Every partition of the input packs its own
documents in blocks of BLOCK pieces, longest first. A piece goes to the open bin that it fills best; if
none can hold it, a bin is opened: of the least cost for each word that it and the pieces still to come can fill it with,
or of a given least length. Which rule serves is optimised jointly: each block is packed under all of them, the bins are downsized to
the least length that holds their contents, and the packing of least total cost is taken. Of a block's bins, the FEWEST least full
that are under CLOSE full stay open for the next block; others are closed, which costs fill but loses no piece. In the end every bin is downsized.

There is no shuffle and no driver work; memory is bounded by the block and the open bins of a task.
Texts longer than the greatest length are cut into pieces of that length, so no word is lost.

Defined results: null and empty texts have no words and are not packed (pack_documents returns no row
for them); repeated rows are packed as often as they occur; null ids stay; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table, words_of

#: Permitted lengths in words and what a sequence of each costs: its words plus a share that grows with their square.
LENGTHS = (512, 1024, 2048, 4096)
BLOCK = 4096
#: Bins that a task carries from block to block at most, and the fill from which a bin is closed.
FEWEST, CLOSE = 256, 0.9


def cost(length: int) -> float:
    return 16 + length * (1 + length / 65536)


def downsized(used: int, lengths=LENGTHS) -> int:
    return lengths[bisect_left(lengths, used)]


class Bin:
    __slots__ = ("capacity", "items", "used")

    def __init__(self, capacity: int):
        self.capacity, self.used, self.items = capacity, 0, []


def cheapest(n: int, left: int, lengths=LENGTHS) -> int:
    """The length to open for a piece of n words: least cost a word of what fills it, `left` words being still to come."""
    return min((c for c in lengths if c >= n), key=lambda c: (cost(c) / min(c, n + left), c))


def best_fit(pieces: list[tuple[int, object]], open_bins: list[Bin], least: int | None, lengths=LENGTHS) -> list[Bin]:
    """Best-fit decreasing of (length, item) into copies of the open bins and new ones of `least` words or more, or of the cheapest length."""
    left = sum(n for n, _ in pieces)
    bins = []
    for b in open_bins:
        bins.append(c := Bin(b.capacity))
        c.used, c.items = b.used, list(b.items)
    free = sorted((b.capacity - b.used, i) for i, b in enumerate(bins))
    for n, item in sorted(pieces, key=lambda p: -p[0]):
        left -= n
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, i = free.pop(at)
        else:
            i = len(bins)
            bins.append(Bin(cheapest(n, left, lengths) if least is None else max(least, downsized(n, lengths))))
            room = bins[i].capacity
        bins[i].used += n
        bins[i].items.append((n, item))
        if room > n:
            insort(free, (room - n, i))
    return bins


def pack_block(pieces, open_bins, lengths=LENGTHS) -> list[Bin]:
    """The cheapest of the packings under each opening rule, judged after downsizing."""
    return min((best_fit(pieces, open_bins, least, lengths) for least in (None, *lengths)), key=lambda bins: sum(cost(downsized(b.used, lengths)) for b in bins))


def _pack(lengths, block: int, with_text: bool):
    longest = lengths[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        open_bins: list[Bin] = []

        def close(bins: list[Bin]) -> pd.DataFrame:
            nonlocal made
            rows = []
            for b in bins:
                at, sequence = 0, (task << 33) + made
                made += 1
                for n, (i, piece, first, text) in b.items:
                    rows.append((sequence, downsized(b.used, lengths), b.used, i, piece, first, n, at, text))
                    at += n
            return pd.DataFrame(rows, columns=["sequence_id", "capacity", "used", "id", "piece", "first_word", "n_words", "at", "text"])

        def pieces_of(batch: pd.DataFrame) -> Iterator[tuple[int, tuple]]:
            for i, text in zip(batch["id"], batch["text"], strict=True):
                words = words_of(text)
                for k in range(0, len(words), longest):
                    part = words[k : k + longest]
                    yield len(part), (i, k // longest, k, " ".join(part) if with_text else None)

        held: list[tuple[int, tuple]] = []
        for batch in batches:
            for piece in pieces_of(batch):
                held.append(piece)
                if len(held) >= block:
                    bins, held = pack_block(held, open_bins, lengths), []
                    open_bins = sorted((b for b in bins if b.used < CLOSE * b.capacity), key=lambda b: b.used)[:FEWEST]
                    stay = set(map(id, open_bins))
                    yield close([b for b in bins if id(b) not in stay])
        yield close(pack_block(held, open_bins, lengths))

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths=LENGTHS, block: int = BLOCK, with_text: bool = True) -> DataFrame:
    """One row per piece of a document: sequence_id, capacity, used (words in the sequence), id, piece,
    first_word (in the document), n_words, at (in the sequence) and the piece's text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(_pack(tuple(sorted(lengths)), block, with_text), f"sequence_id long, capacity int, used int, id {kind}, piece int, first_word int, n_words int, at int, text string")
    return out.withColumnRenamed("id", id_col) if with_text else out.withColumnRenamed("id", id_col).drop("text")


def sequences(docs: DataFrame, lengths=LENGTHS) -> DataFrame:
    """One row per sequence: sequence_id, capacity, used, doc_ids, first_words, lengths (arrays in order) and text."""
    pieces = pack_documents(docs, lengths=lengths)
    columns = "sequence_id long, capacity int, used int, doc_ids array<long>, first_words array<int>, lengths array<int>, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of a sequence follow each other within a task
        held: list[tuple] = []

        def row() -> tuple:
            return (*held[0][:3], [r[3] for r in held], [r[4] for r in held], [r[5] for r in held], " ".join(r[6] for r in held))

        names = ["sequence_id", "capacity", "used", "doc_ids", "first_words", "lengths", "text"]
        for batch in batches:
            rows = []
            for r in zip(batch["sequence_id"], batch["capacity"], batch["used"], batch["doc_id"], batch["first_word"], batch["n_words"], batch["text"], strict=True):
                if held and held[0][0] != r[0]:
                    rows.append(row())
                    held = []
                held.append(r)
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame([row()] if held else [], columns=names)

    return pieces.mapInPandas(run, columns)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
