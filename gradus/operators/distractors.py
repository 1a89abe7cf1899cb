"""Wrong options for answers from the graph of a document: names alike within a few relations, counted for many documents at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import PAIR_LETTERS, pair_codes
from .rows import listed, placed

#: Documents whose graphs are searched at a time, and the concepts that a word's bits stand for.
DOCS, BITS = 512, 64
#: The least similarity by distance, and the options that an answer gets.
LEAST, OPTIONS = {1: 0.12, 2: 0.12, 3: 0.18}, 3
PICKS = pa.list_(pa.struct([("dist", pa.int32()), ("node", pa.int64())]))
_PAIRS = len(PAIR_LETTERS) ** 2


def _tables(doc: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """Of each document the counts of pairs, one row a concept and one column a pair that it has. doc: of each concept, in order; n: concepts of a document."""
    at, pair = pairs
    has = np.zeros(len(n) * _PAIRS + 1, dtype=np.int64)
    has[doc[at] * _PAIRS + pair + 1] = 1
    before = np.cumsum(has)
    first = before[:: _PAIRS][: len(n) + 1]
    width = np.diff(first)
    base = np.concatenate(([0], np.cumsum(n * width)))
    row = at - np.concatenate(([0], np.cumsum(n)))[doc[at]]
    cell = base[doc[at]] + row * width[doc[at]] + before[doc[at] * _PAIRS + pair] - first[doc[at]]
    counts = np.bincount(cell, minlength=base[-1]).astype(float)
    return [counts[i:j].reshape(k, w) for i, j, k, w in zip(base[:-1], base[1:], n, width, strict=True)]


def _pick(edges: pa.Array, concepts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents of the answers, answers, number of their options, distances and nodes of the options) of documents' edges and concepts."""
    doc, node, n, named, a, b, c = placed(edges, concepts)
    total = len(node)
    start = np.concatenate(([0], np.cumsum(n)))
    # relations in both directions, in order of where they lead from
    a, b = np.concatenate((a, b))[np.tile(a != b, 2)], np.concatenate((b, a))[np.tile(a != b, 2)]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    at, pair = pair_codes(c.field("name"))
    table = _tables(doc, (named[at], pair), n)
    norm = np.sqrt(np.concatenate([(t * t).sum(axis=1) for t in table])) if total else np.zeros(0)
    rank, found, have = np.arange(total) - start[doc], [], {d: np.zeros(total, dtype=np.int64) for d in LEAST}
    # the concepts of a document, a word of bits at a time: what leads to them in one, two and three relations
    for low in range(0, int(n.max(initial=0)), BITS):
        of = n[doc[a]] > low
        x, y = a[of], b[of]
        if not len(x):
            break
        heads = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        inside = (rank >= low) & (rank < low + BITS)
        seen = np.where(inside, np.left_shift(np.uint64(1), np.where(inside, rank - low, 0).astype(np.uint64)), np.uint64(0))
        wide = min(BITS, -(-(int(n.max()) - low) // 8) * 8)
        like = np.zeros((total, wide))
        for i in np.flatnonzero(n > low):
            t, here = table[i], slice(start[i], start[i + 1])
            top, scale = t[low : low + BITS], norm[here][:, None] * norm[here][low : low + BITS]
            like[here, : len(top)] = (t @ top.T) / np.where(scale > 0, scale, 1.0)
        front = seen
        for d, least in LEAST.items():
            nxt = np.zeros(total, dtype=np.uint64)
            nxt[x[heads]] = np.bitwise_or.reduceat(front[y], heads)
            front = nxt & ~seen
            seen = seen | front
            bits = np.unpackbits(front.astype("<u8").view(np.uint8).reshape(total, 8)[:, : wide // 8], axis=1, bitorder="little").astype(bool)
            bits &= like >= least
            # an answer takes no more of a distance than it has options
            bits &= np.cumsum(bits, axis=1) + have[d][:, None] <= OPTIONS
            have[d] += bits.sum(axis=1)
            p, q = np.nonzero(bits)
            found.append(np.stack((p, np.full(len(p), d), start[doc[p]] + low + q)))
    p, d, q = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    order = np.lexsort((q, d, p))
    p, d, q = p[order], d[order], q[order]
    # the first of each distance, then the nearest
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])))[: len(p)]
    order = np.lexsort((q, d, ~new, p))
    p, d, q = p[order], d[order], q[order]
    taken = np.arange(len(p)) - np.searchsorted(p, p) < OPTIONS
    answers = np.unique(a)
    return doc[answers], node[answers], np.bincount(p[taken], minlength=total)[answers], d[taken], node[q[taken]]


def picks(edges: Column, concepts: Column) -> Column:
    """J-04 within a document's row: of its edges, an array of (src, dst), and its concepts, an array of (node, name),
    an array of (answer, picks) with the options of each concept that has relations, which may be none. Options are alike by H-10; one of each distance
    up to three comes first, then the nearest. Bits stand for a document's concepts and numpy follows the relations of many documents at a time."""

    def run(e: pa.Array, c: pa.Array) -> pa.Array:
        found = [listed(np.zeros(0, dtype=np.int64), answer=pa.array([], pa.int64()), picks=pa.array([], PICKS))]
        for i in range(0, len(e), DOCS):
            doc, answer, n, dist, node = _pick(e.slice(i, DOCS), c.slice(i, DOCS))
            options = listed(n, dist=pa.array(dist, pa.int32()), node=pa.array(node, pa.int64()))
            found.append(listed(np.bincount(doc, minlength=min(DOCS, len(e) - i)), answer=pa.array(answer, pa.int64()), picks=options))
        return pa.concat_arrays(found)

    return F.arrow_udf(run, "array<struct<answer:bigint,picks:array<struct<dist:int,node:bigint>>>>")(edges, concepts)
