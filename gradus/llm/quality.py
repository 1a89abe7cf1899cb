"""Quality rules: line sequence labelling with a linear-chain conditional random field.

Every line of a text gets features; Viterbi decoding marks it content or boilerplate, and the share
of a text's words that stand in content lines decides whether it stays. The field is trained on at
most MAX_FIT labelled rows chosen by a hash, on all of their lines (long texts in pieces of PIECE lines): the lines
of a text share its quality label. Base counts and base rules are those of the contract.

Defined results: null texts have no words and fail the base rule, as all texts under 50 words do;
lines without a word belong to no count of lines; without labels of both kinds fixed weights serve;
repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, words_of

#: Bound on labelled rows; lines of a piece that a long text is cut into for training, so that padding stays bounded.
MAX_FIT, PIECE = 3000, 48
#: Least share of words in content lines.
MIN_SHARE = 0.5
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
FEATURES = ("bias", "symbols", "many_symbols", "upper", "shouts", "repeats", "one_word", "seen", "bars", "short", "no_lower", "marks")
#: Weights of content against boilerplate where no labels are there.
DEFAULT = (np.array([3.0, -4.0, -3.0, -3.0, -3.0, -4.0, -2.0, -1.0, -3.0, -0.3, -1.0, -2.0]), np.array([[0.5, 0.0], [0.0, 0.5]]))
_UPPER, _MARKS = re.compile(r"[^\W\d_a-zà-ÿ]"), re.compile(r"[!?*#$%&|<>=]{2,}")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the contract counts them."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n >= 3:
        codes, kinds = pd.factorize(np.array(words, dtype=object))
        wide = len(kinds)
        if wide < 2_000_000:
            key = (codes[:-2].astype(np.int64) * wide + codes[1:-1]) * wide + codes[2:]
        else:
            key = pd.factorize(codes[:-2].astype(np.int64) * wide + codes[1:-1])[0].astype(np.int64) * wide + codes[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(n, dtype=bool)
        for k in range(3):
            cover[k : n - 2 + k] |= twice
        repeated = int(cover.sum())
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines that hold a word, and their numbers of words."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = words_of(line)
        if not words:
            continue
        n, chars = len(words), max(1, len(line))
        symbols = sum(map(line.count, SYMBOLS)) / n
        upper = len(_UPPER.findall(line)) / chars
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
        kinds = len(set(words)) / n
        rows.append((1.0, min(1.0, symbols), float(symbols > 0.3), min(1.0, 2 * upper), min(1.0, line.count("!!") / n), min(1.0, repeats), float(n >= 8 and kinds < 0.34), float(line in seen), min(1.0, words.count("|") / n * 2), float(n < 4), float(n > 3 and not re.search("[a-zà-ÿ]", line)), min(1.0, len(_MARKS.findall(line)) / n)))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES)), np.array(sizes, dtype=np.int64)


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best path of states (1 content, 0 boilerplate) for one sequence of emission scores (n, 2)."""
    n = len(emit)
    back = np.zeros((n, 2), dtype=np.int8)
    a0, a1 = float(emit[0, 0]), float(emit[0, 1])
    (m00, m01), (m10, m11) = move.tolist()
    for i, (e0, e1) in enumerate(emit.tolist()):
        if i:
            to0, to1 = a1 + m10 > a0 + m00, a1 + m11 >= a0 + m01
            back[i] = (to0, to1)
            a0, a1 = (a1 + m10 if to0 else a0 + m00) + e0, (a1 + m11 if to1 else a0 + m01) + e1
    path = np.zeros(n, dtype=np.int8)
    path[-1] = a1 >= a0
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def content_share(text: str | None, model=DEFAULT) -> float:
    """Share of words in lines marked content; 0 for a text without words."""
    x, sizes = line_features(text)
    if not len(x):
        return 0.0
    score = x @ model[0]
    return float((viterbi(np.stack([-score / 2, score / 2], axis=1), model[1]) * sizes).sum() / sizes.sum())


def train(sequences: list[np.ndarray], labels: list[int], shares: list[float], rounds: int = 150, rate: float = 0.2, ridge: float = 0.002):
    """Maximum-likelihood training of emission and transition weights by forward-backward on padded sequences; shares: what part of its text a sequence is."""
    longest = max(map(len, sequences))
    x = np.zeros((len(sequences), longest, len(FEATURES)))
    mask = np.zeros((len(sequences), longest), dtype=bool)
    for i, s in enumerate(sequences):
        x[i, : len(s)], mask[i, : len(s)] = s, True
    y = np.array(labels)[:, None] * np.ones(longest, dtype=int)
    kind, part = np.array(labels), np.array(shares)
    of_kind = np.where(kind == 1, part[kind == 1].sum(), part[kind == 0].sum())  # texts of the same label
    weight = (0.5 * part / np.maximum(1.0, of_kind))[:, None] / mask.sum(1, keepdims=True)
    w, move = DEFAULT[0].copy(), DEFAULT[1].copy()
    first, second = [np.zeros_like(w), np.zeros_like(move)], [np.zeros_like(w), np.zeros_like(move)]
    for step in range(1, rounds + 1):
        s = x @ w
        emit = np.stack([-s / 2, s / 2], axis=2)
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[:, 0] = emit[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(fwd[:, t - 1, 0, None] + move[0], fwd[:, t - 1, 1, None] + move[1]) + emit[:, t]
            fwd[:, t] = np.where(mask[:, t, None], nxt, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = bwd[:, t + 1] + emit[:, t + 1]
            nxt = np.logaddexp(nxt[:, 0, None] + move[:, 0], nxt[:, 1, None] + move[:, 1])
            bwd[:, t] = np.where(mask[:, t + 1, None], nxt, 0.0)
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p1 = np.exp(fwd[..., 1] + bwd[..., 1] - total[:, None]) * mask
        gw = ((y - p1) * weight * mask)[..., None] * x
        gm = np.zeros_like(move)
        pairs = mask[:, 1:]
        for a in range(2):
            for b in range(2):
                p = np.exp(np.minimum(0, fwd[:, :-1, a] + move[a, b] + emit[:, 1:, b] + bwd[:, 1:, b] - total[:, None])) * pairs
                gm[a, b] = ((((y[:, :-1] == a) & (y[:, 1:] == b) & pairs) - p) * weight).sum()
        for k, (g, v) in enumerate(((gw.sum((0, 1)) - ridge * (w - DEFAULT[0]), w), (gm - ridge * (move - DEFAULT[1]), move))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            v += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return w, move


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit: int = MAX_FIT):
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_fit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [line_features(t)[0].ravel().tolist() for t in batch["text"]]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id").mapInPandas(run, "y int, x array<double>").collect()
    rows = [(np.array(r["x"]).reshape(-1, len(FEATURES)), r["y"]) for r in rows if r["x"]]
    if len({y for _, y in rows}) < 2:
        return DEFAULT
    pieces = [(x[a : a + PIECE], y, min(PIECE, len(x) - a) / len(x)) for x, y in rows for a in range(0, len(x), PIECE)]
    return train(*(list(v) for v in zip(*pieces, strict=True)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, max_fit: int = MAX_FIT) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, content_share and kept."""
    model = fit(docs, labels, id_col, text_col, max_fit=max_fit)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([base_counts(t) for t in batch["text"]], columns=counts)
            yield out.assign(id=batch["id"].to_numpy(), content_share=[content_share(t, model) for t in batch["text"]])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, ", ".join(f"{c} long" for c in counts) + f", id {rows.schema['id'].dataType.simpleString()}, content_share double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), *counts, failed.alias("base_failed"), (~failed & (F.col("content_share") >= min_share)).alias("kept"), "content_share")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
