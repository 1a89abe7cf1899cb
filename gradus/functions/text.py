"""Text functions as columns: canonical names, keys and similarities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that canonical names leave out.
NOISE = "the a an of and in on process concept principle phenomenon theory law effect method system type form kind class category".split()


def squeeze(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def canonical_lite(name: Column) -> Column:
    """H-02."""
    return squeeze(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""))


def canonical(name: Column) -> Column:
    """H-01."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""), rf"\b({'|'.join(NOISE)})\b", ""))


def relation_token(rel: Column) -> Column:
    """H-04, H-07."""
    return F.upper(F.regexp_replace(F.btrim(rel), r"\s+", "_"))


def stored_type(rel: Column) -> Column:
    """B-10: a relation in capitals, runs of white space as underscores."""
    return F.regexp_replace(F.upper(F.coalesce(rel, F.lit(""))), r"\s+", "_")


def triple_key(s: Column, p: Column, o: Column, chunk: Column) -> Column:
    """H-08."""
    return F.sha2(F.concat_ws("||", F.lower(s), F.upper(p), F.lower(o), F.sha2(F.btrim(chunk), 256)), 256)


def cosine(a: str, b: str) -> Column:
    """H-12: of two arrays of doubles; 0 for a zero vector."""
    dot = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, v) -> s + v)")
    norm = F.sqrt(F.expr(f"aggregate(transform({a}, x -> x * x), 0D, (s, v) -> s + v)")) * F.sqrt(F.expr(f"aggregate(transform({b}, x -> x * x), 0D, (s, v) -> s + v)"))
    return F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))


PAIR_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letters(text: Column) -> Column:
    """A text's lower-case letters, digits and blanks."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")


def character_pairs(text: Column) -> Column:
    """H-10: the pairs of neighbouring characters of a text's lower-case letters, digits and blanks."""
    return F.regexp_extract_all(letters(text), F.lit("(?=(..))"), F.lit(1))


def pair_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of two arrays of character pairs; 0 where either has none."""
    count = lambda x, y: F.aggregate(x, F.lit(0), lambda s, g: s + F.size(F.filter(y, lambda h: h == g))).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), count(a, b) / F.sqrt(count(a, a) * count(b, b))).otherwise(F.lit(0.0))


#: Rows whose pairs are counted at a time, one table of them for each text.
PAIR_ROWS = 256


def pair_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The character pairs of texts: the place of the text, and the pair as a number."""
    n, low = len(PAIR_LETTERS), pc.utf8_lower(texts.cast(pa.large_string()))
    code = np.full(256, n, dtype=np.int16)
    code[np.frombuffer(PAIR_LETTERS.encode(), np.uint8)] = np.arange(n)
    size = pc.binary_length(low).fill_null(0).to_numpy(zero_copy_only=False)
    c = code[np.frombuffer("".join(filter(None, low.to_pylist())).encode(), np.uint8)]
    kept = c < n  # of other letters all bytes go
    at, c = np.repeat(np.arange(len(low), dtype=np.int32), size)[kept], c[kept]
    inside = at[:-1] == at[1:]
    return at[:-1][inside], (c[:-1] * n + c[1:])[inside]


def _cosines(texts: dict[str, pa.Array], of: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Each pair of one text takes the count that it has in the other, so that only the pairs that stand in a text are read, not all there may be."""
    rows, found = len(next(iter(texts.values()))), {k: pair_codes(t) for k, t in texts.items()}
    column = np.zeros(len(PAIR_LETTERS) ** 2, dtype=np.int64)
    for _, pair in found.values():
        column[pair] = 1
    width, column = max(int(column.sum()), 1), np.cumsum(column) - 1
    cell = {k: at * width + column[pair] for k, (at, pair) in found.items()}
    count = {k: np.bincount(c, minlength=rows * width) for k, c in cell.items()}
    dot = lambda a, b: np.bincount(found[a][0], count[b][cell[a]], minlength=rows)
    square = {k: dot(k, k) for k in texts}
    norm = {(a, b): np.sqrt(square[a] * square[b]) for a, b in of}
    return {f"{a}_{b}": dot(a, b) / np.where(norm[a, b] > 0, norm[a, b], 1.0) for a, b in of}


def pair_cosines(texts: dict[str, Column], of: list[tuple[str, str]]) -> Column:
    """H-10 of the named texts of a row, long ones too, as a struct of a_b; 0 where either has no pairs. numpy counts the pairs of many rows at a time."""
    names = list(texts)

    def run(*cols: pa.Array) -> pa.Array:
        parts = [_cosines({k: c.slice(i, PAIR_ROWS) for k, c in zip(names, cols, strict=True)}, of) for i in range(0, len(cols[0]), PAIR_ROWS)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *[p[f"{a}_{b}"] for p in parts]])) for a, b in of], names=[f"{a}_{b}" for a, b in of])

    return F.arrow_udf(run, ", ".join(f"{a}_{b} double" for a, b in of))(*texts.values())


def word_runs(words: Column, n: int) -> Column:
    """The runs of n consecutive words, joined by blanks. Each run is put together from the one that is a word shorter and the next word, so the
    array of words is read n times, not once for every run."""
    runs = words
    for k in range(2, n + 1):
        left = F.greatest(F.size(words) - k + 1, F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), left), F.slice(words, F.lit(k), left), lambda a, b: F.concat_ws(" ", a, b))
    return runs
