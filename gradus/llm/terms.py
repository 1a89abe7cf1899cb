"""Words of letters and digits, with A-Z lower-cased: as columns, and as UTF-8 bytes inside Python tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what stands between words, where case is not folded yet.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for bytes: A-Z to a-z, other ASCII but a-z and 0-9 to a blank; bytes of longer code points stay.
_FOLD = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: str | None) -> list[bytes]:
    """Words of a text in order; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def term_array(text: Column) -> Column:
    """Words of a text in order; null has none."""
    blank = F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, " "))
    return F.array_remove(F.split(blank, " "), "")  # an empty text splits into one empty word


def ngrams(words: Column, least: int, most: int) -> Column:
    """All runs of `least` to `most` consecutive words, each joined by one blank, repeats kept."""
    every, runs = [], words
    for n in range(1, most + 1):
        if n > 1:  # each run is the one that is a word shorter, and the next word
            left = F.greatest(F.size(words) - n + 1, F.lit(0))
            runs = F.zip_with(F.slice(runs, F.lit(1), left), F.slice(words, F.lit(n), left), lambda a, b: F.concat_ws(" ", a, b))
        every += [runs] if n >= least else []
    return every[0] if len(every) == 1 else F.concat(*every)
