"""Uploaded files as rows: type and size are judged by the listing, only files that pass are opened.

A row per file that is not empty (Spark's file scan leaves empty ones out): path, size, error (null, or why it is refused), warnings, n_words, text. Files of other types and files over the limit are
refused unread, since `length` and `path` are known before the content is. Readers are given by suffix; DOCX needs none but the standard library.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The largest file in MB, and the words under which a document is called short.
MAX_MB, LEAST_WORDS = 10, 500
#: The largest text part of an archive that is unpacked, in MB.
MAX_UNPACKED_MB = 200
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = z.getinfo("word/document.xml")
        if part.file_size > MAX_UNPACKED_MB << 20:
            raise ValueError("text part too large")
        root = ElementTree.fromstring(z.read(part))
    shown = {f"{_W}tab": "\t", f"{_W}br": "\n"}
    return "\n\n".join("".join(x.text or "" if x.tag == f"{_W}t" else shown.get(x.tag, "") for x in p.iter()) for p in root.iter(f"{_W}p"))


READERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text}


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def warnings_of(n_words: Column, least_words: int = LEAST_WORDS) -> Column:
    return F.when(n_words < least_words, F.array(F.format_string(f"only %d words (at least {least_words} recommended)", n_words))).otherwise(F.array().cast("array<string>"))


def read_uploads(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None, max_mb: int = MAX_MB, least_words: int = LEAST_WORDS) -> DataFrame:
    """error is `type` for a suffix without a reader, `size` over max_mb, `unreadable` where the reader fails. Texts are read row by row, so a
    Python worker holds the rows of one pickled batch (spark.sql.execution.python.udf.maxRecordsPerBatch), each at most max_mb."""
    known = READERS if readers is None else readers

    def read(suffix: str, content: bytes) -> str | None:
        try:
            return known[suffix](bytes(content))
        except Exception:  # any fault of a file is that file's error, not the job's
            return None

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    listed = files.select("path", F.col("length").alias("size"), suffix.alias("suffix"))
    refused = F.when(~F.col("suffix").isin(*known), "type").when(F.col("size") > max_mb << 20, "size")
    refused = listed.withColumn("error", refused).where("error is not null").select("path", "size", "error", F.lit(None).cast("string").alias("text"))
    taken = files.where(F.col("length") <= max_mb << 20).withColumn("suffix", suffix).where(F.col("suffix").isin(*known))
    taken = taken.select("path", F.col("length").alias("size"), F.udf(read, "string", useArrow=False)("suffix", "content").alias("text"))
    taken = taken.select("path", "size", F.when(F.col("text").isNull(), "unreadable").alias("error"), "text")
    n = word_count(F.col("text")).cast("long")
    return taken.unionByName(refused).select("path", "size", "error", F.when(F.col("error").isNull(), warnings_of(n, least_words)).alias("warnings"), n.alias("n_words"), "text")
