"""License scans: exact set-similarity join of text blocks with license templates.

The words of a text are cut into overlapping blocks of BLOCK words, one every STEP words. A block
meets a template if it holds at least ``ceil(threshold * distinct template tokens)`` of its tokens.
Template tokens are ordered by their frequency in the whole corpus, rarest first. Only blocks that
hold a token of a template's prefix become candidates (prefix filter); candidates that hold too few
template tokens (length filter) or whose common token stands too late in either order (positional
filter) are dropped before the overlap is counted. The filters drop no qualifying pair.

Everything on the rows is DataFrame functions; the driver sees the counts of the template tokens only.

Defined results: null texts count as empty; empty texts have 0 words, no labels and score 0; a row
that is repeated is reported as often as it occurs; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's phrases.
BASE_PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Notices as licenses word them.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial international license"),
    ("cc-by-sa", "creative commons attribution sharealike international license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("proprietary", "all rights reserved no part may be reproduced without prior written permission"),
]
BLOCK, STEP = 32, 16
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _spaced(text: Column) -> Column:
    """Each word with a blank on both sides; letters keep their case."""
    inner = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), NON_WORD, "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _count(spaced: Column) -> Column:
    return ((F.char_length(spaced) - F.char_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _tokens(spaced: Column) -> Column:
    """Lower-case words in order; case is folded for A-Z only."""
    low = F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(low), "  "))


def token_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Occurrences of the vocabulary's tokens in all texts; as many numbers as the templates have tokens."""
    word = F.explode(_tokens(_spaced(F.col(text_col)))).alias("token")
    rows = docs.select(word).where(F.col("token").isin(vocabulary)).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels (arrays)
    and score: 1 for a base phrase, else the largest containment of a template in a block that
    reaches the threshold, else 0."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, text in templates for t in text.split()})
    seen = token_counts(docs, vocabulary, text_col)
    order = sorted(vocabulary, key=lambda t: (seen.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    index = []
    for label, text in templates:
        tokens = sorted(set(text.split()), key=rank.__getitem__)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        index += [(t, label, i, need, tokens) for i, t in enumerate(tokens[: len(tokens) - need + 1])]
    prefix = sorted({row[0] for row in index})
    rules = F.broadcast(spark.createDataFrame(index, "token string, label string, at int, need int, template array<string>"))  # a few rows per template

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _spaced(F.col(text_col)).alias("spaced"))
    rows = rows.select("row", "id", _count(F.col("spaced")).alias("n_words"), _tokens(F.col("spaced")).alias("words"), *[F.split("spaced", "(?i) " + "  ".join(p.split()) + " ").alias(f"p{i}") for i, (_, p) in enumerate(BASE_PHRASES)])
    found = [(F.size(f"p{i}") - 1, F.when(F.size(f"p{i}") > 1, _count(F.col(f"p{i}")[0])), F.when(F.size(f"p{i}") > 1, F.col("n_words") - _count(F.element_at(f"p{i}", -1)) - len(p.split()))) for i, (_, p) in enumerate(BASE_PHRASES)]
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(prefix), i)), lambda i: i.isNotNull())
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for (label, _), (n, _, _) in zip(BASE_PHRASES, found)]))))
    rows = rows.select("row", "id", "n_words", sum((n for n, _, _ in found), F.lit(0)).cast("long").alias("n_base"), F.least(*[a for _, a, _ in found]).alias("first_word"), F.greatest(*[b for _, _, b in found]).alias("last_word"), base.alias("base_labels"), "words", hits.alias("hits"))

    # Candidate blocks: those that hold a prefix token. A text without any keeps one row with nulls.
    blocks = F.filter(F.array_distinct(F.flatten(F.transform("hits", lambda i: F.array(F.floor(i / STEP).cast("int"), F.floor(i / STEP).cast("int") - 1)))), lambda k: k >= 0)
    own = ["row", "id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    cut = rows.select(*own, "words", F.explode_outer(blocks).alias("k"))
    cut = cut.select(*own, F.when(F.col("k").isNotNull(), F.array_intersect(F.lit(order), F.slice("words", F.col("k") * STEP + 1, BLOCK))).alias("block"))
    pairs = cut.select(*own, "block", F.posexplode_outer(F.filter("block", lambda t: t.isin(prefix))).alias("_", "token")).join(rules, "token", "left")
    at, size = F.array_position("block", F.col("token")).cast("int") - 1, F.size("block")
    fits = (size >= F.col("need")) & (at <= size - F.col("need")) & (F.least("at", at) + 1 + F.least(F.size("template") - 1 - F.col("at"), size - 1 - at) >= F.col("need"))
    overlap = F.when(fits, F.size(F.array_intersect("block", "template")))
    met = F.when(overlap >= F.col("need"), overlap / F.size("template"))
    scored = pairs.select(*own, "label", met.alias("met"))
    out = scored.groupBy("row").agg(*[F.first(c).alias(c) for c in own[1:]], F.collect_set(F.when(F.col("met").isNotNull(), F.col("label"))).alias("more"), F.max("met").alias("met"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", "more")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("met", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op1_sql() -> str:
    """Brute force: every block of every text against every template."""
    values = ", ".join(f"('{label}', list_distinct(string_split('{text}', ' ')))" for label, text in TEMPLATES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    places = " union all ".join(f"select doc_id, '{label}' as label, i from w, unnest(range(n_words)) as u(i) where {' and '.join(f'''words[i + {j + 1}] = '{t}' ''' for j, t in enumerate(p.split()))}" for label, p in BASE_PHRASES)
    return rf"""
with w as (select doc_id, words, len(words) as n_words from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents)),
place as ({places}),
base as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_sort(list_distinct(list(label))) as base_labels from place group by doc_id),
template as (select * from (values {values}) as t(label, tokens)),
block as (select doc_id, list_distinct(words[i * {STEP} + 1 : i * {STEP} + {BLOCK}]) as tokens from w, unnest(range((n_words + {STEP} - 1) // {STEP})) as u(i)),
met as (select doc_id, label, len(list_intersect(b.tokens, t.tokens))::double / len(t.tokens) as share from block b, template t where len(list_intersect(b.tokens, t.tokens)) >= ceil(0.8 * len(t.tokens) - 1e-9)),
best as (select doc_id, list(label) as labels, max(share) as share from met group by doc_id)
select w.doc_id, w.n_words::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(base_labels, ','), '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ',') as labels,
  case when coalesce(n_base, 0) > 0 then 1.0::double else coalesce(share, 0)::double end as score
from w left join base using (doc_id) left join best using (doc_id)"""
