"""PII by bootstrapped contextual extraction.

Base entities (e-mail, IP address, card and phone numbers by pattern and checksum) are the seeds.
Long tokens of letters and digits behind an assignment or a label are seeds too, of secrets; unlike base entities they are no spans by themselves.
The two words before a seed induce a lexical pattern, and so does the last of them alone if it is a word of letters. Over all documents, patterns and the instances that
stand in their slot form a graph for each kind; Spark scores it in rounds: a pattern by the share of
its different instances that are trusted, an instance by its best patterns. Patterns whose score and
number of seeds are high in the end then mark identifiers that no base pattern knows.

Scores are kept in tables and joined; a pattern with very many instances is summed before it is
shuffled, and dealt over tasks where it is joined. Nothing but the number of changed rows reaches the driver.

Defined results: null and empty texts have no spans; a text that is repeated has the same spans in
each row; null ids stay; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, spread_join, table, text_key

KINDS = ("email", "ip", "card", "phone")
SEEDS = (*KINDS, "secret")
#: Kinds of spans that learned patterns add, in the order of SEEDS.
LEARNED = tuple(f"{k}_like" for k in SEEDS)
ROUNDS, MIN_SCORE, MIN_SEEDS = 3, 0.6, 5
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ODD = re.compile(r"[\x20-]")
_SLOT = re.compile(r"[^\x20\x09-\x0D]+")
_STRIP = ".,;:!?\"'()[]{}<>#$%&*|"
#: A token that seeds secrets, and the shortest last word that is a pattern on its own.
_SECRET = re.compile(r"(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_+/=-]{24,}")
LONE = 3
#: Characters that make a word without digits look like a handle or an address.
_JOINERS = "@_"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ sign, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at + 1)  # no match can hold this sign
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _ODD.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str, str | None, int, int]]:
    """(pattern, instance, seed kind or None, start, end): the two words before an identifier-like token or a base entity and, as `* word`, the
    last of them alone. A word that ends in a colon keeps it. Tokens like identifiers have five characters at least, of which one is a digit or
    joins names; behind `=` or a colon, long ones of letters and digits seed secrets."""
    out = []
    taken = [(a, b) for _, a, b in spans]

    tokens = [(m.start(), m.end()) for m in _SLOT.finditer(text)] if spans or any(c.isdigit() or c in _JOINERS for c in text) else []
    starts = [a for a, _ in tokens]

    def before(start: int) -> list[str]:
        if "\n" in text[max(0, start - 2) : start]:
            return []
        words, k = [], bisect_left(starts, start) - 1
        while k >= 0 and len(words) < 2:
            a, b = tokens[k]
            whole = text[a : min(b, start)]
            if w := whole.strip(_STRIP).lower():
                words.append(f"{w}:" if whole.endswith(":") else w)
            k -= 1
        if not words or any(c.isdigit() for c in words[0]):
            return []
        pair = len(words) == 2 and not any(c.isdigit() for c in words[1])
        alone = sum(map(str.isalpha, words[0])) >= LONE
        return ([f"{words[1]} {words[0]}"] if pair else []) + ([f"* {words[0]}"] if alone else [])

    for kind, a, b in spans:
        out += [(p, text[a:b], kind, a, b) for p in before(a)]
    for a, b in tokens:
        token = text[a:b]
        if len(token) < 5 or not any(c.isdigit() or c in _JOINERS for c in token):
            continue
        a, b = a + len(token) - len(token.lstrip(_STRIP)), b - (len(token) - len(token.rstrip(_STRIP)))
        if b - a >= 5 and not any(x < b and a < y for x, y in taken):
            long = _SECRET.fullmatch(text, a, b)
            out += [(p, text[a:b], "secret" if long and p[-1] in "=:" else None, a, b) for p in before(a)]
    return out


_SPAN = "struct<kind:string,start:int,end:int>"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text in batch["text"]:
            text = text or ""
            spans = base_spans(text)
            out.append((spans, [(p, i, k, a, b) for p, i, k, a, b in contexts(text, spans)]))
        yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s, _ in out], "slots": [[{"pattern": p, "instance": i, "kind": k, "start": a, "end": b} for p, i, k, a, b in c] for _, c in out]})


def _deal(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """left joined with right's one row for each key; keys that hold many of left's rows are dealt over tasks."""
    return spread_join(left, right, key, [by], left.groupBy(key).agg(F.count("*").alias("n")), left.count())


def score_patterns(slots: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """slots: (pattern, instance, kind). Rows (kind, pattern, score, seeds): the pattern-instance graph after
    so many rounds. A pattern scores (sum of its instances' scores) / (different instances + 2)."""
    if rounds < 1:
        raise ValueError("rounds must be positive")
    edges = materialise(slots.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    seeded = edges.where("seed is not null").groupBy("pattern").agg(F.collect_set("seed").alias("kinds"))  # five kinds at most
    edges = _deal(edges, seeded, "pattern", "instance").withColumn("kind", F.explode("kinds")).drop("kinds")  # only patterns that some seed of the kind stands in
    same = F.coalesce(F.col("seed") == F.col("kind"), F.lit(False))
    edges = materialise(edges.select("kind", "pattern", "instance", "seed", F.concat_ws(" ", "kind", "pattern").alias("node"), F.concat_ws(" ", "kind", "instance").alias("filler")))
    trust = edges.withColumn("trust", same.cast("double"))
    for i in range(rounds):
        patterns = materialise(trust.groupBy("kind", "pattern", "node").agg((F.sum("trust") / (F.count("*") + 2)).alias("score"), F.count(F.when(same, 1)).alias("seeds")))
        if i + 1 < rounds:
            best = _deal(edges, patterns.select("node", "score"), "node", "instance").groupBy("filler").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.99)) * 0.5)))).alias("found"))
            trust = materialise(_deal(edges, best, "filler", "pattern").withColumn("trust", F.when(same, 1.0).when(F.col("seed").isNotNull(), 0.0).otherwise(F.col("found"))).drop("found"))
    return patterns.drop("node")


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and slots of every row, under the key of its text; written, as several plans read it."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", text_key(F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return materialise(rows.mapInPandas(_extract, f"id {kind}, h binary, spans array<{_SPAN}>, slots array<struct<pattern:string,instance:string,kind:string,start:int,end:int>>"))


def _learned(found: DataFrame, min_score: float, min_seeds: int) -> DataFrame:
    """(h, more): the spans that learned patterns add to a text."""
    slots = found.select("h", F.explode("slots").alias("s")).select("h", "s.*")
    order = F.struct(F.array_position(F.lit(list(SEEDS)), F.coalesce("kind", F.lit(""))), "instance")
    slots = materialise(slots.groupBy("h", "start", "end", "pattern").agg(F.min_by(F.struct("instance", "kind"), order).alias("s")).select("h", "start", "end", "pattern", "s.*"))  # repeated texts once
    patterns = score_patterns(slots.select("pattern", "instance", "kind")).where((F.col("score") >= min_score) & (F.col("seeds") >= min_seeds))
    chosen = patterns.groupBy("pattern").agg(F.collect_list(F.struct("score", "kind")).alias("found"))  # five kinds at most
    new = _deal(slots.where("kind is null or kind = 'secret'"), chosen, "pattern", "h").withColumn("f", F.explode("found")).where("kind is null or kind = f.kind")
    new = new.groupBy("h", "start", "end").agg(F.max("f").getField("kind").alias("kind"))
    return new.groupBy("h").agg(F.collect_list(F.struct(F.concat("kind", F.lit("_like")).alias("kind"), "start", "end")).alias("more"))


def _copies(found: DataFrame) -> DataFrame:
    return found.groupBy("h").agg(F.count("*").alias("n"))


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base (array of spans) and spans (all of them)."""
    found = _found(docs, id_col, text_col)
    out = spread_join(found.drop("slots"), _learned(found, min_score, min_seeds), "h", ["id"], _copies(found), found.count(), "left")
    every = F.concat("spans", F.coalesce("more", F.array().cast(f"array<{_SPAN}>")))
    order = F.lit(list(KINDS + LEARNED))
    every = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias(id_col), *counts, F.col("spans").alias("base"), every.alias("spans"), F.col("h").alias("text_hash"))


def _written(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str | None, spans) -> str | None:
    """The text with its spans replaced by their kind; spans that overlap are replaced as one."""
    if not text or spans is None or not len(spans):
        return text
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= end:
            out += [text[end : s["start"]], f"[{s['kind'].removesuffix('_like').upper()}]"]
        end = max(end, s["end"])
    return "".join(out) + text[end:]


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every personal span in text_col replaced; n_chars, where there is one, is made anew."""
    columns, schema = docs.columns, docs.schema
    found = _found(docs.select(F.lit(0).alias("doc_id"), text_col), "doc_id", text_col)
    once = found.where(F.size("spans") + F.size("slots") > 0).select("h", "spans").dropDuplicates(["h"])
    spans = once.join(_learned(found, MIN_SCORE, MIN_SEEDS), "h", "left").select("h", F.concat("spans", F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))).alias("_spans")).where(F.size("_spans") > 0)
    keyed = docs.withColumn("_h", text_key(F.col(text_col)))
    others = [f.name for f in schema if f.name != text_col and isinstance(f.dataType, T.AtomicType)] or [text_col]
    joined = spread_join(keyed, spans.withColumnRenamed("h", "_h"), "_h", others, _copies(found).withColumnRenamed("h", "_h"), found.count(), "left").drop("_h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[columns].copy()
            out[text_col] = [redact(t, s) for t, s in zip(batch[text_col], batch["_spans"], strict=True)]
            yield out

    out = joined.mapInPandas(run, schema)
    return out.withColumn("n_chars", F.length(text_col).cast(schema["n_chars"].dataType)) if "n_chars" in columns else out


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))
