"""Queries over documents, chunks, verdicts and caches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions import formulas as M
from ..functions import text as T
from ..functions.formulas import half_up
from ..sources import views
from .views_sql import r6, sql

QUERIES, SQL = {}, {}


def query(name: str, statement: str | None = None):
    def add(f):
        QUERIES[name] = f
        if statement:
            SQL[name] = statement
        return f

    return add


@query("fixed_chunks", sql("select doc_id, chunk_index, text, length(text)::int as char_count from chunks_fixed", "chunks_fixed"))
def fixed_chunks(spark, sf_dir) -> DataFrame:
    """K-05."""
    return views.chunks_fixed(spark, sf_dir).withColumn("char_count", F.length("text"))


@query("chunk_neighbours", sql("select doc_id, chunk_index, lead(chunk_index) over w as next_chunk, (count(*) over (partition by doc_id order by chunk_index range between 2 preceding and 2 following) - 1)::bigint as within_two from chunks_fixed window w as (partition by doc_id order by chunk_index)", "chunks_fixed"))
def chunk_neighbours(spark, sf_dir) -> DataFrame:
    """C-13, E-10: the next chunk and how many stand within two places."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return views.chunks_fixed(spark, sf_dir).select("doc_id", "chunk_index", F.lead("chunk_index").over(w).alias("next_chunk"), (F.count("*").over(w.rangeBetween(-2, 2)) - 1).alias("within_two"))


_Q = {k: getattr(chunking, k).replace("'", "''") for k in ("CAPTION", "TABLE_ROW", "MATH", "ODD")}
_CONF = f"greatest(0.0::double, floor((1.0::double - 0.1::double * (not regexp_matches(text, '[.!?]$'))::int - 0.3::double * (length(text) < 100)::int - 0.4::double * regexp_matches(text, '{_Q['CAPTION']}')::int - 0.25::double * regexp_matches(text, '{_Q['TABLE_ROW']}')::int - 0.15::double * regexp_matches(text, '{_Q['MATH']}')::int - case when odd > 0.05 then least(0.3::double, 4 * odd) else 0 end) * 100 + 0.5::double) / 100)"
_ODD_SHARE = f"length(regexp_replace(text, '{_Q['ODD'].replace('[^', '[')}', '', 'g'))::double / greatest(1, length(text))"


@query("chunk_confidence_a", sql(f"select doc_id, chunk_index, {_CONF} as confidence, case when {_CONF} >= 0.7 then 'high' when {_CONF} < 0.5 then 'low' else 'medium' end as tier, {_CONF} >= 0.5 as stage2 from (select *, {_ODD_SHARE} as odd from chunks_fixed)", "chunks_fixed"))
def chunk_confidence_a(spark, sf_dir) -> DataFrame:
    """K-02, D-19, B-12; a chunk that ends inside a sentence counts as cut."""
    t, n = F.col("text"), F.length("text")
    odd = F.regexp_count("text", F.lit(chunking.ODD)) / F.greatest(F.lit(1), n)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    c = 1.0 - 0.1 * flag(~t.rlike(r"[.!?]\z")) - 0.3 * flag(n < 100) - 0.4 * flag(t.rlike(chunking.CAPTION)) - 0.25 * flag(t.rlike(chunking.TABLE_ROW)) - 0.15 * flag(t.rlike(chunking.MATH)) - F.when(odd > 0.05, F.least(F.lit(0.3), 4 * odd)).otherwise(0.0)
    c = F.greatest(F.lit(0.0), half_up(c, 2))
    return views.chunks_fixed(spark, sf_dir).select("doc_id", "chunk_index", c.alias("confidence"), F.when(c >= 0.7, "high").when(c < 0.5, "low").otherwise("medium").alias("tier"), (c >= 0.5).alias("stage2"))


#: Fixed value: characters that are no text, of the page extractor and of chunker B.
PAGE_ODD = r"[^\x09\x0A\x0D\x20-\x7E\x{00A0}-\x{024F}\x{2000}-\x{206F}\x{20A0}-\x{20CF}]"

_EXTRACTED = f"""pages as (select doc_id, count(*) as pages, sum(length(text)) as chars, sum((length(text) < 50)::int) as empty_pages, sum(ocr_applied::int) as ocr_pages, avg(ocr_confidence) as ocr,
    least(1.0::double, sum(length(text))::double / sum(case when ocr_applied then 800 else 1800 end)) as cov, sum(length(text) - length(regexp_replace(text, '{PAGE_ODD}', '', 'g')))::double / greatest(1, sum(length(text))) as ns from doc_pages group by 1),
quality as (select *, {r6('cov', 4)} as coverage, {r6('ns', 4)} as noise, {r6('0.35::double * least(1.0::double, chars::double / pages / 1800) + 0.30::double * greatest(0.0::double, 1 - 20 * ns) + 0.20::double * (1 - empty_pages::double / pages) + 0.15::double * case when ocr_pages = 0 then 1.0::double when ocr is null then 0.5::double else greatest(0.0::double, (ocr - 60) / 40) end', 4)} as score from pages)"""


@query("extraction_quality", sql("select doc_id, pages::bigint as pages, chars::bigint as chars, empty_pages::bigint as empty_pages, coverage, noise, case when coverage >= 0.95 then 'COMPLETE' when coverage >= 0.6 then 'PARTIAL' else 'SPARSE' end as verdict, score, case when noise > 0.15 then 'UNREADABLE' when score >= 0.75 then 'HIGH' when score >= 0.45 then 'MEDIUM' when score >= 0.2 then 'LOW' else 'UNREADABLE' end as tier from quality", "doc_pages", more=_EXTRACTED))
def extraction_quality(spark, sf_dir) -> DataFrame:
    """K-10: page yield, coverage against expected characters, noise, the weighted score and its tier."""
    n = F.length("text")
    g = views.doc_pages(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum(n).alias("chars"), F.count_if(n < 50).alias("empty_pages"), F.count_if("ocr_applied").alias("ocr_pages"), F.avg("ocr_confidence").alias("ocr"),
        F.least(F.lit(1.0), F.sum(n) / F.sum(F.when(F.col("ocr_applied"), 800).otherwise(1800))).alias("cov"), (F.sum(F.regexp_count("text", F.lit(PAGE_ODD))) / F.greatest(F.lit(1), F.sum(n))).alias("ns"),
    )
    ocr = F.when(F.col("ocr_pages") == 0, 1.0).when(F.col("ocr").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), (F.col("ocr") - 60) / 40))
    score = 0.35 * F.least(F.lit(1.0), F.col("chars") / F.col("pages") / 1800) + 0.30 * F.greatest(F.lit(0.0), 1 - 20 * F.col("ns")) + 0.20 * (1 - F.col("empty_pages") / F.col("pages")) + 0.15 * ocr
    g = g.withColumns({"coverage": half_up(F.col("cov"), 4), "noise": half_up(F.col("ns"), 4), "score": half_up(score, 4)})
    verdict = F.when(F.col("coverage") >= 0.95, "COMPLETE").when(F.col("coverage") >= 0.6, "PARTIAL").otherwise("SPARSE")
    s = F.col("score")
    tier = F.when(F.col("noise") > 0.15, "UNREADABLE").when(s >= 0.75, "HIGH").when(s >= 0.45, "MEDIUM").when(s >= 0.2, "LOW").otherwise("UNREADABLE")
    return g.select("doc_id", "pages", "chars", "empty_pages", "coverage", "noise", verdict.alias("verdict"), "score", tier.alias("tier"))


def blocks(spark, sf_dir) -> DataFrame:
    """Parts of a text between blank lines."""
    return views.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("block", "text"))


_BLOCKS = r"blocks as (select doc_id, unnest(string_split_regex(text, '\n\s*\n')) as text from documents)"


@query("equation_gaps", sql(f"select doc_id, count(*)::bigint as blocks, sum((hits::double / greatest(1, words) > 1)::int)::bigint as high from (select doc_id, len(regexp_extract_all(text, '{_Q['MATH']}')) as hits, len(regexp_extract_all(text, '[^\\s]+')) as words from blocks) where hits >= 3 group by 1", more=_BLOCKS))
def equation_gaps(spark, sf_dir) -> DataFrame:
    """K-13: blocks with at least three mathematical signs; dense ones are of high severity."""
    d = blocks(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(chunking.MATH)).alias("hits"), F.regexp_count("text", F.lit(r"[^\s]+")).alias("words")).where("hits >= 3")
    return d.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("hits") / F.greatest(F.lit(1), "words") > 1).alias("high"))


@query("table_blocks", sql(r"""select doc_id, count(*)::bigint as tables, sum(rows)::bigint as rows from (select doc_id, len(list_filter(l, lambda x: contains(x, '|') or 2 * len(list_filter(regexp_extract_all(x, '[^\s]+'), lambda w: regexp_full_match(w, '[\d.,%-]+'))) > len(regexp_extract_all(x, '[^\s]+')))) as rows, len(l) as n
  from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s]')) as l from blocks)) where n >= 3 and rows >= 3 and 2 * rows >= n group by 1""", more=_BLOCKS))
def table_blocks(spark, sf_dir) -> DataFrame:
    """K-14: blocks of three or more lines of which half at least, and three, are mostly numbers or hold a bar."""
    words = lambda x: F.regexp_extract_all(x, F.lit(r"[^\s]+"), F.lit(0))
    data = lambda x: x.contains("|") | (2 * F.size(F.filter(words(x), lambda w: w.rlike(r"\A[\d.,%-]+\z"))) > F.size(words(x)))
    d = blocks(spark, sf_dir).select("doc_id", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\s]")).alias("l"))
    d = d.select("doc_id", F.size("l").alias("n"), F.size(F.filter("l", data)).alias("rows")).where("n >= 3 and rows >= 3 and 2 * rows >= n")
    return d.groupBy("doc_id").agg(F.count("*").alias("tables"), F.sum("rows").cast("long").alias("rows"))


@query("hash_keys", sql("select doc_id, sha256(concat_ws('||', lower(lang), upper(source), lower(lang), sha256(trim(text, ' ')))) as triple_hash, 'doc_' || substr(sha256(source || '/' || doc_id), 1, 16) as stable_id from documents"))
def hash_keys(spark, sf_dir) -> DataFrame:
    """H-08, H-09."""
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.triple_key(F.col("lang"), F.col("source"), F.col("lang"), F.col("text")).alias("triple_hash"), F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), 256), 1, 16)).alias("stable_id"))


@query("vector_cosine", sql(f"select a.vec_id as a, b.vec_id as b, {r6('list_cosine_similarity(a.embedding::double[], b.embedding::double[])')} as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"))
def vector_cosine(spark, sf_dir) -> DataFrame:
    """H-12 between vectors that follow each other."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    j = e.select(F.col("vec_id").alias("a"), F.col("v").alias("x")).join(e.select(F.col("vec_id").alias("b"), F.col("v").alias("y")), F.col("b") == F.col("a") + 1)
    return j.select("a", "b", half_up(T.cosine("x", "y")).alias("similarity"))


_GOLD = "g as (select *, (verdict = 'a' and confidence >= 0.65) or (verdict = 'b' and confidence >= 0.80) as accepted from verifier_gold)"
_PRF = f"tp::bigint as tp, fp::bigint as fp, tn::bigint as tn, fn::bigint as fn, {r6('coalesce(tp::double / nullif(tp + fp, 0), 0)')} as precision, {r6('coalesce(tp::double / nullif(tp + fn, 0), 0)')} as recall, {r6('coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0)')} as f1, {r6('coalesce((tp + tn)::double / nullif(tp + fp + tn + fn, 0), 0)')} as accuracy"


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """L-01: counts and ratios of (predicted, actual); 0 where a denominator is empty."""
    p, a = F.col("predicted"), F.col("actual")
    g = rows.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"))
    over = lambda x, y: half_up(F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0)))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return g.select("*", over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2.0 * tp, 2 * tp + fp + fn).alias("f1"), over(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def accepted(a_least=0.65):
    """B-15 for chunks of ordinary confidence."""
    return ((F.col("verdict") == "a") & (F.col("confidence") >= a_least)) | ((F.col("verdict") == "b") & (F.col("confidence") >= 0.80))


@query("verifier_confusion", sql(f"select {_PRF} from (select sum((accepted and human)::int) as tp, sum((accepted and not human)::int) as fp, sum((not accepted and not human)::int) as tn, sum((not accepted and human)::int) as fn from g)", "verifier_gold", more=_GOLD))
def verifier_confusion(spark, sf_dir) -> DataFrame:
    return confusion(views.verifier_gold(spark, sf_dir).select(accepted().alias("predicted"), F.col("human").alias("actual")))


@query("threshold_sweep", sql(f"select cut, {_PRF} from (select cut, sum((p and human)::int) as tp, sum((p and not human)::int) as fp, sum((not p and not human)::int) as tn, sum((not p and human)::int) as fn from (select c / 100.0::double as cut, human, (verdict = 'a' and confidence >= c / 100.0::double) or (verdict = 'b' and confidence >= 0.80::double) as p from verifier_gold, range(50, 91, 5) as r(c)) group by 1)", "verifier_gold"))
def threshold_sweep(spark, sf_dir) -> DataFrame:
    """L-03: nine cut-offs; each row is repeated nine times before it is counted."""
    g = views.verifier_gold(spark, sf_dir).withColumn("cut", F.explode(F.lit([c / 100.0 for c in range(50, 91, 5)])))
    return confusion(g.select("cut", accepted(F.col("cut")).alias("predicted"), F.col("human").alias("actual")), "cut")


@query("verdict_matrix", sql(f"select verdict, sum((human_verdict = 'a')::int)::bigint as a, sum((human_verdict = 'b')::int)::bigint as b, sum((human_verdict = 'c')::int)::bigint as c, {r6('avg((human_verdict = verdict)::int::double)')} as precision from verifier_gold group by 1", "verifier_gold"))
def verdict_matrix(spark, sf_dir) -> DataFrame:
    """L-02."""
    g = views.verifier_gold(spark, sf_dir).groupBy("verdict")
    return g.agg(*[F.count_if(F.col("human_verdict") == v).alias(v) for v in "abc"], half_up(F.avg((F.col("human_verdict") == F.col("verdict")).cast("double"))).alias("precision"))


@query("spot_precision", sql(f"select c::bigint as right_, p::bigint as partial, i::bigint as wrong, {r6('c::double / (c + p + i)')} as strict, {r6('(c + 0.5::double * p) / (c + p + i)')} as soft from (select sum((human_verdict = 'a')::int) as c, sum((human_verdict = 'b')::int) as p, sum((human_verdict = 'c')::int) as i from verifier_gold)", "verifier_gold"))
def spot_precision(spark, sf_dir) -> DataFrame:
    """L-15, Q-37."""
    c, p, i = F.col("right_"), F.col("partial"), F.col("wrong")
    g = views.verifier_gold(spark, sf_dir).agg(*[F.count_if(F.col("human_verdict") == v).alias(n) for v, n in (("a", "right_"), ("b", "partial"), ("c", "wrong"))])
    return g.select("*", half_up(c / (c + p + i)).alias("strict"), half_up((c + 0.5 * p) / (c + p + i)).alias("soft"))


@query("dual_verifier", sql("select doc_id, case when greatest(verdict, human_verdict) = human_verdict and verdict <> human_verdict then human_verdict else greatest(verdict, human_verdict) end as verdict, least(confidence, ((doc_id * 53 % 101) / 100.0)::double) as confidence from verifier_gold where doc_id % 11 <> 0", "verifier_gold"))
def dual_verifier(spark, sf_dir) -> DataFrame:
    """L-20: both verdicts must be there; the lower one and the lesser confidence stand."""
    g = views.verifier_gold(spark, sf_dir)
    second = g.where(F.col("doc_id") % 11 != 0).select("doc_id", F.col("human_verdict").alias("v2"), ((F.col("doc_id") * 53 % 101) / 100.0).cast("double").alias("c2"))
    return g.join(second, "doc_id").select("doc_id", F.greatest("verdict", "v2").alias("verdict"), F.least("confidence", "c2").alias("confidence"))


@query("consensus", sql(f"""select chunk, items::bigint as items, stable::bigint as stable, {r6('stable::double / items')} as agreement, {r6('coalesce(jaccard, 1)')} as jaccard from
  (select chunk, count(*) as items, sum((runs >= 2)::int) as stable from (select chunk, item, count(*) as runs from consensus_runs group by 1, 2) group by 1)
  left join (select chunk, avg(common::double / (na + nb - common)) as jaccard from (select a.chunk, a.run as ra, b.run as rb, any_value(a.n) as na, any_value(b.n) as nb, coalesce(sum((exists (select 1 from consensus_runs x where x.chunk = a.chunk and x.run = b.run and x.item = a.item))::int), 0) as common from (select *, count(*) over (partition by chunk, run) as n from consensus_runs) a join (select chunk, run, count(*) as n from consensus_runs group by 1, 2) b on a.chunk = b.chunk and a.run < b.run group by 1, 2, 3) group by 1) using (chunk)""", "consensus_runs"))  # fmt: skip
def consensus(spark, sf_dir) -> DataFrame:
    """L-14, G-11: items that most runs agree on, and the mean Jaccard of pairs of runs."""
    r = views.consensus_runs(spark, sf_dir)
    per = r.groupBy("chunk", "item").agg(F.count("*").alias("runs")).groupBy("chunk").agg(F.count("*").alias("items"), F.count_if(F.col("runs") >= 2).alias("stable"))
    sets = r.groupBy("chunk", "run").agg(F.collect_set("item").alias("s"))  # at most twenty items
    pair = sets.select("chunk", F.col("run").alias("ra"), F.col("s").alias("x")).join(sets.select("chunk", F.col("run").alias("rb"), F.col("s").alias("y")), "chunk").where("ra < rb")
    jac = pair.groupBy("chunk").agg(F.avg(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("j"))
    return per.join(jac, "chunk", "left").select("chunk", "items", "stable", half_up(F.col("stable") / F.col("items")).alias("agreement"), half_up(F.coalesce("j", F.lit(1.0))).alias("jaccard"))


@query("cache_partition", sql("select (c.doc_id is not null) as hit, count(*)::bigint as n, sum(coalesce(c.quality, 0))::bigint as kept from documents d left join labels c on c.doc_id = d.doc_id group by 1"))
def cache_partition(spark, sf_dir) -> DataFrame:
    """C-05: keys that a cache of verdicts has and those it lacks."""
    c = views.table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("h"))
    j = views.table(spark, sf_dir, "documents").select("doc_id").join(c, "doc_id", "left")
    return j.groupBy(F.coalesce("h", F.lit(False)).alias("hit")).agg(F.count("*").alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("kept"))


@query("merge_upsert", sql("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1"))
def merge_upsert(spark, sf_dir) -> DataFrame:
    """A-10, A-11: the latest row of each key, as an upsert leaves it; one pre-aggregated maximum."""
    e = views.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    return e.select("user_id", "event_type", "x.event_id", "x.value")


@query("cascade_delete", sql("select 'attempts' as entity, count(*)::bigint as n from attempts where concept_id <> 3 union all select 'sessions', count(*) from sessions where concept_id <> 3", "attempts", "sessions"))
def cascade_delete(spark, sf_dir) -> DataFrame:
    """A-12, A-13: what is left of each table when concept 3 goes."""
    gone = F.broadcast(spark.createDataFrame([(3,)], "concept_id int"))
    left = lambda df, name: df.join(gone, "concept_id", "left_anti").agg(F.lit(name).alias("entity"), F.count("*").alias("n"))
    return left(views.attempts(spark, sf_dir), "attempts").unionByName(left(views.sessions(spark, sf_dir), "sessions"))


@query("ttl_cache", sql(f"select user_id, event_id, ts >= timestamp '{M.AS_OF}' - interval 72 hour as in_window, ts >= timestamp '{M.AS_OF}' - interval 30 minute as recent, ts >= timestamp '{M.AS_OF}' - interval 30 day as fresh from events where event_type = 'view'"))
def ttl_cache(spark, sf_dir) -> DataFrame:
    """N-04, E-12: freshness windows against a fixed clock."""
    now = F.lit(M.AS_OF).cast("timestamp_ntz")
    within = lambda text: F.col("ts") >= now - F.expr(f"interval {text}")
    return views.table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", "event_id", within("72 hours").alias("in_window"), within("30 minutes").alias("recent"), within("30 days").alias("fresh"))


@query("research_export", sql("select a.attempt_id, a.session_id, n::int as attempt_index, question_type, correct, confidence, coalesce(s.mode, '') as mode, 'Concept ' || a.concept_id as concept_title, floor(s.score + 0.5::double)::bigint as session_score from attempts a left join sessions s on s.session_id = a.session_id", "attempts", "sessions"))
def research_export(spark, sf_dir) -> DataFrame:
    """C-03, A-06: export rows; the attempts' own aggregate is joined on the session."""
    a, s = views.attempts(spark, sf_dir), views.sessions(spark, sf_dir).select("session_id", F.col("mode").alias("m"), "score")
    j = a.join(s, "session_id", "left")
    return j.select("attempt_id", "session_id", F.col("n").alias("attempt_index"), "question_type", "correct", "confidence", F.coalesce("m", F.lit("")).alias("mode"), F.concat(F.lit("Concept "), "concept_id").alias("concept_title"), F.floor(F.col("score") + 0.5).alias("session_score"))


@query("progress_stages", sql("""select session_id, array_to_string(list_transform(['diagnostic', 'practice', 'mastery'], lambda s: s || ':' || case when list_position(['diagnostic', 'practice', 'mastery'], s) < list_position(['diagnostic', 'practice', 'mastery'], mode) then 'completed' when s = mode then 'current' else 'locked' end), ',') as stages from sessions""", "sessions"))
def progress_stages(spark, sf_dir) -> DataFrame:
    """H-24."""
    here = F.array_position(F.lit(M.STAGES), F.col("mode"))
    parts = [F.when(here > i + 1, f"{s}:completed").when(here == i + 1, f"{s}:current").otherwise(f"{s}:locked") for i, s in enumerate(M.STAGES)]
    return views.sessions(spark, sf_dir).select("session_id", F.concat_ws(",", *parts).alias("stages"))


@query("question_sampling", sql("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by case when ts < timestamp '2024-01-15' then 1 else 2 end, md5(event_id || '|7')) as r from events) where r = 1"))
def question_sampling(spark, sf_dir) -> DataFrame:
    """F-06 to F-08: tiered pick in a seeded order; a minimum over a struct, not a sort."""
    tier = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), 1).otherwise(2)
    e = views.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct(tier, F.md5(F.concat(F.col("event_id").cast("string"), F.lit("|7"))))).alias("event_id"))
    return e.select("user_id", "event_type", "event_id")


#: Fixed value: words of which a clear question holds one, anywhere.
QUESTION_WORDS = "what when where who why how which is are do does".split()
_GRAMMAR = "greatest(0.0::double, 1.0::double - 0.2::double * (not regexp_matches(text, '^\\p{Lu}'))::int - 0.3::double * (not regexp_matches(text, '\\?\\s*$'))::int - 0.3::double * (n < 3)::int - 0.1::double * (n > 50)::int)"
_CLARITY = f"greatest(0.0::double, 1.0::double - 0.3::double * (not regexp_matches(lower(text), '{'|'.join(QUESTION_WORDS)}'))::int - 0.2::double * (n < 5)::int - 0.1::double * (n > 30)::int)"


def grammar_and_clarity(text: str):
    """L-16."""
    off = lambda x, w: F.when(x, w).otherwise(0.0)
    t, n = F.col(text), F.regexp_count(text, F.lit(r"[^\s]+"))
    g = 1.0 - off(~t.rlike(r"^\p{Lu}"), 0.2) - off(~t.rlike(r"\?\s*\z"), 0.3) - off(n < 3, 0.3) - off(n > 50, 0.1)
    c = 1.0 - off(~F.lower(t).rlike("|".join(QUESTION_WORDS)), 0.3) - off(n < 5, 0.2) - off(n > 30, 0.1)
    blank = n == 0
    return F.when(blank, 0.0).otherwise(F.greatest(F.lit(0.0), g)), F.when(blank, 0.0).otherwise(F.greatest(F.lit(0.0), c))


@query("question_quality", sql(f"select conv_id, turn, {r6('case when n = 0 then 0 else ' + _GRAMMAR + ' end')} as grammar, {r6('case when n = 0 then 0 else ' + _CLARITY + ' end')} as clarity, {r6('case when n = 0 then 0 else (' + _GRAMMAR + ' + ' + _CLARITY + ') / 2 end')} as quality from (select *, len(regexp_extract_all(text, '[^\\s]+')) as n from conversations where role = 'user')"))
def question_quality(spark, sf_dir) -> DataFrame:
    """L-16."""
    g, c = grammar_and_clarity("text")
    return views.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", half_up(g).alias("grammar"), half_up(c).alias("clarity"), half_up((g + c) / 2).alias("quality"))


@query("answer_bands", sql("select count(*)::bigint as n, sum((confidence >= 0.8)::int)::bigint as excellent, sum((confidence >= 0.6 and confidence < 0.8)::int)::bigint as good, sum((confidence >= 0.4 and confidence < 0.6)::int)::bigint as moderate, sum((confidence < 0.4)::int)::bigint as poor from verifier_gold", "verifier_gold"))
def answer_bands(spark, sf_dir) -> DataFrame:
    """D-20, L-19."""
    c = F.col("confidence")
    return views.verifier_gold(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(c >= 0.8).alias("excellent"), F.count_if((c >= 0.6) & (c < 0.8)).alias("good"), F.count_if((c >= 0.4) & (c < 0.6)).alias("moderate"), F.count_if(c < 0.4).alias("poor"))
