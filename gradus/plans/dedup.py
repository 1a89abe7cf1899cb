"""Queries that leave repeats out and give things keys: lines, relations, questions, cached verdicts; and spaced reviews dealt into sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions.formulas import half_up
from ..sources import views
from .models import _DECAY, _MASTERY, review_table
from .paths import _PAIRS as _ASKED
from .paths import answer_pairs
from .stored import _TRIPLES, triples
from .views_sql import r6, sql

QUERIES, SQL = {}, {}


def query(name: str, statement: str | None = None):
    def add(f):
        QUERIES[name] = f
        if statement:
            SQL[name] = statement
        return f

    return add


def without_fragments(lines: Column) -> Column:
    """K-15: the lines that the next one does not begin with, case and blanks aside; a line of blanks is no fragment. Null past the end ends it."""
    low = lambda x: F.replace(F.lower(x), F.lit(" "), F.lit(""))
    kept = lambda a, b: F.when(F.coalesce(F.startswith(low(b), low(a)) & (low(a) != ""), F.lit(False)), F.lit(None)).otherwise(a)
    return F.array_compact(F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), kept))


_LOW = "replace(lower({0}), ' ', '')"


@query("heading_fragments", sql(f"""select doc_id, count(*)::bigint as lines, sum((not keep)::int)::bigint as fragments, coalesce(sum(case when keep then length(line) end), 0)::bigint as kept_chars from (select doc_id, line, nxt is null or not starts_with({_LOW.format('nxt')}, {_LOW.format('line')}) as keep
  from (select doc_id, line, lead(line) over (partition by doc_id order by i) as nxt from (select doc_id, i, trim((string_split(text, chr(10)))[i], ' ') as line from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i)) where line <> '')) group by 1"""))
def heading_fragments(spark, sf_dir) -> DataFrame:
    """K-15 of each document's lines that are not blank, within its row: no shuffle."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x)), lambda x: x != "").alias("l")).where("size(l) > 0")
    d = d.select("doc_id", F.size("l").cast("long").alias("lines"), without_fragments(F.col("l")).alias("kept"))
    return d.select("doc_id", "lines", (F.col("lines") - F.size("kept")).alias("fragments"), F.length(F.array_join("kept", "")).cast("long").alias("kept_chars"))


def plain_words(text: Column) -> Column:
    """G-04: lower case, without an article in front, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(F.coalesce(text, F.lit("")))), r"^(the|a|an)\s+", ""), r"\s+", " ")


def _plain_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''), ' ')), '^(the|a|an)\\s+', ''), '\\s+', ' ', 'g')"


def deduplicated(relations: DataFrame, order: str) -> DataFrame:
    """G-04: of the relations (subject, relation, object, ...) that differ in case, blanks and articles only, the first by `order`, and how many."""
    keys = {f"_{c}": plain_words(F.col(c)) for c in ("subject", "relation", "object")}
    rest = F.struct(*relations.columns)
    g = relations.withColumns(keys).groupBy(*keys).agg(F.min_by(rest, F.col(order)).alias("r"), F.count("*").alias("n"))
    return g.select("r.*", "n")


def _variants(spark, sf_dir) -> DataFrame:
    i = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    t = views.table(spark, sf_dir, "lineitem").select(i.alias("at"), F.floor(F.col("l_orderkey") / 64).alias("d"), "l_partkey", "l_suppkey")
    s = F.concat(F.element_at(F.array(F.lit("The "), F.lit("a  "), F.lit(""), F.lit(" AN ")), (F.col("at") % 4 + 1).cast("int")), F.lit("node "), F.col("d"), F.lit("."), F.col("l_partkey") % 5)
    o = F.concat(F.when(F.col("at") % 3 == 0, "NODE   ").otherwise("node "), F.col("d"), F.lit("."), F.col("l_suppkey") % 5)
    return t.select("at", s.alias("subject"), F.when(F.col("at") % 2 == 0, "part of").otherwise("Part  Of").alias("relation"), o.alias("object"))


@query("relation_dedup", sql(f"""select "at" as first_at, subject, relation, object, n from (select *, row_number() over w as r, (count(*) over (partition by {_plain_sql('subject')}, {_plain_sql('relation')}, {_plain_sql('object')}))::bigint as n from (select l_orderkey * 8 + l_linenumber as "at", ['The ', 'a  ', '', ' AN '][(l_orderkey * 8 + l_linenumber) % 4 + 1] || 'node ' || (l_orderkey // 64) || '.' || (l_partkey % 5) as subject,
  case when (l_orderkey * 8 + l_linenumber) % 2 = 0 then 'part of' else 'Part  Of' end as relation, case when (l_orderkey * 8 + l_linenumber) % 3 = 0 then 'NODE   ' else 'node ' end || (l_orderkey // 64) || '.' || (l_suppkey % 5) as object from lineitem) window w as (partition by {_plain_sql('subject')}, {_plain_sql('relation')}, {_plain_sql('object')} order by "at")) where r = 1"""))
def relation_dedup(spark, sf_dir) -> DataFrame:
    """G-04: relations of order lines, written with articles, in capitals or with more blanks."""
    return deduplicated(_variants(spark, sf_dir), "at").withColumnRenamed("at", "first_at")


@query("question_dedup", sql("select key, min_by(conv_id, (conv_id, turn))::bigint as conv_id, min_by(turn, (conv_id, turn)) as turn, count(*)::bigint as n from (select conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) as key from conversations where role = 'user' and text is not null) group by 1"))
def question_dedup(spark, sf_dir) -> DataFrame:
    """G-05: users' questions with the same letters and digits; the first of each stays."""
    key = F.btrim(F.regexp_replace(F.lower("text"), r"[^a-z0-9\s]", ""), F.lit(" \t\n\r"))
    c = views.table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select(key.alias("key"), "conv_id", "turn")
    return c.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("f"), F.count("*").alias("n")).select("key", "f.conv_id", "f.turn", "n")


def triple_hash(s: Column, p: Column, o: Column, chunk: Column) -> Column:
    """H-08: the key of a cached verdict: ends in lower case, the predicate in capitals, and the hash of the chunk, edges trimmed."""
    return F.sha2(F.concat_ws("||", F.lower(F.btrim(s)), F.upper(F.btrim(p)), F.lower(F.btrim(o)), F.sha2(F.btrim(chunk), 256)), 256)


def explanation_hash(label: Column, correct: Column, student: Column, concept: Column, path: Column) -> Column:
    """H-08: the key of a cached explanation."""
    norm = lambda x: F.btrim(F.regexp_replace(F.lower(x), r"\s+", " "))
    return F.sha2(F.concat_ws("||", norm(label), norm(correct), norm(student), norm(concept), F.array_join(F.transform(path, lambda x: F.btrim(x)), " >> ")), 256)


_NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'), ' ')"


@query("cache_keys", sql(f"""select 'verdict' as kind, chunk as id, sha256(lower(subject) || '||' || upper(relation) || '||' || lower(object) || '||' || sha256('Order ' || chunk)) as key from t
  union all select 'explanation', id, sha256('gap ' || (id % 3) || '||' || {_NORM.format('correct')} || '||' || {_NORM.format('student')} || '||' || 'document ' || doc || '||' || trim(correct, ' ') || ' >> ' || trim(student, ' ')) from asked""", "edges", "nodes", more=_TRIPLES + ",\n" + _ASKED))
def cache_keys(spark, sf_dir) -> DataFrame:
    """H-08: keys of triples with their chunk, and of explanations of answers."""
    chunk = F.concat(F.lit("  Order "), "chunk", F.lit(" "))
    t = triples(spark, sf_dir).select(F.lit("verdict").alias("kind"), F.col("chunk").alias("id"), triple_hash(F.concat(F.lit(" "), "subject"), F.lower("relation"), F.upper("object"), chunk).alias("key"))
    label, concept = F.concat(F.lit(" Gap  "), F.col("id") % 3), F.concat(F.lit("DOCUMENT "), "doc")
    a = answer_pairs(spark, sf_dir).select(F.lit("explanation").alias("kind"), "id", explanation_hash(label, F.col("correct"), F.col("student"), concept, F.array("correct", "student")).alias("key"))
    return t.unionByName(a)


# Reviews of other concepts that a session of a mode takes at most.
SPACED_LIMIT = {"practice": 1, "mastery": 2}


@query("spaced_injection", sql("""select session_id, peer from (select s.session_id, p.concept_id as peer, s.most, row_number() over (partition by s.session_id order by md5('7|' || s.session_id || '|' || p.concept_id)) as r from (select session_id, user_id, concept_id, least(case mode when 'practice' then 1 else 2 end, count(*) // 2) as most from attempts where mode <> 'diagnostic' group by session_id, user_id, concept_id, mode) s
  join due p on p.user_id = s.user_id and p.concept_id <> s.concept_id and p.concept_id % 2 = s.concept_id % 2 where p.now_mastery < 70) where r <= most""", "attempts", more=_MASTERY + ",\n" + _DECAY))
def spaced_injection(spark, sf_dir) -> DataFrame:
    """I-45: of a learner's other concepts of the same document that need review, a seeded draw for each session: one in practice, two in
    mastery, none in a diagnostic, and no more than half of the questions."""
    limit = M.case_map(F.col("mode"), SPACED_LIMIT, 0)
    s = views.attempts(spark, sf_dir).groupBy("session_id", "user_id", "concept_id", "mode").agg(F.floor(F.count("*") / 2).alias("half"))
    s = s.select("session_id", "user_id", "concept_id", (F.col("concept_id") % 2).alias("source"), F.least(limit, "half").alias("most")).where("most > 0")
    p = review_table(spark, sf_dir).where(F.col("now_mastery") < M.REVIEW).select("user_id", F.col("concept_id").alias("peer"), (F.col("concept_id") % 2).alias("source"))
    draw = F.row_number().over(Window.partitionBy("session_id").orderBy(F.md5(F.concat_ws("|", F.lit(7), "session_id", "peer"))))
    return s.join(p, ["user_id", "source"]).where("concept_id <> peer").withColumn("r", draw).where("r <= most").select("session_id", "peer")


# Weights of accuracy, time passed and speed, and the forgetting of an hour.
SPACED_WEIGHTS, FORGETTING = (0.5, 0.3, 0.2), 0.05


@query("spaced_scores", sql(f"""select attempt_id, {r6('h', 4)} as hours, {r6("0.5::double * correct::int + 0.3::double * (1.0::double - exp(-0.05::double * h)) + 0.2::double * least(1.0::double, case difficulty when 1 then 30.0::double when 2 then 60.0::double else 90.0::double end / time_taken)")} as score from (select *, coalesce((epoch_us(created_at) - epoch_us(lag(created_at) over (partition by user_id, concept_id order by created_at, attempt_id))) / 3.6e9::double, 0.0::double) as h from attempts) where is_spaced""", "attempts"))
def spaced_scores(spark, sf_dir) -> DataFrame:
    """I-19: the score of a spaced answer, with the hours since the learner last answered on the concept."""
    own = Window.partitionBy("user_id", "concept_id").orderBy("created_at", "attempt_id")
    a = views.attempts(spark, sf_dir).withColumn("h", F.coalesce(M.hours_between(F.col("created_at"), F.lag("created_at").over(own)), F.lit(0.0))).where("is_spaced")
    speed = F.when(F.col("time_taken") <= 0, 1.0).otherwise(F.least(F.lit(1.0), M.case_map(F.col("difficulty"), M.EXPECTED_SECONDS, 60.0) / F.col("time_taken")))
    acc, passed, quick = SPACED_WEIGHTS
    score = acc * F.col("correct").cast("double") + passed * (1.0 - F.exp(-FORGETTING * F.col("h"))) + quick * speed
    return a.select("attempt_id", half_up(F.col("h"), 4).alias("hours"), half_up(score).alias("score"))
