"""Reports on learners' progress: system and concept metrics, titles and defaults, gaps, overdue reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions.formulas import half_up
from ..operators import folds, metrics
from ..sources import views
from .learner import _GAIN, _SCORED, judged
from .learner import SQL as _LEARNER
from .models import _DECAY, _FSRS, _MASTERY
from .views_sql import r6, sql

QUERIES, SQL = {}, {}
MASTERY_GOAL = 75


def query(name: str, statement: str | None = None):
    def add(f):
        QUERIES[name] = f
        if statement:
            SQL[name] = statement
        return f

    return add


def mean(x: Column, digits: int) -> Column:
    """The mean of values of six digits, by their sum as whole numbers, which does not depend on an order; null where there is none."""
    return half_up(F.sum(F.floor(x * 1e6 + 0.5).cast("long")) / F.count(x) / 1e6, digits)


def _mean_sql(x: str, digits: int) -> str:
    return r6(f"sum(floor(({x}) * 1e6::double + 0.5::double)::bigint)::double / count({x}) / 1e6::double", digits)


def measured_sessions(spark, sf_dir) -> DataFrame:
    """Sessions with their gain over the baseline and the measures that reports need."""
    m = metrics.session_metrics(views.attempts(spark, sf_dir)).select("session_id", "ccms", "brier_score", "ece")
    return metrics.gains(views.sessions(spark, sf_dir)).join(m, "session_id")


_MEASURED = _GAIN + f""",
measured as (select * from gained join (select session_id, ccms, brier_score, ece from ({_LEARNER['session_metrics']})) using (session_id))"""


@query("system_report", sql(f"""select students::bigint as students, improved::bigint as mastery_improvement_rate, {r6('sessions', 1)} as sessions_to_mastery, with_learning as ccms_with_learning, without_learning as ccms_without_learning, {r6('w - d', 2)} as ccms_delta, avg_nlg, avg_brier, avg_ece from
  (select count(distinct user_id) as students, floor(100 * avg((mastery > {MASTERY_GOAL})::int::double) + 0.5::double) as improved from mastery), (select count(*)::double / count(distinct user_id) as sessions,
  {_mean_sql("case when mode = 'practice' then ccms end", 2)} as with_learning, {_mean_sql("case when mode = 'diagnostic' then ccms end", 2)} as without_learning, {_mean_sql("case when mode = 'practice' then ccms end", 6)} as w, {_mean_sql("case when mode = 'diagnostic' then ccms end", 6)} as d,
  {_mean_sql("nlg", 3)} as avg_nlg, {_mean_sql("case when nlg is not null then brier_score end", 3)} as avg_brier, {_mean_sql("case when nlg is not null then ece end", 3)} as avg_ece from measured)""", "attempts", "sessions", more=_MASTERY + ",\n" + _MEASURED))  # fmt: skip
def system_report(spark, sf_dir) -> DataFrame:
    """D-09, I-37: share of mastered concepts, mean sessions of a learner, CCMS of practice against diagnostic sessions, and mean gain, Brier
    score and calibration error of the sessions that have a gain."""
    m = folds.mastery_fold(views.attempts(spark, sf_dir)).agg(F.countDistinct("user_id").alias("students"), F.floor(100 * F.avg((F.col("mastery") > MASTERY_GOAL).cast("double")) + 0.5).alias("mastery_improvement_rate"))
    of = lambda mode: F.when(F.col("mode") == mode, F.col("ccms"))
    gained = lambda c: F.when(F.col("nlg").isNotNull(), F.col(c))
    s = measured_sessions(spark, sf_dir).agg(
        half_up(F.count("*") / F.countDistinct("user_id"), 1).alias("sessions_to_mastery"), mean(of("practice"), 2).alias("ccms_with_learning"), mean(of("diagnostic"), 2).alias("ccms_without_learning"),
        half_up(mean(of("practice"), 6) - mean(of("diagnostic"), 6), 2).alias("ccms_delta"), mean(F.col("nlg"), 3).alias("avg_nlg"), mean(gained("brier_score"), 3).alias("avg_brier"), mean(gained("ece"), 3).alias("avg_ece"),
    )
    return m.crossJoin(s)  # one row each


@query("concept_report", sql(f"""select concept_id, count(*)::bigint as sessions, floor(sum(floor(score * 1e6::double + 0.5::double)::bigint)::double / count(*) / 1e6::double + 0.5::double)::bigint as avg_score, sum((score >= 80)::int)::bigint as passed, max_by(ccms, (created_at, session_id)) as latest_ccms, {r6("max_by(nlg, (created_at, session_id)) filter (nlg is not null)")} as latest_nlg, {_mean_sql("brier_score", 3)} as avg_brier from measured group by 1""", "attempts", "sessions", more=_MEASURED))
def concept_report(spark, sf_dir) -> DataFrame:
    """D-05: sessions, mean score, passes, the newest CCMS and gain, and the mean Brier score of each concept."""
    order = F.struct("created_at", "session_id")
    g = measured_sessions(spark, sf_dir).groupBy("concept_id")
    return g.agg(F.count("*").alias("sessions"), F.floor(F.sum(F.floor(F.col("score") * 1e6 + 0.5).cast("long")) / F.count("*") / 1e6 + 0.5).alias("avg_score"), F.count_if(F.col("score") >= M.PASS).alias("passed"), F.max_by("ccms", order).alias("latest_ccms"), half_up(F.max_by("nlg", F.when(F.col("nlg").isNotNull(), order))).alias("latest_nlg"), mean(F.col("brier_score"), 3).alias("avg_brier"))


def titles(spark, sf_dir) -> DataFrame:
    """Titles of the concepts that have one: regions stand for them, counted from one."""
    return views.table(spark, sf_dir, "region").select((F.col("r_regionkey") - 1).alias("concept_id"), F.col("r_name").alias("title"))


@query("session_titles", sql("select session_id, user_id, concept_id, coalesce(r_name, 'Unknown Concept') as title, mode, floor(score + 0.5::double)::bigint as score, score >= 80 as passed from sessions left join region on r_regionkey = concept_id + 1", "attempts", "sessions"))
def session_titles(spark, sf_dir) -> DataFrame:
    """C-01: sessions with their concept's title, where it has one."""
    j = views.sessions(spark, sf_dir).join(titles(spark, sf_dir), "concept_id", "left")
    return j.select("session_id", "user_id", "concept_id", F.coalesce("title", F.lit("Unknown Concept")).alias("title"), "mode", F.floor(F.col("score") + 0.5).alias("score"), (F.col("score") >= M.PASS).alias("passed"))


#: Concepts in every learner's list; answers are of the first five.
LISTED = 7


@query("concept_list", sql(f"select u.user_id, i::int as concept_id, coalesce(now_mastery, 0.0::double) as mastery, coalesce(stage, 'diagnostic') as stage, last_updated from (select distinct user_id from attempts) u, range({LISTED}) r(i) left join decay d on d.user_id = u.user_id and d.concept_id = i", "attempts", more=_MASTERY + ",\n" + _DECAY))
def concept_list(spark, sf_dir) -> DataFrame:
    """C-02: every learner's list of concepts with the mastery that is left by now; 0, the first stage and no date where there was no session."""
    a = views.attempts(spark, sf_dir)
    listed = a.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(LISTED - 1))).alias("concept_id"))
    m = folds.mastery_fold(a)
    hours = M.hours_between(F.lit(M.AS_OF).cast("timestamp_ntz"), F.col("last_updated"))
    j = listed.join(m.withColumn("now", M.decayed(F.col("mastery"), hours)).select("user_id", "concept_id", "now", "stage", "last_updated"), ["user_id", "concept_id"], "left")
    return j.select("user_id", "concept_id", F.coalesce("now", F.lit(0.0)).alias("mastery"), F.coalesce("stage", F.lit(M.STAGES[0])).alias("stage"), "last_updated")


@query("attempt_export", sql("select a.attempt_id, a.user_id, a.session_id, coalesce(s.mode, '') as mode, coalesce(floor(s.score + 0.5::double)::bigint::varchar, '') as session_score, coalesce(r_name, '') as concept_title, a.correct, a.confidence, a.time_taken from attempts a left join (select s.* from sessions s join (select session_id from attempts group by 1 having count(*) = 5) using (session_id)) s on s.session_id = a.session_id left join region on r_regionkey = s.concept_id + 1", "attempts", "sessions"))
def attempt_export(spark, sf_dir) -> DataFrame:
    """C-03: attempts with their session, if that is complete, and with that session's concept, blank where there is none."""
    a = views.attempts(spark, sf_dir)
    whole = a.groupBy("session_id").agg(F.count("*").alias("n")).where("n = 5").select("session_id")
    s = views.sessions(spark, sf_dir).join(whole, "session_id").join(titles(spark, sf_dir), "concept_id", "left").select("session_id", F.col("mode").alias("m"), "score", "title")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return a.join(s, "session_id", "left").select("attempt_id", "user_id", "session_id", blank(F.col("m")).alias("mode"), blank(F.floor(F.col("score") + 0.5).cast("string")).alias("session_score"), blank(F.col("title")).alias("concept_title"), "correct", "confidence", "time_taken")


_LABEL = "question_type || ':' || coalesce(hop::varchar, 'none')"


@query("critical_gaps", sql(f"""select user_id, sum(n)::bigint as total, sum(case when severity = 'CORRECT' then n else 0 end)::bigint as n_correct, sum(case when severity = 'CLOSE' then n else 0 end)::bigint as n_close, sum(case when severity = 'PARTIAL' then n else 0 end)::bigint as n_partial, sum(case when severity = 'CRITICAL' then n else 0 end)::bigint as n_critical,
  coalesce(string_agg(case when severity = 'CRITICAL' then label || ' x' || n end, ', ' order by label), '') as gaps from (select user_id, severity, {_LABEL} as label, count(*) as n from judged group by 1, 2, 3) group by 1""", "attempts", more=_SCORED))
def critical_gaps(spark, sf_dir) -> DataFrame:
    """D-10: a learner's answers by severity, and the critical misconceptions with how often they showed. Answers are counted by label first, so
    what a learner gathers is bounded by the labels."""
    label = F.concat_ws(":", "question_type", F.coalesce(F.col("hop").cast("string"), F.lit("none")))
    g = judged(spark, sf_dir).groupBy("user_id", "severity", label.alias("label")).agg(F.count("*").alias("n"))
    count = lambda s: F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(f"n_{s.lower()}")
    gaps = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == "CRITICAL", F.struct("label", "n")))), lambda x: F.concat(x["label"], F.lit(" x"), x["n"].cast("string"))), ", ")
    return g.groupBy("user_id").agg(F.sum("n").alias("total"), *[count(s) for s in ("CORRECT", "CLOSE", "PARTIAL", "CRITICAL")], gaps.alias("gaps"))


@query("answer_totals", sql(f"""select concept_id, attempts::bigint as attempts, {r6('tenths::double / attempts / 10', 2)} as avg_score, tenths::double / attempts / 10 >= 0.85::double as mastered, (sum(attempts) over ())::bigint as total, (sum(n_correct) over ())::bigint as total_correct, {r6('(sum(n_correct) over ())::double / (sum(attempts) over ())::double * 100', 1)} as score_percent,
  {r6('(sum(tenths) over ())::double / (sum(attempts) over ())::double / 10', 2)} as total_avg_score, (row_number() over (order by {r6('tenths::double / attempts / 10', 2)}, concept_id))::int as place from (select concept_id, count(*) as attempts, sum(correct::int) as n_correct, sum(round(answer_score * 10)::bigint) as tenths from judged group by 1)""", "attempts", more=_SCORED))
def answer_totals(spark, sf_dir) -> DataFrame:
    """D-12, D-13: concepts from the weakest, whether they are mastered or to be reviewed, beside the report's totals."""
    g = judged(spark, sf_dir).groupBy("concept_id").agg(F.count("*").alias("attempts"), F.count_if("correct").alias("n_correct"), F.sum(F.round(F.col("answer_score") * 10).cast("long")).alias("tenths"))
    every = Window.partitionBy(F.lit(0))  # one row a concept
    total = lambda c: F.sum(c).over(every)
    avg = F.col("tenths") / F.col("attempts") / 10
    place = F.row_number().over(every.orderBy(half_up(avg, 2), "concept_id"))
    return g.select("concept_id", "attempts", half_up(avg, 2).alias("avg_score"), (avg >= 0.85).alias("mastered"), total("attempts").alias("total"), total("n_correct").alias("total_correct"), half_up(total("n_correct") / total("attempts") * 100, 1).alias("score_percent"), half_up(total("tenths") / total("attempts") / 10, 2).alias("total_avg_score"), place.alias("place"))


@query("misconception_penalties", sql(f"select user_id, concept_id, sum((not correct and hop is not null)::int)::bigint as frequency, count(*)::bigint as attempts, {r6('1.0::double - sum((not correct and hop is not null)::int)::double / count(*)')} as penalty from attempts group by 1, 2", "attempts"))
def misconception_penalties(spark, sf_dir) -> DataFrame:
    """I-20: what part of a learner's answers to a concept shows no misconception, a wrong option of known distance."""
    f = F.count_if(~F.col("correct") & F.col("hop").isNotNull())
    return views.attempts(spark, sf_dir).groupBy("user_id", "concept_id").agg(f.alias("frequency"), F.count("*").alias("attempts"), half_up(1.0 - f / F.count("*")).alias("penalty"))


# Retrievability at which a review is due, and the longest overdue reviews that are shown.
DUE_AT, SHOWN = 0.70, 3


@query("fsrs_reviews", sql(f"""select user_id, concept_id, case when age <= 0 then mastery else greatest(0.0::double, {r6("mastery * (1.0::double / (1.0::double + (age / 3.6e9::double / 24) / (9.0::double * s)))", 2)}) end as now_mastery, greatest(0.0::double, {r6(f"9.0::double * s * (1 / {DUE_AT}::double - 1)", 1)}) as next_review_days from now join (select user_id, concept_id, max_by(s, n) as s from t group by 1, 2) using (user_id, concept_id)""", "attempts", more=_MASTERY + ",\n" + _DECAY + ",\n" + _FSRS))
def fsrs_reviews(spark, sf_dir) -> DataFrame:
    """I-17: mastery that is left by the memory's stability, and days until the next review is due."""
    a = views.attempts(spark, sf_dir)
    s = folds.fsrs_state(a).select("user_id", "concept_id", "stability")
    j = folds.mastery_fold(a).join(s, ["user_id", "concept_id"])
    hours = M.hours_between(F.lit(M.AS_OF).cast("timestamp_ntz"), F.col("last_updated"))
    r = F.lit(1.0) / (F.lit(1.0) + (hours / 24) / (F.lit(9.0) * F.col("stability")))
    left = F.when(hours <= 0, F.col("mastery")).otherwise(F.greatest(F.lit(0.0), half_up(F.col("mastery") * r, 2)))
    return j.select("user_id", "concept_id", left.alias("now_mastery"), F.greatest(F.lit(0.0), half_up(9.0 * F.col("stability") * (1 / F.lit(DUE_AT) - 1), 1)).alias("next_review_days"))


@query("overdue_reviews", sql(f"select user_id, concept_id, place::int as place, {r6('age / 3.6e9::double', 2)} as hours from (select *, row_number() over (partition by user_id order by age desc, concept_id) as place from due where age / 3.6e9::double >= review_days * 24) where place <= {SHOWN}", "attempts", more=_MASTERY + ",\n" + _DECAY))
def overdue_reviews(spark, sf_dir) -> DataFrame:
    """F-04: the three reviews of each learner that have been due for longest."""
    m = folds.mastery_fold(views.attempts(spark, sf_dir))
    hours = M.hours_between(F.lit(M.AS_OF).cast("timestamp_ntz"), F.col("last_updated"))
    due = m.withColumn("hours", hours).where(F.col("hours") >= M.review_days(F.col("mastery")) * 24)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("hours"), "concept_id"))
    return due.withColumn("place", place).where(F.col("place") <= SHOWN).select("user_id", "concept_id", "place", half_up(F.col("hours"), 2).alias("hours"))
