"""Queries over attempts and sessions: metrics, windows and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions.formulas import half_up
from ..operators import metrics
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


_METRICS = f"""
plain as (select *, correct::int::double as y, avg(time_taken) over (partition by session_id) as pace, case question_type when 'recall' then 1.0::double when 'conceptual' then 1.2::double when 'application' then 1.5::double when 'reasoning' then 1.5::double else 2.0::double end as w from attempts where not is_spaced),
paced as (select *, least(2.0::double, time_taken / pace) as ratio, least(greatest(confidence, 1e-7::double), 1 - 1e-7::double) as c from plain),
bins as (select session_id, least(9, floor(confidence * 10)) as bin, count(*) as m, avg(y) as acc, avg(confidence) as conf from plain group by 1, 2),
ece as (select session_id, sum(m * abs(acc - conf)) / sum(m) as ece from bins group by 1),
m as (select session_id, count(*) as n, avg(y) * 100 as score, sum(w * y) / sum(w) as fas, sum(cognitive_level * y) / sum(cognitive_level) as wbs,
  avg(case when correct then 0.0::double when confidence > 0.7 then 2.0::double when confidence >= 0.4 then 1.5::double else 1.0::double end) as mss,
  avg(greatest(0.0::double, least(1.0::double, case when pace <= 0 or (correct and ratio = 0) then 1 when correct then confidence / ratio else confidence * ratio end))) as rci_avg,
  avg(abs(y - confidence)) as calibration_error, avg((confidence - y) * (confidence - y)) as brier_score, avg(-case when correct then ln(c) else ln(1.0::double - c) end) as log_loss from paced group by 1),
e as (select session_id, coalesce(n, 0) as n, coalesce(m.score, a.score) as score, coalesce(fas, 0) as fas, coalesce(wbs, 0) as wbs, coalesce(mss, 0) as mss, coalesce(rci_avg, 0) as rci_avg, coalesce(calibration_error, 0) as calibration_error, coalesce(brier_score, 0) as brier_score, coalesce(ece, 0) as ece, coalesce(log_loss, 0) as log_loss
  from (select session_id, avg(correct::int::double) * 100 as score from attempts group by 1) a left join m using (session_id) left join ece using (session_id)),
f as (select *, case when n > 0 then 0.15::double * fas + 0.25::double * wbs + 0.6::double * score / 100 else 0 end as ccms from e)"""


@query("session_metrics", sql(f"""select session_id, n::bigint as n, {', '.join(f'{r6(c)} as {c}' for c in ('score', 'fas', 'wbs', 'ccms', 'mss', 'rci_avg', 'calibration_error', 'brier_score', 'ece', 'log_loss'))},
  {r6('case when n > 0 then (1 - greatest(0.0::double, least(1.0::double, ccms))) / 2 + least(1.0::double, mss / 2) / 2 else 0 end')} as lip from f""", "attempts", more=_METRICS.strip()))  # fmt: skip
def session_metrics(spark, sf_dir) -> DataFrame:
    return metrics.session_metrics(views.attempts(spark, sf_dir))


@query("session_breakdown", sql("""select session_id, count(*)::bigint as total, sum(correct::int)::bigint as n_correct, sum((difficulty = 1)::int)::bigint as easy, sum((difficulty = 2)::int)::bigint as medium, sum((difficulty not in (1, 2))::int)::bigint as hard,
  sum((difficulty = 1 and not correct)::int)::bigint as easy_wrong, sum((difficulty = 2 and not correct)::int)::bigint as medium_wrong, sum((difficulty not in (1, 2) and not correct)::int)::bigint as hard_wrong,
  string_agg(question_type || ':' || c, ',' order by question_type) as by_type from (select *, count(*) over (partition by session_id, question_type) as c, row_number() over (partition by session_id, question_type order by attempt_id) as r from attempts) x group by session_id""".replace("string_agg(question_type || ':' || c, ',' order by question_type)", "string_agg(case when r = 1 then question_type || ':' || c end, ',' order by question_type)"), "attempts"))  # fmt: skip
def session_breakdown(spark, sf_dir) -> DataFrame:
    """D-06."""
    band = {"easy": F.col("difficulty") == 1, "medium": F.col("difficulty") == 2, "hard": ~F.col("difficulty").isin(1, 2)}
    kinds = ["analytical", "application", "conceptual", "reasoning", "recall"]
    g = views.attempts(spark, sf_dir).groupBy("session_id").agg(
        F.count("*").alias("total"), F.count_if("correct").alias("n_correct"), *[F.count_if(c).alias(b) for b, c in band.items()],
        *[F.count_if(c & ~F.col("correct")).alias(f"{b}_wrong") for b, c in band.items()], *[F.count_if(F.col("question_type") == t).alias(t) for t in kinds],
    )
    by_type = F.concat_ws(",", *[F.when(F.col(t) > 0, F.concat(F.lit(f"{t}:"), F.col(t))) for t in kinds])
    return g.withColumn("by_type", by_type).drop(*kinds)


@query("weak_topics", sql("""select concept_id, wrong::bigint as wrong, questions from (select concept_id, count(*) as wrong, array_to_string((list(question_id order by created_at desc, attempt_id desc))[1:3], ',') as questions from attempts where not correct group by 1) order by wrong desc, concept_id limit 5""", "attempts"))
def weak_topics(spark, sf_dir) -> DataFrame:
    """D-07: wrong answers by concept with the newest three questions; two steps, so that a hot concept is cut by user first."""
    wrong = views.attempts(spark, sf_dir).where("not correct")
    newest = lambda c: F.slice(F.sort_array(c, asc=False), 1, 3)
    per_user = wrong.groupBy("concept_id", "user_id").agg(F.count("*").alias("m"), newest(F.collect_list(F.struct("created_at", "attempt_id", "question_id"))).alias("top"))
    g = per_user.select("concept_id", "m", "user_id", "top").withColumn("salt", F.col("user_id") % 32)
    g = g.groupBy("concept_id", "salt").agg(F.sum("m").alias("m"), newest(F.flatten(F.collect_list("top"))).alias("top"))
    g = g.groupBy("concept_id").agg(F.sum("m").alias("wrong"), newest(F.flatten(F.collect_list("top"))).alias("top"))
    return g.select("concept_id", "wrong", F.array_join("top.question_id", ",").alias("questions")).orderBy(F.desc("wrong"), "concept_id").limit(5)


@query("concept_breakdown", sql(f"""select concept_id, count(*)::bigint as sessions, floor(avg(score) + 0.5::double)::bigint as avg_score, sum((score >= 80)::int)::bigint as passed, {r6('max_by(score, (created_at, session_id))')} as latest_score from sessions group by 1""", "sessions"))
def concept_breakdown(spark, sf_dir) -> DataFrame:
    """D-05."""
    return views.sessions(spark, sf_dir).groupBy("concept_id").agg(F.count("*").alias("sessions"), F.floor(F.avg("score") + 0.5).alias("avg_score"), F.count_if(F.col("score") >= M.PASS).alias("passed"), half_up(F.max_by("score", F.struct("created_at", "session_id"))).alias("latest_score"))


@query("mss_by_concept", sql(f"""select concept_id, {r6('least(2.0::double, avg(case when correct then 0.0::double when confidence > 0.7 then 2.0::double when confidence >= 0.4 then 1.5::double else 1.0::double end))')} as mss from attempts group by 1""", "attempts"))
def mss_by_concept(spark, sf_dir) -> DataFrame:
    """D-08."""
    return views.attempts(spark, sf_dir).groupBy("concept_id").agg(half_up(F.least(F.lit(2.0), F.avg(M.wrong_weight(F.col("correct"), F.col("confidence"))))).alias("mss"))


_SCORED = """scored as (select *, case when correct then 1.0::double when hop = 1 then 0.4::double when hop = 2 then 0.2::double else 0.0::double end as answer_score from attempts),
judged as (select *, case when answer_score >= 0.85 then 'CORRECT' when answer_score >= 0.6 then 'CLOSE' when answer_score >= 0.3 then 'PARTIAL' else 'CRITICAL' end as severity from scored)"""


def judged(spark, sf_dir) -> DataFrame:
    """I-41, I-42."""
    a = views.attempts(spark, sf_dir).withColumn("answer_score", M.answer_score(F.col("correct"), F.col("hop")))
    return a.withColumn("severity", M.severity(F.col("answer_score")))


@query("mcq_misconception", sql("""select attempt_id, answer_score, severity, prior_wrong::bigint as prior_wrong, (severity in ('PARTIAL', 'CRITICAL') and hop is null) or prior_wrong >= 2 as needs_llm from (select *, sum((not correct)::int) over (partition by user_id, concept_id order by created_at, attempt_id rows between unbounded preceding and 1 preceding) as pw, coalesce(sum((not correct)::int) over (partition by user_id, concept_id order by created_at, attempt_id rows between unbounded preceding and 1 preceding), 0) as prior_wrong from judged) where not correct""", "attempts", more=_SCORED))
def mcq_misconception(spark, sf_dir) -> DataFrame:
    """I-41 to I-43: wrong answers, how severe they are, and whether the explanation needs a model."""
    w = Window.partitionBy("user_id", "concept_id").orderBy("created_at", "attempt_id").rowsBetween(Window.unboundedPreceding, -1)
    a = judged(spark, sf_dir).withColumn("prior_wrong", F.coalesce(F.sum((~F.col("correct")).cast("long")).over(w), F.lit(0)))
    needs = (F.col("severity").isin("PARTIAL", "CRITICAL") & F.col("hop").isNull()) | (F.col("prior_wrong") >= 2)
    return a.where("not correct").select("attempt_id", "answer_score", "severity", "prior_wrong", needs.alias("needs_llm"))


@query("severity_distribution", sql("""select concept_id, sum((severity = 'CORRECT')::int)::bigint as n_correct, sum((severity = 'CLOSE')::int)::bigint as n_close, sum((severity = 'PARTIAL')::int)::bigint as n_partial, sum((severity = 'CRITICAL')::int)::bigint as n_critical from judged group by 1""", "attempts", more=_SCORED))
def severity_distribution(spark, sf_dir) -> DataFrame:
    """D-10."""
    return judged(spark, sf_dir).groupBy("concept_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("CORRECT", "CLOSE", "PARTIAL", "CRITICAL")])


@query("misconception_summary", sql(f"""select question_type || ':' || coalesce(hop::varchar, 'none') as label, count(*)::bigint as frequency, {r6('avg(answer_score)')} as avg_score from judged where not correct group by 1 order by frequency desc, label limit 20""", "attempts", more=_SCORED))
def misconception_summary(spark, sf_dir) -> DataFrame:
    """D-11."""
    label = F.concat_ws(":", "question_type", F.coalesce(F.col("hop").cast("string"), F.lit("none")))
    g = judged(spark, sf_dir).where("not correct").groupBy(label.alias("label")).agg(F.count("*").alias("frequency"), half_up(F.avg("answer_score")).alias("avg_score"))
    return g.orderBy(F.desc("frequency"), "label").limit(20)


@query("answer_report", sql(f"""select concept_id, count(*)::bigint as total, sum(correct::int)::bigint as n_correct, {r6('avg(answer_score)')} as avg_score, avg(answer_score) >= 0.85 as mastered from judged group by 1""", "attempts", more=_SCORED))
def answer_report(spark, sf_dir) -> DataFrame:
    """D-12, D-13."""
    return judged(spark, sf_dir).groupBy("concept_id").agg(F.count("*").alias("total"), F.count_if("correct").alias("n_correct"), half_up(F.avg("answer_score")).alias("avg_score"), (F.avg("answer_score") >= 0.85).alias("mastered"))


@query("history_groups", sql(f"""select user_id, concept_id, count(*)::bigint as tests, {r6('max(score)')} as best, sum((score >= 80)::int)::bigint as passes, max_by(session_id, (created_at, session_id)) as latest from sessions group by 1, 2""", "sessions"))
def history_groups(spark, sf_dir) -> DataFrame:
    """D-22, E-05."""
    return views.sessions(spark, sf_dir).groupBy("user_id", "concept_id").agg(F.count("*").alias("tests"), half_up(F.max("score")).alias("best"), F.count_if(F.col("score") >= M.PASS).alias("passes"), F.max_by("session_id", F.struct("created_at", "session_id")).alias("latest"))


@query("user_test_counts", sql("select user_id, count(*)::bigint as tests, count(distinct concept_id)::bigint as concepts from sessions group by 1", "sessions"))
def user_test_counts(spark, sf_dir) -> DataFrame:
    """D-02, D-03."""
    return views.sessions(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("tests"), F.countDistinct("concept_id").alias("concepts"))


@query("attempt_index", sql("select attempt_id, user_id, concept_id, n::int as attempt_index from attempts", "attempts"))
def attempt_index(spark, sf_dir) -> DataFrame:
    """E-01."""
    return views.attempts(spark, sf_dir).select("attempt_id", "user_id", "concept_id", F.col("n").alias("attempt_index"))


@query("convergence", sql("""select user_id, concept_id, coalesce(min(case when abs(score - before) < 2 then i end), count(*))::bigint as convergence, count(*)::bigint as sessions from (select *, row_number() over w - 1 as i, lag(score) over w as before from sessions window w as (partition by user_id, concept_id order by created_at, session_id)) group by 1, 2""", "sessions"))
def convergence(spark, sf_dir) -> DataFrame:
    return metrics.convergence(views.sessions(spark, sf_dir))


@query("trend_slope", sql(f"""select user_id, concept_id, {r6('case when count(*) < 2 then 0 else regr_slope(score, -back) end')} as slope, count(*)::bigint as points from (select *, row_number() over (partition by user_id, concept_id order by created_at desc, session_id desc)::double as back from sessions) where back <= 10 group by 1, 2""", "sessions"))
def trend_slope(spark, sf_dir) -> DataFrame:
    return metrics.slope(views.sessions(spark, sf_dir))


_GAIN = """based as (select *, coalesce(first_value(case when mode = 'diagnostic' then score end ignore nulls) over w, first_value(score) over w) as baseline from sessions window w as (partition by user_id, concept_id order by created_at, session_id rows between unbounded preceding and 1 preceding)),
gained as (select *, case when baseline is null then null when score > baseline then (score - baseline) / (100.0::double - baseline) when score < baseline then (score - baseline) / baseline else 0 end as nlg from based)"""


@query("baseline_nlg", sql(f"""select session_id, user_id, concept_id, mode, created_at, {r6('score')} as score, {r6('baseline')} as baseline, {r6('nlg')} as nlg from gained""", "sessions", more=_GAIN))
def baseline_nlg(spark, sf_dir) -> DataFrame:
    return metrics.baseline_gain(views.sessions(spark, sf_dir))


@query("nlg_sparkline", sql(f"""select user_id, string_agg({r6('nlg', 2)}::decimal(9,2)::varchar, ' ' order by created_at, session_id) as last_gains, count(*)::bigint as points from (select *, row_number() over (partition by user_id order by created_at desc, session_id desc) as back from gained where nlg is not null) where back <= 5 group by 1""", "sessions", more=_GAIN))
def nlg_sparkline(spark, sf_dir) -> DataFrame:
    """E-06: the newest five gains of a user, oldest first."""
    s = metrics.gains(views.sessions(spark, sf_dir)).where("nlg is not null")
    s = s.withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("session_id")))).where("back <= 5")
    top = F.sort_array(F.collect_list(F.struct("created_at", "session_id", half_up(F.col("nlg"), 2).cast("decimal(9,2)").cast("string").alias("g"))))
    return s.groupBy("user_id").agg(top.alias("top"), F.count("*").alias("points")).select("user_id", F.array_join("top.g", " ").alias("last_gains"), "points")


@query("stats_clamped_nlg", sql(f"""select user_id, {r6('avg(score)')} as avg_score, {r6('avg((score >= 80)::int::double)')} as pass_rate, {r6('avg(greatest(-1.0::double, least(1.0::double, nlg))) * 100')} as mean_nlg from gained group by 1""", "sessions", more=_GAIN))
def stats_clamped_nlg(spark, sf_dir) -> DataFrame:
    """D-21, D-04."""
    s = metrics.gains(views.sessions(spark, sf_dir))
    return s.groupBy("user_id").agg(half_up(F.avg("score")).alias("avg_score"), half_up(F.avg((F.col("score") >= M.PASS).cast("double"))).alias("pass_rate"), half_up(F.avg(M.clamp(F.col("nlg"), -1.0, 1.0)) * 100.0).alias("mean_nlg"))


@query("auc_roc", sql(f"""select user_id, n::bigint as n_attempts, {r6('coalesce(area::double / nullif(p * (n - p), 0), 0.5::double)', 4)} as auc, {r6('coalesce(shared / nullif(p * (n - p), 0), 0.5::double)', 4)} as auc_tied, n >= 10 as reported from (select user_id, count(*) as n, sum(y) as p, sum(case when y = 0 then tp else 0 end) as area, sum(case when y = 0 then tpl - same / 2.0::double else 0 end) as shared from (select user_id, y, sum(y) over (partition by user_id order by confidence desc, created_at, attempt_id rows between unbounded preceding and current row) as tp, sum(y) over (partition by user_id order by confidence desc range between unbounded preceding and current row) as tpl, sum(y) over (partition by user_id, confidence) as same from (select *, correct::int as y from attempts)) group by 1)""", "attempts"))
def auc_roc(spark, sf_dir) -> DataFrame:
    return metrics.auc(views.attempts(spark, sf_dir))


@query("difficulty_distribution", sql(f"""select session_id, {r6('e / (e + m + h)')} as easy, {r6('m / (e + m + h)')} as medium, {r6('h / (e + m + h)')} as hard from (select session_id, e, m, greatest(0.0::double, 1 - e - m) as h from (select session_id, greatest(0.0::double, 0.7::double - 0.006::double * score) as e, 0.3::double + 0.002::double * score as m from sessions))""", "sessions"))
def difficulty_distribution(spark, sf_dir) -> DataFrame:
    """I-23."""
    e, m, h = M.difficulty_shares(F.col("score"))
    return views.sessions(spark, sf_dir).select("session_id", half_up(e).alias("easy"), half_up(m).alias("medium"), half_up(h).alias("hard"))


@query("system_metrics", sql(f"""select count(distinct user_id)::bigint as students, {r6("avg((score > 75)::int::double)")} as mastery_share, {r6("count(*)::double / count(distinct user_id)")} as sessions_per_user, {r6("avg(case when mode = 'practice' then score end) - avg(case when mode = 'diagnostic' then score end)")} as practice_delta, {r6("avg(nlg)")} as mean_nlg from gained""", "sessions", more=_GAIN))
def system_metrics(spark, sf_dir) -> DataFrame:
    """D-09, I-37, Q-15."""
    s = metrics.gains(views.sessions(spark, sf_dir))
    of = lambda m: F.avg(F.when(F.col("mode") == m, F.col("score")))
    return s.agg(F.countDistinct("user_id").alias("students"), half_up(F.avg((F.col("score") > 75).cast("double"))).alias("mastery_share"), half_up(F.count("*") / F.countDistinct("user_id")).alias("sessions_per_user"), half_up(of("practice") - of("diagnostic")).alias("practice_delta"), half_up(F.avg("nlg")).alias("mean_nlg"))
