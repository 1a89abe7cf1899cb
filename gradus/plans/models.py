"""Queries of the learner models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions.formulas import half_up
from ..operators import folds, metrics
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


def _bkt(p: str, right: str) -> str:
    k, o = f"(case when {right} then {p} * 0.92::double else {p} * 0.08::double end)", f"(case when {right} then (1.0::double - {p}) * 0.25::double else (1.0::double - {p}) * 0.75::double end)"
    return f"greatest(0.0::double, least(1.0::double, ({k} / ({k} + {o})) + (1.0::double - ({k} / ({k} + {o}))) * 0.12::double))"


_TRACE = f"""trace as (select user_id, concept_id, attempt_id, n, correct, 0.25::double as before, {_bkt('0.25::double', 'correct')} as p, ln(greatest(1e-10::double, case when correct then 0.25::double * 0.92::double + 0.75::double * 0.25::double else 1 - (0.25::double * 0.92::double + 0.75::double * 0.25::double) end)) as ll from attempts where n = 1
  union all select a.user_id, a.concept_id, a.attempt_id, a.n, a.correct, t.p, {_bkt('t.p', 'a.correct')}, t.ll + ln(greatest(1e-10::double, case when a.correct then t.p * 0.92::double + (1 - t.p) * 0.25::double else 1 - (t.p * 0.92::double + (1 - t.p) * 0.25::double) end)) from trace t join attempts a on a.user_id = t.user_id and a.concept_id = t.concept_id and a.n = t.n + 1)"""


@query("bkt_trace", sql(f"select user_id, concept_id, attempt_id, {r6('p')} as p_known from trace", "attempts", more=_TRACE))
def bkt_trace(spark, sf_dir) -> DataFrame:
    return folds.bkt_trace(views.attempts(spark, sf_dir))


@query("bkt_final", sql(f"select user_id, concept_id, max(n)::bigint as n, {r6('max_by(p, n)')} as p_known, {r6('max_by(ll, n)')} as log_likelihood, floor(max_by(p, n) * 100 + 0.5::double)::bigint as mastery from trace group by 1, 2", "attempts", more=_TRACE))
def bkt_final(spark, sf_dir) -> DataFrame:
    return folds.bkt_final(views.attempts(spark, sf_dir))


_IRT = f"""items as (select *, row_number() over (partition by question_id order by created_at, attempt_id) as i, greatest(0.01::double, least(0.99::double, confidence)) as c from attempts),
steps as (select question_id, i, ln(c / (1 - c)) as theta, correct::int::double as y, case difficulty when 1 then -0.5::double when 2 then 0.0::double else 0.5::double end as b0, difficulty from items),
state as (select question_id, i, {r6('greatest(-3.0::double, least(3.0::double, b0 + 0.1::double / sqrt(1) * (1.0::double / (1.0::double + exp(-(theta - b0))) - y)))', 4)} as b, difficulty as label from steps where i = 1
  union all select s.question_id, x.i, {r6('greatest(-3.0::double, least(3.0::double, s.b + 0.1::double / sqrt(s.i + 1) * (1.0::double / (1.0::double + exp(-(x.theta - s.b))) - x.y)))', 4)}, s.label from state s join steps x on x.question_id = s.question_id and x.i = s.i + 1),
irt as (select question_id, max_by(b, i) as b, max(i) as response_count, max(label) as label, case when max_by(b, i) < -0.25 then 1 when max_by(b, i) > 0.25 then 3 else 2 end as level from state group by 1)"""


@query("irt_online", sql("select question_id, b, response_count::bigint as response_count, level, label from irt", "attempts", more=_IRT))
def irt_online(spark, sf_dir) -> DataFrame:
    return folds.irt_online(views.attempts(spark, sf_dir))


@query("irt_system", sql(f"""select count(*)::bigint as questions, sum((response_count >= 10)::int)::bigint as calibrated, sum((response_count < 5)::int)::bigint as uncalibrated, sum((level = 1)::int)::bigint as easy, sum((level = 2)::int)::bigint as medium, sum((level = 3)::int)::bigint as hard, {r6('avg(b)')} as avg_b,
  string_agg(case when up <= 5 then question_id end, ',' order by up) as most_answered, string_agg(case when down <= 5 then question_id end, ',' order by down) as least_answered
  from (select *, row_number() over (order by response_count desc, question_id) as up, row_number() over (order by response_count, question_id) as down from irt)""", "attempts", more=_IRT))  # fmt: skip
def irt_system(spark, sf_dir) -> DataFrame:
    """D-14, F-02: the first and last five come from top-k plans, not from a total order."""
    q = folds.irt_online(views.attempts(spark, sf_dir))
    level = lambda n: F.count_if(F.col("level") == n)
    s = q.agg(F.count("*").alias("questions"), F.count_if(F.col("response_count") >= 10).alias("calibrated"), F.count_if(F.col("response_count") < 5).alias("uncalibrated"), level(1).alias("easy"), level(2).alias("medium"), level(3).alias("hard"), half_up(F.avg("b")).alias("avg_b"))

    def five(order, name: str) -> DataFrame:
        sign = -1 if order == "desc" else 1
        top = q.select((F.col("response_count") * sign).alias("r"), "question_id").orderBy("r", "question_id").limit(5)
        return top.agg(F.array_join(F.sort_array(F.collect_list(F.struct("r", "question_id")))["question_id"], ",").alias(name))

    return s.crossJoin(five("desc", "most_answered")).crossJoin(five("asc", "least_answered"))  # one row each


@query("irt_concept", sql(f"""select concept_id, count(*)::bigint as questions, {r6('avg((response_count >= 10)::int::double)')} as calibrated_share, {r6('avg(b)')} as avg_b, {r6('avg((abs(b - case level when 1 then -0.5::double when 2 then 0.0::double else 0.5::double end) > 0.25)::int::double)')} as drifted_share from irt join (select distinct question_id, concept_id from attempts) using (question_id) group by 1""", "attempts", more=_IRT))
def irt_concept(spark, sf_dir) -> DataFrame:
    """D-15, C-04."""
    a = views.attempts(spark, sf_dir)
    q = folds.irt_online(a).join(a.select("question_id", "concept_id").distinct(), "question_id")
    drift = F.abs(F.col("b") - M.initial_difficulty(F.col("level"))) > 0.25
    return q.groupBy("concept_id").agg(F.count("*").alias("questions"), half_up(F.avg((F.col("response_count") >= 10).cast("double"))).alias("calibrated_share"), half_up(F.avg("b")).alias("avg_b"), half_up(F.avg(drift.cast("double"))).alias("drifted_share"))


def _fsrs(s: str, d: str, r: str) -> tuple[str, str]:
    up = f"{s} * (1.0::double + exp(0.9::double) * (11.0::double - {d}) * pow({s}, -0.2::double) * (exp(1.0::double - {r}) - 1.0::double))"
    return r6(f"case when a.correct then greatest(0.5::double, {up}) else greatest(0.5::double, {s} / 2) end", 3), r6(f"greatest(1.0::double, least(10.0::double, case when a.correct then {d} - 0.15::double else {d} + 0.3::double end))", 2)


_S0, _D0 = _fsrs("1.0::double", "5.0::double", "1.0::double")
_S1, _D1 = _fsrs("t.s", "t.d", "(case when epoch_us(a.created_at) <= t.at then 1.0::double else 1.0::double / (1.0::double + ((epoch_us(a.created_at) - t.at) / 8.64e10::double) / (9.0::double * t.s)) end)")
_FSRS = f"""t as (select user_id, concept_id, n, {_S0} as s, {_D0} as d, epoch_us(created_at) as at from attempts a where n = 1
  union all select a.user_id, a.concept_id, a.n, {_S1}, {_D1}, epoch_us(a.created_at) from t join attempts a on a.user_id = t.user_id and a.concept_id = t.concept_id and a.n = t.n + 1)"""


@query("fsrs_state", sql(f"select user_id, concept_id, s as stability, d as difficulty, {r6('9 * s * (1 / 0.9::double - 1)', 1)} as next_review_days from (select user_id, concept_id, max_by(s, n) as s, max_by(d, n) as d from t group by 1, 2)", "attempts", more=_FSRS))
def fsrs_state(spark, sf_dir) -> DataFrame:
    return folds.fsrs_state(views.attempts(spark, sf_dir))


# sessions fold: decay, then the answers, one recursion over attempts with the state of the session's start
_MASTERY = f"""per as (select user_id, concept_id, session_no, mode, max(created_at) as at, avg(correct::int::double) as mean from attempts group by all),
x as (select a.user_id, a.concept_id, a.n, a.correct, a.session_no, p.mode, p.mean, epoch_us(p.at) as at, epoch_us(q.at) as before, row_number() over (partition by a.user_id, a.concept_id, a.session_no order by a.n) = 1 as head, row_number() over (partition by a.user_id, a.concept_id, a.session_no order by a.n desc) = 1 as tail
  from attempts a join per p using (user_id, concept_id, session_no) left join per q on q.user_id = a.user_id and q.concept_id = a.concept_id and q.session_no = a.session_no - 1),
m as (select user_id, concept_id, n, case when tail then floor(mean * 100 + 0.5::double) else 0.0::double end as mastery, {_bkt('0.0::double', 'correct')} as p, case when tail and mean * 100 >= 80 then 'practice' else 'diagnostic' end as stage from x where n = 1
  union all select x.user_id, x.concept_id, x.n,
    case when x.tail then case when x.mode = 'diagnostic' then floor(x.mean * 100 + 0.5::double) else floor({_bkt("(case when x.head then case when x.at <= x.before then m.mastery else floor(m.mastery * exp(-0.05::double * ((x.at - x.before) / 3.6e9::double) / 24) * 100 + 0.5::double) / 100 end / 100 else m.p end)", "x.correct")} * 100 + 0.5::double) end else m.mastery end,
    {_bkt("(case when x.head then case when x.at <= x.before then m.mastery else floor(m.mastery * exp(-0.05::double * ((x.at - x.before) / 3.6e9::double) / 24) * 100 + 0.5::double) / 100 end / 100 else m.p end)", "x.correct")},
    case when x.tail and x.mean * 100 >= 80 and list_position(['diagnostic', 'practice', 'mastery'], x.mode) <= coalesce(list_position(['diagnostic', 'practice', 'mastery'], m.stage), 0) + 1 then ['practice', 'mastery', 'complete'][list_position(['diagnostic', 'practice', 'mastery'], x.mode)] else m.stage end
    from m join x on x.user_id = m.user_id and x.concept_id = m.concept_id and x.n = m.n + 1),
mastery as (select user_id, concept_id, max_by(mastery, n) as mastery, max_by(stage, n) as stage from m group by 1, 2),
last as (select user_id, concept_id, count(*) as sessions, max_by(per.at, session_no) as last_updated from per group by 1, 2)"""


@query("mastery_fold", sql("select user_id, concept_id, sessions::bigint as sessions, mastery, stage, last_updated from mastery join last using (user_id, concept_id)", "attempts", more=_MASTERY))
def mastery_fold(spark, sf_dir) -> DataFrame:
    return folds.mastery_fold(views.attempts(spark, sf_dir))


_DECAY = f"""now as (select *, epoch_us(timestamp '{M.AS_OF}') - epoch_us(last_updated) as age from mastery join last using (user_id, concept_id)),
decay as (select *, case when age <= 0 then mastery else {r6("mastery * exp(-0.05::double * (age / 3.6e9::double) / 24)", 2)} end as now_mastery from now),
due as (select *, case when mastery <= 70 then 0.0::double else -ln(70.0::double / mastery) / 0.05::double end as review_days, case when now_mastery >= mastery * 0.9::double then 0.0::double when now_mastery <= 70 then 1.0::double when mastery - 70 <= 0 then 1.0::double else least(1.0::double, (mastery - now_mastery) / (mastery - 70)) end as urgency from decay)"""


def review_table(spark, sf_dir) -> DataFrame:
    m = folds.mastery_fold(views.attempts(spark, sf_dir))
    hours = M.hours_between(F.lit(M.AS_OF).cast("timestamp_ntz"), F.col("last_updated"))
    now = M.decayed(F.col("mastery"), hours)
    return m.withColumn("hours", hours).withColumn("now_mastery", now).withColumn("review_days", M.review_days(F.col("mastery"))).withColumn("urgency", M.review_urgency(F.col("mastery"), F.col("now_mastery")))


@query("decay_review", sql(f"select user_id, concept_id, mastery, now_mastery, now_mastery < 70 as needs_review, {r6('review_days')} as review_days, {r6('urgency')} as urgency, age / 3.6e9::double >= review_days * 24 as due, case when mastery >= 85 then 'mastered' when mastery >= 70 then 'unlocked' else 'locked' end as status from due", "attempts", more=_MASTERY + ",\n" + _DECAY))
def decay_review(spark, sf_dir) -> DataFrame:
    """I-11 to I-14, H-19, H-23."""
    status = F.when(F.col("mastery") >= M.MASTERED, "mastered").when(F.col("mastery") >= M.REVIEW, "unlocked").otherwise("locked")
    return review_table(spark, sf_dir).select("user_id", "concept_id", "mastery", "now_mastery", (F.col("now_mastery") < M.REVIEW).alias("needs_review"), half_up(F.col("review_days")).alias("review_days"), half_up(F.col("urgency")).alias("urgency"), (F.col("hours") >= F.col("review_days") * 24).alias("due"), status.alias("status"))


@query("review_queue", sql(f"select user_id, concept_id, {r6('urgency')} as urgency, now_mastery from due where now_mastery < 70 or age / 3.6e9::double >= review_days * 24 order by {r6('urgency')} desc, user_id, concept_id limit 50", "attempts", more=_MASTERY + ",\n" + _DECAY))
def review_queue(spark, sf_dir) -> DataFrame:
    """F-03, F-04: the fifty most urgent reviews."""
    r = review_table(spark, sf_dir).where((F.col("now_mastery") < M.REVIEW) | (F.col("hours") >= F.col("review_days") * 24))
    return r.select("user_id", "concept_id", half_up(F.col("urgency")).alias("urgency"), "now_mastery").orderBy(F.desc("urgency"), "user_id", "concept_id").limit(50)


@query("sai", sql(f"""select user_id, {r6('m')} as mastery_part, {r6('greatest(0.0::double, least(100.0::double, 50 + 10 * slope))')} as trend_part, {r6('acc * 100')} as accuracy_part, {r6('cal * 100')} as calibration_part, floor(0.5::double * m + 0.2::double * greatest(0.0::double, least(100.0::double, 50 + 10 * slope)) + 0.2::double * acc * 100 + 0.1::double * cal * 100 + 0.5::double)::bigint as sai from
  (select user_id, avg(mastery) as m from mastery group by 1) join (select user_id, avg(correct::int::double) as acc, avg(1 - abs(correct::int::double - case when confidence = 0 then 0.5::double else confidence end)) as cal from attempts group by 1) using (user_id)
  join (select user_id, case when count(*) < 2 then 0 else regr_slope(score, -back) end as slope from (select *, row_number() over (partition by user_id order by created_at desc, session_id desc)::double as back from sessions) where back <= 10 group by 1) using (user_id)""", "attempts", "sessions", more=_MASTERY))
def sai(spark, sf_dir) -> DataFrame:
    """I-22: the student ability index and its four parts."""
    a = views.attempts(spark, sf_dir)
    y, c = F.col("correct").cast("double"), F.when(F.col("confidence") == 0, 0.5).otherwise(F.col("confidence"))
    m = folds.mastery_fold(a).groupBy("user_id").agg(F.avg("mastery").alias("m"))
    r = a.groupBy("user_id").agg(F.avg(y).alias("acc"), M.exact_mean(1 - F.abs(y - c)).alias("cal"))
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("session_id"))
    s = views.sessions(spark, sf_dir).withColumn("back", F.row_number().over(w)).where("back <= 10").groupBy("user_id").agg(F.coalesce(F.regr_slope("score", -F.col("back").cast("double")), F.lit(0.0)).alias("slope"))
    trend = M.clamp(50 + 10 * F.col("slope"), 0.0, 100.0)
    j = m.join(r, "user_id").join(s, "user_id")
    return j.select("user_id", half_up(F.col("m")).alias("mastery_part"), half_up(trend).alias("trend_part"), half_up(F.col("acc") * 100).alias("accuracy_part"), half_up(F.col("cal") * 100).alias("calibration_part"), F.floor(0.5 * F.col("m") + 0.2 * trend + 0.2 * F.col("acc") * 100 + 0.1 * F.col("cal") * 100 + 0.5).alias("sai"))


@query("bkt_fit")
def bkt_fit(spark, sf_dir) -> DataFrame:
    """I-05, C-14. I-06; compared with a plain search of the grid in the tests."""
    return folds.bkt_fit(views.attempts(spark, sf_dir))


# Least and greatest number of questions of a mode.
QUESTION_LIMITS = {"diagnostic": (5, 5), "practice": (5, 7), "mastery": (5, 8)}
_U = "('0x' || substr(md5(session_id || '|' || i || '|{k}'), 1, 8))::bigint / 4294967296.0::double"


@query("question_plan", sql(f"""select session_id, i::int as i, ['recall', 'conceptual', 'application', 'reasoning', 'analytical'][i % 5 + 1] as type, (case when mode = 'diagnostic' then case when i < n / 3.0::double then 1 when i < n * 2 / 3.0::double then 2 else 3 end else case when d = 1 and mode = 'mastery' and {_U.format(k=1)} > 0.4 then 2 else d end end)::int as difficulty from
  (select *, case when u < e / (e + m + h) then 1 when u < (e + m) / (e + m + h) then 2 else 3 end as d from (select *, {_U.format(k=0)} as u, greatest(0.0::double, 0.7::double - 0.006::double * s) as e, 0.3::double + 0.002::double * s as m, greatest(0.0::double, 1.0::double - greatest(0.0::double, 0.7::double - 0.006::double * s) - (0.3::double + 0.002::double * s)) as h from
  (select session_id, mode, s, n, unnest(range(n)) as i from (select session_id, mode, 100.0::double * avg(correct::int::double) as s, greatest(5, least(2 * count(distinct cognitive_level), case mode when 'diagnostic' then 5 when 'practice' then 7 else 8 end)) as n from attempts group by 1, 2))))""", "attempts"))  # fmt: skip
def question_plan(spark, sf_dir) -> DataFrame:
    """I-44, F-09: twice as many questions as the context, a JSON array, has concepts (here the session's cognitive levels), within the limits of the mode; types in turn;
    diagnostic difficulties in thirds, others drawn from the distribution at the learner's mastery with a seeded uniform number."""
    s = views.attempts(spark, sf_dir).groupBy("session_id", "mode").agg((100.0 * F.avg(F.col("correct").cast("double"))).alias("s"), F.to_json(F.collect_set("cognitive_level")).alias("context"))
    concepts = F.greatest(F.lit(1), F.coalesce(F.size(F.from_json("context", "array<string>")), F.lit(1)))
    low, high = (M.case_map(F.col("mode"), {m: v[i] for m, v in QUESTION_LIMITS.items()}, (5, 10)[i]) for i in (0, 1))
    s = s.withColumn("n", F.greatest(low, F.least(2 * concepts, high)))
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    u = lambda k: F.conv(F.substr(F.md5(F.concat_ws("|", "session_id", "i", F.lit(k))), F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296.0
    easy, medium, _ = M.difficulty_shares(F.col("s"))
    drawn = F.when(u(0) < easy, 1).when(u(0) < easy + medium, 2).otherwise(3)
    drawn = F.when((F.col("mode") == "mastery") & (drawn == 1) & (u(1) > 0.4), 2).otherwise(drawn)
    thirds = F.when(F.col("i") < F.col("n") / 3, 1).when(F.col("i") < F.col("n") * 2 / 3, 2).otherwise(3)
    return s.select("session_id", "i", F.element_at(F.lit(M.TYPES), F.col("i") % 5 + 1).alias("type"), F.when(F.col("mode") == "diagnostic", thirds).otherwise(drawn).alias("difficulty"))


@query("session_evaluation")
def session_evaluation(spark, sf_dir) -> DataFrame:
    """I-39, I-47: every session evaluated as it is submitted. Spaced rows are left out (unless there are no others); the score decides passing and the
    recommended path; mastery before (decayed) and after, and the next stage, come from the fold over the learner's sessions; the gain is against the first diagnostic
    score (none yet: 0); metrics are those of the session. Compared with a plain fold in the tests."""
    a = views.attempts(spark, sf_dir)
    h = folds.mastery_steps(a, ~F.col("is_spaced")).select("user_id", "concept_id", F.explode(F.arrays_zip("steps", "states")).alias("z"))
    h = h.select("user_id", "concept_id", F.col("z.steps.session_no").alias("session_no"), F.col("z.steps.mode").alias("mode"), F.col("z.steps.at").alias("created_at"), (F.col("z.steps.mean") * 100.0).alias("score"), F.col("z.states.before").alias("pre_mastery"), F.col("z.states.mastery").alias("post_mastery"), F.col("z.states.stage").alias("next_stage"))
    w = Window.partitionBy("user_id", "concept_id").orderBy("session_no").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.first(F.when(F.col("mode") == "diagnostic", F.col("score")), ignorenulls=True).over(w), F.first("score").over(w))
    h = h.withColumn("baseline", base).withColumn("nlg", M.learning_gain(F.coalesce("baseline", "post_mastery"), F.col("post_mastery")))
    h = h.withColumn("session_id", F.concat_ws("-", "user_id", "concept_id", "session_no"))
    m = metrics.session_metrics(a).select("session_id", "fas", "wbs", "ccms", "mss", "lip", "rci_avg", "calibration_error", "brier_score", "ece", "log_loss")
    passed = F.col("score") >= M.PASS
    return h.join(m, "session_id").select(*m.columns, "mode", F.floor(F.col("score") + 0.5).alias("score"), passed.alias("passed"), F.when(passed, "test_it").otherwise("learn_it").alias("path"), "pre_mastery", "post_mastery", "next_stage", half_up(F.col("nlg"), 4).alias("nlg"))


@query("spaced_update", sql(f"""select session_id, target, n::bigint as n, {r6('p')} as p_known, floor(p * 100 + 0.5::double)::bigint as mastery from (select session_id, target, max(k) as n, max_by(p, k) as p from s group by 1, 2)""", "attempts", more=f"""o as (select *, (concept_id + 1) % 5 as target, row_number() over (partition by session_id order by created_at, attempt_id) as k from attempts where is_spaced),
s as (select session_id, target, k, {_bkt('0.5::double', 'correct')} as p from o where k = 1 union all select o.session_id, o.target, o.k, {_bkt('s.p', 'o.correct')} from s join o on o.session_id = s.session_id and o.k = s.k + 1)"""))
def spaced_update(spark, sf_dir) -> DataFrame:
    """I-40, I-03: spaced answers strengthen or weaken an older concept (here the next one, known at 50 %), whatever the session's mode."""
    a = views.attempts(spark, sf_dir).where("is_spaced").withColumn("target", (F.col("concept_id") + 1) % 5)
    h = folds.history(a, ["session_id", "target"], ["created_at", "attempt_id"], ["correct"])
    p = F.aggregate("steps", F.lit(0.5), lambda q, x: M.bkt_step(q, x["correct"]))
    return h.select("session_id", "target", F.size("steps").cast("long").alias("n"), half_up(p).alias("p_known"), F.floor(p * 100 + 0.5).alias("mastery"))


@query("attempt_defaults", sql("select question_type, cognitive_level::int as cognitive_level, difficulty::int as difficulty, count(*)::bigint as n, sum(time_taken)::bigint as seconds, sum(confidence) as confidence from (select coalesce(case when attempt_id % 5 <> 0 then question_type end, 'recall') as question_type, coalesce(case when attempt_id % 7 <> 0 then cognitive_level end, 1) as cognitive_level, coalesce(case when attempt_id % 3 <> 0 then difficulty end, 1) as difficulty, coalesce(case when attempt_id % 2 <> 0 then time_taken end, 0) as time_taken, coalesce(case when attempt_id % 4 <> 0 then confidence end, 0.5::double) as confidence from attempts) group by 1, 2, 3".replace("sum(confidence) as", r6("sum(confidence)", 4) + " as"), "attempts"))
def attempt_defaults(spark, sf_dir) -> DataFrame:
    """B-06: what stands for missing values; here some of each column are missing."""
    gone = lambda c, k: F.when(F.col("attempt_id") % k != 0, F.col(c))
    a = views.attempts(spark, sf_dir)
    a = a.select(F.coalesce(gone("question_type", 5), F.lit("recall")).alias("question_type"), F.coalesce(gone("cognitive_level", 7), F.lit(1)).alias("cognitive_level"), F.coalesce(gone("difficulty", 3), F.lit(1)).alias("difficulty"), F.coalesce(gone("time_taken", 2), F.lit(0)).alias("t"), F.coalesce(gone("confidence", 4), F.lit(0.5)).alias("c"))
    return a.groupBy("question_type", "cognitive_level", "difficulty").agg(F.count("*").alias("n"), F.sum("t").alias("seconds"), half_up(F.sum("c"), 4).alias("confidence"))


@query("spaced_candidates", sql(f"""select user_id, concept_id, peer, urgency from (select a.user_id, a.concept_id, b.concept_id as peer, {r6('b.urgency')} as urgency, row_number() over (partition by a.user_id, a.concept_id order by {r6('b.urgency')} desc, b.concept_id) as r from due a join due b on a.user_id = b.user_id and a.concept_id % 2 = b.concept_id % 2 and a.concept_id <> b.concept_id where b.now_mastery < 70) where r <= 2""", "attempts", more=_MASTERY + ",\n" + _DECAY))
def spaced_candidates(spark, sf_dir) -> DataFrame:
    """I-45, C-16: a learner's other concepts of the same source document that need review, two at most."""
    r = review_table(spark, sf_dir).select("user_id", "concept_id", (F.col("concept_id") % 2).alias("source"), "now_mastery", half_up(F.col("urgency")).alias("urgency"))
    peer = r.where(F.col("now_mastery") < M.REVIEW).select("user_id", "source", F.col("concept_id").alias("peer"), "urgency")
    j = r.select("user_id", "source", "concept_id").join(peer, ["user_id", "source"]).where("concept_id <> peer")
    w = Window.partitionBy("user_id", "concept_id").orderBy(F.desc("urgency"), "peer")
    return j.withColumn("r", F.row_number().over(w)).where("r <= 2").select("user_id", "concept_id", "peer", "urgency")
