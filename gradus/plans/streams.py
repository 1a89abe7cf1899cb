"""Streaming queries, compared with the SQL of their batch equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import half_up
from ..sources import views
from ..streaming import learner, state
from .learner import SQL as _LEARNER
from .models import _FSRS, _IRT, _TRACE, _bkt
from .views_sql import r6, sql


def stream_irt(spark, sf_dir) -> DataFrame:
    return state.irt_state(state.event_stream(spark, sf_dir))


def stream_mastery(spark, sf_dir) -> DataFrame:
    s = state.bkt_state(state.event_stream(spark, sf_dir))
    return s.select("user_id", "concept_id", half_up(F.col("p")).alias("p_known"), "n")


def stream_windows(spark, sf_dir) -> DataFrame:
    w = state.activity_windows(state.event_stream(spark, sf_dir))
    return w.select(F.unix_seconds("start").alias("start"), "event_type", "n", half_up(F.col("total"), 4).alias("total"))


def stream_fsrs(spark, sf_dir) -> DataFrame:
    """N-03."""
    return state.fsrs_state(state.event_stream(spark, sf_dir))


def stream_hits(spark, sf_dir) -> DataFrame:
    """N-05: every answer looks up the guide of its learner, concept and level; guides exist where a learner was wrong at that level."""
    keys = ["user_id", "concept_id", "difficulty"]
    hits = state.cache_hits(state.answers(state.event_stream(spark, sf_dir)), views.attempts(spark, sf_dir).where("not correct"), keys)
    return hits.select(*keys, "hit_count", F.unix_micros("last_hit_at").alias("last_hit_at"))


def stream_sessions(spark, sf_dir) -> DataFrame:
    """N-01: every session as `session_evaluation` has it, evaluated by a stateful processor."""
    return learner.session_evaluations(state.event_stream(spark, sf_dir)).drop("closed")


def stream_exposures(spark, sf_dir) -> DataFrame:
    """N-04: a question counts as seen by a learner for 72 hours."""
    return learner.renewals(state.event_stream(spark, sf_dir), ["user_id", "question_id"], "72 hours")


def stream_refits(spark, sf_dir) -> DataFrame:
    """N-04: a concept's parameters are fitted anew with the first answer after 24 hours."""
    return learner.renewals(state.event_stream(spark, sf_dir), ["concept_id"], "24 hours")


def stream_sliding(spark, sf_dir) -> DataFrame:
    """N-07: windows of two hours that begin every half hour."""
    w = state.activity_windows(state.event_stream(spark, sf_dir), "2 hours", slide="30 minutes")
    return w.select(F.unix_seconds("start").alias("start"), "event_type", "n", half_up(F.col("total"), 4).alias("total"))


def stream_visits(spark, sf_dir) -> DataFrame:
    """N-07: visits with a gap of six hours, of those that have ended by the watermark."""
    w, _ = state.activity_sessions(state.event_stream(spark, sf_dir))
    return w.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", half_up(F.col("total"), 4).alias("total"))


_KNOWN = "list_reduce(list_concat([{before} / 100], list_transform(coalesce(x.answers, []), lambda a: case when a then 1.0::double else 0.0::double end)), lambda p, a: " + _bkt("p", "a = 1") + ")"
_PASSED = "list_position(['diagnostic', 'practice', 'mastery'], x.mode) <= coalesce(list_position(['diagnostic', 'practice', 'mastery'], {stage}), 0) + 1"


def _session(before: str, stage: str) -> str:
    post = f"case when x.mode = 'diagnostic' then floor(x.mean * 100 + 0.5::double) else floor({_KNOWN.format(before=before)} * 100 + 0.5::double) end"
    return f"x.*, {before} as pre, {post} as post, case when x.mean * 100 >= 80 and {_PASSED.format(stage=stage)} then ['practice', 'mastery', 'complete'][list_position(['diagnostic', 'practice', 'mastery'], x.mode)] else {stage} end as stage"


_BEFORE = "case when x.at <= s.at then s.post else floor(s.post * exp(-0.05::double * ((x.at - s.at) / 3.6e9::double) / 24) * 100 + 0.5::double) / 100 end"
#: Sessions folded one after another: pre, post, stage and base, the score that gains are counted from.
FOLDED = f"""per as (select user_id, concept_id, session_no, session_id, mode, count(*) as answered, epoch_us(max(created_at)) as at, coalesce(avg(case when not is_spaced then correct::int::double end), avg(correct::int::double)) as mean, list(correct order by n) filter (not is_spaced) as answers from attempts group by all),
steps as (select {_session('0.0::double', "'diagnostic'")} from per x where session_no = 0 union all select {_session(_BEFORE, 's.stage')} from steps s join per x on x.user_id = s.user_id and x.concept_id = s.concept_id and x.session_no = s.session_no + 1),
folded as (select *, coalesce(first_value(mean * 100) over (partition by user_id, concept_id order by session_no rows between unbounded preceding and 1 preceding), post) as base from steps)"""
FOLDED_COLUMNS = "mode, floor(mean * 100 + 0.5::double)::bigint as score, mean * 100 >= 80 as passed, case when mean * 100 >= 80 then 'test_it' else 'learn_it' end as path, pre as pre_mastery, post as post_mastery, stage as next_stage, " + r6("case when post > base then (post - base) / (100 - base) when post < base then (post - base) / base else 0.0::double end", 4) + " as nlg"


def _renewed_sql(keys: str, hours: int) -> str:
    on = " and ".join(f"l.{k} = r.{k}" for k in keys.split(", "))
    more = f"""l as (select {keys}, epoch_us(created_at) as us from attempts), r as (select {keys}, min(us) as us from l group by {keys} union all select {', '.join('r.' + k for k in keys.split(', '))}, min(l.us) from r join l on {on} and l.us >= r.us + {hours * 3_600_000_000} group by {', '.join('r.' + k for k in keys.split(', '))})"""
    return sql(f"select {keys}, renewals::bigint as renewals, n - renewals as hits, renewed_at from (select {keys}, count(*) as renewals, max(us) as renewed_at from r group by {keys}) join (select {keys}, count(*)::bigint as n from l group by {keys}) using ({keys})", "attempts", more=more)


_VISITS = """e as (select *, epoch_us(ts) as us from events), cut as (select *, case when us - lag(us) over w < 21600000000 then 0 else 1 end as first from e window w as (partition by user_id order by us, event_id)),
visits as (select *, sum(first) over (partition by user_id order by us, event_id rows unbounded preceding) as visit from cut)"""


QUERIES = {"stream_irt": stream_irt, "stream_mastery": stream_mastery, "stream_windows": stream_windows, "stream_fsrs": stream_fsrs, "stream_hits": stream_hits, "stream_sessions": stream_sessions, "stream_exposures": stream_exposures, "stream_refits": stream_refits, "stream_sliding": stream_sliding, "stream_visits": stream_visits}
SQL = {
    "stream_irt": sql("select question_id, b, response_count::bigint as response_count from irt", "attempts", more=_IRT),
    "stream_mastery": sql(f"select user_id, concept_id, {r6('max_by(p, n)')} as p_known, max(n)::bigint as n from trace group by 1, 2", "attempts", more=_TRACE),
    "stream_windows": sql(f"select (epoch(ts)::bigint // 3600) * 3600 as start, event_type, count(*)::bigint as n, {r6('sum(value)', 4)} as total from events group by 1, 2").replace("epoch(ts)::bigint", "floor(epoch(ts))::bigint"),
    "stream_fsrs": sql("select user_id, concept_id, max_by(s, n) as stability, max_by(d, n) as difficulty, max(n)::bigint as reviews from t group by 1, 2", "attempts", more=_FSRS),
    "stream_hits": sql("select user_id, concept_id, difficulty, count(*)::bigint as hit_count, epoch_us(max(created_at)) as last_hit_at from attempts where (user_id, concept_id, difficulty) in (select user_id, concept_id, difficulty from attempts where not correct) group by 1, 2, 3", "attempts"),
    "stream_sessions": sql(f"select session_id, answered::int as answers, {FOLDED_COLUMNS} from folded", "attempts", more=FOLDED),
    "stream_exposures": _renewed_sql("user_id, question_id", 72),
    "stream_refits": _renewed_sql("concept_id", 24),
    "stream_sliding": sql(f"select us - 1800 * back as start, event_type, count(*)::bigint as n, {r6('sum(value)', 4)} as total from (select event_type, value, (floor(epoch(ts))::bigint // 1800) * 1800 as us, unnest(range(4)) as back from events) group by 1, 2"),
    "stream_visits": sql(f"select user_id, min(us) as start, max(us) + 21600000000 as end, count(*)::bigint as n, {r6('sum(value)', 4)} as total from visits group by user_id, visit having max(us) + 21600000000 <= (select max(us) from e) // 1000 * 1000 - 7200000000", more=_VISITS),
}
_MEASURES = "fas, wbs, ccms, mss, lip, rci_avg, calibration_error, brier_score, ece, log_loss"
SQL["session_evaluation"] = sql(f"select session_id, {_MEASURES}, {FOLDED_COLUMNS} from folded join (select session_id, {_MEASURES} from ({_LEARNER['session_metrics']})) using (session_id)", "attempts", more=FOLDED)
