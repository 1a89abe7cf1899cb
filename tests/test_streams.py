"""Streams carry their state from one micro-batch to the next."""

import time

import pytest
from gradus.streaming import learner, state
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def batches(spark, sf, tmp_path_factory):
    """The events in order of time, as three files that are read one at a time."""
    at = str(tmp_path_factory.mktemp("batches"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    one, two = events.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.3, 0.6])).first()[0]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    for part in (us <= one, (us > one) & (us <= two), us > two):
        events.where(part).coalesce(1).write.mode("append").parquet(at)
    return lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(at)


@pytest.mark.parametrize("fold", [state.irt_state, state.bkt_state, state.fsrs_state])
def test_state_is_carried(spark, sf, batches, fold):
    whole, parts = fold(state.event_stream(spark, sf)), fold(batches())
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_hits_are_carried_and_need_an_entry(spark, sf, batches):
    entries = spark.createDataFrame([(0,), (3,), (3,), (99,)], "concept_id int")
    got = state.cache_hits(state.answers(batches()), entries, ["concept_id"])
    all_ = state.answers(spark.read.parquet(f"{sf}/events.parquet")).where("concept_id in (0, 3)").groupBy("concept_id").agg(F.count("*").alias("hit_count"), F.max("created_at").alias("last_hit_at"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, all_.collect()))


@pytest.fixture(scope="module")
def parted(spark, sf, tmp_path_factory):
    """A function that gives the events in order of time as `n` files that are read one at a time."""
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 5")
    us = F.unix_micros(F.col("ts").cast("timestamp"))

    def split(n):
        at = str(tmp_path_factory.mktemp("parted"))
        cuts = [None, *events.select(F.percentile_approx(us, [k / n for k in range(1, n)])).first()[0], None] if n > 1 else [None, None]
        for a, b in zip(cuts, cuts[1:], strict=False):
            events.where((us > a if a is not None else F.lit(True)) & (us <= b if b is not None else F.lit(True))).coalesce(1).write.mode("append").parquet(at)
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(at)

    return split


def test_sessions_equal_the_batch_after_any_split(spark, sf, parted):
    from gradus.plans import models

    columns = ["session_id", "mode", "score", "passed", "path", "pre_mastery", "post_mastery", "next_stage", "nlg"]
    batch = models.session_evaluation(spark, sf).where("cast(split(session_id, '-')[0] as int) < 5").select(*columns)
    want = sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in batch.collect())
    for n in (1, 4):
        got = learner.session_evaluations(parted(n)).select(*columns)
        assert sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in got.collect()) == want


def events_of(spark, rows):
    """rows: (event_id, 'day hour:minute', user_id, k); values under 60 are right answers."""
    df = spark.createDataFrame([(i, t, u, 10.0, f'{{"k": {k}}}') for i, t, u, k in rows], "event_id long, t string, user_id long, value double, props string")
    return df.select("event_id", F.concat(F.lit("2024-01-"), "t").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", "props")


def test_a_timer_closes_the_session_of_an_idle_learner(spark, tmp_path):
    at, work = str(tmp_path / "in"), str(tmp_path / "work")
    first = [(i, f"01 0{i}:00:00", 1, 0) for i in range(7)]
    later = [(20, "05 00:00:00", 2, 0), (21, "06 00:00:00", 2, 0)]  # moves the watermark by days
    stream = lambda: spark.readStream.schema(events_of(spark, first).schema).parquet(at)
    state_of = lambda: {r.session_id: (r.answers, r.closed) for r in learner.session_evaluations(stream(), at=work).collect()}
    events_of(spark, first).coalesce(1).write.mode("append").parquet(at)
    assert state_of() == {"1-0-0": (5, True), "1-0-1": (2, False)}
    events_of(spark, later).coalesce(1).write.mode("append").parquet(at)
    assert state_of() == {"1-0-0": (5, True), "1-0-1": (2, True), "2-0-0": (2, False)}
    events_of(spark, [(30, "06 01:00:00", 1, 0)]).coalesce(1).write.mode("append").parquet(at)
    assert state_of()["1-0-1"] == (3, False)


def test_entries_expire(spark, tmp_path):
    """Fresh by the lookups' times, an entry is found in the next micro-batch; the store drops it once its time is over by the clock."""
    for ttl, wait, renewed in (("3 seconds", 4, 2), ("1 hour", 0, 1)):
        at, work = (str(tmp_path / f"{x}{wait}") for x in ("in", "work"))
        for i, when in enumerate(("01 00:00:00", "01 00:00:01")):
            events_of(spark, [(i, when, 1, 0)]).coalesce(1).write.mode("append").parquet(at)
            found = learner.renewals(spark.readStream.schema(events_of(spark, []).schema).parquet(at), ["user_id"], ttl, work).first()
            time.sleep(wait)
        assert (found.renewals, found.hits) == (renewed, 2 - renewed)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    at, work = str(tmp_path / "in"), str(tmp_path / "work")
    stream = lambda: spark.readStream.schema(events_of(spark, []).schema).parquet(at)
    batches = [[(1, "01 00:00:00", 1, 0), (2, "01 05:00:00", 1, 0), (3, "03 00:00:00", 2, 0)], [(4, "01 06:00:00", 1, 0), (5, "02 23:00:00", 2, 0), (6, "09 00:00:00", 3, 0)]]
    dropped = []
    for rows in batches:
        events_of(spark, rows).coalesce(1).write.mode("append").parquet(at)
        out, late = state.activity_sessions(stream(), at=work)
        dropped.append(late)
    assert dropped == [0, 1]  # the answer of 06:00 comes two days late, that of 23:00 within the two hours
    assert sorted((r.user_id, r.start.day, r.n) for r in out.collect()) == [(1, 1, 2), (2, 2, 2)]


def test_renewals_are_carried(spark, sf, parted):
    one, four = (learner.renewals(parted(n), ["user_id"], "24 hours") for n in (1, 4))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, four.collect()))
