"""Learner state by stateful processors: sessions that are evaluated as answers come in (N-01), and entries that stay fresh for a while (N-04).

A key's state is small and bounded: the learner's mastery and the answers of the open session; an entry's time and two counters. Rows of a
key are sorted inside a micro-batch; micro-batches are expected in order of time."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import formulas as M
from .state import answers, folded, latest

SESSION_ANSWERS, IDLE = 5, "24 hours"
HOUR_MS = 3_600_000


class Answer(NamedTuple):
    attempt_id: int
    at: int
    correct: bool
    spaced: bool


class Learner(NamedTuple):
    """After the sessions that are complete: mastery, stage, time of the last answer, score of the first session, their number."""

    mastery: float = 0.0
    stage: str = M.STAGES[0]
    at: int | None = None
    baseline: float | None = None
    sessions: int = 0


def known_after(p: float, right: bool) -> float:
    t, s, g = M.BKT["t"], M.BKT["s"], M.BKT["g"]
    known, other = (p * (1 - s), (1 - p) * g) if right else (p * s, (1 - p) * (1 - g))
    post = known / (known + other) if known + other > 0 else p
    return max(0.0, min(1.0, post + (1 - post) * t))


def evaluated(learner: Learner, session: list[Answer]) -> tuple[dict, Learner]:
    """The session's evaluation and the learner after it. Spaced answers are left out, of the score unless there are no others."""
    mode = M.STAGES[min(learner.sessions, len(M.STAGES) - 1)]
    own = [a for a in session if not a.spaced]
    score = 100.0 * (sum(a.correct for a in own or session) / len(own or session))
    at = max(a.at for a in session)
    hours = 0.0 if learner.at is None else (at - learner.at) / 3.6e9
    before = learner.mastery if hours <= 0 else math.floor(learner.mastery * math.exp(-M.GAMMA_DAY * hours / 24) * 100 + 0.5) / 100
    p = before / 100
    for a in own:
        p = known_after(p, a.correct)
    after = float(math.floor((score if mode == M.STAGES[0] else 100 * p) + 0.5))
    passed, stage = score >= M.PASS, learner.stage
    reached = M.STAGES.index(stage) if stage in M.STAGES else -1
    if passed and M.STAGES.index(mode) <= reached + 1:
        stage = [*M.STAGES[1:], "complete"][M.STAGES.index(mode)]
    base = after if learner.baseline is None else learner.baseline
    gain = (after - base) / (100 - base) if after > base else (after - base) / base if after < base else 0.0
    row = {"mode": mode, "score": math.floor(score + 0.5), "passed": passed, "path": "test_it" if passed else "learn_it", "pre_mastery": before, "post_mastery": after, "next_stage": stage, "nlg": math.floor(gain * 1e4 + 0.5) / 1e4}
    return row, Learner(after, stage, at, score if learner.baseline is None else learner.baseline, learner.sessions + 1)


class SessionEvaluation(StatefulProcessor):
    """A session ends with its last answer; until then each micro-batch tells how it stands. A timer closes one whose learner stays away; should
    answers come after all, it goes on."""

    def __init__(self, length: int, idle_ms: int):
        self.length, self.idle_ms = length, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.learner = handle.getValueState("learner", "mastery double, stage string, at long, baseline double, sessions int")
        self.open = handle.getListState("open", "attempt_id long, at long, correct boolean, spaced boolean")

    def _row(self, key, learner: Learner, session: list[Answer], closed: bool) -> tuple[dict, Learner]:
        row, after = evaluated(learner, session)
        return {"session_id": f"{key[0]}-{key[1]}-{learner.sessions}", "answers": len(session), "closed": closed} | row, after

    def _state(self) -> tuple[Learner, list[Answer]]:
        return (Learner(*self.learner.get()) if self.learner.exists() else Learner()), [Answer(*a) for a in self.open.get()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "attempt_id"])
        learner, held = self._state()
        held += [Answer(int(i), int(at), bool(right), bool(spaced)) for i, at, right, spaced in zip(batch["attempt_id"], batch["at"], batch["correct"], batch["spaced"], strict=True)]
        out = []
        while len(held) >= self.length:
            row, learner = self._row(key, learner, held[: self.length], True)
            out, held = [*out, row], held[self.length :]
        self.learner.update(tuple(learner))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.open.put([tuple(a) for a in held])
            self.handle.registerTimer(held[-1].at // 1000 + self.idle_ms)
            out.append(self._row(key, learner, held, False)[0])
        else:
            self.open.clear()
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        learner, held = self._state()
        if held:
            yield pd.DataFrame([self._row(key, learner, held, True)[0]])

    def close(self) -> None:
        pass


def session_evaluations(stream: DataFrame, length: int = SESSION_ANSWERS, idle: str = IDLE, late: str = "2 hours", at: str | None = None) -> DataFrame:
    """N-01: the newest evaluation of every session: session_id, answers, closed, mode, score, passed, path, pre_mastery, post_mastery, next_stage, nlg."""
    rows = answers(stream).withWatermark("created_at", late).select("user_id", "concept_id", "attempt_id", F.unix_micros("created_at").alias("at"), "correct", (F.col("attempt_id") % 10 == 9).alias("spaced"), "created_at")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    schema = "session_id string, answers int, closed boolean, mode string, score long, passed boolean, path string, pre_mastery double, post_mastery double, next_stage string, nlg double"
    s = rows.groupBy("user_id", "concept_id").transformWithStateInPandas(SessionEvaluation(length, idle_ms), schema, "Update", "EventTime")
    return latest(s.withColumn("version", 2 * F.col("answers") + F.col("closed").cast("int")), ["session_id"], "version", at).drop("version")


def renewals(stream: DataFrame, keys: list[str], ttl: str, at: str | None = None) -> DataFrame:
    """N-04: for each key how often its entry was made or renewed, how often it was found fresh, and when it was last renewed (microseconds).
    Learning guides stay fresh for 30 days, exposures count for 72 hours, parameters are fitted again after 24 hours."""
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    clock = {}

    def start() -> Column:
        clock["ms"] = F.lit(int(time.time() * 1000))
        return F.struct(F.lit(None).cast("long").alias("since"), F.lit(0).cast("long").alias("written"), F.lit(0).cast("long").alias("renewals"), F.lit(0).cast("long").alias("hits"))

    def step(s: Column, at: Column) -> Column:
        # fresh by the lookups' times, and not written so long ago by the clock
        fresh = F.coalesce((at - s["since"] < ttl_ms * 1000) & (clock["ms"] - s["written"] < ttl_ms), F.lit(False))
        return F.struct(F.when(fresh, s["since"]).otherwise(at).alias("since"), F.when(fresh, s["written"]).otherwise(clock["ms"]).alias("written"), (s["renewals"] + F.when(fresh, 0).otherwise(1)).alias("renewals"), (s["hits"] + F.when(fresh, 1).otherwise(0)).alias("hits"))

    f = folded(answers(stream).select(*keys, F.unix_micros("created_at").alias("at")), keys, F.col("at"), start, step, at)
    return f.select(*keys, "state.renewals", "state.hits", F.col("state.since").alias("renewed_at"))
