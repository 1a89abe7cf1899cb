"""Order-dependent learner models. A learner's rows of a concept are collected in order and folded by a built-in
higher-order function, with only the order key and the fields the fold reads; the answers to a question, whose
number has no bound, are folded as they are read in order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions.formulas import half_up


def history(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """keys and `steps`, the ordered array of struct(order..., fields...)."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *fields))).alias("steps"))


def bkt_final(attempts: DataFrame) -> DataFrame:
    """I-02, I-04: the posterior after all answers, mastery, and the log-likelihood of the sequence."""
    h = history(attempts, ["user_id", "concept_id"], ["created_at", "attempt_id"], ["correct"])
    p0 = F.struct(F.lit(M.BKT["l0"]).alias("p"), F.lit(0.0).alias("ll"))

    def step(acc: Column, x: Column) -> Column:
        right = acc["p"] * (1 - M.BKT["s"]) + (1 - acc["p"]) * M.BKT["g"]
        seen = F.greatest(F.lit(1e-10), F.when(x["correct"], right).otherwise(1 - right))
        return F.struct(M.bkt_step(acc["p"], x["correct"]).alias("p"), (acc["ll"] + F.ln(seen)).alias("ll"))

    h = h.withColumn("end", F.aggregate("steps", p0, step))
    return h.select("user_id", "concept_id", F.size("steps").cast("long").alias("n"), half_up(F.col("end.p")).alias("p_known"), half_up(F.col("end.ll")).alias("log_likelihood"), F.floor(F.col("end.p") * 100 + 0.5).alias("mastery"))


def bkt_trace(attempts: DataFrame) -> DataFrame:
    """E-02: the posterior after each answer."""
    h = history(attempts, ["user_id", "concept_id"], ["created_at", "attempt_id"], ["correct"])
    empty = F.struct(F.lit(M.BKT["l0"]).alias("p"), F.array().cast("array<double>").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        p = M.bkt_step(acc["p"], x["correct"])
        return F.struct(p.alias("p"), F.concat(acc["seen"], F.array(p)).alias("seen"))

    h = h.select("user_id", "concept_id", F.arrays_zip("steps", F.aggregate("steps", empty, step)["seen"].alias("p")).alias("z"))
    h = h.select("user_id", "concept_id", F.explode("z").alias("z"))
    return h.select("user_id", "concept_id", F.col("z.steps.attempt_id").alias("attempt_id"), half_up(F.col("z.p")).alias("p_known"))


def ordered_fold(rows: DataFrame, key: str, order: list[str], fields: list[str], start: Callable, step: Callable, out: Callable, schema: str) -> DataFrame:
    """One row for each key: out(key, state), the state being start(*first row's fields) carried by step(state, *fields) over the key's rows in order.
    Rows are sorted, which spills, and read batch by batch; a task holds a batch and one state, however many rows a key has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for k, *values in batch[[key, *fields]].itertuples(index=False, name=None):
                if state is None or k != now:
                    done += [out(now, state)] if state is not None else []
                    now, state = k, start(*values)
                state = step(state, *values)
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame([out(now, state)] if state is not None else [], columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    placed = rows.where(F.col(key).isNotNull()).select(key, *order, *fields).repartition(key).sortWithinPartitions(key, *order)
    return placed.select(key, *fields).mapInPandas(run, schema)


def irt_online(attempts: DataFrame, rate: float = 0.1) -> DataFrame:
    """I-09: online item difficulty by question; the state is rounded to four digits at each answer. An attempt's ability is the confidence it was
    given with, read as mastery. There are few questions and very many answers, so answers are folded as they are read."""
    rows = attempts.withColumns({"theta": M.theta_of(F.col("confidence") * 100), "y": F.col("correct").cast("double")})

    def start(theta: float, y: float, difficulty: int) -> tuple:
        return {1: -0.5, 2: 0.0}.get(difficulty, 0.5), 0, difficulty

    def step(state: tuple, theta: float, y: float, difficulty: int) -> tuple:
        b, n, label = state
        b = max(-3.0, min(3.0, b + rate / math.sqrt(n + 1) * (1 / (1 + math.exp(-(theta - b))) - y)))
        return math.floor(b * 1e4 + 0.5) / 1e4, n + 1, label

    h = ordered_fold(rows, "question_id", ["created_at", "attempt_id"], ["theta", "y", "difficulty"], start, step, lambda k, s: (k, *s), "question_id string, b double, response_count long, label long")
    return h.select("question_id", "b", "response_count", M.difficulty_band(F.col("b")).alias("level"), F.col("label").cast(attempts.schema["difficulty"].dataType).alias("label"))


def fsrs_step(acc: Column, x: Column) -> Column:
    """I-16: (s, d, at) after a review (created_at, correct)."""
    now = F.unix_micros(x["created_at"].cast("timestamp"))
    days = F.coalesce((now - acc["at"]) / 8.64e10, F.lit(0.0))
    r = M.retrievability(days, acc["s"])
    up = acc["s"] * (F.lit(1.0) + F.exp(F.lit(0.9)) * (F.lit(11.0) - acc["d"]) * F.pow(acc["s"], F.lit(-0.2)) * (F.exp(F.lit(1.0) - r) - F.lit(1.0)))
    s = F.when(x["correct"], F.greatest(F.lit(0.5), up)).otherwise(F.greatest(F.lit(0.5), acc["s"] / 2))
    d = M.clamp(F.when(x["correct"], acc["d"] - 0.15).otherwise(acc["d"] + 0.3), 1.0, 10.0)
    return F.struct(half_up(s, 3).alias("s"), half_up(d, 2).alias("d"), now.alias("at"))


def fsrs_state(attempts: DataFrame) -> DataFrame:
    """I-16, I-17: stability and difficulty after each of a learner's reviews of a concept."""
    h = history(attempts, ["user_id", "concept_id"], ["created_at", "attempt_id"], ["correct"])
    start = F.struct(F.lit(1.0).alias("s"), F.lit(5.0).alias("d"), F.lit(None).cast("long").alias("at"))
    h = h.withColumn("end", F.aggregate("steps", start, fsrs_step))
    return h.select("user_id", "concept_id", F.col("end.s").alias("stability"), F.col("end.d").alias("difficulty"), half_up(9 * F.col("end.s") * (1 / 0.9 - 1), 1).alias("next_review_days"))


def mastery_steps(attempts: DataFrame, use: Column | None = None) -> DataFrame:
    """I-21, I-38, N-01: the state after each of a learner's sessions of a concept, and the decayed mastery before it. A diagnostic session
    sets the mastery to its score; others start from the decayed mastery and fold their answers (those of `use`, where given)."""
    answer = F.struct("created_at", "attempt_id", "correct")
    folded = F.collect_list(answer if use is None else F.when(use, answer))
    right = F.col("correct").cast("double")
    mean = F.avg(right) if use is None else F.coalesce(F.avg(F.when(use, right)), F.avg(right))
    per = attempts.groupBy("user_id", "concept_id", "session_no", "mode").agg(F.max("created_at").alias("at"), F.sort_array(folded).alias("answers"), mean.alias("mean"))
    h = history(per, ["user_id", "concept_id"], ["session_no"], ["at", "mode", "mean", "answers"])
    state = "struct<mastery:double,stage:string,at:bigint,before:double>"
    start = F.struct(F.lit(0.0).alias("mastery"), F.lit("diagnostic").alias("stage"), F.lit(None).cast("long").alias("at"), F.lit(0.0).alias("before"))
    place = lambda s: F.array_position(F.lit([*M.STAGES]), s).cast("int") - 1  # noqa: E731  "complete" stands at -1

    def step(acc: Column, x: Column) -> Column:
        now = F.unix_micros(x["at"].cast("timestamp"))
        hours = F.coalesce((now - acc["at"]) / 3.6e9, F.lit(0.0))
        before = M.decayed(acc["mastery"], hours)
        p = F.aggregate(x["answers"], before / 100.0, lambda q, a: M.bkt_step(q, a["correct"]))
        after = F.floor(F.when(x["mode"] == "diagnostic", x["mean"] * 100.0).otherwise(p * 100.0) + 0.5).cast("double")
        passed = (x["mean"] * 100.0 >= M.PASS) & (place(x["mode"]) <= place(acc["stage"]) + 1)
        stage = F.when(passed, F.element_at(F.lit([*M.STAGES[1:], "complete"]), place(x["mode"]) + 1)).otherwise(acc["stage"])
        return F.struct(after.alias("mastery"), stage.alias("stage"), now.alias("at"), before.alias("before"))

    def add(seen: Column, x: Column) -> Column:
        return F.concat(seen, F.array(step(F.coalesce(F.try_element_at(seen, F.lit(-1)), start.cast(state)), x).cast(state)))

    return h.select("user_id", "concept_id", "steps", F.aggregate("steps", F.array().cast(f"array<{state}>"), add).alias("states"))


def mastery_fold(attempts: DataFrame) -> DataFrame:
    """The state after all sessions."""
    h = mastery_steps(attempts).withColumn("end", F.element_at("states", -1))
    return h.select("user_id", "concept_id", F.size("steps").cast("long").alias("sessions"), F.col("end.mastery").alias("mastery"), F.col("end.stage").alias("stage"), F.timestamp_micros("end.at").cast("timestamp_ntz").alias("last_updated"))


GRID = {"l0": (0.05, 10), "t": (0.05, 8), "s": (0.02, 7), "g": (0.10, 6)}  # fixed values: first value and number of steps of 0.05


def grid() -> np.ndarray:
    """I-05: the parameter tuples in order; the first of equals wins."""
    axes = [np.round(lo + 0.05 * np.arange(n), 2) for lo, n in GRID.values()]
    return np.stack([a.ravel() for a in np.meshgrid(*axes, indexing="ij")], axis=1)


def bkt_partial(attempts: DataFrame) -> DataFrame:
    """Log-likelihood of every tuple of the grid for blocks of learners: rows (concept_id, students, attempts, ll array).
    Equal answer sequences are one row with a count; they are dealt over all tasks, so a concept with very many is no single task.
    A task folds its sequences side by side, in blocks of 32: a matrix of sequences and tuples, one position at a time."""
    h = history(attempts, ["user_id", "concept_id"], ["created_at", "attempt_id"], ["correct"]).where(F.size("steps") >= 2)
    h = h.groupBy("concept_id", F.transform("steps", lambda s: s["correct"]).alias("y")).agg(F.count("*").alias("n"))
    h = h.repartition(int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tuples = grid()

    def block(ys: list, n: np.ndarray) -> np.ndarray:
        l0, t, s, g = tuples.T.astype(np.float64)
        order = np.argsort([-len(y) for y in ys], kind="stable")
        long = np.array([len(ys[i]) for i in order])
        p, seen, ll = np.tile(l0, (len(ys), 1)), np.ones((len(ys), len(tuples))), np.zeros(len(tuples))
        weight = n[order].astype(float)
        for k in range(long[0]):
            m = int((long > k).sum())  # the sequences that go on
            right = np.array([bool(ys[i][k]) for i in order[:m]])[:, None]
            q = p[:m]
            at = q * np.where(right, 1 - s, s)
            chance = at + (1 - q) * np.where(right, g, 1 - g)
            seen[:m] *= np.maximum(chance, 1e-10)
            q = at / chance
            p[:m] = q + (1 - q) * t
            if k % 16 == 15:  # long before products get too small
                ll += weight[:m] @ np.log(seen[:m])
                seen[:m] = 1
        return ll + weight @ np.log(seen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for batch in batches:
            for concept, rows in batch.groupby("concept_id"):
                own = sums.setdefault(concept, [0, 0, np.zeros(len(tuples))])
                ys, n = rows["y"].tolist(), rows["n"].to_numpy()
                own[0] += int(n.sum())
                own[1] += int(sum(len(y) * c for y, c in zip(ys, n, strict=True)))
                for i in range(0, len(ys), 32):
                    own[2] += block(ys[i : i + 32], n[i : i + 32])
        yield pd.DataFrame([(c, n, m, ll.tolist()) for c, (n, m, ll) in sums.items()], columns=["concept_id", "students", "attempts", "ll"])

    return h.select("concept_id", "y", "n").mapInPandas(run, "concept_id int, students long, attempts long, ll array<double>")


# Readings of fitted parameters, each up to its bound, and what holds beyond.
READINGS = {
    "prior_knowledge": [(0.15, "Very low — students are starting fresh"), (0.35, "Low to moderate — some prior exposure likely"), (None, "High — students have significant prior knowledge")],
    "learning_rate": [(0.08, "Slow — concept requires many exposures"), (0.18, "Moderate — typical factual learning rate"), (None, "Fast — concept is easily acquired per attempt")],
    "slip_rate": [(0.05, "Very low — students who know it almost never slip"), (0.15, "Normal — occasional careless errors"), (None, "High — consider reviewing question clarity")],
    "guess_rate": [(0.15, "Below MCQ floor — verify question difficulty"), (0.30, "Normal for 4-option MCQ"), (None, "High — distractors may be too easy to eliminate")],
    "identifiability": [(0.5, "Good — parameters are identifiable"), (None, "Warning — p_s + p_g is high, model may be poorly identified")],
}


def reading(name: str, value: Column) -> Column:
    """I-06."""
    out = F.when(F.lit(False), F.lit(""))
    for bound, label in READINGS[name]:
        out = out.when(value < bound, F.lit(label)) if bound is not None else out.otherwise(F.lit(label))
    return out


def bkt_fit(attempts: DataFrame, least_attempts: int = 30, least_students: int = 3) -> DataFrame:
    """I-05, I-06: the tuple of greatest likelihood for each concept with enough data. Parts are added up
    by position, so what is shuffled is one array of the grid for each task and concept."""
    parts = bkt_partial(attempts)
    size = parts.groupBy("concept_id").agg(F.sum("students").alias("students"), F.sum("attempts").alias("attempts"))
    ll = parts.select("concept_id", F.posexplode("ll").alias("i", "v")).groupBy("concept_id", "i").agg(F.sum("v").alias("ll"))
    best = ll.groupBy("concept_id").agg(F.max_by(F.struct("i", "ll"), F.struct(half_up(F.col("ll"), 9), -F.col("i"))).alias("b"))
    at, span = [], math.prod(n for _, n in GRID.values())
    for low, n in GRID.values():  # a tuple's values by its place in the grid
        span //= n
        at.append(half_up(low + 0.05 * (F.floor(F.col("b.i") / span) % n), 2))
    read = dict(zip(READINGS, (at[0], at[1], at[2], at[3], at[2] + at[3]), strict=True))
    return best.join(size, "concept_id").where((F.col("students") >= least_students) & (F.col("attempts") >= least_attempts)).select("concept_id", *[at[i].alias(n) for i, n in enumerate(("p_l0", "p_t", "p_s", "p_g"))], half_up(F.col("b.ll"), 3).alias("log_likelihood"), "students", "attempts", *[reading(k, v).alias(k) for k, v in read.items()])
