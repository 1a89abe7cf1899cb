"""Column formulas of the learner model and the assessment metrics. All are built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model defaults, thresholds and weights that results depend on.
BKT = {"l0": 0.25, "t": 0.12, "s": 0.08, "g": 0.25}
GAMMA_DAY, PASS, REVIEW, MASTERED = 0.05, 80, 70.0, 85.0
TYPES = ["recall", "conceptual", "application", "reasoning", "analytical"]
TYPE_WEIGHT = {"recall": 1.0, "conceptual": 1.2, "application": 1.5, "reasoning": 1.5, "analytical": 2.0}
LEVEL = {"recall": 1, "conceptual": 2, "application": 3, "reasoning": 3, "analytical": 4}
EXPECTED_SECONDS = {1: 30.0, 2: 60.0, 3: 90.0}
STAGES = ["diagnostic", "practice", "mastery"]
AS_OF = "2024-02-01 00:00:00"


def half_up(x: Column, digits: int = 6) -> Column:
    """Round half towards plus infinity."""
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def exact_mean(x: Column) -> Column:
    """The mean of values of moderate size, added up as decimals: it does not depend on the order of the rows, whose last bits may decide a rounding."""
    return F.sum(x.cast("decimal(38,18)")).cast("double") / F.count(x)


def case_map(key: Column, values: dict, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in values.items():
        out = out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def bkt_step(p: Column, correct: Column, t=None, s=None, g=None) -> Column:
    """I-01: Bayes with slip and guess, then the learning transition."""
    t, s, g = (F.lit(BKT[k]) if v is None else v for k, v in (("t", t), ("s", s), ("g", g)))
    known = F.when(correct, p * (F.lit(1.0) - s)).otherwise(p * s)
    other = F.when(correct, (F.lit(1.0) - p) * g).otherwise((F.lit(1.0) - p) * (F.lit(1.0) - g))
    post = F.when(known + other > 0, known / (known + other)).otherwise(p)
    return clamp(post + (F.lit(1.0) - post) * t, 0.0, 1.0)


def rasch(theta: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(theta - b)))


def theta_of(mastery: Column) -> Column:
    p = clamp(mastery / 100.0, 0.01, 0.99)
    return F.ln(p / (F.lit(1.0) - p))


def difficulty_band(b: Column) -> Column:
    return F.when(b < -0.25, 1).when(b > 0.25, 3).otherwise(2)


def initial_difficulty(level: Column) -> Column:
    return F.when(level == 1, F.lit(-0.5)).when(level == 2, F.lit(0.0)).otherwise(F.lit(0.5))


def decayed(mastery: Column, hours: Column) -> Column:
    """I-11."""
    return F.when(hours <= 0, mastery).otherwise(half_up(mastery * F.exp(F.lit(-GAMMA_DAY) * hours / 24.0), 2))


def review_days(mastery: Column) -> Column:
    return F.when(mastery <= REVIEW, F.lit(0.0)).otherwise(-F.ln(F.lit(REVIEW) / mastery) / GAMMA_DAY)


def review_urgency(mastery: Column, now: Column) -> Column:
    """I-14: the rules apply in this order."""
    span = mastery - REVIEW
    return F.when(now >= mastery * 0.9, F.lit(0.0)).when(now <= REVIEW, F.lit(1.0)).when(span <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (mastery - now) / F.nullif(span, F.lit(0.0))))


def retrievability(days: Column, stability: Column) -> Column:
    return F.when(stability <= 0, F.lit(0.0)).when(days <= 0, F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + days / (F.lit(9.0) * stability)))


def hours_between(later: Column, earlier: Column) -> Column:
    """Both timestamps without zone or both with."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def severity(score: Column) -> Column:
    return F.when(score >= 0.85, "CORRECT").when(score >= 0.60, "CLOSE").when(score >= 0.30, "PARTIAL").otherwise("CRITICAL")


def answer_score(correct: Column, hop: Column) -> Column:
    """I-41: 1 for a right answer, else by the distance of the chosen option."""
    return F.when(correct, F.lit(1.0)).when(hop == 1, F.lit(0.4)).when(hop == 2, F.lit(0.2)).otherwise(F.lit(0.0))


def wrong_weight(correct: Column, confidence: Column) -> Column:
    """I-28: what a wrong answer weighs by its confidence."""
    return F.when(correct, F.lit(0.0)).when(confidence > 0.7, F.lit(2.0)).when(confidence >= 0.4, F.lit(1.5)).otherwise(F.lit(1.0))


def learning_gain(pre: Column, post: Column) -> Column:
    """I-31: gain by the room above, loss by the room below."""
    up, down = (post - pre) / F.nullif(F.lit(100.0) - pre, F.lit(0.0)), (post - pre) / F.nullif(pre, F.lit(0.0))
    return F.when(post > pre, F.coalesce(up, F.lit(0.0))).when(post < pre, F.coalesce(down, F.lit(0.0))).otherwise(F.lit(0.0))


def log_loss_term(correct: Column, confidence: Column) -> Column:
    c = clamp(confidence, 1e-7, 1 - 1e-7)
    return -F.when(correct, F.ln(c)).otherwise(F.ln(F.lit(1.0) - c))


def difficulty_shares(mastery: Column) -> tuple[Column, Column, Column]:
    """I-23."""
    e = F.greatest(F.lit(0.0), F.lit(0.7) - F.lit(0.006) * mastery)
    m = F.lit(0.3) + F.lit(0.002) * mastery
    h = F.greatest(F.lit(0.0), F.lit(1.0) - e - m)
    return e / (e + m + h), m / (e + m + h), h / (e + m + h)


def logit(p: float) -> float:
    return math.log(p / (1 - p))
