"""Session and student metrics over the attempts table (rows as in sources.views.attempts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions.formulas import half_up


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.sum(num) / F.nullif(F.sum(den), F.lit(0.0)), F.lit(0.0))


def confidence_index(attempts: DataFrame) -> DataFrame:
    """E-09, I-25: adds rci, the confidence relative to the pace within the session."""
    mean = F.avg("time_taken").over(Window.partitionBy("session_id"))
    ratio = F.least(F.lit(2.0), F.col("time_taken") / F.nullif(mean, F.lit(0.0)))
    rci = F.when(mean <= 0, F.lit(1.0)).when(F.col("correct") & (ratio == 0), F.lit(1.0)).when(F.col("correct"), F.col("confidence") / F.nullif(ratio, F.lit(0.0))).otherwise(F.col("confidence") * ratio)
    return attempts.withColumn("rci", M.clamp(rci, 0.0, 1.0))


def calibration_bins(attempts: DataFrame, by: str) -> DataFrame:
    """I-33: expected calibration error over ten bins of confidence."""
    b = attempts.withColumn("bin", F.least(F.lit(9), F.floor(F.col("confidence") * 10)))
    b = b.groupBy(by, "bin").agg(F.count("*").alias("m"), F.avg(F.col("correct").cast("double")).alias("acc"), F.avg("confidence").alias("conf"))
    return b.groupBy(by).agg((F.sum(F.col("m") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("m")).alias("ece"))


def session_metrics(attempts: DataFrame) -> DataFrame:
    """I-24 to I-36 for each session, from rows that are no spaced reviews; a session of spaced rows
    alone has its score from them and metrics of 0."""
    right, level = F.col("correct").cast("double"), F.col("cognitive_level").cast("double")
    weight = M.case_map(F.col("question_type"), M.TYPE_WEIGHT, 1.0)
    plain = confidence_index(attempts.where(~F.col("is_spaced")))
    m = plain.groupBy("session_id").agg(
        F.count("*").alias("n"), (F.avg(right) * 100.0).alias("score"), _ratio(weight * right, weight).alias("fas"), _ratio(level * right, level).alias("wbs"),
        F.avg(M.wrong_weight(F.col("correct"), F.col("confidence"))).alias("mss"), F.avg("rci").alias("rci_avg"), F.avg(F.abs(right - F.col("confidence"))).alias("calibration_error"),
        F.avg((F.col("confidence") - right) ** 2).alias("brier_score"), F.avg(M.log_loss_term(F.col("correct"), F.col("confidence"))).alias("log_loss"),
    )
    m = m.join(calibration_bins(attempts.where(~F.col("is_spaced")), "session_id"), "session_id")
    alone = attempts.groupBy("session_id").agg(F.min("is_spaced").alias("alone"), (F.avg(right) * 100.0).alias("spaced_score")).where("alone")
    every = attempts.select("session_id").distinct().join(m, "session_id", "left").join(alone, "session_id", "left")
    every = every.withColumn("score", F.coalesce("score", "spaced_score", F.lit(0.0))).na.fill(0.0).na.fill(0, ["n"])
    ccms = F.when(F.col("n") > 0, 0.15 * F.col("fas") + 0.25 * F.col("wbs") + 0.6 * F.col("score") / 100.0).otherwise(0.0)
    every = every.withColumn("ccms", ccms)
    lip = F.when(F.col("n") > 0, (F.lit(1.0) - M.clamp(F.col("ccms"), 0.0, 1.0)) / 2.0 + F.least(F.lit(1.0), F.col("mss") / 2.0) / 2.0).otherwise(0.0)
    cols = ["score", "fas", "wbs", "ccms", "mss", "rci_avg", "calibration_error", "brier_score", "ece", "log_loss"]
    return every.select("session_id", F.col("n").cast("long").alias("n"), *[half_up(F.col(c)).alias(c) for c in cols], half_up(lip).alias("lip"))


def auc(attempts: DataFrame, by: str = "user_id") -> DataFrame:
    """I-35, E-07: area under the ROC curve, ties in input order, and a variant that shares ties."""
    order = Window.partitionBy(by).orderBy(F.desc("confidence"), "created_at", "attempt_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy(by).orderBy(F.desc("confidence")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    a = attempts.select(by, "confidence", "created_at", "attempt_id", F.col("correct").cast("long").alias("y"))
    a = a.withColumn("tp", F.sum("y").over(order)).withColumn("tp_level", F.sum("y").over(level)).withColumn("same", F.sum("y").over(Window.partitionBy(by, "confidence")))
    g = a.groupBy(by).agg(F.count("*").alias("n"), F.sum("y").alias("p"), F.sum(F.when(F.col("y") == 0, F.col("tp")).otherwise(0)).alias("area"), F.sum(F.when(F.col("y") == 0, F.col("tp_level") - F.col("same") / 2.0).otherwise(0.0)).alias("shared"))
    pairs = F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0)).cast("double")
    return g.select(by, F.col("n").alias("n_attempts"), half_up(F.coalesce(F.col("area") / pairs, F.lit(0.5)), 4).alias("auc"), half_up(F.coalesce(F.col("shared") / pairs, F.lit(0.5)), 4).alias("auc_tied"), (F.col("n") >= 10).alias("reported"))


def convergence(sessions: DataFrame, threshold: float = 2.0) -> DataFrame:
    """E-03: the first session whose score differs from the one before by less than the threshold, else the number of sessions."""
    w = Window.partitionBy("user_id", "concept_id").orderBy("created_at", "session_id")
    s = sessions.withColumn("i", F.row_number().over(w) - 1).withColumn("d", F.abs(F.col("score") - F.lag("score").over(w)))
    return s.groupBy("user_id", "concept_id").agg(F.coalesce(F.min(F.when(F.col("d") < threshold, F.col("i"))), F.count("*")).cast("long").alias("convergence"), F.count("*").alias("sessions"))


def slope(sessions: DataFrame, last: int = 10) -> DataFrame:
    """E-04: least-squares slope of the last scores, 0 for fewer than two."""
    down = Window.partitionBy("user_id", "concept_id").orderBy(F.desc("created_at"), F.desc("session_id"))
    s = sessions.withColumn("back", F.row_number().over(down)).where(F.col("back") <= last)
    return s.groupBy("user_id", "concept_id").agg(half_up(F.coalesce(F.regr_slope("score", -F.col("back").cast("double")), F.lit(0.0))).alias("slope"), F.count("*").alias("points"))


def gains(sessions: DataFrame) -> DataFrame:
    """E-08 and I-31: adds baseline, the first earlier diagnostic score, else the first earlier score of any mode, and nlg."""
    w = Window.partitionBy("user_id", "concept_id").orderBy("created_at", "session_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(F.when(F.col("mode") == "diagnostic", F.col("score")), ignorenulls=True).over(w)
    base = F.coalesce(first, F.first("score").over(w))
    s = sessions.withColumn("baseline", base)
    return s.withColumn("nlg", F.when(F.col("baseline").isNotNull(), M.learning_gain(F.col("baseline"), F.col("score"))))


def baseline_gain(sessions: DataFrame) -> DataFrame:
    return gains(sessions).select("session_id", "user_id", "concept_id", "mode", "created_at", *[half_up(F.col(c)).alias(c) for c in ("score", "baseline", "nlg")])
