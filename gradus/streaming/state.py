"""Incremental learner state with Structured Streaming.

Each stream reads answers, keeps one small state per key and emits the state after every micro-batch;
a sink keeps the latest per key. Answers of a key are sorted inside a micro-batch; answers that come
in an earlier order in a later batch are folded as they arrive.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import formulas as M
from ..operators.folds import fsrs_step


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one in the warehouse only where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return f"{at or spark.conf.get('spark.sql.warehouse.dir') + '/_checkpoints'}/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def answers(events: DataFrame) -> DataFrame:
    """The columns of the attempts view that need no window."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(F.col("event_id").alias("attempt_id"), "user_id", (k % 5).alias("concept_id"), F.concat(F.lit("q"), k).alias("question_id"), (k % 3 + 1).alias("difficulty"), (F.col("value") < 60).alias("correct"), ((F.col("event_id") * 37 % 101) / 100.0).cast("double").alias("confidence"), F.col("ts").cast("timestamp").alias("created_at"))


def irt_fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """N-02: the item's difficulty and number of answers."""
    rows = pd.concat(list(batches)).sort_values(["created_at", "attempt_id"])
    b, n = state.get if state.exists else ({1: -0.5, 2: 0.0}.get(int(rows["difficulty"].iloc[0]), 0.5), 0)
    for right, confidence in zip(rows["correct"], rows["confidence"], strict=True):
        c = max(0.01, min(0.99, confidence))
        p = 1 / (1 + math.exp(-(math.log(c / (1 - c)) - b)))
        b = max(-3.0, min(3.0, b + 0.1 / math.sqrt(n + 1) * (p - float(right))))
        b, n = math.floor(b * 1e4 + 0.5) / 1e4, n + 1
    state.update((b, n))
    yield pd.DataFrame({"question_id": [key[0]], "b": [b], "response_count": [n]})


#: Processors with timers, lists and entries that expire need this state store.
_PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A stream on the clock's time would else run empty batches for ever.
_NO_IDLE = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def run_now(stream: DataFrame, at: str, mode: str = "update", clock: bool = False) -> tuple[DataFrame, int]:
    """Run the stream over what is there now, on from where the folder's last run ended: all rows emitted so far, and how many rows of this run
    came later than the watermark and were dropped. clock: the stream's state expires by the clock."""
    spark = stream.sparkSession
    conf = _PROVIDER | (_NO_IDLE if clock else {})
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(sink).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    return spark.read.parquet(f"{at}/out").drop("batch"), dropped


def latest(stream: DataFrame, keys: list[str], version: str, at: str | None = None, clock: bool = False) -> DataFrame:
    """Run the stream over what is there now and return the last emitted row of each key."""
    out, _ = run_now(stream, at or shared_folder(stream.sparkSession), clock=clock)
    return out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in out.columns if c not in keys]), version).alias("x")).select(*keys, "x.*")


def irt_state(stream: DataFrame) -> DataFrame:
    s = answers(stream).groupBy("question_id").applyInPandasWithState(irt_fold, "question_id string, b double, response_count long", "b double, n long", "update", GroupStateTimeout.NoTimeout)
    return latest(s, ["question_id"], "response_count")


def folded(stream: DataFrame, keys: list[str], rows: Column, start: Column | Callable, step: Callable, at: str | None = None) -> DataFrame:
    """Run the stream over what is there now and return (keys, state) of every key so far. Each micro-batch folds the rows of a key, in order, onto
    the key's state with built-in expressions, so a key costs no call of Python. A batch reads the states the last one left and writes all
    anew, under its own number: one that is run again gives the same. step(state, row); start may be a function, called for each batch."""
    spark, at = stream.sparkSession, at or shared_folder(stream.sparkSession)

    def sink(batch: DataFrame, number: int) -> None:
        zero = start() if callable(start) else start
        new = batch.groupBy(*keys).agg(F.sort_array(F.collect_list(rows)).alias("steps"))
        if number > 0:
            old = batch.sparkSession.read.parquet(f"{at}/states/batch={number - 1}")
            both = new.unionByName(old, allowMissingColumns=True).groupBy(*keys).agg(F.first("steps", ignorenulls=True).alias("steps"), F.first("state", ignorenulls=True).alias("state"))
        else:
            both = new.withColumn("state", zero)
        after = F.when(F.col("steps").isNull(), F.col("state")).otherwise(F.aggregate("steps", F.coalesce(F.col("state"), zero), step))
        both.select(*keys, after.alias("state")).write.mode("overwrite").parquet(f"{at}/states/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    states = spark.read.parquet(f"{at}/states")
    return states.where(F.col("batch") == states.agg(F.max("batch")).first()[0]).drop("batch")


_KEYS = ["user_id", "concept_id"]


def bkt_state(stream: DataFrame) -> DataFrame:
    """N-01: the posterior that a learner knows a concept."""
    start = F.struct(F.lit(M.BKT["l0"]).alias("p"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(M.bkt_step(s["p"], x["correct"]).alias("p"), (s["n"] + 1).alias("n"))
    return folded(answers(stream), _KEYS, F.struct("created_at", "attempt_id", "correct"), start, step).select(*_KEYS, "state.p", "state.n")


def fsrs_state(stream: DataFrame) -> DataFrame:
    """N-03: stability and difficulty of a learner's memory of a concept, and the number of reviews."""
    start = F.struct(F.lit(1.0).alias("s"), F.lit(5.0).alias("d"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        y = fsrs_step(s, x)
        return F.struct(*[y[c].alias(c) for c in ("s", "d", "at")], (s["n"] + 1).alias("n"))

    f = folded(answers(stream), _KEYS, F.struct("created_at", "attempt_id", "correct"), start, step)
    return f.select(*_KEYS, F.col("state.s").alias("stability"), F.col("state.d").alias("difficulty"), F.col("state.n").alias("reviews"))


def cache_hits(lookups: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """N-05: how often each cache entry was looked up, and when last. Lookups without an entry count for nothing; the counters
    combine before the shuffle, so an entry that everyone reads is no single task."""
    hits = lookups.join(entries.select(*keys).distinct(), keys).groupBy(*keys).agg(F.count("*").alias("hit_count"), F.max("created_at").alias("last_hit_at"))
    return latest(hits, keys, "hit_count")


def activity_windows(stream: DataFrame, length: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """N-07: counts and sums in tumbling windows, or windows that begin every `slide`; the watermark bounds the state."""
    e = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = e.groupBy(F.window("at", length, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return latest(g.select(F.col("w.start").alias("start"), "event_type", "n", "total"), ["start", "event_type"], "n")


def activity_sessions(stream: DataFrame, gap: str = "6 hours", late: str = "2 hours", at: str | None = None) -> tuple[DataFrame, int]:
    """N-07: a user's visits, which end where nothing follows for `gap`: user_id, start, end, n and total of those that the watermark has passed,
    once each; and the number of rows that came too late for any."""
    e = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = e.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return run_now(g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total"), at or shared_folder(stream.sparkSession), "append")
