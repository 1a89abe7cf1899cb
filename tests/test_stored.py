"""Merges into stored tables, deletes that cascade, and reads by their owner."""

import itertools
import random
from pathlib import Path

import pytest
from gradus.operators import cascade
from gradus.operators.cascade import Reference
from gradus.sources import store, views
from gradus.sources.owned import Owned
from pyspark.sql import functions as F


def rows_of(df):
    return sorted(map(str, df.collect()))


def files(at):
    return {str(p): p.stat().st_mtime_ns for p in Path(at).rglob("*.parquet")}


def test_merge_is_an_upsert(spark, tmp_path):
    schema = "k long, sub string, v long, at long"
    rng = random.Random(5)
    batches = [[(rng.randrange(12), rng.choice(["x", None]), rng.randrange(100), 100 * b + i) for i in range(20)] for b in range(3)]
    want = {}
    for r in itertools.chain(*batches):
        want[r[:2]] = max(want.get(r[:2], r), r, key=lambda x: x[3])
    for order in ([0, 1, 2], [2, 0, 1, 0, 2]):  # late and repeated batches change nothing
        at = str(tmp_path / "-".join(map(str, order)))
        for b in order:
            store.merge_into(at, spark.createDataFrame(batches[b], schema), ["k", "sub"], ["at"], 4)
        assert sorted(map(str, (tuple(r) for r in store.merged(spark, at).select("k", "sub", "v", "at").collect()))) == sorted(map(str, want.values()))


def test_merge_touches_only_its_partitions(spark, tmp_path):
    at = str(tmp_path / "t")
    store.merge_into(at, spark.range(200).selectExpr("id as k", "0 as v"), ["k"], ["v"], 16)
    before = files(at)
    store.merge_into(at, spark.createDataFrame([(3, 1)], "k long, v int"), ["k"], ["v"], 16)
    after = files(at)
    assert len(set(before) - set(after)) == 1 and len(set(after) - set(before)) == 1
    assert store.merged(spark, at).where("v = 1").collect()[0].k == 3 and store.merged(spark, at).count() == 200
    store.merge_into(at, spark.createDataFrame([], "k long, v int"), ["k"], ["v"], 16)
    assert files(at) == after


def test_graph_merge_counts_a_batch_once(spark, tmp_path):
    at = str(tmp_path / "g")
    schema = "doc long, chunk long, subject string, relation string, object string"
    one = [(1, 1, "a", "IS_A", "b"), (1, 1, "a", "IS_A", "b"), (1, 2, "b", "x-y", "c"), (1, 2, None, "IS_A", "c"), (1, 2, "c", "__", "a")]
    two = [(1, 3, "a", "IS_A", "b"), (2, 4, "a", "PART_OF", "b")]
    for name, batch in (("one", one), ("two", two), ("one", one)):
        store.merge_triples(at, spark.createDataFrame(batch, schema), name, 4)
    assert {tuple(r) for r in store.graph_nodes(spark, at).collect()} == {(1, "a", 4), (1, "b", 4), (1, "c", 2), (2, "a", 1), (2, "b", 1)}
    assert {tuple(r) for r in store.merged(spark, f"{at}/relations").select("doc", "subject", "relation", "object").collect()} == {(1, "a", "IS_A", "b"), (2, "a", "PART_OF", "b")}
    assert store.merged(spark, f"{at}/mentions").count() == 2 + 3 + 2 + 2  # names of each chunk


def test_graph_merge_leaves_other_batches_alone(spark, tmp_path):
    at = str(tmp_path / "g")
    schema = "doc long, chunk long, subject string, relation string, object string"
    rows = [(d, d, f"s{d}", "IS_A", f"o{d}") for d in range(40)]
    store.merge_triples(at, spark.createDataFrame(rows, schema), "one", 4)
    before = files(at)
    store.merge_triples(at, spark.createDataFrame(rows, schema), "2", 4)
    assert before.items() <= files(at).items()
    store.merge_triples(at, spark.createDataFrame(rows, schema), "2", 4)
    assert before.items() <= files(at).items()
    assert store.graph_relations(spark, at).count() == 40 and store.graph_mentions(spark, at).count() == 80
    assert {r.mention_count for r in store.graph_nodes(spark, at).collect()} == {2}


def test_cascade_follows_references_around_cycles(spark):
    tables = {
        "folder": spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5)], "id long, up long"),
        "file": spark.createDataFrame([(10, 4, 11), (11, 5, None), (12, 6, 10), (13, None, None)], "id long, folder long, link long"),
    }
    keys = {"folder": ["id"], "file": ["id"]}
    references = [Reference("folder", ("up",), "folder", ("id",)), Reference("file", ("folder",), "folder", ("id",)), Reference("file", ("link",), "file", ("id",))]
    left = cascade.delete(tables, keys, references, {"folder": spark.createDataFrame([(2,)], "id long")})
    assert {r.id for r in left["folder"].collect()} == {1, 5, 6} and {r.id for r in left["file"].collect()} == {11, 13}
    ring = {"t": spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "id long, up long")}
    gone = cascade.doomed(ring, {"t": ["id"]}, [Reference("t", ("up",), "t", ("id",))], {"t": spark.createDataFrame([(1,)], "id long")})
    assert {r.id for r in gone["t"].collect()} == {1, 2, 3}
    untouched = cascade.delete(tables, keys, references, {"folder": spark.createDataFrame([(99,)], "id long")})
    assert untouched["folder"].count() == 6 and untouched["file"].count() == 4
    with pytest.raises(RuntimeError):
        cascade.doomed(tables, keys, references, {"folder": spark.createDataFrame([(1,)], "id long")}, rounds=1)


def test_reads_carry_the_owner(spark, sf):
    own = Owned(spark, sf, 7)
    plan = own.read("orders")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]" in plan
    plan = own.read("attempts")._jdf.queryExecution().toString()
    assert "EqualTo(user_id,7)" in plan  # through the view's windows
    assert {r.user_id for r in own.read("sessions").collect()} == {7}
    assert rows_of(own.read("attempts")) == rows_of(views.attempts(spark, sf).where("user_id = 7"))
    assert own.read("parts").count() == views.table(spark, sf, "part").count()


def test_nothing_is_read_or_written_without_a_right(spark, sf):
    with pytest.raises(PermissionError):
        Owned(spark, sf, None)
    own = Owned(spark, sf, 7)
    for act in (lambda: own.read("lineitem"), lambda: own.checked("parts", spark.range(1)), lambda: own.checked("lineitem", spark.range(1))):
        with pytest.raises(PermissionError):
            act()
    mine = own.read("attempts")
    assert own.checked("attempts", mine).count() == mine.count()
    for other in (8, None):
        with pytest.raises(Exception, match="belongs to someone else"):
            own.checked("attempts", mine.withColumn("user_id", F.lit(other).cast("long"))).collect()
