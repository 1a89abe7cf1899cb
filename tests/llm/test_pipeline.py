"""Each stage on the smallest tables: its decisions take effect and columns stay."""

import corpus_pipeline
from gradus.llm import minhash, pii, toxicity
from gradus.llm.common import table


def test_stages(spark, sf):
    docs, seen = table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    before, after = seen["toxicity"]
    bad = {r.doc_id for r in toxicity.toxicity(before, table(spark, sf, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == bad
    before, after = seen["near_duplicates"]
    assert {r.doc_id for r in after.collect()} == {r.class_id for r in minhash.near_groups(before).collect()}
    before, after = seen["pii"]
    assert before.count() == after.count() and not any(pii.base_spans(r.text) for r in after.collect())
    before, after = seen["mixing"]
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert 1.3 < words(after) / words(before) < 1.7
    before, after = seen["packing"]
    assert sum(r.used for r in after.collect()) == words(before)


def test_stages_on_odd_rows(spark, sf):
    """Null ids and texts, empty texts, repeated rows, one id on two texts, and columns named like results; then no rows at all."""
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "a"), (2, "", None), (3, same, "a"), (3, same, "a"), (4, same + " more", "b"), (4, "mail a.b@c.org now", "b"), (None, same, "a"), (None, None, None), (5, " \n", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' as lang", "cast(length(text) as long) as n_chars", "1 as h", "2 as id", "3 as kept", "4 as size", "5 as spans", "6 as used")
    for start in (docs, docs.where("false")):
        now, counts = start, {}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, sf).cache()
            assert name == "packing" or out.dtypes == start.dtypes
            counts[name] = out.count()
            if name == "near_duplicates":
                near = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
            elif name == "pii":
                cleaned = [r.text for r in out.collect() if r.doc_id == 4]
            now = out
        if start is docs:
            # one of the two rows of 3 goes; (4, same + " more") is a near copy of 3 and goes, the other text of id 4 stays
            left = list(rows)
            left.remove((3, same, "a"))
            left.remove((4, same + " more", "b"))
            assert counts["toxicity"] == len(rows)
            assert near == sorted((i or 0, t or "") for i, t, _ in left)
            assert "mail [EMAIL] now" in cleaned
        else:
            assert not any(counts.values())
