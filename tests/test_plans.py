"""Plans that keep a document's work in its row."""

from gradus.plans import extraction, graphs, intake, lookups, more, paths, streams, triples
from gradus.sources import views


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_domain_makes_the_lower_case_once(spark, sf):
    assert plan_of(triples.domain_anchor(spark, sf)).count("lower(text") == 1


def test_chunks_meet_their_pages_without_a_join(spark, sf):
    for df in (intake.page_attribution(spark, sf), intake.chunk_confidence_b(spark, sf)):
        assert "Join" not in plan_of(df) and "Aggregate" not in plan_of(df)
    assert "Join" not in plan_of(intake.chunk_integrity(spark, sf))


def test_near_pairs(spark):
    words = " ".join(f"word{i}" for i in range(400))
    text = words[:850] * 3 + words
    rows = {r.doc_id: r.pairs for r in intake.near_pairs(spark.createDataFrame([(1, text), (2, words[:900]), (3, "")], "doc_id long, text string")).collect()}
    shingles = [set(tuple(c[i : i + 5]) for i in range(len(c) - 4)) for c in (text[i * 850 : i * 850 + 1000].strip().lower().split() for i in range(-(-(len(text) - 1000) // 850) + 1))]
    want = sum(len(a & b) >= 0.85 * len(a | b) for i, a in enumerate(shingles) for b in shingles[i + 1 :])
    assert rows == {1: want, 2: 0, 3: 0} and want > 0


def test_texts_are_read_whole(spark, sf):
    assert views.texts(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").count()


def test_paths_of_answers_write_nothing(spark, sf):
    """Frontiers and their paths are not written; only the two tables are read."""
    files = {f.rsplit("/", 1)[-1] for f in paths.answer_paths(spark, sf).inputFiles()}
    assert files == {"orders.parquet", "lineitem.parquet"}


def test_partitions_grow_with_the_lines(spark, sf, monkeypatch):
    monkeypatch.setattr(views, "PART_LINES", 500)
    lines = views.table(spark, sf, "lineitem").count()
    assert views.doc_edges(spark, sf).rdd.getNumPartitions() == views.doc_parts(spark, sf) == -(-lines // 500) > 4


def test_requests_take_theirs_from_one_array(spark, sf):
    assert "windowspecdefinition(request" not in plan_of(lookups.asked(spark, sf))


def test_cycles_are_searched_many_documents_at_a_time(spark, sf):
    assert "FlatMapGroupsInPandas" not in plan_of(graphs.cycle_filter(spark, sf))


def test_states_are_folded_without_python(spark, sf):
    for df in (streams.stream_exposures(spark, sf), streams.stream_fsrs(spark, sf), streams.stream_mastery(spark, sf)):
        assert all("/states/" in f for f in df.inputFiles())


def test_mentions_are_dealt_over_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(extraction, "PARTS_A_TASK", 10)
    assert extraction.concept_mentions(spark, sf).rdd.getNumPartitions() > 10


def test_shingles_are_not_counted_one_by_one(spark, sf):
    plan = plan_of(more.near_duplicate_chunks(spark, sf))
    assert "row_number" not in plan and "df#" not in plan
