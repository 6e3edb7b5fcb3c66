"""What one task holds must not grow with the input: partitions follow the rows, and ranks are cut before rows are sorted."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlake.operators import normalization, retrieval
from reviewlake.streaming import pending_stream

BLOCKS = "document_id string, block_number int, block_type string, paragraph_number int, table_number int, style string, text string, rows array<struct<row_number:int,cells:array<string>>>"


def test_segmentation_deals_documents_by_titles_and_sorts_blocks_once(spark, monkeypatch):
    monkeypatch.setattr(normalization, "TITLES_A_TASK", 3)
    texts = ["x", "Alpha", "one", "Beta", "two", "Conclusion & Recommendations"]
    blocks = spark.createDataFrame([(f"D{d}", i, "paragraph", i, None, None, t, None) for d in range(30) for i, t in enumerate(texts, 1)], BLOCKS)
    registry = spark.createDataFrame([(f"D{d}", o, t) for d in range(30) for o, t in enumerate(["Alpha", "Beta"], 1)], "document_id string, ordinal int, title string")
    raw = normalization.raw_findings(blocks, registry)
    assert sorted((r.document_id, r.block_number, r.finding_id) for r in raw.collect()) == sorted((f"D{d}", b, f) for d in range(30) for b, f in ((2, "FND-000001"), (3, "FND-000001"), (4, "FND-000002"), (5, "FND-000002")))
    plan = normalization.section_records(raw)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\(\w+#\d+, (\d+)\)", plan)) == {"20"} and plan.count("Sort [") == 1


def test_all_that_rests_on_raw_findings_stays_in_its_tasks(spark, monkeypatch):
    """No later step deals or sorts the blocks anew: what a task holds is bounded by its titles in each of these results."""
    monkeypatch.setattr(normalization, "TITLES_A_TASK", 3)
    blocks = spark.createDataFrame([(f"D{d}", 1, "paragraph", 1, None, None, "Alpha", None) for d in range(60)], BLOCKS)
    raw = normalization.raw_findings(blocks, spark.createDataFrame([(f"D{d}", 1, "Alpha") for d in range(60)], "document_id string, ordinal int, title string"))
    for result in (normalization.section_records, normalization.section_summary, normalization.unclassified_paragraphs, normalization.metadata_faults, normalization.metadata, normalization.normalized_findings):
        plan = result(raw)._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"Exchange (\w+)\(\w+#\d+, (\d+)\)", plan) == [("hashpartitioning", "20")] * 2 and plan.count("Exchange ") == 2, result.__name__


def test_top_k_ranks_only_what_cells_pass_on(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELL", 40)
    monkeypatch.setattr(retrieval, "TILE", 7)
    rng, nan = random.Random(3), float("nan")
    kinds = [lambda: [float(rng.randint(-2, 2)) for _ in range(3)], lambda: [rng.random() for _ in range(3)], lambda: [1.0, 2.0], lambda: None, lambda: [1.0, None, 2.0], lambda: [nan, 1.0, 1.0], lambda: [], lambda: [float("inf"), -1.0, 0.0]]
    for one_kind in (False, True):
        rows = [(f"v{i}", kinds[i % 2]() if one_kind or rng.random() < 0.7 else rng.choice(kinds)()) for i in range(150)]
        rows += rows[:5] + [(None, [1.0, 1.0, 1.0])]
        v = spark.createDataFrame(rows, "vec_id string, embedding array<float>").repartition(3)
        q = v.where("cast(substring(vec_id, 2) as int) % 2 = 0").distinct()
        pairs = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("e")).join(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("f")), F.col("id") != F.col("query_id"))
        scored = pairs.select("query_id", "id", retrieval.inner_product(F.col("e"), F.col("f")).alias("score"))
        want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where("rank <= 6")
        got = retrieval.top_k(v, q, 6)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 400
    assert "NestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert retrieval.top_k(v.limit(0), q, 2).count() == 0 and retrieval.top_k(v, q.limit(0), 2).count() == 0


def test_a_limit_is_cut_within_tasks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "GATHERED", 50)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, None]), rng.choice([None, f"k{rng.randint(0, 400)}"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, f int, r string, n int").repartition(3)
    w = Window.partitionBy("g").orderBy(F.col("f").desc(), "r")
    first = lambda x: sorted((r.g or "", r.rank, r.f or 0, r.r or "") for r in x.withColumn("rank", F.row_number().over(w)).where("rank <= 5").collect())
    for kept in (retrieval.KEPT, 3):
        monkeypatch.setattr(retrieval, "KEPT", kept)
        cut = retrieval.first_within_tasks(df, 5, "g", "f", "r")
        assert first(cut) == first(df) and (cut.count() <= 3 * 4 * 5 or kept == 3)
    assert retrieval.first_within_tasks(df.limit(0), 5, "g", "f", "r").count() == 0
    entries = spark.createDataFrame([(f"K{i}", "sop", "critical", ["all"]) for i in range(90)], "kb_id string, category string, severity string, applicable_to array<string>")
    queries = spark.createDataFrame([("Q", None, None, None, None)], "query_id string, taxonomy_codes array<string>, domain string, categories array<string>, min_severity string")
    found = retrieval.retrieve(entries, queries, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.kb_id for r in found.collect()) == ["K0", "K1", "K10"]
    assert plan.index("Sort [") < plan.index("MapInArrow") < plan.index("NestedLoopJoin") and "Sort [" not in plan[plan.index("MapInArrow") :]


def test_look_ups_of_entries_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ENTRIES_A_TASK", 10)
    kb = spark.createDataFrame([(f"K{i}", f"T{i}", None, None, "do", "info") for i in range(60)], "kb_id string, title string, description string, conditions array<string>, action string, severity string")
    hits = spark.createDataFrame([("Q", f"K{i}", i) for i in range(0, 60, 7)], "query_id string, kb_id string, rank int")
    found = retrieval.rules_summary(hits, kb)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count(", 6), REPARTITION_BY_NUM") == 2
    assert sorted((r.rank, r.title) for r in found.collect()) == [(i, f"T{i}") for i in range(0, 60, 7)]


def test_lines_are_dropped_in_one_pass_of_python(spark):
    docs = spark.createDataFrame([(i, f"the same long line\nown line number {i}\n" + ("" if i % 2 else "the same long line"), "en", "s", 1) for i in range(20)] + [(20, None, "en", "s", 0), (21, "the same long line", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.remove_repeated_lines(spark, docs, "")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {0: ("the same long line\nown line number 0\nthe same long line", 55)} | {i: (f"own line number {i}" + ("\n" if i % 2 else ""), 17 + (i > 9) + i % 2) for i in range(1, 20)}


def test_a_pending_finding_costs_no_frames_of_pandas(monkeypatch):
    """A finding's rows are taken as tuples, in order of time, kind and event, and nothing is given back where nothing becomes known."""
    import pandas as pd

    class State:
        exists, kept = False, None

        def update(self, value):
            self.kept = value

    monkeypatch.setattr(pd, "concat", None)
    at = pd.Timestamp("2024-01-01")
    row = lambda kind, action, events, event, minute: {"finding_id": "F", "at": at + pd.Timedelta(minutes=minute), "kind": kind, "action": action, "reason": "r", "resume_events": events, "event": event}
    frames = [pd.DataFrame([row("event", None, None, "b", 1)]), pd.DataFrame([row("check", "pending", ["a", "b"], None, 1), row("event", None, None, "x", 0)])]
    state = State()
    out = list(pending_stream._advance(("F",), iter(frames), state))
    assert [tuple(x)[1:4] for x in pd.DataFrame(out[0]).itertuples(index=False)] == [("held", "r", None), ("resumed", "r", "b")] and state.kept is None
    state = State()
    assert list(pending_stream._advance(("F",), iter([pd.DataFrame([row("event", None, None, "b", 1)])]), state)) == [] and state.kept == (False, None, [], ["b"])


def test_gated_records_are_reviewed_once(spark):
    """Outcomes and faults come from one reading of the records: their plan reads the table no oftener than the records alone."""
    from reviewlake.plans import record_queries

    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    d = "/root/testdata/sf0.001"
    assert 0 < scans(record_queries.QUERIES["gated_counts"](spark, d)) == scans(record_queries._gated(spark, d))
