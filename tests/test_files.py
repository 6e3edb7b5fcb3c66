"""Sources and sinks, settings, the vector index, blocks of queries, and the schema's own check."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reviewlake.operators import normalization, retrieval, segmentation, validation
from reviewlake.operators.review import output_record, review
from reviewlake.sources import files

from .test_queries import finding, SCHEMA


def test_jsonl_with_numbers_and_missing_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": "1"}\n\n{"a": "2"}\nbad\n')
    path = str(tmp_path / "a.jsonl")
    assert [(r["line"], r["raw"]) for r in files.read_jsonl_numbered(spark, path).orderBy("line").collect()] == [(1, '{"a": "1"}'), (3, '{"a": "2"}'), (4, "bad")]
    for schema in ("a string", StructType([StructField("a", StringType())])):
        assert sorted(str(r["a"]) for r in files.read_jsonl(spark, path, schema).collect()) == ["1", "2", "None"]
        assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), schema, missing_is_empty=True).count() == 0


def test_settings(spark, tmp_path):
    assert files.read_manifest(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "m.json").write_text('{"sop": 19}')
    assert files.read_manifest(spark, str(tmp_path / "m.json")) == {"sop": 19}
    (tmp_path / "c.yaml").write_text("# settings\nepochs: 3\nname: 'x'\n")
    assert files.read_config(spark, str(tmp_path / "c.yaml"), {"epochs": 1, "name": "y", "rate": 0.1}) == {"epochs": 3, "name": "x", "rate": 0.1}
    with pytest.raises(ValueError, match="unknown settings"):
        files.read_config(spark, str(tmp_path / "c.yaml"), {"epochs": 1})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    files.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    files.append_jsonl(spark.createDataFrame([(2, "y"), (3, "z")], "a int, b string"), df, "a", str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "k")).count() == 3
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_defects(spark, str(tmp_path / "c"), ["a", "b"]).count() == 2
    assert json.loads(files.pretty_json(df.orderBy("a")))[1] == {"a": 2, "b": "x"} and "| 2 | x |" in files.markdown_table(df, "t")
    with pytest.raises(ValueError, match="more than 1"):
        files.pretty_json(df, 1)
    files.write_both(df, str(tmp_path / "both"))
    assert spark.read.json(str(tmp_path / "both/jsonl")).count() == 2 and len(json.loads(spark.read.text(str(tmp_path / "both/json"), wholetext=True).first()[0])) == 2
    blocks = spark.createDataFrame([("Heading 1",), ("heading 2",), ("Body",), (None,)], "style string")
    assert files.styled(blocks, "HEADING").count() == 2


def test_schema_checks_itself():
    assert validation.schema_faults(validation.NORMALIZED_SCHEMA) == [] == validation.schema_faults(validation.FINDING_SCHEMA)
    bad = {"type": "thing", "maxLength": 3, "properties": {"a": {"$ref": "#/$defs/none"}}, "required": ["b"], "additionalProperties": False}
    assert len(validation.schema_faults(bad)) == 4


def test_schema_file_and_nested_items(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"type": "object", "properties": {"x": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}}}}))
    schema = files.read_schema(spark, str(tmp_path / "s.json"))
    rows = spark.createDataFrame([(1, '{"x": [{"k": 1}, {"k": "a"}, {}]}'), (2, '{"x": []}'), (3, "{}")], "id int, raw string")
    got = {(r["id"], r["path"], r["message"]) for r in validation.errors(rows, "id", "raw", schema).collect()}
    assert got == {(1, "x[1].k", "is not of type integer"), (1, "x[2]", "lacks required property k")}


def test_vector_index(spark, tmp_path):
    kb = spark.createDataFrame([("KB-1", "sop", "t", None, ["c"], "a"), ("KB-2", "taxonomy", "u", "d", [], "")], "kb_id string, category string, title string, description string, conditions array<string>, action string")
    vectors = spark.createDataFrame([("KB-1", [3.0, 4.0]), ("KB-2", [0.0, 2.0])], "kb_id string, embedding array<double>")
    retrieval.write_index(kb, vectors, str(tmp_path / "index"))
    got = {r["kb_id"]: (r["text"], r["embedding"]) for r in spark.read.parquet(str(tmp_path / "index")).collect()}
    assert got == {"KB-1": ("[KB-1] t\nConditions: c\nAction: a", [0.6, 0.8]), "KB-2": ("[KB-2] u\nd", [0.0, 1.0])}


def test_retrieval_of_more_queries_than_one_block(spark, monkeypatch):
    kb = spark.createDataFrame([(f"K{i:02d}", "sop", "info", ["all"]) for i in range(30)], "kb_id string, category string, severity string, applicable_to array<string>")
    queries = spark.createDataFrame([(f"Q{i}", None, "all", None, None) for i in range(12)], "query_id string, taxonomy_codes array<string>, domain string, categories array<string>, min_severity string")
    want = sorted(map(tuple, retrieval.retrieve(kb, queries, 4).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 5)
    assert sorted(map(tuple, retrieval.retrieve(kb, queries, 4).collect())) == want and len(want) == 48


def test_output_record_has_eighteen_fields(spark):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    row = finding()
    df = spark.createDataFrame([tuple(row[n] for n in names)], SCHEMA).withColumn("document_id", F.lit("DOC-000001"))
    record = output_record(review(df), F.lit("2024-01-01T00:00:00Z"), {"knowledge_base_version": "1", "ruleset_version": "1.0"})
    assert len(record.columns) == 18 and not any("IMP-" in str(x) for x in record.first())


def test_review_of_named_outputs_is_that_of_all(spark):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = [finding(), finding(finding_id="FND-000002", evidence=[], severity=None)]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    every = {r["finding_id"]: r for r in review(df).collect()}
    for only in (["severity_review"], ["review_status", "confidence"], ["review_comments"]):
        plan = review(df, only=only)
        if only == ["severity_review"]:
            assert "CONS-" not in plan._jdf.queryExecution().optimizedPlan().toString()
        assert all(r[name] == every[r["finding_id"]][name] for r in plan.collect() for name in only)


def test_titles_are_matched_without_case_only(spark):
    blocks = spark.createDataFrame([("D", 1, "paragraph", 1, None, None, "TITLE", None), ("D", 2, "paragraph", 2, None, None, "body", None), ("D", 3, "paragraph", 3, None, None, "Conclusion & Recommendations", None)], "document_id string, block_number int, block_type string, paragraph_number int, table_number int, style string, text string, rows array<struct<row_number:int,cells:array<string>>>")
    registry = spark.createDataFrame([("D", 1, "Title")], "document_id string, ordinal int, title string")
    raw = normalization.raw_findings(blocks, registry)
    assert [(r["block_number"], r["finding_id"]) for r in raw.orderBy("block_number").collect()] == [(1, "FND-000001"), (2, "FND-000001")]
    none = spark.createDataFrame([], registry.schema)
    assert normalization.raw_findings(blocks, none).count() == 0 and normalization.normalized_findings(raw).count() == 0


def test_repeated_fields_take_the_first_in_order(spark):
    rows = spark.createDataFrame([("f", 2, "Severity", "low"), ("f", 1, "Severity:", "high")], "k string, n int, label string, value string")
    assert segmentation.pivot_fields(rows, "k", "label", "value", "n").first()["severity"] == "high"
