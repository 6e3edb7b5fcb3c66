"""Score vectors, canonical JSON, names, comments and records against published values, other programs and brute force."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions import canonical, cvss, text
from reviewlake.operators import dictionary, normalization, validation
from reviewlake.operators.review import output_record, record_json, recomputed, review
from tests.test_queries import SCHEMA, finding, reviewed

#: Published examples: vector, base, temporal, environmental.
PUBLISHED = [
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8, 9.8, 9.8),
    ("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0, 10.0, 10.0),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1, 6.1, 6.1),
    ("CVSS:3.0/AV:N/AC:L/PR:L/UI:N/S:C/C:L/I:L/A:N", 6.4, 6.4, 6.4),
    ("CVSS:3.1/AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:N/A:N", 3.1, 3.1, 3.1),
    ("CVSS:3.0/AV:N/AC:L/PR:H/UI:N/S:U/C:L/I:L/A:L", 4.7, 4.7, 4.7),
    ("CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H", 7.8, 7.8, 7.8),
    ("CVSS:3.1/AV:P/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 6.8, 6.8, 6.8),
    ("CVSS:3.1/AV:A/AC:L/PR:N/UI:N/S:C/C:H/I:N/A:H", 9.3, 9.3, 9.3),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0, 0.0, 0.0),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N", 7.5, 7.5, 7.5),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H/E:P/RL:O/RC:C", 9.8, 8.8, 8.8),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H/CR:L/IR:L/AR:L", 9.8, 9.8, 8.0),
    ("CVSS:3.1/AC:L/AV:N/PR:N/UI:N/S:U/C:H/I:H/A:H/MAV:X", 9.8, 9.8, 9.8),
]


def test_published_scores(spark):
    df = spark.createDataFrame([(v,) for v, *_ in PUBLISHED], "v string")
    got = df.select(cvss.scores(cvss.decoded(F.col("v"))).alias("s")).select("s.base", "s.temporal", "s.environmental").collect()
    assert [tuple(r) for r in got] == [tuple(x) for _, *x in PUBLISHED]


def test_vectors_without_a_score(spark):
    bad = [None, "", "CVSS:2.0/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H", "CVSS:3.1/AV:N/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
           "CVSS:3.1/AV:Z/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H/", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H/ZZ:N", " CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"]
    df = spark.createDataFrame([(v,) for v in bad], "v string")
    assert all(r[0] is None for r in df.select(cvss.scores(cvss.decoded(F.col("v")))).collect())


def test_round_up_differs_by_version(spark):
    df = spark.createDataFrame([(4.02,), (4.0,), (4.000001,), (8.6 * 1.0000000000000002,)], "x double")
    got = [tuple(r) for r in df.select(cvss.round_up(F.col("x"), F.lit(True)), cvss.round_up(F.col("x"), F.lit(False))).collect()]
    assert got == [(4.1, 4.1), (4.0, 4.0), (4.0, 4.1), (8.6, 8.7)]


def test_recomputed_stands_beside_what_is_reported(spark):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = [finding(), finding(finding_id="FND-000002", cvss=(5.0, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H")), finding(finding_id="FND-000003", cvss=(5.0, None)), finding(finding_id="FND-000004", cvss=None, severity=None)]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    got = {r["finding_id"][-1]: (r["reported"], r["base"], r["matches"], r["band"], r["severity_matches"]) for r in recomputed(df).collect()}
    assert got == {"1": (9.8, 9.8, True, "critical", True), "2": (5.0, 9.8, False, "critical", True), "3": (5.0, None, None, None, None), "4": (None, None, None, None, None)}
    assert {r["cvss_review"]["score_matches_vector"] for r in review(df).collect()} == {None}


# ---------------------------------------------------------------- canonical JSON


TEXTS = ["", "plain", 'quote " and \\ back', "line\nfeed\ttab\r\f\b", "\x00\x01\x1f\x7f", "é ü 漢字", "😀 astral \U0010ffff", "  separator", "</script>", None]
NUMBERS = [0.0, -0.0, 1.0, -1.5, 0.1, 0.3, 1 / 3, 100.0, 123456789.0, 1e7, 1e15, 9999999999999998.0, 1e16, 1.5e16, 1e22, 1.7976931348623157e308, 5e-324, 1e-4, 1.5e-4, 9.999e-5, 1e-5, 1.234e-10, 0.001, 2.5e-3, 12345.678, float("nan"), float("inf"), float("-inf"), None]


def test_texts_as_json(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(canonical.canonical_json(F.col("t"), T.StringType()), canonical.canonical_json(F.col("t"), T.StringType(), ascii=False)).collect()
    assert [tuple(r) for r in got] == [(json.dumps(t), json.dumps(t, ensure_ascii=False)) for t in TEXTS]


def test_numbers_as_json(spark):
    rng = random.Random(2)
    numbers = NUMBERS + [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-20, 25) for _ in range(400)] + [round(rng.random() * 100, 2) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(canonical.canonical_json(F.col("x"), T.DoubleType())).collect()]
    assert got == [json.dumps(x) for x in numbers]


def test_nested_values_as_json(spark):
    kind = "struct<z:int,B:array<struct<y:string,x:double>>,a:struct<q:boolean,m:map<string,array<bigint>>>,`é`:string>"
    values = [
        {"z": 1, "B": [{"y": "q\"", "x": 0.5}, {"y": None, "x": None}, None], "a": {"q": True, "m": {"b": [1, 2], "a": [], "é": None, "Z": [3]}}, "é": "x"},
        {"z": None, "B": [], "a": {"q": False, "m": {}}, "é": None}, {"z": 2, "B": None, "a": None, "é": "\n"}, None,
    ]
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    for ascii in (True, False):
        got = df.select(canonical.canonical_json(F.col("v"), df.schema["v"].dataType, ascii), canonical.canonical_hash(F.col("v"), df.schema["v"].dataType, ascii)).collect()
        told = [json.dumps(v, sort_keys=True, ensure_ascii=ascii) for v in values]
        assert [tuple(r) for r in got] == [(t, hashlib.sha256(t.encode()).hexdigest()[:16]) for t in told]


def test_payloads_of_cases(spark):
    case = {"case_id": "BMC-1", "task_type": "client_qa", "input": {"question": "Wie heißt \"es\"?", "score": 9.8}, "metadata": {"difficulty": "easy", "content_hash": "old"}}
    df = spark.createDataFrame([case], "case_id string, task_type string, input struct<question:string,score:double>, metadata struct<difficulty:string,content_hash:string>")
    got = df.select(*[v.alias(k) for k, v in canonical.payload_hashes(df.schema).items()]).first().asDict()
    digest = lambda x, ascii: hashlib.sha256(json.dumps(x, sort_keys=True, ensure_ascii=ascii).encode()).hexdigest()[:16]
    assert got == {
        "case_hash": digest(case | {"metadata": {"difficulty": "easy"}}, False), "example_hash": digest({k: case[k] for k in ("task_type", "input")}, False),
        "input_hash": digest(case["input"], True), "record_hash": digest(case, True),
    }


def test_types_without_json_are_refused(spark):
    for kind in ("date", "decimal(5,2)", "binary", "map<int,string>"):
        with pytest.raises(TypeError):
            canonical.canonical_json(F.lit(None), T._parse_datatype_string(f"x {kind}")["x"].dataType)


# ---------------------------------------------------------------- names


def brute(text, names, whole):
    low, out = dictionary.lowered(text or ""), {}
    inside = lambda c: c.isalnum() or c == "_"
    for name in {n for n in names if n}:
        form = dictionary.lowered(name)
        places = [i for i in range(len(low) - len(form) + 1) if low.startswith(form, i)]
        if whole:
            places = [i for i in places if not (i and inside(low[i - 1])) and not (i + len(form) < len(low) and inside(low[i + len(form)]))]
        if places:
            out[name] = (places[0], len(places))
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_names_against_brute_force(spark, whole):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abÉéßIİ_") for _ in range(rng.randint(1, 3)))
    names = [" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(2500)] + ["a", "A", "ab ab", "", None, "a"]
    texts = [(i % 90, rng.choice([" ", "-", ", "]).join(word() for _ in range(rng.randint(0, 30)))) for i in range(100)] + [(None, "a A ab ab ab"), (None, None), (7, ""), (8, "ab " * 2000)]
    df, listed = spark.createDataFrame(texts, "k int, t string").repartition(3), spark.createDataFrame([(n,) for n in names], "name string")
    want = sorted((str(k), name, *hit) for k, t in texts for name, hit in brute(t, names, whole).items())
    for limits in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "part_bytes": 20_000}):
        got = dictionary.matches(df, "k", "t", listed, whole_words=whole, **limits)
        assert got.columns == ["k", "name", "first", "n"]
        assert sorted((str(r["k"]), r["name"], r["first"], r["n"]) for r in got.collect()) == want


def test_names_of_empty_tables(spark):
    texts, names = spark.createDataFrame([(1, "a b")], "k int, t string"), spark.createDataFrame([("a",)], "name string")
    for limits in ({}, {"broadcast_bytes": 0}):
        assert dictionary.matches(texts.limit(0), "k", "t", names, **limits).collect() == []
        assert dictionary.matches(texts, "k", "t", names.limit(0), **limits).collect() == []


def test_tables_are_searched_for_any_number_of_words(spark):
    kind = "document_id string, block_type string, table_number int, text string"
    blocks = spark.createDataFrame([("D", "table", 1, "Severity HIGH word1999x"), ("D", "paragraph", None, "severity"), ("E", "table", 1, None)], kind)
    words = spark.createDataFrame([(f"word{i}",) for i in range(3000)] + [("severity",)], "word string")
    got = sorted(tuple(r) for r in normalization.tables_with(blocks, words, F.col("text")).collect())
    assert got == [("D", 1, "severity"), ("D", 1, "word1"), ("D", 1, "word19"), ("D", 1, "word199"), ("D", 1, "word1999")]


# ---------------------------------------------------------------- comments and records


def test_comments_have_their_field_and_action(spark):
    refuted = [("E1", "command_output", None, "confirmed, but no evidence was found of abuse")]
    got = reviewed(spark, finding(finding_id="FND-000001", evidence=[], severity=None, title="  ", cwe_id="CWE9", recommendation=[]), finding(finding_id="FND-000002", evidence=refuted, cvss=(5.0, "x")))
    told = {k: [(x["taxonomy_code"], x["severity"], x["field"], x["suggested_action"], x["evidence_reference"]) for x in r["review_comments"]] for k, r in got.items()}
    one, two = told["FND-000001"], told["FND-000002"]
    assert one[:4] == [("COMP-001", "error", "title", "provide_missing_content", None), ("COMP-001", "error", "severity", "provide_missing_content", None), ("COMP-002", "error", "evidence", "provide_exploitation_evidence", None), ("COMP-003", "warning", "recommendation", "add_recommendation", None)]
    assert ("CLASS-002", "error", "classification", "provide_evidence_or_mark_as_informational", None) in one and ("SEV-002", "warning", "severity", "assign_severity", None) in one
    assert ("CWE-001", "warning", "cwe_id", "correct_cwe_id_format", None) in one and ("REC-003", "error", "recommendation", "add_recommendation", None) in one
    assert ("EVID-002", "warning", "evidence", "confirm_classification_as_potential_issue", "E1") in two and ("CVSS-001", "warning", "cvss.vector", "verify_cvss_vector", None) in two
    assert two[-1] == ("CONS-008", "info", "consistency", "review_all_consistency_flags", None)


def test_confidence_says_what_it_rests_on(spark):
    got = reviewed(spark, finding(), finding(finding_id="FND-000002", evidence=[], severity="low", retest=None))
    assert got["FND-000001"]["confidence"]["limitations"] == [] and len(got["FND-000001"]["confidence"]["basis"]) == 5
    two = got["FND-000002"]["confidence"]
    assert two["basis"] == ["Evidence is insufficient to support the claim", "Classification has moderate support"]
    assert two["limitations"] == ["Evidence is insufficient or absent", "CVSS score and reported severity are inconsistent", "Some required sections are missing or incomplete", "No retest has been performed"]


def test_records_keep_to_the_whole_schema(spark):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    none = dict.fromkeys(("title", "severity", "cvss", "cwe_id", "impact", "observation", "evidence", "recommendation", "retest"))
    rows = [finding(), finding(finding_id="FND-000002", **none), finding(finding_id="FND-000003", retest=(True, "someday", []), recommendation=["Talk"], evidence=[(None, None, None, None)])]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA).withColumn("document_id", F.lit("DOC-000001"))
    records = output_record(review(df), F.lit("2024-01-01T00:00:00Z"), {"knowledge_base_version": "1", "ruleset_version": "1.0"})
    told = records.select("finding_id", record_json(records).alias("raw"))
    assert validation.errors(told, "finding_id", "raw", validation.REVIEW_SCHEMA).collect() == []
    assert {json.loads(r["raw"])["retest_review"]["reported_status"] for r in told.collect()} == {"fixed", None, "unknown"}


def test_date_times(spark):
    good = ["2024-01-01T00:00:00Z", "2024-02-29t23:59:60.123+01:00", "2024-01-01T00:00:00-23:59"]
    bad = ["2024-01-01", "2023-02-29T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z", "2024-01-01 00:00:00Z", "x2024-01-01T00:00:00Z"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in good + bad], "t string").select(validation.is_date_time(F.col("t"))).collect()]
    assert got == [True] * len(good) + [False] * len(bad)
    assert validation.schema_faults({"type": "string", "format": "uuid"}) == ["#: format uuid is not understood"]


def test_character_references(spark):
    import html

    texts = ["https:&#x2F;&#47;a.io&sol;x?a=1&amp;b=2", "&amp;lt; stays &lt;", "a&nbsp;b &#x1F600; &eacute; &#0; &#55296; &#x110000; & &; &#;", "no reference", "", None, "&lt;&gt;", "&#38;amp;", "x&ndash;y&euro;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.unescape_html(F.col("t"))).collect()]
    kept = "a\u00a0b \U0001f600 &eacute; &#0; &#55296; &#x110000; & &; &#;"
    assert got == [kept if t and "eacute" in t else t and html.unescape(t) for t in texts]
    assert spark.createDataFrame([("see https:&#x2F;&#x2F;host.example&sol;a).",)], "t string").select(text.first_url(F.col("t"))).first()[0] == "https://host.example/a"
