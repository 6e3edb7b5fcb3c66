"""Queries against their SQL twins on the smallest tables, and hand-made cases for rules and sources."""

import math
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import bands, text
from reviewlake.operators import redaction, retrieval, validation
from reviewlake.operators.review import review, settled
from reviewlake.plans import registry
from reviewlake.plans.check_queries import EXPECTED
from reviewlake.sources import files

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return int(v) if type(v).__name__.startswith("int") else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    result = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def finding(**changes):
    base = {
        "finding_id": "FND-000001", "title": "Hardcoded credential in package", "severity": "critical", "cvss": (9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), "cwe_id": "CWE-798",
        "impact": "Unauthorized access with complete takeover", "observation": "The hardcoded credential is in the package",
        "evidence": [("E1", "command_output", None, "Successfully gained access with the hardcoded credential of the package")], "recommendation": ["Remove the credential", "Rotate the secret"], "retest": (True, "fixed", ["shown"]),
    }
    return base | changes


SCHEMA = "finding_id string, title string, severity string, cvss struct<score:double,vector:string>, cwe_id string, impact string, observation string, evidence array<struct<evidence_id:string,evidence_type:string,description:string,content:string>>, recommendation array<string>, retest struct<applicable:boolean,status:string,evidence:array<string>>"


def reviewed(spark, *rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    return {r["finding_id"]: r for r in review(df).collect()}


def test_review_branches(spark):
    refuted = [("E1", "command_output", None, "confirmed, but no evidence was found of abuse")]
    got = reviewed(
        spark,
        finding(),
        finding(finding_id="FND-000002", evidence=[]),
        finding(finding_id="FND-000003", evidence=[("E1", "scanner_output", None, "port list")], severity="low", cvss=(6.5, None)),
        finding(finding_id="FND-000004", evidence=refuted, severity="medium", cvss=(5.0, "x")),
        finding(finding_id="FND-000005", title=None, severity=None, cvss=None, cwe_id=None, impact=None, observation=None, evidence=None, recommendation=None, retest=None),
    )
    one, two, three, four, five = (got[f"FND-00000{i}"] for i in range(1, 6))
    assert (one["evidence_review"]["is_sufficient"], one["classification"]["label"], one["review_status"]) == (True, "confirmed_vulnerability", "human_review")
    assert one["confidence"]["score"] == 1.0 and one["escalation"]["reasons"] == ["high_severity"]
    assert two["evidence_review"]["is_sufficient"] is None and two["classification"]["supported_by_evidence"] is False
    assert three["evidence_review"]["is_sufficient"] is False and three["severity_review"]["suggested"] == "medium"
    assert four["evidence_review"]["is_sufficient"] is True and four["evidence_review"]["unsupported"] == ["E1"] and four["review_status"] == "pass"
    assert five["completeness"]["missing_required"] == ["title", "severity", "observation", "evidence"] and five["severity_review"]["is_consistent"] is None
    for r in got.values():
        assert [x["comment_id"] for x in r["review_comments"]] == [f"RC-{i:03d}" for i in range(1, len(r["review_comments"]) + 1)]


def test_bands_differ_only_in_gaps(spark):
    scores = [None, 0.0, 0.05, 3.95, 6.95, 8.95, 9.0, 10.0]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    functions = [bands.review_band, bands.quality_band, bands.benchmark_band, bands.merge_band, bands.hard_negative_band]
    got = [tuple(r) for r in df.select(*[f(F.col("s")) for f in functions]).collect()]
    assert got == [
        (None, None, "informational", None, None),
        ("informational",) * 5,
        ("unknown", None, "low", "informational", "low"),
        ("unknown", None, "low", "low", "low"),
        ("unknown", None, "low", "medium", "medium"),
        ("unknown", None, "low", "high", "high"),
        ("critical",) * 5,
        ("critical",) * 5,
    ]


def test_text_functions(spark):
    df = spark.createDataFrame([("CWE-79: Some name", " a b c\x1cd ", "9.8 (cvss:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H)", 'x ```json\n{"a": 1}\n``` y')], "a string, b string, c string, d string")
    r = df.select(text.cwe_id(F.col("a")), text.cwe_description(F.col("a")), text.normalize_whitespace(F.col("b")), text.cvss(F.col("c")), text.json_text(F.col("d")), text.parse_error(F.lit("[1]"))).first()
    assert (r[0], r[1], r[2], r[4], r[5]) == ("CWE-79", "Some name", "a b c d", '{"a": 1}', "FMT-INVALID-JSON")
    assert (r[3]["score"], r[3]["version"], r[3]["vector"], r[3]["parse_successful"]) == (9.8, "3.1", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", True)


def test_redaction(spark):
    rows = [("mail a.b@corp.org or user@example.com",), ("password = hunter22",), ("host 10.1.2.3 and 11.1.2.3",), ("see https://client.io/x and https://owasp.org/y",), ("app-release.apk",), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(redaction.redacted(F.col("t"))).collect()]
    assert out[0] == "mail [REDACTED_EMAIL] or user@example.com" and out[1] == "[REDACTED_CREDENTIAL]"
    assert out[2].startswith("host [REDACTED_") and "[REDACTED_URL]" in out[3] and "owasp.org" in out[3] and out[4] == "[REDACTED_APK]" and out[5] is None


def test_catalogue_and_gold(spark):
    assert len(retrieval.CATALOGUE) == 91
    got = retrieval.retrieval_metrics(retrieval.retrieve(retrieval.catalogue(spark), retrieval.gold_queries(spark)), retrieval.gold_queries(spark)).collect()
    found = {r["query_id"]: (r["retrieved"], r["recall"], r["precision"]) for r in got}
    counts = [11, 12, 10, 19, 17, 23, 17, 19, 19, 13]
    precision = [0.6, 0.4, 0.2, 0.2, 0.0, 0.4, 0.6, 0.2, 0.6, 0.4]
    assert found == {f"Q{i:03d}": (n, 1.0, p) for i, (n, p) in enumerate(zip(counts, precision), 1)}


def test_validation_is_by_hand_listed():
    assert {m for found in EXPECTED.values() for _, m in found} >= {"is not JSON", "has additional properties", "is too short"}
    assert validation.FINDING_SCHEMA["additionalProperties"] is False


def test_docx_blocks(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc>{p('Severity')}</w:tc><w:tc>{p(' High ')}</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Title', 'Heading1')}{table}{p('Body')}</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    blocks = files.read_docx(spark, str(tmp_path / "*.docx"))
    good = blocks.where("error is null").orderBy("block_number").collect()
    assert [(r["block_number"], r["block_type"], r["paragraph_number"], r["table_number"], r["text"]) for r in good] == [(1, "paragraph", 1, None, "Title"), (2, "table", None, 1, None), (3, "paragraph", 2, None, "Body")]
    assert good[1]["rows"][0]["cells"] == ["Severity", "High"] and blocks.where("error is not null").count() == 1
    assert files.headings(blocks.where("error is null")).count() == 1


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"kb_id": "A", "category": "x"}, {"category": "y"}]')
    (tmp_path / "entries.json").write_text('{"entries": [{"kb_id": "B", "category": "x", "severity": "critical"}]}')
    (tmp_path / "one.json").write_text('{"kb_id": "C", "category": "z"}')
    (tmp_path / "bad.json").write_text("{")
    entries, errors = files.read_catalogue(spark, [str(tmp_path)])
    assert {(r["kb_id"], r["severity"]) for r in entries.collect()} == {("A", "info"), ("B", "critical"), ("C", "info")}
    assert sorted(r["error"] for r in errors.collect()) == ["kb_id or category missing", "not JSON"]


def test_settled_keeps_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert sorted(settled(df).collect(), key=str) == sorted(df.collect(), key=str)


def test_top_k_of_more_queries_than_one_block(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5) - 2.0, i / 50]) for i in range(50)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, retrieval.top_k(vectors, vectors, 3).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 7)
    assert sorted(map(tuple, retrieval.top_k(vectors, vectors, 3).collect())) == want and len(want) == 150
