"""The specification's checklist, findings that wait on a stream, and segmentation in one pass."""

import random
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import dataset, normalization, validation
from reviewlake.operators.review import review
from reviewlake.operators.spec_checklist import spec_checklist
from reviewlake.streaming import pending_stream
from tests.test_queries import SCHEMA, finding

TARGETS = "affected_targets array<struct<target_type:string,value:string>>, severity_override_reason string, recheck_round int"


def item(text, kind="reproduction_steps"):
    return ("E1", kind, None, text)


STEPS = item("Run the request and observe that the hardcoded credential of the package successfully opens it")
SOUND = dict(affected_targets=[("api", "https://a.example")], severity_override_reason=None, recheck_round=0, evidence=[STEPS], severity="high", cvss=(7.5, None), impact="Complete use of the credential of the package")


def checked(spark, **cases):
    names = [x.split()[0] for x in f"{SCHEMA}, {TARGETS}".split(", ")]
    rows = []
    for i, changes in enumerate(cases.values()):
        row = finding(finding_id=f"FND-{i:06d}") | SOUND | changes
        rows.append(tuple(row[n] for n in names))
    got = {r["finding_id"]: r for r in spec_checklist(review(spark.createDataFrame(rows, f"{SCHEMA}, {TARGETS}"))).collect()}
    return {name: got[f"FND-{i:06d}"] for i, name in enumerate(cases)}


def test_each_check_and_each_outcome(spark):
    quiet = item("Run the request of the hardcoded credential in the package: no evidence was found of abuse", "manual_observation")
    got = checked(
        spark,
        sound={}, no_asset=dict(affected_targets=[], severity="low", cvss=(3.0, None)), no_asset_serious=dict(affected_targets=None), placeholder=dict(affected_targets=[("api", " N/A ")], severity="low", cvss=(3.0, None)), untyped_asset=dict(affected_targets=[(None, "x")]),
        named=dict(affected_targets=[], severity="low", cvss=(3.0, None), observation="The hardcoded credential is at https://host.example/x"), named_again=dict(affected_targets=[], severity="low", cvss=(3.0, None), observation="The hardcoded credential is at https://host.example/x", recheck_round=1),
        no_evidence=dict(evidence=None), scanner=dict(evidence=[item("hardcoded credential listed in package", "scanner_output")]), untyped=dict(evidence=[item("the hardcoded credential of the package was used", None)]), untyped_steps=dict(evidence=[item("run the hardcoded credential of the package", None)]),
        contradiction=dict(evidence=[STEPS, item("hardcoded credential of the package: not demonstrated")]), elsewhere=dict(evidence=[STEPS, item("something else altogether")]), quiet=dict(evidence=[quiet], severity="medium", cvss=(5.0, None)),
        unclear=dict(evidence=[item("the hardcoded credential of the package successfully opens it")]), generic=dict(impact="This may lead to exposure"), no_impact=dict(impact=None), unsupported=dict(impact="Complete compromise of the credential"), unsupported_again=dict(impact="Complete compromise of the credential", recheck_round=1), mild=dict(impact="Use of the package"),
        underrated=dict(severity="medium"), overrated=dict(severity="critical"), overridden=dict(severity="medium", severity_override_reason="agreed"), mean=dict(severity="low", cvss=(3.0, None)),
        lacking=dict(evidence=[item("hardcoded credential of the package: not demonstrated")]), lacking_again=dict(evidence=[item("hardcoded credential of the package: not demonstrated")], recheck_round=1),
    )
    action = {name: {x["check_id"][-1]: x["action"] for x in r["checklist"]} for name, r in got.items()}
    want = {
        "sound": {}, "no_asset": {"1": "request_data"}, "no_asset_serious": {"1": "escalate"}, "placeholder": {"1": "request_data"}, "untyped_asset": {"1": "request_data"}, "named": {"1": "recheck"}, "named_again": {"1": "request_data"},
        "no_evidence": {"2": "request_data", "3": "request_data", "4": "request_data"}, "scanner": {"2": "escalate", "7": "escalate"}, "untyped": {"2": "request_data"}, "untyped_steps": {"2": "recheck"}, "contradiction": {"3": "escalate", "8": "warn"}, "elsewhere": {"3": "escalate"},
        "quiet": {"3": "request_data", "7": "pending", "8": "recheck"}, "unclear": {"4": "warn"}, "generic": {"5": "request_data"}, "no_impact": {"5": "request_data"}, "unsupported": {"5": "recheck", "8": "recheck"}, "unsupported_again": {"5": "warn", "8": "warn"}, "mild": {"5": "warn"},
        "underrated": {"6": "escalate"}, "overrated": {"6": "escalate"}, "overridden": {"6": "warn"}, "mean": {"6": "escalate"}, "lacking": {"3": "request_data", "8": "recheck"}, "lacking_again": {"8": "escalate"},
    }
    for name, some in want.items():
        assert all(action[name][k] == v for k, v in some.items()), (name, action[name])
    assert set(action["sound"].values()) == {"pass"} and got["sound"]["overall_action"] == "pass" and got["sound"]["validated_status"] == got["sound"]["review_status"]
    quiet = got["quiet"]
    assert quiet["overall_action"] == "pending" and quiet["validated_status"] == "pending" and quiet["pending"]["resume_events"] == ["data_response_received", "retest_completed", "manual_verification_added"]
    assert [(x["field"], x["urgency"], x["requested_from"]) for x in got["no_evidence"]["data_requests"]] == [("evidence", "high", "pentester"), ("evidence", "medium", "pentester"), ("evidence", "medium", "pentester")]
    assert got["scanner"]["escalation_reviewer"] == "technical_reviewer" and got["underrated"]["escalation_reasons"] == ["Severity underrated, the score implies a higher one"]
    assert got["overridden"]["overall_action"] in ("warn", "request_data", "recheck") and got["overridden"]["pending"] is None


def test_states_of_one_finding():
    check = lambda action: SimpleNamespace(kind="check", action=action, reason="r", resume_events=["a", "b"] if action == "pending" else None, event=None)
    event = lambda name: SimpleNamespace(kind="event", action=None, reason=None, resume_events=None, event=name)

    def told(*changes):
        state, out = (False, None, [], []), []
        for x in changes:
            state, said = pending_stream.next_state(state, x)
            out += [said and said[0]]
        return out

    assert told(check("pending"), event("x"), event("b"), event("a")) == ["held", None, "resumed", None]
    assert told(event("a"), check("pending"), event("b")) == [None, "resumed", None]
    assert told(event("x"), check("pending"), check("pending"), check("pass"), check("pass")) == [None, "held", None, "closed", None]
    assert told(check("escalate"), check("pending"), check("escalate"), check("pending"), event("a")) == [None, "held", "closed", "held", "resumed"]


def test_a_pending_finding_resumes_in_a_later_run(spark, tmp_path):
    row = lambda key, at, **x: (key, f"2024-01-01 00:{at:02d}:00", x.get("kind", "check"), x.get("action"), x.get("reason"), x.get("events"), x.get("event"))
    kind = pending_stream.CHANGES.replace("at timestamp", "at string")
    wait = dict(action="pending", reason="risk", events=["retest_completed"])
    runs = [
        [row("A", 1, **wait), row("B", 1, **wait), row("C", 1, action="pass"), row("D", 0, kind="event", event="retest_completed"), row(None, 1, **wait), row("E", 2, **wait), row("E", 3, action="pass")],
        [row("A", 5, kind="event", event="retest_completed"), row("B", 5, kind="event", event="other"), row("D", 5, **wait), row("C", 5, kind="event", event="retest_completed")],
        [row("B", 9, action="escalate"), row("A", 9, kind="event", event="retest_completed")],
    ]
    for rows in runs:
        spark.createDataFrame(rows, kind).withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(pending_stream.CHANGES).parquet(f"{tmp_path}/in")
        pending_stream.run_pending(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = Counter((r["finding_id"], r["change"], r["event"]) for r in spark.read.schema(pending_stream.OUTCOMES).parquet(f"{tmp_path}/out").collect())
    assert got == Counter([("A", "held", None), ("B", "held", None), ("E", "held", None), ("E", "closed", None), ("A", "resumed", "retest_completed"), ("D", "resumed", "retest_completed"), ("B", "closed", None)])


# ---------------------------------------------------------------- segmentation

BLOCKS = "document_id string, block_number int, block_type string, paragraph_number int, table_number int, style string, text string, rows array<struct<row_number:int,cells:array<string>>>"


def by_hand(blocks, registry):
    """Blocks of sound documents with their finding, one document after another."""
    out = []
    for doc in {b[0] for b in blocks}:
        own = sorted((b for b in blocks if b[0] == doc), key=lambda b: b[1])
        titles = [(o, t) for d, o, t in sorted((r for r in registry if r[0] == doc), key=lambda r: r[1])]
        at = {}
        for o, t in titles:
            at[o] = [b[1] for b in own if b[2] == "paragraph" and b[6] is not None and b[6].lower() == t.lower()]
        if not titles or any(len(x) != 1 for x in at.values()) or len({t.lower() for _, t in titles}) < len(titles):
            continue
        starts = [at[o][0] for o, _ in titles]
        ends = [b[1] for b in own if b[2] == "paragraph" and (b[6] or "").lower() == "conclusion & recommendations" and b[1] > starts[-1]]
        if starts != sorted(starts) or not ends:
            continue
        for b in own:
            owner = [o for o, s in zip([o for o, _ in titles], starts) if s <= b[1]]
            if owner and b[1] < ends[0]:
                out.append((doc, b[1], f"FND-{owner[-1]:06d}"))
    return out


def test_segmentation_by_brute_force(spark):
    rng = random.Random(6)
    blocks, registry = [], []
    for d in range(120):
        texts = [rng.choice(["Alpha", "ALPHA", "Beta", "Gamma", "other", "", None, "Conclusion & Recommendations"]) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.7:
            texts = ["x", "Alpha", "other", *(["Beta", None] if rng.random() < 0.8 else []), "conclusion & recommendations", "x"] + texts[:2]
        for i, t in enumerate(texts):
            table = rng.random() < 0.1
            blocks.append((f"D{d}", i + 1, "table" if table else "paragraph", i, None, None, t, [(1, ["a", "b"])] if table else None))
        registry += [(f"D{d}", o, t) for o, t in enumerate(["Alpha", "Beta", "gamma"][: rng.randint(0, 3)], 1)]
    rng.shuffle(blocks)
    raw = normalization.raw_findings(spark.createDataFrame(blocks, BLOCKS).repartition(3), spark.createDataFrame(registry, "document_id string, ordinal int, title string"))
    want = sorted(by_hand(blocks, registry))
    assert sorted((r["document_id"], r["block_number"], r["finding_id"]) for r in raw.collect()) == want and len(want) > 60
    plan = normalization.normalized_findings(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("rows", [[], [("D", 1, "paragraph", 1, None, None, None, None)]])
def test_segmentation_of_little(spark, rows):
    registry = spark.createDataFrame([("D", 1, "Alpha"), ("E", 1, None)], "document_id string, ordinal int, title string")
    raw = normalization.raw_findings(spark.createDataFrame(rows, BLOCKS), registry)
    for table in (raw, normalization.normalized_findings(raw), normalization.section_summary(raw), normalization.metadata_faults(raw), normalization.section_faults(raw), normalization.unclassified_paragraphs(raw)):
        assert table.collect() == []


def test_wrong_severities_can_be_given(spark):
    findings = spark.createDataFrame([("A", (9.8,)), ("B", (5.0,)), ("C", (None,))], "finding_id string, cvss struct<score:double>")
    given = spark.createDataFrame([("A", "low"), ("C", "high"), ("X", "high")], "finding_id string, severity string")
    assert sorted(map(tuple, dataset.wrong_severities(findings, given).collect())) == [("A", "critical", "low"), ("B", "medium", "informational")]
    assert sorted(map(tuple, dataset.wrong_severities(findings).collect())) == [("A", "critical", "medium"), ("B", "medium", "informational")]


def test_schema_checks_read_each_value_once(spark):
    """Types are worked out once for each place of the schema, and nothing of it is planned again beside the explode."""
    schema = {"type": "object", "additionalProperties": False, "required": ["a", "b"], "properties": {"a": {"type": "object", "required": ["c"], "properties": {"c": {"type": "string", "minLength": 1}}}, "b": {"enum": ["x", None]}}}
    rows = spark.createDataFrame([(1, '{"a": {"c": ""}, "b": null}'), (2, '{"a": {}, "z": 1}'), (3, "{"), (4, '{"a": 5, "b": "x"}'), (5, None)], "k long, raw string")
    found = validation.errors(rows, "k", "raw", schema)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schemaOfVariant(") == 4
    assert sorted(map(tuple, found.collect())) == [
        (1, "a.c", "is too short"), (2, "<root>", "has additional properties"), (2, "<root>", "lacks required property b"), (2, "a", "lacks required property c"), (3, "<root>", "is not JSON"), (4, "a", "is not of type object"), (5, "<root>", "is not JSON"),
    ]
