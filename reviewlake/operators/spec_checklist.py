"""The eight checks of the self-validation specification over a review, with data requests, pending objects and re-checks.

Beside ``selfcheck`` (what the review runs) this is the longer list that the specification asks for: asset, evidence source, alignment,
reproducibility, impact, severity, false positives, unsupported claims. Each check gives one action; the overall one is that of highest
priority: escalate, pending, request_data, recheck, warn, pass. Everything is row-local.

Where the specification leaves a choice to a reader, it is made here: evidence contradicts a claim if one item shows exploitation and
another denies it; a claim is the main one if no item shows exploitation; a missing impact is asked for; a finding that has been
re-checked (``recheck_round`` over 0) is not re-checked again but takes the outcome named for that. ``affected_targets``,
``severity_override_reason`` and ``recheck_round`` may be absent from the findings and count as null then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import any_of, first_url, lookup
from .review import settled

c = F.col

# Fixed values of the specification.
PRIORITY = {"escalate": 5, "pending": 4, "request_data": 3, "recheck": 2, "warn": 1, "pass": 0}
PLACEHOLDERS = ["", "n/a", "tbd", "unknown"]
ACTION_VERBS = ["navigate", "submit", "configure", "extract", "attach", "run", "send"]
OUTCOMES = ["observe", "confirm", "verify", "should see"]
GENERIC_IMPACT = ["may lead to", "could potentially", "an attacker might"]
RESUME_CONDITION = "manual_verification_provided OR retest_completed"
RESUME_EVENTS = ["data_response_received", "retest_completed", "manual_verification_added"]
STATUS_OF_ACTION = {"escalate": "human_review", "pending": "pending", "request_data": "needs_revision"}

#: Outputs of the review that the checks read.
READS = ["evidence_review", "classification", "severity_review", "impact_review", "consistency", "review_status"]
_REQUEST = "struct<field:string,reason:string,urgency:string,requested_from:string,suggested_format:string>"


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _result(action: str, detail: str | None = None, reviewer: str | None = None, ask: tuple[str, str, str] | None = None) -> Column:
    """(action, detail, reviewer, request); ``ask`` is field, urgency and form of what is asked for, its reason the detail."""
    request = F.lit(None).cast(_REQUEST)
    if ask:
        field, urgency, form = ask
        request = F.struct(F.lit(field).alias("field"), F.lit(detail).alias("reason"), F.lit(urgency).alias("urgency"), F.lit("pentester").alias("requested_from"), F.lit(form).alias("suggested_format"))
    return F.struct(F.lit(action).alias("action"), F.lit(detail).cast("string").alias("detail"), F.lit(reviewer).cast("string").alias("reviewer"), request.alias("request"))


def _first(*cases: tuple[Column, Column]) -> Column:
    """The result of the first condition that holds, else pass."""
    out = None
    for cond, result in cases:
        out = F.when(_true(cond), result) if out is None else out.when(_true(cond), result)
    return out.otherwise(_result("pass"))


def prepared(reviews: DataFrame) -> DataFrame:
    """The columns the checks read, under working names."""
    has = lambda name, kind: c(name) if name in reviews.columns else F.lit(None).cast(kind)
    text = lambda e: F.lower(F.concat(F.coalesce(e.description, F.lit("")), F.lit(" "), F.coalesce(e.content, F.lit(""))))
    items = F.transform(F.coalesce("evidence", F.array().cast(reviews.schema["evidence"].dataType)), lambda e: F.struct(F.coalesce(e.evidence_type, F.lit("")).alias("type"), text(e).alias("text")))
    return settled(reviews.withColumns({
        "s_items": items,
        "s_targets": has("affected_targets", "array<struct<target_type:string,value:string>>"),
        "s_override": F.trim(F.coalesce(has("severity_override_reason", "string"), F.lit(""))) != "",
        "s_round": F.coalesce(has("recheck_round", "int"), F.lit(0)),
        "s_observation": F.lower(F.coalesce("observation", F.lit(""))),
        "s_impact": F.lower(F.coalesce("impact", F.lit(""))),
    }))


def false_positive_probability() -> Column:
    """The largest of the signals: scanner only 0.9; evidence that finds nothing 0.6; nothing exploited in a serious finding 0.6; else 0.1."""
    manual = F.exists("s_items", lambda e: e.type.isin(V.MANUAL_EVIDENCE))
    scanner_only = F.exists("s_items", lambda e: e.type == "scanner_output") & ~manual
    nothing = F.exists("s_items", lambda e: F.contains(e.text, F.lit("no evidence was found")))
    unexploited = (F.exists("s_items", lambda e: F.contains(e.text, F.lit("no successful exploitation"))) | F.contains("s_observation", F.lit("no successful exploitation"))) & _true(c("severity").isin("critical", "high"))
    return F.when(scanner_only, 0.9).when(nothing | unexploited, 0.6).otherwise(0.1)


def checks() -> list[tuple[str, Column]]:
    """(check id, result) in order, over ``prepared`` reviews."""
    label, high = c("classification.label"), c("severity").isin("critical", "high")
    again = c("s_round") > 0
    none = F.size("s_items") == 0
    manual = F.exists("s_items", lambda e: e.type.isin(V.MANUAL_EVIDENCE))
    scanner = F.exists("s_items", lambda e: e.type == "scanner_output")
    untyped = F.exists("s_items", lambda e: e.type.isin("", "unknown"))
    steps_told = F.exists("s_items", lambda e: any_of(e.text, ACTION_VERBS))
    steps = F.filter("s_items", lambda e: e.type == "reproduction_steps")
    clear = F.exists(steps, lambda e: any_of(e.text, ACTION_VERBS)) & F.exists(steps, lambda e: any_of(e.text, OUTCOMES))
    untargeted = F.coalesce(F.size("s_targets"), F.lit(0)) <= 0
    blank = lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))).isin(PLACEHOLDERS)
    unnamed = F.exists("s_targets", lambda t: blank(t.value))
    unkinded = F.exists("s_targets", lambda t: F.coalesce(t.target_type, F.lit("")) == "")
    named_in_text = first_url(c("s_observation")).isNotNull() | c("s_observation").rlike(r"\b\d{1,3}(\.\d{1,3}){3}\b")
    denied, shown = F.size("evidence_review.unsupported") > 0, F.size("evidence_review.shown") > 0
    elsewhere = F.array_contains("consistency.issues", "CONS-006")
    sufficient = c("evidence_review.is_sufficient")
    supported, proportionate = c("impact_review.is_supported"), c("impact_review.is_proportionate")
    mismatch = ~c("severity_review.is_consistent")
    order = {name: i for i, name in enumerate(["informational", "low", "medium", "high", "critical"])}
    level = lambda x: F.try_element_at(lookup(order), x)
    under = level(c("severity_review.reported")) < level(c("severity_review.implied"))
    probability = false_positive_probability()
    return [
        ("SV-001", _first(
            ((untargeted | unnamed) & high, _result("escalate", "Serious finding without an identifiable asset", "senior_pentester")),
            (untargeted & named_in_text & ~again, _result("recheck", "The observation names a target that the finding does not list")),
            (untargeted, _result("request_data", "No identifiable asset in finding", ask=("affected_targets", "medium", "target type and identifier"))),
            (unnamed, _result("request_data", "Asset identifier is placeholder", ask=("affected_targets[0].value", "medium", "address, host or package name"))),
            (unkinded, _result("request_data", "Asset has no type", ask=("affected_targets[0].target_type", "low", "target type"))),
        )),
        ("SV-002", _first(
            (none, _result("request_data", "No evidence provided for this finding", ask=("evidence", "high", "reproduction_steps or manual_verification_notes"))),
            (scanner & ~manual, _result("escalate", "Scanner-only finding requires human verification", "technical_reviewer")),
            (untyped & steps_told & ~again, _result("recheck", "Evidence type can be told from its content")),
            (untyped, _result("request_data", "Cannot determine evidence source", ask=("evidence[0].evidence_type", "medium", "evidence type"))),
        )),
        ("SV-003", _first(
            (denied & shown, _result("escalate", "Evidence contradicts vulnerability claim", "senior_pentester")),
            (elsewhere, _result("escalate", "Evidence appears to describe a different vulnerability", "technical_reviewer")),
            (denied, _result("request_data", "Claims are not supported, additional evidence is needed", ask=("evidence", "medium", "evidence of exploitation"))),
            (~_true(sufficient), _result("request_data", "Evidence is incomplete and does not fully demonstrate exploitation", ask=("evidence", "medium", "evidence of exploitation"))),
        )),
        ("SV-004", _first(
            ((F.size(steps) == 0) & label.isin("informational", "false_positive"), _result("warn", "No reproduction steps; such a finding may not need them")),
            (F.size(steps) == 0, _result("request_data", "No reproduction steps provided", ask=("evidence", "medium", "reproduction_steps"))),
            (~clear, _result("warn", "Reproduction steps lack clarity")),
        )),
        ("SV-005", _first(
            (c("s_impact") == "", _result("request_data", "Impact is missing", ask=("impact", "medium", "finding-specific impact"))),
            (any_of(c("s_impact"), GENERIC_IMPACT), _result("request_data", "Impact description is generic", ask=("impact", "low", "finding-specific impact"))),
            (~supported & ~again, _result("recheck", "Impact is not supported by evidence")),
            (~supported, _result("warn", "Impact is not supported by evidence after a re-check")),
            (~proportionate, _result("warn", "Impact may not be proportionate to severity")),
        )),
        ("SV-006", _first(
            (mismatch & ~c("s_override") & under, _result("escalate", "Severity underrated, the score implies a higher one", "report_reviewer")),
            (mismatch & ~c("s_override"), _result("escalate", "Severity overrated, the score implies a lower one", "report_reviewer")),
            ((label == "confirmed_vulnerability") & (level(c("severity")) < order["medium"]), _result("escalate", "Confirmed vulnerability below medium severity", "senior_pentester")),
            (mismatch, _result("warn", "Severity differs from the score with a reason given")),
        )),
        ("SV-007", _first(
            (label == "false_positive", _result("pass")),
            (probability >= 0.9, _result("escalate", "High false positive probability, scanner only", "technical_reviewer")),
            (probability >= 0.6, _result("pending", "Moderate false positive risk, awaiting additional verification")),
        )),
        ("SV-008", _first(
            (denied & ~shown & again, _result("escalate", "The main claim lacks evidence after a re-check", "technical_reviewer")),
            (denied & ~shown, _result("recheck", "The main claim lacks evidence")),
            ((F.size("impact_review.unsupported") > 0) & ~again, _result("recheck", "Impact claims lack evidence")),
            ((F.size("impact_review.unsupported") > 0) | denied, _result("warn", "Minor claims lack evidence support")),
        )),
    ]


def spec_checklist(reviews: DataFrame) -> DataFrame:
    """Adds to reviews: checklist, overall_action, recheck_items, data_requests, pending, escalation_reasons, escalation_reviewer, false_positive_probability, validated_status.

    ``checklist`` has check_id, status (pass or fail), action, detail, reviewer and request of each check. ``pending`` is null unless
    the overall action is pending. The reviewer is that of the first check that escalates. ``validated_status`` is the review's
    status unless the overall action sets another.
    """
    df = prepared(reviews)
    results = F.array(*[F.struct(F.lit(name).alias("check_id"), result.alias("r")) for name, result in checks()])
    df = settled(df.withColumns({"s_results": results, "false_positive_probability": false_positive_probability()}))
    entry = lambda x: F.struct(x.check_id.alias("check_id"), F.when(x.r.action == "pass", "pass").otherwise("fail").alias("status"), x.r.action.alias("action"), x.r.detail.alias("detail"), x.r.reviewer.alias("reviewer"), x.r.request.alias("request"))
    df = df.withColumn("checklist", F.transform("s_results", entry))
    top = F.array_max(F.transform("checklist", lambda x: F.element_at(lookup(PRIORITY), x.action)))
    df = settled(df.withColumn("overall_action", F.element_at(lookup({v: k for k, v in PRIORITY.items()}), top)))
    of = lambda action: F.filter("checklist", lambda x: x.action == action)
    waiting = F.struct(F.get(of("pending"), F.lit(0))["detail"].alias("reason"), F.lit(RESUME_CONDITION).alias("resume_condition"), F.array(*[F.lit(x) for x in RESUME_EVENTS]).alias("resume_events"))
    df = df.withColumns({
        "recheck_items": F.transform(of("recheck"), lambda x: x.check_id),
        "data_requests": F.transform(F.filter("checklist", lambda x: x.request.isNotNull()), lambda x: x.request),
        "pending": F.when(c("overall_action") == "pending", waiting),
        "escalation_reasons": F.transform(of("escalate"), lambda x: x.detail),
        "escalation_reviewer": F.get(of("escalate"), F.lit(0))["reviewer"],
        "validated_status": F.coalesce(F.try_element_at(lookup(STATUS_OF_ACTION), c("overall_action")), c("review_status")),
    })
    return df.drop(*[x for x in df.columns if x.startswith("s_")])
