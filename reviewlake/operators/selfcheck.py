"""Self-validation of a review: eight items, each with an action; the overall action is the one of highest priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup
from .review import settled

c = F.col
#: Priorities of actions.
PRIORITY = {"escalate": 4, "pending": 3, "request_data": 2, "re-check": 1, "pass": 0}


#: Outputs of the review that the items read.
READS = ["completeness", "evidence_review", "classification", "severity_review", "cvss_review", "consistency", "confidence", "escalation"]


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def items() -> list[tuple[str, Column]]:
    """(item, action) in order, over the columns that ``review`` adds."""
    label, ok = c("classification.label"), c("evidence_review.is_sufficient")
    unsupported = F.size("evidence_review.unsupported") > 0
    confirmed, high = label == "confirmed_vulnerability", _true(c("severity").isin("critical", "high"))
    score, escalated = c("confidence.score"), c("escalation.required")
    status, scanner = F.coalesce(c("retest.status"), F.lit("")), c("evidence_review.has_scanner")
    malformed = _true((c("cvss.vector") != "") & ~c("cvss_review.vector_valid"))
    serious = F.exists("consistency.issues", lambda x: x.isin("CONS-002", "CONS-005", "CONS-006"))
    return [
        ("completeness", F.when(~c("completeness.is_complete"), "request_data").when(F.size("completeness.missing_conditional") > 0, "re-check").otherwise("pass")),
        ("evidence", F.when(ok.isNull(), "request_data").when(_true(ok) & ~unsupported, "pass").when(F.exists("evidence_review.missing", lambda x: x.contains("scanner")), "request_data").when(unsupported, "pending").otherwise("re-check")),
        ("classification", F.when(confirmed & ~_true(ok), "escalate").when(confirmed & scanner & ~_true(ok), "escalate").when((label == "potential_issue") & _true(score < 0.5), "pending").otherwise("pass")),
        ("severity", F.when(malformed, "re-check").when(_true(~c("severity_review.is_consistent")), "escalate").otherwise("pass")),
        ("cross_field", F.when(F.size("consistency.issues") == 0, "pass").when(serious, "escalate").otherwise("re-check")),
        ("scanner_trap", F.when(~scanner | _true(ok), "pass").when(confirmed | high, "escalate").otherwise("request_data")),
        ("confidence", F.when(score.isNull() | escalated | (score < 0.3), "escalate").when((score < 0.5) & (c("factors.evidence") < 0.5), "request_data").when(score < 0.7, "pending").otherwise("pass")),
        ("retest", F.when(status.isin("fixed") & (F.coalesce(F.size("retest.evidence"), F.lit(0)) <= 0), "request_data").when(status.isin("partially_fixed", "not_fixed"), "pending").when(confirmed & status.isin("", "not_retested"), "pending").otherwise("pass")),
    ]


def checklist(reviews: DataFrame) -> DataFrame:
    """Adds ``checklist`` (array of item, action, priority), ``overall_action``, ``passed`` and ``failed``."""
    actions = F.array(*[F.struct(F.lit(name).alias("item"), action.alias("action")) for name, action in items()])
    entries = F.transform(actions, lambda x: F.struct(x.item.alias("item"), x.action.alias("action"), F.element_at(lookup(PRIORITY), x.action).alias("priority")))
    df = settled(reviews.withColumn("checklist", entries))
    top = F.array_max(F.transform("checklist", lambda x: F.struct(x.priority.alias("priority"), x.action.alias("action"))))
    failed = F.size(F.filter("checklist", lambda x: x.action != "pass"))
    return df.withColumns({"overall_action": top["action"], "failed": failed, "passed": F.size("checklist") - failed})


def false_positive_probability() -> Column:
    """The largest of four signals."""
    ok = c("evidence_review.is_sufficient")
    scanner_only = c("evidence_review.has_scanner") & ~_true(ok)
    return F.greatest(F.when(scanner_only, 0.9).otherwise(0.1), F.when(F.size("evidence_review.unsupported") > 0, 0.6).otherwise(0.1), F.when(F.exists("consistency.issues", lambda x: x == "CONS-006"), 0.6).otherwise(0.1))
