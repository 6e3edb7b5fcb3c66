"""Quality checks of normalized findings, governance gate, key checks, duplicates, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.bands import quality_band
from ..functions.text import fingerprint, normalize_whitespace

#: A field that holds only one of these says nothing.
PLACEHOLDERS = ["tbd", "to be determined", "to be updated", "todo", "placeholder", "pending update"]
c = F.col


def is_blank(text: Column) -> Column:
    return text.isNull() | (normalize_whitespace(text) == "")


def is_placeholder(text: Column) -> Column:
    return F.coalesce(F.rtrim(F.lower(normalize_whitespace(text)), F.lit(":.")).isin(PLACEHOLDERS), F.lit(False))


def issues(findings: DataFrame) -> DataFrame:
    """One row per issue: finding_id, check_id, severity, field. Each finding's checks are one array, then exploded."""
    mismatch = F.coalesce(c("severity") != quality_band(c("cvss.score")), F.lit(False))
    status, verified = c("retest.status"), c("retest.verification_result") if "verification_result" in findings.schema["retest"].dataType.names else F.lit(None).cast("string")
    checks = [(is_blank(c(f)), "QC-CONTENT-001", "error", f) for f in ("title", "impact", "observation")]
    checks += [(F.coalesce(F.size(f), F.lit(0)) <= 0, "QC-CONTENT-001", "error", f) for f in ("evidence", "recommendation")]
    checks += [(is_placeholder(c(f)), "QC-CONTENT-002", "warning", f) for f in ("title", "impact", "observation")]
    checks += [
        (mismatch, "QC-CVSS-001", "warning", "severity"),
        (status.isNull() & verified.isNull(), "QC-RETEST-001", "warning", "retest"),
        (status.isNotNull() & verified.isNull(), "QC-RETEST-002", "warning", "retest.verification_result"),
        (F.coalesce(c("document_id"), F.lit("")) == "", "QC-SOURCE-001", "error", "source.document_id"),
        (F.coalesce(c("source_reference"), F.lit("")) == "" if "source_reference" in findings.columns else F.lit(False), "QC-SOURCE-002", "error", "source.source_reference"),
        (~c("usage_approved").eqNullSafe(True), "QC-GOV-001", "error", "governance.usage_approved"),
        (~c("usage_scope").eqNullSafe("internal"), "QC-GOV-002", "warning", "governance.usage_scope"),
    ]
    struct = lambda check, severity, field: F.struct(F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), F.lit(field).alias("field"))
    fixed = F.array_compact(F.array(*[F.when(cond, struct(*what)) for cond, *what in checks]))
    marked = F.filter(F.transform("recommendation", lambda r, i: F.when(is_placeholder(r), F.struct(F.lit("QC-CONTENT-002").alias("check_id"), F.lit("warning").alias("severity"), F.format_string("recommendation[%d]", i).alias("field")))), lambda x: x.isNotNull())
    found = F.concat(fixed, F.coalesce(marked, F.array().cast("array<struct<check_id:string,severity:string,field:string>>")))
    return findings.select("finding_id", F.explode(found).alias("x")).select("finding_id", "x.*")


def status_of(findings: DataFrame, found: DataFrame) -> DataFrame:
    """Counts by severity and status of every finding, those without issues included."""
    counts = found.groupBy("finding_id").agg(F.count_if(c("severity") == "error").alias("errors"), F.count_if(c("severity") == "warning").alias("warnings"))
    out = findings.select("finding_id").join(counts, "finding_id", "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("status", F.when(c("errors") > 0, "blocked").when(c("warnings") > 0, "needs_review").otherwise("passed"))


def run_summary(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("findings"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))


def run_report(statuses: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(kind, value, n): findings by status, issues by severity, duplicate groups and the rows in them; what does not occur is 0."""
    counts = statuses.agg(
        *[F.count_if(c("status") == x).alias(f"status {x}") for x in ("passed", "needs_review", "blocked")], F.coalesce(F.sum("errors"), F.lit(0)).alias("issues error"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("issues warning")
    )
    groups = duplicates.agg(F.count("*").alias("duplicates groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates findings"))
    long = [df.unpivot([], df.columns, "name", "n") for df in (counts, groups)]
    return long[0].unionByName(long[1]).select(F.split_part("name", F.lit(" "), F.lit(1)).alias("kind"), F.split_part("name", F.lit(" "), F.lit(2)).alias("value"), "n")


def duplicate_groups(rows: DataFrame, id_col: str, title: Column, body: Column) -> DataFrame:
    """(fingerprint, n, first_id, last_id) of texts that occur more than once, case and white space aside.

    Hashes are grouped, not texts; ids of a group are not gathered.
    """
    prints = rows.select(F.sha2(fingerprint(title, body), 256).alias("fingerprint"), c(id_col).alias("id"))
    return prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


def governance_gate(findings: DataFrame) -> DataFrame:
    approved, scope = c("usage_approved").eqNullSafe(True), F.coalesce(c("usage_scope").isin(V.USAGE_SCOPES), F.lit(False))
    redacted = F.coalesce(c("redaction_status").isin(V.REDACTION_STATUSES), F.lit(False))
    structure = F.coalesce(c("finding_id").rlike(V.FINDING_ID), F.lit(False))
    return findings.select("finding_id", (approved & scope).alias("governance_valid"), (~redacted).alias("redaction_warning"), structure.alias("structure_valid"), (approved & scope & structure).alias("is_valid"))


def key_faults(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are null or occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(f"{key} is null or n > 1")


def key_set_differences(a: DataFrame, b: DataFrame, third: DataFrame, key: str) -> DataFrame:
    """Keys that one of three tables lacks, with who has them."""
    sides = [df.select(key).distinct().withColumn(name, F.lit(True)) for name, df in (("in_a", a), ("in_b", b), ("in_c", third))]
    out = sides[0].join(sides[1], key, "full").join(sides[2], key, "full").fillna(False, ["in_a", "in_b", "in_c"])
    return out.where("not (in_a and in_b and in_c)")


def outside_domain(rows: DataFrame, columns: dict[str, list[str]], key: str) -> DataFrame:
    """(key, field, value) of values outside a field's enumerated domain; null is outside of none."""
    bad = F.array_compact(F.array(*[F.when(c(f).isNotNull() & ~c(f).isin(allowed), F.struct(F.lit(f).alias("field"), c(f).alias("value"))) for f, allowed in columns.items()]))
    return rows.select(key, F.explode(bad).alias("x")).select(key, "x.field", "x.value")
