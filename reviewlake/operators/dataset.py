"""Benchmark and dataset construction, hard negatives, merge, split and leakage analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import benchmark_band, hard_negative_band
from ..functions.text import any_of, content_hash, message, truncated
from .shared import kept

c = F.col
TASKS = ["finding_review", "severity_review", "evidence_check", "remediation_review", "client_qa", "hard_negative_potential_issue"]
# Phrases that show exploitation, or deny it.
POSITIVE = [
    "authentication succeeds", "authentication succeeded", "verified that the", "successfully intercepted", "successfully authenticated", "successfully access",
    "successfully exploited", "was verified", "confirmed that the exposed credentials remain valid", "confirmed that the", "it was verified",
]
NEGATIVE = [
    "no evidence was found", "no successful exploitation", "not demonstrated", "could not be verified", "was not verified", "no exploitation was performed",
    "not exploited", "not exploited during", "no manual verification", "scanner output only", "no manual confirmation",
]
SCANNERS = ["scanner", "automated scan", "nmap", "nikto", "zap", "nuclei"]


def evidence_text(findings: DataFrame) -> DataFrame:
    """Adds lower-cased ``_blob``: content then description of each item, then the observation."""
    parts = F.flatten(F.transform("evidence", lambda e: F.array(F.lower(F.coalesce(e.content, F.lit(""))), F.lower(F.coalesce(e.description, F.lit(""))))))
    return findings.withColumn("_evidence", F.array_join(parts, " ")).withColumn("_blob", F.concat_ws(" ", "_evidence", F.lower(F.coalesce("observation", F.lit("")))))


def markers(findings: DataFrame) -> DataFrame:
    df = evidence_text(findings)
    positive = any_of(c("_blob"), POSITIVE)
    return df.select("*", positive.alias("positive"), any_of(c("_blob"), NEGATIVE).alias("negative"), (any_of(c("_evidence"), SCANNERS) & ~positive).alias("scanner_only")).drop("_evidence", "_blob")


#: What a model may get wrong in each task.
FAILURE_MODES = {
    "finding_review": ["wrong_classification_label", "missed_severity_cvss_mismatch", "hallucinated_evidence", "missing_review_comment"],
    "severity_review": ["wrong_severity_suggestion", "missed_cvss_severity_mismatch", "invalid_cvss_vector_validation"],
    "evidence_check": ["wrong_evidence_sufficiency", "hallucinated_evidence", "missed_unsupported_claim"],
    "remediation_review": ["wrong_root_cause_assessment", "missed_generic_recommendation", "hallucinated_cwe_relevance"],
    "client_qa": ["hallucinated_severity", "wrong_cvss_score", "refused_in_scope_question"],
    "hard_negative_potential_issue": ["wrong_classification_label_confirmed", "missed_no_exploit_marker", "hallucinated_exploitation"],
}


def _confidence(score: Column) -> Column:
    level = F.when(score >= 0.85, "high").when(score >= 0.65, "medium").otherwise("low")
    return F.struct(F.round(score, 2).alias("overall_score"), level.alias("level"))


def _named(**columns: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in columns.items()])


def _some(when: Column, text: Column | str) -> Column:
    return F.filter(F.array(text if isinstance(text, Column) else F.lit(text)), lambda x: when)


def gold_answers() -> dict[str, Column]:
    """The gold answer of each task over ``markers(findings)`` with ``band``, ``matches`` and ``shown``, each in its own form."""
    title, shown, matches = F.coalesce("title", F.lit("")), c("shown"), c("matches")
    severity, score, vector = F.coalesce("severity", F.lit("")), c("cvss.score"), c("cvss.vector")
    items = F.transform("evidence", lambda e: e.evidence_id)
    untested = c("retest.status").isNull()
    label = F.when(shown, "confirmed_vulnerability").otherwise("potential_issue")
    evidence = _named(is_sufficient=shown, evidence_items_reviewed=items, supported_claims=_some(shown, title), unsupported_claims=_some(~shown, title), missing_evidence=_some(~shown, "Reproducible exploitation proof"))
    banded = _named(reported_severity=severity, suggested_severity=c("band"), is_consistent=matches, change_recommended=~matches)
    scored = _named(reported_score=score, reported_vector=vector, severity_matches_score=matches, requires_manual_recalculation=~matches)
    codes = F.concat(_some(~shown, "EVID-001"), _some(~matches, "SEV-001"), _some(untested, "RETEST-001"))
    escalates = ~shown & ~matches
    steps = F.coalesce(F.size("recommendation"), F.lit(0))
    answer = F.concat(
        F.lit("The finding '"), title, F.lit("' is reported with severity '"), severity, F.lit("' and CVSS score "), F.coalesce(score.cast("string"), F.lit("none")), F.lit(" (vector: "), F.coalesce(vector, F.lit("")), F.lit(").")
    )
    return {
        "finding_review": _named(
            finding_id=c("finding_id"), review_status=F.when(F.size(codes) > 0, "needs_revision").otherwise("pass"), classification=_named(label=label, supported_by_evidence=shown),
            completeness_review=_named(is_complete=F.lit(True), missing_conditional_fields=_some(untested, "retest.status")), evidence_review=evidence, severity_review=banded, cvss_review=scored,
            cwe_review=_named(reported_cwe=c("cwe_id")), consistency_review=_named(is_consistent=matches & shown, issues=_some(~matches, "severity-cvss-mismatch")),
            retest_review=_named(status_supported_by_evidence=~untested, missing_retest_evidence=_some(untested, "Retest not performed")), review_comments=codes,
            confidence=_confidence(F.when(shown & matches, 0.85).otherwise(0.65)), human_escalation=_named(required=escalates, reasons=F.concat(_some(escalates, "evidence_insufficient"), _some(escalates, "severity_mismatch"))),
        ),
        "severity_review": _named(severity_review=banded, cvss_review=scored, confidence=_confidence(F.when(matches, 0.9).otherwise(0.75))),
        "evidence_check": _named(evidence_review=evidence, review_comments=_some(~shown, "EVID-001"), confidence=_confidence(F.lit(0.85))),
        "remediation_review": _named(
            recommendation_review=_named(addresses_root_cause=steps >= 3, is_actionable=steps >= 2, is_technically_relevant=F.lit(True), missing_recommendations=_some(steps < 3, "Add specific remediation steps.")), confidence=_confidence(F.lit(0.85))
        ),
        "client_qa": _named(answer=answer, refuses=F.lit(False), source_references=F.array(_named(field=F.lit("observation"), snippet=truncated(F.coalesce("observation", F.lit("")), 120))), confidence=_confidence(F.lit(0.9))),
        "hard_negative_potential_issue": _named(
            classification=_named(label=F.lit("potential_issue"), supported_by_evidence=F.lit(False)),
            evidence_review=_named(is_sufficient=F.lit(False), evidence_items_reviewed=items, supported_claims=F.array().cast("array<string>"), unsupported_claims=F.array(title), missing_evidence=F.array(F.lit("Reproducible exploitation proof"))), confidence=_confidence(F.lit(0.7)),
        ),
    }


def expand_tasks(findings: DataFrame) -> DataFrame:
    """One case per finding and task (the potential-issue negative only where denied): exploded from a literal array, so nothing shuffles."""
    band = benchmark_band(c("cvss.score"))
    df = markers(findings).withColumns({"band": band, "matches": F.coalesce(F.lower(F.coalesce("severity", F.lit(""))) == band, F.lit(False)), "shown": c("positive") & ~c("negative")})
    tasks = F.filter(F.array(*[F.lit(t) for t in TASKS]), lambda t: (t != TASKS[-1]) | c("negative"))
    df = df.select("*", F.explode(tasks).alias("task_type"))
    task, gold, modes = c("task_type"), F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, answer in gold_answers().items():
        gold = F.when(task == name, F.to_json(answer, {"ignoreNullFields": "false"})).otherwise(gold)
        modes = F.when(task == name, F.array(*[F.lit(x) for x in FAILURE_MODES[name]])).otherwise(modes)
    easy = F.when(task == "finding_review", c("shown")).when(task == "severity_review", c("matches")).when(task == "evidence_check", False).otherwise(True)
    difficulty = F.when(task == TASKS[-1], "hard").when(easy, "easy").otherwise("medium")
    return df.select("finding_id", "task_type", difficulty.alias("difficulty"), (task == TASKS[-1]).alias("is_hard_negative"), gold.alias("gold_output"), modes.alias("expected_failure_modes"), content_hash(task, c("finding_id"), c("title"), c("observation")).alias("content_hash"))


def all_cases(derived: DataFrame, hand_crafted: DataFrame) -> DataFrame:
    """Derived and hand-crafted cases in one table with their ids: hand-crafted ones are numbered after the derived ones of their task."""
    offsets = derived.groupBy("task_type").agg(F.count("*").alias("offset"))
    columns = ["finding_id", "task_type", "difficulty", "is_hard_negative", "gold_output", "content_hash"]
    return case_ids(derived.select(columns)).unionByName(case_ids(hand_crafted.select(columns), offsets))


def case_ids(cases: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """``BMC-<task>-%04d`` per task in order of finding_id, after a task's offset if given as (task_type, offset).

    Rows are range-partitioned by task and finding and kept so, numbered within partitions, and shifted by how many rows of the
    task lie in earlier partitions: no task orders a whole task type.
    """
    placed = kept(cases.repartitionByRange("task_type", "finding_id").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("task_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("task_type", "part").agg(F.count("*").alias("rows")).select(c("task_type").alias("s_task"), c("part").alias("s_part"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    w = Window.partitionBy("task_type", "part").orderBy("finding_id")
    numbered = placed.withColumn("n", F.row_number().over(w)).join(starts, (c("task_type") == c("s_task")) & (c("part") == c("s_part"))).withColumn("n", c("n") + c("start")).drop("s_task", "s_part", "start", "part")
    if offsets is not None:
        numbered = numbered.join(offsets, "task_type", "left").withColumn("n", c("n") + F.coalesce("offset", F.lit(0))).drop("offset")
    return numbered.withColumn("case_id", F.format_string("BMC-%s-%04d", "task_type", "n")).drop("n")


def eligible_tasks(findings: DataFrame) -> DataFrame:
    """(finding_id, task_type) of the tasks that a finding has the parts for."""
    df = markers(findings)
    some = lambda name: F.coalesce(F.size(name), F.lit(0)) > 0
    told = lambda x: F.coalesce(x, F.lit("")) != ""
    rules = {
        "finding_review": told(c("observation")) & some("evidence") & some("recommendation"), "severity_review": told(c("severity")) & c("cvss.score").isNotNull() & told(c("cvss.vector")),
        "evidence_check": some("evidence"), "remediation_review": some("recommendation"), "client_qa": F.lit(True), "hard_negative_potential_issue": c("negative"),
    }
    return df.select("finding_id", F.explode(F.array_compact(F.array(*[F.when(when, task) for task, when in rules.items()]))).alias("task_type"))


def task_inventory(findings: DataFrame) -> DataFrame:
    """(kind, value, n): findings by severity, redaction status (if there is one), what their evidence says of exploitation, and eligible task."""
    shown = F.when(c("negative"), "denied").when(c("positive"), "shown").when(c("scanner_only"), "scanner_only").otherwise("unclear")
    kinds = {"severity": F.coalesce("severity", F.lit("missing")), "exploitation": shown}
    if "redaction_status" in findings.columns:
        kinds["redaction"] = F.coalesce("redaction_status", F.lit("missing"))
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in kinds.items()])
    counted = markers(findings).select(F.explode(each).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    tasks = eligible_tasks(findings).groupBy(c("task_type").alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("task"))
    return counted.unionByName(tasks)


def envelope(cases: DataFrame) -> DataFrame:
    """Cases as dataset examples: gold_output becomes output, the hash is made of task and input."""
    return cases.select("task_type", "instruction", "input", c("gold_output").alias("output"), content_hash(c("task_type"), c("input")).alias("content_hash"))


def repeated_hashes(examples: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    return examples.groupBy(hash_col).agg(F.count("*").alias("n")).where("n > 1")


def unsupported_questions(findings: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions that a finding cannot answer, as cases whose gold answer is a refusal. ``questions(finding_id, question, refusal_reason)``."""
    gold = F.to_json(F.struct(F.lit(None).cast("string").alias("answer"), F.lit(True).alias("refuses"), F.array().cast("array<string>").alias("source_references")), {"ignoreNullFields": "false"})
    joined = findings.select("finding_id", "title", "observation").join(questions, "finding_id")
    return joined.select(
        "finding_id", F.lit("client_qa").alias("task_type"), "question", "refusal_reason", gold.alias("gold_output"), F.lit("hard").alias("difficulty"), F.lit(True).alias("is_hard_negative"),
        F.lit("unsupported_question").alias("hard_negative_type"), content_hash(c("finding_id"), c("title"), c("observation"), c("question")).alias("content_hash"),
    )


def hard_negative_faults(cases: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(fault, subject, n): types whose number is not the expected one, ids that stand twice, cases that are not flagged."""
    spark = cases.sparkSession
    wanted = spark.createDataFrame(list(expected.items()), "subject string, wanted long")
    counts = cases.groupBy(c("hard_negative_type").alias("subject")).agg(F.count("*").alias("n"))
    number = wanted.join(counts, "subject", "full").fillna(0, ["n", "wanted"]).where("n <> wanted").select(F.lit("number").alias("fault"), "subject", "n")
    twice = cases.groupBy(c("case_id").alias("subject")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("fault"), "subject", "n")
    unflagged = cases.where(~c("is_hard_negative").eqNullSafe(True)).select(F.lit("not_flagged").alias("fault"), c("case_id").alias("subject"), F.lit(1).cast("long").alias("n"))
    return number.unionByName(twice).unionByName(unflagged)


def count_deltas(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, n_old, n_new, delta) of the values of a column in two versions of a table."""
    sides = [df.groupBy(F.coalesce(key, F.lit("unknown")).alias(key)).agg(F.count("*").alias(name)) for df, name in ((old, "n_old"), (new, "n_new"))]
    return sides[0].join(sides[1], key, "full").fillna(0, ["n_old", "n_new"]).withColumn("delta", c("n_new") - c("n_old"))


def in_order(rows: DataFrame, order: list[str], amount: str) -> DataFrame:
    """Adds ``at`` (place, from 1), ``before`` (amounts of the rows before), ``rows`` (their number), ``total`` and ``least`` (of all amounts).

    ``order`` names columns, smallest first, that tell rows apart. Rows are range-partitioned and numbered within partitions; what lies in the
    partitions before comes from one row a partition, so that no task orders all rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Kept, since ranges are sampled anew each time a plan is run: both branches must see the same ones.
    placed = kept(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("part").agg(F.count("*").alias("part_rows"), F.sum(amount).alias("part_amount"), F.min(amount).alias("part_least"))
    by_part = Window.orderBy("part")
    earlier, every = by_part.rowsBetween(Window.unboundedPreceding, -1), by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("part", F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("part_amount").over(earlier), F.lit(0)).alias("amount_before"), F.sum("part_rows").over(every).alias("rows"), F.sum("part_amount").over(every).alias("total"), F.min("part_least").over(every).alias("least"))
    own = Window.partitionBy("part").orderBy(*order)
    inner = F.coalesce(F.sum(amount).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.withColumns({"at": F.row_number().over(own), "before": inner}).join(F.broadcast(sums), "part")  # a row for each partition
    return numbered.withColumns({"at": c("at") + c("rows_before"), "before": c("before") + c("amount_before")}).drop("part", "rows_before", "amount_before")


def count_ranks(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, rank): values by how often they occur, ties by value."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("less", -c("n"))
    return in_order(counts, ["less", key], "n").select(key, "n", c("at").alias("rank"))


def freeze_manifest(buckets: DataFrame, examples: DataFrame, group: str) -> DataFrame:
    """One row: whether the test set can be frozen (two groups or more), its groups and number of examples."""
    test = buckets.where("bucket = 'test'").select(group)
    size = examples.withColumn(group, F.coalesce(group, F.lit("UNKNOWN"))).join(test, group, "left_semi").agg(F.count("*").alias("test_examples"))
    status = F.when(F.count("*") < 2, "NOT_FROZEN").otherwise("FROZEN")
    summary = buckets.agg(status.alias("status"), F.count("*").alias("groups"), F.count_if(c("bucket") == "test").alias("test_groups"))
    return summary.crossJoin(size)  # one row by one row


def manifest(cases: DataFrame) -> DataFrame:
    """Counts by task, by difficulty and in all, in one pass of grouping sets."""
    return cases.groupingSets([["task_type"], ["difficulty"], []], "task_type", "difficulty").agg(F.count("*").alias("n"), F.count_if("is_hard_negative").alias("hard_negatives"))


def scanner_negatives(findings: DataFrame) -> DataFrame:
    """Evidence replaced by one scanner item; everything else stays."""
    item = F.array(F.struct(F.concat("finding_id", F.lit("-EVID-001")).alias("evidence_id"), F.lit("scanner_output").alias("evidence_type"), F.lit(None).cast("string").alias("description"), F.lit("Automated scan output, scanner output only").alias("content")))
    return findings.withColumn("evidence", item)


def swapped_evidence(findings: DataFrame, swaps: DataFrame) -> DataFrame:
    """Findings of ``swaps(finding_id, donor_id)`` with their donor's evidence."""
    donors = findings.select(c("finding_id").alias("donor_id"), c("evidence").alias("donor_evidence"))
    return findings.join(swaps, "finding_id").join(donors, "donor_id").withColumn("evidence", c("donor_evidence")).drop("donor_evidence")


def wrong_severities(findings: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Findings whose severity is set two bands from the score's (wrapping around), or to that of ``overrides(finding_id, severity)`` where it has one."""
    names = ["critical", "high", "medium", "low", "informational"]
    band = hard_negative_band(c("cvss.score"))
    at = F.array_position(F.array(*[F.lit(x) for x in names]), band)
    wrong = F.element_at(F.array(*[F.lit(x) for x in names]), ((at + 1) % 5 + 1).cast("int"))
    by_rule = findings.where(band.isNotNull()).select("finding_id", band.alias("band"), wrong.alias("severity"))
    if overrides is None:
        return by_rule
    given = overrides.select("finding_id", c("severity").alias("given"))
    return by_rule.join(given, "finding_id", "left").select("finding_id", "band", F.coalesce("given", "severity").alias("severity"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both tables: must be empty for ids, is a warning for hashes."""
    return a.select(key).intersect(b.select(key))


def duplicate_pairs(rows: DataFrame, key: str, hash_col: str, order: str) -> DataFrame:
    """(first, later) of rows with equal hash: each later row with the first in order.

    The first row comes from an aggregate, and a join brings it to the later ones: a hot hash is not sorted in one task.
    """
    first = rows.groupBy(hash_col).agg(F.min(F.struct(c(order).alias("_order"), c(key).alias("_key"))).alias("f"), F.count("*").alias("n")).where("n > 1").select(hash_col, c("f._key").alias("first"))
    return rows.join(first, hash_col).where(c(key) != c("first")).select("first", c(key).alias("later"))


def failure_modes(rows: DataFrame, modes: str, k: int = 10) -> DataFrame:
    """The most common entries of an array column; ties by name."""
    return rows.select(F.explode(modes).alias("mode")).groupBy("mode").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "mode").limit(k)


def chatml(turns: DataFrame, conversation: str, order: str, role: str, text: str) -> DataFrame:
    """One ChatML string per conversation, turns in order."""
    rendered = F.transform(F.sort_array(F.collect_list(F.struct(order, role, text))), lambda t: F.concat(F.lit("<|im_start|>"), t[role], F.lit("\n"), t[text], F.lit("<|im_end|>\n")))
    return turns.groupBy(conversation).agg(F.array_join(rendered, "").alias("chat"))


def prompt(instruction: str, payload: Column) -> Column:
    """A chat prompt that ends where the assistant begins."""
    return F.concat(message("system", F.lit(instruction)), message("user", payload), F.lit("<|im_start|>assistant\n"))


# ---------------------------------------------------------------- leakage and split


def leakage_risks(examples: DataFrame) -> DataFrame:
    """(risk_id, severity, subject, n) over examples(line, finding_id, engagement_id, task_type, content_hash)."""
    one = examples.agg(F.countDistinct("engagement_id").alias("e"), F.count("*").alias("n"))
    single = one.where("e = 1").select(F.lit("LEAK-001").alias("risk_id"), F.lit("critical").alias("severity"), F.lit("engagement").alias("subject"), "n")
    repeated = examples.groupBy("finding_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("LEAK-002").alias("risk_id"), F.lit("high").alias("severity"), c("finding_id").alias("subject"), "n")
    equal = examples.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("LEAK-003").alias("risk_id"), F.lit("critical").alias("severity"), c("content_hash").alias("subject"), "n")
    always = one.select(F.explode(F.array(
        F.struct(F.lit("LEAK-004").alias("risk_id"), F.lit("medium").alias("severity"), F.lit("template").alias("subject"), c("n").alias("n")),
        F.struct(F.lit("LEAK-005").alias("risk_id"), F.lit("high").alias("severity"), F.lit("small set").alias("subject"), F.greatest(F.lit(1), F.expr("n div 10")).alias("n")))).alias("x")).select("x.*")
    return single.unionByName(repeated).unionByName(equal).unionByName(always)


def repeated_lines(examples: DataFrame) -> DataFrame:
    """(content_hash, line, first_line) of every example whose hash occurs more than once: the line list of the risk, a row a line."""
    first = examples.groupBy("content_hash").agg(F.min("line").alias("first_line"), F.count("*").alias("n")).where("n > 1").drop("n")
    return examples.select("content_hash", "line").join(first, "content_hash")


def engagement_report(findings: DataFrame, engagement: str = "engagement_id") -> DataFrame:
    """Findings by engagement and severity, with each engagement's share of all in percent."""
    counts = findings.groupBy(F.coalesce(engagement, F.lit("UNKNOWN")).alias(engagement)).pivot("severity", ["critical", "high", "medium", "low", "informational"]).agg(F.count(F.lit(1))).fillna(0)
    sizes = findings.groupBy(F.coalesce(engagement, F.lit("UNKNOWN")).alias(engagement)).agg(F.count("*").alias("findings"))
    total = findings.agg(F.count("*").alias("total"))
    return sizes.join(counts, engagement).crossJoin(total).withColumn("percent", F.round(100.0 * c("findings") / c("total"), 2)).drop("total")  # one row beside each


def group_split(examples: DataFrame, group: str, train_share: float = 0.8) -> DataFrame:
    """(group, n, bucket): whole groups only. The smallest group is the test set; of the rest, in order of size, groups
    train until their share is reached, then validate. A single group is held back."""
    sizes = examples.groupBy(F.coalesce(group, F.lit("UNKNOWN")).alias(group)).agg(F.count("*").alias("n")).withColumn("less", -c("n"))
    ranked = in_order(sizes, ["less", group], "n")
    is_last = c("at") == c("rows")
    # The groups before the last hold all but the smallest size.
    bucket = F.when(c("rows") < 2, "hold").when(is_last, "test").when(c("before") < train_share * (c("total") - c("least")), "train").otherwise("validation")
    return ranked.select(group, "n", bucket.alias("bucket"))


def split_manifest(examples: DataFrame, buckets: DataFrame, group: str) -> DataFrame:
    return examples.withColumn(group, F.coalesce(group, F.lit("UNKNOWN"))).join(buckets.select(group, "bucket"), group, "left").fillna("unassigned", ["bucket"])


def bucket_percent(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumn("percent", F.round(100.0 * c("n") / F.sum("n").over(every), 2))
