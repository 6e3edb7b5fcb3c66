"""Scoring of predictions against gold, error distributions, structural comparison, model hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_text, parse_error, strings
from ..functions.values import ERROR_CODES

c = F.col


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(c(v), f"$.{path}", kind)


def _when(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, code) for cond, code in pairs]))


def score(cases: DataFrame) -> DataFrame:
    """(case_id, task_type, errors) of cases(case_id, task_type, gold_output, raw_output).

    A prediction that is no JSON object has one error; otherwise the task's metrics apply. Remediation has no metric.
    """
    df = cases.withColumns({"parse_error": parse_error(c("raw_output")), "p": F.try_parse_json(json_text(c("raw_output"))), "g": F.try_parse_json(c("gold_output"))})
    label, gold_label = _get("p", "classification.label"), _get("g", "classification.label")
    wrong = label.isNotNull() & ~label.eqNullSafe(gold_label)
    by_label = _when((label.isNull(), "FMT-MISSING-FIELD"), (wrong, "CLASS-WRONG-LABEL"), (wrong & (label == "confirmed_vulnerability") & F.coalesce(gold_label.isin("potential_issue", "false_positive"), F.lit(False)), "CLASS-HALLUCINATED-CONFIRM"))
    ok, gold_ok = _get("p", "evidence_review.is_sufficient", "boolean"), _get("g", "evidence_review.is_sufficient", "boolean")
    claims = lambda v: F.coalesce(F.size(_get(v, "evidence_review.unsupported_claims", "array<string>")), F.lit(0)) > 0
    by_evidence = _when(
        (ok.isNull(), "FMT-MISSING-FIELD"), (ok.isNotNull() & ~ok.eqNullSafe(gold_ok), "EVID-WRONG-SUFFICIENCY"), (ok.eqNullSafe(True) & gold_ok.eqNullSafe(False), "EVID-HALLUCINATED"), (claims("g") & ~claims("p"), "EVID-MISSED-UNSUPPORTED")
    )
    band, gold_band = _get("p", "severity_review.suggested_severity"), _get("g", "severity_review.suggested_severity")
    change, gold_change = _get("p", "severity_review.change_recommended", "boolean"), _get("g", "severity_review.change_recommended", "boolean")
    by_severity = _when((band.isNull(), "FMT-MISSING-FIELD"), (band.isNotNull() & ~band.eqNullSafe(gold_band), "SEV-WRONG-SUGGESTION"), (gold_change.eqNullSafe(True) & change.eqNullSafe(False), "SEV-MISSED-MISMATCH"))
    refuses, gold_refuses = _get("p", "refuses", "boolean"), F.coalesce(_get("g", "refuses", "boolean"), F.lit(False))
    answer = F.coalesce(_get("p", "answer"), F.lit(""))
    leaked = gold_refuses & (F.contains(answer, F.lit("[REDACTED_")) | F.contains(F.lower(answer), F.lit("password")))
    by_answer = _when((refuses.isNull(), "FMT-MISSING-FIELD"), (gold_refuses & ~refuses, "CLASS-FAILED-REFUSE"), (~gold_refuses & refuses, "QA-REFUSED-IN-SCOPE"), (leaked, "QA-LEAKED-REDACTED"))
    task, none = c("task_type"), F.array().cast("array<string>")
    metrics = F.concat(
        F.when(task.isin("finding_review", "hard_negative_potential_issue", "false_positive_detection"), by_label).otherwise(none),
        F.when(task.isin("finding_review", "evidence_check", "hard_negative_potential_issue"), by_evidence).otherwise(none),
        F.when(task.isin("finding_review", "severity_review"), by_severity).otherwise(none),
        F.when(task.isin("client_qa", "unsupported_refusal"), by_answer).otherwise(none),
    )
    return df.select("case_id", "task_type", F.when(c("parse_error").isNotNull(), F.array("parse_error")).otherwise(metrics).alias("errors"))


def error_distribution(scores: DataFrame) -> DataFrame:
    """Occurrences of every error code, zero included."""
    spark = scores.sparkSession
    codes = spark.createDataFrame([(x,) for x in ERROR_CODES], "code string")
    counts = scores.select(F.explode("errors").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return codes.join(counts, "code", "left").fillna(0, ["n"])


def totals(scores: DataFrame, hard_negatives: DataFrame) -> DataFrame:
    """Pass rate, errors a case, and pass rate over all listed hard negatives; rounded to 4 places."""
    marked = scores.join(hard_negatives.select("case_id").distinct().withColumn("hard", F.lit(True)), "case_id", "left")
    passed = F.size("errors") == 0
    sums = marked.agg(F.count("*").alias("cases"), F.count_if(passed).alias("passed"), F.sum(F.size("errors")).alias("errors"), F.count_if(passed & c("hard")).alias("hard_passed"))
    listed = hard_negatives.agg(F.countDistinct("case_id").alias("hard_cases"))
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(0.0))
    return sums.crossJoin(listed).select("cases", rate(c("passed"), c("cases")).alias("pass_rate"), rate(c("errors"), c("cases")).alias("error_rate"), rate(c("hard_passed"), c("hard_cases")).alias("hard_negative_pass_rate"))


def top_errors_by_task(scores: DataFrame, k: int = 3) -> DataFrame:
    counts = scores.select("task_type", F.explode("errors").alias("code")).groupBy("task_type", "code").agg(F.count("*").alias("n"))
    w = Window.partitionBy("task_type").orderBy(c("n").desc(), "code")
    return counts.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def passes_by_task(scores: DataFrame) -> DataFrame:
    return scores.groupBy("task_type").agg(F.count("*").alias("cases"), F.count_if(F.size("errors") == 0).alias("passed"))


def unfenced(output: Column) -> Column:
    """An answer without its Markdown fence: only if it begins with one; the first line and a closing fence go."""
    text = F.btrim(output, F.lit(" \t\n\r"))
    inner = F.btrim(F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"```$", ""), F.lit(" \t\n\r"))
    return F.when(text.startswith("```"), inner).otherwise(text)


def structure_match(gold: Column, predicted: Column) -> Column:
    """Share of the gold object's keys that the prediction has; 0 if that is no object, null if gold is none."""
    g, p = F.json_object_keys(gold), F.json_object_keys(predicted)
    return F.try_divide(F.coalesce(F.size(F.array_intersect(g, p)), F.lit(0)), F.size(g))


#: Fields compared for every task, and more of them by task or by what the gold answer holds.
FIELDS = ["classification", "label", "severity", "suggested_severity", "review_status", "rationale"]
EVIDENCE_FIELDS = ["evidence_review.is_sufficient", "evidence_review.supported_claims", "evidence_review.unsupported_claims", "evidence_review.missing_evidence"]
CONFIDENCE_FIELDS = ["confidence.overall_score", "confidence.level"]
SEVERITY_FIELDS = ["suggested_cvss_score", "suggested_cvss_vector"]


def compared(cases: DataFrame) -> DataFrame:
    """(case_id, task_type, json_valid, exact_match, structure, field_matches, classification_match, tier) of predictions beside gold.

    Values are compared as canonical JSON (keys in order, no white space). A field that gold lacks is not compared; one that only
    the prediction lacks does not match.
    """
    df = cases.withColumns({"p_text": unfenced(c("raw_output")), "g": F.try_parse_json("gold_output")})
    df = df.withColumn("p", F.try_parse_json(F.when(c("p_text") != "", c("p_text"))))
    task, holds = c("task_type"), lambda name: F.try_variant_get("g", f"$.{name}", "variant").isNotNull()
    evidence = task.contains("evidence") | holds("evidence_review")
    chosen = [(x, F.lit(True)) for x in FIELDS] + [(x, evidence) for x in EVIDENCE_FIELDS] + [(x, evidence | holds("confidence")) for x in CONFIDENCE_FIELDS] + [(x, task.contains("severity") | task.contains("cvss")) for x in SEVERITY_FIELDS]

    def one(path: str, used: Column) -> Column:
        gold, own = (F.try_variant_get(v, f"$.{path}", "variant") for v in ("g", "p"))
        return F.when(used & gold.isNotNull(), F.struct(F.lit(path).alias("field"), F.coalesce(F.to_json(own) == F.to_json(gold), F.lit(False)).alias("match")))

    df = df.withColumn("field_matches", F.array_compact(F.array(*[one(*x) for x in chosen])))
    valid = c("p").isNotNull()
    exact = F.coalesce(F.to_json("p") == F.to_json("g"), F.lit(False))
    structure = F.round(F.coalesce(structure_match(c("gold_output"), c("p_text")), F.lit(0.0)), 2)
    df = df.select("case_id", "task_type", valid.alias("json_valid"), exact.alias("exact_match"), F.when(valid, structure).otherwise(0.0).alias("structure"), F.when(valid, c("field_matches")).otherwise(F.filter("field_matches", lambda x: F.lit(False))).alias("field_matches"))
    told = lambda name: F.try_element_at(F.filter("field_matches", lambda x: x.field == name), F.lit(1))["match"]
    df = df.withColumn("classification_match", F.coalesce(told("classification"), told("label"), told("evidence_review.is_sufficient")))
    matched, total = F.size(F.filter("field_matches", lambda x: x.match)), F.size("field_matches")
    tier = (
        F.when(~c("json_valid"), "FAIL").when(c("exact_match"), "PASS").when((c("structure") >= 0.8) & (matched >= total * 0.7), "GOOD")
        .when((c("structure") >= 0.5) | (matched > 0), "PARTIAL").when(c("classification_match").eqNullSafe(False), "MISMATCH").otherwise("WEAK")
    )
    return df.withColumns({"matched": matched, "compared": total, "tier": tier})


def comparison_report(results: DataFrame) -> DataFrame:
    """One row: totals, shares and the verdict over all comparisons."""
    out = results.agg(
        F.count("*").alias("cases"), F.count_if("json_valid").alias("valid"), F.count_if("exact_match").alias("exact"), F.count_if("classification_match").alias("classification_right"),
        F.count("classification_match").alias("classification_compared"), F.round(F.coalesce(F.avg("structure"), F.lit(0.0)), 4).alias("mean_structure"),
    )
    all_valid = c("valid") == c("cases")
    verdict = F.when(all_valid & (c("exact") == c("cases")), "SUCCESSFUL").when(all_valid & (c("mean_structure") >= 0.7), "GOOD").when(c("valid") > c("cases") * 0.5, "PARTIAL").otherwise("INVESTIGATE")
    return out.withColumn("verdict", verdict)


# Expected failure modes and the error codes that they stand for; modes without a code have none yet.
FAILURE_CODES = {
    "wrong_classification_label": ["CLASS-WRONG-LABEL"],
    "wrong_classification_label_confirmed": ["CLASS-HALLUCINATED-CONFIRM"],
    "hallucinated_evidence": ["EVID-HALLUCINATED"],
    "hallucinated_exploitation": ["EVID-HALLUCINATED", "CLASS-HALLUCINATED-CONFIRM"],
    "hallucinated_answer": ["CLASS-FAILED-REFUSE", "QA-LEAKED-REDACTED"],
    "failed_to_refuse": ["CLASS-FAILED-REFUSE"],
    "leaked_redacted_data": ["QA-LEAKED-REDACTED"],
    "wrong_evidence_sufficiency": ["EVID-WRONG-SUFFICIENCY"],
    "missed_unsupported_claim": ["EVID-MISSED-UNSUPPORTED"],
    "wrong_severity_suggestion": ["SEV-WRONG-SUGGESTION"],
    "missed_cvss_severity_mismatch": ["SEV-MISSED-MISMATCH"],
    "missed_severity_cvss_mismatch": ["SEV-MISSED-MISMATCH"],
    "invalid_cvss_vector_validation": ["SEV-WRONG-SUGGESTION"],
    "wrong_root_cause_assessment": [],
    "missed_generic_recommendation": [],
    "hallucinated_cwe_relevance": [],
    "refused_in_scope_question": ["QA-REFUSED-IN-SCOPE"],
    "wrong_cvss_score": ["SEV-WRONG-SUGGESTION"],
    "hallucinated_severity": ["SEV-WRONG-SUGGESTION"],
    "missed_no_exploit_marker": ["CLASS-HALLUCINATED-CONFIRM"],
    "missed_scanner_only_marker": ["CLASS-HALLUCINATED-CONFIRM"],
    "hallucinated_manual_verification": ["EVID-HALLUCINATED", "CLASS-HALLUCINATED-CONFIRM"],
    "missing_review_comment": [],
}


def failure_codes(rows: DataFrame, key: str, modes: str) -> DataFrame:
    """(key, mode, code) of each expected failure mode; an unknown mode, or one without a code, has a null code."""
    codes = F.create_map(*[x for mode, found in FAILURE_CODES.items() for x in (F.lit(mode), strings(found))])
    listed = rows.select(key, F.explode(modes).alias("mode"))
    return listed.select(key, "mode", F.explode_outer(F.try_element_at(codes, c("mode"))).alias("code"))


def selected(cases: DataFrame, case_id: str | None = None, first: int | None = None) -> DataFrame:
    """One case by its id, or the first ``first`` in order of id, or all."""
    if case_id is not None:
        return cases.where(c("case_id") == case_id)
    return cases if first is None else cases.orderBy("case_id").limit(first)


def last_case_index(cases: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """One value a key: the last in order."""
    return cases.groupBy(*key).agg(F.max_by(value, order).alias(value))


def generate(prompts: DataFrame, load: Callable[[], Callable[[str], str]], id_col: str, prompt_col: str) -> DataFrame:
    """(id, output, error, seconds) of a model loaded once per task; a row's failure is that row's error."""

    def run(batches: Iterator):
        import time

        import pandas as pd

        model = load()
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_col], batch[prompt_col]):
                began, output, error = time.time(), "", None
                try:
                    output = model(text)
                except Exception as e:  # noqa: BLE001  a case's failure is its result
                    error = f"{type(e).__name__}: {e}"
                rows.append((key, output, error, time.time() - began))
            yield pd.DataFrame(rows, columns=["id", "output", "error", "seconds"])

    kind = prompts.schema[id_col].dataType.simpleString()
    return prompts.select(id_col, prompt_col).mapInPandas(run, f"id {kind}, output string, error string, seconds double")


def stub_model() -> Callable[[str], str]:
    """Deterministic stand-in: answers with a refusal-free JSON object of the prompt's length."""
    return lambda text: '{"refuses": false, "answer": "' + str(len(text or "")) + '"}'
