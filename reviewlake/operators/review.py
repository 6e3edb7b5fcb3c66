"""The review of findings: nine rule checks, cross-field consistency, confidence, escalation, status.

``review(findings)`` adds struct columns; nothing shuffles, so it also runs on a stream. A query that needs some of
them names them, and only the rules they rest on are planned. Expected
columns: finding_id, title, severity, cvss struct<score, vector>, cwe_id, impact, observation,
evidence array<struct<evidence_id, evidence_type, description, content>>, recommendation
array<string>, retest struct<applicable, status, evidence>. Booleans have three states: null is unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cvss as cvss_scores
from ..functions import values as V
from ..functions.bands import review_band
from ..functions.text import any_of, category_of, hits, keywords, lookup, strings

c = F.col


def _comment_of(code: str, message: Column | str, field: str | None = None, reference: Column | None = None) -> Column:
    """The comment of a code, with the severity, field and action that the catalogue has for it."""
    kind, place, action = V.COMMENTS[code]
    return F.struct(
        F.lit(code).alias("code"), F.lit(kind).alias("severity"), F.lit(field or place).alias("field"), (message if isinstance(message, Column) else F.lit(message)).alias("message"),
        (reference if reference is not None else F.lit(None).cast("string")).alias("evidence_reference"), F.lit(action).alias("suggested_action"),
    )


def comment(when: Column, code: str, message: Column | str, field: str | None = None) -> Column:
    return F.when(when, _comment_of(code, message, field))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a one-row generator. Without it the optimizer merges the steps' projections and copies
    each expression into all its later uses, which makes plans grow without bound; this stays in the JVM."""
    return df.select(F.inline(F.array(F.struct(*[c(name) for name in df.columns]))))


def _blank(name: str) -> Column:
    return F.coalesce(c(name), F.lit("")) == ""


def _unsaid(name: str) -> Column:
    """Null, empty or nothing but white space."""
    return ~F.coalesce(c(name).rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"), F.lit(False))


def _present(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, name) for cond, name in pairs]))


def _word_map(column: Column, words: dict) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in words.items() for x in (F.lit(k), strings(v))]), column)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts)


def prepared(findings: DataFrame) -> DataFrame:
    """Shared columns, made once: lower-cased texts, keyword arrays, the score's band."""
    item_text = lambda e: F.lower(F.concat(F.coalesce(e.description, F.lit("")), F.lit(" "), F.coalesce(e.content, F.lit(""))))
    out = findings.withColumns({
        "_band": review_band(c("cvss.score")),
        "_title": F.lower(F.coalesce(c("title"), F.lit(""))),
        "_observation": F.lower(F.coalesce(c("observation"), F.lit(""))),
        "_impact": F.lower(F.coalesce(c("impact"), F.lit(""))),
        "_evidence": F.coalesce(c("evidence"), F.expr("array()").cast(findings.schema["evidence"].dataType)),
        "_recommendation": F.coalesce(c("recommendation"), F.expr("array()").cast("array<string>")),
    })
    out = out.withColumn("_items", F.transform("_evidence", lambda e: F.struct(F.coalesce(e.evidence_id, F.lit("unknown")).alias("id"), e.evidence_type.alias("type"), item_text(e).alias("text"))))
    return out.withColumns({
        "_evidence_text": F.array_join(F.transform("_items", lambda e: e.text), " "),
        "_rec_text": F.lower(F.array_join("_recommendation", " ")),
        "_title_words": keywords(c("_title")),
        "_source_words": keywords(F.concat("_title", F.lit(" "), "_observation")),
    })


def completeness(df: DataFrame) -> DataFrame:
    required = _present([(_unsaid(n), n) for n in ("finding_id", "title", "severity", "observation")] + [(F.size("_evidence") == 0, "evidence")])
    conditional = _present([(F.size("_recommendation") == 0, "recommendation"), (c("cvss.score").isNull(), "cvss.score"), (_blank("cwe_id"), "cwe_id"), (_blank("impact"), "impact")])
    notes = [comment(_unsaid(n), "COMP-001", f"Required field '{n}' is missing or empty", field=n) for n in ("finding_id", "title", "severity", "observation")]
    notes += [
        comment(F.size("_evidence") == 0, "COMP-002", "No evidence items provided"),
        comment(F.size("_recommendation") == 0, "COMP-003", "No recommendation provided"),
        comment(c("cvss.score").isNull(), "COMP-004", "CVSS score is missing"),
        comment(_blank("cwe_id"), "COMP-005", "CWE ID is missing"),
        comment(_blank("impact"), "COMP-006", "Impact is missing"),
    ]
    return df.withColumn("completeness", F.struct((F.size(required) == 0).alias("is_complete"), required.alias("missing_required"), conditional.alias("missing_conditional"))).withColumn("_c1", F.array_compact(F.array(*notes)))


def evidence(df: DataFrame) -> DataFrame:
    """Signals are looked for in each item; manual kind and success may come from different items."""
    manual = F.exists("_items", lambda e: F.coalesce(e.type.isin(V.MANUAL_EVIDENCE), F.lit(False)))
    success = F.exists("_items", lambda e: any_of(e.text, V.EXPLOIT_SIGNALS))
    refuted = F.filter("_items", lambda e: any_of(e.text, V.NO_EXPLOIT_SIGNALS))
    none = F.size("_items") == 0
    sufficient = F.when(none, None).when(success & manual, True).otherwise(False)
    per_item = F.transform(refuted, lambda e: _comment_of("EVID-002", F.concat(F.lit("Evidence item "), e.id, F.lit(" indicates exploitation was NOT demonstrated")), reference=e.id))
    rest = F.array_compact(F.array(
        comment(none, "EVID-003", "No evidence to review"),
        comment(~none & manual & ~success, "EVID-004", "Manual evidence without a sign of success"),
        comment(~none & ~manual, "EVID-005", "Only scanner or unverified evidence"),
    ))
    missing = _present([(none, "No exploitation evidence provided at all"), (~none & manual & ~success, "exploitation confirmation"), (~none & ~manual, "manual verification (scanner output only)")])
    shown = F.transform(F.filter("_items", lambda e: any_of(e.text, V.EXPLOIT_SIGNALS)), lambda e: e.id)
    out = F.struct(
        sufficient.alias("is_sufficient"), F.transform(refuted, lambda e: e.id).alias("unsupported"), missing.alias("missing"), F.exists("_items", lambda e: F.coalesce(e.type == "scanner_output", F.lit(False))).alias("has_scanner"),
        F.transform("_items", lambda e: e.id).alias("reviewed"), shown.alias("shown"), (success & manual).alias("shown_by_hand"),
    )
    return df.withColumn("evidence_review", out).withColumn("_c2", F.concat(per_item, rest))


def classification(df: DataFrame) -> DataFrame:
    ok, unsupported = c("evidence_review.is_sufficient"), F.size("evidence_review.unsupported") > 0
    label = F.when(ok.eqNullSafe(True) & ~unsupported, "confirmed_vulnerability").otherwise("potential_issue")
    refused = ok.eqNullSafe(False) | unsupported
    supported = ok.eqNullSafe(True) & ~unsupported
    notes = F.array_compact(F.array(
        comment(refused, "CLASS-001", "Evidence does not support a confirmed vulnerability"),
        comment(ok.isNull() & ~unsupported, "CLASS-002", "No evidence, so the finding stays a potential issue"),
    ))
    return df.withColumn("classification", F.struct(label.alias("label"), supported.alias("supported_by_evidence"))).withColumn("_c3", notes)


def severity(df: DataFrame) -> DataFrame:
    given, band = F.nullif(c("severity"), F.lit("")), c("_band")
    consistent = given == band
    change = F.coalesce(~consistent, F.lit(False))
    notes = F.array_compact(F.array(
        comment(change, "SEV-001", F.concat(F.lit("Severity '"), given, F.lit("' differs from the score's band '"), band, F.lit("'"))),
        comment(given.isNull(), "SEV-002", "Severity is missing"),
    ))
    out = F.struct(given.alias("reported"), band.alias("implied"), consistent.alias("is_consistent"), change.alias("change_recommended"), F.when(change, band).alias("suggested"))
    return df.withColumn("severity_review", out).withColumn("_c4", notes)


def cvss(df: DataFrame) -> DataFrame:
    vector = F.coalesce(c("cvss.vector"), F.lit(""))
    valid = (vector != "") & vector.rlike(V.CVSS_VECTOR)
    mismatch = F.coalesce(F.nullif(c("severity"), F.lit("")) != c("_band"), F.lit(False))
    notes = F.array_compact(F.array(
        comment((vector != "") & ~valid, "CVSS-001", "CVSS vector is malformed"),
        comment(mismatch, "CVSS-002", "Score and severity disagree"),
    ))
    out = F.struct(valid.alias("vector_valid"), F.lit(None).cast("boolean").alias("score_matches_vector"), (vector == "").alias("manual_recalculation"))
    return df.withColumn("cvss_review", out).withColumn("_c5", notes)


def cwe(df: DataFrame) -> DataFrame:
    given = F.nullif(c("cwe_id"), F.lit(""))
    valid = given.rlike(V.CWE_ID)
    words = _word_map(given, V.CWE_TITLE_WORDS)
    relevant = F.when(valid & words.isNotNull(), F.exists(words, lambda w: F.contains(c("_title"), w)))
    notes = F.array_compact(F.array(
        comment(~valid, "CWE-001", "CWE ID is malformed"),
        comment(relevant.eqNullSafe(False), "CWE-002", "CWE may not fit the title"),
        comment(given.isNull(), "CWE-003", "No CWE ID assigned"),
    ))
    return df.withColumn("cwe_review", F.struct(given.alias("reported"), valid.alias("format_valid"), relevant.alias("is_relevant"))).withColumn("_c6", notes)


def impact(df: DataFrame) -> DataFrame:
    given = c("_impact") != ""
    unsupported = F.filter(strings(V.IMPACT_CLAIMS), lambda w: F.contains(c("_impact"), w) & ~F.contains(c("_evidence_text"), w))
    mild = F.coalesce(c("severity").isin("critical", "high"), F.lit(False)) & ~any_of(c("_impact"), V.STRONG_WORDS)
    notes = F.array_compact(F.array(
        comment(given & mild, "IMP-001", "Impact reads mild for the severity"),
        comment(~given, "IMP-002", "Impact is missing"),
    ))
    out = F.struct(F.when(given, F.size(unsupported) == 0).alias("is_supported"), F.when(given, ~mild).alias("is_proportionate"), F.when(given, unsupported).alias("unsupported"))
    return df.withColumn("impact_review", out).withColumn("_c7", notes)


def recommendation(df: DataFrame) -> DataFrame:
    given = F.size("_recommendation") > 0
    actionable = any_of(c("_rec_text"), V.ACTION_WORDS)
    words = _word_map(c("cwe_id"), V.CWE_ROOT_CAUSES)
    root = F.when(given & words.isNotNull(), F.exists(words, lambda w: F.contains(c("_rec_text"), w)))
    notes = F.array_compact(F.array(
        comment(given & ~actionable, "REC-001", "Recommendation has no actionable step"),
        comment(root.eqNullSafe(False), "REC-002", "Recommendation may miss the root cause"),
        comment(~given, "REC-003", "No recommendation provided"),
    ))
    out = F.struct(F.when(given, actionable).alias("is_actionable"), root.alias("addresses_root_cause"), F.when(given, True).alias("is_relevant"))
    return df.withColumn("recommendation_review", out).withColumn("_c8", notes)


def retest(df: DataFrame) -> DataFrame:
    applicable, status, shown = c("retest.applicable"), c("retest.status"), F.coalesce(F.size("retest.evidence"), F.lit(0)) > 0
    untested = status.isNull() | (status == "not_retested") | applicable.isNull()
    known = status.isin(V.RETEST_STATUSES)
    # In this order: not applicable, not retested, known status, any other.
    case = F.when(applicable.eqNullSafe(False), "none").when(untested, "untested").when(known & shown, "shown").when(known, "unshown").when(status != "", "other").otherwise("none")
    notes = F.array_compact(F.array(
        comment(case == "untested", "RET-001", "Finding has not been retested"),
        comment(case == "unshown", "RET-002", "Retest status has no evidence"),
        comment(case == "other", "RET-003", "Retest status is not a known one"),
    ))
    out = F.struct(applicable.alias("applicable"), status.alias("status"), F.when(case == "shown", True).when(case == "unshown", False).alias("supported"))
    return df.withColumn("retest_review", out).withColumn("_c9", notes)


def consistency(df: DataFrame) -> DataFrame:
    """Eight rules; the third and fourth tell an issue without making the finding inconsistent."""
    title_size = F.size("_title_words")
    ratio = lambda text: F.size(hits(text, c("_title_words"))) / title_size
    some_evidence = (F.size("_items") > 0) & (F.trim("_evidence_text") != "")
    in_evidence = F.when((title_size > 0) & some_evidence, ratio(c("_evidence_text")))
    in_observation = F.when((title_size > 0) & (c("_observation") != ""), ratio(c("_observation")))
    specific = F.exists(F.filter("_source_words", lambda w: F.length(w) >= 4), lambda w: F.contains(c("_rec_text"), w))
    least = lambda e: F.when(e.type == "scanner_output", 0.05).otherwise(0.1)
    overlap = lambda e: F.size(hits(e.text, c("_source_words"))) / F.size("_source_words")
    unrelated = F.when((F.size("_items") > 0) & (F.size("_source_words") > 0), F.size(F.filter("_items", lambda e: overlap(e) < least(e)))).otherwise(0)
    strong, own = any_of(c("_impact"), V.STRONG_IMPACT), None
    for name, words in V.SEVERITY_IMPACT.items():
        own = F.when(c("severity") == name, any_of(c("_impact"), words)) if own is None else own.when(c("severity") == name, any_of(c("_impact"), words))
    own = F.coalesce(own, F.lit(True))
    high, low = F.coalesce(c("severity").isin("critical", "high"), F.lit(False)), F.coalesce(c("severity").isin("low", "informational"), F.lit(False))
    wordy = F.size(F.split(F.trim("_impact"), r"\s+")) > 5
    impact_issue = (F.trim("_impact") != "") & ~_blank("severity") & ((high & ~strong & ~own) | (low & strong) | (~own & wordy))
    rules = [
        ("CONS-001", F.coalesce(F.nullif(c("severity"), F.lit("")) != c("_band"), F.lit(False)), True),
        ("CONS-002", (c("classification.label") == "confirmed_vulnerability") & ~c("evidence_review.is_sufficient").eqNullSafe(True), True),
        ("CONS-003", F.coalesce(in_observation < 0.2, F.lit(False)), False),
        ("CONS-004", (F.size("_recommendation") > 0) & ((c("_title") != "") | (c("_observation") != "")) & ~specific, False),
        ("CONS-005", F.coalesce(in_evidence < 0.25, F.lit(False)), True),
        ("CONS-006", unrelated > 0, True),
        ("CONS-007", impact_issue, True),
    ]
    issues = F.array_compact(F.array(*[F.when(cond, code) for code, cond, _ in rules]))
    bad = reduce(lambda a, b: a | b, [cond for _, cond, breaks in rules if breaks])
    count = F.size(issues)
    summary = F.when(count == 0, "All consistency checks passed").when(count <= 2, "Minor consistency issues found").otherwise("Significant consistency issues found")
    notes = F.array(*[comment(cond, code, f"Consistency rule {code} is not met") for code, cond, _ in rules], comment(F.lit(True), "CONS-008", summary))
    out = F.struct((~bad).alias("is_consistent"), issues.alias("issues"), in_observation.alias("title_in_observation"), in_evidence.alias("title_in_evidence"))
    return df.withColumn("consistency", out).withColumn("_c10", F.array_compact(notes))


def confidence(df: DataFrame) -> DataFrame:
    """Weighted mean of five factors; a null factor takes no weight."""
    label, ok = c("classification.label"), c("classification.supported_by_evidence").eqNullSafe(True)
    known = F.coalesce(c("retest_review.status").isin(V.RETEST_STATUSES), F.lit(False))
    status = c("retest_review.status")
    factors = {
        "evidence": F.when(c("evidence_review.is_sufficient").isNull(), 0.0).when(c("evidence_review.is_sufficient"), 1.0).when(F.size("evidence_review.unsupported") > 0, 0.2).otherwise(0.5),
        "classification": F.when((label == "confirmed_vulnerability") & ok, 1.0).when(label == "confirmed_vulnerability", 0.3).when(label == "potential_issue", 0.7).when(label == "informational", 0.8).when(label == "false_positive", 0.6).when(label == "undetermined", 0.2).otherwise(0.5),
        "cvss": F.when(c("severity_review.is_consistent").isNull(), 0.5).when(c("severity_review.is_consistent"), 1.0).otherwise(0.2),
        "sections": F.when(~c("completeness.is_complete"), 0.3).when(F.size("completeness.missing_conditional") == 0, 1.0).otherwise(0.8),
        "retest": F.when(c("retest_review.applicable").eqNullSafe(False), 1.0).when(known & c("retest_review.supported").eqNullSafe(True), 1.0).when(known, 0.5).when(status.isNull() | (status == "not_retested"), 0.1).otherwise(0.3),
    }
    df = df.withColumn("factors", F.struct(*[v.alias(k) for k, v in factors.items()]))
    weighted = reduce(lambda a, b: a + b, [F.coalesce(c(f"factors.{k}") * w, F.lit(0.0)) for k, w in V.CONFIDENCE_WEIGHTS.items()])
    weight = reduce(lambda a, b: a + b, [F.when(c(f"factors.{k}").isNotNull(), w).otherwise(0.0) for k, w in V.CONFIDENCE_WEIGHTS.items()])
    score = F.round(F.try_divide(weighted, weight), 3)
    level = F.when(score.isNull(), "not_calculated").when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")
    basis, limits = (F.array_compact(F.array(*[_told(c(f"factors.{k}"), k, place) for k in V.CONFIDENCE_TEXTS])) for place in (0, 1))
    return df.withColumn("confidence", F.struct(score.alias("score"), level.alias("level"), basis.alias("basis"), limits.alias("limitations")))


def _told(score: Column, factor: str, place: int) -> Column:
    """What the first text of the factor that its score reaches says: its basis (0) or its limitation (1)."""
    ladder = None
    for least, *said in V.CONFIDENCE_TEXTS[factor]:
        text = F.lit(said[place]).cast("string")
        ladder = F.when(score >= least, text) if ladder is None else ladder.when(score >= least, text)
    return ladder


def escalation(df: DataFrame, strict_conflict: bool = False) -> DataFrame:
    """Reasons in order; the first kind of reviewer in order of seniority. ``strict_conflict`` also
    escalates evidence that both shows and denies success."""
    score, label = c("confidence.score"), c("classification.label")
    high = F.coalesce(c("severity").isin("critical", "high"), F.lit(False))
    unsupported = (label == "confirmed_vulnerability") & ~c("classification.supported_by_evidence").eqNullSafe(True)
    mismatch = c("severity_review.is_consistent").eqNullSafe(False)
    status = F.coalesce(c("retest.status"), F.lit(""))
    reasons = [
        (F.coalesce(score < 0.7, F.lit(False)), "low_confidence"),
        (F.coalesce(c("factors.evidence") < 0.5, F.lit(False)), "weak_evidence"),
        (high, "high_severity"),
        (unsupported, "unsupported_confirmation"),
        (mismatch, "severity_mismatch"),
        ((label == "confirmed_vulnerability") & status.isin("", "not_retested"), "not_retested"),
    ]
    if strict_conflict:
        reasons.append((c("evidence_review.is_sufficient").eqNullSafe(True) & (F.size("evidence_review.unsupported") > 0), "conflicting_evidence"))
    listed = _present(reasons)
    reviewer = F.when(high, "senior_pentester").when(unsupported, "technical_reviewer").when(mismatch, "report_reviewer")
    return df.withColumn("escalation", F.struct((F.size(listed) > 0).alias("required"), listed.alias("reasons"), reviewer.alias("reviewer")))


def status(df: DataFrame) -> DataFrame:
    complete, ok = c("completeness.is_complete"), c("evidence_review.is_sufficient")
    out = F.when(c("escalation.required"), "human_review").when(~complete | ok.eqNullSafe(False), "needs_revision").when(complete & ok.eqNullSafe(True), "pass").otherwise("needs_revision")
    return df.withColumn("review_status", out)


def numbered_comments(df: DataFrame, notes: list[str]) -> DataFrame:
    """The comments in these columns, in rule order, with dense ids and categories."""
    every = _all([c(name) for name in notes])
    numbered = F.transform(every, lambda x, i: F.struct(
        F.format_string("RC-%03d", i + 1).alias("comment_id"), x.code.alias("taxonomy_code"), category_of(x.code).alias("category"),
        x.severity.alias("severity"), x.field.alias("field"), x.message.alias("message"), x.evidence_reference.alias("evidence_reference"), x.suggested_action.alias("suggested_action")))
    return df.withColumn("review_comments", numbered)


#: Output column of each step, the outputs and the working columns that it reads, in the order of the steps.
STEPS = [
    ("completeness", completeness, [], ["_evidence", "_recommendation"]),
    ("evidence_review", evidence, [], ["_items"]),
    ("classification", classification, ["evidence_review"], []),
    ("severity_review", severity, [], ["_band"]),
    ("cvss_review", cvss, [], ["_band"]),
    ("cwe_review", cwe, [], ["_title"]),
    ("impact_review", impact, [], ["_impact", "_evidence_text"]),
    ("recommendation_review", recommendation, [], ["_recommendation", "_rec_text"]),
    ("retest_review", retest, [], []),
    ("consistency", consistency, ["evidence_review", "classification"], ["_band", "_title", "_observation", "_impact", "_items", "_recommendation", "_evidence_text", "_rec_text", "_title_words", "_source_words"]),
    ("confidence", confidence, ["completeness", "evidence_review", "classification", "severity_review", "retest_review"], []),
    ("escalation", None, ["confidence", "evidence_review", "classification", "severity_review"], []),
    ("review_status", status, ["escalation", "completeness", "evidence_review"], []),
]
OUTPUTS = [name for name, *_ in STEPS] + ["review_comments"]
NOTES = [name for name, *_ in STEPS[:10]]
#: Steps after which the rows are settled: later ones read their results more than once.
GROUPS = [["completeness", "evidence_review"], OUTPUTS[2:9], ["consistency"], ["confidence"], ["escalation"], ["review_status"]]
#: Working columns that are not settled: they cost no more than reading them.
CHEAP = {"_band", "_title", "_observation", "_impact", "_evidence", "_recommendation"}
INPUT = ["finding_id", "title", "severity", "cvss", "cwe_id", "impact", "observation", "evidence", "recommendation", "retest"]


def needed(only: list[str], comments_of: list[str]) -> set[str]:
    """The outputs asked for and all that they rest on."""
    reads = {name: outputs for name, _, outputs, _ in STEPS} | {"review_comments": comments_of}
    found: set[str] = set()
    waiting = list(only)
    while waiting:
        name = waiting.pop()
        if name not in found:
            found.add(name)
            waiting += reads[name]
    return found


def review(findings: DataFrame, ruleset: str = "1.0", strict_conflict: bool = False, only: list[str] | None = None, comments_of: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """Checks of every finding; working columns are dropped.

    ``only`` names the outputs wanted: then just the rules that they rest on are built, beside the
    ``INPUT`` columns and those of ``keep``. Without it all outputs stand beside all columns of ``findings``. ``comments_of`` names the rules whose comments
    are wanted, all by default; ids are dense over those.
    """
    spoken = [name for name in NOTES if comments_of is None or name in comments_of]
    wanted = needed(OUTPUTS if only is None else only, spoken)
    base = findings.columns if only is None else [*INPUT, *keep]
    steps = {name: (step, reads, work) for name, step, reads, work in STEPS if name in wanted}
    made: list[str] = []

    def rested(df: DataFrame, later: list[str]) -> DataFrame:
        """Settled, with the columns that are still needed."""
        work = {x for name in later for x in steps[name][2]}
        notes = [f"_c{NOTES.index(name) + 1}" for name in made if name in spoken and "review_comments" in wanted]
        kept = [*base, *made, *(["factors"] if "confidence" in made else []), *notes, *sorted(work)]
        return settled(df.select(*[F.col(f"`{x}`") for x in kept]))

    df = prepared(findings)
    todo = [name for group in GROUPS for name in group if name in steps]
    if any(x not in CHEAP for name in todo for x in steps[name][2]):
        df = rested(df, todo)
    for group in GROUPS:
        now = [name for name in group if name in steps]
        for name in now:
            df = escalation(df, strict_conflict) if name == "escalation" else steps[name][0](df)
            made.append(name)
        todo = [name for name in todo if name not in now]
        if now and (any(x in now for name in todo for x in steps[name][1]) or (not todo and "review_comments" in wanted)):
            df = rested(df, todo)
    if "review_comments" in wanted:
        df = settled(numbered_comments(df, [f"_c{NOTES.index(name) + 1}" for name in spoken]))
    review_id = F.format_string("REV-%06d", F.pmod(F.xxhash64("finding_id", F.lit(ruleset)), F.lit(1000000)))
    asked = [name for name in OUTPUTS if name in (wanted if only is None else only)]
    extra = ["factors"] if "confidence" in asked else []
    return df.withColumn("review_id", review_id).select(*[F.col(f"`{x}`") for x in [*base, *asked, *extra, "review_id"]])


#: Codes and severities as the output schema spells them.
EXPORT_CODES = {"IMP": "IMPACT", "REC": "REMD", "RET": "RETEST"}


def exported_comments(comments: Column) -> Column:
    spelled = lambda code: F.concat(F.coalesce(F.try_element_at(lookup(EXPORT_CODES), F.split_part(code, F.lit("-"), F.lit(1))), F.split_part(code, F.lit("-"), F.lit(1))), F.lit("-"), F.split_part(code, F.lit("-"), F.lit(2)))
    return F.transform(comments, lambda x: x.withField("taxonomy_code", spelled(x.taxonomy_code)).withField("severity", F.when(x.severity == "info", "suggestion").otherwise(x.severity)))


def output_record(reviews: DataFrame, reviewed_at: Column, versions: dict[str, str]) -> DataFrame:
    """The 18-field record of each review, as the output schema (``validation.REVIEW_SCHEMA``) names and spells its parts.

    ``reviews`` has all outputs beside ``document_id``, and ``location`` (a struct) if the source's place is known; ``cvss.version`` is
    reported if it is there. ``versions`` tells knowledge_base_version and ruleset_version; the time is given, so that a record can be
    made again. What the schema cannot spell is written as it can: a retest status of no known kind as ``unknown``, an info comment as a suggestion.
    """
    messages = lambda prefix: F.transform(F.filter("review_comments", lambda x: x.taxonomy_code.startswith(prefix)), lambda x: x.message)
    said = lambda prefix: F.array_join(messages(prefix), " ")
    given = lambda **columns: F.struct(*[value.alias(name) for name, value in columns.items()])
    sentences = lambda items, before, after: F.transform(items, lambda x: F.concat(F.lit(before), x, F.lit(after)))
    completeness_, evidence_, severity_, cvss_, cwe_ = (c(x) for x in ("completeness", "evidence_review", "severity_review", "cvss_review", "cwe_review"))
    impact_, recommendation_, retest_, none = c("impact_review"), c("recommendation_review"), c("retest_review"), F.lit(None).cast("string")
    location = c("location") if "location" in reviews.columns else none
    version = c("cvss.version") if "version" in reviews.schema["cvss"].dataType.names else none
    claims = F.concat(sentences(evidence_["shown"], "Evidence ", ": exploitation demonstrated"), _present([(evidence_["shown_by_hand"], "Manual exploitation with successful outcome confirmed")]))
    impact_claims = F.concat(sentences(F.coalesce(impact_["unsupported"], F.array().cast("array<string>")), "Impact mentions '", "' but evidence does not confirm"), _present([(impact_["is_supported"].isNull(), "No impact description provided")]))
    advice = F.array_compact(F.array(F.when(recommendation_["is_relevant"].isNull(), F.lit("No recommendation provided")), F.when(recommendation_["addresses_root_cause"].eqNullSafe(False), F.concat(F.lit("Recommendation may not address root cause for "), c("cwe_id")))))
    raised = lambda code: F.exists("review_comments", lambda x: x.taxonomy_code == code)
    unproven = F.array_compact(F.array(F.when(raised("RET-001"), F.lit("No retest performed")), F.when(raised("RET-002"), F.concat(F.lit("Retest status is '"), retest_["status"], F.lit("' but no retest evidence provided")))))
    status = F.when(retest_["status"].isNull() | retest_["status"].isin(*V.RETEST_STATUSES, "not_retested", "not_applicable"), retest_["status"]).otherwise("unknown")
    return reviews.select(
        F.lit("0.1").alias("schema_version"), "review_id", "finding_id", "review_status",
        given(label=c("classification.label"), rationale=said("CLASS-"), supported_by_evidence=c("classification.supported_by_evidence")).alias("classification"),
        given(is_complete=completeness_["is_complete"], missing_required_fields=completeness_["missing_required"], missing_conditional_fields=completeness_["missing_conditional"], comments=messages("COMP-")).alias("completeness_review"),
        given(is_sufficient=evidence_["is_sufficient"], evidence_items_reviewed=evidence_["reviewed"], supported_claims=claims, unsupported_claims=sentences(evidence_["unsupported"], "Evidence ", ": no successful exploitation demonstrated"), missing_evidence=evidence_["missing"], comments=messages("EVID-")).alias("evidence_review"),
        given(reported_severity=severity_["reported"], suggested_severity=F.coalesce(severity_["suggested"], severity_["reported"]), is_consistent=severity_["is_consistent"], change_recommended=severity_["change_recommended"], rationale=said("SEV-")).alias("severity_review"),
        given(reported_version=version, reported_score=c("cvss.score"), reported_vector=F.coalesce(c("cvss.vector"), F.lit("")), vector_is_valid=cvss_["vector_valid"], score_matches_vector=cvss_["score_matches_vector"], severity_matches_score=severity_["is_consistent"], requires_manual_recalculation=~cvss_["vector_valid"], comments=messages("CVSS-")).alias("cvss_review"),
        given(reported_cwe=cwe_["reported"], is_relevant=cwe_["is_relevant"], suggested_cwe=none, rationale=said("CWE-")).alias("cwe_review"),
        given(is_supported_by_evidence=impact_["is_supported"], is_proportionate=impact_["is_proportionate"], unsupported_impact_claims=impact_claims, comments=messages("IMP-")).alias("impact_review"),
        given(addresses_root_cause=recommendation_["addresses_root_cause"], is_actionable=recommendation_["is_actionable"], is_technically_relevant=recommendation_["is_relevant"], missing_recommendations=advice, comments=messages("REC-")).alias("recommendation_review"),
        given(is_consistent=c("consistency.is_consistent"), issues=c("consistency.issues")).alias("consistency_review"),
        given(applicable=retest_["applicable"], reported_status=status, status_supported_by_evidence=retest_["supported"], missing_retest_evidence=unproven, comments=messages("RET-")).alias("retest_review"),
        exported_comments(c("review_comments")).alias("review_comments"),
        given(overall_score=c("confidence.score"), level=c("confidence.level"), basis=c("confidence.basis"), limitations=c("confidence.limitations")).alias("confidence"),
        given(required=c("escalation.required"), reasons=c("escalation.reasons"), recommended_reviewer=c("escalation.reviewer")).alias("human_escalation"),
        given(source_document_id=c("document_id"), source_location=location, input_schema_version=F.lit("0.2"), output_schema_version=F.lit("0.1"), model_version=none, knowledge_base_version=F.lit(versions["knowledge_base_version"]), ruleset_version=F.lit(versions["ruleset_version"]), reviewed_at=reviewed_at).alias("traceability"),
    )


def stub_record(findings: DataFrame, issues: Column, reviewed_at: Column, versions: dict[str, str]) -> DataFrame:
    """The record of findings that may not be reviewed: nothing is judged, a human has to correct them. ``issues`` is the text of what is wrong.

    The columns are those of ``output_record``, so that both can stand in one table.
    """
    failed, none, unknown = "Input validation failed", F.lit(None).cast("string"), F.lit(None).cast("boolean")
    texts = lambda *said: F.array(*[F.lit(x) for x in said]).cast("array<string>")
    given = lambda **columns: F.struct(*[value.alias(name) for name, value in columns.items()])
    severity_, cwe_ = F.nullif(c("severity"), F.lit("")), F.nullif(c("cwe_id"), F.lit(""))
    note = given(
        comment_id=F.lit("RC-001"), taxonomy_code=F.lit("COMP-000"), category=F.lit("completeness"), severity=F.lit("error"), field=none,
        message=F.concat(F.lit(f"{failed}: "), F.coalesce(issues, F.lit("unknown"))), evidence_reference=none, suggested_action=F.lit("fix_input_and_resubmit"),
    )
    location = c("location") if "location" in findings.columns else none
    return findings.select(
        F.lit("0.1").alias("schema_version"), F.lit("REV-000000").alias("review_id"), F.coalesce("finding_id", F.lit("FND-000000")).alias("finding_id"), F.lit("human_review").alias("review_status"),
        given(label=F.lit("undetermined"), rationale=F.lit(f"{failed}, nothing was reviewed"), supported_by_evidence=unknown).alias("classification"),
        given(is_complete=F.lit(False), missing_required_fields=texts(), missing_conditional_fields=texts(), comments=texts(failed)).alias("completeness_review"),
        given(is_sufficient=unknown, evidence_items_reviewed=texts(), supported_claims=texts(), unsupported_claims=texts(), missing_evidence=texts(), comments=texts(failed)).alias("evidence_review"),
        given(reported_severity=severity_, suggested_severity=severity_, is_consistent=unknown, change_recommended=F.lit(False), rationale=F.lit(failed)).alias("severity_review"),
        given(reported_version=none, reported_score=F.lit(None).cast("double"), reported_vector=none, vector_is_valid=unknown, score_matches_vector=unknown, severity_matches_score=unknown, requires_manual_recalculation=F.lit(True), comments=texts(failed)).alias("cvss_review"),
        given(reported_cwe=cwe_, is_relevant=unknown, suggested_cwe=none, rationale=F.lit(failed)).alias("cwe_review"),
        given(is_supported_by_evidence=unknown, is_proportionate=unknown, unsupported_impact_claims=texts(), comments=texts(failed)).alias("impact_review"),
        given(addresses_root_cause=unknown, is_actionable=unknown, is_technically_relevant=unknown, missing_recommendations=texts(), comments=texts(failed)).alias("recommendation_review"),
        given(is_consistent=unknown, issues=texts(failed)).alias("consistency_review"),
        given(applicable=unknown, reported_status=none, status_supported_by_evidence=unknown, missing_retest_evidence=texts(), comments=texts(failed)).alias("retest_review"),
        F.array(note).alias("review_comments"),
        given(overall_score=F.lit(None).cast("double"), level=F.lit("not_calculated"), basis=texts(), limitations=texts(f"{failed}, so there is no confidence")).alias("confidence"),
        given(required=F.lit(True), reasons=texts(f"{failed}, a human must correct it"), recommended_reviewer=F.lit("technical_reviewer")).alias("human_escalation"),
        given(source_document_id=F.coalesce("document_id", F.lit("DOC-000000")), source_location=location, input_schema_version=F.lit("0.2"), output_schema_version=F.lit("0.1"), model_version=none, knowledge_base_version=F.lit(versions["knowledge_base_version"]), ruleset_version=F.lit(versions["ruleset_version"]), reviewed_at=reviewed_at).alias("traceability"),
    )


def gated_records(findings: DataFrame, gate: DataFrame, reviewed_at: Column, versions: dict[str, str]) -> DataFrame:
    """Records of all findings: of those that ``gate(finding_id, is_valid, issues)`` lets pass their review, of the others stubs that tell the issues.

    A finding that the gate does not know is not let pass.
    """
    verdict = gate.select(c("finding_id").alias("g_id"), c("is_valid").alias("g_valid"), c("issues").alias("g_issues"))
    judged = findings.join(verdict, c("finding_id") == c("g_id"), "left")
    valid = F.coalesce(c("g_valid"), F.lit(False))
    passed = output_record(review(judged.where(valid)), reviewed_at, versions)
    return passed.unionByName(stub_record(judged.where(~valid), c("g_issues"), reviewed_at, versions))


def record_outcome() -> Column:
    """A record's status, or ``error`` where its finding could not be reviewed."""
    return F.when(c("confidence.level") == "not_calculated", "error").otherwise(c("review_status"))


def record_counts(records: DataFrame) -> DataFrame:
    """(outcome, n): records by status, and as ``error`` those of findings that could not be reviewed."""
    return records.groupBy(record_outcome().alias("outcome")).agg(F.count("*").alias("n"))


def record_json(records: DataFrame) -> Column:
    """A record as JSON text in which null fields are told."""
    return F.to_json(F.struct(*[F.col(f"`{name}`") for name in records.columns]), {"ignoreNullFields": "false"})


def recomputed(findings: DataFrame) -> DataFrame:
    """What the score of each finding's vector is by the published equations, beside what is reported.

    (finding_id, reported, base, temporal, environmental, matches, band, severity_matches): matches tells whether the reported score is the base
    score, null where either is missing. Nothing is corrected, and ``score_matches_vector`` of the review stays unknown.
    """
    own = cvss_scores.scores(cvss_scores.decoded(c("cvss.vector")))
    scored = settled(findings.select("finding_id", "severity", c("cvss.score").alias("reported"), own.alias("own")))
    band = review_band(c("own.base"))
    return scored.select("finding_id", "reported", "own.base", "own.temporal", "own.environmental", (F.abs(c("reported") - c("own.base")) < 0.0001).alias("matches"), band.alias("band"), (F.nullif(c("severity"), F.lit("")) == band).alias("severity_matches"))


def review_stats(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("review_status").agg(F.count("*").alias("n"))
