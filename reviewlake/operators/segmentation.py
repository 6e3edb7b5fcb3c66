"""Ordered segmentation: forward fill, interval ownership, sections, context frames, pivots, joins of parsed parts.

All windows are partitioned by document, so documents are independent; block order is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import field_name, normalize_whitespace

c = F.col

# Labels that open a section, and names of metadata fields.
SECTION_ALIASES = {
    "observation": ["observation", "observations"],
    "exploitation": ["exploitation", "proof of concept", "proof-of-concept", "reproduction", "reproduction steps", "steps to reproduce"],
    "recommendation": ["recommendation", "recommendations", "remediation", "remediations"],
    "retest_verification": ["re-test verification result", "retest verification result", "re-test result", "retest result"],
}
FIELD_ALIASES = {
    "severity": ["severity"], "affected_targets": ["affected target", "affected targets"], "cwe": ["cwe", "cwe-id", "cwe id"], "impact": ["impact", "impact potential"],
    "retest_status": ["retest status", "re-test status"], "affected_user_roles": ["affected user role", "affected user roles"], "cvss": ["cvss", "cvss score"],
}


def _alias(column: Column, aliases: dict) -> Column:
    pairs = [F.lit(x) for name, words in aliases.items() for w in words for x in (w, name)]
    return F.try_element_at(F.create_map(*pairs), column)


def section_of(label: Column) -> Column:
    return _alias(F.rtrim(F.lower(normalize_whitespace(label)), F.lit(":")), SECTION_ALIASES)


def field_of(label: Column) -> Column:
    return _alias(field_name(label), FIELD_ALIASES)


def forward_fill(blocks: DataFrame, doc: str, order: str, marker: Column, name: str = "segment") -> DataFrame:
    """Each block with the newest non-null marker at or before it: interval ownership in one pass, without a join."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn(name, F.last(marker, ignorenulls=True).over(w))


def intervals(blocks: DataFrame, doc: str, order: str, is_marker: Column) -> DataFrame:
    """(doc, start, end, ordinal) of each marker's interval; the last one is open (null end)."""
    w = Window.partitionBy(doc).orderBy(order)
    marks = blocks.where(is_marker).select(doc, c(order).alias("start"))
    w = Window.partitionBy(doc).orderBy("start")
    return marks.select(doc, "start", F.lead("start").over(w).alias("end"), F.row_number().over(w).alias("ordinal"))


def owned_blocks(blocks: DataFrame, spans: DataFrame, doc: str, order: str) -> DataFrame:
    """Blocks with the interval they lie in, by an equi-join on the document with a range condition."""
    s = spans.withColumnRenamed(doc, "_doc")
    inside = (c(doc) == c("_doc")) & (c(order) >= c("start")) & (c("end").isNull() | (c(order) < c("end")))
    return blocks.join(s, inside).drop("_doc")


def segment_stats(owned: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    return owned.groupBy(*keys).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("blocks"), F.count_if(F.coalesce(c(text), F.lit("")) != "").alias("non_empty"))


def marker_order_faults(marks: DataFrame, doc: str, registry: str, start: str) -> DataFrame:
    """Markers that lie before the marker registered before them."""
    w = Window.partitionBy(doc).orderBy(registry)
    return marks.withColumn("previous", F.lag(start).over(w)).where(c("previous") > c(start))


def sections(blocks: DataFrame, doc: str, order: str, label: str, text: str) -> DataFrame:
    """(doc, section, paragraphs, combined_text): paragraphs in order, empty ones dropped, label blocks left out."""
    filled = forward_fill(blocks.withColumn("_label", section_of(c(label))), doc, order, c("_label"), "section")
    body = filled.where(c("_label").isNull() & c("section").isNotNull() & (F.trim(text) != ""))
    listed = body.groupBy(doc, "section").agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("p"))
    texts = F.transform("p", lambda p: p[text])
    return listed.select(doc, "section", texts.alias("paragraphs"), F.array_join(texts, "\n\n").alias("combined_text"))


def missing_sections(found: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """(doc, section) pairs of the fixed sections that a document lacks."""
    every = docs.select(doc).distinct().select(doc, F.explode(F.array(*[F.lit(s) for s in SECTION_ALIASES])).alias("section"))
    return every.join(found.select(doc, "section"), [doc, "section"], "left_anti")


def context_frame(blocks: DataFrame, doc: str, order: str, match: Column, before: int = 2, after: int = 9) -> DataFrame:
    """Blocks from ``before`` blocks ahead of a match to ``after`` behind it, with the match marked: one window, no self-join."""
    w = Window.partitionBy(doc).orderBy(order)
    near = F.max(match.cast("int")).over(w.rowsBetween(-after, before))
    return blocks.withColumns({"is_match": match, "_near": near}).where("_near = 1").drop("_near")


def pivot_fields(rows: DataFrame, key: str, label: str, value: str, order: str) -> DataFrame:
    """Key/value rows to one row a key with a column for each field; a repeated field takes its first value in order."""
    known = rows.withColumn("field", field_of(c(label))).where("field is not null")
    return known.groupBy(key).pivot("field", list(FIELD_ALIASES)).agg(F.min_by(value, order))


def field_faults(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Unknown labels and repeated fields: (key, fault, label)."""
    named = rows.withColumn("field", field_of(c(label)))
    unknown = named.where("field is null").select(key, F.lit("unknown_label").alias("fault"), c(label).alias("label"))
    twice = named.where("field is not null").groupBy(key, "field").count().where("count > 1").select(key, F.lit("duplicate_field").alias("fault"), c("field").alias("label"))
    return unknown.unionAll(twice)


def missing_fields(rows: DataFrame, key: str, label: str, required: list[str]) -> DataFrame:
    seen = rows.groupBy(key).agg(F.collect_set(field_of(c(label))).alias("s"))
    return seen.select(key, F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), "s")).alias("missing")).where("size(missing) > 0")


def assembled(metadata: DataFrame, parts: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """Inner three-way join on the key; sizes decide between broadcast and shuffle."""
    return raw.join(metadata, key).join(parts, key)


def compact_table(rows: Column) -> Column:
    """Table text: cells by single pipes, rows by double pipes, empty ones left out."""
    line = lambda r: F.array_join(F.filter(r["cells"], lambda x: x != ""), " | ")
    return F.array_join(F.filter(F.transform(rows, line), lambda x: x != ""), " || ")
