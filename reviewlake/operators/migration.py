"""Catalogue migration: ordered classification of sources and vulnerability types, backfill, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, strings

# Fixed values, in order: what a source string contains, the source's identifier and its kind of document.
SOURCES = [
    ("review_taxonomy.yaml", "POLICY-review_taxonomy", "policy_document"),
    ("data_usage_policy.yaml", "POLICY-data_usage", "policy_document"),
    ("data_protection_rules.yaml", "POLICY-data_protection", "policy_document"),
    ("system_responsibility.md", "POLICY-system_responsibility", "policy_document"),
    ("input_schema.json", "SCHEMA-input_schema", "schema_definition"),
    ("output_schema.json", "SCHEMA-output_schema", "schema_definition"),
    ("problem_definition.md", "DOC-problem_definition", "internal_guideline"),
    ("split_report.md", "DOC-split_report", "internal_guideline"),
    ("src/harness/kb/schema.py", "CODE-kb_schema", "schema_definition"),
    ("EVVO SOP", "EVVO-SOP-internal", "evvo_sop"),
    ("CVSS v3.1", "REF-CVSS-3.1", "internal_guideline"),
    ("MITRE CWE", "REF-MITRE-CWE", "internal_guideline"),
]
#: By category where no source string tells.
CATEGORY_SOURCES = {"sop": ("DOC-problem_definition", "evvo_sop"), "taxonomy_definitions": ("SCHEMA-registry", "schema_definition")}
OTHER_SOURCE = ("EVVO-internal", "evvo_rule")
#: In order: phrases of a title, tags, and the vulnerability type that any of them tells.
VULNERABILITY_RULES = [
    (["hardcoded", "hard-coded"], ["credential"], "hardcoded_credentials"),
    (["jwt", "hs256", "cryptographic"], ["crypto"], "weak_crypto_algorithm"),
    (["root detection"], [], "missing_root_detection"),
    (["ssl pinning", "certificate validation"], [], "weak_ssl_pinning"),
    (["enumeration", "username", "email enumeration"], [], "user_enumeration"),
    (["xss", "cross-site scripting"], [], "xss"),
    (["sqli", "sql injection"], [], "sqli"),
    (["csrf"], [], "csrf"),
    (["ssrf"], [], "ssrf"),
    (["authorization", "privilege"], [], "authorization_bypass"),
    (["authentication"], [], "authentication_bypass"),
    (["information disclosure", "info disclosure"], [], "information_disclosure"),
    (["business logic"], [], "business_logic"),
]


def _first(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    chain = F.when(*rules[0])
    for when, then in rules[1:]:
        chain = chain.when(when, then)
    return chain.otherwise(otherwise)


def source_class(source: Column, category: Column, subcategory: Column) -> Column:
    """struct(source_id, document_type, section): the first source string that occurs, else the category, decides. Case counts."""
    told = lambda pair: F.struct(F.lit(pair[0]).alias("source_id"), F.lit(pair[1]).alias("document_type"))
    text, kind, sub = (F.coalesce(x, F.lit("")) for x in (source, category, subcategory))
    rules = [(F.contains(text, F.lit(part)), told(pair)) for part, *pair in SOURCES] + [(kind == name, told(pair)) for name, pair in CATEGORY_SOURCES.items()]
    found = _first(rules, told(OTHER_SOURCE))
    section = F.when((kind == "sop") & (sub == "pipeline_step"), F.concat(F.lit("pipeline:"), sub)).when(kind == "sop", F.concat(F.lit("sop:"), sub)).when(sub != "", F.concat_ws(":", kind, sub)).otherwise(kind)
    return F.struct(found["source_id"].alias("source_id"), found["document_type"].alias("document_type"), section.alias("section"))


def vulnerability_type(title: Column, tags: Column) -> Column:
    """The first rule with a phrase in the title or a tag of its own decides, case aside."""
    text = F.lower(F.coalesce(title, F.lit("")))
    folded = F.transform(F.coalesce(tags, strings([])), F.lower)
    rules = [(any_of(text, phrases) | F.arrays_overlap(folded, strings(own)) if own else any_of(text, phrases), F.lit(name)) for phrases, own, name in VULNERABILITY_RULES]
    return _first(rules, F.lit("general"))


def backfill(rows: DataFrame, raw: str, defaults: dict[str, str]) -> DataFrame:
    """Columns of ``defaults``: the raw JSON's value where the key is there (null included), else the default."""
    keys = F.json_object_keys(raw)
    return rows.withColumns({k: F.when(F.array_contains(keys, k), F.get_json_object(raw, f"$.{k}")).otherwise(v) for k, v in defaults.items()})


def upsert(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Rows of ``patches`` take the place of rows with their key or are added; running it again changes nothing."""
    return rows.join(patches.select(key), key, "left_anti").unionByName(patches)


def category_counts(rows: DataFrame, category: str = "category") -> DataFrame:
    return rows.rollup(category).agg(F.count("*").alias("n"))
