"""Redaction by ordered patterns, a log of replacements, and verification. Pure column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, let
from ..functions.values import FINDING_ID, REDACTIONS
from . import dictionary

#: Texts that stay although they match: example addresses, and public references.
EXCEPTIONS = {"email_address": r"(?i)@example\.(com|org|net)$", "client_url": r"(?i)^https?://([a-z0-9.-]*\.)?(owasp\.org|portswigger\.net)"}


def possible(name: str, text: Column) -> Column:
    """Whether a pattern can match at all, by a plain search for what each match of it holds: most texts need no regular expression."""
    needs = {
        "generic_password": lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")), "connection_string": lambda t: F.contains(t, F.lit("://")), "email_address": lambda t: F.contains(t, F.lit("@")),
        "phone_number": lambda t: t.rlike("[0-9]{3}"), "private_ip": lambda t: t.rlike("[0-9]\\.[0-9]"), "client_url": lambda t: F.contains(t, F.lit("://")), "apk_name": lambda t: F.contains(F.lower(t), F.lit(".apk")),
    }
    return F.coalesce(needs[name](text), F.lit(False))


def _replaced(value: Column, rule: tuple[str, str, str]) -> Column:
    name, pattern, replacement = rule
    if name not in EXCEPTIONS:
        return F.when(possible(name, value), F.regexp_replace(value, pattern, replacement)).otherwise(value)
    kept = F.filter(F.array_distinct(F.regexp_extract_all(value, F.lit(f"({pattern})"), F.lit(1))), lambda m: ~m.rlike(EXCEPTIONS[name]))
    # Longest first, so that no match is cut by a shorter one that it contains.
    ordered = F.array_sort(kept, lambda a, b: F.length(b) - F.length(a))
    return F.when(possible(name, value), F.aggregate(ordered, value, lambda t, m: F.replace(t, m, F.lit(replacement)))).otherwise(value)


def redacted(text: Column) -> Column:
    """Patterns are applied in order; excepted matches are kept by splicing around them."""
    return reduce(_replaced, REDACTIONS, text)


def redaction_log(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pattern, matches) of the original text, patterns with matches only."""
    counts = F.array(*[F.struct(F.lit(name).alias("pattern"), F.when(possible(name, F.col(text)), F.regexp_count(text, F.lit(pattern))).otherwise(0).cast("long").alias("matches")) for name, pattern, _ in REDACTIONS])
    return rows.select(key, F.explode(F.filter(counts, lambda x: x.matches > 0)).alias("x")).select(key, "x.*")


def found(name: str, pattern: str, text: Column) -> Column:
    """The matches of a pattern that are no exceptions, where it can match at all."""
    every = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    kept = F.filter(every, lambda m: ~m.rlike(EXCEPTIONS[name])) if name in EXCEPTIONS else every
    return F.when(possible(name, text), kept).otherwise(F.array().cast("array<string>"))


def remaining(rows: DataFrame, text: str, redact: bool = True) -> DataFrame:
    """(pattern, documents) of every pattern that still matches after redaction (or, without ``redact``, in the text as it is), exceptions
    aside: none is the aim."""
    out = redacted(F.col(text)) if redact else F.col(text)
    left = F.array(*[F.when(F.size(found(name, pattern, F.col("t"))) > 0, F.lit(name)) for name, pattern, _ in REDACTIONS])
    return rows.select(out.alias("t")).select(F.explode(F.array_compact(left)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("documents"))


def replacements(text: Column) -> Column:
    """struct(text, log): the redacted text, and for each pattern in order what it replaced: pattern, replacement, matches in the text as
    the patterns before left it."""
    entry = "array<struct<pattern:string,replacement:string,matches:bigint>>"
    state = F.struct(text.alias("text"), F.array().cast(entry).alias("log"))
    for rule in REDACTIONS:
        state = let(state, _step(rule))
    return state


def _step(rule: tuple[str, str, str]):
    name, pattern, replacement = rule

    def step(s: Column) -> Column:
        told = F.struct(F.lit(name).alias("pattern"), F.lit(replacement).alias("replacement"), F.size(found(name, pattern, s["text"])).cast("long").alias("matches"))
        return F.struct(_replaced(s["text"], rule).alias("text"), F.concat(s["log"], F.array(told)).alias("log"))

    return step


def log_entries(rows: DataFrame, fields: list[str], at: Column) -> DataFrame:
    """(document_id, finding_id, field, original_pattern, replacement, matches, timestamp): what redaction replaces in each field, patterns with
    matches only. The time is given, so that a log can be made again."""
    texts = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("text")) for name in fields])).alias("x")
    each = rows.select("document_id", "finding_id", texts).select("document_id", "finding_id", "x.field", F.explode(F.filter(replacements(F.col("x.text"))["log"], lambda e: e.matches > 0)).alias("e"))
    return each.select("document_id", "finding_id", "field", F.col("e.pattern").alias("original_pattern"), "e.replacement", "e.matches", at.alias("timestamp"))


#: The checks after redaction, and the patterns that two of them look for.
POST_CHECKS = ["no_credentials_remaining", "no_urls_remaining", "no_names_remaining", "redaction_tag_consistency", "traceability_preserved"]
CREDENTIALS, URLS = ["generic_password", "connection_string"], ["client_url"]


def post_checks(rows: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """(document_id, finding_id, check) of redacted rows that fail a check; ``names(name)`` are the people and clients of the engagements.

    Credentials, URLs (exceptions aside) and known names must be gone, tags well formed, and a document and a finding still told.
    """
    t = F.col(text)
    left = lambda wanted: F.concat(*[found(name, pattern, t) for name, pattern, _ in REDACTIONS if name in wanted])
    lost = ~F.coalesce(F.col("finding_id").rlike(FINDING_ID) & (F.trim("document_id") != ""), F.lit(False))
    failed = {"no_credentials_remaining": F.size(left(CREDENTIALS)) > 0, "no_urls_remaining": F.size(left(URLS)) > 0, "redaction_tag_consistency": malformed_tags(t) > 0, "traceability_preserved": lost}
    local = rows.select("document_id", "finding_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in failed.items()]))).alias("check"))
    named = dictionary.matches(rows.select(F.struct("document_id", "finding_id").alias("row"), text), "row", text, names).select("row.*", F.lit("no_names_remaining").alias("check"))
    return local.unionByName(named.distinct())


#: By context: (name, words of which the text must hold one, pattern, replacement). Labels stay, what they name goes.
CONTEXTUAL = [
    ("broker_credentials", ["rabbit", "amqp"], r"(?i)\b(hostname|username|password)(\s*=\s*)[^\s,;]+", "$1$2[REDACTED_CREDENTIAL]"),
    ("person_name", ["contact", "manager", "author", "pentester", "reviewer", "approver"], r"\b((?i:contact|manager|author|pentester|reviewer|approver)\s*:\s*)[A-Z][A-Za-z.'-]*(?: [A-Z][A-Za-z.'-]*)*", "$1[REDACTED_NAME]"),
    ("internal_hostname", ["host", "server", "broker", "endpoint"], r"(?i)\b((?:host|server|broker|endpoint)\s*[:=]?\s+)[a-z0-9-]+(?:\.[a-z0-9-]+)+", "$1[REDACTED_HOST]"),
]


def redacted_by_context(text: Column) -> Column:
    """Patterns that hold only near their words: broker credentials, names of people, internal host names. Run before ``redacted``."""
    for _, words, pattern, replacement in CONTEXTUAL:
        text = F.when(any_of(F.lower(text), words), F.regexp_replace(text, pattern, replacement)).otherwise(text)
    return text


def malformed_tags(text: Column) -> Column:
    """Redaction tags that are cut or misspelt: each ``[REDACTED`` must go on as ``_NAME]``."""
    return F.regexp_count(text, F.lit(r"\[REDACTED(?!_[A-Z]+\])"))
