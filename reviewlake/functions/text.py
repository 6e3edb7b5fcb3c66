"""Text functions as Column -> Column; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import CODE_CATEGORIES, STOP_WORDS

WHITE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body reads it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE, " "))


def fingerprint(title: Column, body: Column) -> Column:
    """Case and white space do not count."""
    return normalize_whitespace(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))))


def field_name(label: Column) -> Column:
    return normalize_whitespace(F.translate(F.lower(label), "():", "   "))


def severity(value: Column) -> Column:
    v = F.lower(normalize_whitespace(value))
    v = F.when(v == "info", "informational").otherwise(v)
    return F.when(v.isin("critical", "high", "medium", "low", "informational", "none", "unknown"), v)


def cwe_id(value: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(value, r"(?i)\bCWE-\d+\b", 0), F.lit("")))


def cwe_description(value: Column) -> Column:
    rest = F.regexp_replace(value, r"(?i)^.*?\bCWE-\d+\b", "")
    return F.when(cwe_id(value).isNotNull(), F.nullif(F.trim(F.ltrim(rest, F.lit(" :-"))), F.lit("")))


#: Fixed value: a complete vector of base metrics.
_VECTOR = r"(?i)CVSS:(\d\.\d)/(AV:[NALP]/AC:[LH]/PR:[NLH]/UI:[NR]/S:[UC]/C:[NLH]/I:[NLH]/A:[NLH])"


def cvss(value: Column) -> Column:
    """What is reported in text such as ``9.8 (CVSS:3.1/AV:N/...)``: score, version, vector, both in one form, notes on what differs.

    An incomplete vector is none, and without a vector there is no version. Nothing is recalculated.
    """
    score = F.regexp_extract(value, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    version = F.nullif(F.regexp_extract(value, _VECTOR, 1), F.lit(""))
    vector = F.concat(F.lit("CVSS:"), version, F.lit("/"), F.upper(F.regexp_extract(value, _VECTOR, 2)))
    rendering = F.concat(score.cast("string"), F.lit(" ("), vector, F.lit(")"))
    notes = F.array_compact(F.array(
        F.when(score.isNull(), "score not parsed"), F.when(vector.isNull(), "vector not parsed"), F.when(rendering != normalize_whitespace(value), "source formatting differs")))
    return F.struct(
        value.alias("reported_value"), score.alias("score"), version.alias("version"), vector.alias("vector"), rendering.alias("normalized_rendering"),
        (score.isNotNull() & vector.isNotNull()).alias("parse_successful"), notes.alias("notes"),
    )


# Named characters of HTML that texts of reports hold.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "sect": "§", "para": "¶", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "times": "×", "sol": "/", "colon": ":", "period": ".", "amp": "&",
}


def unescape_html(text: Column) -> Column:
    """Named (``ENTITIES``), decimal and hexadecimal character references as their characters, once: what they give is not read again.

    A reference to no character, or to a name that is not listed, stays as it is.
    """

    def char(reference: Column) -> Column:
        body = F.regexp_extract(reference, "^&(.*);$", 1)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 6), 16, 10)).otherwise(F.substring(body, 2, 7)).try_cast("int")
        sound = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        coded = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.coalesce(F.when(body.startswith("#"), coded).otherwise(F.try_element_at(lookup(ENTITIES), body)), reference)

    # Between references the text stays: pieces and references alternate.
    pattern = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});"
    pieces, references = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    joined = let(F.transform(references, char), lambda chars: F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(chars, i), F.lit("")))), ""))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def first_url(text: Column) -> Column:
    found = F.regexp_extract(unescape_html(text), r"(?i)https?://[^\s\"'<>]+", 0)
    return F.nullif(F.regexp_replace(found, r"[\])}.,;]+$", ""), F.lit(""))


#: Fixed values, in order: the first that occurs decides.
TARGET_RULES = [
    ("android", "android_application"), ("apk", "android_application"), ("ios", "ios_application"), ("web", "web_application"), ("url", "web_application"),
    ("api", "api"), ("jwt", "cryptographic_component"), ("token", "cryptographic_component"), ("network", "network"), ("cloud", "cloud_resource"),
]


def target_type(text: Column) -> Column:
    lower = F.lower(text)
    rules = reduce(lambda c, r: c.when(F.contains(lower, F.lit(r[0])), r[1]), TARGET_RULES, F.when(first_url(text).isNotNull(), "web_application"))
    return rules.otherwise("unknown")


def affected_target(value: Column) -> Column:
    """struct(target_type, reported_value, normalized_value, notes): the URL if there is one, else the text with single spaces."""
    url = first_url(value)
    host = F.try_parse_url(url, F.lit("HOST"))
    notes = F.array_compact(F.array(
        F.when(F.contains(value, F.lit("<")) & F.contains(value, F.lit(">")), "contains markup"), F.when(url.isNotNull() & host.isNull(), "URL without a host")))
    return F.struct(target_type(value).alias("target_type"), value.alias("reported_value"), F.coalesce(url, normalize_whitespace(value)).alias("normalized_value"), notes.alias("notes"))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(n))), F.lit("...")))


def keywords(text: Column) -> Column:
    """Distinct words of three or more characters that are no stop words, in order of first occurrence."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\s_-]", " ")), r"\s+")
    # array_except hashes its right side, drops repeats and keeps the order of first occurrence.
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 3), strings(STOP_WORDS))


def hits(text: Column, words: Column) -> Column:
    """The words that occur in the text as substrings, in the words' order."""
    return F.filter(words, lambda w: F.contains(text, w))


def any_of(text: Column, words) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def content_hash(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by U+001F, nulls as U+0000."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]), 256), F.lit(16))


def category_of(code: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup(CODE_CATEGORIES), F.split_part(code, F.lit("-"), F.lit(1))), F.lit("completeness"))


def json_text(output: Column) -> Column:
    """The JSON object in a model's answer: a fenced block, else from the first { to the last }."""
    fenced = F.nullif(F.regexp_extract(output, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(output, r"(?s)(\{.*\})", 1), F.lit("")))


def parse_error(output: Column) -> Column:
    parsed = F.try_parse_json(json_text(output))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, "FMT-INVALID-JSON")


def message(role: str, content: Column) -> Column:
    return F.concat(F.lit(f"<|im_start|>{role}\n"), content, F.lit("<|im_end|>\n"))
