"""Queries of score vectors, canonical JSON, names and keyed tables, with SQL twins that write equations and texts out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import canonical, cvss
from ..operators import dictionary, lookup
from ..operators.review import recomputed, settled
from .synthetic import WITH, case, findings, flat_findings, table

c = F.col

# ---------------------------------------------------------------- score vectors


def _digit(letters: str, below: int) -> str:
    return f"substr('{letters}', 1 + CAST(CAST(floor(doc_id * 7919 / {below}) AS BIGINT) % {len(letters)} AS INT), 1)"


_PARTS, _below = [], 1
for _name, _letters in (("AV", "NALP"), ("AC", "LH"), ("PR", "NLH"), ("UI", "NR"), ("S", "UC"), ("C", "HLN"), ("I", "LHN"), ("A", "NLH")):
    _PARTS.append(f"'/{_name}:' || {_digit(_letters, _below)}")
    _below *= len(_letters)
_TEMPORAL = "'/E:' || " + _digit("XHFPU", 3) + " || '/RL:' || " + _digit("UWTOX", 7) + " || '/RC:' || " + _digit("CRUX", 11)
_LOCAL = "'/CR:' || " + _digit("HMLX", 2) + " || '/IR:' || " + _digit("XLMH", 5) + " || '/MAV:' || " + _digit("XNALP", 13) + " || '/MS:' || " + _digit("XUC", 17) + " || '/MC:' || " + _digit("NXHL", 19) + " || '/MPR:' || " + _digit("HXNL", 23)
#: Vectors of all kinds, told by the document's number alone; every eleventh is spoilt in one of four ways.
VECTORS_SQL = f"""
SELECT doc_id, CASE doc_id % 44 WHEN 0 THEN 'CVSS:2.0' || base || local WHEN 11 THEN head || base || '/AV:N' WHEN 22 THEN head || replace(base, '/UI:', '/UX:') WHEN 33 THEN head || substr(base, 6) ELSE head || base || temporal || local END AS vector
FROM (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'CVSS:3.1' ELSE 'CVSS:3.0' END AS head, {' || '.join(_PARTS)} AS base, CASE WHEN doc_id % 3 = 0 THEN {_TEMPORAL} ELSE '' END AS temporal, CASE WHEN doc_id % 5 < 2 THEN {_LOCAL} ELSE '' END AS local FROM documents) AS parts
"""


def _vectors(s, d):
    return s.sql(VECTORS_SQL.replace("FROM documents", "FROM {docs}"), docs=table(s, d, "documents"))


def _scored(s, d):
    rows = _vectors(s, d).withColumn("decoded", cvss.decoded(c("vector")))
    rows = settled(rows.select("doc_id", "vector", "decoded.version", cvss.scores(c("decoded")).alias("own")))
    return rows.select("doc_id", "vector", "version", F.round("own.impact", 6).alias("impact"), F.round("own.exploitability", 6).alias("exploitability"), "own.base", "own.temporal", "own.environmental")


def _equations(rows: str) -> str:
    """SQL of the published equations over ``rows`` with a vector that is sound (column ``sound``)."""
    m = lambda name: f"nullif(regexp_extract(vector, '/{name}:([A-Z])', 1), '')"
    av = lambda x: f"CASE {x} WHEN 'N' THEN 0.85::DOUBLE WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 WHEN 'P' THEN 0.2 END"
    pr = lambda x, s: f"CASE {x} WHEN 'N' THEN 0.85::DOUBLE WHEN 'L' THEN CASE {s} WHEN 'C' THEN 0.68 ELSE 0.62 END ELSE CASE {s} WHEN 'C' THEN 0.5 ELSE 0.27 END END"
    loss = lambda x: f"CASE {x} WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END"
    need = lambda x: f"CASE {x} WHEN 'H' THEN 1.5::DOUBLE WHEN 'L' THEN 0.5 ELSE 1 END"
    up = lambda x: f"(CASE WHEN newer THEN CASE WHEN CAST(round({x} * 100000) AS BIGINT) % 10000 = 0 THEN CAST(round({x} * 100000) AS BIGINT) / 100000.0::DOUBLE ELSE (floor(CAST(round({x} * 100000) AS BIGINT) / 10000) + 1) / 10.0::DOUBLE END ELSE ceil({x} * 10) / 10.0::DOUBLE END)"
    local = lambda name: f"coalesce(nullif({m('M' + name)}, 'X'), {m(name)})"
    return f"""read AS (SELECT *, substr(vector, 8, 1) = '1' AS newer, {m('S')} AS s, {local('S')} AS ms, 8.22::DOUBLE * {av(m('AV'))} * CASE {m('AC')} WHEN 'L' THEN 0.77::DOUBLE ELSE 0.44 END * {pr(m('PR'), m('S'))} * CASE {m('UI')} WHEN 'N' THEN 0.85::DOUBLE ELSE 0.62 END AS ex,
        8.22::DOUBLE * {av(local('AV'))} * CASE {local('AC')} WHEN 'L' THEN 0.77::DOUBLE ELSE 0.44 END * {pr(local('PR'), local('S'))} * CASE {local('UI')} WHEN 'N' THEN 0.85::DOUBLE ELSE 0.62 END AS mex,
        1 - (1 - {loss(m('C'))}) * (1 - {loss(m('I'))}) * (1 - {loss(m('A'))}) AS iss,
        least(1 - (1 - {need(m('CR'))} * {loss(local('C'))}) * (1 - {need(m('IR'))} * {loss(local('I'))}) * (1 - {need(m('AR'))} * {loss(local('A'))}), 0.915::DOUBLE) AS miss,
        CASE {m('E')} WHEN 'F' THEN 0.97::DOUBLE WHEN 'P' THEN 0.94 WHEN 'U' THEN 0.91 ELSE 1 END * CASE {m('RL')} WHEN 'W' THEN 0.97::DOUBLE WHEN 'T' THEN 0.96 WHEN 'O' THEN 0.95 ELSE 1 END * CASE {m('RC')} WHEN 'R' THEN 0.96::DOUBLE WHEN 'U' THEN 0.92 ELSE 1 END AS damp FROM {rows} WHERE sound),
    impacts AS (SELECT *, CASE s WHEN 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS im,
        CASE ms WHEN 'C' THEN 7.52::DOUBLE * (miss - 0.029::DOUBLE) - 3.25::DOUBLE * CASE WHEN newer THEN pow(miss * 0.9731::DOUBLE - 0.02::DOUBLE, 13) ELSE pow(miss - 0.02::DOUBLE, 15) END ELSE 6.42::DOUBLE * miss END AS mim FROM read),
    sums AS (SELECT *, CASE WHEN im <= 0 THEN 0::DOUBLE ELSE least(CASE s WHEN 'C' THEN 1.08::DOUBLE ELSE 1 END * (im + ex), 10) END AS b, CASE WHEN mim <= 0 THEN 0::DOUBLE ELSE least(CASE ms WHEN 'C' THEN 1.08::DOUBLE ELSE 1 END * (mim + mex), 10) END AS e FROM impacts),
    rounded AS (SELECT *, {up('b')} AS base, {up('e')} AS inner_e FROM sums),
    scored AS (SELECT *, {up('base * damp')} AS temporal, CASE WHEN mim <= 0 THEN 0 ELSE {up('inner_e * damp')} END AS environmental FROM rounded)"""


# ---------------------------------------------------------------- canonical JSON


def _hashed_cases(s, d):
    """Cases with nested input and metadata, over all findings."""
    f = findings(s, d)
    n = F.substring("finding_id", 5, 6).cast("long")
    cases = f.select(
        F.concat(F.lit("BMC-"), "finding_id").alias("case_id"), F.lit("finding_review").alias("task_type"),
        F.struct("finding_id", "title", "observation", "cvss", F.transform("evidence", lambda e: F.struct(e.evidence_id.alias("id"), e.content.alias("content"))).alias("evidence")).alias("input"),
        F.struct(F.lit("old").alias("content_hash"), "engagement_id", (n % 3 == 0).alias("is_hard_negative"), n.alias("line"), F.create_map(F.lit("z"), c("severity"), F.lit("é"), F.lit("1")).alias("tags")).alias("metadata"),
    )
    hashes = canonical.payload_hashes(cases.schema)
    return cases.select("case_id", *[value.alias(name) for name, value in hashes.items()])


def _escaped(text: str, ascii: bool) -> str:
    """SQL of the JSON form of a text, null as null."""
    written = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"} | {chr(i): f"\\u{i:04x}" for i in range(1, 32) if chr(i) not in "\n\r\t\f\b"}
    out = text
    for plain, form in written.items():
        out = f"replace({out}, chr({ord(plain)}), '{form}')"
    if ascii:
        char = "CASE WHEN unicode(c) > 65535 THEN format('\\u{:04x}\\u{:04x}', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) WHEN unicode(c) > 126 THEN format('\\u{:04x}', unicode(c)) ELSE c END"
        out = f"array_to_string(list_transform(regexp_extract_all({out}, '(?s).'), lambda c: {char}), '')"
    return f"coalesce('\"' || {out} || '\"', 'null')"


def _case_sql(ascii: bool) -> dict[str, str]:
    t = lambda x: _escaped(x, ascii)
    number = "coalesce(CAST(score AS VARCHAR), 'null')"
    items = f"""'[' || coalesce((SELECT string_agg('{{"content": ' || {t('e.content')} || ', "id": ' || {t('e.evidence_id')} || '}}', ', ' ORDER BY e.i) FROM evidence e WHERE e.finding_id = f.finding_id), '') || ']'"""
    inputs = f"""'{{"cvss": {{"score": ' || {number} || ', "vector": ' || {t('vector')} || '}}, "evidence": ' || {items} || ', "finding_id": ' || {t('finding_id')} || ', "observation": ' || {t('observation')} || ', "title": ' || {t('title')} || '}}'"""
    tags = f"""'{{"z": ' || {t('severity')} || ', "{"\\u00e9" if ascii else "é"}": "1"}}'"""
    rest = f"""'"engagement_id": ' || {t('engagement_id')} || ', "is_hard_negative": ' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END || ', "line": ' || doc_id || ', "tags": ' || {tags} || '}}'"""
    head = f"""'{{"case_id": ' || {t("'BMC-' || finding_id")} || ', "input": ' || {inputs} || ', "metadata": {{'"""
    return {
        "whole": f"""{head} || {rest} || ', "task_type": "finding_review"}}'""",
        "record": f"""{head} || '"content_hash": "old", ' || {rest} || ', "task_type": "finding_review"}}'""",
        "example": f"""'{{"input": ' || {inputs} || ', "task_type": "finding_review"}}'""",
        "input": inputs,
    }


# ---------------------------------------------------------------- names

#: Names are the first two words of benchmark passages, if they are letters and differ; all documents are searched for them.
_HEAD = r"^(\p{L}+) (\p{L}+)[ .,;]"


def _names(s, d):
    first, second = (F.regexp_extract("text", _HEAD, i) for i in (1, 2))
    return table(s, d, "benchmark").select(F.concat(first, F.lit(" "), second).alias("name")).where((F.length("name") >= 8) & (F.lower(F.split_part("name", F.lit(" "), F.lit(1))) != F.lower(F.split_part("name", F.lit(" "), F.lit(2)))))


def _known_names(s, d):
    return dictionary.matches(table(s, d, "documents"), "doc_id", "text", _names(s, d)).select("doc_id", "name", "n")


NAMES_SQL = r"""WITH heads AS (SELECT regexp_extract(text, '^(\p{L}+) (\p{L}+)[ .,;]', 1) AS a, regexp_extract(text, '^(\p{L}+) (\p{L}+)[ .,;]', 2) AS b FROM benchmark), names AS (SELECT DISTINCT a || ' ' || b AS name FROM heads WHERE length(a || ' ' || b) >= 8 AND lower(a) <> lower(b))"""
PAIRS_SQL = r"""words AS (SELECT doc_id, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS w FROM ({})), pairs AS (SELECT doc_id, unnest(list_transform(range(1, greatest(1, length(w) - 1)), lambda i: CASE WHEN w[i + 1] = ' ' THEN w[i] || ' ' || w[i + 2] END)) AS pair FROM words)"""

QUERIES = {
    "cvss_vectors": _scored,
    "cvss_recomputed": lambda s, d: recomputed(findings(s, d)),
    "canonical_hashes": _hashed_cases,
    "known_names": _known_names,
}

_UTF8, _ASCII = _case_sql(False), _case_sql(True)
_H = "sha256({})[1:16]"
ORACLE_SQL = {
    "cvss_vectors": f"""WITH vectors AS (SELECT *, doc_id % 11 <> 0 AS sound FROM ({VECTORS_SQL})), {_equations('vectors')}
        SELECT doc_id, v.vector, CASE WHEN v.sound THEN substr(v.vector, 6, 3) END AS version, round(im, 6) AS impact, round(ex, 6) AS exploitability, base, temporal, environmental FROM vectors v LEFT JOIN scored USING (doc_id)""",
    "cvss_recomputed": f"""{WITH}, vectors AS (SELECT *, coalesce(vector LIKE 'CVSS:3%', false) AS sound FROM findings), {_equations('vectors')},
        joined AS (SELECT f.finding_id, f.severity, f.score, s.base, s.temporal, s.environmental, CASE WHEN base >= 9.0 THEN 'critical' WHEN base >= 7.0 THEN 'high' WHEN base >= 4.0 THEN 'medium' WHEN base >= 0.1 THEN 'low' WHEN base IS NOT NULL THEN 'informational' END AS band FROM findings f LEFT JOIN scored s ON f.doc_id = s.doc_id)
        SELECT finding_id, score AS reported, base, temporal, environmental, abs(score - base) < 0.0001 AS matches, band, severity = band AS severity_matches FROM joined""",
    "canonical_hashes": f"""{WITH} SELECT 'BMC-' || finding_id AS case_id, {_H.format(_UTF8['whole'])} AS case_hash, {_H.format(_UTF8['example'])} AS example_hash, {_H.format(_ASCII['input'])} AS input_hash, {_H.format(_ASCII['record'])} AS record_hash FROM findings f""",
    # Words and what lies between them alternate: a name is two words with one space between.
    "known_names": f"{NAMES_SQL}, {PAIRS_SQL.format('SELECT doc_id, text AS t FROM documents')} SELECT doc_id, name, count(*) AS n FROM pairs JOIN names ON pair = lower(name) GROUP BY 1, 2",
}


# ---------------------------------------------------------------- look-ups


def _looked_up(s, d):
    """Orders of the customers of one nation, from a keyed table of all orders."""
    root = s.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    path = f"{root.rstrip('/')}/keyed-{uuid.uuid4().hex}"
    lookup.write_keyed(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, "o_custkey")
    return lookup.look_up(s, path, "o_custkey", table(s, d, "customer").where("c_nationkey = 7").select(c("c_custkey").alias("o_custkey")))


QUERIES["keyed_lookup"] = _looked_up
ORACLE_SQL["keyed_lookup"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)"
