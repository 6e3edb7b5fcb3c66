"""Knowledge-base retrieval: metadata filters, exact vector top-k, hybrid merge, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .validation import ENTRY_DOMAINS

c = F.col

# The entries of the catalogue: identifier, category, severity, targets they apply to.
CATALOGUE = [
    ("KB-CLASS-001", "classification_criteria", "critical", ["all"]),
    ("KB-CLASS-002", "classification_criteria", "critical", ["all"]),
    ("KB-CLASS-003", "classification_criteria", "info", ["all"]),
    ("KB-CLASS-004", "classification_criteria", "critical", ["all"]),
    ("KB-CLASS-005", "classification_criteria", "critical", ["all"]),
    ("KB-CLASS-006", "classification_criteria", "warning", ["all"]),
    ("KB-QA-001", "writing_guidelines", "critical", ["all"]),
    ("KB-QA-002", "writing_guidelines", "critical", ["all"]),
    ("KB-QA-003", "writing_guidelines", "warning", ["all"]),
    ("KB-QA-004", "writing_guidelines", "warning", ["all"]),
    ("KB-QA-005", "writing_guidelines", "warning", ["all"]),
    ("KB-QA-006", "writing_guidelines", "info", ["all"]),
    ("KB-CONS-001", "consistency_rules", "warning", ["all"]),
    ("KB-CONS-002", "consistency_rules", "critical", ["all"]),
    ("KB-CONS-003", "consistency_rules", "warning", ["all"]),
    ("KB-CONS-004", "consistency_rules", "warning", ["all"]),
    ("KB-ESC-001", "escalation_rules", "critical", ["all"]),
    ("KB-ESC-002", "escalation_rules", "critical", ["all"]),
    ("KB-ESC-003", "escalation_rules", "critical", ["all"]),
    ("KB-ESC-004", "escalation_rules", "warning", ["all"]),
    ("KB-ESC-005", "escalation_rules", "warning", ["all"]),
    ("KB-ESC-006", "escalation_rules", "critical", ["all"]),
    ("KB-EVID-001", "evidence_standards", "info", ["all"]),
    ("KB-EVID-002", "evidence_standards", "critical", ["all"]),
    ("KB-EVID-003", "evidence_standards", "critical", ["all"]),
    ("KB-EVID-004", "evidence_standards", "critical", ["all"]),
    ("KB-EVID-005", "evidence_standards", "warning", ["all"]),
    ("KB-EVID-006", "evidence_standards", "critical", ["all"]),
    ("KB-GOV-001", "governance_rules", "critical", ["all"]),
    ("KB-GOV-002", "governance_rules", "critical", ["all"]),
    ("KB-GOV-003", "governance_rules", "critical", ["all"]),
    ("KB-GOV-004", "governance_rules", "critical", ["all"]),
    ("KB-REC-001", "remediation_guidance", "warning", ["all"]),
    ("KB-REC-002", "remediation_guidance", "warning", ["all"]),
    ("KB-REC-003", "remediation_guidance", "warning", ["all"]),
    ("KB-REC-004", "remediation_guidance", "critical", ["all"]),
    ("KB-REC-005", "remediation_guidance", "warning", ["web_application", "api"]),
    ("KB-REC-006", "remediation_guidance", "warning", ["android_application", "ios_application"]),
    ("KB-REC-TPL-001", "remediation_guidance", "info", ["all"]),
    ("KB-REC-TPL-002", "remediation_guidance", "info", ["all"]),
    ("KB-REC-TPL-003", "remediation_guidance", "info", ["android_application", "ios_application", "web_application"]),
    ("KB-REC-TPL-004", "remediation_guidance", "info", ["all"]),
    ("KB-REC-TPL-005", "remediation_guidance", "info", ["web_application", "api"]),
    ("KB-REC-TPL-006", "remediation_guidance", "info", ["all"]),
    ("KB-STYLE-001", "writing_guidelines", "warning", ["all"]),
    ("KB-STYLE-002", "writing_guidelines", "warning", ["all"]),
    ("KB-STYLE-003", "writing_guidelines", "info", ["all"]),
    ("KB-STYLE-004", "writing_guidelines", "warning", ["all"]),
    ("KB-STYLE-005", "writing_guidelines", "info", ["all"]),
    ("KB-STYLE-006", "writing_guidelines", "info", ["all"]),
    ("KB-STYLE-007", "writing_guidelines", "warning", ["all"]),
    ("KB-SEV-001", "severity_guidance", "critical", ["all"]),
    ("KB-SEV-002", "severity_guidance", "critical", ["all"]),
    ("KB-SEV-003", "severity_guidance", "warning", ["all"]),
    ("KB-SEV-004", "severity_guidance", "warning", ["all"]),
    ("KB-SEV-005", "severity_guidance", "info", ["all"]),
    ("KB-SEV-006", "severity_guidance", "critical", ["all"]),
    ("KB-SEV-007", "severity_guidance", "warning", ["all"]),
    ("KB-VAL-001", "validation_requirements", "critical", ["all"]),
    ("KB-VAL-002", "validation_requirements", "warning", ["all"]),
    ("KB-VAL-003", "validation_requirements", "warning", ["all"]),
    ("KB-VAL-004", "validation_requirements", "critical", ["all"]),
    ("KB-VAL-005", "validation_requirements", "info", ["all"]),
    ("KB-VAL-006", "validation_requirements", "critical", ["all"]),
    ("KB-WRITE-001", "writing_guidelines", "warning", ["all"]),
    ("KB-WRITE-002", "writing_guidelines", "warning", ["web_application", "api"]),
    ("KB-WRITE-003", "writing_guidelines", "warning", ["all"]),
    ("KB-WRITE-004", "writing_guidelines", "warning", ["all"]),
    ("KB-SCH-001", "taxonomy_definitions", "critical", ["all"]),
    ("KB-SCH-002", "taxonomy_definitions", "critical", ["all"]),
    ("KB-SCH-003", "taxonomy_definitions", "info", ["all"]),
    ("KB-SCH-004", "taxonomy_definitions", "info", ["all"]),
    ("KB-SOP-ESC-001", "sop", "critical", ["all"]),
    ("KB-SOP-ESC-002", "sop", "warning", ["all"]),
    ("KB-SOP-ESC-003", "sop", "info", ["all"]),
    ("KB-SOP-METH-001", "sop", "warning", ["all"]),
    ("KB-SOP-METH-002", "sop", "info", ["all"]),
    ("KB-SOP-METH-003", "sop", "warning", ["all"]),
    ("KB-SOP-METH-004", "sop", "warning", ["web_application", "api"]),
    ("KB-SOP-METH-005", "sop", "critical", ["all"]),
    ("KB-SOP-METH-006", "sop", "info", ["all"]),
    ("KB-SOP-METH-007", "sop", "info", ["all"]),
    ("KB-SOP-METH-008", "sop", "warning", ["all"]),
    ("KB-SOP-REV-001", "sop", "info", ["all"]),
    ("KB-SOP-REV-002", "sop", "critical", ["all"]),
    ("KB-SOP-REV-003", "sop", "critical", ["all"]),
    ("KB-SOP-REV-004", "sop", "info", ["all"]),
    ("KB-SOP-REV-005", "sop", "info", ["all"]),
    ("KB-SOP-REV-009", "sop", "warning", ["all"]),
    ("KB-SOP-REV-010", "sop", "warning", ["all"]),
    ("KB-SOP-REV-011", "sop", "info", ["all"]),
]
GOLD_QUERIES = [
    ("Q001", ["SEV", "CVSS", "CONS"], "all", None, ["KB-SEV-001", "KB-CONS-001"], ["KB-SEV-001", "KB-SEV-006", "KB-SEV-007", "KB-CONS-001", "KB-VAL-002"]),
    ("Q002", ["EVID", "CLASS"], "all", None, ["KB-EVID-004", "KB-CLASS-004"], ["KB-EVID-001", "KB-EVID-004", "KB-CLASS-002", "KB-CLASS-004", "KB-VAL-001"]),
    ("Q003", ["REC"], "android_application", None, ["KB-REC-TPL-001", "KB-REC-TPL-006"], ["KB-REC-TPL-001", "KB-REC-TPL-004", "KB-REC-TPL-006", "KB-REC-005", "KB-REC-006"]),
    ("Q004", ["REC", "SEV"], "all", None, ["KB-REC-TPL-002"], ["KB-REC-TPL-002", "KB-SEV-003", "KB-CONS-001", "KB-REC-001", "KB-REC-002"]),
    ("Q005", None, "all", ["writing_guidelines"], ["KB-STYLE-001", "KB-STYLE-004"], ["KB-STYLE-001", "KB-STYLE-002", "KB-STYLE-003", "KB-STYLE-004", "KB-STYLE-005"]),
    ("Q006", None, "all", ["writing_guidelines", "classification_criteria"], ["KB-QA-003", "KB-CLASS-002"], ["KB-QA-003", "KB-CLASS-002", "KB-QA-001", "KB-QA-002", "KB-VAL-001"]),
    ("Q007", None, "all", ["writing_guidelines"], ["KB-QA-005"], ["KB-QA-005", "KB-QA-002", "KB-QA-003", "KB-STYLE-003"]),
    ("Q008", None, "all", ["sop"], ["KB-SOP-METH-001", "KB-SOP-METH-003"], ["KB-SOP-METH-001", "KB-SOP-METH-002", "KB-SOP-METH-003", "KB-SOP-METH-004", "KB-SOP-METH-005"]),
    ("Q009", ["CONF", "EVID", "SEV"], "all", None, ["KB-ESC-001", "KB-SEV-006"], ["KB-ESC-001", "KB-ESC-002", "KB-ESC-004", "KB-SEV-006", "KB-EVID-002"]),
    ("Q010", ["COMP", "CVSS", "CWE"], "all", None, ["KB-VAL-001", "KB-VAL-002", "KB-VAL-003"], ["KB-VAL-001", "KB-VAL-002", "KB-VAL-003", "KB-VAL-004", "KB-VAL-005", "KB-VAL-006"]),
]
RANK = {"critical": 3, "warning": 2, "info": 1}


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "kb_id string, category string, severity string, applicable_to array<string>")


def severity_rank(column: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), column)


#: Rows up to which one side of a comparison of all queries with all rows is broadcast.
BROADCAST_QUERIES = 10_000


def met(rows: DataFrame, queries: DataFrame, match: Column) -> DataFrame:
    """Every pair of a row and a query that meets ``match``, for query sets of any size.

    Up to ``BROADCAST_QUERIES`` queries are one broadcast. More are dealt into blocks of about that many, and each block meets each
    part of the rows in a task of its own, so no task holds all queries.
    """
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        return rows.join(F.broadcast(queries), match)
    blocks, parts = -(-n // BROADCAST_QUERIES), max(1, -(-rows.count() // BROADCAST_QUERIES))
    q = queries.withColumns({"q_block": F.pmod(F.xxhash64(*queries.columns[:1]), F.lit(blocks)), "q_part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    v = rows.withColumns({"r_part": F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(parts)).cast("int"), "r_block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    return v.join(q, (c("q_block") == c("r_block")) & (c("q_part") == c("r_part"))).where(match).drop("q_block", "q_part", "r_block", "r_part")


#: Rows that a task gathers before it cuts them, and rows beyond which it lets go of what it has kept.
GATHERED, KEPT = 50_000, 500_000


def first_within_tasks(rows: DataFrame, limit: int, group: str, falling: str, rising: str) -> DataFrame:
    """``rows`` less those that ``limit`` others of their ``group`` precede within a task: ``falling`` downwards, nulls last, then ``rising`` upwards, nulls first.

    A cut ahead of ranking: the first ``limit`` of every group are all still there, and what a task holds and passes on to be sorted is bounded by
    groups and limit, not by its rows. Where that is more than ``KEPT`` rows the task passes them on and begins anew.
    """

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def first(held: pa.Table) -> pa.Table:
            codes = pc.dictionary_encode(held[group], null_encoding="encode").combine_chunks()
            keys = pa.table({"g": (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices, "f": held[falling], "n": pc.is_valid(held[rising]).cast("int8"), "r": held[rising]})
            at = pc.sort_indices(keys, sort_keys=[("g", "ascending"), ("f", "descending"), ("n", "ascending"), ("r", "ascending")]).to_numpy()
            groups = keys["g"].to_numpy()[at]
            begins = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            place = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
            return held.take(pa.array(at[place < limit])).combine_chunks()

        kept, waiting, n = None, [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= max(GATHERED, kept.num_rows if kept is not None else 0):
                kept = first(pa.concat_tables([*([kept] if kept is not None else []), pa.Table.from_batches(waiting)]))
                waiting, n = [], 0
                if kept.num_rows > KEPT:
                    yield from kept.to_batches(max_chunksize=10_000)
                    kept = None
        if n or kept is not None:
            last = [*([kept] if kept is not None else []), *([pa.Table.from_batches(waiting)] if n else [])]
            yield from first(pa.concat_tables(last)).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, rows.schema)


#: Columns of an entry that a query may ask to be equal.
ATTRIBUTES = ["document_type", "section", "vulnerability_type", "source_id"]


def retrieve(kb: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, kb_id, rank) for ``queries(query_id, taxonomy_codes, domain, categories, min_severity)``, and optionally ``tags`` and ``ATTRIBUTES``.

    Filters are conjunctive; absent ones, and codes of which none maps, do not filter. Any shared tag will do. Ordered by
    severity, then id.
    """
    mapped = F.expr("filter(transform(taxonomy_codes, x -> try_element_at(m, x)), x -> x is not null)")
    q = queries.withColumn("m", F.create_map(*[F.lit(x) for kv in V.CODE_TO_KB.items() for x in kv])).withColumn("wanted", mapped).drop("m")
    optional = [x for x in ["tags", *ATTRIBUTES] if x in queries.columns and x in kb.columns]
    q = q.withColumnsRenamed({x: f"q_{x}" for x in optional})
    match = (
        (F.coalesce(F.size("wanted"), F.lit(0)).isin(0, -1) | F.array_contains("wanted", c("category")))
        & (c("domain").isNull() | (c("domain") == "all") | F.array_contains("applicable_to", "all") | F.expr("array_contains(applicable_to, domain)"))
        & (c("categories").isNull() | F.expr("array_contains(categories, category)"))
        & (c("min_severity").isNull() | (severity_rank(c("severity")) >= severity_rank(c("min_severity"))))
    )
    for name in optional:
        match = match & (c(f"q_{name}").isNull() | (F.arrays_overlap("tags", "q_tags") if name == "tags" else c(name) == c(f"q_{name}")))
    hits = met(kb, q, match).select("query_id", "kb_id", "category", "severity", severity_rank(c("severity")).alias("weight"))
    if limit:
        hits = first_within_tasks(hits, limit, "query_id", "weight", "kb_id")
    w = Window.partitionBy("query_id").orderBy(c("weight").desc(), "kb_id")
    out = hits.select("query_id", "kb_id", "category", "severity", F.row_number().over(w).alias("rank"))
    return out.where(c("rank") <= limit) if limit else out


def by_id(kb: DataFrame, kb_id: str) -> DataFrame:
    """The entry with this id: one row or none."""
    return kb.where(c("kb_id") == kb_id).limit(1)


def of_category(kb: DataFrame, category: str) -> DataFrame:
    """Entries of one category, such as escalation_rules or consistency_rules, by severity and id. A category that no entry can have is an error."""
    if category not in ENTRY_DOMAINS["category"]:
        raise ValueError(f"no such category as {category!r}; there are {', '.join(ENTRY_DOMAINS['category'])}")
    return kb.where(c("category") == category).orderBy(severity_rank(c("severity")).desc(), "kb_id")


def result_summary(retrieved: DataFrame) -> DataFrame:
    """(query_id, total, categories): how many entries each query found, and their distinct categories in order."""
    return retrieved.groupBy("query_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_set("category")).alias("categories"))


def _labelled(label: str, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(label), text))


def rule_text(indent: str = "  ", description: str = "Description: ") -> Column:
    """An entry as lines: id and title, then description, conditions and action where there are any."""
    lines = [
        F.concat(F.lit("["), c("kb_id"), F.lit("] "), F.coalesce("title", F.lit(""))), _labelled(indent + description, c("description")),
        _labelled(indent + "Conditions: ", F.array_join("conditions", "; ")), _labelled(indent + "Action: ", c("action")),
    ]
    return F.concat_ws("\n", *lines)


def chunk_text() -> Column:
    """The text of an entry that is embedded: one entry is one chunk."""
    return rule_text(indent="", description="")


def embedded(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], id_col: str, text_col: str, batch: int = 32) -> DataFrame:
    """(id, embedding): texts in batches through a model loaded once per task."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator):
        import pandas as pd

        model = load()
        for frame in batches:
            texts, out = frame[text_col].fillna("").tolist(), []
            for start in range(0, len(texts), batch):
                out += model(texts[start : start + batch])
            yield pd.DataFrame({"id": frame[id_col], "embedding": out})

    return rows.select(id_col, text_col).mapInPandas(run, f"id {kind}, embedding array<double>")


def stub_embedder() -> Callable[[list[str]], list[list[float]]]:
    """Deterministic stand-in for an embedding model: a text's length and its spaces."""
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


#: Entries that one task of a look-up holds.
ENTRIES_A_TASK = 50_000


def _with_entries(retrieved: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits with what their entries tell. Both are dealt by id into as many parts as the entries need, and the catalogue, which grows, is never broadcast."""
    parts = max(1, -(-entries.count() // ENTRIES_A_TASK))
    return retrieved.select("query_id", "kb_id", "rank").repartition(parts, "kb_id").join(entries.repartition(parts, "kb_id").hint("merge"), "kb_id")


def rules_text(retrieved: DataFrame, kb: DataFrame) -> DataFrame:
    """(query_id, text): the retrieved rules of each query in order, for a prompt; a query's hits are bounded by the catalogue or a limit."""
    lines = _with_entries(retrieved, kb.select("kb_id", rule_text().alias("text")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(x.text, F.lit("\n")))
    return lines.groupBy("query_id").agg(F.array_join(ordered, "\n").alias("text"))


def rules_summary(retrieved: DataFrame, kb: DataFrame) -> DataFrame:
    return _with_entries(retrieved, kb.select("kb_id", "title", "action", "severity"))


def write_index(kb: DataFrame, embeddings: DataFrame, path: str) -> None:
    """The vector index: one row per chunk with its unit vector, partitioned by category."""
    rows = kb.select("kb_id", "category", chunk_text().alias("text")).join(embeddings.select("kb_id", normalized(c("embedding")).alias("embedding")), "kb_id")
    rows.write.mode("overwrite").partitionBy("category").parquet(path)


def method_summary(metrics: DataFrame, *groups: str) -> DataFrame:
    """Means of recall and precision, and the share of queries with full recall, by method and whatever else is given."""
    return metrics.groupBy(*groups).agg(
        F.count("*").alias("queries"), F.round(F.avg("recall"), 4).alias("mean_recall"), F.round(F.avg("precision"), 4).alias("mean_precision"), F.round(F.count_if(c("recall") == 1.0) / F.count("*"), 4).alias("pass_rate")
    )


def gold_queries(spark: SparkSession) -> DataFrame:
    rows = [(q, codes, domain, cats, None, exp, rel) for q, codes, domain, cats, exp, rel in GOLD_QUERIES]
    return spark.createDataFrame(rows, "query_id string, taxonomy_codes array<string>, domain string, categories array<string>, min_severity string, expected array<string>, relevant array<string>")


def retrieval_metrics(retrieved: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Recall of the expected ids (1 if none is expected) and precision of the first k."""
    lists = retrieved.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "kb_id"))), lambda x: x["kb_id"]).alias("ids"))
    joined = gold.join(lists, "query_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    top = F.slice("ids", 1, k)
    recall = F.when(F.size("expected") == 0, 1.0).otherwise(F.size(F.array_intersect("ids", "expected")) / F.size("expected"))
    return joined.select("query_id", F.size("ids").cast("long").alias("retrieved"), recall.alias("recall"), F.coalesce(F.try_divide(F.size(F.array_intersect(top, c("relevant"))), F.size(top)), F.lit(0.0)).alias("precision"))


def normalized(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), norm))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


#: Queries and rows of one cell of ``top_k``, and queries whose scores are held at a time.
CELL, TILE = 10_000, 32


def _by_length(vectors) -> dict:
    """Length to (places, matrix of doubles) of an Arrow column of vectors; null ones and those that hold a null are left out."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pa.concat_arrays(vectors.chunks)
    lengths = np.array(pc.fill_null(pc.list_value_length(column), -1))
    flat = column.flatten()
    if flat.null_count:
        lengths[pc.list_parent_indices(column).filter(flat.is_null()).to_numpy()] = -1
    places = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths[lengths >= 0]).tolist()}
    return {n: (at, pc.cast(column.take(pa.array(at)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), n)) for n, at in places.items()}


def _cell_top(k: int) -> Callable:
    """Of one cell of rows and queries, each query's first k rows by score, then id, as Spark orders them: NaN first, no score last.

    A score adds products in the order of the components, as ``inner_product`` does, so both are the same double.
    """

    def run(rows, queries):
        import numpy as np
        import pyarrow as pa

        n, found, scores, known = rows.num_rows, [], [], []
        if n and queries.num_rows:
            order = np.unique(np.concatenate([rows["id"].to_numpy(), queries["query_id"].to_numpy()]), return_inverse=True)[1]
            ids, own = order[:n], order[n:]
            told = {size: (at, np.ascontiguousarray(x.T)) for size, (at, x) in _by_length(rows["r_vector"]).items()}
            asked = _by_length(queries["q_vector"])
            for start in range(0, queries.num_rows, TILE):
                m = min(TILE, queries.num_rows - start)
                score, is_known = np.zeros((m, n)), np.zeros((m, n), dtype=bool)
                for size in told.keys() & asked.keys():
                    (at, x), (q_at, q) = told[size], asked[size]
                    inside = (q_at >= start) & (q_at < start + m)
                    total = np.zeros((int(inside.sum()), len(at)))
                    product = np.empty_like(total)
                    with np.errstate(all="ignore"):
                        for d in range(size):
                            total += np.multiply(q[inside, d, None], x[d], out=product)
                    cell = np.ix_(q_at[inside] - start, at)
                    score[cell], is_known[cell] = total, True
                height = np.where(is_known, np.where(np.isnan(score), np.inf, score), -np.inf)
                for i in range(m):
                    others = np.flatnonzero(ids != own[start + i])
                    if len(others) > k:
                        h = height[i, others]
                        others = others[h >= np.partition(h, len(h) - k)[len(h) - k]]
                    s, has = score[i, others], is_known[i, others]
                    best = others[np.lexsort((ids[others], -np.where(has & ~np.isnan(s), s, 0.0), ~np.isnan(s), ~has))[:k]]
                    found.append(np.column_stack([np.full(len(best), start + i), best]))
                    scores.append(score[i, best])
                    known.append(is_known[i, best])
        pairs = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
        values = pa.array(np.concatenate(scores), mask=~np.concatenate(known)) if found else pa.array([], pa.float64())
        return pa.table({"query_id": queries["query_id"].take(pa.array(pairs[:, 0])), "id": rows["id"].take(pa.array(pairs[:, 1])), "score": values})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): exact inner-product top-k of a query set of any size against all rows.

    Rows and queries are dealt into parts of about ``CELL``, and every part of the one meets every part of the other in a task of its own, which holds
    the scores of ``TILE`` queries and passes on k rows of each query; these alone are ranked.
    """
    q = queries.select(c(id_col).alias("query_id"), c(vector_col).alias("q_vector")).where("query_id is not null")
    v = vectors.select(c(id_col).alias("id"), c(vector_col).alias("r_vector")).where("id is not null")
    blocks, parts = (max(1, -(-x.count() // CELL)) for x in (q, v))
    dealt = lambda x, key, own, n, other, m: x.withColumns({own: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    left, right = dealt(v, "id", "part", parts, "block", blocks), dealt(q, "query_id", "block", blocks, "part", parts)
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, score double"
    best = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_cell_top(k), kinds)
    w = Window.partitionBy("query_id").orderBy(c("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def hybrid(semantic: DataFrame, metadata: DataFrame, limit: int = 20) -> DataFrame:
    """Semantic hits first, then metadata hits not seen yet; ranks start anew. Both: (query_id, id, rank)."""
    both = semantic.select("query_id", "id", "rank", F.lit(0).alias("source")).unionAll(metadata.where(c("rank") <= limit).select("query_id", "id", "rank", F.lit(1).alias("source")))
    first = both.groupBy("query_id", "id").agg(F.min(F.struct("source", "rank")).alias("best"))
    w = Window.partitionBy("query_id").orderBy("best.source", "best.rank", "id")
    return first.select("query_id", "id", c("best.source").alias("source"), F.row_number().over(w).alias("rank"))
