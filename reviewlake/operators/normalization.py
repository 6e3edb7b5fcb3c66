"""From document blocks to normalized findings: segmentation contract, metadata and section parsing, record assembly.

``blocks`` has document_id, block_number, block_type, paragraph_number, table_number, style, text and rows (as
``sources.read_docx`` gives them); ``registry`` has document_id, ordinal and title of the findings that each document holds.
Where the contract is broken nothing is guessed: each fault is a row of a fault table, and the document or
finding that has it is left out of what follows. Windows and joins are keyed by document, then by finding, so documents
are independent and one shuffle by document serves segmentation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import dictionary
from .review import settled
from .segmentation import FIELD_ALIASES, SECTION_ALIASES, field_of, marker_order_faults, section_of

c = F.col
KEYS = ["document_id", "finding_id"]
END_MARKER = "conclusion & recommendations"
#: Registered titles that one task of segmentation holds the documents of.
TITLES_A_TASK = 10_000
#: What a source without its own governance record gets.
GOVERNANCE = {
    "source_type": "company_provided", "data_classification": "confidential", "redaction_status": "provider_preprocessed", "usage_approved": True,
    "usage_scope": "internal", "training_environment": "google_colab", "dataset_version": "0.1",
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- segmentation


def title_matches(blocks: DataFrame, registry: DataFrame) -> DataFrame:
    """Each registered title with its paragraphs: case does not count, all else does. Titles without one have a null block."""
    paragraphs = blocks.where("block_type = 'paragraph'").select("document_id", F.lower("text").alias("folded"), "block_number", "paragraph_number", "style")
    return registry.withColumn("folded", F.lower("title")).join(paragraphs, ["document_id", "folded"], "left").drop("folded")


def segmentation_faults(blocks: DataFrame, registry: DataFrame, end_marker: str = END_MARKER) -> DataFrame:
    """(document_id, fault, detail): titles not found exactly once, titles out of order, no end marker after the last title."""
    found = title_matches(blocks, registry)
    counts = found.groupBy("document_id", F.lower("title")).agg(F.min("title").alias("title"), F.count("block_number").alias("n"))
    wrong = counts.where("n <> 1").select("document_id", F.lit("title_count").alias("fault"), F.concat_ws(": ", "title", c("n").cast("string")).alias("detail"))
    order = marker_order_faults(found.where("block_number is not null"), "document_id", "ordinal", "block_number")
    order = order.join(wrong.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.lit("title_order").alias("fault"), c("title").alias("detail"))
    last = found.groupBy("document_id").agg(F.max("block_number").alias("last"))
    ends = blocks.where((c("block_type") == "paragraph") & (F.lower("text") == end_marker)).select(c("document_id").alias("e_document"), c("block_number").alias("e_block"))
    open_end = last.where("last is not null").join(ends, (c("document_id") == c("e_document")) & (c("e_block") > c("last")), "left_anti")
    return _union([wrong, order, open_end.select("document_id", F.lit("end_marker").alias("fault"), F.lit(end_marker).alias("detail"))])


def raw_findings(blocks: DataFrame, registry: DataFrame, end_marker: str = END_MARKER) -> DataFrame:
    """Blocks of sound documents with the finding that owns them: from its title to the next one's, or to the end marker.

    One pass over each document in block order: its registered titles come as one array, and it is sound (as ``segmentation_faults`` says,
    which tells what is wrong) if the paragraphs that are titles are exactly these in their order and an end marker follows them.
    Documents are dealt to as many tasks as the registry's titles need (``TITLES_A_TASK``), so that no task grows with the input; titles are
    looked up in a hash table before the one sort of blocks, which all windows share.
    """
    parts = max(registry.sparkSession.sparkContext.defaultParallelism, -(-registry.count() // TITLES_A_TASK))
    entry = F.struct("ordinal", "title", F.lower("title").alias("folded"))
    titles = registry.repartition(parts, "document_id").groupBy(c("document_id").alias("t_document")).agg(F.sort_array(F.collect_list(entry)).alias("titles"))
    in_order = Window.partitionBy("document_id").orderBy("block_number")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    document = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paragraph = c("block_type") == "paragraph"
    held = blocks.repartition(parts, "document_id").join(titles.hint("shuffle_hash"), c("document_id") == c("t_document")).drop("t_document")
    hits = F.filter(F.transform("titles", lambda t, i: F.when(t.folded == F.lower("text"), F.struct((i + 1).alias("rank"), t.ordinal.alias("ordinal"), t.title.alias("title")))), lambda x: x.isNotNull())
    held = held.withColumns({"hits": F.when(paragraph, hits).otherwise(F.array().cast("array<struct<rank:int,ordinal:int,title:string>>")), "n_titles": F.size("titles")}).drop("titles")
    mark = F.struct(F.format_string("FND-%06d", c("hits")[0]["ordinal"]).alias("finding_id"), c("hits")[0]["title"].alias("title"), c("block_number").alias("start"), c("paragraph_number").alias("title_paragraph"), c("style").alias("title_style"))
    held = held.withColumns({"n_hits": F.sum(F.size("hits")).over(so_far), "mark": F.when(F.size("hits") > 0, mark), "last_title": F.max(F.when(F.size("hits") > 0, c("block_number"))).over(document)})
    is_end = F.coalesce(paragraph & (F.lower("text") == end_marker) & (c("block_number") > c("last_title")), F.lit(False))
    out_of_turn = (F.size("hits") > 1) | ((F.size("hits") == 1) & (F.get("hits", F.lit(0))["rank"] != c("n_hits")))
    held = held.withColumns({
        "sound": F.min(F.coalesce(~out_of_turn, F.lit(True))).over(document) & (F.max("n_hits").over(document) == c("n_titles")) & F.max(is_end).over(document),
        "owner": F.last("mark", ignorenulls=True).over(so_far), "ended": F.max(is_end).over(so_far),
    })
    owned = held.where("sound and owner is not null and not ended")
    return owned.select("*", "owner.finding_id", "owner.title", "owner.start", "owner.title_paragraph", "owner.title_style").drop("n_titles", "hits", "n_hits", "mark", "last_title", "sound", "owner", "ended")


def extraction_stats(raw: DataFrame) -> DataFrame:
    """One row per finding: first and last block, blocks, blocks that hold something, tables, what tells its source."""
    full = (c("block_type") == "table") | (F.coalesce(c("text"), F.lit("")) != "")
    return raw.groupBy(*KEYS).agg(
        F.first("title").alias("title"), F.min("block_number").alias("start_block_number"), F.max("block_number").alias("end_block_number"), F.count("*").alias("block_count"),
        F.count_if(full).alias("non_empty_block_count"), F.count_if(c("block_type") == "table").alias("tables"), F.first("title_paragraph").alias("title_paragraph"),
    )


def extraction_faults(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """(document_id, finding_id, fault): findings without a table, registered ones without blocks, ids that stand twice in the registry."""
    expected = registry.select("document_id", F.format_string("FND-%06d", "ordinal").alias("finding_id"))
    stats = extraction_stats(raw)
    no_table = stats.where("tables = 0").select(*KEYS, F.lit("no_table").alias("fault"))
    lost = expected.join(stats.select(*KEYS), KEYS, "left_anti").select(*KEYS, F.lit("not_extracted").alias("fault"))
    twice = expected.groupBy(*KEYS).count().where("count > 1").select(*KEYS, F.lit("duplicate_id").alias("fault"))
    return _union([no_table, lost, twice])


def region(blocks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Blocks from the first that meets ``start`` to the first at or after it that meets ``end``, both included; to the last block if none does."""
    w = Window.partitionBy("document_id")
    begun = blocks.withColumn("r_start", F.min(F.when(start, c("block_number"))).over(w)).where(c("block_number") >= c("r_start"))
    return begun.withColumn("r_end", F.min(F.when(end, c("block_number"))).over(w)).where(c("r_end").isNull() | (c("block_number") <= c("r_end"))).drop("r_start", "r_end")


def tables_with(blocks: DataFrame, words: DataFrame, compact: Column) -> DataFrame:
    """(document_id, table_number, word) of tables whose text holds a word, case aside, inside other words too; ``words(word)`` of any number."""
    tables = blocks.where("block_type = 'table'").select(F.struct("document_id", "table_number").alias("place"), compact.alias("text"))
    return dictionary.matches(tables, "place", "text", words, "word", whole_words=False).select("place.*", c("name").alias("word"))


# ---------------------------------------------------------------- one row a finding


def gathered(raw: DataFrame) -> DataFrame:
    """One row per finding, in one aggregate: title, its places, number of tables and the first one, paragraphs in order with their section label.

    ``fields`` are the rows of the metadata table (row_number, label, value, cells, field) if there is one table, else null; ``labels`` are the
    paragraphs that label a section; ``first`` is the first paragraph with a text. A finding's blocks are held in one row, as its record holds its texts.
    """
    table, label = c("block_type") == "table", F.when(c("text") != "", section_of(c("text")))
    df = raw.groupBy(*KEYS).agg(
        F.first("title").alias("title"), F.min("block_number").alias("start_block_number"), F.max("block_number").alias("end_block_number"), F.first("title_paragraph").alias("title_paragraph"),
        F.count_if(table).alias("tables"), F.min_by(F.struct("table_number", "rows"), F.when(table, c("block_number"))).alias("table"),
        F.sort_array(F.collect_list(F.when(c("block_type") == "paragraph", F.struct("block_number", "text", label.alias("label"))))).alias("paragraphs"),
    )
    cell = lambda r, i: F.get(r.cells, F.lit(i))
    rows = F.transform("table.rows", lambda r: F.struct(r.row_number.alias("row_number"), cell(r, 0).alias("label"), cell(r, 1).alias("value"), F.size(r.cells).alias("cells"), F.when(F.size(r.cells) >= 2, field_of(cell(r, 0))).alias("field")))
    return settled(df.withColumns({
        "fields": F.when(c("tables") == 1, rows), "labels": F.filter("paragraphs", lambda p: p.label.isNotNull()), "first": F.get(F.filter("paragraphs", lambda p: p.text != ""), F.lit(0)),
    }))


def _explained(df: DataFrame, faults: Column) -> DataFrame:
    return df.select(*KEYS, F.explode(faults).alias("x")).select(*KEYS, "x.fault", "x.detail")


def _fault(name: str, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("fault"), detail.alias("detail"))


def _repeated(values: Column) -> Column:
    """The values that stand more than once, each once."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.size(F.filter(values, lambda y: y == x)) > 1)))


# ---------------------------------------------------------------- metadata


def metadata_faults(raw: DataFrame, required: list[str] | None = None) -> DataFrame:
    """(document_id, finding_id, fault, detail): number of tables, short rows, unknown labels, repeated and missing fields."""
    fields = F.coalesce("fields", F.array().cast("array<struct<row_number:int,label:string,value:string,cells:int,field:string>>"))
    names = F.transform(fields, lambda r: r.field)
    lacking = F.array_join(F.array_sort(F.array_except(T.strings(sorted(required or FIELD_ALIASES)), names)), ",")
    return _explained(gathered(raw), F.concat(
        F.array_compact(F.array(F.when(c("tables") != 1, _fault("table_count", c("tables").cast("string"))))),
        F.transform(F.filter(fields, lambda r: r.cells < 2), lambda r: _fault("short_row", r.row_number.cast("string"))),
        F.transform(F.filter(fields, lambda r: (r.cells >= 2) & r.field.isNull()), lambda r: _fault("unknown_label", r.label)),
        F.transform(_repeated(names), lambda x: _fault("duplicate_field", x)),
        F.array_compact(F.array(F.when((F.size(fields) > 0) & (lacking != ""), _fault("missing_fields", lacking)))),
    ))


def _sound_metadata() -> Column:
    """Without any of the faults: every row has two cells and a known label, and the labels are the required ones, once each."""
    named = F.transform("fields", lambda r: r.field)
    return F.coalesce(F.forall("fields", lambda r: (r.cells >= 2) & r.field.isNotNull()) & (F.size("fields") == len(FIELD_ALIASES)) & (F.size(F.array_distinct(named)) == len(FIELD_ALIASES)), F.lit(False))


def metadata(raw: DataFrame) -> DataFrame:
    """One row per sound finding: each field's reported value beside what it parses to. Labels and row numbers are kept in ``source_fields``."""
    return parsed_metadata(gathered(raw).where(_sound_metadata()))


def parsed_metadata(findings: DataFrame, *keep: str) -> DataFrame:
    """The same of ``gathered`` rows with sound metadata, beside the columns ``keep``."""
    field = lambda name: F.get(F.transform(F.filter("fields", lambda r: r.field == name), lambda r: F.struct(r.label.alias("label"), r.value.alias("value"), r.row_number.alias("row_number"))), F.lit(0))
    fields = settled(findings.select(*KEYS, c("table.table_number"), *keep, *[field(name).alias(name) for name in sorted(FIELD_ALIASES)]))
    value = lambda name: F.coalesce(c(f"{name}.value"), F.lit(""))
    status, role = T.normalize_whitespace(value("retest_status")), T.normalize_whitespace(value("affected_user_roles"))
    return fields.select(
        *KEYS, *keep, c("table_number").alias("source_table_number"),
        F.struct(value("severity").alias("reported_value"), T.severity(value("severity")).alias("normalized_value")).alias("severity"),
        F.array(T.affected_target(value("affected_targets"))).alias("affected_targets"),
        F.struct(value("cwe").alias("reported_value"), T.cwe_id(value("cwe")).alias("cwe_id"), T.cwe_description(value("cwe")).alias("description")).alias("cwe"),
        F.struct(value("impact").alias("reported_value"), T.field_name(c("impact.label")).contains("potential").alias("is_marked_potential")).alias("impact"),
        F.struct(value("retest_status").alias("reported_value"), F.nullif(status, F.lit("")).alias("normalized_value")).alias("retest_status"),
        F.struct(value("affected_user_roles").alias("reported_value"), F.when(role != "", F.array(role)).otherwise(T.strings([])).alias("normalized_values")).alias("affected_user_roles"),
        T.cvss(value("cvss")).alias("cvss"),
        F.struct(*[c(name) for name in sorted(FIELD_ALIASES)]).alias("source_fields"),
    )


# ---------------------------------------------------------------- sections


def section_faults(raw: DataFrame) -> DataFrame:
    """(document_id, finding_id, fault, detail): no text, a first paragraph that is not the title, sections labelled twice."""
    return _explained(gathered(raw), F.concat(
        F.array_compact(F.array(F.when(c("first").isNull(), _fault("no_paragraphs", F.lit(""))), F.when(c("first.text") != c("title"), _fault("first_paragraph", c("first.text"))))),
        F.transform(_repeated(F.transform("labels", lambda p: p.label)), lambda x: _fault("duplicate_section", x)),
    ))


def _sound_sections() -> Column:
    """Without any of the faults: the first paragraph with text is the title, and no label stands twice."""
    return F.coalesce((c("first.text") == c("title")) & (F.size("labels") == F.size(F.array_distinct(F.transform("labels", lambda p: p.label)))), F.lit(False))


def _section(name: str) -> Column:
    """A section of a sound finding: its label, and the paragraphs with text up to the next label."""
    own = F.get(F.filter("labels", lambda p: p.label == name), F.lit(0))

    def told(label: Column) -> Column:
        following = F.array_min(F.transform(F.filter("labels", lambda p: p.block_number > label.block_number), lambda p: p.block_number))
        content = T.let(following, lambda end: F.filter("paragraphs", lambda p: (p.block_number > label.block_number) & (end.isNull() | (p.block_number < end)) & (p.text != "")))
        return T.let(F.coalesce(content, F.array().cast("array<struct<block_number:int,text:string,label:string>>")), lambda found: _section_record(name, label, found))

    return T.let(own, told)


def _section_record(name: str, label: Column, content: Column) -> Column:
    texts = F.transform(content, lambda p: p.text)
    return F.struct(
        F.lit(name).alias("section_name"), label.text.alias("source_label"), label.block_number.alias("source_label_block"), F.transform(content, lambda p: p.block_number).alias("content_block_numbers"),
        texts.alias("paragraphs"), F.nullif(F.array_join(texts, "\n\n"), F.lit("")).alias("combined_text"), (F.size(content) > 0).alias("content_present"),
    )


def section_records(raw: DataFrame) -> DataFrame:
    """The four fixed sections of each sound finding: label, its block, non-empty paragraphs in order, their text, whether there is any."""
    every = gathered(raw).where(_sound_sections()).select(*KEYS, F.explode(F.array(*[_section(name) for name in SECTION_ALIASES])).alias("x"))
    return every.select(*KEYS, "x.*")


def _unclassified() -> Column:
    """Paragraphs with text between a finding's first paragraph and its first section label."""
    start = F.get("labels", F.lit(0))["block_number"]
    return F.filter(F.slice("paragraphs", 2, F.greatest(F.size("paragraphs"), F.lit(1))), lambda p: (p.text != "") & (start.isNull() | (p.block_number < start)))


def unclassified_paragraphs(raw: DataFrame) -> DataFrame:
    """(document_id, finding_id, block_number, text) between a finding's first paragraph and its first section label."""
    return gathered(raw).select(*KEYS, F.explode(_unclassified()).alias("x")).select(*KEYS, "x.block_number", "x.text")


def section_summary(raw: DataFrame) -> DataFrame:
    """Per sound finding: labels found in order, sections without a label, labelled ones without text, unclassified paragraphs."""
    df = settled(gathered(raw).where(_sound_sections()).select(*KEYS, F.array(*[_section(name) for name in SECTION_ALIASES]).alias("sections"), F.size(_unclassified()).cast("long").alias("unclassified_paragraphs")))
    listed = lambda sections: F.array_join(F.transform(sections, lambda x: x.section_name), ",")
    by_block = F.array_sort(F.filter("sections", lambda x: x.source_label.isNotNull()), lambda a, b: a.source_label_block - b.source_label_block)
    return df.select(
        *KEYS, listed(by_block).alias("labels_found"), listed(F.filter("sections", lambda x: x.source_label.isNull())).alias("missing_labels"),
        listed(F.filter("sections", lambda x: x.source_label.isNotNull() & ~x.content_present)).alias("empty_sections"), "unclassified_paragraphs",
    )


# ---------------------------------------------------------------- records


def affected_targets(targets: Column) -> Column:
    return F.transform(targets, lambda t: F.struct(t.target_type.alias("target_type"), t.normalized_value.alias("value"), F.lit(None).cast("string").alias("description")))


def evidence_items(finding_id: Column, exploitation: Column) -> Column:
    """The text of the exploitation section as one item; it does not say whether that is enough."""
    item = F.struct(
        F.concat(finding_id, F.lit("-EVID-001")).alias("evidence_id"), F.lit("reproduction_steps").alias("evidence_type"),
        F.lit("Exploitation or reproduction information extracted from the source finding.").alias("description"), exploitation["combined_text"].alias("content"), F.lit("full_content").alias("availability"),
    )
    return F.filter(F.array(item), lambda x: exploitation["content_present"])


def references(cwe_id: Column) -> Column:
    return F.filter(F.array(F.struct(F.lit("cwe").alias("reference_type"), cwe_id.alias("value"))), lambda x: x.value.isNotNull())


def retest(status: Column, verification: Column, evidence_type: str) -> Column:
    """Nothing is inferred: with neither a status nor a result, whether a retest applies is unknown."""
    result = F.when(verification["content_present"], verification["combined_text"])
    applicable = F.when(status.isNotNull() | result.isNotNull(), True)
    return F.struct(applicable.alias("applicable"), status.alias("status"), result.alias("verification_result"), F.array().cast(evidence_type).alias("evidence"))


def source_of(stats_title: Column) -> Column:
    number = F.substring_index(c("finding_id"), "-", -1).cast("int").cast("string")
    none = F.lit(None)
    location = F.struct(stats_title.alias("section_title"), none.cast("string").alias("section_number"), number.alias("finding_number"), none.cast("int").alias("page_start"), none.cast("int").alias("page_end"))
    reference = F.format_string("blocks:%d-%d;title_paragraph:%d", "start_block_number", "end_block_number", "title_paragraph")
    return F.struct(c("document_id"), F.lit("unknown").alias("document_type"), location.alias("location"), reference.alias("source_reference"))


def normalized_findings(raw: DataFrame, governance: DataFrame | None = None) -> DataFrame:
    """The 16-field record of every finding that is sound in all three parts, beside its document_id.

    ``governance(document_id, governance)`` gives documents their own governance struct; the rest get ``GOVERNANCE``.
    """
    stats = ["title", "start_block_number", "end_block_number", "title_paragraph"]
    sound = gathered(raw).where(_sound_metadata() & _sound_sections())
    sections = settled(sound.select(*KEYS, *stats, "table", "fields", *[_section(name).alias(name) for name in SECTION_ALIASES]))
    joined = settled(parsed_metadata(sections, *stats, *SECTION_ALIASES))
    default = F.struct(*[F.lit(v).alias(k) for k, v in GOVERNANCE.items()])
    if governance is not None:
        joined = joined.join(governance.select("document_id", c("governance").alias("own_governance")), "document_id", "left")
        default = F.coalesce("own_governance", default)
    items = evidence_items(c("finding_id"), c("exploitation"))
    kind = "array<struct<evidence_id:string,evidence_type:string,description:string,content:string,availability:string>>"
    return joined.select(
        "document_id", F.lit("0.2").alias("schema_version"), "finding_id", "title", c("severity.normalized_value").alias("severity"), affected_targets(c("affected_targets")).alias("affected_targets"),
        c("affected_user_roles.normalized_values").alias("affected_user_roles"), c("cwe.cwe_id").alias("cwe_id"), F.struct("cvss.version", "cvss.score", "cvss.vector").alias("cvss"),
        c("impact.reported_value").alias("impact"), c("observation.combined_text").alias("observation"), items.cast(kind).alias("evidence"), c("recommendation.paragraphs").alias("recommendation"),
        retest(c("retest_status.normalized_value"), c("retest_verification"), kind).alias("retest"), references(c("cwe.cwe_id")).alias("references"), source_of(c("title")).alias("source"), default.alias("governance"),
    )


# ---------------------------------------------------------------- structural gate


def extraction_checks(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """(document_id, finding_id, check): failed structural checks against ``expected(document_id, finding_id, title, table_number)``."""
    filled = (c("block_type") == "paragraph") & (F.coalesce(c("text"), F.lit("")) != "")
    words = F.lower(F.btrim("text"))
    facts = raw.groupBy(*KEYS).agg(
        F.first("title").alias("own_title"), F.min(F.when(filled, F.struct("block_number", "text"))).alias("first"), F.count_if(c("block_type") == "table").alias("tables"),
        F.min(F.when(c("block_type") == "table", c("table_number"))).alias("own_table"), F.count_if(filled & (words == "observation")).alias("observations"), F.count_if(filled & (words == "exploitation")).alias("exploitations"),
        F.count_if(filled & F.rtrim(words, F.lit(":")).isin("recommendation", "recommendations", "remediation")).alias("recommendations"),
        F.count_if(filled & words.startswith("re-test verification result")).alias("retests"),
        (F.max("block_number") - F.min("block_number") + 1).alias("span"), F.count_distinct("block_number").alias("distinct_blocks"), F.count("*").alias("blocks"),
    )
    joined = facts.join(expected.select(*KEYS, c("title").alias("want_title"), c("table_number").alias("want_table")), KEYS)
    checks = {
        "title_match": ~c("own_title").eqNullSafe(c("want_title")),
        "paragraph_content": c("first").isNull(),
        "first_paragraph_title": c("first").isNotNull() & ~c("first.text").eqNullSafe(c("want_title")),
        "metadata_table_count": c("tables") != 1,
        "metadata_table_number": (c("tables") == 1) & ~c("own_table").eqNullSafe(c("want_table")),
        "section_label_observation": c("observations") == 0,
        "section_label_exploitation": c("exploitations") == 0,
        "recommendation_section": c("recommendations") == 0,
        "retest_label_count": c("retests") != 1,
        "continuous_block_range": (c("span") != c("blocks")) | (c("distinct_blocks") != c("blocks")),
    }
    failed = F.array_compact(F.array(*[F.when(wrong, name) for name, wrong in checks.items()]))
    return joined.select(*KEYS, F.explode(failed).alias("check"))


def registry_differences(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """(document_id, ordinal, found, expected): places where the findings, in block order, are not the registered ones in theirs."""
    w = Window.partitionBy("document_id")
    found = extraction_stats(raw).withColumn("ordinal", F.row_number().over(w.orderBy("start_block_number"))).select("document_id", "ordinal", c("finding_id").alias("found"))
    wanted = expected.select("document_id", "ordinal", F.format_string("FND-%06d", "ordinal").alias("expected"))
    return found.join(wanted, ["document_id", "ordinal"], "full").where(~c("found").eqNullSafe(c("expected")))
