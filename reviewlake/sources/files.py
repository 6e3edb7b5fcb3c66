"""File sources and sinks: DOCX blocks, JSON and JSONL, catalogue folders, CSV, Markdown reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import settings

BLOCKS = "block_number int, block_type string, paragraph_number int, table_number int, style string, text string, rows array<struct<row_number:int,cells:array<string>>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def document_blocks(content: bytes):
    """Paragraphs and tables of a DOCX body in order, numbered as a whole and by kind. White space is collapsed."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    def text(node) -> str:
        return " ".join("".join(t.text or "" for t in node.iter(f"{_W}t")).split())

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    paragraphs = tables = 0
    for n, node in enumerate((x for x in body if x.tag in (f"{_W}p", f"{_W}tbl")), 1):
        if node.tag == f"{_W}p":
            paragraphs += 1
            style = node.find(f"{_W}pPr/{_W}pStyle")
            yield n, "paragraph", paragraphs, None, None if style is None else style.get(f"{_W}val"), text(node), None
        else:
            tables += 1
            rows = [(i, [text(cell) for cell in row.findall(f"{_W}tc")]) for i, row in enumerate(node.findall(f"{_W}tr"), 1)]
            yield n, "table", None, tables, None, None, rows


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """One row per block of each DOCX file under ``path``; a file that cannot be read gives one row with its error."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    out += [(name, *block, None) for block in document_blocks(bytes(content))]
                except Exception as e:  # noqa: BLE001  told as a row
                    out.append((name, *[None] * 7, f"{type(e).__name__}: {e}"))
            columns = ["document_id", "block_number", "block_type", "paragraph_number", "table_number", "style", "text", "rows", "error"]
            frame = pd.DataFrame(out, columns=columns)
            for col in ("block_number", "paragraph_number", "table_number"):
                frame[col] = frame[col].astype("Int32")
            frame["rows"] = [r if r is None else [{"row_number": i, "cells": cells} for i, cells in r] for r in frame["rows"]]
            yield frame

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"document_id string, {BLOCKS}, error string")


def styled(blocks: DataFrame, prefix: str) -> DataFrame:
    """Paragraphs whose style begins with a prefix, case aside."""
    return blocks.where(F.lower("style").startswith(prefix.lower()))


def headings(blocks: DataFrame, n: int = 10) -> DataFrame:
    """The first n headings of each document, by style."""
    return blocks.where("lower(style) like 'heading%'").withColumn("h", F.expr("row_number() over (partition by document_id order by block_number)")).where(f"h <= {n}").drop("h")


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_is_empty: bool = False) -> DataFrame:
    """Typed rows with the raw line beside them; blank lines are skipped, bad ones have null fields."""
    if missing_is_empty and not _exists(spark, path):
        lines = spark.createDataFrame([], "value string")
    else:
        lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.col("value").alias("_raw"), F.from_json("value", schema).alias("_row")).select("_raw", "_row.*")


def read_jsonl_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw): the lines of each file with their numbers from 1, blank ones counted but left out.

    A file is read in splits, however large it is: lines are counted by split, and numbered within their split behind those of the splits before.
    """
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("at"))
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file", "offset").agg(F.count("*").alias("n"))
    starts = counts.select("file", "offset", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("file", "offset").orderBy("at")
    numbered = lines.withColumn("line", F.row_number().over(own)).join(starts, ["file", "offset"])
    return numbered.select("file", (F.col("line") + F.col("start")).cast("long").alias("line"), "raw").where("trim(raw) <> ''")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A JSON object of settings or counts; empty if there is no such file."""
    if not _exists(spark, path):
        return {}
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no JSON object")
    return found


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """Settings over their (nested) defaults, from a JSON object or the YAML of ``sources.settings``; unknown keys are an error."""
    if not _exists(spark, path):
        return dict(defaults)
    content = spark.read.text(path, wholetext=True).first()[0]
    try:
        found = json.loads(content)
    except ValueError:
        found = settings.parse(content)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no map of settings")
    return settings.merged(defaults, found)


def read_schema(spark: SparkSession, path: str) -> dict:
    """A JSON Schema file."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


# Fields of a catalogue entry beside kb_id and category, with what an absent one becomes.
ENTRY_DEFAULTS = {
    "subcategory": "", "title": "", "description": "", "conditions": [], "action": "", "references": [], "severity": "info", "applicable_to": ["all"], "version": "1.0", "source": "", "tags": [],
    "document_type": "evvo_rule", "section": "", "vulnerability_type": "general", "effective_date": "2026-08-15", "access_scope": "internal", "source_id": "",
}


def entry_fields(entry: str) -> list[Column]:
    """The 19 typed fields of a VARIANT column, absent ones by their defaults; a JSON null stays null."""
    out = [F.try_variant_get(entry, f"$.{name}", "string").alias(name) for name in ("kb_id", "category")]
    keys = F.json_object_keys(F.to_json(entry))
    for name, default in ENTRY_DEFAULTS.items():
        kind, value = ("array<string>", F.array(*[F.lit(x) for x in default]).cast("array<string>")) if isinstance(default, list) else ("string", F.lit(default))
        out.append(F.when(F.array_contains(keys, name), F.try_variant_get(entry, f"$.{name}", kind)).otherwise(value).alias(name))
    return out


def read_catalogue(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries and errors of JSON files that hold a list, an object with ``entries``, or one entry. Nothing found is an error."""
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = files.withColumn("v", F.try_parse_json("value")).withColumn("kind", F.schema_of_variant("v"))
    listed = F.when(F.col("kind").startswith("ARRAY"), F.col("v").cast("array<variant>")).when(F.col("kind").contains("entries:"), F.try_variant_get("v", "$.entries", "array<variant>")).when(F.col("kind").contains("kb_id:"), F.array("v"))
    rows = parsed.select("file", "v", F.posexplode_outer(listed).alias("entry_index", "entry"))
    typed = rows.select("file", "entry_index", "v", *entry_fields("entry"))
    good = F.col("kb_id").isNotNull() & F.col("category").isNotNull()
    reason = F.when(F.col("v").isNull(), "not JSON").when(F.col("entry_index").isNull(), "no entries").otherwise("kb_id or category missing")
    return typed.where(good).drop("v"), typed.where(~good).select("file", "entry_index", reason.alias("error"))


def read_defects(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{x}` string" for x in columns)).csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, existing: DataFrame, key: str, path: str) -> None:
    """``existing`` and the rows of ``df`` whose key is new, to a new path: running it twice adds nothing."""
    write_jsonl(existing.unionByName(df.join(existing.select(key), key, "left_anti")), path)


def write_both(df: DataFrame, path: str, single: bool = True) -> None:
    """One result as JSON lines and, if it is small (``single``), as one indented document beside them; computed once."""
    write_jsonl(df, f"{path}/jsonl")
    if single:
        written = df.sparkSession.read.schema(df.schema).json(f"{path}/jsonl")
        df.sparkSession.createDataFrame([(pretty_json(written),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/json")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def pretty_json(df: DataFrame, limit: int = 1000) -> str:
    """One indented document of a small result; more than ``limit`` rows is an error."""
    rows = df.limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write JSON lines instead")
    return json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False)


def markdown_table(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small result (aggregates) as a Markdown table; one of more than ``limit`` rows is an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write the table to files")
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
