"""Texts against a dictionary of any number of names: an Aho-Corasick automaton, in parts, streamed over the texts.

A dictionary of up to ``BROADCAST_BYTES`` is sent to all tasks, which read the texts where they lie. A larger one is cut into parts of about
``PART_BYTES`` by a hash of the name; each part and each slice of the texts meet in one group, the names first, so that a task builds
one automaton, streams the group's texts through it and lets it go. Neither names nor texts go through the driver then, and a
task holds one part, however long the dictionary.

Defined results: letter case does not count (characters whose lower case is longer than one character keep theirs); with ``whole_words``
no letter, digit or underscore may stand before or after the name. Occurrences may overlap. A name that is null or empty is
none, repeated names count once, names that differ in case are told apart but found alike. Null and empty texts hold nothing;
rows with equal keys are told one by one.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20
PART_BYTES = 16 << 20
#: What a name costs beside its bytes.
PER_NAME = 64


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def automaton(names: list[str]):
    """Over the lower-cased names; each end tells the length and the names as they were given. None without names."""
    forms: dict[str, list[str]] = {}
    for name in names:
        forms.setdefault(lowered(name), []).append(name)
    if not forms:
        return None
    machine = ahocorasick.Automaton()
    for form, given in forms.items():
        machine.add_word(form, (len(form), given))
    machine.make_automaton()
    return machine


def _inside(char: str) -> bool:
    return char.isalnum() or char == "_"


def found(machine, text: str, whole_words: bool) -> dict[str, tuple[int, int]]:
    """name -> (place of the first occurrence, occurrences)."""
    out: dict[str, tuple[int, int]] = {}
    low = lowered(text)
    for end, (length, given) in machine.iter(low):
        start = end - length + 1
        if whole_words and ((start and _inside(low[start - 1])) or (end + 1 < len(low) and _inside(low[end + 1]))):
            continue
        for name in given:
            first, n = out.get(name, (start, 0))
            out[name] = (min(first, start), n + 1)
    return out


def _told(batch: pa.RecordBatch, hits: list[tuple[int, str, int, int]]) -> pa.RecordBatch:
    rows, names, firsts, counts = zip(*hits) if hits else ((),) * 4
    key = batch.column(batch.schema.get_field_index("key")).take(pa.array(rows, type=pa.int64()))
    return pa.RecordBatch.from_arrays([key, pa.array(names, type=pa.string()), pa.array(firsts, type=pa.int64()), pa.array(counts, type=pa.int64())], names=["key", "name", "first", "n"])


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _scan(sent, whole_words: bool):
    def run(batches):
        machine = automaton(sent.value)
        for batch in batches:
            if machine is not None:
                yield _told(batch, [(i, name, *hit) for i, text in enumerate(_column(batch, "body")) if text for name, hit in found(machine, text, whole_words).items()])

    return run


def _scan_groups(whole_words: bool):
    """Rows sorted by part and slice, names (kind 0) before texts."""

    def run(batches):
        group, names, machine = None, [], None
        for batch in batches:
            hits = []
            for i, (part, piece, kind, body) in enumerate(zip(*(_column(batch, x) for x in ("part", "slice", "kind", "body")))):
                if (part, piece) != group:
                    group, names, machine = (part, piece), [], None
                if kind == 0:
                    names.append(body)
                    continue
                if machine is None and names:
                    machine, names = automaton(names), []
                if machine is not None and body:
                    hits += [(i, name, *hit) for name, hit in found(machine, body, whole_words).items()]
            yield _told(batch, hits)

    return run


def matches(texts: DataFrame, key: str, text: str, names: DataFrame, name: str = "name", whole_words: bool = True, broadcast_bytes: int = BROADCAST_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, name, first, n) of each text and each name of ``names`` in it: the place of its first occurrence and how many there are."""
    listed = names.select(F.col(name).cast("string").alias("body")).where("length(body) > 0").distinct()
    cost = listed.agg(F.sum(F.octet_length("body") + PER_NAME)).first()[0] or 0
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, name string, first long, n long"
    if cost <= broadcast_bytes:
        sent = texts.sparkSession.sparkContext.broadcast([r["body"] for r in listed.collect()])
        out = rows.mapInArrow(_scan(sent, whole_words), schema)
    else:
        parts = -(-cost // part_bytes)
        slices = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        piece = F.pmod(F.xxhash64("body", F.spark_partition_id()), F.lit(slices)).cast("int")
        sent = listed.select(F.pmod(F.xxhash64("body"), F.lit(parts)).cast("int").alias("part"), every(slices).alias("slice"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("key"), "body")
        told = rows.where("length(body) > 0").withColumn("slice", piece).select(every(parts).alias("part"), "slice", F.lit(1).alias("kind"), "key", "body")
        met = sent.unionByName(told).repartition(parts * slices, "part", "slice").sortWithinPartitions("part", "slice", "kind")
        out = met.mapInArrow(_scan_groups(whole_words), schema)
    return out.withColumnRenamed("key", key)
