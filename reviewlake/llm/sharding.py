"""Sharding by histogram sort, with DataFrame functions only: shards of near equal bytes.

Documents are ordered by a hash of the text, then a hash of the whole row, so equal texts lie together and a group of
copies of any size can be cut anywhere. Splitters are sought for the byte positions j / n of the whole: each round counts the
exact bytes and rows between probes (equal steps between the smallest and largest key of an interval), in one aggregate with
partial sums; the cells that hold a sought position are the next round's intervals, and their rows alone are read again. A splitter
is found when its cell is within ``TOLERANCE`` of a shard or holds one key. Then rows find their place among the splitters by
binary search, and travel once. A key that is itself heavier (rows alike in every column) is cut by number: such rows are
counted first and made again behind the exchange.

Shards are cut further into buckets of about ``BUCKET`` bytes, each one group of the final sort; its first slot is known
from the counts, so a shard of any size is numbered by many tasks. Splitters travel with the plan: never more than ``MOST_BUCKETS``,
beyond which buckets grow.

Defined results: the size of a row is the UTF-8 bytes of its text plus one, so a null text has size 1; null ids are
values like any other; rows alike in every column are interchangeable; extra columns travel along, whatever their names (a map
column cannot be hashed and takes no part in the order). The same rows give the same shards and slots, however they are partitioned. Sizes of
shards differ by about one document, or by one text where a shard is smaller than it. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType

from .common import Scratch, packed

BUCKET = 8 << 20
MOST_BUCKETS = 1 << 16
#: Probes of a round for each splitter that is sought.
PROBES = 32
#: Share of a shard by which a splitter may miss its place, where documents are small enough.
TOLERANCE = 1 / 2000


@dataclass(frozen=True)
class Splitter:
    """Below lie the rows with keys under (a, b), and with ``after`` those at (a, b): all, or ``copies`` of them if the key is cut."""

    a: int
    b: int
    after: int
    copies: int
    rows_below: int


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _holds_map(kind: DataType) -> bool:
    inner = [getattr(kind, "elementType", None), *[f.dataType for f in getattr(kind, "fields", [])]]
    return isinstance(kind, MapType) or any(_holds_map(x) for x in inner if x is not None)


def _hash(*columns: Column) -> Column:
    """63 bits; a null leaves a hash as it is, so what is null goes in too."""
    return F.shiftrightunsigned(F.xxhash64(*columns, *[x.isNull() for x in columns]), 1)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, a, b, size): rows with their keys."""
    every = [F.col(f"`{f.name}`") for f in docs.schema.fields if not _holds_map(f.dataType)]
    text = F.col(f"`{text_col}`")
    return packed(docs, a=_hash(text), b=_hash(*every), size=byte_size(text))


def _table(like: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """A few rows of longs known to the driver, as a plan of their own."""
    text = json.dumps([dict(zip(names.split(), row)) for row in rows])
    fields = ",".join(f"{name}:bigint" for name in names.split())
    return like.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def _sums() -> list[Column]:
    """Of a cell: bytes, rows, the smallest and the largest key of either level."""
    return [F.sum("size").alias("bytes"), F.count("*").alias("rows"), *[f(k).alias(f"{k}_{name}") for k in "ab" for name, f in (("min", F.min), ("max", F.max))]]


def _one_key(cell) -> bool:
    return cell["a_min"] == cell["a_max"] and cell["b_min"] == cell["b_max"]


def _settled(place: float, bytes_before: int, rows_before: int, cell) -> Splitter:
    """The end of the cell that is nearer to ``place``; of a cell of one key, the nearest number of its rows."""
    if _one_key(cell):
        below = min(cell["rows"], max(0, round((place - bytes_before) * cell["rows"] / cell["bytes"])))
    else:
        below = 0 if place - bytes_before <= cell["bytes"] / 2 else cell["rows"]
    if below == 0:
        return Splitter(cell["a_min"], cell["b_min"], 0, 0, rows_before)
    return Splitter(cell["a_max"], cell["b_max"], 1, below if below < cell["rows"] else 0, rows_before + below)


def find_splitters(scratch: Scratch, rows: DataFrame, parts: int, tolerance: float) -> list[Splitter]:
    """The ``parts - 1`` splitters of ``rows`` (parent = 0, a, b, size) at the byte positions j / parts, within ``tolerance`` bytes or one key.

    The driver holds one cell for each splitter at most.
    """
    whole = rows.agg(*_sums()).first()
    if not whole["rows"]:
        return []
    share = whole["bytes"] / parts
    found: dict[int, Splitter] = {}
    cells = [(0, 0, 0, range(1, parts), whole)]  # id, bytes and rows before it, splitters in it, its sums
    turn = 0
    while True:
        open_ = []
        for parent, bytes_before, rows_before, sought, cell in cells:
            if _one_key(cell) or cell["bytes"] <= tolerance:
                found |= {j: _settled(j * share, bytes_before, rows_before, cell) for j in sought}
            else:
                level = int(cell["a_min"] == cell["a_max"])
                first, last = cell["ab"[level] + "_min"], cell["ab"[level] + "_max"]
                open_.append((parent, level, first, (last - first) // (PROBES * len(sought)) + 1, bytes_before, rows_before))
        if not open_:
            return [found[j] for j in sorted(found)]
        intervals = _table(rows, open_, "parent level first step bytes_before rows_before")
        inside = rows.join(F.broadcast(intervals.select("parent", "level", "first", "step")), "parent")
        inside = inside.select("a", "b", "size", "parent", F.expr("(if(level = 0, a, b) - first) div step").alias("child"))
        before = Window.partitionBy("parent").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
        counted = inside.groupBy("parent", "child").agg(*_sums())
        counted = counted.withColumns({f"{x}_in": F.coalesce(F.sum(x).over(before), F.lit(0)) for x in ("bytes", "rows")})
        counted = counted.join(F.broadcast(intervals.select("parent", "bytes_before", "rows_before")), "parent")
        counted = counted.withColumns({f"{x}_before": F.col(f"{x}_before") + F.col(f"{x}_in") for x in ("bytes", "rows")})
        # Splitter j lies in the one cell with bytes_before <= j * share < bytes_before + bytes.
        first_j = F.greatest(F.lit(1), F.ceil(F.col("bytes_before") / F.lit(share)))
        end_j = F.least(F.lit(parts), F.ceil((F.col("bytes_before") + F.col("bytes")) / F.lit(share)))
        hit = counted.withColumns({"first_j": first_j, "end_j": end_j}).where("first_j < end_j").collect()
        cells = [(i, x["bytes_before"], x["rows_before"], range(x["first_j"], x["end_j"]), x) for i, x in enumerate(hit)]
        kept = _table(rows, [(x["parent"], x["child"], i) for i, x in enumerate(hit)], "parent child id")
        inside = inside.join(F.broadcast(kept), ["parent", "child"])
        rows, turn = scratch.keep(inside.select("a", "b", "size", F.col("id").alias("parent")), f"cells{turn + 1}"), turn + 1
        scratch.drop(f"cells{turn - 1}")


def _literal(found: list[Splitter]) -> Column:
    text = json.dumps([{"a": s.a, "b": s.b, "after": s.after, "copies": s.copies} for s in found])
    return F.from_json(F.lit(text), "array<struct<a:bigint,b:bigint,after:int,copies:bigint>>")


def _splitters_below(splits: Column, n: int) -> Column:
    """How many of the n sorted splitters the row (a, b) lies behind."""

    def step(now: Column, _: Column) -> Column:
        middle = F.floor((now["low"] + now["high"]) / 2)
        s = F.get(splits, middle.cast("int"))
        behind = (s["a"] < F.col("a")) | ((s["a"] == F.col("a")) & ((s["b"] < F.col("b")) | ((s["b"] == F.col("b")) & (s["after"] == 0))))
        next_ = F.when(behind, F.struct((middle + 1).alias("low"), now["high"].alias("high"))).otherwise(F.struct(now["low"].alias("low"), middle.alias("high")))
        return F.when(now["low"] >= now["high"], now).otherwise(next_)

    start = F.struct(F.lit(0).cast("long").alias("low"), F.lit(n).cast("long").alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, step, lambda x: x["low"]).cast("int")


def _in_buckets(keyed: DataFrame, found: list[Splitter]) -> DataFrame:
    """(row, a, b, bucket), dealt by bucket: the one exchange of rows."""
    if not found:
        return keyed.select("row", "a", "b", F.lit(0).alias("bucket"))
    splits = _literal(found)
    placed = keyed.select("row", "a", "b", _splitters_below(splits, len(found)).alias("bucket"))
    if not any(s.copies for s in found):
        return placed.repartition("bucket")
    # Rows of a key that is cut lie before its first cut here.
    following = F.get(splits, F.col("bucket"))
    placed = placed.withColumn("cut", F.coalesce((following["a"] == F.col("a")) & (following["b"] == F.col("b")) & (following["copies"] > 0), F.lit(False)))
    alike = placed.where("cut").groupBy("a", "b", "bucket").agg(F.first("row").alias("row"), F.count("*").alias("n"))
    cuts = F.filter(splits, lambda s: (s["a"] == F.col("a")) & (s["b"] == F.col("b")) & (s["copies"] > 0))
    alike = alike.withColumn("edges", F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda s: s["copies"]), F.array("n")))
    piece = lambda i: F.struct((F.col("bucket") + i).cast("int").alias("bucket"), (F.get("edges", i + 1) - F.get("edges", i)).alias("n"))
    alike = alike.select("row", "a", "b", F.inline(F.transform(F.sequence(F.lit(0), F.size("edges") - 2), piece)))
    dealt = placed.where("not cut").select("row", "a", "b", "bucket", F.lit(1).cast("long").alias("n")).unionByName(alike.where("n > 0")).repartition("bucket")
    return dealt.select("row", "a", "b", "bucket", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_")).drop("_")


def sharded(docs: DataFrame, shards: int = 16, text_col: str = "text", bucket: int = BUCKET, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, .. in each shard); columns of these names are replaced."""
    keyed = _keyed(docs, text_col)
    scratch = Scratch(docs.sparkSession, "sharding")
    slim = scratch.keep(keyed.select(F.lit(0).cast("long").alias("parent"), "a", "b", "size"), "cells0")
    total = slim.agg(F.sum("size")).first()[0] or 0
    each = max(1, min(MOST_BUCKETS // shards, -(-total // (shards * bucket))))
    found = find_splitters(scratch, slim, shards * each, tolerance * total / shards)
    scratch.drop(*list(scratch.paths))
    below = [0, *(s.rows_below for s in found)]
    starts = F.from_json(F.lit(json.dumps([x - below[i - i % each] for i, x in enumerate(below)])), "array<bigint>")
    order = Window.partitionBy("bucket").orderBy("a", "b")
    out = _in_buckets(keyed, found).withColumn("place", F.row_number().over(order) - 1)
    kept = [F.col("row")[name].alias(name) for name in docs.columns if name.lower() not in ("shard", "slot")]
    return out.select(*kept, F.expr(f"bucket div {each}").cast("int").alias("shard"), (F.get(starts, F.col("bucket")) + F.col("place")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, text_col: str = "text") -> None:
    """The shards as Parquet folders ``shard=N``; each file holds a stretch of slots in order."""
    sharded(docs, shards, text_col).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def sharding_digest(docs: DataFrame) -> DataFrame:
    """Contract columns, from the rows of the shards."""
    out = sharded(docs.select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), byte_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
