"""Shared plumbing: scratch tables in the shared folder, text hashing in numpy, connected components.

Scratch tables live below ``spark.checkpoint.dir`` (set here only where it is
unset, as in tests), so losing an executor never loses intermediate data.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
ASCII_SPACE_CLASS = "[^\\x20\\x09-\\x0D]+"

# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors; a temporary one only where none is configured and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Intermediate tables of one operator call. ``drop`` frees what no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.made = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: cuts lineage and survives lost executors."""
        path = f"{self.base}/{name}-{self.made}"
        self.made += 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name, None)
            if path:
                jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def packed(docs: DataFrame, **columns) -> DataFrame:
    """All columns of ``docs`` as one struct ``row`` beside ``columns``, so that no name of theirs can clash."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).alias("none"))
    return docs.select(row.alias("row"), *[value.alias(name) for name, value in columns.items()])


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the check before a broadcast."""
    return df.count() <= rows


def released(work):
    """``work`` for mapInArrow that hands freed memory back when its rows end: idle workers of earlier stages stay small."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library: nothing to trim

    return run


def arrow_map(df: DataFrame, work, schema: str) -> DataFrame:
    return df.mapInArrow(released(work), schema)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def large(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]


def batch_of(schema: str, arrays: list) -> pa.RecordBatch:
    """RecordBatch for a mapInArrow schema such as ``a long, b int``."""
    fields = [part.split() for part in schema.split(",")]
    cols = [x if isinstance(x, pa.Array) else pa.array(x, type=large(kind)) for x, (_, kind) in zip(arrays, fields, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=[name for name, _ in fields])


def text_bytes(column: pa.Array):
    """UTF-8 bytes of each value, None for null, without decoding."""
    for value in column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column:
        yield value.as_py()


# ---------------------------------------------------------------- hashing in numpy

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Rolling:
    """Hash of any byte range in constant time: prefix sums of keyed bytes times powers, modulo 2**64.

    One instance serves texts of any length: callers pass segments of at most ``SEGMENT`` bytes. Some different ranges of over
    1,000 bytes share a hash of this kind whatever the table and the base are (Thue-Morse words); ``words`` has no such pairs.
    """

    SEGMENT = 1 << 20
    #: Bytes of a word that are mixed in numpy; longer words are hashed one by one.
    CHUNKED = 64

    def __init__(self, seed: int, fold_case: bool = False):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self.fold = np.arange(256, dtype=np.uint8)
        if fold_case:
            self.table[65:91] = self.table[97:123]
            self.fold[65:91] = self.fold[97:123]
        self.key = seed.to_bytes(8, "little")
        self.begun = mix(np.arange(self.CHUNKED + 1, dtype=np.uint64) + _U(seed << 32))
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            out = np.full(n, b, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.pow, self.inv = powers(self.base), powers(self.inverse)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n + 1 > len(self.pow):
            self._grow(max(n + 1, 2 * len(self.pow)))
        out = np.empty(n + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum(self.table[data] * self.pow[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inv[start])

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        n = len(prefix) - size
        return mix((prefix[size:] - prefix[:n]) * self.inv[:n])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each of these non-empty ranges: its size, then eight bytes at a time, each step a bijection of what was there."""
        padded = np.concatenate([self.fold[data], np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        sizes = ends - starts
        capped = np.minimum(sizes, self.CHUNKED)
        h = mix(self.begun[capped] ^ (eight[starts] & _FIRST[capped]))
        left, offset = np.flatnonzero(sizes > 8), 8
        while len(left):
            h[left] = mix(h[left] ^ (eight[starts[left] + offset] & _FIRST[capped[left] - offset]))
            offset += 8
            left = left[capped[left] > offset]
        for i in np.flatnonzero(sizes > self.CHUNKED):
            h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8, key=self.key).digest(), "little")
        return h


#: Masks of the first n bytes of eight.
_FIRST = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(Rolling.CHUNKED + 1)], dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than space and 09-0D."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def segments(raw: bytes, size: int = Rolling.SEGMENT):
    """Pieces of at most about ``size`` bytes that never cut a word (a longer word stays whole)."""
    start, n = 0, len(raw)
    while n - start > size:
        end = start + size
        m = re.compile(rb"[\x20\x09-\x0d]").search(raw, end)
        end = m.start() if m else n
        yield raw[start:end]
        start = end
    yield raw[start:]


def word_hashes(raw: bytes, rolling: Rolling) -> np.ndarray:
    """One 64-bit hash per word of the whole text, A-Z equal to a-z if the table folds case."""
    out = []
    for piece in segments(raw):
        data = np.frombuffer(piece, dtype=np.uint8)
        starts, ends = word_spans(data)
        if len(starts):
            out.append(rolling.words(data, starts, ends))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


_STEP = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5), _U(0x85EBCA77C2B2AE63)]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        h = h + words[j : n - size + 1 + j] * _STEP[j % 5] * _U(2 * j + 1)
    return np.unique(mix(h))


def shingle_sets(texts, k: int, rolling: Rolling) -> list[np.ndarray]:
    """``shingle_set`` of the words of each text (None: no words); texts are hashed together, about ``SEGMENT`` bytes at a time."""
    out, part, held = [], [], 0
    for raw in texts:
        raw = raw or b""
        if part and held + len(raw) > Rolling.SEGMENT:
            out += _sets_of(part, k, rolling)
            part, held = [], 0
        part.append(raw)
        held += len(raw) + 1
    return out + _sets_of(part, k, rolling) if part else out


def _sets_of(texts: list[bytes], k: int, rolling: Rolling) -> list[np.ndarray]:
    if len(texts) == 1:
        return [shingle_set(word_hashes(texts[0], rolling), k)]
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    starts, ends = word_spans(data)
    words = rolling.words(data, starts, ends) if len(starts) else np.empty(0, dtype=np.uint64)
    bounds = np.searchsorted(starts, np.cumsum([len(raw) + 1 for raw in texts])).tolist()
    n = max(0, len(words) - k + 1)
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h += words[j : n + j] * _STEP[j % 5] * _U(2 * j + 1)
    h = mix(h)
    spans = [(a, b - k + 1) if b - a >= k else None for a, b in zip([0, *bounds], bounds)]
    for span in spans:
        if span:
            h[span[0] : span[1]].sort()
    new = np.ones(n, dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[[span[0] for span in spans if span]] = True
    out = []
    for a, b, span in zip([0, *bounds], bounds, spans):
        if span:
            first = new[span[0] : span[1]]
            out.append(h[span[0] : span[1]] if first.all() else h[span[0] : span[1]][first])
        else:
            out.append(shingle_set(words[a:b], k))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- connected components


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node either points at one smaller node or is pointed at."""
    edges = edges.where("hi <> lo")
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component): component is the smallest node reachable over ``edges(a, b)``.

    Alternating large-star and small-star steps, each an aggregate and a join, so a hub's
    neighbours are never gathered in one group; lineage is cut by a written table each round.
    Self loops only make a node known. Null ends are dropped. Empty edges give an empty table.
    """
    edges = edges.where("a is not null and b is not null")
    cur = scratch.keep(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{name}0"
    )
    turn = 0
    while not _only_stars(cur):
        both = cur.where("hi <> lo").select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            cur.where("hi <> lo").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large_star = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large_star.where("hi <> lo").groupBy("hi").agg(F.min("lo").alias("m"))
        small = large_star.where("hi <> lo").join(low, "hi")
        small_star = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(
            small.select("hi", F.col("m").alias("lo"))
        ).where("hi <> lo").distinct()
        turn += 1
        cur = scratch.keep(small_star, f"{name}{turn}")
        if turn > 1:
            scratch.drop(f"{name}{turn - 1}")
    nodes = scratch.spark.read.schema(cur.schema).parquet(scratch.paths[f"{name}0"])
    every = nodes.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    return every.join(cur.where("hi <> lo").withColumnRenamed("hi", "node"), "node", "left").select(
        "node", F.coalesce("lo", "node").alias("component")
    )


