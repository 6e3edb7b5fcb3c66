"""Line dedup by range-partitioned hashes and compressed keep bitmaps.

Texts are hashed line by line; only (hash, document, position) travels. Hashes are
range-partitioned and sorted by document and position within a hash, each partition is streamed
once, and the result is one zlib-compressed bit map of kept lines per document that loses a line.
No text is shuffled to find the bit maps.

Hot lines: each Arrow batch first keeps only its own smallest document of a key and decides the
others on the spot, so a key held by a third of all rows costs the sort one document per batch.

Defined results: a null or empty text is one empty line; a null doc_id counts as greater than all
others; rows with equal doc_id are one holder (lines of each stay if that doc_id is the smallest),
and bit maps are addressed by doc_id and a hash of the text, so repeated rows agree. Extra columns
are carried through unchanged. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, batch_of, column_of, packed, released, text_bytes

LAST = (1 << 63) - 1
_LINES = "h1 long, h2 long, doc long, text_hash long, pos int, decided boolean"
_DROPS = "doc long, text_hash long, pos int"
BITMAPS = "doc long, text_hash long, n_dropped long, bitmap binary"


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def long_enough(key: bytes, least: int) -> bool:
    """At least ``least`` code points (bytes other than 10xxxxxx start one)."""
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def _hash_lines(least: int):
    def run(batches):
        for batch in batches:
            first: dict[bytes, int] = {}
            held: list[tuple[bytes, int, int, int]] = []
            for doc, th, raw in zip(column_of(batch, "doc").to_pylist(), column_of(batch, "text_hash").to_pylist(), text_bytes(column_of(batch, "text"))):
                for pos, line in enumerate((raw or b"").split(b"\n")):
                    key = line_key(line)
                    if len(key) >= least and long_enough(key, least):
                        digest = xxhash.xxh3_128_digest(key)
                        held.append((digest, doc, th, pos))
                        if first.get(digest, LAST) >= doc:
                            first[digest] = doc
            if not held:
                continue
            pairs = np.frombuffer(b"".join(x[0] for x in held), dtype="<i8").reshape(-1, 2)
            yield batch_of(_LINES, [
                pairs[:, 0].copy(), pairs[:, 1].copy(), [x[1] for x in held], [x[2] for x in held], [x[3] for x in held],
                [first[x[0]] != x[1] for x in held],
            ])

    return run


def _stream_first(batches):
    """Rows sorted by hash, document, position: positions held by another than the hash's first document."""
    last, owner = None, None
    for batch in batches:
        h1, h2, doc = (column_of(batch, c).to_numpy() for c in ("h1", "h2", "doc"))
        n = len(h1)
        if not n:
            continue
        new = np.ones(n, dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = (h1[0], h2[0]) != last
        group = np.cumsum(new)
        owners = np.concatenate([[owner if owner is not None else 0], doc[new]])
        drop = doc != owners[group]
        last, owner = (h1[-1], h2[-1]), owners[-1]
        if drop.any():
            yield batch_of(_DROPS, [doc[drop], column_of(batch, "text_hash").to_numpy()[drop], column_of(batch, "pos").to_numpy()[drop]])


def _bitmaps(batches):
    """Rows sorted by document, text and position: one compressed bit map each (bit set: line dropped)."""

    def one(key, positions):
        pos = np.unique(np.concatenate(positions))
        bits = np.zeros(int(pos[-1]) + 1, dtype=bool)
        bits[pos] = True
        return [*key, len(pos), zlib.compress(np.packbits(bits).tobytes(), 1)]

    key, held = None, []
    for batch in batches:
        doc, th, pos = (column_of(batch, c).to_numpy() for c in ("doc", "text_hash", "pos"))
        if not len(doc):
            continue
        cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (th[1:] != th[:-1])) + 1
        done = []
        for a, b in zip([0, *cuts], [*cuts, len(doc)]):
            if (doc[a], th[a]) != key:
                if held:
                    done.append(one(key, held))
                key, held = (doc[a], th[a]), []
            held.append(pos[a:b])
        if done:
            yield batch_of(BITMAPS, list(zip(*done)))
    if held:
        yield batch_of(BITMAPS, list(zip(*[one(key, held)])))


def _addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 10) -> DataFrame:
    """(doc, text_hash, n_dropped, bitmap) of each document that loses a line; others keep all lines."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(arrow_map(_addressed(docs, id_col, text_col), _hash_lines(least_length), _LINES), "hashes")
    ordered = lines.where("not decided").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc", "pos")
    drops = arrow_map(ordered, _stream_first, _DROPS).unionAll(lines.where("decided").select("doc", "text_hash", "pos"))
    return arrow_map(drops.repartition("doc", "text_hash").sortWithinPartitions("doc", "text_hash", "pos"), _bitmaps, BITMAPS)


def dropped_lines(bitmap: bytes | None) -> frozenset[int]:
    if bitmap is None:
        return frozenset()
    return frozenset(np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))).tolist())


def kept_text(raw: bytes | None, bitmap: bytes | None) -> bytes:
    raw = raw or b""
    if bitmap is None:
        return raw
    gone = dropped_lines(bitmap)
    return b"\n".join(line for pos, line in enumerate(raw.split(b"\n")) if pos not in gone)


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 10) -> DataFrame:
    """(row, n_dropped, bitmap): each row of ``docs`` as a struct, the other two null where every line stays."""
    maps = line_keep_bitmaps(docs, id_col, text_col, least_length)
    keyed = packed(docs, doc=F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), text_hash=F.xxhash64(text_col))
    return keyed.join(maps, ["doc", "text_hash"], "left").select("row", "n_dropped", "bitmap")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 10) -> DataFrame:
    """``docs`` with repeated lines removed from the text; a null text stays null. Same columns."""
    marked = with_bitmaps(docs, id_col, text_col, least_length)

    def shortened(pairs):
        for text, bitmap in pairs:
            yield text.combine(bitmap, lambda t, b: t if t is None or b is None else kept_text(t.encode(), b).decode())

    @F.pandas_udf("string")
    def apply(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from released(shortened)(pairs)

    # called non-deterministic, or each later condition on the text would run it once more; only texts that lose a line travel
    apply, text = apply.asNondeterministic(), F.col("row")[text_col]
    losing = F.when(F.col("bitmap").isNotNull(), text)
    kept = F.when(F.col("bitmap").isNotNull(), apply(losing, F.col("bitmap"))).otherwise(text)
    return marked.select(*[(kept if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


_DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def _digests(batches):
    for batch in batches:
        rows = []
        for doc, raw, bitmap, gone in zip(
            column_of(batch, "doc_id").to_pylist(), text_bytes(column_of(batch, "text")), column_of(batch, "bitmap").to_pylist(), column_of(batch, "n_dropped").to_pylist()
        ):
            rows.append((doc, (raw or b"").count(b"\n") + 1, gone or 0, hashlib.sha256(kept_text(raw, bitmap)).hexdigest()))
        if rows:
            yield batch_of(_DIGEST, list(zip(*rows)))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """Contract columns per document: lines before, lines dropped, SHA-256 of what stays."""
    marked = with_bitmaps(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), "row.text", "n_dropped", "bitmap")
    return arrow_map(marked, _digests, _DIGEST)
