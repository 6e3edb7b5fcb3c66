"""Suffix-array style removal of repeated byte strings by bucket-pointer refinement.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller doc_id, or
the same document further left) is removed. Windows of that length are the suffixes, compared to
that depth. Refinement starts from buckets of equal q-grams and splits them by what lies at later
offsets, until buckets hold equal windows:

1. Buckets. Each window is put in the bucket of one of its q-grams, the leftmost of those with
   the least hash, so equal windows share the bucket and the place in it. A bucket member stands
   for the run of windows that chose it, with a fingerprint of all bytes of the run.
2. Members are range-partitioned and sorted by (bucket, fingerprint, document, offset) and
   streamed: a member with an equal run before it is decided, and so are buckets with one member.
3. What is left are buckets whose members differ around the q-gram (ends of repeated passages,
   edits). Their runs of bytes are fetched and refined by bucket pointers: windows are bucketed
   by their first quarter, then sorted by (own bucket, bucket of a quarter further), giving
   buckets of halves, whose new numbers are used to refine again by the bucket half a window
   further. Buckets of one window are dropped as they appear.
4. A bucket too large for one task is refined by bucket pointers as well, across tasks: a window that
   holds the q-gram holds half of what it lacks of the window's length on the gram's left or on its right, so each
   member becomes at most two, in the buckets of (own bucket, what lies at that offset). They are
   sorted and streamed like step 2, and what is left goes on to step 3, or again here with the longer
   gram. Members travel, not windows; once the gram is as long as a window nothing is left.

Copies cost little: within an Arrow batch equal runs after the first are decided at once, so a
text held by a third of all rows sends one member per batch to the sort.

Defined results: null texts are empty; null doc_ids count as greater than all others; of rows with
equal doc_id and text the copies are one document in result and order; rows of equal doc_id and
other texts are ordered by a hash of the text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, arrow_map, batch_of, column_of, mix, packed, signed, text_bytes

_U = np.uint64
LENGTH = 100
GRAM = 20
#: Members of a bucket that one task gathers; larger buckets are refined across tasks first.
MANY = 1000
LAST = (1 << 63) - 1
PIECE = 1 << 20
MEMBERS = "bucket long, run long, doc long, text_hash long, lo int, span int, gram int, decided boolean"
RANGES = "doc long, text_hash long, lo int, hi int"
OPEN = "bucket long, doc long, text_hash long, lo int, span int, gram int, decided boolean"
HALVES = "bucket long, run long, doc long, text_hash long, lo int, span int, gram int, decided boolean, bytes binary"
OPEN_HALVES = "bucket long, doc long, text_hash long, lo int, span int, gram int, decided boolean, bytes binary"


def _rolling() -> Rolling:
    return Rolling(77001)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    size, m = 1, x
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def bucket_members(raw: bytes, rolling: Rolling, length: int = LENGTH, gram: int = GRAM):
    """(bucket, run fingerprint, first window, windows - 1, q-gram's distance from the first window) of a text.

    Long texts go in pieces that overlap by less than a window, so each window is seen once.
    """
    w = length - gram + 1
    for begin in range(0, max(len(raw) - length + 1, 0), PIECE):
        data = np.frombuffer(raw[begin : begin + PIECE + length - 1], dtype=np.uint8)
        prefix = rolling.prefix(data)
        grams = rolling.windows(prefix, gram)
        # The hash's leading bits, then the place: the least is the leftmost of the least hashes.
        place = np.arange(len(grams), dtype=np.uint64)
        best = sliding_min((grams & _U(~((1 << 21) - 1) & (1 << 64) - 1)) | place, w) & _U((1 << 21) - 1)
        best = best.astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        last = np.concatenate([first[1:], [len(best)]]) - 1
        at = best[first]
        run = rolling.ranges(prefix, first, last + length)
        run = mix(run + (at - first).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
        yield grams[at], run, first + begin, last - first, at - first


def _members(batches):
    rolling = _rolling()
    for batch in batches:
        docs, hashes = column_of(batch, "doc").to_numpy(), column_of(batch, "text_hash").to_numpy()
        found, waiting = [], 0
        for i, raw in enumerate(text_bytes(column_of(batch, "text"))):
            for member in bucket_members(raw or b"", rolling):
                found.append((*member, np.full(len(member[0]), docs[i]), np.full(len(member[0]), hashes[i])))
                waiting += len(member[0])
            if waiting > 300_000:
                yield _member_rows(found)
                found, waiting = [], 0
        if found:
            yield _member_rows(found)


def _judged(found):
    """Columns of members, and marks: an equal run comes before it among these; it is a repeated row of the table."""
    bucket, run, lo, span, gram, doc, th = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((lo, th, doc, run, bucket))
    b, r, d, t, p = (x[order] for x in (bucket, run, doc, th, lo))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1])
    of = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    same_place = (d == d[of]) & (t == t[of]) & (p == p[of])
    again, twice = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    again[order] = ~head & ~same_place
    twice[order] = ~head & same_place
    return (signed(bucket), signed(run), doc, th, lo, span, gram), again, twice


def _member_rows(found):
    """Within a batch, all but the first of equal runs are decided here."""
    cols, again, twice = _judged(found)
    return batch_of(MEMBERS, [*(x[~twice] for x in cols), again[~twice]])


def _split_buckets(batches, with_bytes: bool = False):
    """Rows sorted by bucket, run, document, offset: repeats of a run, and first members of runs whose bucket has others.

    A bucket that touches a partition's ends may go on elsewhere, so its first member is told too.
    """
    names = ("bucket", "run", "doc", "text_hash", "lo", "span", "gram")
    last = None  # the newest row's run: its first member
    pending = None  # the first member of a bucket with one run so far
    for batch in batches:
        cols = [column_of(batch, c).to_numpy() for c in names]
        n = len(cols[0])
        if not n:
            continue
        if with_bytes:
            cols.append(column_of(batch, "bytes").to_numpy(zero_copy_only=False))
        bucket, run, doc, th, lo = cols[:5]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = bucket[1:] != bucket[:-1]
        fresh[0] = last is None or bucket[0] != last[0]
        head = fresh.copy()
        head[1:] |= run[1:] != run[:-1]
        head[0] |= last is None or run[0] != last[1]
        of = np.maximum.accumulate(np.where(head, np.arange(n), -1))
        own = np.where(of < 0, 0, of)
        place = [np.where(of < 0, last[i] if last is not None else 0, c[own]) for i, c in ((2, doc), (3, th), (4, lo))]
        repeat = ~head & ((doc != place[0]) | (th != place[1]) | (lo != place[2]))
        heads = np.flatnonzero(head)
        emit = np.zeros(len(heads), dtype=bool)
        if len(heads):
            first_of_bucket = fresh[heads]
            emit = ~first_of_bucket
            emit[:-1] |= first_of_bucket[:-1] & ~first_of_bucket[1:]
            if last is None:
                emit[0] = True
            if pending is not None and not first_of_bucket[0]:
                yield _open_rows(pending, False)
            pending = None if emit[-1] else [c[heads[-1] :][:1] for c in cols]
            last = [c[heads[-1]] for c in cols]
        if repeat.any():
            yield _open_rows([c[repeat] for c in cols], True)
        if emit.any():
            yield _open_rows([c[heads[emit]] for c in cols], False)
    if pending is not None:
        yield _open_rows(pending, False)


def _open_rows(cols, decided: bool):
    out = [cols[0], *cols[2:7], np.full(len(cols[0]), decided)]
    return batch_of(OPEN, out) if len(cols) == 7 else batch_of(OPEN_HALVES, [*out, [None] * len(cols[0]) if decided else list(cols[7])])


def _split_halves(batches):
    return _split_buckets(batches, with_bytes=True)


def deeper(depth: int) -> int:
    """Length of the gram after the next refinement across tasks."""
    return depth + (LENGTH - depth + 1) // 2


def _halves(depth: int):
    """Members of large buckets, whose gram has ``depth`` bytes, as members of the buckets of longer grams."""
    step = deeper(depth) - depth

    def run(batches):
        rolling = _rolling()
        for batch in batches:
            rows, pieces = [], []
            cols = [column_of(batch, c).to_pylist() for c in ("bucket", "doc", "text_hash", "lo", "span", "gram")]
            for bucket, doc, th, lo, span, gram, raw in zip(*cols, text_bytes(column_of(batch, "bytes"))):
                prefix = rolling.prefix(np.frombuffer(raw, dtype=np.uint8))
                # Windows 0 .. gram - step have ``step`` bytes on the gram's left, the others on its right.
                for side, first, last, at in ((0, 0, min(span, gram - step), gram - step), (1, max(0, gram - step + 1), span, gram)):
                    if first <= last:
                        ends = np.array([at + deeper(depth), last + LENGTH])
                        part, whole = rolling.ranges(prefix, np.array([at, first]), ends)
                        rows.append((bucket, side, part, whole, lo + first, last - first, at - first, doc, th))
                        pieces.append(raw[first : last + LENGTH])
            if not rows:
                continue
            own, side, part, whole, lo, span, gram, doc, th = (np.array(c) for c in zip(*rows))
            key = mix(mix(own.view(np.uint64) + side.astype(np.uint64)) + part * _U(0xC2B2AE3D27D4EB4F))
            same = mix(whole + gram.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + span.astype(np.uint64) * _U(0x165667B19E3779F9))
            found = (key, same, lo, span, gram, doc, th)
            cols, again, twice = _judged([found])
            kept = ~twice
            none = [None if gone else piece for piece, gone in zip(pieces, again)]  # decided ones need no bytes
            yield batch_of(HALVES, [*(x[kept] for x in cols), again[kept], [x for x, k in zip(none, kept) if k]])

    return run


def _shared(key: np.ndarray) -> np.ndarray:
    """Marks the values that occur more than once, by sorting."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def refine(buckets, doc, th, lo, gram, pieces: list[bytes], rolling: Rolling, length: int = LENGTH):
    """(member, window) index pairs of windows that have an equal one earlier, among members of equal buckets."""
    quarter = length // 4
    sizes = np.array([len(p) for p in pieces])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    prefix = rolling.prefix(np.frombuffer(b"".join(pieces), dtype=np.uint8))
    first = rolling.windows(prefix, quarter)  # initial buckets: the quarter at each offset
    windows = sizes - length + 1
    member = np.repeat(np.arange(len(pieces)), windows)
    r = np.arange(len(member)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[member] + r
    # Equal windows hold their bucket's q-gram at the same place.
    bucket = mix(mix(buckets.view(np.uint64)[member]) + (gram[member] - r).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    bucket = mix(bucket + first[at])
    later = first
    depth = quarter
    while True:
        keep = _shared(bucket)
        member, r, at, bucket = member[keep], r[keep], at[keep], bucket[keep]
        if depth >= length or not len(at):
            break
        # Sort on (own bucket, bucket of the later offset); then the new identifiers serve at twice the depth.
        bucket = mix(bucket + later[at + depth] * _U(0xC2B2AE3D27D4EB4F))
        if 2 * depth < length:
            later = mix(later[: len(later) - depth] + later[depth:] * _U(0x165667B19E3779F9))
        depth *= 2
    place = lo[member] + r
    order = np.lexsort((place, th[member], doc[member], bucket))
    m, w, b, p = member[order], r[order], bucket[order], place[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = b[1:] != b[:-1]
    of = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    again = (doc[m] != doc[m[of]]) | (th[m] != th[m[of]]) | (p != p[of])
    return m[again], w[again]


def _refined(batches):
    """Rows sorted by bucket, with their bytes: ranges of repeated bytes. Whole buckets are gathered up to a bound of bytes."""
    rolling = _rolling()
    names = ("bucket", "doc", "text_hash", "lo", "gram")
    held: list = []
    size = 0

    def work():
        cols = [np.concatenate([h[0][i] for h in held]) for i in range(len(names))]
        pieces = [x for h in held for x in h[1]]
        m, w = refine(*cols, pieces, rolling)
        order = np.lexsort((w, m))
        m, w = m[order], w[order]
        cut = np.flatnonzero((m[1:] != m[:-1]) | (w[1:] != w[:-1] + 1)) + 1
        a, z = np.concatenate([[0], cut]), np.concatenate([cut, [len(m)]]) - 1
        if len(m):
            lo = cols[3][m[a]]
            yield batch_of(RANGES, [cols[1][m[a]], cols[2][m[a]], lo + w[a], lo + w[z] + LENGTH])

    for batch in batches:
        cols = [column_of(batch, c).to_numpy() for c in names]
        pieces = [x.as_py() for x in column_of(batch, "bytes")]
        n = len(pieces)
        if not n:
            continue
        start = 0
        for end in [*(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1), n]:
            if size > 3_000_000 and (not held or held[-1][0][0][-1] != cols[0][start]):
                yield from work()
                held, size = [], 0
            held.append(([c[start:end] for c in cols], pieces[start:end]))
            size += sum(map(len, pieces[start:end]))
            start = end
    if held:
        yield from work()


def _decided_ranges(rows: DataFrame) -> DataFrame:
    return rows.where("decided").select("doc", "text_hash", "lo", F.expr(f"lo + span + {LENGTH}").cast("int").alias("hi"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, lo, hi): byte ranges to remove of ``docs(doc, text_hash, text)``; they may overlap."""
    scratch = Scratch(docs.sparkSession, "substrings")
    members = scratch.keep(arrow_map(docs, _members, MEMBERS), "members")
    decided = [scratch.keep(_decided_ranges(members), "decided")]
    ordered = members.where("not decided").repartitionByRange("bucket", "run").sortWithinPartitions("bucket", "run", "doc", "text_hash", "lo")
    split = scratch.keep(arrow_map(ordered, _split_buckets, OPEN), "split")
    scratch.drop("members")
    decided.append(_decided_ranges(split))

    wanted = split.where("not decided").drop("decided").withColumnsRenamed({"doc": "o_doc", "text_hash": "o_hash"})
    piece = F.expr(f"substring(cast(text as binary), lo + 1, span + {LENGTH})").alias("bytes")
    fetched = docs.join(wanted, (F.col("doc") == F.col("o_doc")) & (F.col("text_hash") == F.col("o_hash")))
    rest = scratch.keep(fetched.select("bucket", "doc", "text_hash", "lo", "span", "gram", piece), "open")
    depth = GRAM
    while True:
        large = scratch.keep(rest.groupBy("bucket").agg(F.count("*").alias("n")).where(f"n > {MANY}").select("bucket"), "large")
        some = depth < LENGTH and not large.isEmpty()
        usual = rest.join(large, "bucket", "left_anti") if some else rest
        decided.append(arrow_map(usual.repartition("bucket").sortWithinPartitions("bucket", "doc", "text_hash", "lo"), _refined, RANGES))
        if not some:
            break
        halves = scratch.keep(arrow_map(rest.join(large, "bucket", "left_semi"), _halves(depth), HALVES), "halves")
        depth = deeper(depth)
        ordered = halves.where("not decided").repartitionByRange("bucket", "run").sortWithinPartitions("bucket", "run", "doc", "text_hash", "lo")
        split = scratch.keep(arrow_map(ordered, _split_halves, OPEN_HALVES), "split_halves")
        decided += [_decided_ranges(halves), _decided_ranges(split)]
        rest = split.where("not decided").drop("decided")
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return scratch.keep(out, "ranges")


def merged_spans(ranges) -> list[tuple[int, int]]:
    """Maximal runs of the union of (lo, hi) ranges; ranges that touch are one run."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def removal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, spans): each row of ``docs`` as a struct, and (lo, hi) byte ranges of its text, unmerged, null where nothing repeats."""
    keyed = packed(docs, doc=F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), text_hash=F.xxhash64(text_col), text=F.col(text_col))
    ranges = repeated_ranges(keyed.select("doc", "text_hash", "text"))
    grouped = ranges.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return keyed.drop("text").join(grouped, ["doc", "text_hash"], "left").select("row", "spans")


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(batches):
    for batch in batches:
        rows = []
        for doc, raw, spans in zip(column_of(batch, "doc_id").to_pylist(), text_bytes(column_of(batch, "text")), column_of(batch, "spans")):
            raw, spans = raw or b"", merged_spans((x["lo"], x["hi"]) for x in spans.as_py() or ())
            digest, start = hashlib.sha256(), 0
            for lo, hi in spans:
                digest.update(raw[start:lo])
                start = hi
            digest.update(raw[start:])
            rows.append((doc, len(raw), sum(hi - lo for lo, hi in spans), len(spans), digest.hexdigest()))
        if rows:
            yield batch_of(_DIGEST, list(zip(*rows)))


def substring_digest(docs: DataFrame) -> DataFrame:
    """Contract columns per document."""
    return arrow_map(removal_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("row.*", "spans"), _digests, _DIGEST)
