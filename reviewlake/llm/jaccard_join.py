"""N-gram Jaccard join by PartEnum signatures, with exact verification and connected components.

Sizes are cut into bands. Two sets that reach the similarity lie in one band or in neighbouring
ones (then both sign for the upper band) and differ in at most k elements. A hash cuts the element
domain into n1 parts, each into n2 subparts; every choice of n2 - k2 subparts of a part is one
signature. Small k: one part, k2 = k. Larger k: n2 = 3 and k2 = 1; of more than k / 2 parts one has at most
one difference, so two of its three subparts hold the same elements in both sets. The number of differences
follows the smaller set, so a set signs a prefix of the parts, never a shorter one than a smaller set of
the band. A set with too many empty choices in its prefix signs all parts, and tells the empty choices apart
by its signatures under another hash.

Sets, not documents, are joined: documents with equal sets share a fingerprint, and each Arrow
batch sends a set's signatures once, so groups of copies cost no more than one text. Texts are
read once for sets, sketches and signatures. Signatures are range-partitioned, sorted and
streamed; only groups of at least two sets go on, joined with 128-bit sketches (one bit of the least hash in
each of 128 bins). Sets of a group with close sketches (a pair at the similarity passes with six
standard deviations to spare) are one family; a task sends each set's family root, not pairs.
Families get their sets, in tiles of bounded size, and pairs within a family that are not connected yet are compared
exactly; again roots are sent, not pairs. So no link that joins components is left out, and
no group's pairs are sent.

Defined results: null or empty texts have no set and link with nothing; fewer words than
the shingle length are one shingle; rows with equal doc_id each count as holders of that id; null ids
get a null component; extra columns are ignored. Sets are held as 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, arrow_map, batch_of, column_of, connected_components, mix, packed, shingle_sets, signed, text_bytes

_U = np.uint64
_MASK = (1 << 64) - 1
_BINS = np.arange(128, dtype=np.uint64) << _U(57)
TILE = 4096
FAMILY_TILE = 1024
#: Bytes of text whose sets are made and signed together.
TOGETHER = 2_000_000
#: Subparts of all sets that are signed together.
MOST_PARTS = 1 << 19
#: Rows of the tiles whose pairs are compared many tiles at a time, and pairs that wait before they are made a forest.
SMALL_TILE = 64
MOST_PAIRS = 500_000
#: Bits of the filter for each set in a family, and the most bits that are sent (16 MB). A fuller filter lets
#: more sets pass to the join that drops them; results do not change.
BITS_A_SET = 16
MOST_BITS = 1 << 27
BAND_STEP = 3
SETS = "doc_id long, text_hash long, n_shingles long, set_id long, s1 long, s2 long, signatures binary"
ELEMENTS = "set_id long, elements binary"
MEMBERS = "signature long, set_id long"
EDGES = "a long, b long"


class PartEnum:
    """Signatures of sets of 64-bit hashes for Jaccard >= percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent

    def band(self, size: int) -> tuple[int, int, int]:
        """(number, smallest, largest size) of the band that holds ``size``."""
        number, low = 0, 1
        while True:
            high = max(low, low * 100**BAND_STEP // self.percent**BAND_STEP)
            if size <= high:
                return number, low, high
            number, low = number + 1, high + 1

    def differences(self, largest: int) -> int:
        """Most elements in which two sets of the band may differ: sizes a + b <= 2 * largest."""
        return 2 * largest * (100 - self.percent) // (100 + self.percent)

    @staticmethod
    def numbers(k: int) -> tuple[int, int, int]:
        """(n1, n2, k2): parts, subparts of a part, and differences that a part may have.

        k <= 3: one part. Beyond: three subparts a part, of which one may differ, and parts enough that k differences
        leave one part with one difference at most, some to spare for parts with empty choices.
        """
        if k <= 3:
            return 1, k + 2 if k else 1, k
        return k // 2 + 1 + k // 20 + 3, 3, 1

    def prefix(self, size: int, low: int, parts: int) -> int:
        """Parts that a set of ``size`` signs in the band from ``low``; never fewer than a smaller set of the band does.

        So many that usually more than half of the most differences have no empty choice, as seen from the least set that signs there.
        """
        own = size * (100 - self.percent) // self.percent
        full = max(0.05, 1 - 3 * math.exp(-2 * low * self.percent / (300 * parts)))
        return min(parts, math.ceil((own // 2 + 1) / full) + 2)

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        size = len(elements)
        if not size:
            return np.empty(0, dtype=np.uint64)
        number, low, high = self.band(size)
        out = [self._signed(elements, number, low, high, 0)]
        _, above, top = self.band(high + 1)
        if 100 * size >= self.percent * above:
            out.append(self._signed(elements, number + 1, above, top, 0))
        return np.concatenate(out)

    def signatures_of(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """``signatures`` of each set; the sets of a band are signed together."""
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        elements, ends = np.concatenate([sets[i] for i in order]), np.cumsum(sizes)
        bands = {}  # number: least size, largest size, sets in order of size
        for size, at, n in zip(*np.unique(sizes, return_index=True, return_counts=True)):
            if not size:
                continue
            number, low, high = self.band(int(size))
            bands.setdefault(number, (low, high, []))[2].append((at, at + n))
            _, above, top = self.band(high + 1)
            if 100 * size >= self.percent * above:
                bands.setdefault(number + 1, (above, top, []))[2].append((at, at + n))
        found: list[list[np.ndarray]] = [[] for _ in sets]
        for number, (low, high, ranges) in sorted(bands.items()):
            first, last = min(a for a, _ in ranges), max(b for _, b in ranges)  # without a gap: a band is signed by a range of sizes
            n1, n2, _ = self.numbers(self.differences(high))
            step = max(1, MOST_PARTS // (n1 * n2))
            for start in range(first, last, step):
                end = min(start + step, last)
                part = elements[ends[start] - sizes[start] : ends[end - 1]]
                for i, x in zip(order[start:end], self._signed_together(part, sizes[start:end], number, low, high)):
                    found[i].append(x)
        return [np.concatenate(x) if x else np.empty(0, dtype=np.uint64) for x in found]

    def _signed_together(self, elements: np.ndarray, sizes: np.ndarray, band: int, low: int, largest: int):
        """``_signed`` of each of these sets that lie one after the other; those whose parts are too empty are signed one by one."""
        k = self.differences(largest)
        n1, n2, k2 = self.numbers(k)
        ends, n, parts = np.cumsum(sizes), len(sizes), n1 * n2
        if n1 == 1:
            yield from (self._signed(elements[end - size : end], band, low, largest, 0) for size, end in zip(sizes, ends))
            return
        h = mix(elements + np.array([0x5851F42D4C957F2D], dtype=np.uint64))
        part = np.repeat(np.arange(n) * parts, sizes) + ((h >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        sums = np.zeros(n * parts, dtype=np.uint64)
        np.add.at(sums, part, mix(h))
        count = np.bincount(part, minlength=n * parts).reshape(n, n1, n2)
        choices = _choices(n2, k2)
        content = mix(mix(sums).reshape(n, n1, n2) + np.arange(n2, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        chosen, filled = sum(content[:, :, at] for at in choices.T), np.logical_or.reduce([count[:, :, at] > 0 for at in choices.T])
        label = np.arange(n1 * len(choices), dtype=np.uint64).reshape(n1, -1)
        tag = np.array([8 * band * 0xC2B2AE3D27D4EB4F & _MASK], dtype=np.uint64)
        found = mix(chosen + label * _U(0x165667B19E3779F9) + tag)
        signs = np.array([self.prefix(int(size), low, n1) for size in sizes])
        own = np.minimum(k, sizes * (100 - self.percent) // self.percent)
        within = np.arange(n1) < signs[:, None]
        enough = (filled.all(axis=2) & within).sum(axis=1) > own // 2
        keep = filled & within[:, :, None]
        for i in range(n):
            yield found[i][keep[i]] if enough[i] else self._signed(elements[ends[i] - sizes[i] : ends[i]], band, low, largest, 0)

    def _signed(self, elements: np.ndarray, band: int, low: int, largest: int, depth: int) -> np.ndarray:
        k = self.differences(largest)
        n1, n2, k2 = self.numbers(k)
        parts = n1 * n2
        h = mix(elements + np.array([0x5851F42D4C957F2D * (depth + 1) & _MASK], dtype=np.uint64))
        part = ((h >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        count = np.bincount(part, minlength=parts)
        ends = np.cumsum(count)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(h[order]))])
        content = mix(sums[ends] - sums[ends - count]).reshape(n1, n2)
        tag = np.array([(8 * band + depth) * 0xC2B2AE3D27D4EB4F & _MASK], dtype=np.uint64)
        choices = _choices(n2, k2)
        held = count.reshape(n1, n2)[:, choices].sum(axis=2)
        chosen = mix(content[:, choices] + choices.astype(np.uint64) * _U(0x9E3779B97F4A7C15)).sum(axis=2, dtype=np.uint64)
        label = np.arange(n1 * len(choices), dtype=np.uint64)
        found = mix(chosen.ravel() + label * _U(0x165667B19E3779F9) + tag)
        if n1 > 1:
            signs = self.prefix(len(elements), low, n1)
            own = min(k, len(elements) * (100 - self.percent) // self.percent)
            if np.count_nonzero((held[:signs] > 0).all(axis=1)) > own // 2:
                keep = np.zeros(held.shape, dtype=bool)
                keep[:signs] = held[:signs] > 0
                return found[keep.ravel()]
        empty = held.ravel() == 0
        if empty.any() and depth < 2:
            again = self._signed(elements, band, low, largest, depth + 1)
            refined = mix(again[None, :] + mix(label[empty] + _U(1))[:, None] * _U(0x27D4EB2F165667C5)).ravel()
            found = np.concatenate([found[~empty], refined])
        return found


@lru_cache(maxsize=None)
def _choices(n2: int, k2: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n2), n2 - k2)))


def sketch(elements: np.ndarray) -> tuple[int, int]:
    """128 bits: for each bin of the hash's leading bits, one bit of the least hash in it (0 if none)."""
    at = np.searchsorted(elements, _BINS)
    filled = at < np.append(at[1:], len(elements))
    bits = np.zeros(128, dtype=np.uint8)
    bits[filled] = (mix(elements[at[filled]]) & _U(1)).astype(np.uint8)
    words = np.packbits(bits).view(np.int64)
    return int(words[0]), int(words[1])


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """``sketch`` of each set, as rows of two."""
    elements = np.concatenate(sets)
    bins = np.repeat(np.arange(len(sets)) * 128, [len(x) for x in sets]) + (elements >> _U(57)).astype(np.int64)
    first = np.ones(len(bins), dtype=bool)
    first[1:] = bins[1:] != bins[:-1]
    bits = np.zeros((len(sets), 128), dtype=np.uint8)
    bits.ravel()[bins[first]] = (mix(elements[first]) & _U(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def set_fingerprint(elements: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def _rolling() -> Rolling:
    return Rolling(20240801, fold_case=True)


def _document_sets(k: int, percent: int):
    """One row per document; the first of a batch with a set brings the set's signatures."""

    def run(batches):
        rolling, join = _rolling(), PartEnum(percent)
        for batch in batches:
            seen: set[int] = set()
            ids, hashes = column_of(batch, "doc_id"), column_of(batch, "text_hash")
            start, texts, held = 0, [], 0
            for at, raw in enumerate(text_bytes(column_of(batch, "text")), 1):
                texts.append(raw)
                held += len(raw or b"")
                if held < TOGETHER and at < batch.num_rows:
                    continue
                sets = shingle_sets(texts, k, rolling)
                prints = [set_fingerprint(s) if len(s) else None for s in sets]
                new = [i for i, x in enumerate(prints) if x is not None and not (x in seen or seen.add(x))]
                signs: list[bytes | None] = [None] * len(sets)
                for i, x in zip(new, join.signatures_of([sets[i] for i in new]) if new else []):
                    signs[i] = signed(x).tobytes()
                s1, s2 = sketches(sets).T
                yield batch_of(SETS, [ids.slice(start, len(texts)), hashes.slice(start, len(texts)), [len(s) for s in sets], prints, s1, s2, signs])
                start, texts, held = at, [], 0

    return run


MEMBER_ROWS = "signature long, set_id long"


def _unpacked(batches):
    """One row per signature of a set."""
    for batch in batches:
        ids = column_of(batch, "set_id").to_numpy()
        packed = [np.frombuffer(x.as_py(), dtype=np.int64) for x in column_of(batch, "signatures")]
        for start in range(0, len(packed), 2000):
            part = packed[start : start + 2000]
            yield batch_of(MEMBER_ROWS, [np.concatenate(part), np.repeat(ids[start : start + 2000], [len(x) for x in part])])


def _filter(keys: DataFrame) -> tuple[int, bytes]:
    """A filter of the hashes ``key``: its number of bits, and the bits.

    It is summed on the executors; at most MOST_BITS / 64 words reach the driver. A hash outside may pass by
    chance and is dropped by the join that follows; none of the keys is held back.
    """
    bits = min(MOST_BITS, 1 << max(16, (BITS_A_SET * keys.count()).bit_length()))
    bit = F.pmod("key", F.lit(bits))
    words = keys.select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(key, {bits}), 64) as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toPandas()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return bits, out.tobytes()


def _elements(k: int, bits: int, held: bytes):
    """Sets of the texts whose hash passes the filter; the others are not cut into words."""
    words = np.frombuffer(held, dtype=np.uint8)

    def run(batches):
        rolling = _rolling()
        for batch in batches:
            hashes, first = np.unique(column_of(batch, "text_hash").to_numpy(), return_index=True)
            bit = hashes % bits
            rows = np.sort(first[(words[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) > 0])
            texts = column_of(batch, "text").take(pa.array(rows))
            for start in range(0, len(rows), 500):
                sets = [s for s in shingle_sets(text_bytes(texts.slice(start, 500)), k, rolling) if len(s)]
                if sets:
                    yield batch_of(ELEMENTS, [[set_fingerprint(s) for s in sets], [s.tobytes() for s in sets]])

    return run


def _shared(batches):
    """Of rows sorted by signature and set: distinct rows of signatures that at least two sets have.

    A partition's first and last group may go on elsewhere and are kept as they are.
    """
    last, held = None, None  # rows of the group still open, and whether it began with the partition
    for batch in batches:
        sig, ids = column_of(batch, "signature").to_numpy(), column_of(batch, "set_id").to_numpy()
        if not len(sig):
            continue
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        if last is not None:
            new[0] = (sig[0], ids[0]) != last[:2]
        sig, ids = sig[new], ids[new]
        if not len(sig):
            continue
        first = held is None
        if held is not None:
            sig, ids = np.concatenate([held[0], sig]), np.concatenate([held[1], ids])
        last = (sig[-1], ids[-1])
        edge = np.flatnonzero(sig[1:] != sig[:-1]) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(sig)]])
        several = ends - starts > 1
        several[0] |= first or (held is not None and held[2])
        several[-1] = False  # its last row waits for the next batch
        keep = np.repeat(several, ends - starts)
        tail = starts[-1]
        keep[tail:] = False
        alone = len(starts) == 1
        if ends[-1] - tail > 1:  # known to be shared: all but the last row can go
            keep[tail : len(sig) - 1] = True
        opened = alone and (first or held[2])
        shared_before = ends[-1] - tail > 1
        held = (sig[-1:], ids[-1:], opened or shared_before)
        if keep.any():
            yield batch_of(MEMBERS, [sig[keep], ids[keep]])
    if held is not None:
        yield batch_of(MEMBERS, [held[0], held[1]])


def allowed_mismatches(percent: int) -> int:
    p = (100 - percent) / 200
    return math.ceil(128 * p + 6 * math.sqrt(128 * p * (1 - p)))


def _union(root: np.ndarray, i: int, j: int) -> None:
    a, b = root[i], root[j]
    if a != b:
        root[root == max(a, b)] = min(a, b)


def _tiles(names: tuple[str, ...], work):
    """Streams rows sorted by (group, tile) and calls ``work`` on the columns of each tile."""

    def run(batches):
        key, held = None, []

        def done():
            cols = [[x for h in held for x in h[i]] if isinstance(held[0][i], list) else np.concatenate([h[i] for h in held]) for i in range(len(names))]
            return work(*cols)

        out, waiting = [], 0
        for batch in batches:
            keys = list(zip(column_of(batch, "group").to_pylist(), column_of(batch, "tile").to_pylist()))
            values = [column_of(batch, c).to_pylist() if c == "elements" else column_of(batch, c).to_numpy() for c in names]
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                if keys[start] != key:
                    if held:
                        out.append(done())
                        waiting += len(out[-1][0])
                    key, held = keys[start], []
                held.append([v[start:end] for v in values])
                start = end
            if waiting > 100_000:
                yield batch_of(EDGES, [np.concatenate(c) for c in zip(*out)])
                out, waiting = [], 0
        if held:
            out.append(done())
        if out:
            yield batch_of(EDGES, [np.concatenate(c) for c in zip(*out)])

    return run


def _near(i, rest, sizes, s1, s2, percent, most):
    low, high = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
    # Unsigned: of a negative number numpy counts the bits of its absolute value.
    apart = sum(np.bitwise_count((s[rest] ^ s[i]).view(np.uint64)).astype(np.int64) for s in (s1, s2))
    return rest[(apart <= most) & (100 * low >= percent * high)]


def _roots(ids, root):
    some = root != np.arange(len(ids))
    return ids[some], ids[root[some]]


def _across(i, side):
    """Rows that row i of a tile meets: later ones, and of a tile of two sides only the other side's."""
    rest = np.arange(i + 1, len(side))
    return rest if side[i] == 2 else rest[side[rest] != side[i]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that join what the edges (a, b) join."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root != (above := root[root])).any():
            root = above
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return _roots(nodes, root)


def _pairs(ids, sizes, s1, s2, side, behind, percent, most):
    """Pairs with close sketches of rows in the same tile, each row with the first, then the second behind it and so on.

    ``behind`` tells how many rows of its tile follow a row.
    """
    offset, i = 1, np.flatnonzero(behind > 0)
    while len(i):
        j = i + offset
        low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        apart = sum(np.bitwise_count((s[i] ^ s[j]).view(np.uint64)).astype(np.int64) for s in (s1, s2))
        near = (apart <= most) & (100 * low >= percent * high) & ((side[i] == 2) | (side[i] != side[j]))
        yield ids[i[near]], ids[j[near]]
        offset += 1
        i = i[behind[i] >= offset]


def _families(percent: int):
    """(set, family root) of sets whose sketches are close, in each tile; pairs of a task's tiles are one forest, so nothing is sent twice for a set.

    Small tiles are compared many at a time, larger ones row by row.
    """
    most = allowed_mismatches(percent)
    names = ("group", "tile", "set_id", "n", "s1", "s2", "side")

    def whole(ids, sizes, s1, s2, side):
        root = np.arange(len(ids))
        for i in range(len(ids) - 1):
            rest = _across(i, side)
            rest = rest[root[rest] != root[i]]
            for label in np.unique(root[_near(i, rest, sizes, s1, s2, percent, most)]):
                _union(root, i, label)
        return _roots(ids, root)

    def close(cols, starts, ends):
        rows = ends - starts
        for start, end in zip(starts[rows > SMALL_TILE], ends[rows > SMALL_TILE]):
            yield whole(*(x[start:end] for x in cols))
        small = np.repeat(rows <= SMALL_TILE, rows)
        behind = (np.repeat(ends, rows) - np.arange(len(small)) - 1)[small]
        yield from _pairs(*(x[small] for x in cols), behind, percent, most)

    def run(batches):
        held, found, waiting = [np.empty(0, dtype=np.int64)] * len(names), [], 0
        for batch in itertools.chain(batches, [None]):
            cols = held if batch is None else [np.concatenate([h, column_of(batch, x).to_numpy()]) for h, x in zip(held, names)]
            if not len(cols[0]):
                continue
            starts = np.concatenate([[0], np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1])
            ends = np.append(starts[1:], len(cols[0]))
            if batch is not None:  # the last tile may go on
                held, starts, ends = [x[starts[-1] :] for x in cols], starts[:-1], ends[:-1]
            if not len(starts):
                continue
            for pair in close([x[: ends[-1]] for x in cols[2:]], starts, ends):
                found.append(pair)
                waiting += len(pair[0])
                if waiting > MOST_PAIRS:
                    found = [forest(*(np.concatenate(x) for x in zip(*found)))]
                    waiting = len(found[0][0])
                    if 2 * waiting > MOST_PAIRS:
                        yield batch_of(EDGES, list(found[0]))
                        found, waiting = [], 0
        if waiting:
            yield batch_of(EDGES, list(forest(*(np.concatenate(x) for x in zip(*found)))))

    return run


def _linked(percent: int):
    """(set, component root) of sets that reach the similarity, in each tile, by exact counts."""
    most = allowed_mismatches(percent)

    def work(ids, sizes, s1, s2, side, elements):
        root = np.arange(len(ids))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in elements]
        for i in range(len(ids) - 1):
            rest = _across(i, side)
            rest = rest[root[rest] != root[i]]
            rest = _near(i, rest, sizes, s1, s2, percent, most) if len(rest) else rest
            while len(rest):
                j, rest = rest[0], rest[1:]
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    _union(root, i, j)
                    rest = rest[root[rest] != root[i]]
        return _roots(ids, root)

    return _tiles(("set_id", "n", "s1", "s2", "side", "elements"), work)


def _tiled(rows: DataFrame, size: int) -> DataFrame:
    """Rows of ``group`` dealt to tiles of about ``size`` by a hash, each tile with itself and with every other of its group."""
    counts = rows.groupBy("group").agg(F.count("*").alias("m")).where("m > 1").withColumn("tiles", F.expr(f"cast((m - 1) div {size} as int) + 1")).drop("m")
    placed = rows.join(counts, "group").withColumn("t", F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("u", F.explode(F.expr("sequence(0, tiles - 1)")))
    tile = F.least("t", "u").cast("long") * F.col("tiles") + F.greatest("t", "u")
    side = F.when(F.col("t") == F.col("u"), 2).otherwise(F.when(F.col("t") < F.col("u"), 0).otherwise(1))
    return placed.withColumns({"tile": tile, "side": side}).drop("t", "u", "tiles")


def linked_documents(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, group_id, component_id) of each row.

    component_id is the smallest doc_id reachable by links, group_id a set of the component: equal for linked rows, null without words.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "jaccard")
    signed_sets = scratch.keep(arrow_map(docs, _document_sets(k, percent), SETS), "sets")
    sets = signed_sets.drop("signatures")
    signatures = arrow_map(signed_sets.where("signatures is not null").select("set_id", "signatures"), _unpacked, MEMBER_ROWS)
    ordered = signatures.repartitionByRange("signature", "set_id").sortWithinPartitions("signature", "set_id")
    shared = scratch.keep(arrow_map(ordered, _shared, MEMBERS), "shared")
    of_set = sets.where("set_id is not null").dropDuplicates(["set_id"]).select("set_id", F.col("n_shingles").alias("n"), "s1", "s2")
    members = shared.withColumnRenamed("signature", "group").join(of_set, "set_id")
    tiles = _tiled(scratch.keep(members, "members"), TILE).repartition("group", "tile").sortWithinPartitions("group", "tile", "set_id")
    families = connected_components(scratch, arrow_map(tiles, _families(percent), EDGES), "families")
    families = scratch.keep(families.select(F.col("node").alias("set_id"), F.col("component").alias("group")).join(of_set, "set_id"), "families")
    scratch.drop("shared", "members")

    # The sets themselves, only of families, from a second reading of the texts; others do not travel.
    # Of the texts with one set one is enough.
    holders = sets.join(families.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.min("text_hash").alias("key"))
    elements = arrow_map(docs.select("text_hash", "text"), _elements(k, *_filter(scratch.keep(holders, "holders"))), ELEMENTS).join(families.select("set_id"), "set_id", "left_semi")
    elements = scratch.keep(elements.dropDuplicates(["set_id"]), "elements")
    tiles = _tiled(families, FAMILY_TILE).join(elements, "set_id").repartition("group", "tile").sortWithinPartitions("group", "tile", "set_id")
    parts = connected_components(scratch, arrow_map(tiles, _linked(percent), EDGES), "components")
    scratch.drop("elements", "holders")

    of_set = sets.where("set_id is not null").join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    component_of = of_set.groupBy("set_id").agg(F.first("component").alias("group_id")).join(smallest.withColumnRenamed("component", "group_id"), "group_id").select("set_id", "group_id", "component_id")
    return sets.join(component_of, "set_id", "left").select("doc_id", "text_hash", "n_shingles", "set_id", "group_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group, all columns unchanged; rows without words stay.

    It is the one with the smallest id, null ids last, of these the one with the smallest hash of its text; of rows that
    have both in common any one.
    """
    scratch = Scratch(docs.sparkSession, "groups")
    rows = scratch.keep(linked_documents(docs, k, percent, id_col, text_col).where("group_id is not null").groupBy("group_id", "doc_id", "text_hash").agg(F.count("*").alias("n")), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_hash"))
    kept = rows.groupBy("group_id").agg(F.min(key).alias("kept"))
    judged = rows.join(kept, "group_id").withColumn("stays", key.eqNullSafe(F.col("kept")))
    gone = judged.where("not stays or n > 1").select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"))
    several = judged.where("stays and n > 1").select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"))

    def of(side: DataFrame):
        return docs[id_col].cast("long").eqNullSafe(side["g_id"]) & (F.xxhash64(docs[text_col]) == side["g_hash"])

    out = docs.join(gone, of(gone), "left_anti")
    if several.isEmpty():
        return out
    repeated = packed(docs.join(several, of(several), "left_semi"), key=F.struct(F.col(id_col), F.xxhash64(text_col)))
    return out.unionByName(repeated.dropDuplicates(["key"]).select("row.*"))


def jaccard_digest(docs: DataFrame) -> DataFrame:
    """Contract columns per document."""
    return linked_documents(docs).select("doc_id", "n_shingles", "component_id")
