"""Periodic runs of words: maximal stretches that repeat themselves, found over a suffix tree (Stoye and Gusfield).

A document's words become numbers. Its suffix tree is held as the sorted suffixes, the longest common prefixes of
neighbours and the binary splits of its inner nodes. At each split the leaves of the smaller half are listed: leaf i at
depth D with leaf i + D (or i - D) in the other half is a branching tandem repeat, two equal halves of D words that end where
the period breaks. Listing smaller halves alone costs n log n. Each branching repeat is rotated to the left as far as the
period holds, which gives a maximal run; repeats of a multiple of a period end in the same run and are merged into the smallest.

Only words that a run can hold enter a tree: in a run of at least ``least`` words and ``exponent`` periods every k-gram
recurs one period before or after (k from the two parameters, 5 for 6 words and 4 periods), so the text is cut
where a k-gram occurs once, and no run crosses a cut or is changed by it. Words are compared whole, not by hash.

Each document is judged alone, so nothing is shuffled; a task holds one batch of texts and one document's tree.

Defined results: a null or empty text has no words and no run; repeated rows and rows with equal ids are judged one by one;
a null id is an id like any other (in the digest, whose planting rests on the id, it plants nothing); a text of any length is
judged whole; extra columns pass through ``collapse_runs`` whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, column_of, packed, text_bytes

LEAST, EXPONENT = 6, 4
#: Leaves listed at once.
LISTED = 1 << 20

# ---------------------------------------------------------------- the tree of one stretch of words


def power_classes(s: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ..: a number for the 2**k words from each place, equal for equal words and rising with their order.

    What reaches over the end equals nothing else. The last has no two alike. Place n, behind the end, holds -1.
    """
    n, out = len(s), []
    ranks = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        out.append(np.append(ranks, -1))
        if n == 0 or ranks.max() == n - 1:
            return out
        behind = np.zeros(n, dtype=np.int64)
        size = 1 << (len(out) - 1)
        if size < n:
            behind[: n - size] = ranks[size:] + 1
        ranks = np.unique(ranks * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)


def common_prefixes(classes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from places a and b (a <> b) are the same."""
    same = np.zeros(len(a), dtype=np.int64)
    for k in range(len(classes) - 1, -1, -1):
        same += (classes[k][a + same] == classes[k][b + same]).astype(np.int64) << k
    return same


def rotations(classes: list[np.ndarray], start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How often a repeat of ``period`` at ``start`` can be rotated to the left: equal words before both its halves."""
    back = np.zeros(len(start), dtype=np.int64)
    for k in range(len(classes) - 1, -1, -1):
        place = start - back - (1 << k)
        at = np.maximum(place, 0)
        back += ((place >= 0) & (classes[k][at] == classes[k][at + period])).astype(np.int64) << k
    return back


def splits(prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place i between two neighbouring suffixes: where the left part of its node begins and the right part ends.

    The left part reaches to the last smaller prefix, the right part to the next that is not greater: a node with many
    children is split from left to right, and any two leaves are parted at exactly one place, at the depth of their node.
    """
    n = len(prefixes)
    left, right = [0] * n, [n] * n
    values, open_ = prefixes.tolist(), []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] >= v:
            right[open_.pop()] = i
        left[i] = open_[-1] if open_ else 0
        open_.append(i)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def branching_repeats(classes: list[np.ndarray], exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching tandem repeats whose period fits ``exponent`` times into the words."""
    rank = classes[-1][:-1]
    n = len(rank)
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    depth = np.zeros(n, dtype=np.int64)  # of the place before each suffix
    depth[1:] = common_prefixes(classes, order[:-1], order[1:])
    left, right = splits(depth)
    nodes = np.flatnonzero((depth > 0) & (depth * exponent <= n))
    smaller_left = nodes - left[nodes] <= right[nodes] - nodes
    first = np.where(smaller_left, left[nodes], nodes)
    size = np.where(smaller_left, nodes, right[nodes]) - first
    other_first = np.where(smaller_left, nodes, left[nodes])
    other_end = np.where(smaller_left, right[nodes], nodes)
    total = np.cumsum(size)
    found = []
    at = 0
    while at < len(nodes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LISTED, side="right")))
        many = size[at:end]
        node = np.repeat(np.arange(at, end), many)
        step = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many)
        place, period = order[first[node] + step], depth[nodes[node]]
        for other in (place + period, place - period):
            inside = (other >= 0) & (other < n)
            r = rank[np.where(inside, other, 0)]
            hit = inside & (r >= other_first[node]) & (r < other_end[node])
            found.append((np.minimum(place, other)[hit], period[hit]))
        at = end
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _runs_of_stretch(s: np.ndarray, least: int, exponent: int) -> np.ndarray:
    classes = power_classes(s)
    start, period = branching_repeats(classes, exponent)
    end = start + 2 * period
    start = start - rotations(classes, start, period)
    long = end - start >= np.maximum(least, exponent * period)
    runs = np.stack([start[long], end[long] - start[long], period[long]], axis=1)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # of one stretch the smallest period
    return runs[new]


# ---------------------------------------------------------------- one document


def telling_gram(least: int, exponent: int) -> int:
    """The longest k for which every k-gram of a run recurs one period away: no run is shorter than 2 * period + k - 1."""
    return max(1, min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 1)))


def repetitive_stretches(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches of words all of whose k-grams occur more than once; a chance collision only makes one longer."""
    n = len(ids) - k + 1
    if n < 1:
        return []
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64)
    _, place, many = np.unique(grams, return_inverse=True, return_counts=True)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = many[place] > 1
    edge = np.diff(inside)
    return [(int(a), int(b) + k - 1) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same word."""
    known: dict[bytes, int] = {}
    return np.fromiter(map(known.setdefault, words, itertools.count()), dtype=np.int64, count=len(words))


def runs_of(ids: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs, by start, then period."""
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    found = [np.empty((0, 3), dtype=np.int64)]
    for a, b in repetitive_stretches(ids, telling_gram(least, exponent)):
        if b - a >= least:
            found.append(_runs_of_stretch(ids[a:b], least, exponent) + [a, 0, 0])
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The kept words, joined by one space."""
    return b" ".join(itertools.compress(words, kept_words(len(words), runs).tolist()) if len(runs) else words)


# ---------------------------------------------------------------- operators


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(doc, start, length, period) of every run of every text, places and lengths in words."""
    schema = "doc long, start long, length long, period long"

    def found(batches):
        for batch in batches:
            ids, runs = [], [np.empty((0, 3), dtype=np.int64)]
            for doc, raw in zip(column_of(batch, "doc").to_pylist(), text_bytes(column_of(batch, "text"))):
                runs.append(runs_of(word_numbers((raw or b"").split()), least, exponent))
                ids += [doc] * len(runs[-1])
            every = np.concatenate(runs)
            yield batch_of(schema, [ids, *(np.ascontiguousarray(every[:, j]) for j in range(3))])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), found, schema)


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with each run cut to its first period; texts without a run stay as they are, null stays null."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            words = text.encode().split()
            runs = runs_of(word_numbers(words), least, exponent)
            return collapsed(words, runs).decode() if len(runs) else text

        return texts.map(one, na_action=None)

    rows = packed(docs).withColumn("kept", apply(F.col("row")[text_col]))
    return rows.select(*[(F.col("kept") if name == text_col else F.col("row")[name]).alias(name) for name in docs.columns])


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the digest judges them: every tenth document, by the checksum of its id, repeats itself from some word on."""
    h, n = (zlib.crc32(str(doc).encode()) if doc is not None else 1), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(itertools.islice(itertools.cycle(words[a : a + p]), n - a))


_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(batches):
    for batch in batches:
        rows = []
        for doc, raw in zip(column_of(batch, "doc_id").to_pylist(), text_bytes(column_of(batch, "text"))):
            words = planted(doc, (raw or b"").split())
            runs = runs_of(word_numbers(words))
            told = runs.tolist()
            best = min(told, key=lambda r: (-r[1], r[0], r[2]), default=None)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in told)
            rows.append((doc, len(told), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()))
        if rows:
            yield batch_of(_DIGEST, list(zip(*rows)))


def runs_digest(docs: DataFrame) -> DataFrame:
    """Contract columns per document: number of runs, the longest, digests of all runs and of the text without repetition."""
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _digests, _DIGEST)
