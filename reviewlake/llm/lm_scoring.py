"""LM scoring by masked pseudo-likelihood of a bidirectional window network, trained in numpy.

Every word is predicted from the two words on its left and the two on its right. The vocabulary is
counted over the whole corpus: of N words in all, those that occur at least max(50, sqrt(N) / 20) times,
so it grows with the corpus, slower than it. The network (an embedding of every word of it, a matrix for each place in
the window, a tanh layer) gives p(word | both sides) by a hierarchical softmax over the words' Huffman tree; its
start is the unigram model. Rarer words share one leaf, and what they are is the probability of
their spelling under a byte trigram model counted over all of them. A document's score is the sum
of the log-probabilities of all its words.

Texts are read twice: to count words, and to turn them into places in the vocabulary, a table that training and
scoring read. Training covers every word of the corpus: each task runs one pass of mini-batch gradient steps over
its rows from one common start. A task sends every row of weights that it took steps on, and a row's mean over all these
tasks is weighted by the steps: none is left out. What travels is at most the vocabulary times the tasks.
The mean depends on how rows are dealt to tasks; with one task it is the plain network.

Words are told apart by 64-bit hashes, A-Z equal to a-z. Defined results: null or empty texts have
no words, score 0 and a null mean; repeated rows are scored each; null ids are kept; other columns
are ignored; an empty table stays empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, arrow_map, batch_of, column_of, mix, segments, signed, text_bytes, word_spans

LEAST = 50
WIDTH = 16
REACH = 2
SIDES = [j for j in range(2 * REACH + 1) if j != REACH]
STEP = 1.0
BATCH = 4096
#: Tree nodes with the most words below them, computed for all words of a batch at once; below them, as many of each subtree.
HEAVY = 32
SCORED = 4096
#: Words of texts that are held before they are scored.
SETTLED = 1 << 16
#: A row seen less often in a batch takes a step of its share of this many.
GENTLE = 4
#: Keys held before they are counted, and rows of weights in one message.
HELD = 1 << 20
#: Words of a task that are counted at once.
COUNTED = 1 << 22
#: Bytes of short texts that are split and hashed at once.
JOINED = 1 << 17
BLOCK = 64
EDGE = 256
PRIOR = 5.0
COUNTS = "key long, n long"
WORDS = "key long, n long, word binary"
PLACED = "doc_id long, n_words long, spelt double, places binary"
PARAMETERS = "block long, rows binary, n binary, weights binary"
SCORES = "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double"


def _rolling() -> Rolling:
    return Rolling(515, fold_case=True)


def words_of(texts: list[bytes], rolling: Rolling):
    """(bytes, starts, ends, hashes, number of the text) of the words of each segment of these texts, which a line end parts."""
    begin, offset = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])]), 0
    for piece in segments(b"\n".join(texts)):
        data = np.frombuffer(piece, dtype=np.uint8)
        starts, ends = word_spans(data)
        if len(starts):
            yield data, starts, ends, rolling.words(data, starts, ends), np.searchsorted(begin, starts + offset, side="right") - 1
        offset += len(piece)


def joined(texts):
    """Runs of texts of at most ``JOINED`` bytes, or of one longer text; null is an empty text."""
    held, size = [], 0
    for raw in texts:
        raw = raw or b""
        if held and size + len(raw) > JOINED:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield held


def spellings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbol: np.ndarray | None = None, size: int = EDGE + 1) -> np.ndarray:
    """Byte trigrams of the words at these spans, with their ends, A-Z as a-z; of the bytes' symbols, ``size`` in all, if these are given."""
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    spelt = np.arange(EDGE + 1) if symbol is None else symbol
    low = np.arange(EDGE)
    low[65:91] += 32
    at = np.arange(sizes.sum()) + np.repeat(starts - first, sizes)
    c = spelt[low][np.append(data, np.uint8(0))[at]]
    c[first + sizes - 1] = spelt[EDGE]
    # Before a word's first byte stands the end of the word before it, and once more an end.
    b = np.empty_like(c)
    b[:1], b[1:] = spelt[EDGE], c[:-1]
    a = np.empty_like(c)
    a[1:] = b[:-1]
    a[first] = spelt[EDGE]
    return (a * size + b) * size + c


def least_count(total: int) -> int:
    """Occurrences from which a word is in the vocabulary of a corpus of ``total`` words; at most 20 sqrt(total) words are."""
    return max(LEAST, math.isqrt(total) // 20)


def _count_words(batches):
    """Distinct words of a bounded run of texts, with their counts and bytes."""
    rolling = _rolling()
    held, size = [], 0

    def counted():
        key, first, n = np.unique(np.concatenate([h for _, _, _, h in held]), return_index=True, return_counts=True)
        base = np.cumsum([0, *(len(d) for d, *_ in held)])
        starts = np.concatenate([a + o for (_, a, _, _), o in zip(held, base)])[first].tolist()
        ends = np.concatenate([z + o for (_, _, z, _), o in zip(held, base)])[first].tolist()
        whole = b"".join(d.tobytes() for d, *_ in held)
        return batch_of(WORDS, [signed(key), n, [whole[a:z].lower() for a, z in zip(starts, ends)]])

    for batch in batches:
        for texts in joined(text_bytes(column_of(batch, "text"))):
            for *found, _ in words_of(texts, rolling):
                held.append(found)
                size += len(found[3])
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
    if held:
        yield counted()


def _count_spellings(batches):
    """Trigrams of words, each as often as the word occurs."""
    for batch in batches:
        words, n = [x.as_py() for x in column_of(batch, "word")], column_of(batch, "n").to_numpy()
        if len(words):
            sizes = np.array([len(w) for w in words])
            ends = np.cumsum(sizes)
            key = spellings(np.frombuffer(b"".join(words), dtype=np.uint8), ends - sizes, ends)
            key, which = np.unique(key, return_inverse=True)
            yield batch_of(COUNTS, [key, np.bincount(which, weights=np.repeat(n, sizes + 1)).astype(np.int64)])


def places_of(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted vocabulary; words outside it get its length."""
    if not len(words):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, len(words))


@dataclass
class Counts:
    words: np.ndarray  # sorted hashes of the vocabulary
    n: np.ndarray  # occurrences of each, then of all rarer words together
    trigrams: np.ndarray  # sorted byte trigrams of the rarer words
    n_trigrams: np.ndarray


def slot_counts(docs: DataFrame) -> Counts:
    """The vocabulary with its counts, and the trigrams of all other words, over the whole corpus."""
    scratch = Scratch(docs.sparkSession, "words")
    every = arrow_map(docs.select("text"), _count_words, WORDS).groupBy("key").agg(F.sum("n").alias("n"), F.min("word").alias("word"))
    every = scratch.keep(every, "words")
    total = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    inside = every.where(F.col("n") >= least_count(total)).select("key", "n").toPandas()
    words = inside["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    n = np.append(inside["n"].to_numpy(dtype=np.int64)[order], total - int(inside["n"].sum()))
    spelt = arrow_map(every.where(F.col("n") < least_count(total)).select("n", "word"), _count_spellings, COUNTS).groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    scratch.drop("words")
    return Counts(words[order], n, spelt["key"].to_numpy(dtype=np.int64), spelt["n"].to_numpy(dtype=np.int64))


@dataclass
class Tree:
    """Huffman tree of the vocabulary and of the leaf of all rarer words: the nodes above each leaf, root last."""

    words: np.ndarray
    start: np.ndarray  # of each leaf's path in node and right, heavy nodes left out
    deep: np.ndarray  # where in it the nodes begin that are in no crown
    node: np.ndarray
    right: np.ndarray  # whether the path goes right there
    bias: np.ndarray  # of each node: the log odds of right by the counts
    heavy: np.ndarray  # numbers of the heaviest nodes
    turn: np.ndarray  # leaves x heavy nodes: 1 right, -1 left, 0 not on the path
    crowns: np.ndarray  # subtrees below the heavy nodes x numbers of the heaviest nodes of each, -1 where there are fewer
    subtree: np.ndarray  # of each leaf; their number where a heavy node is right above it
    crown_turn: np.ndarray  # leaves x nodes of its subtree's crown, as turn


def slot_classes(counts: Counts) -> Tree:
    weight = np.maximum(counts.n, 1)
    leaves = len(weight)
    order = np.argsort(weight, kind="stable")
    total, parent, right = [int(x) for x in weight[order]], [0] * (2 * leaves - 1), np.zeros(2 * leaves - 1, dtype=bool)
    bias, leaf, inner = np.zeros(leaves - 1), 0, leaves
    for made in range(leaves, 2 * leaves - 1):  # leaves in order and inner nodes in order are both sorted by weight
        pair = []
        for _ in range(2):
            if leaf < leaves and (inner >= made or total[leaf] <= total[inner]):
                pair.append(leaf)
                leaf += 1
            else:
                pair.append(inner)
                inner += 1
        total.append(total[pair[0]] + total[pair[1]])
        parent[pair[0]] = parent[pair[1]] = made
        right[pair[1]] = True
        bias[made - leaves] = np.log(total[pair[1]] / total[pair[0]])
    parent, root = np.array(parent), 2 * leaves - 2
    at, who, paths = np.arange(leaves), order, []
    while (up := at != root).any():
        at, who = at[up], who[up]
        paths.append((who, parent[at] - leaves, right[at]))
        at = parent[at]
    who, node, turn = (np.concatenate(x) for x in zip(*paths)) if paths else (np.empty(0, dtype=np.int64),) * 3
    nodes = np.array(total[leaves:], dtype=np.int64)
    heavy = np.sort(np.argsort(-nodes, kind="stable")[:HEAVY])
    place = np.full(len(nodes), -1)
    place[heavy] = np.arange(len(heavy))
    turns, top = np.zeros((leaves, len(heavy)), dtype=np.int8), place[node] >= 0
    turns[who[top], place[node[top]]] = np.where(turn[top], 1, -1)
    who, node, turn = who[~top], node[~top], turn[~top]
    # A parent has a higher number than its children, and more words, so heavy nodes and crowns hold all nodes above their own.
    above = parent[leaves:] - leaves
    root_of = np.full(len(nodes), -1)
    for v in range(len(nodes) - 2, -1, -1):
        if place[v] < 0:
            root_of[v] = v if place[above[v]] >= 0 else root_of[above[v]]
    roots = np.unique(root_of[place < 0])
    crowns, within = np.full((len(roots), HEAVY), -1), np.full(len(nodes), -1)
    by_weight = np.lexsort((-nodes, root_of))
    first = np.searchsorted(root_of[by_weight], np.append(roots, len(nodes)))
    for i, (a, z) in enumerate(zip(first, first[1:])):
        inside = by_weight[a : min(z, a + HEAVY)]
        crowns[i, : len(inside)] = inside
        within[inside] = np.arange(len(inside))
    subtree = np.full(leaves, len(roots), dtype=np.uint16)
    if len(nodes):
        over = parent[:leaves] - leaves
        subtree[order] = np.where(place[over] < 0, np.searchsorted(roots, root_of[over]), len(roots))
    crown_turn, crowned = np.zeros((leaves, HEAVY), dtype=np.int8), within[node] >= 0
    crown_turn[who[crowned], within[node[crowned]]] = np.where(turn[crowned], 1, -1)
    by_leaf = np.lexsort((~crowned, who))
    start = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=leaves))])
    deep = start[:-1] + np.bincount(who[crowned], minlength=leaves)
    return Tree(counts.words, start, deep, node[by_leaf].astype(np.int32), turn[by_leaf].astype(bool), bias.astype(np.float32), heavy, turns, crowns, subtree, crown_turn)


def _order(rows: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative numbers, 16 bits at a time: numpy sorts those by radix."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    high = rows >> 16
    return order if not high.any() else order[np.argsort(high[order].astype(np.uint16), kind="stable")]


def _added(which: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each of n groups; a row's group is ``which``."""
    width = values.shape[1]
    return np.bincount((which[:, None] * width + np.arange(width)).ravel(), weights=values.ravel(), minlength=n * width).reshape(n, width)


def _sums(rows: np.ndarray, values: np.ndarray, uses: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sum of their values, and how many there are of each, or the sum of their uses."""
    order = _order(rows)
    ordered = rows[order]
    new = np.diff(ordered, prepend=-1) != 0
    which = np.empty(len(rows), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    found = ordered[new]
    return found, _added(which, values, len(found)), np.bincount(which, weights=uses).astype(np.int64)


def _errors(z: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p(right) less whether the path goes right at each node on it, 0 off it; and which those on it are."""
    on = np.flatnonzero(turn != 0)
    g = np.zeros(z.shape, dtype=np.float32)
    g.reshape(-1)[on] = 1 / (1 + np.exp(-np.clip(z.reshape(-1)[on], -30, 30))) - (turn.reshape(-1)[on] > 0)
    return g, on


def _losses(z: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """-log p of each row's turns at the nodes on its path."""
    on = np.flatnonzero(turn != 0)
    lost = np.log(1 + np.exp(np.minimum(z.reshape(-1)[on] * -turn.reshape(-1)[on], 80)))
    return np.bincount(on // z.shape[1], weights=lost, minlength=len(z))


class Network:
    """All weights in one table: embeddings (of words, of all rarer ones, of text ends), tree nodes, matrices, bias."""

    def __init__(self, tree: Tree, weights: np.ndarray | None = None):
        self.tree = tree
        inputs, nodes = len(tree.words) + 2, len(tree.bias)
        if weights is None:
            weights = np.zeros((inputs + nodes + 2 * REACH * WIDTH + 1, WIDTH + 1), dtype=np.float32)
            # A word's first embedding hangs on the word alone.
            names = np.append(tree.words, np.array([1, 2], dtype=np.uint64))
            for j in range(WIDTH):
                draw = mix(names * np.uint64(2 * WIDTH + 1) + np.uint64(j)) >> np.uint64(40)
                weights[:inputs, j] = (draw.astype(np.float64) / (1 << 24) - 0.5) * 1.7
            weights[inputs : inputs + nodes, WIDTH] = tree.bias
            rng = np.random.Generator(np.random.PCG64(9))
            for j in range(2 * REACH):
                at = inputs + nodes + j * WIDTH
                weights[at : at + WIDTH, :WIDTH] = np.linalg.qr(rng.standard_normal((WIDTH, WIDTH)))[0]
        self.weights = weights
        self.times = np.zeros(len(weights), dtype=np.int64)
        self.embedding, self.nodes = weights[:inputs], weights[inputs : inputs + nodes]
        self.matrices = weights[inputs + nodes : -1, :WIDTH].reshape(2 * REACH, WIDTH, WIDTH)
        self.bias = weights[-1, :WIDTH]
        self.first_node = inputs

    def hidden(self, stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of a stream of words, and the tanh layer of the words at these places of it with a constant 1 beside it."""
        read = self.embedding.take(stream, axis=0)[:, :WIDTH]
        windows = len(stream) - 2 * REACH
        z = np.tile(self.bias, (windows, 1))
        for side, m in zip(SIDES, self.matrices):
            z += read[side : side + windows] @ m
        h = np.ones((len(at), WIDTH + 1), dtype=np.float32)
        np.tanh(z.take(at - REACH, axis=0), out=h[:, :WIDTH])
        return read, h

    def turns(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, node, right) of every turn on the paths to the targets at nodes that are neither heavy nor in a crown."""
        first = self.tree.deep[target]
        sizes = self.tree.start[target + 1] - first
        word = np.repeat(np.arange(len(target)), sizes)
        at = np.arange(len(word)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        return word, self.tree.node[at], self.tree.right[at]

    def by_subtree(self, stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Order of the words at these places by the subtree that their leaf is in, and (subtree, first, end) of those that have any."""
        subtree = self.tree.subtree[stream[at]]
        ends = np.cumsum(np.bincount(subtree, minlength=len(self.tree.crowns)))[: len(self.tree.crowns)].tolist()
        return np.argsort(subtree, kind="stable"), [(i, a, z) for i, (a, z) in enumerate(zip([0, *ends], ends)) if z > a]

    def lost(self, stream: np.ndarray, at: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Sum of the log-probabilities of the words at these places of a stream for each text; ``text`` is the number of each word's text."""
        if not len(self.nodes):
            return np.zeros(texts)
        order, groups = self.by_subtree(stream, at)
        at, text = at[order], text[order]
        target = stream[at]
        h = self.hidden(stream, at)[1]
        out = _losses(h @ self.nodes[self.tree.heavy].T, self.tree.turn.take(target, axis=0))
        crowned = groups[-1][2] if groups else 0
        z = np.empty((crowned, HEAVY), dtype=np.float32)
        for i, first, end in groups:
            np.matmul(h[first:end], self.nodes[self.tree.crowns[i]].T, out=z[first:end])
        out[:crowned] += _losses(z, self.tree.crown_turn.take(target[:crowned], axis=0))
        word, node, right = self.turns(target)
        z = np.einsum("ij,ij->i", h.take(word, axis=0), self.nodes.take(node, axis=0))
        deep = np.log(1 + np.exp(np.minimum(np.where(right, -z, z), 80)))
        return -np.bincount(text, weights=out, minlength=texts) - np.bincount(text.take(word), weights=deep, minlength=texts)

    def log_likelihoods(self, context: np.ndarray, target: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """The same for words in these contexts (as ``contexts`` gives them), which need not follow one another."""
        stream = np.insert(context, REACH, target, axis=1).ravel()
        return self.lost(stream, np.arange(len(target)) * (2 * REACH + 1) + REACH, text, texts)

    def learn(self, stream: np.ndarray, at: np.ndarray, step: float = STEP) -> None:
        """One step on the words at these places of a stream, each with what is around it there."""
        if not len(self.nodes):
            return
        n, heavy, crowns = len(at), self.tree.heavy, self.tree.crowns
        order, groups = self.by_subtree(stream, at)
        at = at[order]
        target = stream[at]
        read, h = self.hidden(stream, at)
        # Heavy nodes for all words at once; off the path the error is 0.
        top = self.nodes[heavy]
        g, on = _errors(h @ top.T, self.tree.turn.take(target, axis=0))
        back = g @ top[:, :WIDTH]
        steps = [(heavy, g.T @ h, np.bincount(on % len(heavy), minlength=len(heavy)))]
        # The crown of each subtree for the words in it.
        if groups:
            crowned = groups[-1][2]
            top, total, z = self.nodes[crowns], np.zeros((*crowns.shape, WIDTH + 1), dtype=np.float32), np.empty((crowned, HEAVY), dtype=np.float32)
            for i, first, end in groups:
                np.matmul(h[first:end], top[i].T, out=z[first:end])
            g, on = _errors(z, self.tree.crown_turn.take(target[:crowned], axis=0))
            for i, first, end in groups:
                back[first:end] += g[first:end] @ top[i, :, :WIDTH]
                np.matmul(g[first:end].T, h[first:end], out=total[i])
            times = np.bincount(self.tree.subtree[target[on // HEAVY]].astype(np.int64) * HEAVY + on % HEAVY, minlength=crowns.size)
            used = np.flatnonzero(times)
            steps.append((crowns.ravel()[used], total.reshape(-1, WIDTH + 1)[used], times[used]))
        # The rest of each path, turn by turn.
        word, node, right = self.turns(target)
        if len(word):
            ours, theirs = h.take(word, axis=0), self.nodes.take(node, axis=0)
            z = np.einsum("ij,ij->i", ours, theirs)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - right).astype(np.float32)[:, None]
            theirs *= g
            ours *= g
            back += _added(word, theirs[:, :WIDTH], n)
            steps.append(_sums(node, ours))
        rows, total, times = (np.concatenate(x) for x in zip(*steps))
        self.nodes[rows] = self.nodes.take(rows, axis=0) - step * total / np.maximum(times, GENTLE)[:, None]
        self.times[self.first_node + rows] += times
        back *= 1 - h[:, :WIDTH] ** 2
        # Each word of the stream is read once, and takes what comes back from all windows that it is in.
        windows = len(stream) - 2 * REACH
        backs, centres = np.zeros((windows, WIDTH), dtype=np.float32), np.zeros(windows, dtype=np.int64)
        backs[at - REACH], centres[at - REACH] = back, 1
        inward, uses = np.zeros((len(stream), WIDTH), dtype=np.float32), np.zeros(len(stream), dtype=np.int64)
        for side, m in zip(SIDES, self.matrices):
            inward[side : side + windows] += backs @ m.T
            uses[side : side + windows] += centres
        rows, total, times = _sums(stream, inward, uses)
        self.embedding[rows, :WIDTH] = self.embedding.take(rows, axis=0)[:, :WIDTH] - step * total / np.maximum(times, GENTLE)[:, None]
        self.times[rows] += times
        for side, m in zip(SIDES, self.matrices):
            m -= np.float32(step / n) * (read[side : side + windows].T @ backs)
        self.bias -= np.float32(step / n) * back.sum(axis=0)
        self.times[self.first_node + len(self.nodes) :] += n


def contexts(places: np.ndarray, edge: int) -> np.ndarray:
    """Places of the words around each word; past the text's ends stands a place of its own."""
    stream = padded(places, edge)
    return np.stack([stream[j : j + len(places)] for j in SIDES], axis=1)


def padded(places: np.ndarray, edge: int) -> np.ndarray:
    """The words of a text with the place that stands past its ends on both sides: one stretch of a stream."""
    out = np.full(len(places) + 2 * REACH, edge, dtype=np.int32)
    out[REACH : REACH + len(places)] = places
    return out


def pieces(stream: np.ndarray, at: np.ndarray, size: int):
    """The words at these places of a stream, ``size`` at a time: (first, end, stretch of the stream, places in it)."""
    for a in range(0, len(at), size):
        part = at[a : a + size]
        lo = part[0] - REACH
        yield a, a + len(part), stream[lo : part[-1] + REACH + 1], part - lo


def _texts(batch, tree: Tree, rolling: Rolling, speller: "Speller | None" = None):
    """(places of the words in the vocabulary, log-probability of the rare ones' spelling) of each row.

    A table of places has them already; otherwise they come from the texts.
    """
    if "places" in batch.schema.names:
        for places, spelt in zip(column_of(batch, "places"), column_of(batch, "spelt").to_pylist()):
            yield np.frombuffer(places.as_py(), dtype=np.int32), spelt
        return
    rare = len(tree.words)
    symbol, log_p = speller.table() if speller else (None, None)
    for texts in joined(text_bytes(column_of(batch, "text"))):
        found, counts, total = [np.empty(0, dtype=np.int64)], np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        for data, starts, ends, h, text in words_of(texts, rolling):
            found.append(places_of(h, tree.words))
            counts += np.bincount(text, minlength=len(texts))
            outside = found[-1] == rare
            if speller and outside.any():
                starts, ends, text = starts[outside], ends[outside], text[outside]
                log_ps = log_p.take(spellings(data, starts, ends, symbol, len(log_p)))
                first = np.flatnonzero(np.diff(text, prepend=-1))
                total[text[first]] += np.add.reduceat(log_ps, (np.cumsum(ends - starts + 1) - (ends - starts + 1))[first])
        yield from zip(np.split(np.concatenate(found).astype(np.int32), np.cumsum(counts)[:-1]), total.tolist())


def _place(tree: Tree, speller: "Speller"):
    def run(batches):
        rolling = _rolling()
        for batch in batches:
            ids, rows, size = column_of(batch, "doc_id").to_pylist(), [], 0
            for doc, (places, spelt) in zip(ids, _texts(batch, tree, rolling, speller)):
                rows.append((doc, len(places), spelt, places.tobytes()))
                size += len(places)
                if size >= HELD:
                    yield batch_of(PLACED, list(zip(*rows)))
                    rows, size = [], 0
            if rows:
                yield batch_of(PLACED, list(zip(*rows)))

    return run


def _trained(batches, tree: Tree):
    rolling, net, edge = _rolling(), Network(tree), len(tree.words) + 1
    held, waiting = [], 0

    def learn_all(least: int):
        """Steps on the held words, ``BATCH`` at a time; fewer than ``least`` stay, with what is before them."""
        stream = np.concatenate(held)
        at = np.flatnonzero(stream[REACH:] != edge) + REACH
        for a, z, stretch, words in pieces(stream, at, BATCH):
            if z - a < least:
                return [stream[at[a] - REACH :].copy()], z - a
            net.learn(stretch, words, STEP * (z - a) / BATCH)
        return [], 0

    for batch in batches:
        for places, _ in _texts(batch, tree, rolling):
            if len(places):
                held.append(padded(places, edge))
                waiting += len(places)
            if waiting >= BATCH:
                held, waiting = learn_all(BATCH)
    if waiting:
        learn_all(1)
    sent = np.flatnonzero(net.times)
    for part in np.split(np.arange(len(sent)), np.flatnonzero(np.diff(sent // BLOCK)) + 1):
        if len(part):
            rows = sent[part]
            yield batch_of(PARAMETERS, [[int(rows[0]) // BLOCK], [rows.astype(np.int32).tobytes()], [net.times[rows].tobytes()], [net.weights[rows].tobytes()]])


def _averaged(batches):
    """Weighted means of the rows of each block; the blocks come in order."""
    now, times, total = None, None, None

    def out():
        rows = np.flatnonzero(times)
        means = (total[rows] / times[rows, None]).astype(np.float32)
        return batch_of(PARAMETERS, [[now], [(rows + now * BLOCK).astype(np.int32).tobytes()], [times[rows].tobytes()], [means.tobytes()]])

    for batch in batches:
        for block, rows, n, w in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if block != now:
                if now is not None:
                    yield out()
                now, times, total = block, np.zeros(BLOCK, dtype=np.int64), np.zeros((BLOCK, WIDTH + 1))
            at, n = np.frombuffer(rows, dtype=np.int32) - block * BLOCK, np.frombuffer(n, dtype=np.int64)
            times[at] += n
            total[at] += np.frombuffer(w, dtype=np.float32).reshape(-1, WIDTH + 1) * n[:, None].astype(np.float64)
    if now is not None:
        yield out()


def train_network(docs: DataFrame, tree: Tree) -> Network:
    """Trained on ``docs``, which has texts, or their places as ``_place`` makes them."""
    net = Network(tree)
    columns = ["places", "spelt"] if "places" in docs.columns else ["text"]
    sent = arrow_map(docs.select(columns), lambda batches: _trained(batches, tree), PARAMETERS)
    means = arrow_map(sent.repartition("block").sortWithinPartitions("block"), _averaged, PARAMETERS).toPandas()
    for rows, w in zip(means["rows"], means["weights"]):
        net.weights[np.frombuffer(rows, dtype=np.int32)] = np.frombuffer(w, dtype=np.float32).reshape(-1, WIDTH + 1)
    return net


@dataclass
class Speller:
    """log p(byte | two bytes before): trigrams backed by bigrams, and those by equal bytes."""

    keys: np.ndarray
    n: np.ndarray
    pairs: np.ndarray  # occurrences of two bytes as a context
    after: np.ndarray  # p(byte | one byte before)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of each byte, log p of three symbols); bytes that never occurred are one symbol, each as likely."""
        size = EDGE + 1
        used = np.unique(np.concatenate([self.keys // size**2, self.keys // size % size, self.keys % size]))
        unseen = np.setdiff1d(np.arange(size), used)[:1]
        symbol = np.full(size, len(used), dtype=np.int64)
        symbol[used] = np.arange(len(used))
        byte = np.concatenate([used, unseen]).astype(np.int64)
        n = np.zeros((len(byte),) * 3)
        n[symbol[self.keys // size**2], symbol[self.keys // size % size], symbol[self.keys % size]] = self.n
        pair = byte[:, None] * size + byte
        return symbol, np.log((n + PRIOR * self.after[pair]) / (self.pairs[pair][..., None] + PRIOR))


def within_class(counts: Counts, tree: Tree) -> Speller:
    """How the words of the tree's leaf of rarer words are spelt."""
    size = EDGE + 1
    pairs = np.bincount(counts.trigrams // size, weights=counts.n_trigrams, minlength=size * size)
    after = np.bincount(counts.trigrams % (size * size), weights=counts.n_trigrams, minlength=size * size).reshape(size, size)
    after = (after + PRIOR / size) / (after.sum(axis=1, keepdims=True) + PRIOR)
    return Speller(counts.trigrams, counts.n_trigrams, pairs, after.ravel())


def _score(weights: np.ndarray, tree: Tree, speller: Speller):
    def run(batches):
        rolling, net = _rolling(), Network(tree, weights)
        for batch in batches:
            texts = batch.num_rows
            n, total = np.zeros(texts, dtype=np.int64), np.zeros(texts)
            held, waiting = [], 0

            def settle():
                if held:
                    stream, text = (np.concatenate(x) for x in zip(*held))
                    for a, z, stretch, words in pieces(stream, np.flatnonzero(stream != len(tree.words) + 1), SCORED):
                        total[:] += net.lost(stretch, words, text[a:z], texts)
                    held.clear()

            for i, (places, spelt) in enumerate(_texts(batch, tree, rolling, speller)):
                total[i] += spelt
                if len(places):
                    held.append((padded(places, len(tree.words) + 1), np.full(len(places), i)))
                    n[i] = len(places)
                    waiting += len(places)
                if waiting >= SETTLED:
                    settle()
                    waiting = 0
            settle()
            yield batch_of(SCORES, [column_of(batch, "doc_id"), n, total, [t / k if k else None for t, k in zip(total.tolist(), n.tolist())]])

    return run


def scored_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of each whole text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = slot_counts(docs)
    tree = slot_classes(counts)
    speller = within_class(counts, tree)
    placed = Scratch(docs.sparkSession, "places").keep(arrow_map(docs, _place(tree, speller), PLACED), "places")
    net = train_network(placed, tree)
    return arrow_map(placed, _score(net.weights, tree, speller), SCORES)
