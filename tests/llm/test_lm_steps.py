"""LM scoring does each piece of work once: texts are hashed many at a time, a word of a stream is read once for all its windows."""

import math
import random

import numpy as np
import pyarrow as pa

from reviewlake.llm import lm_scoring
from reviewlake.llm.common import Rolling


def _counts(words: int) -> lm_scoring.Counts:
    """A vocabulary large enough for heavy nodes, crowns and nodes below them."""
    n = np.array([5000 // (i + 1) + 50 for i in range(words)] + [900], dtype=np.int64)
    spelt = np.unique(lm_scoring.spellings(np.frombuffer(b"rareword", dtype=np.uint8), np.array([0]), np.array([8])))
    return lm_scoring.Counts(np.sort(np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 63, words, dtype=np.uint64)), n, spelt, np.full(len(spelt), 900, dtype=np.int64))


def test_every_turn_is_heavy_in_a_crown_or_deep():
    for words in (0, 1, 2, 40, 3000):
        tree = lm_scoring.slot_classes(_counts(words))
        for leaf in range(0, words + 1, 7):
            path = tree.node[tree.start[leaf] : tree.start[leaf + 1]].tolist()
            crowned = int(tree.deep[leaf] - tree.start[leaf])
            turn = tree.crown_turn[leaf]
            assert np.count_nonzero(turn) == crowned
            if crowned:
                nodes = tree.crowns[tree.subtree[leaf]][turn != 0].tolist()
                rights = dict(zip(path, tree.right[tree.start[leaf] : tree.start[leaf + 1]].tolist()))
                assert sorted(nodes) == sorted(path[:crowned]) and all(rights[v] == (t > 0) for v, t in zip(nodes, turn[turn != 0]))
    assert (tree.deep < tree.start[1:]).any() and (tree.deep > tree.start[:-1]).any()


def test_a_step_is_the_gradient_of_each_word_by_brute_force():
    """Windows of three texts in one stream, of which only some words are learnt, against sums over all turns in double precision."""
    tree = lm_scoring.slot_classes(_counts(400))
    net, width = lm_scoring.Network(tree), lm_scoring.WIDTH
    rng = np.random.Generator(np.random.PCG64(5))
    net.weights[:, :width] += rng.standard_normal((len(net.weights), width)).astype(np.float32) * np.float32(0.1)
    net.weights[: net.first_node, width] = 0
    net.weights[net.first_node + len(net.nodes) :, width] = 0
    edge = len(tree.words) + 1
    texts = [rng.integers(0, 401, n) for n in (90, 1, 7)]
    stream = np.concatenate([lm_scoring.padded(t, edge) for t in texts])
    at = np.flatnonzero(stream != edge)[5:]
    before, nodes = net.weights.astype(float), slice(net.first_node, net.first_node + len(net.nodes))
    emb, theta, matrices, bias = before[: net.first_node, :width], before[nodes], net.matrices.astype(float), net.bias.astype(float)
    d_emb, d_theta, d_m, d_b = np.zeros_like(emb), np.zeros_like(theta), np.zeros_like(matrices), np.zeros_like(bias)
    times = np.zeros(len(before), dtype=int)
    for p in at:
        around = [stream[p - 2], stream[p - 1], stream[p + 1], stream[p + 2]]
        h = np.append(np.tanh(bias + sum(emb[w] @ m for w, m in zip(around, matrices))), 1.0)
        t, back = stream[p], np.zeros(width)
        turns = list(zip(tree.node[tree.start[t] : tree.start[t + 1]].tolist(), tree.right[tree.start[t] : tree.start[t + 1]].tolist()))
        for node, right in turns + [(int(v), x > 0) for v, x in zip(tree.heavy, tree.turn[t]) if x]:
            g = 1 / (1 + math.exp(-float(theta[node] @ h))) - right
            back += g * theta[node, :width]
            d_theta[node] += g * h
            times[net.first_node + node] += 1
        back *= 1 - h[:width] ** 2
        d_b += back
        for j, w in enumerate(around):
            d_emb[w] += back @ matrices[j].T
            d_m[j] += np.outer(emb[w], back)
            times[w] += 1
    times[nodes.stop :] = len(at)
    shared = np.maximum(times, lm_scoring.GENTLE)[:, None]
    net.learn(stream, at, 0.5)
    assert np.array_equal(net.times, times)
    assert np.allclose(net.nodes, theta - 0.5 * d_theta / shared[nodes], atol=1e-5)
    assert np.allclose(net.embedding[:, :width], emb - 0.5 * d_emb / shared[: net.first_node], atol=1e-5)
    assert np.allclose(net.matrices, matrices - 0.5 / len(at) * d_m, atol=1e-5) and np.allclose(net.bias, bias - 0.5 / len(at) * d_b, atol=1e-5)


def test_texts_are_split_and_hashed_many_at_a_time(monkeypatch):
    """As each text by itself, in few calls; an empty one, a null and one longer than a segment lose no word."""
    rng = random.Random(3)
    texts = [None, "", " \n", "often " * 250_000] + [" ".join(rng.choice(["often", "Mid", "rare%d" % i, "é\x0bx"]) for _ in range(rng.randrange(9))) for i in range(900)] + ["", None]
    rolling = lm_scoring._rolling()
    known = np.sort(np.concatenate([h for *_, h, _ in lm_scoring.words_of([b"often mid"], rolling)]))
    counts = lm_scoring.Counts(known, np.array([50, 50, 900]), *np.unique(lm_scoring.spellings(np.frombuffer(b"rare12", dtype=np.uint8), np.array([0]), np.array([6])), return_counts=True))
    tree = lm_scoring.slot_classes(counts)
    speller = lm_scoring.within_class(counts, tree)
    calls, words = [], Rolling.words
    monkeypatch.setattr(Rolling, "words", lambda *x: calls.append(1) or words(*x))
    found = list(lm_scoring._texts(pa.RecordBatch.from_pydict({"text": texts}), tree, rolling, speller))
    assert len(found) == len(texts) and len(calls) < 10
    for text, (places, spelt) in zip(texts, found):
        (alone, alone_spelt), = lm_scoring._texts(pa.RecordBatch.from_pydict({"text": pa.array([text], pa.string())}), tree, rolling, speller)
        assert len(places) == len((text or "").split()) and np.array_equal(places, alone) and abs(spelt - alone_spelt) < 1e-9
    del calls[:]
    rows = [x for b in lm_scoring._count_words(iter([pa.RecordBatch.from_pydict({"text": texts})])) for x in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
    assert sum(n for _, n in rows) == sum(len((t or "").split()) for t in texts) and dict(rows)[b"mid"] == sum((t or "").split().count("Mid") for t in texts) and len(calls) < 10
