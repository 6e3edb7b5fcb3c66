"""Work of op8 that is done once for many documents, against the same work done one by one."""

import random

import numpy as np
import pyarrow as pa
import pytest

from reviewlake.llm import common, jaccard_join


def texts_of(seed, n):
    rng = random.Random(seed)
    some = [" ".join(rng.choice(["a", "B", "cd", f"w{rng.randint(0, 400)}", "x" * 90]) for _ in range(rng.choice([0, 1, 3, 4, 30, 200, 900]))).encode() for _ in range(n)]
    return [None, b"", b" \n", *some, some[0]]


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_sets_made_and_signed_together(k, percent):
    rolling, join = common.Rolling(1, fold_case=True), jaccard_join.PartEnum(percent)
    texts = texts_of(3, 200)
    want = [common.shingle_set(common.word_hashes(x or b"", rolling), k) for x in texts]
    sets = common.shingle_sets(iter(texts), k, rolling)
    assert [x.tolist() for x in sets] == [x.tolist() for x in want]
    assert [sorted(x.tolist()) for x in join.signatures_of(sets)] == [sorted(join.signatures(x).tolist()) for x in want]
    assert [tuple(x) for x in jaccard_join.sketches(sets).tolist()] == [jaccard_join.sketch(x) for x in want]


def tile_rows(groups):
    return pa.RecordBatch.from_pydict({name: pa.array([g[i] for g in groups]) for i, name in enumerate(["group", "tile", "set_id", "n", "s1", "s2", "side"])})


def test_families_of_many_groups_are_sent_once():
    """Two sets share hundreds of signatures: their task sends one edge, however rows are cut into batches."""
    rows = [(g, 0, i, 100, 5, 9, 2) for g in range(300) for i in (1, 2, 3)] + [(900, 1, 7, 100, 5, 9, 0), (900, 1, 8, 100, 5, 9, 0), (900, 1, 9, 100, 5, 9, 1), (901, 0, 20, 100, -1, -1, 2), (901, 0, 21, 100, 0, 0, 2)]
    for size in (1, 7, 1000):
        out = list(jaccard_join._families(85)(tile_rows(rows[i : i + size]) for i in range(0, len(rows), size)))
        assert sorted(tuple(r.values()) for b in out for r in b.to_pylist()) == [(2, 1), (3, 1), (8, 7), (9, 7)]


def test_large_tiles_and_full_forests(monkeypatch):
    rng = random.Random(5)
    rows = sorted((g, 0, rng.randint(0, 300), 100, 5 if g % 2 else rng.choice([5, -6]), 9, 2) for g in range(40) for _ in range(rng.randint(1, 12)))
    found = []
    for small, most in ((64, 500_000), (3, 500_000), (64, 10)):
        monkeypatch.setattr(jaccard_join, "SMALL_TILE", small)
        monkeypatch.setattr(jaccard_join, "MOST_PAIRS", most)
        edges = [tuple(r.values()) for b in jaccard_join._families(85)([tile_rows(rows)]) for r in b.to_pylist()]
        found.append(sorted(zip(*(x.tolist() for x in jaccard_join.forest(*map(np.array, zip(*edges)))))))
    assert found[0] == found[1] == found[2] and found[0]


def test_texts_outside_families_are_not_read_twice(monkeypatch):
    """Only texts that pass the filter are cut into words for the exact comparison."""
    seen, real = [], common.shingle_sets
    monkeypatch.setattr(jaccard_join, "shingle_sets", lambda texts, k, rolling: real([seen.append(x) or x for x in texts], k, rolling))
    held = np.zeros(1 << 13, dtype=np.uint8)
    held[0] = 0b101  # hashes 0 and 2
    batch = pa.RecordBatch.from_pydict({"text_hash": pa.array([0, 1, 2, -5, 2]), "text": ["a b c d e", "never read", "f g h i", "never read", "f g h i"]})
    out = list(jaccard_join._elements(4, 1 << 16, held.tobytes())([batch]))
    assert sorted(seen) == [b"a b c d e", b"f g h i"] and [b.num_rows for b in out] == [2]
