"""Operators of the training-data subpackage against brute force on small, awkward tables."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import decontamination, embedding_dedup, jaccard_join, language_id, licenses, line_dedup, lm_scoring, mixing, substring_dedup, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(seed: int = 3, n: int = 60):
    """Random prose with exact and near copies, shared passages, repeated lines, empty, null and long texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéfghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 14)))
    shared = [line() for _ in range(4)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.4 and (old := rng.choice(rows)[1]):
            w = old.split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        else:
            text = "\n".join(rng.choice(shared).upper() + "  " if rng.random() < 0.2 else line() for _ in range(rng.randint(1, 12)))
            if rng.random() < 0.2:
                text = text + " " + passage + " " + line()
        rows.append((i, text, rng.choice(["xx", "yy"]), f"s{rng.randint(0, 4)}", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "xx", "s0", 0), (n + 2, " \n\t", "xx", "s0", 3), (n + 3, "ab", "yy", None, 2), (n + 4, "x" * 3000, "yy", "s1", 3000), (n + 5, line() + "\n" + "lang " * 4000, "xx", "s1", 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_line_dedup(docs, rows, nothing):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    first = {}
    for i, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), i), i)
    want = {}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        want[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in line_dedup.line_dedup_digest(docs).collect()} == want
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert out[len(rows) - 6] is None and len(out) == len(rows)
    assert line_dedup.line_dedup_digest(nothing).count() == 0


def test_line_dedup_repeated_rows_and_null_ids(spark):
    x = spark.createDataFrame([(2, "a long line here\nb"), (2, "a long line here\nb"), (None, "a long line here")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_dropped"]) for r in line_dedup.line_dedup_digest(x).collect())
    assert got == [(False, 0), (False, 0), (True, 1)]


def test_substring_dedup(docs, rows, nothing, monkeypatch):
    seen, want = set(), {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    for many in (substring_dedup.MANY, 2):
        monkeypatch.setattr(substring_dedup, "MANY", many)
        assert {r[0]: tuple(r)[1:] for r in substring_dedup.substring_digest(docs).collect()} == want
    assert substring_dedup.substring_digest(nothing).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, nothing, k, percent):
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall((text or "").translate(ASCII))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = components(sets, edges)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_documents(docs, k, percent).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    if k == 5:
        assert {r["doc_id"] for r in jaccard_join.one_of_each_group(docs, k, percent).collect()} == {i for i in sets if root[i] == i}
        assert jaccard_join.jaccard_digest(nothing).count() == 0


def test_part_enum_shares_a_signature():
    """Every pair at the similarity shares a signature, over sizes and numbers of differences."""
    rng = np.random.Generator(np.random.PCG64(1))
    join = jaccard_join.PartEnum(85)
    for size in [1, 2, 5, 6, 7, 8, 11, 12, 13, 19, 20, 33, 60, 90, 200, 700]:
        for _ in range(30):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            drop, add = rng.integers(0, max(1, size // 6) + 1, 2)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if common and 100 * common >= 85 * (len(a) + len(b) - common):
                assert len(np.intersect1d(join.signatures(a), join.signatures(b)))


def test_mixing(docs, rows, nothing, spark):
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    total = {}
    for i, _, _, source, _ in rows:
        total[source] = total.get(source, 0) + size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[j % 3] for j, s in enumerate(names)}
    target, open_sources, left = {}, set(names), 1.5 * sum(total.values())
    while True:  # hand out by weight; cap; hand out the rest again
        share = {s: left * weight[s] / sum(weight[x] for x in open_sources) for s in open_sources}
        over = {s for s in open_sources if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            open_sources.discard(s)
    got = {r["doc_id"]: r for r in mixing.mixed_documents(docs).collect()}
    assert {i: r["size"] for i, r in got.items()} == size
    taken = {}
    for r in got.values():
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 2
    again = {r["doc_id"]: r["taken"] for r in mixing.mixed_documents(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    slots = mixing.shard_counts(docs).groupBy("source").agg(F.sum("slots")).count()
    assert slots == len(names) and mixing.mixed_documents(nothing).count() == 0
    n = spark.range(97).select(mixing.permuted(F.col("id"), F.lit(97), F.lit(5)).alias("p")).distinct().count()
    assert n == 97


def test_token_counts(docs, rows, nothing):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), token_counts.counter(path)
    rng = random.Random(4)
    odd = ["".join(rng.choice("aBc'sstred19 é_.!-İßſσΣ日🙂\t\n\x1c") for _ in range(40)) for _ in range(500)] + ["x<|endoftext|>y <|startoftext|>", "ΟΔΟΣ ΑΣ", "½²Ⅷ"]
    assert [own.count(x) for x in odd] == [len(library.encode(x, add_special_tokens=False).ids) for x in odd]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, path).collect()}
    for i, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 2048)
    assert token_counts.token_counts(nothing, path).count() == 0


def test_embedding_dedup(spark, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(2))
    base = rng.standard_normal((60, 16))
    rows, i = [], 0
    for b in base:
        for _ in range(int(rng.integers(1, 6))):
            v = b / np.linalg.norm(b) + rng.standard_normal(16) * rng.choice([0.0, 0.04, 0.1])
            rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
            i += 1
    odd = [(i, None, 0), (i + 1, [0.0] * 16, 0), (i + 2, [float("nan")] + [1.0] * 15, 0), (i + 3, rows[0][1], None), (i + 4, [None] + [1.0] * 15, 0), (i + 5, [], 1), (i + 6, [1e-30] * 16, 0), (i + 7, [1e30] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    fine = [r for r in rows + [odd[6], odd[7]]]
    unit = {k: np.array(np.float32(v), dtype=np.float64) / np.linalg.norm(np.array(np.float32(v), dtype=np.float64)) for k, v, _ in fine}
    label = {k: x for k, _, x in fine}
    edges = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    ids = [r[0] for r in rows + odd]
    links = {k: sum(k in e for e in edges) for k in ids}
    root = components(ids, edges)
    for tile in (embedding_dedup.TILE, 16):
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
        assert sum(g[0] for g in got.values()) >= 0.99 * sum(links.values())
        assert sum(got[k] != (links[k], root[k], root[k] == k) for k in ids) <= 1
    assert embedding_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_language_id(spark, nothing):
    rng = random.Random(6)
    lists = {"aa": ["the", "and", "ofthe", "ing", "shall"], "bb": ["der", "und", "nicht", "über", "zwischen"], "cc": ["que", "para", "los", "año", "niño"]}
    rows = [(i, " ".join(rng.choice(lists[lang]) for _ in range(rng.randint(1, 80))), lang) for i, lang in enumerate(rng.choice(list(lists)) for _ in range(300))]
    rows += [(1000, None, "aa"), (1001, "123 ... 456", "bb"), (1002, "", None), (1003, "und nicht der zwischen", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("extra", F.lit(1))
    got = {r["doc_id"]: r for r in language_id.language_digest(df).collect()}
    held = [i for i, _, _ in rows[:300] if got[i]["held_out"]]
    assert 30 < len(held) < 90 and np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not any(got[i]["rejected"] for i in range(300))
    kept = {r["doc_id"] for r in language_id.accepted_documents(df).collect()}
    assert kept == {i for i in got if i not in (1000, 1001, 1002)}
    assert language_id.language_digest(nothing).count() == 0


def test_decontamination(spark, nothing):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(prose(n))) for i, n in enumerate([12, 25, 40, 40, 3])] + [(9, None), (10, "")]
    rows, want = [], set()
    for i in range(60):
        text = prose(rng.randint(0, 120))
        if i % 3 == 0:
            item, body = rng.choice(items[:4])
            leak = body.upper().split()
            if i % 2:
                leak[-1] = "changed"
            text = text[:50] + leak + text[50:]
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (102, items[4][1]), (103, items[1][1])]
    def shingles(w):
        out = {}
        for s in [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []:
            out[s] = out.get(s, 0) + 1
        return out
    for i, text in rows:
        w = (text or "").lower().split()
        for item, body in items:
            b = (body or "").lower().split()
            for s in range(max(1, len(w) - len(b) + 1)) if b and w else []:
                x, y = shingles(w[s : s + len(b)]), shingles(b)
                both = sum(min(v, y.get(k, 0)) for k, v in x.items())
                if both / (sum(x.values()) + sum(y.values()) - both) >= 0.8:
                    want.add((i, item))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated_windows(d, b).collect()}
    assert got == want and len(want) > 15
    assert {r["doc_id"] for r in decontamination.clean_documents(d, b).collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontamination.contaminated_windows(nothing, b).count() == 0


def test_decontamination_without_broadcast_is_the_same(spark, monkeypatch):
    body = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, "a b c " + body), (2, "x " * 40)], "doc_id long, text string")
    b = spark.createDataFrame([(5, body)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
    assert [(r["doc_id"], r["item_id"], r["start_word"], r["similarity"]) for r in decontamination.contaminated_windows(d, b).collect()] == [(1, 5, 3, 1.0)]


def test_licenses(spark, nothing):
    rows = [(1, "some words\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "the driver lost his license in the general public"), (4, None), (5, "")]
    rows += [(6, "und nicht der die das\n" * 50)]
    got = {(r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in licenses.license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, "mit", True), (2, 0, "apache", True)}
    assert licenses.license_paragraphs(nothing).count() == 0


def test_lm_scoring(spark, docs, rows, nothing):
    got = {r["doc_id"]: r for r in lm_scoring.scored_documents(docs).collect()}
    for i, text, *_ in rows:
        n = len(WORD.findall(text or ""))
        assert got[i]["n_words"] == n and (got[i]["log_likelihood"] < 0 if n else got[i]["log_likelihood"] == 0)
    assert lm_scoring.scored_documents(nothing).count() == 0
    rng = np.random.Generator(np.random.PCG64(3))
    # Words that follow one another in a cycle are likelier in order than shuffled.
    texts = [" ".join(f"w{(s + j) % 12}" for j in range(60)) for s in range(300)]
    model = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = lm_scoring.slot_counts(model)
    table = lm_scoring.slot_classes(counts)
    net = lm_scoring.train_network(model, table)
    import pyarrow as pa

    def score(text):
        batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([text])], names=["doc_id", "text"])
        return next(lm_scoring._score(net.weights, table, lm_scoring.within_class(counts, table))([batch]))["log_likelihood"][0].as_py()

    assert score(texts[0]) > score(" ".join(rng.permutation(texts[0].split())))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert counts[-1] > 0 and all(a >= b for a, b in zip(counts, counts[1:])) and counts[0] > counts[3]


def test_lm_scoring_predicts_each_word_and_spells_rare_ones(spark):
    """Pairs of 120 equally frequent words: the right partner is likelier. Rare words are not other words' slots."""
    rng = random.Random(12)
    texts = []
    for _ in range(1500):
        texts.append(" ".join(f"a{i} b{i}" for i in (rng.randrange(60) for _ in range(40))))
    right = [f"a{i} b{i}" for i in range(60)]
    wrong = [f"a{i} b{(i + 7) % 60}" for i in range(60)]
    odd = ["".join(rng.choice("lmno") for _ in range(6)) for _ in range(300)] + ["lmnolm", "zqxkjw"]
    rows = list(enumerate(texts + right + wrong + odd))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["log_likelihood"] for r in lm_scoring.scored_documents(docs).collect()}
    n = len(texts)
    better = sum(got[n + i] > got[n + 60 + i] + 0.1 for i in range(60))
    assert better >= 57
    assert got[len(rows) - 2] > got[len(rows) - 1] + 1


def test_lm_vocabulary_is_counted_and_the_model_adds_up_to_one(spark):
    rows = [(i, " ".join(["often"] * 5 + ["Mid"] + [f"once{i}"])) for i in range(lm_scoring.LEAST)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm_scoring.slot_counts(docs)
    least = lm_scoring.LEAST
    assert sorted(counts.n.tolist()) == [least, least, 5 * least]
    tree = lm_scoring.slot_classes(counts)
    net = lm_scoring.train_network(docs, tree)
    around = np.tile(np.array([[0, 1, 2, 3]], dtype=np.int32), (3, 1))
    logs = net.log_likelihoods(around, np.arange(3), np.arange(3), 3)
    assert abs(np.exp(logs).sum() - 1) < 1e-4
    _, log_p = lm_scoring.within_class(counts, tree).table()
    unseen = lm_scoring.EDGE + 1 - (log_p.shape[2] - 1)
    total = np.exp(log_p[:, :, :-1]).sum(axis=2) + unseen * np.exp(log_p[:, :, -1])
    assert np.allclose(total, 1)


def _best_windows(rows, items):
    """Brute force: (doc, item) to (similarity, start) of the best item-sized window at 0.8 or more."""
    def shingles(w):
        out = {}
        for s in [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []:
            out[s] = out.get(s, 0) + 1
        return out

    want = {}
    for i, text in rows:
        w = (text or "").lower().split()
        for item, body in items:
            b = body.lower().split()
            y = shingles(b)
            for s in range(max(1, len(w) - len(b) + 1)) if w else []:
                x = shingles(w[s : s + len(b)])
                both = sum(min(v, y.get(k, 0)) for k, v in x.items())
                score = both / (sum(x.values()) + sum(y.values()) - both)
                if score >= 0.8 and score > want.get((i, item), (0, 0))[0]:
                    want[i, item] = (score, s)
    return want


def test_decontamination_of_inserts_and_edited_ends(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([80, 80, 60, 100])] + [(4, " ".join(["tick", "tock"] * 20))]
    rows = []
    for i in range(120):
        item, body = items[i % 4]
        leak = body.split()
        ends, inserts = (2, 3) if i < 4 else (rng.randint(0, 3), rng.randint(0, 8))
        leak[:ends], leak[len(leak) - ends :] = [word() for _ in range(ends)], [word() for _ in range(ends)]
        at = 34 if i < 4 else rng.randrange(len(leak))
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 30))] + leak[:at] + [word() for _ in range(inserts)] + leak[at:] + [word() for _ in range(rng.randint(0, 30))])))
    rows += [(200, " ".join(["tock"] + ["tick", "tock"] * 25)), (201, " ".join(items[0][1].split()[:75])), (202, items[2][1].upper())]
    want = _best_windows(rows, items)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontamination.contaminated_windows(d, b).collect()}
    assert got == want and (0, 0) in want and len(want) > 40


def test_decontamination_of_short_items(spark):
    """Items of one to five words inside long, short and equal documents."""
    items = [(1, "Zeta"), (2, "blue moon"), (3, "alpha beta gamma"), (4, "one two three four"), (5, "five words are one shingle"), (6, "six words are two shingles here")]
    filler = " ".join(f"w{i}" for i in range(40))
    rows = [(0, filler)] + [(i, f"{filler} {body.upper()} {filler} {body}") for i, body in items]
    rows += [(10 + i, body) for i, body in items] + [(20 + i, f"x {body}") for i, body in items]
    rows += [(30, "alpha beta"), (31, "alpha beta x gamma"), (32, "one two three"), (33, ""), (34, None)]
    want = _best_windows(rows, items)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontamination.contaminated_windows(d, b).collect()}
    assert got == want and len(want) == 18


def test_mixed_shards_hold_the_words(docs, rows, nothing):
    """The blocks drawn hold the sources' own words, each shard has its drawn slots, and documents' figures follow."""
    out = mixing.mixed_shards(docs).collect()
    drawn = {(r["source"], r["shard"]): r["slots"] for r in mixing.shard_counts(docs).collect()}
    got, taken, blocks = {}, {}, {}
    for r in out:
        got[r["source"], r["shard"]] = got.get((r["source"], r["shard"]), 0) + 1
        words = r["text"].split(" ")
        assert len(words) == r["n_words"] > 0
        assert blocks.setdefault((r["source"], r["block"]), words) == words
        for w in words:
            taken[r["source"], w] = taken.get((r["source"], w), 0) + 1
    assert got == drawn and len({(r["source"], r["slot"]) for r in out}) == len(out)
    # Laid end to end, each source's blocks are its words; every block is drawn here or another time.
    all_words = {}
    for _, text, _, source, _ in rows:
        for w in WORD.findall(text or ""):
            all_words[source, w] = all_words.get((source, w), 0) + 1
    assert set(taken) <= set(all_words) and all(n <= 2 * all_words[k] for k, n in taken.items())
    figures = {r["source"]: r["n"] for r in mixing.mixed_documents(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert figures == {s: sum(n for (t, _), n in taken.items() if t == s) for s in figures}
    assert mixing.mixed_shards(nothing).count() == 0
