"""Awkward tables and long texts for all operators and stages, and the methods' own promises."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import common, decontamination, embedding_dedup, jaccard_join, language_id, licenses, line_dedup, lm_scoring, mixing, queries, substring_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["_doc", "_text_hash", "doc", "text_hash", "row", "bitmap", "spans", "leak_id", "gone_id", "g_id", "words", "shingle", "key", "chunk", "size"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({name: F.lit(f"own {name}") for name in CLASHES})


LINES = "a line that is long enough\nanother line that is long enough\n{}"


def awkward_rows():
    """Null ids and texts, repeated rows, ties of id, empty texts."""
    return [(1, LINES.format("one"), "xx", "a"), (1, LINES.format("one"), "xx", "a"), (None, LINES.format("two"), "xx", None), (None, None, None, None), (2, "", "yy", "b"), (1, "other text under the same id", "xx", "a"), (3, LINES.format("one"), "xx", "b")]


def test_columns_of_any_name_pass_through(spark):
    docs = clashing(spark, awkward_rows())
    bench = spark.createDataFrame([(1, "no such words anywhere in any of these texts at all")], "item_id long, text string")
    for stage in (line_dedup.drop_repeated_lines, jaccard_join.one_of_each_group, lambda x: decontamination.clean_documents(x, bench), language_id.accepted_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        assert all(r[name] == f"own {name}" for r in out.collect() for name in CLASHES)
    spans = substring_dedup.removal_spans(docs).select("row.*").collect()
    assert len(spans) == docs.count() and all(r[name] == f"own {name}" for r in spans for name in CLASHES)
    assert mixing.mixed_documents(docs).count() == docs.count()


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame(awkward_rows(), "doc_id long, text string, lang string, source string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in jaccard_join.one_of_each_group(docs).collect())
    assert got == sorted([(False, 1, LINES.format("one")), (True, None, LINES.format("two")), (True, None, ""), (False, 2, ""), (False, 1, "other text under the same id")], key=lambda x: (x[0], x[1] or 0, x[2]))


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame(awkward_rows(), "doc_id long, text string, lang string, source string")
    n = docs.count()
    assert token_counts.token_counts(docs, tokenizer()).count() == n
    assert lm_scoring.scored_documents(docs).count() == n
    assert language_id.language_digest(docs).count() == n
    assert substring_dedup.substring_digest(docs).count() == n
    assert jaccard_join.jaccard_digest(docs).count() == n
    taken = {(r["doc_id"], r["size"]): r for r in mixing.mixed_documents(docs).collect()}
    assert all(r["taken"] <= 2 * r["size"] for r in taken.values())
    found = licenses.license_paragraphs(spark.createDataFrame([(None, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "Released under the MIT License.")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["family"]) for r in found) == [(False, "mit"), (False, "mit"), (True, "mit")]


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.clean_documents(none, bench).count() == 0
    some = spark.createDataFrame([(1, "five words of no importance", "xx", "a", 1)], SCHEMA)
    assert decontamination.clean_documents(some, bench).count() == 1
    assert line_dedup.drop_repeated_lines(none).count() == 0 and jaccard_join.one_of_each_group(none).count() == 0
    assert language_id.accepted_documents(none).count() == 0 and language_id.accepted_documents(some.withColumn("lang", F.lit(None).cast("string"))).count() == 0
    assert mixing.mixed_shards(none).count() == 0


def test_pipeline_stages_on_empty_and_awkward_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "one item of more than five words here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = spark.createDataFrame([], SCHEMA)
    awkward = spark.createDataFrame([(*r, 1) for r in awkward_rows()], SCHEMA)
    for docs in (none, awkward):
        for i, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs.withColumn("extra", F.lit(1)), str(tmp_path))
            path = str(tmp_path / f"{name}-{docs.count()}-{i}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            if name != "mixing":
                assert docs.columns == pipeline.COLUMNS


# ---------------------------------------------------------------- sketches


def test_sketches_that_differ_in_a_sign_bit_are_close():
    """Of small sets, one element more may set any bit of the sketch, the sign bits of its two halves too."""
    rng, far = np.random.default_rng(4), 0
    for _ in range(400):
        more = np.unique(rng.integers(0, 1 << 64, 40, dtype=np.uint64))
        pair = [more, np.delete(more, rng.integers(0, 40, 4))]
        s1, s2 = (np.array(x, dtype=np.int64) for x in zip(*map(jaccard_join.sketch, pair)))
        far += not len(jaccard_join._near(0, np.array([1]), np.array([len(x) for x in pair]), s1, s2, 85, jaccard_join.allowed_mismatches(85)))
    assert not far


# ---------------------------------------------------------------- long words


def test_long_words_that_share_a_rolling_hash_are_told_apart(spark):
    """Thue-Morse words: any sum of bytes times powers modulo 2**64 is equal for both."""
    first = "ab"
    while len(first) < 2048:
        first += first.translate(str.maketrans("ab", "ba"))
    second = first.translate(str.maketrans("ab", "ba"))
    rolling = common.Rolling(5)
    sizes = [1, 7, 8, 9, 63, 64, 65, 200]
    words = [w for n in sizes for w in ("x" * n, "x" * (n - 1) + "y", "x" * (n - 1) + "\0")] + [first, second]
    assert len(set(common.word_hashes(" ".join(words).encode(), rolling).tolist())) == len(words)
    assert (common.word_hashes("ÀB cD".encode(), common.Rolling(5, fold_case=True)) == common.word_hashes("Àb cd".encode(), rolling)).all()
    docs = spark.createDataFrame([(1, f"{first} a b c"), (2, f"{second} a b c"), (3, f"{first} A b c"), (4, f"{first} a b c {second} a b c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_digest(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (5, 4)}


# ---------------------------------------------------------------- long texts


def test_long_texts_in_pieces_are_as_in_one(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = " ".join(rng.choice(words) for _ in range(260_000))
    raw = text.encode()
    assert len(raw) > common.Rolling.SEGMENT
    rolling = common.Rolling(5)
    whole = common.word_hashes(raw, rolling)
    assert len(whole) == len(text.split(" ")) and b"".join(common.segments(raw)) == raw
    assert (np.concatenate([common.word_hashes(p, rolling) for p in common.segments(raw, 5000)]) == whole).all()
    members = [np.concatenate(x) for x in zip(*substring_dedup.bucket_members(raw, substring_dedup._rolling()))]
    windows = np.concatenate([np.arange(a, a + n + 1) for a, n in zip(members[2].tolist(), members[3].tolist())])
    assert (windows == np.arange(len(raw) - 99)).all()
    grams = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 1 << 30)
    assert np.abs(language_id.ngram_counts(text) - grams).sum() <= 40
    counter = token_counts.counter(tokenizer())
    n = counter.count(text)
    monkeypatch.setattr(token_counts, "PIECE", 1 << 30)
    assert counter.count(text) == n


def test_long_line_is_one_key(spark):
    line = "x" * 1_200_000
    docs = spark.createDataFrame([(2, line + "\nb"), (1, "a\n" + line.upper())], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup_digest(docs).collect()} == {1: (2, 0), 2: (2, 1)}


# ---------------------------------------------------------------- what the methods promise


def test_prefix_never_shrinks_within_a_band():
    for percent in (80, 85):
        join = jaccard_join.PartEnum(percent)
        size = 1
        while size < 5000:
            _, low, high = join.band(size)
            n1, n2, _ = join.numbers(join.differences(high))
            signs = [join.prefix(x, low, n1) for x in range(-(-percent * low // 100), high + 1)]
            assert signs == sorted(signs) and (n2 > 1 or n1 == 1)
            size = high + 1


def test_one_subpart_may_differ():
    """Sets of hundreds of elements that differ in as many as they may share a signature; enumeration is what finds it."""
    rng = np.random.Generator(np.random.PCG64(7))
    join = jaccard_join.PartEnum(85)
    for size in (40, 57, 62, 150, 400, 1500):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            gone = int(rng.integers(0, size * 15 // 170 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, gone, dtype=np.uint64)]))
            common_ = len(np.intersect1d(a, b))
            if 100 * common_ >= 85 * (len(a) + len(b) - common_):
                assert len(np.intersect1d(join.signatures(a), join.signatures(b)))


def test_index_finds_all_fingerprints_within_the_radius(spark):
    rng = random.Random(2)
    items = [(i, 0, 9, 1, rng.getrandbits(64) - (1 << 63)) for i in range(3)]
    prints = []
    for _, _, _, _, value in items:
        for d in range(0, 30):
            flips = 0
            for b in rng.sample(range(64), d):
                flips |= 1 << b
            prints.append((9, ((value ^ flips) + (1 << 63)) % (1 << 64) - (1 << 63)))
    near = decontamination.near_items(spark.createDataFrame(prints, "n_words int, fingerprint long"), spark.createDataFrame(items, "item_id long, version long, n_words int, item_total long, fingerprint long"), decontamination.RADIUS)
    got = {(r["fingerprint"], r["item_id"]) for r in near.collect()}
    bits = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    assert got == {(p, i) for _, p in prints for i, _, _, _, value in items if bits(p, value) <= 19}


def test_fingerprints_of_pairs_at_the_threshold_lie_within_the_radius():
    """Recall of the radius at similarity 0.8 exactly: 16 of 18 shingles in common."""
    rng = np.random.Generator(np.random.PCG64(4))

    def fingerprint(x):
        bits = (x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        return bits.sum(axis=0) * 2 > len(x)

    apart = []
    for _ in range(4000):
        x = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 40, dtype=np.uint64)
        apart.append((fingerprint(x[:36]) != fingerprint(x[4:])).sum())
    assert np.mean(np.array(apart) <= decontamination.RADIUS) > 0.995


def test_shards_take_their_drawn_slots_in_turn(spark):
    """A shard's slots of a source are a run that begins where the shards before it end; counts are those drawn, and they vary."""
    docs = spark.createDataFrame([(i, "w " * 4000, None, f"s{i % 2}", 1) for i in range(40)], SCHEMA)
    old = mixing.WORDS_PER_SHARD
    mixing.WORDS_PER_SHARD = 16384
    try:
        out = mixing.mixed_shards(docs).select("source", "shard", "slot").collect()
        drawn = {(r["source"], r["shard"]): r["slots"] for r in mixing.shard_counts(docs).collect()}
    finally:
        mixing.WORDS_PER_SHARD = old
    runs = {}
    for r in out:
        runs.setdefault((r["source"], r["shard"]), []).append(r["slot"])
    assert {k: len(v) for k, v in runs.items()} == drawn and len({n for n in drawn.values()}) > 3
    for source in ("s0", "s1"):
        at = 0
        for shard in sorted(s for x, s in runs if x == source):
            slots = sorted(runs[source, shard])
            assert slots == list(range(at, at + len(slots)))
            at += len(slots)


def test_taken_words_by_brute_force(spark):
    """Each block is taken as often as slots name it; a document's share follows from where its words lie."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(rng.randint(0, 60))), None, rng.choice(["a", "b", None]), 1) for i in range(50)], SCHEMA)
    taken = {}
    for r in mixing.mixed_shards(docs).collect():
        for w in r["text"].split():
            i = int(w[1 : w.index("w")])
            taken[i] = taken.get(i, 0) + 1
    got = {r["doc_id"]: r["taken"] for r in mixing.mixed_documents(docs).collect()}
    assert got == {i: taken.get(i, 0) for i in range(50)}


def test_scores_by_brute_force(spark):
    """Every word's probability, multiplied out turn by turn along its whole path from the tree of the counts."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["sun", "moon", "star", "sky"]) + str(rng.randrange(12)) for _ in range(40)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    counts = lm_scoring.slot_counts(docs)
    tree = lm_scoring.slot_classes(counts)
    net = lm_scoring.train_network(docs, tree)
    w = len(tree.words)
    rolling = lm_scoring._rolling()
    places = next(lm_scoring._texts(__import__("pyarrow").RecordBatch.from_pydict({"text": [texts[0]]}), tree, rolling))[0]
    around = lm_scoring.contexts(places, w + 1)
    got = net.log_likelihoods(around, places, np.zeros(len(places), dtype=int), 1)[0]
    total = 0.0
    for context, target in zip(around, places):
        z = net.bias.astype(float).copy()
        for j, word in enumerate(context):
            z += net.embedding[word, : lm_scoring.WIDTH].astype(float) @ net.matrices[j].astype(float)
        h = np.append(np.tanh(z), 1.0)
        turns = [(int(n), bool(r)) for n, r in zip(tree.node[tree.start[target] : tree.start[target + 1]], tree.right[tree.start[target] : tree.start[target + 1]])]
        turns += [(int(n), t > 0) for n, t in zip(tree.heavy, tree.turn[target]) if t]
        for node, right in turns:
            p = 1 / (1 + math.exp(-float(net.nodes[node].astype(float) @ h)))
            total += math.log(p if right else 1 - p)
    assert abs(got - total) < 1e-3 * abs(total)
    logs = [net.log_likelihoods(around[:1], np.array([x]), np.zeros(1, dtype=int), 1)[0] for x in range(w + 1)]
    assert abs(sum(map(math.exp, logs)) - 1) < 1e-4


def test_wrapped_notices_are_one_paragraph(spark):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the Software), to deal in the Software without restriction"
    bsd = "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the\nfollowing conditions are met"
    prose = "The harbour was quiet and the boats lay still.\nNobody had seen the keeper of the light since noon."
    rows = [(1, f"{prose}\n\n{mit}\n\n{prose}"), (2, f"{bsd}\n{prose}"), (3, prose), (4, "free of charge to any person who asks for a copy of the software at the desk")]
    got = {(r["doc_id"], r["paragraph"], r["last_line"], r["family"], r["confirmed"]) for r in licenses.license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, 3, 5, "mit", True), (2, 0, 2, "bsd", True)} <= got and not any(d == 3 for d, *_ in got)
    assert all(family == "unknown" and not confirmed for d, _, _, family, confirmed in got if d == 4)


def test_every_template_is_found_and_prose_is_not(spark):
    """Held-out variants: a tenth of the words changed, prose around; and prose alone."""
    rng = random.Random(11)
    filler = " ".join(licenses.PROSE).split()
    rows, want = [], {}
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            if len(notice.split()) >= 8:
                words = [w if rng.random() > 0.05 else "thing" for w in notice.split()]
                want[len(rows)] = family
                rows.append((len(rows), " ".join(rng.choice(filler) for _ in range(6)) + "\n" + " ".join(words)))
    first = len(rows)
    rows += [(first + i, " ".join(rng.choice(filler) for _ in range(rng.randint(5, 30)))) for i in range(300)]
    got = licenses.license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("confirmed").collect()
    found = {r["doc_id"]: r["family"] for r in got}
    assert np.mean([found.get(i) == f for i, f in want.items()]) > 0.85 and sum(i >= first for i in found) <= 2


def test_language_by_brute_force():
    """The nearest centroid by cosine, computed one by one."""
    rng = random.Random(4)
    rows = [(lang, " ".join(rng.choice(words) for _ in range(30))) for lang, words in (("aa", ["the", "and", "shall"]), ("bb", ["der", "und", "nicht"])) for _ in range(30)]
    model = language_id.fit_model(rows)
    texts = ["the and shall the", "und der nicht", "shall und", "zzz qqq"]
    counts = np.stack([language_id.ngram_counts(t) for t in texts])
    owner, sims = model.nearest(counts)
    for n, o, s in zip(counts, owner, sims):
        v = np.log1p(n) * model.idf
        cos = [float(v @ c / np.linalg.norm(v)) for c in model.centroids]
        assert abs(max(cos) - s) < 1e-5 and model.owner[int(np.argmax(cos))] == o


def test_collisions_count_windows_that_hold_a_value():
    rng = np.random.Generator(np.random.PCG64(5))
    p, q = rng.standard_normal((40, 24)), rng.standard_normal((70, 24))
    q[:5] = p[:5]
    want = (np.abs(p[:, None, :] - q[None, :, :]) <= 0.5).sum(axis=2)
    assert (embedding_dedup.collisions(p, q, 0.5) == want).all()


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    with open(tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    with pytest.raises(ValueError, match="understood"):
        token_counts.WordCounter(json.dumps(spec))


def test_all_queries_are_registered():
    assert [int(name[2:].split("_")[0]) for name in queries.QUERIES] == list(range(1, 14))


def test_every_task_sends_all_weights_it_trained(spark):
    """Of 60 equal tasks each sends the tree's root with all its steps on it, and the embedding of every word that it read."""
    words = [f"word{i}" for i in range(30)]
    text = " ".join(words * 4)
    docs = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string")
    tree = lm_scoring.slot_classes(lm_scoring.slot_counts(docs))
    root = len(tree.words) + 2 + len(tree.bias) - 1
    batch = pa.RecordBatch.from_pydict({"text": [text]})
    sent = {}
    for block in lm_scoring._trained(iter([batch]), tree):
        for rows, n in zip(block.column(1).to_pylist(), block.column(2).to_pylist()):
            sent.update(zip(np.frombuffer(rows, dtype=np.int32).tolist(), np.frombuffer(n, dtype=np.int64).tolist()))
    assert len(tree.words) == 30 and sent[root] == 120
    assert all(sent[i] for i in range(30)) and sum(sent[i] for i in range(30)) == 2 * lm_scoring.REACH * 120 - 6
