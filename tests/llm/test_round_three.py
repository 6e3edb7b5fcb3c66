"""Sharding, whitening and periodic runs against brute force, on awkward tables and by their contracts."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import decontamination, embedding_dedup, jaccard_join, language_id, licenses, line_dedup, lm_scoring, mixing, periodic_runs, queries, sharding, substring_dedup, token_counts, whitening

DOCS = "doc_id long, text string, source string"


def random_documents(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéfg") for _ in range(rng.randint(1, 7))) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80))), "s") for i in range(n)]
    rows += [(None, None, None), (None, "", None), (n, None, "x"), (n + 1, "", "x"), (n + 2, "word " * 3000, "x")]
    return rows


# ---------------------------------------------------------------- sharding


def judged_shards(rows, out, shards, slack):
    """Every row is there once, slots have no gap, sizes differ by at most ``slack``."""
    size = lambda text: len((text or "").encode()) + 1
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in rows)
    held, slots = Counter(dict.fromkeys(range(shards), 0)), defaultdict(list)
    for r in out:
        held[r["shard"]] += size(r["text"])
        slots[r["shard"]].append(r["slot"])
    assert set(held) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(held.values()) - min(held.values()) <= slack, held


@pytest.mark.parametrize("bucket", [200, 1 << 23])
def test_shards_are_even(spark, bucket):
    rows = random_documents(1, 400)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    out = sharding.sharded(docs, 8, bucket=bucket)
    assert out.columns == ["doc_id", "text", "source", "shard", "slot"]
    first = out.collect()
    judged_shards(rows, first, 8, slack=2 * 15_001)
    judged_shards([r for r in rows if r[0] != 402], sharding.sharded(docs.where("doc_id is null or doc_id <> 402"), 8, bucket=bucket).collect(), 8, slack=2 * 600)
    again = sharding.sharded(docs.repartition(2), 8, bucket=bucket).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, first))


def test_copies_are_cut_anywhere(spark):
    """A third of all rows one text under many ids, another third one row repeated."""
    rows = [(i, "the same text in many documents", "a") for i in range(500)] + [(7, "one and the same row", "b")] * 500 + random_documents(2, 500)[:500]
    for bucket in (300, 1 << 23):
        out = sharding.sharded(spark.createDataFrame(rows, DOCS).repartition(6), 16, bucket=bucket).collect()
        judged_shards(rows, out, 16, slack=2 * 600)
        places = sorted({r["shard"] for r in out if r["source"] == "a"})
        assert places == list(range(places[0], places[-1] + 1)) and len(places) < 10  # equal texts lie together


def test_shards_of_few_and_odd_rows(spark):
    assert sharding.sharded(spark.createDataFrame([], DOCS)).collect() == []
    one = sharding.sharded(spark.createDataFrame([(1, "x", "y")], DOCS), 4).collect()
    assert len(one) == 1 and one[0]["slot"] == 0 and 0 <= one[0]["shard"] < 4
    same = [(None, None, None)] * 64
    judged_shards(same, sharding.sharded(spark.createDataFrame(same, DOCS), 16).collect(), 16, slack=0)
    clash = spark.createDataFrame(random_documents(3, 50), DOCS).withColumns({c: F.lit(f"own {c}") for c in ("a", "b", "row", "size", "bucket", "n", "cut", "place", "slot", "parent")})
    out = sharding.sharded(clash, 4)
    assert all(r[c] == f"own {c}" for r in out.collect() for c in ("a", "b", "row", "size", "bucket", "n", "cut", "place", "parent"))
    assert {r["slot"] for r in out.where("shard = 0").collect()} == set(range(out.where("shard = 0").count()))


def test_splitters_are_exact_counts(spark, tmp_path):
    """Keys of any spread, far apart and close: what a splitter says lies below it lies below it."""
    from reviewlake.llm.common import Scratch

    rng = random.Random(5)
    rows = [(rng.choice([rng.randrange(50), rng.randrange(1 << 62), (1 << 63) - 1 - rng.randrange(9)]), rng.randrange(3), rng.randint(1, 99)) for _ in range(3000)]
    found = sharding.find_splitters(Scratch(spark, "test"), spark.createDataFrame([(0, *r) for r in rows], "parent long, a long, b long, size long"), 40, 200.0)
    assert len(found) == 39
    total = sum(r[2] for r in rows)
    for j, s in enumerate(found, 1):
        below = [r for r in rows if (r[0], r[1], 0) < (s.a, s.b, s.after)] if not s.copies else None
        if below is not None:
            assert len(below) == s.rows_below
            at = [r[2] for r in rows if (r[0], r[1]) == (s.a, s.b)]
            assert abs(sum(r[2] for r in below) - j * total / 40) <= max(200, sum(at))


def test_sharding_writes_its_shards(spark, tmp_path):
    rows = random_documents(4, 100)
    sharding.write_shards(spark.createDataFrame(rows, DOCS), f"{tmp_path}/shards", 4)
    judged_shards(rows, spark.read.parquet(f"{tmp_path}/shards").collect(), 4, slack=2 * 15_001)


def test_sharding_digest(spark, tmp_path):
    rows = random_documents(6, 200)
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_sharding(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    got = Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in out.collect())
    assert got == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for i, t, _ in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


# ---------------------------------------------------------------- whitening


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) / 10
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base.astype(np.float32))]
    odd = [(900, None), (901, [None] + [0.5] * 11), (902, [math.nan] + [0.5] * 11), (903, [math.inf] + [0.5] * 11), (904, [0.5] * 3), (905, []), (906, [1e30] + [0.5] * 11)]
    more = [(None, rows[0][1]), (5, rows[5][1])]
    table = spark.createDataFrame(rows + odd + more, "vec_id long, embedding array<float>").repartition(4)
    out = whitening.whitening_digest(table)
    assert [name for name, _ in out.dtypes] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    kept = rows + more
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in kept], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    off = (x * n - sums) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = ((x * n - sums) ** 2).sum(axis=1)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    by_id = defaultdict(dict)
    for r in got:
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9
        assert r["identity_error"] < 1e-9
        by_id[r["vec_id"]].setdefault(r["component"], []).append((r["deviation"], r["whitened"]))
    expected = off @ vectors[:, :8] / np.sqrt(values[:8])
    signs = np.sign([by_id[1][c][0][1] / expected[1][c - 1] for c in range(1, 9)])
    for place, (i, _) in enumerate(kept):
        for c in range(1, 9):
            assert any(d == deviation[place] and abs(w - signs[c - 1] * expected[place][c - 1]) < 1e-8 for d, w in by_id[i][c])


def test_whitening_of_awkward_tables(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 5, [(1, [])]):
        assert whitening.whitening_digest(spark.createDataFrame(rows, kind)).collect() == []
    flat = [(i, [float(i), 1.0, float(-i)]) for i in range(10)]  # one direction has all the variance
    got = whitening.whitening_digest(spark.createDataFrame(flat, kind).withColumn("z", F.lit("own"))).collect()
    assert [r["component"] for r in got] == [1] * 10 and abs(got[0]["explained"] - 1) < 1e-12
    big = [(i, [float(i * 100), float(i % 7)]) for i in range(2000)]
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in whitening.whitening_digest(spark.createDataFrame(big, kind)).collect()}
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in big]
    sums = [sum(r[j] for r in x) for j in range(2)]
    exact = [sum((2000 * r[j] - sums[j]) ** 2 for j in range(2)) for r in x]
    assert all(got[i, 1] == (d if d < 1 << 63 else None) for i, d in enumerate(exact)) and 100 < list(got.values()).count(None) < 4000


# ---------------------------------------------------------------- periodic runs


def brute_runs(w, least=6, exponent=4):
    n, out = len(w), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                s, e = i, j + q
                if e - s >= max(least, exponent * q) and q == next(p for p in range(1, q + 1) if all(w[x] == w[x + p] for x in range(s, e - p))):
                    out.add((s, e - s, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7 and w:
            a, p = rng.randrange(len(w)), rng.randint(1, 6)
            w[a:] = [w[a + i % min(p, len(w) - a)] for i in range(len(w) - a)]
            w += [rng.randrange(4) for _ in range(rng.randint(0, 5))]
        for least, exponent in ((6, 4), (2, 2), (8, 3)):
            assert [tuple(r) for r in periodic_runs.runs_of(np.array(w, dtype=np.int64), least, exponent).tolist()] == brute_runs(w, least, exponent)


def test_listing_leaves_in_parts(monkeypatch):
    w = np.array([0, 1, 0, 0, 1, 0, 1, 0] * 40, dtype=np.int64)
    whole = periodic_runs.runs_of(w, 2, 2).tolist()
    monkeypatch.setattr(periodic_runs, "LISTED", 16)
    assert periodic_runs.runs_of(w, 2, 2).tolist() == whole == [list(r) for r in brute_runs(w.tolist(), 2, 2)]


def test_runs_of_documents(spark):
    rows = [(1, "a b a b a b a b c", None), (1, "a b a b a b a b c", None), (None, "x " * 6, None), (2, None, None), (3, "", None), (4, "no run here at all", None), (5, "k " * 200_000, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter(tuple(r) for r in periodic_runs.periodic_runs(docs).collect())
    assert got == Counter({(1, 0, 8, 2): 2, (None, 0, 6, 1): 1, (5, 0, 200_000, 1): 1})
    out = periodic_runs.collapse_runs(docs.withColumns({"row": F.lit("own"), "kept": F.lit("own")}))
    assert out.columns == [*docs.columns, "row", "kept"]
    assert Counter(r["text"] for r in out.collect()) == Counter(["a b c", "a b c", "x", None, "", "no run here at all", "k"])
    assert periodic_runs.runs_digest(spark.createDataFrame([], DOCS)).collect() == []


def test_runs_digest(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) + rng.choice(["", "\n", "\x0b x y"]), None) for i in range(300)] + [(900, None, None), (901, "", None), (None, "a b " * 6, None), (7, "twice", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_periodic_runs(spark, str(tmp_path))

    def expected(i, text):
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (x - a) % p] for x in range(a, n)]
        runs = brute_runs(words)
        gone = {x for s, m, q in runs for x in range(s + q, s + m)}
        best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
        told = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
        return (i, len(runs), *told, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(w for x, w in enumerate(words) if x not in gone).encode()).hexdigest())

    assert Counter(tuple(r) for r in out.collect()) == Counter(expected(i, t) for i, t, _ in rows)
    assert sum(r[1] > 0 for r in map(tuple, out.collect())) > 10


# ---------------------------------------------------------------- mixing


def mixed_rows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 400))), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


def test_the_draw_decides_what_is_taken(spark, monkeypatch):
    docs = mixed_rows(spark)
    monkeypatch.setattr(mixing, "WORDS_PER_SHARD", 20_000)
    key = lambda r: (r["doc_id"], r["taken"])
    first = sorted(map(key, mixing.mixed_documents(docs).collect()))
    assert first == sorted(map(key, mixing.mixed_documents(docs.repartition(7)).collect()))
    draws = mixing.shard_draws
    monkeypatch.setattr(mixing, "shard_draws", lambda plan, seed: draws(plan, seed + 1))  # another draw, the same permutations
    second = sorted(map(key, mixing.mixed_documents(docs).collect()))
    assert first != second
    words = Counter(str(r["source"]) for r in mixing.mixed_shards(docs).collect() for _ in range(r["n_words"]))
    taken = Counter()
    for r in mixing.mixed_documents(docs).collect():
        taken[str(r["source"])] += r["taken"]
    assert words == taken


def test_draws_keep_to_targets_and_caps(spark, monkeypatch):
    docs = mixed_rows(spark)
    for per_shard in (5_000, 1 << 20):
        monkeypatch.setattr(mixing, "WORDS_PER_SHARD", per_shard)
        out = mixing.mixed_documents(docs).collect()
        assert all(r["taken"] <= 2 * r["size"] for r in out)
        by = defaultdict(int)
        for r in out:
            by[str(r["source"]), r["target"]] += r["taken"]
        assert all(abs(n - target) <= 0.02 * target + 300 for (_, target), n in by.items()), dict(by)
    monkeypatch.setattr(mixing, "WORDS_PER_SHARD", 5_000)
    totals = Counter()
    for r in mixing.shard_counts(docs).collect():
        totals[r["shard"]] += r["slots"]
    assert len(totals) > 10 and max(totals.values()) - min(totals.values()) <= 4  # a capped source may leave slots empty


# ---------------------------------------------------------------- licences


@pytest.fixture(scope="module")
def scan():
    model, rolling = licenses.train_model([]), licenses._rolling()
    return lambda text: list(licenses.classify(text.encode(), model, rolling))


def wrapped(notice, width):
    words = notice.split()
    return [" ".join(words[i : i + width]) for i in range(0, len(words), width)]


def test_notices_are_found_wherever_pieces_end(scan):
    """A notice on one line, or a word a line, at every place around the end of a piece of 1 MiB; and in one line longer than a piece."""
    notice = licenses.TEMPLATES["mit"][1]
    for shift in range(0, 260, 7):
        before = ("word " * 210_000)[: (1 << 20) - shift]
        for lines in ([notice], wrapped(notice, 1)):
            assert [(r[0], r[1], r[2], r[5]) for r in scan("\n".join([before, *lines, "end"]))] == [(1, len(lines), "mit", 1.0)]
        assert [(r[0], r[1], r[3]) for r in scan(f"{before} {notice} and on") if r[2] == "mit"] in ([(0, 0, "mit")], [])
    pieces = list(licenses.overlapping(b"one two three four five", 6))
    assert pieces[0] == (0, 7) and pieces[-1][1] == 23 and all(b[0] < a[1] <= b[1] for a, b in zip(pieces, pieces[1:]))


def test_notices_are_found_at_any_width(scan):
    rng, filler = random.Random(1), [w for s in licenses.PROSE for w in s.split()]
    missed = []
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for width in range(1, 8):
                lines = wrapped(notice, width)
                text = [" ".join(rng.choice(filler) for _ in range(10)), *lines, " ".join(rng.choice(filler) for _ in range(10))]
                if not any(r[2] == family and r[0] <= len(lines) and r[1] >= 1 for r in scan("\n".join(text))):
                    missed.append((family, width, notice))
    assert len(missed) <= 2 and all(len(n.split()) < 6 for *_, n in missed), missed


def test_licences_by_brute_force(scan):
    """Every run of lines that as one line is a confirmed notice is met by a confirmed paragraph of the scan."""
    rng, filler = random.Random(3), [w for s in licenses.PROSE for w in s.split()]
    model, rolling = licenses.train_model([]), licenses._rolling()
    met = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.5:
                notice = rng.choice(rng.choice(list(licenses.TEMPLATES.values())))
                lines += wrapped(" ".join(w for w in notice.split() if rng.random() > 0.05), rng.randint(1, 9))
            elif kind < 0.6:
                lines.append("")
            else:
                lines += wrapped(" ".join(rng.choice(filler) for _ in range(rng.randint(1, 30))), rng.randint(1, 9))
        found = [r for r in scan("\n".join(lines)) if r[2] != "unknown"]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if not all(x.strip() for x in lines[i : j + 1]):
                    break
                joined = " ".join(lines[i : j + 1])
                _, p = model.probabilities(*licenses.line_features(joined.encode(), rolling))
                if not len(p) or p.max() < model.least or (family := model.families[int(p.argmax())]) == "unknown":
                    continue
                pairs = licenses.word_pairs(joined)
                if max(len(pairs & t) / len(t) for t in licenses._TEMPLATE_PAIRS[family]) >= licenses.CONFIRMED_AT:
                    met.append(any(r[0] <= j and r[1] >= i for r in found))
    assert len(met) > 300 and np.mean(met) > 0.98, (len(met), np.mean(met))


def test_license_rows_of_awkward_tables(spark):
    text = "Released under the MIT License."
    rows = [(1, text, "x"), (1, text, "x"), (None, text, None), (2, None, None), (3, "", None), (4, "\n\n  \n", None), (5, "---\n" + text + "\n---", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in ("family", "paragraph", "probability")})
    got = Counter((r["doc_id"], r["paragraph"], r["last_line"], r["family"]) for r in licenses.license_paragraphs(docs).collect())
    assert got == Counter({(1, 0, 0, "mit"): 2, (None, 0, 0, "mit"): 1, (5, 1, 1, "mit"): 1})
    assert licenses.license_paragraphs(docs.limit(0)).collect() == []


# ---------------------------------------------------------------- columns and rows of any kind


def same_rows(a, b):
    return Counter(map(str, a.collect())) == Counter(map(str, b.collect()))


def test_digests_ignore_columns_of_any_name(spark):
    rows = [(i, t, "xx" if i % 2 else "yy", f"s{i % 3}") for i, t in enumerate(["some words in a row of a text"] * 3 + ["other words stand here, and more of them", "", "ab", "k " * 40] * 4)] + [(None, None, None, None), (2, "some words in a row of a text", "xx", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = docs.withColumns({name: F.lit(f"own {name}") for name in ("doc", "size", "words", "n_tokens", "score", "shard", "slot", "row", "label", "h", "n", "key", "place", "start", "runs", "token", "count", "task")})
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    for digest in (lambda d: token_counts.token_counts(d, path), language_id.language_digest, lm_scoring.scored_documents, mixing.mixing_digest, sharding.sharding_digest, periodic_runs.runs_digest, substring_dedup.substring_digest, jaccard_join.jaccard_digest, line_dedup.line_dedup_digest):
        assert same_rows(digest(docs), digest(clash)), digest


def test_vectors_of_awkward_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, v, 1), (3, v, 1), (3, v, 1), (5, w, 1), (6, v, 2), (7, None, 1), (8, [0.0] * 3, 1), (9, v, None), (10, [math.nan, 0.0, 0.0], 1), (11, v[:2], 1)]
    table = spark.createDataFrame(rows, kind)
    out = embedding_dedup.near_duplicates(table)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect())
    assert sum(got.values()) == len(rows)
    assert got[3, 2, 3, True] == 2 and got[5, 0, 5, True] == 1 and got[6, 0, 6, True] == 1
    assert all(got[i, 0, i, True] == 1 for i in (7, 8, 9, 10, 11))
    assert [(k[1], k[2]) for k in got if k[0] is None] == [(2, 3)]
    clash = table.withColumns({name: F.lit("own") for name in ("unit", "size", "p0", "times", "set_id", "component", "tile", "root")})
    assert same_rows(embedding_dedup.near_duplicates(clash), out)


def test_contamination_of_rows_without_an_id(spark):
    text = "a passage of the benchmark that stands in some of the documents word for word"
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "nothing of it at all is here"), (None, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (4, text), (4, text), (5, None)], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontamination.contaminated_windows(docs, bench).collect())
    assert got == Counter({(None, None): 1, (None, 4): 1, (1, None): 1, (1, 4): 1})
