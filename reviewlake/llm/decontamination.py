"""Benchmark decontamination with DataFrame functions only.

Windows as long as a benchmark item are cut from a document, at whatever start, if they hold as many
shingles of items of that length as a window at the threshold must; which items is left open. Windows and items get a
64-bit SimHash of their weighted shingles. The index over the items' fingerprints has five blocks of 12 or 13
bits and holds, for each block, all values within three bits of the item's; a window looks up its own five
values. Two fingerprints within the radius of 19 differ by three bits or fewer on one block, so all such pairs
are found; unrelated ones of one length meet with a chance of about 0.23. They are verified by exact weighted
Jaccard similarity of their shingle counts.

At similarity 0.8 two fingerprints differ in about 9.7 bits with deviation 2.9: a radius of 19 keeps 99.9% of
the pairs at exactly the threshold (measured in the tests) and all but a few in a million above 0.85.

Words are runs of characters other than space and 09-0D, lower-cased. Shingles have five words; shorter items and
documents are one shingle. For items of fewer than five words, documents are cut into shingles of their length as
well, of which the first match is the best window. A shingle's weight is how often it occurs. A document shorter than the
item is one window. Null or empty texts, items and documents, match nothing; null ids are kept as
ids; repeated rows of a document or an item give one row a pair. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_enough

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BITS = 64
BLOCKS = 5
#: Distinct shingles of items, and keys of documents with windows, up to which they are broadcast (16 bytes each); beyond, joins shuffle.
BROADCAST_SHINGLES = 500_000
BROADCAST_KEYS = 500_000


def word_hash_array(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles_of(words: str, k: int = SHINGLE) -> Column:
    """Array of hashes of the k-word shingles of an array column of word hashes, in order."""
    parts = ", ".join(f"get({words}, i + {j})" for j in range(k))
    return F.expr(
        f"""CASE WHEN size({words}) = 0 THEN array()
            WHEN size({words}) <= {k} THEN array(xxhash64({words}))
            ELSE transform(sequence(0, size({words}) - {k}), i -> xxhash64({parts})) END"""
    ).cast("array<long>")


def _simhash() -> list[Column]:
    """Sums of +weight or -weight per bit over rows (shingle, weight)."""
    return [F.sum(F.when(F.expr(f"getbit(shingle, {b})") == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(BITS)]


def _fingerprint() -> Column:
    bits = [F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _edges() -> list[tuple[int, int]]:
    return [(BITS * i // BLOCKS, BITS * (i + 1) // BLOCKS) for i in range(BLOCKS)]


def _value(a: int, z: int) -> Column:
    return F.shiftrightunsigned("fingerprint", a).bitwiseAND(F.lit((1 << (z - a)) - 1))


def _blocks() -> Column:
    """(block number, block value) of a fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("no"), _value(a, z).alias("value")) for i, (a, z) in enumerate(_edges())])


def _neighbours(radius: int) -> Column:
    """(block number, value) of all values within radius div BLOCKS of each block: fingerprints within the radius
    differ by no more than that on one block at least, so one of them meets it there."""
    def of(no: int, a: int, z: int) -> Column:
        masks = F.filter(F.sequence(F.lit(0), F.lit((1 << (z - a)) - 1)), lambda m: F.bit_count(m) <= radius // BLOCKS)
        return F.transform(masks, lambda m: F.struct(F.lit(no).alias("no"), _value(a, z).bitwiseXOR(m.cast("long")).alias("value")))

    return F.flatten(F.array(*[of(no, a, z) for no, (a, z) in enumerate(_edges())]))


def _starts(similarity: float) -> Column:
    """Starts of all windows that hold enough of the sorted ``places`` to reach ``similarity``.

    Shared weight c must be at least s (a + b) / (1 + s) for totals a and b, and a window shares at most
    as much as it holds places. A window with so many holds a run of that many neighbouring places.
    """
    size = f"greatest(1, least(n_words, doc_words) - {SHINGLE - 1})"
    need = f"greatest(1, cast(ceil({similarity} * ({size} + greatest(1, n_words - {SHINGLE - 1})) / (1 + {similarity}) - 1e-6) as int))"
    low, high = f"greatest(0, places[i + {need} - 1] - {size} + 1)", "least(places[i], greatest(0, doc_words - n_words))"
    runs = f"transform(sequence(0, size(places) - {need}), i -> CASE WHEN {low} <= {high} THEN sequence({low}, {high}) ELSE cast(array() as array<int>) END)"
    return F.expr(f"CASE WHEN size(places) >= {need} THEN array_distinct(flatten({runs})) END")


def candidate_windows(texts: DataFrame, of_items: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """(doc_id, text_hash, start, n_words): windows as long as some item that hold enough shingles of items of that length.

    Which item a window is like is not asked here: shingles are looked up in a set of (length, shingle). A window at the
    threshold holds as many, so none is lost, and text far from the benchmark is not fingerprinted.
    """
    hashed = texts.select("doc_id", "text_hash", word_hash_array(F.col("text")).alias("words"))
    known = of_items.select("n_words", "shingle").distinct()
    few = small_enough(known, BROADCAST_SHINGLES)
    group = ["doc_id", "text_hash", "doc_words", "n_words"]

    def held(k: int, wanted: DataFrame) -> DataFrame:
        exploded = hashed.select("doc_id", "text_hash", F.size("words").alias("doc_words"), F.posexplode(shingles_of("words", k)).alias("place", "shingle"))
        return exploded.join(F.broadcast(wanted) if few else wanted, "shingle")

    places = held(SHINGLE, known.where(F.col("n_words") >= SHINGLE)).select(*group, "place")
    for k in [r["n_words"] for r in known.where(F.col("n_words") < SHINGLE).select("n_words").distinct().collect()]:  # four at most
        places = places.unionByName(held(k, known.where(F.col("n_words") == k)).groupBy(*group, "shingle").agg(F.min("place").alias("place")).drop("shingle"))
    places = places.groupBy(*group).agg(F.array_sort(F.collect_set("place")).alias("places"))
    return scratch.keep(places.select("doc_id", "text_hash", "n_words", F.explode(_starts(similarity)).alias("start")).distinct(), "cuts")


def near_items(prints: DataFrame, item_prints: DataFrame, radius: int) -> DataFrame:
    """(n_words, fingerprint, item_id, version, item_total, hamming): items within ``radius`` of each window fingerprint.

    Equal fingerprints, as of copies of a passage, are sought once.
    """
    left = prints.select("n_words", "fingerprint").distinct().select("n_words", "fingerprint", F.explode(_blocks()).alias("block")).select("n_words", "fingerprint", "block.*")
    right = item_prints.select("item_id", "version", "n_words", "item_total", F.col("fingerprint").alias("item_print"), F.explode(_neighbours(radius)).alias("block"))
    near = left.join(right.select("*", "block.*").drop("block"), ["n_words", "no", "value"])
    near = near.withColumn("hamming", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))).where(F.col("hamming") <= radius)
    return near.select("n_words", "fingerprint", "item_id", "version", "item_total", "hamming").distinct()


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity) of the best window of each pair at or above ``similarity``."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    items = benchmark.select("item_id", word_hash_array(F.col("text")).alias("words")).where("size(words) > 0").dropDuplicates(["item_id", "words"])
    items = items.select("item_id", F.xxhash64("words").alias("version"), F.size("words").alias("n_words"), shingles_of("words").alias("shingles"))
    items = scratch.keep(items, "items")
    of_items = items.select("item_id", "version", "n_words", F.explode("shingles").alias("shingle"))
    window = ["doc_id", "text_hash", "start", "n_words"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    cuts = candidate_windows(texts, of_items, scratch, similarity)

    # Only places have travelled so far. Texts with windows are fetched by their keys, and meet their windows then.
    spans = cuts.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    spans = scratch.keep(spans.select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), "spans"), "spans")
    keys = spans.select("c_doc", "c_hash")
    same = F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("text_hash") == F.col("c_hash"))
    fetched = texts.join(F.broadcast(keys) if small_enough(keys, BROADCAST_KEYS) else keys, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    held = fetched.select("doc_id", "text_hash", word_hash_array(F.col("text")).alias("words")).join(spans, same).drop("c_doc", "c_hash")
    cut = held.select("doc_id", "text_hash", "words", F.explode("spans").alias("span")).select("doc_id", "text_hash", "span.*", F.expr("slice(words, span.start + 1, span.n_words)").alias("piece"))
    pieces = cut.select(*window, F.explode(shingles_of("piece")).alias("shingle"))
    of_windows = scratch.keep(pieces.groupBy(*window, "shingle").agg(F.count("*").alias("weight")), "windows")
    prints = of_windows.groupBy(*window).agg(*_simhash(), F.sum("weight").alias("total")).select(*window, "total", _fingerprint().alias("fingerprint"))
    prints = scratch.keep(prints, "prints")
    item_weights = of_items.groupBy("item_id", "version", "n_words", "shingle").agg(F.count("*").alias("weight"))
    item_prints = item_weights.groupBy("item_id", "version", "n_words").agg(*_simhash(), F.sum("weight").alias("item_total"))
    item_prints = item_prints.select("item_id", "version", "n_words", "item_total", _fingerprint().alias("fingerprint"))
    # Both sides grow with the documents: no broadcast, however well they pack.
    near = prints.hint("merge").join(near_items(prints, item_prints, radius), ["n_words", "fingerprint"]).drop("fingerprint")

    # Exact weighted Jaccard: sum of minima over sum of maxima, the latter from the totals.
    doc_side = of_windows.select(*[F.col(c).alias(f"w_{c}") for c in window], "shingle", F.col("weight").alias("w"))
    on = F.col("doc_id").eqNullSafe(F.col("w_doc_id"))
    for c in window[1:]:
        on = on & (F.col(c) == F.col(f"w_{c}"))
    ours = item_weights.select(F.col("item_id").alias("j_item"), F.col("version").alias("j_version"), F.col("shingle").alias("j_shingle"), F.col("weight").alias("v"))
    same_item = (F.col("shingle") == F.col("j_shingle")) & F.col("item_id").eqNullSafe(F.col("j_item")) & (F.col("version") == F.col("j_version"))
    common = near.hint("merge").join(doc_side, on).join(ours, same_item).groupBy(*window, "item_id", "version", "total", "item_total", "hamming").agg(F.sum(F.least("w", "v")).alias("common"))
    score = F.col("common") / (F.col("total") + F.col("item_total") - F.col("common"))
    verified = common.withColumn("similarity", score).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct(F.col("start").alias("start_word"), "n_words", "hamming"), F.struct("similarity", -F.col("start"))).alias("at")
    return verified.groupBy("doc_id", "item_id").agg(best, F.max("similarity").alias("similarity")).select("doc_id", "item_id", "at.*", "similarity")


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, all columns unchanged."""
    leaks = contaminated_windows(docs, benchmark, similarity).select(F.col("doc_id").alias("leak_id")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak_id"]), "left_anti")
