"""Mixing sources to target weights, with DataFrame functions only.

A source's words are laid end to end (documents in a fixed order) and packed into blocks of one
fixed length per source. Every output shard has the same number of slots and draws how many of them each source fills: of its
expected share e, e less ``SPREAD`` * sqrt(e) is sure, and the slots that remain are one multinomial draw by the shares left over, which has
the mean of a plain multinomial and keeps a source's total near its target even where shards are few. What is drawn decides what is taken: the shard's slots of a source
follow those drawn by the shards before it; slot j maps to block perm(j) of its epoch by a keyed swap-or-not permutation of the block
indexes, and slots meet the blocks in a join on (source, block). A slot that would be a third pass over its source stays
empty. ``mixed_shards`` is the mix itself, with its words; the documents' figures count the words of each block by the same
slots and the same join, without texts.

Running sums are taken in two levels (within a hashed chunk of a source, then over the chunk
sums), so a source that holds a third of all rows is spread over many tasks.

Defined results: size is the number of runs of characters other than space and 09-0D, 0 for a
null text; a null source is a source of its own and sorts last; a document without words is
never taken; repeated rows each count; null doc_ids are rows like any other; extra columns are
ignored here. The same input and seed give the same mix, however it is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE_CLASS, Scratch

WEIGHTS = (3, 1, 2)
BLOCK = 256
BLOCKS_AT_LEAST = 2048
CHUNKS = 1024
ROUNDS = 16
WORDS_PER_SHARD = 1 << 20
#: Shards whose draws are made in one task; equal shares of all places that a draw can fall on.
GROUP = 1 << 14
CELLS = 1 << 12
#: Part of a source's share of a shard that is drawn, in standard deviations of a plain draw.
SPREAD = 1.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ASCII_SPACE_CLASS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source_key, source_size, target) of (source_key, source_size); an empty key stands for null.

    target = min(level * weight, most * size) with the one level at which targets add up to
    share * all sizes: handing a capped source's excess to the others by weight ends there. Sources
    are ordered by the level at which they cap; each prefix of them gives a candidate level.
    The table has one row a source, so one task orders it.
    """
    by_name = Window.orderBy(F.col("source_key") == "", "source_key")
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("caps_at", F.col("cap") / F.col("w"))
    before = Window.orderBy("caps_at", F.col("source_key") == "", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("total", share * F.sum("source_size").over(every)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    )
    # The first source, in that order, that does not cap at its prefix's level sets the level of all that follow.
    ranked = ranked.withColumn("place", F.row_number().over(Window.orderBy("caps_at", F.col("source_key") == "", "source_key")))
    free = F.min(F.when(F.col("level") <= F.col("caps_at"), F.struct("place", "level"))).over(every)["level"]
    return ranked.select("source_key", "source_size", F.least(F.coalesce(free * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Keyed swap-or-not permutation of 0..n-1: a bijection for every n."""

    def step(value: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, key), n) - value, n)
        swap = F.pmod(F.xxhash64(r, key, F.greatest(value, partner)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def _plan(sizes: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """Targets with each source's block length, number of blocks and how many block slots the target asks for."""
    targets = source_targets(sizes, weights, share)
    targets = targets.withColumn("length", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"source_size div {BLOCKS_AT_LEAST}"))).cast("long"))
    targets = targets.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    return targets.withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))


def shard_draws(plan: DataFrame, seed: int, most: float = 2.0) -> DataFrame:
    """(source_key, blocks, shard, drawn, first_slot): how many slots of each output shard a source fills, and the first of them.

    A shard draws its open slots one by one: a draw is a place between 0 and their number, and falls in the piece of the source whose
    part left over lies there. Pieces and draws meet by cell, an equal share of all places. Shards are dealt out in groups, so that a few
    rows become many in many tasks.
    """
    by_name = Window.orderBy("source_key")  # sums of doubles depend on their order
    every, so_far = by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by_name.rowsBetween(Window.unboundedPreceding, -1)
    shares = plan.where("slots > 0").withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("target").over(every) / WORDS_PER_SHARD)).cast("long"))
    shares = shares.withColumn("all_slots", F.sum("slots").over(every)).withColumn("per_shard", F.greatest(F.lit(1.0), F.floor(F.col("all_slots") / F.col("shards"))))
    shares = shares.withColumn("expected", F.col("per_shard") * F.col("slots") / F.col("all_slots")).withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("expected") - SPREAD * F.sqrt("expected"))).cast("long")).withColumn("rest", F.col("expected") - F.col("sure"))
    shares = shares.withColumn("open", F.round(F.sum("rest").over(every)).cast("long")).withColumn("low", F.coalesce(F.sum("rest").over(so_far), F.lit(0.0)))
    shares = shares.withColumn("high", F.coalesce(F.lead("low").over(by_name), F.col("open").cast("double")))

    def over_shards(rows: DataFrame, *keys: str) -> DataFrame:
        groups = rows.select(*keys, "shards", F.explode(F.expr(f"sequence(0L, (shards - 1) div {GROUP}L)")).alias("g")).repartition(_tasks(plan), *keys, "g")
        return groups.select(*keys, F.explode(F.expr(f"sequence(g * {GROUP}L, least(shards, (g + 1) * {GROUP}L) - 1)")).alias("shard"))

    certain = over_shards(shares.where("sure > 0"), "source_key", "blocks", "sure").withColumnRenamed("sure", "drawn")
    draws = over_shards(shares.groupBy("open").agg(F.max("shards").alias("shards")).where("open > 0"), "open").select("open", "shard", F.explode(F.expr("sequence(1L, open)")).alias("draw"))
    draws = draws.withColumn("place", F.col("open") * (F.pmod(F.xxhash64(F.lit(seed + 1), "shard", "draw"), F.lit(1 << 52)) / F.lit(float(1 << 52))))
    cell = lambda place: F.least(F.lit(CELLS - 1), F.floor(place / F.col("open") * CELLS)).cast("int")
    pieces = shares.where("high > low").select("source_key", "blocks", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    picked = draws.withColumn("cell", cell(F.col("place"))).join(pieces, "cell").where("place >= low and place < high").select("source_key", "blocks", F.lit(1).cast("long").alias("drawn"), "shard")
    counts = certain.unionByName(picked).groupBy("source_key", "blocks", "shard").agg(F.sum("drawn").alias("drawn"))
    before = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first_slot", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
    passes = F.floor(F.lit(most) * F.col("blocks"))
    return counts.withColumn("drawn", F.least(F.col("drawn"), passes - F.col("first_slot"))).where("drawn > 0")


def _tasks(df: DataFrame) -> int:
    """A stated number of partitions, which adaptive execution does not merge: a few rows become many in these tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def drawn_slots(plan: DataFrame, seed: int) -> DataFrame:
    """(source_key, shard, slot, block): a shard's slots of a source follow those of the shards before; each takes a block."""
    draws = shard_draws(plan, seed).repartition(_tasks(plan), "source_key", "shard")
    slots = draws.select("source_key", "blocks", "shard", F.explode(F.expr("sequence(first_slot, first_slot + drawn - 1)")).alias("slot"))
    key = F.xxhash64(F.lit(seed), F.col("source_key"), F.expr("slot div blocks"))
    return slots.select("source_key", "shard", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), key).alias("block"))


def _key() -> Column:
    """Never null, so that joins and groups share one partitioning."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("source_key")


def _source() -> Column:
    return F.when(F.col("source_key") != "", F.expr("substring(source_key, 2)")).alias("source")


def _laid_out(docs: DataFrame, weights: tuple[int, ...], share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the place of their first word in their source, and the plan of the sources. Texts are read once, for their sizes."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _key(), word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(CHUNKS)).cast("int"))
    rows = scratch.keep(rows, "sizes")
    by_chunk = Window.partitionBy("source_key", "chunk").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("source_key", "chunk").agg(F.sum("size").alias("chunk_size"))
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(by_chunk), F.lit(0)))
    over_chunks = Window.partitionBy("source_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("chunk_start", F.coalesce(F.sum("chunk_size").over(over_chunks), F.lit(0)))
    plan = scratch.keep(_plan(chunks.groupBy("source_key").agg(F.sum("chunk_size").alias("source_size")), weights, share), "plan")
    starts = chunks.join(plan.select("source_key", "length"), "source_key").drop("chunk_size")
    placed = rows.join(starts, ["source_key", "chunk"]).withColumn("start", F.col("chunk_start") + F.col("before"))
    return scratch.keep(placed.select("doc_id", "text_hash", "source_key", "size", "length", "start"), "placed"), plan


def _pieces(placed: DataFrame) -> DataFrame:
    """The blocks' contents by place: (source_key, block, first, n) with the row's columns; words first .. first + n - 1 of the source."""
    spread = placed.where("size > 0").select("*", F.explode(F.expr("sequence(start div length, (start + size - 1) div length)")).alias("block"))
    first = "greatest(start, block * length)"
    return spread.select("*", F.expr(first).alias("first"), F.expr(f"least(start + size, (block + 1) * length) - {first}").alias("n")).drop("length")


def shard_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, seed: int = 42) -> DataFrame:
    """(source, shard, slots): the multinomial draw of each source's slots over the output shards."""
    return shard_draws(_laid_out(docs, weights, share, seed)[1], seed).select(_source(), "shard", F.col("drawn").alias("slots"))


def mixed_shards(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, seed: int = 42) -> DataFrame:
    """The mix: (shard, slot, source, block, n_words, text), one row per slot with the words of its block."""
    placed, plan = _laid_out(docs, weights, share, seed)
    texts = docs.select(F.col("doc_id").alias("t_id"), F.xxhash64("text").alias("t_hash"), "text").dropDuplicates(["t_id", "t_hash"])
    held = _pieces(placed).join(texts, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_hash") == F.col("t_hash")))
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    held = held.select("source_key", "block", F.struct("first", F.expr(f"array_join(slice({words}, int(first - start) + 1, int(n)), ' ')").alias("words"), "n").alias("piece"))
    blocks = held.groupBy("source_key", "block").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    out = drawn_slots(plan, seed).join(blocks, ["source_key", "block"])
    return out.select("shard", "slot", _source(), "block", F.aggregate("pieces.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"), F.array_join(F.col("pieces.words"), " ").alias("text"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words of the row that stand in the blocks of the mix: slots and blocks meet by index, as in
    ``mixed_shards``, and no text travels.
    """
    placed, plan = _laid_out(docs, weights, share, seed)
    times = drawn_slots(plan, seed).groupBy("source_key", "block").agg(F.count("*").alias("times"))
    pieces = _pieces(placed).hint("merge").join(times, ["source_key", "block"], "left")  # both grow with the table
    # A row's place in its source tells repeated rows apart.
    taken = pieces.groupBy("doc_id", "source_key", "size", "start").agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).alias("taken"))
    rest = placed.where("size = 0").select("doc_id", "source_key", "size", F.lit(0).cast("long").alias("taken"))
    every = taken.drop("start").unionByName(rest).join(plan.select("source_key", "source_size", "target"), "source_key")
    return every.select("doc_id", _source(), "size", "source_size", "target", "taken")


def mixing_digest(docs: DataFrame) -> DataFrame:
    """Contract columns, then the source."""
    return mixed_documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken", "source")
