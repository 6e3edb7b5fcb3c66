"""Language ID by nearest centroid over hashed TF-IDF character n-grams.

Several spherical k-means centroids per language are fitted on a bounded, deterministic sample of
labelled rows (``per_language`` rows of each language with the smallest id hashes, whole texts);
every document is then compared with all centroids by cosine. A document is rejected when its
best cosine lies under a floor that is calibrated on training texts of similar length, so that
short but clean texts stay.

Defined results: a null text or one without a letter gets ``und``, score 0 and is rejected; rows
without id or language are not learned from; with nothing to learn from every text is ``und``.
Ties go to the language that sorts first. Extra columns are ignored. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, batch_of, column_of, small_enough

DIMENSIONS = 1 << 13
ORDERS = (1, 2, 3)
PER_LANGUAGE = 300
CENTROIDS = 4
PIECE = 1 << 18
#: Languages up to which their counts and the chosen ids are broadcast; beyond, the joins are left to Spark.
MOST_LANGUAGES = 1000
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
_ASCII_LETTER = np.array([chr(i).isalpha() for i in range(0x80)])


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of character n-grams of the whole lower-cased text, other ASCII than letters as one space, in pieces of bounded size."""
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    for start in range(0, len(text), PIECE):
        piece = text[max(0, start - 2) : start + PIECE].lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = np.where((codes >= 0x80) | _ASCII_LETTER[np.minimum(codes, 0x7F)], codes, np.uint32(0x20))
        space = codes == 0x20
        codes = codes[~(space & np.roll(space, 1))]
        h = np.zeros(len(codes), dtype=np.uint32)
        for n in range(1, 1 + max(ORDERS)):
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
            if n in ORDERS:
                slot = ((h * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.int64)
                out += np.bincount(slot, minlength=DIMENSIONS)
    return out


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sims = self.vectors(counts) @ self.centroids.T
        best = sims.argmax(axis=1)
        return self.owner[best], np.clip(sims[np.arange(len(sims)), best], 0.0, 1.0)


def _length_class(n: int) -> int:
    return min(max(int(n).bit_length() - 4, 0), 9)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first starts; deterministic."""
    k = min(k, len(x))
    picked = [0]
    closest = x @ x[0]
    for _ in range(1, k):
        picked.append(int(closest.argmin()))
        closest = np.maximum(closest, x @ x[picked[-1]])
    c = x[picked].copy()
    for _ in range(rounds):
        who = (x @ c.T).argmax(axis=1)
        for j in range(k):
            if (who == j).any():
                m = x[who == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit_model(rows: list[tuple[str, str]], centroids: int = CENTROIDS, slack: float = 0.5) -> Model | None:
    """Model of (language, text) rows; None without a usable row.

    Floors: for each length class, ``slack`` times the lowest cosine that cuts of training texts
    of that length reach, so nothing like the training texts is rejected.
    """
    rows = [(lang, text) for lang, text in rows if text and _LETTER.search(text)]
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    counts = np.stack([ngram_counts(text) for _, text in rows])
    df = (counts > 0).sum(axis=0)
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    model = Model(languages, np.empty(0, dtype=int), np.empty((0, DIMENSIONS), dtype=np.float32), idf, np.zeros(10))
    vectors = model.vectors(counts)
    label = np.array([languages.index(lang) for lang, _ in rows])
    found = [_clusters(vectors[label == i], centroids) for i in range(len(languages))]
    model.centroids = np.concatenate(found).astype(np.float32)
    model.owner = np.repeat(np.arange(len(languages)), [len(c) for c in found])
    lowest = np.ones(10)
    for size in (16, 24, 48, 96, 192, 384, 768, 1536, 3072, 6144):
        cuts = [text[(7 * i) % max(1, len(text) - size) :][:size] for i, (_, text) in enumerate(rows[:: max(1, len(rows) // 200)])]
        cuts = [cut for cut in cuts if _LETTER.search(cut)]
        if cuts:
            sims = model.nearest(np.stack([ngram_counts(cut) for cut in cuts]))[1]
            for cut, sim in zip(cuts, sims):
                i = _length_class(len(cut))
                lowest[i] = min(lowest[i], sim)
    model.floors = slack * np.minimum.accumulate(lowest[::-1])[::-1]
    model.floors[0] = 0.0  # a few characters say too little to reject
    return model


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` rows of each language: those with the smallest id hashes, of equal ids the least text.

    Ids are chosen without their texts. Languages are counted first, so only about twice that many ids of
    a language reach the window; the texts come from a second scan, of the chosen ids alone.
    """
    fit = docs.where("lang is not null and text is not null and doc_id is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    ids = fit.select("lang", "doc_id", (F.shiftrightunsigned(F.xxhash64(F.col("doc_id")), 11) / float(1 << 53)).alias("u"))
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
    few = small_enough(counts, MOST_LANGUAGES)
    near = ids.join(F.broadcast(counts) if few else counts, "lang").where(F.col("u") * F.col("n") <= 2.0 * per_language + 20).select("lang", "doc_id", "u").distinct()
    order = Window.partitionBy("lang").orderBy("u", "doc_id")
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select(F.col("lang").alias("c_lang"), F.col("doc_id").alias("c_id"), "u")
    chosen = Scratch(docs.sparkSession, "language").keep(chosen, "chosen")
    texts = fit.join(F.broadcast(chosen) if few else chosen, (F.col("lang") == F.col("c_lang")) & (F.col("doc_id") == F.col("c_id")))
    texts = texts.groupBy("lang", "u", "doc_id").agg(F.min("text").alias("text"))
    return [(r["lang"], r["text"]) for r in texts.orderBy("lang", "u", "doc_id").collect()]


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, text_hash long"


def _predict(model: Model | None):
    def run(batches):
        for batch in batches:
            ids, texts, held, hashes = (column_of(batch, c) for c in ("doc_id", "text", "held_out", "text_hash"))
            n = len(ids)
            langs, scores, rejected = [UNKNOWN] * n, [0.0] * n, [True] * n
            block: list[tuple[int, int, np.ndarray]] = []

            def flush():
                if block:
                    owner, sims = model.nearest(np.stack([c for _, _, c in block]))
                    for (i, length, _), o, s in zip(block, owner, sims):
                        langs[i], scores[i], rejected[i] = model.languages[o], float(s), bool(s < model.floors[_length_class(length)])
                    block.clear()

            if model is not None:
                for i, value in enumerate(texts):
                    text = value.as_py()
                    if text and _LETTER.search(text):
                        block.append((i, len(text), ngram_counts(text)))
                        if len(block) == 64:
                            flush()
                flush()
            yield batch_of(PREDICTED, [ids, held, langs, scores, rejected, hashes])

    return run


def predict_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, text_hash) for every row; fits a model unless one is given."""
    model = model or fit_model(training_rows(docs, per_language))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0"), F.lit(False)).alias("held_out"),
        F.col("text"),
        F.xxhash64("text").alias("text_hash"),
    )
    return arrow_map(rows, _predict(model), PREDICTED)


def language_digest(docs: DataFrame) -> DataFrame:
    """Contract columns, then whether the distance floor rejects the text."""
    return predict_languages(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def accepted_documents(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Rows of ``docs`` that are not rejected, all columns unchanged; one pass, no join. Only texts go to Python."""
    model = fit_model(training_rows(docs, per_language))

    @F.arrow_udf("boolean")
    def accepted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            keep, counts, slots = [False] * len(column), [], []
            for i, value in enumerate(column):
                text = value.as_py()
                if model is not None and text and _LETTER.search(text):
                    counts.append(ngram_counts(text))
                    slots.append((i, len(text)))
                if len(counts) == 64:
                    _mark(model, counts, slots, keep)
            _mark(model, counts, slots, keep)
            yield pa.array(keep, type=pa.bool_())

    return docs.where(accepted(F.col("text")))


def _mark(model: Model | None, counts: list, slots: list, keep: list[bool]) -> None:
    if counts:
        for (i, length), s in zip(slots, model.nearest(np.stack(counts))[1]):
            keep[i] = bool(s >= model.floors[_length_class(length)])
        counts.clear()
        slots.clear()
