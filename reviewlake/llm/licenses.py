"""License scans: a trained paragraph classifier, with an unknown class and template confirmation.

Presence of hashed word 1- and 2-grams feeds a sparse multinomial logistic regression over licence families and
``unknown``. It is trained in numpy on variants of notice templates (words dropped, prose around them, pieces as
line breaks leave them) and on prose without a notice: built-in sentences, and lines of a bounded sample of the corpus
itself (``SAMPLE`` rows with the smallest id hashes; lines that share a fifth of a template's word pairs are left
out). The probability a family must reach is calibrated on held-out prose of both kinds, of which at most
``FALSE_ALARMS`` may pass.

Lines are scored first, and where lines are short, a few windows of words from each line on (``WINDOWS``), across the line ends of a block
of non-blank lines: a notice may be wrapped at any width. What a family claims is a seed. Around it, as many lines of its block are
joined as hold twice the words of the longest template, and each template is sought there: the stretch
of at most twice its words that holds most of its word pairs. The lines of the family's best stretch are the paragraph, which is
classified again as a whole; where another family's template is closer and the classifier says so of its paragraph, it is that
family's. The template decides: with enough of its pairs found the family is confirmed; else a claimed line is ``unknown``, and ``nearest`` tells the family that the classifier named (a claimed window alone, without a line or a template, is
nothing). Words outside the trained features weigh nothing.

Texts are read in pieces of about 1 MiB for their features alone, each piece from the last word of the one before on, so that no
word, pair or line is lost at a cut; lines and notices are those of the whole text, wherever pieces end.

Defined results: null and empty texts have no paragraphs; one row per identified paragraph, its lines counted from 0;
repeated rows give their rows each; equal probabilities go to the family that sorts first, equal similarities to
the earlier template; null ids are kept and not sampled; extra columns are ignored; empty tables stay empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, arrow_map, batch_of, column_of, mix, text_bytes

UNKNOWN = "unknown"
BITS = 18
FALSE_ALARMS = 0.001
CONFIRMED_AT = 0.6
VARIANTS = 24
#: Words from a line on that are scored together where the line is shorter: the fewest lines that hold so many.
WINDOWS = (5, 9, 14, 24)
#: Rows of the corpus whose lines serve as prose, and lines taken of them at most.
SAMPLE = 400
SAMPLE_LINES = 4000
SCAN = "doc_id long, paragraph int, last_line int, family string, nearest string, probability double, template_similarity double, confirmed boolean"

# Notices of public licences, one or more per family.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.", "Licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal, dedicated to the public domain."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}

# Prose that names things close to licences without being a notice, for the unknown class.
PROSE = [
    "The driver lost a license after the second offence and had to walk to work for a month.",
    "Please read the version notes before you use this software in a public place.",
    "The work of the foundation is free for all visitors and open to the general public.",
    "A copy of the report was sent to every person who had asked for one in the past year.",
    "The author said that the source of the story could not be named in the file.",
    "Under the terms of the agreement the two parties share the costs of the building.",
    "Conditions in the north were cold and the roads were closed without warning.",
    "They released the new album under a different name and sold it at concerts.",
    "The commons was full of people reading, talking and eating in the sun.",
    "The patent office granted permission to build the machine after a long delay.",
    "No part of the garden had been changed since the house was sold.",
    "International rules require a permit for boats of this size in the harbour.",
    "She published three books and a great many papers on the history of law.",
    "All of the names in this list are in the order in which they were received.",
    "Version two of the plan is subject to review by the library and the museum.",
]

_WORD = np.array([chr(b).isalnum() if b < 0x80 else True for b in range(256)])
_SPACE_BYTES = re.compile(rb"[\x20\x09-\x0d]")
_PAIRS = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def words_of(piece: bytes, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of the words of a text."""
    data = np.frombuffer(piece, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return rolling.ranges(rolling.prefix(data), starts, ends), np.searchsorted(np.flatnonzero(data == 10), starts)


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def line_features(piece: bytes, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(line, feature) of the word 1- and 2-grams of a text; pairs do not cross lines."""
    h, line = words_of(piece, rolling)
    same = line[1:] == line[:-1]
    return np.concatenate([line, line[:-1][same]]), _feature(np.concatenate([h, _pair(h[:-1], h[1:])[same]]))


def overlapping(raw: bytes, size: int = Rolling.SEGMENT):
    """(start, end) of pieces of about ``size`` bytes; each begins with the last word of the one before."""
    start, n = 0, len(raw)
    while n - start > size:
        cut = _SPACE_BYTES.search(raw, start + size)
        end = cut.start() if cut else n
        yield start, end
        back = end
        while back > start + 1 and not _WORD[raw[back - 1]]:
            back -= 1
        while back > start + 1 and _WORD[raw[back - 1]]:
            back -= 1
        start = back
        if end == n:
            return
    yield start, n


@dataclass
class Features:
    """Trained features of a whole text: places of words are counted through, a pair stands at its first word."""

    place: np.ndarray  # sorted
    feature: np.ndarray
    in_line: np.ndarray  # a word, or a pair within one line
    line: np.ndarray
    first_word: np.ndarray  # of each line, and the number of words at last


def text_features(raw: bytes, model: Model, rolling: Rolling) -> Features:
    parts, words, lines, counts = [], 0, 0, []
    for i, (start, end) in enumerate(overlapping(raw)):
        h, line = words_of(raw[start:end], rolling)
        line = line + lines
        again = 1 if i and len(h) else 0  # the word that the piece before ended with
        place = words - again + np.arange(len(h))
        singles, pairs = model.place[_feature(h)], model.place[_feature(_pair(h[:-1], h[1:]))] if len(h) > 1 else np.empty(0, dtype=np.int64)
        singles = singles[again:]
        keep, both = singles >= 0, pairs >= 0
        parts.append((np.concatenate([place[again:][keep], place[:-1][both]]), np.concatenate([singles[keep], pairs[both]]), np.concatenate([np.ones(keep.sum(), dtype=bool), (line[1:] == line[:-1])[both]]), np.concatenate([line[again:][keep], line[:-1][both]])))
        counts.append(line[again:])
        words += len(h) - again
        lines += raw.count(b"\n", start, end)
    place, feature, in_line, line = (np.concatenate([p[j] for p in parts]) for j in range(4))
    order = np.argsort(place, kind="stable")
    every = np.concatenate(counts)
    return Features(place[order], feature[order], in_line[order], line[order], np.searchsorted(every, np.arange(raw.count(b"\n") + 2)))


def _rolling() -> Rolling:
    return Rolling(3301, fold_case=True)


def word_pairs(text: str) -> frozenset[tuple[str, str]]:
    words = _PAIRS.findall(text.lower())
    return frozenset(zip(words, words[1:]))


@dataclass
class Model:
    families: list[str]
    place: np.ndarray  # trained feature number, or -1
    weights: np.ndarray  # trained features x classes
    bias: np.ndarray
    least: float

    def probabilities(self, lines: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, class probabilities) of lines that hold a trained feature."""
        at = self.place[features]
        known = at >= 0
        return self.of_trained(lines[known], at[known])

    def of_trained(self, lines: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of features by their trained number."""
        both = np.unique(lines * np.int64(1 << 20) + at)
        line, at = both >> 20, both & ((1 << 20) - 1)
        if not len(line):
            return line, np.empty((0, len(self.bias)))
        first = np.flatnonzero(np.diff(line, prepend=-1))
        z = np.add.reduceat(self.weights[at], first, axis=0) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return line[first], z / z.sum(axis=1, keepdims=True)


def _pieces_of(notice: str, rng) -> str:
    """A run of the notice's words, as a line of a wrapped notice holds them."""
    words = notice.split()
    n = int(rng.integers(6, 14))
    start = int(rng.integers(0, max(1, len(words) - n + 1)))
    return " ".join(words[start : start + n])


def _examples(rng, variants: int) -> list[tuple[str, str]]:
    filler = [w for s in PROSE for w in s.split()]
    rows = []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            for i in range(variants):
                words = [w for w in notice.split() if i == 0 or rng.random() > 0.08]
                before, after = rng.integers(0, 12, 2) if i % 2 else (0, 0)
                rows.append((family, " ".join([*rng.choice(filler, before), *words, *rng.choice(filler, after)])))
            if len(notice.split()) > 14:
                rows += [(family, _pieces_of(notice, rng)) for _ in range(variants)]
    total = len(rows)
    for i in range(total):
        rows.append((UNKNOWN, PROSE[i % len(PROSE)] if i < len(PROSE) else " ".join(rng.choice(filler, rng.integers(2, 40)))))
    return rows


_TEMPLATE_PAIRS = {family: [word_pairs(t) for t in notices] for family, notices in TEMPLATES.items()}
_TEMPLATE_WORDS = {family: [len(_PAIRS.findall(t.lower())) for t in notices] for family, notices in TEMPLATES.items()}
LONGEST = max(n for sizes in _TEMPLATE_WORDS.values() for n in sizes)


def corpus_prose(docs: DataFrame, rows: int = SAMPLE, lines: int = SAMPLE_LINES) -> list[str]:
    """Lines of a bounded sample of ``docs`` that are far from all templates."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = [r[0] for r in ids.collect()]
    if not ids:
        return []
    found = docs.where(F.col("doc_id").isin(ids)).select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) between 20 and 2000")
    found = [r[0] for r in found.distinct().orderBy(F.xxhash64("line"), "line").limit(lines).collect()]
    every = [t for templates in _TEMPLATE_PAIRS.values() for t in templates]
    return [line for line in found if (pairs := word_pairs(line)) is not None and all(len(pairs & t) < 0.2 * len(t) for t in every)]


def train_model(prose: list[str] = (), seed: int = 5, variants: int = VARIANTS, rounds: int = 120, penalty: float = 1e-4) -> Model:
    """Fitted on every second example and line of ``prose``, calibrated on the others."""
    rng, rolling = np.random.Generator(np.random.PCG64(seed)), _rolling()
    rows = _examples(rng, variants)
    families = sorted({f for f, _ in rows})
    found = [np.unique(line_features(t.encode(), rolling)[1]) for _, t in rows]
    used = np.unique(np.concatenate(found))
    place = np.full(1 << BITS, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    rows += [(UNKNOWN, line) for line in prose]
    found += [np.unique(line_features(line.encode(), rolling)[1]) for line in prose]
    x = np.zeros((len(rows), len(used)), dtype=np.float32)
    for i, f in enumerate(found):
        at = place[f]
        x[i, at[at >= 0]] = 1
    y = np.array([families.index(f) for f, _ in rows])
    fit, held = np.arange(0, len(rows), 2), np.arange(1, len(rows), 2)
    w, b = np.zeros((len(used), len(families)), dtype=np.float32), np.zeros(len(families), dtype=np.float32)
    b[families.index(UNKNOWN)] = 2.0
    target = np.eye(len(families), dtype=np.float32)[y[fit]]
    xf = x[fit]
    for _ in range(rounds):
        z = xf @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = (z / z.sum(axis=1, keepdims=True) - target) / len(fit)
        w -= 4.0 * (xf.T @ g + penalty * w)
        b -= 0.2 * g.sum(axis=0)
    z = x[held] @ w + b
    z = np.exp(z - z.max(axis=1, keepdims=True))
    p = z / z.sum(axis=1, keepdims=True)
    u = families.index(UNKNOWN)
    alarms = np.sort(np.delete(p, u, axis=1).max(axis=1)[y[held] == u])
    least = float(alarms[min(len(alarms) - 1, int(np.ceil((1 - FALSE_ALARMS) * len(alarms))))])
    return Model(families, place, w.astype(np.float64), b.astype(np.float64), max(0.5, least))


def _closest(words: list[tuple[str, int]], claimed: str, seed: tuple[int, int]) -> list[tuple[float, int, int, str]]:
    """(similarity, first line, last line, family): for the claimed family, then the one that is closest of all if that is another, the stretch
    of ``words`` (word, line) that meets the lines of the seed and holds most of the pairs of one of its templates; the earliest of the best."""
    found = []
    for family in sorted(TEMPLATES, key=lambda f: (f != claimed, f)):
        best = (0.0, -1, -1, family)
        for pairs, size in zip(_TEMPLATE_PAIRS[family], _TEMPLATE_WORDS[family]):
            hits = [(i, (a, b)) for i, ((a, _), (b, _)) in enumerate(zip(words, words[1:])) if (a, b) in pairs]
            held: dict[tuple[str, str], int] = {}
            left = 0
            for right, (place, pair) in enumerate(hits):
                held[pair] = held.get(pair, 0) + 1
                while place - hits[left][0] > 2 * size:
                    held[hits[left][1]] -= 1
                    if not held[hits[left][1]]:
                        del held[hits[left][1]]
                    left += 1
                lines = words[hits[left][0]][1], words[place + 1][1]
                if len(held) / len(pairs) > best[0] and lines[0] <= seed[1] and lines[1] >= seed[0]:
                    best = (len(held) / len(pairs), *lines, family)
        found.append(best)
    closest = max(found, key=lambda x: x[0])
    return found[:1] + [closest] * (closest[0] > found[0][0])


def _notice(lines: list[bytes], first: int, last: int, family: str) -> list[tuple[float, int, int, str]]:
    """What ``_closest`` finds around the lines ``first`` to ``last``."""
    read = lambda i: [(w, i) for w in _PAIRS.findall(lines[i].decode("utf-8", "replace").lower())]
    around: list[tuple[str, int]] = []
    i = first - 1
    while i >= 0 and len(around) < 2 * LONGEST and lines[i].strip():
        around = read(i) + around
        i -= 1
    inner = [w for i in range(first, last + 1) for w in read(i)]
    after: list[tuple[str, int]] = []
    i = last + 1
    while i < len(lines) and len(after) < 2 * LONGEST and lines[i].strip():
        after += read(i)
        i += 1
    return _closest(around + inner + after, family, (first, last))


def _seeds(lines: list[bytes], found: Features, model: Model) -> list[tuple[int, int, int, float]]:
    """(first line, last line, class, probability) of what a family claims: lines, and windows of short lines."""
    unknown = model.families.index(UNKNOWN)

    def claimed(numbers: np.ndarray, features: np.ndarray) -> list[tuple[int, int, float]]:
        number, p = model.of_trained(numbers, features)
        if not len(number):
            return []
        best = p.argmax(axis=1)
        top = p[np.arange(len(p)), best]
        return [(int(number[i]), int(best[i]), float(top[i])) for i in np.flatnonzero((best != unknown) & (top >= model.least))]

    seeds = [(i, i, c, p) for i, c, p in claimed(found.line[found.in_line], found.feature[found.in_line])]
    starts, ends = found.first_word[:-1], found.first_word[1:]
    blank = np.flatnonzero([not line.strip() for line in lines])
    block_end = np.append(blank, len(lines))[np.searchsorted(blank, np.arange(len(lines)))]  # the blank line behind each line
    done = np.arange(len(lines))  # the last line of the window before
    for size in WINDOWS:
        last = np.minimum(np.searchsorted(ends, starts + size), block_end - 1)
        wider = np.flatnonzero((last > done) & (ends > starts))
        done = np.maximum(done, last)
        # A long last line counts with its first words.
        low, high = np.searchsorted(found.place, starts[wider]), np.searchsorted(found.place, np.minimum(ends[last[wider]], starts[wider] + 2 * size))
        many = high - low
        at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        seeds += [(int(wider[w]), int(last[wider[w]]), c, p) for w, c, p in claimed(np.repeat(np.arange(len(wider)), many), found.feature[at])]
    return seeds


def classify(raw: bytes, model: Model, rolling: Rolling):
    """(first line, last line, family, nearest family, probability, similarity to its closest template) of identified paragraphs."""
    lines, taken = raw.split(b"\n"), -1
    for start, end, best, probability in sorted(_seeds(lines, text_features(raw, model, rolling), model), key=lambda s: (s[0], s[1], s[2])):
        if start <= taken:
            continue  # inside the paragraph before
        family, own = model.families[best], probability
        choices = _notice(lines, start, end, family)
        similarity = choices[0][0]
        first, last = start, end
        # The whole paragraph is classified again: what it says of the claimed family and of a closer template's decides.
        for near, low, high, other in choices:
            if near < CONFIRMED_AT or high <= taken:
                continue
            low = max(low, taken + 1)
            _, whole = model.probabilities(*_joined(lines[low : high + 1], rolling))
            said = float(whole[0, model.families.index(other)]) if len(whole) else 0.0
            if other == model.families[best] or said >= model.least:
                family, similarity, first, last, probability = other, near, low, high, max(said, own if other == model.families[best] else 0.0)
        confirmed = similarity >= CONFIRMED_AT
        if (end > start and not confirmed) or last <= taken:
            continue
        taken = last
        yield first, last, family if confirmed else UNKNOWN, family, probability, similarity


def _joined(lines: list[bytes], rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    line, features = line_features(b" ".join(lines), rolling)
    return np.zeros_like(line), features


def license_paragraphs(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per paragraph that looks like a licence notice: its lines, its family or ``unknown``, the nearest family."""
    model = model or train_model(corpus_prose(docs))

    def run(batches):
        rolling = _rolling()
        for batch in batches:
            rows = []
            for doc, raw in zip(column_of(batch, "doc_id").to_pylist(), text_bytes(column_of(batch, "text"))):
                for first, last, family, nearest, p, similarity in classify(raw or b"", model, rolling):
                    rows.append((doc, first, last, family, nearest, p, similarity, similarity >= CONFIRMED_AT))
            if rows:
                yield batch_of(SCAN, list(zip(*rows)))

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCAN)
