"""Token counts by heap-and-linked-list byte-pair merging; no token identifiers are made.

A word's symbols form a linked list; a heap holds adjacent pairs by (rank, position); the lowest
is popped and merged until no ranked pair is left. Tokens = initial symbols - merges. Counts per
distinct word are remembered in each worker up to a bound; what falls out is counted anew.

Defined results: a null or empty text has no tokens; added special strings inside a text count
one token each, as the tokenizer file's default has it; repeated rows are counted each.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, column_of

REMEMBERED = 400_000
PIECE = 1 << 20
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """Printable stand-in for each byte: printable Latin-1 stays, the rest follows from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


#: Outside ASCII and the Latin letters up to U+024F, which are composed already and have no special lower case.
_UNUSUAL = re.compile("[^\\t-\\r -\x7eÀ-ÖØ-öø-\u012f\u0131-\u024f]")
#: The steps of a file that the counter understands, and the pattern of the fast path below.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
USUAL_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-\u024f]+|[0-9]|[^\\sa-zß-öø-\u024f0-9]+")
_POSITION = (1 << 40) - 1


class Chunks(dict):
    """Tokens of each run of usual characters between white space."""

    def __init__(self, counter: "WordCounter"):
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        self[chunk] = count = self.counter.of_words(_LATIN_WORD.findall(chunk))
        return count


class WordCounter:
    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        split, *others = spec["pre_tokenizer"].get("pretokenizers", [{}])
        understood = (
            model["type"] == "BPE" and not model.get("unk_token") and not model.get("ignore_merges") and not model.get("dropout") and not model.get("continuing_subword_prefix")
            and spec["normalizer"].get("normalizers") == NORMALIZERS
            and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]
            and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in others] == [("ByteLevel", False, False)]
        )
        if not understood:
            raise ValueError("only lower-casing BPE files with a Split pattern over bytes are understood")
        vocabulary = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        # Numbers for symbols, inside this class only; those outside the vocabulary follow it.
        self.number = dict(vocabulary)
        self.known_to_vocabulary = max(vocabulary.values(), default=-1)
        for s in self.symbols:
            for t in (s, s + self.suffix):
                self.number.setdefault(t, self.known_to_vocabulary + 1 + len(self.number))
        self.rank: dict[int, int] = {}
        self.joined: list[int] = []
        for left, right in (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]):
            self.rank[self.number[left] << 32 | self.number[right]] = len(self.joined)
            self.joined.append(self.number[left + right])
        self.inner = [self.number[s] for s in self.symbols]
        self.final = [self.number[s + self.suffix] for s in self.symbols]
        pattern = split["pattern"]["Regex"]
        self.word, self.usual = regex.compile(pattern), pattern == USUAL_WORD
        self.space = regex.compile(r"\s+")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}
        self.chunks = Chunks(self)

    def merged(self, word: str) -> int:
        """Tokens of one word: symbols minus merges."""
        data = word.encode("utf-8", "surrogatepass")
        symbol = [self.inner[b] for b in data]
        symbol[-1] = self.final[data[-1]]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, joined = self.rank.get, self.joined
        heap = [r << 40 | i for i in range(n - 1) if (r := rank(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 40, top & _POSITION
            j = after[i]
            if j >= n or symbol[i] < 0 or rank(symbol[i] << 32 | symbol[j]) != r:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = joined[r], -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank(symbol[i] << 32 | symbol[k])) is not None:
                    heapq.heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := rank(symbol[h] << 32 | symbol[i])) is not None:
                heapq.heappush(heap, r << 40 | h)
        # A symbol outside the vocabulary has no unknown token to stand for it and yields nothing.
        return n - merges - sum(1 for s in symbol if s > self.known_to_vocabulary)

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # Lower-casing is per character: no special final sigma.
        return self.word.findall(self.space.sub(" ", text).replace("Σ", "σ").lower())

    def of_words(self, words: list[str]) -> int:
        known, total = self.known, 0
        for word in words:
            count = known.get(word)
            if count is None:
                count = self.merged(word)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = count
            total += count
        return total

    def plain(self, text: str) -> int:
        if not self.usual or _UNUSUAL.search(text):
            return self.of_words(self.words(text))
        if len(self.chunks) >= REMEMBERED:
            self.chunks.clear()
        return sum(map(self.chunks.__getitem__, text.lower().split()))

    def count(self, text: str) -> int:
        """Tokens of a whole text; long texts go piece by piece, cut at a space."""
        if self.special is None or not self.special.search(text):
            parts, total = [text], 0
        else:
            parts, total = self.special.split(text), len(self.special.findall(text))
        for part in parts:
            start = 0
            while len(part) - start > PIECE:
                cut = part.find(" ", start + PIECE)
                cut = len(part) if cut < 0 else cut
                total += self.plain(part[start:cut])
                start = cut
            total += self.plain(part[start:])
        return total


@lru_cache(maxsize=2)
def counter_of(content: str) -> WordCounter:
    return WordCounter(content)


def counter(path: str) -> WordCounter:
    with open(path, encoding="utf-8") as f:
        return counter_of(f.read())


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text. The driver reads the file and sends its content."""
    with open(tokenizer_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        count = counter_of(content.value).count
        for batch in batches:
            rows = []
            for doc, value in zip(column_of(batch, "doc_id").to_pylist(), column_of(batch, "text")):
                text = value.as_py() or ""
                n = count(text)
                rows.append((doc, len(text.encode()), n, n > limit))
            if rows:
                yield batch_of(COUNTS, list(zip(*rows)))

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, COUNTS)
