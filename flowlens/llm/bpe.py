"""Byte-level BPE encoding and decoding with a public vocabulary file.

A text is split at the added tokens' strings, the rest into pieces by the byte-level pattern. The bytes of a piece are
a doubly linked list of symbols; a queue holds neighbouring pairs by merge rank, then by place. The lowest is merged,
its new neighbours are queued, and entries whose symbols have changed since are skipped. Decoding concatenates the
vocabulary's strings and reads them as UTF-8.

Null text is encoded as empty. Repeated rows get equal results; further columns are ignored. Texts are taken whole;
pieces already seen are remembered per task, up to a fixed number, which changes only the time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Strings whose ids a worker remembers, four times over (pieces and words, new and old): some 50 MB.
REMEMBERED = 100_000

#: White space as Unicode defines it, which leaves out the separators 1C to 1F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the byte-level pre-tokenizer's pattern.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
                       rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A space inside a run of white space, the only one before which the pattern may not cut.
INSIDE = re.compile(rf"[{SPACE}] [{SPACE}]")


class Memory:
    """The last values of a function on short strings: when full, those not asked for since it was last full go."""

    def __init__(self, function: Callable[[str], tuple[int, ...]], most: int):
        self.function = function
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.most = most

    @property
    def most(self) -> int:
        return self._most

    @most.setter
    def most(self, most: int) -> None:
        """A bound below what is remembered holds at once: as hits never reach ``miss``, it would else never be met."""
        self._most = most
        if max(len(self.new), len(self.old)) > most:
            self.forget()

    def forget(self) -> None:
        self.new, self.old = {}, {}

    def miss(self, key: str) -> tuple[int, ...]:
        value = self.old.get(key) or self.function(key)
        if len(key) <= 64:
            if len(self.new) >= self.most:
                self.new, self.old = {}, self.new
            self.new[key] = value
        return value


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        letters = byte_characters()
        of_letter = {c: b for b, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocabulary.values(), *added.values()]) + 1
        self.strings = [b""] * self.size
        for token, i in vocabulary.items():
            self.strings[i] = bytes(of_letter[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.texts = [str(i) for i in range(self.size)]
        self.bytes = [vocabulary[c] for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[a] * self.size + vocabulary[b]] = (rank, vocabulary[a + b])
        self.added = added
        self.at_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
        self.pieces, self.words = Memory(self.merge, remembered), Memory(self.word, remembered)

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece."""
        symbols = [self.bytes[b] for b in piece.encode()]
        n, size, merges = len(symbols), self.size, self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get(symbols[i] * size + symbols[i + 1])
            if found:
                queue.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, new, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get(new * size + symbols[k])
                if found:
                    heapq.heappush(queue, (found[0], i, found[1], new, symbols[k]))
            h = before[i]
            if h >= 0:
                found = merges.get(symbols[h] * size + new)
                if found:
                    heapq.heappush(queue, (found[0], h, found[1], symbols[h], new))
        return tuple(s for s in symbols if s >= 0)

    def split(self, text: str) -> list[int]:
        out: list[int] = []
        for p in PIECES.findall(text):
            out += self.pieces.new.get(p) or self.pieces.miss(p)
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of a space and what follows it up to the next one."""
        return tuple(self.split(" " + word))

    def plain(self, text: str) -> list[int]:
        if INSIDE.search(text):
            return self.split(text)
        first, *words = text.split(" ")
        out = self.split(first)
        for w in words:
            out += self.words.new.get(w) or self.words.miss(w)
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not any(t in text for t in self.added):
            return self.plain(text)
        out: list[int] = []
        for i, part in enumerate(self.at_added.split(text)):
            out += [self.added[part]] if i % 2 else self.plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _loaded(path: str) -> Bpe:
    """The tables, once for each Python worker."""
    return Bpe(path)


@contextmanager
def tokenizer(path: str) -> Iterator[Bpe]:
    """For one task; what it has remembered goes with it, as workers live on for other work."""
    bpe = _loaded(path)
    try:
        yield bpe
    finally:
        bpe.pieces.forget()
        bpe.words.forget()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row. ``path``: the vocabulary file, at the same place on every machine."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tokenizer(path) as bpe:
            for f in frames:
                yield pd.DataFrame({"doc_id": f.doc_id, "ids": [bpe.encode(t) for t in f.text]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give empty text."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tokenizer(path) as bpe:
            for f in frames:
                yield pd.DataFrame({"doc_id": f.doc_id, "text": [bpe.decode([] if i is None else i) for i in f.ids]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded again, in one pass."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tokenizer(path) as bpe:
            for f in frames:
                rows = []
                for text in f.text:
                    ids = bpe.encode(text)
                    shown = bpe.texts
                    rows.append((len(ids), hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest(),
                                 hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                out.insert(0, "doc_id", f.doc_id.to_numpy())
                yield out

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
