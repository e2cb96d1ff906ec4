"""Words of many texts by one regular-expression pass over the texts joined with sentinels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

#: Lower-cases A-Z only; a zero byte inside a text, which is no part of any word, makes room for the sentinel.
LOWER = bytes(0x20 if b == 0 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SENTINEL = b"\0"
MARK = -1
#: Bytes joined before they are read; a longer text is a batch of its own.
BATCH = 1 << 21
#: Bytes whose words are held as a list at one time.
PIECE = 1 << 22


class WordPattern:
    """``separators``: the ASCII characters that are in no word, as the inside of a class; all other bytes make words,
    so that characters beyond ASCII, whose bytes are all above 127, stay whole."""

    def __init__(self, separators: bytes):
        self.words = re.compile(b"[^" + separators + b"]+|" + SENTINEL)
        self.gap = re.compile(b"[" + separators + b"]")

    def lists(self, joined: bytes) -> Iterator[list[bytes]]:
        """The words and sentinels of ``joined`` in order, in lists that are cut between words."""
        at = 0
        while at < len(joined):
            cut = self.gap.search(joined, min(at + PIECE, len(joined)))
            end = cut.start() if cut else len(joined)
            yield self.words.findall(joined, at, end)
            at = end


def batches(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about BATCH bytes."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > BATCH:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def numbers(texts: list[bytes | None], pattern: WordPattern, number: Callable[[bytes], int],
            longest: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n = 1 to ``longest``: n, the text's place in ``texts`` and ``number`` of every run of n words of one text.

    The texts are joined with a sentinel after each. In the list of matches the sentinels' places are the texts'
    offsets: a word belongs to the text before the next sentinel, found by searchsorted, and a run whose ends
    belong to different texts, or that is a sentinel, is masked. ``number`` gets a run's words joined by one space,
    and the sentinel, for which alone it gives MARK.
    """
    joined = SENTINEL.join([(t or b"").translate(LOWER) for t in texts]) + SENTINEL
    places: list[list[np.ndarray]] = [[] for _ in range(longest)]
    values: list[list[np.ndarray]] = [[] for _ in range(longest)]
    ends, passed, rest = [], 0, []
    for found in pattern.lists(joined):
        # Runs that reach into this list begin with the last words of the one before.
        long = rest + found
        for n in range(1, longest + 1):
            runs = found if n == 1 else [b" ".join(w) for w in zip(*(long[i:] for i in range(n)))]
            at = passed - (0 if n == 1 else len(rest))
            places[n - 1].append(np.arange(at, at + len(runs)))
            values[n - 1].append(np.fromiter(map(number, runs), np.int64, len(runs)))
            if n == 1:
                ends.append(np.flatnonzero(values[0][-1] == MARK) + passed)
            if n > 1 and len(rest) >= n:  # runs that lie wholly in the words carried over were counted before
                drop = len(rest) - n + 1
                places[n - 1][-1], values[n - 1][-1] = places[n - 1][-1][drop:], values[n - 1][-1][drop:]
        passed += len(found)
        rest = long[-(longest - 1):] if longest > 1 else []
    offsets = np.concatenate(ends)
    for n in range(1, longest + 1):
        first, value = np.concatenate(places[n - 1]), np.concatenate(values[n - 1])
        owner = np.searchsorted(offsets, first)
        inside = first + n - 1 < offsets[np.minimum(owner, len(offsets) - 1)]
        yield n, owner[inside], value[inside]
