"""Words and character n-grams of many texts at once, as numpy arrays of 64-bit hashes.

Everything here runs inside tasks on one Arrow batch. Hashes depend on the text alone, so equal words have equal
hashes in every task, run and language of Unicode text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
BLOCK = 1 << 18

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def powers(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(size, p, U))]) for p in (BASE, INVERSE)]
    return _powers


def batches(texts: list, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts.

    hashes: one per word, in order; offsets: text i has words offsets[i] to offsets[i + 1]; raw: the UTF-8 bytes of
    the texts, each followed by a line feed, with starts and ends of the words in them and at of the texts.
    """

    def __init__(self, texts: list, lower: bool = False):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.raw = b"\n".join(parts) + b"\n"
        self.bytes = np.frombuffer(self.raw, np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]
        self.at = np.concatenate([[0], np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))])
        inside = np.zeros(len(self.bytes) + 2, np.int8)
        inside[1:-1] = ~SEPARATOR[self.bytes]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.offsets = np.searchsorted(self.starts, self.at)
        self.hashes = np.empty(len(self.starts), U)
        first = 0
        while first < len(self.starts):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + BLOCK, "right")))
            low, high = self.starts[first], self.ends[last - 1]
            up, down = powers(int(high - low) + 1)
            sums = np.zeros(high - low + 1, U)
            np.cumsum(BYTE_VALUES[self.bytes[low:high]] * up[:high - low], out=sums[1:])
            a, b = self.starts[first:last] - low, self.ends[first:last] - low
            self.hashes[first:last] = mix((sums[b] - sums[a]) * down[a])
            first = last

    def of(self, i: int) -> slice:
        return slice(self.offsets[i], self.offsets[i + 1])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every ``k`` consecutive elements; shorter input has none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.full(n, k, U)
    for j in range(k):
        out = (out * U(BASE)) ^ mix(hashes[j:j + n] + U(j + 1))
    return mix(out)


class Characters:
    """Code points of lower-cased texts, white space made single spaces, with ``pad`` zeros before each text.

    With ``words`` every distinct word of a text stands once, and n-grams end at the space before a word: what
    stands before that space counts as zeros.
    """

    def __init__(self, texts: list, pad: int, words: bool = False):
        self.pad = pad
        once = dict.fromkeys if words else iter
        clean = [f" {' '.join(once(t.lower().split()))} " if t else "" for t in texts]
        self.lengths = np.fromiter(map(len, clean), np.int64, len(clean))
        gap = "\0" * pad
        self.codes = np.frombuffer((gap + gap.join(clean)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        self.starts = pad + np.concatenate([[0], np.cumsum(self.lengths + pad)[:-1]]).astype(np.int64)
        self.depth = None
        if words:
            here = np.arange(len(self.codes))
            self.depth = here - np.maximum.accumulate(np.where(self.codes <= U(32), here, 0))

    def grams(self, n: int, ends: np.ndarray | slice | None = None) -> np.ndarray:
        """The hash of the ``n`` code points up to each position; all positions from ``pad`` on by default."""
        out: np.ndarray | None = None
        for k in range(n):
            back = n - 1 - k
            if ends is None:
                c = self.codes[self.pad - back:len(self.codes) - back] + U(1)
            else:
                c = self.codes[ends - back] + U(1)
            if self.depth is not None and back:
                c = np.where((self.depth[self.pad:] if ends is None else self.depth[ends]) >= back, c, U(0))
            out = c if out is None else out * U(BASE) + c
        size = len(self.codes) - self.pad if ends is None else len(ends)
        return mix(out + U(n)) if out is not None else np.zeros(size, U)

    def buckets(self, longest: int, bits: int) -> list[np.ndarray]:
        """For 1 to ``longest`` characters up to each position from ``pad`` on, a number of ``bits`` bits."""
        c = self.codes + U(1)
        out, h = [], c
        for n in range(1, longest + 1):
            if n > 1:
                h = h[:-1] * U(BASE) + c[n - 1:]
            own = h[self.pad - n + 1:] * U(0xD6E8FEB86659FD93 + 2 * n)
            out.append((own >> U(64 - bits)).view(np.int64))
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of ``values`` at its positions (values as from grams())."""
        out, some = np.zeros(len(self.lengths)), np.flatnonzero(self.lengths)
        if len(some):
            # Each text is summed by itself, so equal texts have equal sums wherever they stand.
            low = self.starts[some] - self.pad
            ends = np.stack([low, low + self.lengths[some]], 1).ravel()
            out[some] = np.add.reduceat(np.append(values.astype(np.float64), 0.0), ends)[::2]
        return out
