"""Substring dedup by recompression.

Words are named by hashes. ROUNDS rounds replace first runs of one symbol, then pairs of neighbours, by one symbol each;
a symbol's name is the hash of what it replaces, so equal pairs and runs get equal names in every document without any
exchange. Which neighbours form a pair is decided by their names alone (a bit of the name puts a symbol into the left
or the right half of the alphabet; left-right neighbours pair). Equal word sequences so get equal symbols but for some
at their ends, and symbols never stand for more than LIMITS words, so that a window of WINDOW words always has some.

Where the ends of a window stop mattering is worked out from the window alone: at every round, what a run or pair may
have taken in beyond an end is left out. Of the symbols certainly inside, the one with the smallest name is the window's
anchor. Windows with equal words have equal anchors, so only windows whose anchor occurs in two documents are looked at
again. These are compared by anchor and a hash of their words (128 bits), in one task for an anchor that few documents
have, otherwise by an aggregation of the smallest doc_id that is joined back. A window without a certain symbol is its
own anchor; nothing is lost.

Documents whose word sequences are wholly equal are settled first, by the hash of the sequence: all but the smallest
doc_id lose every word (if there are WINDOW words). Whole texts are never gathered by content; groups are of hashes
with document numbers, aggregated before they are shuffled.

Null and empty texts have no words. Rows that repeat a doc_id are judged each by its own text against smaller doc_ids,
so equal rows stay alike; they never take words from each other. Rows with a null doc_id are left as they are and take
nothing from others. Further columns are ignored by ``removals`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.relational import fitted
from flowlens.llm.base import fresh, saved, settled
from flowlens.llm.vectors import BASE, U, Words, batches, mix, runs, signed

WINDOW = 50
LIMITS = (2, 4, 6)
BARRIER = 1 << 40
BLOCK = 62
#: Anchors with more occurrences than this are compared window by window in any number of tasks.
FEW = 100_000


class Parse:
    """The words of some texts under recompression, and for every window what is certain of it.

    names, sizes: the symbols; low, high: per window the range of symbols that are the same wherever its words occur.
    Texts are kept apart by barriers, symbols too long to be joined to anything.
    """

    def __init__(self, words: Words, window: int, limits: tuple[int, ...]):
        n = np.diff(words.offsets)
        self.window = window
        # Word i of text t stands at i + t: one barrier follows each text.
        place = np.arange(len(words.hashes)) + words.owner()
        self.names = mix(np.arange(len(words.hashes) + len(n), dtype=U) + U(0x5bd1e995))
        self.sizes = np.full(len(self.names), BARRIER)
        self.names[place], self.sizes[place] = words.hashes, 1
        inside = np.arange(len(words.hashes)) + window <= np.repeat(words.offsets[1:], n)
        self.starts = np.flatnonzero(inside)  # of windows, as word numbers
        self.low = place[self.starts]
        self.high = self.low + window
        for number, limit in enumerate(limits):
            self._join_runs(limit, U(2 * number + 1))
            self._join_pairs(limit, U(2 * number + 2))

    def _shrink(self, keep: np.ndarray) -> None:
        before = np.concatenate([[0], np.cumsum(keep)])
        self.names, self.sizes = self.names[keep], self.sizes[keep]
        self.low, self.high = before[self.low], before[self.high]

    def _join_runs(self, limit: int, salt: np.uint64) -> None:
        names, sizes, low, high = self.names, self.sizes, self.low, self.high
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.empty(0, int)
        length = np.diff(np.append(first, len(names)))
        run_start, run_end = np.repeat(first, length), np.repeat(first + length, length)
        # A run at an end of the window may be longer outside. If its part inside is beyond the limit it is joined
        # nowhere; else it is uncertain and left out.
        some = low < high
        left, right = np.where(some, low, 0), np.where(some, high - 1, 0)
        left_end = np.minimum(run_end[left], high) if len(names) else high
        right_start = np.maximum(run_start[right], low) if len(names) else low
        if len(names):
            self.low = np.where(some & ((left_end - low) * sizes[left] <= limit), left_end, low)
            self.high = np.where(some & ((high - right_start) * sizes[right] <= limit), right_start, high)
            self.high = np.maximum(self.high, self.low)
        joined = (length > 1) & (length * sizes[first] <= limit)
        at = first[joined]
        keep = ~np.repeat(joined, length)
        keep[at] = True
        self.names, self.sizes = names.copy(), sizes.copy()
        self.names[at] = mix(names[at] * U(BASE) + length[joined].astype(U) + salt)
        self.sizes[at] = sizes[at] * length[joined]
        self._shrink(keep)

    def _join_pairs(self, limit: int, salt: np.uint64) -> None:
        names, sizes, low, high = self.names, self.sizes, self.low, self.high
        if not len(names):
            return
        right_half = (mix(names + salt) >> U(63)).astype(bool)
        joined = ~right_half[:-1] & right_half[1:] & (sizes[:-1] + sizes[1:] <= limit)
        some = low < high
        left, right = np.where(some, low, 0), np.where(some, high - 1, 0)
        self.low = low + (some & right_half[left] & (sizes[left] < limit))
        self.high = np.maximum(high - (some & ~right_half[right] & (sizes[right] < limit)), self.low)
        at = np.flatnonzero(joined)
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        self.names, self.sizes = names.copy(), sizes.copy()
        self.names[at] = mix((names[at] * U(BASE)) ^ mix(names[at + 1] + salt))
        self.sizes[at] = sizes[at] + sizes[at + 1]
        self._shrink(keep)

    def anchors(self, hashes: np.ndarray) -> np.ndarray:
        """Per window, the smallest certain name; the hash of its words (from ``hashes``) where none is certain."""
        length = self.high - self.low
        out = mix(hashes + U(977))
        least, width = self.names, 1
        while True:
            at = np.flatnonzero((length >= width) & (length < 2 * width))
            out[at] = np.minimum(least[self.low[at]], least[self.high[at] - width])
            if 2 * width > length.max(initial=0):
                return out
            least = np.minimum(least[:-width], least[width:])
            width *= 2


def window_hashes(words: Words, window: int, starts: np.ndarray) -> np.ndarray:
    """A hash of the ``window`` words from each start."""
    up, down = (np.concatenate([np.ones(1, U), np.cumprod(np.full(len(words.hashes), base, U))])
                for base in (BASE, pow(BASE, -1, 2**64)))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(words.hashes + U(5)) * up[:len(words.hashes)])])
    return mix((sums[starts + window] - sums[starts]) * down[starts])


def scan(texts: list, window: int, limits: tuple[int, ...]) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of texts: the first one's place, words, and for all windows start, hash and anchor."""
    for a, b in batches(texts):
        words = Words(texts[a:b])
        parse = Parse(words, window, limits)
        hashes = window_hashes(words, window, parse.starts)
        yield a, words, parse.starts, hashes, parse.anchors(hashes)


def described(docs: DataFrame, window: int = WINDOW, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """Of every row doc_id, mark (a hash of the text), n_words, sha (of the words joined by one space), tag (a short hash
    of that) and anchors (distinct); saved."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, rows = list(f.text), []
            for a, words, starts, _, anchors in scan(texts, window, limits):
                cuts = np.searchsorted(starts, words.offsets)
                for i in range(len(words.offsets) - 1):
                    parts = (texts[a + i] or "").encode("utf-8", "surrogatepass").split()
                    own = anchors[cuts[i]:cuts[i + 1]]
                    rows.append((len(parts), hashlib.sha256(b" ".join(parts)).hexdigest(), signed(np.unique(own))))
            out = pd.DataFrame(rows, columns=["n_words", "sha", "anchors"])
            out.insert(0, "mark", f.mark.to_numpy())
            out.insert(0, "doc_id", f.doc_id.to_numpy())
            yield out

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInPandas(
        run, "doc_id long, mark long, n_words long, sha string, anchors array<long>")
    return saved(rows.withColumn("tag", F.hash("sha")), "substrings-described")


def repeated_windows(docs: DataFrame, rows: DataFrame, window: int = WINDOW,
                     limits: tuple[int, ...] = LIMITS) -> tuple[DataFrame, DataFrame]:
    """Of the rows that own their word sequence and share an anchor with another document: the texts, and the windows
    that a smaller doc_id has too: doc_id, tag, and the bits of mask, counted from the window that starts at word at."""
    long = rows.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    owners = long.groupBy("sha").agg(F.min(F.struct("doc_id", "mark", "tag", "anchors")).alias("o")).select("o.*")
    anchors = owners.select("doc_id", "tag", F.explode("anchors").alias("anchor"))
    shared = (anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                            F.count(F.lit(1)).alias("n"))
              .where("low < high").select("anchor", (F.col("n") > FEW).alias("many")))
    wanted = anchors.join(shared, "anchor").groupBy("doc_id", "tag").agg(
        F.collect_list(F.when(~F.col("many"), F.col("anchor"))).alias("few"),
        F.collect_list(F.when(F.col("many"), F.col("anchor"))).alias("many"))
    wanted = wanted.join(owners.select("doc_id", "tag", "mark"), ["doc_id", "tag"])
    own = docs.select(F.col("doc_id").alias("of"), F.xxhash64("text").alias("like"), "text")
    texts = saved(own.join(wanted, (F.col("of") == F.col("doc_id")) & (F.col("like") == F.col("mark")))
                  .select("doc_id", "tag", "text", "few", "many"), "substrings-texts")

    def blocks(column: str) -> DataFrame:
        """The blocks of the anchors in ``column``: neighbouring windows of one anchor in one text, BLOCK at most."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                texts, wanted = list(f.text), list(f.wanted)
                for a, words, starts, hashes, anchors in scan(texts, window, limits):
                    cuts, anchors = np.searchsorted(starts, words.offsets), signed(anchors)
                    asked = np.zeros(len(anchors), bool)
                    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
                        asked[low:high] = np.isin(anchors[low:high], wanted[a + i])
                    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                    change = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1])
                                                            | (owner[1:] != owner[:-1])]) if len(anchors) else [])
                    since = np.arange(len(anchors)) - np.repeat(change, np.diff(np.append(change, len(anchors))))
                    first = np.flatnonzero(since % BLOCK == 0)
                    last = np.append(first[1:], len(anchors))
                    first, last, hashes = first[asked[first]], last[asked[first]], signed(hashes)
                    rows = a + owner[first]
                    yield pd.DataFrame({
                        "anchor": anchors[first], "doc_id": f.doc_id.to_numpy()[rows], "tag": f.tag.to_numpy()[rows],
                        "at": (starts[first] - words.offsets[owner[first]]).astype(np.int32),
                        "hashes": [hashes[x:y] for x, y in zip(first, last)]})

        return texts.where(F.size(column) > 0).select("doc_id", "tag", "text", F.col(column).alias("wanted")).mapInPandas(
            run, "anchor long, doc_id long, tag int, at int, hashes array<long>")

    # Of an anchor with few occurrences all blocks meet in one task, and their windows are compared there.
    few = (blocks("few").repartition("anchor")
           .select("anchor", "doc_id", "tag", "at", F.posexplode("hashes").alias("k", "hash"))
           .withColumn("low", F.min("doc_id").over(Window.partitionBy("anchor", "hash")))
           .where("doc_id > low").groupBy("anchor", "doc_id", "tag", "at")
           .agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask")).drop("anchor"))
    # Of one with many the smallest doc_id of each window is aggregated first and joined, which a hot window can't stop.
    each = saved(blocks("many"), "substrings-blocks").select("anchor", "doc_id", "tag", "at", F.posexplode("hashes").alias("k", "hash"))
    first = each.groupBy("anchor", "hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where(
        "low < high").drop("high")
    many = (each.join(first, ["anchor", "hash"]).where("doc_id > low").groupBy("doc_id", "tag", "at")
            .agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask")))
    return texts, few.unionByName(many)


def _cut(texts: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, n_removed and kept (the remaining words joined by one space) of the rows that lose words."""
    spans = found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "mask")).alias("found"))
    spans = spans.select("doc_id", "tag", F.col("found.at").alias("at"), F.col("found.mask").alias("mask"))
    bits = np.arange(BLOCK)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text, at, mask in zip(f.text, f["at"], f["mask"]):
                words = text.encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(words) + 1, np.int64)
                lost = (np.asarray(mask)[:, None] >> bits & 1).astype(bool)
                at = np.unique((np.asarray(at, np.int64)[:, None] + bits)[lost])
                edge[at] += 1
                edge[at + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                rows.append((int(gone.sum()), b" ".join([w for w, g in zip(words, gone) if not g]).decode(
                    "utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["n_removed", "kept"])
            out.insert(0, "tag", f.tag.to_numpy())
            out.insert(0, "doc_id", f.doc_id.to_numpy())
            yield out

    # Most texts lose nothing: they are left out by their keys, broadcast only where counted and few, before any is shuffled.
    spans = saved(spans, "substrings-spans")
    losing = texts.select("doc_id", "tag", "text").join(fitted(spans.select("doc_id", "tag")), ["doc_id", "tag"], "left_semi")
    return losing.join(spans, ["doc_id", "tag"]).mapInPandas(
        run, "doc_id long, tag int, n_removed long, kept string").dropDuplicates(["doc_id", "tag"])


def changes(docs: DataFrame, window: int = WINDOW, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """doc_id, mark, n_words, sha, n_removed and kept (null where nothing is removed) of every row."""
    rows = described(docs, window, limits)
    first = (rows.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("first"))
             .withColumnRenamed("sha", "same"))
    cut = _cut(*repeated_windows(docs, rows, window, limits), window)
    cut = cut.select(F.col("doc_id").alias("of"), F.col("tag").alias("like"), "n_removed", "kept")
    slim = rows.drop("anchors")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return (slim.join(first, F.col("sha") == F.col("same"), "left")
            .join(cut, (F.col("doc_id") == F.col("of")) & (F.col("tag") == F.col("like")), "left")
            .select("doc_id", "mark", "n_words", "sha",
                    F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
                    .alias("n_removed"),
                    F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")))


def removals(docs: DataFrame, window: int = WINDOW, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return settled(lambda: changes(docs, window, limits).select(
        "doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept", 256), F.col("sha")).alias("kept_sha256")),
        "substrings-removals")


def deduplicated(docs: DataFrame, window: int = WINDOW, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """The rows of ``docs``; of those that lose words, text is what remains, joined by one space, and n_chars its length."""
    of, mark, kept = fresh(docs.columns, "of", "mark", "kept")
    changed = settled(lambda: changes(docs, window, limits).where("n_removed > 0").dropDuplicates(["doc_id", "mark"])
                      .select(F.col("doc_id").alias(of), F.col("mark").alias(mark), F.col("kept").alias(kept)),
                      "substrings-changed")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length(kept), F.col("n_chars")).cast("long")
    same = (F.col("doc_id") == F.col(of)) & (F.xxhash64("text") == F.col(mark))
    # Only rows that lose words meet their new texts; which they are is told by keys, broadcast where counted and few.
    keys = fitted(changed.select(of, mark))
    altered = docs.join(keys, same, "left_semi").join(changed, same)
    altered = altered.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
    return docs.join(keys, same, "left_anti").unionByName(altered)
