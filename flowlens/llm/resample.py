"""Importance resampling towards a target: documents are drawn by how much their words resemble the target's texts.

Features are all runs of 1 to ``longest`` words, hashed into buckets by crc32. Both corpora are counted whole. A
bucket's gain is the smoothed logarithm of its share in the target over its share in the documents, in thousandths; a
document weighs the sum of its features' gains, gets a Gumbel noise drawn from its doc_id, and the highest scores among
documents of enough words are drawn, which is sampling without replacement in proportion to the weights' exponentials.

A batch's texts are joined with sentinels and read by one regular-expression pass; searchsorted on the sentinels'
places masks runs across texts, bincount counts the rest (words.py). Counts, one number for each bucket, are summed by
Spark; only these, as many as ``buckets``, are brought to the driver and sent out as gains.

Null and empty texts have no features: n_features and weight 0, never drawn if a document must have words. A null doc_id
is hashed as no text at all. Rows that repeat a doc_id are documents each (equal rows have equal scores, and which of
them comes first can't be told). An empty table gives an empty result, an empty target gains from counts of 0. Texts
are read whole, a long one in pieces of some megabytes. Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.base import positions, settled
from flowlens.llm.words import MARK, SENTINEL, WordPattern, batches, numbers

WORD = WordPattern(rb"\x00-\x2F\x3A-\x60\x7B-\x7F")
LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PER_CENT = 10
SEED = 2024
#: Distinct runs whose bucket a worker remembers.
REMEMBERED = 100_000


class Buckets(dict):
    """The bucket of each run of words, worked out once while it is remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[run] = value = MARK if run == SENTINEL else zlib.crc32(run) % self.buckets
        return value


def _features(batch: pa.RecordBatch, known: Buckets, longest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row of a range of ``batch``, then the row in it and the bucket of every feature."""
    texts = batch.column("text").to_pylist()
    for a, b in batches(texts):
        found = [(owner, bucket) for _, owner, bucket in numbers(texts[a:b], WORD, known.__getitem__, longest)]
        yield a, b, np.concatenate([o for o, _ in found]), np.concatenate([v for _, v in found])


def _words(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("text"))


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), Buckets(buckets)
        for part in parts:
            for _, _, _, bucket in _features(part, known, longest):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in _words(docs).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln of the smoothed shares' ratio), worked out in doubles."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(source.astype(float), target.astype(float))], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        known = Buckets(len(gain))
        for part in parts:
            words, features, weight = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            texts = part.column("text").to_pylist()
            for a, b in batches(texts):
                for n, owner, bucket in numbers(texts[a:b], WORD, known.__getitem__, longest):
                    each = np.bincount(owner, minlength=b - a)
                    features[a:b] += each
                    if n == 1:
                        words[a:b] = each
                    np.add.at(weight[a:b], owner, gain[bucket])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (words, features, weight))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS,
              least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank from 1 for those drawn, else null.

    Of the documents with ``least_words`` words, ``per_cent`` in a hundred are drawn, rounded down, ties to smaller
    doc_ids."""
    counted = partial(bucket_counts, longest=longest, buckets=buckets)

    def ranked() -> DataFrame:
        rows = weighed(docs, gains(counted(docs), counted(target)), longest, seed)
        enough = F.col("n_words") >= least_words
        placed = positions(rows, [(~enough).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
        able = placed.where(enough).count()
        drawn = enough & (F.col("position") < able * per_cent // 100)
        return placed.withColumn("rank", F.when(drawn, F.col("position") + 1)).drop("position")

    return settled(ranked, "resampled")
