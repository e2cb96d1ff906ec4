"""Quality by supervised subword embeddings: hashed vectors of words and character n-grams, averaged per document,
then a softmax; vectors and output weights are learnt by stochastic gradient descent in numpy.

A document's features are its words, the 3- and 4-grams of characters, and, for a word that repeats the one before it,
a vector of its own for that. Since the output is linear in the average, a fitted model is kept as one number per
vector (its part of the log-odds), and scoring is a gather and a mean.

Null and empty texts have no features: they get the share of label 1 among the labels. Repeated rows get equal scores;
further columns are ignored. Without learnable labels of both classes every score is that share (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.base import held_out, labelled_sample
from flowlens.llm.vectors import Characters, U, Words, batches, mix

BITS = 17
SIZES = (3, 4)
PER_CLASS = 1500
DIMENSIONS = 16
EPOCHS = 3
#: Few texts are gone through oftener, up to this number of steps, so that little data is not learnt too little from.
STEPS = 9000
THRESHOLD = 0.3


REPEATED = mix(np.array([1], U))[0]


class Features:
    """The vector numbers of some texts: those of words with the text they belong to, those of characters by place."""

    def __init__(self, texts: list, bits: int):
        words, self.chars, top = Words(texts), Characters(texts, max(SIZES)), U(64 - bits)
        h, owner = words.hashes, words.owner()
        same = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
        self.owner = np.concatenate([owner, owner[same]])
        self.words = (np.concatenate([h, np.full(len(same), REPEATED)]) >> top).astype(np.int64)
        self.grams = [g for n, g in enumerate(self.chars.buckets(max(SIZES), bits), 1) if n in SIZES]

    def each(self) -> Iterator[np.ndarray]:
        order = np.argsort(self.owner, kind="stable")
        cuts = np.searchsorted(self.owner[order], np.arange(len(self.chars.lengths) + 1))
        for i, (start, n) in enumerate(zip(self.chars.starts - self.chars.pad, self.chars.lengths)):
            yield np.concatenate([self.words[order[cuts[i]:cuts[i + 1]]], *(g[start:start + n] for g in self.grams)])


class QualityModel:
    def __init__(self, sample: pd.DataFrame, share: float, bits: int = BITS, dimensions: int = DIMENSIONS,
                 epochs: int = EPOCHS, rate: float = 0.5):
        """sample: columns text and label; share: of label 1 among all that is learnt from."""
        self.bits, self.share, self.parts, self.bias = bits, share, None, 0.0
        if sample.label.nunique() < 2:
            return
        data = []
        for a, b in batches(list(sample.text)):
            for i, keys in enumerate(Features(list(sample.text[a:b]), bits).each(), a):
                at, times = np.unique(keys, return_counts=True)
                if len(at):
                    data.append((at, (times / times.sum()).astype(np.float32), int(sample.label.iat[i])))
        random = np.random.default_rng(11)
        vectors = random.uniform(-1, 1, (1 << bits, dimensions)).astype(np.float32) / dimensions
        output, bias = np.zeros((dimensions, 2), np.float32), np.zeros(2, np.float32)
        epochs = max(epochs, -(-STEPS // max(1, len(data))))
        step, steps = 0, epochs * len(data)
        for _ in range(epochs):
            for i in random.permutation(len(data)):
                at, x, label = data[i]
                now, step = rate * (1 - step / steps), step + 1
                hidden = x @ vectors[at]
                error = hidden @ output + bias
                error = np.exp(error - error.max())
                error /= error.sum()
                error[label] -= 1
                back = output @ error
                output -= now * np.outer(hidden, error)
                bias -= now * error
                # The step on an average of many vectors is tiny for each; scaled by their number it is plain SGD
                # on the sum, held to unit length of the whole change.
                vectors[at] -= (now * x * min(len(at), 1 / float(x @ x)))[:, None] * back
        self.parts = (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32)
        # Learnt on as many of either class: moved to the labels' own shares.
        seen = float(sample.label.mean())
        self.bias = float(bias[1] - bias[0] + np.log(share / (1 - share)) - np.log(seen / (1 - seen)))

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if self.parts is None:
            return out
        for a, b in batches(texts):
            f = Features(texts[a:b], self.bits)
            total = np.bincount(f.owner, self.parts[f.words], b - a).astype(float)
            number = np.bincount(f.owner, minlength=b - a) + len(f.grams) * f.chars.lengths
            for g in f.grams:
                total += f.chars.sums(self.parts[g])
            odds = np.clip(total / np.maximum(number, 1) + self.bias, -30, 30)
            out[a:b] = np.where(number > 0, 1 / (1 + np.exp(-odds)), self.share)
        return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS) -> QualityModel:
    """A model from at most ``per_class`` labelled documents of each class, none of them held out."""
    sample, share = labelled_sample(docs, labels, "quality", per_class)
    return QualityModel(sample, share, bits)


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = shared.value.score(list(f.text))
            yield pd.DataFrame({"doc_id": f.doc_id, "held_out": f.held_out, "score": s,
                                "predicted": (s >= threshold).astype(np.int32)})

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(
        run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(list(text)))

    return docs.where(good(F.col("text")) >= threshold)
