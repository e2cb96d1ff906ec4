"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Hashed n-grams of 1 to 3 characters; idf from the documents that may be learnt from, all of them; weights by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of each language; at last a temperature
that makes the probabilities fit labelled texts that weren't trained on.

Null texts and texts without a letter are ``und`` with score 0. Rows without a language are predicted like others but
not learnt from. Repeated rows get equal results; further columns are ignored. Without anything learnt all are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.base import fold, held_out, texts_of
from flowlens.llm.vectors import Characters, batches

BITS = 15
LONGEST = 3
PER_LANGUAGE = 400
UNKNOWN = "und"
LETTER = r"\p{L}"


def ngram_counts(texts: list, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text that has any: its place, the hash buckets of its n-grams in order, and how often each occurs."""
    for a, b in batches(texts):
        chars = Characters(texts[a:b], LONGEST)
        kinds = chars.buckets(LONGEST, bits)
        for i, (start, n) in enumerate(zip(chars.starts - chars.pad, chars.lengths)):
            if n:
                counts = np.bincount(np.concatenate([k[start:start + n] for k in kinds]), minlength=1 << bits)
                found = np.flatnonzero(counts)
                yield a + i, found, counts[found]


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each bucket occurs, and the number of texts. One row per bucket leaves a task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1 << bits) + 1, np.int64)
        for f in frames:
            for _, found, _ in ngram_counts(list(f.text), bits):
                total[found] += 1
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros((1 << bits) + 1, np.int64)
    for r in rows.collect():  # at most one row for each bucket
        out[r.bucket] = r.n
    return out[:-1], int(out[-1])


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates, for a softmax over sparse inputs."""

    def __init__(self, features: int, classes: int, rate: float = 0.5, beta: float = 1.0,
                 l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.rate + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.rate * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class LanguageModel:
    def __init__(self, sample: pd.DataFrame, frequencies: np.ndarray, texts: int, bits: int = BITS, passes: int = 5):
        """sample: columns text, lang and fold; fold 1 sets the temperature, unless it or the rest lacks rows."""
        self.languages, self.bits, self.temperature = sorted(sample.lang.unique()), bits, 1.0
        self.idf = np.log((1 + texts) / (1 + frequencies)) + 1
        if not self.languages:
            return
        code = {x: i for i, x in enumerate(self.languages)}
        data = [(self.inputs(at, n), code[sample.lang.iat[i]], sample.fold.iat[i] == 1)
                for i, at, n in ngram_counts(list(sample.text), bits)]
        train = [d for d in data if not d[2]]
        if len({d[1] for d in train}) < len({d[1] for d in data}):
            train = data
        learner = Ftrl(1 << bits, len(self.languages))
        order = np.random.default_rng(7)
        for _ in range(passes):
            for i in order.permutation(len(train)):
                (at, x), label, _ = train[i]
                learner.step(at, x, label)
        self.weights = learner.weights(slice(None)).astype(np.float32)
        check = [d for d in data if d[2]] or data
        logits = np.array([x @ self.weights[at] for (at, x), _, _ in check]).reshape(len(check), -1)
        labels = np.array([d[1] for d in check], int)
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
        losses = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).sum() for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))]) if len(check) else 1.0

    def inputs(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / np.sqrt(x @ x)

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.languages:
            for i, at, n in ngram_counts(texts, self.bits):
                at, x = self.inputs(at, n)
                p = softmax((x @ self.weights[at]) / self.temperature)
                names[i], scores[i] = self.languages[int(p.argmax())], p.max()
        return names, scores


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, bits: int = BITS) -> LanguageModel:
    """docs: doc_id, text, lang. Of each language about ``per_language`` texts are trained on, chosen by a hash of
    doc_id against that language's own share, so that a language held by a third of all rows costs no more."""
    known = docs.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0))
    frequencies, texts = document_frequencies(known, bits)
    share = known.groupBy("lang").count().select("lang", (F.lit(float(per_language)) / F.col("count")).alias("share"))
    unit = (F.xxhash64("doc_id", F.lit(23)) / F.lit(2.0**64)) + 0.5
    # One row for each language, of which the model holds a column of weights: small by construction.
    chosen = (known.select("doc_id", "lang").join(F.broadcast(share), "lang").where(unit < F.col("share"))
              .select("doc_id", "lang").distinct())
    sample = texts_of(known, chosen, "lang", [F.xxhash64("doc_id", F.lit(23)), F.col("doc_id")])
    return LanguageModel(sample, frequencies, texts, bits)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            names, scores = shared.value.predict(list(f.text))
            yield pd.DataFrame({"doc_id": f.doc_id, "held_out": f.held_out, "lang_pred": names, "score": scores})

    readable = F.when(F.col("text").rlike(LETTER), F.col("text")).alias("text")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), readable).mapInPandas(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
