"""Quality rules as a short-circuit cascade.

Every document gets its base counts. Documents that pass the base rule go through a list of further rules; one that
fails is rejected and later rules don't see it. Each rule's cost and rejection rate are measured on a sample of
documents, and rules run in order of rejections per second, so that cheap and selective ones come first. The order
changes the time a document takes, never the verdict, which is that all rules hold.

Null and empty texts have no words: all counts are 0 and the base rule fails. Repeated rows get equal results; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.vectors import BASE, U, Words, batches, mix

SAMPLE = 1000
SYMBOL = re.compile(r"[#*$%&|<>]")
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
UPPER, LOWER = re.compile(r"[A-Z]"), re.compile(r"[a-z]")
SHOUT = re.compile(r"!!(?=[\x20\x09-\x0D]|\Z)")

#: Whether a text passes, given its base counts. Whole-number comparisons, so SQL can state them alike.
Rule = Callable[[str, dict], bool]
RULES: dict[str, Rule] = {
    "few_symbols": lambda text, n: 10 * n["n_symbols"] <= n["n_words"],
    "mean_word_length": lambda text, n: 2 * n["n_words"] <= n["word_chars"] <= 15 * n["n_words"],
    "few_repeated_lines": lambda text, n: 10 * n["n_dup_lines"] <= 3 * (text.count("\n") + 1),
    "few_shouted_words": lambda text, n: 10 * len(SHOUT.findall(text)) <= n["n_words"],
    "mostly_lower_case": lambda text, n: len(UPPER.findall(text)) <= len(LOWER.findall(text)),
}


def repeated_words(words: Words) -> np.ndarray:
    """Per text, the words inside a 3-word window that the text has more than once."""
    h, owner = words.hashes, words.owner()
    inside = np.zeros(len(h), bool)
    if len(h) >= 3:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        key = mix((h[at] * U(BASE) ^ mix(h[at + 1] + U(1))) * U(BASE) ^ mix(h[at + 2] + U(2))
                  ^ mix(owner[at].astype(U) + U(3)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for k in range(3):
            inside[at[twice] + k] = True
    return np.bincount(owner, inside, len(words.offsets) - 1).astype(np.int64)


def base_counts(texts: list) -> pd.DataFrame:
    parts = []
    for a, b in batches(texts):
        words = Words(texts[a:b])
        letter = np.concatenate([[0], np.cumsum((words.bytes & 0xC0) != 0x80)])
        chars = np.bincount(words.owner(), letter[words.ends] - letter[words.starts], b - a)
        lines = []
        for text in texts[a:b]:
            full = [x for x in text.split("\n") if HAS_WORD.search(x)] if text and "\n" in text else ()
            lines.append(len(full) - len(set(full)))
        parts.append(pd.DataFrame({
            "n_words": np.diff(words.offsets), "word_chars": chars.astype(np.int64),
            "n_symbols": [len(SYMBOL.findall(t)) if t else 0 for t in texts[a:b]],
            "n_dup_lines": lines, "n_repeat_words": repeated_words(words)}))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: np.empty(0, np.int64) for c in columns})


def base_failed(counts: pd.DataFrame) -> pd.Series:
    return (counts.n_words < 50) | (100 * counts.n_repeat_words > 50 * counts.n_words)


def cascade_order(texts: list[str], rules: dict[str, Rule] | None = None) -> list[str]:
    """Rules by rejections per second on these texts, the best first; names settle ties."""
    rules = RULES if rules is None else rules
    counts = base_counts(texts)
    rows = [(t, n) for t, n, bad in zip(texts, counts.to_dict("records"), base_failed(counts)) if not bad]
    gain = {}
    for name, rule in rules.items():
        start = time.perf_counter()
        rejected = sum(not rule(t, n) for t, n in rows)
        gain[name] = rejected / max(time.perf_counter() - start, 1e-9)
    return sorted(rules, key=lambda name: (-gain[name], name))


def sample_order(docs: DataFrame, size: int = SAMPLE) -> list[str]:
    """The order of rules measured on at most ``size`` texts, the first by hash of doc_id.

    Only hashes are ordered, so that tasks send whole texts to the driver for the sample alone.
    """
    known = docs.where(F.col("text").isNotNull()).select(F.xxhash64("doc_id", F.lit(5)).alias("h"), "text")
    last = known.select("h").orderBy("h").limit(size).agg(F.max("h")).first()[0]
    if last is None:
        return cascade_order([])
    return cascade_order([r.text for r in known.where(F.col("h") <= last).select("text").limit(size).collect()])


def judge(docs: DataFrame, order: list[str]) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the rule that rejected it (null if none) of every row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = list(f.text)
            out = base_counts(texts)
            failed = base_failed(out).to_numpy()
            rejected: list[str | None] = [None] * len(texts)
            for i, n in zip(np.flatnonzero(~failed), out[~failed].to_dict("records")):
                rejected[i] = next((name for name in order if not RULES[name](texts[i], n)), None)
            out.insert(0, "doc_id", f.doc_id.to_numpy())
            out["base_failed"] = failed
            out["kept"] = ~failed & np.array([r is None for r in rejected], bool)
            out["rejected_by"] = rejected
            yield out

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, rejected_by string")
