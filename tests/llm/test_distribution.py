"""Sharding, importance resampling and ranked search: brute force, properties, and the odd cases of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import lexical, resample, sharding
from flowlens.llm.base import positions
from flowlens.llm.words import LOWER, MARK, SENTINEL, WordPattern, numbers

SCHEMA = "doc_id long, text string, source string, shard int, position string"
LONG = " ".join(f"long{i % 97} Wort" for i in range(40_000))
ODD = [(1, None, None), (2, "", "a"), (3, " \t\n!!", "a"), (4, "One two", None), (4, "One two", None), (4, "three", None),
       (None, "no id here", "a"), (None, "no id here", "a"), (None, None, "b"), (5, LONG, "b"), (6, LONG, "b"),
       (7, "été naïve \0 日本 🎉 ÉTÉ x", "c"), (8, "one ONE oNe", "c")]
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "x") for r in ODD], SCHEMA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWERED))


def made(n, seed=1, sources=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))),
             None if rng.random() < 0.05 else "hot" if rng.random() < 0.4 else f"s{rng.randrange(sources)}") for i in range(n)]


# One pass over joined texts


def test_runs_never_cross_texts():
    pattern = resample.WORD
    texts = ["a b c", "", None, "d", "e f", "\0g\0 H1 i", "x" * 9 + " y"]
    raw = [None if t is None else t.encode() for t in texts]
    names = {}
    number = lambda run: MARK if run == SENTINEL else names.setdefault(run, len(names))
    found = defaultdict(list)
    for n, owner, value in numbers(raw, pattern, number, 3):
        back = {v: k.decode() for k, v in names.items()}
        for o, v in zip(owner, value):
            found[o, n].append(back[v])
    for i, text in enumerate(texts):
        w = words(text)
        for n in (1, 2, 3):
            assert found[i, n] == [" ".join(w[j:j + n]) for j in range(len(w) - n + 1)]


def test_runs_over_cut_lists(monkeypatch):
    """The list of matches is cut between words; runs that reach over a cut are found once."""
    monkeypatch.setattr("flowlens.llm.words.PIECE", 7)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "dddd"]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    number = lambda run: MARK if run == SENTINEL else zlib.crc32(run)
    for n, owner, value in numbers([t.encode() for t in texts], resample.WORD, number, 4):
        want = [(i, zlib.crc32(" ".join(t.split()[j:j + n]).encode())) for i, t in enumerate(texts)
                for j in range(len(t.split()) - n + 1)]
        assert list(zip(owner.tolist(), value.tolist())) == want


# Global positions


def test_positions_are_a_total_order(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(500)] + [(1, 5)] * 200, "a int, tie int").repartition(7)
    out = [tuple(r) for r in positions(rows, [F.col("a").desc()]).select("a", "position", "tie").collect()]
    assert sorted(p for _, p, _ in out) == list(range(700))
    by_place = [a for a, _, _ in sorted(out, key=lambda r: r[1])]
    assert by_place == sorted(by_place, reverse=True)
    assert positions(rows.limit(0), [F.col("a")]).collect() == []


# Sharding


@pytest.mark.parametrize("n,shards", [(0, 5), (3, 5), (1000, 24)])
def test_shards_hold_the_mixture(spark, n, shards):
    docs = spark.createDataFrame(made(n), "doc_id long, text string, source string")
    out = sharding.sharded(docs, shards).collect()
    assert sorted(r.doc_id for r in out) == list(range(n))
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r)
    sizes = [len(by_shard[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    total = Counter(r.source for r in out)
    for rows in by_shard.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        for source, count in Counter(r.source for r in rows).items():
            assert abs(count - total[source] / shards) <= 3
    if n > 100:  # the start of a shard holds the mixture too
        for rows in by_shard.values():
            head = Counter(r.source for r in rows if r.slot < len(rows) / 2)
            assert abs(head["hot"] - total["hot"] / shards / 2) <= 3


def test_shards_match_a_plain_version_and_do_not_depend_on_partitions(spark):
    rows = made(400, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = ({r.doc_id: (r.shard, r.slot) for r in sharding.sharded(docs.repartition(k), 7, seed=3).collect()} for k in (1, 13))
    assert one == two
    unit = lambda *parts: (int(hashlib.md5(":".join(parts).encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    by_source = defaultdict(list)
    for key, text, source in rows:
        raw = text.encode()
        by_source[source].append((hashlib.md5(f"3:{key}:{zlib.crc32(raw)}:{len(raw)}".encode()).hexdigest(), key))
    order = []
    for source, members in by_source.items():
        u = unit("3", *([] if source is None else [source]))
        order += [((i + u) / len(members), source or "", key) for i, (_, key) in enumerate(sorted(members))]
    seen, want = Counter(), {}
    for at, (_, _, key) in enumerate(sorted(order)):
        shard = at * 7 // len(rows)
        want[key] = (shard, seen[shard])
        seen[shard] += 1
    assert one == want


def test_shards_of_odd_rows(spark, odd):
    out = sharding.sharded(odd, 4, shard="part", slot="at")
    assert out.columns == [*odd.columns, "part", "at"]
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter(ODD)
    assert sorted(Counter(r.part for r in rows).values()) == [3, 3, 3, 4]
    assert sharding.sharded(odd.limit(0), 4, shard="part", slot="at").collect() == []
    with pytest.raises(ValueError):
        sharding.sharded(odd, 0, shard="part")
    one = sharding.interleaved(odd.drop("shard"), 1).collect()
    assert sorted(r.slot for r in one) == list(range(len(ODD)))


def test_written_shards_are_read_in_slot_order(spark, tmp_path):
    docs = spark.createDataFrame(made(300), "doc_id long, text string, source string")
    out = sharding.sharded(docs, 5)
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in out.collect()}
    files = back.groupBy(F.input_file_name().alias("file"), "shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"),
                                                                        F.count("*").alias("n")).collect()
    assert all(f.b - f.a + 1 == f.n for f in files)


# Importance resampling


def brute_resample(docs, target, longest, buckets, least, per_cent, seed=2024):
    def features(text):
        w = words(text)
        return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for key, text, *_ in docs:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((key, len(words(text)), len(f), weight, score))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = able[:len(able) * per_cent // 100]
    return out, [(r[0], i) for i, r in enumerate(drawn, 1)]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 64)])
def test_resampling_matches_brute_force(spark, longest, buckets):
    rows, target = made(300, 9), ["w3 w4 w5 w200 w201", "w200 w250 w3", None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = resample.resampled(docs, wanted, longest, buckets, 5, 20).collect()
    every, drawn = brute_resample(rows, target, longest, buckets, 5, 20)
    assert sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in out) == sorted(every)
    assert sorted((r.doc_id, r["rank"]) for r in out if r["rank"]) == sorted(drawn) and len(drawn) > 40


def test_resampling_of_odd_rows(spark, odd):
    target = spark.createDataFrame([(1, "one two long3")], "item_id long, text string")
    out = resample.resampled(odd, target, least_words=2, per_cent=50).collect()
    every, drawn = brute_resample([r[:2] for r in ODD], ["one two long3"], 1, 10_000, 2, 50)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in out], key=key) == sorted(every, key=key)
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, len(drawn) + 1))
    assert Counter(r.doc_id for r in out if r["rank"]) == Counter(k for k, _ in drawn)
    for docs, wanted in ((odd.limit(0), target), (odd, target.limit(0))):
        assert resample.resampled(docs, wanted).count() == docs.count()


# Ranked search


def brute_search(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWERED))
    found = [(d, Counter(terms(t))) for d, t, *_ in docs]
    N = sum(bool(c) for _, c in found)
    L = sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        asked = set(terms(text))
        weight = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) for t in asked}
        scored = []
        for d, c in found:
            if c:
                m = 50 + 50 * c.total() * N // L
                scored.append((-sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked & set(c)), d))
        best = sorted((s for s in scored if s[0] < 0), key=lambda s: (s[0], math.inf if s[1] is None else s[1]))[:k]
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(best, 1)]
    return out


def plain(rows):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


@pytest.mark.parametrize("stages,block,bundle,k", [(4, 64, 3, 5), (1, 1000, 256, 50), (7, 10, 1, 3)])
def test_search_matches_brute_force(spark, stages, block, bundle, k):
    rows = made(300, 4) + [(1000 + i, "w299 w298 w3 w3", "hot") for i in range(60)]  # copies: ties across blocks
    items = [(i, " ".join(f"W{j}" for j in range(i * 7, i * 7 + 12))) for i in range(8)] + [(50, "w299 w3"), (51, "unknown"), (52, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    out = lexical.search(docs, asked, k, stages, block, bundle).collect()
    assert plain(out) == sorted(brute_search(rows, items, k), key=str)


def test_search_with_terms_sent_in_parts(spark):
    rows = made(120, 6)
    items = [(i, " ".join(f"w{j}" for j in range(i, 300, 11))) for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), 4, vocabulary=400).collect()
    assert plain(out) == sorted(brute_search(rows, items, 4), key=str)


def test_search_on_odd_rows(spark, odd):
    items = [(1, "one"), (1, "one"), (1, "two here"), (None, "id LONG3 x"), (2, ""), (3, None), (4, "x été 日本")]
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    out = lexical.search(odd, asked, 3, block=2).collect()
    distinct = list(dict.fromkeys(items))
    assert Counter(plain(out)) == Counter(sorted(brute_search([r[:2] for r in ODD], distinct, 3), key=str))
    assert lexical.search(odd.limit(0), asked).collect() == lexical.search(odd, asked.limit(0)).collect() == []


def test_large_doc_ids_stay_exact(spark):
    rows = [(2**62 + i, "same words here") for i in range(5)] + [(None, "same words")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), [(2**61 + 1, "same")]
    out = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), 4, block=2).collect()
    assert plain(out) == sorted(brute_search(rows, items, 4), key=str)


def test_pieces_of_a_long_text_keep_words_whole(monkeypatch):
    monkeypatch.setattr("flowlens.llm.words.PIECE", 5)
    raw = "alpha beta été gamma-delta 日本語".encode().translate(LOWER)
    pattern = WordPattern(rb"\x00-\x2F\x3A-\x60\x7B-\x7F")
    assert [w.decode() for part in pattern.lists(raw) for w in part] == ["alpha", "beta", "été", "gamma", "delta", "日本語"]
    assert np.concatenate([v for _, _, v in numbers([raw], pattern, lambda w: MARK if w == SENTINEL else len(w))]).tolist() == [
        5, 4, 5, 5, 5, 9]
