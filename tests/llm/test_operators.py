"""The operators on small tables: brute force, round trips, held-out accuracy, and the odd cases of every contract."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import bpe, jaccard, language, mixing, quality, rules, substrings, topk, toxicity, warc
from flowlens.llm.components import components
from flowlens.llm.queries import VOCABULARY, op1_toxicity, op2_language, op3_quality

SMALL = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(VOCABULARY)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int"
LONG = " ".join(f"long{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None, None, 1), (2, "", "en", "a", 0, 0), (3, " \t\n", "en", "a", 3, 1), (4, "one", "en", None, 3, 0),
    (4, "one", "en", None, 3, 0), (None, "no number here", "en", "a", 5, 1), (5, LONG, "en", "b", len(LONG), 0),
    (6, LONG, "de", "b", len(LONG), 0), (7, "a b c", None, "b", 5, 0), (8, "été naïve 日本 🎉 <|endoftext|> x", "fr", "c", 9, 1),
    (9, "one", "en", "c", 3, 0), (10, "#$% ### 12 34", "en", "c", 9, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def tables(spark, *names):
    return [spark.read.parquet(f"{SMALL}/{name}.parquet") for name in names]


def truth(spark, column):
    docs, labels = tables(spark, "documents", "labels")
    return {r.doc_id: r[column] for r in labels.collect()}


def fold(key):
    return zlib.crc32(str(key).encode()) % 5


# Classifiers


@pytest.mark.parametrize("query,column,least", [(op1_toxicity, "toxic", 0.93), (op3_quality, "quality", 0.97)])
def test_classifier_on_held_out_rows(spark, query, column, least):
    labels, rows = truth(spark, column), query(spark, SMALL).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (fold(r.doc_id) == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= least * len(held)


def test_language_on_held_out_rows(spark):
    docs, = tables(spark, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = op2_language(spark, SMALL).collect()
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(held) >= 0.95 * len(held)


def test_classifiers_learn_only_from_text_and_open_folds(spark):
    docs, labels = tables(spark, "documents", "labels")
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic"))
                              .otherwise(F.col("toxic")))
    some = docs.where("doc_id < 60")
    a = toxicity.score(some, toxicity.fit(docs, labels, 100)).orderBy("doc_id").collect()
    b = toxicity.score(some, toxicity.fit(docs, wrong, 100)).orderBy("doc_id").collect()
    assert [r.score for r in a] == [r.score for r in b]


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(11)], "doc_id long, toxic int, q boolean")
    labels = labels.withColumn("quality", F.col("q").cast("int"))
    none = labels.where("false")
    for module in (toxicity, quality):
        for known in (labels, none):
            rows = module.score(odd, module.fit(odd, known)).collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
            twins = [r.score for r in rows if r.doc_id == 4]
            assert twins[0] == twins[1]
            assert all(r.score == 0 for r in rows) or known is labels
        assert module.score(empty, module.fit(empty, none)).count() == 0
    kept = quality.keep_good(odd, quality.fit(odd, none))
    assert kept.columns == odd.columns
    rows = language.predict(odd, language.fit(odd)).collect()
    by = {r.doc_id: r for r in rows}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3, 10)[:3])
    assert by[10].lang_pred == "und" and by[4].lang_pred != "und" and len(rows) == len(ODD)
    assert {r.lang_pred for r in language.predict(odd, language.fit(empty)).collect()} == {"und"}
    assert language.predict(empty, language.fit(empty)).count() == 0


def test_kneser_ney_sums_to_one():
    """The two class models are distributions, so a class compared with itself says nothing anywhere."""
    texts = ["some words are here", "other words were there", "some others"]
    tables = toxicity._log_ratios(texts * 2, np.array([True] * 3 + [False] * 3), 4, 2)
    assert all(np.allclose(t.values, 0) for pair in tables for t in pair)


def test_lookup_finds_every_key():
    keys = np.unique(np.random.default_rng(1).integers(1, 2**63, 20_000, dtype=np.uint64))
    table = toxicity.Lookup(keys, np.arange(len(keys)))
    value, known = table.get(keys)
    assert known.all() and (value == np.arange(len(keys), dtype=np.float32)).all()
    assert table.get(keys + np.uint64(1))[1].sum() < 10


def test_toxic_compounds_of_a_learnt_stem_are_caught():
    random.seed(3)
    parts = "an der ge ver ung lich keit schaft ein aus".split()

    def text(bad):
        out = ["".join(random.choices(parts, k=random.randint(1, 3))) for _ in range(60)]
        for _ in range(3 * bad):
            out[random.randrange(60)] = "loxo" + "".join(random.choices(parts, k=2))
        return " ".join(out)

    import pandas as pd
    y = [i % 2 for i in range(400)]
    sample = pd.DataFrame({"text": [text(v) for v in y], "label": y, "fold": [1 + i % 4 for i in range(400)]})
    model = toxicity.ToxicityModel(sample, 0.5)
    test = [text(i % 2) for i in range(200)]
    assert np.mean((model.score(test) >= 0.5) == (np.arange(200) % 2)) > 0.95


# Jaccard join


def shingles(text, k=4):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in words(text)]
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(docs, threshold=85):
    sets = {k: shingles(t) for k, t in docs}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_copies(seed, n, vocabulary, groups):
    random.seed(seed)
    bases = [[f"w{random.randrange(vocabulary)}" for _ in range(random.randint(1, 150))] for _ in range(groups)]
    docs = []
    for i in range(n):
        text = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
            at = random.randrange(len(text) + 1)
            text[at:at + random.choice([0, 1])] = [f"x{random.randrange(50)}"] * random.choice([0, 1, 1])
        docs.append((i, " ".join(text)))
    return docs


@pytest.mark.parametrize("seed,n,vocabulary,groups,rare,small", [
    (1, 300, 1000, 60, 32, 32), (2, 300, 6, 40, 4, 4), (3, 400, 1000, 2, 8, 8), (4, 250, 300, 12, 1, 2)])
def test_components_match_brute_force(spark, monkeypatch, seed, n, vocabulary, groups, rare, small):
    monkeypatch.setattr(jaccard, "RARE", rare)
    monkeypatch.setattr(jaccard, "VERY_FREQUENT", 4 * rare)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    docs = near_copies(seed, n, vocabulary, groups)
    found = jaccard.component_ids(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(docs)


def test_sets_that_link_share_a_signature():
    """For every class of tokens, against random sets around the threshold."""
    rng = np.random.default_rng(5)
    for trial in range(300):
        n = int(rng.integers(6, 400))
        pool = rng.integers(0, 2**64, 3 * n + 10, dtype=np.uint64)
        tokens = np.unique(rng.choice(pool, len(pool) // int(rng.integers(1, 5)), replace=False))
        sign = jaccard.Signatures(tokens, rng.choice([40, 5000], len(tokens)))
        a = np.unique(pool[:n])
        drop = int(rng.integers(0, max(1, n // 6) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], pool[n:n + int(rng.integers(0, drop + 1))]]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and len(a) != both or len(b) != both:
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert len(np.intersect1d(sign.of(a), sign.of(b)))


def test_jaccard_odd_rows(spark, odd, empty):
    rows = jaccard.component_ids(odd).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)]
    assert by[4] == [(1, 4), (1, 4)] and by[9] == [(1, 4)] and by[None] == [(1, None)] or by[None][0][1] is None
    assert by[5] == [(977, 5)] and by[6] == [(977, 5)]
    assert jaccard.component_ids(empty).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 4, None, 5, 7, 8, 10])


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.where("false")).count() == 0


# Top k


def brute_top(vectors, k=20):
    rows = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in vectors
            if v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("size,spread", [(64, 1.0), (7, 0.05), (40, 3.0)])
def test_top_k_matches_brute_force(spark, size, spread):
    rng = np.random.default_rng(size)
    data = [(i, [float(x) for x in rng.normal(0, spread, size)]) for i in range(300)]
    data[3] = (3, None)
    data[20] = (20, [float("nan")] + data[20][1][1:])
    data[41] = (41, [None] + data[41][1][1:])
    data[60] = (60, data[61][1])
    data[5] = (5, [])
    vectors = topk.whole_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    found = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), group=40, query_block=5).collect()
    assert len(found) == 20 * 14 and {tuple(r) for r in found} == brute_top(data)


def test_top_k_of_few_or_no_vectors(spark):
    empty = topk.whole_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(empty, empty).count() == 0
    two = topk.whole_vectors(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in topk.top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 64 * 128)]


# Mixing


def test_mix_meets_its_targets(spark):
    docs, = tables(spark, "documents")
    rows = mixing.plan(docs).collect()
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1
    for place, source in enumerate(sorted(by)):
        r = by[source]
        assert abs(sum(x["size"] * x.copies for x in r) - r[0].target) <= max(0.05 * r[0].target, 100)
        assert r[0].target <= 3 * r[0].source_size and all(0 <= x.copies <= 3 for x in r)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_targets_stop_at_three_times_the_size(spark):
    sized = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 20), ("d", 500), (None, 7)], "source string, size long")
    rows = {r.source: r for r in mixing.source_targets(sized).collect()}
    assert rows["b"].target == 30 and rows["c"].target == 60 and rows[None].target == 21
    rest = 1537 - 111
    assert rows["a"].target == pytest.approx(rest / 2) and rows["d"].target == pytest.approx(rest / 2)


def test_mix_odd_rows(spark, odd, empty):
    rows = mixing.plan(odd).collect()
    assert len(rows) == len(ODD) and all(r.copies <= 3 for r in rows) and mixing.plan(empty).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(odd).collect()))
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(empty).count() == 0


# WARC


def test_warc_round_trip_by_record(spark, tmp_path):
    body = "<p>" + "x" * 120
    pages = spark.createDataFrame(
        [(3, "u3", body, "extra"), (1, "u1", body, ""), (2, None, None, ""), (4, "u4", "short", ""), (5, "u5", "short", ""),
         (6, "u\n6", "é" * 60, ""), (1, "u1", body, ""), (None, "u", body, "")], "page_id long, url string, html string, x string")
    folder = f"file://{tmp_path}/bundles"
    index = warc.write(pages.coalesce(2), folder)
    rows = {(r.page_id, r.record_type): r for r in warc.read(index, folder).collect()}
    assert rows[3, "revisit"].refers_to == 1 and rows[3, "revisit"].payload_bytes == 123
    assert rows[1, "response"].payload_digest == hashlib.sha256(body.encode()).hexdigest()
    assert rows[2, "response"].payload_bytes == 0 and (4, "response") in rows and (5, "response") in rows
    assert rows[6, "response"].payload_bytes == 120
    one = index.where("page_id = 6")
    assert [r.payload_bytes for r in warc.read(one, folder).collect()] == [120]
    assert warc.archive(pages.where("false")).count() == 0


def test_bundle_is_plain_zstandard_with_a_seek_table(tmp_path):
    import zstandard
    path = tmp_path / "b.zst"
    with open(path, "wb") as f:
        writer = warc.BundleWriter(f)
        data = [bytes([i]) * 100_000 for i in range(7)]
        places = [writer.add(d) for d in data]
        writer.close()
    with open(path, "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        frames = warc.seek_table(f, path.stat().st_size)
        assert whole == b"".join(data) and sum(x[2] for x in frames) == len(whole) and len(frames) > 2
        for (frame, at), d in zip(places, data):
            f.seek(frames[frame][0])
            assert zstandard.ZstdDecompressor().decompress(f.read(frames[frame][1]))[at:at + len(d)] == d


# BPE


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_bpe_equals_the_library(spark, reference):
    docs, = tables(spark, "documents")
    texts = [r.text for r in docs.collect()]
    mine = bpe.Bpe(PATH, remembered=500)
    expected = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [mine.encode(t) for t in texts] == expected
    assert all(mine.decode(i) == reference.decode(i, skip_special_tokens=False) for i in expected)


def test_bpe_on_random_strings(reference):
    random.seed(2)
    mine = bpe.Bpe(PATH)
    letters = list("ab Z'0½²_.,!  \n\t\r\x0b\x1c\x85\xa0　é日🎉𝟙") + ["'s", "'ll", "<|endoftext|>", "the ", "    "]
    texts = ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(20_000)]
    expected = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, e in zip(texts, expected) if mine.encode(t) != e] == []


def test_bpe_odd_rows(spark, odd, empty, reference):
    rows = bpe.round_trip(odd, PATH).collect()
    for r, (key, text, *_) in zip(rows, ODD):
        ids = reference.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (key, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(empty, PATH).count() == 0
    back = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert [r.text for r in back] == [t or "" for _, t, *_ in ODD]


# Substrings


def brute_removals(docs, window=50):
    first = {}
    split = {k: words(t) for k, t in docs}
    for k, w in split.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, k), k)
    out = {}
    for k, w in split.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < k:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def passages(seed, vocabulary):
    random.seed(seed)
    letters = [f"w{i}" for i in range(vocabulary)]
    shared = [[random.choice(letters) for _ in range(random.randint(50, 120))] for _ in range(4)]
    docs = []
    for i in range(60):
        text = []
        for _ in range(random.randint(1, 4)):
            part = random.choice(shared)
            a = random.randint(0, 20)
            text += random.choice([part, part[a:], part[:len(part) - a], [random.choice(letters)] * random.randint(0, 130),
                                   [random.choice(letters) for _ in range(random.randint(0, 80))]])
        docs.append((i, " ".join(text)))
    return docs + [(60, docs[3][1]), (61, docs[3][1] + " end")]


@pytest.mark.parametrize("seed,vocabulary,few", [
    (1, 2000, substrings.FEW), (2, 2, substrings.FEW), (3, 1, 8), (4, 30, substrings.FEW), (5, 2000, 8), (6, 2, 0)])
def test_removals_match_brute_force(spark, monkeypatch, seed, vocabulary, few):
    monkeypatch.setattr(substrings, "FEW", few)
    docs = passages(seed, vocabulary)
    found = substrings.removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute_removals(docs)


def test_equal_windows_have_equal_anchors():
    random.seed(9)
    for vocabulary in (1, 2, 3, 40):
        letters = [f"v{i}" for i in range(vocabulary)]
        base = [x for x in random.choices(letters, k=120) for _ in range(random.choice([1, 1, 2, 9]))]
        texts = [" ".join(random.choices(letters, k=random.randint(0, 30)) + base[i:i + 90] + random.choices(letters, k=9))
                 for i in (0, 7, 20, 40)] + ["", None]
        found = defaultdict(set)
        for a, w, starts, hashes, anchors in substrings.scan(texts, 50, substrings.LIMITS):
            every = [w.raw[s:e] for s, e in zip(w.starts, w.ends)]
            for s, anchor in zip(starts, anchors):
                found[tuple(every[s:s + 50])].add(int(anchor))
        assert found and all(len(v) == 1 for v in found.values())


def test_substrings_odd_rows(spark, odd, empty):
    rows = substrings.removals(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[6].n_removed == by[6].n_words == 30_000 and by[5].n_removed == 0
    assert by[6].kept_sha256 == hashlib.sha256(b"").hexdigest() == by[1].kept_sha256
    assert substrings.removals(empty).count() == 0
    out = substrings.deduplicated(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[6] == ("", 0) and texts[5][0] == LONG and texts[1] == (None, None)
    assert substrings.deduplicated(empty).count() == 0


# Rules


def test_rules_match_plain_counts(spark, odd, empty):
    docs, = tables(spark, "documents")
    docs = docs.select("doc_id", "text").limit(200).union(odd.select("doc_id", "text"))
    for r, (_, text) in zip(rules.judge(docs, list(rules.RULES)).collect(), docs.collect()):
        w = words(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        again = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rules.judge(empty, rules.sample_order(empty)).count() == 0


def test_order_changes_no_verdict_and_puts_good_rules_first(spark):
    docs, = tables(spark, "documents")
    orders = [list(rules.RULES), list(rules.RULES)[::-1], rules.sample_order(docs)]
    verdicts = [sorted((r.doc_id, r.kept) for r in rules.judge(docs, o).collect()) for o in orders]
    assert verdicts[0] == verdicts[1] == verdicts[2] and sorted(orders[2]) == sorted(rules.RULES)

    def slow(text, n):
        sum(range(2000))
        return True

    texts = [r.text for r in docs.limit(100).collect()]
    assert rules.cascade_order(texts, {"slow": slow, "some": lambda t, n: "a" not in t})[-1] == "slow"


def test_vocabulary_is_the_public_file():
    with open(PATH) as f:
        assert json.load(f)["model"]["type"] == "BPE"
