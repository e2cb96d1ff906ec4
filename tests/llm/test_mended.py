"""Cases that were once wrong: very large numbers, clashing names, null keys, repeated rows, few labels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import bpe, jaccard, mixing, quality, substrings, topk, warc
from flowlens.llm.base import labelled_sample
from flowlens.llm.vectors import mix

LIMIT = 2**63 - 1


def brute_top(rows, asked, k=20):
    """Scores in whole numbers of any size, held to a long's ends."""
    scaled = [(i, [math.floor(64 * x) if abs(x) < 2.0**1000 else 64 * int(x) for x in v]) for i, v in rows]
    out = []
    for q, a in scaled:
        if q in asked:
            scores = [(-max(-LIMIT - 1, min(LIMIT, sum(x * y for x, y in zip(a, b)))), i) for i, b in scaled
                      if i != q and len(a) == len(b)]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [
    [(0, [1e16, 0.0]), (1, [1.0, 1.0]), (2, [2e16, 1.0])],
    [(0, [1e14, 1e14]), (1, [1e14, 1e14]), (2, [-1e14, 3.0]), (3, [0.5, -0.25])],
    [(0, [1e308, -1e308]), (1, [1e308, 1e308]), (2, [-1e-300, 0.0]), (3, [3e15, 7.25])],
    [(0, []), (1, []), (2, [])],
    [(i, [float((i * j) % 7) - 3 for j in range(40)]) for i in range(50)] + [(99, [4e4] * 40), (98, [-3e9] * 40)],
])
def test_no_finite_vector_is_left_out(spark, rows):
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert vectors.count() == len(rows)
    out = topk.top_k(vectors, vectors.where("vec_id % 3 = 0"))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == brute_top(
        rows, {i for i, _ in rows if i % 3 == 0})


@pytest.mark.parametrize("shared,more", [(700_009, 123_531), (700_077, 123_543)])
def test_large_sets_at_the_very_threshold_link(shared, more):
    """85 % to the last token: sums beyond 2^24 must stay exact."""
    every = mix(np.arange(1, shared + more + 1, dtype=np.uint64))
    assert 100 * shared >= 85 * (shared + more)
    assert jaccard.block_links([every[:shared], every], np.array([0, 0]), 85).tolist() == [0, 0]
    assert jaccard.block_links([every[:shared - 60], every], np.array([0, 0]), 85).tolist() == [0, 1]


def test_stages_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(80))
    names = "doc_id long, text string, source string, gone long, __of long, __gone long, __tie string, __kept string, __mark int, __copies int"
    docs = spark.createDataFrame([(1, text, "a", 1, 7, 7, "t", "k", 3, 4), (2, text, "a", 2, 8, 8, "t", "k", 3, 4),
                                  (3, "x " * 60, "b", 3, 9, 9, "t", "k", 3, 4)], names)
    for stage in (jaccard.one_of_each, substrings.deduplicated, mixing.mixed):
        out = stage(docs)
        assert out.columns == docs.columns and 0 < out.count() <= 9
        assert out.select("__of", "gone").distinct().count() <= 3
    assert [r.doc_id for r in jaccard.one_of_each(docs).orderBy("doc_id").collect()] == [1, 3]


def test_a_null_page_revisits(spark):
    html = "<p>" + "x" * 200
    pages = spark.createDataFrame([(1, "u", html), (None, "u", html), (None, "v", html), (None, "w", "y" * 300), (5, "z", html)],
                                  "page_id long, url string, html string")
    rows = warc.archive(pages).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in rows), key=str) == sorted(
        [(1, "response", None), (None, "revisit", 1), (None, "revisit", 1), (None, "response", None), (5, "revisit", 1)], key=str)


def test_a_sample_has_one_text_for_each_doc_id_and_a_bound_in_bytes(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(i, "x" * 1000) for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    sample, share = labelled_sample(docs, labels, "quality", 100)
    assert sample.doc_id.is_unique and 0 < share < 1
    few, _ = labelled_sample(docs, labels, "quality", 100, most_bytes=3500)
    assert set(few.groupby("label").text.apply(lambda t: t.str.len().sum() <= 3500)) == {True}
    one, _ = labelled_sample(docs, labels, "quality", 100, most_bytes=1)
    assert sorted(one.label) == [0, 1]


def test_few_labels_are_learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(scores[k].predicted, v) for k, v in truth.items() if scores[k].held_out]
    open_ = [(scores[k].predicted, v) for k, v in truth.items() if not scores[k].held_out]
    assert all(p == v for p, v in open_) and sum(p == v for p, v in held) >= 0.85 * len(held)
    assert any(p == v == 0 for p, v in held)


def test_remembered_pieces_are_bounded_and_let_go():
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    with bpe.tokenizer(path) as t:
        want = [t.encode(f"word{i} other{i}") for i in range(300)]
        t.pieces.most = t.words.most = 10
        assert [t.encode(f"word{i} other{i}") for i in range(300)] == want
        assert len(t.pieces.new) <= 300 and t.pieces.new
    assert not t.pieces.new and not t.pieces.old and not t.words.new
    t.pieces.most = t.words.most = bpe.REMEMBERED
