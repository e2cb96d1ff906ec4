"""The pipeline's stages against plain versions of their decisions, and the registered queries of the package."""

import random
import re

import __spark_entry__ as contract
import corpus_pipeline
import pytest
from checking import compare, connect

from flowlens.llm import jaccard, substrings
from flowlens.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert len(QUERIES) == 13


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    assert compare(spark, connection, QUERIES[name], ORACLES[name], SMALL) is None


def test_stages_take_effect(spark):
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.cache()
        docs = stage(spark, before, SMALL).cache()
        if name != "bpe":
            assert docs.columns == columns and docs.dtypes == before.dtypes
        if name in ("quality", "near_duplicates"):
            assert 0 < docs.count() < before.count()
            assert docs.subtract(before).count() == 0
        if name == "near_duplicates":
            found = jaccard.component_ids(docs)
            assert found.where("component_id <> doc_id").count() == 0
        if name == "passages":
            assert docs.count() == before.count()
            assert substrings.removals(docs).where("n_removed > 0").count() == 0
        if name == "mixing":
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "bpe":
            assert docs.count() == before.count()
            assert docs.selectExpr("decoded_sha256 as d").subtract(
                before.selectExpr("sha2(coalesce(text, ''), 256) as d")).count() == 0


def test_stages_hand_texts_to_python_in_small_batches(spark):
    """Batches that a Python worker gets in the session of each stage, as the stage's result is worked out in it later."""
    def sizes(frames):
        for f in frames:
            yield f.text.str.len().agg(["count", "sum"]).to_frame().T.rename(columns={"sum": "bytes", "count": "n"})

    docs = spark.range(3000).selectExpr("id as doc_id", "concat(id, repeat(' some words', 300)) as text").repartition(1)
    docs = docs.selectExpr("*", "'en' as lang", "'a' as source", "cast(length(text) as long) as n_chars").cache()
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    try:
        for name, stage in corpus_pipeline.STAGES:
            for key in keys:
                spark.conf.unset(key)
            stage(spark, docs, SMALL)
            got = docs.select("text").mapInPandas(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < 3 << 20, name
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        corpus_pipeline.mix_sources(spark, docs, SMALL)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_run_is_the_stages_in_turn(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def five_word_similarity(a, b):
    a, b = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def four_word_similarity(a, b):
    a, b = ({tuple(t[i:i + 4]) for i in range(len(t) - 3)} for t in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_copies_from_four_fifths_on_are_dropped(spark):
    """Pairs of five-word similarity about 0.8, against brute force; the same pairs by four words are mostly below 0.85."""
    random.seed(8)
    docs = []
    for pair in range(60):
        base = [f"p{pair}w{i}" for i in range(random.choice([60, 120, 240, 500]))]
        copy = list(base)
        if pair % 2:
            copy += [f"p{pair}x{i}" for i in range(int(len(base) * random.uniform(0.15, 0.3)))]
        else:
            changed = max(1, round(len(base) * random.uniform(0.015, 0.03)))
            for k in range(changed):
                copy[(2 * k + 1) * len(base) // (2 * changed)] = f"p{pair}y{k}"
        docs += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(copy))]
    # By hand: 240 words with five changed (211 of 261 shingles), and a fifth of the text appended (exactly 0.8 of the shingles).
    base = [f"h{i}" for i in range(240)]
    docs += [(1000, " ".join(base)), (1001, " ".join(f"z{i}" if i % 48 == 20 else w for i, w in enumerate(base)))]
    base = [f"g{i}" for i in range(244)]
    docs += [(1002, " ".join(base)), (1003, " ".join(base + [f"v{i}" for i in range(60)]))]
    text = dict(docs)
    pairs = [(a, a + 1) for a in text if a % 2 == 0]
    near = {p for p in pairs if five_word_similarity(text[p[0]], text[p[1]]) >= 0.8}
    strict = {p for p in pairs if four_word_similarity(text[p[0]], text[p[1]]) >= 0.85}
    assert {(1000, 1001), (1002, 1003)} <= near and not {(1000, 1001), (1002, 1003)} & strict
    assert strict < near and len(near - strict) > 10 and len(near) < len(pairs)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), SMALL)
    assert {r.doc_id for r in kept.collect()} == set(text) - {b for _, b in near}


def test_near_copies_of_given_documents_match_brute_force(spark):
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).select("doc_id").collect()}
    lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lowered))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    part = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = {k: low if v == high else v for k, v in part.items()}
    assert kept == {k for k, v in part.items() if k == v} and len(kept) < len(sets)
