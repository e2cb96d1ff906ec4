"""The operators as queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import (bpe, jaccard, language, lexical, mixing, quality, resample, rules, sharding, substrings, topk,
                          toxicity, warc)
from flowlens.llm.base import table

VOCABULARY = "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removals(table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.sample_order(docs)).drop("rejected_by")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (sharding.text_bytes() + 8).alias("size"), sharding.text_crc32().alias("text_crc32"))
    return sharding.interleaved(rows, content=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_toxicity, op2_language, op3_quality, op4_jaccard_join, op5_top_k, op6_mixing, op7_warc, op8_bpe,
    op9_substrings, op10_rules, op11_sharding, op12_resampling, op13_search)}

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

#: The words of a column, A-Z alone lower-cased; crc32's table of a byte's eight steps, and crc32 of a blob by it.
WORDS12 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS13 = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = ("regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')")
CRC_TABLE = ("list_transform(range(256), lambda i: list_reduce(range(8), "
             "lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), i))")
CRC32 = ("xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex({}), '..'), lambda x: CAST('0x' || x AS BIGINT)), "
         "lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)]), 4294967295))")

ORACLES: dict[str, str] = {
    "op4_jaccard_join": rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS t FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id
      GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id""",
    "op5_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""",
    "op6_mixing": rf"""
WITH d AS (
    SELECT doc_id, source, CAST(len({WORDS.format("text")}) AS BIGINT) AS size,
           (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum(source_size) OVER o, 0) AS full_size, coalesce(sum(weight) OVER o, 0) AS full_weights
      FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (total - 3 * full_size) / (weights - full_weights) AS guess FROM l),
h AS (SELECT *, max(CASE WHEN guess * weight <= 3 * source_size THEN guess END) OVER () AS level FROM g),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * level) AS target FROM h),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
x AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, floor(rate) AS whole,
             (rate - floor(rate)) * r.source_size AS wanted,
             sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id) AS upto
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
y AS (SELECT *, size > 0 AND 2 * (wanted - (upto - size)) >= size AS drawn FROM x),
z AS (SELECT *, wanted - sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM y),
k AS (SELECT source AS of, doc_id AS swap FROM z WHERE size > 0 AND drawn = (gap < 0) AND abs(size - abs(gap)) < abs(gap)
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - abs(gap)), doc_id) = 1)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN drawn <> coalesce(doc_id = swap, false) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM z LEFT JOIN k ON z.source IS NOT DISTINCT FROM k.of""",
    "op7_warc": """
WITH p AS (
    SELECT page_id, sha256(coalesce(html, '')) AS digest,
           CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE bytes >= 100 GROUP BY digest)
SELECT page_id, bytes AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)""",
    "op9_substrings": rf"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM s JOIN f USING (h) WHERE doc_id > first),
k AS (SELECT p.doc_id, string_agg(p.x, ' ' ORDER BY p.i) AS kept FROM
        (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) p ANTI JOIN g USING (doc_id, i)
      GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) c USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op10_rules": rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("text")} AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
m AS (SELECT doc_id, count(DISTINCT j) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (
            SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
b AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             coalesce(m.n, 0) AS n_repeat_words FROM d LEFT JOIN m USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words
       AND 10 * n_dup_lines <= 3 * len(string_split(t, chr(10)))
       AND 10 * len(regexp_extract_all(t || ' ', '!!([\x20\x09-\x0D])')) <= n_words
       AND length(regexp_replace(t, '[^A-Z]', '', 'g')) <= length(regexp_replace(t, '[^a-z]', '', 'g')) AS kept
FROM f""",
    # crc32 by a table of 256 steps, worked out here, over the bytes of the text.
    "op11_sharding": rf"""
WITH t AS (SELECT {CRC_TABLE} AS crc_table),
d AS (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) + 8 AS size,
             {CRC32.format("encode(coalesce(text, ''))")} AS text_crc32 FROM documents, t),
h AS (SELECT *, md5(concat_ws(':', '11', CAST(doc_id AS VARCHAR), text_crc32, size)) AS h,
             (CAST('0x' || substr(md5(concat_ws(':', '11', source)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS place,
             count(*) OVER (PARTITION BY source) AS n FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY (place + u) / n, source NULLS FIRST, place) - 1 AS pos, count(*) OVER () AS total FROM r),
s AS (SELECT *, pos * 24 // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, pos - (shard * total + 23) // 24 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op12_resampling": rf"""
WITH t AS (SELECT {CRC_TABLE} AS crc_table),
d AS (SELECT doc_id, {TERMS.format("text", WORDS12)} AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS word FROM d),
g AS (SELECT unnest({TERMS.format("text", WORDS12)}) AS word FROM benchmark),
b AS (SELECT word, {CRC32.format("encode(word)")} % 10000 AS bucket FROM (SELECT word FROM f UNION SELECT word FROM g), t),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (word) GROUP BY bucket),
q AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (word) GROUP BY bucket),
a AS (SELECT CAST((SELECT count(*) FROM f) AS DOUBLE) AS s_all, CAST((SELECT count(*) FROM g) AS DOUBLE) AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000)
                / ((coalesce(s, 0) + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain
         FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN q USING (bucket), a),
x AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN b USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
y AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN x USING (doc_id)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
             count(*) OVER (PARTITION BY n_features >= 20) AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM r""",
    "op13_search": rf"""
WITH d AS (SELECT doc_id, {TERMS.format("text", WORDS13)} AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest({TERMS.format("text", WORDS13)}) AS term FROM benchmark),
a AS (SELECT count(*) AS documents, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, len(w) AS n, term, count(*) AS tf
      FROM (SELECT doc_id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM p, a GROUP BY term, documents),
c AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + 50 * n * documents // terms)))) AS BIGINT) AS score
      FROM i JOIN p USING (term) JOIN f USING (term), a GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50""",
}
