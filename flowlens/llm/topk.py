"""Exact top-k search by inner product: branch and bound over columns, a block of dimensions at a time.

Vectors are turned into whole numbers floor(64 * x). A group of candidates lies in memory dimension by dimension.
Scores grow by a block of dimensions; what the rest can still add is bounded by the norms of the remaining parts
(Cauchy-Schwarz), and candidates whose best possible score is below the k-th surely reached one are dropped and the
columns compacted. Ties are kept until the end, so the result is exact.

Queries and candidates meet as blocks: candidates are dealt into groups of about GROUP rows by a hash, queries into
blocks of about QUERIES, and each pair of blocks is one group of rows in a task. A block is bounded by construction,
whatever the number of vectors; each returns its k best, and the k best of those are the result.

Vectors that are null or hold null, NaN or infinite components take no part, nor do null vec_ids. Every other vector
does: where products pass what doubles and longs hold, they are worked out in whole numbers of any size, and a score
beyond a long's ends is that end (and ties there go to the smaller vec_id). Empty vectors score 0 with each other.
Vectors of another length than the query are no candidates for it. Rows that repeat a vec_id are candidates each; a
repeated query gives its result once for each distinct vector, ranked apart (rows equal in all are one query).
Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = 8192
QUERIES = 1024
SCALE = 64
BLOCK = 16
K = 20
EXACT = 2**53
#: Largest components whose products of up to a million dimensions stay within a long.
PLAIN = 2.0**15


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the vector as doubles that are yet to be turned into whole numbers, of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False))
                         ).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def whole(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of components below PLAIN in absolute value, as long."""
    return np.floor(SCALE * v).astype(np.int64)


def large_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of every query with every row in whole numbers of any size, held to the ends of a long."""
    a, b = (np.array([[_large(x) for x in v] for v in m], object).reshape(m.shape) for m in (queries, rows))
    score = a @ b.T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(score, -2**63, 2**63 - 1).astype(np.int64)


def _large(x: float) -> int:
    return math.floor(SCALE * x) if abs(x) < 2.0**1000 else SCALE * int(x)


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int,
                 block: int = BLOCK) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and ids and scores of the k best of ``rows`` other than itself."""
    peak = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    kind = np.float64 if peak < EXACT else np.int64
    # Larger candidates first: they raise the bound soonest.
    order = np.argsort(-np.square(rows.astype(np.float64)).sum(1), kind="stable")
    columns, row_ids = np.ascontiguousarray(rows[order].T.astype(kind)), row_ids[order]
    queries = queries.astype(kind)
    size = queries.shape[1]
    if not size:
        rows = row_ids[np.argsort(row_ids, kind="stable")]
        return [(q, own := rows[rows != query_ids[q]][:k], np.zeros(len(own))) for q in range(len(queries))]
    cuts = list(range(0, size, block)) + [size]

    def rests(x: np.ndarray) -> np.ndarray:
        """Norm of what lies from each cut on, a little enlarged against rounding; x is dimensions by rows."""
        parts = np.array([np.square(x[a:b].astype(np.float64)).sum(0) for a, b in zip(cuts, cuts[1:])])
        return np.sqrt(np.concatenate([np.cumsum(parts[::-1], 0)[::-1], np.zeros((1, x.shape[1]))])) * (1 + 1e-9)

    row_rest, query_rest = rests(columns), rests(queries.T)
    first = queries[:, :cuts[1]] @ columns[:cuts[1]]
    out = []
    for q in range(len(queries)):
        alive, score = None, first[q]
        own = row_ids == query_ids[q]
        if own.any():
            alive = np.flatnonzero(~own)
            score = score[alive]
        for i in range(1, len(cuts) - 1):
            if i > 1:
                part = columns[cuts[i - 1]:cuts[i]]
                score = score + queries[q, cuts[i - 1]:cuts[i]] @ (part if alive is None else part[:, alive])
            if len(score) > k:
                slack = (row_rest[i] if alive is None else row_rest[i][alive]) * query_rest[i, q] + 1e-6
                least = np.partition(score - slack, len(score) - k)[len(score) - k]
                stay = np.flatnonzero(score + slack >= least)
                alive, score = stay if alive is None else alive[stay], score[stay]
        if len(cuts) > 2:
            part = columns[cuts[-2]:]
            score = score + queries[q, cuts[-2]:] @ (part if alive is None else part[:, alive])
        ids = row_ids if alive is None else row_ids[alive]
        best = np.lexsort((ids, -score))[:k]
        out.append((q, ids[best], score[best]))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, group: int = GROUP, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best vectors for each row of ``queries`` (both as whole_vectors())."""
    counts = vectors.agg(F.count(F.lit(1))).first()[0], queries.agg(F.count(F.lit(1))).first()[0]
    groups, blocks = (max(1, -(-n // size)) for n, size in zip(counts, (group, query_block)))

    def deal(key: str, n: int, salt: int):
        return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n)).cast("int")

    rows = vectors.select(deal("vec_id", groups, 1).alias("g"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "vec_id", "v", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("variant"))
    asks = queries.distinct().select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
                                     deal("vec_id", blocks, 2).alias("b"), "vec_id", "v", F.lit(True).alias("asks"),
                                     F.xxhash64("v").alias("variant"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = [np.empty((0, 4), np.int64)]
        sizes = frame.v.map(len)
        for size in sizes[frame.asks].unique():
            part = frame[sizes == size]
            q, r = part[part.asks], part[~part.asks]
            if not len(r):
                continue
            asked, held = (np.stack(list(x.v)).reshape(len(x), size) for x in (q, r))
            q_ids, r_ids = q.vec_id.to_numpy(), r.vec_id.to_numpy()
            plain_q, plain_r = (np.abs(x).max(1, initial=0) < PLAIN for x in (asked, held))
            best = []
            at = np.flatnonzero(plain_q)
            if len(at) and plain_r.any():
                best = [(at[i], ids, scores) for i, ids, scores in search_block(
                    whole(asked[at]), q_ids[at], whole(held[plain_r]), r_ids[plain_r], k)]
            # Very large components: few, and compared without bounds.
            for own, others in ((plain_q, ~plain_r), (~plain_q, np.ones(len(r), bool))):
                for low in range(0, int(own.sum()) if others.any() else 0, 64):
                    at = np.flatnonzero(own)[low:low + 64]
                    for i, scores in zip(at, large_scores(asked[at], held[others])):
                        other = r_ids[others] != q_ids[i]
                        best.append((i, r_ids[others][other], scores[other]))
            for i, ids, scores in best:
                found.append(np.stack([np.full(len(ids), q_ids[i]), np.full(len(ids), q.variant.iat[i]), ids,
                                       scores.astype(np.int64)], 1))
        return pd.DataFrame(np.concatenate(found), columns=["query_id", "variant", "vec_id", "score"])

    found = rows.unionByName(asks).groupBy("g", "b").applyInPandas(
        run, "query_id long, variant long, vec_id long, score long")
    best = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
