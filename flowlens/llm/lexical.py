"""Ranked lexical search: documents for each item by a sum of integer term weights, pipelined over term owners.

Terms are owned by STAGES stages, the rarest by the first, so that each stage owns about as many postings as any other.
Items travel as bundles through the stages. A bundle holds some items' terms and, for one block of documents, their
sparse accumulators: for each item the documents that have scored and their sums. At every stage it meets the postings of
the stage's terms in its block by cogroup, adds their contributions, and goes on; after the last stage the best of every block
meet and the final ones are chosen.

After a stage a document leaves an item's accumulator if the block already holds ``k`` documents whose sums it can't
reach: the terms still to come can add at most their weights times the largest contribution each has in that block's
bound, a million. So rare terms come first, and documents that share only common words with an item are never carried.
No document that could be among the best is lost; the result is exact.

Documents are dealt into blocks by a number that is saved with them, so a block is bounded in rows whatever their
doc_ids are; bundles are bounded in items. Only terms of items are indexed. The items' terms are sent to all tasks in parts
of at most VOCABULARY bytes, each with a pass over the documents of its own if there are more.

Null and empty texts have no terms: such documents count neither in N nor for any item, such items have no results. Null item_ids
and doc_ids take part like others. Rows equal in item_id and text are one item; rows of one item_id with different texts are ranked
apart. Rows that repeat a doc_id are documents each. Empty tables give none. Further columns are ignored. Texts are
read whole; a score must fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.base import positions, saved, settled
from flowlens.llm.words import LOWER, MARK, SENTINEL, WordPattern, batches, numbers

WORD = WordPattern(rb"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F")
K = 50
STAGES = 4
#: Documents of a block and items of a bundle.
BLOCK = 4096
BUNDLE = 256
#: Bytes of the items' terms that are sent out at a time.
VOCABULARY = 64 << 20
#: The largest contribution of a term, before its weight: (1000000000 * tf) div (1000 * tf + 20 * m) stays below it.
MOST = 1_000_000


def terms_of(text: str | None) -> list[str]:
    """The distinct terms of one text."""
    found = [w for part in WORD.lists((text or "").encode("utf-8", "surrogatepass").translate(LOWER)) for w in part]
    return [w.decode("utf-8", "replace") for w in dict.fromkeys(found)]


def numbered_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item (from 0) and item_id of the distinct items, and item and term of each of their distinct terms; saved."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"item": f["item"], "term": f.text.map(terms_of)})

    distinct = positions(items.select("item_id", "text").distinct(), [F.col("item_id"), F.col("text")], "item")
    terms = distinct.select("item", "text").mapInPandas(run, "item long, term array<string>")
    return distinct.select("item", "item_id"), saved(terms.select("item", F.explode("term").alias("term")), "item-terms")


class Known(dict):
    """Numbers of the wanted terms, and 0 for others, none of which is remembered."""

    def __missing__(self, term: bytes) -> int:
        return 0


def postings(docs: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    """doc (a number of its own), doc_id, n (all terms with repeats) and, as arrays, the wanted terms' numbers (above 0)
    and occurrences tf, for every document; saved."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known((term.encode(), number) for term, number in shared.value)
        known[SENTINEL] = MARK
        top = max(known.values()) + 1
        for part in parts:
            texts = part.column("text").to_pylist()
            all_terms, each = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            found, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b in batches(texts):
                for _, owner, number in numbers(texts[a:b], WORD, known.__getitem__):
                    all_terms[a:b] = np.bincount(owner, minlength=b - a)
                    asked = number > 0
                    pairs, tf = np.unique(owner[asked] * top + number[asked], return_counts=True)
                    each[a:b] = np.bincount(pairs // top, minlength=b - a)
                    found.append(pairs % top)
                    times.append(tf)
            cuts = np.concatenate([[0], np.cumsum(each)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(all_terms), _lists(cuts, np.concatenate(found), pa.int32()),
                 _lists(cuts, np.concatenate(times), pa.int64())], ["doc_id", "n", "term", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n long, term array<int>, tf array<long>")
    return saved(found.withColumn("doc", F.monotonically_increasing_id()), "postings")


def _lists(cuts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _parts(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as cuts and values."""
    lists = table.column(name).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], table.schema.field(name).type)
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), np.asarray(lists.flatten())


def owned(found: DataFrame, stage_of: np.ndarray, stages: int, documents: int, terms: int, blocks: int) -> DataFrame:
    """block, doc, doc_id and for each stage i the arrays term{i} and given{i}, the contributions before weights; saved."""
    shared = found.sparkSession.sparkContext.broadcast(stage_of)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            table = pa.Table.from_batches([part])
            (cuts, term), (_, tf) = _parts(table, "term"), _parts(table, "tf")
            n = np.asarray(part.column("n"))
            m = 50 + (50 * n * documents) // terms
            owner = np.repeat(np.arange(part.num_rows), np.diff(cuts))
            given = (1_000_000_000 * tf) // (1000 * tf + 20 * m[owner])
            stage = shared.value[term]
            columns = []
            for i in range(stages):
                at = stage == i
                own = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=part.num_rows))])
                columns += [_lists(own, term[at], pa.int32()), _lists(own, given[at], pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column("block"), part.column("doc"), part.column("doc_id"), *columns],
                                             ["block", "doc", "doc_id", *_arrays(stages)])

    kind = found.schema["doc_id"].dataType.simpleString()
    rows = found.where(F.size("term") > 0).withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int"))
    return saved(rows.mapInArrow(run, f"block int, doc long, doc_id {kind}, "
                                 + ", ".join(f"{c} array<int>" for c in _arrays(stages))), "owned")


def _arrays(stages: int) -> list[str]:
    return [f"{c}{i}" for i in range(stages) for c in ("term", "given")]


BUNDLE_SCHEMA = ("bundle long, block int, item long, term array<int>, weight array<long>, stage array<int>, doc array<long>, "
                 "score array<long>")


class Stage:
    """Adds what one owner's terms give to the bundles that meet its postings in a block of documents."""

    def __init__(self, number: int, k: int, last: bool):
        self.number, self.k, self.last = number, k, last

    def accumulators(self, bundle: pa.Table, docs: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place in the bundle, documents in ascending order and their sums, of each item."""
        cuts, term = _parts(docs, "term")
        given = _parts(docs, "given")[1].astype(np.int64)
        key = np.asarray(docs.column("doc")).astype(np.int64)
        by_doc = np.argsort(key)
        place = np.empty(len(key), np.int64)
        place[by_doc] = np.arange(len(key))
        key = key[by_doc]
        order = np.argsort(term, kind="stable")
        at = np.repeat(place, np.diff(cuts))[order]
        term, given = term[order], given[order]
        (own, asked), (_, weight), (_, stage) = (_parts(bundle, c) for c in ("term", "weight", "stage"))
        (held, doc), (_, score) = _parts(bundle, "doc"), _parts(bundle, "score")
        for i in range(bundle.num_rows):
            mine, owner = asked[own[i]:own[i + 1]], stage[own[i]:own[i + 1]]
            each = weight[own[i]:own[i + 1]]
            here = owner == self.number
            low, high = (np.searchsorted(term, mine[here], side) for side in ("left", "right"))
            total = np.zeros(len(key), np.int64)
            for a, b, w in zip(low, high, each[here]):
                total[at[a:b]] += w * given[a:b]
            scored = np.flatnonzero(total)
            docs_, where = np.unique(np.concatenate([doc[held[i]:held[i + 1]], key[scored]]), return_inverse=True)
            sums = np.zeros(len(docs_), np.int64)
            np.add.at(sums, where, np.concatenate([score[held[i]:held[i + 1]], total[scored]]))
            if len(sums) > self.k:
                rest = int(each[owner > self.number].sum()) * MOST
                stay = sums + rest >= np.partition(sums, len(sums) - self.k)[len(sums) - self.k]
                docs_, sums = docs_[stay], sums[stay]
            yield i, docs_, sums

    def __call__(self, bundle: pa.Table, docs: pa.Table) -> pa.Table:
        kept = list(self.accumulators(bundle, docs))
        if not self.last:
            cuts = np.concatenate([[0], np.cumsum([len(d) for _, d, _ in kept], dtype=np.int64)])
            doc, score = (np.concatenate([np.empty(0, np.int64), *(x[j] for x in kept)]) for j in (1, 2))
            return (bundle.set_column(6, "doc", _lists(cuts, doc, pa.int64()))
                    .set_column(7, "score", _lists(cuts, score, pa.int64())))
        # The last owner's rows hold every document of the block, hence its doc_id.
        key, ids = np.asarray(docs.column("doc")).astype(np.int64), docs.column("doc_id")
        by_id, by_key = np.empty(len(key), np.int64), np.argsort(key)
        by_id[np.asarray(pc.sort_indices(ids, null_placement="at_end"))] = np.arange(len(key))
        items, rows, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, doc, score in kept:
            row = by_key[np.searchsorted(key[by_key], doc)]
            best = np.lexsort((by_id[row], -score))[:self.k]
            rows.append(row[best])
            scores.append(score[best])
            items.append(np.full(len(best), bundle.column("item")[i].as_py()))
        return pa.table({"item": np.concatenate(items), "doc_id": ids.take(pa.array(np.concatenate(rows))),
                         "score": np.concatenate(scores)})


def _step(stage: Stage) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A plain function of two tables, as Spark tells functions apart by the number of their arguments."""
    def run(bundle: pa.Table, docs: pa.Table) -> pa.Table:
        return stage(bundle, docs)
    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, stages: int = STAGES, block: int = BLOCK,
           bundle: int = BUNDLE, vocabulary: int = VOCABULARY) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 of every item."""

    def ranked() -> DataFrame:
        named, terms = numbered_items(items)
        groups, asked = 1, named.count()
        # Until the terms of each group of items are few enough to be sent out, or a group is one item.
        while groups < asked and _bytes(terms, groups) > vocabulary:
            groups *= 2
        found = None
        for group in range(groups):
            part = terms.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group)
            best = _group(docs, part, k, stages, block, bundle)
            found = best if found is None else found.unionByName(best)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .join(named, "item").select("item_id", "rank", "doc_id", "score"))

    return settled(ranked, "ranked")


def _bytes(terms: DataFrame, groups: int) -> int:
    """Of the distinct terms of the largest group of items."""
    each = terms.select(F.pmod(F.xxhash64("item"), F.lit(groups)).alias("group"), "term").distinct()
    return each.groupBy("group").agg(F.sum(F.octet_length("term")).alias("bytes")).agg(F.max("bytes")).first()[0] or 0


def _group(docs: DataFrame, terms: DataFrame, k: int, stages: int, block: int, bundle: int) -> DataFrame:
    """item, doc_id, score: the best of every block for the items whose terms (item, term) are given."""
    spark = docs.sparkSession
    vocabulary = positions(terms.select("term").distinct(), [F.col("term")], "number").withColumn("number", F.col("number") + 1)
    wanted = [(r.term, r.number) for r in vocabulary.collect()]
    found = postings(docs, wanted)
    documents, length, rows = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0)),
                                        F.count(F.when(F.size("term") > 0, 1))).first()
    df = np.zeros(len(wanted) + 1, np.int64)
    for r in found.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        df[r.term] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2.0 * documents + 2) / (2.0 * n + 1))) for n in df.tolist()], np.int64)
    # Rare terms first; every stage owns about as many postings as any other.
    order = np.argsort(df, kind="stable")
    passed = np.cumsum(df[order])
    stage_of = np.empty(len(df), np.int32)
    stage_of[order] = np.minimum((passed - df[order]) * stages // max(int(passed[-1]), 1), stages - 1)
    blocks = max(1, -(-rows // block))
    right = owned(found, stage_of, stages, documents, max(length, 1), blocks)

    facts = spark.sparkContext.broadcast((weight, stage_of))

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            term = [np.sort(np.asarray(t)) for t in f.term]
            yield pd.DataFrame({"item": f["item"], "term": term, "weight": [facts.value[0][t] for t in term],
                                "stage": [facts.value[1][t] for t in term]})

    asked = (terms.join(vocabulary, "term").groupBy("item").agg(F.collect_list("number").alias("term"))
             .mapInPandas(weigh, "item long, term array<int>, weight array<long>, stage array<int>"))
    numbered = saved(asked.withColumn("bundle", F.call_function("div", F.col("item"), F.lit(bundle))), "bundles")
    none = F.array().cast("array<long>")
    left = numbered.select("bundle", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "item", "term",
                           "weight", "stage", none.alias("doc"), none.alias("score"))
    bundles = F.sequence(F.lit(0), F.lit((numbered.agg(F.max("bundle")).first()[0] or 0))).cast("array<long>")
    for i in range(stages):
        last = i == stages - 1
        own = right if last else right.where(F.size(f"term{i}") > 0)
        # Every bundle meets every block: the stated items against all rows, a block at a time.
        own = own.select(F.explode(bundles).alias("bundle"), "block", "doc", "doc_id", F.col(f"term{i}").alias("term"),
                         F.col(f"given{i}").alias("given"))
        kind = right.schema["doc_id"].dataType.simpleString()
        left = (left.groupBy("bundle", "block").cogroup(own.groupBy("bundle", "block"))
                .applyInArrow(_step(Stage(i, k, last)), f"item long, doc_id {kind}, score long" if last else BUNDLE_SCHEMA))
    return left
