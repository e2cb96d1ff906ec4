"""Shards that all hold the mixture of sources: proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked there. The fractional rank, (rank + u) / n with a
number u in (0, 1) drawn for the source, spreads every source evenly over 0 to 1 (u keeps small sources from meeting in
the middle). All rows are sorted by it and cut into shards of equal row counts, at most one apart, so every shard holds
each source in its share, to within about two rows, and a reader meets the mixture all along a shard.

Both orders are global sorts whose rows are numbered by counts of Spark's range partitions (base.positions): no source,
however hot, and no group of equal rows falls into one task. What is sorted is saved first, with a number for each row that breaks
ties, so a lost executor changes nothing.

Null sources are a source of their own. Null doc_ids and texts take part like others, a null text as an empty one. Rows
equal in source, doc_id and text are rows each; which of them comes first can't be told. Empty tables give none. Further columns are
kept; the names of the new columns are parameters, and none that ``docs`` has is used for others. Texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.relational import join_groups
from flowlens.llm.base import fresh, positions, settled

SHARDS = 24
SEED = 11


def _drawn(hashed: Column) -> Column:
    """A number in (0, 1) from the first 32 bits of a hex hash."""
    return (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)


def text_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: str = "text") -> Column:
    """Unsigned; of no bytes for null."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def interleaved(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source",
                key: str = "doc_id", content: tuple[str, ...] = (), shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with the columns ``shard`` (from 0) and ``slot`` (from 0, gapless in each shard).

    ``content`` names columns that tell rows of one ``key`` apart, such as a text's hash; they enter the shuffle.
    """
    if shards < 1:
        raise ValueError(f"shards must be at least 1, not {shards}")
    hashed, place, start, n, share, of, at = fresh(rows.columns, "hashed", "place", "start", "n", "share", "of", "at")
    own = F.col(f"`{source}`")
    names = [F.col(f"`{c}`") for c in (key, *content)]
    seeded = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in names]))

    def numbered() -> DataFrame:
        by_source = positions(rows.withColumn(hashed, seeded), [
            own.asc_nulls_first(), F.col(hashed), *[c.asc_nulls_first() for c in names]], place).withColumn(of, own)
        sources = by_source.groupBy(of).agg(F.min(place).alias(start), F.count(F.lit(1)).alias(n))
        u = _drawn(F.md5(F.concat_ws(":", F.lit(str(seed)), own.cast("string"))))
        rank = F.col(place) - F.col(start)
        ranked = join_groups(by_source, sources, [of], "inner").withColumn(share, (rank + u) / F.col(n))
        spread = positions(ranked.drop(start, n, hashed, of), [F.col(share), F.col(place)], at)
        total, parts = by_source.count(), F.lit(shards).cast("long")
        number = F.call_function("div", F.col(at) * parts, F.lit(max(total, 1)))
        first = F.call_function("div", number * F.lit(total) + (shards - 1), parts)
        return spread.withColumns({shard: number.cast("int"), slot: F.col(at) - first}).drop(place, share, at)

    return settled(numbered, "shards")


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Whole documents with their shard and slot."""
    bytes_, crc = fresh(docs.columns, "bytes", "crc")
    rows = docs.withColumns({bytes_: text_bytes(), crc: text_crc32()})
    return interleaved(rows, shards, seed, content=(crc, bytes_), shard=shard, slot=slot).drop(bytes_, crc)


def write_shards(rows: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder ``shard=…`` each, with files that follow each other by slot; a shard may be many files."""
    (rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
     .write.option("compression", "zstd").partitionBy(shard).parquet(path))
