"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document of a source whose target is r times its size is wanted r times: floor(r)
whole copies are certain, and the remaining inclusion probability p = r - floor(r) is drawn. For that each document
gets a random number u, fixed by its key, and the rank value (u / (1 - u)) / (p / (1 - p)); documents are taken in that
order until the source's words come nearest to p times its size; one last document is then drawn or undrawn if its
size closes what a long document at the cut left open. Only built-in functions, no Python on the data.

Sizes count words; null text has size 0. A null source is a source of its own, last in order. Rows that repeat a doc_id
have the same u and stay neighbours in the order, told apart by their text and then taken as they come (equal rows are
interchangeable). Null doc_ids share one u. An empty table gives an empty result; further columns are kept by
``mixed`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.relational import fitted
from flowlens.llm.base import WORD, fresh, saved, settled

MOST = 3
BUCKETS = 4096
UNIT_BITS = 52


def source_targets(sized: DataFrame) -> DataFrame:
    """From source and size: source, source_size, target. One row per source is all that is ordered in one place.

    The water level: a source below its limit MOST * size has weight * level. Ordered by limit / weight, the sources
    before the level are at their limits; the level is what is left of all words by what is left of the weights.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.withColumn("weight", (F.row_number().over(named) - 1) % 3 + 1)
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = weighed.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("full_weights"))
    # The level if all sources before this one are full and this one is not. The first that fits is right; later ones
    # fill sources that aren't full, so theirs are lower.
    guess = (F.col("total") - MOST * F.col("full")) / (F.col("weights") - F.col("full_weights"))
    fits = guess * F.col("weight") <= MOST * F.col("source_size")
    level = level.withColumn("level", F.max(F.when(fits, guess)).over(everything))
    return level.select("source", "source_size", F.least(
        (MOST * F.col("source_size")).cast("double"),
        F.coalesce(F.col("weight") * F.col("level"), F.lit(float("inf")))).alias("target"))


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), source, size, source_size, target, copies of every row."""
    return settled(lambda: _plan(docs), "mix-plan")


def _unit() -> Column:
    """The document's random number u, in (0, 1)."""
    return (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10)
            .cast("long") + 0.5) / float(2**UNIT_BITS)


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _rank() -> Column:
    """Random odds by inclusion odds; null where nothing is drawn."""
    return F.try_divide(F.col("u") / (1 - F.col("u")), F.col("p") / (1 - F.col("p")))


def _plan(docs: DataFrame) -> DataFrame:
    sized = saved(docs.select("doc_id", F.xxhash64("text").alias("tie"), "source", _size().alias("size"), _unit().alias("u")), "mix-sized")
    targets = source_targets(sized.select("source", "size"))
    rate = F.when(F.col("source_size") > 0, F.try_divide("target", "source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("rate", rate).select(
        "source", "source_size", "target", F.floor("rate").alias("certain"), (F.col("rate") - F.floor("rate")).alias("p"))
    targets = targets.withColumn("wanted", F.col("p") * F.col("source_size"))
    # The rank value has the order of u within a source, so buckets even in u are ranges of it.
    bucket = F.floor(F.col("u") * BUCKETS)
    buckets = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("source").alias("of"), "bucket", "words",
                             F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    cut = (targets.join(buckets, F.col("source").eqNullSafe(F.col("of")), "left")
           .groupBy("source", "source_size", "target", "certain", "p", "wanted")
           .agg(F.min(F.when((F.col("start") <= F.col("wanted")) & (F.col("wanted") < F.col("start") + F.col("words")),
                             F.struct("bucket", "start"))).alias("cut")))
    # One row per source, broadcast only where counted and small.
    per_source = fitted(cut.select(F.col("source").alias("of"), "source_size", "target", "certain", "p", "wanted",
                                   F.col("cut.bucket").alias("cut"), F.col("cut.start").alias("start")))
    rows = sized.join(per_source, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("rank", _rank())
    # Only the cut's bucket needs its documents in order; all others are wholly before or after it.
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.where(bucket == F.col("cut")).withColumn("upto", F.sum("size").over(order) + F.col("start"))
    nearest = (F.col("wanted") - (F.col("upto") - F.col("size"))) * 2 >= F.col("size")
    inside = inside.withColumn("drawn", nearest & (F.col("size") > 0))
    outside = rows.where(~F.coalesce(bucket == F.col("cut"), F.lit(False))).withColumn(
        "drawn", F.coalesce(bucket < F.col("cut"), F.lit(False)) & (F.col("size") > 0))
    done = ["doc_id", "tie", "source", "size", "source_size", "target", "certain", "p", "wanted", "rank", "drawn"]
    drawn = saved(inside.select(*done).unionByName(outside.select(*done)), "mix-drawn")
    # A very long document at the cut leaves a gap: the one document whose size fits it best is drawn or undrawn.
    gap = fitted(drawn.groupBy("source", "wanted").agg(
        (F.col("wanted") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("gap"))
        .select(F.col("source").alias("of"), "gap"))
    misfit = F.abs(F.col("size") - F.abs("gap"))
    swap = fitted(drawn.join(gap, F.col("source").eqNullSafe(F.col("of")), "left")
                  .where((F.col("size") > 0) & (F.col("drawn") == (F.col("gap") < 0)) & (misfit < F.abs("gap")))
                  .groupBy("source").agg(F.min(F.struct(misfit.alias("misfit"), "doc_id", "tie")).alias("x"))
                  .select(F.col("source").alias("of"), F.col("x.doc_id").alias("swap"), F.col("x.tie").alias("swap_tie")))
    drawn = drawn.join(swap, F.col("source").eqNullSafe(F.col("of")), "left")
    swapped = F.coalesce(F.col("doc_id").eqNullSafe(F.col("swap")) & (F.col("tie") == F.col("swap_tie")), F.lit(False))
    return drawn.select("doc_id", "tie", "source", "size", "source_size", "target", "certain", "p", "rank", "drawn",
                        swapped.alias("swapped"), (F.col("certain") + (F.col("drawn") != swapped).cast("long")).alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    A source's drawn rows are those up to the last one in its order, but for the one that closes the gap. So one row for each
    source says what is taken, and no text is shuffled. Rows equal in doc_id and text are taken alike.
    """
    last = F.max(F.when(F.col("drawn"), F.struct("rank", "doc_id", "tie")))
    swap = F.max(F.when(F.col("swapped"), F.struct("doc_id", "tie")))
    per_source = plan(docs).groupBy("source").agg(
        F.first("certain").alias("certain"), F.first("p").alias("p"), last.alias("last"), swap.alias("swap"))
    names = fresh(docs.columns, "of", "rule", "here")
    of, rule, here = names
    table = fitted(per_source.select(F.col("source").alias(of), F.struct("certain", "p", "last", "swap").alias(rule)))
    rows = docs.join(table, F.col("source").eqNullSafe(F.col(of)), "left")
    own = {"u": _unit(), "p": F.col(f"{rule}.p"), "size": _size(), "tie": F.xxhash64("text")}
    rows = rows.withColumn(here, F.struct("doc_id", *[c.alias(n) for n, c in own.items()]))
    p, u = F.col(f"{here}.p"), F.col(f"{here}.u")
    place = F.struct(F.try_divide(u / (1 - u), p / (1 - p)).alias("rank"), F.col(f"{here}.doc_id").alias("doc_id"), F.col(f"{here}.tie").alias("tie"))
    drawn = F.coalesce(place <= F.col(f"{rule}.last"), F.lit(False))
    swapped = F.coalesce(F.struct(F.col(f"{here}.doc_id").alias("doc_id"), F.col(f"{here}.tie").alias("tie")) == F.col(f"{rule}.swap"), F.lit(False))
    copies = F.col(f"{rule}.certain") + (drawn != swapped).cast("long")
    return (rows.where((F.col(f"{here}.size") > 0) & (copies > 0))
            .withColumn(here, F.explode(F.sequence(F.lit(1), copies.cast("int"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
