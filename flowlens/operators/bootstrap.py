"""Bootstrap confidence intervals with Poisson weights.

A resample gives each row an independent Poisson(1) weight (Chamandy et al., 2012). Rows that are equal in
everything a metric looks at form a cell, and a cell of c rows has weight Poisson(c): so the work is
per cell and repetition, not per row and repetition. Every weight is a function of the seed, the cell and
the repetition, whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions.hashing import PRIME, coefficients, draws, row_hash
from flowlens.operators import metrics as M
from flowlens.operators.ordered import bucketed, splitters
from flowlens.session import saved

# Weights held in a task at a time, in a processor's cache.
BLOCK = 65_536
# Cells of a score range, which is one row.
CELLS_PER_BUCKET = 8_192
# Leading bits of a draw that a guide to its count is kept by, and what the guide has where they leave more than two counts.
GUIDE = 12
MANY = 1 << 15
# Half the width, in root means, of the range outside which a Poisson count does not fall in double precision.
SPREAD = 12


def poisson_steps(mean: int) -> tuple[int, np.ndarray]:
    """The first count with any chance and the Poisson distribution function from there on.

    One rule for every mean: chances relative to that of the mean itself come from the ratios of neighbours
    (mean / k upwards, k / mean downwards), and are divided by their sum.
    """
    reach = SPREAD * math.sqrt(mean) + SPREAD
    first, last = max(0, math.floor(mean - reach)), math.ceil(mean + reach)
    up = np.cumprod(mean / np.arange(mean + 1, last + 1, dtype=float))
    down = np.cumprod(np.arange(mean, first, -1, dtype=float) / mean)[::-1]
    chances = np.concatenate([down, [1.0], up])
    steps = np.cumsum(chances)
    return first, steps / steps[-1]


@lru_cache(maxsize=4096)
def poisson_limits(mean: int) -> tuple[int, np.ndarray]:
    """The first count, and the draws (whole numbers below the prime) from which on each next count is reached."""
    first, steps = poisson_steps(mean)
    limits = np.clip(np.floor(steps * PRIME - 0.5).astype(np.int64) - 2, 0, PRIME)
    while True:  # up to the first draw whose middle lies beyond the step
        low = (limits < PRIME) & ((limits + 0.5) / PRIME <= steps)
        if not low.any():
            return first, limits[limits < PRIME].astype(np.uint32)
        limits[low] += 1


def poisson_weights(coefs: np.ndarray, counts: np.ndarray, reps: int) -> np.ndarray:
    """Weights of cells (rows) in repetitions 1…reps (columns)."""
    drawn = draws(coefs, 2 * np.arange(1, reps + 1))
    weights = np.empty(drawn.shape, np.float64)
    for size in np.unique(counts):
        mine = np.flatnonzero(counts == size)
        own = drawn if len(mine) == len(counts) else drawn[mine]
        start, limits = poisson_limits(int(size))
        if len(limits) < 24:
            reached = np.zeros(own.shape, np.uint8)
            for limit in limits:
                reached += own >= limit
        else:
            reached = np.searchsorted(limits, own, side="right")
        weights[mine] = reached + float(start)
    return weights


def even_draws(coefs: np.ndarray, reps: int, step: int) -> Iterator[np.ndarray]:
    """``draws`` at 2, 4, … 2 * reps: repetitions in rows, ``step`` of them at a time, cells in columns. At even points a cubic needs only
    additions: each value is the one before plus a difference, which has differences of its own. The array is used again for the next."""
    state, prime = draws(coefs, np.array([2, 4, 6, 8])).T.astype(np.int64), np.uint32(PRIME)
    for k in (1, 2, 3):
        state[k:] = np.diff(state[k - 1:], axis=0) % PRIME
    value, *slopes = state.astype(np.uint32)
    less, rows = np.empty_like(value), np.empty((min(step, reps), len(coefs)), np.uint32)
    for low in range(0, reps, step):
        out = rows[:reps - low]
        for row in out:
            row[:] = value
            for a, b in zip((value, *slopes), slopes):
                a += b
                np.subtract(a, prime, out=less)  # beyond all numbers where a is below the prime
                np.minimum(a, less, out=a)
        yield out


@lru_cache(maxsize=4096)
def poisson_guide(mean: int) -> tuple[np.ndarray, np.ndarray] | None:
    """By the leading GUIDE bits of a draw: the count that the least such draw has, MANY if more than one count follows in them, and from
    which draw on it is one more. None where there are more counts than a guide is good for."""
    first, limits = poisson_limits(mean)
    if len(limits) > 1 << (GUIDE - 3):
        return None
    starts = np.arange((1 << GUIDE) + 1, dtype=np.int64) << (31 - GUIDE)
    below = np.searchsorted(limits, starts, side="right")
    after = np.append(limits, np.uint32(PRIME))[below[:-1]]
    inside = np.searchsorted(limits, starts[1:] - 1, side="right") - below[:-1]
    return np.where(inside > 1, MANY, below[:-1]).astype(np.uint16), after


def weight_rows(coefs: np.ndarray, counts: np.ndarray, reps: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The repetitions (a slice of 0 to ``reps``) and their weights, as whole numbers: those of ``poisson_weights``, repetitions in rows."""
    order = np.argsort(counts, kind="stable")
    back = np.argsort(order, kind="stable")
    sizes, low = np.unique(counts[order], return_index=True)
    ends, at = np.append(low[1:], len(counts)), 0
    moved = len(sizes) > 1
    for drawn in even_draws(coefs[order], reps, max(1, BLOCK // max(1, len(counts)))):
        weights = np.empty(drawn.shape, np.int64 if sizes[-1] > 1 << 20 else np.int32)
        for size, a, b in zip(sizes.tolist(), low, ends):
            own, (start, limits), guide = drawn[:, a:b], poisson_limits(size), poisson_guide(size)
            if guide is None:
                weights[:, a:b] = np.searchsorted(limits, own, side="right")
            else:
                leading = (own >> np.uint32(31 - GUIDE)).astype(np.intp)
                reached = guide[0].take(leading)
                reached += own >= guide[1].take(leading)
                many = np.flatnonzero(reached >= MANY)
                reached.flat[many] = np.searchsorted(limits, own.flat[many], side="right")
                weights[:, a:b] = reached
            if start:
                weights[:, a:b] += start
        yield slice(at, at + len(drawn)), weights.take(back, axis=1) if moved else weights
        at += len(drawn)


def score_text(score: Column) -> Column:
    """Text that tells any two scores apart, for hashing: whole and 2^-40 parts of 1e-9 units, which every engine works out
    alike, and beyond what they can hold (tiny, huge and infinite scores) a hash of the double's bits."""
    units = score * 1e9
    parts = F.concat_ws(".", F.floor(units), F.floor((units - F.floor(units)) * 2.0**40))
    return F.when((F.abs(score) >= 2.0**-20) & (F.abs(score) < 2.0**30), parts).otherwise(
        F.concat(F.lit("x"), F.xxhash64(score)))


def _with_coefficients(cells: DataFrame, parts: Sequence[str], seed: int) -> DataFrame:
    """Adds ``a0…a3``."""
    def text(name: str):
        if cells.schema[name].dataType.typeName() in ("double", "float"):
            return score_text(F.col(name).cast("double"))
        return F.coalesce(F.col(name).cast("string"), F.lit("~"))
    hashed = cells.withColumn("__h", row_hash(seed, *[text(p) for p in parts]))
    return hashed.withColumns({f"a{i}": c for i, c in enumerate(coefficients(F.col("__h")))}).drop("__h")


def _coefs(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[["a0", "a1", "a2", "a3"]].to_numpy(np.int64)


def cell_totals(cells: DataFrame, keys: Sequence[str], count: str, reps: int) -> DataFrame:
    """Resampled size per ``keys`` and repetition, summed within each batch before the shuffle."""
    keys = list(keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keys).schema.fields)
    lead = f"{fields}, " if keys else ""
    step = max(1, BLOCK // reps)

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), step):
                block = pdf.iloc[start:start + step]
                weights = poisson_weights(_coefs(block), block[count].to_numpy(), reps)
                groups = block.groupby(keys, dropna=False, sort=False).indices if keys else {(): np.arange(len(block))}
                for rows in groups.values():
                    out = pd.DataFrame({"rep": np.arange(1, reps + 1), "w": weights[rows].sum(axis=0)})
                    for k in reversed(keys):
                        out.insert(0, k, block[k].iloc[rows[0]])
                    yield out

    return (cells.select(*keys, count, "a0", "a1", "a2", "a3")
            .mapInPandas(resample, f"{lead}rep int, w double")
            .groupBy(*keys, "rep").agg(F.sum("w").alias("w")))


def decision_bootstrap(df: DataFrame, groups: Sequence[str] = (), reps: int = 2000, seed: int = 7,
                       label: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Precision, recall, F1, TPR and FPR per repetition. Only four cells per group are resampled."""
    cells = df.groupBy(*groups, F.col(label).cast("int").alias("t"), F.col(predicted).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("c"))
    totals = cell_totals(_with_coefficients(cells, [*groups, "t", "p"], seed), [*groups, "t", "p"], "c", reps)

    def cell(t: int, p: int):
        return F.sum(F.when((F.col("t") == t) & (F.col("p") == p), F.col("w")).otherwise(0.0))

    per_rep = totals.groupBy(*groups, "rep").agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                                                 cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    tiny = F.lit(1e-12)
    return per_rep.select(
        *groups, "rep", M.cell_precision().alias("precision"), M.cell_recall().alias("recall"),
        M.or_zero(M.ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        (F.col("tp") / (F.col("tp") + F.col("fn") + tiny)).alias("tpr"),
        (F.col("fp") / (F.col("fp") + F.col("tn") + tiny)).alias("fpr"))


#: The cells of one score range: in descending order of scores; a new score begins where ``begins`` is true.
PACKED = ("__group string, __bucket int, begins array<boolean>, positive array<boolean>, c array<bigint>, coefs array<bigint>, "
          "pos array<double>, neg array<double>, hits array<double>")


def score_bootstrap(df: DataFrame, groups: Sequence[str] = (), reps: int = 1000, seed: int = 7,
                    decide_at: float | None = None, score: str = "y_score", label: str = "y_true",
                    predicted: str = "y_pred", rows_per_bucket: int = CELLS_PER_BUCKET) -> DataFrame:
    """Average precision, FPR at 95 % TPR and accuracy per repetition.

    Accuracy is that of ``predicted``, or of deciding at ``decide_at`` if given. The cells of a score range are shuffled once, into one
    row that is saved with its resampled totals. Running totals over the ranges then meet the saved rows, whose weights
    are worked out again from 32 bytes a cell; keeping them would take a byte for each of ``reps``. Inside
    a task repetitions are columns of blocks that fit a processor's cache.
    """
    groups = list(groups)
    guess = (F.col(score) >= decide_at).cast("int") if decide_at is not None else F.col(predicted)
    known = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull()
    rows = df.where(known).select(
        *groups, F.col(score).cast("double").alias("threshold"), F.col(label).cast("int").alias("t"),
        (guess == F.col(label)).cast("int").alias("hit"))
    cells = rows.groupBy(*groups, "threshold", "t", "hit").agg(F.count(F.lit(1)).alias("c"))
    borders = splitters(rows.select(*groups, "threshold"), groups, "threshold", rows_per_bucket)
    drawn = _with_coefficients(bucketed(cells, groups, "threshold", borders), [*groups, "threshold", "t", "hit"], seed)
    # The group travels as one text, so that a task never has to compare nulls.
    label_of = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["threshold", "t", "hit"], ascending=[False, True, True])
        values, coefs, counts = frame["threshold"].to_numpy(), _coefs(frame), frame["c"].to_numpy()
        positive, hit = frame["t"].to_numpy() == 1, frame["hit"].to_numpy() == 1
        sums, chosen = np.zeros((3, reps)), np.stack([positive, ~positive, hit]).astype(float)
        for here, weights in weight_rows(coefs, counts, reps):
            sums[:, here] = chosen @ weights.T.astype(float)
        return pd.DataFrame([{
            "__group": frame["__group"].iloc[0], "__bucket": frame["__bucket"].iloc[0],
            "begins": np.r_[True, values[1:] != values[:-1]], "positive": positive, "c": counts, "coefs": coefs.ravel(),
            "pos": sums[0], "neg": sums[1], "hits": sums[2]}])

    # A cell is a few bytes and a thousand repetitions of work: dealt by number, not merged into few tasks by their bytes.
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    packed = saved(drawn.withColumn("__group", label_of).select("__group", "__bucket", "threshold", "t", "hit", "c", "a0", "a1", "a2", "a3")
                   .repartition(tasks, "__group", "__bucket").groupBy("__group", "__bucket").applyInPandas(pack, PACKED))
    names = saved(rows.groupBy(*groups).agg(F.lit(1).alias("__one")).withColumn("__group", label_of)) if groups else None

    totals = packed.select("__group", "__bucket", F.posexplode(F.arrays_zip("pos", "neg", "hits")).alias("rep", "x")).select(
        "__group", "__bucket", (F.col("rep") + 1).alias("rep"), "x.*")
    above = W.partitionBy("__group", "rep").orderBy(F.col("__bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("__group", "rep")
    starts = totals.select(
        F.col("__group").alias("of"), F.col("__bucket").alias("at"), "rep",
        F.coalesce(F.sum("pos").over(above), F.lit(0.0)).alias("pos_above"),
        F.coalesce(F.sum("neg").over(above), F.lit(0.0)).alias("neg_above"), F.sum("pos").over(whole).alias("n_pos"))
    starts = starts.groupBy("of", "at").agg(F.sort_array(F.collect_list(F.struct("rep", "pos_above", "neg_above", "n_pos"))).alias("s"))
    starts = starts.select("of", "at", *[F.col(f"s.{c}").alias(c) for c in ("pos_above", "neg_above", "n_pos")])
    met = packed.drop("pos", "neg", "hits").repartition(tasks, "__group", "__bucket").join(
        starts.repartition(tasks, "of", "at"), (F.col("__group") == F.col("of")) & (F.col("__bucket") == F.col("at")))

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                gained, reached = curve_part(*(np.asarray(x) for x in row[1:]), reps)
                yield pd.DataFrame({"__group": [row[0]], "gain": [gained], "neg_at": [reached]})

    parts = met.select("__group", "begins", "positive", "c", "coefs", "pos_above", "neg_above", "n_pos").mapInPandas(
        follow, "__group string, gain array<double>, neg_at array<double>")
    summed = (parts.select("__group", F.posexplode(F.arrays_zip("gain", "neg_at")).alias("rep", "x"))
              .groupBy("__group", (F.col("rep") + 1).alias("rep")).agg(
                  F.sum("x.gain").alias("gain"), F.min(F.when(F.col("x.neg_at") < float("inf"), F.col("x.neg_at"))).alias("neg_at")))
    ends = totals.groupBy("__group", "rep").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("hits").alias("hits"))
    found = ends.join(summed, ["__group", "rep"])
    if names is not None:
        found = found.join(names, "__group")
    return found.select(
        *groups, "rep", M.or_zero(M.ratio(F.col("gain"), F.col("n_pos"))).alias("pr_auc"),
        F.when(F.col("n_pos") > 0, M.ratio(F.col("neg_at"), F.col("n_neg"))).alias("fpr95"),
        M.ratio(F.col("hits"), F.col("n_pos") + F.col("n_neg")).alias("accuracy"))


def curve_part(begins: np.ndarray, positive: np.ndarray, counts: np.ndarray, coefs: np.ndarray, tp: np.ndarray,
               fp: np.ndarray, n_pos: np.ndarray, reps: int, need: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """What one score range adds to the sum under the precision curve, and the false positives at its first score that
    reaches ``need`` (infinite without), per repetition. tp and fp: what lies above the range."""
    gained, reached = np.zeros(reps), np.full(reps, np.inf)
    first = np.flatnonzero(begins)
    scores = np.flatnonzero(np.logical_or.reduceat(positive, first))  # those that have positive rows
    for here, weights in weight_rows(coefs.reshape(-1, 4), counts, reps):
        if len(first) < len(begins):
            pos = np.add.reduceat(weights * positive, first, axis=1).take(scores, axis=1)
            weights = np.add.reduceat(weights, first, axis=1)
        else:
            pos = weights.take(scores, axis=1)
        cum_pos = np.cumsum(pos, axis=1, dtype=np.int64) + tp[here, None]
        seen = np.cumsum(weights, axis=1, dtype=np.int64)
        gained[here] = (pos * cum_pos / np.maximum(seen.take(scores, axis=1) + (tp + fp)[here, None], 1.0)).sum(1)
        ends = cum_pos[:, -1] if len(scores) else tp[here]
        for row in np.flatnonzero((n_pos[here] > 0) & (ends >= need * n_pos[here] * (1 - 1e-12))):
            rep = here.start + row
            if tp[rep] > 0 and tp[rep] / n_pos[rep] >= need:
                continue  # a higher score has reached it, with no more false positives
            all_pos = np.zeros(len(first))
            all_pos[scores] = pos[row]
            all_pos = np.cumsum(all_pos) + tp[rep]
            ok = (weights[row] > 0) & (all_pos > 0) & (all_pos / n_pos[rep] >= need)
            if ok.any():
                reached[rep] = (seen[row] + tp[rep] + fp[rep] - all_pos)[ok].min()
    return gained, reached


def intervals(per_rep: DataFrame, metrics: Sequence[str], groups: Sequence[str] = (),
              undefined: str = "skip") -> DataFrame:
    """``metric, mean, low, high``: mean and the 2.5 and 97.5 percentiles over the repetitions.

    ``undefined="skip"`` leaves undefined repetitions out; ``"propagate"`` makes the metric null. The
    percentiles are over at most one value per repetition.
    """
    long = per_rep.unpivot([*groups, "rep"], list(metrics), "metric", "value")
    found = long.groupBy(*groups, "metric").agg(
        F.avg("value").alias("mean"), F.expr("percentile(value, array(0.025D, 0.975D))").alias("ends"),
        F.max(F.col("value").isNull()).alias("gap"))
    shown = (lambda c: F.when(~F.col("gap"), c)) if undefined == "propagate" else (lambda c: c)
    return found.select(*groups, "metric", shown(F.col("mean")).alias("mean"),
                        shown(F.col("ends")[0]).alias("low"), shown(F.col("ends")[1]).alias("high"))
