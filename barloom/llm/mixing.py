"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length). Each source then plans alone over its lengths,
of which there are as many as lengths differ, not as many as documents: how often all its
documents are taken, and how many of each length once more, so that the words taken meet the
target. The same share of every length is taken first; a bounded-knapsack programme over the
remaining budget closes the gap. Which documents of a length are taken is fixed by seeded hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.text import WORD
from barloom.session import cut_lineage

#: Weights of the sources in code-point order, repeating; and the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST = 3
#: The remaining budget that the knapsack programme closes, in words.
CAPACITY = 1 << 16
_BINS = 1024


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take: the largest sum up to budget, lengths[i] at most counts[i] times.

    Counts are split into powers of two; first[s] is the step that first reached sum s, so the
    choice is read back with one number per sum."""
    taken = np.zeros(len(lengths), int)
    first = np.full(budget + 1, -1, np.int64)
    first[0] = 0
    steps: list[tuple[int, int]] = [(0, 0)]
    for i in np.argsort(-lengths, kind="stable"):
        length, left, part = int(lengths[i]), int(counts[i]), 1
        if length <= 0 or length > budget:
            continue
        left = min(left, budget // length)
        while left > 0 and first[budget] < 0:
            n = min(part, left)
            steps.append((int(i), n))
            shift = n * length
            if shift <= budget:
                new = np.flatnonzero((first[: budget + 1 - shift] >= 0) & (first[shift:] < 0)) + shift
                first[new] = len(steps) - 1
            left, part = left - n, part * 2
        if first[budget] >= 0:
            break
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        i, n = steps[first[at]]
        taken[i] += n
        at -= n * int(lengths[i])
    return taken


def fit_budget(lengths: np.ndarray, counts: np.ndarray, target: float, capacity: int = CAPACITY) -> tuple[int, np.ndarray]:
    """(copies of every document, documents of each length that are taken once more)."""
    total = int((lengths * counts).sum())
    once_more = np.zeros(len(lengths), int)
    if total == 0:
        return 0, once_more
    copies = min(MOST, int(target // total))
    budget = min(int(round(target - copies * total)), total) if copies < MOST else 0
    share = budget / total
    once_more = np.floor(counts * share).astype(int)
    rest = budget - int((lengths * once_more).sum())
    # largest remainders first, until the programme can take over
    for i in np.argsort(-(counts * share - once_more), kind="stable"):
        if rest <= capacity:
            break
        if 0 < lengths[i] <= rest and once_more[i] < counts[i]:
            once_more[i] += 1
            rest -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= capacity or lengths[i] <= 0:
            break
        n = min(int(counts[i] - once_more[i]), rest // int(lengths[i]))
        once_more[i] += n
        rest -= n * int(lengths[i])
    if rest > 0:
        once_more += knapsack(lengths, counts - once_more, min(rest, capacity))
    return copies, once_more


def _source_key(source: Column) -> Column:
    """Joins treat the null source as a source."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded number for a row; rows equal in id and text share it."""
    return F.xxhash64(F.lit(seed), doc_id, text)


def source_targets(sized: DataFrame) -> DataFrame:
    """(source_key, source_size, target) from (source, source_key, size).

    Positions in code-point order come from a range partitioning of the sources and the rows before
    each of its partitions. Targets fill up evenly by weight: level rises until min(3 x size,
    level x weight) add up to all sizes. Only sums over sources reach the driver."""
    totals = sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    placed = cut_lineage(totals.repartitionByRange(16, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    rows = {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}
    offsets = np.cumsum([0, *(rows.get(p, 0) for p in range(max(rows, default=0)))]).tolist()
    rank = F.element_at(F.array(*map(F.lit, offsets)), (part + 1).cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = placed.select("source_key", "source_size", weight.alias("weight"))
    all_words = weighed.agg(F.sum("source_size")).first()[0] or 0
    most, level = MOST * F.col("source_size"), -1.0
    while True:
        full = most < level * F.col("weight")
        w, c = weighed.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, most))).first()
        new = (all_words - (c or 0)) / w if w else level
        if new <= level:
            break
        level = new
    return weighed.select("source_key", "source_size", F.least(most.cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def plan(sized: DataFrame) -> DataFrame:
    """(source_key, size, source_size, target, copies, last): a document of that source and size is
    taken copies times, and once more if its draw is at most last (null: none is)."""
    targets = cut_lineage(source_targets(sized))
    hist = sized.groupBy("source_key", "size").agg(F.count("*").alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        copies, more = fit_budget(rows["size"].to_numpy(), rows["n"].to_numpy(), float(rows["target"][0]))
        return rows.assign(copies=copies, more=more)[["source_key", "size", "source_size", "target", "copies", "more", "n"]]

    fitted = cut_lineage(hist.join(targets, "source_key").groupBy("source_key").applyInPandas(fit, "source_key string, size long, source_size long, target double, copies long, more long, n long"))
    # The draw of the document at rank `more` within its length: find the bin of draws that holds
    # the rank by counting bins, then rank inside that bin only.
    part = fitted.where((F.col("more") > 0) & (F.col("more") < F.col("n"))).select("source_key", "size", "more")
    drawn = sized.join(part, ["source_key", "size"]).withColumn("bin", F.floor(F.col("draw") / F.lit(2.0**64 / _BINS)))
    bins = drawn.groupBy("source_key", "size", "more", "bin").agg(F.count("*").alias("here"))
    w = Window.partitionBy("source_key", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = bins.withColumn("before", F.coalesce(F.sum("here").over(w), F.lit(0))).where((F.col("before") < F.col("more")) & (F.col("more") <= F.col("before") + F.col("here")))
    inside = drawn.join(edge.select("source_key", "size", "bin", "before"), ["source_key", "size", "bin"])
    ranked = inside.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("source_key", "size", "bin").orderBy("draw")))
    last = ranked.where(F.col("rank") == F.col("more")).select("source_key", "size", F.col("draw").alias("at"))
    every = F.when(F.col("more") >= F.col("n"), F.lit((1 << 63) - 1))
    return fitted.join(last, ["source_key", "size"], "left").select("source_key", "size", "source_size", "target", "copies", F.when(F.col("more") > 0, F.coalesce("at", every)).alias("last"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: the columns of keep, then size, source_size, target and copies.

    Size counts words (null text: 0). A null source is a source, after all others. Documents without
    words are taken with the full copies of their source only. Rows equal in id and text share a
    draw, so they are taken together: a source can then exceed its plan by such rows. Sums depend on
    neither the order of rows nor their partitions, so reruns agree. An empty table stays empty."""
    size, key = _size(F.col(text_col)), _source_key(F.col(source_col))
    draw = _draw(F.col(id_col), F.col(text_col), seed)
    sized = cut_lineage(docs.select(F.col(source_col).alias("source"), key.alias("source_key"), size.alias("size"), draw.alias("draw")))
    planned = plan(sized).withColumnsRenamed({"size": "_size", "source_key": "_key"})
    rows = docs.select(*keep, size.alias("_own_size"), key.alias("_own_key"), draw.alias("_draw"))
    met = rows.join(planned, (F.col("_own_key") == F.col("_key")) & (F.col("_own_size") == F.col("_size")))
    copies = F.col("copies") + F.when((F.col("_size") > 0) & (F.col("_draw") <= F.col("last")), 1).otherwise(0)
    return met.select(*keep, F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"))
