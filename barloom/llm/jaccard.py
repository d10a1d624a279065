"""Near copies by SimHash and the Jaccard similarity of their sets of word shingles.

Each set has a SimHash. The segment counts of `simhash` and their grid find every pair of sets whose
fingerprints differ in at most DISTANCE bits: sets that share a cell, then Manhattan distance of the
counts, then Hamming distance. The exact Jaccard similarity decides.

A similarity of 0.8 leaves about 10 of 64 bits different, more than a grid over 64 bits can search. So
beside the grid MinHash bands propose the pairs beyond DISTANCE: PER of the minima agree in one band
with probability J ** PER, and of BANDS bands none does in 3 of a million pairs of J = 0.8, fewer above.
SimHash drops those of them that are far apart, and the same exact similarity decides on the rest.

Equal sets count once. Cells and bands with few sets give pairs in a join. In one with many, a set meets
the first; as most then hang together, only sets outside the largest component so far meet all of the
cell or band, block by block, each pair of blocks in a group of bounded size that returns a spanning
forest. A pair inside the component needs no link of its own, so none is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.graph import components
from barloom.llm.simhash import DISTANCE, SEED, _bits, _hashes, _majority, cell_masks, embed
from barloom.llm.text import lower_words, sliced
from barloom.session import cut_lineage

#: Words of a shingle, and the similarity (NUM / DEN) from which texts are near copies.
WIDTH, NUM, DEN = 5, 4, 5
BANDS, PER = 24, 4
#: Sets of this many shingles and more are compared only within FAR bits, five deviations above the 10 of J = 0.8.
FAR_FROM, FAR = 32, 24
#: Cells and bands with up to this many sets pair up in a join; larger ones are compared block by block.
CELL, BLOCK = 32, 512
#: Large cells or bands of a set in which it is compared with the first before anything else.
STARS = 4
#: Shingles of two blocks that are compared at a time.
_COLUMNS = 4096
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, BANDS * PER, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, BANDS * PER, np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles, A-Z in lower case. Fewer words than WIDTH make one; none (or null) no shingle."""
    found = lower_words(text)
    return np.unique(np.concatenate(list(_hashes(found, WIDTH, SEED)))) if found else np.zeros(0, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One long per band: a digest of the least of the shingles under each of PER orders."""
    least = np.full(BANDS * PER, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 13):
        x = (hashes[None, at : at + (1 << 13)] ^ _XOR[:, None]) * _ODD[:, None]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, x.min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes()) for band in least.reshape(BANDS, PER)], np.uint64).view(np.int64)


def _sketches(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with (set, fp, n, bands) in place of the text: 128 bits that name the shingle set, its SimHash, its size, its bands."""
    at, kept = rows.columns.index(text_col), [f for f in rows.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            sets = [shingle_set(t.as_py()) for t in batch.column(at)]
            prints = np.array([_majority(_bits(h), len(h)) if len(h) else 0 for h in sets], np.uint64).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([band_keys(h) for h in sets])))
            found = {"set": pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), "fp": pa.array(prints), "n": pa.array([len(h) for h in sets], pa.int64()), "bands": bands}
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | found)

    made = T.StructType().add("set", T.BinaryType()).add("fp", T.LongType()).add("n", T.LongType()).add("bands", T.ArrayType(T.LongType()))
    return rows.mapInArrow(run, T.StructType([*kept, *made.fields]))


def _shingled(texts: DataFrame) -> DataFrame:
    """(set, shingles) of (set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["set", "shingles"])

    return texts.mapInArrow(run, "set binary, shingles array<long>")


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """Links each set of a pair of blocks to the least row it is connected with there."""
    ids, n = rows["set"].to_numpy(), rows["n"].to_numpy()
    left = np.flatnonzero(rows["side"].to_numpy() != 1)
    right = np.flatnonzero(rows["side"].to_numpy() != 0)
    owner = np.repeat(np.arange(len(ids)), n)
    names, column, times = np.unique(np.concatenate(list(rows["shingles"])), return_inverse=True, return_counts=True)
    # shingles of one set alone are in no intersection
    shared = times > 1
    column, owner = (np.cumsum(shared) - 1)[column][shared[column]], owner[shared[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        holds = np.zeros((len(ids), _COLUMNS), np.float32)
        holds[owner[a:b], column[a:b] - at] = 1
        common += holds[left] @ holds[right].T
    i, j = np.nonzero(DEN * common >= NUM * (n[left][:, None] + n[right][None, :] - common))
    a, b = left[i], right[j]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"u": ids[moved], "v": ids[label[moved]]})


def _verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets have the similarity."""
    both = pairs.join(shingles.toDF("u", "a"), "u").join(shingles.toDF("v", "b"), "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    return both.where(DEN * F.col("common") >= NUM * (F.size("a") + F.size("b") - F.col("common"))).select("u", "v")


def _banded(sets: DataFrame) -> DataFrame:
    """(band, key, set, fp, n, draw, many) for each band that many sets, at least two, share."""
    placed = sets.select("set", "fp", "n", "draw", F.posexplode("bands").alias("band", "key"))
    shared = placed.groupBy("band", "key").agg(F.count("*").alias("many")).where("many > 1")
    return cut_lineage(placed.join(shared, ["band", "key"]))


def _gridded(sets: DataFrame) -> DataFrame:
    """The same, and the unary codes of the segment counts, for each cell of the grid; cells are numbered after the bands.

    Equal fingerprints count once in the search. Most cells hold one, so keys and fingerprints go there alone."""
    points = cut_lineage(sets.groupBy("fp").agg(F.count("*").alias("w")).withColumn("code", embed(F.col("fp"))))
    masks = cell_masks(points.count(), DISTANCE)
    # a clash of two keys adds a comparison, no link
    cell = F.explode(F.array(*[F.struct(F.lit(BANDS + i).alias("band"), F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(m))).alias("key")) for i, m in enumerate(masks)]))
    placed = points.select("fp", "w", cell.alias("c")).select("fp", "w", "c.band", "c.key")
    shared = cut_lineage(placed.groupBy("key").agg(F.sum("w").alias("many")).where("many > 1"))
    return cut_lineage(placed.drop("w").join(shared, "key").join(sets.drop("bands"), "fp").withColumn("code", embed(F.col("fp"))))


def _met(members: DataFrame, close: Column) -> DataFrame:
    """(u, v, and their draws) for the pairs in each cell or band that are close and whose sizes allow the similarity."""
    other = members.select("band", "key", *[F.col(c).alias(f"{c}2") for c in members.columns if c not in ("band", "key", "many")])
    sizes = DEN * F.least("n", "n2") >= NUM * F.greatest("n", "n2")
    pairs = members.join(other, ["band", "key"]).where((F.col("set") < F.col("set2")) & sizes & close)
    return pairs.select(F.col("set").alias("u"), F.col("set2").alias("v"), F.col("draw").alias("du"), F.col("draw2").alias("dv"))


def links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): edges that connect the sets (set, fp, n, bands, draw) which links of the similarity
    connect. texts (draw, text) has the text of each draw."""
    cells, bands = _gridded(sets), _banded(sets)
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    near_codes = F.bit_count(F.col("code").bitwiseXOR(F.col("code2"))) <= DISTANCE
    not_far = (F.least("n", "n2") < FAR_FROM) | (hamming <= FAR)
    few = F.col("many") <= CELL
    pairs = cut_lineage(_met(cells.where(few), near_codes & (hamming <= DISTANCE)).union(_met(bands.where(few), not_far)).distinct())
    large = bands.where(~few).unionByName(cells.where(~few).drop("code"))
    met = pairs.select(F.col("u").alias("set"), F.col("du").alias("draw")).union(pairs.select("v", "dv")).union(large.select("set", "draw")).distinct()
    found = texts.join(met, "draw").dropDuplicates(["set"])
    found = cut_lineage(_shingled(found.select("set", "text")))
    near = cut_lineage(_verified(pairs.select("u", "v").union(_stars(large)).distinct(), found))
    return near.union(_across(large, near, found))


def _stars(large: DataFrame) -> DataFrame:
    """(u, v): each set of a large cell or band with its first, in a few of them."""
    # bands are taken by a hash, so that sets of a group get different firsts
    turn = F.row_number().over(Window.partitionBy("set").orderBy(F.xxhash64("set", "band")))  # as many rows as there are cells and bands
    some = large.withColumn("turn", turn).where(F.col("turn") <= STARS).select("band", "key", "set")
    firsts = large.groupBy("band", "key").agg(F.min_by("set", F.xxhash64("set", "band")).alias("first"))
    return some.join(firsts, ["band", "key"]).where(F.col("set") != F.col("first")).select(F.least("set", "first").alias("u"), F.greatest("set", "first").alias("v"))


def _across(large: DataFrame, near: DataFrame, shingles: DataFrame) -> DataFrame:
    """Edges between sets of a large cell or band that near does not connect yet. Most sets of such a one are one
    component by now; only those outside it meet the others, block by block."""
    roots = components(near).withColumnRenamed("node", "set")
    rooted = cut_lineage(large.select("band", "key", "set", "n").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")))
    counts = rooted.groupBy("band", "key", "root").agg(F.count("*").alias("c"))
    main = counts.groupBy("band", "key").agg(F.max(F.struct("c", "root")).alias("x"), F.sum("c").alias("many"))
    main = main.select("band", "key", F.col("x.root").alias("main"), F.col("x.c").alias("inside"), (F.col("many") - F.col("x.c")).alias("outside")).where("outside > 0")
    few, rest = F.ceil(F.col("outside") / BLOCK), F.ceil(F.col("inside") / BLOCK)  # blocks outside come first
    is_main, h = F.col("root") == F.col("main"), F.xxhash64("set")
    placed = rooted.join(main, ["band", "key"]).withColumn("own", F.when(is_main, few + F.pmod(h, rest)).otherwise(F.pmod(h, few)))
    last = F.when(is_main, few - 1).otherwise(few + rest - 1)
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # in the group of one block with itself a set stands on both sides
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    dealt = dealt.select("band", "key", "set", "n", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), side.alias("side"))
    return dealt.join(shingles, "set").groupBy("band", "key", "i", "j").applyInPandas(_forest, "u binary, v binary")


def near_copies(docs: DataFrame, draw: Column, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(the columns of keep, draw, root) for each row; root names the component under links of the similarity.

    draw: a value that is the same only for rows of the same text. Null and texts without words are one
    set, linked to no other. Very long texts count with all their shingles, rows that repeat count once in
    the search and come back each; other columns are not read, so names cannot clash but for draw and root.
    An empty table gives an empty table."""
    rows = docs.select(*keep, draw.alias("draw"), F.col(text_col).alias("_text"))
    prints = cut_lineage(_sketches(rows, "_text"))
    sets = prints.groupBy("set").agg(F.min(F.struct("draw", "fp", "n", "bands")).alias("x"))
    sets = cut_lineage(sets.select("set", "x.*").where("n > 0"))
    roots = components(links(sets, docs.select(draw.alias("draw"), F.col(text_col).alias("text"))))
    rooted = prints.drop("fp", "n", "bands").join(roots.withColumnRenamed("node", "set"), "set", "left")
    return rooted.withColumn("root", F.coalesce("root", "set")).drop("set")
