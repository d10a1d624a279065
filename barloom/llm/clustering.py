"""Centroid clustering of whole-number vectors with zone maps along a Hilbert curve.

Vectors are put in the order of a Hilbert curve and cut into blocks; a block knows the box that
holds its vectors. In a round, the distance of each centroid to a box is at least `least` and at
most `most`; a centroid whose least exceeds the smallest most can be nearest to no vector of the
block. The others are the block's candidates, and only they are compared, exactly, with all of its
vectors at once. Blocks are written once and read in every round; a round sends back counts and
sums of each cluster, so its shuffle is as large as the centroids whatever the table.

All arithmetic is in whole numbers, so rounds agree on any partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import written

#: Components end at this size, so that a squared distance in 64 dimensions stays a long.
LARGEST = 1 << 27
#: Vectors of a block, and bits of each dimension that the curve tells apart.
BLOCK, BITS = 128, 4
#: Products of numbers up to this size add up without loss in a double.
_EXACT = 1 << 21


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as a double, held within LARGEST."""
    held = lambda x: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(float(scale)) * x.cast("double")))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def usable(vector: Column, dims: int) -> Column:
    """True for a vector of dims components, none of them null or without a finite value."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, finite), F.lit(False))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """For each row of cells (whole numbers under 2 ** bits), its place on the Hilbert curve, as bytes in order.

    From the highest bit down, each level reflects or swaps the lower bits of an axis with those of the
    first; a Gray code over the axes then gives the bits of the place."""
    x = cells.astype(np.uint32).T.copy()
    dims, top = len(x), np.uint32(1 << (bits - 1))
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(dims):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(flip, low, swap).astype(np.uint32)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= turn
    levels = [(x >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(levels).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box from low to high."""
    under, over = low - centroids, centroids - high
    least = (np.maximum(0, np.maximum(under, over)) ** 2).sum(1)
    most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(1)
    return np.flatnonzero(least <= most.min())


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (of equals, the smaller number) and the squared distance, exactly."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT:
        v, c = vectors.astype(float), centroids.astype(float)
        found = ((v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (v @ c.T)).astype(np.int64)
    else:
        found = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)
    at = found.argmin(1)
    return at, found[np.arange(len(at)), at]


@dataclass
class Clusters:
    """assigned: a row (the id, cluster, distance) for each vector; centroids in the order of their numbers."""

    assigned: DataFrame
    centroids: list[list[int]]

    def totals(self) -> DataFrame:
        """(cluster, cluster_inertia, centroid_sha256) of each cluster that has vectors: as many rows as centroids at most."""
        sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]
        names = self.assigned.sparkSession.createDataFrame(list(enumerate(sha)), "cluster int, centroid_sha256 string")
        return self.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(names, "cluster")


def _blocks(rows: DataFrame, lows: np.ndarray, highs: np.ndarray) -> DataFrame:
    """A row for each block of BLOCK vectors that follow each other on the curve: ids, the vectors one after
    another, and the box."""
    span = np.maximum(1, highs - lows)

    @F.pandas_udf("binary")
    def place(vectors: pd.Series) -> pd.Series:
        v = np.stack(vectors.to_numpy()).astype(np.int64) if len(vectors) else np.zeros((0, len(lows)), np.int64)
        return pd.Series(hilbert_keys(np.clip((v - lows) * (1 << BITS) // span, 0, (1 << BITS) - 1)), dtype=object)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                v = np.stack(part["v"].to_numpy())
                out.append((part["id"].tolist(), v.ravel(), v.min(0), v.max(0)))
            yield pd.DataFrame(out, columns=["ids", "v", "low", "high"])

    # equal vectors have equal places: the id's hash deals a place with many of them over partitions
    keyed = rows.withColumn("place", place("v")).withColumn("deal", F.xxhash64("id"))
    ordered = keyed.repartitionByRange("place", "deal").sortWithinPartitions("place", "deal")
    return ordered.select("id", "v").mapInPandas(cut, "ids array<string>, v array<int>, low array<int>, high array<int>")


def cluster(vectors: DataFrame, n_clusters: int, rounds: int, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Centroids and the nearest one of each vector after rounds of reassigning and averaging.

    Rows whose vector is null, of another length, or has a null, NaN or infinite component are left out.
    Components beyond LARGEST after scaling count as that number. The first centroids are the n_clusters
    kept vectors least by sha256 of "seed:id" (null ids last, then by components), all if fewer. A mean
    is floor(sum / count); a centroid without vectors stays. Rows that repeat, or share an id, are vectors
    of their own. Other columns are not read. No kept vector: no centroid and no row."""
    kind = vectors.schema[id_col].dataType.simpleString()
    kept = vectors.where(usable(F.col(vector_col), dims)).select(F.col(id_col).cast("string").alias("id"), whole_numbers(F.col(vector_col), scale).alias("v"))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")).cast("binary"), 256)
    first = kept.orderBy(named.asc_nulls_last(), "v").limit(n_clusters).collect()
    spark = vectors.sparkSession
    if not first:
        return Clusters(spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long"), [])
    centroids = np.array([r["v"] for r in first], np.int64)
    blocks = written(_blocks(kept, centroids.min(0), centroids.max(0)), "vector-blocks")

    def assigned(centroids: np.ndarray, batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for v, low, high in zip(batch["v"], batch["low"], batch["high"], strict=True):
            v = v.reshape(-1, dims).astype(np.int64)
            near = candidates(low.astype(np.int64), high.astype(np.int64), centroids)
            at, distance = nearest(v, centroids[near])
            yield v, near[at], distance

    for _ in range(rounds):

        def summed(batches: Iterator[pd.DataFrame], centroids: np.ndarray = centroids) -> Iterator[pd.DataFrame]:
            n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
            for batch in batches:
                for v, at, _ in assigned(centroids, batch):
                    n += np.bincount(at, minlength=len(n))
                    order = np.argsort(at, kind="stable")
                    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                    sums[at[order][starts]] += np.add.reduceat(v[order], starts)
            used = np.flatnonzero(n)
            yield pd.DataFrame({"cluster": used, "n": n[used], "sums": list(sums[used])})

        parts = blocks.select("v", "low", "high").mapInPandas(summed, "cluster int, n long, sums array<long>")
        each = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        centroids = centroids.copy()
        for r in each.collect():  # n_clusters * dims rows at most
            centroids[r["cluster"], r["d"]] = r["s"] // r["n"]

    def final(batches: Iterator[pd.DataFrame], centroids: np.ndarray = centroids) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(assigned(centroids, batch))
            ids = [x for own in batch["ids"] for x in own]
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "cluster": np.concatenate([x[1] for x in found]), "distance": np.concatenate([x[2] for x in found])})

    out = blocks.mapInPandas(final, "id string, cluster int, distance long")
    out = out.select(F.col("id").cast(kind).alias(id_col), "cluster", "distance")
    return Clusters(written(out, "assigned-vectors"), centroids.tolist())
