"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the number of set bits in each of its segments. One bit that
differs changes one count by at most one, so the Manhattan distance of the counts is a lower bound
of the Hamming distance. The range join on that distance uses a grid: the axes are dealt into
groups, and two points within d of each other agree exactly on all but d groups, so each point
enters one cell for each choice of the groups that agree. Points that share a cell are compared by
Manhattan distance, and what passes is verified by Hamming distance.

Counts are held as unary codes (c set bits for count c), so that the Manhattan distance of two
points is the number of bits in which their codes differ."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.graph import components
from barloom.llm.text import lower_words
from barloom.session import cut_lineage

SEED, DISTANCE, SEGMENT = 42, 3, 2
#: Cells up to this many points pair up in a join; larger ones are compared block by block.
CELL, BLOCK = 64, 2048


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half the XXH64 of the word shingles, repeats included.

    Fewer words than width make one shingle; none (or null) the fingerprint 0."""
    found = lower_words(text)
    if not found:
        return 0
    counts, total = np.zeros(64, np.int64), 0
    for hashes in _hashes(found, width, seed):
        counts += _bits(hashes)
        total += len(hashes)
    return _majority(counts, total)


def _hashes(found: list[bytes], width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles, in pieces."""
    total = max(1, len(found) - width + 1)
    for at in range(0, total, 1 << 15):
        part = found[at : at + (1 << 15) + width - 1]
        ends = np.cumsum([len(w) + 1 for w in part])
        joined, last = b" ".join(part), min(total - at, 1 << 15)
        starts = [0, *ends[: last - 1].tolist()]
        stops = (ends[min(width, len(part)) - 1 :][:last] - 1).tolist()
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], "<u8")


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(counts: np.ndarray, total: int) -> int:
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(id, the columns of keep, fp long) for each row; ids may be null or repeat."""
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))
    kept = [c for c in rows.columns if c != "_text"]

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t) for t in batch], "<u8").view("<i8"))

    return rows.select(*kept, fp("_text").alias("fp"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def embed(fp: Column, segment: int = SEGMENT) -> Column:
    """The unary codes of the bit counts of all segments, in 64 bits."""
    mask, code = (1 << segment) - 1, F.lit(0).cast("long")
    for at in range(0, 64, segment):
        count = F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit(mask)))
        code = code.bitwiseOR(F.shiftleft(F.element_at(F.array(*[F.lit((1 << c) - 1).cast("long") for c in range(segment + 1)]), count + 1), at))
    return code


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_masks(n: int, distance: int = DISTANCE, segment: int = SEGMENT) -> list[int]:
    """Masks over the unary codes, one per choice of groups that agree.

    The number of groups follows the number of points, so that a cell of evenly spread points holds
    about one; any number of groups above distance finds every pair."""
    axes = 64 // segment
    # chance that two even segments of this width have the same count
    same = sum(comb(segment, c) ** 2 for c in range(segment + 1)) / 4**segment
    groups = 2 * distance
    while groups < axes and n * same ** (axes * (groups - distance) / groups) > 1:
        groups += 2
    bounds = [axes * g // groups for g in range(groups + 1)]
    part = [sum(((1 << segment) - 1) << (segment * a) for a in range(bounds[g], bounds[g + 1])) for g in range(groups)]
    return [_signed(sum(part[g] for g in chosen)) for chosen in combinations(range(groups), groups - distance)]


def _forest(distance: int):
    """Links each point of a block, or pair of blocks, to the least point it is connected with there."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp, code = rows["fp"].to_numpy(), rows["code"].to_numpy()
        left = np.flatnonzero(rows["side"].to_numpy() != 1)
        right = np.flatnonzero(rows["side"].to_numpy() != 0)
        a, b = [], []
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            near = np.bitwise_count((code[part, None] ^ code[None, right]).view(np.uint64)) <= distance
            i, j = np.nonzero(near)
            i, j = part[i], right[j]
            ok = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= distance
            a.append(i[ok])
            b.append(j[ok])
        a, b = np.concatenate(a), np.concatenate(b)
        label = np.arange(len(fp))
        while True:
            new = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"u": fp[moved], "v": fp[label[moved]]})

    return run


def links(points: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): edges that connect exactly those distinct fingerprints (column fp) which links of at
    most distance bits connect. Small cells give each link; a large cell is cut into blocks, each
    pair of blocks is one group of bounded size, and gives a spanning forest instead of all pairs."""
    points = cut_lineage(points.select("fp", embed(F.col("fp")).alias("code")))
    masks = cell_masks(points.count(), distance)
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("cell"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    placed = points.select("fp", "code", cell.alias("c")).select("fp", "code", "c.cell", "c.key")
    shared = cut_lineage(placed.groupBy("cell", "key").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut_lineage(placed.join(shared, ["cell", "key"]))
    small, large = members.where(F.col("n") <= CELL), members.where(F.col("n") > CELL)
    other = small.select("cell", "key", F.col("fp").alias("fp2"), F.col("code").alias("code2"))
    manhattan = F.bit_count(F.col("code").bitwiseXOR(F.col("code2"))) <= distance
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance
    pairs = small.join(other, ["cell", "key"]).where((F.col("fp") < F.col("fp2")) & manhattan & hamming).select(F.col("fp").alias("u"), F.col("fp2").alias("v"))
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("fp"), blocks)
    dealt = large.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    # in the group of one block with itself a point stands on both sides
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    dealt = dealt.select("cell", "key", "fp", "code", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), side.alias("side"))
    forest = dealt.groupBy("cell", "key", "i", "j").applyInPandas(_forest(distance), "u long, v long")
    return pairs.union(forest)


def classes(prints: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id") -> DataFrame:
    """prints (id and fp) with root, a fingerprint that names the component, and component_id: the least
    id that links of at most distance bits reach.

    Equal fingerprints count once in the search. Rows keep their number; null ids are never least,
    and a component of null ids only has a null component_id."""
    alike = cut_lineage(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(alike, distance))
    rooted = alike.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(id, the columns of keep, fp, root, component_id) for each row; a null text has fingerprint 0, as an
    empty one, and links like any other. An empty table gives an empty table."""
    return classes(cut_lineage(fingerprints(docs, id_col, text_col, keep)), id_col=id_col)
