"""Connected components of an edge table, without a group that meets in one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): m is the least of u and its neighbours v. A partial aggregate, so a hub costs no more."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    Alternates two steps until nothing changes: every node points its larger neighbours to the least
    of its neighbourhood, then its smaller ones and itself. The number of rounds grows with the
    logarithm of the size of a component. Loops, repeated edges and null ends are ignored."""
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col("u") > F.col("v")).distinct()
    e, before = cut_lineage(e), None
    while True:
        both = e.union(e.select("v", "u"))
        e = both.join(_smallest(both), "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = e.join(_smallest(e), "u")
        e = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").where(F.col("u") != F.col("v")).distinct()
        e = cut_lineage(e)
        after = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
