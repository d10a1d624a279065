"""Weighted sampling with the production number of bins: the share of equal samples is the similarity."""

from collections import Counter

import pytest
from llm.test_dedup_operators import jaccard
from pyspark.sql import functions as F

from barloom.llm import cws

ONES = list(range(1, 301))
CASES = {
    "heavy in one": (ONES + [0] * 1000, ONES),
    "heavy in both": ([0] * 1000 + ONES, [0] * 1000 + [1000 + t for t in ONES]),
    "heavy differs": (ONES + [0] * 1000, ONES + [0] * 400),
    "counts of all sizes": ([t for t in range(100) for _ in range(1 + t)], [t for t in range(100) for _ in range(100 - t)]),
    "even": (ONES, ONES[100:] + [1000 + t for t in ONES[:100]]),
}


@pytest.mark.parametrize("case", CASES)
def test_likeness_is_generalised_jaccard(spark, case):
    """Mean over other names of the same terms, with the bins that op7 takes."""
    x, y = CASES[case]
    sides = spark.createDataFrame([([t + 10_000 * k for t in x], [t + 10_000 * k for t in y]) for k in range(24)], "x array<long>, y array<long>").repartition(8)
    got = sides.agg(F.avg(cws.likeness(cws.signature(F.col("x")), cws.signature(F.col("y"))))).first()[0]
    assert abs(got - jaccard(Counter(x), Counter(y))) < 0.04
