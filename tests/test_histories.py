"""Histories: partitions follow the rows, and a detection asks only about peaks that a row can meet."""

import numpy as np
import pytest

from barloom.operators import panel, signals
from barloom.plans import load
from barloom.plans.registry import Views


def test_partitions_follow_the_rows(bars):
    cores = bars.sparkSession.sparkContext.defaultParallelism
    assert panel.dealt(bars, 10).rdd.getNumPartitions() == cores
    assert panel.dealt(bars, 40 * panel.DEALT_ROWS + 1).rdd.getNumPartitions() == 41


@pytest.mark.parametrize("digits, distance", [(0, 3), (1, 7), (9, 12)])
def test_single_peaks_as_the_greedy_walk_keeps_them(digits, distance):
    rng = np.random.default_rng(distance)
    x = np.round(rng.normal(size=300).cumsum(), digits)
    pk, ends = signals.peaks_with_ends(x)
    for n in (3, 50, 299, 300):
        some = [j for j, end in enumerate(ends) if end < n - 1]
        known = {}
        kept = [pk[j] for j in some if signals.stays(j, x.tolist(), pk, len(some), distance, known)]
        assert kept == list(signals.spaced_peaks(x[:n], distance))


def test_work_of_a_detection_does_not_grow_with_the_history(monkeypatch):
    asked = []
    stays = signals.stays
    monkeypatch.setattr(signals, "stays", lambda j, x, pk, n, d, known: (stays(j, x, pk, n, d, known), asked.append(len(known)))[0])
    x = np.random.default_rng(2).normal(size=3000).cumsum() * 0.1
    signals.divergence_rows(50 + x, np.diff(x, prepend=0.0))
    assert asked and max(asked) < 120


@pytest.mark.parametrize("name", ["w20_golden_cross_score", "w24_exit_score"])
def test_nothing_is_shuffled_after_the_walk(spark, name):
    """A window above the walk shuffles its rows again, into partitions that do not follow them."""
    plan = load()[name].build(Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]
