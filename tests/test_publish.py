"""Publishing behind a manifest: refusals, failures on the way, repeated runs."""

import shutil
from pathlib import Path

import pytest

from barloom.operators.quality import Rule
from barloom.operators.report import projected
from barloom.sources import publish as P

SCHEMA = "symbol long, day string, close double"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    root = str(tmp_path)
    P.publish(batch(spark, [(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0), (4, None, 9.0)]), root, "one", ["symbol"], "day")
    return root


def test_parts_of_a_batch_replace_those_before(spark, table):
    P.publish(batch(spark, [(1, "a", 5.0), (9, "c", 6.0)]), table, "two", ["symbol"], "day")
    found = {(r["symbol"], r["day"], r["close"]) for r in P.published(spark, table).collect()}
    assert found == {(1, "a", 5.0), (9, "c", 6.0), (3, "b", 3.0), (4, None, 9.0)}
    assert {(r["part"], r["batch"], r["n_rows"]) for r in P.manifest(spark, table).collect()} == {("a", "two", 1), ("b", "one", 1), ("none", "one", 1), ("c", "two", 1)}
    before = {(r["symbol"], r["close"]) for r in P.published(spark, table, version=1).collect()}
    assert before == {(1, 1.0), (2, 2.0), (3, 3.0), (4, 9.0)}
    assert P.lost_parts(spark, table).count() == 0


@pytest.mark.parametrize(
    "rows, contract, problems",
    [
        ([(1, "a", 5.0), (1, "b", 6.0)], None, {"keys that repeat": 1}),
        ([(None, "a", 5.0), (None, "a", 6.0)], None, {"rows without a key": 2}),
        ([(1, "a", None), (2, "a", None), (3, "a", 1.0)], [Rule("symbol", "bigint", nullable=False), Rule("close", "double", nullable=False)], {"close: null": 2}),
        ([(1, "a", 1.0)], [Rule("symbol", "bigint"), Rule("volume", "bigint")], {"volume: missing column": 1}),
    ],
)
def test_a_broken_batch_changes_nothing(spark, table, rows, contract, problems):
    before, known = {tuple(r) for r in P.published(spark, table).collect()}, P.versions(spark, table)
    with pytest.raises(P.Rejected) as e:
        P.publish(batch(spark, rows), table, "broken", ["symbol"], "day", contract)
    assert e.value.problems == problems
    assert {tuple(r) for r in P.published(spark, table).collect()} == before and P.versions(spark, table) == known
    # mended, it goes through under its own name
    P.publish(batch(spark, [(1, "a", 7.0)]), table, "broken", ["symbol"], "day")
    assert (1, "a", 7.0) in {tuple(r) for r in P.published(spark, table).collect()}


def test_a_run_that_dies_before_the_swap_can_be_repeated(spark, table, monkeypatch):
    before = {tuple(r) for r in P.published(spark, table).collect()}
    more = batch(spark, [(8, "b", 8.0)])

    def dies(*_):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(P, "_swap", dies)
    with pytest.raises(RuntimeError):
        P.publish(more, table, "late", ["symbol"], "day")
    assert {tuple(r) for r in P.published(spark, table).collect()} == before
    monkeypatch.undo()
    P.publish(more, table, "late", ["symbol"], "day")
    assert {tuple(r) for r in P.published(spark, table).collect()} == {x for x in before if x[1] != "b"} | {(8, "b", 8.0)}


def test_the_same_batch_twice_is_once(spark, table):
    known = P.versions(spark, table)
    P.publish(batch(spark, [(4, None, 9.0), (2, "a", 2.0), (3, "b", 3.0), (1, "a", 1.0)]), table, "one", ["symbol"], "day")
    assert P.versions(spark, table) == known
    with pytest.raises(ValueError, match="other rows"):
        P.publish(batch(spark, [(1, "a", 2.0)]), table, "one", ["symbol"], "day")
    P.publish(batch(spark, []), table, "empty", ["symbol"], "day")
    assert P.published(spark, table).count() == 4


def test_a_taken_number_is_not_overwritten(spark, table, monkeypatch):
    """Another writer takes the next number between the look and the swap."""
    swap, other = P._swap, []

    def late(session, waiting, version):
        if not other:
            other.append(1)
            monkeypatch.setattr(P, "_swap", swap)
            P.publish(batch(spark, [(7, "z", 7.0)]), table, "other", ["symbol"], "day")
        return swap(session, waiting, version)

    monkeypatch.setattr(P, "_swap", late)
    P.publish(batch(spark, [(6, "y", 6.0)]), table, "mine", ["symbol"], "day")
    assert {(7, "z", 7.0), (6, "y", 6.0), (1, "a", 1.0)} <= {tuple(r) for r in P.published(spark, table).collect()}


def test_lost_files_are_found(spark, table):
    shutil.rmtree(next(Path(table, "batches", "one").glob("_part=b")))
    assert [(r["part"], r["n_rows"], r["n_found"]) for r in P.lost_parts(spark, table).collect()] == [("b", 1, 0)]


def test_nothing_published(spark, tmp_path):
    assert P.manifest(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        P.published(spark, str(tmp_path))


def test_projection_keeps_the_last_of_a_key(spark):
    from pyspark.sql import functions as F

    rows = [("1", "x", "1.5万", "3", 1), ("1", "y", "--", None, 2), (None, "z", "7", "q", 3)]
    df = spark.createDataFrame(rows, "code string, name string, price string, days string, seq int")
    got = projected(df, {"code": "stock_code", "name": "stock_name", "price": "close_price", "days": "up_days", "absent": "x"}, ("close_price",), ("up_days",), "stock_code", F.col("seq"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("1", "y", 0.0, 0), (None, "z", 7.0, 0)], key=str)
