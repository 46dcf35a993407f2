"""Exact medians and exactly n rows, against sorting."""

from __future__ import annotations

import hashlib
import random
import statistics

import pytest

from presslens.operators import rank
from presslens.operators import stats as S


def _columns(rng, n):
    return [(float(rng.choice([1e-300, 1.0, 1e300]) * rng.lognormvariate(0, 30)), rng.randrange(3), rng.gauss(0, 1) if i % 3 else None,
             7, rng.randrange(10 ** 12)) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 20_000, 20_001])
def test_exact_medians(spark, n):
    rng = random.Random(n)
    rows = _columns(rng, n)
    df = spark.createDataFrame(rows, "a double, b int, c double, d long, e long").repartition(6)
    got = rank.exact_medians(df, ["a", "b", "c", "d", "e"])
    for i, c in enumerate("abcde"):
        own = [r[i] for r in rows if r[i] is not None]
        assert got[c] == (statistics.median(own) if own else None), c


def test_median_between_two_equal_halves(spark):
    df = spark.createDataFrame([(0 if i % 2 else 10 ** 6,) for i in range(30_000)], "x long")
    assert rank.exact_medians(df, ["x"]) == {"x": 500_000.0}
    assert rank.exact_medians(df.limit(0), ["x"]) == {"x": None}


def test_mean_median_row(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, None)], "x long, y double")
    assert S.mean_median(df, ["x", "y"]).first().asDict() == {"x_mean": 1.0, "x_median": 1.0, "y_mean": 0.0, "y_median": 0.0}
    assert S.mean_median(df, ["x", "y"], null_as=None).first().asDict() == {"x_mean": 1.5, "x_median": 1.5, "y_mean": None, "y_median": None}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 999, 65_000, 99_999, 100_000, 200_000])
def test_first_by_hash_are_the_rows_of_a_sort(spark, n):
    df = spark.range(100_000).withColumnRenamed("id", "k").repartition(8)
    got = S.sample_rows(df, "k", n, seed=3)
    order = sorted(range(100_000), key=lambda i: hashlib.md5(f"{i}:3".encode()).hexdigest())
    assert sorted(r["k"] for r in got.collect()) == sorted(order[:n])
    if 0 < n < 100_000:
        assert "TakeOrdered" not in _plan(got) and "Sort" not in _plan(got) and "Limit" not in _plan(got)


def test_a_key_of_a_third_of_the_rows(spark):
    """Rows of one key are told apart by their columns, equal rows are interchangeable."""
    rows = [(7, i % 50) for i in range(3000)] + [(i, 0) for i in range(100, 6100)]
    df = spark.createDataFrame(rows, "k long, v int").repartition(5)
    order = sorted({r[0] for r in rows}, key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
    before = order.index(7)
    got = S.sample_rows(df, "k", before + 1000)
    assert got.count() == before + 1000 and got.filter("k = 7").count() == 1000
    again = S.sample_rows(df.repartition(3), "k", before + 1000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    assert S.sample_rows(spark.createDataFrame([(None, 1)] * 10, "k long, v int"), "k", 4).count() == 4
