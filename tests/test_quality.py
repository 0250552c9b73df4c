"""Adjusted agreement against the mean over all permutations."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from corelake.operators import quality


def information(a, b):
    n, c1, c2 = len(a), Counter(a), Counter(b)
    return sum(k / n * math.log(n * k / (c1[x] * c2[y])) for (x, y), k in Counter(zip(a, b, strict=True)).items())


@pytest.mark.parametrize(("a", "b"), [("aabbbc", "xyxyxx"), ("aaabbbb", "xxxxxyz"), ("abcdef", "xxyyzz"), ("aaaa", "xxyy"), ("aabb", "aabb")])
def test_expected_information_is_the_mean_over_permutations(spark, a, b):
    mean = np.mean([information(a, p) for p in itertools.permutations(b)])
    frames = [spark.createDataFrame(list(enumerate(x)), "id long, label string") for x in (a, b)]
    r = quality.adjusted_information(quality.contingency(*frames)).first()
    assert abs(r.e_exact - mean) < 1e-12
    top = max(r.h1, r.h2) - mean
    assert r.ami_max is None if top < 1e-12 else abs(r.ami_max - (information(a, b) - mean) / top) < 1e-9


def test_expected_information_of_large_and_empty_tables(spark):
    n, a, b = 3_000_000_000, 900_000_000, 1_200_000_000
    # near the limit the mean of 2 n I is the number of degrees of freedom
    whole = sum(quality.expected_term(n, x, y) for x in (a, n - a) for y in (b, n - b))
    assert abs(2 * n * whole - 1) < 1e-3
    empty = spark.createDataFrame([], "l1 string, l2 string, n long")
    assert quality.expected_information(empty).first().e_exact is None


def test_a_dense_table_of_many_columns(spark):
    """More labels than a pivot takes; rows of a null label, and labels without a count, are there."""
    from pyspark.sql import functions as F

    from corelake.operators import quality

    n = 12_000
    table = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("l1"), F.col("id").alias("l2"), (F.col("id") % 5 + 1).alias("n"))
    found = {r.l1: r for r in quality.dense_rows(table).collect()}
    assert set(found) == {None, 1, 2}
    for k, r in found.items():
        assert r.labels == list(range(n)) and r.counts == [j % 5 + 1 if j % 3 == (k or 0) else 0 for j in range(n)]
