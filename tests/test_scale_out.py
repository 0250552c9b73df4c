"""Draws by halves, sketches, and nearest of many centres: against plain statements, for any layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelake.functions import distance as dist
from corelake.operators import assign, scale, sensitivity


def test_draws_by_halves(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.1, 1, 200)
    p[7] = 40
    p[11] = 0
    p /= p.sum()
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(p)], "id long, p double")
    found = {}
    for bucket in (20_000, 16):
        monkeypatch.setattr(sensitivity, "BUCKET", bucket)
        rows = sensitivity.split_draws(df, 40_000, 5).collect()
        n = np.zeros(200)
        for r in rows:
            n[r.id] = r.n
            assert abs(r.weight - r.n / (p[r.id] * 40_000)) < 1e-9
        assert n.sum() == 40_000 and n[11] == 0
        own = p > 0
        chi = ((n[own] - 40_000 * p[own]) ** 2 / (40_000 * p[own])).sum()
        assert chi < 199 + 5 * np.sqrt(2 * 199)
        assert sorted(map(tuple, sensitivity.split_draws(df.repartition(7, "p"), 40_000, 5).collect())) == sorted(map(tuple, rows))
        found[bucket] = n
    assert sensitivity.split_draws(df, 0).count() == 0 and sensitivity.split_draws(df.where("id < 0"), 9).count() == 0
    # few draws fall by the shares on average
    sums = sum(np.array([r.n if r.id == 7 else 0 for r in sensitivity.split_draws(df, 50, s).collect()]).sum() for s in range(12))
    assert abs(sums / 600 - p[7]) < 0.1


@pytest.mark.parametrize("values", [np.random.default_rng(1).exponential(size=20_000), np.r_[np.zeros(15_000), np.arange(5000.0)], np.full(9000, 3.5)])
def test_sketches(spark, values):
    """Ranks are within the bound, whatever the values, and merging parts keeps it; small groups are exact."""
    df = spark.createDataFrame([(k % 7, k % 2, float(x)) for k, x in enumerate(values)], "part int, kind int, x double").repartition(5)
    at = (0.01, 0.25, 0.5, 0.99)
    merged = scale.merged_sketches(scale.sketches(df, "x", "kind", "part"), "kind")
    for r in scale.sketch_quantiles(merged, at).collect():
        own = np.sort(values[r.kind :: 2])
        low, high = np.searchsorted(own, r.value, "left") / len(own), np.searchsorted(own, r.value, "right") / len(own)
        assert low - 0.02 <= r.q <= high + 0.02
    assert merged.agg(F.sum("n")).first()[0] == len(values)
    few = spark.createDataFrame([(0, float(k)) for k in range(100)] + [(1, None)], "kind int, x double")
    assert [(r.kind, r.q, r.value) for r in scale.sketch_quantiles(scale.sketches(few, "x", "kind"), (0.25, 1.0)).orderBy("q").collect()] == [(0, 0.25, 24.0), (0, 1.0, 99.0)]


@pytest.mark.parametrize("name", ["l1", "l2", "hamming"])
def test_pivots_equal_the_full_scan(name):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3000, 3)) if name != "hamming" else rng.integers(0, 4, (3000, 3)).astype(float)
    centres[100] = centres[2000]
    x = np.concatenate([rng.normal(size=(500, 3)), centres[[100, 2000, 5]], np.full((1, 3), np.nan)])
    x = np.round(x) if name == "hamming" else x
    d = dist.get(name)
    index = assign.Pivots(d, centres)
    place, least = index.nearest(x)
    full = d.block(x, centres)
    full = np.where(np.isnan(full), np.inf, full)
    np.testing.assert_array_equal(least, full.min(1))
    np.testing.assert_array_equal(place[np.isfinite(least)], full.argmin(1)[np.isfinite(least)])
    if name != "hamming":
        assert index.met < full.size / 2


def test_nearest_of_many_centres(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 2)))] + [(900, None), (901, [1.0]), (902, [float("nan"), 0.0])], "id long, v array<double>").repartition(3)
    centres = spark.createDataFrame([(k, k, v.tolist()) for k, v in enumerate(np.round(rng.normal(size=(1500, 2)), 1))], "rank long, center_id long, center array<double>")
    for name in ("l2", "cosine"):
        found = sorted(map(tuple, assign.nearest(points, centres, name).select("id", "rank", "dist").collect()))
        with monkeypatch.context() as m:
            m.setattr(assign, "MANY", 1 << 30)
            assert sorted(map(tuple, assign.nearest(points, centres, name).select("id", "rank", "dist").collect())) == found
        with monkeypatch.context() as m:
            m.setattr(assign, "MANY", 16)
            m.setattr(assign, "MOST_VALUES", 900)
            assert sorted(map(tuple, assign.nearest(points, centres, name).select("id", "rank", "dist").collect())) == found


def test_sets_whose_pairs_are_too_many(spark, monkeypatch):
    df = spark.createDataFrame([(k, k, [float(k)]) for k in range(20)], "rank long, center_id long, center array<double>")
    assert assign.cross_distances(df).count() == 5
    monkeypatch.setattr(assign, "MOST_PAIRED", 10)
    with pytest.raises(ValueError, match="pairs"):
        assign.cross_distances(df)
    with pytest.raises(ValueError, match="pairs"):
        sensitivity.pairwise(df.select(F.col("rank").alias("id"), F.col("center").alias("v")))


def test_neighbourhood_of_own_partners(spark):
    """Each point has partners of its own: with two distances only, the second nearest of ten is the smaller one."""
    rows = [(k, [float(k % 2 * 100 + k / 1000)]) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert scale.neighbourhood_size(df, 0.999) < 1
    assert scale.neighbourhood_size(df.repartition(7), 0.5) == scale.neighbourhood_size(df, 0.5)
    assert scale.neighbourhood_size(df.limit(2), 0.5) == 100.001
