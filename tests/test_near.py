"""Rough distances, what is found by them, and vectors without structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelake.functions import distance as dist
from corelake.functions import near
from corelake.operators import assign, balls, facility_location


def unit(n, width=64, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


SETS = {"unit": lambda x: x, "far off": lambda x: 1e4 + x, "tiny": lambda x: x * 1e-30, "large": lambda x: x * 1e18, "whole": lambda x: np.round(x * 8)}


@pytest.mark.parametrize("name", ["l1", "l2"])
@pytest.mark.parametrize("kind", SETS)
def test_near_equals_a_full_scan(name, kind):
    d = dist.get(name)
    x, y = SETS[kind](unit(150)), SETS[kind](unit(400, seed=1))
    y[7], x[3] = y[9], y[9]  # ties
    full = d.block(x, y)
    place, best = near.nearest(d, x, y)
    assert (place == full.argmin(1)).all() and (best == full.min(1)).all()
    reach = float(np.quantile(full, 0.1))
    want = np.stack([(full[:, :size] <= r).sum(1) for size, r in ((400, reach), (90, full[0, 3]), (0, reach))], 1)
    assert (near.counts(d, x, y, [(400, reach), (90, full[0, 3]), (0, reach)]) == want).all()
    far, heavy = np.full((150, 5), np.inf), np.zeros((150, 5))
    weight = np.random.default_rng(2).integers(1, 4, 400).astype(float)
    for k in (0, 200):
        far, heavy = near.smallest(d, x, y[k : k + 200], far, heavy, weight[k : k + 200])
    order = np.stack([np.lexsort((weight, f))[:5] for f in full])
    assert (far == np.take_along_axis(full, order, 1)).all() and (heavy == weight[order]).all()


def test_few_pairs_are_met_exactly(monkeypatch):
    met = []
    exact = near._exact
    monkeypatch.setattr(near, "_exact", lambda d, x, y, row, at: met.append(len(row)) or exact(d, x, y, row, at))
    for name in ("l1", "l2"):
        near.nearest(dist.get(name), unit(200), unit(3000, seed=1))
    assert sum(met) < 2 * 200 * 2


def test_rows_that_are_not_finite():
    d, x, y = dist.get("l2"), unit(40), unit(300, seed=1)
    x[3, 5], x[4, 0], x[5] = np.nan, np.inf, 1e200
    with np.errstate(all="ignore"):
        place, best = near.nearest(d, x, y)
        full = d.block(x, y)
    assert np.isinf(best[[3, 4]]).all() and (place[6:] == full[6:].argmin(1)).all() and (best[6:] == full[6:].min(1)).all()


@pytest.mark.parametrize("name", ["l1", "l2", "cosine", "hamming"])
def test_all_distances_are_those_of_the_jvm(spark, monkeypatch, name):
    rows = [(k, v.tolist()) for k, v in enumerate(np.round(unit(30, 3) * 2, 1))]
    rows += [(30, None), (31, [1.0, 2.0]), (32, [1.0, None, 2.0]), (33, [float("nan"), 1.0, 2.0]), (34, [0.0, 0.0, 0.0]), (35, [])]
    rows = rows[:-1] if name == "hamming" else rows  # which divides by the length
    points = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    centres = points.where("id < 7 or id = 34").select(F.col("id").cast("int").alias("rank"), F.col("v").alias("center"))
    d = dist.get(name)
    want = points.crossJoin(centres).select("id", "rank", d.expr(F.col("v"), F.col("center")).alias("d")).orderBy("id", "rank").collect()
    monkeypatch.setattr(assign, "TOGETHER", 20)
    got = assign.distances(points, centres, name)
    assert got.dtypes == [("id", "bigint"), ("rank", "int"), ("d", "double")]
    for a, b in zip(got.orderBy("id", "rank").collect(), want, strict=True):
        assert a[:2] == b[:2] and (a.d is None) == (b.d is None)
        assert a.d is None or (np.isnan(a.d) and np.isnan(b.d)) or abs(a.d - b.d) < 1e-12
    cut = {(r.id, r["rank"]): r.d for r in assign.distances(points.where("id < 20"), centres, name, 3).collect()}
    assert all(abs(cut[r.id, r["rank"]] - r.d) <= 0.0005 + 1e-12 for r in want if r.id < 20)


def test_many_centres_leave_the_jvm(spark, monkeypatch):
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(unit(60))], "id long, v array<double>")
    centres = points.where("id < 20").select(F.col("id").alias("rank"), F.col("id").alias("center_id"), F.col("v").alias("center"))
    want = [(r.id, r["rank"]) for r in assign.nearest(points, centres, native=True).orderBy("id").collect()]
    monkeypatch.setattr(assign, "NATIVE", 1000)
    found = assign.nearest(points, centres, native=True)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert [(r.id, r["rank"]) for r in found.orderBy("id").collect()] == want


def test_the_index_serves_structured_points_only(spark, monkeypatch):
    monkeypatch.setattr(balls, "CELL", 64)
    for x, reach, serves in ((unit(3000), 1.0, False), (unit(3000) * np.r_[1.0, 1.0, np.zeros(62)], 0.0002, True)):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "no long, v array<double>")
        assert balls.BallIndex(df, "l2").serves(df.withColumn("reach", F.lit(reach))) == serves


def test_large_sets_without_structure(spark, monkeypatch):
    """Radii and choice by blocks are those of one task; no pair travels."""
    points = spark.createDataFrame([(k, v.tolist(), 1.0 + k % 3) for k, v in enumerate(unit(400, 16))], "id long, v array<double>, w double")
    radii = lambda: sorted((r.id, round(r.r, 9)) for r in facility_location.estimated_radii(points, 1.2).collect())
    heavy = lambda: sorted((r.id, round(r.r, 9)) for r in facility_location.weighted_radii(points, 0.5).collect())
    chosen = lambda: sorted((r["rank"], r.center_id) for r in facility_location.choose(facility_location.estimated_radii(points, 1.2)).collect())
    want = radii(), heavy(), chosen()
    monkeypatch.setattr(balls, "CELL", 32)
    monkeypatch.setattr(facility_location, "SAMPLED", 20)
    monkeypatch.setattr(facility_location, "SETTLED", 90)
    monkeypatch.setattr(balls.BallIndex, "ask", None)  # would send each point to nearly all chunks
    assert (radii(), heavy(), chosen()) == want


def test_facilities_apart(spark, monkeypatch):
    monkeypatch.setattr(facility_location, "SAMPLED", 3)
    rows = [(0, [0.0, 0.0], 1.0), (1, [2.0, 0.0], 0.5), (2, [9.0, 0.0], 1.0), (3, [12.0, 0.0], 1.0), (4, [0.0, 9.0], 4.0), (5, [0.0, -9.0], 4.0), (6, [30.0, 0.0], 0.0)]
    found = facility_location.apart(spark.createDataFrame(rows, "rank long, v array<double>, r double"))
    want = {i: all(i == j or np.hypot(a[0] - b[0], a[1] - b[1]) > 2 * max(r, s) for j, b, s in rows) for i, a, r in rows}
    assert {r["rank"]: r.apart for r in found.collect()} == want and set(want.values()) == {True, False}
