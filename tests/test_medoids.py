"""Medoids by bounds, by swaps, and of reduced sets, against plain searches; columns and ids of any kind."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelake.functions import distance as dist
from corelake.operators import assign, kmedoids, medoids, sensitivity, swaps
from corelake.plans.cluster import ClusterModel

POINT = "id long, v array<double>, weight double, cluster long"


def clustered(spark, n, width, clusters=3, seed=1, whole=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) + rng.integers(0, 2, (n, 1))
    x = np.round(x * 2) if whole else x
    rows = [(k, x[k].tolist(), float(rng.uniform(0.5, 3)), int(rng.integers(0, clusters))) for k in range(n)]
    return rows, spark.createDataFrame(rows, POINT).repartition(3)


def plain_medoid(rows, cluster, name):
    own = [r for r in rows if r[3] == cluster]
    x, w = np.array([r[1] for r in own]), np.array([r[2] for r in own])
    cost = dist.get(name).block(x, x) @ w
    return min((round(float(c), 9), r[0]) for c, r in zip(cost, own, strict=True))


@pytest.mark.parametrize("name", ["l1", "l2", "hamming"])
def test_exact_medoids(spark, monkeypatch, name):
    monkeypatch.setattr(medoids, "PIVOTS", 16)
    monkeypatch.setattr(medoids, "FIRST", 4)
    rows, df = clustered(spark, 600, 3, whole=name == "hamming")
    for r in medoids.exact_medoids(df, name).collect():
        cost, best = plain_medoid(rows, r.cluster, name)
        assert (r.center_id, round(r.cost, 9)) == (best, cost) and r.center == rows[best][1]
        assert r.points == sum(x[3] == r.cluster for x in rows)


def test_exact_medoids_meet_few_candidates(spark):
    rng = np.random.default_rng(0)
    rows = [(k, v.tolist(), 1.0, 0) for k, v in enumerate(rng.normal(size=(6000, 2)))]
    df = spark.createDataFrame(rows, POINT)
    r = medoids.exact_medoids(df).first()
    assert (round(r.cost, 6), r.center_id) == (lambda c: (round(c[0], 6), c[1]))(plain_medoid(rows, 0, "l2"))
    assert r.computed < 6000 / 8


def test_exact_medoids_of_odd_rows(spark):
    same = [(5, [1.0, 2.0], 1.0, 7)] * 4 + [(3, [1.0, 2.0], 1.0, 7), (9, [4.0, 4.0], 0.0, 8), (1, [0.0, 0.0], 1.0, None)]
    df = spark.createDataFrame(same, POINT).withColumns({"low": F.lit(1), "no": F.lit("x"), "w": F.lit(9)})
    assert sorted((r.cluster, r.center_id, r.cost, r.points) for r in medoids.exact_medoids(df).collect()) == [(7, 3, 0.0, 5), (8, 9, 0.0, 1)]
    assert medoids.exact_medoids(df.where("id < 0")).count() == 0
    with pytest.raises(ValueError, match="triangle"):
        medoids.exact_medoids(df, "cosine")
    with pytest.raises(Exception, match="null or differ"):
        medoids.exact_medoids(df.unionByName(df.withColumn("v", F.lit(None).cast("array<double>")))).collect()


def swap_cost(d, w, chosen):
    return float((d[:, list(chosen)].min(1) * w).sum())


@pytest.mark.parametrize("k", [1, 2, 4])
def test_no_swap_improves(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        x, w = rng.normal(size=(25, 2)), rng.uniform(0.2, 3, 25)
        d = dist.get("l1").block(x, x)
        state = swaps.Swaps(d, w, rng.choice(25, k, replace=False))
        changes = {(i, c): swap_cost(d, w, [*np.delete(state.medoids, i), c]) - state.cost for i in range(k) for c in range(25)}
        for c in range(25):
            np.testing.assert_allclose(state.changes(c), [changes[i, c] for i in range(k)], atol=1e-9)
        state.search(50)
        cost = swap_cost(d, w, state.medoids)
        assert abs(cost - state.cost) < 1e-9
        assert all(swap_cost(d, w, [*np.delete(state.medoids, i), c]) > cost - 1e-9 for i in range(k) for c in range(25))
        if k == 1:
            assert abs(cost - min(swap_cost(d, w, [c]) for c in range(25))) < 1e-9
        if k == 2:
            best = min(swap_cost(d, w, pair) for pair in itertools.combinations(range(25), 2))
            assert cost <= 1.15 * best


def test_swaps_end_below_the_alternation(spark):
    rows, df = clustered(spark, 300, 4, seed=4)
    found = swaps.fit(df, 6).collect()
    alternation = kmedoids.fit(df, 6).first()["total_cost"]
    assert found[0].total_cost <= found[0].start + 1e-9 and found[0].start <= alternation + 1e-9
    x, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    cost = swap_cost(dist.get("l2").block(x, x), w, [r.center_id for r in found])
    assert abs(cost - found[0].total_cost) < 1e-6 and found[0].swaps > 0


def test_reduced_sets(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1, (1000, 2)) for c in (0, 8, 16)])
    rows = [(k, v.tolist(), float(rng.uniform(0.5, 2)), 0) for k, v in enumerate(x)]
    w = np.array([r[2] for r in rows])
    df = spark.createDataFrame(rows, POINT).repartition(5)
    centres = np.array([[0.0, 0], [8, 8], [16, 16], [3, 5]])
    exact = (w * dist.get("l2").block(x, centres).min(1)).sum()
    found = sensitivity.reduced(df, 300, 3).collect()
    assert len(found) <= 300 and abs(sum(r.weight for r in found) - w.sum()) < 1e-6
    assert all(r.v == rows[r.id][1] for r in found)
    cost = sum(r.weight * dist.get("l2").block(np.array([r.v]), centres).min() for r in found)
    assert abs(cost / exact - 1) < 0.2
    # layout doesn't matter; a set within the bound stays; repeated ids are points of their own
    assert sorted(map(tuple, sensitivity.reduced(df.repartition(2), 300, 3).collect())) == sorted(map(tuple, found))
    assert sensitivity.reduced(df, 3000, 3).count() == 3000
    again = sensitivity.reduced(df.withColumn("id", F.lit(1)), 100, 3)
    assert again.count() <= 100 and abs(again.agg(F.sum("weight")).first()[0] - w.sum()) < 1e-6
    # the medoids of a reduced set cost little more than those of the whole one
    whole = swaps.fit(df, 3)
    small = swaps.fit(sensitivity.reduced(df, 300, 3), 3)
    price = lambda f: (w * dist.get("l2").block(x, np.array([r.center for r in f.collect()])).min(1)).sum()
    assert price(small) < 1.1 * price(whole)


def test_a_flat_set_is_reduced(spark):
    df = spark.createDataFrame([(k, [1.0], 1.0, 0) for k in range(500)], POINT)
    found = sensitivity.reduced(df, 50, 3).collect()
    assert len(found) <= 50 and abs(sum(r.weight for r in found) - 500) < 1e-9


def test_a_bounded_search_is_near_the_whole_one(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.5, (300, 3)) for c in (0, 4, 8, 12)])
    df = spark.createDataFrame([(k, v.tolist(), 1.0) for k, v in enumerate(x)], "id long, v array<double>, w double").persist()
    cost = {}
    for most in (100, None):
        model = ClusterModel(4, fraction=0.4, shards=2, searched=most)
        cost[most] = model.transform(df, model.fit(df)).agg(F.sum("dist")).first()[0]
    assert cost[100] < 1.15 * cost[None]


NAMES = ("rank", "dist", "center_id", "p", "matched")


def test_columns_of_any_name(spark):
    """Labels and other columns may have the names of results: they are labels still, or carried, or replaced where said."""
    df = spark.createDataFrame([(k, [float(k % 7)], 1.0, k % 2) for k in range(40)], "id long, v array<double>, w double, x long")
    centres = spark.createDataFrame([(0, 10, [1.0]), (1, 11, [5.0])], "rank long, center_id long, center array<double>")
    plain = df.withColumn("own", F.col("x"))
    want = sorted(map(tuple, assign.label_histogram(plain, centres, "own").collect()))
    assert len(want) == 4
    sums = sorted(map(tuple, assign.dispatch_labels(plain, centres, "own").collect()))
    for name in NAMES:
        other = df.withColumnRenamed("x", name)
        assert sorted(map(tuple, assign.label_histogram(other, centres, name).collect())) == want
        assert sorted(map(tuple, assign.dispatch_labels(other, centres, name).collect())) == sums
        found = assign.within(other, centres, 1.0)
        assert found.columns == [c for c in ("id", "v", "w", name) if c != "matched"] + ["matched"] and found.where("matched").count() > 0
        model = ClusterModel(2)
        made = centres.withColumnRenamed("rank", "cluster")
        got = model.transform(other, made)
        assert len(set(got.columns)) == len(got.columns) and got.where("dist <= 4").count() == 40
        summary = other.withColumnRenamed("w", "weight")
        assert kmedoids.membership(summary, made).select("cluster", "dist").count() == 40


def test_null_ranks_take_no_part(spark):
    rows = [(k, k % 3, 1.0, 1.0) for k in range(9)] + [(9, None, None, 1.0)]
    p = sensitivity.sampling_distribution(spark.createDataFrame(rows, "id long, rank long, dist double, w double"))
    assert p.count() == 9 and abs(p.agg(F.sum("p")).first()[0] - 1) < 1e-12


def test_repeated_ids_in_rounds(spark, monkeypatch):
    rows = [(4, [float(k % 5)], 1.0) for k in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<double>, weight double").repartition(3)
    for name in ("l2", "cosine"):
        moved = df.withColumn("v", F.array(F.col("v")[0] + 1, F.lit(1.0)))
        whole = kmedoids.fit(moved, 2, 4, distance=name).orderBy("cost").collect()
        with monkeypatch.context() as m:
            m.setattr(kmedoids, "MOST_POINTS", 5)
            m.setattr(kmedoids, "BLOCK", 7)
            found = kmedoids.fit(moved, 2, 4, distance=name).orderBy("cost").collect()
        np.testing.assert_allclose([r.total_cost for r in found], [r.total_cost for r in whole])


@pytest.mark.parametrize("name", ["l1", "l2"])
def test_means_of_groups_leave_few_candidates(spark, name):
    """Of lines of orders hardly any candidate meets all members, and none that could be the best is lost."""
    from corelake.plans.queries import line_points

    lines = line_points(spark, "/root/testdata/sf0.001").withColumn("cluster", F.pmod("id", F.lit(2))).withColumnRenamed("w", "weight")
    rows = lines.select("cluster", "v", "weight").toPandas()
    for r in medoids.exact_medoids(lines, name).collect():
        own = rows[rows.cluster == r.cluster]
        x = np.array(own.v.tolist())
        cost = dist.get(name).block(x, x) @ own.weight.to_numpy()
        assert abs(r.cost - cost.min()) < 1e-6 and r.computed <= len(own) // 20
