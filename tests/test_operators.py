import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corelake.functions import distance as dist
from corelake.operators import assign, bicriteria, facility_location, kmedoids, quality, scale, sensitivity
from corelake.plans.cluster import ClusterModel
from corelake.sources import points as src


def frame(spark, rows, schema="id long, v array<double>, w double"):
    return spark.createDataFrame(rows, schema)


def line(spark, values, weight=1.0):
    return frame(spark, [(k, [float(x)], weight) for k, x in enumerate(values)])


def as_centres(df):
    return df.select(F.col("id").alias("rank"), F.col("id").alias("center_id"), F.col("v").alias("center"))


@pytest.mark.parametrize("name", ["l1", "l2", "cosine", "hamming"])
def test_distance_forms_agree(spark, name):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(6, 5)) * 2)
    x[0] = 0
    d = dist.get(name)
    df = frame(spark, [(k, v.tolist(), 1.0) for k, v in enumerate(x)])
    a, b = df.select(F.col("id").alias("i"), F.col("v").alias("a")), df.select(F.col("id").alias("j"), F.col("v").alias("b"))
    found = a.crossJoin(b).select("i", "j", d.expr(F.col("a"), F.col("b")).alias("d")).collect()
    block = d.block(x, x)
    assert all(abs(block[r.i, r.j] - r.d) < 1e-12 for r in found)
    assert all(block[k, k] < 1e-12 for k in range(6))


def test_user_distance(spark):
    most = dist.register(dist.Distance("most", lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), lambda x, y: np.abs(x[:, None] - y[None]).max(-1)))
    df = frame(spark, [(0, [0.0, 0.0], 1.0), (1, [3.0, 4.0], 1.0)])
    got = {r.id: r.dist for r in assign.nearest(df, as_centres(df.where("id = 0")), "most").collect()}
    assert got == {0: 0.0, 1: 4.0} and dist.get(most) is most
    with pytest.raises(ValueError, match="unknown distance"):
        dist.get("nope")


@pytest.mark.parametrize("native", [True, False])
def test_ties_go_to_the_lowest_rank(spark, native):
    df = line(spark, [0, 0, 1, 1, 5, 5, 10])
    found = {r.id: r["rank"] for r in assign.nearest(df, as_centres(df), native=native).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}
    empty = assign.dispatch(df, as_centres(df), native=native).where("weight = 0")
    assert {r["rank"] for r in empty.collect()} == {1, 3, 5}


def test_many_centres_in_blocks(spark, monkeypatch):
    df = line(spark, range(40))
    whole = assign.nearest(df, as_centres(df.where("id % 3 = 0"))).collect()
    monkeypatch.setattr(assign, "MOST_VALUES", 4)
    assert sorted(assign.nearest(df, as_centres(df.where("id % 3 = 0"))).collect()) == sorted(whole)
    with pytest.raises(ValueError, match="no centres"):
        assign.nearest(df, as_centres(df.where("id < 0")))


@pytest.mark.parametrize("how", ["numpy", "native", "blocks"])
def test_points_without_a_distance(spark, monkeypatch, how):
    """Null, ragged and NaN vectors have no nearest centre and leave the others alone; rank and dist are replaced."""
    nan = float("nan")
    rows = [(0, [1.0, 2.0], 7, 8.0), (1, None, 7, 8.0), (2, [4.0, 6.0], 7, 8.0), (3, [1.0], 7, 8.0), (4, [nan, 1.0], 7, 8.0), (5, [1.0, None], 7, 8.0), (6, [], 7, 8.0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, rank int, dist double").repartition(9, "id")
    centres = spark.createDataFrame([(3, 30, [1.0, 2.0]), (5, 50, [9.0, 9.0]), (6, 60, [nan, nan])], "rank long, center_id long, center array<double>")
    if how == "blocks":
        monkeypatch.setattr(assign, "MOST_VALUES", 2)
    found = assign.nearest(df, centres, native=how == "native")
    assert found.columns == ["id", "v", "rank", "dist"]
    got = {r.id: (r["rank"], r.dist) for r in found.collect()}
    assert got == {0: (3, 0.0), 2: (3, 5.0)} | dict.fromkeys((1, 3, 4, 5, 6), (None, None))
    assert assign.nearest(df.where("id < 0"), centres, native=how == "native").count() == 0
    assert {r.id: r.matched for r in assign.within(df, centres, 1.0).collect()} == {0: True} | dict.fromkeys(range(1, 7), False)
    assert assign.dispatch(df.withColumn("w", F.lit(1.0)), centres).agg(F.sum("weight")).first()[0] == 2.0
    odd = centres.unionByName(spark.createDataFrame([(9, 9, [1.0])], centres.schema))
    with pytest.raises(ValueError, match="length"):
        assign.nearest(df, odd)


def test_operators_of_points_raise_for_null_vectors(spark):
    df = frame(spark, [(k, [float(k), 1.0], 1.0) for k in range(20)] + [(20, None, 1.0)]).coalesce(1)
    for run in (lambda: bicriteria.fit(df, 2, shards=1), lambda: facility_location.weighted_radii(df, 0.5), lambda: facility_location.choose(df.withColumn("r", F.lit(0.5)))):
        with pytest.raises(Exception, match="null or differ"):
            run().collect()


def test_facility_records(spark):
    df = line(spark, [0, 1, 5])
    more = assign.insert_facility(as_centres(df), 9, [7.0])
    assert [tuple(r) for r in assign.facility(more, 3).collect()] == [(3, 9, [7.0])]
    assert assign.facility(more, 4).count() == 0
    found = {r["rank"]: r["mean"] for r in assign.mean_costs(assign.dispatch(line(spark, [0, 2, 6]), more)).collect()}
    assert found == {0: 0.0, 1: 1.0, 2: 1.0, 3: None}


def test_validation(spark):
    good = line(spark, [1, 2])
    assert src.validate_points(good) is good
    for row, what in (((None, [1.0], 1.0), "null ids"), ((9, None, 1.0), "null or empty"), ((9, [float("nan")], 1.0), "finite"), ((9, [1.0], -1.0), "weights"), ((9, [1.0, 2.0], 1.0), "lengths")):
        with pytest.raises(ValueError, match=what):
            src.validate_points(good.unionByName(frame(spark, [row])))


def sequential(rows, k, beta, gamma):
    """The one-pass rule, stated plainly: lists, recursion, one distance at a time."""
    n = len(rows)
    k = bicriteria.clamped_k(k, n)
    bound, rate = int((gamma - 1) * (1 + int(math.log2(n))) * k), (1 + int(math.log2(n))) * k
    s = {"phase": 0, "li": 1.0, "most": gamma, "cost": 0.0, "f": []}

    def put(points):
        for i, x, w in points:
            if not s["f"]:
                s["f"].append([i, x, w])
                continue
            d, j = min((abs(x - f[1]), j) for j, f in enumerate(s["f"]))
            if bicriteria.chance(1454691, s["phase"], i) < w * d * rate / s["li"]:
                s["f"].append([i, x, w])
            else:
                s["f"][j][2] += w
                s["cost"] += w * d
            if s["cost"] > s["most"] or len(s["f"]) > bound:
                again = [tuple(f) for f in s["f"]]
                s.update(phase=s["phase"] + 1, li=s["li"] * beta, most=s["most"] * beta, cost=0.0, f=[])
                put(again)

    put(rows)
    return [(f[0], round(f[2], 9)) for f in s["f"]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=150), st.integers(1, 5), st.sampled_from([1, 7, 1024]))
def test_points_that_are_judged_together(values, k, step):
    """Whatever number of points is judged at once, the rule is the sequential one."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bicriteria, "STEP", step)
        state = bicriteria.State(k, len(values), 2.0, 2.0, dist.get("l1"))
        state.process(np.arange(len(values)), np.array(values)[:, None], np.ones(len(values)))
    assert [(i, round(w, 9)) for i, w in zip(state.ids, state.weights, strict=True)] == sequential([(i, x, 1.0) for i, x in enumerate(values)], k, 2.0, 2.0)
    assert bicriteria.chances(3, 2, np.array([-5, 7])).tolist() == [bicriteria.chance(3, 2, i) for i in (-5, 7)]


@pytest.mark.parametrize(("k", "beta", "gamma"), [(3, 2.0, 2.0), (1, 2.2, 3.0), (50, 1.5, 2.0)])
def test_one_shard_is_the_sequential_rule(spark, k, beta, gamma):
    rng = np.random.default_rng(k)
    rows = [(i, float(x), float(w)) for i, (x, w) in enumerate(zip(rng.normal(size=300) * 5, rng.uniform(0.5, 3, 300), strict=True))]
    found = bicriteria.fit(frame(spark, [(i, [x], w) for i, x, w in rows]), k, beta=beta, gamma=gamma, shards=1).orderBy("rank").collect()
    assert [(r.center_id, round(r.weight, 9)) for r in found] == sequential(rows, k, beta, gamma)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=80), st.integers(1, 5))
def test_state_keeps_weight_and_bound(values, k):
    state = bicriteria.State(k, len(values), 2.0, 2.0, dist.get("l1"))
    state.process(np.arange(len(values)), np.array(values)[:, None], np.ones(len(values)))
    assert math.isclose(sum(state.weights), len(values)) and len(state.ids) <= state.bound
    small = state.contracted()
    assert math.isclose(sum(small.weights), len(values)) and set(small.ids) <= set(state.ids)


def test_shards_not_layout_decide(spark):
    df = line(spark, np.random.default_rng(1).normal(size=200))
    a = bicriteria.fit(df.repartition(1), 4, shards=4).collect()
    b = bicriteria.fit(df.repartition(7), 4, shards=4).collect()
    assert a == b
    with pytest.raises(ValueError, match="gamma"):
        bicriteria.State(1, 10, 2.0, 1.0, dist.get("l2"))


def test_distribution_and_draws(spark):
    df = line(spark, np.random.default_rng(2).normal(size=120))
    assigned = assign.nearest(df, as_centres(df.where("id % 30 = 0"))).select("id", "w", "rank", "dist")
    p = sensitivity.sampling_distribution(assigned)
    assert abs(p.agg(F.sum("p")).first()[0] - 1) < 1e-9
    cdf = sensitivity.intervals(p).orderBy("id").toPandas()
    assert cdf.hi.iloc[-1] == 1.0 and np.allclose(cdf.hi[:-1], cdf.lo[1:]) and cdf.lo.iloc[0] == 0
    sums = [sensitivity.draw(p, 60, seed).agg(F.sum("weight"), F.sum("n")).first() for seed in range(12)]
    assert all(s[1] == 60 for s in sums) and abs(np.mean([s[0] for s in sums]) - 120) < 20
    assert sensitivity.draw(p, 0).count() == 0
    same_place = assigned.withColumn("dist", F.lit(0.0))
    assert abs(sensitivity.sampling_distribution(same_place).agg(F.sum("p")).first()[0] - 1) < 1e-9


@pytest.mark.parametrize("at_once", [1 << 20, 100])
def test_draws_find_their_interval(spark, monkeypatch, at_once):
    """Each draw belongs to the interval that holds it, however heavy an interval is and however ranges are cut."""
    monkeypatch.setattr(sensitivity, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    for heavy in (0, 25, 49):
        p = rng.uniform(0.001, 1, 50)
        p[heavy] = 60
        df = spark.createDataFrame([(k, float(x / p.sum())) for k, x in enumerate(p)], "id long, p double")
        cdf = sensitivity.intervals(df).orderBy("id").toPandas()
        u = sensitivity.uniforms(spark, 3000, 5).toPandas().u.to_numpy()
        want = np.bincount(np.searchsorted(cdf.lo.to_numpy(), u, "right") - 1, minlength=50)
        got = {r.id: r.n for r in sensitivity.draw(df, 3000, 5).collect()}
        assert got == {k: n for k, n in enumerate(want.tolist()) if n}


def test_seven_values(spark):
    values = [0.1, 0.2, 0.2, 0.1, 0.3, 0.05, 0.05]
    df = spark.createDataFrame(list(enumerate(values)), "id long, p double")
    n = {r.id: r.n for r in sensitivity.draw(df, 4000).collect()}
    assert all(abs(n[k] / 4000 - p) < 0.03 for k, p in enumerate(values))


def test_k_medoids_edges(spark):
    df = frame(spark, [(k, [float(x)], 1.0) for k, x in enumerate([0, 0, 1, 1, 5, 5, 10])]).withColumnRenamed("w", "weight")
    for k, most in ((1, 1), (3, 3), (20, 4)):
        found = kmedoids.fit(df, k).collect()
        assert 1 <= len(found) <= most
    equal = frame(spark, [(k, [2.0], 1.0) for k in range(4)]).withColumnRenamed("w", "weight")
    assert [(r.center_id, r.cost) for r in kmedoids.fit(equal, 2).collect()] == [(0, 0.0)]
    with pytest.raises(ValueError, match="empty"):
        kmedoids.fit(df.where("id < 0"), 2)


def test_k_medoids_finds_clear_clusters():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (0, 10, 20)])
    d = dist.get("l2").block(x, x)
    centres, _, member, history = kmedoids.search(d, np.ones(90), 3, 25)
    cost = min(history)
    assert len(history) == 25
    assert sorted(np.bincount(member).tolist()) == [30, 30, 30] and sorted(centres // 30) == [0, 1, 2]
    assert cost <= d[:, [15, 45, 75]].min(1).sum() + 1e-9


@pytest.mark.parametrize("distance", ["l2", "cosine"])
def test_k_medoids_by_rounds_equals_one_task(spark, monkeypatch, distance):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(k % 3, 1.0, 3).tolist(), float(rng.uniform(0.5, 3))) for k in range(70)]
    df = frame(spark, rows).withColumnRenamed("w", "weight").repartition(3).persist()
    whole = kmedoids.fit(df, 4, 6, distance=distance).orderBy("cluster").collect()
    monkeypatch.setattr(kmedoids, "MOST_POINTS", 20)
    monkeypatch.setattr(kmedoids, "BLOCK", 30)
    found = kmedoids.fit(df, 4, 6, distance=distance).orderBy("cluster").collect()
    assert [(r.cluster, r.center_id, r.center, r.iterations) for r in found] == [(r.cluster, r.center_id, r.center, r.iterations) for r in whole]
    assert np.allclose([(r.cost, r.total_cost) for r in found], [(r.cost, r.total_cost) for r in whole])


def test_weighted_facilities(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(2, 1, 50).tolist(), float(rng.uniform(0.5, 3))) for k in range(11)]
    df = frame(spark, rows)
    found = facility_location.weighted_facilities(df, 1.0).collect()
    assert abs(sum(r.weight for r in found) - sum(r[2] for r in rows)) < 1e-9
    wide = facility_location.weighted_facilities(df, 1e6)
    assert wide.count() == 1
    assert abs(facility_location.weighted_facilities(df, 1.0, weighted=False).agg(F.sum("weight")).first()[0] - 11) < 1e-9


@pytest.mark.parametrize("alfa", [0.3, 1.0, 5.0])
def test_weighted_radii(spark, monkeypatch, alfa):
    """The worth of the ball of radius r is alfa times that of the nearest ones, also if the points come in blocks."""
    monkeypatch.setattr(facility_location, "SAMPLED", 13)
    monkeypatch.setattr(facility_location, "TOGETHER", 2)
    rng = np.random.default_rng(12)
    x, w = np.round(rng.normal(size=(60, 2)), 1), rng.uniform(0.5, 3, 60)
    df = frame(spark, [(k, v.tolist(), float(a)) for k, (v, a) in enumerate(zip(x, w, strict=True))])
    found = {r.id: r.r for r in facility_location.weighted_radii(df, alfa).collect()}
    d = dist.get("l2").block(x, x)
    worth = lambda k, r: (w * np.maximum(0, r - d[k])).sum()
    for k in range(60):
        target = alfa * worth(k, np.sort(d[k])[5])
        assert abs(worth(k, found[k]) - target) <= 1e-9 * max(1, target) and (target > 0 or found[k] == 0)


def test_shards_are_merged_in_groups(spark, monkeypatch):
    monkeypatch.setattr(bicriteria, "GROUP", 3)
    df = line(spark, np.random.default_rng(1).normal(size=600))
    found = bicriteria.fit(df, 4, shards=20).collect()
    assert abs(sum(r.weight for r in found) - 600) < 1e-9 and len(found) <= bicriteria.facility_bound(4, 600, 2.0)
    bounds = bicriteria.states(df, 4, shards=20).collect()
    assert len(bounds) == 20 and sum(r.weight for r in bounds) == 600 and all(r.total_cost <= r.most_cost and r.inserted >= r.weight for r in bounds)


def test_written_results(spark, tmp_path):
    df = line(spark, range(30))
    model = ClusterModel(3, fraction=0.5, shards=2)
    assigned = model.transform(df, model.fit(df))
    model.write(assigned, str(tmp_path / "c"))
    want = {(r.id, r.center_id) for r in assigned.collect()}
    assert {(int(r.id), int(r.center_id)) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == want
    found = bicriteria.fit(df, 3, shards=2)
    src.write_facilities(found, str(tmp_path / "f"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "f")).collect())) == sorted(map(tuple, found.collect()))


def test_radii_count_over_the_whole_sample(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(200, 2))
    df = frame(spark, [(k, v.tolist(), 1.0) for k, v in enumerate(x)])
    order = [r.id for r in df.orderBy(F.xxhash64(F.lit(123), F.col("id")), "id").collect()]
    monkeypatch.setattr(facility_location, "SAMPLED", 9)
    monkeypatch.setattr(facility_location, "TOGETHER", 2)
    found = {r.id: r.r for r in facility_location.estimated_radii(df, 4.0).collect()}
    d = dist.get("l2").block(x, x[order])
    for k in range(200):
        hits = [j for j in range(1, 8) if 1 + (d[k, : int(2 * (200 / 2**j) / 7)] <= 4.0 / 2**j).sum() >= 2**j]
        assert found[k] == 4.0 / 2 ** max(hits, default=0)
    assert len(set(found.values())) > 1


def test_places_of_repeated_ids(spark, monkeypatch):
    """Points that share an id are all met, wherever blocks and rounds are cut; columns of any name are carried."""
    rng = np.random.default_rng(14)
    x = np.round(rng.uniform(0, 10, (60, 2)), 1)
    same = frame(spark, [(1, v.tolist(), 1.0) for v in x]).coalesce(1)
    own = frame(spark, [(k, v.tolist(), 1.0) for k, v in enumerate(x)]).coalesce(1)
    r = same.withColumn("r", F.lit(0.6))
    found = {}
    for most in (4096, 8):
        monkeypatch.setattr(facility_location, "SETTLED", most)
        monkeypatch.setattr(facility_location, "SAMPLED", most)
        centres = sorted(tuple(c.center) for c in facility_location.choose(r).collect())
        assert len(centres) > 20
        radii = sorted((tuple(p.v), round(p.r, 9)) for p in facility_location.weighted_radii(same, 0.5).collect())
        levels = sorted((tuple(p.v), p.r) for p in facility_location.estimated_radii(same.withColumns({"_n": F.lit("x"), "n": F.lit(2), "r": F.lit(9.0)}), 4.0).collect())
        assert found.setdefault("all", (centres, radii, levels)) == (centres, radii, levels)
    assert found["all"][1] == sorted((tuple(p.v), round(p.r, 9)) for p in facility_location.weighted_radii(own, 0.5).collect())
    assert facility_location.estimated_radii(same.withColumns({"_n": F.lit("x"), "n": F.lit(2)}), 4.0).columns == ["id", "v", "w", "_n", "n", "r"]


def test_quantiles_by_ranges(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=300), np.zeros(200)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    at = (0.0, 0.013, 0.5, 0.77, 1.0)
    whole = sorted(map(tuple, scale.quantiles(df, "x", at).collect()))
    monkeypatch.setattr(scale, "IN_ONE_TASK", 10)
    parts = sorted(map(tuple, scale.quantiles(df, "x", at).collect()))
    assert np.allclose(whole, parts) and np.allclose([v for _, v in whole], np.quantile(x, at))


def test_recentring_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=2).tolist(), float(rng.uniform(0.5, 2)), k % 10 // 8) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>, weight double, cluster long")
    whole = sorted((r.cluster, r.center_id, round(r.cost, 9)) for r in kmedoids.recentred(df, "cosine").collect())
    monkeypatch.setattr(kmedoids, "PART", 7)
    assert sorted((r.cluster, r.center_id, round(r.cost, 9)) for r in kmedoids.recentred(df, "cosine").collect()) == whole


def test_component_types(spark):
    df = line(spark, [1, 255])
    assert src.validate_points(df, "u8") is df
    for values, kind in (([256], "u8"), ([0.5], "u16"), ([-1], "u32"), ([1e39], "f32")):
        with pytest.raises(ValueError, match=f"fit {kind}"):
            src.validate_points(line(spark, values), kind)
    with pytest.raises(ValueError, match="unknown type"):
        src.validate_points(df, "u7")


def test_scales(spark):
    df = line(spark, [0, 1])
    assert scale.hashed_pairs(df, 50).distinct().collect()[0].d == 1.0
    assert scale.hashed_pairs(df.where("id = 0"), 50).count() == 0
    assert scale.neighbourhood_size(line(spark, [3]), 0.9) == 0.0
    approx = {r.q: r.value for r in scale.quantiles(line(spark, range(101)).withColumn("x", F.col("v")[0]), "x", (0.5,), exact=False).collect()}
    assert approx == {0.5: 50.0}


def test_one_cluster_has_no_ratio(spark):
    rows = spark.createDataFrame([(k, 1) for k in range(5)], "id long, label int")
    r = quality.information(quality.contingency(rows, rows)).first()
    assert r.h1 == 0 and r.nmi_joint is None and r.nmi_sqrt is None and r.n == 5
    two = spark.createDataFrame([(k, k % 2) for k in range(6)], "id long, label int")
    assert abs(quality.information(quality.contingency(two, two)).first().nmi_sqrt - 1) < 1e-12


def test_idx_and_csv(spark, tmp_path):
    images = np.arange(2 * 28 * 28, dtype=np.uint32).astype(np.uint8).reshape(2, 28, 28)
    (tmp_path / "images").write_bytes(struct.pack(">4B3I", 0, 0, 8, 3, 2, 28, 28) + images.tobytes())
    (tmp_path / "labels").write_bytes(struct.pack(">4B1I", 0, 0, 8, 1, 2) + bytes([5, 8]))
    x, y = src.read_idx(spark, str(tmp_path / "images")), src.read_idx(spark, str(tmp_path / "labels"))
    rows = src.pair_labels(x, y).orderBy("id").collect()
    assert [r.label for r in rows] == [5, 8] and rows[1].v == images[1].ravel().tolist()
    both = src.append_points(x, x, 784.0).orderBy("id").collect()
    assert [r.id for r in both] == [0, 1, 2, 3] and both[3].v[5] == images[1].ravel()[5] / 784
    (tmp_path / "bad").write_bytes(b"\0\0\x08\x01\0\0\0\x09ab")
    with pytest.raises(Exception, match="length"):
        src.read_idx(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "p.csv").write_text("label,a,b\n3,1,2\n4,5,6\n")
    assert [(r.id, r.label, r.v) for r in src.read_labelled_csv(spark, str(tmp_path / "p.csv"), 2).orderBy("id").collect()] == [(0, 3, [1.0, 2.0]), (1, 4, [5.0, 6.0])]
    (tmp_path / "q.csv").write_text("label,a,b\n3,1\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        src.read_labelled_csv(spark, str(tmp_path / "q.csv"), 2).collect()


def test_idx_in_ranges(spark, tmp_path):
    """Many tasks read ranges of rows of several files; ids have no gaps; other types, widths and lengths raise."""
    rng = np.random.default_rng(1)
    x = rng.integers(-9, 9, (50, 3))
    folder = tmp_path / "many"
    folder.mkdir()
    for name, rows in (("b", x[20:]), ("a", x[:20]), ("c", x[:0])):
        (folder / name).write_bytes(struct.pack(">4B2I", 0, 0, 0x0C, 2, len(rows), 3) + rows.astype(">i4").tobytes())
    src.idx.register(spark)
    found = spark.read.format("idx").option("range_bytes", 84).load(str(folder))
    assert found.rdd.getNumPartitions() == 8
    assert [(r.id, r.v) for r in found.orderBy("id").collect()] == [(k, v) for k, v in enumerate(x.astype(float).tolist())]
    assert src.read_idx(spark, f"file://{folder}", "i32").count() == 50
    for kind, rows, what in (("u8", b"", "holds i32"), (None, struct.pack(">4B2I", 0, 0, 8, 2, 1, 2) + b"ab", "differ in length"), (None, b"\1\0\x08\x01", "not an IDX"), (None, b"\0\0\x08\x03\0", "doesn't fit")):
        if rows:
            (folder / "d").write_bytes(rows)
        with pytest.raises(Exception, match=what):
            src.read_idx(spark, str(folder), kind).collect()
    with pytest.raises(Exception, match="there is no"):
        src.read_idx(spark, str(tmp_path / "none")).collect()
    whole = spark.createDataFrame([(k, [float(k), 7.0]) for k in range(40)], "id long, v array<double>").repartitionByRange(3, "id")
    src.write_idx(whole, str(tmp_path / "out"))
    src.write_idx(whole.limit(0), str(tmp_path / "out"))
    assert [(r.id, r.v) for r in src.read_idx(spark, str(tmp_path / "out"), "u8").orderBy("id").collect()] == [(k, [float(k), 7.0]) for k in range(40)]
    with pytest.raises(Exception, match="don't fit"):
        src.write_idx(whole.withColumn("v", F.array(F.lit(0.5))), str(tmp_path / "bad"))


def test_command_line(spark, tmp_path):
    from corelake.cli import main

    rng = np.random.default_rng(0)
    spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(150)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "in"))
    base = ["--input", str(tmp_path / "in"), "--id", "vec_id", "--vector", "embedding"]
    main([*base, "--output", str(tmp_path / "s")], spark)
    main([*base, "--output", str(tmp_path / "c"), "-c", "4"], spark)
    assert 0 < spark.read.csv(str(tmp_path / "s"), header=True).count() <= int(0.11 * 150)
    assert spark.read.csv(str(tmp_path / "c"), header=True).select("id").distinct().count() == 150


def test_model_cost_is_near_the_best(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.3, (100, 3)) for c in (0, 4, 8, 12)])
    df = frame(spark, [(k, v.tolist(), 1.0) for k, v in enumerate(x)]).persist()
    model = ClusterModel(4, fraction=0.2, shards=2)
    cost = model.transform(df, model.fit(df)).agg(F.sum("dist")).first()[0]
    assert cost < 1.2 * dist.get("l2").block(x, x[[50, 150, 250, 350]]).min(1).sum()
