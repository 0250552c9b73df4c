"""Plans and sizes that tell what a job costs as its tables grow; results on odd rows stay those of a plain statement."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corelake.functions import distance, near
from corelake.operators import assign, bicriteria, sensitivity
from corelake.plans import queries
from corelake.plans.cluster import ClusterModel
from corelake.sources.scratch import written


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_stay_where_they_are_for_their_distribution(spark):
    rows = [(k, k % 7, float(k % 5), 1.0 + k % 3) for k in range(400)] + [(400, None, None, 1.0), (7, 0, 2.0, 1.0), (7, 0, 2.0, 1.0), (401, 9, 3.0, 0.0)]
    assigned = written(spark.createDataFrame(rows, "id long, rank long, dist double, w double"), "assigned")
    p = sensitivity.sampling_distribution(assigned)
    assert "hashpartitioning(rank" not in plan(p)
    # the facility of no weight has no p, rows of one id are rows of their own
    found = p.groupBy("id").count()
    assert p.count() == 402 and found.where("count = 3").first()["id"] == 7 and p.where("rank = 9 or rank is null").count() == 0
    assert abs(p.agg(F.sum("p")).first()[0] - 1) < 1e-12


def test_the_check_of_medoids_meets_no_rows_by_a_join(spark):
    """Points of one id, null vectors and null ids count as in a join of both tables by id, which grows with the square of an id's rows."""
    rows = [(k % 45, [float(k % 11), float(k % 3)], 1.0) for k in range(60)] + [(0, [50.0, 1.0], 1.0)] * 3
    points = spark.createDataFrame(rows, "id long, v array<double>, w double")
    model = ClusterModel(3, shards=1)
    medoids = model.fit(points)
    centres = medoids.select(F.col("cluster").alias("rank"), "center_id", "center")
    odd = points.unionByName(spark.createDataFrame([(100, None, 1.0), (None, [1.0, 1.0], 1.0), (None, None, 1.0), (101, [float("inf"), 0.0], 1.0)], points.schema))
    for own in (points, odd, points.dropDuplicates(["id"]), odd.where("id >= 100 and v is null"), points.where("id < 0")):
        check = assign.nearest(own.select("id", "v"), centres, native=True).select("id", F.col("dist").alias("least"))
        joined = model.transform(own, medoids).join(check, "id")
        want = joined.agg(F.count("*").alias("points"), F.count_distinct("id").alias("ids"), F.bool_and(F.abs(F.col("dist") - F.col("least")) <= 1e-9).alias("nearest"))
        found = queries._nearest_medoids(own, Fitted(model, medoids))
        assert found.collect() == want.collect() and found.schema == want.schema
        joins = [x for x in plan(found).split("\n") if "Join" in x]
        assert joins and not any("[id#" in x for x in joins)


class Fitted:
    """A model that has its medoids."""

    def __init__(self, model, medoids):
        self.fit, self.transform, self.distance = lambda _: medoids, model.transform, model.distance


def test_vectors_that_are_not_asked_for_stay_with_the_workers(spark, monkeypatch):
    rows = [(k, [float(k), 1.0], 1.0, "x") for k in range(50)] + [(50, None, 1.0, "y")]
    points = spark.createDataFrame(rows, "id long, v array<double>, w double, rank string")
    centres = points.where("id % 7 = 3").select(F.col("id").alias("rank"), F.col("id").alias("center_id"), F.col("v").alias("center"))
    for most in (assign.MOST_VALUES, 6):  # at once, in blocks
        monkeypatch.setattr(assign, "MOST_VALUES", most)
        for native in (False, True):
            whole = assign.nearest(points, centres, native=native)
            found = assign.nearest(points, centres, native=native, vectors=False)
            assert found.columns == ["id", "w", "rank", "dist"] and sorted(found.collect(), key=str) == sorted(whole.drop("v").collect(), key=str)
    medoids = centres.withColumnRenamed("rank", "cluster")
    got = ClusterModel(2).transform(points.select("v", "id"), medoids)
    assert got.columns == ["v", "id", "cluster", "center_id", "dist"] and got.where("v is null").first()["cluster"] is None
    assert ClusterModel(2).transform(points.select("v"), medoids).columns == ["v", "cluster", "center_id", "dist"]
    assert "(v, v#" not in got._jdf.queryExecution().optimizedPlan().toString()  # once, not also among the other columns


def test_components_of_a_block_are_met_together():
    rng = np.random.default_rng(1)
    for width in range(9):
        x, y = rng.normal(size=(300, width)), rng.normal(size=(70, width))
        x[5:6, :1], calls = np.nan, []
        found = distance._blocked(x, y, lambda d: (d * d).sum(-1), lambda d, out: calls.append(1) or np.square(d, out=out))
        assert np.array_equal(found, ((x[:, None] - y[None]) ** 2).sum(-1), equal_nan=True)
        assert len(calls) == (-(-300 // (distance._CACHED // width // 70)) if 0 < width < 8 else 0)


@pytest.mark.parametrize("name", ["l1", "l2"])
def test_facilities_that_open_at_once_change_no_sums(name):
    """Weights and costs to the last digit as of points that are judged one by one, also where hardly any joins, of no weight, and beyond NaN."""
    rng = np.random.default_rng(2)
    d = distance.get(name)
    for holes in (False, True):
        x, w, ids = rng.normal(size=(900, 3)), rng.choice([0.0, 0.5, 2.0], 900), np.arange(900)
        x[[40, 500], 1] = np.nan if holes else 0.0
        made = []
        for step in (1, 64, 1024):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(bicriteria, "STEP", step)
                state = bicriteria.State(4, 900, 2.0, 2.0, d)
                state.process(ids, x, w)
                made.append((str(state.facilities()), state.phase, str(state.total_cost), state.weight, state.inserted, {type(v) for v in state.weights + state.costs}))
        assert made[0] == made[1] == made[2] and made[0][-1] == {float}


def test_reduced_sets_go_to_the_workers_as_they_are(spark):
    """Groups travel as Arrow tables; null ids and components, repeated ids and empty vectors are kept, what has no vector raises."""
    rng = np.random.default_rng(3)
    rows = [(k * 7919, 1.0 + k % 3, [float(a) for a in rng.normal(size=2)]) for k in range(300)]
    schema = "id long, weight double, v array<double>"

    def reduced(own):
        return sensitivity.reduced(spark.createDataFrame(own, schema), 20, 3).collect()

    found = reduced([(3, 1.0, [0.5, 0.5])] + [(None, 1.0, [0.5, 0.5])] * 50)
    assert {r.id for r in found} >= {None} and abs(sum(r.weight for r in found) - 51) < 1e-9
    assert {tuple(r.v) for r in reduced([(k, 1.0, [None, 0.5]) for k in range(60)])} == {(None, 0.5)}
    assert len(reduced([(1, 1.0, v) for _, _, v in rows])) > 1 and {tuple(r.v) for r in reduced([(k, 1.0, []) for k in range(100)])} == {()}
    assert all((r.id, tuple(r.v)) in {(i, tuple(v)) for i, _, v in rows} for r in reduced(rows + rows))
    for own in ((5, None, [0.5, 0.5]), (5, 1.0, None), (5, 1.0, [1.0])):
        with pytest.raises(Exception, match="weights are finite and not negative|are null or differ in length"):
            reduced([*rows, own])
    sent = []
    with pytest.MonkeyPatch.context() as m:
        real = sensitivity._reducing
        m.setattr(sensitivity, "_reducing", lambda *a: sent.append(real(*a)) or sent[-1])
        reduced(rows)
    table = pa.table({"id": [3, 4], "weight": [1.0, 1.0], "v": [[0.0, 1.0], [2.0, 3.0]]})
    assert sent and isinstance(sent[0](table), pa.Table)


def test_only_the_lines_that_were_drawn_are_joined(spark):
    found = queries.queries()["reduced_lines"](spark, "/root/testdata/sf0.001")
    text = plan(found)
    assert "LeftSemi" in text and "Exchange hashpartitioning(id" not in text.split("LeftSemi")[1]
    assert found.collect() == [(6000.0, True, True)]


def test_centres_are_prepared_once_and_few_points_try_the_pivots(spark, monkeypatch):
    """However many blocks a batch's pairs fill, the centres are made ready for rough distances once."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(500, 16)), rng.normal(size=(300, 16))
    y[200:] = y[:100]
    for name in ("l1", "l2"):
        d, made = distance.get(name), []
        monkeypatch.setattr(near, "PAIRS", 2000)
        place, least = near.nearest(replace(d, rough=lambda y, d=d, made=made: made.append(len(y)) or d.rough(y)), x, y)
        assert made == [300]
        full = d.block(x, y)
        assert (place == full.argmin(1)).all() and (least == full.min(1)).all()
        for scale in (1e-6, 1.0, 1e6):  # rough distances are as near as they say
            found, off = d.rough(y * scale + scale)(x * scale)
            assert (np.abs(found - d.block(x * scale, y * scale + scale) ** d.power) <= off[:, None]).all()
    pivots = assign.Pivots(distance.get("l2"), y)
    assert pivots.met == 0 and np.isclose(pivots.radius.max(), distance.get("l2").block(y, pivots.pivots).min(1).max(), rtol=0, atol=0)
    assert assign.TRIED * 300 < 500 * 300 * assign.MET * 2


def test_centres_are_collected_without_a_shuffle(spark):
    centres = spark.createDataFrame([(k, k, [float(k)]) for k in (5, 3, 9, 1)], "rank long, center_id long, center array<double>").repartition(3)
    asked = []

    class Watched:
        def select(self, *names):
            asked.append(centres.select(*names))
            return asked[-1]

    ranks, vectors = assign._collected(Watched())
    assert ranks.tolist() == [1, 3, 5, 9] and vectors[:, 0].tolist() == [1.0, 3.0, 5.0, 9.0] and vectors.dtype == float
    assert "Sort" not in plan(asked[0])


def test_draws_send_no_more_than_ids_and_chances(spark, monkeypatch):
    """Neither draws nor shares travel with the rows; shares are those that the leaves' sums are made of, and null ids stay."""
    monkeypatch.setattr(sensitivity, "BUCKET", 50)
    p = np.r_[10.0 ** np.random.default_rng(5).uniform(-25, 0, 300), (np.arange(200) % 7 + 0.5) * 2.0**-52]
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(p)] + [(None, 0.3), (None, 0.3), (1000, None), (1001, 0.0)], "id long, p double")
    found = sensitivity.split_draws(df, 900, 5)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and "share" not in text
    rows = found.collect()
    assert sum(r.n for r in rows) == 900 and sum(r.id is None for r in rows) == 2 and not {r.id for r in rows} & {1000, 1001}
    sums = []
    monkeypatch.setattr(sensitivity, "_split", lambda shares, *a: sums.append(shares.copy()) or np.zeros(len(shares), np.int64))
    assert sensitivity.split_draws(df, 900, 5).count() == 0  # leaves without draws have no rows
    whole = np.maximum(1.0, np.floor(np.r_[p, 0.3, 0.3] * 2.0**52 + 0.5))
    assert sums[0].sum() == whole.sum()
