"""Ball counts and choices by ranges of pivot distances, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelake.functions import distance as dist
from corelake.operators import balls, facility_location


def table(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "no long, v array<double>").repartition(3)


@pytest.mark.parametrize("name", ["l1", "l2", "hamming", "cosine"])
def test_balls_equal_a_full_scan(spark, monkeypatch, name):
    monkeypatch.setattr(balls, "CELL", 40)
    monkeypatch.setattr(balls, "CHUNK", 30)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 3)), np.zeros((100, 3)), rng.normal(size=(200, 3)) + 6])
    x = np.round(x) if name == "hamming" else x
    reach = rng.uniform(0, {"hamming": 1, "cosine": 1.5}.get(name, 3), 600)
    reach[:20] = 40
    reach[20:40] = -1
    far = dist.get(name).block(x, x)
    df = table(spark, x)
    asks = df.join(spark.createDataFrame(list(enumerate(reach.tolist())), "no long, reach double"), "no")
    index = balls.BallIndex(df, name)
    count = {r.no: (r.n, r.met) for r in index.ask(asks, "count").collect() if r.n}
    assert {k: n for k, (n, _) in count.items()} == {k: n for k, n in enumerate((far <= reach[:, None]).sum(1).tolist()) if n}
    least = {r.no: r.least for r in index.ask(asks, "least").collect()}
    assert least == {k: int(np.flatnonzero(row)[0]) for k, row in enumerate(far <= reach[:, None]) if row.any()}
    # whole rings take no distances; angles are told apart less sharply
    assert all(count[k][0] == 600 and (count[k][1] == 0 or name == "cosine") for k in range(20))
    index.drop()
    with pytest.raises(ValueError, match="triangle"):
        balls.BallIndex(df, dist.Distance("plain", dist.L2.expr, dist.L2.block))
    assert balls.BallIndex(df.where("no < 0"), name).ask(asks, "count").count() == 0


@pytest.mark.parametrize(("name", "k"), [("l1", 1), ("l2", 7), ("hamming", 7), ("cosine", 7), ("l2", 900), ("cosine", 900)])
def test_nearest_targets(spark, monkeypatch, name, k):
    monkeypatch.setattr(balls, "CELL", 60)
    monkeypatch.setattr(balls, "CHUNK", 25)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 3)), np.ones((90, 3)), np.zeros((10, 3))])
    x = np.round(x) if name == "hamming" else x
    w = rng.integers(1, 5, 300).astype(float)
    far = dist.get(name).block(x, x)
    df = spark.createDataFrame([(i, v.tolist(), h) for i, (v, h) in enumerate(zip(x, w.tolist(), strict=True))], "no long, v array<double>, w double").repartition(3)
    index = balls.BallIndex(df, name)
    found = {r.no: r for r in index.nearest(df.select("no", "v"), k).collect()}
    assert len(found) == 300
    for i in range(300):
        assert np.allclose(found[i].far, np.sort(far[i])[:k], atol=1e-12) and len(found[i].w) == min(k, 300)
        last = found[i].far[-1] - 1e-9
        assert sum(h for f, h in zip(found[i].far, found[i].w, strict=True) if f < last) == w[far[i] < last].sum()
    index.drop()


@pytest.mark.parametrize(("name", "alfa"), [("l1", 1.0), ("l2", 0.5), ("l2", 3.0), ("hamming", 1.0), ("cosine", 0.5), ("cosine", 3.0)])
def test_weighted_radii_by_the_index(spark, monkeypatch, name, alfa):
    """The same radii as when all points meet, and as the worth of the ball says."""
    monkeypatch.setattr(balls, "CELL", 60)
    monkeypatch.setattr(balls, "CHUNK", 40)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(250, 3)), np.ones((30, 3))])
    x = np.round(x) if name == "hamming" else x
    rows = [(k % 270, v.tolist(), float(1 + k % 4), k) for k, v in enumerate(x)]  # some share an id
    df = spark.createDataFrame(rows, "id long, v array<double>, w double, no long").repartition(3)
    whole = facility_location.weighted_radii(df, alfa, name).collect()
    found = facility_location.weighted_radii(df, alfa, name, at_once=0).collect()
    own = lambda rows: np.array(sorted((r.id, r.w, *r.v, r.r) for r in rows))
    assert len(found) == 280 and np.allclose(own(found), own(whole), atol=1e-7)
    far, w = dist.get(name).block(x, x), np.array([r[2] for r in rows])
    place = min(280, int(np.log2(280)) + 1)
    by = {(r.id, r.w, *r.v): r.r for r in found}
    for k, (i, v, h, _) in enumerate(rows):
        r, last = by[i, h, *v], np.sort(far[k])[place - 1]
        worth = lambda r: (w * np.maximum(0, r - far[k])).sum()  # noqa: E731, B023
        assert np.isclose(worth(r), alfa * worth(last), rtol=1e-6, atol=1e-6)


def test_few_pairs_are_met(spark, monkeypatch):
    """Four times the points in the same density: the distances grow with the points, not with their square."""
    monkeypatch.setattr(balls, "CELL", 50)
    met = {}
    for n in (1000, 4000):
        x = np.random.default_rng(n).uniform(0, np.sqrt(n), (n, 2))
        df = table(spark, x)
        met[n] = balls.BallIndex(df, "l2").ask(df.withColumn("reach", F.lit(1.0)), "count").agg(F.sum("met")).first()[0]
    assert met[4000] < 8 * met[1000] and met[4000] < 4000 * 4000 / 8


def plain_choice(spark, rows):
    """Ids of the sequential rule: by radius, then the hash of the id."""
    h = {r.id: r.h for r in spark.createDataFrame([(r[0],) for r in rows], "id long").select("id", F.xxhash64("id").alias("h")).collect()}
    chosen = []
    for i, v, r in sorted(rows, key=lambda r: (r[2], h[r[0]], r[0])):
        if all(np.linalg.norm(np.subtract(v, c)) > 2 * r for _, c in chosen):
            chosen.append((i, v))
    return [i for i, _ in chosen]


@pytest.mark.parametrize("settled", [50_000, 40, 0])
def test_choice_is_that_of_the_sequential_rule(spark, monkeypatch, settled):
    monkeypatch.setattr(facility_location, "SETTLED", settled)
    monkeypatch.setattr(balls, "CELL", 60)
    rng = np.random.default_rng(4)
    rows = [(k, rng.uniform(0, 10, 2).tolist(), float(rng.choice([0.2, 0.4, 0.6, 1.1]))) for k in range(250)]
    df = spark.createDataFrame(rows, "id long, v array<double>, r double").repartition(3)
    found = facility_location.choose(df).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(len(found)))
    assert [r.center_id for r in found] == plain_choice(spark, rows)
    assert facility_location.choose(df.where("id < 0")).count() == 0
    if settled < 50_000:  # cosine by its angles
        chosen = []
        h = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
        for i, v, r in sorted(((i, v, r / 40) for i, v, r in rows), key=lambda r: (r[2], h[r[0]])):
            if all(dist.COSINE.block(np.array([v]), np.array([c]))[0, 0] > 2 * r for _, c in chosen):
                chosen.append((i, v))
        angles = facility_location.choose(df.withColumn("r", F.col("r") / 40), "cosine").orderBy("rank").collect()
        assert [r.center_id for r in angles] == [i for i, _ in chosen] and len(chosen) > 5
    if settled:  # any other distance, by parts
        with monkeypatch.context() as m:
            m.setattr(facility_location, "SETTLED", 30)
            other = dist.Distance("plain", dist.L2.expr, dist.L2.block)
            assert [r.center_id for r in facility_location.choose(df, other).orderBy("rank").collect()] == plain_choice(spark, rows)


def test_radii_by_levels(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(300, 2))
    df = spark.createDataFrame([(k, v.tolist(), 1.0, "x") for k, v in enumerate(x)], "id long, v array<double>, w double, place string").repartition(3)
    whole = sorted((r.id, r.r, r.place) for r in facility_location.estimated_radii(df, 4.0).collect())
    monkeypatch.setattr(facility_location, "SAMPLED", 10)
    monkeypatch.setattr(balls, "CELL", 20)
    found = facility_location.estimated_radii(df, 4.0)
    assert found.columns == ["id", "v", "w", "place", "r"]
    assert sorted((r.id, r.r, r.place) for r in found.collect()) == whole


def test_few_chunks_are_asked_on_a_line(spark, monkeypatch):
    """Cells whose pivot lies further than a point's own by more than its reach allows aren't asked, however wide they are."""
    monkeypatch.setattr(balls, "CELL", 32)
    rng = np.random.default_rng(4)
    rows = [(k, [float(x), float(k % 12) / 12]) for k, x in enumerate(rng.random(1500))]
    df = spark.createDataFrame(rows, "no long, v array<double>")
    index = balls.BallIndex(df, "l2")
    found = {r.no: r for r in index.ask(df.withColumn("reach", F.lit(1e-4)), "count").collect()}
    x = np.array([v for _, v in rows])
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert all(found[k].n == (full[k] <= 1e-4).sum() for k in range(len(rows)))
    rings = index.rings
    assert sum(r.met for r in found.values()) < 1.5 * len(rows) * (rings.count**2).sum() / len(rows)
    near = {r.no: r for r in index.nearest(index.targets(), 6).collect()}
    assert all(np.allclose(near[k].far, np.sort(full[k])[:6]) for k in range(len(rows)))
