"""Exact medoids of large clusters without all pairs, by bounds that the triangle inequality gives.

The cost of a candidate is its weighted distance to all members of its cluster. Members go to the nearest of some
pivots of the cluster; a pivot's group of weight W and weighted radius E costs a candidate at distance d from the pivot
between |W d - E| and W d + E. Where the distance is a norm, which is convex, it costs no less than W times the distance
from the group's mean, which is far nearer. Sums over the pivots bound every candidate's cost in one pass, and only candidates
whose lower bound is below the least upper one remain. Those are met with all members in growing blocks, the lowest
bounds first; a known cost S of a candidate p bounds the others by |W d(x, p) - S|, and the best one so far ends
the search. What reaches the driver are pivots, blocks of candidates and one row for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as dist
from ..functions.vectors import all_rows, lists
from ..sources.scratch import discard, written

#: Pivots of a cluster; candidates of the first block of a cluster; values that are sent to every task at most.
PIVOTS, FIRST, MOST_VALUES = 512, 64, 2_000_000
#: Components up to which means of groups are taken.
WIDE = 256
#: Relative difference of costs that rounding can make, by far.
CLOSE = 1e-9


def _by_cluster(rows: list) -> dict[int, tuple[np.ndarray, ...]]:
    """For each cluster, arrays of the other columns of its rows."""
    found: dict[int, list] = {}
    for cluster, *rest in rows:
        found.setdefault(cluster, []).append(rest)
    return {c: tuple(np.array(x) for x in zip(*own, strict=True)) for c, own in found.items()}


def _each(f, own: dict, batch: pa.RecordBatch) -> Iterator[tuple]:
    """f(places, vectors, weights, what is known of the cluster) of the rows of each cluster in a batch (cluster, w, v, …)."""
    cluster, w, x = batch.column("cluster").to_numpy(), batch.column("w").to_numpy(), all_rows(batch.column("v"))
    for c in np.unique(cluster).tolist():
        if c in own:
            at = np.flatnonzero(cluster == c)
            for k in range(0, len(at), 1024):
                yield c, f(at[k : k + 1024], x[at[k : k + 1024]], w[at[k : k + 1024]], own[c])


def exact_medoids(assigned: DataFrame, distance: str | dist.Distance = "l2") -> DataFrame:
    """cluster, center_id, center, cost, points and computed: the member of the least weighted distance to all others of
    each cluster of assigned points (id, weight, v, cluster), and how many candidates met all members.

    Ties within rounding go to the smallest id. Ids may repeat. Only for distances that obey the triangle inequality;
    others raise. A null or ragged vector raises, a row of a null cluster is left out, and empty input has no rows.
    """
    d = dist.get(distance)
    if not d.metric:
        raise ValueError(f"{d.name} doesn't obey the triangle inequality")
    spark = assigned.sparkSession
    points = assigned.where("cluster is not null").select(F.col("cluster").cast("long").alias("cluster"), F.col("weight").cast("double").alias("w"), F.col("v").cast("array<double>").alias("v"), F.col("id").cast("long").alias("id"))
    points = written(points.withColumn("no", F.monotonically_increasing_id()), "members")
    size = F.coalesce(F.size("v"), F.lit(-1))
    sums = points.groupBy("cluster").agg(F.sum("w"), F.count("*"), F.max(size), F.min(size)).collect()  # a row for each cluster
    whole = {r[0]: tuple(r[1:4]) for r in sums}
    schema = "cluster long, center_id long, center array<double>, cost double, points long, computed long"
    if not whole:
        return spark.createDataFrame([], schema)
    if len({x for r in sums for x in r[3:]}) > 1 or sums[0][3] < 0:
        raise ValueError("vectors are null or differ in length: validate the points first")
    width = max(1, sums[0][3])
    share = max(1, MOST_VALUES // (width * len(whole)))  # vectors of each cluster that may travel at once

    def first(rows: DataFrame, most: int, *order) -> list:
        place = F.row_number().over(Window.partitionBy("cluster").orderBy(*order, "no"))
        return rows.withColumn("place", place).where(F.col("place") <= most).select("cluster", "no", "v").collect()

    pivots = {c: (v,) for c, (_, v) in _by_cluster(first(points, min(PIVOTS, share), F.xxhash64("no"))).items()}
    pivots = _grouped(points, pivots, d)
    held = left = written(_bounded(points, pivots, d), "candidates")
    best = {c: r for c, r in left.groupBy("cluster").agg(F.min("high")).collect()}
    found: dict[int, list] = {c: [] for c in whole}
    block = min(FIRST, share)
    while True:
        now = _by_cluster(first(_below(left, best), block, "low"))
        if not now:
            break
        sums = _met(points, {c: (no, v) for c, (no, v) in now.items()}, d)
        for c, (no, v) in now.items():
            own = np.array([sums.get((c, k), 0.0) for k in range(len(no))])
            found[c] += list(zip(own.tolist(), no.tolist(), strict=True))
            best[c] = min(best[c], float(own.min()))
            now[c] = (no, v, own, whole[c][0])
        left = written(_raised(_below(left, best), now, d), "candidates")
        discard(held)
        held, block = left, min(2 * block, share)
    discard(held)
    # the smallest id of those whose costs are the least within rounding
    near = [(c, no, cost) for c, own in found.items() for cost, no in own if cost <= min(own)[0] + CLOSE * (1 + min(own)[0])]
    rows = points.join(F.broadcast(spark.createDataFrame(near, "cluster long, no long, cost double")), ["cluster", "no"])
    least = rows.groupBy("cluster").agg(F.min(F.struct(F.round("cost", 9).alias("r"), "id", "no", "v", "cost")).alias("m")).collect()
    out = [(r["cluster"], r["m"]["id"], r["m"]["v"], r["m"]["cost"], whole[r["cluster"]][1], len(found[r["cluster"]])) for r in least]
    discard(points)
    return spark.createDataFrame(out, schema)


def _below(left: DataFrame, best: dict[int, float]) -> DataFrame:
    """The candidates that may still be as good as the best one of their cluster."""
    rows = [(c, b + CLOSE * (1 + b)) for c, b in best.items()]  # a row for each cluster
    return left.join(F.broadcast(left.sparkSession.createDataFrame(rows, "cluster long, best double")), "cluster").where("low <= best").drop("best")


def _grouped(points: DataFrame, pivots: dict, d: dist.Distance) -> dict:
    """For each cluster: its pivots, the weights of their groups, the groups' weighted radii, and their means (or None)."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)
    width = next(iter(pivots.values()))[0].shape[1]
    wide = width if d.norm and width <= WIDE else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((2 + wide, len(own[0]))) for c, own in shared.value.items()}

        def add(at, x, w, own):
            far = d.block(x, own[0])
            best = far.argmin(1)
            return np.stack([np.bincount(best, y, far.shape[1]) for y in (w, w * far.min(1), *(w * x[:, j] for j in range(wide)))])

        for batch in batches:
            for c, more in _each(add, shared.value, batch):
                sums[c] += more
        for c, own in sums.items():
            count = own.shape[1]
            yield pa.record_batch([pa.array(np.full(count, c)), pa.array(np.arange(count)), lists(np.ascontiguousarray(own.T))], names=["cluster", "k", "s"])

    found = points.mapInArrow(run, "cluster long, k long, s array<double>")
    whole = F.array(*[F.sum(F.col("s")[j]) for j in range(2 + wide)]).alias("s")
    for r in found.groupBy("cluster", "k").agg(whole).orderBy("cluster", "k").collect():
        own = pivots[r["cluster"]]
        if len(own) == 1:
            pivots[r["cluster"]] = own = (own[0], np.zeros(len(own[0])), np.zeros(len(own[0])), own[0].copy() if wide else None)
        own[1][r["k"]], own[2][r["k"]] = r["s"][:2]
        if wide and r["s"][0] > 0:
            own[3][r["k"]] = np.array(r["s"][2:]) / r["s"][0]
    return pivots


def _columns(points: DataFrame, run, *names: str) -> DataFrame:
    """points with columns of doubles, from run(batch) to their arrays."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "no", "id", "w", "v")), *map(pa.array, run(batch))], names=["cluster", "no", "id", "w", "v", *names])

    return points.mapInArrow(each, "cluster long, no long, id long, w double, v array<double>, " + ", ".join(f"{n} double" for n in names))


def _bounded(points: DataFrame, pivots: dict, d: dist.Distance) -> DataFrame:
    """points with the bounds low and high of their costs."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(batch.num_rows), np.zeros(batch.num_rows)

        def bound(at, x, w, own):
            far = d.block(x, own[0]) * own[1]
            low[at], high[at] = np.abs(far - own[2]).sum(1), (far + own[2]).sum(1)
            if own[3] is not None:
                low[at] = np.maximum(low[at], d.block(x, own[3]) @ own[1])

        for _ in _each(bound, shared.value, batch):
            pass
        return low, high

    return _columns(points, run, "low", "high")


def _raised(left: DataFrame, now: dict, d: dist.Distance) -> DataFrame:
    """The candidates that haven't met all members yet, their lower bounds raised by the costs of those that have."""
    shared = left.sparkSession.sparkContext.broadcast(now)

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        low, high = batch.column("low").to_numpy().copy(), batch.column("high").to_numpy()
        no = batch.column("no").to_numpy()

        def lift(at, x, w, own):
            low[at] = np.maximum(low[at], np.abs(own[3] * d.block(x, own[1]) - own[2]).max(1))
            low[at[np.isin(no[at], own[0])]] = np.inf

        for _ in _each(lift, shared.value, batch):
            pass
        return low, high

    return _columns(left, run, "low", "high").where("low < double('infinity')")


def _met(points: DataFrame, now: dict, d: dist.Distance) -> dict[tuple[int, int], float]:
    """The costs of candidates, by cluster and place: a row for each reaches the driver."""
    shared = points.sparkSession.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros(len(own[0])) for c, own in shared.value.items()}
        for batch in batches:
            for c, more in _each(lambda at, x, w, own: w @ d.block(x, own[1]), shared.value, batch):
                sums[c] += more
        for c, cost in sums.items():
            yield pa.record_batch([pa.array(np.full(len(cost), c)), pa.array(np.arange(len(cost))), pa.array(cost)], names=["cluster", "k", "cost"])

    found = points.mapInArrow(run, "cluster long, k long, cost double")
    return {(r["cluster"], r["k"]): r["cost"] for r in found.groupBy("cluster", "k").agg(F.sum("cost").alias("cost")).collect()}
