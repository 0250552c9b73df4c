"""Weighted k-medoids over a summary: single steps as DataFrame operators, and the whole search.

A summary within a checked size is searched in one task, where an iteration takes milliseconds and a Spark job for
each would take far longer. A larger one is searched by the same rule in rounds of Spark jobs. New medoids are found by
bounds (see medoids); for distances that don't obey the triangle inequality, candidates meet the members of their
cluster in blocks of the summary, which are sent one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as dist
from ..functions.vectors import all_rows, lists
from ..sources.scratch import delete, discard, shared_path, written
from .assign import nearest
from .medoids import exact_medoids

#: Points of a summary that one task searches (8000 squared distances are half a gigabyte), and points of a block.
MOST_POINTS, BLOCK = 8000, 8000
#: Points of a cluster that meet all of it in one group.
PART = 2000
_FOUND = "cluster int, center_id long, center array<double>, cost double, history array<double>"
_MODEL = ("cluster", "center_id", "center", "cost", "iterations", "total_cost", "history")
#: Quantiles of the distances to a medoid.
CLUSTER = (0.05, 0.25, 0.5, 0.75, 0.95)


def initial_medoids(d: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """First the heaviest point, then again and again the one of the greatest weighted distance from any chosen one.

    Points equal to a chosen one are left out, so there are at most as many as lie apart.
    """
    chosen = [int(w.argmax())]
    cost, free = d[chosen[0]] * w, d[chosen[0]] > 0
    while len(chosen) < k and (cost * free).max() > 0:
        chosen.append(int((cost * free).argmax()))
        cost = np.maximum(cost, d[chosen[-1]] * w)
        free &= d[chosen[-1]] > 0
    return np.array(chosen)


def assign(d: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return d[:, centres].argmin(1)


def recentre(d: np.ndarray, w: np.ndarray, member: np.ndarray, k: int, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The member of least weighted distance to the others of each cluster, and that distance; empty ones keep theirs."""
    centres, costs = old.copy(), np.zeros(k)
    for c in range(k):
        own = np.flatnonzero(member == c)
        if len(own):
            cost = d[np.ix_(own, own)] @ w[own]
            best = int(cost.argmin())
            centres[c], costs[c] = own[best], cost[best]
    return centres, costs


def close_pair(d: np.ndarray, w: np.ndarray, member: np.ndarray, centres: np.ndarray, last: tuple[int, int] | None) -> tuple[int, int] | None:
    """The two clusters whose centres are nearest, measured by their mean distances; not the pair of the last time."""
    k = len(centres)
    own = d[np.arange(len(d)), centres[member]]
    weight = np.bincount(member, w, k)
    mean = np.divide(np.bincount(member, w * own, k), weight, out=np.zeros(k), where=weight > 0)
    best, pair = np.inf, None
    for i in range(k):
        for j in range(i + 1, k):
            spread = mean[i] + mean[j]
            value = 2 * d[centres[i], centres[j]] / spread if spread > 0 else np.inf
            if value < best and (i, j) != last:
                best, pair = value, (i, j)
    return pair


def search(d: np.ndarray, w: np.ndarray, k: int, iterations: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """(centres, costs, membership, history) of the best state: alternation, with a perturbation at each local minimum.

    history has the cost of each accepted step; the best state is that of its least value. Only accepted steps count as
    iterations. A perturbation starts from the best state: of the two clusters whose centres are nearest, one moves its
    centre to its own farthest member. k is cut to the number of points that lie apart.
    """
    rng = np.random.default_rng(seed)
    centres = initial_medoids(d, w, max(1, min(k, len(d))))
    k = len(centres)
    member = assign(d, centres)
    best: tuple | None = None
    current, last, perturbed, history = np.inf, None, False, []
    while len(history) < iterations:
        new, costs = recentre(d, w, member, k, centres)
        total = float(costs.sum())
        if total < current or perturbed:
            perturbed, current, centres = False, total, new
            if not history or total < min(history):
                best = (new.copy(), costs, member.copy())
            history.append(total)
            member = assign(d, centres)
            continue
        centres, member = best[0].copy(), best[2]
        if (last := close_pair(d, w, member, centres, last)) is None:
            break
        c = last[int(rng.integers(2))]
        own = np.flatnonzero(member == c)
        far = own[d[centres[c], own].argmax()] if len(own) else centres[c]
        if d[centres[c], far] <= 0:
            break
        centres[c] = far
        member = assign(d, centres)
        perturbed = True
    return (*best, history)


class Rounds:
    """The search over a summary of any size, each step as a Spark job; what comes back is one row for each cluster.

    Sums are of parts in another order than in one task, so ties to the last digit may fall otherwise.
    """

    def __init__(self, summary: DataFrame, d: dist.Distance):
        self.spark, self.d = summary.sparkSession, d
        self.path = shared_path(self.spark, "kmedoids")
        summary.select(F.col("id").cast("long").alias("id"), F.col("weight").cast("double").alias("weight"), F.col("v").cast("array<double>").alias("v")).withColumn("no", F.monotonically_increasing_id()).write.parquet(f"{self.path}/summary")
        self.rows = self.spark.read.parquet(f"{self.path}/summary")

    def drop(self, name: str = "") -> None:
        """Deletes scratch tables."""
        delete(self.spark, f"{self.path}/{name}".rstrip("/"))

    def _map(self, f, schema: str, rows: DataFrame | None = None) -> DataFrame:
        """f(ids, weights, vectors) of each batch, as columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = all_rows(batch.column("v"))
                    yield pa.record_batch(f(batch.column("id").to_numpy(), batch.column("weight").to_numpy(), x))

        return (self.rows if rows is None else rows).mapInArrow(run, schema)

    def _numbered(self, f) -> DataFrame:
        """no and what f(ids, weights, vectors) of each batch gives: cluster and cost."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = f(batch.column("id").to_numpy(), batch.column("weight").to_numpy(), all_rows(batch.column("v")))
                    yield pa.record_batch({"no": batch.column("no"), **{c: pa.array(x) for c, x in found.items()}})

        return self.rows.mapInArrow(run, "no long, cluster int, cost double")

    def initial(self, k: int) -> list[tuple[int, list[float]]]:
        first = self.rows.orderBy(F.desc("weight"), "id").first()
        chosen = [(first["id"], first["v"])]
        while len(chosen) < k:
            shared, d = self.spark.sparkContext.broadcast(np.array([v for _, v in chosen])), self.d

            def farthest(ids, w, x, shared=shared):
                found = d.block(x, shared.value)
                cost = np.where(found.min(1) > 0, found.max(1) * w, 0.0)
                top = np.flatnonzero(cost == cost.max())
                best = top[ids[top].argmin()]
                return {"id": ids[[best]], "c": cost[[best]], "v": pa.array([x[best].tolist()])}

            best = self._map(farthest, "id long, c double, v array<double>").orderBy(F.desc("c"), "id").first()
            if best["c"] <= 0:
                break
            chosen.append((best["id"], best["v"]))
        return chosen

    def assigned(self, centres: list) -> DataFrame:
        """id, weight, v, cluster and own (distance) of all points."""
        shared, d = self.spark.sparkContext.broadcast(np.array([v for _, v in centres])), self.d

        def near(ids, w, x):
            found = d.block(x, shared.value)
            best = found.argmin(1)
            return {"id": ids, "weight": w, "v": lists(x), "cluster": best.astype(np.int32), "own": found[np.arange(len(best)), best]}

        return self._map(near, "id long, weight double, v array<double>, cluster int, own double")

    def recentre(self, centres: list) -> tuple[list, np.ndarray]:
        """The member of least weighted distance to the others of each cluster, and that distance; empty ones keep theirs."""
        if self.d.metric:
            new, total = list(centres), np.zeros(len(centres))
            for r in exact_medoids(self.assigned(centres), self.d).collect():  # one row for each cluster
                new[r["cluster"]], total[r["cluster"]] = (r["center_id"], r["center"]), r["cost"]
            return new, total
        d, vectors = self.d, self.spark.sparkContext.broadcast(np.array([v for _, v in centres]))
        last = None
        while True:
            rest = self.rows if last is None else self.rows.where(F.col("no") > last)
            block = rest.orderBy("no").limit(BLOCK).collect()
            if not block:
                break
            last = block[-1]["no"]
            held = np.array([r["v"] for r in block])
            shared = self.spark.sparkContext.broadcast((held, np.array([r["weight"] for r in block]), d.block(held, vectors.value).argmin(1)))

            def costs(ids, w, x, shared=shared):
                own = d.block(x, vectors.value).argmin(1)
                held, weight, member = shared.value
                cost = np.zeros(len(ids))
                for c in np.unique(own):
                    at, there = np.flatnonzero(own == c), np.flatnonzero(member == c)
                    if len(there):
                        for k in range(0, len(at), 256):
                            cost[at[k : k + 256]] = d.block(x[at[k : k + 256]], held[there]) @ weight[there]
                return {"cluster": own.astype(np.int32), "cost": cost}

            part = self._numbered(costs)
            part.write.mode("append").parquet(f"{self.path}/costs")  # a job for each block, so that it holds one broadcast
            shared.unpersist()
        parts = self.spark.read.parquet(f"{self.path}/costs").groupBy("no", "cluster").agg(F.sum("cost").alias("cost")).join(self.rows.select("no", "id"), "no")
        best = parts.groupBy("cluster").agg(F.min(F.struct("cost", "id", "no")).alias("m")).select("cluster", "m.cost", "m.no")
        found = best.join(self.rows.select("no", "id", "v"), "no").collect()  # one row for each cluster
        new, total = list(centres), np.zeros(len(centres))
        for r in found:
            new[r["cluster"]], total[r["cluster"]] = (r["id"], r["v"]), r["cost"]
        self.drop("costs")
        return new, total

    def close_pair(self, centres: list, last: tuple[int, int] | None, member: DataFrame) -> tuple[int, int] | None:
        mean = np.zeros(len(centres))
        for r in member.groupBy("cluster").agg((F.sum(F.col("weight") * F.col("own")) / F.sum("weight")).alias("mean")).collect():
            mean[r["cluster"]] = r["mean"] or 0.0
        v = np.array([v for _, v in centres])
        between = self.d.block(v, v)
        best, pair = np.inf, None
        for i in range(len(centres)):
            for j in range(i + 1, len(centres)):
                spread = mean[i] + mean[j]
                value = 2 * between[i, j] / spread if spread > 0 else np.inf
                if value < best and (i, j) != last:
                    best, pair = value, (i, j)
        return pair

    def search(self, k: int, iterations: int, seed: int) -> list[tuple]:
        """Rows of MODEL: the steps of search(), whose membership is that of the nearest of given medoids."""
        rng = np.random.default_rng(seed)
        by = centres = self.initial(k)  # members are those nearest to by
        best: tuple | None = None
        current, last, perturbed, history = np.inf, None, False, []
        while len(history) < iterations:
            new, costs = self.recentre(by)
            total = float(costs.sum())
            if total < current or perturbed:
                perturbed, current, centres = False, total, new
                if not history or total < min(history):
                    best = (new, costs, by)
                history.append(total)
                by = new
                continue
            centres, member = list(best[0]), self.assigned(best[2])
            if (last := self.close_pair(centres, last, member)) is None:
                break
            c = last[int(rng.integers(2))]
            own = self.d.expr(F.col("v"), F.array(*map(F.lit, centres[c][1])))
            far = member.where(F.col("cluster") == c).select("id", "v", own.alias("own")).orderBy(F.desc("own"), "id").first()
            if far is None or far["own"] <= 0:
                break
            centres[c] = (far["id"], far["v"])
            by = centres
            perturbed = True
        centres, costs, _ = best
        return [(c, int(i), [float(x) for x in v], float(costs[c]), history) for c, (i, v) in enumerate(centres)]


def fit(summary: DataFrame, k: int, iterations: int = 15, *, distance: str | dist.Distance = "l2", seed: int = 1) -> DataFrame:
    """MODEL rows of the best state for a summary (id, weight, v): cluster, center_id, center, cost, iterations (the
    number of the best step), total_cost, and history, the cost of each accepted step."""
    n = summary.limit(MOST_POINTS + 1).count()
    if n == 0:
        raise ValueError("the summary is empty")
    d = dist.get(distance)
    best = {"iterations": F.expr("cast(array_position(history, array_min(history)) as int)"), "total_cost": F.array_min("history")}
    if n > MOST_POINTS:
        rounds = Rounds(summary, d)
        rows = rounds.search(k, iterations, seed)
        rounds.drop()
        return summary.sparkSession.createDataFrame(rows, _FOUND).withColumns(best).select(*_MODEL)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        v, w = np.stack(pdf["v"].tolist()), pdf["weight"].to_numpy()
        centres, costs, _, history = search(d.block(v, v), w, k, iterations, seed)
        return pd.DataFrame({"cluster": range(len(centres)), "center_id": pdf["id"].to_numpy()[centres], "center": v[centres].tolist(), "cost": costs, "history": [history] * len(centres)})

    found = summary.select("id", "weight", "v").groupBy(F.lit(0).alias("_")).applyInPandas(run, _FOUND)
    return found.withColumns(best).select(*_MODEL)


def membership(summary: DataFrame, medoids: DataFrame, distance: str | dist.Distance = "l2") -> DataFrame:
    """summary with cluster and dist: the nearest of the medoids, ties to the smaller cluster; columns of these names, and
    rank, are replaced."""
    summary = summary.drop("cluster")
    centres = medoids.select(F.col("cluster").alias("rank"), "center_id", "center")
    return nearest(summary, centres, distance).withColumnRenamed("rank", "cluster")


def distance_quantiles(assigned: DataFrame, at: tuple[float, ...] = CLUSTER) -> DataFrame:
    """cluster, q and value: quantiles of the distance to the medoid in each cluster of assigned points (cluster, dist)."""
    found = assigned.groupBy("cluster").agg(F.percentile("dist", F.array(*map(F.lit, at))).alias("x"))
    return found.select("cluster", F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("q"), "x")).alias("z")).select("cluster", F.col("z.q").alias("q"), F.col("z.x").alias("value"))


def initial(summary: DataFrame, k: int, distance: str | dist.Distance = "l2", *, by: str = "cost", seed: int = 117) -> DataFrame:
    """cluster and center_id of initial medoids, by k rounds of DataFrame operations.

    by: "cost" takes the heaviest point, then again and again the one of the greatest weighted distance from any chosen
    one, without points equal to chosen ones; "distance" takes these too. "random" takes those of the smallest hashes
    of seed and id.
    """
    d = dist.get(distance)
    rows = summary.select("id", "weight", "v")
    if by == "random":
        found = rows.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(k).collect()
        return summary.sparkSession.createDataFrame([(c, r["id"]) for c, r in enumerate(found)], "cluster int, center_id long")
    first = rows.orderBy(F.desc("weight"), "id").limit(1).collect()
    if not first:
        return summary.sparkSession.createDataFrame([], "cluster int, center_id long")
    chosen, far = [first[0]], None
    while len(chosen) < k:
        to_last = d.expr(F.col("v"), F.array(*map(F.lit, chosen[-1]["v"])))
        own = (rows if far is None else far).withColumn("_d", to_last)
        own = own.select("id", "weight", "v", *[F.col("_d").alias(x) if far is None else f("_d", x).alias(x) for x, f in (("most", F.greatest), ("least", F.least))])
        new = written(own, "far")
        if far is not None:
            discard(far)
        far = new
        free = F.col("least") > 0 if by == "cost" else ~F.col("id").isin([r["id"] for r in chosen])
        best = far.where(free).select("id", "v", (F.col("most") * F.col("weight")).alias("c")).orderBy(F.desc("c"), "id").limit(1).collect()
        if not best or best[0]["c"] <= 0:
            break
        chosen.append(best[0])
    return summary.sparkSession.createDataFrame([(c, r["id"]) for c, r in enumerate(chosen)], "cluster int, center_id long")


def recentred(assigned: DataFrame, distance: str | dist.Distance = "l2") -> DataFrame:
    """cluster, center_id and cost: the new medoid of each cluster of assigned points (id, weight, v, cluster).

    Bounds save most distances (see medoids.exact_medoids) if the distance obeys the triangle inequality; else all pairs
    of a cluster are met, in parts: PART of its points with all of them, so that no task has a whole large one.
    """
    d = dist.get(distance)
    if d.metric:
        return exact_medoids(assigned, d).select("cluster", "center_id", "cost")
    assigned = assigned.join(F.broadcast(_parts(assigned)), "cluster")
    a = assigned.select("cluster", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.col("id").alias("i"), F.col("v").alias("a"))
    b = assigned.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("v").alias("b"), "weight")
    cost = a.join(b, ["cluster", "part"]).groupBy("cluster", "i").agg(F.sum(d.expr(F.col("a"), F.col("b")) * F.col("weight")).alias("cost"))
    best = cost.groupBy("cluster").agg(F.min(F.struct(F.round("cost", 9).alias("r"), "i", "cost")).alias("m"))
    return best.select("cluster", F.col("m.i").alias("center_id"), F.col("m.cost").alias("cost"))


def _parts(assigned: DataFrame) -> DataFrame:
    """cluster and parts of PART points: one row for each cluster."""
    rows = assigned.groupBy("cluster").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts")).collect()
    return assigned.sparkSession.createDataFrame(rows, "cluster long, parts long")


def cluster_costs(assigned: DataFrame) -> DataFrame:
    """cluster, n, weight and cost of assigned points (weight, cluster, dist)."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("dist")).alias("cost"))


def closest_pair(centres: DataFrame, costs: DataFrame, distance: str | dist.Distance = "l2") -> DataFrame:
    """c1, c2 and value of the two clusters nearest by the measure of close_pair; no row if there are none."""
    d = dist.get(distance)
    own = centres.join(costs.where("weight > 0").select("cluster", (F.col("cost") / F.col("weight")).alias("mean")), "cluster").select("cluster", "center", "mean")
    a, b = (own.select(*[F.col(c).alias(f"{c}{k}") for c in own.columns]) for k in (1, 2))
    spread = F.col("mean1") + F.col("mean2")
    pairs = a.join(b, F.col("cluster1") < F.col("cluster2")).where(spread > 0)
    value = 2 * d.expr(F.col("center1"), F.col("center2")) / spread
    ordered = pairs.select(F.col("cluster1").alias("c1"), F.col("cluster2").alias("c2"), value.alias("value"))
    return ordered.withColumn("n", F.row_number().over(Window.orderBy("value", "c1", "c2"))).where("n = 1").drop("n")
