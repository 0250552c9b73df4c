"""Streaming facilities for k-median: few more than k centres, within a constant of the best cost, in one pass.

A point opens a facility with a probability that grows with its distance from the nearest one, else it joins
that one. When the facilities or their cost exceed the bounds of the phase, the next phase starts with looser
bounds from the facilities themselves. The rule is sequential, so points are dealt to shards by a hash of their
id, each shard runs the rule over its points in order of id, and the shards' facilities (weighted, and bounded in
number) run through it once more, GROUP shards at a time until one is left. Chances come from hashes of (seed, phase, id): a repeated task, or another
layout of the partitions, opens the same facilities for a given number of shards. The approximation constant
grows with the second level; with one shard there is none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as dist
from ..functions.vectors import all_rows

#: Points of a shard on average where the number of shards is not given, and shards that are merged in one task.
SHARD, GROUP = 25_000, 64
#: Points of a shard that are judged together.
STEP = 1024
FACILITY = "rank long, center_id long, center array<double>, weight double, cost double"
_MASK = (1 << 64) - 1


def chance(seed: int, phase: int, id: int) -> float:
    """A number in [0, 1) from a hash of the three."""
    x = (seed * 0x9E3779B97F4A7C15 + phase * 0xBF58476D1CE4E5B9 + id * 0x94D049BB133111EB) & _MASK
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & _MASK
    return (x ^ (x >> 31)) / 2.0**64


def chances(seed: int, phase: int, ids: np.ndarray) -> np.ndarray:
    """chance() of each id."""
    with np.errstate(over="ignore"):
        x = np.uint64((seed * 0x9E3779B97F4A7C15 + phase * 0xBF58476D1CE4E5B9) & _MASK) + ids.astype(np.int64).view(np.uint64) * np.uint64(0x94D049BB133111EB)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def clamped_k(k: int, n: int) -> int:
    """k, but at most about the root of n."""
    return k if k <= math.isqrt(n) else max(1, min(k, int(math.sqrt(1 + n))))


def log2_floor(n: int) -> int:
    return max(1, n).bit_length() - 1


def _running(start: float, values: np.ndarray) -> np.ndarray:
    """start plus the first of the values, the first two, ...: added one by one."""
    out = np.empty(len(values) + 1)
    out[0], out[1:] = start, values
    return np.cumsum(out, out=out)[1:]


@dataclass
class State:
    """The facilities of one shard, and the bounds of the phase."""

    k: int
    n: int
    beta: float
    gamma: float
    distance: dist.Distance
    seed: int = 1454691
    phase: int = 0
    li: float = 1.0
    total_cost: float = 0.0
    weight: float = 0.0
    inserted: int = 0
    ids: list[int] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    costs: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.k = clamped_k(self.k, self.n)
        self.bound = int((self.gamma - 1) * (1 + log2_floor(self.n)) * self.k)
        if self.bound < 1:
            raise ValueError("gamma is too small: not even one facility is within the bound")
        self.open_rate = (1 + log2_floor(self.n)) * self.k
        self.most_cost = self.gamma
        self._centres = np.zeros((0, 0))

    def _open(self, id: int, v: np.ndarray, w: float) -> None:
        k = len(self.ids)
        if k >= len(self._centres):
            grown = np.zeros((max(64, 2 * k), len(v)))
            grown[:k] = self._centres[:k] if k else 0
            self._centres = grown
        self._centres[k] = v
        self.ids.append(id)
        self.weights.append(w)
        self.costs.append(0.0)

    def process(self, ids: np.ndarray, x: np.ndarray, w: np.ndarray) -> None:
        """Adds points in order; each time the bounds are exceeded, the facilities go in again before the next point."""
        if len(w) and not (np.isfinite(w).all() and (w >= 0).all()):
            raise ValueError("weights are finite and not negative")
        waiting = [(ids, x, w)]
        while waiting:
            ids, x, w = waiting.pop()
            for k in range(0, len(ids), STEP):
                done = self._together(ids[k : k + STEP], x[k : k + STEP], w[k : k + STEP])
                if done is not None:  # the bounds are exceeded
                    waiting.append((ids[k + done :], x[k + done :], w[k + done :]))
                    waiting.append((np.array(self.ids, np.int64), self._centres[: len(self.ids)].copy(), np.array(self.weights)))
                    self.phase += 1
                    self.most_cost *= self.beta
                    self.li *= self.beta
                    self.total_cost = self.weight = 0.0
                    self.ids, self.weights, self.costs = [], [], []
                    break

    def _together(self, ids: np.ndarray, x: np.ndarray, w: np.ndarray) -> int | None:
        """Adds a few points in order; how many went in, if the bounds are exceeded by then.

        The points between two openings join facilities that stay as they are, so they are judged at once.
        """
        at, n = 0, len(ids)
        if not self.ids:
            self._open(int(ids[0]), x[0], float(w[0]))
            self.inserted, self.weight, at = self.inserted + 1, self.weight + float(w[0]), 1
        u = chances(self.seed, self.phase, ids)
        found = self.distance.block(x, self._centres[: len(self.ids)])
        best = found.argmin(1)
        k = len(self.ids)
        weights, costs = np.zeros((2, k + n))  # as many as there may be facilities when all are judged
        weights[:k], costs[:k] = self.weights, self.costs
        done = self._judged(at, ids, x, w, u, best, found[np.arange(n), best], weights, costs)
        self.weights, self.costs = weights[: len(self.ids)].tolist(), costs[: len(self.ids)].tolist()
        return done

    def _judged(self, at: int, ids: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, best: np.ndarray, near: np.ndarray, weights: np.ndarray, costs: np.ndarray) -> int | None:
        """_together() from the point at on, given each point's nearest facility so far and its distance; adds to weights and costs."""
        n = len(ids)
        while at < n:
            cost = w[at:] * near[at:]
            opens = u[at:] < cost * self.open_rate / self.li
            join = int(opens.argmax())  # so many points join a facility first
            if not opens[join]:
                join = n - at
            if join:
                upto, over = _running(self.total_cost, cost[:join]), False
                if not upto[-1] <= self.most_cost and len(beyond := np.flatnonzero(upto > self.most_cost)):
                    join, over = int(beyond[0]) + 1, True
                own = slice(at, at + join)
                np.add.at(weights, best[own], w[own])
                np.add.at(costs, best[own], cost[:join])
                self.total_cost = float(upto[join - 1])
                self.weight = float(_running(self.weight, w[own])[-1])
                self.inserted += join
                at += join
                if over:
                    return at
                if at == n:
                    return None
            k = len(self.ids)
            self._open(int(ids[at]), x[at], float(w[at]))
            weights[k] = w[at]
            self.weight += float(w[at])
            self.inserted += 1
            at += 1
            if len(self.ids) > self.bound or self.total_cost > self.most_cost:
                return at
            if at < n:
                new = self.distance.block(x[at:], self._centres[k : k + 1])[:, 0]
                nearer = new < near[at:]
                near[at:][nearer] = new[nearer]
                best[at:][nearer] = k
        return None

    def facilities(self) -> list[tuple[int, int, list[float], float, float]]:
        return [(k, i, self._centres[k].tolist(), w, c) for k, (i, w, c) in enumerate(zip(self.ids, self.weights, self.costs, strict=True))]

    def contracted(self) -> State:
        """The facilities run through the rule once more, if enough points went in; else this state."""
        m = len(self.ids)
        if self.inserted <= self.k * (1 + log2_floor(m)):
            return self
        out = State(self.k, m, self.beta, self.gamma, self.distance, self.seed)
        out.process(np.array(self.ids, np.int64), self._centres[:m].copy(), np.array(self.weights))
        return out


def facility_bound(k: int, n: int, gamma: float) -> int:
    return int((gamma - 1) * (1 + log2_floor(n)) * clamped_k(k, n))


STATE = "shard int, phase long, inserted long, li double, most_cost double, total_cost double, weight double, bound long"


def shards_for(n: int) -> int:
    """Shards of SHARD points on average, 8 at least."""
    return max(8, -(-n // SHARD))


def fit(points: DataFrame, k: int, *, beta: float = 2.0, gamma: float = 2.0, distance: str | dist.Distance = "l2", shards: int | None = None, contraction: bool = False, seed: int = 1454691) -> DataFrame:
    """Facilities (rank, center_id, center, weight, cost) of points (id, v, w); weights add up to the points'.

    Costs lack what earlier phases paid: dispatch the points to the facilities for exact ones. shards is shards_for()
    the number of points if it isn't given. A null or ragged vector raises.
    """
    d = dist.get(distance)
    shards, found = _by_shard(points, k, beta, gamma, d, shards, seed, False)
    while shards > 1 or contraction:  # at most GROUP * bound rows meet in a task
        left = -(-shards // GROUP)
        last = left == 1
        rule = _merging(left, lambda n: State(k, n, beta, gamma, d, seed), last and contraction and shards > 1)
        found = found.groupBy(F.pmod("shard", F.lit(left))).applyInPandas(rule, f"shard int, {FACILITY}")
        if last:
            break
        shards = left
    return found.drop("shard")


def _merging(left: int, make: Callable[[int], State], contract: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The rule over the facilities of a group of shards; the group's number among those left is its shard."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0]) % left
        pdf = pdf.sort_values("center_id", kind="stable")
        state = make(len(pdf))
        state.process(pdf["center_id"].to_numpy(), np.stack(pdf["center"].tolist()), pdf["weight"].to_numpy(float))
        if contract:
            state = state.contracted()
        return pd.DataFrame([(shard, *r) for r in state.facilities()], columns=["shard", "rank", "center_id", "center", "weight", "cost"])

    return merge


def states(points: DataFrame, k: int, *, beta: float = 2.0, gamma: float = 2.0, distance: str | dist.Distance = "l2", shards: int | None = None, seed: int = 1454691) -> DataFrame:
    """The bounds that each shard of fit() ended with: phase, insertions (with those of facilities that went in again),
    the facility cost li, the most cost of the phase, the cost and weight so far, and the bound of facilities."""
    return _by_shard(points, k, beta, gamma, dist.get(distance), shards, seed, True)[1]


def _by_shard(points: DataFrame, k: int, beta: float, gamma: float, d: dist.Distance, shards: int | None, seed: int, bounds: bool) -> tuple[int, DataFrame]:
    """The number of shards; the facilities (or the bounds) of each."""
    if shards is None:
        shards = shards_for(points.count())
    # shards are whole within a task, of which there are no more than the session asks for
    tasks = min(shards, max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.sparkSession.sparkContext.defaultParallelism))
    dealt = points.select("id", F.col("v").cast("array<double>").alias("v"), "w").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    schema = STATE if bounds else f"shard int, {FACILITY}"

    def judged(shard: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, x, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        state = State(k, len(ids), beta, gamma, d, seed)  # the rule needs the number of points
        state.process(ids, x, w)
        if bounds:
            one = (shard, state.phase, state.inserted, state.li, state.most_cost, state.total_cost, state.weight, state.bound)
            types = (pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64())
            return pa.record_batch([pa.array([c], t) for c, t in zip(one, types, strict=True)], names=["shard", "phase", "inserted", "li", "most_cost", "total_cost", "weight", "bound"])
        rows = [(shard, *r) for r in state.facilities()]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["shard", "rank", "center_id", "center", "weight", "cost"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in batches:
            own = batch.column(3).to_numpy()
            x = all_rows(batch.column(1))
            ids, w = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if own[a] != shard:
                    if parts:
                        yield judged(int(shard), parts)
                    shard, parts = own[a], []
                parts.append((ids[a:b], x[a:b], w[a:b]))
        if parts:
            yield judged(int(shard), parts)

    return shards, dealt.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "id").mapInArrow(run, schema)
