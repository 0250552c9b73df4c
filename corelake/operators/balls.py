"""What lies within a distance of each point: a join by ranges of distances to shared pivots.

Targets go to the nearest of some pivots, and within its cell to rings of their distance from it. The triangle inequality
tells for each point which rings its ball may reach, and which lie in it as a whole; only the rings in between are met.
A ring of many targets is cut into chunks, and a point asks each of them; chunks and those who ask meet by a shuffle,
so no target passes through the driver. What reaches it are the pivots and a few numbers for each ring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as dist
from ..functions import near
from ..functions.vectors import all_rows
from ..sources.scratch import discard, written

#: Targets of a cell that the number of pivots aims at, the most pivots, rings of a cell, and targets of a chunk at most.
CELL, MOST_PIVOTS, RINGS, CHUNK = 4096, 1024, 8, 2048

#: Points that tell whether the index serves, and the share of the targets that they may ask where rough distances serve.
TRIED, MET = 256, 0.03


@dataclass(frozen=True)
class Rings:
    """Pivots, and of each ring its cell, its least and greatest distance from the pivot, its targets, and its chunks."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    chunks: np.ndarray


class BallIndex:
    """Targets (no, v, and a weight w if sums are asked for); no is a whole number of their own, by which "least" compares.

    Rings are told by the distance's lift where it doesn't obey the triangle inequality itself.
    """

    def __init__(self, targets: DataFrame, distance: str | dist.Distance):
        self.d = dist.get(distance)
        if not self.d.bounded:
            raise ValueError(f"{self.d.name} doesn't obey the triangle inequality")
        self.spark = targets.sparkSession
        self.table = None
        targets = targets if "w" in targets.columns else targets.withColumn("w", F.lit(1.0))
        n = targets.count()
        if not n:
            return
        pivots = targets.orderBy(F.xxhash64("no"), "no").limit(min(MOST_PIVOTS, -(-n // CELL))).collect()
        pivots = np.array([r["v"] for r in pivots], np.float64)
        shared, d = self.spark.sparkContext.broadcast(pivots), self.d

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    far = d.lifted(d.block(all_rows(batch.column(1), shared.value.shape[1]), shared.value))
                    yield pa.record_batch([*batch.columns, pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))], names=["no", "v", "w", "cell", "far"])

        targets = targets.select("no", F.col("v").cast("array<double>").alias("v"), F.col("w").cast("double").alias("w"))
        placed = written(targets.mapInArrow(cells, "no long, v array<double>, w double, cell int, far double"), "cells")
        at = [k / RINGS for k in range(1, RINGS)]
        edges = placed.groupBy("cell").agg(F.percentile_approx("far", at).alias("edges"))  # a row for each pivot
        edges = F.broadcast(self.spark.createDataFrame(edges.collect(), "cell int, edges array<double>"))
        ring = F.size(F.filter("edges", lambda x: x < F.col("far")))
        placed_ = placed.join(edges, "cell").select("no", "v", "w", "far", (F.col("cell") * RINGS + ring).alias("ring"))
        table = written(placed_.repartition("ring").sortWithinPartitions("ring"), "rings")
        discard(placed)
        rows = table.groupBy("ring").agg(F.min("far"), F.max("far"), F.count("*")).orderBy("ring").collect()
        ring, low, high, count = (np.array(c) for c in zip(*rows, strict=True))
        self.ring, self.rings = ring, Rings(pivots, ring // RINGS, low, high, count, -(-count // CHUNK))
        chunks = self.spark.createDataFrame([(int(r), int(c)) for r, c in zip(ring, self.rings.chunks, strict=True)], "ring int, chunks int")
        self.table = table.join(F.broadcast(chunks), "ring").withColumn("chunk", F.pmod(F.xxhash64("no"), "chunks").cast("int"))
        self._kept = table

    def drop(self) -> None:
        if self.table is not None:
            discard(self._kept)

    def serves(self, points: DataFrame) -> bool:
        """Whether asking for points (no, v, reach) is less work than meeting all pairs by rough distances (see functions.near)."""
        if self.table is None or not near.serves(self.d, np.repeat(self.rings.pivots[:1], 16, 0)):
            return True
        rows = points.orderBy(F.xxhash64("no"), "no").limit(TRIED).collect()
        reach = self.d.lifted(np.array([[r["reach"]] for r in rows]))
        far = self.d.lifted(self.d.block(np.array([r["v"] for r in rows], np.float64), self.rings.pivots))[:, self.rings.cell]
        touched = (far - reach <= self.rings.high) & (far + reach >= self.rings.low)
        return (touched * self.rings.count).sum() <= MET * len(rows) * self.rings.count.sum()

    def targets(self) -> DataFrame:
        """no and v of the targets, those of a ring together, so that few rings matter to neighbouring rows."""
        return self._kept.select("no", "v")

    def ask(self, points: DataFrame, what: str, most: int | None = None) -> DataFrame:
        """Rows for points (no, v, reach), of the targets within their reach; met counts the distances that it took.

        "count": no, n, met. "least": no, least (the smallest number), met. "sums": no, weight (of the targets), moment (the sum
        of weight times distance), met. "each": no, far, w of every target, for the caller to fold, or, if most is told, arrays of
        so many nearest of a chunk's. Points that reach no target have no row.
        """
        schema = _SCHEMAS[what] if most is None else "no long, far array<double>, w array<double>"
        if self.table is None:
            return self.spark.createDataFrame([], schema)
        shared, numbers, d = self.spark.sparkContext.broadcast(self.rings), self.ring, self.d
        counts = what == "count"

        def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rings = shared.value
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    part = batch.slice(k, 512)
                    reach = d.lifted(part.column(2).to_numpy()[:, None])
                    far = d.lifted(d.block(all_rows(part.column(1), rings.pivots.shape[1]), rings.pivots))
                    # what is within reach is hardly further from its own pivot than the nearest pivot of the point is
                    slack = d.slack * (1 + far)
                    own = far <= far.min(1)[:, None] + 2 * reach + 2 * slack
                    some = np.flatnonzero(own.any(0)[rings.cell] & (far.min(0)[rings.cell] - (reach + slack).max() <= rings.high) & (far.max(0)[rings.cell] + (reach + slack).max() >= rings.low))
                    cell, high = rings.cell[some], rings.high[some]
                    far, slack, own = far[:, cell], slack[:, cell], own[:, cell]
                    touched = own & (far - reach - slack <= high) & (far + reach + slack >= rings.low[some])
                    whole = far + high + slack <= reach if counts else np.zeros_like(touched)
                    sure = (whole * rings.count[some]).sum(1)
                    row, ring = np.nonzero(touched & ~whole)
                    ring = some[ring]
                    times = rings.chunks[ring]
                    at = np.repeat(np.arange(len(row)), times)
                    chunk = np.arange(len(at)) - np.repeat(times.cumsum() - times, times)
                    # rings that lie within the ball as a whole are told by a row of no ring
                    own = np.flatnonzero(sure)
                    rows = np.r_[row[at], own]
                    yield pa.record_batch(
                        [pa.array(np.r_[numbers[ring[at]], np.full(len(own), -1)].astype(np.int32)), pa.array(np.r_[chunk, np.zeros(len(own))].astype(np.int32)), *(part.column(c).take(pa.array(rows)) for c in range(3)), pa.array(np.r_[np.zeros(len(at)), sure[own]])],
                        names=["ring", "chunk", "no", "v", "reach", "w"],
                    )

        asked = points.select(F.col("no").cast("long").alias("no"), F.col("v").cast("array<double>").alias("v"), F.col("reach").cast("double").alias("reach"))
        # of an asking row w holds the targets that are sure
        asked = asked.mapInArrow(asks, "ring int, chunk int, no long, v array<double>, reach double, w double")
        there = self.table.select("ring", "chunk", "no", "v", F.lit(None).cast("double").alias("reach"), "w")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, x = None, [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ring, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                target = pc.is_null(batch.column(4)).to_numpy(zero_copy_only=False)
                no, v, w = batch.column(2).to_numpy(), all_rows(batch.column(3)), batch.column(5).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((np.diff(ring) != 0) | (np.diff(chunk) != 0) | (np.diff(target.astype(np.int8)) != 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ring)], strict=True):
                    if ring[a] < 0:
                        yield _found(what, no[a:b], w[a:b].astype(np.int64), np.zeros(b - a, np.int64))
                        continue
                    if (ring[a], chunk[a]) != key:
                        key, held, x = (ring[a], chunk[a]), [], None
                    if target[a]:
                        held.append((no[a:b], v[a:b], w[a:b]))
                        continue
                    if not held:
                        continue
                    if x is None:
                        own, x, heavy = (np.concatenate(c) for c in zip(*held, strict=True))
                    reach = batch.column(4).slice(a, b - a).to_numpy()
                    for k in range(a, b, 512):
                        far = d.block(v[k : min(b, k + 512)], x)
                        near = far <= reach[k - a : k - a + 512, None]
                        if what == "each":
                            row, at = np.nonzero(near)
                            far, weight = far[row, at], heavy[at]
                            if most is not None:
                                order = np.lexsort((weight, far, row))
                                row, far, weight = row[order], far[order], weight[order]
                                starts = np.flatnonzero(np.r_[True, np.diff(row) != 0]) if len(row) else np.zeros(0, np.int64)
                                kept = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)])) < most
                                row, far, weight = row[kept], far[kept], weight[kept]
                                starts = np.flatnonzero(np.r_[True, np.diff(row) != 0]) if len(row) else np.zeros(0, np.int64)
                                ends = pa.array(np.r_[starts, len(row)].astype(np.int32))
                                yield pa.record_batch([pa.array(no[k + row[starts]]), pa.ListArray.from_arrays(ends, pa.array(far)), pa.ListArray.from_arrays(ends, pa.array(weight))], names=["no", "far", "w"])
                                continue
                            yield _found(what, no[k + row], far, weight)
                            continue
                        hit = np.flatnonzero(near.any(1))
                        near, far, met = near[hit], far[hit], np.full(len(hit), len(own))
                        if what == "sums":
                            inside = np.where(near, heavy, 0.0)
                            yield _found(what, no[k + hit], inside.sum(1), (inside * far).sum(1), met)
                        else:
                            yield _found(what, no[k + hit], near.sum(1) if counts else np.where(near, own, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max), met)

        # targets come first in each chunk
        met = there.unionByName(asked).repartition("ring", "chunk").sortWithinPartitions("ring", "chunk", F.asc_nulls_first("reach")).mapInArrow(meet, schema)
        if what == "each":
            return met
        return met.groupBy("no").agg(*[(F.min if c == "least" else F.sum)(c).alias(c) for c in met.columns[1:]])

    def bounds(self, points: DataFrame, k: int) -> DataFrame:
        """points (no, v) with reach: a distance within which k targets lie (all of them, if they are fewer).

        The first bound counts whole rings; the second is the k-th distance within one chunk near the point, if it holds
        so many.
        """
        if self.table is None:
            return points.select("no", "v", F.lit(0.0).alias("reach"))
        shared, numbers, d = self.spark.sparkContext.broadcast(self.rings), self.ring, self.d

        def nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rings = shared.value
            for batch in batches:
                for s in range(0, batch.num_rows, 512):
                    part = batch.slice(s, 512)
                    far = d.lifted(d.block(all_rows(part.column(1), rings.pivots.shape[1]), rings.pivots))
                    # the ring that the point would be in, or the nearest to it of those whose chunks are large enough
                    gaps = lambda least, most: np.maximum(np.maximum(rings.low - most, least - rings.high), 0)
                    low, high = far.min(0)[rings.cell], far.max(0)[rings.cell]
                    enough = rings.count >= k * rings.chunks
                    most = np.where(enough, gaps(high, low) + 1e-3 * high, np.inf).min()
                    some = np.flatnonzero((gaps(low, high) + 1e-3 * low <= most) | ~np.isfinite(most))
                    far = far[:, rings.cell[some]]
                    gap = np.maximum(np.maximum(rings.low[some] - far, far - rings.high[some]), 0) + 1e-3 * far
                    gap = np.where(enough[some], gap, np.inf)
                    ring = some[gap.argmin(1)]
                    yield pa.record_batch([pa.array(numbers[ring].astype(np.int32)), pa.array((part.column(0).to_numpy() % rings.chunks[ring]).astype(np.int32)), part.column(0), part.column(1)], names=["ring", "chunk", "no", "v"])

        points = points.select(F.col("no").cast("long").alias("no"), F.col("v").cast("array<double>").alias("v"))
        asked = points.mapInArrow(nearby, "ring int, chunk int, no long, v array<double>")
        there = self.table.select("ring", "chunk", "no", "v", F.lit(False).alias("asks"))
        met = there.unionByName(asked.withColumn("asks", F.lit(True))).repartition("ring", "chunk").sortWithinPartitions("ring", "chunk", "asks")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, x = None, [], None
            rings = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ring, chunk, asks = (c.to_numpy(zero_copy_only=False) for c in (batch.column(0), batch.column(1), batch.column(4)))
                v = all_rows(batch.column(3))
                cuts = np.flatnonzero((np.diff(ring) != 0) | (np.diff(chunk) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ring)], strict=True):
                    if (ring[a], chunk[a]) != key:
                        key, held, x = (ring[a], chunk[a]), [], None
                    if not asks[a]:
                        held.append(v[a:b])
                        continue
                    if x is None:
                        x = np.concatenate(held) if held else np.zeros((0, v.shape[1]))
                    for s in range(a, b, 512):
                        part = v[s : min(b, s + 512)]
                        if len(x) >= k:
                            # a little further, for distances that hang on the shape of their block
                            reach = np.partition(d.block(part, x), k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-12
                        else:
                            reach = _ring_bounds(d, part, rings, k)
                        yield pa.record_batch([batch.column(2).slice(s, len(part)), batch.column(3).slice(s, len(part)), pa.array(reach)], names=["no", "v", "reach"])

        return met.mapInArrow(meet, "no long, v array<double>, reach double")

    def nearest(self, points: DataFrame, k: int) -> DataFrame:
        """no, far and w (arrays) of the k nearest targets of points (no, v), by growing distance; all of them if they are fewer.

        Ties at the last place fall to the smaller weight. A task passes on k of a point's targets at most.
        """
        found = self.ask(self.bounds(points, k), "each", k)
        pairs = F.flatten(F.collect_list(F.arrays_zip("far", "w")))
        found = found.groupBy("no").agg(F.slice(F.array_sort(pairs), 1, k).alias("s"))
        return found.select("no", F.col("s.far").alias("far"), F.col("s.w").alias("w"))


_SCHEMAS = {
    "count": "no long, n long, met long",
    "least": "no long, least long, met long",
    "sums": "no long, weight double, moment double, met long",
    "each": "no long, far double, w double",
}


def _found(what: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [c.split()[0] for c in _SCHEMAS[what].split(", ")]
    types = [pa.float64() if c.endswith("double") else pa.int64() for c in _SCHEMAS[what].split(", ")]
    return pa.record_batch([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names=names)


def _ring_bounds(d: dist.Distance, x: np.ndarray, rings: Rings, k: int) -> np.ndarray:
    """For each of x a distance within which whole rings of k targets lie; infinite if all rings hold fewer, or the distance is lifted."""
    if d.lift is not None:
        return np.full(len(x), np.inf)
    end = d.block(x, rings.pivots)[:, rings.cell] + rings.high
    order = end.argsort(1, kind="stable")
    held = rings.count[order].cumsum(1)
    first = (held >= k).argmax(1)
    rows = np.arange(len(x))
    reach = end[rows, order[rows, first]]
    return np.where(held[:, -1] >= k, reach * (1 + d.slack) + d.slack, np.inf)
