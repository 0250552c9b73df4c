"""Facility location by ball radii: a point opens a facility unless one lies within twice its radius.

Radii are found for all points in parallel. The choice takes points by growing radius, ties in order of a hash of the
id. A set within a checked size is settled in one task. A larger one is settled in rounds, in all of which the result is
that of the sequential rule: a point opens when no undecided point or facility that comes before it lies within its
range, and is covered when the first one there is a facility. For distances that obey the triangle inequality, or have a
lift that does, as cosine has, what lies within a range is found by an index (see balls) and weighted radii by its
nearest ones, else, and where the index would meet too much of vectors without structure, points meet all others in
blocks that are sent to every task.
Points are validated (see sources.points): a null or ragged vector raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as dist
from ..functions import near as close
from ..functions.vectors import all_rows, lists, stacked
from ..sources.scratch import discard, written
from .assign import dispatch, nearest
from .balls import TRIED, BallIndex
from .bicriteria import log2_floor
from .scale import neighbourhood_size

#: Points that one task settles in turn; points that are sent to every task at once, and blocks that one job meets.
SETTLED, SAMPLED, TOGETHER = 50_000, 20_000, 16


def estimated_radii(points: DataFrame, scale: float, distance: str | dist.Distance = "l2", seed: int = 123) -> DataFrame:
    """points with r (a column of that name is replaced): scale / 2**j for the largest j such that a ball of that radius seems to hold 2**j points.

    Each level counts over a shared sample of 2 n r / (scale log2 n) points, of the smallest hashes, all of
    which are met, in blocks.
    """
    d = dist.get(distance)
    # the caller's columns travel in one struct, so that none can clash
    kept = [c for c in points.columns if c != "r"]
    rows = points.select("id", F.col("v").cast("array<double>").alias("v"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("p"))
    n = rows.count()
    levels = max(1, log2_floor(n))
    sizes = [int(2 * (n / 2**j) / levels) for j in range(levels + 1)]
    # a place of its own for each point, also where ids repeat
    if d.bounded and sizes[1] > SAMPLED and (found := _radii_by_levels(rows, d, sizes, scale, seed)) is not None:
        return found.select(*[F.col("v").cast(points.schema["v"].dataType).alias("v") if c == "v" else F.col(f"p.`{c}`") for c in kept], "r")
    sample = written(rows.select(F.xxhash64(F.lit(seed), F.col("id")).alias("h"), "id", F.monotonically_increasing_id().alias("no"), "v"), "sample")
    counted = rows.withColumn("n", F.array_repeat(F.lit(0).cast("long"), levels))
    start, last, blocks, held = 0, None, 0, None
    while start < sizes[1]:
        rest = sample if last is None else sample.where(_after(last, "h", "id", "no"))
        block = rest.orderBy("h", "id", "no").limit(min(SAMPLED, sizes[1] - start)).collect()
        counted = _counted(counted, d, stacked([r["v"] for r in block]), [s - start for s in sizes[1:]], scale)
        start, last = start + len(block), block[-1]
        blocks += 1
        if blocks % TOGETHER == 0:  # so that a job holds so many blocks at most
            old, counted = held, written(counted, "counts")
            held = counted
            if old is not None:
                discard(old)
    discard(sample)
    r = F.lit(float(scale))
    for j in range(1, levels + 1):
        r = F.when(F.col("n")[j - 1] + 1 >= 2**j, scale / 2**j).otherwise(r)
    return counted.select(*[F.col("v").cast(points.schema["v"].dataType).alias("v") if c == "v" else F.col(f"p.`{c}`") for c in kept], r.alias("r"))


def _radii_by_levels(rows: DataFrame, d: dist.Distance, sizes: list[int], scale: float, seed: int) -> DataFrame | None:
    """rows with r, from the level of the smallest radius on: points that have enough neighbours there are settled. None where
    the index passes over too little of the largest level."""
    rows = written(rows.withColumn("no", F.monotonically_increasing_id()), "points")
    order = placed(rows.select(F.xxhash64(F.lit(seed), F.col("id")).alias("h"), "id", "no"), "h", "id", "no")
    sample = written(rows.select("no", "v").join(order.where(F.col("place") < sizes[1]).select("no", "place"), "no"), "sample")
    left = rows.select("no", "v")
    index = BallIndex(sample.select("no", "v"), d)
    serves = index.serves(left.withColumn("reach", F.lit(scale / 2)))
    index.drop()
    if not serves:
        discard(rows, sample)
        return None
    settled, read = None, [rows, sample]
    for j in range(len(sizes) - 1, 0, -1):
        index = BallIndex(sample.where(F.col("place") < sizes[j]).select("no", "v"), d)
        found = index.ask(left.withColumn("reach", F.lit(scale / 2**j)), "count")
        found = written(left.join(found.select("no", "n"), "no", "left").withColumn("enough", F.coalesce("n", F.lit(0)) + 1 >= 2**j), "levels")
        index.drop()
        read.append(found)
        own = found.where("enough").select("no", F.lit(scale / 2**j).alias("r"))
        settled = own if settled is None else settled.unionByName(own)
        left = found.where("not enough").select("no", "v")
    settled = settled.unionByName(left.select("no", F.lit(float(scale)).alias("r")))
    out = written(rows.join(settled, "no").drop("no"), "radii")
    discard(*read)
    return out


def placed(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with place, from 0 in order of the columns: by counts of ranges of which a few numbers reach the driver."""
    dealt = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    dealt = written(dealt.withColumns({"part": F.spark_partition_id(), "own": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "placed")
    starts, at = [], 0
    for part, count in sorted(map(tuple, dealt.groupBy("part").count().collect())):
        starts.append((part, at))
        at += count
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long"))
    return dealt.join(starts, "part").withColumn("place", F.col("start") + F.col("own")).drop("part", "own", "start")


def _counted(points: DataFrame, d: dist.Distance, block: np.ndarray, sizes: list[int], scale: float) -> DataFrame:
    """points with n added to: for each level j from 1, how many of the first sizes[j - 1] of block lie within scale / 2**j."""
    shared = points.sparkSession.sparkContext.broadcast(block)
    at, own = points.columns.index("v"), points.columns.index("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = all_rows(batch.column(at)), batch.column(own).flatten().to_numpy().reshape(batch.num_rows, -1)
            n = n + close.counts(d, x, shared.value, [(size, scale / 2**j) for j, size in enumerate(sizes, 1)])
            columns = list(batch.columns)
            columns[own] = lists(n)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return points.mapInArrow(run, points.schema)


def _after(row, *columns: str) -> Column:
    """Whether the columns come after those of row, compared in turn."""
    out = F.lit(False)
    for c in reversed(columns):
        out = (F.col(c) > row[c]) | ((F.col(c) == row[c]) & out)
    return out


def _blocks(points: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors and weights of all points (no: a place of its own for each), SAMPLED at a time in order of place."""
    last = None
    while rows := (points if last is None else points.where(F.col("no") > last)).orderBy("no").limit(SAMPLED).collect():
        yield stacked([r["v"] for r in rows]), np.array([r["w"] for r in rows])
        last = rows[-1]["no"]


def _met(points: DataFrame, state: DataFrame, d: dist.Distance, update) -> DataFrame:
    """state (no, v, s: array of numbers) after update(s, x, vectors, weights) for each block of points, on Arrow batches."""
    held = None
    for k, block in enumerate(_blocks(points), 1):
        shared = state.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vectors, weights = shared.value
            for batch in batches:
                if batch.num_rows:
                    s = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                    s = update(s, all_rows(batch.column(1), vectors.shape[1]), vectors, weights)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(s)], names=["no", "v", "s"])

        state = state.mapInArrow(run, state.schema)
        if k % TOGETHER == 0:  # so that a job holds so many blocks at most
            old, state = held, written(state, "radii")
            held = state
            if old is not None:
                discard(old)
    return state


def weighted_radii(points: DataFrame, alfa: float, distance: str | dist.Distance = "l2", *, at_once: int = SAMPLED) -> DataFrame:
    """id, v, w and r: the r at which a point's ball is worth alfa times that of its log2 n nearest.

    The worth of a ball is sum of w (r - d) over the points d away, d <= r: a convex function of r. If alfa is at most 1 the
    nearest ones hold r as well; else Newton's steps follow until no r changes. Up to at_once points meet all others
    in each pass; of more, the nearest ones and what lies within r are found by an index, if the distance has bounds, and
    only points whose r changed take another step. Points that share an id are points of their own.
    """
    d = dist.get(distance)
    points = written(points.select("id", F.col("v").cast("array<double>").alias("v"), "w", F.monotonically_increasing_id().alias("no")), "points")
    n = points.count()
    place = min(n, max(1, log2_floor(max(1, n))) + 1)
    index = BallIndex(points.select("no", "v", "w"), d) if d.bounded and n > at_once else None

    if index is not None:
        some = points.select("no", "v").orderBy(F.xxhash64("no"), "no").limit(TRIED)
        if not index.serves(index.bounds(some, place)):
            index.drop()
            index = None

    def nearest_of(s: np.ndarray, x: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
        # s: distances, then weights, of the place nearest so far
        return np.concatenate(close.smallest(d, x, vectors, s[:, :place], s[:, place:], weights), 1)

    if index is not None:
        near = index.nearest(index.targets(), place)
        state = points.select("no", "v").join(near.select("no", F.concat("far", "w").alias("s")), "no")
    else:
        state = points.select("no", "v", F.concat(F.array_repeat(F.lit(float("inf")), place), F.array_repeat(F.lit(0.0), place)).alias("s"))
        state = _met(points, state, d, nearest_of)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            far, w = s[:, :place], s[:, place:]
            sw, swd = w.cumsum(1), (w * far).cumsum(1)
            value = far * sw - swd
            target = alfa * value[:, -1]
            k = (value <= target[:, None]).cumsum(1).argmax(1)  # the last place whose value is within the target
            rows = np.arange(len(s))
            weight = sw[rows, k]
            r = np.divide(target + swd[rows, k], weight, out=np.zeros(len(s)), where=weight > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(np.stack([r, target, r, r], 1))], names=["no", "v", "s"])

    state = state.mapInArrow(solve, state.schema)  # s: r, target, and two sums of the next step
    if alfa > 1:
        state = _newton(points, state, d, index)
    out = points.join(state.select("no", F.col("s")[0].alias("r")), "no").drop("no")
    if index is None:
        return out
    out = written(out, "radii")
    index.drop()
    return out


def _newton(points: DataFrame, state: DataFrame, d: dist.Distance, index: BallIndex | None) -> DataFrame:
    """state (no, v, s: r, target, two more) after steps until no r changes. From the right of the root they fall, from its
    left the first one leads to its right."""
    still = None
    while True:
        state = written(state, "radii")

        def sums(s: np.ndarray, x: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
            s = s.copy()
            for k in range(0, len(x), 128):
                found = d.block(x[k : k + 128], vectors)
                inside = np.where(found <= s[k : k + 128, :1], weights, 0.0)
                s[k : k + 128, 2:] += np.stack([inside.sum(1), (inside * found).sum(1)], 1)
            return s

        cleared = state.select("no", "v", F.array(F.col("s")[0], F.col("s")[1], F.lit(0.0), F.lit(0.0)).alias("s"))
        if index is not None:
            found = index.ask(state.select("no", "v", F.col("s")[0].alias("reach")), "sums").select("no", "weight", "moment")
            whole = F.array(F.col("s")[0], F.col("s")[1], F.coalesce("weight", F.lit(0.0)), F.coalesce("moment", F.lit(0.0)))
            met = state.join(found, "no", "left").select("no", "v", whole.alias("s"))
        else:
            met = _met(points, cleared, d, sums)
        r = F.when(F.col("s")[2] > 0, (F.col("s")[1] + F.col("s")[3]) / F.col("s")[2]).otherwise(0.0)
        new = written(met.select("no", "v", F.array(r, F.col("s")[1], F.col("s")[0], F.lit(0.0)).alias("s")), "radii")
        discard(state)
        moved = F.abs(F.col("s")[0] - F.col("s")[2]) > 1e-12 * F.abs(F.col("s")[0])
        if index is not None:  # settled points ask no more
            own = new.where(~moved)
            still = own if still is None else still.unionByName(own)
        state = new if index is None else new.where(moved)
        if new.where(moved).isEmpty():
            return new if index is None else still


def choose(points: DataFrame, distance: str | dist.Distance = "l2") -> DataFrame:
    """Facilities (rank, center_id, center) from points (id, v, r), by growing radius, ties by a hash of the id, then by id
    and place in the table."""
    d = dist.get(distance)
    rows = points.select("id", F.col("v").cast("array<double>").alias("v"), F.col("r").cast("double").alias("r"), F.xxhash64("id").alias("h"))
    rows = rows.withColumn("no", F.monotonically_increasing_id())
    n = points.count()
    if n <= SETTLED:
        return written(_in_turn(rows, d, "r", "h", "id", "no").select("rank", F.col("id").alias("center_id"), F.col("v").alias("center")), "chosen")
    left = written(placed(rows, "r", "h", "id", "no").drop("no", "h").withColumnRenamed("place", "no"), "undecided")
    index = BallIndex(left.select("no", "v"), d) if d.bounded else None
    by_rounds = index is not None and index.serves(left.select("no", "v", (2 * F.col("r")).alias("reach")))
    if index is not None:
        index.drop()
    found = _by_rounds(left, d, n) if by_rounds else _by_parts(left, d, n)
    ranks = placed(found.select("no"), "no").withColumnRenamed("place", "rank")
    return ranks.join(found, "no").select("rank", F.col("id").alias("center_id"), F.col("v").alias("center"))


def _by_rounds(left: DataFrame, d: dist.Distance, n: int) -> DataFrame:
    """The facilities among points (id, v, r, no in order), found by local decisions until few are undecided."""
    found = None
    while n > SETTLED:
        open_ = left if found is None else left.unionByName(found)
        index = BallIndex(open_.select("no", "v"), d)
        least = index.ask(left.select("no", "v", (2 * F.col("r")).alias("reach")), "least").select("no", "least")
        # each point is within its own range, whatever rounding says
        judged = written(left.join(least, "no", "left").withColumn("least", F.least("least", "no")), "judged")
        index.drop()
        new = judged.where("least = no").drop("least")
        found = written(new if found is None else found.unionByName(new), "facilities")
        covering = found.select(F.col("no").alias("least"))
        rest = judged.where("least < no").join(covering, "least", "left_anti").drop("least")
        old, left = left, written(rest, "undecided")
        discard(old, judged)
        n = left.count()
    # what facilities cover that are not the first in reach
    index = BallIndex(found.select("no", "v"), d)
    covered = index.ask(left.select("no", "v", (2 * F.col("r")).alias("reach")), "least").select("no")
    rest = written(left.join(covered, "no", "left_anti"), "undecided")
    index.drop()
    discard(left)
    return written(found.unionByName(_in_turn(rest, d, "no").drop("rank")), "chosen")


def _by_parts(left: DataFrame, d: dist.Distance, n: int) -> DataFrame:
    """The same for any distance: the first points in turn in one task, then all that they cover dropped in parallel."""
    found = None
    while n:
        first = left.orderBy("no").limit(SETTLED)
        new = written(_in_turn(first, d, "no"), "facilities")
        found = new.drop("rank") if found is None else found.unionByName(new.drop("rank"))
        last = first.agg(F.max("no")).first()[0]
        later = nearest(left.where(F.col("no") > last), new.select("rank", F.col("id").alias("center_id"), F.col("v").alias("center")), d)
        old, left = left, written(later.where(F.col("dist") > 2 * F.col("r")).drop("rank", "dist"), "undecided")
        discard(old)
        n = left.count()
    return found


def _in_turn(left: DataFrame, d: dist.Distance, *order: str) -> DataFrame:
    """The points that the sequential rule opens, and their rank, in one task, which holds the facilities and passes over the points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                x, reach = all_rows(part.column(1)), 2 * part.column(2).to_numpy()
                near = np.full(len(x), np.inf) if held is None else close.nearest(d, x, held)[1]
                new = []
                for k in range(len(x)):
                    if near[k] > reach[k]:
                        new.append(k)
                        near[k:] = np.minimum(near[k:], d.block(x[k:], x[k : k + 1])[:, 0])
                ranks = np.arange(len(new)) + (0 if held is None else len(held))
                held = x[new] if held is None else np.concatenate([held, x[new]])
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(new, pa.int64())).columns[:4], pa.array(ranks)], names=["id", "v", "r", "no", "rank"])

    first = left.select("id", "v", "r", "no", *(F.col(c).alias(f"_{c}") for c in order)).coalesce(1).sortWithinPartitions(*(f"_{c}" for c in order))
    return first.mapInArrow(run, "id long, v array<double>, r double, no long, rank long").select(*[c for c in left.columns if c != "h"], "rank")


def apart(facilities: DataFrame, distance: str | dist.Distance = "l2") -> DataFrame:
    """rank and apart of facilities (rank, v, r): whether it lies further from all others than twice the larger radius.

    All pairs are met, in blocks of SAMPLED that are sent to every task.
    """
    d = dist.get(distance)
    rows = facilities.select("rank", F.col("v").cast("array<double>").alias("v"), "r", F.lit(True).alias("apart"))
    met, last = rows, None
    while block := (rows if last is None else rows.where(F.col("rank") > last)).orderBy("rank").limit(SAMPLED).collect():
        last = block[-1]["rank"]
        shared = rows.sparkSession.sparkContext.broadcast((np.array([b["rank"] for b in block]), stacked([b["v"] for b in block]), np.array([b["r"] for b in block])))
        met = _apart(met, shared, d)
    return met.select("rank", "apart")


def _apart(rows: DataFrame, shared, d: dist.Distance) -> DataFrame:
    """rows (rank, v, r, apart) after they have met the shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, vectors, radii = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                found = d.block(all_rows(part.column(1), vectors.shape[1]), vectors)
                rank, r, ok = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
                fine = (found > 2 * np.maximum(r[:, None], radii)) | (rank[:, None] == ranks)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ok & fine.all(1))], names=["rank", "v", "r", "apart"])

    return rows.mapInArrow(run, rows.schema)


def facilities(points: DataFrame, alfa: float = 1.0, distance: str | dist.Distance = "l2", seed: int = 123) -> DataFrame:
    """Facilities of unweighted points, by estimated radii on the scale of alfa times a neighbourhood."""
    return choose(estimated_radii(points, alfa * neighbourhood_size(points, 0.999, distance), distance, seed), distance)


def weighted_facilities(points: DataFrame, alfa: float = 0.5, distance: str | dist.Distance = "l2", *, weighted: bool = True) -> DataFrame:
    """Facilities of weighted points with their weights and costs; a larger alfa opens fewer."""
    centres = choose(weighted_radii(points, alfa, distance), distance)
    return dispatch(points if weighted else points.withColumn("w", F.lit(1.0)), centres, distance)
