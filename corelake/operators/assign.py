"""Facilities: nearest centres, radius matches, sums by facility, label entropies.

Centres are a table of rank (int), center_id and center. They are sent to every task where their values are within
MOST_VALUES (checked); beyond that they are met in blocks, and the least (distance, rank) is kept.
Ties go to the lowest rank. Points without a nearest centre (see nearest) count for no facility.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distance as dist
from ..functions import near
from ..functions.vectors import all_rows, matrix
from ..sources.scratch import written
from .scale import quantiles as value_quantiles

#: Values (centres times dimensions) that are sent to every task at most.
MOST_VALUES = 4_000_000
#: Rows of which all pairs are met at most.
MOST_PAIRED = 50_000
#: Centres from which on most are passed over by pivots; values up to which the JVM's array functions meet them.
MANY, NATIVE = 1024, 1 << 16
#: Points that tell whether pivots pass over enough centres, and the share that they may meet, where rough distances serve.
TRIED, MET = 32, 0.05


def _collected(centres: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(centres.select("rank", "center").collect(), key=lambda r: r["rank"])  # here, as all of them come here
    return np.array([r["rank"] for r in rows], np.int64), np.array([r["center"] for r in rows], np.float64)


def nearest(points: DataFrame, centres: DataFrame, distance: str | dist.Distance = "l2", *, native: bool = False, vectors: bool = True) -> DataFrame:
    """points with rank and dist of the nearest centre; columns of these names are replaced. Without vectors v is left out,
    and doesn't travel back from the workers.

    A vector that is null, of another length than the centres, or without a distance to any of them (a null or NaN
    component) gets null for both. native: by array functions of the JVM alone, if the values of the centres are within
    NATIVE; else by numpy on Arrow batches, many times faster.
    """
    d = dist.get(distance)
    n, width, least = centres.agg(F.count("*"), F.max(F.size("center")), F.min(F.size("center"))).first()
    if n == 0:
        raise ValueError("there are no centres")
    if width != least:
        raise ValueError("the centres differ in length")
    kept = [c for c in points.columns if c not in ("rank", "dist") and (vectors or c != "v")]
    blocks = -(-n * width // MOST_VALUES)
    if native and n * width <= min(NATIVE, MOST_VALUES):
        return _nearest_native(points, centres, d, kept, width)
    # the columns travel in one struct, so that no name of the caller can clash
    others = F.struct(*[F.col(f"`{c}`") for c in kept if c != "v"] or [F.lit(None).cast("int").alias("_")])
    rows = points.select(others.alias("p"), F.col("v").cast("array<double>").alias("v"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("dist"))
    for k in range(blocks):  # a hash deals about MOST_VALUES values to each
        held = _collected(centres if blocks == 1 else centres.where(F.pmod(F.xxhash64("rank"), F.lit(blocks)) == k))
        if len(held[0]):
            rows = _met(rows, d, held, vectors or k < blocks - 1)
    return rows.select(*[F.col("v").cast(points.schema["v"].dataType).alias("v") if c == "v" else F.col(f"p.`{c}`") for c in kept], "rank", "dist")


def _nearest_native(points: DataFrame, centres: DataFrame, d: dist.Distance, kept: list[str], width: int) -> DataFrame:
    packed = centres.agg(F.sort_array(F.collect_list(F.struct("rank", "center"))).alias("c"))  # one row, its size is checked
    rows = points.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("p"), F.when(F.size("v") == width, F.col("v")).alias("v"))
    found = F.transform("c", lambda c: F.struct(d.expr(F.col("v"), c["center"]).alias("dist"), c["rank"].cast("long").alias("rank")))
    best = F.array_min(F.filter(found, lambda x: x["dist"].isNotNull() & ~F.isnan(x["dist"])))
    rows = rows.crossJoin(F.broadcast(packed)).select("p", best.alias("best"))
    return rows.select(*[F.col(f"p.`{c}`") for c in kept], F.col("best.rank").alias("rank"), F.col("best.dist").alias("dist"))


class Pivots:
    """Nearest of many centres by a distance that obeys the triangle inequality: the result of meeting them all.

    Centres go to the nearest of some of them, the pivots. A point meets the group of its nearest pivot first; the
    centres of another group lie no nearer than its pivot less the group's radius, so groups that can't be better or
    equal are passed over. met counts the distances.
    """

    def __init__(self, d: dist.Distance, vectors: np.ndarray):
        self.d, self.met = d, 0
        count = max(1, int(np.sqrt(len(vectors))))
        self.pivots = vectors[np.random.default_rng(5).choice(len(vectors), count, replace=False)]
        of, far = near.nearest(d, vectors, self.pivots)
        self.groups = [np.flatnonzero(of == g) for g in range(count)]  # in order of rank
        self.radius = np.array([far[g].max(initial=-np.inf) for g in self.groups])
        self.vectors = [vectors[g] for g in self.groups]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, distance) of the nearest centre of each row; of equally near ones the first, infinity for none."""
        to = self.d.block(x, self.pivots)
        self.met += to.size
        to = np.where(np.isnan(to), np.inf, to)
        best, place = np.full(len(x), np.inf), np.zeros(len(x), np.int64)

        def meet(rows: np.ndarray, g: int) -> None:
            found = self.d.block(x[rows], self.vectors[g])
            self.met += found.size
            own = found.argmin(1)
            least, at = found[np.arange(len(rows)), own], self.groups[g][own]
            better = (least < best[rows]) | ((least == best[rows]) & (at < place[rows]))
            best[rows], place[rows] = np.where(better, least, best[rows]), np.where(better, at, place[rows])

        first = to.argmin(1)
        for g in np.unique(first).tolist():
            meet(np.flatnonzero((first == g) & np.isfinite(to[:, g])), g)
        slack = 1e-9 * (1 + np.where(np.isfinite(to), to, 0))
        for g in np.argsort(-self.radius).tolist():
            rows = np.flatnonzero(np.isfinite(to[:, g]) & (to[:, g] - self.radius[g] - slack[:, g] <= best) & (first != g))
            if len(rows) and len(self.groups[g]):
                meet(rows, g)
        return place, best


def _met(rows: DataFrame, d: dist.Distance, held: tuple[np.ndarray, np.ndarray], vectors: bool = True) -> DataFrame:
    """rows (p, v, rank, dist; v only with vectors) with the least (dist, rank) of those so far and of the held centres, in order of rank."""
    names = ["p", *["v"] * vectors, "rank", "dist"]
    shared = rows.sparkSession.sparkContext.broadcast(held)
    finite = d.metric and len(held[1]) >= MANY and np.isfinite(held[1]).all()
    rough = near.serves(d, held[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, centers = shared.value
        pivots, tried = Pivots(d, centers) if finite else None, not rough
        for batch in batches:
            x, at = matrix(batch.column(1), centers.shape[1])
            rank = pc.fill_null(batch.column(2), np.iinfo(np.int64).max).to_numpy().copy()
            least = pc.fill_null(batch.column(3), float("inf")).to_numpy().copy()
            if len(x):
                if pivots and not tried:  # vectors without structure meet nearly all centres
                    first, tried = x[:TRIED], True
                    pivots.nearest(first)
                    pivots = pivots if pivots.met <= MET * len(first) * len(centers) else None
                best, new = pivots.nearest(x) if pivots else near.nearest(d, x, centers)
                own = ranks[best]
                better = (new < least[at]) | ((new == least[at]) & (own < rank[at]))
                rank[at], least[at] = np.where(better, own, rank[at]), np.where(better, new, least[at])
            none = np.isinf(least)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(1)] * vectors, pa.array(rank, mask=none), pa.array(least, mask=none)], names=names)

    return rows.mapInArrow(run, rows.select(*names).schema)


def distances(points: DataFrame, centres: DataFrame, distance: str | dist.Distance = "l2", digits: int | None = None) -> DataFrame:
    """id, rank and d: the distance of every point to every centre, rounded to so many digits if they are told.

    Points are never shuffled: centres go to every task, in blocks of MOST_VALUES values. Whole vectors meet them by numpy on
    Arrow batches; those that are null, of another length or hold null or non-finite components, by array functions of the JVM.
    """
    d = dist.get(distance)
    odd = lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.coalesce(F.size("center"), F.lit(-1))
    n, width, least, holes = centres.agg(F.count("*"), F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.min(size), F.lit(0)), F.count_if(odd("center"))).first()
    whole = F.coalesce((F.size("v") == width) & ~odd("v"), F.lit(False)) if width == least > 0 and not holes else F.lit(False)
    blocks, out = max(1, -(-n * width // MOST_VALUES)), None
    for k in range(blocks):
        own = centres if blocks == 1 else centres.where(F.pmod(F.xxhash64("rank"), F.lit(blocks)) == k)
        packed = own.agg(F.collect_list(F.struct("rank", "center")).alias("c"))  # one row, its size is checked
        met = F.transform("c", lambda c: F.struct(c["rank"].alias("rank"), d.expr(F.col("v"), c["center"]).alias("d")))
        rows = points.where(~whole).select("id", "v").crossJoin(F.broadcast(packed)).select("id", F.explode(met).alias("x")).select("id", "x.rank", "x.d")
        rows = rows if digits is None else rows.withColumn("d", F.round("d", digits))
        rows = rows.unionByName(_all_pairs(points.where(whole), own, d, digits)) if width == least > 0 and not holes else rows
        out = rows if out is None else out.unionByName(rows)
    return out


#: Rows of distances that leave a task together.
TOGETHER = 1 << 17


def _all_pairs(points: DataFrame, centres: DataFrame, d: dist.Distance, digits: int | None) -> DataFrame:
    """id, rank and d of all points and the centres, by numpy on Arrow batches."""
    held = _collected(centres)
    shared = points.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, vectors = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, step := max(1, TOGETHER // max(1, len(ranks)))):
                part = batch.slice(k, step)
                found = d.block(all_rows(part.column(1), vectors.shape[1]), vectors)
                if digits is not None:
                    found = np.copysign(np.floor(np.abs(found) * 10.0**digits + 0.5) / 10.0**digits, found)
                yield pa.record_batch([part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(ranks)))), pa.array(np.tile(ranks, part.num_rows)), pa.array(found.ravel())], names=["id", "rank", "d"])

    schema = T.StructType([points.schema["id"], T.StructField("rank", T.LongType()), T.StructField("d", T.DoubleType())])
    rows = points.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, schema)
    return rows.withColumn("rank", F.col("rank").cast(centres.schema["rank"].dataType))


def within(points: DataFrame, centres: DataFrame, radius: float, distance: str | dist.Distance = "l2") -> DataFrame:
    """points with matched added (a column of that name is replaced): whether some centre lies at most radius away."""
    kept = [c for c in points.columns if c != "matched"]
    found = nearest(_carried(points), centres, distance)
    return found.select(*[F.col(f"p.`{c}`") for c in kept], F.coalesce(F.col("dist") <= radius, F.lit(False)).alias("matched"))


def _carried(points: DataFrame) -> DataFrame:
    """v, w if there is one, and all columns in a struct p, so that none of the caller's clashes with a new one."""
    own = [F.col("w")] if "w" in points.columns else []
    return points.select("v", *own, F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("p"))


def dispatch(points: DataFrame, centres: DataFrame, distance: str | dist.Distance = "l2", *, native: bool = False) -> DataFrame:
    """rank, center_id, center, weight and cost of every facility; one without points has weight and cost 0."""
    found = nearest(points, centres, distance, native=native)
    sums = found.groupBy("rank").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("dist")).alias("cost"))
    return centres.select(F.col("rank").cast("long").alias("rank"), "center_id", "center").join(sums, "rank", "left").fillna(0.0, ["weight", "cost"])


def totals(facilities: DataFrame) -> DataFrame:
    """One row: facilities, weight and cost of all."""
    return facilities.agg(F.count("*").alias("facilities"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def label_histogram(points: DataFrame, centres: DataFrame, label: str, distance: str | dist.Distance = "l2") -> DataFrame:
    """rank, label and n: points of each label at each facility."""
    found = nearest(_carried(points), centres, distance).where("rank is not null")
    return found.groupBy("rank", F.col(f"p.`{label}`").alias("label")).agg(F.count("*").alias("n"))


def dispatch_labels(points: DataFrame, centres: DataFrame, label: str, distance: str | dist.Distance = "l2") -> DataFrame:
    """rank, weight, cost, n and entropy (natural logarithm, of the unweighted label counts) of each facility with points."""
    found = nearest(_carried(points), centres, distance).where("rank is not null")
    by_label = found.groupBy("rank", F.col(f"p.`{label}`").alias("label")).agg(F.count("*").alias("c"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("dist")).alias("cost"))
    n = F.sum("c")
    entropy = F.greatest(F.lit(0.0), F.log(n) - F.sum(F.col("c") * F.log("c")) / n)
    return by_label.groupBy("rank").agg(F.sum("w").alias("weight"), F.sum("cost").alias("cost"), n.alias("n"), entropy.alias("entropy"))


def mean_entropy(dispatched: DataFrame) -> DataFrame:
    """One row: the facilities' entropies, averaged by weight."""
    return dispatched.agg((F.sum(F.col("weight") * F.col("entropy")) / F.sum("weight")).alias("entropy"))


def weighted_data(facilities: DataFrame) -> DataFrame:
    """Facilities as points: id, v, w."""
    return facilities.select(F.col("center_id").cast("long").alias("id"), F.col("center").alias("v"), F.col("weight").alias("w"))


def facility(facilities: DataFrame, rank: int) -> DataFrame:
    """The facility of a rank: its row, or none."""
    return facilities.where(F.col("rank") == rank)


def insert_facility(centres: DataFrame, id: int, vector: list[float]) -> DataFrame:
    """centres with one more of the next free rank."""
    top = centres.agg(F.coalesce(F.max("rank") + 1, F.lit(0)).cast("long").alias("rank"))
    new = top.select("rank", F.lit(id).cast("long").alias("center_id"), F.array(*map(F.lit, map(float, vector))).alias("center"))
    return centres.select(F.col("rank").cast("long").alias("rank"), F.col("center_id").cast("long").alias("center_id"), F.col("center").cast("array<double>").alias("center")).unionByName(new)


def mean_costs(facilities: DataFrame) -> DataFrame:
    """rank, weight, cost and mean (cost by weight, null without weight) of each facility: what a log of them shows."""
    return facilities.select("rank", "weight", "cost", F.when(F.col("weight") > 0, F.col("cost") / F.col("weight")).alias("mean"))


def paired(rows: DataFrame) -> None:
    """Raises if all pairs of the rows are too many."""
    if rows.limit(MOST_PAIRED + 1).count() > MOST_PAIRED:
        raise ValueError(f"more than {MOST_PAIRED} rows: all their pairs are not met")


def cross_distances(centres: DataFrame, distance: str | dist.Distance = "l2", quantiles: tuple[float, ...] = (0.01, 0.05, 0.1, 0.5, 0.75)) -> DataFrame:
    """q and dist: quantiles of the distances between different centres; no rows if there are fewer than two.

    Each pair is met once: for sets as summaries and facility location give. More than MOST_PAIRED centres raise, since
    the pairs are their square: look at samples of larger sets (see scale.pair_quantiles).
    """
    d = dist.get(distance)
    paired(centres)
    a, b = centres.select(F.col("rank").alias("i"), F.col("center").alias("a")), centres.select(F.col("rank").alias("j"), F.col("center").alias("b"))
    pairs = a.join(b, F.col("i") < F.col("j")).select(d.expr(F.col("a"), F.col("b")).alias("d"))
    pairs = written(pairs, "pairs")
    both = pairs.unionByName(pairs)  # either way round, as the quantiles are of ordered pairs
    return value_quantiles(both, "d", quantiles).withColumnRenamed("value", "dist")
