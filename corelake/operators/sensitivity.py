"""Sensitivity sampling: a small weighted sample that stands for all points.

Points far from their facility, and points of light facilities, are drawn more often and weigh less. Draws come
from hashes of (seed, number), not from a generator's state, so that a repeated task draws the same.
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
from .assign import paired
from .bicriteria import State, chances

#: Partitions of the two-level prefix sum, at least; draws that are sent to every task at most (8 MB).
_PARTS, AT_ONCE = 16, 1 << 20
#: Ids of a leaf of split draws, on average.
BUCKET = 20_000
#: Samples that are united before they are drawn from again.
UNITED = 4


def sampling_distribution(assigned: DataFrame) -> DataFrame:
    """id, rank, dist, w and p from assigned points (id, rank, dist, w): p adds up to 1.

    Points without a facility (a null rank) have no row. p = (w dist / cost + w / (facilities * weight of the facility)) / 2, over facilities that have points. If
    every point lies on its facility the first term is left out.
    """
    assigned = assigned.where("rank is not null")
    by_facility = assigned.groupBy("rank").agg(F.sum("w").alias("wf"), F.sum(F.col("w") * F.col("dist")).alias("cf"))
    # written, so that the sums are made once and their size is known: few are sent to the points, which then stay where they are
    by_facility = written(by_facility.where("wf > 0"), "facility_sums")
    total = by_facility.agg(F.count("*").alias("b"), F.sum("cf").alias("cost"))
    # facilities and one row of totals: bounded by the number of centres
    found = assigned.join(by_facility.select("rank", "wf"), "rank").crossJoin(F.broadcast(total))
    second = F.col("w") / (F.col("b") * F.col("wf"))
    p = F.when(F.col("cost") > 0, 0.5 * (F.col("w") * F.col("dist") / F.col("cost") + second)).otherwise(second)
    return found.select("id", "rank", "dist", "w", p.alias("p"))


def intervals(weighted: DataFrame) -> DataFrame:
    """id, p, lo and hi: the cumulative distribution in order of id; the last hi is 1. Rows of p = 0 are left out.

    Sums are taken in two levels: of ranges of ids, of which a few numbers reach the driver, then within each.
    """
    rows = weighted.where("p > 0").select("id", "p")
    parts = max(_PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written, as the range that an id falls in has to be the same in both passes
    dealt = written(rows.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ranges")
    sums = sorted((r["part"], r["s"], r["top"]) for r in dealt.groupBy("part").agg(F.sum("p").alias("s"), F.max("id").alias("top")).collect())
    if not sums:
        return rows.select("id", "p", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    total = sum(s for _, s, _ in sums)
    starts, at = {}, 0.0
    for part, s, _ in sums:
        starts[part], at = at, at + s
    last = max(top for *_, top in sums)
    base = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("part")]
    order = Window.partitionBy("part").orderBy("id")
    upto = (base + F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0))) / total
    before = (base + F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / total
    return dealt.select("id", (F.col("p") / total).alias("p"), before.alias("lo"), F.when(F.col("id") == last, 1.0).otherwise(upto).alias("hi"))


def uniforms(spark, draws: int, seed: int) -> DataFrame:
    """j and u for j below draws: u in [0, 1) from 52 bits of an MD5 of seed and j."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return spark.range(draws).select(F.col("id").alias("j"), u.alias("u"))


def draw(distribution: DataFrame, draws: int, seed: int = 14537) -> DataFrame:
    """id, n and weight: how often each id is drawn with replacement, and n / (p draws).

    At most AT_ONCE draws are sorted and sent to every task, where each interval finds its own by bisection. Of more,
    interval starts and draws are dealt together to ranges of [0, 1], so that a heavy interval's draws spread over
    several, and sorted there: a draw belongs to the last start before it. Draws before the first start of a range
    belong to the last one of an earlier range; of each range one row tells both to the driver.
    """
    cdf = intervals(distribution)
    if draws <= 0:
        return cdf.select("id", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("weight")).limit(0)
    spark = distribution.sparkSession
    if draws <= AT_ONCE:
        shared = spark.sparkContext.broadcast(np.sort(uniforms(spark, draws, seed).select("u").toPandas()["u"].to_numpy()))

        def found_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lo, hi = (batch.column(k).to_numpy() for k in (2, 3))
                n = np.searchsorted(shared.value, hi) - np.searchsorted(shared.value, lo)
                hit = np.flatnonzero(n)
                part = batch.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n[hit])], names=["id", "p", "n"])

        found = cdf.mapInArrow(found_by, "id long, p double, n long")
        return found.select("id", "n", (F.col("n") / (F.col("p") * draws)).alias("weight"))
    starts = cdf.select(F.col("lo").alias("x"), F.lit(0).alias("kind"), "id", "p")
    points = uniforms(spark, draws, seed).select(F.col("u").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("p"))
    parts = max(_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = starts.unionByName(points).repartitionByRange(parts, "x").sortWithinPartitions("x", "kind", "id").withColumn("part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, early, part = None, 0, None  # the last start (id, p, draws so far); draws before any
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, part = batch.column(1).to_numpy(), batch.column(4)[0].as_py()
            at = np.flatnonzero(kind == 0)
            before = int(at[0]) if len(at) else len(kind)
            if held is None:
                early += before
            else:
                held = (*held[:2], held[2] + before)
            if not len(at):
                continue
            own = np.diff(np.append(at, len(kind))) - 1
            ids, p = (batch.column(k).take(pa.array(at)) for k in (2, 3))
            if held is not None and held[2]:
                yield _drawn(part, [held[0]], [held[1]], [held[2]])
            some = np.flatnonzero(own[:-1])
            if len(some):
                yield _drawn(part, ids.take(pa.array(some)).to_pylist(), p.take(pa.array(some)).to_pylist(), own[some].tolist())
            held = (ids[-1].as_py(), p[-1].as_py(), int(own[-1]))
        if part is not None:  # the last start, also without draws, and the draws before the first
            yield _drawn(part, [held[0] if held else None], [held[1] if held else None], [held[2] if held else 0], early)

    found = written(dealt.mapInArrow(count, "part int, id long, p double, n long, early long"), "draws")
    more, last = [], None
    for r in found.where("early >= 0").orderBy("part").collect():  # one row for each range
        if r["early"] and last:
            more.append((*last, r["early"]))
        last = (r["id"], r["p"]) if r["id"] is not None else last
    more = spark.createDataFrame(more, "id long, p double, n long")
    found = found.where("n > 0").select("id", "p", "n").unionByName(more)
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.first("p").alias("p")).select("id", "n", (F.col("n") / (F.col("p") * draws)).alias("weight"))


def split_draws(distribution: DataFrame, draws: int, seed: int = 14537, n: int | None = None) -> DataFrame:
    """id, n and weight: how often each id is drawn with replacement, and n / (p draws), without moving any draw.

    The ids' hashes span a binary tree. How many of a node's draws fall to its left half is binomial, from a generator
    that the seed and the node's number start; at the leaves, which hold BUCKET ids on average, a multinomial deals them
    to the points in order of id. So exactly so many are drawn, and neither layout nor partitions change the result.
    A number for each leaf reaches the driver, 65,536 at most. Rows that share an id, or whose p is zero or null, are
    left out or points of their own, as their p says. n is the number of rows, counted if it isn't given.
    """
    rows = distribution.where("p > 0").select("id", "p")
    empty = rows.select("id", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("weight")).limit(0)
    if draws <= 0:
        return empty
    n = rows.count() if n is None else n
    depth = min(16, max(0, int(np.ceil(np.log2(max(1, n) / BUCKET)))))
    h = F.xxhash64(F.lit(seed), F.col("id"))
    # whole numbers add up to the same in any order
    whole = F.greatest(F.lit(1), F.round(F.col("p") * float(1 << 52))).cast("long")
    rows = rows.select("id", "p", (F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0)).cast("int").alias("leaf"))
    shares = np.zeros(1 << depth)
    for r in rows.groupBy("leaf").agg(F.sum(whole).alias("s")).collect():
        shares[r["leaf"]] = r["s"]
    if not shares.any():
        return empty
    wanted = {k: int(x) for k, x in enumerate(_split(shares, draws, seed)) if x}  # goes with the function: a number for each leaf

    def deal(rows: pa.Table) -> pa.Table:
        leaf = rows["leaf"][0].as_py()
        ids, p = (rows[c].to_numpy() for c in ("id", "p"))
        share = np.maximum(1.0, np.floor(p * float(1 << 52) + 0.5))  # as whole above
        order = np.lexsort((share, ids))
        rng = np.random.default_rng([seed, leaf, 1])
        times = rng.multinomial(wanted.get(leaf, 0), share[order] / share.sum())
        hit = np.flatnonzero(times)
        return pa.table({"id": pa.array(ids[order][hit], pa.int64(), from_pandas=True), "n": times[hit], "p": p[order][hit]})

    found = rows.groupBy("leaf").applyInArrow(deal, "id long, n long, p double")
    return found.select("id", "n", (F.col("n") / (F.col("p") * draws)).alias("weight"))


def _split(shares: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Draws of each leaf, by binomials from the root down."""
    levels = [shares]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(1))
    counts = np.array([draws], np.int64)
    for depth, level in enumerate(levels[-2::-1]):
        pairs = level.reshape(-1, 2)
        left = np.array([np.random.default_rng([seed, depth, k]).binomial(n, a / (a + b)) if n else 0 for k, (n, (a, b)) in enumerate(zip(counts.tolist(), pairs.tolist(), strict=True))], np.int64)
        counts = np.stack([left, counts - left], 1).ravel()
    return counts


def _drawn(part: int, ids: list, p: list, n: list, early: int = -1) -> pa.RecordBatch:
    """Rows of draws; early is -1 but for the one row of a range that tells the driver."""
    types = (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    columns = ([part] * len(ids), ids, p, n, [early] * len(ids))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "id", "p", "n", "early"])


def summary(points: DataFrame, assigned: DataFrame, fraction: float, seed: int = 14537, n: int | None = None) -> DataFrame:
    """id, weight and v: floor(fraction * n) draws (see split_draws), those of one id merged; vectors are fetched last. n is
    the number of points, counted if it isn't given. Ids are distinct."""
    n = assigned.count() if n is None else n
    chosen = split_draws(sampling_distribution(assigned), int(fraction * n), seed, n)
    return points.select("id", "v").join(chosen, "id").select("id", "weight", "v")


def reduced(points: DataFrame, most: int, k: int, *, beta: float = 2.0, gamma: float = 2.0, distance: str | dist.Distance = "l2", seed: int = 14537) -> DataFrame:
    """id, weight and v: weighted points (id, weight, v) merged and reduced until there are at most so many.

    Points are dealt by a hash of their id to parts of a few times that many; in each part, facilities of one pass give
    the sensitivities, and so many draws stand for the part. Parts are united and drawn from again, level by level,
    the first of them all in parallel. Weights are those of points times the inverse of their share of the draws, so
    sums over all points stay unbiased, and are scaled so that a part keeps its weight. Each level adds the error
    of a sample of that size. Sets within the bound are returned as they are. A null or ragged vector raises.
    """
    d = dist.get(distance)
    points = points.select(F.col("id").cast("long").alias("id"), F.col("weight").cast("double").alias("weight"), F.col("v").cast("array<double>").alias("v"))
    n, level, held = points.count(), 0, None
    while n > most:
        parts = -(-n // (UNITED * most))
        dealt = points.withColumn("part", F.pmod(F.xxhash64(F.lit(level), F.col("id")), F.lit(parts)).cast("int"))

        rule = _reducing(most, k, beta, gamma, d, seed + level)
        points = written(dealt.groupBy("part").applyInArrow(rule, "id long, weight double, v array<double>"), "reduced")
        if held is not None:
            discard(held)
        held, level, left = points, level + 1, points.count()
        if parts == 1 or left >= n:
            break
        n = left
    return points


def _reducing(most: int, k: int, beta: float, gamma: float, d: dist.Distance, seed: int):
    def reduce(rows: pa.Table) -> pa.Table:
        x = all_rows(rows["v"].combine_chunks())
        ids, w = (rows[c].to_numpy() for c in ("id", "weight"))
        order = np.lexsort((*x.T[::-1], ids))  # whatever the layout, also of repeated ids
        ids, w, x = ids[order], w[order], x[order]
        times, weight = sampled(ids, x, w, min(most, len(ids)), k, beta, gamma, d, seed)
        hit = np.flatnonzero(times)
        # null ids and components came as NaN
        return pa.table({"id": pa.array(ids[hit], pa.int64(), from_pandas=True), "weight": weight[hit], "v": lists(x[hit], True)})

    return reduce


def sampled(ids: np.ndarray, x: np.ndarray, w: np.ndarray, draws: int, k: int, beta: float, gamma: float, d: dist.Distance, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each point is drawn, and what it weighs then: the weights add up to those of all points."""
    state = State(k, len(ids), beta, gamma, d)
    state.process(ids, x, w)
    centres = np.array([f[2] for f in state.facilities()])
    step = max(1, (1 << 22) // max(1, len(centres)))
    found = [(f.argmin(1), f.min(1)) for f in (d.block(x[a : a + step], centres) for a in range(0, len(x), step))]
    best, near = (np.concatenate(c) for c in zip(*found, strict=True))
    of = np.bincount(best, w, len(centres))
    cost = float(w @ near)
    p = np.divide(w, (of > 0).sum() * of[best], out=np.zeros(len(w)), where=of[best] > 0)
    p = 0.5 * (w * near / cost + p) if cost > 0 else p
    upto = p.cumsum() / p.sum()
    upto[-1] = 1.0
    times = np.bincount(np.searchsorted(upto, chances(seed, draws, np.arange(draws)), "right"), minlength=len(ids))
    weight = np.divide(w * times, p, out=np.zeros(len(w)), where=times > 0)
    return times, weight * (w.sum() / weight.sum())


def pairwise(points: DataFrame, distance: str | dist.Distance = "l2") -> DataFrame:
    """i, j and d for all ordered pairs, the diagonal 0. For summaries: more than assign.MOST_PAIRED points raise."""
    d = dist.get(distance)
    paired(points)
    a, b = points.select(F.col("id").alias("i"), F.col("v").alias("a")), points.select(F.col("id").alias("j"), F.col("v").alias("b"))
    upper = a.join(b, F.col("i") < F.col("j")).select("i", "j", d.expr(F.col("a"), F.col("b")).alias("d"))
    return upper.unionByName(upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).unionByName(a.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d")))
