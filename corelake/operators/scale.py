"""Scales of a dataset: quantiles of distances between hashed pairs, and of weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as dist
from ..sources.scratch import discard, written
from .bicriteria import chances

PAIRS = (0.0001, 0.001, 0.01, 0.5, 0.99, 0.999)
CHECKED = (0.005, 0.01, 0.025, 0.25, 0.5, 0.75, 0.99)
WEIGHTS = (0.01, 0.025, 0.05, 0.5, 0.75, 0.99)
DISTANCES = (0.0001, 0.001, 0.01, 0.025, 0.05, 0.5, 0.75, 0.99)


#: Values whose quantiles one task finds; those of more are found in ranges, with the same result.
IN_ONE_TASK = 1_000_000


def quantiles(df: DataFrame, column: str, at: tuple[float, ...], exact: bool = True) -> DataFrame:
    """q and value, linear between neighbours; exact ones are of all values, others of a sketch of a fixed size.

    Nulls don't count; without values there are no rows.
    """
    if exact:
        values = written(df.select(F.col(column).cast("double").alias("x")).where("x is not null"), "values")  # computed once
        if values.count() > IN_ONE_TASK:
            found = _by_ranges(values, at)
            discard(values)
            return found
        df, column = values, "x"
    found = F.percentile(column, F.array(*map(F.lit, at))) if exact else F.percentile_approx(column, list(at), 10_000)
    row = df.agg(found.alias("x")).where("x is not null")
    return row.select(F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("q"), "x")).alias("z")).select(F.col("z.q").alias("q"), F.col("z.x").alias("value"))


def _by_ranges(values: DataFrame, at: tuple[float, ...]) -> DataFrame:
    """Different values x are dealt to ranges with their counts, which tell in which range, and where there, a quantile's
    neighbours stand: one value that fills half of the table is one row."""
    spark = values.sparkSession
    rows = values.groupBy("x").agg(F.count("*").alias("c")).repartitionByRange("x").withColumn("part", F.spark_partition_id())
    rows = written(rows, "ranges")
    counts = sorted((r["part"], r["c"]) for r in rows.groupBy("part").agg(F.sum("c").alias("c")).collect())
    n = sum(c for _, c in counts)
    starts = np.cumsum([0, *(c for _, c in counts)])
    places = sorted({int(f(q * (n - 1))) for q in at for f in (np.floor, np.ceil)})
    range_of = {p: int(np.searchsorted(starts, p, "right") - 1) for p in places}
    wanted = spark.createDataFrame([(counts[k][0], p - int(starts[k]), p) for p, k in range_of.items()], "part int, own long, place long")
    upto = rows.withColumn("upto", F.sum("c").over(Window.partitionBy("part").orderBy("x")))
    found = upto.join(F.broadcast(wanted), "part").where("own < upto and own >= upto - c").collect()  # two rows for each quantile
    value = {r["place"]: r["x"] for r in found}
    discard(rows)

    def between(q: float) -> float:
        low, high = value[int(np.floor(q * (n - 1)))], value[int(np.ceil(q * (n - 1)))]
        return low + (high - low) * (q * (n - 1) - np.floor(q * (n - 1)))

    return spark.createDataFrame([(float(q), float(between(q))) for q in at], "q double, value double")


def sketches(df: DataFrame, column: str, *by: str, size: int = 400) -> DataFrame:
    """The columns by, n, and sketch: a KLL sketch of the column's values in each group, combined before the shuffle.

    Ranks read from a sketch are off by about 1.65 / size of the values, however many there are; up to about size values
    it is exact. Nulls don't count. A group's sketches may be merged with those of other parts, days or shards.
    """
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.kll_sketch_agg_double(F.col(column).cast("double"), size).alias("sketch"))


def merged_sketches(parts: DataFrame, *by: str) -> DataFrame:
    """One sketch for each group of the columns by, from those of its parts (n and sketch)."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(found: DataFrame, at: tuple[float, ...]) -> DataFrame:
    """The groups' columns, q and value: the least value whose rank reaches q; groups without values have no rows."""
    value = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, at)))
    kept = [c for c in found.columns if c not in ("n", "sketch")]
    pairs = F.arrays_zip(F.array(*map(F.lit, at)).alias("q"), value.alias("x"))
    return found.where("n > 0").select(*kept, F.explode(pairs).alias("z")).select(*kept, F.col("z.q").alias("q"), F.col("z.x").alias("value"))


def hashed_pairs(points: DataFrame, pairs: int, distance: str | dist.Distance = "l2", seed: int = 7) -> DataFrame:
    """d of so many pairs of different points, at most: the places of both come from hashes of the pair's number.

    Points take part through a bounded sample of theirs, those of the smallest hashes of id.
    """
    d = dist.get(distance)
    sample = min(pairs, 10_000)
    chosen = points.select("id", "v").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(sample).orderBy("id").collect()
    spark, n = points.sparkSession, len(chosen)
    if n < 2:
        return spark.createDataFrame([], "d double")
    placed = spark.createDataFrame([(k, r["v"]) for k, r in enumerate(chosen)], "place long, v array<double>")
    place = lambda side: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{side}"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("long"), F.lit(n))
    numbers = spark.range(pairs).select(place("a").alias("i"), place("b").alias("j")).where("i != j")
    left = numbers.join(placed.withColumnsRenamed({"place": "i", "v": "a"}), "i")
    return left.join(placed.withColumnsRenamed({"place": "j", "v": "b"}), "j").select(d.expr(F.col("a"), F.col("b")).alias("d"))


def pair_quantiles(points: DataFrame, pairs: int = 10_000, at: tuple[float, ...] = PAIRS, distance: str | dist.Distance = "l2", seed: int = 7) -> DataFrame:
    return quantiles(hashed_pairs(points, pairs, distance, seed), "d", at)


def check_distances(points: DataFrame, distance: str | dist.Distance = "l2", *, first: int = 1000, pairs: int = 50_000, seed: int = 7) -> DataFrame:
    """q and value: quantiles of the distances of so many hashed pairs among the first points by id.

    A quick look at a table's scale, of which sampling is the point: first and pairs bound it.
    """
    return quantiles(hashed_pairs(points.orderBy("id").limit(first), pairs, distance, seed), "d", CHECKED)


def summary_scales(summary: DataFrame, distance: str | dist.Distance = "l2", *, pairs: int = 10_000, seed: int = 2833) -> DataFrame:
    """kind, q and value: quantiles of a summary's weights (all), and of the distances of at most so many hashed pairs."""
    n = summary.count()
    weights = quantiles(summary, "weight", WEIGHTS).select(F.lit("weight").alias("kind"), "q", "value")
    between = quantiles(hashed_pairs(summary, min(pairs, n * (n - 1) // 2), distance, seed), "d", DISTANCES)
    return weights.unionByName(between.select(F.lit("distance").alias("kind"), "q", "value"))


def neighbourhood_size(points: DataFrame, q: float, distance: str | dist.Distance = "l2") -> float:
    """The q-quantile, over the first few points, of the distance to the second nearest of a few partners of each one's own.

    Few is the logarithm of the number of points; a point's partners are those of the smallest hashes of both ids. Tables
    of fewer than four points give the largest distance.
    """
    d = dist.get(distance)
    n = points.count()
    if n < 2:
        return 0.0
    few = max(2, n.bit_length() - 1)
    first = points.select("id", "v").orderBy("id").limit(few).collect()
    shared = points.sparkSession.sparkContext.broadcast([r["id"] for r in first])

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for k, own in enumerate(shared.value):
                u = np.where(ids == own, np.inf, chances(own, 1, ids))
                near = np.argsort(u, kind="stable")[: few + 2]
                near = near[np.isfinite(u[near])]
                yield pa.record_batch([pa.array(np.full(len(near), k, np.int32)), pa.array(u[near]), *(c.take(pa.array(near)) for c in batch.columns)], names=["k", "u", "id", "v"])

    met = points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(partners, "k int, u double, id long, v array<double>")
    met = met.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("u", "id"))).where(F.col("n") <= few + 2)
    own: dict[int, list] = {}
    for r in met.orderBy("k", "n").collect():  # few rows for each of a few points
        own.setdefault(r["k"], []).append(r["v"])
    found = [np.sort(d.block(np.array([first[k]["v"]]), np.array(rest))[0]) for k, rest in own.items()]
    return float(np.quantile([x[min(1, len(x) - 1)] for x in found], q)) if found else 0.0
