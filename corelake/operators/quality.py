"""Agreement of two clusterings: contingency table, entropies, normalised mutual information."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of the hypergeometric sum that are taken together; logarithms below which a term is zero in doubles.
TERMS, LEAST = 1 << 16, -745.0


def contingency(first: DataFrame, second: DataFrame) -> DataFrame:
    """l1, l2 and n from two tables of id and label, over the ids of both."""
    return first.select("id", F.col("label").alias("l1")).join(second.select("id", F.col("label").alias("l2")), "id").groupBy("l1", "l2").agg(F.count("*").alias("n"))


def _entropy(count: Column, total: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(total) - F.sum(count * F.log(count)) / total)


def row_entropies(table: DataFrame) -> DataFrame:
    """l1, n and the entropy of the row's distribution."""
    return table.groupBy("l1").agg(F.sum("n").alias("total"), _entropy(F.col("n"), F.sum("n")).alias("entropy")).withColumnRenamed("total", "n")


def column_entropies(table: DataFrame) -> DataFrame:
    """l2, n and the entropy of the column's distribution."""
    return table.groupBy("l2").agg(F.sum("n").alias("total"), _entropy(F.col("n"), F.sum("n")).alias("entropy")).withColumnRenamed("total", "n")


def dense(table: DataFrame, labels: list | None = None) -> DataFrame:
    """The table with a column for each of the given second labels, by default all that there are, in their order."""
    if labels is None:
        labels = [r["l2"] for r in table.select("l2").where("l2 is not null").distinct().orderBy("l2").collect()]  # they become columns
    return table.groupBy("l1").pivot("l2", labels).agg(F.sum("n")).fillna(0)


def dense_rows(table: DataFrame) -> DataFrame:
    """l1, labels and counts of the dense table: all second labels in their order, and a count for each (0 for none).

    A row is put together in a task; no label becomes a column or passes through the driver, however many there are.
    """
    own = table.where("l2 is not null").groupBy("l1", "l2").agg(F.sum("n").alias("n"))
    cells = table.select(F.col("l1").alias("row")).distinct().crossJoin(own.select(F.col("l2").alias("column")).distinct())
    met = cells.join(own, F.col("row").eqNullSafe(F.col("l1")) & (F.col("column") == F.col("l2")), "left")
    found = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    return found.select(F.col("row").alias("l1"), F.col("s.column").alias("labels"), F.col("s.n").alias("counts"))


def information(table: DataFrame) -> DataFrame:
    """One row: n, rows, columns, h1, h2, h12, h1_given_2, information, e_bound, nmi_joint, nmi_max, nmi_mean, nmi_sqrt, ami_bound.

    The joint and both marginal counts come from one pass of grouping sets. Ratios that are 0/0 are null.
    """
    both = [F.col("l1"), F.col("l2")]
    sets = table.groupingSets([both, both[:1], both[1:]], *both).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    part = lambda g, x: F.sum(F.when(F.col("g") == g, x))
    n_log = F.col("n") * F.log("n")
    row = sets.agg(part(0, F.col("n")).alias("n"), part(1, F.lit(1)).alias("rows"), part(2, F.lit(1)).alias("columns"), part(0, n_log).alias("s12"), part(1, n_log).alias("s1"), part(2, n_log).alias("s2"))
    h = lambda s: F.greatest(F.lit(0.0), F.log("n") - F.col(s) / F.col("n"))
    row = row.withColumns({"h1": h("s1"), "h2": h("s2"), "h12": h("s12")})
    n, r, c = F.col("n"), F.col("rows"), F.col("columns")
    row = row.withColumns({"information": F.greatest(F.lit(0.0), F.col("h1") + F.col("h2") - F.col("h12")), "h1_given_2": F.greatest(F.lit(0.0), F.col("h12") - F.col("h2")), "e_bound": F.when(n > 1, F.log((n + r * c - r - c) / (n - 1)))})
    i, h1, h2 = F.col("information"), F.col("h1"), F.col("h2")
    over = lambda a, b: F.when(b > 1e-12, a / b)
    return row.select(
        "n", "rows", "columns", "h1", "h2", "h12", "h1_given_2", "information", "e_bound",
        over(i, F.col("h12")).alias("nmi_joint"), over(i, F.greatest(h1, h2)).alias("nmi_max"), over(2 * i, h1 + h2).alias("nmi_mean"),
        over(i, F.sqrt(h1 * h2)).alias("nmi_sqrt"), over(i - F.col("e_bound"), F.sqrt(h1 * h2) - F.col("e_bound")).alias("ami_bound"),
    )


def expected_term(n: int, a: int, b: int) -> float:
    """The mean of x/n log(n x / (a b)) when a of n things are marked and b drawn, x being the marked ones drawn.

    Probabilities follow one another by ratios, from the likeliest on to either side until they vanish in doubles; their
    sum is one, so none needs a factorial.
    """
    low, high = max(0, a + b - n), min(a, b)
    mode = min(high, max(low, (a + 1) * (b + 1) // (n + 2)))
    mass = total = 0.0
    for step, end in ((1, high), (-1, low)):
        at, log = mode, 0.0
        while (at <= end) if step > 0 else (at >= end):
            count = min(TERMS, abs(end - at) + 1)
            x = at + step * np.arange(count, dtype=np.float64)
            more = (a - x) * (b - x) / ((x + 1) * (n - a - b + x + 1)) if step > 0 else x * (n - a - b + x) / ((a - x + 1) * (b - x + 1))
            with np.errstate(divide="ignore"):
                ratios = np.log(more)
            logs = log + np.r_[0.0, ratios[:-1].cumsum()]
            p = np.exp(logs)
            if step < 0 and at == mode:
                p[0] = 0.0  # counted on the way up
            own = x > 0
            total += float((p[own] * x[own] / n * np.log(n * x[own] / (a * b))).sum())
            mass += float(p.sum())
            log = logs[-1] + ratios[-1]
            at += step * count
            if not log > LEAST:
                break
    return total / mass


def expected_information(table: DataFrame) -> DataFrame:
    """One row, e_exact: the mean mutual information of two clusterings with these marginal counts that have nothing to do
    with each other (null for an empty table).

    Only the different pairs of counts are met, of which there are hardly more than labelled things: the different
    column counts (at most about the root of twice their sum) go to every task, the row counts stay dealt.
    """
    counts = lambda c: table.groupBy(c).agg(F.sum("n").alias("k")).groupBy("k").agg(F.count("*").alias("times"))
    columns = [(r["k"], r["times"]) for r in counts("l2").orderBy("k").collect()]
    n = sum(k * times for k, times in columns)
    shared = table.sparkSession.sparkContext.broadcast((n, columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, columns = shared.value
        for batch in batches:
            sums = [times * sum(own * expected_term(n, k, c) for c, own in columns) for k, times in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.record_batch([pa.array(sums, pa.float64())], names=["e"])

    return counts("l1").repartition("k").mapInArrow(run, "e double").agg(F.sum("e").alias("e_exact"))


def adjusted_information(table: DataFrame) -> DataFrame:
    """information() with e_exact and the adjusted measures ami_max, ami_mean and ami_sqrt: 1 for equal clusterings, 0 on
    average for unrelated ones. Ratios that are 0/0 are null."""
    row = information(table).crossJoin(expected_information(table))  # one row each
    i, e, h1, h2 = F.col("information"), F.col("e_exact"), F.col("h1"), F.col("h2")
    over = lambda b: F.when(b - e > 1e-12, (i - e) / (b - e))
    return row.withColumns({"ami_max": over(F.greatest(h1, h2)), "ami_mean": over((h1 + h2) / 2), "ami_sqrt": over(F.sqrt(h1 * h2))})
