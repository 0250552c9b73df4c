"""Command line: summarise or cluster a Parquet table of vectors.

    python -m corelake.cli --input points.parquet --id vec_id --vector embedding --distance l2 --output out [--clusters 10]

Without --clusters (or with 0) a weighted summary is written as id, weight; else id, center_id of every point.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.cluster import ClusterModel
from .sources.points import ELEMENTS, read_points, validate_points, write_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--id", default="id")
    p.add_argument("--vector", default="v")
    p.add_argument("--weight")
    p.add_argument("--type", default="f64", choices=tuple(ELEMENTS), help="components that don't fit it are refused")
    p.add_argument("--distance", default="l2", choices=("l1", "l2", "cosine", "hamming"))
    p.add_argument("--clusters", "-c", type=int, default=0)
    p.add_argument("--fraction", "-f", type=float, default=0.11)
    p.add_argument("--beta", "-b", type=float, default=2.0)
    p.add_argument("--gamma", "-g", type=float, default=2.0)
    p.add_argument("--iterations", type=int, default=15)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("corelake").getOrCreate()
    points = validate_points(read_points(spark, a.input, id=a.id, vector=a.vector, weight=a.weight), a.type)
    model = ClusterModel(a.clusters or 10, a.fraction, a.beta, a.gamma, a.iterations, a.distance)
    if a.clusters:
        model.write(model.transform(points, model.fit(points)), a.output)
    else:
        write_csv(model.summary(points), a.output, "id", "weight")


if __name__ == "__main__":
    main()
