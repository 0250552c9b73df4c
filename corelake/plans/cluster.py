"""From points to clusters: facilities, weighted summary, k-medoids of the summary, assignment of all points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as dist
from ..operators import assign, bicriteria, kmedoids, sensitivity
from ..sources.points import write_csv
from ..sources.scratch import discard, written


@dataclass(frozen=True)
class ClusterModel:
    """Parameters of a clustering of points (id, v, w); shards of the one-pass rule follow from their number by default.

    A summary is a share of the points; what k-medoids searches is reduced to at most ``searched`` of its points, however
    many there are (None searches the whole summary, in rounds of jobs where it is large).
    """

    k: int
    fraction: float = 0.11
    beta: float = 2.0
    gamma: float = 2.0
    iterations: int = 15
    distance: str | dist.Distance = "l2"
    shards: int | None = None
    seed: int = 14537
    searched: int | None = kmedoids.MOST_POINTS

    def summary(self, points: DataFrame) -> DataFrame:
        """id, weight and v of the summary."""
        n = points.count()
        shards = self.shards or bicriteria.shards_for(n)
        centres = written(bicriteria.fit(points, self.k, beta=self.beta, gamma=self.gamma, distance=self.distance, shards=shards), "facilities")
        assigned = written(assign.nearest(points.select("id", "v", "w"), centres, self.distance, vectors=False), "assigned")
        found = written(sensitivity.summary(points, assigned, self.fraction, self.seed, n), "summary")
        discard(centres, assigned)
        return found

    def fit(self, points: DataFrame) -> DataFrame:
        """The medoids of the summary, a written table (see kmedoids.fit)."""
        summary = self.summary(points)
        found = self.medoids(summary)
        discard(summary)
        return found

    def medoids(self, summary: DataFrame) -> DataFrame:
        """The medoids of a summary (id, weight, v), a written table."""
        searched = summary
        if self.searched:
            searched = sensitivity.reduced(summary, self.searched, self.k, beta=self.beta, gamma=self.gamma, distance=self.distance, seed=self.seed)
        return written(kmedoids.fit(searched, self.k, self.iterations, distance=self.distance), "medoids")

    def transform(self, points: DataFrame, medoids: DataFrame) -> DataFrame:
        """points with cluster, center_id and dist of the nearest medoid; columns of these names are replaced.

        A point without a nearest medoid (see assign.nearest) keeps its row, with nulls.
        """
        kept = [c for c in points.columns if c not in ("cluster", "center_id", "dist")]
        medoids = medoids.select(F.col("cluster").alias("rank"), "center_id", "center")
        others = [F.col(f"`{c}`") for c in kept if c != "v"]
        carried = points.select("v", F.struct(*others or [F.lit(None).cast("int").alias("_")]).alias("p"))
        found = assign.nearest(carried, medoids, self.distance)
        names = medoids.select(F.col("rank").cast("long").alias("rank"), "center_id")  # k rows
        own = [F.col("v") if c == "v" else F.col(f"p.`{c}`") for c in kept]
        return found.join(F.broadcast(names), "rank", "left").select(*own, F.col("rank").alias("cluster"), "center_id", "dist")

    def write(self, assigned: DataFrame, path: str) -> None:
        """id and center_id of every point as CSV."""
        write_csv(assigned, path, "id", "center_id")
