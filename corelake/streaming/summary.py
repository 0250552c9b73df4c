"""Summary of a stream: its points are landed as they come, and passes over the landed table follow its end."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import assign, sensitivity
from ..sources.scratch import discard, written
from .facilities import FacilityTable, merge, stream_facilities


@dataclass
class StreamSummary:
    """The three passes of a summary where the first one is a stream of points (id, v, w).

    Two queries read the stream: one keeps the facilities, the other lands the points, a folder for each batch, so that a
    batch that is repeated after a failure replaces itself. finish() assigns the landed points to the merged facilities
    and draws the summary, as the batch operators do.
    """

    path: str
    k: int
    expected: int
    fraction: float = 0.11
    beta: float = 2.0
    gamma: float = 2.0
    distance: str = "l2"
    shards: int = 8
    seed: int = 14537
    table: FacilityTable = field(init=False)

    def __post_init__(self):
        self.table = FacilityTable(f"{self.path}/facilities")

    def land(self, batch: DataFrame, number: int) -> None:
        """Writes the points of a batch in place of those that it may have written before."""
        batch.select("id", "v", "w").write.mode("overwrite").parquet(f"{self.path}/points/batch={number}")

    def start(self, points: DataFrame, trigger: dict | None = None) -> list:
        """Starts both queries; they go on from their checkpoints if they have run before."""
        trigger = trigger or {"availableNow": True}
        facilities = stream_facilities(points, self.k, self.expected, beta=self.beta, gamma=self.gamma, distance=self.distance, shards=self.shards)
        out = []
        for name, frame, sink in (("facilities", facilities, self.table), ("points", points, self.land)):
            writer = frame.writeStream.option("checkpointLocation", f"{self.path}/checkpoint-{name}").foreachBatch(sink)
            out.append((writer.outputMode("update") if name == "facilities" else writer).trigger(**trigger).start())
        return out

    def landed(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, v array<double>, w double, batch long").parquet(f"{self.path}/points").drop("batch")

    def finish(self, spark: SparkSession) -> DataFrame:
        """id, weight and v of the summary of what has been landed: both queries have to have ended, or to stand still."""
        points = self.landed(spark)
        centres = written(merge(self.table.read(spark), self.k, beta=self.beta, gamma=self.gamma, distance=self.distance), "facilities")
        assigned = written(assign.nearest(points, centres, self.distance).select("id", "w", "rank", "dist"), "assigned")
        found = written(sensitivity.summary(points, assigned, self.fraction, self.seed), "summary")
        discard(centres, assigned)
        return found
