"""Facilities of a stream: each shard keeps the state of the sequential rule from batch to batch.

The stream gives points (id, v, w) in order of arrival. Shards are keys of Spark's arbitrary state: one value holds the
rule's bounds, a map holds the facilities by rank, of which a trigger writes those that it changed. After each trigger
a shard that had points emits its facilities; FacilityTable keeps the last ones of each shard only, so merge() reads
as many rows as there are facilities, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import distance as dist
from ..functions.vectors import stacked
from ..operators.bicriteria import FACILITY, State

_BOUNDS = "phase long, li double, most_cost double, total_cost double, weight double, inserted long, facilities int"
_KEPT = "id long, weight double, cost double, center array<double>"
_OUT = f"shard int, version long, {FACILITY}"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Rule(StatefulProcessor):
    def __init__(self, k: int, expected: int, beta: float, gamma: float, d: dist.Distance, seed: int):
        self.arguments = k, expected, beta, gamma, d, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bounds = handle.getValueState("bounds", _BOUNDS)
        self.held = handle.getMapState("facilities", "rank int", _KEPT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, before = State(*self.arguments), {}
        if self.bounds.exists():
            state.phase, state.li, state.most_cost, state.total_cost, state.weight, state.inserted, n = self.bounds.get()
            before = {rank: (i, w, c, v) for (rank,), (i, w, c, v) in self.held.iterator()}
            own = [before[rank] for rank in range(n)]
            state.ids, state.weights, state.costs = [r[0] for r in own], [r[1] for r in own], [r[2] for r in own]
            state._centres = np.array([r[3] for r in own], np.float64).reshape(n, -1)
        for frame in rows:
            state.process(frame["id"].to_numpy(), stacked(frame["v"].tolist()), frame["w"].to_numpy(float))
        found = state.facilities()
        for rank, i, center, weight, cost in found:
            old = before.get(rank)
            if old is None or old[:3] != (i, weight, cost):
                self.held.updateValue((rank,), (i, weight, cost, center))
        for rank in before:
            if rank >= len(found):
                self.held.removeKey((rank,))
        self.bounds.update((state.phase, state.li, state.most_cost, state.total_cost, state.weight, state.inserted, len(found)))
        yield pd.DataFrame([(int(key[0]), state.inserted, *r) for r in found], columns=["shard", "version", "rank", "center_id", "center", "weight", "cost"])

    def close(self) -> None:
        pass


def stream_facilities(points: DataFrame, k: int, expected: int, *, beta: float = 2.0, gamma: float = 2.0, distance: str | dist.Distance = "l2", shards: int = 8, seed: int = 1454691) -> DataFrame:
    """shard, version and the facilities of the shards, from a streaming DataFrame; expected is a shard's number of points.

    The session's state store is set to RocksDB, which this kind of state needs. A shard's points keep their order within
    a trigger as far as Spark deals them in order; the chances of the rule don't hang on it.
    """
    points.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    keyed = points.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "v", "w")
    rule = _Rule(k, expected, beta, gamma, dist.get(distance), seed)
    return keyed.groupBy("shard").transformWithStateInPandas(rule, _OUT, "update", "none")


class FacilityTable:
    """The last facilities of each shard, as a folder for each: a sink for foreachBatch. A repeated batch changes nothing."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_OUT).parquet(self.path)


def merge(emitted: DataFrame, k: int, *, beta: float = 2.0, gamma: float = 2.0, distance: str | dist.Distance = "l2", seed: int = 1454691) -> DataFrame:
    """One set of facilities from the last ones of each shard: at most shards * bound rows meet in a task.

    emitted is what a FacilityTable reads, or all that was ever emitted: of each rank of a shard the last version counts.
    """
    d = dist.get(distance)
    last = emitted.groupBy("shard").agg(F.max("version").alias("version"))  # a row for each shard
    last = emitted.join(F.broadcast(last), ["shard", "version"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("center_id", kind="stable")
        state = State(k, len(pdf), beta, gamma, d, seed)
        state.process(pdf["center_id"].to_numpy(), stacked(pdf["center"].tolist()), pdf["weight"].to_numpy(float))
        return pd.DataFrame(state.facilities(), columns=["rank", "center_id", "center", "weight", "cost"])

    return last.select("rank", "center_id", "center", "weight", "cost").groupBy(F.lit(0).alias("_")).applyInPandas(run, FACILITY)
