"""Streams of several files: kept state, restarts, repeated batches, and results equal to those of the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelake.functions import distance as dist
from corelake.operators import assign, bicriteria, sensitivity
from corelake.streaming.facilities import FacilityTable, merge, stream_facilities
from corelake.streaming.summary import StreamSummary

POINT = "id long, v array<double>, w double"


@pytest.fixture(scope="module")
def rows():
    return [(k, [float(x)], 1.0) for k, x in enumerate(np.random.default_rng(2).normal(size=300) * 4)]


def put(spark, rows, folder, files, first=0):
    for k in range(first, files):
        spark.createDataFrame(rows[len(rows) * k // files : len(rows) * (k + 1) // files], POINT).coalesce(1).write.mode("append").parquet(str(folder))


def source(spark, folder):
    return spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))


def by_shard(spark, rows, shards):
    """What the rule leaves of each shard's points, in order."""
    df = spark.createDataFrame(rows, POINT)
    out = {}
    for r in df.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).orderBy("id").collect():
        out.setdefault(r.shard, []).append(r)
    found = {}
    for shard, own in out.items():
        state = bicriteria.State(3, 150, 2.0, 2.0, dist.get("l2"))
        state.process(np.array([r.id for r in own]), np.array([r.v for r in own]), np.array([r.w for r in own]))
        found[shard] = [(i, round(w, 9), v) for _, i, v, w, _ in state.facilities()]
    return found


def test_state_is_that_of_the_batch_rule(spark, rows, tmp_path):
    """Five files, a restart after two of them, and the facilities that one reading of all points gives."""
    table = FacilityTable(str(tmp_path / "f"))
    for first, upto in ((0, 2), (2, 5)):
        for k in range(first, upto):
            put(spark, rows[60 * k : 60 * (k + 1)], tmp_path / "in", 1)
        emitted = stream_facilities(source(spark, tmp_path / "in"), 3, 150, shards=2)
        emitted.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(table).start().awaitTermination()
        seen = rows[: 60 * upto]
        found = {}
        for r in table.read(spark).orderBy("shard", "rank").collect():
            found.setdefault(r.shard, []).append((r.center_id, round(r.weight, 9), r.center))
        assert found == by_shard(spark, seen, 2)
    merged = merge(table.read(spark), 3)
    assert merged.agg(F.sum("weight")).first()[0] == 300.0 and merged.count() <= bicriteria.facility_bound(3, 300, 2.0)
    # rows of earlier versions don't count
    old = table.read(spark).withColumns({"version": F.lit(1).cast("long"), "weight": F.lit(99.0)})
    assert sorted(merge(table.read(spark).unionByName(old), 3).collect()) == sorted(merged.collect())


def test_summary_of_a_stream(spark, rows, tmp_path):
    """Several files give the summary that the batch operators give; a repeated batch changes nothing."""
    put(spark, rows, tmp_path / "in", 4)
    whole = StreamSummary(str(tmp_path / "s"), 3, 150, 0.2, shards=2)
    for running in whole.start(source(spark, tmp_path / "in")):
        running.awaitTermination()
    assert sorted(map(tuple, whole.landed(spark).collect())) == rows
    found = sorted(map(tuple, whole.finish(spark).collect()))
    points = spark.createDataFrame(rows, POINT)
    assigned = assign.nearest(points, merge(whole.table.read(spark), 3)).select("id", "w", "rank", "dist")
    assert found == sorted(map(tuple, sensitivity.summary(points, assigned, 0.2).collect()))
    again = spark.createDataFrame(rows[:75], POINT)
    whole.land(again, 0)
    assert sorted(map(tuple, whole.landed(spark).collect())) == rows
    assert sorted(map(tuple, whole.finish(spark).collect())) == found
