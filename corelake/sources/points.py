"""Reading and writing points: a DataFrame of id (long), v (array<double>) and w (double)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import idx
from .scratch import written


def points(df: DataFrame, *, id: str = "id", vector: str = "v", weight: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """id, v, w and the extra columns; the weight is 1 if no column is named."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), w.alias("w"), *extra)


#: Least and greatest value of each type of component, and whether it takes whole numbers only.
ELEMENTS = {
    "u8": (0, 2**8 - 1, True), "u16": (0, 2**16 - 1, True), "u32": (0, 2**32 - 1, True), "i32": (-(2**31), 2**31 - 1, True),
    "f32": (-3.4028234663852886e38, 3.4028234663852886e38, False), "f64": (None, None, False),
}


def validate_points(df: DataFrame, element: str = "f64") -> DataFrame:
    """df, after one pass that raises for null ids, null or ragged vectors, values that aren't finite or don't fit the
    type of the components, and weights that are negative or not finite."""
    if element not in ELEMENTS:
        raise ValueError(f"unknown type {element!r}; there are {', '.join(ELEMENTS)}")
    low, high, whole = ELEMENTS[element]
    unfit = lambda x: F.lit(False) if low is None else (x < low) | (x > high) | (F.lit(whole) & (x != F.floor(x)))
    bad_value = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = df.agg(
        F.count_if(F.col("id").isNull()).alias("null ids"),
        F.count_if(F.col("v").isNull() | (F.size("v") == 0)).alias("null or empty vectors"),
        F.count_if(bad_value).alias("values that aren't finite"),
        F.count_if(F.exists("v", unfit)).alias(f"values that don't fit {element}"),
        F.count_if(F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0) | (F.col("w") == float("inf"))).alias("bad weights"),
        (F.coalesce(F.max(F.size("v")) - F.min(F.size("v")), F.lit(0))).alias("difference of lengths"),
    ).first()
    if wrong := {k: n for k, n in found.asDict().items() if n}:
        raise ValueError(f"invalid points: {wrong}")
    return df


def read_points(spark: SparkSession, path: str, *, id: str = "id", vector: str = "v", weight: str | None = None) -> DataFrame:
    """Points of a Parquet table with an id and an array of numbers."""
    return points(spark.read.parquet(path), id=id, vector=vector, weight=weight)


def read_labelled_csv(spark: SparkSession, path: str, values: int) -> DataFrame:
    """id, label and v of a CSV file with a header, a label and so many numbers a line; other lines raise.

    id is the line's place, from offsets that a sort by file, block and line gives.
    """
    schema = T.StructType([T.StructField("label", T.IntegerType()), *(T.StructField(f"p{k}", T.DoubleType()) for k in range(values))])
    rows = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=True)
    rows = rows.select("label", F.array(*[f"p{k}" for k in range(values)]).alias("v"))
    return _numbered(rows.withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()}))


def _numbered(rows: DataFrame) -> DataFrame:
    """Gapless ids in order of file and place, by counts of each partition rather than one sort of all rows."""
    rows = rows.repartitionByRange("_file", "_at").sortWithinPartitions("_file", "_at").withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    rows = written(rows, "numbered")  # a line's partition and place have to be the same in both passes
    counts = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]
    base = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]) if starts else F.create_map(F.lit(0), F.lit(0))
    return rows.withColumn("id", (base[F.col("_part")] + F.col("_place")).cast("long")).drop("_file", "_at", "_part", "_place")


def read_idx(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """id (place) and v of a file, or a folder of files, in IDX format, read by many tasks (see sources.idx).

    A file of one dimension gives vectors of length 1. kind ("u8", "i32", "f64", ...) is checked if it is given.
    """
    idx.register(spark)
    reader = spark.read.format("idx")
    return (reader.option("type", kind) if kind else reader).load(path)


def write_idx(df: DataFrame, path: str) -> None:
    """v (whole numbers below 256) as IDX files of unsigned bytes, in the order of the table's partitions."""
    idx.register(df.sparkSession)
    df.select("v").write.format("idx").mode("append").save(path)


def pair_labels(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Vectors and labels of the same place, as id, v and label."""
    return vectors.join(labels.select("id", F.col("v")[0].cast("int").alias("label")), "id")


def append_points(first: DataFrame, second: DataFrame, scale: float = 1.0) -> DataFrame:
    """Both tables, the second one's ids after the first one's; every component divided by scale."""
    offset = first.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    both = first.unionByName(second.withColumn("id", F.col("id") + offset))
    return both.withColumn("v", F.transform("v", lambda x: x / scale))


def write_csv(df: DataFrame, path: str, *columns: str) -> None:
    """The columns as CSV with a header, in full precision."""
    df.select(*columns).write.csv(path, header=True, mode="overwrite")


def write_facilities(facilities: DataFrame, path: str) -> None:
    facilities.write.parquet(path, mode="overwrite")
