"""What the operators of this subpackage share: reading tables, scratch tables, per-row text functions.

Conventions that every operator follows:

* It takes DataFrames with named columns. Other columns are carried in one struct column ``doc`` or left
  out, so that no name of the caller can clash with a result column.
* A null text counts as empty unless the operator's docstring says otherwise.
* Scratch tables go below ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard, shared_path, written

__all__ = ["ARROW_BATCH_BYTES", "bound_batches", "discard", "map_text", "plain_words", "shared_path", "space_words", "table", "written"]

#: At most so many bytes of rows go to a Python worker at once.
ARROW_BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table, read lazily; long rows travel to Python in batches of bounded size."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, size: int = ARROW_BATCH_BYTES) -> None:
    """From now on jobs of this session send so many bytes of rows at most to a Python worker at once, or one row."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None]], dict[str, Iterable]]],
    results: T.StructType,
    text: str | Column = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """doc (a struct of the kept columns; all by default) and the results of a function of the texts.

    make() is called once in a task and gives a function from the texts of a batch to result columns.
    """
    kept = df.columns if keep is None else keep
    source = F.col(f"`{text}`") if isinstance(text, str) else text
    doc = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("_"))
    narrow = df.select(doc.alias("doc"), source.cast("string").alias("_text"))
    schema = T.StructType([narrow.schema["doc"], *results.fields])
    types = _arrow_types(results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            found = function(batch.column(1).to_pylist())
            columns = [x if isinstance(x := found[n], pa.Array) else pa.array(x, type=t) for n, t in types.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc", *types])

    return narrow.mapInArrow(run, schema)


def _arrow_types(schema: T.StructType) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema.fields}


#: Bytes that end a word in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` become spaces, A-Z becomes a-z. In UTF-8 every
#: byte of a character beyond ASCII is 0x80 or more, so bytes can be treated in place of characters.
_PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
