"""Clustering of large vector tables and operations of training-data pipelines, as Spark jobs."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the workers, once for each application, so that their tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = pathlib.Path(__file__).parent
    path = pathlib.Path(tempfile.mkdtemp(prefix="corelake-")) / "corelake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))
