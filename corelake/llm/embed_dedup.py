"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; a hash is the axis, with its sign, that
the rotated vector lies nearest to; a table's bucket is named by several hashes. A vector stands in its own bucket of
each table and looks into the buckets that it just missed (those of the least loss of height on the axes). The number
of hashes follows from the number of vectors, so that unlike vectors hardly meet; the number of tables from the
measured chance that a pair at the threshold meets in one, so that all tables together miss hardly any.

Vectors of a bucket meet in cells, at most two chunks of them in a task, and cosines are computed there for all
candidate pairs. A pair counts in its first table only, which both sides' buckets tell, so no pair is ever emitted: a
cell gives each of its vectors the number of its links, and a spanning forest of them for the components. Equal
vectors of a label are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import all_rows
from .common import discard, written
from .components import connected_components
from .simhash import Forest

#: Buckets besides its own that a vector looks into in each table; share of pairs at the threshold that all tables may miss.
PROBES, MISS = 2, 1e-5
#: Vectors of a bucket in a chunk; pairs of a cell that are compared together; distance from the threshold from which
#: on rounding can't matter.
CHUNK, TILE, CLOSE = 4096, 1 << 20, 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two; it keeps lengths."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


class CrossPolytope:
    """Tables of buckets named by so many hashes each, for vectors of one length."""

    def __init__(self, width: int, hashes: int, tables: int, probes: int = PROBES, seed: int = 11):
        self.width, self.hashes, self.tables = width, hashes, tables
        self.axes = 1 << max(1, (width - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice((-1.0, 1.0), (tables, hashes, 3, self.axes))
        self.ranks = min(3, self.axes)
        self.changes = [((k, r),) for k in range(hashes) for r in range(1, self.ranks)] + [((k, 1), (j, 1)) for k in range(hashes) for j in range(k)]
        self.probes = min(probes, len(self.changes))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes): the own bucket and those that are looked into; -1 is none."""
        n = len(x)
        padded = np.zeros((n, self.axes))
        padded[:, : self.width] = x
        out = np.empty((n, self.tables, 1 + self.probes), np.int32)
        rows = np.arange(n)[:, None]
        for t in range(self.tables):
            own = np.zeros(n, np.int64)
            moves, losses = np.empty((self.hashes, self.ranks, n), np.int64), np.empty((self.hashes, self.ranks, n))
            for k in range(self.hashes):
                y = padded
                for signs in self.signs[t, k]:
                    y = hadamard(y * signs)
                height = np.abs(y)
                best = np.argpartition(-height, self.ranks - 1, axis=1)[:, : self.ranks]
                best = np.take_along_axis(best, np.argsort(-height[rows, best], axis=1, kind="stable"), 1)
                code = 2 * best + (y[rows, best] < 0)
                high = height[rows, best]
                unit = (2 * self.axes) ** k
                own += code[:, 0] * unit
                moves[k], losses[k] = ((code - code[:, :1]) * unit).T, ((high[:, :1] - high) ** 2).T
            named = [own]
            if self.probes:
                loss = np.stack([sum(losses[c] for c in change) for change in self.changes], 1)
                move = np.stack([sum(moves[c] for c in change) for change in self.changes], 1)
                least = np.argsort(loss, axis=1, kind="stable")[:, : self.probes]
                named += list((own[:, None] + np.take_along_axis(move, least, 1)).T)
            with np.errstate(over="ignore"):
                short = [((c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int32) for c in named]
            for p, c in enumerate(short):
                for other in short[:p]:
                    c[c == other] = -1
                out[:, t, p] = c
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def planned(width: int, vectors: int, cosine: float, probes: int = PROBES, miss: float = MISS) -> CrossPolytope:
    """As many hashes as buckets for so many vectors need, and as many tables as keep the share of missed pairs below miss."""
    axes = 1 << max(1, (width - 1).bit_length())
    hashes = max(1, int(np.ceil(np.log(max(2, vectors)) / np.log(2 * axes))))
    if width == 1:
        return CrossPolytope(width, hashes, 1, probes)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 1024, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    trial = CrossPolytope(width, hashes, 8, probes, seed=3)
    chance = _meet(trial.buckets(a), trial.buckets(cosine * a + np.sqrt(1 - cosine * cosine) * b)).mean()
    return CrossPolytope(width, hashes, max(1, int(np.ceil(np.log(miss) / np.log(max(1e-12, 1 - min(chance, 1 - 1e-12)))))), probes)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs of two lists of buckets (pairs, tables, 1 + probes) meet, for each table."""
    return (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)


class Cell:
    """Vectors of one bucket of table t: numbers, chunks, weights, buckets and unit vectors."""

    def __init__(self, t: int, number: np.ndarray, chunk: np.ndarray, weight: np.ndarray, buckets: np.ndarray, x: np.ndarray, own: np.ndarray):
        self.t, self.number, self.chunk, self.weight, self.buckets, self.x, self.own = t, number, chunk, weight, buckets, x, own

    def _first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pair of places a and b counts in this bucket: one stands here, and they met in no earlier bucket."""
        low, high = np.where(self.number[a] < self.number[b], a, b), np.where(self.number[a] < self.number[b], b, a)
        t = self.t
        # in this table the bucket of the smaller number comes first
        fine = self.own[low]
        rest = np.flatnonzero(~fine & self.own[high])
        if len(rest):
            fine[rest] = ~(self.buckets[low[rest], t, :1] == self.buckets[high[rest], t]).any(1)
        for e in range(t):
            at = np.flatnonzero(fine)
            if not len(at):
                break
            fine[at] = ~_meet(self.buckets[low[at], e : e + 1], self.buckets[high[at], e : e + 1])[:, 0]
        return fine

    def _blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Places that meet, without pairs that share the first table's bucket where those are many; whether both sides are one."""
        chunks = np.unique(self.chunk)
        a, b = np.flatnonzero(self.chunk == chunks[0]), np.flatnonzero(self.chunk == chunks[-1])
        same = len(chunks) == 1
        if self.t == 0 or len(a) * len(b) <= 1 << 14:
            yield a, b, same
            return
        first_a, first_b = self.buckets[a, 0, 0], self.buckets[b, 0, 0]
        for value in np.unique(first_a):
            # pairs of one side with itself are met once: against greater values
            other = b[first_b > value] if same else b[first_b != value]
            if len(other):
                yield a[first_a == value], other, False

    def links(self, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """For each vector: the weight of those linked to it here, and the place of its tree's root."""
        n = len(self.number)
        count, forest = np.zeros(n, np.int64), Forest(n)
        for a, b, same in self._blocks():
            step = max(1, TILE // max(1, len(b)))
            for k in range(0, len(a), step):
                rows = a[k : k + step]
                value = self.x[rows] @ self.x[b].T
                p, q = np.nonzero(value >= cosine - CLOSE)
                if not len(p):
                    continue
                exact = value[p, q]
                near = np.flatnonzero(np.abs(exact - cosine) <= CLOSE)
                if len(near):
                    exact[near] = (self.x[rows[p[near]]] * self.x[b[q[near]]]).sum(1)
                kept = exact >= cosine
                if same:
                    kept &= b[q] > rows[p]
                one, two = rows[p[kept]], b[q[kept]]
                fine = self._first(one, two)
                one, two = one[fine], two[fine]
                count += np.bincount(one, self.weight[two], n).astype(np.int64) + np.bincount(two, self.weight[one], n).astype(np.int64)
                forest.add(one, two)
        return count, forest.root


def near_duplicates(
    vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, keep: list[str] | None = None
) -> DataFrame:
    """doc, n_links, component and kept for each row of vectors.

    Rows are linked if their labels are equal and the cosine of their vectors is at least the given one (above zero):
    n_links counts a row's links, copies of its vector included; component is the smallest id that links reach, the
    row's own included; kept tells whether that is its own id. doc has the kept columns (by default all). Links are
    those of candidate pairs; at the threshold MISS of them are missed, of nearer pairs far fewer. Vectors meet those of
    their own length. A row whose id or label is null, or whose vector is null, empty, zero, or holds null or non-finite
    components, links with nothing: no links, its own id, kept. Rows that share an id are vectors of their own.
    """
    kept = vectors.columns if keep is None else keep
    v = F.col(f"`{vector}`")
    if vectors.schema[vector].dataType.elementType != T.FloatType():
        v = v.cast("array<double>")
    doc = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("_"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(doc.alias("doc"), F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), v.alias("v"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)) & F.col("id").isNotNull() & F.col("label").isNotNull())
    fit = rows.where("usable")
    classes = fit.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    classes = written(classes.withColumns({"no": F.monotonically_increasing_id(), "size": F.size("v")}), "classes")
    found, read = None, [classes]
    for size, n in sorted(classes.groupBy("label", "size").count().groupBy("size").agg(F.max("count")).collect()):  # a row for each length
        one, tables = _links(classes.where(F.col("size") == size), planned(size, n, cosine), cosine)
        read += tables
        found = one if found is None else found.unionByName(one)
    apart = rows.where(~F.col("usable")).select("doc", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    if found is None:
        return apart
    found = written(found, "links")
    parts = connected_components(found.where("other is not null").select(F.col("no").alias("a"), F.col("other").alias("b")))
    parts = parts.withColumnRenamed("node", "no")
    named = classes.select("no", "least", "rows").join(found.groupBy("no").agg(F.sum("links").alias("links")), "no", "left").join(parts, "no", "left")
    named = named.withColumn("component", F.coalesce("component", "no"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("no", "component_id", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = written(named.join(classes.select("no", "label", "v"), "no").drop("no"), "named")
    discard(*read, found)
    out = fit.join(named, ["label", "v"]).select("doc", "n_links", F.col("component_id").alias("component"), (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(apart)


def _links(classes: DataFrame, hashing: CrossPolytope, cosine: float) -> tuple[DataFrame, list[DataFrame]]:
    """no, links (rows linked to it) and other (linked to it, or null) from every cell, and the tables that this reads.

    The classes have one length.
    """
    spark = classes.sparkSession
    shared, width, each = spark.sparkContext.broadcast(hashing), hashing.width, 1 + hashing.probes

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = shared.value.buckets(_unit(all_rows(batch.column("v"), width)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes[0].size), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "buckets"])

    narrow = classes.select("no", "label", "v", "rows")
    indexed = written(narrow.mapInArrow(index, T.StructType([*narrow.schema, T.StructField("buckets", T.ArrayType(T.IntegerType()))])), "buckets")
    narrow = indexed.select("no", "label", F.posexplode("buckets").alias("at", "bucket")).where("bucket >= 0")
    narrow = narrow.select("no", "label", F.expr(f"at div {each}").cast("int").alias("t"), "bucket", (F.col("at") % each == 0).alias("own"))
    # a bucket matters if some vector stands in it and another one looks into it
    full = narrow.groupBy("label", "t", "bucket").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("owners > 0 and n > 1")
    full = written(full.select("label", "t", "bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "full")
    members = narrow.join(full, ["label", "t", "bucket"]).join(indexed.select("no", "v", "rows", "buckets"), "no")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("no"), "chunks").cast("int"))
    # a chunk meets itself and every other one
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    name = F.concat_ws("|", F.least("chunk", "other"), F.greatest("chunk", "other"), "t", "bucket", F.col("label").cast("string"))
    cells = members.select(name.alias("cell"), "t", "no", "own", "chunk", "rows", "buckets", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> None:
            cell = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            if len(cell) < 2:
                return
            column = lambda c: cell.column(c).to_numpy()
            buckets = cell.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(cell), -1, each)
            here = Cell(int(column("t")[0]), column("no"), column("chunk"), column("rows"), buckets, _unit(all_rows(cell.column("v").combine_chunks(), width)), column("own"))
            names = cell.column("cell")[0].as_py().split("|", 2)
            if names[0] != names[1] and (here.chunk == here.chunk[0]).all():
                return  # one side is empty, and the other meets itself elsewhere
            count, root = here.links(cosine)
            hit = np.flatnonzero(count)
            if len(hit):
                done.append((here.number[hit], count[hit], np.where(root[hit] != hit, here.number[root[hit]], -1)))

        def rows() -> pa.RecordBatch:
            no, links, other = (np.concatenate(x) for x in zip(*done, strict=True))
            done.clear()
            return pa.record_batch([pa.array(no), pa.array(links), pa.array(other, mask=other < 0)], names=["no", "links", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(0)
            if waiting and waiting[-1].column(0)[0].as_py() != name[0].as_py():
                close()
            cuts = np.flatnonzero(pc.not_equal(name.slice(1), name.slice(0, len(name) - 1)).to_numpy(zero_copy_only=False)) + 1
            edges = [0, *cuts.tolist(), len(name)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a:
                    close()
                waiting.append(batch.slice(a, b - a))
            if done:
                yield rows()
        if waiting:
            close()
        if done:
            yield rows()

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "no long, links long, other long"), [indexed, full]
