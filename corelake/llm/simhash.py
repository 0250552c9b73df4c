"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are ordered by population count and cut into blocks. Two fingerprints within r bits have
population counts within r, so only block pairs whose ranges come that close meet in a cell. In a cell, tiles
are compared with numpy's exclusive-or and bit counts; a tile pair whose counts differ beyond the radius is
skipped, first by whole words, then by the four quarters of the words, whose differences also add up to at most
the distance. A cell returns a spanning forest of its links, one row for a node at most, not the links
themselves: the components are the same, and a group of near copies costs no square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, space_words, written
from .components import connected_components

#: Fingerprints in a packed row, and in a block; blocks of many fingerprints are larger, which halves what is sent,
#: but only up to a size at which a cell takes seconds. From there on their number grows.
CHUNK, LEAST_BLOCK, MOST_BLOCK, BLOCKS = 4096, 16_384, 49_152, 64
#: Tasks that the cells are dealt to at most.
MOST_TASKS = 20_000
#: Shingles hashed before their bits are counted.
COUNTED = 1 << 16


def fingerprint(words: list[bytes], size: int = 4, seed: int = 42) -> int:
    """A bit is set if more than half of the shingles' XXH64 have it; no words give zero."""
    if not words:
        return 0
    text, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    counts = np.zeros(64, np.int64)
    for k in range(0, n, COUNTED):
        pairs = zip(starts[k : min(n, k + COUNTED)], last[k : k + COUNTED], strict=False)
        h = np.array([digest(text[a : b - 1], seed) for a, b in pairs], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = 4, keep: list[str] | None = None) -> DataFrame:
    """doc and fp (the fingerprint as a signed long) for each row of docs; null or empty text: zero."""

    def make():
        def run(texts):
            return {"fp": pa.array(np.array([fingerprint(space_words(t), shingle) for t in texts], np.uint64).view(np.int64))}

        return run

    return map_text(docs, make, T.StructType.fromDDL("fp long"), text, keep)


def _close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs within the radius of two arrays that are sorted by quarters' population counts."""
    xs, ys = [], []
    qa, qb = _quarters(a), _quarters(b)
    step_a, step_b = 512, 2048
    for i in range(0, len(a), step_a):
        lo, hi = qa[i : i + step_a].min(0), qa[i : i + step_a].max(0)
        for j in range(0, len(b), step_b):
            if same and j + step_b <= i:
                continue
            part = qb[j : j + step_b]
            gap = np.maximum(0, np.maximum(part - hi, lo - part)).sum(1)
            near = np.flatnonzero(gap <= radius)
            if not len(near):
                continue
            hit = np.bitwise_count(a[i : i + step_a, None] ^ b[None, j + near]) <= radius
            x, y = np.nonzero(hit)
            x, y = x + i, near[y] + j
            if same:
                x, y = x[x < y], y[x < y]
            xs.append(x)
            ys.append(y)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (empty, empty)


def _quarters(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view("<u2").reshape(-1, 4)).astype(np.int16)


def _order(a: np.ndarray) -> np.ndarray:
    q = _quarters(a)
    return np.lexsort((q[:, 3], q[:, 2], q[:, 1], q[:, 0], q.sum(1)))


class Forest:
    """Union-find over places 0..n-1 that takes many pairs at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            x, y = self.root[x], self.root[y]
            differ = x != y
            x, y = np.maximum(x[differ], y[differ]), np.minimum(x[differ], y[differ])
            if not len(x):
                return
            np.minimum.at(self.root, x, y)
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def link_fingerprints(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b: long) between distinct fingerprints, fp and node, that span the classes within the radius.

    distinct has the columns fp and node; the links are between nodes.
    """
    spark = distinct.sparkSession
    table = written(distinct.select("fp", "node"), "fingerprints")
    n = table.count()
    size = min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS)))
    # sizes of the population counts (65 rows) give each count its place in the order, and so its blocks
    counts = table.groupBy(F.bit_count("fp").cast("int").alias("bits")).count().orderBy("bits").collect()
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    parts, first, total = {}, {}, 0
    for r in counts:
        parts[r["bits"]], first[r["bits"]] = -(-r["count"] // size), total
        total += parts[r["bits"]]
    # a block meets the blocks of population counts within the radius: their numbers are a range
    near = {bits: [other for other in parts if abs(other - bits) <= radius] for bits in parts}
    low = {bits: first[min(others)] for bits, others in near.items()}
    high = {bits: first[max(others)] + parts[max(others)] - 1 for bits, others in near.items()}
    cells = sum(parts[bits] * (high[bits] - low[bits] + 1) for bits in parts) // 2 + 1
    by_bits = lambda numbers: F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[F.col("bits")]
    bits = table.withColumn("bits", F.bit_count("fp").cast("int"))
    dealt = bits.withColumn("block", by_bits(first) + F.pmod(F.xxhash64("fp"), by_bits(parts)).cast("int")).repartitionById(total, F.col("block"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held: dict[int, int] = {}
        count: dict[int, int] = {}

        def rows(block: int):
            fp, node = (np.concatenate(x) for x in zip(*kept.pop(block), strict=True))
            held.pop(block)
            return pa.record_batch({"block": pa.array([block], pa.int32()), "bits": pa.array([count[block]], pa.int32()), "fps": pa.array([fp.tobytes()], pa.binary()), "nodes": pa.array([node.tobytes()], pa.binary())})

        for batch in batches:
            fp, node, block, bits = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            count.update(zip(block.tolist(), bits.tolist(), strict=True))
            for one in np.unique(block).tolist():
                mine = block == one
                kept.setdefault(one, []).append((fp[mine], node[mine]))
                held[one] = held.get(one, 0) + int(mine.sum())
                if held[one] >= CHUNK:
                    yield rows(one)
        for one in list(kept):
            yield rows(one)

    packed = dealt.select("fp", "node", "block", "bits").mapInArrow(pack, "block int, bits int, fps binary, nodes binary")
    goes = packed.withColumn("other", F.explode(F.sequence(by_bits(low), by_bits(high))))
    goes = goes.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fps", "nodes")

    def compare(key, frame):
        i, j = int(key[0]), int(key[1])
        sides = []
        for block in dict.fromkeys((i, j)):
            own = frame[frame["block"] == block]
            fp = np.frombuffer(b"".join(own["fps"]), np.uint64)
            node = np.frombuffer(b"".join(own["nodes"]), np.int64)
            order = _order(fp)
            sides.append((fp[order], node[order]))
        (a, nodes), (b, more) = sides[0], sides[-1]
        offset = 0 if i == j else len(a)
        forest = Forest(len(b) + offset)
        for k in range(0, len(a), CHUNK):
            for q in range(k if i == j else 0, len(b), CHUNK):
                x, y = _close_pairs(a[k : k + CHUNK], b[q : q + CHUNK], radius, i == j and k == q)
                forest.add(x + k, y + q + offset)
        nodes = nodes if i == j else np.concatenate([nodes, more])
        linked = np.flatnonzero(forest.root != np.arange(len(nodes)))
        import pandas as pd

        return pd.DataFrame({"a": nodes[linked], "b": nodes[forest.root[linked]]})

    # dealt to so many tasks by number: merged by their bytes, a few tasks would get all the work
    return goes.repartition(min(MOST_TASKS, cells), "i", "j").groupBy("i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, keep: list[str] | None = None) -> DataFrame:
    """doc, id, fp, component and class for each row of docs: the smallest id, and the smallest fingerprint, reachable.

    Ids are integers; a row whose id is null takes part through its fingerprint and gets the component of the
    others, null if none of them has an id. Rows with equal fingerprints are one node, so exact copies are never
    expanded. Texts without words share the fingerprint zero.
    """
    prints, classes = _classes(docs, id=id, text=text, shingle=shingle, radius=radius, keep=docs.columns if keep is None else keep)
    return prints.join(classes, "fp")


def _classes(docs: DataFrame, *, id: str, text: str, shingle: int, radius: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(doc, fp and id of each row; fp, component and class of each distinct fingerprint)."""
    kept = list(dict.fromkeys([id, *keep]))
    prints = written(fingerprints(docs, text=text, shingle=shingle, keep=kept).withColumn("id", F.col(f"doc.`{id}`").cast("long")), "simhash")
    # the node of a fingerprint is its own value, so that null and repeated ids can't join unlike texts
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    distinct = written(distinct, "simhash-nodes")
    links = link_fingerprints(distinct.select("fp", F.col("fp").alias("node")), radius)
    parts = connected_components(links)
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("root"))
    return prints, named.join(least, "component").select("fp", F.col("root").alias("component"), F.col("component").alias("class"))


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs without all but one of each class: the one of the smallest id (of repeated rows, one).

    A null id comes last; of rows of one id and fingerprint, the one whose text hashes lowest stays.
    """
    prints, classes = _classes(docs, id=id, text=text, shingle=shingle, radius=radius, keep=docs.columns)
    # one narrow row for each class: what stays is known before any text is shuffled
    narrow = prints.select("id", "fp").join(classes, "fp")
    first = narrow.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("m"))
    keyed = lambda df: df.withColumns({"none": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0).cast("long"))})
    winners = written(keyed(first.select("m.id", "m.fp")), "kept")
    # the join and the choice among repeated rows share one shuffle
    kept = keyed(prints).join(winners, ["id", "none", "fp"], "left_semi")
    chosen = Window.partitionBy("id", "none", "fp").orderBy(F.xxhash64(F.col(f"doc.`{text}`").cast("string")))
    return kept.withColumn("_n", F.row_number().over(chosen)).where("_n = 1").select("doc.*")
