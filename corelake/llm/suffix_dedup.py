"""Repeated passages by suffix sorting: each byte covered by a string of ``depth`` bytes that starts elsewhere too.

1. Each text is cut into runs. The anchor of a window (a string of ``depth`` bytes) is the least hash of its
   ``GRAM``-byte strings, so equal windows have equal anchors; a run is a stretch of windows with one anchor.
   Runs are far fewer than bytes, and a window can only repeat where its run's anchor hash repeats.
2. Runs whose anchor hash stands elsewhere too stay. Equal runs repeat as a whole: one of each class goes on.
3. The rest of the decision is suffix sorting. The runs that go on are cut further, dealt to shards by a hash of
   the bytes that all their windows share, and each shard is sorted by induced sorting (see induced.py), which
   carries common-prefix lengths along: neighbours with ``depth`` bytes in common repeat.
4. The covered bytes are merged for each document.

No step gathers a group in one task: classes are combined before the shuffle, and a frequent passage is dealt
out by the bytes around it, ever more of them while too many pieces share them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_text, written
from .decontam import merge_spans
from .induced import repeated

#: Bytes of an anchor's string; texts are hashed in stretches of so many bytes, which bounds memory.
GRAM, STRETCH = 40, 1 << 18
#: Windows of a piece of a run at most: all of them share depth - GRID + 1 bytes, which deal it to a shard; and of the
#: pieces into which those are cut that too many share.
GRID, FINER = 54, (9, 1)
#: Bytes of a shard, about; pieces of more than this share a core only where it is cut finer.
SHARD_BYTES = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place (GRAM is 32 + 8), by doubling."""
    h, size, eight = _mix(text.astype(np.uint64) + np.uint64(1)), 1, None
    while size < 32:
        h = _mix(h[:-size] * np.uint64(0x100000001B3) + h[size:])
        size *= 2
        if size == 8:
            eight = h
    return _mix(h[:-8] * np.uint64(0x100000001B3) + eight[32 : 32 + len(h) - 8])


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of the width hashes from each place on; of equals, the first. len(h) <= 2**20."""
    low = np.uint64((1 << 20) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if width > size:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    return (m & low).astype(np.int64)


def runs_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, first window, windows, hash of the run's bytes) of the runs of all texts."""
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        nonlocal size
        data = b"".join(x[2] for x in held)
        text = np.frombuffer(data, np.uint8)
        lengths = np.array([len(x[2]) for x in held])
        starts = np.cumsum(lengths) - lengths
        h = gram_hashes(text)
        place = least_places(h, depth - GRAM + 1)
        owner = np.repeat(np.arange(len(held)), lengths)[: len(place)]
        valid = np.arange(len(place)) + depth <= (starts + lengths)[owner]
        first = valid.copy()
        first[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
        begin = np.flatnonzero(first)
        count = np.add.reduceat(valid, begin, dtype=np.int64) if len(begin) else begin
        digest = xxhash.xxh3_64_intdigest
        whole = np.array([digest(data[a : a + n + depth - 1]) for a, n in zip(begin.tolist(), count.tolist(), strict=True)], np.uint64)
        own = owner[begin]
        number, offset = np.array([x[0] for x in held])[own], np.array([x[1] for x in held])[own]
        found.append((number, h[place[begin]].view(np.int64), begin - starts[own] + offset, count, whole.view(np.int64)))
        held.clear()
        size = 0

    for k, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - depth + 1), STRETCH):
            part = text[offset : offset + STRETCH + depth - 1]
            if len(part) >= depth:
                held.append((k, offset, part))
                size += len(part)
            if size >= STRETCH:
                flush()
    if held:
        flush()
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _list_arrays(number: np.ndarray, n: int, fields: dict[str, np.ndarray]) -> pa.Array:
    """A list column of structs for n texts, from rows in order of their text's number."""
    offsets = np.searchsorted(number, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], names=list(fields)))


def _runs(docs: DataFrame, depth: int) -> DataFrame:
    def make():
        def run(texts):
            number, key, first, count, whole = runs_of([(t or "").encode("utf-8", "surrogatepass") for t in texts], depth)
            fields = {"key": key, "first": first.astype(np.int32), "n": count.astype(np.int32), "whole": whole}
            order = np.argsort(number, kind="stable")
            return {"runs": _list_arrays(number[order], len(texts), {k: v[order] for k, v in fields.items()})}

        return run

    return map_text(docs, make, T.StructType.fromDDL("runs array<struct<key: long, first: int, n: int, whole: long>>"), "text", ["row", "size"])


def cuts(data: bytes, first: int, n: int, lead: int, depth: int, grid: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, windows, lead, core) of the pieces of a run in data; lead is the distance to the anchor.

    A piece's windows start from grid*q to grid*q + grid - 1 before the anchor, so equal windows are cut alike, and
    all windows of a piece hold the bytes from the last such start to depth after the first: core is their hash.
    """
    at, last, anchor = first, first + n - 1, first + lead
    while at <= last:
        q = (anchor - at) // grid
        end = min(last, anchor - grid * q)
        core = data[anchor - grid * q : anchor - grid * q - grid + 1 + depth]
        yield at, end - at + 1, anchor - at, xxhash.xxh3_64_intdigest(core, q) - (1 << 63)
        at = end + 1


_CUT = {"row": pa.int64(), "size": pa.int32(), "core": pa.int64(), "first": pa.int32(), "n": pa.int32(), "lead": pa.int32(), "open": pa.bool_(), "bytes": pa.binary()}
_CUT_SCHEMA = "row long, size int, core long, first int, n int, lead int, open boolean, bytes binary"


def _cut_runs(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the wanted runs with the bytes of their windows."""
    for batch in batches:
        out = {k: [] for k in _CUT}
        for row, size, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for run in wanted:
                first, n = run["first"], run["n"]
                h = gram_hashes(np.frombuffer(data[first : first + n - 1 + depth], np.uint8))
                lead = int(least_places(h, depth - GRAM + 1)[0])
                for at, m, lead, core in cuts(data, first, n, lead, depth, GRID):
                    for name, value in zip(_CUT, (row, size, core, at, m, lead, run["open"], data[at : at + m - 1 + depth]), strict=True):
                        out[name].append(value)
        yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), _CUT.values(), strict=True)], names=list(out))


def _cut_finer(batches: Iterator[pa.RecordBatch], depth: int, grid: int) -> Iterator[pa.RecordBatch]:
    """Pieces cut into shorter ones, which share more bytes."""
    for batch in batches:
        out = {k: [] for k in _CUT}
        for row, size, _, first, n, lead, is_open, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for at, m, lead, core in cuts(data, 0, n, lead, depth, grid):
                for name, value in zip(_CUT, (row, size, core, first + at, m, lead, is_open, data[at : at + m - 1 + depth]), strict=True):
                    out[name].append(value)
        yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), _CUT.values(), strict=True)], names=list(out))


def _sort_shards(batches: Iterator[pa.RecordBatch], depth: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows of the open runs. Rows come in order of core; a shard is some whole cores."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated([r[7] for r in rows], depth)
        out: list[tuple] = []
        for (row, size, _, first, _, _, is_open, _), places in zip(rows, found, strict=True):
            if is_open and len(places):
                gaps = np.flatnonzero(np.diff(places) > depth)
                begins, ends = places[np.append(0, gaps + 1)], places[np.append(gaps, len(places) - 1)]
                out += [(row, size, first + a, first + b + depth) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["row", "size", "start", "stop"])

    held: list[tuple] = []  # of whole cores with two runs or more
    core: list[tuple] = []
    weight = 0
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if core and r[2] != core[0][2]:
                if len(core) > 1 and any(x[6] for x in core):
                    held += core
                    weight += sum(len(x[7]) for x in core)
                core = []
                if weight >= shard_bytes:
                    yield solve(held)
                    held, weight = [], 0
            core.append(r)
    held += core if len(core) > 1 else []
    if held:
        yield solve(held)


_SPAN = "row long, size int, start int, stop int"


def _settled(pieces: DataFrame, depth: int, shard_bytes: int, grids: tuple[int, ...], most: int) -> list[DataFrame]:
    """Spans of the repeated windows of pieces: rows of _CUT, a written table.

    Pieces of one core go to one shard and are sorted there, unless more than most of them share it (a passage a little
    shorter than depth, in very many texts). Those are cut by a finer grid; equal ones of the new pieces repeat as a
    whole, and one of each class goes on where its new core has several classes. At grid 1 a core is a window.
    """
    hot = written(pieces.groupBy("core").agg(F.count("*").alias("c")).where(F.col("c") > most).select("core"), "hot") if grids else None
    if hot is None or hot.isEmpty():
        return [_sorted(pieces, depth, shard_bytes)]
    out = [_sorted(pieces.join(hot, "core", "left_anti").select(*_CUT), depth, shard_bytes)]
    dense = pieces.join(hot, "core", "left_semi").select(*_CUT)
    finer = dense.mapInArrow(lambda b: _cut_finer(b, depth, grids[0]), _CUT_SCHEMA).withColumn("whole", F.xxhash64("bytes"))
    finer = written(finer, "finer")
    classes = finer.groupBy("core", "whole", "n").agg(F.count("*").alias("c"), F.bool_and("open").alias("open"), F.min(F.struct("row", "size", "first", "lead", "bytes")).alias("one"))
    classes = written(classes, "finer-classes")
    equal = finer.select("row", "size", "core", "whole", "n", "first").join(classes.where("c > 1").select("core", "whole", "n"), ["core", "whole", "n"])
    out.append(equal.select("row", "size", F.col("first").alias("start"), (F.col("first") + F.col("n") + (depth - 1)).alias("stop")))
    unlike = classes.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core")
    left = classes.join(unlike, "core", "left_semi").select("one.row", "one.size", "core", "one.first", "n", "one.lead", (F.col("open") & (F.col("c") == 1)).alias("open"), "one.bytes")
    if grids[0] > 1:
        out += _settled(written(left.select(*_CUT), "pieces"), depth, shard_bytes, grids[1:], most)
    return out


def _sorted(pieces: DataFrame, depth: int, shard_bytes: int) -> DataFrame:
    dealt = pieces.select(*_CUT).repartition("core").sortWithinPartitions("core")
    return dealt.mapInArrow(lambda b: _sort_shards(b, depth, shard_bytes), _SPAN)


def repeated_spans(docs: DataFrame, *, id: str = "doc_id", text: str = "text", depth: int = 200, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): row, size, text, absent (whether it was null) and a struct doc of the other columns; spans by row and size.

    row is a hash of id and text: repeated rows share it, and what they hold repeats anyway. Tables that are no longer
    read are deleted on the way.
    """
    if depth < GRID + GRAM:
        raise ValueError(f"depth is {GRID + GRAM} or more")
    string = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("_")]
    doc = F.struct(*others)
    rows = docs.select(F.xxhash64(F.col(f"`{id}`"), string).alias("row"), F.octet_length(string).alias("size"), string.alias("text"), F.col(f"`{text}`").isNull().alias("absent"), doc.alias("doc"))
    texts = rows.select("row", "size", "text").where(F.col("size") >= depth)
    lists = written(_runs(texts, depth).select("doc.row", "doc.size", "runs"), "runs")
    runs = lists.select("row", "size", F.inline("runs"))
    # keys are a table of their own, so that the join's hot keys can be split
    keys = written(runs.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "keys")
    again = written(runs.join(keys, "key"), "again")
    discard(lists, keys)
    classes = again.groupBy("key", "whole", "n").agg(F.count("*").alias("c"), F.min(F.struct("row", "size", "first")).alias("one"))
    classes = written(classes, "classes")
    equal = again.join(classes.where("c > 1").select("key", "whole", "n"), ["key", "whole", "n"])
    equal = written(equal.select("row", "size", F.col("first").alias("start"), (F.col("first") + F.col("n") + (depth - 1)).alias("stop")), "equal")
    discard(again)
    unlike = written(classes.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "unlike")
    wanted = classes.join(unlike, "key", "left_semi").groupBy(F.col("one.row").alias("row"), F.col("one.size").alias("size")).agg(F.collect_list(F.struct(F.col("one.first").alias("first"), "n", (F.col("c") == 1).alias("open"))).alias("wanted"))
    cut = texts.join(wanted, ["row", "size"]).select("row", "size", "text", "wanted")
    pieces = written(cut.mapInArrow(lambda b: _cut_runs(b, depth), _CUT_SCHEMA), "pieces")
    discard(classes, unlike)
    found = equal
    for spans in _settled(pieces, depth, shard_bytes, FINER, shard_bytes // (depth + GRID)):
        found = found.unionByName(spans)
    return rows, written(found.groupBy("row", "size").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")


def dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", depth: int = 200, texts_out: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row of docs: doc (without the text), n_bytes, removed (spans of bytes), kept, kept_sha256.

    Spans are judged on the input; texts are UTF-8, a null text is empty, texts below depth bytes stay whole.
    Of repeated rows and copies each loses its repeats, the first one too. kept is the text that is left, without
    what a cut leaves of a character, null for a null text, and null where texts_out is false; kept_sha256 is of
    all bytes left.
    """
    rows, spans = repeated_spans(docs, id=id, text=text, depth=depth, shard_bytes=shard_bytes)
    joined = rows.join(spans, ["row", "size"], "left").select("doc", "text", "absent", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n_bytes": [], "removed": [], "kept": [], "kept_sha256": []}
            for text, absent, found in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                merged = merge_spans([(s["start"], s["stop"]) for s in found or ()])
                left, at = [], 0
                for a, b in merged:
                    left.append(data[at:a])
                    at = b
                left = b"".join([*left, data[at:]])
                out["n_bytes"].append(len(data))
                out["removed"].append([{"start": a, "stop": b} for a, b in merged])
                out["kept"].append(left.decode("utf-8", "ignore") if texts_out and not absent else None)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            types = (pa.int64(), spans_type, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["doc", *out])

    schema = T.StructType([joined.schema["doc"], *T.StructType.fromDDL("n_bytes long, removed array<struct<start: int, stop: int>>, kept string, kept_sha256 string").fields])
    return joined.mapInArrow(finish, schema)


def cut(docs: DataFrame, *, id: str = "doc_id", text: str = "text", depth: int = 200) -> DataFrame:
    """docs with the repeats cut from the texts. A null text stays null."""
    found = dedup(docs, id=id, text=text, depth=depth)
    return found.select(*[F.col("kept").alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns])
