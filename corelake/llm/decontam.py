"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the runs of ``window`` consecutive words of each benchmark item (a shorter item is one pattern).
Blocks of two words index a shift table: a block that no pattern holds lets the search skip almost a whole
window. Where the shift is zero, the block is the suffix of some patterns; the bucket of that suffix, split by
the patterns' first block, gives the few patterns that are compared word by word.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, plain_words

#: A benchmark whose words exceed this is searched for in several passes, each with tables of this size. A worker's
#: tables of so many words take about 250 MB (350 MB were measured for 400,000).
WORDS_PER_PASS = 300_000


class WuManber:
    """Search for many word sequences at once; sequences shorter than the others should have a searcher of their own."""

    def __init__(self, patterns: dict[tuple[bytes, ...], frozenset[int]]):
        self.least = min(map(len, patterns))
        self.block = min(2, self.least)
        self.skip = self.least - self.block + 1
        self.shift: dict[bytes, int] = {}
        # by the suffix block and the first block
        self.buckets: dict[bytes, list[tuple[tuple[bytes, ...], frozenset[int]]]] = {}
        for words, owners in patterns.items():
            for end in range(self.block, self.least + 1):
                key = b" ".join(words[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.skip), self.least - end)
            suffix, prefix = b" ".join(words[self.least - self.block : self.least]), b" ".join(words[: self.block])
            self.buckets.setdefault(suffix + b" " + prefix, []).append((words, owners))

    def find(self, words: list[bytes]):
        """(first word, last word + 1, owners) of every occurrence, by last word of the shortest length."""
        at, n, shift, skip, block, least = self.least, len(words), self.shift.get, self.skip, self.block, self.least
        while at <= n:
            key = words[at - 2] + b" " + words[at - 1] if block == 2 else words[at - 1]
            step = shift(key, skip)
            if step:
                at += step
                continue
            start = at - least
            for pattern, owners in self.buckets.get(key + b" " + b" ".join(words[start : start + block]), ()):
                if tuple(words[start : start + len(pattern)]) == pattern:
                    yield start, start + len(pattern), owners
            at += 1


def searchers(items: list[tuple[str | None, list[bytes]]], window: int) -> tuple[list[WuManber], list[str]]:
    """Searchers for whole windows, for items of a few words, and for those of hardly any; the items' names.

    Items without a name have the number -1.
    """
    names = sorted({name for name, _ in items if name is not None})
    number = {name: k for k, name in enumerate(names)} | {None: -1}
    by_size: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    for name, words in items:
        for start in range(max(1, len(words) - window + 1)):
            if part := tuple(words[start : start + window]):
                by_size[len(part)][part].add(number[name])
    found, same = [], {}  # most windows have one owner: equal sets are one
    for sizes in (range(4, window), range(1, min(4, window)), range(window, window + 1)):
        if patterns := {p: same.setdefault(f := frozenset(o), f) for k in sizes for p, o in by_size.get(k, {}).items()}:
            found.append(WuManber(patterns))
    return found, names


def _pass(df: DataFrame, benchmark: DataFrame, window: int, text: str, keep: list[str] | None) -> DataFrame:
    spark = df.sparkSession
    rows = benchmark.toLocalIterator(prefetchPartitions=False)
    tables = spark.sparkContext.broadcast(searchers([(r[0], plain_words(r[1])) for r in rows], window))

    def make():
        finders, names = tables.value

        def find(texts):
            out = {"n_words": [], "spans": [], "items": []}
            for one in texts:
                words = plain_words(one)
                spans, owners = [], set()
                for finder in finders:
                    for start, end, who in finder.find(words):
                        owners |= who
                        spans.append((start, end))
                out["n_words"].append(len(words))
                out["items"].append(sorted(names[k] for k in owners if k >= 0))
                out["spans"].append([{"start": a, "end": b} for a, b in merge_spans(spans)])
            return out

        return find

    results = T.StructType.fromDDL("n_words long, spans array<struct<start: int, end: int>>, items array<string>")
    return map_text(df, make, results, text, keep)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    percent: int = 5,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row for each row of docs: doc, n_words, n_hit, spans (of hit words), items (found), contaminated.

    A document is contaminated if some words are hit and they make up ``percent`` of its words or more.
    A null or empty text has no words and is clean; items without words are passed over, those without an
    id hit words but are not named; an empty benchmark hits nothing; repeated items count once. The benchmark goes to the workers in tables of at
    most WORDS_PER_PASS words; a larger one is searched for in several narrow passes over the documents.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("t is not null").distinct()
    size = items.select(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-size // (4 * WORDS_PER_PASS)))
    if passes == 1:
        found = _pass(docs, items, window, text, keep)
    else:
        kept = docs.columns if keep is None else keep
        found = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.col(f"`{text}`").alias("t"))
        spans = "array<struct<start: int, end: int>>"
        found = found.withColumns({"n": F.lit(0).cast("long"), "s": F.expr(f"cast(array() as {spans})"), "i": F.expr("cast(array() as array<string>)")})
        for k in range(passes):
            part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
            found = _pass(found, part, window, "t", None)
            found = found.select("doc.doc", "doc.t", F.col("n_words").alias("n"), F.concat("doc.s", "spans").alias("s"), F.array_union("doc.i", "items").alias("i"))
        # overlapping spans of several passes: a word is hit once
        merged = F.aggregate(
            F.array_sort("s"),
            F.expr(f"cast(array() as {spans})"),
            lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
        )
        found = found.select("doc", F.col("n").alias("n_words"), merged.alias("spans"), F.array_sort("i").alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))
