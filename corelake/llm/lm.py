"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, memory-mapped.

Counting: each task sums its n-grams and sends them, packed and compressed, to the shard of their context; a
frequent context is dealt to several shards by its next word. A shard's n-grams become two files in the shared
folder: the sorted 64-bit hashes of the n-grams, and their counts. It sends on what the next lower order counts: each
distinct n-gram without its first word. Sums by word and by context (token count, distinct words before it; as a
context its tokens and its next words by count) take a last shuffle of the same form.
Scoring: workers map the files and look up the sorted distinct n-grams of a batch; no worker holds the model.

The model of a text is prod p(w|h) over its words and one end, h being the order - 1 words before (begin marks first):

    p(w|h) = max(0, c(h,w) - D(c(h,w))) / c(h) + (D1 n1(h) + D2 n2(h) + D3 n3+(h)) / c(h) * p(w|h')
    p(w)   = max(0, b(w) - E(b(w))) / B + (E1 m1 + E2 m2 + E3 m3+) / B / (V + 1)

where c(h,w) is a count for the highest order and below it the number of distinct words before (h,w), c(h) its sum
over w, and h' is h without its first word; b(w) is the number of distinct words before w, B the number of distinct
pairs, and V the number of distinct tokens; D (one set for each order) and E are the discounts of the counts of
counts. An unknown word has b(w) = 0; after an unknown context p(w|h) = p(w|h'). The probabilities of the known
tokens and of one unknown add up to 1.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, shared_path, space_words, written

#: Tokens whose n-grams a task sums before it sends them; words whose hashes a worker keeps; parts of a context.
HELD, CACHED_WORDS, SALTS = 4_000_000, 500_000, 16
#: Texts, and their characters, that are looked up together.
TEXTS, CHARACTERS = 2048, 3_000_000
#: Bytes of text for each shard, about, and the most shards (their number comes from the upper 16 bits of a hash).
SHARD_TEXT, MOST_SHARDS = 16 << 20, 1 << 16
BEGIN, END = 1, 2
#: Sums by word: tokens, distinct contexts, tokens after it, next words seen once, twice, more often.
SUMS = 6


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of pairs; the upper 16 bits are those of the context and a salt of the word, and so give the shard."""
    top = _mixed(h + (w % np.uint64(SALTS)) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFF << 48)
    return top | (_mixed(_mixed(h) + w) >> np.uint64(16))


class Words:
    """Hashes of the words of texts."""

    def __init__(self, order: int = 2):
        self.known: dict[bytes, int] = {}
        self.begin = [BEGIN] * (order - 1)

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of begins, words and end of each text in turn, tokens of each text without the begins)."""
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        split = [space_words(t) for t in texts]
        digest = xxhash.xxh3_64_intdigest
        self.known.update((w, max(3, digest(w))) for w in set().union(*split) - self.known.keys())
        get = self.known.__getitem__
        flat: list[int] = []
        for words in split:
            flat += self.begin
            flat += map(get, words)
            flat.append(END)
        return np.array(flat, np.uint64), np.array([len(w) + 1 for w in split], np.int64)


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts that are split and looked up together: so many, of so many characters, or a longer one by itself."""
    some: list[str | None] = []
    size = 0
    for one in texts:
        n = len(one or "")
        if some and (len(some) == TEXTS or size + n > CHARACTERS):
            yield some
            some, size = [], 0
        some.append(one)
        size += n
    if some:
        yield some


def histories(flat: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places of the tokens that are no begin, hashes of the 1, 2, ... order - 1 words before each)."""
    at = np.flatnonzero(flat != np.uint64(BEGIN))
    found = [flat[at - 1]] if order > 1 else []
    for j in range(2, order):
        found.append(_mixed(found[-1] * np.uint64(0x9E3779B97F4A7C15) + flat[at - j]))
    return at, found


def _pack(key: np.ndarray, columns: list[np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, arrays) of rows that are ordered by key, whose uppermost bits give the shard."""
    shift = np.uint64(64 - (shards.bit_length() - 1))
    shard = (key >> shift).astype(np.int64) if shards > 1 else np.zeros(len(key), np.int64)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    coder = zstandard.ZstdCompressor(3)
    for k in np.unique(shard).tolist():
        part = slice(cuts[k], cuts[k + 1])
        yield k, coder.compress(b"".join(np.ascontiguousarray(c[part]).tobytes() for c in columns))


def _unpack(blobs: list[bytes], types: list[str]) -> list[np.ndarray]:
    decoder = zstandard.ZstdDecompressor()
    parts = []
    for blob in blobs:
        data = decoder.decompress(blob)
        n, at, own = len(data) // sum(np.dtype(t).itemsize for t in types), 0, []
        for t in types:
            size = n * np.dtype(t).itemsize
            own.append(np.frombuffer(data[at : at + size], t))
            at += size
        parts.append(own)
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each shard; the rows come in order of the shard."""
    at, held = None, []
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard != at and held:
                yield at, held
                held = []
            at = shard
            held.append(blob)
    if held:
        yield at, held


def _sums(word: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words in order and the sums of their rows."""
    order = np.argsort(word, kind="stable")
    word, rows = word[order], rows[order]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    return word[first], np.add.reduceat(rows, first, axis=0)


def store(folder: str, name: str, array: np.ndarray) -> str:
    """The array's bytes as a file of the shared folder; its name tells attempts of a task apart."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    where = urlparse(path)
    if where.scheme in ("", "file"):
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        with open(where.path, "wb") as f:
            f.write(array.tobytes())
        return where.path
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_output_stream(inner) as f:
        f.write(array.tobytes())
    return path


@cache
def _copies():
    """This worker's folder for copies of files that can't be mapped where they lie; it goes with the worker."""
    return tempfile.TemporaryDirectory(prefix="lm-")


@cache
def mapped(path: str, dtype: str) -> np.ndarray:
    """The stored array, mapped into memory; from a store that can't be mapped, a worker's copy is."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        path = where.path
    else:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_stream(inner) as f, tempfile.NamedTemporaryFile(dir=_copies().name, delete=False) as copy:
            while part := f.read(1 << 24):
                copy.write(part)
        path = copy.name
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def discounts(n: list[int]) -> list[float]:
    """[0, D1, D2, D3+] from the numbers of items counted once, twice, three and four times."""
    n1, n2, n3, n4 = (max(0, x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    found = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [0.0, *(min(float(k), max(0.05, d)) for k, d in enumerate(found, 1))]


class Model:
    """Where the arrays are, and the numbers that all lookups need. grams: files of each order from 2 on, by shard."""

    def __init__(self, shards: int, grams: dict[int, dict], words: dict, tokens: int, distinct: int, types: int, gram_counts: dict[int, list[int]], word_counts: list[int], more: int):
        self.shards, self.grams, self.words = shards, grams, words
        self.tokens, self.distinct, self.types = tokens, distinct, types
        self.order = max(grams)
        self.d, self.e = {k: discounts(n) for k, n in gram_counts.items()}, discounts(word_counts)
        spare = self.e[1] * word_counts[0] + self.e[2] * word_counts[1] + self.e[3] * more
        self.unknown = spare / types / (distinct + 1) if types else 1.0

    def _find(self, files: dict, keys: np.ndarray, value: str, width: int) -> np.ndarray:
        """Values of sorted distinct keys; zero for those that aren't there."""
        out = np.zeros((len(keys), width), np.int64)
        if not len(keys):
            return out
        bits = np.uint64(64 - (self.shards.bit_length() - 1))
        shard = (keys >> bits).astype(np.int64) if self.shards > 1 else np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for k in np.unique(shard).tolist():
            if k not in files:
                continue
            stored, values = mapped(files[k][0], "<u8"), mapped(files[k][1], value)
            mine = keys[cuts[k] : cuts[k + 1]]
            at = np.searchsorted(stored, mine)
            hit = np.flatnonzero(stored[np.minimum(at, len(stored) - 1)] == mine)
            out[cuts[k] + hit] = values.reshape(-1, width)[at[hit]]
        return out

    def score(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, score) of each text."""
        at, before = histories(flat, self.order)
        own = flat[at]
        words, place = np.unique(np.concatenate([own, *before]), return_inverse=True)
        w, *contexts = place.reshape(self.order, len(at))
        # words and contexts are stored by their hash mixed, as n-grams are, so that shards are even
        mixed = _mixed(words)
        order = np.argsort(mixed)
        sums = np.empty((len(words), SUMS), np.int64)
        sums[order] = self._find(self.words, mixed[order], "<i8", SUMS)
        e = np.array(self.e)
        before_w = sums[:, 1]
        p = ((before_w - e[np.minimum(before_w, 3)]) / max(1, self.types) + self.unknown)[w]
        base = np.log10((sums[:, 0] + 1) / (self.tokens + self.distinct + 1))
        after = np.maximum(sums[:, 2], 1)
        for k, (context, h) in enumerate(zip(before, contexts, strict=True), 2):
            d = np.array(self.d[k])
            weight = np.where(sums[:, 2] > 0, (sums[:, 3:] * d[1:]).sum(1) / after, 1.0)
            gram, where = np.unique(pair_keys(context, own), return_inverse=True)
            count = self._find(self.grams[k], gram, "<u4", 1)[:, 0][where]
            p = (count - d[np.minimum(count, 3)]) / after[h] + weight[h] * p
        row = np.repeat(np.arange(len(lengths)), lengths)
        total = lambda x: np.bincount(row, x, len(lengths))
        return total(sums[w, 0] > 0).astype(np.int64), total(base[w]), total(np.log10(p))


def train(docs: DataFrame, *, text: str = "text", where: Column | None = None, order: int = 2, shards: int | None = None) -> Model:
    """A model of the rows of docs that meet where (all by default); a null text is empty, an empty table gives
    a model that knows no word. There is a shard for each SHARD_TEXT bytes of text, if their number isn't given."""
    if order < 2:
        raise ValueError("order is 2 or more")
    rows = (docs if where is None else docs.where(where)).select(F.col(f"`{text}`").cast("string").alias("t"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        shards = 1 << min(MOST_SHARDS.bit_length() - 1, max(4, (size * (order - 1) // SHARD_TEXT).bit_length()))
    folder = shared_path(docs.sparkSession, "lm")
    parts = rows.mapInArrow(lambda b: _count(b, shards, order), "shard int, blob binary")
    grams, counts, sums, types = {}, {}, None, 0
    files = lambda rows: {r["shard"]: (r["keys"], r["values"]) for r in rows}
    for k in range(order, 1, -1):
        made = written(_dealt(parts, shards).mapInArrow(lambda b, k=k: _merge_grams(b, folder, shards, k, order), _MADE), "lm-grams")
        # one small row for each shard
        found = made.where("kind = 'file'").select("shard", "keys", "values", "numbers").collect()
        numbers = [sum(x) for x in zip(*(r["numbers"] for r in found), strict=True)] or [0] * 5
        grams[k], counts[k], types = files(found), numbers[:4], numbers[4]
        own = made.where("kind = 'words'").select("shard", "blob")
        sums = own if sums is None else sums.unionByName(own)
        parts = made.where("kind = 'grams'").select("shard", "blob")
    words = written(_dealt(sums, shards).mapInArrow(lambda b: _merge_words(b, folder), _MADE), "lm-words")
    words = words.select("shard", "keys", "values", "numbers").collect()
    w = [sum(x) for x in zip(*(r["numbers"] for r in words), strict=True)] or [0] * 7
    return Model(shards, grams, files(words), w[5], w[6], types, counts, w[:4], w[4])


def _dealt(parts: DataFrame, shards: int) -> DataFrame:
    return parts.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")


_MADE = "kind string, shard int, blob binary, keys string, values string, numbers array<long>"


def _made(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kind", "shard", "blob", "keys", "values", "numbers"])


def _count(batches: Iterator[pa.RecordBatch], shards: int, order: int) -> Iterator[pa.RecordBatch]:
    words, held, size = Words(order), [], 0

    def settle():
        flat = np.concatenate(held)
        at, before = histories(flat, order)
        w = flat[at]
        key, first, count = np.unique(pair_keys(before[-1], w), return_index=True, return_counts=True)
        return _blobs(list(_pack(key, [*(h[first] for h in before), w[first], count.astype("<u4")], shards)))

    for batch in batches:
        for some in _groups(batch.column(0).to_pylist()):
            held.append(words.tokens(some)[0])
            size += len(held[-1])
            if size >= HELD:
                yield settle()
                held, size = [], 0
    if held:
        yield settle()


def _merge_grams(batches: Iterator[pa.RecordBatch], folder: str, shards: int, k: int, order: int) -> Iterator[pa.RecordBatch]:
    """Files of the k-grams of each shard, sums by word and context, and the next lower grams."""
    for shard, blobs in _by_shard(batches):
        *before, w, count = _unpack(blobs, ["<u8"] * k + ["<u4"])
        key = pair_keys(before[-1], w)
        order_ = np.argsort(key, kind="stable")
        key = key[order_]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(count[order_].astype(np.int64), first)
        key, chosen = key[first], order_[first]
        before, w = [h[chosen] for h in before], w[chosen]
        numbers = [*(int((total == n).sum()) for n in (1, 2, 3, 4)), len(key)]
        yield _made([("file", shard, None, store(folder, f"grams{k}-{shard}", key), store(folder, f"counts{k}-{shard}", total.astype("<u4")), numbers)])
        zero = np.zeros(len(key), np.int64)
        parts = [_sums(before[-1], np.stack([zero, zero, total, total == 1, total == 2, total > 2], 1).astype(np.int64))]
        if k == order or k == 2:  # tokens are counted at the highest order, words before at the lowest
            parts.append(_sums(w, np.stack([total if k == order else zero, zero + (k == 2), zero, zero, zero, zero], 1)))
        word, rows = _sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        by_hash = np.argsort(_mixed(word))
        word, rows = word[by_hash], rows[by_hash]
        packed = _pack(_mixed(word), [word, *(rows[:, c].astype("<i8") for c in range(SUMS))], shards)
        yield _made([("words", n, blob, None, None, None) for n, blob in packed])
        if k > 2:
            lower, first, count = np.unique(pair_keys(before[-2], w), return_index=True, return_counts=True)
            packed = _pack(lower, [*(h[first] for h in before[:-1]), w[first], count.astype("<u4")], shards)
            yield _made([("grams", n, blob, None, None, None) for n, blob in packed])


def _merge_words(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for shard, blobs in _by_shard(batches):
        word, *columns = _unpack(blobs, ["<u8", *["<i8"] * SUMS])
        key, sums = _sums(_mixed(word), np.stack(columns, 1))
        before = sums[:, 1]
        numbers = [*(int((before == k).sum()) for k in (1, 2, 3, 4)), int((before > 2).sum()), int(sums[:, 0].sum()), int((sums[:, 0] > 0).sum())]
        yield _made([("file", shard, None, store(folder, f"words-{shard}", key), store(folder, f"sums-{shard}", sums), numbers)])


def perplexity(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    score is the model's log10 probability of the text and its end, perplexity 10 to its negative mean. A null
    text is empty: one token, the end.
    """
    results = T.StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

    def make():
        words = Words(model.order)

        def run(texts):
            out = {f.name: [] for f in results}
            for some in _groups(texts):
                flat, lengths = words.tokens(some)
                known, base, score = model.score(flat, lengths)
                parts = (lengths, known, np.full(len(lengths), model.tokens), base, score, 10 ** np.minimum(300, -score / lengths))
                for name, part in zip(out, parts, strict=True):
                    out[name] += part.tolist()
            return out

        return run

    return map_text(docs, make, results, text, keep)
