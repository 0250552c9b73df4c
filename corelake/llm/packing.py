"""Lexical retrieval packing: documents that share words fill a training window together.

Documents are tokenized once and packed whole, however long. They are dealt to shards by a min-hash of their
tokens, so that like texts meet while a shard stays small; copies and other hot values are dealt on by a hash of
the row. A shard is a BM25 inverted index over all token ids of its documents, with document frequencies of the
whole corpus. Its documents in turn are seeds: the index returns unused neighbours, best first, which greedily
fill the seed's window; the one that crosses the end is cut there and seeds the next window, so a long document
runs through as many windows as it fills, and its neighbours follow where it ends. Tokens left at the end of a
partition form sequences of powers of two, so nothing is padded. Which documents share a shard depends on the
number of range partitions.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ARROW_BATCH_BYTES, map_text, written

#: Documents of a shard; it ends earlier with the document that brings it to so many ids. Characters of the texts that are encoded together.
SHARD, SHARD_IDS, TOGETHER = 1024, 1 << 22, 16_000_000
#: BM25's constants.
K1, B = 1.2, 0.75


class LatinWords:
    """ids of words of lower-case Latin-1 letters by a byte-pair coder that works on a vocabulary by its strings.

    That coder merges any two neighbours whose union is in the vocabulary, the tokenizer only the pair that its
    list of merges names. They agree if each token of the vocabulary, encoded by itself, is that token: within a
    token's span both make the same merges, as long as none crosses its ends. This is checked; tokens that fail
    are counted in ``odd``, and then this way isn't taken. Each byte of a word is one sign, its last byte another.
    """

    def __init__(self, kind: dict, vocabulary: dict[str, int]):
        import regex
        import tiktoken

        plain = bytes([*range(0x61, 0x7B), 0xC3, *range(0x9F, 0xC0)])
        signs = [chr(c) for c in range(1, 0x7F)]
        self.plain = dict(zip(plain, signs, strict=False))
        lasts = [b for b in plain if b != 0xC3]
        self.last = dict(zip(lasts, signs[len(plain) :], strict=False))
        # the tokenizer writes each byte as a printable character
        shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        byte = {c: b for b, c in shown.items()}
        ranks, ids = {}, []
        tokens = sorted(vocabulary.items(), key=lambda x: x[1])
        self.odd, checked = 0, []
        for token, number in tokens:
            body = token.removesuffix("</w>")
            raw = [byte.get(c, 0) for c in body]
            if not raw or any(b not in self.plain for b in raw) or body != token and raw[-1] not in self.last:
                continue
            coded = [self.plain[b] for b in raw]
            if body != token:
                coded[-1] = self.last[raw[-1]]
            ranks["".join(coded).encode()] = len(ids)
            ids.append(number)
            checked.append((token, number))
        merges = [m if isinstance(m, str) else " ".join(m) for m in kind["model"]["merges"]]
        order = [vocabulary[m.replace(" ", "", 1)] for m in merges]
        # ranks must follow the order of the merges
        self.odd += order != sorted(order)
        self.ids = np.array(ids, "<u4")
        self.closing = np.array([t.endswith("</w>") for t, _ in checked])
        ends = regex.escape("".join(self.last.values()), special_only=False)
        self.coder = tiktoken.Encoding("latin", pat_str=f"[^{ends}]*[{ends}]", mergeable_ranks=ranks, special_tokens={})
        self.sign, self.ending = (np.array([ord(m.get(b, "\0")) for b in range(256)], np.uint8) for m in (self.plain, self.last))
        rank = {tuple(m.split(" ")): k for k, m in enumerate(merges)}
        self.odd += sum(not self._merges_to_itself(t, rank) for t, _ in checked)

    @staticmethod
    def _merges_to_itself(token: str, rank: dict[tuple[str, str], int]) -> bool:
        parts = list(token.removesuffix("</w>"))
        parts[-1] += "</w>" * token.endswith("</w>")
        while len(parts) > 1:
            found = [rank.get(p, len(rank)) for p in zip(parts, parts[1:], strict=False)]
            k = found.index(min(found))
            if found[k] == len(rank):
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, ids of each word) of words of lower-case Latin-1 letters."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        _, offsets, data = words.cast(pa.large_string()).buffers()
        offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        last = offsets[1:] - offsets[0] - 1
        text = self.sign[data]
        text[last] = self.ending[data[last]]
        own = self.coder.encode_to_numpy(text.tobytes().decode("ascii"), disallowed_special=())
        ends = np.flatnonzero(self.closing[own]) + 1
        return self.ids[own], np.diff(ends, prepend=0)


def ragged(ids: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ids that codes name, one after another, and the length of each."""
    start, own = np.cumsum(size) - size, size[codes]
    total = np.cumsum(own)
    place = np.repeat(start[codes] - (total - own), own) + np.arange(total[-1] if len(total) else 0)
    return ids[place], own


class WordTokenizer:
    """ids of texts by a tokenizer that drops white space and never joins across it: each distinct word once.

    Equal to encoding the whole text (checked in the tests): such a tokenizer treats each stretch between white
    space by itself, and its model each word and each run of signs. Words beyond the Latin script, those that
    may hold a special token, and tokenizers of another kind take the plain way.
    """

    #: How the tokenizer's file splits a stretch (fixed value).
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
    #: A word and the signs after it, which the split takes as one; ``<`` may begin a special token.
    SIGNED = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-/:;=-@\[-`{-~]*)$"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        kind = json.loads(self.inner.to_str())
        vocabulary = self.inner.get_vocab()
        self.narrow = max(vocabulary.values()) < 1 << 16
        fast = kind["model"].get("end_of_word_suffix") == "</w>" and self.SPLIT in str(kind["pre_tokenizer"]).replace("\\\\", "\\")
        latin = LatinWords(kind, vocabulary) if fast else None
        self.latin = latin if latin is not None and not latin.odd else None
        self.split = regex.compile(self.SPLIT).findall

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.latin is None:
            return self._plain([t or "" for t in texts])
        out, some, size = [], [], 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size > TOGETHER:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some) if some else out

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        offsets = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        flat, size = ragged(*self._stretches(coded.dictionary), coded.indices.to_numpy().astype(np.int64))
        total = 4 * np.append(0, np.cumsum(size))
        bounds, data = total[offsets].tolist(), flat.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _stretches(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids in turn, ids of each) of distinct stretches without white space of ASCII."""
        found = pc.extract_regex(distinct, self.SIGNED)
        simple = found.is_valid().to_numpy(zero_copy_only=False)
        words, signs = found.drop_null().flatten()
        words, signs = pc.utf8_lower(words).dictionary_encode(), signs.dictionary_encode()
        word_ids, word_size = self.latin.encode(words.dictionary)
        more = [np.frombuffer(x, "<u4") for x in self._plain(signs.dictionary.to_pylist())]
        codes = np.stack([words.indices.to_numpy(), len(word_size) + signs.indices.to_numpy()], axis=1).ravel()
        ids, size = ragged(np.concatenate([word_ids, *more]), np.append(word_size, [len(x) for x in more]).astype(np.int64), codes)
        size = size.reshape(-1, 2).sum(axis=1)
        rest = distinct.filter(pa.array(~simple)).to_pylist()
        if not rest:
            return ids, size
        plain = {w: (w,) for w in rest if "<" in w or not w.isascii() and max(w) >= "\u0250"}
        parts = [plain.get(w) or self.split((w if w.isascii() else unicodedata.normalize("NFC", w)).lower()) for w in rest]
        known = sorted(set().union(*parts), key=plain.__contains__)
        number = {w: k for k, w in enumerate(known)}
        column = pa.array(known, pa.large_string())
        latin = pc.match_substring_regex(column, self.LATIN)
        own_ids, own_size = self.latin.encode(column.filter(latin))
        signs = column.filter(pc.invert(latin)).to_pylist()
        more = [np.frombuffer(x, "<u4") for x in self._plain(signs)]
        part_ids = np.concatenate([own_ids, *more])
        order = np.argsort(~latin.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(known), np.int64)
        place[order] = np.arange(len(known))
        codes = place[np.array([number[p] for x in parts for p in x], np.int64)]
        flat, each = ragged(part_ids, np.append(own_size, [len(x) for x in more]).astype(np.int64), codes)
        ends = np.cumsum([len(x) for x in parts])
        sums = np.append(0, np.cumsum(each))
        rest_size = np.diff(sums[ends], prepend=0)
        # back into the order of the distinct stretches
        all_ids, all_size = np.concatenate([ids, flat]), np.append(size, rest_size)
        back = np.empty(len(simple), np.int64)
        back[np.append(np.flatnonzero(simple), np.flatnonzero(~simple))] = np.arange(len(simple))
        return ragged(all_ids, all_size, back)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer, for all of its tasks."""
    return WordTokenizer(path)


def tokenized(docs: DataFrame, *, tokenizer: str, end_id: int = 1, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc, n_tokens (with the end), ids (all of them, of width bytes each) and key (their min-hash)."""

    def make():
        coder = word_tokenizer(tokenizer)
        end = np.uint32(end_id).tobytes()
        narrow = coder.narrow and end_id < 1 << 16

        def run(texts):
            out = {"n_tokens": [], "ids": [], "width": [], "key": []}
            for own in coder.encode(texts):
                own += end
                ids = np.frombuffer(own, "<u4")
                out["n_tokens"].append(len(ids))
                out["ids"].append(ids.astype("<u2").tobytes() if narrow else own)
                out["width"].append(2 if narrow else 4)
                out["key"].append(int((ids * np.uint32(0x9E3779B1)).min()))
            return out

        return run

    return map_text(docs, make, T.StructType.fromDDL("n_tokens long, ids binary, width int, key long"), text, keep)


def document_frequencies(tokens: DataFrame) -> tuple[dict[int, int], int, float]:
    """Documents that hold each token id; their number and mean length. Bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << 16, np.int64)
        few, held, n = np.zeros(len(found), np.uint8), np.zeros(len(found), np.uint8), 0
        for batch in batches:
            for own, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(own, f"<u{width}")
                top = int(ids.max()) + 1
                if n == 255 or top > len(found):
                    found = np.append(found + few, np.zeros(max(0, top - len(found)), np.int64))
                    few, held, n = np.zeros(len(found), np.uint8), np.zeros(len(found), np.uint8), 0
                held[ids] = 1
                few += held
                held[ids] = 0
                n += 1
        found += few
        ids = np.flatnonzero(found)
        yield pa.record_batch({"token": pa.array(ids), "n": pa.array(found[ids])})

    rows = tokens.select("ids", "width").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    n, length = tokens.agg(F.count("*"), F.avg("n_tokens")).first()
    return {r["token"]: r["n"] for r in rows}, n, length or 1.0


class Shard:
    """A BM25 inverted index over some documents (arrays of ids)."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean: float):
        self.terms = []
        docs, ids, weight = [], [], []
        for k, document in enumerate(documents):
            own, tf = np.unique(document, return_counts=True)
            self.terms.append(own)
            docs.append(np.full(len(own), k))
            ids.append(own)
            weight.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(document) / mean)))
        docs, ids, weight = np.concatenate(docs), np.concatenate(ids), np.concatenate(weight)
        weight = weight * idf[ids]
        order = np.argsort(ids, kind="stable")
        self.docs, self.weight = docs[order], weight[order]
        self.vocabulary, self.start = np.unique(ids[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))
        self.n = len(documents)
        # weights of terms that a quarter of the documents hold, as whole rows: faster to add than their postings
        size = self.end - self.start
        common = 4 * size >= self.n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.common = np.zeros((int(common.sum()), self.n))
        held = np.repeat(common, size)
        self.common[np.repeat(self.row, size)[held], self.docs[held]] = self.weight[held]

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents, by falling score over all terms of the seed, then by place."""
        at = np.searchsorted(self.vocabulary, self.terms[seed])
        row = self.row[at]
        at = at[row < 0]
        start, size = self.start[at], self.end[at] - self.start[at]
        places = np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        score = np.bincount(self.docs[places], self.weight[places], self.n) + self.common[row[row >= 0]].sum(0)
        score[used] = -1
        if self.n > 64:
            first = np.flatnonzero(score >= np.partition(score, -32)[-32])
            first = first[np.lexsort((first, -score[first]))]
            yield from (k for k in first.tolist() if not used[k])
        for k in np.lexsort((np.arange(self.n), -score)).tolist():
            if not used[k]:
                yield k


def shards(batches: Iterable[list], size: Callable[[tuple], int], most: int = SHARD, ids: int = SHARD_IDS) -> Iterator[list]:
    """Rows in turn, as lists of at most so many that end with the row that brings their sizes to so many ids."""
    held: list = []
    total = 0
    for row in chain.from_iterable(batches):
        held.append(row)
        total += size(row)
        if len(held) >= most or total >= ids:
            yield held
            held, total = [], 0
    if held:
        yield held


def pack_shard(shard: Shard, sizes: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, first id, ids); all but the last are full."""
    used = np.zeros(len(sizes), bool)
    begun = [0] * len(sizes)  # ids of each document that earlier windows took
    seed, following = 0, None
    while True:
        while seed < len(sizes) and (used[seed] or sizes[seed] == 0):
            used[seed] = True
            seed += 1
        first = following if following is not None else seed
        if first >= len(sizes):
            return
        following, out, space = None, [], window
        used[first] = True
        for k in chain([first], shard.neighbours(first, used)):
            used[k] = True
            n = min(space, sizes[k] - begun[k])
            if n:
                out.append((k, begun[k], n))
            begun[k] += n
            space -= n
            if begun[k] < sizes[k]:
                following = k
            if not space:
                break
        yield out


def pack(docs: DataFrame, *, tokenizer: str, id: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, keep: list[str] | None = None) -> DataFrame:
    """One row for each piece: doc, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens,
    sequence_id, offset.

    Each id of each row of docs lies in exactly one piece. A null or empty text has the end id alone. Repeated
    rows are packed each by itself; an empty table gives no pieces. Pieces of a sequence are gapless from offset
    0; a sequence is as long as the window, or a smaller power of two.
    """
    spark = docs.sparkSession
    tokens = written(tokenized(docs, tokenizer=tokenizer, end_id=end_id, text=text, keep=keep), "tokens")
    frequency, n, mean = document_frequencies(tokens)
    idf = np.zeros(max(frequency, default=0) + 1)
    for token, df in frequency.items():
        idf[token] = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weights = spark.sparkContext.broadcast(idf)  # one number for each id of the vocabulary
    # long documents stand together, so partitions are more than Spark's number where they would be large
    parts = int(n * mean) // SHARD_IDS
    number = [parts] if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    dealt = tokens.withColumn("tie", F.xxhash64("ids", "doc")).repartitionByRange(*number, "key", "tie").sortWithinPartitions("key", "tie", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        sequence = TaskContext.get().partitionId() << 40
        left: list[tuple] = []  # pieces that fill no window, of this partition: less than a window
        names = ["doc", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kinds = [doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def sequences() -> Iterator[list[tuple]]:
            rows_of = (list(zip(*(c.to_pylist() for c in batch.columns), strict=True)) for batch in batches)
            for rows in shards(rows_of, lambda row: row[1]):
                documents = [np.frombuffer(ids, f"<u{width}") for _, _, ids, width in rows]
                for filled in pack_shard(Shard(documents, idf, mean), [len(d) for d in documents], window):
                    pieces = [(*rows[k][:2], start, documents[k][start : start + n].astype("<u4")) for k, start, n in filled]
                    if sum(len(p[3]) for p in pieces) == window:
                        yield pieces
                        continue
                    left.extend(pieces)
                    if sum(len(p[3]) for p in left) >= window:
                        pieces, left[:] = _cut(left, window)
                        yield pieces
            while left:
                total = sum(len(p[3]) for p in left)
                pieces, left[:] = _cut(left, min(window, 1 << (total.bit_length() - 1)))
                yield pieces

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        out, held = [], 0
        for pieces in sequences():
            offset = 0
            for doc, total, start, ids in pieces:
                data = ids.tobytes()
                out.append((doc, start, len(ids), data, zlib.crc32(data), total, sequence, offset))
                offset += len(ids)
            sequence += 1
            held += 4 * offset
            if held >= ARROW_BATCH_BYTES // 4:
                yield table(out)
                out, held = [], 0
        if out:
            yield table(out)

    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = to_arrow_type(tokens.schema["doc"].dataType)
    schema = T.StructType([tokens.schema["doc"], *T.StructType.fromDDL("start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long").fields])
    return dealt.select("doc", "n_tokens", "ids", "width").mapInArrow(run, schema)


def _cut(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first pieces, of size ids in all, and the others; the piece that crosses the end is cut."""
    taken, rest = [], []
    for doc, total, start, ids in pieces:
        use = min(len(ids), size)
        size -= use
        if use:
            taken.append((doc, total, start, ids[:use]))
        if use < len(ids):
            rest.append((doc, total, start + use, ids[use:]))
    return taken, rest
