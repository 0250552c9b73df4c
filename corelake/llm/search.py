"""Ranked lexical search of a set of items over all documents: a threshold-seeded join.

A document's score for an item is a sum of impacts, one for each of the item's terms. The k-th greatest impact of every
term and its greatest are stored first. The k-th impact of any term of an item bounds the item's k-th score from below;
with its terms in order of their greatest impacts, those whose bounds together stay below that score can't bring a
document in by themselves, so only the postings of the other terms give candidates. A candidate goes as soon as what
it has and the bounds of the terms still to come stay below the least score that counts; the rest are scored exactly.

Documents are never shuffled: items go to every task, in passes of a bounded number of words, and each task returns
its best documents of each item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_text, plain_words, written

#: Words of the items that are searched for in one pass; a worker's table of so many takes about 40 MB.
WORDS_PER_PASS = 300_000


@dataclass(frozen=True)
class Weights:
    """What turns counts into impacts: documents with terms, all their terms, and the weight of each term."""

    documents: int
    terms: int
    weight: np.ndarray

    def impacts(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 75 + (25 * length * self.documents) // max(1, self.terms)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term, count and length of the row for each posting of a batch (…, n, terms, tfs)."""
    n, terms, tfs = batch.column("n").to_numpy(), batch.column("terms"), batch.column("tfs")
    row = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy())
    return row, terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64), n[row]


def _greatest(term: np.ndarray, impact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest impacts of each term."""
    order = np.lexsort((-impact, term))
    term, impact = term[order], impact[order]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    place = np.arange(len(term)) - np.repeat(starts, np.diff(np.r_[starts, len(term)]))
    return term[place < k], impact[place < k]


class Item:
    """An item's terms from the least bound to the greatest, with their repeats, and the seed of its k-th score."""

    def __init__(self, terms: dict[int, int], top: np.ndarray, kth: np.ndarray):
        term, times = (np.array(x, np.int64) for x in (list(terms), list(terms.values())))
        bound = times * top[term]
        order = np.argsort(bound, kind="stable")
        self.terms, self.times = term[order], times[order]
        self.upto = np.r_[0, bound[order].cumsum()]  # of the terms before each place
        self.seed = int((times * kth[term]).max(initial=0))
        self.scores, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self, k: int) -> int:
        """No score below this is among the k best."""
        return max(self.seed, int(self.scores[-1]) if len(self.scores) == k else 0, 1)

    def candidates(self, postings, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best, and their exact scores."""
        least = self.least(k)
        first = int(np.searchsorted(self.upto, least) - 1)  # terms before this one can't reach the least score
        score = np.zeros(rows, np.int64)
        for t, times in zip(self.terms[first:].tolist(), self.times[first:].tolist(), strict=True):
            row, impact = postings(t)
            score[row] += times * impact
        found = np.flatnonzero((score > 0) & (score + self.upto[first] >= least))
        score = score[found]
        for j in range(first - 1, -1, -1):
            if not len(found):
                break
            row, impact = postings(int(self.terms[j]))
            if len(row):
                at = np.minimum(np.searchsorted(row, found), len(row) - 1)
                score += np.where(row[at] == found, self.times[j] * impact[at], 0)
            kept = score + self.upto[j] >= least
            found, score = found[kept], score[kept]
        kept = score >= least
        return found[kept], score[kept]

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> None:
        scores, ids, none = np.r_[self.scores, scores], np.r_[self.ids, ids], np.r_[self.none, none]
        order = np.lexsort((ids, none, -scores))[:k]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]


def _postings_of(term: np.ndarray, row: np.ndarray, impact: np.ndarray):
    """A function from a term to its rows, in order, and impacts."""
    order = np.argsort(term, kind="stable")
    term, row, impact = term[order], row[order], impact[order]

    def postings(t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(term, (t, t + 1))
        return row[a:b], impact[a:b]

    return postings


def search(
    docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 20
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k highest-scoring documents, equal scores by id.

    Terms are runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII. Only scores above zero
    count, so there are fewer rows for an item whose terms few documents hold, and none for one without terms or with a
    null text. Ids of documents are whole numbers; rows that share an id are documents of their own, and a null id comes
    last among equal scores. Equal rows of items are one item; an item's id may be null. Other columns are left out.
    """
    asked = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("t is not null").distinct()
    size = asked.select(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-size // (4 * WORDS_PER_PASS)))
    out = None
    for part in range(passes):
        mine = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == part)
        found = _pass(docs, mine, id, text, k)
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", "rank", "doc_id", "score")


def _pass(docs: DataFrame, asked: DataFrame, id: str, text: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = sorted(asked.collect(), key=lambda r: (r["i"] is None, r["i"], r["t"]))  # at most WORDS_PER_PASS words
    number: dict[bytes, int] = {}
    terms = [Counter(number.setdefault(w, len(number)) for w in plain_words(r["t"])) for r in rows]
    table = _counted(docs, number, id, text)
    n, total = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the items
        df[r["t"]] = r["count"]
    weights = Weights(n, total, np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64))
    top, kth = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    stored = _stored_impacts(table, weights, k)
    for r in stored.collect():  # a row for each term of the items
        top[r["term"]], kth[r["term"]] = r["top"], r["kth"]
    discard(stored)
    shared = spark.sparkContext.broadcast((weights, terms, top, kth))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, terms, top, kth = shared.value
        own = [Item(x, top, kth) if x else None for x in terms]
        for batch in batches:
            row, term, tf, length = _flat(batch)
            postings = _postings_of(term, row, weights.impacts(term, tf, length))
            ids, none = batch.column("id").fill_null(0).to_numpy(), batch.column("id").is_null().to_numpy(zero_copy_only=False)
            for item in own:
                if item is not None:
                    found, score = item.candidates(postings, batch.num_rows, k)
                    if len(found):
                        item.add(score, ids[found], none[found], k)
        for at, item in enumerate(own):
            if item is not None and len(item.scores):
                yield pa.record_batch([pa.array(np.full(len(item.scores), at, np.int32)), pa.array(item.ids, mask=item.none), pa.array(item.scores)], names=["item", "doc_id", "score"])

    found = table.mapInArrow(best, "item int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", asked.schema["i"].dataType)])
    names = F.broadcast(spark.createDataFrame([(at, r["i"]) for at, r in enumerate(rows)], names))  # the items of a pass
    return found.join(names, "item")


def _counted(docs: DataFrame, number: dict[bytes, int], id: str, text: str) -> DataFrame:
    """id, n (terms), and the items' terms with their counts, of each document: a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def make():
        get = shared.value.get

        def count(texts):
            n, ends, terms, tfs = [], [0], [], []
            for one in texts:
                words = plain_words(one)
                own = Counter(map(get, words))
                own.pop(None, 0)
                n.append(len(words))
                terms += own.keys()
                tfs += own.values()
                ends.append(len(terms))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
            return {"n": n, "terms": lists(terms), "tfs": lists(tfs)}

        return count

    results = T.StructType.fromDDL("n long, terms array<int>, tfs array<int>")
    found = map_text(docs, make, results, text, [id])
    return written(found.select(F.col(f"doc.`{id}`").cast("long").alias("id"), "n", "terms", "tfs"), "postings")


def _stored_impacts(table: DataFrame, weights: Weights, k: int) -> DataFrame:
    """term, its greatest impact, and its k-th greatest (0 if fewer documents hold it): a written table."""
    shared = table.sparkSession.sparkContext.broadcast(weights)

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            _, term, tf, length = _flat(batch)
            held = _greatest(np.r_[held[0], term], np.r_[held[1], shared.value.impacts(term, tf, length)], k)
        yield pa.record_batch([pa.array(held[0]), pa.array(held[1])], names=["term", "impact"])

    found = table.select("n", "terms", "tfs").mapInArrow(greatest, "term int, impact long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    found = found.withColumn("place", place).where(F.col("place") <= k)
    kth = F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0))
    return written(found.groupBy("term").agg(F.max("impact").alias("top"), kth.alias("kth")), "impacts")
