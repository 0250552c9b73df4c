"""Quality by co-training: a classifier of the text and one of the metadata teach each other, then score all.

The two views are fitted on a bounded sample of labelled rows. In each round, either view scores all other documents
in Spark, those of which it is most confident get its label, and they join the other view's training rows. Each view
is then calibrated on labelled rows that took no part, and the calibrated log odds are added (the views are taken as
independent, given the class). Two targets are learned so: good quality, and toxic. The words of the text view are
chosen by counts that Spark takes over the sample; every document is scored in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, plain_words, written

#: Defaults of learn(): labelled rows in the sample, words of the text view, rounds, and documents that a view labels in
#: each round. Rows of the sample that hold a word at least, for it to be one of them.
LABELLED, WORDS, ROUNDS, TAUGHT, LEAST = 8000, 4000, 4, 100, 8
TARGETS = ("quality", "toxic")
#: Steps of a fit: of the first one, and of those that start from the weights of the round before.
FIRST_STEPS, STEPS = 300, 80
#: Share of the labelled rows for calibration, and buckets of the metadata view.
HELD, BUCKETS = 0.3, 512


def text_stats(data: bytes, words: list[bytes]) -> np.ndarray:
    """Shares of signs, capitals, digits and white space, and how the words repeat."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    n, m = max(1, len(data)), max(1, len(words))
    signs = np.concatenate([counts[33:48], counts[58:65], counts[91:97], counts[123:127]])
    more = [signs.sum(), counts[65:91].sum(), counts[48:58].sum(), counts[10], counts[32], counts[128:].sum()]
    shares = np.sqrt(np.concatenate([signs, more]) / n)
    distinct = len(set(words)) / m
    follow = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    rest = [distinct, follow, np.log1p(m) / 10, min(4.0, n / m / 10), float(m < 5), 1.0]
    return np.concatenate([shares, rest])


#: Numbers that text_stats gives.
STATS = len(text_stats(b"", []))


def metadata(source: str | None, lang: str | None, n_chars: float | None) -> list[int]:
    """Buckets of what is known about a document besides its text; a null is a value of its own."""
    size = None if n_chars is None else int(np.log2(max(1.0, n_chars)) * 2)
    parts = (f"source={source}", f"lang={lang}", f"size={size}", f"lang={lang} size={size}")
    return [xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts]


class Sparse:
    """A matrix of rows with column numbers (value 1) beside a dense part."""

    def __init__(self, dense: np.ndarray, column: np.ndarray, size: np.ndarray, width: int):
        """size: how many of column belong to each row."""
        self.dense, self.width, self.column, self.size = dense, width, column, size
        self.row = np.repeat(np.arange(len(size)), size)
        # long texts hold more words; their weights are damped alike
        self.value = 1 / np.sqrt(1 + np.log1p(size))[self.row]

    @classmethod
    def of(cls, dense: list, columns: list[list[int]], width: int, deep: int) -> Sparse:
        return cls(np.array(dense, np.float64).reshape(len(columns), deep), np.array([k for c in columns for k in c], np.int64), np.array([len(c) for c in columns], np.int64), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], len(self.size)) + self.dense @ w[self.width :]

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, self.value * r[self.row], self.width), self.dense.T @ r])


def fit(x: Sparse, y: np.ndarray, start: np.ndarray, steps: int, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, by Adam on all rows, from the given ones."""
    w = start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        g = x.transposed(p - y) / max(1, len(y)) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (score, y), smoothed towards the prior."""
    prior = (y.sum() + 1) / (len(y) + 2)
    a, b = 0.0, float(np.log(prior / (1 - prior)))
    if len(np.unique(y)) < 2:
        return a, b
    scale = max(1e-9, float(np.std(score)))
    s = score / scale
    for _ in range(100):  # Newton steps on two numbers
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        r, h = p - y, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(r * s).sum() + 0.1 * a, r.sum()])
        hess = np.array([[(h * s * s).sum() + 0.1, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return a / scale, b


def views(features: list[tuple], words: int) -> tuple[Sparse, Sparse]:
    """The text view and the metadata view of rows of features."""
    return Sparse.of([f[0] for f in features], [f[1] for f in features], words, STATS), Sparse.of([[1.0]] * len(features), [f[2] for f in features], BUCKETS, 1)


def co_train(features: list[tuple], labels: dict[str, np.ndarray], held: np.ndarray, words: int, confident: Callable, rounds: int, taught: int) -> dict[str, list]:
    """For each target (weights, slope, offset) of each view, and the prior log odds last.

    features and labels (0, 1, or -1 if unknown) are those of the sample, held its rows for calibration. confident(weights,
    known, most) gives for (target, view, side) the documents, as (id, features), of which the view is most confident;
    known has the ids that each view was taught, which the other view passes over, and most how many are wanted.
    """
    weights, extra = {}, {(t, v): [] for t in labels for v in (0, 1)}
    most = {}
    for t, y in labels.items():
        own = y[(y >= 0) & ~held]
        share = own.mean() if len(own) else 0.5
        most[t, 1], most[t, 0] = max(1, int(taught * share)), max(1, int(taught * (1 - share)))
    for turn in range(rounds + 1):
        for (t, v), more in extra.items():
            own = np.flatnonzero((labels[t] >= 0) & ~held)
            x = views([features[k] for k in own] + [f for _, f, _ in more], words)[v]
            y = np.concatenate([labels[t][own], [label for *_, label in more]])
            start = weights.get((t, v), np.zeros(x.width + x.dense.shape[1]))
            weights[t, v] = fit(x, y, start, FIRST_STEPS if turn == 0 else STEPS) if len(y) else start
        if turn == rounds:
            break
        known = {key: {k for k, *_ in more} for key, more in extra.items()}
        for (t, v, side), found in confident(weights, known, most).items():
            extra[t, 1 - v] += [(k, f, side) for k, f in found]
    out = {}
    for t, y in labels.items():
        rows = np.flatnonzero(held & (y >= 0))
        both = views([features[k] for k in rows], words)
        known = y[y >= 0]
        prior = (known.sum() + 1) / (len(known) + 2)
        own = [(weights[t, v], *(calibrate(both[v].times(weights[t, v]), y[rows].astype(np.float64)) if len(rows) else (0.0, float(np.log(prior / (1 - prior)))))) for v in (0, 1)]
        out[t] = [*own, float(np.log(prior / (1 - prior)))]
    return out


def _columns(docs: DataFrame, text: str, source: str, lang: str, n_chars: str) -> list:
    null = F.lit(None)
    named = lambda c, t, a: (F.col(f"`{c}`") if c in docs.columns else null).cast(t).alias(a)
    return [named(text, "string", "_t"), named(source, "string", "_s"), named(lang, "string", "_l"), named(n_chars, "double", "_n")]


def learn(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars",
    labelled: int = LABELLED, words: int = WORDS, rounds: int = ROUNDS, taught: int = TAUGHT,
):
    """A broadcast model from at most so many labelled rows, those of the smallest hashes of ids, and all other documents.

    A row of labels counts for a target where that label isn't null and its document is there; of repeated labels the
    largest holds, of repeated ids the text of the smallest hash. Documents without an id are scored only. Without any
    labelled row every document scores one half.
    """
    spark = docs.sparkSession
    label = lambda c: F.max(F.col(f"`{c}`").cast("int") if c in labels.columns else F.lit(None).cast("int")).alias(c)
    known = labels.select(F.col(f"`{id}`").cast("long").alias("k"), *[c for c in TARGETS if c in labels.columns]).groupBy("k").agg(*map(label, TARGETS))
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("k"), *_columns(docs, text, source, lang, n_chars)).where("k is not null")
    known = known.where("quality is not null or toxic is not null").join(rows.select("k"), "k", "left_semi")
    known = written(known.orderBy(F.xxhash64("k"), "k").limit(labelled), "labelled")
    # rows of three numbers, as many as the parameter says
    sample = rows.join(F.broadcast(known), "k").withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("_t"), "_t"))).where("_r = 1").drop("_r")
    sample = written(sample, "quality")

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, quality, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = sorted({w.decode("utf-8", "surrogateescape") for w in plain_words(one)})
                n = len(found)
                yield pa.record_batch({"w": pa.array(found, pa.string()), "quality": pa.array([quality] * n, pa.int32()), "toxic": pa.array([toxic] * n, pa.int32())})

    held_words = sample.select("_t", "quality", "toxic").mapInArrow(word_rows, "w string, quality int, toxic int")
    held_words = held_words.groupBy("w").agg(F.count("*").alias("n"), F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    mean = sample.agg(F.avg("quality").alias("mq"), F.avg("toxic").alias("mt"))
    signal = F.greatest(*[F.coalesce(F.abs(F.col(a) - F.col(b)) / F.sqrt(F.col(b) * (1 - F.col(b)) + 0.01), F.lit(0.0)) for a, b in (("q", "mq"), ("t", "mt"))]) * F.sqrt("n")
    held_words = held_words.where(F.col("n") >= LEAST).crossJoin(F.broadcast(mean)).orderBy(F.desc(signal), "w").limit(words)  # mean is one row
    vocabulary = {r["w"].encode(): k for k, r in enumerate(held_words.select("w").collect())}
    shared = spark.sparkContext.broadcast(vocabulary)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, *_features(t, s, la, n, shared.value)) for k, t, s, la, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if out:
                types = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["k", "stats", "words", "meta"])

    inputs, schema = ("k", "_t", "_s", "_l", "_n"), f"k long, {_FEATURES}"
    got = sample.select(*inputs).mapInArrow(features, schema).join(F.broadcast(known), "k").orderBy("k").collect()  # as many as the parameter says
    if not got:
        return spark.sparkContext.broadcast((vocabulary, None))
    others = written(rows.join(F.broadcast(known.select("k")), "k", "left_anti").select(*inputs).mapInArrow(features, schema), "unlabelled")
    held = np.random.default_rng(3).random(len(got)) < HELD
    own = {c: np.array([-1 if r[c] is None else r[c] for r in got]) for c in TARGETS}
    models = co_train([(r["stats"], r["words"], r["meta"]) for r in got], own, held, len(vocabulary), lambda *a: _confident(others, len(vocabulary), *a), rounds, taught)
    discard(others)
    return spark.sparkContext.broadcast((vocabulary, models))


_FEATURES = "stats array<double>, words array<int>, meta array<int>"


def _confident(others: DataFrame, words: int, weights: dict, known: dict, most: dict) -> dict:
    """See co_train: scores all rows of features; each task returns its best ones, the best of all reach the driver.

    A view is confident at log odds beyond 1; of equal scores the smallest hash of the id comes first.
    """
    shared = others.sparkSession.sparkContext.broadcast((weights, {key: np.array(sorted(ids), np.int64) for key, ids in known.items()}, most))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, most = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy()
            lists = [(c.flatten().to_numpy(), pc.list_value_length(c).to_numpy()) for c in batch.columns[1:]]
            both = (Sparse(lists[0][0].reshape(len(k), -1), *lists[1], words), Sparse(np.ones((len(k), 1)), *lists[2], BUCKETS))
            order = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in k], np.uint64)
            for (t, v), w in weights.items():
                found = both[v].times(w)
                free = ~np.isin(k, known[t, 1 - v])
                for side in (1, 0):
                    sure = np.flatnonzero(free & ((found > 1.0) if side else (found < -1.0)))
                    sure = sure[np.lexsort((order[sure], -found[sure] if side else found[sure]))]
                    sure = sure[np.sort(np.unique(k[sure], return_index=True)[1])][: most[t, side]]  # an id counts once
                    n = len(sure)
                    part = batch.take(pa.array(sure))
                    yield pa.RecordBatch.from_arrays([pa.array([t] * n, pa.string()), pa.array([v] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(-np.abs(found[sure])), pa.array(order[sure].view(np.int64)), *part.columns], names=["t", "v", "side", "least", "hash", *part.schema.names])

    rows = others.mapInArrow(score, f"t string, v int, side int, least double, hash long, k long, {_FEATURES}")
    # of a repeated id the surest row, then the surest ids; hashes are unsigned
    by = [F.col("least"), F.expr("hash < 0"), F.col("hash")]
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("t", "v", "side", "k").orderBy(*by))).where("_n = 1")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("t", "v", "side").orderBy(*by))).where(F.col("_n") <= max(most.values()))
    out: dict = {}
    for r in rows.orderBy("t", "v", "side", "_n").collect():
        if r["_n"] <= most[r["t"], r["side"]]:
            out.setdefault((r["t"], r["v"], r["side"]), []).append((r["k"], (r["stats"], r["words"], r["meta"])))
    return out


def _features(text, source, lang, n_chars, vocabulary) -> tuple[list[float], list[int], list[int]]:
    words = plain_words(text)
    stats = text_stats((text or "").encode("utf-8", "surrogatepass"), words)
    return stats.tolist(), sorted(vocabulary[w] for w in vocabulary.keys() & set(words)), metadata(source, lang, n_chars)


def score_quality(docs: DataFrame, model, *, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc, quality, toxic (probabilities) and score, quality * (1 - toxic).

    A null text is empty; null or missing metadata is a value of its own.
    """
    kept = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), *_columns(docs, text, source, lang, n_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, models = model.value
        for batch in batches:
            found = [_features(*r, vocabulary) for r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            both = views(found, len(vocabulary)) if found else ()
            out = {}
            for target in TARGETS:
                if models is None or not found:
                    out[target] = np.full(len(found), 0.5)
                    continue
                *own, prior = models[target]
                odds = sum(a * v.times(w) + b for v, (w, a, b) in zip(both, own, strict=True)) - prior
                out[target] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            out["score"] = out["quality"] * (1 - out["toxic"])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n]) for n in ("quality", "toxic", "score"))], names=["doc", "quality", "toxic", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *T.StructType.fromDDL("quality double, toxic double, score double").fields]))
