import math
import re
from collections import Counter

import numpy as np
import pytest

from corelake.llm import queries, search, sql
from corelake.llm.search import Item

from ..conftest import SMALL, same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    """(item, rank, id, score) by scoring every document."""
    own = [(i, Counter(words(t))) for i, t in docs]
    n = sum(1 for _, c in own if c)
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def found(frame):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect())


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def asked(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]


def test_op12(spark, texts, asked):
    assert found(queries.op12_ranked_search(spark, SMALL)) == plain(texts, asked)


def test_op12_equals_sql(spark, duck):
    assert same(duck.execute(sql.op12()).df(), queries.op12_ranked_search(spark, SMALL).toPandas())


def test_ties_passes_and_odd_items(spark, texts, monkeypatch):
    docs = [*texts[:40], *texts[:40], (None, texts[3][1]), (900, "Straße 漢字 x9"), (901, "straße漢字"), (902, None), (903, "")]
    items = [(1, texts[0][1]), (2, "The THE the of"), (3, None), (4, ""), (5, "nowhere-to-be-found"), (None, "STRAßE x9"), (7, "Straße 漢字"), (7, "x9"), (1, texts[0][1])]
    a = spark.createDataFrame([(*r, "e", 1) for r in docs], "doc_id long, text string, score string, item int").repartition(4)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    want = plain(docs, list(dict.fromkeys(items)), 5)
    assert found(search.search(a, b, k=5)) == want
    monkeypatch.setattr(search, "WORDS_PER_PASS", 30)
    assert found(search.search(a, b, k=5)) == want
    assert search.search(a.limit(0), b).count() == 0
    assert search.search(a, b.limit(0)).count() == 0
    assert search.search(a.where("text is null"), b).count() == 0


def test_odd_rows(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = spark.createDataFrame([(1, "quick lazy seven"), (2, "ñ nul")], "item_id long, text string")
    assert found(search.search(odd, items)) == plain(docs, [(1, "quick lazy seven"), (2, "ñ nul")])


@pytest.mark.parametrize("seed", range(20))
def test_pruning_is_safe(seed):
    """Candidates of random postings hold the k best with their scores, and pruning leaves documents out."""
    rng = np.random.default_rng(seed)
    rows, terms, k = 300, 12, 5
    weight = rng.integers(1, 10_000, terms)
    impact = weight[:, None] * rng.integers(0, 50, (terms, rows)) * (rng.random((terms, rows)) < rng.random((terms, 1)))
    best = -np.sort(-impact, axis=1)
    times = {t: int(rng.integers(1, 3)) for t in range(terms)}
    item = Item(times, best[:, 0], best[:, k - 1])
    postings = lambda t: ((r := np.flatnonzero(impact[t])), impact[t][r])
    got, score = item.candidates(postings, rows, k)
    whole = sum(n * impact[t] for t, n in times.items())
    np.testing.assert_array_equal(score, whole[got])
    last = np.sort(whole)[-k]
    assert set(np.flatnonzero((whole >= last) & (whole > 0))) <= set(got.tolist())
    item.add(score, got, np.zeros(len(got), bool), k)
    again, _ = item.candidates(postings, rows, k)
    assert set(again) == set(np.flatnonzero(whole >= max(last, 1)))
