import hashlib

import pytest

from corelake.llm import decontam
from corelake.llm.common import plain_words
from corelake.llm.decontam import find_contamination

from ..conftest import SMALL, same


def plain(texts, items, window=13):
    patterns = {}
    for name, text in items:
        words = plain_words(text)
        for k in range(max(1, len(words) - window + 1)):
            if part := tuple(words[k : k + window]):
                patterns.setdefault(part, set()).add(name)
    out = []
    for text in texts:
        words, hit, names = plain_words(text), set(), set()
        for size in {len(p) for p in patterns}:
            for k in range(len(words) - size + 1):
                if own := patterns.get(tuple(words[k : k + size])):
                    names |= own
                    hit |= set(range(k, k + size))
        out.append((len(words), len(hit), sorted(names - {None}), bool(hit) and 20 * len(hit) >= len(words)))
    return out


ITEMS = [("7", "One two THREE four"), ("7", "One two THREE four"), ("10", " ".join(f"w{k}" for k in range(30))), ("11", "fox"), ("12", "a b a b a b a b a b a b a b a b"), ("13", None), (None, "one"), (None, "w1 w2"), ("14", "..."), ("15", "lazy dogs the"), ("9", "w5 w6 w7 w8 w9")]
TEXTS = [" ".join(f"w{k}" for k in range(40)), "x " * 200 + " ".join(f"W{k}," for k in range(3, 20)), "a b " * 9, "b " + "a b " * 9, "fox", "w5 w6 w7 w8 w9 w10", "one-two_three.four five", ""]


def compare(spark, docs, items):
    rows = docs.collect()
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    want = sorted((str(r.doc_id), *p) for r, p in zip(rows, plain([r.text for r in rows], [i for i in items if i[1] is not None]), strict=True))
    got = sorted((str(r.doc.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in find_contamination(docs, benchmark).collect())
    assert got == want


def test_brute_force(spark, odd):
    compare(spark, odd, ITEMS)
    compare(spark, spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), ITEMS)
    compare(spark, odd, [])
    assert find_contamination(odd.limit(0), spark.createDataFrame(ITEMS, "item_id string, text string")).count() == 0


def test_several_passes(spark, odd, monkeypatch):
    monkeypatch.setattr(decontam, "WORDS_PER_PASS", 20)
    compare(spark, odd, ITEMS)
    compare(spark, spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), ITEMS)


@pytest.mark.parametrize("k", [0, 3])
def test_copied_passage_in_each_place(spark, small, k):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect()[k]
    docs = spark.createDataFrame([(0, "Zz " * 50 + item.text + " yy" * 50), (1, "Zz " * 50)], "doc_id long, text string")
    got = {r.doc.doc_id: (r["items"], r.contaminated) for r in find_contamination(docs, spark.createDataFrame([item])).collect()}
    assert got == {0: ([str(item.item_id)], True), 1: ([], False)}


def test_query_equals_sql(spark, duck):
    from corelake.llm import queries, sql

    for name, text in sql.oracle_sql().items():
        assert same(duck.execute(text).df(), queries.queries()[name](spark, SMALL).toPandas())
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in queries.op7_decontamination(spark, SMALL).collect()}
