import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corelake.llm import simhash
from corelake.llm.components import connected_components
from corelake.llm.simhash import fingerprint, keep_one, near_duplicates


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def compare(df, radius=4):
    rows = df.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    classes = plain_classes(prints, radius)
    least = {}
    for r, c in zip(rows, classes, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f, least.get(c)) for r, f, c in zip(rows, prints, classes, strict=True)), key=str)
    got = sorted(((r.id, r.fp % (1 << 64), r.component) for r in near_duplicates(df, radius=radius).collect()), key=str)
    assert got == want


def test_whole_table(small):
    compare(small)


def test_odd_rows(odd):
    compare(odd)
    assert near_duplicates(odd.limit(0)).count() == 0


def test_many_tiles(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_BLOCK", 4)
    monkeypatch.setattr(simhash, "MOST_BLOCK", 4)
    monkeypatch.setattr(simhash, "CHUNK", 16)
    compare(small, radius=12)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(5000))
    whole = fingerprint(text.encode().split())
    monkeypatch.setattr(simhash, "COUNTED", 100)
    assert fingerprint(text.encode().split()) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 4, 9])
def test_close_pairs_are_all_found(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False)) for _ in range(3000)], np.uint64)
    a = np.unique(np.append(base, base[rng.integers(0, 40, 3000)] ^ flips))
    a = a[simhash._order(a)]
    x, y = simhash._close_pairs(a, a, radius, True)
    close = np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= radius, 1))
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [tuple(p) for p in close.tolist()]


def test_components_of_chains_and_hubs(spark):
    rng = np.random.default_rng(0)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 230)] + [(9, 9)]
    pairs += [(int(a), int(b)) for a, b in rng.integers(300, 360, (40, 2))]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {i: find(i) for a, b in pairs if a != b for i in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def test_one_of_each_class_stays(odd, small):
    assert keep_one(odd).columns == odd.columns
    for df in (odd, small):
        kept, found = keep_one(df), near_duplicates(df)
        assert kept.count() == found.select("class").distinct().count()
        ids = {r.component for r in found.where("component is not null").select("component").distinct().collect()}
        assert {r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect()} == ids
