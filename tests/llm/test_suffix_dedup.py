import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corelake.llm import suffix_dedup
from corelake.llm.induced import Shard, repeated
from corelake.llm.suffix_dedup import cut, dedup, runs_of


def plain(texts, depth):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + depth] for b in data for k in range(len(b) - depth + 1))
    out = []
    for b in data:
        covered = np.zeros(len(b), bool)
        for k in range(len(b) - depth + 1):
            if seen[b[k : k + depth]] > 1:
                covered[k : k + depth] = True
        left = bytes(np.frombuffer(b, np.uint8)[~covered])
        spans = int((np.diff(np.append(0, covered.astype(int))) == 1).sum()) if len(b) else 0
        out.append((len(b), int(covered.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def found(df, depth, **more):
    return [(r.doc.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.removed), len(r.removed), r.kept_sha256) for r in dedup(df, depth=depth, **more).collect()]


def compare(df, depth=200, **more):
    rows = df.collect()
    want = [(r.doc_id, *p) for r, p in zip(rows, plain([r.text for r in rows], depth), strict=True)]
    assert sorted(found(df, depth, **more), key=str) == sorted(want, key=str)


def test_whole_table(small):
    compare(small)


def test_odd_rows(odd):
    compare(odd)
    compare(odd, 100)
    assert dedup(odd.limit(0)).count() == 0
    assert cut(odd).columns == odd.columns
    with pytest.raises(ValueError, match="depth"):
        dedup(odd, depth=10)


def test_passages_with_other_surroundings(spark):
    rng = np.random.default_rng(0)
    word = lambda n: "".join(rng.choice(list("abcdéß \n"), n))
    passages = [word(n) for n in (150, 199, 200, 201, 260, 900)]
    texts = [word(int(rng.integers(0, 80))) + str(rng.choice(passages)) + word(int(rng.integers(0, 300))) + str(rng.choice(passages)) for _ in range(60)]
    texts += ["ab" * 400, "x" * 500, "x" * 199, word(3000)] + [texts[0]] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    compare(df)
    compare(df, 120)


def test_pieces_that_many_texts_share(spark):
    """Passages a little shorter or longer than the depth, with few kinds of surroundings: all three grids decide."""
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("ab"), n))
    passages = [word(n) for n in (150, 188, 193, 198, 205)]
    texts = [word(int(rng.integers(0, 9))) + passages[k % 5] + word(int(rng.integers(0, 9))) for k in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    compare(df, shard_bytes=1000)
    compare(df, 140, shard_bytes=500)


def test_stretches_and_spills(spark, small, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 500)
    texts = [(r.text or "").encode() for r in small.collect()][:60] + [b"long " * 900]
    number, _, first, count, _ = runs_of(texts, 200)
    windows = {(k, p) for k, f, n in zip(number.tolist(), first.tolist(), count.tolist(), strict=True) for p in range(f, f + n)}
    assert windows == {(k, p) for k, t in enumerate(texts) for p in range(len(t) - 199)} and count.sum() == len(windows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40) | st.text("ab", min_size=1, max_size=40).map(str.encode), min_size=1, max_size=6), st.integers(1, 8), st.sampled_from([64, 1 << 20]))
def test_induced_sorting(runs, depth, memory):
    shard, suffix, at = Shard(runs, depth), {}, 0
    for r in runs:
        suffix |= {at + k: r[k:] for k in range(len(r))}
        at += len(r) + 1
    order = [p for places, _ in shard.ordered() for p in places.tolist()]
    assert sorted(order) == sorted(suffix) and all(suffix[a] <= suffix[b] for a, b in zip(order, order[1:]))
    seen = Counter(r[k : k + depth] for r in runs for k in range(len(r) - depth + 1))
    want = [[k for k in range(len(r) - depth + 1) if seen[r[k : k + depth]] > 1] for r in runs]
    assert [x.tolist() for x in repeated(runs, depth, memory)] == want


def test_cut_keeps_whole_characters(spark):
    body = "é" * 150
    df = spark.createDataFrame([(0, "aé" + body, "k"), (1, "bé" + body, "k"), (2, None, None)], "doc_id long, text string, more string")
    got = {r.doc_id: r.text for r in cut(df).collect()}
    assert got == {0: "a", 1: "b", 2: None}
