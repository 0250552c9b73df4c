import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corelake.llm import queries
from corelake.llm.runs import collapsed, factors, find_runs, maximal_runs, text_runs

from ..conftest import SMALL


def plain_runs(s, least, exponent):
    """Every period's maximal stretches; of equal stretches the smallest period counts."""
    n, found = len(s), {}
    for p in range(1, n // exponent + 1):
        at = 0
        while at + p < n:
            if s[at] != s[at + p]:
                at += 1
                continue
            end = at
            while end + p < n and s[end] == s[end + p]:
                end += 1
            if end + p - at >= max(least, exponent * p):
                found.setdefault((at, end + p), p)
            at = end + 1
    return sorted((a, b, p) for (a, b), p in found.items())


def plain_factors(s):
    out, at = [], 0
    while at < len(s):
        length = max((k for j in range(at) for k in range(len(s) - at + 1) if s[j : j + k] == s[at : at + k]), default=0)
        out.append((at, max(1, length)))
        at += max(1, length)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_factors(s):
    found = factors(s)
    assert [(a, k) for a, k, _ in found] == plain_factors(s)
    assert all(j < a and s[j : j + k] == s[a : a + k] for a, k, j in found if j >= 0)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 8), st.integers(2, 4))
def test_runs_of_random_values(s, least, exponent):
    assert sorted(maximal_runs(s, least, exponent)) == plain_runs(s, least, exponent)


def nested(rng):
    """Values full of repeats within repeats, and of copies of these."""
    s = [rng.randrange(3) for _ in range(rng.randrange(1, 5))]
    for _ in range(rng.randrange(1, 9)):
        a = rng.randrange(len(s))
        part = s[a : a + rng.randrange(1, 12)]
        s += part * rng.randrange(1, 6) + [rng.randrange(4) for _ in range(rng.randrange(3))]
        if rng.random() < 0.3:
            s += s[rng.randrange(len(s)) :]
        s = s[:400]
    return s


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_nested_repeats(seed):
    rng = random.Random(seed)
    for _ in range(60):
        s = nested(rng)
        for least, exponent in ((1, 2), (6, 2), (24, 3), (9, 3), (5, 4)):
            assert sorted(maximal_runs(s, least, exponent)) == plain_runs(s, least, exponent)
            words = [b"%d" % x for x in s]
            assert [(a, b, p) for a, b, p in text_runs(words, least, exponent)] == sorted(plain_runs(s, least, exponent), key=lambda r: (r[0], r[2]))


def test_time_grows_with_the_words():
    for s in ([0] * 100_000, [k % 333 for k in range(100_000)], [0, 1] * 20_000 + [2] + [0, 1] * 20_000):
        began = time.perf_counter()
        assert len(maximal_runs(s)) in (1, 2)
        assert time.perf_counter() - began < 8


def test_collapsed():
    words = [b"x", *[b"a", b"b"] * 12, b"y"]
    runs = text_runs(words)
    assert runs == [(1, 25, 2)] and collapsed(words, runs) == [b"x", b"a", b"b", b"y"]
    assert text_runs([*[b"a", b"b"] * 11, b"a"]) == []


def test_odd_rows(spark, odd):
    found = find_runs(odd, keep=odd.columns).collect()
    assert len(found) == odd.count()
    for r in found:
        words = (r.doc.text or "").encode().split()
        assert r.n_words == len(words)
        long = r.doc.text and len(r.doc.text) > 10_000
        assert [(x.start, x.length, x.period) for x in r.runs] == ([(0, len(words), 8)] if long else [])
        assert r.collapsed == b" ".join(words[:8] if long else words).decode()
    assert find_runs(odd.limit(0)).count() == 0
    assert find_runs(odd, texts_out=False, keep=[]).where("collapsed is not null").count() == 0


@pytest.fixture(scope="module")
def looping(spark, tmp_path_factory):
    """The small table, and documents that hold several runs."""
    rng = random.Random(3)
    path = tmp_path_factory.mktemp("looping")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    more = [(10_000 + k, " ".join(map(str, nested(rng)))) for k in range(150)] + [(None, "a " * 40), (20_000, None), (20_001, "  "), (20_002, "a\x0bb\tc " * 20)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_op13(spark, looping):
    rows = {r.doc_id: r for r in queries.op13_periodic_runs(spark, looping).collect()}
    docs = spark.read.parquet(f"{looping}/documents.parquet").collect()
    assert len(docs) == len(rows)
    some = 0
    for d in docs:
        words = (d.text or "").encode().split()
        h = zlib.crc32(str(d.doc_id).encode()) if d.doc_id is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        number = {}
        runs = sorted(plain_runs([number.setdefault(w, len(number)) for w in words], 24, 3), key=lambda r: (r[0], r[2]))
        r = rows[d.doc_id]
        some += len(runs)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b - a},{p}\n" for a, b, p in runs).encode()).hexdigest()
        gone = {k for a, b, p in runs for k in range(a + p, b)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
        if runs:
            a, b, p = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (a, b - a, p, 1000 * (b - a) // p)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert some > 100
