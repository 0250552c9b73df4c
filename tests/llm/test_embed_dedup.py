from collections import Counter

import numpy as np
import pytest

from corelake.llm import embed_dedup, queries
from corelake.llm.embed_dedup import CrossPolytope, hadamard, near_duplicates, planned

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, component int, kept string, doc int, no int"


def plain(rows, cosine=0.98):
    """(id, links, component, kept) of rows (id, vector, label), by all pairs."""

    def usable(r):
        return None not in r and len(r[1]) and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])

    fit = [k for k, r in enumerate(rows) if usable(r)]
    unit = {k: (lambda v: v / np.linalg.norm(v))(np.array(rows[k][1], np.float64) / np.abs(rows[k][1]).max()) for k in fit}
    near = {k: [j for j in fit if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in fit}
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen) if len(seen) > 1 else r[0]
        out.append((r[0], len(near.get(k, ())), least, r[0] == least))
    return Counter(out)


def made(seed=0, groups=40, width=64):
    """Groups of near copies at all angles around the threshold, exact and scaled copies, and odd rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=width)
        for _ in range(int(rng.integers(1, 12)) if g else 150):
            v = centre + rng.normal(size=width) * rng.choice([0, 0.01, 0.1, 0.14, 0.2]) * (1 if g else 0.5)
            rows.append(((v * rng.choice([1, 3, 1e-3])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    rows += [rows[k] for k in range(0, len(rows), 7)]
    rng.shuffle(rows := [*rows, *((rng.normal(size=width).astype(np.float32).tolist(), 0) for _ in range(100))])
    rows = [(k, v, label) for k, (v, label) in enumerate(rows)]
    n, v = len(rows), rows[0][1]
    odd = [None, [], [0.0] * width, [float("nan"), *v[1:]], [float("inf"), *v[1:]], [None, *v[1:]], v[:-1], v[:-1], [1.0], [-1.0], [2.0], [1e38] * width, [2e38] * width, [1e-40] * width]
    rows += [(n + k, x, 0) for k, x in enumerate(odd)] + [(n + 50, v, None), (None, v, rows[0][2]), (3, rows[9][1], rows[9][2]), rows[5]]
    return rows


def result(frame):
    return Counter((r.vec_id, r.n_links, r.component, r.kept) for r in frame.select("doc.vec_id", "n_links", "component", "kept").collect())


@pytest.fixture(scope="module")
def rows():
    return made()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA).repartition(5)


def test_equals_all_pairs(spark, rows):
    assert result(near_duplicates(frame(spark, rows))) == plain(rows)


def test_buckets_in_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CHUNK", 20)
    found = near_duplicates(frame(spark, rows), keep=["vec_id"])
    assert result(found) == plain(rows)


def test_other_thresholds_and_few_rows(spark):
    rows = made(1, 8, 12)
    for cosine in (0.9, 0.999):
        assert result(near_duplicates(frame(spark, rows), cosine=cosine)) == plain(rows, cosine)
    assert near_duplicates(frame(spark, [])).count() == 0
    assert result(near_duplicates(frame(spark, rows[-3:]))) == plain(rows[-3:])
    doubles = spark.createDataFrame([(1, [1.0, 0.0], "a|b"), (2, [1.0, 1e-9], "a|b"), (3, [1.0, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    assert result(near_duplicates(doubles)) == Counter([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)])


def test_a_cell_without_the_first_table_counts_each_pair_once():
    """A large bucket of a later table skips pairs that share the first table's bucket."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=16) + rng.normal(size=(400, 16)) * 0.12
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    buckets = CrossPolytope(16, 1, 3).buckets(x)
    total = np.zeros(400, np.int64)
    for t in range(3):
        for b in np.unique(buckets[:, t]):
            at = np.flatnonzero((buckets[:, t] == b).any(1)) if b >= 0 else []
            if len(at) > 1:
                cell = embed_dedup.Cell(t, at, np.zeros(len(at), int), np.ones(len(at), int), buckets[at], x[at], buckets[at, t, 0] == b)
                total[at] += cell.links(0.98)[0]
    met = (buckets[:, None, :, :1] == buckets[None]).any((2, 3))
    np.testing.assert_array_equal(total, ((x @ x.T >= 0.98) & (met | met.T) & ~np.eye(400, dtype=bool)).sum(1))


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 32))
    np.testing.assert_allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    np.testing.assert_allclose(hadamard(hadamard(x)), x)


@pytest.mark.parametrize("vectors", [300, 6000, 10**9])
def test_tables_meet_pairs_at_the_threshold_and_few_others(vectors):
    hashing = planned(64, vectors, 0.98)
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    one = hashing.buckets(a)
    assert embed_dedup._meet(one, hashing.buckets(0.98 * a + np.sqrt(1 - 0.98**2) * b)).any(1).mean() > 0.9995
    assert embed_dedup._meet(one, hashing.buckets(b)).any(1).mean() < 40 * hashing.tables / vectors + 1e-3


def test_query_equals_sql(spark, rows, tmp_path):
    import duckdb

    from corelake.llm import sql

    few = [r for r in rows if r[0] is None or r[0] < 150 or r[0] > len(rows) - 60]
    spark.createDataFrame([r[:3] for r in few], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found = queries.op11_embedding_dedup(spark, str(tmp_path))
    assert Counter(con.execute(sql.op11()).fetchall()) == Counter(map(tuple, found.collect()))
