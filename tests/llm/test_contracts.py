"""Each registered query against a plain statement of what it returns, on whole small tables."""

import html
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corelake.llm import licenses, queries

from ..conftest import SMALL
from .test_models import Plain
from .test_simhash import plain_classes, plain_fingerprint
from .test_suffix_dedup import plain as plain_repeats


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_op1(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*coder.encode(r.text or "", add_special_tokens=False).ids, 1] for k, r in documents.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op1_packing(spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for k, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[k])) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[k])
    total = padded = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        total += at
        assert at <= 2048
        padded += at if at & (at - 1) == 0 else 2048
    assert total == sum(map(len, ids.values())) and padded <= 1.01 * total


def test_op2(spark):
    path = SMALL.replace("0.001", "0.01")
    documents = {r.doc_id for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op2_quality(spark, path).collect()}
    assert rows.keys() == documents
    for r in rows.values():
        assert 0 <= r.quality <= 1 and 0 <= r.toxic <= 1 and abs(r.score - r.quality * (1 - r.toxic)) < 1e-12 and r.keep == (r.score >= 0.5)
    truth = {r.doc_id: r for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert np.mean([rows[k].keep == (r.quality == 1 and r.toxic == 0) for k, r in truth.items()]) > 0.9


def test_op3(spark):
    rows = sorted((r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect())
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = defaultdict(list)
    for r in queries.op3_nearest_neighbours(spark, SMALL).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    assert sorted(found) == [i for i in ids.tolist() if i % 20 == 0]
    recall = []
    for q, own in found.items():
        score = x @ x[ids == q][0]
        best = sorted((-s, i) for i, s in zip(ids.tolist(), score.tolist()) if i != q)[:20]
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len(own) == len(best)
        assert all(abs(r.score - score[ids == r.vec_id][0]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        recall.append(len({r.vec_id for r in own} & {i for _, i in best}) / len(best))
    assert np.mean(recall) >= 0.9


def test_op4(spark, documents):
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in documents}
    model = Plain([r.text for k, r in documents.items() if not held[k]])
    found = {r.doc_id: r for r in queries.op4_lm_scoring(spark, SMALL).collect()}
    assert found.keys() == documents.keys()
    for k, r in found.items():
        n, known, total, base, score = model.row(documents[k].text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_op5(spark, documents):
    rows = {r.doc_id: r for r in queries.op5_language_id(spark, SMALL).collect()}
    assert rows.keys() == documents.keys()
    held = {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in documents}
    learned = {r.lang for k, r in documents.items() if not held[k] and r.lang is not None}
    for k, r in rows.items():
        letters = any(c.isalpha() for c in documents[k].text or "")
        assert r.held_out == held[k] and 0 <= r.score <= 1 and r.lang_pred in (learned if letters else {"und"})
    right = [rows[k].lang_pred == documents[k].lang for k in rows if held[k] and documents[k].lang in learned and rows[k].lang_pred != "und"]
    assert np.mean(right) > 0.95


def test_op6(spark, documents):
    found = {r.doc_id: r for r in queries.op6_license_scan(spark, SMALL).collect()}
    assert found.keys() == documents.keys()
    for k, r in found.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in documents[k].text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(n, label) for phrase, label in licenses.PHRASES.items() for n in range(len(words)) if words[n : n + len(phrase.split())] == phrase.split()]
        starts = [n for n, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        own = r.labels.split(",") if r.labels else []
        assert own == sorted(set(own)) and {x for _, x in places} <= set(own) and 0 <= r.score <= 1


def test_op6_equals_sql(spark, tmp_path):
    """The table, and texts of every template and declaration, some of them denied or a word short."""
    import duckdb

    from corelake.llm import sql

    from .test_models import _filled

    texts = []
    for template in (licenses.TEMPLATES | licenses.DECLARATIONS).values():
        words = [_filled(licenses.parsed(template), full, k) for full, k in ((True, 0), (False, 1))]
        texts += [" ".join(x) for own in words for x in (own, own[:-1], ["it", "is", "not", *own], ["It is not so.", *own, "and", "never"], [*own, ".", *own[1:]])]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate([*texts, None, ""])], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = {r[0]: tuple(r) for r in queries.op6_license_scan(spark, str(tmp_path)).collect()}
    want = {r[0]: r for r in con.execute(sql.op6()).fetchall()}
    assert found == want
    assert {x for r in found.values() for x in r[6].split(",")} >= licenses.TEMPLATES.keys() | licenses.DECLARATIONS.keys()


def test_op8(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = {r.page_id: r for r in queries.op8_html_extraction(spark, SMALL).collect()}
    assert found.keys() == pages.keys()
    for k, r in found.items():
        assert r.url == pages[k].url and r.n_chars == len(r.text)
        # the article of these pages, by a reading of its own
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[k].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_op9(spark, documents):
    prints = {k: plain_fingerprint(r.text) for k, r in sorted(documents.items())}
    classes = dict(zip(prints, plain_classes(list(prints.values()), 4), strict=True))
    least = {}
    for k, c in classes.items():
        least[c] = min(least.get(c, k), k)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SMALL).collect()}
    assert found == {k: (f"{prints[k]:016x}", least[c]) for k, c in classes.items()}


def test_op10(spark, documents):
    want = dict(zip(documents, plain_repeats([r.text for r in documents.values()], 200), strict=True))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_suffix_dedup(spark, SMALL).collect()}
    assert found == want
