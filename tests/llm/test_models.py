"""Language model, language ID, quality, licenses, extraction and nearest neighbours."""

import html
import itertools
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corelake.llm import ann, extract, langid, licenses, lm, quality
from corelake.llm.common import plain_words, space_words

from ..conftest import SMALL


# --- language model ---


class Plain:
    """The model by dictionaries of exact words."""

    def __init__(self, texts, order=2):
        self.order = order
        grams = {order: Counter()}
        for t in texts:
            words = self.words(t)
            grams[order].update(words[k : k + order] for k in range(len(words) - order + 1))
        for k in range(order - 1, 0, -1):
            grams[k] = Counter(g[1:] for g in grams[k + 1])
        self.grams, self.tokens = grams, Counter()
        for g, n in grams[order].items():
            self.tokens[g[-1]] += n
        self.after, self.kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for k in range(2, order + 1):
            for g, n in grams[k].items():
                self.after[g[:-1]] += n
                self.kinds[g[:-1]][min(n, 3) - 1] += 1
        self.d = {k: lm.discounts([sum(x == n for x in c.values()) for n in (1, 2, 3, 4)]) for k, c in grams.items()}
        m = [sum(min(x, 3) == k for x in grams[1].values()) for k in (1, 2, 3)]
        self.unknown = sum(a * b for a, b in zip(self.d[1][1:], m)) / len(grams[2]) / (len(self.tokens) + 1) if grams[2] else 1.0

    def words(self, text):
        return (*["<"] * (self.order - 1), *space_words(text), ">")

    def p(self, *gram):
        n, k = self.grams[len(gram)][gram], len(gram)
        if k == 1:
            return (n - self.d[1][min(n, 3)]) / max(1, len(self.grams[2])) + self.unknown
        h = gram[:-1]
        if not self.after[h]:
            return self.p(*gram[1:])
        return (n - self.d[k][min(n, 3)] + sum(a * b for a, b in zip(self.d[k][1:], self.kinds[h])) * self.p(*gram[1:])) / self.after[h]

    def row(self, text):
        words, n = self.words(text), self.order
        total, v = sum(self.tokens.values()), len(self.tokens)
        own = words[n - 1 :]
        return (len(own), sum(self.tokens[w] > 0 for w in own), total, sum(math.log10((self.tokens[w] + 1) / (total + v + 1)) for w in own), sum(math.log10(self.p(*words[k : k + n])) for k in range(len(own))))


def check_model(df, learned, order=2, **more):
    plain = Plain([r.text for r in learned.collect()], order)
    assert abs(sum(plain.p(w) for w in plain.tokens) + plain.unknown - 1) < 1e-9
    for h in list(plain.after)[:5] + list(plain.after)[-5:]:
        assert abs(sum(plain.p(*h, w) for w in plain.tokens) + plain.p(*h, b"unseen word") - 1) < 1e-9
    rows = sorted((str(r.doc_id), *np.round(plain.row(r.text), 6).tolist()) for r in df.collect())
    got = lm.perplexity(df, lm.train(learned, order=order, **more)).collect()
    assert sorted((str(r.doc.doc_id), *np.round([r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score], 6).tolist()) for r in got) == rows


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model_equals_plain_one(small, odd, order):
    check_model(small.limit(60), small.where("doc_id % 7 != 2"), order, shards=64)
    check_model(odd, odd, order)
    if order == 3:
        check_model(odd, odd.limit(0), order)


def test_small_parts_and_batches(small, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 500)
    check_model(small.limit(20), small.limit(80), 3)
    with pytest.raises(ValueError, match="order"):
        lm.train(small, order=1)


def test_higher_order_tells_more(small):
    """Texts that were learned are likelier, and likelier still with longer contexts."""
    score = [lm.perplexity(small, lm.train(small, order=n)).agg(F.sum("score")).first()[0] for n in (2, 3)]
    assert score[1] > score[0]


def test_held_out_texts_are_likelier_than_by_word_counts(small):
    held = small.where("doc_id % 7 = 2")
    s = lm.perplexity(held, lm.train(small.where("doc_id % 7 != 2"))).agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


# --- language ID ---


def test_held_out_languages(small):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = langid.identify(small.where(held), langid.learn(small, where=~held))
    right = found.where(F.length("doc.text") > 60).agg(F.avg((F.col("lang_pred") == F.col("doc.lang")).cast("int"))).first()[0]
    assert right > 0.97


def test_odd_texts_and_spans(spark, small, odd):
    model = langid.learn(small)
    got = {str(r.doc.doc_id): r for r in langid.identify(odd, model).collect()}
    for k in ("0", "1", "2", "8"):
        assert (got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, [])
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.learn(odd.where("lang is null")) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0
    parts = {lang: " ".join(r.text for r in small.where((F.col("lang") == lang) & (F.length("text") > 200)).orderBy("doc_id").limit(2).collect())[:600] for lang in ("en", "es")}
    mixed = spark.createDataFrame([(0, parts["en"] + " " + parts["es"] + " " + parts["en"])], "doc_id long, text string")
    spans = [s.lang for s in langid.identify(mixed, model).first().spans]
    assert spans == ["en", "es", "en"]


def plain_path(scores, switch):
    """Every sequence of labels."""
    best = (-math.inf, ())
    n, kinds = scores.shape
    for code in range(kinds**n):
        labels = [code // kinds**k % kinds for k in range(n)]
        value = sum(scores[k, x] for k, x in enumerate(labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:]))
        best = max(best, (round(float(value), 6), tuple(labels)), key=lambda x: x[0])
    return best[0]


def test_paths_are_best_ones():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 1, 0, 4, 6, 3])
    for switch in (0.5, 2.0, 6.0):
        scores = -rng.exponential(2.0, (lengths.sum(), 3)).astype(np.float32)
        labels = langid.best_labels(scores, lengths, switch)
        at = 0
        for n in lengths:
            s, x = scores[at : at + n], labels[at : at + n]
            value = sum(s[k, j] for k, j in enumerate(x)) - switch * sum(a != b for a, b in zip(x, x[1:]))
            assert abs(float(value) - plain_path(s, switch)) < 1e-4
            at += n


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 5), st.lists(st.lists(st.integers(-16, 0), min_size=5, max_size=5), min_size=1, max_size=5), st.sampled_from([2.0, 5.0, 12.0]))
def test_best_of_all_paths(kinds, rows, switch):
    scores = np.array(rows, np.float32)[:, :kinds] / 2
    value = lambda path: scores[np.arange(len(path)), path].sum() - switch * (np.diff(path) != 0).sum()
    best = max(value(np.array(p)) for p in itertools.product(range(kinds), repeat=len(scores)))
    assert abs(value(langid.best_labels(scores, np.array([len(scores)]), switch)) - best) < 1e-4


def test_three_languages_of_short_stretches():
    """No stretch gains a whole change over the best constant label, but two gain one together."""
    scores = np.array([[0, -8, -2.4]] * 3 + [[-8, 0, -2.4]] * 3, np.float32)
    assert langid.best_labels(scores, np.array([6]), 12.0).tolist() == [0, 0, 0, 1, 1, 1]
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 12, 2000)
    scores = -rng.uniform(0, 8, (lengths.sum(), 3)).astype(np.float32)
    assert (langid.best_labels(scores, lengths, 6.0) == langid.viterbi(scores, lengths, 6.0)).all()


def test_long_texts_in_stretches():
    rng = np.random.default_rng(5)
    for k in range(60):
        n = int(rng.integers(8, 60))
        scores = np.round(rng.normal(size=(n, 4)) * (0.5 if k % 2 else 3), 1).astype(np.float32)
        part = lambda a, b, scores=scores: scores[a:b]
        labels = np.zeros(n, np.int16)
        for start, _, own in langid.viterbi_in_stretches(n, part, 5.0, 7):
            labels[start : start + len(own)] = own
        value = lambda x, scores=scores, n=n: scores[np.arange(n), x].sum() - 5.0 * (np.diff(x) != 0).sum()
        best = langid.viterbi(scores, np.array([n]), 5.0)
        assert abs(value(labels) - value(best)) < 1e-4
        if (c := langid.constant_label(n, part, 5.0, 7)) is not None:
            assert abs(value(np.full(n, c)) - value(best)) < 1e-4


def test_texts_longer_than_a_stretch(spark, small):
    """A text of more scores than are held at once: spans follow one another, and each language is found where it stands."""
    texts = {r.lang: r.text for r in small.where("lang is not null and length(text) between 2000 and 9000").orderBy("doc_id").collect()}
    n = langid.SCORES // len(texts)
    parts = [(lang, " ".join([t] * (n // len(t.split()) + 1))) for lang, t in sorted(texts.items())[:2]]
    df = spark.createDataFrame([(0, parts[0][1] + " " + parts[1][1])], "doc_id long, text string")
    r = langid.identify(df, langid.learn(small)).first()
    assert [s.lang for s in r.spans] == [lang for lang, _ in parts] and r.spans[0].end == r.spans[1].start


def test_many_languages(spark):
    """300 languages, each of words of its own: every text gets its language, in labels beyond a byte."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    words = [[word() for _ in range(6)] for _ in range(300)]
    rows = [(k * 300 + n, " ".join(rng.permutation(own)), f"l{n:03}") for n, own in enumerate(words) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    found = langid.identify(df, langid.learn(df)).select("doc.lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


def test_scripts_exclude_languages(spark):
    docs = spark.createDataFrame([(0, "the house and the garden of the old man " * 20, "en"), (1, "привет дом и сад старого человека " * 20, "ru")], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    texts = [(0, "the house привет the garden"), (1, "½ ② Ⅳ 12 _"), (2, "x²y the ½house")]
    got = langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).orderBy("doc.doc_id").collect()
    assert [s.lang for s in got[0].spans] == ["en", "ru", "en"]
    assert (got[1].lang_pred, got[1].score, got[1].spans) == ("und", 0.0, [])
    assert got[2].lang_pred == "en" and got[2].spans[-1].end == 4


def test_scripts_narrow_the_candidates(spark):
    rows = [(k, "en", "the house and the garden") for k in range(5)] + [(k, "ru", "дом и сад там") for k in range(5, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.learn(docs)
    got = langid.identify(spark.createDataFrame([(0, "неизвестно"), (1, "unknown"), (2, "漢字")], "doc_id long, text string"), model).orderBy("doc.doc_id").collect()
    assert [r.lang_pred for r in got[:2]] == ["ru", "en"]


# --- quality ---


def test_held_out_labels(spark):
    """Fitted on two thirds of the labels, measured on the others."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 1
    found = quality.score_quality(rows, quality.learn(rows, labels.where(~held))).select("doc.doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t"), "score")
    r = found.join(labels.where(held), "doc_id").agg(F.avg(((F.col("q") >= 0.5) == (F.col("quality") == 1)).cast("int")), F.avg(((F.col("t") >= 0.5) == (F.col("toxic") == 1)).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.93 and r[1] > 0.9 and 0 <= r[2] <= r[3] <= 1
    assert found.count() == rows.count()


def plain_confident(others, words, weights, known, most):
    """Plain sorting of all rows (id, features) by log odds, then by hash of the id."""
    out = {}
    both = quality.views([f for _, f in others], words)
    for (t, v), w in weights.items():
        score = both[v].times(w)
        for side in (1, 0):
            sure = sorted((-abs(s), xxhash.xxh64_intdigest(np.int64(k).tobytes()), k, n) for n, ((k, _), s) in enumerate(zip(others, score)) if k not in known[t, 1 - v] and (s > 1 if side else s < -1))
            seen = {}
            for *_, k, n in sure:
                seen.setdefault(k, n)
            if seen:
                out[t, v, side] = [others[n] for n in list(seen.values())[: most[t, side]]]
    return out


def test_co_training_equals_a_plain_one(spark, small):
    """Every round takes the surest of all documents: the model is that of plain sorting, also with repeated ids."""
    docs = small.unionByName(small.where("doc_id % 9 = 1")).repartition(3)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    vocabulary, models = quality.learn(docs, labels, rounds=2, taught=20).value
    truth = {r.doc_id: r for r in labels.collect()}
    rows = [(r.doc_id, quality._features(r.text, r.source, r.lang, r.n_chars, vocabulary)) for r in docs.collect()]
    sample = sorted({k: f for k, f in rows if k in truth}.items())
    others = [r for r in rows if r[0] not in truth]
    own = {c: np.array([truth[k][c] for k, _ in sample]) for c in quality.TARGETS}
    held = np.random.default_rng(3).random(len(sample)) < quality.HELD
    want = quality.co_train([f for _, f in sample], own, held, len(vocabulary), lambda *a: plain_confident(others, len(vocabulary), *a), 2, 20)
    for t in quality.TARGETS:
        assert abs(models[t][2] - want[t][2]) < 1e-12
        for (w, a, b), (x, c, d) in zip(models[t][:2], want[t][:2], strict=True):
            assert np.allclose(w, x) and abs(a - c) < 1e-6 and abs(b - d) < 1e-6


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, None), (8, 0, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(odd, quality.learn(odd, labels)).where("score between 0 and 1").count() == odd.count()
    none = quality.score_quality(odd, quality.learn(odd.limit(0), labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.25}


def test_views_teach_each_other():
    """Neither the few labels of the text nor those of the metadata tell all: taught rows raise the accuracy of others."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    stats = np.zeros((400, quality.STATS))
    stats[:, 0], stats[:, -1] = y + rng.normal(0, 0.4, 400), 1
    rows = [(k, (stats[k].tolist(), [], [int(y[k] * 2 + rng.integers(0, 2))])) for k in range(400)]
    others = rows[40:]
    calls = []

    def confident(*a):
        calls.append(a[1])
        return plain_confident(others, 1, *a)

    *models, prior = quality.co_train([f for _, f in rows[:40]], {"quality": y[:40]}, np.arange(40) % 4 == 0, 1, confident, 4, 20)["quality"]
    both = quality.views([f for _, f in others], 1)
    odds = sum(a * v.times(w) + b for v, (w, a, b) in zip(both, models, strict=True)) - prior
    assert ((odds > 0) == y[40:]).mean() > 0.95
    assert len(calls) == 4 and calls[3]["quality", 0] and calls[3]["quality", 1]


# --- licenses ---


def test_phrases_equal_brute_force(spark, odd):
    texts = ["MIT License. mit-license, GNU General Public License; Apache License", "gnu general public", "CC-BY cc by CC BY-SA", "mit license " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (docs, odd):
        rows = {str(r.doc_id): r.text for r in df.collect()}
        for r in licenses.scan_licenses(df.where("doc_id is not null")).collect():
            words = plain_words(rows[str(r.doc.doc_id)])
            places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == plain_words(phrase)]
            ends = [k for k, _ in places]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(ends, default=None), max(ends, default=None))
            assert r.base_labels == sorted({x for _, x in places}) and set(r.base_labels) <= set(r.labels)
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def _filled(items, optional, choice=0, stretch=3):
    """The words of a parsed template, with the optional regions or without."""
    out = []
    for item in items:
        if isinstance(item, bytes):
            out.append(item.decode())
        elif item[0] == "optional":
            out += _filled(item[1], optional, choice, stretch) if optional else []
        elif item[0] == "choice":
            out += [w.decode() for w in item[1][choice % len(item[1])]]
        else:
            out += ["body"] * max(item[1], stretch if optional else 0)
    return out


def test_templates(spark):
    """Whole texts match, with and without what may be missing; one mandatory word less, more or other and none does."""
    rows = []
    for label, template in licenses.TEMPLATES.items():
        items = licenses.parsed(template)
        for k, words in enumerate((_filled(items, True), _filled(items, False, 1))):
            rows.append((f"{label} yes {k}", "x y " + ", ".join(words).upper() + " z"))
        bare = _filled(items, False)
        middle = len(bare) // 2
        for k, words in enumerate((bare[:-1], bare[:middle] + bare[middle + 1 :], [*bare[:-3], "never", *bare[-3:]], bare[:-2] + ["otherwise", bare[-1]])):
            rows.append((f"{label} no {k}", f"x y {' '.join(words)}"))
    got = {r.doc.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name, r in got.items():
        label, kind, _ = name.split()
        assert (label in r.labels) == (kind == "yes"), name
        assert kind == "no" or r.score == 1.0


def test_fragments_are_no_license(spark):
    texts = ["we are not licensed under the Apache License", "Redistribution and use in source and binary forms, with or without modification, are permitted. Commercial use is forbidden."]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc.doc_id").collect()
    assert [r.matches for r in got] == [[], []] and [r.labels for r in got] == [["apache"], []] and [r.score for r in got] == [0.5, 0.0]


def test_markup(spark):
    mark = '<<beginOptional;name="t">>The <<beginOptional>>Great<<endOptional>> License<<endOptional>> Use <<var;name="x";original="it";match=".{2,9}">> freely <<var;name="y";original="a";match="(a|b c)">> now'
    texts = ["use aa freely a now", "USE it, or freely b-c, now!", "use abcdefghij freely a now", "use freely a now", "use x freely b now", "use use aa freely a now"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates={"t": mark}).orderBy("doc.doc_id").collect()
    assert [[(m.start, m.end) for m in r.matches] for r in got] == [[(0, 5)], [(0, 7)], [], [], [], [(0, 6), (1, 6)]]
    for bad in ("<<beginOptional>>all optional<<endOptional>>", "a <<endOptional>>", "a <<beginOptional>> b", 'a <<var;name="x";match="[0-9]+">> b', "a <<what>> b"):
        with pytest.raises(ValueError, match="template|region|rule"):
            licenses.scan_licenses(spark.createDataFrame([(1, "a")], "doc_id long, text string"), templates={"t": bad})


def test_declarations(spark):
    """Sentences and tags that name a license; what is denied, has no version or no known identifier declares nothing."""
    texts = {
        "Licensed under the Apache License, Version 2.0.": ["Apache-2.0 declared"],
        "Released under the MIT License.": ["MIT declared"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0 declared"],
        "distributed under the terms of the GNU Lesser General Public License v2.1": ["LGPL-2.1 declared"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0 declared"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike License 3.0": ["CC-BY-SA-3.0 declared"],
        "// SPDX-License-Identifier: MIT": ["MIT tagged"],
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": ["Apache-2.0 tagged", "MIT tagged"],
        "SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0 tagged"],
        "SPDX-License-Identifier: NONE of these": [],
        "Do not write SPDX-License-Identifier: here.": [],
        "It is not licensed under the Apache License, Version 2.0.": [],
        "It isn't released under the MIT license": [],
        "Licensed under the Apache License": [],
    }
    rows = list(enumerate(texts))
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = texts[rows[r.doc.doc_id][1]]
        assert [m.label for m in r.matches] == want and set(want) <= set(r.labels)
        assert r.score == (0.75 if want else 0.5 if r.base_labels else 0.0)


def test_lines_of_the_table_are_declarations(spark):
    found = licenses.scan_licenses(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")).where("size(base_labels) > 0").collect()
    assert found and all(set(r.labels) > set(r.base_labels) and r.score == 0.75 for r in found)


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_time_of_hostile_texts(label):
    """Half of a license again and again, and its first words: a megabyte takes a second, not hours."""
    items = [w for w in _filled(licenses.parsed(licenses.TEMPLATES[label]), True) if w != "body"]
    one = licenses.Automaton(licenses.TEMPLATES[label])
    half = " ".join(items[: len(items) // 2]) + " "
    for text in (half * (1_000_000 // len(half)), f"{sorted(one.first)[0].decode()} " * 100_000):
        words = plain_words(text)
        began = time.perf_counter()
        one.ends(words)
        assert time.perf_counter() - began < 4  # a second on an idle machine


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "[", "]", "*", "{0,3}"]), min_size=1, max_size=7), st.text("abc ", max_size=14))
def test_automata_equal_regular_expressions(parts, text):
    """Templates of words, optional regions and stretches, against Python's own matching."""
    template, pattern, depth = "a ", "a ", 0
    for p in parts:
        if p in "ab":
            template, pattern = template + p + " ", pattern + p + " "
        elif p == "[":
            template, pattern, depth = template + "<<beginOptional>> ", pattern + "(?:", depth + 1
        elif p == "]" and depth:
            template, pattern, depth = template + "<<endOptional>> ", pattern + ")?", depth - 1
        elif p == "*":
            template, pattern = template + '<<var;name="v";match=".*">> ', pattern + r"(?:\w+ )*"
        elif p == "{0,3}":
            template, pattern = template + '<<var;name="v";match=".{0,3}">> ', pattern + r"(?:(?:\w{1,3}|\w \w) )?"
    template, pattern = template + "<<endOptional>> " * depth + "c", pattern + ")?" * depth + "c "
    words = text.split()
    accepted = [(k, m) for k in range(len(words)) for m in range(k, len(words) + 1) if re.fullmatch(pattern, "".join(w + " " for w in words[k:m]))]
    want = [(end, min(k for k, m in accepted if m == end), max(k for k, m in accepted if m == end)) for end in sorted({m for _, m in accepted})]
    assert licenses.Automaton(template).ends([w.encode() for w in words]) == want, template


# --- extraction ---


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract.extract_main_text(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", source[r.doc.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_furniture_goes():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var x="<p>no</p>"</script></head><body class="has-sidebar">
      <header><h1>Site</h1></header><nav><a>menu</a></nav><div class="cookie-notice">We use cookies</div>
      <main><article><header class="entry-header"><h1>Head &amp; more</h1></header><p>One <b>t</b>wo&nbsp;three<p>Four<ul><li>a<li>b</ul>
      <aside>aside</aside><form><label>mail</label></form><div id="ad-3">buy</div><figure><figcaption>Picture</figcaption></figure>
      <table><tr><td>x<td>y</table><!-- <p>no</p> --><p hidden>no</p>five<br>six</div></p> < 7 &lt;8
      <div class="comments"><article class="comment"><p>first!</p></article></div></article></main>
      <footer>(c)</footer></body></html>"""
    want = ["Head & more", "One two three", "Four", "a", "b", "Picture", "x", "y", "five six", "< 7 <8"]
    assert extract.Page(page).text().split("\n") == want
    for odd in ("", "<", "<p", "<!--", "<script>x", "</p></div>", "<a href='", "plain"):
        assert extract.Page(odd).text() in ("", "<", "<p", "plain", "<a href='")


def test_templates_without_telling_names(spark):
    """Hosts whose menus and footers have neutral names: recurrence alone finds them, and nothing else does."""
    menu = "".join(f'<div class="c{k}"><span>Topic {k}</span></div>' for k in range(4))
    page = lambda k: f'<html><body><div class="a1"><div class="b7">{menu}</div><div class="b8"><h1>Story {k}</h1><p>Word {k} and more.</p><p>Shared by two.</p></div><section id="z"><p>Our house, {"Oslo" if k % 2 else "Rome"}</p></section></div></body></html>'
    rows = [(k, f"http://h{k % 2}.example/{k}", page(k // 2), "t", "h") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")
    found = extract.extract_main_text(df).collect()
    for r in found:
        k = r.doc.page_id // 2
        assert r.text == f"Story {k}\nWord {k} and more." and (r.by_template, r.by_rule) == (6, 0)
        assert extract.Page(r.doc.html).text() != r.text
    kept = {r.page_id: r.text for r in extract.extract_main_text(df.where("page_id < 8")).select("doc.page_id", "text").collect()}
    assert kept[0].startswith("Topic 0") and kept[0].endswith("Rome")  # too few pages to tell


def test_shells_of_a_host(spark):
    """Menus and footers of neutral names whose words differ on every page go by their shape and place; nothing of the main place does."""
    menu = lambda k: "".join(f'<div class="c"><a href="/{k}">Alpha{k} Beta{j}{k}</a></div>' for j in range(2 + k % 3))
    page = lambda k: f'<html><body><div class="a{k}"><div class="b">{menu(k)}</div><div class="d"><h1>T{k}</h1>{"<p>Body {k} and many more words of it, told at length</p>" * (1 + k % 4)}</div><div class="e"><table><tr><td>cell {k}, as long as its paragraphs are</table></div><div class="f">(c) {k}</div></div></body></html>'.replace("{k}", str(k))
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(40)]
    # pages with an article of their own, and a page without the main place
    rows += [(k, f"http://i.example/{k}", f'<html><body><div class="b">{menu(k)}</div><article><div class="b">{menu(k)}</div><p>Own {k}</p></article><div class="f">(c) {k}</div></body></html>') for k in range(10)]
    rows += [(99, "http://h.example/99", '<html><body><div class="a"><div class="f">(c) 99</div></div></body></html>')]
    found = {(r.doc.url, r.doc.page_id): r for r in extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(40):
        r = found[f"http://h.example/{k}", k]
        body = [f"Body {k} and many more words of it, told at length"] * (1 + k % 4)
        assert r.text.split("\n") == [f"T{k}", *body, f"cell {k}, as long as its paragraphs are"]
        assert (r.by_template, r.by_rule) == (3 + k % 3, 0)
    for k in range(10):
        r = found[f"http://i.example/{k}", k]
        assert r.text.split("\n") == [*(f"Alpha{k} Beta{j}{k}" for j in range(2 + k % 3)), f"Own {k}"] and r.by_template == 3 + k % 3
    assert found["http://h.example/99", 99].text == "(c) 99"


def test_broken_markup_takes_linear_time():
    n = 120_000
    odd = ["<p " * n, "<scriptx" * n, '<p ">" ' * n, '<p a=">" ' * n, "<div>" * n + "</p>" * n, "<blockquote>" * n + "<li></li>" * n, "<!" * n, "&#" + "9" * n, "<" * n, '<a ="' * n, "<div class= " * n, "<p>x" * n]
    for page in odd:
        began = time.perf_counter()
        one = extract.Page(page)
        one.result(frozenset())
        one.subtrees()
        assert time.perf_counter() - began < 10
    assert extract.Page("a&#0000065;b&#0;&#99999999;&#x110000000;c").text() == "aAb\ufffd\ufffd\ufffdc"


def test_pages_with_odd_rows(spark):
    rows = [(1, None, None, "d"), (None, "http://x.example", "", "d"), (2, "", "<p>a", "d"), (2, "", "<p>a", "d"), (3, "http://x.example", "<p>" + "word " * 200_000, "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, doc string")
    got = sorted(((r.doc.page_id, r.text[:9]) for r in extract.extract_main_text(df).collect()), key=str)
    assert got == sorted([(1, ""), (None, ""), (2, "a"), (2, "a"), (3, "word word")], key=str)
    assert extract.extract_main_text(df.limit(0)).count() == 0


def test_site_templates_go(spark):
    body = lambda k: f"<html><body><div><div>Welcome to our site</div><p>text {k} of this page</p><div><span>Follow us</span> now</div></div></body></html>"
    rows = [(k, f"http://a.example/{k}", body(k)) for k in range(12)] + [(50, "http://b.example/", body(50)), (51, None, body(51)), (52, "nohost", None)]
    got = {r.doc.page_id: r.text for r in extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "text 3 of this page" and got[50].startswith("Welcome") and got[51].startswith("Welcome") and got[52] == ""


# --- nearest neighbours ---


def plain_nearest(rows, k, modulus):
    """Every row but the query's own is a candidate; equal rows are one query."""
    ok = [(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q, x in dict.fromkeys(r for r in ok if r[0] % modulus == 0):
        rest = list(ok)
        rest.remove((q, x))
        best = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in rest if len(v) == len(x))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_all_leaves_give_the_exact_result(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, np.round(rng.normal(size=8) * 4).tolist()) for k in range(200)]
    rows += [(200 + k, rows[0][1]) for k in range(60)]  # a hot vector
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0] * 7 + [None]), (303, [float("nan")] * 8), (304, [1.0, 2.0]), (305, []), (None, [1.0] * 8), rows[5]]
    rows += [rows[20], rows[20], (20, rows[41][1]), (60, [3.0, 1.0]), (80, [-3.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0, "c") for r in rows], "vec_id long, embedding array<double>, id int, v string, score double, class string").repartition(5)
    got = lambda d, **more: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(d, query_modulus=20, k=20, **more).collect())
    want = plain_nearest(rows, 20, 20)
    assert got(df, reach=1.0) == want
    monkeypatch.setattr(ann, "CHUNK", 7)
    assert got(df, reach=1.0) == want
    assert ann.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert got(few) == plain_nearest(rows[:5], 20, 20)


def test_recall_of_random_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    found = defaultdict(set)
    for r in ann.nearest(df).collect():
        found[r.query_id].add(r.vec_id)
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-12
    recall = []
    for q, own in found.items():
        s = m @ x[q]
        s[ids == q] = -9
        recall.append(len(own & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert len(found) == len(ids) // 20 and np.mean(recall) > 0.9


def test_vectors_are_not_shuffled_to_leaves(spark):
    """What is shuffled hangs on the vectors and the best of each query, not on the leaves that a query takes."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(e.totalShuffleWrite() for e in (lambda s: [s.apply(k) for k in range(s.size())])(store.executorList(False)))
    before = shuffled()
    assert ann.nearest(df).count() == 2000
    assert shuffled() - before < 3 * df.count() * 64 * 8


def test_best_of_queries_in_blocks(spark, monkeypatch):
    """Few queries at a time, with the same result."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = lambda: sorted(map(tuple, ann.nearest(df, query_modulus=5).collect()))
    want = got()
    monkeypatch.setattr(ann, "SENT", 30)
    monkeypatch.setattr(ann, "BLOCK", 11)
    monkeypatch.setattr(ann, "CHUNK", 40)
    assert got() == want and len(want) == 2000
