import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corelake.llm import packing
from corelake.llm.packing import Shard, document_frequencies, pack, pack_shard, shards, tokenized, word_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, window):
    """Each id of each text once, in its place; sequences gapless, and of the window's length or a power of two."""
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for key, pieces in got.items():
        ids = [ids_of(t) for t in texts[key]]
        assert sum(p.length for p in pieces) == sum(map(len, ids))
        for p in pieces:
            want = [x for x in ids if len(x) == p.doc_tokens]
            parts = [np.array(x[p.start : p.start + p.length], "<u4").tobytes() for x in want]
            assert p.ids_crc32 in [zlib.crc32(x) for x in parts]
            assert p.ids is None or p.ids in parts
    assert got.keys() == texts.keys()
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0


@pytest.mark.parametrize("window", [2048, 64])
def test_pieces_of_whole_table(small, window):
    texts = {r.doc_id: [r.text] for r in small.collect()}
    check(pack(small, tokenizer=PATH, keep=["doc_id"], window=window).collect(), texts, window)


def test_odd_rows(odd, spark):
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text)
    check(pack(odd, tokenizer=PATH, window=64).collect(), texts, 64)
    assert pack(odd.limit(0), tokenizer=PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeé'stdl ,.!\n\t\x0b\xa0<|ÀSß1²ΑΣ"))), max_size=4))
def test_words_give_the_ids_of_whole_texts(texts):
    texts = [*texts, "it's the <|endoftext|> THE'D", "á éé", " x "]
    got = word_tokenizer(PATH).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_whole_texts_of_the_table(small):
    texts = [r.text for r in small.collect()]
    for text, ids in zip(texts, word_tokenizer(PATH).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode(text or "", add_special_tokens=False).ids


def test_other_tokenizers_take_the_plain_way():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  world\n", "", "naïve"]
    plain = Tokenizer.from_file(path)
    assert word_tokenizer(path).latin is None
    assert [np.frombuffer(x, "<u4").tolist() for x in word_tokenizer(path).encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_neighbours_are_by_bm25():
    rng = np.random.default_rng(0)
    rests = [rng.integers(0, 50, rng.integers(5, 40)).astype("<u4") for _ in range(30)]
    df = np.bincount(np.concatenate([np.unique(r) for r in rests]), minlength=50)
    idf, mean = np.log(1 + (30 - df + 0.5) / (df + 0.5)), np.mean([len(r) for r in rests])
    shard = Shard(rests, idf, mean)
    found = list(shard.neighbours(4, np.arange(30) == 4))

    def score(k):
        tf = np.bincount(rests[k], minlength=50)
        return sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(rests[k]) / mean)) for t in set(rests[4].tolist()) if tf[t])

    values = [score(k) for k in found]
    assert sorted(found) == [k for k in range(30) if k != 4] and all(a >= b - 1e-9 for a, b in zip(values, values[1:]))


def test_all_terms_of_a_long_seed_count():
    """The seed's 100 rarest terms stand in it alone; the order comes from its other words, ties by place."""
    rng = np.random.default_rng(1)
    n = 90
    rests = [np.concatenate([np.arange(300, 400), np.arange(40)]).astype("<u4")]
    rests += [rng.integers(0, 200, rng.integers(5, 80)).astype("<u4") for _ in range(n - 21)]
    rests += [rests[5]] * 20  # equal scores
    df = np.bincount(np.concatenate([np.unique(r) for r in rests]), minlength=400)
    idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), np.mean([len(r) for r in rests])

    def score(k):
        tf = np.bincount(rests[k], minlength=400)
        return sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(rests[k]) / mean)) for t in sorted(set(rests[0].tolist())) if tf[t])

    used = np.arange(n) == 0
    found = []
    for k in Shard(rests, idf, mean).neighbours(0, used):
        used[k] = True
        found.append(k)
    assert found == sorted(range(1, n), key=lambda k: (-round(score(k), 9), k))


def test_like_documents_share_windows():
    a, b = np.arange(0, 30, dtype="<u4"), np.arange(100, 130, dtype="<u4")
    rests = [a, b, a, b, a, b]
    windows = list(pack_shard(Shard(rests, np.ones(200), 30.0), [30] * 6, 60))
    assert [{k % 2 for k, *_ in w} for w in windows] == [{0}, {1}, {0, 1}]  # the last two are left to each other
    assert sum(n for w in windows for *_, n in w) == 180 and all(sum(n for *_, n in w) == 60 for w in windows)


def grouped(spark):
    """Texts of 90 tokens or more of which the first 64 tell their group and the last ones, by windows of 64, are alike."""
    groups = ["apple river stone cloud", "paper engine winter garden"]
    texts = {k: f"{groups[k % 2]} " * 16 + "the " * 26 for k in range(8)}
    assert {len(ids_of(t)) for t in texts.values()} == {91}
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)


def test_words_of_whole_windows_count_for_retrieval(spark):
    texts, docs = grouped(spark)
    rows = pack(docs, tokenizer=PATH, window=64).collect()
    check(rows, {k: [t] for k, t in texts.items()}, 64)
    held = defaultdict(set)
    for r in rows:
        held[r.sequence_id].add(r.doc.doc_id % 2)
    # 5.7 windows of each group, of which only those where a group ends hold both
    assert sum(len(x) > 1 for x in held.values()) <= 1


def test_frequencies_are_of_whole_documents(spark):
    texts = [(0, "apple river stone cloud " * 600 + "the"), (1, "paper engine " * 1100 + "the")]
    found, n, mean = document_frequencies(tokenized(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer=PATH))
    own = [ids_of(t) for _, t in texts]
    assert min(map(len, own)) > 2048
    assert (found, n, mean) == (Counter(x for ids in own for x in set(ids)), 2, sum(map(len, own)) / 2)


def test_every_piece_holds_its_ids(small, spark):
    """Also those of documents beyond a window, and with ids that need four bytes."""
    for window, end_id in ((64, 1), (2048, 70_000)):
        texts = {r.doc_id: r.text for r in small.collect()}
        got = defaultdict(dict)
        for r in pack(small, tokenizer=PATH, keep=["doc_id"], window=window, end_id=end_id).collect():
            assert r.ids is not None and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
            got[r.doc.doc_id][r.start] = r.ids
        for k, t in texts.items():
            whole = b"".join(got[k][s] for s in sorted(got[k]))
            assert np.frombuffer(whole, "<u4").tolist() == [*ids_of(t)[:-1], end_id]


def test_shards_are_bounded_by_ids_too():
    rows = [(k, n) for k, n in enumerate([5, 5, 30, 1, 1, 1, 1, 1])]
    found = list(shards([rows[:3], rows[3:]], lambda r: r[1], most=4, ids=20))
    assert [[k for k, _ in x] for x in found] == [[0, 1, 2], [3, 4, 5, 6], [7]]
    assert list(shards([], len)) == []


def test_large_tables_have_more_partitions(spark, monkeypatch):
    texts, docs = grouped(spark)
    monkeypatch.setattr(packing, "SHARD_IDS", 91)
    packed = pack(docs, tokenizer=PATH, window=64)
    assert packed.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    check(packed.collect(), {k: [t] for k, t in texts.items()}, 64)


def test_a_long_document_runs_through_windows():
    rests = [np.arange(100, dtype="<u4"), np.arange(200, 210, dtype="<u4"), np.arange(90, 250, dtype="<u4")]
    windows = list(pack_shard(Shard(rests, np.ones(300), 90.0), [100, 10, 160], 60))
    assert windows == [[(0, 0, 60)], [(0, 60, 40), (2, 0, 20)], [(2, 20, 60)], [(2, 80, 60)], [(2, 140, 20), (1, 0, 10)]]


def test_words_with_signs_behind_them():
    """Every run of up to two signs behind words of both cases, and special tokens cut short."""
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [" ".join(f"{w}{a}{b}" for w in ("It", "é", "don't") for b in ["", *signs]) for a in signs]
    texts += ["it' it's its' 's 'S x'll' a<|endoftext|>b a<|endoftext| a|> ÀÉ''", "a\x1cb a\x1c! a\x7f a\xa0! a\x85!"]
    for text, ids in zip(texts, word_tokenizer(PATH).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids
