"""Language identification of mixed text: scripts narrow the candidates, a Viterbi path labels spans of words.

learn() counts, in Spark, hashed character n-grams of each language's words over all labelled rows, and which
scripts each language is written in. identify() scores each word once (words repeat, so scores are kept), under
the languages of the word's script only, and finds the best sequence of labels, where each change of language
costs ``switch``. Equal neighbouring labels form spans.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

#: Buckets of the hashed n-grams (the model's size is this times the languages), and n-gram lengths.
BUCKETS, SIZES = 1 << 16, (1, 2, 3, 4)
#: Words whose scores a worker keeps; documents, and scores (words times languages), whose paths are found together; a
#: longer document's path is found in stretches of so many scores.
CACHED_WORDS, TOGETHER, SCORES = 300_000, 2048, 1 << 22
#: log odds that a word's score counts for at most, and what a change of language costs.
WORD_LIMIT, SWITCH = 8.0, 12.0

#: First code points of ranges of letters and their script; a range ends where the next begins (fixed values of
#: the Unicode standard, rounded to blocks).
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0E00, "Thai"),
    (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Japanese"), (0x3100, "Han"), (0xAC00, "Hangul"),
    (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
_NUMBER = np.array([NAMES.index(n) for _, n in SCRIPTS])

_LETTERS, _NEARLY = regex.compile(r"\p{L}+"), re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The stretches of letters of the text in lower case.

    The standard library's pattern is faster and differs by signs of numbers, such as fractions, which few texts have.
    """
    words = _NEARLY.findall(text.lower())
    return words if not words or "".join(words).isalpha() else _LETTERS.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the n-grams of each word between two spaces; single spaces don't count."""
    text = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = text == 32
    spaces = np.cumsum(space)
    number = spaces - 1
    rows, buckets = [], []
    h = text + np.uint64(7)
    for n in range(1, max(SIZES) + 1):
        if n > 1:
            h = (h[:-1] * np.uint64(0x100000001B3)) + text[n - 1 :]
        if n not in SIZES:
            continue
        m = len(h)
        # within one word: no space but at the ends
        good = ~space[:m] if n == 1 else spaces[n - 2 : n - 2 + m] - spaces[:m] == 0
        if n == 2:
            good &= ~(space[:m] & space[1 : m + 1])
        mixed = (h[good] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        rows.append(number[:m][good])
        buckets.append((mixed >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
    rows, buckets = np.concatenate(rows), np.concatenate(buckets)
    kept = rows < len(words)
    return rows[kept], buckets[kept]


def scripts(words: list[str]) -> np.ndarray:
    """Number of the script of most letters of each word; of equals, the first by name."""
    text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    kind = _NUMBER[np.searchsorted(_STARTS, text, "right") - 1]
    return np.bincount(row * len(NAMES) + kind, minlength=len(words) * len(NAMES)).reshape(-1, len(NAMES)).argmax(1)


class Model:
    """Log probabilities of n-gram buckets by language, and the languages of each script."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = counts.sum(0, keepdims=True)
        self.log = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32)
        # a language is a candidate for a script that has one in a hundred of its words; a script that no
        # language has is open to all
        share = scripts / np.maximum(1, scripts.sum(0, keepdims=True))
        allowed = share >= 0.01
        allowed[~allowed.any(1)] = True
        self.allowed = allowed

    def score(self, words: list[str], switch: float = SWITCH) -> np.ndarray:
        """Log odds of each language against the best candidate, for each word; at least -WORD_LIMIT for a candidate.

        A language that is no candidate for the word's script gets less than two changes of language cost together
        with that limit: no best path gives it the word.
        """
        row, bucket = grams(words)
        raw = np.stack([np.bincount(row, self.log[bucket, k], len(words)) for k in range(len(self.languages))], 1) / len(SIZES)
        allowed = self.allowed[scripts(words)]
        best = np.where(allowed, raw, -np.inf).max(1, keepdims=True)
        return np.where(allowed, np.maximum(raw - best, -WORD_LIMIT), -(2 * switch + 2 * WORD_LIMIT)).astype(np.float32)


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", where: Column | None = None) -> Broadcast | None:
    """A model from the rows of docs that have a text, a language and meet where; None if there are none.

    All such rows count. What comes back is one row for each language and non-empty bucket or script, so its
    size is bounded by the number of languages.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{text}`").cast("string").alias("t")).where("l is not null and t is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        found: dict[str, np.ndarray] = {}

        def settle():
            for language, held in words.items():
                own = found.setdefault(language, np.zeros(BUCKETS + len(NAMES), np.int64))
                names, n = list(held), np.array(list(held.values()))
                for k in range(0, len(names), TOGETHER * 16):
                    part, weight = names[k : k + TOGETHER * 16], n[k : k + TOGETHER * 16]
                    row, bucket = grams(part)
                    own[:BUCKETS] += np.bincount(bucket, weight[row], BUCKETS).astype(np.int64)
                    own[BUCKETS:] += np.bincount(scripts(part), weight, len(NAMES)).astype(np.int64)
            words.clear()

        held = 0
        for batch in batches:
            for language, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = words_of(one)
                words[language].update(parts)
                held += len(parts)
                if held > 2_000_000:
                    settle()
                    held = 0
        settle()
        for language, own in found.items():
            at = np.flatnonzero(own)
            yield pa.record_batch({"l": pa.array([language] * len(at)), "k": pa.array(at), "n": pa.array(own[at])})

    rows = rows.mapInArrow(count, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n"))
    packed = rows.groupBy("l").agg(F.collect_list("k").alias("k"), F.collect_list("n").alias("n")).collect()
    if not packed:
        return None
    packed.sort(key=lambda r: r["l"])
    table = np.zeros((BUCKETS + len(NAMES), len(packed)))
    for j, r in enumerate(packed):
        table[r["k"], j] = r["n"]
    model = Model([r["l"] for r in packed], table[:BUCKETS], table[BUCKETS:])
    return docs.sparkSession.sparkContext.broadcast(model)


def best_labels(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The labels of the Viterbi path of each sequence of words; scores are those of all words, sequence by sequence.

    A path of m changes that beats the best constant one gains more than m changes in m + 1 stretches, so one of
    them gains at least half a change. A sequence without such a stretch has the constant path; only the others
    are searched.
    """
    row = np.repeat(np.arange(len(lengths)), lengths)
    total = np.stack([np.bincount(row, scores[:, k], len(lengths)) for k in range(scores.shape[1])], 1)
    constant = total.argmax(1)
    labels = constant[row].astype(np.int16)
    base = scores[np.arange(len(scores)), labels].astype(np.float64)
    unsure = np.zeros(len(lengths), bool)
    far = -2.0 * (float(np.abs(scores).max(initial=0)) + 1) * (lengths.max(initial=0) + 1) * row  # each sequence lies below all before it
    first = (np.cumsum(lengths) - lengths)[row]
    for k in range(scores.shape[1]):
        gain = scores[:, k] - base
        before = np.append(0.0, np.cumsum(gain)[:-1])
        before = before - before[first] + far
        best = before + gain - np.minimum.accumulate(before)
        unsure |= np.bincount(row, best >= switch / 2 - 1e-3, len(lengths)) > 0
    if unsure.any():
        labels[unsure[row]] = viterbi(scores[unsure[row]], lengths[unsure], switch)
    return labels


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best labels of many sequences of words at once; scores are those of all words, sequence by sequence."""
    labels = np.zeros(len(scores), np.int16)
    kinds = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    length = lengths[order]
    best = np.zeros((len(lengths), kinds), np.float32)
    active = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
    back = []  # for each step: the best label before it, and whether a label is reached by a change
    for t, n in enumerate(active.tolist()):
        now, top, changed = _step(best[:n], switch)
        back.append((top.astype(np.int16), changed))
        best[:n] = now + scores[starts[:n] + t]
        best[:n] -= best[:n].max(1, keepdims=True)
    label = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        labels[starts[:n] + t] = label[:n]
        top, changed = back[t]
        label[:n] = np.where(changed[np.arange(n), label[:n]], top, label[:n])
    return labels


def _step(now: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best values before the next word, label that a change comes from, whether each label is reached by a change)."""
    top = now.argmax(1)
    change = (now[np.arange(len(now)), top] - switch)[:, None]
    return np.maximum(now, change), top, now < change


def viterbi_in_stretches(n: int, scores: Callable[[int, int], np.ndarray], switch: float, stretch: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, scores, labels) of each stretch of one long sequence, the last first; scores(a, b) are those of words a to b - 1.

    The forward pass keeps the values at the start of each stretch only; going back, a stretch's steps are found again.
    """
    cuts = list(range(0, n, stretch))
    kept, best = [], None
    for a in cuts:
        part = scores(a, min(n, a + stretch))
        best = np.zeros((1, part.shape[1]), np.float32) if best is None else best
        kept.append(best)
        for row in part:
            best = _step(best, switch)[0] + row
            best = best - best.max()
    label = int(best.argmax())
    for a, best in zip(reversed(cuts), reversed(kept), strict=True):
        part = scores(a, min(n, a + stretch))
        top, changed = np.zeros(len(part), np.int16), np.zeros(part.shape, bool)
        for t, row in enumerate(part):
            now, one, own = _step(best, switch)
            top[t], changed[t] = one[0], own[0]
            best = now + row
            best = best - best.max()
        labels = np.zeros(len(part), np.int16)
        for t in range(len(part) - 1, -1, -1):
            labels[t] = label
            label = int(top[t]) if changed[t, label] else label
        yield a, part, labels


def constant_label(n: int, scores: Callable[[int, int], np.ndarray], switch: float, stretch: int) -> int | None:
    """The best constant label of one long sequence if no path with changes beats it for sure (see best_labels), else None."""
    cuts = list(range(0, n, stretch))
    label = int(sum(scores(a, min(n, a + stretch)).sum(0, dtype=np.float64) for a in cuts).argmax())
    upto, least = None, None  # sums of what each label gains on the constant one, and their least so far
    for a in cuts:
        part = scores(a, min(n, a + stretch)).astype(np.float64)
        gain = part - part[:, label : label + 1]
        upto = np.zeros(gain.shape[1]) if upto is None else upto
        least = upto.copy() if least is None else least
        sums = upto + np.cumsum(gain, axis=0)
        before = np.minimum.accumulate(np.vstack([np.minimum(least, upto), sums]), axis=0)
        if (sums - before[:-1]).max() >= switch / 2 - 1e-3:
            return None
        upto, least = sums[-1], before[-1]
    return label


def identify(docs: DataFrame, model: Broadcast | None, *, text: str = "text", switch: float = SWITCH, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc, lang_pred, score, spans (start and end in words, lang).

    Words are stretches of letters. lang_pred is the language of most letters (of equals, the first by name);
    score is its share of the letters times the mean certainty of its words, from 0 to 1. A text that is null or
    has no letter is ``und`` with score 0 and no spans, and so is every text if the model is None.
    """
    results = T.StructType.fromDDL("lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")

    def make():
        own = model.value if model is not None else None
        stretch = SCORES // len(own.languages) if own else 0
        number: dict[str, int] = {}
        table = np.zeros((0, 1), np.float32)

        def scored(words: list[str]) -> np.ndarray:
            nonlocal table
            if len(number) > CACHED_WORDS:
                number.clear()
                table = table[:0]
            names = list(set(words) - number.keys())
            if names:
                rows = [own.score(names[k : k + 16 * TOGETHER], switch) for k in range(0, len(names), 16 * TOGETHER)]
                number.update(zip(names, range(len(number), len(number) + len(names)), strict=True))
                table = np.concatenate([table.reshape(-1, len(own.languages)), *rows])
            return table[np.array([number[w] for w in words], np.int64)]

        def sums(scores: np.ndarray, labels: np.ndarray, words: list[str], row: np.ndarray, n: int) -> list[np.ndarray]:
            """For each of n texts and each language: letters, letters by certainty, and sum of scores."""
            kinds = len(own.languages)
            sizes = np.array([len(w) for w in words])
            odds = np.exp(scores)
            certain = odds[np.arange(len(labels)), labels] / odds.sum(1)
            cell = row * kinds + labels
            by = lambda x: np.bincount(cell, x, n * kinds).reshape(-1, kinds)
            return [by(sizes), by(certain * sizes), np.stack([np.bincount(row, scores[:, k], n) for k in range(kinds)], 1)]

        def rows(found: list[np.ndarray], labels: list[np.ndarray]) -> list[tuple]:
            """lang_pred, score and spans of each text, from its sums and labels."""
            size, certain, total = found
            chosen, at = size.argmax(1), np.arange(len(size))
            # a long text's words support each other: certainty of the whole from the sum of log odds
            whole = np.exp(total - total.max(1, keepdims=True))
            whole = whole[at, chosen] / whole.sum(1)
            most = size[at, chosen]
            score = most / np.maximum(1, size.sum(1)) * np.maximum(whole, certain[at, chosen] / np.maximum(1, most))
            out = []
            for k, part in enumerate(labels):
                if not len(part):
                    out.append(("und", 0.0, []))
                    continue
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                spans = [{"start": a, "end": b, "lang": own.languages[part[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]
                out.append((own.languages[chosen[k]], float(min(1.0, score[k])), spans))
            return out

        def together(words: list[list[str]]) -> list[tuple]:
            lengths = np.array([len(w) for w in words])
            flat = [w for one in words for w in one]
            if not flat:
                return [("und", 0.0, [])] * len(words)
            scores = scored(flat)
            labels = best_labels(scores, lengths, switch)
            row = np.repeat(np.arange(len(words)), lengths)
            return rows(sums(scores, labels, flat, row, len(words)), np.split(labels, np.cumsum(lengths)[:-1]))

        def alone(words: list[str]) -> tuple:
            found, labels = None, np.zeros(len(words), np.int16)
            pieces = lambda a, b: scored(words[a:b])
            if (label := constant_label(len(words), pieces, switch, stretch)) is None:
                path = viterbi_in_stretches(len(words), pieces, switch, stretch)
            else:
                ends = [(a, min(len(words), a + stretch)) for a in range(0, len(words), stretch)]
                path = ((a, pieces(a, b), np.full(b - a, label, np.int16)) for a, b in ends)
            for start, scores, part in path:
                labels[start : start + len(part)] = part
                one = sums(scores, part, words[start : start + len(part)], np.zeros(len(part), np.int64), 1)
                found = one if found is None else [x + y for x, y in zip(found, one, strict=True)]
            return rows(found, [labels])[0]

        def run(texts):
            out, held, size = [], [], 0
            for one in texts:
                words = words_of(one) if one and own else []
                if held and (len(held) == TOGETHER or size + len(words) > stretch):
                    out += together(held)
                    held, size = [], 0
                if len(words) > stretch:
                    out.append(alone(words))
                else:
                    held.append(words)
                    size += len(words)
            out += together(held) if held else []
            return dict(zip(("lang_pred", "score", "spans"), zip(*out, strict=True), strict=True)) if out else {"lang_pred": [], "score": [], "spans": []}

        return run

    return map_text(docs, make, results, text, keep)
