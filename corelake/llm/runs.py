"""Maximal periodic runs of words, by the method of Kolpakov and Kucherov.

A text is factorised from left to right: each factor is the longest piece that also starts earlier, found with a
suffix automaton. Runs that touch or cross a border between factors come from Main's algorithm: longest common
extensions around the border, for every period at once. A run strictly inside a factor is a copy of one inside the
factor's earlier occurrence, so it is copied from there. All of it takes time in proportion to the text's words.

Only stretches that can hold a run are factorised. In a run of at least ``least`` words and ``exponent`` periods each
piece of g = least (1 - 2 / exponent) words also stands a period before or after, so stretches of pieces that stand
once in the text are passed over; what is left holds every run whole, with the neighbours that end it.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

#: A run's least words, and its least length in periods.
LEAST, EXPONENT = 24, 3

Run = tuple[int, int, int]  # start, end, period


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of the factors of s; a value that is new has an earlier start of -1.

    The automaton's states know where their strings end first; an earlier occurrence may overlap the factor.
    """
    after: list[dict[int, int]] = [{}]
    link, size, ends = [-1], [0], [-1]  # ends: the least last place of a state's strings
    last = 0
    for at, c in enumerate(s):
        new = len(after)
        after.append({})
        link.append(0)
        size.append(size[last] + 1)
        ends.append(at)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(after)
                after.append(after[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                ends.append(ends[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, at, n = [], 0, len(s)
    while at < n:
        state = length = 0
        while at + length < n:
            then = after[state][s[at + length]]  # of the whole text, so there is one
            if ends[then] - length >= at:
                break
            state, length = then, length + 1
        out.append((at, length, ends[state] - length + 1) if length else (at, 1, -1))
        at += max(1, length)
    return out


def _prefixes(s: list[int]) -> list[int]:
    """For each place, how many values from there on equal those from the start on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_border(s: list[int], low: int, border: int, high: int, least: int, exponent: int, found: dict[tuple[int, int], int]) -> None:
    """Puts the runs within [low, high) that touch or cross the border into found, if s ends them there."""
    t, v = s[low:border], s[border:high]
    m, n = len(t), len(v)
    back = t[::-1]
    # a period whose one copy lies right of the border, and one whose copy lies left of it
    ahead = _prefixes(v)
    behind = _prefixes(back)
    down = _prefixes(back + [-1] + (t + v)[::-1])[m + 1 :] if n else []  # at k: common suffix of t and of t + v without its last k values
    up = _prefixes(v + [-1] + t + v)[n + 1 :] if m else []  # at k: common prefix of v and of t + v from k on
    top = len(s)

    def put(start: int, end: int, period: int) -> None:
        length = end - start
        if length < least or length < exponent * period:
            return
        if start and s[start - 1] == s[start - 1 + period] or end < top and s[end] == s[end - period]:
            return  # goes on beyond what is looked at: another border has it
        if found.get((start, end), period) >= period:
            found[start, end] = period

    for p in range(1, n + 1):
        right, left = (ahead[p] if p < n else 0), min(down[n - p], m) if m else 0
        if left + right >= p:
            put(border - left, border + p + right, p)
    for p in range(1, m + 1):
        left, right = (behind[p] if p < m else 0), min(up[m - p], n) if n else 0
        if left + right >= p:
            put(border - p - left, border + right, p)


def maximal_runs(s: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """(start, end, smallest period) of every maximal run of s of at least so many values and periods (two or more).

    A run has at most one factor that starts after its first period and does not end it, so a border is near: Main's
    bound of twice the factor before and the factor behind it on the left, the factor behind it on the right.
    """
    found: dict[tuple[int, int], int] = {}
    starts: list[tuple[int, int]] = []  # those of found, in order
    before = 0
    parts = factors(s)
    for start, length, earlier in [*parts, (len(s), 0, -1)]:
        fresh: dict[tuple[int, int], int] = {}
        # with fewer values around the border no run there is long enough
        if 2 * (before + length) >= least:
            _at_border(s, max(0, start - 2 * before - length), start, start + length, least, exponent, fresh)
        for key, period in fresh.items():
            if key not in found:
                insort(starts, key)
                found[key] = period
            found[key] = min(found[key], period)
        if earlier >= 0 and length > least:
            shift, end = start - earlier, start + length
            k = bisect_left(starts, (earlier + 1, 0))
            while k < len(starts) and starts[k][0] < earlier + length:
                a, b = starts[k]
                k += 1
                if b < earlier + length and a + shift > start and b + shift < end and (key := (a + shift, b + shift)) not in found:
                    insort(starts, key)  # behind k, since it starts later
                    found[key] = found[a, b]
        before = length
    return [(a, b, found[a, b]) for a, b in starts]


def _stretches(words: list[bytes], piece: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches whose pieces of so many words each stand at least twice in the text."""
    n = len(words)
    if not piece:
        return [(0, n)] if n else []
    if n < piece:
        return []
    # equal pieces have equal hashes; unlike ones with equal hashes only make a stretch longer than need be
    h, have = np.fromiter(map(hash, words), np.int64, n).view(np.uint64), 1
    own, done, whole = h, 0, None
    while True:
        if piece & have:
            whole = own[: n - piece + 1] if whole is None else whole * np.uint64(0x9E3779B97F4A7C15) + own[done : done + n - piece + 1]
            done += have
        have *= 2
        if have > piece:
            break
        half = have // 2
        own = own[:-half] * np.uint64(0xBF58476D1CE4E5B9 + 2 * half) + own[half:]
        own ^= own >> np.uint64(29)
    order = np.argsort(whole, kind="stable")
    same = whole[order[1:]] == whole[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(len(whole) + 2, bool)
    again[order[1:][same] + 1] = True
    again[order[:-1][same] + 1] = True
    edges = np.flatnonzero(again[1:] != again[:-1])
    return [(int(a), int(b) + piece - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def text_runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """The maximal runs of the words, by start and period."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    out: list[Run] = []
    for a, b in _stretches(words, least * (exponent - 2) // exponent):
        if b - a >= least:
            number: dict[bytes, int] = {}
            s = [number.setdefault(w, len(number)) for w in words[a:b]]
            out += [(a + start, a + end, period) for start, end, period in maximal_runs(s, least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that stand in some run after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, end, period in runs:
        gone[start + period] += 1
        gone[end] -= 1
    return [words[k] for k in np.flatnonzero(gone.cumsum()[:-1] == 0).tolist()]


def find_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST, exponent: int = EXPONENT, keep: list[str] | None = None, texts_out: bool = True) -> DataFrame:
    """doc, n_words, runs (array of start, length and period, by start and period) and collapsed for each row of docs.

    Words are what stands between blanks; collapsed are the words joined by one space without those that repeat a
    run's first period (null if texts_out is false). A null, empty or blank text has no words, no runs, and collapses to
    an empty text. Every row is judged on its own, so repeated rows and ids give repeated results.
    """

    def make():
        def find(texts):
            out = {"n_words": [], "runs": [], "collapsed": []}
            for one in texts:
                words = (one or "").encode("utf-8", "surrogatepass").split()
                runs = text_runs(words, least, exponent)
                out["n_words"].append(len(words))
                out["runs"].append([{"start": a, "length": b - a, "period": p} for a, b, p in runs])
                out["collapsed"].append(b" ".join(collapsed(words, runs)) if texts_out else None)
            out["collapsed"] = pa.array(out["collapsed"], pa.binary()).cast(pa.string())
            return out

        return find

    results = T.StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return map_text(docs, make, results, text, keep)


def greatest_run(runs) -> F.Column:
    """The run of the greatest length in periods, by whole numbers; ties to the smaller start, then the smaller period."""
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(more(x, best), x).otherwise(best))


def with_repeats(text, start, period) -> F.Column:
    """The words of text, joined by one space, from word start on those of a period again and again."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    head, cycle = F.slice(words, 1, start.cast("int")), F.slice(words, start.cast("int") + 1, period.cast("int"))
    rest = F.size(words) - start
    again = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / period).cast("int"))), 1, rest.cast("int"))
    return F.array_join(F.concat(head, again), " ")
