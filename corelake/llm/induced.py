"""Induced sorting of a shard's suffixes, with common-prefix lengths, on disk-backed queues.

The shard is a concatenation of runs, each closed by a sentinel smaller than any byte. Suffixes are of type S or
L as usual: smaller or larger than the suffix after them; the left-most S suffixes are sorted first, then induce
the order of all L suffixes in an ascending scan and of all S suffixes in a descending one. Each scan is a
monotone priority queue of (first byte, rank) tuples: an induced suffix never precedes the scan, and suffixes of
one first byte arrive in order of rank, so the queue is one spooled run for each first byte. Tuples go through it
in large blocks. With each suffix travels the length of the prefix it shares with the one before; an induced
pair shares one byte more than the least value between the two that induced it.

The left-most S suffixes are sorted by naming the substrings between them and then ranking pairs of ranks of
doubling reach. (Recursive induction over names can't use large blocks, as hardly two names are equal.)
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of tuples that a scan holds in memory; more are spooled to the task's temporary folder.
IN_MEMORY = 256 << 20
#: Suffixes that a scan takes at once.
BLOCK = 1 << 20


class Budget:
    """Bytes held by the spools of one scan, and the folder for what exceeds them."""

    def __init__(self, most: int = IN_MEMORY):
        self.most, self.held, self.folder = most, 0, None

    def file(self):
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        return tempfile.NamedTemporaryFile(dir=self.folder.name, delete=False)

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


class Spool:
    """Blocks of (place, shared prefix) in the order they came; blocks beyond the budget wait on disk."""

    def __init__(self, budget: Budget):
        self.budget, self.blocks, self.read = budget, [], 0

    def push(self, places: np.ndarray, shared: np.ndarray) -> None:
        if self.budget.held + places.nbytes + shared.nbytes > self.budget.most:
            with self.budget.file() as f:
                f.write(places.tobytes())
                f.write(shared.tobytes())
            self.blocks.append((f.name, len(places)))
        else:
            self.budget.held += places.nbytes + shared.nbytes
            self.blocks.append((places, shared))

    def get(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.blocks[k]
        if isinstance(a, str):
            data = np.fromfile(a, np.uint8)
            return data[: 4 * b].view(np.int32), data[4 * b :].view(np.int16)
        return a, b

    def gather(self, k: int) -> None:
        """Makes one block of block k and those after it, up to BLOCK suffixes."""
        end, size = k, 0
        while end < len(self.blocks) and (end == k or size < BLOCK):
            a, b = self.blocks[end]
            size += b if isinstance(a, str) else len(a)
            end += 1
        if end - k < 2:
            return
        parts = [self.get(j) for j in range(k, end)]
        places, shared = (np.concatenate(x) for x in zip(*parts, strict=True))
        for j in range(k, end):
            self.drop(j)
        after = self.blocks[end:]
        del self.blocks[k:]
        self.push(places, shared)
        self.blocks += after

    def drop(self, k: int) -> None:
        a, b = self.blocks[k]
        if isinstance(a, str):
            os.unlink(a)
        elif a is not None:
            self.budget.held -= a.nbytes + b.nbytes
        self.blocks[k] = (None, None)


class Shard:
    def __init__(self, runs: list[bytes], depth: int, most: int = IN_MEMORY):
        self.depth, self.most = depth, most
        data = b"\0".join(runs) + b"\0" * 9
        lengths = np.array([len(r) + 1 for r in runs], np.int64)
        self.n = int(lengths.sum())
        self.raw = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(lengths) - 1  # places of the sentinels
        self.text = self.raw[: self.n].astype(np.int16) + 1
        self.text[self.ends] = 0
        self.words = np.ndarray(self.n, "<u8", data, strides=(1,))

    def left(self, places: np.ndarray) -> np.ndarray:
        """Bytes from each place to the end of its run."""
        return self.ends[np.searchsorted(self.ends, places)] - places

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs, up to depth, by comparison."""
        most = np.minimum(np.minimum(self.left(a), self.left(b)), self.depth)
        out = np.zeros(len(a), np.int64)
        active = np.flatnonzero(most > 0)
        while len(active):
            at = out[active]
            differ = self.words[a[active] + at] ^ self.words[b[active] + at]
            low = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
            out[active] = np.minimum(at + equal, most[active])
            active = active[(equal == 8) & (out[active] < most[active])]
        return out

    def _types(self) -> np.ndarray:
        """True for S. An equal pair has the type of the next unequal one; sentinels are S."""
        text = self.text
        sign = np.ones(self.n, bool)
        sign[:-1] = text[:-1] < text[1:]
        settled = np.flatnonzero(np.append(text[:-1] != text[1:], True))
        return sign[settled[np.searchsorted(settled, np.arange(self.n))]] | (text == 0)

    def _sorted_stars(self, is_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the left-most S suffixes in order, and what each shares with the one before."""
        star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
        m = len(star)
        size = np.append(np.diff(star), 1) + 1
        coded = (self.text.astype(np.int64) << 1) | is_s
        coded = np.append(coded, np.zeros(8, np.int64))
        last = self.text[star] == 0
        size[last] = 1
        name = np.zeros(m, np.int64)
        active, done = np.arange(m), 0
        while len(active):
            key = np.zeros(len(active), np.int64)
            for k in range(6):
                inside = size[active] > done + k
                key = (key << 10) | np.where(inside, coded[np.minimum(star[active] + done + k, self.n)], 0)
            rank = np.unique(key, return_inverse=True)[1] if not done else None
            if done:
                full = np.zeros(m, np.int64)
                full[active] = np.unique(key, return_inverse=True)[1] + 1
                rank = full
                name = np.unique(name * (rank.max() + 1) + rank, return_inverse=True)[1]
            else:
                name = rank
            done += 6
            active = active[size[active] > done]
        # ranks of doubling reach; a run's last star has nothing after it
        step, distinct = 1, -1
        run = np.searchsorted(self.ends, star)
        while True:
            most = int(name.max()) + 1
            if most in (distinct, m):
                break
            distinct = most
            after = np.zeros(m, np.int64)
            same = run[:-step] == run[step:] if step < m else np.zeros(0, bool)
            after[: len(same)] = np.where(same, name[step:] + 1, 0)
            name = np.unique(name * (most + 1) + after, return_inverse=True)[1]
            step *= 2
        order = np.argsort(name, kind="stable")
        places = star[order]
        shared = np.zeros(m, np.int16)
        shared[1:] = self.shared(places[:-1], places[1:])
        return places.astype(np.int32), shared

    def ordered(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (places, shared prefixes) of all suffixes, in order; sentinels are left out."""
        is_s = self._types()
        stars, star_shared = self._sorted_stars(is_s)
        budget = Budget(self.most)
        try:
            larger = self._induce(is_s, False, budget, self._by_byte(stars, star_shared))
            smaller = self._induce(is_s, True, budget, larger)
            for c in range(1, 257):
                tail = None
                for spool, backward in ((larger.get(c), False), (smaller.get(c), True)):
                    if spool is None:
                        continue
                    count = len(spool.blocks)
                    for k in reversed(range(count)) if backward else range(count):
                        places, shared = spool.get(k)
                        if backward:  # each value tells what is shared with the next larger suffix
                            following = self._first_value(spool, k + 1)
                            places, shared = places[::-1], np.append(following if following is not None else 0, shared[:0:-1]).astype(np.int16)
                            if k + 1 < count:
                                shared[0] = self._first_value(spool, k + 1)
                        if tail is not None and not (backward and k + 1 < count):
                            shared = shared.copy()
                            if backward or shared[0] == 0:
                                shared[0] = self.shared(np.array([tail]), places[:1].astype(np.int64))[0]
                        tail = int(places[-1])
                        yield places, shared
        finally:
            budget.close()

    @staticmethod
    def _first_value(spool: Spool, k: int):
        return int(spool.get(k)[1][0]) if k < len(spool.blocks) else None

    def _by_byte(self, places: np.ndarray, shared: np.ndarray) -> dict[int, Spool]:
        out: dict[int, Spool] = {}
        first = self.text[places]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
            if b > a:
                spool = out[int(first[a])] = Spool(Budget(1 << 62))
                spool.push(places[a:b], shared[a:b])
        return out

    def _induce(self, is_s: np.ndarray, to_s: bool, budget: Budget, seeds: dict[int, Spool]) -> dict[int, Spool]:
        """One scan: ascending, from left-most S to all L suffixes; or descending, from all L to all S suffixes."""
        text, queue = self.text, {}
        least = np.full(257, self.depth, np.int16)  # least value scanned since a first byte's last suffix

        def scan(places: np.ndarray, shared: np.ndarray) -> None:
            before = places - 1
            hit = places > 0
            hit &= is_s[before] == to_s
            hit &= text[before] > 0
            target = text[before]
            chosen = np.flatnonzero(hit)
            chosen = chosen[np.argsort(target[chosen], kind="stable")]
            found = target[chosen]
            cuts = (np.flatnonzero(np.diff(found)) + 1).tolist()
            low = shared.min()
            ends: list[tuple[int, int]] = []
            for a, b in zip([0, *cuts], [*cuts, len(chosen)], strict=True):
                if a == b:
                    continue
                c, at = int(found[a]), chosen[a:b]
                starts = np.append(0, at + 1)
                mins = np.minimum.reduceat(shared, starts if starts[-1] < len(shared) else starts[:-1])
                value = mins[: len(at)].copy()
                value[0] = min(value[0], least[c])
                if c not in queue:
                    queue[c] = Spool(budget)
                    value[0] = -1
                queue[c].push(before[at], np.minimum(value + 1, self.depth).astype(np.int16))
                ends.append((c, mins[len(at)] if starts[-1] < len(shared) else self.depth))
            np.minimum(least, low, out=least)
            for c, value in ends:
                least[c] = value

        last = None
        for c in range(256, -1, -1) if to_s else range(257):
            own = queue.get(c)
            k = 0
            while (own := queue.get(c)) is not None and k < len(own.blocks):
                own.gather(k)
                places, shared = own.get(k)
                scan(places, shared)
                last, k = places[-1:], k + 1
            if (seed := seeds.get(c)) is None:
                continue
            blocks = range(len(seed.blocks))
            carried = None
            for k in reversed(blocks) if to_s else blocks:
                places, shared = seed.get(k)
                if to_s:  # backwards: what a suffix shares with the one scanned before it
                    places, shared = places[::-1], np.append(np.int16(carried or 0), shared[:0:-1]).astype(np.int16)
                    carried = int(seed.get(k)[1][0])
                shared = shared.copy()
                if last is not None and (k == (len(seed.blocks) - 1 if to_s else 0)):
                    shared[0] = self.shared(last.astype(np.int64), places[:1].astype(np.int64))[0]
                scan(places, shared)
                last = places[-1:]
                if not to_s:
                    seed.drop(k)
        return queue


def repeated(runs: list[bytes], depth: int, most: int = IN_MEMORY) -> list[np.ndarray]:
    """For each run, the places from which depth bytes also start elsewhere in the shard."""
    shard = Shard(runs, depth, most)
    out, tail = [], None
    for places, shared in shard.ordered():
        if tail is not None and shared[0] >= depth:
            out.append(np.array([tail]))
        same = shared >= depth
        out.append(places[same])
        out.append(places[:-1][same[1:]])
        tail = int(places[-1])
    found = np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)
    run = np.searchsorted(shard.ends, found)
    starts = np.append(0, shard.ends[:-1] + 1)
    cuts = np.searchsorted(run, np.arange(1, len(runs)))
    return np.split(found - starts[run], cuts)
