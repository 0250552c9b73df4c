"""What is near among all pairs of two sets of vectors, with the result of meeting them all.

Rough distances tell which pairs can't matter; the others' are computed by direct differences, as the distance's block
does. Where they'd be many, or a value isn't finite, whole blocks are met.
"""

from __future__ import annotations

import numpy as np

from .distance import Distance

#: Pairs of a block; size of values up to which single precision serves; share of pairs from which on blocks are met.
PAIRS, LARGE, MANY = 1 << 22, 1e15, 0.1


def serves(d: Distance, y: np.ndarray) -> bool:
    """Whether rough distances to y are worth their while."""
    return d.rough is not None and len(y) >= 16 and y.shape[1] >= 8 and _fit(y).all()


def _fit(x: np.ndarray) -> np.ndarray:
    """Rows whose values are finite and not too large (NaN isn't below anything)."""
    return (np.abs(x) < LARGE).all(1)


def _exact(d: Distance, x: np.ndarray, y: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The distances of pairs; each stands alone, so that they are those of a block."""
    out = np.empty(len(row))
    for k in range(0, len(row), 4096):
        a, b = x[row[k : k + 4096]], y[at[k : k + 4096]]
        out[k : k + 4096] = d.block((a - b)[:, :], np.zeros((1, x.shape[1])))[:, 0]
    return out


def _slices(x: np.ndarray, y: np.ndarray) -> list[slice]:
    step = max(1, PAIRS // max(1, len(y)))
    return [slice(k, k + step) for k in range(0, len(x), step)]


def nearest(d: Distance, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the nearest of y for each of x, the first of equally near ones; infinity for none."""
    place, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    rough = d.rough(y) if serves(d, y) else None
    for s in _slices(x, y):
        own, fit = x[s], _fit(x[s]) if rough else np.zeros(len(x[s]), bool)
        if fit.any():
            rows = np.flatnonzero(fit)
            found, off = rough(own[rows])
            # rounded up to the precision of what it is held against
            most = np.nextafter((found.min(1) + 2 * off).astype(np.float32), np.float32(np.inf))
            row, at = np.divmod(np.flatnonzero(found <= most[:, None]), len(y))
            if len(row) <= MANY * found.size + len(rows):
                exact = _exact(d, own[rows], y, row, at)
                order = np.lexsort((at, exact, row))
                first = order[np.r_[True, np.diff(row[order]) != 0]]
                place[s.start + rows], best[s.start + rows] = at[first], exact[first]
            else:
                fit = np.zeros_like(fit)
        rows = np.flatnonzero(~fit)
        if len(rows):
            found = d.block(own[rows], y)
            found = np.where(np.isnan(found), np.inf, found)
            place[s.start + rows] = found.argmin(1)
            best[s.start + rows] = found.min(1)
    return place, best


def counts(d: Distance, x: np.ndarray, y: np.ndarray, within: list[tuple[int, float]]) -> np.ndarray:
    """For each of x and each (size, reach): how many of the first so many of y lie within reach."""
    out = np.zeros((len(x), len(within)), np.int64)
    rough = d.rough(y) if serves(d, y) else None
    for s in _slices(x, y):
        own = x[s]
        if rough and _fit(own).all():
            found, off = rough(own)
            for k, (size, reach) in enumerate(within):
                part = found[:, : max(0, size)]
                sure = part <= (reach**d.power - off)[:, None]
                out[s, k] = sure.sum(1)
                row, at = np.nonzero((part <= (reach**d.power + off)[:, None]) & ~sure)
                if len(row):
                    out[s, k] += np.bincount(row[_exact(d, own, y, row, at) <= reach], minlength=len(own))
        else:
            found = d.block(own, y)
            for k, (size, reach) in enumerate(within):
                out[s, k] = (found[:, : max(0, size)] <= reach).sum(1)
    return out


def smallest(d: Distance, x: np.ndarray, y: np.ndarray, far: np.ndarray, heavy: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances, weights) of the k nearest, by growing distance, equal ones by weight: of those known so far (far and heavy, k
    of each of x, infinitely far where there are fewer) and of y with its weights."""
    far, heavy, k = far.copy(), heavy.copy(), far.shape[1]
    rough = d.rough(y) if serves(d, y) else None
    for s in _slices(x, y):
        own = x[s]
        if rough and _fit(own).all():
            found, off = rough(own)
            last = far[s].max(1) ** d.power
            if len(y) > k and np.isinf(last).any():
                last = np.minimum(last, np.partition(found, k - 1, axis=1)[:, k - 1] + off)
            row, at = np.nonzero(found <= (last + off)[:, None])
            exact = _exact(d, own, y, row, at)
        else:
            found = d.block(own, y)
            last = far[s].max(1)
            if len(y) > k and np.isinf(last).any():
                last = np.minimum(last, np.partition(found, k - 1, axis=1)[:, k - 1])
            row, at = np.nonzero(found <= last[:, None])
            exact = found[row, at]
        row = np.r_[np.repeat(np.arange(len(own)), k), row]
        exact, weight = np.r_[far[s].ravel(), exact], np.r_[heavy[s].ravel(), weights[at]]
        order = np.lexsort((weight, exact, row))
        starts = np.searchsorted(row[order], np.arange(len(own)))
        kept = order[starts[:, None] + np.arange(k)]
        far[s], heavy[s] = exact[kept], weight[kept]
    return far, heavy
