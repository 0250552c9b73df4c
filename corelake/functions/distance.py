"""Distances between vectors, each as a Column expression and as a numpy function for work in blocks.

Null or empty vectors have no distance; callers validate points first (see sources.points). The numpy forms take
direct differences rather than inner products, so that equal vectors are at distance exactly zero.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Distance:
    """expr(a, b) on array columns; block(x, y) from (m, d) and (k, d) arrays to an (m, k) array.

    metric tells whether it obeys the triangle inequality, so that bounds may save distances. A distance that doesn't may
    have lift: a growing function of distances whose values do, up to slack. rough(y), if there is one, prepares finite vectors
    y; called with others, what it returns quickly gives their distances to a power, and how far each row's may be off (see near). norm: it is a norm of the difference.
    """

    name: str
    expr: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    metric: bool = False
    lift: Callable[[np.ndarray], np.ndarray] | None = None
    slack: float = 1e-9
    rough: Callable[[np.ndarray], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]] | None = None
    power: int = 1
    norm: bool = False

    @property
    def bounded(self) -> bool:
        return self.metric or self.lift is not None

    def lifted(self, distances: np.ndarray) -> np.ndarray:
        return distances if self.lift is None else self.lift(distances)


def _total(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, x: acc + x)


#: Values of a block of differences: as many as a processor's cache holds.
_CACHED = 1 << 15
#: What single precision may lose below its least values.
_TINY = 1e-37


def _blocked(x: np.ndarray, y: np.ndarray, term: Callable[[np.ndarray], np.ndarray], part: Callable[..., np.ndarray] | None = None) -> np.ndarray:
    """term of the differences; of few components it may be the sum of part of each, taken in turn, which numpy does in the same order."""
    out, width = np.zeros((len(x), len(y))), max(1, x.shape[1])
    if part and 0 < x.shape[1] < 8:
        columns = max(1, min(len(y), _CACHED // width))
        rows = max(1, _CACHED // width // columns)
        a, b = x.T[:, :, None], y.T[:width, None, :]
        for k in range(0, len(x), rows):
            for j in range(0, len(y), columns):
                far = a[:, k : k + rows] - b[:, :, j : j + columns]
                own, *others = part(far, out=far)
                for other in others:
                    own += other
                out[k : k + rows, j : j + columns] = own
        return out
    columns = max(1, min(len(y), _CACHED // width))
    rows = max(1, _CACHED // (columns * width))
    for k in range(0, len(x), rows):
        for j in range(0, len(y), columns):
            out[k : k + rows, j : j + columns] = term(x[k : k + rows, None, :] - y[None, j : j + columns, :])
    return out


Rough = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _rough_l1(y: np.ndarray) -> Rough:
    """By single precision, a component at a time. Values are taken from the middle of y, as their size tells how far off."""
    middle = y.mean(0)
    y = y - middle
    most = np.abs(y).sum(1).max(initial=0.0)
    b = np.ascontiguousarray(y.T, np.float32)

    def to(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x - middle
        far = np.abs(x).sum(1) + most
        a = np.ascontiguousarray(x.T, np.float32)
        out = np.zeros((len(x), len(y)), np.float32)
        columns = min(len(y), 4096)
        rows = max(1, _CACHED // max(1, columns))
        for k in range(0, len(x), rows):
            for j in range(0, len(y), columns):
                own = np.zeros_like(out[k : k + rows, j : j + columns])
                part = np.empty_like(own)
                for p, q in zip(a[:, k : k + rows], b[:, j : j + columns], strict=True):
                    np.subtract(p[:, None], q[None, :], out=part)
                    np.abs(part, out=part)
                    own += part
                out[k : k + rows, j : j + columns] = own
        return out, (x.shape[1] + 8) * (2.0**-22 * far + _TINY)

    return to


def _rough_l2(y: np.ndarray) -> Rough:
    """Squares, by inner products in single precision; the squares of x and y are two components more, so that one product adds them."""
    middle = y.mean(0)
    y = y - middle
    yy = (y * y).sum(1)
    most = yy.max(initial=0.0)
    b = np.column_stack([-2 * y, yy, np.ones(len(y))]).astype(np.float32).T

    def to(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x - middle
        xx = (x * x).sum(1)
        a = np.column_stack([x, np.ones(len(x)), xx]).astype(np.float32)
        return a @ b, (x.shape[1] + 8) * (2.0**-21 * (xx + most) + _TINY)

    return to


def _cosine(a: Column, b: Column) -> Column:
    norm = lambda v: F.sqrt(_total(v, v, lambda x, y: x * y))
    na, nb = norm(a), norm(b)
    value = F.greatest(F.lit(0.0), 1 - _total(a, b, lambda x, y: x * y) / (na * nb))
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(value)


def _cosine_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    norms = nx[:, None] * ny[None, :]
    value = np.maximum(0.0, 1 - (x @ y.T) / np.where(norms == 0, 1, norms))
    return np.where(norms > 0, value, np.where((nx == 0)[:, None] & (ny == 0)[None, :], 0.0, 1.0))


def _angle(distances: np.ndarray) -> np.ndarray:
    """The angle that a cosine distance stands for. A zero vector is at right angles to all others, which keeps the
    triangle inequality; near zero an angle is known to the root of a distance's rounding."""
    return np.arccos(np.clip(1 - distances, -1.0, 1.0))


_REGISTRY: dict[str, Distance] = {}


def register(distance: Distance) -> Distance:
    """Makes a distance known by its name, for every operator."""
    _REGISTRY[distance.name] = distance
    return distance


def get(distance: str | Distance) -> Distance:
    if isinstance(distance, Distance):
        return distance
    if distance not in _REGISTRY:
        raise ValueError(f"unknown distance {distance!r}; there are {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[distance]


L1 = register(Distance("l1", lambda a, b: _total(a, b, lambda x, y: F.abs(x - y)), lambda x, y: _blocked(x, y, lambda d: np.abs(d).sum(-1), np.abs), True, rough=_rough_l1, norm=True))
L2 = register(Distance("l2", lambda a, b: F.sqrt(_total(a, b, lambda x, y: (x - y) * (x - y))), lambda x, y: np.sqrt(_blocked(x, y, lambda d: (d * d).sum(-1), np.square)), True, rough=_rough_l2, power=2, norm=True))
COSINE = register(Distance("cosine", _cosine, _cosine_block, lift=_angle, slack=1e-6))
HAMMING = register(
    Distance("hamming", lambda a, b: _total(a, b, lambda x, y: F.when(x == y, 0.0).otherwise(1.0)) / F.size(a), lambda x, y: _blocked(x, y, lambda d: (d != 0).mean(-1)), True)
)
