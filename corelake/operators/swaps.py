"""k-medoids by swaps: a medoid goes for another point whenever that lowers the cost of all.

Each point knows its nearest and its second-nearest medoid. What the loss of a medoid would cost its points is kept
for every medoid, so that one pass over a candidate's distances judges its swap with each of them, and the best swap
is taken at once if it helps. The search ends when no candidate in a whole round helps: no single swap does then.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as dist
from . import kmedoids, sensitivity

#: Gains below this share of the cost are rounding.
GAIN = 1e-12
_FOUND = "cluster int, center_id long, center array<double>, cost double, swaps long, start double, total_cost double"


class Swaps:
    """Medoids of points with weights w and distances d, and what swaps of them would change."""

    def __init__(self, d: np.ndarray, w: np.ndarray, medoids: np.ndarray):
        self.d, self.w, self.medoids, self.swaps = d, w, medoids.copy(), 0
        self._settle()

    def _settle(self) -> None:
        far = self.d[:, self.medoids]
        k = far.shape[1]
        self.first = far.argmin(1)
        self.near = far.min(1)
        # with one medoid there is no second: a swap's candidate takes all points
        self.next = np.partition(far, 1, axis=1)[:, 1] if k > 1 else np.full(len(far), np.inf)
        lost = self.w * (self.next - self.near)
        self.loss = np.bincount(self.first, lost, k) if k > 1 else np.zeros(1)

    @property
    def cost(self) -> float:
        return float(self.w @ self.near)

    def changes(self, candidate: int) -> np.ndarray:
        """The change of the cost for the swap of each medoid with the candidate."""
        own = self.d[:, candidate]
        if len(self.medoids) == 1:
            return np.array([self.w @ (own - self.near)])
        nearer = own < self.near
        gain = float(self.w[nearer] @ (own - self.near)[nearer])
        # points that come to the candidate lose nothing with their medoid; others fall to the candidate if it is nearer than their second
        between = ~nearer & (own < self.next)
        change = np.where(nearer, self.near - self.next, np.where(between, own - self.next, 0.0))
        return self.loss + np.bincount(self.first, self.w * change, len(self.medoids)) + gain

    def search(self, rounds: int) -> None:
        n, rest, at = len(self.w), len(self.w), 0
        for _ in range(rounds * n):
            change = self.changes(at)
            best = int(change.argmin())
            if change[best] < -GAIN * (1 + self.cost):
                self.medoids[best] = at
                self.swaps += 1
                self._settle()
                rest = n
            at, rest = (at + 1) % n, rest - 1
            if not rest:
                return


def fit(points: DataFrame, k: int, *, distance: str | dist.Distance = "l2", rounds: int = 100, iterations: int = 15, seed: int = 1) -> DataFrame:
    """cluster, center_id, center, cost, swaps, start and total_cost of medoids that no single swap improves.

    points have id, weight and v; a set of more than kmedoids.MOST_POINTS is first reduced to so many (see
    sensitivity.reduced). The search starts from the best state of the alternation of kmedoids.search, whose cost is
    start, so it never ends above it. k is cut to the number of points that lie apart.
    """
    d = dist.get(distance)
    points = sensitivity.reduced(points, kmedoids.MOST_POINTS, k, distance=d)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        v, w = np.stack(pdf["v"].tolist()), pdf["weight"].to_numpy()
        far = d.block(v, v)
        state = Swaps(far, w, kmedoids.search(far, w, k, iterations, seed)[0])
        start = state.cost
        state.search(rounds)
        costs = np.bincount(state.first, w * state.near, len(state.medoids))
        return pd.DataFrame(
            {"cluster": range(len(costs)), "center_id": pdf["id"].to_numpy()[state.medoids], "center": v[state.medoids].tolist(), "cost": costs, "swaps": state.swaps, "start": start, "total_cost": costs.sum()}
        )

    return points.select("id", "weight", "v").groupBy(F.lit(0).alias("_")).applyInPandas(run, _FOUND)
