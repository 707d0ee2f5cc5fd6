"""Logistic regression by Newton's method; a pass over the rows a step, whose sums alone reach the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquarry.storage import cut


def _probability(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def _sums(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient, Hessian and log likelihood under the weights. A task adds up its rows; the places are added up by a shuffle."""
    d = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(d + d * d + 1)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b.column(1).to_numpy(zero_copy_only=False)
            z = x @ weights
            p = _probability(z)
            out[:d] += x.T @ (y - p)
            out[d:-1] += (x.T @ (x * (p * (1 - p))[:, None])).ravel()
            out[-1] += (y * z - np.logaddexp(0, z)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["place", "value"])

    total = np.zeros(d + d * d + 1)
    for r in rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # d + d * d + 1 rows
        total[r.place] = r.value
    return total[:d], total[d:-1].reshape(d, d), float(total[-1])


@dataclass
class Fit:
    """Weights on standardised features, the intercept first; what they were standardised by; steps taken, and whether the last
    one changed less than was asked for."""

    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    steps: int
    settled: bool

    def coefficients(self) -> np.ndarray:
        """On the features as they are, the intercept first."""
        own = self.weights[1:] / self.scale
        return np.r_[self.weights[0] - own @ self.centre, own]

    def probability(self, features: Sequence[str]) -> Column:
        first, *rest = self.coefficients().tolist()
        z = F.lit(first)
        for c, w in zip(features, rest, strict=True):
            z = z + F.lit(w) * F.col(c)
        return 1 / (1 + F.exp(-z))


def fit(df: DataFrame, features: Sequence[str], truth: str, penalty: float = 1.0, most: int = 50, tolerance: float = 1e-10) -> Fit:
    """The weights that make the log likelihood, less half the penalty times the squared weights but the intercept's, largest, on
    standardised features (a constant one has weight 0). truth is 0 or 1; rows with a null are left out. Each step solves d x d
    on the driver and halves itself until the likelihood grows. Without rows all weights are 0."""
    rows = df.select(*(F.col(c).cast("double") for c in features), F.col(truth).cast("double").alias("__y")).dropna()
    means = rows.agg(*(f(c) for c in features for f in (F.avg, F.stddev_pop))).first()
    centre, scale = np.array([v or 0.0 for v in means[::2]]), np.array([v or 0.0 for v in means[1::2]])
    flat = scale <= 1e-12 * (1 + np.abs(centre))
    scale = np.where(flat, 1.0, scale)
    parts = [F.lit(0.0) if off else (F.col(c) - m) / s for c, m, s, off in zip(features, centre.tolist(), scale.tolist(), flat.tolist(), strict=True)]
    rows = cut(rows.select(F.array(F.lit(1.0), *parts).alias("x"), F.col("__y").alias("y")))
    weights, ridge = np.zeros(len(features) + 1), penalty * np.r_[0.0, np.ones(len(features))]
    gradient, curve, value = _sums(rows, weights)
    settled, step = False, 0
    while not settled and step < most:
        step += 1
        change = np.linalg.lstsq(curve + np.diag(ridge), gradient - ridge * weights, rcond=None)[0]
        now = value - 0.5 * (ridge * weights**2).sum()
        for _ in range(30):
            after = weights + change
            gradient, curve, value = _sums(rows, after)
            if value - 0.5 * (ridge * after**2).sum() >= now - 1e-12 * (1 + abs(now)):
                break
            change = change / 2
        weights, settled = after, bool(np.abs(change).max() < tolerance)
    return Fit(weights, centre, scale, step, settled)
