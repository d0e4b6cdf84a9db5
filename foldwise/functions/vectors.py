"""Vector arithmetic on array columns.

Distances are taken between unit vectors whose coordinates lie on a fixed grid.  The grid is
finer than the precision of float32 input, and every dot product of two grid vectors is an
integer below 2**53, so it is exact in a double whatever the order of summation.  Equal pairs
therefore get bit-equal distances in every task, which keeps ties and tree shapes stable.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = float(2**26)


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(vector: Column) -> Column:
    """Unit vector in double; a zero vector stays zero.  The norm is taken once, not for every coordinate."""
    wide = as_doubles(vector)

    def unit(square: Column) -> Column:
        size = F.sqrt(square)
        return F.when(size > 0, F.transform(wide, lambda x: x / size)).otherwise(wide)

    return F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x, unit)


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def cosine_to_euclid(eps: float) -> float:
    """Euclidean radius on the unit sphere for a cosine distance; negative counts as zero."""
    return math.sqrt(2.0 * max(eps, 0.0))


def cosine_to_euclid_col(eps: Column) -> Column:
    return F.sqrt(F.lit(2.0) * F.greatest(eps, F.lit(0.0)))


def time_kernel(delta_seconds: Column, decay_days: float) -> Column:
    return F.exp(-F.abs(delta_seconds) / 86400.0 / max(1e-6, decay_days))


def grid_vector(vector: Column) -> Column:
    """Unit vector rounded to whole grid steps, as doubles holding integers."""
    return F.transform(l2_normalize(vector), lambda x: F.rint(x * GRID))


def grid_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two blocks of grid vectors."""
    cross = x @ y.T
    own_x = np.einsum("ij,ij->i", x, x)
    own_y = np.einsum("ij,ij->i", y, y)
    square = (own_x[:, None] - cross) + (own_y[None, :] - cross)
    return np.sqrt(np.maximum(square, 0.0)) / GRID
