"""The normal distribution, vectorised for Arrow batches."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled_tail(z):
    """P(Z > z) / density(z) for z >= 0: a series near 0, a continued fraction beyond; both to the last digits of a double."""
    import numpy as np

    near = z < 3.0
    # P(Z <= z) - 1/2 = density(z) (z + z^3 / 3 + z^5 / (3 5) + ..): all terms are positive, so nothing cancels but the last difference.
    x = np.where(near, z, 0.0)
    term, total = x.copy(), x.copy()
    for k in range(1, 80):
        term = term * x * x / (2 * k + 1)
        total += term
    by_series = 0.5 * np.exp(x * x / 2) * math.sqrt(2 * math.pi) - total
    y = np.where(near, 3.0, z)
    fraction = y.copy()
    for k in range(120, 0, -1):
        fraction = y + k / fraction
    return np.where(near, by_series, 1 / fraction)


def tail(z):
    """P(Z > z) of an array; NaN stays."""
    import numpy as np

    z = np.asarray(z, float)
    size = np.abs(z)
    upper = _scaled_tail(np.where(np.isfinite(size), size, 0.0)) * np.exp(-(np.where(np.isfinite(size), size, 0.0) ** 2) / 2) / math.sqrt(2 * math.pi)
    upper = np.where(np.isinf(size), 0.0, upper)
    return np.where(np.isnan(z), np.nan, np.where(z < 0, 1 - upper, upper))


def inverse(p):
    """The z with P(Z <= z) = p of an array; NaN outside (0, 1).

    Newton steps on the logarithm of the smaller tail, which is concave, so they come from one side and always arrive.
    """
    import numpy as np

    p = np.asarray(p, float)
    inside = (p > 0) & (p < 1)
    low = np.where(inside, np.minimum(p, 1 - p), 0.5)
    wanted = np.log(low)
    z = np.sqrt(np.maximum(-2 * np.log(2 * low), 0.0))  # an upper bound: P(Z > z) <= exp(-z^2 / 2) / 2
    for _ in range(60):
        ratio = _scaled_tail(z)
        step = (np.log(ratio) - z * z / 2 - 0.5 * math.log(2 * math.pi) - wanted) * ratio
        z = z + step
        if (np.abs(step) <= 1e-9 * (1 + z)).all():  # the error is squared by each step
            break
    return np.where(inside, np.where(p < 0.5, -z, z), np.nan)


def _by_batch(of, x: Column) -> Column:
    @F.pandas_udf("double")
    def batch(v):
        import numpy as np
        import pandas as pd

        out = of(v.to_numpy(float, na_value=np.nan))
        return pd.Series(out).where(~np.isnan(out), None)

    return batch(x)


def upper_tail(z: Column) -> Column:
    """P(Z > z); null for null and NaN."""
    return _by_batch(tail, z)


def quantile(p: Column) -> Column:
    """The z with P(Z <= z) = p; null outside (0, 1)."""
    return _by_batch(inverse, p)


def density(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
