"""Special functions that Spark lacks, vectorized over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / fix(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, rounds + 1):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / fix(1 + t * d)
            c = fix(1 + t / c)
            h *= c * d
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = x < (a + 1) / (a + b + 2)
    got = np.where(low, front * beta_fraction(a, b, np.where(low, inner, 0.5)) / a, 1 - front * beta_fraction(b, a, np.where(low, 0.5, 1 - inner)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, got))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def t_pvalue(t: Column | str, df: Column | str) -> Column:
    """Two-sided p of Student's t; null for missing arguments."""

    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = (t.notna() & df.notna() & (df > 0)).to_numpy()
        p = t_two_sided(np.where(ok, t, 0.0), np.where(ok, df, 1.0))
        return pd.Series([float(v) if k else None for v, k in zip(p, ok, strict=True)], dtype=object)

    return F.pandas_udf(run, "double")(_column(t).cast("double"), _column(df).cast("double"))


def erfc(x: Column | str) -> Column:
    """Complementary error function; null stays null."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else math.erfc(v) for v in x], dtype=object)

    return F.pandas_udf(run, "double")(_column(x).cast("double"))
