"""Tail probabilities for summary rows (a handful per report). Vectorised, applied to aggregates only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_upper(t: float, df: float) -> float:
    """P(T > t): with T = sqrt(df) tan(a) the density is proportional to cos(a) ** (df - 1), a smooth finite integral."""
    nodes, weights = np.polynomial.legendre.leggauss(400)
    start = math.atan(t / math.sqrt(df))
    half = (math.pi / 2 - start) / 2
    angle = start + half * (nodes + 1)
    log_scale = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    return float(half * np.sum(weights * np.exp(log_scale + (df - 1) * np.log(np.maximum(np.cos(angle), 1e-300)))))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_two_sided(v)).astype("float64")


@F.pandas_udf(T.DoubleType())
def t_upper_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else t_upper(a, b) for a, b in zip(t, df)], dtype="float64")
