"""Scalar functions and guards."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def threshold(x: Column, tau: Column | float) -> Column:
    """What is left over ``tau``, nothing below it."""
    return relu(x - tau)


def saturate(x: Column, mode: str) -> Column:
    if mode not in ("none", "log1p"):
        raise ValueError(f"unknown saturation {mode}")
    return F.log1p(x) if mode == "log1p" else x


def clamp_min(x: Column, eps: float) -> Column:
    return F.greatest(x, F.lit(float(eps)))


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, or ``default`` where b is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(default))


@F.pandas_udf(DoubleType())
def gelu(x: pd.Series) -> pd.Series:
    """x * Phi(x); Spark has no error function."""
    return x.map(lambda v: v * 0.5 * (1 + math.erf(v / math.sqrt(2))) if v is not None else None).astype(float)
