"""Aggregate expressions that stay NULL where a statistic is not defined."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; NULL on a constant column or under two rows (`corr` raises there in ANSI mode)."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))  # the variance of equal values needn't be zero once parts are merged
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))))


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1 within the keys; ties get the mean of their ranks."""
    own = Window.partitionBy(*keys)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(own.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
