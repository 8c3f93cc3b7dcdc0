"""Rounding and SQL pieces that several query modules share."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import fixtures

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """df with its doubles rounded, since sums of doubles vary with the partitioning; zero has no sign."""
    return df.select(*[(F.round(f"`{c}`", digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def rounded_as_sql(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """As `rounded`, but the scaled double is rounded, half away from zero, as DuckDB does; `F.round` makes a decimal text of each value, which is dear where rows are many."""
    scale = float(10**digits)
    whole, finite = 2.0**52 / scale, sys.float_info.max / scale  # from `whole` on, no scaled double has a fraction

    def of(x: Column) -> Column:
        near = F.signum(x) * F.floor(F.abs(x) * scale + 0.49999999999999994) / scale  # the greatest double under a half: a whole half is added to what has none
        return F.when(F.abs(x) < whole, near).when(F.abs(x) <= finite, x * scale / scale).otherwise(x) + 0.0

    return df.select(*[of(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


P = f"p as (select *, pred_bp as x, target_bp as y from {fixtures.PREDICTIONS_SQL})"
TICKS = f"t as (select * from {fixtures.TICKS_SQL})"


def corr(x: str, y: str) -> str:
    return f"(covar_pop({x}, {y}) / nullif(sqrt(var_pop({x}) * var_pop({y})), 0))"


def avg_rank(x: str, keys: str = "") -> str:
    part = f"partition by {keys} " if keys else ""
    ties = f"partition by {keys + ', ' if keys else ''}{x}"
    return f"(rank() over ({part}order by {x}) + (count(*) over ({ties}) - 1) / 2.0)"


def r(x: str, digits: int = DIGITS) -> str:
    return f"round({x}, {digits}) + 0.0"
