"""The registered queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import data, evaluation, market, trading

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for module in (evaluation, market, trading, data):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES

FLAGSHIP = QUERIES["daily_ic"]
