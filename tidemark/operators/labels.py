"""Swing labels over daily bars: symbol, date, open_price, close_price."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.book import log_modulus


def daily_bars(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol", "date").agg(F.min_by("price", "seq").alias("open_price"), F.max_by("price", "seq").alias("close_price"), F.count(F.lit(1)).alias("ticks"))


def swing_labels(daily: DataFrame, horizon: int = 20, hold: int = 5, past: int = 20, cost: float = 0.003, gain: float = 0.15) -> DataFrame:
    """daily with breakout, log_sharpe and phase; NULL where the days ahead or (phase) behind are missing or the entry is not positive.

    Entry at the next open plus cost, exit at the horizon's close less cost. breakout: the best close ahead is over the entry by `gain`.
    log_sharpe: log-modulus of the return over the largest drawdown (from the running maximum of entry and closes). phase: the next closes
    all stand over the mean of the past ones.
    """
    own = Window.partitionBy("symbol").orderBy("date")
    ahead = own.rowsBetween(1, horizon)
    base = daily.withColumns({
        "_entry": F.lead("open_price", 1).over(own) * (1 + cost), "_closes": F.collect_list("close_price").over(ahead), "_n": F.count(F.lit(1)).over(ahead), "_near": F.min("close_price").over(own.rowsBetween(1, hold)),
        "_mean": F.avg("close_price").over(own.rowsBetween(1 - past, 0)), "_past": F.count(F.lit(1)).over(own.rowsBetween(1 - past, 0)),
    })
    whole = (F.col("_n") == horizon) & (F.col("_entry") > 0)
    start = F.struct(F.col("_entry").alias("peak"), F.lit(0.0).alias("worst"), F.lit(True).alias("first"))

    def step(acc, close):
        peak = F.greatest(acc["peak"], close)
        down = close * (1 - cost) / peak - 1
        return F.struct(peak.alias("peak"), F.when(acc["first"], down).otherwise(F.least(acc["worst"], down)).alias("worst"), F.lit(False).alias("first"))

    drawdown = F.abs(F.aggregate("_closes", start, step, lambda acc: acc["worst"]))
    gained = F.element_at("_closes", -1) * (1 - cost) / F.col("_entry") - 1
    return base.select(
        *daily.columns, F.when(whole, (F.array_max("_closes") / F.col("_entry") - 1 > gain).cast("double")).alias("breakout"),
        F.when(whole, log_modulus(gained / (drawdown + 1e-4))).alias("log_sharpe"), F.when(whole & (F.col("_past") == past), (F.col("_near") > F.col("_mean")).cast("double")).alias("phase"),
    )
