"""Cleaning ticks and their daily and rolling statistics.

Ticks have symbol, date, seq (order within the symbol), price and vol_tick. NULL and NaN prices and volumes count as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.book import clean, is_share


def cleaned(ticks: DataFrame) -> DataFrame:
    """Ticks with a symbol; price and volume without NULL or NaN."""
    return ticks.filter("symbol is not null and symbol <> ''").withColumns({"price": clean(F.col("price")), "vol_tick": clean(F.col("vol_tick"))})


def shares(ticks: DataFrame) -> DataFrame:
    """Ticks of listed shares."""
    return ticks.filter(is_share(F.col("symbol")))


def share_symbols(ticks: DataFrame) -> DataFrame:
    return ticks.select("symbol").filter(is_share(F.col("symbol"))).distinct()


def traded(ticks: DataFrame) -> DataFrame:
    """Ticks with a positive price and volume."""
    return ticks.filter((F.col("price") > 0) & (F.col("vol_tick") > 0))


def of_symbols(ticks: DataFrame, symbols: list[str] | DataFrame) -> DataFrame:
    """Ticks of some symbols: up to ten by pushed-down values, else by a semi-join with their table."""
    if isinstance(symbols, DataFrame):
        return ticks.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    if len(symbols) <= 10:
        return ticks.filter(F.col("symbol").isin(*symbols))
    return of_symbols(ticks, ticks.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string"))


def between_dates(ticks: DataFrame, first: str, last: str) -> DataFrame:
    return ticks.filter(F.col("date").between(first, last))


def daily_stats(ticks: DataFrame, in_order: bool = False) -> DataFrame:
    """Per symbol and date: all volume, high and low of positive prices, ticks.

    in_order adds volumes tick by tick in the order of seq, as the stream does: where they are fractions, the sum, and with it a threshold that a bar just meets, then doesn't vary with the partitioning.
    """
    price = F.when(F.col("price") > 0, F.col("price"))
    if in_order:
        upto = F.sum("vol_tick").over(Window.partitionBy("symbol", "date").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
        narrow = ticks.select("symbol", "date", "seq", "price", "vol_tick").withColumn("_upto", upto)
        return narrow.groupBy("symbol", "date").agg(F.max_by("_upto", "seq").alias("volume"), F.max(price).alias("high"), F.min(price).alias("low"), F.count(F.lit(1)).alias("ticks"))
    return ticks.groupBy("symbol", "date").agg(F.sum("vol_tick").alias("volume"), F.max(price).alias("high"), F.min(price).alias("low"), F.count(F.lit(1)).alias("ticks"))


def rolling_macro(daily: DataFrame, days: int = 20, share: float = 0.02, least: float = 1000.0, first_threshold: float = 50_000.0, first_volume: float = 5_000_000.0, first_range: float = 0.5) -> DataFrame:
    """Per symbol and date: v_d, sigma_d and threshold from earlier days only.

    v_d is the mean volume of the last `days` earlier days that had volume; sigma_d the mean range of the last earlier days, where a range
    is 1e-4 or more, also on a day without trades. Without such days the first values hold; the first day's threshold is its own.
    """
    own = Window.partitionBy("symbol").orderBy("date")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    spread = F.greatest(F.coalesce(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(1e-4))
    positive = daily.filter(F.col("volume") > 0).select("symbol", "date", F.avg("volume").over(own.rowsBetween(1 - days, 0)).alias("_mean"))
    joined = daily.join(positive, ["symbol", "date"], "left")
    v_d = F.coalesce(F.last("_mean", ignorenulls=True).over(earlier), F.lit(first_volume))
    sigma_d = F.coalesce(F.avg(spread).over(own.rowsBetween(-days, -1)), F.lit(first_range))
    with_means = joined.withColumns({"v_d": v_d, "sigma_d": sigma_d, "_day": F.row_number().over(own)})
    threshold = F.when(F.col("_day") == 1, F.lit(first_threshold)).otherwise(F.greatest(F.col("v_d") * share, F.lit(least)))
    return with_means.withColumn("threshold", threshold).drop("_mean", "_day")


def day_changes(ticks: DataFrame) -> DataFrame:
    """The first tick of each date in each symbol's order of arrival, with the date before."""
    before = F.lag("date").over(Window.partitionBy("symbol").orderBy("seq"))
    return ticks.withColumn("date_before", before).filter(~F.col("date").eqNullSafe(F.col("date_before"))).select("symbol", "seq", "date", "date_before")
