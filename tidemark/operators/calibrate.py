"""Price-impact coefficients and data-derived clock constants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.book import implied_quantity
from tidemark.operators.ticks import daily_stats, traded

DEFAULT_FRICTION = 0.842


def directional_runs(ticks: DataFrame, most_share: float | None = None) -> DataFrame:
    """Runs of consecutive equal flags (NULL equals NULL) of traded ticks within a symbol and date: volume q and absolute move dp, both positive.

    most_share drops runs with more than that share of the day's volume.
    """
    day = Window.partitionBy("symbol", "date").orderBy("seq")
    new = F.when(F.col("bs_flag").eqNullSafe(F.lag("bs_flag").over(day)) & (F.row_number().over(day) > 1), 0).otherwise(1)
    marked = traded(ticks).withColumn("_new", new).withColumn("run", F.sum("_new").over(day))
    runs = marked.groupBy("symbol", "date", "run").agg(F.sum("vol_tick").alias("q"), F.abs(F.max_by("price", "seq") - F.min_by("price", "seq")).alias("dp"))
    if most_share is not None:
        runs = runs.withColumn("_day", F.sum("q").over(Window.partitionBy("symbol", "date"))).filter(F.col("q") <= most_share * F.col("_day")).drop("_day")
    return runs.filter((F.col("q") > 0) & (F.col("dp") > 0))


def friction(ticks: DataFrame, least_volume: float = 1000.0, low: float = 0.05, high: float = 10.0, default: float = DEFAULT_FRICTION, most_share: float | None = None) -> DataFrame:
    """Per symbol: c of the zero-intercept fit over all days, runs and days; c out of (low, high), or without a fit, becomes the median of the others, else the default. Six decimals."""
    day = daily_stats(traded(ticks)).withColumn("range", F.col("high") - F.col("low")).filter((F.col("volume") >= least_volume) & (F.col("range") >= 1e-6))
    sums = directional_runs(ticks, most_share).groupBy("symbol", "date").agg(F.sum(F.sqrt("q") * F.col("dp")).alias("xy"), F.sum("q").alias("xx"), F.count(F.lit(1)).alias("runs"))
    terms = sums.join(day, ["symbol", "date"]).groupBy("symbol").agg(
        F.sum(F.col("xy") / (F.sqrt("volume") * F.col("range") + 1e-10)).alias("xy"), F.sum(F.col("xx") / (F.col("volume") + 1e-10)).alias("xx"), F.sum("runs").alias("runs"), F.count(F.lit(1)).alias("days")
    )
    raw = F.when(F.col("xx") >= 1e-10, F.col("xy") / F.col("xx"))
    fitted = terms.withColumn("raw", raw).withColumn("raw", F.when((F.col("raw") > low) & (F.col("raw") < high), F.col("raw")))
    middle = fitted.agg(F.coalesce(F.median("raw"), F.lit(default)).alias("_middle"))  # one row
    return fitted.join(F.broadcast(middle)).select("symbol", F.round(F.coalesce("raw", "_middle"), 6).alias("c"), F.col("raw").isNull().alias("is_default"), "runs", "days")


def with_friction(df: DataFrame, registry: DataFrame, default: float = DEFAULT_FRICTION) -> DataFrame:
    """df with c of its symbol, else the default."""
    return df.join(registry.select("symbol", "c"), "symbol", "left").withColumn("c", F.coalesce("c", F.lit(default)))


def with_implied_quantity(bars: DataFrame) -> DataFrame:
    return bars.withColumn("q_hat", implied_quantity(F.col("delta_p"), F.col("sigma_d"), F.col("v_d"), F.col("c")))


def clock_threshold(ticks: DataFrame, bars_a_day: int = 50, least: int = 1000, default: int = 50_000) -> DataFrame:
    """The median daily volume over the wanted bars a day, whole and `least` or more; the default without data."""
    middle = F.floor(F.median("volume") / bars_a_day)
    return daily_stats(ticks).agg(F.when(middle.isNull(), F.lit(default)).otherwise(F.greatest(middle, F.lit(least))).cast("long").alias("threshold"))


def bucketed(ticks: DataFrame, threshold: float) -> DataFrame:
    """Ticks with their volume bucket: cumulative volume of the symbol over the threshold, floored."""
    upto = F.sum("vol_tick").over(Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return ticks.withColumn("bucket", F.floor(upto / threshold))


def path_efficiency(ticks: DataFrame, threshold: float) -> DataFrame:
    """Per symbol and complete bucket of over one tick: net over total price movement, and idx in the symbol's order."""
    marked = bucketed(ticks, threshold)
    step = F.col("price") - F.lag("price").over(Window.partitionBy("symbol", "bucket").orderBy("seq"))
    sums = marked.withColumn("_d", step).groupBy("symbol", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("_d").alias("net"), F.sum(F.abs("_d")).alias("total"))
    last = F.max("bucket").over(Window.partitionBy("symbol"))
    whole = sums.withColumn("_last", last).filter((F.col("bucket") < F.col("_last")) & (F.col("n") > 1))
    idx = F.row_number().over(Window.partitionBy("symbol").orderBy("bucket")) - 1
    return whole.select("symbol", "bucket", (F.col("net") / (F.col("total") + 1e-8)).alias("efficiency"), idx.alias("idx"))


def autocorrelation(series: DataFrame, value: str = "efficiency", lags: int = 150, key: str = "symbol", idx: str = "idx") -> DataFrame:
    """Biased autocorrelation of each key's series at lags 0..lags; zeros if the series is constant. One shuffle: a key's series is an array in one task, by its places; a missing place or value adds nothing."""

    def correlate(rows: pd.DataFrame) -> pd.DataFrame:
        place, x = rows[idx].to_numpy("int64"), rows[value].to_numpy(float)
        known = np.isfinite(x)
        centred = np.zeros(place.max() - place.min() + 1)
        centred[place[known] - place.min()] = x[known] - (x[known].mean() if known.any() else 0.0)
        spread = (centred**2).sum() / max(known.sum(), 1)
        sums = np.array([(centred[: len(centred) - k] * centred[k:]).sum() if k < len(centred) else 0.0 for k in range(lags + 1)])
        acf = sums / (len(rows) * spread) if spread > 1e-300 else np.zeros(lags + 1)
        return pd.DataFrame({key: [rows[key].iloc[0]] * (lags + 1), "lag": np.arange(lags + 1, dtype=np.int32), "acf": acf})

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, idx, value).groupBy(key).applyInPandas(correlate, f"`{key}` {kind}, lag int, acf double")


def window_length(series: DataFrame, lags: int = 150, level: float = 0.05, least: int = 40, default: int = 160) -> DataFrame:
    """The median over symbols (series longer than `lags`) of the first lag whose autocorrelation is within the level, `least` or more."""
    long = series.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).filter(F.col("_n") > lags).drop("_n")
    first = autocorrelation(long, lags=lags).filter("lag >= 1").groupBy("symbol").agg(F.coalesce(F.min(F.when(F.abs("acf") < level, F.col("lag"))), F.lit(lags)).alias("drop"))
    middle = F.floor(F.median("drop"))
    return first.agg(F.when(middle.isNull(), F.lit(default)).otherwise(F.greatest(middle, F.lit(least))).cast("long").alias("window"))


