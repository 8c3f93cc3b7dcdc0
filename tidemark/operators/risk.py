"""Equity curves, trade statistics and scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GUARD = 1e-10


def equity_curve(returns: DataFrame, key: str = "config", date: str = "date", value: str = "ret") -> DataFrame:
    """Per key and date: nav after the date, drawdown from the running maximum of nav (from the first date's on). A return of -1 or less ends the curve at 0."""
    upto = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    dead = F.max((F.col(value) <= -1).cast("int")).over(upto) == 1
    nav = F.when(dead, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(F.col(value) > -1, F.log1p(value))).over(upto)))
    curve = returns.withColumn("nav", nav).withColumn("peak", F.max("nav").over(upto))
    return curve.withColumn("drawdown", F.coalesce(F.try_divide("nav", "peak"), F.lit(1.0)) - 1).drop("peak")


def risk_metrics(curve: DataFrame, key: str = "config", date: str = "date", value: str = "ret", days_a_year: int = 252) -> DataFrame:
    """Per key: days, total and annual return, Sharpe, Sortino, largest drawdown, its longest run of days, Calmar. Population deviations; Sortino is 0 without negative days, Calmar 0 without a drawdown."""
    own = Window.partitionBy(key).orderBy(date)
    under = (F.col("drawdown") < 0).cast("int")
    islands = curve.withColumn("_u", under).withColumn("_i", F.sum(1 - F.col("_u")).over(own))
    runs = islands.groupBy(key, "_i").agg(F.sum("_u").alias("_run")).groupBy(key).agg(F.max("_run").alias("underwater_days"))
    stats = curve.groupBy(key).agg(
        F.count(F.lit(1)).alias("days"), F.max_by("nav", date).alias("nav"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"), F.stddev_pop(F.when(F.col(value) < 0, F.col(value))).alias("_down"), F.min("drawdown").alias("max_drawdown")
    )
    annual = F.pow("nav", F.lit(float(days_a_year)) / F.col("days")) - 1
    root = F.sqrt(F.lit(float(days_a_year)))
    return stats.join(runs, key).select(
        key, "days", (F.col("nav") - 1).alias("total_return"), annual.alias("annual_return"), (F.col("_mean") / (F.col("_std") + GUARD) * root).alias("sharpe"), F.coalesce(F.col("_mean") / (F.col("_down") + GUARD) * root, F.lit(0.0)).alias("sortino"),
        "max_drawdown", "underwater_days", F.when(F.col("max_drawdown") != 0, annual / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"),
    )


def regime(curve: DataFrame, days: int = 20, fall: float = -0.05, key: str = "config", date: str = "date") -> DataFrame:
    """curve with bear: whether nav of the day before fell by over 5 per cent against that of `days` days before."""
    own = Window.partitionBy(key).orderBy(date)
    return curve.withColumn("bear", F.coalesce(F.try_divide(F.lag("nav", 1).over(own), F.lag("nav", days).over(own)) - 1 < fall, F.lit(False)))


def trade_stats(trades: DataFrame, pnl: str = "pnl_bp") -> DataFrame:
    """n, win rate, mean win, mean absolute loss (1 if there is none), asymmetry and profit factor (infinite without losses). A pnl of 0 is neither."""
    x = F.col(pnl)
    won, lost = F.when(x > 0, x), F.when(x < 0, -x)
    sums = trades.agg(F.count(x).alias("n"), F.coalesce(F.avg((x > 0).cast("double")), F.lit(0.0)).alias("win_rate"), F.coalesce(F.avg(won), F.lit(0.0)).alias("mean_win"), F.coalesce(F.avg(lost), F.lit(1.0)).alias("mean_loss"),
                      F.coalesce(F.sum(won), F.lit(0.0)).alias("_won"), F.sum(lost).alias("_lost"))
    return sums.select("n", "win_rate", "mean_win", "mean_loss", (F.col("mean_win") / F.col("mean_loss")).alias("asymmetry"), F.coalesce(F.col("_won") / (F.col("_lost") + GUARD), F.lit(float("inf"))).alias("profit_factor"))


def break_even(trades: DataFrame, cost: float = 25.0, most: int = 100, pnl: str = "pnl_bp") -> DataFrame:
    """The smallest whole cost from `cost` on, under `most`, at which the sum of pnl, made for `cost`, is no longer positive; else `most`: from sum and count."""
    sums = trades.agg(F.sum(pnl).alias("s"), F.count(pnl).alias("n"))
    at = F.greatest(F.ceil(F.col("s") / F.nullif("n", F.lit(0)) + cost), F.lit(int(cost)))
    return sums.select(F.when(F.col("n") == 0, F.lit(int(cost))).otherwise(F.least(at, F.lit(most))).cast("long").alias("break_even"))


def exit_reasons(trades: DataFrame) -> DataFrame:
    return trades.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("n"), F.avg("pnl_bp").alias("mean_pnl"))


def scorecard(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """Per metric: value, target, comparator (ge, gt, le, lt) and whether it is met; metrics without a value are not met."""
    v, t = F.col("value"), F.col("target")
    met = F.when(F.col("comparator") == "ge", v >= t).when(F.col("comparator") == "gt", v > t).when(F.col("comparator") == "le", v <= t).when(F.col("comparator") == "lt", v < t)
    return targets.join(metrics, "metric", "left").select("metric", "value", "target", "comparator", F.coalesce(met, F.lit(False)).alias("met"))


def verdict(stats: DataFrame) -> DataFrame:
    """asymmetry, profit_factor and verdict of trade stats: PASS over 3 and 1.5, CONDITIONAL over 2 and 1.2, else FAIL."""
    over = lambda a, b: (F.col("asymmetry") > a) & (F.col("profit_factor") > b)
    return stats.select("asymmetry", "profit_factor", F.when(over(3.0, 1.5), F.lit("PASS")).when(over(2.0, 1.2), F.lit("CONDITIONAL")).otherwise(F.lit("FAIL")).alias("verdict"))


def sweep_deltas(results: DataFrame, factors: list[str], factor: str, value: str) -> DataFrame:
    """Per setting of the other factors: the value with the factor on (1) less that with it off (0)."""
    others = [f for f in factors if f != factor]
    side = lambda x, name: results.filter(F.col(factor) == x).select(*others, F.col(value).alias(name))
    return side(1, "on").join(side(0, "off"), others).select(*others, F.lit(factor).alias("factor"), (F.col("on") - F.col("off")).alias("delta"))
