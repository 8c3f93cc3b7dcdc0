"""Daily gates, top-N selection and trade outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.book import daily_limit_bp, is_locked


def gated(predictions: DataFrame, boards: tuple[str, ...] = (), cap: float = 0.0, sparsity_percentile: float | None = None, conviction: float | None = None, least_volume: float = 0.0) -> DataFrame:
    """predictions with gate: the first gate that stops the row, in order board, cap, sparsity, locked, conviction, volume; NULL if it passes."""
    days = predictions.groupBy("date").agg(F.percentile("z_sparsity", (sparsity_percentile or 0.0) / 100).alias("_z"), F.median("pred_bp").alias("_median"))
    on = F.lit(False)
    for b in boards:
        on = on | F.startswith(F.col("symbol"), F.lit(b))
    no = F.lit(False)
    gates = [
        ("board", on), ("cap", F.abs("pred_bp") > cap if cap > 0 else no), ("sparsity", F.col("z_sparsity") < F.col("_z") if sparsity_percentile is not None else no), ("locked", is_locked(F.col("bid_p1"), F.col("ask_p1"))),
        ("conviction", F.col("pred_bp") < F.col("_median") + conviction if conviction is not None else no), ("volume", F.col("macro_v_d") < least_volume),
    ]
    gate = F.lit(None).cast("string")
    for name, stops in reversed(gates):
        gate = F.when(stops, F.lit(name)).otherwise(gate)
    return predictions.join(days, "date").withColumn("gate", gate).drop("_z", "_median")


def gate_counts(with_gate: DataFrame) -> DataFrame:
    return with_gate.groupBy(F.coalesce("gate", F.lit("passed")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def one_of_each_symbol(predictions: DataFrame, order: list[str], last: bool = False) -> DataFrame:
    """One row of each symbol and date: the best prediction, or the last row in order."""
    first = [F.desc(c) for c in order] if last else [F.desc("pred_bp"), *order]
    return predictions.withColumn("_r", F.row_number().over(Window.partitionBy("symbol", "date").orderBy(*first))).filter("_r = 1").drop("_r")


def daily_top(candidates: DataFrame, order: list[str], percentile: float = 0.8, most: int = 50) -> DataFrame:
    """Per date the rows of highest prediction: those over the percentile, n * (1 - percentile) of n rows, rounded down in double precision, one at least and `most` at most."""
    day = Window.partitionBy("date")
    wanted = F.least(F.greatest(F.floor(F.count(F.lit(1)).over(day) * F.lit(1 - percentile)), F.lit(1)), F.lit(most))
    ranked = candidates.withColumn("rank", F.row_number().over(day.orderBy(F.desc("pred_bp"), *order))).withColumn("_wanted", wanted)
    return ranked.filter(F.col("rank") <= F.col("_wanted")).drop("_wanted")


def calendar(predictions: DataFrame) -> DataFrame:
    """(date, day): the dates numbered from 0."""
    return predictions.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")) - 1)  # one row for each date


def exits(entries: DataFrame, predictions: DataFrame, order: list[str]) -> DataFrame:
    """entries (symbol, date, pred_bp, target_bp) with exit_date and hold_days.

    The exit is the next date, except that an entry with a negative target waits while the symbol's book is locked (its last row of a date
    counts; a date without a row doesn't wait). Entries that find no exit stay open: NULL.
    """
    days = calendar(predictions)
    last = one_of_each_symbol(predictions, order, last=True).select("symbol", "date", is_locked(F.col("bid_p1"), F.col("ask_p1")).alias("locked")).join(days, "date").filter("locked").select("symbol", "day")
    # islands of consecutive locked days, each with the day after it
    island = F.col("day") - F.row_number().over(Window.partitionBy("symbol").orderBy("day"))
    after = last.withColumn("_i", island).withColumn("free", F.max("day").over(Window.partitionBy("symbol", "_i")) + 1).select("symbol", F.col("day").alias("wanted"), "free")
    placed = entries.join(days, "date").withColumn("wanted", F.col("day") + 1)
    waits = placed.join(after, ["symbol", "wanted"], "left")
    out = F.when((F.col("target_bp") < 0) & F.col("free").isNotNull(), F.col("free")).otherwise(F.col("wanted"))
    named = days.select(F.col("day").alias("exit_day"), F.col("date").alias("exit_date"))
    found = waits.withColumn("exit_day", out).join(named, "exit_day", "left")
    return found.withColumn("hold_days", F.when(F.col("exit_date").isNotNull(), F.col("exit_day") - F.col("day"))).drop("day", "wanted", "free", "exit_day")


def trade_outcomes(trades: DataFrame, half_cost: float = 12.5, stop_bp: float = -1000.0, board_cap: bool = True) -> DataFrame:
    """trades with capped_bp (no loss over the board's daily limit for each day held), pnl_bp after half the cost, and exit_reason; the stop labels only."""
    floor = -daily_limit_bp(F.col("symbol")) * F.greatest(F.col("hold_days"), F.lit(1))
    capped = F.greatest(F.col("target_bp"), floor.cast("double")) if board_cap else F.col("target_bp")
    reason = F.when((F.col("target_bp") < stop_bp) | (F.col("capped_bp") < stop_bp), F.lit("trailing_stop")).otherwise(F.lit("natural_horizon"))
    return trades.withColumn("capped_bp", capped).withColumn("pnl_bp", F.col("capped_bp") - half_cost).withColumn("exit_reason", reason)


def overlap(top: DataFrame, days: DataFrame) -> DataFrame:
    """Per date: the share of the next date's selected symbols that were selected on it."""
    chosen = top.select("symbol", "date").distinct().join(days, "date").select("symbol", "day")
    sizes = chosen.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    kept = chosen.join(chosen.select("symbol", (F.col("day") - 1).alias("day")), ["symbol", "day"]).groupBy("day").agg(F.count(F.lit(1)).alias("kept"))
    later = sizes.select((F.col("day") - 1).alias("day"), F.col("n").alias("next_n"))
    return sizes.join(later, "day").join(kept, "day", "left").join(days, "day").select("date", (F.coalesce("kept", F.lit(0)) / F.col("next_n")).alias("overlap"))
