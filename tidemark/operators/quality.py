"""Data-quality checks, each one aggregation pass over a whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.book import CHANNELS, is_bad_number


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("int")), F.lit(0))


def _checks(stats: DataFrame, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """One row of each check (name, severity, value, met) from a one-row table of statistics."""
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), value.cast("double").alias("value"), F.coalesce(met, F.lit(False)).alias("met")) for name, severity, value, met in checks])
    return stats.select(F.inline(rows)).withColumn("status", F.when(F.col("met"), F.lit("PASS")).otherwise(F.col("severity")))


def check_ticks(ticks: DataFrame, levels: int = 10, most_price: float = 1e7) -> DataFrame:
    """Numbers, price and depth ranges, and crossed quotes of a tick table."""
    prices, depths = [f"{s}_p{i}" for s in ("bid", "ask") for i in range(1, levels + 1)], [f"{s}_v{i}" for s in ("bid", "ask") for i in range(1, levels + 1)]
    bad = reduce(lambda a, b: a + b, [F.coalesce(is_bad_number(F.col(c)), F.lit(False)).cast("int") for c in [*prices, *depths, "price", "vol_tick"]])
    pairs = [(F.col(f"bid_p{i}"), F.col(f"ask_p{i}")) for i in range(1, levels + 1)]
    quoted = reduce(lambda a, b: a + b, [((b > 0) & (a > 0)).cast("int") for b, a in pairs])
    crossed = reduce(lambda a, b: a + b, [((b > 0) & (a > 0) & (a < b)).cast("int") for b, a in pairs])
    s = ticks.agg(
        F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad"), F.min(F.least(*[F.nullif(F.col(c), F.lit(0.0)) for c in prices])).alias("low"), F.max(F.greatest(*prices)).alias("high"), F.min(F.least(*depths)).alias("depth"),
        F.sum(quoted).alias("quoted"), F.sum(crossed).alias("crossed"), F.bool_or(F.col("price") != 0).alias("moves"), F.sum((F.col("date").isNull() | (F.col("date") == "")).cast("int")).alias("undated"), F.countDistinct("symbol").alias("symbols"),
    )
    c = F.col
    return _checks(s, [
        ("rows", "STOP", c("n"), c("n") > 0), ("finite numbers", "STOP", c("bad"), c("bad") == 0), ("prices over 0", "STOP", c("low"), c("low") > 0), ("prices in range", "STOP", c("high"), c("high") < most_price),
        ("depths not negative", "STOP", c("depth"), c("depth") >= 0), ("quotes not crossed", "WARNING", F.try_divide(c("crossed"), c("quoted")), c("crossed") == 0), ("prices not all 0", "STOP", c("moves").cast("int"), c("moves")),
        ("dates present", "STOP", c("undated"), c("undated") == 0), ("symbols", "WARNING", c("symbols"), c("symbols") > 1),
    ])


def check_bars(bars: DataFrame, length: int | None = None) -> DataFrame:
    """Price moves, vwap, volume and range columns of bars: delta_p, vwap, v_d, sigma_d."""
    s = bars.agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta_p").alias("mean_dp"), F.bool_or(F.col("delta_p") != 0).alias("moves"), F.avg("v_d").alias("v"), F.stddev_pop("v_d").alias("v_std"), F.avg("sigma_d").alias("s"), F.stddev_pop("sigma_d").alias("s_std"),
        F.sum(F.coalesce(is_bad_number(F.col("vwap")), F.lit(True)).cast("int")).alias("bad"),
    )
    c = F.col
    return _checks(s, [
        ("rows", "STOP", c("n"), c("n") > 0), ("finite vwap", "STOP", c("bad"), c("bad") == 0), ("moves not all 0", "STOP", c("moves").cast("int"), c("moves")), ("mean move under 100", "WARNING", c("mean_dp"), F.abs("mean_dp") < 100),
        ("volume over 0", "STOP", c("v"), c("v") > 0), ("volume varies", "WARNING", c("v_std"), c("v_std") > 0), ("range over 0", "STOP", c("s"), c("s") > 0), ("range varies", "WARNING", c("s_std"), c("s_std") > 0),
    ])


def check_windows(windows: DataFrame, length: int) -> DataFrame:
    """Shape and target of window samples: bars (array), target_bp."""
    t = F.col("target_bp")
    s = windows.agg(
        F.count(F.lit(1)).alias("n"), _count(F.size("bars") != length).alias("misshapen"), F.max(F.abs(t)).alias("largest"), F.bool_or(t != 0).alias("any"), F.bool_or(t > 0).alias("up"), F.bool_or(t < 0).alias("down"), F.avg(t).alias("mean"), F.avg((t != 0).cast("double")).alias("share")
    )
    c = F.col
    return _checks(s, [
        ("rows", "STOP", c("n"), c("n") > 0), ("bars in each", "STOP", c("misshapen"), c("misshapen") == 0), ("target under 5000", "WARNING", c("largest"), c("largest") < 5000), ("target not all 0", "STOP", c("any").cast("int"), c("any")),
        ("both signs", "STOP", (c("up") & c("down")).cast("int"), c("up") & c("down")), ("mean target under 50", "WARNING", c("mean"), F.abs("mean") < 50), ("half not 0", "WARNING", c("share"), c("share") >= 0.5),
    ])


def check_tensors(samples: DataFrame, shape: tuple[int, int, int] = (160, 10, 10), tensor: str = "tensor", most_price: float = 1e7) -> DataFrame:
    """Shape, type, numbers, quotes and channels of sample tensors (bars x levels x channels), over all samples in one pass."""
    t, at = F.col(tensor), CHANNELS.index
    misshapen = t.isNull() | (F.size(t) != shape[0]) | F.exists(t, lambda bar: (F.size(bar) != shape[1]) | F.exists(bar, lambda level: F.size(level) != shape[2]))
    channel = lambda level, name: F.get(level, F.lit(at(name))).cast("double")
    levels = F.flatten(t)
    bad = F.size(F.filter(F.flatten(levels), lambda x: x.isNull() | is_bad_number(x)))
    sound = lambda p: (p > 0) & ~is_bad_number(p)
    bids = F.filter(F.transform(levels, lambda x: channel(x, "bid_p")), lambda b: sound(b))
    depths = F.concat(F.transform(levels, lambda x: channel(x, "bid_v")), F.transform(levels, lambda x: channel(x, "ask_v")))
    quoted = F.filter(levels, lambda x: sound(channel(x, "bid_p")) & sound(channel(x, "ask_p")))
    crossed = F.size(F.filter(quoted, lambda x: channel(x, "ask_p") < channel(x, "bid_p")))
    reserved = [i for i, name in enumerate(CHANNELS) if name is None]
    used = F.exists(levels, lambda x: reduce(lambda a, i: a | (F.get(x, F.lit(i)) != 0), reserved, F.lit(False)))
    s = samples.agg(
        F.count(F.lit(1)).alias("n"), _count(misshapen).alias("misshapen"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"), F.min(F.array_min(bids)).alias("low"), F.max(F.array_max(bids)).alias("high"), F.min(F.array_min(depths)).alias("depth"),
        F.coalesce(F.sum(F.greatest(F.lit(0), crossed)), F.lit(0)).alias("crossed"), _count(~F.exists(levels, lambda x: channel(x, "close") != 0)).alias("still"), _count(F.coalesce(used, F.lit(False))).alias("used"),
    )
    kind = samples.schema[tensor].dataType.simpleString() == "array<array<array<float>>>"
    c = F.col
    return _checks(s, [
        ("rows", "STOP", c("n"), c("n") > 0), ("shape", "STOP", c("misshapen"), c("misshapen") == 0), ("dtype", "STOP", F.lit(int(kind)), F.lit(kind)), ("finite", "STOP", c("bad"), c("bad") == 0), ("bids over 0", "WARNING", c("low"), c("low") > 0),
        ("bids in range", "WARNING", c("high"), c("high") < most_price), ("depths not negative", "STOP", c("depth"), c("depth") >= 0), ("quotes not crossed", "WARNING", c("crossed"), c("crossed") == 0), ("close not all 0", "WARNING", c("still"), c("still") == 0),
        ("reserved all 0", "STOP", c("used"), c("used") == 0),
    ])


def check_friction(registry: DataFrame) -> DataFrame:
    """Coefficients have six decimals, so that many lie on an edge of four: the scaled double is rounded, as SQL does, not its shortest decimal text."""
    four = F.round(F.col("c") * 1e4) / 1e4
    s = registry.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.countDistinct(four).alias("values"))
    c = F.col
    return _checks(s, [("rows", "STOP", c("n"), c("n") > 0), ("c over 0.05", "STOP", c("low"), c("low") >= 0.05), ("c under 10", "STOP", c("high"), c("high") <= 10), ("c varies", "WARNING", c("values"), c("values") > 1)])


def check_density(rows: DataFrame, key: str = "symbol", most: float = 10.0) -> DataFrame:
    """Whether the largest group is under `most` times the smallest plus one."""
    s = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / (F.min("n") + 1)).alias("ratio"))
    return _checks(s, [("density", "WARNING", F.col("ratio"), F.col("ratio") < most)])


def check_predictions(predictions: DataFrame, least: int = 1000, low: float = 5.0, high: float = 500.0, columns: tuple[str, ...] = ("symbol", "date", "pred_bp", "target_bp")) -> DataFrame:
    missing = [c for c in columns if c not in predictions.columns]
    p = F.col("pred_bp") if "pred_bp" in predictions.columns else F.lit(None).cast("double")
    s = predictions.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(p).alias("std"), _count(F.coalesce(is_bad_number(p), F.lit(True))).alias("bad"))
    c = F.col
    return _checks(s, [
        ("columns missing", "STOP", F.lit(len(missing)), F.lit(not missing)), ("rows", "STOP", c("n"), c("n") >= least), ("deviation in band", "STOP", c("std"), (c("std") > low) & (c("std") < high)), ("finite", "STOP", c("bad"), c("bad") == 0),
    ])


def check_files(listing: DataFrame, least_files: int = 1, small: int = 1_000_000) -> DataFrame:
    """Count and sizes of files: path, length."""
    s = listing.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), F.avg("length").alias("mean"), F.min("length").alias("low"), _count(F.col("length") < small).alias("small"), _count(F.col("length") == 0).alias("empty"))
    c = F.col
    return _checks(s, [("files", "STOP", c("n"), c("n") >= least_files), ("no empty file", "STOP", c("empty"), c("empty") == 0), ("small files", "WARNING", c("small"), c("small") == 0), ("total size", "STOP", c("total"), c("total") > 0)])


def coverage(ticks: DataFrame) -> DataFrame:
    """Rows, first and last date, symbols and rows without a date."""
    return ticks.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("symbol").alias("symbols"), _count(F.col("date").isNull()).alias("undated"))


def batch_targets(samples: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Per batch: share of targets that are not 0, and whether it is half or more."""
    return samples.groupBy(key).agg(F.avg((F.col("target_bp") != 0).cast("double")).alias("share")).withColumn("met", F.col("share") >= least)


def rolled_up(checks: DataFrame) -> DataFrame:
    """Checks by status, and the verdict: STOP if any stops, WARNING if any warns, else PASS."""
    level = F.when(F.col("status") == "STOP", 3).when(F.col("status") == "WARNING", 2).otherwise(1)
    worst = Window.partitionBy(F.lit(1))  # over three rows
    counts = checks.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("_worst", F.max(level).over(worst))
    return counts.select("status", "n", F.when(F.col("_worst") == 3, F.lit("STOP")).when(F.col("_worst") == 2, F.lit("WARNING")).otherwise(F.lit("PASS")).alias("verdict"))
