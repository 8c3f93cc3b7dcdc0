"""Judging predictions: correlations, deciles, calibration and their daily series.

All take a table of predictions; `pred` and `target` name its columns, in basis points. NULL predictions or targets are left out where
a statistic needs both. A correlation over a constant column is NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import counted_values, quantiles, with_average_rank, with_average_rank_by
from tidemark.functions.stats import safe_corr

DECILE_SHARES = [i / 10 for i in range(1, 10)]
INFINITE = float("inf")
TIE = 1e-9  # means that differ by less are equal: their sums vary with the partitioning


def _both(predictions: DataFrame, pred: str, target: str) -> DataFrame:
    return predictions.filter(F.col(pred).isNotNull() & F.col(target).isNotNull())


def of_large_dates(rows: DataFrame, min_rows: int) -> DataFrame:
    """Rows of dates that have so many. Dates are counted apart, so that no task holds those of one."""
    return rows.join(F.broadcast(rows.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).select("date")), "date", "left_semi")


def global_ic(predictions: DataFrame, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """n, ic, r2, rank_ic, and the t and large-sample z statistics of rank_ic, over all rows."""
    ranked = with_average_rank(with_average_rank(_both(predictions, pred, target).select(pred, target), pred, "pr"), target, "tr")
    stats = ranked.agg(F.count(F.lit(1)).alias("n"), safe_corr(pred, target).alias("ic"), safe_corr("pr", "tr").alias("rank_ic"))
    r, n = F.col("rank_ic"), F.col("n")
    return stats.select("n", "ic", (F.col("ic") * F.col("ic")).alias("r2"), "rank_ic", (r * F.sqrt((n - 2) / (1 - r * r))).alias("t_stat"), (r * F.sqrt(n)).alias("z_stat"))


def keyed_ic(predictions: DataFrame, keys: list[str], min_rows: int = 2, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """n, ic and rank_ic of each key; groups under `min_rows` rows are left out."""
    rows = _both(predictions, pred, target).select(*keys, pred, target)
    ranked = with_average_rank_by(with_average_rank_by(rows, keys, pred, "pr"), keys, target, "tr")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr(pred, target).alias("ic"), safe_corr("pr", "tr").alias("rank_ic")).filter(F.col("n") >= min_rows)


def daily_ic(predictions: DataFrame, min_rows: int = 50, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per date: rows, Pearson and rank correlation of prediction and target; only dates of `min_rows` rows or more."""
    return keyed_ic(predictions, ["date"], min_rows, pred, target)


def distribution_profile(df: DataFrame, column: str) -> DataFrame:
    """n, mean, population deviation, median, skewness, excess kurtosis, extremes, percentiles and mean over deviation of one column."""
    shares = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    cuts = [F.lit(v).alias(k) for k, v in zip(shares, quantiles(df, column, list(shares.values())))]
    stats = df.filter(F.col(column).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurtosis"),
        F.min(column).alias("min"), F.max(column).alias("max"), F.try_divide(F.avg(column), F.nullif(F.stddev_pop(column), F.lit(0.0))).alias("mean_over_std"),
    )
    return stats.select("*", *cuts)


def _edge_deciles(pred: Column, edges: Column | list) -> Column:
    """Deciles 1..10 by percentile edges; a value that ties with an edge may fall in two."""
    edge = (lambda i: F.get(edges, F.lit(i))) if isinstance(edges, Column) else (lambda i: F.lit(edges[i]))
    inside = [F.when(pred <= edge(0), F.lit(1))] + [F.when((pred > edge(i - 2)) & (pred <= edge(i - 1)), F.lit(i)) for i in range(2, 10)] + [F.when(pred >= edge(8), F.lit(10))]
    return F.array_compact(F.array(*inside))


def decile_table(predictions: DataFrame, cost: float = 25.0, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per percentile-edge decile: n, mean prediction and target, hit rate, mean win, mean absolute loss, payoff (infinite without losses), mean net of cost."""
    rows = _both(predictions, pred, target)
    edges = quantiles(rows, pred, DECILE_SHARES)
    if edges[0] is None:
        edges = [0.0] * 9
    actual = F.col(target)
    table = rows.select(pred, target, F.explode(_edge_deciles(F.col(pred), edges)).alias("decile")).groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(pred).alias("mean_pred"), F.avg(target).alias("mean_actual"), F.avg((actual > 0).cast("double")).alias("hit_rate"),
        F.coalesce(F.avg(F.when(actual > 0, actual)), F.lit(0.0)).alias("mean_win"), F.coalesce(F.avg(F.when(actual < 0, -actual)), F.lit(0.0)).alias("mean_loss"),
    )
    payoff = F.when(F.col("mean_loss") > 0, F.col("mean_win") / F.col("mean_loss")).otherwise(F.lit(INFINITE))
    return table.withColumn("payoff", payoff).withColumn("mean_net", F.col("mean_actual") - cost)


def decile_spread(table: DataFrame) -> DataFrame:
    """From a decile table: top and bottom mean, long-short spread, number of rises among the nine steps, and a verdict on the top decile's net mean."""
    by = Window.orderBy("decile")  # ten rows
    steps = table.withColumn("rises", (F.lead("mean_actual").over(by) - F.col("mean_actual") > TIE).cast("int"))
    top, bottom = F.max(F.when(F.col("decile") == 10, F.col("mean_actual"))), F.max(F.when(F.col("decile") == 1, F.col("mean_actual")))
    net = F.max(F.when(F.col("decile") == 10, F.col("mean_net")))
    return steps.agg(top.alias("top"), bottom.alias("bottom"), (top - bottom).alias("spread"), F.sum("rises").alias("rises"), net.alias("net")).withColumn(
        "verdict", F.when(F.col("net") > 5, F.lit("strong")).when(F.col("net") > 0, F.lit("pass")).otherwise(F.lit("fail"))
    )


def cut_deciles(df: DataFrame, column: str, name: str = "decile", parts: int = 10) -> DataFrame:
    """df with quantile-cut buckets from 0: the number of distinct inner edges under the value; equal edges fall together."""
    cuts = quantiles(df, column, [i / parts for i in range(parts + 1)])
    edges = sorted(set(cuts)) if cuts[0] is not None else []
    inner = edges[1:-1]
    bucket = reduce(lambda total, e: total + F.when(F.col(column) > e, F.lit(1)).otherwise(F.lit(0)), inner, F.lit(0))
    return df.withColumn(name, bucket)


def cut_by_date(df: DataFrame, column: str, name: str = "decile", parts: int = 10) -> DataFrame:
    """The same within each date."""
    edges = df.groupBy("date").agg(F.array_sort(F.array_distinct(F.percentile(column, [i / parts for i in range(parts + 1)]))).alias("_edges"))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    return df.join(F.broadcast(edges), "date").withColumn(name, F.size(F.filter(inner, lambda e: e < F.col(column)))).drop("_edges")


def decile_report(predictions: DataFrame, by: str = "pred_bp", pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per quantile-cut decile of `by`: n, means, absolute prediction, correlation within it (over two rows), and LOW or HIGH for the outer ones."""
    cut = cut_deciles(_both(predictions, pred, target).filter(F.col(by).isNotNull()), by)
    table = cut.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(by).alias("mean_by"), F.avg(target).alias("mean_target"), F.avg(F.abs(pred)).alias("mean_abs_pred"), F.when(F.count(F.lit(1)) > 2, safe_corr(pred, target)).alias("ic")
    )
    return table.withColumn("tag", F.when(F.col("decile") == 0, F.lit("LOW")).when(F.col("decile") == 9, F.lit("HIGH")))


def _thresholds(ratio: Column, cost: float, otherwise: float) -> tuple[Column, Column]:
    """The deviation that a ratio of spread and deviation turns into a cost, and into twice the cost; a ratio that isn't positive has none."""
    return tuple(F.when(ratio > 0, c / ratio).otherwise(F.lit(otherwise)) for c in (cost, 2 * cost))


def spread_calibration(predictions: DataFrame, cost: float = 25.0, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Decile spread over the population deviation of predictions, and the deviations needed for a cost and twice as much (0 if the ratio isn't positive)."""
    spread = decile_spread(decile_table(predictions, pred=pred, target=target)).select("spread")
    stats = spread.crossJoin(_both(predictions, pred, target).agg(F.stddev_pop(pred).alias("std_pop"), F.stddev_samp(pred).alias("std_samp")))  # one row with one row
    ratio = F.coalesce(F.try_divide(F.col("spread"), F.nullif("std_pop", F.lit(0.0))), F.lit(0.0))
    needed, safe = _thresholds(F.col("ratio"), cost, 0.0)
    return stats.withColumn("ratio", ratio).select("spread", "std_pop", "std_samp", "ratio", needed.alias("cost_threshold"), safe.alias("safe_threshold"))


def outer_spread(predictions: DataFrame, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """One row: mean target of the last bucket less that of the first, by quantile cut; equal edges fall together."""
    means = cut_deciles(_both(predictions, pred, target), pred).groupBy("decile").agg(F.avg(target).alias("mean"))
    return means.agg((F.max_by("mean", "decile") - F.min_by("mean", "decile")).alias("spread"))


def sentinel(predictions: DataFrame, cost: float = 25.0, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Quantile-cut spread (last bucket less first) over the sample deviation, whether the spread covers the cost, and the deviations at which to
    raise an error (a third of the threshold for the cost), to warn (the threshold) and to be content (twice the threshold)."""
    stats = outer_spread(predictions, pred, target).crossJoin(_both(predictions, pred, target).agg(F.stddev_samp(pred).alias("std")))  # one row with one row
    ratio = F.when(F.col("std") > 0, F.col("spread") / F.col("std")).otherwise(0.0)
    warn, healthy = _thresholds(F.col("ratio"), cost, float("inf"))
    return stats.withColumn("ratio", ratio).select("spread", "std", "ratio", (warn / 3).alias("error"), warn.alias("warn"), healthy.alias("healthy"), F.coalesce(F.col("spread") > cost, F.lit(False)).alias("covered"))


def key_correlations(predictions: DataFrame, z: str = "z_sparsity", pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Correlations of prediction and target with each other, and of the sparsity with prediction, absolute prediction and target."""
    rows = predictions.withColumn("_abs", F.abs(pred))
    return rows.agg(safe_corr(pred, target).alias("pred_target"), safe_corr(z, pred).alias("z_pred"), safe_corr(z, "_abs").alias("z_abs_pred"), safe_corr(z, target).alias("z_target"))


def daily_cross_section(predictions: DataFrame, min_rows: int = 50, parts: int = 10, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per date of enough rows: n, ic, rank_ic, top less bottom bucket (quantile-cut) and the share of rising steps between buckets."""
    rows = of_large_dates(_both(predictions, pred, target), min_rows)
    buckets = cut_by_date(rows, pred, parts=parts).groupBy("date", "decile").agg(F.avg(target).alias("mean"))
    along = Window.partitionBy("date").orderBy("decile")
    steps = buckets.withColumn("rise", (F.lead("mean").over(along) - F.col("mean") > TIE).cast("double"))
    shape = steps.groupBy("date").agg((F.max_by("mean", "decile") - F.min_by("mean", "decile")).alias("spread"), F.avg("rise").alias("monotonicity"))
    return daily_ic(rows, min_rows, pred, target).join(shape, "date")


def series_summary(daily: DataFrame, columns: list[str], epsilon: float = 1e-8) -> DataFrame:
    """Per named daily series: days, mean, population deviation, t, information ratio and share of positive days."""
    long = daily.select("date", F.expr(f"stack({len(columns)}, {', '.join(f"'{c}', cast({c} as double)" for c in columns)}) as (series, x)")).filter("x is not null")
    stats = long.groupBy("series").agg(F.count(F.lit(1)).alias("days"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.avg((F.col("x") > 0).cast("double")).alias("positive"))
    return stats.select("series", "days", "mean", "std", (F.col("mean") / (F.col("std") / F.sqrt("days") + epsilon)).alias("t"), (F.col("mean") / (F.col("std") + epsilon)).alias("icir"), "positive")


def global_against_daily(predictions: DataFrame, min_rows: int = 50, cost: float = 25.0) -> DataFrame:
    """Correlation, rank correlation and outer spread, pooled and as means over dates, with a verdict on the daily spread and a remark on the pooled one."""
    pooled = global_ic(predictions).select(F.col("ic").alias("pooled_ic"), F.col("rank_ic").alias("pooled_rank_ic")).crossJoin(outer_spread(predictions).select(F.col("spread").alias("pooled_spread")))  # one row each
    daily = daily_cross_section(predictions, min_rows).agg(*[F.avg(c).alias(f"daily_{c}") for c in ("ic", "rank_ic", "spread")])
    spread = F.col("daily_spread")
    kind = F.when(spread.isNull(), F.lit("INSUFFICIENT")).when(spread > cost, F.lit("TRADEABLE")).when(spread > 5, F.lit("MARGINAL")).when(spread > 0, F.lit("WEAK POSITIVE")).otherwise(F.lit("NEGATIVE"))
    remark = F.when((spread > 0) & (F.col("pooled_spread") <= 0), F.lit("HIDDEN")).when((spread <= 0) & (F.col("pooled_spread") <= 0), F.lit("ABSENT"))
    return pooled.crossJoin(daily).withColumn("verdict", kind).withColumn("remark", remark)  # one row with one row


def daily_edge_deciles(predictions: DataFrame, min_rows: int = 100, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per decile: the mean over dates (of enough rows) of the date's mean target, deciles by the date's percentile edges."""
    rows = of_large_dates(_both(predictions, pred, target), min_rows)
    edges = rows.groupBy("date").agg(F.percentile(pred, DECILE_SHARES).alias("_edges"))
    cut = rows.join(F.broadcast(edges), "date").select("date", pred, target, F.explode(_edge_deciles(F.col(pred), F.col("_edges"))).alias("decile"))
    return cut.groupBy("date", "decile").agg(F.avg(target).alias("m")).groupBy("decile").agg(F.count(F.lit(1)).alias("dates"), F.avg("m").alias("mean_target"))


def daily_decile_scores(predictions: DataFrame, min_rows: int = 100, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Over dates (of enough rows): how many, the mean number of rises among the nine steps between a date's decile means, the share of dates with five or more, and the mean top less the mean bottom decile.

    Deciles are cut by the date's percentile edges; an empty one counts as zero.
    """
    rows = of_large_dates(_both(predictions, pred, target), min_rows)
    edges = rows.groupBy("date").agg(F.percentile(pred, DECILE_SHARES).alias("_edges"))
    own = rows.join(F.broadcast(edges), "date").withColumn("_own", _edge_deciles(F.col(pred), F.col("_edges")))
    means = [F.coalesce(F.avg(F.when(F.array_contains("_own", d), F.col(target))), F.lit(0.0)).alias(f"_d{d}") for d in range(1, 11)]
    rises = reduce(lambda a, d: a + (F.col(f"_d{d}") < F.col(f"_d{d + 1}")).cast("int"), range(1, 10), F.lit(0))
    daily = own.groupBy("date").agg(*means).withColumn("_rises", rises)
    return daily.agg(F.count(F.lit(1)).alias("dates"), F.avg("_rises").alias("monotonicity"), F.avg((F.col("_rises") >= 5).cast("double")).alias("share_5"), (F.avg("_d10") - F.avg("_d1")).alias("long_short"))


def split_ic(predictions: DataFrame, first_out: int = 1594, order: list[str] | None = None) -> DataFrame:
    """Mean daily correlation in and out of sample; a date is in sample if its first row's shard is under `first_out`."""
    first = predictions.groupBy("date").agg(F.min_by("shard_idx", F.struct(*(order or ["symbol"]))).alias("shard"))
    joined = daily_ic(predictions, 10).join(first, "date")
    part = F.when(F.col("shard") < first_out, F.lit("in")).otherwise(F.lit("out"))
    return joined.groupBy(part.alias("part")).agg(F.count("ic").alias("dates"), F.avg("ic").alias("ic"))


def guarded_ic(predictions: DataFrame, key: str, epsilon: float = 1e-8, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per batch: covariance over the product of deviations, both under the root with an epsilon; 0 under two rows."""
    ratio = F.covar_pop(pred, target) / (F.sqrt(F.var_pop(pred) + epsilon) * F.sqrt(F.var_pop(target) + epsilon))
    return _both(predictions, pred, target).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(ratio).alias("ic"))


def loss_metrics(scored: DataFrame, z: str, weight: float = 1e-4, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Fraction of variance unexplained (1 on a near constant target), two-part description length, and the clipped sparse loss."""
    error = F.pow(F.col(pred) - F.col(target), 2)
    norm = F.aggregate(F.col(z), F.lit(0.0), lambda a, x: a + F.abs(x).cast("double"))
    clipped = F.aggregate(F.col(z), F.lit(0.0), lambda a, x: a + F.least(F.abs(x).cast("double"), F.lit(20.0)))
    wanted = F.when(F.col(target) < 0, F.col(target) * 0.1).otherwise(F.col(target)) - 40
    miss = (F.greatest(F.least(wanted, F.lit(500.0)), F.lit(-500.0)) - F.col(pred))
    return _both(scored, pred, target).agg(
        F.when(F.var_pop(target) < 1e-8, F.lit(1.0)).otherwise(F.avg(error) / F.var_pop(target)).alias("fvu"), (F.avg(error) + weight * F.avg(norm)).alias("mdl"),
        (F.avg(miss * miss) / 10000 + weight * F.avg(clipped)).alias("sparse_loss"),
    )


def validation_summary(predictions: DataFrame, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Pearson and rank correlation (0 where undefined), mean target of the top less the bottom tenth, sample deviation of predictions and a collapse flag."""
    rows = _both(predictions, pred, target)
    stats = global_ic(rows, pred, target)
    counts = counted_values(rows, pred)
    total = rows.count()
    k = max(total // 10, 1)
    # rows of one predicted value share their places in the top: each counts with its mean target
    means = rows.groupBy(F.col(pred).alias("value")).agg(F.avg(target).alias("mean"))
    placed = counts.join(means, "value")
    low = F.greatest(F.least(F.col("before") + F.col("n"), F.lit(k)) - F.col("before"), F.lit(0))
    high = F.greatest(F.col("before") + F.col("n") - F.greatest(F.col("before"), F.lit(total - k)), F.lit(0))
    ends = placed.agg((F.sum(high * F.col("mean")) / k - F.sum(low * F.col("mean")) / k).alias("top_less_bottom"))
    spread = rows.agg(F.stddev_samp(pred).alias("std"))
    flag = F.when(F.col("std") < 10, F.lit("error")).when(F.col("std") < 30, F.lit("warn")).otherwise(F.lit("ok"))
    return stats.select(F.coalesce("ic", F.lit(0.0)).alias("ic"), F.coalesce("rank_ic", F.lit(0.0)).alias("rank_ic")).crossJoin(ends).crossJoin(spread).withColumn("collapse", flag)  # one row each


def sparsity(vectors: DataFrame, key: str, z: str, threshold: float = 0.01) -> DataFrame:
    """Share of components under a threshold, per sample."""
    return vectors.select(key, (F.size(F.filter(F.col(z), lambda x: F.abs(x) < threshold)) / F.size(z)).alias("sparsity"))


def entity_counts(predictions: DataFrame) -> DataFrame:
    """Rows, distinct symbols, dates and shards."""
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("date").alias("dates"), F.countDistinct("shard_idx").alias("shards"))


def breakdown(predictions: DataFrame, group: Column, min_rows: int = 10, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per group: dates, mean daily correlation, its ratio to its deviation, and the share of dates over 0."""
    daily = keyed_ic(predictions.withColumn("part", group), ["part", "date"], min_rows, pred, target).filter("ic is not null")
    stats = daily.groupBy("part").agg(F.count(F.lit(1)).alias("dates"), F.avg("ic").alias("ic"), F.stddev_pop("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))
    return stats.select("part", "dates", "ic", (F.col("ic") / (F.col("std") + 1e-8)).alias("icir"), "positive")


def conditional_ic(predictions: DataFrame, thresholds: list[float], min_rows: int = 10, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per threshold: mean daily correlation of rows whose prediction is further than it from the day's median, and rows a day."""
    medians = predictions.groupBy("date").agg(F.median(pred).alias("_median"))
    far = predictions.join(medians, "date").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).filter(F.abs(F.col(pred) - F.col("_median")) > F.col("threshold"))
    return keyed_ic(far, ["threshold", "date"], min_rows, pred, target).groupBy("threshold").agg(F.avg("ic").alias("ic"), F.avg("n").alias("rows_a_day"))


def side_means(predictions: DataFrame, min_rows: int = 100, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per year: mean over dates of the mean target of the long (top), short (bottom) and middle deciles, by each date's percentile edges."""
    rows = of_large_dates(_both(predictions, pred, target), min_rows)
    edges = rows.groupBy("date").agg(F.percentile(pred, [0.1, 0.9]).alias("_edges"))
    side = F.when(F.col(pred) >= F.get("_edges", F.lit(1)), F.lit("long")).when(F.col(pred) <= F.get("_edges", F.lit(0)), F.lit("short")).otherwise(F.lit("middle"))
    daily = rows.join(F.broadcast(edges), "date").groupBy("date", side.alias("side")).agg(F.avg(target).alias("m"))
    return daily.groupBy(F.substring("date", 1, 4).alias("year"), "side").agg(F.count(F.lit(1)).alias("dates"), F.avg("m").alias("mean_target"))


def tail_capture(predictions: DataFrame, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per tail of the target (top and bottom 1 and 5 per cent): rows, share of them in the top prediction decile, and that share over a tenth."""
    rows = _both(predictions, pred, target)
    (top,) = quantiles(rows, pred, [0.9])
    cuts = quantiles(rows, target, [0.01, 0.05, 0.95, 0.99])
    tails = F.array_compact(F.array(F.when(F.col(target) <= cuts[0], F.lit("bottom 1")), F.when(F.col(target) <= cuts[1], F.lit("bottom 5")), F.when(F.col(target) >= cuts[2], F.lit("top 5")), F.when(F.col(target) >= cuts[3], F.lit("top 1"))))
    share = F.avg((F.col(pred) >= top).cast("double"))
    return rows.select(pred, target, F.explode(tails).alias("tail")).groupBy("tail").agg(F.count(F.lit(1)).alias("n"), share.alias("share"), (share / 0.1).alias("lift"))


def ic_drivers(predictions: DataFrame, min_rows: int = 50, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Correlation of the daily correlation with the day's deviations, rows and mean volume."""
    day = predictions.groupBy("date").agg(F.stddev_pop(pred).alias("pred_std"), F.stddev_pop(target).alias("target_std"), F.avg("macro_v_d").alias("volume"))
    daily = daily_ic(predictions, min_rows, pred, target).filter("ic is not null").join(day, "date")
    return daily.agg(*[safe_corr("ic", c).alias(f"ic_{c}") for c in ("pred_std", "target_std", "n", "volume")])


def pooled_means(predictions: DataFrame, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per way of pooling (date, shard): groups and their mean correlation."""
    parts = [keyed_ic(predictions, [k], 3, pred, target).filter("ic is not null").agg(F.count(F.lit(1)).alias("groups"), F.avg("ic").alias("ic")).select(F.lit(k).alias("pooled_by"), "groups", "ic") for k in ("date", "shard_idx")]
    return reduce(DataFrame.unionByName, parts)


def pooling_report(predictions: DataFrame, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """`pooled_means`, and all rows as one group."""
    rows = _both(predictions, pred, target)
    whole = rows.agg(F.count(F.lit(1)).alias("_n"), safe_corr(pred, target).alias("ic"))
    return pooled_means(predictions, pred, target).unionByName(whole.select(F.lit("all").alias("pooled_by"), F.lit(1).cast("long").alias("groups"), "ic"))


def signal_resolution(predictions: DataFrame, within: float = 10.0, pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """How finely predictions tell rows apart: their interquartile range, the share within so much of their median, and the target's deviation, skewness and excess kurtosis."""
    low, middle, high = quantiles(predictions, pred, [0.25, 0.5, 0.75])
    near = F.avg((F.abs(F.col(pred) - F.lit(middle)) <= within).cast("double"))
    stats = predictions.agg(near.alias("near_median"), F.stddev_pop(target).alias("target_std"), F.skewness(target).alias("target_skew"), F.kurtosis(target).alias("target_kurtosis"))
    return stats.withColumn("iqr", F.lit(high) - F.lit(low))


def quintile_spread(predictions: DataFrame, min_rows: int = 50) -> DataFrame:
    """Over dates: mean and median of the spread between the outer fifths, shares over 25 and over 0, and the median correlation."""
    daily = daily_cross_section(predictions, min_rows, parts=5)
    share = lambda t: F.avg((F.col("spread") > t).cast("double"))
    return daily.agg(F.count(F.lit(1)).alias("dates"), F.avg("spread").alias("mean_spread"), F.median("spread").alias("median_spread"), share(25).alias("over_25"), share(0).alias("over_0"), F.median("ic").alias("median_ic"))


def prediction_buckets(predictions: DataFrame, shares: tuple[float, ...] = (0.1, 0.2, 0.5), pred: str = "pred_bp", target: str = "target_bp") -> DataFrame:
    """Per top share of predictions (from its percentile edge on): n, mean target, hit rate, mean win over mean absolute loss."""
    rows = _both(predictions, pred, target)
    cuts = quantiles(rows, pred, [1 - s for s in shares])
    member = F.array_compact(F.array(*[F.when(F.col(pred) >= c, F.lit(s)) for s, c in zip(shares, cuts)]))
    y = F.col(target)
    table = rows.select(pred, target, F.explode(member).alias("share")).groupBy("share")
    win, loss = F.avg(F.when(y > 0, y)), F.avg(F.when(y < 0, -y))
    return table.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_target"), F.avg((y > 0).cast("double")).alias("hit_rate"), F.try_divide(win, loss).alias("win_over_loss"))


def daily_zscore(predictions: DataFrame, min_rows: int = 50, pred: str = "pred_bp") -> DataFrame:
    """predictions of dates with enough rows, with z: the prediction less the day's mean over its population deviation."""
    day = Window.partitionBy("date")
    z = (F.col(pred) - F.avg(pred).over(day)) / (F.stddev_pop(pred).over(day) + 1e-8)
    return predictions.withColumn("z", z).withColumn("_n", F.count(F.lit(1)).over(day)).filter(F.col("_n") >= min_rows).drop("_n")
