"""Local Hurst exponents and persistence landscapes of book windows.

The kernels get the windows of many groups in one Arrow batch each. Windows of one shape are stacked and worked on together, so many at a time as `STACK` numbers hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators.labels import daily_bars

GRID, LAYERS = 20, 3
STACK = 500_000
SCHEMA = "hurst double, triggered boolean, landscape array<double>"


def local_hurst(series: np.ndarray) -> np.ndarray:
    """Of each row (or of one series): slope of log root-mean-square displacement over log lag for lags 2..min(9, n // 2), within [0, 1]; 0.5 for short or flat series."""
    series = np.asarray(series, float)
    if series.ndim == 1:
        return float(local_hurst(series[None])[0])
    n = series.shape[1]
    out = np.full(len(series), 0.5)
    if n < 5:
        return out
    lags = np.arange(2, min(9, n // 2) + 1)
    moves = np.stack([np.sqrt(np.mean((series[:, k:] - series[:, :-k]) ** 2, axis=1)) for k in lags], axis=1)
    sound = moves > 1e-8
    fit = (sound.sum(1) >= 2) & (series.std(axis=1) >= 1e-8)
    x, y = np.where(sound, np.log(lags), 0.0)[fit], np.log(np.where(sound, moves, 1.0))[fit]
    x = np.where(sound[fit], x - (x.sum(1) / sound[fit].sum(1))[:, None], 0.0)
    out[fit] = np.clip((x * y).sum(1) / (x * x).sum(1), 0.0, 1.0)
    return out


def merge_heights(points: np.ndarray) -> np.ndarray:
    """The heights at which single linkage merges, for each cloud of a stack (or one cloud): edge lengths of minimum spanning trees, all grown from their first point in step."""
    points = np.asarray(points, float)
    if points.ndim == 2:
        return merge_heights(points[None])[0]
    clouds, n = points.shape[:2]
    line = np.arange(clouds)
    nearest = np.linalg.norm(points - points[:, :1], axis=2)
    nearest[:, 0] = np.inf
    heights = np.empty((clouds, n - 1))
    grown = np.zeros((clouds, n), bool)
    grown[:, 0] = True
    for i in range(n - 1):
        at = nearest.argmin(1)
        heights[:, i] = nearest[line, at]
        grown[line, at] = True
        nearest = np.where(grown, np.inf, np.minimum(nearest, np.linalg.norm(points - points[line, at][:, None], axis=2)))
    return heights


def landscape(points: np.ndarray, velocity: float | None = None) -> np.ndarray:
    """LAYERS x GRID, for each cloud of a stack (or one cloud): at each of the grid's levels up to the last merge, the largest of max(0, min(t, d - t)) over merge heights d.

    Points are standardised. velocity appends each step's rises by that factor and its falls by a fiftieth of it.
    """
    points = np.asarray(points, float)
    if points.ndim == 2:
        return landscape(points[None], velocity)[0]
    out = np.zeros((len(points), LAYERS, GRID))
    if velocity is not None and points.shape[1] >= 2:
        step = np.diff(points, axis=1)
        points = np.concatenate([points[:, :-1], np.maximum(0, step) * velocity, np.maximum(0, -step) * velocity * 0.02], axis=2)
    if points.shape[1] < 2 or not len(points):
        return out
    deaths = merge_heights((points - points.mean(1, keepdims=True)) / (points.std(1, keepdims=True) + 1e-8))
    top = deaths.max(1)
    levels = np.linspace(0, np.where(top > 0, top, 1.0), GRID, axis=1)
    tents = np.maximum(0, np.minimum(levels[:, :, None], deaths[:, None, :] - levels[:, :, None]))
    k = min(LAYERS, tents.shape[2])
    out[:, :k] = np.sort(tents, axis=2)[:, :, ::-1][:, :, :k].transpose(0, 2, 1)
    return out


def manifold(ticks: DataFrame, levels: int = 10) -> DataFrame:
    """ticks with micro, imbalance and depth of their book."""
    bids, asks = book.side_depth("bid_v", levels), book.side_depth("ask_v", levels)
    return ticks.withColumns({"micro": book.micro_price(F.col("bid_p1"), F.col("ask_p1"), bids, asks), "imbalance": book.imbalance(bids, asks), "depth": book.log_depth(bids, asks)})


def window_landscapes(windows: DataFrame, keys: list[str], points: str = "points", low: float = 0.45, high: float = 0.55, velocity: float | None = None) -> DataFrame:
    """keys, hurst of the first coordinate, triggered (hurst outside [low, high]) and the flat landscape, zeros where not triggered. points: array of arrays."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clouds = batch.column(len(keys))
            flat, sizes = clouds.flatten(), pc.fill_null(pc.list_value_length(clouds), 0).to_numpy()
            values, widths = flat.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(flat).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            at = np.concatenate([[0], np.cumsum(widths)])
            width = np.array([widths[i] if n else 0 for i, n in zip(starts, sizes)], int)
            hurst, cells = np.full(batch.num_rows, 0.5), np.zeros((batch.num_rows, LAYERS * GRID))
            for n, d in sorted(set(zip(sizes.tolist(), width.tolist()))):
                own = np.flatnonzero((sizes == n) & (width == d))
                for part in np.array_split(own, max(1, len(own) * n * max(d, 1) // STACK)) if n else []:
                    stack = values[at[starts[part]][:, None] + np.arange(n * d)].reshape(len(part), n, d)
                    hurst[part] = local_hurst(stack[:, :, 0])
                    hit = part[~((low <= hurst[part]) & (hurst[part] <= high))]
                    cells[hit] = landscape(stack[np.isin(part, hit)], velocity).reshape(len(hit), LAYERS * GRID)
            triggered = ~((low <= hurst) & (hurst <= high))
            lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, LAYERS * GRID, dtype=np.int32), cells.ravel())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], pa.array(hurst), pa.array(triggered), lists], [*keys, "hurst", "triggered", "landscape"])

    kept = windows.select(*keys, points)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keys)])
    return kept.mapInArrow(kernel, f"{schema}, {SCHEMA}")


def daily_topology(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: windows, triggered windows, and the elementwise maximum of the triggered landscapes (zeros if none). Maxima are taken before the shuffle."""
    cells = [F.max(F.get("landscape", F.lit(i))).alias(f"_{i}") for i in range(LAYERS * GRID)]
    sums = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.sum(F.col("triggered").cast("int")).alias("triggered_windows"), *cells)
    return sums.select(*keys, "windows", "triggered_windows", F.array(*[f"_{i}" for i in range(LAYERS * GRID)]).alias("tda"))


def gate_statistics(found: DataFrame) -> DataFrame:
    """Windows, share triggered, and mean, deviation, least and largest landscape value of the triggered ones."""
    rates = found.agg(F.count(F.lit(1)).alias("windows"), F.avg(F.col("triggered").cast("double")).alias("trigger_rate"))
    cells = found.filter("triggered").select(F.explode("landscape").alias("x"))
    return rates.crossJoin(cells.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most")))  # one row with one row


def daily_features(ticks: DataFrame, topology: DataFrame, least: int = 50, cells: int = LAYERS * GRID) -> DataFrame:
    """Per symbol and date of `least` ticks or more: open and close price, triggered windows and tda, zeros where no window was triggered. topology: of `daily_topology`."""
    bars = daily_bars(ticks).filter(F.col("ticks") >= least)
    joined = bars.join(topology.select("symbol", "date", "triggered_windows", "tda"), ["symbol", "date"], "left")
    zeros = F.array_repeat(F.lit(0.0), cells)
    return joined.select("symbol", "date", "open_price", "close_price", F.coalesce("triggered_windows", F.lit(0)).alias("triggered_windows"), F.coalesce("tda", zeros).alias("tda"))
