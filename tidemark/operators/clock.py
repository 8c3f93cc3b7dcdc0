"""The volume clock: ticks to bars, and bars to windows with their forward target.

The clock is sequential within a symbol: it carries what a bar has over its threshold into the next, and thresholds change by day. Only
narrow columns go through the keyed kernel, in batches in order; the closing tick's book is joined back afterwards. The kernel takes one step a
tick over plain floats: that is cheap beside moving the tick, however few ticks a bar or a batch has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.book import bar_features, level_features, pack_book

SIDES = ("bid_p", "bid_v", "ask_p", "ask_v")
BAR_SCHEMA = "symbol string, bar_id long, date string, seq long, close double, delta_p double, vwap double, volume double, threshold double"


@dataclass
class Clock:
    """State of one symbol's clock: volume that counts towards the next bar, and turnover, volume and first price since the last."""

    gathered: float = 0.0
    turnover: float = 0.0
    volume: float = 0.0
    first: float = 0.0
    bars: int = 0

    def closes(self, price: Iterable[float], volume: Iterable[float], threshold: Iterable[float]) -> list[tuple[int, float, float, float]]:
        """Takes ticks in order; gives the bars they close: place of the closing tick, delta_p, vwap and volume.

        A bar closes at the first tick at which what was gathered since reaches the threshold of its day. What it has over that is carried on, up to one threshold.
        A close without volume of its own, by what was carried alone, gives no bar. The first price of a bar is its first that isn't zero. Missing prices and volumes are zero.
        """
        gathered, turnover, own, first, found = self.gathered, self.turnover, self.volume, self.first, []
        for at, (p, v, limit) in enumerate(zip(price, volume, threshold)):
            p, v = p if p == p else 0.0, v if v == v else 0.0
            gathered, turnover, own, first = gathered + v, turnover + p * v, own + v, first or p
            if gathered >= limit:
                gathered -= limit
                if own > 0:
                    found.append((at, p - first, turnover / own, own))
                    gathered = min(gathered, limit)
                turnover = own = first = 0.0
        self.gathered, self.turnover, self.volume, self.first, self.bars = gathered, turnover, own, first, self.bars + len(found)
        return found

    def take(self, price: np.ndarray, volume: np.ndarray, threshold: np.ndarray) -> pd.DataFrame:
        """`closes` as a table: at, delta_p, vwap and volume."""
        return pd.DataFrame(self.closes(price.tolist(), volume.tolist(), threshold.tolist()), columns=["at", "delta_p", "vwap", "volume"]).astype({"at": "int64"})

    def push(self, price: float, volume: float, threshold: float) -> tuple[float, float, float] | None:
        """One tick: (price move, vwap, volume) if it closes a bar."""
        bars = self.take(*(np.array([x], float) for x in (price, volume, threshold)))
        return tuple(bars.iloc[0, 1:]) if len(bars) else None


def run_clock(clock: Clock, rows: pd.DataFrame) -> pd.DataFrame:
    """Bars of one symbol's ticks in order of date and seq, from the clock's state on."""
    before = clock.bars
    found = clock.closes(*(rows[c].to_numpy(float).tolist() for c in ("price", "vol_tick", "threshold")))
    at = [f[0] for f in found]
    closing = {c: rows[c].to_numpy()[at] for c in ("symbol", "date", "seq", "price", "threshold")}
    own = {c: np.array([f[i] for f in found], float) for i, c in enumerate(("delta_p", "vwap", "volume"), 1)}
    close = np.where(np.isnan(price := closing.pop("price").astype(float)), 0.0, price)
    return pd.DataFrame(closing | own | {"bar_id": np.arange(before, clock.bars), "close": close})[["symbol", "bar_id", "date", "seq", "close", "delta_p", "vwap", "volume", "threshold"]]


def _kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    clock, last = Clock(), None
    for rows in batches:
        if not len(rows):
            continue
        date, seq = rows["date"].to_numpy(), rows["seq"].to_numpy()
        falls = (date[1:] < date[:-1]) | ((date[1:] == date[:-1]) & (seq[1:] < seq[:-1]))
        if falls.any() or (last is not None and (date[0], seq[0]) < last):
            raise ValueError("ticks of a symbol came out of order")
        last = date[-1], seq[-1]
        yield run_clock(clock, rows)


def volume_bars(ticks: DataFrame, macro: DataFrame) -> DataFrame:
    """Bars of all symbols. macro gives the threshold of each symbol and date. Unfinished bars are left out."""
    narrow = ticks.join(macro.select("symbol", "date", "threshold"), ["symbol", "date"]).select("symbol", "date", F.col("seq").cast("long").alias("seq"), "price", "vol_tick", "threshold")
    ordered = narrow.repartition("symbol").sortWithinPartitions("symbol", "date", "seq")
    return ordered.groupBy("symbol").applyInPandas(_kernel, BAR_SCHEMA)


def with_book(bars: DataFrame, ticks: DataFrame, macro: DataFrame, levels: int = 10) -> DataFrame:
    """Bars with v_d and sigma_d of their day and the book of their closing tick."""
    sides = [f"{side}{i}" for i in range(1, levels + 1) for side in SIDES]
    book = ticks.select("symbol", "seq", *[F.col(c).cast("float").alias(c) for c in sides])  # flat and narrow while it is moved
    found = bars.join(macro.select("symbol", "date", "v_d", "sigma_d"), ["symbol", "date"]).join(book, ["symbol", "seq"])
    return found.withColumn("lob", pack_book(levels)).drop(*sides)


def bucket_bars(bucketed: DataFrame) -> DataFrame:
    """Bars of the simple bucket clock: one for each complete volume bucket of `calibrate.bucketed`."""
    price, volume = F.col("price"), F.col("vol_tick")
    sums = bucketed.groupBy("symbol", "bucket").agg(
        F.max("date").alias("date"), F.max("seq").alias("seq"), F.max_by("price", "seq").alias("close"), (F.max_by("price", "seq") - F.min_by("price", "seq")).alias("delta_p"),
        F.try_divide(F.sum(price * volume), F.nullif(F.sum(volume), F.lit(0.0))).alias("vwap"), F.sum(volume).alias("volume"),
    )
    own = Window.partitionBy("symbol")
    whole = sums.withColumn("_last", F.max("bucket").over(own)).filter(F.col("bucket") < F.col("_last")).drop("_last")
    return whole.withColumn("bar_id", F.row_number().over(own.orderBy("bucket")) - 1).drop("bucket")


def window_targets(bars: DataFrame, length: int = 160, stride: int = 20, horizon: int = 20) -> DataFrame:
    """Per symbol and window start: date of the last bar and the target, the move in basis points from the next bar's vwap to that `horizon` bars on. Windows without it are left out."""
    own = Window.partitionBy("symbol").orderBy("bar_id")
    entry, end = F.lead("vwap", 1).over(own), F.lead("vwap", 1 + horizon).over(own)
    ends = bars.select("symbol", "bar_id", "date", entry.alias("entry"), end.alias("end")).filter(F.col("end").isNotNull())
    start = F.col("bar_id") - (length - 1)
    aligned = ends.filter((start >= 0) & (start % stride == 0))
    return aligned.select("symbol", start.alias("start"), "date", ((F.col("end") - F.col("entry")) / (F.col("entry") + 1e-8) * 10000).alias("target_bp"))


def windows(bars: DataFrame, columns: list[str], length: int = 160, stride: int = 20, horizon: int = 20) -> DataFrame:
    """window_targets with bars: the window's bars in order, of the given columns.

    Bars lie by symbol after one shuffle. There they are gathered into blocks of `stride`, each with the targets of its bars, and a window is the blocks from its own on: no bar is copied before that.
    """
    own = Window.partitionBy("symbol").orderBy("bar_id")
    entry, end = F.lead("vwap", 1).over(own), F.lead("vwap", 1 + horizon).over(own)
    target = F.when(end.isNotNull(), (end - entry) / (entry + 1e-8) * 10000)
    bar = F.struct("bar_id", F.struct("bar_id", *columns).alias("bar"), F.col("date").alias("_date"), F.col("_target"))
    blocks = bars.repartition("symbol").withColumn("_target", target).groupBy("symbol", F.floor(F.col("bar_id") / stride).alias("block")).agg(F.sort_array(F.collect_list(bar)).alias("bars"))
    ahead = Window.partitionBy("symbol").orderBy("block").rowsBetween(0, -(-length // stride) - 1)
    spans = blocks.select("symbol", (F.col("block") * stride).alias("start"), F.slice(F.flatten(F.collect_list("bars").over(ahead)), 1, length).alias("bars"))
    last = F.element_at("bars", -1)
    whole = spans.filter((F.size("bars") == length) & last["_target"].isNotNull())
    return whole.select("symbol", "start", last["_date"].alias("date"), last["_target"].alias("target_bp"), F.transform("bars", lambda b: b["bar"]).alias("bars"))


def window_keys(samples: DataFrame) -> DataFrame:
    """Samples with their running number in the symbol's order of start."""
    return samples.withColumn("sample", F.row_number().over(Window.partitionBy("symbol").orderBy("start")) - 1)


def tumbling(rows: DataFrame, keys: list[str], order: str, size: int, first: dict[str, str] | None = None) -> DataFrame:
    """Rows with their window of `size` rows within the keys; the remainder is dropped. With first (name -> column), also the row's place in its window, as `bar`, and these
    columns' values at the window's first row. All is found over one order of the rows: a window is whole if its end isn't past the number of rows."""
    own = Window.partitionBy(*keys).orderBy(order)
    everything = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.withColumns({"_place": F.row_number().over(own) - 1, "_n": F.count(F.lit(1)).over(everything), **{f"_{name}_{i}": F.lag(c, i).over(own) for name, c in (first or {}).items() for i in range(1, size)}})
    whole = placed.withColumn("window", F.floor(F.col("_place") / size)).filter((F.col("window") + 1) * size <= F.col("_n"))
    if first is None:
        return whole.drop("_place", "_n")
    bar = F.col("_place") % size
    at_first = {name: reduce(lambda found, i: found.when(bar == i, F.col(f"_{name}_{i}")), range(1, size), F.when(bar == 0, F.col(c))) for name, c in first.items()}
    return whole.select(*rows.columns, "window", bar.alias("bar"), *[c.alias(name) for name, c in at_first.items()])


def flat_manifold(bars: DataFrame, keys: list[str], names: list[str], levels: int = 10, close: str = "close", first: str = "first", quantity: str = "q_hat", macro: tuple[str, ...] = ()) -> DataFrame:
    """A row for each bar (its keys) and level of its book, with the features of `book.manifold` by these names. bars hold the level columns and their window's first close.

    A bar's own features are taken before its levels are unfolded, a level's after that: plain columns are compiled, functions over arrays are not.
    """
    shared = bar_features(F.col(close), F.col(first), F.col(quantity), [F.col(m) for m in macro])
    sides = [F.array(*[F.col(f"{side}{i}").cast("float") for i in range(1, levels + 1)]).alias(side) for side in SIDES]
    unfolded = bars.select(*keys, *[x.alias(name) for name, x in zip(names[4:], shared, strict=True)], *sides).withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(levels)])))
    level = F.struct(*[F.get(side, F.col("level")).alias(side) for side in SIDES])
    return unfolded.select(*keys, "level", *[x.alias(name) for name, x in zip(names, level_features(level))], *names[4:])
