"""The volume clock over a stream of ticks: the same bars, and the same windows with their targets, as the batch clock.

Files arrive in date order. State of a symbol: its clock, the running day, the last days' volumes and ranges, and for windows the last bars that an open window or target can still need;
it is bounded by the days, the window and the horizon. Ticks of a date before the symbol's running day are diverted: with bars they come out with late set and change nothing, with windows
they are left out. An unfinished bar, day or window gives nothing at the end of the input, as in batch. Restarting is the checkpoint's work.

The clock's state is held as a version and a text of named values, so that a checkpoint outlives changes of the layout: what an older version wrote is upgraded when a symbol is next seen, and then
written in the present one. Version 1 held the ticks since the last bar one by one, and bars without their date.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.clock import BAR_SCHEMA, Clock

OUT_SCHEMA = f"{BAR_SCHEMA}, late boolean"
VERSION = 2
CLOCK_STATE = "version int, values string"
BARS = [("bar_id", "i8"), ("date", "O"), ("seq", "i8"), *[(c, "f8") for c in ("close", "delta_p", "vwap", "volume", "threshold", "v_d", "sigma_d")]]
TICKS = [("date", "O"), ("seq", "i8"), ("price", "f8"), ("vol_tick", "f8")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _upgraded_1(old: dict) -> dict:
    """Version 1 held prices and volumes of the ticks since the last bar; version 2 holds their sums and first price. Its bars had no date."""
    price, volume = np.array(old.pop("prices"), float), np.array(old.pop("volumes_since"), float)
    first = price[price != 0]
    return old | {"turnover": float((price * volume).sum()), "volume": float(volume.sum()), "first": float(first[0]) if len(first) else 0.0, "bars": [bar | {"date": None} for bar in old["bars"]]}


UPGRADES = {1: _upgraded_1}


def upgraded(version: int, values: dict) -> dict:
    """Values of the present layout from those of any earlier one."""
    while version < VERSION:
        values, version = UPGRADES[version](values), version + 1
    return values


def in_turn(to: float, values: Iterable[float]) -> float:
    """The sum, value by value in this order, as batch and SQL add."""
    for x in values:
        to += x
    return to


class VolumeClock(StatefulProcessor):
    """Bars, or windows of bars with their targets, of each symbol."""

    def __init__(self, macro: dict, window: dict | None = None, carried: tuple[str, ...] = ()):
        self.macro, self.window, self.carried = macro, window, list(carried)
        self.ticks, self.bars = ([*fields, *[(c, "O") for c in self.carried]] for fields in (TICKS, BARS))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clock", CLOCK_STATE)

    def _read(self) -> dict:
        found = self.state.get()
        if found is None:
            first = {"v_d": self.macro["first_volume"], "sigma_d": self.macro["first_range"], "threshold": self.macro["first_threshold"]}
            return first | {"gathered": 0.0, "turnover": 0.0, "volume": 0.0, "first": 0.0, "closed": 0, "date": None, "seq": None, "day_volume": 0.0, "high": None, "low": None, "volumes": [], "ranges": [], "bars": []}
        version, values = found
        return upgraded(version, json.loads(values))

    def _write(self, values: dict) -> None:
        self.state.update((VERSION, json.dumps(values)))

    def _close_day(self, s: dict) -> None:
        """The finished day goes into the kept volumes (if it had any) and ranges; the next day's threshold comes from those."""
        if s["day_volume"] > 0:
            s["volumes"] = [*s["volumes"], s["day_volume"]][-self.macro["days"] :]
        s["ranges"] = [*s["ranges"], max(s["high"] - s["low"] if s["high"] is not None else 0.0, 1e-4)][-self.macro["days"] :]
        mean = lambda values: in_turn(0.0, values) / len(values)
        s["v_d"] = mean(s["volumes"]) if s["volumes"] else self.macro["first_volume"]
        s["sigma_d"] = mean(s["ranges"])
        s["threshold"] = max(s["v_d"] * self.macro["share"], self.macro["least"])

    def _day(self, s: dict, clock: Clock, date: str, rows: np.ndarray) -> np.ndarray:
        """Takes a day's ticks, or its next ones; gives their bars with v_d, sigma_d and the carried columns of the closing tick."""
        if date != s["date"]:
            if s["date"] is not None:
                self._close_day(s)
            s |= {"date": date, "day_volume": 0.0, "high": None, "low": None}
        price, volume, seq = (rows[c].tolist() for c in ("price", "vol_tick", "seq"))
        s["seq"], s["day_volume"] = seq[-1], in_turn(s["day_volume"], (v for v in volume if v == v))
        if priced := [p for p in price if p > 0]:
            s["high"], s["low"] = max([*priced, s["high"]] if s["high"] is not None else priced), min([*priced, s["low"]] if s["low"] is not None else priced)
        first, found, daily, carried = clock.bars, clock.closes(price, volume, repeat(s["threshold"])), (s["threshold"], s["v_d"], s["sigma_d"]), [rows[c].tolist() for c in self.carried]
        return np.array([(first + k, date, seq[at], price[at] if price[at] == price[at] else 0.0, *of_bar, *daily, *[c[at] for c in carried]) for k, (at, *of_bar) in enumerate(found)], self.bars)

    def _windows(self, s: dict, symbol: str, bars: np.ndarray) -> list[dict]:
        """The windows whose target bar is among the new bars; keeps the bars that later ones need."""
        length, stride, horizon = (self.window[k] for k in ("length", "stride", "horizon"))
        held, out, names = s["bars"], [], ["bar_id", "date", "close", "vwap", "v_d", "sigma_d", *self.carried]
        for values in zip(*[bars[c].tolist() for c in names]):
            held.append(bar := dict(zip(names, values)))
            start = bar["bar_id"] - length - horizon
            if start >= 0 and start % stride == 0:
                own = held[-length - horizon - 1 :]
                entry, last = own[length]["vwap"], own[length - 1]
                out.append({"symbol": symbol, "start": start, "date": last["date"], "target_bp": (bar["vwap"] - entry) / (entry + 1e-8) * 10000, "bars": [{k: v for k, v in b.items() if k != "date"} for b in own[:length]]})
            del held[: -length - horizon]
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """A symbol's ticks of one trigger, which its number of files bounds. They are one array of named fields: a table of pandas for each symbol or day would cost more than all the rest."""
        ticks = np.fromiter((row[1:] for row in rows), self.ticks)
        ticks = ticks[np.lexsort((ticks["seq"], ticks["date"].astype(str)))]
        s = self._read()
        clock = Clock(s["gathered"], s["turnover"], s["volume"], s["first"], s["closed"])
        date, seq = ticks["date"], ticks["seq"]
        late = 0 if s["date"] is None else int(np.count_nonzero((date < s["date"]) | ((date == s["date"]) & (seq < s["seq"]))))  # they come first
        days = np.split(ticks[late:], np.flatnonzero(date[late + 1 :] != date[late:-1]) + 1) if late < len(ticks) else []
        found = np.concatenate([np.empty(0, self.bars), *[self._day(s, clock, day["date"][0], day) for day in days]])
        windows = self._windows(s, key[0], found) if self.window else []
        self._write(s | {"gathered": clock.gathered, "turnover": clock.turnover, "volume": clock.volume, "first": clock.first, "closed": clock.bars})
        if self.window:
            yield from (Row(**window) for window in windows)
            return
        bar = Row(*[c.split()[0] for c in OUT_SCHEMA.split(", ")])
        for bar_id, date, seq, *values, _, _ in found.tolist():
            yield bar(key[0], bar_id, date, seq, *values, False)
        for date, seq, price, volume in ticks[:late].tolist():
            yield bar(key[0], None, date, seq, price if price == price else None, None, None, volume if volume == volume else None, None, True)

    def close(self) -> None:
        pass


def with_keyed_state(spark: SparkSession) -> SparkSession:
    """The session, which keeps streaming state in RocksDB unless it names another provider: values and lists of a key need its column families."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _macro(days: int, share: float, least: float, first_threshold: float, first_volume: float, first_range: float) -> dict:
    return {"days": days, "share": share, "least": least, "first_threshold": first_threshold, "first_volume": first_volume, "first_range": first_range}


def volume_bar_stream(ticks: DataFrame, days: int = 20, share: float = 0.02, least: float = 1000.0, first_threshold: float = 50_000.0, first_volume: float = 5_000_000.0, first_range: float = 0.5) -> DataFrame:
    """Bars (and late ticks) of a stream of ticks: symbol, date, seq, price, vol_tick. Ticks without symbol or date are left out, as in batch."""
    with_keyed_state(ticks.sparkSession)
    processor = VolumeClock(_macro(days, share, least, first_threshold, first_volume, first_range))
    narrow = ticks.filter("symbol is not null and date is not null").selectExpr("symbol", "date", "cast(seq as long) as seq", "cast(price as double) as price", "cast(vol_tick as double) as vol_tick")
    return narrow.groupBy("symbol").transformWithState(processor, OUT_SCHEMA, "append", "none")


def volume_window_stream(
    ticks: DataFrame, carried: tuple[str, ...] = (), length: int = 160, stride: int = 20, horizon: int = 20, processor=VolumeClock,
    days: int = 20, share: float = 0.02, least: float = 1000.0, first_threshold: float = 50_000.0, first_volume: float = 5_000_000.0, first_range: float = 0.5,
) -> DataFrame:
    """Windows of a stream's bars, each when its target bar has closed: symbol, start, date, target_bp and bars (bar_id, close, vwap, v_d, sigma_d and the carried columns of the closing tick, as doubles)."""
    with_keyed_state(ticks.sparkSession)
    clock = processor(_macro(days, share, least, first_threshold, first_volume, first_range), {"length": length, "stride": stride, "horizon": horizon}, carried)
    narrow = ticks.filter("symbol is not null and date is not null").selectExpr("symbol", "date", "cast(seq as long) as seq", "cast(price as double) as price", "cast(vol_tick as double) as vol_tick", *[f"cast(`{c}` as double) as `{c}`" for c in carried])
    fields = ", ".join(["bar_id: long", *[f"`{c}`: double" for c in ("close", "vwap", "v_d", "sigma_d", *carried)]])
    return narrow.groupBy("symbol").transformWithState(clock, f"symbol string, start long, date string, target_bp double, bars array<struct<{fields}>>", "append", "none")
