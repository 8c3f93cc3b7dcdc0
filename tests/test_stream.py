"""The clock kernel tick by tick, and streams against the batch clock: windows, restarts, states of an older layout."""

import json
import random

import numpy as np
import pytest

from tests.test_market import PARAMETERS, TICK, draw_ticks
from tidemark.operators import clock, ticks
from tidemark.streaming.clock_stream import VERSION, VolumeClock, upgraded, volume_bar_stream, volume_window_stream

WINDOW = {"length": 4, "stride": 2, "horizon": 3}


def one_by_one(price, volume, threshold):
    """The clock by its definition."""
    total = turnover = own = first = 0.0
    for i, (p, v, limit) in enumerate(zip(price, volume, threshold)):
        total, turnover, own, first = total + v, turnover + p * v, own + v, first or p
        if total >= limit:
            if own > 0:
                yield i, p - first, turnover / own, own
            total = min(total - limit, limit) if own > 0 else total - limit
            turnover = own = first = 0.0


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("least", [0.0, -3.0])
def test_kernel_against_single_ticks(seed, least):
    draw = np.random.default_rng(seed)
    n = 400
    price = np.where(draw.random(n) < 0.2, 0.0, np.round(draw.normal(10, 1, n), 2))
    volume = np.where(draw.random(n) < 0.3, 0.0, np.round(draw.exponential(8, n) + least, draw.integers(0, 3)))
    threshold = np.repeat([20.0, 35.0 / 3, 1.0, 50.1], n // 4)
    state, found, at = clock.Clock(), [], 0
    for size in [1, 5, 0, 94, 150, 150]:  # in batches, the state carried on
        bars = state.take(price[at : at + size], volume[at : at + size], threshold[at : at + size])
        found += [(at + b.at, b.delta_p, b.vwap, b.volume) for b in bars.itertuples()]
        at += size
    want = list(one_by_one(price, volume, threshold))
    assert [f[0] for f in found] == [w[0] for w in want] and state.bars == len(want)
    assert np.allclose([f[1:] for f in found], [w[1:] for w in want])


def landed(spark, rows, lake, dates):
    for date in sorted(dates):
        spark.createDataFrame([r for r in rows if r[1] == date], TICK).repartition(2).write.mode("append").parquet(lake)


def run(stream, folder):
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()


def batch_windows(spark, rows):
    t = spark.createDataFrame(rows, TICK)
    macro = ticks.rolling_macro(ticks.daily_stats(t), **PARAMETERS)
    bars = clock.volume_bars(t, macro).join(macro.select("symbol", "date", "v_d", "sigma_d"), ["symbol", "date"])
    return flat(clock.windows(bars, ["close", "vwap", "v_d", "sigma_d"], **WINDOW))


def flat(found, dated=True):
    return sorted((r.symbol, r.start, r.date if dated else None, round(r.target_bp, 6), *(round(x, 9) for b in r.bars for x in (b.bar_id, b.close, b.vwap, b.v_d, b.sigma_d))) for r in found.collect())


def test_windows_of_the_stream(spark, tmp_path):
    rows = draw_ticks(8, days=14)
    dates = sorted({r[1] for r in rows})
    lake, folder = str(tmp_path / "lake"), str(tmp_path)
    for part in (dates[:5], dates[5:6], dates[6:]):  # a run for each: all but the first go on from the checkpoint, in the middle of windows
        landed(spark, rows, lake, part)
        run(volume_window_stream(spark.readStream.schema(spark.createDataFrame([], TICK).schema).option("maxFilesPerTrigger", 100).parquet(lake), **WINDOW, **PARAMETERS), folder)
    want = batch_windows(spark, rows)
    assert len(want) > 20 and flat(spark.read.parquet(f"{folder}/out")) == want


def test_carried_columns(spark, tmp_path):
    draw = random.Random(3)
    rows = [(f"60000{s}.SH", f"202401{d:02d}", d * 100 + i, 10.0, 25.0, draw.random(), draw.random()) for s in range(2) for d in range(1, 4) for i in range(20)]
    t = spark.createDataFrame(rows, "symbol string, date string, seq long, price double, vol_tick double, bid_p1 double, ask_p1 double")
    t.write.parquet(str(tmp_path / "lake"))
    run(volume_window_stream(spark.readStream.schema(t.schema).parquet(str(tmp_path / "lake")), carried=("bid_p1", "ask_p1"), **WINDOW, **PARAMETERS), str(tmp_path))
    macro = ticks.rolling_macro(ticks.daily_stats(t), **PARAMETERS)
    bars = clock.volume_bars(t, macro).join(t.select("symbol", "seq", "bid_p1", "ask_p1"), ["symbol", "seq"])
    want = sorted((r.symbol, r.start, [(b.bar_id, b.bid_p1, b.ask_p1) for b in r.bars]) for r in clock.windows(bars, ["bid_p1", "ask_p1"], **WINDOW).collect())
    got = sorted((r.symbol, r.start, [(b.bar_id, b.bid_p1, b.ask_p1) for b in r.bars]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert want and got == want


class FirstLayout(VolumeClock):
    """Keeps its state as version 1 did: the ticks since the last bar one by one, bars without dates."""

    def _read(self):
        self.since = json.loads(self.state.get()[1]) if self.state.exists() else {"prices": [], "volumes_since": []}
        return super()._read()

    def _day(self, s, clock, date, rows):
        bars = super()._day(s, clock, date, rows)
        kept = rows[rows["seq"] > bars["seq"].max()] if len(bars) else rows
        before = {"prices": [], "volumes_since": []} if len(bars) else self.since
        self.since = {"prices": before["prices"] + kept["price"].tolist(), "volumes_since": before["volumes_since"] + kept["vol_tick"].tolist()}
        return bars

    def _write(self, values):
        old = {k: v for k, v in values.items() if k not in ("turnover", "volume", "first")} | {k: self.since[k] for k in ("prices", "volumes_since")}
        old["bars"] = [{k: v for k, v in bar.items() if k != "date"} for bar in values["bars"]]
        self.state.update((1, json.dumps(old)))


def test_a_state_of_version_1_is_taken_up(spark, tmp_path):
    rows = draw_ticks(9, days=14)
    dates = sorted({r[1] for r in rows})
    lake, folder = str(tmp_path / "lake"), str(tmp_path)
    source = lambda: spark.readStream.schema(spark.createDataFrame([], TICK).schema).parquet(lake)
    landed(spark, rows, lake, dates[:6])
    run(volume_window_stream(source(), **WINDOW, **PARAMETERS, processor=FirstLayout), folder)
    landed(spark, rows, lake, dates[6:])
    run(volume_window_stream(source(), **WINDOW, **PARAMETERS), folder)
    got = spark.read.parquet(f"{folder}/out")
    want = batch_windows(spark, rows)
    assert flat(got, dated=False) == sorted((w[0], w[1], None, *w[3:]) for w in want)
    undated = got.filter("date is null").count()  # windows that end in a bar which the old layout kept without its date
    assert 0 < undated < len(want)


def test_layouts_in_turn():
    old = {"prices": [0.0, 10.0, 11.0], "volumes_since": [1.0, 2.0, 3.0], "gathered": 6.0, "bars": [{"bar_id": 0, "vwap": 1.0}]}
    assert upgraded(1, dict(old)) == {"gathered": 6.0, "turnover": 53.0, "volume": 6.0, "first": 10.0, "bars": [{"bar_id": 0, "vwap": 1.0, "date": None}]}
    assert upgraded(VERSION, {"gathered": 1.0}) == {"gathered": 1.0}


def test_late_ticks_leave_no_mark(spark, tmp_path):
    lake = str(tmp_path / "lake")
    landed(spark, [("a", "20240103", 1, 10.0, 5.0, "B")], lake, ["20240103"])
    stream = lambda: volume_bar_stream(spark.readStream.schema(spark.createDataFrame([], TICK).schema).parquet(lake), **PARAMETERS)
    run(stream(), str(tmp_path))
    landed(spark, [("a", "20240101", 1, 99.0, 1e6, "B"), ("a", "20240103", 2, 11.0, 25.0, "B")], lake, ["20240101", "20240103"])
    run(stream(), str(tmp_path))
    out = {r.late: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out[True].volume == 1e6 and (out[False].volume, out[False].delta_p) == (30.0, 1.0)


def test_windows_take_one_shuffle_and_no_copies(spark):
    bars = spark.range(1000).selectExpr("cast(id % 3 as string) as symbol", "id div 3 as bar_id", "'d' as date", "cast(id as double) as vwap")
    text = clock.windows(bars, ["vwap"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Generate" not in text and "Join" not in text


def test_book_of_the_closing_tick(spark):
    rows = [("a", "d", i, 10.0 + i, 30.0, 1.0 * i, 2.0 * i, 3.0 * i, 4.0 * i) for i in range(1, 5)]
    t = spark.createDataFrame(rows, "symbol string, date string, seq long, price double, vol_tick double, bid_p1 double, bid_v1 double, ask_p1 double, ask_v1 double")
    macro = spark.createDataFrame([("a", "d", 60.0, 7.0, 8.0)], "symbol string, date string, threshold double, v_d double, sigma_d double")
    out = clock.with_book(clock.volume_bars(t, macro), t, macro, 1).orderBy("bar_id").collect()
    assert [(r.seq, r.v_d, r.sigma_d, tuple(r.lob[0])) for r in out] == [(2, 7.0, 8.0, (2.0, 4.0, 6.0, 8.0)), (4, 7.0, 8.0, (4.0, 8.0, 12.0, 16.0))]
