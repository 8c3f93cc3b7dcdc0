"""Ticks, calibration, clocks, windows and labels against plain models, with the edge rows."""

import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators import calibrate, clock, labels, ticks

TICK = "symbol string, date string, seq long, price double, vol_tick double, bs_flag string"


def made(spark, rows):
    return spark.createDataFrame(rows, TICK)


def draw_ticks(seed, symbols=3, days=12, a_day=40):
    draw = random.Random(seed)
    rows = []
    for s in range(symbols):
        seq = 0
        for d in range(days):
            if draw.random() < 0.1:
                continue
            dead = draw.random() < 0.15
            for _ in range(draw.randrange(1, a_day)):
                seq += 1
                volume = 0.0 if dead or draw.random() < 0.2 else float(draw.choice([1, 5, 20, 3000 if draw.random() < 0.05 else 7]))
                rows.append((f"60000{s}.SH", f"202401{d + 1:02d}", seq, draw.choice([0.0, 10.0, 10.5, 11.0, 9.5]), volume, draw.choice(["B", "S", None])))
    return rows


def macro_model(rows, days=4, share=0.5, least=20.0, first=30.0, volume=150.0, spread=0.5):
    out = {}
    by = {}
    for s, d, _, p, v, _ in rows:
        by.setdefault(s, {}).setdefault(d, []).append((p, v))
    for s, dated in by.items():
        volumes, ranges = deque(maxlen=days), deque(maxlen=days)
        for k, d in enumerate(sorted(dated)):
            v_d = sum(volumes) / len(volumes) if volumes else volume
            out[s, d] = (v_d, sum(ranges) / len(ranges) if ranges else spread, first if k == 0 else max(v_d * share, least))
            total, prices = sum(v for _, v in dated[d]), [p for p, _ in dated[d] if p > 0]
            if total > 0:
                volumes.append(total)
            ranges.append(max(max(prices) - min(prices), 1e-4) if prices else 1e-4)
    return out


PARAMETERS = {"days": 4, "share": 0.5, "least": 20.0, "first_threshold": 30.0, "first_volume": 150.0}


def bars_model(rows, thresholds):
    out, state = [], {}
    for s, d, q, p, v, _ in rows:
        c = state.setdefault(s, {"cum": 0.0, "pv": 0.0, "v": 0.0, "first": 0.0, "n": 0})
        c["cum"] += v
        c["pv"] += p * v
        c["v"] += v
        c["first"] = c["first"] or p
        limit = thresholds[s, d][2]
        if c["cum"] >= limit:
            if c["v"] > 0:
                out.append((s, c["n"], d, q, p, p - c["first"], c["pv"] / c["v"]))
                c["n"] += 1
                c["cum"] = min(c["cum"] - limit, limit)
            else:
                c["cum"] -= limit
            c["pv"] = c["v"] = c["first"] = 0.0
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_macro_and_clock(spark, seed):
    rows = draw_ticks(seed)
    t = made(spark, rows)
    macro = ticks.rolling_macro(ticks.daily_stats(t), **PARAMETERS)
    want = macro_model(rows)
    for r in macro.collect():
        assert (r.v_d, r.sigma_d, r.threshold) == pytest.approx(want[r.symbol, r.date])
    got = sorted((r.symbol, r.bar_id, r.date, r.seq, r.close, r.delta_p, r.vwap) for r in clock.volume_bars(t, macro).collect())
    model = sorted(bars_model(rows, want))
    assert [g[:4] for g in got] == [m[:4] for m in model]
    assert np.allclose([g[4:] for g in got], [m[4:] for m in model])


def test_block_trade_drains_once():
    c = clock.Clock()
    assert c.push(10, 1000, 100) is not None and c.gathered == 100
    assert c.push(10, 0, 100) is None and c.gathered == 0
    assert c.push(10, 0, 100) is None and c.push(10, 5, 100) is None


def test_first_price_zero():
    c = clock.Clock()
    assert c.push(0.0, 50, 100) is None
    assert c.push(10.0, 50, 100)[0] == 0.0


@pytest.mark.parametrize(("n", "expected"), [(180, 0), (181, 1), (200, 1), (201, 2)])
def test_window_counts(spark, n, expected):
    bars = spark.range(n).select(F.lit("a").alias("symbol"), F.col("id").alias("bar_id"), F.lit("d").alias("date"), (F.col("id") + 1.0).alias("vwap"))
    out = clock.windows(bars, ["vwap"]).collect()
    assert len(out) == expected
    for r in out:
        assert [b.bar_id for b in r.bars] == list(range(r.start, r.start + 160))
        entry = r.start + 161.0
        assert r.target_bp == pytest.approx(20 / (entry + 1e-8) * 1e4)


def test_cleaning(spark):
    rows = [(None, "d", 1, 1.0, 1.0, None), ("", "d", 2, 1.0, 1.0, None), ("600000.SH", "d", 3, None, float("nan"), None), ("159001.SZ", "d", 4, 1.0, 1.0, None), ("60000.SH", "d", 5, 1.0, 1.0, None)]
    out = ticks.cleaned(made(spark, rows))
    assert [(r.price, r.vol_tick) for r in out.filter("seq = 3").collect()] == [(0.0, 0.0)] and out.count() == 3
    assert [r.symbol for r in ticks.share_symbols(out).collect()] == ["600000.SH"]


def test_runs_are_null_safe(spark):
    flags = ["N", "N", None, None, "B"]
    rows = [("a", "d", i, 10.0 + i, 2.0, f) for i, f in enumerate(flags)]
    out = sorted((r.q, r.dp) for r in calibrate.directional_runs(made(spark, rows)).collect())
    assert out == [(4.0, 1.0), (4.0, 1.0)]


def test_zero_range_day_is_left_out(spark):
    rows = [("a", "d1", i, 10.0, 5000.0, "B") for i in range(3)] + [("b", "d1", i, 10.0 + i * 0.1, 5000.0, "B") for i in range(3)]
    assert [r.symbol for r in calibrate.friction(made(spark, rows)).collect()] == ["b"]


def test_defaults_without_data(spark):
    none = made(spark, [])
    assert calibrate.clock_threshold(none).first().threshold == 50_000
    assert calibrate.window_length(calibrate.path_efficiency(none, 10)).first().window == 160
    assert calibrate.friction(none).count() == 0
    assert clock.volume_bars(none, ticks.rolling_macro(ticks.daily_stats(none))).count() == 0


def test_labels(spark):
    draw = random.Random(9)
    closes, opens = [10 + draw.random() * 3 for _ in range(60)], [10 + draw.random() * 3 for _ in range(60)]
    df = spark.createDataFrame([("a", f"d{i:03d}", o, c) for i, (o, c) in enumerate(zip(opens, closes))], "symbol string, date string, open_price double, close_price double")
    for i, r in enumerate(sorted(labels.swing_labels(df).collect(), key=lambda r: r.date)):
        if i + 20 >= 60:
            assert r.breakout is None and r.log_sharpe is None and r.phase is None
            continue
        future, entry = np.array(closes[i + 1 : i + 21]), opens[i + 1] * 1.003
        peak = np.maximum.accumulate(np.insert(future, 0, entry))[1:]
        raw = (future[-1] * 0.997 / entry - 1) / (abs((future * 0.997 / peak - 1).min()) + 1e-4)
        assert r.breakout == float(future.max() / entry - 1 > 0.15)
        assert r.log_sharpe == pytest.approx(math.copysign(math.log1p(abs(raw)), raw))
        assert r.phase == (float((future[:5] > np.mean(closes[i - 19 : i + 1])).all()) if i >= 19 else None)


def test_keys(spark):
    rows = spark.createDataFrame([("600519.SH", 42), ("000001.SZ", 0)], "symbol string, i long")
    out = rows.withColumn("k", book.sample_key(F.col("symbol"), F.col("i"))).withColumns({"s": book.key_symbol(F.col("k")), "n": book.key_index(F.col("k"))}).collect()
    assert [(r.k, r.s, r.n) for r in out] == [("600519_SH_000000042", "600519.SH", 42), ("000001_SZ_000000000", "000001.SZ", 0)]
    odd = spark.createDataFrame([("X_ABC_000000001",), ("bad",)], "k string").select(book.key_symbol(F.col("k")).alias("s"), book.key_index(F.col("k")).alias("n")).collect()
    assert [(r.s, r.n) for r in odd] == [("X.ABC", 1), ("bad", None)]


def test_expressions(spark):
    row = spark.range(1).select(
        book.coarse(F.array(*[F.lit(float(x)) for x in (1, 3, 5, 7, 9)]), 2).alias("c"), book.pooled(F.expr("array(array(1, 5), array(3, 2))")).alias("p"), book.symlog(F.lit(-math.e + 1)).alias("s"), book.clean(F.lit(float("nan"))).alias("n"),
        book.implied_quantity(F.lit(-2.0), F.lit(1.0), F.lit(100.0), F.lit(1.0)).alias("q"), book.is_locked(F.lit(0.0), F.lit(1.0)).alias("l"), book.date_of_file(F.lit("20240105_x.parquet")).cast("string").alias("d"), book.date_of_file(F.lit("readme")).alias("e"),
        book.last_bars(F.expr("array(1, 2, 3)"), 2).alias("b"),
    ).first()
    assert row.c == [2.0, 6.0] and row.p == [3, 5] and row.s == pytest.approx(-1.0) and row.n == 0.0 and row.l and row.d == "2024-01-05" and row.e is None and row.b == [2, 3]
    assert row.q == pytest.approx(-400.0, rel=1e-6)
