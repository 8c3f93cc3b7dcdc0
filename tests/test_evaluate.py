"""Evaluation, selection and risk: edge cases, and numpy models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.functions.ranks import quantiles, with_average_rank
from tidemark.operators import evaluate, layout, quality, risk, selection

PRED = "symbol string, date string, shard_idx long, pred_bp double, target_bp double, bid_p1 double, ask_p1 double, macro_v_d double, z_sparsity double"


def made(spark, pairs, date="20240101"):
    return spark.createDataFrame([("600000.SH", date, i, x, y, 10.0, 10.1, 1e6, 0.5) for i, (x, y) in enumerate(pairs)], PRED)


def test_constant_predictions(spark):
    p = made(spark, [(1.0, float(i)) for i in range(60)])
    row = evaluate.global_ic(p).first()
    assert row.ic is None and row.rank_ic is None
    assert evaluate.validation_summary(p).first().ic == 0.0
    assert [r.decile for r in evaluate.decile_report(p).collect()] == [0]
    assert evaluate.decile_table(p).filter("decile = 1 or decile = 10").count() == 2


def test_heavy_ties_fall_in_two_deciles(spark):
    p = made(spark, [(float(i % 4), float(i)) for i in range(400)])
    table = evaluate.decile_table(p).collect()
    assert sum(r.n for r in table) > 400
    edges = np.percentile([i % 4 for i in range(400)], range(10, 100, 10))
    assert {r.decile: r.n for r in table}[1] == sum(i % 4 <= edges[0] for i in range(400))
    assert sum(r.n for r in evaluate.decile_report(p).collect()) == 400


def test_no_losses(spark):
    p = made(spark, [(float(i), float(i + 1)) for i in range(100)])
    assert all(r.payoff == float("inf") for r in evaluate.decile_table(p).collect())
    assert risk.trade_stats(p.withColumn("pnl_bp", F.col("target_bp"))).first().mean_loss == 1.0


def test_quantiles_and_ranks(spark):
    draw = random.Random(2)
    values = [float(draw.randrange(50)) for _ in range(501)] + [7.0] * 300
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    shares = [0.0, 0.01, 0.33, 0.5, 0.9, 1.0]
    assert quantiles(df, "x", shares) == pytest.approx(list(np.percentile(values, [100 * s for s in shares])))
    got = {r.x: r.r for r in with_average_rank(df, "x", "r").filter("x is not null").distinct().collect()}
    order = sorted(values)
    for v, rank in got.items():
        assert rank == (order.index(v) + 1 + order.index(v) + order.count(v)) / 2
    assert quantiles(df.limit(0), "x", [0.5]) == [None]


def test_locked_exit_waits(spark):
    rows = [("600000.SH", f"2024010{d}", 0, 1.0, -100.0, 10.0, 10.0 if d in (2, 3) else 10.1, 1e6, 0.5) for d in (1, 2, 3, 5)] + [("600001.SH", "20240101", 0, 1.0, -50.0, 10.0, 10.1, 1e6, 0.5)]
    p = spark.createDataFrame(rows, PRED)
    out = {(r.symbol, r.date): (r.exit_date, r.hold_days) for r in selection.exits(p.filter("date = '20240101'"), p, ["shard_idx"]).collect()}
    assert out[("600000.SH", "20240101")] == ("20240105", 3)
    assert out[("600001.SH", "20240101")] == ("20240102", 1)


def test_board_cap(spark):
    t = spark.createDataFrame([("300001.SZ", -3200.0, 1), ("600000.SH", -3200.0, 2), ("600000.SH", -500.0, 1)], "symbol string, target_bp double, hold_days int")
    out = sorted((r.capped_bp, r.exit_reason) for r in selection.trade_outcomes(t).collect())
    assert out == [(-2000.0, "trailing_stop"), (-2000.0, "trailing_stop"), (-500.0, "natural_horizon")]


def test_curve_and_break_even(spark):
    returns = [0.01, -0.02, 0.005, -0.01, 0.03]
    df = spark.createDataFrame([("a", f"d{i}", r) for i, r in enumerate(returns)] + [("dead", "d0", -1.0), ("dead", "d1", 0.5)], "config string, date string, ret double")
    curve = risk.equity_curve(df)
    nav = np.cumprod(1 + np.array(returns))
    got = [r.nav for r in curve.filter("config = 'a'").orderBy("date").collect()]
    assert got == pytest.approx(list(nav))
    assert [r.nav for r in curve.filter("config = 'dead'").collect()] == [0.0, 0.0]
    row = risk.risk_metrics(curve).filter("config = 'a'").first()
    assert row.max_drawdown == pytest.approx((nav / np.maximum.accumulate(nav) - 1).min()) and row.underwater_days == 3
    trades = spark.createDataFrame([(5.5,), (25.0,)], "pnl_bp double")
    assert risk.break_even(trades).first().break_even == 41  # 15.25 + 25, to the next whole cost
    assert risk.break_even(trades.limit(0)).first().break_even == 25
    assert risk.break_even(trades.selectExpr("pnl_bp - 100 as pnl_bp")).first().break_even == 25
    assert risk.break_even(trades.selectExpr("pnl_bp + 100 as pnl_bp")).first().break_even == 100


def test_edges_of_risk(spark):
    """A loss on the first day is no drawdown; a rising curve has Sortino and Calmar 0; a pnl of 0 is neither won nor lost."""
    df = spark.createDataFrame([("a", "d0", -0.1), ("a", "d1", -0.05), ("a", "d2", 0.2), ("up", "d0", 0.1), ("up", "d1", 0.1)], "config string, date string, ret double")
    rows = {r.config: r for r in risk.risk_metrics(risk.equity_curve(df)).collect()}
    assert rows["a"].max_drawdown == pytest.approx(-0.05) and rows["a"].underwater_days == 1
    assert (rows["up"].sortino, rows["up"].calmar, rows["up"].max_drawdown) == (0, 0, 0)
    stats = lambda *pnl: risk.trade_stats(spark.createDataFrame([(x,) for x in pnl], "pnl_bp double")).first()
    assert stats(0.0, 10.0)[1:] == (0.5, 10.0, 1.0, 10.0, float("inf"))
    assert stats(0.0, 30.0, -10.0, -20.0)[1:] == (0.25, 30.0, 15.0, 2.0, pytest.approx(1.0))


def test_edges_of_spreads(spark):
    """Where high predictions lose, nothing is covered and no deviation is enough."""
    falling = spark.createDataFrame([(float(i), -100.0 * i) for i in range(100)], "pred_bp double, target_bp double")
    row = evaluate.sentinel(falling).first()
    assert row.spread < 0 and not row.covered and row.error == row.warn == row.healthy == float("inf")
    row = evaluate.spread_calibration(falling).first()
    assert row.ratio < 0 and row.cost_threshold == row.safe_threshold == 0
    row = evaluate.sentinel(spark.createDataFrame([(float(i), 100.0 * i) for i in (0, 0, 0, 0, 0, 0, 0, 1, 2, 3)], "pred_bp double, target_bp double")).first()
    assert row.spread == pytest.approx(300) and row.covered  # equal edges fell together


def test_daily_top_counts(spark):
    for n, wanted in ((3, 1), (10, 1), (11, 2), (100, 19), (400, 50)):
        rows = spark.createDataFrame([("d", f"s{i}", float(i)) for i in range(n)], "date string, symbol string, pred_bp double")
        assert selection.daily_top(rows, ["symbol"]).count() == wanted


def test_shares(spark):
    code = spark.createDataFrame([("689009.SH",), ("302132.SZ",), ("688981.SH",)], "symbol string")
    assert [r.symbol for r in code.filter(book.is_share(F.col("symbol"))).orderBy("symbol").collect()] == ["688981.SH", "689009.SH"]


def test_scorecard_and_checks(spark):
    targets = spark.createDataFrame([("a", 1.0, "ge"), ("b", 1.0, "lt")], "metric string, target double, comparator string")
    card = risk.scorecard(spark.createDataFrame([("a", 2.0)], "metric string, value double"), targets)
    assert {r.metric: r.met for r in card.collect()} == {"a": True, "b": False}
    stats = spark.createDataFrame([(3.1, 1.6), (3.1, 1.3), (1.9, 9.0)], "asymmetry double, profit_factor double")
    assert [r.verdict for r in risk.verdict(stats).collect()] == ["PASS", "CONDITIONAL", "FAIL"]
    empty = made(spark, [])
    assert {r.status for r in quality.check_predictions(empty).filter("check = 'rows'").collect()} == {"STOP"}
    missing = quality.check_predictions(empty.drop("target_bp")).filter("check = 'columns missing'").first()
    assert missing.value == 1 and missing.status == "STOP"


def test_splits_are_disjoint(spark):
    p = spark.createDataFrame([(f"d{i:02d}", i) for i in range(20) for _ in range(3)], "date string, shard_idx long")
    out = layout.temporal_split(p, embargo=2).select("part", "date").distinct().collect()
    train, valid = {r.date for r in out if r.part == "train"}, {r.date for r in out if r.part == "validation"}
    assert not train & valid and len(train) == 14 and len(valid) == 2


def test_shards_cover_the_spine(spark):
    days = spark.createDataFrame([("d1", 1), ("d2", 500), ("d3", 3)], "date string, n long")
    ranges = layout.shard_ranges(days, 10)
    assert [(r.first_shard, r.last_shard) for r in ranges.orderBy("date").collect()] == [(0, 0), (0, 8), (9, 9)]
    assert [r.date for r in layout.shard_dates(ranges, 10).orderBy("shard").collect()] == ["d2"] * 9 + ["d3"]
