"""Streams over days of few ticks, and mean prices on an edge of the rounding."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from tests.test_stream import one_by_one
from tidemark.operators import clock
from tidemark.streaming.clock_stream import VolumeClock

STREAM = {"days": 5, "share": 0.5, "least": 20.0, "first_threshold": 100.0, "first_volume": 150.0, "first_range": 0.5}


def test_a_day_of_the_stream_makes_no_table(monkeypatch):
    """Days of two ticks: each gives the bars of the definition, and none makes a table of pandas, which cost more than all the rest."""
    draw, processor, state = np.random.default_rng(1), VolumeClock(STREAM), clock.Clock()
    s = {"v_d": 150.0, "sigma_d": 0.5, "threshold": 100.0, "date": None, "volumes": [], "ranges": []}
    rows = np.empty(200, [("date", "O"), ("seq", "i8"), ("price", "f8"), ("vol_tick", "f8")])
    rows["date"], rows["seq"] = [f"{i // 2:08d}" for i in range(200)], range(200)
    rows["price"], rows["vol_tick"] = 10 + np.round(draw.random(200), 2), np.where(draw.random(200) < 0.1, np.nan, np.round(draw.exponential(20, 200), 2))

    def refused(*_, **__):
        raise AssertionError("a table for a day")

    monkeypatch.setattr(pd.DataFrame, "__init__", refused)
    monkeypatch.setattr(pd, "concat", refused)
    found, threshold = [], []
    for i in range(0, 200, 2):
        found += processor._day(s, state, rows["date"][i], rows[i : i + 2]).tolist()
        threshold += [s["threshold"]] * 2
    want = list(one_by_one(rows["price"], np.nan_to_num(rows["vol_tick"]), threshold))
    assert len(want) > 50 and [(b[2], *b[4:7]) for b in found] == want and [b[0] for b in found] == list(range(len(want)))


@pytest.mark.parametrize("name", ["event_bars", "stream_bars", "stream_windows"])
def test_a_mean_price_on_an_edge(spark, tmp_path, name):
    """The first bar's mean price is 10.87405445: as the decimal text says it goes up to 10.8740545, the SQL, which rounds the scaled double, says 10.8740544."""
    value = [55.66, 104.34] + [150.0 + i for i in range(14)]
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=i), 1, "view", v, "") for i, v in enumerate(value)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
    assert len(want) >= 8 and sorted(got) == sorted(want)
