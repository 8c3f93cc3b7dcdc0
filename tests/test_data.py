"""Topology, scoring, tar shards, layouts and the stream."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clock, layout, scoring, ticks, topology
from tidemark.sources import readers, writers
from tidemark.streaming.clock_stream import volume_bar_stream
from tests.test_market import PARAMETERS, TICK, draw_ticks


def brute_heights(points):
    """Kruskal's algorithm."""
    n = len(points)
    edges = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(n) for j in range(i))
    part, out = list(range(n)), []
    for d, i, j in edges:
        if part[i] != part[j]:
            out.append(d)
            part = [part[i] if p == part[j] else p for p in part]
    return out


def test_merge_heights():
    points = np.random.default_rng(1).normal(size=(12, 3))
    assert sorted(topology.merge_heights(points)) == pytest.approx(sorted(brute_heights(points)))


def test_landscape_edges():
    assert not topology.landscape(np.zeros((1, 3))).any()
    assert topology.landscape(np.ones((5, 3))).max() < 1e-6
    assert topology.landscape(np.random.default_rng(0).normal(size=(2, 3)), velocity=5.0).shape == (3, 20)
    assert not topology.landscape(np.random.default_rng(0).normal(size=(2, 3)), velocity=5.0).any()


def test_hurst():
    assert topology.local_hurst(np.ones(20)) == 0.5 and topology.local_hurst(np.arange(4.0)) == 0.5
    assert topology.local_hurst(np.arange(40.0)) == pytest.approx(1.0)
    walk = np.cumsum(np.random.default_rng(3).normal(size=400))
    lags = np.arange(2, 10)
    want = np.polyfit(np.log(lags), np.log([np.sqrt(np.mean((walk[k:] - walk[:-k]) ** 2)) for k in lags]), 1)[0]
    assert topology.local_hurst(walk) == pytest.approx(want)


def test_score(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k long, features array<double>")
    out = {r.k: (r.pred_bp, r.z_sparsity) for r in scoring.score(df, scoring.LinearModel([0.001, 0.0]), ["k"]).collect()}
    assert out[1] == pytest.approx((10.0, 1.0)) and out[2] == (None, None)
    assert scoring.score(df.limit(0), scoring.LinearModel([1.0, 1.0]), ["k"]).count() == 0


def test_tar_shards(spark, tmp_path):
    with tarfile.open(tmp_path / "good.tar", "w") as shard:
        array = io.BytesIO()
        np.save(array, np.arange(6, dtype=np.float32).reshape(2, 3))
        for name, data in (("k1.npy", array.getvalue()), ("k1.json", b'{"symbol": "a"}')):
            member = tarfile.TarInfo(name)
            member.size = len(data)
            shard.addfile(member, io.BytesIO(data))
    with tarfile.open(tmp_path / "none.tar", "w"):
        pass
    (tmp_path / "bad.tar").write_bytes(b"garbage" * 100)
    (tmp_path / "zero.tar").write_bytes(b"")
    rows = readers.read_tar_shards(spark, str(tmp_path)).collect()
    assert [(r.key, r.shape, r.values, r.meta) for r in rows if not r.corrupt] == [("k1", [2, 3], [0, 1, 2, 3, 4, 5], '{"symbol": "a"}')]
    assert [r.path.rsplit("/")[-1] for r in rows if r.corrupt] == ["bad.tar"]


def test_readers(spark, tmp_path):
    lake = str(tmp_path / "lake")
    spark.createDataFrame([("a", 1)], "symbol string, x int").coalesce(1).write.parquet(lake)
    assert readers.read_lake(spark, lake, ["symbol", "missing"]).columns == ["symbol", "file_date"]
    with pytest.raises(ValueError, match="missing"):
        readers.require_columns(spark.range(1), ["missing"])
    (tmp_path / "c.json").write_text('{"a": 1.5, "__GLOBAL__": 0.9}')
    assert [(r.symbol, r.c) for r in readers.read_registry(spark, str(tmp_path / "c.json")).collect()] == [("a", 1.5)]
    assert readers.global_friction(spark, str(tmp_path / "c.json"), 0.842) == 0.9
    writers.write_registry(spark.createDataFrame([("a", 1.23456789)], "symbol string, c double"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().c == 1.234568
    writers.write_curve(spark.createDataFrame([("d", 1.0)], "date string, nav double"), str(tmp_path / "e"))
    assert readers.read_equity(spark, str(tmp_path / "e"), "date string, nav double").first().nav == 1.0


def test_sorted_lake_and_resume(spark, tmp_path):
    path = str(tmp_path / "sorted")
    rows = spark.createDataFrame(draw_ticks(4), TICK)
    writers.write_sorted(rows.filter("date < '20240105'"), path, 3)
    writers.write_sorted(rows, path, 3, done=spark.read.parquet(path))
    back = spark.read.parquet(path)
    assert back.count() == rows.count() and layout.unsorted_rows(back).first().unsorted == 0


def test_subset(spark, tmp_path):
    rows = spark.createDataFrame([(s, "20240102", i, float(i)) for s in ("b", "a", "c") for i in (2, 1)], "symbol string, date string, timestamp long, price double")
    writers.write_subset(rows, ["b", "a"], str(tmp_path / "some"))
    assert [(r.symbol, r.timestamp) for r in spark.read.parquet(str(tmp_path / "some")).orderBy(F.input_file_name(), F.col("_metadata.row_index")).collect()] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    writers.write_subset(rows, ["x"], str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = draw_ticks(6, days=6)
    t = spark.createDataFrame(rows, TICK)
    lake, out = str(tmp_path / "lake"), str(tmp_path / "out")
    for (date,) in sorted({(r[1],) for r in rows}):
        t.filter(F.col("date") == date).coalesce(1).write.mode("append").parquet(lake)
    late = [("600000.SH", "20240101", 1, 10.0, 9999.0, "B")]
    spark.createDataFrame(late, TICK).coalesce(1).write.mode("append").parquet(lake)
    stream = volume_bar_stream(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(lake), **PARAMETERS)
    for _ in range(2):  # the second start goes on from the checkpoint and finds nothing new
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out)
    batch = clock.volume_bars(t, ticks.rolling_macro(ticks.daily_stats(t), **PARAMETERS))
    key = lambda df: sorted((r.symbol, r.bar_id, r.date, r.seq, round(r.vwap, 9), round(r.delta_p, 9)) for r in df.collect())
    assert key(got.filter("not late")) == key(batch)
    assert [(r.symbol, r.volume) for r in got.filter("late").collect()] == [("600000.SH", 9999.0)]
