"""Counts from footers, scoring as a stream, autocorrelation by arrays, readers and writers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators import calibrate, layout, quality, scoring
from tidemark.sources import readers, writers


def test_counts_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id % 3 as day", "id", "cast(id as string) as text").write.partitionBy("day").parquet(path)
    by_day = layout.partition_counts(spark, path, ["day"])
    assert {r.day: r.n for r in by_day.collect()} == {0: 334, 1: 333, 2: 333}
    text = by_day._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in text and "PushedGroupBy: [day]" in text and "text" not in text
    assert layout.partition_counts(spark, path, []).first().n == 1000
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""
    files = readers.listing(spark, path, "*.parquet")
    (tmp_path / "t" / "other.bin").write_bytes(b"no parquet at all")
    both = files.select("path").unionByName(spark.createDataFrame([(str(tmp_path / "t" / "other.bin"),)], "path string"))
    counts = {r.path: r.n for r in layout.footer_counts(both).collect()}
    assert counts.pop(str(tmp_path / "t" / "other.bin")) is None and sum(counts.values()) == 1000


def no_model(features):
    raise ValueError("no model")


def test_each_file_is_scored_once(spark, tmp_path):
    lake, out, state = (str(tmp_path / n) for n in ("lake", "out", "state"))
    table = lambda lo, hi: spark.range(lo, hi).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"))
    model = scoring.LinearModel([0.001, 0.0])
    stream = lambda: spark.readStream.schema("id long, features array<double>").parquet(lake)
    table(0, 10).write.parquet(lake)
    scoring.score_stream(stream(), model, ["id"], out, state)
    scoring.score_stream(stream(), model, ["id"], out, state)  # nothing new
    assert spark.read.parquet(out).count() == 10
    table(10, 15).write.mode("append").parquet(lake)
    with pytest.raises(Exception, match="no model"):
        scoring.score_stream(stream(), no_model, ["id"], out, state)
    scoring.score_stream(stream(), model, ["id"], out, state)
    rows = spark.read.parquet(out).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(15)) and rows[12].pred_bp == pytest.approx(120.0)


def test_autocorrelation_is_one_shuffle(spark):
    draw = np.random.default_rng(4)
    series = {"a": draw.normal(size=50).cumsum(), "b": np.ones(9), "c": draw.normal(size=3)}
    rows = [(s, i, float(v)) for s, x in series.items() for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "symbol string, idx long, efficiency double")
    found = calibrate.autocorrelation(table, lags=5)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.symbol, r.lag): r.acf for r in found.collect()}
    assert len(got) == 18
    for s, x in series.items():
        d = x - x.mean()
        for k in range(6):
            want = (d[: max(len(d) - k, 0)] * d[k:]).sum() / (len(d) * d.var()) if d.var() > 1e-300 else 0.0
            assert got[s, k] == pytest.approx(want, abs=1e-12)


def test_friction_plans_without_a_job(spark):
    table = spark.createDataFrame([], "symbol string, date string, seq long, price double, vol_tick double, bs_flag string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    calibrate.friction(table)
    assert list(tracker.getJobIdsForGroup("plan")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_more_readers(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, f"s{i}")], "x int, symbol string").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    assert sorted(r.x for r in readers.read_files(spark, [str(tmp_path / "p0"), str(tmp_path / "p2")]).collect()) == [0, 2]
    assert readers.existing(spark.range(1), ["id", "missing"]).columns == ["id"]
    assert sorted(r.path.rsplit(".")[-1] for r in readers.listing(spark, str(tmp_path), "*.parquet").collect()) == ["parquet"] * 3
    assert [r.x for r in readers.first_rows(readers.read_lake(spark, str(tmp_path)), ["x"], 2).collect()] == [0, 1]
    (tmp_path / "pred.json").write_text('[{"date": "d", "pred_bp": 1.5}, {"date": "e", "pred_bp": null}]')
    assert [(r.date, r.pred_bp) for r in readers.read_predictions(spark, str(tmp_path / "pred.json")).collect()] == [("d", 1.5), ("e", None)]


def test_more_writers(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "a", 1.23456), ("d2", "b", 2.0), ("d1", "c", None)], "date string, symbol string, pred_bp double")
    for name, write in {"predictions": writers.write_predictions, "json": writers.write_json, "samples": writers.write_samples}.items():
        write(rows, str(tmp_path / name))
    back = readers.read_predictions(spark, str(tmp_path / "predictions"))
    assert sorted((str(r.date), r.symbol) for r in back.collect()) == [("d1", "a"), ("d1", "c"), ("d2", "b")]
    writers.write_predictions(rows.limit(1), str(tmp_path / "predictions"))
    assert spark.read.parquet(str(tmp_path / "predictions")).count() == 4
    assert sorted(r.pred_bp for r in spark.read.json(str(tmp_path / "json")).collect() if r.pred_bp) == [1.23456, 2.0]
    assert sorted(r.pred_bp for r in spark.read.json(str(tmp_path / "samples")).collect() if r.pred_bp) == [1.2346, 2.0]
    writers.write_trades(rows, str(tmp_path / "trades"), ["symbol"], most=2)
    assert sorted(r.symbol for r in spark.read.json(str(tmp_path / "trades")).collect()) == ["a", "b"]


def test_chunks_and_reports(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i,)], "x int").coalesce(1).write.parquet(str(tmp_path / "chunks" / f"chunk_{i}.parquet"))
    spark.createDataFrame([(9,)], "x int").write.parquet(str(tmp_path / "chunks" / "other.parquet"))
    assert sorted(r.x for r in readers.read_chunks(spark, str(tmp_path / "chunks")).collect()) == [0, 1, 2]
    report = tmp_path / "run" / "report"
    report.mkdir(parents=True)
    (report / "results.json").write_text('{"trades": 5,\n "sharpe": 0.5}')
    assert readers.read_report(spark, str(report)).columns == ["sharpe", "trades"]
    (tmp_path / "run" / "meta.json").write_text('{"sparsity": 1.5}')  # beside the report's folder: the second place
    assert readers.read_report(spark, str(report)).first().asDict() == {"sharpe": 0.5, "trades": 5, "sparsity": 1.5}
    (report / "meta.json").write_text('{"sparsity": 2.5, "trades": 7}')  # the first place goes before; the report's own values stay
    assert readers.read_report(spark, str(report)).first().asDict() == {"sharpe": 0.5, "trades": 5, "sparsity": 2.5}


def test_worker_outputs_are_one_table(spark, tmp_path):
    for i, (name, kind) in enumerate([("x", "int"), ("x", "int"), ("y", "int")]):
        spark.createDataFrame([(i,)], f"{name} {kind}").write.parquet(str(tmp_path / f"w{i}"))
    parts = [spark.read.parquet(str(tmp_path / f"w{i}")) for i in range(3)]
    assert sorted(r.x for r in readers.united(parts[:2]).collect()) == [0, 1]
    with pytest.raises(ValueError, match="table 1 has other columns: x, y"):
        readers.united([parts[0], parts[2]])


def tensor(t=2, s=3, reserved=0.0, close=1.0, bid=9.0):
    return [[[bid, 1.0, 10.0, 2.0, close, reserved, 0.0, 0.5, 100.0, 0.1] for _ in range(s)] for _ in range(t)]


@pytest.mark.parametrize(("samples", "failed"), [
    ([tensor(), tensor()], set()), ([tensor(), tensor(s=2)], {"shape"}), ([tensor(reserved=1.0)], {"reserved all 0"}), ([tensor(close=0.0)], {"close not all 0"}),
    ([tensor(bid=float("nan"))], {"finite", "bids over 0", "bids in range"}), ([tensor(bid=11.0)], {"quotes not crossed"}), ([tensor(), None], {"shape"}),
])
def test_tensor_checks(spark, samples, failed):
    table = spark.createDataFrame([(s,) for s in samples], "tensor array<array<array<float>>>")
    assert {r.check for r in quality.check_tensors(table, (2, 3, 10)).collect() if not r.met} == failed
    doubles = table.select(table.tensor.cast("array<array<array<double>>>").alias("tensor"))
    assert {r.check for r in quality.check_tensors(doubles, (2, 3, 10)).collect() if not r.met} == failed | {"dtype"}


def test_samples_through_a_function(spark):
    table = spark.createDataFrame([("k", [1.0, 2.0]), ("l", None)], "key string, values array<double>")
    out = scoring.mapped_samples(table, doubled, "key string, total double").collect()
    assert [tuple(r) for r in out] == [("k", 6.0)]
    row = scoring.with_defaults(spark.createDataFrame([("k", None)], "key string, c double")).first()
    assert (row.c, row.target_bp, row.date) == (0.842, 0.0, "")
    quote = spark.createDataFrame([(tensor(),)], "tensor array<array<array<float>>>").select(book.last_quote(F.col("tensor")).alias("q")).first().q
    assert (quote.bid_p1, quote.ask_p1, quote.macro_v_d) == (9.0, 10.0, 100.0)


def doubled(sample):
    return None if sample["values"] is None else {"key": sample["key"], "total": float(sum(sample["values"]) * 2)}


def test_folders_are_reconciled(spark, tmp_path):
    for folder, files in {"a": {"x.tar": 3, "y.tar": 5, "only.tar": 1}, "b": {"x.tar": 3, "y.tar": 4, "more.tar": 2}}.items():
        (tmp_path / folder).mkdir()
        for name, size in files.items():
            (tmp_path / folder / name).write_bytes(b"x" * size)
    found = layout.reconciled(*(readers.listing(spark, str(tmp_path / folder), "*.tar") for folder in "ab")).collect()
    assert {(r.name, r.local_length, r.remote_length, r.status) for r in found} == {("y.tar", 5, 4, "size differs"), ("only.tar", 1, None, "missing"), ("more.tar", None, 2, "extra")}
    checks = {r.check: r.met for r in quality.check_files(readers.listing(spark, str(tmp_path / "a")), least_files=3, small=2).collect()}
    assert checks == {"files": True, "no empty file": True, "small files": False, "total size": True}


def test_sampled_files_are_the_same_again(spark):
    listing = spark.range(300).selectExpr("concat('f', id % 250) as path")
    first = sorted(r.path for r in layout.sampled_files(listing, 0.04).collect())
    assert len(set(first)) == 10 and first == sorted(r.path for r in layout.sampled_files(listing.repartition(3), 0.04).collect())
    assert layout.sampled_files(listing.limit(1), 0.01).count() == 1 and first != sorted(r.path for r in layout.sampled_files(listing, 0.04, seed=8).collect())


def test_dates_and_numbers(spark):
    row = spark.range(1).select(
        book.date_or_time_prefix(F.lit(None).cast("string"), F.lit("2024-01-05 09:30:00")).alias("a"), book.date_or_time_prefix(F.lit("d"), F.lit("2024")).alias("b"),
        book.is_bad_number(F.lit(float("inf"))).alias("c"), book.is_bad_number(F.lit(1.0)).alias("d"), book.date_of_file(F.lit("20240105_x.parquet")).cast("string").alias("e"),
    ).first()
    assert tuple(row) == ("2024-01-05", "d", True, False, "2024-01-05")
