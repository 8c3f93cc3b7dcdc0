"""What the physical plans must and must not hold."""

from pyspark.sql import functions as F

from tidemark.operators import clock, evaluate, ticks
from tidemark.sources import fixtures

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_symbols_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "t")
    fixtures.ticks(spark, FOLDER, 1).write.parquet(path)
    text = plan(ticks.of_symbols(spark.read.parquet(path), ["600000.SH", "000001.SZ"]).select("price"))
    assert "In(symbol" in text and "ReadSchema: struct<symbol:string,price:double>" in text


def test_many_symbols_are_joined(spark):
    many = ticks.of_symbols(fixtures.ticks(spark, FOLDER, 1), [f"{600000 + i}.SH" for i in range(50)])
    assert "LeftSemi" in plan(many)


def test_only_needed_columns_are_read(spark):
    text = plan(ticks.daily_stats(fixtures.ticks(spark, FOLDER)))
    assert "l_comment" not in text and "ask_v10" not in text


def test_the_clock_adds_no_second_shuffle(spark):
    t = fixtures.ticks(spark, FOLDER, 1)
    macro = ticks.rolling_macro(ticks.daily_stats(t))
    text = plan(clock.volume_bars(t, macro))
    assert text.count("FlatMapGroupsInPandas") == 1
    kernel = text.split("FlatMapGroupsInPandas")[1]
    assert kernel.split("Join")[0].count("Exchange") <= 1  # none where the ticks already lie by symbol


def test_daily_ic_is_native(spark):
    text = plan(evaluate.daily_ic(fixtures.predictions(spark, FOLDER)))
    assert "Python" not in text and "Pandas" not in text


def test_global_ranks_use_no_single_partition_window(spark):
    from tidemark.functions.ranks import counted_values

    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    assert "SinglePartition" not in plan(counted_values(df, "x"))
