"""Edges of roundings, sums in order and layouts of large tables."""

import math
import random
import re
import tarfile

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__
from tests.test_market import TICK
from tidemark.functions import book
from tidemark.operators import clock, evaluate, layout, quality, ticks
from tidemark.plans import common
from tidemark.sources import readers, tars, writers
from tidemark.streaming.clock_stream import VolumeClock

FOLDER = "/root/testdata/sf0.001"


def test_coefficients_on_an_edge_of_four_decimals(spark):
    """As many distinct values of four decimals as the SQL finds: 0.30015 as a double is under the edge, its shortest text on it."""
    found = [0.30015, 0.3001, 0.30065, 0.3006, 0.30115, 0.3011, 0.5]
    registry = spark.createDataFrame([(c,) for c in found], "c double")
    value = quality.check_friction(registry).filter("check = 'c varies'").first()["value"]
    assert value == duckdb.sql(f"select count(distinct round(c, 4)) from (select unnest({found}::double[]) as c)").fetchall()[0][0] == 4


def cents(seed, symbols=2, days=8, a_day=60):
    """Ticks with volumes in cents, whose double sums depend on the order of adding."""
    draw, rows = random.Random(seed), []
    for s in range(symbols):
        rows += [(f"60000{s}.SH", f"202401{d + 1:02d}", d * a_day + i, 10 + draw.randrange(500) / 100, draw.randrange(1, 20_000) / 100, "B") for d in range(days) for i in range(a_day)]
    return rows


def in_turn(rows):
    sums = {}
    for symbol, date, _, _, volume, _ in sorted(rows):
        sums[symbol, date] = sums.get((symbol, date), 0.0) + volume
    return sums


def test_daily_volumes_are_added_in_order(spark):
    rows = cents(1)
    shuffled = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), TICK).repartition(5)
    want = in_turn(rows)
    assert {(r.symbol, r.date): r.volume for r in ticks.daily_stats(shuffled, in_order=True).collect()} == want


def test_the_stream_adds_in_order():
    """A day's volume, in two triggers, and the mean over twenty days are what adding one by one gives."""
    rows = cents(3, symbols=1, days=22)
    want = list(in_turn(rows).values())
    processor, s = VolumeClock({"days": 20, "share": 0.5, "least": 1.0, "first_volume": 1.0}), {"v_d": 1.0, "sigma_d": 1.0, "threshold": 1e9, "date": None, "volumes": [], "ranges": []}
    table, state = pd.DataFrame(rows, columns=["symbol", "date", "seq", "price", "vol_tick", "bs_flag"]), clock.Clock()
    for date, day in table.groupby("date"):
        for half in (day[:23], day[23:]):
            processor._day(s, state, date, half)
    assert s["volumes"] == want[-21:-1]
    mean = 0.0
    for volume in s["volumes"]:
        mean += volume
    assert s["v_d"] == mean / 20


def tar_samples(spark, n):
    return spark.range(n).selectExpr("concat('600000_SH_', lpad(cast(id as string), 9, '0')) as key", "array(cast(id as float), cast(id * 2 as float)) as values", "array(2) as shape", """concat('{"id": ', id, '}') as meta""")


def test_small_shards_share_a_task(spark, tmp_path):
    """100 shards of 3 samples: one task reads them, also where each is cut in two; shorter tasks give the same samples."""
    folder = str(tmp_path / "t")
    writers.write_tar_shards(tar_samples(spark, 300).coalesce(1), folder, per_shard=3)
    assert len(tars.files_below(folder, "*.tar")) >= 100
    read = lambda **options: readers.read_tar_ranges(spark, folder, **options)
    rows = lambda df: sorted((r.key, tuple(r["values"]), tuple(r["shape"]), r.meta) for r in df.collect())
    want = [(f"600000_SH_{i:09d}", (float(i), float(i * 2)), (2,), f'{{"id": {i}}}') for i in range(300)]
    assert read(split_bytes=4000).rdd.getNumPartitions() == 1
    for split, task in ((4000, 1 << 20), (1000, 3000), (1000, 1000), (1 << 20, 20_000)):
        assert rows(read(split_bytes=split, task_bytes=task)) == want


def test_headers_as_tarfile_writes_them():
    for name in ("a.npy", "b" * 100, "c" * 101, "d/\u00e9.json"):
        for size in (0, 7, 8**7, 8**11 - 1, 8**11):
            member = tarfile.TarInfo(name)
            member.size = size
            assert tars.header(name, size) == member.tobuf(tarfile.GNU_FORMAT)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_statistics_order_no_date_in_one_task(spark):
    """Ranks come from counts of values in ranges; rows aren't sorted or dealt by date. A NULL date is a date like any other."""
    rows = spark.range(4000).selectExpr("case when id % 3 < 2 then cast(id % 3 as string) end as date", "cast(id * 7 % 11 as double) as pred_bp", "cast(id * 5 % 13 as double) as target_bp").repartition(7)
    for found in (evaluate.daily_ic(rows, 10), evaluate.daily_cross_section(rows, 10)):
        for line in plan(found).splitlines():
            assert not ("Window" in line and "rank(" in line) and "SortMergeJoin" not in line
    table = rows.toPandas()
    table["date"] = table["date"].fillna("none")
    ranked = {r.date or "none": r for r in evaluate.daily_ic(rows, 10).collect()}
    for date, day in table.groupby("date"):
        assert ranked[date].n == len(day)
        assert abs(ranked[date].rank_ic - day["pred_bp"].rank().corr(day["target_bp"].rank())) < 1e-12


def test_large_sorted_layouts_get_more_files(spark, tmp_path, monkeypatch):
    """Files follow the rows; what is unsorted is found within blocks of a file and where two blocks meet."""
    monkeypatch.setattr(layout, "FILE_ROWS", 100)
    monkeypatch.setattr(layout, "BLOCK_ROWS", 7)
    path, broken = str(tmp_path / "sorted"), str(tmp_path / "broken")
    rows = spark.createDataFrame(cents(4), TICK)
    writers.write_sorted(rows, path, 2)
    back = spark.read.parquet(path)
    assert back.select("_metadata.file_path").distinct().count() > 5
    assert tuple(layout.unsorted_rows(back).first()) == (0, rows.count())
    spark.createDataFrame([(f"{i % 10}",) for i in range(100)], "symbol string").coalesce(1).write.parquet(broken)
    assert tuple(layout.unsorted_rows(spark.read.parquet(broken)).first()) == (9, 100)


def test_the_manifold_is_made_of_narrow_rows_by_compiled_code(spark, capsys):
    """Rows lie in order without their book, no window is gathered into an array, no function over arrays is interpreted, and no generated method is too long (8000 bytes) for the JVM to compile."""
    made = __spark_entry__.queries()["window_manifold"](spark, FOLDER)
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in text and "collect_list" not in text
    assert "bid_p10" not in text.split("Sort [", 1)[1]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        __spark_entry__.queries()["window_manifold"](spark, FOLDER).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_the_flat_manifold_is_the_one_of_windows(spark):
    """Two levels, windows of three rows, a remainder of two, missing prices and volumes: rows hold what the nested windows do."""
    draw = random.Random(4)
    rows = [
        (s, i, None if i == 4 else draw.uniform(9, 11), draw.uniform(-5e3, 5e3), 300.0, 0.4, *[None if i == 7 and j == 5 else draw.uniform(1, 99) for j in range(8)]) for s in ("a", "b") for i in range(11 if s == "a" else 2)
    ]
    sides = ", ".join(f"{side}{i} double" for i in (1, 2) for side in clock.SIDES)
    placed = clock.tumbling(spark.createDataFrame(random.Random(5).sample(rows, len(rows)), f"symbol string, seq int, close double, q_hat double, v_d double, sigma_d double, {sides}"), ["symbol"], "seq", 3, {"first": "close"})
    names, keys, macro = [f"x{i}" for i in range(8)], ["symbol", "window", "bar"], ("v_d", "sigma_d")
    got = {tuple(r[:4]): tuple(r[4:]) for r in clock.flat_manifold(placed, keys, names, 2, macro=macro).collect()}
    bars = placed.select("symbol", "window", F.struct("seq", "close", "q_hat", *macro, book.pack_book(2).alias("lob")).alias("bar")).groupBy("symbol", "window").agg(F.sort_array(F.collect_list("bar")).alias("bars"))
    want = {(r.symbol, r.window, i, j): tuple(x) for r in bars.select("symbol", "window", book.manifold(F.col("bars"), macro=macro).alias("m")).collect() for i, bar in enumerate(r.m) for j, x in enumerate(bar)}
    assert got == want and set(got) == {("a", w, i, j) for w in range(3) for i in range(3) for j in range(2)}
    assert all(x[4] == 0.0 for (_, _, i, _), x in got.items() if i == 0)


def test_rounding_as_sql_does(spark):
    """Halves, the double next to one, large values, infinities: equal to DuckDB, to the sign of zero."""
    draw = random.Random(6)
    found = [0.0, -0.0, 0.5e-7, -0.5e-7, 1.5e-7, 2.5e-7, 0.49999999999999994e-7, 0.30015, -0.00000005, 2.0**52, 2.0**52 / 1e7, 450359962.73704955, 1e300, -1.7e308, math.inf, -math.inf, math.nan]
    found += [draw.randrange(-(10**9), 10**9) / 2 / 1e7 for _ in range(2000)] + [draw.uniform(-100, 100) for _ in range(2000)]
    for digits in (7, 4):
        got = [r.x for r in common.rounded_as_sql(spark.createDataFrame(list(enumerate(found)), "i int, x double"), digits).orderBy("i").collect()]
        want = [x for (x,) in duckdb.sql(f"select round(x, {digits}) + 0.0 from (select unnest(range({len(found)})) as i, unnest({[str(x) for x in found]}::double[]) as x) order by i").fetchall()]
        assert [(x, math.copysign(1, x)) for x in got if x == x] == [(x, math.copysign(1, x)) for x in want if x == x] and [x == x for x in got] == [x == x for x in want]
    assert common.rounded_as_sql(spark.createDataFrame([(None,)], "x double")).first().x is None
