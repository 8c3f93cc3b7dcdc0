"""Queries of data quality, layouts, shards, scoring, topology and streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators import calibrate, clock, layout, quality, scoring, ticks, topology
from tidemark.plans import common, market
from tidemark.plans.common import P, TICKS
from tidemark.plans.market import DIGITS, HORIZON, LENGTH, STRIDE, r
from tidemark.sources import fixtures, readers, writers
from tidemark.sources.scratch import new_path, written
from tidemark.streaming.clock_stream import volume_bar_stream, volume_window_stream

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
SHARDS = 400
STATE_PARTITIONS, RUNS = 8, 4
STREAM = {"days": 5, "share": 0.5, "least": 20.0, "first_threshold": 100.0, "first_volume": 150.0}


def _bars(t: DataFrame) -> DataFrame:
    return market._bars(t).join(market._macro(t).select("symbol", "date", "v_d", "sigma_d"), ["symbol", "date"])


def _windows(t: DataFrame) -> DataFrame:
    return clock.windows(market._bars(t), ["close"], LENGTH, STRIDE, HORIZON)


def _all_checks(t: DataFrame) -> DataFrame:
    return quality.check_ticks(t, 1).unionByName(quality.check_bars(_bars(t))).unionByName(quality.check_friction(calibrate.friction(t, 10.0)))


def _shard_ranges(t: DataFrame) -> DataFrame:
    return layout.shard_ranges(layout.row_counts(t), SHARDS)


def _sorted_layout(t: DataFrame) -> DataFrame:
    path = new_path(t.sparkSession, "sorted")
    writers.write_sorted(t, path, 4)
    return layout.unsorted_rows(t.sparkSession.read.parquet(path))


def _points(t: DataFrame) -> DataFrame:
    """Windows of six ticks of a symbol's date as arrays of book points."""
    rows = clock.tumbling(topology.manifold(t), ["symbol", "date"], "seq", 6)
    point = F.array("micro", "imbalance", "depth")
    return rows.groupBy("symbol", "date", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))), lambda x: x["p"]).alias("points"))


def _found(t: DataFrame, velocity: float | None = None) -> DataFrame:
    return topology.window_landscapes(_points(t), ["symbol", "date", "window"], velocity=velocity)


def _by_cell(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each cell of the landscape tensor."""
    return df.select(*columns, F.posexplode("tda").alias("cell", "x"))


def _landscapes(t: DataFrame, velocity: float | None = None) -> DataFrame:
    return _by_cell(topology.daily_topology(_found(t, velocity), ["symbol", "date"]), "symbol", "date", "windows", "triggered_windows")


def _daily_features(t: DataFrame) -> DataFrame:
    return _by_cell(topology.daily_features(t, topology.daily_topology(_found(t), ["symbol", "date"]), 5), "symbol", "date", "open_price", "close_price", "triggered_windows")


def _check_tensors(t: DataFrame) -> DataFrame:
    bars = clock.with_book(market._volume_bars(t), t, market._macro(t), 10)
    found = clock.windows(bars, ["close", "delta_p", "v_d", "sigma_d", "lob"], LENGTH, STRIDE, HORIZON)
    return quality.check_tensors(found.select(book.sample_tensor(F.col("bars")).alias("tensor")), (LENGTH, 10, 10))


MODEL, SCORED = scoring.LinearModel([0.1, -0.2, 0.3, 0.05]), ["symbol", "start", "date"]


def _samples(t: DataFrame) -> DataFrame:
    vwaps = clock.windows(market._bars(t), ["vwap"], LENGTH, STRIDE, HORIZON)
    first = F.get("bars", F.lit(0))["vwap"]
    features = F.transform(book.last_bars(F.col("bars"), 4), lambda b: book.log_return(b["vwap"], first))
    return vwaps.select("symbol", "start", "date", features.alias("features"))


def _scored(t: DataFrame) -> DataFrame:
    return scoring.score(_samples(t), MODEL, SCORED, threshold=1.0)


def _streamed_scores(t: DataFrame) -> DataFrame:
    """The same scores from a lake of samples to which files are added between runs of a stream."""
    spark, samples = t.sparkSession, written(_samples(t), "samples")
    lake, out, state = (new_path(spark, n) for n in ("lake", "scores", "scoring"))
    for part in ("date < '19950101'", "date >= '19950101'"):
        samples.filter(part).write.mode("append").parquet(lake)
        scoring.score_stream(spark.readStream.schema(samples.schema).parquet(lake), MODEL, SCORED, out, state, threshold=1.0)
    return spark.read.schema("symbol string, start long, date string, pred_bp double, z_sparsity double").parquet(out)


def _counts_from_footers(t: DataFrame) -> DataFrame:
    path = new_path(t.sparkSession, "by_date")
    t.select("date", "seq").repartition("date").write.partitionBy("date").parquet(path)
    return layout.partition_counts(t.sparkSession, path, ["date"]).select(F.col("date").cast("string").alias("date"), "n")


def _tar_samples(t: DataFrame) -> DataFrame:
    vwaps = clock.windows(market._bars(t), ["vwap"], LENGTH, STRIDE, HORIZON)
    return vwaps.select(book.sample_key(F.col("symbol"), F.col("start")).alias("key"), F.transform("bars", lambda b: b["vwap"].cast("float")).alias("values"), F.array(F.lit(LENGTH)).alias("shape"), F.to_json(F.struct("symbol", "date")).alias("meta"))


def _tar_rows(back: DataFrame) -> DataFrame:
    return back.select("key", F.get("shape", F.lit(0)).alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"), F.get_json_object("meta", "$.date").alias("date"))


def _tar_round_trip(t: DataFrame) -> DataFrame:
    """Windows to tar shards and back, by byte ranges."""
    path = new_path(t.sparkSession, "tars")
    writers.write_tar_shards(_tar_samples(t), path, per_shard=500)
    return _tar_rows(readers.read_tar_ranges(t.sparkSession, path, split_bytes=1_000_000))


def _merged_shards(t: DataFrame) -> DataFrame:
    """The shards of three workers, each with a part of the symbols, merged into one folder and read back."""
    spark, samples = t.sparkSession, written(_tar_samples(t), "samples")
    outputs = [new_path(spark, f"worker{i}") for i in range(3)]
    for i, output in enumerate(outputs):
        writers.write_tar_shards(samples.filter(F.pmod(F.crc32(F.substring("key", 1, 6)), F.lit(3)) == i), output, per_shard=500)
    path = new_path(spark, "merged")
    writers.merge_shards(spark, outputs, path)
    return _tar_rows(readers.read_tar_ranges(spark, path, split_bytes=1_000_000))


TICK_OPERATORS = {
    "check_ticks": partial(quality.check_ticks, levels=1),
    "check_bars": lambda t: quality.check_bars(_bars(t)),
    "check_windows": lambda t: quality.check_windows(_windows(t), LENGTH),
    "check_friction": lambda t: quality.check_friction(calibrate.friction(t, 10.0)),
    "check_density": quality.check_density,
    "checks_rolled_up": lambda t: quality.rolled_up(_all_checks(t)),
    "coverage": quality.coverage,
    "row_counts": layout.row_counts,
    "shard_ranges": _shard_ranges,
    "shard_dates": lambda t: layout.shard_dates(_shard_ranges(t), SHARDS),
    "symbol_slice": lambda t: layout.symbol_slice(t, 500, 510).select("symbol", "seq", "price"),
    "sorted_layout": _sorted_layout,
    "scored_windows": _scored,
    "tar_round_trip": _tar_round_trip,
    "merged_shards": _merged_shards,
    "streamed_scores": _streamed_scores,
    "counts_from_footers": _counts_from_footers,
}
BOOK_OPERATORS = {"check_book": quality.check_ticks, "check_tensors": _check_tensors, "landscapes": _landscapes, "daily_features": _daily_features, "velocity_landscapes": partial(_landscapes, velocity=5.0), "gate_statistics": lambda t: topology.gate_statistics(_found(t))}
PREDICTION_OPERATORS = {
    "check_predictions": quality.check_predictions,
    "batch_targets": partial(quality.batch_targets, key="shard_idx"),
    "scoring_summary": scoring.scoring_summary,
    "with_shard_date": lambda p: layout.with_shard_date(p, layout.shard_dates(layout.shard_ranges(layout.row_counts(p), 1000), 1000)).groupBy("mapped_date").agg(F.count(F.lit(1)).alias("n")),
    "temporal_split": lambda p: layout.temporal_split(p).groupBy("part", "date").agg(F.count(F.lit(1)).alias("n")),
    "shard_split": lambda p: layout.temporal_split(p, "shard_idx", embargo=10).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("shard_idx").alias("first"), F.max("shard_idx").alias("last")),
    "shard_slice": lambda p: layout.shard_slice(p, 100, 140).groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n")),
    "shuffled_batches": lambda p: layout.shuffled_batches(p, ORDER).groupBy("batch").agg(F.count(F.lit(1)).alias("n")),
    "unscored": lambda p: scoring.unscored(p, p.filter("shard_idx % 3 = 0"), "shard_idx").agg(F.count(F.lit(1)).alias("n")),
}


def _on_predictions(operator, spark: SparkSession, folder: str) -> DataFrame:
    return common.rounded(operator(fixtures.predictions(spark, folder)))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as ticks: one symbol for each user, one date for each day."""
    return fixtures.table(spark, folder, "events").selectExpr("cast(user_id as string) as symbol", "date_format(ts, 'yyyyMMdd') as date", "event_id as seq", "10 + value / 100 as price", "value as vol_tick", "event_type as bs_flag")


def first_week(spark: SparkSession, folder: str) -> DataFrame:
    return layout.first_week(_events(spark, folder))


def reconciled(spark: SparkSession, folder: str) -> DataFrame:
    """The orders and the parts as two listings: names by number, sizes by value."""
    local = fixtures.table(spark, folder, "orders").select(F.concat(F.lit("/a/"), F.col("o_orderkey") % 3000).alias("path"), F.col("o_custkey").alias("length")).groupBy("path").agg(F.sum("length").alias("length"))
    remote = fixtures.table(spark, folder, "orders").filter("o_orderkey % 7 <> 0").select(F.concat(F.lit("/b/"), F.col("o_orderkey") % 2900).alias("path"), F.col("o_custkey").alias("length")).groupBy("path").agg(F.sum("length").alias("length"))
    return layout.reconciled(local, remote)


def _replayed(spark: SparkSession, folder: str, stream) -> DataFrame:
    """The events through a stream, as a lake that grows: for each part of the calendar files land, and a run takes up from the checkpoint of the one before.

    The runs have a session of their own, as a stream keeps the number of state partitions that it starts with.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism))
    t = written(_events(spark, folder), "events")
    lake, out, state = (new_path(spark, n) for n in ("lake", "streamed", "state"))
    dated = t.join(F.broadcast(t.select("date").distinct().withColumn("run", F.ntile(RUNS).over(Window.orderBy("date")))), "date")  # a calendar
    for run in range(1, RUNS + 1):
        dated.filter(F.col("run") == run).drop("run").select(t.columns).write.mode("append").parquet(lake)
        found = stream(own.readStream.schema(t.schema).parquet(lake))
        found.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


def stream_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The bars of the streaming clock over the events."""
    return common.rounded_as_sql(_replayed(spark, folder, partial(volume_bar_stream, **STREAM)), DIGITS)


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every bar of every window that the stream gives."""
    stream = partial(volume_window_stream, length=LENGTH, stride=STRIDE, horizon=HORIZON, **STREAM)
    found = _replayed(spark, folder, stream).select("symbol", "start", "date", "target_bp", F.explode("bars").alias("bar"))
    return common.rounded_as_sql(found.select("symbol", "start", "date", "target_bp", *[F.col(f"bar.{c}").alias(c) for c in ("bar_id", "close", "vwap", "v_d", "sigma_d")]), DIGITS)


def event_bars(spark: SparkSession, folder: str) -> DataFrame:
    t = _events(spark, folder)
    return common.rounded_as_sql(clock.volume_bars(t, ticks.rolling_macro(ticks.daily_stats(t, in_order=True), **STREAM)), DIGITS)


QUERIES = (
    {name: partial(market._on_ticks, operator, 1) for name, operator in TICK_OPERATORS.items()} | {name: partial(market._on_ticks, operator, 10) for name, operator in BOOK_OPERATORS.items()}
    | {name: partial(_on_predictions, operator) for name, operator in PREDICTION_OPERATORS.items()} | {"first_week": first_week, "reconciled": reconciled, "stream_bars": stream_bars, "stream_windows": stream_windows, "event_bars": event_bars}
)


def _rows(stats: str, checks: list[tuple[str, str, str, str]]) -> str:
    return " union all ".join(f"""select '{n}' as "check", '{s}' as severity, {r(f'({v})::double')} as value, coalesce({m}, false) as met, case when coalesce({m}, false) then 'PASS' else '{s}' end as status from {stats}""" for n, s, v, m in checks)


_Q = "qt as (select *, (100 * ((l_partkey + 1) % 50))::double as bv, (100 * ((l_suppkey * 7 + l_orderkey + 1) % 50))::double as av from t)"
_QT = f"""{_Q}, tk as (select count(*) as n, min(least(nullif(bid_p1, 0), nullif(ask_p1, 0))) as low, max(greatest(bid_p1, ask_p1)) as high, min(least(bv, av)) as dep, sum((bid_p1 > 0 and ask_p1 > 0)::int) as quoted, sum((bid_p1 > 0 and ask_p1 > 0 and ask_p1 < bid_p1)::int) as crossed, count(distinct symbol) as sy from qt)"""
_TICK_CHECKS = _rows("tk", [("rows", "STOP", "n", "n > 0"), ("finite numbers", "STOP", "0", "true"), ("prices over 0", "STOP", "low", "low > 0"), ("prices in range", "STOP", "high", "high < 1e7"), ("depths not negative", "STOP", "dep", "dep >= 0"),
    ("quotes not crossed", "WARNING", "crossed / quoted", "crossed = 0"), ("prices not all 0", "STOP", "1", "true"), ("dates present", "STOP", "0", "true"), ("symbols", "WARNING", "sy", "sy > 1")])
_BOOK = """lv as (select *, price * (1 - 0.001::double * i) as bp, price * (1 + case when i = 1 and l_linenumber = 5 then -0.001::double else 0.001::double * i end) as ap, (100 * ((l_partkey + i) % 50))::double as bv, (100 * ((l_suppkey * 7 + l_orderkey + i) % 50))::double as av
 from t cross join (select unnest(range(1, 11)) as i)),
tk as (select (select count(*) from t) as n, min(least(nullif(bp, 0), nullif(ap, 0))) as low, max(greatest(bp, ap)) as high, min(least(bv, av)) as dep, sum((bp > 0 and ap > 0)::int) as quoted, sum((bp > 0 and ap > 0 and ap < bp)::int) as crossed, count(distinct symbol) as sy from lv)"""
_BARS = f"{market._DAY}, {market._MACRO}, {market._BUCKET}, {market._BARS}"
_BK = f"{_BARS}, bs as (select count(*) as n, avg(delta_p) as dp, avg(v_d) as v, stddev_pop(v_d) as vs, avg(sigma_d) as s, stddev_pop(sigma_d) as ss from ba join ma using (symbol, date))"
_BAR_CHECKS = _rows("bs", [("rows", "STOP", "n", "n > 0"), ("finite vwap", "STOP", "0", "true"), ("moves not all 0", "STOP", "1", "true"), ("mean move under 100", "WARNING", "dp", "abs(dp) < 100"), ("volume over 0", "STOP", "v", "v > 0"), ("volume varies", "WARNING", "vs", "vs > 0"),
    ("range over 0", "STOP", "s", "s > 0"), ("range varies", "WARNING", "ss", "ss > 0")])
_FRIC = f"{market._RUNS.format(share=2)}, {market._FRICTION}"
_FS = "fs as (select count(*) as n, min(c) as lo, max(c) as hi, count(distinct round(c, 4)) as k from fr)"
_FRICTION_CHECKS = _rows("fs", [("rows", "STOP", "n", "n > 0"), ("c over 0.05", "STOP", "lo", "lo >= 0.05"), ("c under 10", "STOP", "hi", "hi <= 10"), ("c varies", "WARNING", "k", "k > 1")])
_RANGES = """n as (select date, count(*) as n from {rows} group by date), u as (select *, sum(n) over (order by date) as upto, sum(n) over () as tot from n),
rg as (select date, floor((upto - n) / tot * {shards})::bigint as first_shard, greatest(floor(upto / tot * {shards})::bigint - 1, floor((upto - n) / tot * {shards})::bigint) as last_shard from u)"""
_DATES = """cl as (select shard, max(date) as date from (select unnest(range(first_shard, last_shard + 1)) as shard, date from rg) group by shard),
sp as (select g.shard, cl.date from (select unnest(range(0, {shards})) as shard) g left join cl using (shard)), sd as (select shard, coalesce(date, last_value(date ignore nulls) over (order by shard rows between 9 preceding and 1 preceding)) as date from sp)"""
_EVENTS = "ev as (select distinct strftime(ts, '%Y%m%d') as date from events)"
_SPLIT = """k as (select {key}, row_number() over (order by {key}) - 1 as k, count(*) over () as n from (select distinct {key} from p)), sl as (select {key}, case when k < floor(n * 0.8 + 1e-9) - {e} then 'train' when k >= floor(n * 0.8 + 1e-9) + {e} then 'validation' end as part from k)"""

_EVENT_BARS = f"""t as (select user_id::varchar as symbol, strftime(ts, '%Y%m%d') as date, event_id as seq, 10 + value / 100 as price, value as vol_tick from events),
{market._DAY}, {market._MACRO.replace("2 preceding", "4 preceding").replace("3 preceding", "5 preceding")}, {market._CLOCK}"""

def _topology(velocity: float | None = None) -> str:
    """Windows of six ticks as points; the merge heights are, in any order of the points, each point's least minimax distance to an earlier one."""
    moved = "" if velocity is None else f""" union all select symbol, date, w, i, {{k}} + dim, greatest(0, nx - x) * {velocity}::double from nx where nx is not null
 union all select symbol, date, w, i, 2 * {{k}} + dim, greatest(0, x - nx) * {velocity}::double * 0.02::double from nx where nx is not null"""
    squares = ", ".join(f"m{i} as (select a.symbol, a.date, a.w, a.i, b.j, min(greatest(a.d, b.d)) as d from m{i - 1} a join m{i - 1} b on a.symbol = b.symbol and a.date = b.date and a.w = b.w and a.j = b.i group by all)" for i in (1, 2, 3))
    key = "symbol, date, w"
    return f"""bo as (select *, {market._BV} as bv, {market._AV} as av from t),
mf as (select symbol, date, seq, (bid_p1 * av + ask_p1 * bv) / (bv + av + 1e-8) as micro, (bv - av) / (bv + av + 1e-8) as imbalance, ln(1 + bv + av) as depth, row_number() over (partition by symbol, date order by seq) - 1 as k from bo),
wi as (select *, k // 6 as w, (k % 6)::int as i, count(*) over (partition by symbol, date, k // 6) as n from mf), po as (select * from wi where n = 6),
hs as (select a.symbol, a.date, a.w, l.lag, sqrt(avg((b.micro - a.micro) ** 2)) as move from po a cross join (values (2), (3)) l(lag) join po b on a.symbol = b.symbol and a.date = b.date and a.w = b.w and b.i = a.i + l.lag group by all),
hu as (select {key}, case when min(move) > 1e-8 then least(greatest((ln(max(move) filter (lag = 3)) - ln(max(move) filter (lag = 2))) / (ln(3::double) - ln(2::double)), 0), 1) else 0.5 end as h from hs group by all),
tr as (select {key}, case when sd < 1e-8 then 0.5 else h end not between 0.45 and 0.55 as triggered from hu join (select {key}, stddev_pop(micro) as sd from po group by all) using ({key})),
xs as (select {key}, i, unnest([1, 2, 3]) as dim, unnest([micro, imbalance, depth]) as x from po), nx as (select *, lead(x) over (partition by {key}, dim order by i) as nx from xs),
pt as (select {key}, i, dim, x from nx{"" if velocity is None else " where nx is not null"}{moved.format(k=3)}),
sp as (select {key}, i, dim, (x - avg(x) over u) / (stddev_pop(x) over u + 1e-8) as x from pt window u as (partition by {key}, dim)),
m0 as (select a.symbol, a.date, a.w, a.i, b.i as j, sqrt(sum((a.x - b.x) ** 2)) as d from sp a join sp b on a.symbol = b.symbol and a.date = b.date and a.w = b.w and a.dim = b.dim group by all), {squares},
he as (select {key}, i, min(d) as d from m3 where j < i group by all), tp as (select {key}, list(d) as ds, case when max(d) > 0 then max(d) else 1 end as top from he group by all),
la as (select {key}, g, top, list_reverse_sort(list_transform(ds, lambda d: greatest(0, least(case when g = 19 then top else g * (top / 19) end, d - case when g = 19 then top else g * (top / 19) end)))) as x from tp cross join (select unnest(range(20)) as g)),
ce as (select {key}, l * 20 + g as cell, case when triggered then coalesce(x[l + 1], 0) else 0 end as x, triggered from la cross join (select unnest([0, 1, 2]) as l) join tr using ({key})),
dt as (select symbol, date, cell::int as cell, count(*) as windows, sum(triggered::int)::bigint as triggered_windows, max(x) as x from ce group by all)"""


_TENSORS = f"""{market._DAY}, {market._MACRO}, {market._CLOCK}, {market._TARGET}, wb as (select wt.symbol, start, ba.seq, ba.close from wt join ba on ba.symbol = wt.symbol and ba.bar_id between start and start + 7),
lv as (select symbol, start, close, {', '.join(f"({x.format(i='i')})::float::double as {c}" for c, x in market._LEVEL.items())} from wb join t using (symbol, seq) cross join (select unnest(range(1, 11)) as i)),
ts as (select (select count(*) from wt) as n, min(bid_p) filter (bid_p > 0) as low, max(bid_p) filter (bid_p > 0) as high, min(least(bid_v, ask_v)) as depth, sum((bid_p > 0 and ask_p > 0 and ask_p < bid_p)::int) as crossed from lv)"""
_TENSOR_CHECKS = [("rows", "STOP", "n", "n > 0"), ("shape", "STOP", "0", "true"), ("dtype", "STOP", "1", "true"), ("finite", "STOP", "0", "true"), ("bids over 0", "WARNING", "low", "low > 0"), ("bids in range", "WARNING", "high", "high < 1e7"),
    ("depths not negative", "STOP", "depth", "depth >= 0"), ("quotes not crossed", "WARNING", "crossed", "crossed = 0"), ("close not all 0", "WARNING", "0", "true"), ("reserved all 0", "STOP", "0", "true")]

ORACLES = {
    "check_tensors": f"with recursive {TICKS}, {_TENSORS} {_rows('ts', _TENSOR_CHECKS)}",
    "landscapes": f"with {TICKS}, {_topology()} select symbol, date, windows, triggered_windows, cell, {r('x')} as x from dt",
    "velocity_landscapes": f"with {TICKS}, {_topology(5.0)} select symbol, date, windows, triggered_windows, cell, {r('x')} as x from dt",
    "gate_statistics": f"""with {TICKS}, {_topology()} select (select count(*) from tr) as windows, {r('(select avg(triggered::int) from tr)')} as trigger_rate, {r('avg(x)')} as mean, {r('stddev_pop(x)')} as std, {r('min(x)')} as least, {r('max(x)')} as most from ce where triggered""",
    "daily_features": f"""with {TICKS}, {_topology()}, db as (select symbol, date, arg_min(price, seq) as open_price, arg_max(price, seq) as close_price from t group by all having count(*) >= 5)
select symbol, date, {r('open_price')} as open_price, {r('close_price')} as close_price, coalesce(triggered_windows, 0) as triggered_windows, cell, {r('coalesce(x, 0)')} as x from (select * from db cross join (select unnest(range(60))::int as cell)) left join dt using (symbol, date, cell)""",
    "event_bars": f"with recursive {_EVENT_BARS} select {market.bars_rounded(r)} from ba",
    "stream_bars": f"with recursive {_EVENT_BARS} select {market.bars_rounded(r)}, false as late from ba",
    "stream_windows": f"""with recursive {_EVENT_BARS}, {market._TARGET} select wt.symbol, start, wt.date, {r('target_bp')} as target_bp, ba.bar_id, {', '.join(f"{r(c)} as {c}" for c in ('close', 'vwap', 'v_d', 'sigma_d'))}
 from wt join ba on ba.symbol = wt.symbol and ba.bar_id between start and start + 7""",
    "check_ticks": f"with {TICKS}, {_QT} {_TICK_CHECKS}",
    "check_book": f"with {TICKS}, {_BOOK} {_TICK_CHECKS}",
    "check_bars": f"with {TICKS}, {_BK} {_BAR_CHECKS}",
    "check_windows": f"""with {TICKS}, {market._BUCKET}, {market._BARS}, {market._TARGET}, w as (select count(*) as n, max(abs(target_bp)) as la, avg(target_bp) as mu, avg((target_bp <> 0)::int) as sh, bool_or(target_bp > 0) and bool_or(target_bp < 0) as bo from wt) """
    + _rows("w", [("rows", "STOP", "n", "n > 0"), ("bars in each", "STOP", "0", "true"), ("target under 5000", "WARNING", "la", "la < 5000"), ("target not all 0", "STOP", "1", "true"), ("both signs", "STOP", "bo::int", "bo"), ("mean target under 50", "WARNING", "mu", "abs(mu) < 50"), ("half not 0", "WARNING", "sh", "sh >= 0.5")]),
    "check_friction": f"with {TICKS}, {_FRIC}, {_FS} {_FRICTION_CHECKS}",
    "check_density": f"with {TICKS}, x as (select max(n) / (min(n) + 1) as q from (select count(*) as n from t group by symbol)) " + _rows("x", [("density", "WARNING", "q", "q < 10")]),
    "checks_rolled_up": f"""with {TICKS}, {_QT}, {_BK}, {_FRIC}, {_FS}, al as ({_TICK_CHECKS} union all {_BAR_CHECKS} union all {_FRICTION_CHECKS})
select status, count(*) as n, (select case when bool_or(status = 'STOP') then 'STOP' when bool_or(status = 'WARNING') then 'WARNING' else 'PASS' end from al) as verdict from al group by status""",
    "coverage": f"with {TICKS} select count(*) as n, min(date) as first_date, max(date) as last_date, count(distinct symbol) as symbols, 0::bigint as undated from t",
    "row_counts": f"with {TICKS} select date, count(*) as n from t group by date",
    "shard_ranges": f"with {TICKS}, {_RANGES.format(rows='t', shards=SHARDS)} select * from rg",
    "shard_dates": f"with {TICKS}, {_RANGES.format(rows='t', shards=SHARDS)}, {_DATES.format(shards=SHARDS)} select * from sd",
    "symbol_slice": f"with {TICKS}, z as (select *, count(*) over (partition by symbol) as n from t) select symbol, seq, {r('price')} as price from z where case when n > 510 then seq between 501 and 510 else seq <= 10 end",
    "sorted_layout": f"with {TICKS} select 0::bigint as unsorted, count(*) as rows from t",
    "scored_windows": f"""with {TICKS}, {market._BUCKET}, {market._BARS}, {market._TARGET}, f as (select wt.symbol, start, wt.date, list(vwap order by bar_id) as v from wt join ba on ba.symbol = wt.symbol and ba.bar_id between start and start + 7 group by all),
l as (select *, list_transform(v[5:8], lambda x: ln(greatest(x, 1e-6) / greatest(v[1], 1e-6)) * 100) as x from f), z as (select *, [x[1] * 0.1, x[2] * -0.2, x[3] * 0.3, x[4] * 0.05] as z from l)
select symbol, start, date, {r('list_sum(z) * 10000')} as pred_bp, {r('len(list_filter(z, lambda a: abs(a) < 1)) / 4::double')} as z_sparsity from z""",
    "tar_round_trip": f"""with {TICKS}, {market._BUCKET}, {market._BARS}, {market._TARGET} select replace(wt.symbol, '.', '_') || '_' || lpad(start::varchar, 9, '0') as key, count(*)::int as n, {r('sum(vwap::float::double)')} as total, wt.date from wt join ba on ba.symbol = wt.symbol and ba.bar_id between start and start + 7 group by wt.symbol, start, wt.date""",
    "check_predictions": f"with {P}, s as (select count(*) as n, stddev_samp(x) as sd from p) select * replace ({common.r('value')} as value) from (" + _rows("s", [("columns missing", "STOP", "0", "true"), ("rows", "STOP", "n", "n >= 1000"), ("deviation in band", "STOP", "sd", "sd > 5 and sd < 500"), ("finite", "STOP", "0", "true")]) + ")",
    "batch_targets": f"with {P} select shard_idx, {common.r('avg((y <> 0)::int)')} as share, avg((y <> 0)::int) >= 0.5 as met from p group by shard_idx",
    "scoring_summary": f"with {P} select count(*) as n, {common.r('avg(z_sparsity)')} as mean_sparsity, {common.r('avg((z_sparsity >= 0.5)::int)')} as sparse_share from p",
    "with_shard_date": f"with {P}, {_RANGES.format(rows='p', shards=1000)}, {_DATES.format(shards=1000)} select coalesce(sd.date, 'shard_' || lpad(shard_idx::varchar, 5, '0')) as mapped_date, count(*) as n from p left join sd on sd.shard = p.shard_idx group by 1",
    "temporal_split": f"with {P}, {_SPLIT.format(key='date', e=1)} select part, date, count(*) as n from p join sl using (date) where part is not null group by all",
    "shard_split": f"with {P}, {_SPLIT.format(key='shard_idx', e=10)} select part, count(*) as n, min(shard_idx) as first, max(shard_idx) as last from p join sl using (shard_idx) where part is not null group by part",
    "shard_slice": f"with {P}, k as (select shard_idx, row_number() over (order by shard_idx) - 1 as k from (select distinct shard_idx from p)) select shard_idx, count(*) as n from p join k using (shard_idx) where k >= 100 and k < 140 group by shard_idx",
    "shuffled_batches": f"with {P}, n as (select count(*) as n from p) select b as batch, least(256, n - b * 256) as n from n, (select unnest(range(0, (select (n + 255) // 256 from n))) as b)",
    "unscored": f"with {P} select count(*) as n from p where shard_idx % 3 <> 0",
    "first_week": f"with {_EVENTS}, k as (select date, row_number() over (order by date) as k, count(*) over () as n from ev), s as (select min(k) as s from k where dayofweek(strptime(date, '%Y%m%d')) = 1 and k + 4 <= n) select date from k, s where k >= s and k < s + 5",
    "reconciled": """with a as (select (o_orderkey % 3000)::varchar as name, sum(o_custkey)::bigint as l from orders group by 1), b as (select (o_orderkey % 2900)::varchar as name, sum(o_custkey)::bigint as l from orders where o_orderkey % 7 <> 0 group by 1)
select name, a.l as local_length, b.l as remote_length, case when b.l is null then 'missing' when a.l is null then 'extra' else 'size differs' end as status from a full join b using (name) where a.l is distinct from b.l""",
}
ORACLES |= {same: ORACLES[name] for same, name in {"merged_shards": "tar_round_trip", "streamed_scores": "scored_windows", "counts_from_footers": "row_counts"}.items()}
