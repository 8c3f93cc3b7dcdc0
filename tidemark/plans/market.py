"""Queries of ticks, calibration, clocks, windows and labels. Constants are shrunk to the size of the fixture tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators import calibrate, clock, labels, ticks
from tidemark.plans import common
from tidemark.plans.common import TICKS
from tidemark.sources import fixtures

MACRO = {"days": 3, "share": 0.5, "least": 20.0, "first_threshold": 100.0, "first_volume": 150.0}
THRESHOLD, LENGTH, STRIDE, HORIZON = 100, 8, 2, 3
MANIFOLD = ("bid_bp", "log_bid_v", "ask_bp", "log_ask_v", "log_ret", "symlog_q", "log_v_d", "log_sigma_d")
DIGITS = 7  # prices are cents over a whole quantity: with fewer digits some lie on the edge between two roundings


STEADY = "1.0000000000001"  # cents over a power of two can lie on the edge itself: this takes them off it, in Spark and in SQL


def r(x: str) -> str:
    return common.r(x, DIGITS)


def _off_edges(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c) * float(STEADY)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def steady(x: str) -> str:
    return r(f"({x}) * {STEADY}::double")


def _on_ticks(operator, levels: int, spark: SparkSession, folder: str, digits: int = DIGITS) -> DataFrame:
    return common.rounded(operator(fixtures.ticks(spark, folder, levels)), digits)


def _macro(t: DataFrame) -> DataFrame:
    return ticks.rolling_macro(ticks.daily_stats(t), **MACRO)


def _bars(t: DataFrame) -> DataFrame:
    return clock.bucket_bars(calibrate.bucketed(t, THRESHOLD))


def _volume_bars(t: DataFrame) -> DataFrame:
    return clock.volume_bars(t, _macro(t))


def _volume_windows(t: DataFrame) -> DataFrame:
    """Every bar of every window, with all levels of its book: sums over levels, each by its number."""
    bars = clock.with_book(_volume_bars(t), t, _macro(t), 10)
    found = clock.windows(bars, ["close", "vwap", "v_d", "sigma_d", "lob"], LENGTH, STRIDE, HORIZON).withColumn("coarse", book.coarse(F.transform("bars", lambda b: b["vwap"]), 4))
    flat = found.select("symbol", "start", "date", "target_bp", "coarse", F.posexplode("bars").alias("place", "bar"))
    side = lambda c: F.aggregate(F.transform("bar.lob", lambda x, i: x[c].cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x).alias(c)
    bar = [F.col(f"bar.{c}").alias(c) for c in ("bar_id", "close", "vwap", "v_d", "sigma_d")]
    return flat.select("symbol", "start", "date", "target_bp", "place", *bar, F.get("coarse", F.floor(F.col("place") / 4).cast("int")).alias("coarse_vwap"), *[side(c) for c in ("bid_p", "bid_v", "ask_p", "ask_v")])


def _windows(t: DataFrame) -> DataFrame:
    found = clock.windows(_bars(t), ["close", "vwap"], LENGTH, STRIDE, HORIZON)
    return found.select("symbol", "start", "date", "target_bp", F.size("bars").alias("n_bars"), F.element_at("bars", -1)["close"].alias("last_close"), F.aggregate("bars", F.lit(0.0), lambda a, b: a + b["vwap"]).alias("vwap_sum"))


def _sample_keys(t: DataFrame) -> DataFrame:
    keyed = clock.window_keys(clock.window_targets(_bars(t), LENGTH, STRIDE, HORIZON)).withColumn("key", book.sample_key(F.col("symbol"), F.col("sample")))
    return keyed.select("key", book.key_symbol(F.col("key")).alias("symbol"), book.key_index(F.col("key")).alias("sample"))


def _features(t: DataFrame) -> DataFrame:
    bids, asks = book.side_depth("bid_v"), book.side_depth("ask_v")
    day = Window.partitionBy("symbol", "date").orderBy("seq")
    mid = book.mid_price(F.col("bid_p1"), F.col("ask_p1"))
    return t.select(
        "symbol", "seq", book.imbalance(bids, asks).alias("imbalance"), book.micro_price(F.col("bid_p1"), F.col("ask_p1"), bids, asks).alias("micro"), book.log_depth(bids, asks).alias("depth"),
        book.deviation_bp(F.col("bid_p1"), mid).alias("bid_bp"), book.log_volume(F.col("vol_tick")).alias("log_vol"), book.symlog(F.col("price") - 1500).alias("symlog"),
        book.log_return(F.col("price"), F.first("price").over(day)).alias("log_ret"), book.is_locked(F.col("bid_p1"), F.col("ask_p1")).alias("locked"), book.daily_limit_bp(F.col("symbol")).alias("limit_bp"),
    )


def _implied(t: DataFrame) -> DataFrame:
    macro = _macro(t)
    bars = _bars(t).join(macro.select("symbol", "date", "v_d", "sigma_d"), ["symbol", "date"])
    return calibrate.with_implied_quantity(calibrate.with_friction(bars, calibrate.friction(t, 10.0))).select("symbol", "bar_id", "c", F.signum("q_hat").alias("side"), F.log1p(F.abs("q_hat")).alias("log_q"))


def _manifold(t: DataFrame, levels: int = 10) -> DataFrame:
    """Every feature of every bar and level of windows of five ticks of a day. The windows are made of narrow ticks; their book comes after that."""
    day = Window.partitionBy("symbol", "date").orderBy("seq")
    daily = _macro(t).select("symbol", "date", "v_d", "sigma_d").hint("shuffle_hash")  # a row for a day's ticks
    moves = t.drop("vol_tick", "bs_flag").join(daily, ["symbol", "date"]).withColumn("_before", F.lag("price").over(day))
    placed = clock.tumbling(moves, ["symbol", "date"], "seq", 5, {"first": "price"})
    delta_p = F.coalesce(F.col("price") - F.col("_before"), F.lit(0.0))
    bars = fixtures.quoted(placed, levels).withColumn("q_hat", book.implied_quantity(delta_p, F.col("sigma_d"), F.col("v_d"), F.lit(0.842)))
    return clock.flat_manifold(bars, ["symbol", "date", "window", "bar"], MANIFOLD, levels, close="price", macro=("v_d", "sigma_d"))


def _window_manifold(spark: SparkSession, folder: str) -> DataFrame:
    return common.rounded_as_sql(_manifold(fixtures.keyed_ticks(spark, folder)), DIGITS)


OPERATORS = {
    "daily_stats": lambda t: ticks.daily_stats(ticks.cleaned(t)),
    "share_symbols": ticks.share_symbols,
    "shares_between": lambda t: ticks.daily_stats(ticks.between_dates(ticks.shares(t), "19940101", "19951201")),
    "two_symbols": lambda t: ticks.of_symbols(t, ["600010.SH", "000011.SZ"]).select("symbol", "date", "seq", "price"),
    "rolling_macro": lambda t: _macro(t).select("symbol", "date", "volume", "v_d", "sigma_d", "threshold"),
    "day_changes": ticks.day_changes,
    "directional_runs": calibrate.directional_runs,
    "friction": partial(calibrate.friction, least_volume=10.0),
    "friction_small_runs": partial(calibrate.friction, least_volume=10.0, most_share=0.1),
    "clock_threshold": partial(calibrate.clock_threshold, bars_a_day=5, least=10),
    "path_efficiency": partial(calibrate.path_efficiency, threshold=THRESHOLD),
    "autocorrelation": lambda t: calibrate.autocorrelation(calibrate.path_efficiency(t, THRESHOLD), lags=10),
    "window_length": lambda t: calibrate.window_length(calibrate.path_efficiency(t, THRESHOLD), lags=10, least=2),
    "bucket_bars": _bars,
    "window_targets": lambda t: clock.window_targets(_bars(t), LENGTH, STRIDE, HORIZON),
    "windows": _windows,
    "sample_keys": _sample_keys,
    "tumbling_windows": lambda t: clock.tumbling(t, ["symbol", "date"], "seq", 5).groupBy("symbol", "date", "window").agg(F.avg("price").alias("mean_price"), F.max("seq").alias("last_seq")),
    "implied_quantity": _implied,
    "swing_labels": lambda t: labels.swing_labels(labels.daily_bars(t)),
    "volume_bars": lambda t: _off_edges(_volume_bars(t)),
    "volume_windows": lambda t: _off_edges(_volume_windows(t)),
}
QUERIES = {name: partial(_on_ticks, operator, 10 if name == "volume_windows" else 1) for name, operator in OPERATORS.items()} | {"window_manifold": _window_manifold, "book_features": partial(_on_ticks, _features, 10), "bucket_bars": partial(_on_ticks, _bars, 1, digits=9)}

_DAY = "d as (select symbol, date, sum(vol_tick) as volume, max(case when price > 0 then price end) as high, min(case when price > 0 then price end) as low, count(*) as ticks from t group by symbol, date)"
_MACRO = """po as (select symbol, date, avg(volume) over (partition by symbol order by date rows between 2 preceding and current row) as m from d where volume > 0),
mc as (select symbol, date, volume, coalesce(last_value(m ignore nulls) over w, 150.0) as v_d, coalesce(avg(greatest(coalesce(high - low, 0), 1e-4)) over (partition by symbol order by date rows between 3 preceding and 1 preceding), 0.5) as sigma_d,
 row_number() over (partition by symbol order by date) as k from d left join po using (symbol, date) window w as (partition by symbol order by date rows between unbounded preceding and 1 preceding)),
ma as (select *, case when k = 1 then 100.0 else greatest(v_d * 0.5, 20.0) end as threshold from mc)"""
_RUNS = """tr as (select *, row_number() over w as k, lag(bs_flag) over w as pf from t where price > 0 and vol_tick > 0 window w as (partition by symbol, date order by seq)),
ru as (select *, sum(case when k > 1 and bs_flag is not distinct from pf then 0 else 1 end) over (partition by symbol, date order by seq) as run from tr),
rs as (select symbol, date, run, sum(vol_tick) as q, abs(arg_max(price, seq) - arg_min(price, seq)) as dp from ru group by symbol, date, run),
rt as (select *, sum(q) over (partition by symbol, date) as dayq from rs), rn as (select symbol, date, run::bigint as run, q, dp from rt where q <= {share} * dayq and q > 0 and dp > 0)"""
_FRICTION = """td as (select symbol, date, sum(vol_tick) as volume, max(price) - min(price) as rng from t where price > 0 and vol_tick > 0 group by symbol, date having sum(vol_tick) >= 10 and max(price) - min(price) >= 1e-6),
sm as (select symbol, date, sum(sqrt(q) * dp) as xy, sum(q) as xx, count(*) as runs from rn group by symbol, date),
te as (select symbol, sum(xy / (sqrt(volume) * rng + 1e-10)) as xy, sum(xx / (volume + 1e-10)) as xx, sum(runs)::bigint as runs, count(*) as days from sm join td using (symbol, date) group by symbol),
fi as (select *, case when xx >= 1e-10 and xy / xx > 0.05 and xy / xx < 10 then xy / xx end as raw from te),
fr as (select symbol, round(coalesce(raw, (select coalesce(median(raw), 0.842) from fi)), 6) as c, raw is null as is_default, runs, days from fi)"""
_BUCKET = "bk as (select *, floor(sum(vol_tick) over (partition by symbol order by seq rows unbounded preceding) / 100)::bigint as bucket from t)"
_EFF = """st as (select *, price - lag(price) over (partition by symbol, bucket order by seq) as dd from bk), eb as (select symbol, bucket, count(*) as n, sum(dd) as net, sum(abs(dd)) as tot from st group by symbol, bucket),
el as (select *, max(bucket) over (partition by symbol) as l from eb), ef as (select symbol, bucket, net / (tot + 1e-8) as efficiency, row_number() over (partition by symbol order by bucket) - 1 as idx from el where bucket < l and n > 1)"""
_ACF = """sr as (select symbol, count(*) as n, avg(efficiency) as m, var_pop(efficiency) as v from {rows} group by symbol), ce as (select {rows}.symbol, idx, n, v, efficiency - m as dv from {rows} join sr using (symbol)),
ac as (select s.symbol, g.lag, coalesce(any_value(case when s.v > 1e-300 then z.s / (s.n * s.v) end), 0) as acf from sr s cross join (select unnest(range(0, 11))::int as lag) g
 left join (select a.symbol, b.idx - a.idx as lag, sum(a.dv * b.dv) as s from ce a join ce b on a.symbol = b.symbol and b.idx >= a.idx and b.idx <= a.idx + 10 group by 1, 2) z on z.symbol = s.symbol and z.lag = g.lag group by s.symbol, g.lag)"""
_BARS = """bb as (select symbol, bucket, max(date) as date, max(seq) as seq, arg_max(price, seq) as close, arg_max(price, seq) - arg_min(price, seq) as delta_p, sum(price * vol_tick) / nullif(sum(vol_tick), 0) as vwap, sum(vol_tick) as volume from bk group by symbol, bucket),
bl as (select *, max(bucket) over (partition by symbol) as l from bb), ba as (select symbol, date, seq, close, delta_p, vwap, volume, row_number() over (partition by symbol order by bucket) - 1 as bar_id from bl where bucket < l)"""
_TARGET = """en as (select *, lead(vwap, 1) over w as e1, lead(vwap, 4) over w as e2 from ba window w as (partition by symbol order by bar_id)),
wt as (select symbol, bar_id - 7 as start, date, (e2 - e1) / (e1 + 1e-8) * 10000 as target_bp from en where e2 is not null and bar_id >= 7 and (bar_id - 7) % 2 = 0)"""
_LEVEL = {
    "bid_p": "price * (1 - 0.001::double * {i})", "bid_v": "(100 * ((l_partkey + {i}) % 50))::double",
    "ask_p": "price * (1 + case when {i} = 1 and l_linenumber = 5 then -0.001::double else 0.001::double * {i} end)", "ask_v": "(100 * ((l_suppkey * 7 + l_orderkey + {i}) % 50))::double",
}
_BV = "(" + " + ".join(f"(100 * ((l_partkey + {i}) % 50))::double" for i in range(1, 11)) + ")"
_AV = "(" + " + ".join(f"(100 * ((l_suppkey * 7 + l_orderkey + {i}) % 50))::double" for i in range(1, 11)) + ")"
_SHARE = "length(split_part(symbol, '.', 1)) = 6 and symbol[1:3] in ('000', '001', '002', '003', '300', '301', '600', '601', '603', '605', '688', '689')"
_CLOCK = """ti as (select t.symbol, t.date, t.seq, price, vol_tick as vol, threshold, v_d, sigma_d, row_number() over (partition by t.symbol order by t.date, t.seq) as k from t join ma using (symbol, date)),
ck as (select symbol, 0::bigint as k, 0::double as g, 0::double as pv, 0::double as v, 0::double as f, 0::bigint as n, false as closed, 0::double as delta_p, 0::double as vwap, 0::double as volume from (select distinct symbol from ti)
 union all select symbol, k, case when not full_ then g when v > 0 then least(g - threshold, threshold) else g - threshold end, case when full_ then 0 else pv end, case when full_ then 0 else v end, case when full_ then 0 else f end,
  n + (full_ and v > 0)::int, full_ and v > 0, price - f, pv / v, v
 from (select ti.symbol, ti.k, price, threshold, n, g + vol as g, pv + price * vol as pv, v + vol as v, case when f = 0 then price else f end as f, g + vol >= threshold as full_ from ck join ti on ti.symbol = ck.symbol and ti.k = ck.k + 1)),
ba as (select ck.symbol, n - 1 as bar_id, date, seq, price as close, delta_p, vwap, volume, threshold, v_d, sigma_d from ck join ti using (symbol, k) where closed)"""
def bars_rounded(edge) -> str:
    return "symbol, bar_id, date, seq, " + ", ".join(f"{edge(c)} as {c}" for c in ("close", "delta_p", "vwap", "volume", "threshold"))


_DAY_ROUND = f"symbol, date, {r('volume')} as volume, {r('high')} as high, {r('low')} as low, ticks"

ORACLES = {
    "daily_stats": f"with {TICKS}, {_DAY} select {_DAY_ROUND} from d",
    "share_symbols": f"with {TICKS} select distinct symbol from t where {_SHARE}",
    "shares_between": f"with {TICKS}, {_DAY} select {_DAY_ROUND} from d where {_SHARE} and date between '19940101' and '19951201'",
    "two_symbols": f"with {TICKS} select symbol, date, seq, {r('price')} as price from t where symbol in ('600010.SH', '000011.SZ')",
    "rolling_macro": f"with {TICKS}, {_DAY}, {_MACRO} select symbol, date, {r('volume')} as volume, {r('v_d')} as v_d, {r('sigma_d')} as sigma_d, {r('threshold')} as threshold from ma",
    "day_changes": f"with {TICKS}, l as (select symbol, seq, date, lag(date) over (partition by symbol order by seq) as date_before from t) select * from l where date is distinct from date_before",
    "directional_runs": f"with {TICKS}, {_RUNS.format(share=2)} select symbol, date, run, {r('q')} as q, {r('dp')} as dp from rn",
    "friction": f"with {TICKS}, {_RUNS.format(share=2)}, {_FRICTION} select * from fr",
    "friction_small_runs": f"with {TICKS}, {_RUNS.format(share=0.1)}, {_FRICTION} select * from fr",
    "clock_threshold": f"with {TICKS}, {_DAY} select coalesce(greatest(floor(median(volume) / 5), 10), 50000)::bigint as threshold from d",
    "path_efficiency": f"with {TICKS}, {_BUCKET}, {_EFF} select symbol, bucket, {r('efficiency')} as efficiency, idx from ef",
    "autocorrelation": f"with {TICKS}, {_BUCKET}, {_EFF}, {_ACF.format(rows='ef')} select symbol, lag, {r('acf')} as acf from ac",
    "window_length": f"""with {TICKS}, {_BUCKET}, {_EFF}, lo as (select ef.* from ef join (select symbol from ef group by symbol having count(*) > 10) using (symbol)), {_ACF.format(rows='lo')},
dr as (select symbol, coalesce(min(lag) filter (abs(acf) < 0.05), 10) as dp from ac where lag >= 1 group by symbol) select coalesce(greatest(floor(median(dp)), 2), 160)::bigint as "window" from dr""",
    "bucket_bars": f"with {TICKS}, {_BUCKET}, {_BARS} select symbol, date, seq, {', '.join(f'{common.r(c, 9)} as {c}' for c in ('close', 'delta_p', 'vwap', 'volume'))}, bar_id from ba",
    "window_targets": f"with {TICKS}, {_BUCKET}, {_BARS}, {_TARGET} select symbol, start, date, {r('target_bp')} as target_bp from wt",
    "windows": f"""with {TICKS}, {_BUCKET}, {_BARS}, {_TARGET} select wt.symbol, start, wt.date, {r('any_value(target_bp)')} as target_bp, count(*)::int as n_bars, {r('arg_max(close, bar_id)')} as last_close, {r('sum(vwap)')} as vwap_sum
 from wt join ba on ba.symbol = wt.symbol and ba.bar_id between start and start + 7 group by wt.symbol, start, wt.date""",
    "sample_keys": f"""with {TICKS}, {_BUCKET}, {_BARS}, {_TARGET} select replace(symbol, '.', '_') || '_' || lpad(k::varchar, 9, '0') as key, symbol, k as sample from (select symbol, row_number() over (partition by symbol order by start) - 1 as k from wt)""",
    "tumbling_windows": f"""with {TICKS}, w as (select *, (row_number() over (partition by symbol, date order by seq) - 1) // 5 as "window" from t) select symbol, date, "window", {r('avg(price)')} as mean_price, max(seq) as last_seq from w group by all having count(*) = 5""",
    "implied_quantity": f"""with {TICKS}, {_DAY}, {_MACRO}, {_RUNS.format(share=2)}, {_FRICTION}, {_BUCKET}, {_BARS}, j as (select ba.*, v_d, sigma_d, coalesce(fr.c, 0.842) as c from ba join ma using (symbol, date) left join fr using (symbol)),
q as (select *, sign(delta_p) * (abs(delta_p) / (c * sigma_d + 1e-8)) ** 2 * (v_d + 1e-8) as qh from j) select symbol, bar_id, {r('c')} as c, sign(qh)::double as side, {r('ln(1 + abs(qh))')} as log_q from q""",
    "swing_labels": f"""with {TICKS}, db as (select symbol, date, arg_min(price, seq) as open_price, arg_max(price, seq) as close_price, count(*) as ticks from t group by symbol, date),
b as (select *, lead(open_price) over w * 1.003::double as en, list(close_price) over (w rows between 1 following and 20 following) as cl, min(close_price) over (w rows between 1 following and 5 following) as nr, avg(close_price) over (w rows between 19 preceding and current row) as mu,
 count(*) over (w rows between 19 preceding and current row) as pa from db window w as (partition by symbol order by date)),
c as (select *, len(cl) = 20 and en > 0 as ok, list_transform(range(1, 21), lambda i: cl[i] * 0.997::double / greatest(en, list_max(cl[1:i])) - 1) as dn from b),
e as (select *, (cl[20] * 0.997::double / en - 1) / (abs(list_min(dn)) + 1e-4) as sh from c)
select symbol, date, {r('open_price')} as open_price, {r('close_price')} as close_price, ticks, case when ok then (list_max(cl) / en - 1 > 0.15)::int::double end as breakout, case when ok then {r('sign(sh) * ln(1 + abs(sh))')} end as log_sharpe,
 case when ok and pa = 20 then (nr > mu)::int::double end as phase from e""",
    "volume_bars": f"with recursive {TICKS}, {_DAY}, {_MACRO}, {_CLOCK} select {bars_rounded(steady)} from ba",
    "volume_windows": f"""with recursive {TICKS}, {_DAY}, {_MACRO}, {_CLOCK}, {_TARGET}, wb as (select wt.symbol, start, wt.date, target_bp, (ba.bar_id - start)::int as place, ba.* exclude (symbol, date) from wt join ba on ba.symbol = wt.symbol and ba.bar_id between start and start + 7)
select symbol, start, wb.date, {steady('target_bp')} as target_bp, place, bar_id, {steady('close')} as close, {steady('vwap')} as vwap, {steady('v_d')} as v_d, {steady('sigma_d')} as sigma_d, {steady('avg(vwap) over (partition by symbol, start, place // 4)')} as coarse_vwap,
 {', '.join(f"{steady('(' + ' + '.join(f'({x.format(i=i)})::float::double * {i}' for i in range(1, 11)) + ')')} as {c}" for c, x in _LEVEL.items())} from wb join t using (symbol, seq)""",
    "window_manifold": f"""with {TICKS}, {_DAY}, {_MACRO}, w as (select t.*, v_d, sigma_d, (row_number() over (partition by symbol, date order by seq) - 1) // 5 as "window", coalesce(price - lag(price) over (partition by symbol, date order by seq), 0) as dp from t join ma using (symbol, date)),
x as (select *, count(*) over (partition by symbol, date, "window") as n, (row_number() over o - 1)::int as bar, first_value(price) over o as p0, sign(dp) * (abs(dp) / (0.842::double * sigma_d + 1e-8)) ** 2 * (v_d + 1e-8) as q from w window o as (partition by symbol, date, "window" order by seq)),
y as (select *, unnest(range(10))::int as level from x where n = 5),
z as (select *, (price * (1 - 0.001::double * (level + 1)))::float::double as b, (price * (1 + case when level = 0 and l_linenumber = 5 then -0.001::double else 0.001::double * (level + 1) end))::float::double as a,
 (100 * ((l_partkey + level + 1) % 50))::double as bv, (100 * ((l_suppkey * 7 + l_orderkey + level + 1) % 50))::double as av from y),
m as (select *, greatest((a + b) / 2, 1e-6) as mid, least(greatest(q, -1e12), 1e12) as s from z)
select symbol, date, "window", bar, level, {r('(b - mid) / mid * 10000')} as bid_bp, {r('ln(1 + greatest(bv, 0))')} as log_bid_v, {r('(a - mid) / mid * 10000')} as ask_bp, {r('ln(1 + greatest(av, 0))')} as log_ask_v,
 {r('ln(greatest(price, 1e-6) / greatest(p0, 1e-6)) * 100')} as log_ret, {r('sign(s) * ln(1 + abs(s))')} as symlog_q, {r('ln(1 + greatest(v_d, 0))')} as log_v_d, {r('ln(1 + greatest(sigma_d, 0))')} as log_sigma_d from m""",
    "book_features": f"""with {TICKS}, f as (select *, {_BV} as bv, {_AV} as av, greatest((bid_p1 + ask_p1) / 2, 1e-6) as mid, first_value(price) over (partition by symbol, date order by seq) as p0 from t)
select symbol, seq, {r('(bv - av) / (bv + av + 1e-8)')} as imbalance, {r('(bid_p1 * av + ask_p1 * bv) / (bv + av + 1e-8)')} as micro, {r('ln(1 + bv + av)')} as depth, {r('(bid_p1 - mid) / mid * 10000')} as bid_bp, {r('ln(1 + greatest(vol_tick, 0))')} as log_vol,
 {r('sign(price - 1500) * ln(1 + abs(price - 1500))')} as symlog, {r('ln(greatest(price, 1e-6) / greatest(p0, 1e-6)) * 100')} as log_ret, bid_p1 <= 0 or ask_p1 <= 0 or abs(ask_p1 - bid_p1) / greatest(bid_p1, 1e-8) < 0.001 as locked,
 case when symbol[1:3] in ('688', '300', '301') then 2000 else 1000 end as limit_bp from f""",
}
