"""Queries of the evaluation operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev
from tidemark.plans.common import P, avg_rank, corr, r, rounded
from tidemark.sources import fixtures

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


def _on_predictions(operator, spark: SparkSession, folder: str) -> DataFrame:
    return rounded(operator(fixtures.predictions(spark, folder)))


def _board(df: DataFrame) -> DataFrame:
    return ev.breakdown(df, F.substring("symbol", 1, 3))


def _quarter(df: DataFrame) -> DataFrame:
    return ev.breakdown(df, F.concat(F.substring("date", 1, 4), F.lit("Q"), F.ceil(F.substring("date", 5, 2).cast("int") / 3)))


def _year(df: DataFrame) -> DataFrame:
    return ev.breakdown(df, F.substring("date", 1, 4))


def _liquidity(df: DataFrame) -> DataFrame:
    """Quartiles of volume by quantile cut."""
    return ev.breakdown(ev.cut_deciles(df, "macro_v_d", "quartile", 4), F.col("quartile"))


def _losses(spark: SparkSession, folder: str) -> DataFrame:
    vectors = fixtures.table(spark, folder, "embeddings").select(((F.col("vec_id") * 37) % 101 - 50.0).alias("pred_bp"), ((F.col("vec_id") * 13) % 89 - 44.0).alias("target_bp"), "embedding")
    return rounded(ev.loss_metrics(vectors, "embedding"))


def _sparsity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.sparsity(fixtures.table(spark, folder, "embeddings"), "vec_id", "embedding", 0.05))


OPERATORS = {
    "global_ic": ev.global_ic,
    "daily_ic": ev.daily_ic,
    "target_profile": partial(ev.distribution_profile, column="target_bp"),
    "decile_table": ev.decile_table,
    "decile_spread": lambda df: ev.decile_spread(ev.decile_table(df)),
    "spread_calibration": ev.spread_calibration,
    "sentinel": ev.sentinel,
    "decile_report": ev.decile_report,
    "sparsity_deciles": partial(ev.decile_report, by="z_sparsity"),
    "key_correlations": ev.key_correlations,
    "daily_cross_section": ev.daily_cross_section,
    "daily_summary": lambda df: ev.series_summary(ev.daily_cross_section(df), ["ic", "rank_ic", "spread", "monotonicity"]),
    "global_against_daily": ev.global_against_daily,
    "daily_edge_deciles": ev.daily_edge_deciles,
    "daily_decile_scores": ev.daily_decile_scores,
    "split_ic": partial(ev.split_ic, first_out=800, order=ORDER),
    "guarded_shard_ic": partial(ev.guarded_ic, key="shard_idx"),
    "validation_summary": ev.validation_summary,
    "entity_counts": ev.entity_counts,
    "breakdown_board": _board,
    "breakdown_quarter": _quarter,
    "breakdown_year": _year,
    "breakdown_liquidity": _liquidity,
    "conditional_ic": partial(ev.conditional_ic, thresholds=[0, 5, 10, 20, 30]),
    "side_means": ev.side_means,
    "tail_capture": ev.tail_capture,
    "ic_drivers": ev.ic_drivers,
    "pooled_means": ev.pooled_means,
    "pooling_report": ev.pooling_report,
    "signal_resolution": ev.signal_resolution,
    "quintile_spread": ev.quintile_spread,
    "prediction_buckets": ev.prediction_buckets,
    "daily_zscore": lambda df: ev.daily_zscore(df).select("date", "symbol", "l_orderkey", "l_linenumber", "l_partkey", "z"),
}
QUERIES = {name: partial(_on_predictions, operator) for name, operator in OPERATORS.items()} | {"loss_metrics": _losses, "vector_sparsity": _sparsity}

SHARES = "[" + ", ".join(str(i / 10) for i in range(1, 10)) + "]"
_IC = f"select {{keys}}, count(*) as n, {corr('x', 'y')} as ic from {{rows}} group by {{keys}}"


def _ic(keys: str, rows: str = "p", least: int = 10) -> str:
    return f"(select {keys}, count(*) as n, {corr('x', 'y')} as ic from {rows} group by {keys} having count(*) >= {least})"


_RANKED = f"k as (select *, {avg_rank('x', 'date')} as xr, {avg_rank('y', 'date')} as yr from p)"
_DAILY = f"day as (select date, count(*) as n, {corr('x', 'y')} as ic, {corr('xr', 'yr')} as rank_ic from k group by date having count(*) >= {{least}})"
_EDGE = " union all ".join(["select 1 as d, *, x <= e[1] as inside from q", *[f"select {i} as d, *, x > e[{i - 1}] and x <= e[{i}] as inside from q" for i in range(2, 10)], "select 10 as d, *, x >= e[9] as inside from q"])
_DECILES = f"q as (select *, (select quantile_cont(x, {SHARES}) from p) as e from p), dec as (select * from ({_EDGE}) where inside)"
_TABLE = """tab as (select d::int as decile, count(*) as n, avg(x) as mean_pred, avg(y) as mean_actual, avg((y > 0)::int) as hit_rate, coalesce(avg(y) filter (y > 0), 0) as mean_win,
 coalesce(avg(-y) filter (y < 0), 0) as mean_loss from dec group by d)"""
_SPREAD = "spr as (select max(mean_actual) filter (decile = 10) as top, max(mean_actual) filter (decile = 1) as bottom, sum((nxt - mean_actual > 1e-9)::int) as rises from (select *, lead(mean_actual) over (order by decile) as nxt from tab))"


def _cut(column: str, parts: int = 10, rows: str = "p", name: str = "decile") -> str:
    shares = "[" + ", ".join(str(i / parts) for i in range(parts + 1)) + "]"
    return f"(select *, len(list_filter(e[2:len(e) - 1], lambda v: v < {column}))::int as {name} from (select *, (select list_sort(list_distinct(quantile_cont({column}, {shares}))) from {rows}) as e from {rows}))"


def _cut_daily(parts: int) -> str:
    shares = "[" + ", ".join(str(i / parts) for i in range(parts + 1)) + "]"
    return f"""big as (select * from (select *, count(*) over (partition by date) as c from p) where c >= 50),
ed as (select date, list_sort(list_distinct(quantile_cont(x, {shares}))) as e from big group by date),
cut as (select big.*, len(list_filter(e[2:len(e) - 1], lambda v: v < x)) as decile from big join ed using (date)),
dm as (select date, decile, avg(y) as m from cut group by date, decile),
st as (select *, lead(m) over (partition by date order by decile) as nx from dm),
shape as (select date, arg_max(m, decile) - arg_min(m, decile) as spread, avg((nx - m > 1e-9)::int) as monotonicity from st group by date)"""


def _report(by: str) -> str:
    return f"""with {P}, c as {_cut(by)}
select decile, count(*) as n, {r(f'avg({by})')} as mean_by, {r('avg(y)')} as mean_target, {r('avg(abs(x))')} as mean_abs_pred, case when count(*) > 2 then {r(corr('x', 'y'))} end as ic,
 case decile when 0 then 'LOW' when 9 then 'HIGH' end as tag from c group by decile"""


def _break(part: str, rows: str = "p") -> str:
    return f"""with {P}, b as (select *, {part} as part from {rows}), dd as {_ic('part, date', 'b')}
select part, count(*) as dates, {r('avg(ic)')} as ic, {r('avg(ic) / (stddev_pop(ic) + 1e-8)')} as icir, {r('avg((ic > 0)::int)')} as positive from dd where ic is not null group by part"""


_SUMMARY = " union all ".join(f"select '{c}' as series, date, {c} as v from full_day" for c in ("ic", "rank_ic", "spread", "monotonicity"))
_WITH_DAILY = f"with {P}, {_RANKED}, {_DAILY.format(least=50)}"
_VALID = f"from (select *, {avg_rank('x')} as xr, {avg_rank('y')} as yr from p)"

ORACLES = {
    "global_ic": f"""with {P}, s as (select count(*) as n, {corr('x', 'y')} as ic, {corr('xr', 'yr')} as rk {_VALID})
select n, {r('ic')} as ic, {r('ic * ic')} as r2, {r('rk')} as rank_ic, {r('rk * sqrt((n - 2) / (1 - rk * rk))')} as t_stat, {r('rk * sqrt(n)')} as z_stat from s""",
    "daily_ic": f"{_WITH_DAILY} select date, n, {r('ic')} as ic, {r('rank_ic')} as rank_ic from day",
    "target_profile": f"""with {P}, m as (select *, avg(y) over () as mu from p)
select count(*) as n, {r('avg(y)')} as mean, {r('stddev_pop(y)')} as std, {r('(avg((y - mu) ** 3)) / stddev_pop(y) ** 3')} as skew, {r('kurtosis_pop(y)')} as kurtosis, {r('min(y)')} as min, {r('max(y)')} as max,
 {r('avg(y) / stddev_pop(y)')} as mean_over_std, {', '.join(f"{r(f'quantile_cont(y, {v})')} as {k}" for k, v in {'p1': .01, 'p5': .05, 'p25': .25, 'median': .5, 'p75': .75, 'p95': .95, 'p99': .99}.items())} from m""",
    "decile_table": f"""with {P}, {_DECILES}, {_TABLE} select decile, n, {', '.join(f'{r(c)} as {c}' for c in ('mean_pred', 'mean_actual', 'hit_rate', 'mean_win', 'mean_loss'))},
 case when mean_loss > 0 then {r('mean_win / mean_loss')} else 'infinity'::double end as payoff, {r('mean_actual - 25')} as mean_net from tab""",
    "decile_spread": f"""with {P}, {_DECILES}, {_TABLE}, {_SPREAD} select {r('top')} as top, {r('bottom')} as bottom, {r('top - bottom')} as spread, rises::bigint as rises, {r('top - 25')} as net,
 case when top - 25 > 5 then 'strong' when top - 25 > 0 then 'pass' else 'fail' end as verdict from spr""",
    "spread_calibration": f"""with {P}, {_DECILES}, {_TABLE}, {_SPREAD}, s as (select top - bottom as spread, (select stddev_pop(x) from p) as sp, (select stddev_samp(x) from p) as ss from spr)
select {r('spread')} as spread, {r('sp')} as std_pop, {r('ss')} as std_samp, {r('spread / sp')} as ratio, case when spread > 0 then {r('25 / (spread / sp)')} else 0 end as cost_threshold,
 case when spread > 0 then {r('50 / (spread / sp)')} else 0 end as safe_threshold from s""",
    "sentinel": f"""with {P}, c as {_cut('x')}, m as (select decile, avg(y) as m from c group by decile), s as (select (select arg_max(m, decile) - arg_min(m, decile) from m) as spread, (select stddev_samp(x) from p) as std)
select {r('spread')} as spread, {r('std')} as std, {r('spread / std')} as ratio, case when spread > 0 then {r('25 / (spread / std) / 3')} else 'infinity'::double end as error, case when spread > 0 then {r('25 / (spread / std)')} else 'infinity'::double end as warn,
 case when spread > 0 then {r('50 / (spread / std)')} else 'infinity'::double end as healthy, spread > 25 as covered from s""",
    "decile_report": _report("x"),
    "sparsity_deciles": _report("z_sparsity"),
    "key_correlations": f"with {P} select {r(corr('x', 'y'))} as pred_target, {r(corr('z_sparsity', 'x'))} as z_pred, {r(corr('z_sparsity', 'abs(x)'))} as z_abs_pred, {r(corr('z_sparsity', 'y'))} as z_target from p",
    "daily_cross_section": f"{_WITH_DAILY}, {_cut_daily(10)} select date, n, {r('ic')} as ic, {r('rank_ic')} as rank_ic, {r('spread')} as spread, {r('monotonicity')} as monotonicity from day join shape using (date)",
    "daily_summary": f"""{_WITH_DAILY}, {_cut_daily(10)}, full_day as (select * from day join shape using (date)), lng as ({_SUMMARY})
select series, count(*) as days, {r('avg(v)')} as mean, {r('stddev_pop(v)')} as std, {r('avg(v) / (stddev_pop(v) / sqrt(count(*)) + 1e-8)')} as t, {r('avg(v) / (stddev_pop(v) + 1e-8)')} as icir, {r('avg((v > 0)::int)')} as positive from lng where v is not null group by series""",
    "global_against_daily": f"""{_WITH_DAILY}, {_cut_daily(10)}, g as (select {corr('x', 'y')} as pooled_ic, {corr('xr', 'yr')} as pooled_rank_ic {_VALID}), c as {_cut('x')}, m as (select decile, avg(y) as m from c group by decile),
gs as (select arg_max(m, decile) - arg_min(m, decile) as pooled_spread from m), d as (select avg(ic) as daily_ic, avg(rank_ic) as daily_rank_ic, avg(spread) as daily_spread from day join shape using (date))
select {', '.join(f'{r(c)} as {c}' for c in ('pooled_ic', 'pooled_rank_ic', 'pooled_spread', 'daily_ic', 'daily_rank_ic', 'daily_spread'))},
 case when daily_spread is null then 'INSUFFICIENT' when daily_spread > 25 then 'TRADEABLE' when daily_spread > 5 then 'MARGINAL' when daily_spread > 0 then 'WEAK POSITIVE' else 'NEGATIVE' end as verdict,
 case when daily_spread > 0 and pooled_spread <= 0 then 'HIDDEN' when daily_spread <= 0 and pooled_spread <= 0 then 'ABSENT' end as remark from g, gs, d""",
    "daily_edge_deciles": f"""with {P}, big as (select * from (select *, count(*) over (partition by date) as c from p) where c >= 100), ed as (select date, quantile_cont(x, {SHARES}) as e from big group by date),
q as (select big.*, e from big join ed using (date)), dec as (select * from ({_EDGE}) where inside), dm as (select date, d, avg(y) as m from dec group by date, d)
select d::int as decile, count(*) as dates, {r('avg(m)')} as mean_target from dm group by d""",
    "daily_decile_scores": f"""with {P}, big as (select * from (select *, count(*) over (partition by date) as c from p) where c >= 100), ed as (select date, quantile_cont(x, {SHARES}) as e from big group by date),
q as (select big.*, e from big join ed using (date)), dec as (select * from ({_EDGE}) where inside), dm as (select date, d::int as d, avg(y) as m from dec group by all),
gd as (select date, g.d, coalesce(m, 0) as m, lead(coalesce(m, 0)) over (partition by date order by g.d) as nx from ed cross join (select unnest(range(1, 11))::int as d) g left join dm using (date, d)),
rs as (select date, sum((m < nx)::int) as rises, max(m) filter (d = 10) as hi, max(m) filter (d = 1) as lo from gd group by date)
select count(*) as dates, {r('avg(rises)')} as monotonicity, {r('avg((rises >= 5)::int)')} as share_5, {r('avg(hi) - avg(lo)')} as long_short from rs""",
    "split_ic": f"""with {P}, f as (select date, arg_min(shard_idx, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) as shard from p group by date), dd as {_ic('date')}
select case when shard < 800 then 'in' else 'out' end as part, count(ic) as dates, {r('avg(ic)')} as ic from dd join f using (date) group by 1""",
    "guarded_shard_ic": f"with {P} select shard_idx, count(*) as n, case when count(*) < 2 then 0 else {r('covar_pop(x, y) / (sqrt(var_pop(x) + 1e-8) * sqrt(var_pop(y) + 1e-8))')} end as ic from p group by shard_idx",
    "validation_summary": f"""with {P}, k as (select greatest(count(*) // 10, 1) as k, count(*) as n from p), ml as (select x, count(*) as c, avg(y) as m, sum(count(*)) over (order by x) as upto from p group by x),
e as (select sum(greatest(upto - greatest(upto - c, n - k), 0) * m) / any_value(k) - sum(greatest(least(upto, k) - (upto - c), 0) * m) / any_value(k) as tb from ml, k),
s as (select {corr('x', 'y')} as ic, {corr('xr', 'yr')} as rk, stddev_samp(x) as std {_VALID})
select coalesce({r('ic')}, 0) as ic, coalesce({r('rk')}, 0) as rank_ic, {r('tb')} as top_less_bottom, {r('std')} as std, case when std < 10 then 'error' when std < 30 then 'warn' else 'ok' end as collapse from s, e""",
    "entity_counts": f"with {P} select count(*) as n, count(distinct symbol) as symbols, count(distinct date) as dates, count(distinct shard_idx) as shards from p",
    "breakdown_board": _break("symbol[1:3]"),
    "breakdown_quarter": _break("date[1:4] || 'Q' || ceil(date[5:6]::int / 3)::int"),
    "breakdown_year": _break("date[1:4]"),
    "breakdown_liquidity": _break("quartile", _cut("macro_v_d", 4, name="quartile")),
    "conditional_ic": f"""with {P}, m as (select date, median(x) as md from p group by date), f as (select p.*, threshold from p join m using (date), (values (0.0::double), (5), (10), (20), (30)) t(threshold) where abs(x - md) > threshold), dd as {_ic('threshold, date', 'f')}
select threshold, {r('avg(ic)')} as ic, {r('avg(n)')} as rows_a_day from dd group by threshold""",
    "side_means": f"""with {P}, big as (select * from (select *, count(*) over (partition by date) as c from p) where c >= 100), ed as (select date, quantile_cont(x, [0.1, 0.9]) as e from big group by date),
s as (select date, case when x >= e[2] then 'long' when x <= e[1] then 'short' else 'middle' end as side, avg(y) as m from big join ed using (date) group by 1, 2)
select date[1:4] as year, side, count(*) as dates, {r('avg(m)')} as mean_target from s group by 1, 2""",
    "tail_capture": f"""with {P}, c as (select quantile_cont(y, [0.01, 0.05, 0.95, 0.99]) as q, quantile_cont(x, 0.9) as top from p),
l as (select 'bottom 1' as tail, x, top from p, c where y <= q[1] union all select 'bottom 5', x, top from p, c where y <= q[2] union all select 'top 5', x, top from p, c where y >= q[3] union all select 'top 1', x, top from p, c where y >= q[4])
select tail, count(*) as n, {r('avg((x >= top)::int)')} as share, {r('avg((x >= top)::int) / 0.1')} as lift from l group by tail""",
    "ic_drivers": f"""with {P}, dd as {_ic('date', least=50)}, s as (select date, stddev_pop(x) as ps, stddev_pop(y) as ts, avg(macro_v_d) as vol from p group by date), j as (select * from dd join s using (date) where ic is not null)
select {r(corr('ic', 'ps'))} as ic_pred_std, {r(corr('ic', 'ts'))} as ic_target_std, {r(corr('ic', 'n'))} as ic_n, {r(corr('ic', 'vol'))} as ic_volume from j""",
    "pooled_means": f"with {P} select 'date' as pooled_by, count(*) as groups, {r('avg(ic)')} as ic from {_ic('date', least=3)} where ic is not null union all select 'shard_idx', count(*), {r('avg(ic)')} from {_ic('shard_idx', least=3)} where ic is not null",
    "pooling_report": f"with {P} select 'date' as pooled_by, count(*) as groups, {r('avg(ic)')} as ic from {_ic('date', least=3)} where ic is not null union all select 'shard_idx', count(*), {r('avg(ic)')} from {_ic('shard_idx', least=3)} where ic is not null union all select 'all', 1, {r(corr('x', 'y'))} from p",
    "signal_resolution": f"""with {P}, q as (select quantile_cont(x, [0.25, 0.5, 0.75]) as q from p), m as (select p.*, q, avg(y) over () as mu from p, q)
select {r('avg((abs(x - q[2]) <= 10)::int)')} as near_median, {r('stddev_pop(y)')} as target_std, {r('avg((y - mu) ** 3) / stddev_pop(y) ** 3')} as target_skew, {r('kurtosis_pop(y)')} as target_kurtosis, {r('any_value(q[3] - q[1])')} as iqr from m""",
    "quintile_spread": f"""{_WITH_DAILY}, {_cut_daily(5)} select count(*) as dates, {r('avg(spread)')} as mean_spread, {r('median(spread)')} as median_spread, {r('avg((spread > 25)::int)')} as over_25, {r('avg((spread > 0)::int)')} as over_0,
 {r('median(ic)')} as median_ic from day join shape using (date)""",
    "prediction_buckets": f"""with {P}, c as (select s as share, (select quantile_cont(x, 0.9) from p) as e from (values (0.1::double)) t(s) union all select 0.2, (select quantile_cont(x, 0.8) from p) union all select 0.5, (select quantile_cont(x, 0.5) from p))
select share, count(*) as n, {r('avg(y)')} as mean_target, {r('avg((y > 0)::int)')} as hit_rate, {r('avg(y) filter (y > 0) / avg(-y) filter (y < 0)')} as win_over_loss from p, c where x >= e group by share""",
    "daily_zscore": f"""with {P} select date, symbol, l_orderkey, l_linenumber, l_partkey, {r('z')} as z from (select *, (x - avg(x) over (partition by date)) / (stddev_pop(x) over (partition by date) + 1e-8) as z, count(*) over (partition by date) as c from p) where c >= 50""",
    "loss_metrics": f"""with v as (select (vec_id * 37) % 101 - 50.0::double as x, (vec_id * 13) % 89 - 44.0::double as y, list_sum(list_transform(embedding, lambda a: abs(a)::double)) as l1, list_sum(list_transform(embedding, lambda a: least(abs(a)::double, 20))) as l2 from embeddings),
w as (select *, (greatest(least((case when y < 0 then y * 0.1 else y end) - 40, 500), -500) - x) as sc from v)
select case when var_pop(y) < 1e-8 then 1 else {r('avg((x - y) ** 2) / var_pop(y)')} end as fvu, {r('avg((x - y) ** 2) + 0.0001 * avg(l1)')} as mdl, {r('avg(sc * sc) / 10000 + 0.0001 * avg(l2)')} as sparse_loss from w""",
    "vector_sparsity": f"select vec_id, {r('len(list_filter(embedding, lambda a: abs(a) < 0.05)) / len(embedding)::double')} as sparsity from embeddings",
}
