"""Queries of selection, trade outcomes and risk."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import risk, selection
from tidemark.plans.common import P, r, rounded
from tidemark.sources import fixtures

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
GATES = {"boards": ("688",), "cap": 60.0, "sparsity_percentile": 20.0, "conviction": 1.0, "least_volume": 500_000.0}
# What the scorecard asks for.
TARGETS = [("win_rate", 0.5, "ge"), ("asymmetry", 1.0, "gt"), ("profit_factor", 1.0, "gt"), ("mean_loss", 150.0, "le")]


def _gated(p: DataFrame) -> DataFrame:
    return selection.gated(p, **GATES)


def _entries(p: DataFrame) -> DataFrame:
    return selection.daily_top(selection.one_of_each_symbol(_gated(p).filter("gate is null"), ORDER), ORDER)


def _trades(p: DataFrame) -> DataFrame:
    return selection.trade_outcomes(selection.exits(_entries(p), p, ORDER).filter("exit_date is not null").withColumn("target_bp", F.col("target_bp") * 20))


def _returns(p: DataFrame) -> DataFrame:
    """Mean target of the day's ten best predictions, for each board."""
    board = p.withColumn("config", F.substring("symbol", 1, 3))
    place = F.row_number().over(fixtures.Window.partitionBy("config", "date").orderBy(F.desc("pred_bp"), *ORDER))
    return board.withColumn("_r", place).filter("_r <= 10").groupBy("config", "date").agg((F.avg("target_bp") / 10000).alias("ret"))


def _curve(p: DataFrame) -> DataFrame:
    return risk.equity_curve(_returns(p))


def _scorecard(p: DataFrame) -> DataFrame:
    stats = risk.trade_stats(_trades(p))
    metrics = stats.select(F.expr("stack(4, 'win_rate', win_rate, 'asymmetry', asymmetry, 'profit_factor', profit_factor, 'mean_loss', mean_loss) as (metric, value)"))
    return risk.scorecard(metrics, p.sparkSession.createDataFrame(TARGETS, "metric string, target double, comparator string"))


def _sweep(p: DataFrame) -> DataFrame:
    """Mean target with and without a conviction gate and a prediction cap, per board kind."""
    flags = p.withColumns({"convinced": F.explode(F.array(F.lit(0), F.lit(1))), "wide": (F.substring("symbol", 1, 3).isin("688", "300")).cast("int")})
    kept = flags.filter((F.col("convinced") == 0) | (F.col("pred_bp") > 20))
    return risk.sweep_deltas(kept.groupBy("convinced", "wide").agg(F.avg("target_bp").alias("mean")), ["convinced", "wide"], "convinced", "mean")


def _overlap(p: DataFrame) -> DataFrame:
    return selection.overlap(_entries(p), selection.calendar(p))


OPERATORS = {
    "gate_counts": lambda p: selection.gate_counts(_gated(p)),
    "daily_top": lambda p: _entries(p).select("date", "symbol", "rank", "pred_bp"),
    "exits": lambda p: selection.exits(_entries(p), p, ORDER).select("symbol", "date", "exit_date", "hold_days"),
    "trades": lambda p: _trades(p).select("symbol", "date", "exit_date", "target_bp", "capped_bp", "pnl_bp", "exit_reason"),
    "trade_stats": lambda p: risk.trade_stats(_trades(p)),
    "exit_reasons": lambda p: risk.exit_reasons(_trades(p)),
    "break_even": lambda p: risk.break_even(_trades(p)),
    "scorecard": _scorecard,
    "verdict": lambda p: risk.verdict(risk.trade_stats(_trades(p))),
    "equity_curve": _curve,
    "risk_metrics": lambda p: risk.risk_metrics(_curve(p)),
    "regime": lambda p: risk.regime(_curve(p), 5, -0.001).select("config", "date", "bear"),
    "sweep_deltas": _sweep,
    "overlap": _overlap,
}


def _run(operator, spark: SparkSession, folder: str) -> DataFrame:
    return rounded(operator(fixtures.predictions(spark, folder)))


QUERIES = {name: partial(_run, operator) for name, operator in OPERATORS.items()}

_O = "l_shipdate, l_orderkey, l_linenumber, l_partkey"
_LOCK = "(bid_p1 <= 0 or ask_p1 <= 0 or abs(ask_p1 - bid_p1) / greatest(bid_p1, 1e-8) < 0.001)"
_GATED = f"""dy as (select date, quantile_cont(z_sparsity, 0.2) as zq, median(x) as md from p group by date),
g as (select p.*, case when starts_with(symbol, '688') then 'board' when abs(x) > 60 then 'cap' when z_sparsity < zq then 'sparsity' when {_LOCK} then 'locked' when x < md + 1 then 'conviction' when macro_v_d < 500000 then 'volume' end as gate from p join dy using (date))"""
_TOP = f"""on1 as (select * from (select *, row_number() over (partition by symbol, date order by x desc, {_O}) as k from g where gate is null) where k = 1),
rk as (select *, row_number() over (partition by date order by x desc, {_O})::int as rank, least(greatest(floor(count(*) over (partition by date) * (1 - 0.8::double)), 1), 50) as w from on1), en as (select * from rk where rank <= w)"""
_EXITS = f"""ca as (select date, row_number() over (order by date) - 1 as day from (select distinct date from p)),
lk as (select symbol, day from (select *, row_number() over (partition by symbol, date order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_partkey desc) as k from p) join ca using (date) where k = 1 and {_LOCK}),
ex as (select en.*, (select min(d) from (select unnest(range(ca.day + 1, ca.day + 200)) as d) where not (y < 0 and exists (select 1 from lk where lk.symbol = en.symbol and lk.day = d))) as xd, ca.day as ed from en join ca using (date)),
xx as (select ex.*, c2.date as exit_date, case when c2.date is not null then xd - ed end as hold_days from ex left join ca c2 on c2.day = xd)"""
_TRADES = """t0 as (select *, y * 20 as tb, case when symbol[1:3] in ('688', '300', '301') then 2000 else 1000 end * greatest(hold_days, 1) as lim from xx where exit_date is not null),
tr as (select *, greatest(tb, -lim)::double as cp, case when tb < -1000 or greatest(tb, -lim) < -1000 then 'trailing_stop' else 'natural_horizon' end as exit_reason from t0)"""
_ALL = f"with {P}, {_GATED}, {_TOP}"
_TR = f"{_ALL}, {_EXITS}, {_TRADES}"
_STATS = """ts as (select count(*) as n, coalesce(avg((pn > 0)::int), 0) as win_rate, coalesce(avg(pn) filter (pn > 0), 0) as mean_win, coalesce(avg(-pn) filter (pn < 0), 1) as mean_loss, coalesce(sum(pn) filter (pn > 0), 0) as won, sum(-pn) filter (pn < 0) as lost
 from (select *, cp - 12.5 as pn from tr)), tt as (select n, win_rate, mean_win, mean_loss, mean_win / mean_loss as asymmetry, coalesce(won / (lost + 1e-10), 'infinity'::double) as profit_factor from ts)"""
_CURVE = f"""with {P}, b as (select *, symbol[1:3] as config from p), k as (select *, row_number() over (partition by config, date order by x desc, {_O}) as k from b), re as (select config, date, avg(y) / 10000 as ret from k where k <= 10 group by config, date),
nv as (select *, exp(sum(ln(1 + ret)) over (partition by config order by date)) as nav from re), cu as (select *, nav / max(nav) over (partition by config order by date) - 1 as drawdown from nv)"""

ORACLES = {
    "gate_counts": f"with {P}, {_GATED} select coalesce(gate, 'passed') as gate, count(*) as n from g group by 1",
    "daily_top": f"{_ALL} select date, symbol, rank, {r('x')} as pred_bp from en",
    "exits": f"{_ALL}, {_EXITS} select symbol, date, exit_date, hold_days from xx",
    "trades": f"{_TR} select symbol, date, exit_date, {r('tb')} as target_bp, {r('cp')} as capped_bp, {r('cp - 12.5')} as pnl_bp, exit_reason from tr",
    "trade_stats": f"{_TR}, {_STATS} select n, {', '.join(f'{r(c)} as {c}' for c in ('win_rate', 'mean_win', 'mean_loss', 'asymmetry', 'profit_factor'))} from tt",
    "exit_reasons": f"{_TR} select exit_reason, count(*) as n, {r('avg(cp - 12.5)')} as mean_pnl from tr group by exit_reason",
    "break_even": f"{_TR} select coalesce(min(c), 100) as break_even from (select c, sum(cp - 12.5 + 25 - c) as s from tr, (select unnest(range(25, 100)) as c) group by c) where s <= 0",
    "scorecard": f"""{_TR}, {_STATS}, mt as (select 'win_rate' as metric, win_rate as value, 0.5::double as target, 'ge' as comparator from tt union all select 'asymmetry', asymmetry, 1, 'gt' from tt union all select 'profit_factor', profit_factor, 1, 'gt' from tt
 union all select 'mean_loss', mean_loss, 150, 'le' from tt) select metric, {r('value')} as value, target, comparator, coalesce(case comparator when 'ge' then value >= target when 'gt' then value > target else value <= target end, false) as met from mt""",
    "verdict": f"{_TR}, {_STATS} select {r('asymmetry')} as asymmetry, {r('profit_factor')} as profit_factor, case when asymmetry > 3 and profit_factor > 1.5 then 'PASS' when asymmetry > 2 and profit_factor > 1.2 then 'CONDITIONAL' else 'FAIL' end as verdict from tt",
    "equity_curve": f"{_CURVE} select config, date, {r('ret')} as ret, {r('nav')} as nav, {r('drawdown')} as drawdown from cu",
    "risk_metrics": f"""{_CURVE}, il as (select *, sum((drawdown >= 0)::int) over (partition by config order by date) as i from cu), ru as (select config, max(u) as underwater_days from (select config, i, sum((drawdown < 0)::int)::bigint as u from il group by config, i) group by config),
s as (select config, count(*) as days, arg_max(nav, date) as nav, avg(ret) as mu, stddev_pop(ret) as sd, stddev_pop(ret) filter (ret < 0) as dn, min(drawdown) as max_drawdown from cu group by config)
select config, days, {r('nav - 1')} as total_return, {r('nav ** (252.0::double / days) - 1')} as annual_return, {r('mu / (sd + 1e-10) * sqrt(252)')} as sharpe, {r('coalesce(mu / (dn + 1e-10) * sqrt(252), 0)')} as sortino, {r('max_drawdown')} as max_drawdown, underwater_days,
 case when max_drawdown <> 0 then {r('(nav ** (252.0::double / days) - 1) / abs(max_drawdown)')} else 0 end as calmar from s join ru using (config)""",
    "regime": f"{_CURVE} select config, date, coalesce(lag(nav, 1) over w / lag(nav, 5) over w - 1 < -0.001, false) as bear from cu window w as (partition by config order by date)",
    "sweep_deltas": f"""with {P}, f as (select *, symbol[1:3] in ('688', '300') as w from p), m as (select w::int as wide, avg(y) as off, avg(y) filter (x > 20) as on_ from f group by 1) select wide, 'convinced' as factor, {r('on_ - off')} as delta from m""",
    "overlap": f"""{_ALL}, {_EXITS}, ch as (select distinct symbol, day from en join ca using (date)), n as (select day, count(*) as n from ch group by day)
select ca.date, {r('count(b.symbol) / any_value(n2.n)::double')} as overlap from ch a join ca using (day) join n n2 on n2.day = a.day + 1 left join ch b on b.symbol = a.symbol and b.day = a.day + 1 group by ca.date""",
}
