"""Tick and prediction tables derived from the `lineitem` table by plain expressions.

`ticks` and `predictions` are DataFrames; `TICKS_SQL` and `PREDICTIONS_SQL` are the same
expressions as DuckDB subqueries, for the checks against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = 10
ORDER_KEY = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
BOOK_KEYS = ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")

_SYMBOL = """concat(case l_suppkey % 5 when 0 then '600' when 1 then '000' when 2 then '300' when 3 then case when l_suppkey % 2 = 1 then '688' else '689' end
 else case when l_suppkey % 2 = 1 then '302' else '159' end end, lpad(cast(l_suppkey % 1000 as varchar(10)), 3, '0'), case when l_suppkey % 5 in (0, 3) then '.SH' else '.SZ' end)"""
_PRED = "l_discount * 700 + l_tax * 300 + l_quantity * 0.37D - 20"
_TARGET = "((l_partkey * 31 + l_orderkey * 17) % 2001 - 1000) / 5.0D"
_SPARSITY = "((l_suppkey * 13 + l_linenumber * 7 + l_orderkey) % 100) / 100.0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """symbol, date, seq, price, vol_tick, bs_flag and the keys that the quoted levels are made of; seq is unique within a symbol."""
    rows = table(spark, folder, "lineitem").selectExpr("*", f"{_SYMBOL} as symbol", "date_format(l_shipdate, 'yyyyMM01') as date", "l_extendedprice / l_quantity as price")
    order = Window.partitionBy("symbol").orderBy(*ORDER_KEY)
    return rows.withColumn("seq", F.row_number().over(order)).selectExpr(
        "symbol", "date", "seq", "price", "case when l_linenumber = 7 then 0.0D else l_quantity end as vol_tick", "case when l_linenumber = 6 then null else l_returnflag end as bs_flag", *BOOK_KEYS
    )


def quoted(keyed: DataFrame, levels: int = LEVELS) -> DataFrame:
    """keyed_ticks with the quoted levels instead of their keys: after what needs narrow rows only."""
    book = [
        expr
        for i in range(1, levels + 1)
        for expr in (
            f"price * (1 - 0.001D * {i}) as bid_p{i}",
            f"cast(100 * ((l_partkey + {i}) % 50) as double) as bid_v{i}",
            (f"case when l_linenumber = 5 then price * (1 - 0.001D) else price * (1 + 0.001D) end as ask_p{i}" if i == 1 else f"price * (1 + 0.001D * {i}) as ask_p{i}"),
            f"cast(100 * ((l_suppkey * 7 + l_orderkey + {i}) % 50) as double) as ask_v{i}",
        )
    ]
    return keyed.selectExpr(*[f"`{c}`" for c in keyed.columns if c not in BOOK_KEYS], *book)


def ticks(spark: SparkSession, folder: str, levels: int = LEVELS) -> DataFrame:
    """keyed_ticks with the quoted levels."""
    return quoted(keyed_ticks(spark, folder), levels)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """symbol, date, shard_idx, pred_bp, target_bp, bid_p1, ask_p1, macro_v_d, z_sparsity and row_key (unique)."""
    rows = table(spark, folder, "lineitem").selectExpr("*", f"{_SYMBOL} as symbol", "date_format(l_shipdate, 'yyyyMM01') as date", "l_extendedprice / l_quantity as price")
    dates = rows.select("date").distinct().withColumn("date_no", F.dense_rank().over(Window.orderBy("date")) - 1)
    return rows.join(F.broadcast(dates), "date").selectExpr(
        "symbol", "date", "20L * date_no + l_orderkey % 20 as shard_idx", f"{_PRED} as pred_bp", f"{_TARGET} as target_bp", "price * (1 - 0.001D) as bid_p1",
        "case when l_linenumber = 5 then price * (1 - 0.001D) else price * (1 + 0.001D) end as ask_p1", "l_quantity * 100000 as macro_v_d", f"{_SPARSITY} as z_sparsity",
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
    )


def _duck(expr: str) -> str:
    return expr.replace("0.37D", "0.37::double").replace("5.0D", "5.0::double").replace("100.0D", "100.0::double").replace("0.001D", "0.001::double")


TICKS_SQL = _duck(
    f"""(select symbol, date, row_number() over (partition by symbol order by {', '.join(ORDER_KEY)}) as seq, price,
 case when l_linenumber = 7 then 0.0::double else l_quantity end as vol_tick,
 case when l_linenumber = 6 then null else l_returnflag end as bs_flag,
 price * (1 - 0.001D) as bid_p1, case when l_linenumber = 5 then price * (1 - 0.001D) else price * (1 + 0.001D) end as ask_p1, l_partkey, l_suppkey, l_orderkey, l_linenumber
 from (select *, {_SYMBOL} as symbol, strftime(l_shipdate, '%Y%m01') as date, l_extendedprice / l_quantity as price from lineitem))"""
)
PREDICTIONS_SQL = _duck(
    f"""(select symbol, date, 20 * (dense_rank() over (order by date) - 1) + l_orderkey % 20 as shard_idx, {_PRED} as pred_bp, {_TARGET} as target_bp,
 price * (1 - 0.001D) as bid_p1, case when l_linenumber = 5 then price * (1 - 0.001D) else price * (1 + 0.001D) end as ask_p1,
 l_quantity * 100000 as macro_v_d, {_SPARSITY} as z_sparsity, l_orderkey, l_linenumber, l_partkey, l_shipdate
 from (select *, {_SYMBOL} as symbol, strftime(l_shipdate, '%Y%m01') as date, l_extendedprice / l_quantity as price from lineitem))"""
)
