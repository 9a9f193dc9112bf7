"""Adapters that read the given tables as the engine's inputs.

Minute ticks come from ``events``; weekly bars, one row per address and week, from ``lineitem``.  Both
are plain projections and aggregations, so everything that runs on them grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of the weekly panel that ``lineitem`` has no producer for; these aggregates stand in for them.
STAND_INS = {
    "oi_change": "sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0e0 END)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars: product, contract, time, prices, volume and open interest."""
    return as_ticks(table(spark, sf_dir, "events"))


def as_ticks(e: DataFrame) -> DataFrame:
    """The ``events`` rows, from a table or a stream, as minute bars."""
    code = F.element_at(F.array(*map(F.lit, ("2402", "2403", "2405", "2409"))), (F.col("user_id") % 4 + 1).cast("int"))
    close = F.col("value") + 10
    open_ = close * (1 + ((F.col("event_id") % 7) - 3) / F.lit(100.0).cast("double"))
    return e.select(
        F.lit("X").alias("exchange"), F.col("event_type").alias("product_id"), F.concat("event_type", code).alias("symbol"), F.col("ts").alias("datetime"),
        open_.alias("open"), (F.greatest(open_, close) * F.lit(1.001).cast("double")).alias("high"), (F.least(open_, close) * F.lit(0.999).cast("double")).alias("low"), close.alias("close"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("volume"),
        (1000 + (F.col("event_id") * 37) % 500).alias("open_oi"), (1000 + (F.col("event_id") * 53) % 500).alias("close_oi"),
    )


TICKS_SQL = """ticks AS (
  SELECT 'X' AS exchange, event_type AS product_id, event_type || (['2402', '2403', '2405', '2409'])[user_id % 4 + 1] AS symbol, ts AS datetime,
    (value + 10) * (1 + ((event_id % 7) - 3) / 100e0) AS open,
    greatest((value + 10) * (1 + ((event_id % 7) - 3) / 100e0), value + 10) * 1.001e0 AS high,
    least((value + 10) * (1 + ((event_id % 7) - 3) / 100e0), value + 10) * 0.999e0 AS low, value + 10 AS close,
    json_extract(props, '$.k')::BIGINT + 1 AS volume, 1000 + (event_id * 37) % 500 AS open_oi, 1000 + (event_id * 53) % 500 AS close_oi
  FROM events
)"""


def address(suppkey: Column) -> Column:
    """The address of a supplier."""
    return F.concat(F.lit("A"), F.lpad(suppkey.cast("string"), 9, "0"), F.lit(".X"))


def _priced(rows: DataFrame) -> DataFrame:
    k = F.struct(F.to_date("l_shipdate").alias("d"), "l_orderkey", "l_linenumber", "l_partkey")
    return rows.select(
        *[c for c in rows.columns if c != "address"], (F.col("address") if "address" in rows.columns else address(F.col("l_suppkey"))).alias("address"),
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("time"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), k.alias("k"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars by address with the stand-in daily columns; not every address has every week.

    Order lines are dealt by address once, as they are; bars and all windows by address then need no other shuffle.
    """
    rows = _priced(table(spark, sf_dir, "lineitem").withColumn("address", address(F.col("l_suppkey"))).repartition("address"))
    base = {
        "open": "min_by(p, k)", "high": "max(p)", "low": "min(p)", "close": "max_by(p, k)", "volume": "sum(l_quantity)",
        "liquidity": "sum(l_quantity) * max_by(p, k)", "fdv": "0e0", "twap": "avg(p)",
    }
    return rows.groupBy("address", "time").agg(*[F.expr(x).cast("double").alias(n) for n, x in (base | STAND_INS).items()])


def _duck(expression: str) -> str:
    return expression.replace("max_by(p, k)", "arg_max(p, k)").replace("min_by(p, k)", "arg_min(p, k)").replace("max_by(", "arg_max(")


BARS_SQL = f"""priced AS (
  SELECT *, 'A' || lpad(l_suppkey::VARCHAR, 9, '0') || '.X' AS address, date_trunc('week', l_shipdate)::DATE AS time,
    l_extendedprice / l_quantity AS p, (l_shipdate::DATE, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem
), bars AS (
  SELECT address, time, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(l_quantity) AS volume,
    sum(l_quantity) * arg_max(p, k) AS liquidity, 0e0 AS fdv, avg(p) AS twap,
    {", ".join(f"{_duck(x)} AS {n}" for n, x in STAND_INS.items())}
  FROM priced GROUP BY address, time
)"""

#: Columns of the dense panel.
PANEL = ("open", "high", "low", "close", "volume", "liquidity", "fdv", "twap", *STAND_INS)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel: every address at every time, gaps filled forward, then with zero; and total open interest."""
    from ..operators.panel import densify

    dense = densify(bars(spark, sf_dir), PANEL, times(spark, sf_dir))
    by = Window.partitionBy("address").orderBy("time")
    return dense.withColumns(
        {
            "total_oi": F.sum("oi_change").over(by.rowsBetween(Window.unboundedPreceding, 0)) + 10000,
        }
    )


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time): the times of the dense panel, from one column of ``lineitem``."""
    return table(spark, sf_dir, "lineitem").select(F.to_date(F.date_trunc("week", "l_shipdate")).alias("time")).distinct()


def weeks(spark: SparkSession, sf_dir: str) -> int:
    """How many times the dense panel has: one number from one column of ``lineitem``."""
    return table(spark, sf_dir, "lineitem").select(F.countDistinct(F.date_trunc("week", "l_shipdate"))).first()[0]


PANEL_SQL = f"""{BARS_SQL}, grid AS (
  SELECT address, time FROM (SELECT DISTINCT address FROM bars) CROSS JOIN (SELECT DISTINCT time FROM bars)
), dense AS (
  SELECT address, time, {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0e0) AS {c}" for c in PANEL)}
  FROM grid LEFT JOIN bars USING (address, time) WINDOW w AS (PARTITION BY address ORDER BY time ROWS UNBOUNDED PRECEDING)
), panel AS (
  SELECT *, sum(oi_change) OVER (PARTITION BY address ORDER BY time ROWS UNBOUNDED PRECEDING) + 10000 AS total_oi FROM dense
)"""


def days(spark: SparkSession, sf_dir: str) -> int:
    """How many times the daily panel of ticks has."""
    return table(spark, sf_dir, "events").select(F.countDistinct(F.to_date("ts"))).first()[0]
