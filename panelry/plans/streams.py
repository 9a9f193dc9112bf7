"""Queries that run as streams over everything available, into a table, and read it back."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures, io
from ..streaming import bars as sb
from ..streaming import clock, lags
from ..streaming import positions as sp
from ..streaming import weights as sw
from . import trading


def _shared(spark: SparkSession) -> str:
    """A new place in the folder that all executors share."""
    return f"{io.shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.as_ticks(sb.read_events(spark, sf_dir))


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = _shared(spark)
    sb.to_table(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def closed(spark: SparkSession, rows: DataFrame, time: str, make: Callable[[DataFrame], DataFrame], late: str, ahead: timedelta) -> DataFrame:
    """All rows of ``make`` over the stream ``rows`` and its end: what is open when the input ends is written as well."""
    folder = _shared(spark)
    clock.set_clock(spark, f"{folder}/clock")
    stream = make(clock.clocked(rows, f"{folder}/clock", time, late))
    clock.finished(spark, lambda: sb.to_table(stream, f"{folder}/out", f"{folder}/checkpoint"), f"{folder}/clock", ahead)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_DAILY = """avg(close) AS twap, arg_max(close_oi, datetime) - arg_min(close_oi, datetime) AS oi_change, sum(volume * close) / nullif(sum(volume), 0) AS vwap,
  coalesce(sum(volume) FILTER (hour(datetime) < 13), 0) AS am_volume, coalesce(sum(volume) FILTER (hour(datetime) >= 13), 0) AS pm_volume, coalesce(sum(volume) FILTER (hour(datetime) >= 14), 0) AS last_hour, coalesce(sum(volume) FILTER (hour(datetime) < 10), 0) AS first_hour,
  avg((close > open)::INT) AS buy_ratio, coalesce(sum(volume) FILTER (close > open), 0) AS up_volume, coalesce(sum(volume) FILTER (close <= open), 0) AS down_volume"""

_LAGS_SQL = f"""WITH {fixtures.TICKS_SQL}, d AS (SELECT *, datetime::DATE AS day, close - lag(close) OVER (PARTITION BY symbol, datetime::DATE ORDER BY datetime) AS dc FROM ticks),
m AS (SELECT *, dc * lag(dc) OVER (PARTITION BY symbol, day ORDER BY datetime) AS move FROM d)
SELECT symbol, day, count(*) AS n, round(sum(greatest(dc, 0)) / nullif(sum(abs(dc)), 0e0) * 100, 6) + 0e0 AS intraday_rsi,
  round(avg((move < 0)::INT), 6) + 0e0 AS inflection_ratio, round(sum(volume * close * sign(dc)) / nullif(sum(volume * close) FILTER (dc IS NOT NULL), 0), 6) + 0e0 AS flow_in_ratio
FROM m GROUP BY symbol, day"""

_EXITS_SQL = f"""WITH RECURSIVE {fixtures.TICKS_SQL}, b AS (SELECT symbol AS position_id, datetime AS time, close AS price, 100e0 AS ep, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS i FROM ticks),
m AS (
  SELECT position_id, 0::BIGINT AS i, 0e0 AS high, false AS half, false AS closed, NULL::VARCHAR AS event, NULL::TIMESTAMP AS time FROM (SELECT DISTINCT position_id FROM b)
  UNION ALL
  SELECT position_id, i, high, half OR coalesce(event = 'take_half', false), coalesce(event <> 'take_half', false), event, time FROM (
    SELECT b.position_id, b.i, greatest(m.high, price, ep) AS high, half, b.time,
      CASE WHEN price / ep - 1 <= -0.05 THEN 'stop_loss' WHEN price / ep - 1 >= 0.10 AND NOT half THEN 'take_half' WHEN greatest(m.high, price, ep) / ep - 1 > 0.05 AND 1 - price / greatest(m.high, price, ep) > 0.03 THEN 'trailing_stop' END AS event
    FROM m JOIN b ON b.position_id = m.position_id AND b.i = m.i + 1 WHERE NOT closed)
) SELECT position_id, time, event FROM m WHERE event IS NOT NULL"""

_SESSIONS_SQL = f"""WITH {fixtures.TICKS_SQL}, g AS (SELECT *, coalesce((datetime - lag(datetime) OVER (PARTITION BY symbol ORDER BY datetime) >= INTERVAL 2 HOUR)::INT, 1) AS new FROM ticks),
s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY datetime) AS k FROM g)
SELECT symbol, min(datetime) AS start, max(datetime) + INTERVAL 2 HOUR AS "end", count(*) AS n, sum(volume)::BIGINT AS volume FROM s GROUP BY symbol, k"""


def register(add: Callable, rounded: Callable) -> None:
    """Add the queries of this module."""
    local = lambda c: F.col(c).cast("timestamp_ntz").alias(c)

    def over_ticks(s: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], ahead: timedelta = timedelta(days=3)) -> DataFrame:
        return closed(s, _ticks(s, d), "datetime", make, "10 minutes", ahead)

    def prices(t: DataFrame) -> DataFrame:
        return sp.monitor(t.select(F.col("symbol").alias("position_id"), F.col("datetime").alias("time"), F.col("close").alias("price"), F.lit(100.0).alias("entry_price"), F.lit(None).cast("double").alias("score")), keep="40 days")

    add("st1_dedup_ticks", lambda s, d: _run(s, sb.deduplicated(_ticks(s, d)).select("symbol", "datetime", "volume")))
    add(
        "st2_stream_bars", lambda s, d: over_ticks(s, d, lambda t: sb.bars(t, "1 hour")).select("symbol", local("time"), *[rounded(c, 8).alias(c) for c in ("open", "high", "low", "close")], "volume"),
        f"WITH {fixtures.TICKS_SQL} SELECT symbol, date_trunc('hour', datetime) AS time, {', '.join(f'round({x}, 8) + 0e0 AS {n}' for n, x in (('open', 'arg_min(open, datetime)'), ('high', 'max(high)'), ('low', 'min(low)'), ('close', 'arg_max(close, datetime)')))}, sum(volume)::BIGINT AS volume FROM ticks GROUP BY ALL",
    )
    numbers = ["vwap", "twap", "buy_ratio"]
    counts = ["oi_change", "am_volume", "pm_volume", "last_hour", "first_hour", "up_volume", "down_volume"]
    add(
        "st3_stream_daily", lambda s, d: over_ticks(s, d, sb.daily).select("symbol", "day", *[rounded(c).alias(c) for c in numbers], *counts),
        f"WITH {fixtures.TICKS_SQL}, x AS (SELECT symbol, datetime::DATE AS day, {_DAILY} FROM ticks GROUP BY ALL) SELECT symbol, day, {', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in numbers)}, {', '.join(f'{c}::BIGINT AS {c}' for c in counts)} FROM x",
    )
    add("st3_stream_lags", lambda s, d: over_ticks(s, d, lags.lag_columns).select("symbol", "day", "n", *[rounded(c).alias(c) for c in ("intraday_rsi", "inflection_ratio", "flow_in_ratio")]), _LAGS_SQL)
    # far enough ahead for the marks of closed positions to go as well
    add("st4_position_monitor", lambda s, d: over_ticks(s, d, prices, timedelta(days=50)).select("position_id", local("time"), "event"), _EXITS_SQL)
    add("st6_sessions", lambda s, d: over_ticks(s, d, lambda t: sb.sessions(t, "2 hours")).select("symbol", local("start"), local("end"), "n", "volume"), _SESSIONS_SQL)

    def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Quarters as files in no order, eight to a batch, into the table of weights."""
        folder = _shared(spark)
        trading.panel_by_quarter(spark, sf_dir).repartition(32, F.xxhash64("period")).write.parquet(f"{folder}/in")
        pnl = spark.readStream.schema("formula_id string, period date, pnl double").option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
        runs = trading.parameter_runs(spark).where("strategy = 'mwu' AND eta IS NULL")
        formulas = list(trading.KEYS_IN_USE)
        make = lambda rows: sw.learn_weights(rows, runs, formulas)
        out = closed(spark, pnl.withColumn("closes", F.col("period").cast("timestamp")), "closes", make, "20000 days", timedelta(days=20001))
        return out.select("period", "formula_id", rounded("weight").alias("weight"))

    add("st5_online_weights", learned, trading.MWU_QUERY)
