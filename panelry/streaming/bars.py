"""Ticks as a stream: deduplicated ingest, bars and daily columns with late rows dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row a contract and minute, kept in state no longer than the watermark."""
    minute = ticks.withColumn("minute", F.date_trunc("minute", "datetime"))
    return minute.withWatermark("datetime", late).dropDuplicatesWithinWatermark(["symbol", "minute"]).drop("minute")


def bars(ticks: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Bars by contract over tumbling (or sliding) windows; a window is final once the watermark on ``datetime`` passes its end."""
    window = F.window("datetime", width, slide) if slide else F.window("datetime", width)
    by = ticks.groupBy("symbol", window.alias("w")).agg(
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume")
    )
    return by.select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")


def daily(ticks: DataFrame) -> DataFrame:
    """Daily columns that need no order inside the day: vwap, twap, shares by hour, buying share, up and down volume."""
    hour, volume = F.hour("datetime"), F.col("volume")
    part = lambda cond: F.sum(F.when(cond, volume).otherwise(0))
    by = ticks.groupBy("symbol", F.window("datetime", "1 day").alias("w")).agg(
        F.try_divide(F.sum(volume * F.col("close")), F.sum(volume)).alias("vwap"), F.avg("close").alias("twap"), (F.max_by("close_oi", "datetime") - F.min_by("close_oi", "datetime")).alias("oi_change"),
        part(hour < 13).alias("am_volume"), part(hour >= 13).alias("pm_volume"), part(hour >= 14).alias("last_hour"), part(hour < 10).alias("first_hour"),
        F.avg((F.col("close") > F.col("open")).cast("double")).alias("buy_ratio"), part(F.col("close") > F.col("open")).alias("up_volume"), part(F.col("close") <= F.col("open")).alias("down_volume"),
    )
    return by.select("symbol", F.to_date("w.start").alias("day"), *[c for c in by.columns if c not in ("symbol", "w")])


def sessions(ticks: DataFrame, gap: str) -> DataFrame:
    """Activity sessions of a contract: closed by a gap without ticks."""
    by = ticks.groupBy("symbol", F.session_window("datetime", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
    return by.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything available now, appended to Parquet exactly once."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # event time has a zone
