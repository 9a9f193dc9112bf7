"""Event time that moves on without data: a clock beside the input, and the step that closes a stream.

A window, a session or a timer ends once the watermark passes it, and the watermark follows the rows.  When the
input ends, whatever is open would wait for ever.  ``clocked`` adds rows of a clock, a folder of times, that move
the watermark and nothing else; ``finished`` runs a stream over everything available, then sets the clock far
enough ahead for everything to end, and runs it again from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def set_clock(spark: SparkSession, folder: str, at: datetime | None = None) -> None:
    """A new reading of the clock in ``folder``; without a time, an empty one, so that a stream can read it."""
    rows = [] if at is None else [(at.isoformat(sep=" "),)]
    frame = spark.createDataFrame(rows, "at string").select(F.to_timestamp("at").alias("at"))
    frame.coalesce(1).write.mode("append").parquet(folder)


def clocked(rows: DataFrame, folder: str, time: str, late: str) -> DataFrame:
    """``rows`` with a watermark on ``time`` that the clock in ``folder`` moves as well."""
    clock = rows.sparkSession.readStream.schema("at timestamp").parquet(folder).select(F.col("at").alias(time), F.lit(True).alias("_clock"))
    both = rows.withColumn("_clock", F.lit(False)).unionByName(clock, allowMissingColumns=True).withWatermark(time, late)
    # no partition has a negative number; naming it keeps this filter, and any later one, above the watermark, which has to see the clock's rows
    return both.where(~F.col("_clock") | (F.spark_partition_id() < 0)).drop("_clock")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as state with timers needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def latest(query: StreamingQuery) -> datetime | None:
    """The latest event time that a query has met, or its watermark where it met none."""
    times = [p.eventTime[k] for p in query.recentProgress for k in ("max", "watermark") if k in p.eventTime]
    return max((datetime.fromisoformat(x.replace("Z", "+00:00")).replace(tzinfo=None) for x in times), default=None)


def finished(spark: SparkSession, start: Callable[[], StreamingQuery], clock: str, ahead: timedelta) -> StreamingQuery:
    """Run ``start`` (over everything available, from one checkpoint), set the clock ``ahead`` of the input, and run it once more.

    ``ahead`` covers the lateness allowed and the longest window; rows that come after are late.
    """
    with keyed_state(spark):
        query = start()
        query.awaitTermination()
        end = latest(query)
        if end is not None:
            set_clock(spark, clock, end + ahead)
            query = start()
            query.awaitTermination()
    return query
