"""Daily columns that need the order of ticks inside a day, from a stream: an ordered buffer and running sums in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000
SUMS = "n long, close double, change double, up double, moved double, moves long, turns long, flow double, turnover double"
OUT = "symbol string, day date, n long, intraday_rsi double, inflection_ratio double, flow_in_ratio double"


class Lags(StatefulProcessor):
    """State of a contract's day: ticks that the watermark has not passed, and what is needed of those before.

    One timer is set at a time: the end of the earliest minute that is still open.  Once it fires, all ticks under the watermark
    are put in order and added to the sums, and the next timer is set, so a day takes a step for each advance of the
    watermark and not for each minute.  The day's own end writes its row and leaves nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", SUMS)
        self.open = handle.getListState("open", "at long, close double, volume double")
        self.next = handle.getValueState("next", "at long")

    def _set_timer(self, first: int, day_end: int) -> None:
        """Wait for the end of the minute of ``first`` (or of the day), unless a timer before it is set."""
        at = min((first // (1000 * MINUTE) + 1) * MINUTE, day_end)
        if self.next.exists():
            before = self.next.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.next.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for r in rows:
            self.open.appendList(list(zip(r["at"].tolist(), r["close"].tolist(), r["volume"].tolist(), strict=True)))
            first = int(r["at"].min()) if first is None else min(first, int(r["at"].min()))
        if first is not None:
            self._set_timer(first, key[2])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = timerValues.getCurrentWatermarkInMs()
        self.next.clear()
        ticks = sorted(tuple(t) for t in self.open.get())
        ready = [t for t in ticks if t[0] < end * 1000]
        s = list(self.sums.get()) if self.sums.exists() else [0, 0.0, None, 0.0, 0.0, 0, 0, 0.0, 0.0]
        for _, close, volume in ready:
            if s[0]:
                change = close - s[1]
                s[3] += max(change, 0.0)
                s[4] += abs(change)
                if s[2] is not None:
                    s[5] += 1
                    s[6] += change * s[2] < 0
                s[7] += volume * close * ((change > 0) - (change < 0))
                s[8] += volume * close
                s[2] = change
            s[0] += 1
            s[1] = close
        left = ticks[len(ready) :]
        if end >= key[2]:
            self.sums.clear()
            self.open.clear()
            ratio = lambda a, b: a / b if b else None
            rsi = ratio(s[3], s[4])
            row = (key[0], key[1], s[0], None if rsi is None else rsi * 100, ratio(s[6], s[5]), ratio(s[7], s[8]))
            yield pd.DataFrame([row], columns=["symbol", "day", "n", "intraday_rsi", "inflection_ratio", "flow_in_ratio"])
            return
        self.sums.update(tuple(s))
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        self._set_timer(left[0][0] if left else key[2] * 1000, key[2])

    def close(self) -> None:
        """Nothing is open."""


def lag_columns(ticks: DataFrame) -> DataFrame:
    """(symbol, day, n, intraday_rsi, inflection_ratio, flow_in_ratio) of a stream of ticks with a watermark on ``datetime``.

    Ticks may come in any order inside the watermark.  What the watermark has passed is final, and so is a day.
    """
    day = F.to_date("datetime")
    rows = ticks.select("symbol", day.alias("day"), F.unix_millis(F.date_add(day, 1).cast("timestamp")).alias("day_end"), "datetime", F.unix_micros("datetime").alias("at"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"))
    rows = rows.where("at IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL")  # a tick without one of them has no place
    return rows.groupBy("symbol", "day", "day_end").transformWithStateInPandas(Lags(), OUT, "Append", "EventTime")
