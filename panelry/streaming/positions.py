"""Live position monitor: exit rules with state by position, in order of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

POSITION = "highest double, half_sold boolean, closed boolean"
TICK = "at long, price double, entry_price double, score double"
OUT = "position_id string, at long, event string"


class Monitor(StatefulProcessor):
    """State of a position: its highest price and two marks, and the ticks that the watermark has not passed yet.

    A tick waits until the watermark passes its time, as only then no earlier one can come.  One timer a position
    stands at its earliest waiting tick.  A closed position leaves a mark that outlives its last tick by ``keep``
    milliseconds; then nothing is left of it.
    """

    def __init__(self, stop: float, take: float, gain: float, drop: float, least_score: float, keep: int):
        self.stop, self.take, self.gain, self.drop, self.least_score, self.keep = stop, take, gain, drop, least_score, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", POSITION)
        self.waiting = handle.getListState("waiting", TICK)

    def _wake(self, at: int) -> None:
        """One timer, at ``at`` milliseconds."""
        for known in list(self.handle.listTimers()):
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat([r[["at", "price", "entry_price", "score"]] for r in rows])
        if self.position.exists() and self.position.get()[2]:
            self._wake(int(ticks["at"].max()) // 1000 + self.keep)
        else:
            self.waiting.appendList([(int(a), float(p), float(e), None if pd.isna(s) else float(s)) for a, p, e, s in ticks.itertuples(index=False)])
            first = int(ticks["at"].min()) // 1000
            self._wake(min([first, *self.handle.listTimers()]))
        return iter(())

    def _step(self, tick: tuple, state: list) -> str | None:
        """The event of one tick, by the rules of ``risk.exit_rules``; ``state`` moves on."""
        _, price, entry, score = tick
        state[0] = max(state[0], price, entry)
        change = price / entry - 1
        if change <= self.stop:
            state[2] = True
            return "stop_loss"
        if change >= self.take and not state[1]:
            state[1] = True
            return "take_half"
        if state[0] / entry - 1 > self.gain and 1 - price / state[0] > self.drop:
            state[2] = True
            return "trailing_stop"
        if not state[1] and score is not None and score < self.least_score:
            state[2] = True
            return "low_score"
        return None

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = list(self.position.get()) if self.position.exists() else [0.0, False, False]
        if state[2]:
            self.position.clear()
            return
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(t) for t in self.waiting.get()), key=lambda t: t[0])
        out, done = [], 0
        for tick in waiting:
            if tick[0] > passed or state[2]:
                break
            event = self._step(tick, state)
            if event:
                out.append((key[0], tick[0], event))
            done += 1
        last = waiting[-1][0] if waiting else 0
        self.position.update(tuple(state))
        if state[2]:
            self.waiting.clear()
            self._wake(last // 1000 + self.keep)
        elif waiting[done:]:
            self.waiting.put(waiting[done:])
            self._wake(waiting[done][0] // 1000)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["position_id", "at", "event"])

    def close(self) -> None:
        """Nothing is open."""


def monitor(ticks: DataFrame, stop: float = -0.05, take: float = 0.10, gain: float = 0.05, drop: float = 0.03, least_score: float = 0.45, keep: str = "1 day") -> DataFrame:
    """Events of a stream of (position_id, time, price, entry_price, score) with a watermark on ``time``.

    The rules are those of ``risk.exit_rules``: the stop loss closes; at the target half is sold, once; a trailing
    stop closes after a gain is given back; a score under ``least_score`` (null: none is known) closes while nothing has
    been sold.  Ticks may come in any order inside the watermark, across batches as well; later ones are dropped.
    A closed position takes no more ticks until none has come for ``keep``; after that its name may be used again.  A tick
    without position, time, price or entry price says nothing.
    """
    millis = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = ticks.select("position_id", "time", F.unix_micros("time").alias("at"), *[F.col(c).cast("double").alias(c) for c in ("price", "entry_price", "score")])
    rows = rows.where("position_id IS NOT NULL AND at IS NOT NULL AND price IS NOT NULL AND entry_price IS NOT NULL")
    out = rows.groupBy("position_id").transformWithStateInPandas(Monitor(stop, take, gain, drop, least_score, millis), OUT, "Append", "EventTime")
    return out.select("position_id", F.timestamp_micros("at").alias("time"), "event")
