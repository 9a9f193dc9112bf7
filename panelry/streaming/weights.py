"""Weights of formulas learned as periods close, with state by run and periods in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ensemble import learned_rate, learned_step

LEARNED = "periods long, weights array<double>, past array<array<double>>"
OUT = "run_id string, period date, formula_id string, weight double"


class Learner(StatefulProcessor):
    """State of a run: its weights, the pnl of its last periods, and periods that are still open.

    A period closes when the watermark passes it, and the run takes one step a period, in order; the work of a step does not
    grow with the history.
    """

    def __init__(self, formulas: list[str]):
        self.formulas = sorted(formulas)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.learned = handle.getValueState("learned", LEARNED)
        self.open = handle.getListState("open", "at long, formula_id string, pnl double")
        self.run = handle.getValueState("run", "strategy string, eta double, floor double, lookback int, warmup int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = set()
        for r in rows:
            p = r.iloc[0]
            self.run.update((p["strategy"], None if pd.isna(p["eta"]) else float(p["eta"]), float(p["floor"]), int(p["lookback"]), int(p["warmup"])))
            self.open.appendList([(int(a), f, None if pd.isna(x) else float(x)) for a, f, x in zip(r["at"], r["formula_id"], r["pnl"], strict=True)])
            timers.update(int(a) for a in r["at"].unique())
        for t in timers.difference(self.handle.listTimers()):
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        rows = [tuple(r) for r in self.open.get()]
        strategy, eta, floor, lookback, warmup = self.run.get()
        n = len(self.formulas)
        t, weights, past = self.learned.get() if self.learned.exists() else (0, [1 / n] * n, [])
        weights, past, out = np.array(weights, float), [list(x) for x in past], []
        for period in sorted({r[0] for r in rows if r[0] <= at}):
            pnl = {f: x for when, f, x in rows if when == period and x is not None}
            past = [*past, [pnl.get(f, 0.0) for f in self.formulas]][-lookback:]
            if t >= warmup:
                weights = learned_step(strategy, np.array(past), weights, learned_rate(eta, n, lookback), floor)
            t += 1
            out.append(pd.DataFrame({"run_id": key[0], "period": pd.Timestamp(period, unit="ms").date(), "formula_id": self.formulas, "weight": weights}))
        if not out:
            return
        if left := [r for r in rows if r[0] > at]:
            self.open.put(left)
        else:
            self.open.clear()
        self.learned.update((t, weights.tolist(), past))
        yield pd.concat(out)

    def close(self) -> None:
        """Nothing is open."""


def learn_weights(pnl: DataFrame, runs: DataFrame, formulas: list[str]) -> DataFrame:
    """(run_id, period, formula_id, weight): the weights after each period, of every run of the parameter table.

    ``pnl`` is a stream of (formula_id, period, pnl, closes), ``closes`` the period as a time in UTC, with a watermark.  Rows
    may come in any order inside the watermark; a row of a period that the watermark has passed is refused (Spark
    counts it among the rows dropped).  ``formulas`` are those in use; others take no part, and one that a period lacks
    counts as zero in it.
    """
    rows = pnl.where(F.col("formula_id").isin(formulas) & F.col("closes").isNotNull()).crossJoin(F.broadcast(runs))  # a table of parameters
    rows = rows.select("run_id", "strategy", "eta", "floor", "lookback", "warmup", "closes", F.unix_millis("closes").alias("at"), "formula_id", "pnl")
    return rows.groupBy("run_id").transformWithStateInPandas(Learner(formulas), OUT, "Append", "EventTime")
