"""The same input as a stream and as a batch gives the same rows: out of order, over restarts, and to the end of the input."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelry.operators import ensemble as en
from panelry.operators import risk
from panelry.plans import streams
from panelry.sources import fixtures
from panelry.streaming import bars as sb
from panelry.streaming import clock, lags
from panelry.streaming import positions as sp
from panelry.streaming import weights as sw

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def _ticks(spark):
    return fixtures.as_ticks(sb.read_events(spark, SF))


def _put(spark, rows, schema, folder):
    """One more file of a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


class Stream:
    """A stream over files in ``folder``, started anew for every batch, with a clock of its own."""

    def __init__(self, spark, folder, schema, time, make, late):
        self.spark, self.folder, self.schema = spark, folder, schema
        clock.set_clock(spark, f"{folder}/clock")
        _put(spark, [], schema, f"{folder}/in")
        rows = clock.clocked(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/clock", time, late)
        self.stream = make(rows)

    def feed(self, rows):
        _put(self.spark, rows, self.schema, f"{self.folder}/in")
        return self.run()

    def run(self):
        with clock.keyed_state(self.spark):
            query = sb.to_table(self.stream, f"{self.folder}/out", f"{self.folder}/checkpoint")
            query.awaitTermination(120)
        return query

    def end(self, at):
        clock.set_clock(self.spark, f"{self.folder}/clock", at)
        return self.run()

    def rows(self):
        return self.spark.read.schema(self.stream.schema).parquet(f"{self.folder}/out").collect()


def _state_rows(query):
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1]


@pytest.mark.parametrize("width, slide", [("1 hour", None), ("2 hours", "1 hour")])
def test_bars_equal_batch_to_the_end(spark, width, slide):
    got = streams.closed(spark, _ticks(spark), "datetime", lambda t: sb.bars(t, width, slide), "1 minute", timedelta(days=1))
    window = F.window("datetime", width, slide) if slide else F.window("datetime", width)
    ticks = fixtures.ticks(spark, SF).withColumn("datetime", F.col("datetime").cast("timestamp"))
    want = ticks.groupBy("symbol", window.getField("start").alias("time")).agg(F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume"))
    key = lambda df: sorted((r.symbol, r.time, r.close, r.volume) for r in df.collect())
    assert key(got) == key(want)


TICK = "position_id string, time timestamp, price double, entry_price double, score double"


def _random_ticks(seed, n=40):
    rng = np.random.default_rng(seed)
    out = []
    for p in ("a", "b", "c", "d"):
        price = 100 * np.cumprod(1 + rng.normal(0.002, 0.02, n))
        out += [(p, START + timedelta(minutes=int(i)), float(x), 100.0, None if rng.random() < 0.5 else float(rng.random())) for i, x in enumerate(price)]
    return out


def _monitor(spark, folder, keep="1 day"):
    return Stream(spark, folder, TICK, "time", lambda t: sp.monitor(t, keep=keep), "10 minutes")


def test_monitor_equals_batch_over_shuffled_batches_and_restarts(spark, tmp_path):
    rows = _random_ticks(1)
    stream = _monitor(spark, str(tmp_path))
    for first in range(0, 40, 8):  # inside a batch in no order, and neighbours swapped between batches
        own = [r for r in rows if first <= ((r[1] - START).seconds // 60) ^ 1 < first + 8]
        np.random.default_rng(first).shuffle(own)
        stream.feed([tuple(r) for r in own])
    stream.end(START + timedelta(hours=2))
    frame = spark.createDataFrame(rows, TICK)
    want = sorted((r.position_id, r.time, r.event) for r in risk.exit_rules(frame).collect())
    assert sorted((r.position_id, r.time, r.event) for r in stream.rows()) == want and len(want) >= 4


def test_a_closed_position_takes_no_ticks_and_leaves_no_state(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    stream = _monitor(spark, str(tmp_path), keep="1 hour")
    stream.feed([(None, at(0), 1.0, 1.0, None), ("a", None, 1.0, 100.0, None), ("a", at(0), None, 100.0, None), ("a", at(0), 1.0, None, None)])  # none of them says anything
    stream.feed([("a", at(0), 100.0, 100.0, None), ("a", at(1), 90.0, 100.0, None), ("b", at(0), 100.0, 100.0, None), ("b", at(20), 100.0, 100.0, None)])
    held = _state_rows(stream.feed([("a", at(25), 80.0, 100.0, None), ("b", at(40), 101.0, 100.0, None)]))  # a is closed: no second event
    assert [(r.position_id, r.event) for r in stream.rows()] == [("a", "stop_loss")]
    stream.feed([("b", at(24 * 60), 101.0, 100.0, None)])
    query = stream.feed([("b", at(24 * 60 + 30), 101.0, 100.0, None)])
    assert _state_rows(query) < held  # the mark of a is gone; b is still open
    late = stream.feed([("a", at(2), 50.0, 100.0, None)])
    assert sum(o.numRowsDroppedByWatermark for p in late.recentProgress for o in p.stateOperators) == 1
    assert [(r.position_id, r.event) for r in stream.rows()] == [("a", "stop_loss")]


def test_lag_columns_equal_batch(spark, tmp_path):
    schema = "symbol string, datetime timestamp, close double, volume long"
    rng = np.random.default_rng(3)
    rows = [(s, START + timedelta(hours=22, seconds=20 * i + k), float(round(100 + rng.normal(), 2)), int(rng.integers(1, 9))) for k, s in enumerate(("x", "y")) for i in range(500)]
    stream = Stream(spark, str(tmp_path), schema, "datetime", lags.lag_columns, "30 minutes")
    rows.sort(key=lambda r: r[1])
    for first in range(0, 1000, 250):
        own = rows[first : first + 250]
        np.random.default_rng(first).shuffle(own)
        stream.feed([(str(r[0]), r[1], float(r[2]), int(r[3])) for r in own])
    stream.end(START + timedelta(days=3))
    got = {(r.symbol, r.day): (r.n, r.intraday_rsi, r.inflection_ratio, r.flow_in_ratio) for r in stream.rows()}
    want = {}
    for s, day in {(r[0], r[1].date()) for r in rows}:
        own = [r for r in rows if r[0] == s and r[1].date() == day]
        close, volume = np.array([r[2] for r in own]), np.array([r[3] for r in own], float)
        dc = np.diff(close)
        turn = volume[1:] * close[1:]
        want[s, day] = (len(own), dc[dc > 0].sum() / np.abs(dc).sum() * 100, (dc[1:] * dc[:-1] < 0).mean(), (turn * np.sign(dc)).sum() / turn.sum())
    assert len(want) == 4 and got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(np.array(got[k], float), np.array(v, float))


def test_weights_learn_one_step_a_period_from_shuffled_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    runs = spark.createDataFrame([("m", "mwu", None, 0.01, 4, 2), ("e", "ema", None, 0.02, 5, 1)], "run_id string, strategy string, eta double, floor double, lookback int, warmup int")
    days = [datetime(2020, 1, 1) + timedelta(days=90 * k) for k in range(12)]
    pnl = [(f, d.date(), float(rng.normal())) for d in days for f in ("p", "q", "r")]
    schema = "formula_id string, period date, pnl double"
    stream = Stream(spark, str(tmp_path), schema + ", closes timestamp", "closes", lambda t: sw.learn_weights(t, runs, ["r", "q", "p"]), "400 days")
    order = [2, 0, 1, 3, 5, 4, 6, 8, 7, 9, 11, 10]
    for k in order:
        stream.feed([(f, d, x, datetime.combine(d, datetime.min.time())) for f, d, x in pnl if d == days[k].date()])
    refused = stream.feed([("p", days[0].date(), 9.0, days[0])])  # long after its period has closed
    assert sum(o.numRowsDroppedByWatermark for p in refused.recentProgress for o in p.stateOperators) == len(runs.collect())
    stream.end(days[-1] + timedelta(days=500))
    want = {(r.run_id, r.period, r.formula_id): r.weight for r in en.online_weights(spark.createDataFrame(pnl, schema), runs).collect()}
    rows = stream.rows()
    assert len(rows) == len(want) == 72
    for r in rows:
        assert abs(r.weight - want[r.run_id, r.period, r.formula_id]) < 1e-12


class _Handle:
    """State of one key in memory, with its timers."""

    class State:
        def __init__(self):
            self.kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept or []

        def update(self, value):
            self.kept = value

        put = update

        def appendList(self, rows):  # noqa: N802
            self.kept = [*(self.kept or []), *rows]

        def clear(self):
            self.kept = None

    def __init__(self):
        self.timers, self.set = set(), 0

    def getValueState(self, *_):  # noqa: N802
        return self.State()

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.set += 1

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def listTimers(self):  # noqa: N802
        return list(self.timers)


def test_lag_columns_take_a_step_for_each_advance_of_the_watermark_not_each_minute():
    start, day = 1_704_067_200_000, 86_400_000
    rng = np.random.default_rng(5)
    at = start * 1000 + rng.permutation(1440) * 60_000_000 + 7
    close, volume = 100 + rng.normal(size=1440), rng.integers(1, 9, 1440).astype(float)
    frame = pd.DataFrame({"at": at, "close": close, "volume": volume})
    handle, one = _Handle(), lags.Lags()
    one.init(handle)
    key, steps, rows = ("a", None, start + day), 0, []
    for cut, mark in ((slice(0, 700), 0), (slice(700, 1440), start + day // 2), (slice(1440, 1440), start + 2 * day)):
        part = frame[cut][frame[cut]["at"] > mark * 1000] if mark == start + day // 2 else frame[cut]
        list(one.handleInputRows(key, iter([part] if len(part) else []), None))
        while due := [t for t in handle.timers if t <= mark]:
            handle.timers.discard(due[0])
            watermark = type("Times", (), {"getCurrentWatermarkInMs": lambda self, m=mark: m})()
            expired = type("Expired", (), {"getExpiryTimeInMs": lambda self, t=due[0]: t})()
            rows += [tuple(r) for f in one.handleExpiredTimer(key, watermark, expired) for r in f.itertuples(index=False)]
            steps += 1
    taken = pd.concat([frame[:700], frame[700:][frame[700:]["at"] > (start + day // 2) * 1000]]).sort_values("at")
    change = taken["close"].diff().to_numpy()[1:]
    assert steps <= 2 and handle.set <= 4 and not handle.timers
    assert len(rows) == 1 and rows[0][2] == len(taken)
    assert rows[0][3] == pytest.approx(np.maximum(change, 0).sum() / np.abs(change).sum() * 100)
    assert rows[0][4] == pytest.approx(np.mean(change[1:] * change[:-1] < 0))
