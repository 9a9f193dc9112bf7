"""The factor engine against numpy loops, DuckDB, and its own invariants."""

import datetime as dt
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelry import catalog
from panelry.functions import rolling as ro
from panelry.operators import backtest as bt
from panelry.operators import ensemble as en
from panelry.operators import formula as fm
from panelry.operators import panel as pn
from panelry.operators import risk as rk
from panelry.operators.factors import FACTORS, compute, merged, register_factor
from panelry.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = [(f"A{a}", dt.date(2020, 1, 1) + dt.timedelta(t), float(100 * np.exp(0.02 * rng.normal())), float(rng.integers(1, 50))) for a in range(4) for t in range(40)]
    return spark.createDataFrame(rows, "address string, time date, close double, volume double").cache()


def _wide(df, column):
    return df.toPandas().pivot(index="time", columns="address", values=column).sort_index()


def test_rolling_forms_pad_zeros(panel):
    k = 10
    out = panel.withColumns({"m": F.expr(ro.mean("close", k)), "s": F.expr(ro.std("close", k)), "c": F.expr(ro.cov("close", "volume", k)), "_i": F.expr(ro.ROW)}).withColumn("d", F.expr(ro.decay("close", k)))
    x, y = _wide(panel, "close").to_numpy(), _wide(panel, "volume").to_numpy()
    px, py = (np.vstack([np.zeros((k - 1, 4)), v]) for v in (x, y))
    win = lambda v, t: v[t : t + k]
    n = len(x)
    weight = np.arange(1, k + 1) / (k * (k + 1) / 2)
    assert np.allclose(_wide(out, "m"), [win(px, t).mean(0) for t in range(n)])
    assert np.allclose(_wide(out, "s"), [win(px, t).std(0, ddof=1) for t in range(n)])
    assert np.allclose(_wide(out, "c"), [((win(px, t) - win(px, t).mean(0)) * (win(py, t) - win(py, t).mean(0))).sum(0) / k for t in range(n)])
    assert np.allclose(_wide(out, "d"), [weight @ win(px, t) for t in range(n)])


def test_ewma_and_breakout_match_loops(panel):
    out, bad = fm.evaluate(panel, {"e": ["close", "EWMA5"], "b": ["close", "BREAKOUT"], "bad": ["ADD"]})
    assert set(bad) == {"bad"}
    x = _wide(panel, "close")
    assert np.allclose(_wide(out, "e"), x.ewm(halflife=5, adjust=False).mean())
    low, high = x.rolling(20, min_periods=1).min(), x.rolling(20, min_periods=1).max()
    assert np.allclose(_wide(out, "b"), 2 * (x - low) / (high - low + 1e-6) - 1)


def test_ewma_is_cut_into_blocks_of_one_address(spark):
    n, rng = 3000, np.random.default_rng(2)
    x = pd.Series(np.exp(rng.normal(0, 3, n)))
    frame = spark.createDataFrame([("A", dt.date(2000, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(x)], "address string, time date, close double")
    frame = frame.repartition(6)
    out = fm.ewma(frame, {"e": "close"}, 5, n, pn.time_index(frame), block=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert re.search(r"hashpartitioning\(address#\d+, _b#\d+", plan) and not re.search(r"hashpartitioning\(address#\d+, \d", plan)  # one history, several tasks
    tasks = out.toPandas().sort_values("time")
    assert len(tasks) == n
    assert np.allclose(tasks["e"], x.ewm(halflife=5, adjust=False).mean(), rtol=1e-12, atol=0)
    whole = fm.ewma(frame, {"e": "close"}, 5, n, pn.time_index(frame)).toPandas().sort_values("time")
    assert np.allclose(whole["e"], tasks["e"], rtol=1e-12, atol=0)


def test_regimes_do_not_multiply_rows(panel):
    rets = pn.simple_returns(panel)
    plan = rk.regime_features(rets)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    got = rk.regime_features(rets).toPandas().sort_values("time")
    r = _wide(rets, "ret").to_numpy()
    for t in (3, 4, 10, 39):
        w = r[max(0, t - 19) : t + 1]
        z = (w - w.mean(0)) / w.std(0) if len(w) >= 5 else None
        want = 0.0 if z is None else ((z.sum(1) ** 2).mean() - 4) / 12
        assert abs(got["avg_corr"].iloc[t] - want) < 1e-9


def test_formula_errors_and_sharing():
    columns = ["a", "b"]
    assert fm.validity(["a", "b", "ADD"], columns) is None
    assert "lacks" in fm.validity(["a", "ADD"], columns)
    assert "left" in fm.validity(["a", "b"], columns)
    assert "unknown" in fm.validity(["zzz"], columns)
    steps, _ = fm.layers({"x": ["a", "b", "ADD", "NEG"], "y": ["a", "b", "ADD", "ABS"]}, columns, 100)
    assert [len(s) for s in steps] == [1, 2]  # the sum is computed once


def test_candidates_are_legal_and_repeatable(spark):
    rows = {r.formula_id: r.tokens for r in fm.candidates(spark, 40, ["a", "b"], 7, seed=3).collect()}
    assert rows == {r.formula_id: r.tokens for r in fm.candidates(spark, 40, ["a", "b"], 7, seed=3).repartition(3).collect()}
    assert all(len(t) == 7 and fm.validity(t, ["a", "b"]) is None for t in rows.values())


def test_factors_skip_and_register(panel):
    out, skipped = compute(panel, ["DEV", "CARRY"])
    assert skipped == ["CARRY"] and "DEV" in out.columns
    assert out.agg(F.max(F.abs("DEV"))).first()[0] <= 5
    merged([n for n in FACTORS], 357)  # no two factors give one name two meanings
    register_factor("OWN_TEST", ["close"], lambda T: [{"OWN_TEST__x": "close * 2"}], scaled=False)
    assert compute(panel, ["OWN_TEST"])[0].where("OWN_TEST <> close * 2").count() == 0
    del FACTORS["OWN_TEST"]


def test_drawdown_known_value(spark):
    pnl = spark.createDataFrame([("r", dt.date(2020, 1, i + 1), v) for i, v in enumerate([0.5015, 0.5, -0.3, -0.2])], "formula_id string, time date, pnl double")
    assert bt.max_drawdown(["formula_id"], pnl).first()["max_drawdown"] == pytest.approx(0.5)


def test_position_modes_small_cross_sections(spark):
    for n in (1, 2, 4, 10):
        df = spark.createDataFrame([(f"A{i}", dt.date(2020, 1, 1), float(i)) for i in range(n)], "address string, time date, signal double")
        for mode in ("sigmoid", "rank", "zscore", "quantile"):
            p = [r.position for r in bt.position(df, mode).collect()]
            assert all(0 <= x <= 1 for x in p)


def test_folds_cover_and_refuse(spark):
    rows = en.folds(spark, 1477, 5, gap=3).orderBy("fold").collect()
    assert rows[-1].test_end == 1477 and all(r.train_end == r.test_start - 3 for r in rows)
    with pytest.raises(ValueError):
        en.folds(spark, 20, 5)


def test_online_weights_sum_to_one_and_follow_the_winner(spark):
    rows = [(f, dt.date(2020, 1 + p, 1), 0.01 if f == "a" else -0.01) for f in "abc" for p in range(8)]
    panel = spark.createDataFrame(rows, "formula_id string, period date, pnl double")
    runs = spark.createDataFrame([("m", "mwu", None, 0.01, 4, 1), ("e", "ema", None, 0.01, 4, 1)], "run_id string, strategy string, eta double, floor double, lookback int, warmup int")
    w = en.online_weights(panel, runs).toPandas()
    assert np.allclose(w.groupby(["run_id", "period"]).weight.sum(), 1)
    last = w[w.period == w.period.max()].set_index(["run_id", "formula_id"]).weight
    assert last["m", "a"] > 0.34 and last["e", "a"] > 0.34


def test_incremental_ticks_and_caches(spark, tmp_path):
    t = spark.createDataFrame([("p", "x", "s", dt.datetime(2020, 1, 1, 9, i), 1.0) for i in range(4)], "product_id string, exchange string, symbol string, datetime timestamp, close double")
    path = str(tmp_path / "ticks")
    io.append_ticks(spark, t.where("minute(datetime) < 2"), path)
    io.append_ticks(spark, t, path)
    assert io.read_ticks(spark, path, products=["p"]).count() == 4
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "address string, time int, value double")
    new = spark.createDataFrame([("b", 1, 3.0), ("c", 1, 4.0)], "address string, time int, value double")
    assert {(r.address, r.value) for r in io.merge_cache(old, new).collect()} == {("a", 1.0), ("b", 3.0), ("c", 4.0)}


def test_corr_dedup_matches_a_loop(spark):
    rng = np.random.default_rng(12)
    day = dt.date(2020, 1, 1)
    rows = [(day, f"a{i:02d}", int(rng.integers(0, 2)), float(w)) for i, w in enumerate([*np.round(rng.normal(0, 0.1, 30), 3), 0.2, 0.2, 0.02, -0.0199, 0.0])]
    want = {}
    for sector in (0, 1):
        line = sorted((r for r in rows if r[2] == sector), key=lambda r: (-abs(r[3]), r[1]))
        w = [r[3] for r in line]
        for i in range(len(line)):
            for j in range(i + 1, len(line)):
                if abs(w[i]) >= 0.01 and abs(w[j]) >= 0.01 and w[i] * w[j] > 0:
                    w[j] /= 2
        want |= {r[1]: x for r, x in zip(line, w)}
    got = {r.address: r.target_weight for r in rk.corr_dedup(spark.createDataFrame(rows, "date date, address string, sector int, target_weight double")).collect()}
    assert got == pytest.approx(want)


def test_exit_rules_match_the_monitor(spark, tmp_path):
    """The batch rules and the stream's state give the same events."""
    from panelry.plans import streams
    from panelry.streaming import positions as sp

    rng = np.random.default_rng(3)
    rows = [(f"p{k}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=t), float(100 * np.exp(v)), 100.0, float(s) if k % 2 else None) for k in range(40) for t, (v, s) in enumerate(zip(np.cumsum(rng.normal(0.002, 0.02, 60)), 0.44 + 0.5 * rng.random(60)))]
    df = spark.createDataFrame(rows, "position_id string, time timestamp, price double, entry_price double, score double")
    batch = {(r.position_id, r.time, r.event) for r in rk.exit_rules(df).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream = {(r.position_id, r.time, r.event) for r in streams.closed(spark, ticks, "time", sp.monitor, "10 minutes", dt.timedelta(hours=1)).collect()}
    assert batch == stream and {e for *_, e in batch} == {"stop_loss", "take_half", "trailing_stop", "low_score"}


def test_regime_labels_and_scale(spark):
    cases = [(0.5, 0.1, "calm"), (0.5, 0.4, "normal"), (1.2, 0.49, "normal"), (1.2, 0.6, "stress"), (1.9, 0.9, "stress"), (2.0, 0.0, "crisis")]
    df = spark.createDataFrame([(r, c) for r, c, _ in cases], "vol_ratio double, avg_corr double")
    out = rk.vol_regime_scale(df).collect()
    assert [r.regime for r in out] == [n for *_, n in cases]
    assert [r.scale for r in out] == pytest.approx([min(1.2, max(0.3, 1 / max(r, 0.5) - max(0, c - 0.3) * 0.5)) for r, c, _ in cases])


def test_lazy_penalty_by_turnover_a_rebalance(spark):
    """Three addresses with turnovers of 0.005, 0.03 and 0.2 a rebalance: 3, 0.8 and 0."""
    day = [dt.date(2020, 1, 1) + dt.timedelta(t) for t in range(10)]
    rows = [("f", a, d, x if i in (0, 5) else 0.0, 0.1, i in (0, 5)) for a, x in (("a", 0.005), ("b", 0.03), ("c", 0.2)) for i, d in enumerate(day)]
    df = spark.createDataFrame(rows, "formula_id string, address string, time date, turnover double, position double, is_rebalance boolean")
    r = bt.activity(df, ["formula_id"], pn.Profile()).first()
    assert r.lazy_penalty == pytest.approx((3 + 0.8 + 0) / 3) and r.turnover_bonus == pytest.approx((0.025 + 0.15 + 0.5) / 3) and r.active == 1


def test_formula_stats_cost_repeats(spark):
    rows = [("f1", ["RET", "DEV", "DEV", "DEV", "ADD", "ADD", "ADD"]), ("f2", ["DEV", "LOG_VOL", "DEV", "RET", "ADD", "ADD", "ADD"]), ("f3", ["RET", "NEG", "NEG", "NEG", "NEG"])]
    out = {r.formula_id: r for r in fm.stats_table(spark.createDataFrame(rows, "formula_id string, tokens array<string>")).collect()}
    assert [out[k].structure_penalty for k in ("f1", "f2", "f3")] == pytest.approx([0.5, 0.0, 0.3])
    assert [out[k].diversity_bonus for k in ("f1", "f2", "f3")] == pytest.approx([0.0, 0.15, 0.0])
    assert [out[k].novelty for k in ("f1", "f2", "f3")] == [0.3, 0.0, 0.3] and out["f1"].length == 6


def test_select_factors_is_greedy(spark):
    quality = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.6), ("e", 0.01)], "formula_id string, icir double")
    pairs = spark.createDataFrame([("a", "b", -0.9), ("b", "c", 0.95), ("c", "d", 0.8)], "a string, b string, corr double")
    assert [r.formula_id for r in en.select_factors(quality, pairs, 3).collect()] == ["a", "c"]  # b is close to a, d to c, e is too weak
    # more names than fit one row; every second one is close to the one before
    many = spark.range(3000).select(F.format_string("f%05d", "id").alias("formula_id"), (10.0 - F.col("id") / 1000).alias("icir"))
    near = spark.range(2999).select(F.format_string("f%05d", "id").alias("a"), F.format_string("f%05d", F.col("id") + 1).alias("b"), F.lit(0.9).alias("corr"))
    assert [r.formula_id for r in en.select_factors(many, near, 6).collect()] == [f"f{k:05d}" for k in range(0, 12, 2)]


def test_densify_fills_forward(spark):
    d = [dt.date(2020, 1, i) for i in (1, 2, 3)]
    df = spark.createDataFrame([("a", d[0], 1.0), ("a", d[2], 3.0), ("b", d[1], 5.0)], "address string, time date, x double")
    assert sorted((r.address, r.time.day, r.x) for r in pn.densify(df, ["x"]).collect()) == [("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 3.0), ("b", 1, 0.0), ("b", 2, 5.0), ("b", 3, 5.0)]


@pytest.mark.parametrize(("days", "cooldown"), [(10, 30), (10, 4)])
def test_decay_triggers_match_a_loop(spark, days, cooldown):
    rng = np.random.default_rng(8)
    pnl = {f: rng.normal(np.repeat([-0.004, 0.004, -0.001, -0.0005, -0.012, 0.01, -0.002, -0.0015], 50), 0.02) for f in ("fa", "fb")}
    day = [dt.date(2020, 1, 1) + dt.timedelta(t) for t in range(400)]
    want = []
    for f, x in pnl.items():
        bad, last = 0, -999
        for t in range(59, len(x)):
            recent = x[t - 59 : t + 1]
            ratio = recent.mean() / (recent.std() + 1e-8) * np.sqrt(52)
            bad = bad + 1 if ratio < 0 else 0
            if bad >= days and t - last >= cooldown:
                level = 3 if ratio < -1.5 else 2 if ratio < -0.5 else 1
                want.append((f, day[t], level))
                if level > 1:
                    bad, last = 0, t
    assert {level for *_, level in want} == {1, 2, 3}
    df = spark.createDataFrame([(f, day[t], float(v)) for f, x in pnl.items() for t, v in enumerate(x)], "formula_id string, time date, pnl double")
    got = rk.decay_triggers(df, 60, days, cooldown, 52.0).collect()
    assert sorted((r.formula_id, r.time, r.level) for r in got) == want


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["f4_dev", "r34_ivol", "t4_vol_conc", "o20_corr10", "b11_sharpe", "b15_rank_ic", "p2_main_contract", "k5_sector_cap", "e5_cv_evaluate", "v1_replay_backtest", "s4_exit_rules", "k8_adjustments", "io16_dedup_clean_bars"])
def test_queries_match_duckdb(spark, duck, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    columns = sorted(a.columns)
    key = lambda f: f[columns].astype({c: str for c in columns if not pd.api.types.is_float_dtype(f[c])})
    order = [c for c in columns if not pd.api.types.is_float_dtype(a[c])] + [c for c in columns if pd.api.types.is_float_dtype(a[c])]
    a, b = (key(f).sort_values(order).reset_index(drop=True) for f in (a, b))
    for c in columns:
        if pd.api.types.is_float_dtype(a[c]):
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-4, equal_nan=True), c
        elif "time" not in c and "day" not in c and c != "date":
            assert (a[c] == b[c]).all(), c


def test_cv_against_the_single_split_matches_duckdb(spark, duck):
    a, b = (rows.set_index("formula_id").sort_index() for rows in (catalog.QUERIES["e6_cv_vs_single_split"](spark, SF).toPandas(), duck.execute(catalog.SQL["e6_cv_vs_single_split"]).df()))
    assert list(a.index) == list(b.index) == ["fa", "fb", "fc"] and (a["overfit"] == b["overfit"]).all()
    for c in ("cv_mean", "cv_std", "single", "difference", "robustness"):
        assert np.allclose(a[c], b[c], atol=2e-5), c


def test_every_query_with_sql_is_registered():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 150


def test_entry_scores_that_agree_to_six_digits_tie(spark):
    last = spark.createDataFrame([("a", 20.0, 9e3), ("b", 21.0, 9e3), ("c", 22.0, 9e3), ("d", 0.0, 9e3)], "address string, signal double, liquidity double")
    held = spark.createDataFrame([], "address string")
    assert [r.address for r in rk.entry_candidates(last, held, 2).collect()] == ["a", "b"]
