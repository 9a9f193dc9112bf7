"""Long histories: blocks of times and medians from histograms give what whole histories give."""

import datetime as dt

import numpy as np
import pytest
from test_loops import N, NAMES, T, data, panel, raw_factors, scaled  # noqa: F401

from panelry.operators import blocks
from panelry.operators.factors import FACTORS, compute, merged, spark_expression
from panelry.operators.panel import time_index


@pytest.mark.parametrize("group", range(6))
def test_factors_in_blocks_match_loops(panel, data, group):  # noqa: F811
    want, names = raw_factors(data), NAMES[group::6]
    out, skipped = compute(panel, names, T, block=70)
    out = out.select("address", "time", *names).toPandas().sort_values(["address", "time"])
    assert not skipped and len(out) == N * T
    for name in names:
        expected = scaled(want[name]) if FACTORS[name].scaled else want[name]
        assert np.allclose(out[name].to_numpy(float).reshape(N, T), expected, atol=1e-6, rtol=1e-6), name


def test_short_frames_in_blocks_equal_whole_histories(spark):
    """Blocks that start in the middle of the history: all factors of bars that look back less than a block."""
    rng, n = np.random.default_rng(8), 420
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, (3, n)), 1))
    rows = [(f"A{a}", dt.date(2020, 1, 1) + dt.timedelta(t), *(float(close[a, t] * (1 + 0.01 * x)) for x in (0, rng.normal(), 1 + rng.random(), -1 - rng.random())), float(rng.uniform(1, 99)), float(rng.uniform(1, 99)), float(rng.normal())) for a in range(3) for t in range(n)]
    bars = spark.createDataFrame(rows, "address string, time date, close double, open double, high double, low double, volume double, liquidity double, oi_change double").cache()
    names = [k for k, f in FACTORS.items() if set(f.requires) <= set(bars.columns) and blocks.reach([{c: spark_expression(x) for c, x in layer.items() if "ROWS UNBOUNDED" not in x} for layer in f.layers(n)]) < 150]
    assert len(names) > 20 and {"IVOL", "TSMOM", "PROSPECT_TK", "OI_LEVEL", "LIQ", "ROBUST_MOM"} <= set(names)
    one, many = (compute(bars, names, n, block=k)[0].select("address", "time", *names).toPandas().sort_values(["address", "time"]) for k in (n, 100))
    for name in names:
        assert np.allclose(one[name].to_numpy(float), many[name].to_numpy(float), atol=1e-7, rtol=1e-6), name


def test_no_window_of_a_factor_holds_a_history(panel):  # noqa: F811
    """Plans in blocks have no window and no percentile by address alone, but for sums of one row a block or bucket."""
    apart = {"OI_LEVEL", "OI_CHANGE_RATE", "LIQ"}  # totals and a median by address
    layers = [{c: spark_expression(x) for c, x in layer.items()} for layer in merged([n for n in NAMES if n not in apart], T, scaled=False)]
    rows = panel.join(time_index(panel).withColumnRenamed("t", "__t"), "time")
    plan = blocks.in_blocks(rows, layers, T, 70)._jdf.queryExecution().optimizedPlan().toString()
    assert "__block#" in plan
    for line in plan.splitlines():
        if "windowspecdefinition(address#" in line:
            assert all(part.lstrip("0123456789").startswith(", __block#") for part in line.split("windowspecdefinition(address#")[1:])


def test_a_block_looks_back_as_far_as_its_layers():
    layers = [{"a": "lag(x, 3, 0e0) OVER (w)"}, {"b": "sum(a) OVER (ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "c": "lag(a) OVER (w)"}, {"d": "a + b"}]
    assert blocks.reach(layers) == 22
    with pytest.raises(ValueError):
        blocks.blocked("avg(x) OVER (PARTITION BY address)")


def test_medians_are_exact_lower_medians(spark):
    rng = np.random.default_rng(4)
    groups = {
        "normal": rng.normal(size=501), "even": rng.normal(size=400) * 1e-8, "ties": rng.integers(-2, 3, 300).astype(float), "zeros": np.zeros(70), "one": np.array([-3.5]), "wide": np.exp(rng.normal(0, 80, 333)) * rng.choice([-1, 1], 333),
        "close": 1e6 + rng.normal(size=1000) * 1e-9, "signs": np.array([-0.0, 0.0, -1e-300, 1e-300]), "huge": np.array([1.7e308, -1.7e308, 1e308, -1e308, 5.0]),
    }
    rows = [(g, float(x), None if i % 7 == 0 else float(-x)) for g, v in groups.items() for i, x in enumerate(v)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "address string, x double, y double").repartition(5)
    got = {r.address: (r.mx, r.my) for r in blocks.medians(df, {"mx": "x", "my": "y"}).collect()}
    for g, v in groups.items():
        want = tuple(sorted(c)[-(-len(c) // 2) - 1] if len(c) else None for c in (v, [-x for i, x in enumerate(v) if i % 7]))
        assert got[g] == want, g
    assert "none" not in got
    plan = blocks.medians(df, {"mx": "x"})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def test_totals_run_over_blocks(spark):
    rows = [(a, dt.date(2020, 1, 1) + dt.timedelta(t), t, float(t * (k + 1))) for k, a in enumerate("ab") for t in range(100)]
    df = spark.createDataFrame(rows, "address string, time date, __t int, x double")
    got = blocks.totals(df, {"s": "x"}, 9).orderBy("address", "__t").toPandas()
    want = np.concatenate([np.cumsum(np.arange(100.0) * (k + 1)) for k in range(2)])
    assert np.allclose(got["s"], want)
