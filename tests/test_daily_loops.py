"""Daily columns of the main contracts against pandas loops over each day's bars."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelry.operators import panel as pn
from panelry.operators import ticks as tk
from panelry.sources import fixtures

SF = "/root/testdata/sf0.001"


def _corr(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    ok = ~(np.isnan(a) | np.isnan(b))
    a, b = a[ok], b[ok]
    return None if len(a) < 2 or a.std() == 0 or b.std() == 0 else float(np.corrcoef(a, b)[0, 1])


def _ratio(a, b):
    return a / b if b else None


def day_loop(g):
    g = g.sort_values("datetime")
    o, h, low, c, v = (g[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume"))
    oi, hour = g["close_oi"].to_numpy(float), g["datetime"].dt.hour.to_numpy()
    half = hour * 2 + (g["datetime"].dt.minute.to_numpy() >= 30)
    dc, ret = np.diff(c), np.diff(c) / c[:-1]
    vwap, close = (v * c).sum() / v.sum(), c[-1]
    level = {p: v[c == p].sum() for p in set(c)}
    price = min(level, key=lambda p: (-level[p], p))
    big = v >= np.quantile(v, 0.9)
    turn = dc[1:] * dc[:-1]
    dev = np.cumsum(c - c.mean())
    dv = np.diff(v)
    up = np.flatnonzero(ret > 0) + 1
    down = np.flatnonzero(ret < 0) + 1
    rv = (ret**2).sum()
    jump = dv > dv.mean() + dv.std(ddof=1) if len(dv) > 1 else np.zeros(len(dv), bool)
    return {
        "vwap_dev": (vwap - close) / (close + 1e-9), "twap_dev": (c.mean() - close) / (close + 1e-9), "oi_change": oi[-1] - oi[0], "total_oi": oi[-1],
        "vol_skew": v[hour < 13].sum() / (v[hour >= 13].sum() + 1e-9), "vol_conc": max(v[half == b].sum() for b in set(half)) / (v.sum() + 1e-9), "smart_money": v[hour >= 14].sum() / (v[hour < 10].sum() + 1e-9),
        "vsp_position": _ratio(price - low.min(), h.max() - low.min()), "buy_ratio": (c > o).mean(), "large_order_ret": np.log(c / o)[big].mean(),
        "intraday_rsi": _ratio(np.maximum(dc, 0).mean(), np.abs(dc).mean()) * 100 if len(dc) and np.abs(dc).mean() else None, "vol_ratio": _ratio(v[c > o].sum(), v[c <= o].sum()),
        "inflection_ratio": (turn < 0).mean() if len(turn) else None, "flow_in_ratio": (v[1:] * c[1:] * np.sign(dc)).sum() / (v[1:] * c[1:]).sum() if len(dc) else None,
        "net_support_vol": (v[c < c.mean()].sum() - v[c > c.mean()].sum()) / v.sum(), "jump_ratio": 1 - math.pi / 2 * (np.abs(ret[1:]) * np.abs(ret[:-1])).sum() / rv if len(ret) > 1 and rv else None,
        "hurst": _ratio(dev.max() - dev.min(), c.std()), "price_oi_corr": _corr(c, oi), "dazzle_ret": ret[jump].mean() if jump.any() else None,
        "gu": (up * ret[up - 1]).sum() / ret[up - 1].sum() if len(c) >= 10 and len(up) >= 3 and len(down) >= 3 else None,
        "gd": (down * ret[down - 1]).sum() / ret[down - 1].sum() if len(c) >= 10 and len(up) >= 3 and len(down) >= 3 else None,
    }


@pytest.fixture(scope="module")
def main(spark):
    rows = pn.main_ticks(fixtures.ticks(spark, SF)).withColumn("datetime", F.col("datetime").cast("timestamp")).toPandas()
    return {key: g for key, g in rows.groupby(["address", "day"])}


def test_daily_columns_match_loops(spark, main):
    got = {(r.address, r.day): r for r in tk.daily_columns(fixtures.ticks(spark, SF)).collect()}
    assert set(got) == set(main)
    seen = set()
    for key, g in main.items():
        for name, want in day_loop(g).items():
            have = got[key][name]
            if want is None or (isinstance(want, float) and math.isnan(want)):
                assert have is None or math.isnan(have), (key, name)
            else:
                seen.add(name)
                assert have == pytest.approx(want, rel=1e-6, abs=1e-7), (key, name)
    assert len(seen) >= 17


def test_main_contract_has_most_interest(spark, main):
    every = fixtures.ticks(spark, SF).withColumn("day", F.to_date("datetime")).toPandas()
    for (address, day), g in main.items():
        own = every[(every.product_id + "." + every.exchange == address) & (every.day == day)].groupby("symbol").close_oi.mean()
        assert g.symbol.nunique() == 1 and g.symbol.iloc[0] == min(own.index, key=lambda s: (-own[s], s))


def test_inv_lunar_yoy_falls_back_to_near_days(spark):
    import datetime as dt

    d = dt.date
    values = spark.createDataFrame([("a", d(2020, 1, 1), 10.0), ("a", d(2021, 1, 1), 20.0), ("a", d(2021, 2, 1), -5.0), ("a", d(2022, 1, 1), 30.0), ("a", d(2022, 2, 1), 40.0), ("a", d(2022, 3, 1), 8.0)], "address string, time date, value double")
    calendar = spark.createDataFrame(
        [(d(2020, 1, 1), 2020, 1, 5), (d(2021, 1, 1), 2021, 1, 5), (d(2021, 2, 1), 2021, 2, 7), (d(2022, 1, 1), 2022, 1, 5), (d(2022, 2, 1), 2022, 1, 7), (d(2022, 3, 1), 2022, 2, 7)], "time date, lunar_year int, lunar_month int, lunar_day int"
    )
    got = {r.time: r.inv_lunar_yoy for r in pn.inv_lunar_yoy(values, calendar).collect()}
    # the same day of two years, and two days away; a negative value is none to compare with
    assert got == pytest.approx({d(2021, 1, 1): 1.0, d(2022, 1, 1): 1.0, d(2022, 2, 1): 40 / 15 - 1})


@pytest.mark.parametrize("lags, what", [(6, "intercept_t"), (5, "t_std")])
def test_lag_regression_matches_least_squares(spark, lags, what):
    """Against numpy's own solver; too few bars and a column that repeats another give null."""
    rng = np.random.default_rng(12)
    n, start = 60, dt.datetime(2024, 1, 2, 9)
    days = {"a": (rng.integers(1, 100, n), 100 + rng.normal(size=n).cumsum()), "b": (rng.integers(1, 100, lags + 4), 50 + rng.normal(size=lags + 4)), "c": (np.tile([3, 9], n // 2), 80 + rng.normal(size=n))}
    rows = [("X", p, f"{p}2402", start + dt.timedelta(minutes=i), float(c[i]), float(c[i]) + 1, float(c[i]) - 1, float(c[i]), int(v[i]), 1000, 1000) for p, (v, c) in days.items() for i in range(len(v))]
    ticks = spark.createDataFrame(rows, "exchange string, product_id string, symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume long, open_oi long, close_oi long")
    got = {r.address.split(".")[0]: (r.value, r.f_value) for r in tk.lag_regression(ticks, lags, what).collect()}
    volume, close = days["a"]
    dv, ret = np.diff(volume).astype(float), close[1:] / close[:-1] - 1
    x = np.stack([np.ones(len(dv) - lags)] + [dv[lags - k : len(dv) - k] for k in range(1, lags + 1)], 1)
    y = ret[lags:]
    beta, _, _, _ = np.linalg.lstsq(x, y, rcond=None)
    rss = ((y - x @ beta) ** 2).sum()
    t = beta / np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss / (len(y) - lags - 1))
    value = abs(t[0]) if what == "intercept_t" else t[1:].std(ddof=1)
    f = ((((y - y.mean()) ** 2).sum() - rss) / lags) / (rss / (len(y) - lags - 1))
    assert np.allclose(got["a"], (value, f), rtol=1e-6)
    assert got.get("b", (None, None))[0] is None and got["c"][0] is None
    assert "Python" not in tk.lag_regression(ticks, lags, what)._jdf.queryExecution().executedPlan().toString()
