"""Every factor and operator against plain numpy, written from its definition and not from the library's text."""

import datetime as dt
import math

import numpy as np
import pytest

from panelry.operators import formula as fm
from panelry.operators.factors import FACTORS, compute

N, T = 6, 90
COLUMNS = (
    "open high low close volume liquidity fdv twap vwap_dev oi_change vol_skew vol_conc smart_money twap_dev f1_close f2_close days_to_expiry expiry_gap spot intraday_rsi buy_ratio dazzle_ret vol_ratio "
    "inflection_ratio large_order_ret vsp_position price_oi_corr tide_speed ret_vol_cov amb_vol_corr lone_goose morning_fog long_conc_std short_weighted inv_lunar_yoy flow_in_ratio shading_tree tgd "
    "net_support_vol jump_ratio hurst cvar_5pct follow_crowd ret_skew member_ls total_oi warehouse"
).split()


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = {c: rng.normal(0, 1, (N, T)) for c in COLUMNS}
    x["close"] = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, (N, T)), 1))
    x["open"] = x["close"] * np.exp(rng.normal(0, 0.01, (N, T)))
    x["high"] = np.maximum(x["open"], x["close"]) * (1 + 0.01 * rng.random((N, T)))
    x["low"] = np.minimum(x["open"], x["close"]) * (1 - 0.01 * rng.random((N, T)))
    for c in ("volume", "liquidity", "fdv", "vol_conc", "smart_money", "vol_ratio", "total_oi", "warehouse"):
        x[c] = rng.uniform(1, 100, (N, T))
    for c, s in (("f1_close", 1.0), ("f2_close", 1.01), ("spot", 0.99), ("twap", 1.0)):
        x[c] = x["close"] * s * np.exp(rng.normal(0, 0.01, (N, T)))
    x["days_to_expiry"], x["expiry_gap"] = rng.integers(1, 60, (N, T)).astype(float), rng.integers(20, 90, (N, T)).astype(float)
    return x


@pytest.fixture(scope="module")
def panel(spark, data):
    day = [dt.date(2020, 1, 1) + dt.timedelta(t) for t in range(T)]
    rows = [(f"A{a}", day[t], *(float(data[c][a, t]) for c in COLUMNS)) for a in range(N) for t in range(T)]
    return spark.createDataFrame(rows, "address string, time date, " + ", ".join(f"{c} double" for c in COLUMNS)).cache()


def windows(x, k):
    """[N, T, k]: the last k values, zeros on the left."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros((len(x), k - 1)), x], 1), k, axis=1)


def lag(x, d=1, first=False):
    out = np.zeros_like(x)
    out[:, d:] = x[:, :-d]
    if first:
        out[:, :d] = x[:, :1]
    return out


def mean(x, k):
    return windows(x, k).mean(2)


def total(x, k):
    return windows(x, k).sum(2)


def std(x, k):
    return windows(x, k).std(2, ddof=1)


def cov(x, y, k):
    a, b = windows(x, k), windows(y, k)
    return ((a - a.mean(2, keepdims=True)) * (b - b.mean(2, keepdims=True))).mean(2)


def decay(x, k):
    return windows(x, k) @ (np.arange(1, k + 1) / (k * (k + 1) / 2))


def rank(x):
    return np.argsort(np.argsort(x, 0, kind="stable"), 0).astype(float)


def lower_median(x, axis):
    n = x.shape[axis]
    return np.take(np.sort(x, axis), [(n - 1) // 2], axis)


def after(x, k):
    """Zeros in the first k places."""
    out = x.copy()
    out[:, :k] = 0
    return out


def prospect(r):
    k = 60
    w = lambda p, g: p**g / (p**g + (1 - p) ** g) ** (1 / g)
    out = np.zeros_like(r)
    for a in range(len(r)):
        for t in range(r.shape[1]):
            line = np.sort(windows(r, k)[a, t])
            for i, v in enumerate(line):
                if v >= 0:
                    out[a, t] += (w((k - i) / k, 0.61) - w((k - i - 1) / k, 0.61)) * v**0.88
                else:
                    out[a, t] -= 2.25 * (w((i + 1) / k, 0.69) - w(i / k, 0.69)) * (-v) ** 0.88
    return out


def regress(c):
    out = np.zeros_like(c)
    j = np.arange(1, 21)
    for a in range(len(c)):
        for t in range(19, c.shape[1]):
            y = c[a, t - 19 : t + 1]
            p = np.polyfit(j, y, 2)
            r2 = 1 - ((y - np.polyval(p, j)) ** 2).sum() / (((y - y.mean()) ** 2).sum() + 1e-9)
            out[a, t] = p[1] / (y.mean() + 1e-9) * np.clip(r2, 0, 1)
    return out


def ideal(c, amp):
    out = np.zeros_like(c)
    for a in range(len(c)):
        for t in range(c.shape[1]):
            order = np.argsort(windows(c, 20)[a, t], kind="stable")
            own = windows(amp, 20)[a, t][order]
            out[a, t] = (own[-5:].sum() - own[:5].sum()) / 5
    return out


def ivol(r, m):
    k = 60
    beta = cov(r, m, k) / (cov(m, m, k) + 1e-12)
    a, b = windows(r, k), windows(m, k)
    rest = (a - a.mean(2, keepdims=True)) - beta[..., None] * (b - b.mean(2, keepdims=True))
    return np.sqrt((rest**2).sum(2) / (k - 1))


def raw_factors(x):
    o, h, low, c, v = x["open"], x["high"], x["low"], x["close"], x["volume"]
    r0, r = np.log(c / (lag(c) + 1e-9)), np.log(c / (lag(c, 1, True) + 1e-9))
    vc, d = (v - lag(v)) / (lag(v) + 1), c - lag(c)
    up, down = mean(np.maximum(d, 0), 14) + 1e-9, mean(np.maximum(-d, 0), 14) + 1e-9
    s5, m = total(r0, 5), np.broadcast_to(r.mean(0), r.shape)
    f1, f2, gap, n0 = x["f1_close"], x["f2_close"], x["expiry_gap"], x["days_to_expiry"]
    spot = f1 * np.clip(f1 / (f2 + 1e-9), 0.5, 2) ** np.clip(n0 / gap, -3, 3)
    dl = np.log(spot / (lag(spot, 1, True) + 1e-9))
    night = ((o > lag(c, 1, True)) & (c < o)).astype(float)
    attention = mean((r - m) ** 2, 20)
    place = rank(r)
    z = (place - place.mean(0)) / (place.std(0, ddof=1) + 1e-9)
    cum = np.cumsum(x["oi_change"], 1)
    rh, rl, rc = np.log(h / (o + 1e-9)), np.log(low / (o + 1e-9)), np.log(c / (o + 1e-9))
    mid = lower_median(r, 0)
    sal = np.abs(r - mid) / (np.abs(r) + np.abs(mid) + 0.1)
    weight = 0.7 ** rank(-sal)
    sa = np.zeros_like(c)
    sa[:, 1:] = c[:, 1:] / c[:, :-1] - 1
    sa5 = np.zeros_like(c)
    sa5[:, 5:] = c[:, 5:] / c[:, :-5] - 1
    w = x["warehouse"]
    wc = np.clip(w / (lag(w, 1, True) + 1e-9) - 1, -0.5, 0.5)
    ls = x["member_ls"]
    plain = lambda n: x[n]
    averaged = lambda n, s=1: s * mean(x[n], 20)
    out = {
        "RET": r0, "LIQ": np.clip(x["liquidity"] / (lower_median(x["liquidity"], 1) + 1e-6), 0, 2) / 2, "LIQ_FDV": np.clip(4 * x["liquidity"] / (x["fdv"] + 1e-6), 0, 1), "PRESSURE": np.tanh(3 * (c - o) / (h - low + 1e-9)),
        "FOMO": np.clip(vc - lag(vc), -5, 5), "DEV": (c - mean(c, 20)) / (mean(c, 20) + 1e-9), "LOG_VOL": np.log1p(v), "VOL_CLUSTER": np.sqrt(mean(r0 * r0, 10) + 1e-9), "MOM_REV": (s5 * lag(s5) < 0).astype(float),
        "REL_STR": (100 - 100 / (1 + up / down) - 50) / 50, "HL_RANGE": (h - low) / (c + 1e-9), "CLOSE_POS": (c - low) / (h - low + 1e-9), "VOL_TREND": vc,
        "VWAP_DEV": plain("vwap_dev"), "OI_CHANGE": plain("oi_change"), "VOL_SKEW": plain("vol_skew"), "VOL_CONC": plain("vol_conc"), "SMART_MONEY": plain("smart_money"), "TWAP_DEV": plain("twap_dev"),
        "SA_RET": sa, "SA_RET5": sa5, "SA_VOL_CHG": after(v / (mean(v, 20) + 1e-6) - 1, 19), "SA_V_RET": sa * after(v / (mean(v, 20) + 1e-6), 19), "SA_TREND": after(c / (mean(c, 60) + 1e-6) - 1, 59),
        "TERM_SPREAD": np.log(f1 / (f2 + 1e-9)), "PINDYCK_VOL": std(dl / (std(dl, 5) + 1e-9), 25), "CARRY": (f1 - f2) / (f2 + 1e-9) * np.clip(365 / gap, 0, 30),
        "BASIS": -mean((f1 - x["spot"]) / (x["spot"] + 1e-9) * np.clip(365 / n0, 0, 50), 20), "NEAR_SUB_SPREAD": mean(np.clip(-(f2 - f1) / (f1 + 1e-9) * 365 / gap, -50, 50), 20),
        "BASIS_MOM": after(f1 / (lag(f1, 20, True) + 1e-9) - f2 / (lag(f2, 20, True) + 1e-9), 20), "BASIS_MOM_LOG": np.zeros_like(c),
        "XS_MOM": after((lag(c, 3, True) - lag(c, 23, True)) / (lag(c, 23, True) + 1e-9), 23), "OVERNIGHT_GAP": total(np.abs(np.log(o / (lag(c, 1, True) + 1e-9))), 20), "SIGN_MOM": mean((c >= lag(c, 1, True)).astype(float), 20),
        "TSMOM": after(np.sign(np.log(c / (lag(c, 20, True) + 1e-9))) / (std(r, 60) * math.sqrt(252) + 1e-9), 20), "ROBUST_MOM": mean(z, 20), "INTRADAY_RSI": decay(x["intraday_rsi"] - 50, 20), "INTRADAY_REV": decay(-x["twap_dev"], 20),
        "INTRADAY_REV_DOC": decay(-np.log(c / (o + 1e-9)), 20), "ATTN_SPILL": attention.mean(0) - attention, "AB_NIGHT_REV": mean(night, 20) / (mean(night, max(min(240, T - 1), 60)) + 1e-6),
        "AMIHUD_ILLIQ": mean(np.abs(r) / (x["liquidity"] + 1e-9), 40), "MPB": mean((c - (h + low) / 2) / (h - low + 1e-9), 20), "BUY_WILL": mean(x["buy_ratio"] - 0.5, 20), "DAZZLE_RET": mean(np.abs(x["dazzle_ret"] - x["dazzle_ret"].mean(0)), 20),
        "VOL_RATIO": decay(np.log(x["vol_ratio"] + 1e-9), 20), "INFLECTION": x["inflection_ratio"] - mean(x["inflection_ratio"], 5), "LARGE_ORDER": averaged("large_order_ret"), "VP_SKEW": mean(x["vsp_position"] - 0.5, 20), "VOL_ENTROPY_STD": std(x["vol_conc"], 20),
        "TS_REGRESS": regress(c), "MA_ALIGN": sum(np.sign(mean(c, a) - mean(c, b)) for a, b in ((5, 10), (10, 20), (20, 40), (40, 60))), "HEDGE_PRESS": np.abs(total(x["oi_change"], T - 1)) / (total(v, T - 1) + 1e-9),
        "OI_CHANGE_RATE": after(cum - lag(cum, 20, True), 20), "OI_LEVEL": (cum + 1e6) / (mean(cum + 1e6, 20) + 1e-9) - 1, "PRICE_OI_CORR": averaged("price_oi_corr"), "IVOL": ivol(r, m),
        "RS_VOL": np.sqrt(252 * mean(np.maximum(0, rh * (rh - rc) + rl * (rl - rc)), 20) + 1e-12), "SHADOW_VOL": np.sqrt(252 * std(r, 20) ** 2 + 1e-12), "SHADOW_VOL_DOC": std(((h - np.maximum(o, c)) - (np.minimum(o, c) - low)) / (h - low + 1e-9), 20),
        "IDEAL_AMP": ideal(c, h / (low + 1e-9) - 1), "SALIENCE_RET": cov(weight, r, 20), "VOL_TIDE": averaged("tide_speed"), "RET_VOL_COV": averaged("ret_vol_cov"), "AMB_VOL_CORR": averaged("amb_vol_corr"), "LONE_GOOSE": averaged("lone_goose"),
        "MORNING_FOG": averaged("morning_fog"), "LONG_CONC_STD": averaged("long_conc_std", -1), "SHORT_WEIGHTED": averaged("short_weighted", -1), "INV_LUNAR_YOY": averaged("inv_lunar_yoy", -1), "FLOW_IN_RATIO": averaged("flow_in_ratio"),
        "SHADING_TREE": averaged("shading_tree"), "TGD": averaged("tgd"), "NET_SUPPORT_VOL": averaged("net_support_vol"), "JUMP_INTENSITY": mean(np.clip(x["jump_ratio"], 0, 1), 20), "HURST": decay(x["hurst"], 20),
        "INTRADAY_CVAR": plain("cvar_5pct"), "FOLLOW_CROWD": plain("follow_crowd"), "RET_SKEW": plain("ret_skew"), "MEMBER_LS": (ls - mean(ls, 20)) / (np.abs(mean(ls, 20)) + 1e-9),
        "LS_STRENGTH": mean(ls / (np.abs(x["total_oi"]) + 1e-9), 20), "LRSR": mean(ls / (np.abs(x["total_oi"]) + 1e-9), 20), "WAREHOUSE_CHG": after(-(total(w, 20) / (lag(total(w, 20), 20) + 1e-9) - 1), 40), "INVENTORY_MOM": -mean(wc, 20),
        "OVERNIGHT_TREND": mean((o - lag(c, 1, True)) / (lag(c, 1, True) + 1e-9), 20), "PROSPECT_TK": prospect(sa),
    }
    return out


def scaled(x):
    m = lower_median(x, 1)
    s = lower_median(np.abs(x - m), 1)
    return np.clip((x - m) / (s + 1e-6), -5, 5)


def _wide(df, name):
    return df.select("address", "time", name).toPandas().pivot(index="address", columns="time", values=name).sort_index().to_numpy()


def test_every_factor_has_a_loop(data):
    assert set(raw_factors(data)) == set(FACTORS)


NAMES = list(FACTORS)


@pytest.mark.parametrize("group", range(6))
def test_factors_match_loops(panel, data, group):
    want, names = raw_factors(data), NAMES[group::6]
    out, skipped = compute(panel, names, T)
    out = out.select("address", "time", *names).toPandas().sort_values(["address", "time"])
    assert not skipped
    for name in names:
        expected = scaled(want[name]) if FACTORS[name].scaled else want[name]
        got = out[name].to_numpy(float).reshape(N, T)
        assert np.allclose(got, expected, atol=1e-6, rtol=1e-6), name


def test_operators_match_loops(panel, data):
    x, y, z = data["twap_dev"], data["vol_skew"], data["oi_change"]
    share = 1 / (1 + np.exp(-x))
    ewm = lambda h: np.stack([np.array(_ewm(row, h)) for row in x])
    low, high = (np.array([[f(row[max(0, t - 19) : t + 1]) for t in range(T)] for row in x]) for f in (np.min, np.max))
    spread = (x - x.mean(1, keepdims=True)) / (x.std(1, ddof=1, keepdims=True) + 1e-6)
    a, b, c = "twap_dev", "vol_skew", "oi_change"
    cases = {
        "ADD": ([a, b], x + y), "SUB": ([a, b], x - y), "MUL": ([a, b], x * y), "DIV": ([a, b], x / (y + 1e-6)), "NEG": ([a], -x), "ABS": ([a], np.abs(x)), "SIGN": ([a], np.sign(x)), "GATE": ([a, b, c], np.where(x > 0, y, z)),
        "JUMP": ([a], np.maximum(spread - 3, 0)), "DECAY": ([a], x + 0.8 * lag(x) + 0.6 * lag(x, 2)), "DELAY1": ([a], lag(x)), "MAX3": ([a], np.maximum(np.maximum(x, lag(x)), lag(x, 2))), "CS_RANK": ([a], rank(x) / (N - 1) * 2 - 1),
        "CS_DEMEAN": ([a], x - x.mean(0)), "MA5": ([a], mean(x, 5)), "MA20": ([a], mean(x, 20)), "DELTA5": ([a], x - lag(x, 5)), "TS_STD10": ([a], std(x, 10)), "DELAY5": ([a], lag(x, 5)),
        "CORR10": ([a, b], np.clip(cov(x, y, 10) / (std(x, 10) * std(y, 10) + 1e-8), -1, 1)), "IFELSE": ([a, b, c], share * y + (1 - share) * z), "COND_MUL": ([a, b], share * y), "EWMA5": ([a], ewm(5)), "EWMA10": ([a], ewm(10)),
        "BREAKOUT": ([a], 2 * (x - low) / (high - low + 1e-6) - 1), "DIV_SIGNED": ([a, b], x / (y + 1e-6 * np.sign(y))), "TS_ZSCORE20": ([a], (x - mean(x, 20)) / (std(x, 20) + 1e-6)), "DECAY_LINEAR20": ([a], decay(x, 20)),
    }
    assert set(cases) == set(fm.OPS)
    out, bad = fm.evaluate(panel, {k: [*args, k] for k, (args, _) in cases.items()}, T)
    out = out.toPandas().sort_values(["address", "time"])
    assert not bad
    for name, (_, expected) in cases.items():
        assert np.allclose(out[name].to_numpy(float).reshape(N, T), expected, atol=1e-7, rtol=1e-7), name


def _ewm(row, halflife):
    alpha, out = 1 - 0.5 ** (1 / halflife), [row[0]]
    for v in row[1:]:
        out.append(out[-1] + alpha * (v - out[-1]))
    return out
