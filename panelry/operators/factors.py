"""Factors as layers of expressions over the dense panel.

A factor names the columns it needs and gives layers of named expressions; a layer only uses columns
of the panel and of earlier layers.  ``compute`` merges the layers of all wanted factors, so that all
windows of one layer and partitioning share one sort and equal intermediate columns are computed once.
The number of shuffles follows the changes between address windows and time windows, not the number of
factors.  Columns are chosen by name only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import BLOCK
from .panel import time_index
from ..functions.rolling import ROW, clip, cov, cross, cross_rank, decay, duck_text, lag0, lag1st, mean, median, over, robust, spark_text, std, total
from ..sources.io import settled

Layers = list[dict[str, str]]


@dataclass(frozen=True)
class Factor:
    """``layers(T)`` gives the expressions for a panel of T times; the last defines the raw value ``<name>__x``.

    The scaled value is ``<name>__f`` until the end, as names of factors and of panel columns may differ in case alone.
    """

    name: str
    requires: tuple[str, ...]
    layers: Callable[[int], Layers]
    scaled: bool = True
    category: str = ""

    def all_layers(self, times: int) -> Layers:
        raw = f"{self.name}__x"
        return self.layers(times) + (robust(raw, f"{self.name}__f") if self.scaled else [{f"{self.name}__f": raw}])


FACTORS: dict[str, Factor] = {}


def register_factor(name: str, requires: Iterable[str], layers: Callable[[int], Layers], scaled: bool = True, category: str = "") -> Factor:
    """Add a factor of the user's own; it can be named wherever a built-in one can."""
    if name in FACTORS:
        raise ValueError(f"factor {name} exists")
    FACTORS[name] = Factor(name, tuple(requires), layers, scaled, category)
    return FACTORS[name]


def log(x: str) -> str:
    """Logarithm that stays finite at zero and below."""
    return f"ln(greatest({x}, 1e-12))"


def _one(name: str, requires: str, raw: str, *before: dict[str, str], scaled: bool = True, category: str = "") -> None:
    register_factor(name, requires.split(), lambda T: [*before, {f"{name}__x": raw}], scaled, category)


_RET0 = {"_r0": log(f"close / ({lag0('close')} + 1e-9)")}
_RET = {"_r": log(f"close / ({lag1st('close')} + 1e-9)")}
_VC = {"_vc": f"(volume - {lag0('volume')}) / ({lag0('volume')} + 1)"}
_I = {"_i": ROW}

# Base features
_one("RET", "close", "_r0", _RET0, category="base")
_one("LIQ", "liquidity", f"{clip('liquidity / (_ml + 1e-6)', 0, 2)} / 2", {"_ml": median("liquidity", "address")}, scaled=False, category="base")
_one("LIQ_FDV", "liquidity fdv", clip("4 * liquidity / (fdv + 1e-6)", 0, 1), scaled=False, category="base")
_one("PRESSURE", "open high low close", "tanh(3 * (close - open) / (high - low + 1e-9))", scaled=False, category="base")
_one("FOMO", "volume", clip(f"_vc - {lag0('_vc')}", -5, 5), _VC, category="base")
_one("DEV", "close", "(close - _ma20) / (_ma20 + 1e-9)", {"_ma20": mean("close", 20)}, category="base")
_one("LOG_VOL", "volume", "ln(1 + volume)", category="base")
_one("VOL_CLUSTER", "close", "sqrt(_v10 + 1e-9)", _RET0, {"_v10": mean("_r0 * _r0", 10)}, category="base")
_one("MOM_REV", "close", f"CASE WHEN _s5 * {lag0('_s5')} < 0 THEN 1e0 ELSE 0e0 END", _RET0, {"_s5": total("_r0", 5)}, scaled=False, category="base")
_one("REL_STR", "close", "(100 - 100 / (1 + (_up14 + 1e-9) / (_down14 + 1e-9)) - 50) / 50", {"_dc": f"close - {lag0('close')}"}, {"_up14": mean("greatest(_dc, 0e0)", 14), "_down14": mean("greatest(-_dc, 0e0)", 14)}, category="base")
_one("HL_RANGE", "high low close", "(high - low) / (close + 1e-9)", category="base")
_one("CLOSE_POS", "high low close", "(close - low) / (high - low + 1e-9)", scaled=False, category="base")
_one("VOL_TREND", "volume", "_vc", _VC, category="base")
for _name, _column in {"VWAP_DEV": "vwap_dev", "OI_CHANGE": "oi_change", "VOL_SKEW": "vol_skew", "VOL_CONC": "vol_conc", "SMART_MONEY": "smart_money", "TWAP_DEV": "twap_dev"}.items():
    _one(_name, _column, _column, category="base")
# Single-asset features: full windows, null before
_one("SA_RET", "close", f"coalesce(close / nullif(lag(close, 1) OVER (PARTITION BY address ORDER BY time), 0e0) - 1, 0e0)", scaled=False, category="single")  # noqa: F541
_one("SA_RET5", "close", f"coalesce(close / nullif(lag(close, 5) OVER (PARTITION BY address ORDER BY time), 0e0) - 1, 0e0)", scaled=False, category="single")  # noqa: F541
_one("SA_VOL_CHG", "volume", f"CASE WHEN _i >= 20 THEN volume / (avg(volume) {over(20)} + 1e-6) - 1 ELSE 0e0 END", _I, scaled=False, category="single")
_one("SA_V_RET", "close volume", f"_sr * (CASE WHEN _i >= 20 THEN volume / (avg(volume) {over(20)} + 1e-6) ELSE 0e0 END)", _I | {"_sr": "coalesce(close / nullif(lag(close, 1) OVER (PARTITION BY address ORDER BY time), 0e0) - 1, 0e0)"}, scaled=False, category="single")
_one("SA_TREND", "close", f"CASE WHEN _i >= 60 THEN close / (avg(close) {over(60)} + 1e-6) - 1 ELSE 0e0 END", _I, scaled=False, category="single")


def _mean_of(name: str, column: str, inner: str | None = None, k: int = 20, sign: str = "", category: str = "") -> None:
    """A rolling mean of a column, or of an expression of columns."""
    _one(name, column, f"{sign}{mean(f'_{name}', k)}", {f"_{name}": inner or column}, category=category)


# Term structure
_one("TERM_SPREAD", "f1_close f2_close", log("f1_close / (f2_close + 1e-9)"), category="curve")
_one(
    "PINDYCK_VOL", "f1_close f2_close days_to_expiry expiry_gap", std("_pz", 25),
    {"_spot": f"f1_close * power({clip('f1_close / (f2_close + 1e-9)', 0.5, 2)}, {clip('days_to_expiry / expiry_gap', -3, 3)})"}, {"_dl": log(f"_spot / ({lag1st('_spot')} + 1e-9)")}, {"_pz": f"_dl / ({std('_dl', 5)} + 1e-9)"}, category="curve",
)
_one("CARRY", "f1_close f2_close expiry_gap", f"(f1_close - f2_close) / (f2_close + 1e-9) * {clip('365 / expiry_gap', 0, 30)}", category="curve")
_one("BASIS", "f1_close spot days_to_expiry", f"-{mean('_basis', 20)}", {"_basis": f"(f1_close - spot) / (spot + 1e-9) * {clip('365 / days_to_expiry', 0, 50)}"}, category="curve")
_mean_of("NEAR_SUB_SPREAD", "f1_close f2_close expiry_gap", clip("-(f2_close - f1_close) / (f1_close + 1e-9) * 365 / expiry_gap", -50, 50), category="curve")
_one("BASIS_MOM", "f1_close f2_close", f"CASE WHEN _i <= 20 THEN 0e0 ELSE f1_close / ({lag1st('f1_close', 20)} + 1e-9) - f2_close / ({lag1st('f2_close', 20)} + 1e-9) END", _I, category="curve")
_one("BASIS_MOM_LOG", "f1_close f2_close", f"CASE WHEN _i <= 243 THEN 0e0 ELSE {log(f'f1_close / ({lag1st("f1_close", 243)} + 1e-9)')} - {log(f'f2_close / ({lag1st("f2_close", 243)} + 1e-9)')} END", _I, category="curve")
# Momentum
_one("XS_MOM", "close", f"CASE WHEN _i <= 23 THEN 0e0 ELSE ({lag1st('close', 3)} - {lag1st('close', 23)}) / ({lag1st('close', 23)} + 1e-9) END", _I, category="momentum")
_one("OVERNIGHT_GAP", "open close", total("_gap", 20), {"_gap": f"abs({log(f'open / ({lag1st("close")} + 1e-9)')})"}, category="momentum")
_mean_of("SIGN_MOM", "close", f"CASE WHEN close >= {lag1st('close')} THEN 1e0 ELSE 0e0 END", category="momentum")
_one("TSMOM", "close", f"CASE WHEN _i <= 20 THEN 0e0 ELSE sign({log(f'close / ({lag1st("close", 20)} + 1e-9)')}) / ({std('_r', 60)} * sqrt(252e0) + 1e-9) END", _I | _RET, category="momentum")
_one("ROBUST_MOM", "close", mean("_rz", 20), _RET, {"_rank": f"{cross_rank('_r')} * 1e0"}, {"_rz": f"(_rank - {cross('avg', '_rank')}) / ({cross('stddev_samp', '_rank')} + 1e-9)"}, category="momentum")
_one("INTRADAY_RSI", "intraday_rsi", decay("(intraday_rsi - 50)", 20), _I, category="momentum")
_one("INTRADAY_REV", "twap_dev", decay("(-twap_dev)", 20), _I, category="reversal")
_one("INTRADAY_REV_DOC", "open close", decay("(-_oc)", 20), _I | {"_oc": log("close / (open + 1e-9)")}, category="reversal")
_one("ATTN_SPILL", "close", f"{cross('avg', '_att')} - _att", _RET, {"_mkt": cross("avg", "_r")}, {"_att": mean("(_r - _mkt) * (_r - _mkt)", 20)}, category="reversal")
register_factor(
    "AB_NIGHT_REV", ("open", "close"),
    lambda T: [{"_night": f"CASE WHEN open > {lag1st('close')} AND close < open THEN 1e0 ELSE 0e0 END"}, {"AB_NIGHT_REV__x": f"{mean('_night', 20)} / ({mean('_night', max(min(240, T - 1), 60))} + 1e-6)"}], category="reversal",
)


# Fixed values of prospect theory: curvature, loss aversion, weighting of gains and of losses.
_CURVE, _LOSS, _GAIN_WEIGHT, _LOSS_WEIGHT = 0.88, 2.25, 0.61, 0.69


def prospect_weights(k: int) -> tuple[list[float], list[float]]:
    """Decision weights by sorted position of ``k`` equally likely outcomes: as a loss, and as a gain."""

    def w(p: float, g: float) -> float:
        return p**g / (p**g + (1 - p) ** g) ** (1 / g)

    low = [w((i + 1) / k, _LOSS_WEIGHT) - w(i / k, _LOSS_WEIGHT) for i in range(k)]
    high = [w((k - i) / k, _GAIN_WEIGHT) - w((k - i - 1) / k, _GAIN_WEIGHT) for i in range(k)]
    return low, high


# Liquidity, micro structure, volume
_mean_of("AMIHUD_ILLIQ", "close liquidity", f"abs({log(f'close / ({lag1st("close")} + 1e-9)')}) / (liquidity + 1e-9)", 40, category="liquidity")
_mean_of("MPB", "high low close", "(close - (high + low) / 2) / (high - low + 1e-9)", category="micro")
_mean_of("BUY_WILL", "buy_ratio", "buy_ratio - 0.5", category="micro")
_one("DAZZLE_RET", "dazzle_ret", mean("_daz", 20), {"_dzm": cross("avg", "dazzle_ret")}, {"_daz": "abs(dazzle_ret - _dzm)"}, category="micro")
_one("VOL_RATIO", "vol_ratio", decay("_lvr", 20), _I | {"_lvr": log("vol_ratio + 1e-9")}, category="micro")
_one("INFLECTION", "inflection_ratio", f"inflection_ratio - {mean('inflection_ratio', 5)}", category="micro")
_mean_of("LARGE_ORDER", "large_order_ret", category="micro")
_mean_of("VP_SKEW", "vsp_position", "vsp_position - 0.5", category="volume")
_one("VOL_ENTROPY_STD", "vol_conc", std("vol_conc", 20), category="volume")


def _regress(T: int) -> Layers:
    j2 = sum(j * j for j in range(1, 21)) / 20
    xx = sum((j - 10.5) ** 2 for j in range(1, 21))
    xq = sum((j - 10.5) * j * j for j in range(1, 21))
    qq = sum((j * j - j2) ** 2 for j in range(1, 21))
    det = xx * qq - xq * xq
    s, s1, s2, sy = total("close", 20), total("_i * close", 20), total("_i * _i * close", 20), f"sum(close * close) {over(20)}"
    return [
        _I,
        {"_s": s, "_t1": s1, "_t2": s2, "_yy": sy},
        {"_s1": "_t1 - (_i - 20) * _s"},
        {"_s2": "_t2 - 2 * (_i - 20) * _s1 - (_i - 20) * (_i - 20) * _s"},
        {"_xy": "_s1 - 10.5e0 * _s", "_qy": f"_s2 - {j2}e0 * _s", "_tot": "_yy - _s * _s / 20"},
        {"_b": f"(_xy * {qq}e0 - _qy * {xq}e0) / {det}e0", "_c": f"(_qy * {xx}e0 - _xy * {xq}e0) / {det}e0"},
        {"TS_REGRESS__x": f"CASE WHEN _i < 20 THEN 0e0 ELSE _b / (_s / 20 + 1e-9) * {clip('(_b * _xy + _c * _qy) / (_tot + 1e-9)', 0, 1)} END"},
    ]


register_factor("TS_REGRESS", ("close",), _regress, category="trend")
_one("MA_ALIGN", "close", "sign(_a5 - _a10) + sign(_a10 - _a20) + sign(_a20 - _a40) + sign(_a40 - _a60)", {f"_a{k}": mean("close", k) for k in (5, 10, 20, 40, 60)}, category="trend")


def _hedge(T: int) -> Layers:
    j = min(243, T - 1)
    return [{"HEDGE_PRESS__x": "0e0" if j < 20 else f"abs({total('oi_change', j)}) / ({total('volume', j)} + 1e-9)"}]


register_factor("HEDGE_PRESS", ("oi_change", "volume"), _hedge, scaled=False, category="positions")
_CUM = {"_cum": "sum(oi_change) OVER (PARTITION BY address ORDER BY time ROWS UNBOUNDED PRECEDING)"}
_one("OI_CHANGE_RATE", "oi_change", f"CASE WHEN _i <= 20 THEN 0e0 ELSE _cum - {lag1st('_cum', 20)} END", _I | _CUM, category="positions")
_one("OI_LEVEL", "oi_change", f"_oil / ({mean('_oil', 20)} + 1e-9) - 1", _CUM, {"_oil": "_cum + 1e6"}, category="positions")
_mean_of("PRICE_OI_CORR", "price_oi_corr", category="positions")
# Volatility
_one(
    "IVOL", "close", "sqrt(greatest(0e0, _srr - 2 * _beta * _srm + _beta * _beta * _smm) / 59)",
    _RET, {"_mkt": cross("avg", "_r")}, {"_crm": cov("_r", "_mkt", 60), "_crr": cov("_r", "_r", 60), "_cmm": cov("_mkt", "_mkt", 60)},
    {"_srr": "60 * _crr", "_srm": "60 * _crm", "_smm": "60 * _cmm", "_beta": "_crm / (_cmm + 1e-12)"}, category="volatility",
)
_one("RS_VOL", "open high low close", f"sqrt(252 * {mean('_rs', 20)} + 1e-12)", {"_h": log("high / (open + 1e-9)"), "_l": log("low / (open + 1e-9)"), "_c0": log("close / (open + 1e-9)")}, {"_rs": "greatest(0e0, _h * (_h - _c0) + _l * (_l - _c0))"}, category="volatility")
_one("SHADOW_VOL", "close", f"sqrt(252 * power({std('_r', 20)}, 2) + 1e-12)", _RET, category="volatility")
_one("SHADOW_VOL_DOC", "open high low close", std("_shadow", 20), {"_shadow": "((high - greatest(open, close)) - (least(open, close) - low)) / (high - low + 1e-9)"}, category="volatility")
_one("IDEAL_AMP", "high low close", "(_top - _bottom) / 5", {"_amp": "high / (low + 1e-9) - 1"}, {"_w": f"ROWS_OF(close, _amp, 20)"}, {"_top": "TOP_OF(_w, 5)", "_bottom": "BOTTOM_OF(_w, 5)"}, category="volatility")  # noqa: F541
_one("SALIENCE_RET", "close", cov("_sw", "_r", 20), _RET, {"_mid": median("_r", "time")}, {"_sal": "abs(_r - _mid) / (abs(_r) + abs(_mid) + 0.1)"}, {"_sw": "power(0.7e0, row_number() OVER (PARTITION BY time ORDER BY _sal DESC, address) - 1)"}, category="reversal")
# Columns with a producer of their own
for _name, _column, _sign in (("VOL_TIDE", "tide_speed", ""), ("RET_VOL_COV", "ret_vol_cov", ""), ("AMB_VOL_CORR", "amb_vol_corr", ""), ("LONE_GOOSE", "lone_goose", ""), ("MORNING_FOG", "morning_fog", ""), ("LONG_CONC_STD", "long_conc_std", "-"), ("SHORT_WEIGHTED", "short_weighted", "-"), ("INV_LUNAR_YOY", "inv_lunar_yoy", "-"), ("FLOW_IN_RATIO", "flow_in_ratio", ""), ("SHADING_TREE", "shading_tree", ""), ("TGD", "tgd", ""), ("NET_SUPPORT_VOL", "net_support_vol", "")):
    _mean_of(_name, _column, sign=_sign, category="daily")
_mean_of("JUMP_INTENSITY", "jump_ratio", clip("jump_ratio", 0, 1), category="daily")
_one("HURST", "hurst", decay("hurst", 20), _I, category="daily")
for _name, _column in {"INTRADAY_CVAR": "cvar_5pct", "FOLLOW_CROWD": "follow_crowd", "RET_SKEW": "ret_skew"}.items():
    _one(_name, _column, _column, category="daily")
_one("MEMBER_LS", "member_ls", f"(member_ls - {mean('member_ls', 20)}) / (abs({mean('member_ls', 20)}) + 1e-9)", category="members")
for _name in ("LS_STRENGTH", "LRSR"):
    _one(_name, "member_ls total_oi", mean("_lso", 20), {"_lso": "member_ls / (abs(total_oi) + 1e-9)"}, category="members")


def _warehouse(T: int) -> Layers:
    if T < 41:
        return [{"WAREHOUSE_CHG__x": "0e0"}]
    before = "sum(warehouse) OVER (PARTITION BY address ORDER BY time ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)"
    return [_I, {"WAREHOUSE_CHG__x": f"CASE WHEN _i <= 40 THEN 0e0 ELSE -({total('warehouse', 20)} / (coalesce({before}, 0e0) + 1e-9) - 1) END"}]


register_factor("WAREHOUSE_CHG", ("warehouse",), _warehouse, category="stock")
register_factor("INVENTORY_MOM", ("warehouse",), lambda T: [{"_wc": clip(f"warehouse / ({lag1st('warehouse')} + 1e-9) - 1", -0.5, 0.5)}, {"INVENTORY_MOM__x": "0e0" if T < 22 else f"-{mean('_wc', 20)}"}], category="stock")
_mean_of("OVERNIGHT_TREND", "open close", f"(open - {lag1st('close')}) / ({lag1st('close')} + 1e-9)", category="momentum")
_one("PROSPECT_TK", "close", "WEIGHTED(_pw)", {"_pr": f"close / ({lag1st('close')} + 1e-9) - 1"}, {"_pw": "ROWS_OF(_pr, _pr, 60)"}, category="reversal")


def spark_expression(x: str) -> str:
    """Text for Spark: windows of rows as sorted arrays, filled with zeros on the left."""
    if x.startswith("ROWS_OF("):
        key, value, k = x[8:-1].split(", ")
        pair = f"struct({key} AS k, {value} AS v)"
        return f"array_sort(concat(collect_list({pair}) {over(int(k))}, array_repeat(struct(0e0 AS k, 0e0 AS v), {k} - cast(count(1) {over(int(k))} AS int))))"
    for name, side in (("TOP_OF", "slice({w}, -{n}, {n})"), ("BOTTOM_OF", "slice({w}, 1, {n})")):
        if x.startswith(name):
            w, n = x[len(name) + 1 : -1].split(", ")
            return f"aggregate({side.format(w=w, n=n)}, 0e0, (s, r) -> s + r.v)"
    if x.startswith("WEIGHTED("):
        low, high = ("array(" + ", ".join(f"{w!r}D" for w in side) + ")" for side in prospect_weights(60))
        value = f"CASE WHEN r.v >= 0 THEN {high}[i] * power(r.v, {_CURVE}D) ELSE -{_LOSS}D * {low}[i] * power(-r.v, {_CURVE}D) END"
        return f"aggregate(transform({x[9:-1]}, (r, i) -> {value}), 0e0, (s, y) -> s + y)"
    return spark_text(x)


def duck_expression(x: str) -> str:
    """The same text for DuckDB."""
    if x.startswith("ROWS_OF("):
        key, value, k = x[8:-1].split(", ")
        return f"list_sort(list_concat(list({{'k': {key}, 'v': {value}}}) {over(int(k))}, list_resize([]::STRUCT(k DOUBLE, v DOUBLE)[], {k} - (count(*) {over(int(k))}), {{'k': 0e0, 'v': 0e0}})))"
    for name, side in (("TOP_OF", "list_slice({w}, -{n}, -1)"), ("BOTTOM_OF", "list_slice({w}, 1, {n})")):
        if x.startswith(name):
            w, n = x[len(name) + 1 : -1].split(", ")
            return f"list_sum(list_transform({side.format(w=w, n=n)}, lambda r: r.v))"
    if x.startswith("WEIGHTED("):
        low, high = ("[" + ", ".join(f"{w!r}::DOUBLE" for w in side) + "]" for side in prospect_weights(60))
        value = f"CASE WHEN r.v >= 0 THEN {high}[i] * pow(r.v, {_CURVE}::DOUBLE) ELSE -{_LOSS}::DOUBLE * {low}[i] * pow(-r.v, {_CURVE}::DOUBLE) END"
        return f"list_sum(list_transform({x[9:-1]}, lambda r, i: {value}))"
    return duck_text(x)


def merged(names: Iterable[str], times: int, scaled: bool = True) -> Layers:
    """The layers of several factors put together, with those that scale them or without; equal names mean equal expressions."""
    out: Layers = []
    depth: dict[str, int] = {}
    known: dict[str, str] = {}
    for name in names:
        least = 0
        for layer in FACTORS[name].all_layers(times) if scaled else FACTORS[name].layers(times):
            at = least
            for column, x in layer.items():
                if known.setdefault(column, x) != x:
                    raise ValueError(f"{column} stands for two expressions")
                if column not in depth:
                    while len(out) <= at:
                        out.append({})
                    out[at][column] = x
                    depth[column] = at
                least = max(least, depth[column] + 1)
    return out


def compute(panel: DataFrame, names: Iterable[str], times: int | None = None, index: DataFrame | None = None, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """(panel with the factors, names skipped because the panel lacks a column they need).

    A factor takes the place of a panel column of the same name, whatever the case.  Histories of more than ``block`` times
    run in blocks, so that no task holds one address's whole history; ``index`` numbers the times then, (time, t).
    """
    names = list(dict.fromkeys(names))
    have = set(panel.columns)
    ready = [n for n in names if have.issuperset(FACTORS[n].requires)]
    if times is None:
        times = panel.select(F.countDistinct("time")).first()[0]
    out = panel
    if times > block:
        out = _in_blocks(panel, ready, times, time_index(panel) if index is None else index, block)
    else:
        for layer in merged(ready, times):
            out = out.withColumns({column: F.expr(spark_expression(x)) for column, x in layer.items()})
    taken = {n.lower() for n in ready}
    return out.select(*[c for c in panel.columns if c.lower() not in taken], *[F.col(f"{n}__f").alias(n) for n in ready]), [n for n in names if n not in ready]


def _in_blocks(panel: DataFrame, names: list[str], times: int, index: DataFrame, block: int) -> DataFrame:
    """The panel with ``<name>__f`` of each factor: raw values first, then medians of all of them at once, twice."""
    out = settled(panel.join(index.select("time", F.col("t").alias("__t")), "time"), "panel")
    out = blocks.layered(out, merged(names, times, scaled=False), times, block, spark_expression)
    out = settled(out.select(*panel.columns, *[f"{n}__x" for n in names]), "raw")
    scaled = [n for n in names if FACTORS[n].scaled]
    if scaled:
        steps = {n: [next(iter(layer.items())) for layer in robust(f"{n}__x", f"{n}__f")] for n in scaled}
        for k in (0, 2):  # the median, then the median deviation
            out = out.join(blocks.medians(out, {steps[n][k][0]: f"{n}__x" if k == 0 else steps[n][1][0] for n in scaled}), "address", "left")
            out = out.withColumns({steps[n][k + 1][0]: F.expr(spark_text(steps[n][k + 1][1])) for n in scaled})
    return out.withColumns({f"{n}__f": F.col(f"{n}__x") for n in names if n not in scaled})
