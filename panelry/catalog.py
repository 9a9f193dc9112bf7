"""The registered queries and, for each, SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.factors import FACTORS, compute
from .oracle.text import DAYS, factor_sql
from .plans import daily, scoring, streams, trading
from .sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Register a query under its name, with its SQL where there is one."""
    if name in QUERIES:
        raise ValueError(f"query {name} exists")
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)


#: Factors over the daily panel of ticks, and over the weekly panel with its caches; all others are over the weekly panel.
FROM_TICKS = set("VWAP_DEV OI_CHANGE VOL_SKEW VOL_CONC SMART_MONEY TWAP_DEV TERM_SPREAD PINDYCK_VOL CARRY BASIS NEAR_SUB_SPREAD BASIS_MOM BASIS_MOM_LOG INTRADAY_RSI INTRADAY_REV BUY_WILL DAZZLE_RET VOL_RATIO INFLECTION LARGE_ORDER VP_SKEW VOL_ENTROPY_STD PRICE_OI_CORR VOL_TIDE JUMP_INTENSITY INTRADAY_CVAR RET_VOL_COV AMB_VOL_CORR FOLLOW_CROWD LONE_GOOSE HURST FLOW_IN_RATIO TGD NET_SUPPORT_VOL RET_SKEW MORNING_FOG SHADING_TREE".split())
FROM_CACHES = set("MEMBER_LS LONG_CONC_STD LS_STRENGTH LRSR SHORT_WEIGHTED WAREHOUSE_CHG INVENTORY_MOM INV_LUNAR_YOY".split())


def _factor(name: str) -> Callable[[SparkSession, str], DataFrame]:
    needs = FACTORS[name].requires

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name in FROM_TICKS:
            panel, times = daily.tick_panel(spark, sf_dir, needs), fixtures.days(spark, sf_dir)
        else:
            panel, times = daily.member_panel(spark, sf_dir, needs) if name in FROM_CACHES else fixtures.panel(spark, sf_dir), fixtures.weeks(spark, sf_dir)
        out, skipped = compute(panel, [name], times)
        if skipped:
            raise ValueError(f"the panel lacks columns of {name}")
        return out.select("address", "time", rounded(name, 4).alias(name))

    query.__doc__ = f"Factor {name} over its panel."
    return query


def _factor_sql(name: str) -> str:
    if name in FROM_TICKS:
        return factor_sql(name, daily.TICK_PANEL_SQL, DAYS)
    return factor_sql(name, daily.MEMBER_PANEL_SQL) if name in FROM_CACHES else factor_sql(name)


#: Query names of factors: base features f0.., single-asset features, then registered factors.
FACTOR_QUERIES = {
    "f0_ret": "RET", "f1_liq": "LIQ", "f1_liq_fdv": "LIQ_FDV", "f2_pressure": "PRESSURE", "f3_fomo": "FOMO", "f4_dev": "DEV", "f5_log_vol": "LOG_VOL", "f6_vol_cluster": "VOL_CLUSTER", "f7_mom_rev": "MOM_REV", "f8_rel_str": "REL_STR", "f9_hl_range": "HL_RANGE", "f10_close_pos": "CLOSE_POS", "f11_vol_trend": "VOL_TREND", "f12_vwap_dev": "VWAP_DEV", "f13_oi_change": "OI_CHANGE", "f14_vol_skew": "VOL_SKEW", "f15_vol_conc": "VOL_CONC", "f16_smart_money": "SMART_MONEY", "f17_twap_dev": "TWAP_DEV", "f18_ret": "SA_RET", "f19_ret5": "SA_RET5", "f20_vol_chg": "SA_VOL_CHG", "f21_v_ret": "SA_V_RET", "f22_trend": "SA_TREND",
    "r1_term_spread": "TERM_SPREAD", "r2_pindyck_vol": "PINDYCK_VOL", "r3_carry": "CARRY", "r4_basis": "BASIS", "r5_near_sub_spread": "NEAR_SUB_SPREAD", "r6_basis_mom": "BASIS_MOM", "r7_basis_mom_log": "BASIS_MOM_LOG", "r8_xs_mom": "XS_MOM", "r9_overnight_gap": "OVERNIGHT_GAP", "r10_sign_mom": "SIGN_MOM", "r11_tsmom": "TSMOM", "r12_robust_mom": "ROBUST_MOM", "r13_intraday_rsi": "INTRADAY_RSI", "r14_intraday_rev": "INTRADAY_REV", "r14_intraday_rev_doc": "INTRADAY_REV_DOC", "r15_attn_spill": "ATTN_SPILL", "r16_ab_night_rev": "AB_NIGHT_REV", "r17_prospect_tk": "PROSPECT_TK", "r18_salience_ret": "SALIENCE_RET", "r19_amihud_illiq": "AMIHUD_ILLIQ", "r20_mpb": "MPB", "r21_buy_will": "BUY_WILL", "r22_dazzle_ret": "DAZZLE_RET", "r23_vol_ratio": "VOL_RATIO", "r24_inflection": "INFLECTION", "r25_large_order": "LARGE_ORDER", "r26_vp_skew": "VP_SKEW", "r27_vol_entropy_std": "VOL_ENTROPY_STD", "r28_ts_regress": "TS_REGRESS", "r29_ma_align": "MA_ALIGN", "r30_hedge_press": "HEDGE_PRESS", "r31_oi_change_rate": "OI_CHANGE_RATE", "r32_oi_level": "OI_LEVEL", "r33_price_oi_corr": "PRICE_OI_CORR", "r34_ivol": "IVOL", "r35_rs_vol": "RS_VOL", "r36_shadow_vol": "SHADOW_VOL", "r36_shadow_vol_doc": "SHADOW_VOL_DOC", "r37_ideal_amp": "IDEAL_AMP", "r38_vol_tide": "VOL_TIDE", "r39_jump_intensity": "JUMP_INTENSITY", "r40_intraday_cvar": "INTRADAY_CVAR", "r41_ret_vol_cov": "RET_VOL_COV", "r42_amb_vol_corr": "AMB_VOL_CORR", "r43_follow_crowd": "FOLLOW_CROWD", "r44_lone_goose": "LONE_GOOSE", "r45_hurst": "HURST", "r46_morning_fog": "MORNING_FOG", "r47_member_ls": "MEMBER_LS", "r48_long_conc_std": "LONG_CONC_STD", "r49_ls_strength": "LS_STRENGTH", "r50_lrsr": "LRSR", "r51_short_weighted": "SHORT_WEIGHTED", "r52_warehouse_chg": "WAREHOUSE_CHG", "r53_inventory_mom": "INVENTORY_MOM", "r54_inv_lunar_yoy": "INV_LUNAR_YOY", "r55_flow_in_ratio": "FLOW_IN_RATIO", "r56_shading_tree": "SHADING_TREE", "r57_overnight_trend": "OVERNIGHT_TREND", "r58_tgd": "TGD", "r59_net_support_vol": "NET_SUPPORT_VOL", "r60_ret_skew": "RET_SKEW",
}
for _query, _name in FACTOR_QUERIES.items():
    add(_query, _factor(_name), _factor_sql(_name))

daily.register(add, rounded)
scoring.register(add, rounded)
trading.register(add, rounded)
streams.register(add, rounded)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    return QUERIES["b11_sharpe"](spark, sf_dir)
