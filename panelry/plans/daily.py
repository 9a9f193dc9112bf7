"""Queries of sources, panel construction and daily columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import panel as pn
from ..operators import ticks as tk
from ..sources import fixtures, io

_MAIN_SQL = f"""{fixtures.TICKS_SQL}, interest AS (
  SELECT product_id, exchange, symbol, datetime::DATE AS day, avg(close_oi) AS avg_oi, arg_max(close, datetime) AS last_close FROM ticks GROUP BY ALL
), placed AS (SELECT *, row_number() OVER (PARTITION BY product_id, exchange, day ORDER BY avg_oi DESC, symbol) AS place FROM interest),
main AS (
  SELECT t.*, t.datetime::DATE AS day, t.product_id || '.' || t.exchange AS address FROM ticks t JOIN placed p ON p.place = 1 AND p.product_id = t.product_id AND p.exchange = t.exchange AND p.symbol = t.symbol AND p.day = t.datetime::DATE
)"""


def _layers(source: str, layers: list[dict[str, str]], last: str) -> str:
    out, before = [], source
    for i, layer in enumerate(layers):
        name = last if i == len(layers) - 1 else f"{last}{i}"
        out.append(f"{name} AS (SELECT *, {', '.join(f'{tk.duck_form(x)} AS {c}' for c, x in layer.items())} FROM {before})")
        before = name
    return ", ".join(out)


_MINUTE_SQL = f"{_MAIN_SQL}, {_layers('main', tk.MINUTE, 'minutes')}"
_DAILY_SQL = f"{_MINUTE_SQL}, days AS (SELECT address, day, {', '.join(f'{tk.duck_form(x)} AS {c}' for c, x in tk.DAILY.items())} FROM minutes GROUP BY address, day), {_layers('days', tk.DERIVED, 'daily')}"

# the bars of five minutes, their returns inside a day, and all returns of twenty days pooled
_SKEW_SQL = """sk_bars AS (SELECT address, day, time_bucket(INTERVAL '5 minutes', datetime) AS bar, arg_max(close, datetime) AS close FROM main GROUP BY ALL),
sk_rets AS (SELECT address, day, close / nullif(lag(close) OVER (PARTITION BY address, day ORDER BY bar), 0e0) - 1 AS r FROM sk_bars), sk_days AS (SELECT address, day, row_number() OVER (PARTITION BY address ORDER BY day) AS k FROM sk_rets WHERE r IS NOT NULL GROUP BY address, day),
sk_pool AS (SELECT d.address, d.day, r.r FROM sk_days d JOIN sk_days e ON e.address = d.address AND e.k BETWEEN d.k - 19 AND d.k JOIN sk_rets r ON r.address = e.address AND r.day = e.day WHERE r.r IS NOT NULL),
skews AS (SELECT address, day, avg(pow((r - mu) / sd, 3)) AS ret_skew FROM (SELECT *, avg(r) OVER w AS mu, stddev_pop(r) OVER w AS sd, count(*) OVER w AS n FROM sk_pool WINDOW w AS (PARTITION BY address, day)) WHERE n >= 10 AND sd > 1e-12 GROUP BY address, day)"""
_TIDE_SQL = """td0 AS (SELECT *, sum(volume) OVER (PARTITION BY address, day ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS tide FROM minutes), td1 AS (SELECT *, first_value(i) OVER (PARTITION BY address, day ORDER BY tide DESC, i) AS peak FROM td0),
td2 AS (SELECT address, day, arg_min(i, tide * 10000 + i) FILTER (i < peak AND i >= 5) AS mi, arg_min(close, tide * 10000 + i) FILTER (i < peak AND i >= 5) AS mc, arg_min(i, tide * 10000 + i) FILTER (i > peak) AS ni, arg_min(close, tide * 10000 + i) FILTER (i > peak) AS nc FROM td1 GROUP BY address, day),
tides AS (SELECT address, day, (nc - mc) / nullif(mc, 0e0) / (ni - mi) AS tide_speed FROM td2)"""
_CROWD_SQL = """cw0 AS (SELECT address, day, crowd, row_number() OVER (PARTITION BY address ORDER BY day) AS k FROM daily WHERE crowd IS NOT NULL),
cw1 AS (SELECT a.address, a.day, b.day AS at, b.crowd AS v FROM cw0 a JOIN cw0 b ON a.address = b.address AND b.k BETWEEN a.k - 19 AND a.k), cw2 AS (SELECT a.address, b.address AS other, a.day, row_number() OVER (PARTITION BY a.address, b.address, a.day ORDER BY a.v, a.at)::DOUBLE AS x, row_number() OVER (PARTITION BY a.address, b.address, a.day ORDER BY b.v, a.at)::DOUBLE AS y
FROM cw1 a JOIN cw1 b ON a.day = b.day AND a.at = b.at AND a.address <> b.address), cw3 AS (SELECT address, other, day, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0e0) AS c, count(*) AS n FROM cw2 GROUP BY ALL),
crowds AS (SELECT address, day, avg(abs(c)) AS follow_crowd FROM cw3 WHERE n >= 3 AND c IS NOT NULL GROUP BY address, day)"""
#: Minutes of a bar in which addresses are compared; the given ticks are too sparse for single minutes.
GOOSE = 240
_GOOSE_SQL = f"""gs0 AS (SELECT address, day, time_bucket(INTERVAL '{GOOSE} minutes', datetime) AS bar, arg_max(close, datetime) AS close, sum(volume * close) AS turnover FROM main GROUP BY ALL), gs1 AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY address, day ORDER BY bar), 0e0) - 1 AS r FROM gs0),
gs2 AS (SELECT day, bar, stddev_samp(r) AS d FROM gs1 GROUP BY day, bar HAVING stddev_samp(r) IS NOT NULL), gs3 AS (SELECT day, bar FROM gs2 QUALIFY d < avg(d) OVER (PARTITION BY day)), gs4 AS (SELECT gs1.* FROM gs1 JOIN gs3 USING (day, bar)),
gs5 AS (SELECT a.day, a.address, b.address AS other, abs(covar_pop(a.turnover, b.turnover) / nullif(stddev_pop(a.turnover) * stddev_pop(b.turnover), 0e0)) AS c, count(*) AS n FROM gs4 a JOIN gs4 b ON a.day = b.day AND a.bar = b.bar AND a.address <> b.address GROUP BY ALL),
geese AS (SELECT address, day, avg(c) AS lone_goose FROM gs5 WHERE n >= 3 AND c IS NOT NULL GROUP BY address, day)"""
_PAIRS_SQL = "pairs AS (SELECT product_id || '.' || exchange AS address, day AS time, max(last_close) FILTER (place = 1) AS F1_close, max(last_close) FILTER (place = 2) AS F2_close, max(symbol) FILTER (place = 1) AS F1_symbol, max(symbol) FILTER (place = 2) AS F2_symbol FROM placed WHERE place <= 2 GROUP BY ALL HAVING count(*) = 2)"
_EXPIRY_SQL = """exp0 AS (SELECT *, make_date(2000 + F1_symbol[-4:-3]::INT, F1_symbol[-2:]::INT, 15) AS e1, make_date(2000 + F2_symbol[-4:-3]::INT, F2_symbol[-2:]::INT, 15) AS e2 FROM pairs),
expiries AS (SELECT address, time, greatest(date_diff('day', time, e1), 1)::INT AS days_to_expiry, greatest(abs(date_diff('day', e1, e2)), 1)::INT AS expiry_gap FROM exp0)"""



def _regression_sql(lags: int, what: str, name: str) -> str:
    """Normal equations by address and day, solved by the same steps."""
    k = lags + 1
    sums = ", ".join(f"sum(x{i} * x{j}) AS s0_{i}_{j}" for i in range(k + 1) for j in range(i, k + 1))
    rows = ", ".join(f"(lag(dv, {i}) OVER (PARTITION BY address, day ORDER BY datetime))::DOUBLE AS x{i}" for i in range(1, k))
    whole = " AND ".join(f"x{i} IS NOT NULL" for i in range(k + 1))
    return f"""{name}_x AS (SELECT address, day, ret AS x{k}, 1e0 AS x0, {rows} FROM minutes), {name}_s AS (SELECT address, day, {sums}, count(*)::DOUBLE AS n FROM {name}_x WHERE {whole} GROUP BY address, day),
    {_layers(f"{name}_s", tk.regression_layers(lags), f"{name}_l")}, {name} AS (SELECT address, day, {tk.regression_value(lags, what)} AS value, f_value FROM {name}_l)"""


_TREE_SQL = f"{_regression_sql(6, 'intercept_t', 'tree')}, trees AS (SELECT address, day, CASE WHEN f_value < avg(f_value) OVER (PARTITION BY day) THEN -value ELSE value END AS shading_tree FROM tree)"
_FOG_SQL = f"{_regression_sql(5, 't_std', 'fog')}, fogs AS (SELECT address, day, value AS morning_fog FROM fog)"

#: Columns of the daily panel by producer.
TICK_DAILY = ("open", "high", "low", "close", "volume", "twap", "vwap_dev", "twap_dev", "oi_change", "vol_skew", "vol_conc", "smart_money", "intraday_rsi", "buy_ratio", "dazzle_ret", "vol_ratio", "inflection_ratio", "large_order_ret", "vsp_position", "price_oi_corr", "jump_ratio", "cvar_5pct", "ret_vol_cov", "amb_vol_corr", "hurst", "flow_in_ratio", "tgd", "net_support_vol")
TICK_MORE = ("ret_skew", "tide_speed", "follow_crowd", "lone_goose", "shading_tree", "morning_fog", "f1_close", "f2_close", "days_to_expiry", "expiry_gap")


def tick_panel(spark: SparkSession, sf_dir: str, wanted: Iterable[str] = (*TICK_DAILY, *TICK_MORE, "spot")) -> DataFrame:
    """The dense daily panel of the main contracts with the wanted columns, each from its producer over the ticks.

    Only the producers of wanted columns run.  ``spot`` is the mean price.
    """
    wanted = [c for c in dict.fromkeys("twap" if c == "spot" else c for c in wanted)]
    t = fixtures.ticks(spark, sf_dir)
    columns = tk.daily_columns(t)
    out = columns.select("address", F.col("day").alias("time"), *[F.col(c).cast("double").alias(c) for c in wanted if c in TICK_DAILY])
    by_day = {"ret_skew": lambda: tk.ret_skew(t), "tide_speed": lambda: tk.tide_speed(t), "follow_crowd": lambda: tk.pair_mean(columns, "crowd").withColumnRenamed("value", "follow_crowd"), "lone_goose": lambda: tk.lone_goose(t, GOOSE), "shading_tree": lambda: tk.shading_tree(t), "morning_fog": lambda: tk.morning_fog(t)}
    for c in wanted:
        if c in by_day:
            out = out.join(by_day[c]().withColumnRenamed("day", "time"), ["address", "time"], "left")
    if {"f1_close", "f2_close", "days_to_expiry", "expiry_gap"} & set(wanted):
        pairs = pn.secondary_contracts(t)
        curve = pn.expiry_features(pairs).select("address", "time", F.col("F1_close").alias("f1_close"), F.col("F2_close").alias("f2_close"), F.col("days_to_expiry").cast("double").alias("days_to_expiry"), F.col("expiry_gap").cast("double").alias("expiry_gap"))
        out = out.join(curve, ["address", "time"], "left")
    dense = pn.densify(out, wanted)
    return dense.withColumn("spot", F.col("twap")) if "twap" in wanted else dense


TICK_PANEL_SQL = f"""{_DAILY_SQL}, {_SKEW_SQL}, {_TIDE_SQL}, {_CROWD_SQL}, {_GOOSE_SQL}, {_TREE_SQL}, {_FOG_SQL}, {_PAIRS_SQL}, {_EXPIRY_SQL},
tk_all AS (SELECT d.address, d.day AS time, {", ".join(f"d.{c}::DOUBLE AS {c}" for c in TICK_DAILY)}, ret_skew, tide_speed, follow_crowd, lone_goose, shading_tree, morning_fog, p.F1_close AS f1_close, p.F2_close AS f2_close, e.days_to_expiry::DOUBLE AS days_to_expiry, e.expiry_gap::DOUBLE AS expiry_gap FROM daily d
  LEFT JOIN skews s ON s.address = d.address AND s.day = d.day LEFT JOIN tides t ON t.address = d.address AND t.day = d.day LEFT JOIN crowds c ON c.address = d.address AND c.day = d.day LEFT JOIN geese g ON g.address = d.address AND g.day = d.day
  LEFT JOIN trees tr ON tr.address = d.address AND tr.day = d.day LEFT JOIN fogs fo ON fo.address = d.address AND fo.day = d.day
  LEFT JOIN pairs p ON p.address = d.address AND p.time = d.day LEFT JOIN expiries e ON e.address = d.address AND e.time = d.day),
tk_grid AS (SELECT address, time FROM (SELECT DISTINCT address FROM tk_all) CROSS JOIN (SELECT DISTINCT time FROM tk_all)),
panel AS (SELECT *, twap AS spot FROM (SELECT address, time, {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0e0) AS {c}" for c in (*TICK_DAILY, *TICK_MORE))} FROM tk_grid LEFT JOIN tk_all USING (address, time) WINDOW w AS (PARTITION BY address ORDER BY time ROWS UNBOUNDED PRECEDING)))"""

# member positions by week, and an indicator of orders as warehouse stock
_MEMBERS_SQL = """mem AS (SELECT address, time, l_suppkey AS member, sum(CASE l_returnflag WHEN 'A' THEN l_quantity ELSE 0e0 END) AS long_oi, sum(CASE l_returnflag WHEN 'R' THEN l_quantity ELSE 0e0 END) AS short_oi FROM priced GROUP BY ALL),
mem_t AS (SELECT *, sum(long_oi) OVER (PARTITION BY address, time) AS total FROM mem),
mem_all AS (SELECT address, time, sum(long_oi) - sum(short_oi) AS member_ls, CASE WHEN max(total) <= 0 OR count(*) <= 1 THEN 0e0 ELSE stddev_samp(long_oi / nullif(total, 0e0)) END AS long_conc_std, CASE WHEN sum(short_oi) <= 0 OR count(*) <= 1 THEN 0e0 ELSE sum(short_oi * short_oi) / nullif(sum(short_oi), 0e0) END AS short_weighted FROM mem_t GROUP BY address, time)"""
_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_STOCK_SQL = "edb AS (" + " UNION ALL ".join(f"SELECT 'A{k:02d}.X' AS address, date_trunc('week', o_orderdate)::DATE AS time, sum(o_totalprice) AS value FROM orders WHERE o_orderpriority = '{v}' GROUP BY 2" for k, v in enumerate(_LEVELS[:4])) + ")"
# a calendar of mean lunations: months of 29.530588 days from 31 January 1900 on, years of 365.2422
_LUNAR = {"l": "floor(e / 29.530588e0)", "y": "floor((e + 1) / 365.2422e0)"}
_CALENDAR_SQL = """cal0 AS (SELECT time, (date_diff('day', DATE '1900-01-31', time))::DOUBLE AS e FROM (SELECT DISTINCT time FROM edb)),
cal AS (SELECT time, floor((e + 1) / 365.2422e0)::INT AS lunar_year, (floor(e / 29.530588e0) - ceil(floor((e + 1) / 365.2422e0) * 365.2422e0 / 29.530588e0) + 1)::INT AS lunar_month, (floor(e - floor(e / 29.530588e0) * 29.530588e0) + 1)::INT AS lunar_day FROM cal0)"""
_YOY_SQL = f"""{_CALENDAR_SQL}, yd AS (SELECT e.address, e.time, e.value, c.lunar_year, c.lunar_month, c.lunar_day FROM edb e JOIN cal c USING (time) WHERE value > 0),
yp AS (SELECT address, lunar_year, lunar_month, lunar_day, arg_max(value, time) AS before FROM yd GROUP BY ALL),
yc AS (SELECT d.address, d.time, d.value, abs(p.lunar_day - d.lunar_day) AS away, p.before FROM yd d JOIN yp p ON p.address = d.address AND p.lunar_month = d.lunar_month AND d.lunar_year - p.lunar_year BETWEEN 1 AND 2 AND abs(p.lunar_day - d.lunar_day) <= 3),
yoys AS (SELECT address, time, max(value) / avg(before) - 1 AS inv_lunar_yoy FROM (SELECT *, min(away) OVER (PARTITION BY address, time) AS least FROM yc) WHERE away = least GROUP BY address, time)"""


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address, time, value): the weekly orders of four priorities as an indicator table, unpivoted."""
    wide = fixtures.table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("time")).agg(*[F.sum(F.when(F.col("o_orderpriority") == v, F.col("o_totalprice"))).alias(f"i{k}") for k, v in enumerate(_LEVELS)])
    return io.unpivot_edb(wide, {f"i{k}": f"A{k:02d}.X" for k in range(4)})


def calendar(times: DataFrame) -> DataFrame:
    """(time, lunar_year, lunar_month, lunar_day) of mean lunations, in place of a calendar table."""
    e = F.datediff("time", F.lit("1900-01-31").cast("date")).cast("double")
    moon, year = F.floor(e / 29.530588), F.floor((e + 1) / 365.2422)
    return times.select("time").distinct().select("time", year.cast("int").alias("lunar_year"), (moon - F.ceil(year * F.lit(365.2422) / 29.530588) + 1).cast("int").alias("lunar_month"), (F.floor(e - moon * F.lit(29.530588)) + 1).cast("int").alias("lunar_day"))


def member_panel(spark: SparkSession, sf_dir: str, wanted: Iterable[str] = ("member_ls", "long_conc_std", "short_weighted", "warehouse", "inv_lunar_yoy")) -> DataFrame:
    """The weekly panel with the wanted of member positions, stock and its lunar comparison joined as caches."""
    mem = io.member_interest(fixtures.table(spark, sf_dir, "lineitem"))
    value = lambda df, c: df.select("address", "time", F.col(c).alias("value"))
    kept = stock(spark, sf_dir)
    caches = {
        "member_ls": lambda: value(io.member_long_short(mem), "ls_raw"), "long_conc_std": lambda: value(io.member_concentration(mem), "long_conc_std"), "short_weighted": lambda: value(io.member_short_weighted(mem), "short_weighted"),
        "warehouse": lambda: kept, "inv_lunar_yoy": lambda: value(pn.inv_lunar_yoy(kept, calendar(kept)), "inv_lunar_yoy"),
    }
    return io.join_caches(fixtures.panel(spark, sf_dir), {c: caches[c]() for c in caches if c in set(wanted)})


_CACHES = ("member_ls", "long_conc_std", "short_weighted", "warehouse", "inv_lunar_yoy")
MEMBER_PANEL_SQL = f"""{fixtures.PANEL_SQL.replace("panel AS (", "plain AS (")}, {_MEMBERS_SQL}, {_STOCK_SQL}, {_YOY_SQL},
cached AS (SELECT p.*, m.member_ls AS q0, m.long_conc_std AS q1, m.short_weighted AS q2, e.value AS q3, y.inv_lunar_yoy AS q4 FROM plain p LEFT JOIN mem_all m USING (address, time) LEFT JOIN edb e USING (address, time) LEFT JOIN yoys y USING (address, time)),
panel AS (SELECT * EXCLUDE (q0, q1, q2, q3, q4), {", ".join(f"coalesce(last_value(q{i} IGNORE NULLS) OVER w, 0e0) AS {c}" for i, c in enumerate(_CACHES))} FROM cached WINDOW w AS (PARTITION BY address ORDER BY time ROWS UNBOUNDED PRECEDING))"""

#: Query name, columns of the daily table, digits.
COLUMNS = {
    "t1_vwap": (["vwap", "vwap_dev"], 6), "t2_oi_change": (["oi_change", "total_oi"], 6), "t3_vol_skew": (["am_volume", "pm_volume", "vol_skew"], 2), "t4_vol_conc": (["max_30min_vol", "vol_conc"], 6), "t5_smart_money": (["last_hour", "first_hour", "smart_money"], 1),
    "t6_twap": (["twap", "twap_dev"], 6), "t7_vsp_position": (["vsp_position"], 6), "t8_buy_ratio": (["buy_ratio"], 6), "t9_large_order_ret": (["large_order_ret"], 6), "t10_intraday_rsi": (["intraday_rsi"], 6), "t11_vol_ratio": (["vol_ratio"], 6), "t12_inflection_ratio": (["inflection_ratio"], 6), "t13_flow_in_ratio": (["flow_in_ratio"], 6),
    "h3_tgd": (["tgd"], 4), "h4_net_support_vol": (["net_support_vol"], 6), "h10_jump_ratio": (["jump_ratio"], 6), "h11_cvar_5pct": (["cvar_5pct"], 6), "h12_ret_vol_cov": (["ret_vol_cov"], 4), "h13_amb_vol_corr": (["amb_vol_corr"], 5), "h16_dazzle_ret": (["dazzle_ret"], 6), "h17_hurst": (["hurst"], 6), "h18_price_oi_corr": (["price_oi_corr"], 6),
}


def register(add: Callable, rounded: Callable) -> None:
    """Add the queries of this module."""
    ticks, table = fixtures.ticks, fixtures.table

    def daily(columns: list[str], digits: int) -> Callable:
        return lambda s, d: tk.daily_columns(ticks(s, d)).select("address", "day", *[rounded(F.col(c).cast("double"), digits).alias(c) for c in columns])

    for name, (columns, digits) in COLUMNS.items():
        add(name, daily(columns, digits), f"WITH {_DAILY_SQL} SELECT address, day, {', '.join(f'round({c}::DOUBLE, {digits}) + 0e0 AS {c}' for c in columns)} FROM daily")
    add("h1_tide_speed", lambda s, d: tk.tide_speed(ticks(s, d)).select("address", "day", rounded("tide_speed").alias("tide_speed")), f"WITH {_MINUTE_SQL}, {_TIDE_SQL} SELECT address, day, round(tide_speed, 6) + 0e0 AS tide_speed FROM tides")
    add("h2_shading_tree", lambda s, d: tk.shading_tree(ticks(s, d)).select("address", "day", rounded("shading_tree", 5).alias("shading_tree")), f"WITH {_MINUTE_SQL}, {_TREE_SQL} SELECT address, day, round(shading_tree, 5) + 0e0 AS shading_tree FROM trees")
    add("h5_ret_skew", lambda s, d: tk.ret_skew(ticks(s, d)).select("address", "day", rounded("ret_skew", 4).alias("ret_skew")), f"WITH {_MAIN_SQL}, {_SKEW_SQL} SELECT address, day, round(ret_skew, 4) + 0e0 AS ret_skew FROM skews")
    add("h6_inv_lunar_yoy", lambda s, d: pn.inv_lunar_yoy(stock(s, d), calendar(stock(s, d))).select("address", "time", rounded("inv_lunar_yoy").alias("inv_lunar_yoy")), f"WITH {_STOCK_SQL}, {_YOY_SQL} SELECT address, time, round(inv_lunar_yoy, 6) + 0e0 AS inv_lunar_yoy FROM yoys")
    add("h19_morning_fog", lambda s, d: tk.morning_fog(ticks(s, d)).select("address", "day", rounded("morning_fog", 5).alias("morning_fog")), f"WITH {_MINUTE_SQL}, {_FOG_SQL} SELECT address, day, round(morning_fog, 5) + 0e0 AS morning_fog FROM fogs")
    add("h14_follow_crowd", lambda s, d: tk.pair_mean(tk.daily_columns(ticks(s, d)), "crowd").select("address", "day", rounded("value").alias("follow_crowd")), f"WITH {_DAILY_SQL}, {_CROWD_SQL} SELECT address, day, round(follow_crowd, 6) + 0e0 AS follow_crowd FROM crowds")
    add("h15_lone_goose", lambda s, d: tk.lone_goose(ticks(s, d), GOOSE).select("address", "day", rounded("lone_goose", 5).alias("lone_goose")), f"WITH {_MAIN_SQL}, {_GOOSE_SQL} SELECT address, day, round(lone_goose, 5) + 0e0 AS lone_goose FROM geese")
    members = f"{fixtures.BARS_SQL}, mem AS (SELECT address, time, l_suppkey AS member, sum(CASE l_returnflag WHEN 'A' THEN l_quantity ELSE 0e0 END) AS long_oi, sum(CASE l_returnflag WHEN 'R' THEN l_quantity ELSE 0e0 END) AS short_oi FROM priced GROUP BY ALL)"
    mem = lambda s, d: io.member_interest(table(s, d, "lineitem"))
    add("h7_member_ls_raw", lambda s, d: io.member_long_short(mem(s, d)).select("address", "time", rounded("ls_raw").alias("ls_raw")), f"WITH {members} SELECT address, time, round(sum(long_oi) - sum(short_oi), 6) + 0e0 AS ls_raw FROM mem GROUP BY address, time")
    add("h8_long_conc_std", lambda s, d: io.member_concentration(mem(s, d)).select("address", "time", rounded("long_conc_std").alias("long_conc_std")), f"WITH {members}, t AS (SELECT *, sum(long_oi) OVER (PARTITION BY address, time) AS total FROM mem) SELECT address, time, round(CASE WHEN max(total) <= 0 OR count(*) <= 1 THEN 0e0 ELSE stddev_samp(long_oi / nullif(total, 0e0)) END, 6) + 0e0 AS long_conc_std FROM t GROUP BY address, time")
    add("h9_short_weighted", lambda s, d: io.member_short_weighted(mem(s, d)).select("address", "time", rounded("short_weighted").alias("short_weighted")), f"WITH {members} SELECT address, time, round(CASE WHEN sum(short_oi) <= 0 OR count(*) <= 1 THEN 0e0 ELSE sum(short_oi * short_oi) / nullif(sum(short_oi), 0e0) END, 6) + 0e0 AS short_weighted FROM mem GROUP BY address, time")

    add("p1_densify", lambda s, d: pn.densify(fixtures.bars(s, d), ["close", "volume"]).select("address", "time", rounded("close", 8).alias("close"), rounded("volume", 4).alias("volume")), f"WITH {fixtures.PANEL_SQL} SELECT address, time, round(close, 8) + 0e0 AS close, round(volume, 4) + 0e0 AS volume FROM dense")
    add("p2_main_contract", lambda s, d: pn.main_contract(ticks(s, d)).select("product_id", "exchange", "day", "symbol", rounded("avg_oi").alias("avg_oi")), f"WITH {_MAIN_SQL} SELECT product_id, exchange, day, symbol, round(avg_oi, 6) + 0e0 AS avg_oi FROM placed WHERE place = 1")
    pairs = f"{_MAIN_SQL}, {_PAIRS_SQL}"
    add("p3_secondary_contracts", lambda s, d: pn.secondary_contracts(ticks(s, d)).withColumns({"F1_close": rounded("F1_close"), "F2_close": rounded("F2_close")}), f"WITH {pairs} SELECT * REPLACE (round(F1_close, 6) + 0e0 AS F1_close, round(F2_close, 6) + 0e0 AS F2_close) FROM pairs")
    add(
        "p4_expiry_features", lambda s, d: pn.expiry_features(pn.secondary_contracts(ticks(s, d))).select("address", "time", "days_to_expiry", "expiry_gap"),
        f"""WITH {pairs}, e AS (SELECT *, make_date(2000 + F1_symbol[-4:-3]::INT, F1_symbol[-2:]::INT, 15) AS e1, make_date(2000 + F2_symbol[-4:-3]::INT, F2_symbol[-2:]::INT, 15) AS e2 FROM pairs)
        SELECT address, time, greatest(date_diff('day', time, e1), 1)::INT AS days_to_expiry, greatest(abs(date_diff('day', e1, e2)), 1)::INT AS expiry_gap FROM e""",
    )
    for minutes in (15, 60, 240):
        add(
            f"p5_ohlcv_{minutes}m", lambda s, d, k=minutes: pn.resample(pn.main_ticks(ticks(s, d)), k).select("address", "time", *[rounded(c, 9).alias(c) for c in ("open", "high", "low", "close")], "volume", rounded("liquidity", 7).alias("liquidity")),
            f"WITH {_MAIN_SQL} SELECT address, time_bucket(INTERVAL '{minutes} minutes', datetime) AS time, round(arg_min(open, datetime), 9) + 0e0 AS open, round(max(high), 9) + 0e0 AS high, round(min(low), 9) + 0e0 AS low, round(arg_max(close, datetime), 9) + 0e0 AS close, sum(volume)::BIGINT AS volume, round(sum(volume) * arg_max(close, datetime), 7) + 0e0 AS liquidity FROM main GROUP BY ALL",
        )
    add("p6_limit_by_row_count", lambda s, d: pn.limit_by_row_count(fixtures.bars(s, d), 5).groupBy("address").agg(F.count(F.lit(1)).alias("n")), f"WITH {fixtures.BARS_SQL} SELECT address, count(*) AS n FROM bars GROUP BY address ORDER BY n DESC, address LIMIT 5")
    add("p7_target_return", lambda s, d: pn.target_return(fixtures.panel(s, d)).select("address", "time", rounded("target_ret").alias("target_ret")), f"WITH {fixtures.PANEL_SQL} SELECT address, time, round(greatest(-0.2e0, least(0.2e0, coalesce((lead(close) OVER w - close) / (close + 1e-9), 0e0))), 6) + 0e0 AS target_ret FROM panel WINDOW w AS (PARTITION BY address ORDER BY time)")
    add("p8_rebalance_mask", lambda s, d: pn.rebalance_mask(fixtures.panel(s, d), "month").select("address", "time", "is_rebalance"), f"WITH {fixtures.PANEL_SQL} SELECT address, time, time = min(time) OVER (PARTITION BY date_trunc('month', time)) AS is_rebalance FROM panel")
    add("p9_train_test_split", lambda s, d: pn.train_test_split(fixtures.panel(s, d), 0.7).select("address", "time", "split"), f"WITH {fixtures.PANEL_SQL}, t AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM panel)) SELECT address, time, CASE WHEN t < floor(n * 0.7e0) THEN 'train' ELSE 'test' END AS split FROM panel JOIN t USING (time)")
    add("p11_simple_returns", lambda s, d: pn.simple_returns(fixtures.panel(s, d)).select("address", "time", rounded("ret").alias("ret")), f"WITH {fixtures.PANEL_SQL} SELECT address, time, round(greatest(-0.2e0, least(0.2e0, coalesce((close - lag(close) OVER w) / (abs(lag(close) OVER w) + 1e-10), 0e0))), 6) + 0e0 AS ret FROM panel WINDOW w AS (PARTITION BY address ORDER BY time)")
    add("p12_open_to_open_return", lambda s, d: pn.open_to_open_return(fixtures.panel(s, d)).select("address", "time", rounded("oto_ret").alias("oto_ret")), f"WITH {fixtures.PANEL_SQL} SELECT address, time, round(coalesce((lead(open, 2) OVER w - lead(open, 1) OVER w) / (lead(open, 1) OVER w + 1e-6), 0e0), 6) + 0e0 AS oto_ret FROM panel WINDOW w AS (PARTITION BY address ORDER BY time)")

    # sources
    def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Half of the ticks, then all of them, into one folder: the second append adds what is later."""
        path, all_ = io.new_folder(spark, "ticks"), ticks(spark, sf_dir)
        io.append_ticks(spark, all_.where("datetime < '2024-01-16'"), path)
        io.append_ticks(spark, all_, path)
        return io.read_ticks(spark, path).select("symbol", "datetime", rounded("close").alias("close"), "volume", F.col("day").cast("date").alias("day"))

    def written(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Bars as JSON, and read back."""
        path = io.new_folder(spark, "results")
        rows = fixtures.bars(spark, sf_dir).select("address", "time", rounded("close", 8).alias("close"))
        io.write_results(rows, path)
        return spark.read.schema(rows.schema).json(path)

    add("io3_join_caches", lambda s, d: member_panel(s, d).select("address", "time", *[rounded(c, 5).alias(c) for c in _CACHES]), f"WITH {MEMBER_PANEL_SQL} SELECT address, time, {', '.join(f'round({c}, 5) + 0e0 AS {c}' for c in _CACHES)} FROM panel")
    add("io5_append_ticks", appended, f"WITH {fixtures.TICKS_SQL} SELECT symbol, datetime, round(close, 6) + 0e0 AS close, volume, datetime::DATE AS day FROM ticks")
    add("io15_write_results", written, f"WITH {fixtures.BARS_SQL} SELECT address, time, round(close, 8) + 0e0 AS close FROM bars")
    add("io1_read_ticks", lambda s, d: io.select_ticks(ticks(s, d), products=["click", "view"], start="2024-01-05", end="2024-01-20").select("symbol", "datetime", rounded("close").alias("close"), "volume"), f"WITH {fixtures.TICKS_SQL} SELECT symbol, datetime, round(close, 6) + 0e0 AS close, volume FROM ticks WHERE product_id IN ('click', 'view') AND datetime >= TIMESTAMP '2024-01-05' AND datetime < TIMESTAMP '2024-01-20'")
    add("io2_read_bars", lambda s, d: io.bars_of_known(fixtures.bars(s, d), fixtures.bars(s, d).groupBy("address").agg(F.sum("volume").alias("v")).where("v > 1000").select("address")).select("address", "time", rounded("close", 8).alias("close")), f"WITH {fixtures.BARS_SQL} SELECT address, time, round(close, 8) + 0e0 AS close FROM bars WHERE address IN (SELECT address FROM bars GROUP BY address HAVING sum(volume) > 1000)")
    add("io4_list_products", lambda s, d: io.list_products(ticks(s, d), 3), f"WITH {fixtures.TICKS_SQL} SELECT product_id, exchange, count(*) AS n FROM ticks GROUP BY ALL ORDER BY n DESC, product_id LIMIT 3")
    add("io6_upsert_instruments", lambda s, d: io.upsert_instruments(table(s, d, "supplier").select(F.col("s_suppkey").alias("address"), F.col("s_name").alias("symbol"), F.lit(None).cast("string").alias("last_updated"), F.col("s_nationkey").alias("chain")), table(s, d, "customer").select(F.col("c_custkey").alias("address"), F.col("c_name").alias("symbol"), F.lit("now").alias("last_updated"), F.col("c_nationkey").alias("chain"))), "SELECT coalesce(c_custkey, s_suppkey) AS address, coalesce(c_name, s_name) AS symbol, CASE WHEN c_custkey IS NOT NULL THEN 'now' END AS last_updated, coalesce(s_nationkey, c_nationkey) AS chain FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
    add("io7_append_bars", lambda s, d: io.new_rows(fixtures.bars(s, d).where("time < '1999-01-01'"), fixtures.bars(s, d).unionByName(fixtures.bars(s, d)), ["address", "time"]).select("address", "time", rounded("close", 8).alias("close")), f"WITH {fixtures.BARS_SQL} SELECT address, time, round(close, 8) + 0e0 AS close FROM bars WHERE time >= DATE '1999-01-01'")
    add("io8_merge_cache", lambda s, d: io.merge_cache(fixtures.bars(s, d).select("address", "time", F.col("open").alias("value")), fixtures.bars(s, d).where("month(time) = 3").select("address", "time", F.col("close").alias("value"))).select("address", "time", rounded("value", 8).alias("value")), f"WITH {fixtures.BARS_SQL} SELECT address, time, round(CASE WHEN month(time) = 3 THEN close ELSE open END, 8) + 0e0 AS value FROM bars")
    add("io9_universe_filter", lambda s, d: io.universe_filter(fixtures.bars(s, d), min_liquidity=50000.0).select("address", "time", rounded("liquidity", 6).alias("liquidity")), f"WITH {fixtures.BARS_SQL} SELECT address, time, round(liquidity, 6) + 0e0 AS liquidity FROM bars WHERE liquidity >= 50000")
    edb = "SELECT date_trunc('week', o_orderdate)::DATE AS time, {} FROM orders GROUP BY 1"
    levels = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    add("io10_unpivot_edb", lambda s, d: io.unpivot_edb(table(s, d, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("time")).agg(*[F.sum(F.when(F.col("o_orderpriority") == v, F.col("o_totalprice"))).alias(f"i{k}") for k, v in enumerate(levels)]), {f"i{k}": f"A{k:02d}.X" for k in range(4)}).select("address", "time", rounded("value", 2).alias("value")), f"WITH w AS ({edb.format(', '.join(f"sum(o_totalprice) FILTER (o_orderpriority = '{v}') AS i{k}" for k, v in enumerate(levels)))}) " + " UNION ALL ".join(f"SELECT 'A{k:02d}.X' AS address, time, round(i{k}, 2) + 0e0 AS value FROM w WHERE i{k} IS NOT NULL" for k in range(4)))
    add("io11_index_constituents", lambda s, d: io.index_constituents(table(s, d, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("trade_date")), table(s, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("market_value")), 20).select("code", rounded("market_value", 2).alias("market_value")), "SELECT code, round(max(v), 2) + 0e0 AS market_value FROM (SELECT DISTINCT o_custkey AS code FROM orders WHERE o_orderdate::DATE = (SELECT max(o_orderdate)::DATE FROM orders)) JOIN (SELECT c_custkey AS code, c_acctbal * 10000 AS v FROM customer) USING (code) GROUP BY code ORDER BY market_value DESC, code LIMIT 20")
    add("io12_best_pair_per_token", lambda s, d: io.best_pair(table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("token"), F.col("l_suppkey").alias("pair")).agg(F.sum("l_extendedprice").alias("liquidity"))).select("token", "pair", rounded("liquidity", 2).alias("liquidity")), "WITH p AS (SELECT l_partkey AS token, l_suppkey AS pair, round(sum(l_extendedprice), 4) AS liquidity FROM lineitem GROUP BY ALL) SELECT token, arg_max(pair, (liquidity, -pair)) AS pair, round(max(liquidity), 2) + 0e0 AS liquidity FROM p GROUP BY token")
    add("io13_normalize_daily", lambda s, d: io.normalize_daily(table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date"), F.col("o_custkey").alias("vol"), F.col("o_totalprice").alias("amount"))).select("o_orderkey", "time", "volume", rounded("amount", 2).alias("amount")), "SELECT o_orderkey, o_orderdate::DATE AS time, o_custkey * 100 AS volume, round(o_totalprice * 1000, 2) + 0e0 AS amount FROM orders")
    add("io14_market_overview", lambda s, d: io.market_overview(fixtures.bars(s, d), 10).select("address", "time", rounded("liquidity", 6).alias("liquidity")), f"WITH {fixtures.BARS_SQL} SELECT address, time, round(liquidity, 6) + 0e0 AS liquidity FROM bars WHERE time = (SELECT max(time) FROM bars) ORDER BY liquidity DESC, address LIMIT 10")
    add("io16_dedup_clean_bars", lambda s, d: io.clean_bars(fixtures.bars(s, d).withColumn("batch", F.lit(1)).unionByName(fixtures.bars(s, d).withColumn("batch", F.lit(2)).withColumn("open", F.lit(None).cast("double")))).select("address", "time", rounded("open", 8).alias("open"), rounded("close", 8).alias("close")), f"WITH {fixtures.BARS_SQL} SELECT address, time, round(close, 8) + 0e0 AS open, round(close, 8) + 0e0 AS close FROM bars WHERE close > 1e-15")
    add(
        "io17_add_basic_factors", lambda s, d: io.basic_factors(fixtures.panel(s, d)).select("address", "time", *[rounded(c, 5).alias(c) for c in ("log_ret", "volatility", "vol_shock", "trend")]),
        f"""WITH {fixtures.PANEL_SQL}, a AS (SELECT *, row_number() OVER w AS i, coalesce(ln(close / nullif(lag(close) OVER w, 0e0)), 0e0) AS log_ret FROM panel WHERE close > 0 WINDOW w AS (PARTITION BY address ORDER BY time))
        SELECT address, time, round(log_ret, 5) + 0e0 AS log_ret, round(CASE WHEN i >= 20 THEN stddev_samp(log_ret) OVER k ELSE 0e0 END, 5) + 0e0 AS volatility, round(CASE WHEN i >= 20 THEN volume / (avg(volume) OVER k + 1e-9) ELSE 0e0 END, 5) + 0e0 AS vol_shock,
          CASE WHEN i < 60 THEN 0e0 WHEN close > avg(close) OVER l THEN 1e0 ELSE -1e0 END AS trend FROM a WINDOW k AS (PARTITION BY address ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), l AS (PARTITION BY address ORDER BY time ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    )
