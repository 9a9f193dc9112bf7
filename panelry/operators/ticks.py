"""Daily columns from minute ticks of the main contracts.

All columns of a day are computed in one pass: every window is partitioned by address and day (or by
more), so one shuffle by (address, day) serves the windows and the aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import mean_with_others
from .panel import main_ticks

_DAY = "PARTITION BY address, day ORDER BY datetime"
_ALL = "OVER (PARTITION BY address, day)"

#: Layers of per-minute columns (text that Spark and DuckDB both read).
MINUTE: list[dict[str, str]] = [
    {"i": f"row_number() OVER ({_DAY})", "n": f"count(close) {_ALL}", "dc": f"close - lag(close) OVER ({_DAY})", "ret": f"close / nullif(lag(close) OVER ({_DAY}), 0e0) - 1", "dv": f"volume - lag(volume) OVER ({_DAY})",
     "vol30": "sum(volume) OVER (PARTITION BY address, day, hour(datetime) * 2 + CASE WHEN minute(datetime) >= 30 THEN 1 ELSE 0 END)", "level": "sum(volume) OVER (PARTITION BY address, day, close)", "p90": f"P90_OF(volume) {_ALL}",
     "day_mean": f"avg(close) {_ALL}", "day_open": f"first_value(open) OVER ({_DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
    {"move": f"dc * lag(dc) OVER ({_DAY})", "aret": f"abs(ret) * abs(lag(ret) OVER ({_DAY}))", "dev_sum": f"sum(close - day_mean) OVER ({_DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "dv_mean": f"avg(dv) {_ALL}", "dv_std": f"stddev_samp(dv) {_ALL}",
     "s4": f"sum(open + high + low + close) OVER ({_DAY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "q4": f"sum(open * open + high * high + low * low + close * close) OVER ({_DAY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "c4": f"4 * count(close) OVER ({_DAY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
     "rsd": f"stddev_pop(ret) OVER ({_DAY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"},
    {"best_vol": "sqrt(greatest(0e0, q4 / c4 - (s4 / c4) * (s4 / c4))) / (s4 / c4)", "vov": f"stddev_pop(rsd) OVER ({_DAY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"},
    {"ratio": "ret / (best_vol + 1e-9)"},
]

#: Daily aggregates by column name; ``CORR_OF`` is a correlation that is null where a side is constant.
DAILY: dict[str, str] = {
    "open": "min_by(open, datetime)", "close": "max_by(close, datetime)", "volume": "sum(volume)",
    "vwap": "sum(volume * close) / nullif(sum(volume), 0)", "twap": "avg(close)",
    "oi_change": "max_by(close_oi, datetime) - min_by(close_oi, datetime)", "total_oi": "max_by(close_oi, datetime)",
    "am_volume": "sum(CASE WHEN hour(datetime) < 13 THEN volume ELSE 0 END)", "pm_volume": "sum(CASE WHEN hour(datetime) >= 13 THEN volume ELSE 0 END)",
    "max_30min_vol": "max(vol30)", "last_hour": "sum(CASE WHEN hour(datetime) >= 14 THEN volume ELSE 0 END)", "first_hour": "sum(CASE WHEN hour(datetime) < 10 THEN volume ELSE 0 END)",
    "vsp": "max_by(close, level * 1e6 - close)", "low": "min(low)", "high": "max(high)",
    "buy_ratio": "avg(CASE WHEN close > open THEN 1e0 ELSE 0e0 END)",
    "large_order_ret": "avg(CASE WHEN volume >= p90 THEN ln(close / open) END)",
    "intraday_rsi": "sum(CASE WHEN dc > 0 THEN dc ELSE 0e0 END) / nullif(sum(abs(dc)), 0e0) * 100",
    "vol_ratio": "sum(CASE WHEN close > open THEN volume ELSE 0 END) * 1e0 / nullif(sum(CASE WHEN close <= open THEN volume ELSE 0 END), 0)",
    "inflection_ratio": "avg(CASE WHEN move IS NULL THEN NULL WHEN move < 0 THEN 1e0 ELSE 0e0 END)",
    "flow_in_ratio": "sum(CASE WHEN dc IS NULL THEN NULL ELSE volume * close * sign(dc) END) / nullif(sum(CASE WHEN dc IS NULL THEN NULL ELSE volume * close END), 0)",
    "net_support_vol": "(sum(CASE WHEN close < day_mean THEN volume ELSE 0 END) - sum(CASE WHEN close > day_mean THEN volume ELSE 0 END)) * 1e0 / nullif(sum(volume), 0)",
    "rv": "sum(ret * ret)", "bv": "1.5707963267948966e0 * sum(aret)", "weighted_ret": "sum(ret * volume) / nullif(sum(volume), 0)",
    "ret_vol_cov": "covar_samp(ratio, volume)", "amb_vol_corr": "CORR_OF(vov, volume)", "price_oi_corr": "CORR_OF(close, close_oi)",
    "dazzle_ret": "avg(CASE WHEN dv > dv_mean + dv_std THEN ret END)", "range_sum": "max(dev_sum) - min(dev_sum)", "close_std": "stddev_pop(close)",
    "n_up": "count(CASE WHEN ret > 0 THEN 1 END)", "n_down": "count(CASE WHEN ret < 0 THEN 1 END)", "n": "count(close)",
    "g_up": "sum(CASE WHEN ret > 0 THEN ret * (i - 1) END) / nullif(sum(CASE WHEN ret > 0 THEN ret END), 0e0)", "g_down": "sum(CASE WHEN ret < 0 THEN -ret * (i - 1) END) / nullif(sum(CASE WHEN ret < 0 THEN -ret END), 0e0)",
    "high_turnover": "sum(CASE WHEN close > day_open THEN volume * close ELSE 0e0 END)", "low_turnover": "sum(CASE WHEN close < day_open THEN volume * close ELSE 0e0 END)", "turnover": "sum(volume * close)",
}

_PAST20 = "OVER (PARTITION BY address ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
#: Layers of daily columns made of daily columns.
DERIVED: list[dict[str, str]] = [
    {
        "vwap_dev": "(vwap - close) / (close + 1e-9)", "twap_dev": "(twap - close) / (close + 1e-9)", "vol_skew": "am_volume / (pm_volume + 1e-9)", "vol_conc": "max_30min_vol / (volume + 1e-9)", "smart_money": "last_hour / (first_hour + 1e-9)",
        "vsp_position": "(vsp - low) / nullif(high - low, 0e0)", "jump_ratio": "1 - bv / nullif(rv, 0e0)", "hurst": "range_sum / nullif(close_std, 0e0)", "crowd": "(high_turnover - low_turnover) / nullif(turnover, 0e0)",
        "gu": "CASE WHEN n >= 10 AND n_up >= 3 AND n_down >= 3 THEN g_up END", "gd": "CASE WHEN n >= 10 AND n_up >= 3 AND n_down >= 3 THEN g_down END",
    },
    {
        "gn": "count(gd) OVER (PARTITION BY day)", "gmu": "avg(CASE WHEN gd IS NOT NULL THEN gu END) OVER (PARTITION BY day)", "gmd": "avg(gd) OVER (PARTITION BY day)", "gcov": "covar_pop(gd, gu) OVER (PARTITION BY day)", "gvar": "var_pop(gu) OVER (PARTITION BY day)",
    },
    {
        "tgd": "CASE WHEN gn < 5 THEN gd - gu ELSE gd - gmd - coalesce(gcov / nullif(gvar, 0e0), 0e0) * (gu - gmu) END",
        "cvar_5pct": f"P05_OF(weighted_ret) {_PAST20}",
    },
]


def spark_form(x: str) -> str:
    import re

    x = re.sub(r"P90_OF\((\w+)\)", r"percentile(\1, 0.9)", x)
    x = re.sub(r"P05_OF\((\w+)\)", r"percentile(\1, 0.05)", x)
    return re.sub(r"CORR_OF\((\w+), (\w+)\)", r"try_divide(covar_pop(\1, \2), stddev_pop(CASE WHEN \2 IS NOT NULL THEN \1 END) * stddev_pop(CASE WHEN \1 IS NOT NULL THEN \2 END))", x)


def duck_form(x: str) -> str:
    import re

    x = re.sub(r"P90_OF\((\w+)\)", r"quantile_cont(\1, 0.9)", x)
    x = re.sub(r"P05_OF\((\w+)\)", r"quantile_cont(\1, 0.05)", x)
    x = re.sub(r"CORR_OF\((\w+), (\w+)\)", r"(covar_pop(\1, \2) / nullif(stddev_pop(CASE WHEN \2 IS NOT NULL THEN \1 END) * stddev_pop(CASE WHEN \1 IS NOT NULL THEN \2 END), 0e0))", x)
    return x.replace("max_by(", "arg_max(").replace("min_by(", "arg_min(")


def minute_columns(ticks: DataFrame) -> DataFrame:
    """Main-contract ticks with the per-minute columns."""
    out = main_ticks(ticks)
    for layer in MINUTE:
        out = out.withColumns({c: F.expr(spark_form(x)) for c, x in layer.items()})
    return out


def daily_columns(ticks: DataFrame) -> DataFrame:
    """One row per address and day with all daily columns."""
    out = minute_columns(ticks).groupBy("address", "day").agg(*[F.expr(spark_form(x)).alias(c) for c, x in DAILY.items()])
    for layer in DERIVED:
        out = out.withColumns({c: F.expr(spark_form(x)) for c, x in layer.items()})
    return out


def ret_skew(ticks: DataFrame, rows: int = 20, minutes: int = 5) -> DataFrame:
    """Population skewness of the last ``rows`` days' returns of ``minutes``-minute bars, by address and day.

    Returns stay inside a day; ten of them are needed, and some spread.  Each day adds its power sums, so
    the pooled moments are sums over a window of days.
    """
    bar = F.window("datetime", f"{minutes} minutes").getField("start")
    bars = main_ticks(ticks).groupBy("address", "day", bar.alias("bar")).agg(F.max_by("close", "datetime").alias("close"))
    before = F.lag("close").over(Window.partitionBy("address", "day").orderBy("bar"))
    rets = bars.withColumn("r", F.try_divide(F.col("close"), before) - 1).where("r IS NOT NULL")
    day = rets.groupBy("address", "day").agg(F.count("r").alias("n"), *[F.sum(F.pow("r", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3)])
    past = Window.partitionBy("address").orderBy("day").rowsBetween(-(rows - 1), 0)
    pooled = day.select("address", "day", *[F.sum(c).over(past).alias(c) for c in ("n", "s1", "s2", "s3")])
    mu = F.col("s1") / F.col("n")
    var = F.col("s2") / F.col("n") - mu * mu
    skew = (F.col("s3") / F.col("n") - 3 * mu * var - mu * mu * mu) / F.pow(var, F.lit(1.5))
    return pooled.where(F.col("n") >= 10).where(var > 1e-24).select("address", "day", skew.alias("ret_skew"))


def lone_goose(ticks: DataFrame, minutes: int = 1) -> DataFrame:
    """Mean absolute correlation of an address's turnover with every other's, over the calm bars of a day.

    A bar is calm if the deviation of its returns over addresses is under the day's mean deviation.
    """
    bar = F.window("datetime", f"{minutes} minutes").getField("start")
    bars = main_ticks(ticks).groupBy("address", "day", bar.alias("bar")).agg(F.max_by("close", "datetime").alias("close"), F.sum(F.col("volume") * F.col("close")).alias("turnover"))
    before = F.lag("close").over(Window.partitionBy("address", "day").orderBy("bar"))
    bars = bars.withColumn("r", F.try_divide(F.col("close"), before) - 1)
    spread = bars.groupBy("day", "bar").agg(F.stddev_samp("r").alias("d")).where("d IS NOT NULL")
    calm = spread.withColumn("m", F.avg("d").over(Window.partitionBy("day"))).where("d < m").select("day", "bar")
    rows = bars.join(calm, ["day", "bar"]).groupBy("day", F.col("address").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("bar").cast("timestamp")).alias("at"), F.col("turnover").cast("double").alias("v")))).alias("r"))
    out = mean_with_others(rows.select("day", "id", F.col("r.at").alias("at"), F.col("r.v").alias("v")), ["day"])
    return out.select(F.col("id").alias("address"), "day", F.col("value").alias("lone_goose"))


def tide_speed(ticks: DataFrame) -> DataFrame:
    """Speed of the volume tide of a day: from the trough before the peak to the trough after it.

    A nine-bar centred volume sum finds the peak bar; the troughs are the smallest sums before it (from
    bar 5 on) and after it; the speed is the price change between them, relative, per bar.
    """
    m = minute_columns(ticks).withColumn("tide", F.expr("sum(volume) OVER (PARTITION BY address, day ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"))
    m = m.withColumn("peak", F.expr("max_by(i, struct(tide, -i)) OVER (PARTITION BY address, day)"))
    low = lambda when: F.min_by(F.struct("i", "close"), F.when(F.expr(when), F.struct("tide", "i")))
    by = m.groupBy("address", "day").agg(low("i < peak AND i >= 5").alias("m"), low("i > peak").alias("n"))
    return by.select("address", "day", F.expr("(n.close - m.close) / nullif(m.close, 0e0) / (n.i - m.i)").alias("tide_speed"))


def regression_layers(lags: int) -> list[dict[str, str]]:
    """Layers that solve the normal equations of returns on a constant (place 0) and ``lags`` columns, one row each.

    ``s0_i_j`` are the sums of products, the return in the last place, and n the rows.  Sweeping the places one after another
    leaves the slopes, the inverse with its sign turned, and the squared residuals.  A place that depends on those before has no pivot,
    and all becomes null, as it does where rows are too few.  The layers end with t0, t1, ... and f_value.
    """
    k = lags + 1
    a = lambda level, i, j: f"s{level}_{min(i, j)}_{max(i, j)}"
    out: list[dict[str, str]] = []
    for p in range(k):
        out.append({f"d{p}": f"CASE WHEN n > {k + 1} AND {a(p, p, p)} > 1e-10 * {a(0, p, p)} THEN {a(p, p, p)} END"})
        layer = {}
        for i in range(k + 1):
            for j in range(i, k + 1):
                if i == p == j:
                    layer[a(p + 1, i, j)] = f"-1e0 / d{p}"
                elif p in (i, j):
                    layer[a(p + 1, i, j)] = f"{a(p, i, j)} / d{p}"
                else:
                    layer[a(p + 1, i, j)] = f"{a(p, i, j)} - {a(p, i, p)} * {a(p, p, j)} / d{p}"
        out.append(layer)
    out.append({"rss": f"CASE WHEN {a(k, k, k)} IS NOT NULL THEN greatest({a(k, k, k)}, 0e0) END", "tss": f"{a(0, k, k)} - {a(0, 0, k)} * {a(0, 0, k)} / n"})
    tests = {f"t{i}": f"CASE WHEN rss IS NOT NULL THEN {a(k, i, k)} / sqrt(greatest(-{a(k, i, i)} * rss / (n - {k}), 1e-300)) END" for i in range(k)}
    out.append(tests | {"f_value": f"((tss - rss) / {lags}) / (rss / nullif(n - {k}, 0) + 1e-300)"})
    return out


def regression_value(lags: int, what: str) -> str:
    """What a regression is read for: the constant's t value, or the deviation of the slopes' t values."""
    if what == "intercept_t":
        return "abs(t0)"
    total, squares = " + ".join(f"t{i}" for i in range(1, lags + 1)), " + ".join(f"t{i} * t{i}" for i in range(1, lags + 1))
    return f"CASE WHEN rss IS NOT NULL THEN sqrt(greatest(0e0, ({squares} - ({total}) * ({total}) / {lags}) / {lags - 1})) END"


def lag_regression(ticks: DataFrame, lags: int, what: str) -> DataFrame:
    """(address, day, value, f_value): per day, least squares of returns on ``lags`` volume differences and a constant.

    Spark sums the normal equations by address and day and solves them in place.  ``what``: "intercept_t" gives the absolute t
    value of the constant; "t_std" the deviation of the slopes' t values.  Days with too few bars, or a singular
    matrix, give null.
    """
    m = minute_columns(ticks)
    m = m.select("address", "day", F.col("ret").alias(f"x{lags + 1}"), F.lit(1.0).alias("x0"), *[F.expr(f"cast(lag(dv, {k}) OVER (PARTITION BY address, day ORDER BY datetime) AS double)").alias(f"x{k}") for k in range(1, lags + 1)])
    m = m.where(" AND ".join(f"x{k} IS NOT NULL" for k in range(lags + 2)))
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s0_{i}_{j}") for i in range(lags + 2) for j in range(i, lags + 2)]
    out = m.groupBy("address", "day").agg(*sums, F.count(F.lit(1)).cast("double").alias("n"))
    for layer in regression_layers(lags):
        out = out.withColumns({c: F.expr(x) for c, x in layer.items()})
    return out.select("address", "day", F.expr(regression_value(lags, what)).alias("value"), "f_value")


def shading_tree(ticks: DataFrame) -> DataFrame:
    """Absolute t value of the constant (six lags); negative on days whose F is under the day's mean F."""
    fit = lag_regression(ticks, 6, "intercept_t")
    low = F.col("f_value") < F.avg("f_value").over(Window.partitionBy("day"))
    return fit.select("address", "day", F.when(low, -F.col("value")).otherwise(F.col("value")).alias("shading_tree"))


def morning_fog(ticks: DataFrame) -> DataFrame:
    """Deviation of the t values of five lags."""
    return lag_regression(ticks, 5, "t_std").select("address", "day", F.col("value").alias("morning_fog"))


def pair_mean(daily: DataFrame, column: str, rows: int = 20, ranked: bool = True) -> DataFrame:
    """Mean absolute correlation of an address's last ``rows`` values with every other address's, by day.

    Of two addresses the days that both have are compared, by rank among these days where ``ranked``.
    """
    w = f"OVER (PARTITION BY address ORDER BY day ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    d = daily.where(f"{column} IS NOT NULL").select("day", F.col("address").alias("id"), F.expr(f"collect_list(cast(unix_date(day) AS long)) {w}").alias("at"), F.expr(f"collect_list(cast({column} AS double)) {w}").alias("v"))
    return mean_with_others(d, ["day"], ranked).select(F.col("id").alias("address"), "day", "value")
