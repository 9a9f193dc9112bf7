"""Queries of ensembles, regimes, signals, risk rules and replays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import ensemble as en
from ..operators import formula as fm
from ..operators import panel as pn
from ..operators import risk as rk
from ..oracle import text as sql
from ..sources import fixtures, io
from .scoring import CANDIDATES, DIGITS, KEYS, WEEKLY, features, held, leaderboard, marked, portfolio, run_formulas, signals

_WEIGHTS = {"fa": 0.5, "fb": 0.3, "fc": 0.2}
#: The formulas in use.
KEYS_IN_USE = tuple(_WEIGHTS)
_WEIGHTS_SQL = f"weights AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}e0)" for k, v in _WEIGHTS.items())}) AS t(formula_id, weight))"
_MEAN_SQL = "mixed AS (SELECT address, time, sum(weight * signal) / sum(weight) AS signal FROM runs JOIN weights USING (formula_id) GROUP BY address, time)"


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_WEIGHTS.items()), "formula_id string, weight double")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.simple_returns(fixtures.panel(spark, sf_dir)).select("address", "time", "ret")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address, sector) of every supplier: the region of its nation, ``other`` where there is none."""
    nation, region = fixtures.table(spark, sf_dir, "nation"), fixtures.table(spark, sf_dir, "region")
    rows = fixtures.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select(fixtures.address(F.col("s_suppkey")).alias("address"), F.coalesce("r_name", F.lit("other")).alias("sector"))


def with_sector(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with the sector of their address; addresses that ``known`` lacks are in ``other``."""
    return rows.join(known, "address", "left").fillna("other", ["sector"])


_SECTORS_SQL = """sectors AS (
  SELECT 'A' || lpad(s_suppkey::VARCHAR, 9, '0') || '.X' AS address, coalesce(r_name, 'other') AS sector
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
)"""


def target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, address, sector, margin, target_weight, target_ret): the ensemble's ranked signal as weights."""
    runs = signals(spark, sf_dir).join(F.broadcast(weights(spark)), "formula_id")  # a few formulas
    mixed = runs.groupBy("address", "time").agg((F.sum(F.col("weight") * F.col("signal")) / F.sum("weight")).alias("signal"), F.max("target_ret").alias("target_ret"), F.max("close").alias("close"))
    ranked = with_sector(rk.rank_signal(mixed), sectors(spark, sf_dir))
    return ranked.select(F.col("time").alias("date"), "address", "sector", (F.col("close") * 2).alias("margin"), (F.col("rank_signal") * 0.3).alias("target_weight"), "target_ret")


_TW_SQL = f"""{sql.RUNS_SQL}, {_WEIGHTS_SQL}, {_MEAN_SQL}, {_SECTORS_SQL}, tw AS (
  SELECT m.time AS date, m.address, coalesce(s.sector, 'other') AS sector, p.close * 2 AS margin,
    ((row_number() OVER (PARTITION BY m.time ORDER BY m.signal, m.address) - 1) / (count(*) OVER (PARTITION BY m.time) - 1) * 2 - 1) * 0.3e0 AS target_weight, p.target_ret
  FROM mixed m JOIN tgt p USING (address, time) LEFT JOIN sectors s USING (address)
)"""


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio(spark, sf_dir).select(F.col("formula_id").alias("run_id"), F.col("time").alias("date"), (F.col("pnl") * 10000).alias("daily_pnl"), F.lit(10000.0).alias("capital"))


_EQ_SQL = f"""{sql.PNL_SQL}, eq0 AS (SELECT formula_id AS run_id, time AS date, pnl * 10000 AS daily_pnl, 10000 + sum(pnl * 10000) OVER (PARTITION BY formula_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS equity FROM pf),
eq AS (SELECT *, greatest(max(equity) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING), 10000e0) AS peak FROM eq0), state AS (SELECT *, 1 - equity / peak AS drawdown, daily_pnl / (equity - daily_pnl) AS daily_ret FROM eq)"""


def _quarter(column: str = "time"):
    return F.to_date(F.date_trunc("quarter", column))


def panel_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_quarter(signals(spark, sf_dir))


def by_quarter(runs: DataFrame) -> DataFrame:
    return en.formula_pnl_panel(bt.position(runs, "rank", KEYS), _quarter())


_QUARTERS_SQL = "qp AS (SELECT formula_id, date_trunc('quarter', time)::DATE AS period, avg(position * target_ret) AS pnl FROM pos GROUP BY ALL)"
# multiplicative weights of the three formulas: look-back 10, warm-up 2, floor 0.01, eta by rule; row t holds them after period t, row -1 before the first
_MWU_SQL = f"""{_QUARTERS_SQL}, qi AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS t FROM (SELECT DISTINCT period FROM qp)),
qw AS (SELECT t, {", ".join(f"coalesce(sum(pnl) FILTER (formula_id = '{k}'), 0e0) AS {k}" for k in _WEIGHTS)} FROM qp JOIN qi USING (period) GROUP BY t),
qg AS (SELECT t, {", ".join(f"avg({k}) OVER w AS {k}" for k in _WEIGHTS)} FROM qw WINDOW w AS (ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
mwu AS (
  SELECT -1::BIGINT AS t, 1 / 3e0 AS wa, 1 / 3e0 AS wb, 1 / 3e0 AS wc
  UNION ALL
  SELECT t, CASE WHEN still THEN wa ELSE na / (na + nb + nc) END, CASE WHEN still THEN wb ELSE nb / (na + nb + nc) END, CASE WHEN still THEN wc ELSE nc / (na + nb + nc) END FROM (
    SELECT *, greatest(wa * (1 + eta * fa / top), 0.01e0) AS na, greatest(wb * (1 + eta * fb / top), 0.01e0) AS nb, greatest(wc * (1 + eta * fc / top), 0.01e0) AS nc FROM (
      SELECT qg.t, wa, wb, wc, fa, fb, fc, qg.t < 2 OR greatest(abs(fa), abs(fb), abs(fc)) < 1e-12 AS still, greatest(abs(fa), abs(fb), abs(fc), 1e-300) AS top, sqrt(ln(3e0) / 100) AS eta FROM mwu JOIN qg ON qg.t = mwu.t + 1))
), learned AS (
  SELECT t, 'fa' AS formula_id, wa AS weight FROM mwu UNION ALL SELECT t, 'fb', wb FROM mwu UNION ALL SELECT t, 'fc', wc FROM mwu
)"""


def _floored(inner: str, passes: int = 10) -> str:
    """Weights raised to the floor and renormalised, until none is under it or the passes are over."""
    for _ in range(passes):
        whole = "(greatest(a, 0.02e0) + greatest(b, 0.02e0) + greatest(c, 0.02e0))"
        inner = "SELECT t, " + ", ".join(f"CASE WHEN least(a, b, c) >= 0.02 THEN {x} ELSE greatest({x}, 0.02e0) / {whole} END AS {x}" for x in "abc") + f" FROM ({inner})"
    return inner


# decayed means of the last ten quarters: decay 0.9, blend 0.3, warm-up 2, floor 0.02
_AGED = lambda k: "(" + " + ".join(f"coalesce(lag({k}, {i}) OVER (ORDER BY t), 0e0) * {0.9**i!r}" for i in range(10)) + ") / (" + " + ".join(f"CASE WHEN t >= {i} THEN {0.9**i!r} ELSE 0e0 END" for i in range(10)) + ")"
_STEP = ", ".join(f"CASE WHEN s.t < 2 THEN e.{x} ELSE 0.7e0 * e.{x} + 0.3e0 * exp(s.z{x} - greatest(s.za, s.zb, s.zc)) / (exp(s.za - greatest(s.za, s.zb, s.zc)) + exp(s.zb - greatest(s.za, s.zb, s.zc)) + exp(s.zc - greatest(s.za, s.zb, s.zc))) END AS {x}" for x in "abc")
_EMA_SQL = f"""em AS (SELECT t, {", ".join(f"{_AGED(k)} AS m{x}" for k, x in zip(_WEIGHTS, "abc", strict=True))} FROM qw),
es AS (SELECT t, {", ".join(f"m{x} / (sqrt(((ma - mu) * (ma - mu) + (mb - mu) * (mb - mu) + (mc - mu) * (mc - mu)) / 3) + 1e-8) AS z{x}" for x in "abc")} FROM (SELECT *, (ma + mb + mc) / 3 AS mu FROM em)),
ema AS (
  SELECT -1::BIGINT AS t, 1 / 3e0 AS a, 1 / 3e0 AS b, 1 / 3e0 AS c
  UNION ALL
  {_floored(f"SELECT s.t, {_STEP} FROM ema e JOIN es s ON s.t = e.t + 1")}
)"""
_PERIODS_SQL = f'WITH RECURSIVE {sql.positions_sql()}, {_MWU_SQL[: _MWU_SQL.index("qg AS")].rstrip().rstrip(",")}'
EMA_QUERY = f"""{_PERIODS_SQL}, {_EMA_SQL}
SELECT 'ema' AS run_id, period, formula_id, round(weight, 6) + 0e0 AS weight FROM (SELECT t, 'fa' AS formula_id, a AS weight FROM ema UNION ALL SELECT t, 'fb', b FROM ema UNION ALL SELECT t, 'fc', c FROM ema) JOIN qi USING (t)"""

MWU_QUERY = f"WITH RECURSIVE {sql.positions_sql()}, {_MWU_SQL} SELECT period, formula_id, round(weight, 6) + 0e0 AS weight FROM learned JOIN qi USING (t)"


def parameter_runs(spark: SparkSession, lookbacks: tuple[int, ...] = (10,), floors: tuple[float, ...] = (0.01,), etas: tuple[float | None, ...] = (None, 0.3)) -> DataFrame:
    """Runs of learned weights: every mix of the parameters for multiplicative weights, and one with decayed means."""
    rows = [(f"mwu-{k}-{f}-{e or 'rule'}", "mwu", e, f, k, 2) for k in lookbacks for f in floors for e in etas] + [("ema", "ema", None, 0.02, 10, 2)]
    return spark.createDataFrame(rows, "run_id string, strategy string, eta double, floor double, lookback int, warmup int")


_MWU = "run_id = 'mwu-10-0.01-rule'"


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes_of(returns(spark, sf_dir))


def regimes_of(rets: DataFrame) -> DataFrame:
    return rk.vol_regime_scale(rk.regime_features(rets)).select(F.col("time").alias("date"), "scale", "regime")


_REGIME_SQL = "CASE WHEN coalesce(vol_ratio, 1e0) < 0.7 AND avg_corr < 0.3 THEN 'calm' WHEN coalesce(vol_ratio, 1e0) < 1.3 AND avg_corr < 0.5 THEN 'normal' WHEN coalesce(vol_ratio, 1e0) < 2 THEN 'stress' ELSE 'crisis' END"


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rk.MODES, "mode string, scaled_by string, use_topn boolean, weighting string, mixes boolean")


def replayed(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    """All seven modes over all dates, with the weights learned up to the quarter before and the ensemble's own past for the legacy scale."""
    runs = with_sector(signals(spark, sf_dir).select("formula_id", "address", "time", "signal", "target_ret", "is_safe", "close"), sectors(spark, sf_dir))
    runs = io.settled(runs, "signals")
    # every formula has every address and time, so one of them holds the panel's prices
    market = regimes_of(pn.simple_returns(runs.where(F.col("formula_id") == KEYS_IN_USE[0])).select("address", "time", "ret"))
    panel = by_quarter(runs)
    after = en.online_weights(panel, parameter_runs(spark).where(_MWU)).select("formula_id", "period", "weight")
    before = after.withColumn("weight", F.lag("weight").over(Window.partitionBy("formula_id").orderBy("period")))
    before = before.withColumn("weight", F.coalesce("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("period"))))
    dates = runs.select("time").distinct().withColumn("period", _quarter())
    learned = dates.join(before, "period").select("formula_id", "time", "weight")
    ensemble = bt.position(en.ensemble_mean(runs, weights(spark)).join(runs.where("formula_id = 'fa'").select("address", "time", "target_ret", "is_safe"), ["address", "time"]), "rank")
    own = ensemble.groupBy("time").agg(F.avg(F.col("position") * F.col("target_ret")).alias("pnl"))
    # what was known at a date is the pnl up to the date before
    line = Window.partitionBy("run").orderBy("time")
    past = own.withColumn("run", F.lit("ensemble")).withColumn("pnl", F.lag("pnl").over(line))
    legacy = rk.legacy_regime(past.where("pnl IS NOT NULL"), ["run"], WEEKLY.bars_per_year).select("time", "scale")
    legacy = own.select("time").join(legacy, "time", "left").fillna(1.0, ["scale"])
    return rk.replay(runs, rk.replay_weights(runs, learned, market), modes(spark), market, legacy, n)


def register(add: Callable, rounded: Callable) -> None:
    """Add the queries of this module."""

    def cols(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
        return df.select(*keys, *[rounded(v, digits).alias(v) for v in values])

    add("e1_ensemble_mean", lambda s, d: cols(en.ensemble_mean(signals(s, d), weights(s)), ["address", "time"], ["signal"]), f"WITH {sql.RUNS_SQL}, {_WEIGHTS_SQL}, {_MEAN_SQL} SELECT address, time, round(signal, 6) + 0e0 AS signal FROM mixed")
    add("e2_ensemble_rank_mean", lambda s, d: cols(en.ensemble_rank_mean(signals(s, d), weights(s)), ["address", "time"], ["signal"]), f"WITH {sql.RUNS_SQL.replace('runs AS (', 'runs0 AS (', 1)}, runs AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY formula_id, address ORDER BY round(signal, 9), time) - 1) / (count(*) OVER (PARTITION BY formula_id, address) - 1) AS signal) FROM runs0), {_WEIGHTS_SQL}, {_MEAN_SQL} SELECT address, time, round(signal, 6) + 0e0 AS signal FROM mixed")
    add("e3_predict_individual", lambda s, d: en.predict_individual(signals(s, d)).groupBy("formula_id").agg(F.count(F.lit(1)).alias("n")), f"WITH {sql.RUNS_SQL} SELECT formula_id, count(*) AS n FROM runs GROUP BY formula_id HAVING stddev_samp(signal) >= 1e-8")

    def fold_table(s: SparkSession, d: str) -> DataFrame:
        return en.folds(s, fixtures.weeks(s, d), 5, gap=2)

    size = sql.WEEKS // 6
    fold_sql = "folds AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, 0, {(k + 1) * size}, {(k + 1) * size + 2}, {sql.WEEKS if k == 4 else (k + 2) * size})" for k in range(5)) + ") AS f(fold, train_start, train_end, test_start, test_end))"
    add("e4_time_series_folds", fold_table, f"WITH {fold_sql} SELECT * FROM folds")
    layers, results = fm.sql_layers(sql.SIGNALS, sql.FEATURES, sql.WEEKS // 6)
    cv_sql = f"""{sql.FEATURES_SQL}, {sql.marks_sql('feats', 'whole')}, {fold_sql}, idx AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS t FROM (SELECT DISTINCT time FROM feats)),
    parted AS (SELECT w.* REPLACE (lpad(fold::VARCHAR, 4, '0') || '|' || address AS address), fold FROM whole w JOIN idx USING (time) JOIN folds ON t >= test_start AND t < test_end), {sql.layered('parted', layers, 'fnodes')},
    tgt AS (SELECT *, {', '.join(f'({r})::DOUBLE AS {k}' for k, r in results.items())} FROM fnodes), {sql.runs_sql(sql.SIGNALS, extra='fold, ')}, {sql.placed_sql(hold=True)}, {sql.NETTED_SQL},
    fpf AS (SELECT formula_id, fold, time, avg(pnl) AS pnl, avg(turnover) AS turnover FROM netted GROUP BY ALL), fsum AS (SELECT *, sum(pnl) OVER (PARTITION BY formula_id, fold ORDER BY time ROWS UNBOUNDED PRECEDING) AS s FROM fpf),
    ftop AS (SELECT *, max(s) OVER (PARTITION BY formula_id, fold ORDER BY time ROWS UNBOUNDED PRECEDING) AS top FROM fsum),
    cv AS (SELECT formula_id, fold, avg(pnl) / (coalesce(stddev_samp(pnl), 0) + 1e-8) * sqrt(52e0) AS sharpe, max(top - s) AS max_drawdown, avg(turnover) AS turnover, count(*) AS n FROM ftop GROUP BY formula_id, fold)"""

    def cv(s: SparkSession, d: str) -> DataFrame:
        times = fixtures.weeks(s, d)
        panel = marked(s, d, times)
        parts = en.fold_panels(panel, en.folds(s, times, 5, gap=2), pn.time_index(fixtures.times(s, d)))
        pnl = held(run_formulas(parts, sql.SIGNALS, times // 6, ("fold",)))
        return en.cv_evaluate(pnl.groupBy("formula_id", "fold", "time").agg(F.avg("pnl").alias("pnl"), F.avg("turnover").alias("turnover")), 52.0)

    add("e5_cv_evaluate", lambda s, d: cols(cv(s, d), ["formula_id", "fold", "n"], ["sharpe", "max_drawdown", "turnover"]), f"WITH {cv_sql} SELECT formula_id, fold, n, round(sharpe, 6) + 0e0 AS sharpe, round(max_drawdown, 6) + 0e0 AS max_drawdown, round(turnover, 6) + 0e0 AS turnover FROM cv")
    single = lambda s, d: bt.sharpe(KEYS, bt.portfolio_pnl(held(signals(s, d)), KEYS), WEEKLY)
    add(
        "e6_cv_vs_single_split", lambda s, d: cols(en.cv_vs_single_split(cv(s, d), single(s, d)), ["formula_id", "overfit"], ["cv_mean", "cv_std", "single", "difference", "robustness"], 5),
        f"""WITH a AS (SELECT formula_id, avg(sharpe) AS cv_mean, stddev_pop(sharpe) AS cv_std FROM (WITH {cv_sql} SELECT * FROM cv) GROUP BY formula_id), s AS (SELECT * FROM (WITH {sql.HELD_SQL}, {sql.SHARPE_SQL} SELECT * FROM sharpes))
        SELECT formula_id, s.sharpe - cv_mean > 0.3 AS overfit, round(cv_mean, 5) + 0e0 AS cv_mean, round(cv_std, 5) + 0e0 AS cv_std, round(s.sharpe, 5) + 0e0 AS single, round(s.sharpe - cv_mean, 5) + 0e0 AS difference, round(cv_mean / (cv_std + 1e-8), 5) + 0e0 AS robustness FROM a JOIN s USING (formula_id)""",
    )
    pair_sql = f"{sql.RUNS_SQL}, prs AS (SELECT a.formula_id AS a, b.formula_id AS b, corr(a.signal, b.signal) AS corr FROM runs a JOIN runs b ON a.address = b.address AND a.time = b.time AND a.formula_id < b.formula_id GROUP BY ALL)"
    add("e7_signal_pairs", lambda s, d: cols(en.signal_pairs(signals(s, d)), ["a", "b"], ["corr"]), f"WITH {pair_sql} SELECT a, b, round(corr, 6) + 0e0 AS corr FROM prs")

    def chosen(s: SparkSession, d: str) -> DataFrame:
        runs = io.settled(signals(s, d).select("formula_id", "address", "time", "signal", "target_ret"), "signals")
        return en.select_factors(bt.pearson_ic(runs, KEYS), en.signal_pairs(runs), 2, min_icir=0.0)

    add(
        "e7_select_factors", chosen,
        f"""WITH {pair_sql}, {sql.QUALITY_SQL}, o AS (SELECT formula_id, row_number() OVER (ORDER BY icir DESC, formula_id) AS k FROM quality WHERE icir >= 0), one AS (SELECT formula_id FROM o WHERE k = 1),
        free AS (SELECT o.formula_id, k FROM o, one WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM prs WHERE abs(corr) > 0.7 AND ((a = o.formula_id AND b = one.formula_id) OR (b = o.formula_id AND a = one.formula_id))))
        SELECT formula_id, 1 AS place FROM one UNION ALL SELECT formula_id, 2 FROM (SELECT formula_id FROM free ORDER BY k LIMIT 1)""",
    )

    # the five features as factors: the first three are in use
    def factor_quality(s: SparkSession, d: str) -> DataFrame:
        rows = pn.target_return(features(s, d)).select("address", "time", "target_ret", *sql.FEATURES)
        return bt.pearson_ic(rows.unpivot(["address", "time", "target_ret"], sql.FEATURES, "formula_id", "signal"), KEYS)

    in_use = lambda s: s.createDataFrame([(f,) for f in sql.FEATURES[:3]], "formula_id string")
    factor_sql = f"""{sql.FEATURES_SQL}, {sql.marks_sql('feats')}, runs AS ({" UNION ALL ".join(f"SELECT '{f}' AS formula_id, address, time, {f} AS signal, target_ret FROM tgt" for f in sql.FEATURES)}), {sql.QUALITY_SQL},
    worst AS (SELECT u.formula_id, row_number() OVER (ORDER BY coalesce(icir, 0), u.formula_id) AS place FROM (SELECT unnest({sql.FEATURES[:3]}) AS formula_id) u LEFT JOIN quality USING (formula_id)),
    fresh AS (SELECT formula_id, row_number() OVER (ORDER BY icir DESC, formula_id) AS place FROM quality WHERE formula_id NOT IN ({', '.join(f"'{f}'" for f in sql.FEATURES[:3])})),
    swaps AS (SELECT place::INT AS place, w.formula_id AS "out", f.formula_id AS "in" FROM worst w JOIN fresh f USING (place))"""
    add("e8_swap_factors", lambda s, d: en.swap_factors(in_use(s), factor_quality(s, d), 2), f'WITH {factor_sql} SELECT place, "out", "in" FROM swaps WHERE place <= 2')

    def gross(s: SparkSession, d: str) -> DataFrame:
        rows = bt.position(signals(s, d), "rank", KEYS)
        spread = F.stddev_samp("signal").over(Window.partitionBy("formula_id", "time"))
        by = rows.withColumn("_s", spread).groupBy("formula_id", "time").agg(F.avg(F.col("position") * F.col("target_ret")).alias("pnl"), F.max("_s").alias("spread"))
        return by

    recent_sql = "recent AS (SELECT *, row_number() OVER (PARTITION BY formula_id ORDER BY time DESC) AS k FROM (SELECT formula_id, time, avg(position * target_ret) AS pnl, stddev_samp(signal) AS spread FROM pos GROUP BY formula_id, time)), recents AS (SELECT formula_id, CASE WHEN max(spread) > 1e-8 THEN avg(pnl) / (coalesce(stddev_samp(pnl), 0) + 1e-10) * sqrt(52e0) ELSE -999e0 END AS sharpe FROM recent WHERE k <= 60 GROUP BY formula_id)"
    add("e9_formula_sharpe_60d", lambda s, d: cols(en.recent_sharpe(gross(s, d), 60, 52.0), KEYS, ["sharpe"]), f"WITH {sql.positions_sql()}, {recent_sql} SELECT formula_id, round(sharpe, 6) + 0e0 AS sharpe FROM recents")
    add("e10_formula_pnl_panel", lambda s, d: cols(panel_by_quarter(s, d), ["formula_id", "period"], ["pnl"], 8), f"WITH {sql.positions_sql()}, {_QUARTERS_SQL} SELECT formula_id, period, round(pnl, 8) + 0e0 AS pnl FROM qp")
    add(
        "e11_mwu_weights", lambda s, d: cols(en.online_weights(panel_by_quarter(s, d), parameter_runs(s).where(_MWU)), ["period", "formula_id"], ["weight"]),
        MWU_QUERY,
    )
    add("e12_ema_weights", lambda s, d: cols(en.online_weights(panel_by_quarter(s, d), parameter_runs(s).where("run_id = 'ema'")), ["run_id", "period", "formula_id"], ["weight"]), EMA_QUERY)

    def online(s: SparkSession, d: str, runs: DataFrame) -> DataFrame:
        panel = io.settled(panel_by_quarter(s, d), "quarters")
        return cols(en.online_pnl(panel, en.online_weights(panel, runs)), ["run_id"], ["online_pnl", "static_pnl", "online_ratio", "static_ratio"])

    add(
        "e13_run_online", lambda s, d: online(s, d, parameter_runs(s).where(_MWU)).drop("run_id"),
        f"""WITH RECURSIVE {sql.positions_sql()}, {_MWU_SQL}, x AS (SELECT period, sum(weight * pnl) AS o, avg(pnl) AS s FROM qp JOIN qi USING (period) JOIN (SELECT t + 1 AS t, formula_id, weight FROM learned WHERE t >= 0) l USING (t, formula_id) GROUP BY period)
        SELECT round(sum(o), 6) + 0e0 AS online_pnl, round(sum(s), 6) + 0e0 AS static_pnl, round(avg(o) / (stddev_samp(o) + 1e-8), 6) + 0e0 AS online_ratio, round(avg(s) / (stddev_samp(s) + 1e-8), 6) + 0e0 AS static_ratio FROM x""",
    )
    # five look-backs, four floors and three rates, in one pass
    lookbacks, floors, etas = (4, 6, 8, 10, 12), (0.005, 0.01, 0.02, 0.05), (None, 0.1, 0.3)
    values = ", ".join(f"('mwu-{k}-{f}-{e or 'rule'}', {f'{e}e0' if e else f'sqrt(ln(3e0) / {max(10 * k, 100)})'}, {f}e0, {k})" for k in lookbacks for f in floors for e in etas)
    moved = {x: f"greatest(w{x} * (1 + eta * f{x} / top), floor)" for x in "abc"}
    whole = f"({' + '.join(moved.values())})"
    add(
        "e14_ab_compare", lambda s, d: online(s, d, parameter_runs(s, lookbacks, floors, etas)),
        f"""{_PERIODS_SQL}, {_EMA_SQL}, ab AS (SELECT * FROM (VALUES {values}) AS v(run_id, eta, floor, lookback)),
        abg AS (SELECT run_id, eta, floor, q.t, avg(p.fa) AS fa, avg(p.fb) AS fb, avg(p.fc) AS fc FROM ab JOIN qw q ON true JOIN qw p ON p.t BETWEEN q.t - lookback + 1 AND q.t GROUP BY run_id, eta, floor, q.t),
        abw AS (
          SELECT run_id, -1::BIGINT AS t, 1 / 3e0 AS wa, 1 / 3e0 AS wb, 1 / 3e0 AS wc FROM ab
          UNION ALL
          SELECT run_id, t, {", ".join(f"CASE WHEN still THEN w{x} ELSE {moved[x]} / {whole} END" for x in "abc")} FROM (
            SELECT abw.run_id, abg.t, wa, wb, wc, fa, fb, fc, eta, floor, abg.t < 2 OR greatest(abs(fa), abs(fb), abs(fc)) < 1e-12 AS still, greatest(abs(fa), abs(fb), abs(fc), 1e-300) AS top FROM abw JOIN abg ON abg.run_id = abw.run_id AND abg.t = abw.t + 1)
        ), abl AS (SELECT run_id, t, unnest(['fa', 'fb', 'fc']) AS formula_id, unnest([wa, wb, wc]) AS weight FROM abw UNION ALL SELECT 'ema', t, unnest(['fa', 'fb', 'fc']), unnest([a, b, c]) FROM ema),
        x AS (SELECT run_id, period, sum(weight * pnl) AS o, avg(pnl) AS s FROM qp JOIN qi USING (period) JOIN (SELECT run_id, t + 1 AS t, formula_id, weight FROM abl WHERE t >= 0) l USING (t, formula_id) GROUP BY run_id, period)
        SELECT run_id, round(sum(o), 6) + 0e0 AS online_pnl, round(sum(s), 6) + 0e0 AS static_pnl, round(avg(o) / (stddev_samp(o) + 1e-8), 6) + 0e0 AS online_ratio, round(avg(s) / (stddev_samp(s) + 1e-8), 6) + 0e0 AS static_ratio FROM x GROUP BY run_id""",
    )
    add(
        "e15_inverse_vol_mix", lambda s, d: cols(en.inverse_vol_mix(signals(s, d), weights(s)), KEYS, ["weight"]),
        f"""WITH {sql.RUNS_SQL}, {_WEIGHTS_SQL}, l AS (SELECT formula_id, time, avg(signal) AS m, row_number() OVER (PARTITION BY formula_id ORDER BY time DESC) AS k FROM runs GROUP BY formula_id, time), v AS (SELECT formula_id, 1 / (stddev_samp(m) + 1e-10) AS inv FROM l WHERE k <= 20 GROUP BY formula_id),
        x AS (SELECT formula_id, 0.6e0 * inv / sum(inv) OVER () + 0.4e0 * weight AS w FROM v JOIN weights USING (formula_id)) SELECT formula_id, round(w / sum(w) OVER (), 6) + 0e0 AS weight FROM x""",
    )

    ret_sql = f"{fixtures.PANEL_SQL}, rets AS (SELECT address, time, greatest(-0.2e0, least(0.2e0, coalesce((close - lag(close) OVER w) / (abs(lag(close) OVER w) + 1e-10), 0e0))) AS ret FROM panel WINDOW w AS (PARTITION BY address ORDER BY time))"
    g_sql = f"""{ret_sql}, g0 AS (SELECT time, stddev_pop(ret) AS cv, avg(abs(ret)) AS ar FROM rets GROUP BY time), g1 AS (SELECT time, row_number() OVER o AS t, avg(cv) OVER w AS cross_vol, avg(ar) OVER w AS abs_ret, avg(cv) OVER h AS hist FROM g0 WINDOW o AS (ORDER BY time), w AS (ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), h AS (ORDER BY time ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
    rt AS (SELECT address, t, ret FROM rets JOIN g1 USING (time)), en AS (SELECT a.address, a.t + k AS e, a.t, a.ret FROM rt a, range(0, 20) x(k)), zs AS (SELECT *, coalesce((ret - avg(ret) OVER p) / nullif(stddev_pop(ret) OVER p, 0e0), 0e0) AS z, count(*) OVER p AS n FROM en WINDOW p AS (PARTITION BY address, e)),
    ss AS (SELECT e, t, sum(z) AS s, count(*) AS k FROM zs WHERE n >= 5 GROUP BY e, t), cc AS (SELECT e, CASE WHEN max(k) < 2 THEN 0e0 ELSE (avg(s * s) - max(k)) / greatest(max(k) * (max(k) - 1), 1) END AS avg_corr FROM ss GROUP BY e),
    regime AS (SELECT time, cross_vol, abs_ret, coalesce(avg_corr, 0e0) AS avg_corr, cross_vol / nullif(hist, 0e0) AS vol_ratio FROM g1 LEFT JOIN cc ON t = e), scaled_regime AS (SELECT *, greatest(0.3e0, least(1.2e0, 1 / greatest(coalesce(vol_ratio, 1e0), 0.5e0) - 0.5e0 * greatest(0e0, avg_corr - 0.3e0))) AS scale FROM regime)"""
    names = ["cross_vol", "abs_ret", "avg_corr", "vol_ratio"]
    add("g1_regime_features", lambda s, d: cols(rk.regime_features(returns(s, d)), ["time"], names), f"WITH {g_sql} SELECT time, {', '.join(f'round({n}, 6) + 0e0 AS {n}' for n in names)} FROM regime")
    add("g2_vol_regime_scale", lambda s, d: cols(rk.vol_regime_scale(rk.regime_features(returns(s, d))), ["time", "regime"], ["scale"], 5), f"WITH {g_sql} SELECT time, {_REGIME_SQL} AS regime, round(scale, 5) + 0e0 AS scale FROM scaled_regime")
    add("g3_legacy_regime", lambda s, d: rk.legacy_regime(portfolio(s, d), KEYS, 52.0).select("formula_id", "time", "scale"), f"WITH {sql.PNL_SQL} SELECT formula_id, time, CASE WHEN count(*) OVER w >= 20 AND avg(pnl) OVER w / (stddev_pop(pnl) OVER w + 1e-10) * sqrt(52e0) < -0.5 THEN 0.5e0 ELSE 1e0 END AS scale FROM pf WINDOW w AS (PARTITION BY formula_id ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
    add("g4_state_regime", lambda s, d: rk.state_regime(rk.regime_features(returns(s, d))).select("time", "level", rounded("scale").alias("scale")))
    add("g5_regime_topn", lambda s, d: regimes(s, d).select("date", rk.regime_topn(5, F.col("scale"), F.col("regime")).alias("n")), f"WITH {g_sql}, rg AS (SELECT *, {_REGIME_SQL} AS regime FROM scaled_regime) SELECT time AS date, CASE regime WHEN 'crisis' THEN greatest(2, floor(5 * scale)::INT) WHEN 'calm' THEN 7 ELSE 5 END AS n FROM rg")

    ranked = "ranked AS (SELECT *, (row_number() OVER (PARTITION BY time ORDER BY signal, address) - 1) / (count(*) OVER (PARTITION BY time) - 1) * 2 - 1 AS rank_signal FROM mixed)"
    mixed = lambda s, d: en.ensemble_mean(signals(s, d), weights(s))
    add("s1_rank_signal", lambda s, d: cols(rk.rank_signal(mixed(s, d)), ["address", "time"], ["rank_signal"]), f"WITH {sql.RUNS_SQL}, {_WEIGHTS_SQL}, {_MEAN_SQL}, {ranked} SELECT address, time, round(rank_signal, 6) + 0e0 AS rank_signal FROM ranked")
    add("s2_build_signals", lambda s, d: rk.build_signals(signals(s, d), weights(s)).select("address", "time", "direction", rounded("signal_strength").alias("signal_strength"), F.size("contributions").alias("n_contributions")), f"WITH {sql.RUNS_SQL}, {_WEIGHTS_SQL}, {_MEAN_SQL}, {ranked} SELECT address, time, CASE WHEN rank_signal > 0.01 THEN 'long' WHEN rank_signal < -0.01 THEN 'short' ELSE 'flat' END AS direction, round(abs(rank_signal), 6) + 0e0 AS signal_strength, 3 AS n_contributions FROM ranked")

    def entries(s: SparkSession, d: str) -> DataFrame:
        runs = signals(s, d).where("formula_id = 'fc'")
        last = runs.groupBy("address").agg(F.max_by("signal", "time").alias("signal"), F.max_by("liquidity", "time").alias("liquidity"))
        held = fixtures.table(s, d, "supplier").where("s_suppkey % 4 = 0").select(fixtures.address(F.col("s_suppkey")).alias("address"))
        return cols(rk.entry_candidates(last, held, 5, least_score=0.3), ["address"], ["score"])

    add("s3_entry_candidates", entries, f"WITH {sql.RUNS_SQL}, l AS (SELECT address, arg_max(signal, time) AS signal, arg_max(liquidity, time) AS liquidity FROM runs WHERE formula_id = 'fc' GROUP BY address) SELECT address, round(1 / (1 + exp(-signal)), 6) + 0e0 AS score FROM l WHERE 1 / (1 + exp(-signal)) >= 0.3 AND liquidity >= 5000 AND address NOT IN (SELECT 'A' || lpad(s_suppkey::VARCHAR, 9, '0') || '.X' FROM supplier WHERE s_suppkey % 4 = 0) ORDER BY score DESC, address LIMIT 5")

    def exits(s: SparkSession, d: str) -> DataFrame:
        bars = fixtures.bars(s, d)
        opened = bars.groupBy("address").agg(F.min_by("close", "time").alias("entry_price"))
        score = 1 / (1 + F.exp(-(F.col("close") - F.col("open")) / F.col("open") * 5))
        return rk.exit_rules(bars.join(opened, "address").select(F.col("address").alias("position_id"), "time", F.col("close").alias("price"), "entry_price", score.alias("score")))

    add("s4_exit_rules", exits, f"""WITH RECURSIVE {fixtures.BARS_SQL}, b AS (SELECT address AS position_id, time, close AS price, first_value(close) OVER (PARTITION BY address ORDER BY time) AS ep, 1 / (1 + exp(-(close - open) / open * 5)) AS score, row_number() OVER (PARTITION BY address ORDER BY time) AS i FROM bars),
    m AS (
      SELECT position_id, 0::BIGINT AS i, 0e0 AS high, false AS half, false AS closed, NULL::VARCHAR AS event, NULL::DATE AS time FROM (SELECT DISTINCT position_id FROM b)
      UNION ALL
      SELECT position_id, i, high, half OR coalesce(event = 'take_half', false), coalesce(event <> 'take_half', false), event, time FROM (
        SELECT b.position_id, b.i, greatest(m.high, price, ep) AS high, half, b.time,
          CASE WHEN price / ep - 1 <= -0.05 THEN 'stop_loss' WHEN price / ep - 1 >= 0.10 AND NOT half THEN 'take_half' WHEN greatest(m.high, price, ep) / ep - 1 > 0.05 AND 1 - price / greatest(m.high, price, ep) > 0.03 THEN 'trailing_stop' WHEN NOT half AND score < 0.45 THEN 'low_score' END AS event
        FROM m JOIN b ON b.position_id = m.position_id AND b.i = m.i + 1 WHERE NOT closed)
    ) SELECT position_id, time, event FROM m WHERE event IS NOT NULL""")  # fmt: skip
    add("s5_position_size", lambda s, d: fixtures.table(s, d, "customer").select("c_custkey", rk.position_size(F.col("c_acctbal"), 500.0).alias("size")), "SELECT c_custkey, CASE WHEN c_acctbal < 500.1 THEN 0e0 ELSE 500e0 END AS size FROM customer")

    tw = target_weights
    state = lambda s, d: rk.portfolio_state(equity(s, d)).where("run_id = 'fa'")
    key = ["date", "address"]
    add("k1_sector_of", sectors, f"WITH {_SECTORS_SQL} SELECT address, sector FROM sectors")
    add("k2_portfolio_state", lambda s, d: cols(rk.portfolio_state(equity(s, d)), ["run_id", "date"], ["equity", "drawdown", "daily_ret"]), f"WITH {_EQ_SQL} SELECT run_id, date, round(equity, 6) + 0e0 AS equity, round(drawdown, 6) + 0e0 AS drawdown, round(daily_ret, 6) + 0e0 AS daily_ret FROM state")
    loss = "lossy AS (SELECT t.* REPLACE (target_weight * CASE WHEN drawdown >= 0.08 OR daily_ret <= -0.02 THEN 0e0 WHEN drawdown >= 0.05 THEN 0.5e0 ELSE 1e0 END AS target_weight) FROM tw t JOIN state s ON s.date = t.date AND s.run_id = 'fa')"
    both = f"{_EQ_SQL}{_TW_SQL[len(sql.RUNS_SQL):]}"
    add("k3_loss_rules", lambda s, d: cols(rk.loss_rules(tw(s, d), state(s, d)), key, ["target_weight"]), f"WITH {both}, {loss} SELECT date, address, round(target_weight, 6) + 0e0 AS target_weight FROM lossy")
    add("k4_position_cap", lambda s, d: cols(rk.position_cap(tw(s, d)), key, ["target_weight"]), f"WITH {_TW_SQL} SELECT date, address, round(greatest(-0.15e0, least(0.15e0, target_weight)), 6) + 0e0 AS target_weight FROM tw")
    add("k5_sector_cap", lambda s, d: cols(rk.sector_cap(tw(s, d)), key, ["target_weight"]), f"WITH {_TW_SQL}, x AS (SELECT *, sum(abs(target_weight)) OVER (PARTITION BY date, sector) AS total FROM tw) SELECT date, address, round(target_weight * CASE WHEN total > 0.4 THEN 0.4e0 / total ELSE 1e0 END, 6) + 0e0 AS target_weight FROM x")
    daily_ret = lambda s, d: portfolio(s, d).where("formula_id = 'fa'").select(F.col("time").alias("date"), F.col("pnl").alias("ret"))
    add("k6_vol_target", lambda s, d: cols(rk.vol_target(tw(s, d), daily_ret(s, d), per_year=52.0), key, ["target_weight"]), f"WITH {both}, v AS (SELECT time AS date, stddev_pop(pnl) OVER w * sqrt(52e0) AS vol, count(*) OVER w AS n FROM pf WHERE formula_id = 'fa' WINDOW w AS (ORDER BY time ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) SELECT date, address, round(target_weight * CASE WHEN n >= 20 AND vol > 0.225 THEN 0.15e0 / vol ELSE 1e0 END, 6) + 0e0 AS target_weight FROM tw JOIN v USING (date)")

    # halved once for each stronger position of the sector and side, until under 0.01
    halve = lambda source, name: f"{name}0 AS (SELECT *, row_number() OVER (PARTITION BY date, sector, sign(target_weight), abs(target_weight) >= 0.01 ORDER BY abs(target_weight) DESC, address) - 1 AS above FROM {source}), {name} AS (SELECT * REPLACE (CASE WHEN abs(target_weight) >= 0.01 THEN target_weight / pow(2, least(above, floor(log2(abs(target_weight) / 0.01e0) + 1e-12) + 1)) ELSE target_weight END AS target_weight) FROM {name}0)"
    add("k7_corr_dedup", lambda s, d: cols(rk.corr_dedup(tw(s, d)), key, ["target_weight"]), f"WITH {_TW_SQL}, {halve('tw', 'hv')} SELECT date, address, round(target_weight, 6) + 0e0 AS target_weight FROM hv")
    rules = f"""{both}, {loss}, capped AS (SELECT * REPLACE (greatest(-0.15e0, least(0.15e0, target_weight)) AS target_weight) FROM lossy), sect AS (SELECT * REPLACE (target_weight * CASE WHEN total > 0.4 THEN 0.4e0 / total ELSE 1e0 END AS target_weight) FROM (SELECT *, sum(abs(target_weight)) OVER (PARTITION BY date, sector) AS total FROM capped)),
    vol AS (SELECT time AS date, stddev_pop(pnl) OVER w * sqrt(52e0) AS vol, count(*) OVER w AS n FROM pf WHERE formula_id = 'fa' WINDOW w AS (ORDER BY time ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), calmed AS (SELECT s.* REPLACE (target_weight * CASE WHEN n >= 20 AND vol > 0.225 THEN 0.15e0 / vol ELSE 1e0 END AS target_weight) FROM sect s LEFT JOIN vol USING (date)), {halve('calmed', 'hv')}"""
    filtered = lambda s, d: rk.risk_filter(tw(s, d), state(s, d), daily_ret(s, d), 52.0)
    add("k8_risk_filter", lambda s, d: cols(filtered(s, d)[0], key, ["target_weight"]), f"WITH {rules} SELECT date, address, round(target_weight, 6) + 0e0 AS target_weight FROM hv")
    steps = [("loss", "tw", "lossy"), ("position", "lossy", "capped"), ("sector", "capped", "sect"), ("volatility", "sect", "calmed"), ("correlation", "calmed", "hv")]
    add("k8_adjustments", lambda s, d: cols(filtered(s, d)[1], [*key, "rule"], ["before", "after"]), f"WITH {rules} " + " UNION ALL ".join(f"SELECT date, address, '{rule}' AS rule, round(a.target_weight, 6) + 0e0 AS before, round(b.target_weight, 6) + 0e0 AS after FROM {x} a JOIN {y} b USING (date, address) WHERE abs(a.target_weight - b.target_weight) > 1e-12" for rule, x, y in steps))
    add("k9_small_capital_topn", lambda s, d: cols(rk.small_capital_topn(tw(s, d), 50000.0, 4), ["date", "address", "side", "place", "lots", "stop_loss"], ["weight"], 4), f"""WITH {_TW_SQL}, a AS (SELECT *, CASE WHEN target_weight > 0 THEN 'long' ELSE 'short' END AS side FROM tw WHERE margin > 0 AND margin <= 10000 AND abs(target_weight) > 0.01), b AS (SELECT *, row_number() OVER (PARTITION BY date, side, sector ORDER BY abs(target_weight) DESC, address) AS s FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY date, side ORDER BY abs(target_weight) DESC, address) AS place FROM b WHERE s <= 2), e AS (SELECT *, greatest(1, floor(30000 / count(*) OVER (PARTITION BY date) / margin)::INT) AS lots FROM c WHERE place <= 4)
    SELECT date, address, side, place::INT AS place, lots, 1500e0 AS stop_loss, round(CASE side WHEN 'long' THEN 1 ELSE -1 END * lots * margin / 50000, 4) + 0e0 AS weight FROM e""")  # fmt: skip
    pick = "pk0 AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY abs(target_weight) DESC, address) AS s FROM tw), pk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(target_weight) DESC, address) AS place FROM pk0 WHERE s <= 2)"
    add("k10_pick_topn_diversified", lambda s, d: rk.pick_topn(tw(s, d), 6).select("date", "address", "place"), f"WITH {_TW_SQL}, {pick} SELECT date, address, place::INT AS place FROM pk WHERE place <= 6")

    def delta(s: SparkSession, d: str) -> DataFrame:
        lots = fixtures.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("address")).agg(F.sum((F.col("l_returnflag") == "A").cast("int")).alias("t"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("c"))
        return rk.position_delta(lots.where("t % 3 <> 0").select("address", F.col("t").alias("lots")), lots.where("c % 5 <> 0").select("address", F.col("c").alias("lots")))

    add("k11_position_delta", delta, "WITH l AS (SELECT l_suppkey AS address, sum((l_returnflag = 'A')::INT) AS t, sum((l_returnflag = 'R')::INT) AS c FROM lineitem GROUP BY 1), x AS (SELECT address, CASE WHEN t % 3 <> 0 THEN t ELSE 0 END - CASE WHEN c % 5 <> 0 THEN c ELSE 0 END AS delta FROM l) SELECT address, delta::BIGINT AS delta FROM x WHERE delta <> 0")

    of = lambda place, kind: "CASE mode " + " ".join(f"WHEN '{m[0]}' THEN {kind(m[place])}" for m in rk.MODES) + " END"
    rep_sql = f"""{sql.positions_sql()}, {_WEIGHTS_SQL}, {_MEAN_SQL}, {_SECTORS_SQL}, {_MWU_SQL}, {g_sql[len(fixtures.PANEL_SQL) + 2:]}, rg AS (SELECT time, scale, {_REGIME_SQL} AS regime FROM scaled_regime),
    lv AS (SELECT formula_id, time, 1 / (coalesce(stddev_samp(m) OVER (PARTITION BY formula_id ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) + 1e-10) AS inv FROM (SELECT formula_id, time, avg(signal) AS m FROM runs GROUP BY formula_id, time)),
    lw AS (SELECT lv.formula_id, lv.time, l.weight, CASE WHEN regime = 'crisis' THEN 0.6e0 * inv / sum(inv) OVER (PARTITION BY lv.time) + 0.4e0 * l.weight ELSE l.weight END AS mix FROM lv JOIN rg USING (time) JOIN qi ON qi.period = date_trunc('quarter', lv.time)::DATE JOIN learned l ON l.t = qi.t - 1 AND l.formula_id = lv.formula_id),
    bw AS (SELECT false AS mixes, formula_id, time, weight AS w FROM lw UNION ALL SELECT true, formula_id, time, mix FROM lw), mx AS (SELECT mixes, r.time, address, sum(signal * w) AS signal, max(target_ret) AS target_ret, coalesce(max(sector), 'other') AS sector FROM runs r JOIN bw USING (formula_id, time) LEFT JOIN sectors USING (address) GROUP BY mixes, r.time, address),
    rk AS (SELECT *, (row_number() OVER (PARTITION BY mixes, time ORDER BY signal, address) - 1) / greatest(count(*) OVER (PARTITION BY mixes, time) - 1, 1) * 2 - 1 AS rank FROM mx), sd AS (SELECT *, sign(rank) AS side, row_number() OVER (PARTITION BY mixes, time, sign(rank), sector ORDER BY abs(rank) DESC, address) AS s FROM rk WHERE abs(rank) > 0.01),
    hd AS (SELECT *, row_number() OVER (PARTITION BY mixes, time, side ORDER BY abs(rank) DESC, address) AS place FROM sd WHERE s <= 2),
    en0 AS (SELECT m.time, CASE WHEN count(*) OVER c < 2 THEN 0 ELSE greatest(0e0, least(1e0, ((row_number() OVER r - 1) / (count(*) OVER c - 1) - 0.6e0) / 0.4e0)) END * is_safe * target_ret AS pnl FROM mixed m JOIN tgt USING (address, time) WINDOW c AS (PARTITION BY m.time), r AS (PARTITION BY m.time ORDER BY m.signal, m.address)),
    en1 AS (SELECT time, lag(pnl) OVER (ORDER BY time) AS pnl FROM (SELECT time, avg(pnl) AS pnl FROM en0 GROUP BY time)), lg AS (SELECT time, CASE WHEN count(pnl) OVER w >= 20 AND avg(pnl) OVER w / (stddev_pop(pnl) OVER w + 1e-10) * sqrt(52e0) < -0.5 THEN 0.5e0 ELSE 1e0 END AS legacy FROM en1 WINDOW w AS (ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    md AS (SELECT mode, {of(1, lambda x: f"'{x}'" if x else "NULL")} AS scaled_by, {of(2, str)} AS use_topn, {of(3, lambda x: f"'{x}'")} AS weighting, {of(4, str)} AS mixes FROM (SELECT unnest({[m[0] for m in rk.MODES]}) AS mode)),
    rp AS (SELECT mode, time, sum(side * target_ret * w * size) / sum(w) AS pnl FROM (SELECT mode, time, side, target_ret, CASE weighting WHEN 'strength' THEN abs(rank) ELSE 1e0 END AS w, CASE scaled_by WHEN 'market' THEN scale WHEN 'legacy' THEN legacy ELSE 1e0 END AS size
      FROM hd JOIN md USING (mixes) JOIN rg USING (time) JOIN lg USING (time) WHERE place <= CASE WHEN use_topn AND regime = 'crisis' THEN greatest(2, floor(4 * scale)::INT) WHEN use_topn AND regime = 'calm' THEN 6 ELSE 4 END) GROUP BY mode, time)"""
    add("v1_replay_backtest", lambda s, d: cols(replayed(s, d), ["mode", "time"], ["pnl"]), f"WITH RECURSIVE {rep_sql} SELECT mode, time, round(pnl, 6) + 0e0 AS pnl FROM rp")
    values = ["total", "sharpe", "win_rate", "max_drawdown", "best", "worst"]
    add("v2_performance_summary", lambda s, d: cols(rk.performance_summary(replayed(s, d), ["mode"], 52.0), ["mode"], values, 5), f"WITH RECURSIVE {rep_sql}, c AS (SELECT *, sum(pnl) OVER (PARTITION BY mode ORDER BY time ROWS UNBOUNDED PRECEDING) AS s FROM rp), t AS (SELECT *, max(s) OVER (PARTITION BY mode ORDER BY time ROWS UNBOUNDED PRECEDING) AS top, CASE WHEN abs(pnl) > 1e-12 THEN pnl END AS live FROM c) SELECT mode, round(sum(pnl), 5) + 0e0 AS total, round(avg(live) / (stddev_pop(live) + 1e-8) * sqrt(52e0), 5) + 0e0 AS sharpe, round(avg((live > 0)::INT), 5) + 0e0 AS win_rate, round(max(top - s), 5) + 0e0 AS max_drawdown, round(max(pnl), 5) + 0e0 AS best, round(min(pnl), 5) + 0e0 AS worst FROM t GROUP BY mode")
    add(
        "v3_decay_triggers", lambda s, d: rk.decay_triggers(portfolio(s, d), per_year=WEEKLY.bars_per_year).select("formula_id", "time", "level"),
        f"""WITH RECURSIVE {sql.PNL_SQL}, d1 AS (SELECT *, row_number() OVER (PARTITION BY formula_id ORDER BY time) AS t, avg(pnl) OVER w / (stddev_pop(pnl) OVER w + 1e-8) * sqrt(52e0) AS ratio FROM pf WINDOW w AS (PARTITION BY formula_id ORDER BY time ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
        d2 AS (SELECT *, (t >= 60 AND ratio < 0)::INT AS bad FROM d1), d3 AS (SELECT *, sum(1 - bad) OVER (PARTITION BY formula_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS island FROM d2), d4 AS (SELECT *, sum(bad) OVER (PARTITION BY formula_id, island ORDER BY time ROWS UNBOUNDED PRECEDING) AS streak FROM d3),
        hit AS (SELECT formula_id, time, t, CASE WHEN ratio < -1.5 THEN 3 WHEN ratio < -0.5 THEN 2 ELSE 1 END AS level, row_number() OVER (PARTITION BY formula_id ORDER BY t) AS k FROM d4 WHERE streak >= 10),
        seen AS (
          SELECT formula_id, 0::BIGINT AS k, NULL::DATE AS time, 0 AS level, false AS keep, -1000000000::BIGINT AS last FROM (SELECT DISTINCT formula_id FROM hit)
          UNION ALL
          SELECT h.formula_id, h.k, h.time, h.level, h.t - s.last >= 30, CASE WHEN h.t - s.last >= 30 AND h.level > 1 THEN h.t ELSE s.last END FROM seen s JOIN hit h ON h.formula_id = s.formula_id AND h.k = s.k + 1
        ) SELECT formula_id, time, level FROM seen WHERE keep""",
    )

    def plan(s: SparkSession, d: str) -> DataFrame:
        board = leaderboard(s, d, CANDIDATES).select("formula_id", F.round("fitness", 6).alias("fitness"))
        recent = en.recent_sharpe(gross(s, d), 60, 52.0)
        return rk.update_plan(factor_quality(s, d), in_use(s), recent, board, 3)

    add("v4_update_plan", plan, f"""WITH b AS (SELECT * FROM (WITH {sql.fitness_sql(CANDIDATES, DIGITS)} SELECT formula_id, row_number() OVER (ORDER BY round(fitness, 6) DESC, formula_id) AS place FROM fit)),
    r AS (SELECT *, row_number() OVER (ORDER BY sharpe, formula_id) AS place FROM (WITH {sql.positions_sql()}, {recent_sql} SELECT * FROM recents WHERE sharpe < 0)), w AS (SELECT * FROM (WITH {factor_sql} SELECT place, "out", "in" FROM swaps WHERE place <= 2))
    SELECT 'factor' AS kind, place, "out", "in" FROM w UNION ALL SELECT 'formula', place::INT, r.formula_id, b.formula_id FROM r JOIN b USING (place)""")  # fmt: skip
    add("v5_compare_feature_sets", lambda s, d: cols(rk.compare_feature_sets(bt.sharpe(KEYS, portfolio(s, d), WEEKLY).withColumnRenamed("formula_id", "feature_set"), "fa"), ["feature_set", "verdict"], ["sharpe", "delta"]), f"WITH {sql.PNL_SQL}, {sql.SHARPE_SQL}, b AS (SELECT sharpe AS base FROM sharpes WHERE formula_id = 'fa') SELECT formula_id AS feature_set, CASE WHEN sharpe - base > 0.1 THEN 'better' WHEN sharpe - base < -0.1 THEN 'worse' ELSE 'same' END AS verdict, round(sharpe, 6) + 0e0 AS sharpe, round(sharpe - base, 6) + 0e0 AS delta FROM sharpes, b")
    add("rg_compute_factors", lambda s, d: cols(features(s, d), ["address", "time"], sql.FEATURES, 4), f"WITH {sql.FEATURES_SQL} SELECT address, time, {', '.join(f'round({n}, 4) + 0e0 AS {n}' for n in sql.FEATURES)} FROM feats")
