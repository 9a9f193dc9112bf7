"""Ensembles of formulas: weights, folds, selection, and weights learned online.

``signals`` are (formula_id, address, time, signal).  What grows with history is aggregated by Spark;
only the recursion over periods of a few formulas runs as a grouped map, one group a run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import settled
from .pairs import pairwise


def valid_formulas(signals: DataFrame, least: float = 1e-8) -> DataFrame:
    """Formulas whose signal varies (sample deviation over all)."""
    return signals.groupBy("formula_id").agg(F.stddev_samp("signal").alias("spread")).where(F.col("spread") >= least).select("formula_id")


def predict_individual(signals: DataFrame) -> DataFrame:
    return signals.join(valid_formulas(signals), "formula_id", "left_semi")


def ensemble_mean(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """(address, time, signal): weighted mean over valid formulas, weights renormalised."""
    joined = predict_individual(signals).join(weights, "formula_id")
    return joined.groupBy("address", "time").agg((F.sum(F.col("weight") * F.col("signal")) / F.sum("weight")).alias("signal"))


def ensemble_rank_mean(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """As the mean, of each formula's rank over time by address, from 0 to 1."""
    w = Window.partitionBy("formula_id", "address")
    rank = (F.row_number().over(w.orderBy(F.round("signal", 9), "time")) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))
    return ensemble_mean(signals.withColumn("signal", rank), weights)


def folds(spark: SparkSession, times: int, n: int, gap: int = 0, rolling: bool = False, least: int = 5) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end), ends exclusive; the last fold takes what is left.

    Training ends ``gap`` bars before the test starts, whose start is moved by the gap as well.
    """
    size = times // (n + 1)
    if n < 1 or size - gap < least:
        raise ValueError(f"{times} times are too few for {n} folds")
    rows = []
    for k in range(n):
        start = (k + 1) * size + gap
        stop = times if k == n - 1 else (k + 2) * size
        rows.append((k, max(0, start - gap - size) if rolling else 0, start - gap, start, stop))
    return spark.createDataFrame(rows, "fold int, train_start int, train_end int, test_start int, test_end int")


def fold_panels(panel: DataFrame, fold_table: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of each fold's test part, with ``fold`` and an address of its own for each fold, so that every window restarts there.

    ``index`` is (time, t).  Test parts don't overlap, so windows over a time stay inside a fold too.
    """
    own = F.concat_ws("|", F.lpad(F.col("fold").cast("string"), 4, "0"), "address")
    rows = panel.join(index, "time").join(F.broadcast(fold_table), (F.col("t") >= F.col("test_start")) & (F.col("t") < F.col("test_end")))  # a few folds
    return rows.withColumn("address", own).drop("t", "train_start", "train_end", "test_start", "test_end")


def cv_evaluate(pnl: DataFrame, per_year: float) -> DataFrame:
    """By run and fold, Sharpe ratio, drawdown and turnover of the test part; ``pnl`` has fold, and its windows restarted there."""
    w = Window.partitionBy("formula_id", "fold").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    line = pnl.withColumn("_sum", F.sum("pnl").over(w)).withColumn("_top", F.max("_sum").over(w))
    return line.groupBy("formula_id", "fold").agg(
        (F.avg("pnl") / (F.coalesce(F.stddev_samp("pnl"), F.lit(0.0)) + 1e-8) * per_year**0.5).alias("sharpe"), F.max(F.col("_top") - F.col("_sum")).alias("max_drawdown"), F.avg("turnover").alias("turnover"), F.count(F.lit(1)).alias("n")
    )


def cv_vs_single_split(by_fold: DataFrame, single: DataFrame) -> DataFrame:
    """Mean and deviation over folds against a single split's Sharpe; overfit if the split is better by over 0.3."""
    agg = by_fold.groupBy("formula_id").agg(F.avg("sharpe").alias("cv_mean"), F.stddev_pop("sharpe").alias("cv_std"))
    out = agg.join(single.select("formula_id", F.col("sharpe").alias("single")), "formula_id")
    return out.withColumns({"difference": F.col("single") - F.col("cv_mean"), "overfit": F.col("single") - F.col("cv_mean") > 0.3, "robustness": F.col("cv_mean") / (F.col("cv_std") + 1e-8)})


def select_factors(quality: DataFrame, pairs: DataFrame, top_n: int, min_icir: float = 0.05, max_corr: float = 0.7) -> DataFrame:
    """(formula_id, place): names by falling ICIR, without any that correlates too much with a better one that is chosen.

    The choice is greedy, ``top_n`` rounds at most: the best name left is taken, and the names close to it are
    struck off by a join with its own pairs.  The driver learns one name a round; ties go to the smaller name.
    """
    spark = quality.sparkSession
    left = settled(quality.where(F.col("icir") >= min_icir).select("formula_id", "icir"), "names")
    near = pairs.where(F.abs("corr") > max_corr).select("a", "b")
    near = settled(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near")
    chosen: list[tuple[str, int]] = []
    while len(chosen) < top_n and (best := left.orderBy(F.desc("icir"), "formula_id").select("formula_id").first()):
        chosen.append((best[0], len(chosen) + 1))
        close = near.where(F.col("a") == best[0]).select(F.col("b").alias("formula_id"))
        left = left.where(F.col("formula_id") != best[0]).join(close, "formula_id", "left_anti")
        if len(chosen) % 4 == 0:  # else every round would repeat the joins of those before
            left = settled(left, "names")
    return spark.createDataFrame(chosen, "formula_id string, place int")


def signal_pairs(signals: DataFrame) -> DataFrame:
    """(a, b, corr) of all pairs of formulas over the panel."""
    return pairwise(signals, ["address", "time"], "formula_id", "signal").select("a", "b", "corr")


def swap_factors(current: DataFrame, quality: DataFrame, n: int) -> DataFrame:
    """(place, out, in): the ``n`` worst current names against the best others by ICIR, as many as there are others.

    A current name without a quality counts as 0.
    """
    one = Window.partitionBy(F.lit(0))  # a row for each factor
    own = current.select("formula_id").join(quality.select("formula_id", "icir"), "formula_id", "left").withColumn("icir", F.coalesce("icir", F.lit(0.0)))
    worst = own.withColumn("place", F.row_number().over(one.orderBy("icir", "formula_id"))).where(F.col("place") <= n)
    others = quality.join(current.select("formula_id"), "formula_id", "left_anti")
    best = others.withColumn("place", F.row_number().over(one.orderBy(F.desc("icir"), "formula_id"))).where(F.col("place") <= n)
    return worst.select("place", F.col("formula_id").alias("out")).join(best.select("place", F.col("formula_id").alias("in")), "place")


def recent_sharpe(gross: DataFrame, bars: int = 60, per_year: float = 252.0) -> DataFrame:
    """Sharpe of each formula's last bars, before costs; -999 where the signal doesn't vary (``spread`` of 1e-8 at most).

    ``gross`` has formula_id, time, the mean of position times target (``pnl``) and the signal's ``spread``.
    """
    last = gross.withColumn("_k", F.row_number().over(Window.partitionBy("formula_id").orderBy(F.desc("time")))).where(F.col("_k") <= bars)
    ratio = F.avg("pnl") / (F.coalesce(F.stddev_samp("pnl"), F.lit(0.0)) + 1e-10) * per_year**0.5
    return last.groupBy("formula_id").agg(F.when(F.max("spread") > 1e-8, ratio).otherwise(-999.0).alias("sharpe"))


def formula_pnl_panel(positions: DataFrame, period: Column) -> DataFrame:
    """(formula_id, period, pnl): mean of position times target."""
    return positions.groupBy("formula_id", period.alias("period")).agg(F.avg(F.col("position") * F.col("target_ret")).alias("pnl"))


def _mwu(gains: np.ndarray, weights: np.ndarray, eta: float, floor: float) -> np.ndarray:
    top = np.abs(gains).max()
    if top < 1e-12:
        return weights
    weights = np.maximum(weights * (1 + eta * gains / top), floor)
    return weights / weights.sum()


def _ema(history: np.ndarray, weights: np.ndarray, decay: float, blend: float, floor: float) -> np.ndarray:
    age = decay ** np.arange(len(history))[::-1]
    mean = (history * age[:, None]).sum(0) / age.sum()
    z = mean / (mean.std() + 1e-8)
    soft = np.exp(z - z.max())
    weights = (1 - blend) * weights + blend * soft / soft.sum()
    for _ in range(10):
        if weights.min() >= floor:
            break
        weights = np.maximum(weights, floor)
        weights = weights / weights.sum()
    return weights


def learned_rate(eta: float | None, n: int, lookback: int) -> float:
    """``eta``, or the rate by rule where it is null."""
    return eta if eta is not None else float(np.sqrt(np.log(max(n, 2)) / max(10 * lookback, 100)))


def learned_step(strategy: str, past: np.ndarray, weights: np.ndarray, eta: float, floor: float) -> np.ndarray:
    """The weights after a period; ``past`` has its pnl last, after those of the periods before."""
    return _mwu(past.mean(0), weights, eta, floor) if strategy == "mwu" else _ema(past, weights, 0.9, 0.3, floor)


def online_weights(panel: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, period, formula_id, weight): weights after each period, of every run of the parameter table.

    ``panel`` is (formula_id, period, pnl), one number a formula and period; ``runs`` has run_id, strategy
    ("mwu" or "ema"), eta (null: by rule), floor, lookback, warmup.  Runs share one pass over the panel.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p = frame.iloc[0]
        wide = frame.pivot(index="period", columns="formula_id", values="pnl").sort_index().fillna(0.0)
        n = wide.shape[1]
        eta = learned_rate(p["eta"] if pd.notna(p["eta"]) else None, n, p["lookback"])
        weights, out = np.full(n, 1 / n), []
        values = wide.to_numpy()
        for t in range(len(values)):
            if t >= p["warmup"]:
                past = values[max(0, t - int(p["lookback"]) + 1) : t + 1]
                weights = learned_step(p["strategy"], past, weights, eta, p["floor"])
            out.append(pd.DataFrame({"run_id": p["run_id"], "period": wide.index[t], "formula_id": wide.columns, "weight": weights}))
        return pd.concat(out)

    return panel.crossJoin(F.broadcast(runs)).groupBy("run_id").applyInPandas(run, "run_id string, period date, formula_id string, weight double")  # a table of parameters


def online_pnl(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """By run: Sharpe-like ratio of the weighted pnl with the weights of the period before, and of equal weights."""
    w = Window.partitionBy("run_id", "formula_id").orderBy("period")
    before = weights.withColumn("weight", F.lag("weight").over(w)).where("weight IS NOT NULL")
    by = before.join(panel, ["formula_id", "period"]).groupBy("run_id", "period").agg(F.sum(F.col("weight") * F.col("pnl")).alias("online"), F.avg("pnl").alias("static"))
    ratio = lambda c: F.avg(c) / (F.stddev_samp(c) + 1e-8)
    return by.groupBy("run_id").agg(F.sum("online").alias("online_pnl"), F.sum("static").alias("static_pnl"), ratio("online").alias("online_ratio"), ratio("static").alias("static_ratio"))


def inverse_vol_mix(signals: DataFrame, weights: DataFrame, share: float = 0.6, rows: int = 20) -> DataFrame:
    """Weights for a crisis: ``share`` by inverse volatility, the rest as they are, renormalised.

    A formula's volatility is that of its mean signal over the last ``rows`` times.
    """
    level = signals.groupBy("formula_id", "time").agg(F.avg("signal").alias("m"))
    last = level.withColumn("_k", F.row_number().over(Window.partitionBy("formula_id").orderBy(F.desc("time")))).where(F.col("_k") <= rows)
    inv = last.groupBy("formula_id").agg((1 / (F.coalesce(F.stddev_samp("m"), F.lit(0.0)) + 1e-10)).alias("inv"))
    all_ = Window.partitionBy(F.lit(0))  # a row for each formula
    mixed = inv.join(weights, "formula_id").withColumn("_w", share * F.col("inv") / F.sum("inv").over(all_) + (1 - share) * F.col("weight"))
    return mixed.select("formula_id", (F.col("_w") / F.sum("_w").over(all_)).alias("weight"))
