"""Positions, costs, and scores of signals.

Frames are long: ``signal`` by (address, time), and by (formula_id, address, time) where many formulas
are scored at once; every score groups by what identifies a run, so one plan serves any number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import settled
from .pairs import median_of_pairs
from .panel import Profile


def _ts(keys: list[str]):
    return Window.partitionBy(*keys, "address").orderBy("time")


def _cs(keys: list[str]):
    return Window.partitionBy(*keys, "time")


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _corr(x: str, y: str) -> Column:
    """Pearson correlation, null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _plain(x: Column) -> Column:
    return _clip(_sigmoid(x) - 0.5, 0.0, 0.5) * 2


def _top_share(x: Column, rank: Column, n: Column) -> Column:
    """The position of mode ``rank`` from the value's place, counted from 0, among ``n``."""
    return F.when(n < 2, _plain(x)).otherwise(_clip((rank / (n - 1) - 0.6) / 0.4, 0.0, 1.0))


def position(df: DataFrame, mode: str = "rank", keys: list[str] | None = None, signal: str = "signal") -> DataFrame:
    """Adds ``position`` by one of the modes; ``is_safe`` (0/1) multiplies it where the column exists.

    sigmoid, rank (top two fifths, linear), zscore (cross-section), quantile (top quarter in two steps),
    long_short (fifths), sign.  Cross-sections too small for a mode use the sigmoid.
    """
    keys = keys or []
    x = F.col(signal)
    safe = F.col("is_safe").cast("double") if "is_safe" in df.columns else F.lit(1.0)
    n = F.count(F.lit(1)).over(_cs(keys))
    rank = F.row_number().over(_cs(keys).orderBy(signal, "address")) - 1
    share = rank / (n - 1)
    plain = _plain(x)
    z = (x - F.avg(x).over(_cs(keys))) / (F.coalesce(F.stddev_samp(x).over(_cs(keys)), F.lit(0.0)) + 1e-6)
    modes = {
        "sigmoid": plain,
        "rank": _top_share(x, rank, n),
        "zscore": F.when(n < 2, plain).otherwise(_sigmoid(1.5 * z)),
        "quantile": F.when(n < 5, plain).otherwise(F.when(share >= 0.9, 1.0).when(share >= 0.75, 0.5).otherwise(0.0)),
        "long_short": F.when(share >= 0.8, 1.0).when(share <= 0.2, -1.0).otherwise(0.0),
        "sign": F.signum(x),
    }
    return df.withColumn("position", (modes[mode] * safe).cast("double"))


def liquidity_mask(df: DataFrame, profile: Profile) -> DataFrame:
    return df.withColumn("is_safe", (F.col("liquidity") > profile.min_liquidity).cast("double"))


def hold_between_rebalances(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The position of the last rebalance bar; bars before the first take the first one's."""
    w = _ts(keys or [])
    held = F.when(F.col("is_rebalance"), F.col("position"))
    past = F.last(held, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(held, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # only asked for before it
    return df.withColumn("position", F.coalesce(past, first, F.lit(0.0)))


def net_pnl(df: DataFrame, profile: Profile, keys: list[str] | None = None) -> DataFrame:
    """Adds turnover, cost and pnl: position times target_ret, less fee and impact on what changes hands."""
    before = F.lag("position", 1, 0.0).over(_ts(keys or []))
    out = df.withColumn("turnover", F.abs(F.col("position") - before))
    rate = profile.base_fee + _clip(profile.trade_size / (F.col("liquidity") + 1e-9), 0.0, 0.05)
    out = out.withColumn("cost", F.col("turnover") * rate)
    return out.withColumn("pnl", F.col("position") * F.col("target_ret") - F.col("cost"))


def portfolio_pnl(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean pnl and turnover over addresses, by time."""
    return df.groupBy(*(keys or []), "time").agg(F.avg("pnl").alias("pnl"), F.avg("turnover").alias("turnover"))


def sharpe(keys: list[str], pnl: DataFrame, profile: Profile) -> DataFrame:
    return pnl.groupBy(*keys).agg((F.avg("pnl") / (F.coalesce(F.stddev_samp("pnl"), F.lit(0.0)) + 1e-8) * profile.bars_per_year**0.5).alias("sharpe"))


def max_drawdown(keys: list[str], pnl: DataFrame) -> DataFrame:
    """Largest fall of the cumulative sum from its maximum so far."""
    w = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    total = pnl.withColumn("_sum", F.sum("pnl").over(w)).withColumn("_top", F.max("_sum").over(w))
    return total.groupBy(*keys).agg(F.max(F.col("_top") - F.col("_sum")).alias("max_drawdown"))


def rank_ic_by_time(df: DataFrame, keys: list[str] | None = None, signal: str = "signal") -> DataFrame:
    """Spearman correlation of signal and target over addresses, by time (addresses decide ties)."""
    keys = keys or []
    a = F.row_number().over(_cs(keys).orderBy(signal, "address")).cast("double")
    b = F.row_number().over(_cs(keys).orderBy("target_ret", "address")).cast("double")
    ranked = df.withColumns({"_a": a, "_b": b})
    return ranked.groupBy(*keys, "time").agg(F.coalesce(_corr("_a", "_b"), F.lit(0.0)).alias("ic"), F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_samp(signal), F.lit(0.0)).alias("spread"))


def _distinct_places(keys: list[str], signal: str) -> Column:
    """1 at each value of an address's signal that differs from the next smaller one."""
    before = F.lag(signal).over(Window.partitionBy(*keys, "address").orderBy(signal, "time"))
    return F.when(before.isNull() | (before != F.col(signal)), 1).otherwise(0)


def _few_values(by: DataFrame, keys: list[str]) -> Column:
    """Whether the first ten addresses of a run have under five distinct values on average; ``by`` has one row an address."""
    return F.avg(F.when(F.row_number().over(Window.partitionBy(*keys).orderBy("address")) <= 10, F.col("_values"))).over(Window.partitionBy(*keys)) < 5


def rank_ic(df: DataFrame, keys: list[str], signal: str = "signal") -> DataFrame:
    """Mean rank IC; 0 for fewer than two addresses or a flat signal, times 0.3 for one with hardly any values."""
    by = rank_ic_by_time(df, keys, signal)
    ic = by.groupBy(*keys).agg(F.when((F.max("n") < 2) | (F.avg("spread") < 1e-6), 0.0).otherwise(F.avg("ic")).alias("ic"))
    values = df.withColumn("_new", _distinct_places(keys, signal)).groupBy(*keys, "address").agg(F.sum("_new").alias("_values"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("address"))
    few = values.withColumn("_k", place).where("_k <= 10").groupBy(*keys).agg((F.avg("_values") < 5).alias("few"))
    return ic.join(few, keys).select(*keys, (F.col("ic") * F.when(F.col("few"), 0.3).otherwise(1.0)).alias("rank_ic"))


def pearson_ic(df: DataFrame, keys: list[str], signal: str = "signal", least: int = 10, rows: int = 132, days: int = 20) -> DataFrame:
    """Mean and stability (ICIR) of the Pearson correlation by time, over values that are not zero.

    Times are the last ``rows`` but the very last; a time counts with over ``least`` values, a run with at
    least ``days`` times.
    """
    times = df.select("time").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("time")))).where(f"_k BETWEEN 2 AND {rows}")  # one row a time
    by = df.join(F.broadcast(times.select("time")), "time", "left_semi").where(F.abs(F.col(signal)) > 1e-10)  # ``rows`` times at most
    by = by.groupBy(*keys, "time").agg(_corr(signal, "target_ret").alias("ic"), F.count(F.lit(1)).alias("n"))
    by = by.where(F.col("n") > least).where("ic IS NOT NULL AND NOT isnan(ic)")
    out = by.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), (F.abs(F.avg("ic")) / (F.stddev_pop("ic") + 1e-10)).alias("icir"), F.count(F.lit(1)).alias("n_times"))
    return out.where(F.col("n_times") >= days)


def rank_ic_report(df: DataFrame, keys: list[str], signal: str = "signal") -> DataFrame:
    by = rank_ic_by_time(df, keys, signal).where("n >= 5")
    return by.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), (F.avg("ic") / (F.stddev_samp("ic") + 1e-10)).alias("ir"), F.avg((F.col("ic") > 0).cast("double")).alias("share_positive"))


def factor_autocorrelation(df: DataFrame, keys: list[str], signal: str = "signal", pooled: bool = False) -> DataFrame:
    """Correlation of the signal with its last bar: by address and then averaged, or pooled."""
    pairs = df.withColumn("_before", F.lag(signal).over(_ts(keys))).where("_before IS NOT NULL")
    if pooled:
        return pairs.groupBy(*keys).agg(_corr(signal, "_before").alias("autocorrelation"))
    by = pairs.groupBy(*keys, "address").agg(_corr(signal, "_before").alias("c")).where("c IS NOT NULL AND NOT isnan(c)")
    return by.groupBy(*keys).agg(F.avg("c").alias("autocorrelation"))


def redundancy_penalty(df: DataFrame, bases: list[str], keys: list[str], signal: str = "signal") -> DataFrame:
    """For each address two for each base column whose Spearman correlation over time with the signal exceeds 0.7; mean over addresses."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys, "address").orderBy(c, "time")).cast("double")
    ranked = df.withColumns({"_s": rank(signal)} | {f"_b{i}": rank(b) for i, b in enumerate(bases)})
    penalty = sum((F.when(F.abs(_corr("_s", f"_b{i}")) > 0.7, 2.0).otherwise(0.0) for i in range(len(bases))), F.lit(0.0))
    by = ranked.groupBy(*keys, "address").agg(penalty.alias("redundancy"))
    return by.groupBy(*keys).agg(F.avg("redundancy").alias("redundancy"))


def _by_address(df: DataFrame, profile: Profile) -> dict[str, Column]:
    """Aggregates of an address: laziness penalty, turnover bonus, active bars and bars.

    The turnover is that of a bar, or of a rebalance where not every bar is one.
    """
    turnover = F.avg("turnover")
    if "is_rebalance" in df.columns:
        marks = F.sum(F.col("is_rebalance").cast("int"))
        turnover = F.when(marks < F.count(F.lit(1)), F.sum("turnover") / F.greatest(marks, F.lit(1))).otherwise(turnover)
    target = profile.target_turnover
    lazy = F.when(turnover < profile.lazy_turnover, 3.0).when(turnover < target, (target - turnover) / target * 2).otherwise(0.0)
    return {"lazy": lazy, "bonus": _clip(5 * turnover, 0.0, 0.5), "live": F.sum((F.col("position") > 0.05).cast("int")), "bars": F.count(F.lit(1))}


def activity(df: DataFrame, keys: list[str], profile: Profile) -> DataFrame:
    """Share of positions over 0.05, and the means over addresses of laziness penalty and turnover bonus."""
    by = df.groupBy(*keys, "address").agg(*[c.alias(n) for n, c in _by_address(df, profile).items()])
    return by.groupBy(*keys).agg((F.sum("live") / F.sum("bars")).alias("active"), F.avg("lazy").alias("lazy_penalty"), F.avg("bonus").alias("turnover_bonus"))


def fitness(df: DataFrame, keys: list[str], profile: Profile, length: DataFrame | None = None, base: str | None = None, signal: str = "signal") -> DataFrame:
    """The score of each run: Sharpe, drawdown, length, redundancy, laziness, turnover and rank IC in one number.

    A run with under five in a hundred positions active scores -10, plus the IC term, which counts in any case.
    ``length`` has the keys and a length; ``base`` is the column that signals should not repeat.  One pass by time
    and one by address serve all terms.
    """
    ranked = df.withColumns({"_a": F.row_number().over(_cs(keys).orderBy(signal, "address")).cast("double"), "_b": F.row_number().over(_cs(keys).orderBy("target_ret", "address")).cast("double")})
    times = ranked.groupBy(*keys, "time").agg(
        F.avg("pnl").alias("pnl"), F.coalesce(_corr("_a", "_b"), F.lit(0.0)).alias("ic"), F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_samp(signal), F.lit(0.0)).alias("spread")
    )
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys, "address").orderBy(c, "time")).cast("double")
    placed = df.withColumns({"_s": rank(signal), "_new": _distinct_places(keys, signal)} | ({"_r": rank(base)} if base else {}))
    repeats = F.when(F.abs(_corr("_s", "_r")) > 0.7, 2.0).otherwise(0.0) if base else F.lit(0.0)
    by = placed.groupBy(*keys, "address").agg(*[c.alias(n) for n, c in _by_address(df, profile).items()], repeats.alias("again"), F.sum("_new").alias("_values"))
    return _fitness(times, by, keys, profile, length)


def _fitness(times: DataFrame, by: DataFrame, keys: list[str], profile: Profile, length: DataFrame | None) -> DataFrame:
    """The score from a row for each run and time, and one for each run and address."""
    w = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    line = times.withColumn("_sum", F.sum("pnl").over(w)).withColumn("_top", F.max("_sum").over(w))
    one = line.groupBy(*keys).agg(
        (F.avg("pnl") / (F.coalesce(F.stddev_samp("pnl"), F.lit(0.0)) + 1e-8) * profile.bars_per_year**0.5).alias("sharpe"), F.max(F.col("_top") - F.col("_sum")).alias("max_drawdown"),
        F.when((F.max("n") < 2) | (F.avg("spread") < 1e-6), 0.0).otherwise(F.avg("ic")).alias("_ic"),
    )
    by = by.withColumn("_few", _few_values(by, keys))
    two = by.groupBy(*keys).agg(
        (F.sum("live") / F.sum("bars")).alias("active"), F.avg("lazy").alias("lazy_penalty"), F.avg("bonus").alias("turnover_bonus"), F.avg("again").alias("redundancy"), F.max("_few").alias("_few")
    )
    out = one.join(two, keys).withColumn("rank_ic", F.col("_ic") * F.when(F.col("_few"), 0.3).otherwise(1.0)).drop("_ic", "_few")
    extra = F.lit(0.0)
    if length is not None:
        out = out.join(length.select(*keys, F.col("length").alias("_length")), keys)
        extra = 0.1 * F.greatest(F.lit(0), F.col("_length") - 6)
    score = F.col("sharpe") - 2 * F.col("max_drawdown") - extra - F.col("redundancy") - F.col("lazy_penalty") + F.col("turnover_bonus")
    score = F.when(F.col("active") < 0.05, -10.0).otherwise(F.coalesce(F.nanvl(score, F.lit(-10.0)), F.lit(-10.0)))
    return out.withColumn("fitness", score + 2 * _clip(F.col("rank_ic"), -0.3, 0.3)).drop("_length")


def fitness_of(panel: DataFrame, signals: list[str], profile: Profile, length: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """``fitness`` of rank positions held between rebalances, of many signals that are columns of a panel (formula_id names each).

    Signals stay beside each other, and a row moves twice whatever their number: to its time, for all ranks, and to its
    address, for what is held, what it earns and what it repeats.  What a time tells is written on its first row.  Positions
    travel on rebalance bars only, as no other is held.
    """
    at, own = Window.partitionBy("time"), Window.partitionBy("address")
    line = own.orderBy("time")
    each = list(enumerate(signals))
    place = lambda w, c, then: F.row_number().over(w.orderBy(c, then)).cast("double")
    out = panel.withColumns({f"_a{i}": place(at, s, "address") for i, s in each} | {"_b": place(at, "target_ret", "address"), "_n": F.count(F.lit(1)).over(at)})
    n, middle = F.col("_n"), (F.col("_n") + 1) / 2
    told = lambda x: F.when(F.col("_b") == 1, x)
    # both ranks are 1 to n, so their variances are known
    ic = lambda i: F.when(n < 2, 0.0).otherwise(F.sum((F.col(f"_a{i}") - middle) * (F.col("_b") - middle)).over(at) / (n * (n * n - 1) / 12))
    out = out.withColumns(
        {f"_ic{i}": told(ic(i)) for i, _ in each} | {f"_spread{i}": told(F.coalesce(F.stddev_samp(s).over(at), F.lit(0.0))) for i, s in each}
        | {f"_p{i}": F.when(F.col("is_rebalance"), (_top_share(F.col(s), F.col(f"_a{i}") - 1, n) * F.col("is_safe").cast("double")).cast("double")) for i, s in each}
    )
    out = out.select("address", "time", "is_rebalance", "liquidity", "target_ret", *([F.col(base).alias("_base")] if base else []), told(n).alias("n"), *signals, *[f"{c}{i}" for i, _ in each for c in ("_ic", "_spread", "_p")])
    past, whole = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = {f"_p{i}": F.coalesce(F.last(f"_p{i}", ignorenulls=True).over(past), F.first(f"_p{i}", ignorenulls=True).over(whole), F.lit(0.0)) for i, _ in each}
    out = out.withColumns(held)
    out = out.withColumns({f"_t{i}": F.abs(F.col(f"_p{i}") - F.lag(f"_p{i}", 1, 0.0).over(line)) for i, _ in each})
    out = out.withColumns({f"_s{i}": place(own, s, "time") for i, s in each} | {f"_new{i}": _distinct_places([], s) for i, s in each} | ({"_r": place(own, "_base", "time")} if base else {}))
    rate = profile.base_fee + _clip(profile.trade_size / (F.col("liquidity") + 1e-9), 0.0, 0.05)
    parts = {"position": "_p", "turnover": "_t", "ic": "_ic", "spread": "_spread", "_s": "_s", "_new": "_new"}
    runs = F.array(*[F.struct(F.lit(s).alias("formula_id"), *[F.col(f"{c}{i}").alias(k) for k, c in parts.items()]) for i, s in each])
    runs = out.select("address", "time", "is_rebalance", "target_ret", "n", rate.alias("rate"), *(["_r"] if base else []), F.explode(runs).alias("_run"))
    runs = runs.select("_run.*", *[c for c in runs.columns if c != "_run"]).withColumn("pnl", F.col("position") * F.col("target_ret") - F.col("turnover") * F.col("rate"))
    repeats = F.when(F.abs(_corr("_s", "_r")) > 0.7, 2.0).otherwise(0.0) if base else F.lit(0.0)
    run, address, time = (F.col(c) for c in ("formula_id", "address", "time"))
    sums = runs.groupingSets([[run, address], [run, time]], run, address, time).agg(
        F.grouping("address").alias("_by_time"), F.avg("pnl").alias("pnl"), F.max("ic").alias("ic"), F.max("n").alias("n"), F.max("spread").alias("spread"),
        *[c.alias(k) for k, c in _by_address(runs, profile).items()], repeats.alias("again"), F.sum("_new").alias("_values"),
    )
    sums = settled(sums, "sums")  # a row for each signal and time, and for each signal and address
    times = sums.where("_by_time = 1").select("formula_id", "time", "pnl", "ic", "n", "spread")
    by = sums.where("_by_time = 0").drop("_by_time", "time", "pnl", "ic", "n", "spread")
    return _fitness(times, by, ["formula_id"], profile, length)


def yearly_report(pnl: DataFrame, profile: Profile, split: str = "split") -> DataFrame:
    """By year, and over all: bars, Sharpe (population), cumulative return, drawdown, turnover, win rate, part."""
    pnl = pnl.withColumn("year", F.year("time").cast("string"))
    both = pnl.unionByName(pnl.withColumn("year", F.lit("ALL"))).unionByName(pnl.where(F.col(split) == "test").withColumn("year", F.lit("OOS")))
    drop = max_drawdown(["year"], both)
    part = F.when(F.min(split) == F.max(split), F.initcap(F.min(split))).otherwise("Mixed")
    by = both.groupBy("year").agg(
        part.alias("part"), F.count(F.lit(1)).alias("n"), (F.avg("pnl") / (F.stddev_pop("pnl") + 1e-8) * profile.bars_per_year**0.5).alias("sharpe"),
        F.sum("pnl").alias("cumulative"), F.avg("turnover").alias("turnover"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
    )
    return by.join(drop, "year")


def ensemble_report(scores: DataFrame, ensemble_id: str) -> DataFrame:
    """The ensemble's score against its members: best, mean, deviation and improvement."""
    own, rest = scores.where(F.col("formula_id") == ensemble_id), scores.where(F.col("formula_id") != ensemble_id)
    members = rest.agg(F.max("sharpe").alias("best"), F.avg("sharpe").alias("mean"), F.stddev_pop("sharpe").alias("deviation"))
    return own.select(F.col("sharpe").alias("ensemble")).crossJoin(members).withColumn("improvement", F.col("ensemble") - F.col("mean"))  # one row each


def sortino_reward(pnl: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over downside deviation, on a yearly scale, with penalties for losing and idling, clipped to -3..5."""
    agg = pnl.groupBy(*keys).agg(F.avg("pnl").alias("mu"), F.sqrt(F.avg(F.pow(F.least("pnl", F.lit(0.0)), 2))).alias("down"), F.avg("turnover").alias("to"))
    raw = F.col("mu") / (F.col("down") + 1e-6) * 15.87
    return agg.withColumn("reward", _clip(raw - F.when(F.col("mu") < 0, 1.0).otherwise(0.0) - F.when(F.col("to") < 1e-4, 1.0).otherwise(0.0), -3.0, 5.0))


def equity_report(pnl: DataFrame, keys: list[str], per_year: float = 252.0, risk_free: float = 0.02) -> DataFrame:
    """Compound growth, yearly return and volatility, Sharpe over the risk-free rate, multiplicative drawdown, Calmar.

    Where the rows have a ``benchmark`` return, its compound growth is told too.
    """
    w = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    line = pnl.withColumn("equity", F.exp(F.sum(F.log1p("pnl")).over(w))).withColumn("top", F.max("equity").over(w))
    agg = line.groupBy(*keys).agg(
        F.max_by("equity", "time").alias("final_equity"), F.count(F.lit(1)).alias("n"), (F.stddev_samp("pnl") * per_year**0.5).alias("annual_vol"), F.max(1 - F.col("equity") / F.greatest("top", F.lit(1.0))).alias("max_drawdown"),
        *([F.exp(F.sum(F.log1p("benchmark"))).alias("benchmark_equity")] if "benchmark" in pnl.columns else []),
    )
    agg = agg.withColumn("annual_return", F.pow("final_equity", F.lit(per_year) / F.col("n")) - 1)
    return agg.withColumns({"sharpe": (F.col("annual_return") - risk_free) / (F.col("annual_vol") + 1e-9), "calmar": F.col("annual_return") / (F.col("max_drawdown") + 1e-9)})


def data_quality_report(panel: DataFrame, columns: list[str]) -> DataFrame:
    """By column: count, mean, median, deviation, true skewness, extremes, shares of positive and of zero."""
    long = panel.select(*columns).unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.stddev_samp("value").alias("std"), F.skewness("value").alias("skewness"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.avg((F.col("value") > 0).cast("double")).alias("share_positive"), F.avg((F.col("value") == 0).cast("double")).alias("share_zero"),
    )


def reward_histogram(scores: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts by fixed edges: bin i holds values from edge i-1 on and below edge i."""
    which = sum(((F.col(column) >= e).cast("int") for e in edges), F.lit(0))
    return scores.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shaped_reward(scores: DataFrame) -> DataFrame:
    """Fitness with the edges smoothed: a constant signal scores -2, a nearly constant one -2 + spread / 0.01.

    Others score their fitness less the structure penalty, plus the bonuses for diversity and novelty (``formula.stats_table``).
    """
    full = F.col("fitness") - F.col("structure_penalty") + F.col("diversity_bonus") + F.col("novelty")
    return scores.withColumn("reward", F.when(F.col("spread") < 1e-4, -2.0).when(F.col("spread") < 0.01, -2 + F.col("spread") / 0.01).otherwise(full))


def return_correlation(returns: DataFrame, rows: int = 200, times: DataFrame | None = None) -> DataFrame:
    """(n_addresses, mean_corr, median_corr, over_half, over_most): correlations of the returns of two addresses over the last ``rows`` times.

    An address whose return never changes counts with correlation 0.  ``times`` has the times where they are known more cheaply.
    """
    last = (returns if times is None else times).select("time").distinct().orderBy(F.desc("time")).limit(rows)
    part = returns.join(F.broadcast(last), "time", "left_semi")  # ``rows`` times at most
    by = part.groupBy(F.col("address").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("time").cast("timestamp")).alias("at"), F.col("ret").alias("v")))).alias("r"))
    series = settled(by.select("id", F.col("r.at").alias("at"), F.col("r.v").alias("v")), "returns")
    n = series.count()
    return median_of_pairs(series, series_count=n).select(F.lit(n).cast("long").alias("n_addresses"), F.col("mean").alias("mean_corr"), F.col("median").alias("median_corr"), "over_half", "over_most")
