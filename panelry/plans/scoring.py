"""Queries of formulas, positions and scores over the weekly panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import formula as fm
from ..functions.rolling import mean
from ..operators.factors import FACTORS, compute, register_factor
from ..operators.panel import Profile, rebalance_mask, simple_returns, target_return
from ..oracle import text as sql
from ..sources import fixtures, io

WEEKLY = Profile(bars_per_year=52.0)
KEYS = ["formula_id"]
#: Columns that ride along with every signal.
MARKED = sql.MARKED.split(", ")
DIGITS = 9
#: Random formulas that the leaderboard scores; more of them are more batches.
CANDIDATES = {f"c{i}": fm.candidate(i, sql.FEATURES, 8, 7) for i in range(24)}


def features(spark: SparkSession, sf_dir: str, times: int | None = None) -> DataFrame:
    """The panel with the features that formulas use."""
    return compute(fixtures.panel(spark, sf_dir), sql.FEATURES, times or fixtures.weeks(spark, sf_dir))[0]


def marked(spark: SparkSession, sf_dir: str, times: int | None = None) -> DataFrame:
    """The features with liquidity, target, rebalance and safety marks, in the same windows."""
    return bt.liquidity_mask(rebalance_mask(target_return(features(spark, sf_dir, times)), "month", fixtures.times(spark, sf_dir)), WEEKLY)


def wide_formulas(panel: DataFrame, formulas: dict[str, list[str]], times: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(address, time, one column for each formula) over a marked panel, with the marks."""
    wide, bad = fm.evaluate(panel, formulas, times, keep=[*MARKED, *more])
    if bad:
        raise fm.InvalidFormula(str(bad))
    return wide


def run_formulas(panel: DataFrame, formulas: dict[str, list[str]], times: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(formula_id, address, time, signal) of formulas over a marked panel, with the marks."""
    # not unpivot(), which forgets how rows are dealt
    runs = F.explode(F.array(*[F.struct(F.lit(k).alias("formula_id"), F.col(k).alias("signal")) for k in formulas]))
    return wide_formulas(panel, formulas, times, more).withColumn("_run", runs).select("_run.formula_id", "address", "time", *MARKED, *more, "_run.signal")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(formula_id, address, time, signal) with liquidity, target, rebalance and safety marks, and base features."""
    times = fixtures.weeks(spark, sf_dir)
    return run_formulas(marked(spark, sf_dir, times), sql.SIGNALS, times)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitness of the formulas that stand for signals."""
    times = fixtures.weeks(spark, sf_dir)
    return bt.fitness_of(wide_formulas(marked(spark, sf_dir, times), sql.SIGNALS, times), list(sql.SIGNALS), WEEKLY, fm.stats_table(token_table(spark, sql.SIGNALS), sql.FEATURES[0]), "RET")


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.net_pnl(bt.position(signals(spark, sf_dir), "rank", KEYS), WEEKLY, KEYS)


def held(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Net pnl of rank positions that are held between rebalances."""
    return bt.net_pnl(bt.hold_between_rebalances(bt.position(runs, "rank", keys), keys), WEEKLY, keys)


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.portfolio_pnl(net(spark, sf_dir), KEYS)


def token_table(spark: SparkSession, formulas: dict[str, list[str]]) -> DataFrame:
    """(formula_id, tokens) of formulas that a caller wrote down."""
    return spark.createDataFrame(list(formulas.items()), "formula_id string, tokens array<string>")


def leaderboard(spark: SparkSession, sf_dir: str, formulas: dict[str, list[str]], batch: int = 12) -> DataFrame:
    """The fitness of any number of formulas, a batch of them in one plan over the panel at a time.

    Signals that agree to ``DIGITS`` digits tie, so that rounding does not decide ranks.
    """
    times = fixtures.weeks(spark, sf_dir)
    panel = io.settled(marked(spark, sf_dir, times).select("address", "time", *dict.fromkeys([*MARKED, *sql.FEATURES])), "marked")
    keys, out = list(formulas), None
    for a in range(0, len(keys), batch):
        part = {k: formulas[k] for k in keys[a : a + batch]}
        length = fm.stats_table(token_table(spark, part), sql.FEATURES[0])
        wide = wide_formulas(panel, part, times)
        more = bt.fitness_of(wide.withColumns({k: F.round(k, DIGITS) for k in part}), list(part), WEEKLY, length, sql.FEATURES[0])
        out = more if out is None else out.unionByName(more)
    return out


def formula_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of formulas, legal and not, one for each part."""
    names = F.array(*map(F.lit, _TOKENS))
    token = lambda i: F.element_at(names, ((F.col("p_partkey") * (i + 3) + i * i + F.col("p_size") * i) % len(_TOKENS) + 1).cast("int"))
    return fixtures.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("formula_id"), F.transform(F.sequence(F.lit(0), (F.col("p_size") % 7).cast("int")), token).alias("tokens"))


_TOKENS = ["RET", "DEV", "ADD", "LOG_VOL", "NEG", "HL_RANGE", "MUL", "CS_RANK", "GATE"]
_PARTS_SQL = f"parts AS (SELECT 'p' || p_partkey AS formula_id, list_transform(range(0, (p_size % 7 + 1)::BIGINT), lambda i: ({_TOKENS})[(p_partkey * (i + 3) + i * i + p_size * i) % {len(_TOKENS)} + 1]) AS tokens FROM part)"
_ARITY_SQL = "CASE t " + " ".join(f"WHEN '{n}' THEN {fm.OPS[n].arity}" for n in _TOKENS if n in fm.OPS) + " ELSE 0 END"

#: One formula for each operator.
OPERATORS = {
    "o1_add": ["RET", "DEV", "ADD"], "o2_sub": ["RET", "DEV", "SUB"], "o3_mul": ["RET", "DEV", "MUL"], "o4_div": ["RET", "LOG_VOL", "DIV"], "o5_neg": ["RET", "NEG"], "o6_abs": ["RET", "ABS"], "o7_sign": ["RET", "SIGN"],
    "o8_gate": ["RET", "DEV", "LOG_VOL", "GATE"], "o9_jump": ["HL_RANGE", "JUMP"], "o10_decay": ["RET", "DECAY"], "o11_delay1": ["RET", "DELAY1"], "o12_max3": ["RET", "MAX3"], "o13_cs_rank": ["RET", "DEV", "ADD", "CS_RANK"], "o14_cs_demean": ["RET", "CS_DEMEAN"],
    "o15_ma5": ["RET", "MA5"], "o16_ma20": ["RET", "MA20"], "o17_delta5": ["DEV", "DELTA5"], "o18_ts_std10": ["RET", "TS_STD10"], "o19_delay5": ["RET", "DELAY5"], "o20_corr10": ["RET", "LOG_VOL", "CORR10"], "o21_ifelse": ["RET", "DEV", "LOG_VOL", "IFELSE"],
    "o22_cond_mul": ["RET", "DEV", "COND_MUL"], "o23_ewma5": ["RET", "EWMA5"], "o24_ewma10": ["DEV", "EWMA10", "CS_DEMEAN"], "o25_breakout": ["DEV", "BREAKOUT"], "o26_div_signed": ["RET", "LOG_VOL", "DIV_SIGNED"], "o27_ts_zscore20": ["RET", "TS_ZSCORE20"], "o28_decay_linear20": ["RET", "DECAY_LINEAR20"], "o29_delta5": ["RET", "DEV", "SUB", "DELTA5"],
}
_MANY = {"fa": ["RET", "DEV", "ADD", "CS_RANK"], "fb": ["RET", "DEV", "ADD", "CS_RANK", "MA5", "NEG"], "fc": ["RET", "DEV", "ADD", "LOG_VOL", "CORR10"], "fd": ["HL_RANGE", "CS_DEMEAN", "EWMA5"]}


def register(add: Callable, rounded: Callable) -> None:
    """Add the queries of this module."""

    def operator(tokens: list[str]) -> Callable:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            times = fixtures.weeks(spark, sf_dir)
            out, bad = fm.evaluate(features(spark, sf_dir, times), {"signal": tokens}, times)
            assert not bad
            return out.select("address", "time", rounded("signal", 5).alias("signal"))

        return query

    for name, tokens in OPERATORS.items():
        add(name, operator(tokens), f"WITH {sql.formulas_sql({'signal': tokens})} SELECT address, time, round(signal, 5) + 0e0 AS signal FROM evaluated")
    def own_op(s: SparkSession, d: str) -> DataFrame:
        """A formula with an operator that the caller adds."""
        fm.register_op("OWN_CLIP", 1, lambda x, T: f"greatest(-3e0, least(3e0, 2 * {x}))")
        try:
            out, bad = fm.evaluate(features(s, d), {"signal": ["RET", "OWN_CLIP", "DEV", "ADD"]}, fixtures.weeks(s, d))
        finally:
            del fm.OPS["OWN_CLIP"]
        if bad:
            raise fm.InvalidFormula(str(bad))
        return out.select("address", "time", rounded("signal", 5).alias("signal"))

    def own_factor(s: SparkSession, d: str) -> DataFrame:
        """A factor that the caller adds, scaled like the built-in ones."""
        register_factor("OWN_GAP", ("open", "close"), lambda T: [{"_own": "close / (open + 1e-9) - 1"}, {"OWN_GAP__x": mean("_own", 5)}], category="own")
        try:
            out, _ = compute(fixtures.panel(s, d), ["OWN_GAP"], fixtures.weeks(s, d))
        finally:
            del FACTORS["OWN_GAP"]
        return out.select("address", "time", rounded("OWN_GAP", 4).alias("OWN_GAP"))

    add("ud1_own_factor", own_factor, f"""WITH {fixtures.PANEL_SQL}, a AS (SELECT address, time, sum(close / (open + 1e-9) - 1) OVER (PARTITION BY address ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5 AS x FROM panel),
    m AS (SELECT *, quantile_disc(x, 0.5) OVER (PARTITION BY address) AS middle FROM a), s AS (SELECT *, quantile_disc(abs(x - middle), 0.5) OVER (PARTITION BY address) AS spread FROM m)
    SELECT address, time, round(greatest(-5e0, least(5e0, (x - middle) / (spread + 1e-6))), 4) + 0e0 AS OWN_GAP FROM s""")  # fmt: skip
    add("ud2_own_op", own_op, f"WITH {sql.FEATURES_SQL} SELECT address, time, round(greatest(-3e0, least(3e0, 2 * RET)) + DEV, 5) + 0e0 AS signal FROM feats")
    # another market: higher fees and larger trades
    dear = Profile(base_fee=0.001, trade_size=50000.0, bars_per_year=52.0)
    add(
        "p10_profile", lambda s, d: bt.sharpe(KEYS, bt.portfolio_pnl(bt.net_pnl(bt.position(signals(s, d), "rank", KEYS), dear, KEYS), KEYS), dear).select("formula_id", rounded("sharpe", 5).alias("sharpe")),
        f"WITH {sql.PNL_SQL.replace('0.0003e0', '0.001e0').replace('10000 /', '50000 /')}, {sql.SHARPE_SQL} SELECT formula_id, round(sharpe, 5) + 0e0 AS sharpe FROM sharpes",
    )
    add("o30_eval_formulas", lambda s, d: fm.evaluate_long(features(s, d), _MANY, fixtures.weeks(s, d)).select("formula_id", "address", "time", rounded("signal", 5).alias("signal")), f"WITH {sql.formulas_sql(_MANY)} " + " UNION ALL ".join(f"SELECT '{k}' AS formula_id, address, time, round({k}, 5) + 0e0 AS signal FROM evaluated" for k in _MANY))
    add(
        "o31_validate_formula", lambda s, d: fm.validate_table(formula_table(s, d)).select("formula_id", "underflow_at", "final_depth", rounded("shaped_score").alias("shaped_score")),
        f"""WITH {_PARTS_SQL}, toks AS (SELECT formula_id, unnest(tokens) AS t, unnest(range(0, len(tokens))) AS i, len(tokens) AS n FROM parts),
        need AS (SELECT *, {_ARITY_SQL} AS need FROM toks), run AS (SELECT *, sum(1 - need) OVER (PARTITION BY formula_id ORDER BY i) AS depth FROM need),
        agg AS (SELECT formula_id, coalesce(min(CASE WHEN depth - (1 - need) < need THEN i END), -1) AS underflow_at, arg_max(depth, i) AS final_depth, max(n) AS n FROM run GROUP BY formula_id)
        SELECT formula_id, underflow_at::INT AS underflow_at, final_depth::INT AS final_depth, round(CASE WHEN underflow_at >= 0 THEN -5 + 2 * underflow_at / n::DOUBLE WHEN final_depth <> 1 THEN -3 - least(1e0, abs(final_depth - 1) / 10e0) ELSE 0e0 END, 6) + 0e0 AS shaped_score FROM agg""",
    )
    n = f"({_ARITY_SQL.replace('CASE t', 'CASE x[1]')})"
    add(
        "o32_decode_formula", lambda s, d: fm.decode_table(formula_table(s, d)).select("formula_id", "postfix", "prefix"),
        f"""WITH {_PARTS_SQL}, read AS (SELECT formula_id, tokens, list_reduce(list_prepend([]::VARCHAR[], list_transform(tokens, lambda t: [t])), lambda s, x: list_append(list_slice(s, 1, greatest(len(s) - {n}, 0)),
          CASE WHEN {n} = 0 THEN x[1] ELSE x[1] || '(' || array_to_string(list_slice(s, greatest(len(s) - {n} + 1, 1), len(s)), ', ') || ')' END)) AS stack FROM parts)
        SELECT formula_id, array_to_string(tokens, ' ') AS postfix, CASE WHEN len(stack) = 1 THEN stack[1] END AS prefix FROM read""",
    )
    ops = ", ".join(f"'{n}'" for n in _TOKENS if n in fm.OPS)
    add(
        "o33_formula_stats", lambda s, d: fm.stats_table(formula_table(s, d)).select("formula_id", "length", "n_distinct", "skeleton", rounded("structure_penalty").alias("structure_penalty"), rounded("diversity_bonus").alias("diversity_bonus"), "novelty"),
        f"""WITH {_PARTS_SQL}, t AS (SELECT formula_id, unnest(tokens) AS t FROM parts), u AS (SELECT formula_id, t, count(*) AS n, t IN ({ops}) AS op FROM t GROUP BY formula_id, t),
        c AS (SELECT formula_id, count(*)::INT AS n_distinct, sum(CASE WHEN op THEN 0.3e0 * greatest(n - 3, 0) ELSE 0.5e0 * greatest(n - 2, 0) END) AS cost, least(0.6e0, 0.15e0 * greatest(count(*) FILTER (NOT op) - 2, 0)) AS bonus FROM u GROUP BY formula_id),
        s AS (SELECT formula_id, len(list_filter(tokens, lambda t: t <> 'RET'))::INT AS length, array_to_string(list_transform(tokens, lambda t: CASE WHEN t IN ({ops}) THEN t ELSE 'F' END), ' ') AS skeleton FROM parts)
        SELECT formula_id, length, n_distinct, skeleton, round(cost, 6) + 0e0 AS structure_penalty, round(bonus, 6) + 0e0 AS diversity_bonus, CASE WHEN formula_id = min(formula_id) OVER (PARTITION BY skeleton) THEN 0.3e0 ELSE 0e0 END AS novelty FROM s JOIN c USING (formula_id)""",
    )
    add(
        "o34_migrate_formulas", lambda s, d: fm.migrate_tokens(fixtures.table(s, d, "part").select("p_partkey", F.transform(F.sequence(F.lit(0), (F.col("p_size") % 7).cast("int")), lambda i: ((F.col("p_partkey") + i * 5) % 17).cast("long")).alias("tokens"))).select("p_partkey", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens")),
        "SELECT p_partkey, array_to_string(list_transform(range(0, (p_size % 7 + 1)::BIGINT), lambda i: CASE WHEN (p_partkey + i * 5) % 17 >= 6 THEN (p_partkey + i * 5) % 17 + 6 ELSE (p_partkey + i * 5) % 17 END), ' ') AS tokens FROM part",
    )
    add("o35_formula_candidates", lambda s, d: fm.candidates_for(fixtures.table(s, d, "part").select(F.col("p_partkey").alias("id")), sql.FEATURES).select("formula_id", F.array_join("tokens", " ").alias("tokens")))

    for mode, number in {"sigmoid": 1, "rank": 2, "zscore": 3, "quantile": 4, "long_short": 5, "sign": 6}.items():
        add(
            f"b{number}_position_{mode}", lambda s, d, m=mode: bt.position(signals(s, d), m, KEYS).select("formula_id", "address", "time", rounded("position").alias("position")),
            f"WITH {sql.positions_sql(mode)} SELECT formula_id, address, time, round(position, 6) + 0e0 AS position FROM pos",
        )
    add(
        "b7_hold_between_rebalances", lambda s, d: bt.hold_between_rebalances(bt.position(signals(s, d), "rank", KEYS), KEYS).select("formula_id", "address", "time", rounded("position").alias("position")),
        f"WITH {sql.positions_sql(hold=True)} SELECT formula_id, address, time, round(position, 6) + 0e0 AS position FROM pos",
    )
    add("b8_liquidity_mask", lambda s, d: bt.liquidity_mask(fixtures.panel(s, d), WEEKLY).select("address", "time", "is_safe"), f"WITH {fixtures.PANEL_SQL} SELECT address, time, (liquidity > 1000)::INT::DOUBLE AS is_safe FROM panel")
    add(
        "b9_turnover_and_cost", lambda s, d: net(s, d).select("formula_id", "address", "time", rounded("turnover").alias("turnover"), rounded("cost", 8).alias("cost")),
        f"WITH {sql.PNL_SQL} SELECT formula_id, address, time, round(turnover, 6) + 0e0 AS turnover, round(cost, 8) + 0e0 AS cost FROM netted",
    )
    add("b10_portfolio_pnl", lambda s, d: portfolio(s, d).select("formula_id", "time", rounded("pnl", 8).alias("pnl"), rounded("turnover").alias("turnover")), f"WITH {sql.PNL_SQL} SELECT formula_id, time, round(pnl, 8) + 0e0 AS pnl, round(turnover, 6) + 0e0 AS turnover FROM pf")
    add("b11_sharpe", lambda s, d: bt.sharpe(KEYS, portfolio(s, d), WEEKLY).select("formula_id", rounded("sharpe").alias("sharpe")), f"WITH {sql.PNL_SQL}, {sql.SHARPE_SQL} SELECT formula_id, round(sharpe, 6) + 0e0 AS sharpe FROM sharpes")
    add("b12_max_drawdown", lambda s, d: bt.max_drawdown(KEYS, portfolio(s, d)).select("formula_id", rounded("max_drawdown").alias("max_drawdown")), f"WITH {sql.PNL_SQL}, {sql.DRAWDOWN_SQL} SELECT formula_id, round(max_drawdown, 6) + 0e0 AS max_drawdown FROM drawdowns")
    add("b13_fitness_score", lambda s, d: scores(s, d).select("formula_id", *[rounded(c).alias(c) for c in ("fitness", "redundancy")]), f"WITH {sql.FITNESS_SQL} SELECT formula_id, round(fitness, 6) + 0e0 AS fitness, round(redundancy, 6) + 0e0 AS redundancy FROM fit")
    add("b14_lazy_and_turnover", lambda s, d: bt.activity(held(signals(s, d)), KEYS, WEEKLY).select("formula_id", *[rounded(c).alias(c) for c in ("active", "lazy_penalty", "turnover_bonus")]), f"WITH {sql.HELD_SQL}, {sql.ACTIVITY_SQL} SELECT formula_id, round(active, 6) + 0e0 AS active, round(lazy_penalty, 6) + 0e0 AS lazy_penalty, round(turnover_bonus, 6) + 0e0 AS turnover_bonus FROM activities")
    add("b15_rank_ic", lambda s, d: bt.rank_ic(signals(s, d), KEYS).select("formula_id", rounded("rank_ic").alias("rank_ic")), f"WITH {sql.RUNS_SQL}, {sql.IC_SQL} SELECT formula_id, round(rank_ic, 6) + 0e0 AS rank_ic FROM rank_ics")
    add(
        "b16_pearson_ic", lambda s, d: bt.pearson_ic(signals(s, d), KEYS).select("formula_id", rounded("mean_ic").alias("mean_ic"), rounded("icir").alias("icir"), "n_times"),
        f"WITH {sql.RUNS_SQL}, {sql.QUALITY_SQL} SELECT formula_id, round(mean_ic, 6) + 0e0 AS mean_ic, round(icir, 6) + 0e0 AS icir, n_times FROM quality",
    )
    add(
        "b17_rank_ic_report", lambda s, d: bt.rank_ic_report(signals(s, d), KEYS).select("formula_id", *[rounded(c).alias(c) for c in ("mean_ic", "std_ic", "ir", "share_positive")]),
        f"WITH {sql.RUNS_SQL}, {sql.IC_SQL} SELECT formula_id, round(avg(ic), 6) + 0e0 AS mean_ic, round(stddev_samp(ic), 6) + 0e0 AS std_ic, round(avg(ic) / (stddev_samp(ic) + 1e-10), 6) + 0e0 AS ir, round(avg((ic > 0)::INT), 6) + 0e0 AS share_positive FROM ics WHERE n >= 5 GROUP BY formula_id",
    )
    add(
        "b18_redundancy_penalty", lambda s, d: bt.redundancy_penalty(signals(s, d), ["RET", "DEV"], KEYS).select("formula_id", rounded("redundancy").alias("redundancy")),
        f"""WITH {sql.RUNS_SQL}, r AS (SELECT formula_id, address, row_number() OVER (PARTITION BY formula_id, address ORDER BY signal, time)::DOUBLE AS s, row_number() OVER (PARTITION BY formula_id, address ORDER BY RET, time)::DOUBLE AS a, row_number() OVER (PARTITION BY formula_id, address ORDER BY DEV, time)::DOUBLE AS b FROM runs),
        c AS (SELECT formula_id, address, corr(s, a) AS a, corr(s, b) AS b FROM r GROUP BY formula_id, address) SELECT formula_id, round(avg((CASE WHEN abs(a) > 0.7 THEN 2e0 ELSE 0e0 END) + (CASE WHEN abs(b) > 0.7 THEN 2e0 ELSE 0e0 END)), 6) + 0e0 AS redundancy FROM c GROUP BY formula_id""",
    )
    lagged = f"{sql.RUNS_SQL}, l AS (SELECT formula_id, address, signal, lag(signal) OVER (PARTITION BY formula_id, address ORDER BY time) AS b FROM runs)"
    add("b19_factor_autocorrelation", lambda s, d: bt.factor_autocorrelation(signals(s, d), KEYS).select("formula_id", rounded("autocorrelation").alias("autocorrelation")), f"WITH {lagged}, c AS (SELECT formula_id, address, corr(signal, b) AS c FROM l WHERE b IS NOT NULL GROUP BY formula_id, address) SELECT formula_id, round(avg(c), 6) + 0e0 AS autocorrelation FROM c WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY formula_id")
    add("b20_pooled_autocorrelation", lambda s, d: bt.factor_autocorrelation(signals(s, d), KEYS, pooled=True).select("formula_id", rounded("autocorrelation").alias("autocorrelation")), f"WITH {lagged} SELECT formula_id, round(corr(signal, b), 6) + 0e0 AS autocorrelation FROM l WHERE b IS NOT NULL GROUP BY formula_id")

    def yearly(s: SparkSession, d: str) -> DataFrame:
        pnl = portfolio(s, d).where("formula_id = 'fa'").withColumn("split", F.when(F.col("time") < "2000-01-01", "train").otherwise("test"))
        return bt.yearly_report(pnl, WEEKLY).select("year", "part", "n", *[rounded(c).alias(c) for c in ("sharpe", "cumulative", "turnover", "win_rate", "max_drawdown")])

    add(
        "b21_yearly_report", yearly,
        f"""WITH {sql.PNL_SQL}, p AS (SELECT *, CASE WHEN time < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS split FROM pf WHERE formula_id = 'fa'),
        y AS (SELECT year(time)::VARCHAR AS year, * FROM p UNION ALL SELECT 'ALL', * FROM p UNION ALL SELECT 'OOS', * FROM p WHERE split = 'test'),
        c AS (SELECT *, sum(pnl) OVER (PARTITION BY year ORDER BY time ROWS UNBOUNDED PRECEDING) AS s FROM y), m AS (SELECT *, max(s) OVER (PARTITION BY year ORDER BY time ROWS UNBOUNDED PRECEDING) AS top FROM c)
        SELECT year, CASE WHEN min(split) = max(split) THEN CASE min(split) WHEN 'train' THEN 'Train' ELSE 'Test' END ELSE 'Mixed' END AS part, count(*) AS n, round(avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(52e0), 6) + 0e0 AS sharpe, round(sum(pnl), 6) + 0e0 AS cumulative,
          round(avg(turnover), 6) + 0e0 AS turnover, round(avg((pnl > 0)::INT), 6) + 0e0 AS win_rate, round(max(top - s), 6) + 0e0 AS max_drawdown FROM m GROUP BY year""",
    )
    add(
        "b22_ensemble_report", lambda s, d: bt.ensemble_report(bt.sharpe(KEYS, portfolio(s, d), WEEKLY), "fa").select(*[rounded(c).alias(c) for c in ("ensemble", "best", "mean", "deviation", "improvement")]),
        f"""WITH {sql.PNL_SQL}, {sql.SHARPE_SQL}, r AS (SELECT max(sharpe) AS best, avg(sharpe) AS mean, stddev_pop(sharpe) AS deviation FROM sharpes WHERE formula_id <> 'fa')
        SELECT round(sharpe, 6) + 0e0 AS ensemble, round(best, 6) + 0e0 AS best, round(mean, 6) + 0e0 AS mean, round(deviation, 6) + 0e0 AS deviation, round(sharpe - mean, 6) + 0e0 AS improvement FROM sharpes, r WHERE formula_id = 'fa'""",
    )
    add(
        "b23_sortino_reward", lambda s, d: bt.sortino_reward(portfolio(s, d), KEYS).select("formula_id", rounded("reward").alias("reward")),
        f"""WITH {sql.PNL_SQL}, a AS (SELECT formula_id, avg(pnl) AS mu, sqrt(avg(pow(least(pnl, 0e0), 2))) AS down, avg(turnover) AS tov FROM pf GROUP BY formula_id)
        SELECT formula_id, round(greatest(-3e0, least(5e0, mu / (down + 1e-6) * 15.87e0 - CASE WHEN mu < 0 THEN 1 ELSE 0 END - CASE WHEN tov < 1e-4 THEN 1 ELSE 0 END)), 6) + 0e0 AS reward FROM a""",
    )
    with_benchmark = lambda s, d: net(s, d).groupBy(*KEYS, "time").agg(F.avg("pnl").alias("pnl"), F.avg("target_ret").alias("benchmark"))
    add(
        "b24_equity_report", lambda s, d: bt.equity_report(with_benchmark(s, d), KEYS, 52.0).select("formula_id", "n", *[rounded(c).alias(c) for c in ("final_equity", "benchmark_equity", "annual_vol", "max_drawdown", "annual_return", "sharpe", "calmar")]),
        f"""WITH {sql.PNL_SQL}, e AS (SELECT *, exp(sum(ln(1 + pnl)) OVER (PARTITION BY formula_id ORDER BY time ROWS UNBOUNDED PRECEDING)) AS equity FROM pf), t AS (SELECT *, max(equity) OVER (PARTITION BY formula_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS top FROM e),
        a AS (SELECT formula_id, count(*) AS n, arg_max(equity, time) AS fe, stddev_samp(pnl) * sqrt(52e0) AS av, max(1 - equity / greatest(top, 1e0)) AS dd, exp(sum(ln(1 + benchmark))) AS be FROM t GROUP BY formula_id), b AS (SELECT *, pow(fe, 52e0 / n) - 1 AS ar FROM a)
        SELECT formula_id, n, round(fe, 6) + 0e0 AS final_equity, round(be, 6) + 0e0 AS benchmark_equity, round(av, 6) + 0e0 AS annual_vol, round(dd, 6) + 0e0 AS max_drawdown, round(ar, 6) + 0e0 AS annual_return, round((ar - 0.02e0) / (av + 1e-9), 6) + 0e0 AS sharpe, round(ar / (dd + 1e-9), 6) + 0e0 AS calmar FROM b""",
    )
    add(
        "b25_return_correlation", lambda s, d: bt.return_correlation(simple_returns(fixtures.panel(s, d)), times=fixtures.times(s, d)).select("n_addresses", *[rounded(c, 5).alias(c) for c in ("mean_corr", "median_corr", "over_half", "over_most")]),
        f"""WITH {fixtures.PANEL_SQL}, r AS (SELECT address, time, greatest(-0.2e0, least(0.2e0, coalesce((close - lag(close) OVER w) / (abs(lag(close) OVER w) + 1e-10), 0e0))) AS ret FROM panel WINDOW w AS (PARTITION BY address ORDER BY time)),
        l AS (SELECT * FROM r WHERE time IN (SELECT DISTINCT time FROM r ORDER BY time DESC LIMIT 200)), c AS (SELECT coalesce(corr(a.ret, b.ret), 0) AS c FROM l a JOIN l b ON a.time = b.time AND a.address < b.address GROUP BY a.address, b.address)
        SELECT (SELECT count(DISTINCT address) FROM r) AS n_addresses, round(avg(v), 5) + 0e0 AS mean_corr, round(median(v), 5) + 0e0 AS median_corr, round(avg((v > 0.5)::INT), 5) + 0e0 AS over_half, round(avg((v > 0.8)::INT), 5) + 0e0 AS over_most FROM (SELECT CASE WHEN isnan(c) THEN 0e0 ELSE c END AS v FROM c)""",
    )
    add(
        "b25_data_quality_report", lambda s, d: bt.data_quality_report(features(s, d), ["RET", "DEV", "LOG_VOL"]).select("column", "n", *[rounded(c, 5).alias(c) for c in ("mean", "median", "std", "skewness", "low", "high", "share_positive", "share_zero")]),
        f"""WITH {sql.FEATURES_SQL}, l AS (SELECT 'RET' AS "column", RET AS v FROM feats UNION ALL SELECT 'DEV', DEV FROM feats UNION ALL SELECT 'LOG_VOL', LOG_VOL FROM feats), m AS (SELECT *, avg(v) OVER (PARTITION BY "column") AS mu FROM l)
        SELECT "column", count(v) AS n, round(avg(v), 5) + 0e0 AS mean, round(median(v), 5) + 0e0 AS median, round(stddev_samp(v), 5) + 0e0 AS std, round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5), 5) + 0e0 AS skewness, round(min(v), 5) + 0e0 AS low, round(max(v), 5) + 0e0 AS high,
          round(avg((v > 0)::INT), 5) + 0e0 AS share_positive, round(avg((v = 0)::INT), 5) + 0e0 AS share_zero FROM m GROUP BY "column" """,
    )

    def ceiling(s: SparkSession, d: str) -> DataFrame:
        runs = signals(s, d).where("formula_id = 'fa'").withColumn("signal", F.col("target_ret"))
        return bt.sharpe(KEYS, bt.portfolio_pnl(bt.net_pnl(bt.position(runs, "rank", KEYS), WEEKLY, KEYS), KEYS), WEEKLY).select("formula_id", rounded("sharpe").alias("sharpe"))

    future = f"{sql.RUNS_SQL}, future AS (SELECT * REPLACE (target_ret AS signal) FROM runs WHERE formula_id = 'fa')"
    add("b26_oracle_ceiling", ceiling, f"WITH {future}, {sql.placed_sql(source='future')}, {sql.NETTED_SQL}, {sql.PF_SQL}, {sql.SHARPE_SQL} SELECT formula_id, round(sharpe, 6) + 0e0 AS sharpe FROM sharpes")
    edges = [-0.05, -0.01, 0.0, 0.01, 0.05]
    add("b27_reward_histogram", lambda s, d: bt.reward_histogram(portfolio(s, d), "pnl", edges).select("bin", "n"), f"WITH {sql.PNL_SQL} SELECT {' + '.join(f'(pnl >= {e}e0)::INT' for e in edges)} AS bin, count(*) AS n FROM pf GROUP BY 1")
    add(
        "b28_score_formulas", lambda s, d: leaderboard(s, d, CANDIDATES).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("fitness", 6)), "formula_id"))).select("formula_id", "rank", *[rounded(c).alias(c) for c in ("fitness", "sharpe", "max_drawdown", "rank_ic")]),  # a row for each formula
        f"WITH {sql.fitness_sql(CANDIDATES, DIGITS)} SELECT formula_id, row_number() OVER (ORDER BY round(fitness, 6) DESC, formula_id)::INT AS rank, round(fitness, 6) + 0e0 AS fitness, round(sharpe, 6) + 0e0 AS sharpe, round(max_drawdown, 6) + 0e0 AS max_drawdown, round(rank_ic, 6) + 0e0 AS rank_ic FROM fit",
    )

    def shaped(s: SparkSession, d: str) -> DataFrame:
        spread = signals(s, d).groupBy(*KEYS).agg(F.stddev_samp("signal").alias("spread"))
        stats = fm.stats_table(token_table(s, sql.SIGNALS), sql.FEATURES[0])
        rows = scores(s, d).join(spread, KEYS).join(stats.select("formula_id", "structure_penalty", "diversity_bonus", "novelty"), KEYS)
        return bt.shaped_reward(rows).select("formula_id", rounded("reward").alias("reward"))

    # none of the three formulas repeats a name, each has a skeleton of its own, none has three features
    add("b29_shaped_reward", shaped, f"WITH {sql.FITNESS_SQL}, sp AS (SELECT formula_id, stddev_samp(signal) AS spread FROM runs GROUP BY formula_id) SELECT formula_id, round(CASE WHEN spread < 1e-4 THEN -2e0 WHEN spread < 0.01 THEN -2 + spread / 0.01e0 ELSE fitness + 0.3e0 END, 6) + 0e0 AS reward FROM fit JOIN sp USING (formula_id)")
