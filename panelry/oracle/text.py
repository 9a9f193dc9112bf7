"""Helpers of the oracle texts."""

from __future__ import annotations

from ..operators.factors import FACTORS, duck_expression, merged
from ..operators.formula import sql_layers
from ..sources.fixtures import PANEL_SQL

#: Weeks of the dense panel over the given tables, at every scale.
WEEKS = 357
#: Days of the daily panel of ticks.
DAYS = 30


def layered(source: str, layers: list[dict[str, str]], last: str = "layered") -> str:
    """One common table for each layer over the table ``source``; the last is named ``last``."""
    parts, before = [], source
    for i, layer in enumerate(layers):
        name = last if i == len(layers) - 1 else f"{last}{i}"
        parts.append(f"{name} AS (SELECT *, {', '.join(f'{duck_expression(x)} AS {n}' for n, x in layer.items())} FROM {before})")
        before = name
    return ", ".join(parts)


def factor_sql(name: str, panel: str = PANEL_SQL, times: int = WEEKS, digits: int = 4) -> str:
    return f"WITH {panel}, {layered('panel', FACTORS[name].all_layers(times))} SELECT address, time, round({name}__f, {digits}) + 0e0 AS {name} FROM layered"


#: Features that the formula and scoring queries work on.
FEATURES = ["RET", "DEV", "HL_RANGE", "LOG_VOL", "CLOSE_POS"]
FEATURES_SQL = f"{PANEL_SQL}, {layered('panel', merged(FEATURES, WEEKS), 'scaled')}, feats AS (SELECT *, {', '.join(f'{n}__f AS {n}' for n in FEATURES)} FROM scaled)"


def formulas_sql(formulas: dict[str, list[str]], name: str = "evaluated") -> str:
    """Common tables up to ``name``: feats with one column for each formula."""
    layers, results = sql_layers(formulas, FEATURES, WEEKS)
    return f"{FEATURES_SQL}, {layered('feats', layers, 'nodes')}, {name} AS (SELECT *, {', '.join(f'({r})::DOUBLE AS {k}' for k, r in results.items())} FROM nodes)"


#: Formulas that stand for signals in the scoring queries.
SIGNALS = {"fa": ["RET", "DEV", "ADD", "CS_RANK"], "fb": ["DEV", "MA5", "NEG"], "fc": ["HL_RANGE", "LOG_VOL", "MUL", "DELTA5"]}

#: Columns that ride along with every signal.
MARKED = "close, liquidity, target_ret, is_rebalance, is_safe, RET, DEV, HL_RANGE"


def marks_sql(source: str, name: str = "tgt") -> str:
    """``source`` with target, rebalance mark and safety mark."""
    return f"""{name} AS (
  SELECT *, greatest(-0.2e0, least(0.2e0, coalesce((lead(close) OVER w - close) / (close + 1e-9), 0e0))) AS target_ret,
    time = min(time) OVER (PARTITION BY date_trunc('month', time)) AS is_rebalance, (liquidity > 1000)::INT::DOUBLE AS is_safe
  FROM {source} WINDOW w AS (PARTITION BY address ORDER BY time)
)"""


def runs_sql(formulas: dict[str, list[str]], source: str = "tgt", extra: str = "", digits: int | None = None) -> str:
    """One row for each formula, address and time; signals rounded to ``digits`` if asked."""
    value = lambda k: k if digits is None else f"round({k}, {digits})"
    return f"runs AS ({' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)} AS formula_id, {extra}address, time, {value(k)} AS signal, {MARKED} FROM {source}' for k in formulas)})"


def scored_runs(formulas: dict[str, list[str]], digits: int | None = None) -> str:
    """Common tables up to ``runs`` for any formulas."""
    return f"{formulas_sql(formulas)}, {marks_sql('evaluated')}, {runs_sql(formulas, digits=digits)}"


RUNS_SQL = scored_runs(SIGNALS)

_N, _SHARE = "count(*) OVER c", "((row_number() OVER r - 1) / (count(*) OVER c - 1))"
_PLAIN = "2 * greatest(0e0, least(0.5e0, 1 / (1 + exp(-signal)) - 0.5))"
POSITIONS = {
    "sigmoid": _PLAIN,
    "rank": f"CASE WHEN {_N} < 2 THEN {_PLAIN} ELSE greatest(0e0, least(1e0, ({_SHARE} - 0.6e0) / 0.4e0)) END",
    "zscore": f"CASE WHEN {_N} < 2 THEN {_PLAIN} ELSE 1 / (1 + exp(-1.5 * (signal - avg(signal) OVER c) / (stddev_samp(signal) OVER c + 1e-6))) END",
    "quantile": f"CASE WHEN {_N} < 5 THEN {_PLAIN} WHEN {_SHARE} >= 0.9 THEN 1e0 WHEN {_SHARE} >= 0.75 THEN 0.5e0 ELSE 0e0 END",
    "long_short": f"CASE WHEN {_SHARE} >= 0.8 THEN 1e0 WHEN {_SHARE} <= 0.2 THEN -1e0 ELSE 0e0 END",
    "sign": "sign(signal)::DOUBLE",
}


def placed_sql(mode: str = "rank", hold: bool = False, source: str = "runs") -> str:
    """Common tables ``placed`` and ``pos``: runs with a position, held between rebalances if asked."""
    out = f"placed AS (SELECT *, ({POSITIONS[mode]}) * is_safe AS position FROM {source} WINDOW c AS (PARTITION BY formula_id, time), r AS (PARTITION BY formula_id, time ORDER BY signal, address))"
    if not hold:
        return f"{out}, pos AS (SELECT * FROM placed)"
    return f"""{out}, pos AS (SELECT * REPLACE (coalesce(
      last_value(CASE WHEN is_rebalance THEN position END IGNORE NULLS) OVER (PARTITION BY formula_id, address ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(CASE WHEN is_rebalance THEN position END IGNORE NULLS) OVER (PARTITION BY formula_id, address ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0e0) AS position) FROM placed)"""


def positions_sql(mode: str = "rank", hold: bool = False) -> str:
    """Common tables up to ``pos``."""
    return f"{RUNS_SQL}, {placed_sql(mode, hold)}"


NETTED_SQL = """turned AS (
  SELECT *, abs(position - lag(position, 1, 0e0) OVER (PARTITION BY formula_id, address ORDER BY time)) AS turnover FROM pos
), costed AS (
  SELECT *, turnover * (0.0003e0 + greatest(0e0, least(0.05e0, 10000 / (liquidity + 1e-9)))) AS cost FROM turned
), netted AS (
  SELECT *, position * target_ret - cost AS pnl FROM costed
)"""
PF_SQL = "pf AS (SELECT formula_id, time, avg(pnl) AS pnl, avg(turnover) AS turnover, avg(target_ret) AS benchmark FROM netted GROUP BY formula_id, time)"
PNL_SQL = f"{positions_sql()}, {NETTED_SQL}, {PF_SQL}"
HELD_SQL = f"{positions_sql(hold=True)}, {NETTED_SQL}, {PF_SQL}"
SHARPE_SQL = "sharpes AS (SELECT formula_id, avg(pnl) / (coalesce(stddev_samp(pnl), 0) + 1e-8) * sqrt(52e0) AS sharpe FROM pf GROUP BY formula_id)"
DRAWDOWN_SQL = """sums AS (SELECT *, sum(pnl) OVER (PARTITION BY formula_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS s FROM pf),
tops AS (SELECT *, max(s) OVER (PARTITION BY formula_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS top FROM sums),
drawdowns AS (SELECT formula_id, max(top - s) AS max_drawdown FROM tops GROUP BY formula_id)"""
# turnover a rebalance; under 0.01 it costs 3, up to 0.05 it costs in proportion
ACTIVITY_SQL = """acts AS (
  SELECT formula_id, address, count(*) AS bars, sum((position > 0.05)::INT) AS live, CASE WHEN sum(is_rebalance::INT) < count(*) THEN sum(turnover) / greatest(sum(is_rebalance::INT), 1) ELSE avg(turnover) END AS tov
  FROM netted GROUP BY formula_id, address
), activities AS (
  SELECT formula_id, sum(live) / sum(bars)::DOUBLE AS active, avg(CASE WHEN tov < 0.01 THEN 3e0 WHEN tov < 0.05 THEN (0.05e0 - tov) / 0.05e0 * 2 ELSE 0e0 END) AS lazy_penalty, avg(least(0.5e0, 5 * tov)) AS turnover_bonus FROM acts GROUP BY formula_id
)"""
IC_SQL = """ranks AS (SELECT *, row_number() OVER (PARTITION BY formula_id, time ORDER BY signal, address)::DOUBLE AS ra, row_number() OVER (PARTITION BY formula_id, time ORDER BY target_ret, address)::DOUBLE AS rb FROM runs),
ics AS (SELECT formula_id, time, coalesce(corr(ra, rb), 0) AS ic, count(*) AS n, coalesce(stddev_samp(signal), 0) AS spread FROM ranks GROUP BY formula_id, time),
ic_values AS (SELECT formula_id, address, count(DISTINCT signal) AS v, row_number() OVER (PARTITION BY formula_id ORDER BY address) AS k FROM runs GROUP BY formula_id, address),
ic_few AS (SELECT formula_id, avg(v) < 5 AS few FROM ic_values WHERE k <= 10 GROUP BY formula_id),
rank_ics AS (SELECT formula_id, CASE WHEN max(n) < 2 OR avg(spread) < 1e-6 THEN 0e0 ELSE avg(ic) END * CASE WHEN max(few) THEN 0.3e0 ELSE 1e0 END AS rank_ic FROM ics JOIN ic_few USING (formula_id) GROUP BY formula_id)"""
# the last 132 times but the very last, those with over ten values, and at least twenty of them
QUALITY_SQL = """q_times AS (SELECT time FROM (SELECT time, row_number() OVER (ORDER BY time DESC) AS k FROM (SELECT DISTINCT time FROM runs)) WHERE k BETWEEN 2 AND 132),
q_ics AS (SELECT formula_id, time, corr(signal, target_ret) AS ic, count(*) AS n FROM runs SEMI JOIN q_times USING (time) WHERE abs(signal) > 1e-10 GROUP BY formula_id, time),
quality AS (SELECT formula_id, avg(ic) AS mean_ic, abs(avg(ic)) / (stddev_pop(ic) + 1e-10) AS icir, count(*) AS n_times FROM q_ics WHERE n > 10 AND ic IS NOT NULL AND NOT isnan(ic) GROUP BY formula_id HAVING count(*) >= 20)"""
# two for each address whose ranks over time follow those of RET
REPEATS_SQL = """rep0 AS (SELECT formula_id, address, row_number() OVER (PARTITION BY formula_id, address ORDER BY signal, time)::DOUBLE AS s, row_number() OVER (PARTITION BY formula_id, address ORDER BY RET, time)::DOUBLE AS r FROM runs),
rep1 AS (SELECT formula_id, address, CASE WHEN abs(corr(s, r)) > 0.7 THEN 2e0 ELSE 0e0 END AS again FROM rep0 GROUP BY formula_id, address),
repeats AS (SELECT formula_id, avg(again) AS redundancy FROM rep1 GROUP BY formula_id)"""


def fitness_sql(formulas: dict[str, list[str]], digits: int | None = None) -> str:
    """Common tables up to ``fit``."""
    lengths = ", ".join(f"('{k}', {sum(t != FEATURES[0] for t in tokens)})" for k, tokens in formulas.items())
    return f"""{scored_runs(formulas, digits)}, {placed_sql(hold=True)}, {NETTED_SQL}, {PF_SQL}, {SHARPE_SQL}, {DRAWDOWN_SQL}, {ACTIVITY_SQL}, {IC_SQL}, {REPEATS_SQL},
lengths AS (SELECT * FROM (VALUES {lengths}) AS l(formula_id, length)), fit AS (
  SELECT *, CASE WHEN active < 0.05 THEN -10e0 ELSE sharpe - 2 * max_drawdown - 0.1e0 * greatest(0, length - 6) - redundancy - lazy_penalty + turnover_bonus END + 2 * greatest(-0.3e0, least(0.3e0, rank_ic)) AS fitness
  FROM sharpes JOIN drawdowns USING (formula_id) JOIN activities USING (formula_id) JOIN rank_ics USING (formula_id) JOIN repeats USING (formula_id) JOIN lengths USING (formula_id)
)"""


FITNESS_SQL = fitness_sql(SIGNALS)
