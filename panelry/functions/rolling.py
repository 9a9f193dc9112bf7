"""Rolling and cross-section expressions in SQL text that Spark and DuckDB both read.

A factor is a list of layers of named expressions (see ``operators.factors``); these helpers write the
expressions.  All windows over an address are ordered by time, all cross-section windows are one time.

Padding rules: averages, deviations and covariances of ``k`` rows take missing rows on the left as
zeros (they divide by ``k``); ``lag0`` pads zeros, ``lag1st`` pads the first value.
"""

from __future__ import annotations

import re

TS = "PARTITION BY address ORDER BY time"


def over(k: int) -> str:
    return f"OVER ({TS} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def total(x: str, k: int) -> str:
    return f"sum({x}) {over(k)}"


def mean(x: str, k: int) -> str:
    return f"({total(x, k)} / {k})"


def std(x: str, k: int) -> str:
    """Sample deviation with zeros on the left, from count, mean and variance (no cancellation)."""
    n, m, v = (f"{f}({x}) {over(k)}" for f in ("count", "avg", "var_pop"))
    return f"sqrt(greatest(0e0, ({n} * {v} + {n} * {m} * {m} * (1e0 - {n} / {k}e0)) / {k - 1}))"


def cov(x: str, y: str, k: int) -> str:
    """Covariance divided by ``k``, zeros on the left."""
    n, c, a, b = f"count({x}) {over(k)}", f"covar_pop({x}, {y}) {over(k)}", f"avg({x}) {over(k)}", f"avg({y}) {over(k)}"
    return f"(({n} * {c} + {n} * {a} * {b} * (1e0 - {n} / {k}e0)) / {k})"


def lag0(x: str, d: int = 1) -> str:
    return f"lag({x}, {d}, 0e0) OVER ({TS})"


def lag1st(x: str, d: int = 1) -> str:
    return f"coalesce(lag({x}, {d}) OVER ({TS}), first_value({x}) OVER ({TS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


def decay(x: str, k: int, i: str = "_i") -> str:
    """Linear decay 1..k over the last ``k`` rows, from two sums; ``i`` is the row number."""
    return f"((sum({i} * {x}) {over(k)} - ({i} - {k}) * sum({x}) {over(k)}) / {k * (k + 1) / 2}e0)"


ROW = f"row_number() OVER ({TS})"


def cross(function: str, x: str) -> str:
    return f"{function}({x}) OVER (PARTITION BY time)"


def cross_rank(x: str) -> str:
    """0 .. n-1 by value; the address decides ties."""
    return f"(row_number() OVER (PARTITION BY time ORDER BY {x}, address) - 1)"


def median(x: str, by: str) -> str:
    """The lower median of a column over a partition."""
    return f"MEDIAN_OF({x}, {by})"


def clip(x: str, low: float, high: float) -> str:
    return f"greatest({low!r}e0, least({high!r}e0, {x}))".replace("e0e0", "e0")


def clean(x: str) -> str:
    """NaN and null to 0, infinities to 1 and -1."""
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 0e0 WHEN {x} > 1.7e308 THEN 1e0 WHEN {x} < -1.7e308 THEN -1e0 ELSE {x} END"


_MEDIAN = re.compile(r"MEDIAN_OF\((\w+), (\w+)\)")


def spark_text(expression: str) -> str:
    return _MEDIAN.sub(r"percentile_disc(0.5) WITHIN GROUP (ORDER BY \1) OVER (PARTITION BY \2)", expression)


def duck_text(expression: str) -> str:
    return _MEDIAN.sub(r"quantile_disc(\1, 0.5) OVER (PARTITION BY \2)", expression)


def robust(x: str, name: str) -> list[dict[str, str]]:
    """Layers that scale column ``x`` to ``name``: lower median and median deviation by address, clipped to 5."""
    m, d, s = f"{x}__m", f"{x}__d", f"{x}__s"
    return [{m: median(x, "address")}, {d: f"abs({x} - {m})"}, {s: median(d, "address")}, {name: clip(f"({x} - {m}) / ({s} + 1e-6)", -5, 5)}]


def layered_sql(source: str, layers: list[dict[str, str]]) -> str:
    """DuckDB text: one common table for each layer, over the table ``source``; the last is ``layered``."""
    parts, before = [], source
    for i, layer in enumerate(layers):
        name = "layered" if i == len(layers) - 1 else f"layer{i}"
        parts.append(f"{name} AS (SELECT *, {', '.join(f'{duck_text(x)} AS {n}' for n, x in layer.items())} FROM {before})")
        before = name
    return ", ".join(parts)
