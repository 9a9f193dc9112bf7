"""Formulas in reverse Polish notation, evaluated for a whole panel in layers.

A formula is a list of names.  A name that is an operator takes its operands from the stack; any other
is a column.  Every node of every formula has a canonical text, so shared parts are computed once, and
nodes of one depth and kind share a layer: the number of shuffles follows the changes between windows
over an address and windows over a time, not the number of formulas.  Division by zero gives the
sign of the numerator, so no node is NaN or infinite.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import ROW, TS, clip, cov, cross, cross_rank, decay, lag0, mean, over, std
from .panel import time_index

_ALL = "OVER (PARTITION BY address)"


@dataclass(frozen=True)
class Op:
    """``text`` writes the expression from operand columns and the number of times; ``halflife`` marks a recursion instead."""

    arity: int
    text: Callable[..., str] | None
    halflife: int = 0


def _divide(x: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN sign({x}) * 1e0 ELSE {x} / ({d}) END"


def _short(k: int, instead: Callable[[str], str], text: Callable[[str], str]) -> Callable[..., str]:
    return lambda x, T: instead(x) if k > T else text(x)


OPS: dict[str, Op] = {
    "ADD": Op(2, lambda x, y, T: f"{x} + {y}"),
    "SUB": Op(2, lambda x, y, T: f"{x} - {y}"),
    "MUL": Op(2, lambda x, y, T: f"{x} * {y}"),
    "DIV": Op(2, lambda x, y, T: _divide(x, f"({y} + 1e-6)")),
    "NEG": Op(1, lambda x, T: f"-{x}"),
    "ABS": Op(1, lambda x, T: f"abs({x})"),
    "SIGN": Op(1, lambda x, T: f"sign({x}) * 1e0"),
    "GATE": Op(3, lambda c, x, y, T: f"CASE WHEN {c} > 0 THEN {x} ELSE {y} END"),
    "JUMP": Op(1, lambda x, T: f"greatest(0e0, ({x} - avg({x}) {_ALL}) / (coalesce(stddev_samp({x}) {_ALL}, 0e0) + 1e-6) - 3)"),
    "DECAY": Op(1, lambda x, T: f"{x} + 0.8e0 * {lag0(x, 1)} + 0.6e0 * {lag0(x, 2)}"),
    "DELAY1": Op(1, lambda x, T: lag0(x, 1)),
    "MAX3": Op(1, lambda x, T: f"greatest({x}, {lag0(x, 1)}, {lag0(x, 2)})"),
    "CS_RANK": Op(1, lambda x, T: f"CASE WHEN {cross('count', x)} <= 1 THEN 0e0 ELSE {cross_rank(x)} * 2e0 / ({cross('count', x)} - 1) - 1 END"),
    "CS_DEMEAN": Op(1, lambda x, T: f"{x} - {cross('avg', x)}"),
    "MA5": Op(1, _short(5, lambda x: x, lambda x: mean(x, 5))),
    "MA20": Op(1, _short(20, lambda x: x, lambda x: mean(x, 20))),
    "DELTA5": Op(1, lambda x, T: f"{x} - {lag0(x, 5)}"),
    "TS_STD10": Op(1, _short(10, lambda x: "0e0", lambda x: std(x, 10))),
    "DELAY5": Op(1, lambda x, T: lag0(x, 5)),
    "CORR10": Op(2, lambda x, y, T: "0e0" if T < 10 else clip(f"{cov(x, y, 10)} / ({std(x, 10)} * {std(y, 10)} + 1e-8)", -1, 1)),
    "IFELSE": Op(3, lambda c, x, y, T: f"{x} / (1 + exp(-{c})) + {y} * (1 - 1 / (1 + exp(-{c})))"),
    "COND_MUL": Op(2, lambda c, x, T: f"{x} / (1 + exp(-{c}))"),
    "EWMA5": Op(1, None, 5),
    "EWMA10": Op(1, None, 10),
    "BREAKOUT": Op(1, _short(20, lambda x: "0e0", lambda x: f"2 * ({x} - min({x}) {over(20)}) / (max({x}) {over(20)} - min({x}) {over(20)} + 1e-6) - 1")),
    "DIV_SIGNED": Op(2, lambda x, y, T: _divide(x, f"({y} + 1e-6 * sign({y}))")),
    "TS_ZSCORE20": Op(1, lambda x, T: f"({x} - {mean(x, 20)}) / ({std(x, 20)} + 1e-6)"),
    "DECAY_LINEAR20": Op(1, lambda x, T: decay(x, 20)),
}


def register_op(name: str, arity: int, text: Callable[..., str]) -> None:
    """Add an operator of the user's own: ``text(*operand columns, T)`` gives SQL text."""
    if name in OPS:
        raise ValueError(f"operator {name} exists")
    OPS[name] = Op(arity, text)


class InvalidFormula(ValueError):
    """Too few operands, operands left over, or an unknown name."""


@dataclass(frozen=True)
class Node:
    name: str  # canonical column
    op: Op | None
    args: tuple[str, ...]
    depth: int


def parse(tokens: Iterable[str], columns: Iterable[str]) -> tuple[list[Node], str]:
    """(nodes in order of evaluation, the result's column)."""
    columns = set(columns)
    nodes: dict[str, Node] = {}
    stack: list[tuple[str, int, str]] = []
    for token in tokens:
        op = OPS.get(token)
        if op is None:
            if token not in columns:
                raise InvalidFormula(f"unknown name {token}")
            stack.append((token, 0, token))
            continue
        if len(stack) < op.arity:
            raise InvalidFormula(f"{token} lacks operands")
        args = stack[len(stack) - op.arity :]
        del stack[len(stack) - op.arity :]
        text = f"{token}({','.join(a[2] for a in args)})"
        name = f"n_{hashlib.md5(text.encode()).hexdigest()[:12]}"  # noqa: S324
        depth = 1 + max(a[1] for a in args)
        nodes.setdefault(name, Node(name, op, tuple(a[0] for a in args), depth))
        stack.append((name, depth, text))
    if len(stack) != 1:
        raise InvalidFormula(f"{len(stack)} values are left")
    return list(nodes.values()), stack[0][0]


def validity(tokens: Iterable[str], columns: Iterable[str]) -> str | None:
    """Why a formula is invalid, or None."""
    try:
        parse(tokens, columns)
    except InvalidFormula as e:
        return str(e)
    return None


#: Half-lives of an average in a block of times, and before it: what is older weighs less than 2**-80 of the newest value.
BLOCK_LIVES, HALO_LIVES = 512, 80


def ewma(df: DataFrame, columns: dict[str, str], halflife: int, times: int, index: DataFrame, block: int | None = None, halo: int | None = None) -> DataFrame:
    """Recursive averages by address, started at the first value: ``columns`` names each after the column it averages.

    Histories are cut into blocks of ``block`` times; a row near the end of its block goes to the next one as well, as
    its halo, so that blocks of one address are averaged by different tasks.  Inside a block the recursion is a running sum:
    with d the decay and p the row number, ``d**(p+1) * first + (1-d) * d**p * sum(x * d**-p)``.  The weights rise by at most
    2**(BLOCK_LIVES + HALO_LIVES), so the sum keeps its precision.  ``index`` is (time, t); one block needs none.
    """
    block, halo = block or BLOCK_LIVES * halflife, halo or HALO_LIVES * halflife
    blocks = -(-times // block)
    d = 0.5 ** (1 / halflife)
    if blocks > 1:
        own = F.floor(F.col("t") / block).cast("int")
        last = F.least(F.floor((F.col("t") + halo) / block).cast("int"), F.lit(blocks - 1))
        out = df.join(index.select("time", "t"), "time").withColumn("_b", F.explode(F.sequence(own, F.greatest(own, last)))).withColumn("_own", F.col("_b") == own).drop("t")
        part = "PARTITION BY address, _b ORDER BY time"
    else:
        out, part = df, TS
    out = out.withColumn("_p", F.expr(f"row_number() OVER ({part}) - 1"))
    up = f"OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    out = out.withColumns({c: F.expr(f"pow({d!r}D, _p + 1) * first_value({x}) {up} + {1 - d!r}D * pow({d!r}D, _p) * sum({x} * pow({1 / d!r}D, _p)) {up}") for c, x in columns.items()})
    return (out.where("_own").drop("_own", "_b") if blocks > 1 else out).drop("_p")


def layers(formulas: dict[str, list[str]], columns: Iterable[str], times: int) -> tuple[list[list[Node]], dict[str, str]]:
    """(nodes of all valid formulas by depth, result column of each formula)."""
    found: dict[str, Node] = {}
    results = {}
    for key, tokens in formulas.items():
        nodes, result = parse(tokens, columns)
        found |= {n.name: n for n in nodes}
        results[key] = result
    depth = max((n.depth for n in found.values()), default=0)
    return [[n for n in found.values() if n.depth == d] for d in range(1, depth + 1)], results


def phases(steps: list[list[Node]], times: int) -> list[list[Node]]:
    """The nodes of ``layers`` in another order of evaluation: whatever needs no other rows than those of its address (or its time)
    comes before the rows are dealt anew."""
    waiting, done, out = [n for step in steps for n in step], set(), []
    names = {n.name for n in waiting}
    kind = {n.name: "" if not n.op.text else next((k for k in ("time", "address") if f"PARTITION BY {k}" in n.op.text(*n.args, times)), "any") for n in waiting}
    side = "address"
    while waiting:
        ready = [n for n in waiting if all(a in done or a not in names for a in n.args)]
        step = [n for n in ready if kind[n.name] in ("any", side) or side == "address" and not kind[n.name]]
        if step:
            out.append(step)
            done |= {n.name for n in step}
            waiting = [n for n in waiting if n.name not in done]
        else:
            side = "time" if side == "address" else "address"
    return out


def evaluate(panel: DataFrame, formulas: dict[str, list[str]], times: int | None = None, keep: Iterable[str] = (), index: DataFrame | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(address, time, the columns to ``keep`` and one column for each valid formula; the reason for each invalid one).

    ``times`` is the number of times of the panel; without it the panel is counted first.  ``index`` numbers the times,
    (time, t); without it they are taken from the panel where recursive averages need several blocks.
    """
    bad = {k: why for k, f in formulas.items() if (why := validity(f, panel.columns))}
    good = {k: f for k, f in formulas.items() if k not in bad}
    if times is None:
        times = panel.select(F.countDistinct("time")).first()[0]
    steps, results = layers(good, panel.columns, times)
    out = panel
    if any("_i *" in n.op.text(*n.args, times) for step in steps for n in step if n.op.text):
        out = out.withColumn("_i", F.expr(ROW))
    for step in phases(steps, times):
        plain = {n.name: F.expr(n.op.text(*n.args, times)) for n in step if n.op.text}
        if plain:
            out = out.withColumns(plain)
        for halflife in sorted({n.op.halflife for n in step if not n.op.text}):
            out = ewma(out, {n.name: n.args[0] for n in step if n.op.halflife == halflife and not n.op.text}, halflife, times, time_index(panel) if index is None else index)
    return out.select("address", "time", *keep, *[F.col(r).cast("double").alias(k) for k, r in results.items()]), bad


def evaluate_long(panel: DataFrame, formulas: dict[str, list[str]], times: int | None = None) -> DataFrame:
    """(formula_id, address, time, signal) of all valid formulas."""
    wide, _ = evaluate(panel, formulas, times)
    keys = [c for c in wide.columns if c not in ("address", "time")]
    return wide.unpivot(["address", "time"], keys, "formula_id", "signal") if keys else wide.select(F.lit("").alias("formula_id"), "address", "time", F.lit(0.0).alias("signal")).limit(0)


def sql_layers(formulas: dict[str, list[str]], columns: Iterable[str], times: int) -> tuple[list[dict[str, str]], dict[str, str]]:
    """The layers as text, for engines that read SQL; recursions are written as weighted sums over all earlier rows."""
    steps, results = layers(formulas, columns, times)
    out = [{"_i": ROW}]
    for step in steps:
        layer = {}
        for n in step:
            if n.op.text:
                layer[n.name] = n.op.text(*n.args, times)
            else:
                a = 1 - 0.5 ** (1 / n.op.halflife)
                rows = f"OVER ({TS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
                layer[n.name] = f"list_reduce(list({n.args[0]}) {rows}, lambda s, x: s + {a!r}::DOUBLE * (x - s))"
        out.append(layer)
    return out, results


#: Depth change of each name: columns push one, operators pop their operands and push one.
def depth_change(tokens: str = "tokens"):
    """Array of depth changes of a column of tokens."""
    arity = F.create_map(*[x for name, op in OPS.items() for x in (F.lit(name), F.lit(1 - op.arity))])
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(arity, t), F.lit(1)))


def validate_table(formulas: DataFrame) -> DataFrame:
    """``formulas(formula_id, tokens)`` with the place of the first underflow (-1 if none), the final depth, and a shaped score.

    The score is -5 at an underflow in the first token, nearer to -3 the later it is; -3 to -4 for leftovers.
    """
    delta = depth_change()
    arity = F.create_map(*[x for name, op in OPS.items() for x in (F.lit(name), F.lit(op.arity))])
    need = F.transform("tokens", lambda t: F.coalesce(F.element_at(arity, t), F.lit(0)))
    start = F.struct(F.lit(0).alias("d"), F.lit(-1).alias("bad"), F.lit(0).alias("i"))
    folded = F.aggregate(
        F.zip_with(delta, need, lambda d, n: F.struct(d.alias("d"), n.alias("n"))), start,
        lambda s, x: F.struct((s.d + x.d).alias("d"), F.when((s.bad < 0) & (s.d < x.n), s.i).otherwise(s.bad).alias("bad"), (s.i + 1).alias("i")),
    )
    out = formulas.withColumn("_f", folded).withColumns({"final_depth": F.col("_f.d"), "underflow_at": F.col("_f.bad"), "length": F.size("tokens")}).drop("_f")
    part = F.col("underflow_at") / F.greatest(F.col("length"), F.lit(1))
    score = F.when(F.col("underflow_at") >= 0, -5 + 2 * part).when(F.col("final_depth") != 1, -3 - F.least(F.lit(1.0), (F.abs(F.col("final_depth") - 1)) / F.lit(10.0))).otherwise(0.0)
    return out.withColumn("shaped_score", score)


def decode_table(formulas: DataFrame) -> DataFrame:
    """``formulas`` with the text in postfix and prefix order (prefix only where the formula is valid)."""
    arity = F.create_map(*[x for name, op in OPS.items() for x in (F.lit(name), F.lit(op.arity))])
    need = lambda t: F.coalesce(F.element_at(arity, t), F.lit(0))

    def step(stack, token):
        n = need(token)
        size = F.size(stack)
        args = F.slice(stack, F.greatest(size - n + 1, F.lit(1)), n)
        rest = F.slice(stack, F.lit(1), F.greatest(size - n, F.lit(0)))
        return F.concat(rest, F.array(F.when(n == 0, token).otherwise(F.concat(token, F.lit("("), F.array_join(args, ", "), F.lit(")")))))

    stack = F.aggregate("tokens", F.array().cast("array<string>"), step)
    return formulas.withColumns({"postfix": F.array_join("tokens", " "), "prefix": F.when(F.size(stack) == 1, F.element_at(stack, 1))})


def stats_table(formulas: DataFrame, first: str = "RET") -> DataFrame:
    """Length without the first feature, skeleton, and what a formula's build costs or earns.

    A feature used more than twice costs 0.5 for each further use, an operator used more than three
    times 0.3.  Each feature beyond two earns 0.15, 0.6 at most.  The first formula of a skeleton (by
    formula_id) earns 0.3 for novelty.
    """
    ops = F.array(*[F.lit(o) for o in OPS])
    names = F.array_distinct("tokens")
    uses = lambda t: F.size(F.filter("tokens", lambda u: u == t))
    is_op = lambda t: F.array_contains(ops, t)
    cost = F.aggregate(names, F.lit(0.0), lambda s, t: s + F.when(is_op(t), 0.3 * F.greatest(uses(t) - 3, F.lit(0))).otherwise(0.5 * F.greatest(uses(t) - 2, F.lit(0))))
    out = formulas.withColumns(
        {
            "length": F.size(F.filter("tokens", lambda t: t != first)), "n_distinct": F.size(names),
            "skeleton": F.array_join(F.transform("tokens", lambda t: F.when(is_op(t), t).otherwise("F")), " "),
            "structure_penalty": cost, "diversity_bonus": F.least(F.lit(0.6), 0.15 * F.greatest(F.size(F.filter(names, lambda t: ~is_op(t))) - 2, F.lit(0))),
        }
    )
    seen = out.groupBy("skeleton").agg(F.min("formula_id").alias("_seen"))
    return out.join(seen, "skeleton").withColumn("novelty", F.when(F.col("formula_id") == F.col("_seen"), 0.3).otherwise(0.0)).drop("_seen")


def migrate_tokens(formulas: DataFrame, from_token: int = 6, shift: int = 6) -> DataFrame:
    """Numbered formulas of an older numbering: tokens from ``from_token`` on move by ``shift``."""
    return formulas.withColumn("tokens", F.transform("tokens", lambda t: F.when(t >= from_token, t + shift).otherwise(t)))


def candidate(i: int, columns: list[str], length: int = 8, seed: int = 0) -> list[str]:
    """The ``i``-th random legal formula of fixed length; it depends on the seed and its number alone.

    Each token is uniform over those from which the end can still be reached with one value.
    """
    need = {c: 0 for c in columns} | {k: op.arity for k, op in OPS.items()}
    most = max(need.values()) - 1
    rng, depth, tokens = random.Random(f"{seed}:{i}"), 0, []
    for left in range(length - 1, -1, -1):
        legal = [t for t, n in need.items() if n <= depth and 1 <= depth + 1 - n <= 1 + left * most and (left or depth + 1 - n == 1)]
        tokens.append(rng.choice(legal))
        depth += 1 - need[tokens[-1]]
    return tokens


def candidates_for(rows: DataFrame, columns: list[str], length: int = 8, seed: int = 0) -> DataFrame:
    """(formula_id, tokens): the random legal formula of each ``id`` of ``rows``."""

    def make(frames):
        for frame in frames:
            yield pd.DataFrame([(f"c{i}", candidate(i, columns, length, seed)) for i in frame["id"]], columns=["formula_id", "tokens"])

    return rows.select("id").mapInPandas(make, "formula_id string, tokens array<string>")


def candidates(spark: SparkSession, n: int, columns: list[str], length: int = 8, seed: int = 0) -> DataFrame:
    """(formula_id, tokens): ``n`` random legal formulas of fixed length."""
    return candidates_for(spark.range(n), columns, length, seed)
