"""The weekly panel is dealt by address once, and scores of formulas move a row twice, with the same results."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelry.operators import backtest as bt
from panelry.operators import formula as fm
from panelry.operators import panel as pn
from panelry.oracle import text as sql
from panelry.plans import scoring
from panelry.sources import fixtures

SF = "/root/testdata/sf0.001"


def _dealt(df):
    """Shuffles by key in the plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_panel_and_marks_are_dealt_by_address_once(spark):
    times = fixtures.weeks(spark, SF)
    rows = scoring.marked(spark, SF, times).select("address", "time", *scoring.MARKED)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(address") == 1 and "SortMergeJoin" not in plan
    # what is written to a time, and to an address; times themselves and single rows apart
    assert _dealt(scoring.wide_formulas(scoring.marked(spark, SF, times), sql.SIGNALS, times)) <= _dealt(rows) + 1


def test_densify_fills_forward_and_then_with_zero(spark):
    rows = [("a", 2, 5.0, None), ("a", 4, None, 7.0), ("b", 1, 1.0, 2.0), ("b", 6, 3.0, None), ("c", 3, None, None)]
    got = pn.densify(spark.createDataFrame(rows, "address string, time int, x double, y double"), ["x", "y"]).toPandas().sort_values(["address", "time"]).reset_index(drop=True)
    frame = pd.DataFrame(rows, columns=["address", "time", "x", "y"])
    grid = pd.MultiIndex.from_product([["a", "b", "c"], [1, 2, 3, 4, 6]], names=["address", "time"])
    want = frame.set_index(["address", "time"]).reindex(grid).astype(float).groupby(level=0).ffill().fillna(0.0).reset_index()
    assert got[["address", "time", "x", "y"]].values.tolist() == want.values.tolist()


@pytest.mark.parametrize("base", ["RET", None])
def test_scores_side_by_side_equal_scores_one_by_one(spark, base):
    times = fixtures.weeks(spark, SF)
    panel = scoring.marked(spark, SF, times)
    formulas = dict(sql.SIGNALS, flat=["RET", "RET", "SUB"], c3=fm.candidate(3, sql.FEATURES, 8, 7))
    length = fm.stats_table(scoring.token_table(spark, formulas))
    one = bt.fitness(scoring.held(scoring.run_formulas(panel, formulas, times)), ["formula_id"], scoring.WEEKLY, length, base)
    two = bt.fitness_of(scoring.wide_formulas(panel, formulas, times), list(formulas), scoring.WEEKLY, length, base)
    names = ["fitness", "sharpe", "max_drawdown", "rank_ic", "redundancy", "active", "lazy_penalty", "turnover_bonus"]
    rows = lambda df: {r.formula_id: [r[c] for c in names] for r in df.select("formula_id", *[F.col(c).cast("double") for c in names]).collect()}
    a, b = rows(one), rows(two)
    assert set(a) == set(b) == set(formulas)
    for k in a:
        assert b[k] == pytest.approx(a[k], abs=1e-9)
