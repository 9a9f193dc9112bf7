"""Pairs of series by tiles against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelry.operators import pairs


def _series(seed=3, n=23, days=2, wide=12):
    """Series of two groups with gaps, ties, and one that never changes."""
    rng = np.random.default_rng(seed)
    out = []
    for d in range(days):
        for i in range(n):
            at = np.sort(rng.permutation(wide)[: rng.integers(2, wide + 1)])
            v = np.full(len(at), 2.5) if i == 4 else rng.integers(0, 5, len(at)).astype(float) * (1e6 if i == 5 else 1)
            out.append((d, f"s{i:02d}", [int(x) for x in at], [float(x) for x in v]))
    return out


def _rank(v):
    out = np.empty(len(v))
    out[np.argsort(v, kind="stable")] = np.arange(len(v))
    return out


def _corr(a, b, ranked):
    common = sorted(set(a[2]) & set(b[2]))
    x, y = (np.array([dict(zip(s[2], s[3]))[t] for t in common]) for s in (a, b))
    if len(common) == 0:
        return np.nan, 0
    if ranked:
        x, y = _rank(x), _rank(y)
    return (np.nan if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1]), len(common)


@pytest.mark.parametrize("ranked, tile", [(False, 100), (False, 5), (True, 100), (True, 4)])
def test_mean_with_others_matches_loops(spark, ranked, tile):
    rows = _series()
    df = spark.createDataFrame(rows, "day int, id string, at array<long>, v array<double>").repartition(4)
    got = {(r.day, r.id): r.value for r in pairs.mean_with_others(df, ["day"], ranked, tile=tile).collect()}
    want = {}
    for a in rows:
        found = [abs(c) for b in rows if b[0] == a[0] and b[1] != a[1] for c, n in [_corr(a, b, ranked)] if n >= 3 and not np.isnan(c)]
        if found:
            want[a[0], a[1]] = np.mean(found)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = pairs.mean_with_others(df, ["day"], ranked, tile=tile)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("n, tile", [(2, 9), (3, 1), (23, 5), (24, 100)])
def test_median_of_pairs_is_exact(spark, n, tile):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 30)) + rng.normal(size=30)
    x[-1] = 1.0
    df = spark.createDataFrame([(f"s{i:02d}", list(range(30)), [float(v) for v in row]) for i, row in enumerate(x)], "id string, at array<long>, v array<double>")
    with np.errstate(all="ignore"):
        c = np.nan_to_num(np.corrcoef(x))[np.triu_indices(n, 1)]
    r = pairs.median_of_pairs(df, tile=tile, series_count=n).first()
    assert r.pairs == len(c) and np.allclose([r.mean, r.median, r.over_half, r.over_most], [c.mean(), np.median(c), (c > 0.5).mean(), (c > 0.8).mean()], atol=1e-12)


@pytest.mark.parametrize("slab", [10**6, 50])
def test_pairwise_matches_numpy(spark, slab):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4, 300)) * 1e3 + 1e6
    x[2] = 5.0
    rows = [(f"a{t % 7}", t, f"f{k}", float(x[k, t])) for t in range(300) for k in range(4) if (t + k) % 11]
    df = spark.createDataFrame(rows, "address string, time int, formula_id string, signal double").repartition(3)
    got = {(r.a, r.b): (r["corr"], r.n) for r in pairs.pairwise(df, ["address", "time"], "formula_id", "signal", slab).collect()}
    assert len(got) == 6
    for (a, b), (c, n) in got.items():
        i, j = int(a[1]), int(b[1])
        both = [t for t in range(300) if (t + i) % 11 and (t + j) % 11]
        assert n == len(both)
        assert c is None if 2 in (i, j) else abs(c - np.corrcoef(x[i, both], x[j, both])[0, 1]) < 1e-9
    assert pairs.pairwise(df.where(F.lit(False)), ["address", "time"], "formula_id", "signal").count() == 0


def test_median_of_pairs_sends_no_series_through_a_shuffle(spark):
    """Tiles sent each series to every other tile."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 200))
    df = spark.createDataFrame([(f"s{i:03d}", list(range(200)), [float(v) for v in row]) for i, row in enumerate(x)], "id string, at array<long>, v array<double>").repartition(3)
    r = pairs.median_of_pairs(df, tile=250, series_count=600)
    assert "FlatMapGroupsInArrow" not in r._jdf.queryExecution().executedPlan().toString()
    c = np.corrcoef(x)[np.triu_indices(600, 1)]
    got = r.first()
    assert got.pairs == len(c) and np.allclose([got.mean, got.median], [c.mean(), np.median(c)], atol=1e-12)
