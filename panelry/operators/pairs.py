"""Correlations of all pairs of series, by tiles: products of matrices in place of a join of rows with rows.

Series are dealt into tiles of about ``TILE``; two tiles meet in one task, as two matrices over their common
places.  A series travels to as many tasks as there are tiles, so the rows sent grow with series times tiles, and the
pairs, which grow with the square, never leave a task but as sums, counts or a histogram.  Where there is but one group of
series, ``median_of_pairs`` sends slabs of them to all tasks in turn instead, and moves nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import settled

#: Series in a tile; series in a slab, and of those that meet it at a time; bins of a histogram of correlations.
TILE, SLAB, MEET, BINS = 128, 4096, 512, 1 << 16


def _matrix(rows: pa.Table, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of each series (0 where there is none, less the series' mean), and which there are."""
    size = np.array([len(x) for x in rows["at"]], np.int64)
    at = np.searchsorted(places, np.concatenate([np.asarray(x.values) for x in rows["at"]]) if len(size) else np.zeros(0, np.int64))
    value = np.concatenate([np.asarray(x.values, float) for x in rows["v"]]) if len(size) else np.zeros(0)
    x, held = np.zeros((len(size), len(places))), np.zeros((len(size), len(places)))
    who = np.repeat(np.arange(len(size)), size)
    x[who, at], held[who, at] = value, 1
    x -= held * (x.sum(1) / np.maximum(held.sum(1), 1))[:, None]
    return x, held


def _ranks(x: np.ndarray, held: np.ndarray, other: np.ndarray) -> np.ndarray:
    """(series, others, places): the rank of each value among the places that both series have; the earlier place first of equals."""
    before = (x[:, None, :] < x[:, :, None]) | ((x[:, None, :] == x[:, :, None]) & np.tri(x.shape[1], k=-1, dtype=bool)[None])
    return np.einsum("ats,bs->abt", before * held[:, None, :], other, optimize=True)


def correlations(left: pa.Table, right: pa.Table, ranked: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(correlation, common places) of each series of ``left`` with each of ``right``; NaN where one doesn't vary there."""
    every = [np.asarray(x.values) for side in (left, right) for x in side["at"]]
    places = np.unique(np.concatenate(every)) if every else np.zeros(0, np.int64)
    (x, mx), (y, my) = _matrix(left, places), _matrix(right, places)
    with np.errstate(all="ignore"):
        if not ranked and mx.all() and my.all():  # no gaps, so one product will do
            sx, sy, sxx, syy, t = x.sum(1)[:, None], y.sum(1)[None, :], (x * x).sum(1)[:, None], (y * y).sum(1)[None, :], len(places)
            vx, vy = sxx - sx * sx / t, syy - sy * sy / t
            flat = (vx <= 1e-14 * sxx) | (vy <= 1e-14 * syy)
            return np.where(flat, np.nan, np.clip((x @ y.T - sx * sy / t) / np.sqrt(vx * vy), -1, 1)), np.full((len(x), len(y)), float(t))
        n = mx @ my.T
        if ranked:
            both = mx[:, None, :] * my[None, :, :]
            p, q = _ranks(x, mx, my) * both, _ranks(y, my, mx).transpose(1, 0, 2) * both
            sx, sy, sxx, syy, sxy = p.sum(2), q.sum(2), (p * p).sum(2), (q * q).sum(2), (p * q).sum(2)
        else:
            sx, sy, sxx, syy, sxy = x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        flat = (vx <= 1e-14 * sxx) | (vy <= 1e-14 * syy)  # what rounding leaves of a constant
        return np.where(flat, np.nan, np.clip((sxy - sx * sy / n) / np.sqrt(vx * vy), -1, 1)), n


def _tiled(series: DataFrame, by: list[str], tile: int, series_count: int | None) -> DataFrame:
    """Every series in each meeting (``lo``, ``hi``) of its tile with another, or itself."""
    count = series.agg(F.approx_count_distinct("id")).first()[0] if series_count is None else series_count
    tiles = max(1, -(-count // tile))
    own = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    out = series.select(*by, "id", "at", "v", own.alias("tile")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return out.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}).drop("other")


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The two tiles of a meeting, each in order of id; and whether they are one."""
    table = table.sort_by("id")
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    tile = table["tile"].to_numpy()
    return table.filter(pa.array(tile == lo)), table.filter(pa.array(tile == hi)), lo == hi


def mean_with_others(series: DataFrame, by: list[str], ranked: bool = False, least: int = 3, tile: int = TILE, series_count: int | None = None) -> DataFrame:
    """(by, id, value): the mean absolute correlation of each series with every other of its group that shares ``least`` places.

    ``series`` are (by, id, at, v): two arrays of equal length, places and values.  Pairs of which one doesn't vary don't count.
    """
    keys = [f for f in series.schema.fields if f.name in by]

    def meet(table: pa.Table) -> pa.Table:
        a, b, same = _sides(table)
        c, n = correlations(a, b, ranked)
        c = np.abs(np.where(n >= least, c, np.nan))
        if same:
            np.fill_diagonal(c, np.nan)
        told = ~np.isnan(c)
        total, count = np.where(told, c, 0), told.astype(np.int64)
        parts = [(a["id"], total.sum(1), count.sum(1))] + ([] if same else [(b["id"], total.sum(0), count.sum(0))])
        ids = pa.chunked_array([x for p in parts for x in p[0].chunks], series_type)
        columns = {f.name: pa.chunked_array([pa.repeat(table[f.name][0], len(ids))]) for f in keys}
        return pa.table(columns | {"id": ids, "total": np.concatenate([p[1] for p in parts]), "n": np.concatenate([p[2] for p in parts])})

    kind = series.schema["id"].dataType.simpleString()
    series_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in keys] + [f"id {kind}", "total double", "n long"])
    met = _tiled(series, by, tile, series_count).groupBy(*by, "lo", "hi").applyInArrow(meet, schema)
    out = met.groupBy(*by, "id").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")
    return out.select(*by, "id", (F.col("total") / F.col("n")).alias("value"))


def median_of_pairs(series: DataFrame, tile: int = SLAB, series_count: int | None = None) -> DataFrame:
    """One row (pairs, mean, median, over_half, over_most) over the correlations of all pairs; a pair of which one doesn't vary counts as 0.

    The last two are the shares of pairs above 0.5 and above 0.8.

    Series are dealt into slabs of about ``tile``.  One slab after another is sent to all tasks, which read the series where they
    are and meet it with theirs, so no series is written or shuffled once more for a meeting.  Tasks first send a histogram of their pairs.
    Of its ``BINS`` bins one or two hold the median, and only their values are sent in the second pass, each distinct one with its count.
    """
    spark = series.sparkSession
    count = series.agg(F.approx_count_distinct("id")).first()[0] if series_count is None else series_count
    slabs = max(1, -(-count // tile))
    series = series.select("id", "at", "v", F.pmod(F.xxhash64("id"), F.lit(slabs)).cast("int").alias("slab"))
    place = lambda c: np.minimum(((c + 1) * (BINS / 2)).astype(np.int64), BINS - 1)

    def meetings(k, one):
        """The rows of slab ``k`` and after, and a function that gives the correlations of some of them with the slab's, each pair once."""
        table = series.where(F.col("slab") == k).select("id", "at", "v").toArrow().sort_by("id")  # a slab
        sent = spark.sparkContext.broadcast(table)

        def met(batches):
            right = sent.value
            ids = {x: i for i, x in enumerate(right["id"].to_pylist())}
            for batch in batches:
                for a in range(0, batch.num_rows, MEET):
                    left = pa.Table.from_batches([batch.slice(a, MEET)])
                    c = np.nan_to_num(correlations(left, right)[0])
                    own = np.array([ids.get(x, -1) if s == k else -1 for x, s in zip(left["id"].to_pylist(), left["slab"].to_pylist(), strict=True)], np.int64)
                    yield c[np.arange(len(right))[None, :] > own[:, None]]

        return one(series.where(F.col("slab") >= k), met), sent

    def binned(rows, met):
        def run(batches):
            sums = np.zeros((4, BINS))
            for c in met(batches):
                at = place(c)
                sums += [np.bincount(at, minlength=BINS), np.bincount(at, c, BINS), *(np.bincount(at[c > x], minlength=BINS) for x in (0.5, 0.8))]
            some = np.flatnonzero(sums[0])
            n, total, half, most = sums[:, some]
            yield pa.record_batch({"bin": some, "n": n.astype(np.int64), "total": total, "half": half.astype(np.int64), "most": most.astype(np.int64)})

        parts = rows.mapInArrow(run, "bin long, n long, total double, half long, most long")
        return parts.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "total", "half", "most")]).collect()  # at most one row a bin

    def told(rows, met):
        def run(batches):
            for c in met(batches):
                c, n = np.unique(c[np.isin(place(c), wanted)], return_counts=True)
                yield pa.record_batch({"c": c, "n": n.astype(np.int64)})

        return settled(rows.mapInArrow(run, "c double, n long"), "middle")

    bins: dict[int, list] = {}
    for k in range(slabs):
        found, sent = meetings(k, binned)
        for r in found:
            bins[r["bin"]] = [x + y for x, y in zip(bins.get(r["bin"], (0, 0.0, 0, 0)), r[1:], strict=True)]
        sent.destroy()
    order = sorted(bins)
    pairs, total, half, most = (sum(bins[x][i] for x in order) for i in range(4))
    middle = {(pairs + 1) // 2, pairs // 2 + 1}
    ends = np.cumsum([bins[x][0] for x in order])
    wanted = np.unique([order[int(np.searchsorted(ends, m))] for m in middle]) if pairs else np.zeros(0, np.int64)
    before = sum(bins[x][0] for x in order if len(wanted) and x < wanted[0])
    inside = None
    for k in range(slabs):
        found, sent = meetings(k, told)
        inside = found if inside is None else inside.unionByName(found)
        sent.destroy()
    inside = inside.groupBy("c").agg(F.sum("n").alias("n"))
    inside = inside.withColumn("_end", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("c")) + before)  # distinct values of one bin, or two
    in_middle = [F.when((F.col("_end") >= m) & (F.col("_end") - F.col("n") < m), F.col("c")) for m in ((pairs + 1) // 2, pairs // 2 + 1)]
    known = [F.lit(x / pairs if pairs else None).cast("double").alias(c) for c, x in (("mean", total), ("over_half", half), ("over_most", most))]
    return inside.agg(F.lit(pairs).cast("long").alias("pairs"), *known, ((F.max(in_middle[0]) + F.max(in_middle[1])) / 2).alias("median"))


def pairwise(rows: DataFrame, key: list[str], id: str, value: str, slab_rows: int = 500_000) -> DataFrame:
    """(a, b, corr, n) of all pairs a < b of a few series with many rows, as (key, id, value).

    Keys are dealt into slabs of about ``slab_rows`` rows; a slab is one matrix product and sends its sums of each pair, which
    Spark adds up.  The values of each series are taken less its mean, so that sums lose no digits.
    """
    centre = rows.groupBy(id).agg(F.avg(value).alias("_mean"), F.count(value).alias("_n"))
    slabs = max(1, -(-int(centre.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]) // slab_rows))
    whole = rows.join(F.broadcast(centre), id) if slabs == 1 else rows.join(centre, id)
    parts = whole.select(F.pmod(F.xxhash64(*key), F.lit(slabs)).alias("slab"), F.to_json(F.struct(*key)).alias("key"), F.col(id).cast("string").alias("id"), (F.col(value).cast("double") - F.col("_mean")).alias("x"))
    parts = parts.where("x IS NOT NULL")

    def gram(table: pa.Table) -> pa.Table:
        at = table["key"].combine_chunks().dictionary_encode()
        names = sorted(set(table["id"].to_pylist()))
        who = np.searchsorted(np.array(names), np.array(table["id"].to_pylist()))
        x, m = np.zeros((len(at.dictionary), len(names))), np.zeros((len(at.dictionary), len(names)))
        x[at.indices.to_numpy(), who], m[at.indices.to_numpy(), who] = table["x"].to_numpy(), 1
        a, b = np.triu_indices(len(names), 1)
        sums = {"n": m.T @ m, "x": x.T @ m, "y": m.T @ x, "xx": (x * x).T @ m, "yy": m.T @ (x * x), "xy": x.T @ x}
        return pa.table({"a": pa.array([names[k] for k in a], pa.string()), "b": pa.array([names[k] for k in b], pa.string())} | {k: v[a, b] for k, v in sums.items()})

    sums = parts.groupBy("slab").applyInArrow(gram, "a string, b string, n double, x double, y double, xx double, yy double, xy double")
    by = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).where("n > 0")
    vx, vy = (F.col(f"{c}{c}") - F.col(c) * F.col(c) / F.col("n") for c in "xy")
    flat = (vx <= 1e-14 * F.col("xx")) | (vy <= 1e-14 * F.col("yy"))
    corr = F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(vx * vy))))
    return by.select("a", "b", corr.alias("corr"), F.col("n").cast("long").alias("n"))
