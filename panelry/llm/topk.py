"""Exact top-k by inner product over an impact-ordered index, one score at a time.

Vectors are turned into integers, ``floor(SCALE * x)``.  They are dealt into shards of bounded size;
each shard is an index of its own: for every dimension, its vectors sorted by the value's quantised
level.  All vectors of one dimension and one level form a posting segment, whose impact on a query is
the query's value times the level.

A query processes a shard's segments by descending quantised impact and adds up the exact values of their
postings.  Whatever is still to come of a vector is bounded by the number of its postings that are left
times the largest contribution left, so its score lies between two bounds.  Now and then the query looks:
a vector whose upper bound lies under the k-th largest lower bound cannot be among the k best.  The query
stops once rescoring the vectors that this proof leaves, exactly and whole, costs less than reading on.
A vector of the index has integers under 2**21, so that with up to 2048 dimensions its sums and their bounds are exact in
doubles as well.  Vectors with larger ones (or longer vectors) lie beside the index: every query meets them in whole numbers
of any length, and such a query meets every vector so.

Queries travel in blocks of ``BLOCK`` to all shards; a shard builds its index once a block and answers with
its k best, and a query's answers are merged.  Equal scores go to the smaller vec_id; a vector that ties with the last place stays possible.

Vectors that are null, or hold a null or a component that is not finite, take no part; nor do rows with
a null id.  A score that no long holds is shown as the nearest long, but ranked by its own value.  Vectors of another length than the query's are no candidates for it.  Of rows that repeat a
query's id, the smallest vector asks; every row with another id is a candidate, and only such rows
count for the bounds.  Empty tables give no
rows.  Other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

SCALE = 1024
#: Integers of the index are smaller, and its vectors no longer; the largest long.
PLAIN, WIDE, _MOST = 2.0**21, 2048, (1 << 63) - 1
#: Vectors in a shard, queries in a block, levels of a dimension on either side of zero.
SHARD, BLOCK, LEVELS = 16384, 8192, 24
#: Looks at the bounds, after equal shares of the postings.
LOOKS = 12


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, v, x): the vectors that take part, as arrays of whole numbers v, or as they are, x, where these are too large."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    large = F.exists("embedding", lambda x: F.abs(x.cast("double")) * SCALE >= PLAIN) | (F.size("embedding") > WIDE)
    rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(F.coalesce(fine, F.lit(False)))
    whole = F.when(~large, F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.when(large, F.col("embedding").cast("array<double>")).alias("x"))


def _asked(queries: DataFrame) -> DataFrame:
    """One vector an id: of rows that repeat one, the smallest."""
    order = F.coalesce(F.col("v").cast("array<double>"), F.transform("x", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)))
    best = F.min_by(F.struct("v", "x"), order)
    return integers(queries).groupBy("vec_id").agg(best.alias("best")).select("vec_id", "best.v", "best.x")


def exact(x: np.ndarray) -> list[int]:
    """floor(SCALE * x) of finite doubles, in whole numbers of any length."""
    return [math.floor(v * SCALE) if abs(v) < 2.0**53 else int(v) * SCALE for v in x.tolist()]


def _exact_best(ids: list[int], vectors: list[list[int]], query: list[int], own: int, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best of these vectors."""
    scores = [(i, sum(a * b for a, b in zip(v, query, strict=True))) for i, v in zip(ids, vectors, strict=True) if i != own]
    return sorted(scores, key=lambda r: (-r[1], r[0]))[:k]


def _beyond(score: int) -> bytes | None:
    """A key in the order of scores at the ends of the longs and beyond."""
    return None if -_MOST <= score < _MOST else (score + (1 << 2200)).to_bytes(280, "big")


class Shard:
    """The impact-ordered index of some vectors of one length: postings by dimension and level, one after another.

    ``read`` and ``held`` count the postings that queries read, and those they would read without a stop.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        step = np.maximum(1.0, (np.abs(vectors).max(0) if n else np.zeros(dims)) / LEVELS)
        level = np.rint(vectors / step).astype(np.int32)
        order = np.argsort(level, axis=0, kind="stable")
        rank = np.take_along_axis(level, order, 0).T  # by dimension, in order of the level
        new = np.ones(rank.shape, bool)
        new[:, 1:] = rank[:, 1:] != rank[:, :-1]
        self.doc = np.ascontiguousarray(order.T).ravel()
        self.value = np.take_along_axis(vectors, order, 0).T.ravel()
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, n * dims))
        self.dim = self.start // n if n else np.zeros(0, np.int64)
        self.level = rank.ravel()[self.start] * step[self.dim]
        # no posting of a segment has a larger value, whatever its level says
        self.most = np.maximum.reduceat(np.abs(self.value), self.start) if n else np.zeros(0)
        self.read = self.held = 0

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best vectors of the shard."""
        n, dims = self.vectors.shape
        order = np.argsort(-np.abs(query[self.dim] * self.level), kind="stable")
        limit = (np.abs(query[self.dim]) * self.most)[order]
        # the largest contribution that a posting can still make after each segment
        limit = np.append(np.maximum.accumulate(limit[::-1])[::-1], 0)
        share = np.cumsum(self.size[order])
        total, met = np.zeros(n, np.int64), np.zeros(n, np.int64)
        possible = other = np.flatnonzero(self.ids != own)  # rows with the query's own id prove nothing
        self.held += n * dims
        at = 0
        for stop in np.searchsorted(share, n * dims * np.arange(1, LOOKS + 1) / LOOKS) + 1 if n else ():
            stop = min(int(stop), len(order))
            if stop > at:
                some = order[at:stop]
                size = self.size[some]
                edge = np.cumsum(size)
                take = np.repeat(self.start[some] - edge + size, size) + np.arange(edge[-1])
                doc = self.doc[take]
                total += np.bincount(doc, self.value[take] * np.repeat(query[self.dim[some]], size), minlength=n).astype(np.int64)
                met += np.bincount(doc, minlength=n)
                self.read += int(edge[-1])
                at = stop
            if k < len(other):
                # a vector's postings that are left move its sum by ``limit`` each at most, up or down
                slack = (dims - met[other]) * limit[at]
                reached = total[other]
                low = reached - slack
                low = np.partition(low, len(other) - k)[len(other) - k]
                possible = other[reached + slack >= low]
            # rescoring the possible ones is now cheaper than reading on
            if len(possible) * dims <= n * dims - (share[at - 1] if at else 0):
                break
        score = self.vectors[possible] @ query
        first = np.lexsort((self.ids[possible], -score))[:k]
        return self.ids[possible][first], score[first]


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each query, both as (vec_id, embedding)."""
    spark = rows.sparkSession
    candidates = settled(integers(rows), "vectors")
    asked = _asked(queries)
    n, q = candidates.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD), int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, -(-q // BLOCK)) if n > SHARD else 1), max(1, -(-q // BLOCK))

    def packed(table: pa.Table) -> tuple[list[int], list[np.ndarray | None], list[np.ndarray | None]]:
        return table["vec_id"].to_pylist(), *([x.values.to_numpy() if x.is_valid else None for x in table[c]] for c in ("v", "x"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        ids, vectors, large = packed(left)
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if v is not None:
                by_size.setdefault(len(v), []).append(i)
        index = {size: Shard(np.array([ids[i] for i in at], np.int64), np.stack([vectors[i] for i in at])) for size, at in by_size.items()}
        beside = [(i, exact(x)) for i, x in zip(ids, large, strict=True) if x is not None]
        for own, v, x in zip(*packed(right), strict=True):
            query = v.tolist() if x is None else exact(x)
            fit = [r for r in beside if len(r[1]) == len(query)]
            found = []
            if x is not None:
                fit += [(ids[i], vectors[i].tolist()) for i in by_size.get(len(query), ())]
            elif len(v) in index:
                found = [(int(i), int(score)) for i, score in zip(*index[len(v)].best(v, own, k), strict=True)]
            if fit:
                found = sorted(found + _exact_best([i for i, _ in fit], [y for _, y in fit], query, own, k), key=lambda r: (-r[1], r[0]))[:k]
            out += [(own, i, score) for i, score in found]
        return pa.table({
            "query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()),
            "score": pa.array([max(-_MOST - 1, min(_MOST, r[2])) for r in out], pa.int64()), "beyond": pa.array([_beyond(r[2]) for r in out], pa.binary()),
        })

    # the stated queries meet all rows: every block goes to every shard
    spread = candidates.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards)))
    spread = spread.withColumn("cell", F.explode(F.sequence(F.col("shard"), F.lit(shards * blocks - 1).cast("long"), F.lit(shards).cast("long"))))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) * shards
    asked = asked.withColumn("cell", F.explode(F.sequence(block, block + shards - 1)))
    found = spread.select("cell", "vec_id", "v", "x").groupBy("cell").cogroup(asked.select("cell", "vec_id", "v", "x").groupBy("cell")).applyInArrow(search, "query_id long, vec_id long, score long, beyond binary")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
