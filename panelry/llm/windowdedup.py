"""Removal of repeated word windows: a count-min prefilter, then exact grouping.

A window is ``width`` consecutive words of one document.  A word goes if a window covers it whose
word sequence also starts in a document with a smaller doc_id.

1. *Sketch.*  Each batch of documents counts, once a document, the anchor of each window (its run of
   ``seed`` words with the smallest hash) in the rows of a count-min sketch.  A batch's sketch is
   sparse: it is dealt out by cell range and the ranges are summed.  A window's estimate is the
   smallest of its anchor's cells, and never below the number of documents that hold the window.
   The number of cells follows the data, so the sketch is as sharp at any size.
2. *Exact pass.*  Only windows estimated to be in two documents go on, as 128-bit hashes of their
   words, to the bucket that owns the hash.  Batches send a hash once, with its smallest doc_id,
   so a window that a third of all documents share costs one entry a batch.
3. Each batch learns which of its windows have a smaller owner and cuts its texts.

Nulls and empty texts have no words.  Rows that repeat a doc_id are handled as one document's
separate texts: they don't count against each other.  Rows with a null doc_id own nothing and lose
nothing.  Column names besides ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, buckets, keyed, slices, text_bytes, tidy_group
from .kernels import Words, flat, runs, windows

WIDTH, SEED = 13, 5
DEPTH, CELLS_PER_ANCHOR = 2, 8
#: Bytes of text for which one cell range or one bucket is provided.
RANGE_TEXT = 24 << 20
_NOBODY = np.iinfo(np.int64).max


def anchors(words: Words, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(window positions, anchor hash of each): the smallest hash of the ``seed``-word runs inside the window."""
    h = words.hashes(0)
    at, _ = windows(h, words.first, width)
    pos, runs_ = windows(h, words.first, seed)
    grams = np.full(len(h), np.iinfo(np.uint64).max, dtype=np.uint64)
    grams[pos] = runs_
    span, low = 1, grams
    while span * 2 <= width - seed + 1:  # doubling: minimum over 2, 4, 8, ... grams
        low = np.minimum(low, np.concatenate([low[span:], np.full(span, np.iinfo(np.uint64).max, np.uint64)])[: len(low)])
        span *= 2
    rest = width - seed + 1 - span
    low = np.minimum(low[at], low[at + rest]) if len(at) else low[at]
    return at, low


class Batch:
    """One batch of documents in a fixed order, with all that the three passes derive from it."""

    def __init__(self, table: pa.Table, width: int, seed: int, exact: bool = False):
        self.table = table.sort_by([("doc_id", "ascending"), ("place", "ascending")])
        self.width = width
        self.ids = self.table["doc_id"].fill_null(_NOBODY).to_numpy()
        at, low, row, pair, base = [], [], [], [], 0
        self.parts = []
        for part in slices(self.table):
            words = Words(*flat(part["text"]))
            a, l = anchors(words, width, seed)
            at.append(a), low.append(l), row.append(words.doc()[a] + base)
            if exact:
                pair.append(np.stack([windows(words.hashes(w), words.first, width, w)[1] for w in (0, 1)]))
            self.parts.append((base, part, words, len(a)))
            base += part.num_rows
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.low = np.concatenate(low) if low else np.zeros(0, np.uint64)
        self.row = np.concatenate(row) if row else np.zeros(0, np.int64)
        self.hash = np.concatenate(pair, axis=1) if pair else np.zeros((2, 0), np.uint64)

    def cells(self, ranges: int, per_range: int) -> list[np.ndarray]:
        """For each sketch row, the cell of each window's anchor."""
        out = []
        for depth in range(DEPTH):
            x = self.low if depth == 0 else (self.low * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (self.low >> np.uint64(29))
            out.append(((x >> np.uint64(20)) % np.uint64(ranges * per_range)).astype(np.int64))
        return out

    def entries(self, ranges: int, per_range: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The batch's sparse sketch, in order of cell range: ranges' edges, cells within their range (the
        sketch's rows one after another), whether two documents of the batch count there, and for each
        sketch row and window the entry that it counts in.
        """
        own = self.ids[self.row]
        where, cells, many, entry = [], [], [], []
        for depth, cell in enumerate(self.cells(ranges, per_range)):
            order = np.lexsort((own, cell))
            c, o = cell[order], own[order]
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            other = np.zeros(len(c), np.int64)
            other[1:] = ~new[1:] & (o[1:] != o[:-1])
            start = np.flatnonzero(new)
            many.append(np.add.reduceat(other, start) > 0 if len(start) else np.zeros(0, bool))
            place = np.empty(len(c), np.int64)
            place[order] = np.cumsum(new) - 1 + sum(map(len, where))
            entry.append(place)
            where.append(c[start] // per_range), cells.append(c[start] % per_range + depth * per_range)
        where = np.concatenate(where)
        order = np.argsort(where, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        edge = np.searchsorted(where[order], np.arange(ranges + 1))
        return edge, np.concatenate(cells)[order].astype(np.uint32), np.concatenate(many)[order], back[np.stack(entry)]

    def owned(self, maybe: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, hashes, smallest doc_id in the batch) of the windows that ``maybe`` marks."""
        first, second, own = self.hash[0][maybe], self.hash[1][maybe], self.ids[self.row[maybe]]
        order = np.lexsort((own, second, first))
        first, second, own = first[order], second[order], own[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        first, second, own = first[new], second[new], own[new]
        edge = np.searchsorted(first, (np.arange(count + 1, dtype=np.float64) / count * 2.0**64)[1:-1].astype(np.uint64))
        edge = np.concatenate([[0], edge, [len(first)]])
        for b in np.flatnonzero(np.diff(edge)):
            s = slice(edge[b], edge[b + 1])
            yield int(b), np.stack([first[s], second[s]]), own[s]


def _batched(docs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Documents with a batch number; the same rows get the same batch in each pass."""
    count = buckets(docs.sparkSession, size, BATCH_BYTES)
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    docs = docs.withColumn("batch", F.pmod(key, F.lit(count)).cast("int"))
    return docs.withColumn("place", F.xxhash64("text")), count


def repeated_windows(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, text, n_words, removed, kept): each document's words, those removed and the text left.

    ``removed`` is a list of [start, end) word ranges; ``kept`` joins the words left by one space.
    """
    spark = docs.sparkSession
    docs = keyed(docs)
    size = text_bytes(docs)
    docs, batches = _batched(docs, size)
    ranges = buckets(spark, size, RANGE_TEXT)
    per_range = max(1024, CELLS_PER_ANCHOR * (size // 25) // ranges)  # about one anchor in 25 bytes of prose

    def count(table: pa.Table) -> pa.Table:
        batch = Batch(table, width, seed)
        edge, cells, many, _ = batch.entries(ranges, per_range)
        rows = [(int(r), cells[edge[r] : edge[r + 1]].tobytes(), np.packbits(many[edge[r] : edge[r + 1]]).tobytes()) for r in np.flatnonzero(np.diff(edge))]
        number = table["batch"][0].as_py()
        return pa.table({"slot": pa.array([x[0] for x in rows], pa.int32()), "batch": pa.array([number] * len(rows), pa.int32()), "cells": pa.array([x[1] for x in rows], pa.binary()), "many": pa.array([x[2] for x in rows], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(DEPTH * per_range, np.uint8)
        entries = []
        for cells, many in zip(table["cells"], table["many"], strict=True):
            cells = np.frombuffer(cells.as_py(), np.uint32)
            bits = np.unpackbits(np.frombuffer(many.as_py(), np.uint8), count=len(cells))
            total[cells] = np.minimum(total[cells] + 1 + bits, 2)
            entries.append(cells)
        full = [np.packbits(total[c] > 1).tobytes() for c in entries]
        return pa.table({"batch": table["batch"], "slot": table["slot"], "bits": pa.array(full, pa.binary())})

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        """The windows that the merged sketch can't rule out, dealt by hash."""
        empty = pa.table({"slot": pa.array([], pa.int32()), "batch": pa.array([], pa.int32()), "hashes": pa.array([], pa.binary()), "owners": pa.array([], pa.binary())})
        if not left.num_rows:
            return empty
        batch = Batch(left, width, seed, exact=True)
        rows = [(b, h.tobytes(), o.tobytes()) for b, h, o in batch.owned(_maybe(batch, right, ranges, per_range), ranges)]
        number = left["batch"][0].as_py()
        return pa.table({"slot": pa.array([x[0] for x in rows], pa.int32()), "batch": pa.array([number] * len(rows), pa.int32()), "hashes": pa.array([x[1] for x in rows], pa.binary()), "owners": pa.array([x[2] for x in rows], pa.binary())})

    def decide(table: pa.Table) -> pa.Table:
        """Of each batch's hashes in this bucket, those that start in a smaller document of another batch."""
        parts = [np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x in table["hashes"]]
        owners = [np.frombuffer(x.as_py(), np.int64) for x in table["owners"]]
        h, o = np.concatenate(parts, axis=1), np.concatenate(owners)
        order = np.lexsort((h[1], h[0]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(h[0][order]) != 0) | (np.diff(h[1][order]) != 0)
        low = np.minimum.reduceat(o[order], np.flatnonzero(new))
        least = np.empty(len(o), np.int64)
        least[order] = low[np.cumsum(new) - 1]
        later = np.split(least < o, np.cumsum([len(x) for x in owners])[:-1])
        return pa.table({"batch": table["batch"], "slot": table["slot"], "bits": pa.array([np.packbits(x).tobytes() for x in later], pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """Texts without the words of windows that have a smaller owner."""
        if not left.num_rows:
            return _cut_schema().empty_table()
        sketch, verdict = right.filter(pc.equal(right["kind"], 0)), right.filter(pc.equal(right["kind"], 1))
        batch = Batch(left, width, seed, exact=True)
        maybe = _maybe(batch, sketch, ranges, per_range)
        smaller = _later(batch, maybe, verdict, ranges)
        return _cut(batch, maybe, smaller)

    sketch = docs.groupBy("batch").applyInArrow(tidy_group(count), "slot int, batch int, cells binary, many binary")
    sketch = sketch.groupBy("slot").applyInArrow(tidy_group(merge), "batch int, slot int, bits binary")
    candidates = docs.groupBy("batch").cogroup(sketch.groupBy("batch")).applyInArrow(tidy_group(own), "slot int, batch int, hashes binary, owners binary")
    verdicts = candidates.groupBy("slot").applyInArrow(tidy_group(decide), "batch int, slot int, bits binary")
    news = sketch.withColumn("kind", F.lit(0)).unionByName(verdicts.withColumn("kind", F.lit(1)))
    return docs.groupBy("batch").cogroup(news.groupBy("batch")).applyInArrow(tidy_group(cut), "doc_id long, text string, n_words long, removed array<array<int>>, kept string")


def _maybe(batch: Batch, sketch: pa.Table, ranges: int, per_range: int) -> np.ndarray:
    """Positions of windows whose anchor's cells all count two documents."""
    full = {s: np.frombuffer(b, np.uint8) for s, b in zip(sketch["slot"].to_pylist(), sketch["bits"].to_pylist(), strict=True)}
    edge, cells, _, entry = batch.entries(ranges, per_range)
    flag = np.zeros(len(cells), bool)
    for r in np.flatnonzero(np.diff(edge)):
        flag[edge[r] : edge[r + 1]] = np.unpackbits(full[int(r)], count=int(edge[r + 1] - edge[r]))
    return np.flatnonzero(flag[entry].all(0))


def _later(batch: Batch, maybe: np.ndarray, verdict: pa.Table, ranges: int) -> np.ndarray:
    """For each window of ``maybe``: does it start in a smaller document too?"""
    later = {s: np.frombuffer(b, np.uint8) for s, b in zip(verdict["slot"].to_pylist(), verdict["bits"].to_pylist(), strict=True)}
    hashes, flags, owners = [], [], []
    for b, h, o in batch.owned(maybe, ranges):
        hashes.append(h), owners.append(o), flags.append(np.unpackbits(later[b], count=len(o)).astype(bool))
    if not hashes:
        return np.zeros(0, bool)
    h, o, f = np.concatenate(hashes, axis=1), np.concatenate(owners), np.concatenate(flags)
    # owned() is in order of the hashes, so the windows find their entry by the order of both
    mine = batch.hash[:, maybe]
    order = np.lexsort((mine[1], mine[0]))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(mine[0][order]) != 0) | (np.diff(mine[1][order]) != 0)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    own = batch.ids[batch.row[maybe]]
    return (f[entry] | (o[entry] < own)) & (own != _NOBODY)


def _cut_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("removed", pa.list_(pa.list_(pa.int32()))), ("kept", pa.string())])


def _cut(batch: Batch, maybe: np.ndarray, smaller: np.ndarray) -> pa.Table:
    hit = np.zeros(len(batch.at), bool)
    hit[maybe[smaller]] = True
    out, seen = [], 0
    for base, part, words, count in batch.parts:
        at = batch.at[seen : seen + count][hit[seen : seen + count]]
        seen += count
        delta = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + batch.width, -1)
        gone = np.cumsum(delta)[:-1] > 0
        data = words.data.tobytes()
        n, removed, kept = [], [], []
        for d in range(part.num_rows):
            a, b = words.first[d], words.first[d + 1]
            n.append(b - a)
            s, e = runs(gone[a:b])
            removed.append(np.stack([s, e], 1).tolist())
            keep = np.flatnonzero(~gone[a:b]) + a
            kept.append(b" ".join([data[x:y] for x, y in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)]).decode())
        out.append(pa.table([part["doc_id"], part["text"], pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.string())], schema=_cut_schema()))
    return pa.concat_tables(out) if out else _cut_schema().empty_table()


def digest(kept: str) -> str:
    """Lowercase hex SHA-256 of the text left."""
    return hashlib.sha256(kept.encode()).hexdigest()
