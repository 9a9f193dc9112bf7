"""Removal of repeated byte strings by a range-partitioned, sparse suffix array.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller
doc_id.

1. *Thinning.*  Every string of ``length`` bytes holds an anchor: a run of ``seed`` bytes whose hash is
   the smallest in it.  Equal strings have equal anchors at equal places, so only suffixes that start
   at anchors are kept (about one byte in fourteen), each with the bytes before it that a string
   around the anchor can reach.  A sketch of the anchors, dealt by cell range and summed, rules out those
   that only one document has.  Its size follows the data; it overestimates, so none is lost.
2. *Range partition.*  Splitters sampled from the corpus cut the suffixes into ranges of leading bytes.
   A batch of documents sends equal suffixes once, with their smallest doc_id.  A boundary never parts
   suffixes with the same leading ``seed`` bytes, and no match is shorter, so comparing neighbours
   inside a range compares across boundaries too.
3. *Sort.*  Each range sorts its suffixes by several keys, eight bytes a step, only suffixes still tied going on to
   the next; numpy's own sort takes the place of a quicksort's three-way partition.  Common prefixes of neighbours give the classes of equal strings for every
   place of the anchor in the string, and each class its smallest doc_id.
4. Batches learn which of their strings have a smaller owner and cut their texts.

An anchor that very many documents share, with different bytes before it, would fill one range; such
anchors (``HOT`` documents and more in the sketch) send each string around them as a suffix of its own,
so they spread by the strings' own leading bytes.

Nulls and empty texts have no bytes.  Rows that repeat a doc_id don't count against each other.  Rows
with a null doc_id own nothing and lose nothing.  Columns besides ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, SLICE_BYTES, buckets, keyed, text_bytes, tidy, tidy_group
from .kernels import flat, mix, powers, runs

LENGTH, SEED = 50, 24
CELLS_PER_ANCHOR = 12
#: Documents that share an anchor from which its strings travel one by one.
HOT = 200
#: Bytes of text for which one cell range or one range of suffixes is provided.
RANGE_TEXT = 16 << 20
#: Documents and suffixes of the sample for splitters; splitters at most.
SAMPLE_DOCS, SAMPLE_EACH, SPLITTERS = 3000, 40, 1 << 15
_NOBODY = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_TOP = np.iinfo(np.uint32).max


def _slide(x: np.ndarray, width: int, low: bool) -> np.ndarray:
    """Minimum (or maximum) of ``width`` values from each place on; the values past the end don't count."""
    take, pad = (np.minimum, _TOP) if low else (np.maximum, 0)
    x = np.concatenate([x, np.full(width, pad, x.dtype)])
    span = 1
    while span * 2 <= width:
        x[:-span] = take(x[:-span], x[span:])
        span *= 2
    rest = width - span
    n = len(x) - width
    return take(x[:n], x[rest : rest + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all strings of ``length`` bytes inside one document each."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[data] * powers(_BASE, n), out=total[1:])
        full = (total[seed:] - total[:-seed]) * powers(pow(_BASE, -1, 1 << 64), n - seed + 1)
    # half of the hash decides; equal halves make an anchor more, never one less
    h = np.full(n, _TOP, np.uint32)
    h[: n - seed + 1] = np.minimum(full >> np.uint64(32), _TOP - 1)
    width = length - seed + 1
    ends = offsets[1:]
    for back in range(1, seed):  # runs that would pass a document's end
        h[np.maximum(ends - back, offsets[:-1])[ends > offsets[:-1]]] = _TOP
    low = _slide(h, width, True)
    for back in range(1, length):
        low[np.maximum(ends - back, offsets[:-1])[ends > offsets[:-1]]] = 0
    # a place is an anchor if it is the minimum of some string that holds it
    high = _slide(np.concatenate([np.zeros(width - 1, np.uint32), low]), width, False)[:n]
    at = np.flatnonzero((high == h) & (h != _TOP))
    return at, mix(full[at])


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of big-endian words, one word after another.

    Rows are ordered by their first word; each further word orders only rows that are tied so far.
    Returns the order, and for each place whether its row equals the one before.
    """
    n, k = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    same = np.zeros(n, bool)
    if n:
        same[1:] = words[order[1:], 0] == words[order[:-1], 0]
    for c in range(1, k):
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~same)[at]
        own = order[at]
        own = own[np.lexsort((words[own, c], group))]
        order[at] = own
        word = words[own, c]
        same[at[1:]] &= (word[1:] == word[:-1]) | (group[1:] != group[:-1])
    return order, same


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 64-bit words."""
    n, w = rows.shape
    full = np.zeros((n, -(-w // 8) * 8), np.uint8)
    full[:, :w] = rows
    return full.view(">u8").astype(np.uint64)


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the row before (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


class Suffixes:
    """Layout of a suffix record: ``length`` bytes on, the bytes before in reverse, and how many of each are real."""

    def __init__(self, length: int, seed: int):
        self.length, self.seed, self.before = length, seed, length - seed
        self.width = length + self.before + 2

    def rows(self, data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, single: bool = False) -> np.ndarray:
        """Records of the suffixes at ``at`` in documents [begin, end); ``single``: only the string that starts there."""
        out = np.empty((len(at), self.width), np.uint8)
        ahead, back = np.minimum(end - at, self.length), np.zeros(len(at), np.int64) if single else np.minimum(at - begin, self.before)
        # 0xFF is in no UTF-8 text: it stands past the ends of a document
        padded = np.concatenate([np.full(self.before, 0xFF, np.uint8), data, np.full(self.length, 0xFF, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, self.before + self.length)
        near = view[at]
        out[:, : self.length], out[:, self.length : -2] = near[:, self.before :], near[:, self.before - 1 :: -1] if self.before else near[:, :0]
        for rows, size, part in ((np.flatnonzero(ahead < self.length), ahead, out[:, : self.length]), (np.flatnonzero(back < self.before), back, out[:, self.length : -2])):
            own = part[rows]
            own[np.arange(part.shape[1]) >= size[rows][:, None]] = 0xFF
            part[rows] = own
        out[:, -2], out[:, -1] = ahead + 1, back + 1
        return out

    def valid(self, rows: np.ndarray) -> np.ndarray:
        """Bit a is set if the string that starts a bytes before the suffix lies inside the document."""
        ahead, back = rows[:, -2].astype(np.int64) - 1, rows[:, -1].astype(np.int64) - 1
        low = np.maximum(self.length - ahead, 0)
        return np.where(low <= back, (np.int64(1) << (back + 1)) - (np.int64(1) << low), 0).astype(np.uint32)

    def owned(self, rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For distinct sorted records with their smallest doc_id: bit a is set if the string that starts a bytes before has a smaller owner."""
        n = len(rows)
        out = np.zeros(n, np.uint32)
        ahead = _common(rows[:, : self.length])
        near = ahead >= self.seed
        near[:-1] |= near[1:].copy()
        at = np.flatnonzero(near)  # the others' leading bytes are theirs alone
        if not len(at):
            return out
        rows, doc, ahead = rows[at], doc[at], ahead[at]
        left = rows[:, self.length : -2]
        order, _ = multikey_order(_words(left))
        back = _common(left[order])
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        valid = self.valid(rows)
        for a in range(self.before + 1):
            some = np.flatnonzero(valid >> np.uint32(a) & np.uint32(1))
            if not len(some):
                continue
            right = np.cumsum(ahead < self.length - a)[some]
            if a:
                key = right * len(at) + np.cumsum(back < a)[place[some]]
                by = np.argsort(key, kind="stable")
                new = np.ones(len(by), bool)
                new[1:] = key[by[1:]] != key[by[:-1]]
            else:
                by, new = np.arange(len(some)), np.concatenate([[True], right[1:] != right[:-1]])
            low = np.minimum.reduceat(doc[some][by], np.flatnonzero(new))
            least = np.empty(len(some), np.int64)
            least[by] = low[np.cumsum(new) - 1]
            out[at[some]] |= (least < doc[some]).astype(np.uint32) << np.uint32(a)
        return out


def _deltas(values: np.ndarray) -> bytes:
    """Sorted numbers as 16-bit steps; 0xFFFF steps on without a number."""
    step = np.diff(values, prepend=0)
    extra = step // 0xFFFF
    out = np.full(len(values) + int(extra.sum()), 0xFFFF, np.uint16)
    out[np.arange(len(values)) + np.cumsum(extra)] = step % 0xFFFF
    return out.tobytes()


def _sums(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, np.uint16)
    return np.cumsum(step.astype(np.int64))[step != 0xFFFF]


class Batch:
    """One batch of documents in a fixed order, with what the passes derive from it."""

    def __init__(self, table: pa.Table, length: int, seed: int):
        self.table = table.sort_by([("doc_id", "ascending"), ("place", "ascending")])
        self.form = Suffixes(length, seed)
        self.ids = self.table["doc_id"].fill_null(_NOBODY).to_numpy()
        self.data, self.offsets = flat(self.table["text"])
        at, low, first = [], [], 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + SLICE_BYTES)))
            last = min(last, len(self.ids))
            a, z = self.offsets[first], self.offsets[last]
            p, h = anchors(self.data[a:z], self.offsets[first : last + 1] - a, length, seed)
            at.append(p + a), low.append(h)
            first = last
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.low = np.concatenate(low) if low else np.zeros(0, np.uint64)
        self.row = np.searchsorted(self.offsets, self.at, side="right") - 1

    def entries(self, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct cells in order, documents that count in each, the entry of each anchor)."""
        cell = ((self.low >> np.uint64(16)) % np.uint64(cells)).astype(np.int64)
        own = self.ids[self.row]
        order = np.lexsort((own, cell))
        c, o = cell[order], own[order]
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        doc = new.copy()
        doc[1:] |= o[1:] != o[:-1]
        start = np.flatnonzero(new)
        count = np.add.reduceat(doc.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        entry = np.empty(len(c), np.int64)
        entry[order] = np.cumsum(new) - 1
        return c[start], count, entry

    def suffixes(self, mark: np.ndarray) -> None:
        """Distinct suffix records (``rows``, smallest doc ``owner``) of anchors marked 1, and of each string around those marked 2."""
        form = self.form
        one, many = np.flatnonzero(mark == 1), np.flatnonzero(mark == 2)
        begin, end = self.offsets[:-1][self.row], self.offsets[1:][self.row]
        a = np.arange(form.before + 1)
        start = self.at[many][:, None] - a
        ok = (start >= begin[many][:, None]) & (start + form.length <= end[many][:, None])
        string, src = np.unique(start[ok], return_index=True)
        src = np.broadcast_to(many[:, None], ok.shape)[ok][src]
        self.where = np.concatenate([self.at[one], string])
        self.whose = np.concatenate([self.row[one], self.row[src]])
        rows = np.concatenate([form.rows(self.data, self.at[one], begin[one], end[one]), form.rows(self.data, string, begin[src], end[src], True)])
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{form.width}").ravel(), kind="stable") if len(rows) else np.zeros(0, np.int64)
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        self.entry = np.empty(len(rows), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.rows = rows[new]
        self.owner = np.minimum.reduceat(self.ids[self.whose[order]], np.flatnonzero(new)) if len(rows) else np.zeros(0, np.int64)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): the [start, end) byte ranges removed, and the bytes left."""
    spark = docs.sparkSession
    docs = keyed(docs)
    size = text_bytes(docs)
    batches = buckets(spark, size, BATCH_BYTES)
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    docs = docs.withColumn("batch", F.pmod(key, F.lit(batches)).cast("int")).withColumn("place", F.xxhash64("text"))
    ranges = buckets(spark, size, RANGE_TEXT)
    per_range = max(1024, CELLS_PER_ANCHOR * (size // ((length - seed) // 2)) // ranges)
    cuts = _splitters(docs, size, length, seed, ranges)
    parts = -(-ranges // (len(cuts) + 1))

    def count(table: pa.Table) -> pa.Table:
        cells, docs_, _ = Batch(table, length, seed).entries(ranges * per_range)
        edge = np.searchsorted(cells, np.arange(ranges + 1) * per_range)
        used = np.flatnonzero(np.diff(edge))
        blobs = [(int(r), _deltas(cells[edge[r] : edge[r + 1]] - r * per_range), zstandard.compress(np.minimum(docs_[edge[r] : edge[r + 1]], 255).astype(np.uint8).tobytes(), 1)) for r in used]
        return pa.table({"slot": pa.array([x[0] for x in blobs], pa.int32()), "batch": pa.array([table["batch"][0].as_py()] * len(blobs), pa.int32()), "cells": pa.array([x[1] for x in blobs], pa.binary()), "counts": pa.array([x[2] for x in blobs], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(per_range, np.uint32)
        cells = [_sums(x) for x in table["cells"].to_pylist()]
        for c, n in zip(cells, table["counts"].to_pylist(), strict=True):
            total[c] += np.frombuffer(zstandard.decompress(n), np.uint8)
        mark = (total > 1).astype(np.uint8) + (total >= hot)
        return pa.table({"batch": table["batch"], "slot": table["slot"], "marks": pa.array([zstandard.compress(mark[c].tobytes(), 1) for c in cells], pa.binary())})

    def marked(batch: Batch, sketch: pa.Table) -> None:
        cells, _, entry = batch.entries(ranges * per_range)
        edge = np.searchsorted(cells, np.arange(ranges + 1) * per_range)
        mark = np.zeros(len(cells), np.uint8)
        for slot, marks in zip(sketch["slot"].to_pylist(), sketch["marks"].to_pylist(), strict=True):
            mark[edge[slot] : edge[slot + 1]] = np.frombuffer(zstandard.decompress(marks), np.uint8)
        batch.suffixes(mark[entry])

    def ranged(batch: Batch) -> Iterator[tuple[int, np.ndarray]]:
        """The range of leading bytes of each record: by splitters, and by hash where there are more ranges than splitters."""
        lead = np.ascontiguousarray(batch.rows[:, :seed]).view(f"S{seed}").ravel()
        at = np.searchsorted(cuts, lead, side="right") if len(cuts) else np.zeros(len(lead), np.int64)
        if parts > 1:
            spread = mix(_words(batch.rows[:, :seed]) @ powers(_BASE, -(-seed // 8)))
            at = at * parts + (spread % np.uint64(parts)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        edge = np.concatenate([[0], np.flatnonzero(np.diff(at[order])) + 1, [len(at)]])
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b > a:
                yield int(at[order[a]]), order[a:b]

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = []
        number = 0
        if left.num_rows:
            batch = Batch(left, length, seed)
            marked(batch, right)
            number = left["batch"][0].as_py()
            # by columns: neighbours in a range share their leading bytes
            blobs = [(r, zstandard.compress(np.ascontiguousarray(batch.rows[at]).tobytes(), 3), zstandard.compress(batch.owner[at].tobytes(), 1)) for r, at in ranged(batch)]
        return pa.table({"slot": pa.array([x[0] for x in blobs], pa.int32()), "batch": pa.array([number] * len(blobs), pa.int32()), "rows": pa.array([x[1] for x in blobs], pa.binary()), "owners": pa.array([x[2] for x in blobs], pa.binary())})

    def decide(table: pa.Table) -> pa.Table:
        form = Suffixes(length, seed)
        owners = [np.frombuffer(zstandard.decompress(x), np.int64) for x in table["owners"].to_pylist()]
        rows = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8).reshape(-1, form.width) for x in table["rows"].to_pylist()])
        owner = np.concatenate(owners)
        order, same = multikey_order(_words(rows))
        head = np.flatnonzero(~same)
        distinct = rows[order[head]]
        least = np.minimum.reduceat(owner[order], head)
        bits = form.owned(distinct, least)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(~same) - 1
        mine = np.where(least[group] < owner, form.valid(distinct)[group], bits[group]).astype(np.uint32)
        split = np.split(mine, np.cumsum([len(x) for x in owners])[:-1])
        return pa.table({"batch": table["batch"], "slot": table["slot"], "marks": pa.array([zstandard.compress(x.tobytes(), 1) for x in split], pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _schema().empty_table()
        batch = Batch(left, length, seed)
        marked(batch, right.filter(pc.equal(right["kind"], 0)))
        verdict = right.filter(pc.equal(right["kind"], 1))
        found = dict(zip(verdict["slot"].to_pylist(), verdict["marks"].to_pylist(), strict=True))
        mask = np.zeros(len(batch.rows), np.uint32)
        for r, at in ranged(batch):
            mask[at] = np.frombuffer(zstandard.decompress(found[r]), np.uint32)
        own = batch.ids[batch.whose]
        bits = np.where(own > batch.owner[batch.entry], batch.form.valid(batch.rows)[batch.entry], mask[batch.entry])
        bits[own == _NOBODY] = 0
        hit = np.zeros(len(batch.data) + length, np.int8)
        for a in range(batch.form.before + 1):
            hit[batch.where[np.flatnonzero(bits >> np.uint32(a) & np.uint32(1))] - a + length] = 1
        run = np.cumsum(hit, dtype=np.int32)
        gone = run[length:] > run[:-length]  # a marked string started within the last ``length`` bytes
        removed, kept = [], []
        for a, b in zip(batch.offsets[:-1], batch.offsets[1:], strict=True):
            s, e = runs(gone[a:b])
            removed.append(np.stack([s, e], 1).tolist())
            kept.append((batch.data[a:b][~gone[a:b]] if len(s) else batch.data[a:b]).tobytes())
        return pa.table([batch.table["doc_id"], pa.array(np.diff(batch.offsets), pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], schema=_schema())

    sketch = docs.groupBy("batch").applyInArrow(tidy_group(count), "slot int, batch int, cells binary, counts binary")
    sketch = sketch.groupBy("slot").applyInArrow(tidy_group(merge), "batch int, slot int, marks binary")
    sent = docs.groupBy("batch").cogroup(sketch.groupBy("batch")).applyInArrow(tidy_group(send), "slot int, batch int, rows binary, owners binary")
    verdicts = sent.groupBy("slot").applyInArrow(tidy_group(decide), "batch int, slot int, marks binary")
    news = sketch.withColumn("kind", F.lit(0)).unionByName(verdicts.withColumn("kind", F.lit(1)))
    return docs.groupBy("batch").cogroup(news.groupBy("batch")).applyInArrow(tidy_group(cut), "doc_id long, n_bytes long, removed array<array<long>>, kept binary")


def _schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])


def _splitters(docs: DataFrame, size: int, length: int, seed: int, ranges: int) -> np.ndarray:
    """Leading bytes that cut the suffixes into about equal ranges, from a bounded sample of documents."""
    spare = max(1, size // (SAMPLE_DOCS * 2000))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data, offsets = flat(pa.chunked_array([batch["text"]]))
                at, low = anchors(data, offsets, length, seed)
                # the smallest hashes of a slice are a fair sample of its anchors
                at = at[np.argsort(low)[: SAMPLE_EACH * batch.num_rows]]
                yield pa.RecordBatch.from_arrays([pa.array([data[a : a + seed].tobytes() for a in at], pa.binary())], names=["lead"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(spare)) == 0).select("text").limit(SAMPLE_DOCS)
    lead = np.sort(np.array([bytes(r[0]) for r in some.mapInArrow(tidy(step), "lead binary").distinct().collect()], f"S{seed}"))
    n = min(ranges, SPLITTERS)
    if not len(lead) or n < 2:
        return np.zeros(0, f"S{seed}")
    return np.unique(lead[(np.arange(1, n) * len(lead)) // n])


def digest(kept: bytes) -> str:
    """Lowercase hex SHA-256 of the bytes left."""
    return hashlib.sha256(kept).hexdigest()
