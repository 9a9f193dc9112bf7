"""Benchmark decontamination: MinHash containment search by size, then exact containment.

A test item is in a document if at least ``least`` of its distinct runs of five lower-cased words
occur there (an item of fewer words counts as one run of its own length).

A short item inside a long document has a tiny Jaccard similarity to it, so documents are searched in
windows whose size fits the items: items fall into size classes, each a factor of two wide, and each
class slides a window of about its size over the document.  Inside such a window a contained item has
a similarity of at least a quarter, and with 64 one-row bands it is missed with probability below
1e-7.  A signature can only agree in a band if the window holds that item's minimal shingle, so
windows without any item's minimal shingle are never hashed.  Candidates are decided exactly, on all
shingles of the document.

Test items are taken block by block (``BLOCK_BYTES`` of text).  Each block is one pass over the texts
without a shuffle and, where there are several blocks, a job of its own, whose finds are written before
the next block is loaded; so the memory for items is bounded whatever their number.  Shingles are told
apart by 64-bit hashes.

Null or empty texts hold nothing; null and empty items are in nothing; items that repeat count once
under each item_id.  All columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, settled, slices
from .kernels import Words, flat, mix, windows
from .neardup import SHINGLE, mix_light, permutations

LEAST = 0.75
BANDS = 64
BLOCK_BYTES = 8 << 20


def _runs(texts: pa.ChunkedArray, sizes: list[int]) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of a slice and, for each run length, (first word, hash) of every run."""
    words = Words(*flat(texts))
    h = words.hashes(0, lower=True)
    out = []
    for size in sizes:
        at, value = windows(h, words.first, size)
        out.append((at, value if size == SHINGLE else mix(value + np.uint64(size))))
    return words, out


class Items:
    """One block of test items, ready to be searched for."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, _ = _runs(pa.chunked_array([pa.array(texts, pa.string())]), [])
        count = np.diff(words.first)
        self.sizes = sorted({min(int(n), SHINGLE) for n in count if n})
        words, found = _runs(pa.chunked_array([pa.array(texts, pa.string())]), self.sizes)
        doc = words.doc()
        self.ids, self.sets, spans = [], [], []
        for size, (at, value) in zip(self.sizes, found, strict=True):
            owner = doc[at]
            keep = (count[owner] == size) | (size == SHINGLE)
            owner, value = owner[keep], value[keep]
            edge = np.flatnonzero(np.diff(owner, prepend=-1))  # runs of an item follow one another
            for i, own in zip(owner[edge], np.split(value, edge[1:]) if len(edge) else (), strict=True):
                self.ids.append(ids[i]), self.sets.append(np.unique(own)), spans.append((size, len(own)))
        sig = np.zeros((len(self.sets), BANDS), np.uint64)
        low = np.zeros((len(self.sets), BANDS), np.uint64)
        length = np.array([len(x) for x in self.sets], np.int64)
        member, start = np.concatenate([np.zeros(0, np.uint64), *self.sets]), np.cumsum(length) - length
        for k, a in enumerate(permutations(BANDS) if len(length) else ()):
            x = mix_light(member, a)
            sig[:, k] = np.minimum.reduceat(x, start)
            low[:, k] = member[x == np.repeat(sig[:, k], length)]  # no two shingles share a value: the hash is a bijection
        # (run length, size class) -> items, their minimal shingles, and their signature values by band
        self.classes = []
        kind = [(size, span.bit_length() - 1) for size, span in spans]
        for size, c in sorted(set(kind)):
            mine = np.array([i for i, x in enumerate(kind) if x == (size, c)])
            bands = []
            for k in range(BANDS):
                order = np.argsort(sig[mine, k], kind="stable")
                bands.append((sig[mine, k][order], mine[order]))
            self.classes.append((size, c, np.unique(low[mine]), bands))

    def search(self, texts: pa.ChunkedArray, least: float) -> list[list[int]]:
        """For each document of a slice, the ids of the items that are in it."""
        out: list[list[int]] = [[] for _ in range(len(texts))]
        if not self.sets:
            return out
        words, found = _runs(texts, self.sizes)
        by_size = dict(zip(self.sizes, found, strict=True))
        doc = words.doc()
        pairs = []
        for size, c, low, bands in self.classes:
            at, value = by_size[size]
            hit = np.flatnonzero(np.isin(value, low))
            if not len(hit):
                continue
            # windows start at multiples of ``step`` runs and are long enough to hold a whole item of the class
            step, width = max(1, 1 << c >> 1), (2 << c) + max(1, 1 << c >> 1)
            first = np.searchsorted(at, words.first)  # runs of a document are consecutive
            begin = first[doc[at[hit]]]
            inside = hit - begin
            grid = inside[:, None] // step - np.arange((width - 1) // step + 1)[None, :]
            ok = (grid >= 0) & (grid * step + width > inside[:, None])
            start = np.unique((begin[:, None] + grid * step)[ok])
            stop = np.minimum(start + width, first[doc[at[start]] + 1])
            length = stop - start
            take = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            member, edge = value[take], np.concatenate([[0], np.cumsum(length)[:-1]])
            for k, a in enumerate(permutations(BANDS)):
                lowest = np.minimum.reduceat(mix_light(member, a), edge)
                values, items = bands[k]
                x, y = np.searchsorted(values, lowest), np.searchsorted(values, lowest, side="right")
                for w in np.flatnonzero(y > x):
                    d = int(doc[at[start[w]]])
                    pairs.extend((d, int(i)) for i in items[x[w] : y[w]])
        run_doc = {size: doc[at] for size, (at, _) in by_size.items()}
        for d, i in sorted(set(pairs)):
            size = SHINGLE if len(self.sets[i]) > 1 else None
            for s, (at, value) in by_size.items():
                if size in (None, s):
                    a, b = np.searchsorted(run_doc[s], [d, d + 1])
                    if np.isin(self.sets[i], value[a:b]).sum() >= least * len(self.sets[i]):
                        out[d].append(self.ids[i])
                        break
        return [sorted(set(x)) for x in out]


def _searched(docs: DataFrame, items: Items, least: float, column: str) -> DataFrame:
    """``docs`` with the sorted ids of one block's items in ``column``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at = part.schema.get_field_index(column)
                part = part.remove_column(at) if at >= 0 else part
                yield from part.append_column(column, pa.array(items.search(part["text"], least), pa.list_(pa.int64()))).combine_chunks().to_batches()

    schema = T.StructType([f for f in docs.schema.fields if f.name != column] + [T.StructField(column, T.ArrayType(T.LongType()))])
    return arrow_map(docs, step, schema)


def found_items(docs: DataFrame, items: DataFrame, column: str = "item_ids", least: float = LEAST, block: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column of the sorted ids of the test items that each text contains.

    An existing column of that name is replaced.  Items with a null id or text are not searched for.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block)

    def loaded(b: int) -> Items:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        return Items([r[0] for r in rows], [r[1] for r in rows])

    if blocks <= 1:
        return _searched(docs, loaded(0) if blocks else Items([], []), least, column)
    # what a text contains depends on the text alone, so the few texts with items are joined by it
    key = [F.xxhash64("text").alias("_a"), F.xxhash64(F.lit(1), "text").alias("_b")]
    texts = docs.select(F.col("text").cast("string").alias("text"))
    hits = None
    for b in range(blocks):
        own = settled(_searched(texts, loaded(b), least, "found").where(F.size("found") > 0).select(*key, "found").distinct(), "items")
        hits = own if hits is None else hits.unionByName(own)
    hits = hits.select("_a", "_b", F.explode("found").alias("item")).groupBy("_a", "_b").agg(F.array_sort(F.collect_set("item")).alias("found"))  # an array of test items at most
    rest = [c for c in docs.columns if c != column]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), *key)
    return rows.join(hits, ["_a", "_b"], "left").select("row.*", F.coalesce("found", F.array().cast("array<long>")).alias(column))
