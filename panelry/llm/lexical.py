"""Ranked lexical search: MaxScore over shards, with bounds of term pairs.

*Index.*  Documents are cut into shards of bounded text, each an inverted index of its own: terms in order, and
for each term its documents with their counts.  A first pass writes the shards; their sizes and a dictionary of
document frequencies give the numbers of the collection.  A second pass turns counts into impacts and adds, for
the ``PAIRED`` most frequent terms of the collection, pair lists: for two terms, the blocks of ``SPAN`` documents
in which they meet, with the largest joint contribution of both to one document there.

*Query.*  A shard's terms are taken by falling largest contribution.  What the terms not yet taken can add
is bounded by its own maxima, less what pairs save: two terms with a pair list add no more than the largest of what both give
together and what each gives alone.  Once the bound lies under the
k-th best score so far, no document that has only those terms can be among the k best, and the rest is looked
up for the documents already met, whose own bound comes from their block's maxima and pairs.  A document
is left out only if its bound is below the k-th best score, so ties stay possible and the answer is exact.  The best
scores of a task carry over from shard to shard, and each task reports k documents an item at most.

Terms are runs of ASCII letters and digits and of characters above ``\\x7F``; only A-Z are lower-cased.  A document's
score sums ``weight * ((10**9 * tf) div (1000 * tf + 20 * m))`` over the item's distinct terms, where the weight is
floor(1000 ln((2N + 2) / (2df + 1))) and m = 50 + (50 n N) div L; N counts documents with terms, L all
their terms, n the document's own.

A null text has no terms.  Rows that repeat an item_id are one item with the terms of all of them; rows that repeat a doc_id are
documents of their own.  A null doc_id comes after all others (2**63 - 1 stands for it).  Items without terms, or that
no document scores above 0, have no rows, nor have empty tables.  Other columns play no part.
"""

from __future__ import annotations

import itertools
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_of, settled, term_table, tidy

#: What becomes of the bytes of a text before it is split at spaces.
_TABLE = term_table(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: Text of a shard, rows in a file of the index, documents in a block, terms with pair lists, bytes of the terms of items in one job.
SHARD_BYTES, FILE_ROWS, SPAN, PAIRED, ITEM_BYTES = 8 << 20, 4, 128, 48, 4 << 20
_LAST = (1 << 63) - 1

_SHARD = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("terms", pa.binary()), ("start", pa.binary()), ("doc", pa.binary()), ("number", pa.binary()), ("pairs", pa.binary())])
_SHARD_SQL = "n_docs long, n_terms long, ids binary, sizes binary, terms binary, start binary, doc binary, number binary, pairs binary"


class Gathered:
    """Documents of a shard while it is built."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.bytes = array("q"), array("q"), 0
        self.vocabulary: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.term, self.doc, self.tf = array("i"), array("i"), array("i")

    def add(self, doc_id: int | None, text: bytes) -> None:
        count: Counter = Counter()
        for part in parts_of(text.translate(_TABLE)):
            count.update(part.split())
        self.bytes += len(text) + 64
        if not count:
            return
        self.term.extend(map(self.vocabulary.__getitem__, count))
        self.tf.extend(count.values())
        self.doc.extend([len(self.ids)] * len(count))
        self.ids.append(_LAST if doc_id is None else doc_id)
        self.sizes.append(sum(count.values()))

    def row(self) -> dict:
        """The shard: documents of each term in a row, terms in order."""
        terms = sorted(self.vocabulary)
        rank = np.empty(len(terms), np.int64)
        rank[np.array([self.vocabulary[t] for t in terms], np.int64)] = np.arange(len(terms))
        term = rank[np.frombuffer(self.term, np.int32)] if terms else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
        return {
            "n_docs": len(self.ids), "n_terms": sum(self.sizes), "ids": self.ids.tobytes(), "sizes": self.sizes.tobytes(), "terms": b"\n".join(terms), "start": start.astype("<i8").tobytes(),
            "doc": np.frombuffer(self.doc, np.int32)[order].tobytes() if terms else b"", "number": np.frombuffer(self.tf, np.int32)[order].tobytes() if terms else b"", "pairs": b"",
        }


def counted_shards(docs: DataFrame, size: int = SHARD_BYTES) -> DataFrame:
    """The shards of ``docs`` with counts in place of impacts; one row each."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                held.add(i, text.as_py())
                if held.bytes > size:
                    yield pa.RecordBatch.from_pylist([held.row()], _SHARD)
                    held = Gathered()
        if held.bytes:
            yield pa.RecordBatch.from_pylist([held.row()], _SHARD)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(tidy(step), _SHARD_SQL)


def dictionary(shards: DataFrame) -> DataFrame:
    """(term, df) of all terms."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, start in zip(batch["terms"], batch["start"], strict=True):
                df = np.diff(np.frombuffer(start.as_py(), "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(terms.as_py().split(b"\n") if len(df) else [], pa.binary()), pa.array(df, pa.int64())], names=["term", "df"])

    return shards.select("terms", "start").mapInArrow(tidy(step), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _weighted(terms: DataFrame, n: int) -> DataFrame:
    return terms.withColumn("weight", F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n) + 2) / (2.0 * F.col("df") + 1))).cast("long"))


def _lengths(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of these sizes, in whole numbers of any length."""
    if len(sizes) and 50 * int(sizes.max()) * n >= 1 << 63:
        return np.array([50 + 50 * int(x) * n // total for x in sizes], np.int64)
    return 50 + 50 * sizes * n // max(total, 1)


class Shard:
    """One shard, read back: postings with impacts by term, and pair lists; ``weights`` of the terms that will be asked for.

    ``met`` and ``held`` count the postings that queries added or looked up, and those of all their terms.
    """

    def __init__(self, row: dict, weights: dict[bytes, int]):
        self.ids, self.weights = np.frombuffer(row["ids"], "<i8"), weights
        self.start, self.doc, self.impact = np.frombuffer(row["start"], "<i8"), np.frombuffer(row["doc"], "<i4"), np.frombuffer(row["number"], "<i4")
        names = bytes(row["terms"]).split(b"\n") if len(self.start) > 1 else []
        self.place = {t: k for k, t in enumerate(names) if t in weights}
        self.blocks = -(-len(self.ids) // SPAN)
        self.pairs = dict(_read_pairs(bytes(row["pairs"])))
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray, int]] = {}
        self.known_blocks: dict[bytes, np.ndarray] = {}
        self.known_joint: dict[tuple[bytes, bytes], tuple[np.ndarray, int]] = {}
        self.met = self.held = 0

    def gains(self, term: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, contributions, the largest contribution) of a term that the shard has."""
        found = self.known.get(term)
        if found is None:
            at = slice(self.start[self.place[term]], self.start[self.place[term] + 1])
            gain = self.weights[term] * self.impact[at].astype(np.int64)
            found = self.known[term] = self.doc[at], gain, int(gain.max())
        return found

    def block_gains(self, term: bytes) -> np.ndarray:
        """The largest contribution of a term in each block."""
        found = self.known_blocks.get(term)
        if found is None:
            doc, gain, _ = self.gains(term)
            found = self.known_blocks[term] = np.zeros(self.blocks, np.int64)
            np.maximum.at(found, doc // SPAN, gain)
        return found

    def bounds(self, terms: list[bytes]) -> tuple[list[int], list[np.ndarray]]:
        """What the first j of ``terms`` can add to one document, for j = 0, 1, ...: anywhere, and by block.

        Each term joins the free one before it with which it saves most over the sum of both maxima.
        """
        most, by_block = [0], [np.zeros(self.blocks, np.int64)]
        free: set[bytes] = set()
        for term in terms:
            own, block = self.gains(term)[2], self.block_gains(term)
            saved, other = 0, None
            for t in free:
                both = self.joint(term, t)
                if both is not None and own + self.gains(t)[2] - both[1] > saved:
                    saved, other = own + self.gains(t)[2] - both[1], t
            bound_block = by_block[-1] + block
            if other is None:
                free.add(term)
            else:
                free.remove(other)
                bound_block = np.minimum(bound_block, by_block[-1] - self.block_gains(other) + self.joint(term, other)[0])
            most.append(most[-1] + own - saved)
            by_block.append(bound_block)
        return most, by_block

    def joint(self, a: bytes, b: bytes) -> tuple[np.ndarray, int] | None:
        """What two terms with a pair list add to one document, by block and anywhere: where they meet, both together, and else one of them."""
        key = (min(a, b), max(a, b))
        found = self.known_joint.get(key)
        if found is None and key in self.pairs:
            blocks, gain = self.pairs[key]
            both = np.maximum(self.block_gains(a), self.block_gains(b))
            both[blocks] = np.maximum(both[blocks], gain)
            found = self.known_joint[key] = both, int(both.max())
        return found

    def best(self, query: list[bytes], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the shard's documents that may be among the k best, if k others have ``least`` or more."""
        terms = sorted((t for t in query if t in self.place), key=lambda t: (self.gains(t)[2], t))
        self.held += sum(len(self.gains(t)[0]) for t in terms)
        most, by_block = self.bounds(terms)
        score = np.zeros(len(self.ids), np.int64)
        j = len(terms)
        while j and most[j] >= max(least, 1):
            j -= 1
            doc, gain, _ = self.gains(terms[j])
            score[doc] += gain
            self.met += len(doc)
            if len(score) >= k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))  # sums so far are lower bounds
        # a document that has only terms not yet taken stays below ``least``
        possible = np.flatnonzero(score)
        possible = possible[score[possible] + by_block[j][possible // SPAN] >= least]
        while j and len(possible):
            j -= 1
            doc, gain, _ = self.gains(terms[j])
            at = np.minimum(np.searchsorted(doc, possible), len(doc) - 1)
            hit = doc[at] == possible
            score[possible[hit]] += gain[at[hit]]
            self.met += len(possible)
            possible = possible[score[possible] + np.minimum(by_block[j][possible // SPAN], most[j]) >= least]
        return possible, score[possible]


def _read_pairs(data: bytes) -> Iterator[tuple[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]]]:
    at = 0
    while at < len(data):
        a, b, n = (int(x) for x in np.frombuffer(data, "<i4", 3, at))
        at += 12
        pair = data[at : at + a], data[at + a : at + a + b]
        at += a + b
        yield pair, (np.frombuffer(data, "<i4", n, at), np.frombuffer(data, "<i8", n, at + 4 * n))
        at += 12 * n


def pair_lists(place: dict[bytes, int], start: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, weights: dict[bytes, int]) -> bytes:
    """For each two terms of ``weights``: blocks in which they meet in a document, and their largest joint contribution there."""
    names = sorted(t for t in weights if t in place)
    blocks = -(-n_docs // SPAN)
    gain, held = np.zeros((len(names), blocks * SPAN), np.int64), np.zeros((len(names), blocks * SPAN), bool)
    for k, t in enumerate(names):
        at = slice(start[place[t]], start[place[t] + 1])
        gain[k, doc[at]], held[k, doc[at]] = weights[t] * impact[at].astype(np.int64), True
    out = []
    for k, t in enumerate(names[:-1]):
        joint = np.where(held[k + 1 :] & held[k], gain[k + 1 :] + gain[k] + 1, 0).reshape(len(names) - k - 1, blocks, SPAN).max(2)
        for other, row in zip(names[k + 1 :], joint, strict=True):
            at = np.flatnonzero(row)  # none, where the two never meet: that is what saves most
            out += [np.array([len(t), len(other), len(at)], "<i4").tobytes(), t, other, at.astype("<i4").tobytes(), (row[at] - 1).astype("<i8").tobytes()]
    return b"".join(out)


def with_impacts(shards: DataFrame, n: int, total: int, weights: dict[bytes, int]) -> DataFrame:
    """The shards with impacts in place of counts, and with pair lists of the terms of ``weights``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, doc, tf = np.frombuffer(row["start"], "<i8"), np.frombuffer(row["doc"], "<i4"), np.frombuffer(row["number"], "<i4").astype(np.int64)
                m = _lengths(np.frombuffer(row["sizes"], "<i8"), n, total)
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
                place = {t: k for k, t in enumerate(row["terms"].split(b"\n") if len(start) > 1 else []) if t in weights}
                row |= {"number": impact.astype("<i4").tobytes(), "pairs": pair_lists(place, start, doc, impact, row["n_docs"], weights)}
                yield pa.RecordBatch.from_pylist([row], _SHARD)

    return shards.mapInArrow(tidy(step), _SHARD_SQL)


class Index:
    """The index of all documents: shards with impacts, the dictionary, and the numbers of the collection."""

    def __init__(self, docs: DataFrame, shard_bytes: int = SHARD_BYTES, paired: int = PAIRED):
        counted = settled(counted_shards(docs, shard_bytes), "shards", FILE_ROWS)
        self.n, self.total = (x or 0 for x in counted.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        self.dictionary = settled(_weighted(dictionary(counted), self.n), "dictionary")
        frequent = self.dictionary.orderBy(F.desc("df"), "term").limit(paired).collect()
        self.shards = settled(with_impacts(counted, self.n, self.total, {bytes(r["term"]): r["weight"] for r in frequent}), "index", FILE_ROWS)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t) for i, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for t in set(text.translate(_TABLE).split())]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], names=["item_id", "term"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return items.select(F.col("item_id").cast("long").alias("item_id"), text).mapInArrow(tidy(step), "item_id long, term binary").distinct()


def ranked(index: Index, items: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item (item_id, text) that score above 0.

    Items travel to the shards in blocks of ``ITEM_BYTES``, one job each.
    """
    spark = items.sparkSession
    asked = settled(item_terms(items).join(index.dictionary, "term"), "items")
    size = asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).collect()
        out = out.unionByName(_searched(index.shards, [(r["item_id"], [(bytes(t), w) for t, w in r["terms"]]) for r in rows], k))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(shards: DataFrame, queries: list[tuple[int | None, list[tuple[bytes, int]]]], k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best documents of each task for each query."""
    weights = {t: w for _, terms in queries for t, w in terms}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(queries)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({c: batch[c][i].as_buffer() for c in ("ids", "terms", "start", "doc", "number", "pairs")}, weights)
                for q, (_, terms) in enumerate(queries):
                    ids, score = best[q]
                    doc, found = shard.best([t for t, _ in terms], k, int(score[k - 1]) if len(score) >= k else 0)
                    if len(doc):
                        ids, score = np.concatenate([ids, shard.ids[doc]]), np.concatenate([score, found])
                        first = np.lexsort((ids, -score))[:k]
                        best[q] = ids[first], score[first]
        for (item, _), (ids, score) in zip(queries, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return shards.select("ids", "terms", "start", "doc", "number", "pairs").mapInArrow(tidy(step), "item_id long, doc_id long, score long")
