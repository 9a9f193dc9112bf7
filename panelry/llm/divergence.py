"""Source divergence audit over runs that are indexed in memory in a single pass.

1. A task reads documents once and counts, for each language and source, the occurrences of each term and the
   documents that hold it.  When memory fills, the block is written as a run sorted by term, cut into a segment
   for each hash shard of terms, and counting starts anew.
2. The segments of a shard and language are merged through a heap, term by term, which gives the frequencies
   of every source side by side; terms in fewer than ``least`` documents of the language end here.  No merge takes
   more than about ``FAN_IN`` segments: where there are more runs, they are merged in several passes.
3. With the totals known, every count becomes a probability in units of 1e-9, smoothed by two occurrences.
   A pair of sources starts from the divergence that it would have if no term occurred in either, and is
   corrected, bucket of terms by bucket, for the terms that do occur in one of them.

Terms are runs of letters A-Z, a-z and of characters above ``\\x7F``; only A-Z are lower-cased.  Null text, lang
and source count as ''.  A source without terms has a row as well; a language without kept terms has value 0
for all pairs.  Equal values rank by item, in order of UTF-8.  Rows that repeat a doc_id are documents of their
own.  An empty table gives no rows.  Other columns play no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, parts_of, settled, term_table, text_bytes, tidy, tidy_group

#: What becomes of the bytes of a text before it is split at spaces.
_TABLE = term_table(b"abcdefghijklmnopqrstuvwxyz")
#: Text that a block holds; text a shard; segments in one merge.
BLOCK_BYTES, SHARD_BYTES, FAN_IN = 24 << 20, 16 << 20, 4096
#: Terms that become one Arrow array of a block.
CHUNK = 200_000
#: Kept rows in a bucket of corrections, and numbers of its dense table.
BUCKET_ROWS, CELLS = 200_000, 1 << 22
LEAST, TERMS = 10, 10

_SEGMENT = "shard int, lang binary, part int, sources array<binary>, terms binary, who binary, n binary, docs binary"


def _packed(shard: int, lang: bytes, part: int, sources: list[bytes], terms: list[bytes], who: np.ndarray, n: np.ndarray, docs: np.ndarray) -> dict:
    """One segment: entries in order of term and source; ``who`` points into ``sources``."""
    return {"shard": shard, "lang": lang, "part": part, "sources": sources, "terms": b"\n".join(terms), "who": who.astype("<i4").tobytes(), "n": n.astype("<i8").tobytes(), "docs": docs.astype("<i8").tobytes()}


_ARROW = pa.schema([("shard", pa.int32()), ("lang", pa.binary()), ("part", pa.int32()), ("sources", pa.list_(pa.binary())), ("terms", pa.binary()), ("who", pa.binary()), ("n", pa.binary()), ("docs", pa.binary())])


class Block:
    """Terms of some documents in memory, one after another, and the source and size of each document."""

    def __init__(self) -> None:
        self.groups: dict[tuple[bytes, bytes], int] = {}
        self.group: list[int] = []
        self.sizes: list[int] = []
        self.terms: list[bytes] = []
        self.chunks: list[pa.Array] = []
        self.bytes = 0

    def add(self, lang: bytes, source: bytes, text: bytes) -> None:
        size = 0
        for part in parts_of(text.translate(_TABLE)):
            terms = part.split()
            size += len(terms)
            self.terms += terms
            if len(self.terms) > CHUNK:
                self.chunks.append(pa.array(self.terms, pa.binary()))
                self.terms = []
        self.group.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.sizes.append(size)
        self.bytes += len(text)

    def run(self, shards: int, parts: int, number: int) -> Iterator[dict]:
        """The block as term-sorted segments, one for each language and shard that it has terms of.

        The empty term, with no occurrences, stands for the source itself.
        """
        encoded = pa.chunked_array([*self.chunks, pa.array(self.terms, pa.binary())]).dictionary_encode().combine_chunks()
        if isinstance(encoded, pa.ChunkedArray):
            encoded = pa.concat_arrays(encoded.unify_dictionaries().chunks)
        shard = np.array([zlib.crc32(t) % shards for t in encoded.dictionary.to_pylist()], np.int64)
        order = pc.sort_indices(pa.table({"shard": shard, "term": encoded.dictionary}), sort_keys=[("shard", "ascending"), ("term", "ascending")])
        terms, shard = encoded.dictionary.take(order).to_pylist(), shard[order.to_numpy()]
        rank = np.empty(len(terms), np.int64)
        rank[order.to_numpy()] = np.arange(len(terms))
        # occurrences of each term in each document, then both summed over the documents of a source
        one, n = np.unique(np.repeat(np.arange(len(self.sizes)), self.sizes) * len(terms) + rank[encoded.indices.to_numpy()], return_counts=True)
        names, group = sorted(self.groups), np.array(self.group, np.int64)
        place = np.empty(len(names), np.int64)
        place[[self.groups[x] for x in names]] = np.arange(len(names))
        langs = [lang for lang, _ in names]
        at = (one % max(len(terms), 1)) * len(names) + place[group[one // max(len(terms), 1)]]
        found, back = np.unique(at, return_inverse=True)
        n, docs = np.bincount(back, n, len(found)).astype(np.int64), np.bincount(back, minlength=len(found))
        term, who = found // len(names) if names else found, found % max(len(names), 1)
        for lang in dict.fromkeys(langs):
            first, last = langs.index(lang), len(langs) - langs[::-1].index(lang)
            sources = [s for _, s in names[first:last]]
            zero = np.zeros(len(sources), np.int64)
            yield _packed(zlib.crc32(b"") % shards, lang, number % parts, sources, [b""] * len(sources), np.arange(len(sources)), zero, zero)
            own = np.flatnonzero((who >= first) & (who < last))
            cuts = np.flatnonzero(np.diff(shard[term[own]])) + 1
            for some in np.split(own, cuts) if len(own) else ():
                yield _packed(int(shard[term[some[0]]]), lang, number % parts, sources, [terms[k] for k in term[some].tolist()], who[some] - first, n[some], docs[some])


def runs(docs: DataFrame, shards: int, parts: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Term-sorted segments of all blocks of ``docs`` (text, lang, source)."""
    as_bytes = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c)

    def batches_of(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in rows:
            held.append(row)
            if len(held) == 256:
                yield pa.RecordBatch.from_pylist(held, _ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(), zlib.crc32(b"%d" % TaskContext.get().partitionId())
        for batch in batches:
            langs, sources = batch["lang"].to_pylist(), batch["source"].to_pylist()
            for lang, source, text in zip(langs, sources, batch["text"], strict=True):
                block.add(lang, source, text.as_py())
                if block.bytes > block_bytes:
                    yield from batches_of(block.run(shards, parts, number))
                    block, number = Block(), number + 1
        yield from batches_of(block.run(shards, parts, number))

    return docs.select(as_bytes("text"), as_bytes("lang"), as_bytes("source")).mapInArrow(tidy(step), _SEGMENT)


def _entries(row: dict) -> Iterator[tuple[bytes, bytes, int, int]]:
    who, n, docs = np.frombuffer(row["who"], "<i4"), np.frombuffer(row["n"], "<i8"), np.frombuffer(row["docs"], "<i8")
    return zip(row["terms"].split(b"\n"), map(row["sources"].__getitem__, who.tolist()), n.tolist(), docs.tolist(), strict=True)


def _summed(segments: pa.Table) -> Iterator[tuple[bytes, list[bytes], list[int], list[int]]]:
    """(term, sources, occurrences, documents) in order of term, from the heap of all segments."""
    term, sources, n, docs = None, [], [], []
    for t, source, count, held in heapq.merge(*map(_entries, segments.to_pylist())):
        if t != term:
            if term is not None:
                yield term, sources, n, docs
            term, sources, n, docs = t, [source], [count], [held]
        elif source != sources[-1]:
            sources.append(source)
            n.append(count)
            docs.append(held)
        else:
            n[-1] += count
            docs[-1] += held
    if term is not None:
        yield term, sources, n, docs


def frequencies(docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """(lang, term, source, n, everywhere, first): kept terms by source, and by language.

    The rows of a term come with ``everywhere``, its occurrences in the language, and ``first`` is true in one of
    them.  The empty term stands for the source itself, n = 0.
    """
    spark, size = docs.sparkSession, text_bytes(docs)
    shards = buckets(spark, size, SHARD_BYTES)
    parts = -(-(size // block_bytes + 1) // fan_in)
    segments = runs(docs, shards, parts, block_bytes)

    def shorter(table: pa.Table) -> pa.Table:
        """The segments of a part as one."""
        first, names, columns = table.slice(0, 1).to_pylist()[0], {}, ([], [], [], [])
        for term, sources, n, held in _summed(table):
            columns[0].extend([term] * len(n))
            columns[1].extend(names.setdefault(s, len(names)) for s in sources)
            columns[2].extend(n)
            columns[3].extend(held)
        row = _packed(first["shard"], first["lang"], first["part"] // fan_in, list(names), columns[0], *(np.array(c, np.int64) for c in columns[1:]))
        return pa.Table.from_pylist([row], _ARROW)

    while parts > 1:
        segments = segments.groupBy("shard", "lang", "part").applyInArrow(tidy_group(shorter), _SEGMENT)
        parts = -(-parts // fan_in)

    def kept(table: pa.Table) -> pa.Table:
        terms, names, counts, total, first = [], [], [], [], []
        for term, sources, n, held in _summed(table):
            if not term or sum(held) >= least:
                terms.extend([term] * len(n))
                names.extend(sources)
                counts.extend(n)
                total.extend([sum(n)] * len(n))
                first.extend([True] + [False] * (len(n) - 1))
        lang = pa.array([table["lang"][0].as_py()] * len(terms), pa.binary())
        return pa.table({"lang": lang, "term": pa.array(terms, pa.binary()), "source": pa.array(names, pa.binary()), "n": pa.array(counts, pa.int64()), "everywhere": pa.array(total, pa.int64()), "first": pa.array(first, pa.bool_())})

    out = segments.groupBy("shard", "lang").applyInArrow(tidy_group(kept), "lang binary, term binary, source binary, n long, everywhere long, first boolean")
    return out.withColumns({c: F.col(c).cast("string") for c in ("lang", "term", "source")})


def _share(count: str, total: str, size: str) -> Column:
    """1 + floor(1e9 * (count + 2) / (total + 2 * size)), in whole numbers of any length."""
    return F.expr(f"1 + (cast(1000000000 as decimal(20, 0)) * (cast({count} as decimal(18, 0)) + 2)) div (cast({total} as decimal(20, 0)) + 2 * {size})")


def _distance(p: Column | np.ndarray, q: Column | np.ndarray) -> Column | np.ndarray:
    if isinstance(p, np.ndarray):
        return (p - q) ** 2 // (p + q)
    return F.call_function("div", (p - q) * (p - q), p + q)


def _corrections(rows: pa.Table, sources: pa.Table) -> pa.Table:
    """Twice the corrections of the pairs (a, b) for a bucket's terms that occur in a.

    A term that occurs in both is met from either side and counts once each time.
    """
    names = sources["source"].to_pylist()
    unseen = sources["unseen"].to_numpy()
    place = {s: k for k, s in enumerate(names)}
    term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy() if len(rows) else np.zeros(0, np.int64)
    who = np.array([place[s] for s in rows["source"].to_pylist()], np.int64)
    p = rows["p"].to_numpy()
    order = np.argsort(term, kind="stable")
    term, who, p = term[order], who[order], p[order]
    found: dict[int, np.ndarray] = {}
    step = max(1, CELLS // max(1, len(names)))
    for a in range(0, int(term[-1]) + 1 if len(term) else 0, step):
        at = slice(*np.searchsorted(term, [a, a + step]))
        table = np.tile(unseen, (min(step, int(term[-1]) + 1 - a), 1))
        occurs = np.zeros(table.shape, bool)
        table[term[at] - a, who[at]] = p[at]
        occurs[term[at] - a, who[at]] = True
        for k in np.unique(who[at]).tolist():
            some = table[occurs[:, k]]
            change = _distance(some[:, k : k + 1], some) - _distance(unseen[k : k + 1], unseen)
            change = (change * np.where(occurs[occurs[:, k]], 1, 2)).sum(0)
            found[k] = found[k] + change if k in found else change
    keys = list(found)
    return pa.table({
        "lang": pa.array([sources["lang"][0].as_py() if len(sources) else None] * (len(keys) * len(names)), pa.string()), "source": pa.array([names[k] for k in keys for _ in names], pa.string()),
        "item": pa.array(names * len(keys), pa.string()), "change": pa.array(np.concatenate([found[k] for k in keys]) if keys else np.zeros(0, np.int64), pa.int64()),
    })


def audit(docs: DataFrame, least: int = LEAST, terms: int = TERMS, block_bytes: int = BLOCK_BYTES, fan_in: int = FAN_IN, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source lies from the others of its language, and its ``terms`` most telling terms."""
    found = settled(frequencies(docs, least, block_bytes, fan_in), "frequencies")
    groups = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = found.groupBy("lang").agg(F.sum("n").alias("all_total"), F.sum((F.col("first") & (F.col("term") != "")).cast("long")).alias("size"))
    groups = settled(groups.join(langs, "lang"), "sources")

    kept = found.where("term <> ''")
    counted = kept.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total", "size"), "q": _share("everywhere", "all_total", "size")})
    value = _distance(F.col("p"), F.col("q"))
    most = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = counted.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    top = top.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= terms)

    n = -(-kept.count() // bucket_rows) or 1
    seen = groups.where("size > 0").select("lang", "source", "total", "size", _share("0", "total", "size").alias("unseen"))
    # every bucket of a language needs the numbers of its sources, not their terms
    spread = seen.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = counted.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int").alias("bucket"))
    change = dealt.groupBy("lang", "bucket").cogroup(spread.select("lang", "bucket", "source", "unseen").groupBy("lang", "bucket")).applyInArrow(tidy_group(_corrections), "lang string, source string, item string, change long")
    change = change.unionByName(change.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "change")).groupBy("lang", "source", "item").agg(F.sum("change").alias("change"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    pairs = groups.join(other, "lang").where("source <> item")  # as many rows as the part has
    start = _distance(F.col("a"), F.col("b")) * F.col("size")
    shares = pairs.where("size > 0").withColumns({"a": _share("0", "total", "size"), "b": _share("0", "item_total", "size")})
    valued = shares.join(change, ["lang", "source", "item"], "left").select("lang", "source", "item", (start + F.coalesce(F.expr("change div 2"), F.lit(0))).alias("value"))
    valued = valued.unionByName(pairs.where("size = 0").select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    pairs = valued.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(most))
    return pairs.unionByName(top)
