"""Exact dedup of texts by skew-safe combining of digest groups.

Two texts are equal when they are identical without the characters ``\\x20`` and ``\\x09-\\x0D``.  The digest
of what is left (SHA-256) only deals rows; every stage compares the whole content:

1. each task deduplicates what it reads, in blocks of bounded memory: one winner a text and block;
2. winners meet by digest and salt, so that a group of which every task holds a copy is dealt over
   ``SALTS`` tasks, and are merged by content;
3. the salts' winners, at most ``SALTS`` a text, are merged by digest and content.

The winner is the row with the most code points in its original text, then the smallest doc_id.  Every
document then looks up its group by digest.  Groups of more than one in ``SHARE`` of all rows, of which there
are fewer than ``SHARE``, are broadcast; the others are joined, so that no join key holds more rows than
that.  Where one digest has several contents, its documents are joined by content as well.

A null text counts as empty; empty texts equal each other and texts of white space.  A null doc_id comes
after all others.  Rows that repeat a doc_id count like any others; ``kept`` is true for all rows that repeat
the winner's doc_id and length.  An empty table gives no rows.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, tidy

SPACE = b" \t\n\v\f\r"
#: Groups in which winners of one digest meet before they are combined.
SALTS = 64
#: Text, and texts, that a task remembers at a time.
BLOCK_BYTES, BLOCK_TEXTS = 32 << 20, 200_000
#: A group of more than one in ``SHARE`` rows is broadcast.
SHARE = 10_000


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.cast("binary").alias("text"))


def _better(n: int, i: int | None, than: list) -> bool:
    """Whether the row comes before the winner so far, ``than`` (length, doc_id, rows)."""
    if n != than[0]:
        return n > than[0]
    return i is not None and (than[1] is None or i < than[1])


def local_winners(docs: DataFrame, digest_bytes: int = 32, salts: int = SALTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, salt, content, n_chars, doc_id, size): the texts of each task's blocks, once a block."""

    def flushed(held: dict[bytes, list], salt: int) -> Iterator[pa.RecordBatch]:
        texts, rows = list(held), list(held.values())
        columns = {
            "key": pa.array([hashlib.sha256(t).digest()[:digest_bytes] for t in texts], pa.binary()), "salt": pa.array([salt] * len(texts), pa.int32()), "content": pa.array(texts, pa.binary()),
            "n_chars": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "size": pa.array([r[2] for r in rows], pa.int64()),
        }
        yield pa.RecordBatch.from_pydict(columns)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts
        held: dict[bytes, list] = {}
        total = 0
        for batch in batches:
            for i, n, text in zip(batch["doc_id"].to_pylist(), batch["n_chars"].to_pylist(), batch["text"], strict=True):
                content = text.as_py().translate(None, SPACE)
                known = held.get(content)
                if known is None:
                    held[content] = [n, i, 1]
                    total += len(content)
                    if total > block_bytes or len(held) > BLOCK_TEXTS:
                        yield from flushed(held, salt)
                        held, total = {}, 0
                else:
                    known[2] += 1
                    if _better(n, i, known):
                        known[:2] = n, i
        if held:
            yield from flushed(held, salt)

    return _rows(docs).mapInArrow(tidy(step), "key binary, salt int, content binary, n_chars long, doc_id long, size long")


def merged(winners: DataFrame, *by: str) -> DataFrame:
    """Winners merged by ``by`` and content: texts of one digest are compared whole."""
    order = F.struct(F.col("n_chars"), F.bitwise_not("doc_id").alias("back"))  # ~doc_id falls as doc_id rises; null comes last
    best = winners.repartition(*by).groupBy(*by, "content").agg(F.max(order).alias("best"), F.sum("size").alias("size"))
    return best.select(*by, "content", "best.n_chars", F.bitwise_not("best.back").alias("doc_id"), "size")


def digests(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, n_chars, key, sha): every document with the digest of its normalised text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256(t.as_py().translate(None, SPACE)).digest() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_chars"], pa.array([x[:digest_bytes] for x in sha], pa.binary()), pa.array(sha, pa.binary())], names=["doc_id", "n_chars", "key", "sha"])

    return _rows(docs).mapInArrow(tidy(step), "doc_id long, n_chars long, key binary, sha binary")


def _content() -> Column:
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary")


def exact_groups(docs: DataFrame, digest_bytes: int = 32, salts: int = SALTS, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha): one row for each of ``docs``, sha the digest of its normalised text.

    ``digest_bytes`` shortens the digest by which rows are dealt and looked up; results stay the same.
    """
    salted = merged(local_winners(docs, digest_bytes, salts, block_bytes), "key", "salt")
    found = merged(salted, "key").withColumn("contents", F.count(F.lit(1)).over(Window.partitionBy("key")))
    # the content is needed again only where a digest has several
    found = found.withColumn("content", F.when(F.col("contents") > 1, F.col("content")))
    groups = settled(found.select("key", "content", "contents", F.col("n_chars").alias("keep_chars"), F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size")), "exact-groups")
    n = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]
    rows = settled(digests(docs, digest_bytes), "exact-digests")
    large = F.col("group_size") * share > n
    alone = groups.where("contents = 1").drop("content", "contents")
    hot = F.broadcast(alone.where(large))  # fewer than ``share`` groups are that large
    out = rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(alone.where(~large), "key"))
    several = groups.where("contents > 1")
    if several.limit(1).count():
        shared = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), _content().alias("content"))
        shared = shared.withColumn("sha", F.unhex(F.sha2("content", 256))).withColumn("key", F.substring("sha", 1, digest_bytes))
        out = out.unionByName(shared.join(several.drop("contents"), ["key", "content"]).drop("content"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "sha")
