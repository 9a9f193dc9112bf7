"""Shared pieces of the text operators: shared storage, batches of documents, components."""

from __future__ import annotations

import ctypes
import gc
import math
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that one task step works on at a time; bounds the temporaries of the numpy kernels.
SLICE_BYTES = 1 << 20
#: Text of one re-readable batch of documents.
BATCH_BYTES = 6 << 20
#: Text that a classifier is fitted on, at most.
SAMPLE_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (tests on one machine) gets a new temporary folder; on a
    cluster no folder of this machine would do, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            found = context.getCheckpointDir()
    return found.rstrip("/")


def settled(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither repeat nor lose it.

    ``file_rows`` bounds the rows of a file, and so of what a reader decodes at a time, where rows are large.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession, size: float, each: float) -> int:
    """How many groups hold ``size`` bytes at ``each`` bytes a group; never fewer than one a shuffle task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (one number)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text, and the named columns.  Rows without a doc_id are kept."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def slices(table: pa.Table | pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Consecutive row ranges of ``table`` with about ``size`` bytes of ``column`` (at least one row each)."""
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    if not table.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(table[column]), 0).to_numpy()
    group = np.cumsum(lengths) // size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [table.num_rows]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield table.slice(a, b - a)


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        found = ctypes.CDLL(None)
        found.malloc_trim  # noqa: B018 (absent outside glibc)
    except (OSError, AttributeError):
        return None
    return found


def release() -> None:
    """Give freed memory back to the system: Python workers stay alive between tasks, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def tidy(step: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A step of ``mapInArrow`` that releases its memory when a task ends."""

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            release()

    return run


def tidy_group(decide: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A step of ``applyInArrow`` over batches or ranges of some megabytes that releases its memory after each."""
    if decide.__code__.co_argcount == 1:
        return lambda table: _released(decide, table)
    return lambda left, right: _released(decide, left, right)


def _released(decide: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    try:
        return decide(*tables)
    finally:
        release()


def arrow_map(docs: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``docs.mapInArrow(step, schema)``, which by itself takes no column with a dot in its name."""
    safe = lambda name: name.replace(".", "\u2024") if "." in name else name
    inner = T.StructType([T.StructField(safe(f.name), f.dataType) for f in schema.fields])
    return docs.toDF(*map(safe, docs.columns)).mapInArrow(tidy(step), inner).toDF(*schema.names)


def term_table(keep: bytes) -> bytes:
    """A table for ``bytes.translate``: the bytes ``keep`` and all above 0x7F stay, A-Z are lower-cased, others become spaces."""
    return bytes(c if c in keep or c > 0x7F else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def parts_of(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut at spaces."""
    at = 0
    while len(text) - at > size:
        cut = text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


def text_slices(texts: list[str | None], size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a list of texts with about ``size`` characters each (at least one text)."""
    a = total = 0
    for b, text in enumerate(texts):
        total += len(text or "")
        if total >= size:
            yield a, b + 1
            a, total = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def within_bytes(rows: DataFrame, order: tuple[Column, ...], size: int = SAMPLE_BYTES) -> DataFrame:
    """The first rows of a bounded sample, in that order, whose texts have ``size`` bytes together; longer texts are passed over.

    ``rows`` has one row a doc_id.  Only ids and lengths are put in order in one place, and the texts of the ids kept are fetched after.
    """
    past = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # a bounded sample, without its texts
    small = rows.select("doc_id", F.octet_length("text").alias("_bytes")).where(F.col("_bytes") <= size)
    kept = small.withColumn("_bytes", F.sum("_bytes").over(past)).where(F.col("_bytes") <= size).select("doc_id")
    return rows.join(F.broadcast(kept), "doc_id", "left_semi")  # at most as many ids as the sample has


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a bounded sample in one task, in order of doc_id; a lost executor only repeats it.

    The driver receives the model alone, never the texts.
    """
    schema = sample.schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else pa.table({f.name: pa.array([], pa.null()) for f in schema.fields})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table), 5)], pa.binary())], names=["model"])

    rows = sample.coalesce(1).sortWithinPartitions("doc_id").mapInArrow(tidy(step), "model binary").collect()
    if rows:
        return pickle.loads(rows[0]["model"])  # noqa: S301 (our own bytes)
    return fit(pa.table({f.name: pa.array([], pa.null()) for f in schema.fields}))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(id, component) of the undirected graph ``edges(a, b)``; component is the smallest id reachable.

    Alternating large-star and small-star steps: every id learns the smallest neighbour, so that a
    chain halves with each round.  Minima are pre-aggregated per task before the shuffle; nothing
    but two numbers a round reaches the driver.
    """

    def joined(e: DataFrame, low: DataFrame) -> DataFrame:
        return e.join(low, "u")

    e = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, low).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = settled(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), name)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
