"""Token-id files: frequency-ranked ids in byte-aligned variable-length code.

*Encoding.*  Texts are split as the tokenizer splits them, by numpy on code points; each distinct part of
a worker's texts goes through the tokenizers library once, and the ids are put together.  A text that
holds one of the tokenizer's added tokens, or a code point that this Python's Unicode tables don't know,
goes through the library whole; so does every text where the split rule is not
``public_tokenizers.PATTERN``.

*Ranks.*  Ids are counted over all documents and renumbered by falling frequency, so that the usual
ids are small.

*Code.*  A shard stores each rank in one to four bytes.  The lengths stand apart, two bits each and four
to a control byte, so the data bytes are found by looking control bytes up in a table and summing;
numpy decodes a whole shard without a loop over tokens.

*Files.*  A folder of Parquet files, each a row per shard in ascending doc_id order: the part and
place of the shard, the doc_ids, the tokens of each document, control bytes and data bytes.  Beside
it lies the table of ids by rank.  Parts are ranges of doc_id; inside a part shards follow one
another, so readers find a document's place from the sums alone.

A null text counts as empty: it holds only the end id.  Rows with a null doc_id come first.  Rows that
repeat a doc_id follow one another, in order of their text's hash.  An empty table makes an empty
folder.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, settled, shared_dir, slices, tidy
from .kernels import mix, powers

#: Tokens after which a shard is closed (at the end of a document).
SHARD = 1 << 21
#: Distinct parts that a worker remembers before it starts afresh.
REMEMBERED = 1_000_000
#: New parts that the library gets as one text.
TOGETHER = 64
#: Bytes of ids for which one file is provided.
FILE_BYTES = 64 << 20

_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.int64) + 1


# Classes of code points in the split rule; ``_END`` parts documents, ``_UNKNOWN`` is unassigned here and maybe not in the library.
_LETTER, _NUMBER, _OTHER, _WHITE, _END, _UNKNOWN = range(6)
# White space of the split rule, and what may follow an apostrophe as a part of its own.
_WHITES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_BASE = 0x9E3779B97F4A7C15


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        g = unicodedata.category(chr(c))
        out[c] = _UNKNOWN if g == "Cn" else kind.get(g[0], _OTHER)
    out[_WHITES] = _WHITE
    return out


@cache
def _hashes() -> np.ndarray:
    """A 64-bit number for every code point."""
    return mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * np.uint64(_BASE))


def split_places(code: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where parts begin, by the rule of ``public_tokenizers.PATTERN``; ends of documents (class ``_END``) stand alone.

    A part is a run of letters, of numbers or of other characters, with one space before it; of white
    space before anything else the last character stands apart; an apostrophe that no space or other
    character precedes takes one of ``_ENDINGS`` with it.
    """
    n = len(code)
    turn = np.ones(n, bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn |= kind == _END
    white = kind == _WHITE
    after_space = np.zeros(n, bool)
    after_space[1:] = code[:-1] == 0x20
    start = turn & ~(after_space & (kind <= _OTHER))
    last = np.flatnonzero(white[:-1] & (kind[1:] <= _OTHER))
    start[last] = True
    quote = np.flatnonzero(turn & (code == 0x27) & ~after_space)
    quote = quote[quote + 1 < n]
    quote = quote[kind[quote + 1] == _LETTER]
    for ending in _ENDINGS if len(quote) else ():
        fits = np.ones(len(quote), bool)
        for k, c in enumerate(ending, 1):
            fits &= code[np.minimum(quote + k, n - 1)] == ord(c)
        at = quote[fits]
        start[at + 1] = False
        rest = at + 1 + len(ending)
        start[rest[(rest < n) & (kind[np.minimum(rest, n - 1)] == _LETTER)]] = True
        quote = quote[~fits]
    return np.flatnonzero(start)


class Encoder:
    """A tokenizer file with a memory of the parts it has met; ids are those of the library.

    The memory is a hash table of parts.  Every hit is compared with the part itself, character by
    character; should two parts ever share a 64-bit hash, their documents go through the library whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known_rule = pattern == public_tokenizers.PATTERN
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._power = self._inverse = np.zeros(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(1 << 18, -1, np.int32)
        self.n = 0
        self.key, self.begin, self.first = np.zeros(1 << 16, np.uint64), np.zeros((1 << 16) + 1, np.int64), np.zeros((1 << 16) + 1, np.int64)
        self.code, self.ids = np.zeros(1 << 19, np.uint32), np.zeros(1 << 18, np.int32)

    def _hash(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self._power) <= len(code):
            self._power, self._inverse = powers(_BASE, len(code) + 1), powers(pow(_BASE, -1, 1 << 64), len(code) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(_hashes()[code] * self._power[: len(code)], out=total[1:])
            return mix((total[end] - total[start]) * self._inverse[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in the memory, or -1."""
        mask = np.uint64(len(self.slots) - 1)
        spot = (h & mask).astype(np.int64)
        at = self.slots[spot]
        left = np.flatnonzero((at >= 0) & (self.key[at] != h))
        while len(left):
            spot[left] = (spot[left] + 1) & int(mask)
            at[left] = self.slots[spot[left]]
            left = left[(at[left] >= 0) & (self.key[at[left]] != h[left])]
        return at

    def _insert(self, h: np.ndarray, place: np.ndarray) -> None:
        mask = len(self.slots) - 1
        spot = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.slots[spot[left]] < 0]
            self.slots[spot[free]] = place[free]
            left = left[self.slots[spot[left]] != place[left]]
            spot[left] = (spot[left] + 1) & mask

    def _learn(self, h: np.ndarray, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Remember parts with distinct new hashes."""
        # a space and letters: put one after another, they are split as they stand, and go through the library together
        plain = (code[start] == 0x20) & (end - start > 1) & (_classes()[code[np.minimum(start + 1, len(code) - 1)]] == _LETTER)
        order = np.argsort(~plain, kind="stable")
        h, start, end = h[order], start[order], end[order]
        edge = np.concatenate([[0], np.cumsum(end - start)])
        text = code[_ranges(start, end - start)].tobytes().decode("utf-32-le")
        joined = int(plain.sum())
        heads = np.append(np.arange(0, joined, TOGETHER), joined)
        whole = self.tokenizer.encode_batch([text[edge[a] : edge[b]] for a, b in zip(heads[:-1], heads[1:], strict=True)], add_special_tokens=False)
        word = np.fromiter(chain.from_iterable(x.word_ids for x in whole), np.int64) + np.repeat(heads[:-1], [len(x.ids) for x in whole])
        length = np.bincount(word, minlength=joined).astype(np.int64)
        if len(length) != joined or not length.all() or not (np.diff(word) >= 0).all():
            joined, whole, length = 0, [], length[:0]  # not split as they stand: one by one
        rest = self.tokenizer.encode_batch([text[a:b] for a, b in zip(edge[joined:-1].tolist(), edge[joined + 1 :].tolist(), strict=True)], add_special_tokens=False)
        found = [x.ids for x in chain(whole, rest)]
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        length = np.concatenate([length, np.array([len(x.ids) for x in rest], np.int64)])
        n, m = self.n, self.n + len(length)
        size = end - start
        used, chars = int(self.first[n]), int(self.begin[n])
        self.key, self.first, self.begin = _room(self.key, m), _room(self.first, m + 1), _room(self.begin, m + 1)
        self.ids, self.code = _room(self.ids, used + len(ids)), _room(self.code, chars + int(size.sum()))
        self.key[n:m] = h
        self.first[n + 1 : m + 1] = used + np.cumsum(length)
        self.begin[n + 1 : m + 1] = chars + np.cumsum(size)
        self.ids[used : used + len(ids)] = ids
        self.code[chars : chars + int(size.sum())] = code[_ranges(start, size)]
        self.n = m
        if 2 * m > len(self.slots):
            self.slots = np.full(1 << (4 * m).bit_length(), -1, np.int32)
            self._insert(self.key[:m], np.arange(m, dtype=np.int32))
        else:
            self._insert(h, np.arange(n, m, dtype=np.int32))

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each document's followed by ``end``, and where each document's begin."""
        if self.n > REMEMBERED:
            self._forget()
        whole = {i for i, t in enumerate(texts) if t and (not self.known_rule or any(a in t for a in self.added))}
        plain = ["" if not t or i in whole else t for i, t in enumerate(texts)]
        code = np.frombuffer(("\n".join(plain) + "\n").encode("utf-32-le"), np.uint32)
        edge = np.cumsum([len(t) + 1 for t in plain])
        kind = _classes()[code]
        kind[edge - 1] = _END
        unknown = np.flatnonzero(kind == _UNKNOWN)
        whole.update(np.searchsorted(edge, unknown, side="right").tolist())
        kind[unknown] = _OTHER
        cut = split_places(code, kind)
        stop = np.append(cut[1:], len(code))
        real = kind[cut] != _END
        start, stop = cut[real], stop[real]
        h = self._hash(code, start, stop)
        at = self._find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            uniq, one = np.unique(h[new], return_index=True)
            self._learn(uniq, code, start[new[one]], stop[new[one]])
            at[new] = self._find(h[new])
        at = at.astype(np.int64)
        doc = np.searchsorted(edge, start, side="right")
        # every character against the remembered part's: a hash alone proves nothing
        size = stop - start
        same = self.begin[at + 1] - self.begin[at] == size
        if same.all():
            differ = self.code[_ranges(self.begin[at], size)] != code[kind != _END]
            if differ.any():
                same = np.repeat(np.arange(len(at)), size)[differ]
                same = ~np.isin(np.arange(len(at)), same)
        whole.update(doc[~same].tolist())
        length = self.first[at + 1] - self.first[at]
        ids = self.ids[_ranges(self.first[at], length)]
        count = np.bincount(doc, length, minlength=len(texts)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(count + 1)])
        out = np.full(first[-1], end, np.int32)
        inside = np.ones(len(out), bool)
        inside[first[1:] - 1] = False
        out[inside] = ids
        if whole:
            pieces = [out[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            for i in whole:
                pieces[i] = np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, end], np.int32)
            out, first = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        return out, first.astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .., one after another."""
    edge = np.cumsum(size)
    return np.repeat(start - edge + size, size) + np.arange(edge[-1] if len(edge) else 0)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` grown, by doubling, to ``n`` places at least."""
    while n > len(x):
        x = np.concatenate([x, np.zeros_like(x)])
    return x


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a tokenizer file, one a process."""
    return Encoder(path, pattern)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit integers."""
    values = values.astype("<u4")
    length = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    four = values.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), four[np.arange(4) < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers of ``pack``."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < length[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def tokens(docs: DataFrame, path: str, pattern: str, end: int) -> DataFrame:
    """(doc_id, tie, ids): each text's ids and the end id, as little-endian 32-bit integers in bytes."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids, first = own.encode(part["text"].to_pylist(), end)
                rows = [ids[a:b].astype("<u2" if wide <= 1 << 16 else "<u4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), part["tie"].combine_chunks(), pa.array(rows, pa.binary())], names=["doc_id", "tie", "ids"])

    wide = max(encoder(path, pattern).tokenizer.get_vocab_size(), end + 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidy(step), "doc_id long, tie long, ids binary")


def write(docs: DataFrame, path: str, pattern: str, end: int, folder: str) -> None:
    """Encode all documents into ``folder``: ``shards`` and ``ranks``."""
    spark = docs.sparkSession
    kind = "<u2" if max(encoder(path, pattern).tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    coded = settled(tokens(docs, path, pattern, end), "tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                more = np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=len(total))
                more[: len(total)] += total
                total = more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    # one row for each id of the vocabulary: bounded by the tokenizer
    counts = coded.select("ids").mapInArrow(tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "id"], ascending=[False, True])
    by_rank = counts["id"].to_numpy(np.int64)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    spark.createDataFrame(counts.assign(rank=range(len(counts)))[["rank", "id", "n"]], "rank long, id long, n long").coalesce(1).write.parquet(f"{folder}/ranks")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        waiting: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in waiting], np.int64)
            control, data = pack(np.concatenate(waiting))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([int(sizes.sum())], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["part", "place", "doc_ids", "sizes", "n_tokens", "control", "data"],
            )

        held = 0
        for batch in batches:
            for key, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                keys.append(key), waiting.append(rank[np.frombuffer(ids.as_buffer(), kind)])
                held += len(waiting[-1])
                if held >= SHARD:
                    yield close()
                    keys, waiting, held, place = [], [], 0, place + 1
        if keys:
            yield close()

    size = coded.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    ranged = coded.repartitionByRange(buckets(spark, size, FILE_BYTES), F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    ranged.select("doc_id", "ids").mapInArrow(tidy(shards), "part int, place int, doc_ids array<long>, sizes array<long>, n_tokens long, control binary, data binary").write.parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of a folder; ``ids`` are 32-bit integers in bytes."""
    found = spark.read.parquet(f"{folder}/shards")
    by_rank = spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").toPandas()["id"].to_numpy("<u4")
    # one number for each file; shards inside a file are summed by a window
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values("part")
    starts = spark.createDataFrame(parts.assign(before=parts["n"].cumsum() - parts["n"])[["part", "before"]], "part int, before long")
    from pyspark.sql import Window

    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    places = found.select("part", "place", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    places = places.join(starts, "part").select("part", "place", (F.col("before") + F.col("inside")).alias("start"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = by_rank[unpack(row["control"], row["data"], row["n_tokens"])]
                sizes = np.array(row["sizes"], np.int64)
                edge = np.concatenate([[0], np.cumsum(sizes)])
                docs = [ids[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(edge[:-1] + row["start"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(docs, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return found.join(places, ["part", "place"]).mapInArrow(tidy(step), "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    """A folder in the shared storage that no other run uses."""
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"


def crc32(ids: bytes) -> int:
    """Unsigned CRC-32, as Spark's ``crc32``."""
    return zlib.crc32(ids)
