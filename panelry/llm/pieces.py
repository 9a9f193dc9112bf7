"""SentencePiece encoding by sampling, and lossless decoding.

All segmentations of a text into pieces form a lattice.  A forward pass gives each position the log
sum of the weights of all segmentations up to it (forward filtering); a segmentation is then drawn
from the end backwards, edge by edge, each with its probability given the rest (backward sampling).
The random numbers come from the row's key and the place in the text alone, so a row is segmented in
the same way whatever the partitioning, and a lost task repeats its result.

The lattice falls apart wherever no piece spans two neighbouring characters, so it is filtered once
for each distinct stretch of a slice of documents and sampled for all occurrences at once.

Weights: a unigram model's scores are log probabilities; a BPE model's scores are merge ranks, for
which Zipf's rule ``-ln(1 + rank)`` stands.  ``smoothing`` multiplies the weights: 0 draws among all
segmentations alike, large values approach the single best one.

Decoding is lossless: characters without a piece, and the character that stands for a space, become
byte pieces.  A null text has null pieces; an empty one has none.  A row with a null key draws by its
text.  Rows that repeat a key and text are segmented alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, slices
from .kernels import mix, powers

_SPACE_MARK = 0x2581
_LITERAL = 0xD800
_BASE = 0x9E3779B97F4A7C15
#: Text that one step works on: larger slices repeat more stretches.
SLICE = 1 << 20
#: Piece ids that are decoded at a time.
DECODED = 1 << 18


class Vocabulary:
    """A model's pieces as hash tables by length, and what each id decodes to."""

    def __init__(self, path: str, smoothing: float = 1.0):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        self.out: list[bytes] = [b""] * n
        plain = []
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.out[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                plain.append((i, piece, model.get_score(i)))
                self.out[i] = piece.replace("▁", " ").encode()
        scores = np.array([s for *_, s in plain])
        ranks = bool(len(scores)) and float(np.median(scores)) < -1000
        rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
        weight = (-np.log1p(rank + 1.0) if ranks else scores) * smoothing
        #: weight of one byte piece: less than any piece's
        self.byte_weight = float(weight.min() - 1.0) if len(weight) else -1.0
        self.longest = max((len(p) for _, p, _ in plain), default=0)
        # by length: sorted hashes of all beginnings of pieces; the piece's id and weight, or id -1
        begin: list[dict[int, tuple[int, float]]] = [{} for _ in range(self.longest + 1)]
        pairs = set()
        chars = sorted({ord(c) for _, p, _ in plain for c in p})
        letter = dict(zip(chars, mix(np.array(chars, np.uint64) + np.uint64(1)).tolist(), strict=True))
        for (i, piece, _), w in zip(plain, weight, strict=True):
            code = [ord(c) for c in piece]
            pairs.update(zip(code[:-1], code[1:], strict=True))
            h, power = 0, 1
            for k, c in enumerate(code):
                h = (h + letter[c] * power) & _MASK
                power = (power * _BASE) & _MASK
                if k + 1 == len(code):
                    begin[k + 1][h] = (i, float(w))
                else:
                    begin[k + 1].setdefault(h, (-1, 0.0))
        self.tables = []
        for d in begin:
            keys = np.array(sorted(d), np.uint64)
            self.tables.append((keys, np.array([d[int(k)][0] for k in keys], np.int32), np.array([d[int(k)][1] for k in keys], np.float64)))
        # the characters that stand in longer pieces, numbered; and which of them a piece joins
        inside = sorted({c for pair in pairs for c in pair})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[inside] = np.arange(1, len(inside) + 1)
        self.joined = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        if pairs:
            a, b = np.array(sorted(pairs)).T
            self.joined[self.number[a], self.number[b]] = True
        lengths = [len(b) for b in self.out]
        self.out_at = np.concatenate([[0], np.cumsum(lengths)])
        self.out_bytes = np.frombuffer(b"".join(self.out), np.uint8)


_MASK = (1 << 64) - 1


@cache
def vocabulary(path: str, smoothing: float = 1.0) -> Vocabulary:
    """The vocabulary of a model file, read once a process."""
    return Vocabulary(path, smoothing)


def encode(texts: list[str | None], keys: np.ndarray, vocab: Vocabulary) -> list[np.ndarray | None]:
    """A sampled segmentation of each text."""
    marked = ["▁" + t.replace("▁", "\ud800").replace(" ", "▁") if t else "" for t in texts]
    # a lone surrogate can't be in a text; it stands for a literal mark, and has no piece
    size = np.array([len(t) for t in marked])
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    total = len(code)
    if not total:
        return [None if t is None else np.zeros(0, np.int32) for t in texts]
    with np.errstate(over="ignore"):
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(mix(code + np.uint64(1)) * powers(_BASE, total), out=sums[1:])
        inverse = powers(pow(_BASE, -1, 1 << 64), total + 1)

        def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (sums[b] - sums[a]) * inverse[a]

        # stretches: cut where no piece spans two characters, and between documents
        number = vocab.number[code]
        cut = np.ones(total + 1, bool)
        cut[1:-1] = ~vocab.joined[number[:-1], number[1:]]
        cut[np.cumsum(size)] = True
        edge = np.flatnonzero(cut)
        start, stop = edge[:-1], edge[1:]
        _, one, which = np.unique(part(start, stop) + (stop - start).astype(np.uint64) * np.uint64(_BASE), return_index=True, return_inverse=True)
        # the distinct stretches, one after another; a stretch of n characters has n + 1 nodes
        length = (stop - start)[one]
        base = np.concatenate([[0], np.cumsum(length)])
        owner = np.repeat(np.arange(len(one)), length)
        offset = np.arange(base[-1]) - base[:-1][owner]
        char = start[one][owner] + offset
        left = length[owner] - offset
        frm, to, piece, weight = [], [], [], []
        alive = np.arange(len(char))
        single = np.zeros(len(char), bool)
        for n in range(1, vocab.longest + 1):
            alive = alive[left[alive] >= n]
            if not len(alive):
                break
            h = part(char[alive], char[alive] + n)
            keys_n, ids, weights = vocab.tables[n]
            if not len(keys_n):
                break
            at = np.minimum(np.searchsorted(keys_n, h), len(keys_n) - 1)
            on = keys_n[at] == h
            alive, at = alive[on], at[on]
            full = ids[at] >= 0
            a = alive[full]
            node = a + owner[a]
            frm.append(node), to.append(node + n), piece.append(ids[at[full]]), weight.append(weights[at[full]])
            if n == 1:
                single[a] = True
    # characters without a piece: their bytes
    lone = np.flatnonzero(~single)
    node = lone + owner[lone]
    raw = code[char[lone]]
    width = 1 + (raw > 0x7F) + (raw > 0x7FF) + (raw > 0xFFFF)
    width[raw == _LITERAL] = 3  # the literal mark is U+2581
    frm.append(node), to.append(node + 1), piece.append(-1 - raw.astype(np.int64)), weight.append(vocab.byte_weight * width)
    frm, to, weight = np.concatenate(frm), np.concatenate(to), np.concatenate(weight)
    piece = np.concatenate([p.astype(np.int64) for p in piece])
    nodes = base[-1] + len(one)
    first_node = base[:-1] + np.arange(len(one))
    depth = np.arange(nodes) - np.repeat(first_node, length + 1)
    order = np.lexsort((to, depth[to]))
    frm, to, weight, piece = frm[order], to[order], weight[order], piece[order]
    filtered = np.full(nodes, -np.inf)
    filtered[first_node] = 0.0
    level = np.searchsorted(depth[to], np.arange(1, int(length.max()) + 2))
    share = np.empty(len(to))
    for a, b in zip(level[:-1], level[1:], strict=True):
        x = filtered[frm[a:b]] + weight[a:b]
        new = np.ones(b - a, bool)
        new[1:] = to[a + 1 : b] != to[a : b - 1]
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        top = np.maximum.reduceat(x, head)
        e = np.exp(x - top[group])
        mass = np.add.reduceat(e, head)
        filtered[to[a:b][head]] = top + np.log(mass)
        run = np.cumsum(e)
        share[a:b] = (run - (run[head] - e[head])[group]) / mass[group]
    order = np.argsort(to, kind="stable")
    frm, to, share, piece = frm[order], to[order], share[order], piece[order]
    low = np.searchsorted(to, np.arange(nodes + 1))
    # backward: all occurrences step from their end to their start together
    doc = np.searchsorted(np.cumsum(size), start, side="right")
    seed = mix(mix(keys.astype(np.uint64) + np.uint64(_BASE))[doc] + (start - (np.cumsum(size) - size)[doc]).astype(np.uint64))
    active = np.arange(len(start))
    here = (first_node + length)[which]
    goal = first_node[which]
    found_at, found_step, found_edge = [], [], []
    step = 0
    while len(active):
        with np.errstate(over="ignore"):
            u = (mix(seed[active] + np.uint64(step) * np.uint64(_BASE)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick, last = low[here[active]], low[here[active] + 1] - 1
        on = np.flatnonzero((pick < last) & (share[pick] <= u))
        while len(on):  # a node has few edges: walk along their running shares
            pick[on] += 1
            at = pick[on]
            on = on[(at < last[on]) & (share[at] <= u[on])]
        found_at.append(active), found_step.append(np.full(len(active), step)), found_edge.append(pick)
        here[active] = frm[pick]
        active = active[here[active] > goal[active]]
        step += 1
    at, steps, chosen = np.concatenate(found_at), np.concatenate(found_step), np.concatenate(found_edge)
    order = np.lexsort((-steps, at))
    at, ids = at[order], piece[chosen[order]]
    # byte pieces: one id for each byte of the character
    raw = np.where(ids < 0, -1 - ids, 0)
    raw[raw == _LITERAL] = _SPACE_MARK
    width = np.where(ids < 0, 1 + (raw > 0x7F) + (raw > 0x7FF) + (raw > 0xFFFF), 1)
    place = np.concatenate([[0], np.cumsum(width)])
    flat = np.empty(place[-1], np.int32)
    flat[place[:-1]] = ids
    for i in np.flatnonzero(ids < 0):
        flat[place[i] : place[i + 1]] = vocab.byte_id[np.frombuffer(chr(raw[i]).encode("utf-8", "surrogatepass"), np.uint8)]
    count = np.bincount(doc[at], width, minlength=len(texts)).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(count)])
    return [None if t is None else flat[edges[i] : edges[i + 1]] for i, t in enumerate(texts)]


def decode(flat: np.ndarray, first: np.ndarray, vocab: Vocabulary) -> list[str]:
    """The texts of lists of ids, given as one array and where each list begins."""
    length = (vocab.out_at[1:] - vocab.out_at[:-1])[flat]
    place = np.concatenate([[0], np.cumsum(length)])
    take = np.repeat(vocab.out_at[flat] - place[:-1], length) + np.arange(place[-1])
    data = vocab.out_bytes[take].tobytes()
    edge = place[first]
    return [data[a + 1 : b].decode("utf-8", "surrogatepass") if b > a else "" for a, b in zip(edge[:-1], edge[1:], strict=True)]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", column: str = "pieces", smoothing: float = 1.0) -> DataFrame:
    """``docs`` with a column of sampled piece ids of ``text`` (an existing column of that name is replaced)."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != column] + [T.StructField(column, T.ArrayType(T.IntegerType()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, smoothing)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                texts = part["text"].to_pylist()
                keys = np.array([k if isinstance(k, int) else hash_text(t) for k, t in zip(part[key].to_pylist(), texts, strict=True)], np.int64)
                ids = encode(texts, keys.view(np.uint64), vocab)
                at = part.schema.get_field_index(column)
                if at >= 0:
                    part = part.remove_column(at)
                yield from part.append_column(column, pa.array(ids, pa.list_(pa.int32()))).combine_chunks().to_batches()

    return arrow_map(docs, step, schema)


def hash_text(text: str | None) -> int:
    """A stable 63-bit number for a row without a key."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    with np.errstate(over="ignore"):
        return int((mix(data + np.uint64(1)) * powers(_BASE, len(data))).sum() >> np.uint64(1))


def decoded(docs: DataFrame, path: str, column: str = "pieces", into: str = "decoded", check: str = "ids_crc32") -> DataFrame:
    """``docs`` with the text of the piece ids in ``column`` (null for null) and the CRC-32 of the ids.

    The CRC-32 is that of the ids as little-endian 32-bit integers.
    """
    schema = T.StructType([f for f in docs.schema.fields if f.name not in (into, check)] + [T.StructField(into, T.StringType()), T.StructField(check, T.LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            size = batch[column].value_lengths().fill_null(0).to_numpy()
            group = np.cumsum(size) // DECODED
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(size)]]) if len(size) else [0]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                table = pa.Table.from_batches([batch.slice(low, high - low)])
                ids = table[column].chunk(0)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                values, edge = ids.flatten().to_numpy().astype("<i4"), np.concatenate([[0], np.cumsum(size[low:high])]).astype(np.int64)
                texts = decode(values, edge, vocab)
                sums = [None if x else zlib.crc32(values[a:b].tobytes()) for x, a, b in zip(null, edge[:-1], edge[1:], strict=True)]
                for name, column_ in ((into, pa.array([None if x else t for x, t in zip(null, texts, strict=True)], pa.string())), (check, pa.array(sums, pa.int64()))):
                    at = table.schema.get_field_index(name)
                    table = (table.remove_column(at) if at >= 0 else table).append_column(name, column_)
                yield from table.combine_chunks().to_batches()

    return arrow_map(docs, step, schema)

