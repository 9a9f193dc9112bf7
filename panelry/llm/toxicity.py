"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A word's embedding is the sum of hashed vectors of the word and of its first three to six letters, so
that an unseen form of a known stem is recognised.  Filters one to three words wide slide over the
whole text; each filter's largest response (max pooling) feeds a logistic output.  Only the winning
positions receive gradients, so an epoch costs little more than a forward pass.

The first number of a hashed vector starts as what its bucket tells alone, the log odds of toxic documents among
those that hold it, shrunk towards the common rate; the first filter starts by reading it.  So what a few hundred
labels can show is there before the first epoch, and training goes on from it only as long as the
held-back rows are ranked better.

Training reads at most ``SAMPLE`` labelled rows and ``common.SAMPLE_BYTES`` of their text, half of them
toxic where there are enough, the first by a hash of the doc_id, in one task; the driver sees the model alone.  A quarter of them is held back to choose, for each language as told from the
text alone, the logit that best parts the classes; the output is shifted so that this logit scores
``THRESHOLD``.  Held-back rows are weighted so that the classes have the rates of all allowed labels,
however the sample is mixed.  A language's logit is drawn towards that of all languages, the more the fewer toxic rows it has.

Every whole text gets a score.  Null and empty texts, and texts without letters, give no evidence: their
score is ``THRESHOLD`` times the share of toxic rows among all allowed labels, so they are never rejected.  Without labelled rows, or with only one class, the score is the share of toxic rows (0 if
there are none).  Labels that repeat for a document count once, as toxic if any says so; of rows that repeat a
doc_id one teaches.  Equal logits get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fitted, slices, text_slices, within_bytes
from .langid import LanguageModel
from .letters import Letters

SAMPLE = 6000
THRESHOLD = 0.3
BUCKETS, DIM = 1 << 16, 12
WIDTHS, FILTERS = (1, 2, 3), 8
PREFIXES = (3, 4, 5, 6)
EPOCHS, BATCH, RATE, PATIENCE = 10, 64, 0.02, 2
#: Documents at the common rate that are added to a bucket's own, and toxic rows at the common cut to a language's own.
PRIOR, COMMON = 10, 15
#: Words whose vectors are in memory at a time.
GROUP = 1 << 16


def _features(letters: Letters) -> np.ndarray:
    """For each word, the bucket of the word and of each of its prefixes (the whole word again where shorter)."""
    parts = [letters.hash(letters.start, letters.end)]
    for k, n in enumerate(PREFIXES):
        end = np.minimum(letters.start + n, letters.end)
        parts.append(letters.hash(letters.start, end) * np.uint64(2 * k + 3))
    return np.stack([(p >> np.uint64(20)) % np.uint64(BUCKETS) for p in parts], 1).astype(np.int32)


class ToxicityModel:
    """The trained network.  ``logits`` is its raw output, ``scores`` the calibrated one."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.kernel = [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.constant: float | None = None
        self.share = 0.0
        self.languages: LanguageModel | None = None
        self.cut: dict[str, float] = {}

    def _embedded(self, words: np.ndarray) -> np.ndarray:
        """The sum of each word's hashed vectors."""
        out = self.table[words[:, 0]]
        for k in range(1, words.shape[1]):
            out += self.table[words[:, k]]
        return out

    def _pool(self, words: np.ndarray, first: np.ndarray, track: bool = False):
        """Largest response of each filter in each document (0 where the text is shorter), and where it is.

        Documents go in groups of about ``GROUP`` words, which bounds the temporaries.
        """
        pooled, where = [], []
        for a, b in _groups(first):
            best, spot = self._pool_group(words[first[a] : first[b]], first[a : b + 1] - first[a], track)
            pooled.append(best), where.append([np.where(s >= 0, s + first[a], -1) for s in spot])
        none = np.zeros((0, FILTERS), np.int64)
        return np.concatenate(pooled) if pooled else np.zeros((0, len(WIDTHS) * FILTERS), np.float32), [np.concatenate([w[i] for w in where] or [none]) for i in range(len(WIDTHS))]

    def _pool_group(self, words: np.ndarray, first: np.ndarray, track: bool):
        n, docs = len(words), len(first) - 1
        emb = self._embedded(words)
        pooled, where = [], []
        doc = np.repeat(np.arange(docs, dtype=np.int32), np.diff(first))
        for w, kernel, bias in zip(WIDTHS, self.kernel, self.bias, strict=True):
            best = np.zeros((docs, FILTERS), np.float32)
            spot = np.full((docs, FILTERS), -1, np.int64)
            last = first[1:] - w + 1
            some = np.flatnonzero(last > first[:-1])
            if len(some):
                m = n - w + 1
                value = bias + emb[:m] @ kernel[:DIM]
                for j in range(1, w):
                    value += emb[j : j + m] @ kernel[j * DIM : (j + 1) * DIM]
                # positions that would run into the next document don't count
                value[np.arange(m) >= last[doc[:m]]] = -np.inf
                top = np.maximum.reduceat(value, first[:-1][some], axis=0)
                if track:
                    row = np.full(docs, -1)
                    row[some] = np.arange(len(some))
                    at, f = np.nonzero(value == top[row[doc[:m]]])
                    spot[doc[at][::-1], f[::-1]] = at[::-1]  # the first of equal positions stays
                    spot[some] = np.where(top > 0, spot[some], -1)
                best[some] = np.maximum(top, 0)
            pooled.append(best), where.append(spot)
        return np.concatenate(pooled, 1), where

    def prime(self, words: np.ndarray, first: np.ndarray, label: np.ndarray) -> None:
        """Start from the log odds of each bucket: how many documents hold it as one feature, and how many of these are toxic."""
        doc = np.repeat(np.arange(len(label), dtype=np.int64), np.diff(first))
        held, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for k in range(words.shape[1]):
            d, bucket = np.divmod(np.unique(doc * BUCKETS + words[:, k]), BUCKETS)
            n, hit = np.bincount(bucket, minlength=BUCKETS), np.bincount(bucket, label[d], minlength=BUCKETS)
            more = n > held
            held, toxic = np.where(more, n, held), np.where(more, hit, toxic)
        rate = label.mean()
        self.table[:, 0] = np.log((toxic + PRIOR * rate) / (held + PRIOR) / rate) / words.shape[1]
        self.kernel[0][:, 0] = 0
        self.kernel[0][0, 0] = 1
        self.out[0], self.base[0] = 4, -4

    def fit(self, words: np.ndarray, first: np.ndarray, label: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, seed: int = 7) -> None:
        """Adaptive gradient descent on the log loss, in document batches, from the log odds of the buckets.

        ``held`` has words, bounds and labels that don't teach; the weights after which they are ranked best stay (the
        earliest of equals), and training ends when ``PATIENCE`` epochs have not ranked them better.
        """
        self.prime(words, first, label)
        best = (self._ranked(*held), 0, self._weights()) if held is not None and len(set(held[2].tolist())) == 2 else None
        rng = np.random.default_rng(seed)
        names = ("out", "base")
        square = {k: np.full_like(getattr(self, k), 1e-2) for k in names} | {("k", i): np.full_like(k, 1e-2) for i, k in enumerate(self.kernel)} | {("b", i): np.full_like(b, 1e-2) for i, b in enumerate(self.bias)}
        seen = np.full(BUCKETS, 1e-2, np.float32)

        def move(key, param: np.ndarray, grad: np.ndarray) -> None:
            square[key] += grad * grad
            param -= RATE * grad / np.sqrt(square[key])

        for epoch in range(1, EPOCHS + 1):
            order = rng.permutation(len(label))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                size = first[pick + 1] - first[pick]
                edge = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(first[pick] - edge[:-1], size) + np.arange(edge[-1])
                own = words[take]
                pooled, where = self._pool(own, edge, track=True)
                error = 1 / (1 + np.exp(-(pooled @ self.out + self.base[0]))) - label[pick]
                error = (error / len(pick)).astype(np.float32)
                back = error[:, None] * self.out[None, :]
                rows, grads = [], []
                for i, w in enumerate(WIDTHS):
                    d, f = np.nonzero(where[i] >= 0)
                    at, g = where[i][d, f], back[d, i * FILTERS + f]
                    dk = np.zeros_like(self.kernel[i])
                    for j in range(w):
                        part = slice(j * DIM, (j + 1) * DIM)
                        emb = self._embedded(own[at + j])
                        np.add.at(dk[part].T, f, g[:, None] * emb)
                        rows.append(own[at + j])
                        grads.append(g[:, None] * self.kernel[i][part].T[f])
                    db = np.bincount(f, g, minlength=FILTERS).astype(np.float32)
                    move(("k", i), self.kernel[i], dk), move(("b", i), self.bias[i], db)
                move("out", self.out, pooled.T @ error)
                move("base", self.base, error.sum(keepdims=True))
                if rows:
                    row = np.concatenate(rows)
                    uniq, inverse = np.unique(row, return_inverse=True)
                    total = np.zeros((len(uniq), DIM), np.float32)
                    np.add.at(total, inverse.reshape(row.shape).T, np.concatenate(grads)[None])
                    seen[uniq] += (total * total).mean(1)
                    self.table[uniq] -= RATE * total / np.sqrt(seen[uniq])[:, None]
            if best:
                rank = self._ranked(*held)
                if rank > best[0]:
                    best = rank, epoch, self._weights()
                elif epoch - best[1] >= PATIENCE:
                    break
        if best:
            self.table, self.kernel, self.bias, self.out, self.base = best[2]

    def _weights(self) -> tuple:
        return self.table.copy(), [k.copy() for k in self.kernel], [b.copy() for b in self.bias], self.out.copy(), self.base.copy()

    def _ranked(self, words: np.ndarray, first: np.ndarray, label: np.ndarray) -> float:
        """The share of pairs of a toxic and another document in which the toxic one has the larger logit (half for equal ones)."""
        _, place, count = np.unique(self._pool(words, first)[0] @ self.out + self.base[0], return_inverse=True, return_counts=True)
        rank = (np.cumsum(count) - (count - 1) / 2)[place]
        n = (label > 0).sum()
        return float((rank[label > 0].sum() - n * (n + 1) / 2) / (n * (len(label) - n)))

    def logits(self, letters: Letters) -> np.ndarray:
        pooled, _ = self._pool(_features(letters), letters.first)
        return pooled @ self.out + self.base[0]

    def calibrate(self, logit: np.ndarray, label: np.ndarray, lang: list[str], weight: np.ndarray) -> None:
        """For each language, the middle of the logits at which the F1 score of the weighted rows is highest, drawn towards that of all."""

        def best(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
            order = np.argsort(-x)
            x, y, w = x[order], y[order], w[order]
            hit = np.cumsum(w * y)
            f1 = 2 * hit / (np.cumsum(w) + (w * y).sum())
            k = int(f1.argmax())
            return float((x[k] + (x[k + 1] if k + 1 < len(x) else x[k] - 1)) / 2)

        lang = np.array(lang)
        self.cut[""] = best(logit, label, weight)
        for x in np.unique(lang):
            own = lang == x
            n = float(label[own].sum())
            if 0 < n < own.sum():
                self.cut[str(x)] = (n * best(logit[own], label[own], weight[own]) + COMMON * self.cut[""]) / (n + COMMON)

    def scores(self, letters: Letters) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(letters.first) - 1, self.constant)
        lang, _ = self.languages.predict(letters)
        cut = np.array([self.cut.get(x, self.cut[""]) for x in lang])
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        score = 1 / (1 + np.exp(-np.clip(self.logits(letters).astype(np.float64) - cut + shift, -40, 40)))
        return np.where(np.diff(letters.first) > 0, score, THRESHOLD * self.share)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model from ``labels(doc_id, toxic)`` of the rows the caller allows; docs give text, and lang to learn languages."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    count = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    order = F.xxhash64("doc_id"), F.col("doc_id")
    taken = marked.where("toxic = 1").orderBy(*order).limit(sample // 2).unionByName(marked.where("toxic = 0").orderBy(*order).limit(sample - sample // 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).join(F.broadcast(taken), "doc_id")  # at most ``sample`` ids
    rows = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("row")).select("doc_id", "toxic", "row.*")
    rows = within_bytes(rows.withColumn("text", F.coalesce("text", F.lit(""))), order)

    def fit(table: pa.Table) -> ToxicityModel:
        return _fit(table["text"].to_pylist(), table["lang"].to_pylist(), np.array(table["toxic"].to_pylist(), np.float32), count)

    return fitted(rows.select("doc_id", "text", "lang", "toxic"), fit)


def _fit(text: list[str], lang: list[str | None], label: np.ndarray, count: dict[int, int]) -> ToxicityModel:
    """The model of a sample in order of doc_id; ``count`` has the rows of each class among all allowed labels."""
    model = ToxicityModel()
    if len(set(label.tolist())) < 2:
        model.constant = float(label.mean()) if len(label) else 0.0
        return model
    model.share = count[1] / (count[0] + count[1])
    known = [i for i, x in enumerate(lang) if x is not None]
    model.languages = LanguageModel([text[i] for i in known], [lang[i] for i in known])
    back = np.arange(len(label)) % 4 == 3
    parts: dict[bool, list[np.ndarray]] = {False: [], True: []}
    size, told = [], []
    for a, b in text_slices(text):
        letters = Letters(text[a:b])
        words, doc = _features(letters), letters.doc()
        for held in (False, True):
            parts[held].append(words[back[a:b][doc] == held])
        size.append(np.diff(letters.first)), told.extend(model.languages.predict(letters)[0])
        text[a:b] = [""] * (b - a)  # the features are all that is left to read
    size = np.concatenate(size)

    def chosen(held: bool) -> tuple[np.ndarray, np.ndarray]:
        words = np.concatenate(parts.pop(held))
        return words, np.concatenate([[0], np.cumsum(size[back == held])])

    own, held = label[back], chosen(True)
    model.fit(*chosen(False), label[~back], (*held, own))
    logit = model._pool(*held)[0] @ model.out + model.base[0]
    weight = np.where(own > 0, count[1] / max((own > 0).sum(), 1), count[0] / max((own == 0).sum(), 1))
    model.calibrate(logit, own, [x for x, b in zip(told, back, strict=True) if b], weight)
    return model


def _groups(first: np.ndarray, words: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``words`` words each (at least one document)."""
    a, n = 0, len(first) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(first, first[a] + words, side="right")) - 1))
        yield a, b
        a = b


def scored(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """``docs`` with a column of toxicity scores (an existing column of that name is replaced)."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != column] + [T.StructField(column, T.DoubleType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = model.scores(Letters(part["text"].to_pylist()))
                at = part.schema.get_field_index(column)
                if at >= 0:
                    part = part.remove_column(at)
                yield from part.append_column(column, pa.array(score, pa.float64())).combine_chunks().to_batches()

    return arrow_map(docs, step, schema)
