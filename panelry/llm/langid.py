"""Language identification: known words first, then character n-grams of falling length.

A word seen often enough in training scores its log frequency in each language.  An unseen word backs
off to its longest n-grams that were seen (from ``GRAMS[0]`` letters down to one) and scores their mean
log frequency.  A text's language is the one with the highest sum; the score is that language's
posterior under equal priors, with evidence damped to ``EVIDENCE`` words, so that it stays readable
for long texts.

Training reads text and language of at most ``SAMPLE`` documents and ``common.SAMPLE_BYTES`` of text, the
first by a hash of the doc_id, out of the rows the caller allows; word and n-gram counts of that sample
are exact.  Scoring reads whole texts and nothing but the text.

A null text, or one without any letter, is ``und`` with score 0; so is every text when no language
was learned.  Of languages with equal scores the first in alphabetical order is told.  Rows that repeat
are scored alike; of rows that repeat a doc_id one teaches.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, slices, text_slices, tidy, within_bytes
from .letters import Letters

SAMPLE = 8000
GRAMS = (5, 4, 3, 2, 1)
#: A word or n-gram counts as known from this many training occurrences.
LEAST_SEEN = 3
#: Words of evidence in the score.
EVIDENCE = 20.0


class LanguageModel:
    """Sorted hashes of known words and n-grams, and a row of log frequencies by language for each."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        code = np.array([self.langs.index(x) for x in langs], np.int64)
        none = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)), np.int32)
        sums = {n: none for n in (0, *GRAMS)}
        for a, b in text_slices(texts):
            letters = Letters(texts[a:b])
            lang = code[a:b][letters.doc()]
            words = np.arange(len(letters.start))
            sums[0] = self._count(sums[0], letters.hash(letters.start, letters.end), lang)
            for n in GRAMS:
                owner, h = letters.grams(words, n)
                sums[n] = self._count(sums[n], h, lang[owner])
        self.tables = {n: self._table(*sums[n]) for n in (0, *GRAMS)}

    def _count(self, before: tuple[np.ndarray, np.ndarray], h: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes, occurrences by language) with those of one more slice."""
        uniq, inverse = np.unique(h, return_inverse=True)
        more = np.bincount(inverse * len(self.langs) + lang, minlength=len(uniq) * len(self.langs)).reshape(-1, len(self.langs))
        keys = np.union1d(before[0], uniq)
        counts = np.zeros((len(keys), len(self.langs)), np.int32)
        counts[np.searchsorted(keys, before[0])] = before[1]
        counts[np.searchsorted(keys, uniq)] += more.astype(np.int32)
        return keys, counts

    def _table(self, keys: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = total.sum(1) >= LEAST_SEEN
        share = (total[kept] + 0.1) / (total.sum(0) + 0.1 * len(keys) + 1)
        return keys[kept], np.log(share).astype(np.float32)

    def _known(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = self.tables[n]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def scores(self, letters: Letters) -> np.ndarray:
        """Summed log frequency by document and language, and in the last column the number of words."""
        h = letters.hash(letters.start, letters.end)
        _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        value = np.zeros((len(one), len(self.langs)), np.float32)
        at, known = self._known(0, h[one])
        value[known] = self.tables[0][1][at[known]]
        left = np.flatnonzero(~known)
        for n in GRAMS:
            if not len(left):
                break
            owner, g = letters.grams(one[left], n)
            at, known = self._known(n, g)
            owner, at = owner[known], at[known]
            seen = np.bincount(owner, minlength=len(left))
            if len(owner):
                total = np.stack([np.bincount(owner, self.tables[n][1][at, k], minlength=len(left)) for k in range(len(self.langs))], 1)
                hit = seen > 0
                value[left[hit]] = total[hit] / seen[hit, None]
                left = left[~hit]
        doc = letters.doc()
        out = np.zeros((len(letters.first) - 1, len(self.langs) + 1))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(doc, value[inverse, k], minlength=len(out))
        out[:, -1] = np.diff(letters.first)
        return out

    def predict(self, letters: Letters) -> tuple[list[str], np.ndarray]:
        out = self.scores(letters)
        words = out[:, -1]
        if not self.langs:
            return ["und"] * len(out), np.zeros(len(out))
        score = out[:, :-1] / np.maximum(words, 1)[:, None] * np.minimum(words, EVIDENCE)[:, None]
        score = np.exp(score - score.max(1, keepdims=True))
        score /= score.sum(1, keepdims=True)
        best = score.argmax(1)
        lang = [self.langs[b] if w else "und" for b, w in zip(best, words, strict=True)]
        return lang, np.where(words > 0, score[np.arange(len(best)), best], 0.0)


def train(rows: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model from ``rows`` (doc_id, text, lang); rows with a null text or lang teach nothing.

    One task fits the model, as the sample is bounded, and only the model comes back.
    """
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    # first the ids alone, so that only the texts of the sample are read into the sort
    order = F.xxhash64("doc_id"), F.col("doc_id")
    taken = rows.select("doc_id").orderBy(*order).limit(sample).distinct()
    # a doc_id that repeats gives one row, by the hash of its text
    found = rows.join(F.broadcast(taken), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("row"))
    found = within_bytes(found.select("doc_id", "row.*"), order)

    def fit(table: pa.Table) -> LanguageModel:
        return LanguageModel(table["text"].to_pylist(), table["lang"].to_pylist())

    return fitted(found.select("doc_id", "text", "lang"), fit)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score = model.predict(Letters(part["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidy(step), "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of ids that no training may see; null ids are never held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 4 == 2, F.lit(False))
