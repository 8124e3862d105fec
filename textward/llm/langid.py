"""Language identification: words first, then shorter and shorter character n-grams.

A word that any language knows is scored by its log relative frequency in each
language.  For any other word the longest n-grams decide of which one language
at least knows one; the word's score is the mean over its known n-grams.  A
text's score is the mean over its words, and the least penalty wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import salted_join
from .common import missing_columns

#: letters only; longer runs (scripts without blanks) are taken in pieces
LETTERS = re.compile(r"[^\W\d_]{1,40}")
UNKNOWN = "und"
_CHUNK = 100_000
#: words of texts that are scored together
_GROUP = 30_000


@dataclass(frozen=True)
class Settings:
    """`max_docs`: documents per language to learn from, in expectation (drawn by a hash of the id), which bounds the model:
    it holds every word and n-gram of theirs.  `longest`: characters of the longest n-gram.  `penalty`: cost of a feature that a language lacks."""

    max_docs: int = 1000
    longest: int = 6
    penalty: float = 7.0


def words_of(text: str | None) -> list[str]:
    """Lower-case words; empty where the text has no letter (signs such as superscript digits are none)."""
    found = LETTERS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def grams_of(word: str, n: int) -> list[str]:
    """Runs of n characters, with a blank before and after the word (which alone is no evidence)."""
    padded = f" {word} " if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def hashed(grams, n: int) -> np.ndarray:
    """A number of 64 bits for each word (n = 0) or n-gram: the model keeps these instead of texts."""
    return np.fromiter((xxhash.xxh3_64_intdigest(g, n) for g in grams), np.uint64, len(grams))


def _counts(longest: int):
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("gram", pa.int64()), ("c", pa.int64())])

    def emit(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            for n in range(longest + 1):
                grams: Counter = words
                if n:
                    grams = Counter()
                    for word, c in words.items():
                        for g in grams_of(word, n):
                            grams[g] += c
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang] * len(grams), "n": [n] * len(grams), "gram": hashed(grams, n).view(np.int64), "c": list(grams.values())}, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = counts.setdefault(lang, Counter())
                before = len(words)
                words.update(words_of(text))
                held += len(words) - before
                if held > 300_000:  # bounds the worker's memory; the sums follow after the shuffle
                    yield from emit(counts)
                    counts, held = {}, 0
        yield from emit(counts)

    return count


@dataclass
class Model:
    """`features[n]`: sorted hashes of words (n = 0) or n-grams; `penalties[n]`: a row for each, with a column per language."""

    langs: list[str]
    features: list[np.ndarray]
    penalties: list[np.ndarray]

    def known(self, grams: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each gram is known, and the penalties of those that are."""
        h, names = hashed(grams, n), self.features[n]
        if not len(names):
            return np.zeros(len(h), bool), self.penalties[n]
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        found = names[at] == h
        return found, self.penalties[n][at[found]]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Learn from the rows of `docs` with text and language.

    Where a language has more than `max_docs` rows, a share of them is drawn by
    hash of `sample_key`, with which all rows of one key stay together; whole
    texts are read.  NULL texts or languages teach nothing; an empty table gives
    a model without languages.
    """
    missing_columns(docs, text, lang, sample_key)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(sample_key)).alias("h"))
    shares = rows.groupBy("lang").agg((F.ceil(F.lit(1_000_000 * settings.max_docs) / F.count("*"))).alias("per_million"))
    drawn = salted_join(rows, shares, ["lang"], "inner").where(F.pmod(F.col("h"), F.lit(1_000_000)) < F.col("per_million"))
    langs = sorted(r["lang"] for r in shares.select("lang").collect())
    if not langs:
        return Model([], [np.zeros(0, np.uint64)] * (settings.longest + 1), [np.zeros((0, 0), np.float32)] * (settings.longest + 1))
    numbers = docs.sparkSession.createDataFrame(list(enumerate(langs)), "i int, lang string")
    counts = (drawn.select("lang", "text")
              .mapInArrow(_counts(settings.longest), "lang string, n int, gram long, c long")
              .groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")).join(numbers, "lang").select("i", "n", "gram", "c"))
    i, n, gram, c = (x.to_numpy() for x in counts.toArrow().columns)  # numbers only, bounded by the documents drawn
    features: list[np.ndarray] = []
    penalties: list[np.ndarray] = []
    for order in range(settings.longest + 1):
        here = n == order
        names, row = np.unique(gram[here].view(np.uint64), return_inverse=True)
        cost = np.full((len(names), len(langs)), settings.penalty, np.float32)
        total = np.bincount(i[here], c[here], len(langs))
        cost[row, i[here]] = np.minimum(settings.penalty, -np.log10(c[here] / total[i[here]]))
        features.append(names)
        penalties.append(cost)
    return Model(langs, features, penalties)


class _Rows:
    """Word to its row of `cost`.  Words get a row when first asked for; the table starts anew when it is full."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.cost = np.zeros((4 * _CHUNK, len(model.langs)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        """Rows of at most _CHUNK words."""
        try:
            return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        except KeyError:
            pass
        if len(self.index) + len(words) > len(self.cost):
            self.index = {}
        new = list(set(words).difference(self.index))
        known, cost = self.model.known(new, 0)
        rows = np.zeros((len(new), len(self.model.langs)), np.float32)
        rows[known] = cost
        unseen = np.flatnonzero(~known)
        rows[unseen] = backoff(self.model, [new[k] for k in unseen])
        first = len(self.index)
        self.cost[first:first + len(new)] = rows
        self.index.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def backoff(model: Model, words: list[str]) -> np.ndarray:
    """For each word the mean penalties of its known n-grams, of the largest n that has any; 0 for all languages where none has."""
    out = np.zeros((len(words), len(model.langs)), np.float32)
    todo = np.arange(len(words))
    for n in range(len(model.features) - 1, 0, -1):
        grams = [grams_of(words[k], n) for k in todo]
        owner = np.repeat(np.arange(len(todo)), [len(g) for g in grams])
        known, cost = model.known([x for g in grams for x in g], n)
        owner = owner[known]
        count = np.bincount(owner, minlength=len(todo))
        done = count > 0
        if done.any():  # grams stand in the order of their words
            n_known = count[done]
            first = np.concatenate(([0], np.cumsum(n_known)[:-1]))
            out[todo[done]] = np.add.reduceat(cost, first, axis=0, dtype=np.float64) / n_known[:, None]
        todo = todo[~done]
        if not len(todo):
            break
    return out


def predictions(model: Model, texts, rows: _Rows | None = None) -> tuple[list[str], list[float]]:
    rows = rows if rows is not None else _Rows(model)
    langs, scores = [], []
    held, n = [], 0

    def score() -> None:
        # words that are new are scored for many texts at once
        fresh = {w for words in held if len(words) <= _GROUP for w in words}
        if fresh and model.langs:
            rows.of(list(fresh))
        for words in held:
            if not words or not model.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            cost = np.zeros(len(model.langs))
            for at in range(0, len(words), _CHUNK):
                cost += rows.cost[rows.of(words[at:at + _CHUNK])].sum(0, dtype=np.float64)
            cost /= len(words)
            best = int(cost.argmin())  # of equals, the first in the order of names
            langs.append(model.langs[best])
            scores.append(float(1 / (10.0 ** (cost[best] - cost)).sum()))

    for text in texts:
        held.append(words_of(text))
        n += len(held[-1])
        if n >= _GROUP:
            score()
            held, n = [], 0
    score()
    return langs, scores


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct column (lang_pred, score).  Text that is NULL or has no letter gives `und` and 0."""
    missing_columns(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = _Rows(shared.value)
        for texts in batches:
            langs, scores = predictions(shared.value, texts, rows)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return tell(F.col(text))
