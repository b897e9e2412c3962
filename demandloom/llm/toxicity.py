"""Toxicity by a classifier chain.

Categories are predicted one after the other. A linear model sees the words of a
text and the probabilities of the categories before it. In training these come
out of fold (from models that have not seen the text), so that later models
learn how far earlier ones can be trusted; the models used afterwards are fitted
on all sampled rows.

No table labels kinds of toxicity, so the earlier categories come from the label of the
last one, in any language: features that stand in toxic texts more often than in others,
``SURE`` standard deviations above even, are dealt into as many groups, and a toxic text
that holds a feature of a group is an example of it. What marks is found anew in the
training rows of each fold.

The chain is fitted on at most ``SAMPLE_ROWS`` labelled rows, taken by the hash of their
id. Features are the words and the beginnings of words (``STEMS`` characters, so that other
endings of a word count) that stand in ``LEAST_TEXTS`` sampled texts at least. A feature
weighs in by the log ratio of its frequency in positive and other texts. Every
text of the corpus is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from demandloom.llm.common import slices

SAMPLE_ROWS = 6000
LEAST_TEXTS = 5
STEMS = (4, 5, 6)
FOLDS = 3
STEPS = 60
RIDGE = 2.0
_WORD = re.compile(r"[^\W\d_]+")

# Before the last category stand groups of the features that mark toxic texts in the labels.
# A feature's group is its hash modulo their number, so it is the same in every fold.
GROUPS = ("insult", "contempt", "mockery")
SURE = 3.0
TOXIC = "toxic"


def features(words: Iterable[str]) -> np.ndarray:
    """Sorted 64-bit hashes of different words, and of their stems with a star."""
    words = {word.lower() for word in words}
    stems = {word[:size] + "*" for size in STEMS for word in words if len(word) > size}
    return np.array(sorted(map(xxh3_64_intdigest, words | stems)), dtype=np.uint64)


def features_of(text: str | None) -> np.ndarray:
    return features(_WORD.findall(text) if text else ())


class Rows:
    """Numbers of the known features of texts, one text after the other. ``known`` is sorted."""

    def __init__(self, texts: list[np.ndarray], known: np.ndarray):
        self.n = len(texts)
        row = np.repeat(np.arange(self.n), [len(text) for text in texts])
        every = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint64)
        at = np.searchsorted(known, every)
        found = known[np.minimum(at, len(known) - 1)] == every if len(known) else np.zeros(len(every), dtype=bool)
        self.word, self.row = at[found], row[found]

    def take(self, chosen: np.ndarray) -> Rows:
        part = object.__new__(Rows)
        keep = chosen[self.row] if self.n else np.zeros(0, dtype=bool)
        part.n, part.word = int(chosen.sum()), self.word[keep]
        part.row = (np.cumsum(chosen) - 1)[self.row[keep]]
        return part


class Linear:
    """Logistic regression on words, each scaled by its log ratio, and on further columns."""

    def __init__(self, n_words: int, n_more: int):
        self.word = np.zeros(n_words)
        self.more = np.zeros(n_more)
        self.bias = 0.0

    def predict(self, rows: Rows, more: np.ndarray) -> np.ndarray:
        odds = self.bias + more @ self.more + np.bincount(rows.row, weights=self.word[rows.word], minlength=rows.n)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def fit(self, rows: Rows, more: np.ndarray, label: np.ndarray) -> Linear:
        """Gradient steps, each scaled by the weight's own past gradients; ridge on the scaled words."""
        if not rows.n:
            return self
        n = len(self.word)
        positive = np.bincount(rows.word, weights=label[rows.row], minlength=n) + 0.5
        other = np.bincount(rows.word, minlength=n) + 1 - positive
        scale = np.log(positive / (label.sum() + 1)) - np.log(other / (len(label) - label.sum() + 1))
        share = (label.sum() + 0.5) / (len(label) + 1)
        self.bias = float(np.log(share / (1 - share)))
        weight = np.zeros(n)
        past = [np.full_like(weight, 1e-8), np.full_like(self.more, 1e-8), 1e-8]
        for _ in range(STEPS):
            wrong = self.predict(rows, more) - label
            slopes = [
                np.bincount(rows.word, weights=wrong[rows.row], minlength=n) * scale + RIDGE * weight,
                more.T @ wrong + 0.1 * self.more,
                wrong.sum(),
            ]
            past = [p + s * s for p, s in zip(past, slopes)]
            steps = [0.5 * s / np.sqrt(p) for s, p in zip(slopes, past)]
            weight -= steps[0]
            self.more -= steps[1]
            self.bias -= steps[2]
            self.word = weight * scale
        return self


class Chain:
    """``models[i]`` predicts ``categories[i]`` from the known features and the probabilities before it."""

    def __init__(self, categories: list[str], known: np.ndarray, models: list[Linear]):
        self.categories, self.known, self.models = categories, known, models

    def predict(self, texts: list[np.ndarray]) -> np.ndarray:
        rows = Rows(texts, self.known)
        chances = np.zeros((rows.n, 0))
        for model in self.models:
            chances = np.column_stack([chances, model.predict(rows, chances)])
        return chances


def marked(group: int, toxic: np.ndarray) -> Callable[[Rows, np.ndarray, np.ndarray], np.ndarray]:
    """The label of ``GROUPS[group]``: for chosen rows, which are toxic and hold one of its marking features."""

    def label(rows: Rows, known: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        own, n = toxic[chosen], len(known)
        holds = own[rows.row] > 0
        positive = np.bincount(rows.word[holds], minlength=n) + 0.5
        other = np.bincount(rows.word[~holds], minlength=n) + 0.5
        ratio = np.log(positive / (own.sum() + 1)) - np.log(other / (rows.n - own.sum() + 1))
        marks = (ratio > SURE * np.sqrt(1 / positive + 1 / other)) & (known % np.uint64(len(GROUPS)) == group)
        found = np.zeros(rows.n)
        found[rows.row[holds & marks[rows.word]]] = 1
        return found

    return label


def fit_chain(
    texts: list[np.ndarray],
    labels: dict[str, np.ndarray | Callable[[Rows, np.ndarray, np.ndarray], np.ndarray]],
    folds: int = FOLDS,
    least_texts: int = LEAST_TEXTS,
) -> Chain:
    """The chain over ``labels``, in their order, from the features of texts. Rows of equal number
    modulo ``folds`` are a fold. A label that is a function is made from the rows trained on.
    """
    every = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint64)
    known, n = np.unique(every, return_counts=True)
    known = known[n >= least_texts]
    del every
    rows = Rows(texts, known)
    fold = np.arange(rows.n) % folds
    chances, models = np.zeros((rows.n, 0)), []

    def fitted(label, chosen: np.ndarray) -> Linear:
        own = rows.take(chosen)
        target = label(own, known, chosen) if callable(label) else label[chosen]
        return Linear(len(known), chances.shape[1]).fit(own, chances[chosen], target)

    for place, label in enumerate(labels.values(), 1):
        unseen = np.zeros(rows.n)
        for k in range(folds if place < len(labels) else 0):  # nothing follows the last category
            train, test = fold != k, fold == k
            part = fitted(label, train)
            unseen[test] = part.predict(rows.take(test), chances[test])
        models.append(fitted(label, np.ones(rows.n, dtype=bool)))
        chances = np.column_stack([chances, unseen])
    return Chain(list(labels), known, models)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """``(doc_id, toxic, features)`` of at most ``sample_rows`` ids that have a label and a text, a row for each.

    Of several texts of an id the first in the alphabet is taken.
    """
    named = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .join(named.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            packed = [features_of(text).tobytes() for text in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "features"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = named.join(F.broadcast(chosen), "doc_id")  # bounded
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), F.min("text").alias("text"))
    return rows.mapInArrow(
        each, f"doc_id {kind}, toxic int, features binary"
    )


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> Chain:
    """The chain insult, contempt, mockery, toxic from ``labels(doc_id, toxic)`` and the texts of ``docs``.

    Rows with a null id, label or text teach nothing; of several labels of an id the
    highest holds. Without any label every text has probability 0.5.
    """
    # at most sample_rows rows, one for each id, of 8 bytes a feature
    sample = labelled_sample(docs, labels, sample_rows).collect()
    sample.sort(key=lambda row: (str(row["doc_id"]), bytes(row["features"])))
    toxic = np.array([row["toxic"] > 0 for row in sample], dtype=float)
    texts = [np.frombuffer(row["features"], dtype=np.uint64) for row in sample]
    marks = {name: marked(group, toxic) for group, name in enumerate(GROUPS)}
    return fit_chain(texts, {**marks, TOXIC: toxic}, folds)


def predict_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``p_<category>`` for every category, for every row of ``docs``.

    Null and empty texts are scored as texts without words. Null ids and repeated rows
    stay, an empty table gives an empty table, and further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # features of the bounded sample
    names = [f"p_{category}" for category in chain.categories]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            scores = shared.value.predict([features_of(text) for text in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(scores[:, i]) for i in range(len(names)))], names=["doc_id", *names]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"{name} double" for name in names)
    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}")
