"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another; each linear model sees, besides the
words of the document, the probabilities of the categories before it. For training those
probabilities come out of fold: a document's comes from a model that was fitted
without its fold, so later models learn how far earlier ones can be relied on. For
scoring they come from the models fitted on all folds.

The query's chain is low_quality (``labels.quality`` = 0), then toxic
(``labels.toxic``), the categories that the tables label; ``fit`` takes any list.

A document's features are its lower-cased runs of letters and their beginnings, hashed
to ``DIMENSIONS`` places; a place counts once. Training uses at most ``SAMPLE`` labelled documents, those with the least
hash of doc_id and at most ``MOST_PLACES`` places together: documented bounds. Of a
word's places, those that do not tell the classes apart (``LEAST_Z`` standard errors) or
occur in fewer than ``LEAST_DOCUMENTS`` fitted documents have no weight. Training goes on
until the gradient vanishes (``STILL``). All documents are scored.

Scale: one pass with a broadcast of DIMENSIONS weights for each category; the labelled
sample (place numbers, not texts, 160 MB at most) is all that reaches the driver.

Defined results: null text has no words and is scored by the intercepts; null doc_id is
an id like any other and is never labelled; repeated rows are scored each, alike;
labels that repeat count once, by their largest values; of rows that share a labelled
doc_id the one whose text has the least hash is fitted; without both kinds of label a
category is constant; a very long text is one row's set of places; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

SAMPLE = 12_000
DIMENSIONS = 1 << 18
FOLDS = 5
#: Letters of the beginnings of words that count as features too: they carry over to
#: forms that training has not seen.
STEMS = (4, 5)
#: Training documents that have a word, at least, for it to count.
LEAST_DOCUMENTS = 3
#: Standard errors by which a word's share must differ between classes for it to count.
LEAST_Z = 4.0
PENALTY = 0.005
#: Training ends where no part of the gradient exceeds this much of the documents' number.
STILL = 1e-6
#: Steps and gradients that the approximation of the curvature looks back on.
HISTORY = 10
#: Places of all fitted documents together, at most.
MOST_PLACES = 40_000_000
_LETTERS = re.compile(r"[^\W\d_]+")
_REMEMBERED = 500_000


def place(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "replace")) % DIMENSIONS


class Places:
    """Distinct hashed places of the words of a text and of their beginnings."""

    def __init__(self) -> None:
        self.of: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = set((text or "").lower().split())
        of = self.of
        out: set[int] = set()
        for w in words:
            p = of.get(w)
            if p is None:
                if len(of) > _REMEMBERED:
                    of.clear()
                p = of[w] = tuple({place(x) for run in _LETTERS.findall(w) for x in (run, *(f"{run[:n]}-" for n in STEMS if len(run) > n))})
            out.update(p)
        return np.fromiter(out, dtype=np.int64, count=len(out))


@dataclass
class Model:
    """Weights of a category: of words, of the categories before it, and a constant."""

    words: np.ndarray
    chain: np.ndarray
    constant: float

    def logit(self, places: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        sizes = np.array([len(p) for p in places])
        values = self.words[np.concatenate(places)] if sizes.sum() else np.zeros(0)
        own = np.bincount(np.repeat(np.arange(len(places)), sizes), values, minlength=len(places))
        return own + before @ self.chain + self.constant


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, still: float) -> np.ndarray:
    """Where a convex ``loss`` (value, gradient) is least: limited-memory quasi-Newton
    steps, halved until the value falls enough, until no part of the gradient is over
    ``still`` or no step lowers the value any more."""
    value, grad = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while np.abs(grad).max() > still:
        way, parts = -grad, []
        for s, y in reversed(steps):
            a = (s @ way) / (s @ y)
            way = way - a * y
            parts.append(a)
        way = way * ((steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(grad).sum()))
        for (s, y), a in zip(steps, reversed(parts)):
            way = way + (a - (y @ way) / (s @ y)) * s
        slope, size = float(grad @ way), 1.0
        while True:
            there, its = loss(x + size * way)
            if there <= value + 1e-4 * size * slope:
                break
            size /= 2
            if size < 1e-12:  # as low as numbers go
                return x
        s, y = size * way, its - grad
        x, value, grad = x + s, there, its
        if s @ y > 0:
            steps = [*steps[1 - HISTORY :], (s, y)]
    return x


def train(places: list[np.ndarray], before: np.ndarray, labels: np.ndarray) -> Model:
    """L2-penalised logistic regression, minimised until it is still."""
    n, chain = len(labels), before.shape[1]
    words = np.zeros(DIMENSIONS)
    if n == 0 or labels.min() == labels.max():
        return Model(words, np.zeros(chain), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1))))
    flat = np.concatenate(places)
    own = np.repeat(np.arange(n), [len(p) for p in places])
    seen = np.bincount(flat, minlength=DIMENSIONS)
    # Each word's value is how far its share differs between the classes, beyond chance;
    # else the many words of long documents that tell nothing would drown the few that do.
    positive = np.bincount(flat, labels[own].astype(float), minlength=DIMENSIONS)
    n1 = labels.sum()
    one, two, all_of = positive / n1, (seen - positive) / (n - n1), np.maximum(seen, 1) / n
    z = (one - two) / np.sqrt(all_of * np.maximum(1 - all_of, 0.5 / n) * (1 / n1 + 1 / (n - n1)))
    value = np.sign(z) * np.maximum(np.abs(z) - LEAST_Z, 0) * (seen >= LEAST_DOCUMENTS)
    used = np.flatnonzero(value)
    value = value / max(1.0, np.abs(value).max(initial=0.0))
    keep = value[flat] != 0
    number = np.zeros(DIMENSIONS, dtype=np.int64)
    number[used] = np.arange(len(used))
    worth = value[flat[keep]]
    flat, own = number[flat[keep]], own[keep]
    theta = np.zeros(len(used) + chain + 1)
    theta[-1] = np.log(labels.mean() / (1 - labels.mean()))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, c = x[: len(used)], x[len(used) : -1]
        z = np.bincount(own, w[flat] * worth, minlength=n) + before @ c + x[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        grad = np.concatenate([np.bincount(flat, error[own] * worth, minlength=len(used)), error @ before, [error.sum()]])
        grad[:-1] += PENALTY * x[:-1]
        return float((np.logaddexp(0, z) - labels * z).sum() + PENALTY / 2 * (x[:-1] @ x[:-1])), grad

    theta = minimise(loss, theta, STILL * n)
    words[used] = theta[: len(used)] * value[used]
    return Model(words, theta[len(used) : -1], float(theta[-1]))


def fit(places: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Model]:
    """The chain's models; ``labels`` is [document, category], in the chain's order."""
    models, before = [], np.zeros((len(places), 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(train(places, before, y))
        if k + 1 < labels.shape[1]:
            out = np.zeros(len(places))
            for f in range(FOLDS):
                test, rest = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
                if len(test):
                    out[test] = _sigmoid(train([places[i] for i in rest], before[rest], y[rest]).logit([places[i] for i in test], before[test]))
            before = np.column_stack([before, out])
    return models


def predict(models: list[Model], places: list[np.ndarray]) -> np.ndarray:
    """Probabilities [document, category]."""
    before = np.zeros((len(places), 0))
    for m in models:
        before = np.column_stack([before, _sigmoid(m.logit(places, before))])
    return before


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> DataFrame:
    """doc_id and p_<category> for each row of ``docs`` (doc_id, text).

    ``categories``: conditions on the columns of ``labels`` (doc_id, ...), in the
    order of the chain.
    """
    spark = docs.sparkSession
    names = list(categories)
    given = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in categories.items()))
    chosen = given.withColumn("order", F.xxhash64(F.col("doc_id").cast("long"))).orderBy("order", "doc_id").limit(sample)
    # at most ``sample`` ids, so of proven size
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "order", "text", *names)

    def as_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Places()
        for b in batches:
            found = [of(t) for t in b["text"].to_pylist()]
            sizes, packed = pa.array([len(p) for p in found], pa.int64()), pa.array([np.sort(p).astype("<i4").tobytes() for p in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b["order"], b["own"], *(b[n] for n in names), sizes, packed], ["order", "own", *names, "size", "places"])

    rows = texts.select("order", F.xxhash64("text").alias("own"), "text", *names).mapInArrow(as_places, "order long, own long, " + "".join(f"`{n}` int, " for n in names) + "size long, places binary")
    one = materialize(rows.groupBy("order").agg(*(F.min_by(n, "own").alias(n) for n in (*names, "size", "places"))), "places")
    room = np.array(sorted((r["order"], r["size"]) for r in one.select("order", "size").collect()), dtype=np.int64).reshape(-1, 2)  # at most ``sample`` rows
    fits = np.cumsum(room[:, 1]) <= MOST_PLACES
    last = int(room[fits, 0].max()) if fits.any() else -(1 << 63)
    t = one.where(F.col("order") <= last).toArrow().sort_by("order")
    release(one)
    places = [np.frombuffer(p, "<i4").astype(np.int64) for p in t["places"].to_pylist()]
    y = np.column_stack([t[n].to_numpy() for n in names]).reshape(-1, len(names))
    order = t["order"].to_numpy()
    del t
    models = spark.sparkContext.broadcast(fit(places, y, np.mod(order, FOLDS)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Places()
        for b in batches:
            p = predict(models.value, [of(x) for x in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(p[:, k]) for k in range(len(names)))], ["doc_id", *(f"p_{n}" for n in names)])

    schema = "doc_id long" + "".join(f", `p_{n}` double" for n in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, schema)
