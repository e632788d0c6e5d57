"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from portolan.llm.common import map_arrow, ship, written

BUCKETS = 1 << 17
FACTORS = 8
MOST_ROWS = 20_000          # labelled rows that a model is fitted on, at most
MOST_TERMS = 1 << 24        # and terms of theirs in all
LEAST_DOCS = 4              # a term needs as many of those rows to be learned from
LEAST_Z = 5.0               # and, for a weight of its own, a share of label 1 so many deviations off
EPOCHS = 40                 # for the weights, and at most as many for the factors
PATIENCE = 15               # epochs without a gain on the rows kept back
KEPT_BACK = 8               # every so manyth row
RATE, FACTOR_RATE = 0.2, 0.7
DECAY, FACTOR_DECAY = 1e-4, 5e-3  # per row
FACTOR_START = 0.05
BATCH = 256
SEED = 11
FOLDS, HELD_OUT_FOLD = 5, 0
CACHED_TERMS = 200_000

_TERM = re.compile(r"[^\W_]+")

# Terms

class _Buckets(dict):
    def __missing__(self, term: str) -> int:
        bucket = zlib.crc32(term.encode()) % BUCKETS
        if len(self) < CACHED_TERMS:
            self[term] = bucket
        return bucket


@functools.lru_cache(maxsize=1)
def _buckets() -> _Buckets:
    """One per worker process."""
    return _Buckets()


def terms(text: str) -> np.ndarray:
    """The distinct buckets of a text's lower-case words, whatever its length."""
    words = set(_TERM.findall(text.lower()))
    return np.unique(np.fromiter(map(_buckets().__getitem__, words), np.int32, len(words)))


# The model

@dataclass(frozen=True)
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum over pairs i < j of v_i . v_j) over the terms
    i of a text. A pair's weight comes from the factors of its terms, so it is known
    for pairs that no training text holds."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        summed = self.factors[found].sum(axis=0, dtype=np.float64)
        own = np.square(self.factors[found], dtype=np.float64).sum()
        raw = self.bias + self.weights[found].sum(dtype=np.float64) + (summed @ summed - own) / 2
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def fit(texts: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
    """Mini-batch AdaGrad on the log loss, the same on every run.

    `texts` are the terms of each row, at most `MOST_ROWS`. Without rows, or with one
    label only, the model gives the rows' share of label 1 (a half without rows).
    """
    labels = np.asarray(labels, np.float64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(share / (1 - share)))
    weights, factors = np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS))
    if len(labels) and 0 < labels.sum() < len(labels):
        bias = _train(texts, labels, bias, weights, factors)
    return FactorizationMachine(bias, weights.astype(np.float32), factors.astype(np.float32))


class _Rows:
    """The terms of training rows, as places among the terms that are learned."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.rows, self.labels = rows, labels

    def batch(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, term, label) of some rows."""
        sizes = [len(self.rows[i]) for i in which]
        return (np.repeat(np.arange(len(which)), sizes),
                np.concatenate([self.rows[i] for i in which]), self.labels[which])


def _raw(owner, term, n, bias, w, v) -> tuple[np.ndarray, np.ndarray]:
    """The score before the sigmoid, and the sums of the factors, of n rows."""
    summed = np.stack([np.bincount(owner, v[term, k], n) for k in range(v.shape[1])], axis=1)
    own = np.bincount(owner, np.square(v[term]).sum(axis=1), n)
    return bias + np.bincount(owner, w[term], n) + (np.square(summed).sum(axis=1) - own) / 2, summed


def _chance(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _loss(rows: _Rows, which: np.ndarray, bias, w, v) -> float:
    lost = 0.0
    for at in range(0, len(which), BATCH):  # as few at a time as in training
        owner, term, label = rows.batch(which[at:at + BATCH])
        chance = np.clip(_chance(_raw(owner, term, len(label), bias, w, v)[0]), 1e-9, 1 - 1e-9)
        lost -= float((label * np.log(chance) + (1 - label) * np.log(1 - chance)).sum())
    return lost / len(which)


def _train(texts, labels, bias, weights, factors) -> float:
    """Weights first, then factors on what the weights leave unexplained.

    A weight is a term's own, so only terms that tell something alone get one; every term
    with `LEAST_DOCS` rows has factors, whatever it tells alone, since a pair may tell what
    neither of its terms does. What overfits is kept down by decay, by steps that are
    small until gradients agree, and by a stop: the factors are those that did best on
    the rows kept back, none at all if none did better than the weights.
    """
    random = np.random.default_rng(SEED)
    first = {hashlib.blake2b(t.tobytes(), digest_size=16).digest(): i
             for i, t in reversed(list(enumerate(texts)))}  # copies count once
    texts, labels = [texts[i] for i in sorted(first.values())], labels[sorted(first.values())]
    sizes, term = [len(t) for t in texts], np.concatenate(texts)
    seen = np.bincount(term, minlength=BUCKETS)
    ones = np.bincount(term, np.repeat(labels.astype(np.float32), sizes), BUCKETS)
    known = np.flatnonzero(seen >= LEAST_DOCS)
    place = np.full(BUCKETS, -1, np.int32)
    place[known] = np.arange(len(known))
    rows = _Rows([p[p >= 0] for p in (place[t] for t in texts)], labels)
    n = len(texts)
    alone = _tells(seen, ones, labels.mean())[known]
    del texts, term  # the rows hold what is learned from
    w, v = np.zeros(len(known)), np.zeros((len(known), FACTORS))
    w_sq, b_sq = np.full(len(known), 1e-8), 1e-8
    kept_back = np.arange(0, n, KEPT_BACK)
    learned = np.setdiff1d(np.arange(n), kept_back)
    if not len(learned):
        return bias

    def batches() -> Iterator[np.ndarray]:
        order = random.permutation(learned)
        return (order[at:at + BATCH] for at in range(0, len(order), BATCH))

    for _ in range(EPOCHS):
        for batch in batches():
            owner, term, label = rows.batch(batch)
            here, local = np.unique(term, return_inverse=True)
            error = _chance(bias + np.bincount(owner, w[term], len(batch))) - label
            b_sq += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(b_sq)
            grad = alone[here] * (np.bincount(local, error[owner], len(here))
                                  + DECAY * len(batch) * w[here])
            w_sq[here] += grad * grad
            w[here] -= RATE * grad / np.sqrt(w_sq[here])

    best, since = (_loss(rows, kept_back, bias, w, v), bias, v.copy()), 0
    v = random.normal(0, FACTOR_START, v.shape)
    v_sq = np.ones(len(known))
    for _ in range(EPOCHS):
        for batch in batches():
            owner, term, label = rows.batch(batch)
            here, local = np.unique(term, return_inverse=True)
            raw, summed = _raw(owner, term, len(batch), bias, w, v)
            error = _chance(raw) - label
            b_sq += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(b_sq)
            pull = error[owner][:, None] * (summed[owner] - v[term])
            grad = np.stack([np.bincount(local, pull[:, k], len(here)) for k in range(FACTORS)], axis=1)
            grad = grad + FACTOR_DECAY * len(batch) * v[here]
            v_sq[here] += np.square(grad).sum(axis=1)
            v[here] -= FACTOR_RATE * grad / np.sqrt(v_sq[here])[:, None]
        loss = _loss(rows, kept_back, bias, w, v)
        if loss < best[0] - 1e-5:
            best, since = (loss, bias, v.copy()), 0
        else:
            since += 1
            if since == PATIENCE:
                break
    weights[known], factors[known] = w, best[2]
    return float(best[1])


def _tells(seen: np.ndarray, ones: np.ndarray, share: float) -> np.ndarray:
    """Whether a term's rows differ in label from the others by more than chance. A rare
    word of one long text would only be learned by heart."""
    z = np.abs(ones - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    return z >= LEAST_Z


# Spark

def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned from. A NULL id is held out."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(doc_id, terms, label) of at most `most` labelled documents that are not held out.

    Which ones is settled on the labels alone, by hash of the id; that list is bounded
    by `most`, so it is broadcast and no text is shuffled.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("_doc_id"), F.col("toxic").alias("_toxic"))
        .where(F.col("_toxic").isin(0, 1) & ~held_out(F.col("_doc_id")))
        .groupBy("_doc_id").agg(F.max("_toxic").alias("label"))
        .orderBy(F.xxhash64("_doc_id"), "_doc_id").limit(most)
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(found, pa.list_(pa.int32())), batch["label"]],
                names=["doc_id", "terms", "label"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc_id")).select(
        "doc_id", "text", F.col("label").cast("int").alias("label"))
    return map_arrow(joined, work, "doc_id bigint, terms array<int>, label int")


def bounded_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS,
                   most_terms: int = MOST_TERMS) -> DataFrame:
    """(terms, label) of at most `most` rows of `training_rows`, those with the smallest ids
    whose terms are `most_terms` together: one partition, in the order of the ids."""
    rows = written(training_rows(docs, labels, most).withColumn(
        "order", F.struct("doc_id", F.xxhash64("terms"))).orderBy("order").limit(most), "training")
    running = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("until", F.sum(F.size("terms")).over(running)).where(
        F.col("until") <= most_terms).select("terms", "label")


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS,
          most_terms: int = MOST_TERMS) -> FactorizationMachine:
    """A model fitted on the `bounded_sample`, by one task: the driver gets the model alone,
    which has a fixed size, and a lost executor costs a task. A document that occurs several
    times is learned from once per occurrence. Of an id's labels the largest counts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[np.ndarray] = []
        known: list[int] = []
        for batch in batches:
            if batch.num_rows:
                ends = batch["terms"].offsets.to_numpy()
                texts += np.split(batch["terms"].values.to_numpy()[ends[0]:ends[-1]], ends[1:-1] - ends[0])
                known += batch["label"].to_pylist()
        model = fit(texts, np.array(known))
        yield pa.RecordBatch.from_pydict({
            "bias": [model.bias], "weights": [model.weights.tobytes()],
            "factors": [model.factors.tobytes()]})

    found = map_arrow(bounded_sample(docs, labels, most, most_terms), work,
                      "bias double, weights binary, factors binary").collect()
    if not found:  # Spark skips the task where it knows that there are no rows
        return fit([], np.array([]))
    bias, weights, factors = found[0]
    return FactorizationMachine(bias, np.frombuffer(weights, np.float32),
                                np.frombuffer(factors, np.float32).reshape(BUCKETS, FACTORS))


def score_of(model: FactorizationMachine, spark: SparkSession) -> Callable[[Column], Column]:
    """The model as a function on text columns. It has a fixed size and is broadcast;
    a task holds one batch of texts, other columns do not leave the JVM."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(terms(t.as_py() or "")) for t in texts], pa.float64())

    return score


def score_documents(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row: narrow, one pass, whole texts.

    A NULL or empty text has no terms and the score of the bias. Repeated rows are
    scored each; other columns, and so labels, language and source, are not read.
    """
    doc_id = F.col("doc_id").cast("bigint")
    scored = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"),
                         score_of(model, docs.sparkSession)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, model: FactorizationMachine, most: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `most`, all columns, in one pass."""
    return docs.where(score_of(model, docs.sparkSession)(F.col("text")) < most)
