"""Toxicity scores from a character n-gram linear classifier with naive Bayes feature scaling.

Features are the character n-grams (``GRAMS`` code points of the lower-cased text) that occur in a text, hashed to 2**``BITS``
places; every character of the text counts, a feature once per text. Training follows NBSVM: the log-count ratio of each feature
between toxic and other texts scales it, and a logistic regression with an L2 penalty is fitted over the scaled
features, in numpy, by seeded mini-batches. Every place has a weight; ratios that the sample hardly bears out (few rows, or a
small ratio: ``SURE``) are shrunk smoothly. Folding the ratio into the weight leaves one number per
place, 4 MB that go to the executors whatever the corpus.

The classifier is fitted on a bounded sample of labelled rows: at most about ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` other ones,
drawn by a hash of the id, and of these, in the order of the hash, as many as have ``MAX_PLACES`` features together. Texts
become features where they are read; the fit is one task, and the driver gets the weights alone. Scoring is one Arrow pass over
the text column; rows aren't shuffled.

Defined results: null and empty texts get the score of no features; labels that are null don't count, of repeated labels the
largest counts; of texts that repeat a labelled id the smallest is learned from; without labels of both kinds the score is the
share of toxic labels (0 without any); repeated rows get equal scores; an empty table gives no rows; other columns stay as they
are or aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

GRAMS = (3, 4, 5)
BITS = 20
MAX_TOXIC, MAX_CLEAN = 2000, 4000
#: Features of all sampled rows together: 4 bytes each in the task that fits.
MAX_PLACES = 1 << 24
#: A ratio counts half where it times the root of its feature's rows is this.
SURE = 6.0
#: Characters of a text looked at in one step.
PIECE = 1 << 18
_U = np.uint32
_BASE, _MIX = _U(0x9E3779B1), _U(0x85EBCA6B)


def places(text: str | None) -> Iterator[np.ndarray]:
    """Hashed places of a text's n-grams, piece by piece, repeats included. White-space controls count as blanks."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    raw = np.where((raw >= 9) & (raw <= 13), np.uint32(32), raw)
    longest = max(GRAMS)
    for at in range(0, len(raw), PIECE):
        c = raw[at : at + PIECE + longest - 1]
        h = c
        for n in range(2, longest + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * _BASE + c[n - 1 :]
            if n in GRAMS:  # a gram that begins in the overlap belongs to the next piece; counted here too, it is the same feature
                yield (((h ^ (h >> _U(15))) * _MIX) >> _U(32 - BITS)).view(np.int32)


def features(text: str | None) -> np.ndarray:
    """The different places of a text."""
    found = list(places(text))
    if not found:
        return np.zeros(0, np.int32)
    if sum(map(len, found)) < 1 << (BITS - 2):
        every = np.sort(np.concatenate(found))
        return every[np.concatenate([[True], every[1:] != every[:-1]])]
    marked = np.zeros(1 << BITS, bool)
    for p in found:
        marked[p] = True
    return np.flatnonzero(marked).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self) -> Callable[[str | None], float]:
        def score(text: str | None) -> float:
            z = self.bias + float(self.weights[features(text)].sum(dtype=np.float64))
            return float(1 / (1 + np.exp(-min(max(z, -50), 50))))

        return score


def log_count_ratios(rows: list[np.ndarray], toxic: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """log(p / q) of each place, of its share of the toxic rows to that of the others, ``alpha`` added to counts; and the rows with it."""
    counts = np.full((2, 1 << BITS), alpha)
    for f, k in zip(rows, toxic):
        counts[int(k), f] += 1
    n, k = len(toxic), toxic.sum()
    return np.log(counts[1] / (k + 2 * alpha)) - np.log(counts[0] / (n - k + 2 * alpha)), counts.sum(0) - 2 * alpha


def fit(rows: list[np.ndarray], toxic: list[int], l2: float = 1e-5, epochs: int = 20, batch: int = 128, rate: float = 80.0, seed: int = 11) -> Model:
    """Fits on the places of each row."""
    y, size = np.asarray(toxic, np.float64), 1 << BITS
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(size, np.float32), 50.0 if p == 1 else -50.0)
    ratio, seen = log_count_ratios(rows, y)
    sure = (np.abs(ratio) * np.sqrt(seen)) ** 4
    ratio *= sure / (sure + SURE**4)
    ratio /= max(1e-9, float(np.sqrt(np.mean([np.square(ratio[f]).sum() for f in rows]))))
    w, b = np.zeros(size), 0.0
    share = np.where(y == 1, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (1 - y).sum()) ** 0.75  # most of the way to equal classes
    rng, step = np.random.default_rng(seed), 0
    parts = max(1, len(rows) // batch)
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(rows)), parts):
            flat, doc = np.concatenate([rows[i] for i in chosen]), np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen])
            z = np.bincount(doc, (w * ratio)[flat], len(chosen)) + b
            g = share[chosen] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[chosen]) / len(chosen)
            now = rate * (1 - 0.9 * step / (epochs * parts))
            w -= now * (np.bincount(flat, g[doc], size) * ratio + l2 * w)
            b -= now * g.sum()
            step += 1
    return Model((w * ratio).astype(np.float32), float(b))


def held_out(id_col: str, folds: int, fold: int):
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = pa.array([features(t).tobytes() for t in part.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=["draw", "y", "places"])


def _fitted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    rows, toxic, size = [], [], 0
    for batch in batches:
        for y, raw in zip(batch.column(1).to_pylist(), batch.column(2)):
            size += len(raw.as_buffer()) // 4
            if size <= most:
                rows.append(np.frombuffer(raw.as_buffer(), np.int32).copy())
                toxic.append(y)
    model = fit(rows, toxic)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on labelled rows whose crc32(id) mod 5 isn't 0."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 5, 0)).groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) > 0).cast("int").alias("__y"))
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    rate = F.lit(0.0)
    for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        rate = F.when(F.col("__y") == y, min(1.0, most / max(1, counts.get(y, 0)))).otherwise(rate)
    drawn = known.where(F.pmod(F.xxhash64("__id", F.lit("train")), F.lit(1_000_000)) < rate * 1_000_000)
    drawn = common.save(drawn.withColumn("draw", F.xxhash64("__id", F.lit("order"))), "drawn")
    small = common.maybe_broadcast(drawn, drawn.count(), 64)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(small, "__id")
    rows = rows.groupBy("draw", "__id", "__y").agg(F.min("__text").alias("__text"))
    found = rows.select("draw", F.col("__y").alias("y"), "__text").mapInArrow(_featured, "draw long, y int, places binary")
    most = MAX_PLACES
    fitted = found.repartition(1).sortWithinPartitions("draw", "y").mapInArrow(lambda it: _fitted(it, most), "weights binary, bias double").first()
    common.discard(drawn)
    return fit([], []) if fitted is None else Model(np.frombuffer(fitted["weights"], np.float32), fitted["bias"])


def score_column(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the toxicity of ``text_col`` in the column ``name``."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return df.withColumn(name, score(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col, 5, 0), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    scored = score_column(rows, train(docs, labels, id_col, text_col)).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
