"""Quality classifier by supervised subword embeddings.

Words, pairs of words and character (byte) trigrams of the whole text are hashed to rows of an embedding table. A document is the
mean of its vectors; a softmax over two classes sits on top. Vectors and output layer are learned together by
stochastic gradient descent in numpy, on a bounded sample of labelled documents (``per_class`` of each class).

To score, the table is folded with the output layer into one number for each row, so a document is a mean of
numbers. Texts without features (null, empty, blank) get the score that the bias alone gives. Rows without an id are
scored like any other, are no examples and are not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import SPACED_BYTES, crc_mod, documents, flat_text, id_and_text, in_fold, mix64, slices, word_codes
from terrane.llm.labelled import labelled_sample

FOLDS = 5
THRESHOLD = 0.3
PER_CLASS = 1500
BITS = 16
DIM = 10
EPOCHS = 6
#: Passes over a small sample are repeated until there were so many steps.
LEAST_STEPS = 4000
RATE = 0.4
_SPACED = np.frombuffer(SPACED_BYTES, np.uint8)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for trigrams (with the text of each), words and pairs (with the text of each).

    Returns rows and owners; trigrams have the first half of the table, words and pairs the second. A word that repeats the
    one before it is one feature, whatever the word: immediate repeats tell of junk, also in words that no example has.
    """
    half = bits - 1
    n = len(data)
    spaced = _SPACED[data].astype(np.uint32)
    tri = np.zeros(0, np.int64)
    owner = np.zeros(0, np.int64)
    if n >= 3:
        value = spaced[:-2] | (spaced[1:-1] << np.uint32(8)) | (spaced[2:] << np.uint32(16))
        tri = ((value * np.uint32(2654435761)) >> np.uint32(32 - half)).astype(np.int64)
        counts = np.maximum(np.diff(offsets) - 2, 0)
        at = np.repeat(offsets[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        tri, owner = tri[at], np.repeat(np.arange(len(counts)), counts)
    codes, text = word_codes(data, offsets, SPACED_BYTES)
    words = np.flatnonzero(codes)
    pairs = words[codes[np.minimum(words + 1, len(codes) - 1)] != 0]
    left, right = codes[pairs], codes[np.minimum(pairs + 1, len(codes) - 1)]
    both = np.concatenate([codes[words], np.where(left == right, np.uint64(0), mix64(left * np.uint64(3) + right))])
    rows = (both >> np.uint64(64 - half)).astype(np.int64) + (1 << half)
    return np.concatenate([tri, rows]), np.concatenate([owner, text[words], text[pairs]])


def _counted(bits: int):
    def of(batches):
        for batch in slices(batches, "text", 1 << 20):
            rows, owner = features(*flat_text(batch.column(1)), bits)
            key, count = np.unique((owner << bits) | rows, return_counts=True)
            cuts = np.searchsorted(key, np.arange(1, batch.num_rows) << bits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2),
                    pa.array(np.split((key & ((1 << bits) - 1)).astype(np.int32), cuts), pa.list_(pa.int32())),
                    pa.array(np.split(count.astype(np.float32), cuts), pa.list_(pa.float32())),
                ],
                names=["label", "rows", "counts"],
            )

    return of


@dataclass
class QualityModel:
    weight: np.ndarray  # by row of the table: its part of the log odds of label 1
    bias: float
    bits: int


def fit(sample: DataFrame, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> QualityModel:
    """Learn from doc_id, text, label. The sample must be bounded: its sparse features are gathered here."""
    got = sample.mapInArrow(_counted(bits), "label int, rows array<int>, counts array<float>").toArrow()
    labels = np.array(got.column("label").to_pylist(), np.int64)
    rows = [x.values.to_numpy() for x in got.column("rows")]
    counts = [x.values.to_numpy() for x in got.column("counts")]
    # the same order whatever the partitions were
    order = sorted(range(len(labels)), key=lambda i: (len(rows[i]), rows[i][:64].tobytes(), counts[i][:64].tobytes(), labels[i]))
    rng = np.random.RandomState(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-LEAST_STEPS // max(len(order), 1)))
    steps, done = epochs * max(len(order), 1), 0
    for _ in range(epochs):
        for i in np.array(order)[rng.permutation(len(order))] if order else []:
            eta = rate * (1 - done / steps)
            done += 1
            share = counts[i] / counts[i].sum() if len(rows[i]) else counts[i]
            hidden = share @ table[rows[i]] if len(rows[i]) else np.zeros(dim, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out.T @ p
            out -= eta * np.outer(p, hidden)
            bias -= eta * 0.1 * p
            if len(rows[i]):
                table[rows[i]] -= (eta * len(rows[i]) ** 0.5) * share[:, None] * back
    return QualityModel(table @ (out[1] - out[0]), float(bias[1] - bias[0]), bits)


def scores(model: QualityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, owner = features(data, offsets, model.bits)
    n = len(offsets) - 1
    total = np.bincount(owner, model.weight[rows].astype(np.float64), minlength=n)
    z = total / np.maximum(np.bincount(owner, minlength=n), 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _score(shared):
    def of(batches):
        for batch in slices(batches, "text", 2 << 20):
            value = scores(shared.value, *flat_text(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=["doc_id", "score"])

    return of


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_and_text(docs, id_col, text_col).mapInArrow(_score(shared), "doc_id long, score double")


def _keep(shared, threshold: float, text_col: str):
    def of(batches):
        for batch in slices(batches, text_col, 2 << 20):
            value = scores(shared.value, *flat_text(batch.column(batch.schema.get_field_index(text_col))))
            yield batch.filter(pa.array(value >= threshold))

    return of


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, threshold, text_col), docs.schema)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Learned from labelled documents outside of the held-out fold."""
    return fit(labelled_sample(docs, labels.where(crc_mod("doc_id", FOLDS) != 0), "quality", per_class))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", in_fold("doc_id", FOLDS, 0).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
