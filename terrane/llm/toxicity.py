"""Toxicity grades by cumulative-link ordinal regression.

Severity has the grades 0 (none) to 3. A document is a sparse vector: the square roots of the shares of its features,
which are hashed words and beginnings of words. The
cumulative-link (proportional odds) model gives P(grade > k) = logistic(w.x - t_k) with one weight vector for all
thresholds t_0 < t_1 < t_2, and the severity of a text is the expected grade, the sum of these.

Labels may be grades already (``graded``). Where they say only toxic or not, grades to learn from are made of them by a
fixed rule, :func:`grades_of`: words that toxic examples use far more often than others
are found by their log odds, and toxic examples are graded 1 to 3 by the thirds of their share of such words. So the first
threshold is what labels teach; the others, and with them how severe a toxic text is, are as good as that rule. Features that do not go with the label
beyond chance have weight 0. The model is fitted by stochastic gradient steps in numpy on a bounded sample (``per_class`` of toxic and of other documents), then
scores whole texts where they are read. Null texts and texts without words have severity 0 exactly. Rows without an id are
scored like any other, are no examples and are not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import WORD_BYTES, crc_mod, documents, flat_text, id_and_text, in_fold, mix64, slices, word_codes
from terrane.llm.labelled import labelled_sample

FOLDS = 5
PER_CLASS = 2500
BITS = 18
#: Bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (5, 6, 7, 8)
GRADES = 3
#: Passes over a small sample are repeated until there were so many steps.
LEAST_STEPS = 8000
#: A text is toxic if a grade above 0 is at least this likely; chosen on the folds that are learned from.
TOXIC = 0.3
#: Standard deviations beyond which a feature is taken to go with the label.
MOST_CHANCE = 5.0
SCALE = 10.0


@dataclass
class ToxicityModel:
    weight: np.ndarray
    thresholds: np.ndarray
    bits: int


def _rows(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the weights for words and their beginnings, the text of each, and each text's number of words."""
    codes, text, starts, lengths = word_codes(data, offsets, spans=True)
    words = np.flatnonzero(codes)
    text = text[words]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = np.frombuffer(WORD_BYTES, np.uint8)[data]
    eight = np.ndarray(len(data), "<u8", padded, strides=(1,)) if len(data) else np.zeros(0, np.uint64)
    first = eight[starts]
    parts, owners = [codes[words]], [text]
    for n in BEGINNINGS:
        long = lengths > n
        parts.append(mix64((first[long] & np.uint64((1 << 8 * n) - 1)) * np.uint64(31) + np.uint64(n)))
        owners.append(text[long])
    rows = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    return rows, np.concatenate(owners), np.bincount(text, minlength=len(offsets) - 1)


def _counted(bits: int):
    def of(batches):
        for batch in slices(batches, "text", 1 << 20):
            rows, owner, _ = _rows(*flat_text(batch.column(1)), bits)
            key, count = np.unique((owner << bits) | rows, return_counts=True)
            cuts = np.searchsorted(key, np.arange(1, batch.num_rows) << bits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2),
                    pa.array(np.split((key & ((1 << bits) - 1)).astype(np.int32), cuts), pa.list_(pa.int32())),
                    pa.array(np.split(count.astype(np.int32), cuts), pa.list_(pa.int32())),
                ],
                names=["doc_id", "label", "rows", "counts"],
            )

    return of


def _telling(labels: np.ndarray, doc: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Features whose presence goes with the label well beyond chance, either way; and those much likelier in toxic texts."""
    toxic = labels[doc] == 1
    n1, n0 = max(labels.sum(), 1), max((labels == 0).sum(), 1)
    in1, in0 = np.bincount(rows[toxic], minlength=size), np.bincount(rows[~toxic], minlength=size)
    rate = (in1 + in0) / (n1 + n0)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))
    beyond = np.abs(in1 / n1 - in0 / n0) / spread > MOST_CHANCE
    odds = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    return beyond, beyond & (odds > np.log(8))


def grades_of(labels: np.ndarray, doc: np.ndarray, rows: np.ndarray, share: np.ndarray, typical: np.ndarray) -> np.ndarray:
    """Grades made of labels: toxic examples by thirds of their share of typical features."""
    amount = np.bincount(doc, share * typical[rows], minlength=len(labels))
    some = amount[(labels == 1) & (amount > 0)]
    cuts = np.quantile(some, [1 / 3, 2 / 3]) if len(some) else np.array([np.inf, np.inf])
    return np.where(labels == 1, 1 + (amount > cuts[0]) + (amount > cuts[1]), 0)


def fit(
    sample: DataFrame, bits: int = BITS, epochs: int = 4, rate: float = 0.3, ridge: float = 1e-3, seed: int = 1, graded: bool = False
) -> ToxicityModel:
    """Learn from doc_id, text, label (0 or 1, or a grade of 0 to 3 if ``graded``). The sample must be bounded: its sparse
    features are gathered here."""
    got = sample.mapInArrow(_counted(bits), "doc_id long, label int, rows array<int>, counts array<int>").toArrow().sort_by("doc_id")
    labels = np.array(got.column("label").to_pylist(), np.int64)
    lists = got.column("rows").combine_chunks() if got.num_rows else None
    weight, thresholds = np.zeros(1 << bits), np.array([2.0, 3.0, 4.0])
    if lists is None or not len(lists.flatten()):
        return ToxicityModel(weight, thresholds, bits)
    rows = lists.flatten().to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(labels)), sizes)
    counts = got.column("counts").combine_chunks().flatten().to_numpy().astype(np.float64)
    share = counts / np.maximum(np.bincount(doc, counts, minlength=len(labels)), 1)[doc]
    telling, typical = _telling(np.minimum(labels, 1), doc, rows, 1 << bits)
    grades = labels if graded else grades_of(labels, doc, rows, share, typical)
    kept = telling[rows]
    doc, rows, x = doc[kept], rows[kept], SCALE * np.sqrt(share[kept])
    sizes = np.bincount(doc, minlength=len(labels))
    # thresholds are a first one and the logarithms of the gaps; AdaGrad steps on one document after the other
    theta = np.array([thresholds[0], 0.0, 0.0])
    size_w, size_t = np.full(1 << bits, 1e-3), np.full(GRADES, 1e-3)
    ends = np.cumsum(sizes)
    rng = np.random.RandomState(seed)
    for _ in range(max(epochs, -(-LEAST_STEPS // len(labels)))):
        for i in rng.permutation(len(labels)):
            at = slice(ends[i] - sizes[i], ends[i])
            mine, values, g = rows[at], x[at], grades[i]
            gaps = np.exp(theta[1:])
            cuts = theta[0] + np.append(0, np.cumsum(gaps))
            p = _above(np.array([weight[mine] @ values]), cuts)[0]
            # the chance of grade g is P(> g - 1) - P(> g); its logarithm has slope 1 - P(> g - 1) - P(> g) in the score
            full = np.concatenate([[1.0], p, [0.0]])
            chance = max(full[g] - full[g + 1], 1e-9)
            slope = np.zeros(GRADES)
            q = p * (1 - p) / chance
            if g < GRADES:
                slope[g] += q[g]
            if g > 0:
                slope[g - 1] -= q[g - 1]
            up_w = (1 - full[g] - full[g + 1]) * values - ridge * weight[mine]
            up_t = np.array([slope.sum(), *(slope[k:].sum() * gaps[k - 1] for k in range(1, GRADES))])
            size_w[mine] += up_w * up_w
            weight[mine] += rate * up_w / np.sqrt(size_w[mine])
            size_t += up_t * up_t
            theta += 0.1 * up_t / np.sqrt(size_t)
    return ToxicityModel(weight, theta[0] + np.append(0, np.cumsum(np.exp(theta[1:]))), bits)


def _above(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -60, 60)))


def grade_chances(model: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """P(grade > k) for k = 0, 1, 2 by text; 0 for texts without words."""
    rows, owner, words = _rows(data, offsets, model.bits)
    n = len(offsets) - 1
    features = np.bincount(owner, minlength=n)
    key, count = np.unique((owner << model.bits) | rows, return_counts=True)
    doc = key >> model.bits
    score = SCALE * np.bincount(doc, model.weight[key & ((1 << model.bits) - 1)] * np.sqrt(count / features[doc]), minlength=n)
    return np.where(words[:, None] > 0, _above(score, model.thresholds), 0.0)


def _score(shared):
    def of(batches):
        for batch in slices(batches, "text", 4 << 20):
            p = grade_chances(shared.value, *flat_text(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p > 0.5).sum(axis=1).astype(np.int32))],
                names=["doc_id", "severity", "chance", "grade"],
            )

    return of


def grade(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), chance (of any grade above 0), grade (median) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_and_text(docs, id_col, text_col).mapInArrow(_score(shared), "doc_id long, severity double, chance double, grade int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document with its severity; toxic says whether a grade above 0 has a chance of ``TOXIC`` or more.

    Learned from labels of documents whose crc32(doc_id) mod 5 is not 0; the others are held out.
    """
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", FOLDS) != 0)
    model = fit(labelled_sample(docs, labels, "toxic", PER_CLASS))
    return grade(docs, model).select(
        "doc_id", in_fold("doc_id", FOLDS, 0).alias("held_out"), "severity", F.col("chance").alias("score"), "grade",
        (F.col("chance") >= TOXIC).alias("toxic"),
    )
