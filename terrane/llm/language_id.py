"""Language identification with string kernels.

The blended-spectrum kernel of two texts is the number of character (byte) n-grams of 1 to 3 that are present in both,
normalised by those of each. ``landmarks`` labelled texts span the Nystroem approximation: a text is the vector of its kernel
values with them, whitened by the inverse root of the kernel among the landmarks. On these vectors, ridge
regression of one class against the rest gives a score for each language; the largest decides. Whole batches are
scored by products of matrices: presence (sparse) by landmarks, then by classes.

Learned from a bounded sample: ``per_language`` texts of each language, every value of the language column being one, and
``sample_bytes`` of text in all. A sample is gathered as its sets of n-grams, 64 kB a text at most. There are ``landmarks`` landmarks, or one for each
language if that is more. A-Z is lower-cased; digits and ASCII
punctuation are blanks. Null texts and texts without a letter are ``und`` with score 0. Rows without an id are scored
like any other, are no examples and are not held out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from terrane.llm.common import crc_mod, cut, documents, flat_text, id_and_text, in_fold, slices

FOLDS = 3
PER_LANGUAGE = 300
#: Bytes of text in the sample of all languages together, at most; one text of each language is still taken.
SAMPLE_BYTES = 32 << 20
#: So many examples (some 50 bytes each) are broadcast to find their texts; more are joined by a shuffle.
MOST_BROADCAST = 200_000
LANDMARKS = 192
BITS = 14
RIDGE = 1e-3
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Letters stay (A-Z lower-cased), anything else of ASCII becomes a blank.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def present(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, and the text of each, in order of text."""
    low = _LETTERS[data].astype(np.uint32)
    parts, sizes = [], np.diff(offsets)
    for n in (1, 2, 3):
        counts = np.maximum(sizes - n + 1, 0)
        if not counts.sum():
            continue
        value = low[: len(low) - n + 1].copy()
        for i in range(1, n):
            value = (value << np.uint32(8)) | low[i : len(low) - n + 1 + i]
        row = ((value * np.uint32(2654435761) + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) >> np.uint32(32 - bits)).astype(np.int64)
        at = np.repeat(offsets[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        parts.append((np.repeat(np.arange(len(sizes)), counts) << bits) | row[at])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(sizes)
    seen = np.zeros(n << bits, bool)
    for key in parts:
        seen[key] = True
    key = np.flatnonzero(seen)
    return key & ((1 << bits) - 1), key >> bits


@dataclass
class LanguageModel:
    landmarks: np.ndarray  # n-grams by landmarks, normalised
    classes: np.ndarray  # landmarks by languages
    bias: np.ndarray
    names: list[str]
    bits: int


def _dense(rows: np.ndarray, owner: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Presence of n-grams, each text's row normalised."""
    out = np.zeros((n, 1 << bits), np.float32)
    out[owner, rows] = 1
    return out / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))[:, None].astype(np.float32)


def _presence(bits: int):
    def of(batches):
        for batch in slices(batches, "text", 1 << 20):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, owner = present(*flat_text(part.column(1)), bits)
                cuts = np.searchsorted(owner, np.arange(1, part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.split(rows.astype(np.int32), cuts), pa.list_(pa.int32()))],
                    names=["doc_id", "lang", "rows"],
                )

    return of


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text, lang: of each language, the rows with the least hashes of id and text, repeated rows once.

    Every language has ``per_language`` rows at most, and as many as fit its equal share of ``sample_bytes``, one at least.

    Rows whose language or id is null are no examples. An id that stands for several texts or languages gives an example
    for each of these rows.
    """
    rows = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    ids = rows.groupBy("doc_id", "lang", "h").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
    # thin by the hash before ranking, so that no window holds a whole language
    share = F.col("h").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    thin = ids.join(counts, "lang").where(share * F.col("n") <= F.lit(4.0 * per_language + 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    thin = thin.withColumn("rank", rank).where(F.col("rank") <= per_language)
    size = F.sum("size").over(Window.partitionBy("lang").orderBy("rank"))  # per_language rows at most
    thin = cut(thin.select("doc_id", "lang", "h", "rank", size.alias("bytes")))
    known = thin.agg(F.count_distinct("lang").alias("languages"), F.count("*").alias("rows")).first()
    chosen = thin.where((F.col("rank") == 1) | (F.col("bytes") <= sample_bytes // max(1, known.languages))).select("doc_id", "lang", "h")
    return rows.join(F.broadcast(chosen) if known.rows <= MOST_BROADCAST else chosen, ["doc_id", "lang", "h"]).groupBy("doc_id", "lang", "h").agg(F.first("text").alias("text")).select("doc_id", "text", "lang")


def fit(rows: DataFrame, landmarks: int = LANDMARKS, bits: int = BITS, ridge: float = RIDGE) -> LanguageModel:
    """Learn from doc_id, text, lang. The sample must be bounded: its n-gram sets are gathered here."""
    got = rows.mapInArrow(_presence(bits), "doc_id long, lang string, rows array<int>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    langs = got.column("lang").to_pylist()
    names = sorted(set(langs))
    if not names:
        return LanguageModel(np.zeros((1 << bits, 1), np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), [UNKNOWN], bits)
    sets = [x.values.to_numpy() for x in got.column("rows")]
    n = len(sets)
    # landmarks from all languages in turn
    turn, count = [], dict.fromkeys(names, 0)
    for i, lang in enumerate(langs):
        turn.append((count[lang], lang, i))
        count[lang] += 1
    chosen = np.array([i for _, _, i in sorted(turn)[: max(landmarks, len(names))]])
    owner = np.repeat(np.arange(len(chosen)), [len(sets[i]) for i in chosen])
    basis = np.ascontiguousarray(_dense(np.concatenate([sets[i] for i in chosen]).astype(np.int64), owner, len(chosen), bits).T)
    kernel = np.empty((n, len(chosen)), np.float32)
    for at in range(0, n, 256):
        part = sets[at : at + 256]
        owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
        kernel[at : at + 256] = _dense(np.concatenate([np.zeros(0, np.int64), *part]).astype(np.int64), owner, len(part), bits) @ basis
    values, vectors = np.linalg.eigh((basis.T @ basis).astype(np.float64))
    good = values > 1e-6 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])
    x = kernel.astype(np.float64) @ white
    y = (np.array(langs)[:, None] == np.array(names)).astype(np.float64)
    mean_x, mean_y = x.mean(axis=0), y.mean(axis=0)
    w = np.linalg.solve((x - mean_x).T @ (x - mean_x) / n + ridge * np.eye(x.shape[1]), (x - mean_x).T @ (y - mean_y) / n)
    return LanguageModel(basis, (white @ w).astype(np.float32), (mean_y - mean_x @ w).astype(np.float32), names, bits)


def _predict(shared):
    def of(batches):
        model = shared.value
        for batch in slices(batches, "text", 2 << 20):
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                n = part.num_rows
                rows, owner = present(*flat_text(part.column(1)), model.bits)
                margins = (_dense(rows, owner, n, model.bits) @ model.landmarks) @ model.classes + model.bias
                best = margins.argmax(axis=1)
                letters = np.array([t is not None and _LETTER.search(t) is not None for t in part.column(1).to_pylist()], bool)
                names = [model.names[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, np.clip(margins[np.arange(n), best], 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return of


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: the winning class's regression value) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_and_text(docs, id_col, text_col).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(sample(docs.where(crc_mod("doc_id", FOLDS) != 1)))
    return predict(docs, model).select("doc_id", in_fold("doc_id", FOLDS, 1).alias("held_out"), "lang_pred", "score")
