"""Classifiers: held-out accuracy on the tables, and defined results for odd rows."""

import math
import zlib

import numpy as np
import pytest

from terrane.llm import language_id, quality, toxicity
from terrane.llm.common import SPACED_BYTES, WORD_BYTES, crc_mod
from terrane.llm.labelled import labelled_sample
from tests.llm.conftest import documents

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def _held_out(labels, n):
    return {r.doc_id: r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % n == 0}


def test_quality(spark, docs, labels, odd_rows):
    model = quality.fitted(docs, labels)
    truth = _held_out(labels, quality.FOLDS)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == docs.count()
    right = [(got[d] >= quality.THRESHOLD) == (r.quality == 1) for d, r in truth.items()]
    assert sum(right) / len(right) > 0.97
    odd = quality.score(documents(spark, odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    empty = {r.score for r in odd if r.doc_id in (1, 2)}
    assert len(empty) == 1
    kept = quality.keep_good(documents(spark, odd_rows), model)
    assert kept.columns == documents(spark, odd_rows).columns
    assert kept.count() == sum(r.score >= quality.THRESHOLD for r in odd)
    again = quality.fitted(docs, labels)
    assert (again.weight == model.weight).all()


def test_quality_without_labels(spark, docs, labels):
    model = quality.fitted(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(5), model).collect()} == {0.5}


def test_toxicity(spark, docs, labels, odd_rows):
    train = labels.where(crc_mod("doc_id", toxicity.FOLDS) != 0)
    model = toxicity.fit(labelled_sample(docs, train, "toxic", toxicity.PER_CLASS))
    assert list(model.thresholds) == sorted(model.thresholds)
    truth = _held_out(labels, toxicity.FOLDS)
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    toxic = [got[d].chance >= toxicity.TOXIC for d, r in truth.items() if r.toxic == 1]
    clean = [got[d].chance >= toxicity.TOXIC for d, r in truth.items() if r.toxic == 0]
    assert sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.01
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got.values())
    odd = {(r.doc_id): r for r in toxicity.grade(documents(spark, odd_rows), model).collect()}
    assert odd[1].severity == odd[2].severity == odd[3].severity == 0 and odd[1].grade == 0
    nothing = toxicity.fit(labelled_sample(docs, labels.limit(0), "toxic", 10))
    assert toxicity.grade(docs.limit(3), nothing).count() == 3


def test_language(spark, docs, odd_rows):
    model = language_id.fit(language_id.sample(docs.where(crc_mod("doc_id", language_id.FOLDS) != 1)))
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    right = [got[d].lang_pred == lang for d, lang in truth.items()]
    assert sum(right) / len(right) > 0.99
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: r for r in language_id.predict(documents(spark, odd_rows + [(50, "12 34 !")]), model).collect()}
    assert {odd[d].lang_pred for d in (1, 2, 3, 50)} == {language_id.UNKNOWN} and odd[1].score == 0
    assert odd[8].lang_pred in model.names
    nothing = language_id.fit(language_id.sample(docs.limit(0)))
    assert {r.lang_pred for r in language_id.predict(docs.limit(3), nothing).collect()} == {language_id.UNKNOWN}


M = 2**64 - 1


def _mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def _code(word):
    """A word's code, eight bytes after the other."""
    h = _mix(int.from_bytes(word[:8], "little") ^ len(word) * 0x9E3779B97F4A7C15 & M)
    for i in range(8, len(word), 8):
        h = _mix(h * 0x9E3779B97F4A7C15 + int.from_bytes(word[i : i + 8], "little") & M)
    return h or 1


def _sample_of_texts(docs, odd_rows):
    return [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(200).collect()] + [(10**9 + d, t) for d, t in odd_rows if len(t or "") < 10**5]


def test_quality_scores_by_definition(spark, docs, labels, odd_rows):
    """The score as a mean over a dictionary of features, text by text."""
    model = quality.fitted(docs, labels, 100)
    rows, half = _sample_of_texts(docs, odd_rows), quality.BITS - 1
    got = {r.doc_id: r.score for r in quality.score(documents(spark, rows), model).collect()}
    for d, text in rows:
        data = (text or "").encode().translate(SPACED_BYTES)
        found = [(int.from_bytes(data[i : i + 3], "little") * 2654435761 & 0xFFFFFFFF) >> 32 - half for i in range(len(data) - 2)]
        codes = [_code(w) for w in data.split(b" ") if w]
        found += [(c >> 64 - half) + (1 << half) for c in codes + [0 if a == b else _mix(a * 3 + b & M) for a, b in zip(codes, codes[1:], strict=False)]]
        z = model.bias + (sum(float(model.weight[f]) for f in found) / len(found) if found else 0)
        assert abs(got[d] - 1 / (1 + math.exp(-z))) < 1e-6


def test_toxicity_by_definition(spark, docs, labels, odd_rows):
    """P(grade > k) and the expected grade from a dictionary of features, text by text."""
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", 300))
    rows = _sample_of_texts(docs, odd_rows) + [(r.doc_id, r.text) for r in docs.join(labels.where("toxic = 1"), "doc_id").limit(50).collect()]
    got = {r.doc_id: r for r in toxicity.grade(documents(spark, rows), model).collect()}
    assert len({r.grade for r in got.values()}) > 1
    for d, text in rows:
        words, counts = (text or "").encode().translate(WORD_BYTES).split(), {}
        for w in words:
            keys = [_code(w)] + [_mix(int.from_bytes(w[:n], "little") * 31 + n & M) for n in toxicity.BEGINNINGS if len(w) > n]
            for k in keys:
                counts[k >> 64 - toxicity.BITS] = counts.get(k >> 64 - toxicity.BITS, 0) + 1
        total = sum(counts.values())
        z = toxicity.SCALE * sum(model.weight[k] * math.sqrt(n / total) for k, n in counts.items())
        p = [1 / (1 + math.exp(t - z)) for t in model.thresholds] if words else [0, 0, 0]
        assert abs(got[d].severity - sum(p)) < 1e-6 and abs(got[d].chance - p[0]) < 1e-6 and got[d].grade == sum(x > 0.5 for x in p)


def test_grades_made_of_labels():
    """Toxic examples by thirds of their share of words that toxic examples have; others are 0."""
    labels = np.array([1, 1, 1, 1, 1, 1, 0, 0])
    doc, rows = np.arange(8), np.array([0, 0, 0, 0, 0, 0, 0, 1])
    share, typical = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.9, 1.0]), np.array([True, False])
    assert list(toxicity.grades_of(labels, doc, rows, share, typical)) == [1, 1, 2, 2, 3, 3, 0, 0]


def test_toxicity_learns_given_grades(spark):
    """Where labels are grades, one weight vector and ordered thresholds give them back."""
    rows = [(i, " ".join(["bad"] * (3 * (i % 4)) + ["fine"] * (9 - 3 * (i % 4)) + ["filler"] * 3), i % 4) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), graded=True)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.grade(spark.createDataFrame(rows, "doc_id long, text string, label int"), model).collect()}
    means = [sum(got[i].severity for i, _, g in rows if g == k) / 100 for k in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 2


def test_language_by_definition(spark, docs, odd_rows):
    """Kernel values with each landmark as shares of common n-grams, text by text."""
    model = language_id.fit(language_id.sample(docs, 40))
    assert model.landmarks.shape[1] >= len(model.names)
    rows = _sample_of_texts(docs, odd_rows)
    got = {r.doc_id: r for r in language_id.predict(documents(spark, rows), model).collect()}
    for d, text in rows:
        data = bytes(language_id._LETTERS[np.frombuffer((text or "").encode(), np.uint8)])
        grams = {(n, int.from_bytes(data[i : i + n], "big")) for n in (1, 2, 3) for i in range(len(data) - n + 1)}
        found = sorted({((v * 2654435761 + n * 0x9E3779B9) & 0xFFFFFFFF) >> 32 - model.bits for n, v in grams})
        kernel = model.landmarks[found].sum(axis=0) / math.sqrt(max(len(found), 1))
        margins = kernel @ model.classes + model.bias
        if got[d].lang_pred != language_id.UNKNOWN:
            assert abs(got[d].score - min(max(margins.max(), 0), 1)) < 1e-3
            assert margins.max() - margins[model.names.index(got[d].lang_pred)] < 1e-3


def test_every_language_is_learned(spark):
    """More languages than landmarks; repeated rows, ids with two languages, null ids."""
    rows = [(i, chr(0x4E00 + i // 2) * 20, f"l{i // 2:03d}") for i in range(500)] + [(1, "other text", None), (None, "no id", "zz")] + [(7, chr(0x4E00 + 3) * 20, "l003")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.sample(docs)
    assert sample.count() == 500
    assert len(language_id.fit(sample).names) == 250


def test_bytes_of_a_language_sample(spark):
    """Languages share the bytes; one text of each is taken, however long."""
    rows = [(i, "ab " * 100, f"l{i % 4}") for i in range(400)] + [(1000, "x" * 50_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.lang: r["count"] for r in language_id.sample(docs, 50, 5 * 3_000).groupBy("lang").count().collect()}
    assert got == {"l0": 10, "l1": 10, "l2": 10, "l3": 10, "long": 1}
    assert language_id.sample(docs, 50).count() == 201


def test_samples_of_repeated_ids(spark):
    """An id is one example, with the label that is its own, however many rows and texts it has."""
    docs = spark.createDataFrame([(1, "a")] * 1000 + [(1, "b"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (None, 1), (9, 1), (2, None)], "doc_id long, good int")
    got = labelled_sample(docs, labels, "good", 10).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(1, 1), (2, 0), (3, 0)]
    assert labelled_sample(docs, labels, "good", 10, class_bytes=0).count() == 2  # the first of each class
    assert labelled_sample(docs, labels, "good", 1).count() == 2


def test_empty_tables_and_null_ids(spark, docs, labels):
    none, one = docs.limit(0), docs.sparkSession.createDataFrame([(None, "some words")], "doc_id long, text string")
    for model, apply in (
        (quality.fitted(docs, labels, 50), quality.score), (toxicity.fit(labelled_sample(docs, labels, "toxic", 50)), toxicity.grade),
        (language_id.fit(language_id.sample(docs, 20)), language_id.predict),
    ):
        assert apply(none, model).count() == 0 and apply(one, model).count() == 1
    from terrane.llm.common import in_fold

    assert [r[0] for r in one.select(in_fold("doc_id", 3, 1)).collect()] == [False]


def test_kernel_is_the_share_of_common_ngrams():
    import pyarrow as pa

    from terrane.llm.common import flat_text

    texts = ["abcab", "Bcd", "zz"]
    rows, owner = language_id.present(*flat_text(pa.array(texts)), 22)
    sets = [set(rows[owner == i]) for i in range(3)]
    grams = [{t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    assert [len(s) for s in sets] == [len(g) for g in grams]
    assert len(sets[0] & sets[1]) == len(grams[0] & grams[1])
    dense = language_id._dense(rows, owner, 3, 22)
    want = len(grams[0] & grams[1]) / np.sqrt(len(grams[0]) * len(grams[1]))
    assert abs(float(dense[0] @ dense[1]) - want) < 1e-6
