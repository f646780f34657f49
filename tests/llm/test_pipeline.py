"""The pipeline: each stage against a brute-force version on what the stage before it kept."""

import corpus_pipeline
from terrane.llm import decontaminate, mixing, quality
from tests.llm.conftest import DATA
from tests.llm.test_exact_operators import _first_of_groups


def _without_repeats(texts, width=100):
    """Characters of which no byte is in a string that starts earlier."""
    seen, out = set(), {}
    for d in sorted(texts):
        data = texts[d].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if (s := data[p : p + width]) in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(s)
        at, kept = 0, []
        for c in texts[d]:
            n = len(c.encode())
            if not any(gone[at : at + n]):
                kept.append(c)
            at += n
        out[d] = "".join(kept)
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) in (4, 5)
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{k}")
        read = spark.read.parquet(f"{tmp_path}/{k}")
        rows = read.collect()
        if k < 4:
            assert read.columns == columns
            after = {r.doc_id: r.text for r in rows}
        if k == 0:
            model = quality.fitted(docs, labels)
            good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= quality.THRESHOLD}
            assert set(after) == good and len(good) < len(before)
        elif k == 1:
            words = {}
            for d in sorted(before):
                words.setdefault(tuple(before[d].lower().split()), d)
            assert set(after) <= set(words.values())  # no copy is left
            assert set(after) == _first_of_groups(sorted(before.items()))
        elif k == 2:
            assert after == _without_repeats(before)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif k == 3:
            found = {r[0] for r in decontaminate.brute_force(list(before.items()), items) if r[5]}
            assert set(after) == set(before) - found
        else:
            sizes = {d: len(t.split()) for d, t in before.items()}
            assert {r.doc_id: r.size for r in rows} == sizes and all(r.taken <= 3 * r.size for r in rows)
            assert abs(sum(r.taken for r in rows) - sum(sizes.values())) <= 20
        docs, before = read, after
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, rows))
    assert mixing.MOST_REPEATS == 3


def _tables(spark, folder, rows):
    """A folder of tables: documents with these rows and columns that operators use inside, and the small tables."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "'en' as lang", "if(doc_id % 2 = 0, 's', null) as source", "length(text) as n_chars", "1 as node", "2 as h", "'k' as rest", "0 as nth")
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return docs


def test_odd_tables(spark, tmp_path, small_rows, odd_rows):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns of clashing names."""
    odd = [(10_000 + d, t) for d, t in odd_rows] + [(None, None), (None, "no id"), (None, "no id"), (5_000, "one text of an id " * 9), (5_000, "another text " * 9)]
    docs = _tables(spark, tmp_path, small_rows + odd)
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path))
        assert out.columns == docs.columns
        before, seen = seen.count(), spark.createDataFrame(out.collect(), docs.schema)
        assert seen.count() <= before
    last = corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).collect()
    assert len(last) == seen.count() and all(0 <= r.taken <= 3 * r.size for r in last)


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
