"""The manifest against trees that are put together row by row."""

import hashlib
import zlib

import pytest

from terrane.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def brute_force(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[name] = _levels([_leaf(r) for r in sources[name]])
    top = _levels([trees[name][-1][0] for name in names])
    out = []
    for nth, name in enumerate(names):
        for at, row in enumerate(sources[name]):
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node, proof = _leaf((*row[:4], text)), ""
            for levels, place in ((trees[name], at), (top, nth)):
                for level in levels[:-1]:
                    run, i = level[place // 16 * 16 :][:16], place % 16
                    proof += "".join(run[:i] + run[i + 1 :])
                    node, place = _digest(*run[:i], node, *run[i + 1 :]), place // 16
            root = top[-1][0]
            out.append((row[0], _leaf(row), trees[name][-1][0], root, _digest(proof), node, node == root))
    return sorted(out, key=str)


def _check(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "'x' as node", "2 as at", "3 as n").write.parquet(f"{folder}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(folder))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(300)]  # more than 16 * 16, the last run of one
    rows = rows[:273] + [(i, f"s{i}", None, None, "A b") for i in range(40)]  # many sources of a single leaf
    rows += [(i, "é" if i % 2 else "\U0001f600", "en", 1, "X") for i in range(33)] + [(i, None, "fr", None, None) for i in range(17)]
    rows += [(None, "hot", None, None, None), (None, "hot", "", 0, ""), (None, None, "-", 1, "1:-")] * 2 + [(5, "hot", "en", 5, "Text 5")] * 3
    rows += [(7, "", "a", 1, "b"), (7, "", "", 1, "ab"), (8, "long", "x", 3, "LONG " * 50_000)]
    _check(spark, tmp_path, rows)


@pytest.mark.parametrize("rows", [[(1, "s", "l", 1, "One")], [(1, None, None, None, None)], [(i, "s", "l", 1, "T") for i in range(16)], [(i, "s", "l", 1, "T") for i in range(17)]])
def test_small_trees(spark, tmp_path, rows):
    _check(spark, tmp_path, rows)


def test_empty_table(spark, tmp_path):
    _check(spark, tmp_path, [])


def test_store_is_read_by_level(spark, tmp_path):
    """A level is a sixteenth of the one below, and proofs go with nodes, not with leaves."""
    docs = spark.range(5_000).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "1L as n_chars", "cast(id as string) as text")
    found = merkle.manifest(docs, str(tmp_path), "doc_id", "source", COLUMNS)
    assert found.count() == 5_000
    sizes = [spark.read.parquet(f"{tmp_path}/leaves/level={k}").count() for k in range(5)]
    assert sizes == [5_000, 313, 20, 2, 1]
