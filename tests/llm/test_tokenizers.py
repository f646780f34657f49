"""Operators on tokens, against the tokenizers themselves on whole texts."""

import bisect
import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from terrane.llm import alignment, bpe_table
from terrane.llm.word_blocks import packed, unpacked
from tests.llm.conftest import documents

WORDS = bpe_table.public_path(bpe_table.VOCABULARY)
A_PATH, B_PATH = bpe_table.public_path(alignment.A_FILE), bpe_table.public_path(alignment.B_FILE)

#: White space of all kinds, marks that combine, letters whose lower case is special, strings of control tokens.
TEXTS = [
    "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "x\x0by\x1cz\x85w\xa0v u t　s", "̈a é ́e ΑΣ ΑΣ. İ ǅ",
    "it's I'LL don't 12 3٣ ½①", "  Å ﬀ ẛ̣", "a</w> </w>b", "﻿ ​‍\U0001f469‍\U0001f4bb", "  two  blanks \r\n\t ends ",
    "▁ ▁a b▁", "<0x41> </s> <s> <unk>", "x" * 30_000 + " " + "ab" * 9_000, "\U0001f600" * 50 + " \U00010348",
]


def _odd(odd_rows):
    return odd_rows + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, "no id"), (None, None)]


def test_bpe_table(spark, small_rows, odd_rows):
    rows = _odd(odd_rows) + small_rows
    reader = bpe_table.tokenizer(WORDS)
    want = []
    for d, text in rows:
        ids = reader.encode(text or "", add_special_tokens=False).ids
        want.append((d, ids, reader.decode(ids, skip_special_tokens=False)))
    df = documents(spark, rows).withColumn("at", F.lit("x")).withColumn("word", F.lit(3))
    for size in (1 << 30, 2_000):  # all in one block of a task, and several blocks
        got = [tuple(r) for r in bpe_table.tokenized(df.repartition(3) if size > 2_000 else df.coalesce(1), WORDS, block_bytes=size, bucket_bytes=size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe_table.tokenized(df.limit(0), WORDS).count() == 0
    assert bpe_table.tokenized(documents(spark, [(1, None), (2, "")]), WORDS).collect() == [(1, [], ""), (2, [], "")]


def test_bpe_query(spark, tmp_path, odd_rows):
    rows = _odd(odd_rows)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    reader, digest = bpe_table.tokenizer(WORDS), lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d, text in rows:
        ids = reader.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), digest(" ".join(map(str, ids))), digest(reader.decode(ids, skip_special_tokens=False))))
    got = bpe_table.op11_bpe_table(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_decode(spark):
    rows = [(1, [320, 49407, 320]), (2, []), (3, None), (4, [320, 10**6, None, 321]), (5, [321] * 3_000)]
    df = spark.createDataFrame(rows, "k int, ids array<int>")
    got = dict(map(tuple, bpe_table.decode(df, bpe_table.id_to_piece(spark, WORDS), ["k"]).collect()))
    reader = bpe_table.tokenizer(WORDS)
    assert got == {k: reader.decode([i for i in ids or [] if i is not None], skip_special_tokens=False) for k, ids in rows}


def test_unfit_tokenizer():
    with pytest.raises(ValueError):
        bpe_table.checked(bpe_table.public_path("byte_bpe_50k.json"))


def test_packed():
    numbers = [0, 1, 127, 128, 65_535, 65_536, 2**32 - 1]
    assert unpacked(packed(numbers), len(numbers)).tolist() == numbers and unpacked(packed([]), 0).tolist() == []


def test_changed_input(spark):
    """Texts that differ from one reading to the next stop the job."""
    shaky = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.rand() * 1e9).cast("long").cast("string")).alias("text"))
    other = shaky.withColumn("text", F.udf(lambda t: t + str(__import__("random").random()), "string").asNondeterministic()("text"))
    with pytest.raises(Exception, match="read again"):
        bpe_table.tokenized(other, WORDS).collect()


def _align_all(rows):
    """Groups by the sets of ends, links and counts by all pairs, on whole texts."""
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(A_PATH)
    reader.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = alignment.byte_letters()
    vocabulary = {i: t for t, i in reader.get_vocab().items()}
    found, held = [], collections.Counter()
    for d, text in rows:
        groups = []
        if text:
            a, b = reader.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            a_bytes = [bytes(letters[c] for c in vocabulary[i]) for i in a]
            b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_ends, b_ends = list(itertools.accumulate(map(len, a_bytes))), list(itertools.accumulate(map(len, b_bytes)))
                borders = sorted(set(a_ends) & set(b_ends))
                groups = [([], []) for _ in borders]
                for side, ids, ends in ((0, a, a_ends), (1, b, b_ends)):
                    for i, end in zip(ids, ends, strict=True):
                        groups[bisect.bisect_left(borders, end)][side].append(i)
        links = collections.Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        held.update(links.keys())
        found.append((d, groups, links))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for d, groups, links in found:
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        best = sum(n for pair, n in links.items() if held[pair] == most[pair[0]])
        out.append((d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), links.total(), best, sum(n * held[pair] for pair, n in links.items()), text))
    return out, held


def test_alignment(spark, small_rows, odd_rows):
    rows = _odd(odd_rows) + small_rows
    want, held = _align_all(rows)
    assert any(r[1] == 0 for r in want if r[0] is not None and r[0] >= 100)  # a text that the pieces do not give back
    df = documents(spark, rows).withColumn("kind", F.lit("x")).withColumn("written", F.lit(3))
    for size in (1 << 30, 2_000):
        got = alignment.align(df.repartition(3) if size > 2_000 else df.coalesce(1), A_PATH, B_PATH, block_bytes=size, bucket_bytes=size)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    pairs = alignment.pair_counts(df, A_PATH, B_PATH, bucket_bytes=100_000)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == held
    assert alignment.align(df.limit(0), A_PATH, B_PATH).count() == 0


def test_alignment_query(spark, tmp_path, odd_rows):
    rows = _odd(odd_rows)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in _align_all(rows)[0]]
    got = alignment.op13_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_groups_by_bisection():
    """Random intervals over the same bytes: borders are the ends that both sides have."""
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 60)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randrange(1, n + 1)), n}) for _ in "ab")
        got = alignment.groups(np.array(a), np.array(b))
        borders = [0, *sorted(set(a) & set(b))]
        assert [list(x) for x in got] == [[sum(lo < e <= hi for e in side) for lo, hi in itertools.pairwise(borders)] for side in (a, b)]
        first, last = alignment.overlaps(np.array(a), np.array(b))
        for i, (lo, hi) in enumerate(itertools.pairwise([0, *a])):
            assert [j for j, (s, e) in enumerate(itertools.pairwise([0, *b])) if s < hi and e > lo] == list(range(first[i], last[i] + 1))


def test_large_groups(monkeypatch):
    """A group of more links than are made at once goes by distinct tokens, with the same links."""
    state = alignment.Aligned(np.array([5, 6, 5, 7, 5]), np.array([1, 2, 1, 3]), np.array([4, 1]), np.array([3, 1]))
    state.a_size, state.b_size, state.n_groups = np.array([4, 1]), np.array([3, 1]), np.array([1, 1])

    def links():
        out = collections.Counter()
        for pair, times, segment in state.links():
            for p, t, s in zip(pair.tolist(), times.tolist(), segment.tolist(), strict=True):
                out[(p, s)] += t
        return out

    one = links()
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 3)
    assert links() == one and one.total() == 13
