"""Alignment of two tokenizers: which tokens of one stand where which of the other do, in each text and in the whole corpus.

Both tokenizers cover the same bytes. B's tokens are a static index of intervals; every token of A is looked up in it by
bisection, which gives the B tokens that it overlaps. Gaps that no token of either spans are the borders of groups; the A and B tokens of a
group are linked, each with each.

Texts are cut before single blanks between characters that are surely no white space. Neither tokenizer's tokens cross such a place:
A's splitting pattern ends a word there, and B has no piece with a blank behind another character (checked on the model). So it is a gap
of both, and a distinct segment of a block is tokenized and aligned once. Where a segment's tokens do not give back its
bytes, the text is tokenized as a whole.

How many texts hold a pair is counted by block first; a block sends each distinct pair once, packed, to the pair's
bucket, and gets the corpus-wide number back. The greatest number of each A token is a table no larger than A's vocabulary.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.bpe_table import public_path
from terrane.llm.common import cut, documents, id_and_text, mix64
from terrane.llm.word_blocks import BLOCK_BYTES, BUCKET_BYTES, blocks, bucket_count, by_bucket, packed, rows_of, spans, unpacked, with_task

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters beside which a blank is no safe place to cut: white space by any definition, controls, and what is not seen.
_UNSAFE = r"\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff\u2581"
CUTS = re.compile(f"(?<=[^{_UNSAFE}]) (?=[^{_UNSAFE}])")
#: Links that are made at once. Larger groups are gone through by distinct tokens.
LINKS_AT_ONCE = 1 << 21


@dataclass
class Side:
    """A tokenizer: ``encode`` gives ids of texts, ``data`` and ``starts`` the bytes of each id's token."""

    encode: object
    data: np.ndarray
    starts: np.ndarray

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.starts[ids + 1] - self.starts[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spans(self.starts[ids], self.sizes(ids))]


def _side(encode, tokens: list[bytes]) -> Side:
    return Side(encode, np.frombuffer(b"".join(tokens), np.uint8), np.append(0, np.cumsum([len(t) for t in tokens])))


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies use for each byte: printable ones stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def side_a(path: str) -> Side:
    """A byte-level BPE file; strings of its special tokens inside texts are plain text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    reader, letters = Tokenizer.from_file(path), byte_letters()
    reader.no_truncation()
    reader.no_padding()
    reader.encode_special_tokens = True
    tokens = [b""] * (max(reader.get_vocab(with_added_tokens=True).values()) + 1)
    for token, i in reader.get_vocab(with_added_tokens=False).items():
        tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    quick = _by_ranks(path, letters)

    def encode(texts: list[str]) -> list[list[int]]:
        out = [quick(" " + t) if quick and max(t, default="") < _FIRST_RARE else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, reader.encode_batch([" " + texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    return _side(encode, tokens)


#: Latin letters, digits and marks below this are of the same classes in every edition of Unicode that libraries may follow.
_FIRST_RARE = "\u0250"


def _by_ranks(path: str, letters: dict[str, int]):
    """A quicker encoder of the same vocabulary, if its ids are the order of its merges and its splitting pattern is the usual one."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    usual = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and spec["normalizer"] is None
    usual &= not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not usual or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or any(vocabulary.get(c, 256) > 255 for c in letters):
        return None
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.cache
def side_b(path: str) -> Side:
    """A sentencepiece model, which puts a blank before each text itself."""
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [reader.id_to_piece(i) for i in range(reader.get_piece_size())]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError(f"{path}: a piece holds a blank behind another character")
    tokens = [bytes([int(p[3:5], 16)]) if reader.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return _side(lambda texts: reader.encode(texts, num_threads=1), tokens)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last B token that each A token overlaps. Both sides' tokens follow each other from 0, and are given by their ends."""
    a_starts = np.append(0, a_ends[:-1]) if len(a_ends) else a_ends
    return np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_ends, a_ends, "left")


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B tokens of each group. An A token's end is a border if the last B token that it overlaps ends there too."""
    _, last = overlaps(a_ends, b_ends)
    border = np.flatnonzero(b_ends[last] == a_ends) if len(a_ends) else np.zeros(0, np.int64)
    return np.diff(border, prepend=-1), np.diff(last[border], prepend=-1)


def _joined(values: pa.Array, counts: np.ndarray, between: str) -> pa.Array:
    """Texts of as many values each, one after the other."""
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), between)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats; whole numbers sort faster than they hash."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


@dataclass
class Aligned:
    """Segments one after the other: ids of both sides, the tokens of each segment, and A and B tokens of the groups of all."""

    a: np.ndarray
    b: np.ndarray
    a_count: np.ndarray
    b_count: np.ndarray

    def __post_init__(self):
        self.a_size = self.b_size = self.n_groups = np.zeros(0, np.int64)

    def find(self, one: Side, other: Side) -> None:
        a_ends = np.cumsum(one.sizes(self.a))
        self.a_size, self.b_size = groups(a_ends, np.cumsum(other.sizes(self.b)))
        last = np.cumsum(self.a_size)  # A tokens up to the end of each group
        self.n_groups = np.diff(np.searchsorted(last, np.cumsum(self.a_count), "right"), prepend=0)

    def written(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each segment."""
        sides = [_joined(pa.array(ids).cast(pa.string()), sizes, ",") for ids, sizes in ((self.a, self.a_size), (self.b, self.b_size))]
        return _joined(pc.binary_join_element_wise(*sides, "|"), self.n_groups, ";").to_pylist()

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of ids (a * 2^32 + b), how many links of a segment's group they are, and the segment; a few million at a time."""
        segment = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        a_start, b_start = np.cumsum(self.a_size) - self.a_size, np.cumsum(self.b_size) - self.b_size
        product = self.a_size * self.b_size
        small = np.flatnonzero(product <= LINKS_AT_ONCE)
        total, first = np.cumsum(product[small]), 0
        while first < len(small):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + LINKS_AT_ONCE, "right")))
            at = small[first:last]
            first = last
            of = np.repeat(np.arange(len(at)), self.a_size[at])  # a group of ``at`` for each A token
            a = spans(a_start[at], self.a_size[at])
            b = spans(b_start[at][of], self.b_size[at][of])
            a, of = np.repeat(a, self.b_size[at][of]), np.repeat(of, self.b_size[at][of])
            yield (self.a[a] << 32) | self.b[b], np.ones(len(a), np.int64), segment[at][of]
        for g in np.flatnonzero(product > LINKS_AT_ONCE).tolist():
            a, a_times = np.unique(self.a[a_start[g] : a_start[g] + self.a_size[g]], return_counts=True)
            b, b_times = np.unique(self.b[b_start[g] : b_start[g] + self.b_size[g]], return_counts=True)
            for x, times in zip(a.tolist(), a_times.tolist(), strict=True):
                yield (x << 32) | b, times * b_times, np.full(len(b), segment[g])


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def aligned(one: Side, other: Side, texts: list[str]) -> tuple[Aligned, np.ndarray]:
    """Tokens of the texts' segments, or of whole texts, and which of these do not give back their bytes on both sides (they have none)."""
    a, b = one.encode(texts), other.encode(texts)
    out = Aligned(_flat(a), _flat(b), np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64))
    data = [b" " + t.encode() for t in texts]
    bad, sizes = np.zeros(len(texts), bool), np.array([len(x) for x in data], np.int64)
    want = np.frombuffer(b"".join(data), np.uint8)
    for side, ids, count in ((one, out.a, out.a_count), (other, out.b, out.b_count)):
        got = np.add.reduceat(np.append(side.sizes(ids), 0), np.append(0, np.cumsum(count))[:-1]) * (count > 0) if len(count) else count
        bad |= got != sizes
        same = spans((np.cumsum(sizes) - sizes)[~bad], sizes[~bad])
        kept = np.repeat(~bad, count)
        unlike = side.joined(ids[kept]) != want[same]
        if unlike.any():
            bad[np.flatnonzero(~bad)[np.searchsorted(np.cumsum(sizes[~bad]), np.flatnonzero(unlike), "right")]] = True
    out.a, out.b = out.a[np.repeat(~bad, out.a_count)], out.b[np.repeat(~bad, out.b_count)]
    out.a_count[bad] = out.b_count[bad] = 0
    out.find(one, other)
    return out, bad


class _Block:
    """Segments of a block: their numbers by their text, and what was found of each."""

    def __init__(self, one: Side, other: Side):
        self.one, self.other = one, other
        self.place: dict = {}
        self.parts: list[Aligned] = []
        self.bad, self.stats, self.written = np.zeros(0, bool), np.zeros((4, 0), np.int64), []
        self.number: dict = {}  # of each pair of ids
        self.n_docs = np.zeros(0, np.int64)
        self.held_starts, self.held_counts, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, texts: list[str]) -> None:
        found, bad = aligned(self.one, self.other, texts)
        n_links, codes, owners = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for pair, times, segment in found.links():
            n_links += np.bincount(segment, times, len(texts)).astype(np.int64)
            codes.append(pair)
            owners.append(segment)
        codes = np.concatenate(codes)
        pairs = distinct(codes)
        once = distinct(np.concatenate(owners) * max(1, len(pairs)) + np.searchsorted(pairs, codes))  # each pair of a segment
        number = np.fromiter((self.number.setdefault(p, len(self.number)) for p in pairs.tolist()), np.int64, len(pairs))
        counts = np.bincount(once // max(1, len(pairs)), minlength=len(texts))
        self.held_starts = np.append(self.held_starts, len(self.held) + np.cumsum(counts) - counts)
        self.held_counts = np.append(self.held_counts, counts)
        self.held = np.append(self.held, number[once % max(1, len(pairs))])
        self.n_docs = np.append(self.n_docs, np.zeros(len(self.number) - len(self.n_docs), np.int64))
        self.parts.append(found)
        self.bad = np.append(self.bad, bad)
        self.stats = np.concatenate([self.stats, [found.a_count, found.b_count, found.n_groups, n_links]], axis=1)
        self.written += found.written()

    def texts(self, texts: list[str | None]) -> list[list[int]]:
        """Numbers of the segments of each text; texts that have no tokens have none."""
        place, fresh = self.place, len(self.place)
        refs = [[place.setdefault(s, len(place)) for s in CUTS.split(t)] if t else [] for t in texts]
        if len(place) > fresh:
            self._add(list(place)[fresh:])
        for i, numbers in enumerate(refs):
            if numbers and self.bad[numbers].any():
                whole = (texts[i],)  # not a text's segment: a text as a whole
                if whole not in place:
                    place[whole] = len(place)
                    self._add([texts[i]])
                refs[i] = [] if self.bad[place[whole]] else [place[whole]]
        self._count(refs)
        return refs

    def _count(self, refs: list[list[int]]) -> None:
        """Count each pair once for each text that holds it."""
        size = [len(x) for x in refs]
        flat, owner = _flat(refs), np.repeat(np.arange(len(refs)), size)
        if not len(flat):
            return
        once = distinct(owner * len(self.place) + flat)
        flat, owner = once % len(self.place), once // len(self.place)
        held, count = self.held[spans(self.held_starts[flat], self.held_counts[flat])], self.held_counts[flat]
        once = distinct(np.repeat(owner, count) * len(self.n_docs) + held)
        self.n_docs += np.bincount(once % max(1, len(self.n_docs)), minlength=len(self.n_docs))


_READ = "block long, kind int, bucket long, n long, numbers binary, more binary, doc_ids array<long>, stats array<long>, written array<string>"
#: Kinds of rows: texts of a block, its segments' tokens, its pairs in one bucket, and what that bucket says of them.
TEXTS, SEGMENTS, PAIRS, COUNTS = range(4)


def _read(a_path: str, b_path: str, buckets: int, most: int, digest: bool):
    def of(batches):
        one, other = side_a(a_path), side_b(b_path)
        row = lambda **values: rows_of(_READ, {"bucket": -1, "more": None, "doc_ids": [], "stats": [], "written": []} | values)
        for block, parts in blocks(batches, most):
            state = _Block(one, other)
            for part in parts:
                refs = state.texts(part.column(1).to_pylist())
                size = np.array([len(x) for x in refs], np.int64)
                flat, owner = _flat(refs), np.repeat(np.arange(len(refs)), size)
                stats = np.array([np.bincount(owner, s[flat], len(refs)) for s in state.stats]).astype(np.int64)
                written = [";".join([state.written[i] for i in x]) for x in refs]
                if digest:
                    written = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
                numbers = np.append(size, flat)
                yield row(block=block, kind=TEXTS, n=len(numbers), numbers=packed(numbers), doc_ids=part.column(0).to_pylist(), stats=stats.ravel().tolist(), written=written)
            a, b = (np.concatenate([getattr(p, side) for p in state.parts] or [np.zeros(0, np.int64)]) for side in "ab")
            counts = np.concatenate([[x for p in state.parts for x in p.a_count], [x for p in state.parts for x in p.b_count]]).astype(np.int64)
            numbers = np.concatenate([counts, a, b])
            yield row(block=block, kind=SEGMENTS, n=len(counts) // 2, numbers=packed(numbers), more=len(numbers).to_bytes(8, "little"))
            pairs = np.fromiter(state.number, np.int64, len(state.number))
            in_order = np.argsort(pairs)
            pairs, n_docs = pairs[in_order], state.n_docs[in_order]
            order, found = by_bucket(mix64(pairs), buckets)
            pairs, n_docs = pairs[order], n_docs[order]
            for bucket, first, last in found:
                mine = pairs[first:last]
                numbers = np.concatenate([mine >> 32, mine & 0xFFFFFFFF, n_docs[first:last]])
                yield row(block=block, kind=PAIRS, bucket=bucket, n=last - first, numbers=packed(numbers))

    return of


_COUNTED = "block long, n long, numbers binary, a array<int>, b array<int>, totals array<long>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a bucket its pairs with their numbers over all blocks; with block -1, each of the bucket's pairs once."""
    rows, codes, times = [], [], []
    for batch in batches:
        for row in batch.select(["block", "n", "numbers"]).to_pylist():
            a, b, n = np.split(unpacked(row["numbers"], 3 * row["n"]), 3)
            rows.append(row["block"])
            codes.append((a << 32) | b)
            times.append(n)
    pairs, number = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(number, np.concatenate(times), len(pairs)).astype(np.int64)
    yield rows_of(_COUNTED, {"block": -1, "n": len(pairs), "numbers": None, "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "totals": total})
    first = 0
    for block, code in zip(rows, codes, strict=True):
        mine = total[number[first : first + len(code)]]
        first += len(code)
        numbers = packed(np.concatenate([code >> 32, code & 0xFFFFFFFF, mine]))
        yield rows_of(_COUNTED, {"block": block, "n": len(code), "numbers": numbers, "a": [], "b": [], "totals": []})


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _finish(a_path: str, b_path: str, best: np.ndarray):
    """Sums over the links of each text of a block. ``best``: the greatest count of each A id."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, segments, codes, totals = [], None, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == TEXTS:
                    texts.append(row)
                elif row["kind"] == SEGMENTS:
                    segments = row
                else:
                    a, b, n = np.split(unpacked(row["numbers"], 3 * row["n"]), 3)
                    codes.append((a << 32) | b)
                    totals.append(n)
        codes, totals = np.concatenate(codes), np.concatenate(totals)
        order = np.argsort(codes)
        codes, totals = codes[order], totals[order]
        m = segments["n"]
        numbers = unpacked(segments["numbers"], int.from_bytes(segments["more"], "little"))
        a_count, b_count = numbers[:m], numbers[m : 2 * m]
        a, b = np.split(numbers[2 * m :], [int(a_count.sum())])
        found = Aligned(a, b, a_count, b_count)
        found.find(side_a(a_path), side_b(b_path))
        sums = np.zeros((2, m), np.int64)
        for pair, times, segment in found.links():
            n = totals[np.searchsorted(codes, pair)]
            sums[0] += np.bincount(segment, times * (n == best[pair >> 32]), m).astype(np.int64)
            sums[1] += np.bincount(segment, times * n, m).astype(np.int64)
        for row in texts:
            docs = len(row["doc_ids"])
            size, flat = np.split(unpacked(row["numbers"], row["n"]), [docs])
            owner = np.repeat(np.arange(docs), size)
            more = [np.bincount(owner, s[flat], docs).astype(np.int64) for s in sums]
            columns = [row["doc_ids"], *np.array(row["stats"], np.int64).reshape(4, docs), *more]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns], pa.array(row["written"], pa.string())], names=[part.split()[0] for part in _RESULT.split(", ")]
            )

    return of


def _states(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, block_bytes: int, bucket_bytes: int, digest: bool):
    texts = with_task(id_and_text(docs, id_col, text_col))
    read = cut(texts.mapInArrow(_read(a_path, b_path, bucket_count(texts, bucket_bytes), block_bytes, digest), _READ))
    return read, cut(read.where(F.col("kind") == PAIRS).select("bucket", "block", "n", "numbers").groupBy("bucket").applyInArrow(_counted, _COUNTED))


def pair_counts(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """a, b, n: each pair of token ids that is linked in any text, and how many texts hold it."""
    return _pairs(_states(docs, a_path, b_path, id_col, text_col, block_bytes, bucket_bytes, True)[1])


def _pairs(counted: DataFrame) -> DataFrame:
    return counted.where("block < 0").select(F.explode(F.arrays_zip("a", "b", "totals")).alias("x")).select("x.a", "x.b", F.col("x.totals").alias("n"))


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
    digest: bool = False,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups for every row of ``docs``.

    A group's text is its A ids, ``|``, its B ids, each in order, joined by commas; groups are joined by ``;`` (with ``digest``: the
    SHA-256 of that, as it need not leave the task then). A link is an A and a B token occurrence of one group; its count is the
    number of rows that hold a link of the same two ids; ``n_best`` links have the greatest count of their A id, ties included.

    Texts that are null or empty, or that the tokens of either side do not give back, have no tokens: zeros and an empty
    text. Repeated rows count as often as they stand there; rows without an id take part. No rows give no rows.
    """
    read, counted = _states(docs, a_path, b_path, id_col, text_col, block_bytes, bucket_bytes, digest)
    # a row for each id of A's vocabulary at most
    most = _pairs(counted).groupBy("a").agg(F.max("n").alias("n")).collect()
    best = np.zeros(len(side_a(a_path).starts), np.int64)
    for row in most:
        best[row.a] = row.n
    back = counted.where("block >= 0").select("block", F.lit(COUNTS).alias("kind"), "n", "numbers")
    nothing = {"more": F.lit(None).cast("binary"), "doc_ids": F.array().cast("array<long>"), "stats": F.array().cast("array<long>"), "written": F.array().cast("array<string>")}
    whole = read.where(F.col("kind").isin(TEXTS, SEGMENTS)).drop("bucket").unionByName(back.withColumns(nothing))
    return whole.groupBy("block").applyInArrow(_finish(a_path, b_path, best), _RESULT)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    found = align(documents(spark, sf_dir), public_path(A_FILE), public_path(B_FILE), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
