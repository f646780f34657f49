"""Texts as places in a dictionary of their block's distinct words.

A task takes its texts in blocks of bounded size. Of each block it gives the distinct words, once each and numbered as they
come, and for each text the numbers of its words. So what is known of a word is found once a block by an equality on the
word, and goes back to all its places in all texts by one number; no row is made for a place in a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import slices, text_volume, word_codes

#: Bytes of text after which a block is full. A longer text is a block of its own.
BLOCK_BYTES = 16 << 20


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte of all, compressed: small numbers cost little more than a byte."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True) if planes.size else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of :func:`packed`."""
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def rows_of(schema: str, values: dict) -> pa.RecordBatch:
    """One row of a schema whose columns are whole numbers, binaries, texts, or arrays of them."""
    fields = [part.split() for part in schema.split(", ")]
    kind = lambda name: pa.list_(_KINDS[name[6:-1]]) if name.startswith("array<") else _KINDS[name]
    return pa.RecordBatch.from_arrays([pa.array([values[name]], kind(k)) for name, k in fields], names=[name for name, _ in fields])


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``starts`` and are ``counts`` long, one range after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def with_task(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text) and the number of the scan's task, by which :func:`blocks` number their blocks."""
    return texts.select("doc_id", "text", F.shiftleft(F.spark_partition_id().cast("long"), 32).alias("task"))


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Number and parts of each block of a task, from rows of :func:`with_task`. Use up the parts before the next block.

    A part is some 4 MB of text, or one longer text; a block ends with the part that makes it ``most`` bytes or more.
    """
    parts = slices(batches)
    ahead = next(parts, None)

    def block():
        nonlocal ahead
        size = 0
        while ahead is not None and size < most:
            part, size = ahead, size + ahead.column(1).nbytes
            yield part
            ahead = next(parts, None)

    number = 0
    while ahead is not None:
        yield ahead.column(2)[0].as_py() + number, block()
        number += 1


#: Bytes of text for each bucket of words. A block gives a row for each bucket that it has words of.
BUCKET_BYTES = 1 << 20
_SAME = bytes(range(256))


def bucket_count(texts: DataFrame, each: int = BUCKET_BYTES) -> int:
    """Buckets in proportion to all text, so that the words of one bucket fit a task at every size."""
    return max(1, text_volume(texts) // each)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of an array without nulls, and n + 1 offsets into them."""
    column = column.cast(pa.large_string())
    buffers, n = column.buffers(), len(column)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; words hold no blank."""
    data, offsets = string_buffers(words)
    codes, owner = word_codes(data, offsets, _SAME)
    out = np.zeros(len(words), np.uint64)
    out[owner[codes != 0]] = codes[codes != 0]
    return out


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the keys by their bucket, and (bucket, first, last) of each bucket in that order."""
    bucket = (keys.astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    of = bucket[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    return order, list(zip(of[first].tolist(), first.tolist(), np.append(first[1:], len(of)).tolist(), strict=True))
