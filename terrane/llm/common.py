"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.session import cut, ensure_checkpoint_dir, in_few  # noqa: F401

#: Lower-cases A-Z and turns every byte that is in no alphanumeric word into a space.
WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


#: Keeps every byte but white space, which becomes a space.
SPACED_BYTES = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n: the folds for learning and testing."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def in_fold(column: str, n: int, fold: int) -> Column:
    """Whether an id is in that fold; a null id is in none."""
    return F.coalesce(crc_mod(column, n) == fold, F.lit(False))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null gives no bytes."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or a single longer row."""
    for batch in batches:
        pa.default_memory_pool().release_unused()  # what earlier batches took
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        lengths = np.nan_to_num(pa.compute.binary_length(col).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        ends, first = np.cumsum(lengths), 0
        while first < len(lengths):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and n + 1 offsets into it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_volume(docs: DataFrame) -> int:
    """Bytes of text in all rows: one narrow scan, one number to the driver."""
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


def word_codes(data: np.ndarray, offsets: np.ndarray, table: bytes = WORD_BYTES, spans: bool = False) -> tuple[np.ndarray, ...]:
    """A 64-bit code for each word, with a 0 after each text, and the text each of these belongs to.

    ``table`` maps every byte to itself, to its lower case, or to a space where it separates words.
    """
    n_texts = len(offsets) - 1
    lower = np.frombuffer(table, np.uint8)[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = lower != 32
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cut = offsets[1:-1][offsets[1:-1] < len(data)]  # a word ends where its text does
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    # the first byte after each word: the next gap or the next text
    stops = ~inside
    stops[offsets[offsets <= len(data)]] = True
    stops = np.flatnonzero(stops)
    lengths = stops[np.searchsorted(stops, starts, "right")] - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = lower
    eight = np.ndarray(len(data), "<u8", padded, strides=(1,)) if len(data) else np.zeros(0, np.uint64)
    h = mix64((eight[starts] & _MASKS[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) * _GOLDEN))
    long = np.flatnonzero(lengths > 8)
    done = 8
    while len(long):
        at, left = starts[long] + done, np.minimum(lengths[long] - done, 8)
        h[long] = mix64(h[long] * _GOLDEN + (eight[at] & _MASKS[left]))
        done += 8
        long = long[lengths[long] > done]
    h[h == 0] = 1
    text = np.searchsorted(offsets, starts, "right") - 1
    codes = np.zeros(len(h) + n_texts, np.uint64)
    codes[np.arange(len(h)) + text] = h
    owner = np.repeat(np.arange(n_texts), np.bincount(text, minlength=n_texts) + 1)
    return (codes, owner, starts, lengths) if spans else (codes, owner)
