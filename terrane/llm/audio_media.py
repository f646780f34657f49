"""Media columns: texts stored as WAV, and spectral-peak pair fingerprints of what is read back.

A payload of bytes becomes the samples of an 8-bit mono WAV file, written and read by the ``wave`` module. From the
samples read back: short-time Fourier transforms over frames of ``frame`` samples at steps of ``hop`` (half a frame, so
that every sample counts), the strongest local peaks of each frame, and pairs of each peak with the peaks of the frames after it. A pair's fingerprint is
an integer of the two frequencies and the frames between; the column holds, in order of time, the frame of the anchor
in the upper 32 bits and the fingerprint in the lower 32.

Null texts are empty. Payloads are padded with blanks (32) to a positive multiple of 192. Equal texts give equal
columns. Samples are worked through in stretches of bounded size, so a long text costs time, not memory.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import documents, id_and_text, slices

UNIT = 192
RATE = 8000
FRAME = 96
HOP = 48
PEAKS = 2
AHEAD = 2
STRETCH = 4096  # frames


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not an 8-bit mono file")
        return w.readframes(w.getnframes())


def _peaks(samples: np.ndarray, frame: int, hop: int, peaks: int) -> np.ndarray:
    """Frequencies (bins) of the strongest local maxima of each frame, strongest first."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    window = np.hanning(frame)
    out = np.empty((len(frames), peaks), np.int64)
    for c in range(0, len(frames), 512):
        part = (frames[c : c + 512].astype(np.float64) - 128) * window
        power = np.abs(np.fft.rfft(part, axis=1)).round(3)  # rounded: the same on any machine
        power[:, :2] = 0
        local = np.zeros_like(power)
        middle = power[:, 1:-1]
        local[:, 1:-1] = np.where((middle >= power[:, :-2]) & (middle > power[:, 2:]), middle, 0)
        for k in range(peaks):
            best = local.argmax(axis=1)
            out[c : c + 512, k] = best
            local[np.arange(len(best)), best] = 0
    return out


def fingerprints(payload: bytes, frame: int = FRAME, hop: int = HOP, peaks: int = PEAKS, ahead: int = AHEAD) -> np.ndarray:
    """Time-coded pairs of spectral peaks."""
    samples = np.frombuffer(payload, np.uint8)
    if len(samples) < frame:
        return np.zeros(0, np.int64)
    n = (len(samples) - frame) // hop + 1
    out = []
    for c in range(0, n, STRETCH):
        last = min(c + STRETCH + ahead, n)
        found = _peaks(samples[c * hop : (last - 1) * hop + frame], frame, hop, peaks)
        mine = min(STRETCH, n - c)
        codes = np.full((mine, ahead, peaks, peaks), -1, np.int64)
        for d in range(1, ahead + 1):
            both = max(0, min(mine, len(found) - d))
            time = np.arange(c, c + both)[:, None, None]
            anchor, target = found[:both, :, None], found[d : d + both, None, :]
            pair = (time << 32) | (anchor << 20) | (target << 8) | d
            codes[:both, d - 1] = np.where((anchor > 0) & (target > 0), pair, -1)
        flat = codes.reshape(-1)
        out.append(flat[flat >= 0])
    return np.concatenate(out)


def _rows(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    yield from slices(batches, column, 4 << 20)


def _encode(batches):
    for batch in _rows(batches, "text"):
        texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.large_binary())]
        media = [to_wav(payload_of(x)) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())],
            names=["doc_id", "n_bytes", "media"],
        )


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media (the WAV file) for every row."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _analyse(batches):
    for batch in _rows(batches, "media"):
        payloads = [from_wav(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns, pa.array(payloads, pa.binary()),
                pa.array([fingerprints(x) for x in payloads], pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_bytes", "media", "payload", "fingerprints"],
        )


def analyse_media(media: DataFrame) -> DataFrame:
    """The result of :func:`to_media` with the payload read back from each file, and its time-coded fingerprints."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _analyse, "doc_id long, n_bytes long, media binary, payload binary, fingerprints array<long>"
    )


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    read = analyse_media(to_media(documents(spark, sf_dir)))
    n = F.octet_length("payload").cast("long")
    codes = F.transform("fingerprints", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))
    feature = F.concat_ws(
        ":", F.size("fingerprints").cast("string"), F.md5(F.array_join(F.col("fingerprints").cast("array<string>"), ",")),
        F.lower(F.hex(F.coalesce(F.get(codes, F.lit(0)), F.lit(0)))),
    )
    return read.select(
        "doc_id", "n_bytes", n.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def brute_force(rows: list[tuple]) -> list[tuple]:
    """All columns but the feature, for tests."""
    import hashlib

    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        payload = payload_of(data)
        media = to_wav(payload)
        out.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()))
    return out
