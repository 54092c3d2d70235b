"""Audio columns: WAV bytes in a binary column, short-time Fourier transforms, spectral-peak pairs.

`as_wav` stores bytes losslessly as 8-bit mono samples through the wave module; `with_landmarks`
reads a WAV column back through the same module and adds an array of (time, code) pairs, where
time is a frame number and code joins two peak frequencies and the frames between them.

Defined cases: a null or empty text is stored as 64 zero bytes, which are the lowest value of 8-bit
samples; samples at rest (128) have no peaks and so empty arrays; equal texts give equal bytes and arrays, whatever batch they come in; no rows give
no rows. A null WAV gives null results.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, column, documents, written

RATE = 8000
BLOCK = 64
WINDOW = 128
FAN_OUT = 3
MOST_FRAMES_APART = 63
#: Frames that are transformed at a time; each slice overlaps the next by one frame on both sides.
SLICE = 4096


def wav_of(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def samples_of(wav: bytes) -> bytes:
    with wave.open(io.BytesIO(wav), "rb") as r:
        return r.readframes(r.getnframes())


def spectrogram(samples: np.ndarray) -> np.ndarray:
    """Log magnitudes, a row for each hop of BLOCK samples; bin 0 is left out."""
    x = samples.astype(np.float32) - 128
    x = np.concatenate([x, np.zeros(WINDOW - BLOCK, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::BLOCK]
    return np.log1p(np.abs(np.fft.rfft(frames * np.hanning(WINDOW).astype(np.float32), axis=1)))[:, 1:].astype(np.float32)


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of peak pairs. A peak is the loudest bin of its frame among its neighbours in time as well."""
    n = len(samples) // BLOCK
    best, loud = np.empty(n, np.int64), np.empty(n, np.float32)
    for at in range(0, n, SLICE):
        part = spectrogram(samples[at * BLOCK : (at + SLICE) * BLOCK + WINDOW - BLOCK])[: min(SLICE, n - at)]
        best[at : at + len(part)] = part.argmax(axis=1)
        loud[at : at + len(part)] = part.max(axis=1, initial=0)
    around = np.pad(loud, 1, constant_values=-1)
    t = np.flatnonzero((loud > 0) & (loud >= around[:-2]) & (loud >= around[2:]))
    f = best[t]
    times, codes = [], []
    for k in range(1, FAN_OUT + 1):
        gap = t[k:] - t[:-k]
        near = gap <= MOST_FRAMES_APART
        times.append(t[:-k][near])
        codes.append((f[:-k][near] << 12) | (f[k:][near] << 6) | gap[near])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def as_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded) and the column media (WAV bytes) of every row."""

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            raw = [x.as_py() or b"" for x in batch.column(1)]
            media = [wav_of(x + bytes(-len(x) % BLOCK or (0 if x else BLOCK))) for x in raw]
            yield pa.record_batch([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).cast("binary").alias("raw")).mapInArrow(encode, f"doc_id {kind}, n_bytes long, media binary")


def with_landmarks(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digests of what was read back, and the time-coded arrays of each WAV."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def features(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            rows = []
            for cell in batch.column(2):
                wav = cell.as_py()
                if wav is None:
                    rows.append((None,) * 7)
                    continue
                payload = samples_of(wav)
                times, codes = landmarks(np.frombuffer(payload, np.uint8))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(wav), hashlib.sha256(wav).hexdigest(), times, codes))
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(features, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>")


def op6_wav_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the audio column to the shared folder and returns what is read back from it."""
    out = with_landmarks(written(as_wav(documents(spark, sf_dir))))
    pairs = F.concat_ws(",", F.transform("times", lambda t: t.cast("string"))), F.concat_ws(",", F.transform("codes", lambda c: c.cast("string")))
    feature = F.concat_ws(":", F.size("codes").cast("string"), F.sha2(F.concat_ws(";", *pairs), 256))
    return out.withColumns({"feature": feature, "n_landmarks": F.size("codes")})


QUERIES = {"op6_wav_landmarks": op6_wav_landmarks}
ORACLES: dict[str, str] = {}
