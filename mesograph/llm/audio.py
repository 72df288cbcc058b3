"""Audio columns: lossless 8-bit wave files, log-mel features as fixed-shape tensors, energy segments.

``wave`` stores bytes as unsigned 8-bit mono samples in a RIFF file and ``samples`` reads them back. ``features``
resamples by a polyphase filter from RATE to RATE * UP / DOWN, cuts overlapping frames of FRAME samples every HOP,
takes the log energies of MELS triangular bands of their power spectrum, and stores them in windows of
FRAMES frames: an Arrow fixed-shape tensor FRAMES x MELS a window with its time span, the last one padded with
silence. Segments are runs of frames that begin where the energy reaches OPEN of the file's range and end where it
falls under CLOSE (hysteresis), with their time span.

All of it runs over BLOCK frames at a time with the filter's history carried along, so memory is bounded by the
stored bytes and the features. Values are rounded to 1/64 before they are stored: equal bytes give equal features
wherever they are computed.

Defined results: null and empty text are 64 zero bytes (payloads are padded with zero bytes to a positive multiple of
64); a constant signal has one range of zero and no segment; repeated rows each give a row; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, sha256, table, utf8

UNIT = 64
RATE, UP, DOWN, TAPS = 16000, 5, 8, 12
FRAME, HOP, FFT, MELS, FRAMES, BLOCK = 256, 128, 256, 24, 32, 2048
OPEN, CLOSE = 0.6, 0.4
RESAMPLED = RATE * UP // DOWN
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT or (UNIT if not text else 0))


def wave(data: bytes, rate: int = RATE) -> bytes:
    return _HEADER.pack(b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(data)) + data


def samples(media: bytes) -> bytes:
    """The stored bytes of an 8-bit mono wave file."""
    head = _HEADER.unpack_from(media)
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[5:7] != (1, 1) or head[10] != 8 or len(media) != _HEADER.size + head[12]:
        raise ValueError("not an 8-bit mono wave file")
    return media[_HEADER.size :]


@cache
def phases() -> np.ndarray:
    """The low-pass filter's UP phases, each 2 * TAPS long and of sum 1: a windowed sinc at the lower rate's limit."""
    n = 2 * TAPS * UP
    at = (np.arange(n) - (n - 1) / 2) / UP
    cut = min(1.0, UP / DOWN)
    h = (cut * np.sinc(cut * at) * np.hamming(n)).reshape(2 * TAPS, UP).T[:, ::-1]
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


@cache
def bands() -> np.ndarray:
    """Triangles of equal width on the mel scale, over the bins of the spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RESAMPLED / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / RESAMPLED)[:, None]
    rise, fall = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resample(signal: np.ndarray, first: int, last: int) -> np.ndarray:
    """Outputs first to last of the resampled signal; first is a multiple of UP. Silence lies around the signal."""
    periods = -(-(last - first) // UP)
    start = first // UP * DOWN
    reach = start + periods * DOWN + TAPS
    low, high = max(0, start - TAPS), min(len(signal), reach)
    x = np.zeros(reach - start + TAPS, dtype=np.float32)
    if high > low:
        x[low - (start - TAPS) : high - (start - TAPS)] = signal[low:high]
    out, h = np.empty((periods, UP), dtype=np.float32), phases()
    for p in range(UP):
        shift = p * DOWN // UP + 1
        some = np.lib.stride_tricks.as_strided(x[shift:], (periods, 2 * TAPS), (DOWN * x.itemsize, x.itemsize))
        out[:, p] = some @ h[p * DOWN % UP]
    return out.reshape(-1)[: last - first]


def log_mel(data: bytes) -> np.ndarray:
    """Frames x MELS, rounded to 1/64."""
    signal = np.frombuffer(data, dtype=np.uint8).astype(np.float32) / 128 - 1
    length = -(-len(signal) * UP // DOWN)
    frames = 1 + max(0, -(-(length - FRAME) // HOP))
    window = np.hanning(FRAME).astype(np.float32)
    out = np.empty((frames, MELS), dtype=np.float32)
    step = BLOCK - BLOCK % UP  # HOP * step is a multiple of UP
    for k in range(0, frames, step):
        n = min(step, frames - k)
        x = resample(signal, k * HOP, k * HOP + (n - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.as_strided(x, (n, FRAME), (HOP * x.itemsize, x.itemsize))
        power = np.abs(np.fft.rfft(cut * window, FFT)) ** 2
        out[k : k + n] = np.log(power @ bands() + 1e-6)
    return np.round(out * 64) / 64


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of frames above the hysteresis limits."""
    energy = mel.sum(axis=1)
    low, high = float(energy.min()), float(energy.max())
    if high == low:
        return []
    above, below = energy >= low + OPEN * (high - low), energy < low + CLOSE * (high - low)
    # the state after each frame is that of the last frame which decides: 1 opens, 0 closes
    decides = np.where(above, 1, np.where(below, 0, -1))
    last = np.maximum.accumulate(np.where(decides >= 0, np.arange(len(mel)), -1))
    on = np.where(last >= 0, decides[np.maximum(last, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray) -> pa.RecordBatch:
    """The windows as a fixed-shape tensor column with the span in seconds of each."""
    n = -(-len(mel) // FRAMES)
    laid = np.full((n * FRAMES, MELS), np.float32(np.round(np.log(1e-6) * 64) / 64))
    laid[: len(mel)] = mel
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(laid.reshape(n, FRAMES, MELS))
    begin = np.arange(n) * FRAMES * HOP / RESAMPLED
    end = np.minimum(np.arange(1, n + 1) * FRAMES, len(mel) - 1 + FRAME / HOP) * HOP / RESAMPLED
    return pa.RecordBatch.from_arrays([column, pa.array(begin), pa.array(end)], names=["log_mel", "begin_s", "end_s"])


def stored(batch: pa.RecordBatch) -> bytes:
    """A record batch as an Arrow stream, the form in which tensors lie in a binary column."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def loaded(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


FEATURES = "doc_id long, n_bytes long, media binary, tensors binary, n_frames int, segments array<struct<begin_s: double, end_s: double>>"


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", then=None, schema: str = FEATURES) -> DataFrame:
    """One row a document (FEATURES): its wave file, tensors of the bytes read back from it, and segments.

    ``then`` may turn the record batches into others of another ``schema`` in the same worker, so that files
    needn't leave it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            media = [wave(payload(t)) for t in texts]
            mels = [log_mel(samples(m)) for m in media]
            spans = [[{"begin_s": a * HOP / RESAMPLED, "end_s": ((b - 1) * HOP + FRAME) / RESAMPLED} for a, b in segments(m)] for m in mels]
            span = pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())]))
            columns = [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary()), pa.array([stored(tensors(m)) for m in mels], pa.binary()), pa.array(map(len, mels), pa.int32()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media", "tensors", "n_frames", "segments"])

    work = (lambda batches: then(run(batches))) if then else run
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("text")).mapInArrow(work, schema)


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long"


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column("media").to_pylist()
        data = [samples(m) for m in media]
        feature = []
        for t, s in zip(batch.column("tensors").to_pylist(), batch.column("segments").to_pylist(), strict=True):
            mel = loaded(t).column("log_mel").to_numpy_ndarray()
            feature.append(f"{mel.shape[0]}x{mel.shape[1]}x{mel.shape[2]};{len(s)};" + hashlib.sha256(np.ascontiguousarray(mel, dtype="<f4").tobytes() + repr([(x["begin_s"], x["end_s"]) for x in s]).encode()).hexdigest()[:32])
        columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(map(len, data), pa.int64()), pa.array(map(sha256, data)), pa.array([zlib.crc32(d[-UNIT:]) for d in data], pa.int64()), pa.array(map(len, media), pa.int64()), pa.array(map(sha256, media)), pa.array(feature), batch.column("n_frames").cast(pa.int64()), pa.array([len(s) for s in batch.column("segments").to_pylist()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _DIGESTS.split(", ")])


def op3_audio(spark, sf_dir: str) -> DataFrame:
    return features(table(spark, sf_dir, "documents"), then=_digests, schema=_DIGESTS)
