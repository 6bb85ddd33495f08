"""Audio columns: 8-bit WAV media, resampling, log-mel tensors and energy segments.

``encode_media`` turns a binary payload into a WAV file; ``audio_features`` reads stored WAV bytes
back, resamples them with a polyphase filter, takes overlapped log-mel frames as fixed-shape tensors
and segments the signal by energy with hysteresis. Both are narrow passes without a shuffle, clip by
clip, so one long clip costs memory in proportion to itself only.

A null payload gives a null medium and null features; an empty payload gives a WAV without samples,
no tensors and no segments. Equal payloads give equal results; an empty frame gives an empty frame.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

RATE = 16_000
TARGET_RATE = 10_000
FRAME, HOP, MELS, PATCH = 256, 160, 32, 32
HIGH_DB, LOW_DB = -14.0, -18.0
TAPS = 12  # of each phase

MEDIA_TYPE = T.BinaryType()
FEATURE_FIELDS = [
    T.StructField("payload", T.BinaryType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("tensors", T.BinaryType(), metadata={"arrow": "IPC stream: tensor fixed_shape_tensor<float>[32, 32], start_s, end_s"}),
    T.StructField("n_tensors", T.IntegerType()),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))),
]


# ---- stored form: RIFF/WAVE, PCM, mono, unsigned 8-bit -------------------------
def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    pad = b"\0" * (len(samples) & 1)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data) + len(samples) + len(pad), b"WAVE") + fmt + data + samples + pad


def read_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a stored 8-bit mono file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return rate, bytes(media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


# ---- signal -----------------------------------------------------------------------
@lru_cache
def phase_filters(up: int, down: int) -> np.ndarray:
    """Kaiser-windowed low-pass filter dealt to ``up`` phases; each row is reversed for a dot product."""
    n = up * TAPS
    t = np.arange(n) - n // 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * cut * np.kaiser(n + 1, 8.0)[:-1] * up
    return np.ascontiguousarray(h.reshape(TAPS, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase rational resampling: output n uses phase n*down mod up at input n*down // up, the filter centred there."""
    g = int(np.gcd(rate, target))
    up, down = target // g, rate // g
    if up == down or not x.size:
        return x
    filters = phase_filters(up, down)
    n_out = -(-x.size * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(TAPS - 1 - TAPS // 2, np.float32), x, np.zeros(TAPS // 2, np.float32)]), TAPS)
    y = np.empty(n_out, np.float32)
    for first in range(min(up, n_out)):  # outputs first, first + up, ... share one phase
        start = first * down
        y[first::up] = windows[start // up :: down][: len(range(first, n_out, up))] @ filters[start % up]
    return y


@lru_cache
def mel_matrix(rate: int) -> np.ndarray:
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), MELS + 2) / 2595.0) - 1.0)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(rise, fall)).astype(np.float32)


@lru_cache
def hann() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1].astype(np.float32)


def frames_of(y: np.ndarray) -> np.ndarray:
    n = max(1, -(-max(0, y.size - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: y.size] = y
    return np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]


def log_mel(frames: np.ndarray, rate: int) -> np.ndarray:
    out = np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), 1024):
        power = np.abs(np.fft.rfft(frames[at : at + 1024] * hann(), axis=1)).astype(np.float32) ** 2
        out[at : at + 1024] = np.log(power @ mel_matrix(rate) + 1e-6)
    return out


def energy_segments(frames: np.ndarray, rate: int, high_db: float = HIGH_DB, low_db: float = LOW_DB) -> list[tuple[float, float]]:
    """On at ``high_db`` or more, off below ``low_db``, else as the frame before."""
    db = 10 * np.log10(np.einsum("ij,ij->i", frames, frames) / FRAME + 1e-10)
    mark = np.where(db >= high_db, 1, np.where(db < low_db, 0, -1))
    known = np.where(mark >= 0, np.arange(mark.size), -1)
    held = np.maximum.accumulate(known)
    on = np.where(held >= 0, mark[held], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return [(float(a * HOP / rate), float(((b - 1) * HOP + FRAME) / rate)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def tensor_stream(mel: np.ndarray, rate: int) -> tuple[int, bytes]:
    """Patches of PATCH frames as an Arrow IPC stream of a fixed-shape tensor column and its time spans."""
    n = -(-len(mel) // PATCH)
    cube = np.full((n * PATCH, MELS), np.log(np.float32(1e-6)), np.float32)
    cube[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), [PATCH, MELS], dim_names=["frame", "mel"])
    tensor = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(cube.reshape(-1)), PATCH * MELS))
    start = np.arange(n) * PATCH * HOP / rate
    end = (np.minimum(np.arange(1, n + 1) * PATCH, len(mel)) - 1) * HOP / rate + FRAME / rate
    batch = pa.record_batch([tensor, pa.array(start), pa.array(end)], names=["tensor", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return n, sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patches x frames x mels, start_s, end_s) of a stored column value."""
    batch = pa.ipc.open_stream(stream).read_all().combine_chunks().to_batches()[0]
    return batch.column(0).to_numpy_ndarray(), batch.column(1).to_numpy(), batch.column(2).to_numpy()


def clip_features(media: bytes) -> tuple[bytes, float, bytes, int, list[dict]]:
    rate, samples = read_wav(media)
    if not samples:
        return samples, 0.0, b"", 0, []
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0) / 128.0
    y = resample(x, rate, TARGET_RATE)
    frames = frames_of(y)
    n, stream = tensor_stream(log_mel(frames, TARGET_RATE), TARGET_RATE)
    spans = [{"start_s": a, "end_s": b} for a, b in energy_segments(frames, TARGET_RATE)]
    return samples, len(samples) / rate, stream, n, spans


# ---- operators ------------------------------------------------------------------------
def text_payload(text, unit: int = 192):
    """Column: UTF-8 bytes with blanks appended up to a positive multiple of ``unit`` bytes."""
    body = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.length(body)
    want = F.greatest(F.lit(1), F.ceil(n / F.lit(float(unit)))) * unit
    return F.concat(body, F.encode(F.repeat(F.lit(" "), (want - n).cast("int")), "UTF-8"))


def encode_media(clips: DataFrame, id_col: str, payload_col: str = "payload") -> DataFrame:
    """id and media: the payload's bytes as the samples of a WAV file, byte for byte."""
    schema = T.StructType([T.StructField(id_col, clips.schema[id_col].dataType), T.StructField("media", MEDIA_TYPE)])

    def encode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                media = [None if p is None else wav_bytes(p) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=[id_col, "media"])

    return map_arrow(clips.select(id_col, payload_col), encode, schema)


def audio_features(clips: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """id, media, and what reading it back gives: payload, duration_s, tensors, n_tensors, segments."""
    schema = T.StructType([T.StructField(id_col, clips.schema[id_col].dataType), T.StructField("media", MEDIA_TYPE), *FEATURE_FIELDS])
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.binary(), pa.float64(), pa.binary(), pa.int32(), spans]

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [(None,) * 5 if m is None else clip_features(m) for m in part.column(1).to_pylist()]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.fieldNames())

    return map_arrow(clips.select(id_col, F.col(media_col).alias("media")), read, schema)
