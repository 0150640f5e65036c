"""Media columns: bytes kept as 8-bit mono WAV samples, and audio features of them.

For each clip: polyphase resampling by a windowed-sinc filter, a log-mel filterbank
over overlapped Hann frames, and segmentation of the frame energy with two
thresholds (a segment opens above the high one and closes below the low one). The
features are a tensor of fixed shape ``(FRAMES, MELS)``, the log-mel frames averaged
over equal spans of the clip, kept as a flat list whose Arrow type is
``fixed_shape_tensor``; the segments are time spans in seconds.

Every clip is computed by itself, so equal payloads give equal values whatever else
is in the batch. Edge cases: null and empty texts are 192 spaces; a silent or
constant clip has no segment above its floor and one tensor of the floor's value;
long clips are processed in blocks, so memory is bounded by the clip's own bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 192
RATE = 8000
UP, DOWN, TAPS = 3, 4, 24
WINDOW, HOP, MELS, FRAMES = 256, 128, 24, 8
LOW_DB, HIGH_DB = 0.3, 1.0
#: Resampled samples in one block of frames.
BLOCK = 1 << 18


def pad_payload(data: bytes, unit: int = UNIT) -> bytes:
    """Spaces up to a positive multiple of ``unit``."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b" ")


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """RIFF/WAVE, PCM, mono, unsigned 8 bit."""
    pad = len(payload) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return head + payload + b"\0" * pad


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate; raises ValueError for what isn't 8-bit mono PCM."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] + 8 != len(media):
        raise ValueError("not a WAVE file of the stated length")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + n > len(media):
            raise ValueError("a chunk is cut short")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            if rate is None:
                raise ValueError("data before format")
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


@lru_cache
def polyphase_bank(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """One row of ``taps`` coefficients for each output phase; every row sums to 1."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    h = np.sinc(t * cutoff) * cutoff * np.hamming(n)
    bank = h.reshape(taps, up).T
    return np.ascontiguousarray((bank / bank.sum(axis=1, keepdims=True))[:, ::-1], dtype=np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``x`` at ``up / down`` of its rate: output k is the dot product of one phase with the samples around k * down / up."""
    bank = polyphase_bank(up, down)
    taps = bank.shape[1]
    n = len(x) * up // down
    padded = np.pad(x, (taps // 2, taps))
    views = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, dtype=np.float32)
    for first in range(up):
        k = np.arange(first, n, up)
        if len(k):
            at, phase = (first * down) // up, (first * down) % up
            out[first::up] = views[at :: down][: len(k)] @ bank[phase]
    return out


@lru_cache
def mel_bank(rate: float = RATE * UP / DOWN, window: int = WINDOW, mels: int = MELS) -> np.ndarray:
    """Triangular filters at equal distances on the mel scale, (bins, mels)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(window, 1 / rate)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    bank = np.maximum(0, np.minimum((f - lo) / np.maximum(mid - lo, 1e-9), (hi - f) / np.maximum(hi - mid, 1e-9)))
    return (bank + 1e-6).astype(np.float32)


@lru_cache
def hann(window: int = WINDOW) -> np.ndarray:
    return np.hanning(window).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (n, MELS) and their energy in dB, in blocks of frames."""
    if len(y) < WINDOW:
        y = np.pad(y, (0, WINDOW - len(y)))
    views = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
    step = BLOCK // WINDOW
    mel, energy = [], []
    for i in range(0, len(views), step):
        frames = views[i : i + step] * hann()
        power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
        mel.append(np.log10(power @ mel_bank() + 1e-6))
        energy.append(10 * np.log10((frames * frames).mean(axis=1) + 1e-9))
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray, hop_s: float, low: float = LOW_DB, high: float = HIGH_DB) -> list[tuple[float, float]]:
    """Spans that rise ``high`` dB above the median and last until below ``low`` dB above it."""
    floor = np.median(energy)
    state = np.where(energy >= floor + high, 1, np.where(energy < floor + low, -1, 0))
    known = np.where(state != 0, np.arange(len(state)), -1)
    last = np.maximum.accumulate(known)
    on = np.where(last >= 0, state[np.maximum(last, 0)] == 1, False)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return [(float(a * hop_s), float(b * hop_s)) for a, b in edge.reshape(-1, 2)]


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The (FRAMES, MELS) tensor and the time spans of one clip."""
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    y = resample(x - x.mean(dtype=np.float64).astype(np.float32))
    mel, energy = log_mel(y)
    edges = np.linspace(0, len(mel), FRAMES + 1).astype(int)
    tensor = np.stack([mel[a : max(b, a + 1)].mean(axis=0, dtype=np.float64) if a < len(mel) else mel[-1] for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return np.round(tensor, 2).astype(np.float32), segments(energy, HOP * DOWN / (UP * rate))


def tensor_type() -> pa.DataType:
    """The Arrow type of the tensor column."""
    return pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))


def tensor_array(column: pa.Array) -> pa.ExtensionArray:
    """A column of flat lists, as Spark returns it, as Arrow tensors."""
    flat = pa.FixedSizeListArray.from_arrays(column.flatten().cast(pa.float32()), FRAMES * MELS)
    return pa.ExtensionArray.from_storage(tensor_type(), flat)


FEATURE_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensor array<float>, spans array<struct<start_s:double,end_s:double>>"


def feature_row(data: bytes) -> dict:
    """Stores, reads back and measures one payload."""
    media = encode_wav(pad_payload(data))
    samples, rate = decode_wav(media)
    tensor, spans = features(samples, rate)
    return {
        "n_bytes": len(data),
        "payload_bytes": len(samples),
        "payload_sha256": hashlib.sha256(samples).hexdigest(),
        "tail_crc32": zlib.crc32(samples[-16:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "tensor": tensor.ravel(),
        "spans": spans,
    }


def feature_digest(tensor: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """SHA-256 of the tensor in hundredths and the spans in milliseconds."""
    ints = np.concatenate((np.rint(np.asarray(tensor, np.float64) * 100), np.rint(np.asarray(spans, np.float64).ravel() * 1000)))
    return hashlib.sha256(ints.astype("<i4").tobytes()).hexdigest()


def audio_features(df: DataFrame, id_column: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per input row: the id, sizes and digests of the stored form read back,
    the tensor, the spans, ``feature`` (their digest) and, if asked for, ``media``."""
    id_type = df.schema[id_column].dataType.simpleString()
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    types = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "tensor": pa.list_(pa.float32()), "spans": span, "feature": pa.string()} | ({"media": pa.binary()} if keep_media else {})

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = []
                for value in part.column(1).to_pylist():
                    data = (value or "").encode()
                    row = feature_row(data)
                    row["feature"] = feature_digest(row["tensor"], row["spans"])
                    row["spans"] = [{"start_s": a, "end_s": b} for a, b in row["spans"]]
                    if keep_media:
                        row["media"] = encode_wav(pad_payload(data))
                    rows.append(row)
                columns = [part.column(0)] + [pa.array([r[k] for r in rows], t) for k, t in types.items()]
                yield pa.RecordBatch.from_arrays(columns, [id_column, *types])

    schema = f"{id_column} {id_type}, {FEATURE_SCHEMA}, feature string" + (", media binary" if keep_media else "")
    return df.select(id_column, text).mapInArrow(kernel, schema)
