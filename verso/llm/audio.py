"""Audio features: polyphase resampling, overlapped log-mel filterbanks and hysteresis energy segmentation.

A stored form is a mono WAV file of 8-bit samples. Its samples are resampled by a rational factor with one short filter per
phase, cut into overlapped windows, and turned into log-mel energies. A segment starts where the energy of a frame exceeds an
upper threshold and ends where it falls under a lower one, both relative to the clip's own mean and deviation.
Each segment's frames are averaged into a tensor of fixed shape; tensors and time spans are stored as an Arrow stream whose
tensor column is of the fixed-shape tensor type.

One scan, no shuffle. A clip is processed in runs of frames, so memory grows with its bytes only (one copy, and its frames of
FILTERS numbers). Values depend on a clip alone, never on its batch: equal clips, equal values.

Edge cases: a null text counts as empty (a payload of 576 bytes of padding); a clip without energy above its threshold has no
segment and an empty tensor column; rows with equal or null ids each give a row; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verso.cluster import ship
from verso.llm import bytes_np as B

RATE = 16_000
UP, DOWN, TAPS = 3, 4, 16
WINDOW, HOP, FILTERS = 256, 128, 16
POOLED = 4
UNIT = 576
RUN = 2048  # frames at once


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a mono 8-bit WAV file; chunks other than fmt and data are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit samples")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def _phases() -> np.ndarray:
    """Low-pass filter for UP / DOWN, one row of taps per phase, newest sample first."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = UP * cut * np.sinc(cut * t) * np.hamming(n)
    return h.reshape(TAPS, UP).T.astype(np.float32)


@cache
def _mel() -> np.ndarray:
    """Triangular filters, equally wide on the mel scale, over the bins of a window's spectrum."""
    rate = RATE * UP / DOWN
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, FILTERS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(WINDOW, 1 / rate)[:, None]
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resampled(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Samples first to last of the resampled signal of 8-bit samples x (silence beyond its ends)."""
    low = first * DOWN // UP - TAPS + 1
    high = (last - 1) * DOWN // UP + 1
    part = np.zeros(high - low, np.float32)
    a, b = max(0, low), min(len(x), high)
    part[a - low : b - low] = (x[a:b].astype(np.float32) - 128) / 128
    views = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    out = np.empty(last - first, np.float32)
    m = np.arange(first, last)
    for p, taps in enumerate(_phases()):
        mine = np.flatnonzero(m * DOWN % UP == p)
        if len(mine):
            at = m[mine[0]] * DOWN // UP - TAPS + 1 - low
            out[mine] = views[at :: DOWN][: len(mine)] @ taps[::-1]
    return out


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x FILTERS."""
    total = -(-len(x) * UP // DOWN)
    frames = 1 + max(0, total - WINDOW) // HOP
    window = np.hanning(WINDOW).astype(np.float32)
    out = np.empty((frames, FILTERS), np.float32)
    for f in range(0, frames, RUN):
        end = min(frames, f + RUN)
        y = resampled(x, f * HOP, (end - 1) * HOP + WINDOW)
        cut = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * window
        power = np.abs(np.fft.rfft(cut, axis=1)).astype(np.float32) ** 2
        out[f:end] = np.log(power @ _mel() + 1e-6)
    return out


def segments(energy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end frames of the stretches that hysteresis finds."""
    mean, dev = energy.mean(dtype=np.float64), energy.std(dtype=np.float64)
    mark = np.where(energy > mean + 0.5 * dev, 1, np.where(energy < mean - 0.5 * dev, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (at >= 0) & (mark[at] > 0)
    edge = np.diff(np.concatenate([[0], on.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def features(samples: bytes) -> tuple[bytes, int, int]:
    """Arrow stream of (start_s, end_s, tensor) of each segment, the number of segments, the number of frames."""
    mel = log_mel(np.frombuffer(samples, np.uint8))
    a, b = segments(mel.mean(axis=1))
    upto = np.zeros((len(mel) + 1, FILTERS))
    np.cumsum(mel, axis=0, out=upto[1:])
    cut = a[:, None] + (b - a)[:, None] * np.arange(POOLED + 1) // POOLED
    low = np.minimum(cut[:, :-1], (b - 1)[:, None])
    high = np.maximum(cut[:, 1:], low + 1)
    tensor = ((upto[high] - upto[low]) / (high - low)[:, :, None]).round(3).astype(np.float32)
    kind = pa.fixed_shape_tensor(pa.float32(), (POOLED, FILTERS))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensor.ravel()), POOLED * FILTERS)
    step = HOP * DOWN / UP / RATE
    batch = pa.RecordBatch.from_arrays([pa.array(a * step), pa.array((b - 1) * step + WINDOW * DOWN / UP / RATE), pa.ExtensionArray.from_storage(kind, flat)], ["start_s", "end_s", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes(), len(a), len(mel)


def audio_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = True) -> DataFrame:
    """Per row: id, sizes and digests of payload and stored form, the feature string, the Arrow stream of its segments' tensors and time spans; with media also the stored form."""
    ship(df.sparkSession)
    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["tensors"] + ["media"] * media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in B.blocks(batch.column(1)):
                rows = []
                for x, y in zip(off[:-1], off[1:]):
                    raw = data[x:y].tobytes()
                    stored = to_wav(raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT))
                    _, back = from_wav(stored)
                    tensors, n, frames = features(back)
                    feature = f"{n}:{frames}:{hashlib.sha256(tensors).hexdigest()}"
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, tensors, stored))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
                cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[: len(names) - 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], names)

    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", tensors binary" + ", media binary" * media
    return source.mapInArrow(run, schema)
