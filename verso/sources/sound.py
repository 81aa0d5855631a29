"""WAV data in binary columns: durations, frames, slices, joining, tones. PCM samples of one format; encoders and players are outside."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verso.cluster import ship

RATE = 24_000
#: The chime's notes in Hz and their seconds.
CHIME = [(523, 0.2), (659, 0.2), (784, 0.4)]


def wav_bytes(frames: bytes, rate: int = RATE, width: int = 2, channels: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(frames)
    return out.getvalue()


def read_wav(data: bytes) -> tuple[int, int, int, bytes]:
    """Sample width, channels, rate, frames."""
    with wave.open(io.BytesIO(data)) as w:
        return w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("sampwidth", "nchannels", "framerate")] + [T.StructField("frames", T.BinaryType())]))
def wav_parts(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_wav(b) for b in x], columns=["sampwidth", "nchannels", "framerate", "frames"])


@F.pandas_udf(T.DoubleType())
def wav_seconds(x: pd.Series) -> pd.Series:
    def seconds(b: bytes) -> float:
        width, channels, rate, frames = read_wav(b)
        return len(frames) / (width * channels * rate)

    return x.map(seconds)


def with_header(frames: Column, rate: int = RATE, width: int = 2, channels: int = 1) -> Column:
    """A WAV file of PCM frames, its header built in the JVM."""

    def little(n: Column, size: int) -> Column:
        return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(size)))

    number = lambda n, size: little(F.lit(n).cast("long"), size)
    size = F.octet_length(frames).cast("long")
    ascii_ = lambda s: F.encode(F.lit(s), "US-ASCII")
    return F.concat(
        ascii_("RIFF"), little(size + 36, 4), ascii_("WAVEfmt "), number(16, 4), number(1, 2), number(channels, 2), number(rate, 4), number(rate * width * channels, 4),
        number(width * channels, 2), number(8 * width, 2), ascii_("data"), little(size, 4), frames,
    )


def as_mono(data: bytes, rate: int = RATE) -> bytes:
    """Frames of a WAV file as 16-bit mono samples at `rate`: channels averaged, times between samples interpolated."""
    width, channels, own, frames = read_wav(data)
    if width == 1:
        x = (np.frombuffer(frames, np.uint8).astype(np.float64) - 128) * 256
    else:
        x = np.frombuffer(frames, f"<i{width}").astype(np.float64) / 256 ** (width - 2)
    x = x.reshape(-1, channels).mean(axis=1)
    if own != rate and len(x):
        x = np.interp(np.arange(len(x) * rate // own) * own / rate, np.arange(len(x)), x)
    return np.clip(np.rint(x), -32768, 32767).astype("<i2").tobytes()


def joined_wavs(pieces: DataFrame, keys: list[str], order: str, data: str = "data", resample: bool = False) -> DataFrame:
    """One WAV per key: its pieces in order. Pieces of other formats are an error, or with `resample` all become 16-bit mono at RATE. keys: string or integer columns."""
    ship(pieces.sparkSession)

    def resampled(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame[keys].iloc[:1].copy()
        out["data"] = [wav_bytes(b"".join(as_mono(b) for b in frame.sort_values(order)[data]))]
        return out

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [read_wav(b) for b in frame.sort_values(order)[data]]
        if len({p[:3] for p in parts}) != 1:
            raise ValueError("pieces of one format are needed")
        width, channels, rate, _ = parts[0]
        out = frame[keys].iloc[:1].copy()
        out["data"] = [wav_bytes(b"".join(p[3] for p in parts), rate, width, channels)]
        return out

    kinds = ", ".join(f"{k} {pieces.schema[k].dataType.simpleString()}" for k in keys)
    return pieces.groupBy(*keys).applyInPandas(resampled if resample else join, f"{kinds}, data binary")


def tone(hertz: float, seconds: float, rate: int = RATE, fade: float = 0.02) -> np.ndarray:
    t = np.arange(int(seconds * rate)) / rate
    edge = np.minimum(1, np.minimum(t, seconds - t) / fade)
    return (np.sin(2 * np.pi * hertz * t) * edge * 0.3 * 32767).astype("<i2")


def chime(rate: int = RATE) -> bytes:
    return wav_bytes(np.concatenate([tone(h, s, rate) for h, s in CHIME]).tobytes(), rate)


def silence(seconds: float, rate: int = RATE) -> bytes:
    return wav_bytes(bytes(2 * int(seconds * rate)), rate)
