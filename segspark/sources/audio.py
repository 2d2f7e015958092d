"""Audio files to cepstra: windowed spectra, a filter bank, logarithms, a cosine transform, deltas."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames of one output batch.
FRAMES = 4096


@dataclass(frozen=True)
class Analysis:
    rate: float = 8000.0
    emphasis: float = 0.95
    length_ms: float = 20.0
    shift_ms: float = 10.0
    filters: int = 24
    cepstra: int = 12
    mel: bool = False
    low: float = 0.0
    high: float = 0.0  # 0: half the rate
    points: int = 512
    lifter: int = 0
    energy: bool = False
    delta: bool = False
    centre: bool = False


def samples(data: bytes, channel: int = 1) -> tuple[np.ndarray, float | None]:
    """16-bit samples of a WAVE file (with its rate), or of headerless little-endian PCM."""
    if data[:4] == b"RIFF":
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2:
                raise ValueError(f"{8 * w.getsampwidth()}-bit samples; 16 wanted")
            if not 1 <= channel <= w.getnchannels():
                raise ValueError(f"no channel {channel}")
            return np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())[:, channel - 1].astype(float), float(w.getframerate())
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(float), None


def filter_bank(a: Analysis, rate: float) -> np.ndarray:
    """Triangular filters x spectrum bins, evenly spaced in Hz or mel."""
    warp, back = (lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)) if a.mel else (lambda f: f, lambda f: f)
    edges = back(np.linspace(warp(a.low), warp(a.high or rate / 2), a.filters + 2))
    at = np.fft.rfftfreq(a.points, 1 / rate)
    up = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    return np.clip(np.minimum(up, down), 0, None)


def deltas(x: np.ndarray, reach: int = 2) -> np.ndarray:
    """Regression slope over `reach` frames each way, ends repeated."""
    padded = np.pad(x, ((reach, reach), (0, 0)), "edge")
    slope = sum(k * (padded[reach + k : len(x) + reach + k] - padded[reach - k : len(x) + reach - k]) for k in range(1, reach + 1))
    return slope / (2 * sum(k * k for k in range(1, reach + 1)))


def cepstra(x: np.ndarray, a: Analysis, rate: float | None = None) -> np.ndarray:
    """frames x coefficients of a signal; a signal shorter than a window has no frame."""
    rate = rate or a.rate
    length, shift = int(rate * a.length_ms / 1000), int(rate * a.shift_ms / 1000)
    if length > a.points:
        raise ValueError(f"a window of {length} samples; the transform has {a.points} points")
    count = max(0, (len(x) - length) // shift + 1) if length else 0
    bank = filter_bank(a, rate).T
    k = np.arange(1, a.cepstra + 1)
    turn = np.sqrt(2 / a.filters) * np.cos(np.pi * k * (np.arange(a.filters)[:, None] + 0.5) / a.filters)
    if a.lifter:
        turn = turn * (1 + a.lifter / 2 * np.sin(np.pi * k / a.lifter))
    bright = np.append(x[:1], x[1:] - a.emphasis * x[:-1])
    window, parts = np.hamming(length), [np.zeros((0, a.cepstra + a.energy))]
    for i in range(0, count, FRAMES):
        at = np.arange(i, min(i + FRAMES, count))[:, None] * shift + np.arange(length)
        out = np.log(np.maximum(np.abs(np.fft.rfft(bright[at] * window, a.points)) @ bank, 1e-10)) @ turn
        parts.append(np.column_stack([out, np.log(np.maximum((x[at] ** 2).sum(1), 1e-10))]) if a.energy else out)
    out = np.concatenate(parts)
    if a.centre and len(out):
        out = out - out.mean(0)
    return np.column_stack([out, deltas(out)]) if a.delta and len(out) else out


def read_cepstra(spark: SparkSession, path: str, a: Analysis = Analysis(), channel: int = 1) -> DataFrame:
    """source (file name without its suffix), frame_idx, v of each audio file below a path; one file is one task's row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["source"], batch["content"], strict=True):
                x, rate = samples(content, channel)
                found = cepstra(x, a, rate)
                for i in range(0, len(found), FRAMES):
                    block = found[i : i + FRAMES]
                    yield pd.DataFrame({"source": source, "frame_idx": np.arange(i, i + len(block)), "v": list(block)})

    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("source")
    return files.select(name, "content").mapInPandas(work, "source string, frame_idx long, v array<double>")
