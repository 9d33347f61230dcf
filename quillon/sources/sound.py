"""Sound: log-mel features of samples."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Mel(NamedTuple):
    n_fft: int = 400
    hop: int = 160
    mels: int = 80
    rate: int = 16_000
    centre: bool = True
    drop_last: bool = False
    clip: bool = True  # least value, else it is added
    eps: float = 1e-10
    base10: bool = True
    norm: str = "clip_max"  # clip_max, clip_fixed or per_feature
    fixed_max: float = 1.5


def bank(p: Mel) -> np.ndarray:
    """Triangles between even steps of the mel scale, of equal area: mels by frequencies."""
    mel, hertz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = hertz(np.linspace(0, mel(p.rate / 2), p.mels + 2))
    f = np.linspace(0, p.rate / 2, p.n_fft // 2 + 1)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: np.ndarray, p: Mel = Mel()) -> np.ndarray:  # noqa: B008  a tuple
    """Mels by frames: power of windowed frames through the bank, logarithm, normalisation."""
    x = np.pad(samples.astype(float), p.n_fft // 2 if p.centre else 0)
    n = (len(x) - p.n_fft) // p.hop + 1 - p.drop_last if len(x) >= p.n_fft else 0
    if n <= 0:
        return np.empty((p.mels, 0))
    frames = np.lib.stride_tricks.sliding_window_view(x, p.n_fft)[:: p.hop][:n]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(p.n_fft) / p.n_fft)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    out = power @ bank(p).T
    out = np.maximum(out, p.eps) if p.clip else out + p.eps
    out = (np.log10(out) if p.base10 else np.log(out)).T
    if p.norm == "per_feature":
        return (out - out.mean(1, keepdims=True)) / np.sqrt(out.var(1, keepdims=True) + 1e-5)
    top = out.max() if p.norm == "clip_max" else p.fixed_max
    return (np.maximum(out, top - 8) + 4) / 4
