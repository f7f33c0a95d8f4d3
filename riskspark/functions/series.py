"""Numeric helpers on one short, already aggregated series (numpy inside tasks)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Decomposition low-pass taps of the four-moment Daubechies wavelet.
DB4_LOW = np.array([-0.010597401785069032, 0.0328830116668852, 0.030841381835560764,
                    -0.18703481171909309, -0.027983769416859854, 0.6308807679298589,
                    0.7148465705529157, 0.2303778133088965])
DB4_HIGH = DB4_LOW[::-1] * np.array([-1.0, 1.0] * 4)
PERIOD, SEASONAL_SPAN, TREND_SPAN, LOW_PASS_SPAN, ROUNDS = 7, 7, 15, 9, 5


def dense(offsets, values) -> np.ndarray:
    """Zero-filled series from its non-empty buckets."""
    at = np.asarray(offsets, dtype=np.int64)
    out = np.zeros(int(at.max()) + 1)
    out[at] = values
    return out


def dominant_period(series: np.ndarray) -> tuple[float, float]:
    """Period and power share of the strongest interior frequency; ties go to the lowest."""
    power = np.abs(np.fft.rfft(series)) ** 2
    power = power[1:len(series) // 2]
    if len(power) == 0:
        return 0.0, 0.0
    k = int(np.argmax(np.round(power, 6)))
    total = power.sum()
    return len(series) / (k + 1), float(power[k] / total) if total > 0 else 0.0


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One filter-bank level: symmetric extension, convolution, every second sample."""
    pad = len(DB4_LOW) - 1
    extended = np.pad(x, pad, mode="symmetric")
    low = np.convolve(extended, DB4_LOW, mode="valid")[1::2]
    high = np.convolve(extended, DB4_HIGH, mode="valid")[1::2]
    return low, high


def wavelet_bands(series: np.ndarray, levels: int = 4) -> list[np.ndarray]:
    """Coarse band first, then details from coarse to fine, of the zero-padded series."""
    size = 1 << int(np.ceil(np.log2(len(series))))
    low = np.pad(series, (0, size - len(series)))
    details = []
    for _ in range(levels):
        low, high = _split(low)
        details.append(high)
    return [low, *details[::-1]]


def _local_line(at: float, first: int, last: int, span: int, n: int) -> np.ndarray:
    """Tricube weights of a local straight-line fit evaluated at ``at``."""
    x = np.arange(first, last + 1, dtype=float)
    reach = max(at - first, last - at) + (max(span - n, 0) // 2)
    r = np.abs(x - at)
    w = np.where(r <= 0.999 * reach, np.where(r <= 0.001 * reach, 1.0, (1 - (r / max(reach, 1e-300)) ** 3) ** 3), 0.0)
    if w.sum() <= 0:
        return w
    w = w / w.sum()
    centre = (w * x).sum()
    spread = (w * (x - centre) ** 2).sum()
    if np.sqrt(spread) > 0.001 * (n - 1):
        w = w * (1 + (at - centre) / spread * (x - centre))
    return w


@lru_cache(maxsize=512)
def _smoother(n: int, span: int, ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row indices and weights of a span-long smoother; ``ends`` adds a point on either side."""
    width = min(span, n)
    points = list(range(0, n + 2)) if ends else list(range(1, n + 1))
    index = np.zeros((len(points), width), dtype=np.int64)
    weight = np.zeros((len(points), width))
    for row, at in enumerate(points):
        first = min(max(at - (span + 1) // 2 + 1, 1), n - width + 1) if span < n else 1
        index[row] = np.arange(first - 1, first - 1 + width)
        weight[row] = _local_line(float(at), first, first + width - 1, span, n)
    return index, weight


def _smooth(y: np.ndarray, span: int, ends: bool = False) -> np.ndarray:
    index, weight = _smoother(len(y), span, ends)
    return (y[index] * weight).sum(axis=1)


def _average(x: np.ndarray, width: int) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(x)])
    return (c[width:] - c[:-width]) / width


def seasonal_trend(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend parts by repeated local regression (weekly period)."""
    n, trend = len(y), np.zeros(len(y))
    seasonal = np.zeros(n)
    for _ in range(ROUNDS):
        cycle = np.zeros(n + 2 * PERIOD)
        rest = y - trend
        for j in range(PERIOD):
            part = rest[j::PERIOD]
            smooth = _smooth(part, SEASONAL_SPAN, ends=True)
            cycle[j::PERIOD][:len(smooth)] = smooth
        low = _smooth(_average(_average(_average(cycle, PERIOD), PERIOD), 3), LOW_PASS_SPAN)
        seasonal = cycle[PERIOD:PERIOD + n] - low
        trend = _smooth(y - seasonal, TREND_SPAN)
    return seasonal, trend
