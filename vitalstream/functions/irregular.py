"""Irregularity of windows of intervals, for many windows at once: one row for each window."""

from __future__ import annotations

import numpy as np

FEATURES = ("median", "rmssd", "mad", "rmssd_over_mad", "pnn", "entropy", "entropy_d", "cosen", "turning", "sd1", "sd2", "sd1_sd2", "acf1", "acf1_d", "within", "iqr", "coherence")
# Published weights, bias first, of the terms that the probability reads.
WEIGHTS = (-2.657532, 1.190974, -4.394903, 0.000017, 2.748223, 5.528393, 0.982912, 0.586405, -0.000006, -0.047553, -2.426139, 0.450888, -1.427805)
TERMS = ("rmssd", "mad", "rmssd_over_mad", "pnn", "entropy_d", "cosen", "turning", "sd1_sd2", "acf1_d", "within", "acf1", "coherence")
BINS = 16


def _pick(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take_along_axis(rows, np.clip(at, 0, rows.shape[1] - 1)[:, None], 1)[:, 0]


def entropy(rows: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Over bins between the values left when a sixteenth, one at least, is taken off each end, by its largest value; 0 of under four."""
    n = there.sum(1)
    order = np.sort(np.where(there, rows, np.inf), axis=1)
    cut = np.maximum(n // 16, 1)
    lo, hi = _pick(order, cut), _pick(order, n - 1 - cut)
    ok = (n >= 4) & (hi > lo)
    width = np.where(ok, hi - lo, 1.0) / BINS
    place = np.clip(np.floor((np.where(there, rows, 0.0) - np.where(ok, lo, 0.0)[:, None]) / width[:, None]), 0, BINS - 1).astype(np.int64)
    counts = ((place[:, :, None] == np.arange(BINS)) & there[:, :, None]).sum(1)
    p = counts / np.maximum(n, 1)[:, None]
    return np.where(ok, -(p * np.log(np.where(p > 0, p, 1.0))).sum(1) / np.log(BINS), 0.0)


def autocorrelation(rows: np.ndarray, there: np.ndarray) -> np.ndarray:
    """At lag one, about the mean; values that are there come first. 0 of what does not vary."""
    n = np.maximum(there.sum(1), 1)
    off = np.where(there, rows - (np.where(there, rows, 0.0).sum(1) / n)[:, None], 0.0)
    den = (off * off).sum(1)
    return np.where(den > 1e-9, (off[:, 1:] * off[:, :-1]).sum(1) / np.where(den > 1e-9, den, 1.0), 0.0)


def sample_entropy(x: np.ndarray, median: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Coefficient of sample entropy, m = 1: pairs close now that stay close next. Without any the largest value that could be is taken."""
    n = x.shape[1]
    close = np.abs(x[:, :, None] - x[:, None, :]) <= radius[:, None, None]
    now, then = close[:, :-1, :-1], close[:, 1:, 1:]
    b, a = now.sum((1, 2)) - (n - 1), (now & then).sum((1, 2)) - (n - 1)
    ratio = np.where(a > 0, a, 1) / np.where(b > 0, b, 1)
    out = np.where(b == 0, np.log(n - 1), np.where(a == 0, np.log(np.where(b > 0, b, 1) * (n - 1.0)), -np.log(ratio)))
    return out + np.log(2 * radius) - np.log(median)


def features(x: np.ndarray, adjacent: np.ndarray, coherence: np.ndarray, floor: float, tiny: float = 1e-3) -> dict[str, np.ndarray]:
    """FEATURES of windows ``x``; ``adjacent``: whether an interval follows the one before it. Differences are over such pairs only.

    Under four differences all but median and coherence are 0. ``floor`` is the
    least radius of the sample entropy in units of the intervals.
    """
    n = x.shape[1]
    order = np.sort(x, axis=1)
    median = order[:, n // 2]
    pairs = adjacent[:, 1:]
    first = np.argsort(~pairs, axis=1, kind="stable")  # pairs that count come first, in order
    d, there = np.take_along_axis(np.diff(x, axis=1), first, 1), np.take_along_axis(pairs, first, 1)
    m = there.sum(1)
    some = np.maximum(m, 1)
    zeroed = np.where(there, d, 0.0)
    root = np.sqrt((zeroed**2).sum(1) / some)
    dev = _pick(np.sort(np.where(there, np.abs(d), np.inf), axis=1), m // 2)
    dev = np.where(np.isfinite(dev), dev, 0.0)
    var_x, var_d = x.var(1), np.maximum((zeroed**2).sum(1) / some - (zeroed.sum(1) / some) ** 2, 0.0)
    axis1, axis2 = np.sqrt(var_d / 2), np.sqrt(np.maximum(2 * var_x - var_d / 2, 0.0))
    turns = (((d[:, 1:] > 0) != (d[:, :-1] > 0)) & there[:, 1:]).sum(1)
    heard = coherence != 0
    voices = heard.sum(1)
    middle = _pick(np.sort(np.where(heard, coherence, np.inf), axis=1), voices // 2)
    every = np.ones_like(x, bool)
    made = {
        "rmssd": root / median, "mad": dev / median, "rmssd_over_mad": root / np.maximum(dev, tiny), "pnn": ((np.abs(d) > 0.05 * median[:, None]) & there).sum(1) / some,
        "entropy": entropy(x, every), "entropy_d": entropy(d, there), "cosen": sample_entropy(x, median, np.maximum(floor, 0.05 * median)), "turning": turns / np.maximum(m - 1, 1),
        "sd1": axis1 / median, "sd2": axis2 / median, "sd1_sd2": axis1 / np.maximum(axis2, tiny), "acf1": autocorrelation(x, every), "acf1_d": autocorrelation(d, there),
        "within": (np.abs(x - median[:, None]) <= 0.05 * median[:, None]).mean(1), "iqr": (order[:, 3 * n // 4] - order[:, n // 4]) / median,
    }
    return {k: np.where(m < 4, 0.0, v) for k, v in made.items()} | {"median": median, "coherence": np.where(voices > 0, middle, 0.0)}


def probability(f: dict[str, np.ndarray]) -> np.ndarray:
    return 1 / (1 + np.exp(-(WEIGHTS[0] + sum(w * f[t] for w, t in zip(WEIGHTS[1:], TERMS, strict=True)))))
