"""Window features that tell fibrillation from a rhythm, for many windows of a channel at once."""

from __future__ import annotations

import numpy as np

FEATURES = ("tcsc", "leakage", "peak_to_mean", "kurtosis", "dominant_hz", "amplitude_rel", "psr_density", "spec_conc", "vf_band_frac", "hf_frac", "spec_entropy", "env_cv")
# Published weights of the logistic models over FEATURES, bias first.
BASELINE = (-2.945878, -0.915637, -1.250130, 0.128096, -0.055942, -0.039030, 0.118203, 15.188091, 1.850344, 0.692025, -2.925844, -1.585018, 0.701483)
LINEAR7 = (-0.490744, -0.902319, -3.525691, 0.142076, -0.063149, -0.146428, 0.162449, 16.190325, 0.0, 0.0, 0.0, 0.0, 0.0)
CELLS = 40


def total(x: np.ndarray) -> np.ndarray:
    """Sum of each row, added from first to last. A row's sum() adds by eights, which moves values that lie on a threshold or between two roundings."""
    return np.add.accumulate(x, axis=1)[:, -1]


def density(x: np.ndarray, lag: int, peak: np.ndarray) -> np.ndarray:
    """Share of the cells of a lagged plot that each row visits."""
    half = 0.5 * (CELLS - 1)
    place = np.clip(x * half / np.where(peak > 0, peak, 1.0)[:, None] + half, 0, CELLS - 1).astype(np.int64)
    cell = place[:, :-lag] * CELLS + place[:, lag:] + np.arange(len(x))[:, None] * CELLS**2
    seen = np.zeros(len(x) * CELLS**2, bool)
    seen[cell.ravel()] = True
    return seen.reshape(len(x), -1).sum(1) / CELLS**2


def envelope_cv(x: np.ndarray, block: int, least: float = 1e-12) -> np.ndarray:
    """Spread over mean of the peaks of blocks; a last block of under half is left out."""
    n = x.shape[1]
    starts = [s for s in range(0, n, block) if min(block, n - s) >= block // 2]
    if len(starts) < 2:
        return np.zeros(len(x))
    top = np.maximum.reduceat(np.abs(x[:, : starts[-1] + block]), starts, axis=1)
    mean = total(top) / len(starts)
    return np.where(mean > least, np.sqrt(np.maximum(total(top**2) / len(starts) - mean**2, 0)) / np.where(mean > least, mean, 1.0), 0.0)


def spectral(x: np.ndarray, fs: float, least: float = 1e-18) -> np.ndarray:
    """(concentration, 2.5-7.5 Hz share, share over 12 Hz, entropy) of each row, over 0.5 to 30 Hz."""
    w = x.shape[1]
    m = max(4, 1 << (w - 1).bit_length())
    power = np.abs(np.fft.rfft(x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(w) / max(w - 1, 1))), m, axis=1)) ** 2
    place = lambda hz: np.minimum(np.floor(np.asarray(hz) * m / fs + 0.5).astype(np.int64), m // 2)
    lo, hi = max(int(place(0.5)), 1), int(place(30.0))
    if hi <= lo:
        return np.zeros((len(x), 4))
    k = np.arange(m // 2 + 1)
    whole = power[:, lo : hi + 1].sum(1)
    safe = np.where(whole > least, whole, 1.0)
    near = slice(int(place(1.0)), int(place(10.0)) + 1)
    peak = (power[:, near].argmax(1) + near.start) * fs / m
    c_lo, c_hi = np.maximum(place(0.5 * peak), lo), np.minimum(place(1.5 * peak), hi)
    within = (k >= c_lo[:, None]) & (k <= c_hi[:, None])
    q = power[:, lo : hi + 1] / safe[:, None]
    entropy = -(q * np.log(np.where(q > 0, q, 1.0))).sum(1) / max(np.log(hi - lo + 1), 1e-9)
    share = lambda a, b: power[:, a : b + 1].sum(1) / safe
    out = np.stack([(power * within).sum(1) / safe, share(max(int(place(2.5)), lo), min(int(place(7.5)), hi)), share(max(int(place(12.0)), lo), hi), entropy], 1)
    return np.where((whole > least)[:, None], out, 0.0)


def features(rows: np.ndarray, fs: float, least: float = 1e-9) -> dict[str, np.ndarray]:
    """FEATURES of windows (rows), without amplitude_rel, and the swing of each.

    A window whose peak is ``least`` or lower is still, and all its features are
    0; with a ``least`` of 0 only one without any swing is, and what rounding
    leaves of a constant counts as a signal.
    """
    w = rows.shape[1]
    x = rows - (total(rows) / w)[:, None]
    size = np.abs(x)
    peak, swing = size.max(1), x.max(1) - x.min(1)
    square = x * x
    m2, m4 = total(square) / w, total(square * x * x) / w
    mean = total(size) / w
    change = total(np.abs(np.diff(x, axis=1)))
    half = np.where(change > least, np.floor(np.pi * mean * w / np.where(change > least, change, 1.0) + 0.5), 0).astype(np.int64)
    half = np.clip(half, 1, w // 2)
    leak = np.ones(len(x))
    for h in np.unique(half).tolist():  # windows of one half period are one shift
        of = half == h
        late, early = x[of, h:], x[of, :-h]
        den = total(np.abs(late) + np.abs(early))
        leak[of] = np.where(den > least, total(np.abs(late + early)) / np.where(den > least, den, 1.0), 1.0)
    taper = max(1, min(int(0.25 * fs), w // 4))
    weight = np.ones(w)
    rise = 0.5 * (1 - np.cos(np.pi * (taper - np.arange(taper)) / taper))
    weight[:taper], weight[w - taper :] = rise, 0.5 * (1 - np.cos(np.pi * np.arange(taper) / taper))
    weight = weight.round(15)  # a half is a half
    shape = spectral(x, fs, least**2)
    out = {
        "tcsc": (size * weight >= 0.2 * peak[:, None]).mean(1), "leakage": leak, "peak_to_mean": np.where(mean > least, peak / np.where(mean > least, mean, 1.0), 0.0),
        "kurtosis": np.where(m2 > least**2, m4 / np.where(m2 > least**2, m2 * m2, 1.0) - 3, 0.0), "dominant_hz": fs / (2.0 * half), "psr_density": density(x, max(1, int(0.5 * fs)), peak),
        "spec_conc": shape[:, 0], "vf_band_frac": shape[:, 1], "hf_frac": shape[:, 2], "spec_entropy": shape[:, 3], "env_cv": envelope_cv(x, int(0.25 * fs), least * 1e-3),
    }
    still = peak <= least
    return {k: np.where(still, 0.0, v) for k, v in out.items()} | {"swing": swing, "still": still}


class Windows:
    """Windows of four seconds, one second on, with the swing against that of late beats."""

    def __init__(self, fs: float) -> None:
        self.fs, self.width, self.hop = fs, int(4 * fs), int(fs)
        self.usual: float | None = None
        self.n = self.since = 0
        self.tail = np.zeros(0)

    def on_gap(self, samples: int) -> None:
        self.n += samples
        self.since, self.tail = 0, np.zeros(0)

    def push(self, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(samples seen, FEATURES) of the windows that the block completes."""
        x = np.r_[self.tail, clean]
        old = len(self.tail)
        # a hop that comes before the first whole window waits for it
        ends, since, k = [], self.since, 0
        while True:
            k += max(self.hop - since, self.width - old - k)
            if k > len(clean):
                break
            ends.append(old + k)
            since = 0
        self.since = len(clean) - (ends[-1] - old) if ends else self.since + len(clean)
        self.n += len(clean)
        at = np.array(ends, np.int64)
        out = np.zeros((0, len(FEATURES)))
        if ends:
            rows = np.lib.stride_tricks.sliding_window_view(x, self.width)[at - self.width]
            f = features(rows, self.fs)
            rel = np.ones(len(at))
            for i, (swing, steep, peaked, still) in enumerate(zip(f["swing"].tolist(), f["peak_to_mean"].tolist(), f["kurtosis"].tolist(), f["still"].tolist(), strict=True)):
                if self.usual is not None and self.usual > 1e-9:
                    rel[i] = swing / self.usual
                if steep > 3 and peaked > 2 and not still:
                    self.usual = swing if self.usual is None else self.usual + 0.05 * (swing - self.usual)
            f["amplitude_rel"] = np.where(f["still"], 0.0, rel)
            out = np.stack([f[k] for k in FEATURES], 1)
        self.tail = x[max(0, len(x) - self.width) :]
        return at - old + self.n - len(clean), out


def probability(f: np.ndarray, weights: tuple[float, ...] = BASELINE) -> np.ndarray:
    return 1 / (1 + np.exp(-(weights[0] + f @ np.array(weights[1:]))))
