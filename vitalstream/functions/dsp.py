"""Filters, spectra and windows over numpy arrays, with state carried between blocks."""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..config import ChannelConfig

BLOCK = 64


@dataclass(frozen=True)
class Section:
    """Second-order section, a0 = 1."""

    b0: float
    b1: float
    b2: float
    a1: float
    a2: float

    def response(self, f: float | np.ndarray, fs: float) -> np.ndarray:
        z = np.exp(-2j * np.pi * np.asarray(f, float) / fs)
        return (self.b0 + self.b1 * z + self.b2 * z * z) / (1 + self.a1 * z + self.a2 * z * z)


def section(kind: str, f0: float, fs: float, q: float) -> Section:
    """Low-pass, high-pass or notch by the audio cookbook."""
    w = 2 * np.pi * f0 / fs
    c, alpha = np.cos(w), np.sin(w) / (2 * q)
    b = {"low": ((1 - c) / 2, 1 - c, (1 - c) / 2), "high": ((1 + c) / 2, -1 - c, (1 + c) / 2), "notch": (1.0, -2 * c, 1.0)}[kind]
    a0 = 1 + alpha
    return Section(*(float(x / a0) for x in (*b, -2 * c, 1 - alpha)))


def butterworth(kind: str, f0: float, fs: float, order: int) -> list[Section]:
    """An even-order Butterworth filter as sections; corners stay under 0.45 of the rate."""
    qs = [1 / (2 * np.cos(np.pi * (2 * k + 1) / (2 * order))) for k in range(order // 2)]
    return [section(kind, min(f0, 0.45 * fs), fs, q) for q in qs]


def group_delay(sections: list[Section], f: float, fs: float) -> float:
    """Samples, by a central difference of the unwrapped phase."""
    df = min(fs / 4096, 0.05 * f)
    phase = lambda x: np.angle(np.prod([s.response(x, fs) for s in sections]))
    d = phase(f + df) - phase(f - df)
    d = (d + np.pi) % (2 * np.pi) - np.pi
    return float(-d / (2 * df * 2 * np.pi / fs))


def magnitude(sections: list[Section], f: float, fs: float) -> float:
    return float(abs(np.prod([s.response(f, fs) for s in sections])))


def phase(sections: list[Section], f: float, fs: float) -> float:
    """Radians, of all sections together and so not wrapped at each."""
    return float(sum(np.angle(s.response(f, fs)) for s in sections))


class Cascade:
    """Sections one after the other, exact over blocks: y = T x + O s within a block of BLOCK samples, then s moves on."""

    def __init__(self, sections: list[Section]) -> None:
        self.sections = sections
        self.parts = []
        for s in sections:
            a = np.array([[-s.a1, 1.0], [-s.a2, 0.0]])
            b = np.array([s.b1 - s.a1 * s.b0, s.b2 - s.a2 * s.b0])
            powers = [np.eye(2)]
            for _ in range(BLOCK):
                powers.append(a @ powers[-1])
            impulse = np.r_[s.b0, [(p @ b)[0] for p in powers[: BLOCK - 1]]]
            t = np.array([[impulse[i - j] if i >= j else 0.0 for j in range(BLOCK)] for i in range(BLOCK)])
            o = np.array([p[0] for p in powers[:BLOCK]])
            drive = np.array([powers[BLOCK - 1 - k] @ b for k in range(BLOCK)]).T
            self.parts.append((t, o, drive, powers))
        self.state: list[np.ndarray] | None = None

    def reset(self) -> None:
        self.state = None

    def _prime(self, x: float) -> None:
        """The steady state of a constant input, so that a start is no step."""
        self.state, level = [], x
        for s in self.sections:
            gain = (s.b0 + s.b1 + s.b2) / (1 + s.a1 + s.a2)
            y = gain * level
            s2 = s.b2 * level - s.a2 * y
            self.state.append(np.array([s.b1 * level - s.a1 * y + s2, s2]))
            level = y

    def process(self, x: np.ndarray) -> np.ndarray:
        y = np.asarray(x, np.float64)
        if not len(y):
            return y
        if self.state is None:
            self._prime(float(y[0]))
        for k, (t, o, drive, powers) in enumerate(self.parts):
            whole, rest = divmod(len(y), BLOCK)
            out, state = np.empty(len(y)), self.state[k]
            if whole:
                blocks = y[: whole * BLOCK].reshape(whole, BLOCK)
                pushed, states = blocks @ drive.T, np.empty((whole, 2))
                for i in range(whole):
                    states[i] = state
                    state = powers[BLOCK] @ state + pushed[i]
                out[: whole * BLOCK] = (blocks @ t.T + states @ o.T).ravel()
            if rest:
                x = y[whole * BLOCK :]
                out[whole * BLOCK :] = t[:rest, :rest] @ x + o[:rest] @ state
                state = powers[rest] @ state + drive[:, BLOCK - rest :] @ x
            self.state[k], y = state, out
        return y


class Bank:
    """Signals that are filtered from one input or from each other, as one linear system.

    ``add`` feeds a signal through sections and gives a new one. All signals of a
    block of BLOCK samples are one matrix product, and one state moves from block
    to block, however many sections there are.
    """

    def __init__(self) -> None:
        self.a, self.b = np.zeros((0, 0)), np.zeros(0)
        self.source = (np.zeros(0), 1.0)
        self.taps: list[tuple[np.ndarray, float]] = []
        self.state: np.ndarray | None = None

    def add(self, signal: tuple[np.ndarray, float], sections: list[Section]) -> tuple[np.ndarray, float]:
        for s in sections:
            c, d = np.r_[signal[0], np.zeros(len(self.b) - len(signal[0]))], signal[1]
            own = np.array([s.b1 - s.a1 * s.b0, s.b2 - s.a2 * s.b0])
            n = len(self.b)
            a = np.zeros((n + 2, n + 2))
            a[:n, :n], a[n:, :n], a[n:, n:] = self.a, np.outer(own, c), [[-s.a1, 1.0], [-s.a2, 0.0]]
            self.a, self.b = a, np.r_[self.b, own * d]
            signal = np.r_[s.b0 * c, 1.0, 0.0], s.b0 * d
        return signal

    def close(self, taps: list[tuple[np.ndarray, float]]) -> None:
        n = len(self.b)
        self.taps = [(np.r_[c, np.zeros(n - len(c))], d) for c, d in taps]
        powers = [np.eye(n)]
        for _ in range(BLOCK):
            powers.append(self.a @ powers[-1])
        self.powers = powers
        self.drive = np.array([powers[BLOCK - 1 - k] @ self.b for k in range(BLOCK)]).T
        self.kernel, self.from_state = [], []
        lower = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
        for c, d in self.taps:
            impulse = np.r_[d, [c @ p @ self.b for p in powers[: BLOCK - 1]]]
            self.kernel.append(np.where(lower >= 0, impulse[np.maximum(lower, 0)], 0.0))
            self.from_state.append(np.array([c @ p for p in powers[:BLOCK]]))
        self.all_kernels = np.concatenate(self.kernel).T.copy()
        self.all_states = np.concatenate(self.from_state).T.copy()

    def reset(self) -> None:
        self.state = None

    def process(self, x: np.ndarray) -> list[np.ndarray]:
        """All taps of ``x``; the first sample of all is taken to have been there for ever, so that a start is no step."""
        if not len(x):
            return [np.zeros(0) for _ in self.taps]
        if self.state is None:
            self.state = np.linalg.solve(np.eye(len(self.b)) - self.a, self.b * x[0])
        whole, rest = divmod(len(x), BLOCK)
        out, state, m = np.empty((len(self.taps), len(x))), self.state, len(self.taps)
        if whole:
            blocks = x[: whole * BLOCK].reshape(whole, BLOCK)
            pushed, states, far = blocks @ self.drive.T, np.empty((whole, len(state))), self.powers[BLOCK]
            for i in range(whole):
                states[i] = state
                state = far @ state + pushed[i]
            made = blocks @ self.all_kernels + states @ self.all_states
            out[:, : whole * BLOCK] = made.reshape(whole, m, BLOCK).transpose(1, 0, 2).reshape(m, -1)
        if rest:
            tail = x[whole * BLOCK :]
            for k in range(m):
                out[k, whole * BLOCK :] = self.kernel[k][:rest, :rest] @ tail + self.from_state[k][:rest] @ state
            state = self.powers[rest] @ state + self.drive[:, BLOCK - rest :] @ tail
        self.state = state
        return list(out)


def tone_power(x: np.ndarray, f: float, fs: float) -> float:
    """Power at one frequency, over the window squared."""
    w = np.exp(-2j * np.pi * f / fs * np.arange(len(x)))
    return float(abs(np.dot(x, w)) ** 2 / len(x) ** 2)


def mains_frequency(first: np.ndarray, fs: float, candidates=(50.0, 60.0), side: float = 7.0, least: float = 6.0) -> float | None:
    """The candidate that stands out of its sidebands, from the first block of a channel; None where none does."""
    best = (least, None)
    for f in candidates:
        if f + side < 0.45 * fs:
            floor = (tone_power(first, f - side, fs) + tone_power(first, f + side, fs)) / 2
            ratio = tone_power(first, f, fs) / max(floor, 1e-18)
            if ratio >= best[0]:
                best = (ratio, f)
    return best[1]


@lru_cache(maxsize=32)
def _design(cfg: ChannelConfig, mains: float | None) -> tuple[dict[str, list[Section]], Bank]:
    """Sections and the closed system of a filter bank."""
    fs = cfg.fs
    notch = [section("notch", k * mains, fs, mains / cfg.notch_hz) for k in (1, 2) if k * mains < 0.45 * fs] if mains else []
    parts = {
        "high": butterworth("high", cfg.high_pass_hz, fs, 2), "clean": [*notch, *butterworth("low", cfg.low_pass_hz, fs, 4)],
        "qrs": [*butterworth("high", cfg.qrs_low_hz, fs, 2), *butterworth("low", cfg.qrs_high_hz, fs, 2)],
        "wave": butterworth("low", cfg.wave_hz, fs, 2), "hf": butterworth("high", cfg.noise_hz, fs, 2),
    }
    bank = Bank()
    high = bank.add(bank.source, parts["high"])
    clean = bank.add(high, parts["clean"])
    bank.close([high, clean, bank.add(clean, parts["qrs"]), bank.add(clean, parts["wave"]), bank.add(bank.source, parts["hf"])])
    return parts, bank


class FilterBank:
    """Taps of a channel: baseline, clean, qrs, wave and high-frequency bands, and where the input saturates."""

    def __init__(self, cfg: ChannelConfig, mains: float | None = None) -> None:
        self.cfg, self.mains = cfg, mains
        self.parts, made = _design(cfg, mains)
        self.bank = copy(made)  # the matrices are shared, the state is not

    def __getstate__(self) -> dict:
        """Settings and the filters' state: the matrices are made again, so that a channel's stored state is small."""
        return {"cfg": self.cfg, "mains": self.mains, "state": self.bank.state}

    def __setstate__(self, kept: dict) -> None:
        self.__init__(kept["cfg"], kept["mains"])
        self.bank.state = kept["state"]

    def reset(self) -> None:
        self.bank.reset()

    def delay(self, tap: str, hz: float) -> float:
        """Samples by which a tap lags the input at ``hz``."""
        path = {"clean": ("high", "clean"), "qrs": ("high", "clean", "qrs"), "wave": ("high", "clean", "wave")}[tap]
        return sum(group_delay(self.parts[p], hz, self.cfg.fs) for p in path)

    def process(self, x: np.ndarray) -> dict[str, np.ndarray]:
        x = np.asarray(x, np.float64)
        high, clean, qrs, wave, hf = self.bank.process(x)
        return {"raw": x, "baseline": x - high, "clean": clean, "qrs": qrs, "wave": wave, "hf": hf, "saturated": np.abs(high) >= self.cfg.saturation_mv}
