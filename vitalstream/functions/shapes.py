"""Shapes of beats: running templates, groups, and the features of a beat against what came before it."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np

from ..config import ChannelConfig
from . import waves
from .waves import Waves

FEATURES = (
    "ncc_template", "ncc_prev", "width_rel", "amp_rel", "area_rel", "slope_rel", "rr_prev_rel", "rr_post_rel", "rr_sum_rel", "rr_ratio", "p_present", "p_pr_rel",
    "p_amp_rel", "p_polarity", "p_ncc", "p_ncc_rel", "p_ncc_prev", "p_pp_rel", "p_pp_over_rr", "init_ratio", "peak_time_ms", "peak_time_frac", "ashman",
)
# Beats until a template counts, misses after which it is dropped, beats of a rival before it may lead, widths in ms.
BOOTSTRAP, REANCHOR, PROMOTE, CONDUCTED_MS, MARGIN_MS = 8, 50, 16, 120.0, 30.0


class Median8:
    """Upper median of the last eight values; a default before the first."""

    __slots__ = ("default", "last")

    def __init__(self, default: float) -> None:
        self.default, self.last = default, deque(maxlen=8)

    def push(self, v: float) -> None:
        self.last.append(v)

    def value(self) -> float:
        return sorted(self.last)[len(self.last) // 2] if self.last else self.default


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    return min(1.0, max(-1.0, float(a @ b)))


def drawn(centre: np.ndarray, v: np.ndarray, rate: float) -> np.ndarray:
    """A unit vector moved towards another."""
    c = centre + rate * (v - centre)
    return c / max(float(np.sqrt(c @ c)), 1e-6)


@dataclass
class Kind:
    """A shape and the running size of its beats: amplitude, area, width, slope; qrs_ms where it was read."""

    vector: np.ndarray
    size: np.ndarray
    qrs_ms: float
    beats: int = 1

    def fold(self, v: np.ndarray, size: np.ndarray, qrs_ms: float, rate: float) -> None:
        self.vector = drawn(self.vector, v, rate)
        self.size = self.size + rate * (size - self.size)
        if qrs_ms > 0:
            self.qrs_ms = self.qrs_ms + rate * (qrs_ms - self.qrs_ms) if self.qrs_ms > 0 else qrs_ms
        self.beats += 1


class Template:
    """The leading kind of a channel and one rival. A rival that is conducted takes over from a wide leader; a leader that is missed for long is replaced."""

    def __init__(self, cfg: ChannelConfig) -> None:
        self.admit, self.rate, self.lead, self.rival, self.missed = cfg.template_ncc, cfg.template_rate, None, None, 0

    def established(self) -> bool:
        return self.lead is not None and self.lead.beats >= BOOTSTRAP

    def similarity(self, v: np.ndarray) -> float:
        return ncc(self.lead.vector, v) if self.lead else 0.0

    def size(self) -> np.ndarray:
        return self.lead.size if self.lead else np.zeros(4)

    def update(self, v: np.ndarray, size: np.ndarray, qrs_ms: float) -> None:
        if self.lead is None or ncc(self.lead.vector, v) >= self.admit:
            if self.lead is None:
                self.lead = Kind(v, size, qrs_ms)
            else:
                self.lead.fold(v, size, qrs_ms, self.rate)
            self.missed = 0
            return
        self.missed += 1
        alike = self.rival is not None and ncc(self.rival.vector, v) >= self.admit
        if alike:
            self.rival.fold(v, size, qrs_ms, self.rate)
            a, b = self.lead, self.rival
            ready = a.beats >= BOOTSTRAP and b.beats >= PROMOTE
            if ready and a.qrs_ms > CONDUCTED_MS >= b.qrs_ms > 0 and b.qrs_ms + MARGIN_MS <= a.qrs_ms:
                self.lead, self.rival, self.missed = b, a, 0
        if self.missed >= REANCHOR:
            self.lead, self.rival, self.missed = Kind(v, size, qrs_ms), None, 0
        elif not alike:
            self.rival = Kind(v, size, qrs_ms)


class ShapeTemplate:
    """A running shape without a size, for the atrial stretch."""

    def __init__(self, admit: float, rate: float) -> None:
        self.admit, self.rate, self.vector, self.beats, self.missed = admit, rate, None, 0, 0

    def established(self) -> bool:
        return self.beats >= BOOTSTRAP

    def similarity(self, v: np.ndarray) -> float:
        return 0.0 if self.vector is None else ncc(self.vector, v)

    def update(self, v: np.ndarray) -> None:
        if self.vector is not None and self.similarity(v) < self.admit:
            self.missed += 1
            if self.missed < REANCHOR:
                return
            self.vector, self.beats = None, 0
        self.missed = 0
        self.vector = v if self.vector is None else drawn(self.vector, v, self.rate)
        self.beats += 1


class AtrialRun:
    """A beat that is called anchors its P shape; the beats after it belong to its run while their P looks like it."""

    def __init__(self, hold: float, blind: int) -> None:
        self.hold, self.most, self.onset, self.blind = hold, blind, None, 0

    def push(self, called: bool, p: np.ndarray | None) -> bool:
        if called:
            self.onset, self.blind = (self.onset if p is None else p), 0
            return True
        if self.onset is None:
            return False
        if p is None:
            self.blind += 1
            held = self.blind <= self.most
        else:
            self.blind, held = 0, ncc(self.onset, p) >= self.hold
        if not held:
            self.onset, self.blind = None, 0
        return held


@dataclass
class Leader:
    """Online groups of unit vectors: the best centre over ``join`` takes one in, else it leads a new group."""

    join: float = 0.90
    rate: float = 0.02
    most: int = 64
    merge: float = 0.95
    centres: np.ndarray | None = None
    counts: list[int] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    #: (what, group, into or -1) in order; the caller may empty it.
    events: list[tuple[str, int, int]] = field(default_factory=list)
    made: int = 0

    def add(self, v: np.ndarray) -> tuple[int, float]:
        """(group, correlation with its centre before the vector moved it; 1 for a new group's first)."""
        n = len(self.ids)
        if n:
            scores = self.centres[:n] @ v
            k = int(scores.argmax())
            if scores[k] >= self.join:
                self.centres[k] = drawn(self.centres[k], v, self.rate)
                self.counts[k] += 1
                return self.ids[k], min(1.0, float(scores[k]))
        if n >= self.most:
            self._make_room()
        if self.centres is None:
            self.centres = np.zeros((self.most, len(v)))
        self.centres[len(self.ids)] = v
        self.counts.append(1)
        self.ids.append(self.made)
        self.made += 1
        return self.ids[-1], 1.0

    def _make_room(self) -> None:
        """The closest pair becomes one if close enough; else the smallest group is let go."""
        n = len(self.ids)
        close = np.triu(self.centres[:n] @ self.centres[:n].T, 1) + np.tril(np.full((n, n), -2.0))
        i, j = np.unravel_index(int(close.argmax()), close.shape)
        if close[i, j] >= self.merge:
            keep, gone = (i, j) if self.counts[i] >= self.counts[j] else (j, i)
            self.counts[keep] += self.counts[gone]
            self.events.append(("merged", self.ids[gone], self.ids[keep]))
        else:
            gone = int(np.argmin(self.counts))
            self.events.append(("dropped", self.ids[gone], -1))
        self.centres[gone : n - 1] = self.centres[gone + 1 : n].copy()
        del self.counts[gone], self.ids[gone]


def measures(clean: np.ndarray, qrs: np.ndarray, r: np.ndarray, now: np.ndarray, cfg: ChannelConfig) -> np.ndarray:
    """(amplitude mV, area, width ms, slope mV/s) of each beat, as rows; zeros where nothing stands out."""
    near, search, dt = cfg.samples(waves.ANCHOR_MS), cfg.samples(150.0), 1000.0 / cfg.fs
    lo, hi = np.maximum(r - search, 0), np.minimum(r + search, now - 1)
    at, v, inside = waves._rows(np.abs(qrs), lo, hi, 0)
    spot = np.where(inside & (np.abs(at - r[:, None]) <= near), v, -1.0).argmax(1)
    top = np.take_along_axis(v, spot[:, None], 1)[:, 0]
    left, right = waves.stretch(v, inside, spot, top * waves.EDGE)
    col = np.arange(v.shape[1])
    run = (col >= left[:, None]) & (col <= right[:, None])
    a_lo, a_hi = np.maximum(r - near, 0), np.minimum(r + near, now - 1)
    _, c, within = waves._rows(clean, a_lo, a_hi, 0)
    step = np.abs(np.diff(c, axis=1)) * within[:, 1:]
    out = np.stack([
        np.where(within, c, -np.inf).max(1) - np.where(within, c, np.inf).min(1), (v * run).sum(1) * dt, (right - left) * dt, step.max(1, initial=0.0) * cfg.fs,
    ], 1)
    return np.where(((hi > lo) & (top > 0))[:, None], out, 0.0)


def onset_shape(clean: np.ndarray, on: np.ndarray, off: np.ndarray, now: np.ndarray, cfg: ChannelConfig) -> np.ndarray:
    """(log ratio of the first to the last swing, time and share of the way to the peak) of each QRS; zeros where it was not read."""
    ok = (on >= 0) & (off < now) & (off > on + 2)
    a, b = np.where(ok, on, 0), np.where(ok, off, 0)
    k = np.maximum(np.minimum(cfg.samples(40.0), (b - a) // 2), 1)
    at = lambda i: clean[np.clip(i, 0, len(clean) - 1)]
    ratio = np.log((np.abs(at(a + k) - at(a)) + 1e-4) / (np.abs(at(b) - at(b - k)) + 1e-4))
    _, v, inside = waves._rows(clean, a, b, 0)
    peak = np.where(inside, np.abs(v - at(a)[:, None]), -1.0).argmax(1)
    out = np.stack([np.clip(ratio, -4.0, 4.0), peak * 1000.0 / cfg.fs, peak / np.maximum(b - a, 1)], 1)
    return np.where(ok[:, None], out, 0.0)


def _over(x: float, r: float) -> float:
    return x / r if r > 1e-6 else 1.0


class Analyzer:
    """Features of beats, one beat late: a beat is judged when the next has come."""

    def __init__(self, cfg: ChannelConfig) -> None:
        self.cfg = cfg
        self.template, self.p_template = Template(cfg), ShapeTemplate(cfg.atrial_ncc, cfg.template_rate)
        self.rr, self.pr, self.p_amp, self.p_ncc, self.pp = Median8(800.0), Median8(160.0), Median8(0.1), Median8(0.8), Median8(800.0)
        self.p_sign = 0.0
        self.legible = deque(maxlen=8)
        self.p_before: int | None = None
        self.on_gap()

    def on_gap(self) -> None:
        self.before = self.atrial_before = None

    def legibility(self) -> float:
        """Upper median of how alike the last eight beats' atrial stretches are to the one before; NaN before the first."""
        return sorted(self.legible)[len(self.legible) // 2] if self.legible else float("nan")

    def observe(self, w: Waves | None, k: int, base: int, vector: np.ndarray, size: np.ndarray, onset: np.ndarray, atrial: np.ndarray | None, rr: tuple[float, float, float], good: bool) -> tuple[list[float], bool]:
        """(FEATURES, template was ready) of beat ``k`` of ``w``, whose positions count from ``base``, with the two intervals before it and the one after, in ms."""
        before2, before, after = rr
        ready = self.template.established()
        usual = max(self.rr.value(), 1.0)
        known = before == before
        rel = [_over(float(a), float(b)) for a, b in zip(size, self.template.size(), strict=True)]
        a = self._atrial(w, k, base, atrial, before, good) if w is not None and w.qrs_on[k] >= 0 else (0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0)
        out = [
            self.template.similarity(vector), 0.0 if self.before is None else ncc(self.before, vector), rel[2], rel[0], rel[1], rel[3],
            before / usual if known else 1.0, after / usual, 0.5 * (before + after) / usual if known else 1.0, before / after if known and after > 1e-3 else 1.0,
            *a, *onset.tolist(), before2 / before if before2 == before2 and before > 1e-3 else 1.0,
        ]
        if good:
            qrs_ms = float(w.qrs_off[k] - w.qrs_on[k]) * 1000.0 / self.cfg.fs if w is not None and w.qrs_on[k] >= 0 else 0.0
            self.template.update(vector, size, qrs_ms)
        self.before = vector
        self.legible.append(out[16])
        return out, ready

    def _atrial(self, w: Waves, k: int, base: int, shape: np.ndarray | None, rr: float, good: bool) -> tuple[float, ...]:
        to_ms = 1000.0 / self.cfg.fs
        like_last = ncc(shape, self.atrial_before) if shape is not None and self.atrial_before is not None else 0.0
        self.atrial_before = shape
        like, off = 0.0, 1.0
        if shape is not None:
            c, ready = self.p_template.similarity(shape), self.p_template.established()
            if good:
                self.p_template.update(shape)
            if ready:
                like, off = c, min(max(1 - c, 0.0) / max(1 - self.p_ncc.value(), 0.02), 20.0)
                if good:
                    self.p_ncc.push(c)
        sure = max(float(w.p_confidence[k]), 0.0)
        present, peak = sure / (sure + 4.0), int(w.p_peak[k])
        if peak < 0:
            return present, 1.0, 1.0, 0.0, like, off, like_last, 1.0, 1.0
        amp, pr = float(w.p_amplitude[k]), float(w.pr_ms[k])
        sign = 1.0 if amp >= 0 else -1.0
        polarity = sign * self.p_sign if self.p_sign else 0.0
        amp_rel, pr_rel = _over(abs(amp), self.p_amp.value()), _over(pr, self.pr.value())
        pp_rel = over_rr = 1.0
        if self.p_before is not None and peak + base > self.p_before:
            pp = (peak + base - self.p_before) * to_ms
            pp_rel, over_rr = _over(pp, self.pp.value()), pp / rr if rr == rr and rr > 1e-3 else 1.0
            if good and 200 <= pp < 3000:
                self.pp.push(pp)
        self.p_before = peak + base
        if good:
            self.p_amp.push(abs(amp))
            if 40 <= pr < 400:
                self.pr.push(pr)
            self.p_sign = min(1.0, max(-1.0, self.p_sign + 0.1 * (sign - self.p_sign)))
        return present, pr_rel, amp_rel, min(1.0, max(-1.0, polarity)), like, off, like_last, pp_rel, over_rr
