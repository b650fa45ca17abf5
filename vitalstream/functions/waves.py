"""Bounds of P, QRS and T waves, for many beats of a channel at once.

Windows of all beats are rows of one matrix; what lies outside a beat's own
window is masked. Positions are indices of the arrays given, and a tap's delay
is taken off by reading it later.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..config import ChannelConfig

# Shares and times (ms) of the windows.
EDGE, VALLEY, ENVELOPE_MS, ANCHOR_MS, SEARCH_MS = 0.15, 0.1, 24.0, 70.0, 120.0
T_GUARD, T_WINDOW = (140.0, 0.15), (520.0, 0.60)
P_GUARD, P_WINDOW = (90.0, 0.10), (360.0, 0.45)
ISO_MS, P_CONFIDENCE, SHAPE_MS = (60.0, 10.0), 2.5, 200.0
P_OFFSET_MS, T_OFFSET_MS = 14.0, 24.0


def _rows(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, delay: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, values, inside) of x[lo + delay : hi + delay + 1], one row for each pair."""
    width = int(max(3, (hi - lo).max(initial=0) + 1))
    at = lo[:, None] + np.arange(width)
    inside = at <= hi[:, None]
    return at, x[np.clip(at + delay, 0, len(x) - 1)], inside


def upper_median(values: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """By row, over what is inside; 0 where nothing is."""
    n = inside.sum(1)
    order = np.sort(np.where(inside, values, np.inf), axis=1)
    return np.where(n > 0, order[np.arange(len(n)), np.minimum(n // 2, order.shape[1] - 1)], 0.0)


def stretch(values: np.ndarray, inside: np.ndarray, at: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last column of the run over ``bound`` around column ``at``."""
    col = np.arange(values.shape[1])
    ends = ~(values > bound[:, None]) | ~inside
    left = np.where(ends & (col < at[:, None]), col, -1).max(1) + 1
    right = np.where(ends & (col > at[:, None]), col, values.shape[1]).min(1) - 1
    return left, right


def _walk(height: np.ndarray, inside: np.ndarray, peak: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
    """Column where a wave ends on one side: at the bound, or before it rises again, or at the window's end."""
    width = height.shape[1]
    col = peak[:, None] + step * np.arange(width)
    there = (col >= 0) & (col < width)
    there &= np.take_along_axis(inside, np.clip(col, 0, width - 1), 1)
    out = np.where(there, np.take_along_axis(height, np.clip(col, 0, width - 1), 1), np.inf)
    lowest = np.minimum.accumulate(out, axis=1)
    low = out[:, 1:] <= bound[:, None]
    rise = out[:, 1:] > lowest[:, :-1] + VALLEY * bound[:, None]  # the window's end rises to infinity
    stop = low | rise
    k = np.where(stop.any(1), stop.argmax(1), width - 1)
    at_bound = np.take_along_axis(low, np.minimum(k, width - 2)[:, None], 1)[:, 0]
    return peak + step * np.where(at_bound, k + 1, k)


@dataclass
class Waves:
    """Arrays over beats; ``qrs_on`` is -1 where there are no bounds, and a P or T that is not there has peak -1."""

    r: np.ndarray
    qrs_on: np.ndarray
    qrs_off: np.ndarray
    p_on: np.ndarray
    p_peak: np.ndarray
    p_off: np.ndarray
    p_confidence: np.ndarray
    p_amplitude: np.ndarray
    t_on: np.ndarray
    t_peak: np.ndarray
    t_off: np.ndarray
    pr_ms: np.ndarray
    atrial_lo: np.ndarray
    atrial_hi: np.ndarray


def _samples(fs: float, ms: float) -> int:
    return max(1, int(fs * ms / 1000 + 0.5))


def qrs_bounds(env: np.ndarray, r: np.ndarray, now: np.ndarray, delay: int, cfg: ChannelConfig, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Onset and offset, where the envelope falls to a share of its peak near ``r``; -1 where it cannot be read."""
    anchor, search = _samples(cfg.fs, ANCHOR_MS), _samples(cfg.fs, SEARCH_MS)
    last = now - 1 - delay
    lo, hi = np.maximum(r - search, max(0, floor - delay)), np.minimum(r + search, last)
    at, v, inside = _rows(env, lo, hi, delay)
    near = inside & (np.abs(at - r[:, None]) <= anchor)
    spot = np.where(near, v, -1.0).argmax(1)
    top = np.take_along_axis(v, spot[:, None], 1)[:, 0]
    left, right = stretch(v, inside, spot, top * EDGE)
    ok = (r <= last) & (hi > lo) & near.any(1) & (top > 0)
    return np.where(ok, lo + left, -1), np.where(ok, lo + right, -1)


def _wave(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, delay: int, base: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(usable, onset, peak, offset, base, rows) of the widest swing in each window."""
    at, v, inside = _rows(x, lo, hi, delay)
    own = upper_median(v, inside)
    base = own if base is None else np.where(np.isnan(base), own, base)
    height = np.where(inside, np.abs(v - base[:, None]), 0.0)
    peak = height.argmax(1)
    top = np.take_along_axis(height, peak[:, None], 1)[:, 0]
    bound = top * EDGE
    on, off = _walk(height, inside, peak, bound, -1), _walk(height, inside, peak, bound, 1)
    return top > 0, lo + on, lo + peak, lo + off, base, (at, v, inside, height)


def _tangent(x: np.ndarray, peak: np.ndarray, off: np.ndarray, hi: np.ndarray, base: np.ndarray, delay: int) -> np.ndarray:
    """Where the steepest tangent of the falling limb meets the base line."""
    end = np.minimum(off + (off - peak) // 2, hi)
    at, v, inside = _rows(x, peak + 1, np.maximum(end - 1, peak + 1), delay)
    sign = np.sign(x[np.clip(peak + delay, 0, len(x) - 1)] - base)
    after = x[np.clip(at + 1 + delay, 0, len(x) - 1)]
    slope = np.where(inside & (at < end[:, None]), sign[:, None] * (v - after), 0.0)
    k = slope.argmax(1)
    steep = np.take_along_axis(slope, k[:, None], 1)[:, 0]
    tall = sign * (np.take_along_axis(v, k[:, None], 1)[:, 0] - base)
    ok = (off > peak + 1) & (hi > peak + 2) & (steep > 0) & (tall > 0)
    ahead = np.floor(tall / np.where(steep > 0, steep, 1.0) + 0.5).astype(np.int64)
    return np.where(ok, np.minimum(peak + 1 + k + ahead, hi), off)


def delineate(env: np.ndarray, wave: np.ndarray, r: np.ndarray, rr_before: np.ndarray, rr_after: np.ndarray, now: np.ndarray, delays: tuple[int, int, int], cfg: ChannelConfig, t_before: int = -1, floor: int = 0) -> Waves:
    """Waves of beats ``r`` in order, with the intervals around them (0: none) and ``now``, the samples seen when each is judged.

    ``delays`` are of the envelope and of the wave band at P and T; ``t_before``
    is the end of the T wave of the beat before the first.
    """
    fs, (d_qrs, d_p, d_t) = cfg.fs, delays
    m, ms = len(r), lambda v: _samples(fs, v)
    none = np.full(m, -1)
    on, off = qrs_bounds(env, r, now, d_qrs, cfg, floor)
    # base line for T: the stretch before the QRS
    iso_lo, iso_hi = on - ms(ISO_MS[0]), on - ms(ISO_MS[1])
    can = (on >= 0) & (iso_lo >= max(0, floor - d_t)) & (iso_hi <= now - 1 - d_t) & (iso_hi > iso_lo + 1)
    _, v, inside = _rows(wave, np.where(can, iso_lo, 0), np.where(can, iso_hi, 0), d_t)
    iso = np.where(can, upper_median(v, inside), np.nan)
    guard = np.maximum(ms(T_GUARD[0]), (rr_after * T_GUARD[1]).astype(np.int64))
    span = np.minimum(ms(T_WINDOW[0]), (rr_after * T_WINDOW[1]).astype(np.int64))
    lo, hi = r + guard, np.minimum(r + span, now - 1 - d_t)
    t_ok = (on >= 0) & (rr_after > 0) & (span > guard) & (hi > lo + 2)
    hi = np.where(t_ok, hi, lo)
    found, t_on, t_peak, t_off, base, _ = _wave(wave, lo, hi, d_t, iso)
    t_ok &= found
    t_off = np.maximum(_tangent(wave, t_peak, t_off, hi, base, d_t) + int(np.floor(T_OFFSET_MS * fs / 1000 + 0.5)), t_peak)
    t_on, t_peak, t_off = (np.where(t_ok, x, none) for x in (t_on, t_peak, t_off))
    # P: not before the T wave of the beat before has ended
    guard = np.maximum(ms(P_GUARD[0]), (rr_before * P_GUARD[1]).astype(np.int64))
    span = np.minimum(ms(P_WINDOW[0]), (rr_before * P_WINDOW[1]).astype(np.int64))
    a_hi = np.maximum(r - guard, 0)
    a_lo = np.maximum(a_hi - span, 0)
    ended = np.full(m, -1, np.int64)
    good = np.flatnonzero(on >= 0)  # a beat without bounds leaves the last T as it was
    if len(good):
        ended[good] = np.r_[t_before, t_off[good][:-1]]
    lo = np.maximum(np.maximum(a_lo, ended), max(0, floor - d_p))
    p_ok = (on >= 0) & (rr_before > 0) & (a_hi > lo + 2) & (a_hi <= now - 1 - d_p)
    lo, hi = np.where(p_ok, lo, 0), np.where(p_ok, a_hi, 0)
    found, p_on, p_peak, p_off, base, (_, _, inside, height) = _wave(wave, lo, hi, d_p, None)
    p_ok &= found
    noise = np.maximum(upper_median(height, inside), 1e-6)
    signed = wave[np.clip(p_peak + d_p, 0, len(wave) - 1)] - base
    sure = np.where(p_ok, np.abs(signed) / noise, 0.0)
    p_ok &= sure >= P_CONFIDENCE
    p_off = np.maximum(p_off + int(np.floor(P_OFFSET_MS * fs / 1000 + 0.5)), p_peak)
    p_on, p_peak, p_off = (np.where(p_ok, x, none) for x in (p_on, p_peak, p_off))
    pr = np.where(p_ok, np.maximum(on - p_on, 0) * 1000.0 / fs, np.nan)
    return Waves(r, on, off, p_on, p_peak, p_off, sure, np.where(p_ok, signed, 0.0), t_on, t_peak, t_off, pr, np.where((on >= 0) & (rr_before > 0), a_lo, -1), a_hi)


def unit_rows(x: np.ndarray, start: np.ndarray, end: np.ndarray, now: np.ndarray, floor: int, points: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """(rows, usable): x from start to end at ``points`` points, zero mean and unit norm; not usable where that is not all seen."""
    ok = (end > start + 2) & (start >= max(0, floor)) & (end < now)
    pos = np.where(ok, start, 0)[:, None] + np.where(ok, end - start, 0)[:, None] * np.arange(points) / (points - 1)
    i = np.clip(np.floor(pos).astype(np.int64), 0, len(x) - 1)
    f = pos - i
    v = x[i] * (1 - f) + x[np.minimum(i + 1, len(x) - 1)] * f
    v = v - v.mean(1, keepdims=True)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.maximum(n, 1e-6), ok
