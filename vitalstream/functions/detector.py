"""Beats of one channel: adaptive threshold on the energy of the slope, with a search back for missed beats.

Decisions hang on candidates, stretches over the threshold, so work on samples is
array operations and only candidates are looked at one by one. All positions
are counts of samples since the channel's start.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..config import ChannelConfig


def median_nearest(values: list[float], q: float = 0.5) -> float:
    """Nearest rank; 0 of nothing."""
    if not values:
        return 0.0
    return sorted(values)[int(q * (len(values) - 1) + 0.5)]


@dataclass
class Beat:
    sample: int
    now: int
    amplitude: float
    energy: float
    margin: float
    recovered: bool
    interval_energy: float
    score: float = 1.0
    unusable: bool = False
    rr_rel: float = 1.0
    span_quality: bool = True
    span_lead: bool = True


class Pace:
    """Intervals of late: the steady ones are within 0.92 to 1.16 of their own mean."""

    def __init__(self, fs: float) -> None:
        self.fs, self.steady, self.mean = fs, [], 0.8 * fs

    def push(self, rr: float) -> None:
        if 0.2 * self.fs <= rr <= 3 * self.fs and 0.92 * self.mean <= rr <= 1.16 * self.mean:
            self.steady = [*self.steady[-7:], rr]
            self.mean = sum(self.steady) / len(self.steady)


class Detector:
    def __init__(self, cfg: ChannelConfig, delay: float = 0.0) -> None:
        self.cfg = cfg
        self.width, self.refractory = cfg.samples(cfg.integration_ms), cfg.samples(cfg.refractory_ms)
        self.t_wave, self.reach = cfg.samples(cfg.t_wave_ms), cfg.samples(cfg.refine_ms)
        self.learn, self.keep, self.shift = cfg.samples(cfg.learn_ms), cfg.samples(4000.0), int(np.floor(delay + 0.5))
        self.energies: list[float] = []
        self.slopes: list[float] = []
        self.scale, self.noise, self.learning = 1.0, 0.0, True
        self.pace, self.last, self.peak = Pace(cfg.fs), None, None
        self.quiet_sum, self.quiet_n = 0.0, 0
        self.learn_top, self.learn_sum = 0.0, 0.0
        self.n = self.pos = 0
        self._restart()

    def _restart(self) -> None:
        self.start = self.pos = self.n
        self.energy, self.clean, self.slope, self.good = (np.zeros(0) for _ in range(4))
        self.tail, self.squares = np.zeros(4), np.zeros(0)
        self.last = self.peak = None

    def latency(self) -> int:
        """Samples after a beat by which it is told, when it is not recovered."""
        return self.width + self.reach

    def on_gap(self, samples: int) -> None:
        """Windows start anew, the clock moves on, what was learnt stays."""
        self.n += samples
        self._restart()

    # levels
    def height(self) -> float:
        return median_nearest(self.energies, self.cfg.peak_quantile) * self.scale

    def threshold(self, good: bool) -> float:
        top = self.height()
        floor = min(self.noise, 0.5 * top) if good else self.noise
        return floor + self.cfg.threshold_share * (top - floor) if top > floor else floor

    def push(self, qrs: np.ndarray, clean: np.ndarray, good: np.ndarray) -> list[Beat]:
        """Beats that are now certain. ``good``: whether levels may learn from each sample."""
        if not len(qrs):
            return []
        x = np.r_[self.tail, qrs]
        slope = (2 * x[4:] + x[3:-1] - x[1:-3] - 2 * x[:-4]) * self.cfg.fs / 1600
        squares = np.r_[self.squares, slope * slope]
        total = np.r_[0.0, np.cumsum(squares)]
        end = np.arange(len(self.squares) + 1, len(squares) + 1)
        held = np.minimum(end, self.width)
        energy = np.maximum(total[end] - total[end - held], 0.0) / held
        self.tail, self.squares = x[-4:], squares[-(self.width - 1) :] if self.width > 1 else np.zeros(0)
        for name, new in (("energy", energy), ("clean", clean), ("slope", np.abs(slope)), ("good", np.asarray(good, bool))):
            setattr(self, name, np.r_[getattr(self, name), new].astype(bool if name == "good" else float))
        self.n += len(qrs)
        out: list[Beat] = []
        if self.learning:
            self._learn()
        if not self.learning:
            self._scan(out)
        drop = min(len(self.energy) - self.keep, self.pos - self.start - self.keep // 2, (self.peak or self.n) - self.start)
        if drop > 0:
            for name in ("energy", "clean", "slope", "good"):
                setattr(self, name, getattr(self, name)[drop:])
            self.start += drop
        return out

    def _learn(self) -> None:
        """Levels from the first two seconds, which hold no beat that could be told."""
        stop = min(self.n, self.learn)
        some = self.energy[self.pos - self.start : stop - self.start] if stop > self.pos else np.zeros(0)
        if len(some):
            self.learn_top, self.learn_sum = max(self.learn_top, float(some.max())), self.learn_sum + float(some.sum())
        self.pos = max(self.pos, stop)
        if self.n >= self.learn:
            top = max(0.25 * self.learn_top, 1e-12)
            self.noise = min(0.5 * self.learn_sum / self.learn, 0.5 * top)
            self.energies, self.learning = [top], False

    def _over(self, lo: int, hi: int) -> np.ndarray | float:
        """The threshold at each sample; it hangs on quality only between events."""
        good = self.good[lo - self.start : hi - self.start]
        return self.threshold(True) if good.all() else np.where(good, self.threshold(True), self.threshold(False))

    def _scan(self, out: list[Beat]) -> None:
        while True:
            if self.peak is not None:
                done = self._close()
                if done is None:
                    return
                n, at, top, thr = done
                self.peak, self.pos = None, n + 1
                self._judge(at, top, thr, n, False, out)
                self._back(n, out)
                continue
            if self.pos >= self.n:
                return
            due = self.n if self.last is None else self.last + max(int(self.pace.mean * self.cfg.search_back), self.refractory) + 1
            stop = min(self.n, max(due, self.pos) + 1, self.pos + 2048)
            y = self.energy[self.pos - self.start : stop - self.start]
            over = y > self._over(self.pos, stop)
            k = int(over.argmax())
            opened = bool(over[k])
            end = self.pos + k if opened else stop - 1
            if self.last is not None:
                lo = max(self.pos, self.last + self.refractory + 1)
                if lo <= end:
                    self.quiet_sum += float(self.energy[lo - self.start : end + 1 - self.start].sum())
                    self.quiet_n += end + 1 - lo
            self.pos = end + 1
            if opened:
                self.peak = end
            elif end >= due:
                self._back(end, out)

    def _close(self) -> tuple[int, int, float, float] | None:
        """(sample, peak, its energy, threshold) where the open candidate ends, once that has come."""
        span = 80
        while True:
            y = self.energy[self.peak - self.start : self.peak + span - self.start]
            top = np.maximum.accumulate(y)
            rise = np.ones(len(y), bool)
            np.greater(y[1:], top[:-1], out=rise[1:])
            thr = self._over(self.peak, self.peak + len(y))
            col = np.arange(len(y))
            at = np.maximum.accumulate(np.where(rise, col, 0))
            ends = ~rise & ((y < thr) | (y < top * self.cfg.peak_drop) | (col - at > self.width + self.refractory))
            k = int(ends.argmax())
            if ends[k]:
                return self.peak + k, self.peak + int(at[k]), float(top[k]), float(thr if isinstance(thr, float) else thr[k])
            if self.peak + span >= self.n:
                return None
            span *= 4

    def _back(self, n: int, out: list[Beat]) -> None:
        """Overdue: the highest energy since the last beat is one if it is over half the threshold. A T wave counts as nothing found."""
        miss = int(self.pace.mean * self.cfg.search_back)
        if self.last is None or n <= self.last + max(miss, self.refractory):
            return
        lo, hi = max(self.last + self.refractory + 1, self.start, n - self.keep), n - self.width // 2
        good = bool(self.good[n - self.start])
        if hi > lo:
            at = lo + int(self.energy[lo - self.start : hi - self.start].argmax())
            top, half = float(self.energy[at - self.start]), 0.5 * self.threshold(good)
            if top > half and self._judge(at, top, half, n, True, out):
                return
        if good:
            self.scale *= 0.9
        self.last = n - miss // 2

    def _judge(self, at: int, top: float, thr: float, n: int, recovered: bool, out: list[Beat]) -> bool:
        good = bool(self.good[n - self.start])
        steep = self.slope[max(0, at - self.width - self.start) : at + 1 - self.start]
        slope = float(steep.max()) if len(steep) else 0.0
        if self.last is not None:
            if at <= self.last + self.refractory:
                return False
            usual, high = median_nearest(self.slopes), median_nearest(self.energies)
            if at - self.last < self.t_wave and usual > 0 and high > 0 and slope < 0.5 * usual and top < 0.5 * high:
                if good:
                    self.noise = 0.125 * top + 0.875 * self.noise
                return False
            self.pace.push(at - self.last)
        lo, hi = max(self.start, at - self.width - self.reach), min(at - self.width // 2 + self.reach + 1, self.n)
        part = self.clean[lo - self.start : hi - self.start]
        spot = lo + int(np.abs(part).argmax()) if len(part) else at
        if good:
            self.energies, self.slopes, self.scale = [*self.energies[-7:], top], [*self.slopes[-7:], slope], 1.0
        height = self.height()
        quiet = self.quiet_sum / self.quiet_n / height if self.quiet_n and height > 1e-12 else 0.0
        self.quiet_sum, self.quiet_n, self.last = 0.0, 0, at
        out.append(Beat(max(0, spot - self.shift), n, float(self.clean[spot - self.start]) if len(part) else 0.0, top, top / thr if thr > 0 else np.inf, recovered, quiet))
        return True
