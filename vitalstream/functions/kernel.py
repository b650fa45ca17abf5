"""All of a channel, samples in and events out: filters, quality, beats, waves, shapes, fibrillation windows.

Everything after an event (intervals, rhythm, episodes, classes) is DataFrame
work over the events; the kernel holds what hangs on every sample before it.
An event is (kind, sample, values, vector); FIELDS names its values.
"""

from __future__ import annotations

import numpy as np

from ..config import CLINICAL, ChannelConfig
from . import fibrillation, quality, shapes, stages, waves
from .detector import Beat
from .dsp import FilterBank, mains_frequency

FIELDS = {
    "beat": ("now", "amplitude", "energy", "margin", "recovered", "interval_energy", "score", "unusable", "rr_rel", "span_quality", "span_lead"),
    "shape": (
        "now", *shapes.FEATURES, "qrs_on", "qrs_off", "p_on", "p_peak", "p_off", "p_confidence", "p_amplitude", "t_on", "t_peak", "t_off", "pr_ms",
        "quality_ok", "template_ready", "group", "group_ncc", "legibility",
    ),
    "quality": (*quality.FEATURES, "flags", "score", "level"),
    "window": fibrillation.FEATURES,
    "leadoff": ("kind", "end"),
    "group": ("what", "into"),
    "gap": ("missing",),
}
Event = tuple[str, int, list[float], list[float] | None]


class ChannelKernel:
    """Fed with blocks of samples of any length; the blocks make no difference to the events."""

    def __init__(self, cfg: ChannelConfig = CLINICAL, chosen: stages.Selection | None = None) -> None:
        self.cfg, self.fs, self.bank = cfg, cfg.fs, None
        self.stages = chosen or stages.selection("", cfg)
        self.first: list[np.ndarray] = []
        self.n = 0

    def _start(self, mains: float | None) -> None:
        cfg = self.cfg
        self.bank = FilterBank(cfg, mains)
        at = lambda tap, hz: self.bank.delay(tap, hz)
        self.envelope = cfg.samples(waves.ENVELOPE_MS)
        whole = lambda v: max(0, int(np.floor(v + 0.5)))
        self.delays = whole(at("qrs", 10.0) + (self.envelope - 1) / 2), whole(at("wave", 10.0)), whole(at("wave", 6.0))
        make = self.stages.make
        self.monitor, self.off = make("quality"), quality.LeadOff(cfg)
        self.detector, self.windows = make("qrs", at("clean", 12.0)), make("vf")
        self.analyzer, self.leader = make("beat"), shapes.Leader(cfg.join_ncc, cfg.shape_rate, cfg.most_shapes, cfg.merge_ncc)
        self.monitor.n = self.detector.n = self.detector.pos = self.detector.start = self.windows.n = self.n
        self.pace = 0.0
        self.bad = self.unled = self.bad_then = self.unled_then = 0
        self.last_beat: int | None = None
        self.quiet_from: int | None = None
        self._restart()

    def _restart(self) -> None:
        self.base = self.n
        self.held = {k: np.zeros(0) for k in ("clean", "qrs", "wave", "env")}
        self.size_tail = np.zeros(0)
        self.beats: list[Beat] = []
        self.t_before, self.rr_before2 = -1, float("nan")
        self.before: int | None = None

    def gap(self, samples: int) -> list[Event]:
        """Samples that were lost: windows start anew, what was learnt stays, the clock moves on."""
        waiting = sum(map(len, self.first))
        self.first = []
        self.n += samples + waiting
        if self.bank is not None:
            self.bank.reset()
            for part in (self.monitor, self.detector, self.windows):
                part.on_gap(samples + waiting)
            self.off.on_gap()
            self.analyzer.on_gap()
            self._restart()
        return [("gap", self.n - samples, [float(samples)], None)]

    def finish(self) -> list[Event]:
        """What the end of the channel settles."""
        out = []
        if self.bank is None and self.first:
            out = self._run(np.concatenate(self.first), True)
        if self.bank is not None and (e := self.off.finish(self.n)):
            out.append(self._leadoff(e))
        return out

    def push(self, x: np.ndarray) -> list[Event]:
        """Until two seconds have come the mains frequency is not known, and samples wait."""
        x = np.asarray(x, np.float64)
        if self.bank is None:
            self.first.append(x)
            if sum(map(len, self.first)) < 2 * self.fs:
                return []
            x = np.concatenate(self.first)
        return self._run(x, False)

    def _run(self, x: np.ndarray, final: bool) -> list[Event]:
        if self.bank is None:
            probe = x[: int(2 * self.fs)]
            self._start(None if final else mains_frequency(probe - probe.mean(), self.fs, least=self.cfg.mains_snr))
            self.first = []
        if not len(x):
            return []
        bands = self.bank.process(x)
        out: list[Event] = []
        n0 = self.n
        flags0, score0, level0 = self.monitor.last
        hops = self.monitor.push(bands)
        turn = np.searchsorted(hops["at"] - 1, np.arange(n0, n0 + len(x)), side="right")
        level = np.r_[level0, hops["level"]][turn]
        score = np.r_[score0, hops["score"]]
        led = (np.r_[flags0, hops["flags"]] & quality.SATURATION == 0)[turn]
        good = level != 2
        beats = self.detector.push(bands["qrs"], bands["clean"], good)
        self.n += len(x)
        bad, unled = np.cumsum(~good) + self.bad, np.cumsum(~led) + self.unled
        for b in beats:
            k = b.now - n0
            b.score, b.unusable = float(score[turn[k]]), bool(level[k] == 2)
            b.span_quality, b.span_lead = int(bad[k]) == self.bad_then, int(unled[k]) == self.unled_then
            self.bad_then, self.unled_then = int(bad[k]), int(unled[k])
            if self.last_beat is not None:
                rr = b.sample - self.last_beat
                b.rr_rel = rr / self.pace if self.pace > 0 else 1.0
                if 300 <= rr * 1000 / self.fs < 2000:
                    self.pace = self.pace + 0.1 * (rr - self.pace) if self.pace > 0 else float(rr)
            self.last_beat = b.sample
            if not (self.cfg.suppress_unusable and b.unusable):
                out.append(("beat", b.sample, [float(v) for v in (b.now, b.amplitude, b.energy, min(b.margin, 1e9), b.recovered, b.interval_energy, b.score, b.unusable, b.rr_rel, b.span_quality, b.span_lead)], None))
        self.bad, self.unled = int(bad[-1]), int(unled[-1])
        self._hops(hops, beats, out)
        at, rows = self.windows.push(bands["clean"])
        out += [("window", n, row, None) for n, row in zip(at.tolist(), rows.tolist(), strict=True)]
        self._hold(bands)
        self._shapes(beats, out)
        return out

    def _leadoff(self, e: tuple[str, int, int]) -> Event:
        return ("leadoff", e[1], [0.0 if e[0] == "rail" else 1.0, float(e[2])], None)

    def _hops(self, hops: dict, beats: list[Beat], out: list[Event]) -> None:
        cols = [hops[k].tolist() for k in FIELDS["quality"]]
        said = [(b.now, b.sample) for b in beats]
        heard = said.pop(0) if said else None
        for n, *row in zip(hops["at"].tolist(), *cols, strict=True):
            out.append(("quality", n, row, None))
            while heard and heard[0] < n:
                self.quiet_from = heard[1]
                heard = said.pop(0) if said else None
            since = np.inf if self.quiet_from is None else n - self.quiet_from
            hop = {"saturated": row[6], "p2p_rel": row[8], "qrs_ratio_rel": row[10], "flags": row[11]}
            if e := self.off.push(n, hop, since):
                out.append(self._leadoff(e))
        if heard:
            self.quiet_from = (said or [heard])[-1][1]

    def _hold(self, bands: dict[str, np.ndarray]) -> None:
        """Six seconds of the taps that waves and shapes read, and all of the block."""
        size = np.r_[self.size_tail, np.abs(bands["qrs"])]
        total = np.r_[0.0, np.cumsum(size)]
        end = np.arange(len(self.size_tail) + 1, len(size) + 1)
        some = np.minimum(end, self.envelope)
        made = {"clean": bands["clean"], "qrs": bands["qrs"], "wave": bands["wave"], "env": np.maximum(total[end] - total[end - some], 0.0) / some}
        self.size_tail = size[-(self.envelope - 1) :] if self.envelope > 1 else np.zeros(0)
        drop = max(0, len(self.held["clean"]) - int(6 * self.fs))
        self.held = {k: np.r_[self.held[k][drop:], v] for k, v in made.items()}
        self.base += drop

    def _shapes(self, beats: list[Beat], out: list[Event]) -> None:
        """Beats whose next has come."""
        line = [*self.beats, *beats]
        self.beats = line[-1:]
        if len(line) < 2:
            return
        cfg, base, h = self.cfg, self.base, self.held
        r = np.array([b.sample for b in line[:-1]]) - base
        ahead = np.array([b.sample for b in line[1:]]) - base
        now = np.array([b.now for b in line[1:]]) + 1 - base
        back = np.r_[r[0] if self.before is None else self.before - base, r[:-1]]
        before, after = np.maximum(r - back, 0), np.maximum(ahead - r, 0)
        known = np.r_[self.before is not None, np.ones(len(r) - 1, bool)]
        w = waves.delineate(h["env"], h["wave"], r, np.where(known, before, 0), after, now, self.delays, cfg, self.t_before - base if self.t_before >= 0 else -1)
        w.qrs_on[~known] = -1  # without a beat before there is no wave
        vectors, usable = waves.unit_rows(h["clean"], r - int(0.12 * self.fs), r + int(0.2 * self.fs), now, 0)
        d = self.delays[1]
        atrial, has_atrial = waves.unit_rows(h["wave"], w.atrial_lo + d, w.atrial_hi + d, now, 0)
        has_atrial &= w.atrial_lo >= 0
        sizes = shapes.measures(h["clean"], h["qrs"], r, now, cfg)
        onsets = shapes.onset_shape(h["clean"], w.qrs_on, w.qrs_off, now, cfg)
        to_ms = 1000.0 / self.fs
        for k, beat in enumerate(line[:-1]):
            rr = float(before[k]) * to_ms if known[k] else float("nan")
            post = float(after[k]) * to_ms
            if known[k] and 200 <= rr < 3000 and beat.span_quality:
                self.analyzer.rr.push(rr)
            if usable[k]:
                f, ready = self.analyzer.observe(w, k, base, vectors[k], sizes[k], onsets[k], atrial[k] if has_atrial[k] else None, (self.rr_before2, rr, post), beat.span_quality)
                group, alike = self.leader.add(vectors[k]) if beat.span_quality and ready else (-1, 0.0)
                places = [float(v + base) if v >= 0 else -1.0 for v in (w.qrs_on[k], w.qrs_off[k], w.p_on[k], w.p_peak[k], w.p_off[k])]
                ends = [float(v + base) if v >= 0 else -1.0 for v in (w.t_on[k], w.t_peak[k], w.t_off[k])]
                values = [float(line[k + 1].now), *f, *places, float(w.p_confidence[k]), float(w.p_amplitude[k]), *ends, float(w.pr_ms[k])]
                values += [float(beat.span_quality), float(ready), float(group), alike, self.analyzer.legibility()]
                out.append(("shape", beat.sample, values, vectors[k].tolist()))
                for what, gone, into in self.leader.events:
                    out.append(("group", gone, [float(what == "merged"), float(into)], None))
                self.leader.events.clear()
            self.rr_before2 = rr
            if w.qrs_on[k] >= 0:
                self.t_before = int(w.t_off[k]) + base if w.t_off[k] >= 0 else -1
        self.before = line[-2].sample
