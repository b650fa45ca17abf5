"""Signal quality of one channel: window features on a hop, slow references, flags and score.

All sums over windows are differences of cumulative sums, so a block of any
length is a few array operations; only the references, which hang on what was
admitted before, go hop by hop.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np

from ..config import ChannelConfig

# Bits of the flags.
SATURATION, FLATLINE, BASELINE, EMG, LOW_AMPLITUDE, UNSTABLE, LEAD_OFF = (1 << k for k in range(7))
FEATURES = ("kurtosis", "skewness", "hf_ratio", "base_ratio", "qrs_ratio", "p2p", "saturated", "flat", "p2p_rel", "kurtosis_rel", "qrs_ratio_rel")
#: A reference takes a value every so many hops.
EVERY = 4
_SUMS = ("c1", "c2", "c3", "c4", "b1", "b2", "h2", "q2", "sat")


class UpperMedian:
    """Of the last ``most`` values, the upper one of two."""

    def __init__(self, most: int) -> None:
        self.most, self.order, self.sorted = most, deque(), []

    def __len__(self) -> int:
        return len(self.order)

    def push(self, v: float) -> None:
        if len(self.order) == self.most:
            self.sorted.pop(bisect_left(self.sorted, self.order.popleft()))
        self.order.append(v)
        insort(self.sorted, v)

    def value(self, default: float = 0.0) -> float:
        return self.sorted[len(self.sorted) // 2] if self.sorted else default


def ramp(x, lo: float, hi: float):
    return np.clip((x - lo) / (hi - lo), 0.0, 1.0)


def flags(f: dict, cfg: ChannelConfig) -> np.ndarray:
    """The seven bits of feature arrays."""
    rel = f["p2p_rel"]
    tests = (
        f["saturated"] > cfg.saturated_bad, f["flat"] > cfg.flat_bad, f["base_ratio"] > cfg.base_warn, f["hf_ratio"] > cfg.hf_warn,
        (rel < cfg.amplitude_low) | (rel > cfg.amplitude_high), (f["kurtosis"] < cfg.kurtosis_warn) & (f["kurtosis_rel"] < cfg.relative_warn), rel < cfg.amplitude_off,
    )
    return sum(np.asarray(t, np.int64) << k for k, t in enumerate(tests))


def score(f: dict, cfg: ChannelConfig) -> np.ndarray:
    """Mean of three soft terms, times what vetoes outright."""
    rel = f["p2p_rel"]
    peaked = np.maximum(ramp(f["kurtosis"], cfg.kurtosis_bad, cfg.kurtosis_warn), ramp(f["kurtosis_rel"], cfg.relative_bad, cfg.relative_warn))
    share = np.maximum(ramp(f["qrs_ratio"], cfg.qrs_ratio_bad, cfg.qrs_ratio_warn), ramp(f["qrs_ratio_rel"], cfg.relative_bad, cfg.relative_warn))
    size = ramp(rel, cfg.amplitude_low / 2, cfg.amplitude_low) * (1 - ramp(rel, cfg.amplitude_high, 2 * cfg.amplitude_high))
    keep = (1 - ramp(f["hf_ratio"], cfg.hf_bad, 1.0)) * (1 - ramp(f["base_ratio"], cfg.base_bad, 1.0)) * ramp(rel, cfg.amplitude_off / 2, cfg.amplitude_off)
    keep = keep * (1 - ramp(f["saturated"], cfg.saturated_bad / 2, cfg.saturated_bad)) * (1 - ramp(f["flat"], 0.8 * cfg.flat_bad, cfg.flat_bad))
    return np.clip((peaked + share + size) / 3 * keep, 0.0, 1.0)


def level(bits: np.ndarray, scores: np.ndarray, cfg: ChannelConfig) -> np.ndarray:
    """0 good, 1 acceptable, 2 unusable."""
    bad = (bits & (SATURATION | FLATLINE) != 0) | (scores <= cfg.score_bad)
    return np.where(bad, 2, np.where(scores <= cfg.score_warn, 1, 0))


class Monitor:
    """Hops of a channel, block by block."""

    def __init__(self, cfg: ChannelConfig) -> None:
        self.cfg, self.window, self.hop = cfg, cfg.samples(cfg.window_ms), cfg.samples(cfg.hop_ms)
        most = max(1, int(cfg.reference_ms / (cfg.hop_ms * EVERY)))
        self.refs = [UpperMedian(most) for _ in range(3)]
        self.waited, self.eps = EVERY, 1e-7
        self.n = 0
        self._restart()
        #: What holds at the end of the last block: flags, score, level.
        self.last = (0, 1.0, 0)

    def _restart(self) -> None:
        self.since = 0
        self.tail = {k: np.zeros(0) for k in ("clean", "base", "hf", "qrs", "sat", "flat")}
        self.before = 0.0

    def on_gap(self, samples: int) -> None:
        self.n += samples
        self._restart()

    def push(self, bands: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Arrays of the hops that the block completes: ``at`` (samples seen), features, flags, score, level."""
        size, w = len(bands["clean"]), self.window
        new = {"clean": bands["clean"], "base": bands["baseline"], "hf": bands["hf"], "qrs": bands["qrs"], "sat": bands["saturated"].astype(float)}
        old = len(self.tail["clean"])
        x = {k: np.r_[self.tail[k], v] for k, v in new.items()}
        change = np.abs(np.diff(x["clean"], prepend=self.before if not old else x["clean"][0]))
        # ends of hops, as counts of samples of x; since counts samples from the start or the last gap
        first = self.hop - self.since % self.hop
        ends = np.arange(first, size + 1, self.hop) + old
        whole = ends[self.since + ends - old >= w]
        c = x["clean"]
        sums = {"c1": c, "c2": c * c, "c3": c**3, "c4": c**4, "b1": x["base"], "b2": x["base"] ** 2, "h2": x["hf"] ** 2, "q2": x["qrs"] ** 2, "sat": x["sat"]}
        total = {k: np.r_[0.0, np.cumsum(v)] for k, v in sums.items()}
        m = {k: (total[k][whole] - total[k][whole - w]) / w for k in _SUMS}
        var = np.maximum(m["c2"] - m["c1"] ** 2, 0.0)
        spread = np.where(var > 1e-24, var, 1.0)
        f = {
            "kurtosis": np.where(var > 1e-24, (m["c4"] - 4 * m["c1"] * m["c3"] + 6 * m["c1"] ** 2 * m["c2"] - 3 * m["c1"] ** 4) / spread**2 - 3, 0.0),
            "skewness": np.where(var > 1e-24, (m["c3"] - 3 * m["c1"] * m["c2"] + 2 * m["c1"] ** 3) / spread**1.5, 0.0),
            "hf_ratio": m["h2"] / (m["h2"] + m["c2"] + 1e-12), "qrs_ratio": m["q2"] / (m["c2"] + 1e-12), "saturated": m["sat"],
        }
        low = np.maximum(m["b2"] - m["b1"] ** 2, 0.0)
        f["base_ratio"] = low / (low + m["c2"] + 1e-12)
        views = [c[e - w : e] for e in whole.tolist()]
        f["p2p"] = np.array([v.max() - v.min() for v in views])
        self._references(f, whole, ends, change, x)
        f["flags"], f["at"] = flags(f, self.cfg), whole - old + self.n
        f["score"] = score(f, self.cfg)
        f["level"] = level(f["flags"], f["score"], self.cfg)
        self.n += size
        self.since += size
        if size:
            self.before = float(c[-1])
        self.tail = {k: v[-w:] for k, v in {**x, "flat": self.flat}.items()}
        if len(whole):
            self.last = (int(f["flags"][-1]), float(f["score"][-1]), int(f["level"][-1]))
        return f

    def _references(self, f: dict, whole: np.ndarray, ends: np.ndarray, change: np.ndarray, x: dict) -> None:
        """Relative features, hop by hop; and which samples are flat by the reference of the hop before."""
        cfg, w = self.cfg, self.window
        p2p, kurt, qrs = self.refs
        out = np.ones((3, len(whole)))
        flat = np.r_[self.tail["flat"], np.zeros(len(change) - len(self.tail["flat"]))]
        done, shares = len(self.tail["flat"]), np.zeros(len(whole))
        calm = (f["hf_ratio"] < cfg.hf_warn) & (f["base_ratio"] < cfg.base_warn) & (f["saturated"] <= 0)
        values = list(zip(f["p2p"].tolist(), f["kurtosis"].tolist(), f["qrs_ratio"].tolist(), calm.tolist(), strict=True))
        for k, end in enumerate(whole.tolist()):
            flat[done:end] = change[done:end] < self.eps
            done = end
            shares[k] = flat[end - w : end].sum() / w
            size, peaked, share, quiet = values[k]
            usual, rel = p2p.value(), 1.0
            if len(p2p) > 1:
                rel = size / usual if usual > 1e-9 else 1.0
                out[:, k] = rel, peaked / max(kurt.value(), 0.5), share / max(qrs.value(), 1e-3)
            self.waited += 1
            if not len(p2p) or (quiet and rel > cfg.amplitude_off and self.waited >= EVERY):
                self.waited = 0
                p2p.push(size)
                kurt.push(peaked)
                qrs.push(share)
            self.eps = max(1e-7, (usual if usual > 1e-9 else size) * cfg.flat_share)
        flat[done:] = change[done:] < self.eps
        self.flat = flat
        f["flat"], (f["p2p_rel"], f["kurtosis_rel"], f["qrs_ratio_rel"]) = shares, out


class LeadOff:
    """Episodes of an electrode that is off: at a rail, or an open input. Two hops of one kind open, four clear ones close."""

    def __init__(self, cfg: ChannelConfig) -> None:
        self.cfg, self.open, self.pending, self.holding, self.clearing = cfg, None, None, 0, 0

    def push(self, at: int, hop: dict, since_beat: float) -> tuple[str, int, int] | None:
        """(kind, start, end) of an episode that this hop ends. No beat for long holds an open one and never opens one."""
        cfg, kind = self.cfg, None
        if hop["saturated"] >= cfg.rail_share or int(hop["flags"]) & SATURATION:
            kind = "rail"
        elif hop["p2p_rel"] >= cfg.open_amplitude and hop["qrs_ratio_rel"] <= cfg.open_qrs:
            kind = "open"
        elif self.open and since_beat >= cfg.quiet_ms * cfg.fs / 1000:
            kind = self.open[0]
        if kind:
            self.clearing = 0
            self.holding = self.holding + 1 if kind == self.pending else 1
            self.pending = kind
            if not self.open and self.holding >= cfg.enter_hops:
                self.open = (kind, at)
            return None
        self.holding, self.pending = 0, None
        self.clearing += 1
        return self.finish(at) if self.clearing >= cfg.exit_hops else None

    def finish(self, at: int) -> tuple[str, int, int] | None:
        found, self.open = self.open, None
        return (*found, at) if found else None

    def on_gap(self) -> None:
        self.holding = self.clearing = 0
        self.pending = None
