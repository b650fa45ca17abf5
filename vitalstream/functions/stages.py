"""Stages of the channel kernel and of the operators after it: what each kind does, and the implementations there are.

A stage is made from settings. Its name is ``kind.variant@version``; made from
settings other than the registered ones it is ``kind.variant@version.configured``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from typing import Protocol

import numpy as np

from ..config import CLINICAL, ChannelConfig, Registry
from . import fibrillation, irregular
from .detector import Beat, Detector
from .quality import Monitor
from .shapes import Analyzer


class QualityStage(Protocol):
    def push(self, bands: dict[str, np.ndarray]) -> dict[str, np.ndarray]: ...
    def on_gap(self, samples: int) -> None: ...


class QrsStage(Protocol):
    def push(self, qrs: np.ndarray, clean: np.ndarray, good: np.ndarray) -> list[Beat]: ...
    def on_gap(self, samples: int) -> None: ...
    def latency(self) -> int: ...


class BeatStage(Protocol):
    def observe(self, *args) -> tuple[list[float], bool]: ...
    def on_gap(self) -> None: ...


class VfStage(Protocol):
    def push(self, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...
    def on_gap(self, samples: int) -> None: ...


class AfStage(Protocol):
    def __call__(self, features: dict[str, np.ndarray]) -> np.ndarray: ...


class SvRunStage(Protocol):
    def push(self, rr: float, at: float, usable: bool, fibrillating: bool) -> tuple[float, float, int] | None: ...


class RhythmStage(Protocol):
    def __call__(self, rr): ...


class SteadyQuality(Monitor):
    """Every hop is good: for signals that are known to be clean."""

    def push(self, bands: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        hops = super().push(bands)
        hops |= {"flags": np.zeros(len(hops["at"]), np.int64), "score": np.ones(len(hops["at"])), "level": np.zeros(len(hops["at"]), np.int64)}
        self.last = (0, 1.0, 0)
        return hops


class NoRuns:
    """Tells no run."""

    def push(self, rr: float, at: float, usable: bool, fibrillating: bool) -> None:
        return None

    def finish(self) -> None:
        return None


def _sv_runs(cfg: ChannelConfig):
    from ..operators.rhythm import SvRuns

    return SvRuns()


def _bank(cfg: ChannelConfig, events_only: bool = False):
    from ..operators import rhythm

    p = rhythm.BankParams(pause=cfg.pause_ms, asystole=cfg.asystole_ms, slow=cfg.slow_bpm, fast=cfg.fast_bpm, quiet=cfg.quiet_energy)
    return partial(rhythm.bank, p=p) if not events_only else lambda rr: rhythm.bank(rr, p).where("kind IN ('pause', 'asystole')")


# Named functions, so that a stage in a channel's stored state is a name.
def _slope(cfg: ChannelConfig, delay: float = 0.0) -> Detector:
    return Detector(cfg, delay)


def _eager(cfg: ChannelConfig, delay: float = 0.0) -> Detector:
    return Detector(cfg.override(search_back=1.4), delay)


def _published(cfg: ChannelConfig) -> AfStage:
    return irregular.probability


def _never(cfg: ChannelConfig) -> AfStage:
    return _no_af


def _no_af(features: dict[str, np.ndarray]) -> np.ndarray:
    return np.zeros(len(next(iter(features.values()))))


def _windows(cfg: ChannelConfig) -> VfStage:
    return fibrillation.Windows(cfg.fs)


def _no_runs(cfg: ChannelConfig) -> NoRuns:
    return NoRuns()


def _pauses(cfg: ChannelConfig) -> RhythmStage:
    return _bank(cfg, True)


REGISTRY = Registry()
_ADD: list[tuple[str, str, Callable]] = [
    ("quality", "window", Monitor), ("quality", "steady", SteadyQuality), ("qrs", "slope", _slope), ("qrs", "eager", _eager), ("beat", "template", Analyzer), ("af", "published", _published), ("af", "never", _never),
    ("vf", "window", _windows), ("sv_run", "quickening", _sv_runs), ("sv_run", "never", _no_runs), ("rhythm", "bank", _bank), ("rhythm", "pauses", _pauses),
]
for kind, variant, make in _ADD:
    REGISTRY.add(kind, variant, 1, make)
DEFAULTS = {"quality": "window", "qrs": "slope", "beat": "template", "af": "published", "vf": "window", "sv_run": "quickening", "rhythm": "bank"}


@dataclass(frozen=True)
class Selection:
    """A stage of each kind and the settings it is made with."""

    stages: dict
    cfg: ChannelConfig = CLINICAL

    def make(self, kind: str, *args):
        """The stage of a kind; a host's own is anything registered or given in its place."""
        stage = self.stages[kind]
        return (stage.make if hasattr(stage, "make") else stage)(self.cfg, *args)

    def name(self, kind: str) -> str:
        stage = self.stages[kind]
        base = getattr(stage, "name", getattr(stage, "__name__", type(stage).__name__))
        return base if self.cfg == CLINICAL else f"{base}.configured"


def selection(text: str = "", cfg: ChannelConfig = CLINICAL, registry: Registry = REGISTRY, own: dict[str, Callable] | None = None) -> Selection:
    """Read ``kind=variant;...`` over the defaults; ``own`` are a host's stages by kind."""
    if own and (unknown := set(own) - set(DEFAULTS)):
        raise KeyError(f"no stage kind {sorted(unknown)}")
    return Selection({**registry.select(text, DEFAULTS), **(own or {})}, cfg)
