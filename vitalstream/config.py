"""Settings and named implementations, chosen by text such as ``qrs=slope;rhythm=bank``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class ChannelConfig:
    """What a channel runs with; two presets, clinical and patch. Times are in ms unless the name says otherwise."""

    fs: float = 250.0
    # filter bank
    high_pass_hz: float = 0.5
    low_pass_hz: float = 40.0
    notch_hz: float = 2.0
    qrs_low_hz: float = 5.0
    qrs_high_hz: float = 20.0
    wave_hz: float = 10.0
    noise_hz: float = 40.0
    saturation_mv: float = 5.0
    mains_snr: float = 6.0
    # signal quality
    window_ms: float = 2000.0
    hop_ms: float = 250.0
    reference_ms: float = 300_000.0
    kurtosis_warn: float = 2.5
    kurtosis_bad: float = 0.5
    hf_warn: float = 0.10
    hf_bad: float = 0.35
    base_warn: float = 0.50
    base_bad: float = 0.85
    qrs_ratio_warn: float = 0.22
    qrs_ratio_bad: float = 0.08
    amplitude_low: float = 0.30
    amplitude_high: float = 2.0
    amplitude_off: float = 0.15
    saturated_bad: float = 0.02
    flat_bad: float = 0.90
    flat_share: float = 1e-3
    relative_bad: float = 0.20
    relative_warn: float = 0.60
    score_bad: float = 0.50
    score_warn: float = 0.75
    # electrode
    rail_share: float = 0.25
    open_amplitude: float = 4.0
    open_qrs: float = 0.35
    quiet_ms: float = 3000.0
    enter_hops: int = 2
    exit_hops: int = 4
    # beat detector
    integration_ms: float = 120.0
    refractory_ms: float = 200.0
    t_wave_ms: float = 360.0
    threshold_share: float = 0.15
    peak_quantile: float = 0.5
    peak_drop: float = 0.5
    search_back: float = 1.66
    refine_ms: float = 40.0
    learn_ms: float = 2000.0
    suppress_unusable: bool = False
    # beats and rhythm
    tolerance_ms: float = 150.0
    short_ms: float = 200.0
    long_ms: float = 3000.0
    pause_ms: float = 2000.0
    asystole_ms: float = 4000.0
    slow_bpm: float = 50.0
    fast_bpm: float = 100.0
    quiet_energy: float = 0.014
    af_enter: float = 0.92
    af_leave: float = 0.72
    af_sustained_s: float = 30.0
    vf_enter: float = 0.80
    vf_leave: float = 0.55
    vf_suppress: float = 0.75
    vf_suppress_s: float = 10.0
    join_ncc: float = 0.90
    merge_ncc: float = 0.95
    shape_rate: float = 0.02
    most_shapes: int = 64
    template_ncc: float = 0.90
    atrial_ncc: float = 0.70
    template_rate: float = 0.05
    hold_ncc: float = 2.0
    max_blind: int = 0
    legible_ncc: float = 0.95
    sv_runs: bool = False

    def __post_init__(self) -> None:
        if not 50 <= self.fs <= 4000:
            raise ValueError(f"a rate of {self.fs} Hz is not within 50 to 4000")

    def samples(self, ms: float) -> int:
        """A time in samples, rounded half up, one at least."""
        return max(1, int(self.fs * ms / 1000.0 + 0.5))

    def override(self, **values: str | float | bool) -> ChannelConfig:
        """A copy with some settings changed; text is read as the setting's type, an unknown name is an error."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if unknown := set(values) - set(kinds):
            raise KeyError(f"no setting {sorted(unknown)}")
        read = lambda k, v: (v in ("1", "true", "yes") if kinds[k] is bool else kinds[k](v)) if isinstance(v, str) else v
        return replace(self, **{k: read(k, v) for k, v in values.items()})


CLINICAL = ChannelConfig()
PATCH = ChannelConfig(sv_runs=True)
KINDS = ("quality", "qrs", "beat", "af", "vf", "sv_run", "rhythm")


@dataclass(frozen=True)
class Stage:
    kind: str
    variant: str
    version: int
    make: Callable

    @property
    def name(self) -> str:
        return f"{self.kind}.{self.variant}@{self.version}"


class Registry:
    """Implementations by kind and variant; a later version of one replaces an earlier as the default."""

    def __init__(self) -> None:
        self.stages: dict[str, Stage] = {}

    def add(self, kind: str, variant: str, version: int, make: Callable) -> Stage:
        if kind not in KINDS:
            raise KeyError(f"no stage kind {kind}")
        stage = Stage(kind, variant, version, make)
        if stage.name in self.stages:
            raise ValueError(f"{stage.name} is there already")
        self.stages[stage.name] = stage
        return stage

    def available(self, kind: str | None = None) -> list[str]:
        return sorted(n for n, s in self.stages.items() if kind in (None, s.kind))

    def find(self, kind: str, variant: str) -> Stage:
        """By variant, or by variant@version; the newest where none is named."""
        base, _, version = variant.partition("@")
        found = [s for s in self.stages.values() if s.kind == kind and s.variant == base and version in ("", str(s.version))]
        if not found:
            raise KeyError(f"no {kind} stage {variant}; there are {self.available(kind)}")
        return max(found, key=lambda s: s.version)

    def select(self, text: str, defaults: dict[str, str] | None = None) -> dict[str, Stage]:
        """Read ``kind=variant;...`` over ``defaults``; an unknown kind, variant or form is an error."""
        chosen = dict(defaults or {})
        for part in filter(None, (p.strip() for p in text.split(";"))):
            kind, sign, variant = (x.strip() for x in part.partition("="))
            if not sign or not variant or kind not in KINDS:
                raise ValueError(f"cannot read {part!r}")
            chosen[kind] = variant
        return {kind: self.find(kind, variant) for kind, variant in chosen.items()}
