"""Settings of the three jobs, with the checks that come before a plan is built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

FILTER_TYPES = ("lowpass", "highpass", "bandpass", "bandstop")
SCORES = ("trust", "relative_cv", "cv", "train", "test")


def _raise(errors: Sequence[str]) -> None:
    if errors:
        raise ValueError("; ".join(errors))


@dataclass(frozen=True)
class ProcessConfig:
    """Recording to feature dataset: each step is off while its setting is None."""

    time_like: str = "Time"
    skip_rows: int = 0
    top_channels: int | None = None
    segments: int | None = None
    filter_order: int = 3
    filter_type: str | None = None
    cuts: tuple[float, ...] = ()
    harmonic_freq: float | None = None
    harmonic_nth: int | None = None
    harmonic_mode: str = "All"
    fs: float | None = None
    fft: bool = False
    average: bool = False
    shrink: int | None = None
    shrink_mode: str = "mean"
    dataset: bool = False
    targets: Mapping[str, str] = field(default_factory=dict)
    untargeted: str = "drop"
    file_name: str | None = None
    keyword: str | None = None
    random_key: bool = False
    timestamp: bool = False

    def validate(self) -> ProcessConfig:
        errors = []
        if self.skip_rows < 0:
            errors.append("skip_rows must not be negative")
        for name in ("top_channels", "segments", "shrink"):
            value = getattr(self, name)
            if value is not None and value < 1:
                errors.append(f"{name} must be positive")
        if (self.filter_type or self.harmonic_freq or self.fft) and not (self.fs and self.fs > 0):
            errors.append("filtering and the spectrum need a sampling frequency")
        if (self.filter_type or self.harmonic_freq) and self.filter_order < 1:
            errors.append("filter_order must be positive")
        if self.filter_type:
            if self.filter_type not in FILTER_TYPES:
                errors.append(f"filter_type must be one of {FILTER_TYPES}")
            want = 2 if self.filter_type in ("bandpass", "bandstop") else 1
            if len(self.cuts) != want:
                errors.append(f"{self.filter_type} needs {want} cut frequency(ies)")
            elif any(c <= 0 for c in self.cuts):
                errors.append("cut frequencies must be positive")
            elif want == 2 and self.cuts[0] >= self.cuts[1]:
                errors.append("the first cut must be below the second")
            if self.fs and self.cuts and max(self.cuts) >= self.fs / 2:
                errors.append("cut frequencies must be below half the sampling frequency")
        if self.harmonic_freq is not None:
            if self.harmonic_mode not in ("All", "Even", "Odd"):
                errors.append("harmonic_mode must be All, Even or Odd")
            if not self.harmonic_nth or self.harmonic_nth < 1:
                errors.append("harmonic_nth must be positive")
            elif self.fs and self.harmonic_freq * self.harmonic_nth + 2 >= self.fs / 2:
                errors.append("harmonics must be below half the sampling frequency")
            if self.harmonic_freq <= 2:
                errors.append("the base harmonic must be above 2 Hz")
        if self.shrink_mode not in ("mean", "linear"):
            errors.append("shrink_mode must be mean or linear")
        if self.dataset and not self.average:
            errors.append("a dataset needs averaged channels")
        if self.untargeted not in ("drop", "keep", "error"):
            errors.append("untargeted must be drop, keep or error")
        _raise(errors)
        return self


@dataclass(frozen=True)
class SpikeConfig:
    """Spike detection; times in seconds."""

    fs: int = 10_000
    threshold: float = 5.5
    dead_window: float = 0.1
    min_margin: float = 0.05
    max_margin: float = 0.05
    edge: str = "ignore"
    time_like: str = "Time"
    top_channels: int | None = None
    skip_rows: int = 6
    targets: Mapping[str, str] = field(default_factory=dict)
    replay_lag: bool = False

    @property
    def dead(self) -> int:
        return int(self.dead_window * self.fs)

    @property
    def before(self) -> int:
        return int(self.min_margin * self.fs)

    @property
    def after(self) -> int:
        return int(self.max_margin * self.fs)

    def validate(self) -> SpikeConfig:
        errors = []
        if self.fs < 1:
            errors.append("fs must be positive")
        if self.threshold < 0 or self.dead_window < 0 or self.min_margin < 0 or self.max_margin < 0:
            errors.append("threshold, dead window and margins must not be negative")
        if self.before + self.after < 1 or self.after < 1:
            errors.append("the window after a crossing must hold at least one sample")
        if self.edge not in ("ignore", "trim"):
            errors.append("edge must be ignore or trim")
        if self.top_channels is not None and self.top_channels < 1:
            errors.append("top_channels must be positive")
        if self.replay_lag and self.dead <= self.before:
            errors.append("replay_lag needs a dead window longer than the margin before a spike")
        _raise(errors)
        return self


@dataclass(frozen=True)
class LearnConfig:
    """Model selection: ``grid`` lists values to try, ``fixed`` holds single values."""

    kind: str = "rf"
    grid: Mapping[str, str | Sequence] = field(default_factory=dict)
    fixed: Mapping[str, object] = field(default_factory=dict)
    labels: Sequence[str] | None = None
    folds: int | None = 5
    score: str = "trust"
    seed: int = 0
    parallelism: int = 2

    def validate(self) -> LearnConfig:
        errors = []
        if self.kind not in ("rf", "svc"):
            errors.append("kind must be rf or svc")
        if self.score not in SCORES:
            errors.append(f"score must be one of {SCORES}")
        if self.folds is not None and self.folds < 2:
            errors.append("folds must be at least 2")
        if self.folds is None and self.score in ("trust", "relative_cv", "cv"):
            errors.append(f"score {self.score} needs k-fold scores")
        if self.labels is not None and not self.labels:
            errors.append("labels must not be empty")
        _raise(errors)
        return self
