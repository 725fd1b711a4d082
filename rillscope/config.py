"""Settings of the analysis: defaults, bounds, files and environment."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path

#: Names of detectors, kernels, methods and output formats.
ALGORITHMS = ("bcp", "ruptures", "torch", "rbeast", "adtk")
MODELS = ("rbf", "l1", "l2", "normal")
METHODS = ("jitter_dispersion", "ks_test")
FORMATS = ("json", "csv", "parquet")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class ChangePoints:
    algorithm: str = "ruptures"
    threshold: float = 0.25
    min_time_elapsed: int = 1800
    max_change_points: int | None = None
    ruptures_model: str = "rbf"
    ruptures_penalty: float = 10.0

    def __post_init__(self) -> None:
        _need(self.algorithm in ALGORITHMS, f"algorithm must be one of {ALGORITHMS}")
        _need(0 <= self.threshold <= 1, "threshold must be between 0 and 1")
        _need(self.min_time_elapsed > 0, "min_time_elapsed must be positive")
        _need(self.max_change_points is None or self.max_change_points > 0, "max_change_points must be positive")
        _need(self.ruptures_penalty > 0, "ruptures_penalty must be positive")


@dataclass(frozen=True)
class Jitter:
    method: str = "jitter_dispersion"
    threshold: float = 0.25
    moving_average_order: int = 6
    moving_iqr_order: int = 4
    significance_level: float = 0.05

    def __post_init__(self) -> None:
        _need(self.method in METHODS, f"method must be one of {METHODS}")
        _need(self.threshold > 0, "threshold must be positive")
        _need(self.moving_average_order > 0 and self.moving_average_order % 2 == 0, "moving_average_order must be positive and even")
        _need(self.moving_iqr_order > 0, "moving_iqr_order must be positive")
        _need(0 < self.significance_level < 1, "significance_level must be between 0 and 1")


@dataclass(frozen=True)
class Jump:
    threshold: float = 0.5

    def __post_init__(self) -> None:
        _need(self.threshold > 0, "threshold must be positive")


@dataclass(frozen=True)
class Processing:
    minimum_interval_minutes: int = 15
    min_samples_per_interval: int = 0
    outlier_detection: bool = False
    outlier_threshold: float = 3.0

    def __post_init__(self) -> None:
        _need(0 < self.minimum_interval_minutes <= 1440, "minimum_interval_minutes must be between 1 and 1440")
        _need(self.outlier_threshold > 0, "outlier_threshold must be positive")


@dataclass(frozen=True)
class Config:
    """All settings.  The outlier and sample-count filters are off unless asked for."""

    change_point_detection: ChangePoints = field(default_factory=ChangePoints)
    jitter_analysis: Jitter = field(default_factory=Jitter)
    latency_jump: Jump = field(default_factory=Jump)
    data_processing: Processing = field(default_factory=Processing)
    output_format: str = "json"
    verbose: bool = False

    def __post_init__(self) -> None:
        _need(self.output_format in FORMATS, f"output_format must be one of {FORMATS}")

    def merged(self, changes: dict) -> Config:
        """A copy with nested changes, validated."""

        def apply(obj, new: dict):
            known = {f.name for f in fields(obj)}
            _need(set(new) <= known, f"unknown settings: {sorted(set(new) - known)}")
            return replace(obj, **{k: apply(getattr(obj, k), v) if is_dataclass(getattr(obj, k)) else v for k, v in new.items()})

        return apply(self, changes)

    def to_dict(self) -> dict:
        return asdict(self)

    def save(self, path: str) -> None:
        Path(path).write_text(_dump(self.to_dict(), path))


def _kind(path: str) -> str:
    suffix = Path(path).suffix.lower()
    _need(suffix in (".json", ".yaml", ".yml"), f"unsupported settings file: {path}")
    return "json" if suffix == ".json" else "yaml"


def _dump(data: dict, path: str) -> str:
    if _kind(path) == "json":
        return json.dumps(data, indent=2)
    import yaml

    return yaml.safe_dump(data, sort_keys=False)


def load_config(path: str | None = None, explicit: dict | None = None, prefix: str = "RILLSCOPE_") -> Config:
    """Defaults, then the file, then the environment, then what is given explicitly."""
    config = Config()
    if path:
        kind = _kind(path)
        text = Path(path).read_text()
        if kind == "json":
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text) or {}
        config = config.merged(data)
    for name in ("output_format", "verbose"):
        value = os.environ.get(prefix + name.upper())
        if value is not None:
            config = config.merged({name: value.lower() in ("1", "true", "yes") if name == "verbose" else value})
    return config.merged(explicit or {})
