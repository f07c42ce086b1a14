"""Settings as frozen dataclasses, read from YAML; every violated range is reported at once."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml


class SettingsError(ValueError):
    """Settings out of range; args[0] lists all violations."""


@dataclass(frozen=True)
class Ingestion:
    chunk_size: int = 5000
    bucket_seconds: float = 1.0


@dataclass(frozen=True)
class Training:
    augmentation_enabled: bool = True
    noise_scale: float = 0.05
    synthetic_fraction: float = 0.10
    least_rows: int = 100
    seed: int = 42


@dataclass(frozen=True)
class Projection:
    blocked: bool = True
    variance: float = 0.99
    family_variance: dict = field(default_factory=lambda: {"volume": 0.95, "payload": 0.99, "flags": 0.99, "protocol": 0.99, "connection": 0.95})


@dataclass(frozen=True)
class Neighbours:
    k: int = 5
    percentiles: tuple = (90.0, 95.0, 99.0, 99.9)
    slack: float = 1.2


@dataclass(frozen=True)
class Mixture:
    components: int = 5
    reg_covar: float = 0.1
    max_iter: int = 200
    threshold_percentile: float = 99.9
    normalization: str = "cdf"
    adaptive: bool = True
    most_components: int = 25


@dataclass(frozen=True)
class Forest:
    contamination: float = 0.05
    trees: int = 100
    sample: int = 256


@dataclass(frozen=True)
class Sentinel:
    enabled: bool = True
    veto_sigma: float = 12.0
    percentile: float = 99.9


@dataclass(frozen=True)
class Velocity:
    enabled: bool = True
    bypass_threshold: float = 5.0
    weight: float = 0.30


@dataclass(frozen=True)
class Tribunal:
    weighted: bool = True
    balltree: float = 0.2
    gmm: float = 0.40
    iforest: float = 0.4
    threshold: float = 0.5
    votes: int = 2


@dataclass(frozen=True)
class FamilyConsensus:
    enabled: bool = True
    min_hits: int = 2
    z_threshold: float = 2.0


@dataclass(frozen=True)
class Persistence:
    ma_window: int = 5
    warmup_multiplier: int = 3
    transient_threshold: float = 0.4
    entry_multiplier: float = 1.0
    exit_multiplier: float = 0.75
    alert_minimum: int = 3
    filter_window: int = 3


@dataclass(frozen=True)
class Forensic:
    debounce_seconds: float = 30.0
    drop_threshold_seconds: float = 60.0
    sigma_min: float = 2.0
    confidence: float = 0.8
    min_anomalies: int = 1
    min_duration_seconds: float = 1.0
    top_features: int = 3


@dataclass(frozen=True)
class Logging:
    level: str = "INFO"
    file_max_bytes: int = 10_485_760
    file_backup_count: int = 5


@dataclass(frozen=True)
class Settings:
    ingestion: Ingestion = Ingestion()
    training: Training = Training()
    projection: Projection = Projection()
    neighbours: Neighbours = Neighbours()
    mixture: Mixture = Mixture()
    forest: Forest = Forest()
    sentinel: Sentinel = Sentinel()
    velocity: Velocity = Velocity()
    tribunal: Tribunal = Tribunal()
    family_consensus: FamilyConsensus = FamilyConsensus()
    persistence: Persistence = Persistence()
    forensic: Forensic = Forensic()
    logging: Logging = Logging()

    def __post_init__(self):
        bad = [message for ok, message in self._rules() if not ok]
        if bad:
            raise SettingsError(bad)

    def _rules(self):
        yield 0 < self.forest.contamination < 0.5, "forest.contamination must lie in (0, 0.5)"
        yield self.neighbours.k >= 1, "neighbours.k must be 1 or more"
        yield list(self.neighbours.percentiles) == sorted(self.neighbours.percentiles), "neighbours.percentiles must ascend"
        yield self.neighbours.slack > 0, "neighbours.slack must be positive"
        yield 0 < self.projection.variance <= 1, "projection.variance must lie in (0, 1]"
        yield all(0 < v <= 1 for v in self.projection.family_variance.values()), "projection.family_variance must lie in (0, 1]"
        yield self.velocity.bypass_threshold > 0, "velocity.bypass_threshold must be positive"
        yield 0 <= self.forensic.confidence <= 1, "forensic.confidence must lie in [0, 1]"
        yield self.persistence.exit_multiplier <= self.persistence.entry_multiplier, "persistence.exit_multiplier must not exceed entry_multiplier"
        yield self.ingestion.bucket_seconds > 0, "ingestion.bucket_seconds must be positive"
        yield self.mixture.normalization in ("cdf", "robust", "minmax"), "mixture.normalization must be cdf, robust or minmax"

    @classmethod
    def of(cls, values: dict[str, Any]) -> Settings:
        """Settings from nested dicts; sections and keys that aren't known are refused together."""
        sections, unknown = {}, []
        for f in dataclasses.fields(cls):
            kind = type(f.default)
            given = values.get(f.name) or {}
            unknown += [f"{f.name}.{k} is not known" for k in given if k not in {x.name for x in dataclasses.fields(kind)}]
            sections[f.name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in {x.name for x in dataclasses.fields(kind)}})
        unknown += [f"{k} is not known" for k in values if k not in sections]
        if unknown:
            raise SettingsError(unknown)
        return cls(**sections)

    @classmethod
    def load(cls, path: str | None) -> Settings:
        """From a YAML file; defaults where there is none."""
        return cls.of(yaml.safe_load(Path(path).read_text()) or {}) if path and Path(path).is_file() else cls()

    def runtime(self, **sections) -> Settings:
        """A copy with other values for what may change after training."""
        fixed = {"ingestion", "training", "projection"} & set(sections)
        if fixed:
            raise SettingsError([f"{f} is fixed by training" for f in sorted(fixed)])
        return dataclasses.replace(self, **sections)
