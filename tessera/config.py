"""Settings of an analysis, from YAML with overrides."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

import yaml


@dataclass(frozen=True)
class EngineConfig:
    """Window lengths, thresholds, seeds and the regions of a run; ``smoke`` keeps the first region and 60 dates."""

    regions: tuple[str, ...] = ()
    window: int = 24
    motifs: int = 3
    discords: int = 3
    rolling: int = 36
    lags: int = 24
    bootstraps: int = 1000
    permutations: int = 10_000
    window_lengths: tuple[int, ...] = (12, 24, 36, 48)
    alpha: float = 0.05
    fdr_level: float = 0.05
    seed: int = 42
    smoke: bool = False

    @classmethod
    def from_yaml(cls, path: str, *overrides: str) -> EngineConfig:
        """Settings in a YAML file, then ``name=value`` overrides; unknown names are errors."""
        with open(path) as file:
            found = yaml.safe_load(file) or {}
        found |= {k: yaml.safe_load(v) for k, v in (x.split("=", 1) for x in overrides)}
        unknown = set(found) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})

    def dump(self) -> str:
        return yaml.safe_dump({k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}, sort_keys=False)

    def limited(self, regions: list[str]) -> list[str]:
        chosen = [r for r in regions if not self.regions or r in self.regions]
        return chosen[:1] if self.smoke else chosen
