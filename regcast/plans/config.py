"""Frozen configuration objects (the "query" of a regression workflow).

Fixed values: the names of the options and their defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

ROW_SELECTIONS = ("Random percent", "Last percent")
VALIDATION_STRATEGIES = ("Random split", "Last split", "Cross-validation")


@dataclass(frozen=True)
class ModelSpec:
    key: str = "linear_regression"
    params: dict = field(default_factory=dict)
    use_grid_search: bool = False
    param_grid: dict = field(default_factory=dict)
    cv: int = 5


@dataclass(frozen=True)
class FeatureSelection:
    method: str
    count: int


@dataclass(frozen=True)
class PipelineConfig:
    features: tuple
    target: str
    order_by: tuple  # unique ordering key: defines row order and the seeded hash
    plan: object = None  # plan DataFrame / list of (Variable, Type, Preprocessing, Unique Count); None ⇒ profile
    model: ModelSpec = field(default_factory=ModelSpec)
    target_processing: str = "None"
    feature_selection: FeatureSelection | None = None
    lookback: int | None = None


@dataclass(frozen=True)
class TrainingConfig:
    pipeline: PipelineConfig
    row_selection: str = "Random percent"
    percent: int = 100


@dataclass(frozen=True)
class ValidationConfig:
    pipeline: PipelineConfig
    strategy: str = "Random split"
    percent: int = 20
    folds: int = 5
