"""Risk weights, alert rules and other tunables, validated once on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from math import isfinite

# --- fixed values -------------------------------------------------------------------------------
FACTORS = (
    "citation_history", "classification_history", "recurring_deficiencies",
    "recency", "severity", "negative_trend",
)
DEFAULT_WEIGHTS = {
    "citation_history": 25.0, "classification_history": 25.0, "recurring_deficiencies": 20.0,
    "recency": 10.0, "severity": 10.0, "negative_trend": 10.0,
}
BANDS = ("LOW", "MODERATE", "HIGH", "CRITICAL", "INSUFFICIENT DATA")
# --- end of fixed values ------------------------------------------------------------------------


@dataclass(frozen=True)
class RiskConfig:
    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    vai_factor: float = 0.4
    recency_days: int = 730
    recurrence_target: int = 3
    observation_cap: int = 5
    moderate: float = 30.0
    high: float = 60.0
    critical: float = 80.0

    def __post_init__(self) -> None:
        values = [float(v) for v in self.weights.values()]
        if set(self.weights) != set(FACTORS):
            raise ValueError("weights must name exactly the six risk factors")
        if not all(isfinite(v) and v >= 0 for v in values) or sum(values) <= 0:
            raise ValueError("weights must be finite, non-negative and not all zero")
        if not 0 <= self.vai_factor <= 1:
            raise ValueError("vai_factor must lie in [0, 1]")
        if min(self.recency_days, self.recurrence_target, self.observation_cap) <= 0:
            raise ValueError("recency_days, recurrence_target and observation_cap must be positive")
        if not 0 < self.moderate < self.high < self.critical <= 100:
            raise ValueError("band limits must increase within 0-100")


@dataclass(frozen=True)
class AlertRules:
    repeated_oai_count: int = 2
    citation_rate_increase: float = 0.20
    minimum_yearly_known_flags: int = 3
    recurring_theme: str = "Data Integrity"
    recurring_theme_count: int = 2
    new_observation_days: int = 365


@dataclass(frozen=True)
class MetricRule:
    """Threshold of one monitored measurement."""

    threshold: float
    label: str = ""
    action: str = ""
