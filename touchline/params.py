"""Thresholds of every engine, with their published defaults (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Methodology:
    blend_lambda: float = 0.5
    prev_minutes_cap: float = 2000.0
    default_shrinkage_k: float = 10.0
    even_share: float = 0.5
    multiplier_min: float = 0.67
    multiplier_max: float = 1.5
    percentile_min_minutes: float = 600.0
    roles_min_minutes: float = 900.0
    match_minutes: float = 90.0


@dataclass(frozen=True)
class DiagnosisParams:
    benchmark: str = "top6"
    benchmark_sizes: dict[str, int] = field(default_factory=lambda: {"top6": 6, "top4": 4})
    weak_link_min_share: float = 0.40
    weak_link_max_percentile: float = 30.0
    weak_link_min_weight: float = 0.20
    depth_share: float = 0.80
    depth_backup_min: float = 40.0
    age_risk: float = 30.0
    contract_months: float = 12.0


@dataclass(frozen=True)
class FitParams:
    upgrade_delta: float = 15.0
    full_minutes: float = 2500.0
    volume_weight: float = 0.6
    availability_weight: float = 0.4
    penalty_per_year: float = 15.0
    min_style_dimensions: int = 2


@dataclass(frozen=True)
class Filters:
    """Hard filters of a shortlist; ``None`` means the filter is not set."""

    max_value_eur: float | None = None
    min_age: float | None = None
    max_age: float | None = None
    min_minutes: float | None = None
    exclude_team_ids: tuple[int, ...] = ()
    excluded_statuses: tuple[str, ...] = ("u", "n")
    include_sideways: bool = False
    limit: int = 10


@dataclass(frozen=True)
class LinkParams:
    accept_score: float = 88.0
    min_margin: float = 4.0
    token_score: float = 95.0
    initial_score: float = 90.0
    dob_confirm_score: float = 60.0


@dataclass(frozen=True)
class ValueParams:
    days_before: int = 120
    days_after: int = 75
    min_minutes: float = 450.0
    stats: tuple[str, ...] = ("goals", "assists", "xg", "xa", "def_contribution")
    age_edges: tuple[float, ...] = (21, 24, 27, 30)
    low_quantile: float = 0.1
    high_quantile: float = 0.9
    max_iter: int = 300
    step: float = 0.05
    seed: int = 42


@dataclass(frozen=True)
class AgeCurveParams:
    metrics: tuple[str, ...] = ("xg", "xa", "goals", "assists")
    min_minutes: float = 900.0
    min_pairs: int = 15
    age_min: int = 18
    age_max: int = 36


@dataclass(frozen=True)
class RoleParams:
    k_min: int = 6
    k_max: int = 12
    seed: int = 42
    max_iter: int = 100
    tolerance: float = 1e-3
    covariance_floor: float = 1e-6


@dataclass(frozen=True)
class ReportParams:
    elite: float = 90.0
    strong: float = 75.0
    above_average: float = 50.0
    below_average: float = 25.0
    max_listed: int = 3
    comparables: int = 3
    small_sample_minutes: float = 900.0
    tolerance: float = 1e-6


MARKET_PRECEDENCE = ("override", "transfermarkt", "transfermarkt_datasets")
STALE_AFTER_HOURS = {"fpl": 24, "understat": 48, "espn": 72, "transfermarkt": 168}
DEFAULT_STALE_HOURS = 72
MAX_MATCH_MINUTES = 130
POSSESSION_TOLERANCE = 0.02
SEARCH_LIMIT = 8
FUZZY_CUTOFF = 75.0
