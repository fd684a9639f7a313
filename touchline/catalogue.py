"""KPI catalogue, position groups and weights (fixed values), as small Spark frames.

Every frame built here has a size set by the tables below, not by the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = ("GK", "CB", "FB", "DM", "CM", "AM", "W", "ST")
CBI_GROUPS = ("CB", "FB")
OUTFIELD_GROUPS = ("CB", "FB", "DM", "CM", "AM", "W", "ST")
DEFAULT_K = 10.0

# Kpi, family, higher is better, proxy, shrinkage constant. Labels are our own.
KPIS: list[tuple[str, str, bool, bool, float, str]] = [
    ("def_activity_padj_p90", "fpl", True, True, DEFAULT_K,
     "Ball-winning work per 90, scaled to opponent possession"),
    ("cbi_padj_p90", "fpl", True, False, DEFAULT_K,
     "Clears, blocks and cut-outs per 90, scaled to opponent possession"),
    ("recoveries_padj_p90", "fpl", True, False, DEFAULT_K,
     "Loose balls won per 90, scaled to opponent possession"),
    ("tackles_padj_p90", "fpl", True, False, DEFAULT_K,
     "Tackles made per 90, scaled to opponent possession"),
    ("xgc_on_pitch_p90", "fpl", False, False, DEFAULT_K,
     "Chance value allowed by the team per 90 played"),
    ("cards_p90", "fpl", False, False, DEFAULT_K,
     "Bookings per 90"),
    ("xg_buildup_p90", "understat", True, True, DEFAULT_K,
     "Part in the build-up of chances per 90"),
    ("xg_chain_p90", "understat", True, True, DEFAULT_K,
     "Part in moves that end in a chance per 90"),
    ("xa_p90", "understat", True, False, DEFAULT_K,
     "Chance value created for others per 90"),
    ("npxg_p90", "understat", True, False, DEFAULT_K,
     "Own chance value without penalties per 90"),
    ("key_passes_p90", "understat", True, False, DEFAULT_K,
     "Passes that lead to a shot, per 90"),
    ("shots_p90", "understat", True, False, DEFAULT_K,
     "Attempts on goal per 90"),
    ("npxg_per_shot", "understat", True, False, DEFAULT_K,
     "Chance value of an average attempt, penalties left out"),
    ("gk_goals_prevented_p90", "fpl", True, True, 20.0,
     "Goals kept out beyond the chances faced, per 90"),
    ("gk_save_pct", "fpl", True, False, 20.0,
     "Share of shots on target that were stopped"),
    ("gk_saves_p90", "fpl", True, False, DEFAULT_K,
     "Stops per 90"),
    ("goals_minus_xg_p90", "understat", True, False, DEFAULT_K,
     "Goals above chance value per 90 (for information, no weight: mostly luck)"),
]

# KPI weights per position group.
GROUP_WEIGHTS: dict[str, dict[str, float]] = {
    "GK": {"gk_goals_prevented_p90": 0.40, "gk_save_pct": 0.30, "gk_saves_p90": 0.10,
           "xgc_on_pitch_p90": 0.20},
    "CB": {"def_activity_padj_p90": 0.30, "cbi_padj_p90": 0.20, "xg_buildup_p90": 0.25,
           "xgc_on_pitch_p90": 0.20, "cards_p90": 0.05},
    "FB": {"xa_p90": 0.25, "xg_chain_p90": 0.20, "xg_buildup_p90": 0.15,
           "def_activity_padj_p90": 0.25, "xgc_on_pitch_p90": 0.15},
    "DM": {"recoveries_padj_p90": 0.25, "tackles_padj_p90": 0.20, "xg_buildup_p90": 0.30,
           "xgc_on_pitch_p90": 0.15, "cards_p90": 0.10},
    "CM": {"xg_buildup_p90": 0.25, "xg_chain_p90": 0.20, "xa_p90": 0.20,
           "def_activity_padj_p90": 0.20, "npxg_p90": 0.15},
    "AM": {"xa_p90": 0.30, "key_passes_p90": 0.25, "npxg_p90": 0.25, "xg_chain_p90": 0.20},
    "W": {"npxg_p90": 0.25, "xa_p90": 0.25, "shots_p90": 0.15, "key_passes_p90": 0.15,
          "xg_chain_p90": 0.20},
    "ST": {"npxg_p90": 0.40, "shots_p90": 0.20, "npxg_per_shot": 0.15, "xa_p90": 0.10,
           "xg_chain_p90": 0.15, "goals_minus_xg_p90": 0.0},
}

# Team KPI, source, column, aggregate, higher is better, responsible groups.
TEAM_KPIS: list[tuple[str, str, str, str, bool, tuple[str, ...]]] = [
    ("xg_p90", "understat", "xg", "per90", True, ("ST", "W", "AM")),
    ("xga_p90", "understat", "xga", "per90", False, ("CB", "DM", "FB")),
    ("ppda", "understat", "ppda", "match_mean", False, ("ST", "W", "CM")),
    ("ppda_allowed", "understat", "ppda_allowed", "match_mean", True, ("CB", "DM", "CM")),
    ("deep_p90", "understat", "deep", "per90", True, ("AM", "W", "FB")),
    ("deep_allowed_p90", "understat", "deep_allowed", "per90", False, ("DM", "CB", "FB")),
    ("set_piece_xg_p90", "understat", "set_piece_xg", "per90", True, ("CB", "ST")),
    ("set_piece_xga_p90", "understat", "set_piece_xga", "per90", False, ("CB", "DM")),
    ("open_play_xga_p90", "understat", "open_play_xga", "per90", False, ("CB", "DM", "FB")),
]

# Style feature, source, column, aggregate, divisor feature.
STYLE_FEATURES: list[tuple[str, str, str, str, str | None]] = [
    ("possession", "espn", "possession", "match_mean", None),
    ("ppda", "understat", "ppda", "match_mean", None),
    ("deep_per_possession", "understat", "deep", "per90", "possession"),
]

# FitScore weights, peak-age windows, availability by status code.
FIT_WEIGHTS = {"need_fill": 0.40, "role_quality": 0.25, "reliability": 0.15, "style_fit": 0.10,
               "age_profile": 0.10}
PEAK_AGE = {"GK": (27, 33), "CB": (26, 30), "FB": (24, 28), "DM": (25, 29), "CM": (24, 29),
            "AM": (24, 28), "W": (23, 27), "ST": (24, 29)}
STATUS_AVAILABILITY = {"a": 1.0, "d": 0.5, "i": 0.0, "s": 0.0, "u": 0.0, "n": 0.0}

# Position names, formation slots and coarse types -> position group.
DETAILED_POSITIONS = {
    "Goalkeeper": "GK", "Centre-Back": "CB", "Left-Back": "FB", "Right-Back": "FB",
    "Defensive Midfield": "DM", "Central Midfield": "CM", "Attacking Midfield": "AM",
    "Left Midfield": "W", "Right Midfield": "W", "Left Winger": "W", "Right Winger": "W",
    "Second Striker": "ST", "Centre-Forward": "ST",
}
SLOT_GROUPS = {
    "GK": "GK", "DC": "CB", "DL": "FB", "DR": "FB", "DML": "FB", "DMR": "FB", "DMC": "DM",
    "MC": "CM", "ML": "W", "MR": "W", "AML": "W", "AMR": "W", "AMC": "AM", "FW": "ST",
}
COARSE_POSITIONS = {"GKP": "GK", "DEF": "CB", "MID": "CM", "FWD": "ST"}
LIMITED_GROUP_CAVEATS = {
    "GK": "Read keeper scores with care: shot placement, passing range and command of the box "
          "are not in the open feeds.",
}

TEAM_STATS = ("xg", "xga", "npxg", "npxga", "ppda", "ppda_allowed", "deep", "deep_allowed",
              "set_piece_xg", "set_piece_xga", "open_play_xga", "possession")
PLAYER_STATS = ("goals", "assists", "xg", "npxg", "xa", "shots", "key_passes", "xg_chain",
                "xg_buildup", "tackles", "recoveries", "cbi", "def_contribution", "xgc_on_pitch",
                "saves", "goals_conceded", "penalties_saved", "yellow_cards", "red_cards")
PADJ_STATS = ("tackles", "recoveries", "cbi")


@dataclass(frozen=True)
class Formula:
    """One KPI: a numerator over season totals, per 90 or divided by ``denominator``.

    Both callables take a column accessor (name -> Column of the season totals) and a flag
    column saying whether clearances, blocks and interceptions count for the player's group.
    """

    numerator: Callable[[Callable[[str], Column], Column], Column]
    denominator: Callable[[Callable[[str], Column]], Column] | None = None
    padj: bool = False


def _plain(name: str, *, padj: bool = False) -> Formula:
    return Formula(lambda c, _cbi: c(name), padj=padj)


# Column addition and subtraction give NULL when any part is missing, as the KPIs require.
FORMULAS: dict[str, Formula] = {
    "def_activity_padj_p90": Formula(
        lambda c, cbi: c("tackles_padj") + c("recoveries_padj")
        + F.when(cbi, c("cbi_padj")).otherwise(F.lit(0.0)),
        padj=True,
    ),
    "cbi_padj_p90": _plain("cbi_padj", padj=True),
    "recoveries_padj_p90": _plain("recoveries_padj", padj=True),
    "tackles_padj_p90": _plain("tackles_padj", padj=True),
    "xgc_on_pitch_p90": _plain("xgc_on_pitch"),
    "cards_p90": Formula(lambda c, _cbi: c("yellow_cards") + c("red_cards")),
    "xg_buildup_p90": _plain("xg_buildup"),
    "xg_chain_p90": _plain("xg_chain"),
    "xa_p90": _plain("xa"),
    "npxg_p90": _plain("npxg"),
    "key_passes_p90": _plain("key_passes"),
    "shots_p90": _plain("shots"),
    "npxg_per_shot": Formula(lambda c, _cbi: c("npxg"), denominator=lambda c: c("shots")),
    "gk_goals_prevented_p90": Formula(lambda c, _cbi: c("xgc_on_pitch") - c("goals_conceded")),
    "gk_save_pct": Formula(
        lambda c, _cbi: c("saves"), denominator=lambda c: c("saves") + c("goals_conceded")
    ),
    "gk_saves_p90": _plain("saves"),
    "goals_minus_xg_p90": Formula(lambda c, _cbi: c("goals") - c("xg")),
}


def register_kpi(kpi: str, family: str, formula: Formula, *, higher_is_better: bool = True,
                 is_proxy: bool = False, shrinkage_k: float = DEFAULT_K, label: str = "") -> None:
    """Add a KPI: its catalogue row and its formula."""
    if any(row[0] == kpi for row in KPIS):
        raise ValueError(f"KPI {kpi!r} is already registered")
    KPIS.append((kpi, family, higher_is_better, is_proxy, shrinkage_k, label or kpi))
    FORMULAS[kpi] = formula


def kpi_dim(spark: SparkSession) -> DataFrame:
    missing = sorted({row[0] for row in KPIS} - set(FORMULAS))
    if missing:
        raise ValueError(f"no formula for KPI(s) {missing}")
    return spark.createDataFrame(
        KPIS, "kpi string, family string, higher_is_better boolean, is_proxy boolean, "
        "shrinkage_k double, label string")


def kpi_weights(spark: SparkSession) -> DataFrame:
    rows = [(g, k, w) for g, ws in GROUP_WEIGHTS.items() for k, w in ws.items()]
    return spark.createDataFrame(rows, "position_group string, kpi string, weight double")


def team_kpi_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, s, c, a, h, list(g)) for k, s, c, a, h, g in TEAM_KPIS]
    return spark.createDataFrame(
        rows, "kpi string, source string, stat string, aggregate string, "
        "higher_is_better boolean, responsible_groups array<string>")


def style_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        STYLE_FEATURES, "kpi string, source string, stat string, aggregate string, "
        "divide_by string")


def literal_map(mapping: dict) -> Column:
    """A constant map column, for small fixed lookups inside a projection."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
