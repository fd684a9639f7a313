"""All clubs diagnosed in one job: gaps, needs, weak links, risks and team needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.operators import needs as N
from touchline.operators import totals as T
from touchline.params import DiagnosisParams, Methodology


@dataclass
class Diagnosis:
    """Tables of one diagnosis run; a single club's answer is a filter on ``team_id``."""

    scores: DataFrame
    need_gap: DataFrame
    need: DataFrame
    weak_link: DataFrame
    risk: DataFrame
    team_need: DataFrame
    evidence: DataFrame
    style: DataFrame


def risks(squads: DataFrame, roles: DataFrame, as_of: Column, d: DiagnosisParams) -> DataFrame:
    """Depth, age and contract flags as one long table."""
    none = F.lit(None).cast("bigint")
    depth = N.depth_risk(squads, roles, d).withColumn("kind", F.lit("depth"))
    age = N.age_risk(squads, as_of, d).withColumn("kind", F.lit("age")).withColumn("player_id", none)
    contract = N.contract_risk(squads, as_of, d).drop("contract_expiry").withColumn("kind", F.lit("contract"))
    return depth.unionByName(age).unionByName(contract)


def diagnose(features: DataFrame, squads: DataFrame, table: DataFrame, clubs: DataFrame,
             matches: DataFrame, team_totals: DataFrame, cur, prev, as_of: Column, *,
             benchmark: str | None = None, custom=(), season_mode: str = "blended",
             d: DiagnosisParams = DiagnosisParams(), m: Methodology = Methodology()) -> Diagnosis:
    """Diagnose every current club.

    ``features``: the long feature table; ``squads``: minutes per club x player this season;
    ``table``: last season's standings; ``team_totals``: team season totals of all sources.
    """
    mode = features.filter(F.col("season_mode") == season_mode)
    pct = mode.select("player_id", "kpi", "percentile")
    members = N.benchmark_members(table, clubs, benchmark or d.benchmark, d.benchmark_sizes, custom)
    scores = N.group_scores(squads, pct)
    gaps = N.benchmark_gap(scores, members, clubs)
    need = N.rank_needs(N.need_severity(gaps))
    before = prev if season_mode == "blended" else None
    rates = N.team_rates(team_totals, catalogue.TEAM_KPIS, cur, before, m)
    style_rates = N.team_rates(team_totals, catalogue.STYLE_FEATURES, cur, before, m)
    return Diagnosis(
        scores=scores, need_gap=gaps, need=need,
        weak_link=N.weak_links(squads, pct, matches, d, m),
        risk=risks(squads, N.role_scores(squads, pct), as_of, d),
        team_need=N.team_needs(N.team_percentiles(rates, clubs), members),
        evidence=N.evidence(squads, mode),
        style=N.style_vectors(style_rates, clubs),
    )


def diagnosis_summary(x: Diagnosis) -> DataFrame:
    """One row per club x group: severity, rank and how much stands behind it."""
    keys = ["team_id", "position_group"]
    gaps = x.need_gap.groupBy(*keys).agg(F.count("gap").alias("known_gaps"), F.max("gap").alias("worst_gap"))
    weak = x.weak_link.groupBy(*keys).agg(F.count(F.lit(1)).alias("weak_links"))
    risk = x.risk.groupBy(*keys).agg(F.count(F.lit(1)).alias("risks"))
    ev = x.evidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("evidence"))
    team = (x.team_need.select("team_id", F.explode("responsible_groups").alias("position_group"))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("team_needs")))
    out = x.need.join(gaps, keys)
    for part in (weak, risk, ev, team):
        out = out.join(part, keys, "left")
    return out.fillna(0, ["weak_links", "risks", "evidence", "team_needs"])
