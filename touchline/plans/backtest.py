"""Last season's diagnosis held against this season's arrivals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.functions import scalars as S
from touchline.operators import careers as CA
from touchline.operators import needs as N
from touchline.operators import totals as T
from touchline.operators.common import stage
from touchline.params import DiagnosisParams, Methodology
from touchline.plans import features as PF


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of every source; a column a source lacks is NULL for it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def backtest(totals: DataFrame, padj: DataFrame, players: DataFrame, table: DataFrame,
             clubs: DataFrame, cur, *, top_n: int = 3, min_minutes: float = 1.0,
             d: DiagnosisParams = DiagnosisParams(), m: Methodology = Methodology()) -> DataFrame:
    """Per club of last season that is still in the league: precision of its predicted needs.

    ``totals`` and ``padj`` are club rows of every season; ``table`` is every season's table.
    """
    prev, before = S.previous_season(cur), S.previous_season(cur, 2)
    season = F.col("season_id")
    # Inputs that several branches read are computed once: season totals, possession totals, people, and who arrived.
    totals = stage(totals.filter((season == cur) | (season == prev) | (season == before)), "backtest-totals")
    padj = stage(padj.filter((season == prev) | (season == before)), "backtest-padj")
    people = stage(players.filter(F.col("position_group").isNotNull()), "backtest-players")
    last = stage(table.filter(season == prev), "backtest-table")
    kept = stage(last.select("team_id").join(clubs.select("team_id"), "team_id", "left_semi"), "backtest-clubs")
    signed = stage(CA.arrivals_anti(totals, players, prev, cur, min_minutes), "backtest-arrivals")

    replayed = CA.relabel_source(totals, prev)
    feats = PF.features(T.collapse_clubs(replayed), T.collapse_clubs(CA.relabel_source(padj, prev)), people, prev, before, m)
    pct = feats.filter(F.col("season_mode") == "blended").select("player_id", "kpi", "percentile")
    squads = (replayed.filter((season == prev) & (F.col("source") == "fpl"))
              .groupBy("team_id", "player_id").agg(F.sum("minutes").alias("minutes"))
              .join(people.select("player_id", "position_group"), "player_id"))
    members = N.benchmark_members(last, kept, d.benchmark, d.benchmark_sizes)
    # Read once per club in the gap, so the scores of clubs and groups (a few numbers each) are written.
    scores = stage(N.group_scores(squads, pct), "backtest-scores")
    severity = N.need_severity(N.benchmark_gap(scores, members, kept))
    return CA.precision_at_n(N.topk_needs(severity, top_n), signed,
                             CA.most_signed(signed, kept, top_n, catalogue.GROUPS), kept,
                             len(catalogue.GROUPS))
