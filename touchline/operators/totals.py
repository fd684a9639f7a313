"""Warehouse aggregates: player and team totals, tables, coverage and freshness.

Every group-by here combines on the map side, so a club, source or season holding a large
share of the rows sends one partial row per task, not its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.functions import scalars as S
from touchline.operators.common import top_per
from touchline.params import DEFAULT_STALE_HOURS, Methodology

_M = Methodology()


def join_fact_match(fact: DataFrame, match: DataFrame) -> DataFrame:
    """Fact rows with the season of their match."""
    return fact.join(match.select("match_id", "season_id"), "match_id")


def _with_season(fact: DataFrame, match: DataFrame | None) -> DataFrame:
    return fact if match is None else join_fact_match(fact, match)


def _player_keys(by_club: bool) -> list[str]:
    return ["player_id", "season_id", *(["team_id"] if by_club else []), "source"]


def player_season(fact: DataFrame, match: DataFrame | None = None, by_club: bool = True) -> DataFrame:
    """Player x season x club x source totals; a sum over only NULLs stays NULL.

    Without ``by_club`` the clubs are added up at once, as ``collapse_clubs`` does it afterwards.
    """
    rows = _with_season(fact, match)
    return rows.groupBy(*_player_keys(by_club)).agg(
        F.count(F.lit(1)).alias("matches"),
        F.sum("minutes").alias("minutes"),
        F.sum(F.col("started").cast("int")).alias("starts"),
        *[F.sum(c).alias(c) for c in catalogue.PLAYER_STATS],
        F.max("fetched_at").alias("fetched_at"),
    )


def collapse_clubs(totals: DataFrame) -> DataFrame:
    """Sum the club rows of each player, season and source."""
    keys = ["player_id", "season_id", "source"]
    sums = [c for c in totals.columns if c not in (*keys, "team_id", "fetched_at")]
    newest = [F.max("fetched_at").alias("fetched_at")] if "fetched_at" in totals.columns else []
    return totals.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *newest)


def opponent_of(team: str = "team_id") -> Column:
    return F.when(F.col(team) == F.col("home_team_id"), F.col("away_team_id")).otherwise(
        F.col("home_team_id"))


def join_opponent_share(fact: DataFrame, match: DataFrame, team_fact: DataFrame) -> DataFrame:
    """Fact rows with the opponent's possession share in the same match (NULL if unknown).

    Both sides' shares go onto the match first, so the fact is shuffled once, by match.
    """
    shares = team_fact.filter((F.col("source") == "espn") & (F.col("possession") > 0)).select("match_id", "team_id", "possession")

    def side(name: str) -> DataFrame:
        return shares.select("match_id", F.col("team_id").alias(f"{name}_team_id"), F.col("possession").alias(f"{name}_share"))

    games = (match.select("match_id", "season_id", "home_team_id", "away_team_id")
             .join(side("home"), ["match_id", "home_team_id"], "left").join(side("away"), ["match_id", "away_team_id"], "left"))
    at_home = F.col("team_id") == F.col("home_team_id")
    return (fact.drop("season_id").join(games, "match_id").withColumns({
        "opponent_team_id": opponent_of(), "opponent_share": F.when(at_home, F.col("away_share")).otherwise(F.col("home_share"))})
        .drop("home_team_id", "away_team_id", "home_share", "away_share"))


def defensive_padj(fact: DataFrame, match: DataFrame, team_fact: DataFrame,
                   m: Methodology = _M, by_club: bool = True) -> DataFrame:
    """Possession-adjusted defensive totals; matches without a share keep their raw value."""
    rows = join_opponent_share(
        fact.filter(F.col("source").isin("fpl", "vaastav"))
        .select("player_id", "match_id", "team_id", "source", *catalogue.PADJ_STATS),
        match, team_fact)
    multiplier = S.possession_multiplier("opponent_share", m.multiplier_min, m.multiplier_max,
                                         m.even_share)
    scaled = F.coalesce(multiplier, F.lit(1.0))
    return rows.groupBy(*_player_keys(by_club)).agg(
        F.count(F.lit(1)).alias("matches"),
        F.count_if(multiplier.isNull()).alias("unadjusted_matches"),
        *[F.sum(F.col(c) * scaled).alias(f"{c}_padj") for c in catalogue.PADJ_STATS])


def team_season(team_fact: DataFrame, match: DataFrame) -> DataFrame:
    """Team x season totals per source; each column has its own count of known matches."""
    rows = team_fact.join(match.select("match_id", "season_id"), "match_id")
    aggs = [x for c in catalogue.TEAM_STATS
            for x in (F.sum(c).alias(f"{c}_total"), F.count(c).alias(f"{c}_matches"))]
    return rows.groupBy("source", "team_id", "season_id").agg(
        F.count(F.lit(1)).alias("matches"), *aggs, F.max("fetched_at").alias("as_of"))


def season_bounds(match: DataFrame) -> DataFrame:
    return match.filter(F.col("kickoff").isNotNull()).groupBy("season_id").agg(
        F.min("kickoff").alias("first_kickoff"), F.max("kickoff").alias("last_kickoff"),
        F.count(F.lit(1)).alias("matches"))


def union_home_away(match: DataFrame) -> DataFrame:
    """Both sides of every match: ``season_id, team_id, goals_for, goals_against``."""
    def side(a: str, b: str) -> DataFrame:
        return match.select("match_id", "season_id", F.col(f"{a}_team_id").alias("team_id"),
                            F.col(f"{a}_score").alias("goals_for"),
                            F.col(f"{b}_score").alias("goals_against"))
    return side("home", "away").unionByName(side("away", "home"))


def standings_totals(match: DataFrame) -> DataFrame:
    played = F.col("goals_for").isNotNull() & F.col("goals_against").isNotNull()
    points = (F.when(F.col("goals_for") > F.col("goals_against"), 3)
              .when(F.col("goals_for") == F.col("goals_against"), 1).otherwise(0))
    return (union_home_away(match).filter(played).groupBy("season_id", "team_id").agg(
        F.count(F.lit(1)).alias("played"), F.sum(points).alias("points"),
        F.sum("goals_for").alias("goals_for"), F.sum("goals_against").alias("goals_against"))
        .withColumn("goal_difference", F.col("goals_for") - F.col("goals_against")))


def standings_rank(totals: DataFrame) -> DataFrame:
    """League position; genuine ties share it. One row per club and season is ranked."""
    w = W.partitionBy("season_id").orderBy(
        F.desc("points"), F.desc("goal_difference"), F.desc("goals_for"))
    return totals.withColumn("position", F.rank().over(w))


def standings(match: DataFrame) -> DataFrame:
    return standings_rank(standings_totals(match))


def team_matches_played(match: DataFrame, season) -> DataFrame:
    sides = union_home_away(match).filter(F.col("season_id") == season)
    return (sides.filter(F.col("goals_for").isNotNull()).groupBy("team_id")
            .agg(F.count(F.lit(1)).alias("matches")))


def club_minutes(fact: DataFrame, season, source: str = "fpl") -> DataFrame:
    """Minutes per club x player in one season; ``fact`` carries the season."""
    rows = fact.filter((F.col("source") == source) & (F.col("season_id") == season))
    return rows.groupBy("team_id", "player_id").agg(F.sum("minutes").alias("minutes"))


def latest_status(status: DataFrame) -> DataFrame:
    return top_per(status, ["player_id"], [F.desc("fetched_at"), F.desc("id")])


def latest_value_per_source(values: DataFrame) -> DataFrame:
    return top_per(with_receipt(values), ["player_id", "source"],
                   [F.desc("tm_last_updated"), F.desc("fetched_at"), F.desc("id")])


def with_receipt(values: DataFrame) -> DataFrame:
    """Valuations that carry both a value and an as-of date."""
    return values.filter(F.col("value_eur").isNotNull() & F.col("tm_last_updated").isNotNull())


def prefer_source(values: DataFrame, precedence: Sequence[str]) -> DataFrame:
    """One valuation per player: the most preferred source that has one."""
    rank = F.array_position(F.array(*[F.lit(s) for s in precedence]), F.col("source"))
    return top_per(values.withColumn("__p", rank).filter(F.col("__p") > 0), ["player_id"],
                   [F.asc("__p")]).drop("__p")


def club_players(fact: DataFrame, season, players: DataFrame, status: DataFrame) -> DataFrame:
    """Current minutes per club x player with attributes and the newest contract expiry."""
    expiry = latest_status(status).select("player_id", "contract_expiry")
    return (club_minutes(fact, season).join(players, "player_id").join(expiry, "player_id", "left"))


def current_club(fact: DataFrame, match: DataFrame, season, source: str = "fpl") -> DataFrame:
    """Club of each player's latest match; a missing kickoff sorts last."""
    rows = (fact.filter((F.col("source") == source) & (F.col("season_id") == season))
            .select("player_id", "match_id", "team_id")
            .join(match.select("match_id", "kickoff"), "match_id"))
    order = [F.desc_nulls_last("kickoff"), F.desc("match_id"), F.asc("team_id")]
    return top_per(rows, ["player_id"], order).select(
        "player_id", F.col("team_id").alias("current_team_id"))


def player_profiles(fact: DataFrame, match: DataFrame, season, players: DataFrame,
                    status: DataFrame) -> DataFrame:
    """One row per player with current minutes: club, position, birth date, availability."""
    clubs = current_club(fact, match, season)
    minutes = (fact.filter((F.col("source") == "fpl") & (F.col("season_id") == season))
               .join(match.select("match_id"), "match_id")
               .groupBy("player_id").agg(F.sum("minutes").alias("season_minutes")))
    latest = latest_status(status).select(
        "player_id", "fpl_status", "chance_of_playing", "contract_expiry",
        F.col("fetched_at").alias("status_as_of"))
    people = players.select("player_id", "canonical_name", "position_group", "birth_date")
    return (clubs.join(people, "player_id").join(minutes, "player_id")
            .join(latest, "player_id", "left"))


def incumbent(squads: DataFrame) -> DataFrame:
    """Minutes leader per club x group; ties go to the lowest player id."""
    return top_per(squads.filter(F.col("position_group").isNotNull()),
                   ["team_id", "position_group"], [F.desc("minutes"), F.asc("player_id")])


def minutes_coverage(fact: DataFrame, players: DataFrame, ids: Mapping[str, str]) -> DataFrame:
    """Share of primary-source minutes whose player is linked to each other source."""
    rows = (fact.filter(F.col("source") == "fpl").groupBy("player_id")
            .agg(F.sum("minutes").alias("minutes")).join(players, "player_id"))
    linked = rows.agg(
        F.sum("minutes").alias("total"),
        *[F.sum(F.when(F.col(c).isNotNull(), F.col("minutes")).otherwise(0)).alias(s)
          for s, c in ids.items()])
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("linked")) for s in ids])
    return linked.filter(F.col("total") > 0).select("total", F.inline(pairs)).select(
        "source", (F.col("linked") / F.col("total")).alias("share"))


def freshness(snapshots: DataFrame, thresholds: Mapping[str, float], now: Column,
              default: float = DEFAULT_STALE_HOURS) -> DataFrame:
    """Newest snapshot per source, its age in hours and a stale flag."""
    newest = snapshots.groupBy("source").agg(F.max("fetched_at").alias("last_fetched"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_fetched").cast("timestamp"))) / 3.6e9
    limit = F.coalesce(
        F.try_element_at(catalogue.literal_map({k: float(v) for k, v in thresholds.items()}),
                         F.col("source")), F.lit(float(default)))
    return newest.withColumn("age_hours", age).withColumn("stale", F.col("age_hours") > limit)


def receipts(facts: DataFrame) -> DataFrame:
    """Newest as-of per player and source."""
    return facts.groupBy("player_id", "source").agg(F.max("as_of").alias("as_of"))


def model_runs(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Latest run receipt and row count per model output table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.max("trained_at").alias("trained_at"), F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), "trained_at", "rows")
        out = row if out is None else out.unionByName(row)
    return out


def standardise(df: DataFrame, cols: Sequence[str], over: Sequence[str] = ()) -> DataFrame:
    """z-score of each column over its known values; NULL with fewer than 2 or no spread."""
    aggs = [x for c in cols for x in (
        F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"), F.count(c).alias(f"__n_{c}"))]
    if over:
        joined = df.join(df.groupBy(*over).agg(*aggs), list(over))
    else:
        # One row of statistics: a scalar subquery, so the rows are not moved to meet it.
        one = df.agg(*aggs)
        joined = df.withColumn("__one", one.select(F.struct(*one.columns).alias("s")).scalar())
        joined = joined.select(*df.columns, "__one.*")
    zs = {f"{c}_z": F.when((F.col(f"__n_{c}") >= 2) & (F.col(f"__s_{c}") > 0),
                           (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")) for c in cols}
    return joined.withColumns(zs).drop(*[f"__{k}_{c}" for c in cols for k in "msn"])


def current_clubs(teams: DataFrame, match: DataFrame, season) -> DataFrame:
    """Clubs with a code and at least one fixture this season."""
    playing = (union_home_away(match.filter(F.col("season_id") == season))
               .select("team_id").distinct())
    return teams.filter(F.col("fpl_code").isNotNull()).join(playing, "team_id", "left_semi")
