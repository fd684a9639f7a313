"""Dimension tables from several feeds: merge on stable keys, adopt, attach, infer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.operators.common import top_per

PAIR = ["season_id", "home_team_id", "away_team_id"]


def dim_season(seasons: DataFrame, current) -> DataFrame:
    """Every known season once, exactly one of them current."""
    return seasons.select("season_id").distinct().withColumn("is_current", F.col("season_id") == current)


def dim_team_merge(fpl: DataFrame, understat: DataFrame, tm: DataFrame) -> DataFrame:
    """One row per club over three feeds, with each feed's id.

    ``fpl``: fpl_code, name; ``understat``: understat_id, name, fpl_code; ``tm``: tm_id, name,
    fpl_code. A club without a known code stands alone. Ids follow the stable key, so a
    rebuild gives the same ones; a league has few enough clubs to number in one place.
    """
    def keyed(df: DataFrame, own: str) -> DataFrame:
        code = F.col("fpl_code")
        key = F.when(code.isNotNull(), F.concat(F.lit("code:"), F.lpad(code.cast("string"), 12, "0")))
        return df.withColumn("key", F.coalesce(key, F.concat(F.lit(f"{own}:"), F.col(own).cast("string"))))

    def once(df: DataFrame, own: str, name: str) -> DataFrame:
        return keyed(df, own).groupBy("key").agg(F.max(own).alias(own), F.max("fpl_code").alias(f"{name}_code"), F.max("name").alias(name))

    out = (once(fpl.withColumn("own_code", F.col("fpl_code")), "own_code", "fpl_name")
           .join(once(understat, "understat_id", "us_name"), "key", "full_outer").join(once(tm, "tm_id", "tm_name"), "key", "full_outer"))
    return out.select(
        F.dense_rank().over(W.orderBy("key")).alias("team_id"), F.coalesce("fpl_name", "us_name", "tm_name").alias("name"),
        F.coalesce("fpl_name_code", "us_name_code", "tm_name_code").alias("fpl_code"), "understat_id", "tm_id")


def position_by_minutes(rows: DataFrame, slots: Mapping[str, str] = catalogue.SLOT_GROUPS) -> DataFrame:
    """Group with most minutes over formation slots (player, slot, minutes); ties alphabetical."""
    group = F.try_element_at(catalogue.literal_map(dict(slots)), F.col("slot"))
    sums = (rows.withColumn("position_group", group).filter(F.col("position_group").isNotNull() & (F.col("minutes") > 0))
            .groupBy("player", "position_group").agg(F.sum("minutes").alias("m")))
    return top_per(sums, ["player"], [F.desc("m"), F.asc("position_group")]).select("player", "position_group")


def dim_player_merge(mapping: DataFrame, fpl: DataFrame, tm: DataFrame, slot_groups: DataFrame,
                     existing: DataFrame | None = None) -> DataFrame:
    """Linked players with position group and birth date.

    Group: detailed position, else formation slots, else coarse type. Birth date: primary
    feed, else market feed, else what the existing table has. The anchor's code is the key.
    """
    market = tm.select(F.col("tm_player_id").alias("transfermarkt_id"), "tm_position", F.col("birth_date").alias("tm_birth"))
    slots = slot_groups.select(F.col("player").alias("understat_id"), F.col("position_group").alias("slot_group"))
    rows = (mapping.join(fpl.select("code", "fpl_position", F.col("birth_date").alias("fpl_birth")), "code", "left")
            .join(market, "transfermarkt_id", "left").join(slots, "understat_id", "left"))
    old: Column = F.lit(None).cast("date")
    if existing is not None:
        rows = rows.join(existing.select(F.col("player_id").alias("code"), F.col("birth_date").alias("old_birth")), "code", "left")
        old = F.col("old_birth")
    detailed = F.try_element_at(catalogue.literal_map(catalogue.DETAILED_POSITIONS), F.col("tm_position"))
    coarse = F.try_element_at(catalogue.literal_map(catalogue.COARSE_POSITIONS), F.col("fpl_position"))
    return rows.select(F.col("code").alias("player_id"), "canonical_name", "understat_id", F.col("transfermarkt_id").alias("tm_id"),
                       F.coalesce("fpl_birth", "tm_birth", old).alias("birth_date"), F.col("tm_position").alias("detailed_position"),
                       F.coalesce(detailed, F.col("slot_group"), coarse).alias("position_group"))


def dim_match_from_fixtures(existing: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Upsert by fixture code; adopt an existing pairing only if it has no code yet.

    Both: season_id, home_team_id, away_team_id, fixture_code, kickoff, home_score, away_score.
    Existing rows also have match_key; new rows get one from their code.
    """
    f = fixtures.select(F.col("fixture_code").alias("code"), *[F.col(c).alias(f"f_{c}") for c in (*PAIR, "kickoff", "home_score", "away_score")])
    known = existing.join(f, F.col("fixture_code") == F.col("code"))
    rest = f.join(existing.select(F.col("fixture_code").alias("code")).filter("code is not null"), "code", "left_anti")
    free = existing.filter(F.col("fixture_code").isNull())
    pair = [F.col(c) == F.col(f"f_{c}") for c in PAIR]
    adopted = free.join(rest, pair[0] & pair[1] & pair[2])
    fresh = rest.join(adopted.select("code"), "code", "left_anti").withColumn("match_key", F.concat(F.lit("fixture:"), F.col("code").cast("string")))
    updated = known.unionByName(adopted)
    columns = [*[F.col(f"f_{c}").alias(c) for c in PAIR], F.col("code").alias("fixture_code"),
               *[F.col(f"f_{c}").alias(c) for c in ("kickoff", "home_score", "away_score")]]
    untouched = existing.join(updated.select("match_key"), "match_key", "left_anti")
    return (updated.select("match_key", *columns).unionByName(fresh.select("match_key", *columns))
            .unionByName(untouched.select("match_key", *PAIR, "fixture_code", "kickoff", "home_score", "away_score")))


def _merge_pairs(existing: DataFrame, games: DataFrame, prefix: str, key: str) -> DataFrame:
    """Full outer merge on season and clubs; scores are filled only when both are missing."""
    g = games.select(*PAIR, key, *[F.col(c).alias(f"g_{c}") for c in ("kickoff", "home_score", "away_score")])
    rows = existing.join(g, PAIR, "full_outer")
    no_score = F.col("home_score").isNull() & F.col("away_score").isNull()
    new = F.col("match_key").isNull()
    return rows.select(
        F.coalesce("match_key", F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))).alias("match_key"), *PAIR, key,
        F.when(new | F.col("kickoff").isNull(), F.col("g_kickoff")).otherwise(F.col("kickoff")).alias("kickoff"),
        F.when(no_score, F.col("g_home_score")).otherwise(F.col("home_score")).alias("home_score"),
        F.when(no_score, F.col("g_away_score")).otherwise(F.col("away_score")).alias("away_score"))


def dim_match_from_games(existing: DataFrame, games: DataFrame) -> DataFrame:
    """Attach game ids by season and clubs, creating matches nobody listed; a known kickoff
    of an existing match is kept."""
    merged = _merge_pairs(existing.drop("game_id"), games, "game", "game_id")
    kept = existing.select("match_key", F.col("kickoff").alias("old_kickoff"))
    return (merged.join(kept, "match_key", "left")
            .withColumn("kickoff", F.when(F.col("match_key").startswith("game:"), F.col("kickoff")).otherwise(F.col("old_kickoff")))
            .drop("old_kickoff"))


def fixture_sides(rows: DataFrame) -> DataFrame:
    """A fixture's clubs from its player rows: the opponent of away players is at home.

    Fixtures seen from one side only are left out. ``rows``: season_id, fixture_id, was_home,
    opponent_id, kickoff, home_score, away_score (match-level values repeat on every row).
    """
    home = F.max(F.when(~F.col("was_home"), F.col("opponent_id")))
    away = F.max(F.when(F.col("was_home"), F.col("opponent_id")))
    return (rows.groupBy("season_id", "fixture_id").agg(
        home.alias("home_team_id"), away.alias("away_team_id"),
        *[F.max(c).alias(c) for c in ("kickoff", "home_score", "away_score")])
        .filter(F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull()))


def dim_match_from_rows(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Past fixtures inferred from player rows, filling what a known match lacks."""
    return _merge_pairs(existing, fixture_sides(rows), "fixture", "fixture_id")


def dim_match_attach_event(existing: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches with event ids, events that match no fixture); events never create matches."""
    e = events.select(*PAIR, "event_id")
    return existing.join(e, PAIR, "left"), e.join(existing.select(*PAIR), PAIR, "left_anti")


def club_of_match_from_opponent(rows: DataFrame, match: DataFrame) -> DataFrame:
    """The player's club is the side opposite their opponent."""
    sides = match.select("match_id", "home_team_id", "away_team_id")
    team = F.when(F.col("opponent_id") == F.col("home_team_id"), F.col("away_team_id")).otherwise(F.col("home_team_id"))
    return rows.join(sides, "match_id").withColumn("team_id", team).drop("home_team_id", "away_team_id")
