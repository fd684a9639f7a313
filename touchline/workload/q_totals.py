"""Warehouse aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import catalogue
from touchline import params as P
from touchline.functions import scalars as S
from touchline.operators import dimensions as D
from touchline.operators import totals as T
from touchline.workload import bindings as B
from touchline.workload.registry import query, r6, rounded
from touchline.workload.sqltext import view

STATS = catalogue.PLAYER_STATS
_SUMS = ", ".join(
    f"CAST(sum({c}) AS {'DOUBLE' if c in ('xg', 'npxg', 'xa', 'xg_chain', 'xg_buildup', 'xgc_on_pitch') else 'BIGINT'}) AS {c}"
    for c in STATS)

view("v_totals", f"""SELECT player_id, season_id, team_id, source, count(*) AS matches,
  CAST(sum(mins) AS BIGINT) AS mins, CAST(sum(CAST(started AS INT)) AS BIGINT) AS starts, {_SUMS},
  max(fetched_at) AS fetched_at FROM v_fact GROUP BY 1, 2, 3, 4""")
view("v_player_totals", f"""SELECT player_id, season_id, source, CAST(sum(matches) AS BIGINT) AS matches,
  CAST(sum(mins) AS BIGINT) AS mins, CAST(sum(starts) AS BIGINT) AS starts, {_SUMS},
  max(fetched_at) AS fetched_at FROM v_totals GROUP BY 1, 2, 3""")
view("v_share", """SELECT f.player_id, m.season_id, f.team_id, f.source, f.match_id, f.tackles, f.recoveries, f.cbi,
  p.possession AS opponent_share
  FROM v_fact f JOIN v_match m ON f.match_id = m.match_id
  LEFT JOIN (SELECT * FROM v_team_fact WHERE source = 'espn' AND possession > 0) p
    ON p.match_id = f.match_id
   AND p.team_id = CASE WHEN f.team_id = m.home_team_id THEN m.away_team_id ELSE m.home_team_id END
  WHERE f.source IN ('fpl', 'vaastav')""")
view("v_padj", """SELECT player_id, season_id, team_id, source, count(*) AS matches,
  count(*) FILTER (opponent_share IS NULL) AS unadjusted_matches,
  sum(tackles * k) AS tackles_padj, sum(recoveries * k) AS recoveries_padj, sum(cbi * k) AS cbi_padj
  FROM (SELECT *, CASE WHEN opponent_share IS NULL THEN 1.0::DOUBLE
      ELSE least(greatest(0.5::DOUBLE / opponent_share, 0.67::DOUBLE), 1.5::DOUBLE) END AS k FROM v_share)
  GROUP BY 1, 2, 3, 4""")
_TS = ", ".join(f"sum(t.{c}) AS {c}_total, count(t.{c}) AS {c}_matches" for c in catalogue.TEAM_STATS)
view("v_team_season", f"""SELECT t.source, t.team_id, m.season_id, count(*) AS matches, {_TS}, max(t.fetched_at) AS as_of
  FROM v_team_fact t JOIN v_match m ON t.match_id = m.match_id GROUP BY 1, 2, 3""")
view("v_sides", """SELECT match_id, season_id, home_team_id AS team_id, home_score AS goals_for, away_score AS goals_against FROM v_match
  UNION ALL SELECT match_id, season_id, away_team_id, away_score, home_score FROM v_match""")
view("v_standings", """SELECT *, rank() OVER (PARTITION BY season_id ORDER BY points DESC, goal_difference DESC, goals_for DESC) AS position
  FROM (SELECT season_id, team_id, count(*) AS played,
    CAST(sum(CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END) AS BIGINT) AS points,
    CAST(sum(goals_for) AS BIGINT) AS goals_for, CAST(sum(goals_against) AS BIGINT) AS goals_against,
    CAST(sum(goals_for) - sum(goals_against) AS BIGINT) AS goal_difference
    FROM v_sides WHERE goals_for IS NOT NULL AND goals_against IS NOT NULL GROUP BY 1, 2)""")
view("v_latest_status", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY fetched_at DESC, id DESC) AS rn FROM v_status) WHERE rn = 1""")
view("v_latest_value", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, source
  ORDER BY tm_last_updated DESC, fetched_at DESC, id DESC) AS rn FROM v_value
  WHERE value_eur IS NOT NULL AND tm_last_updated IS NOT NULL) WHERE rn = 1""")
view("v_best_value", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY
  CASE source WHEN 'override' THEN 1 WHEN 'transfermarkt' THEN 2 ELSE 3 END) AS pr FROM v_latest_value) WHERE pr = 1""")
view("v_club_minutes", """SELECT team_id, player_id, CAST(sum(mins) AS BIGINT) AS mins FROM v_fact
  WHERE source = 'fpl' AND season_id = (SELECT cur FROM v_now) GROUP BY 1, 2""")
view("v_squad", """SELECT c.team_id, c.player_id, c.mins, p.canonical_name, p.position_group, p.birth_date, s.contract_expiry
  FROM v_club_minutes c JOIN v_player p USING (player_id) LEFT JOIN v_latest_status s USING (player_id)""")
view("v_current_club", """SELECT player_id, team_id AS current_team_id FROM (SELECT f.player_id, f.team_id,
  row_number() OVER (PARTITION BY f.player_id ORDER BY m.kickoff DESC NULLS LAST, m.match_id DESC, f.team_id) AS rn
  FROM v_fact f JOIN v_match m ON f.match_id = m.match_id
  WHERE f.source = 'fpl' AND f.season_id = (SELECT cur FROM v_now)) WHERE rn = 1""")
view("v_profile", """SELECT c.player_id, c.current_team_id, p.canonical_name, p.position_group, p.birth_date, m.season_minutes,
  s.fpl_status, s.chance_of_playing, s.contract_expiry, s.fetched_at AS status_as_of
  FROM v_current_club c JOIN v_player p USING (player_id)
  JOIN (SELECT f.player_id, CAST(sum(f.mins) AS BIGINT) AS season_minutes FROM v_fact f JOIN v_match m ON f.match_id = m.match_id
        WHERE f.source = 'fpl' AND f.season_id = (SELECT cur FROM v_now) GROUP BY 1) m USING (player_id)
  LEFT JOIN v_latest_status s USING (player_id)""")
view("v_club", """SELECT * FROM v_team WHERE fpl_code IS NOT NULL AND team_id IN
  (SELECT team_id FROM v_sides WHERE season_id = (SELECT cur FROM v_now))""")


@query("player_season", "SELECT player_id, season_id, team_id, source, matches, mins, starts, "
       + ", ".join(STATS) + ", fetched_at FROM v_totals")
def player_season(spark, sf):
    return T.player_season(B.fact_only(spark, sf), B.match_all(spark, sf)).withColumnRenamed("minutes", "mins")


@query("join_fact_match", """SELECT f.player_id, f.match_id, f.team_id, m.season_id, m.kickoff, f.mins, f.xg, f.xa
  FROM v_fact f JOIN v_match m ON f.match_id = m.match_id""")
def join_fact_match(spark, sf):
    rows = T.join_fact_match(B.fact_only(spark, sf), B.dim_match(spark, sf))
    kick = B.dim_match(spark, sf).select("match_id", "kickoff")
    return rows.join(kick, "match_id").select(
        "player_id", "match_id", "team_id", "season_id", "kickoff", F.col("minutes").alias("mins"), "xg", "xa")


@query("collapse_clubs", "SELECT player_id, season_id, source, matches, mins, starts, "
       + ", ".join(STATS) + ", fetched_at FROM v_player_totals")
def collapse_clubs(spark, sf):
    return T.collapse_clubs(T.player_season(B.fact(spark, sf))).withColumnRenamed("minutes", "mins")


@query("join_opponent_share", """SELECT player_id, season_id, team_id, source, match_id,
  round(opponent_share, 6) AS opponent_share, CAST(count(*) AS BIGINT) AS n, CAST(sum(tackles) AS BIGINT) AS tackles
  FROM v_share GROUP BY ALL""")
def join_opponent_share(spark, sf):
    rows = T.join_opponent_share(B.fact(spark, sf).filter(F.col("source") != "understat"),
                                 B.dim_match(spark, sf), B.fact_team(spark, sf))
    return rows.groupBy("player_id", "season_id", "team_id", "source", "match_id",
                        r6("opponent_share").alias("opponent_share")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tackles").alias("tackles"))


@query("defensive_padj", """SELECT player_id, season_id, team_id, source, matches, unadjusted_matches,
  round(tackles_padj, 6) AS tackles_padj, round(recoveries_padj, 6) AS recoveries_padj, round(cbi_padj, 6) AS cbi_padj FROM v_padj""")
def defensive_padj(spark, sf):
    df = T.defensive_padj(B.fact(spark, sf), B.dim_match(spark, sf), B.fact_team(spark, sf))
    return rounded(df, "tackles_padj", "recoveries_padj", "cbi_padj")


@query("possession_multiplier", """SELECT match_id, team_id, round(possession, 6) AS possession,
  round(CASE WHEN possession > 0 THEN least(greatest(0.5::DOUBLE / possession, 0.67::DOUBLE), 1.5::DOUBLE) END, 6) AS multiplier
  FROM v_team_fact WHERE source = 'espn'""")
def possession_multiplier(spark, sf):
    rows = B.fact_team(spark, sf).filter(F.col("source") == "espn")
    return rows.select("match_id", "team_id", r6("possession").alias("possession"),
                       r6(S.possession_multiplier("possession")).alias("multiplier"))


@query("team_season", "SELECT source, team_id, season_id, matches, " + ", ".join(
    f"round({c}_total, 6) AS {c}_total, {c}_matches" for c in catalogue.TEAM_STATS)
    + ", as_of FROM v_team_season")
def team_season(spark, sf):
    df = T.team_season(B.fact_team(spark, sf), B.dim_match(spark, sf))
    return rounded(df, *[f"{c}_total" for c in catalogue.TEAM_STATS])


@query("season_bounds", """SELECT season_id, min(kickoff) AS first_kickoff, max(kickoff) AS last_kickoff, count(*) AS matches
  FROM v_match WHERE kickoff IS NOT NULL GROUP BY 1""")
def season_bounds(spark, sf):
    return T.season_bounds(B.dim_match(spark, sf))


@query("union_home_away", "SELECT match_id, season_id, team_id, goals_for, goals_against FROM v_sides")
def union_home_away(spark, sf):
    return T.union_home_away(B.dim_match(spark, sf))


@query("standings", """SELECT season_id, team_id, played, points, goals_for, goals_against, goal_difference, position FROM v_standings""")
def standings(spark, sf):
    return T.standings(B.dim_match(spark, sf))


@query("standings_rank", """SELECT team_id, season_id, position, count(*) OVER (PARTITION BY season_id, position) AS level
  FROM v_standings""")
def standings_rank(spark, sf):
    ranked = T.standings_rank(T.standings_totals(B.dim_match(spark, sf)))
    ties = ranked.groupBy("season_id", "position").agg(F.count(F.lit(1)).alias("level"))
    return ranked.join(ties, ["season_id", "position"]).select("team_id", "season_id", "position", "level")


@query("team_matches_played", """SELECT team_id, count(*) AS matches FROM v_sides
  WHERE season_id = (SELECT cur FROM v_now) AND goals_for IS NOT NULL GROUP BY 1""")
def team_matches_played(spark, sf):
    return T.team_matches_played(B.dim_match(spark, sf), B.current_season(spark, sf))


@query("club_minutes", """SELECT team_id, player_id, mins, position_group, birth_date, contract_expiry FROM v_squad""")
def club_minutes(spark, sf):
    df = T.club_players(B.fact(spark, sf), B.current_season(spark, sf), B.dim_player(spark, sf),
                        B.status(spark, sf))
    return df.select("team_id", "player_id", F.col("minutes").alias("mins"), "position_group",
                     "birth_date", "contract_expiry")


@query("join_latest_status", """SELECT p.player_id, p.position_group, s.id AS status_id, s.fpl_status, s.contract_expiry
  FROM v_player p LEFT JOIN v_latest_status s USING (player_id)""")
def join_latest_status(spark, sf):
    latest = T.latest_status(B.status(spark, sf)).withColumnRenamed("id", "status_id")
    return (B.dim_player(spark, sf).join(latest, "player_id", "left")
            .select("player_id", "position_group", "status_id", "fpl_status", "contract_expiry"))


@query("latest_status", "SELECT player_id, id, fpl_status, chance_of_playing, contract_expiry FROM v_latest_status")
def latest_status(spark, sf):
    return T.latest_status(B.status(spark, sf)).drop("fetched_at")


@query("latest_value_per_source", "SELECT player_id, source, id, value_eur, tm_last_updated, is_stale FROM v_latest_value")
def latest_value_per_source(spark, sf):
    return T.latest_value_per_source(B.market_values(spark, sf)).drop("fetched_at")


@query("with_receipt", """SELECT id, player_id, source, value_eur, tm_last_updated FROM v_value
  WHERE value_eur IS NOT NULL AND tm_last_updated IS NOT NULL""")
def with_receipt(spark, sf):
    return T.with_receipt(B.market_values(spark, sf)).select(
        "id", "player_id", "source", "value_eur", "tm_last_updated")


@query("prefer_source", "SELECT player_id, source, value_eur, tm_last_updated, is_stale FROM v_best_value")
def prefer_source(spark, sf):
    latest = T.latest_value_per_source(B.market_values(spark, sf))
    return T.prefer_source(latest, P.MARKET_PRECEDENCE).select(
        "player_id", "source", "value_eur", "tm_last_updated", "is_stale")


@query("current_club", "SELECT player_id, current_team_id FROM v_current_club")
def current_club(spark, sf):
    return T.current_club(B.fact(spark, sf), B.dim_match(spark, sf), B.current_season(spark, sf))


@query("profile_joins", """SELECT player_id, current_team_id, canonical_name, position_group, birth_date, season_minutes,
  fpl_status, chance_of_playing, contract_expiry, strftime(status_as_of, '%Y-%m-%dT%H:%M:%SZ') AS status_as_of FROM v_profile""")
def profile_joins(spark, sf):
    df = T.player_profiles(B.fact(spark, sf), B.dim_match(spark, sf), B.current_season(spark, sf),
                           B.dim_player(spark, sf), B.status(spark, sf))
    return df.withColumn("status_as_of", S.iso_utc("status_as_of"))


@query("incumbent", """SELECT team_id, position_group, player_id, mins FROM (SELECT *, row_number() OVER (
  PARTITION BY team_id, position_group ORDER BY mins DESC, player_id) AS rn FROM v_squad WHERE position_group IS NOT NULL) WHERE rn = 1""")
def incumbent(spark, sf):
    squads = T.club_players(B.fact(spark, sf), B.current_season(spark, sf), B.dim_player(spark, sf),
                            B.status(spark, sf))
    return T.incumbent(squads).select("team_id", "position_group", "player_id", F.col("minutes").alias("mins"))


@query("minutes_coverage", """SELECT source, round(linked / total, 6) AS share FROM (
  SELECT sum(mins)::DOUBLE AS total, sum(CASE WHEN understat_id IS NOT NULL THEN mins ELSE 0 END)::DOUBLE AS understat,
    sum(CASE WHEN tm_id IS NOT NULL THEN mins ELSE 0 END)::DOUBLE AS transfermarkt
  FROM v_fact JOIN v_player USING (player_id) WHERE source = 'fpl') UNPIVOT (linked FOR source IN (understat, transfermarkt))""")
def minutes_coverage(spark, sf):
    df = T.minutes_coverage(B.fact(spark, sf), B.dim_player(spark, sf),
                            {"understat": "understat_id", "transfermarkt": "tm_id"})
    return rounded(df, "share")


@query("freshness", """SELECT source, strftime(max(fetched_at), '%Y-%m-%dT%H:%M:%SZ') AS last_fetched,
  round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(fetched_at))) / 3600000000.0, 6)::DOUBLE AS age_hours,
  (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(fetched_at))) / 3600000000.0 >
    CASE source WHEN 'override' THEN 24 WHEN 'transfermarkt' THEN 168 ELSE 72 END AS stale FROM v_value GROUP BY source""")
def freshness(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    df = T.freshness(B.market_values(spark, sf), {**P.STALE_AFTER_HOURS, "override": 24}, now)
    return rounded(df.withColumn("last_fetched", S.iso_utc("last_fetched")), "age_hours")


@query("receipts", """SELECT player_id, source, max(fetched_at) AS as_of FROM v_fact GROUP BY 1, 2
  UNION ALL SELECT player_id, source, max(tm_last_updated) FROM v_latest_value GROUP BY 1, 2""")
def receipts(spark, sf):
    facts = B.fact(spark, sf).select("player_id", "source", F.col("fetched_at").alias("as_of"))
    values = T.latest_value_per_source(B.market_values(spark, sf)).select(
        "player_id", "source", F.col("tm_last_updated").alias("as_of"))
    return T.receipts(facts.unionByName(values))


@query("model_runs", """SELECT 'role archetypes' AS name, max(fetched_at) AS trained_at, count(*) AS rows FROM v_totals
  UNION ALL SELECT 'value model', max(tm_last_updated), count(*) FROM v_latest_value""")
def model_runs(spark, sf):
    roles = T.player_season(B.fact(spark, sf)).select(F.col("fetched_at").alias("trained_at"))
    scores = T.latest_value_per_source(B.market_values(spark, sf)).select(
        F.col("tm_last_updated").alias("trained_at"))
    return T.model_runs({"role archetypes": roles, "value model": scores})


@query("current_clubs", "SELECT team_id, name, fpl_code FROM v_club")
def current_clubs(spark, sf):
    return T.current_clubs(B.dim_team(spark, sf), B.dim_match(spark, sf),
                           B.current_season(spark, sf)).select("team_id", "name", "fpl_code")


@query("in_current_season", """SELECT match_id, season_id, home_team_id, away_team_id FROM v_match
  WHERE season_id IN (SELECT season_id FROM v_season WHERE is_current)""")
def in_current_season(spark, sf):
    current = B.dim_season(spark, sf).filter("is_current")
    return (B.dim_match(spark, sf).join(current, "season_id", "left_semi")
            .select("match_id", "season_id", "home_team_id", "away_team_id"))


@query("dim_season", "SELECT season_id, is_current FROM v_season")
def dim_season(spark, sf):
    played = B.table(spark, sf, "orders").select(S.season_label(F.year("o_orderdate")).alias("season_id"))
    return D.dim_season(played, B.current_season(spark, sf))


@query("standardise", """SELECT source, team_id, season_id, round((p - avg(p) OVER w) / nullif(stddev_pop(p) OVER w, 0), 6) AS possession_z,
  round(CASE WHEN count(d) OVER w >= 2 THEN (d - avg(d) OVER w) / nullif(stddev_pop(d) OVER w, 0) END, 6) AS deep_z
  FROM (SELECT source, team_id, season_id, possession_total / nullif(possession_matches, 0) AS p, deep_total / nullif(deep_matches, 0) AS d
    FROM v_team_season) WINDOW w AS (PARTITION BY source, season_id)""")
def standardise(spark, sf):
    ts = T.team_season(B.fact_team(spark, sf), B.dim_match(spark, sf)).select(
        "source", "team_id", "season_id",
        S.ratio("possession_total", "possession_matches").alias("possession"),
        S.ratio("deep_total", "deep_matches").alias("deep"))
    df = T.standardise(ts, ["possession", "deep"], ["source", "season_id"])
    return rounded(df.drop("possession", "deep"), "possession_z", "deep_z")
