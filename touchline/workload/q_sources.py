"""Scans of landed feeds, sinks and dimensions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as PT

from touchline import catalogue
from touchline.operators import dimensions as D
from touchline.operators import quality as Q
from touchline.operators import totals as T
from touchline.operators.common import shared_dir, stage
from touchline.plans import load as PL
from touchline.sources import scans as SC
from touchline.sources import sinks as SK
from touchline.sources import snapshots as SN
from touchline.workload import bindings as B
from touchline.workload.feeds import STAMP, landed
from touchline.workload.q_features import staged_features
from touchline.workload.q_links import RULES, failed_sql, staged
from touchline.workload.registry import ORACLES, query, r6, rounded
from touchline.workload.sqltext import view

AT = "TIMESTAMP '2026-01-02 03:04:05'"
NOON = "TIMESTAMP '2001-09-01 15:00:00'"


def fpl(spark, sf, name):
    return f"{landed(spark, sf, f'fpl/{name}')}/fpl/{STAMP}/{name}"


@query("scan_teams", f"""SELECT n_nationkey + 1 AS fpl_team_id, n_nationkey + 100 AS fpl_code, n_name AS name, 'N' || n_nationkey AS short_name, '2001-02' AS season_id,
  'fpl' AS source, {AT} AS fetched_at FROM nation""")
def scan_teams(spark, sf):
    return SC.scan_teams(spark, fpl(spark, sf, "bootstrap-static.json"), multi_line=False)


view("x_player", """SELECT c_custkey + 5000 AS fpl_code, c_custkey + 1 AS fpl_element_id, c_mktsegment AS first_name, c_name AS second_name, c_name AS web_name,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' Junior' END AS known_name, CASE WHEN c_custkey % 4 <> 0 THEN DATE '1970-01-01' + CAST(c_custkey % 5000 AS INTEGER) END AS birth_date,
  c_nationkey + 100 AS team_fpl_code, (['GKP', 'DEF', 'MID', 'FWD'])[c_custkey % 4 + 1] AS fpl_position, 'a' AS fpl_status, CASE WHEN c_custkey % 2 <> 0 THEN 'knock' END AS news,
  CASE WHEN c_custkey % 5 = 0 THEN 75 END AS chance_of_playing FROM customer WHERE c_custkey % 97 <> 0""")


@query("scan_players", f"SELECT *, '2001-02' AS season_id, 'fpl' AS source, {AT} AS fetched_at FROM x_player")
def scan_players(spark, sf):
    return SC.scan_players(spark, fpl(spark, sf, "bootstrap-static.json"), multi_line=False)[0]


def fixtures(spark, sf):
    return SC.scan_fixtures(spark, fpl(spark, sf, "fixtures.json"), scan_teams(spark, sf), multi_line=False)


view("x_fixture", """SELECT match_id + 7000000 AS fpl_fixture_code, match_id AS fpl_fixture_id, CASE WHEN match_id % 6 <> 0 THEN CAST(match_id % 38 AS INT) END AS gameweek,
  CAST(kickoff AS TIMESTAMP) + INTERVAL 15 HOUR AS kickoff, home_team_id + 100 AS home_team_fpl_code, away_team_id + 100 AS away_team_fpl_code, home_score, away_score,
  home_score IS NOT NULL AS finished FROM v_match WHERE match_id % 89 <> 0""")


@query("scan_fixtures", f"SELECT *, '2001-02' AS season_id, 'fpl' AS source, {AT} AS fetched_at FROM x_fixture")
def scan_fixtures(spark, sf):
    return fixtures(spark, sf)[0]


@query("scan_player_match", f"""SELECT f.player_id + 5000 AS fpl_code, f.match_id + 7000000 AS fpl_fixture_code, '2001-02' AS season_id, 3 AS gameweek, {NOON} AS kickoff,
  CASE WHEN f.shots % 2 = 1 THEN m.home_team_id ELSE m.away_team_id END + 100 AS team_fpl_code, CASE WHEN f.shots % 2 = 1 THEN m.away_team_id ELSE m.home_team_id END + 100 AS opponent_fpl_code,
  f.shots % 2 = 1 AS was_home, f.mins, f.started, f.goals, f.assists, f.xg, f.npxg AS xa, f.xgc_on_pitch, f.tackles, f.cbi, f.recoveries, f.def_contribution, f.yellow_cards, f.red_cards, f.saves,
  f.goals_conceded, f.penalties_saved, 'fpl' AS source, {AT} AS fetched_at FROM v_fact f JOIN v_match m ON m.match_id = f.match_id WHERE f.player_id % 97 <> 0 AND f.match_id % 89 <> 0""")
def scan_player_match(spark, sf):
    df, _bad = SC.scan_player_match(spark, fpl(spark, sf, "element-summary.json"), scan_players(spark, sf), scan_fixtures(spark, sf),
                                    scan_teams(spark, sf), multi_line=False)
    return df.withColumnRenamed("minutes", "mins")


_OLD = "CAST(substr(f.season_id, 1, 4) AS INT) < 1997"


def _new(expr: str) -> str:
    return f"CASE WHEN NOT {_OLD} THEN {expr} END"


@query("scan_archive_seasons", f"""SELECT DISTINCT f.player_id + 5000 AS fpl_code, f.season_id, f.match_id AS fpl_fixture_id, 3 AS gameweek, {NOON} AS kickoff,
  CASE WHEN f.shots % 2 = 1 THEN m.away_team_id ELSE m.home_team_id END + 100 AS opponent_fpl_code, 'NATION_' || CASE WHEN f.shots % 2 = 1 THEN m.away_team_id ELSE m.home_team_id END AS opponent_name,
  f.shots % 2 = 1 AS was_home, f.mins, {_new('f.started')} AS started, f.goals, f.assists, f.yellow_cards, f.red_cards, {_new('f.xg')} AS xg, {_new('f.xa')} AS xa, CAST(NULL AS DOUBLE) AS xgc_on_pitch,
  {_new('f.tackles')}::DOUBLE AS tackles, CAST(NULL AS DOUBLE) AS cbi, {_new('f.recoveries')}::DOUBLE AS recoveries, CAST(NULL AS DOUBLE) AS def_contribution, CAST(NULL AS DOUBLE) AS saves,
  CAST(NULL AS DOUBLE) AS goals_conceded, CAST(NULL AS DOUBLE) AS penalties_saved, {_new('m.home_score')} AS home_score, {_new('m.away_score')} AS away_score, CAST(NULL AS INT) AS team_fpl_code_end_of_season, 'vaastav' AS source, {AT} AS fetched_at
  FROM v_fact f JOIN v_match m ON m.match_id = f.match_id""")
def scan_archive_seasons(spark, sf):
    root = landed(spark, sf, "vaastav")
    seasons = [r["season_id"] for r in SN.seasons_present(SN.list_files(spark, f"{root}/vaastav")).collect()]
    rows, _rejects = SC.scan_archive_seasons(spark, f"{root}/vaastav/{STAMP}", seasons)
    return rows.withColumnRenamed("minutes", "mins")


view("x_shot", """SELECT f.match_id, f.player_id, n.n_name AS team, f.npxg / 2 AS xg, f.recoveries % 4 AS kind FROM v_fact f JOIN nation n ON n.n_nationkey = f.team_id WHERE f.match_id % 5 <> 0""")


@query("scan_player_shots", f"""SELECT p.player_id AS understat_player_id, p.match_id AS understat_game_id, p.team_id AS understat_team_id, 'P' || p.player_id AS player_name, n.n_name AS team_name, p.season_id,
  'MC' AS position, p.xg, CASE WHEN p.xg IS NOT NULL THEN greatest(0, p.xg - coalesce(s.pen, 0)) END AS npxg, p.xa, p.xg_chain, p.xg_buildup, CAST(p.mins AS INT) AS mins, CAST(p.goals AS INT) AS goals,
  CAST(p.shots AS INT) AS shots, CAST(p.key_passes AS INT) AS key_passes, CAST(NULL AS INT) AS assists, CAST(NULL AS INT) AS yellow_cards, CAST(NULL AS INT) AS red_cards, 'understat' AS source, {AT} AS fetched_at
  FROM (SELECT match_id, player_id, team_id, season_id, sum(mins) AS mins, sum(goals) AS goals, sum(shots) AS shots, sum(xa) AS xg, sum(npxg) AS xa, sum(xg_chain) AS xg_chain, sum(xg_buildup) AS xg_buildup,
    sum(key_passes) AS key_passes FROM v_fact GROUP BY 1, 2, 3, 4) p JOIN nation n ON n.n_nationkey = p.team_id
  LEFT JOIN (SELECT match_id, player_id, sum(xg) AS pen FROM x_shot WHERE kind = 0 GROUP BY 1, 2) s ON s.match_id = p.match_id AND s.player_id = p.player_id""")
def scan_player_shots(spark, sf):
    base = f"{landed(spark, sf, 'understat/players', 'understat/shots')}/understat/{STAMP}"
    return SC.scan_player_shots(spark, f"{base}/*_player_match.csv", f"{base}/*_shots.csv").withColumnRenamed("minutes", "mins")


view("x_game", """SELECT m.*, h.n_name AS hn, a.n_name AS an, match_id % 8 / 4 AS hxg, CASE WHEN match_id % 9 <> 0 THEN match_id % 16 / 8 END AS axg, match_id % 4 / 4 AS hnp, match_id % 2 / 2 AS anp,
  match_id % 32 / 2 AS hp, match_id % 64 / 4 AS ap, (match_id % 11)::DOUBLE AS hd, (match_id % 13)::DOUBLE AS ad FROM v_match m JOIN nation h ON h.n_nationkey = home_team_id JOIN nation a ON a.n_nationkey = away_team_id""")
view("x_half", """SELECT match_id, season_id, kickoff, home_team_id AS t, away_team_id AS o, hn AS tn, an AS opn, true AS is_home, home_score AS g, away_score AS ga, hxg AS xg, axg AS xga, hnp AS npxg, anp AS npxga,
  hp AS ppda, ap AS ppda_allowed, hd AS deep, ad AS deep_allowed FROM x_game UNION ALL SELECT match_id, season_id, kickoff, away_team_id, home_team_id, an, hn, false, away_score, home_score, axg, hxg, anp, hnp, ap, hp, ad, hd FROM x_game""")


@query("scan_team_match_unpivot", f"""SELECT x.match_id AS understat_game_id, x.season_id, coalesce(x.kickoff, DATE '2000-01-01') AS date, x.t AS understat_team_id, x.o AS understat_opponent_id, x.tn AS team_name,
  x.opn AS opponent_name, x.is_home, x.g AS goals, x.ga AS goals_against, x.xg, x.xga, x.npxg, x.npxga, x.ppda, x.ppda_allowed, x.deep, x.deep_allowed,
  CASE WHEN x.match_id % 5 <> 0 THEN coalesce(a.sp, 0) END AS set_piece_xg, CASE WHEN x.match_id % 5 <> 0 THEN coalesce(b.sp, 0) END AS set_piece_xga,
  CASE WHEN x.match_id % 5 <> 0 THEN coalesce(b.op, 0) END AS open_play_xga, 'understat' AS source, {AT} AS fetched_at FROM x_half x
  LEFT JOIN (SELECT match_id, team, sum(CASE WHEN kind IN (1, 2) THEN xg ELSE 0 END) AS sp FROM x_shot GROUP BY 1, 2) a ON a.match_id = x.match_id AND a.team = x.tn
  LEFT JOIN (SELECT match_id, team, sum(CASE WHEN kind IN (1, 2) THEN xg ELSE 0 END) AS sp, sum(CASE WHEN kind = 3 THEN xg ELSE 0 END) AS op FROM x_shot GROUP BY 1, 2) b ON b.match_id = x.match_id AND b.team = x.opn""")
def scan_team_match_unpivot(spark, sf):
    base = f"{landed(spark, sf, 'understat/games', 'understat/shots')}/understat/{STAMP}"
    return SC.scan_team_match_unpivot(spark, f"{base}/*_team_match.csv", f"{base}/*_shots.csv")


view("x_event", """SELECT *, (match_id % 60 + 20) / 100.0::DOUBLE AS hs, CASE WHEN match_id % 50 = 0 THEN (match_id % 60 + 25) / 100.0::DOUBLE WHEN match_id % 7 = 0 THEN NULL ELSE (80 - match_id % 60) / 100.0::DOUBLE END AS aws
  FROM x_game WHERE kickoff IS NOT NULL AND match_id % 12 <> 0""")


@query("scan_possession", f"""SELECT season_id, match_id AS espn_event_id, kickoff AS date, CAST(kickoff AS TIMESTAMP) + INTERVAL 15 HOUR AS kickoff, s.team_name, s.opponent_name, s.is_home, round(s.a, 6) AS possession_share,
  round(s.b, 6) AS opp_possession_share, 'espn' AS source, {AT} AS fetched_at FROM x_event,
  LATERAL (SELECT hn AS team_name, an AS opponent_name, true AS is_home, hs AS a, aws AS b UNION ALL SELECT an, hn, false, aws, hs) s WHERE NOT coalesce(abs(hs + aws - 1) > 0.02, false)""")
def scan_possession(spark, sf):
    df, _bad = SC.scan_possession(spark, f"{landed(spark, sf, 'espn')}/espn/{STAMP}/scoreboards.json", multi_line=False)
    return rounded(df, "possession_share", "opp_possession_share")


view("x_last", """SELECT player_id, max(tm_last_updated) AS d, (list(value_eur ORDER BY tm_last_updated DESC, value_eur DESC NULLS LAST))[1] AS v FROM v_value WHERE tm_last_updated IS NOT NULL GROUP BY 1""")


@query("scan_market_live", f"""SELECT CAST(c_custkey AS VARCHAR) AS tm_player_id, 'c' || c_nationkey AS tm_club_id, 'NATION_' || c_nationkey AS tm_club_name, c_name AS name,
  CASE WHEN c_custkey % 3 <> 0 THEN 'Left Winger' END AS tm_position, DATE '1970-01-01' + CAST(c_custkey % 5000 AS INTEGER) AS birth_date, DATE '2003-06-30' AS contract_expiry,
  CASE WHEN l.d IS NOT NULL THEN CASE WHEN c_custkey % 2 = 0 THEN 1500000 ELSE l.v END END AS value_eur, l.d AS tm_last_updated, false AS is_stale, 'transfermarkt' AS source, {AT} AS fetched_at
  FROM customer LEFT JOIN x_last l ON l.player_id = c_custkey""")
def scan_market_live(spark, sf):
    return SC.scan_market_live(spark, f"{landed(spark, sf, 'transfermarkt')}/transfermarkt/{STAMP}", multi_line=False)


def market_files(spark, sf):
    base = f"{landed(spark, sf, 'transfermarkt_datasets')}/transfermarkt_datasets/{STAMP}"
    return f"{base}/players.csv.gz", f"{base}/player_valuations.csv.gz"


@query("scan_market_latest", f"""SELECT CAST(c_custkey AS VARCHAR) AS tm_player_id, CAST(c_nationkey AS VARCHAR) AS tm_club_id, 'NATION_' || c_nationkey AS tm_club_name, c_name AS name, 'Centre-Back' AS tm_position,
  DATE '1990-05-01' AS birth_date, DATE '2004-06-30' AS contract_expiry, l.v AS value_eur, l.d AS tm_last_updated, true AS is_stale, 'transfermarkt_datasets' AS source, {AT} AS fetched_at
  FROM customer LEFT JOIN x_last l ON l.player_id = c_custkey WHERE c_custkey % 3 <> 0""")
def scan_market_latest(spark, sf):
    return SC.scan_market_latest(spark, *market_files(spark, sf), "GB1")


@query("scan_market_history", f"""SELECT CAST(player_id AS VARCHAR) AS tm_player_id, max(value_eur) AS value_eur, tm_last_updated, true AS is_stale, 'transfermarkt_datasets' AS source, {AT} AS fetched_at
  FROM v_value WHERE player_id % 3 <> 0 AND player_id IN (SELECT c_custkey FROM customer) AND tm_last_updated IS NOT NULL GROUP BY player_id, tm_last_updated HAVING max(value_eur) IS NOT NULL""")
def scan_market_history(spark, sf):
    return SC.scan_market_history(spark, *market_files(spark, sf), "GB1")


@query("scan_overrides", """SELECT CAST(player_id AS VARCHAR) AS tm_player_id, value_eur, tm_last_updated, CASE WHEN ok THEN DATE '2026-01-01' END AS fetched_at, CASE WHEN NOT ok THEN
    array_to_string(list_filter([CASE WHEN value_eur IS NULL THEN 'value_eur' END, CASE WHEN tm_last_updated IS NULL THEN 'tm_last_updated' END, CASE WHEN id % 5 = 0 THEN 'reason' END], lambda x: x IS NOT NULL), ',') END AS empty_columns
  FROM (SELECT *, value_eur IS NOT NULL AND tm_last_updated IS NOT NULL AND id % 5 <> 0 AS ok FROM v_value WHERE source = 'override')""")
def scan_overrides(spark, sf):
    good, bad = SC.scan_overrides(spark, f"{landed(spark, sf, 'override')}/override/{STAMP}/market_value_overrides.csv")
    kept = SC.market_overrides(good).select("tm_player_id", "value_eur", "tm_last_updated", "fetched_at").withColumn("empty_columns", F.lit(None).cast("string"))
    lost = bad.select("tm_player_id", F.col("value_eur").try_cast("bigint").alias("value_eur"), F.col("tm_last_updated").try_cast("date").alias("tm_last_updated"),
                      F.lit(None).cast("date").alias("fetched_at"), F.array_join("empty_columns", ",").alias("empty_columns"))
    return kept.unionByName(lost)


@query("scan_player_overrides", """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'understat' ELSE 'transfermarkt' END AS source, 'r' || c_custkey AS source_id,
  CASE WHEN c_custkey % 11 <> 0 THEN c_custkey + 5000 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END END AS code, CASE WHEN c_custkey % 11 = 0 THEN 'reason' END AS empty_columns
  FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'understat' ELSE 'transfermarkt' END, 'r' || c_custkey, NULL, 'reason'
  FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 7 = 0 AND c_custkey % 11 = 0""")
def scan_player_overrides(spark, sf):
    good, bad = SC.scan_player_overrides(spark, f"{landed(spark, sf, 'forced')}/forced/{STAMP}/player_overrides.csv")
    return good.withColumn("empty_columns", F.lit(None).cast("string")).unionByName(
        bad.select("source", "source_id", F.lit(None).cast("bigint").alias("code"), F.array_join("empty_columns", ",").alias("empty_columns")))


@query("scan_events_flatten", f"""SELECT user_id % 20 AS match_id, CAST(event_id AS VARCHAR) AS event_id, CAST(event_id % 3000 AS INT) AS "index", 1 AS period, CAST(event_id % 90 AS INT) AS minute, CAST(event_id % 60 AS INT) AS second,
  event_type AS type, CAST(user_id % 25 AS INT) AS team_id, 'team' AS team, CASE WHEN event_id % 4 <> 0 THEN user_id END AS player_id, CASE WHEN event_id % 4 <> 0 THEN 'someone' END AS player, CAST(NULL AS VARCHAR) AS position,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 120)::DOUBLE END AS x, CASE WHEN event_id % 5 <> 0 THEN (event_id % 80)::DOUBLE END AS y, CASE event_type WHEN 'click' THEN (event_id % 120)::DOUBLE WHEN 'view' THEN 1 END AS end_x,
  CASE event_type WHEN 'click' THEN (event_id % 80)::DOUBLE WHEN 'view' THEN 2 END AS end_y, CASE WHEN event_type = 'purchase' THEN event_id % 8 / 8 END AS shot_xg, CASE WHEN event_type = 'purchase' THEN 'Goal' END AS outcome,
  'statsbomb' AS source, {AT} AS fetched_at FROM events""")
def scan_events_flatten(spark, sf):
    return SC.scan_events_flatten(spark, f"{landed(spark, sf, 'statsbomb')}/statsbomb/{STAMP}/*events-*", multi_line=False)


_NAMES = f"""SELECT 'fpl' AS source, unnest(['bootstrap-static.json', 'fixtures.json', 'element-summary.json']) AS name UNION ALL
  SELECT 'vaastav', 'name=' || season_id || unnest(['_merged_gw.csv', '_players_raw.csv']) FROM v_season UNION ALL SELECT 'vaastav', 'file=' || season_id || '_teams.csv' FROM v_season UNION ALL
  SELECT 'understat', 'name=' || season_id || k FROM v_season, (VALUES ('_player_match.csv'), ('_shots.csv'), ('_team_match.csv')) t(k) UNION ALL SELECT 'espn', 'scoreboards.json' UNION ALL
  SELECT 'transfermarkt', unnest(['club-search.json', 'club-players.json', 'market-value.json']) UNION ALL SELECT 'transfermarkt_datasets', unnest(['players.csv.gz', 'player_valuations.csv.gz']) UNION ALL
  SELECT 'override', 'market_value_overrides.csv' UNION ALL SELECT 'forced', 'player_overrides.csv' UNION ALL SELECT DISTINCT 'statsbomb', 'name=events-' || user_id % 20 || '.json' FROM events"""


@query("latest_snapshot", f"SELECT source, name, '{STAMP}' AS ts FROM ({_NAMES})")
def latest_snapshot(spark, sf):
    files = SN.list_files(spark, landed(spark, sf)).filter(~F.col("name").startswith("_"))
    return SN.latest_snapshot(files).select("source", "name", "ts")


@query("snapshot_audit")
def snapshot_audit(spark, sf):
    return SN.snapshot_audit(spark, landed(spark, sf))


@query("seasons_present", "SELECT season_id, CAST(row_number() OVER (ORDER BY season_id DESC) AS INT) AS place FROM v_season")
def seasons_present(spark, sf):
    return SN.seasons_present(SN.list_files(spark, landed(spark, sf)))


REQUIRED = PT.StructType([
    PT.StructField("events", PT.ArrayType(PT.StructType([PT.StructField("deadline_time", PT.StringType()), PT.StructField("name", PT.StringType())]))),
    PT.StructField("elements", PT.ArrayType(PT.StructType([PT.StructField("code", PT.LongType()), PT.StructField("squad_number", PT.LongType())]))),
    PT.StructField("phases", PT.StringType())])


@query("schema_drift", "SELECT unnest(['elements.squad_number', 'events.name', 'phases']) AS missing")
def schema_drift(spark, sf):
    found = spark.read.json(fpl(spark, sf, "bootstrap-static.json")).schema
    return spark.createDataFrame([(m,) for m in Q.schema_drift(found, REQUIRED)], "missing string")


# -- sinks ------------------------------------------------------------------------------

def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("replace_by_source", """SELECT source, count(*) AS n, CAST(sum(CASE WHEN source = 'fpl' THEN 1 ELSE 0 END) AS BIGINT) AS replaced FROM v_fact GROUP BY 1""")
def replace_by_source(spark, sf):
    path = folder(spark, "fact")
    rows = B.fact(spark, sf).withColumn("load", F.lit(1))
    SK.replace_by_source(rows.unionByName(rows.limit(1).withColumn("source", F.lit("gone"))), path, ["fpl", "understat", "vaastav", "gone"])
    SK.replace_by_source(rows.filter(F.col("source") == "fpl").withColumn("load", F.lit(2)), path, ["fpl", "gone"])
    return SK.read_by_source(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("load") == 2).alias("replaced"))


@query("replace_features", "SELECT season_mode, count(*) AS n, count(percentile) AS ranked FROM f_features GROUP BY 1")
def replace_features(spark, sf):
    path = folder(spark, "features")
    feats = staged_features(spark, sf)
    SK.replace_features(feats.filter(F.col("season_mode") == "current"), path)
    return SK.replace_features(feats, path).groupBy("season_mode").agg(F.count(F.lit(1)).alias("n"), F.count("percentile").alias("ranked"))


@query("build_summary", """SELECT 'fpl,understat,vaastav' AS sources, (SELECT count(*) FROM v_fact) AS rows, 5 AS issues, (SELECT round(least(a, b) / c, 6) FROM (SELECT
    sum(CASE WHEN understat_id IS NOT NULL THEN mins ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN tm_id IS NOT NULL THEN mins ELSE 0 END)::DOUBLE AS b, sum(mins)::DOUBLE AS c FROM v_fact JOIN v_player USING (player_id) WHERE source = 'fpl')) AS min_coverage,
  (SELECT count(*) FROM v_player WHERE tm_id IS NULL) AS review_count, false AS valid""")
def build_summary(spark, sf):
    fact, players = B.fact(spark, sf), B.dim_player(spark, sf)
    written = SK.replace_by_source(fact, folder(spark, "fact"), ["fpl", "understat", "vaastav"])
    cover = T.minutes_coverage(fact, players, {"understat": "understat_id", "transfermarkt": "tm_id"})
    return rounded(SK.build_summary(written, Q.validate_tables(staged(spark, sf), RULES), cover, players.filter("tm_id is null")), "min_coverage")


# -- dimensions -------------------------------------------------------------------------

SLOTS = (*catalogue.SLOT_GROUPS, "Sub")
view("d_slot", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', {repr(catalogue.SLOT_GROUPS[s]) if s in catalogue.SLOT_GROUPS else 'NULL'})" for i, s in enumerate(SLOTS)) + ") t(i, slot, g)")
view("d_position", """SELECT player_id AS player, g AS position_group FROM (SELECT player_id, g, row_number() OVER (PARTITION BY player_id ORDER BY m DESC, g) AS rn FROM (
  SELECT f.player_id, s.g, sum(f.mins - 5) AS m FROM v_fact f JOIN d_slot s ON s.i = (f.recoveries + f.tackles) % 16 WHERE s.g IS NOT NULL AND f.mins > 5 GROUP BY 1, 2)) WHERE rn = 1""")


def slot_rows(spark, sf):
    slot = F.try_element_at(F.array(*[F.lit(s) for s in SLOTS]), ((F.col("recoveries") + F.col("tackles")) % 16 + 1).cast("int"))
    return B.fact(spark, sf).select(F.col("player_id").alias("player"), slot.alias("slot"), F.greatest(F.col("minutes") - 5, F.lit(0)).alias("minutes"))


@query("position_by_minutes", "SELECT player, position_group FROM d_position")
def position_by_minutes(spark, sf):
    return D.position_by_minutes(slot_rows(spark, sf))


@query("club_of_match_from_opponent", """SELECT f.player_id, f.match_id, CASE WHEN f.shots % 2 = 0 THEN m.away_team_id ELSE m.home_team_id END AS team_id, count(*) AS n FROM v_fact f JOIN v_match m ON m.match_id = f.match_id GROUP BY 1, 2, 3""")
def club_of_match_from_opponent(spark, sf):
    m = B.dim_match(spark, sf)
    rows = B.fact(spark, sf).drop("team_id", "season_id").join(m.select("match_id", "home_team_id", "away_team_id"), "match_id")
    rows = rows.withColumn("opponent_id", F.when(F.col("shots") % 2 == 0, F.col("home_team_id")).otherwise(F.col("away_team_id"))).drop("home_team_id", "away_team_id")
    return D.club_of_match_from_opponent(rows, m).groupBy("player_id", "match_id", "team_id").agg(F.count(F.lit(1)).alias("n"))


@query("dim_team_merge", """SELECT CAST(dense_rank() OVER (ORDER BY key) AS INT) AS team_id, * EXCLUDE (key) FROM (
  SELECT 'code:' || lpad(CAST(n_nationkey + 100 AS VARCHAR), 12, '0') AS key, CASE WHEN n_nationkey <> 24 THEN n_name ELSE 'us ' || n_name END AS name, n_nationkey + 100 AS fpl_code,
    CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey + 900 END AS understat_id, CASE WHEN n_nationkey % 5 <> 0 THEN 't' || n_nationkey END AS tm_id FROM nation WHERE n_nationkey <> 24
  UNION ALL SELECT 'understat_id:' || (n_nationkey + 900), 'us ' || n_name, NULL, n_nationkey + 900, NULL FROM nation WHERE n_nationkey % 6 = 0
  UNION ALL SELECT 'tm_id:t' || n_nationkey, 'tm ' || n_name, NULL, NULL, 't' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT 'code:' || lpad(CAST(n_nationkey + 100 AS VARCHAR), 12, '0'), 'tm ' || n_name, n_nationkey + 100, NULL, 't' || n_nationkey FROM nation WHERE n_nationkey = 24)""")
def dim_team_merge(spark, sf):
    key, name = F.col("n_nationkey"), F.col("n_name")
    n = B.table(spark, sf, "nation")
    primary = n.filter(key != 24).select((key + 100).alias("fpl_code"), name.alias("name"))
    us = n.select((key + 900).alias("understat_id"), F.concat(F.lit("us "), name).alias("name"), F.when(key % 6 != 0, key + 100).alias("fpl_code"))
    tm = n.select(F.concat(F.lit("t"), key.cast("string")).alias("tm_id"), F.concat(F.lit("tm "), name).alias("name"), F.when(key % 5 != 0, key + 100).alias("fpl_code"))
    return D.dim_team_merge(primary, us, tm)


view("d_detail", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}', '{g}')" for i, (p, g) in enumerate(catalogue.DETAILED_POSITIONS.items())) + ") t(i, p, g)")


@query("dim_player_merge", """SELECT c.c_custkey AS player_id, c.c_name AS canonical_name, p.understat_id, p.tm_id,
  CASE WHEN c.c_custkey % 4 <> 0 THEN DATE '1970-01-01' + CAST(c.c_custkey % 5000 AS INTEGER) WHEN p.tm_id IS NOT NULL AND c.c_custkey % 8 = 0 THEN DATE '1980-01-01' ELSE p.birth_date END AS birth_date,
  CASE WHEN p.tm_id IS NOT NULL THEN d.p END AS detailed_position, coalesce(CASE WHEN p.tm_id IS NOT NULL THEN d.g END, CASE WHEN p.understat_id IS NOT NULL THEN s.position_group END,
    CASE c.c_custkey % 5 WHEN 0 THEN 'GK' WHEN 1 THEN 'CB' WHEN 2 THEN 'CM' WHEN 3 THEN 'ST' END) AS position_group
  FROM customer c JOIN v_player p ON p.player_id = c.c_custkey LEFT JOIN d_detail d ON d.i = c.c_custkey % 20 LEFT JOIN d_position s ON s.player = c.c_custkey""")
def dim_player_merge(spark, sf):
    players = B.dim_player(spark, sf)
    key = F.col("player_id")
    mapping = players.select(key.alias("code"), "canonical_name", "understat_id", F.col("tm_id").alias("transfermarkt_id"))
    kinds = F.array(*[F.lit(k) for k in catalogue.COARSE_POSITIONS])
    primary = players.select(key.alias("code"), F.try_element_at(kinds, (key % 5 + 1).cast("int")).alias("fpl_position"),
                             F.when(key % 4 != 0, F.date_add(F.lit("1970-01-01").cast("date"), (key % 5000).cast("int"))).alias("birth_date"))
    names = F.array(*[F.lit(p) for p in catalogue.DETAILED_POSITIONS])
    tm = players.filter("tm_id is not null").select(F.col("tm_id").alias("tm_player_id"), F.try_element_at(names, (key % 20 + 1).cast("int")).alias("tm_position"),
                                                    F.when(key % 8 == 0, F.lit("1980-01-01").cast("date")).alias("birth_date"))
    slots = D.position_by_minutes(slot_rows(spark, sf)).select((F.col("player") + 5000000).alias("player"), "position_group")
    return D.dim_player_merge(mapping, primary, tm, slots, players)


view("d_pair", """SELECT season_id, home_team_id, away_team_id, min(match_id) AS lo, max(match_id) AS hi FROM v_match GROUP BY 1, 2, 3""")


def season_pairs(spark, sf):
    """One row per season and pairing, as a league has, from its first and last match."""
    return stage(B.dim_match(spark, sf).groupBy(*D.PAIR).agg(F.min("match_id").alias("lo"), F.max("match_id").alias("hi")), "pairs")


def existing_matches(pairs, code=None):
    lo = F.col("lo")
    day = F.when(lo % 3 != 0, F.date_add(F.lit("1999-01-01").cast("date"), (lo % 300).cast("int")))
    score = F.when(lo % 4 != 0, lo % 5)
    return pairs.filter(lo % 5 != 0).select(F.concat(F.lit("m"), lo.cast("string")).alias("match_key"), *D.PAIR, *([code.alias("fixture_code")] if code is not None else []),
                                            day.alias("kickoff"), score.alias("home_score"), score.alias("away_score"))


def new_matches(pairs, key):
    hi = F.col("hi")
    return pairs.filter(hi % 7 != 0).select(*D.PAIR, hi.alias(key), F.date_add(F.lit("2000-01-01").cast("date"), (hi % 300).cast("int")).alias("kickoff"),
                                            (hi % 6).alias("home_score"), (hi % 6).alias("away_score"))


_EX = """SELECT 'm' || lo AS match_key, season_id, home_team_id, away_team_id, lo, CASE WHEN lo % 3 <> 0 THEN DATE '1999-01-01' + CAST(lo % 300 AS INTEGER) END AS kickoff, CASE WHEN lo % 4 <> 0 THEN lo % 5 END AS score FROM d_pair WHERE lo % 5 <> 0"""
_NEW = """SELECT season_id, home_team_id, away_team_id, hi, DATE '2000-01-01' + CAST(hi % 300 AS INTEGER) AS kickoff, hi % 6 AS score FROM d_pair WHERE hi % 7 <> 0"""


@query("dim_match_from_fixtures", f"""SELECT coalesce(e.match_key, 'fixture:' || n.hi) AS match_key, coalesce(n.season_id, e.season_id) AS season_id, coalesce(n.home_team_id, e.home_team_id) AS home_team_id,
  coalesce(n.away_team_id, e.away_team_id) AS away_team_id, coalesce(n.hi, e.code) AS fixture_code, CASE WHEN n.hi IS NOT NULL THEN n.kickoff ELSE e.kickoff END AS kickoff,
  CASE WHEN n.hi IS NOT NULL THEN n.score ELSE e.score END AS home_score, CASE WHEN n.hi IS NOT NULL THEN n.score ELSE e.score END AS away_score
  FROM (SELECT *, CASE WHEN lo % 2 = 0 THEN lo END AS code FROM ({_EX})) e FULL JOIN ({_NEW}) n ON n.season_id = e.season_id AND n.home_team_id = e.home_team_id AND n.away_team_id = e.away_team_id AND (e.code IS NULL OR e.code = n.hi)""")
def dim_match_from_fixtures(spark, sf):
    pairs = season_pairs(spark, sf)
    return D.dim_match_from_fixtures(existing_matches(pairs, F.when(F.col("lo") % 2 == 0, F.col("lo"))), new_matches(pairs, "fixture_code"))


@query("dim_match_from_games", f"""SELECT coalesce(e.match_key, 'game:' || n.hi) AS match_key, season_id, home_team_id, away_team_id, n.hi AS game_id, CASE WHEN e.match_key IS NULL THEN n.kickoff ELSE e.kickoff END AS kickoff,
  coalesce(e.score, n.score) AS home_score, coalesce(e.score, n.score) AS away_score FROM ({_EX}) e FULL JOIN ({_NEW}) n USING (season_id, home_team_id, away_team_id)""")
def dim_match_from_games(spark, sf):
    pairs = season_pairs(spark, sf)
    return D.dim_match_from_games(existing_matches(pairs), new_matches(pairs, "game_id"))


@query("dim_match_from_rows", f"""SELECT coalesce(e.match_key, 'fixture:' || n.hi) AS match_key, season_id, home_team_id, away_team_id, n.hi AS fixture_id, coalesce(e.kickoff, n.kickoff) AS kickoff,
  coalesce(e.score, n.score) AS home_score, coalesce(e.score, n.score) AS away_score FROM ({_EX}) e FULL JOIN (SELECT * FROM ({_NEW}) x WHERE EXISTS (SELECT 1 FROM v_fact f WHERE f.match_id = x.hi AND f.shots % 2 = 1)
    AND EXISTS (SELECT 1 FROM v_fact f WHERE f.match_id = x.hi AND f.shots % 2 = 0)) n USING (season_id, home_team_id, away_team_id)""")
def dim_match_from_rows(spark, sf):
    pairs = season_pairs(spark, sf)
    games = new_matches(pairs, "fixture_id")
    sides = B.fact(spark, sf).select(F.col("match_id").alias("fixture_id"), (F.col("shots") % 2 == 1).alias("was_home"))
    rows = games.join(sides, "fixture_id").withColumn("opponent_id", F.when(F.col("was_home"), F.col("away_team_id")).otherwise(F.col("home_team_id")))
    return D.dim_match_from_rows(existing_matches(pairs), rows.drop("home_team_id", "away_team_id"))


@query("dim_match_attach_event", f"""SELECT e.match_key, season_id, home_team_id, away_team_id, n.hi AS event_id FROM ({_EX}) e LEFT JOIN ({_NEW}) n USING (season_id, home_team_id, away_team_id)
  UNION ALL SELECT 'unmatched', season_id, home_team_id, away_team_id, n.hi FROM ({_NEW}) n ANTI JOIN ({_EX}) e USING (season_id, home_team_id, away_team_id)""")
def dim_match_attach_event(spark, sf):
    pairs = season_pairs(spark, sf)
    known, lost = D.dim_match_attach_event(existing_matches(pairs), new_matches(pairs, "event_id"))
    cols = ["match_key", *D.PAIR, "event_id"]
    return known.select(*cols).unionByName(lost.withColumn("match_key", F.lit("unmatched")).select(*cols))


# -- the rules of the staged tables over the scanned feeds -----------------------------------

_SCANNED = {"fpl_player_match": scan_player_match, "vaastav_player_match": scan_archive_seasons, "understat_player_match": scan_player_shots,
            "understat_team_match": scan_team_match_unpivot, "espn_possession": scan_possession, "tm_market_value": scan_market_live}


def _rules_sql(table: str, rules: Q.Rules) -> list[str]:
    view(f"s_{table}", ORACLES[_SCANNED[table].__name__])

    def own(column: str) -> str:
        return "mins" if column == "minutes" else column

    def rows(column: str, bad: str) -> str:
        return f"SELECT 1 AS n, {own(column)} AS v FROM s_{table} WHERE {bad}"

    out = [failed_sql(table, c, "not_null", "'null'", rows(c, f"{own(c)} IS NULL")) for c in rules.not_null]
    out += [failed_sql(table, c, "non_negative", "v", rows(c, f"{own(c)} < 0")) for c in rules.non_negative]
    out += [failed_sql(table, c, f"in_range({lo:g},{hi:g})", "v", rows(c, f"NOT {own(c)} BETWEEN {lo} AND {hi}")) for c, (lo, hi) in rules.in_range.items()]
    out += [failed_sql(table, c, f"requires({need})", "v", rows(c, f"{own(c)} IS NOT NULL AND {own(need)} IS NULL")) for c, need in rules.requires.items()]
    if rules.unique:
        keys = ", ".join(rules.unique)
        out.append(failed_sql(table, "/".join(rules.unique), "unique", " || '/' || ".join(rules.unique),
                              f"SELECT {keys}, count(*) AS n FROM s_{table} GROUP BY {keys} HAVING count(*) > 1"))
    return out


@query("validate_staged", "SELECT * FROM (" + " UNION ALL ".join(x for t, r in Q.STAGED_RULES.items() for x in _rules_sql(t, r)) + ") WHERE failures > 0")
def validate_staged(spark, sf):
    """All rules of the six staged tables, over the rows that the scans give."""
    frames = {name: scan(spark, sf).withColumnsRenamed({"mins": "minutes"}) for name, scan in _SCANNED.items()}
    return Q.validate_tables(frames).withColumn("examples", F.array_join("examples", "|"))


# -- facts from the scanned feeds -------------------------------------------------------------

def load_dims(spark, sf):
    """Dimensions that know most of the feeds' players, matches and clubs."""
    pid, mid, tid = F.col("player_id"), F.col("match_id"), F.col("team_id")
    players = B.dim_player(spark, sf).filter(pid % 13 != 0).select("player_id", (pid + 5000).alias("fpl_code"), F.when(pid % 10 != 0, pid).alias("understat_id"), F.when(pid % 9 != 0, pid.cast("string")).alias("tm_id"))
    matches = B.dim_match(spark, sf).filter(mid % 17 != 0).select("match_id", "season_id", "home_team_id", "away_team_id", (mid + 7000000).alias("fpl_fixture_code"),
                                                                  mid.alias("fpl_fixture_id"), mid.alias("understat_game_id"), mid.alias("espn_event_id"))
    teams = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("name")).filter(tid != 23).select(
        "team_id", "name", (tid + 100).alias("fpl_code"), tid.alias("understat_id"))
    return {"player": players, "match": matches, "team": teams}


view("s_fpl_players", ORACLES["scan_players"])
_P, _M = "{p} % 13 <> 0 AND {p} IN (SELECT player_id FROM v_player)", "{m} % 17 <> 0 AND {m} IN (SELECT match_id FROM v_match)"


def _loaded(label: str, table: str, ok: str, measure: str) -> str:
    return f"""SELECT '{label}' AS label, count(*) FILTER (ok) AS written, count(*) FILTER (NOT ok) AS skipped, CAST(sum(m) FILTER (ok) AS BIGINT) AS measure
      FROM (SELECT coalesce({ok}, false) AS ok, {measure} AS m FROM s_{table})"""


_FPL_KEYS = f"{_P.format(p='(fpl_code - 5000)')} AND "
_LOAD_SQL = " UNION ALL ".join([
    _loaded("fact_player_match:fpl", "fpl_player_match", _FPL_KEYS + _M.format(m="(fpl_fixture_code - 7000000)") + " AND team_fpl_code <> 123", "(team_fpl_code - 100) * 1000 + mins"),
    _loaded("fact_player_match:understat", "understat_player_match", f"understat_player_id % 10 <> 0 AND {_P.format(p='understat_player_id')} AND {_M.format(m='understat_game_id')} AND understat_team_id <> 23", "understat_team_id * 1000 + mins"),
    _loaded("fact_player_match:vaastav", "vaastav_player_match", _FPL_KEYS + _M.format(m="fpl_fixture_id") + " AND opponent_fpl_code <> 123 AND season_id = (SELECT season_id FROM v_match v WHERE v.match_id = fpl_fixture_id)",
            "(SELECT CASE WHEN v.home_team_id = opponent_fpl_code - 100 THEN v.away_team_id ELSE v.home_team_id END FROM v_match v WHERE v.match_id = fpl_fixture_id) * 1000 + mins"),
    _loaded("fact_team_match:understat", "understat_team_match", _M.format(m="understat_game_id") + " AND understat_team_id <> 23", "understat_team_id * 1000 + deep"),
    _loaded("fact_team_match:espn", "espn_possession", _M.format(m="espn_event_id") + " AND team_name <> (SELECT n_name FROM nation WHERE n_nationkey = 23)", "(SELECT n_nationkey FROM nation WHERE n_name = team_name) * 1000"),
    _loaded("fact_market_value:transfermarkt", "tm_market_value", "CAST(tm_player_id AS BIGINT) % 9 <> 0 AND " + _P.format(p="CAST(tm_player_id AS BIGINT)"), "value_eur"),
    _loaded("fact_player_status:fpl", "fpl_players", _P.format(p="(fpl_code - 5000)"), "chance_of_playing"),
])


@query("load_facts", _LOAD_SQL)
def load_facts(spark, sf):
    """The scanned feeds loaded into the fact tables: rows written and left out per table and source, and a sum over the rows read back."""
    path = folder(spark, "facts")
    rows = {name: scan(spark, sf).withColumnsRenamed({"mins": "minutes"}) for name, scan in _SCANNED.items()}
    counts = PL.load_facts(spark, {**rows, "fpl_players": scan_players(spark, sf)}, load_dims(spark, sf), path)
    team = F.col("team_id") * 1000
    measures = {"fact_player_match": team + F.col("minutes"), "fact_market_value": F.col("value_eur"), "fact_player_status": F.col("chance_of_playing"),
                "fact_team_match": team + F.coalesce("deep", F.lit(0))}
    seen = None
    for table, measure in measures.items():
        part = PL.read_fact(spark, path, table).groupBy(F.concat_ws(":", F.lit(table), "source").alias("label")).agg(F.sum(measure).cast("bigint").alias("measure"))
        seen = part if seen is None else seen.unionByName(part)
    return counts.join(seen, "label", "left")
