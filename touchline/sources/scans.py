"""Scans: landed feed files to typed rows, each with ``source`` and ``fetched_at``.

JSON feeds are read with an explicit schema. A feed is either one document per file
(``multi_line``) or one document per line; a document holds a bounded list, so exploding it
never grows a task beyond its input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators.common import stage, top_per
from touchline.params import POSSESSION_TOLERANCE
from touchline.sources.snapshots import position, with_origin

# Fields of the feeds.
BOOTSTRAP = """events array<struct<id: int, deadline_time: string, finished: boolean>>,
  teams array<struct<id: int, code: int, name: string, short_name: string>>,
  element_types array<struct<id: int, singular_name_short: string>>,
  elements array<struct<id: bigint, code: bigint, first_name: string, second_name: string, web_name: string,
    known_name: string, birth_date: string, team: int, element_type: int, status: string, news: string,
    chance_of_playing_next_round: int, minutes: int>>"""
FIXTURES = """id bigint, code bigint, event int, kickoff_time string, team_h int, team_a int, team_h_score int,
  team_a_score int, finished boolean"""
SUMMARY = """history array<struct<element: bigint, fixture: bigint, opponent_team: int, was_home: boolean,
  kickoff_time: string, round: int, minutes: int, starts: int, goals_scored: int, assists: int,
  expected_goals: string, expected_assists: string, expected_goals_conceded: string, tackles: int,
  clearances_blocks_interceptions: int, recoveries: int, defensive_contribution: int, yellow_cards: int,
  red_cards: int, saves: int, goals_conceded: int, penalties_saved: int>>"""
SCOREBOARDS = """season string, days map<string, struct<events: array<struct<id: string, date: string,
  status: struct<type: struct<completed: boolean>>,
  competitions: array<struct<status: struct<type: struct<completed: boolean>>, competitors: array<struct<homeAway: string,
    team: struct<displayName: string>, statistics: array<struct<name: string, displayValue: string>>>>>>>>>>"""
CLUB_SEARCH = "results array<struct<id: string, name: string>>"
CLUB_PLAYERS = "id string, players array<struct<id: string, name: string, position: string, dateOfBirth: string, contract: string>>"
MARKET_VALUE = "id string, marketValue string, marketValueHistory array<struct<date: string, value: string>>"
EVENTS = """id string, `index` int, period int, minute int, second int, type struct<id: int, name: string>,
  team struct<id: int, name: string>, player struct<id: bigint, name: string>, position struct<id: int, name: string>,
  location array<double>, pass struct<end_location: array<double>>, carry struct<end_location: array<double>>,
  shot struct<statsbomb_xg: double, outcome: struct<id: int, name: string>>"""
# Archive column -> table column; a column an old season lacks is NULL.
ARCHIVE_STATS = {"expected_goals": "xg", "expected_assists": "xa", "expected_goals_conceded": "xgc_on_pitch",
                 "tackles": "tackles", "clearances_blocks_interceptions": "cbi", "recoveries": "recoveries",
                 "defensive_contribution": "def_contribution", "saves": "saves", "goals_conceded": "goals_conceded",
                 "penalties_saved": "penalties_saved"}
ARCHIVE_REQUIRED = ("element", "fixture", "opponent_team", "was_home", "kickoff_time", "round", "minutes",
                    "goals_scored", "assists", "yellow_cards", "red_cards")
SET_PIECES = ("From Corner", "Set Piece", "Direct Freekick")
PENALTY, OPEN_PLAY = "Penalty", "Open Play"


class SchemaChanged(Exception):
    """A feed lacks a required column."""


def read_json(spark: SparkSession, path: str, schema: str, source: str, multi_line: bool = True) -> DataFrame:
    return with_origin(spark.read.schema(schema).option("multiLine", multi_line).json(path), source)


def read_csv(spark: SparkSession, path: str, required: Sequence[str], source: str) -> DataFrame:
    """CSV rows as strings; an empty cell is NULL; required columns must be in the header."""
    df = spark.read.option("header", True).csv(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise SchemaChanged(f"{path}: missing columns {missing}")
    return with_origin(df, source)


def _looked_up(players: DataFrame) -> DataFrame:
    """A feed's players as a lookup table, written once.

    A packed text file is a small part of the rows in it, and Spark would send all players of a season through the driver
    for it; the size of the written table is that of its rows.
    """
    return stage(players, "scan-lookup")


def _instant(c) -> Column:
    """An ISO instant as a plain UTC timestamp."""
    return F.to_timestamp_ntz(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "(Z|\\.\\d+Z?)$", ""))


def _season_of(deadlines: Column) -> Column:
    return S.season_label(F.substring(F.array_min(F.transform(deadlines, lambda e: e["deadline_time"])), 1, 4))


def scan_teams(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    boot = read_json(spark, path, BOOTSTRAP, "fpl", multi_line)
    rows = boot.select(F.explode("teams").alias("t"), _season_of(F.col("events")).alias("season_id"), "source", "fetched_at")
    return rows.select(F.col("t.id").alias("fpl_team_id"), F.col("t.code").alias("fpl_code"), "t.name", "t.short_name",
                       "season_id", "source", "fetched_at").distinct()


def scan_players(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(players, rejects): a player whose club or position is not listed is rejected."""
    boot = read_json(spark, path, BOOTSTRAP, "fpl", multi_line)
    teams = F.map_from_entries(F.transform("teams", lambda t: F.struct(t["id"], t["code"])))
    kinds = F.map_from_entries(F.transform("element_types", lambda t: F.struct(t["id"], t["singular_name_short"])))
    rows = boot.select(F.explode("elements").alias("e"), teams.alias("teams"), kinds.alias("kinds"),
                       _season_of(F.col("events")).alias("season_id"), "source", "fetched_at")
    out = rows.select(
        F.col("e.code").alias("fpl_code"), F.col("e.id").alias("fpl_element_id"), "e.first_name", "e.second_name", "e.web_name",
        F.nullif("e.known_name", F.lit("")).alias("known_name"), F.to_date(F.nullif("e.birth_date", F.lit(""))).alias("birth_date"),
        F.try_element_at("teams", F.col("e.team")).alias("team_fpl_code"),
        F.try_element_at("kinds", F.col("e.element_type")).alias("fpl_position"), F.col("e.status").alias("fpl_status"),
        F.nullif("e.news", F.lit("")).alias("news"), F.col("e.chance_of_playing_next_round").alias("chance_of_playing"),
        "season_id", "source", "fetched_at")
    known = F.col("team_fpl_code").isNotNull() & F.col("fpl_position").isNotNull()
    return out.filter(known), out.filter(~known)


def scan_fixtures(spark: SparkSession, path: str, teams: DataFrame, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fixtures, rejects) with the clubs' stable codes; unplayed scores stay NULL."""
    rows = read_json(spark, path, FIXTURES, "fpl", multi_line)

    def side(name: str) -> DataFrame:
        return teams.select(F.col("fpl_team_id").alias(f"team_{name[0]}"), F.col("fpl_code").alias(f"{name}_team_fpl_code"),
                            *(["season_id"] if name == "home" else []))

    out = rows.join(side("home"), "team_h", "left").join(side("away"), "team_a", "left").select(
        F.col("code").alias("fpl_fixture_code"), F.col("id").alias("fpl_fixture_id"), "season_id", F.col("event").alias("gameweek"),
        _instant("kickoff_time").alias("kickoff"), "home_team_fpl_code", "away_team_fpl_code",
        F.col("team_h_score").alias("home_score"), F.col("team_a_score").alias("away_score"), "finished", "source", "fetched_at")
    known = F.col("home_team_fpl_code").isNotNull() & F.col("away_team_fpl_code").isNotNull()
    return out.filter(known), out.filter(~known)


def scan_player_match(spark: SparkSession, path: str, players: DataFrame, fixtures: DataFrame, teams: DataFrame,
                      multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(player-match rows, rejects): the club of a match is the side the player was on."""
    h = (read_json(spark, path, SUMMARY, "fpl", multi_line)
         .select(F.explode("history").alias("h"), "source", "fetched_at").select("h.*", "source", "fetched_at"))
    who = _looked_up(players.select(F.col("fpl_element_id").alias("element"), "fpl_code"))
    fx = fixtures.select(F.col("fpl_fixture_id").alias("fixture"), "fpl_fixture_code", "season_id", "home_team_fpl_code", "away_team_fpl_code")
    opp = teams.select(F.col("fpl_team_id").alias("opponent_team"), F.col("fpl_code").alias("opponent_fpl_code"))
    rows = h.join(who, "element", "left").join(fx, "fixture", "left").join(opp, "opponent_team", "left")
    out = rows.select(
        "fpl_code", "fpl_fixture_code", "season_id", F.col("round").alias("gameweek"), _instant("kickoff_time").alias("kickoff"),
        F.when(F.col("was_home"), F.col("home_team_fpl_code")).otherwise(F.col("away_team_fpl_code")).alias("team_fpl_code"),
        "opponent_fpl_code", "was_home", "minutes", (F.col("starts") > 0).alias("started"), F.col("goals_scored").alias("goals"), "assists",
        F.col("expected_goals").cast("double").alias("xg"), F.col("expected_assists").cast("double").alias("xa"),
        F.col("expected_goals_conceded").cast("double").alias("xgc_on_pitch"), "tackles",
        F.col("clearances_blocks_interceptions").alias("cbi"), "recoveries", F.col("defensive_contribution").alias("def_contribution"),
        "yellow_cards", "red_cards", "saves", "goals_conceded", "penalties_saved", "source", "fetched_at")
    known = F.col("fpl_code").isNotNull() & F.col("fpl_fixture_code").isNotNull() & F.col("opponent_fpl_code").isNotNull()
    return out.filter(known), out.filter(~known)


def scan_archive_seasons(spark: SparkSession, root: str, seasons: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of past seasons from three CSVs each.

    Exact copies are dropped, conflicting rows stay. A row whose player or opponent the season does not
    list is rejected; a season without its files is an error.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_archive_season(spark, root, s) for s in seasons])
    known = F.col("fpl_code").isNotNull() & F.col("opponent_fpl_code").isNotNull()
    return rows.filter(known).drop("element_id", "team_id"), rows.filter(~known)


def _archive_season(spark: SparkSession, root: str, season: str) -> DataFrame:
    gw = read_csv(spark, f"{root}/*{season}_merged_gw.csv", ARCHIVE_REQUIRED, "vaastav").drop("__path", "__position").dropDuplicates()
    players = read_csv(spark, f"{root}/*{season}_players_raw.csv", ("id", "code"), "vaastav")
    teams = read_csv(spark, f"{root}/*{season}_teams.csv", ("id", "code", "name"), "vaastav")
    club_at_end = F.col("team_code").cast("int") if "team_code" in players.columns else F.lit(None).cast("int")
    who = _looked_up(players.select(F.col("id").cast("bigint").alias("element_id"), F.col("code").cast("bigint").alias("fpl_code"),
                                    club_at_end.alias("team_fpl_code_end_of_season")))
    club = teams.select(F.col("id").cast("int").alias("team_id"), F.col("code").cast("int").alias("opponent_fpl_code"),
                        F.col("name").alias("opponent_name"))
    rows = (gw.withColumn("element_id", F.col("element").cast("bigint")).withColumn("team_id", F.col("opponent_team").cast("int"))
            .join(who, "element_id", "left").join(club, "team_id", "left"))

    def number(column: str, kind: str = "double") -> Column:
        return F.col(column).cast("double").cast(kind) if column in gw.columns else F.lit(None).cast(kind)

    return rows.select(
        "fpl_code", F.lit(season).alias("season_id"), F.col("fixture").cast("bigint").alias("fpl_fixture_id"),
        F.col("round").cast("int").alias("gameweek"), _instant("kickoff_time").alias("kickoff"), "opponent_fpl_code", "opponent_name",
        S.strict(S.clean_bool("was_home"), "was_home", "was_home flag").alias("was_home"), F.col("minutes").cast("int").alias("minutes"),
        (number("starts") > 0).alias("started"), F.col("goals_scored").cast("int").alias("goals"), F.col("assists").cast("int").alias("assists"),
        F.col("yellow_cards").cast("int").alias("yellow_cards"), F.col("red_cards").cast("int").alias("red_cards"),
        *[number(a).alias(b) for a, b in ARCHIVE_STATS.items()],
        number("team_h_score", "int").alias("home_score"), number("team_a_score", "int").alias("away_score"),
        "team_fpl_code_end_of_season", "element_id", "team_id", "source", "fetched_at")


def _season_from_path() -> Column:
    return F.regexp_extract("__path", r"(\d{4}-\d{2})_[a-z_]+\.csv", 1)


def scan_player_shots(spark: SparkSession, players_path: str, shots_path: str) -> DataFrame:
    """Player-match rows with penalty-free xG; unknown xG gives unknown npxG."""
    p = read_csv(spark, players_path, ("game_id", "team_id", "player_id", "minutes", "xg"), "understat")
    shots = read_csv(spark, shots_path, ("game_id", "player_id", "team", "xg", "situation"), "understat")
    pens = (shots.filter(F.col("situation") == PENALTY).groupBy("game_id", "player_id")
            .agg(F.sum(F.col("xg").cast("double")).alias("pen_xg")))
    xg = F.col("xg").cast("double")
    npxg = F.when(xg.isNotNull(), F.greatest(F.lit(0.0), xg - F.coalesce("pen_xg", F.lit(0.0))))
    ints, doubles = ("minutes", "goals", "shots", "key_passes", "assists", "yellow_cards", "red_cards"), ("xa", "xg_chain", "xg_buildup")
    have = set(p.columns)
    return p.join(pens, ["game_id", "player_id"], "left").select(
        F.col("player_id").cast("bigint").alias("understat_player_id"), F.col("game_id").cast("bigint").alias("understat_game_id"),
        F.col("team_id").cast("bigint").alias("understat_team_id"), F.col("player").alias("player_name"), F.col("team").alias("team_name"),
        _season_from_path().alias("season_id"), F.col("position") if "position" in have else F.lit(None).cast("string").alias("position"),
        xg.alias("xg"), npxg.alias("npxg"), *[F.col(c).cast("double").alias(c) for c in doubles],
        *[(F.col(c).cast("double").cast("int") if c in have else F.lit(None).cast("int")).alias(c) for c in ints], "source", "fetched_at")


def scan_team_match_unpivot(spark: SparkSession, games_path: str, shots_path: str) -> DataFrame:
    """Two rows per game, one per side, with opponent values as "against" columns.

    Shot sums are NULL for a game without shot events and 0 for a game with shots but none
    of that kind.
    """
    games = read_csv(spark, games_path, ("game_id", "date", "home_team_id", "away_team_id"), "understat")
    shots = read_csv(spark, shots_path, ("game_id", "player_id", "team", "xg", "situation"), "understat")
    xg, kind = F.col("xg").cast("double"), F.col("situation")
    # Shots are dealt by game once; a game's few clubs then lie side by side, and the game meets them in one join.
    by_team = shots.repartition("game_id").groupBy("game_id", "team").agg(
        F.sum(F.when(kind.isin(*SET_PIECES), xg).otherwise(0.0)).alias("sp"), F.sum(F.when(kind == OPEN_PLAY, xg).otherwise(0.0)).alias("op"))
    club = F.when(F.col("team").isNotNull(), F.struct("team", F.struct("sp", "op").alias("sums")))
    by_game = by_team.groupBy("game_id").agg(F.map_from_entries(F.collect_list(club)).alias("clubs"))

    def side(a: str, b: str) -> Column:
        pairs = {"xg": "xg", "npxg": "np_xg", "ppda": "ppda", "deep": "deep_completions"}
        stats = [x for name, col in pairs.items() for x in (
            F.col(f"{a}_{col}").cast("double").alias(name), F.col(f"{b}_{col}").cast("double").alias(
                f"{name}_allowed" if name in ("ppda", "deep") else f"{name}a"))]
        return F.struct(
            F.col(f"{a}_team_id").cast("bigint").alias("understat_team_id"), F.col(f"{b}_team_id").cast("bigint").alias("understat_opponent_id"),
            F.col(f"{a}_team").alias("team_name"), F.col(f"{b}_team").alias("opponent_name"), F.lit(a == "home").alias("is_home"),
            F.col(f"{a}_goals").cast("double").cast("int").alias("goals"), F.col(f"{b}_goals").cast("double").cast("int").alias("goals_against"), *stats)

    rows = games.join(by_game, "game_id", "left").select(
        F.col("game_id").cast("bigint").alias("understat_game_id"), _season_from_path().alias("season_id"), F.to_date("date").alias("date"), "source", "fetched_at",
        "clubs", F.inline(F.array(side("home", "away"), side("away", "home"))))
    own, opp = (F.try_element_at("clubs", F.col(c)) for c in ("team_name", "opponent_name"))
    split = {"set_piece_xg": own["sp"], "set_piece_xga": opp["sp"], "open_play_xga": opp["op"]}
    return rows.withColumns({n: F.when(F.col("clubs").isNotNull(), F.coalesce(c, F.lit(0.0))) for n, c in split.items()}).drop("clubs")


def scan_possession(spark: SparkSession, path: str, tolerance: float = POSSESSION_TOLERANCE,
                    multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(two rows per completed event, events whose shares do not add up to 1).

    An event listed on several days counts once, on its first day.
    """
    docs = read_json(spark, path, SCOREBOARDS, "espn", multi_line)
    events = (docs.select("season", "source", "fetched_at", F.explode("days").alias("day", "response"))
              .select("season", "day", "source", "fetched_at", F.explode("response.events").alias("e")))
    done = F.coalesce(F.col("e.status.type.completed"), F.col("e.competitions")[0]["status"]["type"]["completed"])
    events = events.filter(done).withColumn("event_id", F.col("e.id").cast("bigint"))
    first = top_per(events, ["event_id"], [F.asc("day"), F.desc("fetched_at")])

    def side(name: str) -> Column:
        team = F.filter(F.col("e.competitions")[0]["competitors"], lambda c: c["homeAway"] == name)[0]
        stat = F.try_element_at(F.filter(team["statistics"], lambda s: s["name"] == "possessionPct"), F.lit(1))
        return F.struct(team["team"]["displayName"].alias("name"), S.strict(S.clean_share(stat["displayValue"]), stat["displayValue"], "possession share").alias("share"))

    rows = first.withColumn("home", side("home")).withColumn("away", side("away"))
    bad = F.coalesce(F.abs(F.col("home.share") + F.col("away.share") - 1.0) > tolerance, F.lit(False))

    def half(a: str, b: str) -> Column:
        return F.struct(F.col(f"{a}.name").alias("team_name"), F.col(f"{b}.name").alias("opponent_name"), F.lit(a == "home").alias("is_home"),
                        F.col(f"{a}.share").alias("possession_share"), F.col(f"{b}.share").alias("opp_possession_share"))

    kickoff = _instant("e.date")
    good = rows.filter(~bad).select(
        F.col("season").alias("season_id"), F.col("event_id").alias("espn_event_id"), F.to_date(kickoff).alias("date"), kickoff.alias("kickoff"),
        "source", "fetched_at", F.inline(F.array(half("home", "away"), half("away", "home"))))
    return good, rows.filter(bad).select(F.col("event_id").alias("espn_event_id"), (F.col("home.share") + F.col("away.share")).alias("total"))


def scan_market_live(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """Squad players with their current value; its as-of is the newest history date.

    Where that date has several points, one with a known value goes before one without; then the place in the
    document's list counts, then the document's place (first wins).
    """
    clubs = (read_json(spark, f"{root}/*club-search*", CLUB_SEARCH, "transfermarkt", multi_line)
             .select(F.explode("results").alias("r")).groupBy(F.col("r.id").alias("tm_club_id")).agg(F.min("r.name").alias("tm_club_name")))
    squads = (read_json(spark, f"{root}/*club-players*", CLUB_PLAYERS, "transfermarkt", multi_line)
              .select(F.col("id").alias("tm_club_id"), F.explode("players").alias("p"), F.col("fetched_at").alias("squad_at")))
    docs = read_json(spark, f"{root}/*market-value*", MARKET_VALUE, "transfermarkt", multi_line)
    points = docs.select("id", "__position", F.posexplode("marketValueHistory").alias("nth", "h")).select(
        "id", "nth", "__position", S.strict(S.clean_multi_date("h.date"), "h.date", "valuation date").alias("d"), S.strict(S.clean_money("h.value"), "h.value", "valuation").alias("v")).filter("d is not null")
    newest = points.groupBy("id").agg(F.max("d").alias("last_date"), F.min_by(F.struct("v"), F.struct(-F.unix_date("d"), F.col("v").isNull(), "nth", "__position")).alias("last"))
    now = docs.groupBy("id").agg(F.max(S.strict(S.clean_money("marketValue"), "marketValue", "market value")).alias("current"), F.max("fetched_at").alias("value_at"))
    rows = (squads.join(clubs, "tm_club_id", "left").join(now, F.col("p.id") == now["id"], "left").drop("id")
            .join(newest, F.col("p.id") == newest["id"], "left").drop("id"))
    return rows.select(
        F.col("p.id").alias("tm_player_id"), "tm_club_id", "tm_club_name", "p.name", F.nullif("p.position", F.lit("")).alias("tm_position"),
        S.strict(S.clean_multi_date("p.dateOfBirth"), "p.dateOfBirth", "birth date").alias("birth_date"), S.strict(S.clean_multi_date("p.contract"), "p.contract", "contract date").alias("contract_expiry"),
        F.when(F.col("last_date").isNotNull(), F.coalesce("current", "last.v")).alias("value_eur"), F.col("last_date").alias("tm_last_updated"),
        F.lit(False).alias("is_stale"), F.lit("transfermarkt").alias("source"), F.coalesce("value_at", "squad_at").alias("fetched_at"))


def _valuations(spark: SparkSession, path: str) -> DataFrame:
    v = read_csv(spark, path, ("player_id", "date", "market_value_in_eur"), "transfermarkt_datasets")
    return v.select(F.col("player_id").alias("tm_player_id"), S.strict(S.clean_multi_date("date"), "date", "date").alias("tm_last_updated"),
                    S.strict(S.clean_money("market_value_in_eur"), "market_value_in_eur", "valuation").alias("value_eur"), "source", "fetched_at",
                    F.col("__position").alias("place"))


def scan_market_latest(spark: SparkSession, players_path: str, valuations_path: str, competition: str) -> DataFrame:
    """Players of one competition with their latest valuation (first row wins on a tie)."""
    p = read_csv(spark, players_path, ("player_id", "name", "current_club_id", "current_club_domestic_competition_id"), "transfermarkt_datasets")
    latest = top_per(_valuations(spark, valuations_path).filter("tm_last_updated is not null"), ["tm_player_id"],
                     [F.desc("tm_last_updated"), F.asc("place")]).select(
                         "tm_player_id", "tm_last_updated", "value_eur", F.col("fetched_at").alias("valued_at"))
    mine = p.filter(F.col("current_club_domestic_competition_id") == competition)
    return mine.withColumn("tm_player_id", F.col("player_id")).join(latest, "tm_player_id", "left").select(
        "tm_player_id", F.col("current_club_id").alias("tm_club_id"), F.col("current_club_name").alias("tm_club_name"), "name",
        F.col("sub_position").alias("tm_position"), S.strict(S.clean_multi_date("date_of_birth"), "date_of_birth", "birth date").alias("birth_date"),
        S.strict(S.clean_multi_date("contract_expiration_date"), "contract_expiration_date", "contract date").alias("contract_expiry"), "value_eur", "tm_last_updated",
        F.lit(True).alias("is_stale"), "source", F.coalesce("valued_at", "fetched_at").alias("fetched_at"))


def scan_market_history(spark: SparkSession, players_path: str, valuations_path: str, competition: str) -> DataFrame:
    """Every valuation of the competition's players; a repeated date keeps its last row."""
    p = read_csv(spark, players_path, ("player_id", "current_club_domestic_competition_id"), "transfermarkt_datasets")
    wanted = p.filter(F.col("current_club_domestic_competition_id") == competition).select(F.col("player_id").alias("tm_player_id")).distinct()
    known = _valuations(spark, valuations_path).filter("tm_last_updated is not null and value_eur is not null")
    rows = known.join(wanted, "tm_player_id", "left_semi")
    return top_per(rows, ["tm_player_id", "tm_last_updated"], [F.desc("place")]).select(
        "tm_player_id", "value_eur", "tm_last_updated", F.lit(True).alias("is_stale"), "source", "fetched_at")


OVERRIDE_COLUMNS = ("tm_player_id", "value_eur", "tm_last_updated", "reason", "date")


def scan_overrides(spark: SparkSession, path: str, required: Sequence[str] = OVERRIDE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(complete rows as text, rejects with the names of their empty columns)."""
    rows = read_csv(spark, path, required, "override")
    trimmed = rows.withColumns({c: F.trim(F.col(c)) for c in required})
    blank = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in required]))
    checked = trimmed.withColumn("empty_columns", blank)
    good = checked.filter(F.size("empty_columns") == 0).select(*required, "source")
    return good, checked.filter(F.size("empty_columns") > 0).select(*required, "empty_columns")


PLAYER_OVERRIDE_COLUMNS = ("fpl_code", "source", "source_id", "reason", "date")


def scan_player_overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(forced links ``source, source_id, code``, rejects with the names of their empty columns).

    Every cell is needed; a record that is named again is linked as its last row says.
    """
    df = spark.read.option("header", True).csv(path)
    if missing := sorted(set(PLAYER_OVERRIDE_COLUMNS) - set(df.columns)):
        raise SchemaChanged(f"{path}: missing columns {missing}")
    # The file has a column "source" of its own: the feed that the forced record is from.
    rows = df.select(*[F.trim(df[c]).alias(c) for c in PLAYER_OVERRIDE_COLUMNS], position())
    blank = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in PLAYER_OVERRIDE_COLUMNS]))
    checked = rows.withColumn("empty_columns", blank)
    last = checked.filter(F.size("empty_columns") == 0).groupBy("source", "source_id").agg(F.max_by("fpl_code", "__position").alias("text"))
    code = F.col("text").try_cast("bigint")
    good = last.select("source", "source_id", S.strict(F.struct(code.isNull().alias("bad"), code.alias("value")), "text", "player code").alias("code"))
    return good, checked.filter(F.size("empty_columns") > 0).select(*PLAYER_OVERRIDE_COLUMNS, "empty_columns")


def market_overrides(good: DataFrame) -> DataFrame:
    """Override rows as market values; the entry date is their fetch time."""
    return good.select("tm_player_id", S.strict(S.clean_money("value_eur"), "value_eur", "override value").alias("value_eur"),
                       S.strict(S.clean_multi_date("tm_last_updated"), "tm_last_updated", "override date").alias("tm_last_updated"), "reason", F.lit(False).alias("is_stale"),
                       "source", S.strict(S.clean_multi_date("date"), "date", "date").alias("fetched_at"))


def scan_events_flatten(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One flat row per match event; the match id is in the file name."""
    e = read_json(spark, path, EVENTS, "statsbomb", multi_line)
    end = F.coalesce("pass.end_location", "carry.end_location")
    return e.select(
        F.regexp_extract("__path", r"events-(\d+)\.json", 1).cast("bigint").alias("match_id"), F.col("id").alias("event_id"), "index", "period",
        "minute", "second", F.col("type.name").alias("type"), F.col("team.id").alias("team_id"), F.col("team.name").alias("team"),
        F.col("player.id").alias("player_id"), F.col("player.name").alias("player"), F.col("position.name").alias("position"),
        F.try_element_at("location", F.lit(1)).alias("x"), F.try_element_at("location", F.lit(2)).alias("y"),
        F.try_element_at(end, F.lit(1)).alias("end_x"), F.try_element_at(end, F.lit(2)).alias("end_y"),
        F.col("shot.statsbomb_xg").alias("shot_xg"), F.col("shot.outcome.name").alias("outcome"), "source", "fetched_at")
