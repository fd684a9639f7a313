"""Landed feed files derived by Spark from the test tables, in the feeds' own formats.

Each document holds a bounded number of entries: players by (nation, id range), histories
by order, scoreboards by a slice of a day, valuations by a player's year. Files are packed, as text of this
kind shrinks to a tenth, and land once per session and scale, each feed only when a query reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.operators.common import shared_dir
from touchline.workload import bindings as B

STAMP, OLD_STAMP = "20260102T030405000000Z", "20260101T000000000000Z"
OLD_SEASONS = 1997  # archive seasons that start before this year lack the optional columns
_ROOTS: dict[tuple, str] = {}
_DONE: set[tuple[str, str]] = set()
KINDS = ("GKP", "DEF", "MID", "FWD")


def landed(spark, sf, *sources) -> str:
    """Root folder with the feeds of ``sources`` (all of them by default) landed once."""
    writers = {"fpl/bootstrap-static.json": _fpl_players, "fpl/fixtures.json": _fpl_fixtures, "fpl/element-summary.json": _fpl_histories,
               "vaastav": _archive, "understat/players": _understat_players, "understat/shots": _understat_shots, "understat/games": _understat_games,
               "espn": _espn, "transfermarkt": _market, "transfermarkt_datasets": _market_archive,
               "override": _overrides, "forced": _forced, "statsbomb": _events}
    key = B.version(spark, sf)
    if key not in _ROOTS:
        _ROOTS[key] = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    root = _ROOTS[key]
    for source in sources or writers:
        if (root, source) not in _DONE:
            writers[source](spark, sf, root)
            _DONE.add((root, source))
    return root


def _json(df, path):
    df.write.option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def _csv(df, path):
    df.write.options(header="true", compression="gzip").csv(path)


def _fpl_players(spark, sf, root):
    nation = B.table(spark, sf, "nation")
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    teams = nation.select(F.array_sort(F.collect_list(F.struct(
        (F.col("n_nationkey") + 1).alias("id"), (F.col("n_nationkey") + 100).alias("code"), F.col("n_name").alias("name"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("short_name")))).alias("t")).scalar()
    types = F.array(*[F.struct(F.lit(i + 1).alias("id"), F.lit(k).alias("singular_name_short")) for i, k in enumerate(KINDS)])
    events = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(d).alias("deadline_time"), F.lit(True).alias("finished"))
                       for i, d in ((1, "2001-08-15T17:30:00Z"), (2, "2002-01-01T17:30:00Z"))])
    element = F.struct(
        (key + 1).alias("id"), (key + 5000).alias("code"), seg.alias("first_name"), F.col("c_name").alias("second_name"), F.col("c_name").alias("web_name"),
        F.when(key % 3 == 0, F.concat(seg, F.lit(" Junior"))).otherwise(F.lit("")).alias("known_name"),
        F.when(key % 4 == 0, F.lit("")).otherwise(F.date_add(F.lit("1970-01-01").cast("date"), (key % 5000).cast("int")).cast("string")).alias("birth_date"),
        (F.col("c_nationkey") + 1).alias("team"), (F.when(key % 97 == 0, F.lit(9)).otherwise(key % 4 + 1)).cast("int").alias("element_type"),
        F.lit("a").alias("status"), F.when(key % 2 == 0, F.lit("")).otherwise(F.lit("knock")).alias("news"),
        F.when(key % 5 == 0, F.lit(75)).alias("chance_of_playing_next_round"), (key % 900).cast("int").alias("minutes"))
    docs = B.table(spark, sf, "customer").groupBy("c_nationkey", F.floor(key / 500).alias("part")).agg(F.collect_list(element).alias("elements"))
    _json(docs.select(events.alias("events"), teams.alias("teams"), types.alias("element_types"), "elements"), f"{root}/fpl/{STAMP}/bootstrap-static.json")


def _fpl_fixtures(spark, sf, root):
    m = B.dim_match(spark, sf)
    iso = F.date_format("kickoff", "yyyy-MM-dd'T'15:00:00'Z'")
    fx = m.select(F.col("match_id").alias("id"), (F.col("match_id") + 7000000).alias("code"), F.when(F.col("match_id") % 6 != 0, (F.col("match_id") % 38).cast("int")).alias("event"),
                  iso.alias("kickoff_time"), (F.col("home_team_id") + 1).alias("team_h"), (F.when(F.col("match_id") % 89 == 0, F.lit(99)).otherwise(F.col("away_team_id") + 1)).alias("team_a"),
                  F.col("home_score").alias("team_h_score"), F.col("away_score").alias("team_a_score"), F.col("home_score").isNotNull().alias("finished"))
    _json(fx, f"{root}/fpl/{STAMP}/fixtures.json")
    _json(fx, f"{root}/fpl/{OLD_STAMP}/fixtures.json")


def _fpl_histories(spark, sf, root):
    m = B.dim_match(spark, sf)
    f = B.fact(spark, sf).drop("season_id", "team_id").join(m.select("match_id", "home_team_id", "away_team_id"), "match_id")
    text = [F.col(c).cast("string").alias(n) for c, n in (("xg", "expected_goals"), ("npxg", "expected_assists"), ("xgc_on_pitch", "expected_goals_conceded"))]
    home = F.col("shots") % 2 == 1
    h = F.struct((F.col("player_id") + 1).alias("element"), F.col("match_id").alias("fixture"),
                 (F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")) + 1).alias("opponent_team"), home.alias("was_home"),
                 F.lit("2001-09-01T15:00:00Z").alias("kickoff_time"), F.lit(3).alias("round"), F.col("minutes"), F.col("started").cast("int").alias("starts"),
                 F.col("goals").alias("goals_scored"), "assists", *text, "tackles", F.col("cbi").alias("clearances_blocks_interceptions"), "recoveries",
                 F.col("def_contribution").alias("defensive_contribution"), "yellow_cards", "red_cards", "saves", "goals_conceded", "penalties_saved")
    _json(f.groupBy("match_id", "player_id").agg(F.collect_list(h).alias("history")).select("history"), f"{root}/fpl/{STAMP}/element-summary.json")


def _archive(spark, sf, root):
    base = f"{root}/vaastav/{STAMP}"
    f = B.fact(spark, sf).join(B.dim_match(spark, sf).select("match_id", "home_team_id", "away_team_id", "home_score", "away_score"), "match_id")
    home = F.col("shots") % 2 == 1
    rows = f.select(
        (F.col("player_id") + 1).alias("element"), F.col("match_id").alias("fixture"),
        (F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")) + 1).alias("opponent_team"), F.when(home, F.lit("True")).otherwise(F.lit("False")).alias("was_home"),
        F.lit("2001-09-01T15:00:00Z").alias("kickoff_time"), F.lit(3).alias("round"), "minutes", F.col("started").cast("int").alias("starts"), F.col("goals").alias("goals_scored"), "assists",
        F.col("xg").alias("expected_goals"), F.col("xa").alias("expected_assists"), "tackles", "recoveries", "yellow_cards", "red_cards",
        F.col("home_score").alias("team_h_score"), F.col("away_score").alias("team_a_score"), "season_id")
    # Every tenth fixture's rows appear twice, as exact copies.
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fixture") % 10 == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    old = F.substring("season_id", 1, 4).cast("int") < OLD_SEASONS
    name = F.concat("season_id", F.lit("_merged_gw.csv")).alias("name")
    cols = [c for c in rows.columns if c != "season_id"]
    required = [c for c in cols if c not in ("starts", "expected_goals", "expected_assists", "tackles", "recoveries", "team_h_score", "team_a_score")]
    rows.filter(old).select(*required, name).write.partitionBy("name").options(header="true", compression="gzip").mode("append").csv(base)
    rows.filter(~old).select(*cols, name).write.partitionBy("name").options(header="true", compression="gzip").mode("append").csv(base)
    seasons = B.dim_season(spark, sf).agg(F.collect_set("season_id")).scalar()
    players = B.table(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("id"), (F.col("c_custkey") + 5000).alias("code"), seasons.alias("seasons"))
    teams = B.table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("id"), (F.col("n_nationkey") + 100).alias("code"), F.col("n_name").alias("name_"), seasons.alias("seasons"))
    players.withColumn("season_id", F.explode("seasons")).select("id", "code", F.concat("season_id", F.lit("_players_raw.csv")).alias("name")).write.partitionBy("name").options(header="true", compression="gzip").mode("append").csv(base)
    (teams.withColumn("season_id", F.explode("seasons")).withColumn("file", F.concat("season_id", F.lit("_teams.csv"))).select("id", "code", F.col("name_").alias("name"), "file")
     .write.partitionBy("file").options(header="true", compression="gzip").mode("append").csv(base))


SITUATIONS = ("Penalty", "From Corner", "Set Piece", "Open Play")


def _club_names(spark, sf):
    return B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team"))


def _understat_players(spark, sf, root):
    base = f"{root}/understat/{STAMP}"
    f, name = B.fact(spark, sf), _club_names(spark, sf)
    pm = (f.groupBy("match_id", "player_id", "team_id", "season_id").agg(
        F.sum("minutes").alias("minutes"), F.sum("goals").alias("goals"), F.sum("shots").alias("shots"), F.sum("xa").alias("xg"), F.sum("npxg").alias("xa"),
        F.sum("xg_chain").alias("xg_chain"), F.sum("xg_buildup").alias("xg_buildup"), F.sum("key_passes").alias("key_passes")).join(name, "team_id"))
    (pm.select(F.col("match_id").alias("game_id"), "team_id", "team", "player_id", F.concat(F.lit("P"), F.col("player_id").cast("string")).alias("player"), F.lit("MC").alias("position"), "minutes",
               "goals", "shots", "xg", "xa", "xg_chain", "xg_buildup", "key_passes", F.concat("season_id", F.lit("_player_match.csv")).alias("name"))
     .write.partitionBy("name").options(header="true", compression="gzip").mode("append").csv(base))


def _understat_shots(spark, sf, root):
    base = f"{root}/understat/{STAMP}"
    f, name = B.fact(spark, sf), _club_names(spark, sf)
    kind = F.try_element_at(F.array(*[F.lit(s) for s in SITUATIONS]), (F.col("recoveries") % 4 + 1).cast("int"))
    (f.filter("match_id % 5 != 0").join(name, "team_id").select(F.col("match_id").alias("game_id"), "player_id", "team", (F.col("npxg") / 2).alias("xg"), kind.alias("situation"),
                                                               F.concat("season_id", F.lit("_shots.csv")).alias("name"))
     .write.partitionBy("name").options(header="true", compression="gzip").mode("append").csv(base))


def _understat_games(spark, sf, root):
    base = f"{root}/understat/{STAMP}"
    m, name = B.dim_match(spark, sf), _club_names(spark, sf)
    h, a = (name.select(F.col("team_id").alias(f"{s}_team_id"), F.col("team").alias(f"{s}_team")) for s in ("home", "away"))
    mid = F.col("match_id")
    (m.join(h, "home_team_id").join(a, "away_team_id").select(
        mid.alias("game_id"), F.coalesce("kickoff", F.lit("2000-01-01").cast("date")).alias("date"), "home_team_id", "away_team_id", "home_team", "away_team",
        F.col("home_score").alias("home_goals"), F.col("away_score").alias("away_goals"), (mid % 8 / 4).alias("home_xg"), F.when(mid % 9 != 0, mid % 16 / 8).alias("away_xg"),
        (mid % 4 / 4).alias("home_np_xg"), (mid % 2 / 2).alias("away_np_xg"), (mid % 32 / 2).alias("home_ppda"), (mid % 64 / 4).alias("away_ppda"),
        (mid % 11).alias("home_deep_completions"), (mid % 13).alias("away_deep_completions"), F.concat("season_id", F.lit("_team_match.csv")).alias("name"))
     .write.partitionBy("name").options(header="true", compression="gzip").mode("append").csv(base))


def _espn(spark, sf, root):
    m = B.dim_match(spark, sf).filter(F.col("kickoff").isNotNull())
    name = _club_names(spark, sf)
    h, a = (name.select(F.col("team_id").alias(f"{s}_team_id"), F.col("team").alias(f"{s}_team")) for s in ("home", "away"))
    mid = F.col("match_id")
    share = mid % 60 + 20

    def side(which, text):
        stats = F.array(F.struct(F.lit("foulsCommitted").alias("name"), F.lit("9").alias("displayValue")), F.struct(F.lit("possessionPct").alias("name"), text.alias("displayValue")))
        return F.struct(F.lit(which).alias("homeAway"), F.struct(F.col(f"{which}_team").alias("displayName")).alias("team"), stats.alias("statistics"))

    away = F.when(mid % 50 == 0, (share + 5).cast("string")).when(mid % 7 == 0, F.lit(None).cast("string")).otherwise((100 - share).cast("string"))
    status = F.struct(F.struct((mid % 12 != 0).alias("completed")).alias("type"))
    event = F.struct(mid.cast("string").alias("id"), F.date_format("kickoff", "yyyy-MM-dd'T'15:00'Z'").alias("date"), status.alias("status"),
                     F.array(F.struct(F.array(side("home", F.concat(share.cast("string"), F.lit("%"))), side("away", away)).alias("competitors"))).alias("competitions"))
    days = F.when(mid % 20 == 0, F.array("kickoff", F.date_add("kickoff", 1))).otherwise(F.array("kickoff"))
    docs = (m.join(h, "home_team_id").join(a, "away_team_id").withColumn("event", event).withColumn("day", F.explode(days)).withColumn("day", F.date_format("day", "yyyyMMdd"))
            .groupBy("season_id", "day", F.floor(mid / 4096).alias("part")).agg(F.collect_list("event").alias("events")))
    _json(docs.select(F.col("season_id").alias("season"), F.create_map("day", F.struct("events")).alias("days")), f"{root}/espn/{STAMP}/scoreboards.json")


def _market(spark, sf, root):
    base = f"{root}/transfermarkt/{STAMP}"
    key, nk = F.col("c_custkey"), F.col("c_nationkey")
    _json(B.table(spark, sf, "nation").select(F.array(F.struct(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))).alias("results")), f"{base}/club-search.json")
    player = F.struct(key.cast("string").alias("id"), F.col("c_name").alias("name"), F.when(key % 3 == 0, F.lit("")).otherwise(F.lit("Left Winger")).alias("position"),
                      F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (key % 5000).cast("int")), "MMM d, yyyy").alias("dateOfBirth"), F.lit("30.06.2003").alias("contract"))
    _json(B.table(spark, sf, "customer").groupBy(nk, F.floor(key / 500).alias("part")).agg(F.collect_list(player).alias("players"))
          .select(F.concat(F.lit("c"), nk.cast("string")).alias("id"), "players"), f"{base}/club-players.json")
    v = B.market_values(spark, sf)
    # A document has a player's points of one year, so points of one day never stand in two; the newest day comes first, and its highest value.
    points = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("tm_last_updated").alias("d"), F.col("value_eur").alias("v")))))
    texts = F.transform(points, lambda p: F.struct(p["d"].cast("string").alias("date"), F.concat(F.lit("€"), (p["v"] / 1000).cast("bigint").cast("string"), F.lit("k")).alias("value")))
    docs = v.groupBy("player_id", F.year("tm_last_updated").alias("part")).agg(texts.alias("marketValueHistory"))
    _json(docs.select(F.col("player_id").cast("string").alias("id"), F.when(F.col("player_id") % 2 == 0, F.lit("€1.50m")).otherwise(F.lit("-")).alias("marketValue"), "marketValueHistory"), f"{base}/market-value.json")


def _market_archive(spark, sf, root):
    key, nk, v = F.col("c_custkey"), F.col("c_nationkey"), B.market_values(spark, sf)
    gz = f"{root}/transfermarkt_datasets/{STAMP}"
    _csv(B.table(spark, sf, "customer").select(
        key.alias("player_id"), F.col("c_name").alias("name"), F.lit("1990-05-01").alias("date_of_birth"), F.lit("Centre-Back").alias("sub_position"), F.lit("2004-06-30").alias("contract_expiration_date"),
        nk.alias("current_club_id"), F.concat(F.lit("NATION_"), nk.cast("string")).alias("current_club_name"), F.when(key % 3 == 0, F.lit("ES1")).otherwise(F.lit("GB1")).alias("current_club_domestic_competition_id")),
        f"{gz}/players.csv.gz")
    once = v.groupBy("player_id", "tm_last_updated").agg(F.max("value_eur").alias("market_value_in_eur"))
    _csv(once.select("player_id", F.col("tm_last_updated").alias("date"), "market_value_in_eur"), f"{gz}/player_valuations.csv.gz")


def _overrides(spark, sf, root):
    v = B.market_values(spark, sf).filter(F.col("source") == "override")
    _csv(v.select((F.concat(F.lit(" "), F.col("player_id").cast("string"))).alias("tm_player_id"), F.col("value_eur").cast("string").alias("value_eur"), F.col("tm_last_updated").cast("string").alias("tm_last_updated"),
                  F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.lit("checked")).alias("reason"), F.lit("2026-01-01").alias("date"), F.col("id").alias("row_id")), f"{root}/override/{STAMP}/market_value_overrides.csv")


def _forced(spark, sf, root):
    """Forced links of customers, some with an empty cell, every seventh named again further down."""
    key = F.col("c_custkey")
    twice = F.explode(F.when(key % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = B.table(spark, sf, "customer").filter(key % 3 == 0).select("c_custkey", twice.alias("again"))
    _csv(rows.select((key + 5000 + F.col("again")).cast("string").alias("fpl_code"), F.when(key % 2 == 0, F.lit("understat")).otherwise(F.lit(" transfermarkt ")).alias("source"),
                     F.concat(F.lit("r"), key.cast("string")).alias("source_id"), F.when(key % 11 == 0, F.lit(" ")).otherwise(F.lit("checked")).alias("reason"),
                     F.lit("2026-01-01").alias("date")).coalesce(1).sortWithinPartitions("fpl_code"), f"{root}/forced/{STAMP}/player_overrides.csv")


def _events(spark, sf, root):
    eid = F.col("event_id")
    loc = F.array((eid % 120).cast("double"), (eid % 80).cast("double"))
    kind = F.col("event_type")
    e = B.table(spark, sf, "events").select(
        eid.cast("string").alias("id"), (eid % 3000).cast("int").alias("index"), F.lit(1).alias("period"), (eid % 90).cast("int").alias("minute"), (eid % 60).cast("int").alias("second"),
        F.struct(F.lit(1).alias("id"), kind.alias("name")).alias("type"), F.struct((F.col("user_id") % 25).cast("int").alias("id"), F.lit("team").alias("name")).alias("team"),
        F.when(eid % 4 != 0, F.struct(F.col("user_id").alias("id"), F.lit("someone").alias("name"))).alias("player"), F.when(eid % 5 != 0, loc).alias("location"),
        F.when(kind == "click", F.struct(loc.alias("end_location"))).alias("pass"), F.when(kind == "view", F.struct(F.array(F.lit(1.0), F.lit(2.0)).alias("end_location"))).alias("carry"),
        F.when(kind == "purchase", F.struct((eid % 8 / 8).alias("statsbomb_xg"), F.struct(F.lit(1).alias("id"), F.lit("Goal").alias("name")).alias("outcome"))).alias("shot"),
        F.concat(F.lit("events-"), (F.col("user_id") % 20).cast("string"), F.lit(".json")).alias("name"))
    e.write.partitionBy("name").option("compression", "gzip").json(f"{root}/statsbomb/{STAMP}")
