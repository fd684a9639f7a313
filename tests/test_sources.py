from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from touchline.operators import quality as Q
from touchline.sources import scans as SC
from touchline.sources import sinks as SK
from touchline.sources import snapshots as SN

STAMP = "20260102T030405000000Z"


@pytest.fixture
def land(tmp_path):
    def write(source, name, payload, stamp=STAMP):
        folder = tmp_path / source / stamp
        folder.mkdir(parents=True, exist_ok=True)
        data = payload if isinstance(payload, bytes) else (payload if isinstance(payload, str) else json.dumps(payload)).encode()
        (folder / name).write_bytes(data)
        return str(folder / name)
    write.root = str(tmp_path)
    return write


BOOT = {
    "events": [{"id": 2, "deadline_time": "2026-08-22T11:00:00Z", "finished": False}, {"id": 1, "deadline_time": "2026-08-15T11:00:00Z", "finished": True}],
    "teams": [{"id": 1, "code": 31, "name": "Harbour", "short_name": "HAR"}, {"id": 2, "code": 32, "name": "Meadow", "short_name": "MEA"}],
    "element_types": [{"id": 1, "singular_name_short": "GKP"}],
    "elements": [{"id": 11, "code": 900, "first_name": "A", "second_name": "B", "web_name": "B", "known_name": "", "birth_date": "", "team": 1, "element_type": 1,
                  "status": "a", "news": "", "chance_of_playing_next_round": None, "minutes": 90},
                 {"id": 12, "code": 901, "first_name": "C", "second_name": "D", "web_name": "D", "team": 7, "element_type": 1, "status": "a", "news": "x",
                  "chance_of_playing_next_round": 50, "minutes": 0}],
}


def test_primary_feed(spark, land):
    boot = land("fpl", "bootstrap-static.json", BOOT)
    teams = SC.scan_teams(spark, boot)
    assert {(r["fpl_code"], r["season_id"]) for r in teams.collect()} == {(31, "2026-27"), (32, "2026-27")}
    players, bad = SC.scan_players(spark, boot)
    row = players.first()
    assert (row["fpl_code"], row["known_name"], row["birth_date"], row["news"], row["fetched_at"]) == (900, None, None, None, dt.datetime(2026, 1, 2, 3, 4, 5))
    assert [r["fpl_code"] for r in bad.collect()] == [901]
    fx = land("fpl", "fixtures.json", [{"id": 5, "code": 700, "event": None, "kickoff_time": None, "team_h": 1, "team_a": 2, "team_h_score": None, "team_a_score": None, "finished": False},
                                       {"id": 6, "code": 701, "event": 1, "kickoff_time": "2026-08-15T14:00:00Z", "team_h": 2, "team_a": 9, "finished": True}])
    good, rejects = SC.scan_fixtures(spark, fx, teams)
    assert good.first()["home_score"] is None and [r["fpl_fixture_code"] for r in rejects.collect()] == [701]
    stats = {k: 0 for k in ("round", "goals_scored", "assists", "tackles", "clearances_blocks_interceptions", "recoveries", "defensive_contribution",
                            "yellow_cards", "red_cards", "saves", "goals_conceded", "penalties_saved")}
    hist = [{"element": 11, "fixture": 5, "opponent_team": 1, "was_home": False, "kickoff_time": "2026-08-15T14:00:00Z", "minutes": 90, "starts": 1,
             "expected_goals": "0.25", "expected_assists": "0.10", "expected_goals_conceded": "1.50", **stats}]
    path = land("fpl", "element-summary-11.json", {"history": hist})
    rows, _ = SC.scan_player_match(spark, path, players, good, teams)
    r = rows.first()
    assert (r["team_fpl_code"], r["opponent_fpl_code"], r["started"], r["xg"]) == (32, 31, True, 0.25)


def test_archive_drops_copies_and_keeps_conflicts(spark, land):
    head = "element,fixture,opponent_team,was_home,kickoff_time,round,minutes,goals_scored,assists,yellow_cards,red_cards"
    line = "1,9,2,True,2025-08-16T14:00:00Z,1,90,1,0,0,0"
    land("vaastav", "2025-26_merged_gw.csv", f"{head},tackles\n{line},3\n{line},3\n{line},4\n")
    land("vaastav", "2023-24_merged_gw.csv", f"{head}\n{line}\n")
    for s in ("2025-26", "2023-24"):
        land("vaastav", f"{s}_players_raw.csv", "id,code\n1,900\n")
        land("vaastav", f"{s}_teams.csv", "id,code,name\n2,32,Meadow\n")
    files = SN.list_files(spark, land.root)
    seasons = [r["season_id"] for r in SN.seasons_present(files).orderBy("place").collect()]
    assert seasons == ["2025-26", "2023-24"]
    rows, rejects = SC.scan_archive_seasons(spark, f"{land.root}/vaastav/{STAMP}", seasons)
    assert rejects.count() == 0
    assert sorted((r["season_id"], r["tackles"]) for r in rows.collect() if r["tackles"] is not None) == [("2025-26", 3.0), ("2025-26", 4.0)]
    assert rows.filter("season_id = '2023-24'").first()["tackles"] is None
    land("vaastav", "2022-23_merged_gw.csv", f"{head}\n{line}\n5{line[1:]}\n1,9,8{line[5:]}\n")
    land("vaastav", "2022-23_players_raw.csv", "id,code,team_code\n1,900,77\n")
    land("vaastav", "2022-23_teams.csv", "id,code,name\n2,32,Meadow\n")
    rows, rejects = SC.scan_archive_seasons(spark, f"{land.root}/vaastav/{STAMP}", ["2022-23"])
    assert [(r["fpl_code"], r["team_fpl_code_end_of_season"]) for r in rows.collect()] == [(900, 77)]
    assert sorted((r["element_id"], r["team_id"]) for r in rejects.collect()) == [(1, 8), (5, 2)]
    land("vaastav", "2020-21_merged_gw.csv", "element\n1\n")
    with pytest.raises(SC.SchemaChanged):
        SC.scan_archive_seasons(spark, f"{land.root}/vaastav/{STAMP}", ["2020-21"])


def test_shots_and_team_rows(spark, land):
    land("understat", "2025-26_shots.csv", "game_id,player_id,team,xg,situation\n1,7,Harbour,0.76,Penalty\n1,7,Harbour,0.20,From Corner\n")
    pm = land("understat", "2025-26_player_match.csv", "game_id,team_id,team,player_id,player,position,minutes,goals,shots,xg,xa,xg_chain,xg_buildup,key_passes\n"
              "1,1,Harbour,7,P,FW,90,1,2,0.96,0.1,1.0,0.2,1\n1,1,Harbour,8,Q,MC,90,0,0,,0.1,1.0,0.2,1\n")
    rows = {r["understat_player_id"]: r for r in SC.scan_player_shots(spark, pm, pm.replace("player_match", "shots")).collect()}
    assert rows[7]["npxg"] == pytest.approx(0.2) and rows[8]["npxg"] is None and rows[7]["season_id"] == "2025-26"
    tm = land("understat", "2025-26_team_match.csv", "game_id,date,home_team_id,away_team_id,home_team,away_team,home_goals,away_goals,home_xg,away_xg,home_np_xg,away_np_xg,"
              "home_ppda,away_ppda,home_deep_completions,away_deep_completions\n1,2025-08-16,1,2,Harbour,Meadow,1,0,0.9,,0.2,0.1,9,11,5,\n2,2025-08-17,2,1,Meadow,Harbour,0,0,1,1,1,1,8,8,1,1\n")
    out = {(r["understat_game_id"], r["is_home"]): r for r in SC.scan_team_match_unpivot(spark, tm, tm.replace("team_match", "shots")).collect()}
    assert len(out) == 4
    assert out[1, True]["set_piece_xg"] == pytest.approx(0.2) and out[1, False]["set_piece_xg"] == 0.0 and out[1, False]["open_play_xga"] == 0.0
    assert out[2, True]["set_piece_xg"] is None and out[1, True]["xga"] is None and out[1, False]["ppda_allowed"] == 9.0


def _event(i, share_h, share_a, done=True):
    def side(which, name, share):
        stats = [] if share is None else [{"name": "possessionPct", "displayValue": share}]
        return {"homeAway": which, "team": {"displayName": name}, "statistics": stats}
    return {"id": str(i), "date": "2025-08-16T14:00Z", "status": {"type": {"completed": done}},
            "competitions": [{"competitors": [side("home", "Harbour", share_h), side("away", "Meadow", share_a)]}]}


def test_possession(spark, land):
    days = {"20250817": {"events": [_event(1, "10", "90")]}, "20250816": {"events": [_event(1, "43.4%", "56.6%"), _event(2, "50", "50", False), _event(3, "70", "50"), _event(4, "60", None)]}}
    path = land("espn", "2025-26_scoreboards.json", {"season": "2025-26", "calendar": [], "days": days})
    good, bad = SC.scan_possession(spark, path)
    rows = {(r["espn_event_id"], r["is_home"]): r["possession_share"] for r in good.collect()}
    assert rows == {(1, True): pytest.approx(0.434), (1, False): pytest.approx(0.566), (4, True): pytest.approx(0.6), (4, False): None}
    assert [r["espn_event_id"] for r in bad.collect()] == [3]


def test_market_feeds(spark, land):
    land("transfermarkt", "club-search-harbour.json", {"results": [{"id": "c1", "name": "Harbour"}]})
    land("transfermarkt", "club-players-c1.json", {"id": "c1", "players": [{"id": str(i), "name": f"P{i}", "position": "", "dateOfBirth": "Jun 10, 2000", "contract": "30.06.2028"} for i in (1, 2, 3)]})
    land("transfermarkt", "market-value-1.json", {"id": "1", "marketValue": "-", "marketValueHistory": [{"date": "2026-01-01", "value": "€5.00m"}, {"date": "2025-01-01", "value": "€9.00m"}]})
    land("transfermarkt", "market-value-2.json", {"id": "2", "marketValue": "€7.00m", "marketValueHistory": []})
    rows = {r["tm_player_id"]: (r["value_eur"], r["tm_last_updated"]) for r in SC.scan_market_live(spark, f"{land.root}/transfermarkt/{STAMP}").collect()}
    assert rows == {"1": (5_000_000, dt.date(2026, 1, 1)), "2": (None, None), "3": (None, None)}
    players = land("transfermarkt_datasets", "players.csv.gz", gzip.compress(
        b"player_id,name,date_of_birth,sub_position,contract_expiration_date,current_club_id,current_club_name,current_club_domestic_competition_id\n1,A,1999-01-01,,2027-06-30,5,Harbour,GB1\n2,B,,,,6,Else,ES1\n"))
    values = land("transfermarkt_datasets", "player_valuations.csv.gz", gzip.compress(
        b"player_id,date,market_value_in_eur\n1,2025-06-01,100\n1,2025-06-01,200\n1,2024-06-01,50\n1,,70\n2,2025-06-01,9\n"))
    latest = SC.scan_market_latest(spark, players, values, "GB1").collect()
    assert [(r["tm_player_id"], r["value_eur"]) for r in latest] == [("1", 100)]
    hist = {(r["tm_last_updated"], r["value_eur"]) for r in SC.scan_market_history(spark, players, values, "GB1").collect()}
    assert hist == {(dt.date(2025, 6, 1), 200), (dt.date(2024, 6, 1), 50)}


def _history(*points):
    return [{"date": d, "value": v} for d, v in points]


def test_ties_across_documents_and_files(spark, land):
    """First wins for the live value, a known one before an unknown; the files' order counts, not the tasks'."""
    land("transfermarkt", "club-players-c1.json", {"id": "c1", "players": [{"id": str(i), "name": f"P{i}"} for i in (1, 2, 3)]})
    land("transfermarkt", "club-search-h.json", {"results": [{"id": "c1", "name": "Harbour"}]})
    docs = [{"id": "1", "marketValue": "-", "marketValueHistory": _history(("2026-01-01", "-"), ("2025-01-01", "€9.00m"))},
            {"id": "2", "marketValue": "-", "marketValueHistory": _history(("2026-01-01", "€2.00m"), ("2026-01-01", "€3.00m"))}]
    land("transfermarkt", "market-value-a.json", "\n".join(map(json.dumps, docs)))
    docs = [{"id": "1", "marketValue": "-", "marketValueHistory": _history(("2026-01-01", "€5.00m"))},
            {"id": "2", "marketValue": "-", "marketValueHistory": _history(("2026-01-01", "€4.00m"))},
            {"id": "3", "marketValue": "-", "marketValueHistory": _history(("2026-01-01", "-"))}]
    land("transfermarkt", "market-value-b.json", "\n".join(map(json.dumps, docs)))
    rows = {r["tm_player_id"]: r["value_eur"] for r in SC.scan_market_live(spark, f"{land.root}/transfermarkt/{STAMP}", multi_line=False).collect()}
    assert rows == {"1": 5_000_000, "2": 2_000_000, "3": None}
    players = land("transfermarkt_datasets", "players.csv", (
        "player_id,name,date_of_birth,sub_position,contract_expiration_date,current_club_id,current_club_name,current_club_domestic_competition_id\n1,A,,,,5,H,GB1\n"))
    # A file of several blocks: the first row stands in the first, the last in the last.
    many = "".join(f"1,2025-06-01,{v}\n" for v in range(100, 60_100))
    values = land("transfermarkt_datasets", "player_valuations.csv", "player_id,date,market_value_in_eur\n" + many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert SC.read_csv(spark, values, ("date",), "x").rdd.getNumPartitions() > 3
        assert [r["value_eur"] for r in SC.scan_market_latest(spark, players, values, "GB1").collect()] == [100]
        assert [r["value_eur"] for r in SC.scan_market_history(spark, players, values, "GB1").collect()] == [60_099]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unreadable_values_stop_the_scan(spark, land):
    players = land("transfermarkt_datasets", "players.csv.gz", gzip.compress(
        b"player_id,name,date_of_birth,sub_position,contract_expiration_date,current_club_id,current_club_name,current_club_domestic_competition_id\n1,A,,,,5,H,GB1\n"))
    for line in (b"1,2025-06-01,garbage", b"1,not-a-date,100"):
        values = land("transfermarkt_datasets", "player_valuations.csv.gz", gzip.compress(b"player_id,date,market_value_in_eur\n" + line + b"\n"))
        with pytest.raises(Exception, match="unreadable"):
            SC.scan_market_latest(spark, players, values, "GB1").collect()
    path = land("espn", "2024-25_scoreboards.json", {"season": "2024-25", "days": {"20240817": {"events": [_event(1, "many", "50")]}}})
    with pytest.raises(Exception, match="unreadable possession share"):
        SC.scan_possession(spark, path)[0].collect()


def test_overrides_and_events(spark, land):
    path = land("override", "o.csv", "tm_player_id,value_eur,tm_last_updated,reason,date\n 7 ,€1.00m,2026-01-01,typo,2026-02-01\n8,,2026-01-01, ,2026-02-01\n")
    good, bad = SC.scan_overrides(spark, path)
    assert [(r["tm_player_id"], r["value_eur"]) for r in SC.market_overrides(good).collect()] == [("7", 1_000_000)]
    assert bad.first()["empty_columns"] == ["value_eur", "reason"]
    path = land("override", "p.csv", "fpl_code,source,source_id,reason,date\n900, understat ,7,typo,2026-02-01\n901,understat,8,,2026-02-01\n902,understat,7,again,2026-02-02\n")
    good, bad = SC.scan_player_overrides(spark, path)
    assert [tuple(r) for r in good.collect()] == [("understat", "7", 902)]
    assert [(r["source_id"], r["empty_columns"]) for r in bad.collect()] == [("8", ["reason"])]
    path = land("override", "q.csv", "fpl_code,source,source_id,reason,date\nx1,understat,7,typo,2026-02-01\n")
    with pytest.raises(Exception, match="unreadable player code"):
        SC.scan_player_overrides(spark, path)[0].collect()
    path = land("statsbomb", "events-8123.json", [
        {"id": "a", "index": 1, "type": {"id": 30, "name": "Pass"}, "team": {"id": 1, "name": "R"}, "location": [60.0, 40.0], "pass": {"end_location": [70.0, 41.0]}},
        {"id": "b", "index": 2, "type": {"id": 43, "name": "Carry"}, "team": {"id": 1, "name": "R"}, "carry": {"end_location": [1.0, 2.0]}}])
    rows = {r["event_id"]: r for r in SC.scan_events_flatten(spark, path).collect()}
    assert (rows["a"]["match_id"], rows["a"]["end_x"], rows["b"]["end_y"], rows["b"]["x"]) == (8123, 70.0, 2.0, None)


def test_snapshots_and_drift(spark, land):
    land("fpl", "a.json", "1", "20250101T000000000000Z")
    land("fpl", "a.json", "22")
    land("fpl", "b.json", "3", "20250101T000000000000Z")
    newest = {(r["name"], r["ts"], r["length"]) for r in SN.latest_snapshot(SN.list_files(spark, land.root)).collect()}
    assert newest == {("a.json", STAMP, 2), ("b.json", "20250101T000000000000Z", 1)}
    now = F.lit("2026-01-03 00:00:00").cast("timestamp_ntz")
    assert [r["name"] for r in SN.latest_snapshot(SN.list_files(spark, land.root), 48, now).collect()] == ["a.json"]
    assert SN.snapshot_audit(spark, land.root).filter("length(checksum) = 64").count() == 3
    import hashlib
    csv = b"id,v\n1,a\n2,b\n\n"
    land("vaastav", "x.csv", csv)
    land("vaastav", "y.csv.gz", gzip.compress(csv))
    land("vaastav", "z.json", "{}\n{}\n{}")
    land("vaastav", "none.csv", b"id,v\n")
    rows = {r["name"]: (r["rows"], r["bytes"], r["checksum"]) for r in SN.snapshot_audit(spark, f"{land.root}/vaastav").collect()}
    assert {k: v[0] for k, v in rows.items()} == {"x.csv": 2, "y.csv.gz": 2, "z.json": 3, "none.csv": 0}
    assert rows["x.csv"][1:] == (len(csv), hashlib.sha256(csv).hexdigest())
    have = spark.createDataFrame([], "a int, s struct<x: int>, l array<struct<y: int>>").schema
    need = spark.createDataFrame([], "a int, b int, s struct<x: int, z: int>, l array<struct<y: int, w: int>>").schema
    assert Q.schema_drift(have, need) == ["b", "s.z", "l.w"]


def test_replace_by_source_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "fpl"), (2, "fpl"), (3, "espn")], "id int, source string")
    for _ in range(2):
        SK.replace_by_source(df, str(tmp_path / "f"), ["fpl", "espn"])
    SK.replace_by_source(df.filter("id = 1"), str(tmp_path / "f"), ["fpl"])
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [1, 3]
    assert SK.replace_by_source(df.limit(0), str(tmp_path / "f"), ["espn"]).count() == 0
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [1]
    with pytest.raises(Exception, match="source that is not replaced"):
        SK.replace_by_source(df, str(tmp_path / "f"), ["fpl"])
    out = SK.store_ml_outputs(spark, None, None, str(tmp_path / "ml"))
    assert out["player_role"].count() == 0 and out["player_value_score"].count() == 0


def test_loads_survive_a_break_and_read_their_own_target(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f")
    df = spark.createDataFrame([(1, "fpl"), (2, "fpl"), (3, "espn"), (4, "a b:c")], "id int, source string")
    everything = ["fpl", "espn", "a b:c"]
    SK.replace_by_source(df, path, everything)

    def ids():
        return sorted(r["id"] for r in spark.read.parquet(path).collect())

    # A load that cannot be computed changes nothing.
    with pytest.raises(Exception, match="not replaced"):
        SK.replace_by_source(df.withColumn("id", F.col("id") + 10), path, ["fpl", "espn"])
    assert ids() == [1, 2, 3, 4] and not any(p.suffix == ".json" for p in (tmp_path / "f.loads").iterdir())
    # Broken off after the first folder has changed places: the next one to look finishes it.
    real, moved = SK.Files.move, []

    def once(self, source, to):
        if "source=" in to:
            if moved:
                raise OSError("executor room on fire")
            moved.append(to)
        real(self, source, to)

    monkeypatch.setattr(SK.Files, "move", once)
    with pytest.raises(OSError, match="on fire"):
        SK.replace_by_source(df.withColumn("id", F.col("id") + 100), path, everything)
    monkeypatch.undo()
    assert len(ids()) < 4
    assert sorted(r["id"] for r in SK.read_by_source(spark, path).collect()) == [101, 102, 103, 104]
    # A load of the table from itself.
    own = spark.read.parquet(path).withColumn("id", F.col("id") * 2)
    written = {r["source"]: r["written"] for r in SK.replace_by_source(own.filter("source != 'espn'"), path, ["fpl", "espn", "a b:c"]).collect()}
    assert written == {"fpl": 2, "a b:c": 1} and ids() == [202, 204, 208]
    assert SK.Files(spark, path).names(f"{path}.loads") == []
