"""Shared inputs of the diagnosis and shortlist queries: what a query builds, and how pairs are scored."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from touchline import catalogue
from touchline.operators import totals as T
from touchline.plans import shortlist as SL
from touchline.workload import bindings as B
from touchline.workload import q_features as QF
from touchline.workload import q_needs as QN

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["age_risk", "attach_value_score"])
def test_query_without_kpis_builds_no_features(spark, monkeypatch, key):
    def refuse(*_):
        raise AssertionError("features built")

    monkeypatch.setattr(QN, "staged_features", refuse)
    assert queries()[key](spark, SF).count() > 0


def test_recent_lines_are_the_two_newest_seasons_whole(spark):
    seasons = [r["season_id"] for r in B.dim_season(spark, SF).orderBy(F.desc("season_id")).collect()][:2]
    want = B.fact(spark, SF).filter(F.col("season_id").isin(*seasons))
    got = B.fact(spark, SF, QF.recent(spark, SF))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_totals_without_clubs_equal_collapsed_clubs(spark):
    fact = B.fact(spark, SF)
    one, two = T.player_season(fact, by_club=False), T.collapse_clubs(T.player_season(fact))
    assert sorted(one.columns) == sorted(two.columns)
    cols = ["player_id", "season_id", "source", "matches", "minutes", "starts", "goals", "xg", "fetched_at"]
    assert one.select(cols).exceptAll(two.select(cols)).count() == 0 and one.count() == two.count()


def test_needs_meet_candidates_without_moving_them(spark):
    text = plan(QN.Inputs(spark, SF).scored().select("team_id", "player_id", "fit_score"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_aligned_mean_is_the_weighted_percentile(spark):
    group, weights = max(catalogue.GROUP_WEIGHTS.items(), key=lambda kv: len(kv[1]))
    names = list(weights)
    rows = [(1, group, {k: 10.0 * i for i, k in enumerate(names)}, {names[1]: 2.0, names[0]: 1.0}),
            (2, group, {names[0]: 40.0, names[1]: None}, {names[0]: 3.0, names[1]: 5.0}),
            (3, group, {names[2]: 7.0}, {names[0]: 3.0}), (4, group, None, {names[0]: 3.0}), (5, None, {names[0]: 3.0}, None)]
    df = spark.createDataFrame(rows, "id int, g string, p map<string,double>, w map<string,double>")
    got = df.select("id", SL.weighted_percentile(F.col("p"), F.col("w")).alias("a"),
                    SL.aligned_mean(SL.aligned(F.col("p"), F.col("g")), SL.aligned(F.col("w"), F.col("g"))).alias("b")).collect()
    assert [r["b"] for r in sorted(got)] == [pytest.approx(20.0 / 3), 40.0, None, None, None]
    assert all(r["a"] == r["b"] or r["a"] == pytest.approx(r["b"]) for r in got)


def test_features_do_not_move_rows_to_priors(spark):
    from touchline.operators import features as FE

    rows = QF.modes(spark, SF)
    assert "SortMergeJoin" not in plan(FE.add_shrunk(rows.localCheckpoint()))


def test_shot_sums_meet_their_game_in_one_join(spark, tmp_path):
    from touchline.sources import scans as SC

    games = ["game_id,date,home_team_id,away_team_id,home_team,away_team,home_goals,away_goals,home_xg,away_xg,home_np_xg,away_np_xg,"
             "home_ppda,away_ppda,home_deep_completions,away_deep_completions",
             "1,2025-08-01,1,2,A,B,1,0,1.0,0.5,1.0,0.5,8,9,3,4", "2,2025-08-02,3,4,C,D,0,0,1.0,0.5,1.0,0.5,8,9,3,4",
             "3,2025-08-03,1,3,A,C,0,0,1.0,0.5,1.0,0.5,8,9,3,4"]
    shots = ["game_id,player_id,team,xg,situation", "1,1,A,0.25,From Corner", "1,1,A,0.5,Open Play", "1,2,B,0.125,Open Play",
             "3,9,,0.75,Set Piece"]
    (tmp_path / "2025-26_team_match.csv").write_text("\n".join(games))
    (tmp_path / "2025-26_shots.csv").write_text("\n".join(shots))
    df = SC.scan_team_match_unpivot(spark, f"{tmp_path}/*_team_match.csv", f"{tmp_path}/*_shots.csv")
    got = {(r["understat_game_id"], r["team_name"]): (r["set_piece_xg"], r["set_piece_xga"], r["open_play_xga"]) for r in df.collect()}
    assert got == {(1, "A"): (0.25, 0.0, 0.125), (1, "B"): (0.0, 0.25, 0.5), (2, "C"): (None, None, None), (2, "D"): (None, None, None),
                   (3, "A"): (0.0, 0.0, 0.0), (3, "C"): (0.0, 0.0, 0.0)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
