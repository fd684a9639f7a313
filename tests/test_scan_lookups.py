"""Lookups of a feed's players are sized by their rows, not by the packed text they come from."""

from __future__ import annotations

import gzip

from touchline.sources import scans as SC


def test_packed_players_do_not_pass_through_the_driver(spark, tmp_path):
    root = tmp_path / "vaastav" / "20260102T030405000000Z"
    root.mkdir(parents=True)
    players = "id,code\n" + "".join(f"{i},{i + 5000}\n" for i in range(200_000))
    rows = "element,fixture,opponent_team,was_home,kickoff_time,round,minutes,goals_scored,assists,yellow_cards,red_cards\n" + "".join(
        f"{i},{i},1,True,2001-09-01T15:00:00Z,3,90,0,0,0,0\n" for i in (0, 7, 199_999, 200_000))
    for name, text in (("players_raw", players), ("teams", "id,code,name\n1,101,A\n"), ("merged_gw", rows)):
        (root / f"2001-02_{name}.csv").mkdir()
        with gzip.open(root / f"2001-02_{name}.csv" / "part.csv.gz", "wt") as f:
            f.write(text)
    packed = (root / "2001-02_players_raw.csv" / "part.csv.gz").stat().st_size
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(packed * 3 // 2))
    try:
        found, rejects = SC.scan_archive_seasons(spark, str(root), ["2001-02"])
        # Rejects keep the outer joins, of which only the lookup can be sent around.
        plan = rejects._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [team_id" in plan and "BroadcastHashJoin [element_id" not in plan
        assert sorted(r["fpl_code"] for r in found.collect()) == [5000, 5007, 204_999] and rejects.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
