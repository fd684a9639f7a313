"""Feeds landed from the test tables, on tables of odd content."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

import __spark_entry__ as entry
from touchline.workload import feeds

SMALL = "/root/testdata/sf0.001"


def tables(folder: Path, **changed: str) -> str:
    """A copy of the small tables; ``changed`` gives the SQL of those that differ."""
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"COPY ({changed.get(name, f'SELECT * FROM {name}')}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def both(spark, sf: str, key: str) -> tuple[list, list]:
    """Rows of a query and of its SQL over the tables of ``sf``, columns by name."""
    con = duckdb.connect()
    for path in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(entry.oracle_sql()[key])
    names = sorted(d[0] for d in found.description)
    want = [dict(zip([d[0] for d in found.description], row)) for row in found.fetchall()]
    got = [r.asDict() for r in entry.queries()[key](spark, sf).collect()]
    return tuple(sorted((tuple(r[n] for n in names) for r in rows), key=str) for rows in (got, want))


def landed_files(root: str) -> list[str]:
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if not f.startswith((".", "_"))]


def test_a_feed_is_packed_and_lands_alone(spark, tmp_path):
    sf = tables(tmp_path)
    assert entry.queries()["scan_players"](spark, sf).count() > 0
    root = feeds.landed(spark, sf, "fpl/bootstrap-static.json")
    assert {Path(f).parent.name for f in landed_files(root)} == {"bootstrap-static.json"}
    feeds.landed(spark, sf)
    assert all(f.endswith(".gz") for f in landed_files(root))
    got, want = both(spark, sf, "latest_snapshot")
    assert got == want


def test_the_highest_value_of_the_newest_day_is_the_current_one(spark, tmp_path):
    # Two events of one day for every second player, of other blocks of ids; either the first or the second has the higher value.
    sf = tables(tmp_path, events="""SELECT * REPLACE (1 + i // 2 + i % 2 * 2500 AS event_id, i // 2 * 2 + 1 AS user_id, 'view' AS event_type, 90.0 + 20 * ((i + i // 2) % 2) AS value)
      FROM (SELECT *, row_number() OVER () - 1 AS i FROM events) WHERE i < 80""")
    got, want = both(spark, sf, "scan_market_live")
    assert got == want
    assert 11_000_000 in {r[-1] for r in got}


def test_a_record_without_a_known_club_has_no_codes(spark, tmp_path):
    sf = tables(tmp_path, supplier="SELECT * REPLACE (24 AS s_nationkey) FROM supplier")
    got, want = both(spark, sf, "build_records")
    assert got == want and got
    assert {r[2] for r in got} == {""}  # name, source_id, team_codes, team_label
