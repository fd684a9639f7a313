from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools_check import TABLES, canonical
from touchline.workload.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["player_season", "percentiles", "features", "standings", "defensive_padj", "benchmark_gap", "recommend",
          "asof_nearest_valuation", "link_decide", "prefix_search", "knn_similar", "scan_possession", "fact_sheet"]
WITHOUT_ORACLE = {"role_clusters", "value_model", "score_players", "snapshot_audit"}


def test_every_query_has_an_oracle_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_ORACLE
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", SAMPLE)
def test_query_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    rel = duck.execute(entry.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), names)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_shared_results_follow_the_files(spark, tmp_path):
    from touchline.workload import bindings as B

    spark.range(3).write.parquet(str(tmp_path / "orders.parquet"))
    first = B.version(spark, str(tmp_path))
    assert B.version(spark, str(tmp_path)) == first
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    assert B.version(spark, str(tmp_path)) != first
