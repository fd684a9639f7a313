"""Test tables as the domain tables the operators expect."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.sources.files import Files

GROUP_OF_SEGMENT = {"AUTOMOBILE": "GK", "BUILDING": "CB", "FURNITURE": "CM", "HOUSEHOLD": "W",
                    "MACHINERY": "ST"}
TODAY = "2001-12-31"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def version(spark: SparkSession, sf: str) -> tuple:
    """What shared results over these tables are kept by: the session and the state of the files."""
    return spark.sparkContext.applicationId, Files(spark, sf).state(sf)


def _season(ts: str) -> Column:
    return S.season_label(F.year(ts))


def current_season(spark: SparkSession, sf: str) -> Column:
    """The newest season as a scalar subquery."""
    return (table(spark, sf, "orders").select(F.max("o_orderdate").alias("d"))
            .select(_season("d")).scalar())


def dim_season(spark: SparkSession, sf: str) -> DataFrame:
    seasons = table(spark, sf, "orders").select(_season("o_orderdate").alias("season_id")).distinct()
    return seasons.withColumn("is_current", F.col("season_id") == current_season(spark, sf))


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100)


def lines(spark: SparkSession, sf: str, seasons: Sequence[Column] = ()) -> DataFrame:
    """Line items with their order; those of the named seasons, or all."""
    li = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    if seasons:
        orders = orders.filter(reduce(or_, [_season("o_orderdate") == s for s in seasons]))
    return li.join(orders, li.l_orderkey == orders.o_orderkey)


def fact(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """fact_player_match with its season: one row per line item (of ``lines``, when some are named)."""
    li = lines(spark, sf) if of is None else of
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    season = _season("o_orderdate")
    qty = F.col("l_quantity").cast("bigint")
    return (
        li.join(suppliers, li.l_suppkey == suppliers.s_suppkey)
        .select(
            F.col("o_custkey").alias("player_id"), F.col("l_orderkey").alias("match_id"),
            F.col("s_nationkey").alias("team_id"), season.alias("season_id"),
            F.when(F.col("l_linestatus") == "O", F.lit("understat"))
            .when(season == current_season(spark, sf), F.lit("fpl"))
            .otherwise(F.lit("vaastav")).alias("source"),
            qty.alias("minutes"),
            F.when(F.col("l_quantity") > 25, F.lit(True))
            .when(F.col("l_quantity") > 5, F.lit(False)).alias("started"),
            (F.col("l_returnflag") == "R").cast("bigint").alias("goals"),
            (F.col("l_returnflag") == "A").cast("bigint").alias("assists"),
            (_cents("l_discount") / 16).alias("xg"), (_cents("l_discount") / 32).alias("npxg"),
            F.when(F.col("l_returnflag") != "R", _cents("l_tax") / 16).alias("xa"),
            F.col("l_linenumber").cast("bigint").alias("shots"),
            (F.col("l_linenumber") % 3).cast("bigint").alias("key_passes"),
            ((_cents("l_discount") + _cents("l_tax")) / 16).alias("xg_chain"),
            (_cents("l_tax") / 32).alias("xg_buildup"),
            (F.col("l_suppkey") % 5).alias("tackles"), (F.col("l_partkey") % 7).alias("recoveries"),
            (F.col("l_partkey") % 4).alias("cbi"),
            (F.col("l_suppkey") % 5 + F.col("l_partkey") % 7).alias("def_contribution"),
            (_cents("l_discount") / 8).alias("xgc_on_pitch"),
            (qty % 4).alias("saves"), (F.col("l_linenumber") % 3).cast("bigint").alias("goals_conceded"),
            (F.col("l_partkey") % 25 == 0).cast("bigint").alias("penalties_saved"),
            (F.col("l_partkey") % 10 == 0).cast("bigint").alias("yellow_cards"),
            (F.col("l_partkey") % 50 == 0).cast("bigint").alias("red_cards"),
            F.to_date("l_shipdate").alias("fetched_at"),
        )
    )


def fact_only(spark: SparkSession, sf: str) -> DataFrame:
    return fact(spark, sf).drop("season_id")


def match_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a match with its season, for joins that need no club sides."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("match_id"), _season("o_orderdate").alias("season_id"))


def dim_match(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    li = lines(spark, sf) if of is None else of
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    order = ["l_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"]
    orders = li.join(suppliers, li.l_suppkey == suppliers.s_suppkey).groupBy(*order).agg(
        F.min("s_nationkey").alias("away_team_id"),
        F.count_if(F.col("l_returnflag") == "R").alias("hs"),
        F.count_if(F.col("l_returnflag") == "A").alias("aws"))
    homes = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    played = F.col("o_orderstatus") != "P"
    return (
        orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
        .filter(F.col("c_nationkey") != F.col("away_team_id"))
        .select(
            F.col("l_orderkey").alias("match_id"), _season("o_orderdate").alias("season_id"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.to_date("o_orderdate")).alias("kickoff"),
            F.col("c_nationkey").alias("home_team_id"), "away_team_id",
            F.when(played, F.col("hs")).alias("home_score"),
            F.when(played, F.col("aws")).alias("away_score"),
        )
    )


def fact_team(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """fact_team_match: a possession row and a statistics row per (order, nation).

    The lines are dealt by order once, which both sums and their join then keep.
    """
    li = (table(spark, sf, "lineitem") if of is None else of).repartition("l_orderkey")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    flag = F.col("l_returnflag")
    own = (li.join(suppliers, li.l_suppkey == suppliers.s_suppkey)
           .groupBy(F.col("l_orderkey").alias("match_id"), F.col("s_nationkey").alias("team_id")).agg(
        F.sum(_cents("l_extendedprice")).cast("bigint").alias("cents"),
        (F.sum(_cents("l_discount")) / 16).alias("xg"), (F.sum(_cents("l_discount")) / 32).alias("npxg"),
        (F.sum("l_quantity") / 4).alias("ppda"), F.sum("l_linenumber").cast("double").alias("deep"),
        (F.sum(F.when(flag == "A", _cents("l_discount")).otherwise(0.0)) / 16).alias("sp"),
        (F.sum(F.when(flag == "N", _cents("l_discount")).otherwise(0.0)) / 16).alias("op"),
        F.count_if(flag == "R").alias("shots"), F.max(F.to_date("l_shipdate")).alias("fetched_at")))
    both = own.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("teams"),
        *[F.sum(c).alias(f"{c}_all") for c in ("cents", "xg", "npxg", "ppda", "deep", "sp", "op", "shots")])
    rows = own.join(both, "match_id")
    has_shots = F.col("shots_all") > 0
    none = F.lit(None).cast("double")
    stats = {
        "possession": (F.when(F.col("teams") > 1, F.col("cents") / F.col("cents_all")), none),
        "xg": (none, F.col("xg")), "xga": (none, F.col("xg_all") - F.col("xg")),
        "npxg": (none, F.col("npxg")), "npxga": (none, F.col("npxg_all") - F.col("npxg")),
        "ppda": (none, F.col("ppda")), "ppda_allowed": (none, F.col("ppda_all") - F.col("ppda")),
        "deep": (none, F.col("deep")), "deep_allowed": (none, F.col("deep_all") - F.col("deep")),
        "set_piece_xg": (none, F.when(has_shots, F.col("sp"))),
        "set_piece_xga": (none, F.when(has_shots, F.col("sp_all") - F.col("sp"))),
        "open_play_xga": (none, F.when(has_shots, F.col("op_all") - F.col("op"))),
    }
    sides = F.array(*[
        F.struct(F.lit(source).alias("source"), *[pair[i].alias(n) for n, pair in stats.items()])
        for i, source in enumerate(("espn", "understat"))])
    return rows.select("match_id", "team_id", "fetched_at", F.inline(sides))


def dim_player(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    group = F.create_map(*[F.lit(x) for kv in GROUP_OF_SEGMENT.items() for x in kv])
    return table(spark, sf, "customer").select(
        key.alias("player_id"), F.col("c_name").alias("canonical_name"),
        F.try_element_at(group, F.col("c_mktsegment")).alias("position_group"),
        F.when(key % 17 != 0, F.date_add(F.lit("1962-01-01").cast("date"), (key * 37 % 7300).cast("int")))
        .alias("birth_date"),
        F.when(key % 50 != 0, key + 5000000).alias("understat_id"),
        F.when(key % 5 != 0, F.concat(F.lit("tm"), key.cast("string"))).alias("tm_id"))


def dim_team(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        key.alias("team_id"), F.col("n_name").alias("name"),
        F.when(key != 24, key + 100).alias("fpl_code"), F.col("n_regionkey").alias("region"))


def status(spark: SparkSession, sf: str) -> DataFrame:
    kind, eid = F.col("event_type"), F.col("event_id")
    return table(spark, sf, "events").select(
        eid.alias("id"), F.col("user_id").alias("player_id"),
        F.when(kind.isin("signup", "view"), F.lit("a")).when(kind == "click", F.lit("d"))
        .when(kind == "purchase", F.lit("i")).otherwise(F.lit("u")).alias("fpl_status"),
        F.when(eid % 3 == 0, F.get_json_object("props", "$.k").cast("double")).alias("chance_of_playing"),
        F.when(eid % 4 != 0, F.date_add(F.lit("2001-06-01").cast("date"), (eid * 13 % 900).cast("int")))
        .alias("contract_expiry"),
        F.col("ts").alias("fetched_at"))


def market_values(spark: SparkSession, sf: str) -> DataFrame:
    kind, eid = F.col("event_type"), F.col("event_id")
    return table(spark, sf, "events").select(
        eid.alias("id"), F.col("user_id").alias("player_id"),
        F.when(kind == "signup", F.lit("override")).when(kind.isin("click", "view"), F.lit("transfermarkt"))
        .otherwise(F.lit("transfermarkt_datasets")).alias("source"),
        F.when(kind != "error", F.round(F.col("value") * 100).cast("bigint") * 1000).alias("value_eur"),
        F.when(eid % 11 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (eid * 7919 % 2500).cast("int")))
        .alias("tm_last_updated"),
        (kind == "purchase").alias("is_stale"), F.col("ts").alias("fetched_at"))
