"""Player-season rows, valuations around season ends, age curves and arrivals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators.common import top_per
from touchline.params import AgeCurveParams, Methodology, ValueParams

_M = Methodology()
_V = ValueParams()
_A = AgeCurveParams()


def player_seasons(totals: DataFrame, players: DataFrame, ends: DataFrame, table: DataFrame,
                   stats: Sequence[str] = _V.stats, m: Methodology = _M) -> DataFrame:
    """One row per player and season over all clubs; the main club has the most minutes.

    ``totals`` are club rows of one source; ``ends``: season_id, season_end; ``table``:
    standings. Equal minutes go to the lowest club id.
    """
    minutes = F.coalesce("minutes", F.lit(0))
    rows = totals.groupBy("player_id", "season_id").agg(
        F.sum(minutes).cast("double").alias("minutes"),
        F.max_by("team_id", F.struct(minutes, -F.col("team_id"))).alias("team_id"),
        *[F.sum(s).cast("double").alias(s) for s in stats], F.max("fetched_at").alias("as_of"))
    record = table.select("season_id", "team_id", "played", "points")
    rows = (rows.join(players.select("player_id", "position_group", "birth_date"), "player_id", "left")
            .join(ends.select("season_id", "season_end"), "season_id", "left")
            .join(record, ["season_id", "team_id"], "left"))
    available = F.col("played") * m.match_minutes
    return rows.select(
        "player_id", "season_id", "team_id", "position_group", "birth_date",
        S.age_on("birth_date", "season_end").alias("age"), "minutes",
        S.ratio("minutes", available).alias("minutes_share"),
        S.ratio("points", "played").alias("team_ppg"), "season_end", "as_of",
        *[S.per90(s, "minutes").alias(f"{s}_p90") for s in stats])


def blend_with_previous(rows: DataFrame, history: DataFrame | None = None,
                        stats: Sequence[str] = _V.stats, m: Methodology = _M) -> DataFrame:
    """Blend each rate with the player's season before.

    Effective minutes count last season's minutes whether or not a rate is known.
    """
    before = (rows if history is None else history).select(
        F.col("player_id").alias("p_player"), F.col("season_id").alias("p_season"),
        F.col("minutes").alias("p_minutes"), F.col("as_of").alias("p_as_of"),
        *[F.col(f"{s}_p90").alias(f"p_{s}") for s in stats])
    joined = rows.join(before, (F.col("player_id") == F.col("p_player"))
                       & (S.previous_season("season_id") == F.col("p_season")), "left")
    prev = F.coalesce("p_minutes", F.lit(0.0))
    weight = F.lit(m.blend_lambda) * F.least(prev, F.lit(m.prev_minutes_cap))
    blended = {f"{s}_p90": S.blend(f"{s}_p90", "minutes", f"p_{s}", prev, lam=m.blend_lambda,
                                   cap=m.prev_minutes_cap)["rate"] for s in stats}
    return joined.withColumns({
        **blended, "effective_minutes": F.col("minutes") + weight,
        "used_previous_season": weight > 0, "as_of": F.greatest("as_of", "p_as_of"),
    }).drop("p_player", "p_season", "p_minutes", "p_as_of", *[f"p_{s}" for s in stats])


def asof_nearest_valuation(rows: DataFrame, history: DataFrame, v: ValueParams = _V) -> DataFrame:
    """The valuation nearest each row's season end within [-before, +after] days.

    Equal distance goes to the later date. The nearest one is an aggregate with map-side
    combine, so a player with very many valuations never sits in one task's sort.
    """
    h = history.select(F.col("player_id").alias("h_player"), F.col("tm_last_updated").alias("value_date"),
                       "value_eur", F.col("source").alias("value_source"), "id")
    delta = F.datediff("value_date", "season_end")
    keys = rows.select("player_id", "season_end").filter(F.col("season_end").isNotNull()).distinct()
    near = (keys.join(h, (F.col("player_id") == F.col("h_player"))
                      & delta.between(-v.days_before, v.days_after))
            .groupBy("player_id", "season_end")
            .agg(F.min_by(F.struct("value_eur", "value_date", "value_source"),
                          F.struct(F.abs(delta), -delta, "value_source", "id")).alias("near")))
    out = rows.join(near, ["player_id", "season_end"], "left")
    return out.select(*rows.columns, "near.value_eur",
                      F.when(F.col("near.value_eur") > 0, F.log(F.col("near.value_eur").cast("double"))).alias("log_value"),
                      "near.value_date", "near.value_source")


def consecutive_season_pairs(rows: DataFrame, metrics: Sequence[str] = _A.metrics,
                             min_minutes: float = _A.min_minutes) -> DataFrame:
    """Change of each rate between two seasons in a row, both with enough minutes."""
    enough = rows.filter(F.col("minutes") >= min_minutes)
    early = enough.filter(F.col("age").isNotNull()).select(
        F.col("player_id").alias("e_player"), F.col("season_id").alias("season_from"), "age",
        F.col("minutes").alias("e_minutes"), *[F.col(f"{x}_p90").alias(f"e_{x}") for x in metrics])
    late = enough.select("player_id", F.col("season_id").alias("season_to"), "minutes",
                         *[f"{x}_p90" for x in metrics])
    pairs = late.join(early, (F.col("player_id") == F.col("e_player"))
                      & (S.previous_season("season_to") == F.col("season_from")))
    items = F.array(*[F.struct(F.lit(x).alias("metric"),
                               (F.col(f"{x}_p90") - F.col(f"e_{x}")).alias("delta")) for x in metrics])
    return (pairs.select("player_id", "season_from", "season_to", F.floor("age").cast("int").alias("age"),
                         S.harmonic_mean("e_minutes", "minutes").alias("weight"), F.inline(items))
            .filter("delta is not null"))


def pair_count(pairs: DataFrame) -> DataFrame:
    return pairs.select("player_id", "season_from").distinct().agg(F.count(F.lit(1)).alias("n"))


def age_deltas(pairs: DataFrame, a: AgeCurveParams = _A) -> DataFrame:
    """Weighted mean change per metric and age over the whole age range; NULL below min pairs."""
    spine = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(age).alias("age"))
                      for m in a.metrics for age in range(a.age_min, a.age_max + 1)])
    ages = pairs.sparkSession.range(1).select(F.inline(spine))
    stats = pairs.groupBy("metric", "age").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(F.col("delta") * F.col("weight")).alias("dw"))
    rows = ages.join(stats, ["metric", "age"], "left")
    delta = F.when((F.col("n") >= a.min_pairs) & (F.col("w") > 0), F.col("dw") / F.col("w"))
    return rows.select("metric", "age", delta.alias("delta"), F.coalesce("n", F.lit(0)).alias("n_pairs"))


def cumulative_curve(points: DataFrame) -> DataFrame:
    """Running sum of the deltas before each age; a gap ends the run and the next starts at 0.

    At most one row per metric and age is ordered here.
    """
    w = W.partitionBy("metric").orderBy("age").rowsBetween(W.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.col("delta").isNull().cast("int")).over(w), F.lit(0))
    inside = W.partitionBy("metric", "run").orderBy("age").rowsBetween(W.unboundedPreceding, -1)
    before = F.sum("delta").over(inside)
    start = F.when(F.col("delta").isNotNull(), F.lit(0.0))
    return points.withColumn("run", run).withColumn("cumulative", F.coalesce(before, start)).drop("run")


def age_curve(pairs: DataFrame, a: AgeCurveParams = _A) -> DataFrame:
    return cumulative_curve(age_deltas(pairs, a))


def age_projection(rates: DataFrame, curve: DataFrame, as_of: Column,
                   metrics: Sequence[str] = _A.metrics) -> DataFrame:
    """Blended rate plus the typical change at the player's age, floored at 0."""
    age = F.floor(S.age_on("birth_date", as_of)).cast("int")
    items = F.array(*[F.struct(F.lit(x).alias("metric"), F.col(f"{x}_p90").alias("current")) for x in metrics])
    rows = rates.select("player_id", age.alias("age"), F.inline(items))
    out = rows.join(curve.select("metric", "age", "delta", "n_pairs"), ["metric", "age"], "left")
    projected = F.when(F.col("current").isNotNull() & F.col("delta").isNotNull(),
                       F.greatest(F.lit(0.0), F.col("current") + F.col("delta")))
    return out.withColumn("projected", projected).withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def relabel_source(totals: DataFrame, season, history: str = "vaastav", current: str = "fpl") -> DataFrame:
    """Replay ``season`` as current: its archive rows take the current source's name."""
    hit = (F.col("season_id") == season) & (F.col("source") == history)
    return totals.withColumn("source", F.when(hit, F.lit(current)).otherwise(F.col("source")))


def arrivals_anti(totals: DataFrame, players: DataFrame, prev, cur, min_minutes: float = 1.0) -> DataFrame:
    """This season's (player, club) pairs without a record last season."""
    before = totals.filter((F.col("season_id") == prev) & (F.col("source") == "vaastav")).select("player_id", "team_id")
    now = (totals.filter((F.col("season_id") == cur) & (F.col("source") == "fpl"))
           .groupBy("team_id", "player_id").agg(F.coalesce(F.sum("minutes"), F.lit(0)).alias("minutes")))
    return (now.filter(F.col("minutes") >= min_minutes).join(before, ["player_id", "team_id"], "left_anti")
            .join(players.select("player_id", "position_group"), "player_id", "left")
            .select("team_id", "player_id", "position_group", "minutes"))


def most_signed(arrivals: DataFrame, clubs: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The n groups most often signed by the other clubs, ties in catalogue order."""
    known = arrivals.filter(F.col("position_group").isNotNull())
    own = known.groupBy("team_id", "position_group").agg(F.count(F.lit(1)).alias("own"))
    total = own.groupBy("position_group").agg(F.sum("own").alias("total"))
    groups = F.array(*[F.struct(F.lit(g).alias("position_group"), F.lit(i).alias("place"))
                       for i, g in enumerate(order)])
    rows = (clubs.select("team_id", F.inline(groups)).join(total, "position_group")
            .join(own, ["team_id", "position_group"], "left")
            .withColumn("n", F.col("total") - F.coalesce("own", F.lit(0))).filter("n > 0"))
    return top_per(rows, ["team_id"], [F.desc("n"), F.asc("place")], n, rank="place_rank").select(
        "team_id", "position_group", "n", F.col("place_rank").alias("rank"))


def precision_at_n(needs: DataFrame, arrivals: DataFrame, baseline: DataFrame, clubs: DataFrame,
                   n_groups: int) -> DataFrame:
    """Per club: share of predicted groups signed, and the naive and random baselines.

    NULL for a club with nothing predicted or nobody signed.
    """
    signed = arrivals.filter(F.col("position_group").isNotNull()).select("team_id", "position_group").distinct()
    hit = signed.withColumn("hit", F.lit(1))

    def share(picks: DataFrame, name: str) -> DataFrame:
        return (picks.select("team_id", "position_group").join(hit, ["team_id", "position_group"], "left")
                .groupBy("team_id").agg(F.count(F.lit(1)).alias(f"{name}_n"), F.count("hit").alias(f"{name}_hits")))

    rows = (clubs.select("team_id").join(share(needs, "p"), "team_id", "left")
            .join(share(baseline, "b"), "team_id", "left")
            .join(signed.groupBy("team_id").agg(F.count(F.lit(1)).alias("signed")), "team_id", "left"))
    ok = (F.col("p_n") > 0) & (F.col("signed") > 0)
    return rows.select(
        "team_id", F.coalesce("p_hits", F.lit(0)).alias("hits"),
        F.when(ok, F.col("p_hits") / F.col("p_n")).alias("precision"),
        F.when(ok & (F.col("b_n") > 0), F.col("b_hits") / F.col("b_n")).alias("baseline_precision"),
        F.when(ok, F.col("signed") / F.lit(float(n_groups))).alias("random_precision"),
        F.when(F.coalesce("signed", F.lit(0)) == 0, F.lit("no arrivals yet"))
        .when(F.coalesce("p_n", F.lit(0)) == 0, F.lit("no shortfall vs benchmark")).alias("skipped"))


def backtest_summary(per_club: DataFrame) -> DataFrame:
    known = F.col("precision").isNotNull()
    return per_club.agg(
        F.avg("precision").alias("precision"), F.avg("baseline_precision").alias("baseline_precision"),
        F.avg("random_precision").alias("random_precision"),
        F.avg(F.when(known, (F.col("hits") > 0).cast("double"))).alias("hit_rate"),
        F.count("precision").alias("evaluated"),
        F.count_if(F.col("skipped") == "no arrivals yet").alias("no_arrivals"),
        F.count_if(F.col("skipped") == "no shortfall vs benchmark").alias("no_shortfall"))


def compare_entities(pairs: DataFrame, features: DataFrame, needs: DataFrame) -> DataFrame:
    """Both players' KPI percentiles side by side for a table of pairs.

    ``pairs``: a, b, team_id, position_group; ``needs``: team_id, position_group, kpi the club
    trails on. KPIs only one of the two has are kept.
    """
    # One map of percentiles per player and one list per club and group, as long as the catalogue; a pair meets each once.
    sheet = features.groupBy("player_id").agg(F.map_from_entries(F.collect_list(F.struct("kpi", "percentile"))).alias("m"))
    trails = needs.groupBy("team_id", "position_group").agg(F.collect_set("kpi").alias("trails"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    rows = (pairs.join(sheet.select(F.col("player_id").alias("a"), F.col("m").alias("m_a")), "a", "left")
            .join(sheet.select(F.col("player_id").alias("b"), F.col("m").alias("m_b")), "b", "left")
            .join(trails, ["team_id", "position_group"], "left"))
    both = F.map_zip_with(F.coalesce("m_a", none), F.coalesce("m_b", none), lambda _k, x, y: F.struct(x.alias("pct_a"), y.alias("pct_b")))
    rows = rows.select("team_id", "position_group", "a", "b", "trails", F.explode(both).alias("kpi", "p"))
    return rows.select("team_id", "position_group", "a", "b", "kpi", "p.pct_a", "p.pct_b", (F.col("p.pct_a") - F.col("p.pct_b")).alias("delta"),
                       F.coalesce(F.array_contains("trails", F.col("kpi")), F.lit(False)).alias("is_need"))


def attach_value_score(candidates: DataFrame, scores: DataFrame, season) -> DataFrame:
    """Candidates with this season's stats-implied value, band and label, if any."""
    mine = scores.filter(F.col("season_id") == season).drop("season_id")
    return candidates.join(mine, "player_id", "left")
