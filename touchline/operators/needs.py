"""Club diagnosis: benchmark gaps, needs, weak links, risks and team-level shortfalls.

Tables here have one row per club x group x KPI at most; players only enter through
aggregations that combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.functions import scalars as S
from touchline.operators.common import top_per
from touchline.operators.totals import standardise
from touchline.params import DiagnosisParams, FitParams, Methodology

_D = DiagnosisParams()
_M = Methodology()


def _snap(gap: Column) -> Column:
    """A gap within float noise of zero is zero: subtracting totals can leave 1e-15."""
    return F.when(F.abs(gap) < 1e-9, F.lit(0.0)).otherwise(gap)


def weights_frame(df: DataFrame) -> DataFrame:
    return catalogue.kpi_weights(df.sparkSession)


def group_scores(squads: DataFrame, percentiles: DataFrame) -> DataFrame:
    """Minutes-weighted mean percentile per club x group x KPI."""
    known = F.col("percentile").isNotNull() & (F.col("minutes") > 0)
    rows = (squads.select("team_id", "player_id", "position_group", "minutes")
            .join(percentiles.select("player_id", "kpi", "percentile"), "player_id")
            .filter(known & F.col("position_group").isNotNull()))
    return rows.groupBy("team_id", "position_group", "kpi").agg(
        (F.sum(F.col("percentile") * F.col("minutes")) / F.sum("minutes")).alias("score"),
        F.sum("minutes").alias("weight_minutes"),
        F.count(F.lit(1)).alias("players"))


def benchmark_members(table: DataFrame, clubs: DataFrame, kind: str = _D.benchmark,
                      sizes: dict[str, int] | None = None, custom: Sequence[int] = ()) -> DataFrame:
    """Clubs of the benchmark; ties at the cut-off position are all in."""
    sizes = sizes or _D.benchmark_sizes
    if kind == "custom":
        return clubs.filter(F.col("team_id").isin(*custom)).select("team_id")
    if kind == "league":
        return clubs.select("team_id")
    if kind not in sizes:
        raise ValueError(f"no benchmark size configured for {kind!r}")
    return table.filter(F.col("position") <= sizes[kind]).select("team_id")


def benchmark_set(clubs: DataFrame, members: DataFrame) -> DataFrame:
    """Every club with the benchmark clubs it is compared to, never itself."""
    ids = members.agg(F.array_sort(F.collect_set("team_id"))).scalar()
    return clubs.withColumn("__ids", ids).select(
        "team_id", F.explode(F.array_remove("__ids", F.col("team_id"))).alias("benchmark_team_id"))


def _weights_array() -> Column:
    return F.array(*[F.struct(F.lit(g).alias("position_group"), F.lit(k).alias("kpi"),
                              F.lit(w).alias("weight"))
                     for g, ws in catalogue.GROUP_WEIGHTS.items() for k, w in ws.items()])


def benchmark_gap(scores: DataFrame, members: DataFrame, clubs: DataFrame) -> DataFrame:
    """Benchmark minus club per group KPI; NULL when either side has no score.

    The benchmark mean without the club itself is the members' total less the club's own
    share, so clubs are never paired with each other.
    """
    member = members.select("team_id").distinct().withColumn("__in", F.lit(1))
    keys = ["position_group", "kpi"]
    bench = (scores.join(member, "team_id").groupBy(*keys)
             .agg(F.sum("score").alias("__sum"), F.count(F.lit(1)).alias("__n")))
    own = scores.select("team_id", *keys, F.col("score").alias("club_score"))
    rows = (clubs.select("team_id", F.inline(_weights_array()))
            .join(own, ["team_id", *keys], "left").join(bench, keys, "left")
            .join(member, "team_id", "left"))
    inside = F.col("__in").isNotNull() & F.col("club_score").isNotNull()
    total = F.col("__sum") - F.when(inside, F.col("club_score")).otherwise(F.lit(0.0))
    n = F.col("__n") - F.when(inside, F.lit(1)).otherwise(F.lit(0))
    return (rows.withColumn("benchmark_score", S.ratio(total, n))
            .withColumn("gap", _snap(F.col("benchmark_score") - F.col("club_score")))
            .select("team_id", *keys, "weight", "club_score", "benchmark_score", "gap"))


def need_severity(gaps: DataFrame) -> DataFrame:
    """Weighted shortfall per club x group: NULL when no gap is known, 0 without shortfall."""
    shortfall = F.when(F.col("gap").isNotNull(), F.col("weight") * F.greatest(F.col("gap"), F.lit(0.0)))
    return gaps.groupBy("team_id", "position_group").agg(F.sum(shortfall).alias("severity"))


def rank_needs(severity: DataFrame, scale: int | None = None) -> DataFrame:
    """Needs of each club, most severe first, unknown last, then by group name."""
    key = F.col("severity") if scale is None else F.round("severity", scale)
    w = W.partitionBy("team_id").orderBy(key.desc_nulls_last(), F.asc("position_group"))
    return severity.withColumn("need_rank", F.row_number().over(w))


def topk_needs(severity: DataFrame, n: int, scale: int | None = None) -> DataFrame:
    return rank_needs(severity.filter(F.col("severity") > 0), scale).filter(F.col("need_rank") <= n)


def role_scores(players: DataFrame, percentiles: DataFrame) -> DataFrame:
    """Position-weighted percentile per player, weights renormalised over known KPIs."""
    w, p = F.col("weight"), F.col("percentile")
    rows = (percentiles.select("player_id", "kpi", "percentile").filter(p.isNotNull())
            .join(players.select("player_id", "position_group").distinct(), "player_id")
            .join(weights_frame(players).filter("weight > 0"), ["position_group", "kpi"]))
    return rows.groupBy("player_id").agg((F.sum(w * p) / F.sum(w)).alias("role_quality"))


def weak_links(squads: DataFrame, percentiles: DataFrame, matches: DataFrame,
               d: DiagnosisParams = _D, m: Methodology = _M) -> DataFrame:
    """Regular starters with a low percentile on a heavy KPI of their group."""
    available = matches.select("team_id", (F.col("matches") * m.match_minutes).alias("available"))
    rows = (squads.join(available, "team_id").filter(F.col("available") > 0)
            .withColumn("minutes_share", F.col("minutes") / F.col("available"))
            .filter(F.col("minutes_share") >= d.weak_link_min_share))
    heavy = weights_frame(squads).filter(F.col("weight") >= d.weak_link_min_weight)
    return (rows.join(percentiles.select("player_id", "kpi", "percentile"), "player_id")
            .filter(F.col("percentile") < d.weak_link_max_percentile)
            .join(heavy, ["position_group", "kpi"])
            .select("team_id", "player_id", "position_group", "kpi", "percentile", "minutes_share"))


def _leader(value: str) -> Column:
    """The value of the minutes leader (ties: lowest player id) within a group-by."""
    return F.max_by(F.struct(F.col(value).alias("v")),
                    F.struct(F.col("minutes"), -F.col("player_id")))["v"]


def _grouped(squads: DataFrame):
    return squads.filter(F.col("position_group").isNotNull()).groupBy("team_id", "position_group")


def depth_risk(squads: DataFrame, roles: DataFrame, d: DiagnosisParams = _D) -> DataFrame:
    """Groups where one player has nearly all minutes and nobody else rates well."""
    good = F.coalesce(F.col("role_quality"), F.lit(0.0)) > d.depth_backup_min
    rows = squads.join(roles, "player_id", "left").withColumn("good", good)
    agg = _grouped(rows).agg(
        F.sum("minutes").alias("total"), F.max("minutes").alias("top"),
        _leader("player_id").alias("player_id"), _leader("good").alias("leader_good"),
        F.count_if("good").alias("n_good"))
    backups = F.col("n_good") - F.col("leader_good").cast("int")
    return (agg.filter(F.col("total") > 0).withColumn("value", F.col("top") / F.col("total"))
            .filter((F.col("value") > d.depth_share) & (backups == 0))
            .select("team_id", "position_group", "player_id", "value"))


def age_risk(squads: DataFrame, as_of: Column, d: DiagnosisParams = _D) -> DataFrame:
    """Groups whose minutes-weighted age reaches the threshold."""
    known = F.col("birth_date").isNotNull() & (F.col("minutes") > 0)
    minutes = F.when(known, F.col("minutes"))
    agg = _grouped(squads).agg(
        F.sum("minutes").alias("total"), F.sum(minutes).alias("known"),
        F.sum(minutes * S.age_on("birth_date", as_of)).alias("weighted"))
    return (agg.filter((F.col("total") > 0) & (F.col("known") > 0))
            .withColumn("value", F.col("weighted") / F.col("known"))
            .filter(F.col("value") >= d.age_risk).select("team_id", "position_group", "value"))


def contract_risk(squads: DataFrame, as_of: Column, d: DiagnosisParams = _D) -> DataFrame:
    """Groups whose minutes leader's contract ends soon or has ended."""
    agg = _grouped(squads).agg(F.sum("minutes").alias("total"), _leader("player_id").alias("player_id"),
                               _leader("contract_expiry").alias("contract_expiry"))
    months = F.datediff("contract_expiry", as_of) / F.lit(S.DAYS_PER_MONTH)
    return (agg.filter(F.col("total") > 0).withColumn("value", months)
            .filter(F.col("value") <= d.contract_months)
            .select("team_id", "position_group", "player_id", "contract_expiry", "value"))


def evidence(squads: DataFrame, features: DataFrame) -> DataFrame:
    """Every squad player's KPI rows of their group, with receipts."""
    rows = features.join(weights_frame(features).select("position_group", "kpi"), ["position_group", "kpi"])
    mine = squads.select("team_id", "player_id", "canonical_name", F.col("minutes").alias("club_minutes"))
    return mine.join(rows, "player_id")


def team_rates(team_totals: DataFrame, metrics: Sequence[tuple], cur, prev,
               m: Methodology = _M) -> DataFrame:
    """Season rate per club and team metric, blended with last season when ``prev`` is given.

    ``metrics`` rows start with (kpi, source, column, aggregate).
    """
    items = F.array(*[
        F.struct(F.lit(kpi).alias("kpi"), F.lit(src).alias("kpi_source"), F.lit(agg).alias("aggregate"),
                 F.col(f"{stat}_total").alias("total"), F.col(f"{stat}_matches").alias("n"))
        for kpi, src, stat, agg, *_ in metrics])
    minutes = F.col("n") * F.lit(m.match_minutes)
    rate = F.when(F.col("aggregate") == "per90", S.per90("total", minutes)).otherwise(S.ratio("total", "n"))
    is_cur = F.col("season_id") == cur
    is_prev = F.lit(False) if prev is None else F.col("season_id") == prev
    rows = (team_totals.withColumn("slot", F.when(is_cur, F.lit("cur")).when(is_prev, F.lit("prev")))
            .filter("slot is not null")
            .select("team_id", "slot", "source", "as_of", F.inline(items))
            .filter((F.col("source") == F.col("kpi_source")) & F.col("total").isNotNull() & (F.col("n") > 0))
            .withColumn("rate", rate))

    def slot(name: str, c: str) -> Column:
        return F.max(F.when(F.col("slot") == name, F.col(c)))

    wide = rows.groupBy("team_id", "kpi", "source").agg(*[
        slot(s, c).alias(f"{c}_{s}") for s in ("cur", "prev") for c in ("rate", "n", "as_of")])
    n_cur, n_prev = (F.coalesce(F.col(f"n_{s}"), F.lit(0)) for s in ("cur", "prev"))
    b = S.blend("rate_cur", n_cur * m.match_minutes, "rate_prev", n_prev * m.match_minutes,
                lam=m.blend_lambda, cap=m.prev_minutes_cap)
    used = F.col("b.used_previous")
    return wide.withColumn("b", b).filter("b.rate is not null").select(
        "team_id", "kpi", F.col("b.rate").alias("value"), n_cur.alias("matches"),
        F.when(used, n_prev).otherwise(F.lit(0)).alias("previous_matches"),
        F.col("b.minutes").alias("effective_minutes"), "source",
        F.greatest("as_of_cur", F.when(used, F.col("as_of_prev"))).alias("as_of"))


def team_percentiles(rates: DataFrame, clubs: DataFrame) -> DataFrame:
    """League percentile per team KPI; one row per club and KPI is ranked."""
    better = catalogue.literal_map({row[0]: row[4] for row in catalogue.TEAM_KPIS})
    score = F.when(better[F.col("kpi")], F.col("value")).otherwise(-F.col("value"))
    by_kpi = W.partitionBy("kpi")
    return (rates.join(clubs.select("team_id"), "team_id", "left_semi").withColumn("score", score)
            .withColumn("percentile", F.lit(100.0) * F.percent_rank().over(by_kpi.orderBy("score")))
            .withColumn("n_peers", F.count(F.lit(1)).over(by_kpi)).drop("score"))


def team_needs(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """Team KPIs where a club trails the benchmark's mean percentile."""
    member = members.select("team_id").distinct().withColumn("__in", F.lit(1))
    bench = (ranked.join(member, "team_id").groupBy("kpi").agg(
        F.sum("percentile").alias("__p"), F.sum("value").alias("__v"), F.count(F.lit(1)).alias("__n")))
    rows = ranked.join(bench, "kpi").join(member, "team_id", "left")
    own = F.when(F.col("__in").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    n = F.col("__n") - own
    groups = F.create_map(*[x for row in catalogue.TEAM_KPIS
                            for x in (F.lit(row[0]), F.array(*[F.lit(g) for g in row[5]]))])
    return (rows.withColumn("benchmark_clubs", n)
            .withColumn("benchmark_percentile", S.ratio(F.col("__p") - own * F.col("percentile"), n))
            .withColumn("benchmark_value", S.ratio(F.col("__v") - own * F.col("value"), n))
            .withColumn("gap", _snap(F.col("benchmark_percentile") - F.col("percentile")))
            .filter(F.col("gap") > 0)
            .withColumn("responsible_groups", groups[F.col("kpi")])
            .drop("__p", "__v", "__n", "__in"))


def style_vectors(rates: DataFrame, clubs: DataFrame) -> DataFrame:
    """Raw and standardised style features per club of the league (NULL when unknown)."""
    names = [f[0] for f in catalogue.STYLE_FEATURES]
    raw = (rates.join(clubs.select("team_id"), "team_id", "left_semi").groupBy("team_id")
           .agg(*[F.max(F.when(F.col("kpi") == n, F.col("value"))).alias(n) for n in names]))
    divided = {f[0]: F.when(F.col(f[4]) != 0, F.col(f[0]) / F.col(f[4]))
               for f in catalogue.STYLE_FEATURES if f[4]}
    return standardise(raw.withColumns(divided), names)


def style_fit(a: Sequence[Column], b: Sequence[Column], p: FitParams = FitParams()) -> Column:
    """Cosine over the dimensions both clubs have, mapped to 0-100."""
    both = [x.isNotNull() & y.isNotNull() for x, y in zip(a, b, strict=True)]
    zero = F.lit(0.0)

    def total(values: Sequence[Column]) -> Column:
        return sum((F.when(k, v).otherwise(zero) for k, v in zip(both, values, strict=True)), zero)

    shared = sum((k.cast("int") for k in both), F.lit(0))
    dot = total([x * y for x, y in zip(a, b, strict=True)])
    norm = F.sqrt(total([x * x for x in a])) * F.sqrt(total([y * y for y in b]))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm))
    return F.when((shared >= p.min_style_dimensions) & (norm > 0), F.lit(100.0) * (cosine + 1.0) / 2.0)


def squad_leaders(squads: DataFrame) -> DataFrame:
    return top_per(squads, ["team_id", "position_group"], [F.desc("minutes"), F.asc("player_id")])
