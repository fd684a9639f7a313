"""Every need's shortlist in one job: filters, FitScore, upgrade gate, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.functions import scalars as S
from touchline.operators import needs as N
from touchline.operators.common import top_per
from touchline.params import Filters, FitParams

HIDDEN_GATES = ("sideways", "insufficient_data")
STYLE = [f"{f[0]}_z" for f in catalogue.STYLE_FEATURES]


def group_weight_map() -> Column:
    """position group -> map of KPI weights, as a constant."""
    return F.create_map(*[x for g, ws in catalogue.GROUP_WEIGHTS.items()
                          for x in (F.lit(g), catalogue.literal_map(ws))])


def weighted_percentile(percentiles: Column, weights: Column) -> Column:
    """Mean percentile over the weighted KPIs that have one; NULL without evidence."""
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w"))

    def step(acc: Column, entry: Column) -> Column:
        p = F.try_element_at(percentiles, entry["key"])
        use = p.isNotNull() & (entry["value"] > 0)
        return F.struct((acc["t"] + F.when(use, entry["value"] * p).otherwise(F.lit(0.0))).alias("t"),
                        (acc["w"] + F.when(use, entry["value"]).otherwise(F.lit(0.0))).alias("w"))

    return F.aggregate(F.map_entries(weights), start, step,
                       lambda acc: F.when(acc["w"] > 0, acc["t"] / acc["w"]))


def player_evidence(features: DataFrame) -> DataFrame:
    """Per player: percentiles by KPI of their group (at most the catalogue) and minutes."""
    rows = features.join(N.weights_frame(features).select("position_group", "kpi"), ["position_group", "kpi"])
    return rows.groupBy("player_id").agg(
        F.map_from_entries(F.collect_list(F.struct("kpi", "percentile"))).alias("percentiles"),
        F.max(F.coalesce("effective_minutes", F.lit(0.0))).alias("effective_minutes"))


def deficits(gaps: DataFrame) -> DataFrame:
    """Per club x group: weight x gap of each KPI it trails on."""
    short = F.when((F.col("gap") > 0) & (F.col("weight") > 0),
                   F.struct("kpi", (F.col("weight") * F.col("gap")).alias("w")))
    return gaps.groupBy("team_id", "position_group").agg(
        F.map_from_entries(F.collect_list(short)).alias("deficits"))


def aligned(values: Column, group: Column) -> Column:
    """Values of a map by KPI as an array in the order of the group's weights."""
    names = F.create_map(*[x for g, ws in catalogue.GROUP_WEIGHTS.items() for x in (F.lit(g), F.array(*[F.lit(k) for k in ws]))])
    return F.transform(F.try_element_at(names, group), lambda k: F.try_element_at(values, k))


def aligned_mean(percentiles: Column, weights: Column) -> Column:
    """``weighted_percentile`` over aligned arrays: plain arithmetic, for the many rows of pairs."""
    parts = []
    for i in range(max(map(len, catalogue.GROUP_WEIGHTS.values()))):
        p, w = F.get(percentiles, F.lit(i)), F.get(weights, F.lit(i))
        parts.append((p.isNotNull() & (w > 0), p, w))
    total = sum((F.when(use, w * p).otherwise(F.lit(0.0)) for use, p, w in parts), F.lit(0.0))
    weight = sum((F.when(use, w).otherwise(F.lit(0.0)) for use, _p, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def needs_with_incumbents(gaps: DataFrame, squads: DataFrame, evidence: DataFrame,
                          styles: DataFrame) -> DataFrame:
    """One row per club x group: what a candidate's percentiles are weighted by (the deficits, or the group's
    weights when there is none), the incumbent's NeedFill and the club's style."""
    lead = (N.squad_leaders(squads.filter(F.col("position_group").isNotNull()))
            .select("team_id", "position_group", F.col("player_id").alias("incumbent_id"))
            .join(evidence.select(F.col("player_id").alias("incumbent_id"),
                                  F.col("percentiles").alias("incumbent_pct")), "incumbent_id", "left"))
    club_style = styles.select("team_id", *[F.col(c).alias(f"club_{c}") for c in STYLE])
    rows = (deficits(gaps).join(lead, ["team_id", "position_group"], "left")
            .join(club_style, "team_id", "left"))
    group = F.col("position_group")
    weights = F.when(F.size("deficits") > 0, F.col("deficits")).otherwise(F.try_element_at(group_weight_map(), group))
    fill = aligned_mean(aligned(F.col("incumbent_pct"), group), F.col("fill_weights"))
    return (rows.withColumn("fill_weights", aligned(weights, group))
            .withColumn("incumbent_need_fill", fill).drop("incumbent_pct", "deficits"))


def candidate_rows(profiles: DataFrame, evidence: DataFrame, values: DataFrame,
                   styles: DataFrame, as_of: Column) -> DataFrame:
    """One row per current player with everything scoring needs."""
    value = values.select("player_id", "value_eur", "tm_last_updated",
                          F.col("source").alias("value_source"), "is_stale")
    style = styles.select(F.col("team_id").alias("current_team_id"), *STYLE)
    return (profiles.filter(F.col("position_group").isNotNull())
            .join(evidence, "player_id", "left").join(value, "player_id", "left")
            .join(style, "current_team_id", "left").withColumn("age", S.age_on("birth_date", as_of)))


def own_scores(candidates: DataFrame, p: FitParams = FitParams()) -> DataFrame:
    """What the score of a candidate takes from the candidate alone, reckoned once and not for every club."""
    pct, group = F.col("percentiles"), F.col("position_group")
    windows = {g: F.array(*[F.lit(float(x)) for x in w]) for g, w in catalogue.PEAK_AGE.items()}
    window = F.try_element_at(F.create_map(*[x for g, w in windows.items() for x in (F.lit(g), w)]), group)
    return candidates.withColumns({
        "pct": aligned(pct, group),
        "role_quality": weighted_percentile(pct, F.try_element_at(group_weight_map(), group)),
        "reliability": S.reliability("effective_minutes", "fpl_status", "chance_of_playing", p),
        "age_profile": S.age_profile("age", window[0], window[1], p.penalty_per_year),
    }).drop("percentiles")


def score(needs: DataFrame, candidates: DataFrame, p: FitParams = FitParams(),
          pairs: DataFrame | None = None) -> DataFrame:
    """Candidates against clubs' needs in their group (``assess``).

    ``pairs`` (``team_id, player_id``) asks for those assessments alone; without it every candidate
    meets every need of the group.
    """
    candidates = own_scores(candidates, p)
    if pairs is None:
        rows = needs.join(candidates, "position_group")
    else:
        rows = candidates.join(pairs.select("team_id", "player_id").distinct(), "player_id").join(needs, ["team_id", "position_group"])
    # Generated columns: filters on the score or the gate read them, they do not repeat the arithmetic behind them.
    rows = rows.select("*", F.inline(F.array(F.struct(
        aligned_mean(F.col("pct"), F.col("fill_weights")).alias("need_fill"),
        N.style_fit([F.col(c) for c in STYLE], [F.col(f"club_{c}") for c in STYLE], p).alias("style_fit")))))
    components = {n: F.col(n) for n in catalogue.FIT_WEIGHTS}
    return (rows.withColumn("fit", S.fit_score(components))
            .withColumn("fit_score", F.col("fit.total"))
            .withColumn("gate", S.upgrade_gate("need_fill", "incumbent_need_fill", p.upgrade_delta))
            .withColumn("same_club", F.col("team_id") == F.col("current_team_id")))


def filter_reason(f: Filters) -> Column:
    """First hard filter a candidate fails, or NULL."""
    out = F.when(F.col("fpl_status").isin(*f.excluded_statuses), F.lit("unavailable"))
    if f.exclude_team_ids:
        out = out.when(F.col("current_team_id").isin(*f.exclude_team_ids), F.lit("excluded club"))
    if f.min_age is not None or f.max_age is not None:
        out = out.when(F.col("age").isNull(), F.lit("age unknown"))
        outside = F.lit(False)
        if f.min_age is not None:
            outside = outside | (F.col("age") < f.min_age)
        if f.max_age is not None:
            outside = outside | (F.col("age") > f.max_age)
        out = out.when(outside, F.lit("outside age range"))
    if f.min_minutes is not None:
        out = out.when(F.coalesce("effective_minutes", F.lit(0.0)) < f.min_minutes, F.lit("too few minutes"))
    if f.max_value_eur is not None:
        out = out.when(F.col("value_eur").isNull(), F.lit("no market value"))
        out = out.when(F.col("value_eur") > f.max_value_eur, F.lit("over budget"))
    return out


def hard_filters(candidates: DataFrame, f: Filters) -> DataFrame:
    return candidates.withColumn("reason", filter_reason(f))


def gate_visibility(scored: DataFrame, include_sideways: bool = False) -> DataFrame:
    """Candidates the upgrade gate leaves on the list."""
    return scored if include_sideways else scored.filter(~F.col("gate").isin(*HIDDEN_GATES))


def filtered_counts(needs: DataFrame, candidates: DataFrame, f: Filters) -> DataFrame:
    """``team_id, position_group, reason, n``: how the hard filters judge other clubs' candidates.

    The reason depends on the candidate alone, so candidates are counted per group and reason and the
    club's own are taken off; clubs and candidates are never paired. ``reason`` is NULL for survivors.
    """
    judged = hard_filters(candidates.filter(F.col("current_team_id").isNotNull()), f).withColumn("reason", F.coalesce("reason", F.lit("")))
    every = judged.groupBy("position_group", "reason").agg(F.count(F.lit(1)).alias("every"))
    own = judged.groupBy(F.col("current_team_id").alias("team_id"), "position_group", "reason").agg(F.count(F.lit(1)).alias("own"))
    return (needs.select("team_id", "position_group").join(every, "position_group")
            .join(own, ["team_id", "position_group", "reason"], "left")
            .withColumn("n", F.col("every") - F.coalesce("own", F.lit(0))).filter("n > 0")
            .select("team_id", "position_group", F.nullif("reason", F.lit("")).alias("reason"), "n"))


def topk_shortlist(scored: DataFrame, k: int, score_col: str = "fit_score") -> DataFrame:
    """Best k candidates per need, ties by player id; each map task keeps only its own k."""
    return top_per(scored.filter(F.col(score_col).isNotNull() & ~F.isnan(score_col)),
                   ["team_id", "position_group"], [F.desc(score_col), F.asc("player_id")], k,
                   rank="rank")


def recommend(needs: DataFrame, candidates: DataFrame, f: Filters = Filters(),
              p: FitParams = FitParams()) -> tuple[DataFrame, DataFrame]:
    """(shortlist, counts of excluded candidates per reason) for every need.

    Candidates that a hard filter leaves out are counted per group and never meet a need; only
    survivors are scored, and nothing is written in between.
    """
    survivors = hard_filters(candidates, f).filter(F.col("reason").isNull()).drop("reason")
    rows = score(needs, survivors, p).filter(~F.col("same_club"))
    hidden = F.lit(False) if f.include_sideways else F.col("gate").isin(*HIDDEN_GATES)
    lost = {"no evidence": F.col("fit_score").isNull(), "sideways move": F.col("fit_score").isNotNull() & hidden}
    short = topk_shortlist(rows.filter(~hidden), f.limit)
    late = (rows.groupBy("team_id", "position_group").agg(F.array(*[
        F.struct(F.lit(reason).alias("reason"), F.count_if(hit).alias("n")) for reason, hit in lost.items()]).alias("lost"))
        .select("team_id", "position_group", F.inline("lost")).filter("n > 0"))
    return short, filtered_counts(needs, candidates, f).filter(F.col("reason").isNotNull()).unionByName(late)
