"""From season totals to the long feature table: rates, blend, shrink, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.functions import scalars as S
from touchline.operators import common as C
from touchline.operators import features as FE
from touchline.params import Methodology

# Where each KPI family's current and previous season totals come from.
FAMILY_SOURCES = {"fpl": ("fpl", "vaastav"), "understat": ("understat", "understat")}
SLOTS = [(family, slot) for family in FAMILY_SOURCES for slot in ("cur", "prev")]


def _slot(season_id: str, source: str, cur, prev) -> Column:
    """'<family>_<cur|prev>' of a totals row, or NULL when no KPI uses it."""
    out = None
    for family, (src_cur, src_prev) in FAMILY_SOURCES.items():
        for name, season, src in (("cur", cur, src_cur), ("prev", prev, src_prev)):
            hit = (F.col(season_id) == season) & (F.col(source) == src)
            value = F.lit(f"{family}_{name}")
            out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


# Season totals each KPI family reads.
FAMILY_TOTALS = {
    "fpl": ["minutes", "xgc_on_pitch", "yellow_cards", "red_cards", "saves", "goals_conceded"],
    "understat": ["minutes", "xg_buildup", "xg_chain", "xa", "npxg", "key_passes", "shots", "goals",
                  "xg"],
}


def season_slots(totals: DataFrame, padj: DataFrame, cur, prev) -> DataFrame:
    """One row per player with the totals of every (family, season) slot side by side."""
    t = totals.withColumn("slot", _slot("season_id", "source", cur, prev)).filter("slot is not null")
    wide = t.groupBy("player_id").agg(*[
        F.sum(F.when(F.col("slot") == f"{f}_{s}", F.col(c).cast("double"))).alias(f"{f}_{s}__{c}")
        for f, s in SLOTS for c in FAMILY_TOTALS[f]
    ], *[F.max(F.when(F.col("slot").startswith(f), F.col("fetched_at"))).alias(f"{f}__as_of")
         for f in FAMILY_SOURCES])
    p = padj.withColumn("slot", _slot("season_id", "source", cur, prev)).filter("slot is not null")
    padj_cols = [f"{c}_padj" for c in catalogue.PADJ_STATS]
    wide_padj = p.groupBy("player_id").agg(*[
        F.sum(F.when(F.col("slot") == f"fpl_{s}", F.col(c).cast("double"))).alias(f"fpl_{s}__{c}")
        for s in ("cur", "prev") for c in padj_cols
    ], F.sum("matches").alias("padj_n"), F.sum("unadjusted_matches").alias("padj_missing"))
    return wide.join(wide_padj, "player_id", "left")


def kpi_rates(slots: DataFrame, players: DataFrame) -> DataFrame:
    """Long rows: every player with a position group x every KPI, both seasons' rates."""
    people = players.filter(F.col("position_group").isNotNull()).select("player_id", "position_group")
    wide = people.join(slots, "player_id", "left")
    cbi = F.col("position_group").isin(*catalogue.CBI_GROUPS)

    def rate(kpi: str, family: str, slot: str) -> Column:
        f = catalogue.FORMULAS[kpi]

        def get(c: str) -> Column:
            return F.col(f"{family}_{slot}__{c}")

        top = f.numerator(get, cbi)
        if f.denominator is not None:
            return S.ratio(top, f.denominator(get))
        return S.per90(top, get("minutes"))

    items = []
    for kpi, family, higher, proxy, k, _label in catalogue.KPIS:
        status = (S.padj_status("padj_n", "padj_missing") if catalogue.FORMULAS[kpi].padj
                  else F.lit(None).cast("string"))
        items.append(F.struct(
            F.lit(kpi).alias("kpi"), F.lit(family).alias("source"),
            rate(kpi, family, "cur").alias("rate_cur"), rate(kpi, family, "prev").alias("rate_prev"),
            F.coalesce(F.col(f"{family}_cur__minutes"), F.lit(0.0)).alias("minutes"),
            F.coalesce(F.col(f"{family}_prev__minutes"), F.lit(0.0)).alias("minutes_prev"),
            F.lit(higher).alias("higher_is_better"), F.lit(proxy).alias("is_proxy"),
            F.lit(float(k)).alias("shrinkage_k"), status.alias("padj_status"),
            F.col(f"{family}__as_of").alias("as_of")))
    return wide.select("player_id", "position_group", F.inline(F.array(*items)))


def season_modes(rates: DataFrame, m: Methodology = Methodology()) -> DataFrame:
    """Two rows per KPI row: blended with last season, and this season alone."""
    b = S.blend("rate_cur", "minutes", "rate_prev", "minutes_prev", lam=m.blend_lambda,
                cap=m.prev_minutes_cap)
    alone = F.when(F.col("rate_cur").isNotNull(), F.col("minutes")).otherwise(F.lit(0.0))
    modes = F.array(
        F.struct(F.lit("blended").alias("season_mode"), F.col("b.rate").alias("value"),
                 F.col("b.minutes").alias("effective_minutes"),
                 F.col("b.used_previous").alias("used_previous_season")),
        F.struct(F.lit("current").alias("season_mode"), F.col("rate_cur").alias("value"),
                 alone.alias("effective_minutes"), F.lit(False).alias("used_previous_season")))
    keep = [c for c in rates.columns if c not in ("rate_cur", "rate_prev", "minutes_prev")]
    return rates.withColumn("b", b).select(
        *keep, F.col("rate_cur").alias("raw_p90"), F.inline(modes))


def features(totals: DataFrame, padj: DataFrame, players: DataFrame, cur, prev,
             m: Methodology = Methodology(), **rank) -> DataFrame:
    """The long feature table: one row per player x season mode x KPI.

    Priors, ranks and peer counts each read all rates, so the rates are written once instead
    of being recomputed from the facts for every one of them.
    """
    rows = season_modes(kpi_rates(season_slots(totals, padj, cur, prev), players), m)
    rows = C.stage(rows, "kpi-rates")
    return FE.add_percentiles(FE.add_shrunk(rows), m.percentile_min_minutes, **rank)
