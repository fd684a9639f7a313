"""Percentiles, priors and peer counts over long KPI rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import common as C
from touchline.params import Methodology

_M = Methodology()


def eligible_for_rank(df: DataFrame, min_minutes: float = _M.percentile_min_minutes,
                      value: str = "value", minutes: str = "minutes") -> DataFrame:
    return df.filter((F.col(minutes) >= min_minutes) & F.col(value).isNotNull()
                     & F.col("position_group").isNotNull())


def oriented(value: str, higher: str = "higher_is_better"):
    """The value with its sign flipped for KPIs where lower is better."""
    return F.when(F.col(higher), F.col(value)).otherwise(-F.col(value))


def percentiles(kpi_values: DataFrame, min_minutes: float = _M.percentile_min_minutes,
                rows_per_bucket: int = C.ROWS_PER_BUCKET) -> DataFrame:
    """Eligible rows with ``percentile`` (0-100, higher is better) and ``n_peers``."""
    rows = eligible_for_rank(kpi_values, min_minutes).withColumn("score", oriented("value"))
    return C.percent_rank(rows, ["position_group", "kpi"], "score", percentile="percentile",
                          n_peers="n_peers", rows_per_bucket=rows_per_bucket).drop("score")


def weighted_prior(rates: DataFrame, value: str = "value",
                   minutes: str = "effective_minutes") -> DataFrame:
    """Exposure-weighted mean per (mode, group, KPI) over known values with minutes."""
    known = F.col(value).isNotNull() & (F.col(minutes) > 0)
    weight = F.sum(F.when(known, F.col(minutes)))
    return rates.groupBy("season_mode", "position_group", "kpi").agg(
        F.when(weight > 0, F.sum(F.when(known, F.col(value) * F.col(minutes))) / weight)
        .alias("prior"))


def n_peers_spread(features: DataFrame) -> DataFrame:
    """Group size on every row of (mode, group, KPI); 0 where nobody is eligible."""
    keys = ["season_mode", "position_group", "kpi"]
    peers = features.groupBy(*keys).agg(F.max("n_peers").alias("__n"))
    return (features.drop("n_peers").join(peers, keys)
            .withColumn("n_peers", F.coalesce(F.col("__n"), F.lit(0))).drop("__n"))


def add_shrunk(rows: DataFrame) -> DataFrame:
    """Rows with the value drawn to its group's prior; the few priors are written first, so the rows stay where they are."""
    keys = ["season_mode", "position_group", "kpi"]
    return (rows.join(C.stage(weighted_prior(rows), "priors"), keys, "left")
            .withColumn("shrunk", S.shrink("value", "effective_minutes", "prior", F.col("shrinkage_k")))
            .drop("prior"))


def add_percentiles(rows: DataFrame, min_minutes: float,
                    rows_per_bucket: int = C.ROWS_PER_BUCKET) -> DataFrame:
    """Percentile of the shrunk value per (mode, group, KPI), NULL for ineligible rows."""
    keys = ["season_mode", "position_group", "kpi"]
    eligible = (F.col("effective_minutes") >= min_minutes) & F.col("shrunk").isNotNull()
    scored = rows.withColumn("__score", F.when(eligible, oriented("shrunk")))
    # Rows without a score have no rank to meet; they go around the join, or they would all meet in one task.
    has = scored.filter(F.col("__score").isNotNull())
    table = C.score_table(has, keys, "__score", rows_per_bucket)
    pct = F.when(F.col("n_total") > 1, F.lit(100.0) * (F.col("n_less") / (F.col("n_total") - 1)))
    ranks = table.select(*keys, "__score", F.coalesce(pct, F.lit(0.0)).alias("percentile"))
    peers = C.stage(scored.groupBy(*keys).agg(F.count("__score").alias("n_peers")), "peers")
    without = scored.filter(F.col("__score").isNull()).withColumn("percentile", F.lit(None).cast("double"))
    return has.join(ranks, [*keys, "__score"]).unionByName(without).join(peers, keys).drop("__score")
