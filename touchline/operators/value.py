"""Stats-implied value: training frames, boosted trees, calibrated band and labels."""

from __future__ import annotations

import ast
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.functions import scalars as S
from touchline.operators import common as C
from touchline.params import ValueParams

_V = ValueParams()
MISSING = -999.0  # outside every feature's range; an indicator column says so as well


def training_frame(labelled: DataFrame, v: ValueParams = _V) -> DataFrame:
    """Labelled past player-seasons with enough minutes."""
    return labelled.filter(F.col("log_value").isNotNull() & (F.col("minutes") >= v.min_minutes))


def scoring_frame(rows: DataFrame, values: DataFrame, v: ValueParams = _V) -> DataFrame:
    """Current players with a value; age is taken on the value's own date."""
    chosen = values.select("player_id", "value_eur", F.col("tm_last_updated").alias("value_date"),
                           F.col("source").alias("value_source"), F.col("is_stale").alias("value_is_stale"))
    out = rows.drop("value_eur", "value_date", "value_source").join(chosen, "player_id")
    return (out.withColumn("age", S.age_on("birth_date", "value_date"))
            .filter(F.col("position_group").isNotNull() & (F.col("effective_minutes") >= v.min_minutes)))


def feature_names(stats: Sequence[str] = _V.stats) -> list[str]:
    return ["age", "age_sq", "minutes_share", "team_ppg", *[f"{s}_p90" for s in stats], "group_code"]


def feature_columns(df: DataFrame, stats: Sequence[str] = _V.stats) -> DataFrame:
    """Adds the derived model inputs; an unknown value stays NULL."""
    codes = catalogue.literal_map({g: float(i) for i, g in enumerate(catalogue.GROUPS)})
    return (df.withColumn("age_sq", F.col("age") * F.col("age"))
            .withColumn("group_code", F.try_element_at(codes, F.col("position_group"))))


def informative_columns(df: DataFrame, stats: Sequence[str] = _V.stats) -> DataFrame:
    """Columns with at least two distinct known values: min and max differ."""
    names = feature_names(stats)
    probe = feature_columns(df, stats).agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"{c}.lo") < F.col(f"{c}.hi")).alias("kept")) for c in names])
    return probe.select(F.inline(rows)).select("feature", F.coalesce("kept", F.lit(False)).alias("kept"))


def feature_matrix(df: DataFrame, kept: Sequence[str], stats: Sequence[str] = _V.stats) -> DataFrame:
    """Model inputs ``x_*`` and their missing flags ``m_*`` for the kept columns."""
    rows = feature_columns(df, stats)
    return rows.withColumns({**{f"x_{c}": F.coalesce(F.col(c), F.lit(MISSING)) for c in kept},
                             **{f"m_{c}": F.col(c).isNull().cast("double") for c in kept}})


def age_bucketed(df: DataFrame, v: ValueParams = _V) -> DataFrame:
    return df.withColumn("bucket", S.age_bucket("age", v.age_edges))


def grouped_quantiles(df: DataFrame, score: str, wanted: dict[str, float], v: ValueParams = _V) -> DataFrame:
    """Quantiles of a score per (group, bucket), per group and overall, as one long table.

    Every row is counted at its three levels, so one rank table serves them all.
    """
    rows = age_bucketed(df, v) if "bucket" not in df.columns else df
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def level(name: str, group: Column, bucket: Column) -> Column:
        return F.struct(F.lit(name).alias("level"), group.alias("position_group"), bucket.alias("bucket"))

    levels = F.array(level("cell", F.col("position_group"), F.col("bucket")),
                     level("group", F.col("position_group"), none_i), level("all", none_s, none_i))
    spread_ = rows.select(score, F.inline(levels)).filter("level != 'cell' or bucket is not null")
    return C.quantiles(spread_, ["level", "position_group", "bucket"], score, wanted)


def baseline_medians(train: DataFrame, v: ValueParams = _V) -> DataFrame:
    return grouped_quantiles(train, "log_value", {"median": 0.5}, v).drop("level")


def with_fallback(df: DataFrame, table: DataFrame, values: Sequence[str], v: ValueParams = _V) -> DataFrame:
    """Attach (group, bucket) values, else the group's, else the overall ones."""
    g, b = F.col("position_group"), F.col("bucket")
    out = age_bucketed(df, v) if "bucket" not in df.columns else df
    levels = [("c", table.filter(b.isNotNull()), ["position_group", "bucket"]),
              ("g", table.filter(b.isNull() & g.isNotNull()), ["position_group"])]
    for name, rows, keys in levels:
        out = out.join(rows.select(*keys, *[F.col(x).alias(f"__{name}_{x}") for x in values]), keys, "left")
    # The overall values are one row: a scalar subquery, so the rows are not moved to meet it.
    overall = table.filter(g.isNull()).agg(F.max(F.struct(*values)).alias("s")).scalar()
    out = out.withColumn("__a", overall)
    return (out.withColumns({x: F.coalesce(f"__c_{x}", f"__g_{x}", F.col(f"__a.{x}")) for x in values})
            .drop("__a", *[f"__{n}_{x}" for n in "cg" for x in values]))


def error_metrics(pred: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Mean absolute error on the log scale and the median absolute % error."""
    rows = pred.withColumn("__d", F.abs(F.col(yhat) - F.col(y))).withColumn(
        "__p", F.abs(F.exp(F.col(yhat) - F.col(y)) - 1.0)).withColumn("every", F.lit(1))
    med = C.median(rows, ["every"], "__p", "median_abs_pct_error")
    return rows.groupBy("every").agg(F.avg("__d").alias("mae_log")).join(med, "every").drop("every")


def value_band(pred: DataFrame, residuals: DataFrame, v: ValueParams = _V) -> DataFrame:
    """Point prediction plus residual quantiles of the (group, age bucket), in order.

    ``pred`` has yhat; ``residuals`` has position_group, age and residual (y - yhat).
    """
    return band_from(pred, residual_quantiles(residuals, v), v)


def residual_quantiles(residuals: DataFrame, v: ValueParams = _V) -> DataFrame:
    return grouped_quantiles(residuals, "residual", {"__lo": v.low_quantile, "__hi": v.high_quantile}, v)


def band_from(pred: DataFrame, table: DataFrame, v: ValueParams = _V) -> DataFrame:
    """``value_band`` from the residual quantiles."""
    out = with_fallback(pred, table, ["__lo", "__hi"], v)
    ordered = F.array_sort(F.array(F.col("yhat") + F.least("__lo", "__hi"), F.col("yhat"), F.col("yhat") + F.greatest("__lo", "__hi")))
    return (out.withColumn("__b", ordered).withColumns({
        "low": F.col("__b")[0], "mid": F.col("__b")[1], "high": F.col("__b")[2]}).drop("__b", "__lo", "__hi"))


def conformal_adjust(calib: DataFrame, coverage: float, y: str = "y") -> DataFrame:
    """How far to widen [low, high] so it covers ``coverage`` of the calibration rows.

    The ceil((n + 1) * coverage)-th smallest of max(low - y, y - high), at most the largest.
    """
    score = F.greatest(F.col("low") - F.col(y), F.col(y) - F.col("high"))
    nth = F.least(F.ceil((F.col("n_total") + 1) * F.lit(coverage)), F.col("n_total"))
    rows = calib.withColumn("__s", score).withColumn("every", F.lit(1))
    return C.nth_smallest(rows, ["every"], "__s", nth, "adjustment").select("adjustment")


def coverage(df: DataFrame, y: str = "y") -> DataFrame:
    inside = (F.col(y) >= F.col("low")) & (F.col(y) <= F.col("high"))
    return df.agg(F.avg(inside.cast("double")).alias("share"))


def widen(df: DataFrame, adjustment: float | Column) -> DataFrame:
    a = F.lit(adjustment) if isinstance(adjustment, float) else adjustment
    ordered = F.array_sort(F.array(F.col("low") - a, F.col("mid"), F.col("high") + a))
    return df.withColumn("__b", ordered).withColumns({
        "low": F.col("__b")[0], "mid": F.col("__b")[1], "high": F.col("__b")[2]}).drop("__b")


def score_players(banded: DataFrame) -> DataFrame:
    """Euro values and the label of the market value against the band."""
    return (banded.withColumn("implied_value_eur", F.exp("mid")).withColumn("band_low_eur", F.exp("low"))
            .withColumn("band_high_eur", F.exp("high"))
            .withColumn("value_label", S.band_label(F.col("value_eur").cast("double"), "band_low_eur", "band_high_eur")))


@dataclass
class ValueModel:
    """Fitted trees, residual table and held-out evaluation."""

    columns: list[str]
    model: PipelineModel
    residuals: DataFrame
    adjustment: float
    metrics: dict[str, float]
    train_seasons: list[str]
    test_season: str
    params: ValueParams = field(default_factory=ValueParams)

    def predict(self, rows: DataFrame) -> DataFrame:
        x = feature_matrix(rows, self.columns, self.params.stats)
        return self.model.transform(x).drop("features", *[f"{p}_{c}" for c in self.columns for p in "xm"])


def _fit(train: DataFrame, v: ValueParams) -> tuple[list[str], PipelineModel]:
    kept = [r["feature"] for r in informative_columns(train, v.stats).collect() if r["kept"]]
    if not kept:
        raise ValueError("no feature has two distinct known values; cannot fit")
    assembler = VectorAssembler(inputCols=[f"{p}_{c}" for p in "xm" for c in kept], outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol="log_value", predictionCol="yhat", seed=v.seed,
                         maxIter=v.max_iter, maxDepth=4, stepSize=v.step, checkpointInterval=20)
    return kept, Pipeline(stages=[assembler, trees]).fit(feature_matrix(train, kept, v.stats))


def value_model(frame: DataFrame, v: ValueParams = _V) -> ValueModel:
    """Evaluate on the latest season held out, then refit on every season.

    The season list has one row per season; metrics are single numbers.
    """
    frame = C.stage(frame, "value-frame")
    seasons = sorted(r["season_id"] for r in frame.select("season_id").distinct().collect())
    if len(seasons) < 2:
        raise ValueError(f"need labelled rows from at least 2 seasons, got {seasons}")
    train = frame.filter(F.col("season_id") != seasons[-1])
    test = frame.filter(F.col("season_id") == seasons[-1])
    (kept, model), (all_kept, all_model) = C.together(lambda: _fit(train, v), lambda: _fit(frame, v))
    held = ValueModel(kept, model, train, 0.0, {}, seasons[:-1], seasons[-1], v)
    residuals = held.predict(train).withColumn("residual", F.col("log_value") - F.col("yhat"))
    pred = held.predict(test).withColumn("y", F.col("log_value"))
    banded = C.stage(value_band(pred, residuals, v), "value-banded")
    adjustment = conformal_adjust(banded, v.high_quantile - v.low_quantile).first()["adjustment"]
    base = with_fallback(test.withColumn("y", F.col("log_value")), baseline_medians(train, v), ["median"], v)
    m, b = error_metrics(banded).first(), error_metrics(base, "y", "median").first()
    metrics = {
        "mae_log": m["mae_log"], "median_abs_pct_error": m["median_abs_pct_error"],
        "baseline_mae_log": b["mae_log"], "baseline_median_abs_pct_error": b["median_abs_pct_error"],
        "improvement_pct": 100.0 * (1.0 - m["mae_log"] / b["mae_log"]) if b["mae_log"] else 0.0,
        "band_coverage": coverage(banded).first()["share"], "band_adjustment": adjustment,
        "calibrated_coverage": coverage(widen(banded, float(adjustment))).first()["share"],
        "n_train": float(train.count()), "n_test": float(test.count()),
    }
    final = ValueModel(all_kept, all_model, frame, float(adjustment), metrics, seasons[:-1], seasons[-1], v)
    final.residuals = final.predict(frame).withColumn("residual", F.col("log_value") - F.col("yhat"))
    return final


def score_with(model: ValueModel, frame: DataFrame) -> DataFrame:
    """Implied value, calibrated band and label for a scoring frame."""
    banded = value_band(model.predict(frame), model.residuals, model.params)
    return score_players(widen(banded, model.adjustment))


def band_table(model: ValueModel) -> DataFrame:
    """What scoring needs beside the trees: residual quantiles per level and the calibration, a row per level."""
    return residual_quantiles(model.residuals, model.params).withColumnsRenamed({"__lo": "low", "__hi": "high"}).withColumn("adjustment", F.lit(model.adjustment))


def score_saved(spark: SparkSession, path: str, frame: DataFrame, v: ValueParams = _V) -> DataFrame:
    """``score_with`` from a saved model, its metadata and band table."""
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/metadata").collect()}
    columns = [c for c in feature_names(v.stats) if c in ast.literal_eval(meta["features"])]
    band = spark.read.parquet(f"{path}/band")
    adjustment = band.agg(F.max("adjustment")).first()[0]
    trees = ValueModel(columns, PipelineModel.load(f"{path}/model"), band, adjustment, {}, [], "", v)
    table = band.drop("adjustment").withColumnsRenamed({"low": "__lo", "high": "__hi"})
    return score_players(widen(band_from(trees.predict(frame), table, v), adjustment))


def metadata(model: ValueModel) -> dict[str, object]:
    return {"features": model.columns, "train_seasons": model.train_seasons, "test_season": model.test_season,
            "seed": model.params.seed, **{k: (None if isinstance(v, float) and math.isnan(v) else v)
                                          for k, v in model.metrics.items()}}
