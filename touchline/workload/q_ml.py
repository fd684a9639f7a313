"""Similarity, role archetypes and the value model."""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.functions import scalars as S
from touchline.operators import careers as CA
from touchline.operators import common as C
from touchline.operators import roles as R
from touchline.operators import similarity as SI
from touchline.operators import totals as T
from touchline.operators import value as V
from touchline.params import MARKET_PRECEDENCE, RoleParams
from touchline.plans import training as TR
from touchline.sources import sinks as SK
from touchline.workload import bindings as B
from touchline.workload.q_careers import AGES, VALUE, blended_now, labelled, pairs
from touchline.workload.q_features import METHOD, staged_features
from touchline.workload.registry import query, r6, rounded
from touchline.workload.sqltext import view

ROLE_KPIS = R.role_kpis()
ROLES = RoleParams()


def blended_features(spark, sf):
    return staged_features(spark, sf).filter(F.col("season_mode") == "blended")


view("m_full", """SELECT player_id, position_group, kpi, shrunk, weight FROM (SELECT f.player_id, f.position_group, f.kpi, f.shrunk, w.weight,
    count(*) OVER (PARTITION BY f.player_id) AS have FROM f_features f JOIN v_weight w USING (position_group, kpi)
    WHERE f.season_mode = 'blended' AND w.weight > 0 AND f.percentile IS NOT NULL AND f.shrunk IS NOT NULL)
  JOIN (SELECT position_group, count(*) AS need FROM v_weight WHERE weight > 0 GROUP BY 1) USING (position_group) WHERE have = need""")
view("m_raw", """SELECT player_id, position_group, kpi, CASE WHEN sd > 0 THEN (shrunk - mean) / sd * sqrt(weight) ELSE 0 END AS x FROM m_full
  JOIN (SELECT position_group, kpi, avg(shrunk) AS mean, stddev_pop(shrunk) AS sd FROM m_full GROUP BY 1, 2) USING (position_group, kpi)""")
view("m_vec", """SELECT player_id, position_group, kpi, x / n AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY player_id)) AS n FROM m_raw) WHERE n > 0""")


@query("similarity_vectors", """SELECT player_id, position_group, row_number() OVER (PARTITION BY player_id ORDER BY kpi) - 1 AS place, round(x, 6) AS x FROM m_vec""")
def similarity_vectors(spark, sf):
    v = SI.similarity_vectors(blended_features(spark, sf))
    return v.select("player_id", "position_group", F.posexplode("vec").alias("place", "x")).withColumn(
        "place", F.col("place").cast("bigint")).withColumn("x", r6("x"))


@query("similarity_examples", """SELECT position_group, player_id, neighbour_id, rank, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY position_group ORDER BY similarity DESC, neighbour_id) AS rank FROM (
    SELECT q.position_group, q.player_id, v.player_id AS neighbour_id, round(sum(q.x * v.x), 9) AS similarity FROM (
      SELECT * FROM m_vec WHERE player_id IN (SELECT player_id FROM (SELECT player_id, row_number() OVER (PARTITION BY position_group ORDER BY m DESC, player_id) AS rn
        FROM (SELECT DISTINCT v.player_id, v.position_group, e.m FROM m_vec v JOIN (SELECT player_id, max(effective_minutes) AS m FROM f_features WHERE season_mode = 'blended' GROUP BY 1) e USING (player_id))) WHERE rn = 1)) q
    JOIN m_vec v ON v.position_group = q.position_group AND v.kpi = q.kpi AND v.player_id <> q.player_id GROUP BY 1, 2, 3)) WHERE rank <= 3""")
def similarity_examples(spark, sf):
    feats = blended_features(spark, sf)
    return rounded(SI.similarity_examples(SI.similarity_vectors(feats), feats).withColumn("rank", F.col("rank").cast("bigint")), "similarity")


view("m_emb", """SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")


@query("knn_similar", """SELECT player_id, neighbour_id, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY similarity DESC, neighbour_id) AS rank FROM (
  SELECT a.vec_id AS player_id, b.vec_id AS neighbour_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS similarity FROM m_emb a JOIN m_emb b
  ON a.label = b.label AND a.vec_id <> b.vec_id WHERE b.vec_id % 5 <> 0 AND a.n > 0 AND b.n > 0)) WHERE rank <= 10""")
def knn_similar(spark, sf):
    e = B.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("player_id"), F.col("label").cast("string").alias("position_group"),
        F.col("embedding").cast("array<double>").alias("raw"))
    current = e.filter(F.col("player_id") % 5 != 0).select("player_id")
    df = SI.knn_similar(SI.unit_vectors(e, "raw").drop("raw"), current, 10)
    return rounded(df.withColumn("rank", F.col("rank").cast("bigint")), "similarity")


_PIVOT = ", ".join(f"max(shrunk) FILTER (kpi = '{k}') AS {k}" for k in ROLE_KPIS)
_Z = ", ".join(f"coalesce(({k} - avg({k}) OVER ()) / nullif(stddev_pop({k}) OVER (), 0), 0) AS {k}" for k in ROLE_KPIS)
_OUTFIELD = ", ".join(f"'{g}'" for g in catalogue.OUTFIELD_GROUPS)
view("m_role", f"""SELECT player_id, {_Z} FROM (SELECT player_id, max(effective_minutes) AS m, {_PIVOT} FROM f_features
  WHERE season_mode = 'blended' AND position_group IN ({_OUTFIELD}) AND shrunk IS NOT NULL AND kpi IN ({', '.join(f"'{k}'" for k in ROLE_KPIS)}) GROUP BY 1)
  WHERE m >= 60 AND {' AND '.join(f'{k} IS NOT NULL' for k in ROLE_KPIS)}""")


def role_matrix_of(spark, sf):
    feats = blended_features(spark, sf).filter(F.col("position_group").isin(*catalogue.OUTFIELD_GROUPS))
    return R.role_matrix(feats, ROLE_KPIS, METHOD.roles_min_minutes)


@query("role_matrix", "SELECT player_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in ROLE_KPIS) + " FROM m_role")
def role_matrix(spark, sf):
    return rounded(role_matrix_of(spark, sf), *ROLE_KPIS)


def by_modulo(matrix, k):
    return matrix.select("player_id", (F.col("player_id") % k).cast("int").alias("cluster"))


_RUNS: dict[tuple, TR.TrainRun] = {}
_FITTED: set[tuple] = set()


def trained(spark, sf, *parts):
    """The training run over the whole tables: its models (both by default) are fitted once per session for all queries that read them."""
    key = B.version(spark, sf)
    run = _RUNS.setdefault(key, TR.TrainRun(B.TODAY, "blended", list(ROLE_KPIS)))
    fits = {"roles": lambda: partial(TR.train_roles, run, role_matrix_of(spark, sf), R.short_names(), ROLES),
            "value": lambda: partial(TR.train_value, run, training(spark, sf), scoring(spark, sf), VALUE)}
    todo = [part for part in parts or fits if (key, part) not in _FITTED]
    if todo:
        C.together(*[fits[part]() for part in todo])
        _FITTED.update((key, part) for part in todo)
    return run


@query("role_clusters")
def role_clusters(spark, sf):
    """Assignments of the chosen mixture with the BIC of every k next to them."""
    run = trained(spark, sf, "roles")
    bic = ", ".join(f"{k}: {v:.3f}" for k, v in sorted(run.roles.bic.items()))
    return run.assignments.withColumn("k", F.lit(run.roles.k)).withColumn("bic", F.lit(bic))


# One step of the mixture from a fixed start: three components of equal weight at -1, 0 and 1 in every KPI, variance 1.
STARTS = (-1.0, 0.0, 1.0)
_JOINT = ", ".join(f"-0.5 * ({' + '.join(f'({k} - {m}) * ({k} - {m})' for k in ROLE_KPIS)})" for m in STARTS)
view("m_joint", f"SELECT *, list_transform(j, lambda x: exp(x - list_max(j))) AS e FROM (SELECT *, [{_JOINT}] AS j FROM m_role)")
view("m_step", "SELECT c, sum(r) AS n, " + ", ".join(f"sum(r * {k}) / sum(r) AS {k}_m, sum(r * {k} * {k}) / sum(r) AS {k}_q" for k in ROLE_KPIS)
     + " FROM (SELECT *, e[c + 1] / list_sum(e) AS r FROM m_joint, (SELECT unnest(range(3)) AS c)) GROUP BY 1")
_STEP = " UNION ALL ".join(f"SELECT c, '{k}' AS kpi, n, {k}_m AS mean, greatest({k}_q - {k}_m * {k}_m, 0) + {ROLES.covariance_floor} AS variance FROM m_step" for k in ROLE_KPIS)


@query("role_em_step", f"SELECT CAST(c AS INT) AS cluster, kpi, round(n / sum(n) OVER (PARTITION BY kpi), 6) AS weight, round(mean, 6) AS mean, round(variance, 6) AS variance FROM ({_STEP})")
def role_em_step(spark, sf):
    """E and M step of the mixture over all players from a fixed start."""
    d = len(ROLE_KPIS)
    start = R.Mixture(np.full(3, 1 / 3), np.array([[m] * d for m in STARTS]), np.ones((3, d)))
    model, _ll, _n = R.em_step(R.with_vectors(role_matrix_of(spark, sf), ROLE_KPIS), start, ROLES)
    rows = [(i, k, float(model.weights[i]), float(model.means[i, j]), float(model.variances[i, j])) for i in range(3) for j, k in enumerate(ROLE_KPIS)]
    return rounded(spark.createDataFrame(rows, "cluster int, kpi string, weight double, mean double, variance double"), "weight", "mean", "variance")


_NAMES = R.short_names()
_CENTRES = " UNION ALL ".join(
    f"SELECT cluster, '{k}' AS kpi, '{_NAMES[k]}' AS name, {k} AS mean FROM m_centre" for k in ROLE_KPIS)
view("m_centre", "SELECT CAST(player_id % 6 AS INT) AS cluster, " + ", ".join(f"avg({k}) AS {k}" for k in ROLE_KPIS) + " FROM m_role GROUP BY 1")


@query("cluster_labels", f"""SELECT cluster, string_agg(CASE WHEN mean >= 0 THEN 'high ' ELSE 'low ' END || name, ', ' ORDER BY r) AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(mean) DESC, kpi) AS r FROM ({_CENTRES})) WHERE r <= 2 GROUP BY 1""")
def cluster_labels(spark, sf):
    m = C.stage(role_matrix_of(spark, sf), "role-matrix")
    return R.cluster_labels(m, by_modulo(m, 6), ROLE_KPIS, _NAMES)


@query("adjusted_rand", """SELECT round(CASE WHEN (ia + ib) / 2 = ia * ib / every THEN 1 ELSE (n - ia * ib / every) / ((ia + ib) / 2 - ia * ib / every) END, 6) AS ari FROM (SELECT
  (SELECT sum(c * (c - 1) / 2.0::DOUBLE) FROM (SELECT count(*) AS c FROM m_role GROUP BY player_id % 6, player_id % 4)) AS n,
  (SELECT sum(c * (c - 1) / 2.0::DOUBLE) FROM (SELECT count(*) AS c FROM m_role GROUP BY player_id % 6)) AS ia,
  (SELECT sum(c * (c - 1) / 2.0::DOUBLE) FROM (SELECT count(*) AS c FROM m_role GROUP BY player_id % 4)) AS ib,
  (SELECT count(*) * (count(*) - 1) / 2.0::DOUBLE FROM m_role) AS every)""")
def adjusted_rand(spark, sf):
    m = C.stage(role_matrix_of(spark, sf), "role-matrix")
    return rounded(R.adjusted_rand(by_modulo(m, 6), by_modulo(m, 4)), "ari")


_DIST = " + ".join(f"(a.{k} - b.{k}) * (a.{k} - b.{k})" for k in ROLE_KPIS)


@query("silhouette", f"""SELECT round(avg(CASE WHEN own <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
  SELECT player_id, max(cnt) FILTER (same) AS own, max(total / nullif(cnt - 1, 0)) FILTER (same) AS a, min(total / cnt) FILTER (NOT same) AS b FROM (
    SELECT a.player_id, b.player_id % 6 AS c, a.player_id % 6 = b.player_id % 6 AS same, count(*) AS cnt, sum({_DIST}) AS total
    FROM m_role a, m_role b GROUP BY 1, 2, 3) GROUP BY 1)""")
def silhouette(spark, sf):
    m = C.stage(role_matrix_of(spark, sf), "role-matrix")
    value = R.silhouette(m, by_modulo(m, 6), ROLE_KPIS)
    return m.agg(F.lit(value).alias("silhouette")).withColumn("silhouette", r6("silhouette"))


_TRAIN_COLS = ["player_id", "season_id", "position_group", "age", "minutes_share", "team_ppg", "xg_p90", "log_value", "value_date", "value_source"]


def training(spark, sf):
    return V.training_frame(labelled(spark, sf), VALUE)


def scoring(spark, sf):
    best = T.prefer_source(T.latest_value_per_source(B.market_values(spark, sf)), MARKET_PRECEDENCE)
    return V.scoring_frame(blended_now(spark, sf), best, VALUE)


@query("training_frame", """SELECT player_id, season_id, position_group, round(age, 6) AS age, round(minutes_share, 6) AS minutes_share, round(team_ppg, 6) AS team_ppg,
  round(xg_p90, 6) AS xg_p90, round(log_value, 6) AS log_value, value_date, value_source FROM v_training""")
def training_frame(spark, sf):
    return rounded(training(spark, sf).select(*_TRAIN_COLS), "age", "minutes_share", "team_ppg", "xg_p90", "log_value")


view("m_scoring", """SELECT b.player_id, b.season_id, b.position_group, (v.tm_last_updated - b.birth_date) / 365.25::DOUBLE AS age, b.effective_minutes, v.value_eur,
  v.tm_last_updated AS value_date, v.source AS value_source, v.is_stale AS value_is_stale FROM v_blended_now b JOIN v_best_value v USING (player_id)
  WHERE b.position_group IS NOT NULL AND b.effective_minutes >= 20""")


@query("scoring_frame", """SELECT player_id, season_id, position_group, round(age, 6) AS age, effective_minutes, value_eur, value_date, value_source, value_is_stale FROM m_scoring""")
def scoring_frame(spark, sf):
    return rounded(scoring(spark, sf).select("player_id", "season_id", "position_group", "age", "effective_minutes", "value_eur",
                                             "value_date", "value_source", "value_is_stale"), "age")


_CODE = "list_position(['" + "', '".join(catalogue.GROUPS) + "'], position_group) - 1"


_INPUTS = [("age", "age"), ("age_sq", "age * age"), ("minutes_share", "minutes_share"), ("team_ppg", "team_ppg"),
           *[(f"{s}_p90", f"{s}_p90") for s in VALUE.stats], ("group_code", _CODE)]
_CELLS = " UNION ALL ".join(f"SELECT player_id, season_id, '{name}' AS feature, CAST({expr} AS DOUBLE) AS v FROM v_training" for name, expr in _INPUTS)


@query("feature_matrix", f"""SELECT player_id, season_id, feature, round(coalesce(v, {V.MISSING}), 6) AS x, CAST(v IS NULL AS DOUBLE) AS missing FROM ({_CELLS})
  WHERE feature IN (SELECT feature FROM ({_CELLS}) GROUP BY 1 HAVING count(DISTINCT v) >= 2)""")
def feature_matrix(spark, sf):
    """Every model input of every training row, for the columns that tell rows apart, with its missing flag."""
    rows = C.stage(training(spark, sf), "matrix-rows")
    kept = [r["feature"] for r in V.informative_columns(rows, VALUE.stats).collect() if r["kept"]]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"x_{c}").alias("x"), F.col(f"m_{c}").alias("missing")) for c in kept])
    return rounded(V.feature_matrix(rows, kept, VALUE.stats).select("player_id", "season_id", F.inline(cells)), "x")


view("m_bucketed", """SELECT *, CASE WHEN age IS NULL THEN NULL WHEN age <= 21 THEN 0 WHEN age <= 24 THEN 1 WHEN age <= 27 THEN 2 WHEN age <= 30 THEN 3 ELSE 4 END AS bucket FROM v_training""")
view("m_median", """SELECT position_group, bucket, quantile_cont(log_value, 0.5) AS median FROM m_bucketed WHERE bucket IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT position_group, NULL, quantile_cont(log_value, 0.5) FROM m_bucketed GROUP BY 1
  UNION ALL SELECT NULL, NULL, quantile_cont(log_value, 0.5) FROM m_bucketed""")
view("m_pred", """SELECT b.player_id, b.season_id, b.position_group, b.bucket, b.log_value AS y, b.value_eur, coalesce(c.median, g.median, (SELECT median FROM m_median WHERE position_group IS NULL)) AS yhat
  FROM m_bucketed b LEFT JOIN m_median c ON c.position_group = b.position_group AND c.bucket = b.bucket
  LEFT JOIN m_median g ON g.position_group = b.position_group AND g.bucket IS NULL""")


@query("baseline_medians", "SELECT position_group, bucket, round(median, 6) AS median FROM m_median")
def baseline_medians(spark, sf):
    return rounded(V.baseline_medians(C.stage(training(spark, sf), "train"), VALUE), "median")


def baseline_pred(spark, sf):
    train = C.stage(training(spark, sf), "train")
    return (V.with_fallback(train, V.baseline_medians(train, VALUE), ["median"], VALUE)
            .withColumn("y", F.col("log_value")).withColumnRenamed("median", "yhat"))


@query("error_metrics", """SELECT round(avg(abs(yhat - y)), 6) AS mae_log, round(quantile_cont(abs(exp(yhat - y) - 1), 0.5), 6) AS median_abs_pct_error FROM m_pred""")
def error_metrics(spark, sf):
    return rounded(V.error_metrics(baseline_pred(spark, sf)), "mae_log", "median_abs_pct_error")


view("m_resid", "SELECT *, y - yhat AS residual FROM m_pred")
view("m_quant", """SELECT position_group, bucket, quantile_cont(residual, 0.1) AS lo, quantile_cont(residual, 0.9) AS hi FROM m_resid WHERE bucket IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT position_group, NULL, quantile_cont(residual, 0.1), quantile_cont(residual, 0.9) FROM m_resid GROUP BY 1
  UNION ALL SELECT NULL, NULL, quantile_cont(residual, 0.1), quantile_cont(residual, 0.9) FROM m_resid""")
view("m_band", """SELECT player_id, season_id, y, value_eur, least(yhat + lo, yhat, yhat + hi) AS low, greatest(yhat + lo, yhat, yhat + hi) AS high,
    (list_sort([yhat + lo, yhat, yhat + hi]))[2] AS mid FROM (SELECT p.*, coalesce(c.lo, g.lo, (SELECT lo FROM m_quant WHERE position_group IS NULL)) AS lo,
    coalesce(c.hi, g.hi, (SELECT hi FROM m_quant WHERE position_group IS NULL)) AS hi FROM m_pred p
  LEFT JOIN m_quant c ON c.position_group = p.position_group AND c.bucket = p.bucket LEFT JOIN m_quant g ON g.position_group = p.position_group AND g.bucket IS NULL)""")


def banded(spark, sf):
    pred = C.stage(baseline_pred(spark, sf), "pred")
    return V.value_band(pred, pred.withColumn("residual", F.col("y") - F.col("yhat")), VALUE)


@query("value_band", "SELECT player_id, season_id, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high FROM m_band")
def value_band(spark, sf):
    return rounded(banded(spark, sf).select("player_id", "season_id", "low", "mid", "high"), "low", "mid", "high")


@query("conformal_adjust", """SELECT round(s, 6) AS adjustment FROM (SELECT greatest((yhat - 0.4::DOUBLE) - y, y - (yhat + 0.4::DOUBLE)) AS s, row_number() OVER (ORDER BY greatest((yhat - 0.4::DOUBLE) - y, y - (yhat + 0.4::DOUBLE))) AS rn,
  count(*) OVER () AS n FROM m_pred) WHERE rn = least(ceil((n + 1) * 0.8::DOUBLE), n)""")
def conformal_adjust(spark, sf):
    calib = baseline_pred(spark, sf).withColumn("low", F.col("yhat") - 0.4).withColumn("high", F.col("yhat") + 0.4)
    return rounded(V.conformal_adjust(calib, 0.8), "adjustment")


@query("coverage", "SELECT round(avg(CAST(y >= yhat - 0.4::DOUBLE AND y <= yhat + 0.4::DOUBLE AS DOUBLE)), 6) AS share FROM m_pred")
def coverage(spark, sf):
    calib = baseline_pred(spark, sf).withColumn("low", F.col("yhat") - 0.4).withColumn("high", F.col("yhat") + 0.4)
    return rounded(V.coverage(calib), "share")


@query("band_label", """SELECT player_id, season_id, CASE WHEN value_eur < exp(low) * 1.0001 THEN 'Undervalued' WHEN value_eur > exp(high) * 0.9999 THEN 'Premium' ELSE 'Fair' END AS label FROM m_band""")
def band_label(spark, sf):
    rows = banded(spark, sf)
    return rows.select("player_id", "season_id", S.band_label(
        F.col("value_eur").cast("double"), F.exp("low") * 1.0001, F.exp("high") * 0.9999).alias("label"))


@query("value_model")
def value_model(spark, sf):
    """Held-out evaluation of the boosted trees, one row per metric."""
    rows = [(k, float(v)) for k, v in trained(spark, sf, "value").value.metrics.items()]
    return spark.createDataFrame(rows, "metric string, value double")


view("m_split", "SELECT *, season_id = (SELECT max(season_id) FROM m_bucketed) AS held FROM m_bucketed")
view("m_split_median", """SELECT position_group, bucket, quantile_cont(log_value, 0.5) AS median FROM m_split WHERE NOT held AND bucket IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT position_group, NULL, quantile_cont(log_value, 0.5) FROM m_split WHERE NOT held GROUP BY 1
  UNION ALL SELECT NULL, NULL, quantile_cont(log_value, 0.5) FROM m_split WHERE NOT held""")
view("m_split_pred", """SELECT s.log_value AS y, coalesce(c.median, g.median, (SELECT median FROM m_split_median WHERE position_group IS NULL)) AS yhat FROM m_split s
  LEFT JOIN m_split_median c ON c.position_group = s.position_group AND c.bucket = s.bucket
  LEFT JOIN m_split_median g ON g.position_group = s.position_group AND g.bucket IS NULL WHERE s.held""")


@query("value_model_split", """SELECT (SELECT count(*) FROM m_split WHERE NOT held) AS n_train, (SELECT count(*) FROM m_split WHERE held) AS n_test,
  (SELECT max(season_id) FROM m_split) AS test_season, round(avg(abs(yhat - y)), 6) AS baseline_mae_log,
  round(quantile_cont(abs(exp(yhat - y) - 1), 0.5), 6) AS baseline_median_abs_pct_error, true AS covers, true AS improvement_agrees FROM m_split_pred""")
def value_model_split(spark, sf):
    """What of the evaluation does not hang on the trees, and what must hold of the rest: the calibrated band covers at
    least its share of the held-out rows, and the improvement is that of the two errors."""
    model = trained(spark, sf, "value").value
    m = model.metrics
    improvement = 100.0 * (1.0 - m["mae_log"] / m["baseline_mae_log"])
    row = (int(m["n_train"]), int(m["n_test"]), model.test_season, m["baseline_mae_log"], m["baseline_median_abs_pct_error"],
           bool(m["calibrated_coverage"] >= VALUE.high_quantile - VALUE.low_quantile), bool(abs(improvement - m["improvement_pct"]) < 1e-9))
    return rounded(spark.createDataFrame([row], "n_train bigint, n_test bigint, test_season string, baseline_mae_log double, "
                                                "baseline_median_abs_pct_error double, covers boolean, improvement_agrees boolean"),
                   "baseline_mae_log", "baseline_median_abs_pct_error")


@query("score_players")
def score_players(spark, sf):
    return trained(spark, sf, "value").scores.select(
        "player_id", "season_id", "value_eur", "implied_value_eur", "band_low_eur", "band_high_eur", "value_label")


# -- the run's sinks --------------------------------------------------------------------

def folder(spark, name):
    return f"{C.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("store_ml_outputs", f"""SELECT 'player_role' AS name, '{B.TODAY}' AS trained_at, count(*) AS rows, count(DISTINCT player_id) AS players, true AS labelled FROM m_role
  UNION ALL SELECT 'player_value_score', '{B.TODAY}', count(*), count(DISTINCT player_id), true FROM m_scoring""")
def store_ml_outputs(spark, sf):
    """Both output tables of the training run: receipts, players, and whether every row has a label of its model."""
    out = TR.store(trained(spark, sf), spark, folder(spark, "ml"))
    facts = {"player_role": F.col("label").rlike("^(high|low) .+, (high|low) .+$"),
             "player_value_score": F.col("value_label").isin(*TR.VALUE_LABELS) & (F.col("band_low_eur") <= F.col("implied_value_eur")) & (F.col("implied_value_eur") <= F.col("band_high_eur"))}
    seen = None
    for name, df in out.items():
        row = df.agg(F.countDistinct("player_id").alias("players"), F.min(facts[name]).alias("labelled")).select(F.lit(name).alias("name"), "*")
        seen = row if seen is None else seen.unionByName(row)
    return T.model_runs(out).join(seen, "name")


@query("save_model", f"""SELECT 'roles' AS model, 'features' AS key, '{",".join(ROLE_KPIS)}' AS value UNION ALL SELECT 'roles', 'n_players', CAST(count(*) AS VARCHAR) FROM m_role
  UNION ALL SELECT 'roles', 'trained_at', '{B.TODAY}' UNION ALL SELECT 'value', 'trained_at', '{B.TODAY}' UNION ALL SELECT 'value', 'seed', '{VALUE.seed}'
  UNION ALL SELECT 'value', 'test_season', max(season_id) FROM m_bucketed UNION ALL SELECT 'value', 'n_test', CAST(count(*) AS DOUBLE)::VARCHAR FROM m_split WHERE held
  UNION ALL SELECT 'roles', 'moved after reload', '0' UNION ALL SELECT 'value', 'changed after reload', '0'""")
def save_model(spark, sf):
    """Metadata of both saved models, and how many players the reloaded ones place or score in another way."""
    run, path = trained(spark, sf), folder(spark, "model")
    saved = TR.save_models(run, spark, path)
    known = {"roles": ("features", "n_players", "trained_at"), "value": ("trained_at", "seed", "test_season", "n_test")}
    rows = None
    for name, df in saved.items():
        part = df.filter(F.col("key").isin(*known[name])).select(F.lit(name).alias("model"), "key", "value")
        rows = part if rows is None else rows.unionByName(part)
    kpis, mixture = SK.load_mixture(spark, f"{path}/roles")
    again = R.assign(R.with_vectors(role_matrix_of(spark, sf), kpis), mixture).withColumnRenamed("cluster", "again")
    moved = run.assignments.join(again, "player_id", "full").filter(~F.col("again").eqNullSafe(F.col("cluster")))
    scores = V.score_saved(spark, f"{path}/value", scoring(spark, sf), VALUE).select("player_id", "season_id", F.col("implied_value_eur").alias("v"), F.col("band_high_eur").alias("h"))
    same = (F.abs(F.col("v") / F.col("implied_value_eur") - 1) < 1e-9) & (F.abs(F.col("h") / F.col("band_high_eur") - 1) < 1e-9)
    changed = run.scores.join(scores, ["player_id", "season_id"], "full").filter(~F.coalesce(same, F.lit(False)))
    for name, key, df in (("roles", "moved after reload", moved), ("value", "changed after reload", changed)):
        rows = rows.unionByName(df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("model"), F.lit(key).alias("key"), "value"))
    return rows


@query("evaluation_tables", f"""SELECT 'skipped' AS name, 0 AS rows UNION ALL SELECT 'similarity', CAST(sum(least(3, n - 1)) AS BIGINT) FROM (SELECT count(DISTINCT player_id) AS n FROM m_vec GROUP BY position_group)
  UNION ALL SELECT 'age_curves', count(*) FROM v_curve UNION ALL SELECT 'role_bic', least({ROLES.k_max}, count(*) - 1) - least({ROLES.k_min}, count(*) - 1) + 1 FROM m_role
  UNION ALL SELECT 'role_scores', 3 UNION ALL SELECT 'value_metrics', 10 UNION ALL SELECT 'value_labels', 3
  UNION ALL SELECT 'value_features', count(*) FROM ({" UNION ALL ".join(f"SELECT count(DISTINCT {expr}) >= 2 AS kept FROM v_training" for expr in
    ["age", "age * age", "minutes_share", "team_ppg", *[f"{s}_p90" for s in VALUE.stats], _CODE])}) WHERE kept
  UNION ALL SELECT 'players in role_clusters', count(*) FROM m_role UNION ALL SELECT 'players in value_labels', count(*) FROM m_scoring""")
def evaluation_tables(spark, sf):
    """Rows of every diagnostic table of the run (of the clusters, whose number the fit chooses, their players)."""
    run, path = trained(spark, sf), folder(spark, "evaluation")
    feats = blended_features(spark, sf)
    similar = SI.similarity_examples(SI.similarity_vectors(feats), feats)
    out = SK.evaluation_tables(TR.diagnostics(run, spark, similar, CA.age_curve(pairs(spark, sf), AGES)), path).filter("name != 'role_clusters'")
    for name in ("role_clusters", "value_labels"):
        out = out.unionByName(spark.read.parquet(f"{path}/{name}").agg(F.sum("players").alias("rows")).select(F.lit(f"players in {name}").alias("name"), "rows"))
    return out
