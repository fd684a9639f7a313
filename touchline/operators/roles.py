"""Role archetypes: a diagonal Gaussian mixture fitted with one pass over the data per step.

Model parameters have k x features numbers, so they travel with the tasks; the players stay
in their partitions and each step returns only summed statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.operators.common import stage, together
from touchline.operators.totals import standardise
from touchline.params import Methodology, RoleParams


def role_kpis(groups: Sequence[str] = catalogue.OUTFIELD_GROUPS) -> list[str]:
    """KPIs with a positive weight in at least one of the groups."""
    return sorted({k for g in groups for k, w in catalogue.GROUP_WEIGHTS[g].items() if w > 0})


def short_names() -> dict[str, str]:
    return {row[0]: row[5].split(" (")[0] for row in catalogue.KPIS}


def role_matrix(features: DataFrame, kpis: Sequence[str],
                min_minutes: float = Methodology().roles_min_minutes) -> DataFrame:
    """player_id and one z column per KPI for players with enough minutes and every KPI."""
    rows = features.filter(F.col("kpi").isin(*kpis) & F.col("shrunk").isNotNull())
    wide = (rows.groupBy("player_id").agg(
        F.max("effective_minutes").alias("m"),
        *[F.max(F.when(F.col("kpi") == k, F.col("shrunk"))).alias(k) for k in kpis])
        .filter(F.col("m") >= min_minutes).drop("m").dropna(subset=list(kpis)))
    z = standardise(wide, list(kpis))
    return z.select("player_id", *[F.coalesce(f"{k}_z", F.lit(0.0)).alias(k) for k in kpis])


@dataclass
class Mixture:
    """One diagonal mixture: weights (k), means and variances (k x d)."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log(weight) + log density of every row under every component."""
        precision = 1.0 / self.variances
        quad = (x**2) @ precision.T - 2.0 * x @ (self.means * precision).T + (self.means**2 * precision).sum(1)
        return (np.log(self.weights) - 0.5 * (x.shape[1] * math.log(2 * math.pi)
                + np.log(self.variances).sum(1)) - 0.5 * quad)

    @property
    def free_parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + 2 * k * d


def _kmeans_start(matrix: DataFrame, k: int, seed: int, d: int) -> Mixture:
    if k == 1:
        placed = matrix.withColumn("c", F.lit(0))
    else:
        placed = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="c", maxIter=20).fit(matrix).transform(matrix)
    stats = placed.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[
        x for j in range(d) for x in (F.avg(F.col("z")[j]).alias(f"m{j}"), F.var_pop(F.col("z")[j]).alias(f"s{j}"))])
    rows = stats.collect()  # one row per component
    n = np.array([r["n"] for r in rows], dtype=float)
    means = np.array([[r[f"m{j}"] for j in range(d)] for r in rows])
    variances = np.array([[r[f"s{j}"] for j in range(d)] for r in rows]) + 1e-6
    return Mixture(n / n.sum(), means, variances)


def _statistics(matrix: DataFrame, models: Mapping[int, Mixture]) -> dict[int, dict[str, np.ndarray]]:
    """Summed responsibilities, first and second moments and log-likelihood of each model."""
    def sums_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["z"])
            for key, model in models.items():
                joint = model.log_joint(x)
                top = joint.max(1, keepdims=True)
                log_sum = top[:, 0] + np.log(np.exp(joint - top).sum(1))
                resp = np.exp(joint - log_sum[:, None])
                part = [resp.sum(0)[:, None], resp.T @ x, resp.T @ x**2, np.array([[log_sum.sum()]])]
                sums[key] = part if key not in sums else [a + b for a, b in zip(sums[key], part, strict=True)]
        for key, parts in sums.items():
            for name, arr in zip(("n", "x", "xx", "ll"), parts, strict=True):
                i, j = np.indices(arr.shape)
                yield pd.DataFrame({"model": key, "stat": name, "i": i.ravel(), "j": j.ravel(), "v": arr.ravel()})

    # One row per model, statistic and cell comes back: a few thousand numbers at most.
    rows = (matrix.select("z").mapInPandas(sums_of, "model int, stat string, i int, j int, v double")
            .groupBy("model", "stat", "i", "j").agg(F.sum("v").alias("v")).toPandas())
    out: dict[int, dict[str, np.ndarray]] = {}
    for (key, name), g in rows.groupby(["model", "stat"]):
        arr = np.zeros((g["i"].max() + 1, g["j"].max() + 1))
        arr[g["i"], g["j"]] = g["v"]
        out.setdefault(int(key), {})[str(name)] = arr
    return out


@dataclass
class RoleFit:
    k: int
    bic: dict[int, float]
    log_likelihood: dict[int, list[float]]
    model: Mixture
    n: int
    #: Whether the likelihood of the chosen fit settled within the allowed steps.
    converged: bool = True


def with_vectors(matrix: DataFrame, kpis: Sequence[str]) -> DataFrame:
    return matrix.select("player_id", F.array(*kpis).alias("z")).withColumn("v", array_to_vector("z"))


def _stepped(s: dict[str, np.ndarray], p: RoleParams) -> tuple[Mixture, float, float]:
    """M step: the model of summed statistics, the log-likelihood of the one they were taken under, and the number of rows."""
    count = s["n"][:, 0] + 1e-12
    n = count.sum()
    means = s["x"] / count[:, None]
    variances = np.maximum(s["xx"] / count[:, None] - means**2, 0.0) + p.covariance_floor
    return Mixture(count / n, means, variances), float(s["ll"][0, 0]), n


def em_step(data: DataFrame, model: Mixture, p: RoleParams = RoleParams()) -> tuple[Mixture, float, float]:
    """One step from a given model: the next one, the log-likelihood of the given one, and the number of rows."""
    return _stepped(_statistics(data, {0: model})[0], p)


def fit_mixtures(data: DataFrame, ks: Sequence[int], d: int, seed: int, p: RoleParams):
    """EM for every k at once: each step is a single pass that serves all open models."""
    models = dict(zip(ks, together(*[partial(_kmeans_start, data, k, seed, d) for k in ks]), strict=True))
    trace: dict[int, list[float]] = {k: [] for k in ks}
    open_ = set(ks)
    n = 0.0
    for _ in range(p.max_iter):
        for k, s in _statistics(data, {k: models[k] for k in open_}).items():
            stepped, likelihood, n = _stepped(s, p)
            trace[k].append(likelihood)
            if len(trace[k]) > 1 and abs(trace[k][-1] - trace[k][-2]) / n < p.tolerance:
                open_.discard(k)
                continue
            models[k] = stepped
        if not open_:
            break
    return models, trace, int(round(n)), set(ks) - open_


def role_clusters(matrix: DataFrame, kpis: Sequence[str], p: RoleParams = RoleParams()) -> tuple[RoleFit, DataFrame]:
    """Fit k_min..k_max and keep the lowest BIC; (fit, player_id + cluster)."""
    data = stage(with_vectors(matrix, kpis), "role-matrix").persist()
    n = data.count()
    if n < 2:
        raise ValueError(f"need at least 2 players to fit roles, got {n}")
    upper = min(p.k_max, n - 1)
    ks = list(range(min(p.k_min, upper), upper + 1))
    models, trace, n, settled = fit_mixtures(data, ks, len(kpis), p.seed, p)
    data.unpersist()
    bic = {k: -2.0 * trace[k][-1] + models[k].free_parameters * math.log(n) for k in ks}
    best = min(ks, key=lambda k: (bic[k], k))
    return RoleFit(best, bic, trace, models[best], n, best in settled), assign(data, models[best])


def assign(data: DataFrame, model: Mixture) -> DataFrame:
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                yield pd.DataFrame({"player_id": batch["player_id"],
                                    "cluster": model.log_joint(np.stack(batch["z"])).argmax(1)})

    return data.select("player_id", "z").mapInPandas(label, "player_id long, cluster int")


def refit_assignments(matrix: DataFrame, kpis: Sequence[str], k: int, seed: int,
                      p: RoleParams = RoleParams()) -> DataFrame:
    """Assignments of a fit with another seed, for the stability score."""
    data = stage(with_vectors(matrix, kpis), "role-matrix").persist()
    models, _trace, _n, _settled = fit_mixtures(data, [k], len(kpis), seed, p)
    data.unpersist()
    return assign(data, models[k])


def cluster_labels(matrix: DataFrame, assignments: DataFrame, kpis: Sequence[str],
                   names: Mapping[str, str], renames: Mapping[str, str] | None = None) -> DataFrame:
    """Label per cluster from its two most extreme mean z-scores."""
    means = matrix.join(assignments, "player_id").groupBy("cluster").agg(*[F.avg(k).alias(k) for k in kpis])
    items = F.array(*[F.struct(F.lit(k).alias("kpi"), F.lit(names.get(k, k)).alias("name"), F.col(k).alias("mean"))
                      for k in kpis])
    w = W.partitionBy("cluster").orderBy(F.desc(F.abs("mean")), F.asc("kpi"))
    part = F.concat_ws(" ", F.when(F.col("mean") >= 0, F.lit("high")).otherwise(F.lit("low")), F.col("name"))
    top = (means.select("cluster", F.inline(items)).withColumn("r", F.row_number().over(w)).filter("r <= 2")
           .groupBy("cluster").agg(F.max(F.when(F.col("r") == 1, part)).alias("a"), F.max(F.when(F.col("r") == 2, part)).alias("b")))
    label = F.concat_ws(", ", "a", "b")
    if renames:
        label = F.coalesce(F.try_element_at(catalogue.literal_map(dict(renames)), label), label)
    return top.select("cluster", label.alias("label"))


def silhouette(matrix: DataFrame, assignments: DataFrame, kpis: Sequence[str]) -> float:
    """Mean silhouette with squared Euclidean distance."""
    rows = with_vectors(matrix, kpis).join(assignments, "player_id")
    return ClusteringEvaluator(featuresCol="v", predictionCol="cluster", metricName="silhouette").evaluate(
        rows.withColumn("cluster", F.col("cluster").cast("double")))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """Adjusted Rand index of two clusterings of the same players, from pair counts."""
    cells = (a.select("player_id", F.col("cluster").alias("a")).join(b.select("player_id", F.col("cluster").alias("b")), "player_id")
             .groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n")))

    def pairs(c):
        return c * (c - 1.0) / 2.0

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sum(pairs(F.col("n"))).alias(name)).withColumn("k", F.lit(1))

    both = total(cells, "both")
    for key in ("a", "b"):
        both = both.join(total(cells.groupBy(key).agg(F.sum("n").alias("n")), f"in_{key}"), "k")
    both = both.join(total(cells.agg(F.sum("n").alias("n")), "every"), "k")
    expected = F.col("in_a") * F.col("in_b") / F.col("every")
    highest = (F.col("in_a") + F.col("in_b")) / 2.0
    return both.select(F.when(highest == expected, F.lit(1.0)).otherwise(
        (F.col("both") - expected) / (highest - expected)).alias("ari"))
