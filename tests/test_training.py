from __future__ import annotations

import numpy as np
import pytest

from touchline.operators import roles as R
from touchline.operators import value as V
from touchline.params import RoleParams, ValueParams
from touchline.plans import training as TR
from touchline.sources import sinks as SK

ROLES = RoleParams(k_min=2, k_max=3, max_iter=20)
VALUE = ValueParams(max_iter=3, step=0.3, min_minutes=10.0)
KPIS = ["a", "b"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(-3, 0.5, (50, 2)), rng.normal(3, 0.5, (50, 2))])
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "player_id long, a double, b double")


def seasons(spark, n, years):
    rng = np.random.default_rng(1)
    rows = []
    for year in years:
        for i in range(n):
            age, rate = float(rng.uniform(18, 35)), float(rng.uniform(0, 1))
            rows.append((i, f"{year}", ["CB", "ST"][i % 2], age, 900.0, 0.5 if i % 5 else None, 1.5, *[rate] * 5, 14 + 2 * rate - age / 20, 1_000_000, "tm", False))
    stats = ", ".join(f"{s}_p90 double" for s in VALUE.stats)
    return spark.createDataFrame(rows, f"player_id long, season_id string, position_group string, age double, minutes double, minutes_share double, "
                                       f"team_ppg double, {stats}, log_value double, value_eur long, value_source string, value_is_stale boolean"
                                 ).selectExpr("*", "DATE'2024-06-01' AS value_date")


@pytest.fixture(scope="module")
def run(spark, matrix):
    return TR.train(matrix, KPIS, seasons(spark, 60, (2021, 2022, 2023)), seasons(spark, 30, (2024,)), {"a": "Passing", "b": "Shooting"},
                    trained_at="2026-01-01", roles=ROLES, value=VALUE)


def test_run_stores_both_outputs_and_diagnostics(spark, run, tmp_path):
    assert run.roles_skipped is None and run.value_skipped is None and run.silhouette > 0.5 and len(run.stability) == 2
    out = TR.store(run, spark, str(tmp_path / "ml"))
    roles = out["player_role"].collect()
    assert len(roles) == 100 and {r["cluster"] for r in roles} == set(range(run.roles.k)) and all(r["label"] for r in roles)
    scores = out["player_value_score"].collect()
    assert len(scores) == 30 and all(r["band_low_eur"] <= r["implied_value_eur"] <= r["band_high_eur"] and r["value_label"] in TR.VALUE_LABELS for r in scores)
    none = spark.createDataFrame([], "player_id long")
    tables = TR.diagnostics(run, spark, none, none)
    rows = {r["name"]: r["rows"] for r in SK.evaluation_tables(tables, str(tmp_path / "e")).collect()}
    assert rows == {"skipped": 0, "similarity": 0, "age_curves": 0, "role_bic": 2, "role_clusters": run.roles.k, "role_scores": 3,
                    "value_metrics": 10, "value_features": len(run.value.columns), "value_labels": 3}
    assert sum(r["players"] for r in tables["value_labels"].collect()) == 30
    assert [r["k"] for r in tables["role_bic"].filter("chosen").collect()] == [run.roles.k]


def test_saved_models_place_and_score_alike(spark, run, matrix, tmp_path):
    path = str(tmp_path / "models")
    meta = TR.save_models(run, spark, path)
    kpis, mixture = SK.load_mixture(spark, f"{path}/roles")
    again = R.assign(R.with_vectors(matrix, kpis), mixture)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in run.assignments.collect()}
    scored = V.score_saved(spark, f"{path}/value", seasons(spark, 30, (2024,)), VALUE).select("player_id", "implied_value_eur", "band_low_eur", "value_label")
    for mine, first in zip(sorted(map(tuple, scored.collect())), sorted(map(tuple, run.scores.select(*scored.columns).collect())), strict=True):
        assert mine[:3] == pytest.approx(first[:3]) and mine[3] == first[3]
    values = {r["key"]: r["value"] for r in meta["value"].collect()}
    assert values["test_season"] == "2023" and values["n_train"] == "120.0" and values["trained_at"] == "2026-01-01"


def test_a_model_that_cannot_be_fitted_leaves_empty_tables(spark, matrix, tmp_path):
    run = TR.train(matrix.limit(1), KPIS, seasons(spark, 20, (2021,)), seasons(spark, 5, (2024,)), {}, trained_at="t", roles=ROLES, value=VALUE)
    assert "at least 2 players" in run.roles_skipped and "at least 2 seasons" in run.value_skipped
    out = TR.store(run, spark, str(tmp_path))
    assert [out[n].count() for n in ("player_role", "player_value_score")] == [0, 0]
    none = spark.createDataFrame([], "player_id long")
    assert {r["model"] for r in TR.diagnostics(run, spark, none, none)["skipped"].collect()} == {"roles", "value"}


def test_em_step_equals_numpy(spark, matrix):
    start = R.Mixture(np.array([0.3, 0.7]), np.array([[-1.0, 0.0], [1.0, 0.5]]), np.array([[1.0, 2.0], [0.5, 1.0]]))
    got, likelihood, n = R.em_step(R.with_vectors(matrix, KPIS), start, ROLES)
    x = np.array([[r["a"], r["b"]] for r in matrix.collect()])
    dens = start.weights * np.exp(-0.5 * ((x[:, None, :] - start.means) ** 2 / start.variances).sum(2)) / np.sqrt((2 * np.pi * start.variances).prod(1))
    resp = dens / dens.sum(1, keepdims=True)
    mean = (resp.T @ x) / resp.sum(0)[:, None]
    assert n == pytest.approx(100) and likelihood == pytest.approx(np.log(dens.sum(1)).sum())
    assert got.weights == pytest.approx(resp.mean(0)) and got.means == pytest.approx(mean)
    assert got.variances == pytest.approx((resp.T @ x**2) / resp.sum(0)[:, None] - mean**2 + ROLES.covariance_floor)


def test_the_two_fits_run_side_by_side(spark, monkeypatch):
    import threading

    both = threading.Barrier(2, timeout=30)

    def fit(rows, v):
        both.wait()
        raise ValueError("both came")

    monkeypatch.setattr(V, "_fit", fit)
    with pytest.raises(ValueError, match="both came"):
        V.value_model(spark.createDataFrame([("2000-01",), ("2001-02",)], "season_id string"))


def test_a_query_of_one_model_leaves_the_other_alone(spark, monkeypatch):
    from touchline.workload import q_ml

    def never(*args):
        raise AssertionError("fitted for nothing")

    seen = []
    monkeypatch.setattr(q_ml.TR, "train_value", never)
    monkeypatch.setattr(q_ml.TR, "train_roles", lambda *args: seen.append(args))
    monkeypatch.setattr(q_ml, "_RUNS", {})
    monkeypatch.setattr(q_ml, "_FITTED", set())
    monkeypatch.setattr(q_ml, "role_matrix_of", lambda spark, sf: None)
    for _ in range(2):
        q_ml.trained(spark, "/root/testdata/sf0.001", "roles")
    assert len(seen) == 1
