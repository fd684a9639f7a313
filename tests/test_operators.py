from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import names as NM
from touchline.operators import careers as CA
from touchline.operators import common as C
from touchline.operators import features as FE
from touchline.operators import grounding as G
from touchline.operators import linkage as L
from touchline.operators import needs as N
from touchline.operators import quality as Q
from touchline.operators import roles as R
from touchline.operators import search as SE
from touchline.operators import similarity as SI
from touchline.operators import totals as T
from touchline.operators import value as V
from touchline.params import AgeCurveParams, RoleParams, ValueParams


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, a third of those with one tied score."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", "k", 5.0 if rng.random() < 0.33 else round(rng.gauss(0, 10), 1)) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "player_id int, position_group string, kpi string, value double")


@pytest.mark.parametrize("bucket", [7, 4_000_000])
def test_percent_rank_matches_pandas(skewed, bucket):
    rows, df = skewed
    got = {r["player_id"]: (r["percentile"], r["n_peers"]) for r in C.percent_rank(
        df, ["position_group", "kpi"], "value", percentile="percentile", n_peers="n_peers", rows_per_bucket=bucket).collect()}
    pdf = pd.DataFrame(rows, columns=["player_id", "g", "k", "v"])
    size = pdf.groupby("g")["v"].transform("size")
    want = (pdf.groupby("g")["v"].rank(method="min") - 1) / (size - 1).clip(lower=1) * 100
    assert len(got) == len(rows)
    for i, w, n in zip(pdf["player_id"], want, size, strict=True):
        assert got[i] == (pytest.approx(w), n)


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_quantiles_match_numpy(skewed, q):
    rows, df = skewed
    got = {r["position_group"]: r["x"] for r in C.quantile(df, ["position_group"], "value", q, "x", rows_per_bucket=11).collect()}
    for g, vals in itertools.groupby(sorted(rows, key=lambda r: r[1]), key=lambda r: r[1]):
        assert got[g] == pytest.approx(np.quantile([v[3] for v in vals], q))


def test_lone_peer_and_ineligible_rows(spark):
    rows = [(1, "ST", "k", 5.0, 700.0, True), (2, "CB", "k", 1.0, 700.0, False), (3, "CB", "k", 2.0, 700.0, False),
            (4, "CB", "k", 3.0, 10.0, False), (5, None, "k", 3.0, 900.0, True), (6, "CB", "k", None, 900.0, False)]
    df = spark.createDataFrame(rows, "player_id int, position_group string, kpi string, value double, minutes double, higher_is_better boolean")
    got = {r["player_id"]: (r["percentile"], r["n_peers"]) for r in FE.percentiles(df).collect()}
    assert got == {1: (0.0, 1), 2: (100.0, 2), 3: (0.0, 2)}


def test_player_season_keeps_missing_missing(spark):
    from touchline import catalogue

    stats = {c: None for c in catalogue.PLAYER_STATS}
    rows = [{"player_id": 1, "match_id": m, "team_id": t, "source": "fpl", "minutes": 90, "started": s, "fetched_at": "2026-01-01", **stats,
             "goals": g} for m, t, s, g in ((1, 1, True, 1), (2, 1, None, None), (3, 2, False, 2))]
    schema = "player_id int, match_id int, team_id int, source string, minutes int, started boolean, fetched_at string, " + ", ".join(
        f"{c} int" for c in stats)
    fact = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    match = spark.createDataFrame([(m, "2025-26") for m in (1, 2, 3)], "match_id int, season_id string")
    totals = T.player_season(fact, match)
    by_team = {r["team_id"]: r for r in totals.collect()}
    assert by_team[1]["goals"] == 1 and by_team[1]["starts"] == 1 and by_team[1]["xg"] is None
    both = T.collapse_clubs(totals).first()
    assert both["goals"] == 3 and both["minutes"] == 270 and both["xa"] is None


def test_severity_null_is_not_zero(spark):
    gaps = spark.createDataFrame([(1, "ST", "a", 0.5, 10.0), (1, "ST", "b", 0.5, -4.0), (1, "CB", "a", 1.0, None), (1, "W", "a", 1.0, -1.0)],
                                 "team_id int, position_group string, kpi string, weight double, gap double")
    ranked = {r["position_group"]: (r["severity"], r["need_rank"]) for r in N.rank_needs(N.need_severity(gaps)).collect()}
    assert ranked == {"ST": (5.0, 1), "W": (0.0, 2), "CB": (None, 3)}


def test_benchmark_ties_and_self_exclusion(spark):
    table = spark.createDataFrame([(i, p) for i, p in ((1, 1), (2, 2), (3, 2), (4, 4))], "team_id int, position int")
    clubs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "team_id int")
    members = N.benchmark_members(table, clubs, "top2", {"top2": 2})
    pairs = {tuple(r) for r in N.benchmark_set(clubs, members).collect()}
    assert pairs == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3) if a != b}
    with pytest.raises(ValueError):
        N.benchmark_members(table, clubs, "top9", {"top2": 2})


def test_cumulative_curve_restarts_after_a_gap(spark):
    points = spark.createDataFrame([("m", a, d) for a, d in ((18, None), (19, 1.0), (20, 2.0), (21, None), (22, None), (23, 5.0), (24, -1.0))],
                                   "metric string, age int, delta double")
    got = [r["cumulative"] for r in CA.cumulative_curve(points).orderBy("age").collect()]
    assert got == [None, 0.0, 1.0, 3.0, None, 0.0, 5.0]


def test_asof_window_and_ties(spark):
    rows = spark.sql("SELECT 1 player_id, DATE'2025-05-25' season_end UNION ALL SELECT 2, DATE'2025-05-25' UNION ALL SELECT 3, NULL")
    hist = spark.sql("""SELECT * FROM VALUES (1, DATE'2025-05-20', 10L, 's', 1), (1, DATE'2025-05-30', 20L, 's', 2), (2, DATE'2025-01-24', 5L, 's', 3),
      (2, DATE'2025-08-09', 6L, 's', 4), (3, DATE'2025-05-25', 1L, 's', 5) AS t(player_id, tm_last_updated, value_eur, source, id)""")
    got = {r["player_id"]: r["value_eur"] for r in CA.asof_nearest_valuation(rows, hist).collect()}
    assert got == {1: 20, 2: None, 3: None}


def brute_similar(qs, ks, cutoff):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]
    return {(a, b) for a in qs for b in ks if 100 * (1 - lev(a, b) / max(len(a), len(b))) >= cutoff}


@pytest.mark.parametrize("cutoff", [60.0, 75.0, 88.0])
def test_similar_strings_finds_every_pair(spark, cutoff):
    rng = random.Random(11)
    words = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(60)]
    noisy = [w[: len(w) // 2] + rng.choice("abc") + w[len(w) // 2 + rng.randint(0, 1):] for w in words]
    left = spark.createDataFrame([(w,) for w in noisy], "q string")
    right = spark.createDataFrame([(w,) for w in words], "key string")
    got = {(r["q"], r["key"]) for r in SE.similar_strings(left, right, cutoff).collect()}
    assert got == brute_similar(set(noisy), set(words), cutoff)


def test_similar_strings_compares_in_every_partition(spark):
    words = [("".join(chr(97 + i * p % 26) for p in (1, 3, 5, 7, 11, 17)),) for i in range(200)]
    df = SE.similar_strings(spark.createDataFrame(words, "q string"), spark.createDataFrame(words, "key string"), 80.0)
    df.count()
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_prefix_search_order(spark):
    names = spark.createDataFrame([(1, "Manchester City", ["Manchester City", "Man City"]), (2, "Manchester United", ["Manchester United"]),
                                   (3, "Arsenal", ["Arsenal"]), (4, "City Town", ["City Town"])], "id int, label string, spellings array<string>")
    queries = spark.createDataFrame([("city",), ("man c",), ("Arsnal",), ("arsenal",), ("",)], "query string")
    got = {}
    for r in sorted(SE.prefix_search(queries, names).collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["id"], r["kind"]))
    assert got["city"] == [(4, "prefix"), (1, "prefix")]
    assert got["man c"][0] == (1, "prefix") and got["Arsnal"] == [(3, "fuzzy")] and got["arsenal"] == [(3, "exact")]
    assert "" not in got


@pytest.mark.parametrize("cell", [5, 40, 2048])
def test_knn_equals_brute_force(spark, cell):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(160, 4))
    base[40:80] = base[40]  # a block of exact copies
    vecs = base / np.linalg.norm(base, axis=1, keepdims=True)
    groups = ["hot" if i < 120 else "b" for i in range(160)]
    current = {i for i in range(160) if i % 5}
    df = spark.createDataFrame([(i, groups[i], vecs[i].tolist()) for i in range(160)], "player_id long, position_group string, vec array<double>")
    cur = spark.createDataFrame([(i,) for i in current], "player_id long")
    got = {}
    for r in SI.knn_similar(df, cur, 6, rows_per_cell=cell).collect():
        got.setdefault(r["player_id"], []).append((r["rank"], r["neighbour_id"]))
    sims = np.clip(vecs @ vecs.T, -1, 1).round(9)
    for i in range(160):
        want = sorted((j for j in current if j != i and groups[j] == groups[i]), key=lambda j: (-sims[i, j], j))[:6]
        assert [n for _, n in sorted(got[i])] == want


def test_metric_index_visits_few_cells(spark, monkeypatch):
    """Vectors of six KPIs around some styles, with copies of one row: exact, and most cells are never looked into."""
    rng = np.random.default_rng(6)
    raw = rng.normal(size=(25, 6))[rng.integers(0, 25, 2400)] + rng.normal(scale=0.15, size=(2400, 6))
    raw[:90] = raw[0]
    vecs = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, "g" if i % 3 else "h", vecs[i].tolist()) for i in range(2400)], "player_id long, position_group string, vec array<double>")
    current = spark.createDataFrame([(i,) for i in range(2400) if i % 7], "player_id long")
    asked = []
    whole = SI.visits

    def watched(queries, cells, first):
        out = C.stage(whole(queries, cells, first), "visits")
        asked.append((out.count(), cells.groupBy("position_group").count().join(queries, "position_group").agg(F.sum("count")).first()[0]))
        return out

    monkeypatch.setattr(SI, "visits", watched)
    got = {}
    for r in SI.knn_similar(df, current, 5, rows_per_cell=24).collect():
        got.setdefault(r["player_id"], []).append((r["rank"], r["neighbour_id"]))
    sims = np.clip(vecs @ vecs.T, -1, 1).round(9)
    for i in range(0, 2400, 11):
        want = sorted((j for j in range(2400) if j % 7 and j != i and (j % 3 > 0) == (i % 3 > 0)), key=lambda j: (-sims[i, j], j))[:5]
        assert [n for _, n in sorted(got[i])] == want
    assert len(got) == 2400
    looked, possible = sum(n for n, _ in asked), asked[0][1]
    assert looked < 0.35 * possible, (looked, possible)


def test_components_of_chain_and_hub(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    hub = [("hub", f"x{i}") for i in range(50)]
    edges = spark.createDataFrame(chain + hub, "a string, b string")
    got = {r["node"]: r["component"] for r in L.link_components(edges).collect()}
    assert all(got[f"n{i:03d}"] == "n000" for i in range(61))
    assert all(got[f"x{i}"] == "hub" for i in range(50)) and len(got) == 112


def test_people_of_one_birthday_are_found_by_names_alone(spark):
    """One birthday holds all, some names are shared by many: the pairs of all against all that score enough."""
    rng = random.Random(17)
    first = ["anna", "bruno", "carlos", "dmitri", "e", "erling", "joao"]
    last = ["ward", "borges fernandes", "haaland", "silva", "de la cruz", "silva"]

    def name():
        s = f"{rng.choice(first)} {rng.choice(last)}"
        if rng.random() < 0.4:
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice(["", "x", " "]) + s[at + 1:]
        return rng.choice([s, s.upper(), " ".join(reversed(s.split())), s.split()[-1] if s.split() else "", s[0] + " " + s.split()[-1] if s.split() else "-"])

    recs = spark.createDataFrame([("tm", f"r{i}", name() if i else "--", "1990-01-01") for i in range(150)], "source string, source_id string, name string, d string")
    anchors = spark.createDataFrame([(i, [name(), name()] if i else ["--"], "1990-01-01") for i in range(120)], "code int, names array<string>, d string")
    r = recs.select("source", "source_id", NM.spelled("name").alias("spelled"), F.to_date("d").alias("born"))
    a = anchors.select("code", F.transform("names", NM.spelled).alias("spellings"), F.to_date("d").alias("born"))
    got = {(x["source_id"], x["code"], round(x["score"], 6)) for x in L.born_together(r, a).collect()}
    full = r.join(a, "born").withColumn("score", NM.name_score(F.col("spellings"), F.col("spelled"))).filter("score >= 88").collect()
    assert got == {(x["source_id"], x["code"], round(x["score"], 6)) for x in full} and len(got) > 300


def test_link_decisions(spark):
    anchors = spark.sql("""SELECT * FROM VALUES (1, array('Bruno Borges Fernandes'), 10, DATE'1994-09-08'), (2, array('Danny Ward'), 10, NULL),
      (3, array('Joel Ward'), 10, NULL), (4, array('Erling Haaland'), 20, DATE'2000-07-21') AS t(code, names, team_code, birth_date)""")
    records = spark.sql("""SELECT 'tm' source, * FROM VALUES ('a', 'Bruno Fernandes', 'U', array(10), CAST(NULL AS DATE)), ('b', 'Ward', 'U', array(10), NULL),
      ('c', 'E. Haaland', 'C', array(20), DATE'2000-07-21'), ('d', 'Erling Haaland', 'X', array(30), DATE'2000-07-21'), ('e', 'Nobody Here', 'U', array(10), NULL),
      ('f', 'Erling Haaland', 'C', array(20), DATE'1999-01-01'), ('g', 'Anyone', 'U', array(10), NULL) AS t(source_id, name, team_label, team_codes, birth_date)""")
    overrides = spark.createDataFrame([("tm", "g", 3), ("tm", "z", 99)], "source string, source_id string, code int")
    links, review, bad = L.link_decide(records, anchors, overrides)
    got = {r["source_id"]: (r["code"], r["method"]) for r in links.collect()}
    assert got == {"a": (1, "fuzzy"), "c": (4, "dob"), "d": (4, "dob_any_club"), "g": (3, "override")}
    why = {r["source_id"]: r["reason"] for r in review.collect()}
    assert set(why) == {"b", "e", "f"} and why["f"] == "date of birth mismatch" and "score" in why["e"]
    assert [r["code"] for r in bad.collect()] == [99]
    kept, lost = L.link_conflicts(links)
    assert {r["source_id"] for r in kept.filter("code = 4").collect()} == {"d"} and {r["source_id"] for r in lost.collect()} == {"c"}


def test_validation_stops_a_build(spark):
    df = spark.createDataFrame([(1, 1, 95.0, "s"), (1, 1, 140.0, None)], "p int, m int, minutes double, source string")
    rules = {"t": Q.Rules(not_null=("source",), in_range={"minutes": (0, 130)}, unique=("p", "m"))}
    issues = Q.validate_tables({"t": df}, rules)
    got = {(r["column"], r["check"]): r["failures"] for r in issues.collect()}
    assert got == {("source", "not_null"): 1, ("minutes", "in_range(0,130)"): 1, ("p/m", "unique"): 2}
    with pytest.raises(Q.ValidationError):
        Q.enforce(issues)
    assert Q.enforce(issues, allow_invalid=True) is False
    with pytest.raises(Q.ValidationError):
        Q.validate_tables({"other": df}, rules)


def test_grounding(spark):
    text = ("Rovers rated 72nd on 2026-09-30, up +12 and -3 from 2025-26; worth €45.0m or €8m. "
            "However Smith has 1,234 minutes, 2.4 per 90, 7.7 and 1999-01-01.")
    texts = spark.createDataFrame([("t", "e", text)], "id string, entity string, text string")
    facts = spark.createDataFrame([("e", 72.0, "Rovers 2026-09-30 2025-26"), ("e", 45.04, None), ("e", 12.0, None), ("e", 3.0, None), ("e", 1234.0, None),
                                   ("e", 2.35, None), ("e", 90.0, "Smith's minutes")], "entity string, number double, text string")
    got = {(r["kind"], r["token"]) for r in G.grounding_check(texts, facts).collect()}
    assert got == {("date", "1999-01-01"), ("money", "€8m"), ("number", "-3"), ("number", "7.7")}


def test_mixture_separates_two_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(-3, 0.5, (60, 2)), rng.normal(3, 0.5, (60, 2))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "player_id long, a double, b double")
    fit, assigned = R.role_clusters(df, ["a", "b"], RoleParams(k_min=1, k_max=3))
    assert fit.k == 2 and all(y >= x_ - 1e-6 for t in fit.log_likelihood.values() for x_, y in zip(t, t[1:], strict=False))
    labels = {r["player_id"]: r["cluster"] for r in assigned.collect()}
    assert len({labels[i] for i in range(60)}) == 1 and labels[0] != labels[60]
    truth = df.select("player_id", (F.col("player_id") >= 60).cast("int").alias("cluster"))
    assert R.adjusted_rand(assigned, truth).first()["ari"] == pytest.approx(1.0)
    assert R.silhouette(df, assigned, ["a", "b"]) > 0.8
    names = R.cluster_labels(df, assigned, ["a", "b"], {"a": "Passing", "b": "Shooting"}, {"high Passing, high Shooting": "Star"})
    assert "Star" in {r["label"] for r in names.collect()} or all("," in r["label"] for r in names.collect())


def test_conformal_rank_and_coverage(spark):
    df = spark.createDataFrame([(float(y), 0.0, 1.0) for y in range(-3, 6)], "y double, low double, high double")
    scores = sorted(max(0 - y, y - 1) for y in range(-3, 6))
    want = scores[min(math.ceil(10 * 0.8), 9) - 1]
    adj = V.conformal_adjust(df, 0.8).first()["adjustment"]
    assert adj == want
    wide = V.widen(df.withColumn("mid", F.lit(0.5)), float(adj))
    assert V.coverage(wide).first()["share"] >= 0.8


def test_value_model_beats_its_baseline(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        age, xg = float(rng.uniform(18, 34)), (None if i % 9 == 0 else float(rng.uniform(0, 1)))
        y = 15 + 2 * (xg or 0.5) - 0.05 * (age - 26) ** 2 + float(rng.normal(0, 0.05))
        rows.append((i, f"20{20 + i % 3}-{21 + i % 3}", "ST" if i % 2 else "CB", age, 0.5, 1.5, 0.1, xg, y))
    df = spark.createDataFrame(rows, """player_id long, season_id string, position_group string, age double, minutes_share double, team_ppg double,
      goals_p90 double, xg_p90 double, log_value double""")
    v = ValueParams(stats=("goals", "xg"), max_iter=10)
    model = V.value_model(df, v)
    assert "minutes_share" not in model.columns and "goals_p90" not in model.columns
    m = model.metrics
    assert m["mae_log"] < m["baseline_mae_log"] and m["calibrated_coverage"] >= 0.75
    scored = V.score_with(model, df.withColumn("value_eur", F.exp("log_value").cast("long")))
    assert scored.filter("band_low_eur > implied_value_eur or implied_value_eur > band_high_eur").count() == 0


def test_age_curve_needs_enough_pairs(spark):
    pairs = spark.createDataFrame([(i, "a", "b", 20 + (i % 2), "xg", 0.1 * i, 1.0) for i in range(6)],
                                  "player_id int, season_from string, season_to string, age int, metric string, delta double, weight double")
    curve = CA.age_curve(pairs, AgeCurveParams(metrics=("xg",), min_pairs=3, age_min=19, age_max=22))
    got = {r["age"]: (r["delta"], r["n_pairs"]) for r in curve.collect()}
    assert got[20] == (pytest.approx(0.2), 3) and got[19] == (None, 0) and len(got) == 4


def test_numbers_are_backed_within_their_rounding_alone(spark):
    """Against the definition, around the borders of bands, with one entity that has most numbers."""
    rng = random.Random(14)
    tolerance = 1e-6
    numbers = [rng.choice([0.0, 0.5, 1.5, 2.0, -2.0, 1e6, 4e8]) + rng.uniform(-3, 3) * 10.0 ** rng.randint(-4, 5) for _ in range(120)]
    facts = [("hot" if i % 3 else "e", x) for i, x in enumerate(numbers)]
    tokens = []
    for i in range(1500):
        entity, x = rng.choice(facts)
        d = rng.randint(0, 8)
        v = round(x + rng.uniform(-1.5, 1.5) * 10.0 ** -d, d) * rng.choice([1, 1, -1])
        tokens.append((f"t{i}", entity, "number", str(i), v, d, rng.random() < 0.5))

    def backed(entity, v, d, signed):
        for e, a in facts:
            for c in (a,) if signed else (a, -a):
                if e == entity and abs(c - v) <= 0.5 * 10.0 ** -d + tolerance * max(1.0, abs(c)):
                    return True
        return False

    df = spark.createDataFrame(tokens, "id string, entity string, kind string, token string, value double, decimals int, signed boolean")
    got = G.unbacked_numbers(df, spark.createDataFrame(facts, "entity string, number double"), tolerance)
    assert got.columns == df.columns
    want = {t[0] for t in tokens if not backed(t[1], t[4], t[5], t[6])}
    assert {r["id"] for r in got.collect()} == want and 100 < len(want) < 1400


def test_common_words_come_from_the_texts(spark):
    texts = spark.createDataFrame([("a", "e", "The end of the road, the sea, the hill. Harbour won. Hill fell."), ("b", "e", None)], "id string, entity string, text string")
    assert {r["token"] for r in G.common_words(texts, openers=()).collect()} == {"end", "of", "road", "sea", "won", "fell"}
    facts = spark.createDataFrame([("e", 1.0, "sea")], "entity string, number double, text string")
    assert {r["token"] for r in G.grounding_check(texts, facts, common=G.common_words(texts, lower_uses=2)).collect()} == {"harbour", "hill"}


def test_pair_scores_are_the_best_over_spellings_without_loops_over_them(spark):
    anchors = spark.sql("""SELECT code, names, 7L AS team_code, DATE'2000-01-01' AS birth_date FROM VALUES ('a', array('José  Núñez', 'Zé')), ('b', array('Nunez Jose Maria', NULL)),
      ('c', CAST(array() AS ARRAY<STRING>)), ('d', array('', 'J. Nunez')), ('e', array('Straße & Sohn')) AS t(code, names)""")
    records = spark.sql("""SELECT 'u' AS source, id AS source_id, name, array(7L, 8L, 7L) AS team_codes, CAST(NULL AS DATE) AS birth_date
      FROM VALUES ('1', 'Jose Nunez'), ('2', 'NUNEZ, José'), ('3', ''), ('4', CAST(NULL AS STRING)), ('5', 'strasse sohn') AS t(id, name)""")
    found = L.pair_scores(records, anchors)
    one_by_one = (records.select("source_id", NM.spelled("name").alias("r")).crossJoin(anchors.select("code", F.transform("names", NM.spelled).alias("a")))
                  .select("source_id", "code", NM.name_score(F.col("a"), F.col("r")).alias("score")))
    got = {(r["source_id"], r["code"]): r["score"] for r in found.collect()}
    assert found.count() == 25 and got == {(r["source_id"], r["code"]): r["score"] for r in one_by_one.collect()}
    assert got["1", "a"] == 100.0 and got["4", "a"] == got["1", "c"] == 0.0
    assert "array_max" not in found._jdf.queryExecution().optimizedPlan().toString()
