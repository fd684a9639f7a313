"""Player-season rows, valuations, age curves, arrivals, backtest, comparison and search."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from touchline import catalogue
from touchline.functions import names as NM
from touchline.functions import scalars as S
from touchline.operators import careers as CA
from touchline.operators import features as FE
from touchline.operators import needs as N
from touchline.operators import search as SE
from touchline.operators import totals as T
from touchline.operators.common import stage
from touchline.params import FUZZY_CUTOFF, AgeCurveParams, ValueParams
from touchline.plans import backtest as BT
from touchline.plans import shortlist as SL
from touchline.workload import bindings as B
from touchline.workload.q_features import METHOD, staged_features, totals_and_padj, warehouse
from touchline.workload.q_needs import Inputs
from touchline.workload.registry import query, r6, rounded
from touchline.workload.sqltext import view

VALUE = ValueParams(min_minutes=20.0)
AGES = AgeCurveParams(min_minutes=40.0)
STATS = VALUE.stats

view("v_ends", "SELECT season_id, max(kickoff) AS season_end FROM v_match WHERE kickoff IS NOT NULL GROUP BY 1")
_P90 = ", ".join(f"CASE WHEN mins > 0 THEN {s} * 90.0::DOUBLE / mins END AS {s}_p90" for s in STATS)


def _ps_sql(source: str) -> str:
    return f"""SELECT a.player_id, a.season_id, a.team_id, p.position_group, p.birth_date, (e.season_end - p.birth_date) / 365.25::DOUBLE AS age, a.mins,
      a.mins / (s.played * 90.0::DOUBLE) AS minutes_share, s.points / s.played::DOUBLE AS team_ppg, e.season_end, a.as_of, {_P90}
      FROM (SELECT player_id, season_id, sum(coalesce(mins, 0))::DOUBLE AS mins, max(fetched_at) AS as_of,
        (list(team_id ORDER BY mins DESC, team_id))[1] AS team_id, {', '.join(f'sum({s})::DOUBLE AS {s}' for s in STATS)}
        FROM v_totals WHERE source = '{source}' GROUP BY 1, 2) a
      LEFT JOIN v_player p USING (player_id) LEFT JOIN v_ends e USING (season_id)
      LEFT JOIN v_standings s ON s.season_id = a.season_id AND s.team_id = a.team_id"""


def _blended_sql(cur: str, prev: str) -> str:
    rates = ", ".join(
        f"""CASE WHEN {w} > 0 THEN ({c} * coalesce(c.{s}_p90, 0) + {p} * coalesce(p.{s}_p90, 0)) / ({w}) END AS {s}_p90"""
        for s in STATS
        for c in [f"CASE WHEN c.{s}_p90 IS NOT NULL THEN c.mins ELSE 0 END"]
        for p in [f"CASE WHEN p.{s}_p90 IS NOT NULL THEN 0.5::DOUBLE * least(coalesce(p.mins, 0), 150) ELSE 0 END"]
        for w in [f"{c} + {p}"])
    return f"""SELECT c.player_id, c.season_id, c.team_id, c.position_group, c.birth_date, c.age, c.mins, c.minutes_share, c.team_ppg, c.season_end,
      greatest(c.as_of, p.as_of) AS as_of, {rates}, c.mins + 0.5::DOUBLE * least(coalesce(p.mins, 0), 150) AS effective_minutes,
      coalesce(p.mins, 0) > 0 AS used_previous_season FROM {cur} c LEFT JOIN {prev} p ON p.player_id = c.player_id
      AND CAST(substr(p.season_id, 1, 4) AS INT) = CAST(substr(c.season_id, 1, 4) AS INT) - 1"""


view("v_history_rows", _ps_sql("vaastav"))
view("v_current_rows", _ps_sql("fpl"))
view("v_blended_rows", _blended_sql("v_history_rows", "v_history_rows"))
view("v_blended_now", _blended_sql("v_current_rows", "v_history_rows"))
view("v_labelled", """SELECT b.*, n.value_eur, CASE WHEN n.value_eur > 0 THEN ln(n.value_eur::DOUBLE) END AS log_value, n.value_date, n.value_source
  FROM v_blended_rows b LEFT JOIN (SELECT * FROM (SELECT r.player_id, r.season_id, h.value_eur, h.tm_last_updated AS value_date, h.source AS value_source,
    row_number() OVER (PARTITION BY r.player_id, r.season_id ORDER BY abs(h.tm_last_updated - r.season_end), -(h.tm_last_updated - r.season_end), h.source, h.id) AS rn
    FROM v_history_rows r JOIN v_value h ON h.player_id = r.player_id AND h.value_eur IS NOT NULL AND h.tm_last_updated IS NOT NULL
     AND h.tm_last_updated - r.season_end BETWEEN -120 AND 75) WHERE rn = 1) n ON n.player_id = b.player_id AND n.season_id = b.season_id""")
view("v_training", "SELECT * FROM v_labelled WHERE log_value IS NOT NULL AND mins >= 20")
view("v_pairs", """SELECT b.player_id, a.season_id AS season_from, b.season_id AS season_to, CAST(floor(a.age) AS INT) AS age, m.metric, m.delta,
    2 * a.mins * b.mins / (a.mins + b.mins) AS weight
  FROM v_history_rows b JOIN v_history_rows a ON a.player_id = b.player_id AND CAST(substr(a.season_id, 1, 4) AS INT) = CAST(substr(b.season_id, 1, 4) AS INT) - 1,
  LATERAL (SELECT 'xg' AS metric, b.xg_p90 - a.xg_p90 AS delta UNION ALL SELECT 'xa', b.xa_p90 - a.xa_p90
    UNION ALL SELECT 'goals', b.goals_p90 - a.goals_p90 UNION ALL SELECT 'assists', b.assists_p90 - a.assists_p90) m
  WHERE a.mins >= 40 AND b.mins >= 40 AND a.age IS NOT NULL AND m.delta IS NOT NULL""")
view("v_curve", """SELECT metric, age, delta, n_pairs, CASE WHEN pre IS NOT NULL THEN pre WHEN delta IS NOT NULL THEN 0 END AS cumulative FROM (
  SELECT *, sum(delta) OVER (PARTITION BY metric, run ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre FROM (
    SELECT *, coalesce(sum(CAST(delta IS NULL AS INT)) OVER (PARTITION BY metric ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM (
      SELECT m.metric, a.age, coalesce(s.n, 0) AS n_pairs, CASE WHEN s.n >= 15 AND s.w > 0 THEN s.dw / s.w END AS delta
      FROM (VALUES ('xg'), ('xa'), ('goals'), ('assists')) m(metric), (SELECT CAST(range AS INT) AS age FROM range(18, 37)) a
      LEFT JOIN (SELECT metric, age, count(*) AS n, sum(weight) AS w, sum(delta * weight) AS dw FROM v_pairs GROUP BY 1, 2) s
        ON s.metric = m.metric AND s.age = a.age)))""")
view("v_arrival", """SELECT n.team_id, n.player_id, p.position_group, n.mins FROM (
  SELECT team_id, player_id, CAST(sum(mins) AS BIGINT) AS mins FROM v_totals WHERE season_id = (SELECT cur FROM v_now) AND source = 'fpl' GROUP BY 1, 2) n
  LEFT JOIN v_player p USING (player_id) WHERE n.mins >= 1 AND NOT EXISTS (SELECT 1 FROM v_totals o
    WHERE o.season_id = (SELECT prev FROM v_now) AND o.source = 'vaastav' AND o.player_id = n.player_id AND o.team_id = n.team_id)""")


def history_totals(spark, sf):
    return T.player_season(B.fact(spark, sf)).filter(F.col("source") == "vaastav")


def ends_and_table(spark, sf):
    match = B.dim_match(spark, sf)
    ends = T.season_bounds(match).select("season_id", F.col("last_kickoff").alias("season_end"))
    return ends, T.standings(match)


def season_rows(spark, sf, totals):
    ends, table = ends_and_table(spark, sf)
    return CA.player_seasons(totals, B.dim_player(spark, sf), ends, table, STATS)


def history_rows(spark, sf):
    return season_rows(spark, sf, history_totals(spark, sf))


def blended_rows(spark, sf):
    return CA.blend_with_previous(history_rows(spark, sf), None, STATS, METHOD)


def blended_now(spark, sf):
    current = T.player_season(B.fact(spark, sf)).filter(F.col("source") == "fpl")
    return CA.blend_with_previous(season_rows(spark, sf, current), history_rows(spark, sf), STATS, METHOD)


def labelled(spark, sf):
    return CA.asof_nearest_valuation(blended_rows(spark, sf), T.with_receipt(B.market_values(spark, sf)), VALUE)


_RATES = [f"{s}_p90" for s in STATS]
_R = ", ".join(f"round({c}, 6) AS {c}" for c in _RATES)


@query("player_seasons_ml", f"""SELECT player_id, season_id, team_id, position_group, round(age, 6) AS age, mins, round(minutes_share, 6) AS minutes_share,
  round(team_ppg, 6) AS team_ppg, season_end, as_of, {_R} FROM v_history_rows""")
def player_seasons_ml(spark, sf):
    df = rounded(history_rows(spark, sf), "age", "minutes_share", "team_ppg", *_RATES)
    return df.drop("birth_date").withColumnRenamed("minutes", "mins")


@query("blend_with_previous", f"""SELECT player_id, season_id, mins, effective_minutes, used_previous_season, as_of, {_R} FROM v_blended_rows""")
def blend_with_previous(spark, sf):
    return rounded(blended_rows(spark, sf), *_RATES).select(
        "player_id", "season_id", F.col("minutes").alias("mins"), "effective_minutes", "used_previous_season",
        "as_of", *_RATES)


@query("asof_nearest_valuation", """SELECT player_id, season_id, season_end, value_eur, round(log_value, 6) AS log_value, value_date, value_source FROM v_labelled""")
def asof_nearest_valuation(spark, sf):
    return rounded(labelled(spark, sf), "log_value").select(
        "player_id", "season_id", "season_end", "value_eur", "log_value", "value_date", "value_source")


@query("consecutive_season_pairs", """SELECT player_id, season_from, season_to, age, metric, round(delta, 6) AS delta, round(weight, 6) AS weight FROM v_pairs""")
def consecutive_season_pairs(spark, sf):
    return rounded(CA.consecutive_season_pairs(history_rows(spark, sf), AGES.metrics, AGES.min_minutes), "delta", "weight")


def pairs(spark, sf):
    return CA.consecutive_season_pairs(history_rows(spark, sf), AGES.metrics, AGES.min_minutes)


@query("harmonic_mean", "SELECT DISTINCT player_id, season_from, round(weight, 6) AS weight FROM v_pairs")
def harmonic_mean(spark, sf):
    return pairs(spark, sf).select("player_id", "season_from", r6("weight").alias("weight")).distinct()


@query("pair_count", "SELECT count(*) AS n FROM (SELECT DISTINCT player_id, season_from FROM v_pairs)")
def pair_count(spark, sf):
    return CA.pair_count(pairs(spark, sf))


@query("age_curve", "SELECT metric, age, round(delta, 6) AS delta, n_pairs FROM v_curve")
def age_curve(spark, sf):
    return rounded(CA.age_deltas(pairs(spark, sf), AGES), "delta")


@query("cumulative_curve", "SELECT metric, age, round(cumulative, 6) AS cumulative FROM v_curve")
def cumulative_curve(spark, sf):
    return rounded(CA.age_curve(pairs(spark, sf), AGES).select("metric", "age", "cumulative"), "cumulative")


@query("age_projection", f"""SELECT b.player_id, m.metric, CAST(floor((DATE '{B.TODAY}' - b.birth_date) / 365.25::DOUBLE) AS INT) AS age,
  round(m.r, 6) AS current, round(c.delta, 6) AS delta, coalesce(c.n_pairs, 0) AS n_pairs, round(greatest(0, m.r + c.delta), 6) AS projected
  FROM v_blended_now b, LATERAL (SELECT 'xg' AS metric, b.xg_p90 AS r UNION ALL SELECT 'xa', b.xa_p90 UNION ALL SELECT 'goals', b.goals_p90
    UNION ALL SELECT 'assists', b.assists_p90) m
  LEFT JOIN v_curve c ON c.metric = m.metric AND c.age = CAST(floor((DATE '{B.TODAY}' - b.birth_date) / 365.25::DOUBLE) AS INT)""".replace(
      "greatest(0, m.r + c.delta)", "CASE WHEN m.r + c.delta IS NOT NULL THEN greatest(0, m.r + c.delta) END"))
def age_projection(spark, sf):
    df = CA.age_projection(blended_now(spark, sf), CA.age_curve(pairs(spark, sf), AGES), F.lit(B.TODAY).cast("date"))
    return rounded(df.select("player_id", "metric", "age", "current", "delta", "n_pairs", "projected"),
                   "current", "delta", "projected")


@query("arrivals_anti", "SELECT team_id, player_id, position_group, mins FROM v_arrival")
def arrivals_anti(spark, sf):
    return arrivals(spark, sf).withColumnRenamed("minutes", "mins")


def arrivals(spark, sf):
    cur = B.current_season(spark, sf)
    return CA.arrivals_anti(T.player_season(B.fact(spark, sf)), B.dim_player(spark, sf), S.previous_season(cur), cur)


_ORDER = "list_position(['" + "', '".join(catalogue.GROUPS) + "'], position_group)"
view("v_most_signed", f"""SELECT team_id, position_group, n, rank FROM (SELECT c.team_id, t.position_group, t.total - coalesce(o.own, 0) AS n,
    row_number() OVER (PARTITION BY c.team_id ORDER BY t.total - coalesce(o.own, 0) DESC, {_ORDER.replace('position_group', 't.position_group')}) AS rank
  FROM v_club c, (SELECT position_group, count(*) AS total FROM v_arrival WHERE position_group IS NOT NULL GROUP BY 1) t
  LEFT JOIN (SELECT team_id, position_group, count(*) AS own FROM v_arrival GROUP BY 1, 2) o ON o.team_id = c.team_id AND o.position_group = t.position_group
  WHERE t.total - coalesce(o.own, 0) > 0) WHERE rank <= 3""")


@query("most_signed", "SELECT team_id, position_group, n, rank FROM v_most_signed")
def most_signed(spark, sf):
    clubs = T.current_clubs(B.dim_team(spark, sf), B.dim_match(spark, sf), B.current_season(spark, sf))
    return CA.most_signed(arrivals(spark, sf), clubs, 3, catalogue.GROUPS)


@query("relabel_source", """SELECT season_id, CASE WHEN season_id = (SELECT prev FROM v_now) AND source = 'vaastav' THEN 'fpl' ELSE source END AS source,
  count(*) AS n, CAST(sum(mins) AS BIGINT) AS mins FROM v_totals GROUP BY 1, 2""")
def relabel_source(spark, sf):
    totals = T.player_season(B.fact(spark, sf))
    out = CA.relabel_source(totals, S.previous_season(B.current_season(spark, sf)))
    return out.groupBy("season_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("minutes").alias("mins"))


# Backtest: last season replayed as current. The clubs are those in last season's table that
# are still in the league.
view("b_squad", """SELECT t.team_id, t.player_id, sum(mins) AS mins, p.position_group FROM v_totals t JOIN v_player p USING (player_id)
  WHERE t.source = 'vaastav' AND t.season_id = (SELECT prev FROM v_now) AND p.position_group IS NOT NULL GROUP BY 1, 2, 4""")
view("b_score", """SELECT s.team_id, s.position_group, f.kpi, sum(f.percentile * s.mins) / sum(s.mins) AS score FROM b_squad s
  JOIN b_features f USING (player_id) WHERE f.season_mode = 'blended' AND f.percentile IS NOT NULL AND s.mins > 0 GROUP BY 1, 2, 3""")
view("b_club", "SELECT team_id FROM v_standings WHERE season_id = (SELECT prev FROM v_now) AND team_id IN (SELECT team_id FROM v_club)")
view("b_severity", """SELECT team_id, position_group, sum(CASE WHEN gap IS NOT NULL THEN weight * greatest(gap, 0) END) AS severity FROM (
  SELECT c.team_id, w.position_group, w.weight, CASE WHEN abs(bench - s.score) < 1e-9 THEN 0 ELSE bench - s.score END AS gap FROM (
    SELECT c.team_id, w.position_group, w.kpi, (SELECT avg(b.score) FROM b_score b WHERE b.position_group = w.position_group AND b.kpi = w.kpi
      AND b.team_id IN (SELECT team_id FROM v_member) AND b.team_id <> c.team_id) AS bench FROM b_club c, v_weight w) c
  JOIN v_weight w USING (position_group, kpi) LEFT JOIN b_score s ON s.team_id = c.team_id AND s.position_group = c.position_group AND s.kpi = c.kpi) GROUP BY 1, 2""")
view("b_top", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY severity DESC, position_group) AS r FROM b_severity WHERE severity > 0) WHERE r <= 3""")
view("b_signed", "SELECT DISTINCT team_id, position_group FROM v_arrival WHERE position_group IS NOT NULL")
view("b_precision", """SELECT c.team_id, coalesce(p.hits, 0) AS hits, CASE WHEN p.n > 0 AND s.k > 0 THEN p.hits / p.n::DOUBLE END AS precision,
  CASE WHEN p.n > 0 AND s.k > 0 AND b.n > 0 THEN b.hits / b.n::DOUBLE END AS baseline_precision, CASE WHEN p.n > 0 AND s.k > 0 THEN s.k / 8.0::DOUBLE END AS random_precision,
  CASE WHEN coalesce(s.k, 0) = 0 THEN 'no arrivals yet' WHEN coalesce(p.n, 0) = 0 THEN 'no shortfall vs benchmark' END AS skipped
  FROM b_club c
  LEFT JOIN (SELECT t.team_id, count(*) AS n, count(g.team_id) AS hits FROM b_top t LEFT JOIN b_signed g ON g.team_id = t.team_id AND g.position_group = t.position_group GROUP BY 1) p USING (team_id)
  LEFT JOIN (SELECT t.team_id, count(*) AS n, count(g.team_id) AS hits FROM v_most_signed t LEFT JOIN b_signed g ON g.team_id = t.team_id AND g.position_group = t.position_group GROUP BY 1) b USING (team_id)
  LEFT JOIN (SELECT team_id, count(*) AS k FROM b_signed GROUP BY 1) s USING (team_id)""")


def run_backtest(spark, sf):
    """The replay of last season, run once per session for both of its readers."""
    return warehouse(spark, sf, "backtest", lambda: replayed(spark, sf))


def replayed(spark, sf):
    cur = B.current_season(spark, sf)
    fact = B.fact(spark, sf)
    totals = T.player_season(fact)
    padj = T.defensive_padj(fact, B.dim_match(spark, sf), B.fact_team(spark, sf))
    match = B.dim_match(spark, sf)
    clubs = T.current_clubs(B.dim_team(spark, sf), match, cur)
    return BT.backtest(totals, padj, B.dim_player(spark, sf), T.standings(match), clubs, cur, m=METHOD)


@query("precision_at_n", """SELECT team_id, hits, round(precision, 6) AS precision, round(baseline_precision, 6) AS baseline_precision,
  round(random_precision, 6) AS random_precision, skipped FROM b_precision""")
def precision_at_n(spark, sf):
    return rounded(run_backtest(spark, sf), "precision", "baseline_precision", "random_precision")


@query("backtest", """SELECT round(avg(precision), 6) AS precision, round(avg(baseline_precision), 6) AS baseline_precision, round(avg(random_precision), 6) AS random_precision,
  round(avg(CASE WHEN precision IS NOT NULL THEN CAST(hits > 0 AS DOUBLE) END), 6) AS hit_rate, count(precision) AS evaluated,
  count(*) FILTER (skipped = 'no arrivals yet') AS no_arrivals, count(*) FILTER (skipped = 'no shortfall vs benchmark') AS no_shortfall FROM b_precision""")
def backtest(spark, sf):
    return rounded(CA.backtest_summary(run_backtest(spark, sf)), "precision", "baseline_precision", "random_precision", "hit_rate")


@query("compare_entities", """SELECT coalesce(x.team_id, y.team_id) AS team_id, coalesce(x.position_group, y.position_group) AS position_group, coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b,
  coalesce(x.kpi, y.kpi) AS kpi, round(pct_a, 6) AS pct_a, round(pct_b, 6) AS pct_b, round(pct_a - pct_b, 6) AS delta, d.kpi IS NOT NULL AS is_need
  FROM (SELECT l.team_id, l.position_group, p.player_id AS a, l.player_id AS b, f.kpi, f.percentile AS pct_a FROM v_leader_any l JOIN v_profile p ON p.position_group = l.position_group AND p.player_id <> l.player_id
    JOIN v_cand_pct f ON f.player_id = p.player_id) x
  FULL JOIN (SELECT l.team_id, l.position_group, p.player_id AS a, l.player_id AS b, f.kpi, f.percentile AS pct_b FROM v_leader_any l JOIN v_profile p ON p.position_group = l.position_group AND p.player_id <> l.player_id
    JOIN v_cand_pct f ON f.player_id = l.player_id) y USING (team_id, position_group, a, b, kpi)
  LEFT JOIN v_deficit d ON d.team_id = coalesce(x.team_id, y.team_id) AND d.position_group = coalesce(x.position_group, y.position_group) AND d.kpi = coalesce(x.kpi, y.kpi)""")
def compare_entities(spark, sf):
    x = Inputs(spark, sf)
    profiles = x.profiles().select("position_group", F.col("player_id").alias("a"))
    lead = T.incumbent(x.squads).select("team_id", "position_group", F.col("player_id").alias("b"))
    pairs_ = lead.join(profiles, "position_group").filter("a != b")
    mine = x.features.filter(F.col("season_mode") == "blended").join(
        N.weights_frame(x.features).select("position_group", "kpi"), ["position_group", "kpi"])
    df = CA.compare_entities(pairs_, mine, x.gaps().filter("gap > 0 and weight > 0"))
    return rounded(df, "pct_a", "pct_b", "delta")


@query("attach_value_score", """SELECT p.player_id, p.current_team_id, s.implied_value_eur, s.value_label FROM v_profile p LEFT JOIN (
  SELECT player_id, round(value_eur * 1.1::DOUBLE, 6) AS implied_value_eur, CASE WHEN value_eur < 5000000 THEN 'Undervalued' WHEN value_eur > 20000000 THEN 'Premium' ELSE 'Fair' END AS value_label
  FROM v_best_value WHERE player_id % 2 = 0) s USING (player_id)""")
def attach_value_score(spark, sf):
    x = Inputs(spark, sf)
    best = T.prefer_source(T.latest_value_per_source(B.market_values(spark, sf)),
                           ("override", "transfermarkt", "transfermarkt_datasets"))
    season = F.when(F.col("player_id") % 2 == 0, x.cur).otherwise(x.prev)
    scores = best.select("player_id", season.alias("season_id"), r6(F.col("value_eur") * 1.1).alias("implied_value_eur"),
                         S.band_label("value_eur", F.lit(5_000_000), F.lit(20_000_000)).alias("value_label"))
    profiles = x.profiles().select("player_id", "current_team_id")
    return CA.attach_value_score(profiles, scores, x.cur)


@query("union_sources", """SELECT source, count(*) AS n, count(reason) AS with_reason, CAST(sum(value_eur) AS BIGINT) AS value_eur FROM (
  SELECT id, source, value_eur, NULL AS reason FROM v_value WHERE source = 'transfermarkt' UNION ALL
  SELECT id, source, value_eur, NULL FROM v_value WHERE source = 'transfermarkt_datasets' UNION ALL
  SELECT id, source, value_eur, 'copied ' || tm_last_updated FROM v_value WHERE source = 'override') GROUP BY 1""")
def union_sources(spark, sf):
    values = B.market_values(spark, sf)
    live = values.filter(F.col("source") == "transfermarkt")
    stale = values.filter(F.col("source") == "transfermarkt_datasets")
    override = values.filter(F.col("source") == "override").withColumn(
        "reason", F.concat(F.lit("copied "), F.col("tm_last_updated").cast("string")))
    return BT.union_sources(live, stale, override).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("reason").alias("with_reason"), F.sum("value_eur").alias("value_eur"))


view("v_norm_club", "SELECT team_id, name, fpl_code, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM v_team")
_VARIANTS = """SELECT upper(name) AS query, team_id FROM v_norm_club UNION ALL SELECT 'Sporting & ' || name, team_id FROM v_norm_club
  UNION ALL SELECT 'N' || team_id, team_id FROM v_norm_club UNION ALL SELECT name || ' reserves', NULL FROM v_norm_club"""


def club_names(spark, sf):
    t = B.table(spark, sf, "nation")
    name, key = F.col("n_name"), F.col("n_nationkey")
    variants = F.array(F.upper(name), F.concat(F.lit("Sporting & "), name),
                       F.concat(F.lit("N"), key.cast("string")), F.concat(name, F.lit(" reserves")))
    aliases = t.select(name.alias("canonical"), F.array(
        F.concat(F.lit("Sporting and "), name), F.concat(F.lit("N"), key.cast("string"))).alias("alternatives"))
    return t.select(F.explode(variants).alias("query")), aliases


@query("find_club", f"""SELECT q.query, q.team_id FROM ({_VARIANTS} UNION ALL SELECT CAST(team_id AS VARCHAR), team_id FROM v_norm_club) q
  WHERE q.team_id IN (SELECT team_id FROM v_club)""")
def find_club(spark, sf):
    names, aliases = club_names(spark, sf)
    ids = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("query"))
    clubs = T.current_clubs(B.dim_team(spark, sf), B.dim_match(spark, sf), B.current_season(spark, sf))
    return SE.find_club(names.unionByName(ids), clubs, aliases)


@query("club_alias_map", f"""SELECT q.query AS name, t.fpl_code AS team_code FROM ({_VARIANTS}) q LEFT JOIN v_team t
  ON t.team_id = q.team_id AND q.query NOT LIKE '%&%'""")
def club_alias_map(spark, sf):
    names, aliases = club_names(spark, sf)
    teams = B.dim_team(spark, sf).select("name", F.col("fpl_code").alias("team_code"))
    return SE.club_alias_map(names.withColumnRenamed("query", "name"), teams, aliases)


view("s_entry", """SELECT id, label, matched, trim(regexp_replace(lower(matched), '[^a-z0-9]+', ' ', 'g')) AS key FROM (
  SELECT p_partkey AS id, p_name AS label, p_name AS matched FROM part UNION ALL SELECT p_partkey, p_name, p_type || ' ' || p_name FROM part)""")
view("s_query", """SELECT DISTINCT query, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) AS q FROM (
  SELECT substr(p_name, 1, 3) AS query FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part UNION ALL SELECT p_name FROM part
  UNION ALL SELECT substr(p_name, 1, 1) || substr(p_name, 3) FROM part UNION ALL SELECT upper(p_type) FROM part)""")
view("s_exact", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, label, id) AS rn FROM (
  SELECT q, id, label, max(score) AS score, (list(matched ORDER BY score DESC, matched DESC))[1] AS matched FROM (
    SELECT q.q, e.id, e.label, e.matched, CASE WHEN e.key = q.q THEN 100.0::DOUBLE WHEN starts_with(e.key, q.q) THEN 90.0::DOUBLE ELSE 80.0::DOUBLE END AS score
    FROM (SELECT DISTINCT q FROM s_query) q JOIN s_entry e ON starts_with(e.key, q.q) OR contains(' ' || e.key, ' ' || q.q)) GROUP BY 1, 2, 3)) WHERE rn <= 8""")
view("s_similar", """SELECT q.q, k.key, 100 * (1 - levenshtein(q.q, k.key) / greatest(length(q.q), length(k.key))::DOUBLE) AS score
  FROM (SELECT DISTINCT q FROM s_query) q, (SELECT DISTINCT key FROM s_entry) k WHERE 100 * (1 - levenshtein(q.q, k.key) / greatest(length(q.q), length(k.key))::DOUBLE) >= 75""")
view("s_fuzzy", """SELECT s.q, e.id, e.label, max(s.score) AS score, (list(e.matched ORDER BY s.score DESC, e.matched DESC))[1] AS matched FROM s_similar s
  JOIN (SELECT id, label, key, min(matched) AS matched FROM s_entry GROUP BY 1, 2, 3) e ON e.key = s.key
  WHERE s.q NOT IN (SELECT q FROM s_exact GROUP BY q HAVING count(*) >= 8)
  AND (s.q, e.id) NOT IN (SELECT (q, id) FROM s_exact) GROUP BY 1, 2, 3""")


@query("prefix_search", """SELECT q.query, r.id, r.label, r.matched, r.kind, round(r.score, 6) AS score, r.rank FROM s_query q JOIN (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE kind WHEN 'exact' THEN 1 WHEN 'prefix' THEN 2 ELSE 3 END, score DESC, label, id) AS rank FROM (
    SELECT q, id, label, matched, CASE WHEN score = 100 THEN 'exact' ELSE 'prefix' END AS kind, score FROM s_exact
    UNION ALL SELECT q, id, label, matched, 'fuzzy', score FROM s_fuzzy)) r ON r.q = q.q WHERE r.rank <= 8""")
def prefix_search(spark, sf):
    part = B.table(spark, sf, "part")
    name = F.col("p_name")
    names = part.select(F.col("p_partkey").alias("id"), name.alias("label"),
                        F.array(name, F.concat_ws(" ", "p_type", name)).alias("spellings"))
    queries = part.select(F.explode(F.array(
        F.substring(name, 1, 3), F.try_element_at(F.split(name, " "), F.lit(2)), name,
        F.concat(F.substring(name, 1, 1), F.expr("substring(p_name, 3)")), F.upper("p_type"))).alias("query")).filter("query is not null")
    return rounded(SE.prefix_search(queries, names), "score")


@query("edit_similarity", f"""SELECT q, key, round(score, 6) AS score FROM (
  SELECT q.q, k.key, 100 * (1 - levenshtein(q.q, k.key) / greatest(length(q.q), length(k.key))::DOUBLE) AS score
  FROM (SELECT DISTINCT q FROM s_query WHERE q <> '') q JOIN (SELECT DISTINCT key FROM s_entry WHERE key <> '') k
    ON length(k.key) BETWEEN 0.75 * length(q.q) - 1 AND length(q.q) / 0.75 + 1) WHERE score >= {FUZZY_CUTOFF}""")
def edit_similarity(spark, sf):
    part = B.table(spark, sf, "part")
    name = F.col("p_name")
    keys = part.select(F.explode(F.array(name, F.concat_ws(" ", "p_type", name))).alias("k")).select(
        NM.normalise_name("k").alias("key")).distinct()
    queries = part.select(F.explode(F.array(
        F.substring(name, 1, 3), F.try_element_at(F.split(name, " "), F.lit(2)), name,
        F.concat(F.substring(name, 1, 1), F.expr("substring(p_name, 3)")), F.upper("p_type"))).alias("query"))
    q = queries.select(NM.normalise_name("query").alias("q")).distinct()
    return rounded(SE.similar_strings(q, keys), "score")
