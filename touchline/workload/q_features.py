"""Rates, blending, shrinkage, percentiles and the feature table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import catalogue
from touchline.functions import scalars as S
from touchline.operators import common as C
from touchline.operators import features as FE
from touchline.operators import totals as T
from touchline.params import Methodology
from touchline.plans import features as PF
from touchline.workload import bindings as B
from touchline.workload.registry import query, r6, rounded
from touchline.workload.sqltext import view

# The test tables hold about 70 minutes per player, season and source, so the minutes
# thresholds of the bindings are scaled to them.
METHOD = replace(Methodology(), percentile_min_minutes=60.0, roles_min_minutes=60.0,
                 prev_minutes_cap=150.0)

_NUM = {  # KPI -> numerator over the season totals {t} and possession-adjusted totals {p}
    "def_activity_padj_p90": "{p}tackles_padj + {p}recoveries_padj + CASE WHEN position_group IN ('CB', 'FB') THEN {p}cbi_padj ELSE 0 END",
    "cbi_padj_p90": "{p}cbi_padj", "recoveries_padj_p90": "{p}recoveries_padj", "tackles_padj_p90": "{p}tackles_padj",
    "xgc_on_pitch_p90": "{t}xgc_on_pitch", "cards_p90": "{t}yellow_cards + {t}red_cards",
    "xg_buildup_p90": "{t}xg_buildup", "xg_chain_p90": "{t}xg_chain", "xa_p90": "{t}xa", "npxg_p90": "{t}npxg",
    "key_passes_p90": "{t}key_passes", "shots_p90": "{t}shots", "npxg_per_shot": "{t}npxg",
    "gk_goals_prevented_p90": "{t}xgc_on_pitch - {t}goals_conceded", "gk_save_pct": "{t}saves",
    "gk_saves_p90": "{t}saves", "goals_minus_xg_p90": "{t}goals - {t}xg",
}
_DEN = {"npxg_per_shot": "{t}shots", "gk_save_pct": "({t}saves + {t}goals_conceded)"}


def _rate(kpi: str, t: str, p: str) -> str:
    num = _NUM[kpi].format(t=t, p=p)
    den = _DEN.get(kpi)
    if den:
        d = den.format(t=t)
        return f"CASE WHEN {d} > 0 THEN ({num})::DOUBLE / {d} END"
    return f"CASE WHEN {t}mins > 0 THEN ({num}) * 90.0::DOUBLE / {t}mins END"


def _kpi_sql(cur: str, prev: str, totals: str = "v_player_totals", padj: str = "v_player_padj") -> str:
    parts = []
    for kpi, family, higher, proxy, k, _ in catalogue.KPIS:
        s_cur, s_prev = PF.FAMILY_SOURCES[family]
        uses = catalogue.FORMULAS[kpi].padj
        status = ("CASE WHEN coalesce(pc.matches, 0) + coalesce(pp.matches, 0) = 0 OR coalesce(pc.unadjusted_matches, 0) + coalesce(pp.unadjusted_matches, 0)"
                  " = coalesce(pc.matches, 0) + coalesce(pp.matches, 0) THEN 'unadjusted'"
                  " WHEN coalesce(pc.unadjusted_matches, 0) + coalesce(pp.unadjusted_matches, 0) = 0 THEN 'adjusted' ELSE 'partial' END"
                  if uses else "CAST(NULL AS VARCHAR)")
        join_padj = (f" LEFT JOIN (SELECT * FROM {padj} WHERE season_id = {cur} AND source = '{s_cur}') pc ON pc.player_id = v.player_id"
                     f" LEFT JOIN (SELECT * FROM {padj} WHERE season_id = {prev} AND source = '{s_prev}') pp ON pp.player_id = v.player_id"
                     if uses else "")
        parts.append(
            f"SELECT v.player_id, v.position_group, '{kpi}' AS kpi, '{family}' AS source, {_rate(kpi, 'c.', 'pc.')} AS r_cur,"
            f" coalesce(c.mins, 0)::DOUBLE AS m_cur, {_rate(kpi, 'p.', 'pp.')} AS r_prev, coalesce(p.mins, 0)::DOUBLE AS m_prev,"
            f" {str(higher).lower()} AS higher_is_better, {str(proxy).lower()} AS is_proxy, {k}::DOUBLE AS k, {status} AS padj_status,"
            f" greatest(c.fetched_at, p.fetched_at) AS as_of"
            f" FROM v_player v LEFT JOIN (SELECT * FROM {totals} WHERE season_id = {cur} AND source = '{s_cur}') c ON c.player_id = v.player_id"
            f" LEFT JOIN (SELECT * FROM {totals} WHERE season_id = {prev} AND source = '{s_prev}') p ON p.player_id = v.player_id{join_padj}"
            f" WHERE v.position_group IS NOT NULL")
    return "\nUNION ALL\n".join(parts)


def _feature_views(prefix: str) -> None:
    view(f"{prefix}_modes", f"""SELECT player_id, position_group, kpi, source, higher_is_better, is_proxy, k, padj_status, as_of,
      r_cur AS raw_p90, m_cur AS mins, 'blended' AS season_mode,
      CASE WHEN wc + wp > 0 THEN (wc * coalesce(r_cur, 0) + wp * coalesce(r_prev, 0)) / (wc + wp) END AS value,
      wc + wp AS effective_minutes, wp > 0 AS used_previous_season
      FROM (SELECT *, CASE WHEN r_cur IS NOT NULL THEN greatest(m_cur, 0) ELSE 0 END AS wc,
        CASE WHEN r_prev IS NOT NULL THEN 0.5::DOUBLE * least(greatest(m_prev, 0), 150) ELSE 0 END AS wp FROM {prefix}_rates)
      UNION ALL SELECT player_id, position_group, kpi, source, higher_is_better, is_proxy, k, padj_status, as_of,
      r_cur, m_cur, 'current', r_cur, CASE WHEN r_cur IS NOT NULL THEN m_cur ELSE 0 END, false FROM {prefix}_rates""")
    view(f"{prefix}_shrunk", f"""SELECT m.*, (mm.n * m.value + m.k * mm.prior) / (mm.n + m.k) AS shrunk, mm.prior FROM {prefix}_modes m JOIN (
      SELECT player_id, kpi, season_mode, greatest(effective_minutes, 0) / 90 AS n,
        sum(CASE WHEN value IS NOT NULL AND effective_minutes > 0 THEN value * effective_minutes END) OVER w /
        nullif(sum(CASE WHEN value IS NOT NULL AND effective_minutes > 0 THEN effective_minutes END) OVER w, 0) AS prior
      FROM {prefix}_modes WINDOW w AS (PARTITION BY season_mode, position_group, kpi)) mm USING (player_id, kpi, season_mode)""")
    view(f"{prefix}_features", f"""SELECT s.*, r.percentile,
      count(r.percentile) OVER (PARTITION BY s.season_mode, s.position_group, s.kpi) AS n_peers
      FROM {prefix}_shrunk s LEFT JOIN (SELECT player_id, kpi, season_mode, 100.0::DOUBLE * percent_rank() OVER (
        PARTITION BY season_mode, position_group, kpi ORDER BY CASE WHEN higher_is_better THEN shrunk ELSE -shrunk END) AS percentile
        FROM {prefix}_shrunk WHERE effective_minutes >= 60 AND shrunk IS NOT NULL) r USING (player_id, kpi, season_mode)""")


view("v_player_padj", """SELECT player_id, season_id, source, sum(matches) AS matches, sum(unadjusted_matches) AS unadjusted_matches,
  sum(tackles_padj) AS tackles_padj, sum(recoveries_padj) AS recoveries_padj, sum(cbi_padj) AS cbi_padj FROM v_padj GROUP BY 1, 2, 3""")
view("f_rates", _kpi_sql("(SELECT cur FROM v_now)", "(SELECT prev FROM v_now)"))
_feature_views("f")

# Replay: last season's archive rows stand in for the current source.
view("b_totals", """SELECT * REPLACE (CASE WHEN source = 'vaastav' AND season_id = (SELECT prev FROM v_now) THEN 'fpl' ELSE source END AS source) FROM v_player_totals""")
view("b_padj", """SELECT * REPLACE (CASE WHEN source = 'vaastav' AND season_id = (SELECT prev FROM v_now) THEN 'fpl' ELSE source END AS source) FROM v_player_padj""")
view("b_rates", _kpi_sql("(SELECT prev FROM v_now)", "(SELECT prev2 FROM v_now)", "b_totals", "b_padj"))
_feature_views("b")


_STAGED: dict[tuple, DataFrame] = {}


def warehouse(spark, sf, name, build, partition_by=()):
    """A warehouse table several engines read: written once per session, then shared."""
    key = (B.version(spark, sf), name)
    if key not in _STAGED:
        _STAGED[key] = C.stage(build(), name, partition_by)
    return _STAGED[key]


def season_pair(spark, sf):
    cur = B.current_season(spark, sf)
    return cur, S.previous_season(cur)


def recent(spark, sf):
    """Lines of this season and the last one: what features, squads, profiles and club rates are made of."""
    return warehouse(spark, sf, "recent-lines", lambda: B.lines(spark, sf, season_pair(spark, sf)))


def totals_and_padj(spark, sf, of=None):
    fact = B.fact(spark, sf, of)
    return (T.player_season(fact, by_club=False),
            T.defensive_padj(fact, B.dim_match(spark, sf, of), B.fact_team(spark, sf, of), by_club=False))


def rates(spark, sf):
    totals, padj = totals_and_padj(spark, sf, recent(spark, sf))
    cur, prev = season_pair(spark, sf)
    return PF.kpi_rates(PF.season_slots(totals, padj, cur, prev), B.dim_player(spark, sf))


def features(spark, sf):
    totals, padj = totals_and_padj(spark, sf, recent(spark, sf))
    cur, prev = season_pair(spark, sf)
    return PF.features(totals, padj, B.dim_player(spark, sf), cur, prev, METHOD)


def staged_features(spark, sf):
    return warehouse(spark, sf, "features", lambda: features(spark, sf), ["season_mode"])


_FEATURE_SQL = """SELECT player_id, season_mode, position_group, kpi, source, round(raw_p90, 6) AS raw_p90, round(value, 6) AS value,
  mins, effective_minutes, used_previous_season, is_proxy, padj_status, as_of, round(shrunk, 6) AS shrunk,
  round(percentile, 6) AS percentile, n_peers FROM f_features"""


@query("features", _FEATURE_SQL)
def features_query(spark, sf):
    df = rounded(features(spark, sf), "raw_p90", "value", "shrunk", "percentile")
    return df.drop("higher_is_better", "shrinkage_k").withColumnRenamed("minutes", "mins")


@query("kpi_formulas", """SELECT player_id, kpi, source, round(r_cur, 6) AS rate_cur, round(r_prev, 6) AS rate_prev,
  m_cur AS mins_cur, m_prev AS mins_prev FROM f_rates""")
def kpi_formulas(spark, sf):
    return rates(spark, sf).select(
        "player_id", "kpi", "source", r6("rate_cur").alias("rate_cur"),
        r6("rate_prev").alias("rate_prev"), F.col("minutes").alias("mins_cur"),
        F.col("minutes_prev").alias("mins_prev"))


@query("padj_status", "SELECT player_id, kpi, padj_status FROM f_rates WHERE padj_status IS NOT NULL")
def padj_status(spark, sf):
    return rates(spark, sf).filter("padj_status is not null").select("player_id", "kpi", "padj_status")


@query("blend", """SELECT player_id, kpi, round(value, 6) AS rate, effective_minutes, used_previous_season AS used_previous
  FROM f_modes WHERE season_mode = 'blended'""")
def blend(spark, sf):
    b = S.blend("rate_cur", "minutes", "rate_prev", "minutes_prev", cap=METHOD.prev_minutes_cap)
    return rates(spark, sf).withColumn("b", b).select(
        "player_id", "kpi", r6("b.rate").alias("rate"),
        F.col("b.minutes").alias("effective_minutes"), "b.used_previous")


def modes(spark, sf):
    return PF.season_modes(rates(spark, sf), METHOD)


@query("weighted_prior", "SELECT DISTINCT season_mode, position_group, kpi, round(prior, 6) AS prior FROM f_shrunk")
def weighted_prior(spark, sf):
    return rounded(FE.weighted_prior(modes(spark, sf)), "prior")


@query("shrink", "SELECT player_id, season_mode, kpi, round(shrunk, 6) AS shrunk FROM f_shrunk")
def shrink(spark, sf):
    return FE.add_shrunk(modes(spark, sf)).select(
        "player_id", "season_mode", "kpi", r6("shrunk").alias("shrunk"))


@query("season_mode_filter", """SELECT player_id, kpi, round(value, 6) AS value, effective_minutes FROM f_modes WHERE season_mode = 'current'""")
def season_mode_filter(spark, sf):
    return staged_features(spark, sf).filter(F.col("season_mode") == "current").select(
        "player_id", "kpi", r6("value").alias("value"), "effective_minutes")


view("v_kpi_values", """SELECT p.player_id, p.position_group, k.kpi, t.mins, k.value, k.kpi <> 'conceded' AS higher_is_better FROM (
    SELECT player_id, sum(mins) AS mins, sum(goals) AS goals, sum(xa) AS xa, sum(xgc_on_pitch) AS conceded
    FROM v_fact WHERE source = 'understat' GROUP BY 1) t JOIN v_player p USING (player_id),
  LATERAL (SELECT 'goals' AS kpi, goals * 90.0::DOUBLE / mins AS value UNION ALL SELECT 'xa', xa * 90.0::DOUBLE / mins
    UNION ALL SELECT 'conceded', conceded * 90.0::DOUBLE / mins) k""")


def kpi_values(spark, sf):
    t = (B.fact(spark, sf).filter(F.col("source") == "understat").groupBy("player_id").agg(
        F.sum("minutes").alias("minutes"), F.sum("goals").alias("goals"), F.sum("xa").alias("xa"),
        F.sum("xgc_on_pitch").alias("conceded")))
    kpis = F.array(*[F.struct(F.lit(c).alias("kpi"), S.per90(c, "minutes").alias("value"),
                              F.lit(c != "conceded").alias("higher_is_better"))
                     for c in ("goals", "xa", "conceded")])
    return (t.join(B.dim_player(spark, sf).select("player_id", "position_group"), "player_id")
            .select("player_id", "position_group", "minutes", F.inline(kpis)))


@query("percentiles", """SELECT player_id, position_group, kpi, round(value, 6) AS value, mins,
  round(100.0::DOUBLE * percent_rank() OVER (PARTITION BY position_group, kpi ORDER BY CASE WHEN higher_is_better THEN value ELSE -value END), 6) AS percentile,
  count(*) OVER (PARTITION BY position_group, kpi) AS n_peers
  FROM v_kpi_values WHERE mins >= 300 AND value IS NOT NULL AND position_group IS NOT NULL""")
def percentiles(spark, sf):
    df = FE.percentiles(kpi_values(spark, sf), 300).drop("higher_is_better")
    return rounded(df, "value", "percentile").withColumnRenamed("minutes", "mins")


@query("eligible_for_rank", """SELECT player_id, kpi, round(value, 6) AS value FROM v_kpi_values
  WHERE mins >= 600 AND value IS NOT NULL AND position_group IS NOT NULL""")
def eligible_for_rank(spark, sf):
    return FE.eligible_for_rank(kpi_values(spark, sf)).select("player_id", "kpi", r6("value").alias("value"))


@query("n_peers_spread", """SELECT player_id, position_group, kpi, 'all' AS season_mode,
  count(*) FILTER (mins >= 300 AND value IS NOT NULL) OVER (PARTITION BY position_group, kpi) AS n_peers FROM v_kpi_values""")
def n_peers_spread(spark, sf):
    rows = kpi_values(spark, sf).withColumn("season_mode", F.lit("all"))
    ranked = FE.percentiles(rows, 300).select("player_id", "kpi", "n_peers")
    return FE.n_peers_spread(rows.join(ranked, ["player_id", "kpi"], "left")).select(
        "player_id", "position_group", "kpi", "season_mode", "n_peers")


@query("per90", """SELECT player_id, season_id, source, round(CASE WHEN mins > 0 THEN goals * 90.0::DOUBLE / mins END, 6) AS goals_p90,
  round(CASE WHEN mins > 0 THEN xa * 90.0::DOUBLE / mins END, 6) AS xa_p90 FROM v_player_totals""")
def per90(spark, sf):
    t = T.collapse_clubs(T.player_season(B.fact(spark, sf)))
    return t.select("player_id", "season_id", "source", r6(S.per90("goals", "minutes")).alias("goals_p90"),
                    r6(S.per90("xa", "minutes")).alias("xa_p90"))


@query("nineties", "SELECT player_id, season_id, source, round(greatest(mins, 0) / 90.0::DOUBLE, 6) AS nineties FROM v_player_totals")
def nineties(spark, sf):
    t = T.collapse_clubs(T.player_season(B.fact(spark, sf)))
    return t.select("player_id", "season_id", "source", r6(S.nineties("minutes")).alias("nineties"))
