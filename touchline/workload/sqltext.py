"""Oracle SQL: the test tables bound to the domain roles, as shared named views."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _close(text: str, start: int) -> int:
    """Position of the parenthesis closing the one opened just before ``start``."""
    depth = 1
    for i in range(start, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return i
    raise ValueError("unbalanced parentheses")


def spell_rounding(sql: str) -> str:
    """``round(x, 6)`` as the same floor arithmetic the Spark side uses, so that values half
    way between two steps go the same way in both engines."""
    at = 0
    while (found := sql.find("round(", at)) >= 0:
        end = _close(sql, found + 6)
        inner = sql[found + 6:end]
        if inner.endswith(", 6"):
            body = f"(floor(({inner[:-3]})::DOUBLE * 1000000::DOUBLE + 0.5001::DOUBLE) / 1000000::DOUBLE)"
            sql = sql[:found] + body + sql[end + 1:]
        at = found + 1
    return sql


def compose(sql: str) -> str:
    """Prefix ``sql`` with the shared views it mentions, directly or through other views."""
    return spell_rounding(_compose(sql))


def _compose(sql: str) -> str:
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in ordered)
    return f"WITH {ctes}\n{sql.lstrip()}" if not sql.lstrip().upper().startswith("WITH ") else (
        f"WITH {ctes},\n{sql.lstrip()[5:]}")


def label(year: str) -> str:
    return f"printf('%d-%02d', {year}, ({year} + 1) % 100)"


view("v_season", f"""SELECT season_id, season_id = max(season_id) OVER () AS is_current FROM (
  SELECT DISTINCT {label('year(o_orderdate)')} AS season_id FROM orders)""")

view("v_now", """SELECT season_id AS cur,
  printf('%d-%02d', CAST(substr(season_id,1,4) AS INT) - 1, CAST(substr(season_id,1,4) AS INT) % 100) AS prev,
  printf('%d-%02d', CAST(substr(season_id,1,4) AS INT) - 2, (CAST(substr(season_id,1,4) AS INT) - 1) % 100) AS prev2
  FROM v_season WHERE is_current""")

view("v_fact", f"""SELECT o.o_custkey AS player_id, l.l_orderkey AS match_id, s.s_nationkey AS team_id,
  {label('year(o.o_orderdate)')} AS season_id,
  CASE WHEN l.l_linestatus = 'O' THEN 'understat'
       WHEN {label('year(o.o_orderdate)')} = (SELECT cur FROM v_now) THEN 'fpl' ELSE 'vaastav' END AS source,
  CAST(l.l_quantity AS BIGINT) AS mins,
  CASE WHEN l.l_quantity > 25 THEN true WHEN l.l_quantity > 5 THEN false END AS started,
  CAST(l.l_returnflag = 'R' AS BIGINT) AS goals, CAST(l.l_returnflag = 'A' AS BIGINT) AS assists,
  round(l.l_discount * 100) / 16 AS xg, round(l.l_discount * 100) / 32 AS npxg,
  CASE WHEN l.l_returnflag <> 'R' THEN round(l.l_tax * 100) / 16 END AS xa,
  CAST(l.l_linenumber AS BIGINT) AS shots, CAST(l.l_linenumber % 3 AS BIGINT) AS key_passes,
  (round(l.l_discount * 100) + round(l.l_tax * 100)) / 16 AS xg_chain, round(l.l_tax * 100) / 32 AS xg_buildup,
  l.l_suppkey % 5 AS tackles, l.l_partkey % 7 AS recoveries, l.l_partkey % 4 AS cbi,
  l.l_suppkey % 5 + l.l_partkey % 7 AS def_contribution, round(l.l_discount * 100) / 8 AS xgc_on_pitch,
  CAST(l.l_quantity AS BIGINT) % 4 AS saves, CAST(l.l_linenumber % 3 AS BIGINT) AS goals_conceded,
  CAST(l.l_partkey % 25 = 0 AS BIGINT) AS penalties_saved, CAST(l.l_partkey % 10 = 0 AS BIGINT) AS yellow_cards,
  CAST(l.l_partkey % 50 = 0 AS BIGINT) AS red_cards, CAST(l.l_shipdate AS DATE) AS fetched_at
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""")

view("v_match", f"""SELECT * FROM (SELECT o.o_orderkey AS match_id, {label('year(o.o_orderdate)')} AS season_id,
  CASE WHEN o.o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(o.o_orderdate AS DATE) END AS kickoff,
  c.c_nationkey AS home_team_id, t.away AS away_team_id,
  CASE WHEN o.o_orderstatus <> 'P' THEN t.hs END AS home_score,
  CASE WHEN o.o_orderstatus <> 'P' THEN t.aws END AS away_score
  FROM (SELECT l_orderkey, min(s_nationkey) AS away, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS hs,
        CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS aws
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) t
  JOIN orders o ON o.o_orderkey = t.l_orderkey JOIN customer c ON o.o_custkey = c.c_custkey)
  WHERE home_team_id <> away_team_id""")

view("v_team_lines", """SELECT l_orderkey AS match_id, s_nationkey AS team_id,
  CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS cents, sum(round(l_discount * 100)) / 16 AS xg,
  sum(round(l_discount * 100)) / 32 AS npxg, sum(l_quantity) / 4 AS ppda,
  CAST(sum(l_linenumber) AS DOUBLE) AS deep,
  sum(CASE WHEN l_returnflag = 'A' THEN round(l_discount * 100) ELSE 0 END) / 16 AS sp,
  sum(CASE WHEN l_returnflag = 'N' THEN round(l_discount * 100) ELSE 0 END) / 16 AS op,
  CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS shots, max(CAST(l_shipdate AS DATE)) AS fetched_at
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")

view("v_team_fact", """SELECT a.match_id, a.team_id, 'espn' AS source,
    CASE WHEN b.teams > 1 THEN a.cents / b.cents END AS possession,
    CAST(NULL AS DOUBLE) AS xg, CAST(NULL AS DOUBLE) AS xga, CAST(NULL AS DOUBLE) AS npxg, CAST(NULL AS DOUBLE) AS npxga,
    CAST(NULL AS DOUBLE) AS ppda, CAST(NULL AS DOUBLE) AS ppda_allowed, CAST(NULL AS DOUBLE) AS deep,
    CAST(NULL AS DOUBLE) AS deep_allowed, CAST(NULL AS DOUBLE) AS set_piece_xg, CAST(NULL AS DOUBLE) AS set_piece_xga,
    CAST(NULL AS DOUBLE) AS open_play_xga, a.fetched_at
  FROM v_team_lines a JOIN (SELECT match_id, sum(cents) AS cents, count(*) AS teams FROM v_team_lines GROUP BY 1) b
    ON a.match_id = b.match_id
  UNION ALL
  SELECT a.match_id, a.team_id, 'understat', CAST(NULL AS DOUBLE), a.xg, b.xg - a.xg, a.npxg, b.npxg - a.npxg, a.ppda, b.ppda - a.ppda,
    a.deep, b.deep - a.deep, CASE WHEN b.shots > 0 THEN a.sp END, CASE WHEN b.shots > 0 THEN b.sp - a.sp END,
    CASE WHEN b.shots > 0 THEN b.op - a.op END, a.fetched_at
  FROM v_team_lines a JOIN (SELECT match_id, sum(xg) AS xg, sum(npxg) AS npxg, sum(ppda) AS ppda, sum(deep) AS deep,
    sum(sp) AS sp, sum(op) AS op, sum(shots) AS shots FROM v_team_lines GROUP BY 1) b ON a.match_id = b.match_id""")

view("v_player", """SELECT c_custkey AS player_id, c_name AS canonical_name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'GK' WHEN 'BUILDING' THEN 'CB' WHEN 'FURNITURE' THEN 'CM'
    WHEN 'HOUSEHOLD' THEN 'W' WHEN 'MACHINERY' THEN 'ST' END AS position_group,
  CASE WHEN c_custkey % 17 <> 0 THEN DATE '1962-01-01' + CAST(c_custkey * 37 % 7300 AS INTEGER) END AS birth_date,
  CASE WHEN c_custkey % 50 <> 0 THEN c_custkey + 5000000 END AS understat_id,
  CASE WHEN c_custkey % 5 <> 0 THEN 'tm' || c_custkey END AS tm_id FROM customer""")

view("v_team", """SELECT n_nationkey AS team_id, n_name AS name,
  CASE WHEN n_nationkey <> 24 THEN n_nationkey + 100 END AS fpl_code, n_regionkey AS region FROM nation""")

view("v_status", """SELECT event_id AS id, user_id AS player_id,
  CASE event_type WHEN 'signup' THEN 'a' WHEN 'click' THEN 'd' WHEN 'view' THEN 'a' WHEN 'purchase' THEN 'i' ELSE 'u' END AS fpl_status,
  CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS chance_of_playing,
  CASE WHEN event_id % 4 <> 0 THEN DATE '2001-06-01' + CAST(event_id * 13 % 900 AS INTEGER) END AS contract_expiry,
  ts AS fetched_at FROM events""")

view("v_value", """SELECT event_id AS id, user_id AS player_id,
  CASE event_type WHEN 'signup' THEN 'override' WHEN 'click' THEN 'transfermarkt' WHEN 'view' THEN 'transfermarkt' ELSE 'transfermarkt_datasets' END AS source,
  CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) * 1000 END AS value_eur,
  CASE WHEN event_id % 11 <> 0 THEN DATE '1995-01-01' + CAST(event_id * 7919 % 2500 AS INTEGER) END AS tm_last_updated,
  event_type = 'purchase' AS is_stale, ts AS fetched_at FROM events""")
