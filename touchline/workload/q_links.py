"""Record linkage, name clean-up and validation.

A "club" is an order and its players are the order's parts, so the blocks have a few members
at any scale, as real squads do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import names as NM
from touchline.functions import scalars as S
from touchline.operators import linkage as L
from touchline.operators import quality as Q
from touchline.operators.common import stage
from touchline.workload import bindings as B
from touchline.workload.registry import query, r6, rounded
from touchline.workload.sqltext import view

_NORM = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_SORTED = "array_to_string(list_sort(string_split({x}, ' ')), ' ')"

view("l_line", """SELECT ok, pk, ok || '-' || pk AS code, mins, ship, p_name, p_type, s_name FROM (
  SELECT l_orderkey AS ok, l_partkey AS pk, sum(l_quantity) AS mins, CAST(min(l_shipdate) AS DATE) AS ship, min(l_suppkey) AS sk FROM lineitem GROUP BY 1, 2)
  JOIN part ON p_partkey = pk JOIN supplier ON s_suppkey = sk""")
view("l_spelling", f"""SELECT code, ok, ship, norm, {_SORTED.format(x='norm')} AS srt FROM (
  SELECT code, ok, ship, {_NORM.format(x="p_name || ' ' || s_name")} AS norm FROM l_line UNION ALL SELECT code, ok, ship, {_NORM.format(x='p_name')} FROM l_line)""")
_NAME = """CASE (pk + ok) % 5 WHEN 0 THEN upper(p_name || ' ' || s_name) WHEN 1 THEN s_name || ' ' || p_name
  WHEN 2 THEN substr(p_name, 1, 1) || substr(p_name, 3) || ' ' || s_name WHEN 3 THEN substr(p_name, 1, 3) || ' ' || s_name ELSE p_type || ' item' END"""
view("l_record", f"""SELECT *, {_NORM.format(x='name')} AS norm, {_SORTED.format(x=_NORM.format(x='name'))} AS srt FROM (
  SELECT CASE WHEN pk % 2 = 0 THEN 'understat' ELSE 'transfermarkt' END AS source, code || x.suffix AS source_id, ok, pk, code, {_NAME} AS name,
    CASE WHEN pk % 2 = 1 AND pk % 3 = 0 THEN ship WHEN pk % 2 = 1 AND pk % 3 = 2 THEN ship + 1 END AS birth,
    CASE WHEN (ok + pk) % 7 = 0 THEN [] WHEN (ok + pk) % 11 = 0 THEN [ok, ok + 1] ELSE [ok] END AS teams
  FROM l_line, (VALUES (''), ('b')) x(suffix) WHERE x.suffix = '' OR pk % 13 = 0)""")
view("l_override", """SELECT source, source_id, CASE WHEN (ok + pk) % 501 = 0 THEN 'none' ELSE code END AS code FROM l_record WHERE (ok * 7 + pk) % 97 = 0""")
view("l_pair", """SELECT r.source, r.source_id, a.code, r.norm AS b, r.srt AS bs, a.norm AS a, a.srt AS asrt, r.birth, a.ship
  FROM (SELECT *, unnest(teams) AS team FROM l_record) r JOIN l_spelling a ON a.ok = r.team""")
# A score of 88 needs few edits, or the surname of one name in the other.
_MAY = " OR ".join(f"(100 * (1 - abs(length(a.{c}) - length(r.{c})) / greatest(length(a.{c}), length(r.{c}))::DOUBLE) >= 88 AND "
                   f"100 * (1 - levenshtein(a.{c}, r.{c}) / greatest(length(a.{c}), length(r.{c}))::DOUBLE) >= 88)" for c in ("norm", "srt"))
view("l_any", f"""SELECT r.source, r.source_id, a.code, r.norm AS b, r.srt AS bs, a.norm AS a, a.srt AS asrt FROM l_record r JOIN l_spelling a ON a.ship = r.birth
  WHERE {_MAY} OR list_contains(string_split(a.norm, ' '), string_split(r.norm, ' ')[-1]) OR list_contains(string_split(r.norm, ' '), string_split(a.norm, ' ')[-1])""")
_SAME = "(u = short[{j}] OR (least(length(u), length(short[{j}])) >= 3 AND (starts_with(u, short[{j}]) OR starts_with(short[{j}], u))))"


def _token_sql(pairs: str) -> str:
    sql = f"""SELECT a, b, ta, tb, short, lng, coalesce(list_position(lng, short[-1]), 0) > 0 AS ok,
      list_concat(lng[1:coalesce(list_position(lng, short[-1]), 0) - 1], lng[coalesce(list_position(lng, short[-1]), 0) + 1:]) AS rest FROM (
      SELECT *, CASE WHEN len(ta) <= len(tb) THEN ta ELSE tb END AS short, CASE WHEN len(ta) <= len(tb) THEN tb ELSE ta END AS lng FROM (
        SELECT a, b, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb FROM (SELECT DISTINCT a, b FROM {pairs}
          WHERE list_contains(string_split(a, ' '), string_split(b, ' ')[-1]) OR list_contains(string_split(b, ' '), string_split(a, ' ')[-1]))))"""
    for j in range(1, 5):
        sql = f"""SELECT a, b, ta, tb, short, lng, ok AND ({j} >= len(short) OR p > 0) AS ok,
          CASE WHEN {j} < len(short) AND p > 0 THEN list_concat(rest[1:p - 1], rest[p + 1:]) ELSE rest END AS rest FROM (
          SELECT *, coalesce(list_position(list_transform(rest, lambda u: {_SAME.format(j=j)}), true), 0) AS p FROM ({sql}))"""
    return f"""SELECT a, b, CASE WHEN len(ta) < 2 THEN NULL WHEN ok THEN 'tokens'
      WHEN len(ta) = 2 AND len(tb) = 2 AND ta[2] = tb[2] AND substr(ta[1], 1, 1) = substr(tb[1], 1, 1) THEN 'initial' END AS rule FROM ({sql})"""


def _score_sql(pairs: str, rules: str, extra: str) -> str:
    sim = "100 * (1 - levenshtein({x}, {y}) / greatest(length({x}), length({y}))::DOUBLE)"
    return f"""SELECT p.source, p.source_id, p.code, {extra} max(greatest({sim.format(x='p.a', y='p.b')}, {sim.format(x='p.asrt', y='p.bs')},
      CASE t.rule WHEN 'tokens' THEN 95.0::DOUBLE WHEN 'initial' THEN 90.0::DOUBLE ELSE 0 END)) AS score
      FROM {pairs} p LEFT JOIN {rules} t ON t.a = p.a AND t.b = p.b GROUP BY p.source, p.source_id, p.code {', p.birth, p.ship' if extra else ''}"""


view("l_rule", _token_sql("l_pair"))
view("l_rule_any", _token_sql("l_any"))
view("l_score", _score_sql("l_pair", "l_rule", "p.birth, p.ship,"))
view("l_score_any", _score_sql("l_any", "l_rule_any", ""))
view("l_decided", """SELECT r.*, b.code AS best, b.score AS best_score, b.second, b.ship AS best_birth, d.code AS day_code, d.score AS day_score,
    coalesce(d.n, 0) = 1 AND d.score >= 60 AS by_day,
    CASE WHEN coalesce(d.n, 0) = 1 AND d.score >= 60 THEN NULL WHEN b.code IS NULL THEN 'no anchor players at this club'
      WHEN b.score < 88 THEN 'best score below the acceptance score' WHEN b.score - coalesce(b.second, 0) < 4 THEN 'ambiguous: runner-up within the margin'
      WHEN r.birth <> b.ship THEN 'date of birth mismatch' END AS reason
  FROM (SELECT r.source, r.source_id, r.name, r.birth FROM l_record r LEFT JOIN (SELECT * FROM l_override WHERE code <> 'none') o USING (source, source_id) WHERE o.code IS NULL) r
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM l_score
    WINDOW w AS (PARTITION BY source, source_id ORDER BY score DESC, code)) WHERE rn = 1) b ON b.source = r.source AND b.source_id = r.source_id
  LEFT JOIN (SELECT source, source_id, count(*) AS n, min(code) AS code, max(score) AS score FROM l_score WHERE birth = ship GROUP BY 1, 2) d
    ON d.source = r.source AND d.source_id = r.source_id""")
view("l_elsewhere", """SELECT u.source, u.source_id, min(s.code) AS code, max(s.score) AS score FROM l_decided u JOIN l_score_any s USING (source, source_id)
  WHERE u.reason IS NOT NULL AND s.score >= 88 GROUP BY 1, 2 HAVING count(*) = 1""")
view("l_link", """SELECT source, source_id, CASE WHEN by_day THEN day_code ELSE best END AS code, round_even(CASE WHEN by_day THEN day_score ELSE best_score END, 1) AS score,
    CASE WHEN by_day THEN 'dob' ELSE 'fuzzy' END AS method FROM l_decided WHERE reason IS NULL
  UNION ALL SELECT source, source_id, code, round_even(score, 1), 'dob_any_club' FROM l_elsewhere
  UNION ALL SELECT source, source_id, code, 100.0::DOUBLE, 'override' FROM l_override WHERE code <> 'none'""")
view("l_kept", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, code ORDER BY method = 'override' DESC, score DESC, source_id) AS rn FROM l_link) WHERE rn = 1""")
view("l_edge", "SELECT 'fpl:' || code AS a, source || ':' || source_id AS b FROM l_kept")


def lines(spark, sf):
    """A club's players, written once for the anchors, the records and whatever counts them."""
    return stage(_lines(spark, sf), "link-lines")


def _lines(spark, sf):
    li = (B.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_quantity").alias("minutes"), F.to_date(F.min("l_shipdate")).alias("ship"), F.min("l_suppkey").alias("sk")))
    part = B.table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    sup = B.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return (li.join(part, li.l_partkey == part.p_partkey).join(sup, li.sk == sup.s_suppkey).select(
        F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("code"),
        "minutes", "ship", "p_name", "p_type", "s_name"))


def anchors(spark, sf, of=None):
    full = F.concat_ws(" ", "p_name", "s_name")
    return (_lines(spark, sf) if of is None else of).select("code", F.array(full, F.col("p_name")).alias("names"),
                                   F.col("ok").alias("team_code"), F.col("ship").alias("birth_date"), "minutes")


def records(spark, sf, of=None):
    ok, pk, p, s = F.col("ok"), F.col("pk"), F.col("p_name"), F.col("s_name")
    kind = (pk + ok) % 5
    name = (F.when(kind == 0, F.upper(F.concat_ws(" ", p, s))).when(kind == 1, F.concat_ws(" ", s, p))
            .when(kind == 2, F.concat(F.substring(p, 1, 1), F.expr("substring(p_name, 3)"), F.lit(" "), s))
            .when(kind == 3, F.concat(F.substring(p, 1, 3), F.lit(" "), s)).otherwise(F.concat(F.col("p_type"), F.lit(" item"))))
    birth = F.when((pk % 2 == 1) & (pk % 3 == 0), F.col("ship")).when((pk % 2 == 1) & (pk % 3 == 2), F.date_add("ship", 1))
    teams = (F.when((ok + pk) % 7 == 0, F.array().cast("array<bigint>")).when((ok + pk) % 11 == 0, F.array(ok, ok + 1)).otherwise(F.array(ok)))
    suffix = F.when(pk % 13 == 0, F.array(F.lit(""), F.lit("b"))).otherwise(F.array(F.lit("")))
    return ((_lines(spark, sf) if of is None else of).withColumn("suffix", F.explode(suffix)).select(
        F.when(pk % 2 == 0, F.lit("understat")).otherwise(F.lit("transfermarkt")).alias("source"),
        F.concat("code", "suffix").alias("source_id"), name.alias("name"), ok.cast("string").alias("team_label"),
        teams.alias("team_codes"), birth.alias("birth_date"), "ok", "pk", "code"))


def overrides(recs):
    code = F.when((F.col("ok") + F.col("pk")) % 501 == 0, F.lit("none")).otherwise(F.col("code"))
    return recs.filter((F.col("ok") * 7 + F.col("pk")) % 97 == 0).select("source", "source_id", code.alias("code"))


def decided(spark, sf, of):
    recs = records(spark, sf, of)
    return L.link_decide(recs.drop("ok", "pk", "code"), anchors(spark, sf, of), overrides(recs))


@query("candidate_pairs_block", "SELECT DISTINCT source, source_id, code FROM l_pair")
def candidate_pairs_block(spark, sf):
    return L.candidate_pairs_block(records(spark, sf).drop("code"), anchors(spark, sf))


@query("normalise_name", f"""SELECT source, source_id, name, norm AS normalised FROM l_record""")
def normalise_name(spark, sf):
    return records(spark, sf).select("source", "source_id", "name", NM.normalise_name("name").alias("normalised"))


@query("sorted_tokens", "SELECT source, source_id, srt AS sorted FROM l_record")
def sorted_tokens(spark, sf):
    return records(spark, sf).select("source", "source_id", NM.sorted_tokens("name").alias("sorted"))


@query("token_match", "SELECT a, b, rule FROM (SELECT DISTINCT a, b FROM l_pair) LEFT JOIN l_rule USING (a, b)")
def token_match(spark, sf):
    of = lines(spark, sf)
    spelled = anchors(spark, sf, of).select("team_code", F.explode("names").alias("n"))
    recs = records(spark, sf, of).select(F.explode("team_codes").alias("team_code"), "name")
    return L.name_pairs(recs, spelled).withColumn("rule", NM.token_match("a", "b"))


@query("name_score", "SELECT source, source_id, code, round(score, 6) AS score FROM l_score")
def name_score(spark, sf):
    of = lines(spark, sf)
    return rounded(L.pair_scores(records(spark, sf, of).drop("code"), anchors(spark, sf, of)).select("source", "source_id", "code", "score"), "score")


@query("link_decide", """SELECT source, source_id, code, score, method FROM l_link
  UNION ALL SELECT d.source, d.source_id, d.best, round_even(d.best_score, 1), d.reason FROM l_decided d
  WHERE d.reason IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l_elsewhere e WHERE e.source = d.source AND e.source_id = d.source_id)""")
def link_decide(spark, sf):
    links, review, _bad = decided(spark, sf, lines(spark, sf))
    return links.unionByName(review.select("source", "source_id", F.col("best_candidate").alias("code"), "score",
                                           F.col("reason").alias("method")))


@query("link_conflicts", """SELECT k.source, k.source_id, k.code, k.score, k.method, 'link' AS outcome FROM l_kept k
  UNION ALL SELECT l.source, l.source_id, l.code, l.score, l.method, 'review' FROM l_link l ANTI JOIN l_kept k USING (source, source_id)""")
def link_conflicts(spark, sf):
    kept, lost = L.link_conflicts(decided(spark, sf, lines(spark, sf))[0])
    return (kept.withColumn("outcome", F.lit("link"))
            .unionByName(lost.drop("reason").withColumn("outcome", F.lit("review"))))


def kept_links(spark, sf, of):
    return L.link_conflicts(decided(spark, sf, of)[0])[0]


@query("link_components", """SELECT a AS node, least(a, min(b)) AS component FROM l_edge GROUP BY 1
  UNION ALL SELECT e.b, least(e.a, m.b) FROM l_edge e JOIN (SELECT a, min(b) AS b FROM l_edge GROUP BY 1) m ON m.a = e.a""")
def link_components(spark, sf):
    return L.link_components(L.link_edges(kept_links(spark, sf, lines(spark, sf))))


@query("link_mapping", """SELECT l.code, l.p_name || ' ' || l.s_name AS canonical_name, u.source_id AS understat_id, t.source_id AS transfermarkt_id FROM l_line l
  LEFT JOIN (SELECT * FROM l_kept WHERE source = 'understat') u ON u.code = l.code LEFT JOIN (SELECT * FROM l_kept WHERE source = 'transfermarkt') t ON t.code = l.code""")
def link_mapping(spark, sf):
    of = lines(spark, sf)
    return L.link_mapping(kept_links(spark, sf, of), anchors(spark, sf, of))


@query("build_anchors", """SELECT c_custkey AS code, array_to_string(CASE WHEN c_custkey % 3 = 0 THEN list_distinct([c_mktsegment]) ELSE [] END, '|') ||
    CASE WHEN c_custkey % 3 = 0 THEN '|' ELSE '' END || c_mktsegment || ' ' || c_name || '|' || c_name AS names, c_nationkey AS team_code,
  coalesce(f.mins, 0) AS mins FROM customer LEFT JOIN (SELECT player_id, sum(mins)::DOUBLE AS mins FROM v_fact WHERE source = 'fpl' GROUP BY 1) f ON f.player_id = c_custkey""")
def build_anchors(spark, sf):
    key = F.col("c_custkey")
    players = B.table(spark, sf, "customer").select(
        key.alias("code"), F.when(key % 3 == 0, F.col("c_mktsegment")).otherwise(F.lit("")).alias("known_name"),
        F.col("c_mktsegment").alias("first_name"), F.col("c_name").alias("second_name"), F.col("c_name").alias("web_name"),
        F.col("c_nationkey").alias("team_code"), F.lit(None).cast("date").alias("birth_date"))
    fact = B.fact(spark, sf).filter(F.col("source") == "fpl").select(F.col("player_id").alias("code"), "minutes")
    return L.build_anchors(players, fact).select("code", F.array_join("names", "|").alias("names"), "team_code", F.col("minutes").alias("mins"))


@query("build_records", """SELECT f.source_id, max(f.name) AS name, coalesce(string_agg(DISTINCT CAST(n.n_nationkey + 100 AS VARCHAR), ',' ORDER BY CAST(n.n_nationkey + 100 AS VARCHAR)), '') AS team_codes,
  string_agg(DISTINCT f.club, ', ' ORDER BY f.club) AS team_label FROM (SELECT o_custkey AS source_id, c_name AS name, n_name AS club, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_custkey = o_custkey WHERE l_linestatus = 'O') f
  LEFT JOIN nation n ON n.n_nationkey = f.s_nationkey AND n.n_nationkey <> 24 GROUP BY 1""")
def build_records(spark, sf):
    nation = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("club"))
    names = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"))
    rows = (B.fact(spark, sf).filter(F.col("source") == "understat").select(F.col("player_id").alias("source_id"), "team_id")
            .join(nation, "team_id").join(names, "source_id").withColumn("birth_date", F.lit(None).cast("date")))
    clubs = nation.filter("team_id != 24").select("club", (F.col("team_id") + 100).alias("team_code"))
    return L.build_records(rows, clubs, "understat").select(
        "source_id", "name", F.array_join(F.array_sort(F.transform("team_codes", lambda c: c.cast("string"))), ",").alias("team_codes"), "team_label")


# -- clean-up columns -------------------------------------------------------------------

@query("clean_money", """SELECT event_id, CASE event_id % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 0 THEN CAST(floor(value) AS BIGINT) * 1000000
    WHEN 1 THEN CAST(floor(value) AS BIGINT) * 1000 WHEN 2 THEN CAST(floor(value) AS BIGINT) * 1000000000 ELSE CAST(floor(value) AS BIGINT) END AS euros,
  event_id % 6 = 5 AS bad FROM events""")
def clean_money(spark, sf):
    eid, whole = F.col("event_id"), F.floor("value").cast("string")
    text = (F.when(eid % 6 == 0, F.concat(F.lit("€"), whole, F.lit(".00m"))).when(eid % 6 == 1, F.concat(F.lit("€ "), whole, F.lit("K")))
            .when(eid % 6 == 2, F.concat(F.lit("€"), whole, F.lit(".00bn"))).when(eid % 6 == 3, whole)
            .when(eid % 6 == 4, F.lit("-")).otherwise(F.concat(F.lit("-"), whole, F.lit(" pounds"))))
    m = S.clean_money(text)
    return B.table(spark, sf, "events").select("event_id", m.alias("m")).select("event_id", F.col("m.value").alias("euros"), "m.bad")


@query("clean_multi_date", """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CAST(ts AS DATE) END AS day, event_id % 5 = 4 AS bad FROM events""")
def clean_multi_date(spark, sf):
    eid = F.col("event_id")
    text = (F.when(eid % 5 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(eid % 5 == 1, F.date_format("ts", "MMM d, yyyy"))
            .when(eid % 5 == 2, F.date_format("ts", "dd.MM.yyyy")).when(eid % 5 == 3, F.lit("n/a")).otherwise(F.date_format("ts", "MM/dd/yy")))
    return B.table(spark, sf, "events").select("event_id", S.clean_multi_date(text).alias("d")).select(
        "event_id", F.col("d.value").alias("day"), "d.bad")


@query("clean_share", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber < 6 THEN round(CASE WHEN l_quantity * 2.5 <= 100 THEN l_quantity * 2.5 / 100 END, 6) END AS share,
  CASE WHEN l_linenumber < 6 THEN l_quantity * 2.5 > 100 WHEN l_linenumber = 6 THEN false ELSE true END AS bad FROM lineitem""")
def clean_share(spark, sf):
    n, pct = F.col("l_linenumber"), (F.col("l_quantity") * 2.5).cast("string")
    text = F.when(n < 3, F.concat(pct, F.lit("%"))).when(n < 6, pct).when(n == 6, F.lit(" ")).otherwise(F.lit("half"))
    return (B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.clean_share(text).alias("s"))
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("s.value").alias("share"), "s.bad"))


@query("clean_bool", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS flag, event_id % 5 = 4 AS bad FROM events""")
def clean_bool(spark, sf):
    text = F.try_element_at(F.array(F.lit(" True"), F.lit("1"), F.lit("FALSE "), F.lit("0"), F.lit("yes")),
                            (F.col("event_id") % 5 + 1).cast("int"))
    return B.table(spark, sf, "events").select("event_id", S.clean_bool(text).alias("b")).select(
        "event_id", F.col("b.value").alias("flag"), "b.bad")


@query("previous_season", """SELECT o_orderkey, printf('%d-%02d', year(o_orderdate) - 1, year(o_orderdate) % 100) || '|' ||
  printf('%d-%02d', year(o_orderdate) - 2, (year(o_orderdate) - 1) % 100) AS before FROM orders""")
def previous_season(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", F.array_join(
        S.previous_seasons(S.season_label(F.year("o_orderdate")), 2), "|").alias("before"))


@query("age_on", f"SELECT player_id, round((DATE '{B.TODAY}' - birth_date) / 365.25::DOUBLE, 6) AS age FROM v_player")
def age_on(spark, sf):
    return B.dim_player(spark, sf).select("player_id", r6(S.age_on("birth_date", F.lit(B.TODAY).cast("date"))).alias("age"))


@query("age_bucket", f"""SELECT player_id, CASE WHEN a IS NULL THEN NULL WHEN a <= 21 THEN 0 WHEN a <= 24 THEN 1 WHEN a <= 27 THEN 2 WHEN a <= 30 THEN 3 ELSE 4 END AS bucket
  FROM (SELECT player_id, (DATE '{B.TODAY}' - birth_date) / 365.25::DOUBLE AS a FROM v_player)""")
def age_bucket(spark, sf):
    age = S.age_on("birth_date", F.lit(B.TODAY).cast("date"))
    return B.dim_player(spark, sf).select("player_id", S.age_bucket(age, (21, 24, 27, 30)).alias("bucket"))


@query("iso_utc", """SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS stamp FROM events""")
def iso_utc(spark, sf):
    return B.table(spark, sf, "events").select("event_id", S.iso_utc(F.when(F.col("event_id") % 9 != 0, F.col("ts"))).alias("stamp"))


@query("alias_json", """SELECT n_nationkey, '["' || lower(n_name) || '","FC ' || n_name || '"]' AS aliases, 2 AS n FROM nation""")
def alias_json(spark, sf):
    name = F.col("n_name")
    raw = F.array(F.lower(name), name, F.concat(F.lit("FC "), name), F.lower(name))
    return B.table(spark, sf, "nation").select("n_nationkey", S.alias_json(raw, name).alias("aliases")).withColumn(
        "n", F.size(S.parse_alias_json("aliases")))


# -- validation -------------------------------------------------------------------------

RULES = {
    "lines": Q.Rules(not_null=("xa", "source"), non_negative=("xg", "margin"), in_range={"minutes": (0.0, 45.0)},
                     unique=("player_id", "match_id", "shots")),
    "values": Q.Rules(not_null=("player_id",), non_negative=("value_eur",), requires={"value_eur": "tm_last_updated"}),
}


def staged(spark, sf):
    lines_ = B.fact(spark, sf).withColumn("margin", F.col("goals") - F.col("assists"))
    return {"lines": lines_, "values": B.market_values(spark, sf)}


def failed_sql(table: str, column: str, check: str, value: str, rows: str) -> str:
    """Failures and examples (smallest, largest, one by hash) of the failing ``rows``."""
    v, pick = f"CAST({value} AS VARCHAR)", f"arg_min(CAST({value} AS VARCHAR), md5(CAST({value} AS VARCHAR)))"
    return f"""SELECT '{table}' AS "table", '{column}' AS "column", '{check}' AS "check", CAST(sum(n) AS BIGINT) AS failures,
      concat_ws('|', min({v}), CASE WHEN max({v}) <> min({v}) THEN max({v}) END, CASE WHEN {pick} <> min({v}) AND {pick} <> max({v}) THEN {pick} END) AS examples FROM ({rows})"""


_VALID = "SELECT * FROM (" + " UNION ALL ".join([
    failed_sql("lines", "xa", "not_null", "'null'", "SELECT 1 AS n FROM v_fact WHERE xa IS NULL"),
    failed_sql("lines", "margin", "non_negative", "m", "SELECT 1 AS n, goals - assists AS m FROM v_fact WHERE goals - assists < 0"),
    failed_sql("lines", "minutes", "in_range(0,45)", "mins", "SELECT 1 AS n, mins FROM v_fact WHERE mins > 45"),
    failed_sql("values", "value_eur", "requires(tm_last_updated)", "value_eur", "SELECT 1 AS n, value_eur FROM v_value WHERE value_eur IS NOT NULL AND tm_last_updated IS NULL"),
    failed_sql("lines", "player_id/match_id/shots", "unique", "player_id || '/' || match_id || '/' || shots",
            "SELECT player_id, match_id, shots, count(*) AS n FROM v_fact GROUP BY 1, 2, 3 HAVING count(*) > 1"),
]) + ") WHERE failures > 0"


@query("validate_tables", _VALID)
def validate_tables(spark, sf):
    return Q.validate_tables(staged(spark, sf), RULES).withColumn("examples", F.array_join("examples", "|"))


@query("enforce", f"SELECT count(*) AS issues, count(*) = 0 AS valid FROM ({_VALID})")
def enforce(spark, sf):
    issues = Q.validate_tables(staged(spark, sf), RULES)
    valid = Q.enforce(issues, allow_invalid=True)
    return issues.agg(F.count(F.lit(1)).alias("issues")).withColumn("valid", F.lit(valid))


@query("share_sum_check", """SELECT match_id, round(total, 6) AS total FROM (SELECT t.match_id, sum(possession) AS total, count(possession) AS k FROM v_team_fact t JOIN v_match m ON m.match_id = t.match_id
  AND t.team_id IN (m.home_team_id, m.away_team_id) WHERE t.source = 'espn' GROUP BY 1) WHERE k = 2 AND abs(total - 1) > 0.02""")
def share_sum_check(spark, sf):
    match = B.dim_match(spark, sf).select("match_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    shares = B.fact_team(spark, sf).filter(F.col("source") == "espn").join(match, ["match_id", "team_id"], "left_semi")
    return rounded(Q.share_sum_check(shares, key="match_id", share="possession"), "total")


@query("skip_counts", """SELECT 'fact_player_match:' || source AS label, count(*) AS skipped FROM v_fact
  WHERE match_id NOT IN (SELECT match_id FROM v_match) OR player_id NOT IN (SELECT player_id FROM v_player WHERE tm_id IS NOT NULL) GROUP BY 1""")
def skip_counts(spark, sf):
    keys = {"match_id": B.dim_match(spark, sf).select("match_id"),
            "player_id": B.dim_player(spark, sf).filter("tm_id is not null").select("player_id")}
    flagged = Q.resolve_keys(B.fact(spark, sf), keys).filter(~F.col("resolved"))
    return flagged.groupBy(F.concat(F.lit("fact_player_match:"), "source").alias("label")).agg(F.count(F.lit(1)).alias("skipped"))
