"""Queries of this package over the given tables, and their oracle SQL where SQL expresses them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import collocations, fill_middle, license_scan, mixing, near_dup, pieces, quality_rules, secret_scan
from touchline.llm import simhash_dedup, substring_dedup, token_counts, topk_search, toxicity
from touchline.llm.texts import sha256_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose passages: what is left, and the removed offsets."""
    found = substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"), substring_dedup.RepeatParams(min_run_words=0))
    return found.select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["n_words"]).alias("removed_words"),
        F.array_distinct(F.transform("removed", lambda r: r["kept_doc_id"])).alias("kept_doc_ids"),
        F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"])), ",").alias("spans"), "text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(_table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(_table(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base_failed.alias("base_failed"), (~base_failed & (F.col("failed") == "")).alias("kept"), "failed")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.by_document(_table(spark, sf_dir, "documents"))
    strong = F.filter("spans", lambda s: s["strong"])

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["strong"] & (s["kind"] == kind))).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                        sha256_of(joined(strong)).alias("base_sha256"), joined("spans").alias("spans"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_fingerprints(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hexed("fp").alias("fingerprint"), "component_id")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_sentencepiece_codec, op3_substring_dedup, op4_token_counts, op5_source_mixing, op6_exact_topk,
    op7_quality_rules, op8_toxicity, op9_license_scan, op10_secret_scan, op11_simhash_near_dedup, op12_phrase_collocations, op13_fill_in_middle)}

_BLANK = r"'[\x20\x09-\x0D]+'"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), {_BLANK}), lambda x: x <> '')"

ORACLES = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_BLANK}), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m.low, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY 1) m USING (doc_id)""",
    "op5_source_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY key) AS i FROM (
  SELECT key, count(*) AS n, greatest(1, round(sqrt(count(*) / max(count(*)) OVER ()) * {mixing.RESOLUTION}))::BIGINT AS q FROM d GROUP BY 1)),
cfg AS (SELECT list(q ORDER BY i) AS q, sum(q)::BIGINT AS p FROM s),
f AS (SELECT 0::BIGINT AS t, list_transform(q, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM cfg
  UNION ALL SELECT t + 1, list_transform(done, lambda x, j: x + (j = k)::BIGINT), k FROM (
    SELECT t, done, p, list_min(list_transform(q, lambda x, j: CASE WHEN (done[j] * p) // x <= t
      THEN (((done[j] + 1) * p + x - 1) // x) * 100000 + j ELSE 9000000000000000 END)) % 100000 AS k FROM f, cfg WHERE t < p)),
slots AS (SELECT t - 1 AS slot, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM f WHERE t > 0),
places AS (SELECT d.doc_id, d.source, s.i, s.q, row_number() OVER (PARTITION BY d.key ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) - 1 AS place FROM d JOIN s USING (key)),
b AS (SELECT *, place // {mixing.BLOCK} AS block FROM places),
z AS (SELECT b.doc_id, b.source, block, (block * p) // b.q AS release, ((block + 1) * p + b.q - 1) // b.q AS deadline, (block // b.q) * p + slot AS slot, place
  FROM b, cfg, slots WHERE slots.i = b.i AND slots.nth = block % b.q),
u AS (SELECT min((((s.n + {mixing.BLOCK} - 1) // {mixing.BLOCK}) // s.q) * p + slot) AS until FROM s, cfg, slots
  WHERE slots.i = s.i AND slots.nth = ((s.n + {mixing.BLOCK} - 1) // {mixing.BLOCK}) % s.q)
SELECT doc_id, source, block, release, deadline, slot, row_number() OVER (ORDER BY slot, place) - 1 AS position, slot < until AS on_target FROM z, u""",
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5""",
}

ORACLES["op12_phrase_collocations"] = r"""
WITH t AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM t),
k AS (SELECT lang, w[i:i + k - 1] AS g FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS f FROM k GROUP BY 1, 2),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY 1),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 100),
inside AS (SELECT lang, g[:-2] AS g, a FROM c WHERE len(g) > 2 UNION SELECT lang, g[2:], a FROM c WHERE len(g) > 2),
cut AS (SELECT lang, g, a, unnest(range(1, len(g))) AS j FROM c ANTI JOIN inside USING (lang, g, a)),
s AS (SELECT cut.lang, cut.g, a, n, j, x.f AS l, y.f AS r, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN n ON n.lang = cut.lang JOIN f x ON x.lang = cut.lang AND x.g = cut.g[:j] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[j + 1:]),
b AS (SELECT *, array_to_string(g, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000"""
ORACLES["op13_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS h1, ('0x' || h[9:16])::BIGINT % (n + 1) AS h2, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1, h2) AS a, greatest(h1, h2) AS b, CASE WHEN doc_id IS NULL OR n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90
  THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


def _bounds(rule: quality_rules.Rule) -> str:
    stat = rule.stat.replace(" / ", "::DOUBLE / ")
    tests = [f"({stat}) < {rule.least}::DOUBLE"] * (rule.least is not None) + [f"({stat}) > {rule.most}::DOUBLE"] * (rule.most is not None)
    return f"CASE WHEN {' OR '.join(tests)} THEN '{rule.name}' END"


ORACLES["op7_quality_rules"] = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
x AS (SELECT row_number() OVER () AS k, *, len(w)::BIGINT AS n_words, len(l)::BIGINT AS n_lines FROM a),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM x)),
h AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM h) GROUP BY 1),
y AS (SELECT doc_id, n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (n_lines - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, n_lines,
  length(array_to_string(l, '')) AS line_chars, length(array_to_string(list_distinct(l), '')) AS line_chars_once,
  len(list_filter(w, lambda x: list_contains({sorted(set(quality_rules.STOP_WORDS))!r}, lower(rtrim(x, '.,;:!?'))))) AS n_stop_words,
  coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
  length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims,
  len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipses
  FROM x LEFT JOIN r USING (k)),
v AS (SELECT *, concat_ws(',', {', '.join(map(_bounds, quality_rules.RULES))}) AS failed, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM v"""
