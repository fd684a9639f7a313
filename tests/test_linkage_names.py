"""Names of one birth date: who has a single match, whichever way the names of the date are compared."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.functions import names as NM
from touchline.operators import linkage as L


@pytest.mark.parametrize("few_pairs", [0, 50_000_000])
def test_single_matches_of_one_birthday(spark, few_pairs):
    """All names share the word "supplier"; some people are there twice, some have no name or code."""
    rng = random.Random(3)

    def name(i):
        first = rng.choice(["large ring", "red ring", "old bolt", "hot bolt", "Größe", ""])
        return rng.choice([None, "--", f"{first} Supplier#{i:05d}", f"Supplier#{i:05d} {first}", f"{first[:3]} Supplier#{i:05d}", first, f"{i * 7919 % 100003}"])

    rows = [("tm", f"r{i % 110}", name(rng.randint(0, 9) * 11111), "1990-01-01" if i % 4 else "1991-01-01") for i in range(120)]
    anchors = [(None if i == 5 else f"c{i % 70}", [name(rng.randint(0, 9) * 11111), name(i)], "1990-01-01" if i % 3 else "1991-01-01") for i in range(75)]
    r = spark.createDataFrame(rows, "source string, source_id string, name string, d string").withColumn("born", F.to_date("d")).drop("d")
    a = spark.createDataFrame(anchors, "code string, names array<string>, d string").withColumn("born", F.to_date("d")).drop("d")
    spelled = r.select("source", "source_id", "born", NM.spelled("name").alias("spelled")), a.select("code", "born", F.transform("names", NM.spelled).alias("spellings"))
    full = (spelled[0].join(spelled[1], "born").withColumn("score", NM.name_score(F.col("spellings"), F.col("spelled")))
            .filter("score >= 88 and code is not null").select("source_id", "code", "score").collect())
    assert Counter(map(tuple, L.born_together(*spelled, few_pairs=few_pairs).select("source_id", "code", "score").collect())) >= Counter(map(tuple, full))
    times = Counter(x["source_id"] for x in full)
    want = {tuple(x) for x in full if times[x["source_id"]] == 1}
    got = L.only_born_together(r, a, few_pairs=few_pairs).select("source_id", "code", "score").collect()
    assert len(got) == len(want) > 5 and {tuple(x) for x in got} == want


def test_bearers_of_one_name_are_not_paired(spark):
    """Names are matched once per date: a name of 2,000 records and 2,000 anchors is one pair, not four million."""
    ids = spark.range(2000)
    r = ids.select(F.lit("tm").alias("source"), F.col("id").cast("string").alias("source_id"), F.lit("John Smith").alias("name"), F.lit("1990-01-01").cast("date").alias("born"))
    a = ids.select("id", F.lit("1990-01-01").cast("date").alias("born"), F.array(F.lit("Smith, John"), F.lit("John Smith")).alias("names"))
    names = NM.with_spelling(r.select("born", "name").distinct(), "name", "r_").drop("name")
    theirs = NM.with_spelling(a.select("born", F.explode("names").alias("name")).distinct(), "name", "a_").drop("name")
    assert 2 <= L.names_born_together(names, theirs).count() <= 6
    assert L.only_born_together(r, a.withColumnRenamed("id", "code")).isEmpty()


def test_letters_bound_the_edits(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc 019xyz") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(x, y) for x in words for y in words], "x string, y string")
    bits = F.bit_count(NM.letters("x").bitwiseXOR(NM.letters("y")))
    assert df.filter(bits > 2 * F.levenshtein("x", "y")).isEmpty() and not df.filter(bits > 6).isEmpty()


def test_ascii_names_are_normalised_like_others(spark):
    names = ["José  Núñez", "O'Neill-Ward", "", "  ", "ÅSE  ø", "PLAIN Name 7", "Straße & Sohn", "tab\tname\n", None, "İx", "K"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    folded = F.trim(F.regexp_replace(NM.fold("n"), "[^a-z0-9]+", " "))
    assert df.filter(~NM.normalise_name("n").eqNullSafe(folded)).isEmpty()


@pytest.mark.parametrize("rows_per_slice", [1, 20_000])
def test_names_of_a_club_are_paired_once(spark, rows_per_slice):
    anchors = spark.sql("SELECT * FROM VALUES (1L, 'José Núñez'), (1L, 'Zé'), (1L, NULL), (1L, '--'), (2L, 'Zé'), (NULL, 'Nobody'), (3L, 'Alone') AS t(team_code, n)")
    records = spark.sql("SELECT * FROM VALUES (1L, 'Nunez'), (2L, 'NUNEZ'), (1L, 'Nunez'), (1L, NULL), (2L, ''), (NULL, 'Nobody'), (4L, 'Far') AS t(team_code, name)")
    found = L.name_pairs(records, anchors, rows_per_slice)
    pairs = (records.join(anchors, "team_code").select(NM.normalise_name("n").alias("a"), NM.normalise_name("name").alias("b")).distinct())
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, pairs.collect())) and found.count() == 9
    # No pair is dealt out: the last exchange has the club's names in one column.
    assert "hashpartitioning(a" not in found._jdf.queryExecution().executedPlan().toString()
