from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from touchline.llm import quality_rules as qr
from touchline.llm.queries import op7_quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    hit = {j for i, t in enumerate(tri) if n[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_equal_brute_force(spark, docs_of):
    rng = random.Random(8)
    words = ["the", "of", "a", "b", "é", "😀", "#x", "|", "...", "AB", " ", "\x1c"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\r"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " \n \n"), (903, "same line\nsame line\nother"), (904, "a b a b a b"), (905, "word " * 30_000)]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in qr.statistics(docs_of(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_repeated_rows_null_ids_empty_table(spark, docs_of):
    df = docs_of([(1, "a b"), (1, "a b"), (None, "c")])
    assert sorted((r.doc_id or 0, r.n_words) for r in qr.statistics(df).collect()) == [(0, 1), (1, 2), (1, 2)]
    assert qr.judged(df.limit(0)).count() == 0


def test_rules_name_what_fails(spark, docs_of):
    good = "The people of the town said that it was not the first time they had seen the lights over the river and that none of them was afraid. "
    text = good + good.replace("river", "hill").replace("town", "port").replace("lights", "boats")
    rows = [(1, text), (2, "#### " * 60), (3, text.upper() + "!! " * 60), (4, "- bullet line of the list\n" * 5), (5, "x" * 40 + " ")]
    failed = {r.doc_id: set(filter(None, r.failed.split(","))) for r in qr.judged(docs_of(rows)).collect()}
    assert failed[1] == set()
    assert {"symbol_ratio", "letter_words", "stop_words"} <= failed[2]
    assert {"upper_ratio", "exclamation_ratio"} <= failed[3]
    assert {"words", "duplicate_lines", "bullet_lines"} <= failed[4]


def test_no_python_in_the_plan(spark):
    plan = op7_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_clean_prose_of_all_languages_is_kept(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("quality = 1")
    n = op7_quality_rules(spark, sf).filter("NOT base_failed").join(docs, "doc_id").groupBy("lang").agg(F.avg(F.col("kept").cast("int")).alias("r")).collect()
    assert len(n) == 4 and all(r.r > 0.95 for r in n)
