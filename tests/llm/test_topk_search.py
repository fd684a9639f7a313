from __future__ import annotations

import math
import random

from touchline.llm import topk_search as ts


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in ok:
        if q % every == 0 and (q not in out or v < out[q][0]):
            scored = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in ok if i != q)
            out[q] = (v, [(i, -s) for s, i in scored[:k]])
    return {q: x[1] for q, x in out.items()}


def run(spark, rows, k=5, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS c", "3 AS score", "4 AS rank")
    v = ts.quantised(df)
    got = {}
    for r in ts.top_k(v, v.filter("vec_id % 50 = 0"), k, **sizes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_equals_brute_force_over_many_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.0, round(rng.uniform(-1, 1), 2)]) for _ in range(8)]) for i in range(400)]
    assert run(spark, rows, per_block=60, per_query_block=3) == brute(rows)


def test_ties_bad_vectors_and_few_rows(spark):
    rows = [(i, [0.5, 0.25]) for i in range(120)] + [(150, [1.0]), (200, None), (250, [None, 1.0]), (300, [math.nan]), (350, [math.inf]),
                                                   (None, [1.0]), (400, []), (50, [0.5, 0.25])]
    want = brute(rows)
    got = run(spark, rows)
    assert {q: [s for _, s in x] for q, x in got.items()} == {q: [s for _, s in x] for q, x in want.items()}
    assert got[0][:4] == [(150, 32768), *want[0][1:4]] and 200 not in got
    assert run(spark, [(0, [1.0]), (1, [1.0])]) == {0: [(1, 65536)]}
    assert run(spark, [(0, [1.0])]) == {}
    assert run(spark, []) == {}
