from __future__ import annotations

import hashlib
import math

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from test_near_dup import brute as components
from touchline.llm import mixing, secret_scan, toxicity
from touchline.llm.texts import map_rows
from touchline.operators.common import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Real rows, with copies, secrets, nulls and repeated rows added."""
    at = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 3000")
    text = " ".join(f"w{i}" for i in range(120))
    extra = spark.createDataFrame(
        [(9001, text, "en", "src1", 1), (9002, text + " end", "en", "src2", 1), (9003, "user = anna pwd: hunter2! fine", "en", None, 1),
         (9004, None, None, None, None), (9005, "", "en", "src1", 0), (9006, "twice the row", "en", "src1", 1), (9006, "twice the row", "en", "src1", 1)],
        docs.schema)
    docs.unionByName(extra).write.parquet(str(at / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(at / "labels.parquet"))
    return str(at)


def redact(text, spans):
    out, last = "", 0
    for a, b in sorted(spans):
        if a >= last:
            out += text[last:a] + "[SECRET]"
        last = max(last, b)
    return out + text[last:]


def test_run_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    rows = [(k, t) for k, t in rows if model.score(scorer.margins([t])[0]) < 0.5]
    comp = components(rows)
    rows = [(k, t) for k, t in rows if comp[k] == k]
    spans = {}
    _, found = secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in found.collect():
        spans.setdefault(r.doc_id, set()).add((r.start, r.end))
    rows = [(k, t if t is None else redact(t, spans.get(k, ()))) for k, t in rows]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((k, sp.encode(t) if t is not None else None) for k, t in rows)
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want
    assert {k for k, _ in got} >= {9001, 9003, 9004, 9005, 9006} and 9002 not in {k for k, _ in got}


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = stage(step(spark, docs, folder), f"test-{name}")
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert out.count() <= docs.count()
        docs = out
    assert docs.filter(F.col("text").contains("hunter2")).count() == 0


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {x.split("_")[0] for x in names if x.startswith("op")} >= {f"op{n}" for n in range(1, 11)}


@pytest.mark.parametrize("key", ["op1_minhash_near_dedup", "op5_source_mixing", "op6_exact_topk", "op7_quality_rules"])
def test_oracles(spark, key):
    import duckdb

    from tools_check import TABLES, canonical

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[key](spark, SF)
    rel = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), names)


def mix_order(rows, block=mixing.BLOCK):
    """Ids of (doc_id, source) rows in the order of the schedule, by hand."""
    queues = {}
    for k, s in rows:
        queues.setdefault("-" if s is None else "+" + s, []).append(k)
    keys = sorted(queues)
    most = max(map(len, queues.values()))
    q = [max(1, math.floor(math.sqrt(len(queues[k]) / most) * mixing.RESOLUTION + 0.5)) for k in keys]
    for k in keys:
        queues[k].sort(key=lambda x: (hashlib.md5(str(x).encode()).hexdigest(), x))
    total, done, out, t = sum(q), [0] * len(q), [], 0
    while len(out) < len(rows):
        i = min((-(-(done[i] + 1) * total // q[i]), i) for i in range(len(q)) if done[i] * total // q[i] <= t)[1]
        out += queues[keys[i]][done[i] * block: (done[i] + 1) * block]
        done[i] += 1
        t += 1
    return out


def test_result_is_in_the_order_of_the_mix(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    rows = got.select("doc_id", "position", "_metadata.file_name", "_metadata.row_index").collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").collect()}
    want = mix_order([(r.doc_id, source[r.doc_id]) for r in rows])
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.position)] == want
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.file_name, r.row_index))] == want


def test_workers_give_freed_memory_back(spark):
    """A worker that goes on to the next stage does not hold what its last task has freed."""
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    def fill(it):
        import os
        import sys

        if list(it):
            before, n = resident(), 4000
            held = [b"x" * n for _ in range(50_000)]
            sys.pinned_by_test = b"x" * n  # stays, so the allocator keeps what is freed below it
            grown = resident() - before
            del held
            yield os.getpid(), before, grown

    def look(it):
        import os

        if list(it):
            yield os.getpid(), resident()

    one = spark.range(1).coalesce(1)
    pid, before, grown = map_rows(one, fill, "pid long, before long, grown long").collect()[0]
    assert grown > 150
    for _ in range(30):
        seen = dict(map(tuple, map_rows(one, look, "pid long, now long").collect()))
        if pid in seen:
            assert seen[pid] - before < 80
            return
    pytest.fail("the worker did not come again")
