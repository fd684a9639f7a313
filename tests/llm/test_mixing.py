from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from touchline.llm import mixing


def rows_of(counts):
    out, key = [], 0
    for s, n in counts.items():
        for _ in range(n):
            out.append((key, "t", s))
            key += 1
    return out


def test_windows_are_met_and_no_source_is_a_block_off(spark, docs_of):
    shares = {"a": 7, "b": 4, "c": 1, None: 3}
    rows = rows_of({"a": 400, "b": 90, "c": 30, None: 75})
    got = mixing.schedule(docs_of(rows), shares, block=3).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    assert sorted(r.position for r in got) == list(range(len(rows)))
    slots = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    total = sum(shares.values())
    until = 1 + max(r.slot for r in got if r.on_target)
    placed = dict.fromkeys(shares, 0)
    for t in range(until):
        placed[slots[t][0]] += 1
        assert all(abs(placed[s] - q * (t + 1) / total) < 1 for s, q in shares.items())
    ends = min((math.ceil(n / 3) // shares[s]) * total for s, n in {"a": 400, "b": 90, "c": 30, None: 75}.items())
    assert until >= ends
    by_slot = sorted(got, key=lambda r: r.position)
    assert [r.slot for r in by_slot] == sorted(r.slot for r in got)


def test_earliest_deadline_first(spark, docs_of):
    """Brute force: one period by hand."""
    counts = {"x": 64, "y": 16, "z": 4}
    got = mixing.schedule(docs_of(rows_of(counts)), {"x": 5, "y": 3, "z": 1}, block=1).collect()
    q, done, order = [5, 3, 1], [0, 0, 0], []
    for t in range(9):
        due = [(-(-(done[i] + 1) * 9 // q[i]), i) for i in range(3) if done[i] * 9 // q[i] <= t]
        i = min(due)[1]
        done[i] += 1
        order.append("xyz"[i])
    assert [s for _, s in sorted((r.slot, r.source) for r in got)][:9] == order


def test_temperature_shares_repeated_rows_null_ids(spark, docs_of):
    rows = [(None, "t", "a"), (1, "t", "a"), (1, "t", "a"), (2, None, "b"), (3, "", None)]
    got = mixing.schedule(docs_of(rows)).collect()
    assert len(got) == 5 and sorted(r.position for r in got) == list(range(5))
    assert mixing.schedule(docs_of(rows).limit(0)).count() == 0
    with pytest.raises(Exception, match="no share for source"):
        mixing.schedule(docs_of(rows), {"a": 1}).collect()


def test_layout_follows_the_schedule(spark, docs_of, tmp_path):
    df = docs_of(rows_of({"a": 300, "b": 40}))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    out.write.parquet(str(tmp_path / "m"))
    files = sorted(p for p in (tmp_path / "m").iterdir() if p.name.startswith("part"))
    read = [r.doc_id for p in files for r in spark.read.parquet(str(p)).coalesce(1).collect()]
    want = [r.doc_id for r in mixing.schedule(df).orderBy("position").collect()]
    assert read == want
    assert mixing.mixed(df.limit(0)).count() == 0


def test_columns_of_any_name_pass(spark, docs_of, tmp_path):
    df = docs_of(rows_of({"a": 60, "b": 9})).withColumns({c: F.lit("own") for c in ("__at", "__id", "__file", "__row", "__start", "position", "n_rows")})
    mixing.mixed(df).write.parquet(str(tmp_path / "m"))
    out = mixing.laid_out(spark.read.parquet(str(tmp_path / "m")))
    assert sorted(out.columns) == sorted(df.columns)
    got = [(r.doc_id, r.position, r["__at"], r["n_rows"]) for r in out.orderBy("position").collect()]
    assert got == [(r.doc_id, r.position, "own", "own") for r in mixing.schedule(df).orderBy("position").collect()]
