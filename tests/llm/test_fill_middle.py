from __future__ import annotations

import random
from hashlib import sha256

from touchline.llm import fill_middle
from touchline.llm.fill_middle import FimParams


def brute(doc_id, text):
    text = text or ""
    n = len(text)
    sha = lambda s: sha256(s.encode()).hexdigest()
    h = [int(sha(f"1:{doc_id}")[i: i + 8], 16) for i in (0, 8, 16, 24)]
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), sha(out), sha(text)


def rows_of(seed=3):
    rng = random.Random(seed)
    letters = "ab <>PSM/é漢😀\n"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 40, 700])))) for i in range(300)]
    return rows + [(1000, ""), (1001, None), (1002, "x<P>y"), (1003, "<S"), (1004, "<M>"), (None, "no id"), (None, None), (5, rows[5][1]),
                   (5, rows[5][1]), (5, "another text of the same id"), (7, None), (7, "")]


def key(row):
    return tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in row)


def test_equals_brute_force(spark, docs_of):
    rows = rows_of()
    for piece in (4096, 7, 1):
        got = [tuple(r) for r in fill_middle.fill_in_middle(docs_of(rows), FimParams(piece=piece)).collect()]
        assert sorted(got, key=key) == sorted([brute(*r) for r in rows], key=key)


def test_all_forms_occur_and_long_text_is_whole(spark, docs_of):
    rows = [(i, f"{i} " * 40) for i in range(60)] + [(100, "w😀 " * 400_000)]
    got = {r.doc_id: tuple(r) for r in fill_middle.fill_in_middle(docs_of(rows)).collect()}
    assert {r[2] for r in got.values()} == {"plain", "psm", "spm"}
    assert all(got[i] == brute(i, t) for i, t in rows)


def test_outputs_are_the_chunks_in_order(spark, docs_of):
    rows = [(i, f"text {i} " * 30) for i in range(40)]
    chunks = {}
    for r in sorted(fill_middle.transformed(docs_of(rows), FimParams(piece=11)).collect(), key=lambda r: (r.doc_id, r.place)):
        chunks[r.doc_id] = chunks.get(r.doc_id, "") + r.chunk
    assert all(sha256(chunks[i].encode()).hexdigest() == brute(i, t)[5] for i, t in rows)


def test_marks_across_chunks():
    form, out = "psm", "<P>a<<S><M<M>>m<"
    want = {0: "a<", 2: "<M", 1: ">m<"}
    for size in range(1, 17):
        found = {}
        for part, at, text in fill_middle._parts(form, iter([out[i: i + size] for i in range(0, len(out), size)])):
            assert at == len(found.get(part, ""))
            found[part] = found.get(part, "") + text
        assert found == want


def test_empty_table(spark, docs_of):
    assert fill_middle.fill_in_middle(docs_of([(1, "a")]).limit(0)).count() == 0
