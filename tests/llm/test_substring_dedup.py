from __future__ import annotations

import random

from pyspark.sql import functions as F

from touchline.llm import substring_dedup as sd
from touchline.llm.queries import op3_substring_dedup

rng = random.Random(2)


def sentence(n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)).capitalize() + "."


def test_passages_go_and_offsets_are_right(spark, docs_of):
    passage = " ".join(sentence(12) for _ in range(6))
    short = "Licensed under some terms of use."
    rows = [(n, f"{sentence(15)} {passage if n % 3 == 0 else sentence(20)} {sentence(9)}\n{short}") for n in range(1, 40)]
    got = {r.doc_id: r for r in sd.repeated_spans(docs_of(rows)).collect()}
    texts = dict(rows)
    holders = [n for n, t in rows if passage in t]
    assert set(got) == set(holders[1:])
    for n, r in got.items():
        assert len(r.removed) == 1 and r.removed[0].kept_doc_id == holders[0]
        start, end = r.removed[0].start, r.removed[0].end
        assert texts[n][start:end] == passage
        assert r.text == texts[n][:start] + texts[n][end:] and short in r.text


def test_lines_and_paragraphs(spark, docs_of):
    line = sentence(30)
    rows = [(1, f"{line}\nalpha"), (2, f"beta\n  {line.upper()} \ngamma"), (3, f"{line}\n{line}")]
    got = {r.doc_id: r.text for r in sd.repeated_spans(docs_of(rows), sd.RepeatParams("line")).collect()}
    assert got == {2: "beta\n\ngamma", 3: ""}
    para = f"{sentence(20)}\n{sentence(20)}"
    rows = [(1, f"{para}\n\nx"), (2, f"y\n\n{para}")]
    got = {r.doc_id: r.text for r in sd.repeated_spans(docs_of(rows), sd.RepeatParams("paragraph")).collect()}
    assert got == {2: "y\n\n"}


def brute(rows, p):
    first, out = {}, {}
    seen = []
    for key, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        units = list(sd.units(text, sd._CUTS[p.unit]))
        seen.append((key, text, units))
        for at, (_, _, w) in enumerate(units):
            if len(w) >= p.min_unit_words:
                first.setdefault(" ".join(w), (key, at))
    for key, text, units in seen:
        dup = [len(w) >= p.min_unit_words and first[" ".join(w)] != (key, at) for at, (_, _, w) in enumerate(units)]
        gone, at = 0, 0
        while at < len(units):
            if not dup[at]:
                at += 1
                continue
            last = end = at
            while end < len(units) and (dup[end] or len(units[end][2]) < p.min_unit_words):
                last = end if dup[end] else last
                end += 1
            n = sum(len(units[k][2]) for k in range(at, last + 1))
            gone += n if n >= p.min_run_words else 0
            at = end
        if gone:
            out[key] = gone
    return out


def test_runs_equal_brute_force(spark, docs_of):
    pool = [sentence(n) for n in (3, 3, 5, 8, 8, 12, 15)]
    rows = [(n, " ".join(rng.choice(pool) if rng.random() < 0.6 else sentence(rng.randint(2, 9)) for _ in range(20))) for n in range(60)]
    got = {r.doc_id: sum(x.n_words for x in r.removed) for r in sd.repeated_spans(docs_of(rows)).collect()}
    assert got == brute(rows, sd.RepeatParams())


def test_table_cases(spark, docs_of):
    text = sentence(40)
    rows = [(None, text), (7, text), (7, text), (8, None), (9, ""), (10, text), (11, "x " * 50_000 + text)]
    df = docs_of(rows)
    got = {r.doc_id: r.removed[0].kept_doc_id for r in sd.repeated_spans(df).collect()}
    assert got == {10: 7}
    out = sd.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert sorted(r.text for r in out.filter("doc_id = 7 OR doc_id IS NULL").collect()) == [text] * 3
    assert sd.repeated_spans(df.limit(0)).count() == 0


def test_query_removes_every_later_occurrence(spark, docs_of, tmp_path):
    """Also a short repeat beside an edited sentence."""
    a, b, c = sentence(10), sentence(20), sentence(9)
    rows = [(1, f"{a} {b} {c}"), (2, f"{a} {b[:-1]} edited. {c}"), (3, f"{sentence(12)} {c}")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.removed_words, r.text) for r in op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {2: (19, f" {b[:-1]} edited. "), 3: (9, rows[2][1][:-len(c)])}


def test_rows_of_one_id_with_other_texts_lose_their_own_repeats(spark, docs_of):
    p = sd.RepeatParams(min_run_words=0)
    a, b, c, d = (sentence(9) for _ in range(4))
    rows = [(1, f"{a} {b}"), (2, f"{a} {b}"), (2, f"{c} {d}"), (2, f"{c} {d}"), (3, f"{d} {a}")]
    df = docs_of(rows).withColumns({"__h": F.lit("x"), "__text": F.lit("x")})
    out = sd.without_repeats(df, p)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(
        [(1, f"{a} {b}"), (2, ""), (2, f"{c} {d}"), (2, f"{c} {d}"), (3, "")])
    assert sorted((r.doc_id, r.text) for r in sd.repeated_spans(df, p).collect()) == [(2, ""), (3, "")]


def rows_left(rows, p):
    """Text of every row without later units, by definition; ids are distinct."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        left, last, run = [], 0, []

        def close():
            nonlocal last
            while run and not run[-1][2]:
                run.pop()
            if run:
                left.append(text[last:run[0][0]])
                last = run[-1][1]
            run.clear()

        for start, end, words in sd.units(text, sd._CUTS[p.unit]):
            name = " ".join(words)
            if len(words) < p.min_unit_words:
                if run:
                    run.append((start, end, False))
            elif name in seen:
                run.append((start, end, True))
            else:
                close()
                seen.add(name)
        close()
        out[key] = "".join(left) + text[last:]
    return out


def test_whole_rows_equal_brute_force_at_the_settings_of_the_query(spark, docs_of):
    gen = random.Random(7)
    pool = [sentence(n) for n in (2, 3, 4, 6, 10)] + ["\n", "\n\n", "  "]
    rows = [(n, " ".join(gen.choice(pool) if gen.random() < 0.5 else sentence(gen.randint(2, 9)) for _ in range(25))) for n in range(80)]
    for unit in ("sentence", "line", "paragraph"):
        p = sd.RepeatParams(unit, min_run_words=0)
        got = {r.doc_id: r.text for r in sd.without_repeats(docs_of(rows), p).collect()}
        assert got == rows_left(rows, p)
