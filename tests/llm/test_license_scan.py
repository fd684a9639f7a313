from __future__ import annotations

import random
import re

from touchline.llm import license_scan as ls
from touchline.llm.queries import op9_license_scan


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for p, label in ls.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_equals_brute_force(spark, docs_of):
    rng = random.Random(6)
    bits = ["GNU", "general", "Public", "license", "Apache", "cc", "BY", "mit", "MIT-License", "é", "xcc", "by2", " ", "漢", "_", "", "\x7f"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice([" ", ", ", "\n", "-", ""]) for _ in range(30))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "--"), (903, "mit license " * 20_000)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in ls.license_spans(docs_of(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_real_rows_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_license_scan(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_notices_with_edits_are_found():
    rng = random.Random(1)
    finder = ls.NoticeFinder()
    for notice, label in ls.NOTICES.items():
        edits = len(notice) // ls.LETTERS_PER_EDIT
        for n in range(edits + 1):
            # Edits inside words, so that the ends stay in place.
            s = list(notice)
            for at in rng.sample([i for i, c in enumerate(s) if c != " "], n):
                s[at] = "q"
            found = finder.find("before it " + "".join(s) + " after it")
            assert any(x[2] == label for x in found), (notice, n)
    assert finder.find("the people of the town saw the river and all of the lights were out") == []


def test_spans_name_words(spark, docs_of):
    rows = [(1, "Intro words. Redistribution and uze in source and binary form, with"), (2, "Released under the M.I.T. licence"), (None, "MIT License"),
            (3, "x"), (3, "x")]
    got = {r.doc_id: r for r in ls.license_spans(docs_of(rows)).collect()}
    assert got[1].labels == "bsd" and got[1].spans[0].word == 2 and got[1].spans[0].edits == 2 and 0.9 < got[1].score < 1
    assert got[None].labels == "mit" and got[None].score == 1.0 and got[3].score == 0.0
    assert ls.license_spans(docs_of(rows).limit(0)).count() == 0


def test_adjacent_notices_are_all_found():
    """The first has more edits than the second, which used to hide it."""
    find = ls.NoticeFinder().find
    text = "x relesed undr the mit license a b released under the mit license z"
    assert [text[a:b] for a, b, *_ in find(text)] == ["relesed undr the mit license", "released under the mit license"]
    text = "all right reserved all rights reserved"
    assert [(text[a:b], e) for a, b, _, e, _ in find(text)] == [("all right reserved", 1), ("all rights reserved", 0)]
    text = "all rights reserved " * 300
    assert [(a, e) for a, _, _, e, _ in find(text.strip())] == [(20 * k, 0) for k in range(300)]


def spans_by_definition(text, notice):
    """Every stretch of whole words within the edits of a notice; best first, then what does not overlap."""
    edits = len(notice) // ls.LETTERS_PER_EDIT
    words, at, places = text.split(" "), 0, []
    for w in words:
        places.append((at, at + len(w)))
        at += len(w) + 1
    found = []
    for i, (a, _) in enumerate(places):
        for _, b in places[i:]:
            if b - a > len(notice) + edits:
                break
            if b - a >= len(notice) - edits and (d := distance(text[a:b], notice)) <= edits:
                found.append((d, a, b))
    out = []
    for d, a, b in sorted(found):
        if all(b <= x or y <= a for x, y, _ in out):
            out.append((a, b, d))
    return sorted(out)


def test_notices_spans_and_edits_equal_brute_force():
    rng = random.Random(21)
    notices = {k: v for k, v in ls.NOTICES.items() if v in ("all-rights-reserved", "mit", "cc-by-sa", "lgpl")}
    finder = ls.NoticeFinder(notices)
    shown = 0
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            s = list(rng.choice(list(notices)))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                i = rng.randrange(len(s))
                s[i] = rng.choice(["", "x", s[i] + "y", " "])
            parts += ["".join(s), *[rng.choice(["a", "all", "the", "mit", "rights"]) for _ in range(rng.randint(0, 2))]]
        text = " ".join(" ".join(parts).split())
        got = finder.find(text)
        for notice, label in notices.items():
            best = spans_by_definition(text, notice)
            mine = [(a, b, e) for a, b, x, e, _ in got if x == label] if list(notices.values()).count(label) == 1 else None
            if mine is not None:
                assert len(mine) == len(best) and [e for *_, e in mine] == [e for *_, e in best], (text, notice)
                assert all(a == x and distance(text[a:b], notice) == e for (a, b, e), (x, _, _) in zip(mine, best))
                shown += len(mine)
    assert shown > 100


def test_words_are_never_cut():
    find = ls.NoticeFinder().find
    assert find("all rights reservedly granted") == [] == find("all rights reservedxyz") == find("xyall rights reserved")
    text = "install rights reserved all rights reservedx end"
    assert [(text[a:b], e) for a, b, _, e, _ in find(text)] == [("all rights reservedx", 1)]


def test_time_is_in_proportion_to_the_text():
    import time

    find = ls.NoticeFinder().find
    one = "relesed undr the mit license "
    times = []
    for n in (500, 4000):
        start = time.perf_counter()
        assert len(find((one * n).strip())) == n
        times.append(time.perf_counter() - start)
    assert times[1] < 30 * times[0] and times[1] < 20
    find("all rights reserved" * 20_000)
    find("all right" * 40_000)
