from __future__ import annotations

import random

import numpy as np
import pytest

from touchline.llm import near_dup


def brute(rows, percent=85):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
        sets.setdefault(key, []).append(s)
    keys = [k for k in sets if k is not None]
    comp = {k: k for k in keys}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {k: root(k) for k in keys}


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, key = [], 10
    for size in (1, 1, 3, 8, 25):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 220))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab).upper()
            rows.append((key, " ".join(w)))
            key += rng.randint(1, 3)
    # A long family: each differs a little from the one before, so ends are linked through the middle.
    w = [rng.choice(vocab) for _ in range(150)]
    for _ in range(14):
        w = list(w)
        w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((key, "\n".join(w)))
        key += 1
    rows += [(key, rows[0][1]), (key + 1, "One two"), (key + 2, "ONE\ttwo"), (key + 3, "One two three"), (key + 4, ""), (key + 5, None),
             (key + 6, " \t\n"), (key + 7, "")]
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark, docs_of):
    rows = corpus()
    got = near_dup.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    n = {r.doc_id: r.n_shingles for r in got}
    assert all(n[k] == 0 for k, t in rows if not (t or "").split())


def test_null_ids_repeated_rows_and_empty_table(spark, docs_of):
    text = " ".join(f"a{i}" for i in range(80))
    rows = [(None, text), (4, text), (4, text), (9, text + " tail"), (9, "other words here"), (2, "x y z")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_dup.near_duplicates(docs_of(rows)).collect())
    assert got == [(False, 2, 2, True), (False, 4, 4, True), (False, 4, 4, True), (False, 9, 4, False), (False, 9, 4, False),
                   (True, 0, None, True)]
    assert near_dup.near_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0


def test_deduplicated_keeps_columns_and_clean_rows(spark, docs_of):
    df = docs_of(corpus())
    kept = near_dup.deduplicated(df)
    assert kept.columns == df.columns
    want = {k for k, c in brute(corpus()).items() if k == c}
    assert {r.doc_id for r in kept.collect()} == want


def test_long_text_is_read_to_its_end():
    hashes, weights, factors = near_dup._tools(near_dup.MinHashParams())
    words = [f"w{i}" for i in range(300_000)]
    a = near_dup.shingle_set(" ".join(words), hashes, 5, weights)
    b = near_dup.shingle_set(" ".join([*words[:-1], "end"]), hashes, 5, weights)
    assert len(a) == len(words) - 4 and len(np.intersect1d(a, b)) == len(a) - 1


def test_exact_round_leaves_out_only_hopeless_pairs(spark, docs_of):
    """Strays around one text: most are too far from all, a few pairs among them are near."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows, key = [(1, " ".join(base))], 2
    for n in range(40):
        w = list(base)
        for at in rng.sample(range(200), 3 + n % 6):
            w[at] = f"edit{key}"
        rows.append((key, " ".join(w)))
        if n % 5 == 0:
            w[0] = f"more{key}"
            rows.append((key + 500, " ".join(w)))
        key += 1
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_a_worker_turns_few_rows_into_objects_at_a_time(monkeypatch):
    class Seen(Exception):
        pass

    class Texts:
        def select(self, *columns):
            return self

    def caught(df, rows, schema, size=4096, read=None):
        raise Seen(rows, size, read)

    monkeypatch.setattr(near_dup, "map_rows", caught)
    with pytest.raises(Seen) as seen:
        near_dup.own_shingles(Texts(), near_dup.MinHashParams())
    rows, size, read = seen.value.args
    assert size <= 16_384 and read is not None and read <= 512
    texts = [(1, "a b c d e f g"), (2, "c d e f g h"), (3, "")]
    whole = list(rows(iter(texts)))
    monkeypatch.setattr(near_dup, "OUT_ROWS", 2)
    assert list(rows(iter(texts))) == whole and len(whole) == 4
    assert sorted(owner for _, owner, many in whole if not many) == [1, 1, 2]
