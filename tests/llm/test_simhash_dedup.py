from __future__ import annotations

import random

import numpy as np
import xxhash

from touchline.llm import simhash_dedup
from touchline.llm.simhash_dedup import SimHashParams


def brute_fp(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [b" ".join(w)]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=4):
    """Component of every id; ids with several texts link them."""
    fps = {}
    for key, text in rows:
        if key is not None:
            fps.setdefault(key, set()).add(brute_fp(text))
    comp = {k: k for k in fps}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if any((x ^ y).bit_count() <= distance for x in fps[a] for y in fps[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {k: root(k) for k in keys}


def corpus(seed=11):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "漢字"]
    rows, key = [], 20
    for size in (1, 1, 1, 4, 30, 80):
        base = [rng.choice(vocab) for _ in range(rng.randint(80, 400))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab).upper()
            rows.append((key, " ".join(w)))
            key += rng.randint(1, 3)
    rows += [(key, rows[0][1]), (key + 1, "One two"), (key + 2, "ONE\ttwo"), (key + 3, ""), (key + 4, None), (key + 5, " \n")]
    rng.shuffle(rows)
    return rows


def check(got, rows):
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    fps = sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64)) for r in got)
    assert fps == sorted((k is None, k or 0, brute_fp(t)) for k, t in rows)


def test_components_equal_brute_force(spark, docs_of):
    rows = corpus()
    for p in (SimHashParams(), SimHashParams(tile=16), SimHashParams(segment_bits=4, groups=6)):
        got = simhash_dedup.near_fingerprints(docs_of(rows), p).collect()
        check(got, rows)
    assert len({r.component_id for r in got}) < len(rows) - 20


def test_null_ids_repeated_rows_and_empty_table(spark, docs_of):
    a, b = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    rows = [(None, a), (None, None), (4, a), (4, a), (9, b), (9, a), (12, b), (2, "x y z"), (30, None), (31, "")]
    check(simhash_dedup.near_fingerprints(docs_of(rows)).collect(), rows)
    assert simhash_dedup.near_fingerprints(docs_of(rows).limit(0)).count() == 0


def test_deduplicated_keeps_columns_and_one_of_each_group(spark, docs_of):
    df = docs_of(corpus())
    kept = simhash_dedup.deduplicated(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, c in brute(corpus()).items() if k == c}


def test_counts_bound_the_distance_and_cells_meet():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    for width in (1, 2, 4, 8):
        x, y = (simhash_dedup.bit_counts(v, width).astype(int) for v in (a, b))
        manhattan = np.abs(x - y).sum(axis=1)
        steps = [simhash_dedup.ladder(v.astype(np.uint8), width) for v in (x, y)]
        assert (np.bitwise_count(steps[0] ^ steps[1]) == manhattan).all()
        assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.repeat(base, 60)
    for _ in range(3):
        fps ^= np.where(rng.random(len(fps)) < 0.8, np.uint64(1) << rng.integers(0, 24, len(fps), dtype=np.uint64), np.uint64(0))
    fps = np.unique(fps)
    counts = simhash_dedup.ladder(simhash_dedup.bit_counts(fps, 2), 2)
    found = simhash_dedup.forest(fps, counts, 4)
    pairs = {(int(a), int(b)) for x, y in found for a, b in zip(x, y)}
    assert len(pairs) < len(fps) and all((a ^ b).bit_count() <= 4 for a, b in pairs)
    comp = {int(f): int(f) for f in fps}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a, b in pairs:
        comp[root(a)] = root(b)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if int(np.bitwise_count(a ^ b)) <= 4:
                assert root(int(a)) == root(int(b))


def test_long_text_is_read_to_its_end():
    words = [f"w{i % 977}" for i in range(60_000)]
    assert simhash_dedup.fingerprint(" ".join(words), 4) == brute_fp(" ".join(words))
    for n in (16_384, 16_385, 16_386, 16_387, 16_388):
        assert simhash_dedup.fingerprint(" ".join(words[:n]), 4) == brute_fp(" ".join(words[:n]))
