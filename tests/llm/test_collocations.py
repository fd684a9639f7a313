from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from touchline.llm import collocations
from touchline.llm.collocations import PhraseParams

SCHEMA = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, p):
    counts = {}
    for lang, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            for k in range(1, p.max_words + 1):
                counts.setdefault(lang or "und", Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cands = {g: c for g, c in f.items() if len(g) > 1 and c >= p.min_count}
        inside = {g[i:j] for g, c in cands.items() for i in range(len(g)) for j in range(i + 1, len(g) + 1)
                  if j - i < len(g) and f[g[i:j]] == c}
        found = []
        for g, a in cands.items():
            score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            if g not in inside:
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:p.top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def corpus(seed=4, size=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "漢字", "Q", "a\x1cb"]
    fixed = ["new york city", "as far as I know", "one two three four five six seven", "ha ha ha ha", "état de siège"]
    rows = []
    for i in range(size):
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choice(fixed) if rng.random() < 0.2 else vocab[min(int(rng.expovariate(0.09)), len(vocab) - 1)])
            out.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!"]))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(out).upper() if i % 7 == 0 else "".join(out)))
    return rows + [("en", None), ("xx", ""), ("en", " .,\n"), (None, "one")]


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, lang, text, "x", "x", "x") for i, (lang, text) in enumerate(rows)],
                                     "doc_id long, lang string, text string, word string, id string, f string")
    return make


@pytest.mark.parametrize("p", [PhraseParams(min_count=4, top=25), PhraseParams(min_count=3, top=2000, shares=(1.0,)),
                               PhraseParams(min_count=5, top=5, shares=(0.1, 0.2, 0.4, 1.0))])
def test_equals_brute_force(spark, frame, p):
    rows = corpus()
    df = collocations.collocations(frame(rows), p)
    assert df.columns == SCHEMA
    got = sorted(tuple(r) for r in df.collect())
    assert got == brute(rows, p) and len(got) >= p.top if p.top < 100 else got == brute(rows, p)


def test_settled_languages_stop_growing(spark, frame, monkeypatch):
    """The rarest words give the whole list, so the commonest words are never expanded."""
    rows = [("en", f"rare{i} pair{i}. the x{j}. ") for i in range(12) for j in range(5)] + [("en", "the of. the of. of the. ") for _ in range(80)]
    seen = []
    whole = collocations.grown

    def watched(frontier, corpus, p):
        seen.extend(r.word for r in frontier.collect())
        return whole(frontier, corpus, p)

    monkeypatch.setattr(collocations, "grown", watched)
    p = PhraseParams(min_count=3, top=10, shares=(0.2, 1.0))
    got = sorted(tuple(r) for r in collocations.collocations(frame(rows), p).collect())
    assert got == brute(rows, p)
    assert "rare3" in seen and "the" not in seen


def test_empty_tables_and_no_candidate(spark, frame):
    assert collocations.collocations(frame(corpus()).limit(0)).count() == 0
    df = collocations.collocations(frame([("en", "a b c"), (None, None)]))
    assert df.columns == SCHEMA and df.count() == 0


def test_ids_equal_those_of_spark(spark):
    df = spark.createDataFrame([("en", "Wort"), ("", "漢字"), ("de", "x" * 90)], "lang string, word string")
    numbered, attempt = collocations.with_ids(df.selectExpr("*", "200L AS f"), PhraseParams())
    for r in numbered.collect():
        assert r.id % (1 << 64) == collocations.xxhash.xxh64_intdigest(r.word.encode(), collocations._seed(r.lang, attempt))


def test_blocks_of_a_long_text_join_seamlessly():
    text = "alpha beta. " * 5000 + "x" * 3000 + "\t,end"
    whole = [w for part in collocations.tokens(text) for w in part]
    assert [w for part in collocations.tokens(text, 97) for w in part] == whole
    assert whole[:3] == [b"alpha", b"beta", b"\n"] and whole[-3:] == [b"x" * 3000, b"\n", b"end"]
