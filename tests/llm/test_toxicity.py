from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pytest

from touchline.llm import toxicity as T
from touchline.llm.queries import op8_toxicity

SF = "/root/testdata/sf0.01"


def kernel(a, b):
    """The normalised kernel by its definition."""
    def phi(s):
        out = {}
        c = ["abcdefghijklmnopqrstuvwxyz".find(x) for x in s]
        for i, j, k in combinations(range(len(s)), 3):
            key = (c[i], c[j], c[k])
            out[key] = out.get(key, 0.0) + T.DECAY ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    dot = sum(v * y.get(k, 0.0) for k, v in x.items())
    return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_features_give_the_kernel():
    words = ["banana", "bandana", "ana", "b.a.n.a", "xyzzyx", "cabana"]
    f = T.features(words).astype(float)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert f[i] @ f[j] == pytest.approx(kernel(a, b), abs=1e-5)


def test_folded_weights_give_the_margin():
    rng = np.random.default_rng(0)
    model = T.Model(rng.normal(0, 0.05, 27 ** 3), 0.1)
    words = ["banana", "ana", "mississippi", "abcabcabcabcabca"]
    want = np.maximum(T.features(words) @ model.weights + model.bias, T.FLOOR)
    assert model.margins(words) == pytest.approx(want, abs=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    return T.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_gaps_and_inserted_signs_are_tolerated(model):
    scorer = T.Scorer(model)
    plain = "onre the {} atst erin"
    for insult in ("idiot", "stupid", "moron"):
        spread = " ".join(insult)
        for s in (insult, insult.upper(), insult[:2] + "-" + insult[2:], insult[0] + "." + insult[1:], insult[:3] + "x" + insult[3:], spread):
            assert scorer.margins([plain.format(s)])[0] > 0.4, s
    assert max(scorer.margins(["The people of the town saw the river.", "Il est de la ville et des champs", ""])) < 0.3


def test_held_out_accuracy(spark):
    got = (op8_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect())
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    # A part of the labels is wrong by design: those documents hold nothing that could tell.
    assert np.mean([s >= 0.5 for s in clean]) < 0.02 and np.mean([s >= 0.5 for s in toxic]) > 0.5
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in clean] for a in toxic])
    assert auc > 0.75


def test_table_cases(spark, docs_of):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs = []
    for n in range(120):
        w = [rng.choice(words) for _ in range(30)]
        if n % 2:
            w[rng.randrange(30)], w[rng.randrange(30)] = "vermin", "vermin"
        docs.append((n, " ".join(w) + ".", "s"))
    extra = [(None, "vermin"), (900, None), (901, ""), (902, "so vile a vermin"), (902, "so vile a vermin"), (903, "a" * 50_000 + " vermin")]
    df = docs_of(docs + extra)
    labels = spark.createDataFrame([(n, n % 2) for n, _, _ in docs] + [(5000, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    got = T.toxicity(df, labels).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(docs) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(by[n][0].predicted == n % 2 for n, _, _ in docs)
    assert [r.predicted for r in by[902]] == [1, 1] and by[900][0].predicted == by[901][0].predicted == 0 and by[903][0].predicted == 1
    kept = T.without_toxic(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    assert T.toxicity(df.limit(0), labels).count() == 0
    none = T.toxicity(df, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def invented(rng, n):
    return ["".join(rng.choice("bcdfghkmpvwz") + rng.choice("aeiou") for _ in range(4)) for _ in range(n)]


def test_rare_insults_count_beside_common_ones():
    """Zipf frequencies, the top one 20 times the rarest; and more insults than any round number."""
    rng = random.Random(8)
    insults = invented(rng, 60)
    uses = [round(240 * (k + 1) ** -1.3) for k in range(10)] + [14] * 50
    assert uses[0] >= 20 * uses[9]
    toxic = [f"{prose(rng, 12)} {w} {prose(rng, 3)}" for w, n in zip(insults, uses) for _ in range(n)]
    clean = [(10_000 + n, prose(rng, 16)) for n in range(6000)]
    model = T.fit_strings(list(enumerate(toxic)), clean)
    scorer = T.Scorer(model)
    assert [w for w in insults if scorer.margins([f"onre the {w} erin"])[0] < 0.4] == []
    assert np.mean([m < 0.3 for m in scorer.margins([prose(rng, 16) for _ in range(200)])]) > 0.95


def test_a_chain_of_copies_is_one_document(spark, docs_of):
    """Each copy shares a sentence with the next alone; their wrong labels teach nothing."""
    rng = random.Random(9)
    links = [prose(rng, 14) for _ in range(31)]
    docs = [(n, f"{links[n]}. {prose(rng, 5)} harvest {prose(rng, 5)}. {links[n + 1]}.") for n in range(30)]
    docs += [(100 + n, f"{prose(rng, 20)}. {prose(rng, 6)} vermin {prose(rng, 4)}.") for n in range(40)]
    docs += [(200 + n, f"{prose(rng, 20)}. {prose(rng, 12)}.") for n in range(300)]
    # Only labels outside the held-out fold teach, so the chain is cut there; its parts have two links and more.
    labels = spark.createDataFrame([(k, int(k < 200)) for k, _ in docs], "doc_id long, toxic int")
    scorer = T.Scorer(T.fit(docs_of(docs), labels))
    assert scorer.margins(["onre the vermin erin"])[0] > 0.4 and scorer.margins(["onre the harvest erin"])[0] < 0.3


def test_full_caps_score_like_a_small_table(spark, docs_of, monkeypatch):
    """Both classes reach the caps, one toxic label among nine: the same texts get about the same scores."""
    rng = random.Random(10)
    docs = [(n, f"{prose(rng, 20)} {rng.choice(['vermin', prose(rng, 1)]) if n % 9 == 0 else ''} {prose(rng, 6)}.") for n in range(1800)]
    labels = spark.createDataFrame([(n, int(n % 9 == 0)) for n, _ in docs], "doc_id long, toxic int")
    asked = docs_of([(n, t) for n, t in docs[:200]]).select("doc_id", "text")
    plain = docs_of([(n, prose(rng, 20)) for n, _ in docs])

    def scores(model):
        return [model.score(m) for m in T.Scorer(model).margins([r.text for r in asked.collect()])]

    small = scores(T.fit(docs_of(docs), labels))
    rate = scores(T.fit(plain, labels))
    monkeypatch.setattr(T, "SAMPLE_DOCS", 120)
    full = scores(T.fit(docs_of(docs), labels))
    assert np.mean(np.abs(np.array(full) - small)) < 0.05 and [s >= 0.5 for s in full] == [s >= 0.5 for s in small]
    assert len(set(rate)) == 1 and scores(T.fit(plain, labels)) == pytest.approx(rate, abs=0.01) and rate[0] < 0.15


def test_whole_query_equals_the_dense_kernel(spark, docs_of):
    """Scores of whole texts against the kernel's explicit features, string by string, without the fold into triples of a batch."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = T.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.filter("n_chars < 4000").orderBy("doc_id").limit(40).collect()}
    texts |= {-1: None, -2: "", -3: "so i d i o t he", -4: "z" * 60 + " stupid"}
    known = {}

    def margin(string):
        if string not in known:
            known[string] = float(T.features([string])[0].astype(float) @ model.weights + model.bias)
        return known[string]

    def score(text):
        found = [margin(w) for s in T.strings((text or "").lower().split()) for w in T.windows(s)]
        return model.score(max([T.FLOOR, *found]))

    got = {r.doc_id: (r.score, r.predicted) for r in T.toxicity(docs.unionByName(spark.createDataFrame(
        [(k, t, "en", "s", 0) for k, t in texts.items() if k < 0], docs.schema)), labels).filter(f"doc_id IN ({', '.join(map(str, texts))})").collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        want = score(t)
        assert got[k][0] == pytest.approx(want, abs=1e-3) and (got[k][1] == int(want >= 0.5) or abs(want - 0.5) < 1e-3)
