"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings sums, over all subsequences of three letters they share, a decay to
the power of the spans they take; an inserted letter, a dot or a gap only lengthens spans, so
``i.d.i.o.t`` or ``idxiot`` stay close to the word. Kernels are normalised. ``LANDMARKS`` strings
give the feature map K(x, Z) K(Z, Z)^-1/2, in which a linear squared-hinge SVM is fitted. As
the kernel is explicit in letter triples, the fitted machine folds into one weight per triple
(27^3 numbers, sent to the workers once), so a string is scored without visiting landmarks.

Learning: at most ``SAMPLE_DOCS`` labelled documents of each class outside the held-out fold, in hash
order, give at most ``SAMPLE_SENTENCES`` distinct sentences of each label. Labels are the documents', so
only some sentences of a toxic one are toxic: strings that stand in toxic sentences, after many different
words and in many documents, far more often than chance allows are positives, however rare beside the
commonest (copied passages and repetitive documents do not count, and a family of copies is one document),
variants with an inserted sign are added, and strings of clean sentences are negatives (at most twice ``NEGATIVES``);
rounds of refitting look through ``SCANNED`` clean strings and add the ``HARD`` nearest the margin. A logistic curve over the
highest margin of the sampled documents gives the score. Sampled documents and sentences weigh as many as
they stand for, so shares of the classes are those of all labels, whatever the caps.

Scoring: every string of a whole text (single letters in a row are joined, long strings pass through in
overlapping windows); the highest margin counts. Workers remember margins of strings.

Defined cases: null, empty or wordless texts get the score of the lowest margin; labels that are null or
have no document are not used; without labels of both classes the score is the constant rate of toxic
labels; rows that repeat an id are scored each; other columns are ignored, or kept by ``without_toxic``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.texts import drop_kept, give_back, map_rows, picked
from touchline.operators.common import stage
from touchline.operators.linkage import link_components

#: Bounds of the training sample: documents and distinct sentences of each class.
SAMPLE_DOCS, SAMPLE_SENTENCES = 3_000, 30_000
LANDMARKS, DECAY, WINDOW, STRIDE, ROUNDS = 256, 0.7, 16, 6, 3
#: Bounds of the clean strings that the machine meets: the commonest and as many drawn ones, those looked through
#: each round for margins that are too high, and those of them that are added.
NEGATIVES, SCANNED, HARD = 3_000, 60_000, 1_500
#: The margin above which all count alike in the curve.
CEILING = 1.0
#: Documents of the sample that share a sentence of so many words are taken for copies.
COPIED_WORDS = 12
FOLDS = 5
#: Margins below this count as this, so clearly clean strings need no norm.
FLOOR = -1.0
CACHE = 150_000
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LOOKS = str.maketrans("013457@$", "oieastas")
#: Sentences; a longer one is cut so that the sample stays bounded.
_SENTENCE = re.compile(r"[^.!?\n]{1,2000}")


def folded(string: str) -> str:
    """Lower case without accents; digits and signs that stand for letters become them."""
    if not string.isascii():
        string = "".join(c for c in unicodedata.normalize("NFKD", string) if not unicodedata.combining(c))
    string = string.lower()
    core = string.strip(".,;:!?\"'()[]{}*#&%|<>-_+=/\\~`^")
    return core.translate(_LOOKS) if any(c.isalpha() for c in core) else core


def strings(words: list[str]) -> list[str]:
    """Strings of a word list: the words, and single letters in a row joined."""
    out, row = list(words), []
    for w in words:
        if len(w) == 1:
            row.append(w)
            continue
        if len(row) > 2:
            out.append("".join(row))
        row = []
    if len(row) > 2:
        out.append("".join(row))
    return out


def windows(string: str) -> list[str]:
    s = folded(string)
    if len(s) <= WINDOW:
        return [s] if len(s) > 2 else []
    return [s[at: at + WINDOW] for at in range(0, len(s) - WINDOW + STRIDE, STRIDE)]


def _codes(group: list[str]) -> np.ndarray:
    """Letters as 0 to 25, all else as 26; one row per string of one length."""
    raw = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(len(group), -1)
    return np.where((raw >= 97) & (raw <= 122), raw - 97, 26).astype(np.int64)


_TRIPLES: dict[int, tuple] = {}


def _triples(n: int):
    """Index triples i < j < k below n, and the decay of each one's span."""
    if n not in _TRIPLES:
        at = np.array(list(combinations(range(n), 3)), np.int64)
        weight = DECAY ** (at[:, 2] - at[:, 0] + 1).astype(float)
        _TRIPLES[n] = at[:, 0], at[:, 1], at[:, 2], weight, math.sqrt((weight ** 2).sum())
    return _TRIPLES[n]


def _triple_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    i, j, k, weight, least = _triples(codes.shape[1])
    return (codes[:, i] * 27 + codes[:, j]) * 27 + codes[:, k], weight, least


def _norms(triples: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of self kernels: equal triples of a string add up first."""
    order = np.argsort(triples, axis=1, kind="stable")
    rows = np.take_along_axis(triples, order, 1)
    w = weight[order]
    starts = np.ones(rows.shape, bool)
    starts[:, 1:] = rows[:, 1:] != rows[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(starts.ravel()))
    owner = np.nonzero(starts)[0]
    return np.sqrt(np.bincount(owner, sums ** 2, len(rows)))


def features(group: list[str]) -> np.ndarray:
    """Explicit normalised kernel features of strings, dense over the 27^3 triples."""
    out = np.zeros((len(group), 27 ** 3), np.float32)
    for n in {len(s) for s in group}:
        at = [x for x, s in enumerate(group) if len(s) == n]
        triples, weight, _ = _triple_codes(_codes([group[x] for x in at]))
        norms = _norms(triples, weight)
        for row, x in enumerate(at):
            out[x] = np.bincount(triples[row], weight / norms[row], out.shape[1])
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 4.0
    shift: float = 0.0

    def margins(self, group: list[str], rows: int = 2048) -> np.ndarray:
        """Margins of strings of 3 to WINDOW characters, not below FLOOR."""
        out = np.full(len(group), FLOOR)
        by_size: dict[int, list[int]] = {}
        for x, s in enumerate(group):
            by_size.setdefault(len(s), []).append(x)
        for at in by_size.values():
            for a in range(0, len(at), rows):
                part = np.array(at[a: a + rows])
                triples, weight, least = _triple_codes(_codes([group[x] for x in part]))
                raw = (self.weights[triples] * weight).sum(1)
                near = np.flatnonzero(raw / least + self.bias > FLOOR)
                if len(near):
                    exact = raw[near] / _norms(triples[near], weight) + self.bias
                    out[part[near]] = np.maximum(exact, FLOOR)
        return out

    def score(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * min(margin, CEILING) + self.shift))))


class Scorer:
    """Highest margins of texts, in one worker."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def learn(self, new: list[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        parts = [windows(s) for s in new]
        flat = self.model.margins([w for p in parts for w in p])
        at = 0
        for s, p in zip(new, parts):
            self.known[s] = float(flat[at: at + len(p)].max()) if p else FLOOR
            at += len(p)

    def margins(self, texts: list[str | None]) -> list[float]:
        lists = [strings(t.lower().split()) if t else [] for t in texts]
        get = self.known.get
        found = [list(map(get, x)) for x in lists]
        short = [k for k, f in enumerate(found) if None in f]
        if short:
            if len(self.known) > CACHE:
                self.known.clear()
                short = list(range(len(lists)))
            self.learn(list({s for k in short for s in lists[k] if s not in self.known}))
            for k in short:
                found[k] = list(map(get, lists[k]))
        return [max(f, default=FLOOR) for f in found]


def _fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Squared-hinge SVM by Newton steps on the margin violators; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        on = y * (x @ w) < 1
        xs = x[on] * (share[on] * cost)[:, None]
        new = np.linalg.solve(ridge + x[on].T @ xs, xs.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _fit_machine(landmarks: list[str], positive: list[str], negative: list[str]) -> Model:
    z = features(landmarks)
    parts = [slice(a, a + 2187) for a in range(0, z.shape[1], 2187)]
    gram = np.zeros((len(z), len(z)))
    for part in parts:
        wide = z[:, part].astype(np.float64)
        gram += wide @ wide.T
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    fold = np.vstack([z[:, part].T.astype(np.float64) @ root for part in parts])  # triples to Nystroem features
    del z, gram, vectors

    def mapped(group):
        return np.vstack([features(group[a: a + 64]) @ fold for a in range(0, len(group), 64)])

    w = _fit_svm(np.vstack([mapped(positive), mapped(negative)]), np.r_[np.ones(len(positive)), -np.ones(len(negative))])
    return Model(fold @ w[:-1], float(w[-1]))


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift of a logistic curve over weighted rows, by damped Newton steps."""
    x = np.c_[margin, np.ones(len(margin))]

    def loss(w):
        f = x @ w
        return weight @ np.logaddexp(0, f) - (weight * y) @ f + ridge / 2 * w @ w

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (weight * (p - y)) + ridge * w)
        rate = 1.0
        while loss(w - rate * step) > loss(w) and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def contexts(sentences: list[tuple[int, str]]) -> dict[str, int]:
    """Strings with the number of documents they stand in or, if fewer, of different words they follow.

    Copies of a passage repeat the words before; a long document is one document.
    """
    follows: dict[str, set[str]] = {}
    docs: dict[str, set[int]] = {}
    for doc, s in sentences:
        before = "^"
        for word in s.lower().split():
            for w in windows(word):
                follows.setdefault(w, set()).add(before)
                docs.setdefault(w, set()).add(doc)
            before = word
    return {w: min(len(x), len(docs[w])) for w, x in follows.items()}


def telling(bad: dict[str, int], good: dict[str, int], weights: tuple[float, float] = (1.0, 1.0)) -> list[str]:
    """Strings mostly in toxic contexts whose share of them is above the average by more than chance, given that all are tried.

    ``weights``: contexts that one of the sample's stands for, clean and toxic. Chance is judged on the sample itself.
    """
    share = sum(bad.values()) / (sum(bad.values()) + sum(good.values()))
    least = math.log(100 * len(bad.keys() | good.keys()))
    out = []
    for w, n in bad.items():
        total = n + good.get(w, 0)
        p = n / total
        if p > share and n * weights[1] > good.get(w, 0) * weights[0]:
            gain = n * math.log(p / share) + ((total - n) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0)
            if gain > least:
                out.append((-gain, w))
    return [w for _, w in sorted(out)]


def context_counts(sentences: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """``contexts`` of toxic and of clean sentences (``doc_id, sentence, toxic``), counted in Spark: the driver gets strings
    and their numbers, never a sentence."""
    def rows(it):
        for doc, s, toxic in it:
            before = 0
            for word in s.lower().split():
                for w in set(windows(word)):
                    yield toxic, w, doc, before
                before = xxhash.xxh64_intdigest(word) >> 1 | 1

    met = map_rows(sentences.select("doc_id", "sentence", "toxic"), rows, "toxic int, w string, doc_id long, before long", size=65536)
    found = met.groupBy("toxic", "w").agg(F.least(F.count_distinct("doc_id"), F.count_distinct("before")).alias("n")).orderBy("w").toArrow()
    out: tuple[dict[str, int], dict[str, int]] = {}, {}
    for batch in found.to_batches():
        for toxic, w, n in zip(*[c.to_pylist() for c in batch.columns]):
            out[1 - toxic][w] = n
    return out


def fit_strings(toxic: list[tuple[int, str]], clean: list[tuple[int, str]], seed: int = 7,
                weights: tuple[float, float] = (1.0, 1.0)) -> Model | None:
    """A machine from (document, sentence) pairs of toxic and of clean documents; None without a telling string."""
    return fit_contexts(contexts(toxic), contexts(clean), seed, weights)


def fit_contexts(bad: dict[str, int], good: dict[str, int], seed: int = 7, weights: tuple[float, float] = (1.0, 1.0)) -> Model | None:
    """A machine from the contexts of strings in toxic and in clean sentences; None without a telling string."""
    if not bad or not good:
        return None
    seeds = telling(bad, good, weights)
    if not seeds:
        return None
    rng = np.random.default_rng(seed)
    varied = []
    for w in seeds:
        for _ in range(6):
            at = int(rng.integers(1, len(w)))
            varied.append((w[:at] + (_LETTERS + ".-*")[int(rng.integers(0, 29))] + w[at:])[:WINDOW])
        varied.append(".".join(w)[:WINDOW])
    pool = sorted(w for w in good if w not in seeds)
    common = sorted(pool, key=lambda w: (-good[w], w))[:NEGATIVES]
    some = [pool[i] for i in sorted(rng.choice(len(pool), min(len(pool), NEGATIVES), replace=False))]
    negative = list(dict.fromkeys(common + some))
    positive = seeds + [w for w in varied if w not in good]
    landmarks = list(dict.fromkeys(positive[: max(LANDMARKS // 2, len(seeds))] + negative[:: max(1, 4 * len(negative) // LANDMARKS)]))
    scan = pool if len(pool) <= SCANNED else [pool[i] for i in sorted(rng.choice(len(pool), SCANNED, replace=False))]
    for _ in range(ROUNDS):
        near = _fit_machine(landmarks, positive, negative).margins(scan)
        hard = [scan[i] for i in np.argsort(-near, kind="stable")[:HARD] if near[i] > -0.9]
        negative = list(dict.fromkeys(negative + hard))
        landmarks = list(dict.fromkeys(landmarks + hard[: LANDMARKS // 8]))
    return _fit_machine(landmarks, positive, negative)


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """``doc_id, text, toxic`` of labels outside the held-out fold that have a text, at most SAMPLE_DOCS of each class, and
    how many such labels of its class each one stands for."""
    docs = docs.filter("text IS NOT NULL")
    own = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
           .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id"), "doc_id", "left_semi"))
    own = stage(own, "toxic-labels")
    weights = {r["toxic"]: max(1.0, r["n"] / SAMPLE_DOCS) for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [own.filter(F.col("toxic") == c).orderBy(*order).limit(SAMPLE_DOCS) for c in (0, 1)]
    # At most 2 * SAMPLE_DOCS rows of two numbers.
    ids = some[0].unionByName(some[1])
    return docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic"), weights


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample, weights = labelled(picked(docs, doc_id=id_col, text=text_col), picked(labels, doc_id="doc_id", toxic="toxic"))
    sample = sample.cache()
    try:
        sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

        def rows(it):
            for doc, text, toxic in it:
                for s in _SENTENCE.findall(text):
                    if s.strip():
                        yield doc, toxic, s.strip()

        found = map_rows(sample, rows, "doc_id long, toxic int, sentence string")
        each = found.groupBy("sentence").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("low"), F.min("doc_id").alias("doc_id"))
        # Copies count as one document: those linked by longer sentences take the smallest id of all.
        long_ = F.size(F.split("sentence", " ")) >= COPIED_WORDS
        shared = (found.filter(long_).join(each.filter(long_).select("sentence", F.col("doc_id").alias("b")), "sentence")
                  .filter("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct())
        first = link_components(shared).select(F.col("node").alias("doc_id"), F.col("component").alias("first"))
        each = stage(each.filter(F.col("toxic") == F.col("low")).join(first, "doc_id", "left")
                     .select("sentence", "toxic", F.coalesce("first", "doc_id").alias("doc_id")), "toxic-sentences")
        held = {r["toxic"]: r["n"] for r in each.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        order = [F.xxhash64("sentence"), F.col("sentence")]
        some = [each.filter(F.col("toxic") == c).orderBy(*order).limit(SAMPLE_SENTENCES) for c in (0, 1)]
        model = None
        if held.get(0) and held.get(1):
            bad, good = context_counts(some[0].unionByName(some[1]))
            model = fit_contexts(bad, good, weights=tuple(weights[c] * held[c] / min(held[c], SAMPLE_SENTENCES) for c in (0, 1)))
            del bad, good
        if model is None:
            standing = {c: n * weights[c] for c, n in sizes.items()}
            rate = (standing.get(1, 0) + 0.5) / (sum(standing.values()) + 1)
            return Model(np.zeros(27 ** 3), FLOOR, 0.0, math.log(rate / (1 - rate)))
        scored = [(r["margin"], r["toxic"]) for r in with_margins(sample, model, "toxic").select("margin", "toxic").collect()]
        model.slope, model.shift = _logistic(np.minimum([m for m, _ in scored], CEILING), np.array([t for _, t in scored], float),
                                             np.array([weights[t] for _, t in scored]))
        return model
    finally:
        sample.unpersist()


def _blocks(it, chars: int = 2_000_000):
    block, held = [], 0
    for row in it:
        block.append(row)
        held += len(row[1] or "")
        if held >= chars or len(block) >= 2000:
            yield block
            block, held = [], 0
    if block:
        yield block


def with_margins(docs: DataFrame, model: Model, extra: str | None = None) -> DataFrame:
    """``doc_id, margin`` (highest of the text) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(it):
        scorer = Scorer(sent.value)
        for block in _blocks(it):
            for row, m in zip(block, scorer.margins([r[1] for r in block])):
                yield (row[0], m, *row[2:])

    cols = ["doc_id", "text"] + [extra] * bool(extra)
    return map_rows(docs.select(*cols), rows, "doc_id long, margin double" + f", {extra} int" * bool(extra))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = fit(docs, labels, id_col, text_col)
    scored = with_margins(picked(docs, doc_id=id_col, text=text_col), model)
    score = 1 / (1 + F.exp(-(F.least("margin", F.lit(CEILING)) * model.slope + model.shift)))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"),
                         score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in their columns, that are not predicted toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def keep(batches):
        drop_kept()
        model = sent.value
        scorer = Scorer(model)
        for batch in batches:
            size = max(1, 2_000_000 // max(1, batch.nbytes // max(1, batch.num_rows)))
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                ok = [model.score(m) < 0.5 for m in scorer.margins(part.column(at).to_pylist())]
                import pyarrow as pa

                yield part.filter(pa.array(ok))
        batch = part = scorer = None
        give_back()

    return docs.mapInArrow(keep, docs.schema)
