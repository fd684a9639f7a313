"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document gets a signature: for each of ``num_hashes`` permutations the smallest hash of its
word shingles. A document is posted under each *token*, a pair (coordinate, value). Two documents
collide once per token they share, so the number of collisions is the number of equal
coordinates, and pairs with ``match_threshold`` or more are candidates:

* **skip**: tokens with one posting cannot collide; a document with fewer than the threshold of
  shared tokens cannot reach it and leaves before any join;
* **prefix**: two documents with T common tokens share one among the first (shared tokens - T + 1)
  of either when tokens are ordered by posting length, so only these short lists are joined;
* candidates count all coordinates, and those over the threshold are confirmed on full shingle
  sets: linked when ``100 * |A & B| >= percent * |A | B|``.

Groups of copies never become all their pairs. Equal sets are one class from the start. Then each
list links its documents to one hub (the one with the most collisions). Documents still in
different components are compared in a last exact round, which leaves out only pairs that cannot
be linked: those whose sizes differ too much, or whose shingles that occur in no other candidate
leave too few to share. The result is the set of connected components.

With 96 coordinates and a threshold of 64 a pair of similarity 0.85 is missed with probability
2e-6, one of 0.9 with 1e-11.

Defined cases: null or wordless texts have no shingles and are linked with nothing; fewer words
than a shingle make one shingle; rows with a null id are returned as their own class (component
null, kept true); rows that repeat an id are one document, linked if any of its texts is; other
columns are ignored. Spill and memory grow with single documents, never with a group.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.texts import lower_words, map_rows, picked
from touchline.operators.common import stage
from touchline.operators.linkage import link_components

#: Words whose hashes one worker keeps at a time.
WORD_CACHE = 400_000
#: Texts that one worker has as Python objects at a time, besides a block's, and rows that it sends at a time.
READ_ROWS, OUT_ROWS = 512, 16_384
#: Ids broadcast to fetch texts, at most (8 bytes each); more ids are joined by shuffle.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 5
    num_hashes: int = 96
    match_threshold: int = 64
    percent: int = 85
    seed: int = 1729


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, hashes: dict, width: int, weights: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    words = lower_words(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < width:
        return _mixed((h * weights[:n]).sum(dtype=np.uint64, keepdims=True) + weights[n: n + 1])
    total = h[: n - width + 1] * weights[0]
    for j in range(1, width):
        total += h[j: n - width + 1 + j] * weights[j]
    return np.unique(_mixed(total))


def minhash(values: np.ndarray, factors: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Per permutation the smallest permuted hash, folded to 32 bits."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), rows):
        np.minimum(low, (values[at: at + rows, None] * factors).min(axis=0), out=low)
    return (_mixed(low) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _tools(p: MinHashParams):
    return _WordHashes(), _odd(p.seed, p.shingle + 1), _odd(p.seed + 1, p.num_hashes)


def signatures(docs: DataFrame, p: MinHashParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the set) and ``sig`` (null without words), one row per row."""

    def rows(it):
        hashes, weights, factors = _tools(p)
        for key, text in it:
            s = shingle_set(text, hashes, p.shingle, weights)
            if len(s):
                yield key, len(s), blake2b(s.tobytes(), digest_size=16).digest(), minhash(s, factors)
            else:
                yield key, 0, None, None

    return map_rows(picked(docs, doc_id=id_col, text=text_col), rows,
                    "doc_id long, n_shingles long, digest binary, sig array<int>", size=1024, read=READ_ROWS)


def shared_postings(reps: DataFrame, p: MinHashParams) -> DataFrame:
    """``doc_id, n_shingles, hits, toks``: tokens other documents have too, shortest lists first.

    ``hits`` sums the lengths of the lists. Documents that cannot reach the threshold are gone.
    """
    posts = reps.select("doc_id", "n_shingles", F.posexplode("sig").alias("at", "v")).select(
        "doc_id", "n_shingles",
        (F.shiftleft(F.col("at").cast("long"), 32) + F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("tok"))
    lists = posts.groupBy("tok").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (posts.join(lists, "tok").groupBy("doc_id", "n_shingles")
            .agg(F.sum("n").alias("hits"), F.collect_list(F.struct("n", "tok")).alias("toks"))
            .filter(F.size("toks") >= p.match_threshold)
            .withColumn("toks", F.sort_array("toks")))


def _equal(p: MinHashParams):
    """Whether signatures ``sig_a`` and ``sig_b`` have enough equal coordinates."""
    return F.expr("aggregate(zip_with(sig_a, sig_b, (x, y) -> int(x = y)), 0, (s, e) -> s + e)") >= p.match_threshold


def colliding(pairs: DataFrame, sigs: DataFrame, p: MinHashParams) -> DataFrame:
    """Pairs ``a, b`` with enough equal coordinates."""
    def of(side: str):
        return sigs.select(F.col("doc_id").alias(side), F.col("sig").alias(f"sig_{side}"))

    return pairs.join(of("a"), "a").join(of("b"), "b").filter(_equal(p)).select("a", "b").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, p: MinHashParams) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar enough."""
    full = (stage(pairs, "near-close")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"))

    def rows(it):
        hashes, weights, _ = _tools(p)
        last, set_a = None, None
        for a, b, ta, tb in it:
            if a != last:
                last, set_a = a, shingle_set(ta, hashes, p.shingle, weights)
            set_b = shingle_set(tb, hashes, p.shingle, weights)
            both = len(np.intersect1d(set_a, set_b, assume_unique=True))
            if 100 * both >= p.percent * (len(set_a) + len(set_b) - both):
                yield a, b

    return map_rows(full.select("a", "b", "ta", "tb"), rows, "a long, b long", read=READ_ROWS)


def own_shingles(texts: DataFrame, p: MinHashParams) -> DataFrame:
    """``doc_id, n_own``: shingles of each document that no other row of ``texts`` has.

    A task sends a shingle that it met twice once and without an owner, so a shingle that a third
    of the documents hold arrives once per task.
    """
    def rows(it):
        hashes, weights, _ = _tools(p)
        for block in _blocks(it):
            sets = [(key, shingle_set(text, hashes, p.shingle, weights).view(np.int64)) for key, text in block]
            values = np.concatenate([s for _, s in sets])
            owners = np.repeat(np.array([k for k, _ in sets], np.int64), [len(s) for _, s in sets])
            v, first, n = np.unique(values, return_index=True, return_counts=True)
            owner, many = owners[first], n > 1
            del sets, values, owners, first, n
            for at in range(0, len(v), OUT_ROWS):  # numbers become Python objects a few at a time
                part = slice(at, at + OUT_ROWS)
                yield from zip(v[part].tolist(), owner[part].tolist(), many[part].tolist())

    sent = map_rows(texts.select("doc_id", "text"), rows, "shingle long, owner long, many boolean", size=OUT_ROWS, read=READ_ROWS)
    return (sent.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.max("owner").alias("doc_id"), F.max("many").alias("many"))
            .filter("n = 1 AND NOT many").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_own")))


def _blocks(it, chars: int = 8_000_000):
    """Lists of rows with about ``chars`` characters together."""
    block, held = [], 0
    for row in it:
        block.append(row)
        held += len(row[1] or "")
        if held >= chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def _near_sizes(a: str, b: str, p: MinHashParams):
    """Sizes that allow the similarity at all."""
    return (100 * F.least(a, b) >= p.percent * F.greatest(a, b))


def linked_components(docs: DataFrame, reps: DataFrame, p: MinHashParams) -> DataFrame:
    """``doc_id, component_id`` of class representatives linked with another one."""
    shared = stage(shared_postings(reps, p), "near-shared")
    many = shared.count()
    ids = shared.select("doc_id")
    texts = stage(docs.select("doc_id", "text")
                  .join(F.broadcast(ids) if many <= BROADCAST_IDS else ids, "doc_id", "left_semi"), "near-texts")
    # Rows that repeat a representative's id hold other texts of the same document.
    sigs = stage(reps.join(F.broadcast(ids) if many <= BROADCAST_IDS else ids, "doc_id", "left_semi"), "near-sigs")
    prefix = stage(shared.select(
        "doc_id", F.col("n_shingles").alias("size"), "hits",
        F.explode(F.expr(f"slice(toks, 1, size(toks) - {p.match_threshold - 1})")).alias("t"))
        .select("doc_id", "size", "hits", F.col("t.tok").alias("tok")), "near-prefix")

    hubs = prefix.groupBy("tok").agg(F.max(F.struct("hits", (-F.col("doc_id")).alias("doc_id"), "size")).alias("hub"))
    hubs = hubs.select("tok", (-F.col("hub.doc_id")).alias("a"), F.col("hub.size").alias("size_a"))
    star = (prefix.join(hubs, "tok").filter((F.col("a") != F.col("doc_id")) & _near_sizes("size", "size_a", p))
            .groupBy("a", F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("collisions")).select("a", "b"))
    star = stage(star, "near-star")
    edges = stage(confirmed(colliding(star, sigs, p), texts, p), "near-edges")
    groups = link_components(edges)

    # The last round: lists whose documents are not yet all in one component.
    labelled = (prefix.join(groups, prefix["doc_id"] == groups["node"], "left")
                .select(prefix["*"], F.coalesce("component", "doc_id").alias("comp")))
    per_comp = labelled.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = (per_comp.groupBy("tok").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("top"))
             .filter("comps > 1").select("tok", F.col("top.comp").alias("main")))
    open_ = stage(labelled.join(mixed, "tok"), "near-open")
    open_ids = stage(open_.select("doc_id").distinct(), "near-open-ids")
    own = own_shingles(texts.join(open_ids, "doc_id", "left_semi"), p)
    # What a document can share with any other; no pair is linked that would need more.
    open_ = (open_.join(own, "doc_id", "left").withColumn("can", F.col("size") - F.coalesce("n_own", F.lit(0)))
             .filter(100 * F.col("can") >= p.percent * F.col("size")))
    # A pair is made at the smallest token it shares, so it is one row however many tokens it shares, and
    # only if its signatures have enough in common.
    open_ = stage(open_.groupBy("doc_id", "comp", "size", "can").agg(F.collect_set(F.struct("tok", "main")).alias("at")), "near-open")
    open_ = open_.join(sigs.select("doc_id", "sig"), "doc_id")
    open_ = open_.select("doc_id", "comp", "size", "can", "sig", F.col("at.tok").alias("toks"), F.explode("at").alias("t"))
    open_ = open_.select("doc_id", "comp", "size", "can", "sig", "toks", F.col("t.tok").alias("tok"), F.col("t.main").alias("main"))
    columns = ("doc_id", "comp", "size", "can", "sig", "toks")
    a = open_.select("tok", "main", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = open_.select("tok", *[F.col(c).alias(f"{c}_b") for c in columns])
    needed = p.percent * (F.col("size_a") + F.col("size_b")) <= (100 + p.percent) * F.least("can_a", "can_b")
    rest = (a.filter("comp_a != main").join(b, "tok")
            .filter((F.col("comp_a") != F.col("comp_b")) & _near_sizes("size_a", "size_b", p) & needed
                    & (F.array_min(F.array_intersect("toks_a", "toks_b")) == F.col("tok"))
                    & ((F.col("comp_b") == F.col("main")) | (F.col("doc_id_a") < F.col("doc_id_b"))) & _equal(p))
            .select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct())
    more = stage(confirmed(rest, texts, p), "near-edges")
    joined = link_components(edges.unionByName(more)) if more.limit(1).count() else groups
    return joined.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    docs = picked(docs, doc_id=id_col, text=text_col)
    rows = stage(signatures(docs, p), "near-signatures")
    classes = rows.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    first = classes.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = stage(classes.select("doc_id", "n_shingles", "digest").join(first, "digest"), "near-members")
    reps = classes.join(first.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"], "left_semi")
    linked = linked_components(docs.filter("doc_id IS NOT NULL"), reps, p)
    comp = member.join(linked.withColumnRenamed("doc_id", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component_id", "rep").alias("component_id"))
    best = comp.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(best, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in their columns, that stay: one document of each group."""
    lost = near_duplicates(docs, p, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, docs[id_col] == lost["__lost"], "left_anti")
