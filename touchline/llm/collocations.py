"""Phrase collocations by best-first branch-and-bound growth over a prefix tree.

Texts are cut into pieces at punctuation and line ends and those into words. Per language, phrases of 2 to ``max_words``
words with at least ``min_count`` occurrences are candidates. A cut of a candidate into a first part (l occurrences) and a
rest (r) scores floor(1000 * a * n / (l * r)), the lowest cut counts, and a candidate that always stands inside one longer
candidate is dropped. Each language's ``top`` phrases are returned.

**Growth.** The nodes of the tree are phrases, grown word by word. All extensions of a first word w score at most
floor(1000 * n / f(w)), because the cut after w has r >= a: the count of a prefix bounds everything below it. The frontier, all
words frequent enough, is expanded best bound first in rounds (``shares`` of a language's occurrences). After a round the ``top``-th
surviving score of each language is known so far; a word is expanded only if its bound reaches that score, ties
included, so the growth of a language ends when nothing outside can enter its list.

**Passes.** Words are counted once, then the corpus is written once as arrays of 64-bit word ids, in which rare words and
piece borders are zero. Each growth step is a scan of these arrays in which a task counts the extensions of its blocks
before the shuffle; exact counts are kept per (prefix id, word id), and ids of words are checked to be distinct (another
seed is taken if not). One scan more per round counts all parts of the new candidates and looks at the words around
them: a phrase with one and the same word before all its occurrences, or after them, stands inside a longer candidate.
What a scan needs of earlier counts is a set of bits of bounded size (64 bits per id, 2 ** ``BITS`` at most), built from the ids: it
lets too much through, never too little, and the exact counts decide. So no table that grows with the data is sent to the workers.

Defined cases: a null text is empty, a null language is ``und``; rows that repeat are counted each; ids are not looked at; other
columns are ignored; an empty table gives no rows. Long texts are cut into words block by block; only the ids of one text are
held whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.texts import encoded, map_rows, picked
from touchline.operators.common import stage

#: Bits of the largest set that scans look ids up in, as a power of two (4 MB).
BITS = 25
#: Words counted before a task sends its counts, ids in a row of the written corpus, bytes of occurrences combined at a time.
HELD_WORDS, CHUNK, HELD_BYTES = 120_000, 1 << 17, 1 << 23
#: Ids remembered per language, and languages remembered, in a worker.
WORD_CACHE, LANGUAGES = 60_000, 4
#: Texts that are Python strings at a time.
READ = 128
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r\t", _UPPER.lower() + b"\n" * 9 + b" ")
_BLANK = re.compile(rb"[ \n]")


@dataclass(frozen=True)
class PhraseParams:
    min_count: int = 100
    max_words: int = 5
    top: int = 2000
    #: Shares of a language's frequent occurrences whose words the rounds expand, rarest words first.
    shares: tuple[float, ...] = (0.3, 1.0)


def tokens(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a whole text, lower-cased, in lists; a line feed stands for each border of pieces."""
    raw = encoded(text).translate(_FOLD) if text else b""
    at = 0
    while at < len(raw):
        found = _BLANK.search(raw, at + size)
        end = found.start() if found else len(raw)
        yield list(filter(None, raw[at:end].replace(b"\n", b" \n ").split(b" ")))
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, f``; each task adds up what it meets before the shuffle."""
    def rows(it):
        counts: dict[str, Counter] = {}

        def sent():
            for lang, found in counts.items():
                found.pop(b"\n", None)
                yield from ((lang, w.decode("utf-8", "replace"), n) for w, n in found.items())
            counts.clear()

        for lang, text in it:
            for words in tokens(text):
                counts.setdefault(lang, Counter()).update(words)
                if sum(map(len, counts.values())) > HELD_WORDS:
                    yield from sent()
        yield from sent()

    return map_rows(docs, rows, "lang string, word string, n long", size=16384, read=READ).groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _seed(lang: str, attempt: int) -> int:
    return xxhash.xxh64_intdigest(encoded(lang) + b"\0" * attempt, 42)


def with_ids(words: DataFrame, p: PhraseParams) -> tuple[DataFrame, int]:
    """``words`` with an ``id`` of language and word that no frequent word shares with another, and the attempt that gave it."""
    for attempt in range(64):
        salted = F.concat(F.col("lang"), F.lit("\0" * attempt))
        numbered = words.withColumn("id", F.xxhash64(salted, F.col("word")))
        shared = (numbered.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f"))
                  .filter((F.col("f") >= p.min_count) & ((F.col("n") > 1) | (F.col("id") == 0))))
        if not shared.limit(1).count():
            return numbered, attempt
    raise RuntimeError("no seed gives the words distinct ids")


def bits_of(df: DataFrame, col: str) -> np.ndarray:
    """The set of ``col`` by its lowest bits; at most 2**BITS / 64 numbers come to the driver."""
    size = 1 << min(BITS, max(12, (64 * df.count()).bit_length()))
    slots = (df.select(F.expr(f"{col} & {size - 1}L").alias("v")).select(F.expr("shiftright(v, 6)").alias("slot"), F.expr("shiftleft(1L, int(v & 63))").alias("bit"))
             .groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(size >> 6, np.int64)
    out[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    return out.view(np.uint64)


def _sent(df: DataFrame, sets: list[np.ndarray]):
    """The sets, packed, for the workers; ``_unpacked`` gives them there."""
    packed = [zstandard.ZstdCompressor(level=1).compress(s.tobytes()) for s in sets]
    return df.sparkSession.sparkContext.broadcast(packed)


def _unpacked(packed: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.ZstdDecompressor().decompress(s), np.uint64) for s in packed]


def held(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    low = ids & np.uint64(64 * len(bits) - 1)
    return (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def grown_id(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Id of the phrase that a word makes of a prefix."""
    x = (prefix ^ (prefix >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Ids(dict):
    """Ids of the words of one language, zero for words that are not frequent for certain and for borders."""

    def __init__(self, seed: int, bits: np.ndarray):
        self.seed, self.bits = seed, bits
        self[b"\n"] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
            self[b"\n"] = 0
        value = xxhash.xxh64_intdigest(word, self.seed)
        low = value & (64 * len(self.bits) - 1)
        if not int(self.bits[low >> 6]) >> (low & 63) & 1:
            value = 0
        self[word] = value
        return value


def as_ids(docs: DataFrame, bits: np.ndarray, attempt: int) -> DataFrame:
    """``chunk``: texts as word ids, zeros merged and words without a neighbour left out; each text ends with a zero."""
    sent = _sent(docs, [bits])

    def packed(parts):
        ids = np.concatenate([np.zeros(1, np.uint64), *parts])
        on = np.r_[ids != 0, False]
        # A word stays beside a word, a zero after a word that stays.
        stays = on[:-1] & (on[1:] | np.r_[False, on[:-2]])
        stays |= ~on[:-1] & np.r_[False, stays[:-1]]
        out = ids[stays]
        return zstandard.ZstdCompressor(level=1).compress(np.r_[np.zeros(1, np.uint64), out, np.zeros(1, np.uint64)].tobytes())

    def rows(it):
        known: dict[str, _Ids] = {}
        bits, = _unpacked(sent.value)
        parts, n, zero = [], 0, np.zeros(1, np.uint64)
        for lang, text in it:
            if lang not in known:
                if len(known) >= LANGUAGES:
                    known.clear()
                known[lang] = _Ids(_seed(lang, attempt), bits)
            get = known[lang].__getitem__
            for words in tokens(text):
                parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
                n += len(words)
            parts.append(zero)
            if n >= CHUNK:
                yield (packed(parts),)
                parts, n = [], 0
        if n:
            yield (packed(parts),)

    return map_rows(docs, rows, "chunk binary", size=4, read=READ)


def _scan(corpus: DataFrame, sets: list[np.ndarray], found, schema: str) -> DataFrame:
    """Columns that ``found(ids, sets)`` yields for each chunk (prefix, word, a count, and pairs of a least and a greatest), added up
    over the task while the sums stay small."""
    sent = _sent(corpus, sets)
    names = [c.split()[0] for c in schema.split(", ")]

    def added(blocks):
        prefix, word, n, *ends = [np.concatenate(c) for c in zip(*blocks)]
        order, starts = _runs(prefix, word)
        first = order[starts]
        ops = [np.minimum, np.maximum] * (len(ends) // 2)
        return [prefix[first], word[first], np.add.reduceat(n[order], starts), *[op.reduceat(v[order], starts) for op, v in zip(ops, ends)]]

    def run(batches):
        blocks, n, sets = [], 0, _unpacked(sent.value)
        for batch in batches:
            for chunk in batch.column(0):
                ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(chunk.as_buffer()), np.uint64)
                for block in found(ids, sets):
                    if len(block[0]):
                        blocks.append(block)
                        n += sum(c.nbytes for c in block)
                if n >= 2 * HELD_BYTES:
                    blocks = [added(blocks)]
                    n = sum(c.nbytes for c in blocks[0])
                    if n >= HELD_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in blocks[0]], names)
                        blocks, n = [], 0
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in added(blocks)], names)

    return corpus.mapInArrow(run, schema)


def _runs(prefix: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, and where each pair starts in it."""
    order = np.argsort(grown_id(prefix, word))
    p, w = prefix[order], word[order]
    return order, np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1])])


def extensions(corpus: DataFrame, sets: list[np.ndarray], p: PhraseParams) -> DataFrame:
    """``p, w, a``: extensions by a word w of prefixes p, whose parts from the first word on lie in ``sets``."""
    def found(ids, sets):
        at = np.flatnonzero((ids != 0) & held(sets[0], ids))
        prefix = ids[at]
        for have in sets[1:]:
            at = at + 1
            word = ids[at]
            grown = grown_id(prefix, word)
            ok = (word != 0) & held(have, grown)
            at, prefix = at[ok], grown[ok]
        word = ids[at + 1]
        prefix, word = prefix[word != 0], word[word != 0]
        yield prefix, word, np.ones(len(word), np.uint64)

    sent = _scan(corpus, sets, found, "p long, w long, n long")
    return sent.groupBy("p", "w").agg(F.sum("n").alias("a")).filter(F.col("a") >= p.min_count)


def profiles(corpus: DataFrame, sets: list[np.ndarray]) -> DataFrame:
    """``p, w, f, inside``: occurrences of the phrases in ``sets`` (by length from one word on), and whether one word stands
    before all of them or after all of them."""
    def found(ids, sets):
        at = np.flatnonzero((ids != 0) & held(sets[0], ids))
        start, prefix = at, ids[at]
        for have in sets[1:]:
            at = at + 1
            word = ids[at]
            grown = grown_id(prefix, word)
            ok = (word != 0) & held(have, grown)
            at, start = at[ok], start[ok]
            before, after = ids[start - 1].view(np.int64), ids[at + 1].view(np.int64)
            yield prefix[ok], word[ok], np.ones(len(at), np.uint64), before, before, after, after
            prefix = grown[ok]

    sent = _scan(corpus, sets, found, "p long, w long, n long, b0 long, b1 long, a0 long, a1 long")
    ends = [F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.min("a0").alias("a0"), F.max("a1").alias("a1")]
    same = ((F.col("b0") == F.col("b1")) & (F.col("b0") != 0)) | ((F.col("a0") == F.col("a1")) & (F.col("a0") != 0))
    return sent.groupBy("p", "w").agg(F.sum("n").alias("f"), *ends).select("p", "w", "f", same.alias("inside"))


def _chain(ids: list[int]) -> list[int]:
    """Signed ids of the prefixes of a phrase, by length from one word on."""
    out = [np.array([ids[0]], np.int64).view(np.uint64)]
    for w in ids[1:]:
        out.append(grown_id(out[-1], np.array([w], np.int64).view(np.uint64)))
    return [int(x.view(np.int64)[0]) for x in out]


def with_phrase_ids(df: DataFrame) -> DataFrame:
    """``p, w, a`` with the ``pid`` of the phrase."""
    def run(batches):
        for b in batches:
            p, w = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(grown_id(p, w).view(np.int64))], ["p", "w", "a", "pid"])

    return df.select("p", "w", "a").mapInArrow(run, "p long, w long, a long, pid long")


def parts(phrases: DataFrame) -> DataFrame:
    """``p, w, cut, sp, sw, size, pid`` of every part of each phrase: prefix id and last word of the part (prefix 0 for one word), and
    after how many words it starts; ``cut`` is that number if the part is the rest of a cut, else null."""
    def rows(it):
        for p, w, ids in it:
            for start in range(len(ids)):
                chain = _chain(ids[start:])
                for size, pid in enumerate(chain, 1):
                    if size < len(ids):
                        rest = start + size == len(ids)
                        yield p, w, start if rest else None, chain[size - 2] if size > 1 else 0, ids[start + size - 1], size, pid

    return map_rows(phrases.select("p", "w", "ws"), rows, "p long, w long, cut int, sp long, sw long, size int, pid long")


def scored(cands: DataFrame, words: DataFrame, corpus: DataFrame, p: PhraseParams) -> DataFrame:
    """Surviving candidates ``lang, ws, a, l, r, n, score``."""
    broken = stage(parts(cands), "phrase-parts")
    # Candidates short enough to stand inside a longer one are looked at like parts.
    short = with_phrase_ids(cands.filter(F.size("ws") < p.max_words))
    own = short.join(cands.select("p", "w", F.size("ws").alias("size")), ["p", "w"]).select("p", "w", "size", "pid")
    asked = broken.select(F.col("sp").alias("p"), F.col("sw").alias("w"), "size", "pid").unionByName(own).distinct()
    asked = stage(asked, "phrase-asked")
    sets = [bits_of(asked.filter(F.col("size") == size), "pid") for size in range(1, p.max_words)]
    found = stage(profiles(corpus, sets).join(asked.select("p", "w"), ["p", "w"], "left_semi"), "phrase-profiles")
    counts = found.select(F.col("p").alias("sp"), F.col("w").alias("sw"), F.col("f").alias("r")).unionByName(
        words.select(F.lit(0).cast("long").alias("sp"), F.col("id").alias("sw"), F.col("f").alias("r")))
    cuts = (broken.filter("cut IS NOT NULL").join(counts, ["sp", "sw"])
            .join(cands.select("p", "w", "lang", "ws", "ls", "a", "n"), ["p", "w"]))
    big = "decimal(38,0)"
    score = F.expr(f"(cast(1000 AS {big}) * a * n) div (cast(l AS {big}) * r)")
    cuts = cuts.withColumn("l", F.expr("ls[cut - 1]")).withColumn("score", score)
    low = cuts.groupBy("p", "w", "lang", "ws", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return (low.join(found.filter("inside").select("p", "w"), ["p", "w"], "left_anti")
            .select("lang", "ws", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score")))


def grown(frontier: DataFrame, corpus: DataFrame, p: PhraseParams) -> DataFrame | None:
    """Candidates ``p, w, lang, ws, ls, a, n`` below the words of the frontier; None if there are none.

    ``ws`` are the words' ids and ``ls`` the counts of the prefixes.
    """
    parents = frontier.select(F.col("id").alias("pid"), "lang", F.array("id").alias("ws"), F.array().cast("array<long>").alias("ls"),
                              F.col("f").alias("a"), "n")
    sets, levels = [bits_of(parents, "pid")], []
    if not sets[0].any():
        return None
    for size in range(2, p.max_words + 1):
        counts = with_phrase_ids(extensions(corpus, sets, p))
        above = parents.select(F.col("pid").alias("p"), "lang", F.col("ws").alias("up"), F.concat("ls", F.array("a")).alias("ls"), "n")
        level = stage(counts.join(above, "p").select("p", "w", "pid", "lang", F.concat("up", F.array("w")).alias("ws"), "ls", "a", "n"),
                      f"phrase-level-{size}")
        found = bits_of(level, "pid")
        if not found.any():
            break
        levels.append(level)
        parents = level
        sets.append(found)
    if not levels:
        return None
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.drop("pid")


def _ordered(df: DataFrame, p: PhraseParams, *more) -> DataFrame:
    """The first ``top`` rows of each language and their ``rank``."""
    window = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), *more)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= p.top)


def collocations(docs: DataFrame, p: PhraseParams = PhraseParams(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language."""
    docs = picked(docs, lang=lang_col, text=text_col).filter("text IS NOT NULL").withColumn("lang", F.coalesce("lang", F.lit("und")))
    words, attempt = with_ids(stage(word_counts(docs), "phrase-words"), p)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= p.min_count)
    # Rarest first: the occurrences of all rarer words tell a word's round.
    mass = frequent.groupBy("lang", "f").agg(F.sum("f").alias("m"))
    below = F.sum("m").over(W.partitionBy("lang").orderBy("f").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("m")
    share = below / F.sum("m").over(W.partitionBy("lang"))
    nth = sum((share >= s).cast("int") for s in p.shares[:-1]) if len(p.shares) > 1 else F.lit(0)
    rounds = mass.select("lang", "f", nth.alias("round"))
    words = stage(frequent.join(rounds, ["lang", "f"]).join(totals, "lang").select(
        "id", "lang", "word", "f", "n", "round", F.expr("(cast(1000 AS decimal(38,0)) * n) div f").alias("bound")), "phrase-frequent")
    corpus = stage(as_ids(docs, bits_of(words, "id"), attempt), "phrase-corpus")

    best = None
    for nth in range(len(p.shares)):
        frontier, settled = words.filter(F.col("round") == nth), None
        if best is not None:
            settled = (best.groupBy("lang").agg(F.count(F.lit(1)).alias("k"), F.min("score").alias("last"))
                       .filter(F.col("k") >= p.top).select("lang", "last"))
            frontier = frontier.join(settled, "lang", "left").filter("last IS NULL OR bound >= last").drop("last")
        cands = grown(stage(frontier, "phrase-frontier"), corpus, p)
        if cands is None:
            continue
        if settled is not None:
            # The cut before the last word is known already; no other gives a higher score.
            known = F.expr("(cast(1000 AS decimal(38,0)) * a * n) div (cast(element_at(ls, -1) AS decimal(38,0)) * last_f)")
            cands = (cands.join(words.select(F.col("id").alias("w"), F.col("f").alias("last_f")), "w").join(settled, "lang", "left")
                     .filter(F.col("last").isNull() | (known >= F.col("last"))).drop("last", "last_f"))
            cands = stage(cands, "phrase-candidates")
        new = scored(cands, words, corpus, p)
        # Ties at the end stay until phrases are spelled out.
        both = new if best is None else best.unionByName(new)
        last = F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
        best = stage(both.withColumn("rank", last).filter(F.col("rank") <= p.top).drop("rank"), "phrase-best")
    if best is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    spelled = (best.select("lang", "ws", F.posexplode("ws").alias("at", "id")).join(words.select("id", "word"), "id")
               .groupBy("lang", "ws").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("s"))
               .select("lang", "ws", F.array_join(F.transform("s", lambda x: x["word"]), " ").alias("phrase")))
    out = _ordered(best.join(spelled, ["lang", "ws"]), p, F.asc("phrase"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
