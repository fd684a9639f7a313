"""Repeated passages: unit hashes grouped over the whole corpus.

Texts are cut into units: lines, and for ``unit="sentence"`` lines cut again after sentence ends, so a
passage is also found inside a longer line. A unit is normalised (lower case, single blanks)
and hashed to 128 bits. Digests are grouped over all documents with map-side combine, so a line
that a third of the documents hold arrives as one row per task. The earliest occurrence by
(document id, position) stays. Further ones are removed where a run of them holds ``min_run_words``
or more, so a short line that many documents share (a licence line) does not go; units too short
to be hashed belong to the run around them.

Offsets are code points of the original text, end exclusive.

Defined cases: null and empty texts have no units and stay as they are; rows with a null id take no
part and stay whole; a row is known by its id and a hash of its text, so rows that repeat an id with other texts lose
their own repeats alone (of them the one with the smaller hash is the earlier), and rows that repeat id and text are one and
keep what one would keep; other columns are ignored or kept by ``without_repeats``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.texts import encoded, map_rows, picked, spare

_CUTS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*"),
         "sentence": re.compile(r"\n|(?<=[.!?])[ \t]+")}


@dataclass(frozen=True)
class RepeatParams:
    unit: str = "sentence"
    min_unit_words: int = 4
    min_run_words: int = 25


def units(text: str, cut: re.Pattern):
    """``start, end, words`` of every unit that has a word."""
    start = 0
    for m in cut.finditer(text):
        if words := text[start: m.start()].lower().split():
            yield start, m.start(), words
        start = m.end()
    if words := text[start:].lower().split():
        yield start, len(text), words


def hashed_units(docs: DataFrame, p: RepeatParams) -> DataFrame:
    """``doc_id, h`` (hash of the text), ``at`` (number of the unit), ``digest`` of units long enough."""

    def rows(it):
        cut = _CUTS[p.unit]
        for key, h, text in it:
            for at, (_, _, words) in enumerate(units(text, cut)):
                if len(words) >= p.min_unit_words:
                    yield key, h, at, blake2b(encoded(" ".join(words)), digest_size=16).digest()

    return map_rows(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text"), "text"), rows,
                    "doc_id long, h long, at int, digest binary", size=65536)


def repeated_spans(docs: DataFrame, p: RepeatParams = RepeatParams(), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, text`` (what is left), ``removed``: array of ``start, end, n_words, kept_doc_id``.

    Only documents that lose something.
    """
    return _left(picked(docs, doc_id=id_col, text=text_col), p).drop("h")


def _left(docs: DataFrame, p: RepeatParams) -> DataFrame:
    """``repeated_spans`` with the hash ``h`` of the whole text."""
    found = hashed_units(docs, p)
    first = (found.groupBy("digest").agg(F.min(F.struct("doc_id", "h", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("digest", "first"))
    later = (found.join(first, "digest").filter(F.struct("doc_id", "h", "at") != F.col("first"))
             .groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", F.col("first.doc_id").alias("kept"))).alias("later")))

    def rows(it):
        cut = _CUTS[p.unit]
        for key, h, text, later in it:
            kept_in = {x["at"]: x["kept"] for x in later}
            runs, run, held = [], [], 0

            def close():
                nonlocal run, held
                while run and run[-1][3] is None:  # short units at the end of a run are not part of it
                    held -= run.pop()[2]
                if run and held >= p.min_run_words:
                    runs.append((run[0][0], run[-1][1], held, min(x[3] for x in run if x[3] is not None)))
                run, held = [], 0

            for at, (start, end, words) in enumerate(units(text, cut)):
                kept = kept_in.get(at)
                if kept is None and (len(words) >= p.min_unit_words or not run):
                    close()
                else:
                    run.append((start, end, len(words), kept))
                    held += len(words)
            close()
            if runs:
                left, last = [], 0
                for start, end, _, _ in runs:
                    left.append(text[last:start])
                    last = end
                left.append(text[last:])
                yield key, h, "".join(left), [dict(zip(("start", "end", "n_words", "kept_doc_id"), r)) for r in runs]

    hashed = docs.filter("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    return map_rows(hashed.join(later, ["doc_id", "h"]).select("doc_id", "h", "text", "later"), rows,
                    "doc_id long, h long, text string, removed array<struct<start:long,end:long,n_words:long,kept_doc_id:long>>",
                    size=512)


def without_repeats(docs: DataFrame, p: RepeatParams = RepeatParams(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` in their columns, with repeated passages taken out of the text."""
    key, hashed, text = spare(docs, "__id", "__h", "__text")
    left = _left(picked(docs, doc_id=id_col, text=text_col), p).select(F.col("doc_id").alias(key), F.col("h").alias(hashed), F.col("text").alias(text))
    left = left.dropDuplicates([key, hashed])
    out = docs.join(left, (docs[id_col] == left[key]) & (F.xxhash64(docs[text_col]) == left[hashed]), "left")
    return out.select(*[F.coalesce(left[text], docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])
