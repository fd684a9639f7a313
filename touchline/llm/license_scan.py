"""Licence scans: exact phrases, and a fuzzy search for short notices.

The base places are where the words of a phrase stand one after the other. The fuzzy search takes
every notice of ``NOTICES`` with up to one edit per ``LETTERS_PER_EDIT`` characters: the notice is
split into (edits + 1) pieces, one of which must occur unchanged in any match (pigeonhole); one
automaton finds the pieces of all notices, and around each hit the regex library's matching with
bounded errors verifies the edits and gives the span. Text between words does not count: both
sides are lower-cased words joined by single blanks. A span starts and ends with whole words. Each hit is verified in
a window of its own, as long as a notice with its edits may be, so the time is in proportion to the hits; of overlapping
spans of a notice the one with fewer edits stays (then the earlier one), and what is left of a window is searched again.

Defined cases: a null text counts as empty; rows
that repeat an id give a row each; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame

from touchline.llm.texts import encoded, map_rows, picked

LETTERS_PER_EDIT = 10
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "this work is licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under a creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license version 2 0": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

#: Everything in ASCII that is no letter or digit becomes a blank, A-Z lower case.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return encoded(text).translate(_TABLE).split() if text else []


def phrase_places(padded: bytes, phrase: bytes) -> list[int]:
    """Word numbers where a phrase starts; ``padded``: words joined and enclosed by blanks."""
    out, at, word, last = [], padded.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += padded.count(b" ", last, at)
        last = at
        out.append(word)
        at = padded.find(b" " + phrase + b" ", at + 1)
    return out


class NoticeFinder:
    """The automaton and the patterns, in one worker."""

    def __init__(self, notices: dict[str, str] = NOTICES, letters_per_edit: int = LETTERS_PER_EDIT):
        import ahocorasick
        import regex

        self.notices, self.seeds = [], ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, label) in enumerate(notices.items()):
            edits = len(notice) // letters_per_edit
            cuts = [len(notice) * x // (edits + 1) for x in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(notice[a:b], []).append((n, a))
            pattern = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice, special_only=True)}){{e<={edits}}}(?![^ ])")
            self.notices.append((label, len(notice), edits, pattern))
        for piece, places in pieces.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """``start, end, label, edits, similarity`` of the notices in a word-joined text."""
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (size, places) in self.seeds.iter(text):
            for n, offset in places:
                _, length, edits, _ = self.notices[n]
                at = end + 1 - size - offset
                windows.setdefault(n, set()).add((max(0, at - edits), min(len(text), at + length + edits)))
        out = []
        for n, found in windows.items():
            label, length, _, _ = self.notices[n]
            out += [(a, b, label, edits, 1 - edits / length) for a, b, edits in self._settled(n, text, found)]
        return sorted(out)

    def _settled(self, n: int, text: str, windows: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Spans of a notice that do not overlap: best first, the rest of a window searched again."""
        _, length, edits, pattern = self.notices[n]
        heap: list[tuple[int, int, int, int, int]] = []

        def search(a: int, b: int) -> None:
            # Only whole words of the window can be part of a span.
            if a and text[a - 1] != " ":
                a = text.find(" ", a, b) + 1 or b
            if b < len(text) and text[b] != " ":
                b = max(a, text.rfind(" ", a, b))
            if b - a >= length - edits and (m := pattern.search(text, a, b)):
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for window in windows:
            search(*window)
        kept: list[tuple[int, int, int]] = []
        while heap:
            n_edits, start, end, a, b = heapq.heappop(heap)
            at = bisect.bisect_left(kept, (end,))
            if at and kept[at - 1][1] > start:  # taken by a better span: what lies before and after it
                taken = kept[at - 1]
                search(a, min(b, taken[0]))
                search(max(a, taken[1]), b)
            else:
                kept.insert(at, (start, end, n_edits))
                search(a, start)
                search(end, b)
        return kept


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``spans``:
    fuzzy notices as array of ``word, n_words, label, edits`` (word: number of the first word)."""

    def rows(it):
        finder = NoticeFinder(notices)
        phrases = [(p.encode(), label) for p, label in PHRASES.items()]
        for key, text in it:
            words = words_of(text)
            joined = b" ".join(words)
            padded = b" " + joined + b" "
            base = [(at, label) for p, label in phrases for at in phrase_places(padded, p)]
            plain = joined.decode("utf-8", "replace")
            fuzzy = finder.find(plain)
            starts = [at for at, _ in base]
            own = {label for _, label in base}
            spans = [{"word": plain.count(" ", 0, a), "n_words": plain.count(" ", a, b) + 1, "label": label, "edits": edits}
                     for a, b, label, edits, _ in fuzzy]
            score = 1.0 if base else max((f[4] for f in fuzzy), default=0.0)
            yield (key, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
                   ",".join(sorted(own | {f[2] for f in fuzzy})), score, spans)

    return map_rows(picked(docs, doc_id=id_col, text=text_col), rows,
                    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                    "score double, spans array<struct<word:int,n_words:int,label:string,edits:int>>")
