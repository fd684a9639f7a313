"""Token counts of a byte-level BPE tokenizer by a two-tier lookup on the map side.

A text is cut into pre-tokens; their token counts add up. The first tier is a compact table of the
pre-tokens that the tokenizer itself ranks as frequent: those of its vocabulary entries that are
pre-tokens, with the count the library gives each. Its size is bounded by the vocabulary, it needs
no pass over the corpus and is the same for every input; it is sent to the workers once. What it
misses is encoded by the library's model in the worker and remembered there (a bounded number).
Nothing but the input's rows moves: there is no shuffle.

The fast cut knows ASCII, Latin letters and common punctuation. Texts with other characters, or
with a special string of the tokenizer, go to the library whole, so counts are always its own.

Defined cases: a null text counts as empty; very long pre-tokens are encoded but not remembered; rows
that repeat an id give a row each; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from touchline.llm.texts import encoded, map_rows, picked

#: Missed pre-tokens a worker remembers for good, further ones it forgets together, longest one kept.
STEADY, FRESH, LONGEST = 350_000, 150_000, 48
#: The library's pattern over the characters that ``_OTHER`` leaves.
_PRE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f\\u00a1\\u00bf\\u00ab\\u00bb\\u2013\\u2014\\u2018\\u2019\\u201c\\u201d\\u2026]")


def byte_letters() -> dict[int, int]:
    """Code point that stands for each byte in the vocabulary: itself if it prints, else 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: b for b in prints} | {b: 256 + n for n, b in enumerate(rest)}


def frequent_lengths(tokenizer_path: str) -> tuple[bytes, bytes]:
    """First tier: pre-tokens joined by NUL, and one byte for each one's token count."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path)
    back = {v: k for k, v in byte_letters().items()}
    entries = []
    for entry in tok.get_vocab(with_added_tokens=False):
        try:
            text = bytes(back[ord(c)] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if "\0" not in text and _PRE.fullmatch(text) and not _OTHER.search(text):
            entries.append(text)
    entries.sort()
    counts = bytes(min(255, len(e.ids)) for e in tok.encode_batch(entries, add_special_tokens=False))
    return "\0".join(entries).encode("utf-8"), counts


class _Lengths(dict):
    """Token counts by pre-token; misses are encoded and remembered."""

    def __init__(self, tokenizer, first: tuple[bytes, bytes]):
        super().__init__(zip(first[0].decode("utf-8").split("\0"), first[1]))
        self.tokenize = tokenizer.model.tokenize
        self.letters = byte_letters()
        self.fresh: list[str] = []
        self.limit = len(self) + STEADY

    def __missing__(self, pre: str) -> int:
        n = len(self.tokenize(pre.encode("utf-8").decode("latin-1").translate(self.letters)))
        if len(pre) <= LONGEST:
            if len(self) >= self.limit:
                if len(self.fresh) >= FRESH:
                    for old in self.fresh:
                        del self[old]
                    self.fresh = []
                self.fresh.append(pre)
            self[pre] = n
        return n


class Counter:
    def __init__(self, tokenizer_path: str, first: tuple[bytes, bytes]):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.lengths = _Lengths(self.tok, first)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def count(self, text: str) -> int:
        if _OTHER.search(text) or (self.special and self.special.search(text)):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        return sum(map(self.lengths.__getitem__, _PRE.findall(text)))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    ``tokenizer_path`` names a file that every executor has, as installed with the tokenizer.
    """
    first = docs.sparkSession.sparkContext.broadcast(frequent_lengths(tokenizer_path))

    def rows(it):
        counter = Counter(tokenizer_path, first.value)
        for key, text in it:
            n = counter.count(text) if text else 0
            yield key, len(encoded(text)) if text else 0, n, n > limit

    return map_rows(picked(docs, doc_id=id_col, text=text_col), rows,
                    "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
