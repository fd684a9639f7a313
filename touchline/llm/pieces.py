"""SentencePiece models on the tokenizers library: encoding, decoding, parity.

``read_model`` parses the model protobuf; ``build_tokenizer`` rebuilds it as a tokenizers
pipeline: normaliser (precompiled map, extra blanks), the ``\\u2581`` marker with its dummy prefix,
unigram scores or the merges that BPE scores imply, byte fallback and the matching decoder.

No piece holds the marker after another character, so no piece crosses from a character to a
marker: a text is cut there into *units* (markers, then a word) that are encoded alone. A worker
encodes units it has not met in multithreaded batches and remembers them; ``parity`` says that
the sentencepiece library gives the same ids for every unit of a document. A model with pieces
that do cross is encoded in whole texts. Runs of markers have equal scores, where SentencePiece
takes the leftmost pair; merge ranks cannot tie, so runs come from a table made by that rule.

Defined cases: a null text has null ids and no tokens, an empty one an empty list; text that holds
the marker itself decodes to a blank there; ids outside the vocabulary and null ids are an error in
decoding; other columns are ignored or, in ``with_decoded``, kept.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame

from touchline.llm.texts import KEPT, map_rows, picked

MARK = "▁"
#: Units that one worker remembers for good, and further ones that it forgets together.
STEADY_UNITS, FRESH_UNITS = 350_000, 150_000
#: Units (or texts) per library call.
BATCH = 4096
#: Texts that one worker has as Python objects at a time, besides a block's.
READ_ROWS = 512
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_blanks: bool = True
    escape_blanks: bool = True

    @property
    def unk_id(self) -> int:
        return next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)


def _fields(data: bytes):
    """Field number and value of a protobuf message: int, 4 or 8 raw bytes, or bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        wire = key & 7
        if wire == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or (varint() if wire == 2 else -1)
            if size < 0 or at + size > end:
                raise ValueError("not a SentencePiece model")
            value = data[at: at + size]
            at += size
        yield key >> 3, value


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return parse_model(f.read())


def parse_model(data: bytes) -> PieceModel:
    m = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 24 and v:
                    raise ValueError("markers as suffixes are not supported")
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.trim_blanks = bool(v)
                elif n == 5:
                    m.escape_blanks = bool(v)
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return m


def implied_merges(m: PieceModel) -> list[tuple[str, str]]:
    """Merges of a BPE model: any two pieces whose joint text is a piece, best score first."""
    scores = {text: score for text, score, kind in m.pieces if kind in (NORMAL, USER)}
    found = []
    for text, score in scores.items():
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in scores and right in scores and set(text) != {MARK}:
                found.append((-score, cut, left, right))
    found.sort(key=lambda x: x[:2])
    return [(left, right) for _, _, left, right in found]


def build_tokenizer(m: PieceModel):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    vocab = {text: i for i, (text, _, _) in enumerate(m.pieces)}
    unk = m.pieces[m.unk_id][0]
    if m.kind == UNIGRAM:
        model = models.Unigram([(t, s) for t, s, _ in m.pieces], m.unk_id, m.byte_fallback)
    else:
        model = models.BPE(vocab, implied_merges(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
    tok = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.trim_blanks:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_blanks else " "))
    if m.escape_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    after = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if m.dummy_prefix:
        after.append(decoders.Strip(" ", 1, 0))
    tok.decoder = decoders.Sequence(after)
    return tok


def _run_table(m: PieceModel) -> dict[int, list[int]]:
    """Piece lengths of a run of n markers, leftmost pair first; grows on demand in ``_runs``."""
    return {len(t): i for i, (t, _, k) in enumerate(m.pieces) if t and set(t) == {MARK} and k in (NORMAL, USER)}


def _runs(n: int, known: dict[int, int]) -> list[int]:
    parts = [1] * n
    at = 0
    while at + 1 < len(parts):
        if parts[at] + parts[at + 1] in known:
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
            at = 0
        else:
            at += 1
    return [known[x] for x in parts]


class Codec:
    """Encoder and decoder of one model in one worker.

    ``encode(texts)`` gives ids per text (None for None); ``parity(texts)`` whether all units met in
    a text agree with the sentencepiece library.
    """

    def __init__(self, path: str, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        import sentencepiece

        self.model = read_model(path)
        self.tok = build_tokenizer(self.model)
        self.known = _run_table(self.model)
        self.ints = list(range(len(self.model.pieces)))
        self.by_unit = (all(MARK not in t.lstrip(MARK) for t, _, _ in self.model.pieces) and self.model.escape_blanks
                        and self.model.dummy_prefix and not self.model.trim_blanks and not self.model.charsmap
                        and 1 in self.known)
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.words: dict[str, tuple] = {"": ()}
        self.fresh: list[str] = []
        self.odd: set[str] = set()
        self.bytes = [self._bytes_of(text, kind) for text, _, kind in self.model.pieces]

    def _bytes_of(self, text: str, kind: int) -> bytes:
        """What the decoder's steps make of one piece inside a text."""
        if kind == BYTE and self.model.byte_fallback:
            return bytes([int(text[3:-1], 16)])
        return text.replace(MARK, " ").encode("utf-8")

    def _make_room(self) -> None:
        if len(self.words) > STEADY_UNITS + FRESH_UNITS:
            for w in self.fresh:
                del self.words[w]
            self.odd.difference_update(self.fresh)
            self.fresh = []

    def _learn(self, words: list[str]) -> None:
        """Encodes single words (a marker stands before each) that are not known yet."""
        for at in range(0, len(words), BATCH):
            part = words[at: at + BATCH]
            other = self.other.encode(part, num_threads=1)
            if len(self.words) >= STEADY_UNITS:
                self.fresh += part
            for word, found, theirs in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), other):
                ids = found.ids
                if ids != theirs:
                    self.odd.add(word)
                self.words[word] = tuple(map(self.ints.__getitem__, ids))

    def _with_run(self, blanks: int, ids: tuple) -> list[int]:
        """A word after more than one marker: the last marker is the word's if a merge took it."""
        if ids and ids[0] == self.known[1]:
            return [*_runs(blanks, self.known), *ids[1:]]
        return [*_runs(blanks - 1, self.known), *ids]

    def encode(self, texts: list[str | None]) -> tuple[list[list[int] | None], list[bool | None]]:
        if not self.by_unit:
            given = [t for t in texts if t is not None]
            ours = iter([e.ids for e in self.tok.encode_batch_fast(given, add_special_tokens=False)])
            theirs = iter(self.other.encode(given, num_threads=1))
            ids = [None if t is None else next(ours) for t in texts]
            return ids, [None if t is None else i == next(theirs) for t, i in zip(texts, ids)]
        parts = [None if t is None else t.replace(" ", MARK).split(MARK) if t else [] for t in texts]
        self._make_room()
        get = self.words.get
        found = [None if p is None else list(map(get, p)) for p in parts]
        short = [k for k, f in enumerate(found) if f and None in f]
        if short:
            self._learn(list({w for k in short for w, ids in zip(parts[k], found[k]) if ids is None}))
            for k in short:
                found[k] = list(map(get, parts[k]))
        out, agree = [], []
        for p, f in zip(parts, found):
            if p is None:
                out.append(None)
                agree.append(None)
                continue
            if "" not in p:
                ids = list(chain.from_iterable(f))
            else:
                ids, blanks = [], 0
                for w, got in zip(p, f):
                    blanks += 1
                    if w:
                        ids.extend(self._with_run(blanks, got) if blanks > 1 else got)
                        blanks = 0
                ids.extend(_runs(blanks, self.known))
            out.append(ids)
            agree.append(not self.odd or self.odd.isdisjoint(p))
        return out, agree

    def decode(self, lists: list[list[int] | None]) -> list[str | None]:
        """Texts of id lists: each piece's bytes joined; the library's decoder where they are no UTF-8."""
        top, table, out = len(self.ints), self.bytes, []
        for ids in lists:
            if ids is None:
                out.append(None)
                continue
            if ids and (None in ids or max(ids) >= top or min(ids) < 0):
                raise ValueError("an id is null or outside the vocabulary")
            joined = b"".join(map(table.__getitem__, ids))
            try:
                text = joined.decode("utf-8")
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.tok.decode(ids, skip_special_tokens=False))
        return out


@lru_cache(maxsize=1)
def _built(path: str, threads: int, state: tuple[int, int]) -> Codec:
    return Codec(path, threads)


KEPT.append(lambda: _built.cache_clear())


def worker_codec(path: str, threads: int = 2) -> Codec:
    """The one codec of a worker, built and taught by its first task and kept for the next ones while the file stays the same."""
    at = os.stat(path)
    return _built(path, threads, (at.st_mtime_ns, at.st_size))


def _texts_of(it, chars: int = 2_000_000, rows: int = 2048):
    block, held = [], 0
    for row in it:
        block.append(row)
        held += len(row[1] or "")
        if held >= chars or len(block) >= rows:
            yield block
            block, held = [], 0
    if block:
        yield block


def encoded_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                   threads: int = 2, position_col: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, parity, round_trip`` of every text, whole, in the order of the rows.

    ``round_trip``: decoding the ids gives the text again, markers read as blanks. ``position_col`` is kept as ``position``.
    """

    def rows(it):
        codec = worker_codec(model_path, threads)
        for block in _texts_of(it):
            texts = [r[1] for r in block]
            ids, agree = codec.encode(texts)
            back = codec.decode(ids)
            for (key, text, *at), i, same, b in zip(block, ids, agree, back):
                yield (key, len(i), i, same, b == text.replace(MARK, " "), *at) if text is not None else (key, 0, None, None, None, *at)

    position = {"position": position_col} if position_col else {}
    return map_rows(picked(docs, doc_id=id_col, text=text_col, **position), rows,
                    "doc_id long, n_tokens long, ids array<int>, parity boolean, round_trip boolean" + ", position long" * bool(position),
                    size=256, read=READ_ROWS, keeps=True)


def decoded_texts(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids",
                  threads: int = 2) -> DataFrame:
    """``doc_id, text`` of id lists."""

    def rows(it):
        codec = worker_codec(model_path, threads)
        for block in _texts_of(it):
            yield from zip([k for k, _ in block], codec.decode([i for _, i in block]))

    return map_rows(picked(encoded, doc_id=id_col, ids=ids_col), rows, "doc_id long, text string", size=256, keeps=True)
