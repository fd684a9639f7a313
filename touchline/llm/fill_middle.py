"""Fill-in-middle transformation by secondary sort.

Each text is cut at two drawn places into prefix, middle and suffix. The map side emits *pieces*, runs of
at most ``piece`` code points keyed by document and by their place in the output (the mark of a part
travels with its first piece), in the order of the text. Pieces are dealt out by document and sorted by
output place inside each partition (``repartition`` and ``sortWithinPartitions``, the DataFrame form of
``repartitionAndSortWithinPartitions``: the shuffled rows are sorted and spilled in the JVM), so a task
streams every output in order into an incremental digest and holds one piece at a time. The same stream is
read back: the marks found in the output give the parts, whose pieces are sorted again inside the partition
by their place in the text, without another exchange, and streamed into the digest of the restored text.

Draws depend on the id alone, so a lost task makes the same cuts again. Forms: ``plain`` (the text),
``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) and ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle).
A text that holds a mark stays plain, so the first mark of a kind in an output is always the inserted one.

Defined cases: a null text is empty; an empty text is plain, and so is a row with a null id (nothing to draw
from). Rows that repeat id and text give one row each; rows that repeat an id with other texts are transformed
each, with the draw of the id. A text of any length is cut into pieces; only the map task that reads
it holds it whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

from pyspark import TaskContext
from pyspark.sql import DataFrame

from touchline.llm.texts import encoded, map_rows, picked

MARKS = ("<P>", "<S>", "<M>")
#: Parts of a form in the order of the output, as (mark, place of the part in the text).
ORDERS = {"plain": (("", 0),), "psm": (("<P>", 0), ("<S>", 2), ("<M>", 1)), "spm": (("<S>", 2), ("<P>", 0), ("<M>", 1))}


@dataclass(frozen=True)
class FimParams:
    #: Percent of texts that are transformed, percent of those in suffix-first order, code points of a piece.
    rate: int = 90
    suffix_first: int = 20
    piece: int = 4096


def drawn(doc_id: int | None, text: str, p: FimParams = FimParams()) -> tuple[str, int, int]:
    """Form of a text, and where its prefix and its middle end (0 and the length if plain)."""
    if doc_id is None or not text or any(m in text for m in MARKS):
        return "plain", 0, len(text)
    digest = sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[i: i + 8], 16) for i in range(0, 32, 8)]
    if h[2] % 100 >= p.rate:
        return "plain", 0, len(text)
    low, high = sorted(x % (len(text) + 1) for x in h[:2])
    return "spm" if h[3] % 100 < p.suffix_first else "psm", low, high


def pieces(docs: DataFrame, p: FimParams = FimParams()) -> DataFrame:
    """``key, doc_id, form, place, chunk``: the pieces of every row's output.

    ``key`` names a text of an id, as met in one map task: equal rows of a task share it, equal rows of
    several tasks are spread.
    """
    def rows(it):
        task = TaskContext.get().partitionId()
        for doc_id, text in it:
            text = text or ""
            form, low, high = drawn(doc_id, text, p)
            key = blake2b(encoded(f"{task}:{doc_id}:{text}"), digest_size=16).digest()
            parts = ((0, low), (low, high), (high, len(text))) if form != "plain" else ((0, len(text)),)
            place, starts = 0, {}
            for mark, part in ORDERS[form]:
                starts[part] = place, mark
                place += len(mark) + parts[part][1] - parts[part][0]
            for part, (start, end) in enumerate(parts):
                place, mark = starts[part]
                for at in range(start, max(end, start + 1), p.piece):
                    chunk = mark + text[at: min(at + p.piece, end)]
                    yield key, doc_id, form, place, chunk
                    place, mark = place + len(chunk), ""

    return map_rows(picked(docs, doc_id="doc_id", text="text"), rows,
                    "key binary, doc_id long, form string, place long, chunk string", size=2048)


def _parts(form: str, chunks: Iterator[str]) -> Iterator[tuple[int, int, str]]:
    """(part, place in it, run of text) found in an output that arrives in chunks, by its marks alone."""
    order = [(m, part) for m, part in ORDERS[form] if m]
    part, at, held = 0, 0, ""
    for chunk in chunks:
        held += chunk
        while order and (found := held.find(order[0][0])) >= 0:
            if found:
                yield part, at, held[:found]
            held = held[found + len(order[0][0]):]
            part, at = order.pop(0)[1], 0
        sure = max(0, len(held) - 2) if order else len(held)  # a mark may still begin in the rest
        if sure:
            yield part, at, held[:sure]
            at, held = at + sure, held[sure:]
    if held:
        yield part, at, held


def _runs(it):
    """(key, iterator of its rows) of sorted rows; a run is read to its end before the next one."""
    row = next(it, None)
    while row is not None:
        key = row[0]

        def run():
            nonlocal row
            while row is not None and row[0] == key:
                yield row
                row = next(it, None)

        yield key, run()


_HEAD = "copies int, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"


def outputs(parts: DataFrame) -> DataFrame:
    """Pieces of the text found in every output (``part`` 0 to 2), and a head row (``part`` -1) with its digest.

    ``parts`` lie sorted by output place within partitions; the rows stay in their partitions.
    """
    def rows(it):
        for key, run in _runs(it):
            digest, copies, last, who = sha256(), 0, -1, []

            def chunks():
                nonlocal copies, last
                for _, doc_id, form, place, chunk in run:
                    copies += place == 0
                    if place == last:  # the same piece of an equal row
                        continue
                    last = place
                    if not who:
                        who.extend((doc_id, form))
                    digest.update(encoded(chunk))
                    yield chunk

            stream = chunks()
            first = next(stream)
            doc_id, form = who

            def again():
                yield first
                yield from stream

            sizes = [0, 0, 0]
            for part, at, text in _parts(form, again()):
                sizes[part] += len(text)
                yield key, doc_id, part, at, text, None, None, None, None, None, None
            cut = form != "plain"
            yield (key, doc_id, -1, 0, None, copies, sum(sizes), form, sizes[0] if cut else None,
                   sizes[1] if cut else None, digest.hexdigest())

    return map_rows(parts, rows, f"key binary, doc_id long, part int, at long, chunk string, {_HEAD}", size=2048)


def restored(found: DataFrame) -> DataFrame:
    """One row per row of the input from the sorted pieces of its text."""
    def rows(it):
        for _, run in _runs(it):
            _, doc_id, _, _, _, copies, n, form, prefix, middle, output = next(run)
            digest = sha256()
            for row in run:
                digest.update(encoded(row[4]))
            for _ in range(copies):
                yield doc_id, n, form, prefix, middle, output, digest.hexdigest()

    return map_rows(found, rows, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                                 "output_sha256 string, restored_sha256 string")


def fill_in_middle(docs: DataFrame, p: FimParams = FimParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every row."""
    sent = pieces(picked(docs, doc_id=id_col, text=text_col), p)
    found = outputs(sent.repartition("key").sortWithinPartitions("key", "place"))
    return restored(found.sortWithinPartitions("key", "part", "at"))


def transformed(docs: DataFrame, p: FimParams = FimParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, doc_id, form, place, chunk``: the outputs themselves, as the runs that make them up.

    Outputs stay in pieces, so a text of any length passes through rows of bounded size. The rows of a key lie
    together, in order; an equal row of the input doubles them.
    """
    return pieces(picked(docs, doc_id=id_col, text=text_col), p).repartition("key").sortWithinPartitions("key", "place")
