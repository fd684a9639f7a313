"""Text helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encoded(text: str) -> bytes:
    """UTF-8 bytes of a text (lone surrogates, which Spark never yields, would pass through)."""
    return text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; ``bytes`` methods know ASCII alone."""
    return encoded(text).lower().split() if text else []


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, so columns with clashing names in ``df`` cannot interfere."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Each drops what a worker keeps for further tasks of one kind; called when a task of another kind begins.
KEPT: list[Callable[[], None]] = []


def drop_kept() -> None:
    for drop in KEPT:
        drop()


def give_back() -> None:
    """Returns to the system what a task has freed: a worker lives on and would hold it beside the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def map_rows(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str, size: int = 4096, read: int | None = None,
             keeps: bool = False) -> DataFrame:
    """``rows`` gets an iterator over the tuples of a partition and yields output tuples.

    Columns travel as Arrow batches; output is flushed every ``size`` rows. At most ``read`` rows of a batch become
    Python objects at a time (all, if None). ``keeps``: the rows' own kind of task uses what ``KEPT`` would drop.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        if not keeps:
            drop_kept()
        arrow = to_arrow_schema(fields)
        n = len(arrow)

        def tuples():
            for batch in batches:
                for at in range(0, batch.num_rows, read or max(1, batch.num_rows)):
                    yield from zip(*[c.to_pylist() for c in batch.slice(at, read).columns])

        block: list[tuple] = []
        for row in rows(tuples()):
            block.append(row)
            if len(block) >= size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in block], type=arrow.field(j).type) for j in range(n)], schema=arrow)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in block], type=arrow.field(j).type) for j in range(n)], schema=arrow)
        row = block = None
        give_back()

    return df.mapInArrow(run, fields)


def sha256_of(joined: Column) -> Column:
    return F.sha2(F.coalesce(joined, F.lit("")), 256)
