"""SimHash near-duplicates by an embedding of segment bit counts and a grid range join.

A text's fingerprint has a bit set where more than half of its shingle hashes (XXH64, seed 42) have it. Equal
fingerprints are one class from the start. A fingerprint is embedded as the *bit counts of its segments* of
``segment_bits`` bits. A differing bit moves one count by one at most, so the Manhattan distance of two
embeddings is never more than the number of differing bits: a lower bound that only far pairs exceed.

The range join over the embedding space runs on a grid. The segments are dealt to ``groups`` groups; of
two fingerprints within ``distance``, at least ``groups - distance`` groups have Manhattan distance zero. So each
fingerprint is posted to the unit cells of every choice of so many groups (35 for 7 groups and distance 4), and two
that are near meet in a cell. In a cell, pairs within the Manhattan bound are verified on all bits.

Cells never turn into all their pairs. A task reads its cells in key order as arrays; a small cell gives
the verified pairs, a larger one a spanning forest of its links (a member that is linked drops out of
further search), so a group of n near copies gives n - 1 links. A cell with more than ``tile`` members is cut into slices
by a hash, and each pair of slices is a tile of its own, so no pair is lost and no task holds a whole hot cell.
The answer is the connected components of all links.

The cells are exact at any size; their number of members grows with the table. With 7 groups of 2-bit
segments a cell of unrelated fingerprints holds one in 1.6 million, so about ten at 15 million documents; beyond a few
hundred million take ``groups=8`` (70 cells each of 24 bits), which finds the same pairs.

Defined cases: texts that are null or have no word have the fingerprint zero and are linked like any other;
rows that repeat an id are one document, linked if any of its fingerprints is; rows with a null id get their
fingerprint, no component (null) and link nothing; other columns are ignored. A text is hashed in blocks of
shingles, so memory grows with single texts alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.texts import lower_words, map_rows, picked
from touchline.operators.common import stage
from touchline.operators.linkage import link_components

#: Shingles that are hashed at a time, and the largest cell whose pairs are compared by shifting.
BLOCK, SMALL = 16_384, 12


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 4
    distance: int = 4
    segment_bits: int = 2
    groups: int = 7
    tile: int = 8192


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit fingerprint of a whole text; zero without words."""
    words = lower_words(text)
    if not words:
        return 0
    total = max(1, len(words) - width + 1)
    set_in = np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        part = words[at: min(at + BLOCK, total) + width - 1]
        joined = zip(*[part[i:] for i in range(width)]) if len(words) >= width else [words]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(s), 42) for s in joined], np.uint64)
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, p: SimHashParams) -> DataFrame:
    """``doc_id, fp`` (signed) of every row."""
    def rows(it):
        for key, text in it:
            fp = fingerprint(text, p.shingle)
            yield key, fp - (1 << 64) if fp >> 63 else fp

    return map_rows(docs, rows, "doc_id long, fp long", size=8192)


def bit_counts(fps: np.ndarray, width: int) -> np.ndarray:
    """Per fingerprint the number of set bits in each segment of ``width`` bits."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), 64 // width, width).sum(axis=2, dtype=np.uint8)


def ladder(counts: np.ndarray, width: int) -> np.ndarray:
    """A count c of each segment as its c lowest bits: these words differ in as many bits as the Manhattan distance of the counts."""
    steps = (np.uint64(1) << counts.astype(np.uint64)) - np.uint64(1)
    shifts = (np.arange(64 // width) * width).astype(np.uint64)
    return np.bitwise_or.reduce(steps << shifts, axis=1)


def near(counts_a, counts_b, fps_a, fps_b, distance: int) -> np.ndarray:
    """Which pairs are near: few enough bits differ, asked only where the bound by counts allows it."""
    ok = np.bitwise_count(counts_a ^ counts_b) <= distance
    if ok.any():
        at = np.flatnonzero(ok)
        a = fps_a if np.ndim(fps_a) == 0 else fps_a[at]
        ok[at] = np.bitwise_count(a ^ fps_b[at]) <= distance
    return ok


def posted(classes: DataFrame, p: SimHashParams) -> DataFrame:
    """``cell, fp``: every fingerprint in the cells of all choices of groups."""
    if 64 % p.segment_bits or p.groups <= p.distance:
        raise ValueError("segments must divide 64 bits, and groups be more than the distance")
    parts = np.array_split(np.arange(64 // p.segment_bits), p.groups)
    chosen = [np.concatenate(c) for c in combinations(parts, p.groups - p.distance)]
    base = p.segment_bits + 1
    scale = base ** max(len(c) for c in chosen)
    if scale * len(chosen) >= 1 << 63:
        raise ValueError("too many segments in a choice of groups")

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            counts = bit_counts(fps, p.segment_bits).astype(np.int64)
            for nth, segments in enumerate(chosen):
                cell = nth * scale + counts[:, segments] @ base ** np.arange(len(segments), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fps.view(np.int64))], ["cell", "fp"])

    return classes.select("fp").mapInArrow(run, "cell long, fp long")


def tiled(cells: DataFrame, p: SimHashParams) -> DataFrame:
    """``cell, tile, fp``: hot cells cut into slices, each member in the tiles of its slice with every slice."""
    hot = (cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > p.tile)
           .select("cell", F.ceil(F.col("n") / p.tile).cast("int").alias("k")))
    cut = cells.join(hot, "cell", "left").withColumn("s", F.pmod(F.xxhash64("fp"), F.coalesce("k", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))
    cut = cut.select("cell", "fp", "s", "k", other.alias("o"))
    tile = F.least("s", "o") * F.coalesce("k", F.lit(1)) + F.greatest("s", "o")
    return cut.select("cell", tile.alias("tile"), "fp")


def forest(fps: np.ndarray, counts: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all that the near pairs of a cell join, at most one fewer than members."""
    links, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            hit = near(counts[x], counts[rest], fps[x], fps[rest], distance)
            if hit.any():
                new = rest[hit]
                links.append((np.full(len(new), fps[x]), fps[new]))
                reached.extend(new.tolist())
                rest = rest[~hit]
    return links


def cell_links(cells: np.ndarray, fps: np.ndarray, p: SimHashParams) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole cells; ``cells`` numbers them in order."""
    counts = ladder(bit_counts(fps, p.segment_bits), p.segment_bits)
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, len(cells)])
    found = []
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        found += forest(fps[start: start + size], counts[start: start + size], p.distance)
    some = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    cells, fps, counts = cells[some], fps[some], counts[some]
    for off in range(1, SMALL):
        at = np.flatnonzero(cells[off:] == cells[:-off]) if len(cells) > off else []
        if not len(at):
            break
        hit = at[near(counts[at], counts[at + off], fps[at], fps[at + off], p.distance)]
        found.append((fps[hit], fps[hit + off]))
    if not found:
        return fps[:0], fps[:0]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def links(tiles: DataFrame, p: SimHashParams) -> DataFrame:
    """Verified links ``a, b`` of fingerprints whose components are those of all near pairs."""
    def run(batches):
        held = [np.empty(0, np.int64)] * 3
        for batch in _and_end(batches):
            if batch is not None:
                held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            if not len(held[0]):
                continue
            new = np.r_[True, (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])]
            end = len(new) if batch is None else int(np.flatnonzero(new)[-1])  # the last cell may go on
            if end:
                a, b = cell_links(np.cumsum(new[:end]), held[2][:end].astype(np.int64).view(np.uint64), p)
                if len(a):
                    a, b = a.view(np.int64), b.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                held = [h[end:] for h in held]

    return tiles.mapInArrow(run, "a long, b long").distinct()


def _and_end(batches):
    yield from batches
    yield None


def near_fingerprints(docs: DataFrame, p: SimHashParams = SimHashParams(), id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    rows = stage(fingerprints(picked(docs, doc_id=id_col, text=text_col), p), "simhash-rows")
    known = rows.filter("doc_id IS NOT NULL")
    classes = stage(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    tiles = tiled(posted(classes, p), p)
    close = links(tiles.repartition("cell", "tile").sortWithinPartitions("cell", "tile"), p)
    # An id with several fingerprints links them.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a != z")
    same = known.join(several.select("doc_id", "a"), "doc_id").filter("fp != a").select("a", F.col("fp").alias("b"))
    groups = link_components(close.unionByName(same))
    comp = (classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
            .withColumn("group", F.coalesce("component", "fp")))
    least = comp.groupBy("group").agg(F.min("rep").alias("component_id"))
    by_fp = comp.join(least, "group").select("fp", "component_id")
    out = rows.join(by_fp, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hexed(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, p: SimHashParams = SimHashParams(), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in their columns, that stay: the document with the smallest id of each group."""
    found = near_fingerprints(docs, p, id_col, text_col)
    lost = found.filter("doc_id != component_id").select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, docs[id_col] == lost["__lost"], "left_anti")
