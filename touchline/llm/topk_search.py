"""Exact top-k inner-product search: exhaustive term-at-a-time accumulation.

Vectors are quantised to integers. Candidates are dealt into blocks; a block is inverted once:
per component (term) a postings list of the candidates with a non-zero weight there. Queries come
in blocks too, as sparse rows. For each term of a query block, its weights are scattered over the
postings into a dense score array; when all terms are done, the array holds every exact score, a
partition selection keeps the k best of the block, and the blocks' results are merged by rank.

Every pair of a candidate block and a query block is a task of bounded memory. The work is
queries times candidates; what moves is each side once per block of the other, plus k rows per
query and candidate block.

Defined cases: vectors that are null, or hold null or non-finite components, or whose id is null take
no part; an empty vector scores 0 everywhere; vectors of different lengths meet on their common
components; ties go to the smaller id; a repeated query id is asked once, with its smallest
vector; repeated candidate ids are candidates each. Scores are 64-bit; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.texts import picked
from touchline.operators.common import top_per

#: Candidates of a block, queries of a block, and queries whose scores are held at a time (int64 each).
CANDIDATES, QUERY_BLOCK, QUERIES = 8_192, 8_192, 64


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: floor(scale * x) of usable vectors."""
    df = picked(vectors, vec_id=id_col, v=vec_col)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    v = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return df.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        "vec_id", v.alias("v"))


def _matrix(vectors) -> np.ndarray:
    rows = [np.asarray(v, np.int64) for v in vectors]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for n, r in enumerate(rows):
        out[n, : len(r)] = r
    return out


class Postings:
    """A candidate block, inverted."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, weights = ids[order], weights[order]
        self.lists = []
        for term in range(weights.shape[1]):
            at = np.flatnonzero(weights[:, term])
            # A list that holds most candidates is added as a whole row.
            self.lists.append((None, weights[:, term].copy()) if 2 * len(at) > len(ids) else (at, weights[at, term]))

    def scores(self, queries: np.ndarray) -> np.ndarray:
        out = np.zeros((len(queries), len(self.ids)), np.int64)
        for term in range(min(queries.shape[1], len(self.lists))):
            at, weights = self.lists[term]
            for q in np.flatnonzero(queries[:, term]):
                if at is None:
                    out[q] += queries[q, term] * weights
                elif len(at):
                    out[q, at] += queries[q, term] * weights
        return out

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """``query_id, vec_id, score`` of the k best candidates of each query in this block."""
        for at in range(0, len(queries), QUERIES):
            scores = self.scores(queries[at: at + QUERIES])
            for key, row in zip(query_ids[at: at + QUERIES].tolist(), scores):
                own = self.ids == key
                where = np.flatnonzero(~own) if own.any() else None
                values = row if where is None else row[where]
                if len(values) > k:
                    least = np.partition(values, len(values) - k)[len(values) - k]
                    over = np.flatnonzero(values > least)
                    pick = np.concatenate([over, np.flatnonzero(values == least)[: k - len(over)]])
                else:
                    pick = np.arange(len(values))
                chosen = pick if where is None else where[pick]
                yield from ((key, v, s) for v, s in zip(self.ids[chosen].tolist(), row[chosen].tolist()))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, per_block: int = CANDIDATES,
          per_query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``; both inputs as ``quantised`` gives them."""
    import pandas as pd

    blocks = max(1, -(-vectors.count() // per_block))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    query_blocks = max(1, -(-asked.count() // per_query_block))

    def dealt(n: int, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    to_all = asked.select(every(blocks).alias("c"), dealt(query_blocks, "vec_id").alias("q"), "vec_id", "v")
    # Rows that repeat an id do not pile up: the vector is part of the hash.
    held = vectors.select(dealt(blocks, "vec_id", "v").alias("c"), every(query_blocks).alias("q"), "vec_id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        index = Postings(left["vec_id"].to_numpy(np.int64), _matrix(left["v"]))
        found = list(index.best(right["vec_id"].to_numpy(np.int64), _matrix(right["v"]), k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    part = (held.groupBy("c", "q").cogroup(to_all.groupBy("c", "q"))
            .applyInPandas(search, "query_id long, vec_id long, score long"))
    return (top_per(part, ["query_id"], [F.desc("score"), F.asc("vec_id")], k, "rank")
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
