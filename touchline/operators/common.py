"""Shared building blocks that keep hot groups out of a single task.

* ``top_per`` keeps the first k rows of a key; Spark limits each map task first.
* ``score_table`` ranks arbitrarily large groups by splitting them into value buckets.
* ``stage`` writes an intermediate table to the shared checkpoint folder.
* ``together`` runs the jobs of independent steps side by side.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own; a cluster
    session without it is an error, because executors could not see a local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def together(*steps: Callable[[], Any]) -> list[Any]:
    """Results of steps that need nothing of each other, whose jobs run side by side; the first error is raised.

    Fits of many short jobs leave most cores idle when they run one after the other.
    """
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(step)) for step in steps]]


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by ``cols`` into the session's number of shuffle partitions.

    For work whose cost is in computing rather than in bytes: an explicit number is not
    merged into a few tasks because the rows happen to be small.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def sliced_join(left: DataFrame, right: DataFrame, key: str, row_id: str, rows_per_slice: int = 20_000,
                keep_slice: bool = False, dealt: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """Equi-join on ``key`` that cuts a hot key of ``left`` into slices.

    A key with many left rows is split by the hash of ``row_id`` and its right rows are
    repeated once per slice, so no task joins more than about ``rows_per_slice`` left rows of
    one key. Other keys have one slice and are not repeated. The hot keys, which are few, are looked up
    first, so either side is dealt out once. ``keep_slice`` leaves the slice's number in
    ``__slice``: rows grouped by it and the key need no further exchange. ``dealt``: what is done to the two
    sides between dealing and joining, so that columns made there are not dealt.
    """
    slices = F.ceil(F.count(F.lit(1)) / rows_per_slice).cast("int")
    hot = stage(left.filter(F.col(key).isNotNull()).groupBy(key).agg(slices.alias("__slices")).filter("__slices > 1"), "hot-keys")
    n = F.coalesce("__slices", F.lit(1))
    cut = left.filter(F.col(key).isNotNull()).join(hot, key, "left").withColumn("__slice", F.pmod(F.xxhash64(row_id), n).cast("int")).drop("__slices")
    copies = right.filter(F.col(key).isNotNull()).join(hot, key, "left").withColumn("__slice", F.explode(F.sequence(F.lit(0), n - 1))).drop("__slices")
    sides = [spread(df, key, "__slice") for df in (cut, copies)]
    out = reduce(lambda a, b: a.join(b, [key, "__slice"]), [f(df) for f, df in zip(dealt, sides, strict=True)] if dealt else sides)
    return out if keep_slice else out.drop("__slice")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
            rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key in a total order; ``rank`` names an optional rank column."""
    name = rank or "__rank"
    window = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def score_table(df: DataFrame, part: Sequence[str], score: str,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact rank counts per distinct score: ``part, score, n_equal, n_less, n_total``.

    Rows are first counted per distinct score (with map-side combine), so ties cannot pile up
    in a task. A group with many distinct scores is cut into buckets at scores picked by a
    hash, about one in ``rows_per_bucket``: the pick depends on the value alone, so a re-run
    after a lost executor cuts at the same places. Each bucket is ordered on its own and
    offset by the totals of the buckets below it.
    """
    part = list(part)
    counts = (df.filter(F.col(score).isNotNull()).groupBy(*part, score)
              .agg(F.count(F.lit(1)).alias("n_equal")))
    picked = F.pmod(F.xxhash64(F.col(score)), F.lit(rows_per_bucket)) == 0
    # The picked scores number one in rows_per_bucket, so their array stays small.
    cuts = (counts.groupBy(*part).agg(
        F.array_sort(F.collect_set(F.when(picked, F.col(score)))).alias("__cuts"),
        F.sum("n_equal").alias("n_total")))
    bucketed = _join_null_safe(counts, cuts, part).withColumn(
        "__bucket", F.size(F.filter("__cuts", lambda b: b <= F.col(score)))).drop("__cuts")
    inside = W.partitionBy(*part, "__bucket").orderBy(score)
    local = bucketed.withColumn("__local", F.sum("n_equal").over(
        inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_equal"))
    sizes = bucketed.groupBy(*part, "__bucket").agg(F.sum("n_equal").alias("__n"))
    below = sizes.withColumn("__below", F.sum("__n").over(
        W.partitionBy(*part).orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
        - F.col("__n")).drop("__n")
    return (_join_null_safe(local, below, [*part, "__bucket"])
            .select(*part, score, "n_equal",
                    (F.col("__local") + F.col("__below")).alias("n_less"), "n_total"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be NULL (NULL joins NULL), keeping the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k)
                             for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def percent_rank(df: DataFrame, part: Sequence[str], score: str, *, percentile: str,
                 n_peers: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``100 * PERCENT_RANK`` and the group size on every row with a score."""
    table = score_table(df, part, score, rows_per_bucket)
    value = F.when(F.col("n_total") > 1,
                   F.lit(100.0) * (F.col("n_less") / (F.col("n_total") - 1))).otherwise(F.lit(0.0))
    ranks = table.select(*part, score, value.alias(percentile), F.col("n_total").alias(n_peers))
    return df.filter(F.col(score).isNotNull()).join(ranks, [*part, score])


def nth_smallest(df: DataFrame, part: Sequence[str], score: str, nth: Column, out: str,
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per group, the score at 1-based position ``nth`` (a column over ``n_total``)."""
    table = score_table(df, part, score, rows_per_bucket).withColumn("__nth", nth)
    hit = ((F.col("n_less") < F.col("__nth"))
           & (F.col("__nth") <= F.col("n_less") + F.col("n_equal")))
    return table.filter(hit).select(*part, F.col(score).alias(out))


def quantiles(df: DataFrame, part: Sequence[str], score: str, wanted: dict[str, float],
              rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact interpolated quantiles per group, all read off one rank table.

    ``wanted`` maps an output column to its quantile; values between two order statistics
    are interpolated linearly.
    """
    table = score_table(df, part, score, rows_per_bucket)
    v = F.col(score).cast("double")

    def spot(q: float) -> Column:
        return (F.col("n_total") - 1) * F.lit(q)

    def holds(nth: Column) -> Column:
        return (F.col("n_less") < nth) & (nth <= F.col("n_less") + F.col("n_equal"))

    aggs, outs, any_hit = [], [], F.lit(False)
    for name, q in wanted.items():
        low, high = holds(F.floor(spot(q)) + 1), holds(F.ceil(spot(q)) + 1)
        any_hit = any_hit | low | high
        aggs += [F.max(F.when(low, v)).alias(f"__l_{name}"), F.max(F.when(high, v)).alias(f"__h_{name}"),
                 F.max(spot(q) - F.floor(spot(q))).alias(f"__w_{name}")]
        lo = F.col(f"__l_{name}")
        outs.append((lo + (F.col(f"__h_{name}") - lo) * F.col(f"__w_{name}")).alias(name))
    return table.filter(any_hit).groupBy(*part).agg(*aggs).select(*part, *outs)


def quantile(df: DataFrame, part: Sequence[str], score: str, q: float, out: str,
             rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    return quantiles(df, part, score, {out: q}, rows_per_bucket)


def median(df: DataFrame, part: Sequence[str], score: str, out: str,
           rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    return quantile(df, part, score, 0.5, out, rows_per_bucket)
