"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are put in an order by hash and cut into blocks. With integer shares
q(s) and a period of P = sum of shares, block k of a source (from 0) is released at slot floor(k P / q)
and due by slot ceil((k + 1) P / q). One block runs per slot; among the released ones the earliest
deadline goes first (ties: source order). The weights add up to one, so every block meets its window,
which means that after any number of slots a source is less than one block from its weight.

The schedule repeats after P slots, so only one period is worked out (a fold over its slots, native),
and the slot of any block follows by arithmetic. Likewise the position of a block: the sum over
the sources of the documents they have placed by then, for which the period holds the counts. No
global sort or window is needed: ranking inside a source is done in 4,096 hash ranges with
offsets, so a source with a third of the rows is ranked by many tasks.

Nothing is dropped or repeated. When a source has run out, its slots fall away and the others go on in
their ratios; ``on_target`` marks the slots before that.

Shares: given per source, or by temperature: the square root of the document count, rounded to
``RESOLUTION`` steps of the largest. The period table has (sources x period) counts, so it suits
up to some thousands of sources.

Defined cases: a null source is a source of its own; null texts are documents; rows with a null id
come first in their source; rows that repeat an id take places next to each other; a source without a
share is an error; an empty table gives an empty schedule; other columns are kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from touchline.llm.texts import picked, spare
from touchline.operators.common import stage

#: Documents of a block, and steps of the largest share that temperature shares are rounded to.
BLOCK, RESOLUTION = 16, 32


def _key(col: Column) -> Column:
    return F.when(col.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), col))


def period_plan(counts: DataFrame, shares: dict[str | None, int] | None, block: int) -> DataFrame:
    """One row: arrays over the sources (``keys, n, q``), the period ``len`` and its ``slots``.

    ``slots[t]`` is the source (from 0) that slot t runs.
    """
    if shares is None:
        q = F.greatest(F.lit(1), F.round(F.sqrt(F.col("n") / F.max("n").over(W.partitionBy())) * RESOLUTION)).cast("long")
    else:
        given = F.create_map(*[x for s, v in shares.items()
                               for x in (F.lit("-" if s is None else f"+{s}"), F.lit(int(v)).cast("long"))])
        q = F.coalesce(F.try_element_at(given, F.col("key")), F.raise_error(F.concat(F.lit("no share for source "), "key")).cast("long"))
    one = (counts.withColumn("q", q).agg(F.sort_array(F.collect_list(F.struct("key", "n", "q"))).alias("s"))
           .filter(F.size("s") > 0)
           .select(F.col("s.key").alias("keys"), F.col("s.n").alias("n"), F.col("s.q").alias("q"))
           .withColumn("len", F.expr("aggregate(q, 0L, (a, x) -> a + x)")))
    due = """array_min(filter(transform(st.done, (d, i) -> CASE WHEN (d * len) div q[i] <= t
             THEN struct(((d + 1) * len + q[i] - 1) div q[i] AS due, i AS i) END), x -> x IS NOT NULL)).i"""
    fold = f"""aggregate(sequence(0L, len - 1), struct(transform(q, x -> 0L) AS done, CAST(array() AS ARRAY<INT>) AS slots),
        (st, t) -> transform(array({due}), p -> struct(transform(st.done, (d, i) -> CASE WHEN i = p THEN d + 1 ELSE d END) AS done,
                                                       concat(st.slots, array(p)) AS slots))[0]).slots"""
    return one.withColumn("slots", F.expr(fold))


def period_slots(plan: DataFrame) -> DataFrame:
    """A row per slot of the period: ``key, nth`` (block of the source in the period), ``slot, before``
    (blocks of each source ahead of it), with ``q, n`` arrays, own share and the period's length."""
    each = plan.select("keys", "n", "q", "len", "slots", F.posexplode("slots").alias("slot", "s"))
    each = each.withColumn("before", F.expr(
        "transform(q, (x, i) -> CAST(size(filter(slice(slots, 1, slot), y -> y = i)) AS BIGINT))"))
    return each.select(F.expr("keys[s]").alias("key"), F.expr("before[s]").alias("nth"), F.col("slot").cast("long").alias("slot"),
                       "before", "n", "q", F.expr("q[s]").alias("share"), "len")


def ranked(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, key``) with ``place``: rank in the source by hash, from 0."""
    h = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    df = docs.withColumns({"h": h, "bucket": F.substring(h, 1, 3)})
    sizes = df.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("m"))
    # At most 4,097 rows of each source.
    below = sizes.select("key", "bucket", (F.sum("m").over(W.partitionBy("key").orderBy("bucket")) - F.col("m")).alias("below"))
    inside = F.row_number().over(W.partitionBy("key", "bucket").orderBy("h", "doc_id")) - 1
    return (df.withColumn("inside", inside).join(below, ["key", "bucket"])
            .withColumn("place", F.col("below") + F.col("inside")).drop("h", "bucket", "inside", "below"))


def schedule(docs: DataFrame, shares: dict[str | None, int] | None = None, block: int = BLOCK,
             id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``doc_id, source, block, release, deadline, slot, position, on_target`` of every row."""
    rows = picked(docs, doc_id=id_col, source=source_col).withColumn("key", _key(F.col("source")))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    slots = stage(period_slots(period_plan(counts, shares, block)), "mix-period")
    # The first slot whose block a source no longer has.
    sizes = counts.withColumn("blocks", F.ceil(F.col("n") / block)).select("key", "blocks")
    mixed_until = (slots.join(sizes, "key").filter(F.col("nth") == F.col("blocks") % F.col("share"))
                   .agg(F.min(F.expr("(blocks div share) * len + slot"))).first()[0])
    shares_of = slots.groupBy("key").agg(F.max("share").alias("own_share"))
    placed = (ranked(rows).withColumn("block", F.expr(f"place div {block}")).join(shares_of, "key")
              .withColumn("nth", F.col("block") % F.col("own_share")).join(slots, ["key", "nth"])
              .withColumn("mixed_until", F.lit(mixed_until).cast("long")))
    cycle = "(block div share)"
    start = f"""aggregate(zip_with(zip_with(n, q, (a, b) -> struct(a, b)), before,
        (x, c) -> least(x.a, {block}L * ({cycle} * x.b + c))), 0L, (a, x) -> a + x)"""
    return placed.select(
        "doc_id", "source", "block", F.expr("(block * len) div share").alias("release"),
        F.expr("((block + 1) * len + share - 1) div share").alias("deadline"),
        F.expr(f"{cycle} * len + slot").alias("slot"), (F.expr(start) + F.expr(f"place % {block}")).alias("position"),
        F.expr(f"{cycle} * len + slot < mixed_until").alias("on_target"))


def mixed(docs: DataFrame, shares: dict[str | None, int] | None = None, block: int = BLOCK,
          id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` in their columns, laid out in the order of the schedule: later partitions hold later
    positions and each is sorted, so files read by name give the mix."""
    key, place = spare(docs, "__id", "__at")
    at = stage(schedule(docs, shares, block, id_col, source_col)
               .groupBy(F.col("doc_id").alias(key)).agg(F.min("position").alias(place)), "mix-order")
    rows = docs.join(at, docs[id_col].eqNullSafe(at[key]))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = max(1, at.agg(F.max(place)).first()[0] or 1)
    part = F.least(F.lit(n - 1), F.floor(F.col(place) * n / (total + 1))).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions(place).select(*[docs[c] for c in docs.columns])


def laid_out(docs: DataFrame) -> DataFrame:
    """``docs``, read from the files of ``mixed``, with ``position`` (place in the mix, from 0; a column of that name gives way),
    laid out by it.

    Spark deals a folder's files to tasks by size, so the order of reading says nothing; names and rows of files do.
    """
    file, row, start = spare(docs, "__file", "__row", "__start")
    others = [c for c in docs.columns if c.lower() != "position"]
    rows = docs.select(*others, F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    # A row per file.
    sizes = [(r[file], r["n_rows"]) for r in rows.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows")).collect()]
    sizes.sort(key=lambda x: (len(x[0]), x[0]))  # numbers of 100,000 and more have another digit
    starts, total = [], 0
    for name, n in sizes:
        starts.append((name, total))
        total += n
    first = F.broadcast(docs.sparkSession.createDataFrame(starts, f"{file} string, {start} long"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.join(first, file).withColumn("position", F.col(start) + F.col(row))
    part = F.floor(F.col("position") * n / max(1, total)).cast("int")
    return at.repartitionById(n, part).sortWithinPartitions("position").select(*others, "position")
