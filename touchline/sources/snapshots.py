"""Landed raw files: ``<root>/<source>/<timestamp>/<name>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Timestamp folder and season prefix of a landed file.
STAMP = r"(\d{8}T\d{6}\d*Z)"
STAMP_FORMAT = "yyyyMMdd'T'HHmmss"
SEASON_PREFIX = r"(?:^|=)(\d{4}-\d{2})_"


def fetched_at(path: Column) -> Column:
    """When a file was fetched, from its timestamp folder (UTC, as a plain timestamp)."""
    stamp = F.substring(F.regexp_extract(path, f"/{STAMP}/", 1), 1, 15)
    return F.to_timestamp_ntz(F.when(stamp != "", stamp), F.lit(STAMP_FORMAT))


def position() -> Column:
    """``__position`` of a freshly read row, which orders rows as they lie: by file, then by the block that a task reads,
    then by the row in it (the running number tells apart rows of one block, which one task reads in order)."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row")).alias("__position")


def with_origin(df: DataFrame, source: str) -> DataFrame:
    """Adds the file path, ``source``, ``fetched_at`` and ``__position`` to freshly read rows."""
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("__path"), F.lit(source).alias("source"), fetched_at(path).alias("fetched_at"), position())


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """source, ts, name, path, length of every landed file; contents are not read.

    ``name`` is the entry below the timestamp: a file, or a folder of part files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    pattern = rf"/([^/]+)/{STAMP}/([^/]+)"
    return files.select("path", "length").select(
        F.regexp_extract("path", pattern, 1).alias("source"), F.regexp_extract("path", pattern, 2).alias("ts"),
        F.regexp_extract("path", pattern, 3).alias("name"), "path", "length").filter("source != ''")


def latest_snapshot(files: DataFrame, max_age_hours: float | None = None, now: Column | None = None) -> DataFrame:
    """Newest copy of every file name per source, optionally only if young enough."""
    newest = files.groupBy("source", "name").agg(F.max_by(F.struct("ts", "path", "length"), "ts").alias("f"))
    out = newest.select("source", "name", "f.ts", "f.path", "f.length")
    if max_age_hours is None:
        return out
    at = F.to_timestamp_ntz(F.substring("ts", 1, 15), F.lit(STAMP_FORMAT))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 3.6e9
    return out.filter(age <= max_age_hours)


def snapshot_audit(spark: SparkSession, root: str, status: str = "ok") -> DataFrame:
    """One audit row per landed file: checksum, size, records, fetch time, status.

    ``rows`` counts the records of the written forms of a feed: lines that hold something, less the header of a
    CSV file (also packed); a document on one line is one. Lines are counted where they are read; a checksum
    is taken over a whole file, so it may have 2 GB. Files of no bytes are not read by Spark and have no row.
    """
    def under(df: DataFrame, *cols) -> DataFrame:
        return df.select(F.col("_metadata.file_path").alias("file"), *cols)

    files = under(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), "path", "length", F.sha2("content", 256).alias("checksum"))
    lines = under(spark.read.option("recursiveFileLookup", "true").text(root), "value").filter(F.trim("value") != "").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    pattern = rf"/([^/]+)/{STAMP}/(.+)$"
    header = F.col("path").rlike(r"\.csv(\.gz|\.bz2|\.zst)?$").cast("bigint")
    return files.join(lines, "file", "left").select(
        F.regexp_extract("path", pattern, 1).alias("source"), F.regexp_extract("path", pattern, 3).alias("name"),
        fetched_at(F.col("path")).alias("fetched_at"), "checksum", F.col("length").alias("bytes"),
        F.greatest(F.coalesce("n", F.lit(0)) - header, F.lit(0)).alias("rows"), F.lit(status).alias("status")).filter("source != ''")


def seasons_present(files: DataFrame) -> DataFrame:
    """Distinct season prefixes of file names, newest first."""
    season = F.regexp_extract("name", SEASON_PREFIX, 1)
    seasons = files.select(season.alias("season_id")).filter("season_id != ''").distinct()
    return seasons.withColumn("place", F.row_number().over(W.orderBy(F.desc("season_id"))))
