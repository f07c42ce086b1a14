"""What the text operators share: staged tables, joins that split heavy keys, and column conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import discard, scratch, shared_root, staged

__all__ = ["WORD", "discard", "documents", "in_pieces", "scratch", "shared_root", "split_join", "staged", "table", "text_or_empty", "unsigned_crc32"]

#: A word is a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is heavy when it holds more than one in so many rows; there are fewer heavy keys than this, whatever the input.
HEAVY_SHARE = 1000
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined to right, which has a row for each key at most, by columns without nulls.

    Rows of heavy keys don't meet in one task: they stay where they are and join a broadcast copy of the right rows of
    these keys, of which there are fewer than HEAVY_SHARE. counts: rows of left by key (keys and n), if known.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts.select(*keys, "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hashed = F.xxhash64(*keys)
    heavy = [r[0] for r in counts.filter(F.col("n") > max(total // HEAVY_SHARE, 1000)).select(hashed).collect()]
    if not heavy:
        return left.join(right, keys, how)
    hot, rest = hashed.isin(heavy), ~hashed.isin(heavy)
    return left.filter(rest).join(right.filter(rest), keys, how).unionByName(left.filter(hot).join(F.broadcast(right.filter(hot)), keys, how))


def in_pieces(batches, rows: int = 500):
    """Arrow batches cut to so many rows at most, as single texts may hold 100 KB and more."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. Arrow batches of texts are held to BATCH_ROWS, one value for all operators, unless the
    session has another than Spark's default: it bounds what workers hold, and results don't depend on it."""
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))
