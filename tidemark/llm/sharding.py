"""Histogram sort into shards of near equal bytes.

Rows are ordered by (hash of the text, doc_id), so that equal texts stand together. Splitters between shards, and
between the buckets that make up a shard, are found by counting the exact bytes at or below candidate keys over all
partitions and refining the candidates until each splitter is within tolerance. Then every row moves once, to its
bucket. A shard's edge falls between groups of equal texts where the tolerance permits that, else inside a group.

Null texts and texts of no bytes have size 1; a null doc_id sorts first; repeated rows get slots of their own; an empty
table gives no rows; a column of the input with the name of an output column is replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, staged, text_or_empty, unsigned_crc32

#: Small buckets spread evenly over tasks, though they are dealt by hash; they grow only where the splitters of all
#: shards, which the driver holds, would be more than MOST_SPLITTERS (at 100 TB a bucket has 1.5 GB).
BUCKET_BYTES = 1 << 20
LEAST_BUCKETS = 16
MOST_SPLITTERS = 1 << 16
PROBES = 16
TOP = (1 << 64) - 1
SIGN = 1 << 63


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes that sort as (high, low) do."""
    out = np.empty((len(high), 2), ">u8")
    out[:, 0] = high.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN)
    out[:, 1] = low.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN)
    return out.view("S16").ravel()


def _probe_bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], "S16")


def _histogram(thin: DataFrame, keys: list[int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Exact bytes and rows at or below each key; keys ascend. Also the least and greatest first half of the keys that
    occur between two (after key i - 1, up to key i)."""
    probes = _probe_bytes(keys)

    def count(batches):
        total, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        first, last = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), np.iinfo(np.int64).min)
        for b in batches:
            high = b.column("high").to_numpy()
            at = np.searchsorted(probes, _packed(high, b.column("low").to_numpy()))
            np.add.at(total, at, b.column("size").to_numpy())
            np.minimum.at(first, at, high)
            np.maximum.at(last, at, high)
            rows += np.bincount(at, minlength=len(rows))
        used = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(c[used]) for c in (np.arange(len(rows)), total, rows, first, last)], names=["at", "bytes", "rows", "first", "last"])

    sums = thin.mapInArrow(count, "at long, bytes long, rows long, first long, last long").groupBy("at")
    total, rows, spans = [0] * (len(keys) + 1), [0] * (len(keys) + 1), {}
    for at, b, n, first, last in sums.agg(F.sum("bytes"), F.sum("rows"), F.min("first"), F.max("last")).collect():
        total[at], rows[at], spans[at] = b, n, (first + SIGN, last + SIGN)
    return list(np.cumsum(total[:-1], dtype=object)), list(np.cumsum(rows[:-1], dtype=object)), spans


def _between(low: int, high: int, n: int, least: int, most: int) -> list[int]:
    """Up to n or so keys strictly between two; whole groups (equal first half) as long as these lie between, then places
    among the second halves that occur, least to most (but for nulls, below least)."""
    a, b = low >> 64, high >> 64
    if b - a > 1:
        return sorted({((a + (b - a) * i // (n + 1)) << 64) | TOP for i in range(1, n + 1)} - {low, high})
    keys: set[int] = set()
    for group in {a, b} if a >= 0 else {b}:
        first, last = max(low + 1, group << 64 | max(least - 1, 0)), min(high - 1, group << 64 | most)
        keys.update(first + (last - first) * i // n for i in range(n + 1) if first <= last)
    return sorted(keys)


def find_splitters(thin: DataFrame, n_shards: int, buckets: int, tolerance: float, loose: float, total: int) -> list[int]:
    """The n_shards * buckets - 1 keys that part the rows; those between shards to the tolerance, others to loose."""
    ends = thin.filter(F.col("low") > -(1 << 63)).agg(F.min("low"), F.max("low")).first()
    least, most = ((v or 0) + SIGN for v in ends)
    n = n_shards * buckets
    targets = [total * i // n for i in range(1, n)]
    slack = [max(1, int((tolerance if i % buckets == 0 else loose) * total / (n_shards if i % buckets == 0 else n))) for i in range(1, n)]
    lows, highs = {i: (-1, 0) for i in range(n - 1)}, {i: ((1 << 128) - 1, total) for i in range(n - 1)}
    open_, best = set(lows), {}
    while open_:
        probes = {i: _between(lows[i][0], highs[i][0], PROBES, least, most) for i in open_}
        open_ = {i for i in open_ if probes[i]}  # else no rows lie between
        keys = set().union(*(probes[i] for i in open_))
        if not keys:
            break
        ordered = sorted(keys)
        below, _, spans = _histogram(thin, ordered)
        for i in list(open_):
            at = bisect_left(below, targets[i])
            for j in (at - 1, at):
                if 0 <= j < len(ordered):
                    miss = abs(below[j] - targets[i])
                    if i not in best or miss < best[i][0]:
                        best[i] = (miss, ordered[j])
            if at > 0 and ordered[at - 1] > lows[i][0]:
                lows[i] = (ordered[at - 1], below[at - 1])
            if at < len(ordered) and ordered[at] < highs[i][0]:
                highs[i] = (ordered[at], below[at])
            if at in spans and 0 < at < len(ordered):  # what lies between begins and ends with these groups
                lows[i] = (max(lows[i][0], (spans[at][0] << 64) - 1), lows[i][1])
                highs[i] = (min(highs[i][0], (spans[at][1] << 64) | TOP), highs[i][1])
            if best.get(i, (slack[i] + 1,))[0] <= slack[i] or highs[i][0] - lows[i][0] <= 1:
                open_.discard(i)
    for i in range(n - 1):
        for edge in (lows[i], highs[i]):
            miss = abs(edge[1] - targets[i])
            if i not in best or miss < best[i][0]:
                best[i] = (miss, max(edge[0], 0))
    return list(np.maximum.accumulate(np.array([best[i][1] for i in range(n - 1)], dtype=object)))


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.001, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with the columns size, shard and slot."""
    docs = docs.drop("size", "shard", "slot")
    high, low = F.xxhash64(text_or_empty()), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    size = (F.octet_length(text_or_empty()) + 1).cast("long")
    thin = staged(docs.select(high.alias("high"), low.alias("low"), size.alias("size")), "shard-keys")
    total, rows = thin.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return docs.select("*", size.alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    buckets = max(LEAST_BUCKETS, min(MOST_SPLITTERS // n_shards, math.ceil(total / n_shards / bucket_bytes)))
    keys = find_splitters(thin, n_shards, buckets, tolerance, 0.2, total)
    distinct = sorted(set(keys))
    _, below, _ = _histogram(thin, distinct)
    rows_below = dict(zip(distinct, below, strict=True))
    starts = [0, *(rows_below[k] for k in keys)]
    bases = np.array([starts[b] - starts[b - b % buckets] for b in range(n_shards * buckets)], np.int64)
    probes = _probe_bytes(keys)

    @F.pandas_udf("int")
    def bucket_of(high: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(probes, _packed(high.to_numpy(), low.to_numpy())).astype(np.int32))

    @F.pandas_udf("long")
    def base_of(bucket: pd.Series) -> pd.Series:
        return pd.Series(bases[bucket.to_numpy()])

    placed = docs.select("*", size.alias("size"), high.alias("__high"), low.alias("__low")).withColumn("__bucket", bucket_of("__high", "__low"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("__high", "__low")) - 1
    placed = placed.withColumn("__place", place)
    return placed.select(
        *docs.columns, "size", F.floor(F.col("__bucket") / buckets).cast("int").alias("shard"), (F.col("__place") + base_of("__bucket")).alias("slot")
    )


def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    keyed = docs.withColumn("text_crc32", unsigned_crc32(text_or_empty()))
    return shard_by_bytes(keyed, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
