"""Removal of repeated multi-line chunks, in DataFrame functions alone.

Lines are hashed; a chunk ends after a line where a rolling hash over that line and the one before is a multiple of
the divisor, so an inserted line shifts no boundary but those beside it. Chunks of two lines or more with a word are
compared by their bytes (grouped by hash and text); where one occurs twice or more, its first occurrence by doc_id and
place stays and the others go. A hash that different texts share removes nothing.

A null text has no lines and stays null; an empty one is a line without words; a null doc_id counts as the smallest;
rows with equal doc_id and text are one place, which all of them keep; an empty table gives no rows; further columns
of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents

DIVISOR = 3
LEAST_LINES = 2


def chunked(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """docs with the arrays lines and chunks; a chunk is a struct of its number, first line and number of lines."""
    hashes = F.expr("transform(lines, x -> cast(conv(substr(md5(x), 1, 8), 16, 10) as bigint))")
    starts = F.expr(f"filter(sequence(0, size(lines) - 1), i -> i = 0 or pmod(coalesce(get(hashes, i - 2), 0) * 31 + get(hashes, i - 1), {divisor}) = 0)")
    chunks = F.expr("transform(starts, (s, k) -> struct(k as no, s as first, coalesce(get(starts, k + 1), size(lines)) - s as n))")
    df = docs.withColumn("lines", F.split("text", "\n", -1)).withColumn("hashes", hashes)
    return df.withColumn("starts", starts).withColumn("chunks", chunks).drop("hashes", "starts")


def occurrences(docs: DataFrame, divisor: int = DIVISOR, least_lines: int = LEAST_LINES) -> DataFrame:
    """A row for each chunk that could be removed: its place, text and hash."""
    long_ones = F.expr(f"filter(chunks, c -> c.n >= {least_lines})")
    df = chunked(docs.filter("text is not null"), divisor).select("key", "text_hash", "lines", F.explode(long_ones).alias("c"))
    df = df.select("key", "text_hash", "c.*", F.expr("array_join(slice(lines, c.first + 1, c.n), '\n')").alias("chunk"))
    return df.filter(F.col("chunk").rlike(r"[^\x20\x09-\x0D]")).withColumn("hash", F.xxhash64("chunk"))


def drop_repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, least_lines: int = LEAST_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_chunks, kept_text of every row."""
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("text_hash"))
    found = occurrences(keyed, divisor, least_lines)
    texts = found.groupBy("hash", "chunk").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))
    repeated = texts.groupBy("hash").agg(F.count("*").alias("texts"), F.min("n").alias("times"), F.min("first_key").alias("first_key"))
    repeated = repeated.filter("texts = 1 and times > 1").select("hash", "first_key")
    places = found.select("key", "text_hash", "no", "first", "n", "hash").join(repeated, "hash").repartition("key", "text_hash")
    again = F.col("no") > F.min("no").over(Window.partitionBy("key", "text_hash", "hash"))
    gone = places.withColumn("again", again).filter("key > first_key or again").groupBy("key", "text_hash").agg(F.collect_set("no").alias("gone"))
    joined = chunked(keyed.join(gone, ["key", "text_hash"], "left"), divisor)
    kept = F.expr("filter(chunks, c -> not coalesce(array_contains(gone, c.no), false))")
    joined = joined.withColumn("kept", F.when(F.col("gone").isNull(), F.col("chunks")).otherwise(kept))
    kept_lines = F.expr("aggregate(kept, 0, (a, c) -> a + c.n)")
    kept_text = F.expr("array_join(flatten(transform(kept, c -> slice(lines, c.first + 1, c.n))), '\n')")
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines)
    return joined.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(n_lines - kept_lines).cast("long").alias("n_removed_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept_text).alias("kept_text"),
    ).withColumn("n_removed_chunks", F.greatest("n_removed_chunks", F.lit(0).cast("long")))


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_chunks(documents(spark, sf_dir))


SQL = f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM line),
near AS (SELECT *, lag(h, 1) OVER w AS h1, lag(h, 2) OVER w AS h2 FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, sum(CASE WHEN i > 0 AND (coalesce(h2, 0) * 31 + h1) % {DIVISOR} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM near),
chunk AS (SELECT doc_id, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, no),
eligible AS (SELECT *, n >= {LEAST_LINES} AND regexp_matches(chunk, '[^\\x20\\x09-\\x0D]') AS fits FROM chunk),
ranked AS (SELECT *, fits AND row_number() OVER (PARTITION BY chunk, fits ORDER BY doc_id, no) > 1 AS gone FROM eligible),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed_chunks, coalesce(sum(n) FILTER (gone), 0) AS n_removed_lines, sum(n) AS n_lines,
  coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept_text FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
  coalesce(n_removed_chunks, 0)::BIGINT AS n_removed_chunks, kept_text FROM documents d LEFT JOIN kept k USING (doc_id)
"""
