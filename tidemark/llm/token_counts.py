"""Token counts through a digest cache.

Contents that differ only in white space have as many tokens in a tokenizer that drops it, so texts are normalised by
folding white space where (and only where) the tokenizer allows that. The digest of normalised content and tokenizer
version is joined to the stored counts; distinct digests without a count are encoded once and appended to the cache.

Null texts count as empty; empty texts have 0 tokens; equal texts share one cache entry; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, shared_root, split_join, staged
from tidemark.llm.tokens import drops_white_space, grouped, shared_encoder, vocabulary_path

CACHE_SCHEMA = "digest binary, n_tokens long"
#: Part of each digest; counts of another way to encode are not those of this one.
ENCODER = "1"
#: Missing digests (32 bytes each) that are broadcast; more are joined by shuffle.
SMALL_MISSES = 200_000


def tokenizer_version(name: str) -> str:
    with open(vocabulary_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def _counts(tokenizer: str):
    def run(batches):
        encoder = shared_encoder(tokenizer)
        for table, texts in grouped(batches, "content"):
            _, n = encoder.encode_flat(texts)
            yield pa.record_batch([table.column("digest").combine_chunks(), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame | None:
    """The stored counts, if there are any; a digest that two writers appended at once counts once."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs; new counts are appended to the Parquet folder cache.

    The cache is asked with digests alone. Texts move only where their digest is missing from it.
    """
    spark = docs.sparkSession
    path = vocabulary_path(tokenizer)
    content = F.coalesce("text", F.lit(""))
    folded = path.endswith(".json") and drops_white_space(path)
    normal = F.trim(F.regexp_replace(content, r"[\x20\x09-\x0D]+", " ")) if folded else content
    digest = F.unhex(F.sha2(F.concat(F.lit(f"{ENCODER}:{tokenizer_version(tokenizer)}:"), F.col("content")), 256)).alias("digest")
    contents = docs.select(normal.alias("content")).select(digest, "content")
    thin = docs.select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), normal.alias("content")).select("doc_id", "n_bytes", digest)
    thin = staged(thin, "token-digests")
    times = staged(thin.groupBy("digest").agg(F.count("*").alias("n")), "token-distinct")
    stored = read_cache(spark, cache)
    if stored is not None:
        missing = staged(times.join(stored, "digest", "left_anti").select("digest"), "token-misses")
        n = missing.count()
        contents = contents.join(F.broadcast(missing) if n <= SMALL_MISSES else missing, "digest", "left_semi") if n else None
    if contents is not None:
        contents.dropDuplicates(["digest"]).mapInArrow(_counts(tokenizer), CACHE_SCHEMA).write.mode("append").parquet(cache)
        stored = read_cache(spark, cache)
    counted = split_join(thin, stored, ["digest"], "left", counts=times)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache stays in the shared folder for later runs, which encode what is new alone."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, "word_bpe_49k.json", f"{shared_root(spark)}/tidemark-token-counts")
