"""Temperature mixing of sources by budgeted block permutations.

A source with the share p of all words gets a weight in proportion to p ** t. The exponent t in [0, 1] is bisected (in
sections of sixteen, so that one job tries many) to the smallest one whose mixture meets a limit of repetitions, or to
the largest one whose mixture has the entropy asked for. The budget defaults to the smallest at which each source is
read once in whole; a source's part of it is then as many whole passes as fit, and a last pass in part.

Each pass permutes blocks of a source's documents, and documents within the blocks. The last pass takes blocks in that
order while they fit, and then documents of the next block while they fit. So what decides on a document are a few
numbers of its source, and no text is moved.

A null source is a source of its own; one without words is passed once; rows with equal doc_id of a source are taken or
left together in a last pass; an empty table gives no rows. Columns of the input keep their names; those of the output
that clash (epoch, mix_order) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, documents, staged, text_or_empty

#: Rows of a block, in the mean; a source of more than MOST_BLOCKS such blocks has larger ones, so that the order of its
#: blocks and that of the rows of one block are both sorted in one task (at 100 TB some 500,000 rows).
BLOCK_ROWS = 4096
MOST_BLOCKS = 1 << 16
SMALL_TABLE_ROWS = 100_000
SEED = 20


def n_words(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def bisect_exponent(sources: DataFrame, repetition_limit: float | None, target_entropy: float | None, sections: int = 16, steps: int = 5) -> float:
    """The exponent; target_entropy is a fraction of the largest possible entropy."""
    known = sources.filter("words > 0")
    low_p, high_p, n, total = known.agg(F.min("words"), F.max("words"), F.count("*"), F.sum("words")).first()
    if n < 2:
        return 1.0
    if repetition_limit is not None:
        meets_high, ok = True, lambda ts: [(low_p / high_p) ** (t - 1) <= repetition_limit for t in ts]
    else:
        p = F.col("words") / F.lit(float(total))

        def entropies(ts):
            z = [F.sum(F.pow(p, F.lit(t))) for t in ts]
            s = [F.sum(F.pow(p, F.lit(t)) * F.log(p)) for t in ts]
            row = known.agg(*z, *s).first()
            return [math.log(row[i]) - t * row[len(ts) + i] / row[i] for i, t in enumerate(ts)]

        meets_high, ok = False, lambda ts: [h >= target_entropy * math.log(n) for h in entropies(ts)]
    low, high = 0.0, 1.0
    if ok([low if meets_high else high])[0]:
        return low if meets_high else high
    for _ in range(steps):
        ts = [low + (high - low) * i / sections for i in range(1, sections)]
        met = ok(ts)
        if meets_high:
            i = next((i for i, m in enumerate(met) if m), len(ts))
        else:
            i = next((i for i, m in enumerate(met) if not m), len(ts))
        low, high = ts[i - 1] if i else low, ts[i] if i < len(ts) else high
    return high if meets_high else low


def _block(n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(SEED)), n_blocks)


def _block_order(epoch: Column) -> Column:
    return F.xxhash64("__block", epoch, F.lit(SEED + 1))


def _row_order(epoch: Column) -> Column:
    return F.xxhash64("doc_id", epoch, F.lit(SEED + 2))


def plan_mixture(docs: DataFrame, repetition_limit: float | None = 1.5, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """A row for each source: words, exponent, weight, passes (whole ones), and what of the last pass is taken."""
    thin = staged(docs.select("source", "doc_id", n_words().alias("words")), "mix-words")
    sources = staged(thin.groupBy("source").agg(F.count("*").alias("rows"), F.sum("words").alias("words")), "mix-sources")
    t = bisect_exponent(sources, repetition_limit, target_entropy)
    power = F.when(F.col("words") > 0, F.pow(F.col("words").cast("double"), F.lit(t))).otherwise(0.0)
    z, least = sources.agg(F.sum(power), F.max(F.when(F.col("words") > 0, F.col("words") / power))).first()
    whole = float(least or 0.0) if budget is None else budget / z if z else 0.0  # words for each unit of power
    due = F.round(power * F.lit(whole)).cast("long")
    passes = F.when(F.col("words") > 0, F.floor(due / F.col("words"))).otherwise(1).cast("long")
    plan = sources.select(
        "source", "rows", "words", F.lit(t).alias("exponent"), (power / F.lit(z or 1.0)).alias("weight"), passes.alias("passes"),
        F.when(F.col("words") > 0, due - passes * F.col("words")).otherwise(0).alias("rest"), F.least(F.ceil(F.col("rows") / BLOCK_ROWS), F.lit(MOST_BLOCKS)).alias("n_blocks"),
    )
    plan = staged(plan, "mix-plan")
    known = thin.withColumnRenamed("source", "__source")
    of = plan.filter("rest > 0").select("source", "passes", "rest", "n_blocks")
    own = known.join(_small(of), F.col("source").eqNullSafe(F.col("__source"))).withColumn("__block", _block(F.col("n_blocks")))
    blocks = own.groupBy("source", "passes", "rest", "__block").agg(F.sum("words").alias("words")).withColumn("__order", _block_order(F.col("passes")))
    along = Window.partitionBy("source").orderBy("__order", "__block")
    blocks = blocks.withColumn("upto", F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    edge = blocks.groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("__order", "__block"))).alias("last_block"),
        F.min(F.when(F.col("upto") > F.col("rest"), F.struct("__order", "__block", (F.col("rest") - F.col("upto") + F.col("words")).alias("room")))).alias("next_block"),
    )
    edge = staged(edge, "mix-edges")
    cut = edge.filter("next_block is not null").select(F.col("source").alias("edge_source"), F.col("next_block.__block").alias("edge_block"), F.col("next_block.room").alias("room"))
    inside = own.join(_small(cut), F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("__block") == F.col("edge_block"))).withColumn("__row", _row_order(F.col("passes")))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("__row").rangeBetween(Window.unboundedPreceding, 0))
    rows = inside.withColumn("upto", upto).filter("upto <= room").groupBy("source").agg(F.max("__row").alias("last_row"))
    joined = plan.alias("p").join(edge.alias("e"), F.expr("p.source <=> e.source"), "left").join(rows.alias("r"), F.expr("p.source <=> r.source"), "left")
    return staged(joined.select("p.*", "e.last_block", F.col("e.next_block.__block").alias("edge_block"), "r.last_row"), "mix")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of sources that has few rows; one with more is joined by shuffle."""
    return F.broadcast(df) if df.count() <= SMALL_TABLE_ROWS else df


def realise(docs: DataFrame, plan: DataFrame, epoch: str = "epoch", order: str = "mix_order") -> DataFrame:
    """docs, each row as often as the plan takes it, with its epoch and its place in the mixture's order."""
    kept = [c for c in docs.columns if c not in (epoch, order)]
    own = plan.select(F.col("source").alias("__source"), F.struct("passes", "n_blocks", "last_block", "edge_block", "last_row", "rest").alias("__plan"))
    df = docs.select(*kept).join(_small(own), F.col("source").eqNullSafe(F.col("__source")))
    df = df.withColumn("__block", _block(F.col("__plan.n_blocks")))
    at = F.struct(_block_order(F.col("__plan.passes")).alias("__order"), F.col("__block"))
    in_block = (F.col("__block") == F.col("__plan.edge_block")) & (_row_order(F.col("__plan.passes")) <= F.col("__plan.last_row"))
    last = (F.col("__plan.rest") > 0) & (F.coalesce(at <= F.col("__plan.last_block"), F.lit(False)) | F.coalesce(in_block, F.lit(False)))
    df = df.withColumn("__copies", F.col("__plan.passes") + last.cast("long")).filter("__copies > 0")
    df = df.withColumn("__turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    place = F.struct(F.col("__turn").alias("epoch"), _block_order(F.col("__turn")).alias("block"), _row_order(F.col("__turn")).alias("row"))
    return df.select(*kept, F.col("__turn").alias(epoch), place.alias(order))


def mix(docs: DataFrame, repetition_limit: float | None = 1.5, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    return realise(docs, plan_mixture(docs, repetition_limit, target_entropy, budget))


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    mixed = mix(docs.select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", n_words().alias("n_words"), "epoch", F.col("mix_order.block").alias("block_order"), F.col("mix_order.row").alias("row_order"))
