"""Incidents against known attack windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.incidents import seconds


#: What makes a window one: several may have one label.
WINDOW = ("label", "win_start", "win_end")


def shifted(windows: DataFrame, hours: float) -> DataFrame:
    """Windows in another zone's time, moved by fixed hours."""
    move = F.expr(f"interval {int(hours * 3600)} seconds")
    return windows.withColumn("win_start", F.col("win_start") + move).withColumn("win_end", F.col("win_end") + move)


def overlaps(found: DataFrame, windows: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Pairs of incident and window (label, win_start, win_end) that overlap, the window widened by the tolerance.

    Windows are a short list of known events; beyond a size that Spark broadcasts by itself the join is a sort-merge
    join on whole days.
    """
    wide = windows.withColumn("__low", seconds(F.col("win_start")) - tolerance).withColumn("__high", seconds(F.col("win_end")) + tolerance)
    days = F.sequence(F.floor(F.col("__low") / 86400), F.floor(F.col("__high") / 86400))
    wide = wide.withColumn("__day", F.explode(days))
    own = found.withColumn("__from", seconds(F.col("start_time"))).withColumn("__to", seconds(F.col("end_time")))
    own = own.withColumn("__day", F.explode(F.sequence(F.floor(F.col("__from") / 86400), F.floor(F.col("__to") / 86400))))
    met = own.join(wide, "__day").filter((F.col("__to") >= F.col("__low")) & (F.col("__from") <= F.col("__high")))
    keep = [*found.columns, *windows.columns]
    return met.dropDuplicates(["capture_id", "incident_id", *WINDOW]).select(*keep)


def atlas(features: DataFrame, found: DataFrame, windows: DataFrame, families: list[str], labels: list[str], floor: float = 0.1) -> DataFrame:
    """Largest sigma by family and label; floor where nothing was seen."""
    hit = overlaps(found.select("capture_id", "incident_id", "start_time", "end_time"), windows)
    rows = features.join(hit.select("capture_id", "incident_id", "label"), ["capture_id", "incident_id"]).filter(F.col("family").isin(families))
    cells = rows.groupBy("family").pivot("label", labels).agg(F.max("max_sigma"))
    grid = features.sparkSession.createDataFrame([(f,) for f in families], "family string")
    return grid.join(cells, "family", "left").select("family", *[F.greatest(F.coalesce(F.col(f"`{x}`"), F.lit(floor)), F.lit(floor)).alias(x) for x in labels])


def coverage(found: DataFrame, windows: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """recall over windows and precision over incidents."""
    hit = overlaps(found, windows, tolerance)
    w = windows.join(hit.select(*WINDOW).distinct().withColumn("seen", F.lit(1)), [*WINDOW], "left").agg(F.avg(F.coalesce("seen", F.lit(0))).alias("recall"))
    i = hit.select("capture_id", "incident_id").distinct().agg(F.count("*").alias("true")).join(F.broadcast(found.agg(F.count("*").alias("all"))))
    return w.join(F.broadcast(i.select(F.when(F.col("all") > 0, F.col("true") / F.col("all")).otherwise(0.0).alias("precision"))))  # single rows


def peaks(found: DataFrame, results: DataFrame, value: str, slot: float = 3600.0) -> DataFrame:
    """The largest value inside each incident; where none is, that of the row nearest to its middle, the earlier of two.

    Rows inside meet by slots of time. The nearest row is the last one before or the first one after the middle, found
    in one sort of rows and middles; rows of one time count as one, of the largest value.
    """
    r = results.select("capture_id", seconds(F.col("ts")).alias("t"), F.col(value).cast("double").alias("y")).filter("t is not null")
    spans = found.select("capture_id", "incident_id", seconds(F.col("start_time")).alias("from"), seconds(F.col("end_time")).alias("to"))
    by_slot = spans.withColumn("slot", F.explode(F.sequence(F.floor(F.col("from") / slot), F.floor(F.col("to") / slot))))
    met = by_slot.join(r.withColumn("slot", F.floor(F.col("t") / slot)), ["capture_id", "slot"]).filter("t >= from and t <= to")
    inside = met.groupBy("capture_id", "incident_id").agg(F.max("y").alias("peak"))
    points = r.groupBy("capture_id", "t").agg(F.max("y").alias("y")).select("capture_id", "t", F.struct("t", "y").alias("row"), F.lit(None).cast("long").alias("incident_id"))
    middles = spans.select("capture_id", ((F.col("from") + F.col("to")) / 2).alias("t"), F.lit(None).cast("struct<t:double,y:double>").alias("row"), "incident_id")
    order = Window.partitionBy("capture_id").orderBy("t")
    both = points.unionByName(middles).select(
        "capture_id", "t", "incident_id", F.last("row", True).over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("a"), F.first("row", True).over(order.rangeBetween(0, Window.unboundedFollowing)).alias("b")
    )
    earlier = F.col("b").isNull() | (F.col("t") - F.col("a.t") <= F.col("b.t") - F.col("t"))
    nearest = both.filter("incident_id is not null").select("capture_id", "incident_id", F.when(earlier, F.col("a.y")).otherwise(F.col("b.y")).alias("nearest"))
    keys = ["capture_id", "incident_id"]
    return found.select(*keys).join(inside, keys, "left").join(nearest, keys, "left").select(*keys, F.coalesce("peak", "nearest").alias("peak"))
