"""Ranges that carry metadata: merging by priority, and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runweave.operators.reshape import split_rows


BUCKET = 4096


def priority_union(ranges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """mask_id, start, end, meta of ranges with meta and priority: where several lie, the highest priority's meta holds (of
    equal ones, the greatest meta); neighbours with equal meta are one range.

    Ranges are cut at multiples of `bucket`, and what lies in one bucket of a mask meets there: cells between the ends that
    occur in a bucket are compared with that bucket's ranges only, and a large mask spreads over its buckets."""
    cut = ranges.withColumn("_b", F.explode(F.expr(f"sequence(`start` div {bucket}, (`end` - 1) div {bucket})")))
    cut = cut.select("mask_id", "_b", F.greatest("start", F.col("_b") * bucket).alias("_from"), F.least("end", (F.col("_b") + 1) * bucket).alias("_to"), "meta", "priority")
    keys = ["mask_id", "_b"]
    cut = cut.repartition(*keys)
    points = cut.select(*keys, F.explode(F.array("_from", "_to")).alias("x")).distinct()
    cells = points.select(*keys, F.col("x").alias("_s"), F.lead("x").over(Window.partitionBy(*keys).orderBy("x")).alias("_e")).filter("_e IS NOT NULL")
    inside = cells.join(cut, keys).filter((F.col("_s") >= F.col("_from")) & (F.col("_s") < F.col("_to")))
    won = inside.groupBy(*keys, "_s", "_e").agg(F.max(F.struct("priority", "meta")).getField("meta").alias("meta"))
    return _islands(won)


def _islands(cells: DataFrame) -> DataFrame:
    """mask_id, start, end, meta: disjoint cells (_s, _e), those that touch and have the same meta as one."""
    v = Window.partitionBy("mask_id").orderBy("_s")
    goes_on = (F.lag("_e").over(v) == F.col("_s")) & F.lag("meta").over(v).eqNullSafe(F.col("meta"))
    marked = cells.withColumn("_opens", F.when(goes_on, 0).otherwise(1)).withColumn("_island", F.sum("_opens").over(v))
    return marked.groupBy("mask_id", "_island", "meta").agg(F.min("_s").alias("start"), F.max("_e").alias("end")).select("mask_id", "start", "end", "meta")


def union_over(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's ranges where it has some, a's elsewhere."""
    side = lambda df, p: df.select("mask_id", "start", "end", "meta", F.lit(p).alias("priority"))
    return priority_union(side(a, 0).unionByName(side(b, 1)))


def check_map(ranges: DataFrame) -> DataFrame:
    """The same ranges, with an error raised for an empty one or for two that overlap or touch."""
    before = F.lag("end").over(Window.partitionBy("mask_id").orderBy("start", "end"))
    bad = F.when(F.col("end") <= F.col("start"), F.lit("range is empty")).when(before >= F.col("start"), F.lit("ranges overlap or touch"))
    return ranges.withColumn("_bad", bad).filter(F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast("boolean")).otherwise(F.lit(True))).drop("_bad")


def transform_meta(ranges: DataFrame, change) -> DataFrame:
    """Applies a DataFrame function to ranges with meta and brings the result into order again: where ranges overlap
    afterwards, the one with the highest priority (0 where there is no such column) holds, of equal ones the greatest meta."""
    changed = change(ranges)
    return priority_union(changed if "priority" in changed.columns else changed.withColumn("priority", F.lit(0).cast("long")))


def meta_spans(ranges: DataFrame, bounds: DataFrame) -> DataFrame:
    """Local ranges with meta as global spans with meta, cut at row ends."""
    cut = split_rows(ranges.join(bounds, "mask_id"), "bw")
    return cut.select("mask_id", F.expr("`start` div bw + by").alias("y"), F.expr("`start` % bw + bx").alias("x_start"), F.expr("`end` - (`start` div bw) * bw + bx").alias("x_end"), "meta")


def ordered_items(ranges: DataFrame) -> DataFrame:
    """In the order of starts, higher priorities first."""
    return ranges.orderBy("mask_id", "start", F.desc("priority"))


def drop_meta(ranges: DataFrame) -> DataFrame:
    return ranges.select("mask_id", "start", "end")
