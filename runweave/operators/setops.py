"""Run algebra on masks.  Arguments are in canonical form; so are results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions.columns import rect, rect_intersection, rect_union
from runweave.operators.dealing import deal
from runweave.operators.normalize import RANGES, SPANS, merge_runs, normalize, sweep


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalize(a.select(*SPANS).unionByName(b.select(*SPANS)))


def union_all(masks: list[DataFrame]) -> DataFrame:
    """Any number of masks; empty ones count for nothing."""
    return normalize(reduce(DataFrame.unionByName, (m.select(*SPANS) for m in masks)))


def union_layers(spans: DataFrame, layer: str, group: str) -> DataFrame:
    """The union as an aggregate: the masks of all layers of a group are merged, and the group becomes the mask."""
    return normalize(spans.filter(F.col(layer).isNotNull()).select(F.col(group).alias("mask_id"), "y", "x_start", "x_end"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep(a, b, lambda p, q: p & q)


def intersect_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same by an equi-join on (mask, row) with an overlap condition: fewer rows to sort where b is small or selective."""
    right = b.select("mask_id", "y", F.col("x_start").alias("_s"), F.col("x_end").alias("_e"))
    both = a.join(right, ["mask_id", "y"]).filter("x_start < _e AND _s < x_end")
    return both.select("mask_id", "y", F.greatest("x_start", "_s").alias("x_start"), F.least("x_end", "_e").alias("x_end"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep(a, b, lambda p, q: p & ~q)


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep(a, b, lambda p, q: p != q)


def bounds_spans(bounds: DataFrame) -> DataFrame:
    """The rows of each bounding rectangle."""
    dealt = deal(bounds, "mask_id")
    return dealt.select("mask_id", F.explode(F.sequence("by", F.expr("by + bh - 1"))).alias("y"), F.col("bx").alias("x_start"), F.expr("bx + bw").alias("x_end"))


def complement(a: DataFrame, bounds: DataFrame) -> DataFrame:
    """What each mask's bounds hold and the mask doesn't; a mask without rows has all of its bounds as complement."""
    return subtract(bounds_spans(bounds), a)


def _ranges(a: DataFrame, b: DataFrame, keep) -> DataFrame:
    return sweep(a.select(*RANGES), b.select(*RANGES), keep, ("mask_id",), "start", "end")


def range_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge_runs(a.select(*RANGES).unionByName(b.select(*RANGES)), ("mask_id",), "start", "end")


def range_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _ranges(a, b, lambda p, q: p & q)


def range_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _ranges(a, b, lambda p, q: p & ~q)


def range_symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _ranges(a, b, lambda p, q: p != q)


def range_complement(a: DataFrame, bounds: DataFrame) -> DataFrame:
    return range_difference(bounds.select("mask_id", F.lit(0).cast("long").alias("start"), F.expr("bw * bh").alias("end")), a)


def _rects(a: DataFrame, b: DataFrame, how: str, combine) -> DataFrame:
    left = a.select("mask_id", rect("bx", "by", "bw", "bh").alias("_p"))
    right = b.select("mask_id", rect("bx", "by", "bw", "bh").alias("_q"))
    out = left.join(right, "mask_id", how).select("mask_id", combine(F.col("_p"), F.col("_q")).alias("_r")).filter("_r IS NOT NULL")
    return out.select("mask_id", F.col("_r.x").alias("bx"), F.col("_r.y").alias("by"), F.col("_r.width").alias("bw"), F.col("_r.height").alias("bh"))


def union_bounds(a: DataFrame, b: DataFrame) -> DataFrame:
    return _rects(a, b, "full", lambda p, q: F.coalesce(rect_union(p, q), p, q))


def intersect_bounds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Masks whose bounds don't meet have no row."""
    return _rects(a, b, "inner", rect_intersection)


def prune(a: DataFrame, a_bounds: DataFrame, b_bounds: DataFrame) -> DataFrame:
    """Only the masks of `a` whose bounds meet the other side's: for use before intersect() and subtract()."""
    return a.join(intersect_bounds(a_bounds, b_bounds).select("mask_id"), "mask_id", "left_semi")
