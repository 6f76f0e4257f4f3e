"""Counts, areas, tight bounds and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def run_count(runs: DataFrame) -> DataFrame:
    return runs.groupBy("mask_id").agg(F.count("*").alias("runs"))


def area(spans: DataFrame, start: str = "x_start", end: str = "x_end") -> DataFrame:
    return spans.groupBy("mask_id").agg(F.sum(F.col(end) - F.col(start)).alias("area"))


def inspect_bounds(spans: DataFrame) -> DataFrame:
    """Tight bounds of each mask; a mask without spans has no row."""
    box = spans.groupBy("mask_id").agg(F.min("x_start").alias("bx"), F.min("y").alias("by"), F.max("x_end").alias("_ex"), F.max("y").alias("_ey"))
    return box.select("mask_id", "bx", "by", F.expr("_ex - bx").alias("bw"), F.expr("_ey + 1 - by").alias("bh"))


def inspect_range_bounds(ranges: DataFrame, bounds: DataFrame) -> DataFrame:
    """The same of local ranges, in global coordinates: a range that crosses a row end takes the full width."""
    at = ranges.join(bounds, "mask_id").withColumns({"_a": F.expr("`start` div bw"), "_b": F.expr("(`end` - 1) div bw")})
    x0, x1 = F.expr("if(_a = _b, `start` % bw, 0)"), F.expr("if(_a = _b, (`end` - 1) % bw + 1, bw)")
    box = at.groupBy("mask_id").agg(F.min(x0 + F.col("bx")).alias("x"), F.min(F.expr("_a + by")).alias("y"), F.max(x1 + F.col("bx")).alias("_ex"), F.max(F.expr("_b + by")).alias("_ey"))
    return box.select("mask_id", F.col("x").alias("bx"), F.col("y").alias("by"), F.expr("_ex - x").alias("bw"), F.expr("_ey + 1 - y").alias("bh"))


def inspect(spans: DataFrame, name: str = "bounds") -> tuple[DataFrame, Observation]:
    """The same spans, with the bounds of all that pass (ex, ey exclusive) and their number, known once an action has run."""
    folds = {"bx": F.min("x_start"), "by": F.min("y"), "ex": F.max("x_end"), "ey": F.max("y") + 1, "runs": F.count(F.lit(1))}
    return fold_inline(spans, name, **folds)


def fold_inline(df: DataFrame, name: str = "fold", **folds: Column) -> tuple[DataFrame, Observation]:
    """The same rows, with aggregates taken as they pass; they are known once an action has run over all of them."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in folds.items())), seen


def fold_masks(df: DataFrame, function, schema: str) -> DataFrame:
    """Any fold over each mask's rows: a pandas function from a mask's frame to a frame."""
    return df.groupBy("mask_id").applyInPandas(function, schema)


def fold_ordered(df: DataFrame, order: str, zero: Column, step, finish=None) -> DataFrame:
    """mask_id, value: a general fold in the order of a column, as expressions: step(so far, row as a struct), then
    finish(value).  A mask's rows come together in one array, so it is meant for masks that fit a task."""
    listed = df.groupBy("mask_id").agg(F.sort_array(F.collect_list(F.struct(order, *(c for c in df.columns if c not in (order, "mask_id"))))).alias("_rows"))
    value = F.aggregate("_rows", zero, step) if finish is None else F.aggregate("_rows", zero, step, finish)
    return listed.select("mask_id", value.alias("value"))


def preview(df: DataFrame, n: int = 10) -> str:
    """The first n rows of the keys' order, and how many more there are."""
    rows, total = df.orderBy(*df.columns).limit(n).collect(), df.count()
    shown = ", ".join(str(tuple(r)) for r in rows)
    return f"[{shown}]" + (f" ...and {total - n} more" if total > n else "")
