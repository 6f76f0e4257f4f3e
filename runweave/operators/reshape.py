"""Spans and ranges into each other, clipping, other widths, and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.functions.columns import FITS, check_fits, col, rect, rect_intersection
from runweave.operators.dealing import deal_both
from runweave.operators.normalize import normalize_ranges


def clip(spans: DataFrame, x, y, width, height) -> DataFrame:
    """What lies in the rectangle.  A filter and two trims: no exchange, and the row filter reaches the scan."""
    x, y, ex, ey = col(x), col(y), col(x) + col(width), col(y) + col(height)
    inside = spans.filter((F.col("y") >= y) & (F.col("y") < ey) & (F.col("x_start") < ex) & (F.col("x_end") > x))
    return inside.withColumns({"x_start": F.greatest("x_start", x).cast("long"), "x_end": F.least("x_end", ex).cast("long")})


def clip_bounds(bounds: DataFrame, x, y, width, height) -> DataFrame:
    """Bounds after clip(); a mask whose bounds lie outside has no row."""
    shared = rect_intersection(rect("bx", "by", "bw", "bh"), rect(x, y, width, height))
    out = bounds.select("mask_id", shared.alias("_r")).filter("_r IS NOT NULL")
    return out.select("mask_id", F.col("_r.x").alias("bx"), F.col("_r.y").alias("by"), F.col("_r.width").alias("bw"), F.col("_r.height").alias("bh"))


def local_ranges(spans: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each span's place in its bounds read row by row; nothing is merged."""
    at = "(y - by) * bw - bx"
    spans, bounds = deal_both(spans, bounds, "mask_id")
    return spans.join(bounds, "mask_id").select("mask_id", F.expr(f"{at} + x_start").alias("start"), F.expr(f"{at} + x_end").alias("end"))


def into_ranges(spans: DataFrame, bounds: DataFrame, output: str = "half_open") -> DataFrame:
    """The same with flat neighbours merged, so that full rows become one range; output: see represent()."""
    return represent(normalize_ranges(local_ranges(spans, bounds)), output)


def represent(ranges: DataFrame, output: str = "half_open", start: str = "start", end: str = "end") -> DataFrame:
    """Half-open runs in another representation: "half_open" (as they are), "inclusive" (`end` is the last place) or "length"
    (`len` in place of the end)."""
    if output == "half_open":
        return ranges
    if output == "inclusive":
        return ranges.withColumn(end, F.col(end) - 1)
    if output == "length":
        return ranges.withColumn("len", F.col(end) - F.col(start)).drop(end)
    raise ValueError(f"unknown output {output!r}")


def split_rows(ranges: DataFrame, width: Column | str | int) -> DataFrame:
    """Ranges cut at row ends, still flat."""
    w = width if isinstance(width, str) else str(width)
    rows = ranges.withColumn("_row", F.explode(F.expr(f"sequence(`start` div {w}, (`end` - 1) div {w})")))
    cut = {"start": F.expr(f"greatest(`start`, _row * {w})"), "end": F.expr(f"least(`end`, (_row + 1) * {w})")}
    return rows.withColumns(cut).drop("_row")


def ranges_to_spans(ranges: DataFrame, bounds: DataFrame) -> DataFrame:
    """Local ranges as global spans, cut at row ends.  No exchange beyond the join with the bounds."""
    return split_rows(ranges.join(bounds, "mask_id"), "bw").select(
        "mask_id", F.expr("`start` div bw + by").alias("y"), F.expr("`start` % bw + bx").alias("x_start"), F.expr("`end` - (`start` div bw) * bw + bx").alias("x_end")
    )


def typed_spans(ranges: DataFrame, bounds: DataFrame, kind: str) -> DataFrame:
    """ranges_to_spans(), with an error raised where a span's end, its row's end or its range's end doesn't fit the unsigned type."""
    spans = ranges_to_spans(ranges.withColumn("end", check_fits("end", kind)), bounds)
    fits = F.when(F.col("y") + 1 > FITS[kind], F.raise_error(F.lit(f"row does not fit {kind}")).cast("long")).otherwise(F.col("y"))
    return spans.withColumns({"y": fits, "x_end": check_fits("x_end", kind)})


def reproject(spans: DataFrame, width: int) -> DataFrame:
    """Flat ranges in a frame at (0, 0) of another width; columns beyond it are left out."""
    kept = spans.filter(F.col("x_start") < width).withColumn("x_end", F.least("x_end", F.lit(width).cast("long")))
    return normalize_ranges(kept.select("mask_id", F.expr(f"y * {width}L + x_start").alias("start"), F.expr(f"y * {width}L + x_end").alias("end")))


def reproject_bounds(bounds: DataFrame, width: int) -> DataFrame:
    return bounds.select("mask_id", *(F.lit(0).cast("long").alias(c) for c in ("bx", "by")), F.lit(width).cast("long").alias("bw"), F.expr("by + bh").alias("bh"))


def with_bounds(bounds: DataFrame, x, y, width, height) -> DataFrame:
    """Declares other bounds for all masks; nothing is filtered."""
    return bounds.select("mask_id", *(col(v).cast("long").alias(n) for n, v in (("bx", x), ("by", y), ("bw", width), ("bh", height))))


def sanitize(ranges: DataFrame, seq: str | None = None, errors: str = "raise") -> DataFrame:
    """Ranges in canonical form.

    With `seq`, the order in which they were given is checked too: a start below the run that is open (`smaller start`) or
    a range that ends before it starts (`start after end`) raises, or, with errors="keep", ends its mask's good part."""
    if seq is None:
        return normalize_ranges(ranges)
    w = Window.partitionBy("mask_id").orderBy(seq)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # the open run starts at the last range that began beyond all ends before it
    reach = F.max("end").over(before)
    marked = ranges.withColumn("_opens", F.when(reach.isNull() | (F.col("start") > reach), F.col("start")))
    marked = marked.withColumn("_open", F.last("_opens", ignorenulls=True).over(before))
    bad = F.when(F.col("end") <= F.col("start"), F.lit("start after end")).when(F.col("start") < F.col("_open"), F.lit("smaller start"))
    marked = marked.withColumn("_bad", bad)
    if errors == "raise":
        good = marked.filter(F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast("boolean")).otherwise(F.lit(True)))
    else:
        good = marked.withColumn("_ended", F.max(F.col("_bad").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("NOT _ended")
    return normalize_ranges(good)


def shift_ranges(ranges: DataFrame, offset: int) -> DataFrame:
    """All ranges moved; one that would begin below 0 is an error."""
    ok = F.when(F.col("start") + offset < 0, F.raise_error(F.lit("range shifted below 0")).cast("long")).otherwise(F.col("start") + offset)
    return ranges.withColumns({"start": ok, "end": F.col("end") + offset})


def shift_lengths(ranges: DataFrame, by: int) -> DataFrame:
    """All ranges longer by `by` at their ends; a negative one drops what is left with nothing."""
    return ranges.withColumn("end", F.col("end") + by).filter(F.col("end") > F.col("start"))


def transform_ranges(ranges: DataFrame, change) -> DataFrame:
    """Applies a DataFrame function to a mask's ranges and brings the result into canonical form; masks left without
    ranges are empty masks, that is, have no rows."""
    return normalize_ranges(change(ranges))


def transform_spans(ranges: DataFrame, bounds: DataFrame, change) -> DataFrame:
    """The same on global spans of local ranges."""
    return into_ranges(change(ranges_to_spans(ranges, bounds)), bounds)
