"""Dilation with a square, on spans and on flat ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions.columns import rect, rect_expand
from runweave.operators.dealing import deal
from runweave.operators.normalize import merge_runs, normalize, normalize_ranges
from runweave.operators.reshape import clip

DIRECT = 4  # up to this radius, all 2r+1 rows of a span are made at once


def in_place(start, end, r: int):
    """[start - r, end + r), not below 0."""
    return F.greatest(start - r, F.lit(0).cast("long")), end + r


def translated(start, end, r: int):
    """[start, end + 2r): the dilated mask moved to the right by r."""
    return start, end + 2 * r


def row_steps(r: int) -> list[int]:
    """Shifts s such that doing -s, 0, +s for each in turn reaches every row within r and none beyond."""
    out, reach = [], 0
    while reach < r:
        step = min(2 * reach + 1, r - reach)
        out.append(step)
        reach += step
    return out


def dilate(spans: DataFrame, r: int, strategy=in_place, clip_to: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Everything within r columns and r rows of the mask; what would fall left of column 0 or above row 0 is left out.

    A small radius makes each span's 2r+1 rows.  With a large one, masks are cut into strips of 2r+1 rows, spans go to the one or
    two strips that they reach, and a strip makes three rows of each run per step of a number of steps logarithmic in r, with
    runs merged in between: one exchange in all.  clip_to (x, y, width, height) cuts the result, and drops early what can't
    reach it."""
    if r < 0:
        raise ValueError("the radius is negative")
    if clip_to:
        x, y, w, h = clip_to
        near = spans.filter((F.col("y") >= y - r) & (F.col("y") < y + h + r))
        spans = near.filter((F.col("x_start") < x + w + r) & (F.col("x_end") > x - r)) if strategy is in_place else near
    start, end = strategy(F.col("x_start"), F.col("x_end"), r)
    out = spans.select("mask_id", "y", start.cast("long").alias("x_start"), end.cast("long").alias("x_end"))
    if r <= DIRECT:
        rows = F.expr(f"sequence(greatest(y - {r}, 0L), y + {r})")
        out = normalize(out.withColumn("y", F.explode(rows)), rows=2 * r + 1)
    else:
        high, left = 2 * r + 1, r
        strips = F.expr(f"sequence(greatest(y - {r}, 0L) div {high}, (y + {r}) div {high})")
        out = deal(out.withColumn("_strip", F.explode(strips)), "mask_id", "_strip", rows=6, always=True)
        for step in row_steps(r):  # rows above 0 and beside the strip are needed as long as they can reach it
            left -= step
            out = out.withColumn("y", F.explode(F.expr(f"array(y - {step}, y, y + {step})")))
            out = out.filter(F.expr(f"y >= _strip * {high} - {left} AND y < (_strip + 1) * {high} + {left}"))
            out = merge_runs(out, ("mask_id", "_strip", "y"), "x_start", "x_end")
        out = out.filter("y >= 0").drop("_strip")
    return clip(out, *clip_to) if clip_to else out


def dilate_bounds(bounds: DataFrame, r: int, times: int = 1) -> DataFrame:
    """Bounds after dilation inside a region that is declared (once), or whose bounds are grown before (twice)."""
    grown = rect("bx", "by", "bw", "bh")
    for _ in range(times):
        grown = rect_expand(grown, r)
    out = bounds.select("mask_id", grown.alias("_r"))
    return out.select("mask_id", F.col("_r.x").alias("bx"), F.col("_r.y").alias("by"), F.col("_r.width").alias("bw"), F.col("_r.height").alias("bh"))


def erode(spans: DataFrame, bounds: DataFrame, r: int) -> DataFrame:
    """What stays r away from everything outside the mask; outside the bounds counts as outside."""
    from runweave.operators.setops import bounds_spans, subtract

    grown = dilate_bounds(bounds, r)
    outside = subtract(bounds_spans(grown), spans)
    return subtract(spans, dilate(outside, r))


def dilate_ranges(ranges: DataFrame, bounds: DataFrame, r: int, compat: bool = False) -> DataFrame:
    """Dilation of flat ranges inside their bounds' width.

    compat: flat arithmetic instead, in which ranges run over row ends and a range's own row stays as it was."""
    if compat:
        wide = normalize_ranges(ranges.select("mask_id", F.expr(f"greatest(`start` - {r}, 0L)").alias("start"), F.expr(f"`end` + {r}").alias("end")))
        moved = wide.join(bounds.select("mask_id", "bw"), "mask_id").withColumn("_dy", F.explode(F.expr(f"filter(sequence(-{r}, {r}), d -> d != 0)")))
        moved = moved.select("mask_id", F.expr("greatest(`start` + _dy * bw, 0L)").alias("start"), F.expr("`end` + _dy * bw").alias("end")).filter("`end` > `start`")
        return normalize_ranges(ranges.select("mask_id", "start", "end").unionByName(moved))
    rows = ranges.join(bounds.select("mask_id", "bw"), "mask_id").withColumn("y", F.explode(F.expr("sequence(`start` div bw, (`end` - 1) div bw)")))
    spans = rows.select("mask_id", "y", F.expr("greatest(`start` - y * bw, 0L)").alias("x_start"), F.expr("least(`end` - y * bw, bw)").alias("x_end"))
    grown = dilate(spans, r).join(bounds.select("mask_id", "bw"), "mask_id").filter("x_start < bw")
    return normalize_ranges(grown.select("mask_id", F.expr("y * bw + x_start").alias("start"), F.expr("y * bw + least(x_end, bw)").alias("end")))
