"""Scalar column helpers: interval and rectangle arithmetic, size checks, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FITS = {"u8": (1 << 8) - 1, "u16": (1 << 16) - 1, "u32": (1 << 32) - 1, "u64": (1 << 63) - 1}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def floor_div(a: str, b: str) -> Column:
    """Integer division of SQL expressions that rounds down (`div` rounds towards zero); null where b is 0."""
    return F.expr(f"(({a}) - pmod({a}, nullif(abs({b}), 0))) div nullif({b}, 0)")


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Half-open intervals share a place; touching ones don't."""
    return (col(a_start) < col(b_end)) & (col(b_start) < col(a_end))


def intersection(a_start, a_end, b_start, b_end) -> Column:
    """STRUCT<start, end> of what two half-open intervals share, null if nothing."""
    shared = F.struct(F.greatest(col(a_start), col(b_start)).alias("start"), F.least(col(a_end), col(b_end)).alias("end"))
    return F.when(overlaps(a_start, a_end, b_start, b_end), shared)


def range_length(start, end) -> Column:
    return col(end) - col(start)


def range_shift(start, end, offset) -> Column:
    """STRUCT<start, end> moved by offset; an error if it would begin below 0."""
    moved = F.struct((col(start) + col(offset)).alias("start"), (col(end) + col(offset)).alias("end"))
    return F.when(col(start) + col(offset) < 0, F.raise_error(F.lit("range shifted below 0"))).otherwise(moved)


def to_inclusive(start, end) -> Column:
    return F.struct(col(start).alias("start"), (col(end) - 1).alias("end"))


def from_inclusive(start, end) -> Column:
    return F.struct(col(start).alias("start"), (col(end) + 1).alias("end"))


def from_length(start, length) -> Column:
    return F.struct(col(start).alias("start"), (col(start) + col(length)).alias("end"))


def range_json(start, end) -> Column:
    """The interval as a JSON array of two numbers."""
    return F.to_json(F.array(col(start), col(end)))


def range_from_json(text) -> Column:
    """STRUCT<start, end> out of a JSON array of two numbers; an error if it is empty or isn't one."""
    pair = F.from_json(col(text), "array<bigint>")
    good = pair.isNotNull() & (F.size(pair) == 2) & (F.get(pair, F.lit(0)) < F.get(pair, F.lit(1)))
    return F.when(good, F.struct(F.get(pair, F.lit(0)).alias("start"), F.get(pair, F.lit(1)).alias("end"))).otherwise(F.raise_error(F.lit("not a range that holds anything")))


def rect(x, y, width, height) -> Column:
    return F.struct(col(x).cast("long").alias("x"), col(y).cast("long").alias("y"), col(width).cast("long").alias("width"), col(height).cast("long").alias("height"))


def rect_end_x(r: Column) -> Column:
    return r["x"] + r["width"]


def rect_end_y(r: Column) -> Column:
    return r["y"] + r["height"]


def rect_union(a: Column, b: Column) -> Column:
    """The smallest rectangle around both."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return rect(x, y, F.greatest(rect_end_x(a), rect_end_x(b)) - x, F.greatest(rect_end_y(a), rect_end_y(b)) - y)


def rect_intersection(a: Column, b: Column) -> Column:
    """What two rectangles share; null if nothing."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    ex, ey = F.least(rect_end_x(a), rect_end_x(b)), F.least(rect_end_y(a), rect_end_y(b))
    return F.when((ex > x) & (ey > y), rect(x, y, ex - x, ey - y))


def rect_expand(r: Column, by) -> Column:
    """Grown by `by` to all sides, as far as 0 allows to the left and to the top."""
    by = col(by)
    x, y = F.greatest(r["x"] - by, F.lit(0)), F.greatest(r["y"] - by, F.lit(0))
    return rect(x, y, rect_end_x(r) + by - x, rect_end_y(r) + by - y)


def check_fits(value, kind: str) -> Column:
    """The value, or an error if it doesn't fit the unsigned type."""
    value = col(value)
    return F.when((value < 0) | (value > FITS[kind]), F.raise_error(F.concat(F.lit(f"value does not fit {kind}: "), value.cast("string")))).otherwise(value)
