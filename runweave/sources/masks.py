"""Masks out of bitmaps, rectangles, ranges, spans and drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.operators.dealing import deal
from runweave.operators.normalize import merge_runs, normalize_ranges

STRIP = 6  # rectangles meet in strips of 2**6 rows
RECT_ROWS = 8  # that a rectangle is taken to have when it is dealt

_ROWS = {"array": "pixels[{i}]", "bytes": "(substring(pixels, {i} + 1, 1) != X'00')"}


def _runs(bitmaps: DataFrame, kind: str, cut: bool) -> DataFrame:
    """Runs of set pixels by their ends alone: no pixel becomes a row and nothing is shuffled."""
    p = _ROWS[kind].format
    n = "cast(" + ("size(pixels)" if kind == "array" else "octet_length(pixels)") + " AS BIGINT)"
    on = lambda i: f"coalesce({p(i=i)}, false)"
    at = "filter(sequence(0L, {n} - 1), i -> {on} AND ({edge} OR NOT {next}))"
    as_int = (lambda i: f"cast({i} AS INT)") if kind == "array" else (lambda i: f"cast({i} AS INT)")
    first = at.format(n=n, on=on(as_int("i")), edge="i % width = 0" if cut else "i = 0", next=on(as_int("i - 1")))
    last = at.format(n=n, on=on(as_int("i")), edge="i % width = width - 1" if cut else f"i = {n} - 1", next=on(as_int("i + 1")))
    whole = bitmaps.filter(F.expr(f"{n} > 0"))
    if cut:
        whole = whole.filter(F.when(F.expr(f"{n} % width != 0"), F.raise_error(F.lit("pixels don't fill whole rows")).cast("boolean")).otherwise(F.lit(True)))
    runs = whole.select("mask_id", "width", F.explode(F.arrays_zip(F.expr(first).alias("s"), F.expr(last).alias("e"))).alias("r"))
    return runs.select("mask_id", F.col("width").cast("long").alias("width"), F.col("r.s").alias("start"), (F.col("r.e") + 1).alias("end"))


def bitmap_spans(bitmaps: DataFrame, kind: str = "array") -> DataFrame:
    """Spans of row-major bitmaps (mask_id, width, pixels): kind "array" of booleans or "bytes", where all but 0 is set."""
    return _runs(bitmaps, kind, True).select("mask_id", F.expr("`start` div width").alias("y"), F.expr("`start` % width").alias("x_start"), F.expr("`start` % width + `end` - `start`").alias("x_end"))


def bitmap_ranges(bitmaps: DataFrame, kind: str = "array") -> DataFrame:
    """The same as flat ranges, which may run over row ends."""
    return _runs(bitmaps, kind, False).select("mask_id", "start", "end")


def bitmap_bounds(bitmaps: DataFrame, kind: str = "array") -> DataFrame:
    n = F.size("pixels") if kind == "array" else F.octet_length("pixels")
    zero = F.lit(0).cast("long")
    return bitmaps.select("mask_id", zero.alias("bx"), zero.alias("by"), F.col("width").cast("long").alias("bw"), (n / F.col("width")).cast("long").alias("bh")).filter("bh > 0")


def rect_spans(rects: DataFrame) -> DataFrame:
    """A span for each row of each rectangle (mask_id, x, y, w, h)."""
    dealt = deal(rects, "mask_id", "y", rows=RECT_ROWS)
    return dealt.select("mask_id", F.explode(F.expr("sequence(y, y + h - 1)")).alias("y"), F.col("x").alias("x_start"), F.expr("x + w").alias("x_end"))


def rect_masks(rects: DataFrame) -> DataFrame:
    """The same in canonical form.  Rectangles are dealt by the strips of rows that they reach and become rows there: one exchange,
    of rectangles."""
    cut = rects.filter("h > 0").withColumn("_strip", F.explode(F.expr(f"sequence(shiftright(y, {STRIP}), shiftright(y + h - 1, {STRIP}))")))
    first, last = f"greatest(y, shiftleft(_strip, {STRIP}))", f"least(y + h, shiftleft(_strip + 1, {STRIP})) - 1"
    rows = deal(cut, "mask_id", "_strip", rows=RECT_ROWS).select("mask_id", "_strip", F.explode(F.expr(f"sequence({first}, {last})")).alias("y"), F.col("x").alias("x_start"), F.expr("x + w").alias("x_end"))
    return merge_runs(rows, ("mask_id", "_strip", "y"), "x_start", "x_end").drop("_strip")


def rect_ranges(rects: DataFrame, width: int) -> DataFrame:
    """Flat ranges of rectangles in a frame of that width; a rectangle of full width is one range."""
    flat = rect_spans(deal(rects, "mask_id", rows=RECT_ROWS)).select("mask_id", F.expr(f"y * {width}L + x_start").alias("start"), F.expr(f"y * {width}L + x_end").alias("end"))
    return normalize_ranges(flat)


def rect_ranges_bounds(rects: DataFrame, width: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    return rects.groupBy("mask_id").agg(F.max(F.expr("y + h")).alias("bh")).select("mask_id", zero.alias("bx"), zero.alias("by"), F.lit(width).cast("long").alias("bw"), "bh")


def from_spans(spark: SparkSession, rows: list[tuple[int, int, int, int]]) -> DataFrame:
    """(mask_id, y, x_start, x_end) as given."""
    return spark.createDataFrame(rows, "mask_id long, y long, x_start long, x_end long")


def from_ranges(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "mask_id long, start long, end long")


def from_bounds(spark: SparkSession, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "mask_id long, bx long, by long, bw long, bh long")


def single_span(spark: SparkSession, y: int, x_start: int, x_end: int, mask_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """A mask of one span, and the span as its bounds."""
    if x_start >= x_end:
        raise ValueError("the span is empty")
    spans = from_spans(spark, [(mask_id, y, x_start, x_end)])
    return spans, span_bounds(spans)


def single_range(spark: SparkSession, start: int, end: int, bounds: tuple[int, int, int, int], mask_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """A mask of one flat range in bounds that begin at (0, 0)."""
    if bounds[:2] != (0, 0):
        raise ValueError("the bounds don't begin at (0, 0)")
    if start >= end:
        raise ValueError("the range is empty")
    return from_ranges(spark, [(mask_id, start, end)]), from_bounds(spark, [(mask_id, *bounds)])


def span_bounds(spans: DataFrame) -> DataFrame:
    """Each single span as the bounds of its mask."""
    return spans.select("mask_id", F.col("x_start").alias("bx"), F.col("y").alias("by"), F.expr("x_end - x_start").alias("bw"), F.lit(1).cast("long").alias("bh"))


def from_ascii(spark: SparkSession, drawing: str, mask_id: int = 0, offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """Spans of a drawing in which # is set; lines are rows."""
    rows = []
    for y, line in enumerate(x.strip() for x in drawing.strip().splitlines()):
        x = 0
        while x < len(line):
            end = x
            while end < len(line) and line[end] == "#":
                end += 1
            if end > x:
                rows.append((mask_id, y + offset[1], x + offset[0], end + offset[0]))
            x = max(end, x + 1)
    return from_spans(spark, rows)
