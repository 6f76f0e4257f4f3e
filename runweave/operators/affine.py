"""Affine transforms of masks.

A span is a quadrilateral between pixel centres moved by half a pixel; its image is filled row by row, edges included, in
fixed point with 8 fractional bits.  Each edge's column in a row has a closed form, so the whole transform is column
arithmetic and one explode over the rows that a span's image touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.operators.normalize import normalize

EDGES = ((0, 1), (1, 2), (2, 3), (3, 0))


def _corners(matrix, left: str, right: str, top: str, bottom: str) -> list[tuple[str, str]]:
    (a, b, c), (d, e, f) = ([float(v) for v in row] for row in matrix[:2])
    at = lambda p, q, r, x, y: f"(({p!r}D * ({x}) + {q!r}D * ({y})) + {r!r}D * 1D)"
    return [(at(a, b, c, x, y), at(d, e, f, x, y)) for x, y in ((left, top), (right, top), (right, bottom), (left, bottom))]


def affine(spans: DataFrame, matrix) -> DataFrame:
    """The mask under x' = m00 x + m01 y + m02, y' = m10 x + m11 y + m12 (a third row is not looked at); what gets negative
    coordinates is left out."""
    corners = _corners(matrix, "x_start - 0.5D", "x_end - 0.5D", "y - 0.5D", "y + 0.5D")
    fixed = {f"_{n}{k}": F.expr(f"cast(round({v} * 256D) AS BIGINT)") for k, pair in enumerate(corners) for n, v in zip("xy", pair, strict=True)}
    out = spans.select("mask_id", "y", "x_start", "x_end").withColumns(fixed)
    ys = ", ".join(f"_y{k}" for k in range(4))
    out = out.withColumns({"_top": F.expr(f"greatest(shiftright(least({ys}) + 255, 8), 0L)"), "_low": F.expr(f"shiftright(greatest({ys}), 8)")})
    out = out.filter("_top <= _low").withColumn("_r", F.explode(F.expr("sequence(_top, _low)")))
    crossings = []
    for i, j in EDGES:
        for p, q in ((i, j), (j, i)):  # from the upper end to the lower one; level edges cross nothing
            run, rise = f"(_r * 256 - _y{p}) * (_x{q} - _x{p})", f"(_y{q} - _y{p})"
            x = f"_x{p} + (({run}) - pmod({run}, {rise})) div {rise}"
            crossings.append(f"CASE WHEN _y{p} < _y{q} AND shiftright(_y{p} + 255, 8) <= _r AND _r <= shiftright(_y{q}, 8) THEN {x} END")
    for k, x in enumerate(crossings):
        out = out.withColumn(f"_c{k}", F.expr(x))
    names = [f"_c{k}" for k in range(len(crossings))]
    out = out.withColumns({"_left": F.expr("least(" + ", ".join(f"shiftright({n} + 255, 8)" for n in names) + ")"), "_right": F.expr("greatest(" + ", ".join(f"shiftright({n}, 8)" for n in names) + ")")})
    hit = out.filter("_left <= _right AND _right >= 0")
    return normalize(hit.select("mask_id", F.col("_r").alias("y"), F.expr("greatest(_left, 0L)").alias("x_start"), F.expr("_right + 1").alias("x_end")))


def affine_bounds(bounds: DataFrame, matrix) -> DataFrame:
    """Bounds of the image; a mask whose image is negative altogether has no row."""
    corners = _corners(matrix, "bx - 0.5D", "bx + bw - 0.5D", "by - 0.5D", "by + bh - 0.5D")
    x, y = (", ".join(c[k] for c in corners) for k in (0, 1))
    out = bounds.select("mask_id", *(F.expr(e).alias(n) for n, e in (("_l", f"least({x})"), ("_r", f"greatest({x})"), ("_t", f"least({y})"), ("_b", f"greatest({y})"))))
    out = out.filter("_r >= 0 AND _b >= 0").select("mask_id", F.expr("cast(ceil(greatest(_l, 0D)) AS BIGINT)").alias("bx"), F.expr("cast(ceil(greatest(_t, 0D)) AS BIGINT)").alias("by"), "_r", "_b")
    return out.select("mask_id", "bx", "by", F.expr("cast(floor(_r) AS BIGINT) + 1 - bx").alias("bw"), F.expr("cast(floor(_b) AS BIGINT) + 1 - by").alias("bh")).filter("bw > 0 AND bh > 0")
