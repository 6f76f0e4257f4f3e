"""Queries over the driver's tables, with SQL that must give the same rows.

The SQL mostly works on single pixels or minutes, which the engine never does, and finds runs in them at the end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runweave.frame import MapFrame, MaskFrame
from runweave.functions import columns
from runweave.operators import affine, cluster, meta, morph, normalize, reshape, setops, stats
from runweave.plans import fixtures as fx
from runweave.shipping import shared_folder
from runweave.sources import encoding, masks
from runweave.streaming import spans as streaming

ROTATE = ((0, 1, 0), (-1, 0, 7))
DOUBLE = ((2, 0, 1), (0, 2, 1))
MOVE = ((1, 0, -2), (0, 1, 3))
TURN = ((0.75, -0.5, 3.0), (0.5, 0.75, 1.0))
WIDTH = 256


def _a(spark, d):
    return normalize.normalize(fx.lines(spark, d, 0))


def _b(spark, d):
    return normalize.normalize(fx.lines(spark, d, 1))


def _r(spark, d):
    return masks.rect_masks(fx.orders(spark, d))


def _v(spark, d):
    return masks.bitmap_spans(fx.vectors(spark, d))


def _e(spark, d):
    return normalize.normalize_ranges(fx.events(spark, d).select("mask_id", "start", "end"))


def _box_a(spark, d):
    """Bounds of the masks of a, from their table: asking _a() for its masks would run it twice."""
    return _box(fx.lines(spark, d, 0))


def _month_e(spark, d):
    return _month(fx.events(spark, d))


def _box(df):
    return fx.canvas(df, 0, 0, WIDTH, 256)


def _month(df):
    return fx.canvas(df, 0, 0, 1440, 31)


def flagship(spark, sf_dir):
    """Union of two mask sets, clipped, area per mask."""
    return stats.area(reshape.clip(setops.union(fx.lines(spark, sf_dir, 0), fx.lines(spark, sf_dir, 1)), 10, 10, 150, 200))


# --- SQL building blocks: pixels of fixtures, and runs of pixels ---


def px(spans: str) -> str:
    return f"(SELECT DISTINCT mask_id, y, unnest(range(x_start, x_end)) AS x FROM {spans})"


def runs(pixels: str, keys: str = "mask_id, y", at: str = "x", start: str = "x_start", end: str = "x_end") -> str:
    return f"""SELECT {keys}, CAST(min({at}) AS BIGINT) AS "{start}", CAST(max({at}) + 1 AS BIGINT) AS "{end}"
FROM (SELECT {keys}, {at}, {at} - row_number() OVER (PARTITION BY {keys} ORDER BY {at}) AS g FROM (SELECT DISTINCT {keys}, {at} FROM {pixels})) GROUP BY {keys}, g"""


def flat(pixels: str) -> str:
    """Runs of places p."""
    return runs(pixels, "mask_id", "p", "start", "end")


PA, PB, PR, PV = px(fx.A), px(fx.B), px(fx.R_SPANS), fx.V_PIXELS
PE = f'(SELECT DISTINCT mask_id, unnest(range("start", "end")) AS p FROM {fx.E})'
MASKS_A = f"(SELECT DISTINCT mask_id FROM {fx.A})"
ALL_A = f"(SELECT mask_id, y, x FROM {MASKS_A}, (SELECT unnest(range(0, 256)) AS y), (SELECT unnest(range(0, {WIDTH})) AS x))"


def near(pixels: str, r: int, dx: str | None = None) -> str:
    return f"""(SELECT mask_id, y + dy AS y, x + dx AS x FROM {pixels}, (SELECT unnest(range(-{r}, {r + 1})) AS dy), (SELECT unnest({dx or f"range(-{r}, {r + 1})"}) AS dx) WHERE y + dy >= 0 AND x + dx >= 0)"""


def _affine_sql(spans: str, m) -> str:
    (a, b, c), (d, e, f) = m
    corner = lambda x, y: (f"({a} * ({x}) + {b} * ({y}) + {c})", f"({d} * ({x}) + {e} * ({y}) + {f})")
    pts = [corner(x, y) for x, y in (("x_start - 0.5", "y - 0.5"), ("x_end - 0.5", "y - 0.5"), ("x_end - 0.5", "y + 0.5"), ("x_start - 0.5", "y + 0.5"))]
    fixed = ", ".join(f"CAST(round(CAST({v} AS DOUBLE) * 256) AS BIGINT) AS {n}{k}" for k, p in enumerate(pts) for n, v in zip("xy", p))
    edges = " UNION ALL ".join(f"SELECT id, mask_id, x{i} AS xa, y{i} AS ya, x{j} AS xb, y{j} AS yb FROM q WHERE y{i} < y{j} UNION ALL SELECT id, mask_id, x{j}, y{j}, x{i}, y{i} FROM q WHERE y{j} < y{i}" for i, j in affine.EDGES)
    return f"""WITH s AS ({spans}), q AS (SELECT row_number() OVER () AS id, mask_id, {fixed} FROM s), e AS ({edges}),
h AS (SELECT id, mask_id, unnest(range(CAST(ceil(ya / 256.0) AS BIGINT), CAST(floor(yb / 256.0) AS BIGINT) + 1)) AS y, xa, ya, xb, yb FROM e),
c AS (SELECT id, mask_id, y, xa + CAST(floor(CAST((y * 256 - ya) * (xb - xa) AS DOUBLE) / (yb - ya)) AS BIGINT) AS x FROM h),
t AS (SELECT mask_id, y, min(CAST(ceil(x / 256.0) AS BIGINT)) AS l, max(CAST(floor(x / 256.0) AS BIGINT)) AS r FROM c GROUP BY id, mask_id, y),
p AS (SELECT DISTINCT mask_id, y, unnest(range(greatest(l, 0), r + 1)) AS x FROM t WHERE l <= r AND r >= 0 AND y >= 0) {runs("p")}"""


LE = lambda v, n: "(" + " || ".join(f"lpad(to_hex(({v} >> {8 * k}) & 255), 2, '0')" for k in range(n)) + ")"
GAPS = f"""SELECT mask_id, "start", "start" - coalesce(lag("end") OVER (PARTITION BY mask_id ORDER BY "start"), 0) AS gap, "end" - "start" AS len FROM ({flat(PE)})"""
CLUSTERS = f"""RECURSIVE p AS MATERIALIZED (SELECT mask_id, y, x, y * 8 + x AS id FROM {PV}),
e AS MATERIALIZED (SELECT a.mask_id, a.id AS a, b.id AS b FROM p a JOIN p b ON a.mask_id = b.mask_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
w AS (SELECT mask_id, id, id AS c FROM p UNION SELECT w.mask_id, e.b, w.c FROM w JOIN e ON e.mask_id = w.mask_id AND e.a = w.id),
l AS (SELECT mask_id, id, min(c) AS cluster_id FROM w GROUP BY mask_id, id)"""
META = f"""WITH c AS (SELECT mask_id, p, max_by(meta, priority) AS meta FROM (SELECT mask_id, unnest(range("start", "end")) AS p, meta, priority FROM {fx.E}) GROUP BY mask_id, p)
SELECT mask_id, CAST(min(p) AS BIGINT) AS "start", CAST(max(p) + 1 AS BIGINT) AS "end", meta FROM (SELECT mask_id, p, meta, p - row_number() OVER (PARTITION BY mask_id, meta ORDER BY p) AS g FROM c) GROUP BY mask_id, meta, g"""

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


# --- sources ---


@_query(runs(PV))
def bitmap_spans(spark, d):
    return _v(spark, d)


@_query(flat(f"(SELECT mask_id, y * 8 + x AS p FROM {PV})"))
def bitmap_ranges(spark, d):
    return masks.bitmap_ranges(fx.vectors(spark, d))


@_query(runs(PV))
def bitmap_bytes_spans(spark, d):
    hexed = "unhex(array_join(transform(pixels, p -> if(p, '01', '00')), ''))"
    return masks.bitmap_spans(fx.vectors(spark, d).withColumn("pixels", F.expr(hexed)), "bytes")


@_query(flat(f"(SELECT mask_id, y * 8 + x AS p FROM {PV})"))
def bitmap_bytes_ranges(spark, d):
    hexed = "unhex(array_join(transform(pixels, p -> if(p, '02', '00')), ''))"
    return masks.bitmap_ranges(fx.vectors(spark, d).withColumn("pixels", F.expr(hexed)), "bytes")


@_query("SELECT CAST(vec_id AS BIGINT) AS mask_id, CAST(0 AS BIGINT) AS bx, CAST(0 AS BIGINT) AS by, CAST(8 AS BIGINT) AS bw, CAST(8 AS BIGINT) AS bh FROM embeddings")
def bitmap_bounds(spark, d):
    return masks.bitmap_bounds(fx.vectors(spark, d))


@_query(runs(PR))
def rect_spans(spark, d):
    return _r(spark, d)


@_query(flat(f"(SELECT mask_id, y * {WIDTH} + x AS p FROM {PR})"))
def rect_ranges(spark, d):
    return masks.rect_ranges(fx.orders(spark, d), WIDTH)


# --- run algebra ---


@_query(runs(PA))
def span_normalize(spark, d):
    return _a(spark, d)


@_query(runs(f"(SELECT * FROM {PA} UNION SELECT * FROM {PB})"))
def span_union(spark, d):
    return setops.union(fx.lines(spark, d, 0), fx.lines(spark, d, 1))


@_query(runs(f"(SELECT * FROM {PA} UNION SELECT * FROM {PB} UNION SELECT * FROM {PR})"))
def union_all(spark, d):
    return setops.union_all([fx.lines(spark, d, 0), fx.lines(spark, d, 1), masks.rect_spans(fx.orders(spark, d))])


@_query(runs(f"(SELECT mask_id % 7 AS mask_id, y, x FROM {PA})"))
def union_layers(spark, d):
    return setops.union_layers(fx.lines(spark, d, 0).withColumn("group", F.col("mask_id") % 7), "mask_id", "group")


@_query(runs(f"(SELECT * FROM {PA} INTERSECT SELECT * FROM {PB})"))
def span_intersect(spark, d):
    return setops.intersect(fx.lines(spark, d, 0), fx.lines(spark, d, 1))


@_query(runs(f"(SELECT * FROM {PA} INTERSECT SELECT * FROM {PB})"))
def span_intersect_join(spark, d):
    return setops.intersect_join(_a(spark, d), _b(spark, d))


@_query(runs(f"(SELECT * FROM {PA} EXCEPT SELECT * FROM {PB})"))
def span_subtract(spark, d):
    return setops.subtract(fx.lines(spark, d, 0), fx.lines(spark, d, 1))


@_query(runs(f"((SELECT * FROM {PA} EXCEPT SELECT * FROM {PB}) UNION ALL (SELECT * FROM {PB} EXCEPT SELECT * FROM {PA}))"))
def span_xor(spark, d):
    return setops.xor(fx.lines(spark, d, 0), fx.lines(spark, d, 1))


@_query(runs(f"(SELECT * FROM {ALL_A} EXCEPT SELECT * FROM {PA})"))
def complement(spark, d):
    return setops.complement(fx.lines(spark, d, 0), _box_a(spark, d))


@_query(flat(f"(SELECT mask_id, p FROM {PE} UNION SELECT mask_id, p + 700 AS p FROM {PE})"))
def range_union(spark, d):
    e = _e(spark, d)
    return setops.range_union(e, reshape.shift_ranges(e, 700))


@_query(flat(f"(SELECT mask_id, p FROM {PE} INTERSECT SELECT mask_id, p + 30 AS p FROM {PE})"))
def range_intersection(spark, d):
    e = _e(spark, d)
    return setops.range_intersection(e, reshape.shift_ranges(e, 30))


@_query(flat(f"(SELECT mask_id, p FROM {PE} EXCEPT SELECT mask_id, p + 30 AS p FROM {PE})"))
def range_difference(spark, d):
    e = _e(spark, d)
    return setops.range_difference(e, reshape.shift_ranges(e, 30))


@_query(flat(f"((SELECT mask_id, p FROM {PE} EXCEPT SELECT mask_id, p + 30 AS p FROM {PE}) UNION ALL (SELECT mask_id, p + 30 AS p FROM {PE} EXCEPT SELECT mask_id, p FROM {PE}))"))
def range_symmetric_difference(spark, d):
    e = _e(spark, d)
    return setops.range_symmetric_difference(e, reshape.shift_ranges(e, 30))


@_query(flat(f"(SELECT mask_id, p FROM (SELECT DISTINCT mask_id FROM {fx.E}), (SELECT unnest(range(0, 1440 * 31)) AS p) EXCEPT SELECT mask_id, p FROM {PE})"))
def range_complement(spark, d):
    e = _e(spark, d)
    return setops.range_complement(e, _month_e(spark, d))


# --- reshaping ---


@_query(runs(f"(SELECT * FROM {PA} WHERE x >= 20 AND x < 120 AND y >= 30 AND y < 200)"))
def clip(spark, d):
    return reshape.clip(_a(spark, d), 20, 30, 100, 170)


@_query(flat(f"(SELECT mask_id, y * {WIDTH} + x AS p FROM {PA})"))
def into_ranges(spark, d):
    a = _a(spark, d)
    return reshape.into_ranges(a, _box_a(spark, d))


@_query(runs(f"(SELECT mask_id, p // 1440 AS y, p % 1440 AS x FROM {PE})"))
def ranges_to_spans(spark, d):
    e = _e(spark, d)
    return reshape.ranges_to_spans(e, _month_e(spark, d))


@_query(runs(f"(SELECT mask_id, p // 1440 AS y, p % 1440 AS x FROM {PE})"))
def typed_spans(spark, d):
    e = _e(spark, d)
    return reshape.typed_spans(e, _month_e(spark, d), "u32")


@_query(runs(f"(SELECT mask_id, p // 1440 AS y, p FROM {PE})", "mask_id, y", "p", "start", "end").replace("SELECT mask_id, y,", "SELECT mask_id,", 1))
def split_rows(spark, d):
    return reshape.split_rows(_e(spark, d), 1440)


def _reproject_sql(width: int) -> str:
    return flat(f"(SELECT mask_id, y * {width} + x AS p FROM {PA} WHERE x < {width})")


@_query(_reproject_sql(100))
def reproject_narrow(spark, d):
    return reshape.reproject(_a(spark, d), 100)


@_query(_reproject_sql(256))
def reproject_equal(spark, d):
    return reshape.reproject(_a(spark, d), 256)


@_query(_reproject_sql(300))
def reproject_wide(spark, d):
    return reshape.reproject(_a(spark, d), 300)


@_query(flat(PE))
def sanitize_ranges(spark, d):
    return reshape.sanitize(fx.events(spark, d).select("mask_id", "start", "end"))


@_query(flat(f"(SELECT mask_id, p + 5 AS p FROM {PE})"))
def transform_ranges(spark, d):
    return reshape.transform_ranges(_e(spark, d), lambda r: reshape.shift_ranges(r, 5))


@_query(flat(f"(SELECT mask_id, p FROM {PE} WHERE p // 1440 % 7 <> 3)"))
def transform_spans(spark, d):
    e = _e(spark, d)
    return reshape.transform_spans(e, _month_e(spark, d), lambda s: s.filter("y % 7 != 3"))


@_query(runs(PA))
def validate_spans(spark, d):
    a = _a(spark, d)
    return normalize.validate(a, _box_a(spark, d))


@_query(f"""SELECT a.mask_id, a.y, greatest(a.x_start, b.x_start) AS "start", least(a.x_end, b.x_end) AS "end" FROM ({runs(PA)}) a JOIN ({runs(PB)}) b ON a.mask_id = b.mask_id AND a.y = b.y AND a.x_start < b.x_end AND b.x_start < a.x_end""")
def interval_predicates(spark, d):
    b = _b(spark, d).select("mask_id", "y", F.col("x_start").alias("s"), F.col("x_end").alias("e"))
    both = _a(spark, d).join(b, ["mask_id", "y"]).filter(columns.overlaps("x_start", "x_end", "s", "e"))
    return both.withColumn("i", columns.intersection("x_start", "x_end", "s", "e")).select("mask_id", "y", "i.start", "i.end")


@_query(f"""SELECT mask_id, '[' || "start" || ',' || "end" || ']' AS json, "start" AS first, "end" - 1 AS last, "end" - "start" AS len FROM ({flat(PE)})""")
def range_arithmetic(spark, d):
    json = _e(spark, d).withColumn("json", columns.range_json("start", "end"))
    back = json.select("mask_id", "json", columns.range_from_json("json").alias("r")).select("mask_id", "json", columns.to_inclusive("r.start", "r.end").alias("i"), columns.range_length("r.start", "r.end").alias("len"))
    return back.select("mask_id", "json", F.col("i.start").alias("first"), F.col("i.end").alias("last"), "len")


@_query(f"""SELECT mask_id, "start" + 7 AS s, "end" + 7 AS e, "start" AS a, "end" AS b, "start" AS c, "end" AS d FROM ({flat(PE)})""")
def range_forms(spark, d):
    moved = _e(spark, d).withColumn("m", columns.range_shift("start", "end", 7)).withColumn("i", columns.to_inclusive("start", "end"))
    back = moved.withColumn("x", columns.from_inclusive("i.start", "i.end")).withColumn("y", columns.from_length("start", columns.range_length("start", "end")))
    return back.selectExpr("mask_id", "m.start AS s", "m.end AS e", "x.start AS a", "x.end AS b", "y.start AS c", "y.end AS d")


@_query("""SELECT CAST(o_orderkey AS BIGINT) AS o, CAST(greatest(x - 5, 0) AS BIGINT) AS x, CAST(greatest(y - 5, 0) AS BIGINT) AS y, CAST(x + w + 5 - greatest(x - 5, 0) AS BIGINT) AS w, CAST(y + h + 5 - greatest(y - 5, 0) AS BIGINT) AS h,
 CAST(least(x, 50) AS BIGINT) AS ux, CAST(greatest(x + w, 60) - least(x, 50) AS BIGINT) AS uw, CAST(coalesce(CASE WHEN x < 60 AND x + w > 50 AND y < 80 AND y + h > 40 THEN least(x + w, 60) - greatest(x, 50) END, 0) AS BIGINT) AS iw
FROM (SELECT o_orderkey, o_custkey % 200 + o_orderkey % 13 AS x, o_orderkey % 200 AS y, 1 + o_orderkey % 17 AS w, 1 + o_custkey % 11 AS h FROM orders)""")
def rect_arithmetic(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("CAST(o_orderkey AS BIGINT) AS o", "o_custkey % 200 + o_orderkey % 13 AS x", "o_orderkey % 200 AS y", "1 + o_orderkey % 17 AS w", "1 + o_custkey % 11 AS h")
    r, s = columns.rect("x", "y", "w", "h"), columns.rect(50, 40, 10, 40)
    e, u, i = columns.rect_expand(r, 5), columns.rect_union(r, s), columns.rect_intersection(r, s)
    return o.select("o", e["x"].alias("x"), e["y"].alias("y"), e["width"].alias("w"), e["height"].alias("h"), u["x"].alias("ux"), u["width"].alias("uw"), F.coalesce(i["width"], F.lit(0)).alias("iw"))


# --- bounds as results ---


def _bounds_sql(box: str) -> str:
    return f"SELECT mask_id, CAST(min(x) AS BIGINT) AS bx, CAST(min(y) AS BIGINT) AS by, CAST(max(x) + 1 - min(x) AS BIGINT) AS bw, CAST(max(y) + 1 - min(y) AS BIGINT) AS bh FROM {box} GROUP BY mask_id"


@_query(_bounds_sql(PA))
def bounds_inspect(spark, d):
    return stats.inspect_bounds(fx.lines(spark, d, 0))


@_query(f"""SELECT mask_id, CAST(min(x0) AS BIGINT) AS bx, CAST(min(y0) AS BIGINT) AS by, CAST(max(x1) - min(x0) AS BIGINT) AS bw, CAST(max(y1) + 1 - min(y0) AS BIGINT) AS bh FROM (SELECT mask_id, "start" // 1440 AS y0, ("end" - 1) // 1440 AS y1,
 CASE WHEN "start" // 1440 = ("end" - 1) // 1440 THEN "start" % 1440 ELSE 0 END AS x0, CASE WHEN "start" // 1440 = ("end" - 1) // 1440 THEN ("end" - 1) % 1440 + 1 ELSE 1440 END AS x1 FROM ({flat(PE)})) GROUP BY mask_id""")
def range_bounds_inspect(spark, d):
    e = _e(spark, d)
    return stats.inspect_range_bounds(e, _month_e(spark, d))


@_query(_bounds_sql(f"(SELECT * FROM {PA} UNION ALL SELECT * FROM {PB})"))
def bounds_union(spark, d):
    return setops.union_bounds(stats.inspect_bounds(fx.lines(spark, d, 0)), stats.inspect_bounds(fx.lines(spark, d, 1)))


@_query(f"""SELECT a.mask_id, greatest(a.bx, b.bx) AS bx, greatest(a.by, b.by) AS by, least(a.bx + a.bw, b.bx + b.bw) - greatest(a.bx, b.bx) AS bw, least(a.by + a.bh, b.by + b.bh) - greatest(a.by, b.by) AS bh
FROM ({_bounds_sql(PA)}) a JOIN ({_bounds_sql(PR)}) b USING (mask_id) WHERE a.bx < b.bx + b.bw AND b.bx < a.bx + a.bw AND a.by < b.by + b.bh AND b.by < a.by + a.bh""")
def bounds_intersect(spark, d):
    return setops.intersect_bounds(stats.inspect_bounds(fx.lines(spark, d, 0)), stats.inspect_bounds(_r(spark, d)))


@_query(f"""SELECT mask_id, greatest(bx - 4, 0) AS bx, greatest("by" - 4, 0) AS "by", bx + bw + 4 - greatest(bx - 4, 0) AS bw, "by" + bh + 4 - greatest("by" - 4, 0) AS bh FROM ({_bounds_sql(PR)})""")
def bounds_dilate(spark, d):
    return morph.dilate_bounds(stats.inspect_bounds(_r(spark, d)), 2, 2)


@_query(f"""SELECT mask_id, CAST(0 AS BIGINT) AS bx, CAST(0 AS BIGINT) AS by, CAST(100 AS BIGINT) AS bw, "by" + bh AS bh FROM ({_bounds_sql(PA)})""")
def bounds_reproject(spark, d):
    return reshape.reproject_bounds(stats.inspect_bounds(fx.lines(spark, d, 0)), 100)


# --- morphology and geometry ---


@_query(runs(near(PV, 1)))
def dilate_r1(spark, d):
    return morph.dilate(_v(spark, d), 1)


@_query(runs(near(PV, 3)))
def dilate_r3(spark, d):
    return morph.dilate(_v(spark, d), 3)


@_query(runs(near(PV, 9)))
def dilate_r9(spark, d):
    return morph.dilate(_v(spark, d), 9)


@_query(runs(near(PV, 2, "range(0, 5)")))
def dilate_translated(spark, d):
    return morph.dilate(_v(spark, d), 2, morph.translated)


@_query(runs(f"(SELECT * FROM {near(PR, 2)} WHERE x >= 40 AND x < 120 AND y >= 50 AND y < 130)"))
def dilate_clip(spark, d):
    return morph.dilate(_r(spark, d), 2, clip_to=(40, 50, 80, 80))


@_query(flat(f"(SELECT mask_id, y * 8 + x AS p FROM {near(PV, 2)} WHERE x < 8)"))
def dilate_ranges(spark, d):
    v = fx.vectors(spark, d)
    return morph.dilate_ranges(masks.bitmap_ranges(v), masks.bitmap_bounds(v), 2)


@_query(
    flat(
        f"""(WITH f AS (SELECT mask_id, y * 8 + x AS p FROM {PV}), x AS (SELECT DISTINCT mask_id, p + dx AS p FROM f, (SELECT unnest(range(-1, 2)) AS dx) WHERE p + dx >= 0)
SELECT mask_id, p FROM f UNION SELECT mask_id, p + dy AS p FROM x, (SELECT unnest([-8, 8]) AS dy) WHERE p + dy >= 0)"""
    )
)
def dilate_ranges_compat(spark, d):
    v = fx.vectors(spark, d)
    return morph.dilate_ranges(masks.bitmap_ranges(v), masks.bitmap_bounds(v), 1, compat=True)


@_query(runs(f"(SELECT * FROM {PV} EXCEPT SELECT mask_id, y - 10, x - 10 FROM {near('(SELECT mask_id, y + 10 AS y, x + 10 AS x FROM (SELECT mask_id, y, x FROM (SELECT CAST(vec_id AS BIGINT) AS mask_id FROM embeddings), (SELECT unnest(range(-1, 9)) AS y), (SELECT unnest(range(-1, 9)) AS x) EXCEPT SELECT * FROM ' + PV + '))', 1)})"))
def erode(spark, d):
    # the bitmaps stand one off the frame's edge, where the outside has room to be seen
    moved = _v(spark, d).selectExpr("mask_id", "y + 1 AS y", "x_start + 1 AS x_start", "x_end + 1 AS x_end")
    out = morph.erode(moved, fx.canvas(masks.bitmap_bounds(fx.vectors(spark, d)), 1, 1, 8, 8), 1)
    return out.selectExpr("mask_id", "y - 1 AS y", "x_start - 1 AS x_start", "x_end - 1 AS x_end")


@_query(_affine_sql(runs(PV), ROTATE))
def affine_rot90(spark, d):
    return affine.affine(_v(spark, d), ROTATE)


@_query(_affine_sql(runs(PV), DOUBLE))
def affine_scale2(spark, d):
    return affine.affine(_v(spark, d), DOUBLE)


@_query(_affine_sql(runs(PV), MOVE))
def affine_translate(spark, d):
    return affine.affine(_v(spark, d), MOVE)


@_query(_affine_sql(runs(PV), TURN))
def affine_turn(spark, d):
    return affine.affine(_v(spark, d), TURN)


@_query("SELECT CAST(vec_id AS BIGINT) AS mask_id, CAST(0 AS BIGINT) AS bx, CAST(1 AS BIGINT) AS by, CAST(9 AS BIGINT) AS bw, CAST(10 AS BIGINT) AS bh FROM embeddings")
def affine_bounds(spark, d):
    # corners x' in -1.125 .. 8.875 and y' in 0.375 .. 10.375
    return affine.affine_bounds(masks.bitmap_bounds(fx.vectors(spark, d)), TURN)


@_query(f"WITH {CLUSTERS} SELECT mask_id, cluster_id, y, min(x) AS x_start, max(x) + 1 AS x_end FROM (SELECT p.mask_id, l.cluster_id, p.y, p.x, p.x - row_number() OVER (PARTITION BY p.mask_id, p.y ORDER BY p.x) AS g FROM p JOIN l ON p.mask_id = l.mask_id AND p.id = l.id) GROUP BY mask_id, cluster_id, y, g")
def cluster_labels(spark, d):
    return cluster.cluster(_v(spark, d), 8, strip=3)


@_query(f"WITH {CLUSTERS} SELECT p.mask_id, l.cluster_id, min(p.x) AS bx, min(p.y) AS by, max(p.x) + 1 - min(p.x) AS bw, max(p.y) + 1 - min(p.y) AS bh FROM p JOIN l ON p.mask_id = l.mask_id AND p.id = l.id GROUP BY p.mask_id, l.cluster_id")
def cluster_bounds(spark, d):
    return cluster.cluster_bounds(cluster.cluster(_v(spark, d), 8))


# --- encodings ---


@_query(f'SELECT mask_id, "start", gap, len FROM ({GAPS})')
def range_offsets(spark, d):
    return encoding.to_offsets(_e(spark, d))


@_query(f"SELECT mask_id, string_agg(CAST(len AS VARCHAR), ',' ORDER BY \"start\") AS included, string_agg(CAST(gap AS VARCHAR), ',' ORDER BY \"start\") AS excluded FROM ({GAPS}) GROUP BY mask_id")
def encode_gaps(spark, d):
    return encoding.encode_gaps(_e(spark, d)).select("mask_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("included", "excluded")))


@_query(flat(PE))
def decode_gaps(spark, d):
    return encoding.decode_gaps(encoding.encode_gaps(_e(spark, d)))


@_query(flat(f"(SELECT mask_id, y * {WIDTH} + x AS p FROM {PA})"))
def encode_spans(spark, d):
    a = _a(spark, d)
    return encoding.decode_gaps(encoding.encode_spans(a, _box_a(spark, d)))


WIRE_HEAD = "'010000' || " + " || ".join(LE(v, 4) for v in ("0", "0", "1440", "31"))


@_query(f"""SELECT mask_id, upper({WIRE_HEAD} || string_agg({LE("gap", 8)} || {LE("len", 8)}, '' ORDER BY "start") || '{"0" * 32}') AS payload FROM ({GAPS}) GROUP BY mask_id""")
def wire_encode(spark, d):
    e = _e(spark, d)
    return encoding.wire_encode(e, _month_e(spark, d)).withColumn("payload", F.hex("payload"))


@_query(f"""SELECT mask_id, upper({WIRE_HEAD} || string_agg({LE("gap", 8)} || {LE("len", 8)}, '' ORDER BY "start")) AS payload FROM ({GAPS}) GROUP BY mask_id""")
def wire_encode_open(spark, d):
    e = _e(spark, d)
    return encoding.wire_encode(e, _month_e(spark, d), terminator=False).withColumn("payload", F.hex("payload"))


@_query(flat(PE))
def wire_decode(spark, d):
    e = _e(spark, d)
    return encoding.wire_decode(encoding.wire_encode(e, _month_e(spark, d)))


@_query(f"SELECT DISTINCT mask_id, CAST(0 AS BIGINT) AS bx, CAST(0 AS BIGINT) AS by, CAST(1440 AS BIGINT) AS bw, CAST(31 AS BIGINT) AS bh FROM {fx.E}")
def wire_header(spark, d):
    e = _e(spark, d)
    return encoding.wire_header(encoding.wire_encode(e, _month_e(spark, d)))


# --- metadata, counts and folds ---


@_query(META)
def meta_union_priority(spark, d):
    return meta.priority_union(fx.events(spark, d))


@_query(f"""WITH c AS (SELECT mask_id, p, max_by(meta, priority) AS meta FROM (SELECT mask_id, unnest(range("start", "end")) AS p, meta, priority FROM {fx.E}) GROUP BY mask_id, p),
u AS (SELECT coalesce(b.mask_id, a.mask_id) AS mask_id, coalesce(b.p, a.p) AS p, coalesce(b.meta, a.meta) AS meta FROM c a FULL JOIN (SELECT mask_id, p + 45 AS p, meta FROM c) b ON a.mask_id = b.mask_id AND a.p = b.p)
SELECT mask_id, CAST(min(p) AS BIGINT) AS "start", CAST(max(p) + 1 AS BIGINT) AS "end", meta FROM (SELECT mask_id, p, meta, p - row_number() OVER (PARTITION BY mask_id, meta ORDER BY p) AS g FROM u) GROUP BY mask_id, meta, g""")
def meta_union_over(spark, d):
    m = meta.priority_union(fx.events(spark, d))
    return meta.union_over(m, reshape.shift_ranges(m, 45))


@_query(f"""SELECT mask_id, CAST(count(*) AS BIGINT) AS n, string_agg(meta, ',' ORDER BY "start") AS metas, string_agg(CAST(gap AS VARCHAR), ',' ORDER BY "start") AS gaps
FROM (SELECT *, "start" - coalesce(lag("end") OVER (PARTITION BY mask_id ORDER BY "start"), 0) AS gap FROM (SELECT mask_id, "start", "end", CAST("end" - "start" AS VARCHAR) AS meta FROM ({flat(PE)}))) GROUP BY mask_id""")
def meta_encode(spark, d):
    e = _e(spark, d).withColumn("meta", (F.col("end") - F.col("start")).cast("string"))
    coded = encoding.encode_gaps(meta.check_map(e), extra=("meta",))
    return coded.select("mask_id", F.size("meta").cast("long").alias("n"), F.array_join("meta", ",").alias("metas"), F.array_join(F.col("excluded").cast("array<string>"), ",").alias("gaps"))


@_query(f"SELECT mask_id, CAST(count(*) AS BIGINT) AS area FROM {PA} GROUP BY mask_id")
def mask_area(spark, d):
    return stats.area(_a(spark, d))


@_query(f"SELECT mask_id, CAST(count(*) AS BIGINT) AS runs FROM ({runs(PA)}) GROUP BY mask_id")
def run_count(spark, d):
    return stats.run_count(_a(spark, d))


@_query(f"SELECT mask_id, CAST(max(x_end - x_start) AS BIGINT) AS longest FROM ({runs(PA)}) GROUP BY mask_id")
def fold_masks(spark, d):
    import pandas as pd

    def longest(frame):
        return pd.DataFrame({"mask_id": [frame["mask_id"].iloc[0]], "longest": [int((frame["x_end"] - frame["x_start"]).max())]})

    return stats.fold_masks(_a(spark, d), longest, "mask_id long, longest long")


@_query(f"SELECT mask_id, CAST(count(*) AS BIGINT) AS area FROM (SELECT * FROM {PA} UNION SELECT * FROM {PB}) WHERE x >= 10 AND x < 160 AND y >= 10 AND y < 210 GROUP BY mask_id")
def union_clip_area(spark, d):
    return flagship(spark, d)


@_query(flat(f"(SELECT mask_id, y * {WIDTH} + x AS p FROM (SELECT * FROM {near(f'(SELECT * FROM {PA} UNION SELECT * FROM {PB})', 1)} EXCEPT SELECT * FROM {PR}) WHERE x >= 5 AND x < 200 AND y >= 5 AND y < 150)"))
def pipeline_union_dilate_subtract_clip(spark, d):
    # what can't reach the clip by a step of 1 goes before the dilation
    near = {"x": 4, "y": 4, "width": 197, "height": 147}
    lines = fx.lines(spark, d, 0).unionByName(fx.lines(spark, d, 1))
    grown = morph.dilate(setops.union(*(reshape.clip(fx.lines(spark, d, k), **near) for k in (0, 1))), 1, clip_to=(5, 5, 195, 145))
    out = setops.subtract(grown, reshape.clip(masks.rect_spans(fx.orders(spark, d)), 5, 5, 195, 145))
    return reshape.into_ranges(out, _box(lines))


# --- single masks, builders, files and streams ---


@_query("SELECT CAST(7 AS BIGINT) AS mask_id, CAST(5 AS BIGINT) AS y, CAST(3 AS BIGINT) AS x_start, CAST(9 AS BIGINT) AS x_end, CAST(3 AS BIGINT) AS bx, CAST(5 AS BIGINT) AS by, CAST(6 AS BIGINT) AS bw, CAST(1 AS BIGINT) AS bh")
def single_span(spark, d):
    spans, bounds = masks.single_span(spark, 5, 3, 9, 7)
    return spans.join(bounds, "mask_id")


@_query('SELECT CAST(7 AS BIGINT) AS mask_id, CAST(y AS BIGINT) AS y, CAST(a AS BIGINT) AS x_start, CAST(b AS BIGINT) AS x_end FROM (VALUES (1, 5, 10), (2, 0, 10), (3, 0, 4)) AS t(y, a, b)')
def single_range(spark, d):
    return reshape.ranges_to_spans(*masks.single_range(spark, 15, 34, (0, 0, 10, 9), 7))


@_query("SELECT CAST(0 AS BIGINT) AS mask_id, CAST(y AS BIGINT) AS y, CAST(a AS BIGINT) AS x_start, CAST(b AS BIGINT) AS x_end FROM (VALUES (4, 7, 9), (4, 10, 11), (6, 6, 11)) AS t(y, a, b)")
def ascii_spans(spark, d):
    return masks.from_ascii(spark, """
.##.#
.....
#####
""", offset=(6, 4))


_EVEN_RECTS = flat(f"(SELECT mask_id, y * 300 + x AS p FROM {PR} WHERE mask_id % 2 = 0)")


@_query(f'SELECT f.mask_id, f."start", f."end", CAST(300 AS BIGINT) AS bw, b.bh FROM ({_EVEN_RECTS}) f JOIN (SELECT mask_id, max(y + h) AS bh FROM {fx.R} GROUP BY mask_id) b USING (mask_id)')
def rect_ranges_bounds(spark, d):
    rects = fx.orders(spark, d).filter("mask_id % 2 = 0")
    return masks.rect_ranges(rects, 300).join(masks.rect_ranges_bounds(rects, 300).select("mask_id", "bw", "bh"), "mask_id")


_SEQ = 'CASE WHEN mask_id % 2 = 0 THEN "start" ELSE -"start" END'


@_query(f"""WITH o AS (SELECT *, max("end") OVER (PARTITION BY mask_id ORDER BY {_SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({flat(PE)})),
e AS (SELECT mask_id, count(*) FILTER (WHERE "start" < coalesce(b, 0)) AS n FROM o GROUP BY mask_id),
l AS (SELECT mask_id, string_agg(CAST(len AS VARCHAR), ',' ORDER BY "start") AS included, string_agg(CAST(gap AS VARCHAR), ',' ORDER BY "start") AS excluded FROM ({GAPS}) GROUP BY mask_id)
SELECT mask_id, CASE WHEN n = 0 THEN included END AS included, CASE WHEN n = 0 THEN excluded END AS excluded, CASE WHEN n > 0 THEN 'range starts before the end of the one before' END AS error FROM e JOIN l USING (mask_id)""")
def build_masks(spark, d):
    e = _e(spark, d).withColumn("seq", F.expr("if(mask_id % 2 = 0, `start`, -`start`)"))
    return encoding.build_masks(e, "seq").select("mask_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("included", "excluded")), "error")


def _wire_files(spark, d):
    folder = f"{shared_folder(spark)}/masks-{uuid.uuid4().hex}"
    encoding.write_wire_files(encoding.wire_encode(_e(spark, d), _month_e(spark, d), terminator=False), folder)
    return folder


def _by_name(files):
    return files.withColumn("mask_id", F.regexp_extract("path", r"(\d+)\.mask$", 1).cast("long"))


@_query(flat(PE))
def wire_files(spark, d):
    return encoding.wire_decode(_by_name(encoding.read_wire(spark, _wire_files(spark, d))))


@_query(flat(PE))
def wire_files_stream(spark, d):
    return streaming.run_to_end(encoding.wire_decode(_by_name(encoding.read_wire_stream(spark, _wire_files(spark, d)))))


@_query("SELECT CAST(1 AS BIGINT) AS mask_id, '9223372036854775808' AS \"start\", '18446744073709551615' AS \"end\"")
def wire_decode_wide(spark, d):
    raw = bytes([1, 0, 0]) + b"".join(x.to_bytes(4, "little") for x in (0, 0, 9, 9)) + (1 << 63).to_bytes(8, "little") + ((1 << 63) - 1).to_bytes(8, "little")
    rows = spark.sql("SELECT 1L AS mask_id, unhex(:raw) AS payload", args={"raw": raw.hex()})
    return encoding.wire_decode(rows, wide=True).select("mask_id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


def _ending(spans, first: str):
    """Each row twice, once with a null that says that its mask ends: what comes in one batch is whole."""
    return spans.withColumn(first, F.explode(F.array(F.col(first), F.lit(None).cast("long"))))


@_query(runs(PA))
def stream_normalize(spark, d):
    return streaming.run_to_end(streaming.normalize_stream(_ending(fx.line_spans(fx.stream(spark, d, "lineitem"), 0), "y")))


@_query(SQL["cluster_labels"])
def stream_clusters(spark, d):
    spans = masks.bitmap_spans(fx.vector_bitmaps(fx.stream(spark, d, "embeddings")))
    return streaming.run_to_end(streaming.cluster_stream(_ending(spans, "y"), 8))


@_query(SQL["encode_gaps"])
def stream_masks(spark, d):
    folder = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    _e(spark, d).write.parquet(folder)
    ranges = spark.readStream.schema("mask_id long, start long, end long").parquet(folder)
    out = streaming.run_to_end(streaming.mask_stream(_ending(ranges, "start")))
    return out.select("mask_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("included", "excluded")))


# --- frames, views and parameters ---


@_query(f"SELECT mask_id, y, x_start, x_end, CAST(10 AS BIGINT) AS bx, CAST(20 AS BIGINT) AS by, CAST(30 AS BIGINT) AS bw, CAST(40 AS BIGINT) AS bh FROM ({runs(PA)})")
def with_roi(spark, d):
    m = MaskFrame(_a(spark, d), _box_a(spark, d)).with_roi(10, 20, 30, 40)
    return m.spans.join(m.bounds, "mask_id")


@_query(f"SELECT mask_id, count(*) AS runs, CAST(0 AS BIGINT) AS bx, CAST(0 AS BIGINT) AS by, CAST(100 AS BIGINT) AS bw, CAST(50 AS BIGINT) AS bh FROM ({runs(PA)}) GROUP BY mask_id")
def with_bounds(spark, d):
    m = MaskFrame(_a(spark, d), _box_a(spark, d)).with_bounds(100, 50)
    return m.run_count().join(m.bounds, "mask_id")


@_query(f"SELECT mask_id, y, x_start, x_end, CAST(1 AS BIGINT) AS bx, CAST(1 AS BIGINT) AS by, CAST(8 AS BIGINT) AS bw, CAST(8 AS BIGINT) AS bh FROM ({runs(near(PV, 1))})")
def dilate_within(spark, d):
    v = fx.vectors(spark, d)
    m = MaskFrame.of_bitmaps(v).dilate_within(1, 2, 2, 6, 6)
    return m.spans.join(m.bounds, "mask_id")


@_query(flat(PE))
def validate_sorted(spark, d):
    return normalize.validate_sorted(_e(spark, d), "start", "start")


@_query(f"""SELECT '[' || string_agg('(' || mask_id || ', ' || y || ', ' || x_start || ', ' || x_end || ')', ', ' ORDER BY i) FILTER (WHERE i <= 10) || '] ...and ' || (count(*) - 10) || ' more' AS text
FROM (SELECT *, row_number() OVER (ORDER BY mask_id, y, x_start, x_end) AS i FROM ({runs(PA)}))""")
def preview(spark, d):
    text = MaskFrame(_a(spark, d), _box_a(spark, d)).preview()
    return spark.sql("SELECT :text AS text", args={"text": text})


_CELLS = f'(SELECT mask_id, p, max_by(meta, priority) AS meta FROM (SELECT mask_id, unnest(range("start", "end")) AS p, meta, priority FROM {fx.E}) GROUP BY mask_id, p)'


@_query(f"""SELECT mask_id, y, CAST(min(x) AS BIGINT) AS x_start, CAST(max(x) + 1 AS BIGINT) AS x_end, meta
FROM (SELECT mask_id, p // 1440 AS y, p % 1440 AS x, meta, p - row_number() OVER (PARTITION BY mask_id, p // 1440, meta ORDER BY p) AS g FROM {_CELLS}) GROUP BY mask_id, y, meta, g""")
def map_spans(spark, d):
    return MapFrame.of_layers(fx.events(spark, d), _month_e(spark, d)).spans()


@_query(f"""WITH m AS ({META}) SELECT m.mask_id, count(*) AS runs, CAST(sum("end" - "start") AS BIGINT) AS covered FROM m GROUP BY m.mask_id""")
def map_views(spark, d):
    m = MapFrame.of_layers(fx.events(spark, d), _month_e(spark, d))
    return m.count().join(m.ranges().groupBy("mask_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered")), "mask_id")


@_query(f"""WITH m AS ({META}), c AS (SELECT mask_id, p, max(meta) AS meta FROM (SELECT mask_id, unnest(range("start", "end" + 30)) AS p, meta FROM m) GROUP BY mask_id, p)
SELECT mask_id, CAST(min(p) AS BIGINT) AS "start", CAST(max(p) + 1 AS BIGINT) AS "end", meta FROM (SELECT mask_id, p, meta, p - row_number() OVER (PARTITION BY mask_id, meta ORDER BY p) AS g FROM c) GROUP BY mask_id, meta, g""")
def map_transform(spark, d):
    m = MapFrame.of_layers(fx.events(spark, d), _month_e(spark, d))
    return m.transform(lambda r: reshape.shift_lengths(r, 30)).items


@_query(META)
def map_round_trip(spark, d):
    m = MapFrame.of_layers(fx.events(spark, d), _month_e(spark, d))
    touching = m.transform(lambda r: r)  # neighbours with other meta may touch, which the gap form can hold, strict input can't
    listed = encoding.encode_gaps(touching.items, touching.bounds, extra=("meta",), strict=False)
    return MapFrame.decode(listed).items


@_query(f'SELECT mask_id, "start", "end" - 1 AS "end" FROM ({flat(f"(SELECT mask_id, y * {WIDTH} + x AS p FROM {PA})")})')
def output_inclusive(spark, d):
    return MaskFrame(_a(spark, d), _box_a(spark, d)).ranges("inclusive")


@_query(f'SELECT mask_id, y, x_start, x_end - x_start AS len FROM ({runs(PA)})')
def output_length(spark, d):
    return MaskFrame(_a(spark, d), _box_a(spark, d)).rows("length")


@_query(f"SELECT * FROM {fx.A} WHERE x_end <= 120 AND y < 128")
def errors_skip(spark, d):
    a = fx.lines(spark, d, 0)
    return normalize.validate(a, fx.canvas(a, 0, 0, 120, 128), canonical=False, errors="skip")


@_query(f"SELECT mask_id % 7 AS mask_id, count(*) AS area FROM (SELECT DISTINCT mask_id % 7 AS mask_id, y, x FROM {PA}) GROUP BY mask_id")
def frame_layers(spark, d):
    return MaskFrame(_a(spark, d), _box_a(spark, d)).layers(F.col("mask_id") % 7).area()


@_query(f"SELECT mask_id, CAST(coalesce(sum(x_end - x_start) FILTER (WHERE y % 2 = 0), 0) AS BIGINT) AS value FROM ({runs(PA)}) GROUP BY mask_id")
def frame_fold(spark, d):
    even = lambda so_far, row: so_far + F.when(row["y"] % 2 == 0, row["x_end"] - row["x_start"]).otherwise(F.lit(0))
    return MaskFrame(_a(spark, d), _box_a(spark, d)).fold("y", F.lit(0).cast("long"), even)


@_query(f"SELECT CAST(min(x) AS BIGINT) AS bx, CAST(min(y) AS BIGINT) AS by, CAST(max(x) + 1 AS BIGINT) AS ex, CAST(max(y) + 1 AS BIGINT) AS ey, (SELECT count(*) FROM ({runs(PA)})) AS runs FROM {PA}")
def inspect_pass(spark, d):
    passed, seen = MaskFrame(_a(spark, d), _box_a(spark, d)).inspect()
    passed.spans.write.format("noop").mode("overwrite").save()
    found = seen.get
    return spark.sql("SELECT " + ", ".join(f"CAST({found[c]} AS BIGINT) AS {c}" for c in ("bx", "by", "ex", "ey", "runs")))
