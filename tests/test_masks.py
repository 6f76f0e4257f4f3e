"""Hand-worked cases of every mask operator."""

import pytest
from pyspark.sql import functions as F

from runweave.frame import MaskFrame
from runweave.functions import columns
from runweave.operators import affine, cluster, meta, morph, normalize, reshape, setops, stats
from runweave.sources import encoding, masks


def spans(spark, *rows):
    """(start, end, y)"""
    return masks.from_spans(spark, [(0, y, s, e) for s, e, y in rows])


def ranges(spark, *rows):
    return masks.from_ranges(spark, [(0, s, e) for s, e in rows])


def box(spark, x, y, w, h):
    return masks.from_bounds(spark, [(0, x, y, w, h)])


def got(df):
    if "x_start" in df.columns:
        return sorted((r["x_start"], r["x_end"], r["y"]) for r in df.collect())
    return sorted((r["start"], r["end"]) for r in df.collect())


def boxes(df):
    return [(r["bx"], r["by"], r["bw"], r["bh"]) for r in df.collect()]


def rect(spark, x, y, w, h):
    return masks.rect_spans(spark.createDataFrame([(0, x, y, w, h)], "mask_id long, x long, y long, w long, h long"))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ([(0, 10, 0), (12, 22, 0)], [(8, 14, 0), (18, 20, 0)], [(0, 22, 0)]),
        ([(0, 10, 0)], [(10, 20, 0)], [(0, 20, 0)]),
        ([(0, 10, 0)], [(0, 11, 1)], [(0, 10, 0), (0, 11, 1)]),
    ],
)
def test_union(spark, a, b, want):
    assert got(setops.union(spans(spark, *a), spans(spark, *b))) == want
    assert got(setops.union(spans(spark, *b), spans(spark, *a))) == want


def test_union_all_and_empty_ones(spark):
    a, b, c = [(0, 5, 0), (0, 5, 1)], [(3, 8, 0), (0, 5, 2)], [(6, 10, 0), (3, 8, 1)]
    assert got(setops.union_all([spans(spark, *x) for x in (a, b, c)])) == [(0, 5, 2), (0, 8, 1), (0, 10, 0)]
    assert got(setops.union_all([spans(spark, (0, 10, 0)), spans(spark), spans(spark, (5, 15, 0))])) == [(0, 15, 0)]
    assert got(setops.union_all([spans(spark), spans(spark)])) == []


@pytest.mark.parametrize("how", [setops.intersect, setops.intersect_join])
@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ([(0, 5, 0), (8, 15, 0)], [(3, 12, 0)], [(3, 5, 0), (8, 12, 0)]),
        ([(0, 5, 0)], [(5, 9, 0)], []),
        ([(0, 10, y) for y in range(3)], [(5, 15, 0), (3, 12, 1), (3, 7, 2)], [(3, 7, 2), (3, 10, 1), (5, 10, 0)]),
    ],
)
def test_intersect(spark, how, a, b, want):
    assert got(how(spans(spark, *a), spans(spark, *b))) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ([(0, 20, 0)], [(3, 6, 0), (10, 14, 0)], [(0, 3, 0), (6, 10, 0), (14, 20, 0)]),
        ([(0, 5, 0), (8, 15, 0)], [(3, 12, 0)], [(0, 3, 0), (12, 15, 0)]),
        ([(0, 10, y) for y in range(3)], [(5, 15, 0), (0, 3, 1), (3, 7, 2)], [(0, 3, 2), (0, 5, 0), (3, 10, 1), (7, 10, 2)]),
    ],
)
def test_subtract(spark, a, b, want):
    assert got(setops.subtract(spans(spark, *a), spans(spark, *b))) == want


def test_bounds(spark):
    a, b = box(spark, 10, 10, 10, 10), box(spark, 8, 6, 10, 10)
    assert boxes(setops.union_bounds(a, b)) == [(8, 6, 12, 14)]
    assert boxes(setops.intersect_bounds(a, b)) == [(10, 10, 8, 6)]
    assert boxes(setops.intersect_bounds(a, box(spark, 50, 50, 2, 2))) == []
    assert got(setops.prune(spans(spark, (1, 2, 0)), a, box(spark, 50, 50, 2, 2))) == []


def test_clip(spark):
    mask = MaskFrame(rect(spark, 0, 0, 100, 100), box(spark, 0, 0, 100, 100)).clip(10, 10, 80, 110)
    assert boxes(mask.bounds) == [(10, 10, 80, 90)]
    assert got(mask.spans) == [(10, 90, y) for y in range(10, 100)]
    assert boxes(mask.clip(500, 500, 1, 1).bounds) == [] and got(mask.clip(500, 500, 1, 1).spans) == []


def test_rectangles(spark):
    r = lambda *v: spark.createDataFrame([(0, *v)], "mask_id long, x long, y long, w long, h long")
    assert got(masks.rect_spans(r(10, 10, 10, 10))) == [(10, 20, y) for y in range(10, 20)]
    assert got(masks.rect_ranges(r(2, 4, 5, 5), 10)) == [(42 + 10 * k, 47 + 10 * k) for k in range(5)]
    assert got(masks.rect_ranges(r(0, 2, 5, 5), 5)) == [(10, 35)]
    assert boxes(masks.rect_ranges_bounds(r(2, 4, 5, 5), 10)) == [(0, 0, 10, 9)]


def test_ranges_and_spans(spark):
    assert got(reshape.into_ranges(rect(spark, 10, 10, 10, 10), box(spark, 10, 10, 10, 10))) == [(0, 100)]
    w10 = box(spark, 0, 0, 10, 10)
    assert got(reshape.ranges_to_spans(ranges(spark, (0, 20)), w10)) == [(0, 10, 0), (0, 10, 1)]
    assert got(reshape.ranges_to_spans(ranges(spark, (0, 10), (11, 20)), w10)) == [(0, 10, 0), (1, 10, 1)]
    assert got(reshape.split_rows(ranges(spark, (0, 25)), 10)) == [(0, 10), (10, 20), (20, 25)]
    roi = box(spark, 1, 2, 200, 100)
    local = reshape.into_ranges(spans(spark, *((1, 11, y) for y in (2, 3, 4))), roi)
    assert got(local) == [(0, 10), (200, 210), (400, 410)]
    assert got(reshape.ranges_to_spans(local, roi)) == [(1, 11, 2), (1, 11, 3), (1, 11, 4)]


@pytest.mark.parametrize(
    ("rect_", "want"),
    [
        ((2, 1, 4, 3), {3: [(5, 6), (8, 9), (11, 12)], 10: [(12, 16), (22, 26), (32, 36)], 20: [(22, 26), (42, 46), (62, 66)]}),
        ((0, 1, 10, 3), {3: [(3, 12)], 10: [(10, 40)], 20: [(20, 30), (40, 50), (60, 70)]}),
    ],
)
def test_reproject(spark, rect_, want):
    for width, out in want.items():
        assert got(reshape.reproject(rect(spark, *rect_), width)) == out
    assert boxes(reshape.reproject_bounds(box(spark, 2, 1, 4, 3), 20)) == [(0, 0, 20, 4)]


def test_bitmaps(spark):
    bits = lambda w, *p: spark.createDataFrame([(0, w, [bool(x) for x in p])], "mask_id long, width long, pixels array<boolean>")
    assert got(masks.bitmap_spans(bits(4, 0, 1, 1, 0, 1, 0, 0, 1))) == [(0, 1, 1), (1, 3, 0), (3, 4, 1)]
    assert got(masks.bitmap_spans(bits(2, 0, 1, 1, 0))) == [(0, 1, 1), (1, 2, 0)]
    assert got(masks.bitmap_ranges(bits(4, 0, 1, 1, 0, 1, 1, 0, 0))) == [(1, 3), (4, 6)]
    assert got(masks.bitmap_ranges(bits(2, 0, 1, 1, 0))) == [(1, 3)]
    raw = spark.createDataFrame([(0, 4, bytearray([0, 7, 255, 0, 195, 0, 0, 1]))], "mask_id long, width long, pixels binary")
    assert got(masks.bitmap_spans(raw, "bytes")) == [(0, 1, 1), (1, 3, 0), (3, 4, 1)]
    assert boxes(masks.bitmap_bounds(raw, "bytes")) == [(0, 0, 4, 2)]
    with pytest.raises(Exception, match="whole rows"):
        masks.bitmap_spans(bits(3, 1, 1, 1, 1)).collect()


def test_sanitize(spark):
    incl = lambda *rows: ranges(spark, *((s, e + 1) for s, e in rows))
    assert got(reshape.sanitize(incl((1, 5), (6, 8), (5, 10), (20, 30)))) == [(1, 11), (20, 31)]
    assert got(reshape.sanitize(incl((1, 5), (3, 7), (2, 103)))) == [(1, 104)]
    given = lambda *rows: spark.createDataFrame([(0, k, s, e + 1) for k, (s, e) in enumerate(rows)], "mask_id long, seq long, start long, end long")
    assert got(reshape.sanitize(given((1, 5), (6, 8), (5, 10)), "seq")) == [(1, 11)]
    with pytest.raises(Exception, match="smaller start"):
        reshape.sanitize(given((10, 11), (9, 10)), "seq").collect()
    with pytest.raises(Exception, match="start after end"):
        reshape.sanitize(given((0, 1), (2, 0)), "seq").collect()
    assert got(reshape.sanitize(given((0, 1), (5, 6), (2, 0), (9, 9)), "seq", errors="keep")) == [(0, 2), (5, 7)]


def test_inspect_bounds(spark):
    off = box(spark, 100, 100, 10, 50)
    assert boxes(stats.inspect_range_bounds(ranges(spark, (13, 18), (32, 33)), off)) == [(102, 101, 6, 3)]
    assert boxes(stats.inspect_range_bounds(ranges(spark, (3, 6), (30, 33), (55, 65)), box(spark, 0, 0, 10, 50))) == [(0, 0, 10, 7)]
    assert boxes(stats.inspect_range_bounds(ranges(spark), off)) == []
    seen, fold = stats.fold_inline(spans(spark, (0, 5, 0), (0, 7, 1)), area=F.sum(F.col("x_end") - F.col("x_start")))
    assert seen.count() == 2 and fold.get == {"area": 12}
    assert "and 1 more" in stats.preview(spans(spark, *((0, 1, y) for y in range(11))))


@pytest.mark.parametrize(
    ("mask", "r", "want"),
    [
        ([(50, 52, 5), (50, 52, 6)], 2, [(48, 54, y) for y in range(3, 9)]),
        ([(5, 10, 0)], 1, [(4, 11, 0), (4, 11, 1)]),
        ([(0, 3, 5), (7, 10, 5)], 1, [(0, 4, 4), (0, 4, 5), (0, 4, 6), (6, 11, 4), (6, 11, 5), (6, 11, 6)]),
        ([(5, 10, 0), (5, 10, 5)], 3, [(2, 13, y) for y in range(9)]),
        ([(5, 6, 0), (5, 6, 6)], 2, [(3, 8, y) for y in (0, 1, 2, 4, 5, 6, 7, 8)]),
        ([(30, 31, 3)], 17, [(13, 48, y) for y in range(21)]),
    ],
)
def test_dilate(spark, mask, r, want):
    assert got(morph.dilate(spans(spark, *mask), r)) == want


def test_dilate_bounds_and_variants(spark):
    assert boxes(morph.dilate_bounds(box(spark, 6, 7, 1, 1), 5)) == [(1, 2, 11, 11)]
    assert got(morph.dilate(spans(spark, (5, 6, 3)), 1, morph.translated)) == [(5, 8, 2), (5, 8, 3), (5, 8, 4)]
    two = ranges(spark, (450, 452), (530, 532))
    want = [(80 * y + 48, 80 * y + 54) for y in range(3, 9)]
    assert got(morph.dilate_ranges(two, box(spark, 0, 0, 80, 40), 2)) == want
    assert got(morph.dilate_ranges(two, box(spark, 0, 0, 80, 40), 2, compat=True)) == want
    one = ranges(spark, (85, 87))
    assert got(morph.dilate_ranges(one, box(spark, 0, 0, 10, 20), 1, compat=True)) == [(74, 78), (85, 87), (94, 98)]
    assert got(morph.dilate_ranges(one, box(spark, 0, 0, 10, 20), 1)) == [(74, 78), (84, 88), (94, 98)]
    for r in range(1, 60):
        reach = {0}
        for s in morph.row_steps(r):
            reach = {y + d for y in reach for d in (-s, 0, s)}
        assert reach == set(range(-r, r + 1))


def test_affine(spark):
    ell = spans(spark, *((0, 1, y) for y in range(4)), (0, 6, 4))
    assert got(affine.affine(ell, ((0, 1, 0), (-1, 0, 6)))) == [(0, 5, 6), *((4, 5, y) for y in range(1, 6))]
    assert got(affine.affine(rect(spark, 2, 2, 3, 3), ((2, 0, -3), (0, 2, -3)))) == [(0, 7, y) for y in range(7)]
    move = lambda dx, dy: got(affine.affine(rect(spark, 1, 1, 3, 3), ((1, 0, dx), (0, 1, dy))))
    assert move(-2, 0) == [(0, 2, y) for y in (1, 2, 3)]
    assert move(4, 0) == [(5, 8, y) for y in (1, 2, 3)]
    assert move(0, -2) == [(1, 4, 0), (1, 4, 1)]
    assert move(-2, -2) == [(0, 2, 0), (0, 2, 1)]
    assert move(-100, 0) == []
    assert boxes(affine.affine_bounds(box(spark, 1, 1, 3, 3), ((1, 0, -100), (0, 1, 0)))) == []
    from math import cos, radians, sin

    for size, angle in ((10, 37), (20, 131), (15, 271)):
        c, s = cos(radians(angle)), sin(radians(angle))
        out = got(affine.affine(rect(spark, 50, 50, size, size), ((c, -s, 60 - 60 * c + 60 * s), (s, c, 60 - 60 * s - 60 * c))))
        ys = sorted(y for _, _, y in out)
        assert ys == list(range(ys[0], ys[-1] + 1)) and abs(sum(e - b for b, e, _ in out) / size**2 - 1) < 0.25


@pytest.mark.parametrize(
    ("drawing", "components", "runs"),
    [
        ("##.##/.#.##", 2, 4), ("##......##/.########.", 1, 3), (".#.#/..#./.#.#", 1, 5), ("#####/...../#####", 2, 2), ("####/#..#/#..#/####", 1, 6),
        ("####/#..#/#..#/##..", 1, 6), ("##........##/##...#....##", 3, 5), ("#########/#......../#.#####../#.#.#.#.#/#########", 1, 10),
    ],
)
@pytest.mark.parametrize("strip", [1, 2, 512])
def test_clusters(spark, drawing, components, runs, strip):
    out = cluster.cluster(masks.from_ascii(spark, drawing.replace("/", "\n")), 20, strip).collect()
    assert len({r["cluster_id"] for r in out}) == components and len(out) == runs
    assert {r["cluster_id"] for r in out} <= {r["y"] * 20 + r["x_start"] for r in out}


def test_cluster_bounds_and_random_bitmaps(spark):
    drawn = masks.from_ascii(spark, "....\n....\n.###\n.###")
    assert boxes(cluster.cluster_bounds(cluster.cluster(drawn, 4))) == [(1, 2, 3, 2)]
    import random

    rng, rows, want = random.Random(5), [], {}
    for m in range(12):
        w, h, p = rng.randint(1, 24), rng.randint(1, 24), rng.choice((0.3, 0.5, 0.7))
        on = {(y, x) for y in range(h) for x in range(w) if rng.random() < p}
        rows.append((m, w, [(y, x) in on for y in range(h) for x in range(w)]))
        left, sizes = set(on), []
        while left:
            todo, size = [left.pop()], 0
            while todo:
                y, x = todo.pop()
                size += 1
                for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if q in left:
                        left.remove(q)
                        todo.append(q)
            sizes.append(size)
        want[m] = sorted(sizes)
    bitmaps = spark.createDataFrame(rows, "mask_id long, width long, pixels array<boolean>")
    sizes = cluster.cluster(masks.bitmap_spans(bitmaps), 24, strip=5).groupBy("mask_id", "cluster_id").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("n")).collect()
    found = {m: sorted(r["n"] for r in sizes if r["mask_id"] == m) for m in want}
    assert found == want


def test_encoding(spark):
    mask = ranges(spark, (10, 30), (45, 50), (205, 210))
    roi = box(spark, 1, 2, 100, 200)
    e = encoding.encode_gaps(mask).first()
    assert e["included"] == [20, 5, 5] and e["excluded"] == [10, 15, 155]
    assert got(encoding.decode_gaps(encoding.encode_gaps(mask))) == got(mask)
    for end in (True, False):
        wire = encoding.wire_encode(mask, roi, end)
        raw = bytes(wire.first()["payload"])
        assert len(raw) == 19 + 48 + 16 * end and raw[19:27] == (10).to_bytes(8, "little")
        assert got(encoding.wire_decode(wire)) == got(mask) and boxes(encoding.wire_header(wire)) == [(1, 2, 100, 200)]
    big = spans(spark, (0, 65535, 0), (0, 65535, 1))
    assert got(encoding.decode_gaps(encoding.encode_spans(big, box(spark, 0, 0, 65535, 2)))) == [(0, 131070)]


@pytest.mark.parametrize(
    ("rows", "kind", "why"),
    [([(256, 257)], "u8", "gap does not fit"), ([(0, 270)], "u8", "len does not fit"), ([(5, 5)], "u64", "empty"), ([(0, 5), (4, 9)], "u64", "overlap or touch"), ([(0, 5), (5, 9)], "u64", "overlap or touch")],
)
def test_encoding_errors(spark, rows, kind, why):
    with pytest.raises(Exception, match=why):
        encoding.encode_gaps(ranges(spark, *rows), kind=kind).collect()


def test_wire_errors(spark):
    good = bytes(encoding.wire_encode(ranges(spark, (10, 30)), box(spark, 1, 2, 100, 200), False).first()["payload"])
    read = lambda raw, **k: encoding.wire_decode(spark.createDataFrame([(0, bytearray(raw))], "mask_id long, payload binary"), **k).collect()
    for raw, why in ((b"\x99" + good[1:], "version"), (good[:1] + b"\x05" + good[2:], "type"), (good[:2] + b"\xff" + good[3:], "type"), (good[:10], "cut short"), (good[:11] + bytes(4) + good[15:], "without area")):
        with pytest.raises(Exception, match=why):
            read(raw)
    assert len(read(good + b"\x01\x02")) == 1
    with pytest.raises(Exception, match="pair is cut short"):
        read(good + b"\x01\x02", cut_short="error")


def test_meta(spark):
    rows = lambda side, p, *r: [(0, s, e, f"{side}{k + 1}", p) for k, (s, e) in enumerate(r)]
    df = lambda r: spark.createDataFrame(r, "mask_id long, start long, end long, meta string, priority long")
    a, b = df(rows("a", 0, (10, 30), (42, 50))), df([(0, 20, 30, "a1", 0), (0, 41, 45, "b2", 0)])
    out = sorted((r["start"], r["end"], r["meta"]) for r in meta.union_over(b, a).collect())
    assert out == [(10, 30, "a1"), (41, 42, "b2"), (42, 50, "a2")]
    moved = reshape.shift_ranges(df(rows("a", 0, (10, 15), (30, 35))), 5)
    assert sorted((r["start"], r["end"], r["meta"]) for r in moved.collect()) == [(15, 20, "a1"), (35, 40, "a2")]
    with pytest.raises(Exception, match="overlap or touch"):
        meta.check_map(df(rows("a", 0, (1, 5), (4, 9)))).collect()
    coded = encoding.encode_gaps(df(rows("a", 0, (10, 20), (255, 257))), extra=("meta",))
    assert sorted((r["start"], r["end"], r["meta"]) for r in encoding.decode_gaps(coded, ("meta",)).collect()) == [(10, 20, "a1"), (255, 257, "a2")]


def test_transforms(spark):
    five = reshape.transform_ranges(ranges(spark, (10, 20), (30, 45), (50, 60)), lambda r: reshape.shift_ranges(r, 5))
    assert got(five) == [(15, 25), (35, 50), (55, 65)]
    assert got(reshape.transform_ranges(five, lambda r: r.limit(0))) == []
    roi = box(spark, 1, 2, 100, 200)
    full = reshape.into_ranges(spans(spark, *((1, 101, y) for y in range(2, 6))), roi)
    out = reshape.transform_spans(full, roi, lambda s: s.filter("y != 3"))
    assert got(out) == [(0, 100), (200, 400)]
    with pytest.raises(Exception, match="below 0"):
        reshape.shift_ranges(ranges(spark, (3, 4)), -5).collect()


def test_validate(spark):
    roi = box(spark, 0, 0, 10, 10)
    assert got(normalize.validate(spans(spark, (0, 3, 0)), roi)) == [(0, 3, 0)]
    for rows, why in (([(0, 3, 0), (3, 4, 0)], "overlap or touch"), ([(3, 3, 0)], "empty"), ([(0, 11, 0)], "outside"), ([(0, 1, 10)], "outside")):
        with pytest.raises(Exception, match=why):
            normalize.validate(spans(spark, *rows), roi).collect()
    seq = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (0, 2, 4)], "mask_id long, seq long, v long")
    with pytest.raises(Exception, match="not sorted"):
        normalize.validate_sorted(seq, "v", "seq").collect()
    with pytest.raises(Exception, match="mask is empty"):
        MaskFrame(spans(spark), roi).require_nonempty().bounds.collect()


def test_interval_columns(spark):
    cases = [((0, 5), (5, 9), None), ((0, 5), (4, 9), (4, 5)), ((0, 9), (3, 4), (3, 4)), ((7, 9), (0, 5), None)]
    df = spark.createDataFrame([(*a, *b) for a, b, _ in cases], "a long, b long, c long, d long")
    out = [r["i"] and tuple(r["i"]) for r in df.select(columns.intersection("a", "b", "c", "d").alias("i")).collect()]
    assert out == [w for *_, w in cases]
    with pytest.raises(Exception, match="holds anything"):
        spark.createDataFrame([("[5,5]",)], "t string").select(columns.range_from_json("t")).collect()
    with pytest.raises(Exception, match="does not fit"):
        df.select(columns.check_fits(F.col("b") + 300, "u8")).collect()
    q = spark.range(1).select(*(columns.floor_div(a, b).alias(f"{k}") for k, (a, b) in enumerate((("-7", "2"), ("7", "2"), ("-8", "2"), ("7", "0"))))).first()
    assert list(q) == [-4, 3, -4, None]
    assert morph.row_steps(200) == [1, 3, 9, 27, 81, 79]


def test_single_masks_and_types(spark):
    one, bounds = masks.single_span(spark, 7, 6, 9)
    assert got(one) == [(6, 9, 7)] and boxes(bounds) == [(6, 7, 3, 1)]
    assert got(masks.single_range(spark, 3, 5, (0, 0, 10, 10))[0]) == [(3, 5)]
    for bad in ((lambda: masks.single_span(spark, 0, 3, 3)), (lambda: masks.single_range(spark, 3, 5, (1, 0, 9, 9))), (lambda: masks.single_range(spark, 5, 5, (0, 0, 9, 9)))):
        with pytest.raises(ValueError):
            bad()
    wide = box(spark, 250, 0, 10, 10)
    assert got(reshape.typed_spans(ranges(spark, (0, 5)), wide, "u8")) == [(250, 255, 0)]
    with pytest.raises(Exception, match="does not fit"):
        reshape.typed_spans(ranges(spark, (0, 7)), wide, "u8").collect()


def test_wire_decode_is_one_pass(spark):
    good = bytes(encoding.wire_encode(ranges(spark, (10, 30)), box(spark, 1, 2, 100, 200), False).first()["payload"])
    df = spark.createDataFrame([(0, bytearray(good)), (1, bytearray(good[:10])), (2, None)], "mask_id int, payload binary")
    out = encoding.wire_decode(df, errors="skip")
    assert [tuple(r) for r in out.collect()] == [(0, 10, 30)] and out.schema["mask_id"].dataType.simpleString() == "int"
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    huge = good[:19] + (1 << 63).to_bytes(8, "little") + (5).to_bytes(8, "little")
    df = spark.createDataFrame([(0, bytearray(huge))], "mask_id long, payload binary")
    with pytest.raises(Exception, match="signed 64-bit"):
        encoding.wire_decode(df).collect()
    assert [(int(r["start"]), int(r["end"])) for r in encoding.wire_decode(df, wide=True).collect()] == [(1 << 63, (1 << 63) + 5)]
    over = good[:19] + ((1 << 64) - 1).to_bytes(8, "little") + (5).to_bytes(8, "little")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        encoding.wire_decode(spark.createDataFrame([(0, bytearray(over))], "mask_id long, payload binary"), wide=True).collect()


def test_builder_keeps_the_first_error(spark):
    rows = [(0, 1, 10, 20), (0, 2, 5, 8), (0, 3, 30, 30), (1, 1, 5, 5), (1, 2, 0, 1), (2, 1, 0, 4), (2, 2, 4, 6), (2, 3, 9, 10), (3, 1, 300, 301)]
    df = spark.createDataFrame(rows, "mask_id long, n int, start long, end long")
    out = {r["mask_id"]: (r["included"], r["excluded"], r["error"]) for r in encoding.build_masks(df, "n", "u8").collect()}
    assert out == {0: (None, None, "range starts before the end of the one before"), 1: (None, None, "range is empty"), 2: ([6, 1], [0, 3], None), 3: (None, None, "end does not fit u8")}


def test_priority_union_in_buckets(spark):
    import random

    rng = random.Random(2)
    rows = [(m, s, s + rng.randint(1, 40), rng.choice("abc"), rng.randint(0, 5)) for m in range(3) for s in [rng.randint(0, 200) for _ in range(30)]]
    df = spark.createDataFrame(rows, "mask_id long, start long, end long, meta string, priority long")
    want = {}
    for m, s, e, meta_, p in rows:
        for x in range(s, e):
            want[m, x] = max(want.get((m, x), (-1, "")), (p, meta_))
    for bucket in (1, 7, 64, 4096):
        out = meta.priority_union(df, bucket).collect()
        assert {(r["mask_id"], x): r["meta"] for r in out for x in range(r["start"], r["end"])} == {k: v[1] for k, v in want.items()}
        ends = {(r["mask_id"], r["end"], r["meta"]) for r in out}
        assert not any((r["mask_id"], r["start"], r["meta"]) in ends for r in out)
