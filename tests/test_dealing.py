"""Tasks don't grow with the input: runs are merged and swept with one sort, in as many partitions as the tables' size asks for."""

import re

import pytest

from runweave.operators import dealing, normalize, setops
from runweave.plans import catalogue
from runweave.sources import masks

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES = [
    "complement",
    "span_xor",
    "range_symmetric_difference",
    "span_subtract",
    "pipeline_union_dilate_subtract_clip",
    "range_difference",
    "span_intersect",
    "range_intersection",
    "rect_ranges",
    "bounds_dilate",
    "bounds_intersect",
    "rect_spans",
    "span_union",
    "rect_ranges_bounds",
    "interval_predicates",
    "span_intersect_join",
    "union_all",
    "range_union",
    "encode_spans",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(df):
    """Partitions of the exchanges that are given a number."""
    return [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\), REPARTITION_BY_NUM", plan(df))]


@pytest.mark.parametrize("name", QUERIES)
def test_partitions_grow_with_tables(spark, monkeypatch, name):
    query = catalogue.QUERIES[name]
    whole = sorted(map(tuple, query(spark, SMALL).collect()))
    monkeypatch.setattr(dealing, "PART_BYTES", 10_000)
    small, large = dealt(query(spark, SMALL)), dealt(query(spark, LARGE))
    assert small and len(small) == len(large)
    assert all(4 * a <= b for a, b in zip(small, large))
    assert sorted(map(tuple, query(spark, SMALL).collect())) == whole


def test_small_tables_are_left_to_spark(spark):
    assert not dealt(catalogue.QUERIES["complement"](spark, SMALL))
    assert not dealt(normalize.normalize(masks.from_spans(spark, [(1, 1, 1, 2)])))


def test_rows_that_are_dealt_stay(spark, monkeypatch):
    monkeypatch.setattr(dealing, "PART_BYTES", 10_000)
    once = normalize.normalize(catalogue.fx.lines(spark, SMALL, 0))
    again = normalize.normalize(normalize.normalize(once))
    assert plan(again).count("Exchange") == plan(once).count("Exchange") == 1
    assert dealing.is_dealt(once, ("mask_id", "y")) and not dealing.is_dealt(once, ("mask_id",))
    moved = once.selectExpr("mask_id", "y + 1 AS y", "x_start", "x_end")
    assert not dealing.is_dealt(moved, ("mask_id", "y"))
    assert plan(normalize.normalize(moved)).count("Exchange") == 2


def test_partitions(spark, monkeypatch):
    lines = catalogue.fx.lines(spark, SMALL, 0)
    size = dealing.table_bytes(lines)
    assert size > 10_000 and dealing.table_bytes(lines.unionByName(lines)) == 2 * size
    monkeypatch.setattr(dealing, "PART_BYTES", size)
    assert dealing.partitions(lines) == 1
    monkeypatch.setattr(dealing, "PART_BYTES", size // 20)
    assert 20 <= dealing.partitions(lines) <= 22 and 60 <= dealing.partitions(lines, rows=3) <= 64
    monkeypatch.setattr(dealing, "MOST", 7)
    assert dealing.partitions(lines) == 7


def test_one_sort_and_no_table_of_groups(spark):
    a, b = (masks.from_spans(spark, [(1, y, x, x + 3) for y in range(3) for x in range(k, 20, 4)]) for k in (0, 1))
    for df in (normalize.normalize(a), setops.union(a, b), setops.subtract(a, b), setops.xor(a, b)):
        assert "Aggregate" not in plan(df) and len(re.findall(r"\bSort \[", plan(df))) == 1


def test_sweep_of_touching_nested_and_empty_runs(spark):
    a = masks.from_spans(spark, [(1, 0, 0, 5), (1, 0, 5, 9), (1, 0, 2, 3), (1, 0, 12, 12), (1, 0, 20, 22), (1, 1, 4, 6), (1, 1, 4, 6)])
    b = masks.from_spans(spark, [(1, 0, 5, 5), (1, 0, 9, 12), (1, 0, 20, 22), (2, 0, 1, 2)])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(setops.union(a.filter("x_end > x_start"), b.filter("x_end > x_start"))) == [(1, 0, 0, 12), (1, 0, 20, 22), (1, 1, 4, 6), (2, 0, 1, 2)]
    assert rows(setops.xor(a, b)) == [(1, 0, 0, 12), (1, 1, 4, 6), (2, 0, 1, 2)]
    assert rows(setops.subtract(a, b)) == [(1, 0, 0, 9), (1, 1, 4, 6)]
    assert rows(setops.intersect(a, b)) == [(1, 0, 20, 22)]


def test_rect_masks_over_strips(spark):
    rects = spark.createDataFrame([(1, 2, 60, 3, 10), (1, 4, 66, 5, 200), (1, 0, 3, 1, 0), (2, 7, -3, 1, 5), (2, 8, 63, 2, 1)], "mask_id long, x long, y long, w long, h long")
    want = sorted(map(tuple, normalize.normalize(masks.rect_spans(rects.filter("h > 0"))).collect()))
    assert sorted(map(tuple, masks.rect_masks(rects).collect())) == want and len(want) == 212
