"""8-connected components of masks.

Masks are labelled in strips of rows, each a group of its own however large its mask is.  What remains is a graph of
strip-local components that touch across a strip border, far smaller than the mask; it is joined per mask.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.shipping import ship

STRIP = 512


def label_runs(rows: list[tuple[int, int, int]]) -> list[int]:
    """For runs (y, start, end) in sorted order, the place of the first run of each one's component."""
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    upper, here, begin = range(0), None, 0
    j = 0
    for i, (y, start, end) in enumerate(rows):
        if y != here:
            upper = range(begin, i) if here == y - 1 else range(0)
            here, begin, j = y, i, 0
        # runs of the row above that touch, corners included; j never goes back
        while j < len(upper) and rows[upper[j]][2] < start:
            j += 1
        k = j
        while k < len(upper) and rows[upper[k]][1] <= end:
            a, b = find(upper[k]), find(i)
            parent[max(a, b)] = min(a, b)
            k += 1
    return [find(i) for i in range(len(rows))]


def _by_group(keys: int, work, names: list[str]):
    """A function for mapInArrow over rows that come group by group (their first `keys` columns): work() gets one group's rows
    as tuples.  Cheaper than a pandas frame for each group, of which there are as many as small masks."""

    def run(batches):
        group, rows, done = None, [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], pa.int64()) for c in range(len(names))], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:keys] != group:
                    if rows:
                        done += work(rows)
                    if len(done) > 50_000:
                        yield out()
                        done = []
                    group, rows = row[:keys], []
                rows.append(row)
        if rows:
            done += work(rows)
        yield out()

    return run


def _label_strip(rows: list[tuple]) -> list[tuple]:
    """Of (mask_id, strip, y, start, end): the same without the strip, and the first run of each one's component."""
    first = label_runs([r[2:] for r in rows])
    return [(r[0], *r[2:], rows[i][2], rows[i][3]) for r, i in zip(rows, first, strict=True)]


def _join_strips(rows: list[tuple]) -> list[tuple]:
    """Of links (mask_id, ay, ax, by, bx): the first component that each reaches."""
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def find(k):
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for _, ay, ax, by, bx in rows:
        p, q = find((ay, ax)), find((by, bx))
        parent[max(p, q)] = min(p, q)
    return [(rows[0][0], *k, *find(k)) for k in list(parent)]


def cluster(spans: DataFrame, width: int, strip: int = STRIP) -> DataFrame:
    """mask_id, cluster_id, y, x_start, x_end: a component's id is its first run's place, y * width + x_start."""
    ship(spans.sparkSession)
    cut = spans.select("mask_id", "y", "x_start", "x_end").withColumn("_strip", F.expr(f"y div {strip}"))
    dealt = cut.select("mask_id", "_strip", "y", "x_start", "x_end").repartition("mask_id", "_strip").sortWithinPartitions("mask_id", "_strip", "y", "x_start")
    part = dealt.mapInArrow(_by_group(2, _label_strip, ["mask_id", "y", "x_start", "x_end", "_ly", "_lx"]), "mask_id long, y long, x_start long, x_end long, _ly long, _lx long")
    above = part.filter(F.expr(f"y % {strip} = {strip - 1}")).select("mask_id", (F.col("y") + 1).alias("y"), F.col("x_start").alias("_s"), F.col("x_end").alias("_e"), F.col("_ly").alias("ay"), F.col("_lx").alias("ax"))
    below = part.filter(F.expr(f"y % {strip} = 0")).select("mask_id", "y", "x_start", "x_end", F.col("_ly").alias("by"), F.col("_lx").alias("bx"))
    links = above.join(below, ["mask_id", "y"]).filter("_s <= x_end AND x_start <= _e").select("mask_id", "ay", "ax", "by", "bx").distinct()
    links = links.repartition("mask_id").sortWithinPartitions("mask_id")
    roots = links.mapInArrow(_by_group(1, _join_strips, ["mask_id", "_ly", "_lx", "_ry", "_rx"]), "mask_id long, _ly long, _lx long, _ry long, _rx long")
    named = part.join(roots, ["mask_id", "_ly", "_lx"], "left")
    return named.select("mask_id", F.expr(f"coalesce(_ry, _ly) * {width}L + coalesce(_rx, _lx)").alias("cluster_id"), "y", "x_start", "x_end")


def cluster_bounds(clusters: DataFrame) -> DataFrame:
    """Tight bounds of each component."""
    box = clusters.groupBy("mask_id", "cluster_id").agg(F.min("x_start").alias("bx"), F.min("y").alias("by"), F.max("x_end").alias("_ex"), F.max("y").alias("_ey"))
    return box.select("mask_id", "cluster_id", "bx", "by", F.expr("_ex - bx").alias("bw"), F.expr("_ey + 1 - by").alias("bh"))
