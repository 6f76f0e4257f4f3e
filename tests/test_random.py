"""Every operator of the run algebra against sets of pixels, and the shape of plans."""

import random
import re

import pytest

from runweave.operators import morph, normalize, reshape, setops
from runweave.sources import masks

W, H = 26, 6


def draw(rng):
    return [(m, rng.randrange(H), s, s + rng.randint(1, 6)) for m in range(30) for s in [rng.randrange(W - 6) for _ in range(rng.randint(0, 9))]]


def pixels(rows):
    return {(m, y, x) for m, y, s, e in rows for x in range(s, e)}


def runs(on):
    out = []
    for m, y, x in sorted(on):
        if out and out[-1][:2] == (m, y) and out[-1][3] == x:
            out[-1] = (m, y, out[-1][2], x + 1)
        else:
            out.append((m, y, x, x + 1))
    return out


@pytest.fixture(scope="module")
def pair(spark):
    rng = random.Random(1)
    a, b = draw(rng), draw(rng)
    return pixels(a), pixels(b), masks.from_spans(spark, a), masks.from_spans(spark, b)


def rows(df):
    return sorted(tuple(r) for r in df.select("mask_id", "y", "x_start", "x_end").collect())


def test_algebra(pair):
    p, q, a, b = pair
    assert rows(normalize.normalize(a)) == runs(p)
    for function, want in ((setops.union, p | q), (setops.intersect, p & q), (setops.subtract, p - q), (setops.xor, p ^ q)):
        assert rows(function(a, b)) == runs(want)
    bounds = a.select("mask_id").distinct().selectExpr("mask_id", "2L AS bx", "1L AS by", "15L AS bw", "4L AS bh")
    everything = {(m, y, x) for m in {m for m, *_ in p} for y in range(1, 5) for x in range(2, 17)}
    assert rows(setops.complement(a, bounds)) == runs(everything - p)
    assert rows(reshape.clip(normalize.normalize(a), 3, 2, 9, 3)) == runs({(m, y, x) for m, y, x in p if 3 <= x < 12 and 2 <= y < 5})


@pytest.mark.parametrize("r", [0, 1, 2, 4, 5, 6, 11])
def test_dilate(pair, r):
    p, _, a, _ = pair
    want = {(m, y + dy, x + dx) for m, y, x in p for dy in range(-r, r + 1) for dx in range(-r, r + 1) if y + dy >= 0 and x + dx >= 0}
    assert rows(morph.dilate(a, r)) == runs(want)
    assert rows(morph.dilate(a, r, clip_to=(4, 1, 7, 3))) == runs({(m, y, x) for m, y, x in want if 4 <= x < 11 and 1 <= y < 4})


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", text.split("Initial Plan")[-1]))


def test_plans(pair):
    *_, a, b = pair
    assert exchanges(normalize.normalize(a)) == 1
    assert exchanges(normalize.normalize(normalize.normalize(a))) == 1
    assert exchanges(setops.union(a, b)) == 1
    assert exchanges(setops.subtract(a, b)) == 1
    assert exchanges(morph.dilate(a, 2)) == exchanges(morph.dilate(a, 200)) == 1
    assert exchanges(reshape.clip(a, 1, 1, 3, 3)) == 0
