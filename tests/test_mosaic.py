"""Whole-scene operators against the untiled result, for any tile size, and the rectangle join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import mosaic as M
from gridloom.operators.rectangles import rectangle_join

HEIGHT, WIDTH = 23, 31


@pytest.fixture(scope="module")
def scenes():
    draw = np.random.default_rng(3)
    return {s: draw.normal(size=(HEIGHT, WIDTH)) for s in (4, 9)}


def tiled(spark, scenes, side):
    rows = []
    for s, a in scenes.items():
        for y in range(0, HEIGHT, side):
            for x in range(0, WIDTH, side):
                part = a[y : y + side, x : x + side]
                rows.append((s, y, x, *part.shape, HEIGHT, WIDTH, part.ravel().tolist()))
    return spark.createDataFrame(rows, "scene long, y0 int, x0 int, h int, w int, height int, width int, data array<double>").repartition(5)


def image(df, name, scene):
    out = np.full((HEIGHT, WIDTH), np.nan)
    for r in M.pixels(df, name).where(F.col("scene") == scene).collect():
        assert np.isnan(out[r.y, r.x])
        out[r.y, r.x] = r[name]
    return out


@pytest.mark.parametrize("side", [1, 4, 7, 40])
def test_stencils(spark, scenes, side):
    tiles = tiled(spark, scenes, side)
    mean, slopes = M.box_mean(tiles, 9, side).cache(), M.gradient(tiles, 2.0, side).cache()
    marks = tiles.withColumn("data", F.transform("data", lambda v: (v > 0).cast("double")))
    edges = M.boundary(marks, side).cache()
    steps = {r.scene: r.max_step for r in M.max_step(tiles, side).collect()}
    for s, a in scenes.items():
        wide = np.pad(a, 4, mode="reflect")
        want = np.array([[wide[y : y + 9, x : x + 9].mean() for x in range(WIDTH)] for y in range(HEIGHT)])
        assert np.allclose(image(mean, "mean", s), want)
        assert np.allclose(image(slopes, "east", s), np.gradient(a, 2.0, axis=1)) and np.allclose(image(slopes, "north", s), np.gradient(a, -2.0, axis=0))
        m = np.pad(a > 0, 1)
        edge = m[1:-1, 1:-1] & ~(m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:])
        e = np.pad(edge, 1)
        assert (image(edges, "edge", s) == edge).all()
        assert (image(edges, "halo", s) == (edge | e[:-2, 1:-1] | e[2:, 1:-1] | e[1:-1, :-2] | e[1:-1, 2:])).all()
        assert np.isclose(steps[s], max(np.abs(np.diff(a, axis=0)).max(), np.abs(np.diff(a, axis=1)).max()))


def test_only_borders_are_sent(spark, scenes):
    parts = M._messages(tiled(spark, scenes, 8), 2, 8).select(F.explode("parts").alias("p")).select(F.sum(F.size("p.data"))).first()[0]
    whole = 2 * HEIGHT * WIDTH
    assert whole < parts < 2.2 * whole  # 12 x 12 for 8 x 8 inside


def test_cut_to_other_tiles(spark, scenes):
    again = M.cut(tiled(spark, scenes, 7), 5)
    assert {(r.h, r.w) for r in again.collect()} == {(h, w) for h in (5, 3) for w in (5, 1)}
    for s, a in scenes.items():
        assert np.allclose(image(again, "data", s), a)


def test_border_as_wide_as_the_scene_is_refused(spark, scenes):
    with pytest.raises(Exception, match="as wide as the scene"):
        M.box_mean(tiled(spark, scenes, 8), 2 * HEIGHT + 1, 8).collect()


def flooded(mask):
    out, seen = [], np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        open_, found = [(y, x)], []
        seen[y, x] = True
        while open_:
            a, b = open_.pop()
            found.append((a, b))
            for c in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for d in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        open_.append((c, d))
        out.append(found)
    return out


@pytest.mark.parametrize("side,least", [(1, 0.9), (5, 0.6), (8, 0.3), (40, 0.6)])
def test_regions(spark, scenes, side, least):
    tiles = tiled(spark, scenes, side).withColumn("mask", F.transform("data", lambda v: (v >= least).cast("double")))
    got = {(r.scene, r.label): (r.area_px, r.x0, r.y0, r.x1, r.y1, r.peak) for r in M.regions(M.labelled(tiles)).collect()}
    want = {}
    for s, a in scenes.items():
        for found in flooded(a >= least):
            ys, xs = zip(*found)
            want[s, min(y * WIDTH + x for y, x in found)] = (len(found), min(xs), min(ys), max(xs) + 1, max(ys) + 1, max(a[p] for p in found))
    assert got == want


def test_snake_through_all_tiles(spark):
    mask = np.zeros((HEIGHT, WIDTH))
    mask[::2] = 1
    for k, y in enumerate(range(1, HEIGHT, 2)):
        mask[y, -1 if k % 2 == 0 else 0] = 1
    tiles = tiled(spark, {1: mask}, 3).withColumn("mask", F.col("data"))
    got = M.regions(M.labelled(tiles)).collect()
    assert [(r.label, r.area_px) for r in got] == [(0, int(mask.sum()))]
    none = tiles.withColumn("mask", F.transform("mask", lambda v: F.lit(0.0)))
    assert M.labelled(none).count() == 0


def boxes(spark, draw, n, prefix, far=200):
    rows = []
    for k in range(n):
        x, y = draw.randint(-far, far), draw.randint(-far, far)
        rows.append((draw.choice([1, 1, 2, None]), k, x, y, x + draw.choice([0, 1, 3, 30]), y + draw.choice([1, 2, 60])))
    return rows, spark.createDataFrame(rows, f"scene long, {prefix} int, x0 int, y0 int, x1 int, y1 int")


@pytest.mark.parametrize("most", [1 << 20, 30, 1])
def test_rectangle_join(spark, most):
    draw = random.Random(most)
    a, left = boxes(spark, draw, 60, "a")
    b, right = boxes(spark, draw, 70, "b")
    b += [(1, 1000 + k, 5, 5, 6, 6) for k in range(8)]  # many in one pixel
    a += [(1, 1000 + k, 4, 4, 7, 7) for k in range(6)]
    left, right = (spark.createDataFrame(rows, df.schema) for rows, df in ((a, left), (b, right)))
    got = sorted((r.scene, r.l_a, r.r_b) for r in rectangle_join(left, right, 64, most).collect())
    want = sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] is not None and p[0] == q[0] and p[2] < p[4] and p[3] < p[5] and q[2] < q[4] and q[3] < q[5] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5])
    assert got == want and len(want) > 48


def test_far_rectangles_are_not_compared(spark):
    rows = [(1, k, 100 * k, 0, 100 * k + 4, 4) for k in range(300)]
    df = spark.createDataFrame(rows, "scene long, k int, x0 int, y0 int, x1 int, y1 int")
    met = rectangle_join(df, df, 64)
    assert met.count() == 300
    assert rectangle_join(df.limit(0), df, 64).count() == 0
    with pytest.raises(ValueError):
        rectangle_join(df, df, 48)
