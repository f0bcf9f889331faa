"""Resampling inside a row, colours, versions, indexed images and merged annotations against plain versions."""

import colorsys
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import mathx
from gridloom.operators import inference, manifests, raster
from gridloom.sources import files


@pytest.mark.parametrize("shape,wanted,kind", [((7, 5), (3, 9), "bilinear"), ((8, 8), (3, 5), "box"), ((1, 4), (4, 1), "bilinear"), ((6, 6), (6, 6), "box")])
def test_resized(spark, shape, wanted, kind):
    a = np.random.default_rng(1).normal(size=shape)
    got = spark.createDataFrame([(a.ravel().tolist(),)], "data array<double>").select(raster.resized(F.col("data"), *shape, *wanted, kind).alias("v")).first().v
    assert np.allclose(np.array(got).reshape(wanted), inference.resampled(a, *wanted, kind))


def test_colours(spark):
    hues = [k / 37 for k in range(38)]
    df = spark.createDataFrame([(h,) for h in hues], "h double")
    for r in df.select("h", mathx.hsv_rgb(F.col("h"), F.lit(0.7), F.lit(0.9)).alias("c")).collect():
        assert max(abs(x - 255 * y) for x, y in zip(r.c, colorsys.hsv_to_rgb(r.h % 1.0, 0.7, 0.9))) <= 0.5 + 1e-9
    stops = [(0.2, (0, 10, 20)), (0.6, (100, 10, 0)), (0.8, (0, 250, 40))]
    for r in df.select("h", mathx.ramp(F.col("h"), stops).alias("c")).collect():
        want = [np.interp(r.h, [s for s, _ in stops], [c[k] for _, c in stops]) for k in range(3)]
        assert np.allclose(r.c, want, atol=0.5 + 1e-9)
    over = mathx.overlaid(F.array(F.lit(255), F.lit(100), F.lit(1)), (44, 210, 163), 0.45, F.col("h") > 0.5)
    assert {tuple(r.c) for r in df.select(over.alias("c")).collect()} == {(255, 100, 1), (int(255 * 0.55 + 44 * 0.45), int(100 * 0.55 + 210 * 0.45), int(0.55 + 163 * 0.45))}


def test_versions(spark):
    row = manifests.stamped(spark.range(1)).first()
    assert row.runtime["spark"] == spark.version and row.runtime["numpy"] == np.__version__


def test_indexed_images_of_odd_width(spark):
    draw = np.random.default_rng(3)
    palette = draw.integers(0, 256, (256, 3), dtype=np.uint8)
    for shape in ((3, 5), (1, 1), (4, 8)):
        idx = draw.integers(0, 256, shape, dtype=np.uint8)
        data = files.indexed_bmp(idx, palette)
        got, colours = files.indexed_pixels(data)
        assert (got == idx).all() and (colours == palette).all() and struct.unpack_from("<I", data, 2)[0] == len(data)
    tiles = spark.createDataFrame([("a", *shape, idx.ravel().tolist())], "name string, height int, width int, data array<int>")
    rows = files.read_indexed(spark, files.write_indexed(tiles, palette)).collect()
    assert {(r.y, r.x): (r.idx, r.r, r.g, r.b) for r in rows} == {(y, x): (int(v), *palette[v].tolist()) for (y, x), v in np.ndenumerate(idx)}


def test_merged_annotations(spark):
    tiles = spark.createDataFrame([("a", 1, 0, 0, 3, 2), ("b", 1, 2, 0, 5, 2), ("c", 2, 0, 0, 1, 1)], "image string, scene long, x0 int, y0 int, x1 int, y1 int")
    pixels = spark.createDataFrame([("a", 0, 2), ("a", 0, 2), ("a", 1, 2), ("b", 1, 2), ("b", 1, 4)], "image string, y int, x int")
    got = {(r.scene, r.y, r.x): (r.covered, r.mask, r.conflict) for r in files.merged(pixels, tiles).collect()}
    assert len(got) == 11 and got[2, 0, 0] == (1, 0, 0)
    assert got[1, 0, 2] == (2, 1, 1) and got[1, 1, 2] == (2, 1, 0) and got[1, 1, 4] == (1, 1, 0) and got[1, 0, 0] == (1, 0, 0)
    documents = files.annotation_documents(spark.createDataFrame([("a", 2, 3, [0, 1, 0, 0, 0, 1]), ("b", 2, 3, [0] * 6)], "image string, height int, width int, data array<int>"))
    read = files.read_annotations(spark, files.write_annotations(documents, 1)).collect()
    assert {(r.image, r.y, r.x) for r in read} == {("a", 0, 1), ("a", 1, 2)}


def test_gallery_pages(spark):
    df = spark.range(100).withColumn("odd", F.col("id") % 2 == 1)
    page = lambda k, **how: [(r.id, r.place) for r in manifests.gallery(df, k, [F.desc("id")], **how).collect()]
    assert page(1) == [(79 - k, k) for k in range(20)]
    assert page(2, odd=True) == [(19 - 2 * k, k) for k in range(10)] and page(3, odd=True) == [] and page(0, odd=None)[0] == (99, 0)
