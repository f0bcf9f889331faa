"""Operators against brute force, closed forms and invariants."""

import hashlib
import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import mathx
from gridloom.operators import fields, manifests, metrics, raster, regions
from gridloom.sources import files
from gridloom.streaming import jobs


def flood(mask):
    seen, sizes = set(), []
    for y, x in zip(*np.nonzero(mask)):
        stack, n = [(y, x)], 0
        while stack:
            p = stack.pop()
            if p in seen or not (0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1]) or not mask[p]:
                continue
            seen.add(p)
            n += 1
            stack += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        if n:
            sizes.append(n)
    return sorted(sizes)


def test_regions_match_flood_fill(spark):
    masks = {k: np.random.default_rng(k).random((13, 17)) < 0.35 for k in range(6)}
    masks[6] = np.zeros((13, 17), bool)
    rows = [(k, int(y), int(x), 1) for k, m in masks.items() for y, x in zip(*np.nonzero(m))]
    runs = raster.runs(spark.createDataFrame(rows, "k int, y int, x int, v int"), "k")
    tiles = spark.createDataFrame([(k, m.astype(int).ravel().tolist()) for k, m in masks.items()], "k int, data array<int>")
    closure, inside = regions.labelled_runs(runs, "k", 17), regions.labelled_tiles(tiles, "k", 17)
    names = ["k", "y", "lo", "hi", "id", "label"]
    assert sorted(map(tuple, closure.select(names).collect())) == sorted(map(tuple, inside.select(names).collect()))
    found = regions.regions(inside, "k").toPandas()
    for k, m in masks.items():
        assert sorted(found[found.k == k].area_px) == flood(m)


def test_spiral_region_is_one(spark):
    n, m = 15, np.zeros((15, 15), int)
    y, x, dy, dx = 0, 0, 0, 1
    m[0, 0] = 1
    for _ in range(200):
        a, b = y + 2 * dy, x + 2 * dx
        if not (0 <= a < n and 0 <= b < n) or m[a, b]:
            dy, dx = dx, -dy
            a, b = y + 2 * dy, x + 2 * dx
            if not (0 <= a < n and 0 <= b < n) or m[a, b]:
                break
        y, x = y + dy, x + dx
        m[y, x] = 1
    rows = [(0, int(a), int(b), 1) for a, b in zip(*np.nonzero(m))]
    runs = raster.runs(spark.createDataFrame(rows, "k int, y int, x int, v int"), "k")
    assert regions.regions(regions.labelled_runs(runs, "k", n), "k").count() == len(flood(m)) == len({r[3] for r in regions.tile_runs(m)})


def test_box_mean(spark):
    a = np.random.default_rng(1).random((6, 7))
    got = spark.createDataFrame([(a.ravel().tolist(),)], "data array<double>").select(raster.box_mean(F.col("data"), 3, 6, 7)).first()[0]
    p = np.pad(a, 1, mode="reflect")
    want = np.array([[p[y : y + 3, x : x + 3].mean() for x in range(7)] for y in range(6)])
    assert np.allclose(np.array(got).reshape(6, 7), want)


def test_gradient_and_rotation(spark):
    a = np.random.default_rng(2).random((5, 5))
    df = spark.createDataFrame([(a.ravel().tolist(),)], "data array<double>")
    one = lambda c: np.array(df.select(c).first()[0]).reshape(5, 5)
    assert np.allclose(one(raster.gradient(F.col("data"), "y", -2.0, 5, 5)), np.gradient(a, -2.0, axis=0))
    for k in range(4):
        assert np.allclose(one(raster.rotated(F.col("data"), k, False, 5, 5)), np.rot90(a, k))


def test_erf(spark):
    x = [k / 20 for k in range(-140, 141)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(mathx.erf(F.col("x"))).collect()]
    assert max(abs(g - math.erf(v)) for g, v in zip(got, x)) < 1e-14


def test_face_is_a_rectangle_when_done(spark):
    grid = fields.grid(spark, 9, 800.0)
    whole = lambda n: fields.face_epoch(grid, fields.segments(spark, (-200, 200), (-100, 100), n, 0.0, 10.0), 1e6, 150.0, 2.0, 5.0).orderBy("y", "x").toPandas().down_m
    assert np.allclose(whole(1), whole(16), atol=1e-12)


def test_scenes_repeat(spark):
    r = spark.createDataFrame([(1, 30.0, 10.0), (2, 5.0, 80.0)], "scene_id long, depth double, turn double")
    a, b = (fields.simulate(r, 16).orderBy("scene_id", "y", "x").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(a, b)
    assert (a.coherence.between(0, 1)).all() and (a.wrapped_rad.abs() <= np.float32(math.pi)).all()
    assert (a["mask"] == (a.down_m >= np.float32(0.005)).astype(int)).all()


def test_metrics_null(spark):
    df = spark.createDataFrame([(0, 0, 0, 9), (3, 1, 1, 0)], "tp int, fp int, fn int, tn int")
    a, b = metrics.scores(df).collect()
    assert a.iou is None and a.f1 is None and b.iou == 0.6


def test_scored(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id int, x array<double>")
    out = metrics.scored(df, lambda m: m.sum(1), "x", "id int, score double").collect()
    assert sorted(map(tuple, out)) == [(1, 3.0), (2, 7.0)]


@pytest.mark.parametrize("n", [20, 37, 199])
def test_split_quota(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 3).alias("c"))
    got = manifests.stratified_split(df, "c", "id", mathx.uniform(1, "s", "id")).groupBy("split").count().collect()
    sizes = {r.split: r["count"] for r in got}
    assert sizes["test"] == sizes["validation"] == int(n * 0.1 + 0.5) and sum(sizes.values()) == n


def test_strict(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    rules = {"a": F.col("a") > 0}
    assert [r.v for r in df.select(manifests.violations(rules).alias("v")).collect()] == [[], ["a"]]
    with pytest.raises(Exception, match="invalid: a"):
        manifests.strict(df, rules).collect()


def test_overlapping_intervals(spark):
    r = np.random.default_rng(3)
    a = [(int(s), int(s + w)) for s, w in zip(r.integers(0, 500, 80), r.integers(0, 90, 80))]
    df = spark.createDataFrame([(0, i, *v) for i, v in enumerate(a)], "k int, i int, lo long, hi long")
    got = manifests.overlapping(df, df.toDF("k", "j", "lo2", "hi2"), 32, "k").select("i", "j").collect()
    want = {(i, j) for i, (p, q) in enumerate(a) for j, (s, t) in enumerate(a) if q > p and t > s and p < t and s < q}
    assert sorted(map(tuple, got)) == sorted(want)


def test_pending(spark):
    assert manifests.pending(spark.range(5), spark.range(3), "id").count() == 2


def test_annotations_round_trip(spark, tmp_path):
    rows = []
    for k in range(3):
        m = (np.random.default_rng(k).random((4, 5)) < 0.4).astype(int)
        rows.append((f"t{k}.png", 4, 5, m.ravel().tolist()))
    rows.append(("empty.png", 2, 2, [0, 0, 0, 0]))
    docs = files.annotation_documents(spark.createDataFrame(rows, "image string, height int, width int, data array<int>")).collect()
    for d in docs:
        (tmp_path / f"{d.image}.json").write_text(d.document)
    got = files.read_annotations(spark, str(tmp_path)).toPandas()
    for name, h, w, data in rows:
        own = got[got.image == name]
        assert sorted(own.y * w + own.x) == [i for i, v in enumerate(data) if v]


def mask_document(tmp_path, name, mask, left=0.0, top=0.0, size=(8, 8), **other):
    import base64
    import json

    png = mask if isinstance(mask, bytes) else files.png(np.array(mask))
    shape = {"label": "1", "shape_type": "mask", "points": [[left, top], [left + 1.0, top + 1.0]], "mask": base64.b64encode(png).decode()} | other
    (tmp_path / f"{name}.json").write_text(json.dumps({"imagePath": f"dir\\\\{name}.png", "imageWidth": size[1], "imageHeight": size[0], "shapes": [shape]}))


def test_annotation_values_and_corners(spark, tmp_path):
    """Values of 1 count as set, corners are rounded, one-bit masks are read."""
    import zlib

    mask_document(tmp_path, "ones", [[0, 1], [1, 1]], 2.6, 1.4)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    bits = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 1, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\xa0\0\x40")) + chunk(b"IEND", b"")
    mask_document(tmp_path, "bits", bits)
    got = {(r.image, r.y, r.x) for r in files.read_annotations(spark, str(tmp_path)).collect()}
    assert got == {("ones.png", 1, 4), ("ones.png", 2, 3), ("ones.png", 2, 4), ("bits.png", 0, 0), ("bits.png", 0, 2), ("bits.png", 1, 1)}
    tiles = spark.createDataFrame([("ones.png", 10, 20, 18, 28), ("bits.png", 0, 0, 8, 8)], "image string, x0 int, y0 int, x1 int, y1 int")
    assert ("ones.png", 21, 14) in {tuple(r) for r in files.placed(files.read_annotations(spark, str(tmp_path)), tiles).collect()}
    for bad, rule in ((tiles.where("image = 'bits.png'"), "unmapped annotation"), (tiles.withColumn("x1", F.col("x1") + 1), "differ in size")):
        with pytest.raises(Exception, match=rule):
            files.placed(files.read_annotations(spark, str(tmp_path)), bad).collect()


@pytest.mark.parametrize("how,rule", [({"mask": [[0, 7]]}, "mask values"), ({"label": "2"}, "another class"), ({"shape_type": "polygon"}, "another class"), ({"points": [[0.0, 0.0]]}, "mask corners"), ({"left": 7.0}, "beyond its tile"), ({"top": -1.0}, "beyond its tile")])
def test_annotations_refused(spark, tmp_path, how, rule):
    mask_document(tmp_path, "a", **({"mask": [[0, 255]]} | {k: v for k, v in how.items() if k in ("mask", "left", "top")}), **{k: v for k, v in how.items() if k not in ("mask", "left", "top")})
    with pytest.raises(Exception, match=rule):
        files.read_annotations(spark, str(tmp_path)).collect()


def test_png_filters():
    """Rows of every filter kind decode to the same values."""
    import zlib

    a = np.random.default_rng(2).integers(0, 256, (5, 9), dtype=np.uint8).astype(int)
    body = b""
    for y, row in enumerate(a):
        up = a[y - 1] if y else np.zeros(9, int)
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], up[:-1]])
        paeth = [min(((abs(int(u) - int(c)), 0, l), (abs(int(l) - int(c)), 1, u), (abs(int(l) + int(u) - 2 * int(c)), 2, c)))[2] for l, u, c in zip(left, up, corner)]
        body += bytes([y]) + ((row - (0, left, up, (left + up) // 2, np.array(paeth))[y]) % 256).astype(np.uint8).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + b"0000"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body))
    assert (files.grey(data) == a).all()


def test_bands_and_hashes(spark, tmp_path):
    np.savez_compressed(tmp_path / "a.npz", dem=np.arange(6, dtype="f4").reshape(2, 3), other=np.zeros(2))
    got = files.read_bands(spark, str(tmp_path), "dem").collect()
    assert [(r.band, r.kind, r.height, r.width, r.data) for r in got] == [("dem", "float32", 2, 3, [0, 1, 2, 3, 4, 5])]
    with pytest.raises(Exception, match="band other"):
        files.read_bands(spark, str(tmp_path), "other").collect()
    assert [(r.length, r.sha256) for r in files.content_hashes(spark, str(tmp_path)).collect()] == [((tmp_path / "a.npz").stat().st_size, hashlib.sha256((tmp_path / "a.npz").read_bytes()).hexdigest())]


def test_manifests_are_read(spark, tmp_path):
    import json

    (tmp_path / "m.csv").write_text("scene_id,group_id,split,category,image,mask,arrays,metadata\ns1,g,train,c,i.png,m.png,a.npz,j.json\n")
    assert files.read_manifest(spark, str(tmp_path / "m.csv")).first().asDict() == {"scene_id": "s1", "group_id": "g", "split": "train", "category": "c", "image": "i.png", "mask": "m.png", "arrays": "a.npz", "metadata": "j.json"}
    (tmp_path / "m.json").write_text(json.dumps({"name": "b", "samples": [{"id": "x", "status": "draft", "split": "train", "template_revision": 3, "label_percent": 1.5, "warnings": ["w"]}, {"id": "y", "status": "accepted", "split": "train"}]}, indent=1))
    m = files.read_batch_manifest(spark, str(tmp_path / "m.json"))
    assert [(r.name, r.id, r.template_revision, r.warnings) for r in m.orderBy("id").collect()] == [("b", "x", 3, ["w"]), ("b", "y", None, None)]
    assert [r.id for r in files.load_dataset(m, "train").collect()] == ["y"] and files.load_dataset(m, "train", True).count() == 2


def test_scenes_are_not_overwritten(spark, tmp_path):
    rows = spark.range(4).withColumn("split", F.when(F.col("id") < 2, "a").otherwise("b"))
    files.save_scenes(rows, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=a", "split=b"] and spark.read.parquet(str(tmp_path / "s")).count() == 4
    with pytest.raises(Exception, match="(?i)exists"):
        files.save_scenes(rows, str(tmp_path / "s"))


def test_wide_mean_and_padding(spark):
    a = np.random.default_rng(1).random((9, 7))
    df = spark.createDataFrame([(1, a.ravel().tolist())], "k int, data array<double>")
    for size in (1, 3, 7):
        p = size // 2
        b = np.pad(a, p, mode="reflect")
        want = np.lib.stride_tricks.sliding_window_view(b, (size, size)).mean((2, 3))
        got = raster.wide_mean(df, size, 9, 7, "k").orderBy("y", "x").toPandas().v.to_numpy().reshape(9, 7)
        assert np.allclose(got, want)
    for mode, name in (("reflected", "reflect"), ("edge", "edge"), ("constant", "constant")):
        assert np.allclose(np.reshape(df.select(raster.padded(F.col("data"), 2, mode, 9, 7)).first()[0], (13, 11)), np.pad(a, 2, mode=name))


def test_finished_plan_and_flat_tile(spark):
    plan = spark.createDataFrame([(1, True), (2, True)], "id long, done boolean")
    assert tuple(manifests.resume_state(plan).first()) == (2, 2, 0, 2)
    assert tuple(manifests.resume_state(plan.withColumn("done", F.col("id") == 1)).first()) == (2, 1, 1, 1)


def test_weighted_picks(spark):
    r = np.random.default_rng(5)
    w = r.integers(0, 9, 50)
    u = r.random(300)
    items = spark.createDataFrame([(k * 1000, int(x)) for k, x in enumerate(w)], "k long, w int")
    got = manifests.weighted_picks(items, spark.createDataFrame([(i, float(x)) for i, x in enumerate(u)], "i int, u double"), "k", "w").collect()
    want = {i: 1000 * int(np.searchsorted(np.cumsum(w), x * w.sum(), side="right")) for i, x in enumerate(u)}
    assert {x.i: x.k for x in got} == want and len(got) == 300


def test_snapshots(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, t string")
    after = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k int, t string")
    got = {r.k: r.change for r in manifests.changes(manifests.snapshot(before, "k", "t"), manifests.snapshot(after, "k", "t"), "k").collect()}
    assert got == {1: "removed", 2: "altered", 3: "same", 4: "added"}


def test_indexed_image(spark, tmp_path):
    idx = np.arange(256, dtype=np.uint8).reshape(16, 16)
    palette = np.stack([np.arange(256)] * 3 + [np.zeros(256)], 1).astype(np.uint8)
    body = idx[::-1].tobytes()
    head = b"BM" + struct.pack("<IHHI", 54 + 1024 + 256, 0, 0, 54 + 1024) + struct.pack("<IiiHHIIiiII", 40, 16, 16, 1, 8, 0, 256, 0, 0, 256, 0)
    (tmp_path / "a.bmp").write_bytes(head + palette.tobytes() + body)
    got = files.read_indexed(spark, str(tmp_path)).orderBy("y", "x").toPandas()
    assert got.idx.tolist() == list(range(256)) and got.r.tolist() == list(range(256)) and got.shown.sum() == 240


def test_palettes(spark, tmp_path):
    """A palette of sixteen levels of a colour cycle, one that jumps, and one of greys."""
    import colorsys

    cycle = np.array([colorsys.hsv_to_rgb(k / 16, 0.9, 1.0) for k in range(16)]) * 255
    jump = cycle[[0, 5, 2, 3, 4, 1, *range(6, 16)]]
    for name, top in (("cycle", cycle), ("back", cycle[::-1]), ("jump", jump), ("grey", np.full((16, 3), 200.0))):
        table = np.round(np.arange(16)[:, None, None] / 15 * top).reshape(256, 3)
        palette = np.concatenate([table[:, ::-1], np.zeros((256, 1))], 1).astype(np.uint8)
        head = b"BM" + struct.pack("<IHHI", 54 + 1024 + 4, 0, 0, 54 + 1024) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 8, 0, 4, 0, 0, 256, 0)
        (tmp_path / f"{name}.bmp").write_bytes(head + palette.tobytes() + b"\0\0\0\0")
    got = {r.path.rsplit("/", 1)[-1][:-4]: r.cyclic for r in files.palette_faults(files.read_palettes(spark, str(tmp_path))).collect()}
    assert got == {"cycle": True, "back": True, "jump": False, "grey": False}


def test_scene_stream_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda k: (tmp_path / "in" / f"{k}.json").write_text(f'{{"scene_id": {k}, "depth": 20.0, "turn": 5.0}}\n')
    run = lambda: jobs.scenes(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at"), 8).awaitTermination()
    put(1), run(), put(2), run(), run()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("scene_id").distinct().collect()) == [1, 2]


def test_session_stream(spark, sf):
    s = jobs.drained(jobs.sessions(jobs.event_stream(spark, sf)))
    assert s.agg(F.sum("events")).first()[0] == 1000


@pytest.mark.parametrize("space,n", [(64, 40), (48, 30), (2**32, 50)])
def test_fresh_draws(spark, space, n):
    """Against the sequential loop: key after key, each draws until its seed is new."""
    used = set(range(0, 36, 2))
    draw = lambda k, t: int(int(hashlib.md5(f"8:seed:{k}:{t}".encode()).hexdigest()[:12], 16) / 2**48 * space)
    want, forbidden = {}, set(used)
    for k in range(n):
        t = 0
        while draw(k, t) in forbidden:
            t += 1
        want[k] = (t, draw(k, t))
        forbidden.add(draw(k, t))
    plan = spark.range(n).withColumnRenamed("id", "k")
    got = manifests.fresh_draws(plan, spark.createDataFrame([(s,) for s in used], "seed long"), "k", 8, "seed", space).collect()
    assert {r.k: (r.tries, r.seed) for r in got} == want and len(got) == n


def test_fresh_seed_plan_is_whole(spark, sf):
    from gridloom.plans import catalog

    got = catalog.QUERIES["fresh_seed_plan"](spark, sf)
    used = {r.user_id for r in spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'").select("user_id").collect()}
    rows = got.collect()
    orders = [r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()]
    assert sorted(r.o_orderkey for r in rows) == sorted(orders)
    assert len({r.seed for r in rows}) == len(rows) and not used & {r.seed for r in rows}
