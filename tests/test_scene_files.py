"""The array source and sink, image decoding, and validation of stored scenes."""

import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import scenes as S
from gridloom.sources import arrays
from gridloom.sources.arrays import Bands, read_scenes, write_scenes
from gridloom.sources.images import decoded_png, read_images


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def test_only_the_bytes_of_the_lines_are_read():
    a = np.random.default_rng(1).random((4000, 50)).astype("f4")
    for save, most in ((np.savez, 10 * 200 + 8_000), (np.savez_compressed, 1 << 20)):
        packed = io.BytesIO()
        save(packed, other=np.zeros((4000, 500)), dem=a, mask=(a > 0.5).astype("u1"))
        file = Counted(packed.getvalue())
        assert (Bands(file).lines("dem", 20, 30) == a[20:30]).all()
        assert file.read_bytes < most and most < 0.2 * len(packed.getvalue()) or save is np.savez_compressed
        assert (Bands(file).lines("mask", 3990, 5000) == (a[3990:] > 0.5)).all()
    packed = io.BytesIO()
    np.savez(packed, cube=np.zeros((2, 2, 2)), fortran=np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(ValueError, match="axes"):
        Bands(packed).lines("cube", 0, 1)
    with pytest.raises(ValueError, match="row order"):
        Bands(packed).lines("fortran", 0, 1)


def rows(spark, n, size=6):
    r = np.random.default_rng(4)
    made = [(f"s{k}", size, size, json.dumps({"k": k}), r.random(size * size).tolist(), [int(v) for v in r.integers(0, 2, size * size)], [int(v) for v in r.integers(0, 256, 3 * size * size)]) for k in range(n)]
    return made, spark.createDataFrame(made, "scene string, height int, width int, metadata string, dem_m array<float>, mask array<tinyint>, image_png array<int>")


@pytest.mark.parametrize("compressed", [False, True])
def test_round_trip(spark, tmp_path, compressed):
    made, df = rows(spark, 5)
    write_scenes(df, str(tmp_path), compressed=compressed)
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"s{k}" for k in range(5)]
    assert {p.name for p in (tmp_path / "s0").iterdir()} == {"arrays.npz", "metadata.json", "image.png"}
    got = read_scenes(spark, str(tmp_path), "mask", "dem_m", "absent_m", rows=4).collect()
    assert sorted((r.scene, r.first_row) for r in got) == [(f"s{k}", a) for k in range(5) for a in (0, 4)]
    for name, height, width, metadata, dem, mask, image in made:
        parts = sorted((r for r in got if r.scene == name), key=lambda r: r.first_row)
        assert np.allclose(np.concatenate([r.dem_m for r in parts]), dem) and sum((r.mask for r in parts), []) == mask
        assert {(r.height, r.width, r.metadata, r.absent_m) for r in parts} == {(6, 6, metadata, None)}
        assert parts[0].kinds == {"mask": "uint8:6x6", "dem_m": "float32:6x6"}
        assert decoded_png((tmp_path / name / "image.png").read_bytes()).ravel().tolist() == image


def test_scenes_and_lines_are_chosen_before_files_are_opened(spark, tmp_path):
    write_scenes(rows(spark, 5)[1], str(tmp_path))
    (tmp_path / "s3" / "arrays.npz").write_bytes(b"broken")  # a file that is not opened does no harm
    read = lambda **how: sorted((r.scene, r.first_row, len(r.dem_m)) for r in read_scenes(spark, str(tmp_path), "dem_m", rows=2, **how).collect())
    assert read(scenes=("s1",), lines=(3, 6)) == [("s1", 3, 12), ("s1", 5, 6)]
    assert read(scenes=("s0", "s4", "none"), lines=(0, 2)) == [("s0", 0, 12), ("s4", 0, 12)]
    with pytest.raises(Exception, match="(?i)zip"):
        read()
    df = read_scenes(spark, str(tmp_path), "dem_m", rows=2, scenes=("s0", "s1"))
    assert [df.count(), df.where("scene = 's1'").count(), df.count()] == [6, 3, 6]  # filters of one query do not stay


def test_large_files_are_dealt_by_lines(spark, tmp_path, monkeypatch):
    made, df = rows(spark, 2)
    write_scenes(df, str(tmp_path))
    monkeypatch.setattr(arrays, "WHOLE", 10)
    parts = arrays._Reader({"path": str(tmp_path), "bands": "dem_m", "rows": "4"}).partitions()
    assert [[f[0], f[3], f[4]] for p in parts for f in p.files] == [["s0", 0, 4], ["s0", 4, 6], ["s1", 0, 4], ["s1", 4, 6]]


def test_a_killed_task_leaves_nothing_and_a_second_run_is_whole(spark, tmp_path):
    made, df = rows(spark, 6)
    broken = df.withColumn("dem_m", F.when(F.col("scene") == "s4", F.slice("dem_m", 1, 5)).otherwise(F.col("dem_m")))
    with pytest.raises(Exception):
        write_scenes(broken.repartition(3), str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    half = tmp_path / "_job-0" / "0-0" / "s0"  # what a job that never ended leaves
    half.mkdir(parents=True)
    (half / "arrays.npz").write_bytes(b"half")
    write_scenes(df.repartition(3), str(tmp_path))
    assert sorted(r.scene for r in read_scenes(spark, str(tmp_path), "dem_m").collect()) == [f"s{k}" for k in range(6)]
    with pytest.raises(Exception, match="there already"):
        write_scenes(df, str(tmp_path))
    with pytest.raises(Exception, match="several rows"):
        write_scenes(df.limit(1).union(df.limit(1)).withColumn("scene", F.lit("twice")), str(tmp_path))
    assert not (tmp_path / "twice").exists()
    write_scenes(df.withColumn("mask", F.transform("mask", lambda v: F.lit(1).cast("tinyint"))), str(tmp_path), overwrite=True)
    assert {tuple(r.mask) for r in read_scenes(spark, str(tmp_path), "mask").collect()} == {(1,) * 36}


def test_names_and_empty_folders(spark, tmp_path):
    assert read_scenes(spark, str(tmp_path), "dem_m").collect() == []
    for name in ("", "a/b", "_x", ".x"):
        with pytest.raises(Exception, match="folder's name"):
            write_scenes(rows(spark, 1)[1].withColumn("scene", F.lit(name)), str(tmp_path))


def test_export_layout(spark, tmp_path):
    for kind in ("arrays", "metadata"):
        (tmp_path / "train" / kind).mkdir(parents=True)
    np.savez_compressed(tmp_path / "train" / "arrays" / "x1.npz", dem_m=np.ones((2, 3), "f4"))
    (tmp_path / "train" / "metadata" / "x1.json").write_text('{"split": "train"}')
    assert [(r.scene, r.height, r.width, r.metadata) for r in read_scenes(spark, f"file://{tmp_path}", "dem_m").collect()] == [("x1", 2, 3, '{"split": "train"}')]


def filtered(a, how):
    """PNG bytes of an image of RGB rows, each row filtered as how says."""
    height, width, _ = a.shape
    rows, body = a.reshape(height, -1).astype(int), b""
    for y, kind in enumerate(how):
        line = bytearray()
        for x in range(3 * width):
            left, up = rows[y, x - 3] if x >= 3 else 0, rows[y - 1, x] if y else 0
            both = rows[y - 1, x - 3] if y and x >= 3 else 0
            p = left + up - both
            near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - both), 2, both))[2]
            line.append((rows[y, x] - (0, left, up, (left + up) // 2, near)[kind]) % 256)
        body += bytes([kind]) + bytes(line)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)[:9]) + chunk(b"IDAT", zlib.compress(body)[9:]) + chunk(b"IEND", b"")


def test_images_of_any_filter(spark, tmp_path):
    draw = np.random.default_rng(7)
    for k in range(30):
        a = draw.integers(0, 256, (draw.integers(1, 12), draw.integers(1, 9), 3), dtype=np.uint8)
        data = filtered(a, draw.integers(0, 5, len(a)))
        assert (decoded_png(data) == a).all()
    (tmp_path / "a.png").write_bytes(data)
    (tmp_path / "b.png").write_bytes(data[:30])
    got = {r.path[-5]: r for r in read_images(spark, str(tmp_path)).collect()}
    assert got["a"].data == a.ravel().tolist() and (got["a"].height, got["a"].width, got["a"].channels) == a.shape
    assert got["b"].data is None and got["b"].error


def good(size=5):
    r = np.random.default_rng(0)
    settings = {"size": size, "wavelength_m": 0.055, "incidence_deg": 35.0, "radar_azimuth_deg": 80.0, "target_threshold_mm": 5.0, "fringe_threshold_rad": 1.5}
    f1, f2, east, north, air, orbit, topo = (r.normal(0, 0.01, (size, size)).astype("f4") for _ in range(7))
    before, down = (r.random((size, size)) * 0.1).astype("f4"), f1 + f2
    i, a, turn = np.radians(35.0), np.radians(80.0), 4 * np.pi / 0.055
    los = (down * np.cos(i) - (east * np.sin(a) + north * np.cos(a)) * np.sin(i)).astype("f4")
    phase = (-turn * los).astype("f4")
    reference = (phase - turn * air + orbit + topo).astype("f4")
    re, im = np.cos(reference), np.sin(reference)
    bands = {"subsidence_before_m": before, "subsidence_after_m": before + down, "delta_down_m": down, "delta_east_m": east, "delta_north_m": north, "delta_los_m": los, "deformation_phase_rad": phase, "reference_phase_rad": reference, "wrapped_phase_rad": np.arctan2(im, re), "atmosphere_equivalent_los_m": air, "orbit_phase_rad": orbit, "applied_topographic_phase_rad": topo, "observation_real": re, "observation_imag": im, "face_1_delta_m": f1, "face_2_delta_m": f2, "model_coherence": np.full((size, size), 0.5, "f4"), "estimated_coherence": np.ones((size, size), "f4")}
    masks = {"mask": down >= np.float32(0.005), "face_1_mask": f1 >= np.float32(0.005), "face_2_mask": f2 >= np.float32(0.005), "fringe_mask": np.abs(phase) >= np.float32(1.5), "fringe_valid_mask": np.ones((size, size)), "water_mask": np.zeros((size, size)), "valid_mask": np.ones((size, size))}
    return settings, {n: v.astype("f4") for n, v in bands.items()} | {n: v.astype("u1") for n, v in masks.items()}


def put(path, name, bands, settings, **metadata):
    (path / name).mkdir()
    np.savez(path / name / "arrays.npz", **bands)
    request = {"settings": settings, "b": 1}
    (path / name / "metadata.json").write_text(json.dumps({"request": request, **metadata}))


def failing(spark, path, rows=1024):
    out = {}
    for r in S.checked(read_scenes(spark, str(path), *S.BANDS, rows=rows)).collect():
        out.setdefault(r.scene, set()).update([] if r.passed else [r.rule])
    return out


@pytest.mark.parametrize("lines", [1024, 2])
def test_rules(spark, tmp_path, lines):
    import hashlib

    settings, bands = good()
    told = hashlib.sha256(json.dumps({"settings": settings, "b": 1}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    put(tmp_path, "good", bands, settings, request_sha256=told)
    put(tmp_path, "few", {n: v for n, v in bands.items() if n in S.NEEDED or n == "applied_topographic_phase_rad"}, settings)
    want = {"good": set(), "few": set()}
    changes = {
        "subsidence_after_m": {"epochs"}, "face_1_delta_m": {"faces", "face_1_mask"}, "delta_los_m": {"line_of_sight", "deformation_phase"}, "orbit_phase_rad": {"reference_phase"},
        "observation_real": {"wrapped_phase"}, "mask": {"mask"}, "face_2_mask": {"face_2_mask"}, "fringe_mask": {"fringe_mask"}, "fringe_valid_mask": {"fringe_valid_mask"},
        "water_mask": {"valid_mask"}, "estimated_coherence": {"estimated_coherence"}, "applied_topographic_phase_rad": {"reference_phase"},
    }
    for name, rules in changes.items():
        other = bands[name].copy()
        at = np.unravel_index(np.argmin(other), other.shape)
        other[at] = 1 - other[at] if name.endswith("mask") else other[at] + 1
        put(tmp_path, "x-" + name, bands | {name: other}, settings)
        want["x-" + name] = rules
    put(tmp_path, "type", bands | {"dem_m": np.zeros((5, 5))}, settings)
    put(tmp_path, "shape", bands, settings | {"size": 6})
    put(tmp_path, "missing", {n: v for n, v in bands.items() if n != "delta_east_m"}, settings)
    put(tmp_path, "sum", bands, settings, request_sha256=told[:-1] + ("0" if told[-1] != "0" else "1"))
    odd = bands["observation_imag"].copy()
    odd[2, 2] = np.inf
    put(tmp_path, "odd", bands | {"observation_imag": odd}, settings)
    want |= {"type": {"types"}, "shape": {"shape"}, "missing": {"bands"}, "sum": {"request_sha256"}, "odd": {"finite", "wrapped_phase"}}
    assert failing(spark, tmp_path, lines) == want


def test_scenes_without_metadata_fail(spark, tmp_path):
    settings, bands = good()
    put(tmp_path, "a", bands, settings)
    (tmp_path / "a" / "metadata.json").unlink()
    assert {"line_of_sight", "mask", "shape"} <= failing(spark, tmp_path)["a"]


def test_images_against_arrays(spark, tmp_path):
    made, df = rows(spark, 4)
    df = df.withColumn("mask_png", F.transform("mask", lambda m: m.cast("int") * 255))
    df = df.withColumn("mask_png", F.when(F.col("scene") == "s1", F.transform("mask_png", lambda v, i: F.when(i == 35, 255 - v).otherwise(v))).otherwise(F.col("mask_png")))
    write_scenes(df, str(tmp_path))
    (tmp_path / "s2" / "mask.png").unlink()
    (tmp_path / "s3" / "mask.png").write_bytes(b"no image")
    scenes = read_scenes(spark, str(tmp_path), "mask", rows=4)
    drawn = {"mask": (1, F.transform("mask", lambda m: m.cast("int") * 255))}
    got = {r.scene: (r.largest, r.passed) for r in S.images_checked(scenes, read_images(spark, str(tmp_path)), drawn).collect()}
    assert got == {"s0": (0, True), "s1": (1, False), "s2": (float("inf"), False), "s3": (float("inf"), False)}


def test_many_small_scenes_are_dealt_by_number_and_their_headers_read_once(spark, tmp_path, monkeypatch):
    write_scenes(rows(spark, 7)[1], str(tmp_path))
    (tmp_path / "_job-0" / "s9").mkdir(parents=True)
    (tmp_path / "_job-0" / "s9" / "arrays.npz").write_bytes(b"half")
    monkeypatch.setattr(arrays, "FILES", 3)
    reader, parsed = arrays._Reader({"path": str(tmp_path), "bands": "dem_m,mask", "images": "image"}), []
    parts = reader.partitions()
    assert [[f[0] for f in p.files] for p in parts] == [["s0", "s1", "s2"], ["s3", "s4", "s5"], ["s6"]]
    read_header = arrays._read_header
    monkeypatch.setattr(arrays, "_read_header", lambda read: parsed.append(1) or read_header(read))
    assert [b.num_rows for p in parts for b in reader.read(p)] == [3, 3, 1] and len(parsed) == 7 * 2


def test_scenes_are_read_once_with_their_images(spark, tmp_path):
    settings, bands = good(6)
    for name in ("whole", "other", "none", "broken", "size"):
        put(tmp_path, name, bands, settings)
        image = np.rint(255 * bands["mask"]).astype(np.uint8)
        image[5, 5] ^= 255 if name == "other" else 0
        if name != "none":
            (tmp_path / name / "mask.png").write_bytes(b"no image" if name == "broken" else arrays.png(image[:5] if name == "size" else image))
    drawn = {"mask": (1, F.transform("mask", lambda m: m.cast("int") * 255))}
    for lines in (1024, 4):
        scenes = read_scenes(spark, str(tmp_path), *S.BANDS, rows=lines, images=("mask",))
        found = S.checked(scenes, drawn)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BatchScan") == 1 and "Join" not in plan  # before: three scans and two joins
        got = {r.scene: (r.largest, r.passed) for r in found.where("rule = 'mask.png'").collect()}
        inf = float("inf")
        assert got == {"whole": (0, True), "other": (1, False), "none": (inf, False), "broken": (inf, False), "size": (inf, False)}
        apart = S.images_checked(scenes, read_images(spark, str(tmp_path)), drawn)
        assert got == {r.scene: (r.largest, r.passed) for r in apart.collect()}
        assert {r.rule for r in found.where("NOT passed").collect()} == {"mask.png"}


def test_values_that_are_no_bytes_are_not_written(spark, tmp_path):
    for change in (F.lit(-1), F.lit(None)):
        with pytest.raises(Exception, match="no bytes"):
            write_scenes(rows(spark, 2)[1].withColumn("mask", F.transform("mask", lambda m, i: F.when(i > 0, m).otherwise(change).cast("tinyint"))), str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    write_scenes(rows(spark, 1)[1].withColumn("dem_m", F.transform("dem_m", lambda v, i: F.when(i > 0, v))), str(tmp_path))
    assert np.isnan(read_scenes(spark, str(tmp_path), "dem_m").collect()[0].dem_m[0])
