"""Readers and writers of manifests, array files, annotation documents and indexed images.

Files come through Spark's binaryFile source, so any store that Spark reads will do."""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gridloom.functions import mathx
from gridloom.session import shared_folder
from gridloom.sources.images import decoded_png

MANIFEST = "scene_id string, group_id string, split string, category string, image string, mask string, arrays string, metadata string"
SAMPLE = "id string, group_id string, source string, status string, split string, case string, style string, template_id string, template_revision int, label_percent double, water_percent double, warnings array<string>"
LABELME = "imagePath string, imageWidth int, imageHeight int, shapes array<struct<label:string,shape_type:string,points:array<array<double>>,mask:string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).csv(path)


def write_manifest(rows: DataFrame) -> str:
    """rows as CSV with the manifest's columns, absent ones null, in the shared folder; gives the path."""
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    path = f"{shared_folder(rows.sparkSession)}/gridloom-manifest-{uuid.uuid4().hex}"
    rows.select(*(F.col(n).cast("string") if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names)).write.option("header", True).csv(path)
    return path


def read_batch_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a JSON manifest, one row each, with the header's name."""
    whole = spark.read.schema(f"name string, samples array<struct<{SAMPLE.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' array', ':array')}>>").json(path, multiLine=True)
    return whole.select("name", F.explode("samples").alias("s")).select("name", "s.*")


def load_dataset(samples: DataFrame, split: str, allow_draft: bool = False) -> DataFrame:
    """Rows of a split; draft labels only on request."""
    return samples.where(F.col("split") == split).where(F.lit(True) if allow_draft else F.col("status") == "accepted")


def save_scenes(pixels: DataFrame, path: str) -> None:
    """One folder a split; an existing target is an error, so nothing is overwritten."""
    pixels.write.mode("errorifexists").partitionBy("split").option("compression", "zstd").parquet(path)


def read_bands(spark: SparkSession, path: str, *bands: str) -> DataFrame:
    """NPZ files -> path, band, kind (type name), height, width, data (array<double>), of the named bands only; a band must have two axes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                with np.load(io.BytesIO(row.content), allow_pickle=False) as z:
                    arrays = {b: z[b] for b in bands if b in z.files}
                for b, a in arrays.items():
                    if a.ndim != 2:
                        raise ValueError(f"band {b} of {row.path} has {a.ndim} axes")
                yield pd.DataFrame([(row.path, b, a.dtype.name, *a.shape, a.astype("f8").ravel()) for b, a in arrays.items()], columns=["path", "band", "kind", "height", "width", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, band string, kind string, height int, width int, data array<double>")


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


# ---- PNG masks in JSON ------------------------------------------------------------------------


def png(array: np.ndarray) -> bytes:
    """8-bit grey (H x W) or RGB (H x W x 3) PNG."""
    kind = 0 if array.ndim == 2 else 2
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(array, np.uint8))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", array.shape[1], array.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def grey(data: bytes) -> np.ndarray:
    """Values of a grey or indexed PNG of 1 or 8 bits, of any row filter."""
    out = decoded_png(data)
    if out.ndim != 2:
        raise ValueError("only grey or indexed masks of 1 or 8 bits, not interlaced, are read")
    return out


def read_annotations(spark: SparkSession, path: str, label: str = "1") -> DataFrame:
    """Annotation documents -> image (base name), width, height, y, x of the pixels that any shape sets.

    Every shape must be a mask of the label, of values 0, 1 and 255, with two finite corners, inside its tile
    when placed by the first corner, rounded; anything else fails the job with the rule's name. Documents without
    shapes give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                def need(ok: bool, rule: str) -> None:
                    if not ok:
                        raise ValueError(f"{rule}: {r.image}")

                need(r.label == label and r.shape_type == "mask" and r.mask is not None, "shape of another class or type")
                points = [list(q) for q in r.points] if r.points is not None else []
                need(len(points) == 2 and all(len(q) == 2 and np.isfinite(q).all() for q in points), "mask corners")
                mask = grey(r.mask)
                need(bool(np.isin(mask, (0, 1, 255)).all()), "mask values")
                left, top = (int(np.rint(v)) for v in points[0])
                need(0 <= left <= r.width - mask.shape[1] and 0 <= top <= r.height - mask.shape[0], "mask beyond its tile")
                y, x = np.nonzero(mask)
                yield pd.DataFrame({"image": r.image, "width": r.width, "height": r.height, "y": (y + top).astype("i4"), "x": (x + left).astype("i4")})

    docs = spark.read.schema(LABELME).json(path, multiLine=True)
    base = F.regexp_extract(F.regexp_replace("imagePath", r"\\\\", "/"), "([^/]*)$", 1)
    shapes = docs.select(base.alias("image"), F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), F.explode("shapes").alias("s"))
    rows = shapes.select("image", "width", "height", "s.label", "s.shape_type", "s.points", F.unbase64(F.substring_index("s.mask", ",", -1)).alias("mask"))
    return rows.mapInPandas(run, "image string, width int, height int, y int, x int").distinct()


def placed(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pixels of tiles in scene coordinates: tiles(image, x0, y0, x1, y1). An annotation without a tile, or of
    another size than its tile, fails the job."""
    rows = pixels.join(tiles, "image", "left")
    rule = F.when(F.col("x0").isNull(), F.concat(F.lit("unmapped annotation: "), "image")).when((F.col("width") != F.col("x1") - F.col("x0")) | (F.col("height") != F.col("y1") - F.col("y0")), F.concat(F.lit("annotation and tile differ in size: "), "image"))
    good = F.when(rule.isNull(), F.lit(True)).otherwise(F.raise_error(rule).cast("boolean"))
    return rows.where(good).select("image", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"))


def merged(placed_pixels: DataFrame, tiles: DataFrame, scene: str = "scene") -> DataFrame:
    """Placed pixels of annotations and all tiles(image, scene, x0, y0, x1, y1), annotated or not -> scene, y, x of each pixel that a
    tile covers, covered (tiles), mask (set in any of them), conflict (set in some only)."""
    set_ = placed_pixels.select("image", "y", "x").distinct().withColumn("_set", F.lit(1))
    rows = tiles.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1))).withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    met = rows.join(set_, ["image", "y", "x"], "left").withColumn("_set", F.coalesce("_set", F.lit(0)))
    return met.groupBy(scene, "y", "x").agg(F.count("*").alias("covered"), F.max("_set").alias("mask"), (F.max("_set") != F.min("_set")).cast("int").alias("conflict"))


def write_annotations(documents: DataFrame, files: int = 8) -> str:
    """annotation_documents() as JSON files (lists of documents) in the shared folder; gives the path."""
    path = f"{shared_folder(documents.sparkSession)}/gridloom-annotations-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("image"), F.lit(files)).cast("int")
    lists = documents.groupBy(part.alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("document"), ","), F.lit("]")).alias("value"))
    lists.write.partitionBy("part").text(path)
    return path


@F.pandas_udf(StringType())
def _mask_text(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    import base64

    return pd.Series([base64.b64encode(png(np.array(d).reshape(h, w) * 255)).decode() for d, h, w in zip(data, height, width)])


def annotation_documents(masks: DataFrame) -> DataFrame:
    """masks(image, height, width, data array<int> of 0 and 1) -> image, document (JSON text)."""
    shape = F.struct(F.lit("1").alias("label"), F.lit("mask").alias("shape_type"), F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.col("width") - 1.0, F.col("height") - 1.0)).alias("points"), _mask_text("data", "height", "width").alias("mask"))
    shapes = F.when(F.array_max("data") == 1, F.array(shape)).otherwise(F.slice(F.array(shape), 1, 0))
    return masks.select("image", F.to_json(F.struct(F.col("height").alias("imageHeight"), F.col("image").alias("imagePath"), F.col("width").alias("imageWidth"), shapes.alias("shapes"))).alias("document"))


def indexed_pixels(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices (top row first) and RGB palette of an 8-bit BMP."""
    if data[:2] != b"BM" or struct.unpack_from("<H", data, 28)[0] != 8:
        raise ValueError("not an indexed BMP")
    start, header, width, height = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<Iii", data, 14)
    used = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(-1, 4)[:, 2::-1]
    rows = np.frombuffer(data, np.uint8, (width + 3) // 4 * 4 * abs(height), start).reshape(abs(height), -1)[:, :width]
    return (rows[::-1] if height > 0 else rows), palette


def indexed_bmp(idx: np.ndarray, palette: np.ndarray) -> bytes:
    """An 8-bit BMP of H x W indices and 256 RGB colours."""
    height, width = idx.shape
    across = (width + 3) // 4 * 4
    rows = np.zeros((height, across), np.uint8)
    rows[:, :width] = idx[::-1]
    colours = np.zeros((256, 4), np.uint8)
    colours[:, :3] = palette[:, ::-1]
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 0, 0, 256, 0)
    return head + colours.tobytes() + rows.tobytes()


def write_indexed(tiles: DataFrame, palette: np.ndarray) -> str:
    """tiles(name, height, width, data of 0 to 255) -> name.bmp a tile, in the shared folder; gives the path. A file that a
    task writes again is the same."""
    from gridloom.sources.arrays import opened

    path = f"{shared_folder(tiles.sparkSession)}/gridloom-indexed-{uuid.uuid4().hex}"
    store, root = opened(path)
    store.create_dir(root, recursive=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(path)
        for frame in frames:
            for r in frame.itertuples():
                image = indexed_bmp(np.array(r.data, np.uint8).reshape(r.height, r.width), palette)
                part = f"{root}/_{r.name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(image)
                store.move(part, f"{root}/{r.name}.bmp")
            yield pd.DataFrame({"n": [len(frame)]})

    tiles.select("name", "height", "width", "data").mapInPandas(run, "n long").agg(F.sum("n")).collect()  # one row
    return path


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    """Indexed BMP files -> path, y, x, idx, r, g, b, shown (brightness bin above 0)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                idx, palette = indexed_pixels(row.content)
                y, x = np.indices(idx.shape)
                rgb = palette[idx.ravel()]
                yield pd.DataFrame({"path": row.path, "y": y.ravel(), "x": x.ravel(), "idx": idx.ravel().astype("i4"), "r": rgb[:, 0].astype("i4"), "g": rgb[:, 1].astype("i4"), "b": rgb[:, 2].astype("i4")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bmp").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, y int, x int, idx int, r int, g int, b int").withColumn("shown", F.shiftright("idx", 4) > 0)


def read_palettes(spark: SparkSession, path: str) -> DataFrame:
    """Indexed BMP files -> path, idx, r, g, b of each palette entry."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                colours = indexed_pixels(row.content)[1].astype("i4")
                yield pd.DataFrame({"path": row.path, "idx": np.arange(len(colours), dtype="i4"), "r": colours[:, 0], "g": colours[:, 1], "b": colours[:, 2]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bmp").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, idx int, r int, g int, b int")


def palette_faults(palettes: DataFrame) -> DataFrame:
    """palettes(path, idx, r, g, b) -> path, entries, scale_error, least_saturation, turn, cyclic: whether an index is
    sixteen brightness levels of sixteen colours that go round the hue circle once, in one direction."""
    rows = palettes.withColumn("level", F.floor(F.col("idx") / 16)).withColumn("code", F.col("idx") % 16)
    full = rows.where("level = 15").select("path", "code", *(F.col(c).alias(f"full_{c}") for c in "rgb"))
    off = F.greatest(*(F.abs(F.col(c) - F.col("level") / 15 * F.col(f"full_{c}")) for c in "rgb"))
    scale = rows.join(full, ["path", "code"]).groupBy("path").agg(F.count("*").alias("entries"), F.max(off).alias("scale_error"))
    hues = full.select("path", "code", mathx.hue(F.col("full_r"), F.col("full_g"), F.col("full_b")).alias("hue"), mathx.saturation(F.col("full_r"), F.col("full_g"), F.col("full_b")).alias("s"))
    after = hues.select("path", F.pmod(F.col("code") - 1, F.lit(16)).cast("int").alias("code"), F.col("hue").alias("after"))
    step = F.pmod(F.col("after") - F.col("hue") + 0.5, F.lit(1.0)) - 0.5
    turns = hues.join(after, ["path", "code"]).groupBy("path").agg(F.min("s").alias("least_saturation"), F.sum(step).alias("turn"), (F.every(step > 0) | F.every(step < 0)).alias("one_way"))
    good = (F.col("entries") == 256) & (F.col("scale_error") <= 2) & (F.col("least_saturation") >= 0.1) & F.col("one_way") & (F.abs(F.abs("turn") - 1) <= 0.05)
    return scale.join(turns, "path", "left").select("path", "entries", "scale_error", "least_saturation", "turn", F.coalesce(good, F.lit(False)).alias("cyclic"))


def write_configs(rows: DataFrame) -> str:
    """One JSON document a row, as lines, in the shared folder; gives the path."""
    path = f"{shared_folder(rows.sparkSession)}/gridloom-configs-{uuid.uuid4().hex}"
    rows.write.option("ignoreNullFields", False).json(path)
    return path


def export_dataset(rows: DataFrame, path: str) -> DataFrame:
    """Save rows(split, category, ..) by split under path/scenes, and the dataset's record beside them: scenes by split
    and category. Neither may be there already."""
    save_scenes(rows, f"{path}/scenes")
    record = rows.groupBy("split", "category").agg(F.count("*").alias("scenes"))
    record.coalesce(1).write.mode("errorifexists").json(f"{path}/dataset")
    return rows.sparkSession.read.schema(record.schema).json(f"{path}/dataset")
