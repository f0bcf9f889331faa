"""Scenes as files: the embeddings' tiles are written as scenes, read back by bands, and validated."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import scenes as S
from gridloom.plans.catalog import query
from gridloom.plans.raster_queries import N, _tiles
from gridloom.session import shared_folder
from gridloom.sources import files
from gridloom.sources.arrays import read_scenes, write_scenes

ANGLE, HEADING, WAVE, LEAST, FRINGE = 35.0, 80.0, 0.0555, 5.0, 1.5


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gridloom-scenes-{uuid.uuid4().hex}"


def _bands(v: str) -> dict[str, str]:
    """SQL of each band at the value v of a tile; fields of one pixel that name one another are put in."""
    los = f"(cos(radians({ANGLE})) * down - sin(radians({ANGLE})) * (sin(radians({HEADING})) * east + cos(radians({HEADING})) * north))"
    steps = {
        "before": f"float(0.01 + 0.01 * {v})", "face1": f"float(0.02 * {v})", "face2": f"float(0.01 * {v} * {v})", "down": "float(face1 + face2)",
        "east": f"float(0.005 * {v})", "north": f"float(-0.004 * {v})", "los": f"float({los})", "phase": f"float(-4 * pi() / {WAVE} * los)",
        "air": f"float(0.001 * {v})", "orbit": f"float(0.1 * {v})", "reference": f"float(phase + orbit - 4 * pi() / {WAVE} * air)",
        "re": "float(cos(reference))", "im": "float(sin(reference))", "wrapped": "float(atan2(im, re))", "water": f"tinyint({v} < -0.2)", "coherence": f"float(greatest(0, least(1, 0.5 + 0.4 * {v})))",
    }
    return steps | {
        "subsidence_before_m": "before", "subsidence_after_m": "float(before + down)", "delta_down_m": "down", "delta_east_m": "east", "delta_north_m": "north", "delta_los_m": "los",
        "deformation_phase_rad": "phase", "reference_phase_rad": "reference", "wrapped_phase_rad": "wrapped", "atmosphere_equivalent_los_m": "air", "orbit_phase_rad": "orbit", "observation_real": "re",
        "observation_imag": "im", "face_1_delta_m": "face1", "face_2_delta_m": "face2", "model_coherence": "coherence", "estimated_coherence": "coherence", "water_mask": "water",
        "mask": f"tinyint(down >= float({LEAST} / 1000))", "face_1_mask": f"tinyint(face1 >= float({LEAST} / 1000))", "face_2_mask": f"tinyint(face2 >= float({LEAST} / 1000))",
        "fringe_mask": f"tinyint(abs(phase) >= float({FRINGE}))", "fringe_valid_mask": "tinyint(1)", "valid_mask": "tinyint(water = 0 AND coherence >= float(0.2))",
    }


def _scene_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a scene with all its bands, images and metadata, made from a tile's values."""
    settings = F.struct(F.lit(N).alias("size"), F.lit(ANGLE).alias("incidence_deg"), F.lit(HEADING).alias("radar_azimuth_deg"), F.lit(WAVE).alias("wavelength_m"), F.lit(LEAST).alias("target_threshold_mm"), F.lit(FRINGE).alias("fringe_threshold_rad"))
    request = F.struct(settings.alias("settings"), F.col("vec_id").alias("seed"))
    metadata = F.to_json(F.struct(request.alias("request"), F.lit("train").alias("split"), S.canonical_sha256(F.to_json(request)).alias("request_sha256")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, for tiles are few bytes beside the work of writing them
    rows = _tiles(spark, sf_dir).repartition(parts, "vec_id").select("vec_id", metadata.alias("metadata"), F.col("data").alias("v"))
    made = _bands("v")
    for name, text in made.items():
        used = [n for n in rows.columns[2:] if re.search(rf"\b{n}\b", text)] or ["v"]
        pixel = re.sub(rf"\b({'|'.join(used)})\b", r"_p.\1", text)
        rows = rows.withColumn(name, F.col(text) if text in used else F.expr(f"transform(arrays_zip({', '.join(used)}), _p -> {pixel})"))
    bands = [b for b in S.BANDS if b in made]
    colours = F.flatten(F.transform("wrapped_phase_rad", S.phase_rgb))
    return rows.select(F.format_string("scene_%06d", "vec_id").alias("scene"), F.lit(N).alias("height"), F.lit(N).alias("width"), "metadata", *bands, colours.alias("image_png"), F.transform("mask", lambda m: m.cast("int") * 255).alias("mask_png"), "vec_id")


@query("scene_files", """SELECT vec_id, round(max(v), 6) AS peak, count(*) FILTER (v >= 0.25) AS positive_px FROM (SELECT vec_id, CAST(embedding[i] AS DOUBLE) AS v, (i - 1) // 8 AS y FROM embeddings, generate_series(1, 64) AS g(i)) WHERE y >= 4 GROUP BY vec_id""")
def scene_files(spark, sf_dir):
    """Scenes written as array files and read back, two bands of many and the lower half of their lines."""
    path = _folder(spark)
    tiles = _tiles(spark, sf_dir).select(F.format_string("scene_%06d", "vec_id").alias("scene"), F.lit(N).alias("height"), F.lit(N).alias("width"), F.col("data").cast("array<float>").alias("dem_m"), F.transform("data", lambda v: (v * 100).cast("float")).alias("unused_cm"), F.transform("data", lambda v: (v >= 0.25).cast("tinyint")).alias("mask"))
    write_scenes(tiles, path)
    rows = read_scenes(spark, path, "dem_m", "mask", rows=2, lines=(4, N)).select("scene", F.explode(F.arrays_zip("dem_m", "mask")).alias("p"))
    return rows.groupBy(F.substring("scene", 7, 6).cast("long").alias("vec_id")).agg(F.round(F.max(F.col("p.dem_m").cast("double")), 6).alias("peak"), F.sum(F.col("p.mask").cast("long")).alias("positive_px"))


def _first(band: str, change: Column) -> Column:
    return F.transform(band, lambda v, i: F.when(i == 0, change).otherwise(v))


#: damage: rules that it breaks; vec_id % 25 tells which.
DAMAGE = {3: ("faces", "face_2_mask"), 7: ("finite", "wrapped_phase", "image.png"), 11: ("model_coherence",), 13: ("mask.png",), 17: ("request_sha256",), 19: ("bands",), 21: ("epochs",)}
RULES = [*S.RULES, *S.WHOLE, "image.png", "mask.png"]
BROKEN = " ".join(f"WHEN '{rule}' THEN count(*) FILTER (vec_id % 25 IN ({', '.join(str(d) for d, broken in DAMAGE.items() if rule in broken) or '-1'}))" for rule in RULES)


@query("stored_scene_checks", f"SELECT rule, CASE rule {BROKEN} END AS failed, count(*) AS scenes FROM embeddings, (SELECT unnest({RULES}) AS rule) GROUP BY rule")
def stored_scene_checks(spark, sf_dir):
    """Scenes written with bands, images and metadata, some of them damaged, and read back: which rules each breaks."""
    path, kind = _folder(spark), F.col("vec_id") % 25
    rows = _scene_rows(spark, sf_dir)
    damaged = {
        "face_2_delta_m": F.when(kind == 3, F.transform("face_2_delta_m", lambda v: (v + 0.01).cast("float"))).otherwise(F.col("face_2_delta_m")),
        "wrapped_phase_rad": F.when(kind == 7, _first("wrapped_phase_rad", F.lit(float("nan")).cast("float"))).otherwise(F.col("wrapped_phase_rad")),
        "model_coherence": F.when(kind == 11, _first("model_coherence", F.lit(1.5).cast("float"))).otherwise(F.col("model_coherence")),
        "mask_png": F.when(kind == 13, F.transform("mask_png", lambda v, i: F.when(i == 5, 255 - v).otherwise(v))).otherwise(F.col("mask_png")),
        "metadata": F.when(kind == 17, F.regexp_replace("metadata", '"seed":', '"seed":1')).otherwise(F.col("metadata")),
        "orbit_phase_rad": F.when(kind != 19, F.col("orbit_phase_rad")),
        "subsidence_after_m": F.when(kind == 21, _first("subsidence_after_m", F.lit(2.0).cast("float"))).otherwise(F.col("subsidence_after_m")),
    }
    write_scenes(rows.withColumns(damaged).drop("vec_id"), path)
    drawn = {"image": (3, F.flatten(F.transform("wrapped_phase_rad", S.phase_rgb))), "mask": (1, F.transform("mask", lambda m: m.cast("int") * 255))}
    found = S.checked(read_scenes(spark, path, *S.BANDS, images=tuple(drawn)), drawn)
    return found.groupBy("rule").agg(F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("scenes"))


@query("annotation_merge", """WITH t AS (SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, embedding[i] AS v FROM embeddings, generate_series(1, 64) AS g(i)),
w AS (SELECT vec_id, y, x, v >= 0.05 AS m FROM t WHERE x < 5 UNION ALL SELECT vec_id, y, x, v >= 0.06 FROM t WHERE x >= 3),
p AS (SELECT vec_id, y, x, count(*) AS covered, bool_or(m) AS mask, bool_or(m) <> bool_and(m) AS conflict FROM w GROUP BY vec_id, y, x)
SELECT vec_id, count(*) AS pixels, CAST(sum(covered) AS BIGINT) AS covered, count(*) FILTER (mask) AS union_px, count(*) FILTER (conflict) AS conflicts FROM p GROUP BY vec_id""")
def annotation_merge(spark, sf_dir):
    """Two overlapping annotations a scene, written as documents, read, placed by their tiles, and merged: union, coverage, conflicts."""
    views = _tiles(spark, sf_dir).withColumn("view", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("x0"), F.lit(b).alias("x1"), F.lit(t).alias("least")) for n, a, b, t in (("left", 0, 5, 0.05), ("right", 3, N, 0.06))))))
    views = views.select("vec_id", "data", "view.*").withColumn("image", F.format_string("%06d_%s.png", "vec_id", "name")).withColumn("width", F.col("x1") - F.col("x0"))
    inside = F.filter("data", lambda v, i: (i % N >= F.col("x0")) & (i % N < F.col("x1")))
    masks = views.select("image", F.lit(N).alias("height"), "width", F.transform(inside, lambda v: (v.cast("float") >= F.col("least").cast("float")).cast("int")).alias("data"))
    path = files.write_annotations(files.annotation_documents(masks))
    tiles = views.select("image", "vec_id", "x0", F.lit(0).alias("y0"), "x1", F.lit(N).alias("y1"))
    found = files.merged(files.placed(files.read_annotations(spark, path), tiles.drop("vec_id")), tiles, "vec_id")
    return found.groupBy("vec_id").agg(F.count("*").alias("pixels"), F.sum("covered").alias("covered"), F.sum(F.col("mask").cast("long")).alias("union_px"), F.sum(F.col("conflict").cast("long")).alias("conflicts"))


@query("indexed_images", """WITH p AS (SELECT vec_id, CAST(least(255, greatest(0, floor(embedding[i] * 300 + 100))) AS INTEGER) AS idx FROM embeddings, generate_series(1, 64) AS g(i))
SELECT vec_id, CAST(sum(idx) AS BIGINT) AS total, count(*) FILTER (idx >= 16) AS shown, CAST(sum(idx // 16 * 17) AS BIGINT) AS red, CAST(sum(idx % 16 * 17) AS BIGINT) AS green FROM p GROUP BY vec_id""")
def indexed_images(spark, sf_dir):
    """Tiles written as indexed images with a palette, and read back: indices, colours and what is shown."""
    k = np.arange(256)
    palette = np.stack([k // 16 * 17, k % 16 * 17, 255 - k], axis=1).astype(np.uint8)
    single = lambda n: F.lit(n).cast("float")  # noqa: E731  a whole number beside a float would make doubles
    tiles = _tiles(spark, sf_dir).select(F.format_string("%06d", "vec_id").alias("name"), F.lit(N).alias("height"), F.lit(N).alias("width"), F.transform("data", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("float") * single(300) + single(100)).cast("int")))).alias("data"))
    rows = files.read_indexed(spark, files.write_indexed(tiles, palette))
    name = F.regexp_extract("path", "([0-9]+)[.]bmp$", 1).cast("long")
    return rows.groupBy(name.alias("vec_id")).agg(F.sum(F.col("idx").cast("long")).alias("total"), F.count_if("shown").alias("shown"), F.sum(F.col("r").cast("long")).alias("red"), F.sum(F.col("g").cast("long")).alias("green"))
