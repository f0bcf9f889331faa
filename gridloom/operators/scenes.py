"""Validation of stored scenes: bands, metadata and images against each other, by a table of rules.

A rule is two SQL expressions over the values of a pixel and the scene's settings that have to agree within a tolerance, and
holds where its bands are stored. Pixels are checked where they were read and the largest violations of a scene are
aggregated, so a scene may be of any size. Names of bands, settings and metadata are fixed values of the format."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The bands of a stored scene.
FLOATS = (
    "subsidence_before_m", "subsidence_after_m", "delta_down_m", "delta_east_m", "delta_north_m", "delta_los_m", "deformation_phase_rad",
    "reference_phase_rad", "wrapped_phase_rad", "atmosphere_equivalent_los_m", "orbit_phase_rad", "observation_real", "observation_imag",
    "face_1_delta_m", "face_2_delta_m", "dem_m", "dem_error_m", "topographic_phase_rad", "residual_topographic_phase_rad",
    "applied_topographic_phase_rad", "height_atmosphere_los_m", "model_coherence", "backscatter_power", "estimated_coherence",
    "intensity_before", "intensity_after",
)
MASKS = ("mask", "fringe_mask", "fringe_valid_mask", "face_1_mask", "face_2_mask", "water_mask", "valid_mask")
BANDS = FLOATS + MASKS
#: Bands without which a scene can't be used.
NEEDED = ("subsidence_before_m", "subsidence_after_m", "delta_down_m", "delta_east_m", "delta_north_m", "delta_los_m", "deformation_phase_rad", "reference_phase_rad", "wrapped_phase_rad", "atmosphere_equivalent_los_m", "orbit_phase_rad", "observation_real", "observation_imag", "face_1_delta_m", "face_2_delta_m", "mask", "face_1_mask", "face_2_mask")

SETTINGS = "size int, incidence_deg double, radar_azimuth_deg double, wavelength_m double, target_threshold_mm double, fringe_threshold_rad double, valid_coherence_threshold double"
METADATA = f"request struct<settings:struct<{SETTINGS.replace(' int', ':int').replace(' double', ':double')}>>, split string, group_id string, request_sha256 string"
LOOK = "radians(incidence_deg)"
HEADING = "radians(radar_azimuth_deg)"
RELATIVE = 1e-7  # of the second side, beside each tolerance
TURN = "2 * pi()"

#: name: (one side, the other, tolerance, bands)
RULES: dict[str, tuple[str, str, float, tuple[str, ...]]] = {
    "epochs": ("delta_down_m", "subsidence_after_m - subsidence_before_m", 1e-7, ("delta_down_m", "subsidence_after_m", "subsidence_before_m")),
    "faces": ("delta_down_m", "face_1_delta_m + face_2_delta_m", 1e-7, ("delta_down_m", "face_1_delta_m", "face_2_delta_m")),
    "line_of_sight": ("delta_los_m", f"cos({LOOK}) * delta_down_m - sin({LOOK}) * (sin({HEADING}) * delta_east_m + cos({HEADING}) * delta_north_m)", 1e-7, ("delta_los_m", "delta_down_m", "delta_east_m", "delta_north_m")),
    "deformation_phase": ("deformation_phase_rad", f"-2 * {TURN} / wavelength_m * delta_los_m", 2e-5, ("deformation_phase_rad", "delta_los_m")),
    "reference_phase": ("reference_phase_rad", f"deformation_phase_rad + orbit_phase_rad + coalesce(applied_topographic_phase_rad, 0) - 2 * {TURN} / wavelength_m * atmosphere_equivalent_los_m", 2e-5, ("reference_phase_rad", "deformation_phase_rad", "orbit_phase_rad", "atmosphere_equivalent_los_m")),
    "wrapped_phase": (f"pmod(wrapped_phase_rad - atan2(observation_imag, observation_real) + pi(), {TURN})", "pi()", 5e-7, ("wrapped_phase_rad", "observation_imag", "observation_real")),
    "mask": ("mask", "int(delta_down_m >= float(target_threshold_mm / 1000))", 0.0, ("mask", "delta_down_m")),
    "face_1_mask": ("face_1_mask", "int(face_1_delta_m >= float(target_threshold_mm / 1000))", 0.0, ("face_1_mask", "face_1_delta_m")),
    "face_2_mask": ("face_2_mask", "int(face_2_delta_m >= float(target_threshold_mm / 1000))", 0.0, ("face_2_mask", "face_2_delta_m")),
    "fringe_mask": ("fringe_mask", "int(abs(deformation_phase_rad) >= float(fringe_threshold_rad))", 0.0, ("fringe_mask", "deformation_phase_rad")),
    "fringe_valid_mask": ("fringe_valid_mask", "1", 0.0, ("fringe_valid_mask",)),
    "valid_mask": ("valid_mask", "int(water_mask = 0 AND model_coherence >= float(coalesce(valid_coherence_threshold, 0.2)))", 0.0, ("valid_mask", "water_mask", "model_coherence")),
    "model_coherence": ("model_coherence", "greatest(0, least(1, model_coherence))", 0.0, ("model_coherence",)),
    "estimated_coherence": ("estimated_coherence", "greatest(0, least(1, estimated_coherence))", 0.0, ("estimated_coherence",)),
}
#: Rules that are not about single pixels: how many bands (for finite: values) break them.
WHOLE = ("bands", "types", "shape", "finite", "request_sha256")


@F.pandas_udf(StringType())
def canonical_sha256(document: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text with sorted keys and no blanks; null for null or what is not JSON."""

    def one(text: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest() if text else None
        except ValueError:
            return None

    return document.map(one)


def checked(scenes: DataFrame, drawn: dict[str, tuple[int, Column]] | None = None) -> DataFrame:
    """What read_scenes(.., *BANDS) gives -> scene, rule, largest (violation; null where the rule has no bands), passed.

    Several rows of a scene (ranges of its lines) are one scene. Without settings, rules that need them fail. With drawn, images
    that were read with the bands are held against them as in images_checked(). Rows are read once and each scene's parts are added up where they were read."""
    drawn = drawn or {}
    known = F.from_json("metadata", METADATA)
    rows = scenes.withColumn("_m", known).withColumn("_request", F.get_json_object("metadata", "$.request"))
    rows = rows.select(*scenes.columns, F.col("_m.request.settings.*"), F.col("_m.request_sha256").alias("_told"), "_request")
    total = lambda parts: sum((p.cast("int") for p in parts[1:]), parts[0].cast("int")).cast("double")
    there = lambda b: F.map_contains_key("kinds", F.lit(b))
    part = lambda b, k: F.element_at(F.split(F.element_at("kinds", F.lit(b)), ":"), k)
    square = F.concat_ws("x", "size", "size")

    def differ(name: str, want: Column) -> Column:
        png = F.col(f"{name}_png")
        off = F.size(F.filter(F.arrays_zip(png.alias("a"), want.alias("b")), lambda p: ~p["a"].eqNullSafe(p["b"]))).cast("double")
        return F.when(want.isNotNull(), F.when(F.coalesce(F.size(png) == F.size(want), F.lit(False)), off).otherwise(float("inf")))

    facts = {
        "bands": total([~there(b) for b in NEEDED]),
        "types": total([there(b) & (part(b, 1) != ("uint8" if b in MASKS else "float32")) for b in BANDS]),
        "shape": total([there(b) & ~part(b, 2).eqNullSafe(square) for b in BANDS]),
        "request_sha256": F.when(F.col("_told").isNotNull(), (~canonical_sha256("_request").eqNullSafe(F.col("_told"))).cast("double")),
    }
    has = {n: total([there(b) for b in bands]) == len(bands) for n, (*_, bands) in RULES.items()}
    lines = F.coalesce(*(F.when(F.col(b).isNotNull(), F.size(b)) for b in BANDS), F.lit(0))
    blank = lambda b: F.array_repeat(F.lit(None).cast("tinyint" if b in MASKS else "float"), lines)
    zipped = F.arrays_zip(*(F.coalesce(F.col(b), blank(b)).alias(b) for b in BANDS))
    settings = [c.split()[0] for c in SETTINGS.split(", ")]
    told = F.struct(*(v.alias(n) for n, v in facts.items()), *(v.alias(f"has_{n}") for n, v in has.items()), *(differ(n, want).alias(f"{n}_png") for n, (_, want) in drawn.items()))
    pixels = rows.select("scene", *settings, told.alias("_f"), zipped.alias("_z"))
    pixels = pixels.select("scene", *settings, "_f", F.posexplode_outer("_z").alias("_pos", "_p"))
    pixels = pixels.select("scene", *settings, "_p.*", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_f")).alias("_f"))

    def off(one: str, other: str) -> Column:
        a, b = F.expr(one).cast("double"), F.expr(other).cast("double")
        beyond = F.abs(a - b) - RELATIVE * F.abs(b)
        return F.when(beyond.isNull(), float("inf")).otherwise(F.greatest(beyond, F.lit(0.0)))

    odd = F.size(F.filter(F.array(*FLOATS), lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    worst = [F.max(off(one, other)).alias(f"_{n}") for n, (one, other, *_) in RULES.items()] + [F.sum(odd).alias("_odd")]
    once = [F.max(f"_f.{n}").alias(f"_{n}") for n in facts] + [F.max(f"_f.has_{n}").alias(f"_has_{n}") for n in RULES] + [F.sum(f"_f.{n}_png").alias(f"_{n}_png") for n in drawn]
    whole = pixels.groupBy("scene").agg(*worst, *once)
    found = {n: F.when(F.col(f"_has_{n}"), F.col(f"_{n}")) for n in RULES}
    found |= {n: F.col("_odd").cast("double") if n == "finite" else F.col(f"_{n}") for n in WHOLE} | {f"{n}.png": F.col(f"_{n}_png") for n in drawn}
    tolerance = {n: t for n, (_, _, t, _) in RULES.items()} | dict.fromkeys([*WHOLE, *(f"{n}.png" for n in drawn)], 0.0)
    told = F.array(*(F.struct(F.lit(n).alias("rule"), v.alias("largest"), (v.isNull() | (v <= tolerance[n])).alias("passed")) for n, v in found.items()))
    return whole.select("scene", F.explode(told).alias("t")).select("scene", "t.*")


def phase_rgb(phase: Column) -> Column:
    """Red, green and blue of a phase: half a cosine each, a third of a turn apart."""
    return F.array(*(F.rint(255 * (0.5 + 0.5 * F.cos(phase.cast("double") - 2 * 3.141592653589793 * k / 3))).try_cast("int") for k in range(3)))


def images_checked(scenes: DataFrame, images: DataFrame, drawn: dict[str, tuple[int, Column]]) -> DataFrame:
    """Stored images against arrays: scenes(scene, first_row, height, width, bands), images as read_images() gives them, drawn:
    name of the image file without .png -> channels and the array column of the values that it must show, row-major, channels innermost.
    scene, rule (`name.png`), largest (values that differ; infinite for another size or no image), passed."""
    place = F.regexp_extract("path", r"([^/]+)/([^/]+)\.png$", 1)
    stored = images.select(place.alias("scene"), F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("name"), "data")
    told = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("channels"), c.alias("want")) for n, (k, c) in drawn.items()))
    wanted = scenes.select("scene", "first_row", "height", "width", F.explode(told).alias("t")).select("scene", "first_row", "height", "width", "t.*")
    met = wanted.join(stored, ["scene", "name"], "left")
    start, total = (F.col(c) * F.col("width") * F.col("channels") for c in ("first_row", "height"))
    shown = F.slice("data", (start + 1).cast("int"), F.size("want"))
    differ = F.size(F.filter(F.arrays_zip(shown.alias("a"), F.col("want").alias("b")), lambda p: ~p["a"].eqNullSafe(p["b"])))
    same = F.coalesce(F.size("data") == total, F.lit(False))
    rows = met.select("scene", F.concat("name", F.lit(".png")).alias("rule"), F.when(same, differ.cast("double")).otherwise(float("inf")).alias("off"))
    out = rows.groupBy("scene", "rule").agg(F.sum("off").alias("largest"))
    return out.withColumn("passed", F.col("largest") == 0)
