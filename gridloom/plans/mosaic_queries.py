"""Whole-scene queries: the embeddings' 8 x 8 tiles, ten to a row, are one raster, as long as there are tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import mosaic as M
from gridloom.operators.rectangles import rectangle_join
from gridloom.plans.catalog import query
from gridloom.plans.raster_queries import N, _tiles

ACROSS = 10
#: Pixels of the raster, in DuckDB; those of the last row of tiles may be absent.
PIX = """pix AS (SELECT CAST(vec_id // 10 * 8 + (i - 1) // 8 AS INTEGER) AS y, CAST(vec_id % 10 * 8 + (i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v
    FROM embeddings, generate_series(1, 64) AS g(i)),
size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM pix)"""


def _mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mosaic(_tiles(spark, sf_dir), F.col("vec_id"), ACROSS, N)


def _marked(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    return _mosaic(spark, sf_dir).withColumn("mask", F.transform("data", lambda v: (v >= least).cast("double")))


@query("mosaic_box_mean", f"""WITH {PIX}, o AS (SELECT a.d AS dy, b.d AS dx FROM generate_series(-6, 6) AS a(d), generate_series(-6, 6) AS b(d)),
near AS (SELECT y, x, abs(y + dy) AS a, abs(x + dx) AS b, h, w FROM pix, o, size),
folded AS (SELECT y, x, CASE WHEN a >= h THEN 2 * (h - 1) - a ELSE a END AS qy, CASE WHEN b >= w THEN 2 * (w - 1) - b ELSE b END AS qx FROM near)
SELECT f.y, f.x, round(avg(q.v), 6) + 0.0 AS mean FROM folded f JOIN pix q ON q.y = f.qy AND q.x = f.qx GROUP BY f.y, f.x""")
def mosaic_box_mean(spark, sf_dir):
    """A 13 x 13 mean, wider than a tile, over the whole raster; borders of the raster are reflected."""
    return M.pixels(M.box_mean(_mosaic(spark, sf_dir), 13, N), "mean").select("y", "x", (F.round("mean", 6) + 0.0).alias("mean"))


@query("mosaic_gradient", f"""WITH {PIX} SELECT y, x,
 round((coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / (2.5 * (CASE WHEN lead(v) OVER r IS NULL THEN 0 ELSE 1 END + CASE WHEN lag(v) OVER r IS NULL THEN 0 ELSE 1 END)), 6) AS east,
 round((coalesce(lag(v) OVER c, v) - coalesce(lead(v) OVER c, v)) / (2.5 * (CASE WHEN lead(v) OVER c IS NULL THEN 0 ELSE 1 END + CASE WHEN lag(v) OVER c IS NULL THEN 0 ELSE 1 END)), 6) AS north
 FROM pix WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)""")
def mosaic_gradient(spark, sf_dir):
    out = M.pixels(M.gradient(_mosaic(spark, sf_dir), 2.5, N), "east", "north")
    return out.select("y", "x", F.round("east", 6).alias("east"), F.round("north", 6).alias("north"))


@query("mosaic_boundary", f"""WITH {PIX}, m AS (SELECT y, x, CASE WHEN v >= 0.05 THEN 1 ELSE 0 END AS mask FROM pix),
b AS (SELECT *, CASE WHEN mask = 1 AND coalesce(lag(mask) OVER r, 0) + coalesce(lead(mask) OVER r, 0) + coalesce(lag(mask) OVER c, 0) + coalesce(lead(mask) OVER c, 0) < 4 THEN 1 ELSE 0 END AS edge FROM m WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))
SELECT y, x, mask, edge, greatest(edge, coalesce(lag(edge) OVER r, 0), coalesce(lead(edge) OVER r, 0), coalesce(lag(edge) OVER c, 0), coalesce(lead(edge) OVER c, 0)) AS halo
FROM b WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)""")
def mosaic_boundary(spark, sf_dir):
    masks = _marked(spark, sf_dir, 0.05).drop("data").withColumnRenamed("mask", "data")
    return M.pixels(M.boundary(masks, N), "mask", "edge", "halo").select("y", "x", *(F.col(c).cast("int").alias(c) for c in ("mask", "edge", "halo")))


@query("mosaic_max_step", f"""WITH {PIX}, s AS (SELECT abs(v - lag(v) OVER (PARTITION BY y ORDER BY x)) AS e, abs(v - lag(v) OVER (PARTITION BY x ORDER BY y)) AS s FROM pix)
SELECT CAST(0 AS BIGINT) AS scene, round(greatest(max(e), max(s)), 6) AS max_step FROM s""")
def mosaic_max_step(spark, sf_dir):
    return M.max_step(_mosaic(spark, sf_dir), N).select("scene", F.round("max_step", 6).alias("max_step"))


REGIONS = f"""WITH RECURSIVE {PIX}, m AS (SELECT y, x, v, y * (SELECT w FROM size) + x AS p FROM pix WHERE v >= 0.2),
o AS (SELECT a.d AS dy, b.d AS dx FROM generate_series(-1, 1) AS a(d), generate_series(-1, 1) AS b(d)),
near AS (SELECT m.p, n.p AS q FROM m, o JOIN m n ON n.y = m.y + dy AND n.x = m.x + dx),
walk(p, q) AS (SELECT p, q FROM near UNION SELECT w.p, n.q FROM walk w JOIN near n ON n.p = w.q),
lab AS (SELECT p, min(q) AS label FROM walk GROUP BY p)"""


@query("mosaic_regions", REGIONS + """ SELECT CAST(label AS BIGINT) AS label, count(*) AS area_px, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, round(max(v), 6) AS peak, round(sqrt(count(*)), 6) AS equivalent_width
 FROM lab JOIN m USING (p) GROUP BY label""")
def mosaic_regions(spark, sf_dir):
    """Regions of the whole raster, also across tiles, with their peaks."""
    found = M.regions(M.labelled(_marked(spark, sf_dir, 0.2)))
    return found.select("label", "area_px", "x0", "y0", "x1", "y1", F.round("peak", 6).alias("peak"), F.round("equivalent_width", 6).alias("equivalent_width"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate windows: seven pixels around each tile's first maximum, cut at the raster's borders."""
    place = F.array_position("data", F.array_max("data")) - 1
    y, x = F.col("y0") + F.floor(place / N), F.col("x0") + place % N
    rows = _mosaic(spark, sf_dir).withColumn("y", y.cast("int")).withColumn("x", x.cast("int"))
    low, high = lambda c: F.greatest(F.col(c) - 3, F.lit(0)), lambda c, n: F.least(F.col(c) + 4, F.col(n))
    return rows.select("scene", "vec_id", low("x").alias("x0"), low("y").alias("y0"), high("x", "width").alias("x1"), high("y", "height").alias("y1"))


WINDOWS = """top AS (SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS p FROM embeddings),
win AS (SELECT vec_id, greatest(vec_id % 10 * 8 + p % 8 - 3, 0) AS x0, greatest(vec_id // 10 * 8 + p // 8 - 3, 0) AS y0, least(vec_id % 10 * 8 + p % 8 + 4, w) AS x1, least(vec_id // 10 * 8 + p // 8 + 4, h) AS y1 FROM top, size)"""


@query("window_truth", f"""WITH {PIX}, {WINDOWS}, hit AS (SELECT win.vec_id, count(*) AS n FROM win JOIN pix ON pix.y >= win.y0 AND pix.y < win.y1 AND pix.x >= win.x0 AND pix.x < win.x1 WHERE pix.v >= 0.2 GROUP BY win.vec_id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS truth_px, coalesce(n, 0) > 0 AS touched FROM win LEFT JOIN hit USING (vec_id)""")
def window_truth(spark, sf_dir):
    """Truth pixels in each candidate window, by a rectangle join with the runs of the regions."""
    runs = M.labelled(_marked(spark, sf_dir, 0.2)).select("scene", "label", F.explode("runs").alias("r"))
    boxes = runs.select("scene", "label", F.col("r.lo").alias("x0"), F.col("r.y").alias("y0"), F.col("r.hi").alias("x1"), (F.col("r.y") + 1).alias("y1"))
    windows = _windows(spark, sf_dir)
    met = rectangle_join(windows, boxes, 16)
    hits = met.groupBy(F.col("l_vec_id").alias("vec_id")).agg(F.sum(F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0")).alias("n"))
    out = windows.select("vec_id").join(hits, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("truth_px"), (F.coalesce("n", F.lit(0)) > 0).alias("touched"))


@query("window_regions", REGIONS + f""", {WINDOWS}, box AS (SELECT label, min(x) AS bx0, min(y) AS by0, max(x) + 1 AS bx1, max(y) + 1 AS by1 FROM lab JOIN m USING (p) GROUP BY label)
SELECT vec_id, CAST(label AS BIGINT) AS label, CAST((least(x1, bx1) - greatest(x0, bx0)) * (least(y1, by1) - greatest(y0, by0)) AS BIGINT) AS overlap_px FROM win JOIN box ON x0 < bx1 AND bx0 < x1 AND y0 < by1 AND by0 < y1""")
def window_regions(spark, sf_dir):
    """Candidate windows and the boxes of the regions that they overlap."""
    boxes = M.regions(M.labelled(_marked(spark, sf_dir, 0.2))).select("scene", "label", "x0", "y0", "x1", "y1")
    met = rectangle_join(_windows(spark, sf_dir), boxes, 16)
    side = lambda a, b: F.least(f"l_{b}", f"r_{b}") - F.greatest(f"l_{a}", f"r_{a}")
    return met.select(F.col("l_vec_id").alias("vec_id"), F.col("r_label").alias("label"), (side("x0", "x1") * side("y0", "y1")).cast("long").alias("overlap_px"))
