"""Raster queries: the 64 values of each embedding are an 8 x 8 tile, row 0 in the north."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import raster as R
from gridloom.operators.regions import labelled_tiles, regions
from gridloom.plans.catalog import query
from gridloom.session import staged
from gridloom.sources.tables import table

N = 8
PIX = """pix AS (SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v
    FROM embeddings, generate_series(1, 64) AS g(i))"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tiles(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).withColumn("data", F.transform("data", lambda v: (v >= 0.05).cast("int")))


def _long(df: DataFrame, *arrays: str) -> DataFrame:
    """vec_id, y, x and one column for each array of a tile."""
    rows = df.select("vec_id", F.posexplode(F.arrays_zip(*arrays)).alias("pos", "p"))
    return rows.select("vec_id", F.floor(F.col("pos") / N).cast("int").alias("y"), (F.col("pos") % N).cast("int").alias("x"), *(F.col(f"p.{a}").alias(a) for a in arrays))


@query("raster_block_mean", f"WITH {PIX} SELECT vec_id, y // 2 AS by, x // 2 AS bx, round(avg(v), 6) AS mean FROM pix GROUP BY ALL")
def raster_block_mean(spark, sf_dir):
    out = R.block_mean(R.pixels(_tiles(spark, sf_dir), N, "vec_id"), 2, "vec_id")
    return out.withColumn("mean", F.round("mean", 6))


@query("raster_threshold_area", f"""WITH {PIX}, b AS (SELECT vec_id, y // 2 AS by, x // 2 AS bx, avg(v) AS mean FROM pix GROUP BY ALL)
SELECT vec_id, count(*) FILTER (CAST(mean AS FLOAT) >= CAST(0.02 AS FLOAT)) AS area, round(max(mean), 6) AS peak, round(100.0 * avg(CASE WHEN CAST(mean AS FLOAT) >= CAST(0.02 AS FLOAT) THEN 1 ELSE 0 END), 6) AS percent FROM b GROUP BY vec_id""")
def raster_threshold_area(spark, sf_dir):
    """Thresholds compare as the 32-bit values that bands are stored in."""
    t = _tiles(spark, sf_dir).select("vec_id", R.block_means(F.col("data"), 2, N, N).alias("means"))
    area = F.size(F.filter("means", lambda m: m.cast("float") >= F.lit(0.02).cast("float")))
    return t.select("vec_id", area.cast("long").alias("area"), F.round(F.array_max("means"), 6).alias("peak"), F.round(100.0 * area / F.size("means"), 6).alias("percent"))


@query("raster_gradient", f"""WITH {PIX} SELECT vec_id, y, x,
 round((coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / ((CASE WHEN x IN (0, 7) THEN 1 ELSE 2 END) * 2.5), 6) AS d_east,
 round((coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / ((CASE WHEN y IN (0, 7) THEN 1 ELSE 2 END) * -2.5), 6) AS d_north
 FROM pix WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)""")
def raster_gradient(spark, sf_dir):
    t = _tiles(spark, sf_dir).select("vec_id", R.gradient(F.col("data"), "x", 2.5, N, N).alias("d_east"), R.gradient(F.col("data"), "y", -2.5, N, N).alias("d_north"))
    return _long(t, "d_east", "d_north").select("vec_id", "y", "x", F.round("d_east", 6).alias("d_east"), F.round("d_north", 6).alias("d_north"))


@query("raster_max_step", f"""WITH {PIX}, s AS (SELECT vec_id, abs(v - lag(v) OVER (PARTITION BY vec_id, y ORDER BY x)) AS e, abs(v - lag(v) OVER (PARTITION BY vec_id, x ORDER BY y)) AS s FROM pix)
SELECT vec_id, round(greatest(max(e), max(s)), 6) AS max_step, greatest(max(e), max(s)) > 0.5 AS aliased FROM s GROUP BY vec_id""")
def raster_max_step(spark, sf_dir):
    """Largest difference of neighbours, the aliasing check."""
    d = F.col("data")
    step = lambda dy, dx: R.each_pixel(lambda y, x: F.abs(F.get(d, y * N + x) - R.pixel(d, y + dy, x + dx, N, N)), N, N)
    top = F.greatest(F.array_max(step(1, 0)), F.array_max(step(0, 1)))
    return _tiles(spark, sf_dir).select("vec_id", F.round(top, 6).alias("max_step"), (top > 0.5).alias("aliased"))


@query("raster_box_mean", f"""WITH {PIX}, o AS (SELECT a.d AS dy, b.d AS dx FROM generate_series(-1, 1) AS a(d), generate_series(-1, 1) AS b(d))
SELECT p.vec_id, p.y, p.x, round(avg(q.v), 6) AS mean FROM pix p, o, pix q
WHERE q.vec_id = p.vec_id AND q.y = (CASE WHEN p.y + dy < 0 THEN -(p.y + dy) WHEN p.y + dy > 7 THEN 14 - (p.y + dy) ELSE p.y + dy END)
 AND q.x = (CASE WHEN p.x + dx < 0 THEN -(p.x + dx) WHEN p.x + dx > 7 THEN 14 - (p.x + dx) ELSE p.x + dx END) GROUP BY ALL""")
def raster_box_mean(spark, sf_dir):
    t = _tiles(spark, sf_dir).select("vec_id", R.box_mean(F.col("data"), 3, N, N).alias("mean"))
    return _long(t, "mean").withColumn("mean", F.round("mean", 6))


@query("raster_boundary", f"""WITH {PIX}, m AS (SELECT vec_id, y, x, CASE WHEN v >= 0.05 THEN 1 ELSE 0 END AS m FROM pix),
n AS (SELECT *, coalesce(lag(m) OVER r, 0) AS w, coalesce(lead(m) OVER r, 0) AS e, coalesce(lag(m) OVER c, 0) AS nn, coalesce(lead(m) OVER c, 0) AS s FROM m WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)),
b AS (SELECT vec_id, y, x, m, CASE WHEN m = 1 AND w + e + nn + s < 4 THEN 1 ELSE 0 END AS edge FROM n)
SELECT vec_id, y, x, m AS mask, edge, greatest(edge, coalesce(lag(edge) OVER r, 0), coalesce(lead(edge) OVER r, 0), coalesce(lag(edge) OVER c, 0), coalesce(lead(edge) OVER c, 0)) AS halo
FROM b WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)""")
def raster_boundary(spark, sf_dir):
    t = _mask(spark, sf_dir).select("vec_id", F.col("data").alias("mask"))
    t = t.withColumn("edge", R.boundary(F.col("mask"), N, N)).withColumn("halo", R.dilation(F.col("edge"), N, N))
    return _long(t, "mask", "edge", "halo")


@query("raster_runs", f"""WITH {PIX}, m AS (SELECT vec_id, y, x, x - row_number() OVER (PARTITION BY vec_id, y ORDER BY x) AS island FROM pix WHERE v >= 0.05)
SELECT vec_id, y, min(x) AS lo, max(x) + 1 AS hi FROM m GROUP BY vec_id, y, island""")
def raster_runs(spark, sf_dir):
    return R.runs(R.pixels(_mask(spark, sf_dir), N, "vec_id"), "vec_id")


REGIONS = f"""WITH RECURSIVE {PIX}, m AS (SELECT vec_id, y, x, y * 8 + x AS p FROM pix WHERE v >= 0.05),
near AS (SELECT a.vec_id, a.p, b.p AS q FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
walk(vec_id, p, q) AS (SELECT vec_id, p, q FROM near UNION SELECT w.vec_id, w.p, n.q FROM walk w JOIN near n ON n.vec_id = w.vec_id AND n.p = w.q),
lab AS (SELECT vec_id, p, min(q) AS label FROM walk GROUP BY ALL)"""


@query("raster_regions", REGIONS + """ SELECT l.vec_id, 'region_' || lpad(CAST(row_number() OVER (PARTITION BY l.vec_id ORDER BY count(*) DESC, min(m.x), min(m.y), max(m.x), max(m.y), label) - 1 AS VARCHAR), 5, '0') AS region_id,
 count(*) AS area_px, min(m.x) AS x0, min(m.y) AS y0, max(m.x) + 1 AS x1, max(m.y) + 1 AS y1, round(sqrt(count(*)), 6) AS equivalent_width
 FROM lab l JOIN m USING (vec_id, p) GROUP BY l.vec_id, label""")
def raster_regions(spark, sf_dir):
    found = regions(labelled_tiles(_mask(spark, sf_dir), "vec_id", N), "vec_id")
    return found.drop("runs").withColumn("equivalent_width", F.round("equivalent_width", 6))


@query("region_peaks", REGIONS + """ SELECT l.vec_id, CAST(label AS BIGINT) AS label, count(*) AS area_px, round(max(x.v), 6) AS peak, greatest(min(x.x) - 1, 0) AS left_pad, least(max(x.x) + 2, 8) AS right_pad, count(*) < 4 AS small
 FROM lab l JOIN pix x ON x.vec_id = l.vec_id AND x.y * 8 + x.x = l.p GROUP BY l.vec_id, label""")
def region_peaks(spark, sf_dir):
    """Candidate windows: peak score and padded bounds of each region. Runs are found and scored inside their tile's row."""
    both = labelled_tiles(_mask(spark, sf_dir), "vec_id", N).groupBy("vec_id").agg(F.collect_list(F.struct("label", "y", "lo", "hi")).alias("runs")).join(_tiles(spark, sf_dir), "vec_id")
    scored = both.select("vec_id", F.explode(F.transform("runs", lambda r: F.struct(r["label"].alias("label"), r["lo"].alias("lo"), r["hi"].alias("hi"), F.array_max(F.slice("data", r["y"] * N + r["lo"] + 1, r["hi"] - r["lo"])).alias("v")))).alias("r")).select("vec_id", "r.*")
    area = F.sum((F.col("hi") - F.col("lo")).cast("long"))
    return scored.groupBy("vec_id", "label").agg(area.alias("area_px"), F.round(F.max("v"), 6).alias("peak"), F.greatest(F.min("lo") - 1, F.lit(0)).alias("left_pad"), F.least(F.max("hi") + 1, F.lit(N)).alias("right_pad"), (area < 4).alias("small"))


@query("raster_argmax", f"WITH {PIX}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, y, x) AS n FROM pix) SELECT vec_id, y, x, round(v, 6) AS peak FROM r WHERE n = 1")
def raster_argmax(spark, sf_dir):
    """First maximum in row-major order."""
    top = F.array_max("data")
    place = (F.array_position("data", top) - 1).cast("int")
    return _tiles(spark, sf_dir).select("vec_id", F.floor(place / N).cast("int").alias("y"), (place % N).alias("x"), F.round(top, 6).alias("peak"))


@query("peak_profile", """WITH t AS (SELECT vec_id, embedding, (list_position(embedding, list_max(embedding)) - 1) // 8 AS y FROM embeddings), c AS (SELECT vec_id, embedding[y * 8 + 1 : y * 8 + 8] AS line FROM t)
SELECT vec_id, CAST(k - 1 AS INTEGER) AS x, round(CAST(line[k] AS DOUBLE), 6) AS v FROM c, generate_series(1, 8) AS g(k)""")
def peak_profile(spark, sf_dir):
    """The row of pixels through the peak."""
    row = F.floor((F.array_position("data", F.array_max("data")) - 1) / N).cast("int")
    part = _tiles(spark, sf_dir).select("vec_id", F.posexplode(F.slice("data", row * N + 1, N)).alias("x", "v"))
    return part.withColumn("v", F.round("v", 6))


@query("raster_quantiles", f"WITH {PIX} SELECT vec_id, " + ", ".join(f"round(quantile_cont(v, {q / 100}), 6) AS q{q}" for q in (0, 10, 25, 50, 75, 90, 100)) + " FROM pix GROUP BY vec_id")
def raster_quantiles(spark, sf_dir):
    p = R.pixels(_tiles(spark, sf_dir), N, "vec_id").groupBy("vec_id")
    return p.agg(*(F.round(F.percentile("v", q / 100), 6).alias(f"q{q}") for q in (0, 10, 25, 50, 75, 90, 100)))


@query("rank_brightness", f"""WITH {PIX}, r AS (SELECT vec_id, y, x, (row_number() OVER (PARTITION BY vec_id ORDER BY v, y, x) - 0.5) / 64 AS q FROM pix)
SELECT vec_id, y, x, round(q, 6) AS q, CAST(least(15, floor(sqrt(q) * 16)) AS INTEGER) AS level FROM r""")
def rank_brightness(spark, sf_dir):
    """Stable ranks as quantiles, looked up in a cumulative distribution (here weights 1, 3, 5, ...)."""
    order = Window.partitionBy("vec_id").orderBy("v", "y", "x")
    p = R.pixels(_tiles(spark, sf_dir), N, "vec_id").withColumn("q", (F.row_number().over(order) - 0.5) / (N * N))
    cdf = F.array(*(F.lit(((k + 1) / 16) ** 2) for k in range(16)))
    level = F.least(F.size(F.filter(cdf, lambda c: c <= F.col("q"))), F.lit(15))
    return p.select("vec_id", "y", "x", F.round("q", 6).alias("q"), level.alias("level"))


@query("brightness_histogram", f"""WITH {PIX}, b AS (SELECT vec_id, CAST(least(15, greatest(0, floor((v + 0.5) * 16))) AS INTEGER) AS bin FROM pix), c AS (SELECT bin, count(*) AS n FROM b WHERE bin > 0 GROUP BY bin)
SELECT bin, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c""")
def brightness_histogram(spark, sf_dir):
    """Histogram without its zero bin, normalised."""
    p = R.pixels(_tiles(spark, sf_dir), N, "vec_id")
    bins = p.select(F.least(F.lit(15), F.greatest(F.lit(0), F.floor((F.col("v") + 0.5) * 16))).cast("int").alias("bin")).where("bin > 0").groupBy("bin").agg(F.count("*").alias("n"))
    return bins.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("tile_fusion", f"""WITH {PIX}, s AS (SELECT unnest([0, 3, 4]) AS t), w AS (SELECT p.vec_id, p.y, p.x, a.t AS ty, b.t AS tx, p.v * (1 + 0.01 * a.t + 0.02 * b.t) AS pv,
 greatest(0.5 - 0.5 * cos(2 * pi() * (p.y - a.t) / 3), 0.05) * greatest(0.5 - 0.5 * cos(2 * pi() * (p.x - b.t) / 3), 0.05) AS wt
 FROM pix p JOIN s a ON p.y >= a.t AND p.y < a.t + 4 JOIN s b ON p.x >= b.t AND p.x < b.t + 4)
SELECT vec_id, y, x, count(*) AS views, round(sum(wt * pv) / sum(wt), 6) AS fused, round(avg(pv), 6) AS plain FROM w GROUP BY ALL""")
def tile_fusion(spark, sf_dir):
    """Overlapping windows (last one moved back to fit), their scores fused by Hann weights."""
    starts = R.tile_starts(N, 4, 3)
    views = _tiles(spark, sf_dir).select("vec_id", "data", F.explode(starts).alias("ty")).select("*", F.explode(starts).alias("tx"))
    views = views.select("vec_id", "data", "ty", "tx", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    y, x = F.col("ty") + F.floor(F.col("k") / 4).cast("int"), F.col("tx") + F.col("k") % 4
    rows = views.select("vec_id", y.alias("y"), x.alias("x"), (F.get("data", y * N + x) * (1 + 0.01 * F.col("ty") + 0.02 * F.col("tx"))).alias("pv"), (R.taper(y - F.col("ty"), 4) * R.taper(x - F.col("tx"), 4)).alias("wt"))
    return rows.groupBy("vec_id", "y", "x").agg(F.count("*").alias("views"), F.round(F.sum(F.col("wt") * F.col("pv")) / F.sum("wt"), 6).alias("fused"), F.round(F.avg("pv"), 6).alias("plain"))


@query("raster_standardised", f"""WITH {PIX}, s AS (SELECT vec_id, avg(v) AS m, greatest(stddev_pop(v), 1e-12) AS d, min(v) AS lo, max(v) AS hi, max(abs(v)) AS peak FROM pix GROUP BY vec_id)
SELECT vec_id, y, x, round((v - m) / d, 6) AS z, round((v - lo) / greatest(hi - lo, 1e-12), 6) AS unit, round(CASE WHEN peak <= 1e-6 THEN 0 ELSE abs(v) / peak END, 6) AS target FROM pix JOIN s USING (vec_id)""")
def raster_standardised(spark, sf_dir):
    """Standard score (population deviation), min-max scale and detection target of each tile."""
    total = lambda f: F.aggregate("data", F.lit(0.0), f)
    t = _tiles(spark, sf_dir).withColumn("m", total(lambda a, v: a + v) / (N * N)).withColumn("lo", F.array_min("data")).withColumn("hi", F.array_max("data"))
    t = t.withColumn("d", F.greatest(F.sqrt(F.aggregate("data", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / (N * N)), F.lit(1e-12))).withColumn("peak", F.greatest(F.abs("lo"), F.abs("hi")))
    one = lambda f: F.transform("data", lambda v: F.round(f(v), 6))
    t = t.select("vec_id", one(lambda v: (v - F.col("m")) / F.col("d")).alias("z"), one(lambda v: (v - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))).alias("unit"), one(lambda v: F.when(F.col("peak") <= 1e-6, 0.0).otherwise(F.abs(v) / F.col("peak"))).alias("target"))
    return _long(t, "z", "unit", "target")


@query("raster_rotated", """SELECT vec_id, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, round(CAST(embedding[p % 8 * 8 + 7 - p // 8 + 1] AS DOUBLE), 6) AS turned, round(CAST(embedding[(7 - p % 8) * 8 + 7 - p // 8 + 1] AS DOUBLE), 6) AS turned_flipped FROM embeddings, generate_series(0, 63) AS g(p)""")
def raster_rotated(spark, sf_dir):
    t = _tiles(spark, sf_dir).select("vec_id", R.rotated(F.col("data"), 1, False, N, N).alias("turned"), R.rotated(F.col("data"), 1, True, N, N).alias("turned_flipped"))
    return _long(t, "turned", "turned_flipped").select("vec_id", "y", "x", F.round("turned", 6).alias("turned"), F.round("turned_flipped", 6).alias("turned_flipped"))


@query("raster_resized", f"""WITH {PIX} SELECT a.vec_id, a.y // 2 AS y, a.x // 2 AS x, round(max(CASE WHEN a.y % 2 = 1 AND a.x % 2 = 1 THEN a.v END), 6) AS nearest, round(avg(a.v), 6) AS box,
 round(max(CASE WHEN a.y % 2 = 0 AND a.x % 2 = 0 THEN a.v END) * 0.75 + max(CASE WHEN a.y % 2 = 0 AND a.x % 2 = 1 THEN a.v END) * 0.25, 6) AS linear FROM pix a GROUP BY a.vec_id, a.y // 2, a.x // 2""")
def raster_resized(spark, sf_dir):
    """Half-size tiles by nearest pixel, box mean and linear interpolation along the row."""
    d, h = F.col("data"), N // 2
    at = lambda y, x: F.get(d, y * N + x)
    nearest = R.each_pixel(lambda y, x: at(2 * y + 1, 2 * x + 1), h, h)
    box = R.each_pixel(lambda y, x: (at(2 * y, 2 * x) + at(2 * y, 2 * x + 1) + at(2 * y + 1, 2 * x) + at(2 * y + 1, 2 * x + 1)) / 4, h, h)
    linear = R.each_pixel(lambda y, x: at(2 * y, 2 * x) * 0.75 + at(2 * y, 2 * x + 1) * 0.25, h, h)
    t = _tiles(spark, sf_dir).select("vec_id", nearest.alias("nearest"), box.alias("box"), linear.alias("linear"))
    rows = t.select("vec_id", F.posexplode(F.arrays_zip("nearest", "box", "linear")).alias("pos", "p"))
    return rows.select("vec_id", F.floor(F.col("pos") / h).cast("int").alias("y"), (F.col("pos") % h).cast("int").alias("x"), *(F.round(f"p.{c}", 6).alias(c) for c in ("nearest", "box", "linear")))


@query("mask_union_conflicts", f"""WITH {PIX}, t AS (SELECT vec_id, y, x, 0 AS file, CASE WHEN v >= 0.05 THEN 1 ELSE 0 END AS m FROM pix WHERE x < 5 UNION ALL SELECT vec_id, y, x, 1, CASE WHEN v >= 0.06 THEN 1 ELSE 0 END FROM pix WHERE x >= 3)
SELECT vec_id, count(*) AS covered, CAST(sum(u) AS BIGINT) AS union_px, CAST(sum(c) AS BIGINT) AS conflicts, CAST(sum(CASE WHEN c = 0 THEN u ELSE 0 END) AS BIGINT) AS agreed_px FROM (SELECT vec_id, y, x, max(m) AS u, CASE WHEN min(m) <> max(m) THEN 1 ELSE 0 END AS c FROM t GROUP BY ALL) GROUP BY vec_id""")
def mask_union_conflicts(spark, sf_dir):
    """Two overlapping annotation tiles placed by their offsets: union, coverage, disagreement."""
    p = R.pixels(_tiles(spark, sf_dir), N, "vec_id")
    views = p.where("x < 5").withColumn("m", (F.col("v") >= 0.05).cast("int")).unionByName(p.where("x >= 3").withColumn("m", (F.col("v") >= 0.06).cast("int")))
    merged = views.groupBy("vec_id", "y", "x").agg(F.max("m").alias("u"), (F.min("m") != F.max("m")).cast("int").alias("c"))
    return merged.groupBy("vec_id").agg(F.count("*").alias("covered"), F.sum("u").alias("union_px"), F.sum("c").alias("conflicts"), F.sum(F.when(F.col("c") == 0, F.col("u")).otherwise(0)).alias("agreed_px"))


@query("context_patches", """WITH l AS (SELECT vec_id, label FROM embeddings), s AS (SELECT unnest([1, 2]) AS scale), t AS (SELECT scale, CAST(unnest(CASE WHEN scale = 1 THEN [0, 3, 4] ELSE [0] END) AS INTEGER) AS start FROM s)
SELECT vec_id, label, a.scale, a.start AS top, b.start AS left_px, a.start + 4 * a.scale AS bottom, b.start + 4 * a.scale AS right_px FROM l, t a JOIN t b USING (scale)""")
def context_patches(spark, sf_dir):
    """Patches at several context scales; each inherits its scene's label."""
    scenes = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.array(F.lit(1), F.lit(2))).alias("scale"))
    starts = F.when(F.col("scale") == 1, R.tile_starts(N, 4, 3)).otherwise(R.tile_starts(N, 8, 6))
    rows = scenes.withColumn("top", F.explode(starts)).withColumn("left_px", F.explode(starts))
    return rows.select("vec_id", "label", "scale", "top", "left_px", (F.col("top") + 4 * F.col("scale")).alias("bottom"), (F.col("left_px") + 4 * F.col("scale")).alias("right_px"))


@query("positive_blocks", f"""WITH {PIX} SELECT vec_id, y // 4 AS by, x // 4 AS bx, CAST(sum(CASE WHEN v >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS positive_px, CASE WHEN sum(CASE WHEN v >= 0.05 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END AS positive FROM pix WHERE x < 7 GROUP BY vec_id, y // 4, x // 4 HAVING count(*) = 16""")
def positive_blocks(spark, sf_dir):
    """Positive area of complete blocks (here of tiles cut to 7 columns, so some are incomplete)."""
    p = R.pixels(_mask(spark, sf_dir), N, "vec_id").where("x < 7").groupBy("vec_id", F.floor(F.col("y") / 4).cast("int").alias("by"), F.floor(F.col("x") / 4).cast("int").alias("bx"))
    return p.agg(F.sum("v").alias("positive_px"), F.max("v").alias("positive"), F.count("*").alias("n")).where("n = 16").drop("n")


@query("crop_equality", f"""WITH {PIX}, a AS (SELECT vec_id, y - 2 AS y, x - 1 AS x, CAST(floor(v * 128 + 0.5) AS INTEGER) AS level FROM pix WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 4)
SELECT a.vec_id, count(*) AS compared, CAST(sum(CASE WHEN abs(a.level / 128.0::DOUBLE - b.v) > 0.003 THEN 1 ELSE 0 END) AS BIGINT) AS different FROM a JOIN pix b ON b.vec_id = a.vec_id AND b.y = a.y + 2 AND b.x = a.x + 1 GROUP BY a.vec_id""")
def crop_equality(spark, sf_dir):
    """Crops stored as 8-bit levels with their offsets, against the tiles that they were cut from: pixels further off than 0.003."""
    p = R.pixels(_tiles(spark, sf_dir), N, "vec_id")
    cut = p.where("y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 4").select("vec_id", (F.col("y") - 2).alias("y"), (F.col("x") - 1).alias("x"), F.floor(F.col("v") * 128 + 0.5).cast("int").alias("level"))
    return R.crop_differences(staged(cut, "crops"), p, 2, 1, 0.003, "vec_id")


@query("raster_cumsum", f"""WITH {PIX}, r AS (SELECT vec_id, y, x, sum(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS s FROM pix) SELECT vec_id, y, x, round(sum(s) OVER (PARTITION BY vec_id, x ORDER BY y), 6) AS total FROM r""")
def raster_cumsum(spark, sf_dir):
    """Cumulative sums along both axes."""
    return R.cumulative(R.pixels(_tiles(spark, sf_dir), N, "vec_id"), "vec_id").withColumn("v", F.round("v", 6)).withColumnRenamed("v", "total")


@query("raster_wide_mean", f"""WITH {PIX}, o AS (SELECT a.d AS dy, b.d AS dx FROM generate_series(-3, 3) AS a(d), generate_series(-3, 3) AS b(d))
SELECT p.vec_id, p.y, p.x, round(avg(q.v), 6) AS mean FROM pix p, o, pix q
WHERE q.vec_id = p.vec_id AND q.y = (CASE WHEN p.y + dy < 0 THEN -(p.y + dy) WHEN p.y + dy > 7 THEN 14 - (p.y + dy) ELSE p.y + dy END)
 AND q.x = (CASE WHEN p.x + dx < 0 THEN -(p.x + dx) WHEN p.x + dx > 7 THEN 14 - (p.x + dx) ELSE p.x + dx END) GROUP BY ALL""")
def raster_wide_mean(spark, sf_dir):
    """A 7 x 7 mean by cumulative sums: four look-ups a pixel, whatever the width."""
    return R.wide_mean(_tiles(spark, sf_dir), 7, N, N, "vec_id").withColumn("v", F.round("v", 6)).withColumnRenamed("v", "mean")


@query("raster_padded", f"""WITH {PIX}, o AS (SELECT CAST(a.d AS INTEGER) AS y, CAST(b.d AS INTEGER) AS x FROM generate_series(0, 11) AS a(d), generate_series(0, 11) AS b(d)), k AS (SELECT DISTINCT vec_id FROM pix)
SELECT k.vec_id, o.y, o.x, round(r.v, 6) AS reflected, round(e.v, 6) AS edge, round(coalesce(c.v, 0), 6) AS constant FROM k, o
JOIN pix r ON r.y = (CASE WHEN o.y < 2 THEN 2 - o.y WHEN o.y > 9 THEN 16 - o.y ELSE o.y - 2 END) AND r.x = (CASE WHEN o.x < 2 THEN 2 - o.x WHEN o.x > 9 THEN 16 - o.x ELSE o.x - 2 END)
JOIN pix e ON e.vec_id = r.vec_id AND e.y = least(7, greatest(0, o.y - 2)) AND e.x = least(7, greatest(0, o.x - 2)) LEFT JOIN pix c ON c.vec_id = r.vec_id AND c.y = o.y - 2 AND c.x = o.x - 2 WHERE r.vec_id = k.vec_id""")
def raster_padded(spark, sf_dir):
    """Tiles with a border of two pixels in the three modes."""
    t = _tiles(spark, sf_dir).select("vec_id", *(R.padded(F.col("data"), 2, mode, N, N).alias(mode) for mode in ("reflected", "edge", "constant")))
    rows = t.select("vec_id", F.posexplode(F.arrays_zip("reflected", "edge", "constant")).alias("pos", "p"))
    return rows.select("vec_id", F.floor(F.col("pos") / (N + 4)).cast("int").alias("y"), (F.col("pos") % (N + 4)).cast("int").alias("x"), *(F.round(f"p.{c}", 6).alias(c) for c in ("reflected", "edge", "constant")))


@query("majority_mask", f"WITH {PIX} SELECT vec_id, y // 2 AS by, x // 2 AS bx, CASE WHEN avg(CASE WHEN v >= 0 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS water FROM pix GROUP BY ALL")
def majority_mask(spark, sf_dir):
    """A block is water if at least half of its pixels are."""
    wet = R.pixels(_tiles(spark, sf_dir), N, "vec_id").withColumn("v", (F.col("v") >= 0).cast("double"))
    return R.block_mean(wet, 2, "vec_id").select("vec_id", "by", "bx", (F.col("mean") >= 0.5).cast("int").alias("water"))


@query("scene_scalars", f"""WITH {PIX} SELECT vec_id, round(max(v), 6) AS peak, round(min(v), 6) AS least, round(100 * avg(CASE WHEN v >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS percent, round(sum(v), 6) AS total, round((max(v) - min(v)) / (2 * pi()), 6) AS cycles,
 count(*) FILTER (v >= 0.05 AND v >= 0.1 * (x - 3)) AS overlap_px, (max(v) - min(v)) * 8 BETWEEN 2 AND 8 AND 100 * avg(CASE WHEN v >= 0.05 THEN 1.0 ELSE 0.0 END) BETWEEN 1.5 AND 40 AS accepted FROM pix GROUP BY vec_id""")
def scene_scalars(spark, sf_dir):
    """Scalars of each scene, and whether it is accepted: range in cycles (here of eight times the values) within 2 to 8, positive area within 1.5 to 40 %."""
    v, set_ = F.col("v"), F.col("v") >= 0.05
    p = R.pixels(_tiles(spark, sf_dir), N, "vec_id").groupBy("vec_id")
    percent, extent = 100 * F.avg(set_.cast("double")), F.max("v") - F.min("v")
    out = p.agg(F.round(F.max("v"), 6).alias("peak"), F.round(F.min("v"), 6).alias("least"), percent.alias("p"), F.round(F.sum("v"), 6).alias("total"), extent.alias("e"), F.count_if(set_ & (v >= 0.1 * (F.col("x") - 3))).alias("overlap_px"))
    return out.select("vec_id", "peak", "least", F.round("p", 6).alias("percent"), "total", F.round(F.col("e") / (2 * math.pi), 6).alias("cycles"), "overlap_px", R.acceptable(F.col("e") * 8, F.col("p")).alias("accepted"))


@query("threshold_range", f"""WITH {PIX}, t AS (SELECT CAST(unnest([0.01, 0.02, 0.05, 10, 10.5, 'NaN'::DOUBLE, 'Infinity'::DOUBLE]) AS DOUBLE) AS t)
SELECT vec_id, CASE WHEN isnan(t) THEN 'nan' WHEN isinf(t) THEN 'inf' ELSE CAST(CAST(t * 100 AS INTEGER) AS VARCHAR) END AS threshold, t BETWEEN 0.02 AND 10 AS valid, CASE WHEN t BETWEEN 0.02 AND 10 THEN count(*) FILTER (abs(v) >= t) ELSE -1 END AS area FROM pix, t GROUP BY vec_id, t""")
def threshold_range(spark, sf_dir):
    """Candidate masks for thresholds given by a user: outside 0.02 to 10, or not finite, there is no mask (area -1)."""
    wanted = F.explode(F.array(*map(F.lit, (0.01, 0.02, 0.05, 10.0, 10.5, float("nan"), float("inf")))))
    t = _tiles(spark, sf_dir).withColumn("t", wanted)
    valid = ~F.isnan("t") & F.col("t").between(0.02, 10)
    name = F.when(F.isnan("t"), "nan").when(F.col("t") > 1e300, "inf").otherwise(F.round(F.col("t") * 100).cast("int").cast("string"))
    return t.select("vec_id", name.alias("threshold"), valid.alias("valid"), F.when(valid, F.size(F.filter("data", lambda v: F.abs(v) >= F.col("t"))).cast("long")).otherwise(F.lit(-1).cast("long")).alias("area"))


@query("phase_components", f"WITH {PIX} SELECT vec_id, y, x, round(sin(v * 8), 6) AS sine, round(cos(v * 8), 6) AS cosine FROM pix")
def phase_components(spark, sf_dir):
    """Phases (here eight times the values) as their sine and cosine, the two channels of a model input."""
    t = _tiles(spark, sf_dir).select("vec_id", F.transform("data", lambda v: F.round(F.sin(v * 8), 6)).alias("sine"), F.transform("data", lambda v: F.round(F.cos(v * 8), 6)).alias("cosine"))
    return _long(t, "sine", "cosine")


WIDE = """(SELECT i, k, w / sum(w) OVER (PARTITION BY i) AS w FROM (SELECT CAST(i AS INTEGER) AS i, CAST(k AS INTEGER) AS k, greatest(0, 1 - abs(k + 0.5 - (i + 0.5) * 8.0 / {n}) / greatest(1.0, 8.0 / {n})) AS w FROM generate_series(0, {n} - 1) AS g(i), generate_series(0, 7) AS h(k)) WHERE w > 0)"""


@query("raster_bilinear", f"WITH {PIX}, a AS {WIDE.format(n=5)}, b AS {WIDE.format(n=11)} SELECT p.vec_id, a.i AS y, b.i AS x, round(sum(a.w * b.w * p.v), 6) AS v FROM pix p JOIN a ON a.k = p.y JOIN b ON b.k = p.x GROUP BY p.vec_id, a.i, b.i")
def raster_bilinear(spark, sf_dir):
    """Tiles resampled bilinearly to 5 x 11 pixels: smaller one way, larger the other."""
    rows = _tiles(spark, sf_dir).select("vec_id", F.posexplode(R.resized(F.col("data"), N, N, 5, 11)).alias("pos", "v"))
    return rows.select("vec_id", F.floor(F.col("pos") / 11).cast("int").alias("y"), (F.col("pos") % 11).cast("int").alias("x"), F.round("v", 6).alias("v"))
