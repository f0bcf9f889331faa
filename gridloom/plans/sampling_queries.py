"""Sampling plans, scenario draws and audits of generated data."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from gridloom.functions import mathx as M
from gridloom.operators import fields, manifests, raster
from gridloom.plans.catalog import query
from gridloom.plans.field_queries import rng
from gridloom.plans.raster_queries import PIX, N, _tiles
from gridloom.sources.tables import table


@query("scenario_draws", f"""SELECT i AS idx, 'face_scene_' || lpad(CAST(i AS VARCHAR), 5, '0') AS scene_id, ['single', 'double', 'deep', 'wet', 'negative'][i % 5 + 1] AS category, CASE WHEN i % 2 = 0 THEN 'standard' ELSE 'sparse' END AS profile,
 round(300 + {rng(21, 'length', 'i')} * 900, 6) AS length_m, round(CASE WHEN i % 5 = 2 THEN 500 ELSE 150 END + {rng(21, 'depth', 'i')} * 250, 6) AS depth_m, CAST(floor({rng(21, 'seed', 'i')} * 4294967296) AS BIGINT) AS seed FROM (SELECT p_partkey AS i FROM part)""")
def scenario_draws(spark, sf_dir):
    """A scene a part, cycling through categories and profiles, each parameter a keyed draw in its range."""
    i = F.col("id")
    names = F.array(*map(F.lit, ("single", "double", "deep", "wet", "negative")))
    u = lambda stream: M.uniform(21, stream, "id")
    depth = F.when(i % 5 == 2, 500).otherwise(150) + u("depth") * 250
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).select(
        i.alias("idx"), F.concat(F.lit("face_scene_"), F.lpad(i.cast("string"), 5, "0")).alias("scene_id"), F.get(names, (i % 5).cast("int")).alias("category"), F.when(i % 2 == 0, "standard").otherwise("sparse").alias("profile"),
        F.round(M.wrap_unit(u("length"), 300.0, 1200.0), 6).alias("length_m"), F.round(depth, 6).alias("depth_m"), F.floor(u("seed") * 4294967296).alias("seed"),
    )


@query("mined_strips", f"""WITH s AS (SELECT CAST(i // 12 AS BIGINT) AS scene, i % 12 AS strip, (i % 12 + 0.5) / 12 AS mid, {rng(31, 'edge', 'i')} AS u FROM (SELECT c_custkey AS i FROM customer))
SELECT scene, CAST(strip AS BIGINT) AS strip, round(-300 + 50.0 * strip, 6) AS lo, round(-250 + 50.0 * strip, 6) AS hi, round(CASE WHEN mid <= 0.25 THEN 60 + (140 - 60) * mid / 0.25 WHEN mid <= 0.75 THEN 140 + (120 - 140) * (mid - 0.25) / 0.5 ELSE 120 + (40 - 120) * (mid - 0.75) / 0.25 END * (0.9 + 0.2 * u), 6) AS width_m FROM s""")
def mined_strips(spark, sf_dir):
    """Strips along panels, one a customer, their widths interpolated between knots and roughened by draws."""
    i = F.col("id")
    mid = (i % 12 + 0.5) / 12
    knots = ((0.0, 60.0), (0.25, 140.0), (0.75, 120.0), (1.0, 40.0))
    width = None
    for (a, x), (b, y) in reversed(list(zip(knots, knots[1:]))):
        value = x + (y - x) * (mid - a) / (b - a)
        width = value if width is None else F.when(mid <= b, value).otherwise(width)
    strip = i % 12
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).select(F.floor(i / 12).alias("scene"), strip.alias("strip"), F.round(-300 + 50.0 * strip, 6).alias("lo"), F.round(-250 + 50.0 * strip, 6).alias("hi"), F.round(width * (0.9 + 0.2 * M.uniform(31, "edge", "id")), 6).alias("width_m"))


@query("extent_adaptation", """WITH RECURSIVE r AS (SELECT p_partkey, 0 AS step, p_retailprice AS extent, CAST(p_size AS DOUBLE) AS percent FROM part UNION ALL SELECT p_partkey, step + 1, least(6000, greatest(400, extent * sqrt(percent / 20))), percent * pow(extent / least(6000, greatest(400, extent * sqrt(percent / 20))), 2) FROM r WHERE step < 2 AND abs(percent - 20) > 1)
SELECT p_partkey, max(step) AS rounds, round(arg_max(extent, step), 4) AS extent_m, round(arg_max(percent, step), 4) AS percent FROM r GROUP BY p_partkey""")
def extent_adaptation(spark, sf_dir):
    """At most two rounds that move a scene's extent towards a wanted share of positive area."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.lit(0).alias("rounds"), F.col("p_retailprice").alias("extent"), F.col("p_size").cast("double").alias("percent")).alias("s"))

    def step(s, _):
        wider = F.least(F.lit(6000.0), F.greatest(F.lit(400.0), s["extent"] * F.sqrt(s["percent"] / 20)))
        more = F.abs(s["percent"] - 20) > 1
        return F.struct((s["rounds"] + more.cast("int")).alias("rounds"), F.when(more, wider).otherwise(s["extent"]).alias("extent"), F.when(more, s["percent"] * F.pow(s["extent"] / wider, 2)).otherwise(s["percent"]).alias("percent"))

    out = rows.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(2)), F.col("s"), step))
    return out.select("p_partkey", "s.rounds", F.round("s.extent", 4).alias("extent_m"), F.round("s.percent", 4).alias("percent"))


@query("positive_crops", f"""WITH {PIX}, p AS (SELECT vec_id, list({{'y': y, 'x': x}} ORDER BY y, x) AS spots FROM pix WHERE v >= 0.05 GROUP BY vec_id), d AS (SELECT vec_id, spots[CAST(floor({rng(41, 'pixel', 'vec_id')} * len(spots)) AS INTEGER) + 1] AS c FROM p)
SELECT vec_id, greatest(0, least(4, c.y - 2)) AS top, greatest(0, least(4, c.x - 2)) AS left_px FROM d""")
def positive_crops(spark, sf_dir):
    """A crop centred on a drawn positive pixel, moved inside the tile."""
    places = F.filter(F.sequence(F.lit(0), F.lit(N * N - 1)), lambda i: F.get("data", i) >= 0.05)
    t = _tiles(spark, sf_dir).withColumn("at", places).where(F.size("at") > 0)
    c = F.get("at", F.floor(M.uniform(41, "pixel", "vec_id") * F.size("at")).cast("int"))
    inside = lambda v: F.greatest(F.lit(0), F.least(F.lit(4), v - 2))
    return t.withColumn("c", c).select("vec_id", inside(F.floor(F.col("c") / N).cast("int")).alias("top"), inside(F.col("c") % N).alias("left_px"))


@query("balanced_draws", f"""WITH s AS (SELECT vec_id, label % 2 AS c, row_number() OVER (PARTITION BY label % 2 ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label % 2) AS n FROM embeddings), d AS (SELECT CAST(i AS BIGINT) AS draw, i % 2 AS c, {rng(51, 'scene', 'i')} AS u FROM generate_series(0, 999) AS g(i))
SELECT draw, vec_id FROM d JOIN s ON s.c = d.c AND s.k = CAST(floor(d.u * s.n) AS BIGINT)""")
def balanced_draws(spark, sf_dir):
    """Draws that alternate between two classes, each scene of a class as likely as another."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("c"))
    s = manifests.ranked_by(s, ["c"], F.floor(F.col("vec_id") / 4096), "vec_id").withColumn("k", F.col("place") - 1)
    n = s.groupBy("c").agg(F.count("*").alias("n"))
    d = spark.range(1000).select(F.col("id").alias("draw"), (F.col("id") % 2).cast("int").alias("c"), M.uniform(51, "scene", "id").alias("u")).join(F.broadcast(n), "c")  # two rows
    return d.withColumn("k", F.floor(F.col("u") * F.col("n"))).join(s, ["c", "k"]).select("draw", "vec_id")


@query("boundary_preview", f"""WITH {PIX}, t AS (SELECT unnest([0.025, 0.05, 0.1]) AS t) SELECT vec_id, CAST(t AS DOUBLE) AS threshold, count(*) FILTER (CAST(v AS FLOAT) >= CAST(t AS FLOAT)) AS area, coalesce(min(x) FILTER (CAST(v AS FLOAT) >= CAST(t AS FLOAT)), 0) AS x0, coalesce(max(x) FILTER (CAST(v AS FLOAT) >= CAST(t AS FLOAT)) + 1, 0) AS x1 FROM pix, t GROUP BY vec_id, t""")
def boundary_preview(spark, sf_dir):
    """Masks at half, once and twice the threshold, with their bounds."""
    at = F.explode(F.array(F.lit(0.025), F.lit(0.05), F.lit(0.1)))
    p = raster.pixels(_tiles(spark, sf_dir).withColumn("threshold", at), N, "vec_id", "threshold")
    set_ = F.col("v").cast("float") >= F.col("threshold").cast("float")
    return p.groupBy("vec_id", "threshold").agg(F.count_if(set_).alias("area"), F.coalesce(F.min(F.when(set_, F.col("x"))), F.lit(0)).alias("x0"), F.coalesce(F.max(F.when(set_, F.col("x"))) + 1, F.lit(0)).alias("x1"))


@query("set_membership_audit", """WITH e AS (SELECT DISTINCT md5(text) AS h FROM benchmark), f AS (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT (SELECT count(*) FROM e) AS evaluation, (SELECT count(*) FROM f) AS fit, (SELECT count(*) FROM e WHERE h IN (SELECT h FROM f)) AS shared, (SELECT CAST(sum(n - 1) AS BIGINT) FROM f) AS repeated_texts""")
def set_membership_audit(spark, sf_dir):
    """Hashes of fit texts against evaluation texts, which must not meet."""
    e = table(spark, sf_dir, "benchmark").select(F.md5("text").alias("h")).distinct()
    f = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"))
    shared = e.join(f, "h", "left_semi").agg(F.count("*").alias("shared"))
    return e.agg(F.count("*").alias("evaluation")).join(f.agg(F.count("*").alias("fit"), F.sum(F.col("n") - 1).alias("repeated_texts"))).join(shared).select("evaluation", "fit", "shared", "repeated_texts")


@query("scene_audit")
def scene_audit(spark, sf_dir):
    """Invariants of generated scenes, each found where the scene's row is: how many of its pixels break it."""
    requests = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene_id"), (20 + F.col("s_suppkey") % 40).cast("double").alias("depth"), (F.col("s_suppkey") * 7 % 180).cast("double").alias("turn"))
    p = fields.simulated(requests, 32)
    finite = lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v)
    bands = ("down_m", "dem_m", "phase_rad", "wrapped_rad", "coherence")
    broken = lambda values, rule: F.size(F.filter(values, rule)).cast("long")
    return p.select(
        "scene_id",
        F.size("down_m").cast("long").alias("pixels"),
        broken(F.arrays_zip(*bands), lambda v: ~reduce(and_, (finite(v[b]) for b in bands))).alias("not_finite"),
        broken("wrapped_rad", lambda v: F.abs(v) > F.lit(math.pi).cast("float")).alias("not_wrapped"),
        broken("coherence", lambda v: (v < 0) | (v > 1)).alias("coherence_out_of_range"),
        broken(F.arrays_zip("mask", "down_m"), lambda v: v["mask"] != (v["down_m"] >= F.lit(0.005).cast("float")).cast("int")).alias("mask_mismatch"),
        F.lit(len(bands)).alias("bands"),
    )


@query("safe_paths", "SELECT page_id, regexp_replace(url, '^https?://', '') AS path, regexp_matches(regexp_extract(url, '([^/?]+)[?]', 1), '^[\\w-]{1,40}$') AS plain_name, NOT contains(url, '..') AND NOT starts_with(url, '/') AS inside FROM pages")
def safe_paths(spark, sf_dir):
    """Names that are plain, and paths that stay inside their root."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(u, "^https?://", "").alias("path"), F.regexp_extract(u, "([^/?]+)[?]", 1).rlike(r"^[\w-]{1,40}$").alias("plain_name"), (~u.contains("..") & ~u.startswith("/")).alias("inside"))


@query("correlation_error", f"""WITH g AS (SELECT unnest([0.0, 0.3, 0.7, 1.0])::DOUBLE AS gamma), d AS (SELECT i, sqrt(-2 * ln(1 - {rng(61, 'r1', 'i')})) AS r1, 2 * pi() * {rng(61, 'a1', 'i')} AS a1, sqrt(-2 * ln(1 - {rng(61, 'r2', 'i')})) AS r2, 2 * pi() * {rng(61, 'a2', 'i')} AS a2 FROM (SELECT o_orderkey AS i FROM orders)),
o AS (SELECT gamma, r1 * cos(a1) AS x1, r1 * sin(a1) AS y1, gamma * r1 * cos(a1) + sqrt(1 - gamma * gamma) * r2 * cos(a2) AS x2, gamma * r1 * sin(a1) + sqrt(1 - gamma * gamma) * r2 * sin(a2) AS y2 FROM d, g)
SELECT gamma, round(abs(avg(x1 * x2 + y1 * y2) / sqrt(avg(x1 * x1 + y1 * y1) * avg(x2 * x2 + y2 * y2)) - gamma), 6) AS error, count(*) AS looks FROM o GROUP BY gamma""")
def correlation_error(spark, sf_dir):
    """Correlated complex pairs, drawn for each order by Box and Muller; how far their correlation is from the wanted one."""
    u = lambda s: M.uniform(61, s, "id")
    r = lambda s: F.sqrt(-2 * F.log(1 - u(s)))
    a1, a2 = 2 * math.pi * u("a1"), 2 * math.pi * u("a2")
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).select((r("r1") * F.cos(a1)).alias("x1"), (r("r1") * F.sin(a1)).alias("y1"), (r("r2") * F.cos(a2)).alias("n1"), (r("r2") * F.sin(a2)).alias("n2"))
    d = d.select("*", F.explode(F.array(*map(F.lit, (0.0, 0.3, 0.7, 1.0)))).alias("gamma"))
    rest = F.sqrt(1 - F.col("gamma") ** 2)
    o = d.select("gamma", "x1", "y1", (F.col("gamma") * F.col("x1") + rest * F.col("n1")).alias("x2"), (F.col("gamma") * F.col("y1") + rest * F.col("n2")).alias("y2"))
    dot = lambda a, b: F.avg(F.col(f"x{a}") * F.col(f"x{b}") + F.col(f"y{a}") * F.col(f"y{b}"))
    return o.groupBy("gamma").agg(F.round(F.abs(dot(1, 2) / F.sqrt(dot(1, 1) * dot(2, 2)) - F.col("gamma")), 6).alias("error"), F.count("*").alias("looks"))


@query("region_hits", f"""WITH {PIX}, m AS (SELECT vec_id, y, x, x - row_number() OVER (PARTITION BY vec_id, y ORDER BY x) AS island FROM pix WHERE v >= 0.05), r AS (SELECT vec_id, y, min(x) AS lo, max(x) + 1 AS hi FROM m GROUP BY vec_id, y, island)
SELECT r.vec_id, r.y, r.lo, count(*) AS px, count(*) FILTER (p.v >= 0.1) AS hits, round(count(*) FILTER (p.v >= 0.1) / count(*), 6) AS covered FROM r JOIN pix p ON p.vec_id = r.vec_id AND p.y = r.y AND p.x >= r.lo AND p.x < r.hi GROUP BY r.vec_id, r.y, r.lo""")
def region_hits(spark, sf_dir):
    """Runs against prediction pixels: the equi-join is on the row, the interval is its condition."""
    p = raster.pixels(_tiles(spark, sf_dir), N, "vec_id")
    r = raster.runs(p.withColumn("v", (F.col("v") >= 0.05).cast("int")), "vec_id")
    hit = F.count_if(F.col("v") >= 0.1)
    return r.join(p, ["vec_id", "y"]).where("lo <= x AND x < hi").groupBy("vec_id", "y", "lo").agg(F.count("*").alias("px"), hit.alias("hits"), F.round(hit / F.count("*"), 6).alias("covered"))


@query("scope_exclusion", f"WITH {PIX}, s AS (SELECT vec_id, y, x FROM pix WHERE v >= 0), c AS (SELECT vec_id, y, x FROM pix WHERE abs(v) > 0.1) SELECT vec_id, count(*) AS px FROM (SELECT * FROM s EXCEPT SELECT * FROM c) GROUP BY vec_id")
def scope_exclusion(spark, sf_dir):
    """Pixels of a scope without those in conflict."""
    p = raster.pixels(_tiles(spark, sf_dir), N, "vec_id")
    left = p.where("v >= 0").select("vec_id", "y", "x").subtract(p.where("abs(v) > 0.1").select("vec_id", "y", "x"))
    return left.groupBy("vec_id").agg(F.count("*").alias("px"))


@query("circular_observation", f"""WITH {PIX}, o AS (SELECT vec_id, y, x, v + 0.3 * sqrt(-2 * ln(1 - {rng(81, 'r', "vec_id || ':' || y || ':' || x || ':' || k")})) * cos(2 * pi() * {rng(81, 'a', "vec_id || ':' || y || ':' || x || ':' || k")}) AS p FROM pix, generate_series(0, 3) AS g(k))
SELECT vec_id AS scene_id, y, x, round(CASE WHEN avg(sin(p)) < 0 THEN atan2(avg(sin(p)), avg(cos(p))) + 2 * pi() ELSE atan2(avg(sin(p)), avg(cos(p))) END, 6) AS observed_rad, round(sqrt(avg(sin(p)) * avg(sin(p)) + avg(cos(p)) * avg(cos(p))), 6) AS strength FROM o GROUP BY vec_id, y, x""")
def circular_observation(spark, sf_dir):
    """Tiles as phases, observed in four looks with normal noise: angle and length of the mean phasor."""
    p = raster.pixels(_tiles(spark, sf_dir), N, "vec_id").select("vec_id", "y", "x", "v", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    u = lambda stream: M.uniform(81, stream, "vec_id", "y", "x", "k")
    noisy = F.col("v") + 0.3 * F.sqrt(-2 * F.log(1 - u("r"))) * F.cos(2 * math.pi * u("a"))
    means = p.withColumn("p", noisy).groupBy(F.col("vec_id").alias("scene_id"), "y", "x").agg(F.avg(F.sin("p")).alias("s"), F.avg(F.cos("p")).alias("c"))
    return means.select("scene_id", "y", "x", F.round(F.atan2("s", "c") + F.when(F.col("s") < 0, 2 * math.pi).otherwise(0.0), 6).alias("observed_rad"), F.round(F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")), 6).alias("strength"))
