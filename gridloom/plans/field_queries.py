"""Deformation fields, phases and observations, over in-query grids and the event and order tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import mathx as M
from gridloom.operators import fields as P
from gridloom.plans.catalog import query
from gridloom.sources.tables import table

#: The error function in DuckDB, by the same series.
ERF = "(CASE WHEN abs({x}) >= 6 THEN sign({x}) ELSE 2 / sqrt(pi()) * exp(-({x}) * ({x})) * (list_reduce(list_prepend({{'k': 0, 't': {x}, 's': {x}}}, [{{'k': k, 't': CAST(0 AS DOUBLE), 's': CAST(0 AS DOUBLE)}} FOR k IN range(1, 121)]), lambda acc, cur: {{'k': cur.k, 't': acc.t * 2 * ({x}) * ({x}) / (2 * cur.k + 1), 's': acc.s + acc.t * 2 * ({x}) * ({x}) / (2 * cur.k + 1)}})).s END)"
RNG = "(CAST('0x' || substr(md5('{seed}:{stream}:' || CAST({key} AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0)"


def rng(seed: int, stream: str, key: str) -> str:
    return RNG.format(seed=seed, stream=stream, key=key)


@query("erf_values", f"SELECT event_id, round({ERF.format(x='x')}, 9) AS erf FROM (SELECT event_id, (value - 10) / 5 AS x FROM events)")
def erf_values(spark, sf_dir):
    """The error function of each event's value."""
    return table(spark, sf_dir, "events").select("event_id", F.round(M.erf((F.col("value") - 10) / 5), 9).alias("erf"))


@query("strip_profile", f"""SELECT p_partkey, round(({ERF.format(x='b')} - {ERF.format(x='a')}) / 2, 9) AS share FROM (SELECT p_partkey, sqrt(pi()) * (p_retailprice - 1500 - 400) / 250 AS a, sqrt(pi()) * (p_retailprice - 1500 + 400) / 250 AS b FROM part)""")
def strip_profile(spark, sf_dir):
    """Influence of a strip 800 m wide at the places that parts' prices give."""
    x, c = F.col("p_retailprice") - 1500, math.sqrt(math.pi)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(M.strip_integral(c * (x - 400) / 250, c * (x + 400) / 250), 9).alias("share"))


#: Places of customers around a face: metres east by balance, north by key.
PLACES = "SELECT c_custkey, (c_acctbal - 4000) / 8.37 AS e, (c_custkey % 17 - 8) * 100.0 AS n FROM customer"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_acctbal") - 4000) / 8.37).alias("e"), ((F.col("c_custkey") % 17 - 8) * 100.0).alias("n"))


@query("panel_epochs", f"""WITH seg AS (SELECT s, -300 + 600.0 / 8 * s AS lo, -300 + 600.0 / 8 * (s + 1) AS hi, 4.0 * s AS opened FROM generate_series(0, 7) AS g(s)), px AS ({PLACES}),
v AS (SELECT c_custkey, opened, sqrt(pi()) * (lo - e) / 220 AS a, sqrt(pi()) * (hi - e) / 220 AS b, sqrt(pi()) * (-150 - n) / 220 AS c, sqrt(pi()) * (150 - n) / 220 AS d FROM px, seg WHERE opened < 52)
SELECT c_custkey, round(sum(({ERF.format(x='b')} - {ERF.format(x='a')}) / 2 * ({ERF.format(x='d')} - {ERF.format(x='c')}) / 2 * 1.8 * (1 - exp(-greatest(52 - opened, 0) / 20.0))), 6) AS down_m FROM v GROUP BY c_custkey""")
def panel_epochs(spark, sf_dir):
    """Subsidence at customers' places over a rectangular working face, extracted segment by segment, at one epoch."""
    face = P.segments(spark, along=(-300.0, 300.0), across=(-150.0, 150.0), count=8, first_day=0.0, days=32.0)
    out = P.face_epoch(_places(spark, sf_dir), face, day=52.0, reach=220.0, depth=1.8, tau=20.0, keys=("c_custkey",))
    return out.select("c_custkey", F.round("down_m", 6).alias("down_m"))


@query("segment_convergence", f"""WITH c AS (SELECT unnest([8, 16, 32, 64]) AS n), seg AS (SELECT n, -300 + 600.0 / n * s AS lo, -300 + 600.0 / n * (s + 1) AS hi, 32.0 / n * s AS opened FROM c, generate_series(0, 63) AS g(s) WHERE s < n), px AS ({PLACES}),
v AS (SELECT n, c_custkey, opened, sqrt(pi()) * (lo - e) / 220 AS a, sqrt(pi()) * (hi - e) / 220 AS b FROM (SELECT c_custkey, e FROM px), seg),
f AS (SELECT n, c_custkey, sum(({ERF.format(x='b')} - {ERF.format(x='a')}) / 2 * (1 - exp(-greatest(40 - opened, 0) / 20.0))) AS d FROM v GROUP BY n, c_custkey)
SELECT f.n AS segments, round(sqrt(sum((f.d - r.d) * (f.d - r.d))) / sqrt(sum(r.d * r.d)), 6) AS relative_error FROM f JOIN f r ON r.c_custkey = f.c_custkey AND r.n = 64 WHERE f.n < 64 GROUP BY f.n""")
def segment_convergence(spark, sf_dir):
    """Relative error of coarse segmentation against a fine one, over customers' places."""
    c, fine = math.sqrt(math.pi) / 220, 64
    # bounds of coarse segments are bounds of fine ones: one error function a bound serves all
    bounds = _places(spark, sf_dir).select("c_custkey", "e", F.explode(F.sequence(F.lit(0), F.lit(fine))).alias("k"))
    at = bounds.select("c_custkey", "k", M.erf(c * (-300 + 600.0 / fine * F.col("k") - F.col("e"))).alias("erf"))
    weight = lambda n: F.get(F.array(*map(F.lit, P.bound_weights(n, fine, first_day=0.0, days=32.0, day=40.0, tau=20.0))), F.col("k"))
    rows = at.groupBy("c_custkey").agg(*(F.sum(F.col("erf") * weight(n)).alias(f"d{n}") for n in (8, 16, 32, 64)))
    off = lambda n: F.sqrt(F.sum((F.col(f"d{n}") - F.col("d64")) ** 2)) / F.sqrt(F.sum(F.col("d64") ** 2))
    whole = rows.agg(F.array(*(F.struct(F.lit(n).alias("segments"), F.round(off(n), 6).alias("relative_error")) for n in (8, 16, 32))).alias("r"))
    return whole.select(F.explode("r").alias("r")).select("r.*")


@query("face_response", """SELECT o_orderkey, round(-1.2 * (exp(-greatest(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)), 0) / 300.0) - 1), 6) AS down_m,
 round(-4 * pi() * (-(1.2 * (1 - exp(-greatest(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)), 0) / 300.0))) * cos(radians(34.0))) / 0.0555, 4) AS phase_rad FROM orders""")
def face_response(spark, sf_dir):
    """First-order response to the age of each order, projected on the line of sight, as phase."""
    age = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (1.2 * M.response(age, F.lit(300.0))).alias("down"))
    los = M.line_of_sight(F.col("down"), F.lit(0.0), F.lit(0.0), 34.0, -12.0)
    return rows.select("o_orderkey", F.round("down", 6).alias("down_m"), F.round(M.phase_of(los, 0.0555), 4).alias("phase_rad"))


@query("los_projection", """SELECT l_orderkey, l_linenumber, round(-d * cos(radians(35.0)) + (e * -cos(radians(-10.0)) + n * sin(radians(-10.0))) * sin(radians(35.0)), 6) AS los FROM (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS d, l_discount AS e, -l_tax AS n FROM lineitem)""")
def los_projection(spark, sf_dir):
    """Lines' quantity, discount and tax as displacement down, east and south, along the line of sight."""
    los = M.line_of_sight(F.col("l_quantity") / 10, F.col("l_discount"), -F.col("l_tax"), 35.0, -10.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(los, 6).alias("los"))


@query("phase_wrap_quantize", """SELECT event_id, round(atan2(sin(p), cos(p)), 6) AS wrapped, round(floor((p - floor(p / (2 * pi())) * 2 * pi()) / (2 * pi() / 16)) * (2 * pi() / 16), 6) AS edge,
 CAST(CAST(floor((p - floor(p / (2 * pi())) * 2 * pi()) / (2 * pi()) * 16) AS INTEGER) % 16 AS INTEGER) AS bin, abs(p) >= pi() / 2 AS fringe FROM (SELECT event_id, value - 50 AS p FROM events)""")
def phase_wrap_quantize(spark, sf_dir):
    p = F.col("value") - 50
    return table(spark, sf_dir, "events").select("event_id", F.round(M.wrap(p), 6).alias("wrapped"), F.round(M.quantize(p, 16), 6).alias("edge"), M.colour_index(p).alias("bin"), (F.abs(p) >= math.pi / 2).alias("fringe"))


@query("phase_colours", """WITH b AS (SELECT event_id, CAST(floor((value - floor(value / (2 * pi())) * 2 * pi()) / (2 * pi()) * 16) AS INTEGER) % 16 AS bin, value AS p FROM events)
SELECT event_id, CAST(round_even(127.5 * (1 + cos(p)), 0) AS INTEGER) AS r, CAST(round_even(127.5 * (1 + cos(p - 2 * pi() / 3)), 0) AS INTEGER) AS g, CAST(round_even(127.5 * (1 + cos(p + 2 * pi() / 3)), 0) AS INTEGER) AS b, 22.5 * bin AS hue FROM b""")
def phase_colours(spark, sf_dir):
    """Cosine channels and the hue of the phase's bin, looked up in a palette."""
    p = F.col("value")
    channel = lambda shift: F.rint(127.5 * (1 + F.cos(p + shift))).cast("int")
    palette = F.array(*(F.lit(22.5 * k) for k in range(16)))
    return table(spark, sf_dir, "events").select("event_id", channel(0.0).alias("r"), channel(-2 * math.pi / 3).alias("g"), channel(2 * math.pi / 3).alias("b"), F.get(palette, M.colour_index(p)).alias("hue"))


@query("complex_coherence", f"""WITH e AS (SELECT user_id, value AS a, 2 * pi() * {rng(7, 'phase', 'event_id')} AS f FROM events), s AS (SELECT user_id, a * cos(f) AS re1, a * sin(f) AS im1, a * cos(f) + 10 AS re2, a * sin(f) - 5 AS im2 FROM e)
SELECT user_id, count(*) AS looks, round(least(1, sqrt(pow(sum(re1 * re2 + im1 * im2), 2) + pow(sum(im1 * re2 - re1 * im2), 2)) / greatest(sqrt(sum(re1 * re1 + im1 * im1) * sum(re2 * re2 + im2 * im2)), 1e-20)), 6) AS coherence FROM s GROUP BY user_id""")
def complex_coherence(spark, sf_dir):
    """Sample coherence of two complex observations, each user's events as looks."""
    f = 2 * math.pi * M.uniform(7, "phase", "event_id")
    s = table(spark, sf_dir, "events").select("user_id", (F.col("value") * F.cos(f)).alias("re1"), (F.col("value") * F.sin(f)).alias("im1"))
    s = s.withColumn("re2", F.col("re1") + 10).withColumn("im2", F.col("im1") - 5)
    return s.groupBy("user_id").agg(F.count("*").alias("looks"), F.round(P.coherence("re1", "im1", "re2", "im2"), 6).alias("coherence"))


@query("circular_mean", """WITH m AS (SELECT event_type, avg(sin(value)) AS s, avg(cos(value)) AS c FROM events GROUP BY event_type)
SELECT event_type, round(CASE WHEN sqrt(s * s + c * c) > 1e-6 THEN atan2(s, c) ELSE 0 END, 6) AS mean_phase, round(sqrt(s * s + c * c), 6) AS strength FROM m""")
def circular_mean(spark, sf_dir):
    s, c = F.avg(F.sin("value")), F.avg(F.cos("value"))
    size = F.sqrt(s * s + c * c)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.when(size > 1e-6, F.atan2(s, c)).otherwise(0.0), 6).alias("mean_phase"), F.round(size, 6).alias("strength"))


@query("plane_wave_screen", f"""WITH w AS (SELECT k, 2 * pi() * {rng(3, 'angle', 'k')} AS a, 0.002 + 0.01 * {rng(3, 'freq', 'k')} AS f, 2 * pi() * {rng(3, 'start', 'k')} AS p FROM generate_series(0, 23) AS g(k)), px AS ({PLACES}),
s AS (SELECT c_custkey, sum(cos(f * (e * cos(a) + n * sin(a)) + p)) AS v FROM px, w GROUP BY c_custkey) SELECT c_custkey, round(0.004 * (v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS delay_m FROM s""")
def plane_wave_screen(spark, sf_dir):
    """A screen of 24 plane waves at customers' places, with zero mean and a given population deviation."""
    return P.plane_wave_screen(_places(spark, sf_dir), seed=3, waves=24, deviation=0.004, keys=("c_custkey",)).select("c_custkey", F.round("delay_m", 6).alias("delay_m"))


@query("water_raster", f"""WITH px AS ({PLACES}),
w AS (SELECT *, abs(n - (40 + 90 * sin(e / 180 + 0.7))) / sqrt(1 + pow(90.0 / 180 * cos(e / 180 + 0.7), 2)) <= 25 + 10 * sin(e / 240) AS river,
 sqrt(pow(e - 250, 2) + pow(n + 300, 2)) <= 120 * (1 + 0.2 * cos(3 * atan2(n + 300, e - 250) + 0.5)) AS pond FROM px)
SELECT c_custkey, CASE WHEN river OR pond THEN 1 ELSE 0 END AS water_mask, CASE WHEN river OR pond THEN 0.05 ELSE round(0.8 * exp(-abs(n) / 2000), 6) END AS model_coherence,
 CASE WHEN NOT (river OR pond) AND CAST(0.8 * exp(-abs(n) / 2000) AS FLOAT) >= CAST(0.7 AS FLOAT) THEN 1 ELSE 0 END AS valid_mask FROM w""")
def water_raster(spark, sf_dir):
    """A meandering river of varying width, a pond with a harmonic shoreline, coherence and validity at customers' places."""
    g = _places(spark, sf_dir)
    wet = P.river(F.col("e"), F.col("n"), centre=40.0, swing=90.0, length=180.0, start=0.7, width=25.0, change=10.0, period=240.0) | P.pond(F.col("e"), F.col("n"), 250.0, -300.0, 120.0, 0.2, 3, 0.5)
    land = 0.8 * F.exp(-F.abs("n") / 2000)
    return g.select("c_custkey", wet.cast("int").alias("water_mask"), F.when(wet, 0.05).otherwise(F.round(land, 6)).alias("model_coherence"), (~wet & (land.cast("float") >= F.lit(0.7).cast("float"))).cast("int").alias("valid_mask"))


@query("topographic_phase", """SELECT p_partkey, round(CASE WHEN abs(b) < 1e-12 THEN 0 ELSE 4 * pi() / 0.0555 * b / (850000 * sin(radians(34.0))) END * h, 6) AS topo_rad, round(0.00002 * h + 0.01 * (1 - exp(-h / 500)), 6) AS height_delay_m, round(0.9 * exp(-t / 120) * exp(-h / 4000), 6) AS coherence
 FROM (SELECT p_partkey, (p_partkey % 5 - 2) * 50.0 AS b, p_retailprice AS h, p_size * 1.0 AS t FROM part)""")
def topographic_phase(spark, sf_dir):
    """Topographic phase (none without a baseline), stratified delay and decaying coherence of parts: prices are heights, sizes days."""
    b, h, t = (F.col("p_partkey") % 5 - 2) * 50.0, F.col("p_retailprice"), F.col("p_size") * 1.0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(P.topographic_factor(b, 0.0555, 850000.0, 34.0) * h, 6).alias("topo_rad"), F.round(0.00002 * h + 0.01 * (1 - F.exp(-h / 500)), 6).alias("height_delay_m"), F.round(0.9 * F.exp(-t / 120) * F.exp(-h / 4000), 6).alias("coherence"))


@query("orbit_and_patch", f"""SELECT c_custkey, round(0.3 + 1.5 * x + -0.8 * y + 0.4 * x * y, 6) AS ramp_rad, round(0.9 - 0.6 * exp(-(pow(x - 0.2, 2) + pow(y + 0.1, 2)) / (2 * 0.3 * 0.3)), 6) AS disturbed FROM (SELECT c_custkey, e / 1000 AS x, n / 1000 AS y FROM ({PLACES}))""")
def orbit_and_patch(spark, sf_dir):
    """An orbit ramp and a patch of low coherence at customers' places."""
    e, n = F.col("e") / 1000, F.col("n") / 1000
    return _places(spark, sf_dir).select("c_custkey", F.round(0.3 + 1.5 * e - 0.8 * n + 0.4 * e * n, 6).alias("ramp_rad"), F.round(0.9 - 0.6 * F.exp(-((e - 0.2) ** 2 + (n + 0.1) ** 2) / (2 * 0.3 * 0.3)), 6).alias("disturbed"))


@query("random_draws", f"SELECT o_orderkey, round({rng(11, 'draw', 'o_orderkey')}, 9) AS u, round(400 + {rng(11, 'draw', 'o_orderkey')} * 5600, 6) AS extent, CASE WHEN {rng(11, 'mode', 'o_orderkey')} < 0.3 THEN 'none' WHEN {rng(11, 'mode', 'o_orderkey')} < 0.6 THEN 'river' WHEN {rng(11, 'mode', 'o_orderkey')} < 0.85 THEN 'pond' ELSE 'mixed' END AS water_mode FROM orders")
def random_draws(spark, sf_dir):
    """Draws keyed by seed, stream and row; scaled, and looked up in cumulative weights."""
    u, m = M.uniform(11, "draw", "o_orderkey"), M.uniform(11, "mode", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(u, 9).alias("u"), F.round(M.wrap_unit(u, 400.0, 6000.0), 6).alias("extent"), P.pick(m, (("none", 0.3), ("river", 0.6), ("pond", 0.85), ("mixed", 1.0))).alias("water_mode"))


@query("simulated_scenes")
def simulated_scenes(spark, sf_dir):
    """Whole scenes for the parts table: each part's key seeds a scene; results are scalars per scene."""
    requests = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scene_id"), (20 + F.col("p_size")).cast("double").alias("depth"), (F.col("p_retailprice") % 360).alias("turn"))
    return P.scene_summary(P.simulated(requests, size=32), size=32)


@query("overlay_colours", """WITH e AS (SELECT event_id, value, least(1.0, greatest(0.0, value / 50)) AS t, value / 100 AS h FROM events),
r AS (SELECT *, round_even(CASE WHEN t <= 0.5 THEN 20 + (240 - 20) * t / 0.5 ELSE 240 + (180 - 240) * (t - 0.5) / 0.5 END, 0) AS r, round_even(CASE WHEN t <= 0.5 THEN 40 + (230 - 40) * t / 0.5 ELSE 230 + (30 - 230) * (t - 0.5) / 0.5 END, 0) AS g, round_even(CASE WHEN t <= 0.5 THEN 120 + (200 - 120) * t / 0.5 ELSE 200 + (20 - 200) * (t - 0.5) / 0.5 END, 0) AS b,
 (5 + 6 * h) - floor((5 + 6 * h) / 6) * 6 AS k5, (3 + 6 * h) - floor((3 + 6 * h) / 6) * 6 AS k3, (1 + 6 * h) - floor((1 + 6 * h) / 6) * 6 AS k1 FROM e)
SELECT event_id, CAST(CASE WHEN value >= 20 THEN floor(r * 0.55 + 44 * 0.45) ELSE r END AS INTEGER) AS r, CAST(CASE WHEN value >= 20 THEN floor(g * 0.55 + 210 * 0.45) ELSE g END AS INTEGER) AS g, CAST(CASE WHEN value >= 20 THEN floor(b * 0.55 + 163 * 0.45) ELSE b END AS INTEGER) AS b,
 CAST(round_even(255 * (0.9 - 0.9 * 0.8 * greatest(0, least(k5, 4 - k5, 1))), 0) AS INTEGER) AS hsv_r, CAST(round_even(255 * (0.9 - 0.9 * 0.8 * greatest(0, least(k3, 4 - k3, 1))), 0) AS INTEGER) AS hsv_g, CAST(round_even(255 * (0.9 - 0.9 * 0.8 * greatest(0, least(k1, 4 - k1, 1))), 0) AS INTEGER) AS hsv_b FROM r""")
def overlay_colours(spark, sf_dir):
    """A colour ramp with marked values laid over, and hues turned into red, green and blue."""
    v = F.col("value")
    ramp = M.ramp(v / 50, [(0.0, (20, 40, 120)), (0.5, (240, 230, 200)), (1.0, (180, 30, 20))])
    rows = table(spark, sf_dir, "events").select("event_id", M.overlaid(ramp, (44, 210, 163), 0.45, v >= 20).alias("c"), M.hsv_rgb(v / 100, F.lit(0.8), F.lit(0.9)).alias("h"))
    return rows.select("event_id", *(F.get("c", F.lit(k)).alias(n) for k, n in enumerate("rgb")), *(F.get("h", F.lit(k)).alias(f"hsv_{n}") for k, n in enumerate("rgb")))
