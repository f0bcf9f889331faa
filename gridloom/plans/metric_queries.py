"""Metrics, losses and size statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions.mathx import ratio, uniform
from gridloom.operators import metrics as S
from gridloom.operators.quantiles import exact_quantiles
from gridloom.plans.catalog import query
from gridloom.plans.field_queries import rng
from gridloom.plans.raster_queries import PIX, N, _tiles
from gridloom.operators import raster as R
from gridloom.sources.tables import table

PRED = f"p AS (SELECT doc_id, quality AS truth, CASE WHEN {rng(1, 'score', 'doc_id')} >= CAST(0.25 AS DOUBLE) THEN 1 ELSE 0 END AS pred, toxic = 0 AS valid, lang, source FROM labels JOIN documents USING (doc_id))"
CNT = "count(*) FILTER (valid AND pred = 1 AND truth = 1) AS tp, count(*) FILTER (valid AND pred = 1 AND truth = 0) AS fp, count(*) FILTER (valid AND pred = 0 AND truth = 1) AS fn, count(*) FILTER (valid AND pred = 0 AND truth = 0) AS tn"
SCO = "round(tp / nullif(tp + fp + fn, 0), 6) AS iou, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall"


def _predictions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.select("doc_id", F.col("quality").alias("truth"), (uniform(1, "score", "doc_id") >= 0.25).cast("int").alias("pred"), (F.col("toxic") == 0).alias("valid"), "lang", "source")


@query("confusion_metrics", f"WITH {PRED}, c AS (SELECT source, {CNT} FROM p GROUP BY source) SELECT *, {SCO} FROM c")
def confusion_metrics(spark, sf_dir):
    """Counts under the validity mask, and scores, of each arm."""
    return S.scores(_predictions(spark, sf_dir).groupBy("source").agg(*S.counts(F.col("pred"), F.col("truth"), F.col("valid"))))


@query("metrics_by_difficulty", f"WITH {PRED}, c AS (SELECT coalesce(lang, 'all') AS difficulty, {CNT} FROM p GROUP BY GROUPING SETS ((lang), ())) SELECT *, {SCO} FROM c")
def metrics_by_difficulty(spark, sf_dir):
    """Each difficulty and all of them together."""
    p = _predictions(spark, sf_dir)
    return S.scores(p.groupingSets([["lang"], []], "lang").agg(*S.counts(F.col("pred"), F.col("truth"), F.col("valid"))).select(F.coalesce("lang", F.lit("all")).alias("difficulty"), "tp", "fp", "fn", "tn"))


@query("arm_comparison", f"""WITH {PRED}, c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'baseline' ELSE 'matched' END AS arm, {CNT} FROM p GROUP BY ALL), s AS (SELECT *, {SCO} FROM c)
SELECT round(max(iou) FILTER (arm = 'matched') - max(iou) FILTER (arm = 'baseline'), 5) AS iou_gain, round(max(recall) FILTER (arm = 'matched') - max(recall) FILTER (arm = 'baseline'), 5) AS recall_gain, count(*) AS arms FROM s""")
def arm_comparison(spark, sf_dir):
    """Two arms under the same budget, and their difference."""
    p = _predictions(spark, sf_dir).withColumn("arm", F.when(F.col("doc_id") % 2 == 0, "baseline").otherwise("matched"))
    s = S.scores(p.groupBy("arm").agg(*S.counts(F.col("pred"), F.col("truth"), F.col("valid"))))
    of = lambda c, arm: F.max(F.when(F.col("arm") == arm, F.col(c)))
    return s.agg(F.round(of("iou", "matched") - of("iou", "baseline"), 5).alias("iou_gain"), F.round(of("recall", "matched") - of("recall", "baseline"), 5).alias("recall_gain"), F.count("*").alias("arms"))


LOSS = f"{PIX}, s AS (SELECT vec_id, y, x, least(1, greatest(0, v + 0.5)) AS p, CASE WHEN v >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM pix)"


@query("image_losses", f"""WITH {LOSS} SELECT vec_id, round(avg(pow(p - t, 2) * (1 + 4 * t)), 6) AS weighted_mse, round(avg(t * t * (1 + 4 * t)), 6) AS zero_baseline, round(sqrt(avg(pow(p - t, 2))), 6) AS rmse,
 round(-avg(t * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - t) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7))), 6) AS bce, round(1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1), 6) AS dice FROM s GROUP BY vec_id""")
def image_losses(spark, sf_dir):
    s = R.pixels(_tiles(spark, sf_dir), N, "vec_id").select("vec_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") + 0.5)).alias("p"), (F.col("v") >= 0.05).cast("double").alias("t"))
    p, t = F.col("p"), F.col("t")
    r = lambda c, name: F.round(c, 6).alias(name)
    return s.groupBy("vec_id").agg(r(S.weighted_error(p, t), "weighted_mse"), r(F.avg(t * t * (1 + 4 * t)), "zero_baseline"), r(F.sqrt(F.avg((p - t) ** 2)), "rmse"), r(S.cross_entropy(p, t), "bce"), r(S.dice_loss(p, t), "dice"))


@query("mean_rmse", f"""WITH {LOSS}, i AS (SELECT vec_id, sqrt(avg(pow(p - t, 2))) AS rmse FROM s GROUP BY vec_id) SELECT label, count(*) AS images, round(avg(rmse), 6) AS mean_rmse, round(max(rmse), 6) AS worst FROM i JOIN embeddings USING (vec_id) GROUP BY label""")
def mean_rmse(spark, sf_dir):
    """Root mean square error of each image, inside its row, and the mean over the images of a class."""
    p, t = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v + 0.5)), lambda v: (v >= 0.05).cast("double")
    d = F.transform(F.col("embedding").cast("array<double>"), lambda v: (p(v) - t(v)) * (p(v) - t(v)))
    rmse = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, v: a + v) / F.size(d))
    return table(spark, sf_dir, "embeddings").select("label", rmse.alias("rmse")).groupBy("label").agg(F.count("*").alias("images"), F.round(F.avg("rmse"), 6).alias("mean_rmse"), F.round(F.max("rmse"), 6).alias("worst"))


@query("gradient_loss", f"""WITH {LOSS}, g AS (SELECT vec_id, p - lag(p) OVER w AS dp, t - lag(t) OVER w AS dt FROM s WINDOW w AS (PARTITION BY vec_id, y ORDER BY x)) SELECT vec_id, round(avg(abs(dp - dt)), 6) AS gradient_l1 FROM g GROUP BY vec_id""")
def gradient_loss(spark, sf_dir):
    """Mean absolute difference of first differences along rows."""
    d = F.col("data")
    p, t = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v + 0.5)), lambda v: (v >= 0.05).cast("double")
    pairs = F.filter(F.transform(d, lambda v, i: F.when(i % N > 0, F.abs(p(v) - p(F.get(d, i - 1)) - t(v) + t(F.get(d, i - 1))))), lambda v: v.isNotNull())
    return _tiles(spark, sf_dir).select("vec_id", F.round(F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / F.size(pairs), 6).alias("gradient_l1"))


@query("epoch_loss", "SELECT l_linenumber AS epoch, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_loss, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS valid_px FROM lineitem GROUP BY l_linenumber")
def epoch_loss(spark, sf_dir):
    """Losses weighted by their number of valid pixels."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(F.round(F.sum(F.col("l_discount") * q) / F.sum(q), 6).alias("weighted_loss"), F.sum(q.cast("long")).alias("valid_px"))


@query("best_epoch", "WITH e AS (SELECT o_custkey, o_orderkey AS epoch, round(o_totalprice, -4) AS iou, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -4) DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, epoch, iou FROM e WHERE n = 1")
def best_epoch(spark, sf_dir):
    """The earliest of the best epochs, by one aggregation."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("epoch"), F.round("o_totalprice", -4).alias("iou"))
    return o.groupBy("o_custkey").agg(F.max(F.struct("iou", (-F.col("epoch")).alias("back"))).alias("b")).select("o_custkey", (-F.col("b.back")).alias("epoch"), "b.iou")


@query("size_bins", "SELECT lang, count(*) FILTER (n_chars < 256) AS small, count(*) FILTER (n_chars >= 256 AND n_chars < 4096) AS medium, count(*) FILTER (n_chars >= 4096) AS large, round(quantile_cont(n_chars, 0.5), 3) AS median FROM documents GROUP BY lang")
def size_bins(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(n < 256).alias("small"), F.count_if((n >= 256) & (n < 4096)).alias("medium"), F.count_if(n >= 4096).alias("large"), F.round(F.percentile("n_chars", 0.5), 3).alias("median"))


@query("scale_risk", "SELECT s AS scale, count(*) FILTER (n_chars / (s * s) < 64) AS below_1, count(*) FILTER (n_chars / (s * s) < 256) AS below_4, count(*) AS regions FROM documents, (SELECT unnest([1, 2, 4, 8]) AS s) GROUP BY s")
def scale_risk(spark, sf_dir):
    """Regions that shrink below one and four cells at each scale; one pass, no join."""
    n = F.col("n_chars")
    one = table(spark, sf_dir, "documents").agg(*(F.count_if(n / (s * s) < a).alias(f"{k}_{s}") for s in (1, 2, 4, 8) for k, a in (("below_1", 64), ("below_4", 256))), F.count("*").alias("regions"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("scale"), F.col(f"below_1_{s}").alias("below_1"), F.col(f"below_4_{s}").alias("below_4"), F.col("regions")) for s in (1, 2, 4, 8)))).alias("r")).select("r.*")


COV = "c AS (SELECT o_orderkey, o_custkey, o_orderpriority, avg(CASE WHEN l_discount >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cov, count(*) AS px FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


@query("object_coverage", f"WITH {COV} SELECT o_orderpriority AS scene, count(*) AS objects, count(*) FILTER (cov > 0) AS any_overlap, count(*) FILTER (cov >= 0.5) AS half_covered, round(avg(cov), 6) AS mean_coverage FROM c GROUP BY o_orderpriority")
def object_coverage(spark, sf_dir):
    """Objects (orders) and their pixels (lines): share of pixels with a high score."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg((F.col("l_discount") >= 0.05).cast("double")).alias("cov"))
    c = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return c.groupBy(F.col("o_orderpriority").alias("scene")).agg(F.count("*").alias("objects"), F.count_if(F.col("cov") > 0).alias("any_overlap"), F.count_if(F.col("cov") >= 0.5).alias("half_covered"), F.round(F.avg("cov"), 6).alias("mean_coverage"))


@query("negative_scenes", "WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS truth, max(CASE WHEN value >= 99 THEN 1 ELSE 0 END) AS pred FROM events GROUP BY user_id) SELECT count(*) AS scenes, count(*) FILTER (truth = 0) AS negatives, count(*) FILTER (truth = 0 AND pred = 1) AS negatives_with_false_positive FROM s")
def negative_scenes(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("truth"), F.max((F.col("value") >= 99).cast("int")).alias("pred"))
    return s.agg(F.count("*").alias("scenes"), F.count_if(F.col("truth") == 0).alias("negatives"), F.count_if((F.col("truth") == 0) & (F.col("pred") == 1)).alias("negatives_with_false_positive"))


@query("split_statistics", "SELECT lang AS split, count(*) AS scenes, round(quantile_cont(n_chars, 0.1), 4) AS p10, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.9), 4) AS p90, round(100.0 * avg(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END), 4) AS positive_percent, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def split_statistics(spark, sf_dir):
    """Counts and exact quantiles of large groups; the quantiles by counted value ranges, as a language may hold most rows."""
    n, rows = F.col("n_chars"), table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), "n_chars", "source")
    quantiles = exact_quantiles(rows, ["split"], "n_chars", [0.1, 0.5, 0.9]).select(F.col("split").alias("_s"), *(F.round(f"q{k}", 4).alias(name) for k, name in enumerate(("p10", "p50", "p90"))))
    whole = rows.groupBy("split").agg(F.count("*").alias("scenes"), F.round(100.0 * F.avg((n > 1000).cast("int")), 4).alias("positive_percent"), F.countDistinct("source").alias("sources"))
    return whole.join(quantiles, F.col("split").eqNullSafe(F.col("_s")), "left").select("split", "scenes", "p10", "p50", "p90", "positive_percent", "sources")


@query("mean_over_scales", f"WITH {PIX}, a AS (SELECT vec_id, y, x, v, avg(v) OVER (PARTITION BY vec_id, y // 2, x // 2) AS v2, avg(v) OVER (PARTITION BY vec_id, y // 4, x // 4) AS v4 FROM pix) SELECT vec_id, y, x, round((v + v2 + v4) / 3, 6) AS fused FROM a")
def mean_over_scales(spark, sf_dir):
    """Equal-weight mean of scores at full, half and quarter resolution."""
    d = F.col("data")

    def mean(f):
        return R.each_pixel(lambda y, x: F.aggregate(F.sequence(F.lit(0), F.lit(f * f - 1)), F.lit(0.0), lambda a, k: a + F.get(d, ((F.floor(y / f) * f + F.floor(k / f)) * N + F.floor(x / f) * f + k % f).cast("int"))) / (f * f), N, N)

    t = _tiles(spark, sf_dir).withColumn("v2", mean(2)).withColumn("v4", mean(4))
    fused = F.transform(d, lambda v, i: (v + F.get("v2", i) + F.get("v4", i)) / 3)
    rows = t.select("vec_id", F.posexplode(fused).alias("pos", "fused"))
    return rows.select("vec_id", F.floor(F.col("pos") / N).cast("int").alias("y"), (F.col("pos") % N).cast("int").alias("x"), F.round("fused", 6).alias("fused"))
