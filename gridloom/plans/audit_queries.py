"""Audits composed of several operators, evaluations, and small conversions of fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import mathx
from gridloom.operators import manifests as M
from gridloom.operators import metrics, raster
from gridloom.operators.regions import labelled_tiles, regions
from gridloom.plans.catalog import query
from gridloom.plans.raster_queries import N, PIX, REGIONS, _mask, _tiles, tile_fusion
from gridloom.session import staged
from gridloom.sources.tables import table

FUSED = """t AS (SELECT unnest([0, 3, 4]) AS t), w AS (SELECT p.vec_id, p.y, p.x, p.v * (1 + 0.01 * a.t + 0.02 * b.t) AS pv,
 greatest(0.5 - 0.5 * cos(2 * pi() * (p.y - a.t) / 3), 0.05) * greatest(0.5 - 0.5 * cos(2 * pi() * (p.x - b.t) / 3), 0.05) AS wt
 FROM pix p JOIN t a ON p.y >= a.t AND p.y < a.t + 4 JOIN t b ON p.x >= b.t AND p.x < b.t + 4), fused AS (SELECT vec_id, y, x, round(sum(wt * pv) / sum(wt), 6) AS fused FROM w GROUP BY ALL)"""


@query("dataset_validation", """WITH s AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS places, max(l_linenumber) AS last, sum(l_extendedprice * (1 - l_discount)) AS net, sum(l_extendedprice) AS gross, sum(l_extendedprice * l_discount) AS off, count(DISTINCT l_linestatus) AS states FROM lineitem GROUP BY 1),
j AS (SELECT o.*, s.* FROM orders o LEFT JOIN s ON l_orderkey = o_orderkey),
c AS (SELECT 'count' AS "check", coalesce(CAST(n AS DOUBLE), 0) AS was, CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END AS v, 0.5 AS tol FROM j UNION ALL SELECT 'shape', 0, CASE WHEN n IS NOT NULL THEN CAST(n - places AS DOUBLE) END, 0.5 FROM j UNION ALL SELECT 'sum', 0, abs(gross - off - net), 1e-6 FROM j UNION ALL SELECT 'total', 0, abs(o_totalprice - net) / o_totalprice, 0.5 FROM j UNION ALL SELECT 'state', 0, CASE WHEN states IS NOT NULL THEN CAST(states - 1 AS DOUBLE) END, 0.5 FROM j)
SELECT "check", count(*) AS rows, round(max(v), 4) AS largest, count(*) FILTER (NOT coalesce(v <= tol, FALSE)) AS failed FROM c GROUP BY 1""")
def dataset_validation(spark, sf_dir):
    """Stored records against their manifest, in one pass: presence, shape, sum of components, total, one state each."""
    one = F.col("l_extendedprice")
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("places"), F.sum(one * (1 - F.col("l_discount"))).alias("net"), F.sum(one).alias("gross"), F.sum(one * F.col("l_discount")).alias("off"), F.countDistinct("l_linestatus").alias("states")
    )
    j = table(spark, sf_dir, "orders").join(s, "o_orderkey", "left")
    found = M.deviations(j, {
        "count": (F.col("n").isNull().cast("double"), 0.5), "shape": ((F.col("n") - F.col("places")).cast("double"), 0.5), "sum": (F.abs(F.col("gross") - F.col("off") - F.col("net")), 1e-6),
        "total": (F.abs(F.col("o_totalprice") - F.col("net")) / F.col("o_totalprice"), 0.5), "state": ((F.col("states") - 1).cast("double"), 0.5),
    })
    return found.withColumn("largest", F.round("largest", 4))


@query("batch_audit", """WITH d AS (SELECT doc_id, md5(text) AS h, source, lang, length(text) AS n FROM documents), g AS (SELECT h, count(*) AS copies, count(DISTINCT source) AS splits FROM d GROUP BY h), b AS (SELECT DISTINCT md5(text) AS h FROM benchmark), l AS (SELECT doc_id, quality, toxic FROM labels)
SELECT 'repeated_hash' AS rule, CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS broken FROM g UNION ALL SELECT 'group_in_splits', count(*) FILTER (splits > 1) FROM g UNION ALL SELECT 'baseline_reuse', count(*) FROM d WHERE h IN (SELECT h FROM b)
UNION ALL SELECT 'label_without_record', count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT 'label_value', count(*) FROM l WHERE NOT (quality IN (0, 1) AND toxic IN (0, 1)) UNION ALL SELECT 'empty_positive', count(*) FROM l JOIN d USING (doc_id) WHERE quality = 1 AND n < 50""")
def batch_audit(spark, sf_dir):
    """Rules over a batch with how many rows break each: contents, groups, reuse of the baseline, labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"), "source", F.length("text").alias("n"))
    g = d.groupBy("h").agg(F.count("*").alias("copies"), F.countDistinct("source").alias("splits"))
    by_group = g.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated_hash"), F.count_if(F.col("splits") > 1).alias("group_in_splits"))
    reuse = d.join(table(spark, sf_dir, "benchmark").select(F.md5("text").alias("h")).distinct(), "h", "left_semi").agg(F.count("*").alias("baseline_reuse"))
    l = table(spark, sf_dir, "labels").join(d.select("doc_id", "n"), "doc_id", "left")
    values = F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)
    by_label = l.agg(F.count_if(F.col("n").isNull()).alias("label_without_record"), F.count_if(~values).alias("label_value"), F.count_if((F.col("quality") == 1) & (F.col("n") < 50)).alias("empty_positive"))
    row = by_group.join(reuse).join(by_label)  # one row each
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("broken")) for c in row.columns))).alias("r")).select("r.*")


@query("export_inspection", """WITH m AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), i AS (SELECT o_orderpriority AS export, o_orderkey AS k, length(o_orderstatus) AS width FROM orders)
SELECT export, count(*) AS images, count(m.k) AS masks, count(*) - count(m.k) AS missing, count(DISTINCT width) AS sizes, count(*) = count(m.k) AND count(DISTINCT width) = 1 AS complete FROM i LEFT JOIN m ON m.k = i.k GROUP BY export""")
def export_inspection(spark, sf_dir):
    """Each export: as many masks as images, none missing, all of one size."""
    i = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("export"), F.col("o_orderkey").alias("k"), F.length("o_orderstatus").alias("width"))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("has", F.lit(1))
    out = i.join(m, "k", "left").groupBy("export").agg(F.count("*").alias("images"), F.count("has").alias("masks"), F.countDistinct("width").alias("sizes"))
    return out.select("export", "images", "masks", (F.col("images") - F.col("masks")).alias("missing"), "sizes", ((F.col("images") == F.col("masks")) & (F.col("sizes") == 1)).alias("complete"))


LISTED = REGIONS + """, r AS (SELECT l.vec_id, label, count(*) AS area, min(m.x) AS x0, min(m.y) AS y0 FROM lab l JOIN m USING (vec_id, p) GROUP BY l.vec_id, label)"""


@query("label_audit", LISTED + """ SELECT count(*) AS regions, count(DISTINCT vec_id) AS tiles, CAST(sum(area) AS BIGINT) AS positive_px, """ + ", ".join(f"round(quantile_cont(sqrt(area), {q / 100}), 6) AS width_q{q}" for q in (0, 25, 50, 75, 90, 100)) + """, count(*) FILTER (area = 1) AS single_px FROM r""")
def label_audit(spark, sf_dir):
    """Annotated regions: how many, on how many tiles, quantiles of their equivalent widths."""
    r = regions(labelled_tiles(_mask(spark, sf_dir), "vec_id", N), "vec_id")
    return r.agg(F.count("*").alias("regions"), F.countDistinct("vec_id").alias("tiles"), F.sum("area_px").alias("positive_px"), *(F.round(F.percentile("equivalent_width", q / 100), 6).alias(f"width_q{q}") for q in (0, 25, 50, 75, 90, 100)), F.count_if(F.col("area_px") == 1).alias("single_px"))


@query("label_audit_picks", LISTED + """, k AS (SELECT *, row_number() OVER (ORDER BY area, vec_id, label) - 1 AS k, count(*) OVER () AS n FROM r), t AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 19.0) AS BIGINT) AS k FROM k, generate_series(0, 19) AS g(i))
SELECT k, vec_id, CAST(label AS BIGINT) AS label, area AS area_px, x0, y0 FROM k JOIN t USING (k)""")
def label_audit_picks(spark, sf_dir):
    """Twenty regions at evenly spaced ranks of area, for review."""
    found = labelled_tiles(_mask(spark, sf_dir), "vec_id", N)
    r = found.groupBy("vec_id", "label").agg(F.sum(F.col("hi") - F.col("lo")).alias("area_px"), F.min("lo").alias("x0"), F.min("y").alias("y0"), F.lit(1).alias("one"))
    k = M.ranked_by(staged(r, "regions"), ["one"], F.struct("area_px", F.floor(F.col("vec_id") / 4096)), "vec_id", "label").withColumn("k", F.col("place") - 1)
    wanted = F.array(*(F.floor(i * (F.col("size") - 1) / 19.0) for i in range(20)))
    return k.where(F.array_contains(wanted, F.col("k"))).select("k", "vec_id", "label", "area_px", "x0", "y0")


@query("scale_comparison", LISTED + """, b AS (SELECT vec_id, y // 2 AS by, x // 2 AS bx, avg(v) AS mean FROM pix GROUP BY ALL), o AS (SELECT l.vec_id, l.label, count(*) AS area, count(*) FILTER (b.mean >= 0.05) AS hit FROM lab l JOIN m USING (vec_id, p) JOIN b ON b.vec_id = l.vec_id AND b.by = m.y // 2 AND b.bx = m.x // 2 GROUP BY ALL)
SELECT CASE WHEN area < 2 THEN '1' WHEN area < 4 THEN '2-3' WHEN area < 8 THEN '4-7' ELSE '8+' END AS size_bin, count(*) AS objects, count(*) FILTER (hit > 0) AS found, round(avg(hit / area), 6) AS mean_covered, round(count(*) FILTER (hit > 0) / count(*), 6) AS recall FROM o GROUP BY 1""")
def scale_comparison(spark, sf_dir):
    """Objects against a mask at half the resolution, by size of the object: how many it still shows, and how much of them."""
    runs = labelled_tiles(_mask(spark, sf_dir), "vec_id", N)
    truth = runs.select("vec_id", "label", "y", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("x"))
    half = raster.block_mean(raster.pixels(_tiles(spark, sf_dir), N, "vec_id"), 2, "vec_id")
    at = lambda c: F.floor(F.col(c) / 2).cast("int")
    o = truth.withColumn("by", at("y")).withColumn("bx", at("x")).join(half, ["vec_id", "by", "bx"]).groupBy("vec_id", "label").agg(F.count("*").alias("area"), F.count_if(F.col("mean") >= 0.05).alias("hit"))
    size = F.when(F.col("area") < 2, "1").when(F.col("area") < 4, "2-3").when(F.col("area") < 8, "4-7").otherwise("8+")
    found = F.count_if(F.col("hit") > 0)
    return o.groupBy(size.alias("size_bin")).agg(F.count("*").alias("objects"), found.alias("found"), F.round(F.avg(F.col("hit") / F.col("area")), 6).alias("mean_covered"), F.round(found / F.count("*"), 6).alias("recall"))


@query("frozen_evaluation", LISTED + ", " + FUSED + """, c AS (SELECT count(*) FILTER (f.fused >= 0.06 AND p.v >= 0.05) AS tp, count(*) FILTER (f.fused >= 0.06 AND p.v < 0.05) AS fp, count(*) FILTER (f.fused < 0.06 AND p.v >= 0.05) AS fn, count(*) FILTER (f.fused < 0.06 AND p.v < 0.05) AS tn FROM fused f JOIN pix p USING (vec_id, y, x)),
o AS (SELECT l.vec_id, l.label, count(*) FILTER (f.fused >= 0.06) / count(*) AS covered FROM lab l JOIN m USING (vec_id, p) JOIN fused f ON f.vec_id = l.vec_id AND f.y = m.y AND f.x = m.x GROUP BY ALL)
SELECT tp, fp, fn, tn, round(tp / (tp + fp + fn), 6) AS iou, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS prec, round(tp / (tp + fn), 6) AS rec, (SELECT count(*) FROM o) AS objects, (SELECT count(*) FILTER (covered >= 0.5) FROM o) AS objects_found FROM c""")
def frozen_evaluation(spark, sf_dir):
    """One fixed evaluation: windows fused to scores, scores to a mask at a fixed threshold, counts and objects against the truth."""
    fused = staged(tile_fusion(spark, sf_dir).select("vec_id", "y", "x", "fused"), "fused")
    p = raster.pixels(_tiles(spark, sf_dir), N, "vec_id")
    hit, true = F.col("fused") >= 0.06, F.col("v") >= 0.05
    c = fused.join(p, ["vec_id", "y", "x"]).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    runs = labelled_tiles(_mask(spark, sf_dir), "vec_id", N)
    pixels = runs.select("vec_id", "label", "y", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("x"))
    o = pixels.join(fused, ["vec_id", "y", "x"]).groupBy("vec_id", "label").agg((F.count_if(hit) / F.count("*")).alias("covered"))
    objects = o.agg(F.count("*").alias("objects"), F.count_if(F.col("covered") >= 0.5).alias("objects_found"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scores = c.withColumns({"iou": F.round(tp / (tp + fp + fn), 6), "f1": F.round(2 * tp / (2 * tp + fp + fn), 6), "prec": F.round(tp / (tp + fp), 6), "rec": F.round(tp / (tp + fn), 6)})
    return scores.join(objects)  # one row each


@query("snapshot_changes", """WITH b AS (SELECT doc_id, md5(text) AS h FROM documents), a AS (SELECT doc_id, md5(lower(text)) AS h FROM documents WHERE length(text) >= 100)
SELECT CASE WHEN a.doc_id IS NULL THEN 'removed' WHEN b.doc_id IS NULL THEN 'added' WHEN a.h = b.h THEN 'same' ELSE 'altered' END AS change, count(*) AS inputs FROM b FULL JOIN a USING (doc_id) GROUP BY 1""")
def snapshot_changes(spark, sf_dir):
    """Hashes of all inputs before a run against those after it; here the run has lower-cased texts and dropped short ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    before, after = M.snapshot(d, "doc_id", "text"), M.snapshot(d.where(F.length("text") >= 100).withColumn("text", F.lower("text")), "doc_id", "text")
    return M.changes(before, after, "doc_id").groupBy("change").agg(F.count("*").alias("inputs"))


@query("config_defaults", """WITH c AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.window') AS BIGINT) AS w, json_extract_string(props, '$.shape') AS shape FROM events), f AS (SELECT event_id, coalesce(w, k, 3) AS width, coalesce(shape, 'gentle') AS shape FROM c)
SELECT event_id, width, shape, CASE WHEN NOT (width BETWEEN 1 AND 50) THEN 'width' ELSE '' END || CASE WHEN shape NOT IN ('gentle', 'irregular', 'rectangular') THEN 'shape' ELSE '' END AS violations FROM f""")
def config_defaults(spark, sf_dir):
    """Settings in JSON: nulls by the older field of another name, else by a default; then names and ranges checked."""
    c = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long, window long, shape string").alias("c")).select("event_id", "c.k", F.col("c.window").alias("width"), "c.shape")
    c = M.with_defaults(c, {"width": 3, "shape": "gentle"}, {"width": "k"})
    rules = {"width": F.col("width").between(1, 50), "shape": F.col("shape").isin("gentle", "irregular", "rectangular")}
    return c.select("event_id", F.col("width").cast("long").alias("width"), "shape", F.array_join(M.violations(rules), "").alias("violations"))


@query("axes_rotation", """SELECT p_partkey, round(p_size * cos(radians(p_retailprice)) + (p_partkey % 50 + 0.25) * sin(radians(p_retailprice)), 6) AS along_m, round(-p_size * sin(radians(p_retailprice)) + (p_partkey % 50 + 0.25) * cos(radians(p_retailprice)), 6) AS across_m FROM part""")
def axes_rotation(spark, sf_dir):
    """East and north to the axes of a panel at a bearing (here three columns of parts)."""
    along, across = metrics.rotated_axes(F.col("p_size"), F.col("p_partkey") % 50 + 0.25, F.radians("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(along, 6).alias("along_m"), F.round(across, 6).alias("across_m"))


@query("score_adapters", """SELECT event_id, round(1 / (1 + exp(-(value - 100) / 50)), 6) AS score, round(ln((value + 1) / (1001 - least(value, 1000))), 6) AS logit FROM events""")
def score_adapters(spark, sf_dir):
    """Model outputs to scores and back."""
    return table(spark, sf_dir, "events").select("event_id", F.round(metrics.sigmoid((F.col("value") - 100) / 50), 6).alias("score"), F.round(F.log((F.col("value") + 1) / (1001 - F.least(F.col("value"), F.lit(1000.0)))), 6).alias("logit"))


@query("thickness_scaling", """SELECT p_partkey, round(least(8, greatest(0.1, p_size * 0.2 * 5 / greatest(p_retailprice / 300, 1e-6))), 6) AS thickness_m, round(p_retailprice / 300 * least(8, greatest(0.1, p_size * 0.2 * 5 / greatest(p_retailprice / 300, 1e-6))) / (p_size * 0.2), 6) AS cycles FROM part""")
def thickness_scaling(spark, sf_dir):
    """Thickness scaled so that a scene shows five cycles, kept within 0.1 to 8; and the cycles that it then has."""
    thick, cycles = F.col("p_size") * 0.2, F.col("p_retailprice") / 300
    new = metrics.scaled_thickness(thick, cycles, 5.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(new, 6).alias("thickness_m"), F.round(cycles * new / thick, 6).alias("cycles"))


@query("status_counters", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counters FROM c GROUP BY user_id""")
def status_counters(spark, sf_dir):
    """A counter for each user: a map from kind to number, here written out in order."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    counter = c.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("m"))  # one entry a kind
    return counter.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("counters"))


@query("regenerated_revisions", """WITH l AS (SELECT user_id, count(*) AS revision, arg_max(event_type, event_id) AS status, max(event_id) AS at FROM events GROUP BY user_id)
SELECT user_id, revision, CASE WHEN status = 'purchase' THEN 'accepted' WHEN status = 'error' THEN 'rejected' ELSE 'pending' END AS status FROM l UNION ALL SELECT user_id, revision + 1, 'pending' FROM l WHERE status = 'error'""")
def regenerated_revisions(spark, sf_dir):
    """The current revision of each sample, and a new one, to be reviewed, of each that was rejected."""
    last = M.latest_state(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    status = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").otherwise("pending")
    now = last.select("user_id", "revision", status.alias("status"))
    return now.unionByName(now.where("status = 'rejected'").select("user_id", (F.col("revision") + 1).alias("revision"), F.lit("pending").alias("status")))


@query("percent_text", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN '-' ELSE printf('%.1f', o_totalprice / 2000) || ' %' END AS percent FROM orders""")
def percent_text(spark, sf_dir):
    """Shares as text with one decimal; a missing one is a dash."""
    share = F.when(F.col("o_totalprice") <= 200000, F.col("o_totalprice") / 2000)
    # the pattern rounds the double as it is, ties to even, as printf does; %.1f rounds its shortest decimal up
    text = F.when(share.isNull(), "-").otherwise(F.concat(F.call_function("format_number", share, F.lit("0.0")), F.lit(" %")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("percent"))


@query("split_reader", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'draft' ELSE 'rejected' END AS status FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""")
def split_reader(spark, sf_dir):
    """Samples of one split; drafts and rejected ones only on request."""
    from gridloom.sources.files import load_dataset

    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "draft").otherwise("rejected")
    samples = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("split"), status.alias("status"))
    return load_dataset(samples, "1-URGENT").select("o_orderkey", "status")


@query("csv_manifest", """SELECT CAST(o_orderkey AS VARCHAR) AS scene_id, o_orderpriority AS split, o_orderstatus AS category FROM orders""")
def csv_manifest(spark, sf_dir):
    """A manifest written as CSV in the shared folder and read back by its schema."""
    from gridloom.sources.files import read_manifest, write_manifest

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("scene_id"), F.col("o_custkey").cast("string").alias("group_id"), F.col("o_orderpriority").alias("split"), F.col("o_orderstatus").alias("category"))
    return read_manifest(spark, write_manifest(o)).select("scene_id", "split", "category")


@query("saved_scenes", """SELECT l_orderkey AS scene_id, l_linenumber AS band, l_extendedprice AS value, l_returnflag AS split FROM lineitem""")
def saved_scenes(spark, sf_dir):
    """Records saved by split (an existing target is an error) and read back."""
    import uuid

    from gridloom.session import shared_folder
    from gridloom.sources.files import save_scenes

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("band"), F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("split"))
    path = f"{shared_folder(spark)}/gridloom-scenes-{uuid.uuid4().hex}"
    save_scenes(rows, path)
    return spark.read.parquet(path).select("scene_id", "band", "value", "split")


@query("config_rows", """SELECT p_partkey, p_name AS name, p_size AS size, p_retailprice AS extent FROM part""")
def config_rows(spark, sf_dir):
    """Settings written as one JSON document a scene and read back."""
    from gridloom.sources.files import write_configs

    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("extent"))
    return spark.read.schema(p.schema).json(write_configs(p))


@query("dataset_export", """SELECT l_returnflag AS split, l_linestatus AS category, count(*) AS scenes FROM lineitem GROUP BY ALL""")
def dataset_export(spark, sf_dir):
    """A dataset saved by split with its record of splits and categories."""
    import uuid

    from gridloom.session import shared_folder
    from gridloom.sources.files import export_dataset

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("category"))
    return export_dataset(rows, f"{shared_folder(spark)}/gridloom-export-{uuid.uuid4().hex}")


# Where the colours of magnitudes stand, and the colours there.
PLACES = (0, 0.3, 0.65, 1)
COLOURS = ((14, 24, 42), (18, 83, 114), (34, 180, 168), (253, 219, 143))


def _between(channel: int) -> str:
    y = [c[channel] for c in COLOURS]
    parts = " ".join(f"WHEN t <= {b} THEN {p}::DOUBLE + {q - p}::DOUBLE * (t - {a}) / {b - a}" for a, b, p, q in zip(PLACES, PLACES[1:], y, y[1:]))
    return f"CAST(floor(CASE {parts} END) AS INTEGER)"


@query("magnitude_colours", f"""WITH {PIX}, m AS (SELECT vec_id, greatest(max(v), 1e-12) AS top FROM pix GROUP BY vec_id), s AS (SELECT vec_id, y, x, round(least(1, greatest(0, v / top)), 4)::DOUBLE AS t FROM pix JOIN m USING (vec_id))
SELECT vec_id, y, x, {_between(0)} AS r, {_between(1)} AS g, {_between(2)} AS b FROM s""")
def magnitude_colours(spark, sf_dir):
    """Values as shares of the tile's maximum, coloured between fixed places."""
    top = F.greatest(F.array_max("data"), F.lit(1e-12))
    t = _tiles(spark, sf_dir).select("vec_id", F.transform("data", lambda v: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / top)), 4)).alias("data"))
    p = raster.pixels(t, N, "vec_id")
    channel = lambda k: F.floor(mathx.piecewise(F.col("v"), [(a, c[k]) for a, c in zip(PLACES, COLOURS)])).cast("int")
    return p.select("vec_id", "y", "x", channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))
