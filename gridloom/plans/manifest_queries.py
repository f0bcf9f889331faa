"""Manifests, sampling plans, audits and review state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions.mathx import uniform
from gridloom.operators import manifests as M
from gridloom.plans.catalog import query
from gridloom.plans.field_queries import rng
from gridloom.sources.tables import table


@query("stratified_split", f"""WITH d AS (SELECT o_orderkey, o_orderpriority AS c, {rng(5, 'split', 'o_orderkey')} AS u FROM orders), n AS (SELECT c, count(*) AS n, floor(count(*) * 0.1::DOUBLE) AS base, count(*) * 0.1::DOUBLE - floor(count(*) * 0.1::DOUBLE) AS rest FROM d GROUP BY c),
q AS (SELECT c, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, c) <= (SELECT round(sum(n) * 0.1::DOUBLE) - sum(base) FROM n) THEN 1 ELSE 0 END AS quota FROM n),
r AS (SELECT o_orderkey, c, row_number() OVER (PARTITION BY c ORDER BY u, o_orderkey) AS k FROM d)
SELECT o_orderkey, c AS category, CASE WHEN k <= quota THEN 'test' WHEN k <= 2 * quota THEN 'validation' ELSE 'train' END AS split FROM r JOIN q USING (c)""")
def stratified_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("category"))
    return M.stratified_split(o, "category", "o_orderkey", uniform(5, "split", "o_orderkey"))


@query("category_split", f"""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {rng(6, 'hold', 'doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, CASE WHEN k <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'holdout' ELSE 'train' END AS split, count(*) AS scenes FROM d GROUP BY ALL""")
def category_split(spark, sf_dir):
    """Hold out a tenth (at least one) of each category; counts by split."""
    d = M.ranked(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", uniform(6, "hold", "doc_id"))
    split = F.when(F.col("place") <= F.greatest(F.lit(1.0), F.bround(F.col("size") * 0.1, 0)), "holdout").otherwise("train")
    return d.groupBy("source", split.alias("split")).agg(F.count("*").alias("scenes"))


@query("split_leakage", "SELECT md5(text) AS group_id, count(*) AS scenes, count(DISTINCT lang || ':' || source) AS splits FROM documents GROUP BY md5(text) HAVING count(DISTINCT lang || ':' || source) > 1")
def split_leakage(spark, sf_dir):
    """Groups (equal texts) that occur in several splits."""
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("group_id"), F.concat_ws(":", "lang", "source").alias("split"))
    return d.groupBy("group_id").agg(F.count("*").alias("scenes"), F.countDistinct("split").alias("splits")).where("splits > 1")


@query("canonical_fingerprint", """SELECT c_custkey, sha256('{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || CAST(c_nationkey AS VARCHAR) || '}') AS request_sha256, sha256('{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || CAST(c_nationkey AS VARCHAR) || '}') AS group_id FROM customer""")
def canonical_fingerprint(spark, sf_dir):
    """Hashes of canonical JSON: of all fields, and of those that define the group."""
    return table(spark, sf_dir, "customer").select("c_custkey", M.fingerprint("c_name", "c_custkey", "c_nationkey", "c_mktsegment").alias("request_sha256"), M.fingerprint("c_nationkey", "c_mktsegment").alias("group_id"))


@query("duplicate_groups", "WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS scenes, count(*) FILTER (n > 1) AS repeated FROM g")
def duplicate_groups(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("scenes"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("manifest_join_mismatch", """WITH m AS (SELECT o_orderkey, o_orderstatus FROM orders), r AS (SELECT l_orderkey, max(l_linestatus) AS status, count(*) AS files FROM lineitem GROUP BY 1)
SELECT 'status' AS problem, count(*) AS scenes FROM m JOIN r ON l_orderkey = o_orderkey WHERE status IS DISTINCT FROM o_orderstatus UNION ALL SELECT 'no_metadata', count(*) FROM m WHERE o_orderkey NOT IN (SELECT l_orderkey FROM r) UNION ALL SELECT 'no_manifest', count(*) FROM r WHERE l_orderkey NOT IN (SELECT o_orderkey FROM m)""")
def manifest_join_mismatch(spark, sf_dir):
    """Manifest rows against their records: fields that disagree, and rows without a partner."""
    m = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("status"))
    both = m.join(r, "o_orderkey", "full_outer")
    problem = F.when(F.col("status").isNull(), "no_metadata").when(F.col("o_orderstatus").isNull(), "no_manifest").when(F.col("status") != F.col("o_orderstatus"), "status")
    kinds = F.array(*map(F.lit, ("status", "no_metadata", "no_manifest")))
    counts = both.groupBy(problem.alias("problem")).agg(F.count("*").alias("scenes")).where("problem IS NOT NULL")
    return spark.range(1).select(F.explode(kinds).alias("problem")).join(counts, "problem", "left").select("problem", F.coalesce("scenes", F.lit(0)).cast("long").alias("scenes"))


def _fresh_sql(rounds: int = 4) -> str:
    """Rounds of drawing as the operator has them; still open after the last: an error, not a lost row."""
    draw = f"CAST(floor({rng(8, 'seed', "o_orderkey || ':' || t")} * 4294967296) AS BIGINT)"
    parts = ["used AS (SELECT DISTINCT user_id AS seed FROM events WHERE event_type = 'purchase')", f"d0 AS (SELECT o_orderkey, t, {draw} AS seed FROM (SELECT o_orderkey, CAST(0 AS BIGINT) AS t FROM orders))"]
    for k in range(rounds):
        parts.append(f"o{k} AS (SELECT *, seed IN (SELECT seed FROM used) OR row_number() OVER (PARTITION BY seed ORDER BY o_orderkey) > 1 AS again FROM d{k})")
        parts.append(f"d{k + 1} AS (SELECT o_orderkey, t, CASE WHEN again THEN {draw} ELSE seed END AS seed FROM (SELECT o_orderkey, again, seed, t + CASE WHEN again THEN 1 ELSE 0 END AS t FROM o{k}))")
    return f"WITH {', '.join(parts)} SELECT o_orderkey, CASE WHEN again THEN error('open') ELSE t END AS tries, seed FROM o{rounds - 1}"


@query("fresh_seeds", _fresh_sql())
def fresh_seeds(spark, sf_dir):
    """A 32-bit seed for every order that is no used seed and no other order's; drawn until fresh."""
    used = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("seed"))
    return M.fresh_draws(table(spark, sf_dir, "orders").select("o_orderkey"), used, "o_orderkey", 8, "seed")


@query("fresh_seed_plan")
def fresh_seed_plan(spark, sf_dir):
    """The same out of a space that is nearly used up: four seeds for three orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    used = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("seed"))
    return M.fresh_draws(orders, used, "o_orderkey", 8, "seed", orders.count() * 4 // 3 + used.distinct().count())


@query("plan_resume", """WITH done AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM done), p AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders)
SELECT (SELECT count(*) FROM p) AS planned, (SELECT count(*) FROM done) AS recorded, (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM done)) AS pending, coalesce((SELECT min(p.k) - 1 FROM p WHERE id NOT IN (SELECT id FROM done)), (SELECT count(*) FROM p)) AS contiguous_prefix""")
def plan_resume(spark, sf_dir):
    """A plan against its records: what is pending, and how long the completed prefix is."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("done"))
    return M.resume_state(o)


@query("template_cycle", """WITH t AS (SELECT p_partkey, p_type, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS k, count(*) OVER () AS n FROM part), i AS (SELECT t.*, unnest(generate_series(k, 2 * n + n // 2 - 1, n)) AS i FROM t)
SELECT CAST(i AS BIGINT) AS idx, 'B' || lpad(CAST(i AS VARCHAR), 8, '0') AS sample_id, p_partkey AS template_id, p_type AS kind, least(50, greatest(1, p_size + i % 7 - 3)) AS size FROM i""")
def template_cycle(spark, sf_dir):
    """All templates taken in turn, two and a half times, and jittered within bounds."""
    t = M.ranked_by(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", F.lit(0).alias("one")), ["one"], F.floor(F.col("p_partkey") / 4096), "p_partkey")
    k, n, i = F.col("place") - 1, F.col("size"), F.col("i")
    last = 2 * n + F.floor(n / 2) - 1
    rows = t.withColumn("i", F.explode(F.when(last >= k, F.sequence(k, last, n))))
    return rows.select(i.alias("idx"), F.concat(F.lit("B"), F.lpad(i.cast("string"), 8, "0")).alias("sample_id"), F.col("p_partkey").alias("template_id"), F.col("p_type").alias("kind"), F.least(F.lit(50).cast("long"), F.greatest(F.lit(1).cast("long"), F.col("p_size") + i % 7 - 3)).alias("size"))


@query("date_overlap", """WITH d AS (SELECT o_custkey, list_distinct(flatten(list(regexp_extract_all('pair_' || strftime(o_orderdate, '%Y%m%d') || '_' || strftime(o_orderdate + INTERVAL 12 DAY, '%Y%m%d'), '[0-9]{8}')))) AS dates FROM orders GROUP BY o_custkey)
SELECT a.o_custkey, len(a.dates) AS dates, len(list_intersect(a.dates, b.dates)) > 0 AS shares_with_next FROM d a JOIN d b ON b.o_custkey = a.o_custkey + 1""")
def date_overlap(spark, sf_dir):
    """Dates read from names; whether the next set shares any."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    name = F.concat(F.lit("pair_"), day(F.col("o_orderdate")), F.lit("_"), day(F.date_add("o_orderdate", 12)))
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(name, F.lit("([0-9]{8})"))))).alias("dates"))
    b = d.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("dates").alias("others"))
    return d.join(b, "o_custkey").select("o_custkey", F.size("dates").cast("long").alias("dates"), F.arrays_overlap("dates", "others").alias("shares_with_next"))


@query("latest_review_state", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS revision FROM events) SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status, revision FROM e WHERE k = 1")
def latest_review_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    s = M.latest_state(e, "user_id", "ts", "event_id", "event_type")
    status = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").otherwise("pending")
    return s.select("user_id", "event_id", status.alias("status"), "revision")


@query("review_receipts", "WITH r AS (SELECT user_id, arg_max(md5(props), event_id) FILTER (event_type = 'purchase') AS receipt, arg_max(md5(props), event_id) AS current FROM events GROUP BY user_id) SELECT count(*) AS samples, count(receipt) AS accepted, count(*) FILTER (receipt = current) AS unchanged, count(*) FILTER (receipt <> current) AS stale FROM r")
def review_receipts(spark, sf_dir):
    """Receipts of accepted samples against the current content."""
    h = F.md5("props")
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.when(F.col("event_type") == "purchase", h), F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("receipt"), F.max_by(h, "event_id").alias("current"))
    return r.agg(F.count("*").alias("samples"), F.count("receipt").alias("accepted"), F.count_if(F.col("receipt") == F.col("current")).alias("unchanged"), F.count_if(F.col("receipt") != F.col("current")).alias("stale"))


@query("template_gate", """WITH r AS (SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(md5(props), event_id) AS current, arg_max(md5(props), event_id) FILTER (event_type = 'purchase') AS receipt, arg_max(md5(event_type || ':' || CAST(value AS VARCHAR)), event_id) FILTER (event_type = 'purchase') AS label_receipt, arg_max(md5(event_type || ':' || CAST(value AS VARCHAR)), event_id) AS label FROM events GROUP BY user_id)
SELECT count(*) AS templates, count(*) FILTER (status = 'purchase') AS accepted, count(*) FILTER (status = 'purchase' AND receipt = current AND label_receipt = label) AS unchanged, count(DISTINCT current) FILTER (status = 'purchase') AS groups, count(*) FILTER (status = 'purchase' AND receipt = current AND label_receipt = label) = 20 AND count(DISTINCT current) FILTER (status = 'purchase') = 20 AS gate FROM r""")
def template_gate(spark, sf_dir):
    """Templates whose last state is accepted and whose content and label are those of the receipt; the gate wants twenty of twenty groups."""
    accepted, last = F.col("event_type") == "purchase", lambda c: F.max_by(c, "event_id")
    receipt = lambda c: F.max_by(F.when(accepted, c), F.when(accepted, F.col("event_id")))
    content, label = F.md5("props"), F.md5(F.concat_ws(":", "event_type", F.col("value").cast("string")))
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(last(F.col("event_type")).alias("status"), last(content).alias("current"), receipt(content).alias("receipt"), last(label).alias("label"), receipt(label).alias("label_receipt"))
    ok = F.col("status") == "purchase"
    same = ok & (F.col("receipt") == F.col("current")) & (F.col("label_receipt") == F.col("label"))
    out = r.agg(F.count("*").alias("templates"), F.count_if(ok).alias("accepted"), F.count_if(same).alias("unchanged"), F.countDistinct(F.when(ok, F.col("current"))).alias("groups"))
    return out.withColumn("gate", (F.col("unchanged") == 20) & (F.col("groups") == 20))


@query("first_per_category", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT source, doc_id, k FROM r WHERE k <= 3")
def first_per_category(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", k.alias("k")).where("k <= 3").withColumn("k", F.col("k").cast("long"))


@query("quantile_picks", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents), t AS (SELECT DISTINCT lang, CAST(floor(i * (n - 1) / 4.0) AS BIGINT) AS k FROM r, generate_series(0, 4) AS g(i)) SELECT lang, doc_id, k FROM r JOIN t USING (lang, k)")
def quantile_picks(spark, sf_dir):
    """Rows at evenly spaced ranks."""
    r = M.ranked_by(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], F.struct("n_chars", F.floor(F.col("doc_id") / 4096)), "doc_id").withColumn("k", F.col("place") - 1)
    wanted = F.array(*(F.floor(i * (F.col("size") - 1) / 4.0) for i in range(5)))
    return r.where(F.array_contains(wanted, F.col("k"))).select("lang", "doc_id", "k")


@query("gallery_page", "WITH f AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS k FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') SELECT o_orderkey, k % 20 AS place FROM f WHERE k // 20 = 2")
def gallery_page(spark, sf_dir):
    """The third page of twenty after several filters; only the rows up to its end are sorted."""
    f = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
    top = f.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(60)
    return top.select("o_orderkey", (F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1).cast("long").alias("k")).where("k >= 40").select("o_orderkey", (F.col("k") % 20).alias("place"))


@query("window_overlap", "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND CAST(a.l_partkey AS BIGINT) < CAST(b.l_partkey + b.l_quantity * 4 AS BIGINT) AND CAST(b.l_partkey AS BIGINT) < CAST(a.l_partkey + a.l_quantity * 4 AS BIGINT)")
def window_overlap(spark, sf_dir):
    """Intervals of one order that overlap, by blocks instead of a comparison of all pairs."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("lo"), (F.col("l_partkey") + F.col("l_quantity") * 4).cast("long").alias("hi"))
    r = l.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return M.overlapping(l, r, 128, "l_orderkey").where("l_linenumber < other").select("l_orderkey", "l_linenumber", "other")


@query("marker_scan", "SELECT page_id, regexp_matches(html, '(?i)track\\(|ad [0-9]+') AS marked, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages")
def marker_scan(spark, sf_dir):
    """Forbidden markers in text files."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.col("html").rlike(r"(?i)track\(|ad [0-9]+").alias("marked"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_extract("url", "//([^/]+)", 1).alias("host"))


@query("param_violations", "SELECT p_partkey, list_sort(list_filter([CASE WHEN NOT (p_size BETWEEN 5 AND 45) THEN 'p_size' END, CASE WHEN NOT (p_retailprice <= 1800) THEN 'p_retailprice' END, CASE WHEN NOT regexp_full_match(p_name, '[\\w -]{1,40}') THEN 'p_name' END, CASE WHEN p_size > 40 AND p_retailprice < 1000 THEN 'p_size_price' END], lambda x: x IS NOT NULL))::VARCHAR AS violations FROM part")
def param_violations(spark, sf_dir):
    """Names of the rules that each row of parameters breaks."""
    rules = {"p_size": F.col("p_size").between(5, 45), "p_retailprice": F.col("p_retailprice") <= 1800, "p_name": F.col("p_name").rlike(r"^[\w -]{1,40}$"), "p_size_price": (F.col("p_size") <= 40) | (F.col("p_retailprice") >= 1000)}
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(M.violations(rules), ", "), F.lit("]")).alias("violations"))


@query("unknown_fields", """SELECT event_id, len(list_filter(json_keys(props), lambda k: k NOT IN ('ref', 'page'))) AS unknown, len(json_keys(props)) AS fields FROM events""")
def unknown_fields(spark, sf_dir):
    """Keys of a JSON record that the schema does not know."""
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.size(F.array_except(keys, F.array(F.lit("ref"), F.lit("page")))).cast("long").alias("unknown"), F.size(keys).cast("long").alias("fields"))


@query("counts_by_key", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS with_water FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def counts_by_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("with_water"))


@query("paired_rows", """WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT coalesce(a.place, b.place) AS place, coalesce(a.o_orderkey, -1) AS baseline, coalesce(b.o_orderkey, -1) AS matched FROM (SELECT * FROM o WHERE o_orderstatus = 'O') a FULL JOIN (SELECT * FROM o WHERE o_orderstatus = 'F') b USING (place)""")
def paired_rows(spark, sf_dir):
    """Two whole exports paired by position; the partner of a row that the shorter one lacks is -1."""
    o = M.ranked_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], F.floor(F.col("o_orderkey") / 4096), "o_orderkey")
    side = lambda s, name: o.where(F.col("o_orderstatus") == s).select((F.col("place") - 1).alias("place"), F.col("o_orderkey").alias(name))
    return side("O", "baseline").join(side("F", "matched"), "place", "full_outer").na.fill(-1, ["baseline", "matched"])


@query("run_consistency", "SELECT count(DISTINCT o_orderstatus) AS n_o_orderstatus, count(DISTINCT year(o_orderdate) > 1900) AS n_era, count(DISTINCT o_orderstatus) = 1 AND count(DISTINCT year(o_orderdate) > 1900) = 1 AS consistent FROM orders")
def run_consistency(spark, sf_dir):
    return M.same_everywhere(table(spark, sf_dir, "orders").select("o_orderstatus", (F.year("o_orderdate") > 1900).alias("era")), "o_orderstatus", "era")


@query("weighted_draws", f"""WITH s AS (SELECT n_nationkey, 1 + n_regionkey AS w FROM nation), c AS (SELECT n_nationkey, sum(w) OVER (ORDER BY n_nationkey) AS hi, sum(w) OVER () AS total, w FROM s), d AS (SELECT CAST(i AS BIGINT) AS draw, {rng(12, 'weighted', 'i')} AS u FROM generate_series(0, 1999) AS g(i))
SELECT draw, n_nationkey FROM d JOIN c ON u * total >= hi - w AND u * total < hi""")
def weighted_draws(spark, sf_dir):
    """Draws with replacement, by weight: one lookup in the cumulative weights a draw."""
    c = table(spark, sf_dir, "nation").select("n_nationkey", (1 + F.col("n_regionkey")).alias("w"))
    d = spark.range(2000).select(F.col("id").alias("draw"), uniform(12, "weighted", "id").alias("u"))
    return M.weighted_picks(c, d, "n_nationkey", "w").select("draw", "n_nationkey")


@query("set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'only_customers', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)")
def set_operations(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "customer")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return one(o.intersect(c.where("c_acctbal > 0").select("c_custkey")), "both").unionByName(one(c.select("c_custkey").exceptAll(o).distinct().join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "only_customers")).unionByName(one(o.union(c.select("c_custkey")).distinct(), "either"))


@query("units_by_name", "SELECT n_name, CASE WHEN n_name LIKE '%A' THEN 'm' WHEN n_name LIKE '%N' THEN 'rad' WHEN n_name LIKE '%Y' THEN 'mask' ELSE '1' END AS unit, regexp_replace(lower(n_name), '[^a-z]+', '_', 'g') || '.npz' AS path FROM nation")
def units_by_name(spark, sf_dir):
    n = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_name", F.when(n.endswith("A"), "m").when(n.endswith("N"), "rad").when(n.endswith("Y"), "mask").otherwise("1").alias("unit"), F.concat(F.regexp_replace(F.lower(n), "[^a-z]+", "_"), F.lit(".npz")).alias("path"))


@query("event_sessions", """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""")
def event_sessions(spark, sf_dir):
    """Sessions with gaps of at most 30 minutes; the streaming module has the same over a stream."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"), "event_id", "value")
    us = F.unix_micros("t")
    e = e.withColumn("start", F.coalesce((us - F.lag(us).over(order) > 1_800_000_000).cast("int"), F.lit(1)))
    s = e.withColumn("sid", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "sid").agg(F.unix_seconds(F.min("t")).alias("started"), F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).drop("sid")


@query("gallery_filtered", """WITH f AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS k FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' AND o_custkey % 2 = 0 AND NOT o_totalprice > 300000)
SELECT o_orderkey, k % 20 AS place FROM f WHERE k // 20 = 1""")
def gallery_filtered(spark, sf_dir):
    """A page of twenty after the gallery's four filters: case, split, with or without water, with or without warnings."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("case"), F.col("o_orderstatus").alias("split"), (F.col("o_custkey") % 2 == 0).alias("water"), (F.col("o_totalprice") > 300000).alias("warnings"))
    page = M.gallery(rows, 1, [F.desc("o_orderdate"), F.col("o_orderkey")], case="2-HIGH", split="F", water=True, warnings=False)
    return page.select("o_orderkey", "place")


@query("name_dates", """WITH n AS (SELECT o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'single_' || strftime(o_orderdate, '%Y%m%d') WHEN o_orderkey % 10 = 1 THEN 'three_20200101_20200102_' || strftime(o_orderdate, '%Y%m%d') ELSE 'pair_' || strftime(o_orderdate, '%Y%m%d') || '_' || strftime(o_orderdate + INTERVAL 12 DAY, '%Y%m%d') END AS name FROM orders),
d AS (SELECT o_custkey, regexp_extract_all(name, '[0-9]{8}') AS dates FROM n), e AS (SELECT o_custkey, len(dates) = 2 AS two, dates FROM d),
u AS (SELECT o_custkey, count(DISTINCT t) AS days FROM (SELECT o_custkey, unnest(dates) AS t FROM e WHERE two) GROUP BY o_custkey)
SELECT e.o_custkey, count(*) AS names, count(*) FILTER (NOT two) AS broken, coalesce(any_value(days), 0) AS dates FROM e LEFT JOIN u ON u.o_custkey = e.o_custkey GROUP BY e.o_custkey""")
def name_dates(spark, sf_dir):
    """Names that have to hold exactly two dates: how many break the rule, and the dates of the others."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    pair = F.concat(F.lit("pair_"), day(F.col("o_orderdate")), F.lit("_"), day(F.date_add("o_orderdate", 12)))
    name = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("single_"), day(F.col("o_orderdate")))).when(F.col("o_orderkey") % 10 == 1, F.concat(F.lit("three_20200101_20200102_"), day(F.col("o_orderdate")))).otherwise(pair)
    rows = table(spark, sf_dir, "orders").select("o_custkey", M.two_dates(name).alias("dates"))
    whole = rows.groupBy("o_custkey").agg(F.count("*").alias("names"), F.count_if(F.col("dates").isNull()).alias("broken"))
    days = rows.select("o_custkey", F.explode("dates").alias("day")).groupBy("o_custkey").agg(F.countDistinct("day").alias("dates"))
    return whole.join(days, "o_custkey", "left").select("o_custkey", "names", "broken", F.coalesce("dates", F.lit(0)).cast("long").alias("dates"))


@query("review_summary", """WITH r AS (SELECT l_orderkey, max(l_linestatus) AS review, count(*) AS parts FROM lineitem GROUP BY l_orderkey)
SELECT o_orderstatus AS split, c_mktsegment AS kind, review, count(*) AS samples, CAST(sum(parts) AS BIGINT) AS parts, count(*) FILTER (parts > 4) AS large FROM orders JOIN r ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def review_summary(spark, sf_dir):
    """Manifest entries with their reviews and metadata, three tables joined: samples by split, kind and review."""
    reviews = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("review"), F.count("*").alias("parts"))
    kinds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("kind"))
    met = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("split")).join(reviews, "o_orderkey").join(kinds, "o_custkey")
    return met.groupBy("split", "kind", "review").agg(F.count("*").alias("samples"), F.sum("parts").alias("parts"), F.count_if(F.col("parts") > 4).alias("large"))
