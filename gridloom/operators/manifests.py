"""Manifests as tables: splits, plans, fingerprints, joins between records, and audits of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.mathx import uniform
from gridloom.session import fewer, staged, stored, unstaged


#: Draws of a round whose seeds are broadcast to find former draws of the same seeds.
FEW = 1 << 20


def canonical(*fields: str) -> Column:
    """JSON text of the fields in alphabetical order, without blanks; nulls are written."""
    parts = [F.concat(F.lit(f'"{n}":'), F.coalesce(F.get(F.array(F.to_json(F.array(F.col(n)))), F.lit(0)), F.lit("[null]"))) for n in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.regexp_replace(p, r":\[(.*)\]$", ":$1") for p in parts)), F.lit("}"))


def fingerprint(*fields: str) -> Column:
    return F.sha2(canonical(*fields), 256)


def violations(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that a row breaks; a rule that is null counts as broken."""
    found = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(rules.items())))
    return F.filter(found, lambda n: n.isNotNull())


def strict(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, failing the job on the first row that breaks a rule."""
    v = violations(rules)
    return df.where(F.when(F.size(v) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid: "), F.array_join(v, ", "))).cast("boolean")))


def ranked_by(df: DataFrame, keys: list[str], bucket: Column, *order: Column | str) -> DataFrame:
    """df with its place among the rows of its keys, from 1, by bucket and then order, and their number as size.

    Buckets are counted, and rows ranked inside a bucket, so no window holds the rows of a key whole."""
    rows = df.withColumn("_b", bucket)
    per = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b"))
    per = per.select(*keys, "_b", (upto - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("size"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return rows.join(per, [*keys, "_b"]).withColumn("place", F.col("_before") + inside).drop("_b", "_before")


def ranked(df: DataFrame, category: str, key: str, draw: Column, buckets: int = 1024) -> DataFrame:
    """df with its place in its category by (draw, key), from 1, and the category's size. Draws lie in [0, 1)."""
    rows = df.withColumn("_d", draw)
    return ranked_by(rows, [category], F.floor(F.col("_d") * buckets).cast("int"), "_d", key).drop("_d")


def stratified_split(df: DataFrame, category: str, key: str, draw: Column, share: float = 0.1) -> DataFrame:
    """Adds split: per category the floor of its share to test and to validation, the rest of the
    overall quota to the categories of largest remainder (ties by name)."""
    cats = df.groupBy(category).agg(F.count("*").alias("_all"))
    cats = cats.withColumn("_base", F.floor(F.col("_all") * share)).withColumn("_rest", F.col("_all") * share - F.floor(F.col("_all") * share))
    whole = cats.agg((F.round(F.sum("_all") * share) - F.sum("_base")).alias("_extra"))
    turn = F.row_number().over(Window.orderBy(F.desc("_rest"), category))  # one row a category
    quota = cats.join(F.broadcast(whole)).select(category, (F.col("_base") + (turn <= F.col("_extra")).cast("long")).alias("_quota"))  # one row
    rows = ranked(df, category, key, draw).join(quota, category)
    split = F.when(F.col("place") <= F.col("_quota"), "test").when(F.col("place") <= 2 * F.col("_quota"), "validation").otherwise("train")
    return rows.withColumn("split", split).select(*df.columns, "split")


def pending(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Planned rows that no record names."""
    return plan.join(done.select(key).distinct(), key, "left_anti")


def fresh_draws(plan: DataFrame, used: DataFrame, key: str, seed: int, stream: str, space: int = 2**32) -> DataFrame:
    """plan(key) -> key, tries (draws before the one that holds, from 0), seed: for every row a seed of
    [0, space) that is not in used(seed) and that no other row has.

    Equal to drawing key after key, each until its seed is neither used nor given to a lesser key: all
    rows draw at once, a seed stays with its least key, and those without one draw again until none has to.
    Draws are kept as they are made, and the least key that ever drew a seed has it. So only the seeds drawn in a
    round are looked at in it, and of former draws only those of the same seeds are shuffled where the round is small."""
    draw = lambda t: F.floor(uniform(seed, stream, F.concat_ws(":", F.col(key).cast("string"), t.cast("string"))) * space).cast("long")
    used = used.select(F.col("seed").cast("long").alias("seed")).where(F.col("seed").between(0, space - 1)).distinct()
    new = staged(plan.select(key, F.lit(0).cast("long").alias("tries")).withColumn("seed", draw(F.col("tries"))), "draws")
    none = F.lit(None).cast(new.schema[key].dataType).alias(key)
    used = staged(used.select(none, F.lit(-1).cast("long").alias("tries"), "seed"), "used")
    count = new.count()
    if count + used.count() > space:
        raise ValueError("more rows than fresh seeds")
    large, small = [used], []
    together = lambda tables: plan.sparkSession.read.schema(new.schema).parquet(*(t.staged_at for t in tables))  # noqa: E731  one scan: small files share tasks
    while count:
        before = together([*large, *small]).withColumn("_new", F.lit(False))
        if count <= FEW:
            before = before.join(F.broadcast(new.select("seed").distinct()), "seed", "left_semi").select(key, "tries", "seed", "_new")
        turn = Window.partitionBy("seed").orderBy(F.col("tries") >= 0, key, "tries", "_new")
        met = before.union(new.withColumn("_new", F.lit(True)))
        met = met.withColumn("_turn", F.row_number().over(turn)).withColumn("_former", F.count_if(~F.col("_new")).over(turn.rowsBetween(Window.unboundedPreceding, 0)))
        # who draws again: new draws that are not first, and who had the seed till now and is not first any more
        lost = met.where((F.col("_turn") > 1) & (F.col("tries") >= 0) & (F.col("_new") | (F.col("_former") == 1)))
        again = lost.select(key, (F.col("tries") + 1).alias("tries")).withColumn("seed", draw(F.col("tries")))
        (small if count <= FEW else large).append(new)
        size = 2 * stored(new) + (stored(*large) if count > FEW else 0)
        new = staged(fewer(again, size), "draws")
        count = new.count()
        if len(small) > 24:
            old, small = small, [staged(fewer(together(small), stored(*small)), "draws")]
            unstaged(*old)
    unstaged(new)
    first = together([*large, *small]).groupBy("seed").agg(F.min(F.struct((F.col("tries") >= 0).alias("drawn"), F.col(key), "tries")).alias("_first"))
    out = staged(first.where("_first.drawn").select(F.col(f"_first.{key}").alias(key), F.col("_first.tries").alias("tries"), "seed"), "draws")
    unstaged(*large, *small)
    return out


def overlapping(a: DataFrame, b: DataFrame, width: int, *keys: str) -> DataFrame:
    """Pairs of intervals a(lo, hi) and b(lo2, hi2), half-open, that overlap, by an equi-join on the
    blocks of `width` that they touch; each pair comes once, from the first block that both touch."""
    blocks = lambda lo, hi: F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))
    left = a.where("hi > lo").withColumn("_k", F.explode(blocks("lo", "hi")))
    right = b.where("hi2 > lo2").withColumn("_k", F.explode(blocks("lo2", "hi2")))
    first = F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("lo2") / width))
    return left.join(right, [*keys, "_k"]).where((F.col("lo") < F.col("hi2")) & (F.col("lo2") < F.col("hi")) & (F.col("_k") == first)).drop("_k")


def latest_state(events: DataFrame, key: str, at: str, *fields: str) -> DataFrame:
    """The last event's fields of each key, by one aggregation."""
    last = events.groupBy(key).agg(F.max(F.struct(at, *fields)).alias("_last"), F.count("*").alias("revision"))
    return last.select(key, F.col(f"_last.{at}").alias(at), *(F.col(f"_last.{f}").alias(f) for f in fields), "revision")


def same_everywhere(df: DataFrame, *fields: str) -> DataFrame:
    """One row: number of distinct values of each field, and whether all have just one."""
    counted = df.agg(*(F.countDistinct(f).alias(f"n_{f}") for f in fields))
    return counted.withColumn("consistent", reduce(lambda a, b: a & b, (F.col(f"n_{f}") == 1 for f in fields)))


def snapshot(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """key, sha256 of the row's fields."""
    return df.select(key, fingerprint(*fields).alias("sha256"))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of two snapshots with what became of them: same, altered, removed or added."""
    both = before.withColumnRenamed("sha256", "was").join(after.withColumnRenamed("sha256", "now"), key, "full_outer")
    state = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") == F.col("now"), "same").otherwise("altered")
    return both.select(key, state.alias("change"))


def deviations(df: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """One pass over df: for each check (size of the violation, tolerance) the rows, the largest violation and how
    many are over the tolerance. A violation that is null or not a number counts as over it."""
    bad = lambda v, t: ~F.coalesce((v <= t) & ~F.isnan(v), F.lit(False))
    aggs = [x for n, (v, t) in checks.items() for x in (F.max(F.when(~F.isnan(v), v)).alias(f"{n}_max"), F.count_if(bad(v, t)).alias(f"{n}_bad"))]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    parts = F.array(*(F.struct(F.lit(n).alias("check"), F.col("rows"), F.col(f"{n}_max").cast("double").alias("largest"), F.col(f"{n}_bad").alias("failed")) for n in checks))
    return one.select(F.explode(parts).alias("c")).select("c.*")


def with_defaults(df: DataFrame, defaults: dict[str, object], legacy: dict[str, str] | None = None) -> DataFrame:
    """df with nulls of the named columns filled: from the older column that legacy names, else by the default."""
    legacy = legacy or {}
    return df.withColumns({n: F.coalesce(F.col(n), *([F.col(legacy[n])] if n in legacy else []), F.lit(v)) for n, v in defaults.items()})


def resume_state(plan: DataFrame) -> DataFrame:
    """plan(id, done) -> one row: planned, recorded, pending, and how many rows from the start on are done."""
    gap = plan.where("NOT done").agg(F.min("id").alias("first_gap"))
    rows = plan.join(F.broadcast(gap))  # one row
    before = F.col("first_gap").isNull() | (F.col("id") < F.col("first_gap"))
    return rows.agg(F.count("*").alias("planned"), F.count_if("done").alias("recorded"), F.count_if(~F.col("done")).alias("pending"), F.count_if(before).alias("contiguous_prefix"))


def weighted_picks(items: DataFrame, draws: DataFrame, key: str, weight: str, blocks: int = 1 << 16) -> DataFrame:
    """draws(u in [0, 1), ..) with the item in whose share of all weights, in key order, u falls.

    Cumulative weights are running sums of block sums and sums inside a block of keys; draws meet items by an
    equi-join on blocks of the unit interval that an item's share touches."""
    rows = items.withColumn("_b", F.floor(F.col(key) / 4096))
    per = rows.groupBy("_b").agg(F.sum(weight).alias("_w"))
    per = per.select("_b", (F.sum("_w").over(Window.orderBy("_b")) - F.col("_w")).alias("_before"), F.sum("_w").over(Window.partitionBy()).alias("_total"))  # a row for each 4096 keys
    hi = F.col("_before") + F.sum(weight).over(Window.partitionBy("_b").orderBy(key))
    rows = rows.join(per, "_b").withColumn("_hi", hi).withColumn("_lo", F.col("_hi") - F.col(weight)).where(F.col(weight) > 0)
    block = lambda x: F.floor(x * blocks)
    rows = rows.withColumn("_k", F.explode(F.sequence(block(F.col("_lo") / F.col("_total")), F.least(F.lit(blocks - 1).cast("long"), block(F.col("_hi") / F.col("_total"))))))
    at = F.col("u") * F.col("_total")
    return draws.withColumn("_k", block(F.col("u"))).join(rows, "_k").where((at >= F.col("_lo")) & (at < F.col("_hi"))).drop("_k", "_b", "_before", "_total", "_hi", "_lo")


def gallery(rows: DataFrame, page: int, order: list[Column], size: int = 20, **filters) -> DataFrame:
    """A page (from 0) of rows after filters by column (None: no filter), with their place on it; only the rows up to its end are sorted."""
    for name, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    top = rows.orderBy(*order).limit((page + 1) * size)
    k = F.row_number().over(Window.orderBy(*order)) - 1
    return top.withColumn("_k", k).where(F.col("_k") >= page * size).withColumn("place", (F.col("_k") % size).cast("long")).drop("_k")


def two_dates(name: Column) -> Column:
    """The two dates (eight digits each) of a name; null for a name that has fewer or more."""
    found = F.regexp_extract_all(name, F.lit("([0-9]{8})"))
    return F.when(F.size(found) == 2, found)


def stamped(rows: DataFrame) -> DataFrame:
    """rows with the versions that made them, as a column `runtime` (map of name to version)."""
    import platform

    import numpy
    import pandas
    import pyarrow

    versions = {"spark": rows.sparkSession.version, "python": platform.python_version(), "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}
    return rows.withColumn("runtime", F.create_map(*(F.lit(x) for pair in versions.items() for x in pair)))
