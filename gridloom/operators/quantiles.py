"""Exact quantiles of groups of any size, by counted value ranges.

Wanted ranks are located in ranges of values: each round proposes splitters for every open range (approximate percentiles, which
merge), counts the rows at and between them, and keeps the range that holds a rank. A rank at a splitter is found; one in a
range of at most `SMALL` rows is found by sorting those. So no task holds more than that of a group, whatever its size and
whatever values repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import staged, unstaged

SMALL, SPLITS = 10_000, 64


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], small: int = SMALL) -> DataFrame:
    """keys, n (values that are not null), q0, q1, .. : linearly interpolated quantiles of value at each share. Groups without a value
    are left out; NaN is above all numbers."""
    names = [f"_k{k}" for k in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(n) for c, n in zip(keys, names)), F.col(value).cast("double").alias("v"))
    group = F.struct(*names) if names else F.struct(F.lit(0).alias("_all"))
    rows = rows.select(group.alias("g"), "v")
    counted = staged(rows.groupBy("g").agg(F.count("*").alias("n")), "counts")
    place = F.array(*(F.lit(float(s)) for s in shares))
    ranks = F.array_distinct(F.flatten(F.transform(place, lambda s: F.array(F.floor(s * (F.col("n") - 1)), F.ceil(s * (F.col("n") - 1))))))
    # ranges of a group are apart from one another: values above lo and below hi (null: no limit), `below` rows up to lo, ranks wanted in them
    open_ = counted.select("g", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), ranks.alias("ranks"))
    found, old = [], []
    while True:
        open_ = staged(open_, "ranges")
        inside = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
        held = rows.join(open_.withColumnRenamed("g", "og"), (F.col("g") == F.col("og")) & inside)
        few = held.where(F.col("inside") <= small)
        order = Window.partitionBy("g", "below").orderBy("v")
        ranked = few.withColumn("rank", F.row_number().over(order) - 1 + F.col("below"))
        found.append(staged(ranked.where(F.array_contains("ranks", F.col("rank"))).select("g", "rank", "v"), "found"))
        many = held.where(F.col("inside") > small)
        if not open_.where(F.col("inside") > small).limit(1).count():
            break
        many = staged(many.select("g", "v", "below"), "open")  # the next rounds read no more than this
        # a row a range, staged, so that it is known to be small: no rows of a group are sorted to meet theirs
        split = staged(many.groupBy("g", "below").agg(F.array_distinct(F.percentile_approx("v", [k / SPLITS for k in range(SPLITS + 1)], 100 * SPLITS)).alias("s")), "splits")
        its = (F.col("g") == F.col("sg")) & (F.col("below") == F.col("sb"))
        at = F.size(F.filter("s", lambda s: s < F.col("v")))
        classed = many.join(split.withColumnsRenamed({"g": "sg", "below": "sb"}), its)
        classed = classed.withColumn("class", 2 * at + F.coalesce(F.get("s", at) == F.col("v"), F.lit(False)).cast("int"))
        told = split.join(open_.where(F.col("inside") > small).select(F.col("g").alias("og"), F.col("below").alias("ob"), "ranks"), (F.col("g") == F.col("og")) & (F.col("below") == F.col("ob")))
        told = told.select(F.col("g").alias("sg"), F.col("below").alias("sb"), "s", "ranks")
        counts = classed.groupBy("g", "below", "class").agg(F.count("*").alias("n")).join(told, its).drop("sg", "sb")
        upto = F.sum("n").over(Window.partitionBy("g", "below").orderBy("class"))
        counts = counts.withColumn("start", F.col("below") + upto - F.col("n"))
        counts = staged(counts.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))).where(F.size("ranks") > 0), "classes")
        k = F.floor(F.col("class") / 2).cast("int")
        found.append(counts.where("class % 2 = 1").select("g", F.explode("ranks").alias("rank"), F.get("s", k).alias("v")))
        unstaged(*old)
        old = [many, open_, split]
        rows = many.select("g", "v")
        open_ = counts.where("class % 2 = 0").select("g", F.get("s", k - 1).alias("lo"), F.get("s", k).alias("hi"), F.col("start").alias("below"), F.col("n").alias("inside"), "ranks")
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    by = values.groupBy("g").agg(F.map_from_entries(F.collect_set(F.struct("rank", "v"))).alias("values"))
    both = counted.join(by.withColumnRenamed("g", "vg"), F.col("g") == F.col("vg"))

    def quantile(share: float):
        spot = F.lit(float(share)) * (F.col("n") - 1)
        low, high = (F.element_at("values", f(spot)) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (spot - F.floor(spot)))

    return both.select(*(F.col(f"g.{n}").alias(c) for c, n in zip(keys, names)), "n", *(quantile(s).alias(f"q{k}") for k, s in enumerate(shares)))
