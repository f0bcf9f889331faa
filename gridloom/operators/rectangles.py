"""Joins of rectangles by a grid that is refined where it is crowded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import staged, unstaged

BOX = ["x0", "y0", "x1", "y1"]


def _cells(boxes: DataFrame, size: int, inside: bool = False) -> DataFrame:
    """Each box in each cell of `size` that it touches; `inside`: boxes that are in a cell of twice that, only in its four parts."""
    near = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size))
    if inside:
        half = lambda c: F.array(2 * F.col(c), 2 * F.col(c) + 1)
        return boxes.withColumn("cy", F.explode(F.array_intersect(near("y0", "y1"), half("cy")))).withColumn("cx", F.explode(F.array_intersect(near("x0", "x1"), half("cx"))))
    return boxes.withColumn("cy", F.explode(near("y0", "y1"))).withColumn("cx", F.explode(near("x0", "x1")))


def rectangle_join(left: DataFrame, right: DataFrame, size: int = 1024, most: int = 1 << 20, key: str = "scene") -> DataFrame:
    """left and right(key, x0, y0, x1, y1 exclusive, ..), integers -> their columns, prefixed l_ and r_ but for the key, of all pairs that overlap.

    Boxes meet in the cells of a grid. A cell in which the two sides have over `most` pairs is cut in four and its boxes are dealt
    to the parts, again and again down to single pixels (whose boxes all overlap). A pair counts in the cell that holds
    the upper left corner of its overlap, so it is found once whatever cells it shares. `size` is a power of two. Empty boxes and null keys match nothing."""
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")
    named = lambda df, p: df.where("x0 < x1 AND y0 < y1").select(F.col(key), *BOX, F.struct(*(F.col(c).alias(p + c) for c in df.columns if c != key)).alias(p))
    sides, found, old = [_cells(named(df, p), size) for df, p in ((left, "l_"), (right, "r_"))], [], []
    while True:
        a, b = sides = [staged(s, "cells") for s in sides]
        unstaged(*old)
        cell = [key, "cy", "cx"]
        counts = a.groupBy(*cell).agg(F.count("*").alias("na")).join(b.groupBy(*cell).agg(F.count("*").alias("nb")), cell)
        counts = staged(counts.select(*cell, ((F.col("na") * F.col("nb") > most) & F.lit(size > 1)).alias("crowded")), "counts")
        calm = counts.where("NOT crowded").select(*cell)
        other = b.select(*cell, *(F.col(c).alias("o" + c) for c in BOX), "r_")
        met = a.join(calm, cell).join(other, cell).where("x0 < ox1 AND ox0 < x1 AND y0 < oy1 AND oy0 < y1")
        corner = (F.floor(F.greatest("y0", "oy0") / size) == F.col("cy")) & (F.floor(F.greatest("x0", "ox0") / size) == F.col("cx"))
        found.append(staged(met.where(corner).select(key, "l_.*", "r_.*"), "pairs"))
        crowded = counts.where("crowded").select(*cell)
        if not crowded.limit(1).count():
            unstaged(a, b, counts)
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            return out
        size //= 2
        sides, old = [_cells(s.join(crowded, cell), size, True) for s in (a, b)], [a, b, counts]
