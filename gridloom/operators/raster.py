"""Rasters as one row a tile (data array<double>, row-major, north first) and as pixel tables.

Neighbourhood operators stay inside the row: a tile needs no shuffle, whatever the number of tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiles(df: DataFrame, key: str, data: str) -> DataFrame:
    return df.select(F.col(key), F.col(data).cast("array<double>").alias("data"))


def pixels(df: DataFrame, width: int, *keys: str) -> DataFrame:
    """keys, y, x, v for each value of data."""
    rows = df.select(*keys, F.posexplode("data").alias("pos", "v"))
    return rows.select(*keys, F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).cast("int").alias("x"), "v")


def pixel(data: Column, y: Column, x: Column, height: int, width: int) -> Column:
    """The value at (y, x); null outside."""
    inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
    return F.when(inside, F.get(data, F.when(inside, y * width + x)))


def each_pixel(f: Callable[[Column, Column], Column], height: int, width: int) -> Column:
    """Array of f(y, x) over a tile."""
    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: f(F.floor(i / width).cast("int"), (i % width).cast("int")))


def reflected(i: Column, n: int) -> Column:
    """Index with borders reflected, the edge itself not repeated."""
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


def box_mean(data: Column, size: int, height: int, width: int) -> Column:
    """Sliding mean of size x size pixels."""
    p = size // 2
    around = [(dy, dx) for dy in range(-p, p + 1) for dx in range(-p, p + 1)]
    return each_pixel(lambda y, x: sum((F.get(data, reflected(y + dy, height) * width + reflected(x + dx, width)) for dy, dx in around[1:]), F.get(data, reflected(y + around[0][0], height) * width + reflected(x + around[0][1], width))) / len(around), height, width)


def gradient(data: Column, axis: str, spacing: float, height: int, width: int) -> Column:
    """Central differences, one-sided at borders; spacing is signed (rows run south)."""

    def at(y: Column, x: Column) -> Column:
        i, n = (y, height) if axis == "y" else (x, width)
        lo, hi = F.greatest(i - 1, F.lit(0)), F.least(i + 1, F.lit(n - 1))
        value = lambda k: F.get(data, k * width + x if axis == "y" else y * width + k)
        return (value(hi) - value(lo)) / ((hi - lo) * spacing)

    return each_pixel(at, height, width)


def boundary(mask: Column, height: int, width: int) -> Column:
    """Set pixels with a 4-neighbour that is unset or outside."""
    full = lambda y, x: sum((F.coalesce(pixel(mask, y + dy, x + dx, height, width), F.lit(0)) for dy, dx in ((-1, 0), (1, 0), (0, -1))), F.coalesce(pixel(mask, y, x + 1, height, width), F.lit(0))) == 4
    return each_pixel(lambda y, x: ((F.get(mask, y * width + x) == 1) & ~full(y, x)).cast("int"), height, width)


def dilation(mask: Column, height: int, width: int) -> Column:
    """4-neighbour dilation."""
    return each_pixel(lambda y, x: F.greatest(*(F.coalesce(pixel(mask, y + dy, x + dx, height, width), F.lit(0)) for dy, dx in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)))), height, width)


def block_mean(df: DataFrame, factor: int, *keys: str) -> DataFrame:
    """Means of factor x factor pixels of a pixel table."""
    return df.groupBy(*keys, F.floor(F.col("y") / factor).cast("int").alias("by"), F.floor(F.col("x") / factor).cast("int").alias("bx")).agg(F.avg("v").alias("mean"))


def block_means(data: Column, factor: int, height: int, width: int) -> Column:
    """Means of factor x factor pixels inside the tile's row; the sides must be multiples of the factor."""
    if height % factor or width % factor:
        raise ValueError("the sides of a tile must be multiples of the factor")
    places = [(dy, dx) for dy in range(factor) for dx in range(factor)]
    at = lambda y, x: F.get(data, y * width + x)
    mean = lambda y, x: sum((at(y * factor + dy, x * factor + dx) for dy, dx in places[1:]), at(y * factor, x * factor)) / factor**2
    return each_pixel(mean, height // factor, width // factor)


def rotated(data: Column, turns: int, flip: bool, height: int, width: int) -> Column:
    """Quarter turns (counter-clockwise) of a square tile, then a left-right flip."""
    n = height

    def source(y: Column, x: Column) -> Column:
        x = width - 1 - x if flip else x
        a, b = {0: (y, x), 1: (x, n - 1 - y), 2: (n - 1 - y, n - 1 - x), 3: (n - 1 - x, y)}[turns % 4]
        return F.get(data, a * width + b)

    return each_pixel(source, height, width)


def runs(df: DataFrame, *keys: str) -> DataFrame:
    """Runs of set pixels in each row: keys, y, lo, hi (exclusive)."""
    order = Window.partitionBy(*keys, "y").orderBy("x")
    set_ = df.where("v = 1").withColumn("island", F.col("x") - F.row_number().over(order))
    return set_.groupBy(*keys, "y", "island").agg(F.min("x").cast("int").alias("lo"), (F.max("x") + 1).cast("int").alias("hi")).drop("island")


def touching_runs(df: DataFrame, *keys: str) -> DataFrame:
    """Runs of adjacent rows that touch, diagonals included: keys, y and lo of both."""
    a = df.select(*keys, F.col("y").alias("ay"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), (F.col("y") + 1).alias("next"))
    b = df.select(*keys, F.col("y").alias("next"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    return a.join(b, [*keys, "next"]).where("alo <= bhi AND blo <= ahi").select(*keys, "ay", "alo", F.col("next").alias("by"), "blo")


def tile_starts(length: Column | int, size: int, stride: int) -> Column:
    """Starts of windows that cover a length, the last one moved back to fit."""
    length = F.lit(length) if isinstance(length, int) else length
    whole = F.concat(F.sequence(F.lit(0), F.greatest(length - size, F.lit(0)), F.lit(stride)), F.array(F.greatest(length - size, F.lit(0))))
    return F.array_distinct(whole)


def taper(i: Column, size: int) -> Column:
    """Hann weight of position i in a window, at least 0.05."""
    import math

    return F.greatest(0.5 - 0.5 * F.cos(2 * math.pi * i / (size - 1)), F.lit(0.05))


def padded(data: Column, border: int, mode: str, height: int, width: int) -> Column:
    """A tile with a border on all sides: reflected (edge not repeated), edge, or constant (zeros)."""

    def at(y: Column, x: Column) -> Column:
        y, x = y - border, x - border
        if mode == "constant":
            return F.coalesce(pixel(data, y, x, height, width), F.lit(0.0))
        if mode == "edge":
            inside = lambda i, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), i))
            return F.get(data, inside(y, height) * width + inside(x, width))
        return F.get(data, reflected(y, height) * width + reflected(x, width))

    return each_pixel(at, height + 2 * border, width + 2 * border)


def cumulative(df: DataFrame, *keys: str) -> DataFrame:
    """keys, y, x, v summed over all pixels at or before (y, x) in both axes; dealt by tile once."""
    rows = df.repartition(*(F.col(k) for k in keys))
    along = F.sum("v").over(Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum("v").over(Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("v", along).withColumn("v", down).select(*keys, "y", "x", "v")


def wide_mean(df: DataFrame, size: int, height: int, width: int, key: str) -> DataFrame:
    """key, y, x, v: sliding mean of size x size pixels, borders reflected, by cumulative sums of the padded tile."""
    p, w = size // 2, width + 2 * (size // 2)
    sums = cumulative(pixels(df.select(key, padded(F.col("data"), p, "reflected", height, width).alias("data")), w, key), key)
    t = sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("s"))  # one tile a row again
    at = lambda y, x: F.when((y >= 0) & (x >= 0), F.get("s", F.when((y >= 0) & (x >= 0), y * w + x))).otherwise(0.0)
    mean = lambda y, x: (at(y + size - 1, x + size - 1) - at(y - 1, x + size - 1) - at(y + size - 1, x - 1) + at(y - 1, x - 1)) / size**2
    return pixels(t.select(key, each_pixel(mean, height, width).alias("data")), width, key)


def crop_differences(crops: DataFrame, source: DataFrame, top: int, left: int, tolerance: float, key: str) -> DataFrame:
    """crops(key, y, x, level of 128) against source(key, y, x, v) at their offset: pixels compared, and off by more than the tolerance."""
    placed = crops.select(key, (F.col("y") + top).alias("y"), (F.col("x") + left).alias("x"), (F.col("level") / 128.0).alias("was"))
    off = F.abs(F.col("was") - F.col("v")) > tolerance
    return placed.join(source, [key, "y", "x"]).groupBy(key).agg(F.count("*").alias("compared"), F.sum(off.cast("long")).alias("different"))


def acceptable(cycles: Column, percent: Column) -> Column:
    """Whether a scene is accepted: 2 to 8 cycles, 1.5 to 40 % of its area positive."""
    return cycles.between(2, 8) & percent.between(1.5, 40)


def resized(data: Column, height: int, width: int, new_height: int, new_width: int, kind: str = "bilinear") -> Column:
    """A tile resampled to any size (box or bilinear), inside its row: first its lines, then its columns."""
    from gridloom.operators.inference import weights

    def literal(size: int, wanted: int) -> Column:  # for each new pixel the source pixels that it is made of, with their weights
        rows = weights(size, wanted, kind)
        return F.array(*(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(row) if w)) for row in rows.tolist()))

    def applied(values: Column, table: Column, index, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(index(i, table), F.lit(0.0), lambda a, p: a + p["w"] * F.get(values, p["k"])))

    across, down = literal(width, new_width), literal(height, new_height)
    lines = applied(data, across, lambda i, t: F.transform(F.get(t, (i % new_width).cast("int")), lambda p: F.struct((F.floor(i / new_width) * width + p["k"]).cast("int").alias("k"), p["w"].alias("w"))), height * new_width)
    return applied(lines, down, lambda i, t: F.transform(F.get(t, F.floor(i / new_width).cast("int")), lambda p: F.struct((p["k"] * new_width + i % new_width).cast("int").alias("k"), p["w"].alias("w"))), new_height * new_width)
