"""Tiles in Parquet, clustered by place: sorted by the interleaved bits of y and x, so that a window read touches few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _spread(v: Column) -> Column:
    """The low 24 bits of a number, one to every second place."""
    v = v.cast("long").bitwiseAND(F.lit(0xFFFFFF))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def interleaved(y: Column, x: Column) -> Column:
    """The place of (y, x), both from 0 to 2**24 - 1, on a curve that keeps neighbours near."""
    return F.shiftleft(_spread(y), 1).bitwiseOR(_spread(x))


def write_clustered(tiles: DataFrame, path: str, y: str = "y0", x: str = "x0", step: int = 1, files: int = 8, group_bytes: int = 1 << 20) -> None:
    """Tiles sorted along the curve of their grid places (y / step, x / step), in row groups of about group_bytes; an existing target is an error."""
    place = interleaved(F.floor(F.col(y) / step), F.floor(F.col(x) / step))
    rows = tiles.withColumn("_place", place).repartitionByRange(files, "_place").sortWithinPartitions("_place").drop("_place")
    rows.write.mode("errorifexists").option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 10).option("compression", "zstd").parquet(path)


def read_window(spark: SparkSession, path: str, top: int, left: int, bottom: int, right: int, y: str = "y0", x: str = "x0", h: str = "h", w: str = "w", most: int = 1 << 12) -> DataFrame:
    """Tiles that overlap the window. The filters on y and x reach the row groups' statistics; `most` is the largest side of a tile."""
    near = (F.col(y) > top - most) & (F.col(y) < bottom) & (F.col(x) > left - most) & (F.col(x) < right)
    return spark.read.parquet(path).where(near & (F.col(y) + F.col(h) > top) & (F.col(x) + F.col(w) > left))
