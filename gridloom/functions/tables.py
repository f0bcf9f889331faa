"""Table functions for SQL and lateral joins: window starts, patches and runs.

    register(spark)
    SELECT s.scene, p.* FROM scenes s, LATERAL patches(s.height, s.width, 256, 192) p
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, ShortType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _starts(length: int, size: int, stride: int) -> list[int]:
    last = max(length - size, 0)
    return [*range(0, last, stride), last]


def _whole_numbers(*arguments: AnalyzeArgument) -> None:
    """Refuses types that are not whole numbers, and sizes and strides below 1 that are known before any row is read."""
    for k, a in enumerate(arguments):
        if not isinstance(a.dataType, (IntegerType, LongType, ShortType)):
            raise ValueError(f"argument {k + 1} is not a whole number")
    for a in arguments[-2:]:
        if a.isConstantExpression and (a.value is None or a.value < 1):
            raise ValueError("size and stride must be at least 1")


class TileStarts:
    """Starts of windows of a size that cover a length, a stride apart, the last one moved back to fit."""

    @staticmethod
    def analyze(length: AnalyzeArgument, size: AnalyzeArgument, stride: AnalyzeArgument) -> AnalyzeResult:
        _whole_numbers(length, size, stride)
        return AnalyzeResult(StructType().add("start", IntegerType()))

    def eval(self, length: int, size: int, stride: int) -> Iterator[tuple[int]]:
        if None not in (length, size, stride):
            yield from ((s,) for s in _starts(length, size, stride))


class Patches:
    """Windows of a raster: top, left, bottom, right (exclusive, within the raster)."""

    @staticmethod
    def analyze(height: AnalyzeArgument, width: AnalyzeArgument, size: AnalyzeArgument, stride: AnalyzeArgument) -> AnalyzeResult:
        _whole_numbers(height, width, size, stride)
        schema = StructType()
        for name in ("top", "left", "bottom", "right"):
            schema.add(name, IntegerType())
        return AnalyzeResult(schema)

    def eval(self, height: int, width: int, size: int, stride: int) -> Iterator[tuple[int, int, int, int]]:
        if None not in (height, width, size, stride):
            for y in _starts(height, size, stride):
                for x in _starts(width, size, stride):
                    yield y, x, min(y + size, height), min(x + size, width)


class ArrayRuns:
    """Runs of the true or non-zero values of an array: lo, hi (exclusive)."""

    @staticmethod
    def analyze(values: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(values.dataType, ArrayType):
            raise ValueError("argument 1 is not an array")
        return AnalyzeResult(StructType().add("lo", IntegerType()).add("hi", IntegerType()))

    def eval(self, values: list) -> Iterator[tuple[int, int]]:
        start = None
        for k, v in enumerate([*(values or []), 0]):
            if v and start is None:
                start = k
            elif not v and start is not None:
                yield start, k
                start = None


def register(spark: SparkSession) -> None:
    for name, function in (("tile_starts", TileStarts), ("patches", Patches), ("array_runs", ArrayRuns)):
        spark.udtf.register(name, udtf(function))
