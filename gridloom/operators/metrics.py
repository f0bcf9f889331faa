"""Segmentation metrics over tables of (prediction, truth, valid); a metric without a denominator is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.mathx import ratio


def counts(prediction: Column, truth: Column, valid: Column | None = None) -> list[Column]:
    """tp, fp, fn, tn of the valid rows."""
    valid = F.lit(True) if valid is None else valid
    one = lambda p, t, name: F.count_if(valid & (prediction == p) & (truth == t)).alias(name)
    return [one(1, 1, "tp"), one(1, 0, "fp"), one(0, 1, "fn"), one(0, 0, "tn")]


def scores(df: DataFrame) -> DataFrame:
    """df with tp, fp, fn -> iou, f1, precision, recall added, rounded to 6 digits."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r = lambda a, b: F.round(ratio(a.cast("double"), b), 6)
    return df.withColumns({"iou": r(tp, tp + fp + fn), "f1": r(2 * tp, 2 * tp + fp + fn), "precision": r(tp, tp + fp), "recall": r(tp, tp + fn)})


def weighted_error(prediction: Column, target: Column) -> Column:
    """Mean squared error that counts pixels by 1 + 4 target."""
    return F.avg((prediction - target) ** 2 * (1 + 4 * target))


def dice_loss(prediction: Column, target: Column) -> Column:
    return 1 - (2 * F.sum(prediction * target) + 1) / (F.sum(prediction) + F.sum(target) + 1)


def cross_entropy(prediction: Column, target: Column) -> Column:
    p = F.least(F.greatest(prediction, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -F.avg(target * F.log(p) + (1 - target) * F.log(1 - p))


def scored(df: DataFrame, model, features: str, schema: str) -> DataFrame:
    """Inference: model(numpy matrix) -> scores, over Arrow batches; schema names the columns that stay and `score`."""
    import numpy as np

    def run(batches):
        for batch in batches:
            yield batch.assign(score=model(np.stack(batch[features].to_numpy())) if len(batch) else []).drop(columns=[features])

    return df.mapInPandas(run, schema)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rotated_axes(east: Column, north: Column, angle: Column) -> tuple[Column, Column]:
    """Coordinates along and across an axis at an angle (radians) from east."""
    return east * F.cos(angle) + north * F.sin(angle), north * F.cos(angle) - east * F.sin(angle)


def scaled_thickness(thickness: Column, cycles: Column, wanted: float, lo: float = 0.1, hi: float = 8.0) -> Column:
    """The thickness at which a scene would show the wanted cycles, within bounds."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), thickness * wanted / F.greatest(cycles, F.lit(1e-6))))
