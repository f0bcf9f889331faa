"""Connected regions of set pixels (8 neighbours), by row runs: inside a tile in one pass over its row, across a
raster of many rows as a relational closure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.raster import runs, touching_runs
from gridloom.session import staged, unstaged


def labelled_runs(found: DataFrame, key: str, width: int, most: int = 10_000) -> DataFrame:
    """runs(key, y, lo, hi) with the least run id (y * width + lo) of their region.

    Least ids spread over touching runs; each step also follows the label of the label, so a path of n
    runs takes about log n steps. Steps are staged in the shared folder."""
    nodes = found.withColumn("id", (F.col("y") * width + F.col("lo")).cast("long"))
    touch = touching_runs(found, key).select(key, (F.col("ay") * width + F.col("alo")).cast("long").alias("a"), (F.col("by") * width + F.col("blo")).cast("long").alias("b"))
    edges = staged(touch.union(touch.select(key, "b", "a")).toDF(key, "id", "other"), "edges")
    now = old = staged(nodes.withColumn("label", F.col("id")), "labels")
    for _ in range(most):
        other = edges.join(now.select(key, F.col("id").alias("other"), F.col("label").alias("seen")), [key, "other"]).groupBy(key, "id").agg(F.min("seen").alias("seen"))
        near = now.join(other, [key, "id"], "left").withColumn("least", F.least("label", F.coalesce("seen", "label")))
        jump = near.select(key, F.col("id").alias("least"), F.col("least").alias("further"))
        new = near.join(jump, [key, "least"], "left").select(key, "y", "lo", "hi", "id", F.least("least", F.coalesce("further", "least")).alias("new"), "label")
        new = staged(new, "labels")
        unstaged(old)
        old = new
        changed = new.where("new <> label").limit(1).count()
        now = new.select(key, "y", "lo", "hi", "id", F.col("new").alias("label"))
        if not changed:
            unstaged(edges)
            return now
    raise RuntimeError("regions did not settle")


def tile_runs(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """y, lo, hi and label of the runs of one mask; the label is the least run id (y * width + lo) of the region."""
    width, runs, above = mask.shape[1], [], []
    root: dict[int, int] = {}

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        own, k = [], 0
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            i = y * width + lo
            root[i] = i
            while k < len(above) and above[k][1] < lo:
                k += 1
            for a, _, j in above[k:]:
                if a > hi:
                    break
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
            own.append((lo, hi, i))
            runs.append((y, lo, hi, i))
        above = own
    return [(y, lo, hi, top(i)) for y, lo, hi, i in runs]


def labelled_tiles(tiles: DataFrame, key: str, width: int) -> DataFrame:
    """tiles(key, data of 0 and 1) -> key, y, lo, hi, id, label as labelled_runs() has them; no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, y, lo, hi, y * width + lo, label) for k, d in zip(frame[key], frame["data"]) for y, lo, hi, label in tile_runs(np.asarray(d).reshape(-1, width))]
            yield pd.DataFrame(found, columns=[key, "y", "lo", "hi", "id", "label"])

    rows = tiles.select(key, "data")
    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, y int, lo int, hi int, id long, label long")


def regions(found: DataFrame, key: str) -> DataFrame:
    """Labelled runs -> per region: key, region_id, area_px, x0, y0, x1, y1 (exclusive), equivalent_width, runs; largest first."""
    by = found.groupBy(key, "label").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("area_px"), F.min("lo").alias("x0"), F.min("y").alias("y0"), F.max("hi").alias("x1"), (F.max("y") + 1).alias("y1"),
        F.array_sort(F.collect_list(F.struct("y", "lo", "hi"))).alias("runs"),
    )
    order = Window.partitionBy(key).orderBy(F.desc("area_px"), "x0", "y0", "x1", "y1", "label")
    return by.select(key, F.format_string("region_%05d", F.row_number().over(order) - 1).alias("region_id"), "area_px", "x0", "y0", "x1", "y1", F.sqrt("area_px").alias("equivalent_width"), "runs")
