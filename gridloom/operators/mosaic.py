"""Whole rasters as mosaics of tiles: stencils by halo exchange and connected regions by seams.

A tile is a row (scene, y0, x0, h, w, height, width, data): its place and size, the extent of its scene and its values,
row-major. Tiles lie on a grid of `step` pixels; the last of a row or column may be smaller. No task holds a
scene: a stencil sends each neighbour only the pixels that lie in its border, and regions are labelled in their
tiles and joined where runs meet across a seam."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.regions import tile_runs
from gridloom.session import staged, unstaged

PLACE = ["scene", "y0", "x0", "h", "w", "height", "width"]


def mosaic(tiles: DataFrame, number: Column, across: int, side: int, scene: Column | None = None) -> DataFrame:
    """Square tiles(.., data) laid out row by row, `across` to a row, by their number from 0; rows of a scene whose last
    row of tiles is not full have no values there."""
    row, column = F.floor(number / across).cast("int"), (number % across).cast("int")
    rows = tiles.select((scene if scene is not None else F.lit(0)).cast("long").alias("scene"), (row * side).alias("y0"), (column * side).alias("x0"), F.lit(side).alias("h"), F.lit(side).alias("w"), "data", *[c for c in tiles.columns if c != "data"])
    extent = rows.groupBy("scene").agg((F.max("y0") + side).alias("height"), (F.max("x0") + side).alias("width"))
    return rows.join(extent, "scene")


def cut(tiles: DataFrame, step: int) -> DataFrame:
    """The same scenes in tiles of another size: each tile sends its part of every new tile, which are put together."""
    return _padded(tiles, 0, step, lambda canvas, r: {"data": canvas}, ["data"])


def _messages(tiles: DataFrame, depth: int, step: int) -> DataFrame:
    """Per tile of the grid: place, and the parts (y, x, h, w, data) of all tiles that lie in it or its border."""
    reach = lambda at, size, extent: F.sequence(F.greatest(F.floor((at - depth) / step), F.lit(0)).cast("int"), F.least(F.floor((at + size - 1 + depth) / step), F.floor((extent - 1) / step)).cast("int"))
    rows = tiles.withColumn("ty", F.explode(reach(F.col("y0"), F.col("h"), F.col("height")))).withColumn("tx", F.explode(reach(F.col("x0"), F.col("w"), F.col("width"))))
    top, left = F.greatest("y0", F.col("ty") * step - depth), F.greatest("x0", F.col("tx") * step - depth)
    rows = rows.withColumn("top", top).withColumn("left", left)
    rows = rows.withColumn("ph", F.least(F.col("y0") + F.col("h"), (F.col("ty") + 1) * step + depth) - F.col("top")).withColumn("pw", F.least(F.col("x0") + F.col("w"), (F.col("tx") + 1) * step + depth) - F.col("left"))
    at = lambda i: F.get("data", ((F.col("top") - F.col("y0") + F.floor(i / F.col("pw"))) * F.col("w") + F.col("left") - F.col("x0") + i % F.col("pw")).cast("int"))
    whole = (F.col("ph") == F.col("h")) & (F.col("pw") == F.col("w"))
    part = F.when(whole, F.col("data")).otherwise(F.transform(F.sequence(F.lit(0), F.col("ph") * F.col("pw") - 1), at))
    parts = F.collect_list(F.struct(F.col("top").alias("y"), F.col("left").alias("x"), F.col("ph").alias("h"), F.col("pw").alias("w"), part.alias("data")))
    met = rows.groupBy("scene", "ty", "tx").agg(F.max("height").alias("height"), F.max("width").alias("width"), parts.alias("parts"))
    y0, x0 = F.col("ty") * step, F.col("tx") * step
    return met.select("scene", y0.alias("y0"), x0.alias("x0"), F.least(F.lit(step), F.col("height") - y0).alias("h"), F.least(F.lit(step), F.col("width") - x0).alias("w"), "height", "width", "parts")


def _padded(tiles: DataFrame, depth: int, step: int, f: Callable[[np.ndarray, tuple], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                canvas = np.full((r.h + 2 * depth, r.w + 2 * depth), np.nan)
                inside = False
                for p in r.parts:
                    y, x = p["y"] - r.y0 + depth, p["x"] - r.x0 + depth
                    values = np.array(p["data"], float).reshape(p["h"], p["w"])
                    y_end, x_end = min(y + p["h"], len(canvas)), min(x + p["w"], canvas.shape[1])
                    canvas[y:y_end, x:x_end] = values[: y_end - y, : x_end - x]
                    inside |= y < depth + r.h and y_end > depth and x < depth + r.w and x_end > depth
                if inside:
                    made = f(canvas, r)
                    out.append((*r[:7], *(made[n].ravel() for n in names)))
            yield pd.DataFrame(out, columns=[*PLACE, *names])

    kind = "scene long, y0 int, x0 int, h int, w int, height int, width int"
    return _messages(tiles, depth, step).mapInPandas(run, kind + "".join(f", {n} array<double>" for n in names))


def _reflected(canvas: np.ndarray, r, depth: int) -> np.ndarray:
    """The canvas with pixels outside the scene taken from inside, the edge itself not repeated."""
    if depth >= min(r.height, r.width):
        raise ValueError("the border is as wide as the scene")

    def index(start: int, size: int, extent: int) -> np.ndarray:
        at = np.arange(start - depth, start + size + depth)
        at = np.where(at < 0, -at, at)
        return np.where(at >= extent, 2 * (extent - 1) - at, at) - (start - depth)

    return canvas[np.ix_(index(r.y0, r.h, r.height), index(r.x0, r.w, r.width))]


def box_mean(tiles: DataFrame, size: int, step: int) -> DataFrame:
    """Sliding mean of those of size x size pixels (size odd) that have a value, scene borders reflected: PLACE, mean."""
    depth = size // 2

    def sums(a: np.ndarray) -> np.ndarray:
        total = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]

    def f(canvas: np.ndarray, r) -> dict[str, np.ndarray]:
        wide = _reflected(canvas, r, depth)
        there = ~np.isnan(wide)
        here = there[depth:-depth, depth:-depth] if depth else there
        count = sums(there.astype(np.int64))
        return {"mean": np.divide(sums(np.where(there, wide, 0.0)), count, out=np.full(here.shape, np.nan), where=here)}

    return _padded(tiles, depth, step, f, ["mean"])


def gradient(tiles: DataFrame, spacing: float, step: int) -> DataFrame:
    """Central differences to the east and north, one-sided where there is no value on a side: PLACE, east, north."""

    def slope(before: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
        low, high = np.isnan(before), np.isnan(after)
        gap = spacing * (2.0 - low - high)
        return np.divide(np.where(high, here, after) - np.where(low, here, before), gap, out=np.zeros_like(here), where=gap > 0)

    def f(canvas: np.ndarray, r) -> dict[str, np.ndarray]:
        here = canvas[1:-1, 1:-1]
        return {"east": slope(canvas[1:-1, :-2], here, canvas[1:-1, 2:]), "north": slope(canvas[2:, 1:-1], here, canvas[:-2, 1:-1])}

    return _padded(tiles, 1, step, f, ["east", "north"])


def boundary(masks: DataFrame, step: int) -> DataFrame:
    """Of data of 0 and 1: the set pixels with an unset or absent 4-neighbour, and those with their 4-neighbours: PLACE, mask, edge, halo."""

    def f(canvas: np.ndarray, r) -> dict[str, np.ndarray]:
        m = np.nan_to_num(canvas) > 0
        edge = m[1:-1, 1:-1] & ~(m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:])
        halo = edge[1:-1, 1:-1] | edge[:-2, 1:-1] | edge[2:, 1:-1] | edge[1:-1, :-2] | edge[1:-1, 2:]
        there = ~np.isnan(canvas[2:-2, 2:-2])
        return {"mask": canvas[2:-2, 2:-2], "edge": (edge[1:-1, 1:-1] & there).astype(float), "halo": (halo & there).astype(float)}

    return _padded(masks, 2, step, f, ["mask", "edge", "halo"])


def max_step(tiles: DataFrame, step: int) -> DataFrame:
    """scene, max_step: the largest difference of neighbouring pixels of each scene."""

    def f(canvas: np.ndarray, r) -> dict[str, np.ndarray]:
        here = canvas[1:-1, 1:-1]
        both = np.concatenate([np.abs(here - canvas[1:-1, 2:]).ravel(), np.abs(here - canvas[2:, 1:-1]).ravel()])
        both = both[~np.isnan(both)]
        return {"top": both.max(keepdims=True) if len(both) else np.zeros(0)}

    return _padded(tiles, 1, step, f, ["top"]).groupBy("scene").agg(F.max(F.get("top", F.lit(0))).alias("max_step"))


def pixels(tiles: DataFrame, *names: str) -> DataFrame:
    """scene, y, x and the named arrays' values, one row a pixel that has one."""
    rows = tiles.select("scene", "y0", "x0", "w", F.posexplode(F.arrays_zip(*names)).alias("pos", "p"))
    rows = rows.select("scene", (F.col("y0") + F.floor(F.col("pos") / F.col("w"))).cast("int").alias("y"), (F.col("x0") + F.col("pos") % F.col("w")).cast("int").alias("x"), *(F.col(f"p.{n}").alias(n) for n in names))
    return rows.where(~F.isnan(F.col(names[0])))


# ---- regions across tiles ---------------------------------------------------------------------


def _local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regions of each tile, with the cells of its border that they hold and those beyond it that they touch."""
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            mask, score = (np.array(a, float).reshape(r.h, r.w) for a in (r.mask, r.data))
            found: dict[int, list] = {}
            for y, lo, hi, label in tile_runs(np.nan_to_num(mask) > 0):
                found.setdefault(label, []).append((y, lo, hi))
            for label, own in found.items():
                cells, beyond = set(), set()
                for y, lo, hi in own:
                    y_, a, b = y + r.y0, lo + r.x0, hi + r.x0
                    if y == 0:
                        cells |= {(y_, x) for x in range(a, b)}
                    if lo == 0:
                        cells.add((y_, a))
                    if hi == r.w:
                        cells.add((y_, b - 1))
                        beyond |= {(y_ + d, b) for d in (-1, 0, 1)}
                    if y == r.h - 1:
                        cells |= {(y_, x) for x in range(a, b)}
                        beyond |= {(y_ + 1, x) for x in range(a - 1, b + 1)}
                ys, los, his = zip(*own)
                peak = max(float(np.nanmax(score[y, lo:hi])) for y, lo, hi in own)
                place = lambda s: [{"y": y, "x": x} for y, x in sorted(s)]
                out.append((r.scene, (label // r.w + r.y0) * r.width + label % r.w + r.x0, sum(his) - sum(los), min(los) + r.x0, min(ys) + r.y0, max(his) + r.x0, max(ys) + 1 + r.y0, peak, [{"y": y + r.y0, "lo": lo + r.x0, "hi": hi + r.x0} for y, lo, hi in own], place(cells), place(beyond)))
        yield pd.DataFrame(out, columns=["scene", "label", "area_px", "x0", "y0", "x1", "y1", "peak", "runs", "cells", "beyond"])


def closed(edges: DataFrame) -> DataFrame:
    """edges(scene, a, b), both ways -> scene, id, label: the least id that each is linked to. Least ids spread, and
    each step follows the label of the label too, so a chain of n takes about log n steps."""
    edges = staged(edges, "seams")
    now = staged(edges.select("scene", F.col("a").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    while True:
        seen = edges.join(now.select("scene", F.col("id").alias("b"), F.col("label").alias("seen")), ["scene", "b"]).groupBy("scene", F.col("a").alias("id")).agg(F.min("seen").alias("seen"))
        near = now.join(seen, ["scene", "id"]).select("scene", "id", "label", F.least("label", "seen").alias("least"))
        jump = now.select("scene", F.col("id").alias("least"), F.col("label").alias("further"))
        new = staged(near.join(jump, ["scene", "least"]).select("scene", "id", F.least("least", "further").alias("new"), "label"), "labels")
        unstaged(now)
        changed = new.where("new <> label").limit(1).count()
        now = new.select("scene", "id", F.col("new").alias("label"))
        now.staged_at = new.staged_at
        if not changed:
            unstaged(edges)
            return now


def labelled(tiles: DataFrame) -> DataFrame:
    """tiles(PLACE, data, mask) -> the parts of 8-connected regions that each tile holds: scene, label (least y * width + x of
    the region's first run), area_px, x0, y0, x1, y1, peak of data, runs."""
    kind = "scene long, label long, area_px long, x0 int, y0 int, x1 int, y1 int, peak double, runs array<struct<y:int,lo:int,hi:int>>, cells array<struct<y:int,x:int>>, beyond array<struct<y:int,x:int>>"
    parts = staged(tiles.select(*PLACE, "data", "mask").mapInPandas(_local, kind), "parts")
    told = parts.select("scene", F.col("label").alias("a"), F.explode("beyond").alias("at"))
    held = parts.select("scene", F.col("label").alias("b"), F.explode("cells").alias("at"))
    met = told.join(held, ["scene", "at"]).select("scene", "a", "b").where("a <> b").distinct()
    labels = closed(met.union(met.select("scene", "b", "a")).distinct())
    final = labels.select("scene", F.col("id").alias("label"), F.col("label").alias("final"))
    return parts.drop("cells", "beyond").join(final, ["scene", "label"], "left").withColumn("label", F.coalesce("final", "label")).drop("final")


def regions(parts: DataFrame) -> DataFrame:
    """What labelled() gives, a row a region: scene, label, area_px, x0, y0, x1, y1 (exclusive), peak, equivalent_width."""
    out = parts.groupBy("scene", "label").agg(F.sum("area_px").alias("area_px"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("peak").alias("peak"))
    return out.withColumn("equivalent_width", F.sqrt("area_px"))
